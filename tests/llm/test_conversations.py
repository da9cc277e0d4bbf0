"""Conversation repair against plain forward search, long conversations over several partitions, and odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from labelwright.llm import conversations
from labelwright.llm.queries import QUERIES
from labelwright.llm.twins import ORACLES
from tests.oracle_harness import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, conv string, letters string, kind int, Turn_ long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "l", 7, 1) for r in rows], SCHEMA)


def damaged(rows):
    """(conv_id, turn, role, text) after damage, and every id."""
    out = []
    for c, t, r, x in rows:
        blank = lambda v: " " if v is None else str(v)
        hit = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        r, x = blank(r), blank(x)
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out += [(c, t, "user" if hit == 4 else r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def forward(rows):
    """The cheapest and then ASCII-least edits by trying all of them forward, with the turns they leave."""
    best = {"": (0, "", ())}  # by the last role initial

    def offer(found, last, item):
        if last not in found or item[:2] < found[last][:2]:
            found[last] = item

    def put(found, last, item, cost, letter, role, text):
        initial = role[:1]
        if initial == "s" and last == "" or initial == "u" and last != "u" or initial == "a" and last == "u":
            offer(found, initial, (item[0] + cost, item[1] + letter, (*item[2], f"{role}:{text}")))

    def inserted(found):
        for _ in range(3):
            for last, item in list(found.items()):
                for role in ("user", "assistant"):
                    put(found, last, item, 2, "I", role, "")
        return found

    for role, text, bad, cut in rows:
        found = {}
        for last, item in inserted(dict(best)).items():
            offer(found, last, (item[0] + 3, item[1] + "D", item[2]))
            if not bad:
                put(found, last, item, cut, "K", role, text)
                for other in ("user", "assistant"):
                    put(found, last, item, 2 + cut, "R", other, text)
        best = found
    return min((item for last, item in inserted(best).items() if last in ("", "a")), key=lambda i: i[:2])


def brute(rows, ids):
    out = {}
    for c in ids:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, faults, blank, duplicate, truncated, illegal = set(), [], 0, 0, 0, 0
        for i, (_, _, role, text) in enumerate(mine):
            end = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, duplicate, truncated = blank + (kind == "b"), duplicate + (kind == "d"), truncated + (kind == "t")
            illegal += i > 0 and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
            faults.append((role, text, kind in ("b", "d"), int(kind == "t")))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, said = forward(faults)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(spark, rows, **more):
    audited = conversations.audit_conversations(frame(spark, rows), **more)
    assert audited.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r)[1:] for r in audited.collect()}


def random_rows(seed, n, ids):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", None, "s", "urgent", "ätzend"]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "what?", "what? ", "x" * 3000 + ".", "\x85", "日本。", "a.b"]
    return [(rng.choice(ids), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_forward_search(spark, seed):
    rows = random_rows(seed, 300, [None, *range(40)])
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(spark, rows) == brute(filled, {r[0] for r in rows})


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["ok.", f"text {i}.", f"open {i}"])) for i in range(900)]
    rows += [(2, 0, "user", "same.")] * 200 + [(c, t, r, "fine.") for c in range(3, 9) for t, r in enumerate(["user", "assistant"])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        borders = []
        made = conversations.Borders
        conversations.Borders = lambda summary: borders.append(made(summary)) or borders[-1]
        assert got(spark, rows) == brute(rows, {r[0] for r in rows})
        assert len(borders[0].ends) > 5  # the conversation went over that many borders
    finally:
        conversations.Borders = made
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_costs_are_held_at_checkpoints_only():
    rng = random.Random(3)
    rows = [(rng.choice("usax"), rng.random() < 0.2, rng.random() < 0.3, rng.randint(1, 3)) for _ in range(400)]
    held, calls = [], [0]
    plain = conversations.before

    def counted(v, row):
        calls[0] += 1
        return plain(v, row)

    conversations.before = counted
    try:
        letters = "".join(x for x, _ in conversations.walk(rows, 0, conversations.END))
    finally:
        conversations.before = plain
    assert calls[0] == 2 * len(rows)  # once backward, once again block by block
    v = conversations.END
    for row in reversed(rows):
        held.append(v)
        v = plain(v, row)
    held.reverse()
    state, whole, here = 0, "", v
    for row, behind in zip(rows, held):
        own, state = conversations.edit(row, state, here, behind)
        whole, here = whole + own, behind
    assert letters == whole


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?"), (2, 0, "user", "")]
    turns = conversations.repair_conversations(frame(spark, rows))
    assert [tuple(r) for r in turns.orderBy("conv_id", "place").collect() if r["edit"] != "D"] == [
        (1, 1, "K", "system", "Be kind."), (1, 2, "I", "user", ""), (1, 3, "K", "assistant", "Hello."), (1, 4, "K", "user", "Hi?"), (1, 5, "I", "assistant", "")]
    assert [tuple(r)[3:] for r in turns.where("edit = 'D'").orderBy("conv_id").collect()] == [("user", "Hi?"), ("user", "")]


def test_empty_and_absent(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, []) == {}
    assert got(spark, [(1, 1, "user", "Hi."), (None, None, None, None)], present=F.lit(False)) == {i: (0, 0, 0, 0, 0, 0, "", empty) for i in (1, None)}


def test_query_on_odd_rows_as_python_and_sql(spark, tmp_path):
    import duckdb
    rows = random_rows(5, 500, [None, *range(60)])
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    mine = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_repair_conversations"](spark, str(tmp_path)).collect()}
    assert mine == brute(damaged(rows), {r[0] for r in rows})
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    problem, _ = compare(spark, con, "op11", QUERIES["op11_repair_conversations"], ORACLES["op11_repair_conversations"], str(tmp_path))
    assert problem is None, problem


def test_query_on_the_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in connect(path).execute("select conv_id, turn, role, text from conversations").fetchall()]
    mine = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_repair_conversations"](spark, path).collect()}
    assert mine == brute(damaged(rows), {r[0] for r in rows})
