"""Deduplication, links and passages against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from labelwright.llm import fingerprints, line_dedup, repeats, shingle_join
from labelwright.llm.common import shingle_sets
from labelwright.llm.components import components
from labelwright.llm.queries import QUERIES
from tests.llm.cases import copied_documents, no_documents, odd_documents

PATH = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# ---- links by shingles

def brute_links(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j:j + width]) for j in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    best = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return sorted((i, len(sets[i]), best[i]) for i in sets)


@pytest.mark.parametrize("width, percent, block", [(4, 85, 1024), (5, 80, 4), (2, 50, 8), (1, 30, 5)])
def test_links_of_copies(spark, width, percent, block):
    rows = copied_documents()
    got = shingle_join.link_documents(documents(spark, rows), width=width, percent=percent, block_docs=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, width, percent)


def test_blocks_are_cut_by_their_shingles_too(spark, monkeypatch):
    """Blocks of few shingles, some of them of a single document, lose no link."""
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 60)
    rows = copied_documents()
    got = shingle_join.link_documents(documents(spark, rows), width=4, percent=60)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, 4, 60)


def test_texts_that_share_single_shingles_form_no_group(spark, monkeypatch):
    """Each text shares one shingle with the next and is like none: no group holds them, else groups grow faster than the table."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    shared = [fresh(4) for _ in range(41)]
    rows = [(i, " ".join(fresh(20) + shared[i] + fresh(40) + shared[i + 1] + fresh(20))) for i in range(40)]
    rows += [(i + 100, " ".join(text.split()[:-1] + ["other"])) for i, text in rows[:3]]
    sizes = []

    def spied(edges):
        found = components(edges)
        sizes.append(found.groupBy("component").count().agg(F.max("count")).first()[0])
        return found
    monkeypatch.setattr(shingle_join, "components", spied)
    monkeypatch.setattr(shingle_join, "_ranks", lambda signed: np.random.default_rng(1).integers(0, 2, shingle_join.CELLS).astype(np.uint32))
    for percent in (85, 30):
        got = shingle_join.link_documents(documents(spark, rows), width=4, percent=percent)
        assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, 4, percent)
    assert sizes[0] == 2


@pytest.mark.parametrize("crowded", [2, 16])
def test_links_of_crowded_lists(spark, monkeypatch, crowded):
    """Many near copies of like and unlike sizes, few copies and exact ones: lists that are paired and lists that are chained."""
    monkeypatch.setattr(shingle_join, "CROWDED", crowded)
    rng = random.Random(crowded)
    fresh = lambda n: [f"v{rng.randrange(60)}" for _ in range(n)]
    rows = []
    for copies in (45, 20, 6, 3, 2):
        words = fresh(rng.choice((30, 80, 120)))
        for _ in range(copies):
            own = words[:len(words) - rng.choice((0, 0, 3, 9, 20))]
            for _ in range(rng.choice((0, 1, 2, 6))):
                own[rng.randrange(len(own))] = rng.choice(fresh(3))
            rows.append((len(rows), " ".join(own)))
    rows += [(i + 1000, text) for i, text in rows[::5]] + [(2000 + i, " ".join(fresh(rng.choice((1, 3, 5, 9))))) for i in range(30)]
    for width, percent in ((4, 85), (1, 60)):
        got = shingle_join.link_documents(documents(spark, rows), width=width, percent=percent)
        assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, width, percent)


def test_links_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op7_shingle_join"](spark, PATH).collect()) == brute_links(rows, 4, 85)


def test_divide_skip_against_all_pairs():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 4000, 60) for _ in range(6)]
    sets = []
    for _ in range(120):
        own = base[rng.integers(6)].copy()
        own[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 4000)
        sets.append(np.unique(np.append(own, rng.integers(0, 4000, rng.integers(0, 6)))).astype(np.uint64))
    def closed(links):
        best = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                best[a] = best[b] = min(best[a], best[b])
        return best
    truth = [(i, j) for i, j in combinations(range(120), 2) for n in [len(np.intersect1d(sets[i], sets[j]))] if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert closed(shingle_join.divide_skip(sets, 80)) == closed(truth)


def test_links_of_odd_rows(spark):
    got = shingle_join.link_documents(odd_documents(spark)).collect()
    assert len(got) == 13
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)]
    assert by_id[7] == [(3, 5)] and sorted(by_id[5]) == [(3, 5), (3, 5), (8, 5)] and by_id[8] == [(1, 8)]
    assert sorted(by_id[None]) == [(0, None), (5, None)]
    assert shingle_join.link_documents(no_documents(spark)).count() == 0
    kept = shingle_join.keep_one_of_each(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 6, 8, 9]  # id 5 has two unlike texts


def test_links_of_ids_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (5, a), (2, b), (5, b), (9, b + " more"), (7, a), (7, "some other words of no copy at all")]
    got = shingle_join.link_documents(documents(spark, rows))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(i, 1) for i in (1, 2, 5, 7, 9)}
    kept = shingle_join.keep_one_of_each(documents(spark, rows + rows))
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[0], rows[2], rows[6]])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100, 300)] + [(7, 9), (9, 7), (8, 8), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 7: 7, 9: 7}


def test_shingles_ignore_ascii_case_only(spark):
    import pyarrow as pa
    sets = list(shingle_sets(pa.array(["A b\x0bC d", "a B c D", "Ä b c d", "ä b c d", None, "a\xa0b c d e"]), 4))
    assert sets[0].tolist() == sets[1].tolist() and sets[2].tolist() != sets[3].tolist() and [len(s) for s in sets] == [1, 1, 1, 1, 0, 1]


# ---- lines

def letters(x):
    return max(1, len(regex.sub(r"[^\p{L}\p{N}]+", "", x)))


def brute_lines(rows, min_letters):
    """Delete every line of a run that also begins earlier, whatever its length."""
    ordered = sorted(rows)
    lines = {i: [(j, x) for j, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in ordered}
    first = {}
    places = [(i, p) for i, _ in ordered for p in range(len(lines[i]))]
    gone = {i: set() for i, _ in ordered}
    for i, p in places:
        run = []
        for n in range(p, len(lines[i])):
            run.append(lines[i][n][1])
            key = tuple(run)
            if first.setdefault(key, (i, p)) < (i, p) and sum(map(letters, run)) >= min_letters:
                gone[i].update(lines[i][m][0] for m in range(p, n + 1))
    return sorted((i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]), len(gone[i])) for i, t in ordered)


@pytest.mark.parametrize("min_letters", [1, 8, 40, 120])
def test_lines_against_brute_force(spark, min_letters):
    rows = copied_documents(seed=9, n=40)
    rows.append((500, "ab\ncd\nab\ncd\nab\n\nab\nab\ncd\n" * 4))
    rows.append((501, "x\n" * 70))
    cut, _, removed = line_dedup.dedup_lines(documents(spark, rows), min_letters=min_letters)
    assert sorted((r["doc_id"], r["text"], r[removed]) for r in cut.collect()) == brute_lines(rows, min_letters)


def test_lines_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    want = [(i, hashlib.sha256(t.encode()).hexdigest(), n) for i, t, n in brute_lines(rows, line_dedup.MIN_LETTERS)]
    assert sorted((r["doc_id"], r["text_sha256"], r["n_removed"]) for r in QUERIES["op2_line_dedup"](spark, PATH).collect()) == want


def test_short_lines_that_repeat_are_deleted(spark):
    docs = documents(spark, [(1, "MIT License.\nfirst text\n\t\n\r"), (2, "second text\nMIT License.\n\t\n\r\n"), (3, "}\nMIT License.\n}"), (4, "third text")])
    cut, _, removed = line_dedup.dedup_lines(docs)
    got = sorted((r["doc_id"], r["text"], r[removed]) for r in cut.collect())
    assert got == [(1, "MIT License.\nfirst text\n\t\n\r", 0), (2, "second text\n\t\n\r\n", 1), (3, "}\n}", 1), (4, "third text", 0)]


def test_structure_stays_and_runs_of_short_lines_go(spark):
    table = "|---|---|"
    verse = ["a b", "}", "c", "{", "d e", "f"]
    docs = documents(spark, [(1, "\n".join(["h 1", table, *verse])), (2, "\n".join(["h 2", table, "1", *verse, "}"])), (3, "\n".join([*verse[:4], table]))])
    array, longest = line_dedup.suffix_array(docs)
    assert longest > 4 and {"r0", "r1", "r2"} <= set(array.columns)  # three rounds of doubling
    cut, _, removed = line_dedup.dedup_lines(docs)
    got = sorted((r["doc_id"], r["text"], r[removed]) for r in cut.collect())
    assert got == [(1, "\n".join(["h 1", table, *verse]), 0), (2, f"h 2\n{table}\n1\n}}", 6), (3, "\n".join([*verse[:4], table]), 0)]


def test_runs_and_odd_lines(spark):
    docs = documents(spark, [(1, "a b c\nd e f\n\ng"), (2, "x\na b c\nd e f\ny"), (2, "x\na b c\nd e f\ny"), (None, "d e f\ng h"), (3, None), (4, ""), (5, "a b c\nd e f")])
    runs = line_dedup.line_runs(line_dedup.later_copies(docs, min_letters=6)).collect()
    assert sorted((r["doc"], r["first_line"], r["n_lines"]) for r in runs) == [(2, 1, 2), (5, 0, 2)]
    cut, n_lines, removed = line_dedup.dedup_lines(docs, min_letters=6)
    got = sorted(((r["doc_id"] or 0), r["text"] or "-", r[n_lines], r[removed]) for r in cut.collect())
    assert got == [(0, "d e f\ng h", 2, 0), (1, "a b c\nd e f\n\ng", 4, 0), (2, "x\ny", 4, 2), (2, "x\ny", 4, 2), (3, "-", 0, 0), (4, "-", 1, 0), (5, "-", 2, 2)]
    odd, n_lines, _ = line_dedup.dedup_lines(odd_documents(spark))
    assert n_lines == "_n_lines" and odd.count() == 13
    assert line_dedup.dedup_lines(no_documents(spark))[0].count() == 0


# ---- passages

def brute_passages(rows, least):
    """Words of each document that lie in a run of ``least`` words which an earlier document has."""
    where, covered = {}, {}
    for i, text in sorted(rows):
        words = text.split()
        runs = [tuple(words[p:p + least]) for p in range(len(words) - least + 1)]
        covered[i] = {q for p, r in enumerate(runs) if r in where for q in range(p, p + least)}
        for r in runs:
            where.setdefault(r, i)
    return covered


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_passages_against_brute_force(spark, partitions):
    rows = copied_documents(seed=4, n=80)
    got = repeats.repeated_passages(documents(spark, rows), partitions=partitions).collect()
    want = brute_passages(rows, repeats.MIN_WORDS)
    found = {i: set() for i, _ in rows}
    for r in got:
        assert r["n_words"] >= repeats.MIN_WORDS and r["other_doc_id"] < r["doc_id"]
        found[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    # an end may lie a chance word short of where some copy that was not compared would put it
    assert all(found[i] <= want[i] and len(want[i] - found[i]) <= 2 for i in want)
    assert sum(len(want[i]) for i in want) > 3000


def exact_passages(spark, rows):
    """The words found by the operator; each passage is one unbroken stretch and its beginning is in the other document."""
    found, words = {i: set() for i, _ in rows}, {i: t.split() for i, t in rows}
    for r in repeats.repeated_passages(documents(spark, rows)).collect():
        own = set(range(r["first_word"], r["first_word"] + r["n_words"]))
        assert not found[r["doc_id"]] & own and r["other_doc_id"] < r["doc_id"]
        a, b, least = r["first_word"], r["other_first_word"], repeats.MIN_WORDS
        assert words[r["doc_id"]][a:a + least] == words[r["other_doc_id"]][b:b + least]
        found[r["doc_id"]] |= own
    return found


def test_passages_before_a_hot_phrase(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    rows = []
    for _ in range(6):
        hot, shared = fresh(40), [fresh(10) for _ in range(10)] * 2 + [[]] * 80
        rng.shuffle(shared)
        rows += [(len(rows) + i, " ".join(fresh(30) + before + hot + fresh(30))) for i, before in enumerate(shared)]
    want = brute_passages(rows, repeats.MIN_WORDS)
    assert sum(map(bool, want.values())) == 60 and exact_passages(spark, rows) == want
    copies = copied_documents(seed=4, n=80)
    assert exact_passages(spark, copies) == brute_passages(copies, repeats.MIN_WORDS)


def test_both_places_of_a_section_that_an_earlier_document_has_in_part(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    rows = []
    for k in range(12):
        section, part = fresh(200), 60
        rows.append((10 * k + 3, " ".join(fresh(30) + section[60:60 + part] + [f"z{k}"] + fresh(30))))
        rows.append((10 * k + 5, " ".join(fresh(30) + section + fresh(40) + section + fresh(30))))
    want = brute_passages(rows, repeats.MIN_WORDS)
    assert sum(map(len, want.values())) == 12 * 2 * 60 and exact_passages(spark, rows) == want


def test_passages_are_cut_and_odd_rows(spark):
    words = [f"w{i}" for i in range(70)]
    docs = documents(spark, [(1, "start " + " ".join(words) + " end"), (2, "other " + " ".join(words) + " last"), (3, " ".join(words[:45])), (4, None), (None, " ".join(words))])
    spans = repeats.repeated_passages(docs)
    assert [tuple(r) for r in spans.collect()] == [(2, 1, 70, 1, 1)]
    assert {r["doc_id"]: r["text"] for r in repeats.without_passages(docs, spans).collect()}[2] == "other last"
    assert repeats.repeated_passages(odd_documents(spark)).count() == 0
    assert repeats.repeated_passages(no_documents(spark)).count() == 0


# ---- fingerprints

def test_edits_and_likeness_against_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op9_fingerprints"](spark, PATH).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        q = len(text) // 4
        edited = text[:len(text) - q] + rows[(k + 1) % len(rows)][1][:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        assert abs(got[i]["near_next"] - brute_likeness(text, rows[(k + 1) % len(rows)][1])) < 1e-9 and abs(got[i]["near_edited"] - brute_likeness(text, edited)) < 1e-9
    roots = {}
    for i, text in rows:
        assert roots.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(roots.values())) == len(roots)
    near = np.mean([r["near_edited"] > r["near_next"] for r in got.values()])
    assert near > 0.97


def brute_tree(text):
    """Sections of paragraphs of pieces."""
    def cut(paragraph):
        out = [""]
        for u in regex.findall(r"[^ \t]+[ \t]*|[ \t]+", paragraph):
            for c in u if len(u) > fingerprints.LONG_WORD else [u]:
                out[-1] += c
                if len(u) > fingerprints.LONG_WORD and ord(c[0]) % fingerprints.PIECE_WORDS == 0:
                    out.append("")
            if xxhash.xxh64_intdigest(u.encode(), 42) % fingerprints.PIECE_WORDS == 0:
                out.append("")
        return tuple(x for x in out if x)
    return tuple(tuple(cut(p) for p in s.split("\n")) for s in text.split("\n\n"))


def brute_likeness(one, two):
    if one == two:
        return 1.0
    a, b = (list(dict.fromkeys(s for s in brute_tree(t) if any(s) or len(s) > 1)) for t in (one, two))
    sections = sum(len(p) for s in a if s in b for p in s)
    x, y = (list(dict.fromkeys(p for s in me if s not in other for p in s if p)) for me, other in ((a, b), (b, a)))
    whole = sections + sum(len(p) for p in x if p in y)
    pa, pb = ({q for p in me if p not in other for q in p} for me, other in ((x, y), (y, x)))
    both = 2 * whole + len(pa) + len(pb)
    return 2 * (whole + len(pa & pb)) / both if both else 0.0


def test_likeness_comes_from_the_branches(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    long = line(400)
    bare = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz\u4e00\u4e8c\U0001F600") for _ in range(4000))
    text = "\n\n".join("\n".join(line(rng.randint(0, 60)) for _ in range(rng.randint(1, 5))) for _ in range(6))
    pairs = [(long, "word " + long), (bare, bare[:2000] + "#" + bare[2001:]), (text, text.replace("a", "b", 1)), (text, "\n\n".join(reversed(text.split("\n\n")))), (text, text + "\n" + line(9)),
             (text, long), ("", "x"), ("", ""), (" ", "\t"), ("\n\n", "\n"), ("a b", "a  b"), (text, None)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["n"] for r in frame.select("i", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("n")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - brute_likeness(a, b or "")) < 1e-9, (i, got[i], brute_likeness(a, b or ""))
    assert got[0] > 0.95 and got[1] > 0.95 and got[2] > 0.9 and got[5] < 0.1 and got[7] == 1
    assert got[3] == 1 and fingerprints.PIECE_WORDS == 8  # the same sections in another order have all pieces in common


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprints.edited_documents(odd_documents(spark))
    assert rows.count() == 13
    assert fingerprints.edited_documents(no_documents(spark)).count() == 0
    alone = fingerprints.edited_documents(documents(spark, [(1, "abcdefgh")])).first()
    assert alone["edited"] == "abcdefab"
    made = fingerprints.fingerprint_documents(odd_documents(spark)).collect()
    assert len({r["fingerprint"] for r in made if not r["text"]}) == 1


def test_edits_are_located(spark):
    row = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nx\ny\n\nz")], "one string, two string").select(fingerprints.edits(F.col("one"), F.col("two")).alias("e"),
        fingerprints.edits(F.col("one"), F.col("one")).alias("none")).first()
    assert [tuple(x) for x in row["e"]] == [(1, 1), (1, 2), (2, 0)] and row["none"] == []
