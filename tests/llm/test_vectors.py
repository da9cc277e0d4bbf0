"""Vector codes against plain loops, lattice links against all pairs, and odd vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.llm import lattice_dedup, vector_codes
from labelwright.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v string, far string, cell long, unit string, kept_id int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "c", "e", "v", "f", 1, "u", 2) for i, v, label in rows], SCHEMA)


def odd_vectors(width=32):
    some = np.random.default_rng(7).normal(size=(90, width)).astype(np.float32).tolist()
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(some)]
    rows += [(3, some[3], 0), (3, some[4], 1), (None, some[5], 1), (200, None, 1), (201, [None] + some[0][1:], 1), (202, [NAN] + some[0][1:], 1), (203, [INF] + some[0][1:], None),
             (204, [0.0] * width, 1), (205, [], 1), (206, some[0][:-1], 1), (207, [2 * x for x in some[0]], 1), (-5, some[9], 2), (-6, [-x for x in some[9]], 2)]
    return rows


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), label) for i, v, label in rows if fine(v)]
    first = {}
    for i, v, _ in kept:
        if i is not None and (i not in first or v.tolist() < first[i].tolist()):
            first[i] = v
    begin = [first[i] for i in sorted(first)][:entries]
    width = len(begin[0])
    begin = [first[i] for i in sorted(first) if len(first[i]) == width][:entries]
    kept = [(i, v, label) for i, v, label in kept if len(v) == width]
    cut = lambda v: v.reshape(parts, -1)
    books = [[cut(v)[j].tolist() for v in begin] for j in range(parts)]

    def code(v):
        out, error = [], 0
        for j, part in enumerate(cut(v)):
            far = [sum((int(a) - b) ** 2 for a, b in zip(part, e)) for e in books[j]]
            out.append(far.index(min(far)))
            error += min(far)
        return out, error

    for _ in range(rounds):
        codes = [code(v)[0] for _, v, _ in kept]
        for j in range(parts):
            for e in range(len(begin)):
                mine = [cut(v)[j] for (_, v, _), c in zip(kept, codes) if c[j] == e]
                if mine:
                    books[j][e] = [int(sum(int(m[k]) for m in mine)) // len(mine) for k in range(len(mine[0]))]
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, bytes(c), e, label) for (i, v, label) in kept for c, e in [code(v)]], hashlib.sha256(flat.encode()).hexdigest()


key = lambda r: (str(r[0]), *r[1:3])


@pytest.mark.parametrize("parts, entries, rounds, pivots", [(16, 64, 2, 3), (4, 7, 3, 1), (1, 200, 1, 5), (32, 1, 2, 3), (16, 64, 0, 0)])
def test_codes_against_plain_loops(spark, parts, entries, rounds, pivots):
    rows = odd_vectors()
    coded = vector_codes.code_vectors(frame(spark, rows), parts=parts, entries=entries, rounds=rounds, n_pivots=pivots)
    want, digest = brute_codes(rows, parts, entries, rounds)
    assert coded.digest() == digest
    got = [(r["vec_id"], bytes(r[coded.code]), r[coded.error], r["label"]) for r in coded.rows.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert set(coded.rows.columns) == {*SCHEMA.replace(" array<float>", "").replace(",", "").split(), coded.code, coded.error} - {"long", "int", "string", "embedding"}


def test_pivots_prune_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(1)
    points = rng.integers(-40, 40, (3000, 4))
    book = np.concatenate([points[:40], points[:24]])
    pivots = vector_codes.pivots_of(book)
    at, best, tried = vector_codes.nearest(points, vector_codes.distances(points, pivots).astype(np.float32).astype(float), pivots, book)
    far = ((points[:, None] - book[None]) ** 2).sum(-1)
    assert (at == far.argmin(1)).all() and (best == far.min(1)).all() and at.max() < 40
    assert tried < 0.4 * far.size


def test_group_totals(spark):
    rows = [(i, None if i % 3 == 0 else i % 40, i) for i in range(3000)]
    got = vector_codes.with_group_total(spark.createDataFrame(rows, "id int, key int, _n long"), "key", "_n", "total", shares=20).collect()
    want = {}
    for _, k, v in rows:
        want[k] = want.get(k, 0) + v
    assert len(got) == len(rows) and all(r["total"] == want[r["key"]] for r in got)


def test_no_codes(spark):
    for rows in ([], [(1, None, 1), (None, [1.0] * 32, 1)], [(1, [1.0] * 31, 1)], [(1, [], 1)]):
        coded = vector_codes.code_vectors(frame(spark, rows))
        assert coded.rows.count() == 0 and coded.books == []
    with pytest.raises(Exception, match="beyond"):
        vector_codes.code_vectors(frame(spark, [(1, [1e30] * 32, 1)])).rows.collect()


def test_codes_without_rows_as_a_query(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("op12_vector_codes", "op13_lattice_dedup"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


def planted(seed, n=700, width=64, groups=((1, 150), (30, 6), (60, 2)), close=(0.9, 0.999)):
    """Vectors at random, and groups around some of them."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(n, width)))
    more = []
    for count, size in groups:
        for c in base[rng.choice(n, count, replace=False)]:
            side = rng.normal(size=(size - 1, width))
            side = unit(side - (side @ c)[:, None] * c)
            cosine = rng.uniform(*close, size - 1)[:, None]
            more.append((cosine * c + np.sqrt(1 - cosine ** 2) * side) * rng.uniform(0.5, 3, (size - 1, 1)))
    return np.concatenate([base, *more]).astype(np.float32)


def brute_links(rows, least=0.9):
    usable = [(n, i, np.array(v, np.float32).astype(float)) for n, (i, v, _) in enumerate(rows) if i is not None and fine(v) and any(v)]
    links = {n: set() for n in range(len(rows))}
    for width in {len(v) for _, _, v in usable}:
        mine = [(n, v / np.linalg.norm(v)) for n, _, v in usable if len(v) == width]
        m = np.stack([v for _, v in mine])
        for a, row in enumerate(m @ m.T >= least):
            links[mine[a][0]] |= {mine[b][0] for b in np.flatnonzero(row).tolist() if b != a}
    parent = {i: i for i, _, _ in rows}
    for _ in rows:
        changed = False
        for n, others in links.items():
            for o in others:
                low = min(parent[rows[n][0]], parent[rows[o][0]])
                changed |= parent[rows[n][0]] != low or parent[rows[o][0]] != low
                parent[rows[n][0]] = parent[rows[o][0]] = low
        if not changed:
            break
    return links, parent


@pytest.mark.parametrize("seed, width, group_rows", [(0, 64, 1024), (1, 64, 30), (2, 24, 1024), (3, 200, 1024)])
def test_links_against_all_pairs(spark, monkeypatch, seed, width, group_rows):
    monkeypatch.setattr(lattice_dedup, "GROUP_ROWS", group_rows)
    rows = [(3 * i, v, 0) for i, v in enumerate(planted(seed, width=width).tolist())]
    links, parent = brute_links(rows)
    got = {r["vec_id"]: r for r in lattice_dedup.link_vectors(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    true, found = sum(len(x) for x in links.values()), sum(r["n_links"] for r in got.values())
    assert all(got[rows[n][0]]["n_links"] <= len(x) for n, x in links.items())
    assert 0.95 * true <= found <= true and true > 10_000
    same = np.mean([got[i]["component_id"] == parent[i] for i, _, _ in rows])
    assert same > 0.97 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_at_the_threshold(spark):
    """Pairs just at the least cosine are the hardest to meet."""
    rows = [(i, v, 0) for i, v in enumerate(planted(8, n=3000, groups=((1000, 2),), close=(0.9001, 0.91)).tolist())]
    links, _ = brute_links(rows)
    found = sum(r["n_links"] for r in lattice_dedup.link_vectors(frame(spark, rows)).collect())
    assert found >= 0.9 * sum(len(x) for x in links.values())


def test_links_of_odd_vectors(spark):
    rows = odd_vectors()
    links, parent = brute_links(rows)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.link_vectors(frame(spark, rows)).collect()), key=str)
    want = sorted(((i, len(links[n]), parent[i] if i is not None and fine(v) and any(v) else i, i is not None and (i == parent[i] or not (fine(v) and any(v)))) for n, (i, v, _) in enumerate(rows)), key=str)
    assert got == want  # copies and scaled copies only: all of them meet
    vectors = frame(spark, rows)
    left = lattice_dedup.drop_near_duplicates(vectors, lattice_dedup.link_vectors(vectors))
    assert left.columns == vectors.columns and left.where("vec_id in (9, 207)").count() == 0 and left.where("vec_id in (0, -5, 200)").count() == 3


def test_many_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0] * 32, 0) for i in range(3000)] + [(5000, [1.0, 2.01] * 32, 0), (5001, [-1.0, 2.0] * 32, 0)]
    got = lattice_dedup.link_vectors(frame(spark, rows)).groupBy("n_links", "component_id").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 5001, 1), (3000, 0, 3001)]


def test_decoding_finds_the_nearest_point():
    x = np.random.default_rng(2).normal(0, 2, (500, 8))
    near = lattice_dedup.decode(x)
    off = ((x - near) ** 2).sum(1)
    assert len(lattice_dedup.ROOTS) == 240 and (off <= 1 + 1e-9).all()  # the covering radius is 1
    others = near[:, None] + lattice_dedup.ROOTS[None]
    assert (((x[:, None] - others) ** 2).sum(-1) >= off[:, None] - 1e-9).all()
