import numpy as np
import pytest
from pyspark.sql import functions as F

from posrecon.llm import neighbors as n

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=10):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault((i, tuple(np.float32(v).astype(float).tolist())), None)
    out = set()
    for q, v in fine:
        if is_query(q):
            best = {}
            for i, u in fine:
                if i != q and len(u) == len(v):
                    d = float(np.sqrt(np.cumsum((np.array(u) - np.array(v)) ** 2)[-1]))
                    best[i] = min(d, best.get(i, d))
            out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (6, 12))
    out = [(i, (centres[i % 6] + rng.normal(0, 1, 12)).astype(np.float32).tolist()) for i in range(600)]
    out += [(1000 + i, [1.0] * 12) for i in range(150)]  # one very common vector
    out += [(2000, None), (2100, []), (2200, [0.0] * 12), (2300, [None] + [1.0] * 11), (2400, [float("nan")] * 12)]
    out += [(2500, [float("inf")] + [0.0] * 11), (None, [2.0] * 12), (2600, [1.0, 2.0]), (2601, [1.5, 2.0]), (2700, [1.0, 2.0, 3.0])]
    out += [(5, out[5][1]), (0, [9.0] * 12)]  # a repeated row; an id with two vectors
    return out


@pytest.mark.parametrize("search", [n.PRODUCTION, n.Search(vectors_per_pivot=40, shard_rows=16, block_queries=3, leaf=4)])
def test_exact_search(spark, rows, search):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit(1) for c in ("v", "ids", "pivot", "score", "n")})
    got = {tuple(r) for r in n.neighbor_report(df, search).collect()}
    single = lambda rs: {r for r in rs if r[0] != 0}  # the query id with two vectors is checked by itself
    assert single(got) == single(brute(rows, lambda q: q % 100 == 0))
    assert len([r for r in got if r[0] == 0]) == 10


def test_relaxed_search_still_finds_most(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    exact = {r[:3] for r in brute(rows, lambda q: q % 20 == 0 and q)}
    loose = n.nearest(df, F.col("vec_id") % 20 == 0, n.Search(relax=1.3, vectors_per_pivot=100, leaf=4))
    found = {tuple(r)[:3] for r in loose.filter("query_id <> 0").collect()}
    recall = len({(q, v) for q, _, v in exact} & {(q, v) for q, _, v in found}) / len(exact)
    assert recall >= 0.9


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0], 0), (101, [0.0, 1.0], 0), (102, [0.0, 1.0], 0)], SCHEMA)
    assert [tuple(r)[:3] for r in n.neighbor_report(df).orderBy("rank").collect()] == [(100, 1, 101), (100, 2, 102)]
    assert n.neighbor_report(df.limit(0)).count() == 0
    assert n.neighbor_report(df.filter("vec_id = 100")).count() == 0


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.1, (200, 3)) for c in range(10)])
    tree, seen = n.VpTree(points, 8), []
    best = [np.inf]

    def found(rows, d):
        seen.extend(rows)
        best[0] = min(best[0], d.min())
        return best[0]

    tree.search(points[3] + 0.01, 1, np.inf, 1.0, found)
    assert best[0] == n.distances(points, points[3] + 0.01).min() and len(seen) < 600


def clustered(n_clusters, each, size=16):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 10, (n_clusters, size))
    return [(i, (centres[i % n_clusters] + rng.normal(0, 1, size)).astype(np.float32).tolist(), 0) for i in range(n_clusters * each)]


def test_work_on_clusters_is_a_small_share_and_answers_are_exact(spark):
    # Nested: 6,000 vectors, four pivots a cell at most, shards of 200 or less.
    search = n.Search(vectors_per_pivot=100, fan=4, shard_rows=200, chunk_rows=500, block_queries=20, leaf=16)
    rows = clustered(60, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    is_query = F.col("vec_id") % 100 == 0
    index = n.build_index(df, is_query, search)
    work = n.search_work(index, search).first()
    assert work["queries"] == 60 and work["vectors"] == 6000 and work["shards"] >= 30
    assert work["opened"] < 0.3 * work["queries"] * work["shards"]
    assert work["measured"] < 0.15 * work["queries"] * work["vectors"]
    got = {tuple(r) for r in n.nearest(df, is_query, search, index).collect()}
    points, ids = np.array([v for _, v, _ in rows]).astype(np.float32).astype(float), np.arange(6000)
    want = set()
    for q in range(0, 6000, 100):
        d = n.distances(points, points[q])
        best = [i for i in np.lexsort((ids, d)) if i != q][:10]
        want |= {(q, r + 1, int(i), float(d[i])) for r, i in enumerate(best)}
    assert got == want


def test_a_larger_factor_measures_less(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist(), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    is_query = F.col("vec_id") % 50 == 0
    how = {"vectors_per_pivot": 100, "shard_rows": 150, "leaf": 8}
    exact, loose = n.Search(**how), n.Search(relax=1.5, **how)
    index = n.build_index(df, is_query, exact)
    measured = [n.search_work(index, s).first()["measured"] for s in (exact, loose)]
    found = [{tuple(r)[::2] for r in n.nearest(df, is_query, s, index).collect()} for s in (exact, loose)]
    assert measured[1] < 0.8 * measured[0]
    assert len(found[0] & found[1]) >= 0.9 * len(found[0])
