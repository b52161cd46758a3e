"""Nearest neighbours with a vantage-point tree per shard.

Equal vectors are stored once, with their ids in order (of equals no more than the ``k`` +
1 smallest ids can be in any answer), and searched once. Cells are nested: a cell of more than
``shard_rows`` vectors takes some of them, those with the smallest hashes, as pivots, and its vectors go to the
nearest pivot's cell. So the number of cells grows with the vectors, and no list of pivots is longer than
``fan``. A cell that needs no split is a shard. Its vantage-point tree is built once and stored: a
node's vector splits the rest at the median of their distances from it, and the tree's shape follows from the
number of vectors, so a row per vector with its place and its two distances holds all of it.

A search leaves cells and subtrees out when the triangle inequality puts all of their vectors beyond the
``k``-th distance found so far; ``relax`` multiplies the lower bound, so values above one
leave out more, and one is exact search. Bounds of a cell are its distances from the pivot (largest and
smallest), and half of what its pivot is farther from the query than the nearest pivot beside it.

A first round searches each query's own shard. Its ``k``-th distance bounds the second, which goes down the
cells from the top, and opens only what can reach nearer. Queries and trees meet by shard and block of
that shard's queries, so no task holds all queries or all vectors. ``search_work`` tells how many vectors were measured.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither as queries nor as candidates. Vectors of different lengths are never compared.
Ties go to the smaller id; ids that repeat with one vector count once, with different
vectors as candidates of their own, and the nearest of them answers. Fewer candidates
than ``k`` give fewer rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from posrecon.llm.common import hash_place, parts_for, saved


@dataclass(frozen=True)
class Search:
    k: int = 10
    relax: float = 1.0
    #: A cell that is split gets one pivot per so many vectors, and never more than ``fan``.
    vectors_per_pivot: int = 2000
    fan: int = 1024
    shard_rows: int = 4096
    #: Splits in a row; vectors that still share a cell then are dealt to its shards by hash.
    levels: int = 8
    #: Vectors of one cell that meet its pivots in one task.
    chunk_rows: int = 65536
    block_queries: int = 4096
    leaf: int = 256


PRODUCTION = Search()

#: Rounding of the distances must not leave anything out.
_SLACK = 1 + 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): ids and vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(v, lambda x: x + 0.0).alias("v"),  # -0.0 and 0.0 are one value
    )


def distances(points, q):
    """Euclidean distances, summed component by component from the first."""
    import numpy as np

    d = points - q
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


class VpTree:
    """A tree in rows: points in tree order, and for a node's first row its inner and outer distance.

    The node of rows ``first`` to ``last`` has its vantage point first, then the inner half, then the
    outer one; no more than ``leaf`` rows are a leaf.
    """

    def __init__(self, points, leaf: int = 32):
        import numpy as np

        n = len(points)
        self.leaf, self.order = leaf, np.arange(n)
        self.inner, self.outer = np.zeros(n), np.zeros(n)
        stack = [(0, n)]
        while stack:
            first, last = stack.pop()
            if last - first <= leaf:
                continue
            rows = self.order[first:last].copy()
            # The row farthest from the first one is a good vantage point.
            at = int(distances(points[rows], points[rows[0]]).argmax())
            rows[[0, at]] = rows[[at, 0]]
            d = distances(points[rows[1:]], points[rows[0]])
            half = len(d) // 2
            part = np.argpartition(d, half)
            self.order[first:last] = np.concatenate([rows[:1], rows[1:][part]])
            self.inner[first], self.outer[first] = d[part[:half]].max(initial=0.0), d[part[half:]].min()
            stack += [(first + 1, first + 1 + half), (first + 1 + half, last)]
        self.points = points[self.order]

    @classmethod
    def stored(cls, points, inner, outer, leaf: int) -> VpTree:
        """The tree of stored rows, in their order."""
        import numpy as np

        tree = cls.__new__(cls)
        tree.points, tree.inner, tree.outer, tree.leaf, tree.order = points, inner, outer, leaf, np.arange(len(points))
        return tree

    def search(self, q, want: int, reach: float, relax: float, found) -> int:
        """Give ``found`` rows with distances; it returns the distance that still counts. The number measured."""
        stack, measured = [(0, len(self.points), 0.0)], 0
        while stack:
            first, last, bound = stack.pop()
            if bound * relax > reach * _SLACK:
                continue
            if last - first <= self.leaf:
                measured += last - first
                reach = min(reach, found(self.order[first:last], distances(self.points[first:last], q)))
                continue
            measured += 1
            d = distances(self.points[first : first + 1], q)
            reach = min(reach, found(self.order[first : first + 1], d))
            inner_max, outer_min = self.inner[first], self.outer[first]
            middle = first + 1 + (last - first - 1) // 2
            near = (first + 1, middle, max(bound, d[0] - inner_max))
            far = (middle, last, max(bound, outer_min - d[0]))
            stack.extend((far, near) if d[0] <= (inner_max + outer_min) / 2 else (near, far))
        return measured


def _answers(tree: VpTree, ids, q, want: int, reach: float, relax: float):
    """Up to ``want`` (distance, id) of one shard, ties to the smaller id, and the vectors measured."""
    import numpy as np

    best: list[tuple[float, int]] = []

    def found(rows, d) -> float:
        nonlocal best
        limit = best[-1][0] if len(best) == want else reach
        near = np.flatnonzero(d <= limit)
        if len(near):
            nearest_of = {i: x for x, i in best}
            for x, r in zip(d[near].tolist(), rows[near]):
                for i in ids[r]:
                    if x < nearest_of.get(i, np.inf) or i not in nearest_of:
                        nearest_of[i] = x
            best = sorted((x, i) for i, x in nearest_of.items())[:want]
        return best[-1][0] if len(best) == want else reach

    measured = tree.search(q, want, reach, relax, found)
    return best, measured


def _squares(points, pivots):
    """Squared distances by one matrix product, and a bound of their rounding error per point."""
    import numpy as np

    middle = pivots.mean(axis=0)
    a, b = points - middle, pivots - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return aa[:, None] + bb - 2 * (a @ b.T), 1e-12 * (aa + bb.max())


def _to_pivots(rows, pivots):
    """cogroup function: the cell of the nearest pivot, the distance from it, and how much nearer another may be."""
    import numpy as np

    names = ["v", "ids", "key", "asked", "cell", "away", "slip"]
    if not len(rows):
        return rows.assign(away=0.0, slip=0.0)[names]
    p, numbers = np.array(pivots["p"].tolist()), pivots["number"].to_numpy()
    at, away, slip = [], [], []
    for first in range(0, len(rows), 512):
        points = np.array(rows["v"].iloc[first : first + 512].tolist())
        with np.errstate(over="ignore", invalid="ignore"):
            squares, error = _squares(points, p)
            best = squares.argmin(axis=1)
            away.append(np.sqrt(np.cumsum((points - p[best]) ** 2, axis=1)[:, -1]))
            # Where squares overflow, nothing is known of the other pivots.
            slip.append(np.nan_to_num(np.sqrt(2 * error), nan=np.inf, posinf=np.inf))
        at.append(best)
    cell = rows["cell"] + "." + [str(x) for x in numbers[np.concatenate(at)]]
    return rows.assign(cell=cell, away=np.concatenate(away), slip=np.concatenate(slip))[names]


_INDEXED = "v array<double>, ids array<long>, key long, asked boolean"


def _reachable(relax: float):
    """cogroup function: a row per query and cell below its cell that can hold a nearer vector."""

    def run(asked, cells):
        import numpy as np
        import pandas as pd

        out = []
        if len(asked) and len(cells):
            p = np.array(cells["p"].tolist())
            radius, near, slip = (cells[c].to_numpy() for c in ("radius", "near", "slip"))
            kids = list(zip(cells["child"], cells["n"]))
            for key, q, reach, own in zip(asked["key"], asked["q"], asked["reach"], asked["own"]):
                with np.errstate(over="ignore", invalid="ignore"):
                    d = distances(p, np.asarray(q))
                    bound = np.fmax(np.fmax(d - radius, near - d), (d - d.min() - slip) / 2)
                for i in np.flatnonzero(~(bound * relax > reach * _SLACK)):
                    out.append((key, q, reach, own, *kids[i]))
        return pd.DataFrame(out, columns=["key", "q", "reach", "own", "cell", "n"]).astype(
            {"key": "int64", "reach": "float64", "n": "int64"}
        )

    return run


@dataclass
class Index:
    """Stored trees, and per level the cells that a split made."""

    trees: DataFrame  # cell, shard, pos, v, ids, key, asked, inner, outer
    cells: list[DataFrame]  # parent, cell, p, n, radius, near, slip
    roots: DataFrame  # cell, n


def _blocks(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """Adds ``block``: rows of equal ``keys`` in blocks of about ``most`` by the hash of ``by``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    return rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).drop("blocks")


def _pivots(rows: DataFrame, search: Search) -> DataFrame:
    """(cell, number, p) of rows (cell, n, v): the smallest hashes of each cell."""
    want = F.least(F.greatest(F.ceil(F.col("n") / search.vectors_per_pivot), F.lit(2)), F.lit(search.fan))
    place = hash_place("cell", "v")  # with the cell: each split draws anew
    # A first cut at twice the share that is wanted leaves few rows to sort.
    few = rows.filter(place / float(1 << 63) <= 2 * (want + 50) / F.col("n"))
    w = Window.partitionBy("cell").orderBy(place, "v")
    numbered = few.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= search.fan)
    return numbered.filter(F.col("number") <= want).select("cell", "number", F.col("v").alias("p"))


def _grow(rows, leaf: int):
    """applyInPandas function: the rows of one shard with their places in its tree."""
    import numpy as np

    tree = VpTree(np.array(rows["v"].tolist()), leaf)
    out = rows.iloc[tree.order]
    return out.assign(pos=np.arange(len(out)), inner=tree.inner, outer=tree.outer)


def build_index(vectors: DataFrame, is_query, search: Search = PRODUCTION) -> Index:
    """Cells, shards and trees of all vectors; ``asked`` marks vectors of an id that ``is_query`` picks."""
    rows = usable(vectors)
    asked = rows.filter(is_query).select("v").distinct().withColumn("asked", F.lit(True))
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= search.k + 1)
    ids = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    open_ = saved(ids.join(asked, "v", "left").select(
        "v", "ids", F.monotonically_increasing_id().alias("key"), F.coalesce("asked", F.lit(False)).alias("asked"),
        F.size("v").cast("string").alias("cell"),
    ))
    sizes = roots = saved(open_.groupBy("cell").agg(F.count("*").alias("n")))
    levels: list[DataFrame] = []
    shards = []
    while True:
        sized = open_.join(sizes, "cell")
        big = F.col("n") > search.shard_rows
        if len(levels) == search.levels or sizes.filter(big).isEmpty():
            shards.append(sized)
            break
        shards.append(sized.filter(~big))
        pivots = saved(_pivots(sized.filter(big), search))
        chunks = F.ceil(F.col("n") / search.chunk_rows).cast("int")
        right = sizes.filter(big).join(pivots, "cell").select(
            F.col("cell").alias("c"), "number", "p", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("b")
        )
        left = sized.filter(big).withColumn("chunk", F.pmod(F.xxhash64("v"), chunks).cast("int")).drop("n")
        placed = left.groupBy("cell", "chunk").cogroup(right.groupBy("c", "b"))
        open_ = saved(placed.applyInPandas(_to_pivots, _INDEXED + ", cell string, away double, slip double"))
        sums = open_.groupBy("cell").agg(
            F.count("*").alias("n"), F.max("away").alias("radius"), F.min("away").alias("near"), F.max("slip").alias("slip")
        )
        named = pivots.select(F.col("cell").alias("parent"), F.concat_ws(".", "cell", "number").alias("cell"), "p")
        sizes = saved(named.join(sums, "cell"))
        levels.append(sizes)
        open_, sizes = open_.drop("away", "slip"), sizes.select("cell", "n")
    leaves = shards[0]
    for more in shards[1:]:
        leaves = leaves.unionByName(more)
    count = F.ceil(F.col("n") / search.shard_rows)
    sharded = leaves.withColumn("shard", F.pmod(F.xxhash64("v"), count).cast("int")).drop("n")
    trees = saved(sharded.groupBy("cell", "shard").applyInPandas(
        lambda rows: _grow(rows, search.leaf),
        _INDEXED + ", cell string, shard int, pos int, inner double, outer double",
    ))
    return Index(trees, levels, roots)


def _searched(index: Index, asked: DataFrame, search: Search) -> DataFrame:
    """(key, near, measured) per row of ``asked``: (key, q, reach, cell, shard)."""
    left = _blocks(asked, ["cell", "shard"], "key", search.block_queries)
    used = left.select("cell", "shard", "block").distinct()
    right = index.trees.drop("key", "asked").join(used, ["cell", "shard"]).withColumnsRenamed(
        {"cell": "c", "shard": "s", "block": "b"}
    )

    def run(qs, vs):
        import numpy as np
        import pandas as pd

        out = []
        if len(qs) and len(vs):
            vs = vs.sort_values("pos")
            tree = VpTree.stored(np.array(vs["v"].tolist()), vs["inner"].to_numpy(), vs["outer"].to_numpy(), search.leaf)
            ids = vs["ids"].tolist()
            for key, q, reach in zip(qs["key"], qs["q"], qs["reach"]):
                best, measured = _answers(tree, ids, np.asarray(q), search.k + 1, reach, search.relax)
                out.append((key, [{"score": d, "vec_id": i} for d, i in best], measured))
        return pd.DataFrame(out, columns=["key", "near", "measured"]).astype({"key": "int64", "measured": "int64"})

    return left.groupBy("cell", "shard", "block").cogroup(right.groupBy("c", "s", "b")).applyInPandas(
        run, "key long, near array<struct<score: double, vec_id: long>>, measured long"
    )


def _search(index: Index, search: Search) -> DataFrame:
    """(key, near, measured): a row per query vector and shard that it opened."""
    asked = index.trees.filter("asked").select("key", F.col("v").alias("q"), "cell", "shard")
    none = F.lit(float("inf"))
    own = saved(_searched(index, asked.withColumn("reach", none), search))
    # The shortest list that is full bounds all that may follow; it holds the query itself.
    reach = own.filter(F.size("near") == search.k + 1).select("key", F.col("near")[search.k]["score"].alias("reach"))
    bounded = asked.join(reach, "key", "left").select(
        "key", "q", F.coalesce("reach", none).alias("reach"), F.concat_ws("#", "cell", "shard").alias("own")
    )
    at = saved(bounded.withColumn("cell", F.size("q").cast("string")).join(index.roots, "cell"))
    opened = []
    for cells in index.cells:
        # A cell of this level is either split, which makes it a parent, or holds shards.
        split = cells.select(F.col("parent").alias("cell")).distinct()
        opened.append(at.join(split, "cell", "left_anti"))
        left = _blocks(at.drop("n").join(split, "cell", "left_semi"), ["cell"], "key", search.block_queries)
        used = left.select(F.col("cell").alias("parent"), F.col("block").alias("b")).distinct()
        right = cells.withColumnRenamed("cell", "child").join(used, "parent")
        at = saved(left.groupBy("cell", "block").cogroup(right.groupBy("parent", "b")).applyInPandas(
            _reachable(search.relax), "key long, q array<double>, reach double, own string, cell string, n long"
        ))
    opened.append(at)
    leaves = opened[0].select("key", "q", "reach", "own", "cell", "n")
    for more in opened[1:]:
        leaves = leaves.unionByName(more.select(*leaves.columns))
    count = F.ceil(F.col("n") / search.shard_rows).cast("int")
    others = leaves.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("shard"))
    others = others.filter(F.concat_ws("#", "cell", "shard") != F.col("own")).drop("own", "n")
    return own.unionByName(_searched(index, others, search))


#: Queries with one vector may be many: they meet its answers in so many parts.
_PARTS = 8


def nearest(vectors: DataFrame, is_query, search: Search = PRODUCTION, index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``is_query`` (a column of ``vec_id``) picks.

    An ``index`` of the same vectors and queries serves searches that differ in ``relax`` only.
    """
    index = index or build_index(vectors, is_query, search)
    near = _search(index, search).select("key", F.explode("near").alias("x")).select("key", "x.vec_id", "x.score")
    w = Window.partitionBy("key").orderBy("score", "vec_id")
    best = near.groupBy("key", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= search.k + 1)
    lists = best.groupBy("key").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    answers = index.trees.filter("asked").select("key", "v").join(lists, "key").select(
        "v", "near", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part")
    )
    queries = usable(vectors).filter(is_query).distinct().withColumnRenamed("vec_id", "query_id")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(_PARTS)).cast("int"))
    found = queries.join(answers, ["v", "part"]).select("query_id", F.explode("near").alias("x"))
    found = found.select("query_id", "x.vec_id", "x.score").filter(F.col("vec_id") != F.col("query_id"))
    scored = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= search.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_work(index: Index, search: Search = PRODUCTION) -> DataFrame:
    """One row: (queries, vectors, shards, opened, measured), of distinct vectors.

    ``opened`` counts pairs of query and shard, ``measured`` pairs of query and vector whose distance was
    taken; divided by queries x shards and queries x vectors they are the shares that the search could not leave out.
    """
    held = index.trees.select(
        F.col("asked").cast("long").alias("queries"), F.lit(1).alias("vectors"), (F.col("pos") == 0).cast("long").alias("shards")
    )
    done = _search(index, search).select(F.lit(1).alias("opened"), "measured")
    names = ["queries", "vectors", "shards", "opened", "measured"]
    each = held.unionByName(done, allowMissingColumns=True)
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def neighbor_report(vectors: DataFrame, search: Search = PRODUCTION) -> DataFrame:
    """The nearest vectors of the rows whose id is divisible by 100."""
    return nearest(vectors, F.col("vec_id") % 100 == 0, search)
