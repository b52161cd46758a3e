"""Similarity join of documents on word n-grams with a token-group matrix.

Two documents link when their shingle sets have a Jaccard similarity of at least
``num / den``. The join is exact; links between different texts are all followed, and copies of one
set are one class that is joined once. The result is each document's component.

A group of sets is described by the union of their tokens: a set overlaps no member of the group in
more tokens than it overlaps the union. That bound is applied from large groups to small:

1. The group of all other classes. Tokens that only one class has cannot be shared, so a
   class with too many of them links with nothing (first on a quarter of the tokens, then on all).
2. Groups of similar documents. Tokens are ordered (own tokens, then others by hash, the
   heaviest last); linked sets share a token among the first ``n - need + 1`` of each. These
   columns of the token-group matrix give each class the group of the most
   ordinary class it meets. A group is cut to bounded size, its members are compared
   with each other and with that class, and links give first components.
3. Groups again, now for the classes of other components that meet them in the matrix:
   the smaller component asks, the larger one's group is opened only if the overlap
   with its union suffices, and one link per component is enough.

No task gets more than a bounded group; frequent tokens meet as one row per group.

Tokens and sets are known by 64-bit hashes. Texts of any length count whole: a task holds the words of one text at a time
and, in a group, sets of bounded total size. A null, empty or blank text has no shingles
and links with nothing, not even with its like. Repeated rows are copies. Rows without an id
are joined too; a component of only such rows has a null id. An empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posrecon.llm.common import SPACES, parts_for, saved
from posrecon.llm.tokens import once_per_worker


@dataclass(frozen=True)
class Join:
    words: int = 4
    num: int = 85
    den: int = 100
    #: One in so many tokens decides the first bound.
    sample: int = 4
    range_tokens: int = 500_000
    max_ranges: int = 200_000
    #: Tokens and sets of one group, and sets that ask a group at a time, about.
    group_tokens: int = 150_000
    group_sets: int = 400
    asking_sets: int = 4000
    #: Tokens in more classes than ``heavy_df`` come last; so many are known to every task.
    heavy_df: int = 50
    max_heavy: int = 65_536

    def need(self, n):
        """Tokens that a set of ``n`` must share with any partner."""
        return (self.num * n + self.den - 1) // self.den

    def links(self, overlap, n, m):
        return self.den * overlap >= self.num * (n + m - overlap)


PRODUCTION = Join()
_SHARED = -(1 << 63)


class Shingles:
    """Sets of hashed word n-grams, for many texts at a time.

    A word's hash is a polynomial over the random values of its bytes (A-Z as a-z), cut out of
    running sums modulo 2^64 and mixed with its length. Words end at ``[\\x20\\x09-\\x0D]`` and at
    the ends of their text.
    """

    BLOCK = 1 << 20

    def __init__(self, words: int):
        import numpy as np
        import xxhash

        self.words = words
        self._digest = xxhash.xxh3_128_digest
        letters = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in bytes(range(256)).lower()], np.uint64)
        spaces = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self._letters, self._spaces = np.where(spaces, 0, letters), spaces
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int):
        """Powers of an odd number and of its inverse."""
        import numpy as np

        if len(self._up) < n:
            base = 0x9E3779B97F4A7C15
            for name, b in (("_up", base), ("_down", pow(base, -1, 1 << 64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self._up, self._down

    @staticmethod
    def _mixed(h):
        import numpy as np

        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _block(self, data, offsets):
        import numpy as np

        n, k = len(data), self.words
        up, down = self._powers(n + 1)
        space = self._spaces[data]
        before, after = np.r_[True, space[:-1]], np.r_[space[1:], True]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner], after[inner - 1] = True, True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._letters[data] * up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        h = self._mixed(h)
        first = np.searchsorted(starts, offsets)
        whole = max(0, len(h) - k + 1)
        grams = np.full(whole, k, np.uint64)
        for j in range(k):
            grams = self._mixed(grams ^ h[j : j + whole])
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi == lo:
                yield h[:0]
            else:
                one = np.full(1, hi - lo, np.uint64)
                for j in range(lo, hi):
                    one = self._mixed(one ^ h[j : j + 1])
                yield one

    def __call__(self, texts):
        """Sorted distinct hashes of each text of an Arrow array."""
        import numpy as np
        import pyarrow as pa

        raw = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
        i = 0
        while i < len(raw):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.BLOCK, "right")) - 1)
            yield from self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j

    def fingerprint(self, tokens) -> tuple[int, int]:
        d = self._digest(tokens.tobytes())
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _shingles(words: int) -> Shingles:
    return once_per_worker(("shingles", words), lambda: Shingles(words))


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _version(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("v_"), F.xxhash64(F.lit("second"), text).alias("w_")]


def fingerprints(docs: DataFrame, j: Join = PRODUCTION, versions: bool = False) -> DataFrame:
    """(doc_id, n, few, id, check): size of the set and of its sample, and its hashes.

    The hashes are null for no shingles. v_ (and, with ``versions``, w_) tell texts apart.
    """
    words, sample = j.words, j.sample
    extra = ["v_", "w_"] if versions else ["v_"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make = _shingles(words)
        for batch in batches:
            n, few, a, b = [], [], [], []
            for tokens in make(batch.column(1)):
                n.append(len(tokens))
                few.append(int((tokens % np.uint64(sample) == 0).sum()))
                x, y = make.fingerprint(tokens) if len(tokens) else (None, None)
                a.append(x)
                b.append(y)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, few, a, b)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "few", "id", "check", *extra])

    rows = _text_rows(docs)
    rows = rows.select("*", *_version(F.col("text"))[: len(extra)])
    schema = "doc_id long, n long, few long, id long, check long" + "".join(f", {c} long" for c in extra)
    return rows.mapInArrow(run, schema)


def _sampled_tokens(docs: DataFrame, ranges: int, j: Join) -> DataFrame:
    """Blobs of (token, owner) per range of tokens, and counts of tokens shared within a task.

    A token with several owners in one task is sent once, marked; its owners are counted there.
    """
    words, sample = j.words, j.sample

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make = _shingles(words)
        schema = pa.schema([("range", pa.int64()), ("owner", pa.int64()), ("count", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary())])
        found, known = [], set()
        size = 0

        def closed():
            tokens = np.concatenate([t for _, t in found])
            owners = np.repeat(np.array([o for o, _ in found], np.int64), [len(t) for _, t in found])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            many = np.diff(np.r_[first, len(tokens)]) > 1
            inner = np.repeat(many, np.diff(np.r_[first, len(tokens)]))
            who, count = np.unique(owners[inner], return_counts=True)
            out_tokens, out_owners = tokens[first], np.where(many, _SHARED, owners[first])
            # Ranges are slices of the hash space.
            at = (out_tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.r_[cut[1:], len(at)]
            rows = [(None, int(o), int(c), None, None) for o, c in zip(who, count)]
            rows += [
                (int(at[s]), None, None, out_tokens[s:e].tobytes(), out_owners[s:e].tobytes()) for s, e in zip(cut, ends)
            ]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2000]), schema)], schema=schema
                )

        for batch in batches:
            for tokens in make(batch.column(1)):
                if len(tokens) == 0:
                    continue
                owner = make.fingerprint(tokens)[0]
                if owner in known:
                    continue
                known.add(owner)
                few = tokens[tokens % np.uint64(sample) == 0]
                found.append((owner, few))
                size += len(few)
            if size > 4_000_000:  # bounded memory; owners seen before may come again
                yield from closed()
                found, known, size = [], set(), 0
        if size:
            yield from closed()

    return _text_rows(docs).mapInArrow(run, "range long, owner long, count long, tokens binary, owners binary")


def _shared_counts(blobs: DataFrame) -> DataFrame:
    """(owner, count) of tokens that another class has too; counts may be too high, never too low."""

    def run(rows):
        import numpy as np
        import pandas as pd

        tokens = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["tokens"]])
        owners = np.concatenate([np.frombuffer(b, np.int64) for b in rows["owners"]])
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        first = np.r_[True, tokens[1:] != tokens[:-1]]
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        last = np.r_[starts[1:], len(tokens)] - 1
        shared = (owners[starts] != owners[last]) | (owners[starts] == _SHARED)
        who, count = np.unique(owners[shared[group] & (owners != _SHARED)], return_counts=True)
        return pd.DataFrame({"owner": who, "count": count})

    ranged = blobs.filter(F.col("range").isNotNull()).select("range", "tokens", "owners")
    far = ranged.groupBy("range").applyInPandas(run, "owner long, count long")
    near = blobs.filter(F.col("range").isNull()).select("owner", "count")
    return far.unionByName(near).groupBy("owner").agg(F.sum("count").alias("shared"))


def _sets(docs: DataFrame, wanted: DataFrame, j: Join) -> DataFrame:
    """(id, n, tokens) of the classes in ``wanted`` (id, first_doc, first_v), from the text of one document each.

    The text counts with the id, so that rows without one, or with the same, meet their own class only. Rows that
    repeat both are together after the join, and one of them is enough.
    """
    words = j.words

    def run(batches):
        import pyarrow as pa

        make = _shingles(words)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
        seen = set()
        for batch in batches:
            rows = []
            fresh = [k for k, key in enumerate(batch.column(0).to_pylist()) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for key, tokens in zip(batch.column(0).to_pylist(), make(batch.column(1))):
                if len(tokens) and make.fingerprint(tokens)[0] == key:
                    rows.append((key, len(tokens), tokens.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    d = _text_rows(docs)
    same = d.doc_id.eqNullSafe(wanted.first_doc) & (F.xxhash64(d.text) == wanted.first_v)
    joined = d.join(wanted, same).select("id", "text")
    return joined.mapInArrow(run, "id long, n long, tokens binary")


def _token_rows(sets: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, blob in zip(ids, batch.column(1)):
                tokens = np.frombuffer(blob.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), i))], ["token", "id"])

    return sets.select("id", "tokens").mapInArrow(run, "token long, id long")


def _columns(sets: DataFrame, own: DataFrame, heavy: list[int], j: Join) -> DataFrame:
    """(token, id, n, own): the columns of the matrix in which a class can be met.

    Own tokens come first in the order, so only ``n - need + 1`` less their number are left.
    """
    shared = sets.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frequent = np.array(shared.value, np.int64)
        places = np.argsort(frequent)
        table = frequent[places]
        schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("own", pa.int64())])
        for batch in batches:
            for i, n, blob, mine in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(blob, np.int64)
                mine = np.array(mine or [], np.int64)
                left = n - j.need(n) + 1 - len(mine)
                if left <= 0:
                    continue
                tokens = tokens[~np.isin(tokens, mine)]
                # The heavy ones by their place in the list, after all others by hash.
                weight = np.zeros(len(tokens), np.int64)
                if len(table):
                    at = np.minimum(np.searchsorted(table, tokens), len(table) - 1)
                    weight = np.where(table[at] == tokens, 1 + len(table) - places[at], 0)
                pick = tokens[np.lexsort((tokens, weight))][:left]
                k = len(pick)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick), *(pa.array(np.full(k, v, np.int64)) for v in (i, n, len(mine)))], schema=schema
                )

    rows = sets.join(own, "id", "left").select("id", "n", "tokens", "mine")
    return rows.mapInArrow(run, "token long, id long, n long, own long")


def _incidence(blobs):
    """Rows of a 0/1 matrix over the distinct tokens of several sets, in slices of columns."""
    import numpy as np

    sets = [np.frombuffer(b, np.uint64) for b in blobs]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    return len(sets), row, col, int(col.max()) + 1


def _overlaps(blobs_a, blobs_b=None):
    """Sizes of the intersections of all sets of a with all of b (or of a)."""
    import numpy as np

    a = len(blobs_a)
    n, row, col, width = _incidence([*blobs_a, *(blobs_b or [])])
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((a, (n - a) if blobs_b is not None else n), np.float32)
    step = max(256, 8_000_000 // n)
    for start in range(0, width, step):
        lo, hi = np.searchsorted(col, [start, start + step])
        m = np.zeros((n, min(step, width - start)), np.float32)
        m[row[lo:hi], col[lo:hi] - start] = 1
        out += m[:a] @ (m[a:] if blobs_b is not None else m).T
    return out.astype(np.int64)


def _open_groups(members: DataFrame, j: Join) -> DataFrame:
    """(a, b): links that connect what is linked within each group (pivot, part)."""

    def run(rows):
        import numpy as np
        import pandas as pd

        rows = rows.drop_duplicates("id").sort_values("id")
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        over = _overlaps(rows["tokens"].tolist())
        linked = j.links(over, n[:, None], n[None, :])
        label = np.arange(len(ids))
        links = []
        for start in range(len(ids)):
            if label[start] != start:
                continue
            seen, stack = {start}, [start]
            while stack:
                x = stack.pop()
                for y in np.flatnonzero(linked[x]):
                    if y not in seen:
                        seen.add(int(y))
                        label[y] = start
                        links.append((ids[x], ids[y]))
                        stack.append(int(y))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return members.groupBy("pivot", "part").applyInPandas(run, "a long, b long")


def _ask_groups(asks: DataFrame, members: DataFrame, j: Join) -> DataFrame:
    """(a, b): for each class that asks a group, a link to each other component in it."""

    def run(queries, rows):
        import numpy as np
        import pandas as pd

        links = []
        if len(queries) and len(rows):
            rows = rows.drop_duplicates("id")
            union = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in rows["tokens"]]))
            n = queries["n"].to_numpy()
            bound = np.array([
                np.isin(np.frombuffer(b, np.uint64), union, assume_unique=True).sum() for b in queries["tokens"]
            ])
            least = np.maximum(n, rows["n"].min())
            queries = queries[bound * j.den >= j.num * least]
            for start in range(0, len(queries), 256):
                q = queries.iloc[start : start + 256]
                over = _overlaps(q["tokens"].tolist(), rows["tokens"].tolist())
                fits = j.links(over, q["n"].to_numpy()[:, None], rows["n"].to_numpy()[None, :])
                other, mine, ids = rows["component"].to_numpy(), q["component"].to_numpy(), rows["id"].to_numpy()
                for x, y in zip(*np.nonzero(fits & (other[None, :] != mine[:, None]))):
                    links.append((q["id"].iloc[x], ids[y], other[y]))
        found = pd.DataFrame(links, columns=["a", "b", "c"]).astype("int64")
        return found.drop_duplicates(["a", "c"])[["a", "b"]]

    return asks.groupBy("pivot", "part", "piece").cogroup(members.groupBy("p", "s", "block")).applyInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id it is connected with.

    Each round every id moves to its smallest neighbour and the links follow; ids that only meet
    themselves are done. A hub is one row per task before any shuffle.
    """
    spark = links.sparkSession
    edges = saved(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = saved(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("to"))
        step = saved(least)
        jump = step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.at"), "left")
        step = saved(jump.select(F.col("x.at").alias("at"), F.coalesce("y.to", "x.to").alias("to")))
        labels = saved(
            labels.join(step, labels.component == step["at"], "left").select("id", F.coalesce("to", "component").alias("component"))
        )
        ends = [step.select(F.col("at").alias(f"at_{c}"), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = edges.join(ends[0], edges.a == ends[0].at_a).join(ends[1], edges.b == ends[1].at_b)
        edges = saved(
            moved.filter("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
    return labels


def _linked_classes(docs: DataFrame, classes: DataFrame, j: Join) -> DataFrame:
    """(id, component) of the classes that link with another class."""
    spark: SparkSession = docs.sparkSession
    # Sets that any other size could reach are few shingles long at least.
    able = classes.filter(F.expr(f"({j.den} * n) div {j.num} > n or ({j.num} * n + {j.den - 1}) div {j.den} < n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = min(j.max_ranges, parts_for(total // j.sample, j.range_tokens, 64))
    counts = _shared_counts(_sampled_tokens(docs, ranges, j))
    need = F.expr(f"({j.num} * n + {j.den - 1}) div {j.den}")
    # Sampled tokens that nobody else has are at most what a class can spare.
    spare = F.col("n") - need
    alive = able.join(counts, able.id == counts.owner, "left").filter(
        F.col("few") - F.coalesce("shared", F.lit(0)) <= spare
    )
    sets = saved(_sets(docs, alive.select("id", "first_doc", "first_v"), j))

    tokens = _token_rows(sets).groupBy("token").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("df")
    )
    tokens = saved(tokens.filter((F.col("low") == F.col("high")) | (F.col("df") > j.heavy_df)))
    own = tokens.filter("low = high").groupBy(F.col("low").alias("id")).agg(F.collect_list("token").alias("mine"))
    heavy = tokens.filter("low != high").orderBy(F.desc("df"), "token").limit(j.max_heavy).select("token")
    columns = saved(_columns(sets, own, [r[0] for r in heavy.collect()], j))

    # Every class joins the group of the most ordinary class it meets.
    ordinary = F.struct((1000 * F.col("own") / F.col("n")).cast("long").alias("rank"), F.col("id").alias("pivot"))
    met = columns.groupBy("token").agg(F.min(ordinary).alias("best"), F.min("id").alias("low"), F.max("id").alias("high"))
    met = saved(met.filter("low != high").select("token", "best"))
    placed = columns.join(met, "token").groupBy("id").agg(F.min("best").alias("best"), F.max("n").alias("n")).select(
        "id", "n", F.col("best.pivot").alias("pivot")
    )
    placed = saved(placed)
    enough = F.greatest(F.ceil(F.sum("n") / j.group_tokens), F.ceil(F.count("*") / j.group_sets))
    sizes = placed.groupBy("pivot").agg(enough.cast("int").alias("parts"))
    grouped = placed.join(sizes, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    grouped = saved(grouped)
    member = grouped.select("id", "pivot", "part")
    # The pivot is in every part of its group, which ties the parts together.
    centre = grouped.select(F.col("pivot").alias("id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    everyone = member.unionByName(centre).distinct()
    links = saved(_open_groups(everyone.join(sets, "id"), j))
    first = components(links)

    # What meets in the matrix and is not connected yet.
    named = grouped.join(first, "id", "left").select("id", "pivot", "part", F.coalesce("component", "id").alias("component"))
    weight = named.groupBy("component").agg(F.count("*").alias("size"))
    named = saved(named.join(weight, "component"))
    rows = columns.select("token", "id").join(met.select("token"), "token").join(named, "id")
    rank = F.struct("size", "component")
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    rows = saved(rows.join(mixed.select("token"), "token"))
    cells = rows.groupBy("token", "pivot", "part").agg(F.max(rank).alias("top")).select(
        "token", F.col("pivot").alias("p"), F.col("part").alias("s"), "top"
    )
    asks = rows.select("token", "id", rank.alias("mine"), "component").join(cells, "token").filter("mine < top")
    asks = saved(asks.select("id", "component", "p", "s").distinct())
    load = asks.groupBy("p", "s").agg(F.ceil(F.count("*") / j.asking_sets).cast("int").alias("blocks"))
    load = saved(load)
    renamed = named.select("id", "component", F.col("pivot").alias("p"), F.col("part").alias("s"))
    right = renamed.join(load, ["p", "s"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = asks.join(load, ["p", "s"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.select("id", "component", F.col("p").alias("pivot"), F.col("s").alias("part"), F.col("block").alias("piece"))
    again = sets.select(*(F.col(c).alias(c) for c in sets.columns))  # the same columns by new identities
    asked = left.join(again, "id").select("id", "n", "tokens", "component", *(F.col(c).alias(c) for c in ("pivot", "part", "piece")))
    more = saved(_ask_groups(asked, right.drop("blocks").join(sets, "id"), j))
    if more.isEmpty():
        return first
    return components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def _named_classes(docs: DataFrame, prints: DataFrame, j: Join) -> DataFrame:
    """(id, check, first_doc, component) of every class."""
    classes = saved(
        prints.filter(F.col("id").isNotNull())
        .groupBy("id", "check")
        .agg(
            F.min("doc_id").alias("first_doc"), F.coalesce(F.min_by("v_", "doc_id"), F.min("v_")).alias("first_v"),
            F.max("n").alias("n"), F.max("few").alias("few"),
        )
    )
    linked = _linked_classes(docs, classes, j).withColumnRenamed("id", "linked_id")
    return saved(
        classes.join(linked, classes.id == linked.linked_id, "left").select(
            "id", "check", "first_doc", F.coalesce("component", "id").alias("component")
        )
    )


def joined(docs: DataFrame, j: Join = PRODUCTION) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    prints = saved(fingerprints(docs, j))
    named = _named_classes(docs, prints, j)
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    found = named.join(smallest, "component").select(F.col("id").alias("i"), F.col("check").alias("c"), "component_id")
    return prints.join(found, (prints.id == found.i) & (prints.check == found.c), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, j: Join = PRODUCTION) -> DataFrame:
    """One row of ``docs`` per component: the smallest by (doc_id, fingerprint, text), ids before none.

    Documents without shingles all stay. Rows that repeat id and text stay once, except rows
    with neither id nor shingles.
    """
    prints = saved(fingerprints(docs, j, versions=True))
    named = _named_classes(docs, prints, j).select(F.col("id").alias("i"), F.col("check").alias("c"), "component")
    place = F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", F.col("id").alias("i"), F.col("check").alias("c"), "v_", "w_"
    )
    first = (
        prints.join(named, (prints.id == named.i) & (prints.check == named.c))
        .groupBy("component").agg(F.min(place).alias("best")).select("best.doc_id", "best.v_", "best.w_")
    )
    bare = prints.filter("n = 0 and doc_id is not null").select("doc_id", "v_", "w_")
    keep = first.unionByName(bare).distinct().select(*(F.col(c).alias(f"kept_{c}") for c in ("doc_id", "v_", "w_")))
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("key_"), *_version(text),
        (F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)) == "").alias("blank_"),
    )
    same = (F.col("v_") == F.col("kept_v_")) & (F.col("w_") == F.col("kept_w_"))
    named_rows = rows.filter("key_ is not null").join(keep, same & (F.col("key_") == F.col("kept_doc_id"))).dropDuplicates(["key_", "v_", "w_"])
    others = rows.filter("key_ is null and not blank_").dropDuplicates(["v_", "w_"])
    others = others.join(keep.filter("kept_doc_id is null"), same)
    blank = rows.filter("key_ is null and blank_")
    return named_rows.select("row_").unionByName(others.select("row_")).unionByName(blank.select("row_")).select("row_.*")
