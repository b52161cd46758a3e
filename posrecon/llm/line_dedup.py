"""Line dedup over documents that come and go.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys
of ``min_chars`` code points or more count. The state of a corpus is three tables:

* ``refs``: which document holds which key, once each;
* ``counts``: the exact table, per key the number of documents and the largest id;
* ``filters``: a cuckoo filter per shard of the keys that reach ``min_docs``.

``insert`` and ``delete`` give the state with documents added or taken away: counts go up
or down, and keys enter or leave their shard's filter as they cross ``min_docs``. A
document's deletion is thus undone by inserting it again. To clean documents, their lines
meet the filters first; only lines that a filter lets through are looked up in the exact
table, which settles the filter's false positives. A line goes if its key is in
``min_docs`` documents or more and the document is not the largest that holds it.

Keys are kept as 128 bits of hash. Lines are dealt to shards by key and, where a shard has more
lines than most, to several groups per shard, each with a copy of the shard's filter.

Texts of any length are split whole, and only the hashes of their lines are moved. A null or empty text is one empty line. Rows with one id count as one document; each of
them is cleaned. A null id counts as the smallest. Lines of the document that keeps a key
all stay. Empty tables give empty results. Other columns are handed through, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posrecon.llm.common import SPACES, ascii_lower, let, parts_for, saved

_NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 20
    min_docs: int = 3
    keys_per_shard: int = 500_000
    min_shards: int = 64
    #: The shard list is sent to every task; beyond this many, shards grow instead.
    max_shards: int = 8192
    #: Lines of one group of a shard, at least.
    group_lines: int = 20_000


PRODUCTION = LineRules()
#: Whole hashes beside a filter's table after which the filter is built anew.
SPARE = 4096


class CuckooFilter:
    """Sets of 64-bit hashes with deletion: buckets of four 16-bit fingerprints.

    A hash has two buckets, each found from the other and the fingerprint; their bits are mixed, so they do not depend on
    those that chose the shard. What finds no place after ``KICKS`` moves is kept as it is, in a sorted list of whole
    hashes. Deletion looks there first. In the table, equal fingerprints with a bucket in common have both
    in common, so that taking either of them out leaves the other hash found: deletion never loses another key.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, table=None, spare=None, capacity: int = 64):
        import numpy as np

        self.table = np.zeros((self._buckets(capacity), self.SLOTS), np.uint16) if table is None else table
        self.spare = np.zeros(0, np.int64) if spare is None else spare

    @classmethod
    def _buckets(cls, capacity: int) -> int:
        return 1 << max(3, (capacity * 3 // (2 * cls.SLOTS)).bit_length())

    def dump(self) -> bytes:
        import numpy as np

        return np.array([len(self.table), len(self.spare)], np.int64).tobytes() + self.table.tobytes() + self.spare.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        import numpy as np

        buckets, spare = np.frombuffer(data, np.int64, 2).tolist()
        table = np.frombuffer(data, np.uint16, buckets * cls.SLOTS, 16).reshape(buckets, cls.SLOTS).copy()
        return cls(table, np.frombuffer(data, np.int64, spare, 16 + 2 * table.size).copy())

    def _spots(self, hashes):
        import numpy as np

        h = np.asarray(hashes, np.int64).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        import numpy as np

        moved = prints.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ moved) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes):
        import numpy as np

        h = np.asarray(hashes, np.int64)
        prints, a, b = self._spots(h)
        found = ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)
        if len(self.spare):
            at = np.minimum(np.searchsorted(self.spare, h), len(self.spare) - 1)
            found |= self.spare[at] == h
        return found

    def insert(self, hashes) -> None:
        """All at once into free slots of the first and second buckets; only the rest moves others."""
        import numpy as np

        h = np.asarray(hashes, np.int64)
        prints, *buckets = self._spots(h)
        left = np.arange(len(h))
        for bucket in buckets:
            left = left[~self._fill(prints[left], bucket[left])]
        room = int(0.95 * self.table.size) - np.count_nonzero(self.table)
        kept = []
        for k in left.tolist():
            if room > 0 and self._kick(int(prints[k]), int(buckets[0][k])):
                room -= 1
            else:
                kept.append(h[k])
        if kept:
            self.spare = np.sort(np.append(self.spare, np.array(kept, np.int64)))

    def _fill(self, prints, buckets):
        """Which of the fingerprints found a free slot in their bucket; used slots come first in a bucket."""
        import numpy as np

        order = np.argsort(buckets, kind="stable")
        bucket = buckets[order]
        slot = (self.table[bucket] != 0).sum(axis=1) + np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        fits = slot < self.SLOTS
        self.table[bucket[fits], slot[fits]] = prints[order][fits]
        placed = np.zeros(len(buckets), bool)
        placed[order] = fits
        return placed

    def _kick(self, mark: int, bucket: int) -> bool:
        """Make room for one fingerprint, or leave the table as it was."""
        moves, mask = [], len(self.table) - 1
        for kick in range(self.KICKS):
            slot = (kick * 7 + mark) % self.SLOTS
            out = int(self.table[bucket, slot])
            moves.append((bucket, slot, out))
            self.table[bucket, slot] = mark
            mark, bucket = out, (bucket ^ ((out * 0x5BD1E9955BD1E995 & (1 << 64) - 1) >> 20)) & mask
            row = self.table[bucket].tolist()
            if 0 in row:
                self.table[bucket, row.index(0)] = mark
                return True
        for at, slot, before in reversed(moves):
            self.table[at, slot] = before
        return False

    def delete(self, hashes) -> None:
        """Take out hashes that were inserted, each as often as it is given."""
        import numpy as np

        h = np.sort(np.asarray(hashes, np.int64))
        # The k-th copy of a hash takes the k-th copy in the list, as long as there is one.
        at = np.searchsorted(self.spare, h) + np.arange(len(h)) - np.searchsorted(h, h)
        near = np.minimum(at, max(len(self.spare) - 1, 0))
        listed = (at < len(self.spare)) & (self.spare[near] == h) if len(self.spare) else np.zeros(len(h), bool)
        self.spare = np.delete(self.spare, at[listed])
        for mark, *buckets in zip(*(x[~listed].tolist() for x in self._spots(h))):
            for bucket in buckets:
                row = self.table[bucket].tolist()
                if mark in row:
                    row.remove(mark)
                    self.table[bucket] = [*row, 0]
                    break


@dataclass(frozen=True)
class LineState:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID))


def _text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _version(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(text)


def lines_of(docs: DataFrame, rules: LineRules = PRODUCTION) -> DataFrame:
    """(id, version, pos, k1, k2) of every line with a key that counts."""
    keys = F.transform(_text_lines(docs["text"]), lambda x: ascii_lower(F.trim(x, F.lit(SPACES))))
    rows = docs.select(_id(docs).alias("id"), _version(docs["text"]).alias("version"), F.posexplode(keys).alias("pos", "key"))
    return rows.filter(F.length("key") >= rules.min_chars).select(
        "id", "version", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), F.col("key")).alias("k2")
    )


def _shard(n: int) -> Column:
    return F.pmod("k1", F.lit(n)).cast("int")


def _tallied(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))


def _filters(
    entering: DataFrame, leaving: DataFrame | None, old: DataFrame | None, shards: int, now: DataFrame | None = None
) -> DataFrame:
    """Filters per shard after keys (k1) enter and leave; a shard with none has no row.

    A shard that has outgrown its filter (``spare`` hashes beside the table) gets a new one from all its keys ``now``.
    """

    def build(key, held, moved):
        import pandas as pd

        f = CuckooFilter.load(held["data"].iloc[0]) if len(held) else CuckooFilter(capacity=len(moved))
        f.delete(moved["k1"][~moved["enters"]])
        f.insert(moved["k1"][moved["enters"]])
        return pd.DataFrame({"shard": [key[0]], "data": [f.dump()], "spare": [len(f.spare)]})

    tagged = lambda keys, enters: keys.select(_shard(shards).alias("shard"), "k1", F.lit(enters).alias("enters"))
    moved = tagged(entering, True)
    if leaving is not None:
        moved = moved.unionByName(tagged(leaving, False))
    schema = "shard int, data binary, spare int"
    if old is None:
        old = moved.sparkSession.createDataFrame([], schema)
    elif now is not None:
        # One number per shard, never more than ``max_shards``.
        full = F.broadcast(old.where(F.col("spare") > SPARE).select("shard"))
        moved = moved.join(full, "shard", "left_anti").unionByName(tagged(now, True).join(full, "shard", "left_semi"))
        old = old.where(F.col("spare") <= SPARE)
    return old.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(build, schema)


def build(lines: DataFrame, rules: LineRules = PRODUCTION) -> LineState:
    """The state of a corpus from its lines."""
    refs = saved(lines.select("id", "k1", "k2").dropDuplicates())
    counts = saved(_tallied(refs))
    frequent = counts.filter(F.col("n_docs") >= rules.min_docs)
    shards = min(rules.max_shards, parts_for(frequent.count(), rules.keys_per_shard, rules.min_shards))
    return LineState(refs, counts, saved(_filters(frequent, None, None, shards)), shards)


def _changed(state: LineState, refs: DataFrame, counts: DataFrame, rules: LineRules) -> LineState:
    """The next state; ``counts`` are all keys' new counts (keys without documents are dropped)."""
    refs = saved(refs)
    counts = saved(counts)
    many = F.col("n_docs") >= rules.min_docs
    was = state.counts.filter(many).select("k1", "k2")
    now = counts.filter(many).select("k1", "k2")
    entering, leaving = now.join(was, ["k1", "k2"], "left_anti"), was.join(now, ["k1", "k2"], "left_anti")
    return LineState(refs, counts, saved(_filters(entering, leaving, state.filters, state.shards, now)), state.shards)


def insert(state: LineState, docs: DataFrame, rules: LineRules = PRODUCTION) -> LineState:
    """Add documents; references that the state has already change nothing."""
    fresh = lines_of(docs, rules).select("id", "k1", "k2").dropDuplicates().join(state.refs, ["id", "k1", "k2"], "left_anti")
    fresh = saved(fresh)
    counts = state.counts.unionByName(_tallied(fresh)).groupBy("k1", "k2").agg(
        F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id")
    )
    return _changed(state, state.refs.unionByName(fresh), counts, rules)


def delete(state: LineState, ids: DataFrame, rules: LineRules = PRODUCTION) -> LineState:
    """Take documents (column ``doc_id``) away; unknown ids change nothing."""
    gone = ids.select(_id(ids).alias("id")).distinct()
    left = saved(state.refs.join(gone, "id", "left_anti"))
    touched = state.refs.join(gone, "id", "left_semi").select("k1", "k2").distinct()
    counts = state.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(
        _tallied(left.join(touched, ["k1", "k2"], "left_semi"))
    )
    return _changed(state, left, counts, rules)


def _possible(state: LineState, lines: DataFrame, rules: LineRules) -> DataFrame:
    """The lines that their shard's filter lets through."""
    spark = lines.sparkSession
    sizes = {r["shard"]: r["n"] for r in lines.groupBy(_shard(state.shards).alias("shard")).agg(F.count("*").alias("n")).collect()}
    usual = max(rules.group_lines, sum(sizes.values()) // state.shards)
    parts = [(s, -(-n // usual)) for s, n in sizes.items()]  # one row per shard
    split = F.broadcast(spark.createDataFrame(parts, "shard int, parts int"))
    left = lines.withColumn("shard", _shard(state.shards)).join(split, "shard").withColumn(
        "part", F.pmod(F.xxhash64("id", "pos"), F.col("parts")).cast("int")
    )
    right = state.filters.join(split, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "data"
    )
    columns = ["id", "version", "pos", "k1", "k2"]

    def probe(held, filters):
        if len(filters) == 0:
            return held[columns].iloc[:0]
        return held.loc[CuckooFilter.load(filters["data"].iloc[0]).contains(held["k1"].to_numpy()), columns]

    grouped = left.drop("parts").groupBy("shard", "part")
    return grouped.cogroup(right.groupBy("shard", "part")).applyInPandas(
        probe, "id long, version long, pos int, k1 long, k2 long"
    )


def dropped_lines(state: LineState, lines: DataFrame, rules: LineRules = PRODUCTION) -> DataFrame:
    """(id, version, drops): positions of the lines that go, for texts that lose any."""
    exact = state.counts.filter(F.col("n_docs") >= rules.min_docs).drop("n_docs")
    gone = _possible(state, lines, rules).join(exact, ["k1", "k2"]).filter(F.col("id") != F.col("last_id"))
    # Rows that repeat as a whole give each position more than once.
    return gone.groupBy("id", "version").agg(F.collect_set("pos").alias("drops"))


def cleaned(docs: DataFrame, rules: LineRules = PRODUCTION, state: LineState | None = None) -> DataFrame:
    """``row_`` (the row of ``docs``) with ``n_lines``, ``n_dropped`` and ``kept`` text."""
    lines = saved(lines_of(docs, rules))
    drops = dropped_lines(state or build(lines, rules), lines, rules)
    rows = docs.select(F.struct("*").alias("row_"), _id(docs).alias("id"), _version(docs["text"]).alias("version"))
    joined = rows.join(drops, ["id", "version"], "left")
    text = F.coalesce(F.col("row_.text"), F.lit(""))
    rest = let(
        F.split(text, "\n"),
        lambda all_: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("drops")), lambda i: F.get(all_, i)), "\n"
        ),
    )
    return joined.select(
        "row_",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), text).otherwise(rest).alias("kept"),
    )


def line_report(docs: DataFrame, rules: LineRules = PRODUCTION) -> DataFrame:
    rows = cleaned(docs.select("doc_id", "text"), rules)
    return rows.select("row_.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, rules: LineRules = PRODUCTION) -> DataFrame:
    """``docs`` with their own columns; only ``text`` changes, and a null text stays null."""
    text = F.when(F.col("row_.text").isNotNull(), F.col("kept"))
    return cleaned(docs, rules).select(
        *((text if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns)
    )
