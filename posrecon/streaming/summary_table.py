"""A stored summary that grows file by file.

Keys are dealt to a fixed number of buckets. Adding rows sums them, merges them with the buckets that they touch, and writes
those as a new version; other buckets stay as they are. One small file per version is the commit: it names the
buckets of the version and the files that went into it, so a file that comes again, in a later batch or in a replay
of the same one, changes nothing, and what a failed attempt left behind is never read. One writer at a time.

Commits of eight versions are written together once more, and those of eight such blocks again, so a look at the log opens
few files however many versions there are. A block is a copy: without it, the commits themselves are read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.operators.summarize import LEVELS, sum_columns, summarize
from posrecon.shared import stored
from posrecon.sources.lines import FILE

_LOG = "version long, bucket int, file string"
_LOG_ROWS = f"array<struct<{_LOG}>>"
#: So many commits, or blocks of commits, are written together.
_BLOCK = 8
#: Files of a batch whose names are looked up one by one; more are joined.
_FEW = 1000


class SummaryTable:
    """``level`` sums at ``path``. Choose ``buckets`` so that one holds no more than a task writes well."""

    def __init__(self, spark: SparkSession, path: str, level: str, buckets: int = 64, exact: bool | int = True):
        if level not in LEVELS:
            raise ValueError(f"Unknown aggregation level: {level}")
        self.spark, self.path, self.level, self.buckets, self.exact = spark, path.rstrip("/"), level, buckets, exact
        self.keys, self.sums = LEVELS[level]
        # Made once: a stream adds many batches, and expressions take longer to build than small batches to sum.
        self._totals = sum_columns(self.sums, exact)
        self._bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(buckets)).cast("int").alias("bucket")
        self._seen = None

    # --- the log ---------------------------------------------------------

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _stamp(self, version: int) -> int | None:
        """When the commit of a version was written; None if there is none."""
        fs, where = self._hadoop(f"{self.path}/log/version={version}")
        return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None

    def _block(self, start: int, size: int) -> str:
        """The folder with the commits ``start + 1`` to ``start + size``."""
        return f"{self.path}/log/version={start + 1}" if size == 1 else f"{self.path}/log-blocks/{start + 1}-{start + size}"

    def _is_whole(self, start: int, size: int) -> bool:
        fs, where = self._hadoop(f"{self._block(start, size)}/_SUCCESS")
        return fs.exists(where)

    def _cover(self, start: int, last: int) -> list[tuple[int, int]]:
        """Start and size of the largest blocks there are, and of single commits, from ``start`` to ``last``."""
        parts = []
        while start < last:
            size = 1
            while start % (size * _BLOCK) == 0 and start + size * _BLOCK <= last:
                size *= _BLOCK
            while size > 1 and not self._is_whole(start, size):
                size //= _BLOCK
            parts.append((start, size))
            start += size
        return parts

    def _rows(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(*[self._block(*p) for p in parts])

    def _look(self) -> None:
        """Learn the last version, the buckets' versions and the parts of the log, unless they are known and still the last."""
        if self._seen is not None and self._stamp(self._last) == self._seen[0] and self._stamp(self._last + 1) is None:
            return
        fs, where = self._hadoop(f"{self.path}/log")
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        there = {int(n.removeprefix("version=")) for n in found if n.startswith("version=")}
        parts = [(a, n) for a, n in self._cover(0, max(there, default=0)) if n > 1 or a + 1 in there]
        latest = self._rows(parts).groupBy("bucket").agg(F.max("version").alias("v")).collect()
        # What an attempt that failed left behind has no rows.
        self._last = max((r["v"] for r in latest), default=0)
        self._parts = [(a, n) for a, n in parts if a < self._last]
        self._now = {r["bucket"]: r["v"] for r in latest if r["bucket"] is not None}
        self._seen = (self._stamp(self._last),)

    def versions(self) -> dict[int, int]:
        """The current version of each bucket that has one (never more than ``buckets`` rows)."""
        self._look()
        return dict(self._now)

    def files(self) -> DataFrame:
        """The ledger: ``source_file`` and the ``version`` that took it in."""
        self._look()
        return self._rows(self._parts).where("file is not null").select(F.col("file").alias(FILE), "version")

    def _commit(self, version: int, touched: list[int], files: DataFrame | list[str]) -> None:
        rows = [dict(version=version, bucket=b) for b in touched]
        if isinstance(files, list):
            rows += [dict(version=version, file=f) for f in files]
        # From one literal: rows of a Python list would go through Python workers.
        log = self.spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), _LOG_ROWS)))
        if not isinstance(files, list):
            log = log.unionByName(files.select(F.lit(version).cast("long").alias("version"), F.lit(None).cast("int").alias("bucket"), F.col(FILE).alias("file")))
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        self._last, self._seen = version, (self._stamp(version),)
        self._now |= dict.fromkeys(touched, version)
        self._parts.append((version - 1, 1))
        size = _BLOCK
        while version % size == 0:
            start = version - size
            inner = [p for p in self._parts if p[0] >= start]
            self._rows(inner).coalesce(1).write.mode("overwrite").parquet(self._block(start, size))
            if self._is_whole(start, size):
                self._parts = [p for p in self._parts if p[0] < start] + [(start, size)]
            size *= _BLOCK

    # --- the sums --------------------------------------------------------

    def _schema(self) -> str:
        return ", ".join([*[f"`{k}` string" for k in self.keys], *[f"`{s}` double" for s in self.sums]])

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The summary, or some of its buckets."""
        now = {b: v for b, v in self.versions().items() if buckets is None or b in buckets}
        if not now:
            return self.spark.createDataFrame([], self._schema())
        parts = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(now.items())]
        return self.spark.read.schema(self._schema()).parquet(*parts)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.select("*", self._bucket)

    def add(self, rows: DataFrame) -> list[int]:
        """Take in canonical rows that carry ``source_file``; returns the buckets that were written anew.

        The rows are read once, into sums per file and key; files of the ledger are left out of those.
        """
        per_file = stored(self._bucketed(rows.groupBy(FILE, *self.keys).agg(*self._totals)))
        self._look()
        fresh, touched, files = self._fresh(per_file)
        if not touched:
            return []
        version = self._last + 1
        again = [b for b in touched if b in self._now]
        if again:
            fresh = self._bucketed(self.read(again)).unionByName(fresh)
        # The rows of each touched bucket meet in a task of its own, are summed there and written.
        place = F.expr(f"cast(array_position(array({', '.join(map(str, touched))}), bucket) - 1 as int)")
        placed = fresh.withColumn("place", place).repartitionById(len(touched), F.col("place"))
        merged = placed.groupBy("place", "bucket", *self.keys).agg(*self._totals).drop("place")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        self._commit(version, touched, files)
        return touched

    def _fresh(self, per_file: DataFrame) -> tuple[DataFrame, list[int], DataFrame | list[str]]:
        """The sums of files that are not in the ledger, their buckets, and those files."""
        per_file = per_file.where(F.col(FILE).isNotNull())
        found = per_file.groupBy(FILE).agg(F.collect_set("bucket").alias("b")).limit(_FEW + 1).collect()
        if len(found) > _FEW:
            files = stored(per_file.select(FILE).distinct().join(self.files(), FILE, "left_anti"))
            fresh = per_file.join(files, FILE, "left_semi").drop(FILE)
            # Many files hold the same keys, so they are summed before they meet the buckets.
            fresh = stored(summarize(fresh, ["bucket", *self.keys], self.sums, self.exact))
            return fresh, sorted(r[0] for r in fresh.select("bucket").distinct().collect()), files
        names = [r[FILE] for r in found]
        known = set()
        if names and self._parts:
            known = {r[0] for r in self._rows(self._parts).where(F.col("file").isin(names)).select("file").collect()}
        files = [n for n in names if n not in known]
        touched = sorted({b for r in found if r[FILE] not in known for b in r["b"]})
        return (per_file.where(F.col(FILE).isin(files)) if known else per_file).drop(FILE), touched, files
