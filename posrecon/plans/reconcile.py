"""Whole runs: two sides against each other, or one side on its own."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from posrecon.config import UNIT_PRICE, FormatConfig, ValidationConfig
from posrecon.operators.canonical import bad_measure_count, to_rows, to_sales_rows
from posrecon.operators import tagged
from posrecon.operators.compare import item_comparison_of, item_summary, store_comparison_of
from posrecon.operators.review import review_from_summaries, review_of_summary
from posrecon.operators.stores import store_list_diff, store_list_of
from posrecon.operators.summarize import LEVELS, summarize_level
from posrecon.sources.lines import FILE


@dataclass
class RunResult:
    """Lazy report frames by name, plus what the run keeps for them."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    observations: dict[str, list[Observation]] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)
    #: Exact numbers of stores, UPCs and files per side, for runs that sum stores and items.
    counts: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def metrics(self, timeout: float = 10.0) -> dict[str, dict]:
        """Observed counts per side; an error if no report has been computed.

        Counts arrive shortly after the first report, so up to ``timeout`` seconds are waited.
        """
        end = time.monotonic() + timeout
        while not all(o._jo.future().isCompleted() for seen in self.observations.values() for o in seen):
            if time.monotonic() > end:
                raise ValueError("no report of this run has been computed yet")
            time.sleep(0.05)
        return {name: {k: v for o in seen for k, v in o.get.items()} for name, seen in self.observations.items()}

    def release(self) -> None:
        """Drop the cached summaries once every report is written."""
        for df in self.kept:
            df.unpersist()


def observe_input(raw: DataFrame, config: FormatConfig, name: str) -> tuple[DataFrame, Observation]:
    """Count rows, unusable measures and rows without a store on the same pass."""
    seen = Observation(name)
    counted = raw.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        bad_measure_count(raw, config).alias("bad_measures"),
        F.count_if(F.col(f"`{config.store_col}`").isNull()).alias("no_store"),
    )
    return counted, seen


@dataclass
class _Sums:
    """The sums of a run's sides, cached: per store, per item and, from one scan, per file."""

    n_sides: int
    stores: DataFrame | None = None
    items: DataFrame | None = None
    summary: DataFrame | None = None
    exact: bool | int = False

    def store_side(self, side: int) -> DataFrame:
        p = tagged.SIDES[side]
        return self.stores.where(F.col(p + "Units").isNotNull()).select(
            "STORE_NUMBER", F.col(p + "Units").alias("Units"), F.col(p + "Totalprice").alias("Totalprice")
        )

    def item_side(self, side: int) -> DataFrame:
        p, (keys, sums) = tagged.SIDES[side], LEVELS["item"]
        return self.items.where(F.col(p + sums[0]).isNotNull()).select(*keys, *[F.col(p + m).alias(m) for m in sums])

    def review(self, side: int, by_file: bool, names: list[str]) -> DataFrame:
        if by_file:
            return review_of_summary(self.summary, side, self.exact)
        return review_from_summaries(self.store_side(side), self.item_side(side), names, self.exact)


def _summed(
    run: RunResult,
    raws: dict[str, tuple[DataFrame, FormatConfig]],
    exact: bool | int,
    stores: bool,
    items: bool,
    files: bool,
    seen: dict[str, Observation],
) -> _Sums:
    """Each side is scanned once for all reports of the run; a level that none needs is not computed."""
    out = _Sums(len(raws), exact=exact)
    if not (stores or items or files):
        return out
    counted = {}
    for name, (raw, config) in raws.items():
        counted[name], observed = observe_input(raw, config, name)
        run.observations[name] = [observed, *([seen[name]] if name in seen else [])]
    if (stores and items) or files:
        sales = [to_sales_rows(counted[name], config) for name, (_, config) in raws.items()]
        if files:
            sales = [s if FILE in s.columns else s.withColumn(FILE, F.lit(None).cast("string")) for s in sales]
        one_price = all(config.price_type != UNIT_PRICE for _, config in raws.values())
        out.summary = tagged.run_summary(sales, exact, stores, items, files, one_price).persist()
        out.stores = tagged.part(out.summary, "store")
        out.items = tagged.part(out.summary, "item").withColumnsRenamed(
            {p + "Units": p + "UNITS_SOLD" for p in tagged.SIDES[: out.n_sides]}
        )
        if stores and items:
            run.counts = tagged.key_counts_of(out.summary, list(raws), files)
        run.kept.append(out.summary)
        return out
    level = "store" if stores else "item"
    rows = [to_rows(counted[name], level, config) for name, (_, config) in raws.items()]
    keys, sums = LEVELS[level]
    if len(rows) == 2:
        told = tagged.both_sides(*rows, keys, sums, exact)
    else:
        told = summarize_level(rows[0], level, exact).withColumnsRenamed({m: tagged.SIDES[0] + m for m in sums})
    told = told.persist()
    run.kept.append(told)
    out.stores, out.items = (told, None) if stores else (None, told)
    return out


def reconcile(
    bau: DataFrame,
    test: DataFrame,
    bau_config: FormatConfig,
    test_config: FormatConfig,
    rules: ValidationConfig | None = None,
    exact: bool | int = False,
    file_counts: tuple[list[str], list[str]] | None = None,
    seen: dict[str, Observation] | None = None,
) -> RunResult:
    """Compare two sides; each side keeps its own configuration.

    ``bau`` and ``test`` are raw columns from ``read_pos``. Each enabled rule adds
    its frames: ``store_validation``; ``item_comparison`` and ``item_summary``;
    ``store_list``; ``bau_review`` and ``test_review``. Reviews are per file when
    the raw rows carry ``source_file``, else one consolidated row from the
    summaries (``file_counts`` holds the file names of both sides). Every side is scanned once.
    ``seen`` are the readers' own observations by side (``read_pos(..., seen=)``); their counts join the metrics.
    """
    rules = rules or ValidationConfig()
    run = RunResult()
    raws = {"bau": (bau, bau_config), "test": (test, test_config)}
    by_file = {name: rules.file_review.enabled and FILE in raw.columns for name, (raw, _) in raws.items()}
    from_sums = rules.file_review.enabled and not all(by_file.values())
    sums = _summed(
        run, raws, exact,
        rules.store_validation.enabled or rules.compare_store_list.enabled or from_sums,
        rules.item_validation.enabled or from_sums,
        any(by_file.values()),
        seen or {},
    )
    if rules.store_validation.enabled:
        run.frames["store_validation"] = store_comparison_of(sums.stores)
    if rules.item_validation.enabled:
        comparison = item_comparison_of(sums.items)
        run.frames["item_comparison"] = comparison
        run.frames["item_summary"] = item_summary(comparison)
    if rules.compare_store_list.enabled:
        run.frames["store_list"] = store_list_of(sums.stores)
    if rules.file_review.enabled:
        names = file_counts or (["BAU"], ["TEST"])
        for k, name in enumerate(raws):
            run.frames[f"{name}_review"] = sums.review(k, by_file[name], names[k])
    return run


def onboard(
    raw: DataFrame,
    config: FormatConfig,
    store_list: DataFrame | None = None,
    store_list_col: str = "Store",
    rules: ValidationConfig | None = None,
    exact: bool | int = False,
    files: list[str] | None = None,
    seen: Observation | None = None,
) -> RunResult:
    """Check one retailer's files: ``store_list`` against a given list,
    ``upc_summary`` and ``file_review``."""
    rules = rules or ValidationConfig()
    run = RunResult()
    by_file = rules.file_review.enabled and FILE in raw.columns
    from_sums = rules.file_review.enabled and not by_file
    sums = _summed(
        run, {"retailer": (raw, config)}, exact,
        rules.compare_store_list.enabled or from_sums, rules.item_validation.enabled or from_sums, by_file,
        {"retailer": seen} if seen else {},
    )
    if rules.compare_store_list.enabled:
        if store_list is None:
            raise ValueError("a store list is required to compare stores")
        run.frames["store_list"] = store_list_diff(sums.store_side(0), store_list, "STORE_NUMBER", store_list_col)
    if rules.item_validation.enabled:
        run.frames["upc_summary"] = sums.item_side(0)
    if rules.file_review.enabled:
        run.frames["file_review"] = sums.review(0, by_file, files or ["retailer"])
    return run
