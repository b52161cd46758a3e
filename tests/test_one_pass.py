"""Both sides in one aggregation, all reports of a run from one scan, orphans."""

import random
from collections import Counter

import pytest
from pyspark.sql import Observation, functions as F

from posrecon.operators import compare as cmp
from posrecon.operators.audit import audit_summary, outer_presence, presence_of_rows
from posrecon.operators.canonical import to_rows
from posrecon.operators.summarize import summarize_level
from posrecon.plans.reconcile import onboard, reconcile
from posrecon.sources.lines import FILE
from posrecon.sources.transactions import read_transactions, transaction_counts
from tests.fixtures import FORMATS, NAMES, ROWS, TEST_ROWS
from tests.test_formats import DTL, HDR
from tests.test_records_in_splits import path_up

CONFIG = FORMATS["delimited"][1]


def exchanges(df):
    rows = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("Exchange" in r and "ReusedExchange" not in r for r in rows)


@pytest.fixture
def both(spark):
    rnd = random.Random(5)
    one = lambda k: [
        (rnd.choice(["S1", "S2", "S3", None, f"only{k}"]), rnd.choice(["1", "2 ", None, f"9{k}"]), rnd.choice(["W", None]),
         str(rnd.randint(0, 9)), f"{rnd.random() * 50:.2f}")
        for _ in range(300)
    ]
    return [spark.createDataFrame(one(k), NAMES) for k in range(2)]


@pytest.mark.parametrize("level", ["store", "item"])
def test_one_aggregation_equals_the_join_of_two_summaries(both, level):
    rows = [to_rows(df, level, CONFIG) for df in both]
    sums = [summarize_level(r, level, True) for r in rows]
    if level == "store":
        one, two = cmp.store_validation(*rows, exact=True, ordered=False), cmp.store_diffs(*sums, ordered=False)
    else:
        one, two = cmp.item_validation(*rows, exact=True)[0], cmp.item_comparison(*sums)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))
    assert sum(r[0] is None for r in one.collect()) >= 2  # null keys of the two sides stay apart
    assert exchanges(one.select("*")) == 1


def test_presence_of_rows_equals_the_join(both):
    names = {"UPC": "UPC_CODE", "Description": "PRODUCT_DESCRIPTION", "Units": "UNITS_SOLD", "Price": "TOTAL_DOLLARS"}
    rows = [df.withColumnsRenamed(names) for df in both]
    one, two = presence_of_rows(*rows, exact=True), outer_presence(*(audit_summary(r, True) for r in rows))
    assert one.columns == two.columns and Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))
    assert exchanges(one.select("*")) == 1


def test_a_run_scans_each_side_once(spark, tmp_path):
    paths = []
    for name, rows in (("bau", ROWS), ("test", TEST_ROWS)):
        for k in range(3):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{k}.csv").write_text(FORMATS["delimited"][0](rows))
        paths.append(spark.read.option("header", True).csv(str(tmp_path / name)).withColumn(FILE, F.col("_metadata.file_path")))
    run = reconcile(*paths, CONFIG, CONFIG)
    (summary,) = run.kept
    def sources(df):
        leaves = df._jdf.queryExecution().withCachedData().collectLeaves()
        return {leaves.apply(i).nodeName() for i in range(leaves.size())}

    assert summary.is_cached and all(sources(f) == {"InMemoryRelation"} for f in [*run.frames.values(), run.counts])
    assert "InMemoryRelation" not in sources(paths[0].select("Store"))
    assert {r.side: (r.stores, r.upcs, r.files) for r in run.counts.collect()} == {"bau": (3, 3, 3), "test": (4, 4, 3)}
    assert [r.filename for r in run["bau_review"].orderBy("filename").collect()] == ["0.csv", "1.csv", "2.csv"]
    run.release()


def test_one_side_with_files_and_null_keys(both):
    bau, test = both
    run = reconcile(bau.withColumn(FILE, F.lit("/x/a.csv")), test, CONFIG, CONFIG, exact=True, file_counts=(["-"], ["t.csv"]))
    stores, upcs = (bau.select(F.trim(c)).distinct().count() for c in ("Store", "UPC"))
    row = run["bau_review"].first()
    assert (row.filename, row.store_count, row.upc_count) == ("a.csv", stores, upcs)
    assert run["test_review"].first().filename == "t.csv"
    counts = {r.side: r.files for r in run.counts.collect()}
    assert counts == {"bau": 1, "test": 0}
    run.release()
    alone = onboard(bau.withColumn(FILE, F.lit("/x/a.csv")), CONFIG, test, "Store", exact=True)
    assert tuple(alone["file_review"].first())[:3] == ("a.csv", stores, upcs) and alone.counts.first().files == 1
    alone.release()


def sequential_orphans(text):
    details = orphans = 0
    is_open = False
    for line in text.split("\n"):
        if line.startswith("HDR"):
            is_open = True
        elif line.startswith("TRL"):
            is_open = False
        elif line:
            details += 1
            orphans += not is_open
    return details, orphans


@pytest.mark.parametrize("seed", range(4))
def test_orphans_equal_a_sequential_model(small_splits, tmp_path, seed):
    rnd = random.Random(seed)
    weights = rnd.choice([(1, 1, 9, 1), (1, 6, 30, 0), (1, 1, 200, 3)])
    want = {}
    for k in range(3):
        kinds = rnd.choices(["HDR001Store 1", "TRL001   100", "DTL001Item A", ""], weights, k=600)
        (tmp_path / f"{k}.txt").write_text("\n".join(kinds) + "\n")
        want[f"{k}.txt"] = sequential_orphans("\n".join(kinds))
    got = transaction_counts(small_splits, str(tmp_path), "HDR", "TRL")
    assert {r[0].rsplit("/", 1)[-1]: (r.details, r.orphans) for r in got.collect()} == want
    scan = path_up(transaction_counts(small_splits, str(tmp_path), "HDR", "TRL"), "FileScan text")
    assert scan == []  # only stored tables of marks and blocks are left in the plan
    seen = Observation("seen")
    read_transactions(small_splits, str(tmp_path), "HDR", HDR, DTL, "TRL", seen=seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"details": sum(d for d, _ in want.values()), "orphan_details": sum(o for _, o in want.values())}


def test_reviews_per_file_deal_rows_out_before_they_group_them(spark, both):
    """rows go to parts of bounded size by UPC, and each level's groups have the same few keys."""
    parted = [df.withColumn(FILE, F.concat(F.lit("/x/f"), F.col("Units"))) for df in both]
    run = reconcile(*parted, CONFIG, CONFIG, exact=True)
    plan = run.kept[0]._jdf.queryExecution().optimizedPlan().toString()
    parts = run.kept[0]._jdf.queryExecution().logical().toString()
    assert parts.lower().count("rebalance") == 2 and "Expand" not in plan + parts
    for side, name, df in zip(range(2), ("bau_review", "test_review"), parted):
        want = {
            r[0].rsplit("/", 1)[-1]: (r[1], r[2], r[3], r[4])
            for r in df.groupBy(FILE).agg(
                F.size(F.collect_set(F.coalesce("Store", F.lit("-")))), F.size(F.collect_set(F.coalesce(F.trim("UPC"), F.lit("-")))),
                F.sum(F.col("Units").cast("double")), F.round(F.sum(F.col("Price").cast("decimal(12,2)")), 2).cast("double"),
            ).collect()
        }
        assert {r[0]: tuple(r)[1:] for r in run[name].collect()} == want
    run.release()


@pytest.mark.parametrize("exact", [False, True])
def test_store_dollars_are_summed_apart_only_under_unit_prices(both, exact):
    """one dollars sum per side where both levels have the same; results are those of each level alone."""
    unit = CONFIG.with_(price_type="Unit Price")
    for configs, alike in (((CONFIG, CONFIG), True), ((CONFIG, unit), False), ((unit, unit), False)):
        run = reconcile(*both, *configs, exact=exact)
        assert ("b_Totalprice" not in run.kept[0].columns) == alike
        sums = [[summarize_level(to_rows(df, level, c), level, exact) for df, c in zip(both, configs)] for level in ("store", "item")]
        near = lambda df: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert near(run["store_validation"]) == near(cmp.store_diffs(*sums[0], ordered=False))
        assert near(run["item_comparison"]) == near(cmp.item_comparison(*sums[1]))
        run.release()


def test_a_review_of_all_files_adds_up_exactly(spark):
    """a large price does not take the cents of the others."""
    rows = [("S1", "1", "W", "1", "900000000000000")] + [("S1", str(i), "W", "1", "0.01") for i in range(2, 302)]
    df = spark.createDataFrame(rows, NAMES).repartition(8)
    run = reconcile(df, df, CONFIG, CONFIG, exact=True)
    assert {r.total_dollars for r in run["bau_review"].union(run["test_review"]).collect()} == {900000000000003.0}
    run.release()
