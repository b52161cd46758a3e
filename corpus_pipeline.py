"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

1. Quality rules: documents that fail the base check or the fences of their group go.
2. Line dedup: repeated lines go from every document but the largest that holds them.
3. N-gram Jaccard join (five words, similarity 0.8): one document of each group stays.
4. Secret scans: every secret in a text is masked.
5. Packing: the texts as sequences of tokens.

``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from posrecon.llm import jaccard, line_dedup, packing, quality_rules as quality, secrets

SIMILAR = jaccard.Join(words=5, num=80, den=100)


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def line_dedup_stage(spark, docs, sf_dir):
    return _counted(line_dedup.without_repeated_lines(docs))


def ngram_jaccard(spark, docs, sf_dir):
    return jaccard.one_of_each(docs, SIMILAR)


def secret_scans(spark, docs, sf_dir):
    return _counted(secrets.redact(docs))


def packed(spark, docs, sf_dir):
    return packing.packing_report(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard),
    ("secret scans", secret_scans),
    ("packing", packed),
]
#: The fences, fingerprints and packing have no SQL of their own; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    from posrecon.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
