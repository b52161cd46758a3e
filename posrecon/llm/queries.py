"""Registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from posrecon.llm.alignment import alignment_report
from posrecon.llm.bpe import encoding_report
from posrecon.llm.common import table
from posrecon.llm.jaccard import joined
from posrecon.llm.language import language_report
from posrecon.llm.line_dedup import line_report
from posrecon.llm.mixing import mix_report
from posrecon.llm.neighbors import neighbor_report
from posrecon.llm.packing import packing_report
from posrecon.llm.quality_model import quality_scores
from posrecon.llm.quality_rules import quality_report
from posrecon.llm.runs import run_report
from posrecon.llm.secrets import secret_report
from posrecon.llm.toxicity import toxicity_report


def op1_ngram_jaccard(spark, sf_dir):
    return joined(table(spark, sf_dir, "documents"))


def op2_neighbors(spark, sf_dir):
    return neighbor_report(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_model(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return encoding_report(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language_report(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing_report(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment_report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return run_report(table(spark, sf_dir, "documents"))


def op13_mixing(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_neighbors": op2_neighbors,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_quality_model": op5_quality_model,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_secret_scans": op10_secret_scans,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}
