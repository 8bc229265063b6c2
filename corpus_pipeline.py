"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

A stage is (spark, docs, sf_dir) -> DataFrame and works on all rows that its predecessor kept; all
but the last return the columns of ``documents``. Null and empty texts fall to the quality rules.
"""

from __future__ import annotations

from relata.llm import decontaminate, linededup, mixing, quality, simhash
from relata.llm.common import materialize, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the fixed rules or a risk-controlled cutoff reject go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark, docs, sf_dir):
    """Lines equal or near-equal to an earlier one go, and documents that keep no word."""
    return linededup.dedup(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash group stays, the one of least id."""
    return simhash.dedup(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them, numbered in ``mix_copy``."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: No stage but the last can be said in SQL (binomial bounds, edit distance, Hamming components).
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
