"""The corpus pipeline: five stages from raw documents to a seeded mix of them.

Every stage but the last takes and returns the columns of `documents`; the last
returns how many words the mix takes of each remaining document.

Every decision holds for a row, named by its id and text: of rows that share an id, only those go that a
stage rejects, and rows equal in id and text stay or go together. Rows with a null id pass the near-duplicate and
substring stages untouched and are judged by the others; an empty table gives no rows. Further columns pass through all stages
but the last unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import fm_index, language_id, minhash, mixing, paragraphs
from tidewatch.llm.common import ROW, materialize, table, without_rows


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that every model rejects go."""
    model, prefix = language_id.fit(docs), "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return language_id.identify(docs, model, prefix=prefix).filter(~F.col(f"{prefix}rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest id."""
    gone = materialize(minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id", ROW).distinct(), "near")
    return without_rows(docs, gone)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that an earlier document has."""
    cut = paragraphs.remove(docs, paragraphs.repeats(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: fewer than 5 % of their words lie in 13-word windows of benchmark items."""
    found = fm_index.contamination(docs, table(spark, sf_dir, "benchmark"), words=13, share=5)
    gone = materialize(found.filter("contaminated").select("doc_id", ROW).distinct(), "contaminated")
    return without_rows(docs, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every remaining document."""
    return mixing.mix(docs).select("doc_id", F.col("sources")[0].alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: Kneser-Ney models and word-by-word growth of passages are beyond SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
