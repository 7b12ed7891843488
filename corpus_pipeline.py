"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, mixing.

Each stage takes the documents that its predecessor kept and returns documents with the same columns;
the last adds what the mix takes of each. Every stage is written as Parquet in the shared folder before
the next one reads it, so a lost executor costs at most one stage's tasks. A stage keeps its tables in
one folder, which goes as soon as another stage begins (unless the documents given still read it).

Defined cases, of every stage: rows are kept or dropped whole, with their columns in order, and columns
of any other name are carried along untouched (the last stage replaces mix_size, mix_target and
mix_taken). Null, empty and very long texts are judged by what is in them: the quality rules reject a
text without a word, near-dedup links it with nothing, decontamination and PII find nothing in it,
and the mix takes no word of it, so it leaves there. Null sources and languages form groups of their
own. Rows that are equal in all columns pass or fail together, but near-dedup keeps one row of an id;
it keeps every row with a null id. Empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm.common import Scratch, read_table
from dialoom.llm.decontaminate import decontaminate
from dialoom.llm.minhash import NearConfig, near_dedup
from dialoom.llm.mixing import mix_select
from dialoom.llm.pii import pii_redact
from dialoom.llm.quality import QualityConfig, quality_filter

#: Short texts aren't junk by that alone: only texts without a word go for their length.
QUALITY = QualityConfig(min_words=1)
#: The stage links from a similarity of 0.80 on; a pair at 0.80 agrees in fewer than 34 of 64 coordinates with a chance of 3e-7.
NEAR = NearConfig(percent=80, least=34)

_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str, docs: DataFrame) -> Scratch:
    """A folder for a stage's tables; those of earlier stages go."""
    for old in [s for s in _open if s.spark is not spark or not s.feeds(docs)]:
        if old.spark is spark:
            old.close()
        _open.remove(old)
    _open.append(Scratch(spark, name))
    return _open[-1]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the adaptive quality rules go."""
    return quality_filter(docs, QUALITY, _scratch(spark, "quality", docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dedup(docs, NEAR, _scratch(spark, "near", docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), scratch=_scratch(spark, "decontaminate", docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    _scratch(spark, "pii", docs)
    return pii_redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with mix_size, mix_target and mix_taken (words, repeats counted)."""
    return mix_select(docs, scratch=_scratch(spark, "mix", docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: Signatures and sketches have no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch, docs, before = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
