"""Sources and sinks: raw CSV, dimensions, JSON lines, chunk sets and vector indexes with fingerprints.

Paths go to Spark's readers and writers, so any store that Spark reaches will do. Manifests are
one-row JSON tables beside the data.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArtifactError, CorpusError
from ..operators.evalset import Item, fingerprint, parse_items, vector_checks

RAW = ("", "Season", "Episode", "Speaker", "Line", "date_job")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """csv_record, index_field, season, episode, speaker, text: all strings, blanks as ''. The header must be the known one.

    A multi-line file is read by one task, so the row number is its order.
    """
    header = spark.read.text(path).first()
    if header is None or header[0].lstrip("﻿").rstrip("\r") != ",".join(RAW):
        raise CorpusError("unknown header", expected=",".join(RAW), actual=header and header[0])
    names = ("index_field", "season", "episode", "speaker", "text", "date_job")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.monotonically_increasing_id().alias("csv_record"), *[F.coalesce(n, F.lit("")).alias(n) for n in names[:-1]])


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """season, episode, episode_title; a repeated key is an error."""
    rows = spark.read.option("header", True).csv(path)
    if missing := {"season", "episode", "episode_title"} - set(rows.columns):
        raise CorpusError("missing columns", actual=sorted(missing))
    titles = rows.select(F.col("season").cast("int").alias("season"), F.col("episode").cast("int").alias("episode"), "episode_title")
    if not titles.groupBy("season", "episode").count().filter("count > 1").isEmpty():
        raise CorpusError("an episode has several titles")
    return titles


def read_aliases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scoped, everywhere) from one JSON document with ``episode_scoped`` and ``global`` entries."""
    entry = "array<struct<`from`:string,`to`:string,episodes:array<string>>>"
    doc = spark.read.schema(f"global {entry}, episode_scoped {entry}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    everywhere = doc.select(F.explode("global").alias("e")).select(F.col("e.from").alias("from_name"), F.col("e.to").alias("to_name"))
    scoped = doc.select(F.explode("episode_scoped").alias("e")).select(F.explode("e.episodes").alias("code"), F.col("e.from").alias("from_name"), F.col("e.to").alias("to_name"))
    part = lambda i: F.regexp_extract("code", r"^S(\d+)E(\d+)$", i)
    if not scoped.filter(part(1) == "").isEmpty():
        raise CorpusError("an episode code is not like S1E2")
    return scoped.select(part(1).cast("int").alias("season"), part(2).cast("int").alias("episode"), "from_name", "to_name"), everywhere


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_items(spark: SparkSession, path: str) -> list[Item]:
    """Evaluation items of one JSON file (some hundreds)."""
    return parse_items(json.loads(spark.read.option("wholetext", True).text(path).first()[0]))


def _write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_chunks(chunks: DataFrame, path: str, settings: dict) -> dict:
    """Chunks as Parquet, with a manifest of settings, count and fingerprint."""
    chunks.write.mode("errorifexists").parquet(f"{path}/chunks")
    facts = settings | {"n_chunks": chunks.sparkSession.read.parquet(f"{path}/chunks").count(), "sha256": fingerprint(chunks.sparkSession.read.parquet(f"{path}/chunks"), "chunk_id", ["chunk_id", "text"]).first()[0]}
    _write_manifest(chunks.sparkSession, f"{path}/manifest", facts)
    return facts


def load_chunks(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """The chunks, if settings, count and fingerprint are those of the manifest."""
    facts, chunks = read_manifest(spark, f"{path}/manifest"), spark.read.parquet(f"{path}/chunks")
    if stale := {k: v for k, v in settings.items() if facts.get(k) != v}:
        raise ArtifactError("stale chunk set", expected=stale, actual={k: facts.get(k) for k in stale}, recovery="build the chunks again")
    if (n := chunks.count()) != facts["n_chunks"]:
        raise ArtifactError("chunks are missing", expected=facts["n_chunks"], actual=n)
    if fingerprint(chunks, "chunk_id", ["chunk_id", "text"]).first()[0] != facts["sha256"]:
        raise ArtifactError("chunks were changed", recovery="build the chunks again")
    return chunks


def save_index(vectors: DataFrame, path: str, facts: dict, dim: int) -> None:
    """Vectors (chunk_id, vector) that are finite and of unit length, with a manifest."""
    found = vector_checks(vectors, dim).first().asDict()
    if any(found[k] for k in ("wrong_size", "not_finite", "not_unit")):
        raise ArtifactError("unsound vectors", actual=found)
    vectors.write.mode("errorifexists").parquet(f"{path}/vectors")
    _write_manifest(vectors.sparkSession, f"{path}/manifest", facts | {"n": found["n"], "dim": dim})


def load_index(spark: SparkSession, path: str, facts: dict) -> DataFrame:
    kept, vectors = read_manifest(spark, f"{path}/manifest"), spark.read.parquet(f"{path}/vectors")
    if any(kept.get(k) != v for k, v in facts.items()):
        raise ArtifactError("stale index", expected=facts, actual=kept, recovery="build the index again")
    found = vector_checks(vectors, kept["dim"]).first().asDict()
    if found["n"] != kept["n"] or any(found[k] for k in ("wrong_size", "not_finite", "not_unit")):
        raise ArtifactError("unsound index", expected=kept, actual=found)
    return vectors


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def check_digest(spark: SparkSession, path: str, expected: str, allow: bool = False) -> str:
    """The digest of a file, which must be the expected one unless another is allowed."""
    if (found := file_digest(spark, path)) != expected and not allow:
        raise CorpusError("the file is not the known one", expected=expected, actual=found, recovery="fetch it again, or allow another")
    return found


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cached_indexes(spark: SparkSession, base: str) -> DataFrame:
    """(name, status, n, dim) of the index folders in ``base``: ok, or incomplete (no manifest, or no vectors)."""
    fs, where = _file_system(spark, base)
    rows = []
    for folder in fs.listStatus(where) if fs.exists(where) else []:
        if folder.isDirectory():
            path = folder.getPath().toString()
            ok = all(fs.exists(_file_system(spark, f"{path}/{part}/_SUCCESS")[1]) for part in ("vectors", "manifest"))
            facts = read_manifest(spark, f"{path}/manifest") if ok else {}
            rows.append((folder.getPath().getName(), "ok" if ok else "incomplete", facts.get("n"), facts.get("dim")))
    return spark.createDataFrame(rows, "name string, status string, n long, dim long")


def write_run(spark: SparkSession, base: str, run_id: str, facts: dict, rows: DataFrame) -> str:
    """Writes the rows of a run and its facts into a new folder, and returns that; a name in use gets -2, -3 and so on."""
    path, n = f"{base}/{run_id}", 1
    while (found := _file_system(spark, path)) and found[0].exists(found[1]):
        n += 1
        path = f"{base}/{run_id}-{n}"
    rows.write.mode("errorifexists").parquet(f"{path}/queries")
    _write_manifest(spark, f"{path}/run", facts | {"run_id": path.rsplit("/", 1)[-1], "spark": spark.version})
    return path
