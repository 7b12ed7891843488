"""The parse end to end, index building, and splits, on small fixtures."""

import pytest

from dialoom.errors import ArtifactError, CorpusError
from dialoom.operators.corpus import format_report, parse_corpus
from dialoom.operators.embedding import HashedWords, build_index, ensure_fits
from dialoom.operators.evalset import split_problems
from dialoom.sources.files import cached_indexes, check_digest, load_index, write_run

RECORDS = [
    (0, "0", "1", "1", "Ada", "The kettle is on."),
    (1, "1", "", "", "ADA & Bo", "Who took my hat? - Nobody did."),
    (2, "2", "1", "1", "ada", "Fine."),
    (3, "('Bo', 'It was me.')", "1", "1", "", ""),
    (4, "4", "x", "1", "Bo", "Lost."),
    (5, "5", "", "", "", ""),
    (6, "6", "1", "1", "Bo", "..."),
    (7, "7", "", "", "Cy", "No episode."),
]
FIELDS = "csv_record long, index_field string, season string, episode string, speaker string, text string"


def parsed(spark, records=RECORDS):
    none = spark.createDataFrame([], "from_name string, to_name string")
    scoped = spark.createDataFrame([(1, 1, "Bo", "Bob")], "season int, episode int, from_name string, to_name string")
    return parse_corpus(spark.createDataFrame(records, FIELDS), scoped, none)


def test_parse_corpus(spark):
    p = parsed(spark)
    lines = [(r.csv_record, r.part, r.clean_text, r.speaker) for r in p.lines.orderBy("csv_record", "part").collect()]
    assert lines == [(0, 0, "The kettle is on.", "Ada"), (1, 0, "Who took my hat?", None), (1, 1, "Nobody did.", None), (2, 0, "Fine.", "Ada"), (3, 0, "It was me.", "Bob")]
    assert [r.csv_record for r in p.dead.collect()] == [4]
    assert [r.csv_record for r in p.unresolved.collect()] == [7]
    assert [r.csv_record for r in p.no_content.collect()] == [6]
    facts = {r.fact: r.n for r in p.report.collect()}
    assert facts == {"rows": 5, "failed": 1, "unresolved": 1, "lines": 5, "no_content": 1, "filled_episode_ids": 1, "unpacked_tuple_row": 1, "reconstructed_source_row": 1}
    assert "filled_episode_ids" in format_report(p.report)
    assert {(r.speaker_raw, r.speaker) for r in p.mappings.collect()} == {("ada", "Ada"), ("Bo", "Bob")}


def test_no_lines(spark):
    with pytest.raises(CorpusError):
        parsed(spark, [(0, "0", "1", "1", "Bo", "...")])


def test_index(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    facts = {"chunks": "x"}
    build_index(chunks, HashedWords(), f"{tmp_path}/good", facts)
    assert load_index(spark, f"{tmp_path}/good", facts | HashedWords().identity()).count() == 2
    with pytest.raises(ArtifactError):
        ensure_fits(chunks, HashedWords(most_tokens=1))
    (tmp_path / "half" / "vectors").mkdir(parents=True)
    assert {(r["name"], r["status"]) for r in cached_indexes(spark, str(tmp_path)).collect()} == {("good", "ok"), ("half", "incomplete")}


def test_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0)], "query_id long, rr double")
    first, second = (write_run(spark, str(tmp_path), "r", {"k": 5}, rows) for _ in range(2))
    assert first.endswith("/r") and second.endswith("/r-2")
    assert spark.read.parquet(f"{second}/queries").count() == 1


def test_digest(spark, tmp_path):
    (tmp_path / "f").write_text("text")
    digest = check_digest(spark, str(tmp_path / "f"), "0", allow=True)
    assert check_digest(spark, str(tmp_path / "f"), digest) == digest
    with pytest.raises(CorpusError):
        check_digest(spark, str(tmp_path / "f"), "0")


def test_split_problems(spark):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    found = split_problems(frame([1, 2, 3, 4]), frame([1, 2]), frame([2, 3, 9]))
    assert {(r.id, r.problem) for r in found.collect()} == {(2, "in both"), (4, "in neither"), (9, "not in the benchmark")}
