"""Small cases of the engine's operators."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom import cli
from dialoom.config import Chunking, Evaluation, Retrieval, Settings, load_settings
from dialoom.errors import ArtifactError, ConfigurationError, CorpusError, EvaluationError, HeldOutError
from dialoom.functions import text as T
from dialoom.operators import chunking, evalset, lines, metrics, repair, retrieval, scenes, speakers
from dialoom.sources import files
from dialoom.streaming.cleaning import clean_stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("rule", "value", "wanted"),
    [
        (T.leading_dash, "-41 below", "-41 below"), (T.leading_dash, "- 41 below", "41 below"), (T.leading_dash, "-  - wait", "wait"), (T.leading_dash, "---", "---"),
        (T.trailing_dash, "was it rain? -", "was it rain?"), (T.trailing_dash, "so she --", "so she --"), (T.caps_l, "BAlL in ClTY, Bl", "BAIL in CITY, Bl"), (T.l_as_i, "may l? lf öl", "may I? If öl"),
        (T.missing_space, "rain.Then", "rain. Then"), (T.plain_typography, "o’’k", 'o"k'), (T.collapse_whitespace, " q \n r ", "q r"), (T.match_form, "Won't. Go—later", "wont go later"),
    ],
)
def test_rules(spark, rule, value, wanted):
    assert one(spark, value, rule) == wanted


def test_turns_drop_pieces_without_content(spark):
    rows = spark.createDataFrame([(1, "- Rain? - ... - By noon. -"), (2, " - "), (3, None)], "csv_record long, text_raw string")
    got = [tuple(r) for r in lines.turns(rows).orderBy("csv_record", "part").select("csv_record", "part", "n_parts", "clean_text").collect()]
    assert got == [(1, 0, 2, "Rain?"), (1, 1, 2, "By noon.")]


def cut(counts, size, overlap):
    starts, ends = chunking.cuts(np.array(counts), size, overlap)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def test_cuts_of_small_cases():
    assert cut([2] * 6, 6, 0) == [(0, 3), (3, 6)]
    assert cut([3] * 5, 9, 3) == [(0, 3), (2, 5)]
    assert cut([8, 8, 70], 75, 20) == [(0, 2), (2, 3)]
    assert cut([2, 90, 2], 8, 2) == [(0, 1), (1, 2), (2, 3)]
    assert cut([], 8, 2) == []
    for bad in ((7, 7), (0, 0), (7, -2)):
        with pytest.raises(ValueError):
            cut([1], *bad)


def test_cuts_equal_their_definition():
    """Of all ends and next starts, those that the rules allow, the longest window and the longest overlap win."""
    rng = random.Random(7)
    for _ in range(200):
        counts = [rng.randint(0, 60) for _ in range(rng.randint(1, 90))]
        size = rng.choice([16, 64, 256])
        overlap, made = rng.randrange(size), cut(counts, size, rng.randrange(size))
        made = cut(counts, size, overlap)
        assert made[0][0] == 0 and made[-1][1] == len(counts)
        for n, (a, b) in enumerate(made):
            assert b == max(e for e in range(a + 1, len(counts) + 1) if e == a + 1 or sum(counts[a:e]) <= size)
            if b < len(counts):
                room = min(overlap, size - counts[b])
                assert made[n + 1][0] == min([t for t in range(a + 1, b) if sum(counts[t:b]) <= room], default=b)


def test_greedy_boundaries():
    assert scenes.accept([(1.2, 12), (2.0, 8), (1.1, 20)], 30, 6) == [8, 20]
    assert scenes.accept([(9.0, 3)], 30, 6) == []


def test_scene_of_a_clean_switch(spark):
    rows = [(1, i, ["a", "b"][i % 2 : i % 2 + 1] if i < 12 else ["c", "d"][i % 2 : i % 2 + 1], "x", i) for i in range(24)]
    made = spark.createDataFrame(rows, "ep long, i long, speakers array<string>, clean_text string, source_row long")
    assert [r.line_start for r in scenes.scenes(made).orderBy("scene").collect()] == [0, 12]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(i, "common" + (" rare" if i == 3 else f" w{i}")) for i in range(6)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "common"), (2, "rare rare"), (3, "nothing")], "query_id long, text string")
    got = retrieval.Bm25(docs).search(asked, 5).collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in got] == [(2, 3, 1)]
    assert retrieval.top_k(retrieval.bm25_scores(docs, asked), 0).count() == 0
    ranks = spark.createDataFrame([(1, c, m, r) for m, cs in (("bm25", "abc"), ("dense", "ca")) for r, c in enumerate(cs, 1)], "query_id long, chunk_id string, method string, rank int")
    scores = {r.chunk_id: r.score for r in retrieval.fuse(ranks).collect()}
    assert scores == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 62, "c": 1 / 63 + 1 / 61}, abs=1e-12)


def test_speakers_filter_needs_all(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], ["a"]), (2, [0.0, 1.0], ["a", "b"])], "chunk_id long, vector array<float>, speakers array<string>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.chunk_id for r in retrieval.Dense(v).search(q, 5, retrieval.Filters(speakers=("a", "b"))).collect()] == [2]
    assert retrieval.Dense(v).search(q, 5).count() == 2


def test_metrics(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 7), ("any", 1, 3), ("deep", 0, 20)], "query_id string, target int, rank int")
    needs = spark.createDataFrame([("q", 0, 0), ("q", 1, 1), ("q", 2, 2), ("any", 0, 0), ("any", 0, 1), ("deep", 0, 0)], "query_id string, requirement int, target int")
    got = {r.query_id: r for r in metrics.score_rankings(hits, needs).collect()}
    assert (got["q"].recall_1, got["q"].recall_10, got["q"].all_10, got["q"].rr) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 0.0, 1.0)
    assert (got["any"].hit_5, got["any"].recall_5, got["any"].all_5) == (1.0, 1.0, None)
    assert (got["deep"].hit_10, got["deep"].rr, got["deep"].first_relevant_rank, got["deep"].first_relevant_rank_in_depth) == (0.0, 0.0, None, 20)
    ranks = {r.query_id: r.ranks for r in metrics.target_first_ranks(hits, needs).collect()}
    assert ranks["q"] == [None, 1, 7]


def test_fill_and_rows(spark):
    rows = [(0, 1, 1), (1, None, None), (2, 1, 1), (3, None, 2), (4, 1, 2), (5, None, None)]
    made = spark.createDataFrame([(i, s, e, "") for i, s, e in rows], "csv_record long, season int, episode int, index_field string")
    got = {r.csv_record: (r.season, r.episode, r.filled) for r in repair.fill_ids(made).collect()}
    assert got[1] == (1, 1, "filled") and got[3][2] == "unresolved" and got[5][2] == "unresolved"
    assert {r.csv_record: r.source_row for r in repair.source_rows(repair.fill_ids(made).filter("filled <> 'unresolved'")).collect()} == {0: 0, 1: 1, 2: 2, 4: 0}


def test_rows_from_records(spark):
    raw = [(0, "1", "2.0", "1.7", "A", "x"), (1, "('B', 'y')", "1.0", "1.0", "", ""), (2, "(bad", "1", "1", "C", "z"), (3, "", "abc", "1", "", "")]
    good, bad = repair.build_rows(spark.createDataFrame(raw, "csv_record long, index_field string, season string, episode string, speaker string, text string"))
    assert {r.csv_record: (r.season, r.episode, r.speaker, r.text) for r in good.collect()} == {0: (2, 1, "A", "x"), 1: (1, 1, "B", "y")}
    assert {r.csv_record for r in bad.collect()} == {2, 3}


def test_labels(spark):
    tidy = lambda v: one(spark, v, lambda c: speakers.tidy_label(c)["text"])
    assert (tidy("Guard # 7"), tidy("Guard7"), tidy("(Choir)"), tidy("3rd DOCK Hand")) == ("Guard 7", "Guard 7", "Choir", "3rd DOCK Hand")
    assert one(spark, "MOnika", speakers.casing_errors) == 1
    counts = spark.createDataFrame([("MOnika", 9), ("Monika", 2)], "name string, n long")
    assert [tuple(r) for r in speakers.case_map(counts).collect()] == [("MOnika", "Monika")]


def test_items():
    span = {"season": 1, "episode": 1, "source_row_start": 3}
    item = evalset.parse_item({"id": "a", "question": "?", "required_groups": [{"mode": "any", "targets": [span, span]}, {"mode": "all", "targets": [span]}]})
    assert item.requirements() == [[0, 1], [2]]
    with pytest.raises(EvaluationError, match="2 problems"):
        evalset.parse_items([{"id": "a", "question": "?", **span, "targets": []}, {"id": "b", "question": "?", "season": True, "episode": 1, "source_row_start": 1}])


def test_split(spark):
    rows = [(f"i{n:02}", f"t{n % 3}", str(n % 2), [n % 4, n % 5]) for n in range(30)]
    items = spark.createDataFrame(rows, "id string, question_type string, style string, seasons array<int>")
    chosen = lambda draws: [tuple(r) for r in evalset.choose_dev(items.repartition(3), "question_type", ["style", "seasons"], 9, draws, 5).orderBy("id").collect()]
    few, many = chosen(5), chosen(40)
    assert few == chosen(5) and len(few) == 9 and many[0][2] <= few[0][2]
    kinds = Counter(dict((r[0], r[1]) for r in rows)[i] for i, _, _ in many)
    assert set(kinds.values()) == {3}
    whole = Counter(("style", r[2]) for r in rows) + Counter(("seasons", str(v)) for r in rows for v in r[3])
    own = Counter(("style", r[2]) for r in rows if r[0] in {m[0] for m in many}) + Counter(("seasons", str(v)) for r in rows if r[0] in {m[0] for m in many} for v in r[3])
    assert many[0][2] == pytest.approx(sum(abs(own[k] - 0.3 * n) for k, n in whole.items()))
    with pytest.raises(EvaluationError):
        evalset.choose_dev(items, "question_type", ["style"], 30, 3, 5)


def test_checks_and_reports(spark):
    lines = spark.createDataFrame([(1, r, f"Row {r} tells of a rare zebra." if r == 2 else f"row {r}") for r in range(5)], "ep int, source_row int, clean_text string")
    spans = spark.createDataFrame([("a", 0, 1, 1, 2), ("a", 1, 1, 3, 9), ("b", 0, 7, 0, 0), ("c", 0, 1, 0, 0)], "query_id string, target int, ep int, start int, end int")
    statuses = spark.createDataFrame([("a", 0, "ok"), ("c", 0, "moved")], "query_id string, target int, status string")
    assert sorted(tuple(r) for r in evalset.check_spans(spans, lines, statuses).collect()) == [("a", 1, "rows beyond the episode"), ("b", 0, "unknown episode"), ("c", 0, "quote outside its rows")]
    texts = {r.query_id: r.text for r in evalset.scored_text(spans, lines).collect()}
    assert texts == {"a": "row 1 Row 2 tells of a rare zebra. row 3 row 4", "c": "row 0"}
    pairs = spark.createDataFrame([("a", "Which zebra is rare?", texts["a"])], "id string, q string, t string")
    rare = evalset.rare_words(lines.withColumn("g", F.col("source_row")), "g", "clean_text", 1)
    assert evalset.shared_rare_words(pairs, "q", "t", rare).first().words == ["rare", "zebra"]
    items = spark.createDataFrame([("a", "who", "plain"), ("b", "why", "odd")], "id string, question_type string, style string")
    strata = evalset.item_strata(items, spark.createDataFrame([("a", 0, 2), ("a", 1, 1)], "query_id string, target int, season int"), spark.createDataFrame([("a", 0.9), ("b", None)], "id string, overlap double"))
    got = {r.id: (r.seasons, r.targets, r.overlap) for r in strata.collect()}
    assert got == {"a": ([1, 2], "multi", "high"), "b": (None, None, "n/a")}
    counts = {(r.measure, r.value): r.n for r in evalset.distribution(strata, spans).collect()}
    assert counts["season", "1"] == 1 and counts["targets", "2"] == 1 and counts["span_rows", "7"] == 1 and counts["style", "odd"] == 1
    report = evalset.overlap_report(spark.createDataFrame([("who", 0.1, 1), ("who", None, 0)], "question_type string, overlap double, n_rare int")).first()
    assert (report.low, report.n_a, report.hooked) == (1, 1, 0.5)


def test_epsilon_keeps_frequent_terms(spark):
    docs = spark.createDataFrame([(i, "common" + (" odd" if i == 3 else f" w{i}")) for i in range(6)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "common")], "query_id long, text string")
    idf = [math.log(6 - n + 0.5) - math.log(n + 0.5) for n in (6, *[1] * 6)]
    got = retrieval.bm25_scores(docs, asked, Retrieval(epsilon=0.25)).collect()
    assert len(got) == 6 and got[0].score == pytest.approx(0.25 * sum(idf) / len(idf), abs=1e-9)


def test_retrievers(spark):
    docs = spark.createDataFrame([(i, f"w{i} shared", ["a" if i % 2 else "b"], i) for i in range(7)], "chunk_id long, text string, speakers array<string>, source_row_start long")
    vectors = retrieval.embed_words(docs, "chunk_id").join(docs.select("chunk_id", "speakers"), "chunk_id")
    asked = spark.createDataFrame([(1, "w3"), (2, "w4 w5")], "query_id long, text string")
    asked = asked.join(retrieval.embed_words(asked, "query_id"), "query_id")
    made = retrieval.build_retrievers(["bm25", "dense", "hybrid"], docs, vectors)
    for r in made.values():
        top = {x.query_id: x.chunk_id for x in r.search(asked, 3).filter("rank = 1").collect()}
        assert top[1] == 3 and top[2] in (4, 5)
    only = made["hybrid"].search(asked, 9, retrieval.Filters(speakers=("a",))).collect()
    assert {x.chunk_id for x in only} <= {1, 3, 5} and all(x.components for x in only)
    assert retrieval.result(made["bm25"].search(asked, 1), docs, text=False).first().source_row_start == 3
    exact = {(r.query_id, r.chunk_id): r.score for r in retrieval.dense_scores(vectors, asked, block=2).collect()}
    best = {(r.query_id, r.chunk_id): r.score for r in retrieval.dense_scores(vectors, asked, 2, block=3).collect()}
    assert len(exact) == 14 and all(exact[k] == pytest.approx(v, abs=1e-12) for k, v in best.items())
    with pytest.raises(ConfigurationError):
        retrieval.build_retrievers(["sparse"], docs)
    with pytest.raises(ArtifactError):
        retrieval.build_retrievers(["hybrid"], docs)


def test_reopened_and_report(spark):
    rows = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 2)], "csv_record long, season int, episode int")
    assert [r.csv_record for r in repair.reopened(rows, ["season", "episode"], "csv_record").orderBy("csv_record").collect()] == [3, 4]
    full = rows.withColumn("fixes", F.array(F.lit("unpacked_tuple_row"))).withColumn("filled", F.when(F.col("csv_record") == 1, "filled").otherwise("kept")).withColumn("reconstructed", F.col("csv_record") > 2)
    got = {r.fact: r.n for r in repair.load_report(full, rows.limit(0), rows.limit(2)).collect()}
    assert got == {"rows": 5, "failed": 0, "unresolved": 2, "unpacked_tuple_row": 5, "filled_episode_ids": 1, "reconstructed_source_row": 2}


def test_guard(spark):
    items = spark.createDataFrame([("1", "Who  is\nit?")], "id string, question string")
    with pytest.raises(HeldOutError):
        evalset.guard(items, spark.createDataFrame([("9", "who is it?")], "id string, question string"))


def test_percentile(spark):
    got = metrics.nearest_rank(spark.range(1, 11), [], "id", [0.1, 0.5, 0.9, 1.0]).first()
    assert tuple(got) == (1, 5, 9, 10)


def test_settings(tmp_path):
    assert Settings().validate()
    assert Chunking(settings=((10, 10),)).problems() and Retrieval(k1=0).problems() and Evaluation(ks=(5, 1)).problems()
    (tmp_path / "s.toml").write_text("[retrieval]\nk = 3\n")
    assert load_settings(tmp_path / "s.toml").retrieval.k == 3
    (tmp_path / "s.toml").write_text("[retrieval]\nnope = 3\n")
    with pytest.raises(ConfigurationError):
        load_settings(tmp_path / "s.toml")


def test_files(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(',Season,Episode,Speaker,Line,date_job\n1,1.0,1.0,A,"two\nlines, ""quoted""",x\n,,,,b,\n')
    got = files.read_raw_csv(spark, str(raw)).orderBy("csv_record").collect()
    assert [(r.season, r.text) for r in got] == [("1.0", 'two\nlines, "quoted"'), ("", "b")]
    raw.write_text("a,b\n1,2\n")
    with pytest.raises(CorpusError):
        files.read_raw_csv(spark, str(raw))
    aliases = tmp_path / "a.json"
    aliases.write_text(json.dumps({"global": [{"from": "Bob", "to": "Robert", "reason": "r"}], "episode_scoped": [{"from": "X", "to": "Y", "episodes": ["S1E2"]}]}, indent=1))
    scoped, everywhere = files.read_aliases(spark, str(aliases))
    assert [tuple(r) for r in scoped.collect()] == [(1, 2, "X", "Y")] and everywhere.count() == 1
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    files.save_chunks(chunks, str(tmp_path / "set"), {"size": 5})
    assert files.load_chunks(spark, str(tmp_path / "set"), {"size": 5}).count() == 1
    with pytest.raises(ArtifactError):
        files.load_chunks(spark, str(tmp_path / "set"), {"size": 6})
    with pytest.raises(ArtifactError):
        files.save_index(spark.createDataFrame([("c", [2.0])], "chunk_id string, vector array<float>"), str(tmp_path / "ix"), {}, 1)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "- Hi? - Yes. -")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert [r.clean_text for r in spark.table("cleaned").orderBy("part").collect()] == ["Hi?", "Yes."]


def test_cli(capsys):
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "/nowhere"]) == 2
