"""Queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from dialoom.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Enough to touch every module; the driver compares all of them on a larger scale.
CHOSEN = [
    "text_whitespace", "text_ocr_caps_l", "split_turns", "rule_summary", "bm25_topk", "bm25_filtered", "dense_filtered", "hybrid_filtered", "fill_missing_ids", "assign_source_rows", "multi_speaker",
    "scene_boundaries", "chunk_pack_64_8", "chunk_neighbors", "find_quote", "quote_status", "span_relevance", "hit_recall_mrr", "average_by_type", "outcome_buckets", "heldout_guard", "content_fingerprint", "type_quotas", "imbalance", "choose_dev", "hybrid_topk", "lexical_overlap", "nearest_rank_percentile", "scored_text", "shared_rare_words", "item_strata", "distribution", "overlap_report", "check_spans",
]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_equal(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, wanted = queries()[name](spark, SF), con.sql(oracle_sql()[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert plain(frame.collect(), frame.columns) == plain(wanted.fetchall(), wanted.columns)
