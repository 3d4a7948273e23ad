"""Driver contract, a sample of DuckDB oracle comparisons at sf0.001, and
batch = stream equality."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as ent
from ledgerline.sources.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"
SAMPLE = ["rfm_segments", "basket_itemsets", "basket_rules", "basket_summary", "price_strategy", "eoq_reorder",
          "budget_greedy", "delay_prediction", "route_distance", "supply_dashboard", "sort_by_metric", "sort_multi",
          "last_n_per_key", "sentiment_lexicon", "emotion_scores", "mixed_sentiment", "aspect_sentiment", "extract_skills",
          "categorize_skills", "extract_education", "extract_experience_years", "required_vs_found", "skills_from_job",
          "cv_topn", "profile_columns", "eda_describe", "distinct_count", "detect_target_binary", "detect_basket_columns",
          "regression_metrics", "roc_auc", "quantile_agg", "gap_rows", "scan_csv", "scan_csv_sniff", "scan_csv_skip_bad",
          "sink_jsonl_append", "null_to_blank", "split_columns", "anomaly_report", "stream_rate_window"]


def _norm(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert "segment" in df.columns


def test_every_oracle_has_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sdf = ent.queries()[name](spark, SF)
    res = con.execute(ent.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(ocols, res.fetchall())


def test_stream_equals_batch(spark):
    s = ent.queries()["stream_sentiment"](spark, SF)
    b = ent.queries()["sentiment_lexicon"](spark, SF)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.select(*s.columns).collect()))
