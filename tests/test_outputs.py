import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from briefloom.operators import aggregates, items as it
from briefloom.sources.tables import write_run
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


def test_run_output_replaces_its_own_date(spark, tmp_path):
    for day, n in (("2026-04-11", 3), ("2026-04-12", 2), ("2026-04-11", 1)):
        write_run({"block": spark.range(n)}, str(tmp_path), day)
    found = spark.read.parquet(str(tmp_path / "block")).groupBy("run_date").count()
    assert {str(r.run_date): r["count"] for r in found.collect()} == {"2026-04-11": 1, "2026-04-12": 2}


def test_counters_ride_along(spark):
    rows = [(1, "A new model release", "https://e.com/1", "d", "s", "news", "2026-04-11"), (2, "A lawsuit", "https://e.com/2", "d", "s", "news", None)]
    raw = spark.createDataFrame(rows, "seq bigint, title string, url string, `desc` string, source_name string, source_type string, published_at_raw string")
    watched, seen = aggregates.observe_counts(it.normalize_items(raw), "run")
    watched.select(F.count(F.lit(1))).collect()
    assert seen.get == {"raw_count": 2, "irrelevant_dropped": 1, "undated": 1}


@pytest.mark.parametrize("name", ["url_canonical", "parse_dates", "title_keys", "top_k_large", "history_skipped", "year_rollback"])
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
