"""The whole job over bundles of two runs; what a run has seen is known to the next one."""

import json
from datetime import datetime

import pytest
from briefloom.operators import history as hist
from briefloom.plans.reports import build_reports
from briefloom.session import checkpoint_root
from briefloom.sources.tables import read_bundle
from pyspark.sql import functions as F

def now():
    return F.lit(datetime(2025, 11, 20, 9)).cast("timestamp")

HISTORY = "category string, fingerprint string, seen_at timestamp, pos bigint"


def story(n, **more):
    """A story of its own kind and day; every fifth comes from a repository."""
    kinds = ("official_news", "news", "research", "news", "github_repo")
    return {
        "title": f"Model release {n} of the agent series", "url": f"https://lab{n}.example.org/posts/{n}?utm_medium=x", "desc": f"Weights and notes of release {n}.",
        "source_name": f"Lab {n % 4}", "source_type": kinds[n % 5], "published_at": f"2025-11-{14 + n % 6:02d}T0{n % 10}:00:00Z", **more,
    }


def bundle(first, count):
    return {
        "us_stocks": [{"symbol": "ZZT", "price": 41.5, "change": "-0.75", "range": "40.1-43.0", "source": "own"}, {"symbol": "QRX", "price": None, "change": "no number", "range": "wide", "source": "own"}],
        "tw_stocks": [],
        "stock_news": [
            {"title": "晶片廠擴大產能", "url": "https://paper.example.org/x/1", "desc": "產能 &#9999999; 與 &eacute;", "source_name": "Paper", "source_type": "news", "published_at": "2025-11-19"},
            {"title": None, "url": None, "desc": None, "source_name": None, "source_type": None, "published_at": "yesterday"},
        ],
        "ai_news": [story(n) for n in range(first, first + count)],
    }


@pytest.fixture
def runs(spark, tmp_path):
    for name, content in (("one", bundle(0, 30)), ("two", bundle(100, 4))):
        (tmp_path / f"{name}.json").write_text(json.dumps(content, ensure_ascii=False))
    return read_bundle(spark, str(tmp_path / "*.json"))


def test_two_runs_end_to_end(spark, runs):
    items, quotes = runs
    out = build_reports(items, quotes, now(), history=spark.createDataFrame([], HISTORY))
    reports = {r.report_id.split("/")[-1]: r for r in out["report"].collect()}
    assert set(reports) == {"one.json:ai", "one.json:stock", "two.json:ai", "two.json:stock"}
    shown = out["report_item"].groupBy("report_id").count().collect()
    assert all(r["count"] > 0 for r in shown if r.report_id.endswith(":ai"))
    messages = [r.description for r in out["message"].collect() if r.report_id.endswith(":stock")]
    assert len(messages) == 2 and all("ZZT" in m for m in messages)
    blocks = out["block"].collect()
    assert max(b.pos for b in blocks) <= 100 and {"heading_2", "divider"} <= {b.type for b in blocks}


def test_every_fresh_row_is_remembered(spark, runs):
    items, quotes = runs
    one = items.filter(F.col("run_id").endswith("one.json") & (F.col("category") == "ai_news"))
    known = build_reports(one, quotes, now(), history=spark.createDataFrame([], HISTORY))
    assert known["fresh"].count() < 30  # the quotas take a part
    assert known["history"].filter("category = 'ai_news'").count() == 30
    fingerprints = known["history"].select("category", "fingerprint")
    assert hist.active_history(known["history"], now(), 26, 2000).join(fingerprints, ["category", "fingerprint"], "left_anti").count() == 0


def test_durable_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        checkpoint_root(Session)
