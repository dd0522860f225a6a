"""What must hold for the physical plans at any size."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        entry.queries()[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["hydrate_metadata", "appendix_pool", "report_has_item", "not_selected", "anti_history", "history_fresh"])
def test_no_pairwise_joins(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["top_k_per_source", "display_sort", "history_fresh"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_whole_ranking_is_one_distributed_top_k(spark):
    text = plan(spark, "deduplicate_and_rank")
    assert "TakeOrderedAndProject" in text and "Exchange SinglePartition" not in text
    # both de-dup steps combine on the map side
    assert text.count("partial_max_by") >= 2


def test_dedup_reads_documents_once(spark):
    text = plan(spark, "dedup_items")
    assert text.count("documents.parquet") == 1
    assert "text" in text and "n_chars" not in text.split("ReadSchema")[1].splitlines()[0]
