"""Plan properties of the registered queries (what holds at scale):
no cartesian / nested-loop joins anywhere, partial aggregation and partial
window limits where a hot key could otherwise land in one task, pruned
scans."""
import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: _plan(q(spark, SF_SMALL)) for n, q in entry.queries().items()}


def test_no_cartesian_or_nested_loop(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p]
    assert bad == []


@pytest.mark.parametrize("name", ["history_last_n", "history_last_2"])
def test_last_n_uses_partial_window_limit(plans, name):
    p = plans[name]
    assert p.count("WindowGroupLimit") >= 2          # partial before the shuffle, final after


@pytest.mark.parametrize("name", ["corpus_stats", "length_histogram_fr", "type_counts",
                                  "file_distribution", "keyword_count", "page_summary"])
def test_aggregates_are_partial(plans, name):
    assert "partial_" in plans[name]


def test_single_query_topk_plans(plans):
    # one query vector: scored in Arrow batches, merged by TakeOrderedAndProject
    assert "MapInArrow" in plans["topk_cosine"] and "TakeOrderedAndProject" in plans["topk_cosine"]
    assert "TakeOrderedAndProject" in plans["keyword_search"]


def test_batch_topk_scores_in_arrow_batches(plans):
    for n in ["topk_batch", "topk_l2", "sources", "text_search_hashed", "ann_topk"]:
        assert "FlatMapCoGroupsInArrow" in plans[n], n


@pytest.mark.parametrize("name", ["topk_batch", "topk_l2"])
def test_query_sets_do_not_pass_through_the_driver(spark, name, monkeypatch):
    """Building and planning the query collects nothing and broadcasts nothing by hand."""
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def refuse(*a, **k):
        raise AssertionError("rows reached the driver")
    for m in ("collect", "toArrow", "toPandas", "toLocalIterator", "first", "head", "take", "count"):
        monkeypatch.setattr(Classic, m, refuse)
    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    assert "FlatMapCoGroupsInArrow" in _plan(entry.queries()[name](spark, SF_SMALL))


def test_scans_are_pruned(plans):
    # the statistics never read lang-independent columns they do not need
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" not in plans["keyword_count"]
    assert "n_chars" not in plans["chunk_documents"]
    assert "label" not in plans["topk_batch"].split("ReadSchema")[1].split("\n")[0]


def test_package_is_shipped_to_workers(spark):
    from ragtide.session import ship_package
    ship_package(spark)
    ship_package(spark)                      # once per context
    incs = [p for p in spark.sparkContext._python_includes if p.endswith("ragtide.zip")]
    assert len(incs) == 1


def test_recommended_conf_sizes_partitions():
    from ragtide.session import recommended_conf
    c = recommended_conf(100 * 10 ** 12, 8000)
    assert int(c["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 * 1024
    assert int(c["spark.sql.shuffle.partitions"]) == 37253
    assert int(recommended_conf(10 ** 6, 8)["spark.sql.shuffle.partitions"]) == 16
    assert "spark.checkpoint.dir" not in c


@pytest.mark.parametrize("name", ["keyword_search", "table_preview", "recent_rows"])
def test_bounded_results_do_not_number_the_corpus(plans, name):
    # numbering the whole corpus would join id offsets back to the documents
    p = plans[name]
    assert "BroadcastHashJoin" not in p and "SortMergeJoin" not in p and "ShuffledHashJoin" not in p


@pytest.mark.parametrize("name", ["chunk_documents", "keyword_batch", "text_search_hashed"])
def test_full_numbering_joins_offsets_by_broadcast(plans, name):
    # the offsets travel, not the chunks' text
    assert "BroadcastHashJoin" in plans[name]
    assert "SortMergeJoin" not in plans[name] and "ShuffledHashJoin" not in plans[name]
