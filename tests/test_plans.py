"""Scale properties of the physical plans (static plans, AQE off so they are fully visible)."""

import pytest

from conftest import SMALL
from slicewise.plans import catalog


@pytest.fixture()
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunking_is_map_side(static):
    for q in ("chunk_lines_1000_200", "chunk_recursive_150_15"):
        plan = _plan(catalog.QUERIES[q](static, SMALL))
        exchanges = [ln for ln in plan.split("\n") if "Exchange" in ln]
        # only the optional `spread` repartition of a single-split input may appear
        assert len(exchanges) <= 1 and all("REPARTITION_BY_NUM" in ln for ln in exchanges)


def test_knn_top_k_is_limited_before_the_shuffle(static):
    plan = _plan(catalog.QUERIES["knn_exact_k8"](static, SMALL))
    lines = plan.split("\n")
    limits = [i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln]
    ex = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning(query_id" in ln]
    assert len(limits) == 2 and len(ex) == 1 and limits[0] < ex[0] < limits[1]
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_chunk_document_cosine_shuffles_no_tokens(static):
    plan = _plan(catalog.QUERIES["chunk_vs_original_cosine"](static, SMALL))
    exchanges = [ln for ln in plan.split("\n") if "Exchange hash" in ln]
    # one exchange of per-collection sums; the other may deal a small corpus to all cores
    assert len([ln for ln in exchanges if "hashpartitioning(collection" in ln]) == 1
    assert all("hashpartitioning(collection" in ln or "REPARTITION_BY_NUM" in ln for ln in exchanges)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_release_materialised_tables(spark):

    from slicewise.session import cut_lineage, release_tables
    t = cut_lineage(spark.range(10))
    assert t.count() == 10
    assert release_tables(spark) >= 1


def test_batch_search_is_limited_before_the_shuffle(static):
    """k is a column of the batch's settings; its largest value limits the candidates of every task."""
    from slicewise.plans import experiment_batch
    from slicewise.sources import testdata
    from slicewise.sources.tables import strategies_table
    b = experiment_batch.Batch()
    experiment_batch.run(static, testdata.corpus(static, SMALL), testdata.file_types(static, SMALL), strategies_table(static),
                         testdata.experiments(static, SMALL), testdata.qa_pairs(static, SMALL), b, stop_after="retrieval")
    lines = _plan(b.frames["search"]).split("\n")
    limits = [i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln]
    ex = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning(query_id" in ln]
    assert len(limits) == 2 and len(ex) == 1 and limits[0] < ex[0] < limits[1]
    assert b.release(static) > 5 and not b.tables


def test_spread_only_when_too_few_splits(spark, monkeypatch):
    from slicewise.functions import sizing
    from slicewise.functions.sizing import spread
    few = spark.range(100).coalesce(1)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism * 2)
    assert spread(many, "id") is many
    monkeypatch.setattr(sizing, "SPREAD_BYTES", 100)          # a large table keeps its splits, however few
    assert spread(few, "id") is few
