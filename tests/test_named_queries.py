"""Every named query against its SQL on the smallest sample tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import differences, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, con, entry.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clusters_cover_every_review(spark):
    clusters = entry.queries()["review_clusters"](spark, SF_DIR).persist()
    reviews = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert clusters.select("review_id").distinct().count() == clusters.count() == reviews.count()
    per_cluster = clusters.groupBy("business_url", "cluster_id")
    assert per_cluster.agg({"cluster_label": "count"}).count() == (
        clusters.select("business_url", "cluster_id", "cluster_label").distinct().count()
    )
    clusters.unpersist()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
