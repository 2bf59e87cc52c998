"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from panelworks.scale import cut_lineage, shared_folder


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_cluster_setting_is_used():
    assert shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"


def test_local_runs_keep_one_folder_of_their_own():
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_a_cluster_without_the_setting_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))


def test_cut_tables_keep_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id, id + 1) AS pair")
    again = cut_lineage(df, "test")
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect())
