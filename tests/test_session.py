from types import SimpleNamespace

import pytest

from twinscript import session


def fake(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    get = lambda key, default=None: settings.get(key, default)
    conf = SimpleNamespace(get=get)
    return SimpleNamespace(
        conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf)
    )


def test_the_cluster_names_the_folder():
    assert session.shared_folder(fake("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_a_local_session_keeps_one_folder():
    one = session.shared_folder(fake("local[2]"))
    assert one.startswith("/tmp/spark-") and session.shared_folder(fake("local[2]")) == one


def test_staged_rows_are_read_from_files(spark):
    df = session.staged(spark.range(5).withColumnRenamed("id", "n"))
    assert df.count() == 5 and len(df.inputFiles()) > 0
    assert df.schema.names == ["n"]


def test_small_tables_start_no_job(spark):
    df = session.small_table(spark, [("a", None), ("b", 2.5)], "s string, d double")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("a", None), ("b", 2.5)]
    assert session.small_table(spark, [], "s string").count() == 0


def folders(*stages):
    return [s.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for s in stages]


def test_dropped_stages_leave_no_folder(spark):
    import os

    one, two, three = (session.staged(spark.range(n)) for n in (1, 2, 3))
    with session.owned_stages("owner"):
        mine = session.staged(spark.range(4))
    paths = folders(one, two, three, mine)
    session.drop_stage(one)
    assert [os.path.exists(p) for p in paths] == [False, True, True, True]
    session.drop_stage(one)  # gone already
    session.drop_stages(spark, owner="owner")
    assert [os.path.exists(p) for p in paths] == [False, True, True, False]
    # What a DataFrame still reads stays.
    session.drop_stages(spark, three.filter("id > 0"))
    assert [os.path.exists(p) for p in paths] == [False, False, True, False]
    assert three.count() == 3
    session.drop_stages(spark)
    assert not os.path.exists(paths[2])


def test_a_stage_in_the_catalog_goes_with_its_table(spark):
    import os

    path = session.scratch_path(spark, "table")
    spark.range(3).write.option("path", path).saveAsTable("stage_in_the_catalog")
    session.stage_table(spark, "stage_in_the_catalog", path)
    session.drop_stages(spark, spark.range(1))
    assert not os.path.exists(path) and not spark.catalog.tableExists("stage_in_the_catalog")
