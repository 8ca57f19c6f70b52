"""Where the operators write: a shared folder, never an executor's own disk."""

import pytest

from lodeseek.llm import common
from tests.test_operators import FakeSession


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master, monkeypatch):
    monkeypatch.setattr(FakeSession.sparkContext, "master", master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(FakeSession)


def test_tables_are_dropped(spark):
    t = common.cut(spark.range(10).toDF("x"), "dropped")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(t.lodeseek_path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(jpath) and spark.sparkContext.applicationId in t.lodeseek_path
    common.drop_table(t, spark)
    assert not fs.exists(jpath)
