import pytest
from pyspark.sql import functions as F

from quillon.llm import shared


def test_cut_and_drop(spark):
    df = shared.cut(spark.range(10).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 10 and df.columns == ["id", "x"]
    (folder,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    shared.drop(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, at):
            self.at = at

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.at or default

    class Session:
        class sparkContext:
            applicationId, master = "app", "spark://host:7077"

        def __init__(self, at):
            self.conf = Conf(at)

    assert shared.shared_dir(Session("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session(None))
