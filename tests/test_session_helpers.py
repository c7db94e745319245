"""Session helpers and the one-pass cluster indices."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sentimetry.operators import measures as M
from sentimetry.sources import sinks as K
from sentimetry.session import bounded_broadcast, inherit_bound, mark_bounded, materialize, shared_dir


def test_bounds_and_broadcast(spark):
    small = mark_bounded(spark.createDataFrame([(1,), (2,)], "x int"), 2)
    derived = inherit_bound(small.where("x > 1"), small)
    plan = spark.range(5).join(bounded_broadcast(derived), F.col("id") == F.col("x"))
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString() or \
        "broadcast" in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    # without a proven bound, or above it, no hint is given and no job runs
    assert bounded_broadcast(big := spark.range(10)) is big
    assert bounded_broadcast(small, max_rows=1) is small


def test_materialize_cuts_lineage(spark):
    df = spark.range(50).withColumn("y", F.col("id") * 2)
    m = materialize(df)
    assert m.count() == 50 and m.dtypes == df.dtypes
    assert m.inputFiles()[0].startswith("file:") and shared_dir(spark) in m.inputFiles()[0]


def test_materialize_writes_zstd(spark):
    m = materialize(spark.range(50).withColumn("y", (F.col("id") % 3).cast("int")), by="y")
    kinds = {pq.ParquetFile(f.removeprefix("file:")).metadata.row_group(0).column(0).compression for f in m.inputFiles()}
    assert kinds == {"ZSTD"} and m.count() == 50 and m.where("y = 1").count() == 17


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


class _Session:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId = master, f"app-{master}"

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return None


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(_Session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(_Session("local-cluster[2,1,1024]"))
    local = _Session("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_a_repeated_write_replaces_the_first(spark):
    K.write_and_read(spark, spark.range(10), "again")
    assert K.write_and_read(spark, spark.range(3), "again").count() == 3


def test_cluster_globals_one_pass(spark):
    d = dt.date(2020, 1, 1)
    m = spark.createDataFrame([(d, "A", "x", "t", 1.0), (d, "A", "y", "t", 3.0), (d, "B", "x", "t", 5.0)],
                              "date date, lexicon string, feature string, time string, value double")
    g = {r["cluster"]: r["global"] for r in M.cluster_globals(m, {"c1": (["A"], ["x", "y"]),
                                                                  "c2": (["A", "B"], ["x"])}).collect()}
    assert g == {"c1": pytest.approx(2.0), "c2": pytest.approx(3.0)}
