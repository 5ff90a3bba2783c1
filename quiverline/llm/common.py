"""Shared plumbing of the training-data operators: durable tables and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.  No other folder can stand in for it on a cluster;
    where Spark runs in one process, a temporary one can."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quiverline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quiverline/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _write(df: DataFrame, path: str, dictionary: bool = True) -> None:
    """Write Parquet and let Spark drop the shuffle files of this one job when it ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
    except Exception:  # an engine without the setting keeps its shuffle files until they are collected
        before = "absent"
    try:
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        elif before != "absent":
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Cut the lineage: write `df` under the shared folder and read it back.

    A lost executor then costs no more than the tasks it ran; the table itself outlives every executor.  Tables of hashes
    are written without a dictionary, which would cost more than it saves.
    """
    path = new_path(df.sparkSession, name)
    _write(df, path, dictionary)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that `materialise` made, once nothing reads them any more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, folder)


class Scratch:
    """Durable tables of one iteration, dropped as soon as the next one is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        _write(df, path)
        if self.last:
            drop_path(self.spark, self.last)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over `edges(a, b)`, for every node that has an edge.

    Alternating large-star and small-star rounds.  Each round is two aggregations by minimum (combined before
    the shuffle, so a hub costs one row per task) and two joins that AQE may split; no node's neighbours are
    ever gathered.  Rounds grow with the logarithm of the number of nodes.  Self-loops and nulls are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "cc")
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    cur = scratch.put(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        )
        nxt = small.select("e.u", "e.v").where("u <> v").distinct()
        cur = scratch.put(nxt)
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
