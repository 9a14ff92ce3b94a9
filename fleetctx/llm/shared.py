"""Helpers of the training-data operators: the shared folder, written cuts, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: ASCII white space as the contracts name it (space, tab to carriage return), as a Java regex class.
WS_CLASS = "[ \\x09-\\x0D]"
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and one machine does all the work."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster the operators need one that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fleetctx-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/fleetctx-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def veiled(df: DataFrame, *names: str) -> tuple:
    """df with its columns renamed by place, c0, c1, ..., so that none can clash with ours; and where the named ones are now."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), *[f"c{df.columns.index(n)}" for n in names]


def unveiled(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, from a frame made of its veiled form."""
    return df.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(like.columns)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def lowered(word: Column) -> Column:
    """A-Z in lower case; lower() is cheaper but only right for ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def with_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right on (doc_id, th); a null doc_id meets a null."""
    right = right.withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    return left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left["th"] == right["__th"]), how).drop("__id", "__th")


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right by sorting and merging, whatever their sizes: for sides that grow with the input.

    Spark takes a written cut for as small as its files, which hold repeated numbers in a bit or two, and would build tables of
    their many rows in the driver, several at once.
    """
    return left.hint("merge").join(right, on, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links of long nodes -> (node, root): the smallest node reachable, for every node that has a link.

    Each round every node takes the least root among itself and its neighbours, then roots are
    followed one step (pointer jumping), so rounds grow with the logarithm of the longest path.
    Rounds are written to the shared folder; only whether one changed a root reaches the driver.
    """
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "cc-0")
    for k in count(1):
        near = merged(both, label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = merged(label, near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = merged(step, jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        after = materialize(step, f"cc-{k}")
        changed = not after.where("root <> old").isEmpty()
        discard(label)
        label = after.select("node", "root")
        if not changed:
            break
    discard(both)
    return label
