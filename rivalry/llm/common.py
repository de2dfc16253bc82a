"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: The scopes that the thread is in.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())

#: Tables up to so many bytes may be broadcast; their size is measured first.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one serves local runs (tests) only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="rivalry-shared-"))
    return _OWN_DIR[0]


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, inside the shared one."""
    return "/".join([shared_dir(spark), f"rivalry-{spark.sparkContext.applicationId}", *_SCOPES.get()])


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end. Results must have been written elsewhere by then."""
    token = _SCOPES.set((*_SCOPES.get(), uuid.uuid4().hex))
    try:
        yield
    finally:
        clear_scratch(spark)
        _SCOPES.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends there, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, or inside scratch_scope those of the scope. Frames that still read them fail afterwards."""
    delete_folder(spark, scratch_dir(spark))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs whose id is not in the one column of ids; null ids stay."""
    key = fresh(docs, "gone")
    return docs.join(ids.toDF(key).distinct(), F.col(id_col) == F.col(key), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) per vertex, component being the smallest id.

    Alternating large-star and small-star rounds. Each round is one aggregation and one join on the edge
    list, and its edges are written to the shared folder. The rounds end when the edges are the same, by their
    number and two sums of 64-bit hashes. No edges give no rows; an edge with a null end is left out.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), name)
    last = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        edges = written(
            small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct(), name
        )
        now = edges.agg(F.count("*"), *[F.sum(F.xxhash64("a", "b", F.lit(s)).cast("decimal(20, 0)")) for s in (1, 2)]).first()
        if now == last:
            break
        last = now
    lows = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return lows.union(edges.select("b", "b")).distinct()
