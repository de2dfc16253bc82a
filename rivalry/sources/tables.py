"""Strict readers and deterministic writers of contest tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.core.asof import appearances, forbid

CONTEST = T.StructType([
    T.StructField(n, t) for n, t in (
        ("contest_id", T.LongType()), ("d", T.DateType()), ("season", T.IntegerType()), ("home", T.LongType()), ("away", T.LongType()),
        ("competition", T.StringType()), ("place", T.IntegerType()), ("home_score", T.IntegerType()), ("away_score", T.IntegerType()), ("result", T.IntegerType()),
    )
])
SCHEDULE = T.StructType([T.StructField(n, t) for n, t in (("fixture_key", T.LongType()), ("d", T.DateType()), ("status", T.StringType()), ("score", T.LongType()))])


def read_contests_csv(spark: SparkSession, path: str, schema: T.StructType = CONTEST) -> DataFrame:
    """Fixed schema, no inference, header names checked, a malformed row fails the job; a byte order mark is allowed."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("dateFormat", "yyyy-MM-dd").option("encoding", "UTF-8").csv(path)


def read_multi_season(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Yearly folders season=<year> in one read; and the rows whose season differs from their folder's."""
    # the folder's name wins over the column in files, so the column is read under another name
    fields = [T.StructField("row_season" if f.name == "season" else f.name, f.dataType) for f in CONTEST]
    reader = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    rows = reader.csv(path).withColumn("season", F.regexp_extract(F.col("_metadata.file_path"), r"season=(\d+)", 1).cast("int"))
    return rows.drop("row_season"), rows.where(~F.col("season").eqNullSafe(F.col("row_season")))


def read_nullable_revision(spark: SparkSession, path: str, schema: T.StructType = SCHEDULE) -> DataFrame:
    """A schedule with empty cells as nulls, typed by schema."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def published_subset_agrees(schedule: DataFrame, completed: DataFrame, status: str = "completed") -> DataFrame:
    """Rows that only the filtered schedule or only the completed table has, with multiplicity; none if they agree."""
    own = schedule.where(F.col("status") == status).select(*completed.columns)
    return own.exceptAll(completed).withColumn("only_in", F.lit("schedule")).union(completed.exceptAll(own).withColumn("only_in", F.lit("completed")))


def read_safe_projection(rows: DataFrame, allowed: Sequence[str], outcomes: Sequence[str] = ("home_score", "away_score", "result", "score")) -> DataFrame:
    """Identity and status columns only; asking for an outcome fails. The scan reads only these columns."""
    return forbid(rows.select(*allowed), outcomes)


def write_csv(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted rows with header; the same rows give the same bytes per part."""
    rows.orderBy(*order).write.option("header", True).option("dateFormat", "yyyy-MM-dd").mode("overwrite").csv(path)


def export_ratings(ratings: DataFrame, contests: DataFrame, path: str) -> DataFrame:
    """Write (pool, e, rating, last_date, played) as sorted CSV, and read it again; ratings: replay(final=True) of contests."""
    told = appearances(contests).groupBy(F.col("competition").alias("pool"), "e").agg(F.max("d").alias("last_date"), F.count("*").alias("played"))
    write_csv(ratings.join(told, ["pool", "e"]).select("pool", "e", "rating", "last_date", "played"), path, ["pool", "e"])
    return ratings.sparkSession.read.schema("pool string, e long, rating double, last_date date, played long").option("header", True).csv(path)


def json_feed(past: DataFrame, coming: DataFrame, by: str = "competition") -> DataFrame:
    """One JSON document per group with its previous and next batch as ordered arrays; batches are a date's rows only."""
    def pack(df, name):
        body = F.struct(*[c for c in df.columns if c != by])
        return df.groupBy(by).agg(F.array_sort(F.collect_list(body)).alias(name))

    j = pack(past, "previous").join(pack(coming, "next"), by, "full")
    return j.select(by, F.to_json(F.struct(by, "previous", "next")).alias("feed"))
