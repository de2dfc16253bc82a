"""Queries of readers, extraction jobs and streams, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators import features as FE
from rivalry.plans.base import Registry, scratch
from rivalry.plans.models import elo_sql
from rivalry.plans.scoring import DIFF, PLAIN, diff_rows
from rivalry.sources import pages as P
from rivalry.sources import tables as T
from rivalry.streaming import jobs as J

R = Registry()
CSV_COLS = [f.name for f in T.CONTEST]
CSV_SQL = f"SELECT {', '.join(CSV_COLS)} FROM {{contests}}"


def csv_round_trip(v) -> DataFrame:
    k = v("contests").select(*CSV_COLS)
    path = scratch(k.sparkSession, "contests-csv")
    T.write_csv(k, path, ["d", "contest_id"])
    return T.read_contests_csv(k.sparkSession, path)


R.add("read_contests_csv", csv_round_trip, CSV_SQL)


def multi_season(v) -> DataFrame:
    k = v("contests").select(*CSV_COLS)
    path = scratch(k.sparkSession, "seasons")
    wrong = F.when(F.col("contest_id") % 1000 == 0, F.col("season") + 1).otherwise(F.col("season"))
    named = k.select(*[(wrong if c == "season" else F.col(c)).alias("row_season" if c == "season" else c) for c in CSV_COLS], "season")
    named.write.partitionBy("season").option("header", True).csv(path)
    return T.read_multi_season(k.sparkSession, path)[1].select("contest_id", "season", "row_season")


R.add("read_multi_season", multi_season, "SELECT contest_id, season, season + 1 AS row_season FROM {contests} WHERE contest_id % 1000 = 0")


def nullable(v) -> DataFrame:
    s = v("schedule_rev").where("rev = 2").select("fixture_key", "d", "status", "score")
    path = scratch(s.sparkSession, "revision")
    s.write.option("header", True).csv(path)
    return T.read_nullable_revision(s.sparkSession, path)


R.add("read_nullable_revision", nullable, "SELECT fixture_key, d, status, score FROM {schedule_rev} WHERE rev = 2")
R.add(
    "published_subset_agrees",
    lambda v: T.published_subset_agrees(v("schedule_rev").where("rev = 2").drop("rev"), v("schedule_rev").where("rev = 2 and status = 'completed' and fixture_key % 100 <> 0").select("fixture_key", "d", F.when(F.col("fixture_key") % 77 == 0, 9).otherwise(F.col("score")).alias("score"))),
    """WITH c AS (SELECT fixture_key, d, score FROM {schedule_rev} WHERE rev = 2 AND status = 'completed') SELECT *, 'schedule' AS only_in FROM c WHERE fixture_key % 100 = 0 OR fixture_key % 77 = 0
UNION ALL SELECT fixture_key, d, 9, 'completed' FROM c WHERE fixture_key % 77 = 0 AND fixture_key % 100 <> 0""",
)
R.add("read_safe_projection", lambda v: T.read_safe_projection(v("schedule_rev").where("rev = 2"), ["fixture_key", "d", "status"]), "SELECT fixture_key, d, status FROM {schedule_rev} WHERE rev = 2")


def feed(v) -> DataFrame:
    s = v("schedule_rev").where("rev = 2").withColumn("competition", (F.col("fixture_key") % 3).cast("string"))
    cols = ["competition", "fixture_key", "d", "status"]
    return T.json_feed(FE.previous_batch(s).select(*cols), FE.next_batch(s).select(*cols))


R.add("export_json_feed", feed)
R.add(
    "html_table_extract_job", lambda v: P.html_table_rows(v("pages")).select("page_id", "table_no", "row_no", F.posexplode("cells").alias("cell_no", "cell")),
    r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t FROM {pages}), i AS (SELECT page_id, t, unnest(range(0, len(t))) AS row_no FROM x)
SELECT page_id, 0 AS table_no, CAST(row_no AS INT) AS row_no, 0 AS cell_no, replace(replace(replace(replace(t[row_no + 1], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS cell FROM i""",
)
R.add(
    "html_event_extract_job", lambda v: P.commented_sections(v("pages")),
    r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<!--\s*(\w+)\s+(\d+)\s*-->\s*<[^>]*>([^<]*)', 1) AS k, regexp_extract_all(html, '<!--\s*(\w+)\s+(\d+)\s*-->\s*<[^>]*>([^<]*)', 2) AS n, regexp_extract_all(html, '<!--\s*(\w+)\s+(\d+)\s*-->\s*<[^>]*>([^<]*)', 3) AS t FROM {pages}),
i AS (SELECT *, unnest(range(0, len(k))) AS s FROM x) SELECT page_id, CAST(s AS INT) AS section_no, k[s + 1] AS kind, CAST(n[s + 1] AS BIGINT) AS number, trim(t[s + 1]) AS text FROM i""",
)
def live():
    """A page with a state object in a script and a sentence about the result."""
    return F.concat(
        F.coalesce("html", F.lit("")), F.lit("<script>var s="), F.to_json(F.struct(F.col("page_id").alias("home"), F.struct((F.col("page_id") % 5).alias("home_score"), F.substring_index("url", "?", 1).alias("url")).alias("score"))),
        F.lit(";</script><p>"), F.when(F.col("page_id") % 9 != 0, F.concat(F.lit("Full time: "), F.col("page_id") % 5, F.lit("-"), F.col("page_id") % 4, F.lit(". xG "), F.round((F.col("page_id") % 30) / 10, 1), F.lit("-1.5"))).otherwise("Postponed."), F.lit("</p>"),
    )


R.add(
    "embedded_json_extract_job",
    lambda v: P.embedded_json(v("pages").select("page_id", live().alias("html")), "page_id", "html", r"var s=(\{.*\});", {"home": "$.home", "total": "$.score.home_score", "url": "$.score.url"}),
    "SELECT page_id, CAST(page_id AS VARCHAR) AS home, CAST(page_id % 5 AS VARCHAR) AS total, split_part(url, '?', 1) AS url FROM {pages}",
)
R.add(
    "text_summary_extract_job", lambda v: P.text_summary(v("pages").select("page_id", F.element_at(F.split(live(), "</script>"), -1).alias("text")), "page_id", "text"),
    "SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN CAST(page_id % 5 AS INT) END AS home_score, CASE WHEN page_id % 9 <> 0 THEN CAST(page_id % 4 AS INT) END AS away_score, CASE WHEN page_id % 9 <> 0 THEN (page_id % 30) / 10.0::DOUBLE END AS home_xg, CASE WHEN page_id % 9 <> 0 THEN 1.5::DOUBLE END AS away_xg FROM {pages}",
    ["home_xg", "away_xg"],
)


def run_diff(v) -> DataFrame:
    """Both revisions arrive in pieces that mix their rows, a file for each piece and two files to a micro-batch."""
    s = v("schedule_rev").select("rev", "fixture_key", "d", "status", F.col("score").cast("long").alias("score"))
    s = s.join(F.broadcast(s.groupBy("rev").agg(F.count("*").alias("rev_rows"))), "rev")
    spark, path = s.sparkSession, scratch(s.sparkSession, "diff-stream")
    s.repartition(6, "fixture_key").write.parquet(f"{path}/in")
    J.stream_snapshot_diff(spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), path, size="rev_rows").trigger(availableNow=True).start().awaitTermination()
    return J.snapshot_events(spark, path).where("rev = 2").drop("rev")


R.add("stream_snapshot_diff", run_diff, f"WITH {DIFF} {diff_rows(PLAIN)}")


def run_ratings(v) -> DataFrame:
    """Two runs of one stream: the contests up to 1995, then the later ones and a closing row for each pool."""
    k = v("contests_strict").select(F.col("competition").alias("pool"), "contest_id", F.col("d").cast("timestamp").alias("ts"), "home", "away", "result", "season")
    spark, path = k.sparkSession, scratch(k.sparkSession, "rating-stream")
    end = (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")
    close = k.select("pool").distinct().crossJoin(F.broadcast(k.agg(end)))
    for rows in (k.where("season <= 1995"), k.where("season > 1995"), k.limit(0).unionByName(close, allowMissingColumns=True)):
        rows.drop("season").write.mode("append").parquet(f"{path}/in")
        rated = J.stream_ratings(spark.readStream.schema(k.drop("season").schema).parquet(f"{path}/in"))
        rated.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(J.RATED).parquet(f"{path}/out").drop("d")


R.add(
    "stream_ratings", run_ratings, f"WITH {elo_sql()} SELECT rt.pool, rt.contest_id, home_rating, away_rating, false AS late FROM rt", ["home_rating", "away_rating"],
)
