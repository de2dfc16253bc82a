"""Aggregations, coverage reports and derived contest facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.core.asof import ID, appearances
from rivalry.functions.scalar import points
from rivalry.operators.sketches import LG, SKETCH_K, quantile


def contest_summary(contests: DataFrame, by: Sequence[str] = ("competition",)) -> DataFrame:
    """Counts, dates, results, entities and missing scores, by group and in total (group null)."""
    is_ = lambda r: F.count(F.when(F.col("result") == r, 1))
    return contests.rollup(*by).agg(
        F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), is_(2).alias("home_wins"), is_(1).alias("draws"),
        is_(0).alias("away_wins"), F.count_distinct("home").alias("home_entities"), F.count_distinct("season").alias("seasons"),
        F.count(F.when(F.col("home_score").isNull() | F.col("away_score").isNull(), 1)).alias("missing_scores"),
    )


def special_summary(contests: DataFrame, stage: str, stages: Sequence) -> DataFrame:
    """Totals of each entity, and its points in each stage as columns."""
    rows = appearances(contests, [stage]).withColumn("p", points("gf", "ga"))
    total = rows.groupBy("e").agg(F.count("*").alias("played"), F.sum("p").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    wide = rows.groupBy("e").pivot(stage, list(stages)).agg(F.sum("p"))
    return total.join(wide, "e")


def availability_by_period(features: DataFrame, home: Column, away: Column, period: str = "season") -> DataFrame:
    """Sides, pairs, only one and none available, by period and in total."""
    h, a = home.cast("int"), away.cast("int")
    return features.rollup(period).agg(
        F.count("*").alias("n"), F.sum(h + a).alias("sides"), F.sum(h * a).alias("pairs"), F.sum(F.abs(h - a)).alias("only_one"),
        F.sum((1 - h) * (1 - a)).alias("none"),
    )


def count_bin(x: Column, edges: Sequence[int] = (0, 1, 2, 3, 4, 5, 10)) -> Column:
    """Label of the bin of x: single values, then ranges, the last one open."""
    out = F.lit(None).cast("string")
    for i, lo in enumerate(edges):
        hi = edges[i + 1] - 1 if i + 1 < len(edges) else None
        label = f"{lo}+" if hi is None else str(lo) if hi == lo else f"{lo}-{hi}"
        out = F.when(x >= lo, label).otherwise(out)
    return out


def count_bins(df: DataFrame, column: str, edges: Sequence[int] = (0, 1, 2, 3, 4, 5, 10)) -> DataFrame:
    return df.groupBy(count_bin(F.col(column), edges).alias("bin")).agg(F.count("*").alias("n"))


def coverage_season_global(df: DataFrame, columns: Mapping[str, str], edges: Sequence[int] = (0, 1, 5)) -> DataFrame:
    """Bins of unpivoted side columns (side -> column), by season and in total."""
    pairs = ", ".join(f"'{s}', {c}" for s, c in columns.items())
    rows = df.select("season", F.expr(f"stack({len(columns)}, {pairs}) as (side, x)"))
    return rows.rollup("season").agg(*[F.count(F.when(count_bin(F.col("x"), edges) == b, 1)).alias(f"bin{i}") for i, b in enumerate(_labels(edges))])


def _labels(edges: Sequence[int]) -> list[str]:
    out = []
    for i, lo in enumerate(edges):
        hi = edges[i + 1] - 1 if i + 1 < len(edges) else None
        out.append(f"{lo}+" if hi is None else str(lo) if hi == lo else f"{lo}-{hi}")
    return out


def distribution(df: DataFrame, column: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """n, nulls, min, median, mean, max, variance, distinct values and mode (the smallest of the most frequent).

    approximate: median and distinct values by mergeable sketches (see sketches, whose profiles can be stored and merged), of bounded
    size however many values there are.
    """
    freq = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_f"))
    mode = freq.groupBy(*by).agg(F.max(F.struct("_f", (-F.col(column)).alias("v"))).alias("m"))
    x = F.col(column).cast("double")
    median = quantile(F.kll_sketch_agg_double(x, F.lit(SKETCH_K)), 0.5) if approximate else F.percentile(column, 0.5)
    unique = F.hll_sketch_estimate(F.hll_sketch_agg(x.cast("string"), F.lit(LG))) if approximate else F.count_distinct(column)
    base = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"), F.min(column).alias("lo"), median.alias("median"),
        F.avg(column).alias("mean"), F.max(column).alias("hi"), F.var_pop(column).alias("variance"), unique.alias("distinct_values"),
    )
    mode = mode.select(*by, (-F.col("m.v")).alias("mode"))
    return base.join(mode, list(by), "left") if by else base.crossJoin(F.broadcast(mode))  # one row each


def source_audit(contests: DataFrame, events: DataFrame) -> DataFrame:
    """One row: contests, events, events of no contest, contests without events, distinct contests with a goal."""
    ids = contests.select(ID).distinct().withColumn("_c", F.lit(1))
    per = events.groupBy(ID).agg(F.count("*").alias("k"), F.count(F.when(F.col("event_type") == "GOAL", 1)).alias("g"))
    j = ids.join(per, ID, "full")
    return j.agg(
        F.count("_c").alias("contests"), F.coalesce(F.sum("k"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("_c").isNull(), F.col("k"))), F.lit(0)).alias("orphan_events"),
        F.count(F.when(F.col("_c").isNotNull() & F.col("k").isNull(), 1)).alias("silent_contests"), F.count(F.when(F.col("g") > 0, 1)).alias("with_goal"),
    )


def event_type_report(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "season").agg(F.count("*").alias("n"), F.count_distinct(ID).alias("contests"), F.count(F.when(F.col("minute").isNull(), 1)).alias("unresolved"))


def participation_intervals(roster: DataFrame, moves: DataFrame, full: int = 90) -> DataFrame:
    """roster (contest_id, e, player, starter), moves (contest_id, e, player, kind in|out|red, minute) -> entry, exit, minutes, type.

    A starter enters at 0; a red card after the exit is ignored; who never enters plays 0 minutes. The moves of a contest are met as one
    list, so that a roster that is partitioned by contest needn't be shuffled.
    """
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("minute")))
    m = moves.groupBy(ID, "e", "player").agg(of("in").alias("i"), of("out").alias("o"), of("red").alias("r"))
    m = m.select(ID, F.struct("e", "player", "i", "o", "r").alias("m")).groupBy(ID).agg(F.collect_list("m").alias("_m"))
    own = F.filter("_m", lambda x: (x["e"] == F.col("e")) & (x["player"] == F.col("player")))
    j = roster.select(ID, "e", "player", "starter").join(m, ID, "left").withColumn("_m", F.get(own, F.lit(0))).select(ID, "e", "player", "starter", "_m.i", "_m.o", "_m.r")
    entry = F.when(F.col("starter"), 0).otherwise(F.col("i"))
    red = F.when(F.col("o").isNull() | (F.col("r") <= F.col("o")), F.col("r"))
    leave = F.when(entry.isNotNull(), F.least(F.coalesce("o", F.lit(full)), F.coalesce(red, F.lit(full)), F.lit(full)))
    kind = (
        F.when(entry.isNull(), "UNUSED").when(red.isNotNull(), "DISMISSED").when(F.col("starter") & F.col("o").isNull(), "FULL")
        .when(F.col("starter"), "SUBSTITUTED_OFF").when(F.col("o").isNull(), "SUBSTITUTED_ON").otherwise("ON_AND_OFF")
    )
    return j.select(ID, "e", "player", "starter", entry.alias("entry"), leave.alias("exit"), F.coalesce(F.greatest(leave - entry, F.lit(0)), F.lit(0)).alias("minutes"), kind.alias("kind"))


def minutes_conservation(intervals: DataFrame, players: int = 11, full: int = 90) -> DataFrame:
    """Sides whose minutes differ from players * full less what dismissals took."""
    lost = F.when(F.col("kind") == "DISMISSED", full - F.col("exit")).otherwise(0)
    per = intervals.groupBy(ID, "e").agg(F.sum("minutes").alias("minutes"), F.sum(lost).alias("lost"))
    return per.withColumn("excess", F.col("minutes") + F.col("lost") - players * full).where("excess <> 0")


def two_leg_tie(legs: DataFrame) -> DataFrame:
    """legs (tie, leg, home, away, home_score, away_score, ph, pa) -> winner by wins, then aggregate, then shoot-out of leg 2."""
    a = F.least("home", "away")
    rows = legs.withColumns({
        "a": a, "b": F.greatest("home", "away"), "fa": F.when(F.col("home") == a, F.col("home_score")).otherwise(F.col("away_score")),
        "fb": F.when(F.col("home") == a, F.col("away_score")).otherwise(F.col("home_score")),
        "sa": F.when(F.col("leg") == 2, F.when(F.col("home") == a, F.col("ph")).otherwise(F.col("pa"))),
        "sb": F.when(F.col("leg") == 2, F.when(F.col("home") == a, F.col("pa")).otherwise(F.col("ph"))),
    })
    won = lambda x, y: F.count(F.when(F.col(x) > F.col(y), 1))
    t = rows.groupBy("tie", "a", "b").agg(
        F.count("*").alias("legs"), won("fa", "fb").alias("wa"), won("fb", "fa").alias("wb"), F.sum("fa").alias("ga"), F.sum("fb").alias("gb"),
        F.max("sa").alias("pa"), F.max("sb").alias("pb"),
    )
    pick = lambda x, y: F.when(F.col(x) > F.col(y), F.col("a")).when(F.col(x) < F.col(y), F.col("b"))
    winner = F.coalesce(pick("wa", "wb"), pick("ga", "gb"), pick("pa", "pb"))
    by = F.when(F.col("wa") != F.col("wb"), "wins").when(F.col("ga") != F.col("gb"), "aggregate").when(F.col("pa") != F.col("pb"), "shootout").otherwise("undecided")
    return t.select("tie", "a", "b", "legs", "ga", "gb", winner.alias("winner"), by.alias("decided_by"))


def regulation_score(candidates: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row per candidate: CONFIRMED with consistent 90-minute scores, CONFLICT, or UNRESOLVED with null scores."""
    e = extracted.groupBy(ID).agg(F.count_distinct("h", "a").alias("k"), F.min("h").alias("h"), F.min("a").alias("a"))
    j = candidates.join(e, ID, "left")
    status = F.when(F.col("k").isNull() | (F.col("k") == 0), "UNRESOLVED").when(F.col("k") > 1, "CONFLICT").otherwise("CONFIRMED")
    ok = status == "CONFIRMED"
    return j.select(ID, status.alias("status"), F.when(ok, F.col("h")).alias("home_90"), F.when(ok, F.col("a")).alias("away_90"))


def interval_audit(snapshots: DataFrame, contests: DataFrame) -> DataFrame:
    """snapshots (e, snap, d, total): contests between consecutive snapshots, the total's growth, CLEAN, MULTI, NONE or IDENTITY."""
    w = W.partitionBy("e").orderBy("d", "snap")
    s = snapshots.withColumns({"d0": F.lag("d").over(w), "t0": F.lag("total").over(w)}).where("d0 is not null")
    a = appearances(contests).groupBy("e", F.col("d").alias("on")).agg(F.count("*").alias("k"))
    j = s.join(a.withColumnRenamed("e", "_e"), (F.col("e") == F.col("_e")) & (F.col("on") > F.col("d0")) & (F.col("on") <= F.col("d")), "left")
    out = j.groupBy("e", "snap", "d", (F.col("total") - F.col("t0")).alias("increment")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    status = F.when(F.col("increment") != F.col("n"), "IDENTITY").when(F.col("n") == 0, "NONE").when(F.col("n") == 1, "CLEAN").otherwise("MULTI")
    return out.withColumn("status", status)
