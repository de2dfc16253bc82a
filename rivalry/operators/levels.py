"""Ratings of a pool of any size: contests that share no entity with an open date are rated together, level by level."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivalry.core.asof import ID
from rivalry.operators.ratings import CONFIG, START

PLAIN = ("config", "k", "home_adv")


def _step(c: Mapping, home: Column, away: Column) -> Column:
    gap = F.greatest(F.lit(-300.0), F.least(F.lit(300.0), (away - home - F.lit(float(c["home_adv"]))) / 400.0))
    expected = 1 / (1 + F.pow(F.lit(10.0), gap))
    return F.coalesce(F.lit(float(c["k"])) * (F.col("result") / 2.0 - expected), F.lit(0.0))


def replay_levels(contests: DataFrame, store: Callable[[DataFrame, str], DataFrame], configs: Sequence[Mapping] = ({},), pool: str = "competition") -> DataFrame:
    """The rows of ratings.replay, for pools that are too large for one task: no task holds a pool, rows meet by (pool, entity) joins.

    An entity's dates are numbered; a contest is ready when the earlier dates of both its entities are done, which all contests of a level
    are at once. A level is two joins of the waiting contests with the written state, one row per entity: the number of its date, the
    rating before it, what its contests have changed so far, and how many are still to come. Contests are written by the higher of their
    two date numbers, before which they can't be ready, so a level reads its own and those that still wait, not all. There are as many
    levels as the longest chain of contests that wait for each other: an entity's dates at least. Configurations may set k and home_adv;
    season rules need the order of a pool's seasons and stay with ratings.replay. Null results are rated and change nothing.
    """
    rows = [{**CONFIG, **c} for c in configs]
    if any(c[x] != v for c in rows for x, v in CONFIG.items() if x not in PLAIN):
        raise ValueError("levels know k and home_adv only")
    spark, n = contests.sparkSession, range(len(rows))
    base = contests.select(F.col(pool).cast("string").alias("pool"), ID, "d", "home", "away", "result")
    days = base.select("pool", "d", F.explode(F.array("home", "away")).alias("e")).groupBy("pool", "e", "d").agg(F.count("*").alias("size"))
    days = store(days.withColumn("no", F.row_number().over(W.partitionBy("pool", "e").orderBy("d"))), "days")
    for side in ("home", "away"):
        own = days.select("pool", "d", F.col("e").alias(side), F.col("no").alias(f"{side}_no"))
        base = base.join(own, ["pool", "d", side])
    base = store(base.withColumn("level", F.greatest("home_no", "away_no")), "contests")
    by_level = {r.level: r["count"] for r in base.groupBy("level").count().collect()}  # a row per level
    zero, start = [F.lit(0.0).alias(f"s{i}") for i in n], [F.lit(START).alias(f"r{i}") for i in n]
    state = store(days.where("no = 1").select("pool", "e", "no", F.col("size").alias("left"), *start, *zero), "state")
    waiting, done, level = None, [], 0
    while waiting is not None or level < max(by_level, default=0):
        level += 1
        now = base.where(F.col("level") == level).drop("level")
        now = now if waiting is None else now.unionByName(waiting)
        sides = {s: state.select("pool", F.col("e").alias(s), F.col("no").alias(f"{s}_no"), *[F.col(f"r{i}").alias(f"{s}_r{i}") for i in n]) for s in ("home", "away")}
        met = now
        for s, own in sides.items():
            met = met.join(own, ["pool", s, f"{s}_no"], "left")
        met = store(met.withColumns({f"step{i}": _step(c, F.col(f"home_r{i}"), F.col(f"away_r{i}")) for i, c in enumerate(rows)}).withColumn("ready", F.col("home_r0").isNotNull() & F.col("away_r0").isNotNull()), "met")
        ready = met.where("ready")
        done.append(ready.select("pool", ID, *[f"{s}_r{i}" for s in sides for i in n]))
        both = [ready.select("pool", F.col(s).alias("e"), *[(F.col(f"step{i}") * sign).alias(f"c{i}") for i in n]) for s, sign in (("home", 1), ("away", -1))]
        change = both[0].union(both[1]).groupBy("pool", "e").agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in n])
        new = state.join(change, ["pool", "e"], "left").withColumn("left", F.col("left") - F.coalesce("n", F.lit(0)))
        new = new.withColumns({f"s{i}": F.col(f"s{i}") + F.coalesce(f"c{i}", F.lit(0.0)) for i in n})
        over = F.col("left") == 0
        new = new.withColumns({f"r{i}": F.col(f"r{i}") + F.when(over, F.col(f"s{i}")).otherwise(0.0) for i in n}).withColumns({f"s{i}": F.when(over, 0.0).otherwise(F.col(f"s{i}")) for i in n})
        new = new.withColumn("no", F.col("no") + over.cast("int"))
        ahead = days.select("pool", "e", "no", F.col("size").alias("next"))
        new = new.join(ahead, ["pool", "e", "no"], "left").withColumn("left", F.when(over, F.coalesce("next", F.lit(-1))).otherwise(F.col("left")))
        state = store(new.select("pool", "e", "no", "left", *[f"{x}{i}" for x in "rs" for i in n]), "state")
        left = met.where("not ready").select(*[c for c in base.columns if c != "level"])
        waiting = left if left.take(1) else None
    if not done:
        return spark.createDataFrame([], "pool string, config string, contest_id long, home_rating double, away_rating double, rating_diff double")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    told = F.inline(F.array(*[F.struct(F.lit(str(c["config"])).alias("config"), F.col(f"home_r{i}").alias("home_rating"), F.col(f"away_r{i}").alias("away_rating")) for i, c in enumerate(rows)]))
    return out.select("pool", ID, told).select("pool", "config", ID, "home_rating", "away_rating").withColumn("rating_diff", F.col("home_rating") - F.col("away_rating"))
