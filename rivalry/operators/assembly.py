"""Training tables: feature frames joined one to one on the contest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.core.asof import ID
from rivalry.operators import features as FE
from rivalry.operators import ratings as RA


def training_base(contests: DataFrame, rated: DataFrame, window: int = 5) -> DataFrame:
    """Ids, ratings, form of both sides and the label."""
    form = FE.form_lastn(contests, window)
    r = rated.select(ID, "home_rating", "away_rating", "rating_diff")
    base = contests.select(ID, "d", "season", "competition", "home", "away", F.col("result").alias("label"))
    return base.join(r, ID).join(form, ID)


def add_frames(base: DataFrame, frames: Sequence[DataFrame]) -> DataFrame:
    """Join frames that have one row per contest; columns that base already has aren't taken again.

    The alignment is strict: a contest that a frame hasn't fails the job instead of being dropped.
    """
    for f in frames:
        f = f.drop(*[c for c in f.columns if c in base.columns and c != ID]).withColumn("__met", F.lit(True))
        base = base.join(f, ID, "left").where(F.coalesce("__met", F.raise_error(F.lit("a feature frame lacks a contest")).cast("boolean"))).drop("__met")
    return base


def plus_venue(base: DataFrame, contests: DataFrame) -> DataFrame:
    return add_frames(base, [FE.venue_form(contests)])


def plus_matchup(base: DataFrame, contests: DataFrame) -> DataFrame:
    return add_frames(base, [FE.h2h_lastn(contests), FE.place_form(contests)])


def plus_context(base: DataFrame, contests: DataFrame) -> DataFrame:
    return add_frames(base, [FE.schedule_gap(contests)])


def plus_momentum(base: DataFrame, contests: DataFrame, rated: DataFrame) -> DataFrame:
    long = rated.select(ID, F.expr("stack(2, 'home', home_rating, 'away', away_rating) as (side, rating)"))
    rows = FE.appearances(contests).join(long, [ID, "side"])
    return add_frames(base, [FE.rating_momentum(rows)])


def plus_stats(base: DataFrame, contests: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    return add_frames(base, [FE.stats_lastn(contests, stats, names)])


def continuous_history(parts: dict[str, DataFrame], feature) -> dict[str, DataFrame]:
    """Compute a feature over the union of tables of different schemas, then split the result by source."""
    rows = None
    for name, df in parts.items():
        tagged = df.withColumn("_source", F.lit(name))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    got = feature(rows.drop("_source"))
    ids = rows.select(ID, "_source")
    return {name: got.join(ids.where(F.col("_source") == name).select(ID), ID, "left_semi") for name in parts}


def xg_training_rows(xg: DataFrame, contests: DataFrame, rated: DataFrame, window: int = 5) -> DataFrame:
    """Rows with means for both sides, joined to ratings and label, with a fingerprint."""
    means = FE.xg_lastn_mean(xg, window).where("pair_available")
    out = means.join(rated.select(ID, "rating_diff"), ID).join(contests.select(ID, "result"), ID)
    cols = [ID, "home_xg_for", "home_xg_against", "away_xg_for", "away_xg_against", "result"]
    text = [F.round(F.col(c) * 10000).cast("long").cast("string") if c not in (ID, "result") else F.col(c).cast("string") for c in cols]
    return out.select(*cols, "rating_diff", F.sha2(F.concat_ws("|", *text), 256).alias("row_hash"))


def rated_rows(contests: DataFrame, k: float = 20.0) -> DataFrame:
    return RA.replay(contests, [{"k": k}])
