"""Leakage-safe history: what a row may know is what happened on earlier dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ID = "contest_id"


def by_id(id_col: str = ID) -> Column:
    """Ids are ordered as text."""
    return F.col(id_col).cast("string")


def appearances(contests: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Two rows per contest, one for each side, in one pass: e, opp, side, gf, ga beside the shared columns."""
    shared = [x for x in (ID, "d", "season", "competition", "place", "result", *extra) if x in contests.columns]
    side = lambda e, o, s, f, a: F.struct(
        F.col(e).alias("e"), F.col(o).alias("opp"), F.lit(s).alias("side"), F.col(f).alias("gf"), F.col(a).alias("ga")
    )
    both = F.array(side("home", "away", "home", "home_score", "away_score"), side("away", "home", "away", "away_score", "home_score"))
    return contests.select(*shared, F.inline(both))


def at_first_of_date(df: DataFrame, values: Mapping[str, Column], keys: Sequence[str], id_col: str = ID) -> DataFrame:
    """Add window values as they stood at the first row of each date, so that rows of a date don't see each other.

    The first window's exchange on keys also serves the second one; no shuffle is added.
    """
    day = W.partitionBy(*keys, "d").orderBy(by_id(id_col))
    df = df.withColumns({f"__{k}": v for k, v in values.items()})
    return df.withColumns({k: F.first(f"__{k}").over(day) for k in values}).drop(*[f"__{k}" for k in values])


def last_n(df: DataFrame, n: int, aggs: Mapping[str, Column], keys: Sequence[str] = ("e",), id_col: str = ID) -> DataFrame:
    """Aggregates over the last n rows of earlier dates, ordered by (d, id)."""
    w = W.partitionBy(*keys).orderBy("d", by_id(id_col)).rowsBetween(-n, -1)
    return at_first_of_date(df, {k: a.over(w) for k, a in aggs.items()}, keys, id_col)


def prior(df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str] = ("e",), days: int | None = None) -> DataFrame:
    """Aggregates over all rows of earlier dates, or of the last `days` days; season among keys resets each season."""
    w = W.partitionBy(*keys).orderBy(F.unix_date("d")).rangeBetween(W.unboundedPreceding if days is None else -days, -1)
    return df.withColumns({k: a.over(w) for k, a in aggs.items()})


def repivot(df: DataFrame, values: Sequence[str], keep: Sequence[str] = (ID,)) -> DataFrame:
    """Rows of sides -> one row per contest with home_ and away_ columns."""
    pick = lambda s, v: F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{s}_{v}")
    return df.groupBy(*keep).agg(*[pick(s, v) for v in values for s in ("home", "away")])


def eligible_last_n(df: DataFrame, n: int, values: Sequence[str], flag: str, keys: Sequence[str] = ("e",), id_col: str = ID) -> DataFrame:
    """Sums and counts of the last n flagged rows of earlier dates, for flagged and other rows alike.

    Prefix sums over the flagged rows are looked up at the present count and at the count n before, with
    two joins on (keys, count); no list of history is built.
    """
    w = W.partitionBy(*keys).orderBy("d", by_id(id_col)).rowsBetween(W.unboundedPreceding, 0)
    hit = F.col(flag)
    seq = df.where(hit).withColumn("__n", F.count("*").over(w))
    seq = seq.select(*keys, "__n", *[F.sum(v).over(w).alias(f"__{v}") for v in values])
    out = prior(df, {"__now": F.count(F.when(hit, 1))}, keys)
    out = out.withColumn("__then", F.greatest(F.col("__now") - n, F.lit(0)))
    for at in ("now", "then"):
        look = seq.withColumnRenamed("__n", f"__{at}").withColumnsRenamed({f"__{v}": f"__{at}_{v}" for v in values})
        out = out.join(look, [*keys, f"__{at}"], "left")
    got = {f"{v}_sum": F.coalesce(f"__now_{v}", F.lit(0)) - F.coalesce(f"__then_{v}", F.lit(0)) for v in values}
    out = out.withColumns(got | {"n_history": F.least(F.col("__now"), F.lit(n)), "n_eligible": F.col("__now")})
    return out.drop("__now", "__then", *[f"__{at}_{v}" for at in ("now", "then") for v in values])


def forbid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Targets may not carry outcomes."""
    found = sorted(set(columns) & set(df.columns))
    if found:
        raise ValueError(f"targets carry outcome columns: {found}")
    return df
