"""Column functions on scores, ratings, minutes, keys and weights."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def result_from_scores(home, away) -> Column:
    """2 home, 1 draw, 0 away; null where a score is."""
    return (F.signum((c(home) - c(away)).cast("double")) + 1).cast("int")


def points(gf, ga) -> Column:
    """3, 1 or 0 for one side."""
    return F.when(c(gf) > c(ga), 3).when(c(gf) == c(ga), 1).when(c(gf) < c(ga), 0)


def expected_score(rating, opponent) -> Column:
    """1 / (1 + 10 ** ((opponent - rating) / 400)); the exponent is bounded so that it can't overflow."""
    gap = (c(opponent) - c(rating)) / 400.0
    return 1 / (1 + F.pow(F.lit(10.0), F.greatest(F.lit(-300.0), F.least(F.lit(300.0), gap))))


def minute_parts(raw) -> Column:
    """struct(minute, half, base, added, stoppage) of "45'+2", "90+3" or "67"; nulls if it isn't a minute."""
    m = lambda g: F.regexp_extract(c(raw), r"^\s*(\d{1,3})'?\s*(?:\+\s*(\d{1,2}))?'?\s*$", g)
    base = F.when(m(1) != "", m(1).cast("int"))
    added = F.when(base.isNotNull(), F.when(m(2) != "", m(2).cast("int")).otherwise(0))
    return F.struct(
        (base + added).alias("minute"),
        F.when(base <= 45, 0).when(base > 45, 1).alias("half"),
        base.alias("base"), added.alias("added"), (added > 0).alias("stoppage"),
    )


def season_phase(round_no, early: int = 5, middle: int = 29) -> Column:
    return F.when(c(round_no) <= early, "early").when(c(round_no) <= middle, "middle").when(c(round_no).isNotNull(), "late")


def pair_low(a, b) -> Column:
    return F.least(c(a), c(b))


def pair_high(a, b) -> Column:
    return F.greatest(c(a), c(b))


def orient(home, low) -> Column:
    """1 where the pair's first member is at home, else -1: turns pair history to the present home side."""
    return F.when(c(home) == c(low), 1).otherwise(-1)


def time_decay(age_days, half_life: float | None) -> Column:
    """exp(-ln 2 * age / half_life); 1 without a half-life."""
    if half_life is None:
        return F.lit(1.0)
    return F.exp(-F.log(F.lit(2.0)) * c(age_days) / F.lit(float(half_life)))


def derived_key(*cols) -> Column:
    """A normalised composite key: lower case, blanks to '-', parts joined by '|'."""
    return F.concat_ws("|", *[F.regexp_replace(F.lower(F.trim(c(x).cast("string"))), r"\s+", "-") for x in cols])


def row_fingerprint(*cols: str) -> Column:
    """SHA-256 of the values as text, '|' between them and '~' for null."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("~")) for x in cols]), 256)


def shootout_points(gf, ga, pf, pa) -> Column:
    """3 or 0 in regulation; after a shoot-out 2 or 1; null where a needed score is missing."""
    return (
        F.when(c(gf) > c(ga), 3).when(c(gf) < c(ga), 0)
        .when((c(gf) == c(ga)) & (c(pf) > c(pa)), 2).when((c(gf) == c(ga)) & (c(pf) < c(pa)), 1)
    )


def decision(gf, ga, ef, ea, pf, pa) -> Column:
    """How a tie was decided: regulation, extra_time, penalties or draw."""
    return (
        F.when(c(gf) != c(ga), "regulation").when(c(ef) != c(ea), "extra_time").when(c(pf) != c(pa), "penalties")
        .when(c(gf) == c(ga), "draw")
    )


def clipped_log(p) -> Column:
    """log of a probability, clipped at the double epsilon on both sides."""
    eps = 2.220446049250313e-16
    return F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c(p))))


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it. Meant for distinct names, not for long texts."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def name_key(name: Column) -> Column:
    """A name for comparison: NFKC, lower case, runs of white space (the ideographic one too) as one blank."""
    return F.trim(F.regexp_replace(F.lower(nfkc(name)), r"[\s\u3000]+", " "))
