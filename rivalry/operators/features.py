"""As-of features of contests. Each function gives one row per contest, from history of earlier dates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.core.asof import ID, appearances, at_first_of_date, by_id, eligible_last_n, forbid, last_n, prior, repivot
from rivalry.functions.scalar import orient, points


def _zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({x: F.coalesce(x, F.lit(0)) for x in cols})


def _form(rows: DataFrame, n: int, keys: Sequence[str] = ("e",)) -> DataFrame:
    p = points("gf", "ga")
    is_ = lambda v: F.sum(F.when(p == v, 1).otherwise(0))
    aggs = {"points": F.sum(p), "wins": is_(3), "draws": is_(1), "losses": is_(0), "gf_sum": F.sum("gf"), "ga_sum": F.sum("ga"), "played": F.count("gf")}
    return _zero(last_n(rows, n, aggs, keys), list(aggs))


FORM = ["points", "wins", "draws", "losses", "gf_sum", "ga_sum", "played"]


def form_lastn(contests: DataFrame, n: int = 5) -> DataFrame:
    """Points, wins, draws, losses and goals of the last n, both roles together, over seasons; 0 without history."""
    return repivot(_form(appearances(contests), n), FORM)


def form_asof_targets(contests: DataFrame, targets: DataFrame, n: int = 5) -> DataFrame:
    """form_lastn for targets (contest_id, d, home, away) that have no outcome; targets are never history."""
    forbid(targets, ["home_score", "away_score", "result"])
    none = {x: F.lit(None).cast(dict(contests.dtypes)[x]) for x in ("home_score", "away_score")}
    cols = [ID, "d", "home", "away", "home_score", "away_score", "target"]
    rows = contests.withColumn("target", F.lit(False)).select(cols).unionByName(
        targets.withColumns(none | {"target": F.lit(True)}).select(cols)
    )
    rows = appearances(rows, ["target"]).withColumn("eligible", ~F.col("target"))
    p = points("gf", "ga")
    rows = rows.withColumns({"points": p, "wins": (p == 3).cast("int"), "draws": (p == 1).cast("int"), "losses": (p == 0).cast("int")})
    names = ["points", "wins", "draws", "losses", "gf", "ga"]
    got = eligible_last_n(rows, n, names, "eligible").where("target").drop(*names)
    got = got.withColumnsRenamed({f"{x}_sum": x for x in names[:4]} | {"n_history": "played"})
    return repivot(got, FORM)


def venue_form(contests: DataFrame, n: int = 5) -> DataFrame:
    """Last n in the same role: points and goal difference."""
    aggs = {"venue_points": F.sum(points("gf", "ga")), "venue_goal_diff": F.sum(F.col("gf") - F.col("ga"))}
    return repivot(_zero(last_n(appearances(contests), n, aggs, ["e", "side"]), list(aggs)), list(aggs))


def place_form(contests: DataFrame, window: int = 5) -> DataFrame:
    """Last `window` at the same place, both roles: n, points, goal difference."""
    aggs = {"place_n": F.count("gf"), "place_points": F.sum(points("gf", "ga")), "place_goal_diff": F.sum(F.col("gf") - F.col("ga"))}
    return repivot(_zero(last_n(appearances(contests), window, aggs, ["e", "place"]), list(aggs)), list(aggs))


def place_forms(contests: DataFrame, windows: Sequence[int]) -> DataFrame:
    """place_form of several windows at once, its columns ended by _<window>; all share the exchanges of one."""
    aggs = {"place_n": F.count("gf"), "place_points": F.sum(points("gf", "ga")), "place_goal_diff": F.sum(F.col("gf") - F.col("ga"))}
    keys, names = ["e", "place"], [f"{x}_{n}" for n in windows for x in aggs]
    over = {n: W.partitionBy(*keys).orderBy("d", by_id()).rowsBetween(-n, -1) for n in windows}
    rows = appearances(contests).select(ID, *keys, "d", "side", "gf", "ga")
    return repivot(_zero(at_first_of_date(rows, {f"{x}_{n}": a.over(over[n]) for n in windows for x, a in aggs.items()}, keys), names), names)


def _pairs(contests: DataFrame) -> DataFrame:
    low = F.least("home", "away")
    p = lambda f, a: points(f, a)
    turn = orient("home", low)
    return contests.withColumns({
        "low": low, "high": F.greatest("home", "away"),
        "pd": turn * (p("home_score", "away_score") - p("away_score", "home_score")),
        "gd": turn * (F.col("home_score") - F.col("away_score")),
    })


def h2h_lastn(contests: DataFrame, n: int = 5) -> DataFrame:
    """Last n of the same pair: n, points and goal difference as the present home side sees them."""
    aggs = {"h2h_n": F.count("pd"), "h2h_points_diff": F.sum("pd"), "h2h_goal_diff": F.sum("gd")}
    rows = _zero(last_n(_pairs(contests), n, aggs, ["low", "high"]), list(aggs))
    turn = orient("home", "low")
    return rows.select(ID, "h2h_n", *[(turn * F.col(x)).alias(x) for x in ("h2h_points_diff", "h2h_goal_diff")])


def h2h_cumulative(contests: DataFrame) -> DataFrame:
    """All earlier contests of the pair: n, wins of the present home side, draws, last id and date, available."""
    rows = _pairs(contests).withColumns({
        "low_won": F.when(F.col("result") == 1, 0).when((F.col("result") == 2) == (F.col("home") == F.col("low")), 1).otherwise(0),
        "drawn": (F.col("result") == 1).cast("int"),
    })
    at = F.struct("d", by_id())
    aggs = {"n": F.count("result"), "lw": F.sum("low_won"), "dr": F.sum("drawn"), "prev_id": F.max_by(ID, at), "prev_d": F.max("d")}
    rows = _zero(prior(rows, aggs, ["low", "high"]), ["n", "lw", "dr"])
    wins = F.when(F.col("home") == F.col("low"), F.col("lw")).otherwise(F.col("n") - F.col("dr") - F.col("lw"))
    return rows.select(
        ID, F.col("n").alias("h2h_played"), wins.alias("h2h_home_wins"), F.col("dr").alias("h2h_draws"),
        F.col("prev_id").alias("h2h_previous_id"), F.col("prev_d").alias("h2h_previous_date"), (F.col("n") > 0).alias("h2h_available"),
    )


def stats_lastn(contests: DataFrame, stats: DataFrame, names: Sequence[str], window: int = 5) -> DataFrame:
    """Last `window` sums for, against and their difference of each statistic; stats has home_<x> and away_<x>."""
    rows = contests.join(stats, ID)
    own = {x: F.when(F.col("side") == "home", F.col(f"home_{x}")).otherwise(F.col(f"away_{x}")) for x in names}
    other = {x: F.when(F.col("side") == "home", F.col(f"away_{x}")).otherwise(F.col(f"home_{x}")) for x in names}
    rows = appearances(rows, [f"{s}_{x}" for x in names for s in ("home", "away")])
    aggs = {f"{x}_for": F.sum(own[x]) for x in names} | {f"{x}_against": F.sum(other[x]) for x in names}
    rows = _zero(last_n(rows, window, aggs), list(aggs)).withColumns({f"{x}_diff": F.col(f"{x}_for") - F.col(f"{x}_against") for x in names})
    return repivot(rows.select(ID, "side", *aggs, *[f"{x}_diff" for x in names]), [*aggs, *[f"{x}_diff" for x in names]])


def _xg_rows(xg: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    named = xg.withColumnsRenamed({"home_xg": "home_score", "away_xg": "away_score"})
    return appearances(named, ["eligible", *extra]).withColumn("eligible", F.coalesce("eligible", F.lit(False)))


def _xg_means(rows: DataFrame, n: int) -> DataFrame:
    got = eligible_last_n(rows, n, ["gf", "ga"], "eligible").drop("gf", "ga")
    full = F.col("n_history") == n
    return got.withColumns({"xg_for": F.when(full, F.col("gf_sum") / n), "xg_against": F.when(full, F.col("ga_sum") / n)})


def xg_lastn_mean(xg: DataFrame, n: int = 5) -> DataFrame:
    """Means of exactly n eligible earlier observations, else null; how many ineligible ones were passed over; both sides available."""
    rows = prior(_xg_means(_xg_rows(xg), n), {"excluded": F.count(F.when(~F.col("eligible"), 1))})
    return _pair_flag(repivot(rows, ["xg_for", "xg_against", "n_history", "excluded"]))


def _pair_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("pair_available", F.col("home_xg_for").isNotNull() & F.col("away_xg_for").isNotNull())


def xg_asof_targets(xg: DataFrame, targets: DataFrame, n: int = 5) -> DataFrame:
    """xg_lastn_mean for targets that may not carry outcomes."""
    forbid(targets, ["home_xg", "away_xg", "home_score", "away_score", "result"])
    cols = [ID, "d", "home", "away", "home_xg", "away_xg", "eligible", "target"]
    none = {x: F.lit(None).cast("double") for x in ("home_xg", "away_xg")}
    rows = xg.withColumn("target", F.lit(False)).select(cols).unionByName(
        targets.withColumns(none | {"eligible": F.lit(False), "target": F.lit(True)}).select(cols)
    )
    got = _xg_means(_xg_rows(rows, ["target"]), n).where("target")
    return _pair_flag(repivot(got, ["xg_for", "xg_against", "n_history"]))


def history_audit(contests: DataFrame, n: int = 5) -> DataFrame:
    """Ids of the history that each side used, oldest first, joined by commas."""
    ids = last_n(appearances(contests), n, {"used": F.collect_list(by_id())})
    return repivot(ids.withColumn("used", F.array_join("used", ",")), ["used"])


def _gap(rows: DataFrame, keys: Sequence[str], name: str = "gap") -> DataFrame:
    return prior(rows, {"__last": F.max("d")}, keys).withColumn(name, F.datediff("d", "__last")).drop("__last")


def schedule_gap(contests: DataFrame) -> DataFrame:
    """Days since each side's last contest, flags, and the difference (0 unless both are known)."""
    out = repivot(_gap(appearances(contests), ["e"]), ["gap"])
    both = F.col("home_gap").isNotNull() & F.col("away_gap").isNotNull()
    return out.select(
        ID, F.coalesce("home_gap", F.lit(0)).alias("home_gap"), F.coalesce("away_gap", F.lit(0)).alias("away_gap"),
        F.col("home_gap").isNotNull().alias("home_known"), F.col("away_gap").isNotNull().alias("away_known"),
        F.when(both, F.col("home_gap") - F.col("away_gap")).otherwise(0).alias("gap_diff"),
    )


def multi_stream_rest(contests: DataFrame) -> DataFrame:
    """For each appearance: days since the last contest in the own competition and in any, and which of five cases holds.

    domestic_longer can only come from histories that leave out contests of the own competition.
    """
    rows = _gap(_gap(appearances(contests), ["e", "competition"], "own_gap"), ["e"], "any_gap")
    case = (
        F.when(F.col("any_gap").isNull(), "no_previous_domestic").when(F.col("own_gap").isNull(), "no_previous_league")
        .when(F.col("any_gap") == F.col("own_gap"), "equal").when(F.col("any_gap") < F.col("own_gap"), "shorter").otherwise("domestic_longer")
    )
    return rows.select(ID, "e", "side", "competition", "own_gap", "any_gap", case.alias("category"))


def rest_with_completed_targets(contests: DataFrame, targets: DataFrame) -> DataFrame:
    """Days of rest of targets (contest_id, d, home, away), where earlier targets count as history too."""
    forbid(targets, ["home_score", "away_score", "result"])
    cols = [ID, "d", "home", "away", "home_score", "away_score", "target"]
    rows = contests.withColumn("target", F.lit(False)).select(cols).unionByName(
        targets.withColumns({"home_score": F.lit(None).cast("int"), "away_score": F.lit(None).cast("int"), "target": F.lit(True)}).select(cols)
    )
    return repivot(_gap(appearances(rows, ["target"]), ["e"], "rest").where("target"), ["rest"])


def rating_momentum(rated: DataFrame, n: int = 5) -> DataFrame:
    """rated (contest_id, d, e, side, rating): rating now minus the oldest of the last n before; and how many there are."""
    rows = last_n(rated, n, {"oldest": F.first("rating"), "momentum_n": F.count("rating")})
    rows = rows.withColumn("momentum", F.coalesce(F.col("rating") - F.col("oldest"), F.lit(0.0)))
    return repivot(rows, ["momentum", "momentum_n"])


def draw_rates(contests: DataFrame, n: int = 5) -> DataFrame:
    """Draw rates of the last n and of the season so far, their mean and distance between sides; null without history."""
    rows = appearances(contests).withColumn("drawn", (F.col("result") == 1).cast("int"))
    rows = last_n(rows, n, {"last_draws": F.sum("drawn"), "last_n": F.count("drawn")})
    rows = prior(rows, {"season_draws": F.sum("drawn"), "season_n": F.count("drawn")}, ["e", "season"])
    rows = rows.withColumns({f"{k}_rate": F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_draws") / F.col(f"{k}_n")) for k in ("last", "season")})
    out = repivot(rows, ["last_rate", "season_rate", "last_n", "season_n"])
    return out.withColumns(
        {f"{k}_mean": (F.col(f"home_{k}_rate") + F.col(f"away_{k}_rate")) / 2 for k in ("last", "season")}
        | {f"{k}_distance": F.abs(F.col(f"home_{k}_rate") - F.col(f"away_{k}_rate")) for k in ("last", "season")}
    )


def _event_totals(contests: DataFrame, events: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    per = events.groupBy(ID, "e").agg(*[v.alias(k) for k, v in aggs.items()])
    return appearances(contests).join(per, [ID, "e"], "left")


def discipline_rates(contests: DataFrame, events: DataFrame) -> DataFrame:
    """Yellow and red cards for each contest of the season so far; contests without cards count."""
    of = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    rows = _zero(_event_totals(contests, events, {"yellow": of("YELLOW_CARD"), "red": of("RED_CARD")}), ["yellow", "red"])
    rows = prior(rows, {"n": F.count("*"), "y": F.sum("yellow"), "r": F.sum("red")}, ["e", "season"])
    rows = rows.withColumns({"yellow_rate": F.when(F.col("n") > 0, F.col("y") / F.col("n")), "red_rate": F.when(F.col("n") > 0, F.col("r") / F.col("n"))})
    out = repivot(rows, ["yellow_rate", "red_rate", "n"])
    return out.withColumn("available", (F.col("home_n") > 0) & (F.col("away_n") > 0))


ORDER = ("half", "minute", "added")


def first_event_side(contests: DataFrame, events: DataFrame, kind: str = "GOAL", not_checkable: DataFrame | None = None) -> DataFrame:
    """home, away, AMBIGUOUS where both sides hold the smallest order key, NO_EVENT without one; NOT_CHECKABLE for the contests listed as such."""
    goals = events.where(F.col("event_type") == kind)
    per = goals.groupBy(ID, "side").agg(F.min(F.struct(*ORDER)).alias("at"))
    first = per.groupBy(ID).agg(F.min(F.when(F.col("side") == "home", F.col("at"))).alias("h"), F.min(F.when(F.col("side") == "away", F.col("at"))).alias("a"))
    rows = contests.select(ID).join(first, ID, "left")
    forced = F.lit(False)
    if not_checkable is not None:
        rows = rows.join(not_checkable.select(ID).distinct().withColumn("forced", F.lit(True)), ID, "left")
        forced = F.coalesce("forced", F.lit(False))
    side = (
        F.when(forced, "NOT_CHECKABLE").when(F.col("h").isNull() & F.col("a").isNull(), "NO_EVENT").when(F.col("a").isNull(), "home").when(F.col("h").isNull(), "away")
        .when(F.col("h") == F.col("a"), "AMBIGUOUS").when(F.col("h") < F.col("a"), "home").otherwise("away")
    )
    return rows.select(ID, side.alias("first_side"))


def first_event_profile(contests: DataFrame, events: DataFrame, not_checkable: DataFrame | None = None) -> DataFrame:
    """Season so far: scored first, conceded first, no goal - counts and rates over contests that can be checked and aren't ambiguous."""
    rows = appearances(contests).join(first_event_side(contests, events, not_checkable=not_checkable), ID)
    is_ = lambda x: F.count(F.when(x, 1))
    own = F.col("first_side") == F.col("side")
    ok = ~F.col("first_side").isin("AMBIGUOUS", "NOT_CHECKABLE")
    rows = prior(rows, {
        "n": is_(ok), "scored": is_(own), "conceded": is_(ok & ~own & (F.col("first_side") != "NO_EVENT")), "goalless": is_(F.col("first_side") == "NO_EVENT"),
    }, ["e", "season"])
    names = ["scored", "conceded", "goalless"]
    rows = rows.withColumns({f"{x}_rate": F.when(F.col("n") > 0, F.col(x) / F.col("n")) for x in names})
    return repivot(rows, ["n", *names, *[f"{x}_rate" for x in names]])


def event_timing_profile(contests: DataFrame, events: DataFrame) -> DataFrame:
    """Season so far: count, sum and mean of the minutes of the contest's first goal, of own goals and of goals against."""
    goals = events.where("event_type = 'GOAL'")
    first = goals.groupBy(ID).agg(F.min("minute").alias("first"))
    per = goals.groupBy(ID, "side").agg(F.count("*").alias("k"), F.sum("minute").alias("m"))
    per = per.groupBy(ID).agg(*[F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{s}_{v}") for s in ("home", "away") for v in ("k", "m")])
    rows = appearances(contests).join(first, ID, "left").join(per, ID, "left")
    at_home = F.col("side") == "home"
    pick = lambda v, own: F.when(at_home == F.lit(own), F.col(f"home_{v}")).otherwise(F.col(f"away_{v}"))
    rows = prior(rows, {
        "first_n": F.count("first"), "first_sum": F.sum("first"),
        "scored_n": F.sum(pick("k", True)), "scored_sum": F.sum(pick("m", True)),
        "conceded_n": F.sum(pick("k", False)), "conceded_sum": F.sum(pick("m", False)),
    }, ["e", "season"])
    kinds = ["first", "scored", "conceded"]
    rows = _zero(rows, [f"{k}_{x}" for k in kinds for x in ("n", "sum")]).withColumns({f"{k}_mean": F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_sum") / F.col(f"{k}_n")) for k in kinds})
    return repivot(rows, [f"{k}_{x}" for k in kinds for x in ("n", "sum", "mean")])


def substitution_profile(contests: DataFrame, events: DataFrame) -> DataFrame:
    """Season so far: count and mean minute of each side's substitutions."""
    subs = events.where("event_type = 'SUBSTITUTION'")
    rows = _event_totals(contests, subs, {"k": F.count("*"), "m": F.sum("minute")})
    rows = _zero(prior(rows, {"subs_n": F.sum("k"), "subs_sum": F.sum("m")}, ["e", "season"]), ["subs_n"])
    return repivot(rows.withColumn("subs_mean", F.when(F.col("subs_n") > 0, F.col("subs_sum") / F.col("subs_n"))), ["subs_n", "subs_mean"])


def asof_last_state(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = ("e", "season")) -> DataFrame:
    """Adds previous_id, previous_d and previous_<value>: the last row of earlier dates; the greatest id on that date."""
    w = W.partitionBy(*keys).orderBy("d", by_id()).rowsBetween(-1, -1)
    last = {"previous_id": F.max(ID).over(w), "previous_d": F.max("d").over(w)}
    return at_first_of_date(rows, last | {f"previous_{v}": F.max(v).over(w) for v in values}, keys)


def workload_windows(contests: DataFrame, squads: DataFrame, windows: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Minutes that the previous squad played in the trailing windows: sum and players with history, all and starters.

    squads (contest_id, d, season, e, player, starter, minutes). Squads are shuffled once, by season and entity, together with a row per
    contest that is the last one before a date. Within these partitions a contest's players get that date by a window, and a player's
    windows are differences of running sums up to the days before it, so that no player meets their other days in a join.
    """
    group = ["season", "e"]
    rows = asof_last_state(appearances(contests), []).select(ID, "d", *group, "side", "previous_id").where("previous_id IS NOT NULL")
    last = rows.select(F.col("previous_id").alias(ID), *group, F.col("d").alias("next")).distinct()
    squad = squads.select(ID, *group, F.unix_date("d").alias("day"), "player", "starter", "minutes")
    both = squad.withColumn("squad", F.lit(True)).unionByName(last, allowMissingColumns=True).where("season IS NOT NULL AND e IS NOT NULL").repartition(*group)
    at = F.unix_date(F.max("next").over(W.partitionBy(*group, ID)))
    both = both.withColumn("at", at).where("squad")
    # a player's day, and what it is asked for: the day of the next contest
    kinds = F.array(
        F.struct(F.col("day").alias("day"), F.col("minutes").alias("played"), F.lit(False).alias("asked")),
        F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("day"), F.lit(None).cast(dict(squads.dtypes)["minutes"]).alias("played"), F.lit(True).alias("asked"))),
    )
    days = both.select(ID, *group, "player", "starter", F.inline(F.array_compact(kinds)))
    before = lambda n: W.partitionBy(*group, "player").orderBy("day").rangeBetween(W.unboundedPreceding, -n)
    until = {n: F.struct(F.coalesce(F.sum("played").over(before(n)), F.lit(0)).alias("s"), F.count("played").over(before(n)).alias("n")) for n in (1, *[n + 1 for n in windows])}
    days = days.withColumns({f"_{n}": x for n, x in until.items()}).where("asked")
    known = lambda n: F.col("player").isNotNull() & (F.col("_1.n") > F.col(f"_{n + 1}.n"))
    days = days.withColumns({f"m{n}": F.when(known(n), F.col("_1.s") - F.col(f"_{n + 1}.s")) for n in windows})
    out = days.groupBy(*group, ID, "day").agg(*[
        f for n in windows for f in (
            F.coalesce(F.sum(f"m{n}"), F.lit(0)).alias(f"squad_minutes_{n}"), F.count(f"m{n}").alias(f"squad_known_{n}"),
            F.coalesce(F.sum(F.when(F.col("starter"), F.col(f"m{n}"))), F.lit(0)).alias(f"starter_minutes_{n}"),
        )
    ])
    values = [x for x in out.columns if x not in (ID, "day", *group)]
    out = out.withColumnRenamed(ID, "previous_id").withColumn("d", F.date_from_unix_date("day")).drop("day")
    return repivot(rows.join(out, ["previous_id", *group, "d"]), values)


def lineup_overlap(lineups: DataFrame) -> DataFrame:
    """lineups (contest_id, d, e, side, xi array): players shared by the last two line-ups before; null under two."""
    w = W.partitionBy("e").orderBy("d", by_id())
    rows = at_first_of_date(lineups, {"x1": F.lag("xi", 1).over(w), "x2": F.lag("xi", 2).over(w)}, ["e"])
    return repivot(rows.withColumn("overlap", F.when(F.col("x2").isNotNull(), F.size(F.array_intersect("x1", "x2")))), ["overlap"])


def tenure_streak(staff: DataFrame) -> DataFrame:
    """staff (contest_id, d, e, side, value nullable): known, change known, changed, and earlier contests in a row with it."""
    w = W.partitionBy("e").orderBy("d", by_id())
    before = F.lag("value").over(w)
    rows = staff.withColumn("previous", before)
    new = F.col("value").isNull() | F.col("previous").isNull() | (F.col("value") != F.col("previous"))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy("e", "island").orderBy("d", by_id())) - 1
    known = F.col("value").isNotNull() & F.col("previous").isNotNull()
    return rows.select(
        ID, "e", "side", F.col("value").isNotNull().alias("known"), known.alias("change_known"),
        F.when(known, F.col("value") != F.col("previous")).otherwise(False).alias("changed"),
        F.when(F.col("value").isNotNull(), nth).otherwise(0).alias("tenure"),
    )


def transition_events(staff: DataFrame) -> DataFrame:
    """(e, previous_id, contest_id, old, new) wherever the known value of an entity changes."""
    w = W.partitionBy("e").orderBy("d", by_id())
    rows = staff.where("value is not null").select(
        "e", F.lag(ID).over(w).alias("previous_id"), ID, F.lag("value").over(w).alias("old_value"), F.col("value").alias("new_value")
    )
    return rows.where("old_value <> new_value")


def appearance_ordinal(contests: DataFrame, first: int = 5) -> DataFrame:
    """Which contest of the season it is for each side, whether it is one of the first ones, and what the sides were the season before.

    A side's status is ESTABLISHED if it played the season before, RETURNING if in an earlier one, else FIRST_TIME_IN_SCOPE.
    """
    rows = appearances(contests)
    w = W.partitionBy("e", "season").orderBy("d", by_id())
    seasons = rows.select("season", "e").distinct().withColumn("before", F.lag("season").over(W.partitionBy("e").orderBy("season")))
    status = F.when(F.col("before") == F.col("season") - 1, "ESTABLISHED").when(F.col("before").isNotNull(), "RETURNING").otherwise("FIRST_TIME_IN_SCOPE")
    rows = rows.withColumn("ordinal", F.row_number().over(w)).join(seasons.select("season", "e", status.alias("status")), ["season", "e"])
    out = repivot(rows, ["ordinal", "status"])
    h, a = F.col("home_ordinal") <= first, F.col("away_ordinal") <= first
    old = lambda s, x: F.col(f"{s}_status") == x
    return out.withColumns({
        "home_early": h, "away_early": a, "any_early": h | a, "both_early": h & a,
        "promoted_involved": ~old("home", "ESTABLISHED") | ~old("away", "ESTABLISHED"), "returning_involved": old("home", "RETURNING") | old("away", "RETURNING"),
        "established_only": old("home", "ESTABLISHED") & old("away", "ESTABLISHED"),
    })


def first_seen(contests: DataFrame) -> DataFrame:
    return appearances(contests).groupBy("e").agg(F.min("season").alias("first_season"))


def min_ordinal_promoted(contests: DataFrame) -> DataFrame:
    """The smaller season ordinal among the sides that weren't there the season before; null if neither is new.

    Nobody is new in the first season of the data. Sides that return after a gap are new again.
    """
    rows = appearances(contests)
    members = rows.select("season", "e").distinct()
    stayed = members.select((F.col("season") + 1).alias("season"), "e", F.lit(True).alias("stayed"))
    start = F.broadcast(members.agg(F.min("season").alias("start")))
    new = members.join(stayed, ["season", "e"], "left").crossJoin(start).where("stayed IS NULL AND season > start").select("season", "e", F.lit(True).alias("new"))
    w = W.partitionBy("e", "season").orderBy("d", by_id())
    nth = rows.withColumn("ordinal", F.row_number().over(w)).join(new, ["season", "e"], "left")
    return nth.groupBy(ID).agg(F.min(F.when(F.col("new"), F.col("ordinal"))).alias("min_ordinal"))


def next_batch(schedule: DataFrame, status: str = "status", done: str = "completed") -> DataFrame:
    """All unfinished rows of the nearest date that has any."""
    left = schedule.where(F.col(status) != done)
    return left.join(F.broadcast(left.agg(F.min("d").alias("d"))), "d")


def previous_batch(schedule: DataFrame, status: str = "status", done: str = "completed") -> DataFrame:
    """All finished rows of the latest date that has any."""
    past = schedule.where(F.col(status) == done)
    return past.join(F.broadcast(past.agg(F.max("d").alias("d"))), "d")
