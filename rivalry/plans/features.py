"""Queries of the as-of features and the SQL that checks them, mostly by self joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.core.asof import appearances
from rivalry.operators import features as O
from rivalry.plans.base import Registry, last_sql, pivot_sql

R = Registry()

PTS = "CASE WHEN b.gf > b.ga THEN 3 WHEN b.gf = b.ga THEN 1 WHEN b.gf < b.ga THEN 0 END"


def isum(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


FORM_SQL = {
    "points": isum(PTS), "wins": isum("CASE WHEN b.gf > b.ga THEN 1 ELSE 0 END"), "draws": isum("CASE WHEN b.gf = b.ga THEN 1 ELSE 0 END"),
    "losses": isum("CASE WHEN b.gf < b.ga THEN 1 ELSE 0 END"), "gf_sum": isum("b.gf"), "ga_sum": isum("b.ga"), "played": "count(b.gf)",
}

R.add("form_lastn", lambda v: O.form_lastn(v("contests")), f"WITH f AS ({last_sql(5, FORM_SQL)}) {pivot_sql('f', FORM_SQL)}")

TARGETS = "contest_id % 5 = 0"


def targets(v):
    return v("contests").where(TARGETS).select("contest_id", "d", "home", "away")


R.add(
    "form_asof_targets",
    lambda v: O.form_asof_targets(v("contests").where(f"NOT ({TARGETS})"), targets(v)),
    f"""WITH h AS (SELECT * FROM {{appearances}} WHERE NOT ({TARGETS})), t AS (SELECT * FROM {{appearances}} WHERE {TARGETS}),
f AS ({last_sql(5, FORM_SQL, base="t", hist="h")}) {pivot_sql('f', FORM_SQL)}""",
)
VENUE = {"venue_points": isum(PTS), "venue_goal_diff": isum("b.gf - b.ga")}
R.add(
    "venue_form", lambda v: O.venue_form(v("contests")),
    f"WITH f AS ({last_sql(5, VENUE, 'b.e = a.e AND b.side = a.side')}) {pivot_sql('f', VENUE)}",
)
PLACE = {"place_n": "count(b.gf)", "place_points": isum(PTS), "place_goal_diff": isum("b.gf - b.ga")}
R.add(
    "place_form", lambda v: O.place_form(v("contests"), 5),
    f"WITH f AS ({last_sql(5, PLACE, 'b.e = a.e AND b.place = a.place')}) {pivot_sql('f', PLACE)}",
)
PAIR = "LEFT JOIN (SELECT * FROM (SELECT a.contest_id AS aid, b.*, row_number() OVER (PARTITION BY a.contest_id ORDER BY b.d DESC, CAST(b.contest_id AS VARCHAR) DESC) AS k FROM {contests} a JOIN {contests} b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away) AND b.d < a.d) x) b ON b.aid = a.contest_id"
TURN = "CASE WHEN b.home = a.home THEN 1 ELSE -1 END"
PD = "CASE WHEN b.home_score > b.away_score THEN 3 WHEN b.home_score < b.away_score THEN -3 ELSE 0 END"
H2H = f"""SELECT a.contest_id, count(b.contest_id) AS h2h_n, {isum(f"{TURN} * ({PD})")} AS h2h_points_diff,
{isum(f"{TURN} * (b.home_score - b.away_score)")} AS h2h_goal_diff FROM {{contests}} a {PAIR} AND b.k <= 5 GROUP BY a.contest_id"""
R.add("h2h_lastn", lambda v: O.h2h_lastn(v("contests")), H2H)
R.add(
    "h2h_cumulative", lambda v: O.h2h_cumulative(v("contests")),
    f"""SELECT a.contest_id, count(b.contest_id) AS h2h_played,
{isum("CASE WHEN (b.result = 2 AND b.home = a.home) OR (b.result = 0 AND b.away = a.home) THEN 1 ELSE 0 END")} AS h2h_home_wins,
{isum("CASE WHEN b.result = 1 THEN 1 ELSE 0 END")} AS h2h_draws, max(CASE WHEN b.k = 1 THEN b.contest_id END) AS h2h_previous_id,
max(b.d) AS h2h_previous_date, count(b.contest_id) > 0 AS h2h_available FROM {{contests}} a {PAIR} GROUP BY a.contest_id""",
)


def stats(v):
    return v("contests").select(
        "contest_id", (F.col("contest_id") % 11).alias("home_shots"), (F.col("contest_id") % 7).alias("away_shots"),
        (F.col("contest_id") % 5).alias("home_corners"), (F.col("contest_id") % 3).alias("away_corners"),
        (F.col("contest_id") % 13).alias("home_fouls"), (F.col("contest_id") % 9).alias("away_fouls"),
    )


def _stat(home: int, away: int, own: bool) -> str:
    a, b = (home, away) if own else (away, home)
    return f"CASE WHEN b.side = 'home' THEN b.contest_id % {a} ELSE b.contest_id % {b} END"


STATS = {}
for _name, (_h, _a) in {"shots": (11, 7), "corners": (5, 3), "fouls": (13, 9)}.items():
    STATS |= {f"{_name}_for": isum(_stat(_h, _a, True)), f"{_name}_against": isum(_stat(_h, _a, False)), f"{_name}_diff": f"{isum(_stat(_h, _a, True))} - {isum(_stat(_h, _a, False))}"}
R.add(
    "stats_lastn", lambda v: O.stats_lastn(v("contests"), stats(v), ["shots", "corners", "fouls"]),
    f"WITH f AS ({last_sql(5, STATS)}) {pivot_sql('f', STATS)}",
)

XG = """WITH x AS (SELECT contest_id, d, home AS e, 'home' AS side, home_xg AS gf, away_xg AS ga, eligible FROM {xg_obs}
UNION ALL SELECT contest_id, d, away, 'away', away_xg, home_xg, eligible FROM {xg_obs}), """
XG_AGG = {"n_history": "count(b.gf)", "xg_for": "CASE WHEN count(b.gf) = 5 THEN avg(b.gf) END", "xg_against": "CASE WHEN count(b.gf) = 5 THEN avg(b.ga) END"}
XG_MEANS = [f"{s}_{x}" for s in ("home", "away") for x in ("xg_for", "xg_against")]
R.add(
    "xg_lastn_mean", lambda v: O.xg_lastn_mean(v("xg_obs")),
    XG + f"""h AS (SELECT * FROM x WHERE eligible), f1 AS ({last_sql(5, XG_AGG, base="x", hist="h")}),
no AS (SELECT * FROM x WHERE NOT eligible), f2 AS ({last_sql(None, {"excluded": "count(b.gf)"}, base="x", hist="no")}),
f AS (SELECT f1.*, f2.excluded FROM f1 JOIN f2 USING (contest_id, side)), p AS ({pivot_sql("f", [*XG_AGG, "excluded"])})
SELECT *, home_xg_for IS NOT NULL AND away_xg_for IS NOT NULL AS pair_available FROM p""",
    XG_MEANS,
)
R.add(
    "xg_asof_targets",
    lambda v: O.xg_asof_targets(v("xg_obs").where(f"NOT ({TARGETS})"), targets(v)),
    XG + f"""h AS (SELECT * FROM x WHERE eligible AND NOT ({TARGETS})), t AS (SELECT * FROM x WHERE {TARGETS}),
f AS ({last_sql(5, XG_AGG, base="t", hist="h")}), p AS ({pivot_sql("f", XG_AGG)})
SELECT *, home_xg_for IS NOT NULL AND away_xg_for IS NOT NULL AS pair_available FROM p""",
    XG_MEANS,
)
USED = {"used": "coalesce(string_agg(CAST(b.contest_id AS VARCHAR), ',' ORDER BY b.d, CAST(b.contest_id AS VARCHAR)), '')"}
R.add("history_audit", lambda v: O.history_audit(v("contests")), f"WITH f AS ({last_sql(5, USED)}) {pivot_sql('f', USED)}")

GAP = "date_diff('day', max(b.d), a.d)"
R.add(
    "schedule_gap", lambda v: O.schedule_gap(v("contests")),
    f"""WITH f AS ({last_sql(None, {"gap": GAP}, keep="a.side, a.d")}), p AS ({pivot_sql("f", ["gap"])})
SELECT contest_id, coalesce(home_gap, 0) AS home_gap, coalesce(away_gap, 0) AS away_gap, home_gap IS NOT NULL AS home_known,
away_gap IS NOT NULL AS away_known, coalesce(home_gap - away_gap, 0) AS gap_diff FROM p""",
)
R.add(
    "multi_stream_rest", lambda v: O.multi_stream_rest(v("contests")),
    f"""WITH o AS ({last_sql(None, {"own_gap": GAP}, "b.e = a.e AND b.competition = a.competition", keep="a.side, a.d")}),
y AS ({last_sql(None, {"any_gap": GAP}, keep="a.side, a.d")})
SELECT a.contest_id, a.e, a.side, a.competition, own_gap, any_gap, CASE WHEN any_gap IS NULL THEN 'no_previous_domestic' WHEN own_gap IS NULL THEN 'no_previous_league'
WHEN any_gap = own_gap THEN 'equal' WHEN any_gap < own_gap THEN 'shorter' ELSE 'domestic_longer' END AS category
FROM {{appearances}} a JOIN o ON o.contest_id = a.contest_id AND o.side = a.side JOIN y ON y.contest_id = a.contest_id AND y.side = a.side""",
)
R.add(
    "rest_with_completed_targets",
    lambda v: O.rest_with_completed_targets(v("contests").where(f"NOT ({TARGETS})"), targets(v)),
    f"""WITH t AS (SELECT * FROM {{appearances}} WHERE {TARGETS}), f AS ({last_sql(None, {"rest": GAP}, base="t", hist="{appearances}", keep="a.side, a.d")})
{pivot_sql("f", ["rest"])}""",
)


def rated(v):
    return appearances(v("contests")).withColumn("rating", (1500 + (F.col("e") * 13 + F.col("contest_id")) % 97).cast("double"))


R.add(
    "rating_momentum", lambda v: O.rating_momentum(rated(v)),
    f"""WITH r AS (SELECT *, CAST(1500 + (e * 13 + contest_id) % 97 AS DOUBLE) AS rating FROM {{appearances}}),
f0 AS ({last_sql(5, {"oldest": "arg_max(b.rating, b.k)", "momentum_n": "count(b.rating)"}, base="r", keep="a.side, a.rating")}),
f AS (SELECT contest_id, side, momentum_n, coalesce(rating - oldest, 0) AS momentum FROM f0) {pivot_sql("f", ["momentum", "momentum_n"])}""",
    ["home_momentum", "away_momentum"],
)
DR = "CAST(sum(CASE WHEN b.result = 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(b.result), 0)"
R.add(
    "draw_rates", lambda v: O.draw_rates(v("contests")),
    f"""WITH l AS ({last_sql(5, {"last_rate": DR, "last_n": "count(b.result)"})}),
s AS ({last_sql(None, {"season_rate": DR, "season_n": "count(b.result)"}, "b.e = a.e AND b.season = a.season")}),
f AS (SELECT l.*, s.season_rate, s.season_n FROM l JOIN s USING (contest_id, side)), p AS ({pivot_sql("f", ["last_rate", "season_rate", "last_n", "season_n"])})
SELECT *, (home_last_rate + away_last_rate) / 2 AS last_mean, (home_season_rate + away_season_rate) / 2 AS season_mean,
abs(home_last_rate - away_last_rate) AS last_distance, abs(home_season_rate - away_season_rate) AS season_distance FROM p""",
    [f"{s}_{k}_rate" for s in ("home", "away") for k in ("last", "season")] + [f"{k}_{x}" for k in ("last", "season") for x in ("mean", "distance")],
)
SEASON = "b.e = a.e AND b.season = a.season"
R.add(
    "discipline_rates", lambda v: O.discipline_rates(v("contests"), v("contest_events")),
    f"""WITH p AS (SELECT contest_id, e, sum(CASE WHEN event_type = 'YELLOW_CARD' THEN 1 ELSE 0 END) AS y, sum(CASE WHEN event_type = 'RED_CARD' THEN 1 ELSE 0 END) AS r
FROM {{contest_events}} GROUP BY 1, 2), t AS (SELECT a.*, coalesce(p.y, 0) AS y, coalesce(p.r, 0) AS r FROM {{appearances}} a LEFT JOIN p USING (contest_id, e)),
f AS ({last_sql(None, {"n": "count(b.e)", "yellow_rate": "CAST(sum(b.y) AS DOUBLE) / nullif(count(b.e), 0)", "red_rate": "CAST(sum(b.r) AS DOUBLE) / nullif(count(b.e), 0)"}, SEASON, base="t")}),
q AS ({pivot_sql("f", ["yellow_rate", "red_rate", "n"])}) SELECT *, home_n > 0 AND away_n > 0 AS available FROM q""",
    [f"{s}_{k}_rate" for s in ("home", "away") for k in ("yellow", "red")],
)
FIRST = """g AS (SELECT contest_id, side, half * 1000000 + minute * 1000 + added AS o FROM {contest_events} WHERE event_type = 'GOAL'),
m AS (SELECT contest_id, min(CASE WHEN side = 'home' THEN o END) AS h, min(CASE WHEN side = 'away' THEN o END) AS a FROM g GROUP BY 1),
fs AS (SELECT k.contest_id, CASE WHEN k.contest_id % 53 = 0 THEN 'NOT_CHECKABLE' WHEN h IS NULL AND a IS NULL THEN 'NO_EVENT' WHEN a IS NULL THEN 'home' WHEN h IS NULL THEN 'away'
WHEN h = a THEN 'AMBIGUOUS' WHEN h < a THEN 'home' ELSE 'away' END AS first_side FROM {contests} k LEFT JOIN m USING (contest_id))"""
unseen = lambda v: v("contests").where("contest_id % 53 = 0")
R.add("first_event_side", lambda v: O.first_event_side(v("contests"), v("contest_events"), not_checkable=unseen(v)), f"WITH {FIRST} SELECT * FROM fs")
FEP = {
    "n": "count(CASE WHEN b.first_side NOT IN ('AMBIGUOUS', 'NOT_CHECKABLE') THEN 1 END)", "scored": "count(CASE WHEN b.first_side = b.side THEN 1 END)",
    "conceded": "count(CASE WHEN b.first_side IN ('home', 'away') AND b.first_side <> b.side THEN 1 END)",
    "goalless": "count(CASE WHEN b.first_side = 'NO_EVENT' THEN 1 END)",
}
FEP_RATES = [f"{x}_rate" for x in ("scored", "conceded", "goalless")]
R.add(
    "first_event_profile", lambda v: O.first_event_profile(v("contests"), v("contest_events"), unseen(v)),
    f"""WITH {FIRST}, t AS (SELECT a.*, fs.first_side FROM {{appearances}} a JOIN fs USING (contest_id)), f0 AS ({last_sql(None, FEP, SEASON, base="t")}),
f AS (SELECT *, {", ".join(f"CAST({x} AS DOUBLE) / nullif(n, 0) AS {x}_rate" for x in ("scored", "conceded", "goalless"))} FROM f0)
{pivot_sql("f", [*FEP, *FEP_RATES])}""",
    [f"{s}_{x}" for s in ("home", "away") for x in FEP_RATES],
)
TIMING = {
    "first_n": "count(b.first)", "first_sum": "CAST(coalesce(sum(b.first), 0) AS BIGINT)", "scored_sum": isum("b.sm"), "conceded_sum": isum("b.cm"), "first_mean": "avg(b.first)", "scored_n": isum("b.sk"), "scored_mean": "CAST(sum(b.sm) AS DOUBLE) / nullif(sum(b.sk), 0)",
    "conceded_n": isum("b.ck"), "conceded_mean": "CAST(sum(b.cm) AS DOUBLE) / nullif(sum(b.ck), 0)",
}
R.add(
    "event_timing_profile", lambda v: O.event_timing_profile(v("contests"), v("contest_events")),
    f"""WITH g AS (SELECT contest_id, side, minute FROM {{contest_events}} WHERE event_type = 'GOAL'), o AS (SELECT contest_id, min(minute) AS first FROM g GROUP BY 1),
p AS (SELECT contest_id, side, count(*) AS k, sum(minute) AS m FROM g GROUP BY 1, 2),
t AS (SELECT a.*, o.first, x.k AS sk, x.m AS sm, y.k AS ck, y.m AS cm FROM {{appearances}} a LEFT JOIN o USING (contest_id)
LEFT JOIN p x ON x.contest_id = a.contest_id AND x.side = a.side LEFT JOIN p y ON y.contest_id = a.contest_id AND y.side <> a.side),
f AS ({last_sql(None, TIMING, SEASON, base="t")}) {pivot_sql("f", TIMING)}""",
    [f"{s}_{k}_mean" for s in ("home", "away") for k in ("first", "scored", "conceded")],
)
SUBS = {"subs_n": isum("b.k0"), "subs_mean": "CAST(sum(b.m0) AS DOUBLE) / nullif(sum(b.k0), 0)"}
R.add(
    "substitution_profile", lambda v: O.substitution_profile(v("contests"), v("contest_events")),
    f"""WITH p AS (SELECT contest_id, e, count(*) AS k0, sum(minute) AS m0 FROM {{contest_events}} WHERE event_type = 'SUBSTITUTION' GROUP BY 1, 2),
t AS (SELECT a.*, p.k0, p.m0 FROM {{appearances}} a LEFT JOIN p USING (contest_id, e)), f AS ({last_sql(None, SUBS, SEASON, base="t")}) {pivot_sql("f", SUBS)}""",
    ["home_subs_mean", "away_subs_mean"],
)
R.add(
    "asof_last_state", lambda v: O.asof_last_state(appearances(v("contests")), ["gf"]).select("contest_id", "e", "side", "previous_id", "previous_d", "previous_gf"),
    f"""WITH f AS ({last_sql(1, {"previous_id": "max(b.contest_id)", "previous_d": "max(b.d)", "previous_gf": "max(b.gf)"}, SEASON, keep="a.side, a.e")}) SELECT contest_id, e, side, previous_id, previous_d, previous_gf FROM f""",
)
WL = ", ".join(
    f"""{isum(f"m{n}")} AS squad_minutes_{n}, count(m{n}) AS squad_known_{n}, {isum(f"CASE WHEN starter THEN m{n} END")} AS starter_minutes_{n}""" for n in (7, 14, 30)
)
WLN = [f"{x}_{n}" for n in (7, 14, 30) for x in ("squad_minutes", "squad_known", "starter_minutes")]
R.add(
    "workload_windows", lambda v: O.workload_windows(v("contests"), v("squads")),
    f"""WITH pr AS ({last_sql(1, {"pid": "max(b.contest_id)"}, SEASON, keep="a.side, a.e, a.d, a.season")}),
tg AS (SELECT pr.contest_id, pr.side, pr.d, pr.season, pr.e, s.player, s.starter FROM pr JOIN {{squads}} s ON s.contest_id = pr.pid AND s.e = pr.e AND s.season = pr.season),
mm AS (SELECT tg.contest_id, tg.side, tg.player, tg.starter, {", ".join(f"sum(CASE WHEN date_diff('day', s.d, tg.d) <= {n} THEN s.minutes END) AS m{n}" for n in (7, 14, 30))}
FROM tg LEFT JOIN {{squads}} s ON s.season = tg.season AND s.e = tg.e AND s.player = tg.player AND s.d < tg.d AND date_diff('day', s.d, tg.d) <= 30 GROUP BY 1, 2, 3, 4),
f AS (SELECT contest_id, side, {WL} FROM mm GROUP BY 1, 2) {pivot_sql("f", WLN)}""",
)


def lineups(v):
    xi = v("squads").where("starter").groupBy("contest_id", "e").agg(F.collect_set("player").alias("xi"))
    return appearances(v("contests")).join(xi, ["contest_id", "e"])


R.add(
    "lineup_overlap", lambda v: O.lineup_overlap(lineups(v)),
    f"""WITH q AS (SELECT contest_id, e, list(DISTINCT player) AS xi FROM {{squads}} WHERE starter GROUP BY 1, 2),
t AS (SELECT a.*, q.xi FROM {{appearances}} a JOIN q USING (contest_id, e)),
f0 AS ({last_sql(2, {"x1": "max(CASE WHEN b.k = 1 THEN b.xi END)", "x2": "max(CASE WHEN b.k = 2 THEN b.xi END)"}, base="t")}),
f AS (SELECT contest_id, side, CASE WHEN x2 IS NOT NULL THEN len(list_intersect(x1, x2)) END AS overlap FROM f0) {pivot_sql("f", ["overlap"])}""",
)
STAFF = "CASE WHEN contest_id % 10 = 0 THEN NULL ELSE e * 10 + month(d) // 4 END"


def staff(v):
    return appearances(v("contests")).withColumn("value", F.expr(STAFF.replace("//", "DIV")))


ISL = f"""WITH s AS (SELECT *, {STAFF} AS value FROM {{appearances}}),
b AS (SELECT *, lag(value) OVER w AS previous, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY e ORDER BY d, CAST(contest_id AS VARCHAR))), """
R.add(
    "tenure_streak", lambda v: O.tenure_streak(staff(v)),
    ISL + """k AS (SELECT e, rn FROM b WHERE value IS NULL OR previous IS NULL OR value <> previous)
SELECT contest_id, b.e, side, value IS NOT NULL AS known, value IS NOT NULL AND previous IS NOT NULL AS change_known,
coalesce(value <> previous, false) AS changed, CASE WHEN value IS NULL THEN 0 ELSE b.rn - (SELECT max(k.rn) FROM k WHERE k.e = b.e AND k.rn <= b.rn) END AS tenure FROM b""",
)
R.add(
    "transition_events", lambda v: O.transition_events(staff(v)),
    f"""WITH s AS (SELECT *, {STAFF} AS value FROM {{appearances}}), n AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY d, CAST(contest_id AS VARCHAR)) AS rn FROM s WHERE value IS NOT NULL)
SELECT x.e, y.contest_id AS previous_id, x.contest_id, y.value AS old_value, x.value AS new_value FROM n x JOIN n y ON y.e = x.e AND y.rn = x.rn - 1 WHERE x.value <> y.value""",
)
ORD = "o AS (SELECT *, row_number() OVER (PARTITION BY e, season ORDER BY d, CAST(contest_id AS VARCHAR)) AS ordinal FROM {appearances})"
R.add(
    "appearance_ordinal", lambda v: O.appearance_ordinal(v("contests")),
    f"""WITH {ORD}, m AS (SELECT DISTINCT season, e FROM {{appearances}}), t AS (SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.e = o.e AND m.season = o.season - 1) THEN 'ESTABLISHED'
WHEN EXISTS (SELECT 1 FROM m WHERE m.e = o.e AND m.season < o.season) THEN 'RETURNING' ELSE 'FIRST_TIME_IN_SCOPE' END AS status FROM o), p AS ({pivot_sql("t", ["ordinal", "status"])}) SELECT *, home_ordinal <= 5 AS home_early, away_ordinal <= 5 AS away_early,
home_ordinal <= 5 OR away_ordinal <= 5 AS any_early, home_ordinal <= 5 AND away_ordinal <= 5 AS both_early, home_status <> 'ESTABLISHED' OR away_status <> 'ESTABLISHED' AS promoted_involved,
home_status = 'RETURNING' OR away_status = 'RETURNING' AS returning_involved, home_status = 'ESTABLISHED' AND away_status = 'ESTABLISHED' AS established_only FROM p""",
)
R.add("first_seen", lambda v: O.first_seen(v("contests")), "SELECT e, min(season) AS first_season FROM {appearances} GROUP BY e")
R.add(
    "min_ordinal_promoted", lambda v: O.min_ordinal_promoted(v("contests")),
    f"""WITH {ORD}, m AS (SELECT DISTINCT season, e FROM {{appearances}})
SELECT contest_id, min(CASE WHEN o.season > (SELECT min(season) FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.e = o.e AND m.season = o.season - 1) THEN ordinal END) AS min_ordinal FROM o GROUP BY contest_id""",
)
R.add(
    "next_batch", lambda v: O.next_batch(v("schedule_rev").where("rev = 2")),
    "SELECT * FROM {schedule_rev} WHERE rev = 2 AND status <> 'completed' AND d = (SELECT min(d) FROM {schedule_rev} WHERE rev = 2 AND status <> 'completed')",
)
R.add(
    "previous_batch", lambda v: O.previous_batch(v("schedule_rev").where("rev = 2")),
    "SELECT * FROM {schedule_rev} WHERE rev = 2 AND status = 'completed' AND d = (SELECT max(d) FROM {schedule_rev} WHERE rev = 2 AND status = 'completed')",
)
