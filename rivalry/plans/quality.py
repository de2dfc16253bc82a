"""Queries of the expectations and reports, on views with planted faults, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.core.asof import appearances
from rivalry.operators import coverage as C
from rivalry.operators import features as FE
from rivalry.operators import quality as O
from rivalry.operators import sketches as SK
from rivalry.plans.base import Registry, last_sql, pivot_sql, spread, stored

R = Registry()
ID = "contest_id"


def unions(*parts: tuple[str, str, str], keys: str = ID) -> str:
    """(rule, from, where) -> one SELECT for each rule."""
    return "\nUNION ALL ".join(f"SELECT {keys}, '{rule}' AS rule FROM {src} WHERE {cond}" for rule, src, cond in parts)


def faulty(v):
    k = v("contests")
    return k.withColumns({
        "home_score": F.when(F.col(ID) % 97 == 0, -1).otherwise(F.col("home_score")), "away": F.when(F.col(ID) % 101 == 0, F.col("home")).otherwise(F.col("away")),
        "d": F.when(F.col(ID) % 103 != 0, F.col("d")),
    }).unionByName(k.where(f"{ID} % 107 = 0"))


BAD = """k AS (SELECT contest_id, CASE WHEN contest_id % 103 <> 0 THEN d END AS d, season, home, CASE WHEN contest_id % 101 = 0 THEN home ELSE away END AS away, competition, place,
CASE WHEN contest_id % 97 = 0 THEN -1 ELSE home_score END AS home_score, away_score, result FROM {contests} UNION ALL SELECT * FROM {contests} WHERE contest_id % 107 = 0),
i AS (SELECT *, count(*) OVER (PARTITION BY contest_id) AS ni, count(*) OVER (PARTITION BY d, home, away) AS nk FROM k)"""
R.add(
    "expect_contests", lambda v: O.expect_contests(faulty(v)),
    f"WITH {BAD} " + unions(("missing_date", "i", "d IS NULL"), ("bad_score", "i", "home_score < 0"), ("result_differs", "i", "result <> sign(home_score - away_score) + 1"), ("same_sides", "i", "home = away"), ("duplicate_id", "i", "ni > 1"), ("duplicate_key", "i", "nk > 1 AND d IS NOT NULL")),
)
R.add("expect_no_same_day_dup", lambda v: O.expect_no_same_day_dup(v("contests")), "SELECT e, d, count(*) AS n FROM {appearances} GROUP BY 1, 2 HAVING count(*) > 1")
bent = lambda v: v("aliases").withColumns({"valid_to": F.when(F.col("entity_id") % 10 == 3, F.lit("1998-06-01").cast("date")).otherwise(F.col("valid_to")), "valid_from": F.when(F.col("entity_id") % 25 == 4, F.lit("1999-01-01").cast("date")).otherwise(F.col("valid_from"))})
named = lambda v: bent(v).withColumns({"canonical_name": F.concat(F.lit("C"), F.when(F.col("source_name") == "N7", 1).otherwise(F.col("entity_id") % 40)), "external_id": F.when(F.col("entity_id") % 9 == 0, F.col("entity_id") % 18)})
R.add(
    "expect_alias_intervals", lambda v: O.expect_alias_intervals(named(v).union(named(v).where("entity_id % 40 = 6").withColumn("source_name", F.lit("N7x")).withColumn("canonical_name", F.lit("other")))),
    """WITH a0 AS (SELECT *, concat('C', CASE WHEN source_name = 'N7' THEN 1 ELSE entity_id % 40 END) AS canonical_name, CASE WHEN entity_id % 9 = 0 THEN entity_id % 18 END AS external_id FROM {aliases}),
b AS (SELECT * FROM a0 UNION ALL SELECT * REPLACE ('N7x' AS source_name, 'other' AS canonical_name) FROM a0 WHERE entity_id % 40 = 6), a AS (SELECT canonical_name, external_id, entity_id, source_name, source, coalesce(CASE WHEN entity_id % 25 = 4 THEN DATE '1999-01-01' ELSE valid_from END, DATE '0001-01-01') AS lo, coalesce(CASE WHEN entity_id % 10 = 3 THEN DATE '1998-06-01' ELSE valid_to END, DATE '9999-12-31') AS hi FROM b)
SELECT source, source_name, entity_id, 'canonical_differs' AS rule FROM a x WHERE EXISTS (SELECT 1 FROM a y WHERE y.entity_id = x.entity_id AND y.canonical_name <> x.canonical_name) UNION ALL
SELECT source, source_name, entity_id, 'external_shared' FROM a x WHERE EXISTS (SELECT 1 FROM a y WHERE y.source = x.source AND y.external_id = x.external_id AND y.entity_id <> x.entity_id) UNION ALL
SELECT source, source_name, entity_id, 'reversed' AS rule FROM a WHERE lo > hi UNION ALL SELECT source, source_name, entity_id, 'overlap' FROM a x
WHERE EXISTS (SELECT 1 FROM a y WHERE y.source = x.source AND y.source_name = x.source_name AND (y.lo, y.hi, y.entity_id) < (x.lo, x.hi, x.entity_id) AND y.hi >= x.lo)""",
)
R.add(
    "expect_round_robin", lambda v: O.expect_round_robin(v("contests").withColumn("round", F.month("d")), ["season", "competition"], "round"),
    """WITH k AS (SELECT *, month(d) AS round FROM {contests}), a AS (SELECT season, competition, round, unnest([home, away]) AS e FROM k), e AS (SELECT DISTINCT season, competition, e FROM a), z AS (SELECT season, competition, count(*) AS z FROM e GROUP BY 1, 2),
p AS (SELECT x.season, x.competition, x.e, y.e AS o, (SELECT count(*) FROM k WHERE k.season = x.season AND k.competition = x.competition AND k.home = x.e AND k.away = y.e) AS n FROM e x JOIN e y ON x.season = y.season AND x.competition = y.competition AND x.e <> y.e),
r AS (SELECT season, competition, round, count(*) AS n FROM k GROUP BY 1, 2, 3), t AS (SELECT season, competition, e, round, count(*) AS n FROM a GROUP BY 1, 2, 3, 4)
SELECT season, competition, 'MISSING' AS problem, CAST(e AS VARCHAR) AS subject, count(*) AS n FROM p WHERE n = 0 GROUP BY ALL UNION ALL SELECT season, competition, 'REPEATED', CAST(e AS VARCHAR), count(*) FROM p WHERE n > 1 GROUP BY ALL
UNION ALL SELECT season, competition, 'ROUND_SIZE', CAST(round AS VARCHAR), n FROM r JOIN z USING (season, competition) WHERE n <> z // 2
UNION ALL SELECT season, competition, 'ROUND_APPEARANCES', CAST(e AS VARCHAR), q.rounds - count(CASE WHEN t.n = 1 THEN 1 END) FROM t JOIN (SELECT season, competition, count(DISTINCT round) AS rounds FROM k GROUP BY 1, 2) q USING (season, competition) GROUP BY season, competition, e, q.rounds HAVING q.rounds <> count(CASE WHEN t.n = 1 THEN 1 END)""",
)
odd = lambda v: v("contest_events").withColumns({"minute": F.when(F.col("event_id") % 61 == 0, 130).otherwise(F.col("minute")), "side": F.when(F.col("event_id") % 67 == 0, "both").otherwise(F.col("side"))})
ODD = "k AS (SELECT event_id, contest_id, e, event_type, half, CASE WHEN event_id % 61 = 0 THEN 130 ELSE minute END AS minute, CASE WHEN event_id % 67 = 0 THEN 'both' ELSE side END AS side FROM {contest_events}), i AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM k)"
KINDS = ["GOAL", "SUBSTITUTION", "YELLOW_CARD"]
R.add(
    "expect_events", lambda v: O.expect_events(odd(v), KINDS),
    f"WITH {ODD} " + unions(("unknown_kind", "i", "event_type = 'RED_CARD'"), ("minute_range", "i", "minute > 120"), ("half_differs", "i", "(minute > 45) <> (half = 1)"), ("bad_side", "i", "side = 'both'"), ("duplicate_id", "i", "n > 1"), keys="event_id"),
)
R.add(
    "expect_score_reconciles", lambda v: O.expect_score_reconciles(v("contests"), v("contest_events")),
    """SELECT k.contest_id, home_score, away_score, count(CASE WHEN v.event_type = 'GOAL' AND side = 'home' THEN 1 END) AS home_events, count(CASE WHEN v.event_type = 'GOAL' AND side = 'away' THEN 1 END) AS away_events
FROM {contests} k LEFT JOIN {contest_events} v USING (contest_id) GROUP BY 1, 2, 3 HAVING home_events <> home_score OR away_events <> away_score""",
)
R.add(
    "expect_no_ambiguous_order", lambda v: O.expect_no_ambiguous_order(v("contest_events")),
    "SELECT contest_id, e, half, minute, added, count(CASE WHEN event_type = 'SUBSTITUTION' THEN 1 END) AS n_first, count(CASE WHEN event_type = 'RED_CARD' THEN 1 END) AS n_second FROM {contest_events} GROUP BY 1, 2, 3, 4, 5 HAVING n_first > 0 AND n_second > 0",
)
broken = lambda v: FE.discipline_rates(v("contests"), v("contest_events")).where(f"{ID} % 89 <> 0").withColumn("home_red_rate", F.when(F.col(ID) % 83 != 0, F.col("home_red_rate")))
DISC = f"""WITH f AS ({last_sql(None, {"n": "count(b.e)"}, "b.e = a.e AND b.season = a.season")}), p AS ({pivot_sql("f", ["n"])}) """
R.add(
    "expect_features", lambda v: O.expect_features(broken(v), v("contests"), {"home_red_rate": "home_n", "away_red_rate": "away_n"}),
    DISC + unions(("missing", "p", "contest_id % 89 = 0"), ("home_red_rate_null_rule", "p", "contest_id % 89 <> 0 AND contest_id % 83 = 0 AND home_n > 0")),
)
R.add(
    "recount_history", lambda v: O.recount_history(v("contests")),
    """SELECT a.contest_id, CAST(count(CASE WHEN b.d < a.d THEN 1 END) AS BIGINT) AS earlier, count(CASE WHEN b.d = a.d THEN 1 END) - 1 AS same_date, count(CASE WHEN b.d > a.d THEN 1 END) AS later
FROM {contests} a JOIN {contests} b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away) GROUP BY 1""",
)
season = lambda v: v("contests").where(f"{ID} % 73 <> 0").select(ID, (F.col(ID) % 11 - F.when(F.col(ID) % 71 == 0, 20).otherwise(0)).alias("shots"), F.when(F.col(ID) % 79 != 0, F.col(ID) % 5).alias("corners"))
R.add(
    "expect_stats_season", lambda v: O.expect_stats_season(v("contests").where(f"{ID} % 69 <> 0"), season(v), ["shots", "corners"]),
    "WITH s AS (SELECT * FROM {contests}) " + unions(("no_statistics", "s", "contest_id % 73 = 0 AND contest_id % 69 <> 0"), ("no_contest", "s", "contest_id % 69 = 0 AND contest_id % 73 <> 0"), ("bad_shots", "s", "contest_id % 73 <> 0 AND contest_id % 71 = 0"), ("bad_corners", "s", "contest_id % 73 <> 0 AND contest_id % 79 = 0")),
)
ids = lambda v: v("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "foreign").when(F.col("c_custkey") % 31 == 0, "other").otherwise("local").alias("kind"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("l"), F.when(F.col("c_custkey") % 12 == 0, F.col("c_nationkey")).alias("f"))
R.add(
    "expect_identity_frame", lambda v: O.expect_identity_frame(ids(v), "c_custkey", "l", "f", "kind"),
    "WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'foreign' WHEN c_custkey % 31 = 0 THEN 'other' ELSE 'local' END AS kind, c_custkey % 4 <> 0 AS l, c_custkey % 12 = 0 AS f FROM {customer}) "
    + unions(("unknown_type", "s", "kind = 'other'"), ("local_id", "s", "(kind = 'local') <> l"), ("foreign_id", "s", "(kind = 'local') = f"), keys="c_custkey"),
)
P3 = ["p_away", "p_draw", "p_home"]
R.add(
    "expect_probabilities", lambda v: O.expect_probabilities(v("predictions").withColumn("p_home", F.when(F.col(ID) % 59 == 0, F.col("p_home") + 1).when(F.col(ID) % 53 != 0, F.col("p_home"))), ID, P3),
    unions(("out_of_range", "{contests}", "contest_id % 59 = 0 OR contest_id % 53 = 0"), ("sum", "{contests}", "contest_id % 59 = 0 OR contest_id % 53 = 0")),
)
folds = lambda v: v("contests").select(F.col("competition").alias("fold"), F.when((F.col("season") < 1997) | (F.col(ID) % 997 == 0), "train").otherwise("valid").alias("role"), ID, "d", "result").where("not (fold = 'BUILDING' and result = 1)")
R.add(
    "expect_fold_contract", lambda v: O.expect_fold_contract(folds(v)),
    """WITH f AS (SELECT competition AS fold, CASE WHEN season < 1997 OR contest_id % 997 = 0 THEN 'train' ELSE 'valid' END AS role, d, result FROM {contests} WHERE NOT (competition = 'BUILDING' AND result = 1)),
g AS (SELECT fold, max(CASE WHEN role = 'train' THEN d END) AS t, min(CASE WHEN role = 'valid' THEN d END) AS v, count(DISTINCT CASE WHEN role = 'train' THEN result END) AS k FROM f GROUP BY 1) """
    + unions(("overlap", "g", "t >= v"), ("missing_class", "g", "k < 3"), ("no_rows", "g", "t IS NULL OR v IS NULL"), keys="fold"),
)
means = lambda v, shift: v("predictions").groupBy("season").agg((F.avg("p_home") + F.when(F.col("season") == 1996, shift).otherwise(0)).alias("m"))
R.add("expect_metrics_equal", lambda v: O.expect_metrics_equal(means(v, 0), means(v, 1e-6), ["season"], ["m"]), "SELECT DISTINCT season, 'm' AS rule FROM {predictions} WHERE season = 1996")
R.add(
    "expect_feature_inputs", lambda v: O.expect_feature_inputs(odd(v), v("contests").where(f"{ID} % 47 <> 0")),
    f"WITH {ODD} " + unions(("unknown_contest", "i", "contest_id % 47 = 0"), ("bad_side", "i", "side = 'both'"), ("minute_range", "i", "minute > 120"), ("duplicate_id", "i", "n > 1"), keys="event_id"),
)
R.add(
    "expect_rest_consistent", lambda v: O.expect_rest_consistent(FE.schedule_gap(v("contests")).withColumn("home_gap", F.col("home_gap") + (F.col(ID) % 43 == 0).cast("int")), FE.schedule_gap(v("contests")), ["home_gap", "away_gap"]),
    "SELECT contest_id, 'home_gap' AS rule FROM {contests} WHERE contest_id % 43 = 0",
)
live = lambda v: v("schedule_rev").where("rev = 2").withColumns({"status": F.when(F.col("fixture_key") % 37 == 0, "lost").otherwise(F.col("status")), "score": F.when(F.col("fixture_key") % 41 != 0, F.col("score"))})
R.add(
    "expect_live_inputs", lambda v: O.expect_live_inputs(live(v), v("schedule_rev").where("rev = 2 and status = 'completed' and fixture_key % 29 <> 0").select("fixture_key"), ["completed", "candidate", "scheduled"]),
    """WITH s AS (SELECT fixture_key, d, CASE WHEN fixture_key % 37 = 0 THEN 'lost' ELSE status END AS status, status AS old, CASE WHEN fixture_key % 41 <> 0 THEN score END AS score FROM {schedule_rev} WHERE rev = 2) """
    + unions(("status", "s", "status = 'lost'"), ("score", "s", "status = 'completed' AND score IS NULL"), ("early_score", "s", "status = 'scheduled' AND score IS NOT NULL"),
             ("missing_in_completed", "s", "status = 'completed' AND fixture_key % 29 = 0"), ("not_completed", "s", "status = 'lost' AND old = 'completed' AND fixture_key % 29 <> 0"), keys="fixture_key"),
)
R.add(
    "expect_bindings", lambda v: O.expect_bindings(v("supplier").select(F.when(F.col("s_suppkey") % 13 == 0, " ").otherwise(F.col("s_name")).alias("a"), (F.col("s_suppkey") % 60).alias("b")), ["a", "b"], ["a", "b"]),
    """WITH s AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN ' ' ELSE s_name END AS a, s_suppkey % 60 AS b FROM {supplier}), n AS (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM s) """
    + unions(("blank_a", "n", "trim(a) = ''"), ("duplicate_a", "n", "na > 1"), ("duplicate_b", "n", "nb > 1"), keys="a"),
)
R.add(
    "expect_restart_from_group", lambda v: O.expect_rebuilt(v("contests").select(ID, F.when(F.col(ID) % 23 == 0, 1).otherwise(F.col("result")).alias("result")), v("contests").where(f"{ID} % 31 <> 0").select(ID, "result"), ID, ["result"]),
    "SELECT contest_id, CASE WHEN contest_id % 31 = 0 THEN 'missing' ELSE 'result' END AS rule FROM {contests} WHERE contest_id % 31 = 0 OR (contest_id % 23 = 0 AND result <> 1)",
)

# ---- reports
R.add(
    "contest_summary", lambda v: C.contest_summary(v("contests")),
    """SELECT competition, count(*) AS n, min(d) AS first, max(d) AS last, count(CASE WHEN result = 2 THEN 1 END) AS home_wins, count(CASE WHEN result = 1 THEN 1 END) AS draws, count(CASE WHEN result = 0 THEN 1 END) AS away_wins,
count(DISTINCT home) AS home_entities, count(DISTINCT season) AS seasons, 0 AS missing_scores FROM {contests} GROUP BY ROLLUP (competition)""",
)
PTS = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
R.add(
    "special_summary", lambda v: C.special_summary(v("contests").withColumn("stage", F.month("d") % 3), "stage", [0, 1, 2]).withColumnsRenamed({str(i): f"stage_{i}" for i in range(3)}),
    f"SELECT e, count(*) AS played, CAST(sum({PTS}) AS BIGINT) AS points, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, " + ", ".join(f"CAST(sum(CASE WHEN month(d) % 3 = {i} THEN {PTS} END) AS BIGINT) AS stage_{i}" for i in range(3)) + " FROM {appearances} GROUP BY e",
)
FORM = f"""WITH f AS ({last_sql(5, {"played": "count(b.gf)"}, keep="a.side, a.season")}), p AS (SELECT contest_id, season, max(CASE WHEN side = 'home' THEN played END) AS h, max(CASE WHEN side = 'away' THEN played END) AS a FROM f GROUP BY 1, 2) """
form = lambda v: FE.form_lastn(v("contests")).join(v("contests").select(ID, "season"), ID)
R.add(
    "availability_by_period", lambda v: C.availability_by_period(form(v), F.col("home_played") > 0, F.col("away_played") > 0),
    FORM + """SELECT season, count(*) AS n, CAST(sum((h > 0)::INT + (a > 0)::INT) AS BIGINT) AS sides, count(CASE WHEN h > 0 AND a > 0 THEN 1 END) AS pairs, count(CASE WHEN (h > 0) <> (a > 0) THEN 1 END) AS only_one, count(CASE WHEN h = 0 AND a = 0 THEN 1 END) AS none FROM p GROUP BY ROLLUP (season)""",
)
R.add(
    "count_bins", lambda v: C.count_bins(FE.h2h_cumulative(v("contests")), "h2h_played"),
    """WITH c AS (SELECT a.contest_id, count(b.contest_id) AS n FROM {contests} a LEFT JOIN {contests} b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away) AND b.d < a.d GROUP BY 1)
SELECT CASE WHEN n >= 10 THEN '10+' WHEN n >= 5 THEN '5-9' ELSE CAST(n AS VARCHAR) END AS bin, count(*) AS n FROM c GROUP BY 1""",
)
R.add(
    "coverage_season_global", lambda v: C.coverage_season_global(form(v), {"home": "home_played", "away": "away_played"}),
    FORM + "SELECT season, count(CASE WHEN x = 0 THEN 1 END) AS bin0, count(CASE WHEN x BETWEEN 1 AND 4 THEN 1 END) AS bin1, count(CASE WHEN x >= 5 THEN 1 END) AS bin2 FROM (SELECT season, h AS x FROM p UNION ALL SELECT season, a FROM p) q GROUP BY ROLLUP (season)",
)
R.add(
    "distribution", lambda v: C.distribution(FE.schedule_gap(v("contests")).join(v("contests").select(ID, "season"), ID).withColumn("x", F.when(F.col("home_known"), F.col("home_gap"))), "x", ["season"]),
    f"""WITH f AS ({last_sql(None, {"gap": "date_diff('day', max(b.d), a.d)"}, keep="a.side, a.d, a.season")}), x AS (SELECT season, gap FROM f WHERE side = 'home')
SELECT season, count(*) AS n, count(*) - count(gap) AS nulls, min(gap) AS lo, quantile_cont(gap, 0.5) AS median, avg(gap) AS mean, max(gap) AS hi, var_pop(gap) AS variance, count(DISTINCT gap) AS distinct_values,
(SELECT g FROM (SELECT y.gap AS g, count(*) AS c FROM x y WHERE y.season = x.season AND y.gap IS NOT NULL GROUP BY 1 ORDER BY c DESC, g LIMIT 1) q) AS mode FROM x GROUP BY season""",
    ["median", "mean", "variance"],
)
def profiles(v):
    """Profiles of each date's goals per contest, merged by season; the sketches are held against exact ranks and counts."""
    k = v("contests").select("season", "d", F.when(F.col("contest_id") % 10 != 3, F.col("contest_id") * 7 % 1009).cast("double").alias("x"))
    got = SK.described(SK.merged(stored(SK.profile(k, "x", ["season", "d"]), "profiles"), ["season"]), ["season"])
    at = k.join(F.broadcast(got.select("season", "median", "distinct_values")), "season").groupBy("season").agg(
        (F.count(F.when(F.col("x") <= F.col("median"), 1)) / F.count("x")).alias("_le"), (F.count(F.when(F.col("x") < F.col("median"), 1)) / F.count("x")).alias("_lt"), F.count_distinct("x").alias("_d"),
    )
    near = (F.col("_le") >= 0.5 - SK.RANK_ERROR) & (F.col("_lt") <= 0.5 + SK.RANK_ERROR)
    close = F.abs(F.col("distinct_values") - F.col("_d")) <= F.ceil(F.col("_d") * 4 * 1.04 / 2 ** (SK.LG / 2))
    return got.join(at, "season").select("season", "n", "nulls", "lo", "mean", "hi", "variance", near.alias("median_near"), close.alias("distinct_near"))


R.add(
    "coverage_profiles", profiles,
    "WITH x AS (SELECT season, CASE WHEN contest_id % 10 <> 3 THEN CAST(contest_id * 7 % 1009 AS DOUBLE) END AS x FROM {contests}) SELECT season, count(*) AS n, count(*) - count(x) AS nulls, min(x) AS lo, avg(x) AS mean, max(x) AS hi, var_pop(x) AS variance, true AS median_near, true AS distinct_near FROM x GROUP BY 1",
    ["mean", "variance"],
)
R.add(
    "source_audit", lambda v: C.source_audit(v("contests").where(f"{ID} % 19 <> 0"), v("contest_events").where(f"{ID} % 17 <> 0")),
    """SELECT (SELECT count(*) FROM {contests} WHERE contest_id % 19 <> 0) AS contests, count(*) AS events, count(CASE WHEN contest_id % 19 = 0 THEN 1 END) AS orphan_events,
(SELECT count(*) FROM {contests} WHERE contest_id % 19 <> 0 AND contest_id % 17 = 0) AS silent_contests, count(DISTINCT CASE WHEN event_type = 'GOAL' THEN contest_id END) AS with_goal FROM {contest_events} WHERE contest_id % 17 <> 0""",
)
R.add("event_type_report", lambda v: C.event_type_report(v("contest_events")), "SELECT event_type, season, count(*) AS n, count(DISTINCT contest_id) AS contests, 0 AS unresolved FROM {contest_events} GROUP BY 1, 2")


def roster(v):
    return spread(v, "squads", "appearances", ID).groupBy(ID, "e", "player").agg(F.max("starter").alias("starter"))


def moves(v):
    ev = v("contest_events").where("event_type in ('SUBSTITUTION', 'RED_CARD')")
    kind = F.when(F.col("event_type") == "RED_CARD", "red").when(F.col("event_id") % 2 == 0, "in").otherwise("out")
    return ev.select(ID, "e", (F.col("e") * 100 + (F.col(ID) + F.col("event_id") % 13 * 7) % 18).alias("player"), kind.alias("kind"), "minute")


PART = """r AS (SELECT contest_id, e, player, bool_or(starter) AS starter FROM {squads} GROUP BY 1, 2, 3),
m AS (SELECT contest_id, e, e * 100 + (contest_id + event_id % 13 * 7) % 18 AS player, min(CASE WHEN event_type = 'SUBSTITUTION' AND event_id % 2 = 0 THEN minute END) AS i,
min(CASE WHEN event_type = 'SUBSTITUTION' AND event_id % 2 = 1 THEN minute END) AS o, min(CASE WHEN event_type = 'RED_CARD' THEN minute END) AS rd FROM {contest_events} WHERE event_type IN ('SUBSTITUTION', 'RED_CARD') GROUP BY 1, 2, 3),
j AS (SELECT r.*, i, o, CASE WHEN o IS NULL OR rd <= o THEN rd END AS red, CASE WHEN starter THEN 0 ELSE i END AS entry FROM r LEFT JOIN m USING (contest_id, e, player)),
x AS (SELECT contest_id, e, player, starter, entry, CASE WHEN entry IS NOT NULL THEN least(coalesce(o, 90), coalesce(red, 90), 90) END AS exit, CASE WHEN entry IS NULL THEN 'UNUSED' WHEN red IS NOT NULL THEN 'DISMISSED'
WHEN starter AND o IS NULL THEN 'FULL' WHEN starter THEN 'SUBSTITUTED_OFF' WHEN o IS NULL THEN 'SUBSTITUTED_ON' ELSE 'ON_AND_OFF' END AS kind FROM j),
y AS (SELECT *, coalesce(greatest(exit - entry, 0), 0) AS minutes FROM x)"""
R.add("participation_intervals", lambda v: C.participation_intervals(roster(v), moves(v)), f"WITH {PART} SELECT * FROM y")
R.add(
    "minutes_conservation", lambda v: C.minutes_conservation(C.participation_intervals(roster(v), moves(v))),
    f"WITH {PART} SELECT contest_id, e, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(CASE WHEN kind = 'DISMISSED' THEN 90 - exit ELSE 0 END) AS BIGINT) AS lost, CAST(sum(minutes) + sum(CASE WHEN kind = 'DISMISSED' THEN 90 - exit ELSE 0 END) - 990 AS BIGINT) AS excess FROM y GROUP BY 1, 2 HAVING excess <> 0",
)


def legs(v):
    from pyspark.sql import Window as W

    lo, hi = F.least("home", "away"), F.greatest("home", "away")
    n = F.row_number().over(W.partitionBy(lo, hi, "season").orderBy("d", F.col(ID).cast("string")))
    k = v("contests").withColumns({"leg": n, "tie": F.concat_ws("-", F.col("season").cast("string"), lo.cast("string"), hi.cast("string"))}).where("leg <= 2")
    return k.select("tie", "leg", "home", "away", "home_score", "away_score", (F.col(ID) % 5).alias("ph"), (F.col(ID) % 3).alias("pa"))


R.add(
    "two_leg_tie", lambda v: C.two_leg_tie(legs(v)),
    """WITH l AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b, row_number() OVER (PARTITION BY season, least(home, away), greatest(home, away) ORDER BY d, CAST(contest_id AS VARCHAR)) AS leg FROM {contests}),
m AS (SELECT season, a, b, leg, CASE WHEN home = a THEN home_score ELSE away_score END AS fa, CASE WHEN home = a THEN away_score ELSE home_score END AS fb, CASE WHEN leg = 2 THEN CASE WHEN home = a THEN contest_id % 5 ELSE contest_id % 3 END END AS sa,
CASE WHEN leg = 2 THEN CASE WHEN home = a THEN contest_id % 3 ELSE contest_id % 5 END END AS sb FROM l WHERE leg <= 2),
t AS (SELECT concat_ws('-', CAST(season AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS tie, a, b, count(*) AS legs, CAST(sum(fa) AS BIGINT) AS ga, CAST(sum(fb) AS BIGINT) AS gb, sum((fa > fb)::INT) AS wa, sum((fb > fa)::INT) AS wb, max(sa) AS pa, max(sb) AS pb FROM m GROUP BY season, a, b)
SELECT tie, a, b, legs, ga, gb, CASE WHEN wa > wb THEN a WHEN wa < wb THEN b WHEN ga > gb THEN a WHEN ga < gb THEN b WHEN pa > pb THEN a WHEN pa < pb THEN b END AS winner,
CASE WHEN wa <> wb THEN 'wins' WHEN ga <> gb THEN 'aggregate' WHEN pa <> pb THEN 'shootout' ELSE 'undecided' END AS decided_by FROM t""",
)
found = lambda v: v("contests").where(f"{ID} % 4 <> 0").select(ID, F.col("home_score").alias("h"), F.col("away_score").alias("a")).union(v("contests").where(f"{ID} % 6 = 1").select(ID, F.col("home_score") + 1, F.col("away_score")))
R.add(
    "regulation_score", lambda v: C.regulation_score(v("contests").select(ID), found(v)),
    """WITH s AS (SELECT *, CASE WHEN contest_id % 4 = 0 AND contest_id % 6 <> 1 THEN 'UNRESOLVED' WHEN contest_id % 4 <> 0 AND contest_id % 6 = 1 THEN 'CONFLICT' ELSE 'CONFIRMED' END AS status FROM {contests})
SELECT contest_id, status, CASE WHEN status = 'CONFIRMED' THEN home_score END AS home_90, CASE WHEN status = 'CONFIRMED' THEN away_score END AS away_90 FROM s""",
)


def snaps(v):
    t = appearances(v("contests")).groupBy("e").agg(F.count("*").alias("all"))
    days = F.array(*[F.lit(f"{y}-07-01").cast("date") for y in range(1993, 1999)])
    s = t.select("e", F.posexplode(days).alias("snap", "d"))
    n = s.join(appearances(v("contests")).select("e", F.col("d").alias("on")), "e").where("on <= d").groupBy("e", "snap", "d").agg(F.count("*").alias("total"))
    return n.withColumn("total", F.col("total") + F.when((F.col("e") + F.col("snap")) % 9 == 0, 1).otherwise(0))


R.add(
    "interval_audit", lambda v: C.interval_audit(snaps(v), v("contests")),
    """WITH y AS (SELECT CAST(i AS INT) AS snap, make_date(1993 + i, 7, 1) AS d FROM range(0, 6) r(i)), s AS (SELECT a.e, y.snap, y.d, count(*) + CASE WHEN (a.e + y.snap) % 9 = 0 THEN 1 ELSE 0 END AS total FROM y JOIN {appearances} a ON a.d <= y.d GROUP BY 1, 2, 3),
l AS (SELECT *, lag(d) OVER w AS d0, lag(total) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY e ORDER BY d)), c AS (SELECT l.e, snap, l.d, total - t0 AS increment, (SELECT count(*) FROM {appearances} a WHERE a.e = l.e AND a.d > l.d0 AND a.d <= l.d) AS n FROM l WHERE d0 IS NOT NULL)
SELECT *, CASE WHEN increment <> n THEN 'IDENTITY' WHEN n = 0 THEN 'NONE' WHEN n = 1 THEN 'CLEAN' ELSE 'MULTI' END AS status FROM c""",
)
