"""Queries of the scalar functions and linking joins, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.core.asof import appearances
from rivalry.functions import scalar as S
from rivalry.operators import link as O
from rivalry.plans.base import Registry, spread

R = Registry()
K = ["contest_id"]

R.add("result_from_scores", lambda v: v("contests").select(*K, S.result_from_scores("home_score", "away_score").alias("r")), "SELECT contest_id, CAST(sign(home_score - away_score) + 1 AS INT) AS r FROM {contests}")
R.add("points", lambda v: appearances(v("contests")).select(*K, "side", S.points("gf", "ga").alias("points")), "SELECT contest_id, side, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM {appearances}")
R.add("unpivot_appearances", lambda v: appearances(v("contests")), "SELECT contest_id, d, season, competition, place, result, e, opp, side, gf, ga FROM {appearances}")
R.add(
    "repivot_sides",
    lambda v: v("appearances").groupBy(*K).agg(*[F.max(F.when(F.col("side") == s, F.col("gf") - F.col("ga"))).alias(f"{s}_diff") for s in ("home", "away")]),
    "SELECT contest_id, home_score - away_score AS home_diff, away_score - home_score AS away_diff FROM {contests}",
)
R.add(
    "minute_normalize",
    lambda v: v("contest_events").select("event_id", S.minute_parts(F.expr("concat(cast(minute as string), \"'\", case when added > 0 then concat('+', cast(added as string)) else '' end)")).alias("m")).select("event_id", "m.*"),
    "SELECT event_id, minute + added AS minute, CASE WHEN minute <= 45 THEN 0 ELSE 1 END AS half, minute AS base, added, added > 0 AS stoppage FROM {contest_events}",
)
SHOOT = "SELECT contest_id, home_score AS gf, away_score AS ga, contest_id % 5 AS pf, contest_id % 7 AS pa, contest_id % 3 AS ef, contest_id % 2 AS ea FROM {contests}"
shoot = lambda v: v("contests").select(*K, F.col("home_score").alias("gf"), F.col("away_score").alias("ga"), *[(F.col("contest_id") % n).alias(x) for n, x in ((5, "pf"), (7, "pa"), (3, "ef"), (2, "ea"))])
R.add(
    "shootout_points",
    lambda v: shoot(v).select(*K, S.shootout_points("gf", "ga", "pf", "pa").alias("points"), S.decision("gf", "ga", "ef", "ea", "pf", "pa").alias("decision")),
    f"""SELECT contest_id, CASE WHEN gf > ga THEN 3 WHEN gf < ga THEN 0 WHEN pf > pa THEN 2 WHEN pf < pa THEN 1 END AS points,
CASE WHEN gf <> ga THEN 'regulation' WHEN ef <> ea THEN 'extra_time' WHEN pf <> pa THEN 'penalties' ELSE 'draw' END AS decision FROM ({SHOOT}) s""",
)
R.add(
    "split_regulation",
    lambda v: shoot(v).select(*K, (F.col("gf") + F.when(F.col("gf") == F.col("ga"), F.col("ef")).otherwise(0)).alias("shown_home"), (F.col("ga") + F.when(F.col("gf") == F.col("ga"), F.col("ea")).otherwise(0)).alias("shown_away"), (F.col("gf") != F.col("ga")).alias("in_regulation")),
    f"SELECT contest_id, CASE WHEN gf = ga THEN gf + ef ELSE gf END AS shown_home, CASE WHEN gf = ga THEN ga + ea ELSE ga END AS shown_away, gf <> ga AS in_regulation FROM ({SHOOT}) s",
)
R.add(
    "per_basis_rate", lambda v: v("profiles").select("season", "e", "stat", (F.col("raw_value") / F.col("basis")).alias("rate")),
    "SELECT season, e, stat, CAST(raw_value AS DOUBLE) / basis AS rate FROM {profiles}", ["rate"],
)
R.add("season_phase", lambda v: v("contests").select(*K, S.season_phase(F.month("d") * 3).alias("phase")), "SELECT contest_id, CASE WHEN month(d) * 3 <= 5 THEN 'early' WHEN month(d) * 3 <= 29 THEN 'middle' ELSE 'late' END AS phase FROM {contests}")
R.add("pair_key", lambda v: v("contests").select(*K, S.pair_low("home", "away").alias("low"), S.pair_high("home", "away").alias("high")), "SELECT contest_id, least(home, away) AS low, greatest(home, away) AS high FROM {contests}")
R.add("orient_pair", lambda v: v("contests").select(*K, S.orient("home", S.pair_low("home", "away")).alias("sign")), "SELECT contest_id, CASE WHEN home < away THEN 1 ELSE -1 END AS sign FROM {contests}")
R.add(
    "attacker_view", lambda v: appearances(v("contests")).select(*K, "side", (F.when(F.col("side") == "home", 1).otherwise(-1) * F.when(F.col("side") == "home", F.col("e") - F.col("opp")).otherwise(F.col("opp") - F.col("e"))).alias("diff")),
    "SELECT contest_id, side, e - opp AS diff FROM {appearances}",
)
R.add("form_diffs", lambda v: v("contests").select(*K, (S.points("home_score", "away_score") - S.points("away_score", "home_score")).alias("points_diff"), (2 * (F.col("home_score") - F.col("away_score"))).alias("goal_diff")), "SELECT contest_id, CASE result WHEN 2 THEN 3 WHEN 1 THEN 0 ELSE -3 END AS points_diff, 2 * (home_score - away_score) AS goal_diff FROM {contests}")
R.add("rating_parity", lambda v: v("contests").select(*K, F.abs(F.col("home") - F.col("away")).alias("parity")), "SELECT contest_id, abs(home - away) AS parity FROM {contests}")
AGE = "date_diff('day', d, DATE '1998-12-31')"
age = lambda: F.datediff(F.lit("1998-12-31").cast("date"), "d")
HALF = (None, 180, 365, 730)
R.add(
    "time_decay_weight", lambda v: v("contests").select(*K, *[S.time_decay(age(), h).alias(f"w{h or 0}") for h in HALF]),
    f"SELECT contest_id, 1.0::DOUBLE AS w0, {', '.join(f'exp(-ln(2) * {AGE} / {h}.0) AS w{h}' for h in HALF if h)} FROM {{contests}}", ["w180", "w365", "w730"],
)
R.add(
    "decay_weight_summary",
    lambda v: v("contests").withColumn("w", S.time_decay(age(), 365)).groupBy("season").agg(F.min("w").alias("lo"), F.percentile("w", 0.5).alias("mid"), F.max("w").alias("hi"), (F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("effective")),
    f"WITH x AS (SELECT season, exp(-ln(2) * {AGE} / 365.0) AS w FROM {{contests}}) SELECT season, min(w) AS lo, quantile_cont(w, 0.5) AS mid, max(w) AS hi, pow(sum(w), 2) / sum(w * w) AS effective FROM x GROUP BY season", ["lo", "mid", "hi", "effective"],
)
R.add("expected_score", lambda v: v("contests").select(*K, S.expected_score(1500 + F.col("home"), 1500 + F.col("away")).alias("p")), "SELECT contest_id, 1 / (1 + pow(10, (away - home) / 400.0)) AS p FROM {contests}", ["p"])
R.add("row_fingerprint", lambda v: v("contests").select(*K, S.row_fingerprint("contest_id", "d", "home", "away", "result").alias("h")), "SELECT contest_id, sha256(concat_ws('|', CAST(contest_id AS VARCHAR), CAST(d AS VARCHAR), CAST(home AS VARCHAR), CAST(away AS VARCHAR), CAST(result AS VARCHAR))) AS h FROM {contests}")
R.add(
    "ordered_id_hash",
    lambda v: v("contests").groupBy("season", "competition").agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", F.col("contest_id").cast("string").alias("id")))), lambda x: x["id"]), "\n"), F.lit("\n")), 256).alias("h")),
    "SELECT season, competition, sha256(concat(string_agg(CAST(contest_id AS VARCHAR), chr(10) ORDER BY d, CAST(contest_id AS VARCHAR)), chr(10))) AS h FROM {contests} GROUP BY 1, 2",
)
R.add("derived_key", lambda v: v("contests").select(*K, S.derived_key("competition", "d", "home").alias("k")), "SELECT contest_id, concat_ws('|', regexp_replace(lower(trim(competition)), '\\s+', '-', 'g'), CAST(d AS VARCHAR), CAST(home AS VARCHAR)) AS k FROM {contests}")
R.add(
    "pre_event_gate",
    lambda v: v("events").select("event_id", (F.to_utc_timestamp("ts", "Asia/Tokyo") < F.date_trunc("day", "ts")).alias("ok")),
    "SELECT event_id, ts - INTERVAL 9 HOUR < date_trunc('day', ts) AS ok FROM {events}",
)

named = lambda v: appearances(v("contests")).select("contest_id", "side", "e", F.when(F.col("contest_id") % 17 != 0, F.col("d")).alias("d"), F.lit("a").alias("source"), F.concat(F.lit("N"), (F.col("e") % 60).cast("string")).alias("source_name"))
NAMED = "n AS (SELECT contest_id, side, e, CASE WHEN contest_id % 17 <> 0 THEN d END AS d, 'a' AS source, concat('N', CAST(e % 60 AS VARCHAR)) AS source_name FROM {appearances})"
R.add(
    "resolve_alias_asof", lambda v: O.resolve_alias_asof(named(v), v("aliases"), ["contest_id", "side"]),
    f"""WITH {NAMED}, m AS (SELECT contest_id, side, count(DISTINCT entity_id) AS c, min(entity_id) AS one FROM n LEFT JOIN {{aliases}} a ON a.source = n.source AND a.source_name = n.source_name
AND n.d BETWEEN coalesce(a.valid_from, DATE '0001-01-01') AND coalesce(a.valid_to, DATE '9999-12-31') GROUP BY 1, 2)
SELECT contest_id, side, CASE WHEN c = 1 THEN one END AS entity_id, CASE c WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status FROM m""",
)
R.add(
    "resolve_alias_safe",
    lambda v: O.resolve_alias_safe(v("supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).alias("given_id"), F.concat(F.lit("N"), (F.col("s_suppkey") % 70).cast("string")).alias("source_name")), v("aliases").where("entity_id % 4 <> 0")).select("k", "entity_id"),
    """WITH o AS (SELECT source_name, min(entity_id) AS one FROM {aliases} WHERE entity_id % 4 <> 0 GROUP BY 1 HAVING count(DISTINCT entity_id) = 1)
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE o.one END AS entity_id FROM {supplier} LEFT JOIN o ON o.source_name = concat('N', CAST(s_suppkey % 70 AS VARCHAR))""",
)
R.add(
    "resolve_unique_name",
    lambda v: O.resolve_unique_name(v("customer").select("c_custkey", F.concat(F.lit(" P  "), (F.col("c_custkey") % 200).cast("string")).alias("name")), v("customer").where("c_custkey <= 300").select(F.concat(F.lit("p "), (F.col("c_custkey") % 250).cast("string")).alias("name"), F.col("c_custkey").alias("id"))).select("c_custkey", "linked_id"),
    """WITH m AS (SELECT c_custkey % 250 AS n, min(c_custkey) AS one FROM {customer} WHERE c_custkey <= 300 GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, m.one AS linked_id FROM {customer} LEFT JOIN m ON m.n = c_custkey % 200""",
)
squads = lambda v: spread(v, "squads", "appearances", "season", "e")
people = lambda v: squads(v).select("season", "e", (F.col("player") % 7).alias("name"), F.col("player").alias("id")).where("e % 3 <> 0 or season % 2 = 0")
R.add(
    "scoped_exact_link",
    lambda v: O.scoped_exact_link(squads(v).select("season", "e", (F.col("player") % 10).alias("name")), people(v), ["season", "e"], "name"),
    """WITH m AS (SELECT season, e, player % 7 AS name, player AS id FROM {squads} WHERE e % 3 <> 0 OR season % 2 = 0), i AS (SELECT season, e, name, count(DISTINCT id) AS ni, min(id) AS one FROM m GROUP BY 1, 2, 3),
c AS (SELECT season, e, id, count(DISTINCT name) AS nn FROM m GROUP BY 1, 2, 3), k AS (SELECT season, e, player % 10 AS name, count(*) AS n_rows FROM {squads} GROUP BY 1, 2, 3)
SELECT k.season, k.e, k.name, n_rows, CASE WHEN ni IS NULL THEN 'UNRESOLVED' WHEN ni > 1 THEN 'AMBIGUOUS' WHEN nn > 1 THEN 'COLLISION' ELSE 'EXACT' END AS status,
CASE WHEN ni = 1 AND nn = 1 THEN one END AS linked_id FROM k LEFT JOIN i ON i.season = k.season AND i.e = k.e AND i.name = k.name LEFT JOIN c ON c.season = k.season AND c.e = k.e AND c.id = i.one""",
)
R.add(
    "classify_identity_state", lambda v: O.classify_identity_state(v("squads").select((F.col("player") % 500).alias("id"), (F.col("player") % 3).alias("name"), (F.col("e") % 2).alias("club")), "id", "name", "club"),
    "WITH x AS (SELECT player % 500 AS id, count(DISTINCT player % 3) AS names, count(DISTINCT e % 2) AS groups FROM {squads} GROUP BY 1) SELECT *, CASE WHEN names > 1 THEN 'CONFLICTING_NAME' WHEN groups > 1 THEN 'MULTI_GROUP' ELSE 'OK' END AS state FROM x",
)
REV = lambda v, r: v("schedule_rev").where(f"rev = {r}").select("fixture_key", "d", "status", "score")
R.add(
    "strict_1to1_join", lambda v: O.strict_join_violations(REV(v, 1), REV(v, 2), "fixture_key", ["d", "status"]),
    """WITH a AS (SELECT * FROM {schedule_rev} WHERE rev = 1), b AS (SELECT * FROM {schedule_rev} WHERE rev = 2) SELECT fixture_key, 'missing_left' AS violation FROM b WHERE fixture_key NOT IN (SELECT fixture_key FROM a)
UNION ALL SELECT fixture_key, 'missing_right' FROM a WHERE fixture_key NOT IN (SELECT fixture_key FROM b) UNION ALL SELECT a.fixture_key, 'differs_d' FROM a JOIN b USING (fixture_key) WHERE a.d <> b.d
UNION ALL SELECT a.fixture_key, 'differs_status' FROM a JOIN b USING (fixture_key) WHERE a.status <> b.status""",
)
R.add(
    "xg_reference_join", lambda v: O.xg_reference_join(v("xg_obs"), v("contests_strict")).select("contest_id", "reference_id", "scope"),
    "SELECT x.contest_id, k.contest_id AS reference_id, CASE WHEN k.contest_id IS NULL THEN 'UNMATCHED' WHEN eligible THEN 'REGULATION' ELSE 'UNRESOLVED' END AS scope FROM {xg_obs} x LEFT JOIN {contests_strict} k ON k.d = x.d AND k.home = x.home AND k.away = x.away",
)
R.add(
    "event_identity_check",
    lambda v: O.event_identity_check(v("contest_events").withColumns({"d": F.when(F.col("event_id") % 50 == 0, F.date_add("d", 1)).otherwise(F.col("d")), "e": F.when(F.col("event_id") % 41 == 0, F.col("e") + 1).otherwise(F.col("e"))}), v("contests").where("contest_id % 19 <> 0")),
    """SELECT event_id, contest_id, CASE WHEN contest_id % 19 = 0 THEN 'unknown_contest' WHEN event_id % 50 = 0 THEN 'date' ELSE 'entity' END AS reason FROM {contest_events}
WHERE contest_id % 19 = 0 OR event_id % 50 = 0 OR event_id % 41 = 0""",
)
R.add(
    "notice_target_link",
    lambda v: O.notice_target_link(v("events").select(F.col("event_id").alias("notice_id"), (F.col("user_id") % 100 + 1).alias("e"), F.to_date(F.date_add(F.lit("1995-01-01"), (F.col("event_id") % 400).cast("int"))).alias("d"), (F.col("event_id") % 12 + 1).cast("int").alias("round_hint"), F.lit(None).cast("long").alias("id_hint")), v("contests").withColumn("round", F.month("d"))),
    """WITH n AS (SELECT event_id AS notice_id, user_id % 100 + 1 AS e, CAST(DATE '1995-01-01' + CAST(event_id % 400 AS INT) AS DATE) AS d, event_id % 12 + 1 AS r FROM {events}),
m AS (SELECT notice_id, r, count(a.contest_id) AS n, min(a.contest_id) AS one, min(month(a.d)) AS ir FROM n LEFT JOIN {appearances} a ON a.e = n.e AND a.d = n.d GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n = 0 THEN 'NO_MATCH' WHEN n > 1 THEN 'MULTIPLE' WHEN r <> ir THEN 'ROUND_CONFLICT' ELSE 'LINKED' END AS status FROM m)
SELECT notice_id, n, status, CASE WHEN status = 'LINKED' THEN one END AS contest_id FROM s""",
)
R.add(
    "previous_period_profile", lambda v: O.previous_period_profile(v("contests"), v("profiles").where("e % 10 <> 3 or stat = 'gf'"), ["gf", "ga"]),
    """WITH w AS (SELECT season + 1 AS season, e, max(CASE WHEN stat = 'gf' THEN CAST(raw_value AS DOUBLE) / basis END) AS gf, max(CASE WHEN stat = 'ga' THEN CAST(raw_value AS DOUBLE) / basis END) AS ga FROM {profiles} WHERE e % 10 <> 3 GROUP BY 1, 2)
SELECT contest_id, h.gf AS home_gf_rate, h.ga AS home_ga_rate, a.gf AS away_gf_rate, a.ga AS away_ga_rate, h.gf IS NOT NULL AND a.gf IS NOT NULL AS available
FROM {contests} k LEFT JOIN w h ON h.season = k.season AND h.e = k.home LEFT JOIN w a ON a.season = k.season AND a.e = k.away""",
    ["home_gf_rate", "home_ga_rate", "away_gf_rate", "away_ga_rate"],
)
tiers = lambda v: v("appearances").select(F.when((F.col("e") + F.col("season")) % 3 == 0, "TOP").otherwise("LOW").alias("competition"), "season", "e").distinct()
TOPS = """m AS (SELECT DISTINCT season, e, CASE WHEN (e + season) % 3 = 0 THEN 'TOP' ELSE 'LOW' END AS c FROM {appearances}),
t AS (SELECT season, e FROM m WHERE c = 'TOP'), l AS (SELECT season, e FROM m WHERE c = 'LOW')"""
R.add(
    "membership_sets", lambda v: O.member_status(tiers(v), "TOP"),
    f"""WITH {TOPS} SELECT season, e, CASE WHEN EXISTS (SELECT 1 FROM t x WHERE x.e = t.e AND x.season = t.season - 1) THEN 'staying'
WHEN NOT EXISTS (SELECT 1 FROM t x WHERE x.e = t.e AND x.season < t.season) THEN 'first_time' ELSE 'returning' END AS status,
NOT EXISTS (SELECT 1 FROM t x WHERE x.e = t.e AND x.season = t.season - 1) AND EXISTS (SELECT 1 FROM l WHERE l.e = t.e AND l.season = t.season - 1) AS promoted FROM t""",
)
R.add(
    "retain_involved", lambda v: O.retain_involved(v("contests"), tiers(v).where("competition = 'TOP'")),
    f"WITH {TOPS} SELECT * FROM {{contests}} k WHERE EXISTS (SELECT 1 FROM t WHERE t.season = k.season AND t.e = k.home) OR EXISTS (SELECT 1 FROM t WHERE t.season = k.season AND t.e = k.away)",
)


def _bridge(v):
    m = tiers(v)
    return O.bridge_candidates(v("contests"), m.where("competition = 'TOP'"), m.where("competition = 'LOW'"))


R.add(
    "bridge_candidates", _bridge,
    f"""WITH {TOPS}, f AS (SELECT k.*, EXISTS (SELECT 1 FROM t WHERE t.season = k.season AND t.e = k.home) AS ht, EXISTS (SELECT 1 FROM t WHERE t.season = k.season AND t.e = k.away) AS at_,
EXISTS (SELECT 1 FROM l WHERE l.season = k.season AND l.e = k.home) AS hl, EXISTS (SELECT 1 FROM l WHERE l.season = k.season AND l.e = k.away) AS al FROM {{contests}} k)
SELECT contest_id, season, home, away, true AS result_safe FROM f WHERE (ht AND al AND NOT hl AND NOT at_) OR (hl AND at_ AND NOT ht AND NOT al)""",
)
PRED = "concat('m:', CAST(contest_id AS VARCHAR(20)))"
binds = lambda v: O.bind_predictions(v("predictions").where("contest_id % 9 <> 0"), v("contests").select("contest_id", F.concat(F.lit("f"), F.col("contest_id").cast("string")).alias("fixture_key")), "m")
BINDS = "b AS (SELECT concat('m:', CAST(contest_id AS VARCHAR)) AS prediction_id, concat('f', CAST(contest_id AS VARCHAR)) AS fixture_key, 'm' AS model, contest_id FROM {contests} WHERE contest_id % 9 <> 0)"
R.add("bind_predictions", binds, f"WITH {BINDS} SELECT prediction_id, fixture_key, model FROM b")
ids = lambda v, m: v("contests").where(f"contest_id % {m} <> 0").select(F.concat(F.lit("m:"), F.col("contest_id").cast("string")).alias("prediction_id"))
R.add(
    "predictions_to_outcomes",
    lambda v: O.predictions_to_outcomes(ids(v, 8), binds(v).drop("model"), v("contests").where("contest_id % 7 <> 0").select(F.concat(F.lit("f"), F.col("contest_id").cast("string")).alias("fixture_key"), "contest_id"), v("contests").where("season < 1998").select("contest_id", "result")),
    """SELECT concat('m:', CAST(contest_id AS VARCHAR)) AS prediction_id, CASE WHEN contest_id % 9 <> 0 THEN concat('f', CAST(contest_id AS VARCHAR)) END AS fixture_key,
CASE WHEN contest_id % 9 <> 0 AND contest_id % 7 <> 0 THEN contest_id END AS contest_id, CASE WHEN contest_id % 9 <> 0 AND contest_id % 7 <> 0 AND season < 1998 THEN result END AS result,
CASE WHEN contest_id % 9 = 0 THEN 'UNBOUND' WHEN contest_id % 7 = 0 THEN 'NO_BRIDGE' WHEN season >= 1998 THEN 'NO_OUTCOME' ELSE 'RESOLVED' END AS status FROM {contests} WHERE contest_id % 8 <> 0""",
)
R.add(
    "binding_completeness", lambda v: O.binding_completeness(ids(v, 8), binds(v)),
    f"SELECT {PRED} AS prediction_id, CASE WHEN contest_id % 9 = 0 THEN 'UNBOUND' ELSE 'EXTRA' END AS problem FROM {{contests}} WHERE (contest_id % 9 = 0) <> (contest_id % 8 = 0)",
)
R.add(
    "resolve_targets",
    lambda v: O.resolve_targets(v("contests").select(F.col("contest_id").alias("fixture_key"), "d", F.concat(F.lit("N"), (F.col("home") % 60).cast("string")).alias("home_name"), F.concat(F.lit("N"), (F.col("away") % 60).cast("string")).alias("away_name")), v("aliases"), "a"),
    f"""WITH n AS (SELECT contest_id, side, e, d, 'a' AS source, concat('N', CAST(e % 60 AS VARCHAR)) AS source_name FROM {{appearances}}), m AS (SELECT contest_id AS fixture_key, side, count(DISTINCT entity_id) AS c, min(entity_id) AS one FROM n LEFT JOIN {{aliases}} a ON a.source_name = n.source_name
AND n.d BETWEEN coalesce(a.valid_from, DATE '0001-01-01') AND coalesce(a.valid_to, DATE '9999-12-31') GROUP BY 1, 2), s AS (SELECT *, CASE c WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status, CASE WHEN c = 1 THEN one END AS entity_id FROM m)
SELECT fixture_key, {", ".join(f"max(CASE WHEN side = '{s}' THEN {c} END) AS {s}_{c}" for s in ("home", "away") for c in ("entity_id", "status"))} FROM s GROUP BY 1""",
)
R.add("already_predicted", lambda v: O.already_predicted(ids(v, 8), binds(v), ["prediction_id"]), f"SELECT {PRED} AS prediction_id FROM {{contests}} WHERE contest_id % 8 <> 0 AND contest_id % 9 = 0")
P3 = ["p_away", "p_draw", "p_home"]
R.add(
    "fallback_union", lambda v: O.fallback_union(v("predictions").select("contest_id", *P3), v("predictions").where("contest_id % 3 = 0").select("contest_id", *[F.lit(1 / 3).alias(p) for p in P3]), P3),
    "SELECT contest_id, " + ", ".join(f"CASE WHEN contest_id % 3 = 0 THEN 1.0 / 3 ELSE {p} END AS {p}" for p in P3) + ", CASE WHEN contest_id % 3 = 0 THEN 'challenger' ELSE 'baseline' END AS used FROM {predictions}", P3,
)
R.add("align_by_id", lambda v: O.align_by_id(v("predictions").select("contest_id", "p_home"), v("contests")), "SELECT contest_id, p_home FROM {predictions}", ["p_home"])
R.add(
    "frozen_target_select",
    lambda v: O.frozen_target_select(v("contests").select("contest_id", "home", "away"), v("contests").where("contest_id % 6 = 0").select("contest_id", "home", (F.col("away") + F.when(F.col("contest_id") % 12 == 0, 1).otherwise(0)).alias("away")), ["home", "away"]),
    "SELECT contest_id, home, away, contest_id % 12 <> 0 AS identity_ok FROM {contests} WHERE contest_id % 6 = 0",
)
R.add(
    "dataset_compare", lambda v: O.dataset_compare(v("appearances").where("season <= 1997"), v("appearances").where("season > 1997"), "e", "place"),
    """WITH o AS (SELECT DISTINCT e, place FROM {appearances} WHERE season <= 1997), n AS (SELECT DISTINCT e, place FROM {appearances} WHERE season > 1997),
j AS (SELECT coalesce(o.e, n.e) AS e, o.place AS op, n.place AS np FROM o FULL JOIN n ON o.e = n.e AND o.place = n.place)
SELECT e, CASE WHEN count(op) = 0 THEN 'added' WHEN count(np) = 0 THEN 'removed' ELSE 'common' END AS state, count(CASE WHEN op IS NULL THEN 1 END) AS gained, count(CASE WHEN np IS NULL THEN 1 END) AS lost FROM j GROUP BY e""",
)
