"""Queries of ratings, training tables and models; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators import assembly as A
from rivalry.operators import features as FE
from rivalry.operators import models as M
from rivalry.operators import ratings as RA
from rivalry.plans.base import Registry, last_sql, pivot_sql, scratch, stored
from rivalry.plans.features import FORM_SQL, H2H, PLACE, STATS, XG, XG_AGG, stats
from rivalry.sources import tables as T

R = Registry()
ID = "contest_id"
RATES = ["home_rating", "away_rating", "rating_diff"]


def elo_sql(source: str = "{contests_strict}", k: str = "20.0", adv: str = "0.0", prior: str = "1500.0", pull: float = 0.0, config: str = "base", moves: str = "", t: str = "") -> str:
    """Day by day: state (n, pool, e, r) after n days. k, adv and prior are SQL over the contest or entity; t ends the names.

    Before a pool's first day of a season ratings are pulled to 1500 once for each season passed; then moves ('offset', or the status
    that resets) act on the entities of mv (season, e, status, move) that have played.
    """
    now = f"1500 + (s.r - 1500) * coalesce(f.keep, 1)"
    joins = f"LEFT JOIN pf{t} f ON f.pool = s.pool AND f.n = s.n + 1"
    if moves:
        joins += f" LEFT JOIN es{t} v ON v.pool = s.pool AND v.e = s.e AND v.n = s.n + 1"
    if moves == "offset":
        mean = lambda m: f"avg(CASE WHEN v.move = '{m}' THEN st{t}.r END)"
        joins += f" LEFT JOIN (SELECT st{t}.pool, st{t}.n, {mean('relegated')} - {mean('promoted')} AS gift FROM st{t} JOIN es{t} v ON v.pool = st{t}.pool AND v.e = st{t}.e AND v.n = st{t}.n + 1 GROUP BY 1, 2) g ON g.pool = s.pool AND g.n = s.n"
        now = f"{now} + CASE WHEN v.move = 'promoted' THEN coalesce(g.gift, 0) ELSE 0 END"
    elif moves:
        now = f"CASE WHEN v.status = '{moves}' THEN 1500 ELSE {now} END"
    state = f"(SELECT s.n, s.pool, s.e, {now} AS r FROM st{t} s {joins})"
    met = f"FROM dn{t} k JOIN {state} h ON h.pool = k.competition AND h.e = k.home AND k.n = h.n + 1 JOIN {state} a ON a.pool = k.competition AND a.e = k.away AND k.n = a.n + 1"
    events = f"""
es{t} AS MATERIALIZED (SELECT f.pool, f.n, m.e, m.status, m.move FROM pf{t} f JOIN mv m ON m.season = f.season JOIN (SELECT pool, e, min(n) AS n FROM pl{t} GROUP BY 1, 2) p ON p.pool = f.pool AND p.e = m.e AND p.n < f.n WHERE f.season > f.last),""" if moves else ""
    return f"""RECURSIVE dn{t} AS MATERIALIZED (SELECT *, CAST(dense_rank() OVER (ORDER BY d) AS INT) AS n, {k} AS kk, {adv} AS aa FROM {source} z),
pl{t} AS MATERIALIZED (SELECT DISTINCT competition AS pool, home AS e, n FROM dn{t} UNION SELECT DISTINCT competition, away, n FROM dn{t}),
pf{t} AS MATERIALIZED (SELECT *, pow({1 - pull}, season - last) AS keep FROM (SELECT pool, n, season, lag(season) OVER (PARTITION BY pool ORDER BY n) AS last FROM (SELECT DISTINCT competition AS pool, n, season FROM dn{t}) y) y),{events}
st{t} AS (SELECT 0 AS n, pool, e, CAST({prior} AS DOUBLE) AS r FROM (SELECT DISTINCT pool, e FROM pl{t}) y UNION ALL
SELECT s.n + 1, s.pool, s.e, s.r + coalesce(x.delta, 0) FROM {state} s LEFT JOIN (SELECT pool, e, sum(delta) AS delta FROM (SELECT competition AS pool, unnest([home, away]) AS e, unnest([delta, -delta]) AS delta FROM (
  SELECT k.competition, k.home, k.away, k.kk * (k.result / 2.0::DOUBLE - 1 / (1 + pow(10, (a.r - h.r - k.aa) / 400))) AS delta {met}) y) y GROUP BY 1, 2) x
  ON x.pool = s.pool AND x.e = s.e WHERE s.n < (SELECT max(n) FROM dn{t})),
rt{t} AS (SELECT k.competition AS pool, '{config}' AS config, k.contest_id, h.r AS home_rating, a.r AS away_rating, h.r - a.r AS rating_diff {met})"""


strict = lambda v: v("contests_strict")
R.add("elo_replay", lambda v: RA.replay(strict(v)), f"WITH {elo_sql()} SELECT * FROM rt", RATES)
R.add(
    "elo_multi_segment", lambda v: RA.elo_multi_segment([strict(v).where("season < 1996"), strict(v).where("season >= 1996")]),
    f"WITH {elo_sql()} SELECT * FROM rt", RATES,
)
R.add(
    "elo_final_ratings", lambda v: RA.final_ratings(strict(v), v("supplier").crossJoin(F.broadcast(v("customer").select(F.col("c_mktsegment").alias("pool")).distinct())).select("pool", F.col("s_suppkey").alias("e"))),
    f"WITH {elo_sql()}, f AS (SELECT pool, e, r FROM st WHERE n = (SELECT max(n) FROM st)), p AS (SELECT DISTINCT c_mktsegment AS pool FROM {{customer}}) SELECT p.pool, s_suppkey AS e, coalesce(r, 1500) AS rating FROM {{supplier}} CROSS JOIN p LEFT JOIN f ON f.pool = p.pool AND f.e = s_suppkey",
    ["rating"],
)
R.add(
    "elo_per_competition_advantage", lambda v: RA.replay(strict(v).withColumn("adv_row", F.when(F.col("competition") == "BUILDING", 0.0).otherwise(175.0))),
    f"""WITH {elo_sql(adv="CASE WHEN competition = 'BUILDING' THEN 0.0 ELSE 175.0 END")} SELECT * FROM rt""", RATES,
)
R.add(
    "elo_initial_prior", lambda v: RA.replay(strict(v).withColumns({f"prior_{s}": F.when(F.col(s) % 5 == 0, 1400.0).otherwise(1500.0) for s in ("home", "away")})),
    f"WITH {elo_sql(prior='CASE WHEN e % 5 = 0 THEN 1400.0 ELSE 1500.0 END')} SELECT * FROM rt", RATES,
)
tier = lambda e: F.when((F.col(e) + F.col("season")) % 3 == 0, "TOP").otherwise("LOW")
tiers = lambda v: v("appearances").select(tier("e").alias("competition"), "season", "e").distinct()
moves = lambda v: RA.membership_events(tiers(v), "TOP")


#: Tiers by entity and season: what membership_events makes of them, by EXISTS.
MOVES = """tt AS (SELECT DISTINCT season, e, (e + season) % 3 = 0 AS top FROM {appearances}), tc AS (SELECT DISTINCT season + 1 AS season, e, top FROM tt),
mv AS MATERIALIZED (SELECT season, e, CASE WHEN EXISTS (SELECT 1 FROM tt y WHERE y.top AND y.e = t.e AND y.season < t.season) THEN 'returning' ELSE 'first_time' END AS status,
  CASE WHEN EXISTS (SELECT 1 FROM tc y WHERE NOT y.top AND y.e = t.e AND y.season = t.season) THEN 'promoted' ELSE '' END AS move FROM tt t WHERE top AND NOT EXISTS (SELECT 1 FROM tc y WHERE y.top AND y.e = t.e AND y.season = t.season)
UNION ALL SELECT season, e, '', 'relegated' FROM tc c WHERE top AND NOT EXISTS (SELECT 1 FROM tt y WHERE y.top AND y.e = c.e AND y.season = c.season))"""


def boundary(key: str, config: dict, act: str) -> None:
    sql = elo_sql(config=config["config"], moves=act)
    R.add(key, lambda v: RA.replay(strict(v), [config], events=moves(v)), f"WITH RECURSIVE {MOVES}, {sql[len('RECURSIVE '):]} SELECT * FROM rt", RATES)


boundary("elo_promotion_offset", {"config": "offset", "offset": True}, "offset")
boundary("elo_returning_hybrid", {"config": "hybrid", "reset": "first_time"}, "first_time")
boundary("elo_returning_reset", {"config": "reset", "reset": "returning"}, "returning")
R.add("elo_season_regression", lambda v: RA.replay(strict(v), [{"config": "pull", "pull": 0.25}]), f"WITH {elo_sql(pull=0.25, config='pull')} SELECT * FROM rt", RATES)
NTH = """(WITH o AS (SELECT contest_id, e, row_number() OVER (PARTITION BY e, season ORDER BY d, CAST(contest_id AS VARCHAR)) AS o FROM (SELECT contest_id, season, d, unnest([home, away]) AS e FROM {contests_strict}) y)
SELECT k.*, least(h.o, a.o) AS nth FROM {contests_strict} k JOIN o h ON h.contest_id = k.contest_id AND h.e = k.home JOIN o a ON a.contest_id = k.contest_id AND a.e = k.away)"""
EARLY = "CASE WHEN nth <= 5 THEN 45.0 ELSE 30.0 END"
R.add(
    "elo_early_k", lambda v: RA.replay(RA.with_ordinals(strict(v)), [{"config": "early", "k": 30.0, "early_k": 45.0}]),
    f"WITH {elo_sql(NTH, EARLY, config='early')} SELECT * FROM rt", RATES,
)
LAST = "SELECT pool, '{0}' AS config, e, r AS rating FROM st_{0} WHERE n = (SELECT max(n) FROM st_{0})"
R.add(
    "live_dual_replay", lambda v: RA.replay(RA.with_ordinals(strict(v)), [{"config": "a", "k": 30.0}, {"config": "b", "k": 30.0, "early_k": 45.0}], final=True),
    f"WITH {elo_sql(k='30.0', t='_a')}, {elo_sql(NTH, EARLY, t='_b')[len('RECURSIVE '):]} {LAST.format('a')} UNION ALL {LAST.format('b')}", ["rating"],
)
R.add(
    "asof_ratings_for_targets", lambda v: RA.replay(strict(v).withColumn("result", F.when(F.col("season") < 1998, F.col("result")))).join(strict(v).where("season >= 1998").select(ID), ID, "left_semi"),
    f"""WITH {elo_sql("(SELECT * FROM {contests_strict} WHERE season < 1998)")}, f AS (SELECT pool, e, r FROM st WHERE n = (SELECT max(n) FROM st))
SELECT competition AS pool, 'base' AS config, contest_id, coalesce(h.r, 1500) AS home_rating, coalesce(a.r, 1500) AS away_rating, coalesce(h.r, 1500) - coalesce(a.r, 1500) AS rating_diff FROM {{contests_strict}} k
LEFT JOIN f h ON h.pool = k.competition AND h.e = k.home LEFT JOIN f a ON a.pool = k.competition AND a.e = k.away WHERE season >= 1998""",
    RATES,
)
R.add(
    "attack_defence_replay", lambda v: RA.attack_defence(v("contests"), 1996),
    """WITH RECURSIVE q AS MATERIALIZED (SELECT k.*, row_number() OVER (PARTITION BY competition ORDER BY d, CAST(contest_id AS VARCHAR)) AS i,
  avg(CASE WHEN season <= 1996 THEN home_score END) OVER (PARTITION BY competition) AS bh, avg(CASE WHEN season <= 1996 THEN away_score END) OVER (PARTITION BY competition) AS ba FROM {contests} k),
f AS MATERIALIZED (SELECT competition AS pool, e, min(i) AS i FROM (SELECT competition, i, unnest([home, away]) AS e FROM q) y GROUP BY 1, 2),
st AS (SELECT CAST(0 AS BIGINT) AS i, pool, e, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM f UNION ALL
SELECT s.i + 1, s.pool, s.e, CASE WHEN s.fi <= s.i + 1 THEN s.a + CASE s.e WHEN x.home THEN x.dh WHEN x.away THEN x.da ELSE 0 END - (x.dh + x.da) / x.met ELSE 0 END,
  CASE WHEN s.fi <= s.i + 1 THEN s.b - CASE s.e WHEN x.home THEN x.da WHEN x.away THEN x.dh ELSE 0 END + (x.dh + x.da) / x.met ELSE 0 END
FROM (SELECT st.*, f.i AS fi FROM st JOIN f USING (pool, e)) s JOIN (
  SELECT q.competition AS pool, q.home, q.away, 0.05 * (q.home_score - q.bh * exp(h.a - w.b)) AS dh, 0.05 * (q.away_score - q.ba * exp(w.a - h.b)) AS da, (SELECT count(*) FROM f WHERE f.pool = q.competition AND f.i <= q.i) AS met
  FROM q JOIN st h ON h.pool = q.competition AND h.e = q.home AND q.i = h.i + 1 JOIN st w ON w.pool = q.competition AND w.e = q.away AND q.i = w.i + 1) x ON x.pool = s.pool)
SELECT q.competition AS pool, q.contest_id, q.bh * exp(h.a - w.b) AS home_lambda, q.ba * exp(w.a - h.b) AS away_lambda FROM q
JOIN st h ON h.pool = q.competition AND h.e = q.home AND h.i = q.i - 1 JOIN st w ON w.pool = q.competition AND w.e = q.away AND w.i = q.i - 1""",
    ["home_lambda", "away_lambda"],
)
R.add("elo_same_date_manifest", lambda v: RA.replay(v("contests")), f"WITH {elo_sql('{contests}')} SELECT * FROM rt", RATES)
pair = lambda df: df.withColumn("pool", F.when(F.col("competition").isin("BUILDING", "MACHINERY"), "PAIR").otherwise(F.col("competition")))
PAIRED = "(SELECT * REPLACE (CASE WHEN competition IN ('BUILDING', 'MACHINERY') THEN 'PAIR' ELSE competition END AS competition) FROM {contests_strict})"
R.add(
    "transition_sanity", lambda v: RA.transition_sanity(strict(v), RA.replay(strict(v)), RA.replay(pair(strict(v)), pool="pool")),
    f"""WITH {elo_sql()}, {elo_sql(PAIRED, t='_p')[len('RECURSIVE '):]}, o AS (SELECT contest_id, e, season, row_number() OVER (PARTITION BY e, season ORDER BY d, CAST(contest_id AS VARCHAR)) AS o FROM (SELECT contest_id, season, d, unnest([home, away]) AS e FROM dn) y)
SELECT o.contest_id, e, season, rt.rating_diff AS own_diff, rt_p.rating_diff AS combined_diff FROM o JOIN rt USING (contest_id) JOIN rt_p USING (contest_id) WHERE o.o = 1""",
    ["own_diff", "combined_diff"],
)
R.add(
    "export_ratings",
    lambda v: T.export_ratings(RA.replay(strict(v), final=True), strict(v), scratch(strict(v).sparkSession, "ratings-csv")),
    f"WITH {elo_sql()}, u AS (SELECT competition AS pool, home AS e, d FROM dn UNION ALL SELECT competition, away, d FROM dn) SELECT st.pool, st.e, st.r AS rating, max(u.d) AS last_date, count(*) AS played FROM st JOIN u USING (pool, e) WHERE n = (SELECT max(n) FROM st) GROUP BY 1, 2, 3",
    ["rating"],
)

# ---- training tables


def base_sql(extra: str = "") -> str:
    form = f"sa AS (SELECT contest_id, d, season, competition, place, home AS e, away AS opp, 'home' AS side, home_score AS gf, away_score AS ga, result FROM {{contests_strict}} UNION ALL SELECT contest_id, d, season, competition, place, away, home, 'away', away_score, home_score, result FROM {{contests_strict}})"
    return f"WITH {elo_sql()}, {form}, f0 AS ({last_sql(5, FORM_SQL, base='sa')}), fo AS ({pivot_sql('f0', FORM_SQL)}){extra}"


base = lambda v: A.training_base(strict(v), A.rated_rows(strict(v)))
TB = "SELECT k.contest_id, k.d, k.season, k.competition, k.home, k.away, k.result AS label, rt.home_rating, rt.away_rating, rt.rating_diff, fo.* EXCLUDE (contest_id)"
FROM = "FROM dn k JOIN rt ON rt.contest_id = k.contest_id JOIN fo ON fo.contest_id = k.contest_id"
R.add("training_base", base, f"{base_sql()} {TB} {FROM}", RATES)
VEN = {"venue_points": "CAST(coalesce(sum(CASE WHEN b.gf > b.ga THEN 3 WHEN b.gf = b.ga THEN 1 WHEN b.gf < b.ga THEN 0 END), 0) AS BIGINT)", "venue_goal_diff": "CAST(coalesce(sum(b.gf - b.ga), 0) AS BIGINT)"}
R.add(
    "training_plus_venue", lambda v: A.plus_venue(base(v), strict(v)),
    base_sql(f", v0 AS ({last_sql(5, VEN, 'b.e = a.e AND b.side = a.side', base='sa')}), ve AS ({pivot_sql('v0', VEN)})") + f" {TB}, ve.* EXCLUDE (contest_id) {FROM} JOIN ve ON ve.contest_id = k.contest_id", RATES,
)
SPAN = "date_diff('day', max(b.d), a.d)"
H2H_ROWS = f"h2 AS ({H2H.replace('{contests}', '{contests_strict}')})"
PLACES = f"p0 AS ({last_sql(5, PLACE, 'b.e = a.e AND b.place = a.place', base='sa')}), pf_ AS ({pivot_sql('p0', PLACE)})"
GAPS = f"""g0 AS ({last_sql(None, {"gap": SPAN}, base="sa", keep="a.side, a.d")}), g1 AS ({pivot_sql("g0", ["gap"])}), ga AS (SELECT contest_id, coalesce(home_gap, 0) AS home_gap, coalesce(away_gap, 0) AS away_gap,
home_gap IS NOT NULL AS home_known, away_gap IS NOT NULL AS away_known, coalesce(home_gap - away_gap, 0) AS gap_diff FROM g1)"""
VENUES = f"v0 AS ({last_sql(5, VEN, 'b.e = a.e AND b.side = a.side', base='sa')}), ve AS ({pivot_sql('v0', VEN)})"
MOMENTUM = f"""mr AS (SELECT sa.*, CASE WHEN sa.side = 'home' THEN rt.home_rating ELSE rt.away_rating END AS rating FROM sa JOIN rt USING (contest_id)),
m0 AS ({last_sql(5, {"oldest": "arg_max(b.rating, b.k)", "momentum_n": "count(b.rating)"}, base="mr", keep="a.side, a.rating")}), m1 AS (SELECT contest_id, side, momentum_n, coalesce(rating - oldest, 0) AS momentum FROM m0), mo AS ({pivot_sql("m1", ["momentum", "momentum_n"])})"""
SUMS = f"s0 AS ({last_sql(5, STATS, base='sa')}), ss AS ({pivot_sql('s0', STATS)})"


def plus_sql(parts: dict[str, str]) -> str:
    """The base table with the columns of the named parts: name of the common table expression -> its SQL."""
    return base_sql("".join(f", {x}" for x in parts.values())) + f" {TB}, " + ", ".join(f"{n}.* EXCLUDE (contest_id)" for n in parts) + f" {FROM} " + " ".join(f"JOIN {n} ON {n}.contest_id = k.contest_id" for n in parts)


MATCHUP = {"h2": H2H_ROWS, "pf_": PLACES}
R.add("training_plus_matchup", lambda v: A.plus_matchup(base(v), strict(v)), plus_sql(MATCHUP), RATES)
R.add("training_plus_context", lambda v: A.plus_context(base(v), strict(v)), plus_sql({"ga": GAPS}), RATES)


def full(v) -> DataFrame:
    rated = stored(A.rated_rows(strict(v)), "rated")
    out = A.training_base(strict(v), rated)
    return A.plus_momentum(A.plus_context(A.plus_matchup(A.plus_venue(out, strict(v)), strict(v)), strict(v)), strict(v), rated)


R.add("training_plus_full", full, plus_sql({"ve": VENUES, **MATCHUP, "ga": GAPS, "mo": MOMENTUM}), [*RATES, "home_momentum", "away_momentum"])
R.add("training_plus_stats", lambda v: A.plus_stats(base(v), strict(v), stats(v), ["shots", "corners", "fouls"]), plus_sql({"ss": SUMS}), RATES)
R.add(
    "continuous_history",
    lambda v: A.continuous_history({"a": v("contests").where("season < 1996"), "b": v("contests").where("season >= 1996").drop("place")}, FE.form_lastn)["b"],
    f"WITH f AS ({last_sql(5, FORM_SQL)}), p AS ({pivot_sql('f', FORM_SQL)}) SELECT p.* FROM p JOIN {{contests}} USING (contest_id) WHERE season >= 1996",
)
R.add("time_split", lambda v: M.time_split(v("contests"), 1995, 1996, 1997).select(ID, "split"), "SELECT contest_id, CASE WHEN season <= 1995 THEN 'train' WHEN season = 1996 THEN 'validation' WHEN season = 1997 THEN 'test' ELSE 'reserved' END AS split FROM {contests}")
R.add(
    "expanding_folds", lambda v: M.expanding_folds(v("contests"), folds(v)).select(ID, "fold", "role"),
    "SELECT contest_id, CAST(y AS INT) AS fold, CASE WHEN season = y THEN 'valid' ELSE 'train' END AS role FROM {contests} JOIN (SELECT DISTINCT season AS y FROM {contests} WHERE season > (SELECT min(season) FROM {contests})) r ON season <= y",
)
R.add(
    "eligibility_flag", lambda v: M.eligibility_flag(v("predictions").withColumns({"ok": F.col(ID) % 4 != 0, "x": F.when(F.col(ID) % 5 != 0, F.col("p_home"))}), ["ok"], ["x"]).select(ID, "eligible"),
    "SELECT contest_id, contest_id % 4 <> 0 AND contest_id % 5 <> 0 AS eligible FROM {predictions}",
)
R.add(
    "goal_state_features", lambda v: M.goal_state_features(FE.form_lastn(strict(v)), A.rated_rows(strict(v))),
    f"{base_sql()} SELECT fo.contest_id, rt.rating_diff, home_points, away_points, home_gf_sum, away_gf_sum, home_ga_sum, away_ga_sum, home_points - away_points AS points_diff, home_gf_sum - home_ga_sum - away_gf_sum + away_ga_sum AS goal_diff FROM fo JOIN rt ON rt.contest_id = fo.contest_id", ["rating_diff"],
)
R.add(
    "xg_training_rows", lambda v: A.xg_training_rows(v("xg_obs"), v("contests"), RA.replay(v("contests"))).drop("rating_diff"),
    XG + f"""h AS (SELECT * FROM x WHERE eligible), f1 AS ({last_sql(5, XG_AGG, base="x", hist="h")}), p AS ({pivot_sql("f1", XG_AGG)})
SELECT p.contest_id, home_xg_for, home_xg_against, away_xg_for, away_xg_against, result, sha256(concat_ws('|', CAST(p.contest_id AS VARCHAR), CAST(CAST(round(home_xg_for * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(round(home_xg_against * 10000) AS BIGINT) AS VARCHAR),
CAST(CAST(round(away_xg_for * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(round(away_xg_against * 10000) AS BIGINT) AS VARCHAR), CAST(result AS VARCHAR))) AS row_hash FROM p JOIN {{contests}} k ON k.contest_id = p.contest_id WHERE home_xg_for IS NOT NULL AND away_xg_for IS NOT NULL""",
    ["home_xg_for", "home_xg_against", "away_xg_for", "away_xg_against"],
)

# ---- models


def folds(v) -> list[int]:
    """Every season that has an earlier one."""
    return sorted(r.season for r in v("contests").select("season").distinct().collect())[1:]


def feats(v, more=()) -> DataFrame:
    """Contests with the difference of ratings, of points and of goals over the last five, written once; more frames are joined by id."""
    rows = v("contests").join(FE.form_lastn(v("contests")), ID).join(RA.replay(v("contests")).select(ID, "rating_diff"), ID)
    rows = rows.withColumns({"points_diff": (F.col("home_points") - F.col("away_points")).cast("double"), "goal_diff": (F.col("home_gf_sum") - F.col("away_gf_sum")).cast("double")})
    rows = rows.select(ID, "season", "d", "home", "away", "result", "rating_diff", "points_diff", "goal_diff")
    for frame in more:
        rows = rows.join(frame, ID)
    return stored(rows, "features")


R.add("baseline_uniform", lambda v: M.baseline_uniform(v("contests")).select(ID, *M.P), "SELECT contest_id, 1.0::DOUBLE / 3 AS p_away, 1.0::DOUBLE / 3 AS p_draw, 1.0::DOUBLE / 3 AS p_home FROM {contests}", M.P)
R.add(
    "baseline_prior", lambda v: M.baseline_prior(v("contests").where("season < 1997"), v("contests").where("season >= 1997").select(ID)),
    "WITH t AS (SELECT avg((result = 0)::INT) AS p_away, avg((result = 1)::INT) AS p_draw, avg((result = 2)::INT) AS p_home FROM {contests} WHERE season < 1997) SELECT contest_id, t.* FROM {contests} CROSS JOIN t WHERE season >= 1997", M.P,
)
ALL = ["rating_diff", "points_diff", "goal_diff"]
lam = lambda v: v("contests").withColumns({"home_lambda": F.lit(0.5) + (F.col("home") % 7) * 0.25, "away_lambda": F.lit(0.5) + (F.col("away") % 5) * 0.25})
R.add(
    "score_grid_probs", lambda v: lam(v).select(ID, M.score_grid_probs(F.col("home_lambda"), F.col("away_lambda")).alias("p")).select(ID, *[F.col("p")[i].alias(n) for i, n in enumerate(M.P)]),
    """WITH l AS (SELECT DISTINCT home % 7 AS h, away % 5 AS a, 0.5::DOUBLE + (home % 7) * 0.25 AS hl, 0.5::DOUBLE + (away % 5) * 0.25 AS al FROM {contests}), g AS (SELECT h, a, i, j, exp(-hl) * pow(hl, i) / factorial(i::INT) * exp(-al) * pow(al, j) / factorial(j::INT) AS p FROM l CROSS JOIN range(0, 16) x(i) CROSS JOIN range(0, 16) y(j)),
s AS (SELECT h, a, sum(CASE WHEN i < j THEN p END) / sum(p) AS p_away, sum(CASE WHEN i = j THEN p END) / sum(p) AS p_draw, sum(CASE WHEN i > j THEN p END) / sum(p) AS p_home FROM g GROUP BY 1, 2)
SELECT contest_id, p_away, p_draw, p_home FROM {contests} JOIN s ON s.h = home % 7 AND s.a = away % 5""", M.P,
)
R.add(
    "dixon_coles_tau", lambda v: lam(v).select(ID, M.dixon_coles_tau(F.col("home_score"), F.col("away_score"), F.col("home_lambda"), F.col("away_lambda"), F.lit(0.1)).alias("tau")),
    """WITH l AS (SELECT *, 0.5::DOUBLE + (home % 7) * 0.25 AS hl, 0.5::DOUBLE + (away % 5) * 0.25 AS al FROM {contests}) SELECT contest_id, CASE WHEN home_score = 0 AND away_score = 0 THEN 1 - hl * al * 0.1 WHEN home_score = 0 AND away_score = 1 THEN 1 + hl * 0.1 WHEN home_score = 1 AND away_score = 0 THEN 1 + al * 0.1 WHEN home_score = 1 AND away_score = 1 THEN 0.9 ELSE 1 END AS tau FROM l""",
    ["tau"],
)
R.add(
    "dixon_coles_rho", lambda v: v("contests").select(F.max("season").alias("season")).withColumn("rho", F.lit(M.dixon_coles_rho(lam(v)))),
    """WITH RECURSIVE l AS MATERIALIZED (SELECT home_score AS h, away_score AS a, 0.5::DOUBLE + (home % 7) * 0.25 AS hl, 0.5::DOUBLE + (away % 5) * 0.25 AS al, count(*) AS n FROM {contests} WHERE home_score <= 1 AND away_score <= 1 GROUP BY ALL),
z AS (SELECT 0 AS i, -0.2::DOUBLE AS lo, 0.2::DOUBLE AS hi UNION ALL SELECT i + 1, CASE WHEN slope > 0 THEN mid ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE mid END FROM (
  SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(n * CASE WHEN h = 0 AND a = 0 THEN -hl * al / (1 - hl * al * (lo + hi) / 2) WHEN h = 0 THEN hl / (1 + hl * (lo + hi) / 2) WHEN a = 0 THEN al / (1 + al * (lo + hi) / 2) ELSE -1 / (1 - (lo + hi) / 2) END) FROM l) AS slope FROM z WHERE i < 40) y)
SELECT (SELECT max(season) FROM {contests}) AS season, (lo + hi) / 2 AS rho FROM z WHERE i = 40""", ["rho"],
)
dav = lambda v: v("contests").withColumns({"home_rating": (1500 + F.col("home")).cast("double"), "away_rating": (1500 + F.col("away")).cast("double")})
R.add(
    "davidson_probs", lambda v: dav(v).select(ID, M.davidson_probs(F.col("home_rating"), F.col("away_rating"), F.lit(0.7)).alias("p")).select(ID, *[F.col("p")[i].alias(n) for i, n in enumerate(M.P)]),
    """WITH g AS (SELECT contest_id, pow(10, (1500 + home) / 400.0::DOUBLE) AS h, pow(10, (1500 + away) / 400.0::DOUBLE) AS a FROM {contests}) SELECT contest_id, a / (h + a + 0.7 * sqrt(h * a)) AS p_away, 0.7 * sqrt(h * a) / (h + a + 0.7 * sqrt(h * a)) AS p_draw, h / (h + a + 0.7 * sqrt(h * a)) AS p_home FROM g""", M.P,
)
R.add(
    "davidson_nu", lambda v: v("contests").select(F.max("season").alias("season")).withColumn("nu", F.lit(M.davidson_nu(dav(v)))),
    """WITH RECURSIVE g AS MATERIALIZED (SELECT pow(10, home / 400.0::DOUBLE) AS h, pow(10, away / 400.0::DOUBLE) AS a, count(*) AS n, count(CASE WHEN result = 1 THEN 1 END) AS drawn FROM {contests} GROUP BY home, away),
z AS (SELECT 0 AS i, 0.01::DOUBLE AS lo, 5.0::DOUBLE AS hi UNION ALL SELECT i + 1, CASE WHEN slope > 0 THEN mid ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE mid END FROM (
  SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(drawn / ((lo + hi) / 2) - n * sqrt(h * a) / (h + a + (lo + hi) / 2 * sqrt(h * a))) FROM g) AS slope FROM z WHERE i < 45) y)
SELECT (SELECT max(season) FROM {contests}) AS season, (lo + hi) / 2 AS nu FROM z WHERE i = 45""", ["nu"],
)


def _calibrated(kind):
    def build(v):
        tau, b = M.fit_calibration(v("predictions").where("season < 1997"), kind)
        rows = v("predictions").where("season >= 1997")
        return rows.select(ID, M.calibrate(M.P, tau, b).alias("q")).select(ID, *[F.col("q")[i].alias(n) for i, n in enumerate(M.P)])

    return build


#: Newton's steps by Cramer's rule: biases x and y of draw and home, temperature t, of which a kind moves its own.
_Q = "(SELECT result, n, la, ld, lh, t, x, y, i, 1 / (1 + exp(t * (ld - la) + x) + exp(t * (lh - la) + y)) AS qa FROM rows CROSS JOIN (SELECT * FROM z WHERE i < 25) z)"
_MOVE = {"t": ("la", "ld", "lh"), "x": ("0", "1", "0"), "y": ("0", "0", "1")}


def calibration_sql(own: str) -> str:
    mean = lambda u: f"(qa * {u[0]} + qd * {u[1]} + qh * {u[2]})"
    true = lambda u: f"(CASE result WHEN 0 THEN {u[0]} WHEN 1 THEN {u[1]} ELSE {u[2]} END)"
    picks = [f"sum(n * ({mean(_MOVE[m])} - {true(_MOVE[m])})) AS g{m}" for m in own]
    picks += [f"sum(n * ({mean([f'({p}) * ({q})' for p, q in zip(_MOVE[a], _MOVE[b], strict=True)])} - {mean(_MOVE[a])} * {mean(_MOVE[b])})) AS h{a}{b}" for a in own for b in own]

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"

    h = [[f"h{a}{b}" for b in own] for a in own]
    solved = {m: f"{m} - {det([[f'g{own[i]}' if own[c] == m else h[i][c] for c in range(len(own))] for i in range(len(own))])} / {det(h)}" for m in own}
    step = ", ".join(f"greatest(0, {solved[m]})" if m == "t" and m in own else solved.get(m, m) for m in "txy")
    return f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT result, ln(p_away) AS la, ln(p_draw) AS ld, ln(p_home) AS lh, count(*) AS n FROM {{predictions}} WHERE season < 1997 GROUP BY ALL),
z AS (SELECT 0 AS i, 1.0::DOUBLE AS t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT i + 1, {step} FROM (
  SELECT i, t, x, y, {', '.join(picks)} FROM (SELECT *, qa * exp(t * (ld - la) + x) AS qd, qa * exp(t * (lh - la) + y) AS qh FROM {_Q} u) u GROUP BY i, t, x, y) w),
o AS (SELECT contest_id, pow(p_away, t) AS a, pow(p_draw, t) * exp(x) AS d, pow(p_home, t) * exp(y) AS h FROM {{predictions}} CROSS JOIN (SELECT * FROM z WHERE i = 25) f WHERE season >= 1997)
SELECT contest_id, a / (a + d + h) AS p_away, d / (a + d + h) AS p_draw, h / (a + d + h) AS p_home FROM o"""


for _kind, _own in (("C1", "t"), ("C2", "xy"), ("C3", "txy")):
    R.add(f"calibrate_{_kind}", _calibrated(_kind), calibration_sql(_own), M.P)
R.add(
    "calibrate_apply", lambda v: v("predictions").select(ID, M.calibrate(M.P, 0.8, (0.0, 0.1, -0.1)).alias("q")).select(ID, *[F.col("q")[i].alias(n) for i, n in enumerate(M.P)]),
    "WITH z AS (SELECT contest_id, pow(p_away, 0.8) AS a, pow(p_draw, 0.8) * exp(0.1) AS d, pow(p_home, 0.8) * exp(-0.1) AS h FROM {predictions}) SELECT contest_id, a / (a + d + h) AS p_away, d / (a + d + h) AS p_draw, h / (a + d + h) AS p_home FROM z", M.P,
)
R.add("mlp_baseline", lambda v: M.rolling_predict(feats(v), M.MultilayerPerceptron(ALL, 16, steps=1000), folds(v)).select(ID, *M.P), None, M.P)
