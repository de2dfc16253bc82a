"""Queries of scores, diagnostics and versioned snapshots, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions.scalar import season_phase
from rivalry.operators import features as FE
from rivalry.operators import scoring as O
from rivalry.operators import versions as V
from rivalry.plans.base import Registry

R = Registry()
ID = "contest_id"
scored = lambda v: O.row_scores(v("predictions"))
#: A second forecaster: halfway between the first and equal chances.
other = lambda v: O.row_scores(v("predictions").withColumns({p: F.col(p) / 2 + F.lit(1 / 6) for p in O.P}))


def sc(src: str = "{predictions}", name: str = "s") -> str:
    true = "CASE result WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END"
    return f"""{name} AS (SELECT *, CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END AS predicted, greatest(p_away, p_draw, p_home) AS confidence, {true} AS p_true,
-ln(least(greatest({true}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) AS nll, pow(p_away - (result = 0)::INT, 2) + pow(p_draw - (result = 1)::INT, 2) + pow(p_home - (result = 2)::INT, 2) AS brier FROM {src} x)"""


HALF = "(SELECT contest_id, season, d, home, away, result, p_away / 2 + 1.0::DOUBLE / 6 AS p_away, p_draw / 2 + 1.0::DOUBLE / 6 AS p_draw, p_home / 2 + 1.0::DOUBLE / 6 AS p_home FROM {predictions})"
MET = "count(*) AS n, avg((predicted = result)::INT) AS accuracy, avg(nll) AS log_loss, avg(brier) AS brier_score"
M = list(O.METRICS)

R.add("row_scores", scored, f"WITH {sc()} SELECT * FROM s", ["p_away", "p_draw", "p_home", "confidence", "p_true", "nll", "brier"])
R.add("metrics_by_fold_pooled", lambda v: O.metrics_by_fold_pooled(scored(v)), f"WITH {sc()} SELECT season, {MET} FROM s GROUP BY ROLLUP (season)", M)
DELTA = f"""{sc()}, {sc(HALF, "h")}, a AS (SELECT season, {MET} FROM s GROUP BY ROLLUP (season)), b AS (SELECT season, {MET} FROM h GROUP BY ROLLUP (season)),
dl AS (SELECT a.season, a.n, true AS same_rows, {", ".join(f"b.{m} - a.{m} AS {m}_delta" for m in M)} FROM a JOIN b ON a.season IS NOT DISTINCT FROM b.season)"""
delta = lambda v: O.metric_delta(O.metrics_by_fold_pooled(scored(v)), O.metrics_by_fold_pooled(other(v)))
R.add("metric_delta", delta, f"WITH {DELTA} SELECT * FROM dl", [f"{m}_delta" for m in M])
R.add("confusion", lambda v: O.confusion(scored(v)), f"WITH {sc()} SELECT result, " + ", ".join(f"count(CASE WHEN predicted = {k} THEN 1 END) AS predicted_{k}" for k in range(3)) + " FROM s GROUP BY 1")
CLS = "c AS (" + " UNION ALL ".join(f"SELECT contest_id, season, home, away, {i} AS class, {p} AS p, result = {i} AS hit FROM {{predictions}}" for i, p in enumerate(O.P)) + ")"


def edge(x: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {e} THEN {i}" for i, e in reversed(list(enumerate(edges[:-1])))) + " END"


R.add(
    "reliability_bins", lambda v: O.reliability_bins(v("predictions")),
    f"WITH {CLS} SELECT class, {edge('p', O.TENTHS)} AS bin, count(*) AS n, avg(p) AS mean_p, avg(hit::INT) AS frequency, avg(p) - avg(hit::INT) AS bias, count(*) < 30 AS is_sparse FROM c GROUP BY 1, 2",
    ["mean_p", "frequency", "bias"],
)
R.add(
    "draw_calibration", lambda v: O.draw_calibration(v("predictions")),
    f"SELECT {edge('p_draw', (0, 0.1, 0.2, 0.3, 0.4, 1))} AS bin, count(*) AS n, avg(p_draw) AS mean_p, avg((result = 1)::INT) AS frequency FROM {{predictions}} GROUP BY 1", ["mean_p", "frequency"],
)
R.add("draw_table", lambda v: O.draw_table(scored(v)), f"WITH {sc()} SELECT result = 1 AS drawn, count(*) AS n, avg(p_draw) AS mean_draw, avg(nll) AS log_loss, count(CASE WHEN predicted = 1 THEN 1 END) AS predicted_draws FROM s GROUP BY 1", ["mean_draw", "log_loss"])
R.add(
    "draw_diagnostic", lambda v: O.draw_table(scored(v)).select("drawn", "n", "predicted_draws"),
    f"WITH {sc()} SELECT result = 1 AS drawn, count(*) AS n, count(CASE WHEN predicted = 1 THEN 1 END) AS predicted_draws FROM s GROUP BY 1",
)
R.add("near_even_metrics", lambda v: O.near_even_metrics(scored(v)), f"WITH {sc()} SELECT {MET} FROM s WHERE abs(p_home - p_away) < 0.05", M)
R.add(
    "confidence_bins", lambda v: O.confidence_bins(scored(v)),
    f"WITH {sc()}, b AS (SELECT *, {edge('confidence', (0, 0.4, 0.5, 0.6, 0.7, 1))} AS bin FROM s) SELECT bin, predicted, count(*) AS n, avg((predicted = result)::INT) AS accuracy, avg(confidence) AS mean_confidence, avg((predicted = result)::INT) - avg(confidence) AS excess FROM b GROUP BY GROUPING SETS ((bin), (bin, predicted))",
    ["accuracy", "mean_confidence", "excess"],
)
R.add(
    "rating_diff_bins", lambda v: O.rating_diff_bins(v("predictions").withColumn("diff", F.col("home") - F.col("away")), "diff", (-200, -50, -20, 0, 20, 50, 200)),
    f"SELECT {edge('(home - away)', (-200, -50, -20, 0, 20, 50, 200))} AS bin, count(*) AS n, " + ", ".join(f"avg((result = {k})::INT) AS share_{k}" for k in range(3)) + ", avg(p_home) AS mean_home FROM {predictions} GROUP BY 1",
    ["share_0", "share_1", "share_2", "mean_home"],
)
PHASE = "CASE WHEN rno <= 5 THEN 'early' WHEN rno <= 29 THEN 'middle' ELSE 'late' END"


def in_transition(v):
    """Scored rows with the phase of the season and the statuses and ordinals of both sides."""
    phase = season_phase(F.col(ID) % 38 + 1).alias("season_phase")
    return scored(v).join(FE.appearance_ordinal(v("contests")), ID).select("*", phase)


STATUS = """m AS (SELECT DISTINCT season, e FROM {appearances}), o AS (SELECT contest_id, side, row_number() OVER (PARTITION BY e, season ORDER BY d, CAST(contest_id AS VARCHAR)) AS o,
  CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.e = a.e AND m.season = a.season - 1) THEN 'ESTABLISHED' WHEN EXISTS (SELECT 1 FROM m WHERE m.e = a.e AND m.season < a.season) THEN 'RETURNING' ELSE 'FIRST_TIME_IN_SCOPE' END AS st FROM {appearances} a),
tr AS (SELECT s.*, contest_id % 38 + 1 AS rno, h.o AS ho, a.o AS ao, h.st AS hs, a.st AS aws FROM s JOIN (SELECT * FROM o WHERE side = 'home') h USING (contest_id) JOIN (SELECT * FROM o WHERE side = 'away') a USING (contest_id))"""


def _masks() -> dict[str, str]:
    any5, both5 = "(ho <= 5 OR ao <= 5)", "(ho <= 5 AND ao <= 5)"
    out = {f"phase:{p}": f"{PHASE} = '{p}'" for p in ("early", "middle", "late")} | {"any_first5": any5, "neither_first5": f"NOT {any5}", "both_first5": both5}
    out |= {"home_first5": "ho <= 5", "home_6plus": "ho > 5", "away_first5": "ao <= 5", "away_6plus": "ao > 5"}
    who = {"promoted_involved": "(hs <> 'ESTABLISHED' OR aws <> 'ESTABLISHED')", "returning_involved": "(hs = 'RETURNING' OR aws = 'RETURNING')", "established_only": "(hs = 'ESTABLISHED' AND aws = 'ESTABLISHED')"}
    for n, x in who.items():
        out |= {n: x} | {f"{n}:phase:{p}": f"{x} AND {PHASE} = '{p}'" for p in ("early", "middle", "late")} | {f"{n}:first5:0": f"{x} AND NOT {any5}", f"{n}:first5:1": f"{x} AND {any5}"}
    out |= {f"not:{n}": f"NOT {who[n]}" for n in ("promoted_involved", "returning_involved")} | {"core": f"{who['established_only']} AND NOT {any5}"}
    for side, st, o in (("home", "hs", "ho"), ("away", "aws", "ao")):
        out |= {f"{side}:{x}:first5:{k}": f"{st} = '{x}' AND ({o} <= 5) = {bool(k)}" for x in ("ESTABLISHED", "RETURNING", "FIRST_TIME_IN_SCOPE") for k in (0, 1)}
    return out


SEGMENTS = " UNION ALL ".join(f"SELECT '{n}' AS segment, * FROM tr WHERE {x}" for n, x in _masks().items())
R.add(
    "segment_metrics", lambda v: O.segment_metrics(in_transition(v), O.transition_masks()),
    f"WITH {sc()}, {STATUS}, g AS ({SEGMENTS}) SELECT segment, {MET} FROM g GROUP BY 1", M,
)
R.add(
    "promotion_segments",
    lambda v: O.promotion_segments(scored(v).join(FE.min_ordinal_promoted(v("contests")), ID).join(FE.appearance_ordinal(v("contests")).select(ID, "returning_involved", "promoted_involved"), ID), F.when(F.col("returning_involved"), "returning").when(F.col("promoted_involved"), "first_time").otherwise("none"), "min_ordinal"),
    f"""WITH {sc()}, {STATUS}, n AS (SELECT contest_id, CASE WHEN hs = 'RETURNING' OR aws = 'RETURNING' THEN 'returning' WHEN hs <> 'ESTABLISHED' OR aws <> 'ESTABLISHED' THEN 'first_time' ELSE 'none' END AS status,
  CASE WHEN season > (SELECT min(season) FROM m) THEN least(CASE WHEN hs <> 'ESTABLISHED' THEN ho END, CASE WHEN aws <> 'ESTABLISHED' THEN ao END) END AS mo FROM tr),
g AS (SELECT s.*, status, CASE WHEN mo <= 3 THEN '1-3' WHEN mo <= 10 THEN '4-10' WHEN mo IS NOT NULL THEN '11+' ELSE 'none' END AS ordinal_range FROM s JOIN n USING (contest_id))
SELECT status, ordinal_range, {MET} FROM g GROUP BY CUBE (status, ordinal_range)""", M,
)
R.add("favorite_outcome", lambda v: O.favorite_outcome(v("predictions")), "SELECT CASE WHEN p_home > p_away THEN 'home' WHEN p_home < p_away THEN 'away' ELSE 'none' END AS favorite, result, count(*) AS n FROM {predictions} GROUP BY 1, 2")
R.add(
    "localization_mass", lambda v: O.localization_mass(v("predictions"), F.col("home") <= 20),
    f"WITH {CLS}, r AS (SELECT *, hit::INT - p AS r FROM c) SELECT class, CASE WHEN r >= 0 THEN 'under' ELSE 'over' END AS direction, sum(abs(r)) AS mass, sum(CASE WHEN home <= 20 THEN abs(r) ELSE 0 END) AS inside, sum(CASE WHEN home <= 20 THEN abs(r) ELSE 0 END) / sum(abs(r)) AS share FROM r GROUP BY 1, 2",
    ["mass", "inside", "share"],
)
CELLS = """x AS (SELECT season, unnest([home, away]) AS e, nll FROM s), p AS (SELECT season, e, count(*) AS n, sum(nll) AS total_nll, avg(nll) AS log_loss FROM x GROUP BY 1, 2)"""
R.add(
    "entity_cells", lambda v: O.entity_cells(scored(v)),
    f"WITH {sc()}, {CELLS} SELECT *, total_nll / sum(total_nll) OVER (PARTITION BY season) AS period_share, total_nll / sum(total_nll) OVER () AS pooled_share FROM p", ["total_nll", "log_loss", "period_share", "pooled_share"],
)
R.add(
    "entity_concentration", lambda v: O.entity_concentration(scored(v)),
    f"""WITH {sc()}, {CELLS}, q AS (SELECT *, season AS g, row_number() OVER (PARTITION BY season ORDER BY total_nll DESC, season, e) AS k FROM p UNION ALL SELECT *, NULL, row_number() OVER (ORDER BY total_nll DESC, season, e) FROM p)
SELECT g AS season, count(*) AS entities, sum(CASE WHEN k <= 5 THEN total_nll END) / sum(total_nll) AS top_share, quantile_cont(log_loss, 0.25) AS q1, quantile_cont(log_loss, 0.5) AS q2, quantile_cont(log_loss, 0.75) AS q3, quantile_cont(log_loss, 0.75) - quantile_cont(log_loss, 0.25) AS iqr FROM q GROUP BY 1""",
    ["top_share", "q1", "q2", "q3", "iqr"],
)
R.add(
    "calibration_context", lambda v: O.calibration_context(v("predictions")),
    "SELECT season, " + ", ".join(f"avg({p}) AS mean_{i}, avg((result = {i})::INT) AS share_{i}" for i, p in enumerate(O.P)) + " FROM {predictions} GROUP BY 1", [f"{x}_{i}" for x in ("mean", "share") for i in range(3)],
)
R.add(
    "decision_gate", lambda v: O.decision_gate(delta(v)),
    f"""WITH {DELTA}, g AS (SELECT max(CASE WHEN season IS NULL THEN log_loss_delta END) AS ll, max(CASE WHEN season IS NULL THEN brier_score_delta END) AS br, count(CASE WHEN season IS NOT NULL AND log_loss_delta < 0 THEN 1 END) AS better_folds FROM dl)
SELECT *, CASE WHEN ll < 0 AND br <= 0 AND better_folds >= 3 THEN 'CONTINUE' WHEN ll >= 0 THEN 'CLOSE' ELSE 'INCONCLUSIVE' END AS decision FROM g""",
    ["ll", "br"],
)
cands = lambda v: scored(v).groupBy((F.col(ID) % 4).alias("name")).agg(F.round(F.avg("nll"), 1).alias("log_loss")).withColumns({"complexity": 5 - F.col("name"), "passes": F.col("name") != 3})
R.add(
    "select_candidate", lambda v: O.select_candidate(cands(v)),
    f"WITH {sc()}, c AS (SELECT contest_id % 4 AS name, round(avg(nll), 1) AS log_loss, 5 - contest_id % 4 AS complexity, contest_id % 4 <> 3 AS passes FROM s GROUP BY 1) SELECT * FROM c WHERE passes AND log_loss <= (SELECT min(log_loss) FROM c WHERE passes) + 1e-12 ORDER BY complexity, name LIMIT 1", ["log_loss"],
)
R.add(
    "lane_decision", lambda v: O.lane_decision(v("predictions")),
    f"WITH {CLS}, b AS (SELECT class, season, avg(p - hit::INT) AS b FROM c GROUP BY 1, 2), o AS (SELECT class, count(CASE WHEN b > 0.02 THEN 1 END) AS over, count(CASE WHEN b < -0.02 THEN 1 END) AS under FROM b GROUP BY 1) SELECT *, CASE WHEN greatest(over, under) >= 3 THEN 'OPEN' ELSE 'CLOSED' END AS lane FROM o",
)
R.add("context_coverage", lambda v: O.context_coverage(v("appearances").withColumns({"known": F.col(ID) % 10 != 0, "changed": F.col("e") % 3 == 0}), ["known", "changed"]), "SELECT season, avg((contest_id % 10 <> 0)::INT) AS known_share, avg((e % 3 = 0)::INT) AS changed_share FROM {appearances} GROUP BY 1", ["known_share", "changed_share"])
R.add(
    "expected_goals_summary", lambda v: O.expected_goals_summary(v("predictions").withColumn("lam", F.col("p_home") * 2 + 1), ["lam"]),
    "SELECT min(p_home * 2 + 1) AS lam_min, quantile_cont(p_home * 2 + 1, 0.5) AS lam_median, avg(p_home * 2 + 1) AS lam_mean, max(p_home * 2 + 1) AS lam_max, avg(p_home) AS mean_home, avg((result = 2)::INT) AS share_home FROM {predictions}",
    ["lam_min", "lam_median", "lam_mean", "lam_max", "mean_home", "share_home"],
)

# ---- versions
rev = lambda v, r: v("schedule_rev").where(f"rev = {r}").drop("rev")
J = """a AS (SELECT * FROM {schedule_rev} WHERE rev = 1), b AS (SELECT * FROM {schedule_rev} WHERE rev = 2)"""
#: The snapshots with what else a schedule has: an id and its namespace, and a note.
more = lambda v, r: rev(v, r).withColumns({
    "match_id": F.when(F.lit(r == 2) & (F.col("fixture_key") % 29 == 0), F.col("fixture_key") + 1).when(F.lit(r == 2) | (F.col("fixture_key") % 3 != 0), F.col("fixture_key")),
    "namespace": F.when(F.lit(r == 2) & (F.col("fixture_key") % 23 == 0), "site").otherwise("page"), "note": F.when(F.lit(r == 2) & (F.col("fixture_key") % 31 == 0), "moved"),
    "fetched": F.lit(r),
})
DIFF_FIELDS = ("d", "status", "score", "match_id", "namespace", "note")
MORE = """s AS (SELECT *, CASE WHEN rev = 2 AND fixture_key % 29 = 0 THEN fixture_key + 1 WHEN rev = 2 OR fixture_key % 3 <> 0 THEN fixture_key END AS match_id, CASE WHEN rev = 2 AND fixture_key % 23 = 0 THEN 'site' ELSE 'page' END AS namespace,
  CASE WHEN rev = 2 AND fixture_key % 31 = 0 THEN 'moved' END AS note FROM {schedule_rev}),
a AS (SELECT * FROM s WHERE rev = 1), b AS (SELECT * FROM s WHERE rev = 2)"""


def diff_sql(views: str, fields: tuple[str, ...], bridged: str = "false", fresh: str = "false") -> str:
    """Event kinds by UNION over a full join, from the rules for two rows of a fixture."""
    ids = "match_id" in fields
    pick = ", ".join(f"{t}.{c} AS {n}_{c}" for t, n in (("a", "before"), ("b", "after")) for c in fields)
    both = "k1 IS NOT NULL AND k2 IS NOT NULL"
    moved = f"({bridged} AND before_namespace = 'page' AND after_namespace = 'site')" if ids else "false"
    rules = {
        "NEW": "k1 IS NULL", "MISSING": "k2 IS NULL", "SCHEDULE_CHANGED": f"{both} AND before_d IS DISTINCT FROM after_d",
        "BRIDGE_ESTABLISHED": f"k2 IS NOT NULL AND {fresh}", "NAMESPACE_TRANSITION": f"{both} AND {moved}",
        "RESULT_CANDIDATE": f"(k1 IS NULL AND after_score IS NOT NULL) OR ({both} AND before_status <> 'completed' AND before_score IS DISTINCT FROM after_score)",
        "RESULT_CORRECTED": f"{both} AND before_status = 'completed' AND before_score IS DISTINCT FROM after_score",
        "COMPLETED": f"(k1 IS NULL AND after_status = 'completed') OR ({both} AND before_status <> 'completed' AND after_status = 'completed')",
        "UNCONFIRMED": f"{both} AND before_status = 'completed' AND after_status <> 'completed'",
    }
    if ids:
        rules["IDENTITY_LINKED"] = f"{both} AND NOT {moved} AND before_match_id IS NULL AND after_match_id IS NOT NULL"
        rules["IDENTITY_CONFLICT"] = f"{both} AND NOT {moved} AND before_match_id IS NOT NULL AND before_match_id IS DISTINCT FROM after_match_id"
    changed = [f"CASE WHEN before_{c} IS DISTINCT FROM after_{c} THEN '{c}' END" for c in sorted(fields)]
    union = " UNION ALL ".join(f"SELECT '{n}' AS event, j.* FROM j WHERE {x}" for n, x in rules.items())
    return f"""{views}, j AS (SELECT coalesce(a.fixture_key, b.fixture_key) AS fixture_key, a.fixture_key AS k1, b.fixture_key AS k2, {pick} FROM a FULL JOIN b ON a.fixture_key = b.fixture_key),
e1 AS ({union}), e2 AS (SELECT * FROM e1 UNION ALL SELECT 'METADATA_CHANGED', j.* FROM j WHERE {both} AND fixture_key NOT IN (SELECT fixture_key FROM e1) AND concat_ws(',', {', '.join(changed)}) <> ''),
ev AS (SELECT *, concat_ws(',', {', '.join(changed)}) AS changed_fields FROM e2)"""


def diff_rows(fields: tuple[str, ...]) -> str:
    cols = [f"{s}_{c}" for s in ("before", "after") for c in fields]
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols)
    return f"SELECT fixture_key, event, changed_fields, {', '.join(cols)}, sha256(concat_ws('|', CAST(fixture_key AS VARCHAR), event, {text})) AS event_id FROM ev"


PLAIN = ("d", "status", "score")
DIFF = diff_sql(J, PLAIN)
keys = lambda v, n: rev(v, 2).where(F.col("fixture_key") % n == 0).select("fixture_key")
R.add(
    "snapshot_diff", lambda v: V.snapshot_diff(more(v, 1), more(v, 2), ignored=["fetched"], bridged=keys(v, 23), established=keys(v, 46), spaces=("page", "site")),
    f"WITH {diff_sql(MORE, DIFF_FIELDS, 'fixture_key % 23 = 0', 'fixture_key % 46 = 0')} {diff_rows(DIFF_FIELDS)}",
)
off = lambda df, m: df.withColumn("official_id", F.when(F.col("fixture_key") % m == 0, F.col("fixture_key") + 1000))
R.add(
    "carry_forward_identity", lambda v: V.carry_forward_identity(off(rev(v, 1), 2), off(rev(v, 2), 3), ["d", "status"]).select("fixture_key", "official_id"),
    f"""WITH {J} SELECT b.fixture_key, CASE WHEN b.fixture_key % 3 = 0 THEN b.fixture_key + 1000 WHEN a.fixture_key % 2 = 0 AND a.d = b.d AND a.status = b.status AND NOT EXISTS (SELECT 1 FROM b u WHERE u.fixture_key % 3 = 0 AND u.fixture_key = a.fixture_key) THEN a.fixture_key + 1000 END AS official_id
FROM b LEFT JOIN a ON a.fixture_key = b.fixture_key""",
)
weak = lambda v: rev(v, 2).withColumn("status", F.when(F.col("fixture_key") % 5 == 0, "candidate").otherwise(F.col("status")))
R.add(
    "retain_completion", lambda v: V.retain_completion(rev(v, 1), weak(v), ["d", "score"]).select("fixture_key", "status"),
    f"""WITH {J}, w AS (SELECT fixture_key, d, score, CASE WHEN fixture_key % 5 = 0 THEN 'candidate' ELSE status END AS status FROM b)
SELECT w.fixture_key, CASE WHEN w.status = 'candidate' AND a.status = 'completed' AND a.d = w.d AND a.score IS NOT DISTINCT FROM w.score THEN 'completed' ELSE w.status END AS status FROM w LEFT JOIN a ON a.fixture_key = w.fixture_key""",
)
R.add(
    "id_bridge", lambda v: V.id_bridge(v("orders").select(F.col("o_orderkey").alias("fixture_key"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 9000).alias("a_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 11000).alias("b_id")), "a_id", "b_id"),
    """WITH r AS (SELECT o_orderkey AS fixture_key, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9000 END AS a_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 11000 END AS b_id FROM {orders}), t AS (SELECT * FROM r WHERE a_id IS NOT NULL AND b_id IS NOT NULL),
x AS (SELECT a_id FROM t GROUP BY 1 HAVING count(DISTINCT b_id) > 1), y AS (SELECT b_id FROM t GROUP BY 1 HAVING count(DISTINCT a_id) > 1),
s AS (SELECT *, CASE WHEN a_id IS NOT NULL AND b_id IS NOT NULL THEN CASE WHEN a_id IN (SELECT a_id FROM x) OR b_id IN (SELECT b_id FROM y) THEN 'CONFLICT' ELSE 'LINKED' END WHEN a_id IS NOT NULL OR b_id IS NOT NULL THEN 'PARTIAL' ELSE 'NONE' END AS status FROM r)
SELECT *, CASE WHEN status <> 'CONFLICT' THEN coalesce(a_id, b_id) END AS operational_id FROM s""",
)
R.add(
    "apply_evidence", lambda v: V.apply_evidence(rev(v, 1), rev(v, 2).where("fixture_key % 2 = 0")).select("fixture_key", "status", "conflict"),
    f"""WITH {J} SELECT a.fixture_key, CASE WHEN a.status = 'candidate' AND b.fixture_key IS NOT NULL AND a.d = b.d AND a.score IS NOT DISTINCT FROM b.score THEN 'completed' ELSE a.status END AS status,
a.status = 'candidate' AND b.fixture_key IS NOT NULL AND NOT (a.d = b.d AND a.score IS NOT DISTINCT FROM b.score) AS conflict FROM a LEFT JOIN b ON a.fixture_key = b.fixture_key AND b.fixture_key % 2 = 0""",
)
R.add(
    "publish_gate", lambda v: V.publish_gate(V.snapshot_diff(rev(v, 1), rev(v, 2)), ["MISSING", "UNCONFIRMED"], F.lit(5), F.lit(4), F.lit(False)),
    f"WITH {DIFF} SELECT count(*) AS events, count(CASE WHEN event IN ('MISSING', 'UNCONFIRMED') THEN 1 END) AS forbidden, 'forbidden_event,coverage' AS reasons, 'HOLD' AS status FROM ev",
)
R.add(
    "latest_published", lambda v: V.latest_published(v("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("revision"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("HELD").alias("status")), ["doc"]),
    "SELECT o_custkey AS doc, max(o_orderkey) AS revision, max(o_orderkey) AS seq FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1",
)
R.add(
    "version_history", lambda v: V.version_history(v("orders"), "o_custkey", "o_orderkey", "o_orderpriority"),
    "SELECT o_custkey, string_agg(concat(CAST(o_orderkey AS VARCHAR), ':', o_orderpriority), ',' ORDER BY o_orderkey) AS history, count(*) AS n, count(DISTINCT o_orderpriority) AS versions FROM {orders} GROUP BY 1",
)
R.add(
    "evidence_timing_class", lambda v: v("events").select("event_id", V.evidence_timing_class(F.col("event_id") % 7, F.col("event_id") % 11, F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 6)).alias("class")),
    """WITH x AS (SELECT event_id, event_id % 7 AS p, event_id % 11 AS r, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS u, CASE WHEN event_id % 13 <> 0 THEN event_id % 6 END AS s FROM {events})
SELECT event_id, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN r < s AND (u IS NULL OR u < s) THEN 'BEFORE_START' WHEN r < s THEN 'UPDATED_LATER' WHEN p < s THEN 'PUBLISHED_BEFORE_RETRIEVED_AFTER' ELSE 'AFTER_START' END AS class FROM x""",
)
R.add(
    "logical_state_merge",
    lambda v: V.logical_state_merge(v("appearances").withColumn("kind", F.when(F.col("e") % 3 == 0, "BASE").when((F.col("e") % 3 == 1) & (F.dayofmonth("d") % 3 != 0), "SUPPLEMENT").when(F.dayofmonth("d") % 3 == 0, "BASE")).where("kind is not null").groupBy("season", "d", "kind").agg(F.collect_set(F.col("e") % 12).alias("members"))),
    """WITH k AS (SELECT season, d, e % 12 AS m, CASE WHEN e % 3 = 0 THEN 'BASE' WHEN e % 3 = 1 AND day(d) % 3 <> 0 THEN 'SUPPLEMENT' WHEN day(d) % 3 = 0 THEN 'BASE' END AS kind FROM {appearances}), g AS (SELECT season, d, list(DISTINCT m) FILTER (WHERE kind = 'BASE') AS b, list(DISTINCT m) FILTER (WHERE kind = 'SUPPLEMENT') AS s FROM k WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT season, d, CASE WHEN b IS NULL THEN 'SUPPLEMENT_ONLY' WHEN s IS NULL THEN 'BASE_ONLY' WHEN len(list_intersect(b, s)) > 0 THEN 'CONFLICT' ELSE 'FULL' END AS state, len(list_distinct(list_concat(coalesce(b, []), coalesce(s, [])))) AS n FROM g""",
)
R.add(
    "profile_classify", lambda v: V.profile_classify(v("contest_events").where("minute < 30"), ["contest_id"], "event_type", {"CARDS": ["RED_CARD", "YELLOW_CARD"], "GOALS": ["GOAL"]}),
    "WITH g AS (SELECT contest_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM {contest_events} WHERE minute < 30 GROUP BY 1) SELECT *, CASE names WHEN 'RED_CARD,YELLOW_CARD' THEN 'CARDS' WHEN 'GOAL' THEN 'GOALS' ELSE 'UNKNOWN' END AS kind FROM g",
)
R.add(
    "snapshot_registry_audit",
    lambda v: V.snapshot_registry_audit(v("contest_events").where("contest_id % 5 <> 0").groupBy("contest_id").agg(F.count("*").alias("n_rows")), v("contest_events").where("contest_id % 7 <> 0"), v("contest_events").where("event_type <> 'GOAL'"), "contest_id"),
    """WITH c AS (SELECT contest_id, count(*) AS n, count(CASE WHEN event_type <> 'GOAL' THEN 1 END) AS g FROM {contest_events} GROUP BY 1), s AS (SELECT contest_id, CASE WHEN contest_id % 5 <> 0 THEN n END AS n_rows, CASE WHEN contest_id % 7 <> 0 THEN n END AS raw, nullif(g, 0) AS done FROM c)
SELECT *, CASE WHEN n_rows IS NULL THEN 'ORPHAN' WHEN raw IS NULL THEN 'MISSING_RAW' WHEN done IS NULL THEN 'MISSING_PROCESSED' WHEN raw <> n_rows OR done <> n_rows THEN 'COUNT_DIFFERS' ELSE 'OK' END AS status FROM s WHERE n_rows IS NOT NULL OR raw IS NOT NULL OR done IS NOT NULL""",
)
R.add(
    "dependent_gate", lambda v: V.dependent_gate(V.snapshot_diff(rev(v, 1), rev(v, 2)), rev(v, 1).where("fixture_key % 2 = 0"), rev(v, 1).where("fixture_key % 3 = 0")),
    f"WITH {DIFF} SELECT DISTINCT fixture_key FROM ev WHERE k1 IS NOT NULL AND fixture_key % 2 = 0 AND fixture_key % 3 <> 0",
)
R.add(
    "source_state_class", lambda v: rev(v, 1).join(rev(v, 2).select("fixture_key", F.col("score").alias("now")), "fixture_key").select("fixture_key", V.source_state_class(F.col("score"), F.col("now")).alias("state")),
    f"WITH {J} SELECT a.fixture_key, CASE WHEN a.score IS NULL OR b.score IS NULL THEN 'UNKNOWN' WHEN b.score > a.score THEN 'ADVANCED' WHEN b.score = a.score THEN 'UNCHANGED' ELSE 'REGRESSED' END AS state FROM a JOIN b ON a.fixture_key = b.fixture_key",
)
