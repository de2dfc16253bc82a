"""Rolling comparisons of logistic fits over all seasons that have an earlier one, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators import assembly as A
from rivalry.operators import features as FE
from rivalry.operators import goals as G
from rivalry.operators import link as L
from rivalry.operators import logits as LO
from rivalry.operators import models as M
from rivalry.operators import ratings as RA
from rivalry.operators import scoring as SC
from rivalry.operators.boosting import Boost, fit_boosted, predict_boosted
from rivalry.operators.logits import Candidate
from rivalry.plans import features as PF
from rivalry.plans import link as PL
from rivalry.plans import models as PM
from rivalry.plans.base import Registry, last_sql, pivot_sql, stored
from rivalry.plans.features import FORM_SQL, PLACE, stats
from rivalry.plans.fits import chained_sql, deltas_sql, logit_sql, metrics_sql, poisson_sql
from rivalry.plans.models import ID, elo_sql, feats, folds, strict

R = Registry()
RATING, ALL = ("rating_diff",), ("rating_diff", "points_diff", "goal_diff")
BOTH = lambda *names: tuple(f"{s}_{n}" for n in names for s in ("home", "away"))


def sub(registry: Registry, key: str) -> str:
    """A registered query's SQL, its doubles unrounded, as a subquery of SQL that is still to be filled in."""
    return "(" + registry.raw[key].replace("{", "{{").replace("}", "}}") + ")"


#: The rows of models.feats.
FEATS = f"""{elo_sql("{contests}")}, f0 AS ({last_sql(5, FORM_SQL)}), fo AS ({pivot_sql("f0", FORM_SQL)}),
fe AS MATERIALIZED (SELECT k.contest_id, k.season, k.d, k.home, k.away, k.result, rt.rating_diff, CAST(home_points - away_points AS DOUBLE) AS points_diff, CAST(home_gf_sum - away_gf_sum AS DOUBLE) AS goal_diff
FROM {{contests}} k JOIN rt ON rt.contest_id = k.contest_id JOIN fo ON fo.contest_id = k.contest_id)"""


def fitted(candidates, rows: str, end: str) -> str:
    """SQL that fits the candidates on rows: common table expressions that end with fr."""
    return f"WITH {rows},\n{logit_sql(candidates)}\n{end}"


def compared(rows: DataFrame, candidates: dict[str, Candidate], seasons) -> DataFrame:
    return SC.metrics_by_fold_pooled(SC.row_scores(LO.rolling_logits(rows, candidates, seasons)), by=["candidate"])


def against(rows: DataFrame, base: str, candidates: dict[str, Candidate], seasons) -> DataFrame:
    """Metric deltas of each candidate against `base`, all fitted together."""
    got = stored(compared(rows, candidates, seasons), "metrics")
    one = got.where(F.col("candidate") == base)
    parts = [SC.metric_delta(one, got.where(F.col("candidate") == c)).withColumn("challenger", F.lit(c)) for c in candidates if c != base]
    return reduce(DataFrame.unionByName, parts)


DELTAS = [f"{m}_delta" for m in SC.METRICS]
ONE = {"rating": Candidate(RATING)}
R.add(
    "logit_multinomial", lambda v: LO.rolling_logits(feats(v), ONE, folds(v)).select(ID, *M.P),
    fitted(ONE, f"{FEATS}, fr AS (SELECT * FROM fe)", "SELECT contest_id, p_away, p_draw, p_home FROM pr"), M.P,
)
BATCH = {"logit": Candidate(ALL)}


def batch(v) -> DataFrame:
    """Every season's unbound contests, by the fit on the seasons before; a seventh of the contests counts as predicted already."""
    rows = feats(v)
    bound = v("contests").where("contest_id % 7 = 0").select(ID)
    fits = LO.fit_logits(rows, BATCH, folds(v))
    left = rows.where(F.col("season").isin(folds(v))).join(bound, ID, "left_anti")
    return LO.predict_logits(left, BATCH, fits).select(ID, *M.P, F.col("candidate").alias("model"))


R.add("score_batch", batch, fitted(BATCH, f"{FEATS}, fr AS (SELECT * FROM fe)", "SELECT contest_id, p_away, p_draw, p_home, candidate AS model FROM pr WHERE contest_id % 7 <> 0"), M.P)

# ---- ablation and tuning on the full training table

PLACES, GAPS, KNOWN, MOMENTUM = BOTH("place_n", "place_points", "place_goal_diff"), BOTH("gap"), BOTH("known"), BOTH("momentum")
H2H = ("h2h_n", "h2h_points_diff", "h2h_goal_diff")
STATS = ("shots_diff", "corners_diff", "fouls_diff")
BEST = (*RATING, *PLACES, *GAPS, *KNOWN)
SETS = {
    "rating": RATING, "form": ALL[1:], "rating_form": ALL, "rating_venue_points": (*RATING, "venue_points_diff"), "rating_venue_goals": (*RATING, "venue_goal_diff"),
    "rating_venue": (*RATING, "venue_points_diff", "venue_goal_diff"), "rating_h2h": (*RATING, *H2H), "rating_place": (*RATING, *PLACES), "rating_h2h_place": (*RATING, *H2H, *PLACES),
    "place_gap_diff": (*RATING, *PLACES, "gap_diff", *KNOWN), "best": BEST, "h2h_place_gap_diff": (*RATING, *H2H, *PLACES, "gap_diff", *KNOWN), "best_h2h": (*BEST, *H2H),
    "best_momentum": (*BEST, *MOMENTUM), "best_momentum_h2h": (*BEST, *MOMENTUM, *H2H), "best_stats": (*BEST, *STATS),
    "all_numeric": ("home_rating", "away_rating", *RATING, *BOTH("points", "wins", "draws", "losses", "gf_sum", "ga_sum"), *H2H, *PLACES, *GAPS, "gap_diff", *KNOWN, *MOMENTUM),
}
ABLATION = {n: Candidate(tuple(x)) for n, x in SETS.items()}
#: Columns that are differences of the two sides' columns.
DIFFS = {"points_diff": "points", "goal_diff": "gf_sum", "venue_points_diff": "venue_points", "venue_goal_diff": "venue_goal_diff", "shots_diff": "shots_for", "corners_diff": "corners_for", "fouls_diff": "fouls_for"}
COLUMNS = sorted({x for c in SETS.values() for x in c})


def wide(v) -> DataFrame:
    """The full training table with sums of statistics, as doubles, written once."""
    out = A.plus_stats(PM.full(v), strict(v), stats(v), ["shots", "corners", "fouls"])
    made = {n: F.col(f"home_{x}") - F.col(f"away_{x}") for n, x in DIFFS.items()}
    return stored(out.select(ID, "season", F.col("label").alias("result"), *[made.get(c, F.col(c)).cast("double").alias(c) for c in COLUMNS]), "wide")


WIDE = {"ve": PM.VENUES, **PM.MATCHUP, "ga": PM.GAPS, "mo": PM.MOMENTUM, "ss": PM.SUMS}


def wide_sql(more: str = "") -> str:
    made = {n: f"home_{x} - away_{x}" for n, x in DIFFS.items()}
    picks = ", ".join(f"CAST({made.get(c, c)} AS DOUBLE) AS {c}" for c in COLUMNS)
    parts = "".join(f", {x}" for x in WIDE.values())
    joined = f"{PM.TB}, " + ", ".join(f"{n}.* EXCLUDE (contest_id)" for n in WIDE) + f" {PM.FROM} " + " ".join(f"JOIN {n} ON {n}.contest_id = k.contest_id" for n in WIDE)
    return PM.base_sql(f"{parts}, wide AS ({joined}), fe AS MATERIALIZED (SELECT contest_id, season, label AS result, {picks} FROM wide)")[len("WITH "):] + more


R.add("feature_set_ablation", lambda v: compared(wide(v), ABLATION, folds(v)), fitted(ABLATION, wide_sql(", fr AS (SELECT * FROM fe)"), metrics_sql()), SC.METRICS)
#: Penalties on the best set, and how many contests at the same place count.
PENALTIES, PLACE_WINDOWS = (0.1, 0.3, 1.0, 3.0, 10.0), (3, 5, 8, 10)
NTH = lambda n: tuple(f"{x}_{n}" for x in PLACES)
TUNING = {f"c{c:g}": Candidate(BEST, c) for c in PENALTIES} | {f"w{n}": Candidate((*RATING, *NTH(n), *GAPS, *KNOWN)) for n in PLACE_WINDOWS}


def tuning_rows(v) -> DataFrame:
    """What the candidates learn from and nothing else, written once; the place columns of all windows come from one pass."""
    k = strict(v)
    frames = [A.rated_rows(k).select(ID, *RATING), FE.schedule_gap(k), FE.place_forms(k, PLACE_WINDOWS)]
    rows = A.add_frames(k.select(ID, "season", "result"), frames)
    rows = stored(rows.select(ID, "season", "result", *[F.col(x).cast("double").alias(x) for x in (*RATING, *GAPS, *KNOWN, *[y for n in PLACE_WINDOWS for y in NTH(n)])]), "tuning")
    return rows.withColumns({x: F.col(f"{x}_5") for x in PLACES})  # the window of the training table


def tuning(v) -> DataFrame:
    return compared(tuning_rows(v), TUNING, folds(v))


_places = "".join(f", p{n} AS ({last_sql(n, PLACE, 'b.e = a.e AND b.place = a.place', base='sa')}), q{n} AS ({pivot_sql(f'p{n}', PLACE)})" for n in PLACE_WINDOWS)
_picks = ", ".join(f"CAST(q{n}.{x} AS DOUBLE) AS {x}_{n}" for n in PLACE_WINDOWS for x in PLACES)
R.add(
    "param_tuning", tuning,
    fitted(TUNING, wide_sql(f"{_places}, fr AS MATERIALIZED (SELECT fe.*, {_picks} FROM fe " + " ".join(f"JOIN q{n} ON q{n}.contest_id = fe.contest_id" for n in PLACE_WINDOWS) + ")"), metrics_sql()), SC.METRICS,
)

# ---- challengers of the rating


def sides(frame: DataFrame, values: dict) -> DataFrame:
    """One row per contest from rows (contest_id, side, ..): each value for both sides."""
    pick = [F.max(F.when(F.col("side") == s, x)).cast("double").alias(f"{s}_{n}") for n, x in values.items() for s in ("home", "away")]
    return frame.groupBy(ID).agg(*pick)


CHALLENGERS = {
    "rating": RATING, "form": ALL, "rest": (*RATING, *BOTH("rest", "rest_missing")), "parity": (*RATING, "parity"), "staff": (*RATING, *BOTH("tenure", "changed", "staff_known")),
    "statistics": (*RATING, *STATS), "lineup": (*RATING, *BOTH("overlap", "overlap_missing")),
}
ROLLING = {n: Candidate(tuple(x)) for n, x in CHALLENGERS.items()}


def challengers(v) -> DataFrame:
    k = v("contests")
    gap = sides(FE.multi_stream_rest(k), {"rest": F.coalesce("any_gap", F.lit(0)), "rest_missing": F.col("any_gap").isNull().cast("int")})
    staff = sides(FE.tenure_streak(PF.staff(v)), {"tenure": F.col("tenure"), "changed": F.col("changed").cast("int"), "staff_known": F.col("known").cast("int")})
    summed = FE.stats_lastn(k, stats(v), ["shots", "corners", "fouls"]).select(ID, *[(F.col(f"home_{DIFFS[x]}") - F.col(f"away_{DIFFS[x]}")).cast("double").alias(x) for x in STATS])
    overlap = FE.lineup_overlap(PF.lineups(v))
    overlap = overlap.select(ID, *[x for s in ("home", "away") for x in (F.coalesce(F.col(f"{s}_overlap"), F.lit(0)).cast("double").alias(f"{s}_overlap"), F.col(f"{s}_overlap").isNull().cast("double").alias(f"{s}_overlap_missing"))])
    rows = feats(v, [gap, staff, summed, overlap]).withColumn("parity", F.abs("rating_diff"))
    return against(stored(rows, "challengers"), "rating", ROLLING, folds(v))


def _sides_sql(source: str, values: dict[str, str]) -> str:
    return f"SELECT contest_id, {', '.join(f'''CAST(max(CASE WHEN side = '{s}' THEN {x} END) AS DOUBLE) AS {s}_{n}''' for n, x in values.items() for s in ('home', 'away'))} FROM {source} y GROUP BY 1"


_summed = ", ".join(f"CAST(home_{DIFFS[x]} - away_{DIFFS[x]} AS DOUBLE) AS {x}" for x in STATS)
_overlap = ", ".join(f"CAST(coalesce({s}_overlap, 0) AS DOUBLE) AS {s}_overlap, CAST({s}_overlap IS NULL AS DOUBLE) AS {s}_overlap_missing" for s in ("home", "away"))
R.add(
    "rolling_compare", challengers,
    fitted(ROLLING, f"""{FEATS}, g1 AS ({_sides_sql(sub(PF.R, "multi_stream_rest"), {"rest": "coalesce(any_gap, 0)", "rest_missing": "(any_gap IS NULL)::INT"})}),
g2 AS ({_sides_sql(sub(PF.R, "tenure_streak"), {"tenure": "tenure", "changed": "changed::INT", "staff_known": "known::INT"})}),
g3 AS (SELECT contest_id, {_summed} FROM {sub(PF.R, "stats_lastn")} y), g4 AS (SELECT contest_id, {_overlap} FROM {sub(PF.R, "lineup_overlap")} y),
fr AS MATERIALIZED (SELECT *, abs(rating_diff) AS parity FROM fe JOIN g1 USING (contest_id) JOIN g2 USING (contest_id) JOIN g3 USING (contest_id) JOIN g4 USING (contest_id))""", deltas_sql("rating")), DELTAS,
)

# ---- feature families, each on the rows that it can judge


def family(frame: DataFrame, columns, name: str) -> DataFrame:
    """The columns of a feature frame as doubles named <name>_<i>, and <name>_ok where all are known."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return frame.select(ID, *[F.col(c).cast("double").alias(f"{name}_{i}") for i, c in enumerate(columns)], known.alias(f"{name}_ok"))


#: Columns of the nine families.
FAMILIES = {
    "workload": BOTH("squad_minutes_7", "squad_minutes_14"), "discipline": BOTH("yellow_rate", "red_rate"), "first_event": BOTH("scored_rate", "conceded_rate"), "timing": BOTH("scored_mean", "conceded_mean"),
    "substitution": BOTH("subs_mean"), "lineup": BOTH("overlap"), "draws": ("last_mean", "season_mean"), "previous": BOTH("gf_rate", "ga_rate"), "h2h": ("wins", "draws"),
}


def families(v) -> dict[str, DataFrame]:
    k, ev = v("contests"), stored(v("contest_events"), "events")  # four families read the events
    xi = v("squads").where("starter").groupBy(ID, "d", "e").agg(F.collect_set("player").alias("xi")).join(FE.appearances(k).select(ID, "e", "side"), [ID, "e"])
    h2h = FE.h2h_cumulative(k).withColumn("wins", F.when(F.col("h2h_available"), F.col("h2h_home_wins"))).withColumn("draws", F.when(F.col("h2h_available"), F.col("h2h_draws")))
    return {
        "workload": FE.workload_windows(k, v("squads")), "discipline": FE.discipline_rates(k, ev), "first_event": FE.first_event_profile(k, ev, PF.unseen(v)), "timing": FE.event_timing_profile(k, ev),
        "substitution": FE.substitution_profile(k, ev), "lineup": FE.lineup_overlap(xi), "draws": FE.draw_rates(k), "previous": L.previous_period_profile(k, v("profiles").where("e % 10 <> 3 or stat = 'gf'"), ["gf", "ga"]), "h2h": h2h,
    }


NINE = ONE | {n: Candidate((*RATING, *[f"{n}_{i}" for i in range(len(x))]), flag=f"{n}_ok") for n, x in FAMILIES.items()}


def nine(v) -> DataFrame:
    rows = feats(v, [family(frame, FAMILIES[n], n) for n, frame in families(v).items()])
    return M.family_metrics(rows, NINE, "rating", folds(v))


def _family_sql(name: str, source: str) -> str:
    x = FAMILIES[name]
    return f"SELECT contest_id, {', '.join(f'CAST({c} AS DOUBLE) AS {name}_{i}' for i, c in enumerate(x))}, {' AND '.join(f'{c} IS NOT NULL' for c in x)} AS {name}_ok FROM {source} y"


_sources = {"workload": "workload_windows", "discipline": "discipline_rates", "first_event": "first_event_profile", "timing": "event_timing_profile", "substitution": "substitution_profile", "lineup": "lineup_overlap", "draws": "draw_rates"}
_frames = {n: sub(PF.R, key) for n, key in _sources.items()} | {"previous": sub(PL.R, "previous_period_profile")}
_frames["h2h"] = f"(SELECT contest_id, CASE WHEN h2h_available THEN h2h_home_wins END AS wins, CASE WHEN h2h_available THEN h2h_draws END AS draws FROM {sub(PF.R, 'h2h_cumulative')} y)"
_flag = "CASE family " + " ".join(f"WHEN '{n}' THEN {n}_ok" for n in FAMILIES) + " END"
R.add(
    "family_evaluation", nine,
    fitted(NINE, f"""{FEATS}, {", ".join(f"n_{n} AS ({_family_sql(n, _frames[n])})" for n in FAMILIES)},
fr AS MATERIALIZED (SELECT * FROM fe {" ".join(f"JOIN n_{n} USING (contest_id)" for n in FAMILIES)})""", f"""
, w AS (SELECT b.contest_id, b.season, b.result, b.p_away, b.p_draw, b.p_home, family, {_flag} AS flagged FROM pr b JOIN fr USING (contest_id) CROSS JOIN (SELECT unnest({list(FAMILIES)}) AS family) f WHERE b.candidate = 'rating'),
o AS (SELECT w.*, c.p_away AS ca, c.p_draw AS cd, c.p_home AS ch FROM w LEFT JOIN pr c ON c.contest_id = w.contest_id AND c.candidate = w.family),
u AS (SELECT season, result, coalesce(ca, p_away) AS p_away, coalesce(cd, p_draw) AS p_draw, coalesce(ch, p_home) AS p_home, family, 'operational' AS population FROM o
UNION ALL SELECT season, result, ca, cd, ch, family, 'challenger_matched' FROM o WHERE ca IS NOT NULL UNION ALL SELECT season, result, p_away, p_draw, p_home, family, 'baseline_matched' FROM o WHERE flagged
UNION ALL SELECT season, result, p_away, p_draw, p_home, '', 'baseline_all' FROM pr WHERE candidate = 'rating')
{metrics_sql("u", "family, population")}"""), SC.METRICS,
)

# ---- goals with an attack and a defence effect of each entity

ASKED = [ID, "side", "e", "opp", "at_home"]
OB = "SELECT contest_id, side, season, d, e, opp, CAST(gf AS DOUBLE) AS gf, CAST(side = 'home' AS DOUBLE) AS at_home FROM {appearances}"
HALF_LIFE = 365.0
DECAY = f"exp(-ln(2) * date_diff('day', d, last) / {HALF_LIFE})"


def gaps(v) -> DataFrame:
    """Observations with the rating difference as the scoring side sees it, in hundreds."""
    r = RA.replay(v("contests")).select(ID, F.expr("stack(2, 'home', rating_diff, 'away', -rating_diff) AS (side, diff)"))
    return M.goal_observations(v("contests")).join(r, [ID, "side"]).withColumn("diff", F.col("diff") / 100)


def goals_sql(ob: str, numeric: list[str], **more) -> str:
    """ob: common table expressions that end with ob."""
    return f"WITH RECURSIVE {ob}, {poisson_sql(numeric, **more)} SELECT {', '.join(ASKED + numeric[1:])}, lam FROM pr"


RATED_OB = f"{elo_sql('{contests}')[len('RECURSIVE '):]}, ob AS MATERIALIZED (SELECT o.*, CASE WHEN side = 'home' THEN rating_diff ELSE -rating_diff END / 100 AS diff FROM ({OB}) o JOIN rt USING (contest_id))"
R.add("poisson_goals", lambda v: G.poisson_goals(M.goal_observations(v("contests")), folds(v), stored).select(*ASKED, "lam"), goals_sql(f"ob AS MATERIALIZED ({OB})", ["at_home"]), ["lam"])
R.add("poisson_goals_elo", lambda v: G.poisson_goals(gaps(v), folds(v), stored, ["diff"]).select(*ASKED, "diff", "lam"), goals_sql(RATED_OB, ["at_home", "diff"]), ["diff", "lam"])
R.add(
    "poisson_goals_decay", lambda v: G.poisson_goals(M.goal_observations(v("contests")), folds(v), stored, half_life=HALF_LIFE).select(*ASKED, "lam"),
    goals_sql(f"ob AS MATERIALIZED ({OB})", ["at_home"], weight=DECAY), ["lam"],
)

# ---- rating variants: one replay, then one fit of each

#: Variant -> the pools that it is replayed in and the configuration.
VARIANTS = {"own": ("own", "base"), "joined": ("joined", "base"), "prior": ("joined", "prior"), "calibrated": ("joined", "offset"), "hybrid": ("joined", "hybrid"), "reset": ("joined", "reset"), "bridged": ("bridged", "base")}
SETTINGS = [
    {"config": "base", "use_prior": False}, {"config": "prior"}, {"config": "offset", "use_prior": False, "offset": True},
    {"config": "hybrid", "use_prior": False, "reset": "first_time"}, {"config": "reset", "use_prior": False, "reset": "returning"},
]
VARIANT = {n: Candidate((n,)) for n in VARIANTS}


def variants(v) -> DataFrame:
    """(contest_id, a column per variant): each competition by itself, two competitions joined with five rules, and all bridged."""
    two = F.when(F.col("competition").isin("BUILDING", "MACHINERY"), "PAIR").otherwise(F.col("competition"))
    pools = F.array(F.concat(F.lit("own:"), "competition"), F.concat(F.lit("joined:"), two), F.lit("bridged:all"))
    rows = v("contests").withColumn("pool", F.explode(pools)).withColumns({f"prior_{s}": F.when(F.col(s) % 5 == 0, 1400.0).otherwise(1500.0) for s in ("home", "away")})
    got = RA.replay(rows, SETTINGS, pool="pool", events=PM.moves(v)).withColumn("kind", F.split("pool", ":")[0])
    which = F.coalesce(*[F.when((F.col("kind") == kind) & (F.col("config") == config), F.lit(i)) for i, (kind, config) in enumerate(VARIANTS.values())])
    # shuffled before they are aggregated, as the task of the one pool of all contests would hold a group for each
    got = got.select(ID, which.cast("tinyint").alias("which"), "rating_diff").where("which is not null").repartition(ID)
    return got.groupBy(ID).agg(*[F.max(F.when(F.col("which") == i, F.col("rating_diff"))).alias(n) for i, n in enumerate(VARIANTS)])


def two_ratings(v) -> DataFrame:
    rows = v("contests").select(ID, "season", "result").join(variants(v), ID)
    return against(stored(rows, "variants"), "own", VARIANT, folds(v))


_joined = "(SELECT * REPLACE (CASE WHEN competition IN ('BUILDING', 'MACHINERY') THEN 'PAIR' ELSE competition END AS competition) FROM {contests})"
_all = "(SELECT * REPLACE ('all' AS competition) FROM {contests})"
_rules = {
    "own": {"source": "{contests}"}, "joined": {"source": _joined}, "prior": {"source": _joined, "prior": "CASE WHEN e % 5 = 0 THEN 1400.0 ELSE 1500.0 END"}, "calibrated": {"source": _joined, "moves": "offset"},
    "hybrid": {"source": _joined, "moves": "first_time"}, "reset": {"source": _joined, "moves": "returning"}, "bridged": {"source": _all},
}


def variants_sql(names) -> str:
    parts = [elo_sql(t=f"_{n}", **_rules[n])[len("RECURSIVE "):] for n in names]
    picks = ", ".join(f"rt_{n}.rating_diff AS {n}" for n in names)
    return f"RECURSIVE {PM.MOVES}, {', '.join(parts)}, va AS MATERIALIZED (SELECT k.contest_id, k.season, k.result, {picks} FROM {{contests}} k " + " ".join(f"JOIN rt_{n} ON rt_{n}.contest_id = k.contest_id" for n in names) + ")"


R.add("competition_rating_compare", two_ratings, fitted(VARIANT, f"{variants_sql(VARIANTS)}, fr AS (SELECT * FROM va)", deltas_sql("own")), DELTAS)
R.add(
    "elo_grid", lambda v: RA.replay(strict(v), RA.grid([10, 15, 20, 30, 40], range(0, 201, 25))),
    f"""WITH {elo_sql("(SELECT k.* REPLACE (concat(competition, '|k', kx, 'a', ax) AS competition), kx, ax FROM {contests_strict} k CROSS JOIN (SELECT unnest([10, 15, 20, 30, 40]) AS kx) x CROSS JOIN (SELECT unnest(range(0, 201, 25)) AS ax) y)", k="kx::DOUBLE", adv="ax::DOUBLE")}
SELECT split_part(pool, '|', 1) AS pool, split_part(pool, '|', 2) AS config, contest_id, home_rating, away_rating, rating_diff FROM rt""", PM.RATES,
)

# ---- candidates on the same folds: architectures, season rules of ratings, calibrators of earlier out-of-fold rows, a held-out season

CANDIDATES = {"rating": Candidate(RATING), "form": Candidate(ALL[1:]), "all": Candidate(ALL), "joined": Candidate(("joined",)), "calibrated": Candidate(("calibrated",)), "reset": Candidate(("reset",))}


def candidates(v) -> DataFrame:
    rows = stored(feats(v).join(variants(v), ID), "candidates")
    got = stored(LO.rolling_logits(rows, CANDIDATES, folds(v)).select(ID, "season", "result", "candidate", *M.P), "out-of-fold")
    base = stored(got.where(F.col("candidate") == "rating").drop("candidate"), "base")  # calibrators pass over it many times
    every = got.unionByName(M.chained(base, folds(v)).withColumnRenamed("kind", "candidate"))
    return M.held_out_metrics(every, folds(v)[-1])


_own = ("joined", "calibrated", "reset")
R.add(
    "candidate_evaluation", candidates,
    fitted(CANDIDATES, f"{variants_sql(_own)}, {FEATS[len('RECURSIVE '):]}, fr AS MATERIALIZED (SELECT fe.*, {', '.join(_own)} FROM fe JOIN va USING (contest_id))", f""", {chained_sql(M.KINDS, "(SELECT * FROM pr WHERE candidate = 'rating')")},
u AS (SELECT season, result, candidate, p_away, p_draw, p_home FROM pr UNION ALL SELECT season, result, kind, p_away, p_draw, p_home FROM ch), w AS (SELECT *, CASE WHEN season >= (SELECT max(season) FROM u) THEN 'holdout' ELSE 'development' END AS part FROM u)
{metrics_sql("w", "candidate, part")}"""), SC.METRICS,
)

# ---- boosted trees: ablation and tuning on the last season, the fixed state model on all folds

CONTEXT = (*RATING, *PLACES, *GAPS, *KNOWN)
TREE_SETS = {"rating": RATING, "context": CONTEXT, "context_momentum": (*CONTEXT, *MOMENTUM), "context_momentum_h2h": (*CONTEXT, *MOMENTUM, *H2H), "all_numeric": SETS["all_numeric"]}
TREE_PARAMETERS = {
    "very_small": {"trees": 80, "rate": 0.03, "leaves": 3, "depth": 2, "least": 80, "lam": 5.0}, "small": {"trees": 120, "rate": 0.03, "leaves": 5, "depth": 3, "least": 60, "lam": 3.0},
    "small_regularized": {"trees": 150, "rate": 0.03, "leaves": 7, "depth": 3, "least": 50, "alpha": 0.5, "lam": 5.0}, "conservative": {"trees": 100, "rate": 0.05, "leaves": 5, "depth": 3, "least": 100, "alpha": 1.0, "lam": 10.0},
}
STATE = (*RATING, *BOTH("points", "gf_sum", "ga_sum"), "points_diff", "goal_diff")
BOOSTED = {f"set_{n}": Boost(tuple(x), leaves=15, depth=4) for n, x in TREE_SETS.items()}
BOOSTED |= {f"{name}_{n}": Boost(tuple(TREE_SETS[n]), **more) for n in ("context", "all_numeric") for name, more in TREE_PARAMETERS.items()}
BOOSTED |= {"state": Boost(STATE, leaves=5, depth=3)}


def boosted(v) -> DataFrame:
    rows, years = wide(v), folds(v)
    fits = fit_boosted(rows, BOOSTED, {n: years if n == "state" else years[-1:] for n in BOOSTED}, stored)
    return SC.metrics_by_fold_pooled(SC.row_scores(predict_boosted(rows, BOOSTED, fits)), by=["candidate"])


R.add("boosted_trees", boosted, None, SC.METRICS)
