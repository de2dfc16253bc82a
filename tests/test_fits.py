"""Fits of many models at once against plain numpy."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivalry.operators import boosting as B
from rivalry.operators import goals as G
from rivalry.operators import levels as LV
from rivalry.operators import logits as LO
from rivalry.operators import models as M
from rivalry.operators import ratings as RA
from rivalry.plans import models as PM
from rivalry.plans import rolling as PR
from rivalry.plans.base import stored, view

DATA = "/root/testdata/sf0.001"
FOLDS = [2002, 2003]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.2] + [0, 3, 0]
    y = (x @ np.array([[0, 0.6, 1.0], [0, -0.1, 0.05], [0, 1, 2]]) + rng.gumbel(size=(500, 3))).argmax(1)
    return x, y, 2001 + np.arange(500) % 3


@pytest.fixture(scope="module")
def rows(spark, table):
    x, y, season = table
    made = [(i, int(season[i]), int(y[i]), *map(float, x[i]), i % 4 != 0, None if i % 4 == 0 else float(x[i, 0])) for i in range(len(x))]
    return spark.createDataFrame(made, "contest_id long, season int, result int, a double, b double, c double, seen boolean, d double").repartition(3).persist()


def optimum(x, y, c):
    """Gradient steps on the penalised loss of three coefficient vectors, to convergence."""
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros((x.shape[1], 3)), np.zeros(3)
    for _ in range(20_000):
        p = np.exp(z @ w + b)
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(3)[y]) / len(y)
        w -= 0.5 * (z.T @ g + w / c / len(y))
        b -= 0.5 * g.sum(0)
    return lambda v: (lambda e: e / e.sum(1, keepdims=True))(np.exp((v - x.mean(0)) / x.std(0) @ w + b))


def test_logits_of_all_folds_and_candidates(rows, table):
    x, y, season = table
    cands = {"one": LO.Candidate(("a",)), "all": LO.Candidate(("a", "b", "c"), 0.1), "flagged": LO.Candidate(("d",), flag="seen")}
    got = LO.rolling_logits(rows, cands, FOLDS).collect()
    seen = np.arange(500) % 4 != 0
    for name, cols, c, use in (("one", [0], 1.0, seen | True), ("all", [0, 1, 2], 0.1, seen | True), ("flagged", [0], 1.0, seen)):
        own = {r.contest_id: (r.p_away, r.p_draw, r.p_home) for r in got if r.candidate == name}
        assert set(own) == set(np.flatnonzero((season > 2001) & use).tolist())
        for fold in FOLDS:
            past, now = (season < fold) & use, np.flatnonzero((season == fold) & use)
            want = optimum(x[past][:, cols], y[past], c)(x[now][:, cols])
            assert np.abs(want - np.array([own[i] for i in now.tolist()])).max() < 1e-6


def test_logits_say_what_they_cannot_fit(spark, rows):
    with pytest.raises(ValueError, match="null"):
        LO.fit_logits(rows, {"x": LO.Candidate(("d",))}, FOLDS)
    with pytest.raises(ValueError, match="result is missing"):
        LO.fit_logits(rows.where("result <> 1"), {"x": LO.Candidate(("a",))}, FOLDS)
    few = rows.where("not seen or result <> 1")
    assert {k for k, _ in LO.fit_logits(few, {"x": LO.Candidate(("a",)), "y": LO.Candidate(("a",), flag="seen")}, FOLDS)} == {"x"}


def observed(n, contests, seed, seasons=3):
    rng = random.Random(seed)
    out = []
    for i in range(contests):
        h, a = rng.sample(range(n), 2)
        for side, e, o in (("home", h, a), ("away", a, h)):
            rate = np.exp(0.2 + (e % 5 - 2) * 0.2 - (o % 3 - 1) * 0.3 + 0.3 * (side == "home"))
            out.append((i, side, 2001 + i * seasons // contests, f"2001-01-{1 + i % 28:02d}", e, o, float(side == "home"), float(min(9, rng.expovariate(1 / rate) // 1)), rng.gauss(0, 1)))
    return out


@pytest.mark.parametrize(("numeric", "half_life"), [([], None), (["diff"], 10.0)])
def test_goal_effects_are_the_penalised_optimum(spark, numeric, half_life):
    obs = observed(12, 240, 3)
    df = spark.createDataFrame(obs, "contest_id long, side string, season int, d string, e long, opp long, at_home double, gf double, diff double").withColumn("d", F.to_date("d"))
    got = {(r.contest_id, r.side): r.lam for r in G.poisson_goals(df, [2003], stored, numeric, alpha=1e-3, half_life=half_life).collect()}
    past, now = [o for o in obs if o[2] < 2003], [o for o in obs if o[2] == 2003]

    def design(rs):
        m = np.zeros((len(rs), 26 + len(numeric)))
        for i, r in enumerate(rs):
            m[i, 0], m[i, 1 + r[4]], m[i, 13 + r[5]], m[i, 25] = 1, 1, 1, r[6]
            if numeric:
                m[i, 26] = r[8]
        return m

    x, y = design(past), np.array([r[7] for r in past])
    day = np.array([int(r[3][-2:]) for r in past])
    w = np.ones(len(past)) if half_life is None else np.exp(-np.log(2) * (day.max() - day) / half_life)
    pull = 1e-3 * w.sum() * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(60):
        lam = np.exp(x @ b)
        b -= np.linalg.solve(x.T @ (x * (w * lam)[:, None]) + pull, x.T @ (w * (lam - y)) + pull @ b)
    want = np.exp(design(now) @ b)
    assert np.abs(want - np.array([got[r[0], r[1]] for r in now])).max() < 1e-6


def test_goals_of_many_entities_and_of_unknown_ones(spark):
    obs = observed(2500, 9000, 5, 2)  # two effects each: more than a dense solver of 4096 columns takes
    obs += [(10**6, "home", 2002, "2001-01-01", 10**6, 10**6 + 1, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(obs, "contest_id long, side string, season int, d string, e long, opp long, at_home double, gf double, diff double")
    attack, defence, theta = G.fit_goals(G.weighted_cells(df, [2002], ["at_home"]), ["at_home"], stored, 1e-3)
    a, d = ({r.id: r.v for r in x.collect()} for x in (attack, defence))
    mu, home = theta[2002]
    kappa = 1e-3 * sum(o[2] < 2002 for o in obs)
    slack = defaultdict(float)
    for o in obs:
        if o[2] < 2002:
            rest = o[7] - np.exp(mu + home * o[6] + a[o[4]] + d[o[5]])
            slack["a", o[4]] += rest
            slack["d", o[5]] += rest
    assert max(abs(v - kappa * (a if s == "a" else d)[i]) for (s, i), v in slack.items()) < 1e-5
    lam = {r.contest_id: r.lam for r in G.poisson_goals(df, [2002], stored, alpha=1e-3).where("contest_id = 1000000").collect()}
    assert abs(lam[10**6] - np.exp(mu + home)) < 1e-9


def grown(bins, y, prior, s, n_bins):
    """The same boosting row by row: leaves are split best first."""
    z = np.tile(prior, (len(y), 1))
    soft = lambda g: np.sign(g) * max(abs(g) - s.alpha, 0)
    score = lambda g, h: soft(g) ** 2 / (h + s.lam)
    for _ in range(s.trees):
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        for k in range(3):
            g, h = p[:, k] - (y == k), 1.5 * p[:, k] * (1 - p[:, k])

            def split(at, depth):
                best = None
                if depth < s.depth:
                    for f in range(bins.shape[1]):
                        for b in range(n_bins - 1):
                            left, right = at[bins[at, f] <= b], at[bins[at, f] > b]
                            if min(len(left), len(right)) < s.least or min(h[left].sum(), h[right].sum()) < 1e-3:
                                continue
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[at].sum(), h[at].sum())
                            if gain > 1e-10 and (best is None or gain > best[0] * (1 + 1e-10)):
                                best = (gain, left, right)
                return best

            leaves = [(np.arange(len(y)), 0, 0.0, split(np.arange(len(y)), 0))]
            while len(leaves) < s.leaves and any(x[3] for x in leaves):
                i = max((i for i, x in enumerate(leaves) if x[3]), key=lambda i: leaves[i][3][0])
                _, depth, _, (_, *parts) = leaves.pop(i)
                leaves += [(at, depth + 1, -s.rate * soft(g[at].sum()) / (h[at].sum() + s.lam), split(at, depth + 1)) for at in parts]
            for at, _, value, _ in leaves:
                z[at, k] += value
    return np.exp(z) / np.exp(z).sum(1, keepdims=True)


def test_boosting_matches_row_by_row_growth(rows, table):
    x, y, season = table
    settings = {
        "small": B.Boost(("a", "b", "c"), trees=12, rate=0.3, leaves=3, depth=2, least=8, alpha=0.5, lam=2.0), "deep": B.Boost(("c", "a"), trees=4, rate=0.2, leaves=6, depth=4, least=5),
        "stump": B.Boost(("b",), trees=3, rate=0.5, leaves=2, depth=1, least=200),
    }
    fits = B.fit_boosted(rows, settings, {"small": FOLDS, "deep": FOLDS[1:], "stump": FOLDS[:1]}, stored, bins=8)
    assert set(fits) == {("small", 2002), ("small", 2003), ("deep", 2003), ("stump", 2002)}
    for (name, fold), fit in fits.items():
        past = season < fold
        own = x[past][:, ["abc".index(f) for f in settings[name].features]]
        b = B._binned(own, fit["limits"])
        prior = np.log(np.bincount(y[past], minlength=3) / past.sum())
        assert np.abs(B.margins_of(own, fit) - grown(b, y[past], prior, settings[name], 8)).max() < 1e-9
    got = B.predict_boosted(rows, settings, fits).collect()
    assert {(r.candidate, r.season) for r in got} == set(fits)
    assert len(got) == sum((season == f).sum() for _, f in fits)
    r = next(r for r in got if r.candidate == "deep")
    assert np.abs(np.array([r.p_away, r.p_draw, r.p_home]) - B.margins_of(x[[r.contest_id]][:, [2, 0]], fits["deep", 2003])[0]).max() < 1e-12


def test_calibrators_learn_from_earlier_folds_only(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 1, 2], 900)
    y = np.array([rng.choice(3, p=q**0.7 / (q**0.7).sum()) for q in p])
    df = spark.createDataFrame([(i, 2001 + i % 3, int(y[i]), *map(float, p[i])) for i in range(900)], "contest_id long, season int, result int, p_away double, p_draw double, p_home double")
    fits = M.fit_calibrations(df, [2001, *FOLDS])
    assert set(fits) == {(k, f) for k in M.KINDS for f in FOLDS}
    for (kind, fold), theta in fits.items():
        tau, (_, b1, b2) = M.fit_calibration(df.where(f"season < {fold}"), kind, steps=40)
        assert np.abs(np.array(theta) - [tau, b1, b2]).max() < 1e-6
    rows = M.chained(df, [2001, *FOLDS]).collect()
    assert len(rows) == 3 * 600 and all(abs(r.p_away + r.p_draw + r.p_home - 1) < 1e-12 for r in rows)


def test_ratings_of_all_configurations_are_those_row_by_row(spark):
    v = lambda name: view(spark, DATA, name)
    rows = v("contests").withColumn("prior_home", F.lit(1450.0))
    rows = RA.with_ordinals(rows.where("contest_id % 9 <> 0").unionByName(rows.where("contest_id % 9 = 0").withColumn("result", rows["result"] * None)))
    configs = [
        {"config": "a", "k": 10.0}, {"config": "b", "home_adv": 75.0, "early_k": 45.0}, {"config": "c", "pull": 0.3, "offset": True, "use_prior": False},
        {"config": "d", "reset": "both", "home_adv": 20.0}, {"config": "e", "reset": "returning", "pull": 0.1},
    ]
    slow = lambda row, state: RA.elo_update(row, state)
    for final in (False, True):
        got, want = (RA.replay(rows, configs, update=u, events=PM.moves(v), final=final).collect() for u in (RA.elo_update, slow))
        key = lambda r: (r.pool, r.config, r.e if final else r.contest_id)
        told = lambda r: [r.rating] if final else [r.home_rating, r.away_rating]
        assert len(got) == len(want) and {key(r) for r in got} == {key(r) for r in want}
        own = {key(r): told(r) for r in want}
        assert max(abs(a - b) for r in got for a, b in zip(told(r), own[key(r)], strict=True)) < 1e-8


def test_ratings_by_levels_are_those_of_the_replay(spark):
    rng, rows = random.Random(7), []
    for i in range(260):
        h, a = rng.sample(range(60), 2)
        if i % 3 == 0:  # an entity with a third of all contests, several of them on a date
            h, a = 0, a or 1
        rows.append((i, "one" if i % 20 else "two", dt.date(2020, 1, 1 + i * 9 // 260), 2020, h, a, rng.randrange(3) if i % 13 else None))
    df = spark.createDataFrame(rows, "contest_id long, competition string, d date, season int, home long, away long, result int").repartition(3)
    configs = [{"config": "a"}, {"config": "b", "k": 40.0, "home_adv": 60.0}]
    got, want = LV.replay_levels(df, stored, configs).collect(), RA.replay(df, configs).collect()
    own = {(r.pool, r.config, r.contest_id): (r.home_rating, r.away_rating, r.rating_diff) for r in want}
    assert len(got) == len(want) == 520
    assert max(abs(x - y) for r in got for x, y in zip((r.home_rating, r.away_rating, r.rating_diff), own[r.pool, r.config, r.contest_id], strict=True)) < 1e-9
    assert LV.replay_levels(df.limit(0), stored).count() == 0
    with pytest.raises(ValueError, match="home_adv only"):
        LV.replay_levels(df, stored, [{"pull": 0.1}])


def test_reference_candidates_are_complete():
    assert [PR.TUNING[f"c{c:g}"].c for c in (0.1, 0.3, 1.0, 3.0, 10.0)] == [0.1, 0.3, 1.0, 3.0, 10.0] and {"w3", "w5", "w8", "w10"} <= set(PR.TUNING)
    assert len(PR.VARIANTS) == 7 and len(PR.FAMILIES) == 9 and set(PR.ROLLING) == {"rating", "form", "rest", "parity", "staff", "statistics", "lineup"}
    assert sum(n.startswith("set_") for n in PR.BOOSTED) == 5 and len(PR.BOOSTED) == 14
