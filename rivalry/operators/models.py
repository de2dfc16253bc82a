"""Outcome models: folds, baselines, Spark ML fits, score grids, one-parameter likelihoods, calibration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.core.asof import ID, appearances
from rivalry.functions.scalar import clipped_log
from rivalry.operators.logits import Candidate, added, fit_logits, flat_sums, list_logits, predict_logits
from rivalry.operators.scoring import P, metrics_by_fold_pooled, row_scores


def time_split(rows: DataFrame, train_to: int, valid: int, test: int) -> DataFrame:
    """Adds split: train, validation, test or reserved, by season."""
    s = F.col("season")
    return rows.withColumn("split", F.when(s <= train_to, "train").when(s == valid, "validation").when(s == test, "test").otherwise("reserved"))


def expanding_folds(rows: DataFrame, valid_seasons: Sequence[int]) -> DataFrame:
    """A copy of each row for every fold that uses it: role valid in season = fold, train in earlier seasons."""
    folds = F.filter(F.array(*map(F.lit, valid_seasons)), lambda y: F.col("season") <= y)
    return rows.withColumn("fold", F.explode(folds)).withColumn("role", F.when(F.col("season") == F.col("fold"), "valid").otherwise("train"))


def eligibility_flag(rows: DataFrame, available: Sequence[str], values: Sequence[str]) -> DataFrame:
    """eligible: all flags hold and all values are there and finite."""
    ok = F.lit(True)
    for a in available:
        ok = ok & F.coalesce(F.col(a), F.lit(False))
    for v in values:
        x = F.col(v).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.withColumn("eligible", ok)


def baseline_uniform(rows: DataFrame) -> DataFrame:
    return rows.withColumns({p: F.lit(1.0) / 3 for p in P})


def baseline_prior(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Class frequencies of the training rows, one broadcast row."""
    share = train.agg(*[F.avg((F.col("result") == i).cast("double")).alias(p) for i, p in enumerate(P)])
    return rows.crossJoin(F.broadcast(share))


def _vector(rows: DataFrame, features: Sequence[str], out: str = "x") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(rows)


class Logit:
    """One standardised multinomial logistic fit with an L2 penalty of 1 / C; see logits for many at once."""

    def __init__(self, features: Sequence[str], c: float = 1.0):
        self.candidates = {"": Candidate(tuple(features), c)}

    def fit(self, train: DataFrame) -> Logit:
        self.fits = fit_logits(train if "season" in train.columns else train.withColumn("season", F.lit(0)), self.candidates)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return predict_logits(rows, self.candidates, self.fits).select(*rows.columns, *P)


class MultilayerPerceptron:
    """A small perceptron on features scaled by their means and population deviations."""

    def __init__(self, features: Sequence[str], hidden: int = 8, seed: int = 7, steps: int = 50):
        self.features, self.hidden, self.seed, self.steps = list(features), hidden, seed, steps

    def _standardised(self, rows: DataFrame) -> DataFrame:
        z = {f"_z{i}": (F.col(x) - m) / s for i, (x, m, s) in enumerate(self.scale)}
        return _vector(rows.withColumns(z), list(z)).drop(*z)

    def fit(self, train: DataFrame) -> MultilayerPerceptron:
        got = train.agg(*[a for x in self.features for a in (F.avg(x), F.stddev_pop(x))]).first()
        self.scale = [(x, got[2 * i] or 0.0, got[2 * i + 1] or 1.0) for i, x in enumerate(self.features)]
        net = MultilayerPerceptronClassifier(featuresCol="x", layers=[len(self.features), self.hidden, 3], maxIter=self.steps, seed=self.seed)
        self.model = net.fit(self._standardised(train.withColumn("label", F.col("result").cast("double"))))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        return self.model.transform(self._standardised(rows)).withColumns({name: p[i] for i, name in enumerate(P)}).select(*rows.columns, *P)


#: Folds that are fitted side by side.
PARALLEL = 6


def side_by_side(spark: SparkSession, run, folds: Sequence[int]) -> DataFrame:
    """The union of run(fold) over all folds; the fits are independent Spark jobs that wait for each other's tasks only."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        made = [pool.submit(inheritable_thread_target(spark)(run), y) for y in folds]
        return reduce(DataFrame.unionByName, [x.result() for x in made])


def rolling_predict(rows: DataFrame, model: MultilayerPerceptron, folds: Sequence[int]) -> DataFrame:
    """Out-of-fold predictions: for each season the model is fitted on all earlier ones."""
    return side_by_side(rows.sparkSession, lambda y: copy(model).fit(rows.where(F.col("season") < y)).predict(rows.where(F.col("season") == y)), folds)


def family_metrics(rows: DataFrame, candidates: Mapping[str, Candidate], base: str, folds: Sequence[int]) -> DataFrame:
    """For each candidate with a flag (a challenger on the rows that it can judge): a matched comparison with `base` on those rows, and
    the challenger with the baseline's prediction where a row isn't flagged. All are fitted together. A challenger judges the folds
    before which all three results were met among its rows."""
    fits = fit_logits(rows, candidates, folds)
    got = list_logits(rows.where(F.col("season").isin(*folds)), candidates, fits)
    by = lambda n: F.get(F.filter("_p", lambda x: x["candidate"] == n), F.lit(0))
    # a contest's list has all that is compared, so that predictions needn't meet by joins
    said = [(F.lit(True), "", "baseline_all", F.col("_base"))]
    for n, c in candidates.items():
        if n != base:
            own = F.col(f"_of_{n}")
            on = F.coalesce(F.col(c.flag), F.lit(False))
            said += [(F.lit(True), n, "operational", F.coalesce(own, F.col("_base"))), (own.isNotNull(), n, "challenger_matched", own), (on, n, "baseline_matched", F.col("_base"))]
    got = got.select("season", "result", *[c.flag for n, c in candidates.items() if n != base], by(base).alias("_base"), *[by(n).alias(f"_of_{n}") for n in candidates if n != base])
    each = [F.when(keep, F.struct(F.lit(n).alias("family"), F.lit(population).alias("population"), *[p[x].alias(x) for x in P])) for keep, n, population, p in said]
    out = got.where("_base IS NOT NULL").select("season", "result", F.inline(F.array_compact(F.array(*each))))
    return metrics_by_fold_pooled(row_scores(out), by=["family", "population"])


def score_grid_probs(home_lambda: Column, away_lambda: Column, most: int = 15, rho: Column | float = 0.0) -> Column:
    """array(away, draw, home) from independent Poisson goals 0..most, renormalised; rho corrects the four low scores.

    One pass over the goals with running sums; the two distributions are computed once and bound by a lambda.
    """
    def pmf(lam):
        return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(-lam + k * F.log(lam)) / F.factorial(k))

    rho = F.lit(float(rho)) if isinstance(rho, (int, float)) else rho
    names = ("home", "away", "draw", "under_h", "under_a")

    def step(s: Column, x: Column) -> Column:
        new = (s["home"] + x["h"] * s["under_a"], s["away"] + x["a"] * s["under_h"], s["draw"] + x["h"] * x["a"], s["under_h"] + x["h"], s["under_a"] + x["a"])
        return F.struct(*[v.alias(n) for v, n in zip(new, names, strict=True)])

    def probs(goals: Column) -> Column:
        sums = F.aggregate(goals, F.struct(*[F.lit(0.0).alias(n) for n in names]), step)
        at = lambda i, j: F.element_at(goals, i + 1)["h"] * F.element_at(goals, j + 1)["a"]
        fix = {(i, j): at(i, j) * (dixon_coles_tau(F.lit(i), F.lit(j), home_lambda, away_lambda, rho) - 1) for i in (0, 1) for j in (0, 1)}
        return F.struct((sums["home"] + fix[1, 0]).alias("h"), (sums["away"] + fix[0, 1]).alias("a"), (sums["draw"] + fix[0, 0] + fix[1, 1]).alias("d"))

    goals = F.zip_with(pmf(home_lambda), pmf(away_lambda), lambda h, a: F.struct(h.alias("h"), a.alias("a")))
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return bind(bind(goals, probs), lambda p: F.array(p["a"] / (p["h"] + p["a"] + p["d"]), p["d"] / (p["h"] + p["a"] + p["d"]), p["h"] / (p["h"] + p["a"] + p["d"])))


def dixon_coles_tau(h: Column, a: Column, home_lambda: Column, away_lambda: Column, rho: Column) -> Column:
    """The factor of a low score; 1 for all others."""
    return (
        F.when((h == 0) & (a == 0), 1 - home_lambda * away_lambda * rho).when((h == 0) & (a == 1), 1 + home_lambda * rho)
        .when((h == 1) & (a == 0), 1 + away_lambda * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(F.lit(1.0))
    )


def davidson_probs(home_rating: Column, away_rating: Column, nu: Column, advantage: float = 0.0) -> Column:
    """array(away, draw, home) of the draw model on ratings."""
    h = F.pow(F.lit(10.0), (home_rating + F.lit(float(advantage))) / 400)
    a = F.pow(F.lit(10.0), away_rating / 400)
    d = nu * F.sqrt(h * a)
    t = h + a + d
    return F.array(a / t, d / t, h / t)


def minimise(nll, rows: DataFrame, low: float, high: float, points: int = 9, passes: int = 13) -> float:
    """A bounded one-parameter minimum: each pass evaluates `points` values in one aggregation and narrows the interval."""
    rows = rows.persist()
    for _ in range(passes):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        got = rows.agg(*[F.sum(nll(F.lit(x))).alias(f"v{i}") for i, x in enumerate(grid)]).first()
        best = min(range(points), key=lambda i: float("inf") if got[i] is None or got[i] != got[i] else got[i])
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    rows.unpersist()
    return (low + high) / 2


def dixon_coles_rho(rows: DataFrame, bound: float = 0.2) -> float:
    """rows (home_lambda, away_lambda, home_score, away_score)."""
    tau = lambda rho: dixon_coles_tau(F.col("home_score"), F.col("away_score"), F.col("home_lambda"), F.col("away_lambda"), rho)
    return minimise(lambda rho: -F.log(F.greatest(tau(rho), F.lit(1e-12))), rows, -bound, bound)


def davidson_nu(rows: DataFrame, bound: float = 5.0) -> float:
    """rows (home_rating, away_rating, result)."""
    p = lambda nu: F.element_at(davidson_probs(F.col("home_rating"), F.col("away_rating"), nu), F.col("result") + 1)
    return minimise(lambda nu: -clipped_log(p(nu)), rows, 0.01, bound)


def calibrate(probs: Sequence[str], tau, biases: Sequence = (0.0, 0.0, 0.0)) -> Column:
    """q ~ p ** tau * exp(bias), computed from logs less their maximum."""
    z = [F.lit(tau) * clipped_log(p) + (b if isinstance(b, Column) else F.lit(b)) for p, b in zip(probs, biases, strict=True)]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = e[0] + e[1] + e[2]
    return F.array(*[x / total for x in e])


def fit_calibration(rows: DataFrame, kind: str = "C1", steps: int = 12, probs: Sequence[str] = P) -> tuple[float, tuple[float, float, float]]:
    """Newton steps for C1 (temperature), C2 (biases of draw and home) or C3 (both); one aggregation for each step."""
    names = {"C1": ["tau"], "C2": ["b1", "b2"], "C3": ["tau", "b1", "b2"]}[kind]
    x = dict.fromkeys(["tau", "b1", "b2"], 0.0) | {"tau": 1.0}
    logs = [clipped_log(p) for p in probs]
    feats = {"tau": logs, "b1": [F.lit(0.0), F.lit(1.0), F.lit(0.0)], "b2": [F.lit(0.0), F.lit(0.0), F.lit(1.0)]}
    rows = rows.select("result", *probs).persist()
    for _ in range(steps):
        q = calibrate(probs, x["tau"], (0.0, x["b1"], x["b2"]))
        mean = {n: q[0] * feats[n][0] + q[1] * feats[n][1] + q[2] * feats[n][2] for n in names}
        true = {n: F.element_at(F.array(*feats[n]), F.col("result") + 1) for n in names}
        grads = [F.sum(mean[n] - true[n]).alias(f"g{i}") for i, n in enumerate(names)]
        hess = [F.sum(sum((q[k] * feats[a][k] * feats[b][k] for k in range(3)), F.lit(0.0)) - mean[a] * mean[b]) for a in names for b in names]
        got = list(rows.agg(*grads, *[h.alias(f"h{i}") for i, h in enumerate(hess)]).first())
        k = len(names)
        step = np.linalg.solve(np.array(got[k:]).reshape(k, k) + 1e-9 * np.eye(k), np.array(got[:k]))
        for n, s in zip(names, step, strict=True):
            x[n] -= float(s)
        x["tau"] = max(0.0, x["tau"])
        if max(abs(step)) < 1e-10:
            break
    rows.unpersist()
    return x["tau"], (0.0, x["b1"], x["b2"])


#: Parameters of each kind of calibration, which start at tau = 1 and biases of 0.
KINDS = {"C1": ("tau",), "C2": ("b1", "b2"), "C3": ("tau", "b1", "b2")}


def _calibration_sums(models: Sequence[tuple], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By model: loss, gradient and Hessian, added up over the rows (season, result, logs) of a task that are before the model's fold.

    models: (number, kind, fold, parameters).
    """
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        season, result = (batch.column(i).to_numpy() for i in range(2))
        logs = batch.column(2).flatten().to_numpy().reshape(-1, len(P))
        for i, kind, fold, (tau, *bias) in models:
            use = season < fold
            if not use.any():
                continue
            own, y = logs[use].T, result[use]
            z = tau * own
            z[1:] += np.array(bias)[:, None]
            top, which = z.max(axis=0), np.arange(len(y))
            q = np.exp(z - top)
            size = q.sum(axis=0)
            q /= size
            # a parameter's move of the three logs, its mean and what the result has of it
            move = {"tau": own, "b1": np.array([[0.0], [1.0], [0.0]]), "b2": np.array([[0.0], [0.0], [1.0]])}
            mean = {n: (q * move[n]).sum(axis=0) for n in KINDS[kind]}
            true = {"tau": own[y, which], "b1": y == 1, "b2": y == 2}
            flat = [(np.log(size) + top - z[y, which]).sum(), *[(mean[n] - true[n]).sum() for n in KINDS[kind]]]
            flat += [((q * move[a] * move[b]).sum(axis=0) - mean[a] * mean[b]).sum() for a in KINDS[kind] for b in KINDS[kind]]
            total[i] = total[i] + np.array(flat) if i in total else np.array(flat)
    yield from flat_sums(total)


def fit_calibrations(rows: DataFrame, folds: Sequence[int], kinds: Sequence[str] = tuple(KINDS), steps: int = 40, tolerance: float = 1e-10) -> dict[tuple[str, int], tuple[float, float, float]]:
    """(kind, fold) -> (tau, bias of draw, bias of home), learned from the rows (season, result, probabilities) of earlier seasons.

    A Newton step of all kinds and folds is one pass over the rows, which are best stored. Folds without earlier rows have no entry. Plain steps, as the SQL has them, run
    away where the probabilities hardly differ between rows and the best tau is large; such a fit starts again with steps that are halved
    until they lower the loss, which is convex, and ends where no step can. A tau that would fall below 0 stays there.
    """
    rows = rows.select(F.col("season").cast("int"), F.col("result").cast("int"), F.array(*map(clipped_log, P)).alias("logs"))
    first = rows.agg(F.min("season")).first()[0]
    start = np.array([1.0, 0.0, 0.0])
    theta = {(k, f): start for f in folds if first is not None and f > first for k in kinds}
    keys, at = list(theta), {"tau": 0, "b1": 1, "b2": 2}
    done: set[tuple] = set()
    safe: dict[tuple, tuple] = {}  # fits with halved steps: the loss that was met last, where, and the move from there
    for turn in range(4 * steps):
        if len(done) == len(theta):
            break
        open_ = [(i, *key, theta[key]) for i, key in enumerate(keys) if key not in done]
        for i, flat in added(rows.mapInArrow(partial(_calibration_sums, open_), "model int, flat array<double>"), len(open_)).items():
            key, n = keys[i], len(KINDS[keys[i][0]])
            loss, g, h = flat[0], flat[1 : 1 + n], flat[1 + n :].reshape(n, n)
            old, mine = theta[key], [at[x] for x in KINDS[key[0]]]
            if key in safe:
                best, before, move = safe[key]
                if not loss <= best + 1e-13 * abs(best):
                    if np.abs(move).max() < tolerance:
                        theta[key] = before
                        done.add(key)
                        continue
                    safe[key] = (best, before, move / 2)
                    theta[key] = before + move / 2
                    continue
                free = [j for j, x in enumerate(mine) if x or old[0] > 0 or g[j] < 0]
                move = np.zeros(3)
                if free:
                    move[[mine[j] for j in free]] = -np.linalg.lstsq(h[np.ix_(free, free)], g[free])[0]
                move[0] = max(move[0], -old[0])
                if np.abs(move).max() < tolerance * max(1.0, np.abs(old).max()) or -move[mine] @ g <= 1e-15 * abs(loss):
                    done.add(key)
                safe[key] = (loss, old, move)
                theta[key] = old + move
                continue
            try:
                new = old.copy()
                new[mine] -= np.linalg.solve(h + 1e-12 * np.eye(n), g)
                new[0] = max(0.0, new[0])
            except np.linalg.LinAlgError:
                new = np.full(3, np.inf)
            if turn >= steps or not np.abs(new).max() < 1e6:
                safe[key], theta[key] = (np.inf, start, np.zeros(3)), start
                continue
            theta[key] = new
            if np.abs(new - old).max() < tolerance:
                done.add(key)
    if len(done) < len(theta):
        raise ValueError("no convergence")
    return {k: tuple(map(float, x)) for k, x in theta.items()}


def chained(predictions: DataFrame, folds: Sequence[int], kinds: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """predictions (season, result, probabilities ..), out of fold, with calibrated copies: kind and probabilities by a calibrator that has
    learned from the out-of-fold rows of earlier folds. Seasons without earlier folds have no calibrated rows."""
    fits = fit_calibrations(predictions, folds, kinds)
    table = [(k, f, *x) for (k, f), x in fits.items()]
    known = F.broadcast(predictions.sparkSession.createDataFrame(table, "kind string, _fold int, _t double, _b1 double, _b2 double"))
    both = predictions.join(known, F.col("season") == F.col("_fold"))
    q = calibrate(P, F.col("_t"), (F.lit(0.0), F.col("_b1"), F.col("_b2")))
    return both.withColumn("_q", q).select(*[c for c in predictions.columns if c not in P], "kind", *[F.col("_q")[i].alias(p) for i, p in enumerate(P)])


def held_out_metrics(rows: DataFrame, holdout: int, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Metrics of each candidate by season, and pooled (season null) over the development seasons and over the held-out one apart."""
    part = F.when(F.col("season") >= holdout, "holdout").otherwise("development")
    return metrics_by_fold_pooled(row_scores(rows.withColumn("part", part)), by=[*by, "part"])


def goal_observations(contests: DataFrame) -> DataFrame:
    """Two rows per contest: e scores gf against opp, at_home 1 or 0."""
    return appearances(contests).withColumn("at_home", (F.col("side") == "home").cast("double")).withColumn("gf", F.col("gf").cast("double"))


def goal_state_features(form: DataFrame, ratings: DataFrame) -> DataFrame:
    """Nine columns: the rating difference, and points, goals for and against of both sides' last contests, with sums."""
    j = form.join(ratings.select(ID, "rating_diff"), ID)
    return j.select(
        ID, "rating_diff", "home_points", "away_points", "home_gf_sum", "away_gf_sum", "home_ga_sum", "away_ga_sum",
        (F.col("home_points") - F.col("away_points")).alias("points_diff"),
        (F.col("home_gf_sum") - F.col("home_ga_sum") - F.col("away_gf_sum") + F.col("away_ga_sum")).alias("goal_diff"),
    )
