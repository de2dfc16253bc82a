"""Log-linear goal models with an attack and a defence effect for each entity, whatever their number, on all folds at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.functions.scalar import time_decay

#: Rounds before a fit counts as failed, and the largest change of an effect in the last round.
ROUNDS, TOLERANCE = 80, 1e-8
#: Newton steps for the one effect of an entity.
INNER = 40
#: Bytes of effects that are broadcast.
WIDEST = 64 << 20


def _effect(y: Column, t: Column, k: Column) -> Column:
    """The a with y - exp(a) * t - k * a = 0: the penalised effect of an entity with y goals where exp(a) * t are expected.

    The left side is concave and falls; from a point right of the root Newton's steps approach it from there.
    """
    start = F.when(t.isNotNull(), F.greatest(F.log((y + 1) / t), F.lit(0.0)))  # no rows, no effect
    step = lambda a, _: a + (y - F.exp(a) * t - k * a) / (F.exp(a) * t + k)
    return F.aggregate(F.sequence(F.lit(1), F.lit(INNER)), start, step)


def weighted_cells(observations: DataFrame, folds: Sequence[int], numeric: Sequence[str] = (), half_life: float | None = None) -> DataFrame:
    """(e, opp, numeric.., w<fold>.., y<fold>..): for each fold the weights and weighted goals of the rows of earlier seasons, added up
    where all columns agree; null where a fold has no such row."""
    if half_life is None:
        weight = {f: F.lit(1.0) for f in folds}
    else:
        ends = observations.agg(*[F.max(F.when(F.col("season") < f, F.col("d"))).alias(f"d{f}") for f in folds]).first()
        weight = {f: time_decay(F.datediff(F.lit(ends[f"d{f}"]).cast("date"), "d"), half_life) for f in folds}
    w = {f: F.when(F.col("season") < f, weight[f]) for f in folds}
    return observations.groupBy("e", "opp", *numeric).agg(*[F.sum(w[f]).alias(f"w{f}") for f in folds], *[F.sum(w[f] * F.col("gf")).alias(f"y{f}") for f in folds])


def fit_goals(cells: DataFrame, numeric: Sequence[str], store: Callable[[DataFrame, str], DataFrame], alpha: float = 1e-6) -> tuple[DataFrame, DataFrame, dict]:
    """Attack (fold, id, v), defence (fold, id, v) and coefficients fold -> [intercept, numeric..] of log goals.

    Minimises the weighted mean of the half deviance plus alpha / 2 times the squares of all effects and coefficients but the intercept,
    by blocks: the attack effects given all else, each from one sum over its rows; then the defence effects; then one Newton step of
    intercept and coefficients. Effects are centred, which is where the penalty has them. The cells are written twice, clustered by e and
    by opp, with all folds in a row. A block is one aggregation by entity over the cells that are clustered by it, so that a task adds up
    an entity's rows before they are sent; the effects of the other side are broadcast up to WIDEST bytes, joined by shuffle beyond.
    Effects stay tables, `store` writes them. Only a row per fold reaches the driver. Raises ValueError without convergence.
    """
    spark, names = cells.sparkSession, list(numeric)
    folds = [int(c[1:]) for c in cells.columns if c.startswith("w") and c[1:].isdigit()]
    sides = {"e": "opp", "opp": "e"}
    whole = store(cells.repartition("e"), "cells")
    by = {"e": whole, "opp": store(whole.repartition("opp"), "cells")}
    sums = whole.agg(*[F.sum(f"{x}{f}") for f in folds for x in "wy"]).first()
    folds, sums = [f for i, f in enumerate(folds) if sums[2 * i]], {f: (sums[2 * i], sums[2 * i + 1]) for i, f in enumerate(folds) if sums[2 * i]}
    kappa = {f: alpha * w for f, (w, _) in sums.items()}
    theta = {f: np.array([np.log(max(y, 1e-9) / w)] + [0.0] * len(names)) for f, (w, y) in sums.items()}
    # an entity that a fold hasn't met has no effect there
    start = [F.when(F.count(f"w{f}") > 0, 0.0).alias(f"v{f}") for f in folds]
    goals = {s: store(by[s].groupBy(F.col(s).alias("id")).agg(*start, *[F.sum(f"y{f}").alias(f"y{f}") for f in folds]), "effects") for s in sides}
    effects = {s: goals[s].drop(*[f"y{f}" for f in folds]) for s in sides}
    small = {s: goals[s].count() * (len(folds) + 3) * 8 <= WIDEST for s in sides}

    def base(f: int) -> Column:
        return sum((F.lit(float(theta[f][i + 1])) * F.col(x) for i, x in enumerate(names)), F.lit(float(theta[f][0])))

    def with_effects(df: DataFrame, side: str) -> DataFrame:
        own = effects[side].select(F.col("id").alias(side), *[F.col(f"v{f}").alias(f"_{side}{f}") for f in folds])
        return df.join(F.broadcast(own) if small[side] else own, side)

    for _ in range(ROUNDS):
        moved = 0.0
        for side, other in sides.items():
            at = with_effects(by[side], other)
            got = at.groupBy(F.col(side).alias("id")).agg(*[F.sum(F.col(f"w{f}") * F.exp(base(f) + F.col(f"_{other}{f}"))).alias(f"t{f}") for f in folds])
            old = effects[side].select("id", *[F.col(f"v{f}").alias(f"old{f}") for f in folds])
            got = got.join(goals[side].select("id", *[f"y{f}" for f in folds]), "id").join(old, "id")
            new = store(got.select("id", *[_effect(F.col(f"y{f}"), F.col(f"t{f}"), F.lit(float(kappa[f]))).alias(f"v{f}") for f in folds], *[f"old{f}" for f in folds]), "effects")
            gap = {f: F.col(f"v{f}") - F.col(f"old{f}") for f in folds}
            r = new.agg(*[a for f in folds for a in (F.avg(f"v{f}"), F.max(gap[f]), F.min(gap[f]))]).first()
            means = {f: r[3 * i] for i, f in enumerate(folds)}
            moved = max([moved, *[abs(x - means[f]) for i, f in enumerate(folds) for x in r[3 * i + 1 : 3 * i + 3]]])
            effects[side] = new.select("id", *[(F.col(f"v{f}") - F.lit(float(means[f]))).alias(f"v{f}") for f in folds])
            for f, m in means.items():
                theta[f][0] += m
        at = with_effects(with_effects(whole, "e"), "opp")
        at = at.withColumns({f"_r{f}": F.col(f"w{f}") * F.exp(base(f) + F.col(f"_e{f}") + F.col(f"_opp{f}")) for f in folds})
        x = [F.lit(1.0), *map(F.col, names)]
        n = len(x)
        aggs = [a for f in folds for a in [F.sum((F.col(f"_r{f}") - F.col(f"y{f}")) * c) for c in x] + [F.sum(F.col(f"_r{f}") * x[i] * x[j]) for i in range(n) for j in range(n)]]
        got, width = at.agg(*aggs).first(), n + n * n
        for i, f in enumerate(folds):
            r = got[i * width : (i + 1) * width]
            pull = kappa[f] * np.diag([0.0] + [1.0] * (n - 1))
            g = np.array(r[:n]) + pull @ theta[f]
            step = np.linalg.solve(np.array(r[n:]).reshape(n, n) + pull, g)
            theta[f] = theta[f] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < TOLERANCE:
            told = F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"v{f}").alias("v")) for f in folds]))
            attack, defence = (effects[s].select("id", told).where("v IS NOT NULL").select("fold", "id", "v") for s in sides)
            return attack, defence, theta
    raise ValueError("no convergence")


def poisson_goals(observations: DataFrame, folds: Sequence[int], store: Callable[[DataFrame, str], DataFrame], numeric: Sequence[str] = (), alpha: float = 1e-6, half_life: float | None = None) -> DataFrame:
    """The observations of the seasons in `folds` with lam, the goals expected by a fit on all earlier seasons.

    observations: (season, e, opp, at_home, gf, numeric..), and d for weights with a half-life in days. log lam = intercept + attack of e
    + defence of opp + coefficients of at_home and the numeric columns; an entity that the fit hasn't met has effect 0.
    """
    names = ["at_home", *numeric]
    attack, defence, theta = fit_goals(weighted_cells(observations, folds, names, half_life), names, store, alpha)
    coef = observations.sparkSession.createDataFrame([(f, *map(float, t)) for f, t in theta.items()], ", ".join(["season int", *[f"_t{i} double" for i in range(len(names) + 1)]]))
    out = observations.join(F.broadcast(coef), "season")
    for side, table in (("e", attack), ("opp", defence)):
        out = out.join(table.select(F.col("fold").alias("season"), F.col("id").alias(side), F.col("v").alias(f"_{side}")), ["season", side], "left")
    eta = sum((F.col(f"_t{i + 1}") * F.col(x) for i, x in enumerate(names)), F.col("_t0"))
    return out.withColumn("lam", F.exp(eta + F.coalesce("_e", F.lit(0.0)) + F.coalesce("_opp", F.lit(0.0)))).select(*observations.columns, "lam")
