"""Multinomial logistic fits of many candidates on many folds in one sequence of Newton steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.operators.scoring import P

#: Newton steps before a fit counts as failed, and the largest step of a fit that has converged.
STEPS, TOLERANCE = 40, 1e-9


class Candidate(NamedTuple):
    """Features, the inverse penalty, and the flag of the rows that the candidate learns from and predicts."""

    features: tuple[str, ...]
    c: float = 1.0
    flag: str | None = None


class Fit(NamedTuple):
    """Coefficients of raw features for draw and home against away, and the intercepts."""

    features: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray


def _double(x: str) -> Column:
    return F.col(x).cast("double")


def _on(flag: str | None) -> Column:
    return F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag else F.lit(True)


def _scales(rows: DataFrame, candidates: Mapping[str, Candidate], folds: Sequence) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Means and population deviations of each candidate's training rows for each fold: moments by season, merged here."""
    asked = sorted({(c.flag or "", x) for c in candidates.values() for x in c.features})
    flags = sorted({f for f, _ in asked} | {c.flag or "" for c in candidates.values()})
    aggs = [F.count(F.when(_on(f), 1)).alias(f"n{i}") for i, f in enumerate(flags)]
    aggs += [F.count(F.when(_on(f) & (F.col("result") == k), 1)).alias(f"k{i}_{k}") for i, f in enumerate(flags) for k in range(len(P))]
    for i, (f, x) in enumerate(asked):
        v = F.when(_on(f), _double(x))
        aggs += [F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.count(v).alias(f"c{i}")]
    seasons = rows.groupBy("season").agg(*aggs).collect()  # a row per season
    out = {}
    for name, c in candidates.items():
        flag = c.flag or ""
        fi = flags.index(flag)
        for y in folds:
            past = [s for s in seasons if y is None or s.season < y]
            n = np.array([s[f"n{fi}"] for s in past], float)
            if not all(sum(s[f"k{fi}_{k}"] for s in past) for k in range(len(P))):
                if c.flag:
                    continue
                raise ValueError(f"{name}: a result is missing before {y}")
            mean, sd = np.zeros(len(c.features)), np.ones(len(c.features))
            for j, x in enumerate(c.features):
                i = asked.index((flag, x))
                if any(s[f"c{i}"] != s[f"n{fi}"] for s in past):
                    raise ValueError(f"{name}: {x} is null in a training row")
                m = np.array([s[f"m{i}"] or 0.0 for s in past])
                v = np.array([s[f"v{i}"] or 0.0 for s in past])
                mean[j] = (n * m).sum() / n.sum()
                sd[j] = np.sqrt((n * (v + (m - mean[j]) ** 2)).sum() / n.sum()) or 1.0
            out[name, y] = (mean, sd)
    return out


def _pieces(flat: np.ndarray, q: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian from a task's or all tasks' flat sums."""
    upper = q * (q + 1) // 2
    blocks = []
    for i in range(3):
        h = np.zeros((q, q))
        h[np.triu_indices(q)] = flat[1 + 2 * q + i * upper : 1 + 2 * q + (i + 1) * upper]
        blocks.append(h + np.triu(h, 1).T)
    return flat[0], flat[1 : 1 + 2 * q], np.block([[blocks[0], blocks[1]], [blocks[1], blocks[2]]])


def _sums(rows: DataFrame, names: Sequence[str], flags: Sequence[str], models: Sequence[tuple]) -> dict[int, np.ndarray]:
    """By model: loss, gradient and upper triangles of the Hessian, added up over all rows.

    models: (key, fold, columns, flag or -1, means, deviations, coefficients). A task sends one array per model; the arrays of a model
    meet in one task of the second stage, which adds them as they come.
    """

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            season, y = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)), np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(int)
            x = batch.column(2).values.to_numpy(zero_copy_only=False).reshape(len(y), len(names))
            on = batch.column(3).values.to_numpy(zero_copy_only=False).reshape(len(y), len(flags)) if flags else None
            for key, fold, cols, flag, mean, sd, beta in models:
                use = np.ones(len(y), bool) if fold is None else season < fold
                if flag >= 0:
                    use = use & on[:, flag]
                if not use.any():
                    continue
                z = np.column_stack(((x[np.ix_(use, cols)] - mean) / sd, np.ones(use.sum())))
                own, q = y[use], z.shape[1]
                eta = np.column_stack((np.zeros(len(own)), z @ beta.reshape(2, q).T))
                eta -= eta.max(axis=1, keepdims=True)
                e = np.exp(eta)
                p = e / e.sum(axis=1, keepdims=True)
                loss = -np.log(np.maximum(p[np.arange(len(own)), own], 1e-300)).sum()
                g = ((p - np.eye(3)[own])[:, 1:].T @ z).ravel()
                tri = np.triu_indices(q)
                h = [(z.T @ (w[:, None] * z))[tri] for w in (p[:, 1] * (1 - p[:, 1]), -p[:, 1] * p[:, 2], p[:, 2] * (1 - p[:, 2]))]
                flat = np.concatenate(([loss], g, *h))
                total[key] = total[key] + flat if key in total else flat
        yield from flat_sums(total)

    sent = rows.select("season", "result", F.array(*[F.coalesce(_double(x), F.lit(0.0)) for x in names]).alias("x"), F.array(*map(_on, flags)).alias("on") if flags else F.lit(None).alias("on"))
    return added(sent.mapInArrow(part, "model int, flat array<double>"), len(models))


def added(sent: DataFrame, n: int) -> dict[int, np.ndarray]:
    """The sum of each model's arrays of rows (model, flat), of which tasks send one for each of the n models."""

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[key] = total[key] + np.asarray(flat) if key in total else np.asarray(flat)
        yield from flat_sums(total)

    sent = sent.repartition(min(n, 64), "model").mapInArrow(merge, "model int, flat array<double>")
    return {r.model: np.asarray(r.flat) for r in sent.collect()}  # one array per model


def flat_sums(total: dict[int, np.ndarray]):
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))], ["model", "flat"])


def fit_logits(rows: DataFrame, candidates: Mapping[str, Candidate], folds: Sequence = (None,)) -> dict[tuple, Fit]:
    """(candidate, fold) -> Fit. A fold y learns from the rows of earlier seasons, the fold None from all.

    Each fit is a standardised multinomial logistic regression with an L2 penalty of 1 / C on the coefficients of all three results and
    none on intercepts. A Newton step of all fits is one pass over the rows, which are best stored; a step that makes a fit's objective
    worse is halved. A candidate with a flag has no fit for the folds before which its rows haven't met all results. A fit without
    convergence, a result that isn't met otherwise and a null feature of a row that is learned from raise ValueError.
    """
    names = sorted({x for c in candidates.values() for x in c.features})
    flags = sorted({c.flag for c in candidates.values() if c.flag})
    scales = _scales(rows, candidates, folds)
    keys = list(scales)
    beta = {k: np.zeros(2 * (len(candidates[k[0]].features) + 1)) for k in keys}
    move, best = {k: np.zeros_like(b) for k, b in beta.items()}, dict.fromkeys(keys, np.inf)
    open_ = list(keys)
    for _ in range(STEPS):
        models = []
        for k in open_:
            c = candidates[k[0]]
            models.append((keys.index(k), k[1], [names.index(x) for x in c.features], flags.index(c.flag) if c.flag else -1, *scales[k], beta[k]))
        got = _sums(rows, names, flags, models)
        left = []
        for k in open_:
            q = len(beta[k]) // 2
            loss, g, h = _pieces(got[keys.index(k)], q)
            pull = np.kron(np.array([[2.0, -1.0], [-1.0, 2.0]]) / 3, np.diag([1.0] * (q - 1) + [0.0])) / candidates[k[0]].c
            loss, g, h = loss + beta[k] @ pull @ beta[k] / 2, g + pull @ beta[k], h + pull
            if loss > best[k] + 1e-9 * abs(best[k]):
                move[k] = move[k] / 2
                beta[k] = beta[k] + move[k]
                left.append(k)
                continue
            best[k] = loss
            move[k] = np.linalg.solve(h, g)
            beta[k] = beta[k] - move[k]
            if np.abs(move[k]).max() > TOLERANCE:
                left.append(k)
        open_ = left
        if not open_:
            break
    if open_:
        raise ValueError(f"no convergence: {open_}")
    out = {}
    for k in keys:
        mean, sd = scales[k]
        b = beta[k].reshape(2, -1)
        w = b[:, :-1] / sd
        out[k] = Fit(tuple(candidates[k[0]].features), w, b[:, -1] - w @ mean)
    return out


def list_logits(rows: DataFrame, candidates: Mapping[str, Candidate], fits: Mapping[tuple, Fit], name: str = "_p") -> DataFrame:
    """rows with a list of (candidate, probabilities): one for each candidate whose flag they have, by the fit of their season (or of all).

    All fits of a row's season are applied to a batch of rows at once.
    """
    names = sorted({x for c in candidates.values() for x in c.features})
    flags = sorted({c.flag for c in candidates.values() if c.flag})
    labels = list(candidates)
    pooled = all(fold is None for _, fold in fits)
    by: dict = {}
    for (candidate, fold), f in fits.items():
        flag = candidates[candidate].flag
        by.setdefault(fold, []).append((labels.index(candidate), flags.index(flag) if flag else -1, [names.index(x) for x in f.features], np.asarray(f.weights), np.asarray(f.intercepts)))

    def scored(season: pa.Array, x: pa.Array, on: pa.Array) -> pa.Array:
        n = len(season)
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(n, len(names))
        on = on.flatten().to_numpy(zero_copy_only=False).reshape(n, len(flags)) if flags else None
        season = season.to_numpy(zero_copy_only=False)
        places, codes, probs = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, len(P)))]
        for fold, models in by.items():
            at = np.arange(n) if pooled else np.flatnonzero(season == fold)
            for code, flag, cols, w, b in models:
                own = at[on[at, flag].astype(bool)] if flag >= 0 else at
                z = np.column_stack((np.zeros(len(own)), x[np.ix_(own, cols)] @ w.T + b))
                e = np.exp(z - z.max(axis=1, keepdims=True))
                places.append(own)
                codes.append(np.full(len(own), code))
                probs.append(e / e.sum(axis=1, keepdims=True))
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=n))))
        p, label = np.concatenate(probs)[order], pa.array(labels, pa.string()).take(pa.array(np.concatenate(codes)[order]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([label, *[pa.array(p[:, i]) for i in range(len(P))]], ["candidate", *P]))

    score = F.arrow_udf(scored, f"array<struct<candidate: string, {', '.join(f'{p}: double' for p in P)}>>")
    x = F.array(*[F.coalesce(_double(x), F.lit(0.0)) for x in names])
    season = F.lit(None).cast("double") if pooled else F.col("season").cast("double")
    return rows.withColumn(name, score(season, x, F.array(*map(_on, flags)) if flags else F.lit(False)))


def predict_logits(rows: DataFrame, candidates: Mapping[str, Candidate], fits: Mapping[tuple, Fit]) -> DataFrame:
    """rows once for each candidate whose flag they have, with candidate and the probabilities; see list_logits."""
    return list_logits(rows, candidates, fits).select(*rows.columns, F.inline("_p"))


def rolling_logits(rows: DataFrame, candidates: Mapping[str, Candidate], folds: Sequence[int]) -> DataFrame:
    """Out-of-fold predictions of all candidates: each season by a fit on all earlier ones."""
    return predict_logits(rows.where(F.col("season").isin(*folds)), candidates, fit_logits(rows, candidates, folds))
