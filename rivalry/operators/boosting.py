"""Gradient boosting of trees with a softmax loss: many settings and folds in the same passes over the rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators.scoring import P

#: Bins of a feature, and rounds after which the margins of all rows are written.
BINS, REFRESH = 32, 10
#: Rows of a file of the binned table, where it has more files than twice the cores.
FILE_ROWS = 200_000
#: Rows up to which a model is fitted within one task, some 120 bytes each; cells of features that are counted together there, and rows of a count.
TASK_ROWS, CELLS, PIECE = 2_000_000, 4096, 32_768
CLASSES = len(P)
#: The least sum of second derivatives in a leaf, and the factor that multiclass boosting has in them.
LEAST_HESSIAN, FACTOR = 1e-3, CLASSES / (CLASSES - 1)


class Boost(NamedTuple):
    """A setting. `leaves` are grown best first, `depth` levels at most; `least` rows in a leaf; alpha and lam are L1 and L2 penalties."""

    features: tuple[str, ...]
    trees: int = 100
    rate: float = 0.05
    leaves: int = 5
    depth: int = 3
    least: int = 20
    alpha: float = 0.0
    lam: float = 0.0


class Tree:
    """A binary tree in heap order: the children of node i are 2 i + 1 and 2 i + 2. A node without a feature (-1) is a leaf."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.bin, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)

    def leaf(self, columns: np.ndarray) -> np.ndarray:
        """The node that each row ends in; columns: for each feature the bin numbers of all rows.

        Node by node, parents first, over whole columns: a few passes over bytes for each split, no row is looked up by itself.
        """
        kind = np.uint8 if len(self.feature) <= 256 else np.int64
        at = np.zeros(columns.shape[1], kind)
        for i in np.flatnonzero(self.feature >= 0):
            step = (columns[self.feature[i]] > self.bin[i]).astype(kind)
            step += kind(i + 1)
            if i:
                step *= at == i
            at += step
        return at


def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(hist: np.ndarray, s: Boost) -> list[tuple | None]:
    """For each node of hist (node, feature, bin, (gradient, hessian, rows)): (gain, feature, bin, value left, value right), or None.

    Gains are compared to ten digits, so that the order of sums doesn't decide between equal splits; ties go to the first feature and bin.
    """
    out: list[tuple | None] = []
    score = lambda x: soft(x[..., 0], s.alpha) ** 2 / np.maximum(x[..., 1] + s.lam, 1e-300)
    for node in hist:
        left = np.cumsum(node, axis=1)[:, :-1]
        total = node[0].sum(axis=0)
        right = total - left
        gain = score(left) + score(right) - score(total)
        ok = (left[..., 2] >= s.least) & (right[..., 2] >= s.least) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
        gain = np.where(ok, gain, -np.inf)
        top = gain.max() if gain.size else -np.inf
        if not top > 1e-10:
            out.append(None)
            continue
        f, b = np.unravel_index(int(np.argmax(gain >= top - abs(top) * 1e-10)), gain.shape)
        values = [float(-soft(x[f, b, 0], s.alpha) / (x[f, b, 1] + s.lam)) for x in (left, right)]
        out.append((float(top), int(f), int(b), *values))
    return out


def pruned(grown: Tree, gains: np.ndarray, leaves: int) -> Tree:
    """The leaves of the best splits first: the subtree of `grown` that splits the leaf with the highest gain until there are `leaves`."""
    out = Tree(0)
    out.feature, out.bin, out.value = np.full_like(grown.feature, -1), grown.bin, grown.value
    frontier = [0]
    while len(frontier) < leaves:
        open_ = [i for i in frontier if grown.feature[i] >= 0]
        if not open_:
            break
        i = max(open_, key=lambda j: (gains[j], -j))
        out.feature[i] = grown.feature[i]
        frontier.remove(i)
        frontier += [2 * i + 1, 2 * i + 2]
    return out


def bin_limits(rows: DataFrame, features: Sequence[str], folds: Sequence[int], bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Fold -> for each feature the ascending upper limits of all bins but the last, quantiles of the rows of earlier seasons."""
    fold = F.explode(F.filter(F.array(*map(F.lit, folds)), lambda y: F.col("season") < y))
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    aggs = [F.percentile_approx(F.col(x).cast("double"), at, 10_000).alias(f"q{i}") for i, x in enumerate(features)]
    got = rows.withColumn("_fold", fold).groupBy("_fold").agg(*aggs).collect()  # a row per fold
    return {r["_fold"]: [np.unique(np.array(r[f"q{i}"], float)) for i in range(len(features))] for r in got}


def _binned(x: np.ndarray, limits: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(t, x[:, i], "left") for i, t in enumerate(limits)], axis=1).astype(np.uint8)


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, value after value."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]).copy()


def _softmax(z: np.ndarray, axis: int = 1) -> np.ndarray:
    e = np.exp(z - z.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


class _Codes:
    """Bins of one model's rows: features whose joint bins are CELLS at most share a column, so that one count serves all of them."""

    def __init__(self, limits: Sequence[np.ndarray], bins: int):
        self.bins, self.limits, self.sizes = bins, limits, [len(t) + 1 for t in limits]
        self.groups: list[list[int]] = []
        for f in sorted(range(len(limits)), key=lambda i: -self.sizes[i]):
            room = (x for x in self.groups if np.prod([self.sizes[i] for i in [*x, f]]) <= CELLS)
            first = next(room, None)
            if first is None:
                self.groups.append([f])
            else:
                first.append(f)
        self.shapes = [[self.sizes[i] for i in x] for x in self.groups]
        self.place = {f: (j, x.index(f)) for j, x in enumerate(self.groups) for f in x}

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """A column of codes for each group."""
        b = _binned(x, self.limits)
        return [np.ravel_multi_index([b[:, i] for i in own], shape).astype(np.uint16) for own, shape in zip(self.groups, self.shapes, strict=True)]

    def above(self, columns: Sequence[np.ndarray], at, f: int, limit: int) -> np.ndarray:
        """Which of the rows at `at` have a bin of feature f above limit."""
        j, axis = self.place[f]
        shape = self.shapes[j]
        cell = np.broadcast_to((np.arange(shape[axis]) > limit).reshape([-1 if i == axis else 1 for i in range(len(shape))]), shape).ravel()
        return cell.take(columns[j] if at is None else columns[j].take(at))

    def histograms(self, columns: Sequence[np.ndarray], at, g: np.ndarray, h: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """(feature, bin, (gradient, hessian, rows)) of the rows at `at`, None for all; in pieces that stay in a core's cache.

        counts: the rows by feature and bin, where they are known.
        """
        n, joint = len(g) if at is None else len(at), [np.zeros((3, int(np.prod(shape)))) for shape in self.shapes]
        for first in range(0, n, PIECE):
            part = slice(first, first + PIECE)
            own = None if at is None else at[part]
            gs, hs = (x[part] if at is None else x.take(own) for x in (g, h))
            for column, total in zip(columns, joint, strict=True):
                cell = (column[part] if at is None else column.take(own)).astype(np.intp)
                for i, w in enumerate((gs, hs) if counts is not None else (gs, hs, None)):
                    total[i] += np.bincount(cell, w, total.shape[1])
        out = np.zeros((len(self.limits), self.bins, 3))
        for total, own, shape in zip(joint, self.groups, self.shapes, strict=True):
            total = total.reshape(3, *shape)
            for axis, f in enumerate(own):
                out[f, : shape[axis]] = total.sum(axis=tuple(j + 1 for j in range(len(shape)) if j != axis)).T
        if counts is not None:
            out[..., 2] = counts
        return out


def _grown(codes: _Codes, columns: Sequence[np.ndarray], g: np.ndarray, h: np.ndarray, s: Boost, counts: np.ndarray) -> tuple[Tree, dict]:
    """The pruned tree of all rows, and which rows (None for all) each of its leaves has.

    Of two children the smaller one is counted, the other has what is left of their parent's histogram.
    """
    t = Tree(s.depth)
    gains, hist, has = np.full(len(t.feature), -np.inf), {0: codes.histograms(columns, None, g, h, counts)}, {0: None}

    def part(i: int) -> None:
        """The rows of both children of node i."""
        right, at = codes.above(columns, has[i], t.feature[i], t.bin[i]), has[i]
        has[2 * i + 1], has[2 * i + 2] = (np.flatnonzero(y) if at is None else at[y] for y in (~right, right))

    for depth in range(s.depth):
        nodes = sorted(hist)
        found, parents, hist = best_splits(np.stack([hist[i] for i in nodes]), s), hist, {}
        for i, x in zip(nodes, found, strict=True):
            if not x:
                continue
            gains[i], t.feature[i], t.bin[i] = x[:3]
            t.value[2 * i + 1], t.value[2 * i + 2] = s.rate * x[3], s.rate * x[4]
            if depth + 1 < s.depth:
                part(i)
                small = int(len(has[2 * i + 2]) < len(has[2 * i + 1]))
                one = codes.histograms(columns, has[2 * i + 1 + small], g, h)
                hist[2 * i + 1 + small], hist[2 * i + 2 - small] = one, parents[i] - one
        if not hist:
            break
    out = pruned(t, gains, s.leaves)
    leaves, todo = {}, [0]
    while todo:
        i = todo.pop()
        if out.feature[i] < 0:
            leaves[i] = has[i]
        else:
            if 2 * i + 1 not in has:  # below the last level rows are parted where the split is kept
                part(i)
            todo += [2 * i + 1, 2 * i + 2]
    return out, leaves


def _fit_rows(codes: _Codes, columns: Sequence[np.ndarray], y: np.ndarray, start: np.ndarray, s: Boost) -> list[list[Tree]]:
    """trees[round][class] of one model, whose rows are all here."""
    z, out = np.tile(start[:, None], (1, len(y))), []
    true, none = [y == k for k in range(CLASSES)], np.zeros(len(y))
    counts = codes.histograms(columns, None, none, none)[..., 2]
    for _ in range(s.trees):
        p, trees = _softmax(z, 0), []
        for k in range(CLASSES):
            t, leaves = _grown(codes, columns, p[k] - true[k], FACTOR * p[k] * (1 - p[k]), s, counts)
            for i, at in leaves.items():
                if at is None:
                    z[k] += t.value[i]
                else:
                    z[k, at] += t.value[i]
            trees.append(t)
        out.append(trees)
    return out


def _fit_in_tasks(rows: DataFrame, settings: Mapping[str, Boost], models: Sequence[tuple[str, int]], start: Mapping[int, np.ndarray], bins: int) -> dict[tuple[str, int], dict]:
    """fit_boosted for tables whose folds have TASK_ROWS at most: a task reads the columns and rows of its model and fits it."""
    years = sorted({y for _, y in models})
    asked: dict[tuple, list[int]] = {}  # features -> the folds that have models with them
    for y in years:
        asked.setdefault(tuple(sorted({x for n, f in models if f == y for x in settings[n].features})), []).append(y)
    limits = {(y, x): t for names, own in asked.items() for y, ts in bin_limits(rows, names, own, bins).items() for x, t in zip(names, ts, strict=True)}
    own = {(n, y): [limits[y, x] for x in settings[n].features] for n, y in models}

    def fit(i: int) -> list[list[Tree]]:
        s, y, codes = settings[models[i][0]], models[i][1], _Codes(own[models[i]], bins)

        def run(batches):
            parts, results = [], []
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(s.features))
                parts.append(codes.of(x))
                results.append(batch.column(0).to_numpy().astype(np.int8))
            columns = [np.concatenate([p[j] for p in parts]) for j in range(len(codes.groups))]
            parts.clear()
            trees = _fit_rows(codes, columns, np.concatenate(results), start[y], s)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])

        used = rows.where(F.col("season") < y).select(F.col("result").cast("int"), F.array(*[F.col(x).cast("double") for x in s.features]).alias("x"))
        return pickle.loads(used.coalesce(1).mapInArrow(run, "trees binary").first().trees)

    work = lambda i: settings[models[i][0]].trees * settings[models[i][0]].depth * len(settings[models[i][0]].features)
    # a job for each, the longest first: a union of single partitions would be one partition
    spark, order = rows.sparkSession, sorted(range(len(models)), key=lambda i: (-work(i), -models[i][1]))
    with ThreadPoolExecutor(max(2, min(len(models), spark.sparkContext.defaultParallelism))) as pool:
        waiting = {i: pool.submit(inheritable_thread_target(spark)(fit), i) for i in order}
        got = {i: x.result() for i, x in waiting.items()}
    return {m: {"limits": own[m], "start": start[m[1]], "trees": got[i]} for i, m in enumerate(models)}


def fit_boosted(rows: DataFrame, settings: Mapping[str, Boost], folds: Mapping[str, Sequence[int]], store: Callable[[DataFrame, str], DataFrame], bins: int = BINS) -> dict[tuple[str, int], dict]:
    """(setting, fold) -> {limits, start, trees}: trees[round][class], learned from the rows (season, result, features..) of earlier seasons.

    Where no fold learns from more than TASK_ROWS rows a task fits a model by itself, all models side by side. Otherwise rows are binned once for each fold. A pass over them makes the gradient histograms of one level of the trees of all settings, folds
    and classes; the histograms of a (setting, fold, class) meet in one task, which finds the best splits, so that the driver gets a
    split per node. Trees grow to their depth and keep the best splits. Margins are written every REFRESH rounds; between, the trees since
    are applied, to the rows that their fold learns from. A task works on columns of its batch by season, so that a fold's rows are its
    first ones. Null features and results that are missing before a fold raise ValueError.
    """
    names = sorted({x for s in settings.values() for x in s.features})
    years = sorted({y for f in folds.values() for y in f})
    models = [(n, y) for n in settings for y in folds[n]]
    missing = F.count_if(reduce(lambda a, b: a | b, [F.col(x).isNull() for x in names]))
    met = rows.groupBy("season", "result").agg(F.count("*").alias("count"), missing.alias("missing")).collect()  # a row per season and result
    if any(r.missing for r in met):
        raise ValueError("a feature is null")
    seasons = {(r.season, r.result): r["count"] for r in met}
    start = {}
    for y in years:
        n = np.array([sum(c for (s, k), c in seasons.items() if s < y and k == i) for i in range(CLASSES)], float)
        if not n.all():
            raise ValueError(f"a result is missing before {y}")
        start[y] = np.log(n / n.sum())
    if sum(c for (s, _), c in seasons.items() if s < years[-1]) <= TASK_ROWS:
        return _fit_in_tasks(rows, settings, models, start, bins)
    limits = bin_limits(rows, names, years, bins)
    cols = {n: np.array([names.index(x) for x in s.features]) for n, s in settings.items()}
    blank = np.concatenate([start[y] for _, y in models]).tobytes()

    def cut(batches):
        for batch in batches:
            x = batch.column(2).values
            if x.null_count:
                raise ValueError("a feature is null")
            batch = batch.filter(pa.array(batch.column(0).to_numpy() < years[-1]))  # no fold learns from the others
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            b = np.stack([_binned(x, limits[y]) for y in years], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in b], pa.binary()), pa.array([blank] * len(b), pa.binary())], ["season", "result", "bins", "margin"])

    kind = "season int, result int, bins binary, margin binary"
    used = rows.select(F.col("season").cast("int"), F.col("result").cast("int"), F.array(*[F.col(x).cast("double") for x in names]).alias("x"))
    # few files of one size, so that tasks that read them are equal and fill the cores evenly
    files = max(2 * rows.sparkSession.sparkContext.defaultParallelism, sum(seasons.values()) // FILE_ROWS)
    table = store(used.repartition(files).mapInArrow(cut, kind), "binned")

    def read(batch):
        """Season and result by season, the bins of all rows by fold and feature, their margins by model and class, and the rows' order."""
        n, season = batch.num_rows, batch.column(0).to_numpy()
        order = np.argsort(season, kind="stable")
        b = _bytes(batch.column(2)).reshape(n, -1)[order].T
        margins = _bytes(batch.column(3)).view(float).reshape(n, -1)[order].T
        return season[order], batch.column(1).to_numpy()[order], np.ascontiguousarray(b).reshape(len(years), len(names), n), margins.copy().reshape(len(models), CLASSES, n), order

    def grow(margins: np.ndarray, own: np.ndarray, m: int, fresh: dict) -> None:
        for k in range(CLASSES):
            for t in fresh.get((m, k), ()):
                margins[k] += t.value[t.leaf(own)]

    def level(now: dict, fresh: dict, depth: int) -> dict[tuple[int, int], list]:
        """The best splits of the nodes of a level, for each model and class in now (its tree so far)."""
        w, base = 2**depth, 2**depth - 1

        def part(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                season, y, b, margins, _ = read(batch)
                for m in sorted({m for m, _ in now}):
                    n = np.searchsorted(season, models[m][1])
                    if not n:
                        continue
                    own = b[years.index(models[m][1]), cols[models[m][0]], :n]
                    grow(margins[m, :, :n], own, m, fresh)
                    p = _softmax(margins[m, :, :n], 0)
                    for k in range(CLASSES):
                        if (m, k) not in now:
                            continue
                        g, h, node, mine = p[k] - (y[:n] == k), FACTOR * p[k] * (1 - p[k]), now[m, k].leaf(own), own
                        here = np.flatnonzero(node >= base)
                        if len(here) < n:
                            g, h, node, mine = g[here], h[here], node[here], own[:, here]
                        first, hist = (node.astype(np.intp) - base) * bins, np.empty((3, len(own), w * bins))
                        for f, column in enumerate(mine):
                            at = first + column
                            for i, x in enumerate((g, h, None)):
                                hist[i, f] = np.bincount(at, x, w * bins)
                        total[m, k] = total[m, k] + hist if (m, k) in total else hist
            sent = [v.reshape(3, -1, w, bins).transpose(2, 1, 3, 0).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array([m * CLASSES + k for m, k in total], pa.int32()), pa.array(sent, pa.binary())], ["model", "hist"])

        def split(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, hist in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(hist)
                    total[key] = total[key] + x if key in total else x
            keys, found = list(total), []
            for key in keys:
                s = settings[models[key // CLASSES][0]]
                found.append([list(map(float, x)) if x else None for x in best_splits(total[key].reshape(2**depth, len(s.features), bins, 3), s)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["model", "splits"])

        sent = table.mapInArrow(part, "model int, hist binary").repartition(min(len(now), 16), "model").mapInArrow(split, "model int, splits array<array<double>>")
        return {divmod(r.model, CLASSES): r.splits for r in sent.collect()}  # a split per node

    out = {m: {"limits": [limits[m[1]][i] for i in cols[m[0]]], "start": start[m[1]], "trees": []} for m in models}
    fresh: dict[tuple[int, int], list[Tree]] = {}
    for r in range(max(settings[n].trees for n, _ in models)):
        active = [i for i, (n, _) in enumerate(models) if r < settings[n].trees]
        if r and r % REFRESH == 0:
            known = fresh

            def refreshed(batches, known=known):
                for batch in batches:
                    season, _, b, margins, order = read(batch)
                    for m, (name, y) in enumerate(models):
                        n = np.searchsorted(season, y)
                        grow(margins[m, :, :n], b[years.index(y), cols[name], :n], m, known)
                    out = np.empty((batch.num_rows, len(models) * CLASSES))
                    out[order] = margins.reshape(len(models) * CLASSES, -1).T
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in out], pa.binary())], ["season", "result", "bins", "margin"])

            table, fresh = store(table.mapInArrow(refreshed, kind), "margins"), {}
        now = {(m, k): Tree(settings[models[m][0]].depth) for m in active for k in range(CLASSES)}
        gains = {key: np.full(len(t.feature), -np.inf) for key, t in now.items()}
        going = dict(now)
        for depth in range(max(settings[models[m][0]].depth for m in active)):
            going = {key: t for key, t in going.items() if depth < settings[models[key[0]][0]].depth}
            if not going:
                break
            got, first, still = level(going, fresh, depth), 2**depth - 1, {}
            for key, splits in got.items():
                t, rate = now[key], settings[models[key[0]][0]].rate
                for i, x in enumerate(splits):
                    if x:
                        at = first + i
                        gains[key][at], t.feature[at], t.bin[at] = x[0], int(x[1]), int(x[2])
                        t.value[2 * at + 1], t.value[2 * at + 2] = rate * x[3], rate * x[4]
                        still[key] = t
            going = still
        for m in active:
            trees = [pruned(now[m, k], gains[m, k], settings[models[m][0]].leaves) for k in range(CLASSES)]
            out[models[m]]["trees"].append(trees)
            for k, t in enumerate(trees):
                fresh.setdefault((m, k), []).append(t)
    return out


def margins_of(x: np.ndarray, fit: dict) -> np.ndarray:
    """Probabilities of rows of raw features by one fit."""
    b, z = np.ascontiguousarray(_binned(x, fit["limits"]).T), np.tile(fit["start"], (len(x), 1))
    for trees in fit["trees"]:
        for k, t in enumerate(trees):
            z[:, k] += t.value[t.leaf(b)]
    return _softmax(z)


def predict_boosted(rows: DataFrame, settings: Mapping[str, Boost], fits: Mapping[tuple[str, int], dict], id_col: str = "contest_id") -> DataFrame:
    """(id, season, result, candidate, probabilities) of every row of a fold's season by every setting that has the fold. Trees are broadcast."""
    names = sorted({x for s in settings.values() for x in s.features})
    shared = rows.sparkSession.sparkContext.broadcast(dict(fits))

    def score(batches):
        for batch in batches:
            season = batch.column(1).to_numpy()
            x = batch.column(3).values.to_numpy(zero_copy_only=False).reshape(-1, len(names))
            for (name, fold), fit in shared.value.items():
                at = np.flatnonzero(season == fold)
                if len(at):
                    p = margins_of(x[at][:, [names.index(f) for f in settings[name].features]], fit)
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array([name] * len(at)), *[pa.array(p[:, k]) for k in range(CLASSES)]], [id_col, "season", "result", "candidate", *P])

    used = rows.select(id_col, F.col("season").cast("int"), F.col("result").cast("int"), F.array(*[F.col(x).cast("double") for x in names]).alias("x"))
    return used.mapInArrow(score, f"{id_col} {dict(rows.dtypes)[id_col]}, season int, result int, candidate string, {', '.join(f'{p} double' for p in P)}")
