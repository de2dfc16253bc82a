"""Exact top-k search by inner product: a table of distances to pivots eliminates candidates before they are scored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivalry.llm.common import written

#: Pivots for vectors of one length, and the rows that they are chosen from.
PIVOTS = 32
SAMPLE = 1024
#: Rows of a block of candidates and of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Squared norms below this keep every sum of products exact in a double.
EXACT = float(1 << 52)
#: Block pairs are listed in so many slices, so that no task holds all blocks of one length.
SLICES = 64
#: Queries that share an order of candidates, and candidates that are scored together.
QUERIES, TILE = 64, 512
#: Share of the squared norms by which a bound from rounded distances may be off.
SLACK = 4e-6
#: No score.
NONE = np.iinfo(np.int64).min


def quantised(vec: str | Column, scale: int) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vec: str | Column) -> Column:
    """False where the vector or a component of it is null or isn't finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vec, bad), F.lit(False))


def choose_pivots(rows: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """By length of vector: up to n pivots, each the one farthest from those before it, from at most `sample` rows in the order of a hash."""
    got = rows.select("v", F.xxhash64("id").alias("o")).orderBy("o").limit(sample).select("v").collect()  # at most `sample` rows
    out = {}
    for dim in sorted({len(r.v) for r in got} - {0}):
        x = np.unique(np.array([r.v for r in got if len(r.v) == dim]).reshape(-1, dim), axis=0)
        x = x[(x * x).sum(axis=1) < EXACT]
        far, picks = np.full(len(x), np.inf), []
        while len(picks) < min(n, len(x)):
            picks.append(int(np.argmax(far)))
            far = np.minimum(far, ((x - x[picks[-1]]) ** 2).sum(axis=1))
        if picks:
            out[dim] = x[picks]
    return out


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, v) with dim, squared norm (infinite where sums could be rounded), distances to the pivots and the nearest pivot."""
    kind = dict(rows.dtypes)["id"]

    def measure(batches):
        for batch in batches:
            v = batch.column(1)
            ends = np.asarray(v.offsets)
            values, first, dims = np.asarray(v.values), ends[:-1], np.diff(ends)
            norm, near = np.zeros(len(dims)), np.zeros(len(dims), np.int32)
            dists: list = [[]] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = values[first[at][:, None] + np.arange(dim)]
                norm[at] = (x * x).sum(axis=1)
                p = pivots.get(int(dim))
                if p is not None:
                    small = norm[at] < EXACT
                    d = np.zeros((len(at), len(p)))
                    d[small] = np.sqrt(np.maximum(norm[at][small, None] + (p * p).sum(axis=1) - 2 * x[small] @ p.T, 0))
                    near[at] = d.argmin(axis=1)
                    for i, own in zip(at, d, strict=True):
                        dists[i] = own
            norm[norm >= EXACT] = np.inf
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(dims, pa.int32()), pa.array(norm), pa.array(near), pa.array(dists, pa.list_(pa.float64()))], ["id", "v", "dim", "norm", "near", "dist"])

    return rows.select("id", "v").mapInArrow(measure, f"id {kind}, v array<double>, dim int, norm double, near int, dist array<double>")


def in_blocks(table: DataFrame, size: int, n_pivots: int, name: str) -> DataFrame:
    """table with block: rows near the same pivots, about `size` of them; what is near one pivot is dealt to as many blocks as it needs."""
    table = written(table.withColumn("row", F.monotonically_increasing_id()), f"{name}-table")
    per = table.groupBy("dim", "near").agg(F.count("*").alias("n"))
    spread = F.least(F.lit(n_pivots), F.ceil(F.sum("n") / size))
    per = per.join(per.groupBy("dim").agg(spread.alias("cells")), "dim").withColumn("cell", F.col("near") % F.col("cells"))
    parts = per.groupBy("dim", "cell").agg(F.ceil(F.sum("n") / size).alias("parts"))
    places = written(per.join(parts, ["dim", "cell"]).select("dim", "near", "cell", "parts"), f"{name}-places")
    block = F.concat_ws(":", "dim", "cell", F.pmod(F.xxhash64("row"), "parts"))
    return written(table.join(places, ["dim", "near"]).withColumn("block", block).drop("near", "cell", "parts"), f"{name}-blocks")


def block_bounds(blocks: DataFrame, n_pivots: int, name: str) -> DataFrame:
    """A row per block: its length of vectors, the largest norm, and the interval of the distances to each pivot."""
    at = [F.get("dist", F.lit(i)) for i in range(n_pivots)]
    out = blocks.groupBy("block", "dim").agg(F.max("norm").alias("norm"), *[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(at) for f in (F.min, F.max)])
    return out.select(F.col("block").alias(name), "dim", F.col("norm").alias(f"{name}_norm"), *[F.array(*[f"{m}{i}" for i in range(n_pivots)]).alias(f"{name}_{m}") for m in ("min", "max")])


def block_pairs(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, c, most) for each block of queries and each block of candidates of the same length: no score of the pair is above `most`."""
    q = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    pairs = q.join(blocks.withColumn("slice", F.pmod(F.hash("c"), F.lit(SLICES))), ["dim", "slice"])
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    apart = F.array_max(F.zip_with(less("q_min", "c_max"), less("c_min", "q_max"), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    apart = F.coalesce(apart, F.lit(0.0))
    sums = F.col("q_norm") + F.col("c_norm")
    most = F.least((sums - apart * apart) / 2, F.sqrt("q_norm") * F.sqrt("c_norm"))
    return pairs.select("q", "c", F.when(sums < EXACT, most + sums * SLACK + 1).otherwise(float("inf")).alias("most"))


def _whole(x: np.ndarray, y: np.ndarray) -> int:
    """An inner product beyond the doubles, held within 64 bits."""
    return max(1 - (1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True))))


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row, in no order."""
    return scores if scores.shape[1] <= k else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _eliminate(k: int):
    """For a block of queries and one of candidates: the k best of each query, unless `need` or the bounds exclude them.

    QUERIES queries at a time share one order of the candidates, by their highest bound for any of them, and score TILE of them at a time.
    A query stops where no bound from there on reaches `need` or the k-th best score that it has met.
    """

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        c = c.sort_values("id", kind="stable")
        ids, norm = c["id"].to_numpy(), c["norm"].to_numpy()
        if len(c):
            x, dist = np.stack(c["v"].to_numpy()), np.ascontiguousarray(np.stack(c["dist"].to_numpy()).T, np.float32)
        for a in range(0, len(q) if len(c) else 0, QUERIES):
            part = q.iloc[a : a + QUERIES]
            v, own = np.stack(part["v"].to_numpy()), np.stack(part["dist"].to_numpy()).astype(np.float32)
            need, asked = part["need"].to_numpy().copy(), part["id"].to_numpy()
            far, gap = np.zeros((len(part), len(c)), np.float32), np.empty((len(part), len(c)), np.float32)
            for i, d in enumerate(dist):
                np.maximum(far, np.abs(np.subtract(d, own[:, i, None], out=gap), out=gap), out=far)
            sums = part["norm"].to_numpy()[:, None] + norm
            exact = sums < EXACT
            with np.errstate(invalid="ignore"):
                most = np.where(exact, np.floor((sums - np.square(far, dtype=np.float64)) / 2 + sums * SLACK), np.inf)
            for i, (lo, hi) in enumerate(zip(np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right"), strict=True)):
                most[i, lo:hi] = -np.inf
            order = np.argsort(-most.max(axis=0), kind="stable")
            starts = range(0, len(c), TILE)
            ahead = np.array([most[:, order[s : s + TILE]].max(axis=1) for s in starts])
            ahead = np.maximum.accumulate(ahead[::-1])[::-1]  # the highest bound from each tile on
            top, met = np.full((len(part), k), NONE, np.int64), []
            for s, bound in zip(starts, ahead, strict=True):
                on = np.flatnonzero((bound >= need) & (bound > -np.inf))
                if not len(on):
                    break
                tile = order[s : s + TILE]
                with np.errstate(invalid="ignore", over="ignore"):
                    score = (v[on] @ x[tile].T).astype(np.int64)
                for i, j in np.argwhere(~exact[np.ix_(on, tile)]):
                    score[i, j] = _whole(v[on[i]], x[tile[j]])
                score[most[np.ix_(on, tile)] == -np.inf] = NONE
                top[on] = _highest(np.concatenate((top[on], score), axis=1), k)
                kth = top[on].min(axis=1)
                need[on] = np.where(kth > NONE, np.maximum(need[on], kth.astype(np.float64)), need[on])
                i, j = np.nonzero((score > NONE) & (score >= np.maximum(kth, NONE)[:, None]))
                met.append((on[i], tile[j], score[i, j]))
            if met:
                i, j, score = (np.concatenate(z) for z in zip(*met, strict=True))
                keep = score >= top.min(axis=1)[i]
                i, j, score = i[keep], j[keep], score[keep]
                best = np.lexsort((j, -score, i))
                i, j, score = i[best], j[best], score[best]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"row": part["row"].to_numpy()[i[keep]], "query_id": asked[i[keep]], "vec_id": ids[j[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors of other ids; ties to the smaller id.

    Both frames hold whole-number vectors (see quantised). Distances to up to n_pivots pivots, chosen from at most `sample` rows, are
    computed once and stored. With them |d(q, p) - d(x, p)| bounds the distance of q and x from below, so the score from above. Blocks of
    queries first meet the block with the highest bound, which gives each query a score that k candidates reach; then those blocks and
    candidates whose bound reaches it, in the order of bounds, until the next bound is below the k-th best score. No candidate is left
    out otherwise, so the result is exact, however far the bounds reach.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Vectors meet those of their own
    length only. Ids are of any type that can be sorted. Repeated rows are candidates each; repeated queries are answered each.
    Scores are exact, and held at the ends of 64 bits beyond them. Other columns aren't read. An empty table gives no rows.
    """
    pick = lambda df: df.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows, asked = pick(vectors), pick(queries)
    kind = dict(rows.dtypes)["id"]
    pivots = choose_pivots(rows, n_pivots, sample)
    blocks = in_blocks(pivot_table(rows, pivots), block, n_pivots, "vectors").withColumnRenamed("block", "c")
    asked = in_blocks(pivot_table(asked, pivots), query_block, n_pivots, "queries").withColumnRenamed("block", "q")
    pairs = written(block_pairs(block_bounds(asked.withColumnRenamed("q", "block"), n_pivots, "q"), block_bounds(blocks.withColumnRenamed("c", "block"), n_pivots, "c")), "pairs")

    def meet(pairs: DataFrame, asked: DataFrame, name: str) -> DataFrame:
        q = asked.join(pairs, "q").groupBy("q", "c")
        c = blocks.join(pairs, "c").select("q", "c", "id", "v", "norm", "dist").groupBy("q", "c")
        return written(q.cogroup(c).applyInPandas(_eliminate(k), f"row long, query_id {kind}, vec_id {kind}, score long"), name)

    first = pairs.groupBy("q").agg(F.max_by("c", "most").alias("c"))
    found = meet(first, asked.withColumn("need", F.lit(float("-inf"))), "first")
    reached = found.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("need"))
    asked = written(asked.join(reached, "row", "left").withColumn("need", F.coalesce("need", F.lit(float("-inf")))), "asked")
    least = asked.groupBy("q").agg(F.min("need").alias("need"))
    rest = pairs.join(least, "q").where("most >= need").join(first, ["q", "c"], "left_anti").select("q", "c")
    found = found.union(meet(rest, asked, "rest"))
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
