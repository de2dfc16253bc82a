"""Sequential ratings: replays with O(entities) state, partitioned by pool and configuration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.core.asof import ID, appearances, by_id
from rivalry.operators.link import membership

#: Columns of a configuration, with the values that a missing one has.
CONFIG = {"config": "base", "k": 20.0, "home_adv": 0.0, "early_k": None, "early_games": 5, "pull": 0.0, "reset": "none", "offset": False, "use_prior": True}
START = 1500.0
OUT = "pool string, config string, contest_id long, home_rating double, away_rating double"

Update = Callable[[dict, dict], tuple[float, float]]


def elo_update(row: dict, state: dict) -> tuple[float, float]:
    """The change of the home rating and of the away rating from one contest."""
    gap = (row["away_rating"] - row["home_rating"] - row["home_adv"]) / 400.0
    expected = 1.0 / (1.0 + 10.0 ** max(-300.0, min(300.0, gap)))
    step = row["k"] * (row["result"] / 2.0 - expected)
    return step, -step


def _new_season(ratings: dict, passed: int, config: Mapping, moves: Sequence[tuple]) -> None:
    """Season boundary: pull to the start value once for each season passed, then offsets and resets of entities.

    moves: (entity, status, move) of the season that begins; those without a rating are left out.
    """
    if config["pull"]:
        keep = (1.0 - config["pull"]) ** passed
        for e in ratings:
            ratings[e] = START + (ratings[e] - START) * keep
    moves = [m for m in moves if m[0] in ratings]
    if config["offset"]:
        up, down = ([e for e, _, move in moves if move == m] for m in ("promoted", "relegated"))
        offset = promotion_offset([ratings[e] for e in down], [ratings[e] for e in up])
        for e in up:
            ratings[e] += offset
    for e, status, _ in moves:
        if status in ("returning", "first_time") and config["reset"] in (status, "both"):
            ratings[e] = START


class _Pool:
    """Ratings of a pool: a row per entity, a column per configuration; and the contests of the last date, which are still to count."""

    def __init__(self, configs: Sequence[Mapping]):
        self.configs = configs
        self.at: dict = {}
        self.ratings, self.known = np.empty((64, len(configs))), np.zeros(64, bool)
        self.day = self.season = None
        self.moves: list[tuple] = []
        self.waiting: list[tuple] = []

    def places(self, entities: list) -> np.ndarray:
        out = np.array([self.at.setdefault(e, len(self.at)) for e in entities], np.int64)
        while len(self.at) > len(self.known):
            self.ratings, self.known = np.concatenate((self.ratings, np.empty_like(self.ratings))), np.concatenate((self.known, np.zeros_like(self.known)))
        return out

    def flush(self) -> None:
        """Count the contests of the last date: an entity that has no rating yet starts from the one that its first row was given."""
        for place, start, step in self.waiting:
            new = np.flatnonzero(~self.known[place])
            if len(new):
                first, at = np.unique(place[new], return_index=True)
                self.ratings[first], self.known[first] = start[new[at]], True
            np.add.at(self.ratings, place, step)
        self.waiting.clear()

    def new_season(self, passed: int, moves: Sequence[tuple]) -> None:
        r, known = self.ratings, np.flatnonzero(self.known)
        moves = [(self.at[e], status, move) for e, status, move in moves if e in self.at and self.known[self.at[e]]]
        up, down = ([e for e, _, move in moves if move == m] for m in ("promoted", "relegated"))
        for i, c in enumerate(self.configs):
            if c["pull"]:
                r[known, i] = START + (r[known, i] - START) * (1.0 - c["pull"]) ** passed
            if c["offset"]:
                r[up, i] += promotion_offset(r[down, i].tolist(), r[up, i].tolist())
            back = [e for e, status, _ in moves if status in ("returning", "first_time") and c["reset"] in (status, "both")]
            r[back, i] = START


def _vector_replay(batches: Iterable[pa.RecordBatch], configs: Sequence[Mapping], final: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pool, season, events first, and date; each run of rows of one date is rated and counted at once."""
    names = np.array([str(c["config"]) for c in configs], object)
    n = len(configs)
    of = lambda key: np.array([np.nan if c[key] is None else float(c[key]) for c in configs])
    k, adv, early_k, early_games, use_prior = of("k"), of("home_adv"), of("early_k"), of("early_games"), np.array([bool(c["use_prior"]) for c in configs])
    key, pool = None, None

    def told(pools: list, ids: np.ndarray, home: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(ids)), n)
        text = lambda values, index: pa.DictionaryArray.from_arrays(pa.array(index, pa.int32()), pa.array(values, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([text(pools, at), text(list(names), np.tile(np.arange(n), len(ids))), pa.array(np.repeat(ids, n), pa.int64()), pa.array(home.ravel()), pa.array(away.ravel())], ["pool", "config", ID, "home_rating", "away_rating"])

    def ended() -> pa.RecordBatch:
        pool.flush()
        kept = [(e, i) for e, i in pool.at.items() if pool.known[i]]
        return told([key] * len(kept), np.array([e for e, _ in kept], np.int64), pool.ratings[[i for _, i in kept]].reshape(-1, n), np.full((len(kept), n), np.nan))

    for batch in batches:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        value = lambda c: cols[c].cast(pa.float64()).to_numpy(zero_copy_only=False) if c in cols else np.full(batch.num_rows, np.nan)  # noqa: B023, E731
        pools, home, away = (cols[c].to_pylist() for c in ("pool", "home", "away"))
        ids, event = cols[ID].fill_null(0).to_numpy(zero_copy_only=False), cols[ID].is_null().to_numpy(zero_copy_only=False)
        season = cols["season"].to_numpy(zero_copy_only=False)
        day = cols["d"].cast(pa.date32()).cast(pa.int32()).fill_null(-(1 << 31)).to_numpy(zero_copy_only=False)
        result, k_row, adv_row = value("result"), value("k_row"), value("adv_row")
        prior = np.stack([value("prior_home"), value("prior_away")], axis=1)
        ordinal = np.fmin(value("home_ordinal"), value("away_ordinal"))
        status, move = (cols[c].to_pylist() if c in cols else None for c in ("status", "move"))
        rated = np.empty((batch.num_rows, 2, n))
        code = np.unique(np.array(pools, str), return_inverse=True)[1] if pools else np.empty(0)
        change = (code[1:] != code[:-1]) | (season[1:] != season[:-1]) | (day[1:] != day[:-1]) | (event[1:] != event[:-1])
        starts = np.concatenate(([0], np.flatnonzero(change) + 1)) if len(pools) else []
        for a, b in zip(starts, [*starts[1:], len(pools)], strict=True):
            if pools[a] != key:
                if pool is not None and final:
                    yield ended()
                key, pool = pools[a], _Pool(configs)
            if event[a]:
                if pool.moves and pool.moves[0][0] != season[a]:
                    pool.moves.clear()
                pool.moves.extend((season[i], home[i], status[i], move[i]) for i in range(a, b))
                continue
            if day[a] != pool.day:
                pool.flush()
                pool.day = day[a]
            if pool.season is not None and season[a] > pool.season:
                pool.new_season(int(season[a] - pool.season), [m[1:] for m in pool.moves if m[0] == season[a]])
            pool.season = season[a]
            place = pool.places([e for pair in zip(home[a:b], away[a:b], strict=True) for e in pair])
            given = prior[a:b].reshape(-1, 1)
            start = np.where(use_prior & ~np.isnan(given), given, START)
            now = np.where(pool.known[place, None], pool.ratings[place], start)
            rated[a:b] = now.reshape(-1, 2, n)
            counted = np.flatnonzero(~np.isnan(result[a:b]))
            if len(counted):
                at = a + counted
                own_k = np.where(np.isnan(k_row[at, None]), k, k_row[at, None])
                own_k = np.where(~np.isnan(early_k) & (ordinal[at, None] <= early_games), early_k, own_k)
                own_adv = np.where(np.isnan(adv_row[at, None]), adv, adv_row[at, None])
                gap = np.clip((rated[at, 1] - rated[at, 0] - own_adv) / 400.0, -300.0, 300.0)
                step = own_k * (result[at, None] / 2.0 - 1.0 / (1.0 + 10.0**gap))
                both = np.stack((2 * counted, 2 * counted + 1), axis=1).ravel()
                pool.waiting.append((place[both], now[both], np.stack((step, -step), axis=1).reshape(-1, n)))
        if not final:
            shown = ~event
            yield told([p for p, e in zip(pools, event, strict=True) if not e], ids[shown], rated[shown, 0], rated[shown, 1])
    if pool is not None and final:
        yield ended()


#: Columns that a contest may have beside its result.
MORE = ("k_row", "adv_row", "prior_home", "prior_away", "home_ordinal", "away_ordinal")
#: What stands for a null entity in blocks.
NOBODY = -(1 << 63)
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _packed(batches: Iterable[pa.RecordBatch], numbers: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pool, season, date and id -> a compressed block of numbers for each run of one date, in the same order (seq)."""
    seq = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        code = [cols[c].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in ("pool", "season", "d")]
        starts = np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in code], axis=0)) + 1))
        ends = np.append(starts[1:], batch.num_rows)
        whole = [cols[c].cast(pa.int64()).fill_null(NOBODY).to_numpy(zero_copy_only=False) for c in (ID, "home", "away")]
        real = [np.ascontiguousarray(cols[c].cast(pa.float64()).to_numpy(zero_copy_only=False)).view(np.int64) for c in numbers]
        table = np.stack([*whole, *real])
        data = [pa.compress(table[:, a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(starts, ends, strict=True)]
        key = [cols[c].take(pa.array(starts)) for c in ("pool", "season", "d")]
        yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(seq, seq + len(starts))), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())], ["pool", "season", "d", "seq", "n", "data"])
        seq += len(starts)


def _unpacked(batches: Iterable[pa.RecordBatch], numbers: Sequence[str], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The rows of blocks and of season events, about `most` at a time."""
    waiting: list[tuple] = []

    def rows() -> pa.RecordBatch:
        pool, season, day, status, move, event, tables = zip(*waiting, strict=True)
        table, n = np.concatenate(tables, axis=1), [t.shape[1] for t in tables]
        text = lambda values: pa.array(np.repeat(np.array(values, object), n), pa.string())
        ids = pa.array(table[0], mask=np.repeat(event, n))
        known = {"pool": text(pool), ID: ids, "season": pa.array(np.repeat(season, n)), "d": pa.array(np.repeat(np.array(day, np.int32), n)).cast(pa.date32()), "home": pa.array(table[1]), "away": pa.array(table[2]), "status": text(status), "move": text(move)}
        waiting.clear()
        return pa.RecordBatch.from_pydict(known | {c: pa.array(x.view(np.float64)) for c, x in zip(numbers, table[3:], strict=True)})

    held = 0
    for batch in batches:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        day = cols["d"].cast(pa.date32()).cast(pa.int32()).fill_null(-(1 << 31)).to_pylist()
        own = [cols[c].to_pylist() if c in cols else [None] * batch.num_rows for c in ("home", "status", "move")]
        for pool, season, d, n, data, e, status, move in zip(cols["pool"].to_pylist(), cols["season"].to_numpy(zero_copy_only=False), day, cols["n"].to_pylist(), cols["data"], *own, strict=True):
            if n is None:
                table = np.full((3 + len(numbers), 1), NOBODY)
                table[1] = e
            else:
                size = 8 * n * (3 + len(numbers))
                table = np.frombuffer(pa.decompress(data.as_buffer(), size, "zstd"), np.int64).reshape(-1, n)
            waiting.append((pool, season, d, status, move, n is None, table))
            held += table.shape[1]
            if held >= most:
                yield rows()
                held = 0
    if waiting:
        yield rows()


def replay(
    contests: DataFrame,
    configs: Sequence[Mapping] = ({},),
    pool: str = "competition",
    update: Update = elo_update,
    events: DataFrame | None = None,
    final: bool = False,
) -> DataFrame:
    """Pre-contest ratings of every contest for each configuration; with final, the ratings after the last date.

    Pools are closed populations and share no state: the pool is the shuffle key, rows are sorted by (season, date, id as text)
    within tasks, and a task carries one number per entity and configuration from batch to batch. A date's contests are sorted and packed
    by all tasks, so that the task of a pool sorts compressed blocks, and they are updated together for all configurations. Another update than the default one is called row by row, with
    (pool, config) as the key.
    All contests of a date read the state of the date before. Rows with a null result are targets: they are
    rated but change nothing. Optional columns: k_row and adv_row override a configuration's k and home_adv;
    prior_home and prior_away start an entity's rating. One giant pool is one task: use daily state
    (rivalry.streaming) there. events: (season, e, status, move), see membership_events; they travel in the
    same stream, before their season's contests, to the pools that the entity plays in. With offset, those
    promoted get the mean rating of the relegated less their own mean at the season's start.
    """
    spark = contests.sparkSession
    rows = [{**CONFIG, **c} for c in configs]
    more = [c for c in MORE if c in contests.columns]
    at = F.col(pool).cast("string").alias("pool")
    sent = contests.select(at, ID, "d", "season", "home", "away", "result", *more)
    packs = update is elo_update and all(dict(contests.dtypes)[c] in WHOLE for c in ("home", "away"))
    numbers = ["result", *more]
    if packs:
        sent = sent.where(F.col(ID).isNotNull()).repartition("pool", "season", "d").sortWithinPartitions("pool", "season", "d", by_id())
        kinds = dict(sent.dtypes)
        sent = sent.mapInArrow(lambda batches: _packed(batches, numbers), f"pool string, season {kinds['season']}, d {kinds['d']}, seq long, n int, data binary")
    if events is not None:
        plays = contests.select(at, F.explode(F.array("home", "away")).alias("e")).distinct()
        told = events.join(plays, "e").select("pool", "season", F.col("e").alias("home"), "status", "move")
        sent = sent.unionByName(told, allowMissingColumns=True)
    if packs:
        sent = sent.repartition("pool").sortWithinPartitions("pool", "season", F.col("n").isNotNull(), "d", "seq")
        return _rated(sent.mapInArrow(lambda batches: _vector_replay(_unpacked(batches, numbers), rows, final), OUT), final)
    if update is elo_update:
        sent = sent.repartition("pool").sortWithinPartitions("pool", "season", F.col(ID).isNotNull(), "d", by_id())
        return _rated(sent.mapInArrow(lambda batches: _vector_replay(batches, rows, final), OUT), final)
    conf = spark.createDataFrame([(str(c["config"]),) for c in rows], "config string")
    sent = sent.crossJoin(F.broadcast(conf)).repartition("pool", "config")
    sent = sent.sortWithinPartitions("pool", "config", "season", F.col(ID).isNotNull(), "d", by_id())
    settings = {str(c["config"]): c for c in rows}

    def kernel(batches: Iterable[pd.DataFrame]):
        key, ratings, day, last = None, {}, None, None
        waiting: list[dict] = []
        moves: list[tuple] = []

        def flush() -> None:
            for r in waiting:
                if r["result"] is not None and r["result"] == r["result"]:
                    a, b = update(r, ratings)
                    ratings[r["home"]] = ratings.get(r["home"], r["home_rating"]) + a
                    ratings[r["away"]] = ratings.get(r["away"], r["away_rating"]) + b
            waiting.clear()

        def finish(out: list[tuple]) -> None:
            flush()
            if final and key is not None:
                out.extend((*key, e, x, float("nan")) for e, x in ratings.items())

        for batch in batches:
            out: list[tuple] = []
            names = list(batch.columns)
            for values in zip(*(batch[c].tolist() for c in names), strict=True):
                r = dict(zip(names, values, strict=True))
                if (r["pool"], r["config"]) != key:
                    finish(out)
                    key, ratings, day, last = (r["pool"], r["config"]), {}, None, None
                    moves.clear()
                    c = settings[r["config"]]
                if r[ID] is None or r[ID] != r[ID]:
                    if moves and moves[0][0] != r["season"]:
                        moves.clear()
                    moves.append((r["season"], int(r["home"]), r["status"], r["move"]))
                    continue
                if r["d"] != day:
                    flush()
                    day = r["d"]
                if last is not None and r["season"] > last:
                    _new_season(ratings, r["season"] - last, c, [m[1:] for m in moves if m[0] == r["season"]])
                last = r["season"]
                k, adv = r.get("k_row"), r.get("adv_row")
                early = c["early_k"] and min(r["home_ordinal"], r["away_ordinal"]) <= c["early_games"]
                r["k"] = c["early_k"] if early else c["k"] if k is None or k != k else k
                r["home_adv"] = c["home_adv"] if adv is None or adv != adv else adv
                for s in ("home", "away"):
                    prior = r.get(f"prior_{s}") if c["use_prior"] else None
                    r[f"{s}_rating"] = ratings.get(r[s], START if prior is None or prior != prior else prior)
                waiting.append(r)
                if not final:
                    out.append((*key, int(r[ID]), r["home_rating"], r["away_rating"]))
            yield pd.DataFrame(out, columns=["pool", "config", ID, "home_rating", "away_rating"])
        out = []
        finish(out)
        yield pd.DataFrame(out, columns=["pool", "config", ID, "home_rating", "away_rating"])

    return _rated(sent.mapInPandas(kernel, OUT), final)


def _rated(got: DataFrame, final: bool) -> DataFrame:
    if final:
        return got.select("pool", "config", F.col(ID).alias("e"), F.col("home_rating").alias("rating"))
    return got.withColumn("rating_diff", F.col("home_rating") - F.col("away_rating"))


def elo_multi_segment(segments: Sequence[DataFrame], configs: Sequence[Mapping] = ({},), pool: str = "competition") -> DataFrame:
    """One state over ordered segments; fails if a segment starts before the one before has ended, or ids repeat."""
    bounds = [s.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first() for s in segments]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a.hi is not None and b.lo is not None and b.lo <= a.hi:
            raise ValueError("segments overlap in time")
    rows = segments[0]
    for s in segments[1:]:
        rows = rows.unionByName(s)
    if rows.groupBy(ID).count().where("count > 1").take(1):
        raise ValueError("segments share ids")
    return replay(rows, configs, pool)


def final_ratings(contests: DataFrame, roster: DataFrame, config: Mapping | None = None, pool: str = "competition") -> DataFrame:
    """Rating of each (pool, e) of the roster; unplayed ones at the start value."""
    got = replay(contests, [config or {}], pool, final=True)
    return roster.join(got.select("pool", "e", "rating"), ["pool", "e"], "left").withColumn("rating", F.coalesce("rating", F.lit(START)))


def grid(ks: Sequence[float], advantages: Sequence[float]) -> list[dict]:
    return [{"config": f"k{k:g}a{a:g}", "k": float(k), "home_adv": float(a)} for k in ks for a in advantages]


def season_events(contests: DataFrame, top: str) -> DataFrame:
    """membership_events of the competitions that the contests are played in."""
    return membership_events(membership(contests), top)


def membership_events(m: DataFrame, top: str) -> DataFrame:
    """Rows (season, e, status, move) for competition `top`; m: distinct (competition, season, e).

    status: first_time or returning for entities that weren't in it the season before, else empty. move: promoted
    if they were in another one then; relegated for those that left it.
    """
    mine, other = m.where(F.col("competition") == top), m.where(F.col("competition") != top)
    first = mine.groupBy("e").agg(F.min("season").alias("first"))
    later = lambda df: df.select((F.col("season") + 1).alias("season"), "e").distinct()
    came = mine.select("season", "e").join(later(mine), ["season", "e"], "left_anti").join(first, "e")
    came = came.join(later(other).withColumn("up", F.lit(True)), ["season", "e"], "left")
    status = F.when(F.col("first") == F.col("season"), "first_time").otherwise("returning")
    came = came.select("season", "e", status.alias("status"), F.when(F.col("up"), "promoted").otherwise("").alias("move"))
    left = later(mine).join(mine.select("season", "e"), ["season", "e"], "left_anti")
    return came.union(left.select("season", "e", F.lit("").alias("status"), F.lit("relegated").alias("move")))


def promotion_offset(relegated: Iterable[float], promoted: Iterable[float]) -> float:
    """What promoted entities get: mean rating of the relegated less mean of the promoted; 0 if either is empty."""
    r, p = list(relegated), list(promoted)
    return sum(r) / len(r) - sum(p) / len(p) if r and p else 0.0


def with_ordinals(contests: DataFrame) -> DataFrame:
    """Adds home_ordinal and away_ordinal, each side's contest number in the season."""
    w = W.partitionBy("e", "season").orderBy("d", by_id())
    o = appearances(contests).withColumn("o", F.row_number().over(w))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("o"))).alias(f"{s}_ordinal")
    return contests.join(o.groupBy(ID).agg(pick("home"), pick("away")), ID)


def attack_defence(contests: DataFrame, train_until: int, rate: float = 0.05, pool: str = "competition") -> DataFrame:
    """Expected goals of every contest from online attack and defence strengths, contest by contest.

    Expected goals are the mean home (or away) score of the pool up to season train_until, times exp(attack of
    the side - defence of the other). After each contest both strengths move by rate times the surprise and all
    are recentred: only the mean is kept, so that a contest costs the same however many entities there are.
    Contests go by date and id as text.
    """
    cols = [ID, "d", "home", "away", "home_score", "away_score"]
    mean = lambda c: F.avg(F.when(F.col("season") <= train_until, F.col(c)))
    base = contests.groupBy(F.col(pool).alias("pool")).agg(mean("home_score").alias("base_home"), mean("away_score").alias("base_away"))
    sent = contests.select(F.col(pool).alias("pool"), *cols).join(F.broadcast(base), "pool").withColumn("pool", F.col("pool").cast("string"))
    sent = sent.repartition("pool").sortWithinPartitions("pool", "d", by_id())
    names = ["pool", ID, "home_lambda", "away_lambda"]

    def kernel(batches):
        key = None
        attack: dict = {}
        defence: dict = {}
        mean_a = mean_d = 0.0  # strengths are kept without centring; these are their means
        for batch in batches:
            out = []
            for pool_, cid, home, away, hs, as_, bh, ba in zip(*(batch[c].tolist() for c in ("pool", ID, "home", "away", "home_score", "away_score", "base_home", "base_away")), strict=True):
                if pool_ != key:
                    key, attack, defence, mean_a, mean_d = pool_, {}, {}, 0.0, 0.0
                for e in (home, away):
                    if e not in attack:  # a new entity starts at the mean
                        attack[e], defence[e] = mean_a, mean_d
                lh = bh * math.exp(attack[home] - mean_a - defence[away] + mean_d)
                la = ba * math.exp(attack[away] - mean_a - defence[home] + mean_d)
                out.append((key, cid, lh, la))
                dh, da = rate * (hs - lh), rate * (as_ - la)
                attack[home] += dh
                attack[away] += da
                defence[home] -= da
                defence[away] -= dh
                mean_a += (dh + da) / len(attack)
                mean_d -= (dh + da) / len(attack)
            yield pd.DataFrame(out, columns=names)

    return sent.mapInPandas(kernel, "pool string, contest_id long, home_lambda double, away_lambda double")


def transition_sanity(contests: DataFrame, pool_a: DataFrame, pool_b: DataFrame) -> DataFrame:
    """Both replays' rating differences at each side's first contest of a season."""
    w = W.partitionBy("e", "season").orderBy("d", by_id())
    first = appearances(contests).withColumn("o", F.row_number().over(w)).where("o = 1").select(ID, "e", "season")
    a = pool_a.select(ID, F.col("rating_diff").alias("own_diff"))
    b = pool_b.select(ID, F.col("rating_diff").alias("combined_diff"))
    return first.join(a, ID).join(b, ID)
