"""Structured Streaming forms of the snapshot difference and of the ratings."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rivalry.operators.ratings import START, elo_update
from rivalry.operators.versions import snapshot_diff


def stream_snapshot_diff(snapshots: DataFrame, path: str, key: str = "fixture_key", size: str | None = None, **options):
    """A stream of whole snapshots (rev, key, d, status, score, ..) -> events at path/events, each by the revision before.

    size: the column that holds, on every row, the number of rows of its revision. A revision then may come in any number of files and
    micro-batches: its rows wait at path/pending/rev=<rev>/batch=<id> until all are there and every lower revision that the stream has
    met is complete, or was before. Without size a revision must come within one micro-batch. A micro-batch may complete several
    revisions: they are taken in order. Each is compared with the newest one published before it, kept at path/state/rev=<rev>, of which
    only that folder is read; a revision that isn't newer is held: it changes nothing. Rerunning a batch writes the same folders again,
    so a crash at any point loses and repeats nothing. options go to snapshot_diff.
    """

    def revisions(spark: SparkSession, folder: str) -> list[int]:
        """The rev= folders below path/folder, which are few: one per revision."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[4:]) for n in names if n.startswith("rev=") and (folder != "state" or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/{n}/_SUCCESS"))))

    def publish(spark: SparkSession, rev: int, new: DataFrame) -> None:
        before = max((r for r in revisions(spark, "state") if r < rev), default=None)
        old = spark.read.parquet(f"{path}/state/rev={before}") if before is not None else new.limit(0)
        snapshot_diff(old, new, key, **options).write.mode("overwrite").parquet(f"{path}/events/rev={rev}")
        new.write.mode("overwrite").parquet(f"{path}/state/rev={rev}")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.where("rev IS NOT NULL").persist()
        met = sorted(r.rev for r in batch.select("rev").distinct().collect())  # a row per revision
        ahead = max(revisions(spark, "state"), default=None)
        fresh = [r for r in met if ahead is None or r >= ahead]
        if size is None:
            for rev in fresh:
                publish(spark, rev, batch.where(F.col("rev") == rev).drop("rev"))
        else:
            for rev in fresh:
                batch.where(F.col("rev") == rev).drop("rev").write.mode("overwrite").parquet(f"{path}/pending/rev={rev}/batch={batch_id}")
            done = set(revisions(spark, "state"))
            for rev in revisions(spark, "pending"):
                if rev in done and rev not in fresh:
                    continue
                rows = spark.read.parquet(f"{path}/pending/rev={rev}").drop("batch")
                n, want = rows.agg(F.count("*"), F.max(size)).first()
                if n < want:
                    break
                publish(spark, rev, rows.drop(size))
        batch.unpersist()

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint")


def snapshot_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/events")


RATED = "pool string, contest_id long, d date, home_rating double, away_rating double, late boolean"
#: Map state is kept in RocksDB, beyond a worker's memory.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Contests that a task holds before it writes them by date, and the most of them in a block.
HELD, BLOCK = 500_000, 10_000
#: Ratings that a task holds before it writes them, and rows that it holds before it sends them on.
KNOWN, SENT = 1_000_000, 10_000


class RatedDays(StatefulProcessor):
    """State of a pool: a rating per entity; for each open date the number of its blocks, and these by date and number (contests of
    the date, as arrays); the last date that was applied.

    Each open date has a timer at its end. The first that expires in a micro-batch applies every date that is over, so that an entity's
    rating is read and written once for all of them, and the others find their dates applied. Each entry costs a call to the JVM.
    """

    def __init__(self, k: float, home_adv: float):
        self.k, self.home_adv = k, home_adv

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", "entity long", "rating double")
        self.sizes = handle.getMapState("sizes", "day long", "n long")
        self.open = handle.getMapState("open", "day long, no long", "contest_id array<long>, home array<long>, away array<long>, result array<int>")
        self.done = handle.getValueState("done", "day long")

    def _done(self) -> int | None:
        return self.done.get()[0] if self.done.exists() else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, sizes, held = self._done(), {}, []
        for pdf in rows:
            pdf = pdf[pdf["contest_id"].notna()]
            block = np.stack([pdf["at"].to_numpy("datetime64[D]").astype("int64"), *(pdf[c].to_numpy("int64") for c in ("contest_id", "home", "away", "result"))])
            if done is not None:
                late = block[0] <= done
                yield _frame([(key[0], cid, _date(day), None, None, True) for day, cid in block[:2, late].T.tolist()])
                block = block[:, ~late]
            held.append(block)
            if sum(x.shape[1] for x in held) > HELD:
                self._keep(held, sizes)
        self._keep(held, sizes)
        for day, n in sizes.items():
            self.sizes.updateValue((day,), (n,))

    def _keep(self, held: list[np.ndarray], sizes: dict[int, int]) -> None:
        """A block for each date of the contests in held, which is emptied."""
        if not held:
            return
        rows = np.concatenate(held, axis=1)
        held.clear()
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        days, first = np.unique(rows[0], return_index=True)
        for day, own in zip(days.tolist(), np.split(rows[1:], first[1:], axis=1), strict=False):
            if day not in sizes:
                sizes[day] = self.sizes.getValue((day,))[0] if self.sizes.containsKey((day,)) else 0
                if not sizes[day]:
                    self.handle.registerTimer((day + 1) * DAY_MS - 1)
            for i in range(0, own.shape[1], BLOCK):
                self.open.updateValue((day, sizes[day]), tuple(own[:, i : i + BLOCK].tolist()))
                sizes[day] += 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day, done = (expiredTimerInfo.getExpiryTimeInMs() + 1) // DAY_MS - 1, self._done()
        if done is not None and day <= done:
            return
        now = timerValues.getCurrentWatermarkInMs()
        days = sorted(d for (d,) in list(self.sizes.keys()) if d <= day or (d + 1) * DAY_MS - 1 < now)
        known: dict[int, float] = {}
        out: list[tuple] = []
        for d in days:
            self._apply(key[0], d, known, out)
            if len(known) > KNOWN:
                self._write(known)
            if len(out) > SENT:
                yield _frame(out)
                out = []
        self._write(known)
        self.done.update((days[-1],))
        yield _frame(out)

    def _apply(self, pool: str, day: int, known: dict[int, float], out: list[tuple]) -> None:
        n = self.sizes.getValue((day,))[0]
        rows = sorted((r for i in range(n) for r in zip(*self.open.getValue((day, i)), strict=True)), key=lambda r: str(r[0]))
        now = {}
        for e in {e for r in rows for e in r[1:3]}:
            if e not in known:
                held = self.ratings.getValue((e,))  # None where there is none
                known[e] = held[0] if held else START
            now[e] = known[e]
        for cid, home, away, result in rows:
            r = {"home_rating": now[home], "away_rating": now[away], "k": self.k, "home_adv": self.home_adv, "result": result}
            out.append((pool, cid, _date(day), now[home], now[away], False))
            a, b = elo_update(r, now)
            known[home] += a
            known[away] += b
        for i in range(n):
            self.open.removeKey((day, i))
        self.sizes.removeKey((day,))

    def _write(self, known: dict[int, float]) -> None:
        for e, x in known.items():
            self.ratings.updateValue((e,), (x,))
        known.clear()

    def close(self) -> None:
        pass


def _date(day: int) -> date:
    return date(1970, 1, 1) + timedelta(days=day)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pool", "contest_id", "d", "home_rating", "away_rating", "late"])


def stream_ratings(contests: DataFrame, k: float = 20.0, home_adv: float = 0.0, delay: str = "0 days") -> DataFrame:
    """contests (pool, contest_id, ts, home, away, result) -> ratings before each contest, once the watermark has passed its date.

    State of a pool, in RocksDB (which is set as the session's state store): a rating per entity, the contests of open dates in blocks,
    the last date applied. A batch reads and writes the blocks of its contests and of the dates that end with it only, and the ratings of
    their entities once, however many dates end. A date is applied as a whole; contests of a date that is already applied come out with late = true and null ratings and change
    nothing. A row without contest_id only moves the watermark: sources end with one per pool, later than all contests, so that the last
    date comes out too.
    """
    contests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # rows behind the watermark must arrive too: the processor doesn't get the column that carries it
    rows = contests.withWatermark("ts", delay).withColumn("at", F.col("ts") + F.expr("INTERVAL 0 SECOND")).drop("ts").groupBy("pool")
    return rows.transformWithStateInPandas(RatedDays(k, home_adv), RATED, "Append", "EventTime")
