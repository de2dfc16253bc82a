"""Streams: state, splits and crashes."""

import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivalry.operators import ratings as RA
from rivalry.streaming import jobs as J

SCHEMA = "pool string, contest_id long, ts timestamp, home long, away long, result int"


def contests(n=240, entities=14, days=30):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        h, a = rng.sample(range(entities), 2)
        rows.append((rng.choice("ab"), i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i * days // n), h, a, rng.randrange(3)))
    return rows


def closing():
    return [(p, None, dt.datetime(2020, 3, 1), None, None, None) for p in "ab"]


def run(spark, path, sink="parquet", fail=None):
    rated = J.stream_ratings(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    if sink == "parquet":
        out = rated.writeStream.format("parquet").option("path", f"{path}/out")
    else:

        def write(batch, batch_id):
            if batch_id == fail:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

        out = rated.writeStream.foreachBatch(write)
    out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def replayed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.to_date("ts")).withColumn("season", F.lit(2020))
    return {r.contest_id: (r.pool, round(r.home_rating, 9), round(r.away_rating, 9)) for r in RA.replay(df, pool="pool").collect()}


def test_ratings_survive_a_crash_and_a_restart(spark, tmp_path):
    rows, path = contests(), str(tmp_path)
    for part in (rows[:80], rows[80:160]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(Exception, match="lost"):
        run(spark, path, "batches", fail=2)
    run(spark, path, "batches")
    for part in (rows[160:], closing()):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark, path, "batches")
    got = spark.read.schema(J.RATED + ", batch int").parquet(f"{path}/out").collect()
    assert Counter(r.contest_id for r in got) == Counter(range(240)) and not any(r.late for r in got)
    assert {r.contest_id: (r.pool, round(r.home_rating, 9), round(r.away_rating, 9)) for r in got} == replayed(spark, rows)
    # what is left is a rating per pool and entity; no contest is open
    held = lambda name: spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", name).load().count()
    assert held("ratings") == len({(r[0], e) for r in rows for e in r[3:5]}) and held("open") == held("sizes") == 0


def test_late_contests_change_nothing(spark, tmp_path):
    rows, path = contests(), str(tmp_path)
    late = [("a", 900, dt.datetime(2020, 1, 2), 1, 2, 2)]
    for part in (rows[:120], [(p, None, dt.datetime(2020, 1, 14), None, None, None) for p in "ab"], late, rows[120:], closing()):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark, path)
    got = spark.read.schema(J.RATED).parquet(f"{path}/out").collect()
    assert [(r.contest_id, r.home_rating) for r in got if r.late] == [(900, None)]
    want = replayed(spark, rows)
    assert {r.contest_id: (r.pool, round(r.home_rating, 9), round(r.away_rating, 9)) for r in got if not r.late} == want


class Map:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, got=None):
        self.calls += 1
        return got

    def getValue(self, key):  # noqa: N802
        return self._call(self.held.get(key))

    def containsKey(self, key):  # noqa: N802
        return self._call(key in self.held)

    def updateValue(self, key, value):  # noqa: N802
        self._call()
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self._call()
        del self.held[key]

    def keys(self):
        return self._call(iter(self.held))


class Handle:
    """A pool's state: maps, one value and timers."""

    def __init__(self):
        self.maps, self.timers, self.value = {}, [], None

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, Map())

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class Time:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("known", [3, 200_000])
def test_state_is_read_once_for_many_dates(spark, monkeypatch, known):
    monkeypatch.setattr(J, "KNOWN", known)
    rows = [("a", *r[1:]) for r in contests(n=600, entities=6, days=60)]
    handle, job = Handle(), J.RatedDays(20.0, 0.0)
    job.init(handle)
    pdf = pd.DataFrame([r[1:] for r in rows] + [(None, dt.datetime(2020, 6, 1), None, None, None)], columns=["contest_id", "at", "home", "away", "result"])
    list(job.handleInputRows(("a",), iter([pdf[:300], pdf[300:]]), None))
    parts = [x for ms in sorted(handle.timers) for x in job.handleExpiredTimer(("a",), Time(J.DAY_MS * 30_000), Time(ms))]
    got = pd.concat(parts)
    assert {r.contest_id: (r.pool, round(r.home_rating, 9), round(r.away_rating, 9)) for r in got.itertuples()} == replayed(spark, rows) and not got["late"].any()
    assert not handle.maps["open"].held and not handle.maps["sizes"].held and handle.value == (max(ms for ms in handle.timers) // J.DAY_MS,)
    if known > 6:  # each of 6 ratings, and each of 60 dates, not each of 600 contests on each date
        assert handle.maps["ratings"].calls <= 18 and handle.maps["open"].calls <= 180


SNAP = "rev int, fixture_key long, d date, status string, score long, rev_rows long"


def snapshots():
    rng, out = random.Random(4), []
    for rev in (1, 2, 3, 4):
        keys = [k for k in range(40) if rng.random() < 0.9]
        out += [(rev, k, dt.date(2020, 1, 1 + (k + rev * (k % 7 == 0)) % 28), "completed" if k < 8 * rev else "scheduled", k % 5 if k < 8 * rev else None, len(keys)) for k in keys]
    return out


@pytest.mark.parametrize(("files", "at_once"), [(1, 1), (5, 1), (9, 2)])
def test_events_are_the_same_however_revisions_are_split(spark, tmp_path, files, at_once):
    rows = snapshots()
    if files > 1:
        random.Random(files).shuffle(rows)
    df = spark.createDataFrame(rows, SNAP)
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SNAP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", at_once).parquet(f"{tmp_path}/in")
    J.stream_snapshot_diff(stream, str(tmp_path), size="rev_rows").trigger(availableNow=True).start().awaitTermination()
    got = Counter((r.rev, r.fixture_key, r.event) for r in J.snapshot_events(spark, str(tmp_path)).collect())
    want = Counter()
    for rev in (1, 2, 3, 4):
        old, new = (df.where(F.col("rev") == r).drop("rev", "rev_rows") for r in (rev - 1, rev))
        want.update((rev, r.fixture_key, r.event) for r in J.snapshot_diff(old, new, "fixture_key").collect())
    assert got == want
