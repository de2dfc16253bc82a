"""Leakage, batching and edge cases of the contest operators on hand-made frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rivalry.core.asof import forbid
from rivalry.functions import scalar as S
from rivalry.operators import coverage as C
from rivalry.operators import features as FE
from rivalry.operators import link as L
from rivalry.operators import models as M
from rivalry.operators import quality as Q
from rivalry.operators import ratings as RA
from rivalry.operators import scoring as SC
from rivalry.operators import versions as V
from rivalry.streaming import jobs as J

SCHEMA = "contest_id long, d date, season int, home long, away long, competition string, place int, home_score int, away_score int, result int"
DAY = dt.date(2020, 1, 1)


def contest(i, day, home, away, hs, as_, season=2020, place=1, competition="A"):
    return (i, DAY + dt.timedelta(day), season, home, away, competition, place, hs, as_, (hs > as_) - (hs < as_) + 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.contest_id: r.asDict() for r in df.collect()}


def league(seed=1, days=12, entities=6):
    rng, out, i = random.Random(seed), [], 0
    for day in range(days):
        teams = list(range(entities))
        rng.shuffle(teams)
        for k in range(0, entities, 2):
            i += 1
            out.append(contest(i, day, teams[k], teams[k + 1], rng.randrange(4), rng.randrange(4), 2020 + day // 6))
    return out


FEATURES = [
    FE.form_lastn, FE.venue_form, FE.place_form, FE.h2h_lastn, FE.h2h_cumulative, FE.schedule_gap, FE.draw_rates, FE.appearance_ordinal, FE.history_audit,
    lambda k: RA.replay(k),
]


@pytest.mark.parametrize("feature", FEATURES)
def test_future_rows_do_not_change_the_past(spark, feature):
    rows = league()
    past = [r for r in rows if r[1] < DAY + dt.timedelta(8)]
    a, b = by_id(feature(frame(spark, past))), by_id(feature(frame(spark, rows)))
    assert all(b[i] == a[i] for i in a)


@pytest.mark.parametrize("feature", FEATURES)
def test_own_result_and_input_order_do_not_matter(spark, feature):
    rows = league()
    last = rows[-1]
    other = rows[:-1] + [(*last[:7], 9, 0, 2)]
    random.Random(5).shuffle(other)
    a, b = by_id(feature(frame(spark, rows))), by_id(feature(frame(spark, other)))
    assert a == b


def test_contests_of_a_date_do_not_see_each_other(spark):
    rows = [contest(1, 0, 1, 2, 1, 0), contest(9, 5, 1, 3, 2, 0), contest(10, 5, 4, 1, 0, 3), contest(2, 6, 1, 2, 0, 0)]
    got = by_id(FE.form_lastn(frame(spark, rows)))
    assert got[9]["home_points"] == got[10]["away_points"] == 3
    assert got[2]["home_points"] == 9 and got[2]["home_played"] == 3
    rated = by_id(RA.replay(frame(spark, rows)))
    assert rated[9]["home_rating"] == rated[10]["away_rating"]


def test_exactly_n_history(spark):
    rows = [contest(i, i, 1, 2, 1, 0) for i in range(8)]
    got = by_id(FE.form_lastn(frame(spark, rows), 5))
    assert [got[i]["home_played"] for i in range(8)] == [0, 1, 2, 3, 4, 5, 5, 5]
    xg = frame(spark, rows).select("contest_id", "d", "home", "away", F.col("home_score").cast("double").alias("home_xg"), F.lit(0.5).alias("away_xg"), (F.col("contest_id") != 3).alias("eligible"))
    means = by_id(FE.xg_lastn_mean(xg, 5))
    assert means[5]["home_xg_for"] is None and means[6]["home_xg_for"] == 1.0 and means[6]["home_excluded"] == 1


def test_ratings_conserve_points_and_match_a_loop(spark):
    rows = league(3)
    got = by_id(RA.replay(frame(spark, rows), [{"k": 20.0, "home_adv": 50.0}]))
    state = {}
    for r in sorted(rows, key=lambda r: (r[1], str(r[0]))):
        h, a = state.get(r[3], 1500.0), state.get(r[4], 1500.0)
        assert math.isclose(got[r[0]]["home_rating"], h) and math.isclose(got[r[0]]["away_rating"], a)
        step = 20 * (r[9] / 2 - 1 / (1 + 10 ** ((a - h - 50) / 400)))
        state[r[3]], state[r[4]] = h + step, a - step
    final = RA.replay(frame(spark, rows), [{"k": 20.0, "home_adv": 50.0}], final=True).collect()
    assert math.isclose(sum(r.rating for r in final), 1500 * len(final))
    assert all(math.isclose(r.rating, state[r.e]) for r in final)


def test_season_regression_pulls_once_for_each_year(spark):
    rows = [contest(1, 0, 1, 2, 1, 0, 2020), contest(2, 900, 1, 2, 1, 0, 2022)]
    got = by_id(RA.replay(frame(spark, rows), [{"pull": 0.25}]))
    assert math.isclose(got[2]["home_rating"], 1500 + 10 * 0.75**2)


def test_promoted_entities_get_the_offset(spark):
    rows = [
        contest(1, 0, 1, 2, 1, 0, 2020, competition="TOP"), contest(2, 1, 3, 4, 1, 0, 2020, competition="LOW"),
        contest(3, 400, 1, 3, 1, 1, 2021, competition="TOP"), contest(4, 401, 2, 4, 1, 1, 2021, competition="LOW"),
    ]
    k = frame(spark, rows)
    events = RA.season_events(k, "TOP")
    assert {(r.e, r.status, r.move) for r in events.where("season = 2021").collect()} == {(3, "first_time", "promoted"), (2, "", "relegated")}
    got = by_id(RA.replay(k.withColumn("pool", F.lit("all")), [{"offset": True}], pool="pool", events=events))
    assert got[3]["away_rating"] == 1490.0 and got[3]["home_rating"] == 1510.0
    fresh = by_id(RA.replay(k.withColumn("pool", F.lit("all")), [{"reset": "first_time"}], pool="pool", events=events))
    assert fresh[3]["away_rating"] == 1500.0


def test_targets_may_not_carry_outcomes(spark):
    with pytest.raises(ValueError):
        forbid(frame(spark, league()), ["result"])


def test_lineups_and_tenure(spark):
    rows = [(i, DAY + dt.timedelta(i), 1, "home", xi) for i, xi in enumerate([[1, 2, 3], [2, 3, 4], [9]])]
    got = by_id(FE.lineup_overlap(spark.createDataFrame(rows, "contest_id long, d date, e long, side string, xi array<long>")))
    assert [got[i]["home_overlap"] for i in range(3)] == [None, None, 2]
    staff = [(i, DAY + dt.timedelta(i), 1, "home", v) for i, v in enumerate([None, 5, 5, None, 5, 6])]
    out = {r.contest_id: r for r in FE.tenure_streak(spark.createDataFrame(staff, "contest_id long, d date, e long, side string, value long")).collect()}
    assert [out[i].tenure for i in range(6)] == [0, 0, 1, 0, 0, 0]
    assert [out[i].changed for i in range(6)] == [False, False, False, False, False, True]


def test_alias_bounds_are_inclusive(spark):
    aliases = spark.createDataFrame([(1, "X", "s", None, dt.date(2020, 1, 5)), (2, "X", "s", dt.date(2020, 1, 5), None), (3, "Y", "s", None, None)], "entity_id long, source_name string, source string, valid_from date, valid_to date")
    rows = spark.createDataFrame([(i, "s", n, d) for i, (n, d) in enumerate([("X", dt.date(2020, 1, 4)), ("X", dt.date(2020, 1, 5)), ("X", dt.date(2020, 1, 6)), ("X", None), ("Y", None), ("Z", DAY)])], "k int, source string, source_name string, d date")
    got = {r.k: (r.status, r.entity_id) for r in L.resolve_alias_asof(rows, aliases, ["k"]).collect()}
    assert got == {0: ("OK", 1), 1: ("AMBIGUOUS", None), 2: ("OK", 2), 3: ("UNKNOWN", None), 4: ("OK", 3), 5: ("UNKNOWN", None)}


def test_strict_join_fails_on_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "contest_id long, v string")
    assert L.strict_1to1_join(a, a, "contest_id", ["v"]).count() == 2
    with pytest.raises(ValueError):
        L.strict_1to1_join(a, a.limit(1), "contest_id")


def test_minutes_and_points(spark):
    rows = spark.createDataFrame([("45'+2",), ("90+3",), ("67",), ("x",), (None,)], "m string")
    got = [r.p for r in rows.select(S.minute_parts("m").alias("p")).collect()]
    assert [(p.minute, p.half, p.stoppage) for p in got] == [(47, 0, True), (93, 1, True), (67, 1, False), (None, None, None), (None, None, None)]


def test_bins_on_their_edges(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 0.0, 1), (0.1, 0.3, 0.6, 2)], "p_away double, p_draw double, p_home double, result int")
    got = {(r["class"], r.bin) for r in SC.reliability_bins(rows).collect()}
    assert got == {(0, 0), (0, 1), (1, 9), (1, 3), (2, 0), (2, 6)}
    assert C.count_bins(spark.createDataFrame([(4,), (5,), (9,), (10,)], "x int"), "x").count() == 3


def test_snapshot_diff_events(spark):
    s = "fixture_key long, d date, status string, score long"
    old = spark.createDataFrame([(1, DAY, "scheduled", None), (2, DAY, "completed", 1), (3, DAY, "scheduled", None)], s)
    new = spark.createDataFrame([(1, DAY + dt.timedelta(1), "completed", 2), (2, DAY, "completed", 2), (4, DAY, "scheduled", None)], s)
    got = sorted((r.fixture_key, r.event) for r in V.snapshot_diff(old, new).collect())
    assert got == [(1, "COMPLETED"), (1, "RESULT_CANDIDATE"), (1, "SCHEDULE_CHANGED"), (2, "RESULT_CORRECTED"), (3, "MISSING"), (4, "NEW")]
    assert V.snapshot_diff(old, old).count() == 0


def test_snapshot_identities_and_metadata(spark):
    s = "fixture_key long, d date, status string, score long, match_id string, namespace string, note string, fetched int"
    row = lambda k, **x: ({"fixture_key": k, "d": DAY, "status": "scheduled", "score": None, "match_id": "p1", "namespace": "page", "note": None, "fetched": 1} | x)
    frame_of = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], s)
    old = [row(1, match_id=None), row(2), row(3), row(4), row(5), row(6, status="completed", score=1)]
    new = [row(1), row(2, match_id="p2"), row(3, match_id="d3", namespace="site"), row(4, note="moved"), row(5, fetched=2), row(6, score=1), row(7, status="completed", score=3)]
    keys = spark.createDataFrame([(3,), (7,)], "fixture_key long")
    got = V.snapshot_diff(frame_of(old), frame_of(new), ignored=["fetched"], bridged=keys, established=keys.where("fixture_key = 7"), spaces=("page", "site"))
    rows = {(r.fixture_key, r.event): r.changed_fields for r in got.collect()}
    assert set(rows) == {
        (1, "IDENTITY_LINKED"), (2, "IDENTITY_CONFLICT"), (3, "NAMESPACE_TRANSITION"), (4, "METADATA_CHANGED"), (6, "UNCONFIRMED"),
        (7, "NEW"), (7, "BRIDGE_ESTABLISHED"), (7, "RESULT_CANDIDATE"), (7, "COMPLETED"),
    }
    assert rows[3, "NAMESPACE_TRANSITION"] == "match_id,namespace" and rows[4, "METADATA_CHANGED"] == "note"


def test_stream_takes_every_revision_of_a_batch(spark, tmp_path):
    s = "rev int, fixture_key long, d date, status string, score long"
    rows = [(1, 1, DAY, "scheduled", None), (2, 1, DAY, "candidate", 1), (3, 1, DAY, "completed", 1), (3, 2, DAY, "scheduled", None)]
    spark.createDataFrame(rows, s).write.parquet(str(tmp_path / "in"))
    J.stream_snapshot_diff(spark.readStream.schema(s).parquet(str(tmp_path / "in")), str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    got = {(r.rev, r.fixture_key, r.event) for r in J.snapshot_events(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "NEW"), (2, 1, "RESULT_CANDIDATE"), (3, 1, "COMPLETED"), (3, 2, "NEW")}


def test_names_are_compared_by_their_compatibility_forms(spark):
    names = spark.createDataFrame([(1, "Ｇａｍｂａ　 Osaka"), (2, "twin"), (3, "Twin")], "id long, name string")
    asked = spark.createDataFrame([("gamba osaka",), ("TWIN",), (None,)], "name string")
    assert {r.name: r.linked_id for r in L.resolve_unique_name(asked, names).collect()} == {"gamba osaka": 1, "TWIN": None, None: None}


def test_quartiles_are_of_mean_losses(spark):
    rows = spark.createDataFrame([(2020, 1, 2, 1.0), (2020, 1, 3, 2.0), (2021, 1, 2, 4.0)], "season int, home long, away long, nll double")
    got = {r.season: r for r in SC.entity_concentration(rows, top=1).collect()}
    assert got[2020].entities == 3 and got[2020].q2 == 1.5 and got[2020].top_share == 0.5
    assert got[None].entities == 5 and got[None].top_share == 4 / 14 and got[None].q3 == 4.0


def test_empty_tables(spark):
    none = frame(spark, [])
    for feature in FEATURES[:-1]:
        assert feature(none).count() == 0
    assert Q.expect_contests(none).count() == 0
    assert RA.replay(none).count() == 0


def test_calibration_recovers_a_temperature(spark):
    rng, rows = random.Random(2), []
    for _ in range(4000):
        z = [rng.gauss(0, 1) for _ in range(3)]
        true = [math.exp(x) for x in z]
        told = [math.exp(2 * x) for x in z]
        rows.append((*[x / sum(told) for x in told], rng.choices(range(3), true)[0]))
    df = spark.createDataFrame(rows, "p_away double, p_draw double, p_home double, result int")
    tau, _ = M.fit_calibration(df, "C1")
    assert 0.45 < tau < 0.55


def test_logit_matches_its_optimum(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x @ np.array([[0, 0.5, 1.0], [0, -0.5, 0.3]]) + rng.gumbel(size=(400, 3))).argmax(1)
    df = spark.createDataFrame([(int(i), float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))], "contest_id long, a double, b double, result int")
    got = np.array([[r.p_away, r.p_draw, r.p_home] for r in M.Logit(["a", "b"]).fit(df).predict(df).orderBy("contest_id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros((2, 3)), np.zeros(3)
    for _ in range(4000):  # plain gradient steps on the penalised mean loss, C = 1
        p = np.exp(z @ w + b)
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(3)[y]) / len(y)
        w -= 1.0 * (z.T @ g + w / len(y))
        b -= 1.0 * g.sum(0)
    assert np.abs(got - p).max() < 2e-3
