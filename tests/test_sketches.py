"""Mergeable sketches and top-k in two steps against their exact forms."""

import random

import pytest
from pyspark.sql import functions as F

from rivalry.operators import coverage as C
from rivalry.operators import scoring as SC
from rivalry.operators import sketches as SK


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(12)
    rows = [(i % 40, i % 4, float(int(rng.paretovariate(1.2) * 1000)) if i % 11 else None) for i in range(60_000)] + [(99, 9, None)]
    return spark.createDataFrame(rows, "day int, season int, x double").repartition(7).persist()


def ranks(values, q):
    return sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)


def test_merged_profiles_keep_their_bounds(values):
    own: dict = {}
    for r in values.collect():
        own.setdefault(r.season, []).append(r.x)
    got = {r.season: r for r in SK.described(SK.merged(SK.profile(values, "x", ["season", "day"]), ["season"]), ["season"]).collect()}
    assert set(got) == set(own)
    for season, xs in own.items():
        r, met = got[season], [x for x in xs if x is not None]
        assert (r.n, r.nulls) == (len(xs), len(xs) - len(met))
        if not met:
            assert r.lo is r.median is r.mean is r.variance is None and r.distinct_values == 0
            continue
        mean = sum(met) / len(met)
        assert (r.lo, r.hi) == (min(met), max(met)) and abs(r.mean - mean) < 1e-6 * mean
        assert abs(r.variance / (sum((x - mean) ** 2 for x in met) / len(met)) - 1) < 1e-9
        lo, hi = ranks(met, r.median)
        assert lo <= 0.5 + SK.RANK_ERROR and hi >= 0.5 - SK.RANK_ERROR
        assert abs(r.distinct_values / len(set(met)) - 1) < 4 * 1.04 / 2 ** (SK.LG / 2)


def test_approximate_distribution(values):
    exact, near = (C.distribution(values, "x", ["season"], approximate=a).where("season < 4").orderBy("season").collect() for a in (False, True))
    for a, b in zip(exact, near, strict=True):
        assert (a.n, a.nulls, a.lo, a.hi, a.mode) == (b.n, b.nulls, b.lo, b.hi, b.mode)
        assert abs(b.distinct_values / a.distinct_values - 1) < 0.04 and abs(b.median / a.median - 1) < 0.1


def scored(spark, n=4000):
    rng = random.Random(3)
    return spark.createDataFrame([(2020 + i % 3, rng.randrange(300), rng.randrange(300), round(rng.expovariate(1), 2)) for i in range(n)], "season int, home long, away long, nll double").repartition(5)


def test_top_cells_in_two_steps(spark):
    df = scored(spark)
    cells = [(r.season, r.e, r.total_nll) for r in SC.entity_cells(df).collect()]
    got = {r.season: r for r in SC.entity_concentration(df, top=7).collect()}
    for season in (2020, 2021, 2022, None):
        own = sorted((t for s, _, t in cells if season in (s, None)), reverse=True)
        assert abs(got[season].top_share - sum(own[:7]) / sum(own)) < 1e-12 and got[season].entities == len(own)
    near = {r.season: r for r in SC.entity_concentration(df, top=7, approximate=True).collect()}
    means = [r.log_loss for r in SC.entity_cells(df).collect()]
    for p, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")):
        lo, hi = ranks(means, near[None][name])
        assert lo <= p + SK.RANK_ERROR and hi >= p - SK.RANK_ERROR
    assert near[None].top_share == got[None].top_share


def test_no_window_over_all_rows(spark, capsys):
    SC.select_candidate(spark.createDataFrame([("a", 1.0, 2, True), ("b", 1.0, 1, True)], "name string, log_loss double, complexity int, passes boolean")).explain()
    assert "Window" not in capsys.readouterr().out
    SC.top_rows(scored(spark).withColumn("g", F.lit(1)), ["g"], ["nll"], ["home", "away"], 3).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") >= 2 and "Exchange SinglePartition" not in plan  # what is ranked at last is bounded
