"""A pool's task sorts packed blocks of dates, not contests; blocks keep every row, whatever is missing in it."""

from datetime import date, timedelta
from random import Random

from rivalry.operators import ratings as RA


def test_blocks_rate_as_rows_do(spark):
    rng = Random(5)
    rows = []
    for i in range(3000):
        d = date(2000, 1, 1) + timedelta(days=rng.randrange(900))
        home, away = rng.sample(range(30), 2)
        maybe = lambda x: None if rng.random() < 0.3 else x
        rows.append((i, d, d.year, home, away, rng.choice("ab"), maybe(rng.randrange(3)), maybe(30.0), maybe(1400.0), maybe(1600.0)))
    k = spark.createDataFrame(rows, "contest_id long, d date, season int, home long, away long, competition string, result int, k_row double, prior_home double, prior_away double")
    m = k.selectExpr("competition", "season", "explode(array(home, away)) AS e").distinct().where("competition = 'a' OR e % 3 = 0")
    events = RA.membership_events(m, "a")
    configs = [{"config": "x"}, {"config": "y", "k": 10.0, "pull": 0.2, "reset": "returning", "offset": True}]
    plain = lambda row, state: RA.elo_update(row, state)
    got = RA.replay(k, configs, events=events)
    key = lambda df: {(r.pool, r.config, r.contest_id): (r.home_rating, r.away_rating) for r in df.collect()}
    a, b = key(got), key(RA.replay(k, configs, update=plain, events=events))
    assert a.keys() == b.keys() and len(a) == 6000
    assert all(abs(x - y) < 1e-6 for i in a for x, y in zip(a[i], b[i], strict=True))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Exchange hashpartitioning(pool#" in x and "season" not in x)
    assert any("MapInArrow" in x and "data#" in x for x in plan[at:])


def test_rating_variants_are_shuffled_before_they_are_aggregated(spark):
    from rivalry.plans import rolling
    from rivalry.plans.base import views

    plan = rolling.variants(views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString().splitlines()
    replayed = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    above = [x for x in plan[:replayed] if "Aggregate" in x or "REPARTITION_BY_COL" in x]
    assert "REPARTITION_BY_COL" in above[-1]
