"""Work that grew faster than its input, and results that only larger tables told apart."""

from datetime import date
from random import Random

import pytest

from rivalry.operators import features as FE
from rivalry.operators import goals as G
from rivalry.operators import link as L
from rivalry.operators import scoring as SC
from rivalry.plans.base import stored, views


def test_aliases_of_a_frequent_name_are_looked_up_once(spark):
    rng, day = Random(3), lambda i: None if i is None else date.fromordinal(729_000 + i)
    bound = lambda: None if rng.random() < 0.2 else rng.randrange(60)
    aliases = [(rng.choice([1, 2, 3, None]), f"n{rng.randrange(12)}", rng.choice("ab"), bound(), bound()) for _ in range(60)]
    rows = [(i // 2 if i < 40 else i, rng.choice([None, *[f"n{k}" for k in range(13)]]), rng.choice("ab"), bound()) for i in range(600)]
    want = {}
    for key, name, source, d in rows:
        hit = want.setdefault(key, set())
        for e, n, s, lo, hi in aliases:
            free = lo is None and hi is None
            if (n, s) == (name, source) and e is not None and (free or (d is not None and (lo is None or lo <= d) and (hi is None or d <= hi))):
                hit.add(e)
    want = {k: (next(iter(x)) if len(x) == 1 else None, ("UNKNOWN", "OK", "AMBIGUOUS")[min(len(x), 2)]) for k, x in want.items()}
    a = spark.createDataFrame([(e, n, s, day(lo), day(hi)) for e, n, s, lo, hi in aliases], "entity_id long, source_name string, source string, valid_from date, valid_to date")
    r = spark.createDataFrame([(k, n, s, day(d)) for k, n, s, d in rows], "k long, source_name string, source string, d date")
    got = L.resolve_alias_asof(r, a, ["k"])
    assert {x.k: (x.entity_id, x.status) for x in got.collect()} == want and len({s for _, s in want.values()}) == 3
    # one name that 3,000 entities hold in turn: 2,000 rows don't meet them all
    many = spark.range(3000).selectExpr("id AS entity_id", "'n' AS source_name", "'a' AS source", "date_add(date'1900-01-01', cast(id AS int)) AS valid_from", "date_add(date'1900-01-01', cast(id AS int)) AS valid_to")
    asked = spark.range(2000).selectExpr("id AS k", "'n' AS source_name", "'a' AS source", "date_add(date'1900-01-01', cast(id AS int)) AS d")
    got = L.resolve_alias_asof(asked, many, ["k"])
    assert got.where("status = 'OK' AND entity_id = k").count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "valid_from" in line]


def test_rating_differences_above_the_last_edge_are_in_the_last_bin(spark):
    rows = spark.createDataFrame([(d, 1, 0.5) for d in (-201, -200, 0, 199, 200, 999)], "diff int, result int, p_home double")
    got = {r.bin: r.n for r in SC.rating_diff_bins(rows, "diff", (-200, 0, 200)).collect()}
    assert got == {None: 1, 0: 1, 1: 4}


def test_windows_of_players_are_no_join(spark):
    day = lambda i: date.fromordinal(730_000 + i)
    contests = [(i, day(i // 2), 2000, 1, 2, 1, 0) for i in range(40)]
    k = spark.createDataFrame(contests, "contest_id long, d date, season int, home long, away long, home_score int, away_score int")
    squads = [(c, d, s, e, 10 * e + j % 3, j < 2, None if (c + j) % 5 == 0 else 10 * c + j) for c, d, s, h, a, *_ in contests for e in (h, a) for j in range(c % 2, 3)]
    got = FE.workload_windows(k, spark.createDataFrame(squads, "contest_id long, d date, season int, e long, player long, starter boolean, minutes int"), (3, 10))
    want = {}
    for c, d, s, h, a, *_ in contests:
        for side, e in (("home", h), ("away", a)):
            before = [x for x in contests if x[1] < d]
            if before:
                last = max(before, key=lambda x: (x[1], str(x[0])))
                for n in (3, 10):
                    own = [(p, st, [m for _, o, *_, p2, _, m in [(x[0], x[1], x[2], x[4], x[5], x[6]) for x in squads if x[3] == e] if p2 == p and m is not None and 0 < (d - o).days <= n]) for q, _, _, e2, p, st, _ in squads if q == last[0] and e2 == e]
                    want[c, side, n] = (sum(sum(m) for *_, m in own), sum(bool(m) for *_, m in own), sum(sum(m) for _, st, m in own if st))
    rows = {(r.contest_id, s, n): tuple(r[f"{s}_{x}_{n}"] for x in ("squad_minutes", "squad_known", "starter_minutes")) for r in got.collect() for s in ("home", "away") for n in (3, 10)}
    assert rows == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "player#" in line]


def test_goal_fits_join_no_cells_by_shuffle(spark, monkeypatch):
    rng, plans = Random(5), []
    rows = [(2000 + i % 3, e, o, float(h), float(rng.randrange(4))) for i in range(120) for e, o in [rng.sample(range(6), 2)] for h in (0, 1)]
    df = spark.createDataFrame(rows, "season int, e long, opp long, at_home double, gf double")

    def store(x, name):
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        return stored(x, name)

    monkeypatch.setattr(G, "ROUNDS", 1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(ValueError, match="convergence"):
            G.poisson_goals(df, [2001, 2002], store)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    blocks = [p for p in plans if "EXP(" in p]
    joins = [line for p in blocks for line in p.splitlines() if "Join [" in line and "opp#" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_contests_are_joined_once_for_a_query(spark):
    v = views(spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (v("contests"), v("contests_strict"), v("appearances"), v("predictions"))]
    assert not [line for p in plans for line in p.splitlines() if "Join" in line or "Window" in line]
    assert v("contests_strict") is v("contests_strict") and v("contests_strict").count() > 0
