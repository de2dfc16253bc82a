"""Registered queries do their whole job: nothing is sampled or left out."""

from collections import defaultdict

import pytest

from rivalry.plans import models as PM
from rivalry.plans import rolling as PR
from rivalry.plans.base import view

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return lambda name: view(spark, DATA, name)


def test_boundary_events_come_from_all_contests(v):
    played, tops = defaultdict(set), defaultdict(set)
    for r in v("appearances").select("season", "e").distinct().collect():
        played[r.season].add(r.e)
        if (r.e + r.season) % 3 == 0:
            tops[r.season].add(r.e)
    want = defaultdict(dict)
    for s in range(min(played), max(played) + 2):
        for e in tops[s - 1] - tops[s]:
            want[s][e] = ("", "relegated")
        for e in tops[s] - tops[s - 1]:
            first = not any(e in tops[y] for y in range(min(played), s))
            up = e in played[s - 1] - tops[s - 1]
            want[s][e] = ("first_time" if first else "returning", "promoted" if up else "")
    got = defaultdict(dict)
    for r in PM.moves(v).collect():
        got[r.season][r.e] = (r.status, r.move)
    assert got == {s: x for s, x in want.items() if x}


SEASONS = set(range(1996, 2002))


@pytest.mark.parametrize("key", ["logit_multinomial", "poisson_goals_elo", "score_batch"])
def test_every_season_with_an_earlier_one_is_scored(v, key):
    got = PR.R.queries[key](v("contests").sparkSession, DATA).select("contest_id").distinct()
    assert {r.season for r in got.join(v("contests"), "contest_id").select("season").distinct().collect()} == SEASONS


def test_elo_grid_has_the_reference_candidates(spark):
    got = {r.config for r in PR.R.queries["elo_grid"](spark, DATA).select("config").distinct().collect()}
    assert got == {f"k{k}a{a}" for k in (10, 15, 20, 30, 40) for a in range(0, 201, 25)}
