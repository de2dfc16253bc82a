"""The views that most queries read: one scan and one shuffle of lineitem each, with the rows of their text."""

import pytest

from rivalry.plans import base

SF = "/root/testdata/sf0.01"


@pytest.fixture
def by_text(spark):
    def view(name):
        if name not in base.VIEWS:
            return spark.read.parquet(f"{SF}/{name}.parquet")
        return spark.sql(base.VIEWS[name], **{n: view(n) for n in base._parts(base.VIEWS[name])})

    return view


@pytest.mark.parametrize("name", ["contests", "contest_events"])
def test_rows_are_those_of_the_text(spark, by_text, name):
    got, want = base.view(spark, SF, name), by_text(name)
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_contests_scan_lineitem_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(base, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    base.view(spark, SF, "contests")
    assert len(plans) == 1 and plans[0].count("Relation [l_orderkey") == 1


@pytest.mark.parametrize(("key", "spread"), [("scoped_exact_link", 3), ("participation_intervals", 1)])
def test_squads_are_made_after_the_shuffle(spark, key, spread):
    """Appearances are shuffled, not the thirteen players of each: what is shuffled further by name is aggregated already."""
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_COL" in x for x in shuffles) == spread and sum("player#" in x for x in shuffles) <= 1
