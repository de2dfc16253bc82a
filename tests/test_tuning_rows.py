"""The rows of param_tuning: all place windows in the exchanges of one, equal to a pass for each."""

from pyspark.sql import functions as F

from rivalry.operators import features as FE
from rivalry.plans import rolling as PR
from rivalry.plans.base import views

DATA = "/root/testdata/sf0.001"


def test_place_windows_share_their_exchanges(spark, capsys):
    k = views(spark, DATA)("contests_strict")
    got = FE.place_forms(k, PR.PLACE_WINDOWS)
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2  # of the appearances by place, and of both sides by contest
    for n in PR.PLACE_WINDOWS:
        one = FE.place_form(k, n)
        mine = got.select("contest_id", *[F.col(f"{x}_{n}").alias(x) for x in one.columns[1:]])
        assert not mine.exceptAll(one).count() and not one.exceptAll(mine).count()


def test_rows_have_what_candidates_ask_for(spark):
    v = views(spark, DATA)
    rows = PR.tuning_rows(v)
    assert set(rows.columns) == {"contest_id", "season", "result"} | {x for c in PR.TUNING.values() for x in c.features}
    assert rows.count() == v("contests_strict").count()
