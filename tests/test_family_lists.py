"""Families are compared without joins of their predictions, and tables that are small only as files aren't broadcast."""

import random

from pyspark.sql import functions as F

from rivalry.operators.logits import Candidate, rolling_logits
from rivalry.operators.models import family_metrics
from rivalry.operators.scoring import P, metrics_by_fold_pooled, row_scores
from rivalry.plans.base import UNPACKED, views

DATA = "/root/testdata/sf0.001"


def test_family_metrics_join_nothing(spark, capsys):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, 2000 + i % 4, rng.randrange(3), rng.random(), rng.random(), rng.choice([True, True, False, None])) for i in range(400)], "contest_id long, season int, result int, a double, b double, ok boolean")
    sets, folds = {"base": Candidate(("a",)), "more": Candidate(("a", "b"), flag="ok")}, [2001, 2002, 2003]
    got = family_metrics(rows, sets, "base", folds)
    got.explain()
    assert "Join" not in capsys.readouterr().out
    one = rolling_logits(rows, sets, folds)
    base, more = (one.where(F.col("candidate") == n).select("contest_id", "season", "result", "ok", *P) for n in sets)
    parts = {("", "baseline_all"): base, ("more", "baseline_matched"): base.where("ok"), ("more", "challenger_matched"): more, ("more", "operational"): base.join(more, "contest_id", "left_anti").unionByName(more)}
    for (family, population), part in parts.items():
        keys = (F.col("family") == family) & (F.col("population") == population)
        want = {r.season: tuple(round(x, 9) for x in r[1:]) for r in metrics_by_fold_pooled(row_scores(part)).collect()}
        assert {r.season: tuple(round(x, 9) for x in r[1:]) for r in got.where(keys).drop("family", "population").collect()} == want


def test_files_count_at_the_size_of_their_rows(spark):
    views(spark, DATA)
    path = views(spark, DATA)("contests").inputFiles()
    size = spark.read.parquet(*path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    files = sum(spark.read.format("binaryFile").load(path).select("length").toPandas()["length"])
    assert int(str(size)) >= UNPACKED * files
