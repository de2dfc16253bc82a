from pyspark.sql import functions as F

from rivalry.operators import logits as LO


def test_predictions_are_vectorised_and_keep_flags_and_columns(spark):
    rows = spark.createDataFrame(
        [(i, 2000 + i % 3, i // 3 % 3, float(i % 7), None if i % 5 == 0 else float(i % 4), i % 5 != 0) for i in range(300)], "id long, season int, result int, a double, b double, ok boolean"
    )
    candidates = {"one": LO.Candidate(("a",)), "two": LO.Candidate(("b", "a"), flag="ok")}
    fits = LO.fit_logits(rows, candidates, [2002, 2003])
    got = LO.predict_logits(rows, candidates, fits)
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("zipwith", "zip_with")
    seen = got.collect()
    assert got.columns == [*rows.columns, "candidate", "p_away", "p_draw", "p_home"]
    assert {(r.id, r.candidate) for r in seen} == {(i, c) for i in range(300) if i % 3 == 2 for c in candidates if c == "one" or i % 5}
    for r in seen:
        f, x = fits[r.candidate, r.season], {"a": r.a, "b": r.b}
        z = [0.0, *[float(w @ [x[c] for c in f.features] + b) for w, b in zip(f.weights, f.intercepts, strict=True)]]
        e = [2.718281828459045**v for v in z]
        assert max(abs(p - v / sum(e)) for p, v in zip((r.p_away, r.p_draw, r.p_home), e, strict=True)) < 1e-12
    assert LO.predict_logits(rows.where(F.lit(False)), candidates, fits).count() == 0
