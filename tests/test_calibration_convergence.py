import numpy as np

from rivalry.operators import models as M


def loss(log, y, theta):
    z = theta[0] * log + np.array([0.0, theta[1], theta[2]])
    return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]).sum()


def test_calibrators_of_nearly_equal_forecasts_converge(spark):
    """Plain Newton steps run away here: the best temperature is large."""
    rng = np.random.default_rng(0)
    n = 20000
    for s in (1e-2, 1e-3, 1e-4, 1e-5):
        x, y = rng.normal(size=n), rng.choice(3, n, p=[0.4, 0.2, 0.4])
        log = np.log([0.4, 0.2, 0.4]) + s * np.outer(x, rng.normal(size=3))
        log -= np.log(np.exp(log).sum(1, keepdims=True))
    rows = spark.createDataFrame([(2001, int(k), *map(float, p)) for k, p in zip(y, np.exp(log), strict=True)], "season int, result int, p_away double, p_draw double, p_home double")
    fits = M.fit_calibrations(rows, [2002])
    assert set(fits) == {(k, 2002) for k in M.KINDS}
    for (kind, _), theta in fits.items():
        assert theta[0] >= 0 and np.isfinite(theta).all()
        at = loss(log, y, np.array(theta))
        for i in [{"tau": 0, "b1": 1, "b2": 2}[x] for x in M.KINDS[kind]]:
            for by in (-1e-2, 1e-2):
                near = np.array(theta)
                near[i] = max(0.0, near[i] + by) if i == 0 else near[i] + by
                assert loss(log, y, near) >= at - 1e-8


def test_sums_of_all_kinds_and_folds_are_one_pass_over_arrays():
    """A row isn't copied for each fold: the sums of a batch are those of the rows before each fold."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    log = np.log(rng.dirichlet([3, 2, 3], 300))
    season, y = 2000 + np.arange(300) % 4, rng.integers(0, 3, 300)
    batch = pa.RecordBatch.from_arrays([pa.array(season, pa.int32()), pa.array(y, pa.int32()), pa.array(list(log))], ["season", "result", "logs"])
    models = [(i, k, f, np.array([0.8, 0.1, -0.2])) for i, (k, f) in enumerate((k, f) for k in M.KINDS for f in (2000, 2001, 2003))]
    (got,) = M._calibration_sums(models, [batch.slice(0, 100), batch.slice(100)])
    got = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    assert set(got) == {i for i, _, f, _ in models if f > 2000}
    for i, kind, fold, theta in models:
        if i in got:
            past, mine, step = season < fold, [{"tau": 0, "b1": 1, "b2": 2}[x] for x in M.KINDS[kind]], 1e-4 * np.eye(3)
            at = lambda t: loss(log[past], y[past], t)  # noqa: B023, E731
            g = [(at(theta + step[j]) - at(theta - step[j])) / 2e-4 for j in mine]
            h = [(at(theta + step[a] + step[b]) - at(theta + step[a] - step[b]) - at(theta - step[a] + step[b]) + at(theta - step[a] - step[b])) / 4e-8 for a in mine for b in mine]
            assert np.allclose(got[i], [at(theta), *g, *h], atol=1e-3)
