import numpy as np
import pytest

from tapeline.checks import CheckError
from tapeline.plans import events, regress, report

Z = "z"


def panel(spark, z, f):
    rows = [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(z, f))]
    return spark.createDataFrame(rows, "date string, z double, spy_fwd_log_return_1d double")


def test_quantile_keeps_ties(spark):
    rows = events.positions(panel(spark, [*range(1, 11), None], [0] * 11), Z)
    assert [r.position for r in events.event_days(rows).collect()] == [9]
    assert events.event_days(events.positions(panel(spark, [1.0] * 5, [0] * 5), Z)).count() == 5


def test_event_study(spark):
    z = [0.0] * 40
    z[5] = z[15] = 10
    summary, complete, dropped = events.checked_event_study(panel(spark, [x if x else float(i) / 1000 for i, x in enumerate(z)], [0.01] * 40), Z)
    assert complete == 1 and dropped >= 1
    path = {r[0]: r[1] for r in summary.collect()}
    assert (path[-10], path[0], path[21]) == (pytest.approx(-0.1), 0, pytest.approx(0.21)) and len(path) == 32
    holes = [0.01] * 40
    holes[20] = None
    with pytest.raises(CheckError, match="complete"):
        events.checked_event_study(panel(spark, [x if x else float(i) / 1000 for i, x in enumerate(z)], holes), Z)
    with pytest.raises(CheckError, match="non-missing"):
        events.checked_event_study(panel(spark, [None] * 40, [0.01] * 40), Z)
    with pytest.raises(CheckError):
        events.event_paths(events.positions(panel(spark, z, holes), Z), (0, 3))


def hac(x, y, lags):
    x = np.column_stack([np.ones(len(x)), x])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    u = (y - x @ beta)[:, None] * x
    s = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(bread @ s @ bread))


def regression_panel(spark, n=90, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 0.3 + x @ [1.5, -2] + rng.normal(size=n)
    rows = [(f"d{i:04d}", float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "date string, y double, a double, b double"), x, y


@pytest.mark.parametrize("lags", [0, 4, 20])
def test_hac_against_dense_algebra(spark, lags):
    df, x, y = regression_panel(spark)
    f = regress.fit(df, "y", ["a", "b"], lags)
    beta, error = hac(x, y, lags)
    assert f["coefficient"] == pytest.approx(beta) and f["std_error"] == pytest.approx(error) and f["n"] == 90


def test_designs(spark):
    df, *_ = regression_panel(spark, 20)
    with pytest.raises(CheckError, match="rank 2"):
        regress.fit(df.withColumn("c", df.a * 1.0), "y", ["a", "c"], 0)
    with pytest.raises(CheckError, match="underidentified"):
        regress.fit(df.limit(3), "y", ["a", "b"], 0)
    with pytest.raises(CheckError, match="no complete"):
        regress.fit(df.selectExpr("date", "y", "double('nan') as a"), "y", ["a"], 0)
    with pytest.raises(CheckError, match="lacks"):
        regress.fit(df, "y", ["nope"], 0)
    assert [m[0] for m in regress.model_specs(5, Z)] == ["return", "future_volatility", "future_drawdown"]
    assert len(regress.model_specs(5, Z)[1][2]) == 3


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, "const", 0.123456789, float("nan"), None, 5, 0)], "model string, horizon int, term string, coefficient double, std_error double, p_value double, n long, maxlags int")
    assert report.markdown_table(df).splitlines()[2] == "| m | 1 | const | 0.123457 |  |  | 5 | 0 |"
    report.write_markdown(df, str(tmp_path / "x" / "t.md"))
    assert report.WARNING in (tmp_path / "x" / "t.md").read_text()


def test_lags_longer_than_the_data(spark):
    """Fewer complete rows than lags: the lags that there are count."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=6), rng.normal(size=6)
    df = spark.createDataFrame([(f"2024-01-0{i + 1}", float(y[i]), float(x[i])) for i in range(6)], "date string, y double, a double")
    f = regress.fit(df, "y", ["a"], 20)
    design = np.column_stack([np.ones(6), x])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    u = design * (y - design @ beta)[:, None]
    meat = u.T @ u + sum((1 - k / 21) * (u[k:].T @ u[: 6 - k] + u[: 6 - k].T @ u[k:]) for k in range(1, 6))
    assert f["coefficient"] == pytest.approx(beta) and f["std_error"] == pytest.approx(np.sqrt(np.diag(bread @ meat @ bread)))
