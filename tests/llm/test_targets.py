import numpy as np
import pytest

from tapeline.llm import targets


def test_tilt_meets_margins():
    cells = np.array([[a, b] for a in (0, 1) for b in (0, 1)], float)
    counts = np.array([10.0, 20, 30, 40])
    lam = targets.tilt(cells, counts, np.array([12.0, 9.0]), base=0.2)
    weight = counts * 0.2 * np.exp(cells @ lam)
    assert cells.T @ weight == pytest.approx([12, 9])


def test_pivotal_keeps_the_size_and_the_probabilities():
    rng = np.random.default_rng(1)
    pi = np.array([0.2, 0.5, 0.3, 0.9, 0.1, 1.0, 0.0, 0.6, 0.4])
    hits = np.zeros(len(pi))
    for _ in range(8000):
        taken, carry, left = targets.pivotal(pi, rng.random(len(pi)))
        assert taken.sum() + (left if carry >= 0 else 0) == pytest.approx(pi.sum())
        hits += taken
    assert hits / 8000 == pytest.approx(pi, abs=0.03)
    assert targets.pivotal(np.zeros(0), np.zeros(0))[0].size == 0


def pool_of(spark, rows):
    return spark.createDataFrame(rows, "pool_id long, sample_stratum string, query_type string").selectExpr("*", "1 as unit", "'c' as cat_0", "2 as block", "3 as available")


SCHEMA = "target_set string, sample_stratum string, query_type string, target_pct int, draw_pct int, min_rows int"


def test_gaps_and_sample(spark, monkeypatch):
    monkeypatch.setattr(targets, "BLOCK", 100)
    rows = [(i, "General_Market " if i % 2 else "general-market", "q") for i in range(900)] + [(i, "rare", " Q") for i in range(900, 910)] + [(5, "general market", "q"), (None, "rare", "q"), (911, None, None), (912, "", "q"), (913, "general market", "q")]
    want = [("w", "general_market", "q", 60, 50, 1), ("w", "rare", "q", 40, 50, 1), ("v", "rare", "q", 1, 10, 3), ("v", "none", "q", 0, 10, 2), ("u", "rare", "q", 0, 10, 10)]
    units, plan = targets.allocate(pool_of(spark, rows), spark.createDataFrame(want, SCHEMA))
    got = {tuple(r) for r in targets.gaps(spark, plan).collect()}
    assert got == {("w", "rare", "q"), ("v", "none", "q")}
    assert dict(zip(zip(plan.target_set, plan.sample_stratum), plan.needed))["w", "general_market"] == 274  # of 913 units: ceil(60 % of 456)
    drawn = targets.draw(units, plan).toPandas()
    assert drawn.groupby(["target_set", "sample_stratum"]).size().to_dict() == {("w", "general_market"): 446, ("w", "rare"): 10, ("v", "rare"): 3, ("u", "rare"): 10}
    assert not drawn.duplicated().any() and drawn.columns.tolist() == ["target_set", "sample_stratum", "query_type", "unit"]


def test_free_categories_keep_their_proportions():
    share, have, floor = np.array([40.0, 30, 20, 9, 1, 0]), np.array([50.0, 900, 900, 900, 900, 0]), np.array([0.0, 0, 0, 0, 20, 5])
    strata, kinds = np.array(["a", "a", "b", "b", "c", "c"]), np.array(["x", "y", "x", "y", "x", "y"])
    m, held = targets.calibrate(share, have, floor, 400.0, [strata, kinds])
    assert held.tolist() == ["all taken", "free", "free", "free", "floor", "all taken"]
    assert m == pytest.approx([50, 330 * 30 / 59, 330 * 20 / 59, 330 * 9 / 59, 20, 0])
    # more than there is: all is taken; minima above the size: the minima
    assert targets.calibrate(share, have, floor, 1e6, [strata, kinds])[0] == pytest.approx(have)
    assert targets.calibrate(share, have, np.full(6, 100.0), 10.0, [strata, kinds])[0] == pytest.approx([50, 100, 100, 100, 100, 0])


def test_shares(spark, monkeypatch):
    """Drawn numbers are the planned ones rounded up or down, and make the whole size."""
    monkeypatch.setattr(targets, "BLOCK", 60)
    rows = [(i, "abc"[i % 7 % 3], "xy"[i % 2]) for i in range(1000)]
    want = [("w", s, q, p, 37, 11) for s, q, p in (("a", "x", 31), ("a", "y", 23), ("b", "x", 17), ("b", "y", 13), ("c", "x", 11), ("c", "y", 5))]
    units, plan = targets.allocate(pool_of(spark, rows), spark.createDataFrame(want, SCHEMA))
    got = targets.shares(units, plan).toPandas()
    assert got.drawn.sum() == 370 and (abs(got.drawn - got.planned) < 1).all() and set(got.held) == {"free"}
    assert (abs(got.actual_pct - got.target_pct) < 100 / 370).all()


def test_empty_pool(spark):
    units, plan = targets.allocate(pool_of(spark, [(1, "a", "b")]).limit(0), spark.createDataFrame([("w", "a", "b", 50, 10, 1), ("w", "z", "b", 50, 10, 0)], SCHEMA))
    assert [tuple(r) for r in targets.gaps(spark, plan).collect()] == [("w", "a", "b")]
    assert targets.draw(units, plan).count() == 0
    assert len(targets.allocate(pool_of(spark, [(1, "a", "b")]), spark.createDataFrame([], SCHEMA))[1]) == 0
