import random

import pytest

from tapeline.llm import consensus

SCHEMA = "label_id long, id string, annotator string, criticism_label string, category_label string, intensity_score string"


def crowd(seed=1, items=60):
    rng = random.Random(seed)
    skill = {"a": 0.95, "b": 0.92, "c": 0.9, "d": 0.93, "coin": 0.5, "liar": 0.08}
    truth = {f"i{k}": k % 2 for k in range(items)}
    kind = {i: consensus.CATEGORIES[n % 5] for n, i in enumerate(truth)}
    rows, n = [], 0
    for i, y in truth.items():
        for who, p in skill.items():
            n += 1
            said = y if rng.random() < p else 1 - y
            rows.append((n, i, who, rng.choice(["{}", " {} "]).format(said), kind[i].upper().replace("_", " ") if said else None, "2" if said else None))
    return rows, truth, kind


def test_recovers_the_truth(spark):
    rows, truth, kind = crowd()
    rows += [(9000 + i, r[1], r[2], str(1 - int(r[3].strip())), None, None) for i, r in enumerate(rows[:30])]  # later repeats don't count
    rows += [(9500, None, "a", "1", None, None), (9501, "i0", None, "1", None, None), (9502, "odd", "a", "maybe", None, None), (9503, "only", "a", "1", "no such", "9")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as item", "2 as said", "3 as truth", "'t' as cls")
    items, usable = consensus.consensus(df)
    got = {r.item: r for r in items.collect()}
    assert sum(got[i].truth == y for i, y in truth.items()) >= 58 and "odd" not in got
    assert all(got[i].category == kind[i] for i, y in truth.items() if y and got[i].truth)
    assert got["only"].category is None
    who = {r.annotator: r for r in consensus.reliability(usable, items).collect()}
    assert {a for a, r in who.items() if r.unreliable} == {"coin", "liar"}
    rows = consensus.answers(items, consensus.reliability(usable, items)).collect()
    assert {r.subject_key for r in rows if r.subject == "annotator"} == {"coin", "liar"}
    assert all(got[r.subject_key].yes and got[r.subject_key].no for r in rows if r.subject == "item")
    scores = {r.item: r.intensity for r in consensus.intensity(usable, items, consensus.reliability(usable, items)).collect()}
    assert set(scores.values()) == {2.0}


def test_agreement(spark):
    rows = [(1, "x", "a", "1", "valuation", "1"), (2, "x", "b", "1", "valuation", "1.0"), (3, "y", "a", "0", None, None), (4, "y", "b", "0", None, None), (5, "z", "a", "1", None, None)]
    _, usable = consensus.consensus(spark.createDataFrame(rows, SCHEMA))
    got = {r.field: r for r in consensus.agreement(usable).collect()}
    assert got["criticism_label"].observed == 1 and got["criticism_label"].alpha == pytest.approx(1) and got["criticism_label"].pairs == 2
    assert got["category_label"].alpha is None
    # a row without a usable criticism label still counts for its category
    both = consensus.agreement(consensus.label_rows(spark.createDataFrame([(1, "x", "a", None, "valuation", " 1,0"), (2, "x", "b", "?", "concentration", "1")], SCHEMA)))
    assert {r.field: (r.pairs, r.observed) for r in both.collect()} == {"category_label": (1, 0.0), "intensity_score": (1, 1.0)}


def test_empty(spark):
    items, usable = consensus.consensus(spark.createDataFrame([], SCHEMA))
    assert items.count() == 0 and consensus.answers(items, consensus.reliability(usable, items)).count() == 0


def test_rounds_agree_with_joins_and_never_stop_silently(spark, monkeypatch):
    rows, _, _ = crowd(3, 40)
    edges = spark.createDataFrame([(c, r[1], r[2], int(r[3].strip()) if c == "x" else 1 - int(r[3].strip())) for c in "xy" for r in rows], "cls string, item string, annotator string, said int")
    key = lambda df: {(r.cls, r.item): r.log_odds for r in df.collect()}
    passed, joined = key(consensus.pass_messages(edges)), key(consensus.pass_by_joins(edges))
    assert passed.keys() == joined.keys() and all(abs(v - joined[k]) < 0.05 for k, v in passed.items())
    for way in (consensus.pass_messages, consensus.pass_by_joins):
        with pytest.raises(consensus.NotConverged):
            way(edges, rounds=2)
    monkeypatch.setattr(consensus, "FEW", 2)  # too many annotators to send around
    assert key(consensus.pass_messages(edges)) == pytest.approx(joined)


def test_scores_are_read_by_one_rule(spark):
    df = spark.createDataFrame([(" 1,5 ",), ("2",), ("x",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(consensus.intensity_value(df.s)).collect()] == [1.5, 2.0, None, None, None]
