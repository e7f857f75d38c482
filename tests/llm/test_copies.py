import random

from pyspark.sql import functions as F

from tapeline.llm import copies
from tapeline.plans import groups

FIELDS = ["title", "domain", "seendate"]


def brute(rows):
    import unicodedata

    canon = lambda s: "".join(c for c in s.casefold() if not c.isspace() and not unicodedata.category(c).startswith("P"))
    seen, out = {}, set()
    for i, *values in sorted(rows, key=lambda r: r[0]):
        if all(v is not None and v.strip() for v in values):
            k = tuple(map(canon, values))
            if k in seen:
                out.add((seen[k], i))
            else:
                seen[k] = i
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, domain string, seendate string").selectExpr("*", "1 as key", "2 as copies", "'r' as record", "3 as row_id")


def found(df):
    return {tuple(r) for r in copies.find_copies(copies.canonical_records(df, "id", FIELDS)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    titles = ["A b", "a-B!", "ab", "Größe", "GRÖSSE", "  ", None, "", "“a” b", "a\u00a0\u3000b", "x" * 50_000, "…", "-"]
    rows = [(i, rng.choice(titles), rng.choice(["d.com", "D.COM ", None, "dcom", "e"]), rng.choice(["2024", "20 24", "", "2025"])) for i in range(400)]
    assert found(frame(spark, rows)) == brute(rows)


def test_hot_group_and_empty(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", "d", "s") for i in range(9000)]
    df = frame(spark, rows)
    assert found(df) == brute(rows)
    assert not found(df.limit(0))
    counted = copies.count_copies(copies.canonical_records(df, "id", FIELDS))[1]
    assert counted.agg(F.max("copies"), F.sum("copies")).first() == (6000, 9000)


def test_json(spark):
    df = spark.createDataFrame([(1, '{"title":"A","domain":"d","seendate":"s"}'), (2, ' {"seendate" : "s", "domain":"D", "title":"\\u0041"}\n'), (3, "{"), (4, None), (5, '{"title":null,"domain":"d","seendate":"s"}')], "id long, payload string")
    records = copies.canonical_records(copies.json_fields(df, "id", "payload", FIELDS), "row_id", FIELDS)
    assert [tuple(r) for r in copies.find_copies(records).collect()] == [(1, 2)]


def test_collision_is_told_apart(spark, monkeypatch):
    real = F.md5
    monkeypatch.setattr(copies.F, "md5", lambda c: real(F.lit("same")))
    rows = [(1, "a", "d", "s"), (2, "b", "d", "s"), (3, "A", "d", "s")]
    records = copies.canonical_records(frame(spark, rows), "id", FIELDS)
    assert [tuple(r) for r in copies.find_copies(records).collect()] == [(1, 3)]


def test_characters_too(spark):
    """Wide, combining and invisible variants are one record only where asked for."""
    from tapeline.llm import glyphs

    rows = [(1, "Größe Ａ", "d", "s"), (2, "Gro\u0308ße A", "d", "s"), (3, "größe \u200ba", "d", "s"), (4, None, "d", "s")]
    df = frame(spark, rows)
    same = copies.canonical_records(df, "id", FIELDS, glyphs.consistent_form)
    assert {tuple(r) for r in copies.find_copies(same).collect()} == {(1, 2), (1, 3)} and not found(df)


def test_attach(spark):
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 0, id) as k", "id")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = groups.attach(rows, counts, ["k"], "n")
    assert out.count() == 20_000 and out.filter("k = 0 and n = 10000").count() == 10_000
