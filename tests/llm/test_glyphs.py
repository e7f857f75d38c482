import pytest

from tapeline.llm import glyphs


#: Titles in scripts that share no letter shape with Latin, or stand for themselves.
OTHER = ["中文标题 市场", "日本語のタイトル", "한국어 제목", "عنوان السوق", "כותרת השוק", "ชื่อเรื่อง", "हिन्दी शीर्षक", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "தமிழ்", "ქართული", "አማርኛ", "עברית и English и 中文"]


def test_tables():
    known = glyphs.looks()
    assert {"а": "a", "О": "O", "ο": "o", "Α": "A", "օ": "o", "ꓮ": "A", "Ⲟ": "O", "ı": "i", "ɡ": "g"}.items() <= known.latin.items()
    assert all(x.isascii() and x.isalpha() and (c.isupper() == x.isupper() or not c.isupper() and not c.islower()) for c, x in known.latin.items())
    assert not set("жщяЖ0Il中ا") & set(known.latin)
    with pytest.raises(FileNotFoundError):
        glyphs.read_confusables("/nowhere.jar")


@pytest.mark.parametrize("title", OTHER)
def test_other_scripts_stay(title):
    assert glyphs.match_key(title) == glyphs.normal_form(title) == title and glyphs.mixed_tokens(title)[1] == 0


def test_other_scripts_in_spark(spark):
    from tapeline.llm import language

    df = spark.createDataFrame([*enumerate(OTHER), (50, "市\u200b场"), (51, "市场"), (52, "市場")], "headline_id long, title string")
    assert [r[0] for r in df.select(glyphs.consistent_form(df.title)).collect()][: len(OTHER)] == OTHER
    assert [tuple(r) for r in glyphs.lookalike_pairs(df, "headline_id", "title").collect()] == [(50, 51)]
    assert [language.tokens_of(t)[:1] for t in ("中文标题 市场", "РАСТЁТ рынок")] == [["中文标题"], ["растёт"]]


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("①", "1"), ("™", "TM"), ("№5", "No5"), ("½", "1/2"), ("ſet", "set"), ("ﾊ", "ハ゛")])
def test_other_in_print(a, b):
    assert glyphs.match_key(a) != glyphs.match_key(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("bаsket fоr", "basket for"), ("ｐｏｉｎｔ\u3000ｔｏ", "point to"), ("th\u200de\u2060 Da\u00adte\ufeff", "the Date"), ("é", "e\u0301"), ("a\u00a0b\u2007c\u202fd", "a b c d"),
        ("Νasdaq Ηοke", "Nasdaq Hoke"), ("Doԝ Niӏi", "Dow Nili"), ("ﬁrst oﬀ", "first off"), ("Вlümen", "Blu\u0308men"), ("Рынoк", "Рынок"), ("օne", "one"), ("ё", "ë"), ("\tx", " x"),
        ("ꓮBC", "ABC"), ("ⲞPEC", "OPEC"), ("ｶ", "カ"), ("Ⅳ", "IV"), ("𝐁𝐮𝐲", "Buy"), ("ĳ", "ij"), ("Åre", "Åre"),
    ],
)
def test_same_look(a, b):
    assert glyphs.match_key(a) == glyphs.match_key(b)


@pytest.mark.parametrize(("a", "b"), [("a  b", "a b"), ("A", "a"), ("a-b", "a–b"), ("cafe", "café"), ("a.", "a"), ("1", "l"), ("ж", "x"), ("", " ")])
def test_other_look(a, b):
    assert glyphs.match_key(a) != glyphs.match_key(b)


def test_normal_form_takes_the_script_of_the_line():
    assert glyphs.normal_form("По мнению, сo сна") == "По мнению, со сна"
    assert glyphs.normal_form("the сосоа price") == "the cocoa price"
    assert glyphs.mixed_tokens("the сосоа pricе") == (1, 1)
    assert glyphs.normal_form("") == "" and glyphs.normal_form("x" * 100_000) == "x" * 100_000


def brute(rows):
    rows = [(i, t) for i, t in rows if t is not None]
    return {(a, b) for a, s in rows for b, t in rows if a < b and s != t and glyphs.match_key(s) == glyphs.match_key(t)}


def test_pairs(spark):
    texts = ["Dow", "Doԝ", "Dow", "Do\u200bw", "dow", None, "", " ", "\u00a0", "Dо w", "x", "x", "ｘ", "х"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "headline_id long, title string").selectExpr("*", "1 as look", "2 as id", "3 as n", "'t' as text")
    assert {tuple(r) for r in glyphs.lookalike_pairs(df, "headline_id", "title").collect()} == brute(rows)
    assert glyphs.lookalike_pairs(df.limit(0), "headline_id", "title").count() == 0
    forms = {r[0]: r[1] for r in df.select("headline_id", glyphs.consistent_form(df.title)).collect()}
    assert forms[1] == forms[3] == "Dow" and forms[5] is None and forms[6] == ""
    report = glyphs.confusable_report(df, "title").first()
    assert report.texts == 13 and report.changed == 6
    groups = {(r.group_id, r.id, r.spelling, r.rows) for r in glyphs.lookalike_groups(df, "headline_id", "title").collect()}
    assert {g for g in groups if g[0] == 0} == {(0, 0, 0, 4), (0, 1, 1, 4), (0, 2, 0, 4), (0, 3, 3, 4)}


def test_hot_group(spark, monkeypatch):
    """A look that holds most rows in two spellings is dealt out in parts, and no pair is lost or doubled."""
    monkeypatch.setattr(glyphs, "SPLIT", 50)
    rows = [(i, "Dow up" if i % 7 else "Dоw up") for i in range(400)] + [(1000 + i, f"title {i}") for i in range(100)]
    got = [tuple(r) for r in glyphs.lookalike_pairs(spark.createDataFrame(rows, "headline_id long, title string"), "headline_id", "title").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows[:400])
