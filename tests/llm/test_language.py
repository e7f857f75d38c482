import numpy as np
import pytest

from tapeline.llm import language

DATA = {
    "en": ["the market looks expensive", "buyers should be careful with the rally", "investors warn the index looks fragile", "why traders think the shares will fall"],
    "es": ["los inversores temen una corrección", "el mercado está muy caro", "las acciones suben otra vez", "por qué los expertos dudan del índice"],
    "de": ["die anleger warnen vor einer blase", "der markt ist zu teuer", "warum die aktien fallen werden", "nach den zahlen wächst die angst"],
    "fr": ["les analystes craignent une correction", "le marché est trop cher", "pourquoi la hausse ne va pas durer", "les investisseurs restent prudents"],
    "pt": ["os investidores temem uma correção", "o mercado está muito caro", "as ações sobem de novo", "por que a alta não vai durar muito"],
    "it": ["gli investitori temono una correzione", "il mercato è troppo caro", "le azioni salgono ancora", "perché il rialzo non durerà a lungo"],
    "ru": ["инвесторы боятся коррекции", "рынок слишком дорогой", "акции снова растут", "почему подъём скоро закончится"],
}


@pytest.fixture(scope="module")
def model():
    texts = [(c, f"{t} {n}") for c, ts in DATA.items() for t in ts for n in ("Bavo Keri", "Tulo Mase", "Reni Gado", "Sopa Vike", "Dilo Hafe")]
    return language.fit([language.tokens_of(t) for _, t in texts], np.array([language.LANGUAGES.index(c) for c, _ in texts]))


def test_codewords():
    code = language.codewords()
    assert code.shape == (7, 15)
    assert min((code[a] != code[b]).sum() for a in range(7) for b in range(a)) >= 7


def test_single_and_mixed(model):
    for c, texts in DATA.items():
        for t in texts:
            assert [p[0] for p in language.decode(model, [t.upper()])[0]] == [c]
    cyrillic = "the mаrket lооks ехpensive"  # with Cyrillic letters
    assert [p[0] for p in language.decode(model, [cyrillic])[0]] == ["en"]
    both = language.decode(model, ["the market looks expensive to buyers / die anleger warnen vor einer blase"])[0]
    assert [p[0] for p in both] == ["en", "de"] and both[0][3] == both[1][2] and all(0 < p[1] <= 1 for p in both)
    assert language.decode(model, [None, "", "  ", "123 %", "..."]) == [[]] * 5
    assert len(language.decode(model, ["the market looks expensive " * 3000])[0]) == 1
    assert language.decode(model, []) == []


def test_more_than_one_cut(model):
    en, de, fr = "why traders think the shares will fall", "warum die anleger vor einer blase warnen", "les investisseurs craignent une correction du marché"
    for texts, want in (((en, de, en), ["en", "de", "en"]), ((en, de, fr), ["en", "de", "fr"]), ((en, de, fr, en), ["en", "de", "fr", "en"])):
        parts = language.decode(model, [" ".join(texts)])[0]
        assert [p[0] for p in parts] == want
        assert parts[0][2] == 0 and all(x[3] == y[2] for x, y in zip(parts, parts[1:])) and parts[-1][3] == len(language.tokens_of(" ".join(texts)))


def test_operator(spark, model):
    rows = [(1, "the market looks expensive", " ENG "), (2, "the market looks expensive", "German"), (3, "le marché est trop cher", None), (4, None, "English"), (5, " ", None), (6, "die anleger warnen vor einer blase: the market looks expensive to buyers", "German"), (7, "le marché est trop cher", "-")]
    df = spark.createDataFrame(rows, "headline_id long, title string, language string").selectExpr("*", "'x' as langs", "'y' as code", "1 as lang")
    out = language.mislabelled(language.identify(df.drop("lang"), "title", model), "headline_id", "language")
    assert sorted(map(tuple, out.collect())) == [(2, "en"), (3, "fr"), (6, "de"), (6, "en"), (7, "fr")]
    assert language.identify(df.limit(0), "title", model).count() == 0


def test_held_out_accuracy(spark, sf):
    heads = spark.read.parquet(f"{sf}/headlines.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_on(heads, docs)
    held = docs.filter("lang is not null").selectExpr("lang", "get(split(text, '[.?] '), 1) as s").filter("length(s) > 30").toPandas()
    told = [p[0][0] if p else None for p in language.decode(model, held.s.tolist())]
    assert np.mean([a == b for a, b in zip(told, held.lang)]) >= 0.95
