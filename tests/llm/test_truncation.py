import random

from pyspark.sql import functions as F

from tapeline.llm import truncation

SENTENCES = [
    "The company declined to comment on the figures for the year.", "Buyers have been cautious since the firm reported its numbers.", "Most of the gain came from chip stocks, while miners did very little.",
    "That view is not shared by everyone in the market.", "Margin debt is up by 12% over the quarter.", "Passive money keeps buying the largest names, whatever they cost.",
    "The bank sold its shares on Monday.",
]
CLOSERS = ["Updated 16:05 ET", "Corrections: none", "Tags: chip stocks, miners", "(ends)", "***", "More on this story later…", "- SPY +0.4%"]


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        body = " ".join(rng.sample(SENTENCES, 4))
        rows.append((i, body + (("\n" if rng.random() < 0.8 else " ") if i % 2 and CLOSERS[i % 7][-1] == "…" else "\n" if i % 2 else "") + (CLOSERS[i % 7] if i % 2 else "")))
    return rows


CUT = ["Buyers have been cautious since the fi", "Margin debt is up by 12% over…", "Most of the gain came from chip stocks, while [+230 chars]", "The company declined...", "Passive money keeps buying <a href=", "Passive money keeps &am", "<b>That view is not shared by everyone in the market.", "That view is not shar�", "Margin debt is up by 12", "The bank sold its shares on Mond…", "Buyers have been cautious since the firm rep\n \n"]


def test_planted_cuts(spark):
    rows = corpus()
    bad = [(1000 + i, SENTENCES[i % 5] + (" " if i % 2 else "\n\n") + c) for i, c in enumerate(CUT)]
    good = [(2000, None), (2001, ""), (2002, "  "), (2003, SENTENCES[0] * 400), (2004, SENTENCES[1]), (2005, SENTENCES[1])]
    df = spark.createDataFrame(rows + bad + good, "doc_id long, text string").selectExpr("*", "1 as tail", "2 as body", "3 as whole", "'S ' as source")
    assert {r.doc_id for r in truncation.truncated(df).collect()} == {i for i, _ in bad}
    assert [tuple(r) for r in truncation.rates(df).collect()] == [("s", len(rows + bad + good), len(bad), 6, 1, 4, round(len(bad) / len(rows + bad + good), 6))]
    assert truncation.truncated(df.limit(0)).count() == 0


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame(corpus() + [(900 + i, SENTENCES[i % 5] + " " + c) for i, c in enumerate(CUT)], "doc_id long, text string")
    bare = lambda c: truncation._bare(F.col(c))
    split = df.select(F.explode(F.split(truncation._mask(F.col("text")), truncation._PIECE_END)).alias("p")).select(bare("p").alias("b"), F.col("p").rlike(truncation._STOPPED).alias("s"))
    pieces = [tuple(r) for r in split.filter("b != ''").collect()]
    judged = truncation.judged(df).filter("whole is not null").collect()
    assert len(judged) > 100
    for r in judged:
        # a marked tail's own piece still has its mark, so it may not stand among the pieces
        assert r.whole == sum(p == r.tail for p, _ in pieces)
        assert r.stopped == sum(p == r.tail and s for p, s in pieces)
        assert r.longer == sum(p.startswith(r.tail) and p != r.tail for p, _ in pieces)


def test_finished_sentences_are_no_cases(spark):
    words = ("sharply", "again", "by a third", "in London", "after lunch", "for a week")
    rows = [(k, f"{SENTENCES[0]}\nShares fell {w}. The bank declined {w} to comment.") for k, w in enumerate(words)]
    done = [(100, SENTENCES[1] + " Shares fell."), (101, SENTENCES[2] + "\nThe bank declined."), (102, "Shares fell."), (103, SENTENCES[3] + " “Shares fell.”")]
    cut = [(200, SENTENCES[1] + " Shares fe"), (201, SENTENCES[2] + "\nThe bank declined")]
    found = {r.doc_id: r.rule for r in truncation.judged(spark.createDataFrame(rows + done + cut, "doc_id long, text string")).filter("rule is not null").collect()}
    assert found == {200: "prefix", 201: "prefix"}


def test_nothing_elsewhere_is_no_evidence(spark):
    """A tail that nothing goes on after is no case, however it ends; ties between texts that end and go on are none."""
    df = spark.createDataFrame([(1, "Alpha beta. gamma delt"), (2, "one two three"), (3, "one two three four."), (4, "Foo bar.\none two three"), (5, "x" * 100_000 + " y")], "doc_id long, text string")
    assert truncation.truncated(df).count() == 0


def test_one_original(spark):
    whole = ["Rates were left where they stood after a long debate among members.", "Copper fell while zinc and tin were little changed in thin trade.", "The fund sold most of its stake to Halden."]
    cut = [(1000, whole[0][:40]), *((1001 + k, SENTENCES[1] + "\n" + whole[1][:38]) for k in range(150)), (1200, SENTENCES[2] + "\n" + whole[2][:-3])]
    good = [(2000 + k, x) for k, x in enumerate(whole)] + [(2010 + k, f"{SENTENCES[k]}\n{SENTENCES[k + 1]}\nReported by staff") for k in range(5)] + [(2020, SENTENCES[3] + "\nReported by staff in the morning")]
    df = spark.createDataFrame(corpus() + cut + good, "doc_id long, text string")
    assert {r.doc_id for r in truncation.truncated(df).collect()} == {i for i, _ in cut}
