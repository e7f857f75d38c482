"""Text cut off by field limits: a self-join by prefix, on sorted values.

The values are the sentences and lines of all documents, numbers and names masked. A document's last one is its
tail. Sorted, all values that go on after a tail stand right behind it, so three running sums (before the tail,
behind its equals, behind the last value that begins with it) tell how often it stands whole and how often
longer; no value meets another one in a join, and no key can be hot, as equal values are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.mixing import source_key
from tapeline.plans.groups import attach
from tapeline.session import cut_lineage

#: What systems put after a cut. A mark makes no case; it only doesn't belong to the text.
_MARK = r"(?:\s*(?:…|\.\.\.+|\[(?:…|\.\.\.|\+?\s*[0-9]+ (?:more )?(?:chars|characters|words))\]|\((?:more|continued)\)|(?:Read|Show|See) more\W{0,20}|Continue reading\W{0,20}|�))+\s*\z"
#: What the last characters of a text with such a mark hold; most texts have none of it and are spared the search.
_HINT = r"[…\])�]|\.\.|more|reading"
_PIECE_END = r"(?=[ \t])(?<=[.!?…\"'”»’)\]])(?<=[.!?…][\"'”»’)\]]{0,2})[ \t]+|[\r\n]\s*"
_STOPPED = r"(?<![.…])[.!?][\"'”»’)\]]*\z"
_TERMINATED = r"[.!?…][\"'”»’)\]*\s]*\z|[)\]*]\s*\z"
_MASKED = r"\p{Lu}[\p{L}\p{M}'&]*+|[0-9]++(?:[.,][0-9]++)*+"
#: The last word of a sentence; of a text.
_FINAL = r"(?<![\p{L}\p{M}0-9'&-])([\p{L}0-9][\p{L}\p{M}0-9'&-]*+)[\"'”»’)\]]{0,2}[.!?](?![.…0-9])"
_LAST = r"(?<![\p{L}\p{M}0-9'&-])([\p{L}0-9][\p{L}\p{M}0-9'&-]*+)\z"
_COUNTED = r"\[\+?\s*[0-9]+ (?:more )?(?:chars|characters|words)\]\s*\z"
#: Markup; the character references among it.
_MARKUP = r"<[^<>\n]*>|&(?:[a-zA-Z]{2,6}|#[0-9]+);"
#: A character reference that was not finished; it has no more than 12 characters with what stands before it.
_BROKEN_REFERENCE = r"(?:^|[\s>\"“(])&#?[a-zA-Z0-9]{0,8}\z"
_INLINE = ("a", "b", "i", "u", "em", "strong", "span", "q", "p", "li", "ul", "ol", "div", "blockquote")
#: What closes a sentence or a line, and blanks: not part of what is compared.
_CLOSING = ".!?…\"'”»’)]* \t\n\r\f\x0b\xa0"
_BLANK = " \t\n\r\f\x0b\xa0"
#: Sorts behind every text that begins with what stands before it.
_BEHIND = "\U0010ffff"
#: Marks the last words of sentences among the values.
_WORD = "\x01"


def _mask(text: Column) -> Column:
    """Markup off, quotes alike, numbers and capitalised words as N: what makes sentences of a kind equal."""
    plain = F.when(text.rlike(_MARKUP), F.regexp_replace(text, _MARKUP, "")).otherwise(text)
    plain = F.when(plain.rlike("[‘’ʼ“”„«»]"), F.regexp_replace(plain, "[‘’ʼ“”„«»\"]", "'")).otherwise(F.replace(plain, F.lit('"'), F.lit("'")))
    return F.regexp_replace(plain, _MASKED, "N")


def _bare(piece: Column) -> Column:
    return F.regexp_replace(F.trim(F.rtrim(piece, F.lit(_CLOSING))), r"[ \t\xa0]{2,}|[\t\xa0]", " ")


def _unclosed(text: Column) -> Column:
    """Whether an inline tag is opened more often than closed."""
    out = F.lit(False)
    for tag in _INLINE:
        out = out | (F.regexp_count(text, F.lit(rf"(?i)<{tag}(?:\s[^<>]*)?>")) > F.regexp_count(text, F.lit(rf"(?i)</{tag}\s*>")))
    return out


def tails_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with text: its masked last sentence or line and what is known of its end.

    marked: something stands after it that systems put after a cut; broken: markup or a character is not
    finished; counted: the mark says how much is missing; ended: it ends as sentences do; word: its last word;
    copy: a hash of its last lines, equal for copies.
    """
    short = F.rtrim(F.col("text"), F.lit(_BLANK))
    body = F.when(F.right(short, F.lit(60)).rlike(_HINT), F.rtrim(F.regexp_replace(short, _MARK, ""), F.lit(_BLANK))).otherwise(short)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.col("text").rlike(r"[^\s\xa0]"))
    rows = rows.select("doc_id", body.alias("body"), (body != short).alias("marked"), short.rlike(_COUNTED).alias("counted"), F.endswith(short, F.lit("�")).alias("torn"))
    line = F.substring_index(F.replace(F.col("body"), F.lit("\r"), F.lit("\n")), "\n", -1)
    tag = F.substring_index("body", "<", -1)
    open_tag = F.contains(F.col("body"), F.lit("<")) & tag.rlike("^[a-zA-Z/!]") & ~F.contains(tag, F.lit(">"))
    rows = rows.select(
        "doc_id", "marked", "counted", line.alias("line"),
        (F.col("torn") | F.right(F.col("body"), F.lit(12)).rlike(_BROKEN_REFERENCE) | F.when(F.contains(F.col("body"), F.lit("<")), open_tag | _unclosed(F.col("body"))).otherwise(False)).alias("broken"),
        F.xxhash64(F.lower(F.substring_index(F.col("body"), "\n", -4))).alias("copy"),
    )
    return rows.select(
        "doc_id", "marked", "counted", "broken", "copy",
        _bare(F.element_at(F.split(_mask(F.col("line")), _PIECE_END), -1)).alias("tail"),
        F.regexp_extract(F.rtrim(F.col("line"), F.lit(_CLOSING)), _LAST, 1).alias("word"),
        F.col("line").rlike(_TERMINATED).alias("ended"),
    )


def values_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """(value, n, stopped): every masked sentence and line of all documents, how often it stands and how often with a full stop.

    In the same scan the last words of sentences, with _WORD before them. Values repeat a lot, so the counts combine
    map-side before anything is shuffled.
    """
    t = F.col(f"`{text}`").cast("string")
    pieces = F.split(_mask(t), _PIECE_END)
    words = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(_FINAL), F.lit(1))), lambda w: F.concat(F.lit(_WORD), w))
    each = documents.select(F.explode(F.concat(pieces, words)).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    each = each.select(_bare(F.col("raw")).alias("value"), "n", F.when(F.rtrim("raw", F.lit(_BLANK)).rlike(_STOPPED), F.col("n")).otherwise(0).alias("stopped"))
    return each.filter("value != ''").groupBy("value").agg(F.sum("n").alias("n"), F.sum("stopped").alias("stopped"))


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted range: the marks of the tails with the sums up to them, and a last row with the sums of the range."""
    part, n, stopped = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        up_n, up_stopped = n + np.cumsum(b["n"].to_numpy()), stopped + np.cumsum(b["stopped"].to_numpy())
        at = b["mark"].to_numpy() != 0
        yield pd.DataFrame({"part": part, "tail": b["tail"][at], "mark": b["mark"][at], "n": up_n[at], "stopped": up_stopped[at]})
        if len(b):
            n, stopped = int(up_n[-1]), int(up_stopped[-1])
    yield pd.DataFrame({"part": [part], "tail": [None], "mark": [9], "n": [n], "stopped": [stopped]})


def continued(tails: DataFrame, values: DataFrame) -> DataFrame:
    """(tail, whole, stopped, longer): how often each tail stands whole, whole with a full stop, and goes on.

    Values and three marks per tail are sorted by ranges; a range is a task, and what stands before it is the sum of
    the ranges before. The sums are written once to the checkpoint folder: ranges are drawn by sampling and must
    not be drawn again.
    """
    mark = lambda k, after: tails.select(F.concat("tail", F.lit(after)).alias("key"), F.lit(k).alias("place"), "tail", F.lit(k).alias("mark"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stopped"))
    own = values.select(F.col("value").alias("key"), F.lit(2).alias("place"), F.lit(None).cast("string").alias("tail"), F.lit(0).alias("mark"), "n", "stopped")
    rows = own.unionByName(mark(1, "")).unionByName(mark(3, "")).unionByName(mark(4, _BEHIND))
    sums = cut_lineage(rows.repartitionByRange("key").sortWithinPartitions("key", "place").select("tail", "mark", "n", "stopped").mapInPandas(_running, "part int, tail string, mark int, n long, stopped long"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sums.filter("mark = 9").select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("stopped").over(upto), F.lit(0)).alias("s0"))
    at = sums.filter("mark != 9").join(F.broadcast(before), "part")
    total = lambda v, k: F.sum(F.when(F.col("mark") == k, F.col(v[0]) + F.col(v[1])))
    n, s = ("n", "n0"), ("stopped", "s0")
    return at.groupBy("tail").agg((total(n, 3) - total(n, 1)).alias("whole"), (total(s, 3) - total(s, 1)).alias("stopped"), (total(n, 4) - total(n, 3)).alias("longer"))


def judged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tail, ended, marked, whole, stopped, longer, others, rule) of every document with text.

    rule is what makes it a case, else null: `markup` (a tag, a character reference or a character is not finished),
    `prefix` (the tail goes on elsewhere more often than it ends there), `word` (it stands elsewhere with its
    full stop, but no sentence anywhere ends in its last word, so that one is cut, or the mark after it counts
    what is missing). `others` counts the places
    where the tail ends without a stop, this text and its copies aside. A text that ends with a full stop, or
    that nothing goes on after, is no case, nor is a whole sentence whose stop became an ellipsis. Null and blank
    texts have no row; repeated rows are judged alike.
    """
    docs = cut_lineage(tails_of(documents, doc_id, text))
    values = cut_lineage(values_of(documents, text))
    known = docs.filter("tail != '' and not ended")
    tails = known.groupBy("tail").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("copy").alias("texts"))
    stats = cut_lineage(tails.join(continued(tails.select("tail"), values.filter(~F.startswith("value", F.lit(_WORD)))), "tail"))
    met = attach(known, stats, ["tail"], "docs")
    others = F.col("whole") - F.col("stopped") - F.col("docs") + F.col("texts") - 1
    met = met.withColumn("others", F.greatest(others, F.lit(0)).cast("long"))
    prefix = F.when(F.col("marked"), F.col("longer") > F.col("others") + F.col("stopped")).otherwise(F.col("longer") + F.col("stopped") > F.col("others"))
    # after a mark, a sentence that is whole but for its last word: do sentences end in that word?
    met = met.withColumn("doubt", F.col("marked") & ~prefix & (F.col("stopped") > F.col("others")) & (F.col("word") != ""))
    finals = values.filter(F.startswith("value", F.lit(_WORD))).select(F.substring("value", 2, 2**31 - 1).alias("word")).join(met.filter("doubt").select("word").distinct(), "word", "left_semi")
    met = met.join(finals.withColumn("final", F.lit(True)), "word", "left")
    rule = F.when(F.col("broken"), "markup").when(prefix, "prefix").when(F.col("doubt") & (F.col("counted") | F.col("final").isNull()), "word")
    met = met.select("doc_id", "tail", "ended", "marked", "whole", "stopped", "longer", "others", rule.alias("rule"))
    none = F.lit(None).cast("long")
    rest = docs.filter("tail = '' or ended").select("doc_id", "tail", "ended", "marked", *(none.alias(c) for c in ("whole", "stopped", "longer", "others")), F.when(F.col("broken"), "markup").alias("rule"))
    return met.unionByName(rest)


def truncated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return judged(documents, doc_id, text).filter("rule is not null").select("doc_id")


def rates(documents: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, documents, cut, by_prefix, by_word, by_markup, rate) by source, case and outer blanks aside; documents without text count as not cut."""
    of = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), source_key(F.col(f"`{source}`")).alias("source"))
    found = judged(documents, doc_id, text).filter("rule is not null").select("doc_id", "rule")
    by = [F.count_if(F.col("rule") == r).alias(f"by_{r}") for r in ("prefix", "word", "markup")]
    return of.join(found, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("rule").alias("cut"), *by).withColumn("rate", F.round(F.col("cut") / F.col("documents"), 6))
