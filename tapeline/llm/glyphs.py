"""Visually identical text with different characters: one consistent form.

Every token gets the set of scripts in which all of its letters can be spelled: a letter that looks like one
of another script can be spelled in both. The sets of its letters are intersected. One script in the
intersection decides; a token that could be spelled in several (a whole-script confusable such as an all
Cyrillic "oco") takes Latin if it can for the match key, and the script of its line for the shown form.

Which letters look like a Latin one is read from the Unicode confusables data that Spark's ICU library carries, on
the driver; the tables (some hundred letters) go to the workers with the functions that need them. Letters of one
script that only look alike in some fonts (capital I and small l) are left apart, as are letters and digits.
"""

from __future__ import annotations

import functools
import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.plans.groups import attach
from tapeline.session import cut_lineage

#: The script a token is spelled in if it may be spelled in several, best first; others follow by name.
PREFERENCE = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
#: Where the confusables data lies in ICU's archive.
_CONFUSABLES = "com/ibm/icu/impl/data/icudata/confusables.cfu"
_MAGIC = 0x3845FDEF
#: Compatibility forms that show the same as what they stand for; raised, circled or squared ones show something else.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Letters that look like a Latin one in most fonts, though the Unicode data says otherwise or nothing.
ALSO = {"ӏ": "l", "Ԛ": "Q", "Լ": "L"}
#: Rows of a group of look-alikes that one task joins with the whole group.
SPLIT = 2_000
#: Characters that show nothing: format characters, variation selectors, fillers, the combining grapheme joiner.
_SHOWS_NOTHING = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb"
    "\U000e0000-\U000e0fff\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]"
)


def icu_archive() -> str:
    """The ICU library among Spark's jars."""
    import pyspark

    for home in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)):
        if home and (found := sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))):
            return found[-1]
    raise FileNotFoundError("no icu4j archive among Spark's jars: give the path of one")


def read_confusables(path: str | None = None) -> dict[str, str]:
    """Character -> what it shows, of the compiled Unicode confusables in an ICU archive."""
    with zipfile.ZipFile(path or icu_archive()) as z:
        raw = z.read(_CONFUSABLES)
    start = struct.unpack(">H", raw[:2])[0]
    order = ">" if struct.unpack(">I", raw[start : start + 4])[0] == _MAGIC else "<"
    magic, _, _, keys_at, keys, index_at, _, strings_at, units = struct.unpack(f"{order}9I", raw[start : start + 36])
    if magic != _MAGIC:
        raise ValueError("not a confusables file")
    at = lambda offset, n, kind: struct.unpack(f"{order}{n}{kind}", raw[start + offset : start + offset + n * struct.calcsize(kind)])
    strings = at(strings_at, units, "H")
    out = {}
    for key, value in zip(at(keys_at, keys, "I"), at(index_at, keys, "H")):
        size = (key >> 24) + 1  # the text itself if it is one unit, else its place in the string table
        shown = (value,) if size == 1 else strings[value : value + size]
        out[chr(key & 0xFFFFFF)] = struct.pack(f"<{size}H", *shown).decode("utf-16-le", "replace")
    return out


def script_of(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@functools.lru_cache(maxsize=None)
def latin_looks(path: str | None = None) -> dict[str, str]:
    """Letters that look like an ASCII letter of the same case, with that letter. Letters that run right to left are left out."""
    confusables = read_confusables(path)
    shows = lambda c: "".join(confusables.get(x, x) for x in unicodedata.normalize("NFD", c))
    ascii_letters: dict[str, list[str]] = {}
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        ascii_letters.setdefault(shows(c), []).append(c)
    out = {}
    for c in sorted(confusables):
        if c.isascii() or unicodedata.category(c) not in ("Lu", "Ll", "Lo") or unicodedata.bidirectional(c) != "L" or unicodedata.decomposition(c):
            continue
        same = ascii_letters.get(shows(c), [])
        cased = [x for x in same if x.isupper() == c.isupper()] if c.isupper() or c.islower() else same
        if cased:
            out[c] = cased[0]
    return out | ALSO


@functools.lru_cache(maxsize=8192)
def _decomposed(c: str) -> str:
    """A character in parts: canonical ones, and compatible ones where they show the same (wide, narrow, font, ligature)."""
    tag, _, parts = unicodedata.decomposition(c).partition(" ")
    if not tag:
        return c
    if not tag.startswith("<"):
        return unicodedata.normalize("NFD", c)
    letters = tag == "<compat>" and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl", "Po") and c != "\u017f"
    if tag in _SAME_LOOK or letters:
        return "".join(_decomposed(chr(int(x, 16))) for x in parts.split())
    return c


_TOKENS = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
_SPECIAL_BLANK = re.compile("[\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _plain(text: str) -> str:
    """Decomposed form without what shows nothing, every blank an ordinary one."""
    parts = "".join(c if c.isascii() else _decomposed(c) for c in _SPECIAL_BLANK.sub(" ", text))
    return _SHOWS_NOTHING.sub("", unicodedata.normalize("NFD", parts))


class Looks:
    """The tables of look-alike letters, and what is done with them. Small; goes to the workers as it is.

    Scripts without a letter in the tables (Chinese, Arabic, Thai, ...) have no other spelling: their tokens stay.
    """

    def __init__(self, path: str | None = None):
        self.latin = dict(latin_looks(path))
        self.by_script: dict[str, dict[str, str]] = {}
        for c in sorted(self.latin, reverse=True):  # the letter with the lowest code point is the script's usual one
            self.by_script.setdefault(script_of(c), {})[self.latin[c]] = c
        self.by_script.pop("LATIN", None)
        self._table = {ord(c): x for c, x in self.latin.items()}
        self._letters: dict[str, frozenset[str]] = {}
        self._tokens: dict[tuple[str, str | None], str] = {}

    def __reduce__(self):
        return _with_tables, (self.latin, self.by_script)

    def scripts(self, c: str) -> frozenset[str]:
        """The scripts in which what a letter shows can be spelled; empty: any (digits, marks, signs)."""
        known = self._letters.get(c)
        if known is None:
            known = frozenset()
            if c.isalpha():
                own = script_of(c)
                shown = c if c.isascii() else self.latin.get(c)
                known = frozenset({own} if shown is None else {own, "LATIN"} | {s for s, letters in self.by_script.items() if shown in letters})
            self._letters[c] = known
        return known

    def token_scripts(self, token: str) -> frozenset[str] | None:
        """The scripts a token can be spelled in; None if it has no letters; empty if there is no such script."""
        sets = [s for c in token if (s := self.scripts(c))]
        return frozenset.intersection(*sets) if sets else None

    def _spell(self, token: str, script: str) -> str:
        if script == "LATIN":
            return token.translate(self._table)
        table = self.by_script.get(script)
        if table is None:
            return token
        return "".join(c if not c.isalpha() or script_of(c) == script else table.get(self.latin.get(c, c), c) for c in token)

    def spelled(self, token: str, line_script: str | None) -> str:
        out = self._tokens.get((token, line_script))
        if out is None:
            scripts = self.token_scripts(token)
            if scripts is None:
                out = token
            elif not scripts:  # no script spells all of it: each look-alike becomes the Latin letter it shows
                out = token.translate(self._table)
            elif line_script in scripts:
                out = self._spell(token, line_script)
            else:
                out = self._spell(token, next(s for s in (*PREFERENCE, *sorted(scripts)) if s in scripts))
            if len(self._tokens) >= 1 << 16:
                self._tokens.clear()
            self._tokens[token, line_script] = out
        return out

    def line_script(self, text: str) -> str | None:
        """The script of the letters that can be spelled in one script only; None if there are none."""
        seen: dict[str, int] = {}
        for c in text:
            if len(s := self.scripts(c)) == 1:
                own = next(iter(s))
                seen[own] = seen.get(own, 0) + 1
        return max(sorted(seen), key=seen.get) if seen else None

    def match_key(self, text: str) -> str:
        """Equal for texts that look the same in print, whatever characters they are made of."""
        if text.isascii():
            return _SHOWS_NOTHING.sub("", _SPECIAL_BLANK.sub(" ", text))
        return unicodedata.normalize("NFC", _TOKENS.sub(lambda m: self.spelled(m[0], None), _plain(text)))

    def one_script_words(self, text: str) -> str:
        """match_key(), but words that are wholly of one script stay in it, even if they could be spelled in another."""
        if text.isascii():
            return self.match_key(text)
        word = lambda m: m[0] if m[0].isascii() or len({script_of(c) for c in m[0] if c.isalpha()}) == 1 else self.spelled(m[0], None)
        return unicodedata.normalize("NFC", _TOKENS.sub(word, _plain(text)))

    def normal_form(self, text: str) -> str:
        """The text in its one consistent form: tokens in one script each, NFC, ordinary blanks, nothing invisible."""
        if text.isascii():
            return _SHOWS_NOTHING.sub("", _SPECIAL_BLANK.sub(" ", text))
        plain = _plain(text)
        script = self.line_script(plain)
        return unicodedata.normalize("NFC", _TOKENS.sub(lambda m: self.spelled(m[0], script), plain))

    def mixed_tokens(self, text: str) -> tuple[int, int]:
        """(tokens of several scripts, tokens wholly of look-alikes of a script other than the line's)."""
        plain, mixed, whole = _plain(text), 0, 0
        script = self.line_script(plain)
        for m in _TOKENS.finditer(plain):
            own = {script_of(c) for c in m[0] if c.isalpha()}
            mixed += len(own) > 1
            whole += len(own) == 1 and script is not None and script not in own and script in (self.token_scripts(m[0]) or ())
        return mixed, whole


def _with_tables(latin: dict[str, str], by_script: dict[str, dict[str, str]]) -> Looks:
    out = Looks.__new__(Looks)
    out.latin, out.by_script, out._table, out._letters, out._tokens = latin, by_script, {ord(c): x for c, x in latin.items()}, {}, {}
    return out


@functools.lru_cache(maxsize=None)
def looks(path: str | None = None) -> Looks:
    """The tables of this process; `path` is an ICU archive, by default Spark's own."""
    return Looks(path)


def match_key(text: str) -> str:
    return looks().match_key(text)


def normal_form(text: str) -> str:
    return looks().normal_form(text)


def mixed_tokens(text: str) -> tuple[int, int]:
    return looks().mixed_tokens(text)


_PRINTABLE = r"^[ -~]*\z"


def _over(text: Column, method: str, path: str | None) -> Column:
    """A method of the tables over a text column; printable ASCII never leaves the JVM, null stays null."""
    known = looks(path)

    @F.pandas_udf(T.StringType())
    def convert(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else getattr(known, method)(t), na_action=None)

    plain = text.rlike(_PRINTABLE)
    return F.when(plain, text).otherwise(convert(F.when(~plain, text)))


def consistent_form(text: Column, path: str | None = None) -> Column:
    """The consistent form of a text column."""
    return _over(text, "normal_form", path)


def look(text: Column, path: str | None = None) -> Column:
    """The match key of a text column."""
    return _over(text, "match_key", path)


def lookalike_groups(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(group_id, id, spelling, rows): membership of every row whose text looks like a differently spelled one.

    group_id is the smallest id of the group, spelling the smallest id of the rows with exactly that text, rows the
    size of the group. Null texts are no cases, empty ones only equal each other; ids are unique. The texts are read
    and keyed once: what is shuffled and written are 16-byte hashes of look and spelling. Counts per look combine
    map-side and join back by attach(), so no hot group is ever in one task; looks of a single spelling go no further.
    """
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{row_id}`").alias("id"), t.alias("text")).filter("text is not null")
    hashed = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    keyed = cut_lineage(rows.select("id", hashed(look(F.col("text"), path)).alias("look"), hashed(F.col("text")).alias("spelled")))
    spellings = keyed.groupBy("look", "spelled").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("spelling"))
    groups = spellings.groupBy("look").agg(F.sum("m").alias("rows"), F.count(F.lit(1)).alias("k"), F.min("spelling").alias("group_id")).filter("k > 1").select("look", "rows", "group_id")
    some = cut_lineage(spellings.join(groups, "look"))
    return attach(keyed, some, ["look", "spelled"], "m").select("group_id", "id", "spelling", "rows")


def lookalike_pairs(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(first_id, second_id), smaller id first: rows whose texts differ but look the same in print.

    lookalike_groups() spelled out. The rows of a group are dealt out in parts of about SPLIT, each of which meets
    the whole group in a task of its own, so a group of n rows is n / SPLIT tasks however large n is.
    """
    members = cut_lineage(lookalike_groups(df, row_id, text, path))
    parts = F.ceil(F.col("rows") / SPLIT).cast("int")
    one = members.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    all_ = members.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("group_id", "part", F.col("id").alias("second_id"), F.col("spelling").alias("other"))
    return one.join(all_, ["group_id", "part"]).filter("id < second_id and spelling != other").select(F.col("id").alias("first_id"), "second_id")


def confusable_report(df: DataFrame, text: str, names: Sequence[str] = ("mixed_script_tokens", "whole_script_tokens"), path: str | None = None) -> DataFrame:
    """(texts, changed, mixed_script_tokens, whole_script_tokens) over a text column, nulls left out."""
    known = looks(path)

    @F.pandas_udf("mixed long, whole long")
    def tokens(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(0, 0) if t is None else known.mixed_tokens(t) for t in v], columns=["mixed", "whole"])

    t = F.col(f"`{text}`")
    odd = F.when(~t.rlike(_PRINTABLE), t)
    return df.filter(t.isNotNull()).select(t.alias("t"), consistent_form(t, path).alias("form"), tokens(odd).alias("k")).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("form") != F.col("t")).alias("changed"), F.coalesce(F.sum("k.mixed"), F.lit(0)).alias(names[0]), F.coalesce(F.sum("k.whole"), F.lit(0)).alias(names[1])
    )
