"""Missing or wrong language labels: error-correcting output codes over n-gram classifiers.

Each language has a codeword; every bit of it is predicted by one binary n-gram classifier. A token loses
against each codeword what its margins lose bit by bit, weighted by how well each bit did on held-out rows;
losses add up, so a title, or any stretch of its tokens, is decoded to the codeword that it loses least
against. A title is cut where two stretches decoded apart lose less than one decoded whole; a cut needs tokens
that speak for each of the two languages.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.glyphs import Looks, looks

LANGUAGES = ("en", "es", "de", "fr", "pt", "it", "ru")
# The names and codes by which a label may give a language.
LABELS = {
    "en": ("english", "en", "eng"), "es": ("spanish", "es", "spa"), "de": ("german", "de", "deu"), "fr": ("french", "fr", "fra"),
    "pt": ("portuguese", "pt", "por"), "it": ("italian", "it", "ita"), "ru": ("russian", "ru", "rus"),
}
BITS = 15
FEATURES = 1 << 16
#: Rows that the classifiers are fitted on, at most, of each of the two labelled tables; drawn by a hash of the id.
TITLE_ROWS = 24_000
TEXT_ROWS = 4_000
#: Tokens that must speak for a language before a part of a title is taken to be in it, and tokens a part has at least.
LEAST_TOKENS = 2
LEAST_LENGTH = 3
#: What a cut must gain lies halfway between what all but this share of held-out plain titles stay below and what all but
#: this share of held-out mixtures exceed; so many mixtures are made.
TAIL = 1 / 300
MIXTURES = 6_000
#: By how much the loss of one language must be below another's for a token to speak for it.
CLEAR = 4.0
#: Words seen so often in the sample count as whole words (firms' names then speak for no language, as they
#: stand in titles of every language); what the n-grams say of rarer words counts less.
KNOWN = 4
WORD_SCALE, RARE_SCALE = 4.0, 1.5
_NOT_LETTER = re.compile(r"[^\w]+|[\d_]+")


def codewords(languages: int = len(LANGUAGES), bits: int = BITS) -> np.ndarray:
    """(languages, bits) of -1 and 1: balanced columns, each next one the best for the smallest distances so far."""
    half = languages // 2
    columns = [np.where(np.isin(np.arange(languages), c), 1, -1) for c in itertools.combinations(range(languages), half)]
    chosen: list[np.ndarray] = []
    pairs = list(itertools.combinations(range(languages), 2))
    apart = np.zeros(len(pairs))
    for _ in range(min(bits, len(columns))):
        scores = [(np.sort(apart + np.array([c[a] != c[b] for a, b in pairs])).tolist(), -i) for i, c in enumerate(columns)]
        best = -max(scores)[1]
        apart += np.array([columns[best][a] != columns[best][b] for a, b in pairs])
        chosen.append(columns.pop(best))
    return np.stack(chosen, axis=1).astype(np.float32)


def tokens_of(title: str, tables: Looks | None = None) -> list[str]:
    """The words of a title in lower case; words of mixed scripts are spelled in one, words of one script stay in it."""
    return _NOT_LETTER.sub(" ", (tables or looks()).one_script_words(title).lower()).split()


def _ngrams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each n-gram, token it is in) of 1- to 5-grams of ` token `."""
    text = np.frombuffer((" " + "  ".join(tokens) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) + 2 for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), lengths)
    features, owners = [], []
    key = text.copy()
    for n in range(2, 6):
        key = key[:-1] * np.uint64(1000003) + text[n - 1 :] if len(key) > 1 else key[:0]
        inside = owner[: len(key)] == owner[n - 1 :] if len(key) else np.zeros(0, bool)
        h = key[inside] * np.uint64(0x9E3779B97F4A7C15)
        features.append((h >> np.uint64(40)).astype(np.int64) % FEATURES)
        owners.append(owner[: len(key)][inside])
    return np.concatenate(features), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (FEATURES, bits)
    code: np.ndarray  # (languages, bits)
    trust: np.ndarray  # (bits,)
    words: dict[str, int]
    word_weights: np.ndarray  # (words, bits)
    tables: Looks  # of look-alike letters, as the workers have no file to read them from
    least_gain: float = np.inf  # what a cut must gain
    checked: tuple[float, float] = (np.nan, np.nan)  # shares of held-out mixtures not cut and of held-out plain titles cut

    def margins(self, tokens: list[str]) -> np.ndarray:
        """(tokens, bits): the mean margin of a token's n-grams, so that long words don't outweigh the rest."""
        if not tokens:
            return np.zeros((0, self.code.shape[1]), np.float32)
        features, owner = _ngrams(tokens)
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        sums = np.add.reduceat(self.weights[features[order]], np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), axis=0)
        out = RARE_SCALE * sums / np.bincount(owner, minlength=len(tokens))[:, None]
        known = np.array([self.words.get(t, -1) for t in tokens])
        out[known >= 0] = WORD_SCALE * self.word_weights[known[known >= 0]]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(rows, languages): the trusted logistic loss of margins against each codeword."""
        right, wrong = np.logaddexp(0, -margins) * self.trust, np.logaddexp(0, margins) * self.trust
        plus = (self.code > 0).astype(margins.dtype)
        return right @ plus.T + wrong @ (1 - plus).T


def _bit_weights(counts: np.ndarray, code: np.ndarray, share_of_mean: float, floor: float) -> np.ndarray:
    """(features, bits) log ratios. Languages weigh alike, however many rows they have; shares are smoothed."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    prior = share.mean(axis=0) * share_of_mean + floor
    weights = np.empty((counts.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, zero = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.clip(np.log((one + prior) / (zero + prior)), -4, 4)
    return weights


def _best_cut(lost: np.ndarray, own: np.ndarray, least_tokens: int = LEAST_TOKENS) -> tuple[float, int, int, int]:
    """(gain, cut, left language, right language) of the best single cut of (tokens + 1, languages) summed and (tokens, languages) own losses; gain 0 if there is none."""
    n = len(own)
    if n < 2 * LEAST_LENGTH:
        return 0.0, 0, 0, 0
    at = np.arange(LEAST_LENGTH, n - LEAST_LENGTH + 1)
    left, right = lost[at] - lost[0], lost[n] - lost[at]
    total = left.min(axis=1) + right.min(axis=1)
    k = int(total.argmin())
    l, r, cut = int(left[k].argmin()), int(right[k].argmin()), int(at[k])
    ahead = own[:, r] - own[:, l]
    if l == r or (ahead[:cut] > CLEAR).sum() < least_tokens or (ahead[cut:] < -CLEAR).sum() < least_tokens:
        return 0.0, 0, 0, 0
    return float((lost[n] - lost[0]).min() - total[k]), cut, l, r


def _cut_gains(model: Model, texts: list[list[str]]) -> np.ndarray:
    """What the best cut of each text gains."""
    ids, distinct = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    own = model.losses(model.margins(list(distinct)).astype(np.float64))[ids]
    ends = np.cumsum([len(t) for t in texts])
    lost = np.vstack([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
    return np.array([_best_cut(lost[e - len(t) : e + 1], own[e - len(t) : e])[0] for t, e in zip(texts, ends.tolist())])


def _calibrated(model: Model, texts: list[list[str]], labels: np.ndarray, held: np.ndarray) -> tuple[float, tuple[float, float]]:
    """(least gain, (mixtures missed, plain titles cut)): from held-out rows, and pairs of them in different languages joined to mixtures.

    One half of the held-out rows sets the least gain, the other half tells the error. Some labelled rows truly are
    mixtures: what gains as much as mixtures do isn't taken for plain when the gain is set, but counts as cut in the
    error. Without two languages nothing is ever cut.
    """
    rng, halves = np.random.default_rng(3), []
    at = held[[len(texts[i]) >= LEAST_LENGTH for i in held]] if len(held) else held
    if len(at) < 4:
        return np.inf, (np.nan, np.nan)
    for some in (at[::2], at[1::2]):
        a, b = rng.choice(some, MIXTURES // 2), rng.choice(some, MIXTURES // 2)
        both = labels[a] != labels[b]
        if not both.any():
            return np.inf, (np.nan, np.nan)
        halves.append((_cut_gains(model, [texts[i] for i in some]), _cut_gains(model, [texts[i] + texts[j] for i, j in zip(a[both], b[both])])))
    (plain, mixed), (other_plain, other_mixed) = halves
    low = np.quantile(mixed, TAIL)
    gain = float((low + np.quantile(plain[plain < low], 1 - TAIL)) / 2) if (plain < low).any() else float(low)
    return gain, (float((other_mixed <= gain).mean()), float((other_plain > gain).mean()))


def fit(texts: list[list[str]], labels: np.ndarray, rounds: int = 2) -> Model:
    """Naive Bayes for every bit. After each round, rows that contradict their own label are left out of the next."""
    code = codewords()
    vocabulary, distinct = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    features, owner = _ngrams(list(distinct))
    lengths = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), lengths)
    keep = lengths > 0
    held = np.arange(len(texts)) % 5 == 0
    model, trust, least, checked = None, np.ones(code.shape[1], np.float32), np.inf, (np.nan, np.nan)
    for k in range(rounds + 1):
        by_word = np.zeros((len(LANGUAGES), len(distinct)))
        for c in range(len(LANGUAGES)):
            use = (keep & (labels == c) & ~(held & (k == rounds - 1)))[row]
            by_word[c] = np.bincount(vocabulary[use], minlength=len(distinct))
        counts = np.stack([np.bincount(features, weights=np.minimum(n, 400)[owner], minlength=FEATURES) for n in by_word])
        known = np.flatnonzero(by_word.sum(axis=0) >= KNOWN)
        words = {distinct[j]: i for i, j in enumerate(known)}
        model = Model(_bit_weights(counts, code, 0.02, 1e-7), code, np.ones(code.shape[1], np.float32), words, _bit_weights(by_word, code, 0.1, 3e-5)[known], looks())
        margins = model.margins(list(distinct))
        lost = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(lost, row, model.losses(margins)[vocabulary])
        told = lost.argmin(axis=1)
        if k == rounds - 1 and (held & keep).any():
            use = (held & keep & (told == labels))[row]
            ok = (margins[vocabulary[use]] > 0) == (code[labels[row[use]]] > 0)
            accuracy = np.clip(ok.mean(axis=0) if len(ok) else np.full(code.shape[1], 0.5), 0.5, 0.999)
            trust = np.log(accuracy / (1 - accuracy)) + 1e-3
            trust = (trust / trust.mean()).astype(np.float32)
            least, checked = _calibrated(replace(model, trust=trust), texts, labels, np.flatnonzero(held & keep & (told == labels)))
        keep = (lengths > 0) & (told == labels)
    return replace(model, trust=trust, least_gain=least, checked=checked)


def _segments(lost: np.ndarray, cost: float) -> list[tuple[int, int, int]]:
    """(language, first token, end token) of the cheapest stretches, by the (tokens + 1, languages) summed losses; each cut costs `cost`."""
    n, k = len(lost) - 1, lost.shape[1]
    best, begun, since = np.full((n + 1, k), np.inf), np.full(k, np.inf), np.zeros(k, np.int64)
    came = np.zeros((n + 1, k), np.int64)
    for e in range(LEAST_LENGTH, n + 1):
        s = e - LEAST_LENGTH
        new = (best[s].min() + cost if s else 0.0) - lost[s]
        since[new < begun] = s
        begun = np.minimum(begun, new)
        best[e], came[e] = lost[e] + begun, since
    out, e = [], n
    while e:
        c = int(best[e].argmin())
        out.append((c, int(came[e, c]), e))
        e = out[-1][1]
    return out[::-1]


def decode(model: Model, titles: list[str | None], least_tokens: int = LEAST_TOKENS) -> list[list[tuple[str, float, int, int]]]:
    """For each title its parts: (language, confidence, first token, end token); none for a title without words."""
    split = [tokens_of(t, model.tables) if t else [] for t in titles]
    lengths = np.array([len(t) for t in split], dtype=np.int64)
    flat = [w for t in split for w in t]
    if not flat:
        return [[] for _ in titles]
    ids, distinct = pd.factorize(np.array(flat, dtype=object))
    margins = model.margins(list(distinct)).astype(np.float64)
    token_loss = model.losses(margins)
    # what a token alone says: its best language, if ahead of the second
    ranked = np.sort(token_loss, axis=1)
    speaks = np.where(ranked[:, 1] - ranked[:, 0] > CLEAR, token_loss.argmin(axis=1), -1)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    lost = np.vstack([np.zeros((1, len(LANGUAGES))), np.cumsum(token_loss[ids], axis=0)])
    row = np.repeat(np.arange(len(split)), lengths)
    said = np.zeros((len(split), len(LANGUAGES)), np.int64)
    spoken = speaks[ids]
    np.add.at(said, (row[spoken >= 0], spoken[spoken >= 0]), 1)
    whole = lost[ends] - lost[starts]
    best = whole.argmin(axis=1)
    out: list[list[tuple[str, float, int, int]]] = []
    least_gain = model.least_gain
    confidence = lambda losses, n: float(1 / np.exp(np.clip((losses.min() - losses) / max(n, 1) ** 0.5, -50, 0)).sum())
    second = np.sort(said, axis=1)[:, -2]
    apart = np.bincount(row, weights=token_loss.min(axis=1)[ids], minlength=len(split))  # no parts lose less
    for i in range(len(split)):
        n, a = int(lengths[i]), int(starts[i])
        if not n:
            out.append([])
            continue
        if second[i] and n >= 3 * LEAST_LENGTH and whole[i].min() - apart[i] > 2 * least_gain:
            parts = _segments(lost[a : ends[i] + 1] - lost[a], least_gain)
            own = token_loss[ids[a : ends[i]]]
            clear = lambda x, y: (own[x[1] : x[2], y[0]] - own[x[1] : x[2], x[0]] > CLEAR).sum() >= least_tokens  # noqa: B023, E731
            if len(parts) > 2 and all(clear(x, y) and clear(y, x) for x, y in itertools.pairwise(parts)):
                out.append([(LANGUAGES[c], confidence(lost[a + e] - lost[a + s], e - s), s, e) for c, s, e in parts])
                continue
        if second[i] and n >= 2 * LEAST_LENGTH:
            gain, cut, l, r = _best_cut(lost[a : ends[i] + 1], token_loss[ids[a : ends[i]]], least_tokens)
            if gain > least_gain:
                out.append([(LANGUAGES[l], confidence(lost[a + cut] - lost[a], cut), 0, cut), (LANGUAGES[r], confidence(lost[ends[i]] - lost[a + cut], n - cut), cut, n)])
                continue
        out.append([(LANGUAGES[best[i]], confidence(whole[i], n), 0, n)])
    return out


def label_code(label: Column) -> Column:
    """The language a label names, in any case and with outer blanks; null for what names none."""
    clean = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""))
    out = None
    for code, names in LABELS.items():
        out = F.when(clean.isin(*names), code) if out is None else out.when(clean.isin(*names), code)
    return out


def _sample(df: DataFrame, row_id: str, text: str, label: Column, rows: int) -> pd.DataFrame:
    """At most `rows` labelled rows, those with the smallest hashes of their ids; other languages than English first.

    The rows are counted first, so that the hash alone leaves hardly more than are wanted: however many tasks there
    are, they send on about a fifth more rows than the sample has.
    """
    known = df.select(F.xxhash64(F.col(f"`{row_id}`")).alias("h"), F.col(f"`{text}`").alias("text"), label.alias("code")).filter("code is not null and text is not null")
    english = F.col("code") == "en"
    counted = {r[0]: r[1] for r in known.select("code").groupBy(english.alias("e")).agg(F.count(F.lit(1))).collect()}
    out = []
    for is_english, most in ((False, rows - rows // 3), (True, rows // 3)):
        n = counted.get(is_english, 0)
        some = known.filter(english == F.lit(is_english))
        if n > most:
            share = min(1.0, (1.2 * most + 100) / n)
            some = some.filter(F.col("h") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))).cast("long")) if share < 1 else some
        out.append(some.orderBy("h").limit(most))
    return out[0].unionByName(out[1]).toPandas()


def fit_on(titles: DataFrame, documents: DataFrame | None = None, title_rows: int = TITLE_ROWS, text_rows: int = TEXT_ROWS, names: Mapping[str, str] | None = None) -> Model:
    """A model fitted on a bounded sample of labelled titles and, if given, of labelled documents."""
    n = {"id": "headline_id", "title": "title", "label": "language", "doc": "doc_id", "text": "text", "lang": "lang"} | dict(names or {})
    rows = _sample(titles, n["id"], n["title"], label_code(F.col(n["label"])), title_rows)
    if documents is not None:
        rows = pd.concat([rows, _sample(documents, n["doc"], n["text"], label_code(F.col(n["lang"])), text_rows)], ignore_index=True)
    rows = rows.sort_values("h", kind="stable")
    return fit([tokens_of(t) for t in rows.text], np.array([LANGUAGES.index(c) for c in rows.code], dtype=np.int64))


def identify(df: DataFrame, title: str, model: Model) -> DataFrame:
    """`df` with `parts`: an array of (lang, confidence, first_token, end_token) in the order of the title.

    Null, blank and wordless titles have an empty array. Confidence is the share of the chosen codeword in the
    soft minimum of the losses; below 0.6 a part counts as ambiguous. Very long titles are read whole.
    """
    model_of = df.sparkSession.sparkContext.broadcast(model)  # a fixed size: FEATURES x BITS floats
    kind = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("first_token", T.IntegerType()), T.StructField("end_token", T.IntegerType())]))

    @F.pandas_udf(kind)
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"lang": a, "confidence": b, "first_token": c, "end_token": d} for a, b, c, d in x] for x in decode(model_of.value, batch.tolist())], dtype=object)

    return df.withColumn("parts", parts(F.col(f"`{title}`")))


def mislabelled(found: DataFrame, row_id: str, label: str) -> DataFrame:
    """(row_id, lang): a row per language of the titles whose label is missing, wrong, or can't be right as there are two."""
    languages = F.array_distinct(F.transform("parts", lambda p: p["lang"]))
    code = label_code(F.col(f"`{label}`"))
    rows = found.select(F.col(f"`{row_id}`"), languages.alias("langs"), code.alias("code")).filter(F.size("langs") > 0)
    return rows.filter((F.size("langs") > 1) | F.col("code").isNull() | (F.col("langs")[0] != F.col("code"))).select(row_id, F.explode("langs").alias("lang"))
