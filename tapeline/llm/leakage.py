"""Evaluation texts leaking into training text.

Every stretch of WINDOW words of an item is a window. A random walk over a window's words (one output symbol
a step, the next word or the same one again by a random bit of the word and the step) turns a small edit
distance into a small Hamming distance; sampling a few steps of the walk gives a key that similar windows
share. As many walks are made as the target recall needs. Document windows that share a key with an item
window are verified by their exact edit distance. Nothing is shuffled: the items go to the documents.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.session import cut_lineage

#: The shortest passage that counts, in words, and how many of them may be edited between its two ends.
WINDOW = 12
EDITS = 2
STEPS = 3 * WINDOW
#: Steps sampled for a key, out of the first SAMPLED_FROM (later ones are mostly past the end).
SAMPLED = 5
SAMPLED_FROM = 2 * WINDOW
TARGET_RECALL = 0.995
#: Items that are searched for in one pass over the documents; more items are more passes.
ITEMS_A_PASS = 5_000
#: Document windows keyed at a time, and candidate pairs built at a time: what a worker holds is bounded by these.
BLOCK = 50_000
PAIRS = 400_000

_BLOCK_TAG = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_LINE_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*[\r\n]\s*(?=\w)")
_JOINT = re.compile(r"(?<=\w)[-‐‑'’ʼ](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text without letter case, punctuation, layout, markup and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return _WORD.findall(_JOINT.sub("", _LINE_BREAK.sub("", text)).casefold())


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walk_keys(words: np.ndarray, starts: np.ndarray, walks: int) -> np.ndarray:
    """(walks, windows) keys of the windows of WINDOW word ids that begin at `starts`."""
    keys = np.empty((walks, len(starts)), np.uint64)
    ids = words.astype(np.uint64) + np.uint64(1)
    for r in range(walks):
        bits = _mix(ids + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)))  # bit j: whether step j leaves this word
        wanted = set(np.random.default_rng(1000 + r).choice(SAMPLED_FROM, SAMPLED, replace=False).tolist())
        at, key = np.zeros(len(starts), np.int64), np.full(len(starts), r + 1, np.uint64)
        for j in range(max(wanted) + 1):
            here = np.minimum(starts + at, len(words) - 1)
            inside = at < WINDOW
            if j in wanted:
                key = _mix(key * np.uint64(31) + np.where(inside, ids[here], np.uint64(0)))
            at += inside & ((bits[here] >> np.uint64(j)) & np.uint64(1)).astype(bool)
        keys[r] = key
    return keys


#: The edits that a window of fixed length can hold inside: words replaced, or one put in and one left out.
EDIT_KINDS = ("replaced", "moved on")


def edited_windows(words: np.ndarray, kind: str, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Copies of (n, WINDOW) word ids with so many edits between their first and last words; new words are new ids.

    `replaced`: that many words are others. `moved on`: half of them are words put in, half words left out elsewhere
    (an odd one is replaced), so that the words between the two places stand one off.
    """
    n, out = len(words), words.copy()
    fresh = lambda k: rng.integers(1 << 30, 1 << 31, (n, k))
    inner = 1 + rng.random((n, WINDOW - 2)).argsort(axis=1)
    pairs = edits // 2 if kind == "moved on" else 0
    for k in range(pairs):
        new, gone = inner[:, 2 * k], inner[:, 2 * k + 1]
        at = np.arange(WINDOW)[None, :]
        back = (gone < new)[:, None]
        # a word put in before the one left out moves those between on, else back
        source = np.where(back, at + ((at >= gone[:, None]) & (at < new[:, None])), at - ((at > new[:, None]) & (at <= gone[:, None])))
        out = np.take_along_axis(out, source, axis=1)
        out[np.arange(n), new] = fresh(1)[:, 0]
    for k in range(2 * pairs, edits):
        out[np.arange(n), inner[:, k]] = fresh(1)[:, 0]
    return out


@functools.lru_cache(maxsize=8)
def walks_needed(target: float = TARGET_RECALL, trials: int = 20_000, most: int = 96) -> int:
    """Walks until windows with EDITS edits of the hardest kind share a key with the target probability, by simulation."""
    rng = np.random.default_rng(7)
    words = rng.integers(1, 1 << 30, size=(trials, WINDOW))
    edited = [edited_windows(words, kind, EDITS, rng) for kind in EDIT_KINDS]
    starts, tried = np.arange(trials) * WINDOW, min(32, most)
    while True:  # a few walks first, as simulating them is what takes time
        own, needed = walk_keys(words.ravel(), starts, tried), []
        for other in edited:
            recall = np.maximum.accumulate(own == walk_keys(other.ravel(), starts, tried), axis=0).mean(axis=1)
            needed.append(int(np.argmax(recall >= target)) + 1 if recall[-1] >= target else 0)
        if all(needed):
            return max(needed)
        if tried == most:
            raise ValueError(f"{most} walks don't reach a recall of {target} for windows with {EDITS} edits")
        tried = min(2 * tried, most)


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances between the rows of two (n, w) arrays of word ids."""
    n, w = a.shape
    row = np.tile(np.arange(w + 1), (n, 1))
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(w):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (a[:, i] != b[:, j]))
        row = new
    return row[:, w]


@dataclass(frozen=True)
class Index:
    vocabulary: dict[str, int]
    windows: np.ndarray  # (n, WINDOW) word ids, each distinct window once
    holders: list[np.ndarray]  # of each window: the positions of its items
    ids: list
    keys: np.ndarray  # (walks, n), each row sorted
    order: np.ndarray  # (walks, n): the window of each sorted key


def build_index(ids: list, texts: list[str | None], walks: int | None = None) -> Index:
    vocabulary: dict[str, int] = {}
    rows, items = [], []
    for k, text in enumerate(texts):
        own = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text or "")], np.int64)
        if len(own) >= WINDOW:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW))
            items.append(np.full(len(own) - WINDOW + 1, k))
    every = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int64)
    item_of = np.concatenate(items) if items else np.zeros(0, np.int64)
    windows, which = np.unique(every, axis=0, return_inverse=True)
    which = which.ravel()
    by = np.argsort(which, kind="stable")
    holders = np.split(item_of[by], np.cumsum(np.bincount(which, minlength=len(windows)))[:-1]) if len(windows) else []
    keys = walk_keys(windows.ravel() if len(windows) else np.zeros(1, np.int64), np.arange(len(windows)) * WINDOW, walks or walks_needed())
    order = np.argsort(keys, axis=1, kind="stable")
    return Index(vocabulary, windows, [np.unique(h) for h in holders], ids, np.take_along_axis(keys, order, axis=1), order)


def _candidates(index: Index, keys: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document window, item window) pairs of the windows a to b that share a key, in chunks of about PAIRS."""
    low = np.stack([np.searchsorted(index.keys[r], keys[r, a:b], "left") for r in range(len(keys))])
    n = np.stack([np.searchsorted(index.keys[r], keys[r, a:b], "right") for r in range(len(keys))]) - low
    total = n.sum()
    if total > PAIRS and b - a > 1:
        mid = (a + b) // 2
        yield from _candidates(index, keys, a, mid)
        yield from _candidates(index, keys, mid, b)
    elif total:
        mine, theirs = [], []
        for r in range(len(keys)):
            if m := n[r].sum():
                mine.append(np.repeat(np.arange(a, b), n[r]))
                theirs.append(index.order[r][np.arange(m) - np.repeat(np.cumsum(n[r]) - n[r], n[r]) + np.repeat(low[r], n[r])])
        pair = np.unique(np.concatenate(mine) * len(index.windows) + np.concatenate(theirs))
        yield pair // len(index.windows), pair % len(index.windows)


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int]]:
    """(row, item position) of the texts that hold a passage of an item."""
    if not len(index.windows):
        return []
    split = [[index.vocabulary.get(w, 0) for w in words_of(t)] if t else [] for t in texts]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    words = np.fromiter((w for s in split for w in s), np.int64, int(lengths.sum()))
    if len(words) < WINDOW:
        return []
    row = np.repeat(np.arange(len(split)), lengths)
    known = np.r_[0, np.cumsum(words > 0)]
    at = np.arange(len(words) - WINDOW + 1)
    # more than EDITS words that no item has are more than EDITS edits: no true window is left out
    fits = (row[at] == row[at + WINDOW - 1]) & (known[at + WINDOW] - known[at] >= WINDOW - EDITS) & (words[at] > 0) & (words[at + WINDOW - 1] > 0)
    at = at[fits]
    found: set[tuple[int, int]] = set()
    for block in np.array_split(at, math.ceil(len(at) / BLOCK)) if len(at) else ():
        keys = walk_keys(words, block, index.keys.shape[0])
        for mine, theirs in _candidates(index, keys, 0, len(block)):
            begin = block[mine]
            ends = (words[begin] == index.windows[theirs, 0]) & (words[begin + WINDOW - 1] == index.windows[theirs, -1])
            begin, theirs = begin[ends], theirs[ends]
            good = edit_distances(words[begin[:, None] + np.arange(WINDOW)], index.windows[theirs]) <= EDITS
            for r, w in set(zip(row[begin[good]].tolist(), theirs[good].tolist())):
                found.update((r, i) for i in index.holders[w].tolist())
    return sorted(found)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", walks: int | None = None) -> DataFrame:
    """(doc_id, item_id): the documents with at least WINDOW words of an item side by side, up to EDITS edits inside.

    The items are the query set: they are searched for in passes of ITEMS_A_PASS, each a narrow job over all
    documents. Null and empty texts hold nothing; items of fewer than WINDOW words can't leak. Repeated items are
    reported each. Whole texts are read, however long. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    own = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("item_text"))
    kind, doc_kind = own.schema["item_id"].dataType.simpleString(), documents.schema[doc_id].dataType.simpleString()
    passes = max(1, math.ceil(own.count() / ITEMS_A_PASS))
    out = None
    for k in range(passes):
        rows = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect() if passes > 1 else own.collect()
        index = spark.sparkContext.broadcast(build_index([r[0] for r in rows], [r[1] for r in rows], walks))  # about ITEMS_A_PASS items

        def leaks(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = search(index.value, batch["text"].tolist())
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[[r for r, _ in hits]], "item_id": [index.value.ids[i] for _, i in hits]})

        part = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInPandas(leaks, f"doc_id {doc_kind}, item_id {kind}")
        if passes > 1:  # the index of a pass is let go before the next is built
            part = cut_lineage(part)
            index.unpersist()
        out = part if out is None else out.unionByName(part)
    return out
