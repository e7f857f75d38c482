import random

import numpy as np
import pytest

from tapeline.llm import leakage

RNG = random.Random(5)
VOCABULARY = [f"{a}{b}" for a in ("ta", "mo", "ri", "lu", "ke", "su", "po") for b in ("ber", "nim", "dof", "gas", "ved", "quix")]
ITEMS = [(k, " ".join(RNG.choice(VOCABULARY) for _ in range(40)).capitalize() + ".") for k in range(20)]
FILL = "Ordinary words stand here and say nothing of note at all today."


def quote(k, a, n, change=()):
    words = ITEMS[k][1].rstrip(".").split()[a : a + n]
    for c in change:
        words[c] = "replaced"
    return words


@pytest.mark.parametrize("how", ["plain", "upper", "wrapped", "hyphen", "markup", "invisible", "wide", "edited"])
def test_forms(spark, how):
    words = quote(3, 5, 14, (4,) if how == "edited" else ())
    text = {
        "plain": " ".join(words), "upper": ", ".join(words).upper(), "wrapped": "\n".join(words), "hyphen": " ".join(w[:2] + "-\n" + w[2:] for w in words),
        "markup": " ".join(f"<em>{w}</em><br/>&quot;" for w in words), "invisible": " ".join("\u200b".join(w) + "\u00ad" for w in words), "wide": "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "\u3000" for c in " ".join(words)), "edited": " ".join(words),
    }[how]
    docs = spark.createDataFrame([(1, f"{FILL} “{text}” {FILL}")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in leakage.find_leaks(docs, items).collect()] == [(1, 3)]


def test_edges(spark):
    items = spark.createDataFrame([*ITEMS, (90, None), (91, "too short"), (92, ITEMS[0][1])], "item_id long, text string").selectExpr("*", "1 as doc_id")
    short = " ".join(quote(1, 0, 11)) + " " + FILL
    rows = [(1, None), (2, ""), (3, short), (4, (FILL + " ") * 2000 + " ".join(quote(0, 0, 30))), (5, " ".join(quote(2, 0, 12))), (6, " ".join(quote(2, 0, 12))), (7, " ".join(quote(4, 0, 16, (2, 4, 6, 8, 10, 12))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "2 as item_id", "3 as item_text")
    assert {tuple(r) for r in leakage.find_leaks(docs, items).collect()} == {(4, 0), (4, 92), (5, 2), (6, 2)}
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_A_PASS", 6)
    docs = spark.createDataFrame([(k, " ".join(quote(k, 3, 20))) for k in range(20)], "doc_id long, text string")
    assert {tuple(r) for r in leakage.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()} == {(k, k) for k in range(20)}


def test_recall_against_brute_force():
    walks = leakage.walks_needed()
    index = leakage.build_index([k for k, _ in ITEMS], [t for _, t in ITEMS], walks)
    rng = random.Random(8)
    hit = 0
    for _ in range(400):
        k, a = rng.randrange(20), rng.randrange(28)
        hit += (0, k) in leakage.search(index, [FILL + " ".join(quote(k, a, 12, (rng.randrange(1, 11),))) + " " + FILL])
    assert hit >= 0.97 * 400


def test_recall_at_all_edits():
    index = leakage.build_index([k for k, _ in ITEMS], [t for _, t in ITEMS])
    rng = random.Random(9)
    hit = 0
    for _ in range(400):
        k, a = rng.randrange(20), rng.randrange(28)
        hit += (0, k) in leakage.search(index, [FILL + " ".join(quote(k, a, 12, rng.sample(range(1, 11), leakage.EDITS))) + " " + FILL])
    assert hit >= 0.97 * 400


@pytest.mark.parametrize("kind", leakage.EDIT_KINDS)
@pytest.mark.parametrize("edits", range(1, leakage.EDITS + 1))
def test_recall_of_every_edit_kind(kind, edits):
    """Fresh windows, not those that the walks were counted on; brute force finds every one of them."""
    rng = np.random.default_rng(31)
    words = rng.integers(1, 1 << 30, (5000, leakage.WINDOW))
    other = leakage.edited_windows(words, kind, edits, rng)
    assert (leakage.edit_distances(words, other) <= leakage.EDITS).all() and (other[:, [0, -1]] == words[:, [0, -1]]).all()
    starts, walks = np.arange(5000) * leakage.WINDOW, leakage.walks_needed()
    assert (leakage.walk_keys(words.ravel(), starts, walks) == leakage.walk_keys(other.ravel(), starts, walks)).any(axis=0).mean() >= 0.99


def test_moved_on_words_are_found():
    index = leakage.build_index([k for k, _ in ITEMS], [t for _, t in ITEMS])
    rng, hit = random.Random(10), 0
    for _ in range(300):
        k, a = rng.randrange(20), rng.randrange(28)
        words = quote(k, a, 12)
        gone, new = rng.sample(range(1, 11), 2)
        del words[gone]
        words.insert(new, "inserted")
        hit += (0, k) in leakage.search(index, [FILL + " ".join(words) + " " + FILL])
    assert hit >= 0.97 * 300


def test_boilerplate_in_every_item(monkeypatch):
    """A passage that stands in all items is one window of the index; candidates come in chunks."""
    monkeypatch.setattr(leakage, "PAIRS", 50)
    monkeypatch.setattr(leakage, "BLOCK", 30)
    common = " ".join(quote(0, 0, 14))
    items = [f"{common} {' '.join(quote(k, 0, 20))}" for k in range(1, 20)]
    index = leakage.build_index(list(range(19)), items)
    assert len(index.windows) < 19 * 23
    assert leakage.search(index, [FILL, f"{FILL} {common}", None, common * 30]) == [(r, k) for r in (1, 3) for k in range(19)]


def test_edit_distance():
    a, b = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 3]]), np.array([[1, 2, 3], [2, 3, 4], [7, 8, 9]])
    assert leakage.edit_distances(a, b).tolist() == [0, 2, 3]
