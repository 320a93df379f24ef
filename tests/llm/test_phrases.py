"""Phrase mining against plain counts of all phrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain_top(rows, top=phrases.TOP):
    out = []
    by_lang = collections.defaultdict(list)
    for lang, text in rows:
        by_lang[lang or "und" if lang is None else lang].append(text)
    for lang, texts in by_lang.items():
        f = collections.Counter(tuple(w[i : i + m]) for t in texts for w in pieces_of(t) for i in range(len(w)) for m in range(1, min(4, len(w) - i) + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= phrases.LEAST}
        gone = {q[i : i + m] for q, b in cands.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= 80 * f[q[i : i + m]]}
        found = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, rows, top=phrases.TOP):
    # further columns whose names the operator uses itself
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, phrase string").repartition(3)
    return sorted(map(tuple, phrases.top_phrases(df, top).collect()))


def some_rows(rng, n):
    vocab = ["the", "The", "of", "new york", "new", "york", "city", "a\x01", "a", "é", "日本", "x" * 300, "-", "''", "\xa0"]
    end = lambda: rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "!?"])
    text = lambda: "".join(rng.choice(vocab) + end() for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "en", "de", None, ""]), text()) for _ in range(n)]


def test_top_equals_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 3000)  # many shards
    rng = random.Random(13)
    rows = some_rows(rng, 300) + [("en", None), ("en", ""), (None, " \t. "), ("en", "the of " * 3000), ("one", "no phrase here"), ("en", "glued"), ("en", "word")] + [("en", "copies of one text, copies of one text")] * 40
    assert mined(spark, rows) == plain_top(rows)
    assert mined(spark, rows, 3) == plain_top(rows, 3)
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("en", "a b c")]) == []


def test_words_and_pieces():
    texts = ["Ab,cd ef", None, "", "gh", "ij. kl\tmn", "op", " ", "qr"]
    ids, words = phrases.word_ids(pa.array(texts))
    want = [p for t in texts for p in pieces_of(t) if p]
    got, piece = [], []
    for i in [*ids, -1]:
        if i < 0:
            got.append(piece)
            piece = []
        else:
            piece.append(words[i].decode())
    assert got == want and words == sorted(words)
    assert phrases.word_ids(pa.array(["", None], pa.string()))[1] == []


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_trie_counts_and_order(depth):
    rng = random.Random(depth)
    ids = np.array([rng.choice([-1, 0, 1, 2, 3]) for _ in range(400)])
    words = [b"a", b"b", b"c", b"d"]
    trie = phrases.Trie(ids, words, depth)
    for level in range(1, depth + 1):
        want = collections.Counter(tuple(ids[i : i + level]) for i in range(len(ids) - level + 1) if (ids[i : i + level] >= 0).all())
        names, _, counts = trie.phrases(level)
        got = list(zip(names.to_pylist(), counts.tolist(), strict=True))
        assert got == sorted((b" ".join(words[i] for i in p), c) for p, c in want.items())


def test_filter_has_no_false_negatives(spark):
    some = [("en", f"word{i}") for i in range(500)] + [("de", "zwei worte")]
    token = phrases._filter_of(spark.createDataFrame(some, "lang string, phrase string"))
    found = phrases._loaded(token)
    h = phrases._hashes([f"word{i}".encode() for i in range(1000)])
    assert found.has(h, "en")[:500].all() and found.has(h, "en")[500:].sum() < 5 and found.has(h, "de").sum() < 5
    two = phrases._hashes([b"zwei", b"worte"])
    assert found.has(phrases._pair_hashes(two[:1], two[1:]), "de").all()
