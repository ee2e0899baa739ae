"""Collocations by pivot partitioning against plain counting of all n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brookfern.llm import phrases


def brute(rows, least=30, reported=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            if words:
                sizes[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, found in counts.items():
        cand = {g: c for g, c in found.items() if len(g) > 1 and c >= least}
        rows_of = []
        for g, a in cand.items():
            if any(100 * c >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in cand.items() if len(h) > len(g)):
                continue
            score, k = min((2_000_000 * a // (found[g[:k]] + found[g[k:]]), k) for k in range(1, len(g)))
            rows_of.append((-score, -a, b" ".join(g), found[g[:k]], found[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(11)
    pool = ["the", "The", "of", "naïve", "Ünder", "word", "x", "中文", "rare", "tail"]
    weights = [30, 10, 20, 10, 5, 5, 4, 3, 2, 1]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "!", " ; "]
    rows = []
    for i in range(120):
        body = "".join(rng.choices(pool, weights)[0] + rng.choice(gaps) for _ in range(rng.choice([1, 5, 60, 150])))
        rows.append((body, rng.choice(["en", "de", None, "und"])))
    rows += [("New York City is large. new york", "en")] * 40 + [("a a a a a a", "rep")] * 12 + [("b a b a b a, b a c", "rep")] * 20
    rows += [(None, "en"), ("", "en"), (" \n.,", "de"), (None, None), ("the end of " * 20_000, "long"), ("one two\x0bone two", "de")]
    return rows


@pytest.mark.parametrize("block, salt", [(4 << 20, 1 << 22), (2000, 1 << 22), (1000, 40)])
def test_equals_plain_counting(spark, block, salt):
    rows = texts()
    docs = spark.createDataFrame([(i % 7 or None, t, lang, "a", 1, "w") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, a string, n long, words string")
    found = phrases.collocations(docs, block, salt)
    got = sorted(tuple(r) for r in found.collect())
    want = brute(rows)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got == want and len({lang for lang, *_ in want}) >= 5
    assert any(len(r[2].split()) == k for r in want for k in (2, 3, 4))


def test_report_is_cut_with_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "REPORTED", 7)
    rows = [(f"p{i} q{i} p{i}", "en") for i in range(12) for _ in range(30 + i % 3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == brute(rows, reported=7)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "few words", "en")], none.schema)).count() == 0


def test_pairs_of_large_numbers_stay_apart():
    a = np.array([0, 5, 5, 1 << 40, 1 << 40])
    b = np.array([1 << 40, 3, 3, 0, 7])
    key = phrases._pair(a, b)
    assert key[1] == key[2] and len(set(key.tolist())) == 4


def test_arithmetic_passes_64_bits(spark):
    big = 10**15
    words = spark.createDataFrame([("en", "a", big, 0), ("en", "b", big + 1, 1)], "lang string, word string, f long, word_rank long")
    row = phrases.scored(words, spark.createDataFrame([([0, 1], big - 1)], "words array<long>, a long")).collect()[0]
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1)
