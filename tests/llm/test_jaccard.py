"""Jaccard classes by the count-vector R-tree against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from brookfern.llm import jaccard


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, size, component) of each row; rows are told apart by their place."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def texts():
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one\ttwo three"), (6, "word " * 9), (7, "word " * 40)]
    passage = [f"p{i}" for i in range(60)]
    for base in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 12, 60, 150]))]
        for _ in range(13):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(500)}"
            if rng.random() < 0.4:
                own = own[: len(own) - len(own) // rng.randint(4, 12)]
            rows.append((len(rows), " ".join(own)))
    # A passage that is 85 % of many texts: they share it, and are not similar by it alone.
    rows += [(200 + i, " ".join([*passage, *(f"o{i}_{j % 2 * i}_{j}" for j in range(8 + i % 4))])) for i in range(20)]
    return rows


@pytest.mark.parametrize("hot, page, bucket", [(32, 1024, 1 << 16), (1, 2, 5), (2, 1024, 9)])
def test_classes_equal_brute_force(docs, monkeypatch, hot, page, bucket):
    for name, value in (("HOT", hot), ("PAGE_POINTS", page), ("BUCKET_POINTS", bucket)):
        monkeypatch.setattr(jaccard, name, value)
    rows = texts()
    got = jaccard.classes(docs(rows), block_bytes=3000).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_edges(docs):
    same, long = "some text of more than five words", "very long text " * 60_000
    rows = [(5, same), (3, same), (3, same), (3, "another text that is here of its own"), (9, None), (9, ""), (None, same), (None, "alone and without id so without name"), (None, None), (7, long), (8, long + "end")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.classes(docs(rows)).collect())
    want = [("3", 3, "3"), ("3", 3, "3"), ("5", 3, "3"), ("3", 4, "3"), ("9", 0, "9"), ("9", 0, "9"), ("None", 3, "3"), ("None", 3, "None"), ("None", 0, "None"), ("7", 3, "7"), ("8", 4, "8")]
    assert got == sorted(want) == brute(rows)
    assert jaccard.classes(docs([])).count() == 0 and jaccard.classes(docs([(1, None)])).collect()[0].component_id == 1


@pytest.mark.parametrize("n, chunk", [(1, 7), (7, 9), (8, 64), (9, 1 << 14), (200, 100), (200, 1 << 14)])
def test_tree_loses_no_pair(n, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = np.random.default_rng(n)
    points = rng.poisson(3, (n, jaccard.GROUPS)).astype(np.int32)
    points[n // 2 :] = points[: n - n // 2] + rng.poisson(0.1, (n - n // 2, jaccard.GROUPS)).astype(np.int32)
    sizes, address = points.sum(1) + rng.integers(0, 9, n), rng.integers(0, 3, n)

    def passes(p, s, q, t):
        return 180 * np.minimum(p, q).sum() >= 80 * (s + t)

    got = sorted(tuple(sorted(x)) for i, j in jaccard.Tree(points, sizes, address).join() for x in zip(i.tolist(), j.tolist(), strict=True))
    assert got == [(i, j) for i in range(n) for j in range(i + 1, n) if address[i] == address[j] and passes(points[i], sizes[i], points[j], sizes[j])]
    few = max(1, n // 9)
    other = jaccard.Tree(points[:few], sizes[:few])
    got = sorted(x for i, j in jaccard.Tree(points, sizes).join(other) for x in zip(i.tolist(), j.tolist(), strict=True))
    assert got == [(i, j) for i in range(n) for j in range(few) if passes(points[i], sizes[i], points[j], sizes[j])]


def test_counts_keep_their_width():
    rows = np.zeros((4, jaccard.GROUPS), np.int64)
    rows[1, 3], rows[2, 5], rows[3, 7] = 255, 256, 70_000
    packed = jaccard._narrow(rows)
    assert [len(p) for p in packed] == [64, 64, 128, 256] and (jaccard._wide(packed) == rows).all()
