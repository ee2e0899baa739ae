"""Near-duplicate classes against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from brookfern.llm import near


def brute(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: grams(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and 9 * shared >= 4 * (len(sets[a]) + len(sets[b])) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in sets}


def texts():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for base in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(500)}"
            if rng.random() < 0.4:
                own = own[: len(own) - len(own) // rng.randint(5, 12)]
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("hot, tile", [(1, 3), (4, 2048), (32, 2048)])
def test_classes_equal_brute_force(docs, monkeypatch, hot, tile):
    monkeypatch.setattr(near, "HOT", hot)
    monkeypatch.setattr(near, "TILE", tile)
    rows = texts()
    assert {r.doc_id: r.component_id for r in near.classes(docs(rows), block_bytes=3000).collect()} == brute(rows)


def test_edges(docs):
    same, other = "same text of some words", "wholly other words than those"
    rows = [(5, same), (3, same), (3, same), (3, other), (4, other), (9, None), (8, ""), (None, same), (None, same)]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.score) for r in near.deduplicated(docs(rows)).collect())
    assert kept == [(False, 3, same, "kept"), (False, 3, other, "kept"), (False, 8, "", "kept"), (True, 0, same, "kept"), (True, 0, same, "kept")]
    assert near.deduplicated(docs([])).count() == 0 and near.deduplicated(docs([(None, same)])).count() == 1


def test_stage_drops_near_copies(docs, spark):
    import corpus_pipeline

    rows = texts()
    want = brute(rows)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()}
    assert kept == {d for d in want if want[d] == d}
