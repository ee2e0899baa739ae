"""Fill-in-middle against a plain list of units, and whole rows back from output and form."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brookfern.llm import fim


def brute(doc_id, text, plain=10, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def rows():
    rng = random.Random(3)
    pool = ["a", "Bc", "é", "中", "😀", " ", "\n", "9", "<", ">", "P", "ÿ", "`", "{", "@", "["]
    out = [(i, "".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 7, 60, 400])))) for i in range(150)]
    edges = [None, "", "x", "only", "...", "a <P> b", "half < P>", "<S", "<M>", "é" * 5000, "ab" * 100_000 + "é", "1" * 300_000, "naïve 😀 text"]
    return out + [(1000 + i, t) for i, t in enumerate(edges)] + [(7, "twice here"), (7, "twice here"), (None, "no id at all"), (None, None)]


@pytest.mark.parametrize("piece, rates", [(4 << 20, (10, 20)), (50, (0, 50))])
def test_equals_brute_force(docs, monkeypatch, piece, rates):
    monkeypatch.setattr(fim, "PIECE_BYTES", piece)
    given = rows()
    out = fim.transformed(docs(given).withColumn("fim_text", F.lit(1)).withColumn("n", F.lit("old")), rates=fim.Rates(*rates)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == sorted((str(d), n, f, str(p), str(m), o) for d, t in given for n, f, p, m, o in [brute(d, t, *rates)])
    assert all(r.back == (r.text or "") and r.score == "kept" and r.fim_text == 1 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_runs_are_few_and_flat():
    import pyarrow as pa

    texts = pa.array(["skip", "abc def", "", "ÄÖ--x", "x"]).slice(1)
    runs = fim.Runs(texts)
    assert runs.totals().tolist() == [3, 0, 5, 1]
    assert len(runs.units) - 1 == 6  # abc, space, def, ÄÖ--, x, x
    import numpy as np

    assert runs.offsets(np.array([2, 0, 3, 1])).tolist() == [4, 0, 3, 1]


def test_empty_table(docs):
    assert fim.transformed(docs([])).count() == 0
