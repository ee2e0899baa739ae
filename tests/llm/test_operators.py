"""Each training-data operator against brute force on small fixtures, edge cases included."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookfern.llm import bpe, common, html, imatch, language, lines, mixing, ppm, simhash, suffix, topk

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "x" * 5000), (7, "a b c d e f g " * 50), (7, "a b c d e f g " * 50), (8, "naïve 中文 😀 <|endoftext|> end"), (None, "no id here at all")]


def test_bpe_equals_library_and_round_trips(docs):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rows = bpe.decode(bpe.encode(docs([*EDGES, (9, "hahahaha aaaaaaa'll  \n\n x")]), path), path).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.score == "kept"
    assert bpe.digests(docs([]), path).count() == 0


def test_bpe_refuses_other_vocabularies():
    import json

    spec = json.loads(open(bpe.default_vocabulary(), "rb").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError, match="vocabulary asks for"):
            bpe.ByteBpe(json.dumps(spec | change).encode())


def test_bpe_store_keeps_short_words_only():
    model = bpe.ByteBpe(open(bpe.default_vocabulary(), "rb").read())
    first = model.encode_batch(["short " + "y" * 500])[0].tolist()
    assert model.encode_batch(["short " + "y" * 500])[0].tolist() == first and max(map(len, model.known)) <= bpe.REMEMBERED_LETTERS


def test_imatch_equal_texts_and_edits(docs, spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30))) for i in range(20)] + [(20, None), (21, ""), (22, "w1 w2"), (23, " ".join(f"w{(7 + j) % 40}" for j in range(30)))]
    df = docs(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = imatch.lexicon(df)
    df = df.withColumn("prints", imatch.fingerprint("text", words))
    got = {r.doc_id: r for r in imatch.with_next(df, ["text", "prints"]).withColumn("edited", imatch.edited(F.col("text"), F.col("next_text"))).withColumn("near", imatch.likeness(F.col("prints"), F.col("next_prints"))).collect()}
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        gone = len(t) // 4
        assert got[i].edited == t[: len(t) - gone] + following[:gone] and 0 <= got[i].near <= 1
    assert got[1].prints == got[23].prints != got[2].prints
    assert imatch.with_next(df.limit(0), ["text"]).count() == 0


def test_imatch_equals_brute_force(docs, spark):
    rng = random.Random(6)
    pool = [f"Word{i}" for i in range(300)]
    rows = [(i, "\t".join(rng.choice(pool[: rng.choice([40, 300])]) for _ in range(rng.choice([3, 15, 60])))) for i in range(60)]
    rows += [(60 + i, t) for i, t in enumerate([None, "", "alone", "rare terms only here", rows[0][1]])]
    df = docs(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = {d: sorted({w for w in (t or "").lower().split()}) for d, t in rows}
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for ws in terms.values() for w in ws], "w string").distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    found = {w: sum(w in ws for ws in terms.values()) for w in hashed}
    band = {hashed[w] for w, n in found.items() if max(2, imatch.LEAST * len(rows)) <= n <= imatch.MOST * len(rows)}
    assert imatch.lexicon(df) == sorted(band)
    got = {r.doc_id: r for r in df.withColumn("prints", imatch.fingerprint("text", sorted(band))).withColumn("shown", imatch.as_text(F.col("prints"))).collect()}
    lists, used = [], {}
    for d, ws in terms.items():
        own = [hashed[w] for w in ws]
        known = [h for h in own if h in band]
        used[d] = sorted(known + sorted(h for h in own if h not in band)[: max(0, imatch.FEW - len(known))])
        for k in range(imatch.SUBSETS):
            lists.append((d, k, [h for h in used[d] if h % imatch.SUBSETS == k]))
    want = {(r.d, r.k): r.h for r in spark.createDataFrame(lists, "d long, k int, own array<long>").select("d", "k", F.when(F.size("own") > 0, F.xxhash64("own")).alias("h")).collect()}
    for d, _ in rows:
        assert got[d].prints == [want[d, k] for k in range(imatch.SUBSETS)]
        assert got[d].shown == "".join("-" * 16 if want[d, k] is None else f"{want[d, k] % (1 << 64):016x}" for k in range(imatch.SUBSETS))
    assert got[64].shown == got[0].shown and len({r.shown for r in got.values()}) == len({tuple(u) for u in used.values()})
    assert any(len(u) < 2 * imatch.FEW for u in used.values())


def test_imatch_edits_stay_nearer_than_others(spark, sf):
    from brookfern.llm import queries

    rows = [r for r in queries.QUERIES["op2_imatch"](spark, sf).collect() if r.n_chars >= 400]
    assert sum(r.near_edited > r.near_next or r.near_edited == 1 for r in rows) >= 0.95 * len(rows)


def test_imatch_next_over_many_ranges(docs, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    ids = [None, *sorted(random.Random(3).sample(range(1000), 120)), 500, 500]
    df = docs([(i, f"text {i} {n}") for n, i in enumerate(ids)]).select("doc_id", "text")
    got = imatch.with_next(df, ["text"]).collect()
    order = sorted(((i is not None, i or 0, f"text {i} {n}") for n, i in enumerate(ids)))
    want = {a[2]: b[2] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.text: r.next_text for r in got} == want


def test_language_spans_and_edges(docs, spark):
    en, de = "the cat and the dog were there with them ", "der hund und die katze waren dort mit ihnen "
    train = spark.createDataFrame([("en", en * 5), ("de", de * 5), ("el", "το σκυλι και η γατα " * 5), ("de", None)], "lang string, text string")
    model = language.fit(train)
    got = {r.doc_id: r for r in language.identify(docs([*EDGES, (20, en), (21, de), (22, en * 4 + de * 2), (23, "η γατα"), (24, "12 34")]), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[24].lang_pred == "und" and got[1].score == 0
    assert got[20].lang_pred == "en" and got[21].lang_pred == "de" and got[23].lang_pred == "el"
    assert [s.lang for s in got[22].spans] == ["en", "de"] and got[22].lang_pred == "en" and 0 < got[22].score <= 1
    empty = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.identify(docs(EDGES), empty).collect()} == {"und"}


def test_language_viterbi_is_optimal():
    import itertools

    model = language.Model(pa.table({"lang": ["a", "b", "c"], "cell": [0, 1, 2], "times": [1, 1, 1]}))
    rng = np.random.default_rng(1)
    for lengths in ([5], [0, 3, 1, 4], [2, 2]):
        scores = rng.normal(0, 10, (sum(lengths), 3))
        labels = model.label(scores, np.array(lengths))
        at = 0
        for n in lengths:
            s = scores[at : at + n]

            def value(path, s=s):
                return (model.prior[path[0]] if path else 0) + sum(s[i, k] for i, k in enumerate(path)) - language.SWITCH * sum(x != y for x, y in zip(path, path[1:], strict=False))

            best = max(map(value, itertools.product(range(3), repeat=n))) if n else 0
            assert abs(value(tuple(labels[at : at + n].tolist())) - best) < 1e-9
            at += n


def test_language_of_many():
    names = [f"l{i:03d}" for i in range(300)]
    # Language i has a trigram of its own; the word with it must be labelled i.
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    cells = [language.Words([w]) for w in words]
    rows = [(n, int(c), 50) for n, w in zip(names, cells, strict=True) for c in w.cells] + [(n, language.BUCKETS + 1, 100) for n in names]
    model = language.Model(pa.table({"lang": [r[0] for r in rows], "cell": pa.array([r[1] for r in rows], pa.int32()), "times": [r[2] for r in rows]}))
    assert language._group(model, [" ".join([words[290]] * 30), " ".join([words[3]] * 30)])[0] == [names[290], names[3]]


def test_html_blocks():
    page = "<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><a href=a>Menu</a></nav><article><h1>Head &amp; line</h1><p>First  para<b>graph</b>, long enough.<br>Same block<p>Second one.</article><div class='comments'><p>Nice article, I liked it very much indeed.</p></div><footer>&copy; me</footer>"
    assert html.main_text(page) == "Head & line\n\nFirst paragraph, long enough. Same block\n\nSecond one."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


PAGES = {
    "<p>Hello there, world.</p><svg viewBox='0'/><p>Second paragraph here, it is.</p>": "Hello there, world.\n\nSecond paragraph here, it is.",
    "<article><p>First one is here, ok.</p><button>Share<p>Second paragraph here.</p><p>Third one.</p></article>": "First one is here, ok.\n\nSecond paragraph here.\n\nThird one.",
    "<article><p>First one is here, ok.</p><select><option>a<option>b<p>Second paragraph here.</p></article>": "First one is here, ok.\n\nSecond paragraph here.",
    "<article><p>First one is here, ok.</p><iframe src=x><p>Second paragraph here.</p></article>": "First one is here, ok.\n\nSecond paragraph here.",
    "<article><button>Menu</button><p>Text, of <button type=b><div>x</div></button>course.</p></article>": "Text, of course.",
    "<p class='social-history'>The social history of the town began long ago, with many people.</p>": "The social history of the town began long ago, with many people.",
    "<section class='notice-of-death'><p>The notice was sent to all of the family members.</p></section>": "The notice was sent to all of the family members.",
    "<article id='widget-theory'><p>Widgets are made in theory.</p><p>Short.</p></article>": "Widgets are made in theory.\n\nShort.",
    "<article><p>Real text here, fine. <span class='advert'>Buy <span>x</span> now cheap!</span> More text follows it.</p></article>": "Real text here, fine. More text follows it.",
    "<article><p>Some words <span class='social-note'>and these</span> in a sentence, which goes on.</p></article>": "Some words and these in a sentence, which goes on.",
    "<div data-u=/x/>Some text in a div, long enough to be kept.</div>": "Some text in a div, long enough to be kept.",
    "<p>\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130</p><script>x</script><p>Following text stays here, whole.</p>": "\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130\n\nFollowing text stays here, whole.",
    "<article><p>One of the texts.</p><p class='advert'>Buy it now, limited offer only today.</p><p>All rights reserved.</p></article>": "One of the texts.\n\nAll rights reserved.",
    "<div class='post-content'><p>Alpha text.</p><ul><li>Item one</li><li>Item two</li></ul><p>Omega text.</p></div>": "Alpha text.\n\nItem one\n\nItem two\n\nOmega text.",
    "<body><header><h1>Site name</h1></header><div id='cookie-banner'><p>We use cookies, please accept all of them.</p></div><main><h1>Title</h1><p>Body text of it.</p>"
    "<div class='newsletter-signup'><p>Subscribe to our newsletter.</p></div></main><div class='comment-thread'><p>Nice article, thanks a lot for it!</p></div><footer>&copy; 2020</footer></body>": "Title\n\nBody text of it.",
}


@pytest.mark.parametrize("page", PAGES)
def test_html_pages(page):
    assert html.main_text(page) == PAGES[page]


def test_html_neighbours_decide():
    # The same paragraph, doubtful by its name, stays among content and goes among boilerplate.
    doubtful = "<p class='promo'>A few words stand here.</p>"
    article = "<article>" + "<p>Long enough prose stands in this place, and there is more of it to be read.</p>" * 2
    assert "A few words" in html.main_text(f"{article}<p class='promo-essay'>A few words stand here.</p></article>")
    assert html.main_text(f"<div>{doubtful * 2}<p>Few words</p></div>") == ""


def fixture_article(page):
    """The article of the fixture pages by their fixed shape: its blocks without markup."""
    import html as entities
    import re

    inner = re.search(r"<article>(.*)</article>", page, re.S)
    blocks = re.split(r"</?(?:h1|p)\b[^>]*>", inner[1]) if inner else []
    return "\n\n".join(t for t in (" ".join(entities.unescape(re.sub(r"<[^>]*>", " " , b)).split()) for b in blocks) if t)


def test_html_fixture_pages(spark, sf):
    from collections import Counter

    hit = got = want = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        own, true = Counter(html.main_text(r.html).split()), Counter(fixture_article(r.html).split())
        hit, got, want = hit + (own & true).total(), got + own.total(), want + true.total()
    assert hit >= 0.99 * got and hit >= 0.99 * want  # precision and recall in words


def test_html_minimum_cut():
    import itertools

    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 7)
        lean = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels, lean=lean, edges=edges):
            return sum(abs(x) for x, s in zip(lean, labels, strict=True) if (x > 0) != bool(s) and x) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert abs(cost(html.min_cut(lean, edges)) - min(map(cost, itertools.product((0, 1), repeat=n)))) < 1e-9


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Body text here.</p></article>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {1: "Body text here.", 2: ""}


def simhash_reference(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def classes_reference(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in prints}


def test_simhash_prints(docs):
    got = {(r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs(EDGES)).collect()}
    assert got == {(d, simhash_reference(t)) for d, t in EDGES}


@pytest.mark.parametrize("hot", [1, 32])
def test_simhash_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    prints = set()
    for base in (rng.getrandbits(64) for _ in range(6)):
        for _ in range(15):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, 1, 3, (1 << 64) - 1}
    ids = {i: p for i, p in enumerate(sorted(prints))}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = {r.node % (1 << 64): r.root for r in found}
    want = classes_reference(ids)
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(ids[i])
    for members in groups.values():
        assert len({root.get(m, "alone") if len(members) > 1 else "one" for m in members}) == 1
    assert len({root[m] for g in groups.values() if len(g) > 1 for m in g}) == sum(len(g) > 1 for g in groups.values())


def test_simhash_empty_table(docs):
    assert simhash.classes(docs([])).count() == 0


def test_lines(docs):
    rows = [(i, f"own line {i}\n  shared line \nmiddle {i // 3}\n\n") for i in range(12)] + [(50, None), (51, ""), (None, "shared line"), (52, "shared line\nshared line\r")]
    got = {r.doc_id: r for r in lines.cleaned(docs(rows, lambda d: None if d == 5 else f"s{d}"), min_sites=6).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0 and got[0].score == "kept"
    assert got[5].text == "own line 5\nmiddle 1\n\n" and got[5].n_lines == 3 and got[5].n_chars == len(got[5].text)
    assert got[52].text == "" and got[52].n_removed == 2 and got[50].text is None and got[51].text == "" and got[None].text == ""
    assert lines.cleaned(docs([])).count() == 0
    clash = docs([(i, f"shared line\nown {i}") for i in range(12)], lambda d: f"s{d}").withColumns({"n_lines": F.lit("mine"), "cut_at": F.lit(1), "cut_row": F.lit(2), "at": F.lit(3)})
    kept = lines.cleaned(clash, counts=False).collect()
    assert all((r.n_lines, r.cut_at, r.cut_row, r["at"]) == ("mine", 1, 2, 3) for r in kept) and sum(r.text == f"own {r.doc_id}" for r in kept) == 11
    assert {r.n_lines for r in lines.cleaned(clash).collect()} == {2}


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf"), 0.0]), (404, []), (405, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df.filter("vec_id % 50 = 0"), df, 5).collect()}
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q, a in good.items():
        if q % 50 == 0:
            scored = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b, strict=False))), i) for i, b in good.items() if i != q)
            want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:5])}
    assert got == want
    assert topk.search(df.limit(0), df, 5).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.search(few.filter("vec_id = 0"), few, 5).count() == 2


def test_ppm_counts_and_base(docs):
    rows = [(i, "The cat sat on the mat " * (i % 4 + 1) + f"word{i}") for i in range(60)] + [*EDGES[:6], EDGES[8]]
    rows = [(d + 100 if k >= 60 else d, t) for k, (d, t) in enumerate(rows)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in ppm.score(docs(rows), held, block_bytes=300).collect()}
    tokens = {d: [*(t or "").encode().lower().split(), b""] for d, t in rows}
    count, n = {}, 0
    for d, ts in tokens.items():
        if zlib.crc32(str(d).encode()) % 10:
            for t in ts:
                count[t] = count.get(t, 0) + 1
                n += 1
    for d, ts in tokens.items():
        base = sum(np.log10((count.get(t, 0) + 0.1) / (n + 0.1 * (len(count) + 1))) for t in ts)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(t in count for t in ts), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert ppm.score(docs([]), held).count() == 0


def ppm_reference(training, texts, order):
    """log10 probabilities of the bytes of texts, node by node in dictionaries."""
    from collections import Counter, defaultdict

    nodes = [defaultdict(Counter) for _ in range(order + 1)]
    for s in training:
        data = ppm._START + s
        for i in range(ppm.ORDER, len(data)):
            nodes[order][data[i - order : i]][data[i]] += 1
    longer = set()
    for s in training:  # below five bytes both orders count the contexts of the longer order
        data = ppm._START + s
        longer |= {data[i - ppm.ORDER : i + 1] for i in range(ppm.ORDER, len(data))}
    for k in range(order - 1, -1, -1):
        for t in {t[ppm.ORDER - k - 1 :] for t in longer}:
            nodes[k][t[1 : k + 1]][t[-1]] += 1
    return nodes


def ppm_code(nodes, escape, data, i, order):
    log, seen = 0.0, set()
    for k in range(order, -1, -1):
        node = nodes[k].get(data[i - k : i])
        if node is None:
            continue
        left = {b: c for b, c in node.items() if b not in seen}
        number = 8 if k == order != ppm.ORDER else k
        chance = escape[ppm._states(number, np.array([sum(node.values())]), np.array([len(node)]))[0]]
        if data[i] in left:
            return log + np.log10((1 - chance) * left[data[i]] / sum(left.values()))
        if left:
            log += np.log10(chance)
        seen |= set(node)
    return log - np.log10(256 - len(nodes[0].get(b"", ())))


def ppm_escapes(tries):
    grid = np.zeros((int(np.prod(ppm._STATES)), 2), np.int64)
    levels = {8 if order != ppm.ORDER else order: nodes[order] for order, nodes in tries.items()}
    for number, table in [*levels.items(), *((k, tries[ppm.ORDER][k]) for k in range(ppm.ORDER))]:
        for node in table.values():
            n, d = sum(node.values()), len(node)
            for c in node.values() if n > 1 else ():
                state = ppm._states(number, np.array([n - 1]), np.array([d - (c == 1)]))[0]
                grid[state, int(c == 1)] += c
    return ppm.escapes(grid)


@pytest.mark.parametrize("share", [1.0, 0.004])
def test_ppm_equals_brute_force(docs, monkeypatch, share):
    monkeypatch.setattr(ppm, "SPLIT_SHARE", share)
    rng = random.Random(11)
    pool = ["the", "cat", "then", "\u00e9t\u00e9", "catch", "a", "sat", "mat\x00", "mathematics", "of"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))) for i in range(50)] + [(60, None), (61, "unheard of \u4e2d"), (62, rows_text := "the cat sat " * 30), (63, rows_text)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in ppm.score(docs(rows), held, block_bytes=700).collect()}
    streams = {d: ppm.stream(t) for d, t in rows}
    training = [s for d, s in streams.items() if zlib.crc32(str(d).encode()) % 10]
    tries = {order: ppm_reference(training, streams.values(), order) for order in ppm.ORDERS}
    escape = ppm_escapes(tries)
    for d, s in streams.items():
        data, codes = ppm._START + s, []
        for i in range(ppm.ORDER, len(data)):
            codes.append([ppm_code(tries[order], escape, data, i, order) for order in ppm.ORDERS])
        ends = [i for i, b in enumerate(s) if b == 32]
        tokens = np.array([np.sum(codes[a:b], axis=0) for a, b in zip([0, *(e + 1 for e in ends[:-1])], [e + 1 for e in ends], strict=True)])
        want, log = 0.0, np.zeros(2)
        for t in range(len(tokens)):
            log = tokens[max(0, t - ppm.WINDOW) : t].sum(0)
            share = 10 ** (log - log.max())
            want += np.log10((share / share.sum() * 10 ** tokens[t]).sum())
        assert abs(got[d].score - want) <= len(s) / ppm.STEPS / 2 * 1.5 + 1e-6, (d, got[d].score, want)


def test_ppm_bytes_are_a_distribution():
    streams = [ppm.stream(t) for t in ("the cat sat on the mat", "then the car", "", "cat")]
    keys, counts = ppm._distinct(streams)
    split = {3: np.empty(0, np.uint64), 4: np.empty(0, np.uint64)}
    stats = pa.table(dict(zip(ppm._STAT_TYPES, ppm._stats(keys, counts, split), strict=True)))
    top = ppm.Top(stats, split)
    for context in (keys[0] >> np.uint64(8), keys[-1] >> np.uint64(8), np.uint64(123456789)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        levels = top.with_group(keys, counts)
        for order in ppm.ORDERS:
            assert abs((10 ** ppm.code_lengths(every, levels, top.escape, order)).sum() - 1) < 1e-9


def test_mixing_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([("a", 100)]) == [100.0]
    got = mixing.targets([("a", 100), ("b", 100), (None, 10)])
    assert got[2] == 30.0 and abs(sum(got) - 210) < 1e-9 and abs(got[1] / got[0] - 2) < 1e-9


def test_mixing(docs, spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 900)))) for i in range(300)] + [(500, None), (501, ""), (502, "one"), (502, "one"), (None, "null id words")]
    df = docs(rows, lambda d: None if d is None or d % 7 == 0 else f"s{d % 3}" if d % 11 else "tiny")
    got = mixing.takes(mixing.sized(df)).drop("pieces").collect()
    again = mixing.takes(mixing.sized(df.repartition(7))).drop("pieces").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken, goal = {}, {}
    for r in got:
        key = (r.source_size, r.target)
        taken[key], goal[key] = taken.get(key, 0) + r.taken, r.target
    assert all(abs(taken[k] - goal[k]) <= 0.05 * goal[k] + 3 * mixing.BLOCK for k in goal)
    out = {r.doc_id: r for r in mixing.mixed(df).collect()}
    for r in got:
        if r.taken and r.doc_id not in (502,):
            assert len(out[r.doc_id].text.split()) == r.taken and out[r.doc_id].score == "kept"
    twins = docs([(1, "a b c"), *((7, "the same words " * 200) for _ in range(4))], "only").withColumns({"mix_words": F.lit(1), "mix_key": F.lit(2)})
    kept = mixing.mixed(twins).collect()
    assert all((r.mix_words, r.mix_key) == (1, 2) for r in kept) and sum(len(r.text.split()) for r in kept) >= 0.9 * 2403
    assert mixing.takes(mixing.sized(docs([]))).count() == 0


def test_mixing_shards():
    slots = np.array([0, 5, 1000, 70_000])
    for shards in (1, 2, 7, 9):
        before = np.zeros(4, np.int64)
        for s in range(shards):
            own, at = mixing.shard_counts(slots, shards, s)
            assert (at == before).all()
            before += own
        assert (before == slots).all()
    assert abs(own[3] - 70_000 / 9) < 6 * (70_000 / 9) ** 0.5
    assert mixing.slot_counts(np.array([2.5, 0.4, 9.1]), np.array([3, 3, 8])).tolist() == [3, 1, 8]


def test_mixing_permutation():
    for size in (1, 2, 5, 64, 1000):
        got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 9))
        assert sorted(got.tolist()) == list(range(size))


def repeats_reference(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        out.append((d, len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_suffix(docs):
    rng = random.Random(8)
    base = ["".join(rng.choice("abc de\n") for _ in range(220)) for _ in range(4)]
    rows = [(i, rng.choice(base)[rng.randint(0, 90) :] + rng.choice(["", "é", "zz"]) + rng.choice(base)[: rng.randint(0, 220)]) for i in range(40)] + EDGES + [(60, "x" * 400), (61, "a" * 49)]
    got = sorted(((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), bytes(r.kept)) for r in suffix.repeats(docs(rows), block_bytes=2000).collect()), key=str)
    assert got == repeats_reference(rows)
    assert suffix.repeats(docs([])).count() == 0


def test_very_long_texts(docs):
    long = " ".join(f"w{i * i % 977}" for i in range(200_000))
    df = docs([(1, long), (2, long + " end"), (3, "short text"), (4, None)])
    prints = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("p", imatch.fingerprint("text", []))
    assert {len(r.p) for r in prints.collect()} == {imatch.SUBSETS}
    model = language.fit(df)
    assert {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
    scored = {r.doc_id: r for r in ppm.score(df, F.col("doc_id") == 2).collect()}
    assert scored[1].n_tokens == 200_001 and scored[2].n_tokens == 200_002 and scored[2].n_known == 200_001 and 0 > scored[2].score > scored[2].base_score
    taken = {r.doc_id: r for r in mixing.takes(mixing.sized(df)).collect()}
    assert taken[1]["size"] == 200_000 and 0 < taken[1].taken <= 600_000 and taken[4].taken == 0


def test_html_other_columns(spark):
    page = "<article><p>Body text here.</p></article>"
    df = spark.createDataFrame([(1, "u", page, "old", 7, "s", None)], "page_id long, url string, html string, text string, n_chars long, score string, path array<int>")
    row = html.extract(df).first()
    assert (row.text, row.n_chars, row.score, row.path, row.html) == ("Body text here.", 7, "s", None, page)


def test_topk_wide_and_repeated(spark):
    rows = [(i % 5, [float(i % 3)] * 700, i) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = topk.search(df.filter("block = 2"), df, 3).orderBy("rank").collect()
    assert [r.score for r in got] == [512 * 512 * 700] * 3 and all(r.vec_id != 2 for r in got)


def test_checkpoint_folder_is_the_session_s(spark):
    path = common.write_shared(spark.range(3), "probe")
    assert path.startswith(common.shared_dir(spark))


def test_queries_on_smallest_tables(spark, sf):
    from brookfern.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES["op6_lines"](spark, sf).count() == docs
    rows = queries.QUERIES["op3_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


def test_op6_equals_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, lines.op6_lines(spark, sf).collect())) == sorted(con.execute(lines.ORACLE).fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, sf), "test-pipeline")
        if name != "BPE encoding":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out if name != "BPE encoding" else docs
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = bpe.ByteBpe(open(bpe.default_vocabulary(), "rb").read())
    for r in out.collect():
        own = ids.encode_batch([texts[r.doc_id]])[0].tolist()
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
