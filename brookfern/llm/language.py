"""Language identification of whole texts, mixed ones included.

Script ranges of a word's letters narrow the candidate languages to those that use the script.
Every word gets a score for each candidate from byte trigrams of the word between
blanks (naive Bayes over hashed trigrams), and Viterbi with a penalty for each switch labels
the words, so that a text falls into spans of one language.  The language of the text is the
one that labels most letters; the score is its share of the letters, weighed by how
clearly the text as a whole prefers it.

The model is learnt from the labelled training rows by one distributed count into
``BUCKETS`` cells per language (a size that does not depend on the data).

Defined results: null text, or text without letters, is ``und`` with score 0; a word without
candidates (a script that no language was trained in) takes no side; without training rows
everything is ``und``; ties go to the language that comes first by code point; repeated rows are
labelled alike; very long texts are labelled whole; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTH = 0.5
#: A language is a candidate for a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.01
#: Texts are labelled in groups of so many words at most (one text at least).
GROUP_WORDS = 200_000
#: Rows counted at a time.
SLICE_ROWS = 1000
UNKNOWN = "und"

#: First code points of script ranges and the script of each; the last holds to the end.
SCRIPTS = ("common", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han", "other")
_RANGES = ((0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0x2B0, 13), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 13), (0x900, 7), (0xE00, 8), (0xE80, 13), (0x10A0, 9), (0x1100, 10), (0x1200, 13), (0x1E00, 1), (0x1F00, 2), (0x2000, 13), (0x2C60, 1), (0x2C80, 13), (0x3040, 11), (0x3100, 13), (0x3130, 10), (0x3190, 13), (0x31F0, 11), (0x3200, 13), (0x3400, 12), (0xA000, 13), (0xAC00, 10), (0xD7B0, 13), (0xF900, 12), (0xFB00, 1), (0xFB10, 13), (0xFB50, 6), (0xFE00, 13), (0xFE70, 6), (0xFF00, 13), (0x20000, 12), (0x30000, 13))
_STARTS = np.array([a for a, _ in _RANGES])
_SCRIPT = np.array([b for _, b in _RANGES])
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


class Words:
    """Distinct lower-cased words of a batch: trigram cells, letters and scripts."""

    def __init__(self, words: list[str]):
        raw = [w.encode("utf-8", "replace") for w in words]
        data = np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8).astype(np.uint32) if raw else np.empty(0, np.uint32)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
        ends = np.cumsum(lengths)
        cells = ((data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]) if len(data) else data
        cells = (cells * np.uint32(2654435761)) >> np.uint32(16)
        whole = np.ones(len(cells), bool)
        for back in (1, 2):  # trigrams that reach into the next word
            whole[(ends - back)[ends - back < len(cells)]] = False
        self.cells = cells[whole].astype(np.int64)
        self.first = np.cumsum(lengths - 2) - (lengths - 2)
        self.sizes = lengths - 2
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[points]
        script = np.where(letter, _SCRIPT[np.searchsorted(_STARTS, points, "right") - 1], 0)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        self.letters = np.bincount(owner, letter, len(words)).astype(np.int64)
        by_script = np.bincount(owner[letter] * len(SCRIPTS) + script[letter], minlength=len(words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
        self.script = by_script.argmax(1)  # 0 only for words without letters
        self.by_script = by_script


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _counts(lang_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        texts: Counter = Counter()
        common.trim()
        for batch in (big.slice(at, SLICE_ROWS) for big in batches for at in range(0, big.num_rows, SLICE_ROWS)):
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, Counter()).update((text.as_py() or "").lower().split())
                texts[lang] += 1
            for lang, counter in by_lang.items():
                if not counter:
                    continue
                words = Words(list(counter))
                times = np.fromiter(counter.values(), np.int64, len(counter))
                lettered = times * (words.letters > 0)
                grid = np.bincount(words.cells, np.repeat(lettered, words.sizes), BUCKETS)
                cells[lang] = cells.get(lang, 0) + grid
                scripts[lang] = scripts.get(lang, 0) + times @ words.by_script
        for lang in texts:
            grid = np.concatenate([cells.get(lang, np.zeros(BUCKETS)), scripts.get(lang, np.zeros(len(SCRIPTS))), [texts[lang]]]).astype(np.int64)
            where = np.flatnonzero(grid)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(grid[where], pa.int64())], ["lang", "cell", "times"])
        cells.clear()
        common.trim()

    return run


class Model:
    def __init__(self, counted: pa.Table):
        """counted: lang, cell, times."""
        lang = counted.column("lang").combine_chunks().dictionary_encode()
        names = lang.dictionary.to_pylist()
        self.langs = sorted(names)
        place = np.array([self.langs.index(x) for x in names], np.int64)
        grid = np.zeros((len(self.langs), BUCKETS + len(SCRIPTS) + 1))
        if len(lang):
            grid[place[lang.indices.to_numpy()], counted.column("cell").to_numpy()] = counted.column("times").to_numpy()
        cells, scripts, texts = grid[:, :BUCKETS] + SMOOTH, grid[:, BUCKETS:-1], grid[:, -1]
        self.score = np.ascontiguousarray(np.log(cells / cells.sum(1, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.candidate = (share >= SCRIPT_SHARE).T  # script, language
        self.candidate[0] = False
        self.prior = np.log((texts + 1) / (texts + 1).sum()) if self.langs else texts

    def words(self, words: Words) -> np.ndarray:
        """Scores (word, language), as the lead over the best other score at hand; 0 where nothing speaks."""
        if not len(words.letters):
            return np.zeros((0, len(self.langs)))
        total = np.stack([np.add.reduceat(self.score[:, i][words.cells], words.first) if len(words.cells) else np.zeros(len(words.letters)) for i in range(len(self.langs))], 1).astype(np.float64)
        able = self.candidate[words.script]
        some = able.any(1) & (words.letters > 0)
        worst = np.where(able, total, np.inf).min(1, initial=np.inf)
        total = np.where(able, total, worst[:, None] - SWITCH)
        total[~some] = 0
        return total - total.max(1, keepdims=True)

    def label(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best language of each word of texts laid end to end, by Viterbi over all texts at once."""
        langs = len(self.langs)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")  # texts still running are a prefix
        begin = starts[order]
        alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        kind = np.uint8 if langs <= 256 else np.int32
        came = np.zeros(scores.shape, kind)
        best = np.zeros((len(lengths), langs))
        best[: alive[0] if len(alive) else 0] = scores[begin[: alive[0]]] + self.prior if len(alive) else 0
        here = np.arange(langs, dtype=kind)[None, :]
        for t in range(1, len(alive)):
            n = alive[t]
            now = best[:n]
            top = now.argmax(1)
            leap = now[np.arange(n), top][:, None] - SWITCH
            stay = now >= leap
            came[begin[:n] + t] = np.where(stay, here, top[:, None].astype(kind))
            best[:n] = np.where(stay, now, leap) + scores[begin[:n] + t]
        out = np.zeros(len(scores), kind)
        if not len(alive):
            return out
        state = best.argmax(1).astype(kind)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            out[at] = state[:n]
            state[:n] = came[at, state[:n]] if t else state[:n]
        return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Learn from every row of ``docs`` with a language; what is gathered has a fixed size per language."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_counts(pa.string()), "lang string, cell int, times long").groupBy("lang", "cell").agg(F.sum("times").alias("times"))
    return Model(counted.toArrow())  # BUCKETS cells and a few more for each language, as columns


def _group(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
    numbers = _Numbers()
    rows = [np.fromiter(map(numbers.__getitem__, (t or "").lower().split()), np.int32) for t in texts]
    words = Words(list(numbers))
    scores = model.words(words)
    ids = np.concatenate([np.empty(0, np.int32), *rows])
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    labels = model.label(scores[ids], lengths)
    letters = words.letters[ids]
    owner = np.repeat(np.arange(len(rows)), lengths)
    langs = len(model.langs)
    share = np.bincount(owner * langs + labels, letters, len(rows) * langs).reshape(-1, langs)
    own = np.stack([np.bincount(owner, scores[ids, i], len(rows)) for i in range(langs)], 1)
    total = share.sum(1)
    best = share.argmax(1)
    lead = own + model.prior
    lead = np.exp(np.minimum(lead[np.arange(len(rows)), best][:, None] - lead, 50))
    sure = 1 / np.maximum((1 / np.maximum(lead, 1e-20)).sum(1), 1)
    # A text that falls into several languages is less sure, but no less a text in the one that labels most of it.
    value = np.where(total > 0, share.max(1) / np.maximum(total, 1) * (0.5 + 0.5 * np.minimum(sure, 1)), 0.0)
    names, spans = [], []
    ends = np.cumsum(lengths)
    for i, (b, n) in enumerate(zip(best.tolist(), total.tolist(), strict=True)):
        names.append(model.langs[b] if n > 0 else UNKNOWN)
        own_labels = labels[ends[i] - lengths[i] : ends[i]]
        cut = np.flatnonzero(np.r_[True, np.diff(own_labels) != 0, True]) if len(own_labels) else np.zeros(1, np.int64)
        spans.append([{"lang": model.langs[own_labels[a]], "first_word": int(a), "words": int(z - a)} for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
    return names, value.tolist(), spans


def identify(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and spans (runs of words of one language); columns of these names are replaced."""
    added = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    if with_spans:
        span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
        added.append(("spans", "array<struct<lang: string, first_word: long, words: long>>", span))
    names = [n for n, _, _ in added]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS cells for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        model = shipped.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            keep = [n for n in batch.schema.names if n not in names]
            begin, size, texts = 0, 0, []
            column = batch.column(at)
            for row in range(batch.num_rows):
                texts.append(column[row].as_py())
                size += len(texts[-1] or "") // 6
                if size >= GROUP_WORDS or row == batch.num_rows - 1:
                    found = _group(model, texts) if model.langs else ([UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts))
                    part = batch.slice(begin, len(texts))
                    values = [pa.array(v, t) for v, (_, _, t) in zip(found, added, strict=False)]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *values], [*keep, *names])
                    begin, size, texts = row + 1, 0, []
            del column, batch
            common.trim()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in names), *(f"{n} {t}" for n, t, _ in added)])
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0; a row without doc_id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, with_spans=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")
