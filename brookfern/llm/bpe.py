"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The vocabulary comes from a ``tokenizer.json`` file (its path is a parameter).  Distinct
words of a batch are laid out as symbols in one flat array.  Each round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each
word and applies that merge to all its occurrences, left to right; words without a
mergeable pair leave the array.  Encoded words are remembered in a bounded per-worker
store, so that a frequent word is merged once.

Defined results: a null text counts as empty (no ids); ids of an empty text are an empty
list; very long texts are encoded whole; special tokens in a text become their own id;
repeated rows are encoded alike; other columns pass through; a column already called like
the output is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pre-tokenisation pattern of byte-level BPE vocabularies (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers before it starts afresh.
REMEMBERED_WORDS = 250_000
#: Longer words are merged each time, so that the store is bounded in bytes, too.
REMEMBERED_LETTERS = 40
_NONE = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


def _require_byte_level(spec: dict) -> None:
    """Raise if the file asks for steps that are not done here, as ids would then be wrong without a sign of it."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    asked = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "ignore_merges": model.get("ignore_merges"),
        "dropout": model.get("dropout"),
        "byte_fallback": model.get("byte_fallback"),
        "a subword prefix or suffix": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
        "a normalizer": spec.get("normalizer"),
        "a pre-tokenizer other than ByteLevel": before.get("type") != "ByteLevel",
        "add_prefix_space": before.get("add_prefix_space"),
        "no regular expression": before.get("use_regex", True) is False,
        "added tokens that strip or stand alone": any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]),
    }
    if wrong := [what for what, is_so in asked.items() if is_so]:
        raise ValueError(f"this vocabulary asks for {', '.join(wrong)}")


class ByteBpe:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        _require_byte_level(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_rank = order.astype(np.int64)
        self.pair_merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self._prepare()

    def _prepare(self) -> None:
        import regex

        self.find_words = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find_words", "split_special", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each non-empty word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        last = len(self.pair_keys) - 1
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), last)
            rank = np.full(len(sym), _NONE)
            hit = (self.pair_keys[at] == key) & (owner[1:] == owner[:-1])
            rank[:-1][hit] = self.pair_rank[at[hit]]
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            done = least == _NONE
            if done.any():
                ids = sym.tolist()
                for w, s, n in zip(owner[starts[done]].tolist(), starts[done].tolist(), size[done].tolist(), strict=True):
                    out[w] = tuple(ids[s : s + n])
                if done.all():
                    break
            chosen = rank == np.repeat(np.where(done, -1, least), size)
            # Of overlapping occurrences (a run of chosen positions) every other one merges, from the left.
            where = np.flatnonzero(chosen)
            first = np.r_[True, np.diff(where) != 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            sym[where] = self.pair_merged[at[where]]
            keep = np.repeat(~done, size)
            keep[where + 1] = False
            sym, owner = sym[keep], owner[keep]
        return out

    def _words(self, text: str) -> list[str]:
        if self.split_special is None or not any(t in text for t in self.special):
            return self.find_words(text)
        return list(chain.from_iterable([p] if p in self.special else self.find_words(p) for p in self.split_special(text)))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        known, out = self.known, []
        for at in range(0, len(texts), 256):
            split = [self._words(t) if t else [] for t in texts[at : at + 256]]
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            if not known:
                known.update({t: (i,) for t, i in self.special.items()})
            new = [w for w in set().union(*split) if w not in known]
            if new:
                known.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
            out += [np.fromiter(chain.from_iterable(map(known.__getitem__, ws)), np.int32) for ws in split]
            for w in new:
                if len(w) > REMEMBERED_LETTERS:
                    del known[w]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _ship(spark: SparkSession, path: str):
    """A vocabulary (a few MB, fixed by its publisher), parsed once, for all workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(ByteBpe(f.read()))


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], [*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


#: Rows encoded at a time.
SLICE_ROWS = 500


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of column ``text`` as ``array<int>`` in column ``ids``.

    decoded: also decode the ids again, in the same worker, into the column of this name."""
    shipped = _ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        model = shipped.value
        for big in batches:
            for at in range(0, big.num_rows, SLICE_ROWS):
                batch = big.slice(at, SLICE_ROWS)
                rows = model.encode_batch(batch.column(batch.schema.get_field_index(text)).to_pylist())
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
                out = _replaced(batch, ids, values)
                yield out if decoded is None else _replaced(out, decoded, pa.array([model.decode(r.tolist()) for r in rows], pa.string()))
            common.trim()

    schema = _schema(df, ids, T.ArrayType(T.IntegerType()))
    if decoded is not None:
        schema = T.StructType([*(f for f in schema.fields if f.name != decoded), T.StructField(decoded, T.StringType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids in column ``ids`` in column ``text`` (null ids: empty)."""
    shipped = _ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        model = shipped.value
        for big in batches:
            for at in range(0, big.num_rows, SLICE_ROWS):
                batch = big.slice(at, SLICE_ROWS)
                column = batch.column(batch.schema.get_field_index(ids))
                texts = [model.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in column]
                yield _replaced(batch, text, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, text, T.StringType()))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of op1, from the ids and the decoded texts: one worker a task holds the vocabulary."""
    return encode(docs.select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), default_vocabulary())
