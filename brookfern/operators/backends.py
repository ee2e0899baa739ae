"""Models behind one interface: embedding, reranking and generation, in Arrow batches with one client a task.

``StandIn`` is a deterministic backend without a model: hashed word vectors, shared words, the prompt's first
evidence line.  A real one is any object with the same three methods, made in each task by a factory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources import files
from . import tools


class ModelBackend(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...

    def rerank(self, queries: list[str], texts: list[str]) -> list[float]: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


class StandIn:
    """Hashed bags of words, normalised; the share of the query's words that a text has; a line of the prompt."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, t in zip(out, texts, strict=True):
            for word in t.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.width] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def rerank(self, queries: list[str], texts: list[str]) -> list[float]:
        pairs = ((set(q.lower().split()), set(t.lower().split())) for q, t in zip(queries, texts, strict=True))
        return [len(a & b) / max(1, len(a)) for a, b in pairs]

    def generate(self, prompts: list[str]) -> list[str]:
        return [next((x[2:] for x in p.splitlines() if x.startswith("- ")), "") for p in prompts]


#: Texts sent to a backend at once.
BATCH = 256


def _in_batches(df: DataFrame, inputs: list[str], name: str, kind: str, arrow: pa.DataType, factory: Callable[[], ModelBackend], call: Callable) -> DataFrame:
    """``df`` with column ``name``: call(backend, *input lists) for slices of each Arrow batch."""
    fields = [f for f in df.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                values = call(backend, *([x or "" for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in inputs))
                keep = [f.name for f in fields]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(values, arrow)], [*keep, name])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` {kind}"]))


def embedded(df: DataFrame, column: str = "text", name: str = "embedding", factory: Callable[[], ModelBackend] = StandIn) -> DataFrame:
    """``df`` with a vector for each text (null: that of an empty text)."""
    return _in_batches(df, [column], name, "array<float>", pa.list_(pa.float32()), factory, lambda b, texts: list(b.embed(texts)))


def embedded_once(df: DataFrame, store: str, column: str = "text", name: str = "embedding", factory: Callable[[], ModelBackend] = StandIn) -> DataFrame:
    """``embedded``, by way of a table at ``store`` of what was embedded before, keyed by the hash of the text.

    Equal texts go to the backend once, and not at all if the store has them; new vectors are added to it.  Two runs at
    once may add the same key: one of them is read."""
    spark = df.sparkSession
    key, schema = "key_", "key_ string, vector_ array<float>"
    keyed = df.withColumn(key, F.sha2(F.coalesce(F.col(column), F.lit("")), 256))
    known = files.exists(spark, store)
    wanted = keyed.groupBy(key).agg(F.first(F.coalesce(F.col(column), F.lit(""))).alias("text_"))
    if known:
        wanted = wanted.join(spark.read.schema(schema).parquet(store).select(key), key, "left_anti")
    embedded(wanted, "text_", "vector_", factory).select(key, "vector_").write.mode("append").parquet(store)
    once = spark.read.schema(schema).parquet(store).groupBy(key).agg(F.first("vector_").alias(name))
    return keyed.drop(name).join(once, key).drop(key)


def generated(df: DataFrame, prompt: str = "prompt", name: str = "answer", factory: Callable[[], ModelBackend] = StandIn) -> DataFrame:
    """``df`` with the answer to each prompt; an empty answer stands for a failure of the model."""

    def call(backend: ModelBackend, prompts: list[str]) -> list[str]:
        try:
            return backend.generate(prompts)
        except Exception:
            return [""] * len(prompts)

    return _in_batches(df, [prompt], name, "string", pa.string(), factory, call)


def reranked(hits: DataFrame, limit: int, factory: Callable[[], ModelBackend] = StandIn) -> DataFrame:
    """hits (query_id, query, text, rank, ...) by the backend's score; where it fails, in the order they came."""

    def call(backend: ModelBackend, queries: list[str], texts: list[str]) -> list[float | None]:
        try:
            return [float(x) for x in backend.rerank(queries, texts)]
        except Exception:
            return [None] * len(texts)

    scored = _in_batches(hits, ["query", "text"], "reranker_score", "double", pa.float64(), factory, call)
    own = Window.partitionBy("query_id")
    failed = F.count_if(F.col("reranker_score").isNull()).over(own) > 0
    score = F.when(failed, F.lit(None)).otherwise(F.col("reranker_score"))
    kept = scored.withColumn("reranker_score", score)
    return kept.withColumn("place", F.row_number().over(own.orderBy(F.col("reranker_score").desc_nulls_last(), "rank"))).filter(F.col("place") <= limit)


def rerank_by_overlap(hits: DataFrame, limit: int) -> DataFrame:
    """The stand-in's ranking as column functions: the share of the query's words that a text has."""
    asked, own = F.array_distinct(text.tokens(F.col("query"))), F.array_distinct(text.tokens(F.col("text")))
    score = F.size(F.array_intersect(asked, own)) / F.greatest(F.size(asked), F.lit(1))
    w = Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "rank")
    return hits.withColumn("reranker_score", score).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


@F.udtf(returnType=T.StructType([T.StructField("at", T.IntegerType()), T.StructField("sentence", T.StringType())]), useArrow=True)
class Sentences:
    """Sentences of a text with their places, for ``LATERAL``: white space collapsed, split after . ! and ?; none of a null or blank text."""

    def eval(self, body: str):  # noqa: ANN201
        flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", body or "").strip(" ")
        for at, sentence in enumerate(re.split(r"(?<=[.!?]) ", flat) if flat else []):
            yield at, sentence


def register(spark: SparkSession) -> None:
    """The library's functions under names for SQL: brookfern_tokens, brookfern_redact, brookfern_weather and the table function brookfern_sentences."""
    spark.udtf.register("brookfern_sentences", Sentences)
    schema = "array<string>"
    spark.udf.register("brookfern_tokens", F.pandas_udf(lambda s: s.fillna("").str.lower().str.findall(r"\w+"), schema))
    spark.udf.register("brookfern_weather", F.pandas_udf(lambda s: s.map(lambda c: tools.WEATHER.get(c, f"Weather code {c}")), "string"))
