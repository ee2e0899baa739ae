"""Tools over the library's tables: a registry, a read-only dispatcher, weather labels and places, formatted output."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import store

# Weather codes of the forecast service and their labels, and the likeness from which names of places agree.
WEATHER = {0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Depositing rime fog", 51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle", 61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain", 71: "Slight snow", 73: "Moderate snow", 75: "Heavy snow", 80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers", 95: "Thunderstorm", 96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail"}
ALIKE = 0.78
MOST_PLACES = 30


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    call: Callable[..., DataFrame]
    read_only: bool = True
    metadata: dict[str, str] = field(default_factory=dict)


class Registry:
    """Tools by name; a second one of a name is refused."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"there is a tool {tool.name} already")
        self._tools[tool.name] = tool

    def specs(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.description, t.read_only, t.metadata) for t in sorted(self._tools.values(), key=lambda t: t.name)]
        return spark.createDataFrame(rows, "tool_name string, description string, read_only boolean, metadata map<string, string>")

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self._tools:
            raise KeyError(f"there is no tool {name}")
        return self._tools[name].call(**arguments)


def clamped(limit: int | None, most: int = 50, default: int = 10) -> int:
    return max(1, min(most, default if limit is None else limit))


def table_tools(spark: SparkSession, tables: dict[str, DataFrame], traces: DataFrame, feedback: DataFrame) -> Registry:
    """list_tables, preview_table, recent_traces and feedback_summary over the tables given; nothing else can be read."""

    def preview(table: str, limit: int | None = None) -> DataFrame:
        if table not in tables:
            raise KeyError(f"there is no table {table}")
        return store.preview(tables[table], clamped(limit))

    registry = Registry()
    registry.register(Tool("list_tables", "Tables and their row counts.", lambda: store.table_catalog(spark, tables)))
    registry.register(Tool("preview_table", "First rows of a table.", preview))
    registry.register(Tool("recent_traces", "The newest traces.", lambda limit=None: traces.orderBy(F.desc("trace_id")).limit(clamped(limit))))
    registry.register(Tool("feedback_summary", "Counts of answer feedback.", lambda: store.feedback_summary(feedback)))
    return registry


def weather_label(code: Column) -> Column:
    """The label of a weather code; others are shown as they are, null is unknown."""
    labels = F.create_map(*(F.lit(x) for pair in WEATHER.items() for x in pair))
    number = code.cast("int")
    return F.when(number.isNull(), "Unknown").otherwise(F.coalesce(labels[number], F.concat(F.lit("Weather code "), number.cast("string"))))


def place_candidates(location: Column) -> Column:
    """Names to look a place up by, the likeliest first: as given, its first words, without its last letter, and with two letters exchanged."""
    words = F.split(text.squeeze(location), " ")
    n = F.size(words)
    first = F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))).otherwise(F.array().cast("array<string>"))
    last = F.element_at(words, -1)
    rest = F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    shorter = F.when(F.length(last) >= 5, F.array(F.array_join(F.concat(rest, F.array(F.substring(last, F.lit(1), F.length(last) - 1))), " "))).otherwise(F.array().cast("array<string>"))

    def swapped(i: Column) -> Column:
        word = F.get(words, i)
        letters = F.when(F.length(word) >= 5, F.filter(F.sequence(F.lit(1), F.length(word) - 1), lambda k: F.lower(F.substring(word, k, F.lit(1))) != F.lower(F.substring(word, k + 1, F.lit(1))))).otherwise(F.array().cast("array<int>"))
        turned = F.transform(letters, lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.lit(1)), F.substring(word, k, F.lit(1)), F.substring(word, k + 2, F.length(word))))
        whole = F.transform(turned, lambda w: F.array_join(F.concat(F.slice(words, F.lit(1), i), F.array(w), F.slice(words, i + 2, n)), " "))
        return F.when((n > 1) & (i == 0), F.flatten(F.zip_with(whole, turned, lambda a, b: F.array(a, b)))).otherwise(whole)

    turns = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), swapped))
    every = F.filter(F.concat(F.array(F.array_join(words, " ")), first, shorter, turns), lambda c: c != "")
    return F.slice(F.array_distinct(every), 1, MOST_PLACES)


def same_place(pairs: DataFrame, name: str = "same") -> DataFrame:
    """pairs (asked, candidate, place, label) with whether a found place is the one asked for.

    One name starts with or holds the other, or all longer words of the candidate stand in the label, or they are
    alike letter by letter; an unnamed place agrees."""
    a, c, p, lab = (text.compact(F.col(x)) for x in ("asked", "candidate", "place", "label"))
    words = F.filter(F.transform(F.split("candidate", r"\s+"), text.compact), lambda w: F.length(w) >= 3)
    held = F.col("place").isNull() | (F.col("place") == "") | p.startswith(c) | c.startswith(p) | ((p != "") & (c.contains(p) | a.contains(p))) | ((F.size(words) > 0) & F.forall(words, lambda w: lab.contains(w)))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, s or "", t or "").ratio() for s, t in zip(x, y, strict=True)])

    return pairs.withColumn(name, held | (ratio(a, lab) >= ALIKE) | (ratio(c, p) >= ALIKE))


def formatted_weather(row: dict[str, str]) -> Column:
    """One line for a weather result given as columns by field name."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(row[c]).cast("string"))
    return F.concat_ws("; ", F.concat_ws(": ", F.col(row["location"]), weather_label(F.col(row["code"]))), part("temperature", "temperature"), part("humidity", "humidity"), part("wind", "wind"))


def formatted_rows(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """The first rows as lines of a list: ``- a: 1; b: 2``."""
    fields = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]
    return df.limit(limit).select(F.concat(F.lit("- "), F.concat_ws("; ", *fields)).alias("line"))

