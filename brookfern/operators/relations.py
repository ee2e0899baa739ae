"""What texts say of an entity: subject, relation and object of clauses, and definitions from windows around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import sentences as st
from ..session import settled
from . import answer, cleaning, windows

#: Relations of a clause, the longer ones first where one opens another.
RELATIONS = [r.strip() for r in fixed.DEFINED_BY]


def triples(rows: DataFrame, body: str, entity: str, *keys: str) -> DataFrame:
    """(*keys, place, subject, relation, object, distance): of each clause that names the entity, the first relation after it.

    A clause ends at , ; : . ! or ?.  distance: the letters between entity and relation; object: the rest of the clause.
    Null and empty texts and entities have none."""
    clauses = F.filter(F.transform(F.split(text.squeeze(F.col(body)), r"[,;:.!?]"), lambda x: F.trim(x)), lambda c: c != "")
    each = rows.filter(f"coalesce(`{entity}`, '') <> ''").select(*keys, F.col(entity).alias("subject"), F.posexplode(clauses).alias("place", "clause"))
    quoted = F.regexp_replace("subject", r"([\\\[\](){}.*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("(?i)(?:^|[^A-Za-z0-9])"), quoted, F.lit(rf"((?: .*?)??) ({'|'.join(RELATIONS)}) (.+)$"))
    held = settled(each, pattern=pattern)
    part = lambda i: F.call_function("regexp_extract", F.col("clause"), F.col("pattern"), F.lit(i))
    found = settled(held, relation=F.lower(part(2)), object=part(3), distance=F.length(part(1)))
    return found.filter("relation <> ''").select(*keys, "place", "subject", "relation", "object", "distance")


def nearest(found: DataFrame, *keys: str) -> DataFrame:
    """The triple of each key whose relation stands nearest to its subject, the first of equal ones."""
    order = Window.partitionBy(*keys).orderBy("distance", "place")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def definition_answers(items: DataFrame) -> DataFrame:
    """(query_id, answer): the best window that defines what a query asks about, up to three of its sentences.

    A sentence defines if it names the entity with a relation, or opens with it and names a class; those with details follow one
    that does.  items: as in ``windows``; queries that ask for no definition have no row."""
    q = F.col("query")
    asked = settled(items.select("query").distinct(), entity=windows.entity_terms(F.lower(st.definition_entity(q))), terms=windows.query_terms(q), intents=answer.intent_terms(F.lower(q))).filter("size(entity) > 0")
    rows = windows.with_body(items.join(asked, "query")).select("query_id", "query", "rank", "text", "body", "entity", "terms", "intents")
    rows = settled(rows, low=F.lower("body"))
    spots = F.slice(F.array_sort(F.array_distinct(windows.entity_positions(F.col("low"), F.col("entity")))), 1, 4)
    near = rows.withColumn("at", F.explode(spots))
    start, stop = windows.around(F.col("body"), F.col("at"), 120, 760)
    near = settled(near, start=start, stop=stop)
    parts = F.filter(F.transform(F.split(text.squeeze(F.substring("body", F.col("start") + 1, F.col("stop") - F.col("start"))), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s) > 40)
    heads = F.transform(parts, lambda s: F.trim(F.split(s, fixed.DEFINED_ENDS, 2)[0]))
    near = settled(near, parts=heads).drop("body", "low", "text").select("*", F.posexplode("parts").alias("place", "sentence")).drop("parts")
    s, low, entity = F.col("sentence"), F.lower("sentence"), F.col("entity")
    near = settled(near, useful=(s != "") & ~st.is_low_value(s) & ~st.is_code(s), named=windows.holds_entity(low, entity), opens=windows.holds_entity(F.split(low, ":", 2)[0], entity)).filter("useful")
    defines = (F.col("named") & text.any_of(low, fixed.DEFINED_BY)) | (F.col("opens") & F.col("named") & text.any_of(low, fixed.DEFINED_CLASSES))
    near = settled(near, defines=defines.cast("int"), details=text.any_of(low, fixed.DEFINED_DETAILS))
    own = Window.partitionBy("query_id", "rank", "at").orderBy("place")
    begun = F.coalesce(F.max("defines").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    kept = near.withColumn("kept", (F.col("defines") == 1) | (F.col("details") & begun)).filter("kept").withColumn("n", F.row_number().over(own)).filter("n <= 3")
    joined = kept.groupBy("query_id", "query", "rank", "at", "entity", "terms", "intents").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("excerpt"))
    shown = settled(joined, excerpt=windows.excerpt(F.col("excerpt"), 95)).filter("excerpt <> ''")
    low = F.lower("excerpt")
    said = F.concat(F.lit(r"\b"), F.array_join("entity", r"\s*[-_]?\s*"), F.lit(r"\s+(?:is|are)\s+(?:a|an|the)\b"))
    score = windows._relevance(F.col("excerpt")) + F.when(windows.holds_entity(low, entity), 8).otherwise(0) + F.when(F.regexp_like(low, said), 18).otherwise(0)
    for worth, marks in fixed.DEFINED_SCORES.items():
        score = score + (F.when(text.any_of(low, marks), worth).otherwise(0) if worth < 0 else answer.hits_in(low, marks) * worth)
    best = settled(shown, score=score).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", F.desc("excerpt")))).filter("n = 1")
    return cleaning.cleaned(best.select("query_id", F.concat("excerpt", F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("answer")), "answer")
