"""Queries of ordered runs, steps, pipelines, relations and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relations, runs
from ..sources import fixtures as fx
from .registry import query


def _listed(spark, sf_dir) -> DataFrame:
    """Whole texts with their lines numbered by sevens, and every fifth line opened by an ordinal instead."""
    line = lambda x, i: F.concat(F.when(i % 5 == 4, F.concat(F.element_at(F.array(F.lit("First"), F.lit("second"), F.lit("third")), (F.floor(i / 5) % 3 + 1).cast("int")), F.lit(", "))).otherwise(F.concat((i % 7 + 1).cast("string"), F.lit(". "))), x)
    return fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), " ").alias("body"))


_RUNS = r"""listed AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 4 THEN ['First', 'second', 'third'][((i - 1) // 5) % 3 + 1] || ', ' ELSE ((i - 1) % 7 + 1)::VARCHAR || '. ' END || x), ' ') AS body FROM documents WHERE text IS NOT NULL),
kinds(kind, pat) AS (VALUES ('numbered', '(^|\s)(\d{1,4})[.)]\s'), ('ordinal', '(^|[^\p{L}\p{N}_])(?i:(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth))($|[^\p{L}\p{N}_])')),
hit AS (SELECT doc_id, kind, unnest(range(1, n + 1)) AS place, unnest(found) AS m FROM (SELECT doc_id, kind, regexp_extract_all(body, pat, 2) AS found, len(regexp_extract_all(body, pat, 2)) AS n FROM listed, kinds)),
numbered AS (SELECT doc_id, kind, place, CASE kind WHEN 'numbered' THEN m::INTEGER ELSE list_position(['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'], lower(m)) END AS number FROM hit),
opened AS (SELECT *, CASE WHEN number - lag(number) OVER (PARTITION BY doc_id, kind ORDER BY place) = 1 THEN 0 ELSE 1 END AS opens FROM numbered),
island AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, kind ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM opened),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, kind, run) AS steps, row_number() OVER (PARTITION BY doc_id, kind, run ORDER BY place) AS step FROM island)"""


@query(f"WITH {_RUNS} SELECT doc_id, kind, run::INTEGER AS run, step::INTEGER AS step, steps::INTEGER AS steps, number::INTEGER AS number FROM sized WHERE steps >= 2")
def ordered_runs(spark, sf_dir):
    """Runs of numbered and ordinal markers in whole texts."""
    return runs.runs(_listed(spark, sf_dir), "body", "doc_id").select("doc_id", "kind", "run", F.col("step").cast("int").alias("step"), "steps", "number")


@query(f"""WITH {_RUNS}, best AS (SELECT doc_id, arg_min(kind, (-steps) * 1000000.0 + CASE kind WHEN 'numbered' THEN 0 ELSE 500000 END + run) AS kind, arg_min(run, (-steps) * 1000000.0 + CASE kind WHEN 'numbered' THEN 0 ELSE 500000 END + run) AS run FROM sized WHERE steps >= 2 GROUP BY doc_id)
SELECT doc_id, kind, s.run::INTEGER AS run, steps::INTEGER AS steps, list(number::INTEGER ORDER BY step)::VARCHAR AS numbers FROM sized s JOIN best b USING (doc_id, kind) WHERE s.run = b.run GROUP BY doc_id, kind, s.run, steps""")
def longest_runs(spark, sf_dir):
    """The longest run of each text."""
    found = runs.longest(runs.runs(_listed(spark, sf_dir), "body", "doc_id"), "doc_id")
    ordered = found.groupBy("doc_id", "kind", "run", "steps").agg(F.array_sort(F.collect_list(F.struct("step", "number"))).alias("n"))
    return ordered.select("doc_id", "kind", "run", "steps", F.concat(F.lit("["), F.array_join(F.transform("n", lambda x: x["number"].cast("string")), ", "), F.lit("]")).alias("numbers"))


def _asked(spark, sf_dir, question: str, first: str, every: str) -> DataFrame:
    """Documents as items of a question each: pages of eight lines, with words before the first and before every line."""
    lines = fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    part = lambda i: F.array_join(F.transform(F.slice("l", i * 8 + 1, F.lit(8)), lambda x, j: F.concat(F.when(j == 0, first).otherwise(""), F.replace(F.lit(every), F.lit("@"), (j + 1).cast("string")), x)), "\n")
    pages = lines.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 8).cast("int")), part)).alias("page", "text"))
    return pages.select(F.col("doc_id").alias("query_id"), F.lit(question).alias("query"), (F.col("page") + 1).alias("rank"), F.lit("t").alias("title"), (F.col("page") + 1).alias("page_number"), F.lit(0).alias("chunk_index"), "text")


@query(None)
def challenge_steps(spark, sf_dir):
    """Steps of a challenge in every document."""
    return runs.challenge_answers(_asked(spark, sf_dir, "What are the steps of the 7 day challenge?", "The challenge: ", "@. Day @: "))


@query(None)
def pipeline_steps(spark, sf_dir):
    """Stages of a pipeline in every document."""
    first = "Load the model. Upload a file or a URL of a PDF image. Generate DocTags and a DoclingDocument() to export as Markdown or HTML with a preview in Gradio. "
    return runs.pipeline_answers(_asked(spark, sf_dir, "What is the main pipeline?", first, "# generate part @ of it\n"))


@query(None)
def series_answers(spark, sf_dir):
    """The longest run of every document as an answer that keeps its order."""
    items = _listed(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), "body")
    return runs.series(items)


_TRIPLES = r"""pages AS (SELECT doc_id, trim(regexp_replace(replace(replace(' ' || replace(text, chr(10), ' ' || chr(10) || ' ') || ' ', ' that ', ' Erly '), ' of ', ' known as '), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS body FROM documents WHERE text IS NOT NULL),
clauses AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '[,;:.!?]'), lambda c: trim(c)), lambda c: c <> '') AS cs FROM pages),
each AS (SELECT doc_id, unnest(range(0, len(cs))) AS place, unnest(cs) AS clause FROM clauses),
said AS (SELECT *, regexp_extract(clause, '(?i)(?:^|[^A-Za-z0-9])Erly((?: .*?)??) (is|are|refers to|means|called|known as) (.+)$', 1) AS gap, lower(regexp_extract(clause, '(?i)(?:^|[^A-Za-z0-9])Erly((?: .*?)??) (is|are|refers to|means|called|known as) (.+)$', 2)) AS relation,
  regexp_extract(clause, '(?i)(?:^|[^A-Za-z0-9])Erly((?: .*?)??) (is|are|refers to|means|called|known as) (.+)$', 3) AS object FROM each),
found AS (SELECT doc_id, place::INTEGER AS place, relation, object, length(gap)::INTEGER AS distance FROM said WHERE relation <> '')"""


def _triples(spark, sf_dir) -> DataFrame:
    """What whole documents say of one entity, whose name stands for a common word."""
    body = F.concat(F.lit(" "), F.regexp_replace("text", r"\n", " \n "), F.lit(" "))
    named = F.replace(F.replace(body, F.lit(" that "), F.lit(" Erly ")), F.lit(" of "), F.lit(" known as "))
    rows = fx.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", named.alias("body"), F.lit("Erly").alias("entity"))
    return relations.triples(rows, "body", "entity", "doc_id")


@query(f"WITH {_TRIPLES} SELECT * FROM found")
def relation_triples(spark, sf_dir):
    return _triples(spark, sf_dir).select("doc_id", "place", "relation", "object", "distance")


@query(f"WITH {_TRIPLES} SELECT doc_id, place, relation, object FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, place) AS n FROM found) WHERE n = 1")
def nearest_relations(spark, sf_dir):
    return relations.nearest(_triples(spark, sf_dir), "doc_id").select("doc_id", "place", "relation", "object")


@query(None)
def definitions(spark, sf_dir):
    """A definition of one entity from every document."""
    return relations.definition_answers(fx.cued_items(spark, sf_dir).filter("query_id % 10 = 0").withColumn("query", F.lit("What is Erly?")))
