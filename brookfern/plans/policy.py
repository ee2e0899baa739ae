"""Queries of the answer policy, direct answers and answers from tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import policy
from ..sources import fixtures as fx
from .registry import query


def _items(spark, sf_dir) -> DataFrame:
    return fx.cued_items(spark, sf_dir, every=False).withColumns({"section_title": F.lit(""), "hybrid_score": 1.0 / (F.col("rank") + 60)})


@query(None)
def policy_answers(spark, sf_dir):
    """The whole policy over a question on every document, of all kinds in turn, with the stage that answered and why others did not."""
    found = policy.answered(_items(spark, sf_dir))
    return found.select("query_id", "answer", "source", F.to_json("trace").alias("trace"))


_WORDED = "SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 5 = 0 THEN ['Hi', ' hello ', 'Good Morning', 'hey'][conv_id % 4 + 1] WHEN turn % 5 = 1 THEN '' ELSE 'line ' || turn::VARCHAR || ' ' || split_part(trim(text), chr(10), 1) END AS query FROM conversations"
_GREETING_CASE = "CASE lower(trim(query)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.GREETINGS.items()) + " END"


@query(f"WITH q AS ({_WORDED}), g AS (SELECT *, {_GREETING_CASE} AS hello FROM q) SELECT query_id, coalesce(hello, nullif(trim(query), ''), '{fixed.DIRECT_FALLBACK.replace(chr(39), chr(39) * 2)}') AS answer, CASE WHEN hello IS NOT NULL THEN 'greeting' WHEN trim(query) <> '' THEN 'model' ELSE 'fallback' END AS source FROM g")
def direct_answers(spark, sf_dir):
    """Greetings, the model's reply, or a request to rephrase, for turns of conversations."""
    greeting = "element_at(array('Hi', ' hello ', 'Good Morning', 'hey'), cast(conv_id % 4 + 1 as int))"
    asked = fx.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn as query_id", f"case when turn % 5 = 0 then {greeting} when turn % 5 = 1 then '' else concat('line ', turn, ' ', split_part(trim(text), '\\n', 1)) end as query")
    return policy.direct(asked).select("query_id", "answer", "source")


_PAYLOADS = [
    """'{"tool":"get_current_weather","location":"L' || user_id || '","temperature":"' || (event_id % 30) || ' C","condition":"' || event_type || '"}'""",
    """'{"source":"mcp","result":{"tool":"file_info","path":"f' || event_id || '.txt","is_dir":false,"size_bytes":' || (event_id * 3) || '}}'""",
    """'{"source":"mcp","result":{"tool":"list_tables","tables":[{"name":"' || event_type || '","row_count":' || event_id || '},{"name":"other","row_count":2}]}}'""",
    """'{"source":"mcp","result":{"tool":"feedback_summary","total_count":' || event_id || ',"like_count":' || (event_id // 2) || ',"dislike_count":1,"dislike_rate":0.25,"issue_counts":{"' || event_type || '":3}}}'""",
    """'{"source":"mcp","result":{"tool":"read_text_file","success":false,"error":"no ' || event_type || '"}}'""",
    """'{"source":"mcp","result":{"tool":"preview_table","table":"t","rows":[{"a":"' || event_id || '","b":"' || event_type || '"}]}}'""",
    """'not a result of ' || event_id""",
    "''",
]
_SAID = [
    "'The current temperature in L' || user_id || ' is ' || (event_id % 30) || ' C. Conditions: ' || event_type || '.'",
    "'f' || event_id || '.txt is a file. Size: ' || (event_id * 3) || ' bytes.'",
    "'SQLite tables:' || chr(10) || '- ' || event_type || ' (' || event_id || ' rows)' || chr(10) || '- other (2 rows)'",
    "'Feedback summary: ' || event_id || ' total, ' || (event_id // 2) || ' liked, 1 disliked, dislike rate 25%. Issue counts: ' || event_type || ': 3.'",
    "'The MCP tool could not complete the request: no ' || event_type",
    "'Preview of SQLite table t:' || chr(10) || '1. a=' || event_id || '; b=' || event_type",
    "'not a result of ' || event_id",
    f"'{fixed.TOOL_FALLBACK}'",
]
_CASES = " ".join(f"WHEN {i} THEN {said}" for i, said in enumerate(_SAID))


@query(f"SELECT event_id AS query_id, CASE event_id % 8 {_CASES} END AS answer, CASE WHEN event_id % 8 < 6 THEN 'structured' WHEN event_id % 8 = 6 THEN 'model' ELSE 'fallback' END AS source FROM events")
def tool_answers(spark, sf_dir):
    """What tool results say, the model's reply where they are no known result, and the fallback."""
    payload = "case event_id % 8 " + " ".join(f"when {i} then {p.replace('//', 'div')}" for i, p in enumerate(_PAYLOADS)) + " end as payload"
    asked = fx.table(spark, sf_dir, "events").selectExpr("event_id as query_id", "event_type as query", payload)
    return policy.from_tools(asked).select("query_id", "answer", "source")
