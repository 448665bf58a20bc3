"""Chat formatting with linked tool calls.

Calls and results of a conversation meet in a hash join by identifier; calls are put in topological order by the call
that each one depends on; their arguments are validated against the tools' schemas; each call with its result becomes
one line of canonical JSON. No conversation is gathered in one task: order comes from pointer doubling over identifiers.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")


def written(text: str) -> str:
    """The text with lone surrogates, which UTF-8 can't hold, as \\u escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON without spaces, keys by code point, text as it is; only lone surrogates are escaped."""
    return written(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def same(a: object, b: object) -> bool:
    """Equal as JSON: true isn't 1, but 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(x, b[k]) for k, x in a.items())
    return a == b


def of_type(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, int | float):
            return False
        return kind == "number" or isinstance(value, int) or math.isfinite(value) and value == int(value)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """What contradicts a JSON schema: type (or list of types), enum, required, properties, additionalProperties, items, lengths, bounds."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(of_type(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(map(str, kinds))}"]
    out = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        out += [f for k, x in enumerate(value) for f in faults(x, schema["items"], f"{at}[{k}]")]
    elif isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        out.append(f"{at}: length")
    elif isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: bounds")
    return out


def checked(arguments: str | None, schema: dict | None) -> tuple[str | None, str]:
    """Canonical arguments (null if they aren't JSON, or have numbers or depths beyond what JSON readers take), and faults."""
    try:
        value = json.loads(arguments or "", parse_constant=lambda c: 1 / 0)
        return canonical(value), written("; ".join(["unknown tool"] if schema is None else faults(value, schema)))
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None, "not JSON"


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) of calls (key, after): steps to a call that depends on none of them; -1 in or behind a cycle."""
    parents = calls.join(calls.select(F.col("key").alias("after")), "after", "left_semi").select("key", "after")
    far = calls.select("key").join(parents, "key", "left").select("key", F.col("after").alias("jump"), F.col("after").isNotNull().cast("long").alias("level"))
    far = cut(far)
    total, steps = far.count(), 1
    while True:
        open_ = far.filter(F.col("jump").isNotNull()).count()
        if not open_ or steps > 2 * total:
            break
        ahead = far.select(F.col("key").alias("jump"), F.col("jump").alias("_next"), F.col("level").alias("_more"))
        far = cut(far.join(ahead, "jump", "left").select("key", F.col("_next").alias("jump"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level")))
        steps *= 2
    return far.select("key", F.when(F.col("jump").isNull(), F.col("level")).otherwise(-1).alias("level"))


def _key(conversation: Column, identifier: Column) -> Column:
    """One text for a conversation and an identifier; null if either is."""
    return F.when(conversation.isNotNull() & identifier.isNotNull(), F.to_json(F.struct(conversation.cast("string").alias("c"), identifier.alias("i"))))


_COLUMNS = ("call_id", "conv_id", "turn", "name", "arguments", "level", "status", "copies", "results", "result")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each distinct call, and for each distinct result that answers none.

    calls: call_id, conv_id, turn, name, arguments (JSON), after (identifier of a call of the same conversation, or
    null). results: call_id, conv_id, turn, text. Out: call_id, conv_id, turn, level, status, copies, results, faults,
    line. copies and results count the input rows of calls and results that a row stands for; they add up to all rows.

    An identifier is one of its conversation. Of several different calls or results with one identifier the first by
    turn, then by content, is linked; the others are rows of their own with status repeated. status: linked, unanswered
    (a call without a result), orphan (a result without a call) or repeated. Rows with a null identifier or
    conversation can't be linked: each is a row, unanswered or orphan. An unknown `after` counts as none. Arguments that
    aren't JSON are kept as text, with a fault. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    lit = lambda x, kind: F.lit(x).cast(kind)
    as_call = lambda f, status: f.withColumns({"level": lit(0, "long"), "status": F.lit(status), "results": lit(0, "long"), "result": lit(None, "string")}).select(*_COLUMNS)
    as_result = lambda f, status: f.withColumns({"name": lit(None, "string"), "arguments": lit(None, "string"), "level": lit(0, "long"), "status": F.lit(status), "copies": lit(0, "long")}).select(*_COLUMNS)

    asked = calls.select("call_id", "conv_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", "after", _key(F.col("conv_id"), F.col("call_id")).alias("key"))
    said = results.select("call_id", "conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("result"), _key(F.col("conv_id"), F.col("call_id")).alias("key"))
    out = [as_call(asked.filter("key IS NULL").withColumn("copies", lit(1, "long")), "unanswered"), as_result(said.filter("key IS NULL").withColumn("results", lit(1, "long")), "orphan")]

    content = ("turn", "name", "arguments", "after")
    each = cut(asked.filter("key IS NOT NULL").groupBy("key", "call_id", "conv_id", *content).agg(F.count(F.lit(1)).alias("copies")))
    first = cut(each.groupBy("key").agg(F.min(F.struct(*content, "call_id", "conv_id", "copies")).alias("c"), F.count(F.lit(1)).alias("different")))
    answers = cut(said.filter("key IS NOT NULL").groupBy("key", "call_id", "conv_id", "turn", "result").agg(F.count(F.lit(1)).alias("results")))
    answer = cut(answers.groupBy("key").agg(F.min(F.struct("turn", "result", "call_id", "conv_id", "results")).alias("r"), F.count(F.lit(1)).alias("different")))
    own = first.select("key", "c.*")
    order = levels(own.select("key", _key(F.col("conv_id"), F.col("after")).alias("after")))

    met = own.join(answer.select("key", "r.result", "r.results"), "key", "left").join(order, "key")
    status = F.when(F.col("results").isNotNull(), "linked").otherwise("unanswered")
    out.append(met.withColumns({"status": status, "results": F.coalesce("results", lit(0, "long"))}).select(*_COLUMNS))
    lost = answer.join(own.select("key"), "key", "left_anti")
    out.append(as_result(lost.select("r.*"), "orphan"))
    more = first.filter("different > 1").select("key", F.struct(*(F.col(f"c.{c}") for c in content)).alias("_first"))
    more = each.join(more, "key").filter(~F.struct(*content).eqNullSafe(F.col("_first")))
    out.append(as_call(more, "repeated"))
    again = answer.filter("different > 1").select("key", F.struct("r.turn", "r.result").alias("_first"))
    again = answers.join(again, "key").filter(~F.struct("turn", "result").eqNullSafe(F.col("_first")))
    out.append(as_result(again, "repeated"))

    @F.pandas_udf("faults string, line string")
    def lines(call_id: pd.Series, name: pd.Series, arguments: pd.Series, result: pd.Series, level: pd.Series, status: pd.Series, copies: pd.Series) -> pd.DataFrame:
        found = []
        for i, n, a, r, order, s, asks in zip(call_id, name, arguments, result, level, status, copies):
            record: dict = {"id": i, "status": s}
            problem = ""
            if asks:
                own, problem = checked(a, schemas.get(n))
                record |= {"name": n, "arguments": json.loads(own) if own is not None else a, "valid": not problem, "order": int(order)}
            if s == "linked" or not asks:
                record["result"] = r
            found.append((problem, canonical(record)))
        return pd.DataFrame(found, columns=["faults", "line"])

    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    done = rows.withColumn("w", lines("call_id", "name", "arguments", "result", "level", "status", "copies"))
    return done.select("call_id", "conv_id", "turn", "level", "status", "copies", "results", "w.faults", "w.line")


#: In the query's table a user's turn asks the assistant.
ASK = {"ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations without tools: each user's turn asks, the turn after it answers, and a user's turn depends on the one two turns before."""
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    mine = lambda back: F.when(known, name(back))
    calls = messages.filter(F.col("role") == "user").select(mine(0).alias("call_id"), "conv_id", "turn", F.lit("ask").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), mine(2).alias("after"))
    results = messages.filter(F.col("role") == "assistant").select(mine(1).alias("call_id"), "conv_id", "turn", "text")
    return calls, results


def others(messages: DataFrame) -> DataFrame:
    """A row as of `link`, with status message, for each turn that neither asks nor answers: of the system, a tool, or no role."""
    own = messages.filter(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)))
    own = own.select(F.concat_ws(":", *(F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col(c).cast("string")) for c in ("conv_id", "turn"))).alias("call_id"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = own.withColumn("call_id", F.nullif("call_id", F.lit("")))

    @F.pandas_udf("string")
    def lines(call_id: pd.Series, role: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([canonical({"id": i, "status": "message", "role": r, "text": t}) for i, r, t in zip(call_id, role, text)], dtype=object)

    whole = lambda n: F.lit(n).cast("long")
    return own.select("call_id", "conv_id", "turn", whole(0).alias("level"), F.lit("message").alias("status"), whole(0).alias("copies"), whole(0).alias("results"), F.lit("").alias("faults"), lines("call_id", "role", "text").alias("line"))


def formatted(messages: DataFrame) -> DataFrame:
    """Every turn of conversations without tools: asked and answered ones linked, the others as they are."""
    return link(*turns(messages), ASK).unionByName(others(messages))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Levels are places in runs of a conversation's user turns, two apart.
SQL = f"""
WITH m AS (SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations),
asked AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, '{{' || concat_ws(',', '"text":' || to_json(text), '"turn":' || turn) || '}}' AS arguments, count(*) AS copies, conv_id IS NOT NULL AND turn IS NOT NULL AS known FROM m WHERE role = 'user' GROUP BY ALL),
said AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id, count(*) AS results, conv_id IS NOT NULL AND turn IS NOT NULL AS known FROM m WHERE role = 'assistant' GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY arguments) AS k FROM asked WHERE known),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY text NULLS FIRST) AS k FROM said WHERE known),
runs AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c WHERE k = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM runs),
rows_ AS (
  SELECT p.call_id, p.conv_id, p.turn, p.level, CASE WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, p.copies, coalesce(r.results, 0) AS results, p.text, p.arguments, r.text AS result FROM placed p LEFT JOIN r ON r.call_id = p.call_id AND r.k = 1
  UNION ALL SELECT call_id, conv_id, turn, 0, 'repeated', copies, 0, text, arguments, NULL FROM c WHERE k > 1
  UNION ALL SELECT r.call_id, r.conv_id, r.turn, 0, CASE WHEN r.k = 1 THEN 'orphan' ELSE 'repeated' END, 0, r.results, NULL, NULL, r.text FROM r WHERE r.k > 1 OR r.call_id NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT NULL, conv_id, turn, 0, 'unanswered', 1, 0, text, '{{' || concat_ws(',', '"text":' || to_json(text), '"turn":' || turn) || '}}', NULL FROM m WHERE role = 'user' AND (conv_id IS NULL OR turn IS NULL)
  UNION ALL SELECT NULL, conv_id, turn, 0, 'orphan', 0, 1, NULL, NULL, text FROM m WHERE role = 'assistant' AND (conv_id IS NULL OR turn IS NULL)),
faulty AS (SELECT *, CASE WHEN copies = 0 THEN '' ELSE concat_ws('; ', CASE WHEN text IS NULL THEN '$.text: missing' END, CASE WHEN turn IS NULL THEN '$.turn: missing' END,
  CASE WHEN text = '' THEN '$.text: length' END, CASE WHEN turn < 0 THEN '$.turn: bounds' END) END AS faults FROM rows_)
SELECT call_id, conv_id, turn, level::BIGINT AS level, status, copies::BIGINT AS copies, results::BIGINT AS results, faults,
  CASE WHEN copies = 0 THEN '{{"id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"status":"' || status || '"}}'
    ELSE '{{"arguments":' || arguments || ',"id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"name":"ask","order":' || level
      || CASE WHEN status = 'linked' THEN ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') ELSE '' END || ',"status":"' || status || '","valid":' || CASE WHEN faults = '' THEN 'true' ELSE 'false' END || '}}' END AS line
FROM faulty
UNION ALL SELECT conv_id || ':' || turn, conv_id, turn, 0, 'message', 0, 0, '',
  '{{"id":' || coalesce(to_json(conv_id || ':' || turn)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"status":"message","text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}}'
FROM m WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""
