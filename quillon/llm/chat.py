"""Chat formatting with tool-call linking, in DataFrame operations only.

Results are aggregated by call identifier and hash-joined to the calls.  Calls are ordered topologically: level 0 needs no other
call, each further level needs one of the level before.  Chains are followed by pointer doubling and branching calls are peeled off in
rounds, so that no conversation is gathered in a task; calls on a cycle, or behind one, have no level.
Arguments are checked against the tool's schema.  Messages are canonical JSON: keys in order, no white space, nulls at the top left out.

Defined cases: arguments that are null or no JSON object are an error of the call, and are left out of its message; an unknown tool, a
missing or unknown field, a wrong type, a dependency on no known call and an identifier used twice are errors; several results of a call:
the first by place and content is linked and all are counted; a result of no call is kept and marked; a null identifier links to nothing; empty tables give
no rows.  Calls that share an identifier share its level and results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import forget, stored


def _jumped(edges: DataFrame) -> DataFrame:
    """``(id, to, dist, cyclic)`` of nodes with one dependency: where their chain of such nodes ends, and how far off.

    Pointers double in every round, so that a chain of n calls takes log n rounds.
    """
    one = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("dep").alias("to")).where("n = 1")
    now = stored(one.select("id", "to", F.lit(1).cast("long").alias("dist"), F.lit(True).alias("moved")), "chains")
    for _ in range(now.count().bit_length() + 2):
        after = now.select(realigned_text(F.col("id")).alias("next_id"), F.col("to").alias("next_to"), F.col("dist").alias("next_dist"))
        rows = now.join(after, F.col("to") == F.col("next_id"), "left")
        moved = F.col("next_id").isNotNull()
        rows = rows.select("id", F.coalesce("next_to", "to").alias("to"), (F.col("dist") + F.coalesce("next_dist", F.lit(0))).alias("dist"), moved.alias("moved"))
        old, now = now, stored(rows, "chains")
        forget(old)
        if now.where("moved").isEmpty():
            break
    return now.select("id", "to", "dist", F.col("moved").alias("cyclic"))  # what still moves goes round in a circle


def levels(edges: DataFrame) -> DataFrame:
    """``(node, level)`` of the nodes of ``edges(id, dep)`` that depend on others: the longest chain below. Nodes on or behind a cycle have null.

    Chains of nodes with one dependency are jumped over; only nodes with several are peeled off round by round.
    """
    edges = stored(edges.where("id is not null and dep is not null").distinct(), "needs")
    chain = _jumped(edges)
    several = edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(realigned_text(F.col("id")).alias("own"))
    jump = chain.select(realigned_text(F.col("id")).alias("jump_id"), F.col("to"), F.col("dist"), "cyclic")
    left = edges.join(several, F.col("id") == F.col("own"), "left_semi").join(jump, F.col("dep") == F.col("jump_id"), "left")
    # A node behind a circle of single ones waits for itself.
    left = stored(left.select("id", F.when(F.col("cyclic"), F.col("id")).otherwise(F.coalesce("to", "dep")).alias("dep"), F.coalesce("dist", F.lit(0)).alias("dist")), "open")
    known = left.select(F.col("id").alias("known"), F.lit(0).cast("long").alias("level")).limit(0)
    stuck = left.select(F.col("id").alias("known")).limit(0)
    while not left.isEmpty():
        waiting = left.select(realigned_text(F.col("id")).alias("node")).distinct()
        blocked = left.join(waiting, F.col("dep") == F.col("node"), "left_semi").select(realigned_text(F.col("id")).alias("late")).distinct()
        below = known.select(realigned_text(F.col("known")).alias("below"), F.col("level").alias("under"))
        ready = left.join(blocked, F.col("id") == F.col("late"), "left_anti").join(below, F.col("dep") == F.col("below"), "left")
        ready = stored(ready.groupBy(F.col("id").alias("known")).agg((1 + F.max(F.coalesce("under", F.lit(0)) + F.col("dist"))).alias("level")), "level")
        if ready.isEmpty():
            stuck = left.select(F.col("id").alias("known")).distinct()
            break
        known = known.union(ready)
        left = stored(left.join(blocked, F.col("id") == F.col("late"), "left_semi"), "open")
    known = known.union(stuck.select("known", F.lit(None).cast("long"))).withColumn("settled", F.lit(True))
    ends = known.select(realigned_text(F.col("known")).alias("end"), F.col("level").alias("under"), "settled")
    level = F.when(F.col("cyclic") | (F.col("settled") & F.col("under").isNull()), F.lit(None).cast("long")).otherwise(F.coalesce("under", F.lit(0)) + F.col("dist"))
    single = chain.join(ends, F.col("to") == F.col("end"), "left").select(F.col("id").alias("node"), level.alias("level"))
    return single.union(known.select(F.col("known").alias("node"), "level"))


def realigned_text(key: Column) -> Column:
    """As :func:`quillon.llm.common.realigned`, for strings."""
    return F.concat(key, F.lit(""))


def _json_type(kind: Column) -> Column:
    """The JSON Schema name of a variant's type."""
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("number")
    )


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problems``, what its ``arguments`` violate of the schema of ``name``; ``schemas`` has ``tool, field, type, required``."""
    fields = schemas.groupBy("tool").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))
    rows = calls.join(fields.select(realigned_text(F.col("tool")).alias("tool"), "fields"), F.col("name") == F.col("tool"), "left")
    rows = rows.withColumn("given", F.transform(F.map_entries(F.from_json("arguments", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), _json_type(F.schema_of_variant(e["value"])).alias("type"))))
    given = F.coalesce("given", F.array().cast("array<struct<key:string,type:string>>"))
    missing = F.transform(F.filter("fields", lambda f: f["required"] & ~F.exists(given, lambda g: g["key"] == f["field"])), lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.transform(F.filter(given, lambda g: F.exists("fields", lambda f: (f["field"] == g["key"]) & (f["type"] != g["type"]) & ~((f["type"] == "number") & (g["type"] == "integer")))), lambda g: F.concat(F.lit("wrong type "), g["key"]))
    unknown = F.transform(F.filter(given, lambda g: ~F.exists("fields", lambda f: f["field"] == g["key"])), lambda g: F.concat(F.lit("unknown field "), g["key"]))
    none = F.array().cast("array<string>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    problems = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.when(is_object, F.concat(missing, wrong, unknown)).otherwise(F.array(F.lit("arguments are no object"))))
    return rows.withColumn("problems", F.coalesce(problems, none)).drop("tool", "fields", "given")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every call with ``level, errors, valid, n_results`` and its ``message``.

    ``calls``: ``conv_id, place, call_id, name, arguments, needs`` (an array of identifiers); ``results``: ``call_id, place, content``.
    """
    calls = calls.select("conv_id", "place", "call_id", "name", "arguments", "needs")
    results = results.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("place", "content"))["content"].alias("content"))
    results = results.select(realigned_text(F.col("call_id")).alias("result_id"), "n_results", "content")
    ids = calls.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("uses"))
    ids = stored(ids.select(F.col("call_id").alias("known_id"), "uses"), "call-ids")
    edges = calls.where("call_id is not null").select(F.col("call_id").alias("id"), F.explode("needs").alias("dep"))
    real = edges.join(ids, F.col("dep") == F.col("known_id"), "left_semi")
    vague = edges.join(ids, F.col("dep") == F.col("known_id"), "left_anti").select(F.col("id").alias("vague_id")).distinct()
    order = levels(real)
    rows = checked(calls, schemas).join(results, F.col("call_id") == F.col("result_id"), "left")
    rows = rows.join(ids, F.col("call_id") == F.col("known_id"), "left").join(vague, F.col("call_id") == F.col("vague_id"), "left").join(order, F.col("call_id") == F.col("node"), "left")
    cyclic = F.col("node").isNotNull() & F.col("level").isNull()
    more = F.filter(F.array(F.when(F.col("call_id").isNull(), "no identifier"), F.when(F.col("uses") > 1, "identifier used twice"), F.when(F.col("vague_id").isNotNull(), "unknown dependency"), F.when(cyclic, "cyclic dependency")), lambda x: x.isNotNull())
    rows = rows.withColumn("level", F.when(~cyclic, F.coalesce("level", F.lit(0))).cast("int")).withColumn("errors", F.array_sort(F.array_distinct(F.concat("problems", more))))
    arguments = F.when(~F.array_contains("errors", "arguments are no object"), F.try_parse_json("arguments"))
    message = F.to_json(F.struct(arguments.alias("arguments"), "errors", F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), F.lit("call").alias("type")))
    return rows.select("conv_id", "place", "call_id", "name", "level", "errors", (F.size("errors") == 0).alias("valid"), F.coalesce("n_results", F.lit(0)).alias("n_results"), message.alias("message"))


#: The tools of the test conversations: a question of up to 200 characters asks, a longer one explains its topic.
TOOLS = [("ask", "text", "string", True), ("ask", "turn", "integer", True), ("explain", "text", "string", True), ("explain", "topic", "string", True), ("explain", "turn", "integer", False)]


def op9_chat_tools(conversations: DataFrame) -> DataFrame:
    """Every turn as a message: user turns are calls, assistant turns the results of the turn before, others plain.

    Arguments are the text, the turn and, if the text has several lines, the first as topic.  A call needs the call two turns before.  Columns:
    ``conv_id, turn, kind, call_id, level, valid, n_links, message``; ``n_links`` counts a call's results or a result's calls.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")

    def name(turn: Column) -> Column:
        return F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    text = F.coalesce("text", F.lit(""))
    topic = F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", 1))
    arguments = F.to_json(F.struct(text.alias("text"), topic.alias("topic"), "turn"))
    tool = F.when(F.char_length(text) <= 200, "ask").otherwise("explain")
    calls = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("place"), name(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    calls = stored(calls, "calls")
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    schemas = conversations.sparkSession.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")
    out = linked(calls, results.select("call_id", F.col("turn").alias("place"), "content"), schemas)
    out = out.select("conv_id", F.col("place").alias("turn"), F.lit("call").alias("kind"), "call_id", "level", "valid", F.col("n_results").alias("n_links"), "message")
    uses = calls.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n")).select(realigned_text(F.col("call_id")).alias("used"), "n")
    answers = results.join(uses, F.col("call_id") == F.col("used"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    message = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")))
    answers = answers.select("conv_id", "turn", F.lit("result"), "call_id", F.lit(None).cast("int"), F.col("n") > 0, "n", message)
    plain = turns.where("coalesce(role, '') not in ('user', 'assistant')")
    message = F.to_json(F.struct(text.alias("content"), F.col("role"), F.lit("message").alias("type")))
    plain = plain.select("conv_id", "turn", F.lit("message"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(True), F.lit(0).cast("long"), message)
    return out.union(answers).union(plain)


ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, 'call-' || conv_id || '-' || turn AS own, 'call-' || conv_id || '-' || (turn - 1) AS asked,
         'call-' || conv_id || '-' || (turn - 2) AS needed FROM conversations),
calls AS (SELECT *, length(text) <= 200 AS short, contains(text, chr(10)) AS lines FROM t WHERE role = 'user'),
chain AS (
  SELECT c.conv_id, c.turn, c.own, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.own = c.needed AND c.turn >= 2)
  UNION ALL
  SELECT c.conv_id, c.turn, c.own, p.level + 1 FROM calls c JOIN chain p ON p.own = c.needed AND c.turn >= 2),
answers AS (SELECT asked, count(*) AS n, arg_min(text, turn) AS content FROM t WHERE role = 'assistant' GROUP BY asked),
judged AS (
  SELECT c.*, k.level, coalesce(a.n, 0) AS n, a.content,
         list_sort(list_filter([CASE WHEN NOT c.short AND NOT c.lines THEN 'missing topic' END, CASE WHEN c.short AND c.lines THEN 'unknown field topic' END,
           CASE WHEN c.turn >= 2 AND p.own IS NULL THEN 'unknown dependency' END], lambda x: x IS NOT NULL)) AS errors
  FROM calls c JOIN chain k USING (conv_id, turn) LEFT JOIN answers a ON a.asked = c.own LEFT JOIN calls p ON p.own = c.needed)
SELECT conv_id, turn, 'call' AS kind, own AS call_id, level::INTEGER AS level, len(errors) = 0 AS valid, n::BIGINT AS n_links,
  '{"arguments":{"text":' || to_json(text) || CASE WHEN lines THEN ',"topic":' || to_json(string_split(text, chr(10))[1]) ELSE '' END || ',"turn":' || turn || '},"errors":' ||
  to_json(errors) || ',"id":"' || own || '","level":' || level || ',"name":"' || CASE WHEN short THEN 'ask' ELSE 'explain' END || '"' ||
  CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || ',"type":"call"}' AS message
FROM judged
UNION ALL
SELECT t.conv_id, t.turn, 'result', t.asked, NULL, c.own IS NOT NULL, (c.own IS NOT NULL)::BIGINT,
  '{"content":' || to_json(t.text) || ',"id":"' || t.asked || '","type":"result"}'
FROM t LEFT JOIN calls c ON c.own = t.asked WHERE t.role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'message', NULL, NULL, TRUE, 0, '{"content":' || to_json(text) || CASE WHEN role IS NULL THEN '' ELSE ',"role":' || to_json(role) END || ',"type":"message"}'
FROM t WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""
