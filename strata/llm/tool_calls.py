"""Chat formatting: link tool calls to results, order them, validate arguments, canonical JSON.

``link_tool_calls(calls, results, schemas)``

* calls: conv_id, call_id, depends_on (array of call ids, may be null), tool, arguments (JSON text)
* results: conv_id, call_id, content
* schemas: tool, param, type (``STRING``, ``BIGINT``, ``DOUBLE``, ``BOOLEAN``, ``OBJECT`` or ``ARRAY``), required

Identifiers such as ``call_1`` come again in every conversation, so a call is known by conversation and
identifier; results meet calls by an equi-join on both, and dependencies are those of the same conversation.  The order is the depth of
a call below its dependencies (0: none), so depth and then call id is a
topological order.  Chains are shortened by pointer jumping: a call with one
dependency hands its pointer to that one's, doubling the distance each round, so
a conversation of n turns takes log2(n) rounds; calls with several dependencies
are levelled by rounds over what is left of the graph.  No window or list over a
whole conversation is ever made: every join is on a call's identifier.

Canonical JSON: the argument text is parsed to a variant and written again, which
sorts the keys at all levels and drops white space outside strings; numbers keep
their value.

Defined results.  A null conv_id is a conversation like any other.  Identifier on several call rows of a conversation: they count as one call (least
tool and arguments; ``n_copies`` tells how many) that depends on the union of
theirs.  Several results for a call: ``n_results``, least content.  Result without
a call: a row of status ``orphan_result``.  Call without a result:
``unanswered``.  Dependency on an unknown id: ignored and counted in
``n_unknown_deps``.  Dependency cycle: depth null, status ``cycle``, also for
what depends on one.  Rows with a null call_id are dropped, as nothing can refer to
them.  Null, empty or bad JSON, repeated keys in it, or a value that is not an object: ``arguments`` null, not valid,
error ``not_an_object``.  Tool without a schema: error ``unknown_tool``.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, store, table


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds canonical ``arguments``, ``valid`` and ``errors`` to calls (tool, arguments)."""
    shape = schemas.dropna(subset=["tool", "param"]).dropDuplicates(["tool", "param"]).groupBy(F.col("tool").alias("s_tool")).agg(
        F.array_sort(F.collect_list(F.struct("param", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("params")
    )
    parsed = F.try_parse_json(F.col("arguments"))
    is_object = F.coalesce(F.startswith(F.expr("schema_of_variant(_v)"), F.lit("OBJECT")), F.lit(False))
    df = calls.withColumn("_v", parsed).withColumn("_object", is_object)
    df = df.withColumn("_values", F.when(F.col("_object"), F.expr("map_entries(cast(_v AS map<string, variant>))")))
    # only the kinds are compared: OBJECT<...> and ARRAY<...> by their heads
    df = df.withColumn("_kinds", F.expr("transform(_values, e -> struct(e.key AS key, regexp_extract(schema_of_variant(e.value), '^[A-Z]+', 0) AS kind))"))
    df = df.join(shape, df.tool == shape.s_tool, "left")
    errors = F.expr("""
      CASE WHEN NOT _object THEN array('not_an_object')
           WHEN params IS NULL THEN array('unknown_tool')
           ELSE array_sort(concat(
             transform(filter(params, p -> p.required AND NOT exists(_kinds, k -> k.key = p.param AND k.kind <> 'VOID')), p -> concat('missing:', p.param)),
             transform(filter(params, p -> exists(_kinds, k -> k.key = p.param AND k.kind <> 'VOID' AND k.kind <> p.type AND NOT (p.type = 'DOUBLE' AND k.kind IN ('BIGINT', 'DECIMAL')))), p -> concat('type:', p.param)),
             transform(filter(_kinds, k -> NOT exists(params, p -> p.param = k.key)), k -> concat('unknown:', k.key)))) END""")
    df = df.withColumn("errors", errors).withColumn("arguments", F.when(F.col("_object"), F.to_json("_v")))
    return df.withColumn("valid", F.size("errors") == 0).drop("_v", "_object", "_values", "_kinds", "params", "s_tool")


def depths(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, depth (null in or below a cycle): the longest chain of dependencies.

    ``edges`` (id, dep) are distinct and both ends are in ``ids`` (id).
    """
    n_deps = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("only"))
    # a call with one dependency points to it at distance 1; others point nowhere
    state = store(
        ids.join(n_deps, "id", "left").select("id", F.when(F.col("n") == 1, F.col("only")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("far"), F.coalesce("n", F.lit(0)).alias("n")), "calls-chains"
    )
    total = state.count()
    reach = 1
    while reach < total:  # a chain has fewer links than there are calls; a pointer that still moves then runs in a cycle
        last = state.select(F.col("id").alias("t_id"), F.col("to").alias("t_to"), F.col("far").alias("t_far"))
        moved = state.join(last, state["to"] == last.t_id, "left")
        step = F.col("t_to").isNotNull()
        new = store(moved.select("id", F.when(step, F.col("t_to")).otherwise(F.col("to")).alias("to"), F.when(step, F.col("far") + F.col("t_far")).otherwise(F.col("far")).alias("far"), "n", step.alias("moved")), "calls-chains")
        some = bool(new.filter("moved").limit(1).count())
        remove(state)
        state = new.drop("moved")
        state.stored_at = new.stored_at
        reach *= 2
        if not some:
            break
    # heads: calls without dependencies (depth 0) or with several; only the latter's graph is levelled in rounds
    several = store(
        edges.join(state.filter("n > 1").select("id"), "id", "left_semi")
        .join(state.select(F.col("id").alias("dep"), F.coalesce("to", F.col("id")).alias("head"), "far"), "dep").select("id", "head", "far"), "calls-graph"
    )
    known = store(state.filter("n = 0").select("id", F.lit(0).cast("long").alias("depth")), "calls-depth")
    while True:
        fresh = several.join(known, several["head"] == known["id"], "left").groupBy(several["id"].alias("id")).agg(
            F.max(F.col("far") + F.col("depth") + 1).alias("depth"), F.count_if(F.col("depth").isNull()).alias("open")
        ).filter("open = 0").join(known.select("id"), "id", "left_anti").select("id", "depth")
        fresh = store(fresh, "calls-level")
        if not fresh.limit(1).count():
            break
        known = store(known.unionByName(fresh), "calls-depth")
    # n = 1 pointers that ended at a known head; in a cycle the end is no head
    heads = known.select(F.col("id").alias("k_id"), "depth")
    at = F.when(F.col("n") == 1, F.col("to")).otherwise(F.col("id"))
    return state.join(heads, at == heads.k_id, "left").select("id", (F.col("far") + F.col("depth")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without one.  A call is known by its conversation and identifier together."""
    key = F.struct("conv_id", "call_id").alias("key")
    in_conversation = F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), lambda d: F.when(d.isNotNull(), F.struct(F.col("conv_id"), d.alias("call_id")))).alias("depends_on")
    calls = calls.filter("call_id IS NOT NULL").select(key, in_conversation, "tool", "arguments")
    results = results.filter("call_id IS NOT NULL").select(key, "content")
    one = calls.groupBy("key").agg(F.min(F.struct("tool", "arguments")).alias("least"), F.count(F.lit(1)).alias("n_copies"))
    one = store(one.select("key", "least.tool", "least.arguments", "n_copies"), "calls")
    wanted = calls.select(F.col("key").alias("id"), F.explode("depends_on").alias("dep")).filter("dep IS NOT NULL").distinct()
    ids = one.select(F.col("key").alias("id"))
    edges = wanted.join(ids.select(F.col("id").alias("dep"), F.lit(True).alias("is_known")), "dep", "left")
    edges = store(edges.select("id", "dep", F.coalesce("is_known", F.lit(False)).alias("is_known")), "calls-edges")
    depth = depths(edges.filter("is_known").select("id", "dep"), ids)
    unknown = edges.filter("NOT is_known").groupBy("id").agg(F.count(F.lit(1)).alias("n_unknown"))
    answers = results.groupBy("key").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    linked = validated(one, schemas).withColumn("_is_call", F.lit(True)).join(answers, "key", "full")
    linked = linked.join(depth.withColumnRenamed("id", "key"), "key", "left").join(unknown.withColumnRenamed("id", "key"), "key", "left")
    status = F.when(F.col("_is_call").isNull(), "orphan_result").when(F.col("depth").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    return linked.select(
        "key.conv_id", "key.call_id", "depth", status.alias("status"), "tool", "arguments", "valid", F.array_join("errors", ",").alias("errors"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown_deps"), "content",
    )


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations' turns as calls and results.

    A user turn is a call of ``reply`` with the prompt and the turn as arguments, named
    ``conv/turn``; it depends on the call two turns before.  An assistant turn is the result
    of the call one turn before.  A system turn is a call of ``configure`` on which the next turn depends.
    """
    rows = turns.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    name = lambda back: F.concat_ws("/", F.col("conv_id"), F.col("turn") - back)
    calls = rows.filter("role IN ('user', 'system')").select(
        "conv_id", name(0).alias("call_id"), F.array(name(1), name(2)).alias("depends_on"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("tool"),
        F.to_json(F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("prompt"))).alias("arguments"),
    )
    return calls, rows.filter("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))


SCHEMAS = [("reply", "prompt", "STRING", True), ("reply", "turn", "BIGINT", True), ("configure", "prompt", "STRING", True), ("configure", "turn", "BIGINT", True)]


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, p, k, r in SCHEMAS) + " AS t(tool, param, type, required)")
    return link_tool_calls(calls, results, schemas)


QUERIES = {"op8_tool_calls": op8_tool_calls}
# each turn depends on those one and two before it, if they are calls; so depth counts the calls before it without a gap
ORACLE = {
    "op8_tool_calls": """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, conv_id || '/' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS tool, '{"prompt":' || to_json(body) || ',"turn":' || turn || '}' AS arguments
      FROM t WHERE role IN ('user', 'system')),
u AS (SELECT call_id, conv_id, turn, min({'tool': tool, 'arguments': arguments}) AS least, count(*) AS n_copies FROM c GROUP BY ALL),
d AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM u
      UNION
      SELECT u.conv_id, u.turn, d.depth + 1 FROM d JOIN u ON u.conv_id = d.conv_id AND u.turn IN (d.turn + 1, d.turn + 2)),
m AS (SELECT conv_id, turn, max(depth) AS depth FROM d GROUP BY ALL),
a AS (SELECT conv_id, conv_id || '/' || (turn - 1) AS call_id, min(body) AS content, count(*) AS n_results FROM t WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.call_id, a.call_id) AS call_id, m.depth,
       CASE WHEN u.call_id IS NULL THEN 'orphan_result' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       least.tool AS tool, least.arguments AS arguments, CASE WHEN u.call_id IS NOT NULL THEN true END AS valid, CASE WHEN u.call_id IS NOT NULL THEN '' END AS errors,
       coalesce(n_copies, 0) AS n_copies, coalesce(n_results, 0) AS n_results,
       CASE WHEN u.call_id IS NULL THEN 0 ELSE 2 - (SELECT count(*) FROM u AS v WHERE v.conv_id = u.conv_id AND v.turn IN (u.turn - 1, u.turn - 2)) END AS n_unknown_deps, content
FROM u LEFT JOIN m ON m.conv_id = u.conv_id AND m.turn = u.turn FULL JOIN a ON a.call_id = u.call_id"""
}
