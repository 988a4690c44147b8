"""Tool calls in conversations: linking, ordering, checking, canonical JSON.

Calls ``(conv_id, call_id, turn, name, arguments, after)`` and results ``(conv_id, call_id, turn, content)`` meet
by a hash join on (conversation, call id). ``arguments`` is JSON text; ``after`` names a call of the same
conversation whose result this call uses, or is null.

* Order. A call's level is its number of predecessors along ``after``; (level, turn, call id) is a
  topological order. Levels come from pointer doubling: each round every call looks twice as far back, so a
  chain of a million calls takes twenty joins, whatever the size of its conversation. Calls whose chain
  never ends lie on or behind a cycle and have no level; a call that names an unknown call, or one more than once made, starts a chain.
* Schemas. ``schemas`` maps a tool's name to {argument: (SQL type, required)}; arguments must be one JSON object
  with the required arguments and no unknown ones, each of its type.
* Canonical JSON. Objects with sorted keys and no blanks, nested ones too.

One row per call and per matching result: a call without result keeps nulls, a call id that occurs more than once in its
conversation is linked to all its results and marked, a result without call is a row of its own. Null ids
link with nothing. All work is DataFrame operations; a conversation is never gathered in one place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import written

MAX_ROUNDS = 40  # chains of up to 2 ** 40 calls


def canonical(json: Column) -> Column:
    """Canonical text of a JSON document; null for what is no JSON. A variant stores objects by sorted key."""
    return F.to_json(F.try_parse_json(json))


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Array of what is wrong with a call, in the order of the schema; empty for a valid one."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            given = F.array_contains(keys, field)
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            have = F.schema_of_variant(value)
            fits = {"string": have == "STRING", "long": have == "BIGINT", "boolean": have == "BOOLEAN",
                    "double": have.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")}[kind]
            if required:
                checks.append(F.when(~given, F.lit(f"missing {field}")))
            checks.append(F.when(given & ~F.coalesce(fits, F.lit(False)), F.lit(f"{field} is no {kind}")))
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)))),
                              lambda k: F.concat(F.lit("unknown "), k))
        found = found.when(name == tool, F.concat(F.array_compact(F.array(*checks)), unknown))
    found = found.otherwise(F.array(F.lit("unknown tool")))
    return F.when(~is_object, F.array(F.lit("no JSON object"))).otherwise(found)


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of calls with unique ids; null on or behind a cycle."""
    once = (calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
            .groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("after").alias("after"))
            .where("n = 1").drop("n"))
    known = once.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    reach = written(once.join(known, ["conv_id", "after"], "left")
                    .select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("after"),
                            F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level")), "levels")
    last = None
    for _ in range(MAX_ROUNDS):
        unfinished = reach.where(F.col("after").isNotNull()).count()
        if unfinished == 0:
            break
        if unfinished == last and reach.where("after is not null").join(
                reach.where("after is null").select("conv_id", F.col("call_id").alias("after")),
                ["conv_id", "after"], "left_semi").isEmpty():
            break  # nobody's pointer will reach a start: cycles only
        last = unfinished
        behind = reach.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("further"),
                              F.col("level").alias("more"))
        reach = written(reach.join(behind, ["conv_id", "after"], "left")
                        .select("conv_id", "call_id", F.col("further").alias("after"),
                                (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return reach.select("conv_id", "call_id", F.when(F.col("after").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """Calls with their results, levels, problems and canonical text; results without call at the end.

    ``status``: ``ok``, ``no_result``, ``no_call``, ``result_before_call``, ``invalid`` or ``cycle``, the first that
    holds from the right. ``record`` is the canonical JSON of call and result.
    """
    ids = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", "after")
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    times = (calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
             .groupBy(*ids).agg(F.count("*").alias("times")))
    known = times.select(*ids)
    linked = (calls.join(results, ids, "left").join(times, ids, "left").join(levels(calls), ids, "left")
              .withColumn("problems", problems(F.col("name"), F.col("arguments"), schemas)))
    orphans = results.join(known, ids, "left_anti")
    both = linked.unionByName(orphans.withColumn("status", F.lit("no_call")), allowMissingColumns=True)
    status = (F.when(F.col("status").isNotNull(), F.col("status"))
              .when((F.col("times") == 1) & F.col("level").isNull(), F.lit("cycle"))
              .when(F.size("problems") > 0, F.lit("invalid"))
              .when(F.col("result_turn").isNull(), F.lit("no_result"))
              .when(F.col("result_turn") <= F.col("call_turn"), F.lit("result_before_call"))
              .otherwise(F.lit("ok")))
    record = F.to_json(F.named_struct(
        F.lit("after"), F.col("after"), F.lit("arguments"), F.try_parse_json("arguments"),
        F.lit("call_id"), F.col("call_id"), F.lit("content"), F.col("content"), F.lit("name"), F.col("name")))
    return (both.withColumn("status", status).withColumn("repeated_id", F.coalesce(F.col("times") > 1, F.lit(False)))
            .withColumn("record", record)
            .select("conv_id", "call_id", "call_turn", "result_turn", "name", "after", "level", "status",
                    "problems", "repeated_id", "record"))


# What the conversations table stands for: a user turn asks, the next assistant turn answers.
ANSWER = {"answer": {"conversation": ("long", True), "turn": ("long", True), "question": ("string", True),
                     "words": ("long", True), "brief": ("boolean", False)}}
BRIEF_WORDS = 30


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations contain.

    Each user turn calls ``answer`` with its question; it uses the answer to the user turn before it. Each assistant turn
    is the result of the call of the user turn before it. Turns that follow each other are found by a join on
    (conversation, turn number), not by gathering conversations.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role",
                                 F.col("text").cast("string"))
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    users = turns.where("role = 'user'")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    calls = (users.join(earlier, ["conv_id", "turn"], "left")
             .select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.lit("answer").alias("name"),
                     F.to_json(F.named_struct(
                         F.lit("words"), words, F.lit("turn"), F.col("turn"), F.lit("question"), F.col("text"),
                         F.lit("conversation"), F.col("conv_id"), F.lit("brief"), words <= BRIEF_WORDS))
                     .alias("arguments"),
                     F.when(F.col("follows"), call_id(F.col("turn") - 2)).alias("after")))
    results = (turns.where("role = 'assistant'")
               .select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn",
                       F.col("text").alias("content")))
    return calls, results
