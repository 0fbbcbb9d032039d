"""Chat formatting: links tool calls to their results, orders and validates them, and writes canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch

#: Types of a schema and the JSON types (as Spark names them) that satisfy them.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

#: What may stand before JSON: a byte order mark, and the blanks of JSON itself.
BEFORE_JSON = r"^\x{FEFF}?[\x20\x09\x0A\x0D]*"

Schemas = dict[str, dict[str, tuple[str, bool]]]


def invalid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Null if the arguments fit the schema of ``name``, else what is wrong first; fields are checked in name order."""
    found = F.lit("unknown tool")
    for tool, fields in schemas.items():
        wrong = [F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments are no object"))]
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            fits = F.lit(False)
            for prefix in TYPES[kind]:
                fits = fits | F.schema_of_variant(value).startswith(prefix)
            wrong.append(F.when(absent, F.lit(f"{field} is missing") if required else F.lit(None)).when(~fits, F.lit(f"{field} is no {kind}")))
        found = F.when(name == tool, F.coalesce(*wrong)).otherwise(found)
    return F.when(name.isNull(), F.lit("unknown tool")).otherwise(found)


def parts(messages: DataFrame, schemas: Schemas) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and plain messages, by what the text of each row holds."""
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    bare = F.regexp_replace("text", BEFORE_JSON, "")
    json = F.when(bare.startswith("{"), F.try_parse_json(bare))
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get(json, "$.tool_calls", "array<variant>")))
    rows = rows.withColumn("answers", F.when(F.col("role") == "tool", F.try_variant_get(json, "$.tool_call_id", "string")))
    rows = rows.withColumn("content", F.when(F.col("role") == "tool", F.try_variant_get(json, "$.content", "string")))
    called = rows.where("calls IS NOT NULL").select("conv_id", "turn", F.posexplode("calls").alias("part", "call"))
    get = lambda path, kind: F.try_variant_get("call", path, kind)
    calls = called.select(
        "conv_id", "turn", "part", get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"),
        get("$.arguments", "variant").alias("arguments"), F.coalesce(get("$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    calls = calls.withColumn("problem", invalid(F.col("name"), F.col("arguments"), schemas)).withColumn("arguments", F.to_json("arguments"))
    results = rows.where("answers IS NOT NULL").select("conv_id", "turn", F.lit(0).alias("part"), F.col("answers").alias("call_id"), "content")
    plain = rows.where("calls IS NULL AND answers IS NULL").select("conv_id", "turn", F.lit(0).alias("part"), "role", "text")
    return calls, results, plain


def ordered(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, at (turn from which the call may run), level (order within it), cyclic, unmet.

    A call runs after those it names in ``after``. Where all of these came earlier, as in any recorded conversation, the
    order of turns is topological already. Only conversations that name a later call are sorted by rounds: in each, the
    calls whose needs are settled follow the latest of them; calls on a cycle are never settled. The number of rounds is
    the longest chain in such conversations.
    """
    keys = calls.select("conv_id", "call_id", "turn", "part")
    needs = calls.select("conv_id", "call_id", "turn", "part", F.explode(F.array_distinct("after")).alias("need"))
    target = keys.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need"), F.struct("turn", "part").alias("need_at"))
    linked = needs.join(target, (F.col("conv_id") == F.col("c")) & (needs.need == target.need), "left").select(
        "conv_id", "call_id", "turn", "part", needs.need.alias("need"), "need_at"
    )
    linked = scratch.table("needs", linked)
    unmet = linked.where("need_at IS NULL").select("conv_id", "call_id").distinct().withColumn("unmet", F.lit(True))
    odd = linked.where("need_at IS NOT NULL AND need_at >= struct(turn, part)").select("conv_id").distinct()
    odd = scratch.table("odd", odd)
    out = keys.select("conv_id", "call_id", F.col("turn").alias("at"), F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    if not odd.isEmpty():
        edges = linked.where("need_at IS NOT NULL").join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "need")
        todo = scratch.table("todo0", keys.join(odd, "conv_id", "left_semi"))
        settled, rounds = None, 0
        while True:
            if settled is None:
                open_ = edges.select("conv_id", "call_id").distinct()
                ready = todo.join(open_, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("turn").alias("at"), F.lit(0).alias("level"))
            else:
                before = settled.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.struct("at", "level").alias("done"))
                seen = edges.join(before, (F.col("conv_id") == F.col("c")) & (F.col("need") == F.col("n")), "left")
                full = seen.groupBy("conv_id", "call_id").agg(F.count_if(F.col("done").isNull()).alias("open"), F.max("done").alias("done")).where("open = 0")
                own = F.col("turn") > F.col("done.at")
                ready = todo.join(full, ["conv_id", "call_id"]).select(
                    "conv_id", "call_id", F.greatest("turn", F.col("done.at")).alias("at"), F.when(own, 0).otherwise(F.col("done.level") + 1).alias("level")
                )
            ready = scratch.table(f"ready{rounds}", ready)
            if ready.isEmpty():
                break
            settled = ready if settled is None else scratch.table(f"settled{rounds}", settled.unionByName(ready))
            todo = scratch.table(f"todo{rounds + 1}", todo.join(ready, ["conv_id", "call_id"], "left_anti"))
            rounds += 1
        last = F.lit(2**30)
        stuck = todo.select("conv_id", "call_id", F.col("turn").alias("at"), last.alias("level"), F.lit(True).alias("cyclic"))
        sorted_ = stuck if settled is None else settled.withColumn("cyclic", F.lit(False)).unionByName(stuck)
        out = out.join(odd, "conv_id", "left_anti").unionByName(sorted_)
    return out.join(unmet, ["conv_id", "call_id"], "left").withColumn("unmet", F.coalesce("unmet", F.lit(False)))


def matched(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Hash join of calls and results by conversation and id: conv_id, call_id, result_uid.

    Both sides hold one row per key, numbers and a short id each, so a partition's hash table is small and no key is hot.
    """
    return calls.select("conv_id", "call_id").join(results.hint("shuffle_hash"), ["conv_id", "call_id"])


def link(messages: DataFrame, schemas: Schemas, scratch: Scratch) -> DataFrame:
    """One row per message, call and result: conv_id, at, level, turn, part, kind, call_id, status, json.

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` holds calls, a tool's text
    ``{"tool_call_id", "content"}`` a result, also after a byte order mark or blanks; any other text, valid JSON or not,
    is a plain message. Calls and results
    are joined by conversation and id. Of several calls or results with one id the first counts, the others are kept and
    marked. Sorting a conversation by at, level, turn, part and kind gives a topological order: a call follows the calls
    it needs, a result its call. Status is ``ok``, or says what is wrong. ``json`` is canonical: keys in order, no
    blanks; calls carry their validated arguments and the linked result. Rows are never gathered by conversation, so a
    hot one is no more than rows of one key; repeated ids are reduced before they are joined.

    Null texts are plain messages with null content; rows with a null conv_id, turn or id stay, and link to nothing.
    Repeated rows are reported each. Other columns are ignored; no rows give no rows.
    """
    calls, results, plain = parts(messages, schemas)
    calls = scratch.table("calls", calls.withColumn("uid", F.monotonically_increasing_id()))
    results = scratch.table("results", results.withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct("turn", "part", "uid")).alias("first")
    key = ["conv_id", "call_id"]
    one_call = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(first)
    one_call = scratch.table("one_call", one_call.select(*key, F.col("first.uid").alias("uid")))
    heads = calls.join(one_call, [*key, "uid"])
    one_result = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(first)
    one_result = one_result.select(*key, F.col("first.uid").alias("result_uid"))
    answered = matched(one_call, one_result).join(results.select(F.col("uid").alias("result_uid"), "content"), "result_uid")
    order = scratch.table("order", ordered(heads, scratch))
    tied = scratch.table("tied", one_call.join(order, key).join(answered, key, "left").select("uid", "at", "level", "cyclic", "unmet", "result_uid", "content"))

    call_rows = calls.join(tied, "uid", "left").select(
        "conv_id",
        F.coalesce("at", "turn").alias("at"),
        F.coalesce("level", F.lit(0)).alias("level"),
        "turn",
        "part",
        F.lit("call").alias("kind"),
        "call_id",
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no id")
        .when(F.col("at").isNull() & F.col("level").isNull(), "repeated id")
        .when(F.col("cyclic"), "cycle")
        .when(F.col("unmet"), "unknown need")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("result_uid").isNull(), "no result")
        .otherwise("ok")
        .alias("status"),
        F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), F.lit("assistant").alias("role"))).alias("json"),
    )
    of_result = tied.where("result_uid IS NOT NULL").select(F.col("result_uid").alias("uid"), "at", F.col("level").alias("call_level"))
    known = one_call.select(*key, F.lit(True).alias("known"))
    result_rows = (
        results.join(of_result, "uid", "left")
        .join(known, key, "left")
        .select(
            "conv_id",
            F.greatest("turn", "at").alias("at"),
            F.when(F.col("at") >= F.col("turn"), F.col("call_level") + 1).otherwise(0).alias("level"),
            "turn",
            "part",
            F.lit("result").alias("kind"),
            "call_id",
            F.when(F.col("call_level").isNotNull(), "ok").when(F.col("known"), "repeated result").otherwise("no call").alias("status"),
            F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"),
        )
    )
    plain_rows = plain.select(
        "conv_id",
        F.col("turn").alias("at"),
        F.lit(0).alias("level"),
        "turn",
        "part",
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit("ok").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return plain_rows.unionByName(call_rows).unionByName(result_rows)
