"""Chat formatting with tool calls: linking, ordering, validation and canonical JSON. DataFrame operations only.

A message's text may hold calls and results, as JSON objects between tags:

    <tool_call>{"id": "c1", "name": "search", "arguments": {...}, "after": ["c0"]}</tool_call>
    <tool_result>{"id": "c1", "content": ...}</tool_result>

after (optional) names calls of the same conversation that must come first. The result has one event for each message (its
text without those blocks), each call and each result; a conversation is never gathered into one row or one task:

- link: calls and results are hash-joined on (conv_id, id). Of several calls of one id the first (turn, place) owns it; the others are invalid
  (duplicate_id). Results without a call are kept, orphan.
- order: a call's level is the length of its longest chain of after, found by rounds that settle all calls whose predecessors have settled
  (Kahn's order, without a limit, each round reading only what the last one settled; runs of single predecessors by pointer doubling); calls
  in or behind a cycle, or after an unknown id, don't settle (level null, unordered). Sorting a conversation
  by (o_turn, o_level, o_place, o_part) gives each message, its calls in topological order, each followed by its results.
- validate: against schemas, {name: {argument: (type, required)}}, types string, integer (of any size), number, boolean, array and object;
  the error names what is wrong (bad_json, no_id, duplicate_id, unknown_tool, missing:..., type:..., extra:...; type:arguments and type:after
  where these are no object and no list). No arguments count as an empty object.
- serialise: canonical JSON, keys sorted at all depths, no white space. Numbers of 39 digits and more, or with an exponent of three digits and more, are kept
  as written (not in blocks that have the characters U+E000 to U+E002); other numbers with an exponent are written as doubles.

A block ends at the first end tag; inside a JSON string this is to be written <\\/tool_call>, else the block is cut there (bad_json).

Null text counts as empty, null role as "unknown"; null conv_id and turn stay null and link to nothing. Text of a malformed block is
kept in its event's JSON as a string. Repeated rows give repeated events (calls with one id: duplicate_id). An empty table gives an
empty result. Other columns, whatever their names, are ignored. Texts of any length are read whole; a linear pattern finds the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import discard, prepare, stored, table

SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
    "classify": {"text": ("string", True), "labels": ("array", True), "threshold": ("number", False), "multi": ("boolean", False)},
}
_CALL, _RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"
_EVENT = ["conv_id", "turn", "kind", "call_id", "o_turn", "o_level", "o_place", "o_part", "linked", "error", "json"]


_BIG, _BACKSLASH, _QUOTE = "\ue000", "\ue001", "\ue002"  # marks of numbers and escapes while a block is parsed
_LONG = r"[0-9][0-9.]{38}|[eE][+-]?[0-9]{3}"
_NUMBER = r"(?<![0-9.eE+-])-?(?=[0-9.]{39}|[0-9.]+[eE][+-]?[0-9]{3})(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.eE+-])"


def _kind_of(value: Column) -> Column:
    """The JSON type of a variant."""
    t, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    big = (t == "STRING") & text.startswith(_BIG)
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(big, F.when(text.rlike("^.-?[0-9]+$"), "integer").otherwise("number")).when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
        .when((t == "BIGINT") | t.rlike(r"^DECIMAL\([0-9]+,\s*0\)$"), "integer").when(t.startswith("DECIMAL") | (t == "DOUBLE"), "number").otherwise("null")
    )


def _marked(raw: Column) -> Column:
    """raw with each number that a variant would round as a string that begins with _BIG; only what lies outside strings changes."""
    plain = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    parts = F.transform(F.split(plain, '"'), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, _NUMBER, f'"{_BIG}$0"')).otherwise(x))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _blocks(messages: DataFrame, pattern: str) -> DataFrame:
    """mid, conv_id, turn, place, raw, big, v, call_id: the blocks of one kind."""
    found = messages.select("mid", "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("place", "raw"))
    found = found.withColumn("big", F.col("raw").rlike(_LONG) & ~F.col("raw").rlike(f"[{_BIG}-{_QUOTE}]"))
    found = found.withColumn("v", F.try_parse_json(F.when(F.col("big"), _marked(F.col("raw"))).otherwise(F.col("raw"))))
    return found.withColumn("call_id", F.expr("try_variant_get(v, '$.id', 'string')"))


def _canonical() -> Column:
    text = F.to_json("v")
    return F.coalesce(F.when(F.col("big"), F.regexp_replace(text, f'"{_BIG}([^"]*)"', "$1")).otherwise(text), F.to_json(F.struct("raw")))


def _faults(calls: DataFrame, schemas: dict) -> DataFrame:
    """mid, place, error: the schema errors of calls whose tool is known."""
    spark = calls.sparkSession
    rows = [(tool, a, t, required) for tool, args in schemas.items() for a, (t, required) in args.items()]
    wanted = F.broadcast(spark.createDataFrame(rows, "name string, arg string, want string, required boolean"))  # as large as schemas, an argument
    arguments = F.try_variant_get("v", "$.arguments", "variant")
    shaped = calls.select("mid", "place", "name", "v", F.coalesce(arguments.isNull() | (_kind_of(arguments) == "object"), F.lit(True)).alias("shaped"), _kind_of(F.try_variant_get("v", "$.after", "variant")).alias("order"))
    fit = shaped.where("shaped")
    each = spark.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), "$.arguments", "variant"))
    given = fit.lateralJoin(each).select("mid", "place", "name", F.col("key").alias("arg"), _kind_of(F.col("value")).alias("got"))
    both = fit.select("mid", "place", "name").join(wanted, "name").join(given.drop("name"), ["mid", "place", "arg"], "left")
    fits = (F.col("got") == F.col("want")) | ((F.col("want") == "number") & (F.col("got") == "integer"))
    wrong = both.select("mid", "place", F.when(F.col("got").isNull() & F.col("required"), F.concat(F.lit("missing:"), "arg")).when(F.col("got").isNotNull() & ~fits, F.concat(F.lit("type:"), "arg")).alias("e"))
    extra = given.join(wanted.select("name", "arg"), ["name", "arg"], "left_anti").select("mid", "place", F.concat(F.lit("extra:"), "arg").alias("e"))
    whole = shaped.select("mid", "place", F.explode(F.array(F.when(~F.col("shaped"), "type:arguments"), F.when(~F.col("order").isin("array", "null"), "type:after"))).alias("e"))
    return wrong.unionByName(extra).unionByName(whole).where("e is not null").groupBy("mid", "place").agg(F.concat_ws(",", F.array_sort(F.collect_list("e"))).alias("fault"))


def _levels(owners: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that settle. owners: conv_id, call_id, after (array of ids).

    Runs of calls with one predecessor each are followed by pointer doubling; Kahn's rounds then settle the calls with several, until
    none settles.
    """
    spark = owners.sparkSession
    waits = stored(owners.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct(), "waits")
    begun = stored(owners.where("size(after) = 0").select("conv_id", "call_id", F.lit(0).alias("level")), "settled")
    counts = stored(waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("at")), "open")
    jumps = stored(counts.where("n = 1").select("conv_id", "call_id", "at", F.lit(1).cast("long").alias("far"), F.lit(True).alias("moved")), "jumps")
    # Steps double each time; what hasn't left the runs after as many steps as there are calls is in or behind a cycle.
    for _ in range(jumps.count().bit_length()):
        on = jumps.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        far = jumps.join(on, ["conv_id", "at"], "left")
        last, jumps = jumps, stored(far.select("conv_id", "call_id", F.coalesce("next", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")), "jumps")
        discard(last)
        if not jumps.where("moved").take(1):
            break
    ends = jumps.select("conv_id", F.col("call_id").alias("dep"), "at", "far")
    # What waits for several: left counts those that haven't settled, level is that of the settled ones so far.
    several = counts.where("n > 1").select("conv_id", "call_id", F.col("n").alias("left"), F.lit(0).alias("level"))
    open_ = stored(several, "open")
    several = waits.join(several.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi").join(ends, ["conv_id", "dep"], "left")
    steps = stored(several.select("conv_id", "call_id", F.coalesce("at", "dep").alias("dep"), (F.coalesce("far", F.lit(0)) + 1).cast("int").alias("far")), "waits")
    settled, new = [begun], begun
    while open_.take(1) and new.take(1):
        met = steps.join(new.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("base")), ["conv_id", "dep"])
        met = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("m"), F.max(F.col("base") + F.col("far")).alias("best"))
        now = open_.join(met, ["conv_id", "call_id"], "left")
        now = stored(now.select("conv_id", "call_id", (F.col("left") - F.coalesce("m", F.lit(0))).alias("left"), F.greatest("level", F.coalesce("best", F.lit(0))).alias("level")), "open")
        new = stored(now.where("left = 0").select("conv_id", "call_id", "level"), "settled")
        settled.append(new)
        last, open_ = open_, stored(now.where("left > 0"), "open")
        discard(last, now)
    done = spark.read.schema(begun.schema).parquet(*(x._stored_path for x in settled))
    on = done.select("conv_id", F.col("call_id").alias("at"), "level")
    along = jumps.join(on, ["conv_id", "at"]).select("conv_id", "call_id", (F.col("level") + F.col("far")).cast("int").alias("level"))
    out = stored(done.unionByName(along), "levels")
    discard(*settled, open_, steps, waits, counts, jumps)
    return out


def format_chat(conversations: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, kind, call_id, o_turn, o_level, o_place, o_part, linked, error, json: the events."""
    prepare(conversations.sparkSession)
    messages = conversations.select(F.monotonically_increasing_id().alias("mid"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = stored(messages.where(F.col("text").contains("<tool_")), "tool-messages")

    plain = F.when(F.col("text").contains("<tool_"), F.regexp_replace(F.regexp_replace("text", _CALL, ""), _RESULT, "")).otherwise(F.col("text"))
    said = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.col("turn").alias("o_turn"), F.lit(0).alias("o_level"), F.lit(-1).alias("o_place"), F.lit(0).alias("o_part"),
        F.lit(False).alias("linked"), F.lit(None).cast("string").alias("error"),
        F.to_json(F.struct(plain.alias("content"), "role")).alias("json"),
    )

    calls = stored(_blocks(held, _CALL).withColumn("name", F.expr("try_variant_get(v, '$.name', 'string')")).withColumn("after", F.coalesce(F.expr("try_variant_get(v, '$.after', 'array<string>')"), F.array().cast("array<string>"))), "calls")
    key = F.struct("turn", "mid", "place")
    named = calls.where("call_id is not null and conv_id is not null")
    owner = stored(named.groupBy("conv_id", "call_id").agg(F.min_by(F.struct("mid", "place", "turn", F.array_distinct(F.filter("after", lambda x: x.isNotNull())).alias("after")), key).alias("own")), "owners")
    level = _levels(owner.select("conv_id", "call_id", "own.after"))
    results = stored(_blocks(held, _RESULT), "results")
    answered = results.where("call_id is not null").select("conv_id", "call_id").distinct().withColumn("linked", F.lit(True))
    first = owner.join(level, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("own.mid").alias("mid"), F.col("own.place").alias("place"), F.col("own.turn").alias("own_turn"), "level")
    first = stored(first, "first")

    tool = F.create_map(*[F.lit(x) for n in schemas for x in (n, True)]) if schemas else F.create_map().cast("map<string,boolean>")
    judged = calls.join(first.select("mid", "place", "level", F.lit(True).alias("is_owner")), ["mid", "place"], "left").join(_faults(calls, schemas), ["mid", "place"], "left").join(answered, ["conv_id", "call_id"], "left")
    error = (
        F.when(F.col("v").isNull(), "bad_json").when(F.col("call_id").isNull(), "no_id").when(F.col("is_owner").isNull() & F.col("conv_id").isNotNull(), "duplicate_id")
        .when(F.col("name").isNull() | F.element_at(tool, F.coalesce("name", F.lit(""))).isNull(), "unknown_tool").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("level").isNull() & F.col("conv_id").isNotNull(), "unordered")
    )
    text = _canonical()
    called = judged.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("turn").alias("o_turn"), F.col("level").alias("o_level"), F.col("place").alias("o_place"), F.lit(0).alias("o_part"), (F.coalesce("linked", F.lit(False)) & F.col("is_owner").isNotNull()).alias("linked"), error.alias("error"), text.alias("json"))

    at = first.select("conv_id", "call_id", "own_turn", "level", F.col("place").alias("own_place"))
    got = results.join(at, ["conv_id", "call_id"], "left")
    orphan = F.col("own_turn").isNull()
    returned = got.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.when(orphan, F.col("turn")).otherwise(F.col("own_turn")).alias("o_turn"), "level", F.when(orphan, F.col("place")).otherwise(F.col("own_place")).alias("o_place"), F.lit(1).alias("o_part"), (~orphan).alias("linked"), F.when(F.col("v").isNull(), "bad_json").when(F.col("call_id").isNull(), "no_id").when(orphan, "orphan").alias("error"), text.alias("json")).withColumnRenamed("level", "o_level")
    return said.unionByName(called).unionByName(returned).select(*_EVENT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))


#: For conversations without blocks, as in the synthetic tables; blocks are tested on fixtures.
ORACLE = """
SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS o_turn, 0 AS o_level, -1 AS o_place, 0 AS o_part, false AS linked,
       CAST(NULL AS VARCHAR) AS error, '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, 'unknown')) || '}' AS json
FROM conversations
"""
