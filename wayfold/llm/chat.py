"""Chat formatting with linked tool calls.

A message may carry a JSON object as its text: an assistant's with ``tool_calls`` (objects
with ``id``, ``name``, ``arguments`` and, where a call waits for the results of others,
``depends_on``: their ids; name and arguments may stand below ``function``), or a tool's with
the ``tool_call_id`` that it answers. Calls and results are linked by a hash join on
conversation and identifier.

The order is topological. A message stands at (anchor_turn, depth): its own turn and 0, unless
links move it. A result stands right after its call's message, at depth + 1, wherever it
stood before; results of one message in the order of its calls, several of one call by turn.
A message whose calls wait for others stands after the results of those, at their anchor and
depth + 1, if that is later than its own turn. Places are found in rounds. Each settles the
messages that wait for settled ones only, and lets a message that waits for one which itself
waits for a single other wait for that other instead, at the sum of both distances: a chain of
n takes some log2(n) rounds, and where messages wait for several the rounds are as many as
such levels at most. Messages that wait in a circle, or for one that does, keep their own turns and are
marked ``cyclic``. ``position`` counts a conversation's messages from 1 in that order; it comes
from a sort in ranges and offsets, never from one task a conversation.

Arguments, also those given as JSON text, are validated against a schema for each tool, and
each message is serialised as canonical JSON: every key that was given, and ``role``, sorted at
every level, values of their own types, no spare white space.

Null text is empty content; a null role is ``unknown``; a row with a null conversation or turn
links with nothing, has no position and is kept. Repeated rows are messages each; where calls
repeat an identifier in a conversation, results link to the first (by turn, then number).
Text that isn't such an object is plain content, as it stands. A call without an identifier
links with nothing, and so does waiting for an id that no call has. An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, drop

#: Tool name to its arguments: name, type (string, integer, number, boolean, object, array), required.
SCHEMAS: dict[str, list[tuple[str, str, bool]]] = {
    "search": [("query", "string", True), ("limit", "integer", False)],
    "lookup": [("id", "integer", True)],
    "calculate": [("expression", "string", True), ("digits", "number", False)],
}
#: What schema_of_variant() says of a value of each type.
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """The string there; null where there is none or it is of another type."""
    return F.when(F.schema_of_variant(_get(v, path)) == "STRING", _get(v, path, "string"))


def _valid(name: Column, arguments: Column, schemas: dict[str, list[tuple[str, str, bool]]]) -> Column:
    """Whether arguments (a variant) fit the tool's schema: known names only, required ones
    there, each of its type. Unknown tools don't fit."""
    given = _get(arguments, "$", "map<string,variant>")
    out = F.lit(False)
    for tool, fields in schemas.items():
        good = F.size(F.array_except(F.map_keys(given), F.array(*(F.lit(f) for f, _, _ in fields)))) == 0
        for field, kind, required in fields:
            there = F.array_contains(F.map_keys(given), field)
            typed = F.schema_of_variant(_get(arguments, f"$.{field}")).rlike(_TYPES[kind])
            good = good & F.when(there, F.coalesce(typed, F.lit(False))).otherwise(F.lit(not required))
        out = F.when(name == tool, good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _json(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def _object(v: Column, instead: dict[str, Column]) -> Column:
    """The JSON of an object (a variant), keys sorted, with some values (JSON text) instead
    of its own; a null among those leaves what was given."""
    own = _get(v, "$", "map<string,variant>")
    own = F.transform(F.map_entries(F.coalesce(own, F.create_map().cast("map<string,variant>"))), lambda e: F.struct(e["key"].alias("key"), _json(e["value"]).alias("json")))
    new = F.array_compact(F.array(*(F.when(j.isNotNull(), F.struct(F.lit(k).alias("key"), j.alias("json"))) for k, j in instead.items())))
    left = F.filter(own, lambda e: ~F.exists(new, lambda x: x["key"] == e["key"]))
    parts = F.transform(F.array_sort(F.concat(left, new)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _call(c: Column, schemas: dict) -> Column:
    """id, waits (ids), valid and json of one call."""
    nested = _get(c, "$.function.name").isNotNull() | _get(c, "$.function.arguments").isNotNull()
    at = lambda path: F.coalesce(_get(c, f"$.{path}"), _get(c, f"$.function.{path}"))
    raw = at("arguments")
    parsed = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string")))
    arguments = F.coalesce(parsed, raw)
    name = F.coalesce(_text(c, "$.name"), _text(c, "$.function.name"))
    written = F.when(raw.isNotNull(), _json(arguments))
    flat = _object(c, {"arguments": F.when(_get(c, "$.arguments").isNotNull(), written)})
    below = _object(c, {"function": _object(_get(c, "$.function"), {"arguments": F.when(_get(c, "$.function.arguments").isNotNull(), written)})})
    waits = F.filter(F.coalesce(_get(c, "$.depends_on", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.struct(_text(c, "$.id").alias("id"), waits.alias("waits"), _valid(name, arguments, schemas).alias("valid"), F.when(nested, below).otherwise(F.when(_get(c, "$", "map<string,variant>").isNotNull(), flat).otherwise(_json(c))).alias("json"))


def _read(df: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, role, tool_call_id, calls and message."""
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))
    read = df.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"), body.alias("body"))
    answers = F.when(F.col("role") == "tool", _text(F.col("body"), "$.tool_call_id"))
    given = F.when(F.col("role") == "assistant", _get(F.col("body"), "$.tool_calls", "array<variant>"))
    read = read.withColumns({"tool_call_id": answers, "given": given}).withColumn("calls", F.transform("given", lambda c: _call(c, schemas)))
    role, listed = _quoted(F.col("role")), F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: c["json"]), ","), F.lit("]"))
    special = _object(F.col("body"), {"role": role, "tool_calls": F.when(F.col("calls").isNotNull(), listed)})
    plain = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), role, F.lit("}"))
    message = F.when(F.col("tool_call_id").isNotNull() | F.col("calls").isNotNull(), special).otherwise(plain)
    return read.select("conv_id", "turn", "role", "tool_call_id", "calls", message.alias("message"))


def _places(calls: DataFrame, first: DataFrame) -> DataFrame:
    """conv_id, turn, anchor, depth, cyclic of the messages whose calls wait for others.

    ``calls``: conv_id, turn, waits; ``first``: conv_id, id, at (turn and number of its call)."""
    waits = calls.select("conv_id", "turn", F.explode("waits").alias("id")).join(first, ["conv_id", "id"])
    waits = waits.select("conv_id", "turn", F.col("at.turn").alias("for")).distinct()
    place = lambda anchor, depth: F.struct(anchor.alias("anchor"), depth.cast("long").alias("depth"))
    none = F.lit(0).cast("long")
    edges = F.collect_list(F.struct("for", F.lit(1).cast("long").alias("far")))  # of one message's calls
    # best: the latest place found so far; waits: whom a message still waits for, and how far off
    now = cut(waits.groupBy("conv_id", "turn").agg(edges.alias("waits")).withColumns({"best": place(F.col("turn"), none), "done": F.lit(False), "cyclic": F.lit(False)}), "waits")
    seen = most = None
    while True:
        open_ = now.where("not done")
        each = F.transform("waits", lambda e: F.xxhash64("conv_id", "turn", e["for"], e["far"]).cast("decimal(38,0)"))
        mark = open_.agg(F.count(F.lit(1)), F.sum(F.aggregate(each, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)")))).first()
        most = mark[0] if most is None else most
        if not mark[0] or mark == seen:
            break
        seen = mark
        other = now.select("conv_id", F.col("turn").alias("for"), F.col("best").alias("their"), F.col("done").alias("settled"), F.col("cyclic").alias("circle"), F.when(F.size("waits") == 1, F.col("waits")[0]).alias("next"))
        asked = open_.select("conv_id", "turn", F.explode("waits").alias("e")).select("conv_id", "turn", "e.for", "e.far").join(other, ["conv_id", "for"], "left")
        gone = F.coalesce("settled", F.lit(True))
        later = place(F.coalesce("their.anchor", F.col("for")), F.coalesce("their.depth", none) + 2 * F.col("far"))
        step = F.when(gone, F.lit(None)).when(F.col("next").isNotNull(), F.struct(F.col("next.for").alias("for"), (F.col("far") + F.col("next.far")).alias("far"))).otherwise(F.struct("for", "far"))
        asked = asked.select("conv_id", "turn", step.alias("e"), F.when(gone | F.col("next").isNotNull(), later).alias("p"), F.coalesce("circle", F.lit(False)).alias("circle"))
        asked = asked.groupBy("conv_id", "turn", F.col("e.for").alias("for")).agg(F.max("e.far").alias("far"), F.max("p").alias("p"), F.max("circle").alias("circle"))
        left = F.collect_list(F.when(F.col("for").isNotNull(), F.struct("for", "far")))
        found = asked.groupBy("conv_id", "turn").agg(left.alias("waits"), F.max("p").alias("p"), F.max("circle").alias("cyclic"), F.max("far").alias("far"))
        after = open_.select("conv_id", "turn", "best").join(found, ["conv_id", "turn"])
        stuck = F.col("cyclic") | F.coalesce(F.col("far") > most, F.lit(False))  # farther than there are messages: a circle
        after = after.select("conv_id", "turn", "waits", F.greatest("best", F.coalesce("p", "best")).alias("best"), (stuck | (F.size("waits") == 0)).alias("done"), stuck.alias("cyclic"))
        then = cut(now.where("done").unionByName(after), "waits")  # of settled ones too: a wait may be handed on to them
        drop(now)
        now = then
    every = now.withColumn("cyclic", F.col("cyclic") | ~F.col("done"))
    anchor, depth = (F.when(F.col("cyclic"), own).otherwise(F.col(f"best.{c}")) for c, own in (("anchor", F.col("turn")), ("depth", F.lit(0))))
    out = cut(every.select("conv_id", "turn", anchor.cast("long").alias("anchor"), depth.cast("int").alias("depth"), "cyclic"), "moved")
    drop(now)
    return out


def _with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """``position`` from 1 within conv_id: ranges of the sorted rows are counted, and each
    range's rows are numbered from where the ranges before it end."""
    dealt = cut(df.repartitionByRange("conv_id", *order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("conv_id", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("__part")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("conv_id", "__part").orderBy(*order))
    out = dealt.withColumn("__within", within).join(counts.select("conv_id", "__part", before.alias("__before")), ["conv_id", "__part"])
    return out.withColumn("position", F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")


def format_chat(df: DataFrame, schemas: dict[str, list[tuple[str, str, bool]]] | None = None) -> DataFrame:
    """conv_id, turn, role, position, anchor_turn, depth, n_calls, n_valid, linked (a result
    whose call is there), cyclic and message (canonical JSON) for every row of conv_id, turn,
    role, text."""
    read = cut(_read(df, SCHEMAS if schemas is None else schemas), "messages")
    of = read.where("calls is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("calls").alias("number", "call"))
    first = of.where("call.id is not null").groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(F.struct("turn", "number")).alias("at"))
    first = cut(first, "calls")
    moved = _places(of.select("conv_id", "turn", F.col("call.waits").alias("waits")), first)
    # where the call of each result, or the message itself, stands
    results = read.where("tool_call_id is not null and turn is not null").join(first.withColumnRenamed("id", "tool_call_id"), ["conv_id", "tool_call_id"], "left")
    others = read.where("tool_call_id is null or turn is null").withColumn("at", F.lit(None).cast(first.schema["at"].dataType))
    both = others.unionByName(results).withColumn("__of", F.coalesce(F.col("at.turn"), F.when(F.col("calls").isNotNull(), F.col("turn"))))
    of_place = moved.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), "anchor", "depth", "cyclic")
    both = both.join(of_place, (F.col("conv_id") == F.col("__conv")) & (F.col("__of") == F.col("__turn")), "left")
    linked = F.col("at").isNotNull()
    rows = both.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("anchor", "__of", "turn").alias("anchor_turn"),
        (F.coalesce("depth", F.lit(0)) + F.when(linked, 1).otherwise(0)).alias("depth"),
        F.coalesce(F.col("at.number") + 1, F.lit(0)).alias("__number"),
        F.col("tool_call_id").isNotNull().alias("__answers"),
        F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"),
        F.coalesce(F.size(F.filter("calls", lambda c: c["valid"])), F.lit(0)).alias("n_valid"),
        linked.alias("linked"),
        (F.coalesce("cyclic", F.lit(False)) & ~linked).alias("cyclic"),
        "message",
    )
    rows = rows.withColumns({c: F.greatest(c, F.lit(0)) for c in ("n_calls", "n_valid")}).withColumn("__mark", F.xxhash64("message"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = _with_position(rows.where(whole), ["anchor_turn", "depth", "__number", "__answers", "turn", "__mark"])
    out = placed.unionByName(rows.where(~whole).withColumn("position", F.lit(None).cast("long")))
    return out.select("conv_id", "turn", "role", "position", "anchor_turn", "depth", "n_calls", "n_valid", "linked", "cyclic", "message")
