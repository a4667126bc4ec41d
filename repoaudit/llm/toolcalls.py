"""Tool calls in conversations: linked to their results, ordered, validated, and serialised.

Calls and results meet by hash join on conversation and identifier. A call may name calls it
depends on; Kahn's rounds give each call its level, the length of the longest chain of calls
before it, so that sorting by level, turn and identifier is a topological order. Arguments are
JSON objects, checked against the schema of their tool, and written as canonical JSON: keys in
code point order, no white space, whole numbers without fraction.

Cases. Of several calls with one identifier in one conversation the earliest counts, the others
are ``duplicate``, rows of their own where asked for; so are results. A call without result is ``unanswered``, a result without call
``orphan``. A call that depends on an identifier that is not there ignores it. Calls on a cycle,
or after one, have no level and sort last, as ``cyclic``. Arguments that are null, empty or no
JSON object are invalid; so are NaN, infinities and lone surrogates. Null identifiers never match: calls and
results without one, or without a conversation, stay rows of their own, unanswered or orphan. An empty table
gives an empty one; columns other than those named are not looked at.

Every step is an aggregate or a join on (conversation, identifier), so a conversation of any
length is spread over tasks by its identifiers.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from repoaudit.session import freeze

#: Schemas as JSON texts would state them: a name, the type of each property, those required,
#: and whether others are allowed.
SCHEMAS = {
    "lookup": {"properties": {"query": "string", "limit": "integer"}, "required": ["query"], "more": False},
    "count": {"properties": {"text": "string", "unit": "string"}, "required": ["text", "unit"], "more": False},
    "note": {"properties": {"text": "string", "tags": "array", "score": "number"}, "required": ["text"], "more": True},
}
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def _plain(value):
    """The value with whole floats as integers; raises on what JSON cannot hold."""
    stack, top = [], [value]
    stack.append(top)
    while stack:
        box = stack.pop()
        for key in range(len(box)) if isinstance(box, list) else list(box):
            item = box[key]
            if isinstance(item, float):
                if not math.isfinite(item):
                    raise ValueError("not a JSON number")
                if item.is_integer() and abs(item) < 2**53:
                    box[key] = int(item)
            elif isinstance(item, (list, dict)):
                stack.append(item)
    return top[0]


def canonical(text: str | None) -> str | None:
    """Canonical JSON of a JSON text, or null if it is none."""
    try:
        value = _plain(json.loads(text))
        written = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        written.encode()  # a lone surrogate is no text, and raises
        return written
    except (TypeError, ValueError, RecursionError):
        return None


def problems(tool: str | None, arguments: str | None, schemas: dict) -> list[str]:
    """What is wrong with a call's arguments, in order; empty if nothing is."""
    schema = schemas.get(tool)
    if schema is None:
        return ["unknown tool"]
    plain = canonical(arguments)
    value = json.loads(plain) if plain is not None else None
    if not isinstance(value, dict):
        return ["arguments are no object"]
    found = [f"missing {name}" for name in sorted(schema["required"]) if name not in value]
    for name in sorted(value):
        kind = schema["properties"].get(name)
        if kind is None:
            found += [] if schema["more"] else [f"unexpected {name}"]
        elif not _TYPES[kind](value[name]):
            found.append(f"{name} is no {kind}")
    return found


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of calls ``(conv_id, call_id, depends_on)``; no row for those
    on a cycle or after one. Each round settles the calls whose dependencies are settled; it
    joins waiting edges with what the round before settled, so an edge is used once."""
    nodes = calls.select("conv_id", "call_id")
    edges = (
        calls.select("conv_id", "call_id", F.explode("depends_on").alias("_on"))
        .distinct()
        .join(nodes.withColumnRenamed("call_id", "_on"), ["conv_id", "_on"], "left_semi")
    )
    # Per waiting call: how many edges are left, and the highest level seen.
    edges = freeze(edges)
    left = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("_left"))
    state = freeze(
        nodes.join(left, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", F.coalesce("_left", F.lit(0)).alias("_left"), F.lit(0).alias("level")
        )
    )
    settled = []
    while True:
        ready = state.where("_left = 0").select("conv_id", "call_id", "level")
        if ready.isEmpty():
            break
        settled.append(ready)
        freed = (
            edges.join(ready.withColumnRenamed("call_id", "_on"), ["conv_id", "_on"])
            .groupBy("conv_id", "call_id")
            .agg(F.count("*").alias("_done"), (F.max("level") + 1).alias("_level"))
        )
        state = freeze(
            state.where("_left > 0")
            .join(freed, ["conv_id", "call_id"], "left")
            .select(
                "conv_id",
                "call_id",
                (F.col("_left") - F.coalesce("_done", F.lit(0))).alias("_left"),
                F.greatest("level", F.coalesce("_level", F.lit(0))).alias("level"),
            )
        )
    if not settled:
        return state.select("conv_id", "call_id", "level").limit(0)
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    return whole


#: Repeated identifiers that are broadcast, at most.
FEW = 1000
_KEYS = ["conv_id", "call_id"]
_NAMED = "conv_id IS NOT NULL AND call_id IS NOT NULL"
_COLUMNS = {
    "call_turn": None, "result_turn": None, "tool": "string", "arguments": "string", "content": "string",
    "level": "int", "status": "string", "repeated_calls": "bigint", "repeated_results": "bigint", "called": "boolean",
}


def _others(rows: DataFrame, first: DataFrame, number: str, counted: list) -> DataFrame | None:
    """The rows of identifiers that ``first`` has ``number`` > 1 of, but for the one that
    counts: one of those equal to ``counted``. None if no identifier is repeated."""
    names = [c for c in rows.columns if c not in _KEYS]
    often = first.where(F.col(number) > 1).select(*_KEYS, F.struct(*[c.alias(n) for c, n in zip(counted, names)]).alias("_first"))
    many = often.limit(FEW + 1).count()
    if not many:
        return None
    found = rows.join(F.broadcast(often) if many <= FEW else often, _KEYS)
    same = F.struct(*names).eqNullSafe(F.col("_first")).alias("_same")
    found = freeze(found.select(*rows.columns, same, F.monotonically_increasing_id().alias("_row")))
    counts = found.where("_same").groupBy(*_KEYS).agg(F.min("_row").alias("_row")).select("_row")
    return found.join(F.broadcast(counts) if many <= FEW else counts, "_row", "left_anti").select(*rows.columns)


def _alone(calls: DataFrame, first: DataFrame, order: DataFrame) -> DataFrame | None:
    """Calls without identifier or conversation with their level and whether it is known."""
    loose = calls.where(f"NOT ({_NAMED})")
    if loose.isEmpty():
        return None
    loose = freeze(loose.withColumn("_row", F.monotonically_increasing_id()))
    on = loose.select("_row", "conv_id", F.explode("depends_on").alias("call_id")).join(first.select(*_KEYS), _KEYS)
    above = on.join(order, _KEYS, "left").groupBy("_row").agg(
        (F.max("level") + 1).alias("_level"), F.max(F.col("level").isNull()).alias("_cyclic")
    )
    level = F.when(~F.coalesce("_cyclic", F.lit(False)), F.coalesce("_level", F.lit(0)))
    return loose.join(above, "_row", "left").withColumn("level", level)


def link_calls(
    calls: DataFrame, results: DataFrame, schemas: dict | None = None, repeated: bool = False
) -> DataFrame:
    """Calls ``(conv_id, turn, call_id, tool, arguments, depends_on)`` with results
    ``(conv_id, turn, call_id, content)``.

    One row per identifier, and per call or result without one; with ``repeated`` also one per
    further call or result of an identifier, with status ``duplicate``: ``conv_id, call_id, call_turn,
    result_turn, tool, status, level, valid, problems, message``. ``message`` is the exchange as
    canonical JSON.
    """
    schemas = SCHEMAS if schemas is None else schemas
    keys = _KEYS
    calls = calls.select(*keys, "turn", "tool", "arguments", "depends_on")
    results = results.select(*keys, "turn", "content")
    body = F.struct("turn", "tool", "arguments", "depends_on")
    first = calls.where(_NAMED).groupBy(*keys).agg(F.min(F.struct("turn", "tool", "arguments")).alias("_c"), F.count("*").alias("_calls"), F.min_by("depends_on", body).alias("depends_on"))
    first = freeze(first)
    answers = results.where(_NAMED).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("_r"), F.count("*").alias("_results"))
    joined = first.join(answers, keys, "full")
    order = levels(first.select(*keys, F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    rows = joined.join(order, keys, "left").select(
        *keys,
        F.col("_c.turn").alias("call_turn"),
        F.col("_r.turn").alias("result_turn"),
        F.col("_c.tool").alias("tool"),
        F.col("_c.arguments").alias("arguments"),
        F.col("_r.content").alias("content"),
        "level",
        F.when(F.col("_c").isNull(), "orphan")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("_r").isNull(), "unanswered")
        .otherwise("answered")
        .alias("status"),
        (F.coalesce("_calls", F.lit(1)) - 1).alias("repeated_calls"),
        F.greatest(F.coalesce("_results", F.lit(1)) - 1, F.lit(0)).alias("repeated_results"),
        F.col("_c").isNotNull().alias("called"),
    )
    turn = calls.schema["turn"].dataType.simpleString()

    def filled(more, **own):
        own = {"repeated_calls": F.lit(0), "repeated_results": F.lit(0)} | own
        return more.select(*keys, *[own.get(c, F.lit(None)).cast(t or turn).alias(c) for c, t in _COLUMNS.items()])

    def of_calls(more, status, level):
        return filled(more, call_turn=F.col("turn"), tool=F.col("tool"), arguments=F.col("arguments"), level=level, status=status, called=F.lit(True))

    def of_results(more, status):
        return filled(more, result_turn=F.col("turn"), content=F.col("content"), status=F.lit(status), called=F.lit(False))

    alone = _alone(calls, first, order)
    if alone is not None:
        status = F.when(F.col("level").isNull(), "cyclic").otherwise("unanswered")
        rows = rows.unionByName(of_calls(alone, status, F.col("level")))
    rows = rows.unionByName(of_results(results.where(f"NOT ({_NAMED})"), "orphan"))
    if repeated:
        counted = [F.col(f"_c.{c}") for c in ("turn", "tool", "arguments")] + [F.col("depends_on")]
        more = _others(calls, first, "_calls", counted)
        if more is not None:
            rows = rows.unionByName(of_calls(more, F.lit("duplicate"), F.lit(None)))
        more = _others(results, answers, "_results", [F.col("_r.turn"), F.col("_r.content")])
        if more is not None:
            rows = rows.unionByName(of_results(more, "duplicate"))

    def written(batches):
        for batch in batches:
            table = batch.to_pydict()
            found = [
                problems(tool, arguments, schemas) if called else []
                for called, tool, arguments in zip(table["called"], table["tool"], table["arguments"])
            ]
            messages = []
            for i, status in enumerate(table["status"]):
                plain = canonical(table["arguments"][i])
                exchange = {
                    "arguments": json.loads(plain) if plain is not None else table["arguments"][i],
                    "id": table["call_id"][i],
                    "name": table["tool"][i],
                    "result": table["content"][i],
                    "status": status,
                }
                messages.append(json.dumps(exchange, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            keep = ["conv_id", "call_id", "call_turn", "result_turn", "tool", "status", "level", "repeated_calls", "repeated_results"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep]
                + [pa.array([not p for p in found]), pa.array(["; ".join(p) for p in found], pa.string()), pa.array(messages, pa.string())],
                [*keep, "valid", "problems", "message"],
            )

    kind = calls.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, call_id string, call_turn {turn}, result_turn {turn}, tool string, status string,"
        " level int, repeated_calls bigint, repeated_results bigint, valid boolean, problems string, message string"
    )
    return rows.mapInArrow(written, schema)


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of ``conversations`` stand for.

    The table holds plain talk, so each assistant turn is read as a call: the tool goes by the
    turn, the arguments hold the turn's whole text, and the call depends on those of the two
    assistant turns before. The user turn after it is its result. Rows that repeat a turn give
    repeated calls and results, which linking must resolve. The first user turn and turns of other
    roles, or of none, are talk around the calls: they are neither and give no row.
    """
    turn = F.col("turn")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    text = F.coalesce("text", F.lit(""))
    arguments = (
        F.when(turn % 6 == 1, F.to_json(F.struct(text.alias("query"), F.length(text).alias("limit"))))
        .when(turn % 6 == 3, F.to_json(F.struct(F.lit("words").alias("unit"), text.alias("text"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), F.array("role").alias("tags"), (F.length(text) / 2).alias("score"))))
    )
    tool = F.when(turn % 6 == 1, "lookup").when(turn % 6 == 3, "count").otherwise("note")
    before = F.filter(F.array(turn - 2, turn - 4), lambda t: t > 0)
    calls = conversations.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        name(turn).alias("call_id"),
        tool.alias("tool"),
        arguments.alias("arguments"),
        F.transform(before, name).alias("depends_on"),
    )
    results = conversations.where("role = 'user' AND turn > 0").select(
        "conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def toolcalls_digest(conversations: DataFrame, repeated: bool = False) -> DataFrame:
    """All exchanges of ``conversations``."""
    return link_calls(*calls_of(conversations), repeated=repeated)


def ordered(spark: SparkSession, linked: DataFrame) -> DataFrame:
    """Linked calls in topological order within each conversation."""
    return linked.orderBy("conv_id", F.col("level").asc_nulls_last(), "call_turn", "call_id")
