"""Chat formatting: tool calls and their results, in DataFrame functions only.

Calls and results are joined by hash on their identifier. Calls that refer to earlier results are put in
topological order: a call's level is one more than the deepest call it waits for; chains of calls are
followed by doubling, so a conversation of n turns takes about log2(n) passes. Arguments are checked
against the schema of the tool, and each call becomes one line of canonical JSON: keys sorted at every level, no spare
white space, null members left out; an argument whose schema's type isn't string is JSON itself and stands as that (numbers, booleans,
arrays and objects bare), any other as a string. Conversations are never gathered in a task: links, levels and checks
are equi-joins on identifiers, so a conversation of any length is spread over tasks.

Defined results: calls and results without an identifier are dropped; of rows that repeat an identifier
the least by value counts; a result without a call gives no row; a call without a result is "unresolved";
references to unknown calls are ignored; calls that wait for themselves (a cycle) get level -1 and status
"cyclic"; null arguments are an empty object and fail a schema's required keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, table

#: For each tool: the arguments it must have, and for each argument its longest length in characters, the values allowed
#: (none: any) and its type (none: string); whether others than the arguments named in any of these are an error.
SCHEMAS = {
    "instruct": {"required": ["prompt"], "max_chars": {"prompt": 2000}, "one_of": {}, "types": {"prompt": "string", "role": "string"}, "closed": True},
    "reply": {"required": ["prompt"], "max_chars": {"prompt": 400}, "one_of": {"role": ["user"]}, "types": {"prompt": "string", "role": "string"}, "closed": True},
}


def of_type(value: Column, kind: str | dict) -> Column:
    """Whether an argument, given as text, is of a type: string, integer, number, boolean, array, object, or an object with a type for each member that it must have."""
    if isinstance(kind, dict):
        holds = of_type(value, "object")
        for member, inner in sorted(kind.items()):
            got = F.get_json_object(value, f"$['{member}']")
            holds = holds & got.isNotNull() & of_type(got, inner)
        return holds
    whole = F.get_json_object(value, "$")
    told = {
        "string": F.lit(True),
        "integer": value.rlike(r"^-?(?:0|[1-9][0-9]*)$"),
        "number": value.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"),
        "boolean": value.isin("true", "false"),
        "array": whole.isNotNull() & F.ltrim(value).startswith("["),
        "object": whole.isNotNull() & F.ltrim(value).startswith("{"),
    }
    return told[kind]


def valid(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether a map of arguments satisfies the schema of the tool; false for unknown tools. A null argument counts as missing."""
    out = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        value = lambda key: F.element_at(arguments, F.lit(key))
        holds = F.lit(True)
        for key in schema["required"]:
            holds = holds & F.coalesce(value(key) != "", F.lit(False))
        for key, most in sorted(schema["max_chars"].items()):
            holds = holds & F.coalesce(F.char_length(value(key)) <= most, F.lit(True))
        for key, allowed in sorted(schema["one_of"].items()):
            holds = holds & F.coalesce(value(key).isin(allowed), F.lit(True))
        for key, kind in sorted(schema.get("types", {}).items()):
            holds = holds & (value(key).isNull() | F.coalesce(of_type(value(key), kind), F.lit(False)))
        if schema.get("closed"):
            named = sorted({*schema["required"], *schema["max_chars"], *schema["one_of"], *schema.get("types", {})})
            holds = holds & F.coalesce(F.size(F.array_except(F.map_keys(arguments), F.array(*map(F.lit, named)))) == 0, F.lit(True))
        out = F.when(name == tool, holds).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _quoted(value: Column) -> Column:
    """A string as JSON writes it."""
    made = F.to_json(F.struct(value.alias("x")))
    return F.substr(made, F.lit(6), F.char_length(made) - 6)


def json_text(value: Column) -> Column:
    """Canonical text of JSON: null where it isn't JSON. A variant holds objects with sorted keys and numbers as numbers, and is written without white space."""
    return F.to_json(F.try_parse_json(value))


def canonical(name: Column, arguments: Column, schemas: dict) -> Column:
    """The object of arguments (sorted entries of key, value): those whose type in the tool's schema isn't string as JSON, where they are JSON."""
    bare = F.lit(False)
    key = lambda x: x["key"]
    entries = F.filter(arguments, lambda x: x["value"].isNotNull())
    typed = {tool: sorted(k for k, kind in schema.get("types", {}).items() if kind != "string") for tool, schema in sorted(schemas.items())}

    def member(x: Column) -> Column:
        told = bare
        for tool, keys in typed.items():
            told = told | ((name == tool) & key(x).isin(keys)) if keys else told
        return F.concat(_quoted(key(x)), F.lit(":"), F.when(told, F.coalesce(json_text(x["value"]), _quoted(x["value"]))).otherwise(_quoted(x["value"])))

    return F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(entries, member), ","), F.lit("")), F.lit("}"))


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level for each row (call_id, waits_for: array of call ids); -1 on cycles and for what waits for one.

    A call that waits for one other points at it; pointers double until they end at a call that waits for none
    or for several, so a chain takes as many passes as the logarithm of its length. Calls that wait for several
    then follow in Kahn's order, a level of them a pass.
    """
    nodes = calls.select("call_id")
    edges = calls.select("call_id", F.explode(F.array_distinct("waits_for")).alias("first")).filter(F.col("first").isNotNull())
    edges = materialise(edges.join(nodes.select(F.col("call_id").alias("first")), "first", "left_semi").select("call_id", "first"))
    waits = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    waits = materialise(nodes.join(waits, "call_id", "left").select("call_id", F.coalesce("n", F.lit(0)).alias("n"), "first"))
    ends = waits.filter("n <> 1").select(F.col("call_id").alias("first"), F.lit(True).alias("ended"))
    chain = waits.filter("n = 1").join(ends, "first", "left")
    chain = materialise(chain.select("call_id", F.col("first").alias("to"), F.lit(1).cast("long").alias("steps"), F.coalesce("ended", F.lit(False)).alias("ended")))
    left = chain.filter("not ended").count()
    while left:
        further = chain.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("ends"))
        moved = chain.filter("not ended").join(further, "to").select("call_id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("ended"))
        chain = materialise(chain.filter("ended").unionByName(moved))
        before, left = left, chain.filter("not ended").count()
        if left == before:  # none of them leads to an end: all lead into cycles
            break
    done = waits.filter("n = 0").select("call_id", F.lit(0).cast("long").alias("level"))
    several = waits.filter("n > 1").select("call_id")
    if not several.isEmpty():
        done = _after_several(edges.join(several, "call_id", "left_semi"), chain, done)
    behind = chain.filter("ended").join(done.select(F.col("call_id").alias("to"), "level"), "to").select("call_id", (F.col("level") + F.col("steps")).alias("level"))
    return nodes.join(done.unionByName(behind), "call_id", "left").select("call_id", F.coalesce("level", F.lit(-1)).alias("level"))


def _after_several(edges: DataFrame, chain: DataFrame, done: DataFrame) -> DataFrame:
    """done (call_id, level) with the calls of edges (all that each waits for) added, a level a pass; chains on the way are stepped over at once."""
    ended = chain.filter("ended").select(F.col("call_id").alias("first"), "to", "steps")
    edges = edges.join(ended, "first", "left").select("call_id", F.coalesce("to", "first").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    edges, last, passes = materialise(edges), done, 0
    while True:
        near = edges.join(last.select(F.col("call_id").alias("to")), "to", "left_semi").select("call_id").distinct()
        known = edges.join(near, "call_id", "left_semi").join(done.select(F.col("call_id").alias("to"), "level"), "to", "left")
        ready = known.groupBy("call_id").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        last = materialise(ready.filter("open = 0").select("call_id", "level"))
        if last.isEmpty():
            return done
        passes += 1
        done = done.unionByName(last)
        if passes % 8 == 0:  # keeps the plan short
            done = materialise(done)


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls: call_id, name, arguments (map<string,string>), waits_for (array<string>); results: call_id, content.

    A row for each call: call_id, name, level, status (ok, invalid, unresolved, cyclic), line (canonical JSON).
    """
    one = lambda *c: F.min(F.struct(*c)).alias("x")
    entries = F.array_sort(F.map_entries("arguments"))
    calls = calls.filter(F.col("call_id").isNotNull()).select("call_id", "name", entries.alias("arguments"), F.coalesce("waits_for", F.array().cast("array<string>")).alias("waits_for"))
    calls = materialise(calls.groupBy("call_id").agg(one("name", "arguments", "waits_for")).select("call_id", "x.*"))
    results = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("found"))
    joined = calls.join(results, "call_id", "left").join(levels(calls), "call_id", "left")
    arguments = F.map_from_entries("arguments")
    right = valid(F.col("name"), arguments, schemas)
    status = F.when(F.col("level") < 0, "cyclic").when(F.col("found").isNull(), "unresolved").when(~right, "invalid").otherwise("ok")
    line = F.concat(F.lit('{"arguments":'), canonical(F.col("name"), F.col("arguments"), schemas), F.lit(","), F.substr(F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result"))), F.lit(2)))
    return joined.select("call_id", "name", "level", status.alias("status"), line.alias("line"))


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain turns: a user's or system's turn calls for the next one; an assistant's turn answers the turn before it.

    A call waits for the turn before it if that calls too, else for the one two before it if that does (which the former waits for itself).
    """
    said = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    role = lower_ascii(F.col("role"))
    name_of = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asked = said.filter(role.isin("user", "system"))
    name = F.when(role == "system", "instruct").otherwise("reply")
    # repeated turns meet before anything is joined to them
    calls = asked.groupBy(name_of(F.col("turn")).alias("call_id")).agg(F.min(F.struct(name.alias("name"), F.col("text").alias("prompt"), role.alias("role"))).alias("x"))
    turns = asked.select("conv_id", "turn").distinct()
    turns = turns.select(name_of(F.col("turn")).alias("call_id"), name_of(F.col("turn") - 1).alias("one"), name_of(F.col("turn") - 2).alias("two"))
    waits = turns.join(turns.select(F.col("call_id").alias("one"), F.lit(True).alias("calls")), "one", "left")
    waits = waits.select("call_id", F.array(F.when(F.col("calls"), F.col("one")).otherwise(F.col("two"))).alias("waits_for"))
    arguments = F.map_from_arrays(F.array(F.lit("prompt"), F.lit("role")), F.array(F.col("x.prompt"), F.col("x.role")))
    calls = calls.join(waits, "call_id").select("call_id", "x.name", arguments.alias("arguments"), "waits_for")
    answers = said.filter(role == "assistant").select(name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, answers


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_turns(table(spark, sf_dir, "conversations"))
    linked = link(calls, results, SCHEMAS)
    return linked.select("call_id", "name", F.col("level").cast("long").alias("level"), "status", F.md5("line").alias("line_md5"), F.char_length("line").cast("long").alias("n_chars"))


# level: turns of a conversation form chains of steps of one or two; the recursion follows them
ORACLE_SQL = """
with recursive said as (select conv_id, turn, translate(role, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as role, text from conversations where conv_id is not null and turn is not null),
asked as (select conv_id, turn, min_by(role, role) as role, min(text) as text from said where role in ('user', 'system') group by conv_id, turn),
answers as (select conv_id, turn - 1 as turn, min(text) as content from said where role = 'assistant' group by all),
steps as (select a.conv_id, a.turn, b.turn as first from asked a join asked b on a.conv_id = b.conv_id and b.turn in (a.turn - 1, a.turn - 2)),
deep as (select conv_id, turn, 0 as level from asked union select s.conv_id, s.turn, d.level + 1 from steps s join deep d on s.conv_id = d.conv_id and s.first = d.turn),
levels as (select conv_id, turn, max(level) as level from deep group by all),
j as (select concat(a.conv_id, ':', a.turn) as call_id, case role when 'system' then 'instruct' else 'reply' end as name, a.*, n.content, n.turn is not null as found, l.level
  from asked a left join answers n using (conv_id, turn) join levels l using (conv_id, turn)),
k as (select *, coalesce(text <> '', false) and length(text) <= case name when 'instruct' then 2000 else 400 end as good,
  '{"arguments":{' || case when text is null then '' else '"prompt":' || to_json(text) || ',' end || '"role":"' || role || '"},"id":"' || call_id || '","name":"' || name || '"' || case when content is null then '' else ',"result":' || to_json(content) end || '}' as line from j)
select call_id, name, cast(level as bigint) as level, case when not found then 'unresolved' when not good then 'invalid' else 'ok' end as status, md5(line) as line_md5, length(line) as n_chars from k"""
