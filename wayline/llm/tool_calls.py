"""Link tool calls to their results and serialise them as canonical JSON.

Calls and results are hash-joined by identifier, calls are ordered topologically
by what they wait for, arguments are checked against the tools' schemas, and each
call becomes one JSON line with sorted keys. Native column code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.spread import spread_join
from wayline.workspace import new_path, written

C = F.col
KEY = ["conv_id", "call_id"]
#: parameter types by the type names of parsed JSON values
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


#: turns of a conversation that are folded at once, and calls in one block at most (about; more are dealt by identifier)
TURNS, BLOCK = 256, 512
_REFS = "map<string,int>"


def _merged(left: Column, right: Column) -> Column:
    return F.map_zip_with(left, right, lambda k, a, b: F.greatest(a, b))


def _fold(entries: Column) -> Column:
    """Map of call id to (turn, base, refs): each call's longest ways to calls outside the block, or behind it in the fold's order.

    A call's level is the largest of its base and, over its refs, the other
    call's level plus the way. Calls before it in the block are replaced by theirs.
    """
    value = f"struct<turn: long, base: int, refs: {_REFS}>"

    def call(done: Column, e: Column) -> Column:
        def ref(s: Column, r: Column) -> Column:
            other = F.try_element_at(done, r["key"])
            known = F.struct(F.greatest(s["base"], other["base"] + r["value"]).alias("base"), _merged(s["refs"], F.transform_values(other["refs"], lambda k, w: w + r["value"])).alias("refs"))
            return F.when(other.isNotNull(), known).otherwise(F.struct(s["base"].alias("base"), _merged(s["refs"], F.map_from_arrays(F.array(r["key"]), F.array(r["value"]))).alias("refs")))

        start = F.struct(e["base"].alias("base"), F.create_map().cast(_REFS).alias("refs")).cast(f"struct<base: int, refs: {_REFS}>")
        at = F.aggregate(e["refs"], start, lambda s, r: ref(s, r).cast(f"struct<base: int, refs: {_REFS}>"))
        return F.map_from_arrays(F.array(e["call_id"]), F.array(F.struct(e["turn"].alias("turn"), at["base"].alias("base"), at["refs"].alias("refs")).cast(value)))

    return F.aggregate(entries, F.create_map().cast(f"map<string,{value}>"), lambda done, e: F.map_concat(done, call(done, e)))


def _folded(graph: DataFrame, turns: int, descending: bool) -> DataFrame:
    """Every call of a graph (conv_id, call_id, turn, base, refs) with its calls inside the same block replaced by theirs."""
    span = F.expr(f"turn div {turns}")
    sizes = graph.groupBy("conv_id", span.alias("span")).agg(F.ceil(F.count("*") / BLOCK).alias("subs"))
    dealt = spread_join(graph.withColumn("span", span), sizes, ["conv_id", "span"], "inner", C("call_id")).withColumn("sub", F.pmod(F.xxhash64("call_id"), C("subs")))
    blocks = dealt.groupBy("conv_id", "span", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "call_id", "base", F.map_entries("refs").alias("refs"))), not descending).alias("entries"))
    return blocks.select("conv_id", F.explode(F.map_entries(_fold(C("entries")))).alias("e")).select("conv_id", C("e.key").alias("call_id"), "e.value.*")


def _settled(graph: DataFrame, known: DataFrame) -> DataFrame:
    """The graph with calls of known level (conv_id, call_id, level) taken out of refs and into base."""
    ways = graph.select("conv_id", "call_id", F.explode("refs").alias("after", "way"))
    found = ways.join(known.select("conv_id", C("call_id").alias("after"), "level"), ["conv_id", "after"]).groupBy(*KEY).agg(
        F.max(C("level") + C("way")).alias("high"), F.collect_set("after").alias("gone"))
    rest = F.map_filter("refs", lambda k, w: ~F.array_contains("gone", k))
    return graph.join(found, KEY, "left").select(*KEY, "turn", F.greatest("base", "high").alias("base"), F.when(C("gone").isNull(), C("refs")).otherwise(rest).alias("refs"))


def _rounds(graph: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of a graph, one level after the other; calls on or behind a cycle get no row.

    Each round reads the newest level and the calls still open, both stored, and
    appends to one folder: the plan does not grow.
    """
    spark = graph.sparkSession
    path = new_path(spark, "level")
    newest, open_ = graph.where("size(refs) = 0").select(*KEY, C("base").alias("level")), graph.where("size(refs) > 0")
    while True:
        newest = written(newest, "newest")
        newest.write.mode("append").parquet(path)
        if newest.isEmpty():
            return spark.read.schema(newest.schema).parquet(path)
        open_ = written(_settled(open_, newest), "open")
        newest, open_ = open_.where("size(refs) = 0").select(*KEY, C("base").alias("level")), open_.where("size(refs) > 0")


def levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the latest call waited for.

    calls: conv_id, call_id, turn, distinct. waits: (conv_id, call_id, after)
    between existing calls. Calls on or behind a cycle get no row.

    Long chains are contracted: calls of one block of turns are folded in their
    order, so that they refer to calls of other blocks only; then the few calls
    that others refer to are folded in blocks of 64 times the turns, and so on.
    Once that no longer shrinks the graph (calls that wait against the order of
    turns, cycles, references all over a conversation), the rest is settled level
    by level; then all levels follow from theirs.
    """
    refs = waits.groupBy(*KEY).agg(F.map_from_entries(F.collect_set(F.struct("after", F.lit(1)))).alias("refs"))
    empty = F.create_map().cast(_REFS)
    graph = written(calls.join(refs, KEY, "left").select(*KEY, F.coalesce(C("turn").cast("long"), F.lit(0)).alias("turn"), F.lit(0).alias("base"), F.coalesce("refs", empty).alias("refs")), "graph")
    stack, turns, size, stuck, descending = [], TURNS, None, 0, False
    while stuck < 2:
        folded = written(_folded(graph, turns, descending), "folded")
        ways = folded.select("conv_id", F.explode(F.map_keys("refs")).alias("call_id")).distinct()
        stack.append(folded)
        graph = written(folded.join(ways, KEY, "left_semi"), "referred")
        n, open_ = graph.agg(F.count("*"), F.count_if(F.size("refs") > 0)).first()
        if not open_:
            break
        stuck = stuck + 1 if size is not None and open_ > size / 2 else 0
        size, turns, descending = open_, turns * (64 if not stuck else 1), not descending if stuck else descending
    known = _rounds(graph)
    for folded in reversed(stack):
        known = written(_settled(folded, known).where("size(refs) = 0").select(*KEY, C("base").alias("level")), "level")
    return known


def _checks(args: Column, specs: Column) -> Column:
    """Errors of parsed arguments (map of name to variant) against a tool's parameter list."""
    kinds = F.map_from_entries(F.transform(F.map_entries(args), lambda e: F.struct(e["key"], F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0).alias("kind"))))
    types = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def of(s: Column) -> Column:
        kind = F.element_at(kinds, s["name"])
        size = F.length(F.element_at(args, s["name"]).cast("string"))
        absent = kind.isNull() | (kind == "VOID")
        return (
            F.when(absent & s["required"], F.concat(F.lit("missing "), s["name"]))
            .when(absent, F.lit(None))
            .when(~F.array_contains(F.element_at(types, s["type"]), kind), F.concat(F.lit("type of "), s["name"]))
            .when((s["type"] == "string") & (size < s["min_length"]), F.concat(F.lit("too short "), s["name"]))
            .when((s["type"] == "string") & (size > s["max_length"]), F.concat(F.lit("too long "), s["name"]))
        )

    names = F.transform(specs, lambda s: s["name"])
    unknown = F.transform(F.array_except(F.map_keys(args), names), lambda k: F.concat(F.lit("unknown "), k))
    return F.concat(F.filter(F.transform(specs, of), lambda e: e.isNotNull()), F.array_sort(unknown))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without a call.

    calls: conv_id, call_id, turn, tool, arguments (JSON text), after (array of
    call ids). results: conv_id, call_id, turn, content. schemas: tool, name,
    type, required, min_length, max_length, one row per parameter, a bounded
    table.

    Output: conv_id, call_id, turn, tool, level, linked, n_results, errors
    (array), json. A call is linked to its result with the smallest (turn,
    content). Of calls that repeat an identifier in a conversation the smallest
    (turn, tool, arguments) is meant; the others carry the error 'repeated
    identifier' and no level. Null identifiers link with nothing. Arguments that
    do not parse, also for a key given twice, are 'malformed arguments'. JSON
    keys are sorted at every depth, absent values are null. Order the lines of a
    conversation by level, then turn. Other columns are ignored.
    """
    calls = calls.select(*KEY, "turn", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    first = calls.where(C("call_id").isNotNull() & C("conv_id").isNotNull()).groupBy(*KEY).agg(F.min(F.struct("turn", "tool", "arguments", "after")).alias("c"), F.count("*").alias("copies"))
    unique = written(first.select(*KEY, "c.*", "copies"), "calls")
    ids = unique.select(*KEY)
    # each step is written: the plans stay small, and so does the driver
    existing = ids.select("conv_id", C("call_id").alias("after"), F.lit(True).alias("known"))
    asked = written(unique.select(*KEY, F.explode(F.array_distinct("after")).alias("after")).join(existing, ["conv_id", "after"], "left"), "asked")
    waits = asked.where("known").select(*KEY, "after")
    lost = asked.where("known IS NULL").select(*KEY).distinct().withColumn("lost", F.lit(True))
    got = results.where(C("call_id").isNotNull() & C("conv_id").isNotNull()).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    specs = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("name", "type", "required", "min_length", "max_length"))).alias("specs"))
    joined = written(unique.join(levels(unique.select(*KEY, "turn"), waits), KEY, "left").join(got, KEY, "left").join(lost, KEY, "left"), "joined")
    joined = spread_join(joined, specs, ["tool"], "left", F.struct(*KEY))
    args = F.expr("cast(try_parse_json(arguments) as map<string, variant>)")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    note = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(
        F.when(C("specs").isNull(), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("malformed arguments"))).otherwise(_checks(args, C("specs"))),
        note(C("n_results").isNull(), "no result"), note(C("lost"), "waits for unknown call"), note(C("level").isNull(), "cyclic order"))
    line = F.to_json(F.struct(
        F.when(is_object, F.try_parse_json("arguments")).alias("arguments"), "call_id", C("r.content").alias("result"), "tool"), {"ignoreNullFields": "false"})
    linked = joined.select(*KEY, "turn", "tool", "level", C("n_results").isNotNull().alias("linked"), F.coalesce("n_results", F.lit(0)).alias("n_results"), errors.alias("errors"), line.alias("json"))
    same = F.struct("turn", "tool", "arguments", "after")
    chosen = unique.select(*KEY, same.alias("c"))
    # further rows of an identifier, and calls without one
    extra = calls.join(unique.where("copies > 1").select(*KEY), KEY, "left_semi").groupBy(*KEY, "turn", "tool", "arguments", "after").agg(F.count("*").alias("n")).withColumn("c", same)
    extra = extra.join(chosen.withColumnRenamed("c", "kept"), KEY).select(*KEY, "turn", "tool", "arguments", (C("n") - F.when(C("c").eqNullSafe(C("kept")), 1).otherwise(0)).alias("n")).where("n > 0")
    extra = extra.withColumn("i", F.explode(F.sequence(F.lit(1), C("n").cast("int"))))
    nameless = calls.where(C("call_id").isNull() | C("conv_id").isNull())
    unlinked = lambda df, why: df.select(*KEY, "turn", "tool", F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit(0).cast("long").alias("n_results"),
                                         F.array(F.lit(why)).alias("errors"), F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", F.lit(None).cast("string").alias("result"), "tool"), {"ignoreNullFields": "false"}).alias("json"))
    orphans = results.join(ids, KEY, "left_anti").select(*KEY, "turn", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("arguments"), "content")
    orphan_rows = orphans.select(*KEY, "turn", "tool", F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit(1).cast("long").alias("n_results"), F.array(F.lit("result without call")).alias("errors"),
                                 F.to_json(F.struct("arguments", "call_id", C("content").alias("result"), "tool"), {"ignoreNullFields": "false"}).alias("json"))
    rest = unlinked(extra, "repeated identifier").unionByName(unlinked(nameless, "no identifier")).unionByName(orphan_rows)
    return linked.unionByName(written(rest, "unlinked"))
