"""Tool calls of conversations: linked with results, ordered, validated and serialised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import stage


@dataclass(frozen=True)
class Arg:
    """``kind``: string, integer, number, boolean, array or object; ``least`` and ``most`` bound numbers; ``among`` lists allowed strings."""

    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    among: tuple[str, ...] = ()


Schemas = dict[str, dict[str, Arg]]

# Variant type names of each kind of argument.
_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


# Parts of JSON text: strings, numbers, the rest.
_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def _number(x: Column) -> Column:
    """A number's text in one form: digits without exponent or trailing zeros, or, outside of 38 digits, mantissa and exponent."""
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = [F.when(x.try_cast(f"decimal(38,{scale})").cast("double") == x.try_cast("double"), x.try_cast(f"decimal(38,{scale})").cast("string")) for scale in (18, 0)]
    # A decimal of 38 digits or more prints zeros after the point.
    fraction = F.coalesce(*[F.when(p.contains("."), trimmed(p)).otherwise(p) for p in plain])
    parts = F.split(x, "[eE]")
    scientific = F.concat(trimmed(parts[0]), F.lit("e"), F.regexp_replace(F.get(parts, F.lit(1)), r"^\+", ""))
    out = F.when(x.rlike("[eE]"), F.coalesce(fraction, scientific)).when(x.contains("."), trimmed(x)).otherwise(x)
    return F.when(out == "-0", F.lit("0")).otherwise(out)


def _one_form(json: Column) -> Column:
    """JSON text with every number in one form; strings stay."""
    parts = F.transform(F.regexp_extract_all(json, F.lit(_PARTS), F.lit(0)), lambda x: F.when(x.rlike("^-?[0-9]"), _number(x)).otherwise(x))
    return F.when(json.rlike("[0-9][.eE]|-0"), F.array_join(parts, "")).otherwise(json)


def canonical(text: Column) -> Column:
    """JSON with sorted keys, without blanks, and one form for equal numbers (1, 1.0 and 1e0 are 1); null where ``text`` is not JSON.

    Integers and decimals are exact up to 38 digits; longer ones, and numbers with an exponent, are double-precision.
    """
    return _one_form(F.to_json(F.try_parse_json(text)))


def _problems(tool: Column, args: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments (a variant) of a call, sorted texts; empty if nothing is."""
    by_tool = []
    for name, fields in sorted(schemas.items()):
        found = []
        for arg, rule in sorted(fields.items()):
            value = F.try_variant_get(args, f"$.{arg}", "variant")
            kind = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
            text, number = F.try_variant_get(args, f"$.{arg}", "string"), F.try_variant_get(args, f"$.{arg}", "double")
            absent = value.isNull() | F.is_variant_null(value)
            wrong = ~kind.isin(*_KINDS[rule.kind])
            found.append(F.when(absent, F.lit(f"{arg}: missing") if rule.required else None).when(wrong, F.lit(f"{arg}: not {rule.kind}")))
            bad = F.lit(False)
            if rule.least is not None:
                bad = bad | (number < rule.least)
            if rule.most is not None:
                bad = bad | (number > rule.most)
            if rule.among:
                bad = bad | ~text.isin(*rule.among)
            found.append(F.when(~absent & ~wrong & bad, F.lit(f"{arg}: out of range")))
        keys = F.map_keys(F.try_variant_get(args, "$", "map<string,variant>"))
        extra = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, fields)).cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        by_tool.append((name, F.sort_array(F.concat(F.array_compact(F.array(*found)).cast("array<string>"), extra))))
    out = F.array(F.lit("unknown tool"))
    for name, problems in by_tool:
        out = F.when(tool == name, problems).otherwise(out)
    return F.when(args.isNull(), F.array(F.lit("arguments are not a JSON object"))).otherwise(out)


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Join calls (conv, turn, call_id, tool, args, uses) with results (conv, call_id, result): adds ``result`` and ``n_results``.

    An identifier counts within its conversation, so conversations may use the same ones.  Several results of one call are
    counted and the least is taken; calls without result have null and 0.  Results of no call are left out.
    Null identifiers and null conversations never match.
    """
    one = results.filter("conv is not null and call_id is not null").groupBy("conv", "call_id").agg(F.min("result").alias("result"), F.count("*").alias("n_results"))
    return calls.drop("result", "n_results").join(one, ["conv", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))


def order_calls(calls: DataFrame) -> DataFrame:
    """Add ``rank`` (turn, hops), by which every call comes after all it uses, ``missing`` (used ids that do not exist) and ``cyclic``.

    A call ranks at its turn, or at the latest turn among what it uses directly or in turn, after it: (turn, hops) is
    the least solution of rank = max((turn, 0), rank of a used call plus one hop).  A call that uses earlier
    ones only keeps its turn, so only uses that point forward need rounds, one per step of the longest such chain.
    Calls on a cycle, or that use one, never settle: a call whose hops reach the number of calls of its conversation is ``cyclic``
    and its rank is (its turn, null).  Calls whose id is null or shared with another call of the conversation can't be used.
    """
    named = calls.withColumn("n", F.monotonically_increasing_id())
    named = stage(named)
    unique = named.filter("call_id is not null").groupBy("conv", "call_id").agg(F.count("*").alias("same"), F.min("n").alias("used"), F.min("turn").alias("used_turn")).filter("same = 1").drop("same")
    uses = named.select("conv", "turn", "n", F.explode(F.array_distinct(F.coalesce("uses", F.array().cast("array<string>")))).alias("call_id")).filter("call_id is not null")
    found = uses.join(unique, ["conv", "call_id"], "left")
    gaps = found.filter("used is null").groupBy("n").agg(F.sort_array(F.collect_set("call_id")).alias("missing"))
    edges = stage(found.filter("used is not null").select("conv", "n", "turn", "used", "used_turn"))
    sizes = named.groupBy("conv").agg(F.count("*").alias("calls"))
    # Ranks that differ from (turn, 0); a round extends them by one use.
    moved = stage(edges.filter("used_turn >= turn").groupBy("conv", "n").agg(F.max(F.struct(F.col("used_turn").alias("turn"), F.lit(1).alias("hops"))).alias("rank")))
    before = None
    while True:
        state = moved.agg(F.count("*"), F.sum(F.xxhash64("n", "rank").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        through = edges.join(moved.select(F.col("n").alias("used"), F.col("rank").alias("of")), "used").filter("of.turn >= turn")
        longer = through.select("conv", "n", F.struct(F.col("of.turn").alias("turn"), (F.col("of.hops") + 1).alias("hops")).alias("rank"))
        moved = moved.select("conv", "n", "rank").unionByName(longer).groupBy("conv", "n").agg(F.max("rank").alias("rank")).join(sizes, "conv")
        moved = stage(moved.select("conv", "n", F.struct(F.col("rank.turn").alias("turn"), F.least(F.col("rank.hops"), F.col("calls").cast("int")).alias("hops")).alias("rank")))
    limit = moved.join(sizes, "conv").select("n", "rank", (F.col("rank.hops") >= F.col("calls")).alias("cyclic"))
    out = named.join(limit, "n", "left").join(gaps, "n", "left")
    cyclic = F.coalesce("cyclic", F.lit(False))
    rank = F.struct(F.when(cyclic | F.col("rank").isNull(), F.col("turn")).otherwise(F.col("rank.turn")).alias("turn"), F.when(cyclic, None).otherwise(F.coalesce("rank.hops", F.lit(0))).alias("hops"))
    return out.withColumns({"rank": rank, "cyclic": cyclic, "missing": F.coalesce("missing", F.array().cast("array<string>"))}).drop("n")


def format_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Link, order, validate and serialise tool calls.

    ``calls``: conv, turn, call_id, tool, args (JSON text), uses (ids whose results the call needs); ``results``: conv,
    call_id, result.
    Returns conv, turn, call_id, ``rank_turn``, ``rank_hops`` (the order within a conversation: every call comes after
    what it uses), ``problems`` (sorted), ``valid`` and ``json``: the call with its result as canonical JSON, keys
    sorted, no blanks, one form for equal numbers.  Rows are never gathered per conversation.  Null texts are null in the JSON; other columns are dropped.
    """
    linked = order_calls(link_results(calls.select("conv", "turn", "call_id", "tool", "args", "uses"), results.select("conv", "call_id", "result")))
    parsed = linked.withColumn("given", F.try_parse_json(F.col("args")))
    is_object = F.schema_of_variant(F.col("given")).startswith("OBJECT")
    parsed = parsed.withColumn("given", F.when(is_object, F.col("given")))
    about = F.concat(
        _problems(F.col("tool"), F.col("given"), schemas),
        F.transform("missing", lambda x: F.concat(F.lit("uses "), x, F.lit(": missing"))),
        F.when(F.col("cyclic"), F.array(F.lit("uses: cycle"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n_results") == 0, F.array(F.lit("result: missing"))).when(F.col("n_results") > 1, F.array(F.lit("result: repeated"))).otherwise(F.array().cast("array<string>")),
    )
    checked = parsed.withColumn("problems", F.sort_array(about))
    # Keys in sorted order; the arguments are canonical already.
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(F.col(c)))), F.lit("[null]"))
    bare = lambda c: F.regexp_replace(text(c), r"(?s)^\[(.*)\]$", "$1")
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(_one_form(F.to_json("given")), F.lit("null")), F.lit(',"call_id":'), bare("call_id"),
        F.lit(',"result":'), bare("result"), F.lit(',"tool":'), bare("tool"), F.lit("}"),
    )
    return checked.select("conv", "turn", "call_id", F.col("rank.turn").alias("rank_turn"), F.col("rank.hops").alias("rank_hops"), "problems", (F.size("problems") == 0).alias("valid"), json.alias("json"))


SCHEMAS: Schemas = {
    "lookup": {"query": Arg("string"), "words": Arg("integer", least=1, most=40)},
    "summarise": {"query": Arg("string"), "words": Arg("integer", least=1), "style": Arg("string", required=False, among=("plain", "short"))},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off chat turns: every user turn calls a tool on its text and the next turn, if the assistant's, is the result.

    Long requests (over 30 words) are summarised, others looked up; one in five (by word count) needs the result of the next
    user turn, the others that of the one before unless that one waits for them.  Identifiers name the turn, so they repeat between conversations.
    """
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    ident = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    quoted = F.to_json(F.to_variant_object(F.struct(F.col("text").alias("query"), n.cast("long").alias("words"))))
    waits = n % 5 == 0
    users = conversations.filter("role = 'user'")
    others = users.select("conv_id", (F.col("turn") + 2).alias("turn"), waits.alias("waits")).groupBy("conv_id", "turn").agg(F.max("waits").alias("waits_before"))
    calls = users.join(others, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("conv"), "turn", ident(F.col("turn")).alias("call_id"), F.when(n > 30, "summarise").otherwise("lookup").alias("tool"), quoted.alias("args"),
        F.when(waits, F.array(ident(F.col("turn") + 2))).when(~F.col("waits_before"), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("uses"),
    )
    results = conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("conv"), ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))
    return calls, results
