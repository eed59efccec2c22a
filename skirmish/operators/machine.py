"""Rules whose variables decide their own next values: a functional scan over chunks.

A line maps the stored variables to new values, and so does a run of lines.  What does not depend on
those variables is tested as columns first; only lines on which a storing rule may still fire go on, as small
facts.  Each chunk of a stream then is a function from the variables before it to those after it.  The chunks run side
by side for the values they may start from; their tables are composed along the stream, and chunks whose
start is not in their table yet run again.  Values that many chunks end with are tried everywhere at once, so a switch with a few
states takes two rounds whatever the number of chunks; each round settles one more chunk at least.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import templates
from skirmish.operators.ordered import chunk_of, stage

# States tried in every unsettled chunk, the most frequent ends of chunks so far.
_TRIED = 8
_NUMBER = re.compile(r"[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.I | re.A)


def _map(values: dict[str, Column]) -> Column:
    pairs = [x for n, v in sorted(values.items()) for x in (F.lit(n), v)]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def reads_of(rule: dict) -> set[str]:
    """Names that conditions on variables and texts of actions of a rule look up."""
    conds = [c for c in rule["conditions"] if c["type"] == "var"]
    texts = [c.get("value") for c in conds] + [a.get(t) for a in rule.get("actions") or [] for t in ("value", "message", "tts_text")]
    return {c.get("var_name") or "" for c in conds} | {n for t in texts for n in templates._PLACEHOLDER.findall(t or "")}


def facts_of(rule: dict, number: int, captured: list[tuple[Column, dict[str, Column], dict[str, Column]]], known: dict[str, Column]) -> Column:
    """What a line says about one rule, as a struct; null where the rule can't fire whatever its variables are.

    ``captured`` holds, for each condition on text, whether it holds and its named and numbered captures; only those that
    the rule reads are kept.
    """
    read = reads_of(rule)
    tests = [c["type"] == "var" for c in rule["conditions"]]
    if rule.get("logic", "all") == "any":
        may = F.lit(any(tests) or not tests)
        for passed, _, _ in captured:
            may = may | passed
    else:
        may = F.lit(True)
        for passed, _, _ in captured:
            may = may & passed
    some = lambda values: _map({n: v for n, v in values.items() if n in read})
    conds = [F.struct(p.alias("p"), some(n).alias("n"), some(g).alias("g")) for p, n, g in captured]
    conds = F.array(*conds) if conds else F.lit(None).cast("array<struct<p:boolean,n:map<string,string>,g:map<string,string>>>")
    return F.when(may, F.struct(F.lit(number).alias("r"), conds.alias("c"), _map(known).alias("v")))


def fact_line(structs: list[Column]) -> Column:
    """The facts of all rules as JSON; null where no rule may fire."""
    found = F.array_compact(F.array(*structs))
    return F.when(F.size(found) > 0, F.to_json(found))


@lru_cache(1 << 16)
def facts_in(text: str) -> list[dict]:
    """The facts of a line; lines that say the same share them."""
    return json.loads(text)


class Machine:
    """Applies rules to the facts of one line after the other, over a state of stored variables."""

    def __init__(self, rules: list[dict], names: list[str] | None = None):
        self.rules = [{k: r.get(k) for k in ("rule_id", "name", "logic", "conditions", "actions")} for r in rules]
        for r in self.rules:
            r["conditions"] = [{k: c.get(k) for k in ("type", "var_name", "op", "value")} for c in r["conditions"]]
        # Variables that are state here; None: all of them.
        self.names = names

    @staticmethod
    def _fill(template: str, find) -> str:
        return template if "{" not in template else templates._PLACEHOLDER.sub(lambda m: m[0] if (v := find(m[1])) is None else v, template)

    def _holds(self, c: dict, find) -> bool:
        stored, value = find(c["var_name"] or ""), self._fill(c["value"] or "", find)
        op = c["op"] or "isset"
        if op == "isset" or stored is None:
            return op == "isset" and stored is not None
        if op == "equals":
            return stored.lower() == value.lower()
        if op == "contains":
            return value.lower() in stored.lower()
        if op == "matches":
            rx = templates._compiled(value)
            return rx is not None and rx.search(stored) is not None
        if not (_NUMBER.fullmatch(stored) and _NUMBER.fullmatch(value)):
            return False
        a, b = float(stored), float(value)
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]

    def step(self, line: list[dict], state: dict[str, str]) -> Iterator[tuple[int, int, dict, str]]:
        """Run the rules of one line; ``state`` is updated.  Yields (rule, action number, action, what it stores or says)."""
        for fact in line:
            rule = self.rules[fact["r"]]
            known = fact.get("v") or {}
            named: dict[str, str] = {}
            groups: dict[str, str] | None = None
            stored: dict[str, str] = {}

            def find(name: str) -> str | None:
                for source in (groups or {}, named, stored, state, known):  # noqa: B023
                    if source.get(name) is not None:
                        return source[name]
                return None

            results, texts = [], iter(fact.get("c") or [])
            for c in rule["conditions"]:
                if c["type"] == "var":
                    results.append(self._holds(c, find))
                    continue
                got = next(texts)
                results.append(got["p"])
                if got["p"]:
                    named.update({k: v for k, v in (got.get("n") or {}).items() if v is not None})
                    groups = (got.get("g") or {}) if groups is None else groups
            if results and not (any(results) if rule["logic"] == "any" else all(results)):
                continue
            for n, a in enumerate(rule["actions"] or []):
                if a["type"] != "store":
                    yield fact["r"], n, a, self._fill(a.get({"alert": "message", "notice": "message", "voice": "tts_text"}.get(a["type"], ""), "") or "", find)
                elif a.get("var_name"):
                    value = self._fill(a.get("value", ""), find)
                    stored[a["var_name"]] = value
                    yield fact["r"], n, a, value
            state.update({k: v for k, v in stored.items() if self.names is None or k in self.names})


def _dump(state: dict[str, str]) -> str:
    return json.dumps(state, sort_keys=True)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of a chunk together: the states to start from, then its lines in order."""
    return rows.repartition("_k", "_chunk").sortWithinPartitions("_k", "_chunk", "_at")


def _ends(events: DataFrame, starts: DataFrame, machine: Machine, nth: int) -> DataFrame:
    """Run chunks for given starts: (_k, _chunk, start, end, nth)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, states, names = None, [], []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(*here, n, _dump(s), nth) for s, ns in zip(states, names) for n in ns], columns=["_k", "_chunk", "start", "end", "nth"])

        for b in batches:
            out = []
            for k, chunk, at, body in zip(b["_k"], b["_chunk"], b["_at"], b["body"]):
                if (k, chunk) != here:
                    if here is not None:
                        out.append(done())
                    here, states, names = (k, chunk), [], []
                if pd.isna(at):
                    states.append(json.loads(body))
                    names.append([body])
                    continue
                line = facts_in(body)
                for s in states:
                    for _ in machine.step(line, s):
                        pass
                for i in range(len(states) - 1, 0, -1):  # starts that have come together go on as one
                    j = states.index(states[i])
                    if j < i:
                        names[j] += names.pop(i)
                        states.pop(i)
            yield pd.concat(out) if out else pd.DataFrame(columns=["_k", "_chunk", "start", "end", "nth"])
        if here is not None:
            yield done()

    mine = events.join(starts.select("_k", "_chunk").distinct(), ["_k", "_chunk"], "left_semi")
    rows = mine.unionByName(starts.select("_k", "_chunk", F.lit(None).cast("long").alias("_at"), F.col("start").alias("body")))
    return _grouped(rows).mapInPandas(run, "_k string, _chunk long, start string, end string, nth int")


def _walk(tables: DataFrame, first: str) -> DataFrame:
    """Compose the chunks' tables along each stream: each chunk's start, if it is sure, and whether its table lacks it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, table, last, state, sure = None, None, {}, None, first, True
        out = []

        def close() -> None:
            nonlocal state, sure
            if chunk is None:
                return
            lacks = state not in table
            out.append((key, chunk, state, sure, lacks))
            sure = sure and not lacks
            state = last if lacks else table[state]

        for b in batches:
            for k, c, start, end in zip(b["_k"], b["_chunk"], b["start"], b["end"]):
                if (k, c) != (key, chunk):
                    close()
                    if k != key:
                        state, sure = first, True
                    key, chunk, table = k, c, {}
                table[start] = last = end
            yield pd.DataFrame(out, columns=["_k", "_chunk", "start", "sure", "lacks"])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=["_k", "_chunk", "start", "sure", "lacks"])

    rows = tables.repartition("_k").sortWithinPartitions("_k", "_chunk", "nth")
    return rows.mapInPandas(run, "_k string, _chunk long, start string, sure boolean, lacks boolean")


def replay(events: DataFrame, keys: list[str], order: str, machine: Machine, slots: dict[tuple[int, int], int], seeds: dict[str, str], span: int) -> DataFrame:
    """What each line stores, ``(keys, order, writes)``: an entry per slot, null where nothing is stored; lines that store nothing are left out.

    ``events`` is ``(keys, order, facts)``, ``slots`` numbers the (rule, action) pairs that store.  ``order`` is unique per key.
    """
    chunked = stage(events.select(F.to_json(F.struct(*keys)).alias("_k"), chunk_of(order, span).alias("_chunk"), F.col(order).cast("long").alias("_at"), F.col("facts").alias("body")))
    first = _dump(seeds)
    starts = chunked.select("_k", "_chunk").distinct().withColumn("start", F.lit(first))
    tables, nth = stage(_ends(chunked, starts, machine, 0)), 0
    while True:
        walked = stage(_walk(tables, first))
        if not walked.filter("lacks").limit(1).count():
            break
        nth += 1
        often = [r["end"] for r in tables.groupBy("end").count().orderBy(F.desc("count"), "end").limit(_TRIED).collect()]
        open_ = walked.filter("lacks or not sure")
        tried = open_.select("_k", "_chunk", F.explode(F.array(*map(F.lit, often))).alias("start"))
        wanted = open_.filter("lacks").select("_k", "_chunk", "start").unionByName(tried).distinct()
        starts = stage(wanted.join(tables.select("_k", "_chunk", "start"), ["_k", "_chunk", "start"], "left_anti"))
        tables = stage(tables.unionByName(_ends(chunked, starts, machine, nth)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, str] = {}
        for b in batches:
            out = []
            for k, at, body in zip(b["_k"], b["_at"], b["body"]):
                if pd.isna(at):
                    state = json.loads(body)
                    continue
                writes: list[str | None] = [None] * len(slots)
                for rule, n, a, value in machine.step(facts_in(body), state):
                    if (rule, n) in slots:
                        writes[slots[rule, n]] = value
                if any(w is not None for w in writes):
                    out.append((k, int(at), writes))
            yield pd.DataFrame(out, columns=["_k", "_at", "writes"])

    rows = chunked.unionByName(walked.select("_k", "_chunk", F.lit(None).cast("long").alias("_at"), F.col("start").alias("body")))
    done = _grouped(rows).mapInPandas(run, "_k string, _at long, writes array<string>")
    kinds = ", ".join(f"`{c}` {t}" for c, t in events.select(*keys).dtypes)
    return done.select(F.from_json("_k", kinds).alias("_k"), F.col("_at").alias(order), "writes").select("_k.*", order, "writes")
