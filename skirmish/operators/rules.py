"""User rules over lines: conditions, captures, variables and actions, as columns.

A rule set is small and known when the plan is built, so every rule becomes column
expressions and one projection tests all rules on a line; there is no join of lines with
rules.  Rules that store variables need one ordered scan per dependency level; variables that
decide their own next values go through the functional scan of :mod:`skirmish.operators.machine`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import chatter, templates, times
from skirmish.operators.machine import Machine, fact_line, facts_of, reads_of, replay
from skirmish.operators.ordered import SPAN, Carry, scan, stage

KEYS = ["stream_id"]

# Category, label and pattern of the ready-made conditions.
PRESETS = [
    ("Death", "You slay a mob", r"You have slain (?P<tgt>.+)!"),
    ("Death", "Someone else slays a mob", r"(?P<killer>.+?) has slain (?P<tgt>.+)!"),
    ("Death", "A mob is slain (by anyone)", r"(?P<tgt>.+?) (?:was|has been) slain by (?P<killer>.+)!"),
    ("Death", "You are slain", r"You have been slain by (?P<killer>.+)!"),
    ("Death", "A mob simply died", r"(?P<tgt>.+?) died\."),
    ("Combat", "You melee a target", r"You (?:hit|slash|crush|pierce|bash|kick|punch|backstab)s? (?P<tgt>.+?) for (?P<dmg>\d+) point"),
    ("Combat", "Something melees you", r"(?P<src>.+?) (?:hits?|slashes?|crushes?|pierces?|bites?|claws?) YOU for (?P<dmg>\d+) point"),
    ("Combat", "Spell damage lands", r"(?P<src>.+?)'s (?P<spell>.+?) (?:hit|has taken effect on) (?P<tgt>.+?)(?: for (?P<dmg>\d+) point)?"),
    ("Combat", "You begin casting", r"You begin casting (?P<spell>.+)\."),
    ("Combat", "Someone heals a target", r"(?P<src>.+?) healed? (?P<tgt>.+?) for (?P<amt>\d+) hit points?"),
    ("Chat", "Someone tells you", r"(?P<src>.+?) tells? you, '(?P<msg>.+)'"),
    ("Chat", "Someone says something", r"(?P<src>.+?) says?, '(?P<msg>.+)'"),
    ("Chat", "Someone tells the group", r"(?P<src>.+?) tells? the group, '(?P<msg>.+)'"),
    ("Loot", "You loot an item", r"You (?:have )?looted (?P<item>.+?) from (?P<mob>.+?)'s corpse"),
    ("Loot", "You receive currency from a corpse", r"You receive (?P<amounts>.+?) from the corpse\."),
    ("System", "You enter a zone", r"You have entered (?P<zone>.+)\."),
]

_VISIBLE = {"alert": "message", "notice": "message", "voice": "tts_text", "sound": ""}


def preset_rules() -> list[dict]:
    """The presets as rules that raise an alert naming the preset."""
    return [
        {"rule_id": i + 1, "name": label, "enabled": True, "logic": "all",
         "conditions": [{"type": "match", "match_type": "regex", "pattern": pattern}],
         "actions": [{"type": "alert", "message": label}]}
        for i, (_, label, pattern) in enumerate(PRESETS)
    ]


def _source(cond: dict) -> str:
    text = cond.get("pattern", "")
    return templates.glob_to_regex(text) if cond.get("match_type", "regex") == "glob" else templates.escape_literal_groups(text)


def _regex(cond: dict) -> tuple[str, dict[str, int]] | None:
    """Spark pattern and group numbers of a regex or glob condition; None when invalid."""
    try:
        return templates.to_java(_source(cond))
    except (ValueError, re.error):
        return None


def compile_rules(rules: list[dict]) -> list[dict]:
    """Enabled rules with prepared patterns; an invalid pattern never matches."""
    out = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        conds = []
        for c in rule.get("conditions", []):
            c = dict(c)
            if c["type"] in ("match", "chat") and c.get("match_type", "regex") != "exact":
                c["compiled"] = _regex(c)
                c["texts"] = templates.required_texts(_source(c)) if c["compiled"] else []
            conds.append(c)
        out.append({**rule, "conditions": conds})
    return out


def discover_variables(rules: list[dict]) -> list[str]:
    """Sorted names of all named captures of all rules, disabled ones included."""
    found = set()
    for rule in rules:
        for c in rule.get("conditions", []):
            if c["type"] in ("match", "chat") and c.get("match_type", "regex") != "exact":
                compiled = _regex(c)
                found |= set(compiled[1]) if compiled else set()
    return sorted(found)


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"^\(\?U?d\)", "", pattern)).groups


class _Eval:
    """Column expressions of one rule on one line, built condition by condition."""

    def __init__(self, rule: dict, line: Column, variables: dict[str, Column]):
        self.rule, self.line, self.variables = rule, line, variables
        self.results: list[Column] = []
        self.named: dict[str, Column] = {}
        self.positional: list[tuple[Column, dict[str, Column]]] = []
        # Per condition on text: whether it holds, its named and its numbered captures.
        self.captured: list[tuple[Column, dict[str, Column], dict[str, Column]]] = []
        for cond in rule["conditions"]:
            self.results.append(F.coalesce(self._condition(cond), F.lit(False)))

    def _condition(self, c: dict) -> Column:
        if c["type"] == "var":
            return self._variable(c)
        text, speaker, gate = self.line, None, F.lit(True)
        if c["type"] == "chat":
            parts = chatter.chat_parts(self.line)
            text, speaker = parts["msg"], parts["speaker"]
            gate = parts.isNotNull() & chatter.channel_matches(c.get("channel", "any"), c.get("custom_channel", ""), parts["verb"])
        if c.get("match_type", "regex") == "exact":
            passed, named, numbered = gate & F.contains(text, F.lit(c.get("pattern", ""))), {}, {}
        elif c["compiled"] is None:
            self.captured.append((F.lit(False), {}, {}))
            return F.lit(False)
        else:
            rx, index = c["compiled"]
            holds = [F.contains(text, F.lit(t)) for t in c["texts"]]
            passed = reduce(lambda a, b: a & b, [gate, *holds, text.rlike(rx)])
            group = lambda i: F.nullif(F.regexp_extract(text, rx, i), F.lit(""))
            numbered = {str(i): group(i) for i in range(_groups(rx) + 1)}
            named = {n: group(i) for n, i in index.items()}
        if speaker is not None:
            named["speaker"] = speaker
        passed = F.coalesce(passed, F.lit(False))
        self.positional.append((passed, numbered))
        self.captured.append((passed, dict(named), numbered))
        for n, value in named.items():
            mine = F.when(passed, value)
            self.named[n] = F.coalesce(mine, self.named[n]) if n in self.named else mine
        return passed

    def values(self, stored: dict[str, Column] | None = None) -> dict[str, Column]:
        """Every name a template can use: positions, named captures, then variables.

        ``stored`` are variables written by earlier actions of the same rule.
        """
        variables = {**self.variables, **(stored or {})}
        out = dict(variables)
        out.update({n: F.coalesce(v, variables[n]) if n in variables else v for n, v in self.named.items()})
        for i in {i for _, numbered in self.positional for i in numbered}:
            case = F
            for passed, numbered in self.positional:
                case = case.when(passed, numbered.get(i, F.lit(None).cast("string")))
            value = case.otherwise(F.lit(None).cast("string"))
            out[i] = F.coalesce(value, out[i]) if i in out else value
        return out

    def _variable(self, c: dict) -> Column:
        known = self.values()
        stored = known.get(c.get("var_name", ""), F.lit(None).cast("string"))
        value = templates.resolve_template(c.get("value", ""), known)
        op = c.get("op", "isset")
        if op == "isset":
            return stored.isNotNull()
        if op == "equals":
            return F.lower(stored) == F.lower(value)
        if op == "contains":
            return F.contains(F.lower(stored), F.lower(value))
        if op == "matches":
            if "{" not in c.get("value", ""):
                try:
                    return stored.rlike(templates.to_java(c.get("value", ""))[0])
                except (ValueError, re.error):
                    return F.lit(False)
            return templates.matches(stored, value)
        return templates.cmp_numeric(stored, value, op)

    def fired(self) -> Column:
        if not self.results:
            return F.lit(True)
        join = (lambda a, b: a | b) if self.rule.get("logic", "all") == "any" else (lambda a, b: a & b)
        return reduce(join, self.results)


def _reads(rule: dict) -> set[str]:
    texts = []
    names = set()
    for c in rule["conditions"]:
        if c["type"] == "var":
            names.add(c.get("var_name", ""))
            texts.append(c.get("value", ""))
    for a in rule.get("actions", []):
        if a["type"] == "store":
            texts.append(a.get("value", ""))
    return names | {m for t in texts for m in re.findall(r"\{([^}]+)\}", t)}


def _writes(rule: dict) -> list[str]:
    return [a["var_name"] for a in rule.get("actions", []) if a["type"] == "store" and a.get("var_name")]


def variable_levels(rules: list[dict]) -> list[tuple[list[str], bool]]:
    """Stored variables in an order in which each depends only on earlier levels, or on its own.

    A level that depends on its own values, by one variable or several that need each other, is marked.
    """
    writers: dict[str, list[dict]] = {}
    for r in rules:
        for v in _writes(r):
            writers.setdefault(v, []).append(r)
    needs = {v: {x for r in rs for x in _reads(r) if x in writers} for v, rs in writers.items()}
    reach = {v: set(n) for v, n in needs.items()}
    for _ in needs:
        reach = {v: n | {y for x in n for y in reach[x]} for v, n in reach.items()}
    done: set[str] = set()
    levels = []
    while len(done) < len(needs):
        ready = sorted(v for v, n in needs.items() if v not in done and n <= done)
        loop = bool(not ready)
        if loop:
            ready = next(g for v in sorted(needs) if v not in done for g in [sorted({v} | {x for x in reach[v] if v in reach[x]})] if reach[v] <= done | set(g))
        levels.append((ready, loop))
        done |= set(ready)
    return levels


def _facts(rule: dict, number: int, line: Column, known: dict[str, Column]) -> Column:
    """The facts of one rule on one line, with the variables that are known already."""
    texts = {**rule, "conditions": [c for c in rule["conditions"] if c["type"] != "var"]}
    reads = reads_of(rule)
    return facts_of(rule, number, _Eval(texts, line, {}).captured, {n: v for n, v in known.items() if n in reads})


def _may_fire(rule: dict, line: Column) -> Column:
    """Whether the texts of a line let a rule fire, whatever its variables are."""
    texts = [c for c in rule["conditions"] if c["type"] != "var"]
    passed = [p for p, _, _ in _Eval({**rule, "conditions": texts}, line, {}).captured]
    if rule.get("logic", "all") == "any":
        return reduce(lambda a, b: a | b, passed, F.lit(len(passed) < len(rule["conditions"]) or not passed))
    return reduce(lambda a, b: a & b, passed, F.lit(True))


def _resolve_variables(
    lines: DataFrame, rules: list[dict], line: str, seeds: dict[str, str], keys: list[str], order: str, span: int
) -> tuple[DataFrame, list[dict[str, Column]]]:
    """Lines with the stored variables as columns, and per rule the values it sees."""
    seen = [{n: F.lit(v) for n, v in seeds.items()} for _ in rules]
    slots: dict[tuple[int, int], str] = {}
    for nth, (level, loop) in enumerate(variable_levels(rules)):
        # Every level reads its lines several times over.
        lines = stage(lines) if nth else lines
        writes: dict[str, list[tuple[int, str]]] = {v: [] for v in level}
        mine = {}
        for j, rule in enumerate(rules):
            for n, a in enumerate(rule.get("actions", [])):
                if a["type"] == "store" and a.get("var_name") in writes:
                    mine[j, n] = slots[j, n] = f"_w{len(slots)}"
                    writes[a["var_name"]].append((j, slots[j, n]))
        if loop:
            # The variables of the loop are state, not known columns.
            known = [{n: v for n, v in s.items() if n not in writes} for s in seen]
            events = lines.select(*keys, order, fact_line([_facts(rules[j], j, F.col(line), known[j]) for j in sorted({j for j, _ in mine})]).alias("facts")).filter(F.col("facts").isNotNull())
            done = replay(events, keys, order, Machine(rules, level), {at: i for i, at in enumerate(mine)}, {v: seeds[v] for v in level if v in seeds}, span)
            lines = lines.join(done.withColumnRenamed("writes", "_writes"), [*keys, order], "left")
            lines = lines.withColumns({c: F.get("_writes", F.lit(i)) for i, c in enumerate(mine.values())}).drop("_writes")
        else:
            for (j, n), col in mine.items():
                rule = rules[j]
                ev = _Eval(rule, F.col(line), seen[j])
                before = {a["var_name"]: F.col(slots[j, i]) for i, a in enumerate(rule["actions"][:n]) if (j, i) in slots}
                lines = lines.withColumn(col, F.when(ev.fired(), templates.resolve_template(rule["actions"][n].get("value", ""), ev.values(before))))
        last = {v: F.coalesce(*[F.col(c) for _, c in reversed(ws)]) for v, ws in writes.items()}
        lines = scan(lines, keys, order, [Carry(f"_var_{v}", "last", e, inclusive=False) for v, e in last.items()], span)
        for v, ws in writes.items():
            for j in range(len(rules)):
                same_line = [F.col(c) for i, c in reversed(ws) if i < j]
                seed = [F.lit(seeds[v])] if v in seeds else []
                seen[j] = {**seen[j], v: F.coalesce(*same_line, F.col(f"_var_{v}"), *seed)}
    return lines, seen


def _evaluated(lines, rules, raw, seeds, keys, order, span):
    compiled = compile_rules(rules)
    rows = lines.withColumn("_text", times.strip_prefix(F.col(raw)))
    if variable_levels(compiled):  # the other lines store nothing and fire nothing
        rows = stage(rows.filter(reduce(lambda a, b: a | b, [_may_fire(r, F.col("_text")) for r in compiled])))
    rows, seen = _resolve_variables(rows, compiled, "_text", seeds or {}, keys, order, span)
    return rows, compiled, [_Eval(r, F.col("_text"), seen[j]) for j, r in enumerate(compiled)]


def apply_rules(
    lines: DataFrame, rules: list[dict], raw: str = "raw", seeds: dict[str, str] | None = None,
    keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN,
) -> DataFrame:
    """Alerts: one row per line, fired rule and visible action.

    ``seeds`` are the variables of the active reference group.  ``fire_ts`` is the line's
    ``ts`` plus the delay of the action.
    """
    rows, compiled, evals = _evaluated(lines, rules, raw, seeds, keys, order, span)
    fired = []
    for rule, ev in zip(compiled, evals):
        acts = []
        stored: dict[str, Column] = {}
        for n, a in enumerate(rule.get("actions", [])):
            if a["type"] == "store":
                if a.get("var_name"):
                    stored[a["var_name"]] = templates.resolve_template(a.get("value", ""), ev.values(stored))
                continue
            text = templates.resolve_template(a.get(_VISIBLE[a["type"]], "") if _VISIBLE[a["type"]] else "", ev.values(stored))
            sounds = [F.lit(s) for s in a.get("sounds", [])]
            row = F.struct(
                F.lit(rule.get("rule_id", 0)).alias("rule_id"), F.lit(rule["name"]).alias("rule"), F.lit(n).alias("action"),
                F.lit(a["type"]).alias("type"), text.alias("message"), F.lit(a.get("priority", "operational")).alias("priority"),
                F.lit(float(a.get("delay_secs", 0.0) or 0.0)).alias("delay"),
                (F.array(*sounds) if sounds else F.array().cast("array<string>")).alias("sounds"),
            )
            keep = (text != "") if a["type"] == "voice" else F.lit(bool(sounds)) if a["type"] == "sound" else F.lit(True)
            acts.append(F.when(ev.fired() & keep, row))
        fired += acts
    base = [c for c in lines.columns]
    if not fired:
        fired = [F.lit(None).cast("struct<rule_id:int,rule:string,action:int,type:string,message:string,priority:string,delay:double,sounds:array<string>>")]
    out = rows.select(*base, F.explode(F.array_compact(F.array(*fired))).alias("_a"))
    return out.select(*base, "_a.*").withColumn("fire_ts", F.col("ts") + F.greatest(F.col("delay"), F.lit(0.0)))


def rule_facts(lines: DataFrame, rules: list[dict], raw: str = "raw") -> tuple[DataFrame, list[dict]]:
    """Lines on which a rule may fire, with what they say about the rules as ``facts``, and the compiled rules.

    Nothing here depends on stored variables, so it needs no order and works on a stream; see :class:`skirmish.operators.machine.Machine`.
    """
    compiled = compile_rules(rules)
    rows = lines.withColumn("_text", times.strip_prefix(F.col(raw)))
    facts = fact_line([_facts(r, j, F.col("_text"), {}) for j, r in enumerate(compiled)])
    return rows.withColumn("facts", facts).drop("_text").filter(F.col("facts").isNotNull()), compiled


def _preview_struct(rule: dict, ev: _Eval) -> Column:
    kinds = [a["type"] for a in rule.get("actions", [])]
    urgent = any(a["type"] == "voice" and a.get("priority") == "emergency" for a in rule.get("actions", []))
    caps = [v for _, v in sorted(ev.named.items())]
    captures = F.array_distinct(F.array_compact(F.array(*caps))) if caps else F.array().cast("array<string>")
    return F.struct(
        F.lit(rule["name"]).alias("rule"), F.lit(urgent).alias("emergency"), F.lit("alert" in kinds).alias("shows_alert"),
        F.lit("notice" in kinds).alias("shows_notice"), F.lit("sound" in kinds).alias("plays_sound"), F.lit("voice" in kinds).alias("speaks"),
        captures.alias("captures"))


def preview_rules(
    lines: DataFrame, rules: list[dict], raw: str = "raw", seeds: dict[str, str] | None = None, order: str = "line_no",
) -> DataFrame:
    """Dry run: per line and rule that would fire, its outputs and named captures.

    Variables are only the seeded ones; nothing is stored.
    """
    compiled = compile_rules(rules)
    rows = lines.withColumn("_text", times.strip_prefix(F.col(raw)))
    known = {n: F.lit(v) for n, v in (seeds or {}).items()}
    hits = []
    for i, rule in enumerate(compiled):
        ev = _Eval(rule, F.col("_text"), known)
        hits.append(F.when(ev.fired(), F.struct(F.lit(i).alias("nth"), _preview_struct(rule, ev).alias("h"))))
    out = rows.select(*lines.columns, F.explode(F.array_compact(F.array(*hits))).alias("_h"))
    return out.select(*lines.columns, F.col("_h.nth").alias("nth"), "_h.h.*")


def rule_hits_by_line(
    lines: DataFrame, rules: list[dict], raw: str = "raw", seeds: dict[str, str] | None = None
) -> DataFrame:
    """Every line with its first rule and how many more, all output flags and captures.

    All rules of a line are tested in the same row, so this is a projection, no grouping.
    """
    compiled = compile_rules(rules)
    rows = lines.withColumn("_text", times.strip_prefix(F.col(raw)))
    known = {n: F.lit(v) for n, v in (seeds or {}).items()}
    hits = F.array_compact(F.array(*[
        F.when(ev.fired(), _preview_struct(r, ev)) for r, ev in ((r, _Eval(r, F.col("_text"), known)) for r in compiled)]))
    rows = rows.withColumn("_h", hits)
    h, more = F.col("_h"), F.size("_h") - 1
    flag = lambda f: F.exists("_h", lambda x: x[f]).alias(f)
    label = F.when(more > 0, F.concat(h[0]["rule"], F.lit(" (+"), more.cast("string"), F.lit(" more)"))).when(more == 0, h[0]["rule"])
    return rows.select(*lines.columns, label.alias("rules"), *[flag(f) for f in ("emergency", "shows_alert", "shows_notice", "plays_sound", "speaks")],
                       F.flatten(F.transform("_h", lambda x: x["captures"])).alias("captures"))


def alert_history(alerts: DataFrame, now: int, max_entries: int, max_age: int = 0, keys: list[str] = KEYS) -> DataFrame:
    """The newest ``max_entries`` alerts of each stream that are young enough, with their age."""
    w = Window.partitionBy(*keys).orderBy(F.col("fire_ts").desc(), F.col("line_no").desc(), F.col("rule_id").desc(), F.col("action").desc())
    out = alerts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_entries).withColumn("age", F.lit(now) - F.col("fire_ts"))
    out = out.filter(F.col("age") <= max_age) if max_age > 0 else out
    return out.drop("_n")


def by_target(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts for the alert queue (voice and sound included) and for the notice queue."""
    notice = F.col("type") == "notice"
    return alerts.filter(~notice), alerts.filter(notice)
