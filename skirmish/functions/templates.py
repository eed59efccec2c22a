"""Rule patterns and ``{name}`` templates.

Patterns are prepared once on the driver while the plan is built; only column expressions
run on the cluster.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{([^}]+)\}")


def glob_to_regex(glob: str) -> str:
    """``*`` any text, ``?`` one character, ``{name}`` a named capture, the rest literal."""
    def piece(m: re.Match) -> str:
        if m["name"]:
            return f"(?P<{m['name']}>.+?)"
        return {"*": ".*", "?": "."}.get(m[0]) or (m[0] if m[0].isalnum() or m[0] in " _'`-,:;!\"#%&/<=>@~" else "\\" + m[0])

    return re.sub(r"\{(?P<name>[A-Za-z0-9_]+)\}|.", piece, glob, flags=re.S)


def escape_literal_groups(pattern: str) -> str:
    """``(Critical)`` pasted from a log becomes ``\\(Critical\\)``.

    A bare group counts as pasted text when it holds only literal characters or groups that
    do; anything that does matching work, and named or ``(?:`` groups, stay as written.
    """
    stack: list[list] = []
    marks: list[int] = []
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1:i + 2]
            if nxt.isalnum() and nxt not in "nrtfv":  # a class, an assertion, a back-reference
                for g in stack:
                    g[1] = False
            i += 2
            continue
        if ch == "[":
            end = i + 1
            if pattern[end:end + 1] == "^":
                end += 1
            end += 1
            while end < n and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            for g in stack:
                g[1] = False
            i = end + 1
            continue
        if ch == "(":
            stack.append([i, True, pattern[i + 1:i + 2] != "?"])
            if not stack[-1][2]:
                head = re.match(r"\(\?(?:P?<\w+>|:|[a-zA-Z-]*:?)", pattern[i:])
                i += head.end() if head else 1
                continue
        elif ch == ")":
            if not stack:
                return pattern
            at, plain, bare = stack.pop()
            if plain and bare:
                marks += [at, i]
        elif ch in ".^$|*+?{":
            for g in stack:
                g[1] = False
        i += 1
    if stack:
        return pattern
    out = list(pattern)
    for at in marks:
        out[at] = "\\" + out[at]
    return "".join(out)


def to_java(pattern: str) -> tuple[str, dict[str, int]]:
    """Pattern for Spark with plain groups, and the index of each named group.

    Look-around and back-references are refused, so that a rule keeps a plain meaning.
    """
    # An escaped character starts no reference and no repeat.
    if re.search(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|\(\?P=|[*+?}]\+", re.sub(r"\\[^0-9k]", "..", pattern)):
        raise ValueError("look-around, back-references and possessive repeats are not allowed")
    compiled = re.compile(_python_names(pattern))
    plain = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    # Word, digit and blank classes mean all of Unicode, at a cost; so only where one is used.
    return ("(?Ud)" if re.search(r"\\[wWdDsSbB]", plain) else "(?d)") + plain, dict(compiled.groupindex)


def _python_names(pattern: str) -> str:
    return re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern)


def required_texts(pattern: str) -> list[str]:
    """Literal texts (three characters or more) every match of the pattern holds.

    They are cheap to test before the regex is tried.  Optional parts and alternatives count for
    nothing, and neither does a pattern that ignores case.
    """
    try:
        flags = re.compile(_python_names(pattern)).flags
    except re.error:
        return []
    if flags & (re.IGNORECASE | re.VERBOSE):
        return []
    return sorted({r for r in _literal_runs(pattern) if len(r) >= 3})


# One element of a pattern, and a repeat.
_ELEMENT = re.compile(
    r"(?P<open>\((?:\?(?:P?<[A-Za-z_]\w*>|:))?(?!\?))|(?P<other>\(\?)|(?P<close>\))|(?P<bar>\|)|(?P<anchor>[\^$]|\\[AzZbB])"
    r"|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\]|\.|\\[A-Za-z0-9])|\\(?P<escaped>.)|(?P<plain>.)", re.S)
_REPEAT = re.compile(r"(?:[*+?]|\{\d*,?\d*\})[?+]?")


def _literal_runs(pattern: str) -> list[str]:
    """Texts between elements that vary.  A group counts where it must occur and has no alternatives."""
    stack: list[list] = [[[""], False]]  # per open group: its runs, and whether it has alternatives
    at = 0
    while at < len(pattern):
        m = _ELEMENT.match(pattern, at)
        at = m.end()
        if m["open"]:
            stack.append([[""], False])
            continue
        if m["other"]:  # flags or look-around: nothing is sure
            return []
        if m["bar"]:
            stack[-1][1] = True
            continue
        if m["anchor"]:
            continue
        rep = _REPEAT.match(pattern, at)
        must = not rep or rep[0][0] == "+" or bool(re.match(r"\{0*[1-9]", rep[0]))
        at = rep.end() if rep else at
        if m["close"]:
            inner, either = stack.pop()
            runs = stack[-1][0]
            if either or not must:
                runs.append("")
            elif rep:
                runs += [*inner, ""]
            else:
                runs[-1] += inner[0]
                runs += inner[1:]
            continue
        runs, text = stack[-1][0], m["escaped"] or m["plain"]
        if text is None or rep:
            runs.append("")
        else:
            runs[-1] += text
    return [] if stack[0][1] else stack[0][0]


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        to_java(pattern)
        return re.compile(_python_names(pattern))
    except (ValueError, re.error):
        return None


def matches(text: Column, pattern: Column) -> Column:
    """Whether ``text`` has a match of a pattern that differs by row; false for one that is no pattern or is not allowed."""

    def run(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        found = ((_compiled(p) if p is not None else None, t) for t, p in zip(texts, patterns))
        return pd.Series([rx is not None and t is not None and rx.search(t) is not None for rx, t in found], dtype=bool)

    return F.pandas_udf(run, "boolean")(text, pattern)


def resolve_template(template: str, values: dict[str, Column], extra: Column | None = None) -> Column:
    """Fill ``{name}``; a name without a value stays as typed.

    ``values`` holds one nullable column per name known at plan time; ``extra`` may be a map
    column looked up for other names.
    """
    parts: list[Column] = []
    at = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at:m.start()]))
        found = [values[m[1]]] if m[1] in values else []
        if extra is not None:
            found.append(F.try_element_at(extra, F.lit(m[1])))
        parts.append(F.coalesce(*found, F.lit(m[0])))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def cmp_numeric(left: Column, right: Column, op: str) -> Column:
    """Numeric comparison; false unless both sides are numbers and nothing else, not even blanks."""
    number = r"^[+-]?(?i:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)$"
    a, b = (F.when(x.rlike(number), x.try_cast("double")) for x in (left, right))
    test = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    return F.coalesce(test, F.lit(False))
