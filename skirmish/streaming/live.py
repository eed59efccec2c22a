"""Structured Streaming forms: sessions, instances and rules with state per stream.

State is small per key: the last log time, the open instance of one mob name, or the
variables of one stream.  It lives in the RocksDB state store.  The rows of one key within one
micro-batch are handled together, so bound the micro-batch at the source (``maxFilesPerTrigger``).
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skirmish.operators import classify as C
from skirmish.operators.classify import BUFF_SECS, SUMMON_SECS
from skirmish.operators.instances import GAP
from skirmish.operators.machine import Machine, facts_in
from skirmish.operators.parse import parse_lines
from skirmish.operators.rules import rule_facts
from skirmish.operators.sessions import SESSION_GAP

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def sized(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Start streams with a state partition per core, or the number given.

    A stream keeps the number it first starts with, and adaptive execution does not change it.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# Rows of a task that are packed together, about, and rows of a batch that leaves a task.
_PACK = 1 << 17
_OUT = 1 << 14


def _blocks(table: pa.Table, keys: list[str]) -> pa.RecordBatch:
    """One row per value of ``keys``: the key and its rows as a block, in their order."""
    codes = np.zeros(table.num_rows, dtype="int64")
    for name in keys:
        values = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * len(values.dictionary) + values.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(codes[order])) + 1, len(codes))
    starts = np.append(0, ends[:-1])
    rows = table.take(pa.array(order)).combine_chunks()
    heads = rows.select(keys).take(pa.array(starts)).combine_chunks().to_batches()[0]
    blocks = pa.array([_block(rows.slice(a, b - a)) for a, b in zip(starts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([*heads.columns, blocks], [*keys, "block"])


def _block(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as ``(keys, block)``, many in a block, since state in Python costs by the row that comes in rather than by its size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= _PACK:
                yield _blocks(pa.Table.from_batches(held), keys)
                held, n = [], 0
        if n:
            yield _blocks(pa.Table.from_batches(held), keys)

    return rows.mapInArrow(pack, StructType([rows.schema[k] for k in keys]).add("block", "binary"))


def unpacked(blocks: DataFrame, schema: StructType) -> DataFrame:
    """The rows of ``block``, which have the columns of ``schema``."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"]:
                yield from _rows(block.as_py()).to_batches(max_chunksize=_OUT)

    return blocks.select("block").mapInArrow(unpack, schema)


class _Sessions(StatefulProcessor):
    """Session numbers of one slice of the streams; state is the last log time and the number of each stream."""

    def __init__(self, gap: int, keep: int | None):
        self.gap, self.keep = gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "stream_id STRING", "ts BIGINT, num BIGINT", _millis(self.keep))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        codes, names = pd.factorize(batch["stream_id"], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names]
        batch = batch.assign(_code=codes).sort_values(["_code", "id"], kind="stable")
        seen = self.last.exists()
        states = [self.last.getValue((x,)) if seen else None for x in names]
        known = np.array([s is not None for s in states])
        last = np.array([s[0] if s is not None else 0 for s in states], dtype="int64")
        nums = np.array([s[1] if s is not None else 0 for s in states], dtype="int64")

        # Rows with a log time meet the one before them in their stream, the first of a stream what the state holds.
        codes = batch["_code"].to_numpy()
        timed = batch["log_ts"].notna().to_numpy()
        of, ts, login = codes[timed], batch["log_ts"].to_numpy()[timed].astype("int64"), (batch["login"] == True).to_numpy()[timed]  # noqa: E712
        first = np.append(True, of[1:] != of[:-1])[: len(of)]
        before = np.where(first, last[of], np.append(0, ts[:-1])[: len(ts)])
        cuts = np.zeros(len(batch), dtype="int64")
        cuts[timed] = (first & ~known[of]) | login | (ts - before >= self.gap)
        total = np.cumsum(cuts)
        start = np.searchsorted(codes, np.arange(len(names)))
        num = total + (nums - total[start] + cuts[start])[codes]
        end = np.append(of[1:] != of[:-1], True)[: len(of)]
        for code, at, n in zip(of[end], ts[end], num[timed][end]):
            self.last.updateValue((names[code],), (int(at), int(n)))
        if self.keep is not None:  # heard of, though without a log time
            for code in set(np.flatnonzero(known)) - set(of):
                self.last.updateValue((names[code],), states[code])
        yield batch.assign(session=np.maximum(num, 1))[["stream_id", "id", "log_ts", "session"]]

    def close(self) -> None:
        pass


def _millis(keep: int | None) -> int | None:
    return None if keep is None else keep * 1000


def _clock(keep: int | None) -> str:
    """State that is to be forgotten needs the clock; a stream with it runs on until it is stopped (:func:`stop_when_idle`)."""
    return "None" if keep is None else "ProcessingTime"


def stream_sessions(batches: DataFrame, gap: int = SESSION_GAP, keep: int | None = None, slices: int = 1024) -> DataFrame:
    """Sessions over a stream of batches ``(stream_id, id, log_ts, login)``.

    Streams share groups, ``slices`` in all, as a group costs more than a stream of a few batches; each keeps its own state.  With ``keep`` a stream
    that sent nothing for so many seconds by the clock is forgotten, and numbers from 1 if it comes back.
    """
    rows = batches.select(F.pmod(F.xxhash64("stream_id"), F.lit(slices)).cast("int").alias("slice"), "stream_id", "id", "log_ts", "login")
    return rows.groupBy("slice").transformWithStateInPandas(
        _Sessions(gap, keep), "stream_id STRING, id BIGINT, log_ts BIGINT, session BIGINT", "Append", _clock(keep))


class _Instances(StatefulProcessor):
    """Open instance of one mob name: opening line, last time, parked, slain since."""

    def __init__(self, gap: int, keep: int | None):
        self.gap, self.keep = gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "mob BIGINT, ts BIGINT, parked BOOLEAN, slain BOOLEAN", _millis(self.keep))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else None
        batch = pa.concat_tables(_rows(x) for part in rows for x in part["block"]).select(["line_no", "ts", "touch", "slay", "park"])
        batch = batch.to_pandas().sort_values("line_no", kind="stable")
        lines, timed = batch["line_no"].to_numpy(), batch["ts"].notna().to_numpy()
        ts = batch["ts"].fillna(0).to_numpy().astype("int64")
        touch, park = batch["touch"].to_numpy(), batch["park"].to_numpy()
        kills = np.cumsum(batch["slay"].to_numpy())

        # Each touch meets the one before it, the first what the state holds.
        at = np.flatnonzero(touch)
        mob, last, parked, slain = state or (None, None, False, False)
        before = lambda first, values: np.append(first, values[at])[: len(at)]
        idle = (ts[at] - before(last or 0, ts) >= self.gap) & timed[at] & before(last is not None, timed).astype(bool)
        cut = (np.diff(kills[at], prepend=-1 if slain else 0) > 0) | (idle & ~before(parked, park).astype(bool))
        if state is None:
            cut[:1] = True
        opened = np.append(0 if mob is None else mob, np.where(cut, lines[at], 0))
        number = np.maximum.accumulate(np.where(np.append(True, cut), np.arange(len(opened)), 0))
        mobs = pd.array(opened[number[np.cumsum(touch)]], dtype="Int64")
        if state is None:
            mobs[np.cumsum(touch) == 0] = pd.NA
        if len(at):
            end = at[-1]
            state = (int(mobs[end]), int(ts[end]) if timed[end] else None, bool(park[end]), bool(kills[-1] > kills[end]))
        elif state is not None:
            state = (*state[:3], bool(slain or kills[-1] > 0))
        if state is not None:
            self.open.update(state)
        yield pd.DataFrame({"stream_id": key[0], "line_no": lines, "mob": mobs})

    def close(self) -> None:
        pass


def stream_instances(events: DataFrame, gap: int = GAP, keep: int | None = None) -> DataFrame:
    """Instance of every touch and kill in a stream of classified events.

    Keyed by stream and mob name, so a busy stream spreads over its mob names.  With ``keep`` a name without an event for so many seconds
    by the clock is forgotten: a later touch opens a new instance, even of a mob that was parked, and a later kill has none.
    Choose it well over ``gap`` and, where mobs are parked, over the time they may be.
    """
    touch = F.coalesce(F.col("touch"), F.lit(False))
    slay = F.coalesce(F.col("k") == "slay", F.lit(False))
    park = F.coalesce((F.col("k") == "cc") & ~F.coalesce(F.col("off"), F.lit(True)), F.lit(False))
    rows = events.filter(touch | slay).select(
        "stream_id", F.lower(F.when(touch, F.col("mob_name")).otherwise(F.col("tgt"))).alias("mob_key"), "line_no", "ts",
        touch.alias("touch"), slay.alias("slay"), park.alias("park"))
    return packed(rows, ["stream_id", "mob_key"]).groupBy("stream_id", "mob_key").transformWithStateInPandas(
        _Instances(gap, keep), "stream_id STRING, line_no BIGINT, mob BIGINT", "Append", _clock(keep))


class _Variables(StatefulProcessor):
    """Latest value of each stored variable of one stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vars = handle.getMapState("vars", "name STRING", "value STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["line_no", "pos"], kind="stable")
        before = []
        for name, value in zip(batch["name"], batch["value"]):
            k = (name,)
            before.append(self.vars.getValue(k)[0] if self.vars.containsKey(k) else None)
            if value is not None:
                self.vars.updateValue(k, (value,))
        yield batch.assign(before=before)[["stream_id", "line_no", "pos", "name", "value", "before"]]

    def close(self) -> None:
        pass


def stream_variables(stores: DataFrame) -> DataFrame:
    """For each read or write of a variable, the value before it.

    ``stores`` is ``(stream_id, line_no, pos, name, value)``; a null value is a read.
    """
    return stores.groupBy("stream_id").transformWithStateInPandas(
        _Variables(), "stream_id STRING, line_no BIGINT, pos INT, name STRING, value STRING, before STRING", "Append", "None")


_NEVER = np.iinfo("int64").min

# Slices of what a stream remembers side by side: its names, or the keys of its batches.
_SLICES = 64


class _Direction(StatefulProcessor):
    """Who is a player and who a mob in one stream, line by line.

    State: per name the line from which it is a player and the one from which it is a mob, and a pet's owner; the last
    casts that may bring a pet.  Only the slices of names that a micro-batch mentions are read.  A name is settled once and for good, so most
    lines can tell nothing new; these are found as columns, and only the others are gone through.
    """

    def __init__(self, stretch: int = 4096):
        self.stretch = stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A call costs far more than what it carries, so names are kept by slice, as JSON.
        self.names = handle.getMapState("names", "slice INT", "names STRING")
        self.casts = handle.getMapState("casts", "kind STRING", "owner STRING, ts BIGINT, used BOOLEAN")

    def _pet(self, kind: str, secs: int, name: str, ts: int, casts: dict) -> str | None:
        owner, at, used = casts.get(kind) or (None, None, True)
        if used or owner == name or max(ts - at, 0) > secs:
            return None
        casts[kind] = owner, at, True
        return owner

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tables = [_rows(x) for part in rows for x in part["block"]]
        batch = pa.concat_tables([t.select(["line_no", "src", "tgt", *_TELLS]) for t in tables])
        line = batch["line_no"].to_numpy()
        order = np.argsort(line, kind="stable")
        line = line[order]
        n = len(line)
        col = {c: batch[c].to_numpy()[order] for c in _TELLS}
        cat, mine, casting, seen = col["_cat"], col["_mine"], col["_buff_cast"] | col["_summon_cast"], col["_buff_seen"] | col["_summon_seen"]

        # Names as numbers, the last one for none.  What is known of each, with its place in this micro-batch.
        both = pa.chunked_array([*batch["src"].chunks, *batch["tgt"].chunks], batch["src"].type).combine_chunks().dictionary_encode()
        names = both.dictionary.to_pylist()
        none = len(names)
        code = both.indices.fill_null(none).to_numpy()
        src, tgt = code[:n][order], code[n:][order]
        slices = [zlib.crc32(x.encode()) % _SLICES for x in names]
        held = {k: self.names.getValue((k,)) for k in set(slices)} if self.names.exists() else {}
        held = {k: json.loads(held[k][0]) if held.get(k) else {} for k in set(slices)}
        before = [tuple(held[k].get(x, (None, None, None))) for x, k in zip(names, slices)]
        since = np.full((2, none + 1), _NEVER)
        for i in (0, 1):
            since[i, :none] = [_NEVER if x[i] is None else x[i] for x in before]
        place = np.where(since == _NEVER, n, -1)
        player, mob = since
        owner: list[str | None] = [x[2] for x in before] + [None]
        owned: dict[int, list[tuple[int, str]]] = {}
        spaced = np.array([" " in x for x in names] + [False])
        casts = {k[0]: v for k, v in self.casts.iterator()}
        casts_before = dict(casts)

        def settle(what: int, name: int, i: int) -> None:
            if name != none and since[what, name] == _NEVER:
                since[what, name], place[what, name] = line[i], i

        def tell(i: int) -> None:
            s, t, c = src[i], tgt[i], cat[i]
            for kind in ("buff", "summon"):
                if col[f"_{kind}_cast"][i]:
                    casts[kind] = names[s] if s != none else None, int(col["_ts"][i]), False
            pet = None
            if seen[i] and s != none:
                if col["_buff_seen"][i]:
                    pet = self._pet("buff", BUFF_SECS, names[s], int(col["_ts"][i]), casts)
                elif owner[s] is None:
                    pet = self._pet("summon", SUMMON_SECS, names[s], int(col["_ts"][i]), casts)
            if pet is not None:
                owner[s] = pet
                owned.setdefault(int(s), []).append((i, pet))
                settle(0, s, i)
            struck = False
            known, met = player[s] != _NEVER, player[t] != _NEVER and player[t] < line[i]
            if c == "U":
                settle(0, s, i)
                struck = col["_hurts"][i]
            elif c in ("H", "C", "S"):
                struck = known or not (c == "H" or spaced[s] or (c == "C" and mine[i]) or mob[s] != _NEVER or met)
                settle(0 if struck else 1, s, i)
            elif c == "A":  # a spell whose cast was not seen tells nothing of its source
                struck = known
            elif c == "B" or (c == "M" and not known and (spaced[s] or mine[i] or met)):
                settle(1, s, i)
            if struck and not col["_corpse"][i]:
                settle(1, t, i)

        # Stretches that double in length: what one settles need not be looked at in the next.
        kinds = {c: cat == c for c in "UHCSAMB"}
        swing, open_tgt = kinds["H"] | kinds["C"] | kinds["S"], (tgt != none) & ~col["_corpse"]
        low, high = 0, min(n, self.stretch)
        while low < n:
            at = slice(low, high)
            s, t = src[at], tgt[at]
            new_tgt = open_tgt[at] & (mob[t] == _NEVER)
            no_player, no_mob = player == _NEVER, mob == _NEVER
            # Names that are players by the end of this stretch, or may be.
            may = ~no_player
            may[s[(kinds["U"] | seen)[at]]] = True
            may[s[swing[at] & no_mob[s]]] = True
            fresh, unmet = no_player[s], no_mob[s]
            news = (
                (casting | seen)[at]
                | (kinds["U"][at] & (fresh | (new_tgt & col["_hurts"][at])))
                | (swing[at] & ((fresh & unmet) | (new_tgt & may[s])))
                | (kinds["A"][at] & new_tgt & may[s])
                | (kinds["M"][at] & fresh & unmet)
                | (kinds["B"][at] & unmet)
            )
            for i in np.flatnonzero(news) + low:
                tell(int(i))
            low, high = high, min(n, high + (high - low) * 2)

        changed = set()
        for x, k, old, now in zip(names, slices, before, zip(player, mob, owner)):
            now = tuple(None if v == _NEVER else int(v) for v in now[:2]) + now[2:]
            if now != old:
                held[k][x] = now
                changed.add(k)
        for k in changed:
            self.names.updateValue((k,), (json.dumps(held[k]),))
        for kind, value in casts.items():
            if casts_before.get(kind) != value:
                self.casts.updateValue((kind,), value)

        # What was known at each line, in the order the rows came in.
        back = np.empty(n, dtype="int64")
        back[order] = np.arange(n)
        as_of = lambda what, name: pa.array(since[what][name][back], mask=(place[what][name] > np.arange(n))[back])
        found = [as_of(0, src), as_of(0, tgt), as_of(1, src), self._owners(src, [x[2] for x in before] + [None], owned, back)]
        start = 0
        for t in tables:
            t, told = t.drop_columns(_TELLS), [x.slice(start, len(t)) for x in found]
            start += len(t)
            for name, values in zip(_TOLD, told):
                t = t.append_column(name, values)
            yield pd.DataFrame({"block": [_block(t)]})

    def _owners(self, src: np.ndarray, before: list[str | None], owned: dict[int, list[tuple[int, str]]], back: np.ndarray) -> pa.Array:
        """Owner of the source as far as known at each line."""
        values = [*before, *(pet for x in owned.values() for _, pet in x)]
        at, new = src.astype("int64"), len(before)
        for name, got in owned.items():
            mine = np.flatnonzero(src == name)
            number = np.searchsorted([i for i, _ in got], mine, side="right")
            at[mine] = np.where(number > 0, new + number - 1, name)
            new += len(got)
        return pa.array(values, pa.string()).take(pa.array(at[back]))

    def close(self) -> None:
        pass


_TELLS = ["_ts", "_cat", "_mine", "_corpse", "_hurts", "_buff_cast", "_summon_cast", "_buff_seen", "_summon_seen"]
_TOLD = ["_ks", "_kt", "_e", "pet_owner"]


def stream_direction(parsed: DataFrame) -> DataFrame:
    """:func:`skirmish.operators.classify.classify` with its pets, while parsed lines arrive; adds ``pet_owner``, the owner of the source as far as known.

    Only what tells who somebody is goes through the state of the stream; the direction itself is made of columns, the same as in
    batch.  A line without a time counts as of second 0 for pets.  Lines of a stream must arrive in order from one micro-batch to the next; inside
    one their order does not matter.  Names stay known for good, so state grows with the names of a stream.
    """
    tgt = F.col("tgt")
    known = F.coalesce(F.col("caster").isNotNull(), F.lit(False)) if "caster" in parsed.columns else F.lit(False)
    cat = F.when((F.col("pattern") == "spell_attr") & ~known, "A").otherwise(C._category(parsed))
    flag = lambda c: F.coalesce(c, F.lit(False))
    tells = [F.coalesce("ts", F.lit(0).cast("long")), F.coalesce(cat, F.lit("")), flag(tgt == F.col("player")), flag(tgt.endswith("'s corpse")), flag(F.col("pattern") != "miss"), *C.pet_hints().values()]
    rows = packed(parsed.select("*", *[c.alias(n) for n, c in zip(_TELLS, tells)]), ["stream_id"])
    told = rows.groupBy("stream_id").transformWithStateInPandas(_Direction(), "block BINARY", "Append", "None")
    schema = StructType([*parsed.schema.fields, *[StructField(n, StringType() if n == "pet_owner" else LongType()) for n in _TOLD]])
    return C._directed(C._flags(unpacked(told, schema), "line_no"), [*parsed.columns, "pet_owner"], "line_no")


# Columns of parsed lines that make the direction.
_PARSED = ["ts", "k", "src", "tgt", "sp", "typ", "verb"]


def stream_events(lines: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Typed events with direction from a stream of lines, as :func:`skirmish.sources.tail.tail_logs` or ``stream_logs`` give them.

    With ``only``, no other columns of :func:`skirmish.operators.parse.parse_lines` are made and carried than these and those that make the direction.
    """
    if only is None:
        return stream_direction(parse_lines(lines).filter(F.col("pattern").isNotNull()))
    some = [*_PARSED, *[c for c in only if c not in _PARSED]]
    parsed = parse_lines(lines, only=some).filter(F.col("pattern").isNotNull())
    return stream_direction(parsed.select("stream_id", "player", "line_no", "pattern", *some))


class _Rules(StatefulProcessor):
    """Rules over the lines of one stream; state is its variables and the alerts that wait for their time."""

    def __init__(self, machine: Machine, seeds: dict[str, str]):
        self.machine, self.seeds = machine, seeds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vars = handle.getMapState("vars", "name STRING", "value STRING")
        self.waiting = handle.getMapState("waiting", "at BIGINT", "alerts STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.vars.iterator()}
        state = {**self.seeds, **before}
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        out, later = [], {}
        for line_no, ts, facts in zip(batch["line_no"], batch["ts"], batch["facts"]):
            for rule, n, a, text in self.machine.step(facts_in(facts), state):
                sounds, delay = a.get("sounds") or [], max(0.0, float(a.get("delay_secs") or 0.0))
                if a["type"] == "store" or (a["type"] == "voice" and not text) or (a["type"] == "sound" and not sounds):
                    continue
                r = self.machine.rules[rule]
                row = [key[0], int(line_no), r["rule_id"] or 0, r["name"], n, a["type"], text, a.get("priority", "operational"), delay, sounds, None if pd.isna(ts) else float(ts) + delay]
                if delay:
                    later.setdefault(now + int(delay * 1000), []).append(row)
                else:
                    out.append(row)
        for name, value in state.items():
            if before.get(name) != value:
                self.vars.updateValue((name,), (value,))
        for at, alerts in later.items():
            if self.waiting.containsKey((at,)):
                alerts = json.loads(self.waiting.getValue((at,))[0]) + alerts
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), (json.dumps(alerts),))
        yield pd.DataFrame(out, columns=_ALERT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        alerts = json.loads(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else []
        self.waiting.removeKey(at)
        yield pd.DataFrame(alerts, columns=_ALERT)

    def close(self) -> None:
        pass


_ALERT = ["stream_id", "line_no", "rule_id", "rule", "action", "type", "message", "priority", "delay", "sounds", "fire_ts"]


def stream_rules(lines: DataFrame, rules: list[dict], raw: str = "raw", seeds: dict[str, str] | None = None) -> DataFrame:
    """Alerts of :func:`skirmish.operators.rules.apply_rules` while lines ``(stream_id, line_no, ts, raw)`` arrive.

    Texts are tested as columns; the lines on which a rule may fire meet the variables of their stream, which are state, so rules may
    read what they wrote.  An alert without delay leaves with its line.  One with a delay waits in the state and leaves
    by a timer that many seconds later by the clock; ``fire_ts`` is in log time.  Timers fire as long as the stream
    runs, so a stream that is to stop by itself must be stopped from outside once nothing waits.  State per stream: its variables and what
    waits.  Lines of a stream must arrive in order from one micro-batch to the next.
    """
    rows, compiled = rule_facts(lines, rules, raw)
    kinds = "stream_id STRING, line_no BIGINT, rule_id INT, rule STRING, action INT, type STRING, message STRING, priority STRING, delay DOUBLE, sounds ARRAY<STRING>, fire_ts DOUBLE"
    return rows.select("stream_id", "line_no", "ts", "facts").groupBy("stream_id").transformWithStateInPandas(
        _Rules(Machine(compiled), seeds or {}), kinds, "Append", "ProcessingTime")


def stop_when_idle(query: StreamingQuery, seconds: float) -> None:
    """Stop a query that timers keep going once it has read nothing for so long and then run once more."""
    last, idle_since, batch = -1, None, None
    while query.isActive:
        p = query.lastProgress
        now = time.monotonic()
        if p and p.batchId != last:
            last = p.batchId
            if p.numInputRows:
                idle_since = None
            elif idle_since is None:
                idle_since = now
            elif batch is None and now - idle_since > seconds + 0.2:
                batch = last
            elif batch is not None and last > batch + 1:
                query.stop()
        time.sleep(0.05)
    if query.exception():
        raise query.exception()


def live_totals(events: DataFrame) -> DataFrame:
    """Running damage per stream and player; write with output mode ``update`` or ``complete``."""
    hit = events.filter(F.col("k").isin("melee", "spell", "dot", "rip", "ds") & ~F.coalesce("tank", F.lit(False)))
    return hit.groupBy("stream_id", F.col("src").alias("player")).agg(F.sum("dmg").alias("dmg"), F.count(F.lit(1)).alias("hits"))


def batches_by_second(events: DataFrame, late: str | None = None) -> DataFrame:
    """One row per stream and log second.

    No row is ever too late: write with output mode ``update`` and merge by key.  With ``late`` a second is
    emitted once (mode ``append``) when the watermark has passed it, and rows later than that are lost.
    """
    rows = events.withColumn("at", F.timestamp_seconds("ts"))
    rows = rows.withWatermark("at", late) if late else rows
    return rows.groupBy("stream_id", F.window("at", "1 second")).agg(
        F.count(F.lit(1)).alias("events"), F.min("line_no").alias("first_line")).select(
        "stream_id", F.unix_seconds("window.start").alias("ts"), "events", "first_line")


class _Resent(StatefulProcessor):
    """Batches of one slice of a stream that were not seen within the time to live of the state."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id STRING", "here BOOLEAN", _millis(self.keep))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = []
            for name in batch["id"]:
                new.append(not self.seen.containsKey((name,)))
                self.seen.updateValue((name,), (True,))
            yield batch.loc[new, ["row"]]

    def close(self) -> None:
        pass


def drop_resent(batches: DataFrame, late: str | None = None, keep: int | None = None) -> DataFrame:
    """Resent batches dropped while the stream runs (same run, seq and log time).

    With ``keep`` a batch is remembered for so many seconds by the clock after it was last sent, whatever its log time, so state is bounded
    by what is sent in that time; one resent later comes through again.  ``late`` bounds it by log time instead, and what
    is older than that is lost.  Without either, state keeps every key.
    """
    names = ["stream_id", "run", "seq", "log_ts"]
    if keep is not None:
        rows = batches.select("stream_id", F.to_json(F.struct("run", "seq", "log_ts")).alias("id"), F.to_json(F.struct(*batches.columns)).alias("row"))
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(_SLICES)).cast("int"))
        new = rows.groupBy("stream_id", "slice").transformWithStateInPandas(_Resent(keep), "row STRING", "Append", _clock(keep))
        return new.select(F.from_json("row", batches.schema).alias("r")).select("r.*")
    if not late:
        return batches.dropDuplicates(names)
    rows = batches.withColumn("at", F.timestamp_seconds("log_ts")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(names).drop("at")


def ingest(batches: DataFrame, store: str, rejects: str, checkpoint: str, column: str = "batch", keep: int | None = None):
    """Store the events of a stream of batches; text that is no batch goes to ``rejects``.

    The store has the layout of :func:`skirmish.sources.batches.write_events` with the micro-batch below the day, and
    :func:`skirmish.sources.batches.read_events` reads it.  A repeated micro-batch overwrites its own folders.  Batches that
    carry ``run``, ``seq`` and ``log_ts`` are stored once however often they are sent (``keep`` bounds for how long, see :func:`drop_resent`).  Each micro-batch is parsed once.
    """
    from skirmish.sources.batches import _parsed, events_of, rejects_of, with_date

    def write(df: DataFrame, epoch: int) -> None:
        parsed = _parsed(df, column).persist()
        put = lambda rows: rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        put(with_date(events_of(parsed, column))).partitionBy("stream_id", "log_date", "epoch").parquet(store)
        put(rejects_of(parsed)).partitionBy("epoch").json(rejects)
        parsed.unpersist()

    if {"stream_id", "run", "seq", "log_ts"} <= set(batches.columns):
        batches = drop_resent(batches, keep=keep)
    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def replay(df: DataFrame, from_id: int | None = None, to_id: int | None = None, order: str = "id") -> DataFrame:
    """A bounded range of stored rows; run with ``trigger(availableNow=True)`` to stop at the end."""
    out = df if from_id is None else df.filter(F.col(order) >= from_id)
    return out if to_id is None else out.filter(F.col(order) <= to_id)
