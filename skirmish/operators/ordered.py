"""Ordered computations over a sequence per key, without one task per key.

A log is one long sequence per stream, and a single busy stream may hold a large
part of all rows.  A plain window ``partitionBy(stream)`` would put that stream in
one task.  Everything here is a two-level scan instead:

1. rows are cut into chunks of the order column, ``order div span``; windows run per
   ``(keys, chunk)``, so a hot key spreads over as many tasks as it has chunks;
2. one summary row per ``(keys, chunk)`` is built by a normal aggregate;
3. only those summary rows are scanned per key, and the carry is joined back.

The frame given is read twice (rows and summaries).  Give it a stored table, or cut
the lineage first with :func:`stage`.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows per chunk when the order column is dense.  A chunk is one window partition.
SPAN = 1 << 20

_C = "_chunk"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate data; an error on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run in here lose their shuffle files as their action ends, for use where the result is stored."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there; the shuffle files it took are removed.

    The folder is that of ``spark.checkpoint.dir``, which all executors share.  Where none is set, only a
    session whose driver and executors are one process gets a temporary folder; a cluster is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like :func:`stage` for wide rows, texts say: written as Parquet, which is compressed and read by column."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (narrow ones), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def span_for(df: DataFrame, keys: list[str], span: int, most: int = SPAN) -> int | None:
    """``span``, or None where no key has over ``most`` rows: one window holds each sequence, and a second level would only cost."""
    return span if df.groupBy(*keys).count().filter(F.col("count") > most).limit(1).count() else None


def chunk_of(order: str, span: int) -> Column:
    return F.expr(f"`{order}` div {int(span)}")


def _join_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (keys, chunk), the partitioning the rows already have from their window."""
    return rows.join(carry, [*keys, _C], "left")


@dataclass(frozen=True)
class Carry:
    """One output of :func:`scan`.

    kind: ``last`` (latest non-null so far), ``next`` (next non-null), ``sum``, ``max``,
    ``min``.  ``inclusive`` says whether the row itself counts; ``next`` never does.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(df: DataFrame, keys: list[str], order: str, carries: list[Carry], span: int | None = SPAN) -> DataFrame:
    """Running values along ``order`` per ``keys``.  ``order`` must be unique per key.

    Without ``span`` a sequence is one window and ``df`` is read once; see :func:`span_for`.
    Rows with a null key belong to no sequence; what they get is not defined.
    """
    cols = df.columns
    if span is None:
        w = Window.partitionBy(*keys).orderBy(order)
        whole = {}
        for c in carries:
            back = w.rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1)
            if c.kind == "last":
                whole[c.name] = F.last(c.value, ignorenulls=True).over(back)
            elif c.kind == "next":
                whole[c.name] = F.first(c.value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
            else:
                whole[c.name] = _FOLD[c.kind](c.value).over(back)
        return df.select(*[x for x in cols if x not in whole], *[e.alias(n) for n, e in whole.items()])
    rows = df.withColumn(_C, chunk_of(order, span))
    w = Window.partitionBy(*keys, _C).orderBy(order)
    wc = Window.partitionBy(*keys).orderBy(_C)
    before_c = wc.rowsBetween(Window.unboundedPreceding, -1)
    after_c = wc.rowsBetween(1, Window.unboundedFollowing)
    o = F.col(order)

    local, summary, carried, final = {}, [], [], {}
    for i, c in enumerate(carries):
        rows = rows.withColumn(f"_v{i}", c.value)
        v = F.col(f"_v{i}")
        end = 0 if c.inclusive else -1
        back = w.rowsBetween(Window.unboundedPreceding, end)
        if c.kind == "last":
            local[f"_l{i}"] = F.last(v, ignorenulls=True).over(back)
            summary.append(F.max_by(v, F.when(v.isNotNull(), o)).alias(f"_s{i}"))
            carried.append(F.last(f"_s{i}", ignorenulls=True).over(before_c).alias(f"_p{i}"))
            final[c.name] = F.coalesce(f"_l{i}", f"_p{i}")
        elif c.kind == "next":
            local[f"_l{i}"] = F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
            summary.append(F.min_by(v, F.when(v.isNotNull(), o)).alias(f"_s{i}"))
            carried.append(F.first(f"_s{i}", ignorenulls=True).over(after_c).alias(f"_p{i}"))
            final[c.name] = F.coalesce(f"_l{i}", f"_p{i}")
        else:
            fold = _FOLD[c.kind]
            local[f"_l{i}"] = fold(v).over(back)
            summary.append(fold(v).alias(f"_s{i}"))
            carried.append(fold(f"_s{i}").over(before_c).alias(f"_p{i}"))
            a, b = F.col(f"_l{i}"), F.col(f"_p{i}")
            if c.kind == "sum":
                final[c.name] = F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
            elif c.kind == "max":
                final[c.name] = F.greatest(a, b)
            else:
                final[c.name] = F.least(a, b)

    marks = rows.groupBy(*keys, _C).agg(*summary)
    carry = marks.select(*keys, _C, *carried)
    out = _join_carry(rows.withColumns(local), carry, keys)
    keep = [x for x in cols if x not in final]
    return out.select(*keep, *[e.alias(n) for n, e in final.items()])


def segment(
    df: DataFrame,
    keys: list[str],
    order: str,
    state: Column,
    cut,
    member: Column | None = None,
    breaker: Column | None = None,
    span: int | None = SPAN,
    start: str = "seg_start",
    num: str = "seg_num",
) -> DataFrame:
    """Cut each key's sequence into segments.

    ``state`` is a struct kept from the latest member row; ``cut(prev, cur)`` compares two
    such structs and says whether the current member opens a new segment.  A ``breaker`` row
    at or after the latest member forces one.  The first member always opens a segment.  Adds the
    order value of the opening row and the 1-based segment number; rows before any member get
    null and 0, other non-members belong to the segment open at that point.  Without ``span`` a sequence is
    one window.  Rows with a null key belong to no sequence; what they get is not defined.
    """
    cols = df.columns
    o = F.col(order)
    member = F.lit(True) if member is None else member
    breaker = F.lit(False) if breaker is None else breaker
    rows = (
        df.withColumn(_C, F.lit(0) if span is None else chunk_of(order, span))
        .withColumn("_m", F.when(member, F.struct(o.alias("o"), state.alias("s"))))
        .withColumn("_b", F.when(breaker, o))
    )
    w = Window.partitionBy(*keys, *([] if span is None else [_C])).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_p": F.last("_m", ignorenulls=True).over(before),
        "_pb": F.max("_b").over(before),
    })
    p, m = F.col("_p"), F.col("_m")
    local = F.when(
        m.isNotNull() & p.isNotNull(),
        F.coalesce(cut(p["s"], m["s"]), F.lit(False)) | F.coalesce(F.col("_pb") >= p["o"], F.lit(False)),
    )
    if span is None:
        rows = rows.withColumn("_cut", F.coalesce(F.when(m.isNotNull() & p.isNull(), F.lit(True)).otherwise(local), F.lit(False)))
        return rows.select(
            *[c for c in cols if c not in (start, num)],
            F.max(F.when(F.col("_cut"), o)).over(upto).alias(start), F.sum(F.col("_cut").cast("long")).over(upto).alias(num))
    rows = rows.withColumn("_cut", F.coalesce(local, F.lit(False)))
    rows = rows.withColumns({
        "_ls": F.max(F.when(F.col("_cut"), o)).over(upto),
        "_ln": F.sum(F.col("_cut").cast("long")).over(upto),
        "_seen": F.max(m.isNotNull()).over(upto),
    })
    marks = rows.groupBy(*keys, _C).agg(
        F.min_by("_m", F.when(m.isNotNull(), o)).alias("_first"),
        F.max_by("_m", F.when(m.isNotNull(), o)).alias("_last"),
        F.min("_b").alias("_fb"),
        F.max("_b").alias("_lb"),
        F.max(F.when(F.col("_cut"), o)).alias("_cs"),
        F.sum(F.col("_cut").cast("long")).alias("_cn"),
    )
    wc = Window.partitionBy(*keys).orderBy(_C)
    prev = wc.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumns({
        "_pm": F.last("_last", ignorenulls=True).over(prev),
        "_pmb": F.max("_lb").over(prev),
    })
    first, pm = F.col("_first"), F.col("_pm")
    opened = F.when(
        first.isNotNull(),
        F.when(pm.isNull(), F.lit(True)).otherwise(
            F.coalesce(cut(pm["s"], first["s"]), F.lit(False))
            | F.coalesce(F.col("_pmb") >= pm["o"], F.lit(False))
            | F.coalesce(F.col("_fb") < first["o"], F.lit(False))
        ),
    )
    marks = marks.withColumn("_open", F.when(opened, first["o"]))
    carry = marks.select(
        *keys,
        _C,
        "_open",
        F.last(F.coalesce("_cs", "_open"), ignorenulls=True).over(prev).alias("_pstart"),
        F.sum(F.col("_cn") + F.col("_open").isNotNull().cast("long")).over(prev).alias("_pn"),
    )
    out = _join_carry(rows, carry, keys)
    here = F.when(F.col("_seen"), F.col("_open"))
    return out.select(
        *[c for c in cols if c not in (start, num)],
        F.coalesce("_ls", here, "_pstart").alias(start),
        (F.coalesce(F.col("_pn"), F.lit(0)) + F.col("_ln") + here.isNotNull().cast("long")).alias(num),
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top ``k`` rows per key.  The ``<= k`` filter lets Spark cut each task to k rows first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, right_order: str, name: str,
    value: Column, span: int | None = SPAN, strict: bool = False,
) -> DataFrame:
    """Add to each left row the latest right ``value`` at or before its ``order``.

    A union and one :func:`scan`; no range join and no list per key.  ``strict`` leaves out
    right rows at the very same order value.
    """
    first, second = (1, 0) if strict else (0, 1)
    pos = "_pos"
    r = right.select(*keys, (F.col(right_order) * 2 + first).cast("long").alias(pos), value.alias("_val"))
    l = left.withColumn(pos, (F.col(order) * 2 + second).cast("long")).withColumn("_left", F.lit(True))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    out = scan(both, keys, pos, [Carry(name, "last", F.col("_val"))], span and span * 2)
    return out.filter("_left").drop(pos, "_left", "_val")
