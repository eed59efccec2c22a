"""Mixing sources to target weights in blocks of fixed length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.base import stage, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
_BUCKET_ROWS = 4_000
_TASK_SLOTS = 100_000
_ROUNDS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and split ``share`` times all sizes; a target stops at
    ``repeats`` times its source's size and the excess goes to the others by weight.  Taken in order of size per weight,
    the stopped sources come first, and each stops just when its cap is at most its share of what the ones before it left: one pass.
    The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * repeats
    all_words = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    left = each.withColumns({"left": all_words - F.coalesce(F.sum(cap).over(before), F.lit(0)), "of": F.sum("weight").over(after), "cap": cap})
    stopped = F.col("cap") * F.col("of") <= F.col("weight") * F.col("left")
    # The first source that is not stopped sets the words per weight for all that follow.
    level = F.first(F.when(~stopped, F.col("left") / F.col("of")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return left.withColumn("stopped", stopped).withColumn("level", level).select(
        "source", "source_size", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target")
    )


def permuted(i: Column, n: Column, *salt: Column | int) -> Column:
    """A pseudorandom permutation of 0 to n-1 applied to ``i``, by a swap-or-not shuffle: each round pairs every
    index with one partner and swaps them or not by a hash of the pair, so any ``n`` gives a bijection."""
    salts = [F.lit(s) if isinstance(s, int) else s for s in salt]

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *salts), n) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(x, partner), *salts) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), i, turn)


@dataclass(frozen=True)
class Mix:
    """``docs``: key, size, source_size, target, source, ``sid`` and the place [start, end) in the source's words.
    ``slots``: shard, slot, ``sid``, block: what the mix holds, in order.  ``sources``: one row per source."""

    docs: DataFrame
    slots: DataFrame
    sources: DataFrame
    block_words: int

    def taken(self) -> DataFrame:
        """``docs`` with ``taken``: the words of each document in the mix, repeats counted."""
        b = self.block_words
        uses = self.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
        cut = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}")))).alias("block")
        parts = self.docs.select("row", "key", "size", "source_size", "target", "sid", "start", cut)
        inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        met = parts.join(uses, ["sid", "block"], "left").withColumn("words", F.coalesce(inside * F.col("uses"), F.lit(0)))
        return met.groupBy("row", "key", "size", "source_size", "target").agg(F.sum("words").alias("taken"))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
             repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> Mix:
    """Plan a mix of all ``docs``.

    A source's words, its documents in a fixed pseudorandom order, are cut into blocks of ``block_words``; its last block may be
    short.  A source takes whole passes over its blocks and part of one more, up to its target to within half a block.
    Each output shard of ``shard_slots`` slots draws its source counts from the multinomial of the targets.  Where the
    draws of all shards pass a source's target, the surplus slots go, in shard order, to the sources still short.  A
    source's slots count through its pseudorandom permutation of block indices, another in each pass, with the short
    block last.  All choices hash ``seed`` and indices, so reruns agree.

    No window spans a source: offsets come from (source, bucket) sums.  Windows over shards hold counts only.  Null texts
    have no words; null sources are one source, last; null or repeated keys are fine, each row counts for itself.
    """
    size = F.size(words(F.col(text))).cast("long")
    sized = stage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("hash")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = stage(source_targets(totals.select("source", "source_size"), weights, share, repeats).join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    rest = F.round((F.col("target") - passes * F.col("source_size")) / block_words).cast("long")
    sid = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")
    sources = stage(targets.select("source", "source_size", "rows", "target", sid.alias("sid"), blocks.alias("blocks"), F.expr(f"source_size div {block_words}").alias("full"), (passes * blocks + rest).alias("quota")))

    # Places of the documents in their source.
    named = sized.join(sources.select(F.col("source").alias("s"), "source_size", "target", "sid", "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = named.withColumn("bucket", F.pmod(F.xxhash64("key", "hash", F.lit(seed)), F.ceil(F.col("rows") / _BUCKET_ROWS)))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "hash", "size")
    runs = named.withColumns({"n": F.row_number().over(within), "upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    placed = stage(runs.join(offsets, ["sid", "bucket"]).select(
        F.struct("sid", "bucket", "n").alias("row"), "key", "hash", "n", "size", "source_size", "target", "sid", (F.col("offset") + F.col("upto") - F.col("size")).alias("start")))
    return Mix(placed, _slots(sources, shard_slots, seed), sources, block_words)


def _slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    spark = sources.sparkSession
    n_slots = sources.agg(F.sum("quota")).first()[0] or 0
    # A slot draws a number below n_slots; sources own ranges as long as their quotas.  Cells make that an equal join.
    cells = min(max(n_slots, 1), 1 << 16)
    width = -(-max(n_slots, 1) // cells)
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    ranges = sources.filter("quota > 0").select("sid", (upto - F.col("quota")).alias("lo"), upto.alias("hi"))
    cut = ranges.select("sid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    draws = spark.range(n_slots).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit("draw"), "id", F.lit(seed)), F.lit(max(n_slots, 1))).alias("u"))
    drawn = draws.withColumn("cell", F.expr(f"u div {width}")).join(cut, "cell").filter("u >= lo and u < hi").groupBy("shard", "sid").agg(F.count("*").alias("n"))
    counts = stage(drawn.join(sources.select("sid", "quota"), "sid"))

    # Cut each source's draws at its quota, shard by shard.
    upto = F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    kept = counts.withColumn("upto", upto).withColumn("kept", F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), F.least(F.col("n"), F.col("upto") - F.col("quota")))))
    kept = stage(kept.select("shard", "sid", "n", "kept"))
    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    free = kept.groupBy("shard").agg((F.sum("n") - F.sum("kept")).alias("free")).filter("free > 0").withColumn("hi", F.sum("free").over(in_order)).withColumn("lo", F.col("hi") - F.col("free"))
    have = sources.join(kept.groupBy("sid").agg(F.sum("kept").alias("have")), "sid", "left").select("sid", (F.col("quota") - F.coalesce("have", F.lit(0))).alias("short")).filter("short > 0")
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    short = have.withColumn("to", F.sum("short").over(by_sid)).withColumn("from", F.col("to") - F.col("short"))
    # Each surplus slot, counted through the shards, meets the source that owns that number.
    step = max(1, shard_slots)
    free = free.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))))
    short = short.withColumn("cell", F.explode(F.sequence(F.expr(f"from div {step}"), F.expr(f"(to - 1) div {step}"))))
    over = F.least("hi", "to", (F.col("cell") + 1) * step) - F.greatest("lo", "from", F.col("cell") * step)
    given = free.join(short, "cell").withColumn("kept", over).filter("kept > 0").select("shard", "sid", "kept")
    final = stage(kept.select("shard", "sid", "kept").unionByName(given).groupBy("shard", "sid").agg(F.sum("kept").alias("n")).filter("n > 0"))

    # Slots of a source count on through the shards; the count is the place in its passes.
    first = F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    spans = final.withColumns({"first": first, "start": start}).join(sources.select("sid", "blocks", "full"), "sid")
    # A few counts make many slots, so they are dealt out before they are unrolled.
    spans = spans.repartition(-(-max(n_slots, 1) // _TASK_SLOTS), "shard", "sid")
    each = spans.select("shard", "sid", "blocks", "full", "start", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    each = each.withColumns({"turn": F.expr("(first + k) div blocks"), "index": F.expr("(first + k) % blocks")})
    block = F.when(F.col("index") < F.col("full"), permuted(F.col("index"), F.greatest("full", F.lit(1)), F.col("sid"), F.col("turn"), seed)).otherwise(F.col("index"))
    n_in = F.sum("n").over(Window.partitionBy("shard"))
    return stage(each.select("shard", (F.col("start") + F.col("k")).alias("place"), "sid", block.alias("block")))


def mixed_blocks(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: one row (shard, place, source, block, n_words, doc_ids, text) per slot.

    Documents are cut at block bounds, the pieces of a block (at most its words) joined in order, and slots joined with blocks by
    (source, index), which spreads a hot source over its blocks.
    """
    b = mix.block_words
    none = F.lit("0").cast(docs.schema[key].dataType)
    by = {"k": F.coalesce(F.col("key"), none), "nil": F.col("key").isNull(), "hash": F.col("hash")}
    whole = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).select(*(c.alias(n) for n, c in by.items()), "text")
    # Rows of one key and text are alike, so one of them stands for all.
    spread = mix.docs.filter("size > 0").withColumns(by).join(whole.dropDuplicates([*by]), [*by]).withColumn("w", words(F.col("text")))
    cut = spread.select("sid", "key", "start", "size", "w", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * b)
    n = (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - begin).cast("int")
    piece = F.array_join(F.slice("w", (begin - F.col("start") + 1).cast("int"), n), " ")
    parts = cut.select("sid", "block", F.struct(begin.alias("at"), F.col("key").alias("doc"), n.alias("n"), piece.alias("text")).alias("piece"))
    packed = parts.groupBy("sid", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    n_words = F.aggregate("pieces.n", F.lit(0), lambda x, y: x + y)
    packed = packed.select("sid", "block", n_words.alias("n_words"), F.array_distinct("pieces.doc").alias("doc_ids"), F.array_join("pieces.text", " ").alias("text"))
    names = mix.sources.select("sid", "source")
    return mix.slots.join(packed, ["sid", "block"]).join(names, "sid").select("shard", "place", "source", "block", "n_words", "doc_ids", "text")
