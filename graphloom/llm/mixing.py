"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash of their ids, form a stream of words that repeats once; the stream is cut
into blocks of equally many words. As many golden-ratio points as the targets fill blocks, mapped through the cumulative
target shares, deal slots to sources; the rank of a slot within its source names the block it takes. A source's words are
those of its slots, so they differ from its target by the discrepancy of the points: a few blocks at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.text import join_decisions, or_empty, words
from graphloom.runtime import broadcast_if_few, stage, with_offsets

#: Words of a block.
BLOCK = 128
#: Cells of [0, 1) through which points meet the cumulative shares by an equality join.
CELLS = 4096
#: Slots (2 to this power) of which a rank counts one by one; whole runs before it are summed.
RUN_BITS = 12

_PHI = (math.sqrt(5) - 1) / 2
#: What 2**20 steps and one step of the golden ratio add, modulo 1.
GOLDEN = (math.fmod((1 << 20) * _PHI, 1.0), _PHI)


def _golden(t: Column) -> Column:
    """Fractional part of ``t`` times the golden ratio; the low 20 bits go apart so that doubles stay exact enough."""
    high, low = F.shiftright(t, 20), t.bitwiseAND(F.lit((1 << 20) - 1))
    return F.pmod(high * F.lit(GOLDEN[0]) + low * F.lit(GOLDEN[1]), F.lit(1.0))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (s, source, source_size) with target (double) and words (its rounded value).

    Weights repeat over the sources in code-point order, null last. Targets share ``share`` times all words by weight;
    none exceeds ``most`` times its source, and the excess is shared again. A source is capped exactly if, at the level
    where its own cap binds, the budget isn't used up yet.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    upto = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("caps", F.sum("cap").over(upto)).withColumn("done", F.sum("weight").over(upto))
    s = s.withColumn("all_weights", F.sum("weight").over(everything))
    s = s.withColumn("full", F.col("caps") + F.col("level") * (F.col("all_weights") - F.col("done")) <= F.col("budget"))
    cap_sum = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0.0))).over(everything)
    open_sum = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything)
    s = s.withColumns({"cap_sum": cap_sum, "open_sum": open_sum})
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("cap_sum")) / F.col("open_sum") * F.col("weight"))
    s = s.withColumn("target", target)
    return s.select("s", "source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots ``(slot, s, block)`` from ``sources`` (s, words): slot numbers in mixing order; ``block`` is the rank in the source.

    There are as many slots as blocks in all words; point number ``slot`` falls into the interval of one source. The few
    that go past a source's second lap, where its target is all of it twice, stay without words.
    """
    spark = sources.sparkSession
    shares = sources.filter("words > 0").select("s", "words")
    words_ = int(shares.agg(F.sum("words")).first()[0] or 0)
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = shares.withColumn("hi", F.sum("words").over(upto)).withColumn("lo", F.col("hi") - F.col("words"))
    scale = F.lit(float(max(words_, 1)))
    shares = shares.select("s", (F.col("lo") / scale).alias("lo"), (F.col("hi") / scale).alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    grid = broadcast_if_few(stage(shares.select("s", "lo", "hi", F.explode(cells).alias("cell")), "grid"))
    points = spark.range(-(-words_ // block)).select(F.col("id").alias("slot"), _golden(F.col("id") + 1).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(grid, "cell").filter("u >= lo and u < hi").select("slot", "s", F.shiftright("slot", RUN_BITS).alias("run"))
    ranked = with_offsets(dealt, ["s"], "run", F.lit(1), "before")
    rank = F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1
    return ranked.select("slot", "s", (F.col("before") + rank).alias("block"))


def _pieces(lap: int, block: int) -> Column:
    """Blocks of the stream that hold the row's words in its lap, with its first word in each and how many, up to ``got`` blocks."""
    lo = F.col("start") + F.col("source_size") * lap
    hi = F.least(lo + F.col("size"), F.col("got") * block)
    numbers = F.sequence(F.floor(lo / block), F.floor((hi - 1) / block))

    def piece(b: Column) -> Column:
        first = F.greatest(lo, b * block)
        return F.struct(b.alias("block"), F.lit(lap).alias("lap"), (first - lo).alias("first"), (F.least(hi, (b + 1) * block) - first).alias("n"))

    none = F.expr("cast(array() as array<struct<block:bigint,lap:int,first:bigint,n:bigint>>)")
    return F.when(lo < hi, F.transform(numbers, piece)).otherwise(none)


def _placed(docs: DataFrame, key: str, text: str, source: str, block: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their place in their source's stream, and the schedule's slots (slot, s, block)."""
    slim = docs.select(
        F.col(key).alias("id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")).alias("s"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("order"),
        F.xxhash64(or_empty(text)).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    slim = stage(slim, "sizes")
    sizes = slim.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = stage(source_targets(sizes), "targets")
    slots = stage(schedule(sources, block), "slots")
    got = slots.groupBy("s").agg(F.count(F.lit(1)).alias("got"))
    ordered = Window.partitionBy("s", "bucket").orderBy("order", "id", "size", "_hash", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_offsets(slim, ["s"], "bucket", F.col("size"), "before")
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    of_source = broadcast_if_few(stage(sources.join(got, "s", "left").select("s", "source_size", "target", F.coalesce("got", F.lit(0)).alias("got")), "taken_by"))
    return placed.join(of_source, "s").select("_row", "id", "_hash", "s", "size", "source_size", "target", "start", "got"), slots


def _sequence(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    pieces = placed.withColumn("p", F.explode(F.concat(_pieces(0, block), _pieces(1, block)))).select("_row", "id", "_hash", "s", "p.*")
    return pieces.join(slots, ["s", "block"]).select("slot", "_row", "id", "_hash", "lap", "first", "n")


def mixed_sequence(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix: ``(slot, _row, id, _hash, lap, first, n)``, a row for each run of words that a document gives to a slot.

    Slots in ascending order are the mixing order, and runs within a slot follow by lap, row and ``first``, the run's first
    word in the document. Nulls, repeats and empty tables are as in ``mix``.
    """
    return _sequence(*_placed(docs, key, text, source, block), block)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``key``, size, source_size, target, taken, ``slots`` (where each lap begins) and ``_hash`` of the text.

    Null text has size 0 and is never taken; null is a source of its own, last in order. Rows with equal ids follow each
    other in the shuffled stream in an order fixed by size and text; a repeated row is mixed as one more document. A text
    of any length gives as many runs as it fills blocks. An empty table gives no rows, a source without words target 0.
    Other columns of ``docs`` are not read.
    """
    placed, slots = _placed(docs, key, text, source, block)
    laps = _sequence(placed, slots, block).groupBy("_row", "lap").agg(F.min("slot").alias("slot"), F.sum("n").alias("n"))
    taken = laps.groupBy("_row").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))
    out = placed.join(taken, "_row", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return out.select(F.col("id").alias(key), "_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", none).alias("slots"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` in their own columns, each as often as the mix takes it (taken words over its size, rounded), in mixing order.

    A copy stands where its lap begins in the schedule: partitions are ranges of slots, sorted within. Null and empty texts
    are in no mix and go. Rows of one id and text share their number of copies. An empty table stays empty.
    """
    taken = stage(mix(docs, key, text, source), "taken")
    times = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    # Rows of one id and text are alike; which of them a lap took makes no difference, so their takings are averaged.
    copies = taken.select(F.col(key).alias("_id"), "_hash", times.alias("n"), "slots").groupBy("_id", "_hash")
    copies = copies.agg(F.floor(F.avg("n") + 0.5).cast("int").alias("n"), F.array_sort(F.flatten(F.collect_list("slots"))).alias("slots"))
    copies = stage(copies.filter("n > 0").select("_id", "_hash", F.slice("slots", F.lit(1), F.col("n")).alias("_slots")), "copies")
    joined = join_decisions(docs, copies, "inner", key, text).withColumn("_slot", F.explode("x._slots"))
    ordered = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("_slot").alias("_slot_of_the_mix"))
    return ordered.repartitionByRange("_slot_of_the_mix").sortWithinPartitions("_slot_of_the_mix").drop("_slot_of_the_mix")
