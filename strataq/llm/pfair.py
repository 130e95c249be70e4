"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Rows of a source are put in a fixed pseudo-random order and cut into blocks. In
the fluid schedule all sources run at once, each at a speed in proportion to its
weight; a source that has run out leaves its share to the others. At virtual
time v source j has run min(blocks_j, units_j * v) blocks, and

    t(v) = sum over j of min(blocks_j, units_j * v) = gone(v) + live(v) * v

slots have passed, where gone counts the blocks of sources that have run out and
live the units of the others. Block i of source s fills the virtual time from
i / units_s to (i + 1) / units_s, so it is released at slot floor(t(i / units_s))
and due by slot ceil(t((i + 1) / units_s)). In each slot the released block with
the earliest deadline runs. No more blocks have their windows between two slots
than there are slots between them, so no deadline is missed: after any number of
slots each source is less than one block from its fluid share. Weights are whole
units and all times exact: there is no period and nothing drifts however long
the schedule is.

The schedule is made in epochs of slots, in parallel. What an epoch runs is, of
the blocks that it would run by itself and those handed over to it, the earliest
by deadline that fit; so a first pass runs each epoch by itself, one short fold
over the epochs finds what each hands over, and a second pass runs each epoch
with that. Epochs times sources are at most ``HANDED`` numbers, whatever the
corpus holds. Within an epoch all waiting blocks are sorted once in ``STEP``
slots, of which only the first STEP can run before the next sort.

Rows are numbered per source and hash range, and the ranges are added up, so a
source with a third of all rows is spread over many tasks. Each row is joined to
the slot of its block, a key of ``block_rows`` rows.

Without ``weights`` a source weighs the square root of its row count. Weights may
be whole numbers, decimals, fractions or doubles; they are scaled to whole units,
without rounding where the units stay under ``MOST_UNITS``.

Cases: a null source is a source of its own; a source missing in ``weights`` or
with a weight of 0 or less runs after all others, these by row count. Null texts
are rows like others; empty tables give empty results. The order key is the hash
of the id, then the id, then the hash of the whole row (for null ids the latter
alone), so results depend on the partitioning only where rows are equal in all
columns, and such rows lie in one hash range. Columns of any name are kept.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._batches import packed, quoted
from .components import cut

BLOCK_ROWS = 32
#: Units of one source; with decimal(38) arithmetic this leaves room for 10 ** 17 blocks and 10 ** 5 sources.
MOST_UNITS = 10**15
#: Default weights are the square root of the row count, in units of this.
ROOT_UNITS = 1 << 20
#: Epochs times sources; slots of an epoch, at least; slots between two sorts of all waiting blocks.
HANDED, LEAST_EPOCH, STEP = 1 << 22, 4096, 32
#: Hash ranges a source: as many as keep one under ROWS_PER_RANGE rows, and no fewer than 2 ** LEAST_BITS.
ROWS_PER_RANGE, LEAST_BITS, MOST_BITS = 20_000, 7, 24

JOB = "struct<due:bigint,source:bigint,block:bigint>"
POINT = "struct<source:bigint,blocks:bigint,units:bigint,gone:bigint,live:decimal(20,0)>"


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def times(a: Column, b: Column) -> Column:
    """Exact product of two whole numbers of 20 and 17 digits at most."""
    return a.cast("decimal(20,0)") * b.cast("decimal(17,0)")


def over(a: Column, b: Column) -> Column:
    """floor(a / b) of exact whole numbers, 0 or more."""
    return F.call_function("div", a, b.cast("decimal(20,0)"))


def ceiling(a: Column, b: Column) -> Column:
    return F.when(a > 0, over(a - 1, b) + 1).otherwise(F.lit(0)).cast("bigint")


def first(low: Column, high: Column, steps: Column, holds) -> Column:
    """The first of the numbers low to high - 1 for which ``holds`` (false up to some number, true from there on), high if none; in ``steps`` halvings."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        return F.when(state["low"] >= state["high"], state).when(holds(middle), F.struct(state["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), state["high"].alias("high")))

    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")), halve, lambda s: s["low"])


def halvings(n: Column) -> Column:
    """Enough steps to search among n numbers."""
    return F.length(F.bin(n.cast("bigint"))) + 1


def whole_units(weights: dict) -> dict[str, int]:
    """Units in proportion to ``weights``: exact if that needs no more than MOST_UNITS for one source, else rounded to MOST_UNITS for the largest."""
    exact = {s: Fraction(w) for s, w in weights.items() if w is not None and w > 0}
    if not exact:
        return {}
    scale, top = Fraction(lcm(*(w.denominator for w in exact.values()))), max(exact.values())
    if top * scale > MOST_UNITS:
        scale = MOST_UNITS / top
    return {s: max(1, round(w * scale)) for s, w in exact.items()}


def sources_of(counts: DataFrame, weights: dict | None, block_rows: int) -> DataFrame:
    """``counts`` (has, name, rows), one row per source, with blocks, units, tier (1 for those without a weight) and source, its number within the tier."""
    if weights is None:
        units = F.greatest(F.round(F.sqrt("rows") * ROOT_UNITS), F.lit(1.0))
    else:
        given = whole_units(weights)
        units = F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col("name")) if given else F.lit(None)
        units = F.when(F.col("has") == 1, units)
    told = counts.withColumn("units", units.cast("bigint")).withColumn("tier", F.col("units").isNull().cast("int"))
    told = told.withColumn("units", F.coalesce("units", "rows")).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("bigint"))
    return told.withColumn("source", F.row_number().over(Window.partitionBy("tier").orderBy("has", "name")).cast("bigint"))


def plans(sources: DataFrame) -> DataFrame:
    """One row per tier: start (its first slot), size (its blocks), slots (of an epoch) and curve.

    curve has the sources by the virtual time blocks / units at which they run
    out, each with gone, the blocks of those before, and live, the units of it
    and of those after.
    """
    earlier = lambda x, y: times(x["blocks"], y["units"]) - times(y["blocks"], x["units"])
    order = lambda x, y: F.when(earlier(x, y) < 0, -1).when(earlier(x, y) > 0, 1).otherwise(F.signum(x["source"] - y["source"]).cast("int"))
    lists = sources.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "units")), order).alias("ends"), F.sum(F.col("units").cast("decimal(20,0)")).cast("decimal(20,0)").alias("live"), F.sum("blocks").alias("size"))
    begin = F.struct(F.lit(0).cast("bigint").alias("gone"), F.col("live").alias("live"), F.array().cast(f"array<{POINT}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        point = F.struct(x["source"].alias("source"), x["blocks"].alias("blocks"), x["units"].alias("units"), state["gone"].alias("gone"), state["live"].alias("live"))
        return F.struct((state["gone"] + x["blocks"]).alias("gone"), (state["live"] - x["units"]).cast("decimal(20,0)").alias("live"), F.concat(state["out"], F.array(point)).alias("out"))

    before = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)  # two rows at most
    slots = F.greatest(F.lit(LEAST_EPOCH), F.ceil(F.col("size") * F.size("ends") / HANDED)).cast("bigint")
    return lists.select("tier", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), "size", slots.alias("slots"), F.aggregate("ends", begin, step, lambda s: s["out"]).alias("curve"))


def jobs_of(curve: Column, start: Column, stop: Column) -> Column:
    """The blocks released in the slots from start to stop - 1, as sorted array of (release, due, source, block)."""
    n, steps = F.size(curve), halvings(F.size(curve))

    def when(source: Column, i: Column) -> Column:
        """gone, live and the exact product live * i at the virtual time i / units of ``source``."""
        k = first(F.lit(0), n - 1, steps, lambda k: times(source["units"], F.get(curve, k)["blocks"]) >= times(F.get(curve, k)["units"], i))
        return let(k, lambda k: let(F.get(curve, k), lambda p: F.struct(p["gone"].alias("gone"), times(p["live"], i).alias("done"))))

    def released(source: Column, i: Column) -> Column:
        return let(when(source, i), lambda w: w["gone"] + over(w["done"], source["units"]))

    def due(source: Column, i: Column) -> Column:
        return let(when(source, i + 1), lambda w: w["gone"] + ceiling(w["done"], source["units"]))

    def segment(slot: Column) -> Column:
        """The place of ``curve`` in force when ``slot`` begins."""
        return F.get(curve, first(F.lit(0), n - 1, steps, lambda k: let(F.get(curve, k), lambda p: times(p["live"], p["blocks"]) >= times(p["units"], slot - p["gone"]))))

    def from_slot(source: Column, slot: Column, at: Column) -> Column:
        """The first block of ``source`` released at ``slot`` or later."""
        return F.least(source["blocks"], F.when(slot <= at["gone"], F.lit(0)).otherwise(ceiling(times(source["units"], slot - at["gone"]), at["live"])))

    def of(source: Column, a: Column, b: Column) -> Column:
        def each(low: Column, high: Column) -> Column:
            job = lambda i: F.struct(released(source, i).alias("release"), due(source, i).alias("due"), source["source"].alias("source"), i.alias("block"))
            return F.when(high > low, F.transform(F.sequence(low, high - 1), job)).otherwise(F.array().cast("array<struct<release:bigint,due:bigint,source:bigint,block:bigint>>"))

        return let(F.struct(from_slot(source, start, a).alias("low"), from_slot(source, stop, b).alias("high")), lambda x: each(x["low"], x["high"]))

    return let(F.struct(segment(start).alias("a"), segment(stop).alias("b")), lambda x: F.sort_array(F.flatten(F.transform(curve, lambda s: of(s, x["a"], x["b"])))))


def run_epoch(jobs: Column, handed: Column, start: Column, stop: Column) -> Column:
    """Earliest deadline first over the slots from start to stop - 1: ``ran``, the block of each slot (null for none), and ``left``, the sorted blocks not run."""
    plain = lambda x: F.struct(x["due"].alias("due"), x["source"].alias("source"), x["block"].alias("block"))

    def slot(new: Column):
        def step(state: Column, t: Column) -> Column:
            arrived = F.filter(new, lambda x: x["release"] == t)
            ready = let(arrived, lambda more: F.when(F.size(more) == 0, state["ready"]).otherwise(F.sort_array(F.concat(state["ready"], F.transform(more, plain)))))
            return let(ready, lambda r: F.struct(F.slice(r, 2, F.size(r)).alias("ready"), F.concat(state["ran"], F.array(F.get(r, 0))).alias("ran")))

        return step

    def batch(state: Column, b: Column) -> Column:
        low = start + b * STEP
        high = F.least(low + STEP, stop)
        count = first(state["at"], F.size(jobs), halvings(F.size(jobs)), lambda k: F.get(jobs, k)["release"] >= high)

        def with_count(count: Column) -> Column:
            new = F.slice(jobs, state["at"] + 1, count - state["at"])
            begin = F.struct(F.slice(state["left"], 1, STEP).alias("ready"), F.array().cast(f"array<{JOB}>").alias("ran"))
            done = let(new, lambda new: F.aggregate(F.sequence(low, high - 1), begin, slot(new)))
            return let(done, lambda d: F.struct(count.alias("at"), F.sort_array(F.concat(d["ready"], F.slice(state["left"], STEP + 1, F.size(state["left"])))).alias("left"), F.concat(state["ran"], d["ran"]).alias("ran")))

        return let(count, with_count)

    begin = F.struct(F.lit(0).alias("at"), handed.alias("left"), F.array().cast(f"array<{JOB}>").alias("ran"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor((stop - start - 1) / STEP)), begin, batch)


def summary(done: Column, first_slot: Column, stop: Column) -> Column:
    """What the epochs behind must know of what an epoch runs by itself: room, ran (how many), risk (those that may have to give way) and left."""
    ran = lambda d: F.filter(d["ran"], lambda x: x.isNotNull())
    return let(done, lambda d: F.struct((stop - first_slot).alias("room"), F.size(ran(d)).alias("ran"), F.filter(ran(d), lambda x: x["due"] > stop).alias("risk"), d["left"].alias("left")))


def handed_over(alone: DataFrame) -> DataFrame:
    """tier, epoch and ``handed``, the sorted blocks that the epoch takes over, from ``summary`` of each epoch (tier, epoch, stop, alone)."""
    nothing = F.array().cast(f"array<{JOB}>")
    told = alone.select("tier", F.struct("epoch", "stop", "alone.*").alias("e"))

    def step(state: Column, e: Column) -> Column:
        pool = F.sort_array(F.concat(e["risk"], F.filter(state["now"], lambda x: x["due"] > e["stop"])))
        more = e["ran"] + F.size(state["now"]) - e["room"]
        then = let(F.struct(pool.alias("pool"), more.cast("int").alias("more")), lambda x: F.sort_array(F.concat(F.slice(x["pool"], F.size(x["pool"]) - x["more"] + 1, x["more"]), e["left"])))
        return F.struct(then.alias("now"), F.concat(state["out"], F.array(F.struct(e["epoch"].alias("epoch"), state["now"].alias("handed")))).alias("out"))

    begin = F.struct(nothing.alias("now"), F.array().cast(f"array<struct<epoch:bigint,handed:array<{JOB}>>>").alias("out"))
    lists = told.groupBy("tier").agg(F.sort_array(F.collect_list("e")).alias("e"))  # at most HANDED blocks
    return lists.select("tier", F.explode(F.aggregate("e", begin, step, lambda s: s["out"])).alias("x")).select("tier", "x.epoch", "x.handed")


def schedule(sources: DataFrame) -> DataFrame:
    """tier, source, block and slot of every block of ``sources`` (tier, source, blocks, units)."""
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    epochs = plans(sources).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / F.col("slots"))))).repartition(parts, "tier", "epoch")
    epochs = epochs.withColumn("first", F.col("epoch") * F.col("slots")).withColumn("stop", F.least(F.col("first") + F.col("slots"), F.col("size")))
    # Cut, so that both passes read one and the same blocks.
    epochs = cut(epochs.select("tier", "epoch", "start", "first", "stop", jobs_of(F.col("curve"), F.col("first"), F.col("stop")).alias("jobs")))
    alone = run_epoch(F.col("jobs"), F.array().cast(f"array<{JOB}>"), F.col("first"), F.col("stop"))
    handed = cut(handed_over(epochs.select("tier", "epoch", "stop", summary(alone, F.col("first"), F.col("stop")).alias("alone"))))
    ran = run_epoch(F.col("jobs"), F.col("handed"), F.col("first"), F.col("stop"))["ran"]
    told = epochs.join(handed, ["tier", "epoch"]).select("tier", (F.col("start") + F.col("first")).alias("base"), ran.alias("ran"))
    told = told.select("tier", "base", F.posexplode("ran").alias("at", "job"))
    return told.select("tier", "job.source", "job.block", (F.col("base") + F.col("at")).alias("slot"))


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None, block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """``row`` (the columns of ``docs``), block (number within the source), slot (place of the block in the mix) and place (in the block) of every row."""
    source, whole = F.col(quoted(source_col)).cast("string"), F.xxhash64(F.lit(seed), *(F.col(quoted(c)) for c in docs.columns))
    key = F.when(F.col(quoted(id_col)).isNull(), whole).otherwise(F.xxhash64(F.lit(seed), F.col(quoted(id_col))))
    rows = packed(docs, has=source.isNotNull().cast("int"), name=F.coalesce(source, F.lit("")), key=key, whole=whole)
    total = cut(rows.groupBy("has", "name").agg(F.count(F.lit(1)).alias("rows")))
    n = total.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    bits = max(LEAST_BITS, min(MOST_BITS, (max(int(n), 1) // ROWS_PER_RANGE).bit_length()))
    sources = cut(sources_of(total, weights, block_rows))
    # Ranges of the key, in the order of the signed key.
    rows = rows.withColumn("range", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int"))
    sizes = rows.groupBy("has", "name", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("has", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("has", "name", "range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    blocks = F.sequence(F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("n") - 1) / block_rows))
    offsets = offsets.select("has", "name", "range", "before", F.explode(blocks).alias("block"))
    slots = schedule(sources).join(sources.select("tier", "source", "has", "name"), ["tier", "source"])
    offsets = offsets.join(slots.select("has", "name", "block", "slot"), ["has", "name", "block"])
    # The slots of the blocks that a range touches: about ROWS_PER_RANGE / block_rows numbers.
    offsets = offsets.groupBy("has", "name", "range").agg(F.min("before").alias("before"), F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    within = Window.partitionBy("has", "name", "range").orderBy("key", F.col(f"row.{quoted(id_col)}"), "whole")
    placed = rows.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["has", "name", "range"])
    nth = F.col("nth") + F.col("before")
    placed = placed.withColumn("block", F.floor(nth / block_rows).cast("long")).withColumn("place", (nth % block_rows).cast("int"))
    return placed.select("row", "block", F.get("slots", (F.col("block") - F.col("slots")[0]["block"]).cast("int"))["slot"].alias("slot"), "place")


def mix_places(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """id, source, block, slot and row_in_block of every row."""
    thin = docs.select(F.col(quoted(id_col)), F.col(quoted(source_col)))
    return mixed(thin, source_col, id_col, **options).select("row.*", "block", "slot", F.col("place").alias("row_in_block"))


def in_mix_order(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", parts: int | None = None, **options) -> DataFrame:
    """``docs`` in the order of the mix, range partitioned, so that written files follow it."""
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed(docs, source_col, id_col, **options).repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")
