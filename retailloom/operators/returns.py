"""First-in-first-out match of returns to the sales they reverse.

For each key (customer, product, quantity) the cancellations are taken in time
order. Each consumes the earliest sale not yet consumed, if that sale is dated on or
before it, and otherwise consumes nothing.

Closed form. After J cancellations, with S sales dated so far, the number consumed is

    p = J + min(0, smallest (S - J) at any cancellation up to here)

so running sums and a running minimum replace the queue. Sales with an ordinal up to
the final p are netted out.

One key may hold a large part of all rows, so no window spans a whole key. The events
are range-partitioned by key and time; a key that does not fit one range continues in
the next, and ``block`` numbers the ranges. Windows run inside (key, block). Nearly every key lies in one
block and is done then; the blocks of the others, at most two keys a block, are chained through one summary row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailloom.functions.expressions import pct
from retailloom.schema import MATCH_KEY, PACKED, RAW_COLUMNS
from retailloom.session import materialise

SALE, CANCEL = 0, 1

# Sales before cancellations at the same instant; the rest is a total order, so the
# outcome does not depend on the partitioning.
EVENT_ORDER = ["InvoiceDate", "kind", "Invoice", "Description", "Price", "Country"]

# Longest array built when a batch of returns is spread over its ordinals.
SPREAD = 100_000

# Keys from which sales are tried against a bitmap first, bits a key, and the most buckets of 32,768 bits (4 KB).
MANY_KEYS, BITS, BUCKETS = 1 << 20, 8, 1 << 14


def _order():
    return [F.col(c).asc_nulls_last() for c in EVENT_ORDER]


def cancel_batches(cancelled: DataFrame) -> DataFrame:
    """Cancellations that can match, with equal ones counted together.

    Nothing matches through a missing key or date.
    """
    return (
        cancelled.withColumn("Quantity", F.abs("Quantity"))
        .dropna(subset=[*MATCH_KEY, "InvoiceDate"])
        .groupBy(*MATCH_KEY, "InvoiceDate", "Invoice")
        .agg(F.count(F.lit(1)).alias("units"))
    )


def candidate_sales(valid: DataFrame, cancels: DataFrame) -> DataFrame:
    """Sales whose key occurs among the cancellations; all others pass by untouched.

    The keys are stored first. Small ones are then broadcast by their real size; large ones
    meet the sales shuffle to shuffle, a shape in which adaptive execution splits a hot key.
    (A join whose side ends in an aggregation is never split.) Before that shuffle a bitmap of the
    hashed keys drops most sales of other keys; what it lets through by chance the join drops.
    """
    keys = materialise(cancels.select(*MATCH_KEY).distinct(), "returns-keys")
    dated, count = valid.dropna(subset=["InvoiceDate"]), keys.count()
    if count < MANY_KEYS:
        return dated.join(keys, MATCH_KEY, "left_semi")
    # Keys are distinct, so this is the same join; Spark would take a semi join ahead of the bitmap.
    return _maybe_among(dated, keys, count).join(keys, MATCH_KEY)


def _maybe_among(sales: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The sales whose hashed key has its bit set: all with a key among ``keys``, and a few others."""
    return by_bitmap(sales.dropna(subset=MATCH_KEY), keys, MATCH_KEY, count)


def by_bitmap(rows: DataFrame, keys: DataFrame, on: list[str], count: int, how: str = "inner") -> DataFrame:
    """The rows whose hashed key has its bit set among those of the ``count`` keys, or by ``left_anti`` the
    others, none of which has its key there. No row is shuffled."""
    buckets = min(BUCKETS, count * BITS // 32768 + 1)
    place = F.pmod(F.xxhash64(*on), F.lit(buckets * 32768)) + 1  # positions count from 1
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    placed = rows.withColumns(
        {"own_bucket": F.bitmap_bucket_number(place), "position": F.bitmap_bit_position(place)}
    )
    byte = F.conv(F.hex(F.expr("substring(bits, cast(position div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("position") % 8).cast("int")) == 1
    # At most 64 MB, whatever the keys.
    there = (F.col("own_bucket") == F.col("bucket")) & is_set
    return placed.join(F.broadcast(bits), there, how).select(*rows.columns)


def timeline(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """Sales and cancellations in order, cut into blocks, stored.

    Stored because every later step must see the same blocks.
    """
    events = sales.select(
        *RAW_COLUMNS, F.lit(SALE).alias("kind"), F.lit(1).cast("bigint").alias("units")
    ).unionByName(cancels.withColumn("kind", F.lit(CANCEL)), allowMissingColumns=True)
    blocks = events.repartitionByRange(
        *[F.col(c) for c in MATCH_KEY], *_order()
    ).withColumn("block", F.spark_partition_id())
    return materialise(blocks, "returns-timeline", **PACKED)


def _running(events: DataFrame) -> DataFrame:
    """Sums and the smallest slack inside each (key, block)."""
    upto = Window.partitionBy(*MATCH_KEY, "block").orderBy(*_order())
    here = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_cancel = F.col("kind") == CANCEL
    units = F.col("units")
    return events.select(
        "*",
        F.sum(F.when(is_cancel, 0).otherwise(units)).over(here).alias("s"),
        F.sum(F.when(is_cancel, units).otherwise(0)).over(here).alias("j"),
    ).withColumn("slack", F.when(is_cancel, F.col("s") - F.col("j")))


def _chained(running: DataFrame) -> DataFrame:
    """One row per (key, block): what came before it, and the key's final count."""
    summary = running.groupBy(*MATCH_KEY, "block").agg(
        F.max("s").alias("s"), F.max("j").alias("j"), F.min("slack").alias("slack")
    )
    blocks = Window.partitionBy(*MATCH_KEY).orderBy("block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*MATCH_KEY)
    return (
        summary.select(
            "*",
            F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
            F.coalesce(F.sum("j").over(before), F.lit(0)).alias("j0"),
        )
        .withColumn("slack", F.col("s0") - F.col("j0") + F.col("slack"))
        .select(
            *MATCH_KEY,
            "block",
            "s0",
            "j0",
            F.least(F.lit(0), F.min("slack").over(before)).alias("slack0"),
            (F.sum("j").over(whole) + F.least(F.lit(0), F.min("slack").over(whole))).alias(
                "consumed"
            ),
        )
    )


def _crossing(events: DataFrame) -> DataFrame:
    """The keys that lie in more than one block. Blocks are ranges of keys, so such a key is the first or the
    last of each of its blocks. Stored, so that it is broadcast by its real size."""
    key = F.struct(*MATCH_KEY)
    ends = events.groupBy("block").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    keys = ends.select("block", F.explode(F.array("low", "high")).alias("key")).distinct()
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    return materialise(several.select("key.*"), "crossing-keys")


def _parted(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events of keys that lie in one block, and of the others."""
    crossing = _crossing(events)
    return events.join(crossing, MATCH_KEY, "left_anti"), events.join(crossing, MATCH_KEY, "left_semi")


def _placed(events: DataFrame) -> DataFrame:
    single, several = _parted(events)
    whole = Window.partitionBy(*MATCH_KEY, "block")
    nothing = F.lit(0).cast("bigint")
    single = _running(single).select(
        "*",
        *[nothing.alias(c) for c in ("s0", "j0", "slack0")],
        consumed(F.max("j").over(whole), F.min("slack").over(whole)).alias("consumed"),
    )
    running = _running(several)
    return single.unionByName(running.join(_chained(running), [*MATCH_KEY, "block"]))


def _sales_in_queue(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("kind") == SALE).withColumn("ordinal", F.col("s0") + F.col("s"))


def key_states(events: DataFrame) -> DataFrame:
    """One row per key: its sales and cancellations so far, the least slack at any cancellation, how many
    sales are consumed, and the time of its last event. Later events need no more than this row to
    tell how many they consume."""
    blocks = _running(events).groupBy(*MATCH_KEY, "block").agg(
        F.max("s").alias("s"), F.max("j").alias("j"), F.min("slack").alias("slack"),
        F.max("InvoiceDate").alias("last"),
    )
    before = Window.partitionBy(*MATCH_KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("s") - F.col("j")).over(before), F.lit(0))
    totals = blocks.withColumn("slack", offset + F.col("slack")).groupBy(*MATCH_KEY).agg(
        F.sum("s").alias("sales"), F.sum("j").alias("cancels"), F.min("slack").alias("slack"),
        F.max("last").alias("last"),
    )
    return totals.withColumn("consumed", consumed(F.col("cancels"), F.col("slack")))


def consumed(cancels: Column, slack: Column) -> Column:
    """The closed form, from totals. Without a cancellation there is no slack."""
    return cancels + F.least(F.lit(0), F.coalesce(slack, F.lit(0)))


def netted_sales(events: DataFrame) -> DataFrame:
    """The sales that a return reverses: the first ``consumed`` of their key."""
    return (
        _sales_in_queue(_placed(events))
        .where(F.col("ordinal") <= F.col("consumed"))
        .select(*RAW_COLUMNS)
    )


def matched_count(events: DataFrame) -> DataFrame:
    """Number of sales netted out, as one row."""
    single, several = _parted(events)
    in_one = _running(single).groupBy(*MATCH_KEY, "block").agg(
        consumed(F.max("j"), F.min("slack")).alias("n")
    )
    chained = _chained(_running(several)).groupBy(*MATCH_KEY).agg(F.max("consumed").alias("n"))
    per_key = in_one.select("n").unionByName(chained.select("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("matched"))


def pairs(events: DataFrame) -> DataFrame:
    """Each matched cancellation with the sale it reverses."""
    placed = _placed(events)
    here = (
        Window.partitionBy(*MATCH_KEY, "block")
        .orderBy(*_order())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("s0") - F.col("j0")

    def consumed_after(j, slack):
        return F.col("j0") + j + F.least(F.col("slack0"), offset + slack)

    j_before, slack_before = F.col("j") - F.col("units"), F.min("slack").over(earlier)
    batches = (
        placed.withColumn("first", consumed_after(j_before, slack_before))
        .withColumn("last", consumed_after(F.col("j"), F.min("slack").over(here)))
        .where((F.col("kind") == CANCEL) & (F.col("last") > F.col("first")))
    )
    # Ordinals first+1..last, spread in two steps so that no array grows with the batch.
    step = F.lit(SPREAD).cast("bigint")
    starts = F.sequence(F.col("first") + 1, F.col("last"), step)
    run = F.sequence(F.col("start"), F.least(F.col("start") + step - 1, F.col("last")))
    ordinals = batches.withColumn("start", F.explode(starts)).withColumn("ordinal", F.explode(run))
    cancels = ordinals.select(
        *MATCH_KEY,
        "ordinal",
        F.col("Invoice").alias("cancel_invoice"),
        F.col("InvoiceDate").alias("cancel_date"),
    )
    sales = (
        _sales_in_queue(placed)
        .where(F.col("ordinal") <= F.col("consumed"))
        .select(
            *MATCH_KEY,
            "ordinal",
            F.col("Invoice").alias("sale_invoice"),
            F.col("InvoiceDate").alias("sale_date"),
        )
    )
    return cancels.join(sales, [*MATCH_KEY, "ordinal"]).drop("ordinal")


def match_rate(matches: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Matched returns against the cancellations that carry a customer."""
    counts = cancelled.agg(F.count("CustomerID").alias("cancels_with_customer"))
    return counts.select(
        matched_count(matches).scalar().alias("matched"), "cancels_with_customer"
    ).withColumn(
        "match_rate_pct", pct(F.col("matched"), F.col("cancels_with_customer"), 1)
    )
