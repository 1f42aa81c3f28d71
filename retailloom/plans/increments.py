"""The load by increments: batches of raw lines, in any order, give the table of one load.

A folder holds what a load must remember:

* ``events``  the lines that passed the value rules, each once, and the cancellations, by batch and month;
* ``keys``    per batch, one row for each match key it changed: sales, cancellations, least slack, how many
  sales are consumed, last event. The newest row of a key counts;
* ``netted``  per batch, the lines that a return took from the table (+1) or gave back (-1);
* ``counts``  per batch, what the value rules dropped;
* ``sales``   the table, by month.

A batch reads the old events only of the months of its own lines, to find lines that were there before,
and of the keys whose matches change. For a key whose new events are all later than its last, the row
in ``keys`` tells how many sales the new returns consume; only if that is more than before, or if events come
late, are the key's events read and matched anew. (A return may consume a sale of any age, and
a late sale may take the place of another, which then is given back.) At last the months of new,
netted and restored lines are written anew from their events; all others stay as they are.

Batches pile up; ``compact`` makes one of them all, from time to time.

Every step is stored before the next, and a step that is there is not done again. So a batch
that was cut short is applied again under its number, as Structured Streaming does, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.operators import cleaning, returns
from retailloom.schema import MATCH_KEY, RAW, RAW_COLUMNS, SALE_MONTH
from retailloom.session import materialise, remove
from retailloom.sources import warehouse

LINES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW)
KEYS = ", ".join(f"{c} {RAW[c].dataType.simpleString()}" for c in MATCH_KEY)
STATE = "sales bigint, cancels bigint, slack bigint, last timestamp_ntz, consumed bigint"
STORED = {
    "events": f"{LINES}, kind int, units bigint, batch bigint, {SALE_MONTH} date",
    "keys": f"{KEYS}, {STATE}, batch bigint",
    "netted": f"{LINES}, change int, batch bigint, {SALE_MONTH} date",
    "counts": "rows_in bigint, cancelled bigint, non_positive_qty bigint, non_positive_price bigint,"
    " valid bigint, batch bigint",
}


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def _names(spark: SparkSession, path: str) -> list[str]:
    system, where = _place(spark, path)
    return [e.getPath().getName() for e in system.listStatus(where)] if system.exists(where) else []


def _batches(spark: SparkSession, folder: str, part: str) -> list[int]:
    """Numbers of the batches whose ``part`` is complete."""
    names = _names(spark, f"{folder}/{part}")
    numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return sorted(n for n in numbers if _exists(spark, f"{folder}/{part}/batch={n}/_SUCCESS"))


def _read(spark: SparkSession, folder: str, part: str, upto: int) -> DataFrame:
    """What the batches up to a number have stored."""
    if not _batches(spark, folder, part):
        return spark.createDataFrame([], STORED[part])
    return spark.read.schema(STORED[part]).parquet(f"{folder}/{part}").where(F.col("batch") <= upto)


def _store(rows: DataFrame, folder: str, part: str, batch: int) -> None:
    _write(rows, part, f"{folder}/{part}/batch={batch}")


def _write(rows: DataFrame, part: str, path: str) -> None:
    columns = [c.split()[0] for c in STORED[part].split(", ") if c != "batch bigint"]
    by_month = SALE_MONTH in columns
    if by_month:
        rows = rows.withColumn(SALE_MONTH, _month()).hint("rebalance", SALE_MONTH)
    writer = rows.select(*columns).write.mode("overwrite")
    (writer.partitionBy(SALE_MONTH) if by_month else writer).parquet(path)


def _month() -> Column:
    return F.trunc(F.to_date("InvoiceDate"), "month")


def _in_months(months: list) -> Column:
    """Months by name, so that the others are never opened. One may be missing."""
    named = F.col(SALE_MONTH).isin(*[F.lit(m) for m in months if m is not None])
    return named | F.col(SALE_MONTH).isNull() if None in months else named


def _months_of(rows: DataFrame) -> list:
    """A few hundred at most."""
    return [r[0] for r in rows.select(_month()).distinct().collect()]


def _same_line(other: DataFrame) -> DataFrame:
    return other.select(cleaning.whole_line())


def _arrived(raw: DataFrame, folder: str, batch: int) -> None:
    """Store the lines of a batch that are new, and its cancellations."""
    spark = raw.sparkSession
    lines = cleaning.distinct_lines(cleaning.valid_lines(raw))
    before = _read(spark, folder, "events", batch - 1).where(
        (F.col("kind") == returns.SALE) & _in_months(_months_of(cleaning.valid_lines(raw)))
    )
    new = lines.join(_same_line(before), "line", "left_anti").select("line.*")
    sales = new.withColumns({"kind": F.lit(returns.SALE), "units": F.lit(1).cast("bigint")})
    cancels = returns.cancel_batches(cleaning.cancellations(raw)).withColumn("kind", F.lit(returns.CANCEL))
    _store(sales.unionByName(cancels, allowMissingColumns=True), folder, "events", batch)


def _timeline(events: DataFrame) -> DataFrame:
    """Events as the match wants them."""
    sales = events.where(F.col("kind") == returns.SALE).select(*RAW_COLUMNS)
    cancels = events.where(F.col("kind") == returns.CANCEL).groupBy(
        *MATCH_KEY, "InvoiceDate", "Invoice"
    ).agg(F.sum("units").alias("units"))
    return returns.timeline(sales, cancels)


def _matchable(events: DataFrame) -> DataFrame:
    return events.dropna(subset=[*MATCH_KEY, "InvoiceDate"])


def _latest_states(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    columns = [c.split()[0] for c in STATE.split(", ")]
    newest = F.max_by(F.struct(*columns), "batch").alias("state")
    return _read(spark, folder, "keys", batch).groupBy(*MATCH_KEY).agg(newest)


def _rematched(folder: str, batch: int, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The states that a batch changes, and the keys whose matches change with it."""
    mine = _matchable(_read(spark, folder, "events", batch).where(F.col("batch") == batch))
    cancelled = F.count_if(F.col("kind") == returns.CANCEL)
    touched = mine.groupBy(*MATCH_KEY).agg(F.min("InvoiceDate").alias("first"), cancelled.alias("own_cancels"))
    known = touched.join(_latest_states(spark, folder, batch - 1), MATCH_KEY, "left")
    # A key without any return needs no state.
    known = materialise(
        known.where(F.col("state").isNotNull() | (F.col("own_cancels") > 0)).withColumn(
            "in_order", F.coalesce(F.col("first") > F.col("state.last"), F.lit(False))
        ),
        "touched-keys",
    )
    later = known.where("in_order").select(*MATCH_KEY, "state")
    # Stored keys on one side and a scan on the other: a hot key can be split.
    added = returns.key_states(_timeline(mine.join(later.select(*MATCH_KEY), MATCH_KEY, "left_semi")))
    slack = F.least("state.slack", F.col("state.sales") - F.col("state.cancels") + F.col("slack"))
    moved = (
        added.join(later, MATCH_KEY)
        .withColumns(
            {
                "sales": F.col("state.sales") + F.col("sales"),
                "cancels": F.col("state.cancels") + F.col("cancels"),
                "slack": slack,
            }
        )
        .withColumn("consumed", returns.consumed(F.col("cancels"), F.col("slack")))
    )
    moved = materialise(moved.withColumn("more", F.col("consumed") > F.col("state.consumed")), "moved-states")
    late = known.where("not in_order").select(*MATCH_KEY)
    return moved, materialise(late.unionByName(moved.where("more").select(*MATCH_KEY)), "rematched-keys")


def _matched(folder: str, batch: int, spark: SparkSession) -> None:
    """Store how a batch changes the matches."""
    moved, keys = _rematched(folder, batch, spark)
    events = _matchable(_read(spark, folder, "events", batch)).join(keys, MATCH_KEY, "left_semi")
    timeline = _timeline(events)
    now = returns.netted_sales(timeline).select(*RAW_COLUMNS)
    before = _netted(spark, folder, batch - 1).join(keys, MATCH_KEY, "left_semi").select(*RAW_COLUMNS)
    changes = now.withColumn("change", F.lit(1)).unionByName(before.withColumn("change", F.lit(-1)))
    changes = changes.groupBy(cleaning.whole_line()).agg(F.sum("change").cast("int").alias("change"))
    changes = changes.where("change <> 0").select("line.*", "change")
    _store(changes, folder, "netted", batch)
    kept = moved.where("not more").select(*MATCH_KEY, *[c.split()[0] for c in STATE.split(", ")])
    _store(kept.unionByName(returns.key_states(timeline).select(*kept.columns)), folder, "keys", batch)


def _netted(spark: SparkSession, folder: str, batch: int, months: list | None = None) -> DataFrame:
    """The lines that returns have taken, as of a batch."""
    rows = _read(spark, folder, "netted", batch)
    if months is not None:
        rows = rows.where(_in_months(months))
    totals = rows.groupBy(cleaning.whole_line()).agg(F.sum("change").alias("n"))
    return totals.where("n > 0").select("line.*")


def _open_lines(events: DataFrame, netted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events that no return took: those that a bitmap of the netted lines rules out at once, as they lie in
    their files, and what is left of the few others, which alone are shuffled to meet the netted lines."""
    lines, count = _same_line(events), netted.count()
    beyond = returns.by_bitmap(lines, netted, ["line"], count, "left_anti")
    maybe = returns.by_bitmap(lines, netted, ["line"], count)
    # Spark would take an anti join ahead of the bitmap, and shuffle every line for it.
    met = maybe.join(netted.withColumn("taken", F.lit(True)), "line", "left")
    return beyond.select("line.*"), met.where("taken IS NULL").select("line.*")


def _lines_by_month(lines: DataFrame) -> dict:
    """A few hundred at most."""
    return {r[0]: r[1] for r in lines.groupBy(_month()).agg(F.count(F.lit(1))).collect()}


def _restated(folder: str, batch: int, spark: SparkSession) -> list:
    """Write the months anew that a batch has changed, and only these."""
    mine = F.col("batch") == batch
    lines = _read(spark, folder, "events", batch).where(mine & (F.col("kind") == returns.SALE))
    changed = _read(spark, folder, "netted", batch).where(mine)
    months = sorted(
        set(_months_of(lines)) | set(_months_of(changed)), key=lambda m: (m is not None, m)
    )
    if not months:
        return []
    events = _read(spark, folder, "events", batch).where(
        (F.col("kind") == returns.SALE) & _in_months(months)
    )
    netted = materialise(_same_line(_netted(spark, folder, batch, months)), "netted-lines")
    open_, left = _open_lines(events, netted)
    warehouse.restate_months(left, f"{folder}/sales", by_month=open_)
    # Each line is there once and a netted line is one of them, so the numbers tell which months have none left.
    stored, gone = _lines_by_month(events), _lines_by_month(netted.select("line.*"))
    empty = {m for m in months if stored.get(m, 0) == gone.get(m, 0)}
    names = ["__HIVE_DEFAULT_PARTITION__" if m is None else m.isoformat() for m in empty]
    remove(spark, [f"{folder}/sales/{SALE_MONTH}={name}" for name in names])
    return months


def apply(raw: DataFrame, folder: str, batch: int | None = None) -> list:
    """Add a batch of raw lines to the load in ``folder`` and return the months written anew.

    Batches are numbered from 0 and applied one after another. A number that was applied before is only
    finished where it was cut short: then ``raw`` must be what it was.
    """
    spark = raw.sparkSession
    _finish_compaction(spark, folder)
    done = _batches(spark, folder, "counts")
    batch = (done[-1] + 1 if done else 0) if batch is None else batch
    if done and batch < done[-1]:
        return []
    if batch not in _batches(spark, folder, "events"):
        _arrived(raw, folder, batch)
    if batch not in _batches(spark, folder, "keys"):
        _matched(folder, batch, spark)
    months = _restated(folder, batch, spark)
    if batch not in done:
        counts = raw.agg(*cleaning.line_counts(cleaning.is_valid(), F.lit(1)))
        _store(counts, folder, "counts", batch)
    return months


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.read_sales(spark, f"{folder}/sales")


def report(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaning report over all batches."""
    last = _batches(spark, folder, "counts")[-1]
    counts = _read(spark, folder, "counts", last).drop("batch")
    totals = counts.agg(*[F.sum(c).alias(c) for c in counts.columns]).first().asDict()
    matched = _read(spark, folder, "netted", last).agg(F.coalesce(F.sum("change"), F.lit(0)).alias("n"))
    stored = sales(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("CustomerID").isNull()).alias("nulls")
    )
    return cleaning.observed_report(totals, matched.first().n, stored.first().asDict(), spark)


READY = "READY"


def compact(spark: SparkSession, folder: str) -> None:
    """Make one batch of all that were applied, under the number of the last.

    The new files are complete before an old one goes. A compaction that was cut short is finished by the next
    batch or compaction; no other may run meanwhile.
    """
    _finish_compaction(spark, folder)
    done = _batches(spark, folder, "counts")
    if len(done) < 2:
        return
    last, staged = done[-1], f"{folder}/compacted-{done[-1]}"
    remove(spark, [staged])
    states = _latest_states(spark, folder, last)
    counts = _read(spark, folder, "counts", last).drop("batch")
    merged = {
        "events": _read(spark, folder, "events", last),
        "keys": states.select(*MATCH_KEY, "state.*"),
        "netted": _netted(spark, folder, last).withColumn("change", F.lit(1)),
        "counts": counts.agg(*[F.sum(c).cast("bigint").alias(c) for c in counts.columns]),
    }
    for part, rows in merged.items():
        _write(rows, part, f"{staged}/{part}")
    system, where = _place(spark, f"{staged}/{READY}")
    system.create(where).close()
    _finish_compaction(spark, folder)


def _finish_compaction(spark: SparkSession, folder: str) -> None:
    """Put staged parts in the place of the batches they were made of, each once."""
    for name in _names(spark, folder):
        staged = f"{folder}/{name}"
        if not name.startswith("compacted-") or not _exists(spark, f"{staged}/{READY}"):
            continue
        last = int(name.removeprefix("compacted-"))
        for part in STORED:
            if _exists(spark, f"{staged}/{part}"):
                old = [n for n in _names(spark, f"{folder}/{part}") if n.startswith("batch=")]
                old = [n for n in old if int(n.removeprefix("batch=")) <= last]
                remove(spark, [f"{folder}/{part}/{n}" for n in old])
                _rename(spark, f"{staged}/{part}", f"{folder}/{part}/batch={last}")
        remove(spark, [staged])


def _rename(spark: SparkSession, old: str, new: str) -> None:
    system, where = _place(spark, old)
    if not system.rename(where, _place(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def stream(raw: DataFrame, folder: str, checkpoint: str, **trigger):
    """Apply a stream of raw lines batch by batch. ``raw`` is a streaming DataFrame; without a trigger
    everything that is there is taken, and the query ends."""
    return (
        raw.writeStream.foreachBatch(lambda rows, number: apply(rows, folder, number) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
