"""Revisions of pages: histories, previous revisions, creators, editors, contributions, sightings.

A page may hold a third of all revisions. Windows over pages therefore run over ranges of equal size;
what passes from range to range is one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.session import materialised


def distinct_revisions(revisions: DataFrame) -> DataFrame:
    """One row of each revision: the one fetched first (all else of a revision is the same or late)."""
    rest = [c for c in revisions.columns if c not in ("revid", "fetched_at")]
    return revisions.groupBy("revid").agg(F.min(F.struct(F.col("fetched_at").isNull().alias("n"), "fetched_at", *rest)).alias("r")).select("revid", "r.fetched_at", *[f"r.{c}" for c in rest])


def previous_value(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str) -> DataFrame:
    """df with ``value`` of the key's row before (by time, nulls first, then ``tie``) in column ``out``;
    null for a key's first row and for rows with a null key.

    Rows are cut into ranges of (key, time, tie) of like size, whatever the keys are; what passes from a
    range to the next is its last row."""
    order = [F.asc_nulls_first(c) for c in (key, ts, tie)]
    rows = materialised(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    rows = rows.withColumns({"__prev": F.lag(F.struct(F.col(key).alias("k"), F.col(value).alias("x"))).over(inside), "__first": F.row_number().over(inside) == 1})
    last = F.max(F.struct(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(tie).alias("i"), F.col(value).alias("x"))).alias("e")
    ends = rows.groupBy("__part").agg(last)  # as many rows as shuffle partitions
    ends = ends.select("__part", F.lag(F.struct("e.k", "e.x")).over(Window.orderBy("__part")).alias("__before"))
    p = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev"))
    return rows.join(F.broadcast(ends), "__part").withColumn(out, F.when(p["k"] == F.col(key), p["x"])).drop("__part", "__prev", "__first", "__before")


def previous_revision(revisions: DataFrame, page: str = "pageid", ts: str = "timestamp", rev: str = "revid") -> DataFrame:
    """revisions with previous_<rev> (null for a page's first). Ties of time go by number; rows with a
    null page have none."""
    return previous_value(revisions.withColumn("__value", F.col(rev)), page, ts, rev, "__value", f"previous_{rev}").drop("__value")


def creators(revisions: DataFrame) -> DataFrame:
    """First revision's user and time of each page, and the latest's, and how many there are."""
    first, last = F.min(F.struct("timestamp", "revid", "user_name")), F.max(F.struct("timestamp", "revid", "user_name"))
    g = revisions.filter("pageid IS NOT NULL AND pageid <> 0 AND timestamp IS NOT NULL").groupBy("pageid").agg(first.alias("f"), last.alias("l"), F.count("*").alias("revisions"))
    return g.select("pageid", F.col("f.user_name").alias("creator"), F.col("f.timestamp").alias("created"), F.col("f.revid").alias("first_revid"), F.col("l.user_name").alias("last_editor"), F.col("l.revid").alias("last_revid"), "revisions")


def editors(revisions: DataFrame) -> DataFrame:
    """Distinct editors of each page with their edits."""
    return revisions.filter("user_name IS NOT NULL").groupBy("pageid", "user_name").agg(F.count("*").alias("edits"))


def revert_targets(revisions: DataFrame, user: str) -> DataFrame:
    """For each edit of a user that is still the top one: the revision just before it."""
    return previous_revision(revisions).filter((F.col("user_name") == user) & F.col("top")).select("pageid", "revid", F.col("previous_revid"))


def first_and_last_seen(sightings: DataFrame, key: str, ts: str, min_gap: int = 3600, report_days: float = 7) -> DataFrame:
    """Of each key the first and last sighting, the number of slots of ``min_gap`` seconds by the clock
    that hold one, and whether it is due to be reported. Two sightings either side of the hour are two
    slots; ``counted_sightings`` counts as the dead-link history does."""
    pieces = sightings.withColumn("__slot", F.floor(F.unix_timestamp(ts) / min_gap))
    g = pieces.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.countDistinct("__slot").alias("slots"))
    return g.withColumn("report", (F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) > report_days * 86400)


def counted_sightings(sightings: DataFrame, key: str, ts: str, min_gap: int = 3600, report_days: float = 7) -> DataFrame:
    """Batch form of the dead-link history: of each key the first and last sighting, the number of
    sightings that count (the first, and each more than ``min_gap`` seconds after the last that
    counted), and whether it is due to be reported. Rows run through in order of time, a batch at a
    time, with only the key's state passed on; rows without a key or time are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, state = min_gap * 1_000_000, None  # key, first, last, last counted, count
        row = lambda s: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((s[0], s[1], s[2], s[4]), kinds)], names=names)
        for batch in batches:
            keys, times = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            names, kinds = ["__key", "__first", "__last", "sightings"], [keys.type, pa.int64(), pa.int64(), pa.int64()]
            ends = pc.run_end_encode(keys)
            begin = 0
            for k, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                t = times[begin:end]
                if state is None or state[0] != k:
                    if state is not None:
                        yield row(state)
                    state = [k, int(t[0]), 0, int(t[0]) - gap - 1, 0]
                state[2] = int(t[-1])
                at = int(np.searchsorted(t, state[3] + gap, "right"))
                while at < len(t):
                    state[3], state[4] = int(t[at]), state[4] + 1
                    at = int(np.searchsorted(t, state[3] + gap, "right"))
                begin = end
        if state is not None:
            yield row(state)

    kind = sightings.schema[key].dataType.simpleString()
    rows = sightings.select(F.col(key).alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__t")).filter("__key IS NOT NULL AND __t IS NOT NULL")
    g = rows.repartition("__key").sortWithinPartitions("__key", "__t").mapInArrow(run, f"__key {kind}, __first bigint, __last bigint, sightings bigint")
    seen = g.select(F.col("__key").alias(key), F.timestamp_micros("__first").alias("first_seen"), F.timestamp_micros("__last").alias("last_seen"), "sightings")
    return seen.withColumn("report", (F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) > report_days * 86400)


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*")
