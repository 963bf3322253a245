"""Streams of changes: repeated events, time windows, and state by key over time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F


def without_repeats(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each event once while its key is within the watermark; the state is bounded by it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, ts: str, by: str, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Edits of a user with less than ``gap`` between them."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))


def recent(stream: DataFrame, ts: str, now, delay_minutes: int = 60, block_minutes: int = 10) -> DataFrame:
    """Changes between now - delay - block and now - delay; now is a column or a timestamp."""
    n = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    return stream.filter((F.col(ts) >= n - F.expr(f"INTERVAL {delay_minutes + block_minutes} MINUTES")) & (F.col(ts) < n - F.expr(f"INTERVAL {delay_minutes} MINUTES")))


DEAD_LINKS = "url string, first_seen timestamp, last_seen timestamp, sightings int, report boolean"
_STATE = "first long, last long, n int"


def dead_links(stream: DataFrame, url: str = "url", ts: str = "ts", ok: str = "ok", min_gap: int = 3600, report_days: float = 7) -> DataFrame:
    """History of dead links: a failure counts if more than ``min_gap`` seconds after the last that
    counted; a success clears it; a link is reported that has been dead for ``report_days``. State is
    three numbers a URL."""

    def update(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        first, last, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values(ts)
        for at, good in zip(rows[ts].astype("datetime64[us]").astype("int64") // 1_000_000, rows[ok]):
            if good:
                first, last, n = None, None, 0
            elif first is None:
                first, last, n = int(at), int(at), 1
            elif at - last > min_gap:
                last, n = int(at), n + 1
        if first is None:
            if state.exists:
                state.remove()
            return
        state.update((first, last, n))
        yield pd.DataFrame({"url": [key[0]], "first_seen": [pd.Timestamp(first, unit="s")], "last_seen": [pd.Timestamp(last, unit="s")], "sightings": [n], "report": [last - first > report_days * 86400]})

    return stream.groupBy(url).applyInPandasWithState(update, DEAD_LINKS, _STATE, "update", "NoTimeout")


def inserted_span(old: str, new: str) -> tuple[int, int]:
    """(begin, end) in ``new`` of what changed: after the common beginning, before the common end."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    z = 0
    while z < min(len(old), len(new)) - a and old[-1 - z] == new[-1 - z]:
        z += 1
    return a, len(new) - z
