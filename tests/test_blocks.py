from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from pageloom.operators import blocks
from pageloom.plans import wiki

# time, expiry, and what they are as instants, worked out by hand
ROWS = [
    ("2009-01-02T00:00:00Z", "2009-01-04T00:00:00Z", (2009, 1, 2), (2009, 1, 4)),
    ("2009-01-02T01:00:00+01:00", "Sun, 04 Jan 2009 02:00:00 +0200", (2009, 1, 2), (2009, 1, 4)),
    ("1230854400", "Jan 4, 2009 12:00:00 AM", (2009, 1, 2), (2009, 1, 4)),
    ("20090102000000", "infinity", (2009, 1, 2), None),
    ("2008-12-31 19:30:00", "2009", (2009, 1, 1, 0, 30), None),
    ("2010-01-01T00:30:00+01:00", "unknown", (2009, 12, 31, 23, 30), None),
    ("2009-02-30T00:00:00Z", "2009-03-01T00:00:00Z", None, (2009, 3, 1)),
    (None, None, None, None),
]


def test_all_forms_of_time(spark, tmp_path):
    zones = ["Europe/London"] * 4 + ["America/New_York"] + ["Europe/London"] * 3
    rows = [(i, z, f"by{i % 2}", "u", "1", None, None, t, e) for i, ((t, e, _, _), z) in enumerate(zip(ROWS, zones))]
    spark.createDataFrame(rows, "delivery_no bigint, site string, by_name string, user_name string, userid string, rangestart string, rangeend string, timestamp string, expiry string").write.parquet(str(tmp_path / "apispec.parquet"))
    spark.createDataFrame([(z, z) for z in set(zones)], "site string, tz string").write.parquet(str(tmp_path / "wiki_site.parquet"))
    when = lambda x: x and datetime(*x, tzinfo=UTC)
    times = [(i, when(t), when(e)) for i, (_, _, t, e) in enumerate(ROWS)]

    got = {r.delivery_no: r.days for r in wiki.block_durations_all_forms(spark, str(tmp_path)).collect()}
    assert got == {i: (e - t).days for i, t, e in times if t and e} and len(got) == 3
    got = {r.by_name: r.blocks for r in wiki.blocks_between_all_forms(spark, str(tmp_path)).collect()}
    inside = [i for i, t, _ in times if t and datetime(2009, 1, 1, tzinfo=UTC) <= t <= datetime(2010, 1, 1, tzinfo=UTC)]
    assert got == {f"by{k}": sum(i % 2 == k for i in inside) for k in (0, 1)} and len(inside) == 6
    (r,) = wiki.block_lists_all_forms(spark, str(tmp_path)).collect()
    assert (r.kind, r.blocks, r.endless, r.finite) == ("user", 8, 1, 5)
    timed = wiki._timed_blocks(spark, str(tmp_path), ends="expiry")
    assert sorted(x.delivery_no for x in blocks.finite(timed, F.col("ends")).collect()) == [0, 1, 2, 4, 6]
    assert [x.delivery_no for x in blocks.expiring(timed, F.col("ends"), after="2009-02-01").collect()] == [6]


def test_days_of_the_tables(spark, sf):
    """Against the library's clock, for the forms that Python reads by itself."""
    zone = {r.site: r.tz for r in spark.read.parquet(f"{sf}/wiki_site.parquet").collect()}

    def read(text, site):
        try:
            t = datetime.fromisoformat(text)
        except (TypeError, ValueError):
            return None
        if len(text) < 16 or ":" not in text or not (t.tzinfo or zone.get(site)):
            return None
        at = (t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone[site]))).astimezone(UTC)
        exists = t.tzinfo or at.astimezone(ZoneInfo(zone[site])).replace(tzinfo=None) == t  # else in the gap of a clock change
        return at.replace(microsecond=0) if exists else None

    rows = spark.read.parquet(f"{sf}/apispec.parquet").select("delivery_no", "site", "timestamp", "expiry").collect()
    got = {r.delivery_no: r.days for r in wiki.block_durations_all_forms(spark, sf).collect()}
    plain = {r.delivery_no: r.days for r in wiki.block_durations(spark, sf).collect()}
    want = {r.delivery_no: (e - t).days for r in rows if (t := read(r.timestamp, r.site)) and (e := read(r.expiry, r.site))}
    assert len(got) > len(plain) and plain.items() <= got.items()
    assert len(want) > len(plain) and want.items() <= got.items()
