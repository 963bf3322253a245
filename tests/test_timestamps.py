import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest

from pageloom.functions.zones import zone_table, zone_tables
from pageloom.operators.timestamps import convert, day_text, normalised_instants

ZONES = ["Europe/Amsterdam", "America/New_York", "Asia/Kolkata", "Europe/London"]
CASES = [
    ("2008-01-03T04:30:26+01:00", None, "2008-01-03T03:30:26"), ("00:00, 15 June 2013 (CEST)", "Europe/Amsterdam", "2013-06-14T22:00:00"), ("20080101215325", "America/New_York", "2008-01-01T21:53:25"),
    ("2008-01-01 20:06:44", "America/New_York", "2008-01-02T01:06:44"), ("1199167987", None, "2008-01-01T06:13:07"), ("1199248530866", None, "2008-01-02T04:35:30"), ("24 décembre 2013 10:12:42", "Europe/Amsterdam", "2013-12-24T09:12:42"),
    ("24 décembre 2013 10:12:42", "Europe/Amsterdam", "2013-12-24T09:12:42"), ("Apr 11, 2010 12:51:49 PM", "Europe/London", "2010-04-11T11:51:49"), ("Apr 11, 2010 12:51:49 AM", "Europe/London", "2010-04-10T23:51:49"),
    ("2012-10-30T08:36:40.55-03:30", None, "2012-10-30T12:06:40"), ("2010-10-31 02:30:00", "Europe/Amsterdam", "2010-10-31T00:30:00"), ("2010-03-28 02:30:00", "Europe/Amsterdam", None), ("2010-03-28 02:30 ", "Asia/Kolkata", "2010-03-27T21:00:00"),
    ("12:00, 1 May 2010 (BST)", "Europe/London", "2010-05-01T11:00:00"), ("12:00, 1 May 2010 (XYZ)", "Europe/London", None), ("2010-02-30T10:00:00Z", None, None), ("2010-07-05", "Europe/London", None), ("infinity", None, None),
    ("", None, None), (None, "Europe/London", None), ("2010-01-01 25:00", "Europe/London", None), ("2010-01-01 10:00", None, None), ("\t2008-01-21T19:11:38Z\n", None, "2008-01-21T19:11:38"), ("A 9", None, None),
    ("2150-07-01 12:00", "Europe/Amsterdam", "2150-07-01T10:00:00"), ("2150-01-01 12:00", "Europe/Amsterdam", "2150-01-01T11:00:00"), ("3999-07-01 12:00", "Europe/Amsterdam", "3999-07-01T10:00:00"),
    ("2010-07-01T10:00:00." + "0" * 2000 + "Z", None, "2010-07-01T10:00:00"), ("2010-W01-1T10:00:00Z", None, "2010-01-04T10:00:00"), ("2009-W53-7T10:00:00Z", None, "2010-01-03T10:00:00"), ("2010-W53-1T10:00:00Z", None, None), ("2012-366T10:00Z", None, "2012-12-31T10:00:00"), ("2011-366T10:00Z", None, None),
    ("1 " * 100_000, None, None), ("２００８-01-01T00:00:00Z", None, "2008-01-01T00:00:00"), ("x" * 100_000 + "9", None, None),
]


@pytest.mark.parametrize("text,zone,want", CASES)
def test_instants(text, zone, want):
    v, ok = convert(pa.array([text], pa.string()), pa.array([zone], pa.string()), zone_tables(ZONES))
    assert (str(np.datetime64(int(v[0]), "s")) if ok[0] else None) == want


@pytest.mark.parametrize(
    "text,want",
    [("10 APRIL 1987", "1987-04-10"), ("dinsdag 10 april 1979", "1979-04-10"), ("00-00-1971", None), ("10 apr. 1972", "1972-04-10"), ("[10 april 1973]", "1973-04-10"), ("[10 april 1973", None), ("ca. 1971", None), ("10-11 april 1972", None),
     ("10/1/1984", "1984-01-10"), ("10/13/1984", None), ("April 11, 1992", "1992-04-11"), ("19710229", None), ("19720229", "1972-02-29"), ("23 mei 1981, 7.00 uur", "1981-05-23"), ("1971-02-22T00:00:00Z", "1971-02-22"), (None, None), ("1971", None)],
)
def test_days(text, want):
    v, ok = convert(pa.array([text], pa.string()), None, {}, days=True)
    assert (str(np.datetime64(int(v[0]), "D")) if ok[0] else None) == want


@pytest.mark.parametrize("zone", ZONES)
def test_zone_table_against_the_library(zone):
    t, tz, rng = zone_table(zone), ZoneInfo(zone), random.Random(1)
    for _ in range(3000):
        wall = datetime(1950, 1, 1) + timedelta(seconds=rng.randrange(int(timedelta(days=365 * 900).total_seconds())))
        instants = {wall.replace(tzinfo=tz, fold=f).astimezone(UTC) for f in (0, 1)}
        real = sorted(i for i in instants if i.astimezone(tz).replace(tzinfo=None) == wall)
        got, ok, twice = t.to_utc(np.array([int(wall.replace(tzinfo=UTC).timestamp())]))
        assert bool(ok[0]) == bool(real) and bool(twice[0]) == (len(real) == 2)
        if real:
            assert int(got[0]) == int(real[0].timestamp())


def test_status_and_fractions(spark):
    from pageloom.operators.timestamps import parsed_instants

    sites = spark.createDataFrame([("s", "Europe/London")], "site string, tz string")
    texts = ["2010-07-01T10:00:00.1234567Z", "1199248530866", "2010-10-31 01:30", "2010-03-28 01:30", "2010-13-01 10:00", "soon", None, "2010-07-01 10:00 (QQQ)", "2010-07-01T10:00:00,5+01:00"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "i int, site string, value string")
    rows = parsed_instants(df, df["value"], df["site"], sites).selectExpr("i", "date_format(parsed.at, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS at", "parsed.status AS status").orderBy("i").collect()
    assert [(r.at, r.status) for r in rows] == [
        ("2010-07-01 10:00:00.123456", "parsed"), ("2008-01-02 04:35:30.866000", "parsed"), ("2010-10-31 00:30:00.000000", "ambiguous"), (None, "does not exist"), (None, "does not exist"),
        (None, "unknown form"), (None, None), (None, "no zone"), ("2010-07-01 09:00:00.500000", "parsed"),
    ]


def test_columns(spark):
    sites = spark.createDataFrame([("s", "Europe/London"), ("n", None), (None, "Asia/Kolkata")], "site string, tz string")
    df = spark.createDataFrame([("s", "2010-07-01 10:00", 1), ("s", "2010-07-01T10:00:00Z", 2), ("n", "2010-07-01 10:00", 3), (None, "1199167987", 4), ("?", None, 5)], "site string, value string, tz int")
    got = {r.tz: r.norm for r in normalised_instants(df, df["value"], df["site"], sites).collect()}
    assert got == {1: "2010-07-01T09:00:00Z", 2: "2010-07-01T10:00:00Z", 3: None, 4: "2008-01-01T06:13:07Z", 5: None}
    other = normalised_instants(df, df["value"], df["site"], sites, only_other_forms=True)
    assert sorted(r.tz for r in other.collect()) == [1, 3, 4]
    assert df.limit(0).select(day_text("value")).count() == 0
