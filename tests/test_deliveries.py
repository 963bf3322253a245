import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators.deliveries import DeliveryVectors, block_number, first_deliveries, later_deliveries

SCHEMA = "delivery_no bigint, id string, received_at timestamp, `_metadata` string, note string"


def rows():
    t = lambda d: datetime(2010, 1, d)
    return [
        (1, "7", t(2), "x", "a"), (2, " 007\n", t(1), None, "b"), (3, "7", t(1), "y", "c"), (4, None, t(1), "z", None), (5, "-1", t(1), "z", None), (6, "-1", t(1), "z", None),
        (7, "8", None, "q", "d"), (8, "+8", t(9), "q", "e"), (9, "text", t(1), "q", "f"), (10, "text", t(1), "q", "g"), (11, "8", None, "q", "h"), (12, "", t(1), "", ""),
        (13, "123456789012345678901234567890", t(1), "", ""), (14, "0123456789012345678901234567890", t(2), "", ""),
    ]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_first_and_later(spark, tmp_path, limit):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    v = DeliveryVectors(spark.read.parquet(str(tmp_path / "t")), block_number(F.col("id")), ["received_at", "delivery_no"], limit)
    assert sorted(r[0] for r in v.rows(True, ["delivery_no"]).collect()) == [1, 3, 7, 11, 14]
    kept = v.rows(False)
    assert kept.columns == ["delivery_no", "id", "received_at", "_metadata", "note"]
    assert sorted(r[0] for r in kept.collect()) == [2, 4, 5, 6, 8, 9, 10, 12, 13]


def test_not_from_files_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r[0] for r in later_deliveries(df, columns=["delivery_no"]).collect()} == {1, 3, 7, 11, 14}
    empty = spark.createDataFrame([], SCHEMA)
    assert later_deliveries(empty).count() == 0 and first_deliveries(empty).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_against_brute_force_with_a_hot_key(spark, tmp_path, limit):
    rng = random.Random(3)
    data = [(i, "5" if rng.random() < 0.4 else str(rng.randrange(3000)), datetime(2010, 1, 1 + rng.randrange(20)), None, "n" * rng.randrange(50)) for i in range(80_000)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.option("maxRecordsPerFile", 50_000).parquet(str(tmp_path / "t"))
    best = {}
    for no, k, t, *_ in data:
        best[k] = min(best.get(k, (t, no)), (t, no))
    v = DeliveryVectors(spark.read.parquet(str(tmp_path / "t")), block_number(F.col("id")), ["received_at", "delivery_no"], limit)
    assert {r[0] for r in v.rows(False, ["delivery_no"]).collect()} == {no for _, no in best.values()}
    assert v.rows(True, ["delivery_no"]).count() == len(data) - len(best)
