import random
from collections import defaultdict
from datetime import datetime, timedelta

from pageloom.operators import history
from pageloom.plans import wiki


def by_rule(rows):
    """The reference's rule, one sighting after the other."""
    times = defaultdict(list)
    for k, t in rows:
        if k is not None and t is not None:
            times[k].append(t)
    out = {}
    for k, ts in times.items():
        last, n = None, 0
        for t in sorted(ts):
            if last is None or t - last > timedelta(hours=1):
                last, n = t, n + 1
        out[k] = (min(ts), max(ts), n, max(ts) - min(ts) > timedelta(days=7))
    return out


def test_sightings_by_the_rule(spark):
    rng, t0 = random.Random(1), datetime(2024, 1, 1, 10, 59)
    rows = [("a", t0), ("a", t0 + timedelta(minutes=2)), ("b", t0), ("b", t0 + timedelta(hours=1)), ("c", t0), ("c", t0 + timedelta(hours=1, microseconds=1)), ("n", None), (None, t0)]
    rows += [(f"k{rng.randrange(5)}", t0 + timedelta(seconds=rng.randrange(20 * 86400))) for _ in range(3000)] + [("hot", t0 + timedelta(seconds=7 * i)) for i in range(25_000)]
    rng.shuffle(rows)
    got = {r.k: (r.first_seen, r.last_seen, r.sightings, r.report) for r in history.counted_sightings(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts").collect()}
    assert got == by_rule(rows) and (got["a"][2], got["b"][2], got["c"][2]) == (1, 1, 2)
    assert history.counted_sightings(spark.createDataFrame([], "k string, ts timestamp"), "k", "ts").count() == 0


def test_dead_link_sightings(spark, sf):
    want = by_rule((r.page, r.ts) for r in wiki._sightings(spark, sf).collect())
    got = {r.page: (r.sightings, r.report) for r in wiki.dead_link_sightings(spark, sf).collect()}
    assert got == {k: v[2:] for k, v in want.items()}
