import random

import pytest

from pageloom.llm.catalogue import TOKENIZER
from pageloom.llm.packing import SumOfSquares, capacities_of, faults, fill_report, pack, token_counts


def naive(capacity, sizes):
    """The same rule by trying every level."""
    n, out, numbers, made = [0] * (capacity + 1), [], {h: [] for h in range(capacity + 1)}, 0
    for s in sizes:
        best = None
        for h in range(capacity - s, -1, -1):
            if h and not n[h]:
                continue
            m = list(n)
            m[h] -= h > 0
            if h + s < capacity:
                m[h + s] += 1
            cost = sum(x * x for x in m[1:capacity])
            if best is None or cost < best[0]:
                best = (cost, h)
        h = best[1]
        if h:
            number = numbers[h].pop()
            n[h] -= 1
        else:
            number, made = made, made + 1
        if h + s < capacity:
            n[h + s] += 1
            numbers[h + s].append(number)
        out.append(number)
    return out


def test_rule():
    rng = random.Random(2)
    for capacity in (1, 7, 20):
        sizes = [rng.randrange(1, capacity + 1) for _ in range(300)]
        p = SumOfSquares(capacity)
        assert [p.place(s) for s in sizes] == naive(capacity, sizes)


@pytest.mark.parametrize("stream", [100_000, 150])
def test_pack(spark, stream):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, None, 1, 3, 9, 10, 11, 25, 60])) for i in range(1000)] + [(5, 7), (5, 7)]
    out = pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), {"a": 10, "b": 50}, stream_items=stream).toPandas()
    for kind, cap in (("a", 10), ("b", 50)):
        k = out[out.container_kind == kind]
        assert k.groupby("doc_id").n_tokens.sum().to_dict() == {i: sum(n or 0 for j, n in rows if j == i) for i in {r[0] for r in rows}}
        full = k[k.container_id.notna()].groupby("container_id").n_tokens.sum()
        assert full.max() <= cap
        assert full.sum() / (len(full) * cap) > 0.95
        split = k[(k.piece > 0)].doc_id.unique()
        sizes = dict(rows)
        assert all(sizes[d] > cap for d in split if d != 5)
        assert set(k[k.container_id.isna()].doc_id) == {i for i, n in rows if not n}
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), {"a": 10}).count() == 0


def test_tokens_and_report(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x y " * 20_000)], "doc_id bigint, text string")
    n = {r.doc_id: r.n_tokens for r in token_counts(docs, "doc_id", "text", TOKENIZER).collect()}
    assert n[1] == 2 and n[2] == 0 and n[3] == 0 and n[4] >= 20_000
    caps = capacities_of(spark.createDataFrame([("a", 10), (None, 3)], "container_kind string, capacity int"))
    assert caps == {"a": 10}
    r = fill_report(pack(spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "doc_id bigint, n_tokens bigint"), caps), caps).first()
    assert (r.containers, r.tokens, r.used) == (2, 14, 0.7)


def test_streams_are_even_whatever_the_ids(spark):
    """Null and repeated ids of one size are spread over streams, and each is packed."""
    df = spark.createDataFrame([(None, 3)] * 900 + [(7, 3)] * 300, "doc_id bigint, n_tokens bigint")
    out = pack(df, {"a": 10}, stream_items=100, merge_items=50)
    got = out.groupBy("container_id").sum("n_tokens").toPandas()["sum(n_tokens)"]
    assert got.max() <= 10 and got.sum() == 3600 and len(got) <= 440
    assert faults(out.filter("doc_id IS NULL"), df.filter("doc_id IS NULL"), {"a": 10}).count() == 0  # a null id names no document


def test_a_large_capacity_costs_no_time():
    import time

    rng = random.Random(3)
    sizes = [min(131_072, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    p = SumOfSquares(131_072)
    began = time.perf_counter()
    for x in sizes:
        p.place(x)
    assert (time.perf_counter() - began) / len(sizes) < 60e-6
