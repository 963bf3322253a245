"""Problem 6: filling fixed-capacity containers.

Sum-of-squares online packing: a stream keeps the number of open containers at each fill level, and
each item goes to the level (or a new container) that makes the sum of the squares of those numbers
smallest, which keeps the levels balanced and lets them be closed exactly. Streams of items are
packed in parallel; the containers that a stream leaves open are merged by one more round of
packing, in which an open container is an item of its fill level, fullest first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.session import materialised

#: Items of one stream. A stream of one kind of container is one task, which holds the number of open
#: containers at each of the kind's fill levels.
STREAM_ITEMS = 20_000
#: Open containers of one stream of the merging round.
MERGE_ITEMS = 20_000


class SumOfSquares:
    """Packs a stream of sizes into containers of one capacity. Only the levels that hold open
    containers are looked at, so a large capacity costs no time."""

    def __init__(self, capacity: int, last: bool = False):
        """``last``: nothing comes after these items, so no level is kept open for later ones and each
        item goes to the fullest container that it fits."""
        self.capacity, self.last = capacity, last
        self.open = np.zeros(capacity + 1, np.int64)  # open[h]: open containers filled to h
        self.levels = np.zeros(64, np.int64)  # the n levels h > 0 with open containers, in order
        self.n = 0
        self.at: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of 1 to ``capacity``."""
        c = self.capacity
        # moving one container from h to h + size changes the sum of squares by
        # 2 (open[h+size] - open[h] + 1); beginning a new one or filling one changes only one end
        best, cost = 0, 2 * int(self.open[size]) + 1 if size < c else 0
        fit = self.levels[: np.searchsorted(self.levels[: self.n], c - size, side="right")]
        if self.last:
            best = int(fit[-1]) if len(fit) else 0
        elif len(fit):
            costs = 2 * (self.open[fit + size] - self.open[fit]) + 2
            if fit[-1] == c - size:
                costs[-1] = 1 - 2 * self.open[c - size]
            k = len(costs) - 1 - int(costs[::-1].argmin())  # the fullest of equal levels
            if costs[k] <= cost:
                best = int(fit[k])
        if best == 0:
            number = self.made
            self.made += 1
        else:
            number = self.at[best].pop()
            self.open[best] -= 1
            if not self.open[best]:
                i = int(np.searchsorted(self.levels[: self.n], best))
                self.levels[i : self.n - 1] = self.levels[i + 1 : self.n]
                self.n -= 1
        h = best + size
        if h < c:
            if not self.open[h]:
                if self.n == len(self.levels):
                    self.levels = np.concatenate([self.levels, np.zeros_like(self.levels)])
                i = int(np.searchsorted(self.levels[: self.n], h))
                self.levels[i + 1 : self.n + 1] = self.levels[i : self.n].copy()
                self.levels[i] = h
                self.n += 1
            self.at.setdefault(h, []).append(number)
            self.open[h] += 1
        return number

    def left_open(self):
        """(number, fill) of the containers that are not full."""
        return [(n, h) for h, numbers in sorted(self.at.items()) for n in numbers]


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens) in tokens of the byte-level BPE whose ranks are in the file ``tokenizer``
    (present on every executor). Null and empty texts have 0 tokens."""

    def count(batches):
        import pyarrow as pa

        from pageloom.llm.packing import _encoder

        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "doc_id bigint, n_tokens bigint")


_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


_COLUMNS = ["container_kind", "stream", "number", "doc_id", "piece", "start", "n_tokens"]
_ITEMS = "container_kind string, stream int, number bigint, doc_id bigint, piece int, start bigint, n_tokens bigint"


def _pack_items(batches):
    """A task: the items of one stream of one kind."""
    import pandas as pd

    packer = None
    for b in batches:
        if not len(b):
            continue
        kind, stream = b["container_kind"].iloc[0], int(b["stream"].iloc[0])
        packer = packer or SumOfSquares(int(b["capacity"].iloc[0]))
        c, out = packer.capacity, []
        for doc, n in zip(b["doc_id"].astype("object").where(b["doc_id"].notna(), None), b["n_tokens"].tolist()):
            piece, start = 0, 0
            while n - start > c:  # only a text longer than the capacity is split
                out.append((doc, piece, start, c, packer.made))
                packer.made += 1
                piece, start = piece + 1, start + c
            if n > start:
                out.append((doc, piece, start, n - start, packer.place(n - start)))
        done = pd.DataFrame(out, columns=["doc_id", "piece", "start", "n_tokens", "number"]).assign(container_kind=kind, stream=stream)
        yield done.astype({"doc_id": "Int64"})[_COLUMNS]


def _merge(batches):
    import pandas as pd

    packer = None
    for b in batches:
        if not len(b):
            continue
        packer = packer or SumOfSquares(int(b["capacity"].iloc[0]), last=True)
        numbers = [packer.place(int(f)) for f in b["fill"]]
        yield b[["container_kind", "stream", "number", "to_stream"]].assign(to_number=numbers)


def pack(sizes: DataFrame, capacities: dict[str, int], stream_items: int = STREAM_ITEMS, merge_items: int = MERGE_ITEMS) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start, n_tokens): for each kind every document's
    tokens, each in one container; no container is over its capacity; only documents longer than the
    capacity are split, into full containers and one rest.

    ``sizes`` (doc_id, n_tokens). Each stream of each kind is a task of its own; rows are spread over
    the streams evenly whatever their ids are. Documents of 0 (or null) tokens need no place and come
    out with a null container. Repeated rows and null ids are packed as often as they come. Only
    (id, size) is shuffled."""
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be at least 1")
    sizes = materialised(sizes.withColumn("__row", F.monotonically_increasing_id()))  # texts are tokenised once; a repeated task sees the same streams
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("no"), F.lit(c).cast("bigint").alias("capacity")) for i, (k, c) in enumerate(capacities.items())])).alias("k")
    streams = max(1, -(-sizes.count() // stream_items))
    mixed = F.xxhash64("doc_id", "n_tokens", "__row")  # a mixed but fixed order
    full = sizes.filter("n_tokens > 0").select("doc_id", "n_tokens", F.pmod(mixed, F.lit(streams)).cast("int").alias("stream"), mixed.alias("mixed"), kinds)
    full = full.select("doc_id", "n_tokens", "stream", "mixed", F.col("k.kind").alias("container_kind"), F.col("k.no").alias("no"), F.col("k.capacity").alias("capacity"))
    tasks = streams * len(capacities)
    placed = full.repartitionById(tasks, F.col("no") * streams + F.col("stream")).sortWithinPartitions("mixed").mapInPandas(_pack_items, _ITEMS)
    placed = materialised(placed)
    # the containers that streams leave open are merged, the fullest first
    caps = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(c).cast("bigint"))])
    numbers = F.create_map(*[x for i, k in enumerate(capacities) for x in (F.lit(k), F.lit(i))])
    fills = placed.groupBy("container_kind", "stream", "number").agg(F.sum("n_tokens").alias("fill"))
    opened = materialised(fills.withColumns({"capacity": caps[F.col("container_kind")], "no": numbers[F.col("container_kind")]}).filter("fill < capacity"))
    groups = max(1, -(-opened.count() // merge_items))
    opened = opened.withColumn("to_stream", F.pmod(F.xxhash64("stream", "number"), F.lit(groups)).cast("int"))
    moved = opened.repartitionById(groups * len(capacities), F.col("no") * groups + F.col("to_stream")).sortWithinPartitions(F.desc("fill"), "stream", "number").mapInPandas(
        _merge, "container_kind string, stream int, number bigint, to_stream int, to_number bigint"
    )
    out = placed.join(moved, ["container_kind", "stream", "number"], "left").select(
        "container_kind",
        F.when(F.col("to_number").isNull(), F.concat_ws("-", F.lit("0"), "stream", "number")).otherwise(F.concat_ws("-", F.lit("1"), "to_stream", "to_number")).alias("container_id"),
        "doc_id", "piece", "start", "n_tokens",
    )
    every = F.explode(F.array(*[F.lit(k) for k in capacities]))
    none = sizes.filter("coalesce(n_tokens, 0) <= 0").select(every.alias("container_kind"), F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_tokens"))
    return out.unionByName(none)


def faults(packed: DataFrame, sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Of each kind the documents, the containers over capacity, the documents of which not every
    token has one place, and the documents split without need; the last three are 0 in a right packing."""
    caps = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(c).cast("bigint"))])
    over = packed.filter("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("fill"))
    over = over.groupBy("container_kind").agg(F.count_if(F.col("fill") > caps[F.col("container_kind")]).alias("over_full"))
    want = sizes.groupBy("doc_id").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("want"), F.max("n_tokens").alias("longest"))
    got = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("got"), F.max("piece").alias("pieces"), F.max(F.col("start") + F.col("n_tokens")).alias("stop"))
    per = got.join(want, "doc_id").groupBy("container_kind").agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("got") != F.col("want")) | (F.col("stop") != F.coalesce("longest", F.lit(0)))).alias("misplaced"),
        F.count_if((F.col("pieces") > 0) & (F.col("longest") <= caps[F.col("container_kind")])).alias("split_without_need"),
    )
    return per.join(over, "container_kind", "left")


def capacities_of(containers: DataFrame, kind: str = "container_kind", capacity: str = "capacity") -> dict[str, int]:
    """The table of kinds; a fixed short list."""
    rows = containers.select(kind, capacity).filter(f"`{kind}` IS NOT NULL AND `{capacity}` IS NOT NULL").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 kinds of container")
    return {r[0]: r[1] for r in sorted(rows)}


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Of each kind the number of containers, their tokens, and the share of the room that is used."""
    caps = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(c))])
    per = packed.filter("container_id IS NOT NULL").groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * caps[F.col("container_kind")]), 6))


def token_sizes(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return token_counts(docs, "doc_id", "text", tokenizer)
