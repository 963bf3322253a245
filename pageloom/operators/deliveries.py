"""Problem 1: messages delivered more than once.

Only (identifier, delivery order, file, row position) is shuffled, in one narrow scan. The winners'
positions become bitmaps for each file, and the wide rows are read once, without a shuffle, through
them: a row that names a message and is no winner is deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.session import materialised, shared_path

#: Vectors up to this many bytes in all are sent to every executor; beyond it each task reads those of its own files.
BROADCAST_BYTES = 64 << 20
_CHUNK_BYTES = 4096  # a bitmap for each 32,768 rows


def block_number(c: Column) -> Column:
    """Text of a whole number in one spelling (no space around, sign + or zeros in front); null for
    null, -1 and text that is no whole number. Any length of number is kept exactly."""
    t = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    n = F.regexp_replace(F.regexp_extract(t, r"^[+]?(-?[0-9]+)(?:\.0*)?$", 1), r"^(-?)0+(?=[0-9])", "$1")
    return F.when((n != "") & (n != "-1"), n)


def _positioned(df: DataFrame) -> tuple[DataFrame, Column]:
    """df as a scan of files, and its metadata column. Other frames are written to the shared folder first."""
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta.getField("row_index")).schema  # noqa: B018
    except AnalysisException:
        path = shared_path(df.sparkSession, "deliveries")
        df.write.parquet(path)
        df = df.sparkSession.read.parquet(path)
        meta = df.metadataColumn("_metadata")
    return df, meta


class DeliveryVectors:
    """Deletion vectors of one scan: the places of the first delivery of each message; of the rows that
    name a message all others are deleted."""

    def __init__(self, df: DataFrame, key: Column, order: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES):
        self.df, self._meta = _positioned(df)
        self.broadcast_bytes = broadcast_bytes
        self._keyed = key.isNotNull()
        self._file = F.xxhash64(self._meta.getField("file_path"))
        row = self._meta.getField("row_index") + F.lit(1)
        self._bucket, self._bit = F.bitmap_bucket_number(row), F.bitmap_bit_position(row)
        narrow = self.df.select(
            key.alias("k"),
            *[x for i, c in enumerate(order) for x in (F.col(f"`{c}`").isNull().alias(f"n{i}"), F.col(f"`{c}`").alias(f"o{i}"))],
            self._file.alias("file"), self._bucket.alias("bucket"), self._bit.alias("bit"),
        ).filter("k IS NOT NULL")
        # min() of a struct combines before the shuffle, so a key with a third of all rows is no hot spot
        first = F.min(F.struct(*[c for c in narrow.columns if c != "k"])).alias("w")
        kept = narrow.groupBy("k").agg(first).select("w.file", "w.bucket", "w.bit")
        self.vectors = materialised(kept.groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("kept")))

    def rows(self, deleted: bool, columns: Sequence[str] | None = None) -> DataFrame:
        """The deleted deliveries, or all other rows (first deliveries and rows that name no message)."""
        columns = list(columns or self.df.columns)
        wide = self.df.select(*[F.col(f"`{c}`") for c in columns], self._file.alias("__file"), self._bucket.alias("__bucket"), self._bit.alias("__bit"), self._keyed.alias("__keyed"))
        if self.vectors.count() * _CHUNK_BYTES <= self.broadcast_bytes:
            v = F.broadcast(self.vectors.select(F.col("file").alias("__file"), F.col("bucket").alias("__bucket"), F.col("kept").alias("__kept")))
            gone = F.col("__keyed") & ~F.coalesce(_bit(F.col("__kept"), F.col("__bit")), F.lit(False))
            out = wide.join(v, ["__file", "__bucket"], "left").filter(gone if deleted else ~gone)
        else:
            out = self._by_file(wide, deleted)
        return out.select(*[F.col(f"`{c}`") for c in columns])

    def _by_file(self, wide: DataFrame, deleted: bool) -> DataFrame:
        """Each task loads only the vectors of the files it reads, from the shared folder."""
        path = shared_path(self.df.sparkSession, "vectors")
        self.vectors.repartition("file").write.partitionBy("file").parquet(path)

        def apply(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc
            import pyarrow.parquet as pq
            from pyarrow import fs

            uri = path.replace("s3a://", "s3://", 1)  # the same store under Arrow's name
            store, root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
            cache: dict = {}

            def vectors(file: int) -> dict:
                if file not in cache:
                    cache.clear()  # a task reads one file after another
                    found: dict = {}
                    at = f"{root}/file={file}"
                    if store.get_file_info(at).type != fs.FileType.NotFound:
                        for f in store.get_file_info(fs.FileSelector(at)):
                            if f.path.endswith(".parquet"):
                                t = pq.read_table(store.open_input_file(f.path), columns=["bucket", "kept"])
                                for b, x in zip(t["bucket"].to_pylist(), t["kept"].to_pylist()):
                                    found[b] = np.frombuffer(x, np.uint8)
                    cache[file] = found
                return cache[file]

            for b in batches:
                file, bucket, bit, keyed = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__file", "__bucket", "__bit", "__keyed"))
                kept = np.zeros(b.num_rows, bool)
                for f in np.unique(file):
                    for k in np.unique(bucket[file == f]):
                        v = vectors(int(f)).get(int(k))
                        if v is not None:
                            at = np.flatnonzero((file == f) & (bucket == k))
                            kept[at] = (v[bit[at] >> 3] >> (bit[at] & 7)) & 1
                gone = keyed.astype(bool) & ~kept
                yield b.filter(pa.array(gone if deleted else ~gone))

        return wide.mapInArrow(apply, wide.schema)


def _bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1


def first_deliveries(df: DataFrame, id_col: str = "id", order: Sequence[str] = ("received_at", "delivery_no"), columns: Sequence[str] | None = None) -> DataFrame:
    """Exactly one row of each message, the first by ``order`` (nulls last, then the place in the
    files), with all columns unless ``columns`` is given. Rows that name no message (null, -1, no
    number) are kept: none of them repeats another. An empty table gives no rows."""
    return DeliveryVectors(df, block_number(F.col(f"`{id_col}`")), order).rows(False, columns)


def later_deliveries(df: DataFrame, id_col: str = "id", order: Sequence[str] = ("received_at", "delivery_no"), columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that ``first_deliveries`` leaves out."""
    return DeliveryVectors(df, block_number(F.col(f"`{id_col}`")), order).rows(True, columns)
