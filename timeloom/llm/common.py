"""Small helpers shared by the training-data operators: scratch tables and Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that part words: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"

_OWN_DIR: dict[str, str] = {}
#: Folders of the tables that ``saved`` wrote and nobody has deleted yet, in order.
_WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode only: on a
    cluster the executors would each write a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="spark-scratch-"))
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost no recompute."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def saved_in_buckets(df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
    """Like ``saved``, in ``buckets`` parts by the hash of ``keys``, each sorted by them: what joins such tables on the
    keys under ``bucket_order`` neither moves nor sorts them. ``df`` has to hold a bucket in one task at most."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{table}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _WRITTEN.append(path)
    out = spark.table(table)
    out.scratch_path, out.scratch_table = path, table
    return out


@contextmanager
def bucket_order(spark: SparkSession):
    """Plans made inside rely on the order in the files of ``saved_in_buckets``."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(table: DataFrame) -> None:
    """Delete a saved table that nothing reads any more."""
    if hasattr(table, "scratch_table"):
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.scratch_table}")
    _delete(table.sparkSession, table.scratch_path)
    _WRITTEN.remove(table.scratch_path)


def scratch_mark() -> int:
    """A point to which ``clear_scratch`` goes back."""
    return len(_WRITTEN)


def clear_scratch(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables saved since ``mark``, but ``keep``. To be called once results that rest on them are written."""
    kept = getattr(keep, "scratch_path", None)
    for path in _WRITTEN[mark:]:
        if path != kept:
            _delete(spark, path)
    _WRITTEN[mark:] = [path for path in _WRITTEN[mark:] if path == kept]


def row_key(id_col: Column, text: Column) -> Column:
    """A second key beside the id, so that rows that repeat an id stay apart when their texts differ."""
    return F.xxhash64(id_col, text)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, carry: bool = False, text_in_row: bool = True) -> DataFrame:
    """(doc_id, rk, text): only the columns the operators need, null text as empty; ``carry`` adds row, a struct of all
    columns, or of all but the text, which need not travel twice then."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = ["*"] if text_in_row else [F.col(f"`{c}`") for c in docs.columns if c.lower() != text_col.lower()]
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(F.col(id_col), text).alias("rk"),
        text.alias("text"),
        *([F.struct(*row).alias("row")] if carry else []),
    )


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    return (left["rk"] == right["rk"]) & left["doc_id"].eqNullSafe(right["doc_id"])


#: Bits of the map behind ``may_be_among``, 2 MB: bounds what is broadcast, not results.
BITS = 1 << 24


def may_be_among(rows: DataFrame, keys: DataFrame, key: str = "rk") -> DataFrame:
    """Rows with maybe: false where no row of ``keys`` has the row's ``key`` (a long that is a hash), so that such rows need
    not travel to be joined; true for all others and, by chance, for some more. A map of BITS bits is broadcast."""
    place = F.pmod(F.col(key), F.lit(BITS)) + 1  # from 1 on, as Spark numbers the bits of its bitmaps
    bits = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bit_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bit_map"))
    rows = rows.withColumns({"bit_bucket": F.bitmap_bucket_number(place), "bit_at": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.expr("substring(bit_map, cast(bit_at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, F.col("bit_at").cast("int") % 8) == 1, F.lit(False))
    return rows.join(F.broadcast(bits), "bit_bucket", "left").withColumn("maybe", found).drop("bit_bucket", "bit_map", "bit_at")


def replaced(df: DataFrame, row_type, changes: dict) -> DataFrame:
    """The columns that ``row`` carried, with those in ``changes`` given anew."""
    return df.select(*[changes[f.name].alias(f.name) if f.name in changes else F.col(f"row.`{f.name}`").alias(f.name) for f in row_type.fields])


def utf8_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array, end to end, and the offsets (n + 1) of each text in them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    if pa.types.is_large_string(array.type):
        offsets = np.frombuffer(array.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(array.buffers()[1], np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches, limit: int = 4 << 20):
    """The rows of Arrow batches in slices of about ``limit`` bytes, and one row at least: bounds what a worker holds
    beside the batch itself."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
