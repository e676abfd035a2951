"""What the operators share: words, folds, the shared folder and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these bytes; bytes.split() without arguments cuts at just these.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; one is made only where none is set in a local session, as in
    tests. On a cluster that is an error: no folder of one machine is there for the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the driver ends."""
    if not _written:
        atexit.register(drop_stored)
    _written.append((spark, path := f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}-{name}"))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Deletes what store() wrote, by Hadoop's file system, so that any shared store will do."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            return


_holder: list = []


def hold(name: str, clear: Callable[[], None]) -> None:
    """Says that this worker now keeps words looked up for the operator `name`; what it kept for another is let go, so that a
    worker that serves several operators one after the other holds the words of one."""
    if _holder and _holder[0] != name:
        _holder[1]()
    _holder[:] = [name, clear]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], most: int = 8_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: make() runs once a task, and what it returns once for each slice of up to 256 rows and about `most` bytes, or
    one larger row alone; in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            waiting = [batch.slice(at, 256) for at in reversed(range(0, batch.num_rows, 256))]
            while waiting:
                part = waiting.pop()
                if (n := part.num_rows) > 1 and part.nbytes > most:
                    waiting += [part.slice(n // 2), part.slice(0, n // 2)]
                else:
                    yield one(part)

    return run


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """Only these columns, the ids as bigint, so that further columns of any name do no harm."""
    return docs.select(*(F.col(n).cast("bigint") if n in ("doc_id", "page_id", "conv_id") else F.col(n) for n in names))


def named(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def bounded_sample(df: DataFrame, stratum: str, rows: int, key: str = "doc_id") -> DataFrame:
    """For fitting classifiers: about `rows` rows of each value of `stratum` (fewer than 1.2 * rows + 100, all but surely),
    picked by a hash of `key`; of every value but null. So its size is bounded by the number of values, and with few of them it may
    be broadcast."""
    here = df.where(F.col(stratum).isNotNull())
    shares = here.groupBy(stratum).agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count(F.lit(1))).alias("_share"))
    picked = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)
    return here.join(F.broadcast(shares), stratum).where(picked).select(*df.columns)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, with their texts: about `most` bytes of text each, or one longer text alone."""
    for b in batches:
        texts, size, start = [], 0, 0
        for k in range(b.num_rows):
            texts += utf8(b.column(column).slice(k, 1))
            size += len(texts[-1])
            if size >= most or len(texts) == 1024:
                yield b.slice(start, len(texts)), texts
                texts, size, start = [], 0, k + 1
        if texts:
            yield b.slice(start, len(texts)), texts


def map_texts(docs: DataFrame, run, ddl: str, carry: bool, **more: Column) -> DataFrame:
    """mapInArrow over (doc_id, text, *more) of docs, whatever the names of its other columns. With carry, run gets the whole row
    as the last column, `row`, and has to return it after the columns of `ddl`, so that its decisions can be applied without a
    join; the text then travels in the row only."""
    kind, extra = T.StructType.fromDDL(ddl), [c.alias(n) for n, c in more.items()]
    if not carry:
        return docs.select(F.col("doc_id").cast("bigint"), "text", *extra).mapInArrow(run, kind)
    at = [docs.schema.names.index(n) for n in ("doc_id", "text")]

    def unpacked(batches):
        for b in batches:
            row = b.column(b.num_columns - 1)
            doc_id, text = (row.field(k) for k in at)
            yield pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), text, *b.columns], names=["doc_id", "text", *b.schema.names])

    return docs.select(*extra, F.struct(*named(docs)).alias("row")).mapInArrow(lambda batches: run(unpacked(batches)), kind.add("row", docs.schema, False))


def out_batch(b: pa.RecordBatch, schema: pa.Schema, columns: list, carry: bool) -> pa.RecordBatch:
    if not carry:
        return pa.RecordBatch.from_arrays(columns, schema=schema)
    return pa.RecordBatch.from_arrays([*columns, b.column(b.num_columns - 1)], names=[*schema.names, "row"])
