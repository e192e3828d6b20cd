"""What the corpus operators share: reading tables, the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's regular expressions and for DuckDB's.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that parts words and is stripped from lines.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns of the documents table, in order.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chronoweir-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Folders and tables written in this process, for sweep().
_WRITTEN: list[tuple[str, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(("folder", path))
    return path


def stored(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and a lost executor costs no recomputation. Filters on partition columns read their part alone."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *columns: str, path: str | None = None) -> DataFrame:
    """df as a table with its files in the shared folder (or at path), bucketed by columns and sorted by them: joins on them read it without a shuffle."""
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = path or fresh_path(spark, name)
    _WRITTEN.append(("table", table_name))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, *columns).sortBy(*columns).saveAsTable(table_name)
    return spark.table(table_name)


def opened(spark: SparkSession, path: str, schema: str, columns: list[str], buckets: int) -> DataFrame:
    """A table that bucketed() has written at a path, in an earlier session too."""
    name, by = f"opened_{uuid.uuid4().hex}", ", ".join(columns)
    _WRITTEN.append(("table", name))
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession):
    """Joins of tables that bucketed() has written don't sort them again, as their buckets are single files."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def written(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a pattern fits, as far as their writing has ended."""
    files, at = _files(spark, f"{pattern}/_SUCCESS")
    return sorted(x.getPath().getParent().toString() for x in files.globStatus(at) or ())


def delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        files, at = _files(spark, folder)
        files.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def sweep(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Deletes all that this process has stored (since mark() gave a number, and but for the last ones); for when the results that read it have been written."""
    stop = len(_WRITTEN) - but_last
    old, _WRITTEN[since:stop] = _WRITTEN[since:stop], []
    for kind, name in old:
        if kind == "folder":
            delete(spark, name)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def mark() -> int:
    return len(_WRITTEN)


def of(struct: str, column: str) -> Column:
    """A field of a struct, whatever its name."""
    return F.col(struct).getField(column).alias(column)


def hashes(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds, 128 bits together."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7919), *columns)


def salt(column: Column, bits: int) -> Column:
    """0 to 2**bits - 1 (bits up to 16) from the MD5 of a value's text, which other engines can also compute; 0 for null."""
    return F.coalesce(F.shiftright(F.conv(F.substring(F.md5(column.cast("string")), 1, 4), 16, 10).cast("int"), 16 - bits), F.lit(0))


def size_class(size: Column, digits: int = 4) -> Column:
    """A class for sizes >= 0: the binary length and the first digits of size + 1, so sizes of a class differ by under 2**(1-digits)."""
    bits = F.length(F.bin(size + 1))
    return (bits * (1 << digits) + F.call_function("shiftright", size + 1, F.greatest(bits - digits, F.lit(0))).cast("int")).cast("int")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20):
    """Parts of an Arrow batch with about limit bytes in a column, at least one row each."""
    n, start, total = batch.num_rows, 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, x in enumerate(lengths):
        if i > start and total + x > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += x
    if start < n:
        yield batch.slice(start, n - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
