"""Helpers shared by the text operators: reading, Arrow mapping, and cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.sources.shared import drop_written, written

LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, as texts are long; a setting of the session's own stays."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; bytes.split() splits at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept up to a bounded number."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def arrow_map(df: DataFrame, inputs: list[str], fn: Callable, out: str, keep: list[str] | None = None) -> DataFrame:
    """Adds the columns ``out`` (DDL) that ``fn(*input columns as lists)`` makes as a list of columns, batch by batch.

    ``keep``: columns passed on unchanged, all when None. Rows keep their partition; nothing is shuffled. A batch is
    worked on in slices of SLICE_ROWS rows or about SLICE_BYTES of input, which bounds what ``fn`` holds at once.
    """
    small_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    # by position, so that clashing or odd names in the input do no harm
    picked = df.select(*[_col(df, c).alias(f"k{i}") for i, c in enumerate(keep)], *[_col(df, c).alias(f"i{j}") for j, c in enumerate(inputs)])
    added = T._parse_datatype_string(out)
    schema = T.StructType([T.StructField(f"k{i}", picked.schema[f"k{i}"].dataType) for i in range(len(keep))] + list(added.fields))
    n, m = len(keep), len(inputs)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, range(n, n + m)):
                cols = fn(*[b.column(n + j).to_pylist() for j in range(m)])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + [pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    made = picked.mapInArrow(run, schema)
    taken = {f.name for f in added.fields}
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in taken], *[F.col(f.name) for f in added.fields])


SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def slices(batch: pa.RecordBatch, columns) -> Iterator[pa.RecordBatch]:
    """Parts of a batch; a single long text makes a slice of its own."""
    total = np.zeros(batch.num_rows, np.int64)
    for j in columns:
        if pa.types.is_string(batch.column(j).type) or pa.types.is_large_string(batch.column(j).type):
            total += pc.fill_null(pc.binary_length(batch.column(j)), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for k, x in enumerate(total.tolist()):
        if k > at and (k - at == SLICE_ROWS or size + x > SLICE_BYTES):
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += x
    if at < batch.num_rows:
        yield batch.slice(at)


def _col(df: DataFrame, name: str):
    return df["`" + name.replace("`", "``") + "`"]


def shuffled(df: DataFrame) -> DataFrame:
    """The smaller side of a join with texts: both sides are exchanged by the key at every size, and this one is hashed, so that texts aren't sorted."""
    return df.hint("shuffle_hash")


__all__ = ["BATCH_ROWS", "LOWER_ASCII", "WordHashes", "arrow_map", "drop_written", "mixed", "shuffled", "slices", "small_batches", "table", "words", "written"]
