"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import string

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` is used where text is pure ASCII (it is much faster)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of ``separators`` (a regular expression); null has none."""
    return F.array_remove(F.split(text_or_empty(text), separators), "")


def recount(docs: DataFrame, changed: Column) -> DataFrame:
    """n_chars, if there is such a column, set to the text's length in rows that were ``changed``."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(run):
    """``run`` as a task's function whose worker, which waits for further tasks, gives its free memory back when it is done."""

    def go(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return go


def key_batches(batches, key: str, rows: int, most: int):
    """(table, whether it is part of a run longer than ``most``): the stream, ordered by ``key``, in whole runs of equal keys.

    About ``rows`` rows at once.  A run longer than ``most`` is handed on in pieces as it comes, and never held.
    """
    held, n, long = [], 0, None

    def parted(t: pa.Table):
        at = t[key].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        size = np.diff(np.append(first, len(at)))
        for k in np.flatnonzero(size > most).tolist():
            yield t.slice(first[k], size[k]).combine_chunks(), True
        rest = t if (size <= most).all() else t.filter(pa.array(np.repeat(size <= most, size)))
        if rest.num_rows:
            yield rest.combine_chunks(), False

    for b in batches:
        if not b.num_rows:
            continue
        if long is not None:
            same = int(np.searchsorted(b.column(key).to_numpy(), long, "right"))
            if same:
                yield pa.Table.from_batches([b.slice(0, same)]).combine_chunks(), True
            if same == b.num_rows:
                continue
            b, long = b.slice(same), None
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = t[key].to_numpy()
        cut = int(np.searchsorted(at, at[-1], "left"))
        yield from parted(t.slice(0, cut)) if cut else ()
        left = t.slice(cut).combine_chunks()
        if left.num_rows > most:
            yield left, True
            held, n, long = [], 0, at[-1]
        else:
            held, n = left.to_batches(), left.num_rows
            rows = max(rows, 2 * n)
    if held:
        yield from parted(pa.Table.from_batches(held).combine_chunks())


def packed_text(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the text, compressed for a shuffle (null: the empty text), as ``packed``."""
    rows = docs.select(*keys, F.col(text).cast("binary").alias("__t"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pack.compress(x or b"") for x in b.column(len(keys)).to_pylist()], pa.binary())], names=[*keys, "packed"])

    return rows.mapInArrow(run, StructType([*[rows.schema[k] for k in keys], StructField("packed", BinaryType())]))


def unpacked_text(column: pa.Array) -> list[str]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x).decode() for x in column.to_pylist()]
