r"""Document fingerprints by one-permutation MinHash.

Words are cut at ASCII blanks and lower-cased (A-Z); shingles are five consecutive words (fewer: all of them), hashed
once to 64 bits.  The top bits choose one of ``BINS`` bins, each of which keeps its least hash.  An empty bin takes over
the hash of another bin by optimal densification: it has its own random order of all bins, the same for every
document, and takes the first that is not empty.  ``BITS`` low-order bits of each bin are kept, packed and written as
hexadecimal digits.  Two unlike hashes still agree in these bits by chance; ``likeness`` takes that out.

The next document: rows are dealt by range and sorted, in parts of about ``PART_BYTES``; each task compares its rows, and only what stands at
the borders, the first and the last row of each part, is joined once more.  What comes to the driver is the parts' numbers.

Defined edge cases: a null, empty or blank text has the empty fingerprint, which is like itself (1) and unlike any
other (0).  Equal texts have equal fingerprints.  A document alone is its own next one.  Ids may be numbers or strings.  Rows that
share an id are ordered by a hash of the text; null ids come last.  Repeated rows each get a result.  Other columns are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType
from pyspark.sql.types import StringType, StructField, StructType

from haplospark.checkpoints import stored
from haplospark.llm.common import packed_text, unpacked_text

SHINGLE = 5
BINS = 512
BITS = 4
CHUNK = 1 << 17
#: Text of one part of the order, about; and rows compared at once.
PART_BYTES, ROWS = 32 << 20, 500
U = np.uint64
BASE = U(0x2545F4914F6CDD1D)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bins in the order in which an empty bin asks them, and the place of each bin in that order.
DONORS = np.array([np.random.default_rng([BINS, k]).permutation(BINS) for k in range(BINS)], np.int64)
RANKS = np.argsort(DONORS, axis=1)
np.fill_diagonal(RANKS, -1)  # a bin that is not empty keeps its own hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: U, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, U), np.full(n, base, U))), dtype=U)


def shingle_hashes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of the texts that end at ``ends`` in ``buf``."""
    n = len(buf)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    ink = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    fresh = np.concatenate(([True], text[1:] != text[:-1]))
    start = np.flatnonzero(ink & (fresh | np.concatenate(([True], ~ink[:-1]))))
    stop = np.flatnonzero(ink & np.append(fresh[1:] | ~ink[1:], True)) + 1
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64)
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(U) + U(1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(low * _powers(BASE, n - 1), dtype=U)))
    word = _mix((sums[stop] - sums[start]) * _powers(INVERSE, n - 1)[start] + (stop - start).astype(U))
    owner = text[start]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(owner)))
    place = np.arange(len(owner)) - np.repeat(first, count)
    of = np.minimum(np.repeat(count, count), SHINGLE)
    head = np.flatnonzero(place + of <= np.repeat(count, count))
    value = of[head].astype(U)
    for k in range(SHINGLE):
        more = of[head] > k
        value = np.where(more, _mix(value * BASE + word[np.minimum(head + k, len(word) - 1)]), value)
    return value, owner[head]


def sketch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n x BINS codes, whether a text has any shingle)."""
    n = len(texts)
    least = np.full(n * BINS, ~U(0), U)
    i = 0
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        buf = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        if len(buf):
            value, owner = shingle_hashes(buf, np.cumsum([len(t) for t in texts[i:j]]))
            np.minimum.at(least, (owner + i) * BINS + (value >> U(55)).astype(np.int64), value)
        i = j
    least = least.reshape(n, BINS)
    full = least != ~U(0)
    some = full.any(axis=1)
    few = some & (full.sum(axis=1) <= 32)
    for k in np.flatnonzero(few).tolist():
        own = np.flatnonzero(full[k])
        least[k] = least[k, own[RANKS[:, own].argmin(axis=1)]]
    row, bin_ = np.nonzero(~full & (some & ~few)[:, None])
    turn = 0
    while len(row):
        donor = DONORS[bin_, turn]
        there = full[row, donor]
        least[row[there], bin_[there]] = least[row[there], donor[there]]
        row, bin_, turn = row[~there], bin_[~there], turn + 1
    return (least & U((1 << BITS) - 1)).astype(np.uint8), some


def packed_bytes(codes: np.ndarray, some: np.ndarray) -> list[bytes]:
    """Two bins a byte; empty where there is no shingle."""
    pairs = codes[:, ::2] << 4 | codes[:, 1::2]
    return [p.tobytes() if s else b"" for p, s in zip(pairs, some.tolist(), strict=True)]


def packed(codes: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal digits, one for each bin; empty where there is no shingle."""
    return [p.hex() for p in packed_bytes(codes, some)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingles behind two rows of codes, without the share that agrees by chance."""
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, as a column."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(packed(*sketch([(t or "").encode() for t in texts])), dtype=object)

    return F.pandas_udf(run, StringType(), PandasUDFType.SCALAR)(text)


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """part, doc_id, packed text: parts, and rows within them, by descending id (nulls last), then by a hash of the text.

    Rows alike in both are told apart by their place in the input, so that they may be dealt to several parts.
    """
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // PART_BYTES))
    rows = packed_text(docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("place"), text), ["doc_id", "h", "place"], text)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("place")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "packed")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the head of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_RESULT, _FIRST, _LAST = range(3)


def compare_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    rows = in_order(docs, text)
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = StructType([rows.schema["doc_id"]]).add("n_chars", "long").add("edited_sha256", "binary").add("fingerprint", "binary").add("edited_fingerprint", "binary").add("near_edited", "double").add("near_next", "double")
    marked = StructType([*schema.fields, StructField("kind", rows.schema["part"].dataType), StructField("part", rows.schema["part"].dataType)]).add("packed", "binary")

    def compared(ids: pa.Array, texts: list[str]) -> list[pa.Array]:
        """The columns of all rows but the last, whose next one is not known here."""
        edits = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        codes, some = sketch([t.encode() for t in texts])
        changed, has = sketch([t.encode() for t in edits])
        return [
            ids, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in edits], pa.binary()),
            pa.array(packed_bytes(codes[:-1], some[:-1]), pa.binary()), pa.array(packed_bytes(changed, has), pa.binary()),
            pa.array(likeness(codes[:-1], changed, some[:-1], has)), pa.array(likeness(codes[:-1], codes[1:], some[:-1], some[1:])),
        ]

    def batch(columns: list[pa.Array], kind: int, part: int, body: pa.Array | None) -> pa.RecordBatch:
        n = len(columns[0])
        tail = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.binary()) if body is None else body]
        return pa.RecordBatch.from_arrays([*columns, *tail], names=marked.names)

    def border(row: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return batch([row.column(1), *none], kind, row.column(0)[0].as_py(), row.column(2))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, ""
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                own = b.slice(k, ROWS)
                texts = unpacked_text(own.column(2))
                if last is None:
                    yield border(own.slice(0, 1), _FIRST)
                    ids, shown = own.column(1).slice(0, len(own) - 1), texts
                else:
                    ids, shown = pa.concat_arrays([last.column(1), own.column(1).slice(0, len(own) - 1)]), [before, *texts]
                yield batch(compared(ids, shown), _RESULT, 0, None)
                last, before = own.slice(own.num_rows - 1), texts[-1]
        if last is not None:
            yield border(last, _LAST)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(compared(own.column(0), [unpacked_text(own.column(1))[0], unpacked_text(own.column(2))[0]]), names=out)

    done = stored(rows.mapInArrow(within, marked), "compared")
    borders = done.where(F.col("kind") != _RESULT)
    parts = [r[0] for r in borders.select("part").distinct().orderBy("part").collect()]  # a number for each part
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    first = borders.where(F.col("kind") == _FIRST).select(F.col("part").alias("following"), F.col("packed").alias("next"))
    last = borders.where(F.col("kind") == _LAST).join(F.broadcast(following), "part").join(first, "following")
    whole = done.where(F.col("kind") == _RESULT).select(*out).unionByName(last.select("doc_id", "packed", "next").mapInArrow(across, schema))
    digits = lambda c: F.lower(F.hex(c)).alias(c)  # noqa: E731  (stored as bytes, half the size)
    return whole.select("doc_id", "n_chars", digits("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")
