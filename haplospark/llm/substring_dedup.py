r"""Substring dedup over sliding sentence spans.

A text is cut into sentences: up to and with a run of ``.!?`` or line ends.  Words are cut, and sentences stripped, at ASCII blanks.  From every sentence on, the shortest run
of at least ``SENTENCES`` consecutive sentences and at least ``WORDS`` words is hashed (128 bits of the sentences,
stripped, a line each), and likewise the shortest run that ends at every sentence; so a passage is covered up
to both its ends, whatever stands around it.  Runs are joined globally by hash.  The first occurrence, by
(doc_id, MD5 of the text, sentence), stays; the sentences of any other are removed with what separates them from the next one.

The table of occurrences is written once; the first of each hash comes from a partial aggregation, so a hot run is one
row per task there, and the join back is a sort-merge join between two shuffles, which adaptive execution splits.
What is to be removed goes back to the texts by a join between two shuffles.

Defined edge cases: a null text has no sentence.  Rows that agree in id and text are one document: each gets the
same result.  A null id comes first.  A text with too few sentences or words has no run.  Other columns are not
read by ``removals``; ``dedup`` keeps them.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from haplospark.checkpoints import stored, sweep

SENTENCES = 2
WORDS = 20
_BLANK = " \t\n\x0b\x0c\r"
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")


def sentences(text: str | None) -> list[str]:
    """Pieces that make up ``text``."""
    return _SENTENCE.findall(text or "")


def runs(pieces: list[str], least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs from and to every sentence, each once, in order."""
    upto = [0, *accumulate(len(p.encode().split()) for p in pieces)]
    n, found = len(pieces), set()
    for i in range(n):
        j = max(i + least, bisect_left(upto, upto[i] + words))
        if j <= n:
            found.add((i, j - 1))
        j = min(i + 1 - least, bisect_right(upto, upto[i + 1] - words) - 1)
        if j >= 0:
            found.add((j, i))
    return sorted(found)


def hashed_runs(text: str | None, least: int = SENTENCES, words: int = WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first, last) of every run."""
    pieces = sentences(text)
    lines = [p.strip(_BLANK).encode() for p in pieces]
    whole, ends = b"\n".join(lines), list(accumulate(len(x) + 1 for x in lines))
    starts = [0, *ends[:-1]]
    return [(xxhash.xxh3_128_digest(whole[starts[i] : ends[j] - 1]), i, j) for i, j in runs(pieces, least, words)]


def body_of(text: Column) -> Column:
    """Tells texts of one id apart, and orders them: the first eight bytes of the MD5."""
    return F.unhex(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16))


def _occurrences(docs: DataFrame, text: str, least: int, words: int) -> DataFrame:
    """run, doc_id, body (of the text), i, j."""
    rows = docs.select("doc_id", text, body_of(F.col(text)).alias("body"))
    schema = StructType().add("run", "binary").add(rows.schema["doc_id"]).add("body", "binary").add("i", "integer").add("j", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owner = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                own = hashed_runs(t, least, words)
                found += own
                owner += [k] * len(own)
            if found:
                h, i, j = zip(*found, strict=True)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), b.column(0).take(at), b.column(2).take(at), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def removals(docs: DataFrame, text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Stored doc_id, body, spans: array of (i, j) sentence ranges to remove, of the documents that have any."""
    every = stored(_occurrences(docs, text, least, words), "runs")
    place = F.struct("doc_id", "body", "i", "j")
    first = stored(every.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("run", "first"), "repeated")
    sweep(docs.sparkSession)
    again = every.join(first, "run").where(~place.eqNullSafe(F.col("first")))
    out = stored(again.groupBy("doc_id", "body").agg(F.collect_set(F.struct("i", "j")).alias("spans")), "removals", every, first)
    sweep(docs.sparkSession)
    return out


def dedup(docs: DataFrame, text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with cleaned ``text``, and n_sentences, n_removed (sentences) and spans (the ranges removed, in order).

    Columns of the latter names give way.
    """
    docs = docs.drop("n_sentences", "n_removed", "spans")
    names = docs.columns
    gone = removals(docs, text, least, words).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("spans").alias("__spans"))
    marked = docs.withColumn("__own", body_of(F.col(text)))
    joined = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__body")), "left").select(*names, "__spans")
    schema = StructType(list(docs.schema)).add("n_sentences", "long").add("n_removed", "long").add("spans", ArrayType(StructType().add("i", "integer").add("j", "integer")))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, count, gone, ranges = [], [], [], []
            for t, spans in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                pieces, merged = sentences(t), []
                for i, j in sorted((x["i"], x["j"]) for x in spans or ()):
                    if merged and i <= merged[-1]["j"] + 1:
                        merged[-1]["j"] = max(merged[-1]["j"], j)
                    else:
                        merged.append({"i": i, "j": j})
                edges = [0, *[e for x in merged for e in (x["i"], x["j"] + 1)], len(pieces)]
                kept = [p for i, j in zip(edges[::2], edges[1::2], strict=True) for p in pieces[i:j]]
                out.append(t if not merged else "".join(kept))
                count.append(len(pieces))
                gone.append(len(pieces) - len(kept))
                ranges.append(merged)
            kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
            columns = [pa.array(out, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, kind)], names=schema.names)

    return joined.mapInArrow(run, schema)


def brute_force(rows: list[tuple], least: int = SENTENCES, words: int = WORDS) -> dict[tuple, set[int]]:
    """Sentences removed of each distinct (doc_id, text) (for tests)."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()[:8])
    seen: set[tuple] = set()
    out: dict[tuple, set[int]] = {}
    for r in sorted({(a, b) for a, b in rows}, key=key):
        pieces, gone = sentences(r[1]), set()
        for i, j in runs(pieces, least, words):
            name = tuple(p.strip(_BLANK) for p in pieces[i : j + 1])
            if name in seen:
                gone |= set(range(i, j + 1))
            seen.add(name)
        out[r] = gone
    return out
