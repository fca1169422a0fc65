r"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` = 200 bytes that starts anywhere else as well.

A suffix array over all suffixes would be many times the input, so only suffixes at anchors are sorted, and
nothing is lost by that: every 200-byte window picks one of its 32-byte grams, the one with the least
polynomial hash (the leftmost of equals), by its content alone, so equal windows have equal anchors at equal
places.  Consecutive windows with one anchor form a run; a run's context is the text that its windows span.

1. ``_anchors``, map side, no text leaves: one row for each run (64-bit anchor hash, 128-bit context hash, place).  Runs met twice
   in a task are settled there, and one of them goes on; so a hot passage shrinks before any shuffle.
2. Anchors met once are dropped.  Of the others, contexts met twice are covered whole: all their windows repeat.
3. Different contexts around one anchor (the borders of repeated passages, and edits): one of each context
   fetches its text.  At each anchor the suffixes to the right and the reversed prefixes to the left are ordered by
   ``suffix_sort``: a mergesort whose comparisons find common extensions by binary search over prefix
   polynomial hashes; each common extension in the resulting LCP array is then verified byte by byte (a collision
   falls back to an exact sort).  A window is repeated if another context shares its left and its right part.
4. An anchor with over ``MAX_GROUP`` contexts is dealt to several tasks by context hash.  What a task cannot
   settle alone, one window of each kind, meets in an exact join on 128-bit window hashes.
5. The covered ranges of equal texts are the same, so they are kept by content, and joined back to all documents.

Texts move through two shuffles, compressed.  Contexts count as equal by 128 bits of two unlike hashes.

Defined edge cases: a null text is empty; texts under 200 bytes lose nothing.  Repeated rows are copies of each
other: each loses all, from 200 bytes on.  Null and repeated ids are kept, each row gets its result.  Other
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from haplospark.checkpoints import stored, sweep
from haplospark.llm.common import key_batches

LENGTH = 200
GRAM = 32
#: Bytes worked on at once.
PIECE = 1 << 17
#: Contexts of one anchor that one task sorts.
MAX_GROUP = 2048
#: Runs held back to settle repeats before the shuffle.
HELD = 200_000
#: Contexts sorted at once.
SORTED = 30_000
U = np.uint64
BASE = U(0x5851F42D4C957F2D)
_LOW = U(0xFFFFFF)

OCCURRENCE = "ah long, ch long, cl long, dup boolean, blob binary, s int, e int, p int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


INVERSE = U(pow(int(BASE), -1, 1 << 64))


def _table(base: U, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, U), np.full(n - 1, base, U))), dtype=U)


_POWERS, _INVERSES = _table(BASE, 4 * PIECE), _table(INVERSE, 4 * PIECE)


def _powers(n: int, base: U = BASE) -> np.ndarray:
    known = _POWERS if base == BASE else _INVERSES
    return known[:n] if n <= len(known) else _table(base, n)


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes modulo 2^64, and the powers that bring two of them to the same place."""
    power = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * power[:-1], dtype=U, out=sums[1:])
    return sums, power


def runs(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first window, last window, anchor, anchor hash) of the pieces begin..end of ``buf``, in order."""
    n, span = len(buf), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
    sums, _ = prefix_hashes(buf)
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * _powers(n - GRAM + 1, INVERSE))
    low = (gram & ~_LOW) | np.arange(len(gram), dtype=U)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & _LOW).astype(np.int64)
    piece = np.repeat(np.arange(len(begin)), end - begin)[: len(at)]
    real = np.flatnonzero(np.arange(len(at)) + LENGTH <= end[piece])
    if not len(real):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
    anchor, own = at[real], piece[real]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))))
    last = np.append(first[1:], len(real)) - 1
    return own[first], real[first], real[last], anchor[first], gram[anchor[first]]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, ends, text numbers, places in their texts) of groups of pieces; long texts are cut so that each window is in one piece."""
    parts, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            parts.append((part, k, at))
            size += len(part)
            if size >= PIECE:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[bytes, int, int]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    end = np.cumsum([len(p[0]) for p in parts])
    begin = np.concatenate(([0], end[:-1]))
    return b"".join(p[0] for p in parts), begin, end, np.array([p[1] for p in parts]), np.array([p[2] for p in parts])


def merge_ranges(owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of each owner."""
    if not len(s):
        return owner, s, e
    order = np.lexsort((s, owner))
    owner, s, e = owner[order], s[order], e[order]
    wide = int(e.max()) + 1
    reach = np.maximum.accumulate(owner * wide + e)
    new = np.concatenate(([True], owner[1:] * wide + s[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return owner[first], s[first], (reach[np.append(first[1:], len(s)) - 1] - owner[first] * wide)


def blob_of(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blobs: list[bytes] = []
    found: list[tuple[np.ndarray, ...]] = []
    n = 0
    for b in batches:
        texts = [x or b"" for x in b.column(0).to_pylist()]
        base = len(blobs)
        blobs += map(blob_of, texts)
        for body, begin, end, which, place in _pieces(texts):
            piece, first, last, anchor, ah = runs(np.frombuffer(body, np.uint8), begin, end)
            if len(piece):
                digest = xxhash.xxh3_128_digest
                names = b"".join([digest(body[i:j]) for i, j in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
                ch, cl = np.ascontiguousarray(np.frombuffer(names, "<u8").reshape(-1, 2).T)
                shift = place[piece] - begin[piece]
                found.append((ah, ch, cl, which[piece] + base, first + shift, last + shift + LENGTH, anchor + shift))
                n += len(piece)
        if n >= HELD:
            yield _settled(blobs, found)
            blobs, found, n = [], [], 0
    if found:
        yield _settled(blobs, found)


def _settled(blobs: list[bytes], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ah, ch, cl, owner, s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((cl, ch, ah))
    ah, ch, cl, owner, s, e, p = (x[order] for x in (ah, ch, cl, owner, s, e, p))
    first = np.flatnonzero(np.concatenate(([True], (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1]) | (cl[1:] != cl[:-1]))))
    count = np.diff(np.append(first, len(ah)))
    again = np.repeat(count > 1, count)
    who, begin, end = merge_ranges(owner[again], s[again], e[again])
    names = pa.array(blobs, pa.binary())
    none = pa.nulls(len(who), pa.int64())
    whole = lambda a, b, kind: pa.concat_arrays([pa.array(a).cast(kind), pa.array(b).cast(kind)])
    return pa.RecordBatch.from_arrays(
        [
            *[pa.concat_arrays([pa.array(x[first].view(np.int64)), none]) for x in (ah, ch, cl)],
            pa.concat_arrays([pa.array(count > 1), pa.nulls(len(who), pa.bool_())]), names.take(pa.array(np.concatenate((owner[first], who)))),
            whole(s[first], begin, pa.int32()), whole(e[first], end, pa.int32()), pa.concat_arrays([pa.array(p[first]).cast(pa.int32()), pa.nulls(len(who), pa.int32())]),
        ],
        names=["ah", "ch", "cl", "dup", "blob", "s", "e", "p"],
    )


class Suffixes:
    """Substrings start..start+length of a buffer, compared by hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buf, self.start, self.length = buf, start, length
        self.sums, self.power = prefix_hashes(buf)
        self.steps = [1 << k for k in range(int(length.max(initial=1)).bit_length() - 1, -1, -1)]

    def _hash(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.power[len(self.buf) - at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search."""
        most, done = np.minimum(self.length[x], self.length[y]), np.zeros(len(x), np.int64)
        a, b = self.start[x], self.start[y]
        for step in self.steps:
            open_ = np.flatnonzero(done + step <= most)
            i, j = a[open_] + done[open_], b[open_] + done[open_]
            done[open_[self._hash(i, step) == self._hash(j, step)]] += step
        return done

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        ended = n >= np.minimum(self.length[x], self.length[y])
        top = len(self.buf) - 1
        byte = self.buf[np.minimum(self.start[x] + n, top)] < self.buf[np.minimum(self.start[y] + n, top)]
        return np.where(ended, self.length[x] < self.length[y], byte)

    def verified(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Whether the first n bytes of each pair are equal, byte by byte."""
        for at in range(0, len(x), 4096):
            m = n[at : at + 4096]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            if not np.array_equal(self.buf[np.repeat(self.start[x[at : at + 4096]], m) + step], self.buf[np.repeat(self.start[y[at : at + 4096]], m) + step]):
                return False
        return True


def suffix_sort(group: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(order within each group, common extension with the one before it, -1 at a group's first).  Groups stand together."""
    n = len(group)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    base, count = np.repeat(first, size), np.repeat(size, size)
    order, width = np.arange(n), 1
    while width < size.max(initial=0):
        place = np.arange(n) - base
        block = place // (2 * width) * (2 * width)
        left = place - block < width
        middle, end = np.minimum(block + width, count), np.minimum(block + 2 * width, count)
        lo = base + np.where(left, middle, block)
        hi = base + np.where(left, end, middle)
        origin = lo.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            own, other = order[active], order[mid]
            # a right element goes behind equal left ones
            after = np.where(left[active], suffixes.less(other, own), ~suffixes.less(own, other))
            lo[active] = np.where(after, mid + 1, lo[active])
            hi[active] = np.where(after, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = base + block + (place - block - np.where(left, 0, middle - block)) + (lo - origin)
        fresh = np.empty_like(order)
        fresh[target] = order
        order, width = fresh, 2 * width
    lcp = np.full(n, -1)
    inner = np.setdiff1d(np.arange(n), first)
    lcp[inner] = suffixes.common(order[inner - 1], order[inner])
    if not suffixes.verified(order[inner - 1], order[inner], lcp[inner]):
        body = suffixes.buf.tobytes()
        text = [body[s : s + m] for s, m in zip(suffixes.start.tolist(), suffixes.length.tolist(), strict=True)]
        order = np.array(sorted(range(n), key=lambda k: (base[k], text[k])))
        for k in inner.tolist():
            a, b = text[order[k - 1]], text[order[k]]
            lcp[k] = next((i for i, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))
    return order, lcp


def repeated_windows(group: np.ndarray, contexts: list[bytes], anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x LENGTH - GRAM + 1 of whether the window that starts so far before the anchor is repeated, whether it is its kind's first).

    ``anchor``: where the anchor stands in each context; the anchors of one group are equal grams.
    """
    length = np.array([len(c) for c in contexts])
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(length) - length
    right = suffix_sort(group, Suffixes(buf, begin + anchor, length - anchor))
    left = suffix_sort(group, Suffixes(buf[::-1].copy(), len(buf) - (begin + anchor), anchor))
    n, span = len(length), LENGTH - GRAM + 1
    hit, lead = np.zeros((n, span), bool), np.zeros((n, span), bool)
    kinds = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for o in range(span):
        for kind, (order, lcp), least in ((kinds[0], left, o), (kinds[1], right, LENGTH - o)):
            kind[order] = np.cumsum(lcp < least)
        own = np.flatnonzero((o <= anchor) & (anchor - o + LENGTH <= length))
        if not len(own):
            continue
        key = kinds[0][own] * (n + 1) + kinds[1][own]
        by = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        alone = new & np.append(new[1:], True)
        hit[own[by[~alone]], o] = True
        lead[own[by[new]], o] = True
    return hit, lead


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, _ in key_batches(batches, "g", SORTED, 1 << 62):
        group = t["g"].to_numpy()
        s, p = t["s"].to_numpy().astype(np.int64), t["p"].to_numpy().astype(np.int64)
        body = t["body"].to_pylist()
        hit, lead = repeated_windows(group, body, p - s)
        alone = t["alone"].to_numpy(zero_copy_only=False).astype(bool)
        wide = np.zeros((len(s), hit.shape[1] + 2), np.int8)
        wide[:, 1:-1] = hit & alone[:, None]
        row, at = np.nonzero(np.diff(wide, axis=1) == 1)
        _, stop = np.nonzero(np.diff(wide, axis=1) == -1)
        blob = t["blob"].combine_chunks()
        yield _rows(blob.take(pa.array(row)), p[row] - (stop - 1), p[row] - at + LENGTH, None, np.zeros(len(row), bool))
        split = t["split"].to_numpy(zero_copy_only=False).astype(bool)
        row, at = np.nonzero(lead & split[:, None])
        for k in range(0, len(row), 50_000):
            r, o = row[k : k + 50_000], at[k : k + 50_000]
            begin = p[r] - o
            cut = (begin - s[r]).tolist()
            names = [xxhash.xxh3_128_digest(body[i][c : c + LENGTH]) for i, c in zip(r.tolist(), cut, strict=True)]
            yield _rows(blob.take(pa.array(r)), begin, begin + LENGTH, names, hit[r, o] | ~alone[r])


def _rows(blob: pa.Array, s: np.ndarray, e: np.ndarray, window: list[bytes] | None, done: np.ndarray) -> pa.RecordBatch:
    names = pa.nulls(len(s), pa.binary()) if window is None else pa.array(window, pa.binary())
    return pa.RecordBatch.from_arrays([blob, pa.array(s).cast(pa.int32()), pa.array(e).cast(pa.int32()), names, pa.array(done)], names=["blob", "s", "e", "window", "done"])


def _packed(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, blob and the compressed text of every row."""
    rows = docs.select(*keys, F.col(text).cast("binary").alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [x or b"" for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(blob_of, texts), pa.binary()), pa.array(map(pack.compress, texts), pa.binary())], names=[*keys, "blob", "packed"])

    return rows.mapInArrow(run, StructType([*[rows.schema[k] for k in keys], StructField("blob", BinaryType()), StructField("packed", BinaryType())]))


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[tuple] = []
        for blob, packed, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = unpack.decompress(packed)
            out += [(x["g"], blob, x["s"], x["p"], x["alone"], x["split"], text[x["s"] : x["e"]]) for x in places]
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        for k in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[k : k + 20_000], strict=True), kinds, strict=True)], names=["g", "blob", "s", "p", "alone", "split", "body"])


def covered(docs: DataFrame, text: str = "text") -> DataFrame:
    """(blob, spans): for each text with repeated windows, array of (s, e) byte ranges, in any order, that may overlap."""
    every = stored(docs.select(F.col(text).cast("binary")).mapInArrow(_anchors, OCCURRENCE), "runs")
    local = every.where("ah is null").select("blob", "s", "e")
    found = every.where("ah is not null")
    again = stored(found.groupBy("ah").agg(F.count("*").alias("n"), F.min("ch").alias("a"), F.max("ch").alias("b"), F.min("cl").alias("c"), F.max("cl").alias("d")).where("n > 1").select("ah", ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("mixed")), "anchors")
    met = stored(found.join(again, "ah"), "met")
    kinds = stored(
        met.groupBy("ah", "ch", "cl").agg(F.count("*").alias("n"), F.max("dup").alias("dup"), F.max("mixed").alias("mixed"), F.min(F.struct("blob", "s", "e", "p")).alias("one")), "contexts"
    )
    sweep(docs.sparkSession)
    whole = met.join(kinds.where("n > 1").select("ah", "ch", "cl"), ["ah", "ch", "cl"]).select("blob", "s", "e")
    mixed = kinds.where("mixed")
    sizes = stored(mixed.groupBy("ah").agg(F.count("*").alias("m")), "sizes")
    parts = F.ceil(F.col("m") / MAX_GROUP)
    dealt = mixed.join(sizes, "ah").select(
        "one.*", ((F.col("n") == 1) & ~F.col("dup")).alias("alone"), (parts > 1).alias("split"),
        F.when(parts > 1, F.xxhash64("ah", F.pmod("ch", parts))).otherwise(F.col("ah")).alias("g"),
    )
    places = dealt.groupBy("blob").agg(F.collect_list(F.struct("g", "s", "e", "p", "alone", "split")).alias("places"))
    texts = _packed(docs, [], text).groupBy("blob").agg(F.first("packed").alias("packed"))
    bodies = texts.join(places, "blob").select("blob", "packed", "places").mapInArrow(_cut_contexts, "g long, blob binary, s int, p int, alone boolean, split boolean, body binary")
    sought = stored(bodies.repartition("g").sortWithinPartitions("g").mapInArrow(_search, "blob binary, s int, e int, window binary, done boolean"), "windows")
    spans = local.unionByName(whole).unionByName(sought.where("window is null").select("blob", "s", "e"))
    left = sought.where("window is not null")
    if not left.isEmpty():
        twice = stored(left.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "twice")
        spans = spans.unionByName(left.where("not done").join(twice, "window").select("blob", "s", "e"))
    return spans.groupBy("blob").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    found = stored(covered(docs, text), "covered")
    sweep(docs.sparkSession)
    rows = _packed(docs, keys, text).join(found, "blob", "left").select(*keys, "packed", "spans")
    schema = StructType([rows.schema[k] for k in keys]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            sizes, gone, count, kept = [], [], [], []
            for packed, spans in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True):
                body = unpack.decompress(packed)
                at = np.array([(x["s"], x["e"]) for x in spans or ()], np.int64).reshape(-1, 2)
                _, s, e = merge_ranges(np.zeros(len(at), np.int64), at[:, 0], at[:, 1])
                edges = [0, *np.stack((s, e), 1).ravel().tolist(), len(body)]
                left = b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(body))
                gone.append(len(body) - len(left))
                count.append(len(s))
                kept.append(left)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *[pa.array(x, pa.int64()) for x in (sizes, gone, count)], pa.array(kept, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[bool]]:
    """Which bytes of each text go, straight from the definition (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = hashlib.sha256(t[i : i + length]).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[hashlib.sha256(t[i : i + length]).digest()] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out
