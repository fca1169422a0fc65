r"""SimHash near-dedup by anchor-point covering.

Fingerprint: words are cut at ASCII blanks, lower-cased (A-Z), joined to shingles (fewer words: all of them), hashed with
XXH64 (seed 42); a bit is 1 where over half the hashes have it.  There are two settings:

* ``CONTRACT``: shingles of four words, 64 bits, a link at 4 or fewer differing bits.  Exact.
* ``SIMILAR``: distinct shingles of five words, 192 bits (two more words of bits by mixing each hash).  Two texts are linked
  if their sets of shingles have a Jaccard similarity of 0.8 or more.  The bits only find candidates, at 40 or fewer
  differing bits (a similarity of 0.8 gives 29 on the average, and over 40 once in a hundred times); every link is then
  verified on the shingles themselves.

Search in ``CONTRACT``: the 64 bits fall into three blocks.  A block's anchors are a covering code: the codewords of the
Hamming(15,11) code, which covers with radius 1, times all values of the block's other bits.  A fingerprint lives at the
anchor nearest to it (at most 1 off), and is replicated to every anchor within radius plus threshold, 1 + 1 = 2.  So two
fingerprints that differ in at most one bit of some block meet at the home of either: with a threshold of 4 that is
certain.  Each anchor compares its homes with its visitors.  A block has 2^17 or 2^18 anchors.

Search in ``SIMILAR``: the 192 bits fall into blocks.  A block's bits carry vectors of GF(2)^dim, and for each of
the nonzero v of that space there is an anchor: the block's bits whose vector has an odd product with v (the words of a
linear code, so any ``dim`` - 1 differing bits of a block leave an anchor that has none of them).  Fingerprints that agree in all bits of
an anchor meet there.  How many blocks and dimensions there are depends on the number of fingerprints (``covering``): about as
many bits are kept as tell so many of them apart, so anchors stay small as the input grows.

An anchor compares its members and emits no pairs, but spanning forests of candidates: the links of least distance that
connect what is connected.  Verified links make components; where links of a forest failed and others had been left out for
it, those nodes are searched again with components contracted, first for forests again, then for all that is left, each pair at the
first anchor that it shares.  Which nodes these are takes one row for each: nodes of links left out whose component has a failed link
to another one (a link left out between two components had a path in its forest, and that has a failed link at either of them).  In these rounds nodes carry a finer fingerprint, of 4,096 bits, which leaves few candidates that are not alike
enough (a family of texts just below the threshold would else be verified pair by pair).  So components are those of all verified candidates, without a pair within a group being emitted.

Anchors of over ``HOT`` rows leave the task that finds them: with ``CONTRACT`` they are dealt anew by five pieces of the other bits
(four differences leave one piece equal); what is still too large is cut into parts, and each pair of parts is a
task of its own.

Groups: equal fingerprints are merged before the search.  Components come from ``graph_components``.

Defined edge cases: a null, empty or blank text has fingerprint zero, which links like any other.  Repeated
rows are kept each, with equal fingerprints.  Null ids are kept; a component of null ids alone has a null
id.  Columns not asked for are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from haplospark.checkpoints import release, stored, sweep
from haplospark.llm.common import key_batches, tidied
from haplospark.llm.graph_components import components

SEED = 42


@dataclass(frozen=True)
class Setting:
    """Words of a shingle, 64-bit words of a fingerprint, the most bits in which candidates differ, and the similarity that links need (None: the bits decide)."""

    shingle: int
    words: int
    bits: int
    similarity: float | None = None

    @property
    def kind(self) -> str:
        """Of a fingerprint's name: all its words."""
        return "long" if self.words == 1 else "binary"


CONTRACT = Setting(4, 1, 4)
SIMILAR = Setting(5, 3, 40, 0.8)
#: Forests of candidates that each round of the search takes at an anchor; the last takes all candidates between components.
ROUNDS: tuple[int | None, ...] = (1, 1, None)
#: Words of the finer fingerprint of later rounds, and the most of its 4,096 bits in which candidates differ (a similarity of 0.8
#: gives 621 on the average, and over 690 once in 800 times).
FINE, FINE_BITS = 64, 690
#: Candidates that are fetched by a broadcast of their names (about 100 bytes each); more go through a shuffle.
MAX_BROADCAST_NAMES = 300_000
#: Rows of an anchor that one task compares, by the number of words.
HOT = {1: 200_000, 3: 16_384}
#: (first bit, bits) of each block; the lowest 15 bits of a block carry the Hamming code.
BLOCKS = ((0, 21), (21, 21), (42, 22))
LARGE = 4096
#: Pairs compared at once: some tens of MB.
PAIRS = 250_000
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(text: bytes | None, how: Setting = CONTRACT) -> np.ndarray:
    """Hashes of the shingles; distinct ones in order where similarity is to be verified."""
    words, n = (text or b"").lower().split(), how.shingle
    if not words:
        return np.zeros(0, U)
    whole = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = [whole[i:j] for i, j in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), U, len(cuts))
    return np.unique(hashes) if how.similarity else hashes


def fingerprint(text: bytes | None, how: Setting = CONTRACT) -> np.ndarray:
    """The fingerprint's words."""
    hashes, out = shingle_hashes(text, how), np.zeros(how.words, U)
    if not len(hashes):
        return out
    for w in range(how.words):
        own, ones = (hashes if w == 0 else _mix(hashes + U(w))), np.zeros(64, np.int64)
        for k in range(0, len(own), 65536):
            ones += np.unpackbits(own[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(ones * 2 > len(own), bitorder="little").view("<u8")[0]
    return out


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets of distinct hashes; two empty ones are alike."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def names_of(fps: np.ndarray) -> pa.Array:
    """One name for each row of n x words: the fingerprint itself, as a signed long or as its bytes."""
    fps = np.ascontiguousarray(fps)
    if fps.shape[1] == 1:
        return pa.array(fps[:, 0].view(np.int64))
    return pa.Array.from_buffers(pa.binary(8 * fps.shape[1]), len(fps), [None, pa.py_buffer(fps.tobytes())]).cast(pa.binary())


def _hashed(fps: np.ndarray) -> np.ndarray:
    """One hash for each row of n x words."""
    name = fps[:, 0]
    for w in range(1, fps.shape[1]):
        name = _mix(_mix(name) ^ fps[:, w])
    return name


def _words(how: Setting) -> list[str]:
    return [f"f{w}" for w in range(how.words)]


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", how: Setting = CONTRACT) -> DataFrame:
    """``keys``, fp (the fingerprint's name) and its words f0, f1, ... of every row."""
    rows, names = docs.select(*keys, F.col(text).cast("binary").alias("__text")), [*keys, "fp", *_words(how)]
    name = LongType() if how.words == 1 else BinaryType()
    schema = StructType([*[rows.schema[k] for k in keys], StructField("fp", name), *[StructField(c, LongType()) for c in _words(how)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), how) for x in b.column(len(keys))], U).reshape(-1, how.words)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], names_of(fps), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T]], names=names)

    return rows.mapInArrow(tidied(run), schema)


def _patterns() -> list[np.ndarray]:
    """For each syndrome of the Hamming code, the flips of two or fewer of 15 bits that end at a codeword; the lightest first."""
    found: list[list[int]] = [[] for _ in range(16)]
    for k in range(3):
        for bits in combinations(range(15), k):
            s = 0
            for i in bits:
                s ^= i + 1
            found[s].append(sum(1 << i for i in bits))
    return [np.array(x, np.int64) for x in found]


def _syndromes() -> np.ndarray:
    words, out = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for i in range(15):
        out ^= np.where(words >> i & 1, i + 1, 0)
    return out


PATTERNS, SYNDROMES = _patterns(), _syndromes()


def cover(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into ``fps`` (n x words), home) of every replica."""
    anchors, index, home = [], [], []
    for block in range(len(BLOCKS) * fps.shape[1]):
        first, bits = BLOCKS[block % len(BLOCKS)]
        value = (fps[:, block // len(BLOCKS)] >> U(first) & U((1 << bits) - 1)).astype(np.int64)
        code, rest = value & 0x7FFF, value >> 15
        syndrome = SYNDROMES[code]
        extra = bits - 15
        singles = [1 << i for i in range(extra)]
        doubles = [1 << i | 1 << j for i, j in combinations(range(extra), 2)]
        for s in range(16):
            mine = np.flatnonzero(syndrome == s)
            near = code[mine] ^ PATTERNS[s][0]
            moves = [(code[mine] ^ p, 0) for p in PATTERNS[s]] + [(near, r) for r in singles] + ([(near, r) for r in doubles] if s == 0 else [])
            for at, (word, r) in enumerate(moves):
                anchors.append(block << 22 | (rest[mine] ^ r) << 15 | word)
                index.append(mine)
                home.append(np.full(len(mine), at == 0))
    return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)


def covering(n: int) -> tuple[int, int]:
    """(blocks, dimensions) for ``n`` fingerprints of 192 bits: a pair of similarity 0.8 meets with 0.98 or more in each."""
    if n <= 1 << 22:
        return 6, 5  # 186 anchors of 16 bits
    return (5, 6) if n <= 1 << 26 else (4, 8)  # 315 of about 19, 1020 of about 24


def _vectors(bits: int, dim: int) -> np.ndarray:
    """A nonzero vector of GF(2)^dim for each bit, such that every product keeps about half of the bits."""
    whole = (1 << dim) - 1
    if bits >= whole:
        return np.arange(bits) % whole + 1
    rng, best, most = np.random.default_rng([bits, dim]), None, -1
    products = np.array([[(v & x).bit_count() & 1 for x in range(whole + 1)] for v in range(1, whole + 1)])
    for _ in range(300):
        x = rng.permutation(whole)[:bits] + 1
        least = int(products[:, x].sum(axis=1).min())
        if least > most:
            best, most = x, least
    return best


def masks(blocks: int, dim: int, words: int = 3) -> np.ndarray:
    """The bits (n x words) that each anchor keeps: of any ``dim`` - 1 bits of a block, some mask has none."""
    cuts, out = [64 * words * k // blocks for k in range(blocks + 1)], []
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        x = _vectors(end - first, dim).tolist()
        for v in range(1, 1 << dim):
            row = np.zeros(words, U)
            for i in range(first, end):
                if (x[i - first] & v).bit_count() & 1:
                    row[i // 64] |= U(1 << i % 64)
            out.append(row)
    return np.stack(out)


#: The bits of an anchor that hold its mask's number.
_MASK = U(0xFFF)


def first_shared(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The first mask that has none of the differing bits ``x`` (n x words)."""
    out, left = np.full(len(x), len(keep)), np.arange(len(x))
    for k, row in enumerate(keep):
        if not len(left):
            break
        here = ((x[left] & row) == 0).all(axis=1)
        out[left[here]] = k
        left = left[~here]
    return out


def masked(fps: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into ``fps`` (n x words)) of every replica: a hash of the bits that each mask keeps, and in its lowest bits the mask's number."""
    anchors = [_hashed(fps & row) & ~_MASK | U(k) for k, row in enumerate(keep)]
    return np.concatenate(anchors).view(np.int64), np.tile(np.arange(len(fps)), len(keep))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of ``n`` nodes by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the links of the lightest spanning forest of n nodes, the least node reachable from each)."""
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    root, live, chosen = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(live):
        live = live[root[a[live]] != root[b[live]]]
        if not len(live):
            break
        best = np.full(n, len(a))  # of each component, its first link that leaves it
        np.minimum.at(best, root[a[live]], live)
        np.minimum.at(best, root[b[live]], live)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        root = forest(n, root[a[pick]], root[b[pick]])[root]
    return order[np.concatenate(chosen)], root


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every k with every member of its range starts[k] .. starts[k]+counts[k]-1."""
    who = np.repeat(np.arange(len(starts)), counts)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _close(fps: np.ndarray, left: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, differing bits) of the pairs (left[k], member of k's range) that differ in ``most`` bits or fewer, some at a time."""
    for k in np.flatnonzero(counts > PAIRS).tolist():  # one row with very many visitors: in parts
        for at in range(0, int(counts[k]), PAIRS):
            yield from _close(fps, left[k : k + 1], starts[k : k + 1] + at, np.minimum(counts[k : k + 1] - at, PAIRS), most)
    keep = np.flatnonzero(counts <= PAIRS)
    left, starts, counts = left[keep], starts[keep], counts[keep]
    total = np.cumsum(counts)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        who, right = _expand(starts[at:to], counts[at:to])
        a = left[at:to][who]
        off = np.zeros(len(a), np.uint8)
        for w in range(fps.shape[1]):
            off += np.bitwise_count(fps[a, w] ^ fps[right, w])
        hit = np.flatnonzero((off <= most) & (a != right))
        if len(hit):
            yield a[hit], right[hit], off[hit]
        at = to


def _connected(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what ``pairs`` connect, fewer than nodes in each piece."""
    out = []
    for a, b, _ in pairs:
        nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = forest(len(nodes), *np.split(where, 2))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        out.append((nodes[own], nodes[root[own]]))
    return out


def _runs(anchor: np.ndarray) -> np.ndarray:
    """Where runs of equal anchors begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))


def candidates(group: np.ndarray, fps: np.ndarray, label: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], forests: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, node): links a-b of the ``forests`` lightest edge-disjoint spanning forests of ``pairs``, and nodes of links left out.

    Nodes of one group with equal labels count as one.
    """
    key = np.stack((group.astype(np.int64), label), axis=1)
    every, node = np.unique(key, axis=0, return_inverse=True)
    node, n = node.ravel(), len(every)
    kept = [np.zeros((3, 0), np.int64)]
    left = [np.zeros(0, np.int64)]

    def thin(links: np.ndarray) -> np.ndarray:
        rest, chosen = np.arange(links.shape[1]), []
        for _ in range(forests):
            if not len(rest):
                break
            pick, _ = spanning(n, node[links[0, rest]], node[links[1, rest]], links[2, rest])
            chosen.append(rest[pick])
            rest = np.delete(rest, pick)
        left.append(np.unique(links[:2, rest]))
        return links[:, np.concatenate(chosen)] if chosen else links[:, :0]

    for a, b, off in pairs:
        cross = node[a] != node[b]
        if cross.any():
            kept.append(thin(np.stack((a[cross], b[cross], off[cross]))))
            if sum(x.shape[1] for x in kept) > PAIRS:
                kept = [thin(np.concatenate(kept, axis=1))]
    links = thin(np.concatenate(kept, axis=1))
    return links[0], links[1], np.unique(np.concatenate(left))


def _pieces(anchor: int) -> list[list[int]]:
    """Five pieces of the bits outside the anchor's block (of a fingerprint of 64 bits)."""
    first, bits = BLOCKS[anchor >> 22]
    rest = [i for i in range(64) if not first <= i < first + bits]
    return [rest[k * len(rest) // 5 : (k + 1) * len(rest) // 5] for k in range(5)]


def compare(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, most: int = CONTRACT.bits) -> tuple[pa.Array, pa.Array]:
    """Links (u, v) that connect what is connected at each anchor; rows (fps: n x 1) are ordered by anchor."""
    cut = _runs(anchor)
    size = np.diff(cut)
    group = np.repeat(np.arange(len(size)), size)
    homes = np.flatnonzero(home & (size[group] > 1) & (size[group] <= LARGE))
    links = _connected(_close(fps, homes, cut[group[homes]], size[group[homes]], most))
    for g in np.flatnonzero(size > LARGE).tolist():
        rows = slice(cut[g], cut[g + 1])
        for bits in _pieces(int(anchor[cut[g]])):
            part = _piece(fps[rows, 0], bits)
            order = np.argsort(part, kind="stable")
            own, part = fps[rows][order], part[order]
            begin, end = np.searchsorted(part, part, "left"), np.searchsorted(part, part, "right")
            mine = np.flatnonzero(home[rows][order])
            links += [(order[a] + cut[g], order[b] + cut[g]) for a, b in _connected(_close(own, mine, begin[mine], (end - begin)[mine], most))]
    return _named(fps, links)


def _piece(words: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each word, side by side."""
    part = np.zeros(len(words), U)
    for i, bit in enumerate(bits):
        part |= (words >> U(bit) & U(1)) << U(i)
    return part


def _named(fps: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """A forest of the names of the rows that ``links`` connect."""
    if not links:
        return pa.array([], pa.int64()), pa.array([], pa.int64())
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    nodes, where = np.unique(fps[np.concatenate((a, b)), 0], return_inverse=True)
    root = forest(len(nodes), *np.split(where, 2))
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return names_of(nodes[own][:, None]), names_of(nodes[root[own]][:, None])


#: What a search gives: links (u, v); nodes of links left out (u); and the rows of anchors too large for it.
LINK, OUT, LEFT = 0, 1, 2


#: What a row at an anchor may carry besides its words: with ``CONTRACT`` whether the anchor is its home; in later rounds its component and its finer fingerprint.
CARRIED = {"home": ("boolean", pa.bool_()), "label": ("long", pa.int64()), "fine": ("binary", pa.binary())}


def _found_schema(how: Setting) -> str:
    return f"kind tinyint, u {how.kind}, v {how.kind}, anchor long" + "".join(f", {c} {t}" for c, (t, _) in CARRIED.items()) + "".join(f", {w} long" for w in _words(how))


def _matrix(t, how: Setting) -> np.ndarray:
    return np.stack([t[w].to_numpy() if isinstance(t, pa.Table) else t.column(w).to_numpy(zero_copy_only=False) for w in _words(how)], axis=1).view(U)


def _row(kind: int, n: int, how: Setting, given: dict[str, pa.Array]) -> pa.RecordBatch:
    own = pa.int64() if how.words == 1 else pa.binary()
    kinds = {"u": own, "v": own, "anchor": pa.int64(), **{c: t for c, (_, t) in CARRIED.items()}, **dict.fromkeys(_words(how), pa.int64())}
    columns = [given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *columns], names=["kind", *kinds])


def _found(kind: int, u: pa.Array, v: pa.Array, how: Setting) -> pa.RecordBatch:
    return _row(kind, len(u), how, {"u": u, "v": v})


def _left(t: pa.Table, how: Setting) -> pa.RecordBatch:
    return _row(LEFT, t.num_rows, how, {c: t[c].combine_chunks() for c in t.column_names})


def _placed(nodes: DataFrame, how: Setting, keep: np.ndarray | None) -> DataFrame:
    """anchor, words, and home or what the nodes carry: every node at each of its anchors."""
    words = _words(how)
    carried = [c for c in CARRIED if c in nodes.columns]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = _matrix(b, how)
            step = 30 if carried else 500
            for k in range(0, len(fps), step):
                part = fps[k : k + step]
                anchor, index, home = cover(part) if keep is None else (*masked(part, keep), None)
                own = {"home": pa.array(home)} if keep is None else {c: b.column(c).slice(k, len(part)).take(pa.array(index)) for c in carried}
                columns = {"anchor": pa.array(anchor.astype(np.int64)), **own, **{words[w]: pa.array(part[index, w].view(np.int64)) for w in range(how.words)}}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    more = ["home"] if keep is None else carried
    return nodes.select(*carried, *words).mapInArrow(tidied(replicate), "anchor long" + "".join(f", {c} {CARRIED[c][0]}" for c in more) + "".join(f", {w} long" for w in words))


def fine_fingerprint(hashes: np.ndarray) -> bytes:
    """``FINE`` words of bits of a set of shingle hashes, which tell similarities apart more finely."""
    out = np.zeros(FINE, U)
    if len(hashes):
        with np.errstate(over="ignore"):
            for w in range(FINE):
                ones = np.unpackbits(_mix(hashes + U(w + 1) * _STEP).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[w] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out.tobytes()


def _finer(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, fine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``pairs`` of different labels whose finer fingerprints differ in few bits, with their number."""
    for a, b, _ in pairs:
        cross = np.flatnonzero(label[a] != label[b])
        for k in range(0, len(cross), 20_000):
            x, y = a[cross[k : k + 20_000]], b[cross[k : k + 20_000]]
            off = np.bitwise_count(fine[x] ^ fine[y]).sum(axis=1, dtype=np.int64)
            near = off <= FINE_BITS
            yield x[near], y[near], off[near]


def _compared(t: pa.Table, how: Setting, forests: int | None, starts: np.ndarray, counts: np.ndarray, keep: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Of rows t, each with the rows starts .. starts+counts-1."""
    fps, rows = _matrix(t, how), np.flatnonzero(counts > 0)
    pairs = _close(fps, rows, starts[rows], counts[rows], how.bits)
    if not how.similarity:
        yield _found(LINK, *_named(fps, _connected(pairs)), how)
        return
    if "label" in t.column_names and not t["label"].null_count:
        label = t["label"].to_numpy()
        pairs = _finer(pairs, label, np.frombuffer(b"".join(t["fine"].to_pylist()), U).reshape(-1, FINE))
    else:
        label = _hashed(fps).view(np.int64)
    if forests is None:
        number = (t["anchor"].to_numpy().view(U) & _MASK).astype(np.int64)
        for a, b, _ in pairs:
            own = first_shared(fps[a] ^ fps[b], keep) == number[a]
            yield _found(LINK, names_of(fps[a[own]]), names_of(fps[b[own]]), how)
        return
    a, b, out = candidates(t["anchor"].to_numpy(), fps, label, pairs, forests)
    yield _found(LINK, names_of(fps[a]), names_of(fps[b]), how)
    own = names_of(np.unique(fps[out], axis=0))  # once, at however many anchors
    yield _row(OUT, len(own), how, {"u": own})


def _search(placed: DataFrame, how: Setting, forests: int | None, certain: bool, keep: np.ndarray | None = None) -> DataFrame:
    """What the anchors find; ``certain``: rows are at anchors of ``cover``, homes and visitors."""
    hot, rows = HOT[how.words], 200_000 if certain else 20_000 if "fine" in placed.columns else 60_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, large in key_batches(batches, "anchor", rows, hot):
            if large:
                yield _left(t, how)
            elif certain:
                yield _found(LINK, *compare(t["anchor"].to_numpy(), _matrix(t, how), t["home"].to_numpy(zero_copy_only=False).astype(bool), how.bits), how)
            else:
                cut = _runs(t["anchor"].to_numpy())
                here = np.arange(t.num_rows)
                yield from _compared(t, how, forests, here + 1, np.repeat(cut[1:], np.diff(cut)) - here - 1, keep)

    return placed.repartition("anchor").sortWithinPartitions("anchor", *_words(how)).mapInArrow(tidied(run), _found_schema(how))


def _by_pieces(left: DataFrame, how: Setting) -> DataFrame:
    """Rows of large anchors of ``cover``, each at five anchors more, one for each piece of the bits outside the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, words = b.column("anchor").to_numpy(), b.column("f0").to_numpy().view(U)
            for block in np.unique(anchor >> 22).tolist():
                own = np.flatnonzero(anchor >> 22 == block)
                at = pa.array(own)
                for k, bits in enumerate(_pieces(block << 22)):
                    name = _hashed(np.stack((anchor[own].view(U), _piece(words[own], bits), np.full(len(own), k, U)), axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), b.column("f0").take(at)], names=["anchor", "f0"])

    return left.select("anchor", "f0").mapInArrow(run, "anchor long, f0 long")


def _by_parts(left: DataFrame, how: Setting, forests: int | None, keep: np.ndarray | None) -> DataFrame:
    """What anchors too large for a task find: cut into parts, each pair of parts a cell."""
    hot, words = HOT[how.words], _words(how)
    sizes = left.groupBy("anchor").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*words), F.col("parts")).cast("int")
    cells = left.join(sizes, "anchor").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    number = F.lit(int(_MASK)).cast("long")
    cell = F.xxhash64("anchor", F.least("part", "other"), F.greatest("part", "other")).bitwiseAND(F.bitwise_not(number)).bitwiseOR(F.col("anchor").bitwiseAND(number))
    placed = cells.select(cell.alias("anchor"), "label", "fine", *words, (F.col("part") <= F.col("other")).alias("first"), (F.col("part") == F.col("other")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in key_batches(batches, "anchor", 2 * hot, 1 << 62):
            cut = _runs(t["anchor"].to_numpy())
            size, here = np.diff(cut), np.arange(t.num_rows)
            first, same = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("first", "same"))
            upper = np.add.reduceat(first.astype(np.int64), cut[:-1])  # a cell's first part stands before its second
            start = np.where(same, here + 1, np.repeat(cut[:-1] + upper, size))
            yield from _compared(t, how, forests, start, np.where(first, np.repeat(cut[1:], size) - start, 0), keep)

    return placed.repartition("anchor").sortWithinPartitions("anchor", F.col("first").desc(), *words).mapInArrow(run, _found_schema(how))


def _found_in(nodes: DataFrame, how: Setting, keep: np.ndarray | None, forests: int | None) -> DataFrame:
    """kind, u, v of all anchors, large ones included."""
    found = stored(_search(_placed(nodes, how, keep), how, forests, keep is None, keep), "found")
    left = found.where(F.col("kind") == LEFT)
    if not left.isEmpty():
        if keep is None:
            found = stored(found.where(F.col("kind") != LEFT).unionByName(_search(_by_pieces(left, how), how, forests, False)), "found", found)
            left = found.where(F.col("kind") == LEFT)
        found = stored(found.where(F.col("kind") != LEFT).unionByName(_by_parts(left, how, forests, keep)), "found", found)
    return found


def links(distinct: DataFrame, how: Setting = CONTRACT) -> DataFrame:
    """(u, v) names of fingerprints such that what links of few bits connect is connected, from ``distinct(f0)``."""
    found = _found_in(distinct.select(*_words(how)), how, None, 1)
    return found.where(F.col("kind") == LINK).select("u", "v")


def verified_roots(distinct: DataFrame, sets: Callable[[DataFrame], DataFrame], how: Setting = SIMILAR) -> DataFrame:
    """Stored (node, root) by links of similarity ``how.similarity`` or more, from ``distinct(fp, f0, ...)``; ``sets`` gives (fp, set) of a table of fps."""
    keep = masks(*covering(distinct.count()), how.words)
    nodes, good, root = distinct.select(*_words(how)), None, None
    for forests in ROUNDS:
        found = _found_in(nodes, how, keep, forests)
        pairs = stored(found.where(F.col("kind") == LINK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "candidates")
        own = stored(sets(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()), "sets")
        sweep(distinct.sparkSession)
        judged = stored(_alike(pairs, own, how), "judged", pairs, own)
        new = judged.where("alike").select("u", "v")
        if root is None or not new.isEmpty():
            good = stored(new if good is None else good.unionByName(new), "links", good)
            release(root)
            root = components(good)
        if forests is None:
            release(found, judged)
            break
        out = found.where(F.col("kind") == OUT).select(F.col("u").alias("fp")).distinct()
        again = stored(_open(out, judged.where("not alike"), root), "again", found, judged)
        if again.isEmpty():
            release(again)
            break
        nodes = stored(again.join(_fine(sets(again.select("fp"))), "fp").join(distinct, "fp").select("label", "fine", *_words(how)), "nodes", again)
    release(good)
    return root


def _open(out: DataFrame, failed: DataFrame, root: DataFrame) -> DataFrame:
    """fp and label (of its component) of the nodes ``out(fp)`` whose component has a link of ``failed(u, v)`` to another; ``root(node, root)``."""
    u, v = F.coalesce("ru", "u"), F.coalesce("rv", "v")
    ends = failed.join(root.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(root.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    touched = stored(ends.where(u != v).select(F.explode(F.array(u, v)).alias("root")).distinct(), "touched")
    side = F.broadcast(touched) if touched.count() <= MAX_BROADCAST_NAMES else touched
    rooted = out.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rooted.join(side, "root", "left_semi").select("fp", F.xxhash64("root").alias("label"))


def _fine(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fine_fingerprint(np.frombuffer(x, U)) for x in b.column(1).to_pylist()], pa.binary())], names=["fp", "fine"])

    return sets.mapInArrow(run, "fp binary, fine binary")


def _alike(pairs: DataFrame, own: DataFrame, how: Setting) -> DataFrame:
    """The ``pairs`` (u, v), and whether their sets, by ``own(fp, set)``, are alike enough."""
    both = pairs.join(own.select(F.col("fp").alias("u"), F.col("set").alias("a")), "u").join(own.select(F.col("fp").alias("v"), F.col("set").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            near = [jaccard(a, b) >= how.similarity for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(near, pa.bool_())], names=["u", "v", "alike"])

    return both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary, alike boolean")


def _text_key(text: str) -> list[Column]:
    own = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(own).alias("__d1"), F.xxhash64(F.lit(1), own).alias("__d2")]


def _sets(docs: DataFrame, text: str, one: DataFrame, how: Setting) -> Callable[[DataFrame], DataFrame]:
    """(fp, set of shingle hashes) of one text of each fp; ``one(fp, __d1, __d2)`` says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t, how).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["fp", "set"])

    def sets(names: DataFrame) -> DataFrame:
        wanted = stored(one.join(names, "fp").select("fp", "__d1", "__d2"), "wanted")
        side = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_NAMES else wanted
        found = docs.select(*_text_key(text), F.col(text).cast("binary").alias("t")).join(side, ["__d1", "__d2"])
        return found.groupBy("fp").agg(F.first("t").alias("t")).mapInArrow(run, "fp binary, set binary")

    return sets


def near_groups(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", how: Setting = CONTRACT) -> DataFrame:
    """``keys``, fp, root (of the component) and component_id (its least first key) of every row."""
    words, own = _words(how), _text_key(text) if how.similarity else []
    base = stored(fingerprints(docs.select(*keys, text, *own), [*keys, *(["__d1", "__d2"] if own else [])], text, how), "fingerprints")
    one = [F.min(F.struct("__d1", "__d2")).alias("__one")] if own else []
    least = stored(base.groupBy("fp").agg(F.min(keys[0]).alias("least"), *[F.first(w).alias(w) for w in words], *one), "distinct")
    root = verified_roots(least.select("fp", *words), _sets(docs, text, least.select("fp", "__one.*"), how), how) if own else components(links(least, how))
    rooted = stored(least.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted", least, root)
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    label = stored(rooted.join(ids, "root").select("fp", "root", "component_id"), "labels", rooted, ids)
    return base.join(label, "fp").select(*keys, "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, how: Setting = SIMILAR) -> DataFrame:
    """One row of each group stays: the least doc_id (nulls last); among rows that share it, the one whose row hashes least.

    What is joined back is not the rows that stay, but those that do not: of a broadcast size where they are few, else by a shuffle.
    """
    names = docs.columns
    flat = [F.to_json(F.struct(F.col(f"`{c}`"))) if f.dataType.simpleString().startswith(("map", "array", "struct")) else F.col(f"`{c}`") for c, f in zip(names, docs.schema, strict=True)]
    row = [*flat, *[F.col(f"`{c}`").isNull() for c in names]]
    marked = docs.withColumns({"__k1": F.xxhash64(*row), "__k2": F.xxhash64(F.lit(1), *row)})
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")
    groups = stored(near_groups(marked, ("doc_id", "__k1", "__k2"), how=how).select("root", "doc_id", "__k1", "__k2"), "groups")
    best = groups.groupBy("root").agg(F.min(rank).alias("b")).select("root", F.col("b.__k1").alias("__b1"), F.col("b.__k2").alias("__b2"))
    stays = (F.col("__k1") == F.col("__b1")) & (F.col("__k2") == F.col("__b2"))
    decided = groups.join(stored(best, "best"), "root").groupBy("__k1", "__k2").agg(F.max(stays).alias("__stays"), F.count("*").alias("__n"))
    special = stored(decided.where("not __stays or __n > 1").select("__k1", "__k2", "__stays"), "special", groups)
    side = F.broadcast(special) if special.count() <= MAX_BROADCAST_NAMES else special
    joined = marked.join(side, ["__k1", "__k2"], "left")
    repeated = joined.where("__stays").dropDuplicates(["__k1", "__k2"])
    return joined.where("__stays is null").unionByName(repeated).select(*names)
