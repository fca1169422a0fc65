r"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

1. Tokens.  A text is cut into runs of letters (any byte from 0x80 on counts as one), digits and marks.  A run of
   letters gives two tokens: its lower-cased form, and its shape (upper, title, lower); a repeated word gives a
   third.  Tokens are hashed to ``SLOTS`` slots, so the table of word vectors has a fixed size.
2. Random indexing.  Each slot has a sparse ternary index vector, made from its number.  The word vector of a slot
   is the sum of the index vectors of all tokens within ``WINDOW`` places, over the whole corpus, less what a token at
   large would have, scaled to length one.  Every task adds up its own table of ``SLOTS`` x ``ROW`` counts; tables
   are summed block by block (two levels, salted).
3. A document is the mean of its tokens' word vectors, and the norm of that mean.
4. A two-layer network (numpy, Adam, fixed seed) learns the labels from at most ``MAX_LABELLED`` rows, those whose
   hashed id is lowest; one fifth of them is set aside, and a temperature is fitted there so that scores are calibrated.

Neither lang, source nor doc_id is an input of a score; doc_id only says which labels may be learned from.

Defined edge cases: null, empty and blank texts have no token; they share one score, that of the zero vector.
Null labels and labels of unknown documents are ignored; a label given several times counts once, the least quality
wins; of a document with several texts the one with the least MD5 is learned from.  With labels of one class only, or none, the score is that class's smoothed share.  Repeated rows get
equal scores.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from haplospark.checkpoints import stored
from haplospark.llm.common import tidied

SLOTS = 1 << 13
DIM = 48
NONZERO = 2
WINDOW = 2
#: Labelled rows that are learned from, at most.
MAX_LABELLED = 20_000
HIDDEN = 24
EPOCHS = 40
#: Weight decay is this over the number of rows learned from (a normal prior on the weights).
DECAY = 3.0
THRESHOLD = 0.3
BLOCK = 256
#: Of a slot's table: the sums of index vectors, and how often it occurs.
ROW = DIM + 1
SALTS = 16
#: Bytes of text worked on at once: its arrays stay in a core's cache.
CHUNK = 1 << 17
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: U) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _index_table() -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of the ``NONZERO`` nonzero entries of each slot's index vector."""
    h = _mix(np.arange(1, SLOTS * NONZERO + 1, dtype=U)).reshape(SLOTS, NONZERO)
    return (h % U(DIM)).astype(np.int64), np.where(h >> U(40) & U(1), 1, -1)


PLACE, SIGN = _index_table()
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def _tokens(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of the tokens of texts that end at ``ends`` in ``buf``, in order."""
    kind = _CLASS[buf]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    cut = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (text[1:] != text[:-1]))))
    stop = np.append(cut[1:], len(buf))
    real = kind[cut] > 0
    cut, stop = cut[real], stop[real]
    upper = (buf >= 65) & (buf <= 90)
    low = np.where(upper, buf + 32, buf)
    power = _powers(len(buf) + 1, BASE)
    sums = np.concatenate((np.zeros(1, U), np.cumsum((low.astype(U) + U(1)) * power[:-1], dtype=U)))
    word = _mix((sums[stop] - sums[cut]) * _powers(len(buf), INVERSE)[cut])
    capitals = np.concatenate(([0], np.cumsum(upper)))
    count, length = capitals[stop] - capitals[cut], stop - cut
    letters = kind[cut] == 1
    shape = np.where(count == 0, 0, np.where((count == length) & (length > 1), 2, 1))
    before = np.zeros(len(cut), bool)
    if len(cut) > 1:
        owner = text[cut]
        before[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    of = np.where(letters, 2, 1) + before
    at = np.cumsum(of) - of
    slot = np.empty(int(of.sum()), np.int64)
    slot[at] = (word % U(SLOTS - 4)).astype(np.int64) + 4
    slot[(at + 1)[letters]] = shape[letters]
    slot[(at + of - 1)[before]] = 3
    return slot, np.repeat(text[cut], of)


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, ends, first text, last text + 1) of groups of texts of about ``CHUNK`` bytes; a longer text is a group of its own."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + CHUNK, "right")) - 1)
        yield body[offset[i] : offset[j]], offset[i + 1 : j + 1] - offset[i], i, j
        i = j


def _count(table: np.ndarray, slot: np.ndarray, text: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours, and one."""
    table[DIM::ROW] += np.bincount(slot, minlength=SLOTS)
    for d in range(1, WINDOW + 1):
        same = text[d:] == text[:-d]
        a, b = slot[:-d][same], slot[d:][same]
        for left, right in ((a, b), (b, a)):
            for k in range(NONZERO):
                table += np.bincount(left * ROW + PLACE[right, k], SIGN[right, k], SLOTS * ROW).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIM, from sums over the whole corpus; of a fixed size whatever the input."""
    rows = docs.select(F.col(text).cast("binary").alias("t"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slots, texts, n = np.zeros(SLOTS * ROW, np.int64), [], [], 0
        salt = None
        for b in batches:
            for buf, ends, _, _ in _chunks(b.column(0)):
                if not len(buf):
                    continue
                slot, own = _tokens(buf, ends)
                salt = int(ends[-1]) % SALTS if salt is None else salt
                slots.append(slot)
                texts.append(own + n)
                n += len(ends)
                if sum(map(len, slots)) > 500_000:
                    _count(table, np.concatenate(slots), np.concatenate(texts))
                    slots, texts = [], []
        if slots:
            _count(table, np.concatenate(slots), np.concatenate(texts))
        if salt is not None:
            yield _blocks(table, salt)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                sums[block] = sums[block] + own if block in sums else own
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["block", "salt", "counts"])

    schema = "block int, salt int, counts binary"
    sums = rows.mapInArrow(tidied(partial), schema).repartition("block", "salt").mapInArrow(total, schema).repartition("block").mapInArrow(total, schema)
    table = np.zeros((SLOTS // BLOCK, BLOCK * ROW), np.float64)
    for r in stored(sums, "counts").collect():  # SLOTS / BLOCK rows
        table[r["block"]] += np.frombuffer(r["counts"], np.int64)
    return from_counts(table.reshape(SLOTS, ROW))


def from_counts(table: np.ndarray) -> np.ndarray:
    """Word vectors of length one: how a slot's contexts differ from those of a token at large, shrunk where it is rare."""
    sums, n = table[:, :DIM], table[:, DIM:]
    usual = sums.sum(0) / max(1.0, float(n.sum()))
    away = (sums - n * usual) / (n + 50)
    size = np.linalg.norm(away, axis=1, keepdims=True)
    return (away / np.where(size == 0, 1, size)).astype(np.float32)


def _blocks(table: np.ndarray, salt: int) -> pa.RecordBatch:
    parts = table.reshape(SLOTS // BLOCK, BLOCK * ROW)
    used = np.flatnonzero(parts.any(axis=1)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["block", "salt", "counts"])


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """n x (DIM + 1): the mean word vector of each text, and its norm."""
    out = np.zeros((len(column), DIM + 1), np.float64)
    for buf, ends, i, _ in _chunks(column):
        if not len(buf):
            continue
        slot, own = _tokens(buf, ends)
        for at in range(0, len(slot), CHUNK):
            s, o = slot[at : at + CHUNK], own[at : at + CHUNK]
            first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            out[i + o[first], :DIM] += np.add.reduceat(vectors[s], first, axis=0)
        n = np.bincount(own, minlength=len(ends))
        out[i : i + len(ends), :DIM] /= np.maximum(n, 1)[:, None]
    out[:, DIM] = np.linalg.norm(out[:, :DIM], axis=1)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, decay: float = DECAY, seed: int = 7) -> Model:
    """The network on four fifths of the rows, its temperature on the rest."""
    d = x.shape[1] if len(x) else DIM + 1
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(vectors, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, fit = order[: len(x) // 5], order[len(x) // 5 :]
    m = Model(vectors, x[fit].mean(0), x[fit].std(0) + 1e-6, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - m.mean) / m.scale
    decay /= len(fit)
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for k in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            hidden = np.maximum(z[k] @ params[0] + params[1], 0)
            err = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - y[k]) / len(k)
            back = np.outer(err, params[2]) * (hidden > 0)
            grads = [z[k].T @ back + decay * params[0], back.sum(0), hidden.T @ err + decay * params[2], np.array([err.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 0.005 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(aside):
        raw = m.logits(x[aside])
        ones = float(y[aside].sum())
        soft = np.where(y[aside] == 1, (ones + 1) / (ones + 2), 1 / (len(aside) - ones + 2))  # as if one more of each class had been seen
        m.temperature = min(np.geomspace(0.5, 16, 61).tolist(), key=lambda t: _loss(raw / t, soft))
    return m


def in_fold(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the whole corpus' word vectors and the labels outside fold 0."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = stored(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled), "sample")
    sent = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool(b.column(3), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.float64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "h", "y", "x"])

    # The sample has at most max_labelled rows of two numbers.
    picked = docs.join(F.broadcast(sample), "doc_id").select(F.md5(F.col("doc_id").cast("string")).alias("k"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), "quality", F.col("text").cast("binary").alias("t"))
    one = picked.mapInArrow(tidied(pooled), "k string, h string, y double, x binary").groupBy("k").agg(F.min(F.struct("h", "y", "x")).alias("r"))
    rows = stored(one.select("k", "r.y", "r.x"), "learned").orderBy("k").collect()  # at most max_labelled rows
    x = np.array([np.frombuffer(r["x"], np.float64) for r in rows]).reshape(len(rows), DIM + 1)
    return train(vectors, x, np.array([r["y"] for r in rows], np.float64))


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keys`` and the score, called ``name``, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keys, F.col(text).cast("binary").alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(pool(b.column(len(keys)), sent.value.vectors))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*keys, name])

    return rows.mapInArrow(tidied(run), StructType([*[rows.schema[k] for k in keys], StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; all columns stay."""
    names = docs.columns
    model = fit(docs, labels)
    rows = docs.withColumn("__scored", F.col("text"))
    # Written here, so that workers get small batches whatever the session says.
    return stored(score(rows, model, names, "__scored", "__score").where(F.col("__score") >= threshold).select(*names), "good")
