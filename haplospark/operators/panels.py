"""Tall matrices over individuals that no machine holds whole: pieces of some individuals and one column each.

Where an operator takes whole columns, pieces of a column come together in a task; where columns meet each other (products, orthonormal bases), those of the
same individuals do.  What comes to the driver are matrices of columns by columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.checkpoints import release, stored
from haplospark.schema import VECTOR

#: Individuals of a piece.
PEOPLE = 65_536
_PIECES = "part int, col int, v binary"


def _pieces(part: int, matrix: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": np.full(matrix.shape[1], part, np.int32), "col": np.arange(matrix.shape[1], dtype=np.int32), "v": [np.ascontiguousarray(c).tobytes() for c in matrix.T]})


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    """individuals x columns of one part."""
    return np.column_stack([np.frombuffer(b, float) for b in frame.sort_values("col")["v"]])


@dataclass(frozen=True, eq=False)
class Panel:
    """``table``: part, col, v (doubles of the part's individuals); ``people``: individuals of a part."""

    table: DataFrame
    n: int
    k: int
    people: int

    @classmethod
    def random(cls, spark: SparkSession, n: int, k: int, seed: int) -> Panel:
        """Standard normals, which hang on the seed and the part alone."""
        people = PEOPLE

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in (p for f in frames for p in f["id"].tolist()):
                yield _pieces(part, np.random.default_rng([seed, part]).standard_normal((min(people, n - part * people), k)))

        parts = -(-n // people)
        return cls(stored(spark.range(0, parts, 1, parts).mapInPandas(draw, _PIECES), "panel"), n, k, people)

    def release(self) -> None:
        release(self.table)

    def applied(self, by_column: Callable[[np.ndarray], np.ndarray]) -> Panel:
        """``by_column`` (1 x n -> 1 x n) of each column, one task a column."""
        people = self.people

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            whole = np.concatenate([np.frombuffer(b, float) for b in frame.sort_values("part")["v"]])
            out = by_column(whole[None, :])[0]
            parts = np.arange(len(frame), dtype=np.int32)
            return pd.DataFrame({"part": parts, "col": np.full(len(parts), frame["col"].iloc[0], np.int32), "v": [out[p * people : (p + 1) * people].tobytes() for p in parts]})

        return Panel(stored(self.table.groupBy("col").applyInPandas(run, _PIECES), "panel"), self.n, self.k, people)

    def orthonormal(self) -> Panel:
        """An orthonormal basis of the columns' span: a QR for each part, then one of the parts' small factors."""

        def cut(frame: pd.DataFrame) -> pd.DataFrame:
            q, r = np.linalg.qr(_matrix(frame))
            part = int(frame["part"].iloc[0])
            return pd.concat([_pieces(part, q), pd.DataFrame({"part": np.array([part], np.int32), "col": np.array([-1], np.int32), "v": [r.tobytes()]})])

        own = stored(self.table.groupBy("part").applyInPandas(cut, _PIECES), "factors")
        small = sorted((r["part"], np.frombuffer(r["v"], float).reshape(-1, self.k)) for r in own.where("col < 0").collect())  # columns x columns for each part
        turn, _ = np.linalg.qr(np.vstack([r for _, r in small]))
        ends = np.cumsum([len(r) for _, r in small])
        turns = {p: turn[end - len(r) : end] for (p, r), end in zip(small, ends, strict=True)}
        sent = own.sparkSession.sparkContext.broadcast(turns)
        out = own.where("col >= 0").groupBy("part").applyInPandas(lambda f: _pieces(int(f["part"].iloc[0]), _matrix(f) @ sent.value[int(f["part"].iloc[0])]), _PIECES)
        return Panel(stored(out, "panel", own), self.n, min(self.n, self.k), self.people)

    def times(self, small: np.ndarray) -> Panel:
        """The panel times a matrix of few columns."""
        turned = self.table.groupBy("part").applyInPandas(lambda f: _pieces(int(f["part"].iloc[0]), _matrix(f) @ small), _PIECES)
        return Panel(stored(turned, "panel"), self.n, small.shape[1], self.people)

    def with_other(self, other: Panel, summed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over parts of ``summed`` of both panels' parts."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"v": [summed(_matrix(frame[~frame["other"]]), _matrix(frame[frame["other"]])).tobytes()]})

        both = self.table.withColumn("other", F.lit(False)).unionByName(other.table.withColumn("other", F.lit(True)))
        return np.sum([np.frombuffer(r["v"], float) for r in both.groupBy("part").applyInPandas(run, "v binary").collect()], axis=0)

    def array(self) -> np.ndarray:
        """n x k; only for few columns."""
        out = np.zeros((self.n, self.k))
        for r in self.table.toLocalIterator():
            out[r["part"] * self.people : (r["part"] + 1) * self.people, r["col"]] = np.frombuffer(r["v"], float)
        return out

    def vectors(self) -> DataFrame:
        """row, id, value."""
        people = self.people

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, col, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    value = np.frombuffer(v, float)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), col, np.int32)), pa.array(part * people + np.arange(len(value))), pa.array(value)], names=["row", "id", "value"])

        return self.table.select("part", "col", "v").mapInArrow(run, VECTOR)


def randomized(spark: SparkSession, by_column: Callable[[np.ndarray], np.ndarray], n: int, k: int, oversample: int = 40, power: int = 10, seed: int = 2026) -> tuple[np.ndarray, Panel, np.ndarray]:
    """(values, vectors, relative residuals) of the largest eigenpairs: ``solvers.randomized``, with the block in pieces."""

    def basis(panel: Panel) -> Panel:
        out = panel.orthonormal()
        panel.release()
        return out

    q = basis(Panel.random(spark, n, min(n, k + oversample), seed))
    for _ in range(power + 1):
        image = q.applied(by_column)
        q.release()
        q = basis(image)
    image = q.applied(by_column)
    small = q.with_other(image, lambda x, y: x.T @ y).reshape(q.k, q.k)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(values)[::-1][:k]
    values, turn = values[top], turn[:, top]
    off = q.with_other(image, lambda x, y: ((y @ turn - x @ turn * values) ** 2).sum(axis=0))
    vectors = q.times(turn)
    q.release()
    image.release()
    return values, vectors, np.sqrt(off) / np.maximum(np.abs(values), 1e-300)
