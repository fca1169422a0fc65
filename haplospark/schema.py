"""Explicit schemas of all tables, and the few enumerations of the public interface."""

from __future__ import annotations

from enum import Enum

EDGES = "parent bigint, child bigint, dst_level int, src_level int"
NODES = "node_id bigint, level int, pos bigint, is_sample boolean, coal_count bigint"
SELECTOR = "mutation_id bigint, node_id bigint"
MUTATIONS = "mutation_id bigint, position double, time double, allele string, ref_allele string"
SAMPLES = "sample_id bigint, individual_id bigint"
#: One row of an operand or result: vector number, sample / individual / mutation / node, value.  What is absent is 0.
VECTOR = "row int, id bigint, value double"
META = (
    "magic string, version int, num_samples bigint, num_individuals bigint, num_mutations bigint, num_nodes bigint, "
    "num_edges bigint, ploidy int, height int, has_missing boolean, has_coalescence boolean"
)
BLOCKS = "dst_level int, src_level int, nrows bigint, ncols bigint, nnz bigint"
SELECTOR_STATS = "level int, mut_nnz bigint, miss_nnz bigint"
BIAS = "kind string, id bigint, vec_bias double, xtx_bias double"


class Direction(Enum):
    """``UP``: samples to mutations (V·X).  ``DOWN``: mutations to samples (V·Xᵀ)."""

    UP = "up"
    DOWN = "down"

    @classmethod
    def parse(cls, value: Direction | str) -> Direction:
        if isinstance(value, cls):
            return value
        if not isinstance(value, str):
            raise TypeError(f"direction must be a string or a Direction, not {type(value).__name__}")
        try:
            return cls(value.strip().lower())
        except ValueError:
            raise ValueError(f"direction must be 'up' or 'down', not {value!r}") from None


class InitMode(Enum):
    """What nodes hold before the operand is added."""

    NONE = "none"
    VECTOR = "vector"
    MATRIX = "matrix"
    XTX = "xtx"

    @classmethod
    def parse(cls, value: InitMode | str | None) -> InitMode:
        if value is None:
            return cls.NONE
        if isinstance(value, cls):
            return value
        if not isinstance(value, str):
            raise TypeError(f"init mode must be a string, not {type(value).__name__}")
        try:
            return cls(value.strip().lower())
        except ValueError:
            raise ValueError(f"init mode must be one of none, vector, matrix, xtx, not {value!r}") from None
