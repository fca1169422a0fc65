"""Choosing between the two ways to run a traversal.

``KERNEL``: the graph's arrays are broadcast, and each task runs whole vectors through them.  It needs the graph in
the memory of a worker.  ``LEVELS``: one join and one aggregation per level pair, for graphs of any size.
"""

from __future__ import annotations

from enum import Enum

from haplospark.operators.graph import Meta

#: Bytes of arrays that a worker may hold.
WORKER_BYTES = 256 << 20


class Strategy(Enum):
    KERNEL = "kernel"
    LEVELS = "levels"


def structure_bytes(meta: Meta, selector_entries: int | None = None) -> int:
    """Index arrays of edges and selectors: two 8-byte ids each."""
    entries = meta.num_edges + (selector_entries if selector_entries is not None else 2 * meta.num_mutations)
    return 16 * entries


def vector_bytes(meta: Meta) -> int:
    """One vector's node values, operand and result."""
    return 8 * (2 * meta.num_nodes + meta.num_samples + 2 * meta.num_mutations)


def choose(meta: Meta, budget: int = WORKER_BYTES, selector_entries: int | None = None, vectors: int = 1) -> Strategy:
    """``vectors``: how many a task holds at once."""
    return Strategy.KERNEL if structure_bytes(meta, selector_entries) + 2 * vectors * vector_bytes(meta) <= budget else Strategy.LEVELS


def vectors_at_once(meta: Meta, budget: int = WORKER_BYTES, selector_entries: int | None = None) -> int:
    """How many vectors a worker may hold beside the arrays, at least one."""
    return max(1, (budget - structure_bytes(meta, selector_entries)) // (2 * vector_bytes(meta)))
