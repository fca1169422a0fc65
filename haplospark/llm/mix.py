"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are counted by membership pattern (the set of sources they belong to): a small table.
2. Words flow from patterns to the quotas of their sources.  A pattern has one arc for each time it may
   be used up, and the k-th time costs k, so repetition costs are convex: no pattern is repeated while
   another that can serve the same quota is fresh.  Successive shortest paths solve it on the driver, which holds
   one row for each pattern, whatever their number: patterns that find room in one of their own sources are routed at
   once, and only the rest need a search.
3. Each pattern's flow is k whole epochs and a rest.  Documents of the pattern are dealt by a seeded
   hash; the rest takes those with the lowest hashes.  The limit is found by histograms of the hash, 256
   bins at a time: only the bin where the limit falls is opened further, so no task ever sorts or sums up a
   source.  The gap that the document on the limit leaves is filled by further rounds among documents that
   still fit.  What is known of the limits is one small row for each pattern; it is broadcast (beyond
   ``MAX_BROADCAST_PATTERNS`` joined), and every document decides for itself.

Defined edge cases: a null text has size 0 and takes nothing; a null source is a source of its own, last
in order; an empty table gives an empty mix.  Rows that repeat both id and text share a hash and are taken together, or, where they
do not all fit, passed over.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.checkpoints import stored
from haplospark.llm.common import split_words

#: Membership patterns (of about a hundred bytes) that are broadcast.
MAX_BROADCAST_PATTERNS = 100_000
ROUNDS = 4
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.size(split_words(text, r"[\x20\x09-\x0D]+")).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], total: float, cap: int = 2) -> list[float]:
    """Targets by weight that sum to ``total``; none above ``cap`` times its size, the excess reshared by weight."""
    targets, rem, wsum, capped = [0.0] * len(sizes), float(total), sum(weights), True
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        capped = capped and rem * weights[i] > cap * sizes[i] * wsum
        if capped:
            targets[i] = float(cap * sizes[i])
            rem, wsum = rem - cap * sizes[i], wsum - weights[i]
        else:
            targets[i] = weights[i] * rem / wsum
    return targets


def route(patterns: dict[tuple, int], quotas: dict, epochs: int = 2) -> dict[tuple[tuple, object], int]:
    """Words from each pattern to each of its sources: a maximal flow of least cost, the k-th use of a pattern costing k.

    As a use's cost hangs on the pattern alone, a shortest augmenting path starts at a pattern whose next
    use is cheapest, and goes through arcs already used.
    """
    names, goals = sorted(patterns, key=str), sorted(quotas, key=str)
    flow = {(p, s): 0 for p in names for s in p if s in quotas}
    left = {s: int(quotas[s]) for s in goals}
    for k in range(epochs):  # each round at cost k+1; earlier rounds may be rerouted, never repeated
        room = {p: patterns[p] for p in names}
        for p, s in flow:  # what needs no search
            pushed = min(room[p], left[s])
            flow[p, s] += pushed
            room[p] -= pushed
            left[s] -= pushed
        if not any(left.values()):
            break
        while True:
            before: dict = {}
            heap = [(0, str(p), ("p", p)) for p in names if room[p] > 0]
            seen = {x[2] for x in heap}
            heapq.heapify(heap)
            end = None
            while heap and end is None:
                d, _, node = heapq.heappop(heap)
                if node[0] == "p":
                    step = [("s", s) for s in node[1] if s in left]
                elif left[node[1]] > 0:
                    end = node
                    break
                else:
                    step = [("p", p) for p in names if flow.get((p, node[1]), 0) > 0]
                for x in step:
                    if x not in seen:
                        seen.add(x)
                        before[x] = node
                        heapq.heappush(heap, (d + 1, str(x[1]), x))
            if end is None:
                break
            path = [end]
            while path[-1] in before:
                path.append(before[path[-1]])
            path.reverse()
            pushed = min(room[path[0][1]], left[end[1]], *[flow[b[1], a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1], b[1]] += pushed
                else:
                    flow[b[1], a[1]] -= pushed
            room[path[0][1]] -= pushed
            left[end[1]] -= pushed
    return flow


def prepared(docs: DataFrame, sources: Column, seed: str = SEED) -> DataFrame:
    """``docs`` with __pattern (its distinct sources, as JSON), __size and __hash."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.withColumns({"__pattern": F.coalesce(F.to_json(F.array_sort(F.array_distinct(sources))), F.lit("[null]")), "__size": text_size(F.col("text")), "__hash": digest})


def _limit(rows: DataFrame, rest: dict[str, int]) -> dict[str, tuple[str, int]]:
    """For each pattern a hash such that all rows below it fit into ``rest``, and the words that are left."""
    spark = rows.sparkSession
    limits, at = {p: ("g", r) for p, r in rest.items()}, {p: ("", r) for p, r in rest.items()}
    for depth in range(2, 33, 2):
        if not at:
            break
        opened = _sent(spark, [(p, *x) for p, x in at.items()], "p string, prefix string, left long")
        here = rows.join(opened, (F.col("__pattern") == F.col("p")) & F.startswith(F.col("__hash"), F.col("prefix")))
        bins = here.groupBy("p", "left", F.substring("__hash", 1, depth).alias("bin")).agg(F.sum("__size").alias("n"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("p").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most 256 bins
        over = F.when(F.col("upto") > F.col("left"), F.struct("bin", (F.col("upto") - F.col("n")).alias("before"), "rows"))
        after = {}
        for r in bins.withColumn("upto", upto).groupBy("p", "left").agg(F.min(over).alias("first"), F.sum("n").alias("n")).collect():  # a row for each pattern
            first, p = r["first"], r["p"]
            limits[p] = (first["bin"], r["left"] - first["before"]) if first else (limits[p][0], r["left"] - r["n"])
            if first and first["rows"] > 1:
                after[p] = limits[p]
        at = after
    return limits


def plan(rows: DataFrame, weight: Callable[[list], list[int]], ratio: float = 1.5, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two small tables for ``rows`` (as ``prepared`` gives them): by pattern, and by source.

    ``weight`` maps the ordered sources (code points, null last) to their weights.  The targets share ``ratio``
    times all words; none is above ``cap`` times its source's words, and no document is taken over ``cap`` times.
    """
    spark = rows.sparkSession
    patterns = {r["__pattern"]: int(r["n"]) for r in rows.groupBy("__pattern").agg(F.sum("__size").alias("n")).collect()}
    members = {p: tuple(json.loads(p)) for p in patterns}
    sources = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    words: dict = dict.fromkeys(sources, 0)
    for p, m in members.items():
        for s in m:
            words[s] += patterns[p]
    sizes = [words[s] for s in sources]
    targets = water_fill(sizes, weight(sources), ratio * sum(patterns.values()), cap)
    flow = route({members[p]: n for p, n in patterns.items()}, {s: int(t) for s, t in zip(sources, targets, strict=True)}, cap)
    take = {p: sum(flow.get((m, s), 0) for s in m) for p, m in members.items()}
    whole = {p: take[p] // n if n else 0 for p, n in patterns.items()}
    rest = {p: take[p] - whole[p] * n for p, n in patterns.items()}
    rounds: list[dict[str, tuple[int, str]]] = []
    for _ in range(ROUNDS):
        rest = {p: r for p, r in rest.items() if r > 0}
        if not rest:
            break
        state = _sent(spark, _state(patterns, whole, rounds), _state_schema(len(rounds)))
        room = _sent(spark, list(rest.items()), "p string, room long")
        open_ = apply_plan(rows, state).where("__extra = 0 and not __passed").join(room, F.col("__pattern") == F.col("p")).where("__size > 0 and __size <= room").select("__pattern", "__hash", "__size")
        limits = _limit(open_, rest)
        rounds.append({p: (rest[p], limits[p][0]) for p in rest})
        rest = {p: limits[p][1] for p in rest}
    by_source = [(s, n, t) for s, n, t in zip(sources, sizes, targets, strict=True)]
    return (
        _sent(spark, _state(patterns, whole, rounds), _state_schema(len(rounds))),
        _sent(spark, by_source, "__source string, source_size long, target double"),
    )


def _sent(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's, broadcast where it has few rows."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_PATTERNS else df


def _state(patterns: dict, whole: dict, rounds: list) -> list[tuple]:
    return [(p, whole[p], *[x for r in rounds for x in r.get(p, (0, ""))]) for p in patterns]


def _state_schema(rounds: int) -> str:
    return "__p string, __whole long" + "".join(f", __room{k} long, __limit{k} string" for k in range(rounds))


def apply_plan(rows: DataFrame, by_pattern: DataFrame) -> DataFrame:
    """``rows`` and __whole, __extra: how often the mix takes each document, in whole epochs and besides; and __passed: whether it was passed over.

    Rows on a round's limit, which do not fit together, are passed over by later rounds.
    """
    extra, passed, k = F.lit(0), F.lit(False), 0
    while f"__room{k}" in by_pattern.columns:
        fits = (F.col("__size") > 0) & (F.col("__size") <= F.col(f"__room{k}")) & (F.col("__hash") < F.col(f"__limit{k}")) & ~passed
        extra = F.when((extra == 0) & fits, 1).otherwise(extra)
        passed, k = passed | F.coalesce(F.col("__hash") == F.col(f"__limit{k}"), F.lit(False)), k + 1
    out = rows.join(by_pattern, F.col("__pattern") == F.col("__p"), "left")
    return out.select(*rows.columns, "__whole", extra.alias("__extra"), passed.alias("__passed"))


def mix(docs: DataFrame, sources: Column, weight: Callable[[list], list[int]], ratio: float = 1.5, cap: int = 2, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with __pattern, __size, __hash and copies, the table of sources with their targets)."""
    rows = prepared(docs, sources, seed)
    small = stored(rows.select("__pattern", "__size", "__hash"), "sizes")
    by_pattern, by_source = plan(small, weight, ratio, cap)
    taken = apply_plan(rows, by_pattern)
    return taken.withColumn("copies", F.when(F.col("__size") > 0, F.col("__whole") + F.col("__extra")).otherwise(0)).drop("__whole", "__extra", "__passed"), by_source


def mixed(docs: DataFrame, sources: Column, weight: Callable[[list], list[int]]) -> DataFrame:
    """The documents that the mix takes, with all their columns, and copies: how often (a column of that name gives way)."""
    docs = docs.drop("copies")
    taken, _ = mix(docs, sources, weight)
    return taken.where("copies > 0").select(*docs.columns, F.col("copies").cast("int").alias("copies"))
