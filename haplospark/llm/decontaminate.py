r"""Benchmark decontamination with a broadcast hash set of n-grams.

Items and documents are lower-cased (A-Z) and cut into words.  Every run of 13 consecutive words of an
item is a window; an item of fewer words is one window.  Each document's windows are hashed in place
(64 bits of 13 word hashes) and looked up in the broadcast set of window hashes.  What is found there carries
its words, and is verified word by word against the windows themselves, so a hash collision cannot make a hit: by a
broadcast if the windows are small, else by a join of the few rows that were found.  No document text is
shuffled: what leaves the map side are those rows, and one row for each document, sent along as an
always-found sentinel.

The set has at most ``MAX_BROADCAST_WINDOWS`` hashes; of a larger benchmark, each such part of the set is a pass over the
documents of its own, so a benchmark of any size stays within the bound.

Defined edge cases: a null or empty text has no words and no hits.  An item without words has no
window; an item with a null id hits, but is not counted.  Repeated items count once.  Repeated document
rows (same id and text) each get their own result row; rows with one id but different texts are told
apart by their text.  An empty benchmark or table gives no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.checkpoints import stored
from haplospark.llm.common import recount, split_words, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same as a set for a token, with its leading separators (any case).
_TOKEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
N = 13
#: Hashes of a set: about 60 bytes each, 60 MB.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Bytes of windows and of their items that are broadcast to verify what was found.
MAX_BROADCAST_BYTES = 32 << 20
_SENTINEL = 0x5EED0FD0C5


def document_words(text: Column) -> Column:
    from haplospark.llm.common import ascii_lower

    return split_words(ascii_lower(text_or_empty(text)), SEPARATORS)


def _window_hash(hashes: Column, at: Column | int, n: int) -> Column:
    """Of the ``n`` word hashes from the 0-based ``at`` on."""
    return F.xxhash64(*[F.get(hashes, (at + j) if isinstance(at, Column) else F.lit(at + j)) for j in range(n)])


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """hash, len, win (its words), items (sorted distinct ids) of every distinct window."""
    w = F.col("w")
    each = (
        benchmark.select("item_id", document_words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.explode(F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n))).otherwise(F.array(w))).alias("win"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumns({"len": F.size("win"), "h": F.transform("win", lambda x: F.xxhash64(x))})
    )
    by_len = F.lit(None).cast("long")
    for k in range(1, n + 1):
        by_len = F.when(F.col("len") == k, _window_hash(F.col("h"), 0, k)).otherwise(by_len)
    return each.select(by_len.alias("hash"), "len", "win", "items")


def _scan(docs: DataFrame, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, body_hash, n_words, pos, len, hash, found (words): a row for each window whose hash is in the set, and one with pos 0 for each document."""
    h, w = F.col("h"), F.col("w")
    base = docs.select("doc_id", F.md5(text_or_empty(F.col("text"))).alias("body_hash"), document_words(F.col("text")).alias("w"))
    base = base.withColumns({"n_words": F.size(w), "h": F.transform(w, lambda x: F.xxhash64(x))})
    mark = F.array(F.lit(_SENTINEL).cast("long"))

    def windowed(n: int) -> Column:
        here = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: _window_hash(h, i, n))
        return F.struct(F.lit(n).alias("n"), F.when(F.size(h) >= n, F.concat(mark, here)).otherwise(mark).alias("g"))

    sets = base.select("doc_id", "body_hash", "n_words", "w", windowed(lengths[0]).alias("s")) if len(lengths) == 1 else base.select("doc_id", "body_hash", "n_words", "w", F.explode(F.array(*map(windowed, lengths))).alias("s"))
    rows = sets.select("doc_id", "body_hash", "n_words", "w", F.col("s.n").alias("n"), F.posexplode("s.g").alias("pos", "g"))
    # The sentinel stands at place 0 only; a window with its hash, further on, goes on to be verified.
    found = rows.join(F.broadcast(hashes), (F.col("g") == F.col("hash")) & ((F.col("pos") > 0) | (F.col("g") == _SENTINEL)))
    return found.select("doc_id", "body_hash", "n_words", "pos", F.col("n").alias("len"), "hash", F.when(F.col("pos") > 0, F.slice("w", F.greatest("pos", F.lit(1)), F.col("n"))).alias("found"), (F.col("n") == lengths[0]).alias("first"))


def match(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """A row for each row of ``docs``: doc_id, body_hash, n_words, n_hit, items, hits (array of (pos, len), 1-based words)."""
    table = stored(windows(benchmark, n), "windows")
    size = F.sum(F.octet_length(F.array_join("win", " ")) + 40 * F.size("win") + 40 * F.greatest(F.size("items"), F.lit(1)))
    stats = table.agg(F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes"), F.collect_set("len").alias("lens")).first()
    lengths = sorted(stats["lens"], reverse=True) or [n]
    chunks = max(1, -(-stats["rows"] // MAX_BROADCAST_WINDOWS))
    spark, scanned = docs.sparkSession, None
    sentinel = spark.range(1).select(F.lit(_SENTINEL).cast("long").alias("hash"))
    for k in range(chunks):
        part = _scan(docs, table.where(F.pmod("hash", F.lit(chunks)) == k).select("hash").unionByName(sentinel).distinct(), lengths).withColumn("pass", F.lit(k))
        scanned = part if scanned is None else scanned.unionByName(part)
    known = table.select(F.col("hash").alias("__hash"), F.col("len").alias("__len"), "win", "items")
    verified = (F.col("hash") == F.col("__hash")) & (F.col("len") == F.col("__len")) & (F.col("found") == F.col("win"))
    both = scanned.join(F.broadcast(known) if stats["bytes"] <= MAX_BROADCAST_BYTES else known, verified, "left")
    hits = both.withColumn("hit", F.when(F.col("win").isNotNull(), F.struct("pos", "len")))
    copy = (F.col("pos") == 0) & F.col("first") & (F.col("pass") == 0)
    grouped = hits.groupBy("doc_id", "body_hash").agg(
        F.first("n_words").alias("n_words"),
        F.sum(copy.cast("int")).alias("copies"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc: Column, x: Column) -> Column:
        begin, end = F.greatest(x["pos"], acc["end"] + 1), x["pos"] + x["len"] - 1
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - begin + 1)).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return grouped.select(
        "doc_id", "body_hash", F.col("n_words").cast("long").alias("n_words"), F.aggregate("hits", start, cover)["n"].cast("long").alias("n_hit"),
        "items", "hits", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words stand in benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def cut_words(text: Column, hits: Column) -> Column:
    """``text`` without the words in ``hits`` and the separators before each of them."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    gone = F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))
    # One element that holds both, so that neither is computed again for each word.
    bound = F.array(F.struct(tokens.alias("tokens"), gone.alias("gone")))

    def kept(x: Column) -> Column:
        n = F.size(x["tokens"])
        every = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(F.array_except(every, x["gone"]), lambda i: F.element_at(x["tokens"], i)), "")  # by a hash set, in order

    return F.concat(F.get(F.transform(bound, kept), F.lit(0)), F.regexp_extract(text, _TAIL, 0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without contaminated documents, and the rest without the spans that a benchmark window covers.

    Documents without a hit come back unchanged, with all their columns; n_chars, if there, follows the text.
    """
    names = docs.columns
    hit = match(docs, benchmark, n).where("n_hit > 0").select(
        F.col("doc_id").alias("__id"), F.col("body_hash").alias("__body"), F.col("hits").alias("__hits"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("__bad")
    ).dropDuplicates(["__id", "__body"])
    body = text_or_empty(F.col("text"))
    joined = docs.withColumn("__md5", F.md5(body)).join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__body")), "left")
    clean = joined.where(~F.coalesce("__bad", F.lit(False)))
    cut = clean.withColumn("text", F.when(F.col("__hits").isNull(), F.col("text")).otherwise(cut_words(F.col("text"), F.col("__hits"))))
    return recount(cut, F.col("__hits").isNotNull()).select(*names)
