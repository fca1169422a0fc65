"""URL filters: host/path rules first, then a blocked Bloom filter in front of an exact hash join.

The listed URLs are brought into a canonical form and folded into a blocked Bloom filter: a table
with one row of four 64-bit lanes for each block, built by ``bit_or`` (it combines map-side, so no
key gets hot).

1. Every page looks at one block of the filter, map side, before anything is shuffled.  Distinct canonical URLs that
   pass are written: a barrier, behind which the optimizer cannot move the exact join.
2. An exact hash join of these few with the list removes the false positives.
3. The hits go back to the pages: broadcast, if they are small (their bytes are counted), else by a hash join of the pages that
   passed the filter; pages that did not pass are never shuffled.

Defined edge cases: a null url, or one without ``://``, has an empty host and path, no canonical
form, and is never listed.  Null entries of the list are ignored, repeated ones count once, an empty
list blocks nothing.  Repeated pages are judged each.  Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.checkpoints import stored
from haplospark.llm.common import ascii_lower

#: (verdict, host, path prefix); a handful of configured rules, compiled into one expression.
Rule = tuple[str, str, str]

BITS_PER_URL = 20
BLOCK_BITS = 256
#: A block is 5 longs; the filter is broadcast up to 40 MB, else joined by block.
MAX_BROADCAST_BLOCKS = 1_000_000
#: Bytes of URLs that are broadcast.
MAX_BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, tracking parameters, ``www.``/``m.`` and a final slash go; null if there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", full)


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.  Equal lengths: the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _lanes(key: Column) -> list[Column]:
    """Four masks of two bits each, from 48 bits of one hash."""
    h = F.xxhash64(key)
    bit = lambda k: F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    shl = lambda k: F.call_function("shiftleft", one, bit(k))
    return [shl(2 * i).bitwiseOR(shl(2 * i + 1)) for i in range(4)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks))


def bloom_blocks(listed: DataFrame, n_urls: int) -> tuple[DataFrame, int]:
    """The filter of distinct ``canonical`` values: (block, lane0..lane3), and its number of blocks."""
    n_blocks = max(1, -(-n_urls * BITS_PER_URL // BLOCK_BITS))
    lanes = _lanes(F.col("canonical"))
    blocks = (
        listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *[m.alias(f"lane{i}") for i, m in enumerate(lanes)])
        .groupBy("block")
        .agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(4)])
    )
    return blocks, n_blocks


def passes(pages: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """``pages(canonical, ...)`` and __passes: whether both bits are set in every lane of the URL's block; no page is shuffled where the filter is broadcast."""
    side = blocks.select(F.col("block").alias("__block"), *[F.col(f"lane{i}").alias(f"__lane{i}") for i in range(4)])
    probe = pages.withColumn("__at", _block(F.col("canonical"), n_blocks))
    hit = F.col("canonical").isNotNull()
    for i, m in enumerate(_lanes(F.col("canonical"))):
        hit = hit & (F.col(f"__lane{i}").bitwiseAND(m) == m)
    joined = probe.join(F.broadcast(side) if n_blocks <= MAX_BROADCAST_BLOCKS else side, F.col("__at") == F.col("__block"), "left")
    return joined.select(*pages.columns, F.coalesce(hit, F.lit(False)).alias("__passes"))


def possible_hits(candidates: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Distinct ``canonical`` of ``candidates`` that pass the filter."""
    return passes(candidates.select("canonical"), blocks, n_blocks).where("__passes").select("canonical").distinct()


def _small(urls: DataFrame) -> bool:
    n, size = urls.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0))).first()
    return size + 64 * n <= MAX_BROADCAST_BYTES


def exact_hits(possible: DataFrame, listed: DataFrame) -> DataFrame:
    """The stored, distinct ``canonical`` of ``possible`` that stand in ``listed``, by a hash join on the smaller side."""
    return listed.join(F.broadcast(possible) if _small(possible) else possible.hint("shuffle_hash"), "canonical").select("canonical")


def judge(pages: DataFrame, listed_urls: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed for every row of ``pages(page_id, url)``.

    Rules come first; where none fits, a listed URL is blocked and any other allowed.
    """
    url = F.col("url")
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
        .select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "canonical")
        .withColumns({"rule": rule, "ruled": verdict})
    )
    listed = stored(listed_urls.select(canonical_url(F.col("url")).alias("canonical")).where("canonical is not null").distinct(), "listed")
    blocks, n_blocks = bloom_blocks(listed, listed.count())
    blocks = stored(blocks, "bloom")
    possible = stored(possible_hits(judged, blocks, n_blocks), "possible")
    hits = stored(exact_hits(possible, listed), "hits", possible, listed)
    there = hits.withColumn("listed", F.lit(True))
    if _small(hits):
        joined = judged.join(F.broadcast(there), "canonical", "left")
    else:
        probed = passes(judged, blocks, n_blocks)
        rest = probed.where("not __passes").withColumn("listed", F.lit(None).cast("boolean"))
        joined = probed.where("__passes").join(there.hint("shuffle_hash"), "canonical", "left").unionByName(rest)
    on_list = F.coalesce("listed", F.lit(False))
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(on_list, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "canonical", on_list.alias("listed"),
    )
