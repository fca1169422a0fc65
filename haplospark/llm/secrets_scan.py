r"""Secret scans with an incremental blob ledger.

Every text is addressed by its SHA-256.  A ledger holds, for each (blob, rule, version) scanned so far, the spans found.
A scan goes by keys first: 32-byte names of blobs, with flags of which rules may match, less the (blob, rule, version) pairs that the
ledger has.  Bodies are fetched only for unseen pairs whose rule may match, one for each blob; all other unseen pairs
are entered as empty.  Findings are joined back to all documents ("paths") and versions with that content.  So copies are
scanned once, unchanged versions never again, and a new rule version alone is run over old blobs.

Positions come from the built-in regular expressions alone: the text split at a rule gives the gaps, and the matches themselves
stand between them; a running sum of lengths over (blob, rule) gives every position.  All steps are linear in the text and its findings.
Positions are code points, the end exclusive.

Masking cuts a text into chunks of ``CHUNK`` code points, and spans at the borders of chunks, so each chunk is masked by itself.

Defined edge cases: a null text is the empty text (no findings).  Repeated rows, or equal texts under
several ids, share one blob and get its findings each.  An empty table gives an empty result.  Only
the columns asked for are read, so other columns may have any names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.checkpoints import release, shared_dir, stored, there
from haplospark.llm.common import recount, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one capturing group, the value.  A match counts if its value has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    version: int = 1
    #: The rule can only match a text that holds one of these (compared in lower case).
    hints: tuple[str, ...] = ()
    #: The same without a group and with the least length inside; for rules whose value is the whole match, where no match that is too short holds a longer one.
    quick: str | None = None

    @property
    def whole(self) -> bool:
        """The value is the whole match."""
        return self.pattern.startswith("(") and not self.pattern.startswith("(?") and self.pattern.endswith(")")

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
BASE_RULES = (
    Rule("assign", rf"(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"(AKIA[A-Z0-9]+)", 20, hints=("akia",), quick=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"([0-9a-f]+)", 24, quick=r"[0-9a-f]{24,}"),
)
#: What the method adds: formats with a published, unmistakable prefix.
MORE_RULES = (
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/= \t\r\n]*)", 27, hints=("-----begin",)),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 36, hints=("eyj",)),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]+)", 40, hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 15, hints=("xox",)),
    Rule("google", r"(AIza[A-Za-z0-9_-]+)", 39, hints=("aiza",)),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:int,rank:int,kind:string,end:int>"
#: Code points that are masked at once, and bytes of masked texts that are joined back by a broadcast.
CHUNK, MAX_BROADCAST_BYTES = 512, 32 << 20
#: Names of blobs (about 150 bytes each, with their rules) that are broadcast to fetch their bodies.
MAX_BROADCAST_BLOBS = 200_000
LEDGER_SCHEMA = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap,whole,value>>: lengths of each match, of what stands before it, and of its value, in order."""
    pattern = rule.quick or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if rule.whole else F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    length = lambda c, name: F.transform(c, F.char_length).alias(name)
    zipped = F.arrays_zip(length(F.split(text, pattern, -1), "gap"), length(found, "whole"), length(value, "value"))
    return F.filter(zipped, lambda m: m["whole"].isNotNull())  # behind the last match is one gap more


def may_match(text: Column, low: Column, rule: Rule) -> Column:
    """A cheap test that no text with a finding fails."""
    if not rule.hints:
        return text.rlike(rule.quick or rule.pattern)
    hit = F.lit(False)
    for h in rule.hints:
        hit = hit | F.contains(low, F.lit(h))
    return hit


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob, todo: (rule:version, whether it may match) of every pair that the ledger lacks; blobs with none are left out.  No body is shuffled."""
    own = docs.select(blob_of(F.col(text)).alias("blob"), text_or_empty(F.col(text)).alias("body")).withColumn("low", F.lower("body"))
    pairs = F.array(*[F.struct(F.lit(r.key).alias("rule"), may_match(F.col("body"), F.col("low"), r).alias("may")) for r in rules])
    blobs = own.groupBy("blob").agg(F.first(pairs).alias("todo"))
    if ledger is None:
        return blobs
    seen = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    left = F.filter("todo", lambda p: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), p["rule"]))
    return blobs.join(seen, "blob", "left").select("blob", left.alias("todo")).where(F.size("todo") > 0)


def scan_blobs(docs: DataFrame, todo: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob, rule:version, spans: the non-empty ones of the pairs in ``todo`` (as ``unseen`` gives them)."""
    wanted = todo.select("blob", F.transform(F.filter("todo", lambda p: p["may"]), lambda p: p["rule"]).alias("run")).where(F.size("run") > 0)
    bodies = docs.select(blob_of(F.col(text)).alias("blob"), text_or_empty(F.col(text)).alias("body"))
    if wanted.count() <= MAX_BROADCAST_BLOBS:
        wanted = F.broadcast(wanted)
    else:  # bodies that no rule may match stay where they are
        may = F.lit(False)
        for r in rules:
            may = may | may_match(F.col("body"), F.lower("body"), r)
        bodies = bodies.where(may)
    once = bodies.join(wanted, "blob").groupBy("blob").agg(F.first("body").alias("body"), F.first("run").alias("run"))
    none = F.array().cast("array<struct<gap:int,whole:int,value:int>>")
    each = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), F.when(F.array_contains("run", r.key), matches(F.col("body"), r)).otherwise(none).alias("found")) for r in rules])
    flat = once.select("blob", F.explode(each).alias("r")).select("blob", "r.rule", "r.least", F.posexplode("r.found").alias("pos", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.whole")).over(Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = flat.withColumn("end", upto).where(F.col("m.value") >= F.col("least")).select("blob", "rule", F.struct((F.col("end") - F.col("m.whole")).alias("start"), "end").alias("s"))
    return spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def ledger_rows(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob, rule:version, spans (may be empty) of every pair that the ledger lacks."""
    todo = stored(unseen(docs, ledger, rules, text), "unseen")
    found = scan_blobs(docs, todo, rules, text)
    pairs = todo.select("blob", F.explode("todo").alias("p")).select("blob", F.col("p.rule").alias("rule"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return pairs.join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", none).alias("spans"))


def ledger_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found (all spans by start, then rule order) of the blobs with a finding; only the given rules' current versions count."""
    rank, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, r in enumerate(rules):
        rank = F.when(F.col("rule") == r.key, F.lit(i)).otherwise(rank)
        kind = F.when(F.col("rule") == r.key, F.lit(r.kind)).otherwise(kind)
    flat = ledger.where(F.col("rule").isin([r.key for r in rules])).select("blob", rank.alias("rank"), kind.alias("kind"), F.explode("spans").alias("s"))
    span = F.struct(F.col("s.start").alias("start"), "rank", "kind", F.col("s.end").alias("end"))
    return flat.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))


def join_back(docs: DataFrame, found: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every document, and ``found`` (empty where nothing is); a column of that name gives way."""
    kept = [c for c in columns if c != "found"]
    paths = docs.select(*kept, blob_of(F.col(text)).alias("__blob"))
    # Written first, so that the join has a shuffle on either side, and a blob of very many documents is split.
    by_blob = stored(found, "findings").select(F.col("blob").alias("__key"), F.col("found").alias("__found"))
    none = F.array().cast(f"array<{SPAN}>")
    return paths.join(by_blob, F.col("__blob") == F.col("__key"), "left").select(*kept, F.coalesce("__found", none).alias("found"))


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger that lasts as long as the application."""
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if there(spark, path) else None


def update_ledger(spark: SparkSession, docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` (Parquet, made if missing) lacks, append it, and return the whole ledger.

    ``docs`` may hold any number of historical versions of its documents, a row each.  The append is one job's commit: a run
    that dies leaves the ledger as it was, and is repeated.
    """
    rows = stored(ledger_rows(docs, read_ledger(spark, path), rules, text), "scanned")
    rows.write.mode("append").parquet(path)
    release(rows)
    return read_ledger(spark, path)


def scan(docs: DataFrame, columns: list[str], ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``columns`` and ``found`` of every document, through the ledger at the given path (None: one of its own), which it brings up to date."""
    spark = docs.sparkSession
    known = update_ledger(spark, docs, ledger or new_ledger(spark), rules, text)
    return join_back(docs, ledger_findings(known, rules), columns, text)


def span_text(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` joined by commas."""
    kept = found if kinds is None else F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(bodies: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``key``, masked: of ``bodies(key, body, found)`` each maximal run of found characters replaced by ``mask``."""
    order = Window.partitionBy("key").orderBy("s.start", "s.end")
    before = F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = bodies.select("key", F.explode("found").alias("s")).withColumn("fresh", F.coalesce(F.col("s.start") > before, F.lit(True)).cast("int"))
    run = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = spans.withColumn("run", run).groupBy("key", "run").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    # A span is cut at the borders of chunks; only its first piece leaves a mask.
    first, last = F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int")
    cut = whole.select("key", "start", "end", F.explode(F.sequence(first, last)).alias("chunk"))
    at = lambda c: (c - F.col("chunk") * CHUNK).cast("int")
    piece = F.struct(F.greatest(at(F.col("start")), F.lit(0)).alias("start"), F.least(at(F.col("end")), F.lit(CHUNK)).alias("end"), (at(F.col("start")) >= 0).alias("lead"))
    pieces = cut.select("key", "chunk", piece.alias("p")).groupBy("key", "chunk").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    chunks = bodies.select("key", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s).{1,%d}" % CHUNK), F.lit(0))).alias("chunk", "c"))
    here = chunks.join(pieces, ["key", "chunk"], "left")
    begin = lambda i: F.when(i > 0, F.get("pieces", i - 1)["end"]).otherwise(0)  # noqa: E731  (where a gap of the chunk begins)
    gaps = F.transform("pieces", lambda p, i: F.concat(F.substr("c", begin(i) + 1, p["start"] - begin(i)), F.when(p["lead"], F.lit(mask)).otherwise(F.lit(""))))
    rest = F.substr("c", F.element_at("pieces", -1)["end"] + 1, F.lit(CHUNK))
    shown = F.when(F.col("pieces").isNull(), F.col("c")).otherwise(F.concat(F.array_join(gaps, ""), rest))
    parts = here.select("key", "chunk", shown.alias("c")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "c"))).alias("parts"))
    return parts.select("key", F.array_join(F.transform("parts", lambda p: p["c"]), "").alias("masked"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """``docs`` with every secret in text masked; all rows and columns stay, and n_chars, if there, follows the text.

    Masked texts, one for each blob with a finding, are joined back: by a broadcast where they are small, else by a shuffle.
    """
    spark, names = docs.sparkSession, docs.columns
    known = update_ledger(spark, docs.select("text"), ledger or new_ledger(spark), rules)
    found = stored(ledger_findings(known, rules), "findings")
    body = docs.select(blob_of(F.col("text")).alias("key"), F.col("text").alias("body")).join(found.withColumnRenamed("blob", "key"), "key")
    bodies = stored(body.groupBy("key").agg(F.first("body").alias("body"), F.first("found").alias("found")), "bodies", found)
    clean = stored(masked(bodies), "masked", bodies)
    size = clean.agg(F.sum(F.octet_length("masked"))).first()[0] or 0
    side = clean.select(F.col("key").alias("__key"), F.col("masked").alias("__masked"))
    joined = docs.withColumn("__blob", blob_of(F.col("text"))).join(F.broadcast(side) if size <= MAX_BROADCAST_BYTES else side, F.col("__blob") == F.col("__key"), "left")
    changed = F.col("__masked").isNotNull()
    return recount(joined.withColumn("text", F.coalesce("__masked", "text")), changed).select(*names)
