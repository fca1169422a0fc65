"""One query for each operator, over its whole table with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm import chat_format, decontaminate, fingerprints, mix, quality, secrets_scan, simhash, substring_dedup, suffix_dedup, url_filter
from haplospark.checkpoints import stored
from haplospark.llm.common import table

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that every document loses to repeated runs of 20 words and more, and a digest of the rest."""
    return _substring_dedup(spark, sf_dir, substring_dedup.WORDS)


def substring_dedup_every_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every repeated run of two sentences and more, however short."""
    return _substring_dedup(spark, sf_dir, 0)


def _substring_dedup(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    left = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), words=words)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["i"].cast("string"), (x["j"] + 1).cast("string"))), ",")
    kept = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_sentences", "n_removed", spans.alias("removed"), F.char_length(kept).cast("long").alias("n_kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document; see ``decontaminate``."""
    found = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over every page.  The list: URLs met with a campaign tag (``utm_source``), in canonical form."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, pages.where(F.contains("url", F.lit("utm_source="))).select("url"), URL_RULES)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they and the next document are."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def mix_weights(sources: list) -> list[int]:
    return [(5, 2, 1)[i % 3] for i in range(len(sources))]


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document; the one source of a document is its membership pattern."""
    docs = table(spark, sf_dir, "documents")
    rows = stored(mix.prepared(docs, F.array("source")).select("doc_id", F.col("source").alias("__source_of"), "__pattern", "__size", "__hash"), "sizes")
    by_pattern, by_source = mix.plan(rows, mix_weights)
    taken = mix.apply_plan(rows, by_pattern).join(by_source, F.col("__source_of").eqNullSafe(F.col("__source")))
    copies = F.when(F.col("__size") > 0, F.col("__whole") + F.col("__extra")).otherwise(0)
    return taken.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (copies * F.col("__size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's perspective."""
    shown = chat_format.render(table(spark, sf_dir, "conversations"))
    return shown.withColumn("mask", chat_format.mask_text(F.col("mask")))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 200-byte strings, and a digest of the rest."""
    left = suffix_dedup.remove(table(spark, sf_dir, "documents"), ["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of this corpus and its labels."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", quality.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document through a ledger that is filled in two steps: the base rules first, then only the pairs that the added rules bring."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets_scan.new_ledger(spark)
    secrets_scan.update_ledger(spark, docs, ledger, secrets_scan.BASE_RULES)
    found = secrets_scan.scan(docs, ["doc_id"], ledger)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = tuple(r.kind for r in secrets_scan.BASE_RULES)
    return found.select(
        "doc_id", *map(count, kinds), F.sha2(secrets_scan.span_text(F.col("found"), kinds), 256).alias("base_sha256"), secrets_scan.span_text(F.col("found")).alias("spans")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_substring_dedup, substring_dedup_every_run, op2_benchmark_decontamination, op3_url_filters, op4_document_fingerprints, op5_source_mix,
        op6_chat_formatting, op7_suffix_array_dedup, op8_simhash_near_dedup, op9_quality_classifier, op10_secret_scans,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from haplospark.llm import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
