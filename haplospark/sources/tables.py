"""Delimited text tables: covariates, phenotypes, variant manifests, association statistics, and what caches are keyed by."""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.checkpoints import stored, there
from haplospark.functions.statistics import g6, g17, p_value_text
from haplospark.operators.qc import is_model_variant, join_samples
from haplospark.sources.plink import _lines, write_lines

#: Columns of a manifest and of a table of statistics, in order.
MANIFEST = (
    "global_idx", "chrom", "local_grg_idx", "bed_row", "snp_id", "bp", "allele1", "allele0", "missing", "mean", "mean_center_norm2", "proj_norm2", "norm_scale", "x_norm2", "a1freq",
)
STATISTICS = (
    "SNP", "CHR", "BP", "GENPOS", "ALLELE1", "ALLELE0", "A1FREQ", "F_MISS", "CHISQ_LINREG", "P_LINREG", "BETA", "SE", "CHISQ_BOLT_LMM_INF", "P_BOLT_LMM_INF",
)
#: Where a chromosome's file may be, below a folder: the name alone or behind another, and followed by nothing or by more; exactly one must match.
PATTERNS = tuple(f"{folder}{before}chr{{c}}{after}{{s}}" for folder in ("", "chr{c}/") for before in ("", "*.") for after in ("", ".*", "_*", "-*"))


def read_fields(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """row (from 0, the header not counted) and the columns that the first line names, as text, split at blanks."""
    lines = _lines(spark, path)
    head = lines.where("row = 0").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = list(head["fields"])
    lost = [c for c in required if c not in names]
    if lost:
        raise ValueError(f"{path} has no column {lost[0]}")
    bad = lines.where(F.size("fields") != len(names)).orderBy("row").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0]['row'] + 1}: {len(bad[0]['fields'])} fields, the header has {len(names)}")
    return lines.where("row > 0").select((F.col("row") - 1).alias("row"), *[F.col("fields")[k].alias(n) for k, n in enumerate(names)])


def read_samples_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """fid, iid and ``columns``; the header must begin with FID IID."""
    table = read_fields(spark, path, ["FID", "IID", *columns])
    if table.columns[1:3] != ["FID", "IID"]:
        raise ValueError(f"the header of {path} does not begin with FID IID")
    return table.select(F.col("FID").alias("fid"), F.col("IID").alias("iid"), *columns)


def write_phenotype(df: DataFrame, path: str) -> None:
    """FID IID PHENO; 17 significant digits, which read back the same number."""
    write_lines(df.select(F.col("fid").alias("FID"), F.col("iid").alias("IID"), g17(F.col("pheno")).alias("PHENO")), path, " ", header=True)


def read_phenotype(spark: SparkSession, path: str, samples: DataFrame | None = None) -> DataFrame:
    """fid, iid, pheno (a number); of ``samples(fid, iid)``, if given, each of which must be there once."""
    table = read_samples_table(spark, path, ["PHENO"]).select("fid", "iid", F.col("PHENO").cast("double").alias("pheno"))
    return table if samples is None else join_samples(samples, table, ["pheno"])


def write_covariates(df: DataFrame, path: str, components: int = 20) -> None:
    names = [f"PC{k + 1}" for k in range(components)]
    write_lines(df.select(F.col("fid").alias("FID"), F.col("iid").alias("IID"), *[g17(F.col(n)).alias(n) for n in names], F.col("sex").alias("SEX")), path, " ", header=True)


def write_manifest(variants: DataFrame, path: str) -> None:
    twice = variants.groupBy("snp_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"variant {twice[0]['snp_id']} stands twice in the manifest")
    write_lines(variants.select(*MANIFEST), path, "\t", ["global_idx"], header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    text = read_fields(spark, path).drop("row")
    if tuple(text.columns) != MANIFEST:
        raise ValueError(f"{path} does not have a manifest's columns")
    kinds = {c: "bigint" for c in ("global_idx", "local_grg_idx", "bed_row", "bp", "missing")} | {"chrom": "int", "snp_id": "string", "allele1": "string", "allele0": "string"}
    return text.select(*[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in MANIFEST])


def statistics_table(associated: DataFrame, dim: int) -> DataFrame:
    """The 14 text columns of an association result that also has snp_id, bp, genetic_pos, allele1, allele0."""
    c, ok = F.col, is_model_variant()
    return associated.select(
        c("snp_id").alias("SNP"), c("chrom").cast("string").alias("CHR"), c("bp").cast("string").alias("BP"), g6(c("genetic_pos").cast("double")).alias("GENPOS"), c("allele1").alias("ALLELE1"), c("allele0").alias("ALLELE0"),
        g6(c("a1freq")).alias("A1FREQ"), g6(c("missing") / F.lit(float(dim))).alias("F_MISS"), g6(c("chisq_linreg")).alias("CHISQ_LINREG"), p_value_text(c("p_linreg"), c("chisq_linreg")).alias("P_LINREG"),
        g6(c("beta")).alias("BETA"), F.when(ok, g6(F.coalesce("se", F.lit(0.0)))).otherwise(F.lit("-nan")).alias("SE"),
        g6(c("chisq_lmm")).alias("CHISQ_BOLT_LMM_INF"), p_value_text(c("p_lmm"), c("chisq_lmm")).alias("P_BOLT_LMM_INF"),
    )


def write_statistics(table: DataFrame, path: str) -> None:
    """By the column ``row``, if there is one, else as the rows come."""
    write_lines(table.select(*STATISTICS, *[F.col(c).alias("__row") for c in table.columns if c == "row"]), path, "\t", ["__row"] if "row" in table.columns else [], header=True)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return read_fields(spark, path)


def find_chromosome_file(folder: str, chrom: int, suffix: str) -> str:
    """The one local file of a chromosome, flat or in a folder of its own."""
    found = sorted({os.path.normpath(f) for p in PATTERNS for f in glob.glob(os.path.join(folder, p.format(c=chrom, s=suffix)))})
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files {suffix} for chromosome {chrom} below {folder}, not one")
    return found[0]


def parse_chromosomes(text: str) -> list[int]:
    """``19,chr20`` -> [19, 20]; positive and without repeats."""
    out: list[int] = []
    for part in text.split(","):
        word = part.strip().lower().removeprefix("chr")
        if not word.isdigit() or int(word) < 1:
            raise ValueError(f"not a chromosome: {part!r}")
        if int(word) in out:
            raise ValueError(f"chromosome {word} is listed twice")
        out.append(int(word))
    return out


def content_key(df: DataFrame, columns: Sequence[str], order: str) -> str:
    """SHA-256 of a table's rows in order: the rows' own digests, chained over one row for each block of a million."""
    row = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    blocks = df.select(F.floor(F.col(order) / 1_000_000).alias("b"), F.struct(F.col(order), row.alias("d")).alias("r"))
    parts = blocks.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["d"]), ""), 256).alias("d")).orderBy("b").collect()
    return hashlib.sha256("".join(p["d"] for p in parts).encode()).hexdigest()


def file_key(path: str) -> dict:
    """What tells a local file from a later version of it."""
    s = os.stat(path)
    return {"path": os.path.abspath(path), "size": s.st_size, "mtime_ns": s.st_mtime_ns}


def cached_json(path: str, key: dict, build) -> dict:
    """The value kept at ``path`` under ``key``, or ``build()``, kept there by an atomic replacement."""
    try:
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        if kept.get("key") == key:
            return kept["value"]
    except (FileNotFoundError, json.JSONDecodeError):
        pass
    value = build()
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump({"key": key, "value": value}, f)
    os.replace(f"{path}.new", path)
    return value


def cached_table(spark: SparkSession, path: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at ``path`` under ``key`` (such as a simulated phenotype under its sources, seed and heritability), or ``build()``, kept there.

    The key is written behind the table, so a run that dies leaves no key.
    """
    name, text = f"{path.rstrip('/')}/key", json.dumps(key, sort_keys=True)
    if there(spark, f"{name}/_SUCCESS") and [r[0] for r in spark.read.text(name).collect()] == [text]:
        return spark.read.parquet(f"{path.rstrip('/')}/table")
    new = stored(build(), "cached")
    spark.createDataFrame([("",)], "value string").write.mode("overwrite").text(name)
    new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/table")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(name)
    return spark.read.parquet(f"{path.rstrip('/')}/table")
