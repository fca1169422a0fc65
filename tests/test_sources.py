import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospark.operators import compare, qc
from haplospark.sources import plink, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_bim_fam(spark, tmp_path):
    bim = plink.read_bim(spark, write(tmp_path / "a.bim", "19 rs1 0 100 A G\n\nchr19\trs2 0.5\t200 C T extra\n19 rs3 0 200 G T\n"))
    assert [(r["chrom"], r["snp_id"], r["bp"], r["row"]) for r in bim.orderBy("row").collect()] == [(19, "rs1", 100, 0), (19, "rs2", 200, 1), (19, "rs3", 200, 2)]
    assert [r["snp_id"] for r in plink.select_rows(bim, [0, 2]).orderBy("row").collect()] == ["rs1", "rs3"]
    with pytest.raises(ValueError, match="behind the end"):
        plink.select_rows(bim, [0, 9])
    with pytest.raises(ValueError, match="ascending"):
        plink.select_rows(bim, [2, 1])
    with pytest.raises(ValueError, match="fields"):
        plink.read_bim(spark, write(tmp_path / "b.bim", "19 rs1 0\n"))
    with pytest.raises(ValueError, match="empty"):
        plink.read_bim(spark, write(tmp_path / "c.bim", "\n"))
    a, b = (plink.read_fam(spark, write(tmp_path / f"{n}.fam", t)) for n, t in (("a", "f i1 0\nf i2 0\n"), ("b", "f i1 0\nf i3 0\n")))
    plink.require_same_samples(a, a)
    with pytest.raises(ValueError, match="row 1"):
        plink.require_same_samples(a, b)


def test_bed(spark, tmp_path):
    n, m = 7, 9
    g = np.random.default_rng(0).integers(-1, 3, (m, n))
    path = tmp_path / "a.bed"
    path.write_bytes(plink.BED_MAGIC + b"".join(map(plink.encode, g)))
    got = {r["variant_id"]: [-1 if d is None else d for d in r["dosages"]] for r in plink.read_bed(spark, str(path), n, m).collect()}
    assert got == {k: row.tolist() for k, row in enumerate(g)}
    known = np.where(g < 0, 0, g)
    stats = {r["variant_id"]: (r["sum"], r["sumsq"], r["missing"]) for r in plink.bed_stats(spark, str(path), n, m).collect()}
    assert stats == {k: (int(known[k].sum()), int((known[k] ** 2).sum()), int((g[k] < 0).sum())) for k in range(m)}
    table = {r["variant_id"]: r for r in qc.snp_stats(plink.bed_genotypes(spark, str(path), n, m), n).collect()}
    assert all((table[k]["sum"], table[k]["sumsq"], table[k]["missing"]) == stats[k] for k in table)
    with pytest.raises(Exception, match="missing calls"):
        qc.require_complete(qc.snp_stats(plink.bed_genotypes(spark, str(path), n, m), n)).collect()
    with pytest.raises(ValueError, match="bytes"):
        plink.read_bed(spark, str(path), n, m + 1)
    plink.write_bed_subset(str(path), str(tmp_path / "b.bed"), n, m, [1, 2, 5])
    assert (tmp_path / "b.bed").read_bytes() == plink.BED_MAGIC + b"".join(map(plink.encode, g[[1, 2, 5]]))
    with pytest.raises(ValueError):
        plink.write_bed_subset(str(path), str(tmp_path / "b.bed"), n, m, [2, 1])
    path.write_bytes(b"abc" + b"".join(map(plink.encode, g)))
    with pytest.raises(ValueError, match="not a BED"):
        plink.read_bed(spark, str(path), n, m)
    assert plink.decode(bytes([0b11100100]), 4).tolist() == [2, -1, 1, 0]
    assert plink.runs([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)] and plink.runs([]) == []


def test_sample_tables(spark, tmp_path):
    samples = spark.createDataFrame([("f", "a"), ("f", "b")], "fid string, iid string")
    table = tables.read_samples_table(spark, write(tmp_path / "c.txt", "FID IID SEX AGE\nf b 1 30\nf a 2 40\nf z 1 9\n"), ["SEX", "AGE"])
    assert {(r["iid"], r["SEX"]) for r in qc.join_samples(samples, table, ["SEX"]).collect()} == {("a", "2"), ("b", "1")}
    with pytest.raises(ValueError, match="not in the table"):
        qc.join_samples(samples, table.where("iid <> 'a'"), ["SEX"])
    with pytest.raises(ValueError, match="twice"):
        qc.join_samples(samples, table.unionAll(table), ["SEX"])
    with pytest.raises(ValueError, match="no column"):
        tables.read_samples_table(spark, str(tmp_path / "c.txt"), ["BMI"])
    with pytest.raises(ValueError, match="fields"):
        tables.read_fields(spark, write(tmp_path / "d.txt", "FID IID X\nf a\n"))
    with pytest.raises(ValueError, match="begin"):
        tables.read_samples_table(spark, write(tmp_path / "e.txt", "X FID IID\n1 f a\n"), ["X"])
    wide, names = qc.covariate_columns(table, ["SEX"], ["AGE"])
    assert names == ["SEX=1", "SEX=2", "q:AGE", "constant"]
    basis = np.array([r["q"] for r in qc.covariate_basis(wide, names, "iid").collect()])
    assert basis.shape == (3, 3)
    np.testing.assert_allclose(basis.T @ basis, np.eye(3), atol=1e-6)
    with pytest.raises(ValueError, match="missing value"):
        qc.covariate_columns(spark.createDataFrame([("NA",)], "x string"), [], ["x"])
    with pytest.raises(ValueError, match="levels"):
        qc.covariate_columns(spark.range(30).withColumnRenamed("id", "x"), ["x"], [])


def test_variant_matching(spark):
    """Two multi-allelic positions, a swapped allele pair and a repeated position: one variant is left."""
    bim = spark.createDataFrame([(19, "a", 100, "A", "G", 0), (19, "b", 200, "C", "T", 1), (19, "c", 300, "C", "CA", 2), (19, "d", 300, "CA", "C", 3)], "chrom int, snp_id string, bp bigint, allele1 string, allele0 string, row bigint")
    graph = spark.createDataFrame([(0, 100.0, "A", "G"), (1, 200.0, "A", "T"), (2, 300.0, "C", "CA")], "mutation_id bigint, position double, allele string, ref_allele string")
    got = qc.match_variants(bim, graph, spark.createDataFrame([(300,)], "bp bigint")).collect()
    assert [(r["unique_id"], r["mutation_id"], r["row"]) for r in got] == [("19:100:A:G", 0, 0)]
    halves = spark.createDataFrame([(0, 99.5, "A", "G"), (1, 100.5, "A", "G")], graph.schema)
    assert qc.match_variants(bim, halves).count() == 0  # both round to 100


def test_model_counts(spark):
    v = spark.createDataFrame([(19, 1.0, 1.0, 1.0, 1.0), (20, 1.0, 0.05, 1.0, 1.0)], "chrom int, mean_center_norm2 double, proj_norm2 double, norm_scale double, x_norm2 double")
    with pytest.raises(ValueError, match="chromosome 20"):
        qc.require_model_counts(v)
    with pytest.raises(ValueError, match="fewer than two"):
        qc.require_model_counts(v.where("chrom = 19"))
    assert qc.require_model_counts(v.where("chrom = 19").unionAll(v.where("chrom = 19"))) == {19: 2}


def statistics(spark):
    cols = "mutation_id bigint, snp_id string, chrom int, bp bigint, genetic_pos string, allele1 string, allele0 string, a1freq double, missing bigint, mean_center_norm2 double, proj_norm2 double, norm_scale double, x_norm2 double, chisq_linreg double, p_linreg double, beta double, se double, chisq_lmm double, p_lmm double"
    return spark.createDataFrame(
        [(0, "a", 19, 5, "0.1234567", "A", "G", 0.25, 0, 2.0, 1.0, 1.0, 1.0, 4.0, 0.0455, 0.5, 0.25, 4.0, 0.0455), (1, "b", 19, 6, "0.1234567", "A", "G", 0.0, 0, 2.0, 0.05, 1.0, 1.0, -1e9, 1.0, 0.0, None, -1e9, 1.0)], cols
    )


def test_statistics_file_and_comparison(spark, tmp_path):
    text = tables.statistics_table(statistics(spark), 10)
    bad = text.where("SNP = 'b'").first()
    assert (bad["CHISQ_LINREG"], bad["P_LINREG"], bad["BETA"], bad["SE"], bad["GENPOS"]) == ("-1e+09", "1.0E+00", "0", "-nan", "0.123457")
    tables.write_statistics(text.coalesce(1), str(tmp_path / "s"))
    back = tables.read_statistics(spark, str(tmp_path / "s"))
    assert back.count() == 2 and tuple(back.columns[1:]) == tables.STATISTICS
    same = compare.compare_stats(back, back, compare.Tolerances())
    assert same["status"] == "ok" and same["passed"] and same["A1FREQ"]["max_abs"] == 0
    off = compare.compare_stats(back, back.withColumn("BETA", (back["BETA"].cast("double") + 1).cast("string")), compare.Tolerances())
    assert not off["passed"] and not off["BETA"]["passed"] and off["BETA"]["max_abs"] == 1
    assert compare.compare_stats(back, back.limit(1))["status"] == "row_count_mismatch"
    assert compare.compare_stats(back, back.drop("SNP"))["status"] == "missing_required_columns"
    from pyspark.sql import functions as F

    assert compare.compare_stats(back, back.withColumn("SNP", F.lit("x")))["identity_mismatches"] == [0, 1]


def test_small_things(spark, tmp_path):
    assert tables.parse_chromosomes("19, chr20") == [19, 20]
    for bad in ("0", "x", "19,19"):
        with pytest.raises(ValueError):
            tables.parse_chromosomes(bad)
    (tmp_path / "chr19.bed").touch()
    assert tables.find_chromosome_file(str(tmp_path), 19, ".bed").endswith("chr19.bed")
    with pytest.raises(FileNotFoundError):
        tables.find_chromosome_file(str(tmp_path), 20, ".bed")
    df = spark.createDataFrame([(0, "a"), (1, None)], "i bigint, x string")
    assert tables.content_key(df, ["x"], "i") == tables.content_key(df.repartition(3), ["x"], "i") != tables.content_key(df.limit(1), ["x"], "i")
    calls = []
    build = lambda: calls.append(1) or {"v": 3}
    key = tables.file_key(str(tmp_path / "chr19.bed"))
    assert tables.cached_json(str(tmp_path / "k.json"), key, build) == tables.cached_json(str(tmp_path / "k.json"), key, build) == {"v": 3} and len(calls) == 1
    phenotype = spark.createDataFrame([("f", "a", 0.1)], "fid string, iid string, pheno double")
    tables.write_phenotype(phenotype, str(tmp_path / "p"))
    assert tables.read_samples_table(spark, str(tmp_path / "p"), ["PHENO"]).first()["PHENO"] == "0.10000000000000001"


def test_bim_writer_and_order_of_parts(spark, tmp_path):
    """Rows come back in the order written, over many parts; a header stands once."""
    n = 3000
    bim = spark.range(n, 0, -1, 7).select(F.lit(19).alias("chrom"), F.concat(F.lit("rs"), F.col("id")).alias("snp_id"), F.lit("0.5").alias("genetic_pos"), (7 * F.col("id")).alias("bp"), F.lit("A").alias("allele1"), F.lit("CG").alias("allele0"), (n - F.col("id")).alias("row"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    plink.write_bim(bim, str(tmp_path / "b"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "b").glob("part-*"))) > 1
    assert sorted(map(tuple, plink.read_bim(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, bim.collect()))
    with pytest.raises(ValueError, match="twice"):
        plink.write_bim(bim.unionAll(bim.limit(1)), str(tmp_path / "c"))
    people = spark.range(n).select(F.lit("f").alias("fid"), F.col("id").cast("string").alias("iid"), (F.col("id") / 7).alias("pheno")).repartition(5)
    tables.write_phenotype(people, str(tmp_path / "p"))
    back = tables.read_phenotype(spark, str(tmp_path / "p"), people.select("fid", "iid"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, people.collect()))
    plink.write_fam(spark.range(n).select(F.concat(F.lit("f "), F.col("id"), F.lit(" 0 0 1 -9")).alias("raw"), (n - 1 - F.col("id")).alias("row")), str(tmp_path / "f"))
    assert [r["iid"] for r in plink.read_fam(spark, str(tmp_path / "f")).orderBy("row").collect()] == [str(n - 1 - k) for k in range(n)]


def test_bed_writer(spark, tmp_path):
    calls = [(v, i, None if (v + i) % 5 == 0 else (v * i) % 3) for v in range(6) if v != 4 for i in range(7) if (v + 2 * i) % 4]
    path = str(tmp_path / "x.bed")
    plink.write_bed(spark.createDataFrame(calls, "variant_id bigint, individual_id bigint, dosage bigint"), path, 7, 6)
    assert sorted(map(tuple, plink.bed_genotypes(spark, path, 7, 6).collect()), key=str) == sorted([c for c in calls if c[2] != 0], key=str)


def test_discovery(tmp_path):
    for k, name in enumerate(["chr1.bim", "chr2.x.bim", "chr3_x.bim", "chr4-x.bim", "a.chr5.y.bim", "a.chr6_y.bim", "a.chr7-y.bim"], 1):
        (tmp_path / name).touch()
        assert tables.find_chromosome_file(str(tmp_path), k, ".bim").endswith(name)
    (tmp_path / "chr8").mkdir()
    (tmp_path / "chr8" / "chr8_z.bim").touch()
    assert tables.find_chromosome_file(str(tmp_path), 8, ".bim").endswith("chr8_z.bim")
    (tmp_path / "chr1_again.bim").touch()
    with pytest.raises(FileNotFoundError, match="2 files"):
        tables.find_chromosome_file(str(tmp_path), 1, ".bim")
    with pytest.raises(FileNotFoundError, match="0 files"):
        tables.find_chromosome_file(str(tmp_path), 11, ".bim")


def test_sampling_in_batches(spark):
    """As a walk through the seeded permutation; ``keep`` sees no row behind the last batch."""
    variants = spark.range(1000).withColumnRenamed("id", "row")
    seen = []

    def keep(rows):
        seen.append(rows.count())
        return rows.where("row % 50 = 3")

    order = np.random.default_rng(np.random.SeedSequence([5, 19])).permutation(1000)
    want = sorted([int(r) for r in order if r % 50 == 3][:6])
    assert [r["row"] for r in qc.sample_variants(variants, 6, 5, 19, keep, batch=100).collect()] == want
    assert sum(seen) < 1000 and set(seen) == {100}
    with pytest.raises(ValueError, match="only 20"):
        qc.sample_variants(variants, 21, 5, 19, keep)
    with pytest.raises(ValueError, match="asked for"):
        qc.sample_variants(variants, 1001, 5)


def test_cached_table(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    path = str(tmp_path / "kept")
    for key, times in (({"seed": 1}, 1), ({"seed": 1}, 1), ({"seed": 2}, 2)):
        assert tables.cached_table(spark, path, key, build).count() == 3 and len(built) == times


def test_basis_of_close_covariates(spark):
    """Singular values a hundred million apart count, less than that do not; as in a decomposition of the whole matrix."""
    rng = np.random.default_rng(0)
    x, z = rng.standard_normal(500), rng.standard_normal(500)
    for gap, rank in ((1e-5, 3), (1e-7, 3), (1e-10, 2)):
        table = spark.createDataFrame([(i, 1.0, float(x[i]), float(x[i] + gap * z[i])) for i in range(500)], "individual_id bigint, one double, a double, b double").repartition(7)
        rows = sorted((r["individual_id"], r["q"]) for r in qc.covariate_basis(table, ["one", "a", "b"]).collect())
        q = np.array([r[1] for r in rows])
        assert q.shape == (500, rank)
        np.testing.assert_allclose(q.T @ q, np.eye(rank), atol=1e-12)
        dense = qc.orthonormal_basis(np.column_stack([np.ones(500), x, x + gap * z]))
        np.testing.assert_allclose(q @ q.T, dense @ dense.T, atol=1e-15 / gap * 100)


def test_minus_nine_is_a_number(spark, tmp_path):
    """A balance of -27 gives a component of -9, which the file has as the text that also stands for a missing value."""
    from haplospark import file_queries

    spark.createDataFrame([(0, 1, -27.0, "A"), (1, 2, 33.0, "B")], "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r["iid"], r["name"]): r["value"] for r in file_queries.covariate_columns(spark, str(tmp_path)).collect()}
    assert (got["i0", "q:PC1"], got["i1", "q:PC1"]) == (-9.0, 11.0) and len(got) == 8
    with pytest.raises(ValueError, match="missing value"):
        qc.covariate_columns(spark.createDataFrame([("-9",)], "x string"), [], ["x"])


@pytest.mark.parametrize("local", [True, False])
def test_bed_of_many_blocks(spark, tmp_path, monkeypatch, local):
    """Blocks without calls, individuals that do not fill a byte; a local file is not put together in one task."""
    n, m, r = 13, 57, np.random.default_rng(8)
    monkeypatch.setattr(plink, "READ_BYTES", 12)
    known = {(int(v), int(i)): int(d) for v, i, d in zip(r.choice([*range(9), *range(40, 57)], 150), r.integers(0, n, 150), r.integers(-1, 3, 150), strict=True)}
    calls = spark.createDataFrame([(v, i, None if d < 0 else d) for (v, i), d in known.items()], "variant_id bigint, individual_id bigint, dosage bigint")
    if local:
        whole = type(calls).repartition
        monkeypatch.setattr(type(calls), "repartition", lambda self, *a: pytest.fail("all blocks came to one task") if a == (1,) else whole(self, *a))
    else:
        monkeypatch.setattr(plink.pyarrow.fs, "LocalFileSystem", type(None))
    path = str(tmp_path / "a.bed")
    plink.write_bed(calls, path, n, m)
    x = np.zeros((m, n), np.int8)
    for (v, i), d in known.items():
        x[v, i] = d
    assert open(path, "rb").read() == plink.BED_MAGIC + b"".join(plink.encode(row) for row in x)
    got = {(c["variant_id"], c["individual_id"]): -1 if c["dosage"] is None else c["dosage"] for c in plink.bed_genotypes(spark, path, n, m).collect()}
    assert got == {k: d for k, d in known.items() if d}
    assert {c["variant_id"]: c["missing"] for c in plink.bed_stats(spark, path, n, m).collect()} == dict(enumerate((x < 0).sum(axis=1).tolist()))
