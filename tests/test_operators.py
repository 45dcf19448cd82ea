"""Pinned values and small cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from siftline.functions import names, residues
from siftline.operators import audit, evaluation, learning, matching, peptides, ranking, scoring, statistics, variants


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("args", "value"), [((3, 10, 14, 139), 0.064), ((2, 10, 14, 139), 0.265), ((1, 10, 14, 139), 0.667), ((3, 10, 3, 19), 0.124), ((1, 10, 3, 19), 0.913)])
def test_exact_tails(args, value):
    assert statistics.upper_tail(*args) == pytest.approx(value, abs=5e-4)


def test_design_capacity(spark):
    designs = spark.createDataFrame([(20, 14, 139), (10, 3, 19), (10, 14, 139)], "drawn long, positives long, pool long")
    got = {(r.drawn, r.positives): r for r in statistics.design_capacity(designs).collect()}
    assert got[20, 14].hits_needed == 5
    assert got[10, 3].hits_needed is None
    assert got[10, 14].expected_hits == pytest.approx(1.0072, abs=1e-4)


def test_power_is_scanned_in_full(spark):
    curve = statistics.power_curve(spark, 5000, 115, 2.5)
    assert curve.where("n = 60").first().power == pytest.approx(0.418091, abs=1e-5)
    assert statistics.smallest_sample(curve, 0.8).first().min_n == 235


@pytest.mark.parametrize(("rows", "auc"), [([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], 0.875), ([(1.0, 1), (1.0, 0)], 0.5), ([(1.0, 1)], None)])
def test_rank_auc(spark, rows, auc):
    pool = spark.createDataFrame([("m", s, y) for s, y in rows], "method string, score double, label int")
    assert evaluation.rank_auc(pool, ["method"]).first().auc == auc


def test_auc_of_empty_pool(spark):
    assert evaluation.rank_auc(spark.createDataFrame([], "method string, score double, label int"), ["method"]).count() == 0


def test_missing_measures_drop_nothing(spark):
    row = [("a", ["PASS"], None, None, None, None, None, None)]
    frame = spark.createDataFrame(row, "key string, filters array<string>, depth int, dna_vaf double, population_af double, tpm double, rna_vaf double, copies double")
    assert variants.annotated(frame).first().reason is None
    strict = variants.annotated(frame, variants.Thresholds(require_rna=True)).first()
    assert strict.reason == "no_expression_data"


def test_consequence_class(spark):
    got = one(spark, variants.consequence_class(F.lit("splice&missense_variant")).alias("a"), variants.consequence_class(F.lit("intron")).alias("b"))
    assert tuple(got) == ("missense", "other")


def test_caps_share_one_counter(spark):
    rows = [("k", i, c) for i, c in enumerate([6, 6, 2, 6, 6, 6, 6, 6])]
    frame = spark.createDataFrame(rows, "key string, i int, cap int")
    got = scoring.shortlist(frame, "key", [F.asc("i")], 50, F.col("cap"))
    assert [r.i for r in got.orderBy("rank").collect()] == [0, 1, 3, 4, 5, 6]


def test_two_caps_are_greedy(spark):
    rows = [("a", "v1", "x", 0.9), ("b", "v1", "y", 0.8), ("c", "v2", "x", 0.7), ("d", "v2", "y", 0.6), ("e", "v3", "x", 0.5)]
    frame = spark.createDataFrame(rows, "key string, variant string, allele string, acq double")
    got = learning.active_batch(frame, [F.desc("acq")], 10, 1, 2).orderBy("rank").collect()
    assert [r.key for r in got] == ["a", "c"]


@pytest.mark.parametrize(("raw", "name"), [("A0201", "HLA-A*02:01"), (" hla-b*07:02:01 ", "HLA-B*07:02"), ("DRB1*15:01", "HLA-DRB1*15:01"), ("x", None), ("", None)])
def test_alleles(spark, raw, name):
    assert one(spark, names.normalize_allele(F.lit(raw)).alias("n")).n == name


@pytest.mark.parametrize(("text", "want"), [("p.S754Qfs*12", ("frameshift", 754, 754, "S", "")), ("G261R", ("missense", 261, 261, "G", "R")), ("p.L5_V9del", ("deletion_range", 5, 9, "", "")), ("p.L5_V99del", None), ("p.A3_B4insKL", ("insertion", 3, 3, "", "KL")), ("?", None), (None, None)])
def test_protein_changes(spark, text, want):
    got = one(spark, names.protein_change(F.lit(text).cast("string")).alias("c")).c
    assert (tuple(got) if got else None) == want


def test_sequences(spark):
    got = one(
        spark, residues.translate_codons(F.lit("atgGCCtaaGGG")).alias("t"), residues.hydropathy(F.lit("AC")).alias("h"), residues.substitution_dissimilarity(F.lit("AAAAA"), F.lit("AAAAA")).alias("d"),
        residues.substitution_dissimilarity(F.lit("AAAA"), F.lit("AAA")).alias("n"), residues.mutation_exposure(F.lit(2), F.lit(9)).alias("e"), residues.is_valid(F.lit("ACX")).alias("v"),
    )
    assert tuple(got) == ("MA*", 0.5, 0.0, None, 0.0, False)


def test_nearest_self(spark):
    peptides = spark.createDataFrame([("ACDEFGHI",), ("WWWWWWWW",)], "peptide string")
    reference = spark.createDataFrame([(1, "KKACDEFGHIKK")], "id int, seq string")
    got = {r.peptide: r.similarity for r in matching.nearest_similarity(peptides, reference, "id").collect()}
    assert got == {"ACDEFGHI": 1.0, "WWWWWWWW": 0.0}


def test_corrections(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "feature string, p double")
    got = {r.feature: r for r in statistics.corrected(tests).collect()}
    assert [got[f].step_up for f in "abcd"] == [True, True, True, False]
    assert [got[f].bonferroni for f in "abcd"] == [True, False, False, False]
    assert got["a"].adjusted == pytest.approx(0.04)
    assert statistics.corrected(tests.limit(0)).count() == 0


def test_z_test(spark):
    rows = [("f", g, v) for g, v in (("A", 2.0), ("A", 4.0), ("B", 1.0), ("B", 1.0))] + [("lonely", "A", 1.0)]
    got = statistics.z_test(spark.createDataFrame(rows, "feature string, group string, value double")).collect()
    assert len(got) == 1
    assert got[0].p == pytest.approx(math.erfc(2 / math.sqrt(2)))


def test_alias_never_rewrites_a_readable_name(spark):
    source = spark.createDataFrame([("A*02:02", 1), ("old1", 2), (None, 3)], "name string, payload int")
    aliases = spark.createDataFrame([("A*02:02", "HLA-A*02:01"), ("OLD1", "HLA-A*01:01")], "alias string, canonical string")
    got = {r.payload: r.canonical for r in audit.canonicalised(source, aliases, "name").collect()}
    assert got == {1: "HLA-A*02:02", 2: "HLA-A*01:01", 3: None}


def test_sets_and_grades(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert audit.same_set(a, a)
    assert not audit.same_set(a, a.distinct())
    got = one(spark, audit.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("j"))
    assert got.j == 1.0


def test_refit_needs_enough_rows(spark):
    rows = spark.createDataFrame([(float(i % 7), i % 2) for i in range(20)], "x double, label int")
    assert learning.refit(rows, ["x"]) is None
    more = spark.createDataFrame([(float(i % 2) + (i % 5) / 10, i % 2) for i in range(60)], "x double, label int")
    assert learning.refit(more, ["x"])["x"] > 0


def test_streaming_matches_batch(spark, tmp_path):
    from siftline import streaming

    schema = "key string, filters array<string>, depth int, dna_vaf double, population_af double, tpm double, rna_vaf double, copies double"
    frame = spark.createDataFrame([("a", ["PASS"], 30, 0.4, 0.0, 5.0, 0.1, 2.0), ("b", ["q10"], 30, 0.4, 0.0, 5.0, 0.1, 2.0)], schema)
    frame.write.parquet(str(tmp_path / "in"))
    q = streaming.annotate_stream(spark, str(tmp_path / "in"), schema).writeStream.format("memory").queryName("annotated").start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.reason for r in spark.table("annotated").collect()} == {"a": None, "b": "not_pass"}


CHANGE = "variant string, seq string, variant_class string, protein_start int, protein_end int, aa_ref string, aa_alt string, downstream string, release int, length_change int"
PROTEIN = "MKTAYIAKQRQISFVKSHFSRQ"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (("missense", 5, 5, "Y", "C", None, None, None), ("MKTACIAKQRQISFVKSHFSRQ", 4, 5, None)),
        (("missense", 5, 5, "A", "C", None, None, None), (None, 4, 5, "reference_mismatch")),
        (("missense", 40, 40, "Y", "C", None, None, None), (None, 39, 40, "reference_mismatch")),
        (("inframe_insertion", 5, 6, None, "GG", None, None, None), ("MKTAYGGIAKQRQISFVKSHFSRQ", 5, 7, None)),
        (("inframe_deletion", 5, 6, "YI", None, None, None, None), ("MKTAAKQRQISFVKSHFSRQ", 4, 4, None)),
        (("frameshift", 5, 5, "Y", "X", "WWWG*AA", 111, 3), ("MKTAWWWG", 4, 8, None)),
        (("frameshift", 5, 5, "Y", "X", None, 111, 3), (None, 4, None, "no_tail")),
        (("frameshift", 5, 5, "Y", "X", "YIAKX", 111, None), (None, 4, None, "reference_mismatch")),
        (("frameshift", 5, 5, "Y", "C", "WWWG", 114, -13), ("MKTACWWWG", 4, 9, None)),
        (("frameshift", 5, 5, "Y", "X", "WWWG", 114, -13), (None, 4, None, "missing_residues")),
        (("frameshift", 5, 5, None, "X", "WWWG", 114, -13), ("MKTAYWWWG", 5, 9, None)),
        (("frameshift", 5, 5, "Y", "C", "WWWG", 114, -19), (None, 4, None, "reference_mismatch")),
    ],
)
def test_mutant_proteins(spark, change, want):
    kind, start, end, ref, alt, tail, release, grown = change
    rows = spark.createDataFrame([("v", PROTEIN, kind, start, end, ref, alt, tail, release, grown)], CHANGE)
    got = peptides.mutant_proteins(rows).first()
    assert (got.mutant, got.first, got.last, got.error) == want


def test_peptides_of_a_substitution(spark):
    rows = spark.createDataFrame([("v", PROTEIN, "missense", 12, 12, "I", "W", None, None, None), ("none", None, "missense", 1, 1, "M", "A", None, None, None)], CHANGE)
    got = {r.peptide: r for r in peptides.peptides(peptides.mutant_proteins(rows), "variant", (9, 30), flank=3).collect()}
    mutant = PROTEIN[:11] + "W" + PROTEIN[12:]
    assert set(got) == {mutant[s : s + 9] for s in range(3, 12)}
    for s in range(3, 12):
        r = got[mutant[s : s + 9]]
        assert (r.wildtype, r.position, r.n_flank, r.c_flank) == (PROTEIN[s : s + 9], 12 - s, mutant[max(0, s - 3) : s], mutant[s + 9 : s + 12])


def test_peptides_of_a_junction_and_a_tail(spark):
    rows = spark.createDataFrame(
        [("del", PROTEIN, "inframe_deletion", 5, 6, "YI", None, None, None, None), ("fs", PROTEIN, "frameshift", 20, 20, "S", "X", "WWGXA", None, None), ("same", "A" * 20, "missense", 9, 9, "A", "A", None, None, None)], CHANGE
    )
    got = peptides.peptides(peptides.mutant_proteins(rows), "variant", (8,)).collect()
    cut, shifted = "MKTAAKQRQISFVKSHFSRQ", PROTEIN[:19] + "WWG"
    assert {r.peptide for r in got if r.variant == "del"} == {cut[s : s + 8] for s in range(4)}
    assert {r.peptide for r in got if r.variant == "fs"} == {shifted[s : s + 8] for s in range(12, 15)}
    assert [r.position for r in got if r.variant == "same"] == [8]  # of equal windows the first counts
    assert all(r.wildtype is None for r in got if r.variant != "same")


def test_protein_lookup(spark):
    known = spark.createDataFrame([("P1", "T1", "G1", "MA"), ("P2", "T2", "G1", "MAA"), ("P3", "T3", "G1", "MAC")], "protein string, transcript string, symbol string, seq string")
    asked = spark.createDataFrame([(1, "T1.4", "G1"), (2, "P3", "G9"), (3, "none", "G1"), (4, None, None)], "id int, transcript string, gene string")
    assert {r.id: r.seq for r in peptides.with_protein(asked, known).collect()} == {1: "MA", 2: "MAC", 3: "MAA", 4: None}


def test_ranking_end_to_end(spark):
    rows = spark.createDataFrame([(f"v{i}", PROTEIN, "missense", 5 + i, 5 + i, PROTEIN[4 + i], "W", None, None, None) for i in range(4)], CHANGE)
    found = peptides.peptides(peptides.mutant_proteins(rows), "variant", (9,))
    unique = ranking.distinct_peptides(found)
    assert unique.count() == unique.select("peptide").distinct().count()
    calls = ranking.predicted(unique, ["HLA-A*02:01", "HLA-B*07:02", "HLA-A*02:01"])
    assert calls.count() == 2 * unique.count()
    names = ("ccf", "tpm", "normal_tpm", "self_similarity", "dna_vaf", "rna_vaf")
    joined = ranking.with_predictions(found, calls).withColumns({n: F.lit(None).cast("double") for n in names} | {"is_self": F.lit(False), "gene": F.lit("G"), "transcript": F.lit("T"), "hgvsp": F.lit("h")})
    scored = ranking.featured(joined, max_percentile=50.0)
    table = ranking.ranked_table(ranking.ranked(scored, 5, cap=2), "s")
    assert tuple(table.columns) == ranking.RANKED
    got = table.orderBy("rank").collect()
    want, taken = [], {}
    for r in sorted(scored.collect(), key=lambda r: (-r.score, r.variant, r.peptide, r.allele)):
        if not r.gate_failures and taken.get(r.variant, 0) < 2:
            taken[r.variant] = taken.get(r.variant, 0) + 1
            want.append((r.variant, r.peptide, r.allele))
    assert [(r.variant, r.mutant_peptide, r.allele) for r in got] == want[:5]
    assert all(r.wt_affinity_nm is not None and r.clonality == 0.5 for r in scored.collect())


def test_names_read_odd_input(spark):
    got = one(spark, names.protein_change(F.lit("p.A99999999999C")).alias("a"), names.protein_change(F.lit("\tp.A12C\n")).alias("b"))
    assert got.a is None
    assert (got.b.kind, got.b.start) == ("missense", 12)
    source = spark.createDataFrame([("OLD10-OLD12",), ("HLA-A*02:01",), ("A0201",), ("",), (None,), ("OLD10-unknown",)], "allele string")
    aliases = spark.createDataFrame([("OLD10", "HLA-DQA1*05:01"), ("OLD12", "HLA-DQB1*02:01")], "alias string, canonical string")
    got = {r.allele: r.canonical for r in audit.canonicalised(source, aliases, "allele").collect()}
    assert got["OLD10-OLD12"] == "HLA-DQA1*05:01-HLA-DQB1*02:01"
    assert got["HLA-A*02:01"] == "HLA-A*02:01"
    assert got[""] is None and got[None] is None and got["OLD10-unknown"] is None


def test_every_drop_reason_is_counted(spark):
    frame = spark.createDataFrame([("low_vaf",), ("low_vaf",), (None,)], "reason string")
    got = {r.reason: r.n for r in variants.failure_counts(frame).collect()}
    assert got == dict.fromkeys(variants.REASONS, 0) | {"low_vaf": 2}


def test_reconcile_verdicts_and_odd_claims(spark):
    from siftline.operators import claims

    seq = "MACDEFGHIKLMNPQRSTVWY"
    isoforms = spark.createDataFrame([("KRAS", "T1", seq, True), ("KRAS", "T2", seq[:9], False)], "symbol string, transcript string, seq string, primary boolean")
    aliases = spark.createDataFrame([("OLD", "KRAS"), ("KRAS", "OTHER"), ("GONE", "NOWHERE")], "old string, new string")
    rows = [
        (1, "KRAS", "p.G7W", "CDEFWHIKL", None, "derivable"), (2, "KRAS", "p.G7W", "CDEFGHIKL", None, "peptide_not_generated"), (3, "KRAS", "p.A7W", "CDEFWHIKL", None, "no_consistent_isoform"),
        (4, "OLD", "p.G7W", "CDEFWHIKL", None, "derivable"), (5, "OLD", "p.A7W", "CDEFWHIKL", None, "gene_not_found"), (6, "GONE", "p.G7W", "CDEFWHIKL", None, "gene_not_found"),
        (7, "KRAS", "p.G7fs", "DEFWWWW", "", "tail_required"), (8, "KRAS", "p.G7fs", "DEFWWWWW", "WWWWW*", "derivable"), (9, "KRAS", "odd", "CDEFWHIKL", None, "unparseable_change"),
        (10, None, "p.G7W", "CDEFWHIKL", None, "gene_not_found"), (11, "KRAS", "p.G7W", None, None, "peptide_not_generated"), (12, "KRAS", "p.G7W", "", None, "peptide_not_generated"),
        (13, "KRAS", None, "CDEFWHIKL", None, "unparseable_change"), (14, "KRAS", "p.F6_G7del", "DEHIKLMNP", None, "derivable"),
    ]
    frame = spark.createDataFrame([r[:5] for r in rows], "claim_id int, gene string, protein_change string, peptide string, downstream string")
    got = {r["claim_id"]: r["verdict"] for r in claims.reconcile(frame, isoforms, aliases).collect()}
    assert got == {r[0]: r[5] for r in rows}
    assert claims.reconcile(frame.limit(0), isoforms, aliases).count() == 0


def test_request_gated_tail_and_weight_changes(spark):
    from pyspark.sql import functions as F

    from siftline.operators import learning, ranking

    scored = spark.createDataFrame(
        [("s", "A", "a1", 0.9, []), ("s", "B", "a1", 0.8, ["self_peptide"]), ("s", "C", "a1", 0.7, ["weak_binder"]), ("s", "D", "a1", 0.6, ["weak_binder"])],
        "sample_id string, peptide string, allele string, score double, gate_failures array<string>",
    )
    short = scored.where("peptide = 'A'").withColumn("rank", F.lit(1))
    out = ranking.with_gated(short, scored, ["peptide", "allele"], [F.desc("score")], 2).collect()
    assert [(r["peptide"], r["rank"]) for r in sorted(out, key=lambda r: r["peptide"])] == [("A", 1), ("B", None), ("C", None)]
    sheet = ranking.assay_request(short).first()
    assert (sheet["assay"], sheet["call"], sheet["predicted_rank"], sheet["predicted_score"]) == ("IFNG_ELISPOT", "", 1, 0.9) and len(sheet) == 12
    changes = learning.weight_changes({"b": 1.0, "a": 0.5}, {"a": 0.25, "b": 2.0}, spark).collect()
    assert [c["text"] for c in changes] == ["a                  +0.500 -> +0.250  (-0.250)", "b                  +1.000 -> +2.000  (+1.000)"]
