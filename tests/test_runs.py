"""Sheets and their drops, annotation columns, claims files, settings and whole runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.operators import claims, evaluation, learning, sheets, statistics, variants
from siftline.plans import runs
from siftline.sources import config, manifest, tables, vcf
from siftline.sources import sheets as files


def test_mutation_sheet_with_every_drop(spark, tmp_path):
    text = "Table 1\nsupplementary\nPatient ID\tHugo Symbol\tVariant Classification\tProtein Change\tChromosome\tStart position\tReference Allele\tTumor Seq Allele2\n"
    rows = [
        "1\tG1\tMissense_Mutation\tp.C2W\t7\t100.0\tA\tT", "2.0\tOLD\tIn_Frame_Del\tp.C2_E4del\t7\t101\t\tT", "3\tG1\tIn_Frame_Ins\tp.C2_D3insWW\t7\t102\tA\tT", "9\tG1\tMissense_Mutation\tp.C2W\t7\t1\tA\tT",
        "1\tG1\tNonsense_Mutation\tp.C2*\t7\t1\tA\tT", "1\tG1\tNonsense_Mutation\tp.C3*\t7\t1\tA\tT", "1\tG1\tSilent\tp.C2C\t7\t1\tA\tT", "1\tG1\tMissense_Mutation\tC2W\t7\t1\tA\tT", "1\tG1\tMissense_Mutation\tp.C2fs\t7\t1\tA\tT",
        "1\tG1\tMissense_Mutation\tp.W2C\t7\t1\tA\tT", "1\tNEW\tIn_Frame_Del\tp.A1_C60del\t7\t1\tA\tT", "1\tNONE\tMissense_Mutation\tp.C2W\t7\t1\tA\tT", "total\t\t\t\t\t\t\t", "1\t\t\t\t\t\t\t",
    ]
    (tmp_path / "maf.tsv").write_text(text + "\n".join(rows) + "\n")
    columns = {"patient": "Patient ID", "gene": "Hugo Symbol", "class": "Variant Classification", "change": "Protein Change", "chrom": "Chromosome", "pos": "Start position", "ref": "Reference Allele", "alt": "Tumor Seq Allele2"}
    sheet = files.read_sheet(spark, str(tmp_path / "maf.tsv"), columns)
    isoforms = spark.createDataFrame([("G1", "T1", "ACDEFGHIK", False), ("G1", "T2", "ACDEF", True), ("NEW", "T3", "ACDEFGH", True)], "symbol string, transcript string, seq string, primary boolean")
    aliases = spark.createDataFrame([("OLD", "NEW")], "old string, new string")
    found = sheets.mutations(sheet, isoforms, [1, 2, 3], aliases)
    got = {(r.gene, r.transcript, r.consequence, r.protein_position, r.amino_acids, r.ref, r.pos) for r in found.where("dropped is null").collect()}
    assert got == {
        ("G1", "T2", "missense_variant", "2", "C/W", "A", 100), ("OLD", "T3", "inframe_deletion", "2-4", "CDE/-", "N", 101), ("G1", "T2", "inframe_insertion", "2", "-/WW", "A", 102),
    }
    kept, seen = sheets.tallied(found, sheets.MUTATION_DROPS, "maf")
    assert kept.count() == 3
    assert seen.get == {"rows": 13, "kept": 3, "dropped_patient": 1, "dropped_class": 4, "dropped_change": 3, "dropped_isoform": 2}
    told = {(r.dropped, r.detail): r.n for r in sheets.tally(found, "class").collect()}
    assert told == {("kept", None): 3, ("patient", None): 1, ("class", "Nonsense_Mutation"): 2, ("class", "Silent"): 1, ("class", ""): 1, ("change", None): 3, ("isoform", None): 2}
    assert sheets.mutations(sheet.limit(0), isoforms, [1]).count() == 0
    with pytest.raises(tables.SchemaError, match="Nothing"):
        files.read_sheet(spark, str(tmp_path / "maf.tsv"), {"patient": "Nothing"})


def test_assay_sheet_with_two_heading_lines(spark, tmp_path):
    lines = [
        "Table 5", "", "Patient ID\tGene\tProtein change\tPeptide\t\tELISPOT\t", "\t\t\tSequence\tHLA allele\tPulsed\tMinigene", "1\tG1\tp.C2W\tacdef\tA*02:01\t1\t0", "1\tG1\tp.C2W\tACDEF\tHLA-A*02:01\t0\tn.d.", "1\tG1\tp.C2W\tACX\tA*02:01\t1\t1",
        "2\tG1\tp.C2W\tACD\t\t1\t1", "2\tG1\tp.C2W\tACD\tA*02:01\tn.d.\t1", "note\t\t\t\t\t\t", "2\t\t\t\tA*02:01\t1\t1",
    ]
    (tmp_path / "t5.tsv").write_text("\n".join(lines) + "\n")
    columns = {"patient": "Patient ID", "gene": "Gene", "change": "Protein change", "peptide": "Sequence", "allele": "HLA allele", "pulsed": "ELISPOT", "minigene": "Minigene", "tumor": "Tumor"}
    assert files.merged_names([["A", "", "B"], ["x", "A", "B"]]) == {"x": 0, "A": 0, "B": 2}
    sheet = files.read_sheet(spark, str(tmp_path / "t5.tsv"), columns, 2, 2, optional=("tumor",))
    found = sheets.assay_labels(sheet, "pulsed", {"minigene": "minigene", "tumor": "tumor"}, "S-PT", "here")
    kept, seen = sheets.tallied(found, sheets.LABEL_DROPS, "labels")
    got = sorted(tuple(r) for r in kept.collect())
    assert got == [
        ("S-PT1", "ACDEF", "HLA-A*02:01", "ifng_elispot", "negative", "gene=G1;protein_change=p.C2W;minigene=nd;tumor=na;source=here"),
        ("S-PT1", "ACDEF", "HLA-A*02:01", "ifng_elispot", "positive", "gene=G1;protein_change=p.C2W;minigene=negative;tumor=na;source=here"),
    ]
    assert seen.get == {"rows": 6, "kept": 2, "dropped_peptide": 2, "dropped_allele": 1, "dropped_call": 1}


def test_annotation_columns(spark):
    rows = [("12-14/300", "LAV/-"), ("7", "G"), ("5-x", "-/W"), ("9-3", "R/A"), ("-", "-"), ("", None), ("x-4", "A/B/C"), (None, "")]
    frame = spark.createDataFrame(rows, "p string, a string")
    (start, end), (before, after) = variants.protein_span(F.col("p")), variants.residue_change(F.col("a"))
    got = [tuple(r) for r in frame.select(start, end, before, after).collect()]
    assert got == [(12, 14, "LAV", ""), (7, 7, "G", "G"), (5, 5, "", "W"), (9, 9, "R", "A"), (None, None, "", ""), (None, None, "", ""), (None, None, "A", "B/C"), (None, None, "", "")]
    tails = spark.createDataFrame([("MABCDE", "CDE", "4"), ("-", "CDE", " 4 "), ("", " ", "4"), ("MA", None, "x"), (None, "CDE", "x")], "w string, t string, n string")
    tail, change = variants.novel_tail(F.col("w"), F.col("t"), F.col("n"), F.lit(3))
    assert [tuple(r) for r in tails.select(tail, change).collect()] == [("BCDE", None), ("CDE", 4), (None, None), (None, None), ("CDE", None)]
    none, _ = variants.novel_tail(None, F.col("t"), None, F.lit(3))
    assert tails.select(none).first()[0] == "CDE"


def test_claims_files_and_verdicts(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Peptide\tgene\tprotein_change\tdownstream_protein\n CWDEF \tG1\tp.C2W\t\nAWDEF\tG1\tp.C2W\t\n\tG1\tp.C2W\t\nAWDEF\tG9\tp.C2W\t\n")
    stated = tables.read_claims(spark, str(tmp_path / "c.tsv"))
    assert sorted((r.peptide, r.source, r.downstream) for r in stated.collect()) == [("AWDEF", "", None), ("AWDEF", "", None), ("CWDEF", "", None)]
    isoforms = spark.createDataFrame([("G1", "T1", "ACDEFGHIK", True)], "symbol string, transcript string, seq string, primary boolean")
    verdicts = claims.reconcile(stated, isoforms)
    table = claims.verdict_table(stated, verdicts)
    tables.write_tsv(table, str(tmp_path / "out"), list(claims.VERDICT))
    back = tables.read_tsv(spark, str(tmp_path / "out"))
    assert tuple(back.columns) == claims.VERDICT
    assert sorted((r.peptide, r.gene, r.verdict, r.transcript) for r in back.collect()) == [
        ("AWDEF", "G1", "derivable", "T1"), ("AWDEF", "G9", "gene_not_found", None), ("CWDEF", "G1", "peptide_not_generated", "T1"),
    ]
    assert {r.verdict: r.n for r in claims.verdict_counts(verdicts).collect()} == {**dict.fromkeys(claims.DETAILS, 0), "derivable": 1, "gene_not_found": 1, "peptide_not_generated": 1}
    (tmp_path / "d.tsv").write_text("peptide\n")
    with pytest.raises(tables.SchemaError):
        tables.read_claims(spark, str(tmp_path / "d.tsv"))


def test_settings_and_samples(spark, tmp_path):
    folder = str(tmp_path)
    assert config.read_config(spark, folder=folder) == {}
    (tmp_path / "siftline.toml").write_text("[weights]\nclonality = 2\n")
    assert config.read_config(spark, folder=folder) == {"weights": {"clonality": 2}}
    (tmp_path / "siftline.yaml").write_text("")
    assert config.read_config(spark, folder=folder) == {}
    (tmp_path / "s.json").write_text('{"sample_id": "s", "tumor_purity": 0.5, "processed": {"variant_tsv": "v.tsv", "proteome_fasta": "/p.fa", "expression_tsv": null}}')
    assert config.read_sample(spark, f"{folder}/s.json")["processed"] == {"variant_tsv": f"{folder}/v.tsv", "proteome_fasta": "/p.fa", "expression_tsv": None}
    bad = ["[1]", '{"processed": {"variant_tsv": "v"}}', '{"sample_id": "s"}', '{"sample_id": "s", "processed": {"variant_tsv": "v", "somatic_vcf": "w"}}', '{"sample_id": "s", "tumor_purity": 0, "processed": {"variant_tsv": "v"}}']
    for i, text in enumerate(bad):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(config.ConfigError):
            config.read_sample(spark, f"{folder}/bad{i}.json")
    with pytest.raises(config.ConfigError, match="no such file"):
        config.read_config(spark, f"{folder}/none.yaml")


def test_runs_are_listed_newest_first(spark, tmp_path):
    for name, at in (("a", "2026-01-02T00:00:00"), ("b", "2026-01-03T00:00:00"), ("c", "2026-01-01T00:00:00")):
        manifest.write_manifest(spark, {"run_id": name, "sample_id": "s", "started_at": at, "counts": {"n": 1}}, str(tmp_path / "runs" / name))
    assert [(r.run_id, r.counts) for r in manifest.runs(spark, str(tmp_path / "runs")).collect()] == [("b", {"n": 1}), ("a", {"n": 1}), ("c", {"n": 1})]


@pytest.mark.parametrize(("size", "a", "b"), [(5, 1, 2), (40, 2, 3), (7, 3, 1), (0, 1, 1)])
def test_two_caps_equal_a_plain_pick(spark, size, a, b):
    rows = [(i, None if i % 11 == 0 else f"v{i * 7 % 9}", None if i % 13 == 0 else f"a{i * 5 % 4}", float(i * 37 % 101)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, variant string, allele string, acq double")
    got = learning.active_batch(frame, [F.desc("acq"), F.asc("id")], size, a, b)
    used: dict = {}
    want = []
    for i, v, al, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(want) < size and used.get(("v", v), 0) < a and used.get(("a", al), 0) < b:
            used[("v", v)], used[("a", al)] = used.get(("v", v), 0) + 1, used.get(("a", al), 0) + 1
            want.append(i)
    assert [r.id for r in got.orderBy("rank").collect()] == want


def test_least_sample_equals_the_whole_curve(spark):
    for population, successes, odds in ((5000, 115, 2.5), (40, 10, 3.0), (2000, 900, 1.3)):
        whole = statistics.smallest_sample(statistics.power_curve(spark, population, successes, odds), 0.8).first().min_n
        assert statistics.least_sample(spark, population, successes, odds, 0.8) == whole
    assert statistics.least_sample(spark, 30, 3, 1.0, 0.9) is None


def test_screen_and_overlap(spark):
    values = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "feature string, value int")
    listed = spark.createDataFrame([("a", "screen"), ("b", "spike_in"), ("a", " screen ")], "feature string, role string")
    assert [r.feature for r in statistics.screened(values, listed).collect()] == ["a"]
    rankings = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", "y"), ("n", "z"), ("n", None)], "method string, key string")
    got = evaluation.key_overlap(spark.createDataFrame([("x",), ("x",), (None,)], "key string"), rankings)
    assert {tuple(r) for r in got.collect()} == {("m", 2, 1), ("n", 1, 0)}


VCF = """##fileformat=VCFv4.2
##INFO=<ID=CSQ,Description="x Format: Allele|Consequence|SYMBOL|Feature|BIOTYPE|Protein_position|Amino_acids|CANONICAL|DownstreamProtein|ProteinLengthChange">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	TUMOR
1	100	.	A	T	.	PASS	CSQ=T|missense_variant|G1|T1|protein_coding|12|R/W|YES||	AD:DP	60,40:100
1	200	.	A	T	.	PASS	CSQ=T|missense_variant|G2|T2|protein_coding|12|R/W|YES||	AD:DP	98,2:100
1	300	.	A	T	.	PASS	CSQ=T|frameshift_variant|G2|T2|protein_coding|10/24|H/X|YES|WWWWKKKK|	AD:DP	60,40:100
1	400	.	A	T	.	PASS	CSQ=T|missense_variant|G2|T2|protein_coding||R/W|YES||	AD:DP	60,40:100
"""


def test_from_file_to_report(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    changes = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert changes.count() == 3
    seq = "ACDEFGHIKLMRNPQSTVWYACDE"
    other = "ACDEFGHIKHMRNPQSTVWYACDE"
    proteins = spark.createDataFrame([("P1", "T1", "G1", seq), ("P2", "T2", "G2", other), ("P3", "T3", "G3", "DEFGHIKLMW")], "protein string, transcript string, symbol string, seq string")
    found = runs.rank(changes, proteins, ["HLA-A*02:01"], lengths=(9, 10), max_percentile=100.0, top_n=50, cap=50, shift_cap=50, sample_id="s", run_id="r")
    assert {(r.pos, r.reason) for r in found.judged.collect()} == {(100, None), (200, "low_vaf"), (300, None)}
    table = found.table.orderBy("rank").collect()
    assert [r["rank"] for r in table] == list(range(1, len(table) + 1)) and [r.score for r in table] == sorted((r.score for r in table), reverse=True)
    mutant = seq[:11] + "W" + seq[12:]
    shifted = other[:9] + "WWWWKKKK"
    want = {mutant[i : i + n] for n in (9, 10) for i in range(12 - n, 12)} | {shifted[i : i + n] for n in (9, 10) for i in range(len(shifted) - n + 1) if i + n > 9}
    scored = {r.peptide: r for r in found.scored.collect()}
    assert set(scored) == want
    assert {r.mutant_peptide for r in table} == {p for p, r in scored.items() if not r.gate_failures}
    own = {p for p, r in scored.items() if "self_peptide" in r.gate_failures}
    assert own == {p for p in want if p in "DEFGHIKLMW"} and own

    keys = sorted(f"{p}|HLA-A*02:01" for p in want)
    labels = spark.createDataFrame([(k, i % 3 == 0 and 1 or 0, f"s{i % 2}") for i, k in enumerate(keys)] + [("none", None, "s0")], "key string, label int, stratum string")
    results = runs.benchmark({"own": found, "again": found}, labels, 5, 50, "again")
    cover = {r.method: r for r in results["coverage"].collect()}
    assert cover["own"].labels == len(keys) + 1 and cover["own"].usable == cover["own"].scored == len(keys) and cover["own"].positives_scored == -(-len(keys) // 3)
    text = runs.report(results, [{"path": "a.vcf", "digest": "sha256:0"}])
    assert text.count("## ") == 6 and "| own | " in text and "sha256:0" in text and "Paired" in text
    assert {r.method for r in results["paired"].collect()} == {"own"} and results["paired"].first().hits_p == 1.0
