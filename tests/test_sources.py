"""Readers and writers over small files."""

from __future__ import annotations

import gzip

import pytest

from siftline.sources import sequences, tables, vcf

VCF = """##fileformat=VCFv4.2
##VEP="v114.2" ensembl=114
##INFO=<ID=CSQ,Description="x Format: Allele|Consequence|SYMBOL|Feature|BIOTYPE|Protein_position|Amino_acids|CANONICAL">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	NORMAL	TUMOR
1	100	.	A	T	.	PASS	SOMATIC;gnomAD_AF=0.01;CSQ=T|intron_variant|G1|T1|protein_coding|||,T|missense_variant|G1|T2|protein_coding|12|G/D|,T|missense_variant|G1|T3|protein_coding|12|G/D|YES	AD:DP	9,1:10	6,4:10
2	200	.	A	T	.	q10;low	CSQ=T|intron_variant|G1|T1|protein_coding|||	AD:DP	9,1:10	6,4:10
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    rows = vcf.read_vcf(spark, str(tmp_path / "a.vcf")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.csq.Feature, r.consequence, r.tumor_depth, r.release, r.filters) == ("T3", "missense", 10, 114, ["PASS"])
    assert r.dna_vaf == pytest.approx(0.4)
    assert r.population_af == pytest.approx(0.01)


def test_vcf_without_annotation(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\n")
    with pytest.raises(vcf.VCFError):
        vcf.read_vcf(spark, str(tmp_path / "a.vcf"))


def test_fasta(spark, tmp_path):
    text = ">P1.2 pep gene:G1.1 transcript:T1.3 gene_symbol:ABC\nacde\nFGH\n>P2\nKK\n"
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(text)
    got = {r.protein: r for r in sequences.proteins(sequences.read_fasta(spark, str(tmp_path / "a.fa.gz"))).collect()}
    assert (got["P1"].seq, got["P1"].transcript, got["P1"].gene, got["P1"].symbol) == ("ACDEFGH", "T1", "G1", "ABC")
    assert got["P2"].symbol is None


def test_variant_table(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("Chrom\tpos\tref\talt\tgene\ttranscript\tconsequence\tprotein_position\tamino_acids\tdna_vaf\tfilter\n1\t5\tA\tT\tG\tT1\tmissense_variant\t41-43\tLAV/-\t0.3,0.2\tPASS\n1\t6\tA\tT\tG\tT1\tx\t.\tA/B\t.\t.\n")
    rows = tables.read_variants(spark, str(tmp_path / "v.tsv")).collect()
    assert [(r.start, r.end, r.dna_vaf, r.filters) for r in rows] == [(41, 43, 0.3, ["PASS"])]
    (tmp_path / "w.tsv").write_text("chrom\n1\n")
    with pytest.raises(tables.SchemaError):
        tables.read_variants(spark, str(tmp_path / "w.tsv"))


def test_rankings_and_labels(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("sample_id\tpeptide\tallele\tscore\ns\tP\t\t0.5\ns\tP\t\t0.7\ns\t\t\t0.1\ns\tQ\tA\t.\n")
    assert [(r.key, r.score) for r in tables.read_ranking(spark, str(tmp_path / "r.tsv"), "m").collect()] == [("s|P|*", 0.7)]
    (tmp_path / "l.tsv").write_text("sample_id\tpeptide\tcall\ns\tP\tpositive\ns\tQ\tindeterminate\n")
    assert {r.key: r.label for r in tables.read_labels(spark, str(tmp_path / "l.tsv")).collect()} == {"s|P|*": 1, "s|Q|*": None}


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("a", float("nan"), 1)], "k string, x double, n int")
    tables.write_tsv(frame, str(tmp_path / "t"), ["k", "n"])
    assert tables.read_tsv(spark, str(tmp_path / "t")).first().asDict() == {"k": "a", "n": "1"}
    tables.write_features(frame, str(tmp_path / "f"))
    assert "x" not in spark.read.json(str(tmp_path / "f")).first().asDict()
    assert tables.file_digests(spark, [str(tmp_path / "t" / "*.csv")]).count() >= 1
    assert tables.config_digest({"b": 1, "a": 2}) == tables.config_digest({"a": 2, "b": 1})


def test_vcf_odd_lines(spark, tmp_path):
    from siftline.sources import vcf

    head = '##INFO=<ID=CSQ,Number=.,Type=String,Description="Format: Consequence|SYMBOL">\n'
    eight = head + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t5\tx\tA\tC\t.\tPASS\tCSQ=missense_variant|G;POPAF=0.1;POPAF=0.2;FLAG\n1\t6\ty\tA\tC\t.\tPASS\t.\n"
    (tmp_path / "eight.vcf").write_text(eight)
    row = vcf.read_vcf(spark, str(tmp_path / "eight.vcf")).first()
    assert (row.dna_vaf, row.tumor_depth, row.population_af) == (None, None, 0.2)
    calls = {"GT:AD": "0/1:.", "AD:DP": "3,1:9", "AD:AD": "1,1:6,2", "AD:AF": "7:0.25", "AF:AD": "0.5:3,x", "DP:AD": "8:.", "AD": "0,0"}
    want = {"GT:AD": (None, None), "AD:DP": (0.25, 9), "AD:AD": (0.25, 8), "AD:AF": (0.25, None), "AF:AD": (0.5, None), "DP:AD": (None, 8), "AD": (None, None)}
    lines = [f"1\t{i}\t{fmt}\tA\tC\t.\tPASS\tCSQ=missense_variant|G\t{fmt}\t{call}" for i, (fmt, call) in enumerate(calls.items())]
    (tmp_path / "calls.vcf").write_text(head + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tTUMOR\n" + "\n".join(lines) + "\n")
    got = {r.id: (r.dna_vaf, r.tumor_depth) for r in vcf.read_vcf(spark, str(tmp_path / "calls.vcf")).collect()}
    assert got == want
