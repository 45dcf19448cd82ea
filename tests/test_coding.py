"""Coding spans and positions, and results recomputed from files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.operators import coding
from siftline.sources import annotations, sequences


def test_spans_follow_the_strand(spark):
    spans = spark.createDataFrame([("t", "c", 11, 20, "+"), ("t", "c", 31, 40, "+"), ("u", "c", 11, 20, "-"), ("u", "c", 31, 40, "-"), ("far", "c", 40_001, 90_000, "+")], "transcript string, sequence string, start long, end long, strand string")
    assert sorted(tuple(r) for r in coding.span_offsets(spans).select("transcript", "start", "before").collect()) == [("far", 40001, 0), ("t", 11, 0), ("t", 31, 10), ("u", 11, 10), ("u", 31, 0)]
    variants = spark.createDataFrame([("a", "c", 12, "AC", "A"), ("b", "c", 20, "AC", "A"), ("d", "c", 40, "G", "T"), ("e", "c", 50_000, "G", "T"), ("f", "other", 12, "A", "C")], "variant_id string, sequence string, pos long, ref string, alt string")
    got = coding.coding_positions(variants, coding.span_offsets(spans)).select("variant_id", "transcript", "cds_pos", "ref", "alt").collect()
    assert sorted(tuple(r) for r in got) == [
        ("a", "t", 1, "AC", "A"), ("a", "u", 17, "GT", "T"), ("d", "t", 19, "G", "T"), ("d", "u", 0, "C", "A"), ("e", "far", 9999, "G", "T"),
    ]


@pytest.mark.parametrize(("pos", "ref", "alt", "offset", "peptide"), [(3, "G", "T", 1, "F*"), (4, "", "A", 1, "DL"), (3, "GTT", "", 1, "*"), (0, "A", "", 0, "WFK"), (11, "A", "AA", 3, "K")])
def test_downstream(spark, pos, ref, alt, offset, peptide):
    cds = F.lit("ATGGTTTAAA")
    got = spark.range(1).select(coding.downstream(cds, F.lit(pos), F.lit(ref), F.lit(alt)).alias("m")).first().m
    assert (got.start_offset, got.peptide) == (offset, peptide)


def test_recompute_from_files(spark, tmp_path):
    (tmp_path / "t.fa").write_text(">T1 first\nccATGGTT\nTAAA\n>T2\nATGAAATTT\n")
    (tmp_path / "a.gff3").write_text(
        "##gff-version 3\nT1\tx\tCDS\t3\t12\t.\t+\t0\tID=c;Parent=transcript:T1\n##transcript-origin 100\nT2\tx\tmRNA\t101\t109\t.\t+\t.\tID=T2\n"
        "T2\tx\tCDS\t101\t109\t.\t+\t0\tID=d\nshort\tline\n"
    )
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nT1\t6\tv1\tG\tT\t.\t.\tTRANSCRIPT=T1;CDSPOS=4;DB\nT2\t5\tv2\tA\t\t.\t.\tCDSPOS=5;TRANSCRIPT=T2\nT9\t1\tv3\tA\tC\t.\t.\tTRANSCRIPT=T9;CDSPOS=1\n")
    (tmp_path / "r.csv").write_text("variant_id,downstream_peptide,start_offset\nv1,F*,1\nv2,NF,2\nv3,,x\n")
    spans = annotations.read_cds_spans(spark, str(tmp_path / "a.gff3"))
    assert sorted(tuple(r) for r in spans.collect()) == [("T1", "T1", 3, 12, "+"), ("T2", "T2", 1, 9, "+")]
    variants = annotations.read_coding_variants(spark, str(tmp_path / "v.vcf"))
    transcripts = sequences.read_fasta(spark, str(tmp_path / "t.fa")).select(F.col("name").alias("transcript"), "seq")
    found = coding.recomputed(variants, transcripts, spans)
    assert sorted(tuple(r) for r in found.collect()) == [("v1", "F*", 1), ("v2", "N", 1)]
    judged = coding.drift(annotations.read_reported(spark, str(tmp_path / "r.csv")), found).select("variant_id", "verdict", "drift").collect()
    assert sorted(tuple(r) for r in judged) == [("v1", "equal", 0), ("v2", "offset_drift", 1), ("v3", "not_recomputed", None)]


def test_origin_is_carried_over_blocks(spark):
    lines = spark.createDataFrame([("f", 0, 1, None), ("f", 0, 2, 5), ("f", 10, 7, None), ("f", 20, 9, 6), ("f", 20, 10, None), ("g", 0, 3, None)], "file string, block long, at long, v int")
    got = annotations.carried(lines, F.col("v"), "out").select("file", "at", "out").collect()
    assert sorted(((r.file, r.at, r.out) for r in got), key=str) == sorted([("f", 1, None), ("f", 2, 5), ("f", 7, 5), ("f", 9, 6), ("f", 10, 6), ("g", 3, None)], key=str)
