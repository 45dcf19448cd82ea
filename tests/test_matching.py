"""Self matches over lengths, genotypes, eligibility and the feature index."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import names
from siftline.operators import matching, ranking
from siftline.sources import tables


@pytest.mark.parametrize("most", [matching.MOST_PREFIXES, 3])
def test_self_matches_of_all_lengths(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_PREFIXES", most)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ACDEFG", k=rng.randint(0, 400))) for _ in range(40)] + ["", "ACXDEFGHIKL", "MNPQRSTVWY" * 3]
    asked = {t[i : i + n] for t in texts for i in (0, 5, len(t) - 9) if i >= 0 for n in (3, 7, 8, 9, 12) if len(t) >= i + n}
    asked |= {"".join(rng.choices("ACDEFG", k=n)) for n in (5, 8, 11) for _ in range(60)} | {"CXD", "acd", "", "NPQRSTVWYM", "WYMNPQRSTVWY"}
    got = matching.self_matches(spark.createDataFrame([(p,) for p in [*asked, None]], "peptide string"), spark.createDataFrame([(t,) for t in [*texts, None]], "seq string"))
    want = {p for p in asked if p and set(p) <= set("ACDEFGHIKLMNPQRSTVWY") and any(p in t for t in texts)}
    assert {r.peptide for r in got.collect()} == want and got.count() == len(want)


def test_matches_across_pieces(spark, monkeypatch):
    text = "".join(random.Random(1).choices("ACDEFGHIKLMNPQRSTVWY", k=300))
    asked = [text[i : i + 9] for i in range(292)]
    found = matching.self_matches(spark.createDataFrame([(p,) for p in asked], "peptide string"), spark.createDataFrame([(text,)], "seq string"))
    assert found.count() == len(set(asked))
    assert matching.self_matches(spark.createDataFrame([], "peptide string"), spark.createDataFrame([(text,)], "seq string")).count() == 0


def test_only_presentable_peptides_are_looked_up(spark):
    calls = spark.createDataFrame([("ACDEFGHI", 1.0, None), ("CDEFGHIK", 3.0, 0.9), ("DEFGHIKL", None, 0.1), ("DEFGHIKL", 1.0, 0.9), ("WWWWWWWW", None, None)], "peptide string, affinity_percentile double, presentation_score double")
    assert {r.peptide for r in ranking.presentable(calls, 2.0, 0.5).collect()} == {"ACDEFGHI", "DEFGHIKL", "WWWWWWWW"}
    reference = spark.createDataFrame([("p", "AACDEFGHIKLM")], "protein string, seq string")
    rows = calls.select("peptide", F.lit(1).alias("kept"))
    got = {(r.peptide, r.is_self, r.self_similarity) for r in ranking.self_scanned(rows, calls, reference, "protein", 2.0, 0.5).collect()}
    assert got == {("ACDEFGHI", True, 1.0), ("CDEFGHIK", False, None), ("DEFGHIKL", True, 1.0), ("WWWWWWWW", False, 0.0)}
    assert ranking.self_scanned(rows, None, reference).where("is_self").count() == 4


def test_genotypes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# genotype\nA0201\nB*07:02\n\nC08:02 , A*02:01;rubbish\n")
    (tmp_path / "b.tsv").write_text("sample\tAllele\nS1\tA0201\nS1\tA0201\nS1\t\nS1\tDRB1*04:01\nS1\n")
    (tmp_path / "c.txt").write_text("")
    got = {r.path.rsplit("/", 1)[1]: (r.alleles, r.unreadable) for r in tables.read_genotypes(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (["HLA-A*02:01", "HLA-B*07:02", "HLA-C*08:02"], ["rubbish"]), "b.tsv": (["HLA-A*02:01", "HLA-DRB1*04:01"], []), **({"c.txt": ([], [])} if "c.txt" in got else {})}
    one = spark.range(1).select(names.gene_of(F.lit("HLA-DRB1*04:01")).alias("g"), names.is_class_i(F.lit("HLA-C*08:02")).alias("c"), names.is_class_i(F.lit("HLA-DRB1*04:01")).alias("d")).first()
    assert (one.g, one.c, one.d) == ("DRB1", True, False)


def test_eligible_entries(spark):
    catalog = spark.createDataFrame([("k", ["a", "b", "a"]), ("l", ["c"]), ("m", []), ("n", None)], "entry string, restricting array<string>")
    owned = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "c"]), (3, []), (4, None)], "sample int, alleles array<string>")
    assert sorted(tuple(r) for r in matching.eligible(catalog, owned, "entry", "sample").collect()) == [("k", 1), ("l", 2)]


def test_feature_index_keeps_order(spark, tmp_path):
    row = lambda allele, x: {"sample_id": "s", "peptide": "P", "allele": allele, "features": {"x": x}}
    (tmp_path / "z.json").write_text(json.dumps([row("a", 1.0), row("b", 2.0), row("a", 3.0)]))
    (tmp_path / "a.json").write_text(json.dumps([row("b", 4.0), {**row("c", 5.0), "peptide": "Q"}, {**row("*", 6.0), "peptide": "Q"}]))
    got = {r.key: r.features.x for r in tables.read_feature_index(spark, [str(tmp_path / "z.json"), str(tmp_path / "a.json")]).collect()}
    assert got == {"s|P|a": 3.0, "s|P|b": 4.0, "s|P|*": 1.0, "s|Q|c": 5.0, "s|Q|*": 6.0}
