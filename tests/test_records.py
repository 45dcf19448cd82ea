"""Rules counted in one pass, manifests and submissions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import checks
from siftline.sources import manifest, submissions


def test_rules_and_counts_in_one_pass(spark, tmp_path):
    rows = [
        ("ACDEFGHI", "ACDEFGHK", 8, "", ""), ("ACDEFGHI", "ACDEFGHI", 9, None, "X"), ("ACD", "AC", 0, "", ""), ("ACDEFGHIB", None, 1, "", ""), ("ACDEFGHI", None, None, "AC", "DE"),
    ]
    frame = spark.createDataFrame(rows, "peptide string, wildtype string, position int, n_flank string, c_flank string")
    judged, seen = checks.observed(frame, checks.candidate_rules())
    got = [r.broken for r in judged.collect()]
    assert sorted(map(tuple, got)) == sorted([(), ("unknown_residue", "position_outside", "wildtype_identical"), ("length_outside", "position_outside", "register_differs"), ("unknown_residue",), ()])
    want = {"rows": 5, "length_outside": 1, "unknown_residue": 2, "position_outside": 2, "register_differs": 1, "wildtype_identical": 1}
    assert seen.get == want
    assert {r.rule: r.n for r in checks.rule_counts(frame, checks.candidate_rules()).collect()} == {k: v for k, v in want.items() if k != "rows"}
    spans = spark.createDataFrame([(5, 4), (5, 5), (None, 4)], "protein_start int, protein_end int")
    assert [r.n for r in checks.rule_counts(spans, checks.variant_rules()).collect()] == [1]

    (tmp_path / "in.tsv").write_text("a\tb\n")
    record = manifest.started(spark, "s", {"purity": 0.5}, "null", [str(tmp_path / "in.tsv")])
    manifest.write_manifest(spark, manifest.finished(record, seen.get, {"rows": 6}), str(tmp_path / "run"))
    back = manifest.read_manifest(spark, str(tmp_path / "run"))
    assert back["counts"] == want | {"rows": 6} and back["inputs"][0]["bytes"] == 4 and back["inputs"][0]["digest"].startswith("sha256:") and back["finished_at"] >= back["started_at"]
    with pytest.raises(Exception, match="exists"):
        manifest.write_manifest(spark, record, str(tmp_path / "run"))


def test_submissions_of_all_shapes(spark, tmp_path):
    answers = {
        "lists": {"leaked_pairs": [["acd", "A0201"], ["ACD", "HLA-A*02:01", 1], ["A"], [1, 2], 5, None, []]},
        "objects": {"leaked_pairs": [{"peptide": "Ac d", "mhc_allele": "B*07:02"}, {"peptide": None, "mhc_allele": "B*07:02"}, {}, {"peptide": True, "mhc_allele": "A0201"}]},
        "side": {"leaked_pairs": None}, "none": {}, "text": {"leaked_pairs": "x"}, "empty": {"leaked_pairs": []}, "array": [1], "only_side": None,
    }
    for name, answer in answers.items():
        (tmp_path / name).mkdir()
        if answer is not None:
            (tmp_path / name / "submission.json").write_text(json.dumps(answer))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "submission.json").write_text('{"leaked_pairs": [')
    (tmp_path / "side" / "leaked_pairs.csv").write_text('pep_tide,mhc\nACD,A*02:01\n"EFG",bad\nH\n')
    (tmp_path / "only_side" / "leaked_pairs.csv").write_text("ACD,A*02:01\n")
    found = submissions.submitted_pairs(submissions.read_submissions(spark, str(tmp_path))).collect()
    got = {r.submission: (r.valid, r.listed, r.stated, r.malformed, [tuple(p) for p in r.pairs]) for r in found}
    acd = ("ACD", "HLA-A*02:01")
    assert got == {
        "lists": (True, True, 7, 5, [acd]), "objects": (True, True, 4, 3, [("ACD", "HLA-B*07:02")]), "side": (True, True, 2, 1, [acd]), "none": (True, False, 0, 0, []),
        "text": (True, False, 0, 0, []), "empty": (True, True, 0, 0, []), "array": (False, False, 0, 0, []), "broken": (False, False, 0, 0, []), "only_side": (False, False, 0, 0, []),
    }


def test_submissions_of_odd_texts(spark):
    """Texts around an object, items of other kinds, keys in another case, and ends of lines that the patterns let pass."""
    acd, listed = ("ACD", "HLA-A*02:01"), '{"leaked_pairs": %s}'
    none, bad = (True, False, 0, 0, []), (False, False, 0, 0, [])
    want = {
        None: bad, "": bad, "null": bad, '"{}"': bad, "[{}]": bad, "\x0b{}": bad, "{a: 1}": bad, '{"a": 1, "a": 2}': bad, " \n\t\r{}": none, "{} x": none,
        '{"Leaked_Pairs": [["ACD", "A0201"]]}': none, '{"x": {"leaked_pairs": [["ACD", "A0201"]]}}': none,
        **{listed % x: none for x in ("true", "1.5", '"[]"', "{}", '{"peptide": "ACD", "mhc_allele": "A0201"}', '{"0": ["ACD", "A0201"]}')},
        listed % '[null, 7, true, "ACD,A0201", [["ACD"], "A0201"], [1, "A0201"], {"Peptide": "ACD", "mhc_allele": "A0201"}, {"0": "ACD", "1": "A0201"}]': (True, True, 8, 8, []),
        listed % '[{"peptide": {"a": 1}, "mhc_allele": "A0201"}, {"peptide": "A C D", "mhc_allele": "A_0201", "n": [1]}, ["acd", "hla-a02:01:03", {"y": 1}]]': (True, True, 3, 2, [acd]),
        listed % '[["Z", "B0702"], ["A", "B0702"], ["Z", "A0201"], ["z", "A0201\\n"], ["\u00df", "A0201"]]': (True, True, 5, 0, [("A", "HLA-B*07:02"), ("SS", acd[1]), ("Z", acd[1]), ("Z", "HLA-B*07:02")]),
    }
    rows = spark.createDataFrame([(i, a, None) for i, a in enumerate(want)], "submission int, answer string, side string")
    got = {r.submission: (r.valid, r.listed, r.stated, r.malformed, [tuple(p) for p in r.pairs]) for r in submissions.submitted_pairs(rows).collect()}
    assert {a: got[i] for i, a in enumerate(want)} == want


def test_submissions_are_not_taken_apart_for_their_kinds(spark):
    """The schema of a variant takes all of its parts: it is asked for the two texts of a pair only, and no comparison of pairs is interpreted."""
    found = submissions.submitted_pairs(spark.createDataFrame([(1, '{"leaked_pairs": [["ACD", "A0201"]]}', None)], "submission int, answer string, side string"))
    assert [tuple(p) for p in found.first().pairs] == [("ACD", "HLA-A*02:01")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("schemaofvariant(") == 2 and plan.count("try_parse_json") + plan.count("parsejson(") == 1 and "array_sort(" not in plan


def test_side_file_without_header(spark):
    got = spark.range(1).select(submissions.side_rows(F.lit("ACD,A*02:01,x\nonly\n")).alias("r")).first().r
    assert [tuple(r) for r in got] == [("ACD", "A*02:01")]
