"""Steps whose rows, passes or shuffles must not grow faster than their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import names
from siftline.operators import audit, coding, ensembles, matching, peptides, permutation, ranking, scoring

from .conftest import SF


def operators(frame: DataFrame) -> list:
    """The physical operators of a frame that has been collected."""
    out, queue = [], [frame._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            queue.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            queue.append(node.plan())
            continue
        out.append(node)
        queue += [node.children().apply(i) for i in range(node.children().size())]
    return out


def most_rows(frame: DataFrame) -> int:
    """The rows of the operator that made most."""
    counted = [node.metrics().get("numOutputRows") for node in operators(frame)]
    return max(c.get().value() for c in counted if c.isDefined())


def exchanges(frame: DataFrame) -> list[str]:
    """The columns of each shuffle."""
    return [node.output().mkString(",") for node in operators(frame) if node.nodeName() == "Exchange"]


def test_eligible_counts(spark):
    catalog = spark.createDataFrame([("k", ["a", "b", "a"]), ("l", ["c"]), ("l", ["a", None]), ("m", []), ("n", None), ("o", ["z"])], "entry string, restricting array<string>")
    owned = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "c"]), (2, ["a"]), (3, []), (4, None), (5, ["a", "b"])], "sample int, alleles array<string>")
    got = sorted(tuple(r) for r in matching.eligible_counts(catalog, owned, "entry", "sample").collect())
    pairs = matching.eligible(catalog, owned, "entry", "sample").groupBy("entry").agg(F.count("*"), F.min("sample"))
    assert got == sorted(tuple(r) for r in pairs.collect()) == [("k", 3, 1), ("l", 3, 1)]


def test_entries_and_samples_of_few_alleles_make_no_pairs(spark):
    from siftline.plans import registry

    folder = {"part": spark.range(2000).select((F.col("id") * 437).alias("p_partkey"), (F.col("id") % 2).alias("p_size")), "customer": spark.range(2000).select((F.col("id") * 2185).alias("c_custkey"))}
    read, registry.read = registry.read, lambda _, __, table: folder[table]
    try:
        found = registry.eligible_entries(spark, "")
        assert {(r.samples, r.first_sample) for r in found.collect()} == {(2000, 0)}
    finally:
        registry.read = read
    assert most_rows(found) <= 2000 * 4


def test_scores_are_computed_once_for_the_deviation(spark):
    """Each score is a Python call that counts itself; no score may be computed again for another."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def scores(x: float) -> list[float]:
        calls.add(1)
        return [x, x + 0.1, x + 0.2]

    members = spark.createDataFrame([(i, n, float(i)) for i in range(40) for n in ("a", "bias")], "member int, name string, weight double")
    column = ensembles.weight_uncertainty(ensembles.member_scores(members, ["a"]))
    assert column._jc.toString().count("exp(") == 1
    spread = spark.range(4).select(F.round(ensembles.weight_uncertainty(scores(F.col("id") / 10)), 6).alias("s"))
    assert [r.s for r in spread.collect()] == [0.2] * 4
    assert calls.value == 4


def test_peptides_of_lone_rows_are_not_shuffled(spark):
    columns = "variant string, variant_class string, seq string, mutant string, first int, last int"
    rows = [("a", "missense", "AAAAAAAAAAAAAAAAAAAA", "AAAAAAAAAACAAAAAAAAA", 10, 11), ("b", "frameshift", "MKLVMKLVMKLV", "MAAAAAAAAAAAAAAAAAAA", 1, 20),
            ("b", "frameshift", "MKLVMKLVMKLV", "CCAAAAAAAAAAAAAAAAAA", 2, 20), (None, "missense", "CDEFGHIKLM", "CDEFGHIKLN", 9, 10), (None, "missense", "CDEFGHIKLM", "CDEFGHIKLN", 9, 10), ("z", "missense", "CDEF", "CDEX", 3, 4)]
    built = spark.createDataFrame(rows, columns)
    found = peptides.peptides(built, "variant", (9,))
    got = sorted((r.variant or "", r.start, r.length, r.peptide, r.position) for r in found.collect())
    # A frameshift repeats one text, which also another row of its id has: the first place of all counts.
    assert [g for g in got if g[0] == "b"] == [("b", 0, 9, "CCAAAAAAA", 3), ("b", 0, 9, "MAAAAAAAA", 2), ("b", 1, 9, "AAAAAAAAA", 1), ("b", 1, 9, "CAAAAAAAA", 2)]
    assert [g for g in got if g[0] == ""] == [("", 1, 9, "DEFGHIKLN", 9)] and sum(g[0] == "a" for g in got) == 9
    lone = peptides.peptides(built.where("variant in ('a', 'z')"), "variant", (9,))
    assert len(lone.collect()) == 9
    assert all("peptide" not in text for text in exchanges(lone))


def test_proteins_are_not_sent_to_all_tasks(spark):
    variants = spark.createDataFrame([("v", "T1.2", "G9"), ("w", "P2", None), ("x", None, "G3"), ("y", None, None), ("z", "", "")], "variant string, transcript string, gene string")
    proteins = spark.createDataFrame([("P1", "T1", "G1", "AC"), ("P2", "T2", "G2", "CD"), ("P3", "T3", "G3", "DE"), ("P4", "", "", "EF")], "protein string, transcript string, symbol string, seq string")
    found = peptides.with_protein(variants, proteins)
    assert {r.variant: r.seq for r in found.collect()} == {"v": "AC", "w": "CD", "x": "DE", "y": None, "z": None}
    assert not [n for n in operators(found) if n.nodeName() == "BroadcastExchange"]


def test_names_with_a_protein_are_not_looked_up_again(spark, monkeypatch):
    proteins = [("P1", "T1", "G1", "AC"), ("P2", "T1", "G1", "ACD"), ("P3", "T3", None, "DE"), ("T1", None, "G9", "EEEE"), (None, "T4", "G4", "EF"), ("P5", None, "", ""), ("P3", "T3", None, "DE")]
    known = spark.createDataFrame(proteins, "protein string, transcript string, symbol string, seq string")
    names = [("T1.2", "G4"), ("P3", "G1"), (None, "G9"), ("none", "G4"), ("", ""), (None, None), ("P5", "none"), ("T1.2", "G4")]
    variants = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "variant int, transcript string, gene string")
    want = {0: "ACD", 1: "DE", 2: "EEEE", 3: "EF", 4: None, 5: None, 6: None, 7: "ACD"}
    for most in (peptides.MOST_IDS, 0):  # names that are left are few, or too many to be sent
        monkeypatch.setattr(peptides, "MOST_IDS", most)
        got = peptides.with_protein(variants, known).collect()
        assert len(got) == 8 and {r.variant: r.seq for r in got} == want and got[0].asDict().keys() == {"variant", "transcript", "gene", "seq"}
    assert peptides.with_protein(variants.where("false"), known).collect() == []
    found = peptides.with_protein(variants.where("transcript = 'T1.2'"), known.repartition(2))
    assert [r.seq for r in found.collect()] == ["ACD", "ACD"]
    assert len(exchanges(found)) == 2  # variants and the proteins they were given; all look-ups are done by then


def test_change_fields_build_the_same_proteins(spark):
    columns = "transcript string, gene string, variant_class string, protein_start int, protein_end int, aa_ref string, aa_alt string, downstream string, release int, length_change int, note string"
    changes = [("missense", 2, 2, "C", "W", "WW*", 114, 0), ("missense", 2, None, "C", "W", None, None, None), ("inframe_deletion", 2, 3, "CD", "", "A", 112, 3), ("inframe_insertion", 2, 2, "", "WW", None, 114, 2),
               ("frameshift", 3, 3, "D", "WX", "KLM*AC", 114, 1), ("frameshift", 3, 3, "D", "", "KLMXAC", 112, 9), ("frameshift", 3, None, "", "", "KL", 115, 1), ("frameshift", 2, 2, "C", "A", "*", 114, 0),
               (None, 2, 3, "C", "W", "KLM*", 114, 0), ("frameshift", None, 2, None, None, None, None, None), ("missense", None, 9, "C", None, "K", 114, 0)]
    rows = spark.createDataFrame([(t, "G", *c, "n") for c in [*changes, changes[0]] for t in ("T", "none", None)], columns)
    proteins = spark.createDataFrame([("P", "T", "H", "ACDEFGHIKL")], "protein string, transcript string, symbol string, seq string")
    fields = peptides.change_fields(rows)
    told = ["transcript", "gene", "variant_class", "aa_ref", "aa_alt", "protein_start", "seq", "mutant", "first", "last", "error"]
    whole, narrow = (sorted(map(str, peptides.mutant_proteins(peptides.with_protein(x, proteins)).select(*told).collect())) for x in (rows, fields))
    assert whole == narrow and len(whole) == 36 and any("KLM" in r for r in whole)
    of_others = fields.where("variant_class <> 'frameshift'").select("downstream", "release", "length_change").distinct().collect()
    assert [tuple(r) for r in of_others] == [(None, None, None)]
    assert {r.downstream for r in fields.where("variant_class = 'frameshift'").collect()} == {"KLM", "KL", "", None}
    assert "note" not in fields.columns


def test_names_are_read_once_each(spark, monkeypatch):
    """Reading a name is a Python call that counts itself."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def canonical(name: str, known: dict) -> str:
        calls.add(1)
        return known.get(name, name)

    monkeypatch.setattr(audit, "canonical_allele", canonical)
    aliases = spark.createDataFrame([("B", "Y"), ("B", "X"), (None, "Z")], "alias string, canonical string")
    source = spark.range(2000).selectExpr("id", "element_at(array('A', 'B', '', null), int(id % 5 % 4) + 1) as name")
    found = audit.canonicalised(source, aliases, "name")
    got = {(r.id % 5 % 4, r.canonical) for r in found.collect()}
    assert got == {(0, "A"), (1, "X"), (2, ""), (3, None)} and found.columns == ["id", "name", "canonical"]
    assert found.count() == 2000 and calls.value <= 6


def test_hot_names_are_not_shuffled_by_row(spark):
    from siftline.plans import registry

    keys = F.when(F.col("id") % 5 < 2, F.col("id") * 720 + 1).when(F.col("id") % 5 == 4, F.lit(None)).otherwise(F.col("id"))
    folder = {"part": spark.range(20000).select(keys.alias("p_partkey")), "customer": spark.range(20000).select(keys.alias("c_custkey"))}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    read, registry.read = registry.read, lambda _, __, table: folder[table]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = registry.allele_normalize_join(spark, "")
        got = {r.canonical: (r.payload_a, r.payload_b) for r in found.collect()}
    finally:
        registry.read = read
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got["HLA-A*02:11"][0] == 19996 * 720 + 1 and got["HLA-B*44:11"][1] == 19996 * 720 + 1
    written = [n.metrics().get("shuffleRecordsWritten").get().value() for n in operators(found) if n.nodeName() == "Exchange"]
    assert max(written) <= 721 * 8


def test_reference_windows_are_not_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_PREFIXES", 0)
    wanted = spark.createDataFrame([("ACDEFGHIK",), ("CCCCCCCCC",), ("ACDEFGHI",)], "peptide string")
    found = matching.self_matches(wanted, spark.createDataFrame([("MACDEFGHIKL",)], "seq string"))
    assert sorted(r.peptide for r in found.collect()) == ["ACDEFGHI", "ACDEFGHIK"]
    assert not [n for n in operators(found) if n.nodeName() == "BroadcastExchange"]


def test_prefixes_reach_the_driver_as_numbers(spark):
    codes = matching._collected_codes(spark.createDataFrame([("ACDEFGHI",), ("CCCCCCCC",), ("AC",)], "prefix string"))
    assert {n: len(c) for n, c in codes.items()} == {2: 1, 8: 2} and codes[2].dtype == "int64"


def test_changes_and_isoforms_of_one_symbol_make_no_pairs(spark):
    i = F.col("id")
    changes = spark.range(2000).select(i.alias("change_id"), F.lit("s").alias("symbol"), (1 + i % 3).cast("int").alias("start"), (2 + i % 3).cast("int").alias("end"), F.when(i % 2 == 0, "C").otherwise("").alias("ref"))
    isoforms = spark.range(2000).select(F.lit("s").alias("symbol"), i.alias("transcript"), F.lit("ACDEF").alias("seq"), (i == 7).alias("primary"))
    found = matching.resolve_isoform(changes, isoforms)
    got = {(r.change_id % 6, r.transcript, r.outcome) for r in found.collect()}
    assert got == {(0, None, "no_isoform_fits"), (1, 7, "resolved"), (2, None, "no_isoform_fits"), (3, 7, "resolved"), (4, 7, "resolved"), (5, 7, "resolved")}
    assert most_rows(found) <= 2000 * 6


def test_small_pools_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(permutation, "placed", None)  # no score of a small pool is ranked over ranges
    rows = spark.range(4000).selectExpr("id div 4 as g", "if(id % 4 = 0, double('nan'), id % 4) as score_a", "cast(id % 4 as decimal(9, 2)) as score_b", "cast(id % 4 = 0 as int) as label")
    found = permutation.paired_comparison(rows, ["g"], 2)
    got = {tuple(r)[1:] for r in found.collect()}
    assert got == {(4, 1, 2, 1, 0, 0.5, 1.0, 0.0, 0.25)} and found.count() == 1000
    assert len(exchanges(found)) == 1
    single = permutation.permutation_p(rows.withColumnRenamed("score_a", "score"), ["g"])
    assert {tuple(r)[1:] for r in single.collect()} == {(1.0, 0.25)} and len(exchanges(single)) == 1


def test_many_spans_are_not_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(coding, "MOST_ROWS", 0)
    monkeypatch.setattr(coding, "TASK_ROWS", 10)
    spans = spark.range(100).selectExpr("concat('t', id div 2) as transcript", "'c' as sequence", "id * 10 + 1 as start", "id * 10 + 10 as end", "'+' as strand")
    offsets = coding.span_offsets(spans)
    assert offsets.rdd.getNumPartitions() == 10 and {r.before for r in offsets.collect()} == {0, 10}
    variants = spark.createDataFrame([("v", "c", 25, "A", "C")], "variant_id string, sequence string, pos long, ref string, alt string")
    found = coding.coding_positions(variants, offsets)
    assert [(r.transcript, r.cds_pos) for r in found.collect()] == [("t1", 4)]
    assert not [n for n in operators(found) if n.nodeName() == "BroadcastExchange"]


def test_results_are_recomputed_once(spark, monkeypatch):
    from siftline.plans import registry

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def peptide(_: int) -> str:
        calls.add(1)
        return "A"

    made = spark.range(50).select(F.col("id").cast("string").alias("variant_id"), F.lit("t").alias("transcript"), F.col("id").alias("start_offset"), peptide("id").alias("peptide"))
    monkeypatch.setattr(registry, "coding_changes", lambda *_: made)
    assert sum(r.n for r in registry.drift_verdicts(spark, "").collect()) == 50
    assert calls.value == 50


def test_names_are_compacted_once(spark):
    spelled = names.normalize_panel_allele(F.col("a"))
    assert spelled._jc.toString().count("\\s+") == 1 and names.normalize_peptide(F.col("a"))._jc.toString().count("\\s+") == 1
    rows = spark.createDataFrame([("hla_a02:01",), ("A*02:01\u2028",), ("A*02:01:03",), ("nonsense",), (None,)], "a string")
    assert [r[0] for r in rows.select(spelled).collect()] == ["HLA-A*02:01", "HLA-A*02:01", "HLA-A*02:01", None, None]


def candidates(spark):
    """Twelve peptides of four variants; every third occurs in the reference."""
    letters = F.split(F.lit("ACDEFGHIKLMN"), "")
    peptide = lambda tail: F.concat(F.element_at(letters, (F.col("id") + 1).cast("int")), F.lit(tail))
    null = F.lit(None).cast("double")
    rows = spark.range(12).select(
        F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("variant"), F.lit("T").alias("transcript"), F.when(F.col("id") % 4 == 0, "frameshift").otherwise("missense").alias("variant_class"),
        peptide("KLMNPQRS").alias("peptide"), F.when(F.col("id") % 2 == 0, peptide("KLMWPQRS")).alias("wildtype"), F.lit(3).alias("position"), F.lit("").alias("n_flank"), F.lit("").alias("c_flank"), null.alias("ccf"), null.alias("tpm"), null.alias("normal_tpm"),
    )
    return rows, rows.where("ascii(peptide) % 3 = 0").select(F.concat(F.lit("M"), "peptide").alias("seq"))


def test_best_rows_alone_are_looked_up(spark, monkeypatch):
    alleles, (rows, reference) = ["A", "B"], candidates(spark)
    predictor = lambda p, a: scoring.null_prediction(p, a) | {"affinity_percentile": F.lit(1.0)}
    calls = ranking.predicted(ranking.distinct_peptides(rows), alleles, predictor)
    want = ranking.ranked(ranking.featured(ranking.with_predictions(ranking.self_scanned(rows, None, reference), calls)), 5, 1, 2)
    columns = ["rank", "variant", "peptide", "allele", "score", "wt_affinity_nm", "hydrophobicity", "is_self"]
    want = [tuple(r) for r in want.select(*columns).orderBy("rank").collect()]
    asked = []
    monkeypatch.setattr(matching, "self_matches", lambda p, r, look=matching.self_matches: (asked.append(p.count()), look(p, r))[1])
    made = ranking.called(rows, alleles, predictor)
    for first, most, looked in ((10, 20, None), (1, 0, [12]), (5, 1000, None), (24, 24, [12])):
        asked.clear()
        got = ranking.ranked_unscanned(made, reference, 5, 1, 2, first, most)
        assert [tuple(r) for r in got.select(*columns).orderBy("rank").collect()] == want
        assert looked is None or asked == looked
    assert ranking.ranked_unscanned(made, reference, 1, 1, 2, 2).count() == 1 and asked[-1] <= 2
    assert not exchanges(made)


def test_calls_are_made_once_a_candidate(spark):
    """A call counts itself; filters on its measures may not make it again."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(_: str, __: str) -> float:
        calls.add(1)
        return 1.0

    predictor = lambda p, a: {"presentation_score": score(p, a), "affinity_nm": score(p, a) * 2, "affinity_percentile": score(p, a)}
    rows, _ = candidates(spark)
    made = ranking.called(rows.drop("wildtype").withColumn("wildtype", F.lit(None).cast("string")), ["A", "B", "A"], predictor, ranking.presented())
    assert len(made.collect()) == 24 and calls.value == 24


def test_lists_of_peptides_are_not_shuffled(spark):
    from siftline.plans import registry

    found = registry.mutant_peptides(spark, SF)
    assert len(found.collect()) > 0
    assert not [text for text in exchanges(found) if "found" in text or "least" in text or "mutant" in text]


def test_rows_that_share_an_id_are_found_by_hash(spark, monkeypatch):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,), ("c",)], "variant string")
    shared = peptides.shared_ids(rows, "variant")
    assert shared.count() == 2 and not [text for text in exchanges(shared) if "variant" in text]
    monkeypatch.setattr(peptides, "MOST_IDS", 0)
    alone, together = peptides._parted(rows.withColumn("mutant", F.lit("A")), "variant", shared)
    assert sorted(r.variant for r in alone.collect()) == ["b", "c"] and together.count() == 4
    assert not [n for n in operators(alone) if n.nodeName() == "BroadcastExchange"]


def test_short_references_are_scanned_together(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(matching, "prefix_codes", lambda d, n, make=matching.prefix_codes: (calls.append(len(d)), make(d, n))[1])
    import pyarrow as pa

    joined = list(matching._joined(pa.array(["ACD", None, "", "EF", "G" * matching.PIECE, "H"])))
    assert [len(j) for j in joined] == [8 + matching.PIECE, 1] and bytes(joined[0][:8]) == b"ACD\n\nEF\n"
    # A window ends with its sequence: neither prefix nor rest reaches into the next one.
    wanted = spark.createDataFrame([("ACDEFGHIK",), ("ACDEFGHI",), ("GHIKLMNPQ",)], "peptide string")
    found = matching.self_matches(wanted, spark.createDataFrame([("MACDEFGHI",), ("KLMNPQ",), (None,)], "seq string").coalesce(1))
    assert [r.peptide for r in found.collect()] == ["ACDEFGHI"]


def test_claims_and_sheets_are_shuffled_whole_twice(spark):
    from siftline.plans import registry

    for name, own in (("claim_verdicts", "claim_id"), ("sheet_mutations", "row_id")):
        found = registry.QUERIES[name](spark, SF)
        assert len(found.collect()) > 0
        sent = exchanges(found)
        assert sum(own in text for text in sent) == 2 and sum("l_suppkey" in text for text in sent) == 1
        assert not [n for n in operators(found) if n.nodeName() == "BroadcastExchange"]


def test_isoform_of_a_row(spark):
    asked = [(1, "G", (2, 2, "C")), (2, "G", (2, 6, "CDEFG")), (3, "OLD", (1, 3, "ACD")), (4, "G", (2, 2, "W")), (5, "OLD", (1, 1, "W")), (6, "X", (1, 1, "A")),
             (7, None, (1, 1, "A")), (8, "G", (3, 3, "DE")), (9, "G", (3, 3, "DEFGH")), (1, "G", (2, 2, "C")), (10, "t1", (1, 1, "A"))]
    rows = spark.createDataFrame(asked, "id int, gene string, change struct<start: int, end: int, ref: string>")
    isoforms = spark.createDataFrame([("G", "t2", "ACDE", True), ("G", "t1", "ACDE", True), ("G", "t0", "ACDEFG", False), (None, "t9", "A", True)], "symbol string, transcript string, seq string, primary boolean")
    aliases = spark.createDataFrame([("OLD", "G")], "old string, new string")
    found = matching.with_isoform(rows, isoforms, aliases)
    got = sorted((r.id, r.gene, r.transcript, r.seq) for r in found.collect())
    assert [(i, t, s) for i, _, t, s in got] == [(1, "t1", "ACDE"), (1, "t1", "ACDE"), (2, "t0", "ACDEFG"), (3, "t1", "ACDE"), (4, None, None), (5, None, None), (6, None, None), (7, None, None), (8, "t1", "ACDE"), (9, None, None), (10, None, None)]
    assert {r.id: r.known for r in found.where("transcript is null").collect()} == {4: True, 5: False, 6: False, 7: False, 9: True, 10: False}
