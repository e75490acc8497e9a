"""Operators and sources on fixtures."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blend, entities, lexical, pairs, rank, sampling, scorers, select, validate
from tessera.schema import OWL, RDFS, SKOS, role_rows, roles
from tessera.sources import files, ofn, pools, rdfxml
from tessera.streaming import incremental

OFN = r'''Prefix(:=<http://ex.org/id/>)
Prefix(rdfs:=<http://www.w3.org/2000/01/rdf-schema#>)
Prefix(skos:=<http://www.w3.org/2004/02/skos/core#>)
Prefix(owl:=<http://www.w3.org/2002/07/owl#>)
Ontology(<http://ex.org/o>
# comment
Declaration(Class(:1))
Declaration(Class(:2))
Declaration(Class(:3))
Declaration(ObjectProperty(:9))
Declaration(ObjectProperty(:8))
AnnotationAssertion(rdfs:label :1 "Round thing (artifact)"@en)
AnnotationAssertion(skos:prefLabel :1 "Ring (GB)"@en-gb)
AnnotationAssertion(skos:prefLabel :1 "Ring"@en-us)
AnnotationAssertion(skos:prefLabel :2 "Shape"@en)
AnnotationAssertion(skos:altLabel :1 "Anneau"@fr)
AnnotationAssertion(skos:altLabel :1 "say \"hi\""@en)
AnnotationAssertion(skos:altLabel :7 "orphan"@en)
AnnotationAssertion(owl:deprecated :3 "true"^^xsd:boolean)
SubClassOf(:1 :2)
SubClassOf(:1 ObjectIntersectionOf(:3 ObjectSomeValuesFrom(:9 :2)))
SubClassOf(ObjectSomeValuesFrom(:9 :2) :3)
EquivalentClasses(:2 ObjectIntersectionOf(:3 ObjectSomeValuesFrom(:9 :1)))
SubObjectPropertyOf(:9 :8)
SubObjectPropertyOf(ObjectPropertyChain(:9 :9) :9)
TransitiveObjectProperty(:9)
)
'''
ID = "http://ex.org/id/"
DOID = "http://purl.obolibrary.org/obo/DOID_"
XML = f"""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}" xmlns:oio="http://www.geneontology.org/formats/oboInOwl#" xmlns:obo="http://purl.obolibrary.org/obo/">
<owl:AnnotationProperty rdf:about="http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"><rdfs:label>exact</rdfs:label></owl:AnnotationProperty>
<owl:Class rdf:about="{DOID}1"><rdfs:label>Red fever</rdfs:label><rdfs:label xml:lang="fr">fièvre</rdfs:label>
<oio:hasExactSynonym>red  FEVER</oio:hasExactSynonym><oio:hasExactSynonym>Scarlet fever</oio:hasExactSynonym>
<oio:hasRelatedSynonym>scarlet Fever</oio:hasRelatedSynonym><oio:hasRelatedSynonym>SF</oio:hasRelatedSynonym>
<obo:IAO_0000115>A  fever.</obo:IAO_0000115><oio:hasDbXref>X:1</oio:hasDbXref>
<rdfs:subClassOf rdf:resource="{DOID}2"/>
<owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection"><rdf:Description rdf:about="{DOID}3"/><owl:Restriction/></owl:intersectionOf></owl:Class></owl:equivalentClass>
<rdfs:subClassOf><owl:Class><owl:intersectionOf rdf:parseType="Collection"><rdf:Description rdf:about="{DOID}4"/></owl:intersectionOf></owl:Class></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="{DOID}2"><rdfs:label>Fever</rdfs:label><owl:deprecated>true</owl:deprecated></owl:Class>
<rdf:Description rdf:about="{DOID}3"><rdf:type rdf:resource="{OWL}Class"/><rdfs:label>Infection</rdfs:label></rdf:Description>
<owl:Class rdf:about="{DOID}4"><rdfs:label>Never</rdfs:label></owl:Class>
<rdf:Description rdf:nodeID="l1"><rdf:first rdf:resource="{DOID}3"/><rdf:rest rdf:nodeID="l2"/></rdf:Description>
<rdf:Description rdf:nodeID="l2"><rdf:first rdf:resource="{DOID}4"/></rdf:Description>
</rdf:RDF>"""


def test_ofn_axioms_and_counters(spark, tmp_path):
    path = tmp_path / "a.ofn"
    path.write_text(OFN)
    assert ofn.is_ofn(spark, str(path))
    axioms, stats = ofn.parse_ofn(spark, str(path))
    counted = {k: v for k, v in stats.first().asDict().items() if v}
    assert counted == {"lines": 27, "declared_classes": 3, "declared_ObjectProperty": 2, "annotation_assertions": 8, "annotations_on_undeclared": 1, "subclass_named": 1, "subclass_intersection": 1, "gci_skipped": 1, "equivalent_intersection": 1, "subproperty_named": 1, "subproperty_chain_skipped": 1, "other_axioms_skipped": 1}
    above = {}
    for r in axioms.where("kind = 'parent'").orderBy("ord").collect():
        above.setdefault(r.iri.removeprefix(ID), []).append(r.obj.removeprefix(ID))
    assert above == {"1": ["2", "3"], "2": ["3"], "9": ["8"]}
    needed = spark.createDataFrame([(ID + k,) for k in "123"], "iri string")
    got = {r.iri.removeprefix(ID): r for r in entities.build_entities(entities.canonical_names(axioms), roles(spark, "SNOMED"), needed).collect()}
    assert got["1"].label == "Ring" and got["1"].synonyms == ["Ring (GB)", "Round thing", 'say "hi"'] and got["1"].semantic_tag == "artifact"
    assert got["1"].parents == ["Shape"] and got["1"].children == [] and got["2"].children == ["Ring"]
    assert got["3"].deprecated and got["3"].label_is_fallback and got["3"].found


@pytest.mark.parametrize("line", ["Declaration(Class(zz:1))", "AnnotationAssertion(rdfs:seeAlso :1 <http://ex.org/x>)", "SubObjectPropertyOf(:77 :8)"])
def test_ofn_errors(spark, tmp_path, line):
    path = tmp_path / "b.ofn"
    path.write_text(OFN.rstrip(")\n") + ")\n" + line + "\n)\n")
    with pytest.raises(Exception):  # noqa: B017
        axioms, stats = ofn.parse_ofn(spark, str(path))
        axioms.collect()
        stats.collect()


def test_rdfxml_entities(spark, tmp_path):
    path = tmp_path / "a.owl"
    path.write_text(XML, encoding="utf-8")
    axioms = rdfxml.read_rdfxml(spark, str(path))
    needed = spark.createDataFrame([(DOID + "1",), (DOID + "2",), (DOID + "99",)], "iri string")
    got = {r.iri.removeprefix(DOID): r for r in entities.build_entities(axioms, roles(spark, "DOID"), needed).collect()}
    one = got["1"]
    assert (one.label, one.synonyms, one.related_synonyms, one.definition, one.parents) == ("Red fever", ["Scarlet fever"], ["SF"], "A fever.", ["Fever", "Infection"])
    assert got["2"].deprecated and got["2"].children == ["Red fever"]
    assert not got["99"].found and got["99"].label == "DOID 99" and got["99"].parents == []
    share = entities.coverage(entities.build_entities(axioms, roles(spark, "DOID"), needed)).first()
    assert (share.entities, share.found_in_ontology_pct, share.deprecated_pct) == (3, 66.67, 33.33)
    walked = rdfxml.read_rdfxml(spark, str(path), triples=True)
    cells = walked.where("iri like '\\_:%'").groupBy(F.col("iri").alias("cell")).agg(F.max(F.when(F.col("prop").endswith("first"), F.col("obj"))).alias("member"), F.max(F.when(F.col("prop").endswith("rest"), F.col("obj"))).alias("rest"))
    assert [(r.head, r["at"], r.member.removeprefix(DOID)) for r in validate.walk_lists(cells).orderBy("at").collect()] == [("_:l1", 0, "3"), ("_:l1", 1, "4")]
    kept = entities.retained(axioms, spark.createDataFrame([(DOID + "2",)], "iri string"), [RDFS + "label"])
    assert kept.where("kind = 'annotation'").count() == 5


def test_roles():
    assert [p for r, _, p in role_rows("NCIT") if r == "label"][:2] == [RDFS + "label", SKOS + "prefLabel"]
    assert not any(r == "related" for r, _, _ in role_rows("SNOMED"))


def test_pool_files(spark, tmp_path):
    path = tmp_path / "local.train.cands.tsv"
    path.write_text("SrcEntity\tTgtEntity\tTgtCandidates\nhttp://s/1\thttp://t/2\t\"['http://t/1', 'http://t/2']\"\nhttp://s/2\t\t\"['http://ex.org/a', \"\"http://ex.org/it's\"\"]\"\n")
    pool = pools.read_pool(spark, str(path))
    assert [tuple(r) for r in pool.orderBy("query_idx").collect()] == [(0, "http://s/1", "http://t/2", ["http://t/1", "http://t/2"]), (1, "http://s/2", None, ["http://ex.org/a", "http://ex.org/it's"])]
    pools.write_pool(pool, str(tmp_path / "out"))
    assert pools.read_pool(spark, str(tmp_path / "out")).count() == 2
    bare = tmp_path / "bare.tsv"
    bare.write_text("SrcEntity\tTgtCandidates\na\t['x']\n")
    assert [tuple(r) for r in pools.read_pool(spark, str(bare)).collect()] == [(0, "a", None, ["x"])]
    assert pools.pool_path("/r", "/i", "P", "train-dev") == "/i/P/local.train-dev.cands.tsv"
    scores = tmp_path / "s.tsv"
    scores.write_text("query_idx\tsrc\tcand\tcand_pos\tscore\n0\ta\tx\t0\t0.1\n0\ta\tx\t0\t0.7\n")
    assert pools.read_scores(spark, str(scores), "query_idx bigint, src string, cand string, cand_pos int, score double").first().score == 0.7


MARGINS, LEXICAL = [[2, 0, -1, 2], [1, 1, 1, 1]], [[0.25, 1, 0.25, 0], [0.5, 0.75, 0.5, 0]]


def _two_queries(spark):
    rows = [(q, f"s{q}", f"c{q}{p}", p, float(MARGINS[q][p]), float(LEXICAL[q][p]), f"c{q}1") for q in (0, 1) for p in range(4)]
    return spark.createDataFrame(rows, "query_idx bigint, src string, cand string, cand_pos int, margin double, lex double, gold string")


@pytest.mark.parametrize("mode,alpha,first,second", [("minmax", 0.0, "1023", "1023"), ("minmax", 0.5, "1032", "1023"), ("minmax", 1.0, "0312", "0123"), ("prob", 0.5, "1032", "1023"), ("prob", 1.0, "0312", "0123")])
def test_blend_orders(spark, mode, alpha, first, second):
    got = {r.query_idx: "".join(c[2] for c in r.ranked) for r in rank.ranking(blend.apply(_two_queries(spark), mode, alpha)).collect()}
    assert got == {0: first, 1: second}


def test_blend_grid_ties(spark):
    best = blend.choose(blend.grid(spark, _two_queries(spark))).first()
    assert (best["mode"], best.alpha, best.mrr) == ("minmax", 0.0, 1.0)
    with pytest.raises(Exception, match="no gold"):
        blend.choose(spark.createDataFrame([("minmax", 0.0, 0.0, 0)], "mode string, alpha double, mrr double, queries bigint")).collect()


def test_blend_grid_ranks_pairs_once(spark):
    rng = np.random.default_rng(7)
    rows = [(q, f"c{p % 5}" if q % 4 == 1 else f"c{p}", p, float(rng.integers(-2, 3)), None if q == 2 and p < 3 else float(rng.integers(0, 3)) / 2, None if q == 3 else "c9" if q == 5 else "c1") for q in range(40) for p in range(8)]
    s = spark.createDataFrame(rows, "query_idx bigint, cand string, cand_pos int, margin double, lex double, gold string")
    grid = blend.grid(spark, s)
    got = {(r["mode"], r.alpha): r[2:] for r in grid.collect()}
    for mode, alpha in (("minmax", 0.0), ("minmax", 0.3), ("prob", 0.5), ("prob", 1.0)):
        assert got[mode, alpha] == tuple(rank.metrics(rank.gold_ranks(blend.apply(s, mode, alpha))).first())
    assert len(got) == 22 and grid.schema["alpha"].dataType.simpleString() == "double"
    plan = grid._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert sorts and all("Sort [query_idx" in line and "," not in line.split("], false")[0] for line in sorts), sorts
    with pytest.raises(Exception, match="not a number"):
        blend.grid(spark, s.withColumn("lex", F.lit(float("nan")))).collect()


def test_metrics(spark):
    ranks = spark.createDataFrame([(k, r) for k, r in enumerate([1, 2, 3, 7, 100, 1, 1, 13])], "query_idx int, gold_rank int")
    m = rank.metrics(ranks).first()
    assert (m.mrr, m.hits_at_1, m.hits_at_5, m.hits_at_10, m.queries) == (0.507889, 0.375, 0.625, 0.75, 8)
    none = rank.metrics(ranks.limit(0)).first()
    assert (none.mrr, none.hits_at_10, none.queries) == (0.0, 0.0, 0)
    absent = spark.createDataFrame([(0, None), (1, 1)], "query_idx int, gold_rank int")
    assert rank.metrics(absent).first().mrr == 0.5


def test_nan_and_permutations_are_refused(spark):
    bad = _two_queries(spark).withColumn("lex", F.lit(float("nan")))
    with pytest.raises(Exception, match="not a number"):
        rank.ranked(bad, "lex").collect()
    pool = spark.createDataFrame([(0, "s", ["a", "b"])], "query_idx bigint, src string, cands array<string>")
    fine = spark.createDataFrame([(0, ["b", "a"])], "query_idx bigint, ranked array<string>")
    assert rank.checked_ranking(fine, pool).count() == 1
    for ranked in (["a", "a"], ["a"]):
        with pytest.raises(Exception, match="no permutation"):
            rank.checked_ranking(spark.createDataFrame([(0, ranked)], "query_idx bigint, ranked array<string>"), pool).collect()


def test_submission_problems(spark):
    good = [f"http://t/{k}" for k in range(3)]
    pool = spark.createDataFrame([(k, f"s{k}", good) for k in range(7)], "query_idx bigint, src string, cands array<string>")
    rows = [(0, 2, "s0", good), (1, 3, "s1", good), (2, 2, "s0", good), (3, 2, "s3", None), (4, 2, "s4", [good[0], good[0], good[1]]), (5, 2, "s5", [*good[:2], "x"])]
    got = [(r.query_idx, r.problem) for r in rank.submission_problems(spark.createDataFrame(rows, "query_idx bigint, cells int, src string, ranked array<string>"), pool, 3).collect()]
    assert [(q, p.split()[0]) for q, p in got] == [(1, "wrong"), (2, "source"), (3, "not"), (4, "wrong"), (4, "not"), (5, "not"), (5, "a"), (6, "row")]


def test_pair_joins(spark):
    pool = spark.createDataFrame([(0, "s", "a", ["a", "b"])], "query_idx bigint, src string, gold string, cands array<string>")
    rows = pairs.explode_pool(pool)
    e = spark.createDataFrame([("s", "S"), ("a", "A"), ("b", "B")], "iri string, label string")
    assert pairs.with_entities(rows, e, e).count() == 2
    with pytest.raises(Exception, match="no entity"):
        pairs.with_entities(rows, e, e.where("iri <> 'b'")).collect()
    stored = spark.createDataFrame([(0, "s", "a", 0, 0.5), (0, "s", "b", 1, 0.25)], "query_idx bigint, src string, cand string, cand_pos int, x double")
    assert pairs.checked_scores(rows, stored, "x").count() == 2
    with pytest.raises(Exception, match="no score"):
        pairs.checked_scores(rows, stored.where("cand_pos = 0"), "x").collect()
    with pytest.raises(Exception, match="another entity"):
        pairs.checked_scores(rows, stored.withColumn("cand", F.lit("a")), "x").collect()


def test_exact_sampling():
    assert sampling.exact_dev_sources([f"s{k:02d}" for k in range(10)]) == {"s07"}
    assert [sampling.dev_size(n, 0.1) for n in (3, 5, 15, 25, 35)] == [1, 1, 2, 2, 4]
    assert sampling.exact_fit_sample([k for k in range(10) if k != 7], 4) == [0, 2, 6, 9]
    rest = list(range(3, 12))
    assert [sampling.exact_negatives(rest, q, 2) for q in (0, 1, 5)] == [[9, 11], [5, 4], [7, 8]]
    assert sampling.exact_negatives(rest, 2, 2, seed=1) == [7, 3]
    assert len(sampling.exact_holdout(50)) == 5


def test_training_pairs(spark):
    rows = [(q, f"s{q % 2}", f"c{p}", p, p / 20, f"c{q}") for q in range(4) for p in range(20)]
    scored = spark.createDataFrame(rows, "query_idx bigint, src string, cand string, cand_pos int, lex double, gold string")
    for exact in (False, True):
        made = sampling.training_pairs(scored, 5, exact=exact)
        counts = {(r.query_idx, r.kind): r["count"] for r in made.groupBy("query_idx", "kind").count().collect()}
        assert counts == {(q, k): n for q in range(4) for k, n in (("positive", 1), ("hard", 3), ("random", 2))}
        golds = {f"s{q % 2}": {f"c{x}" for x in range(q % 2, 4, 2)} for q in range(2)}
        assert all(r.cand not in golds[r.src] for r in made.where("label = 0").collect())
        assert {r.cand for r in made.where("kind = 'hard'").collect()} == {"c19", "c18", "c17"}
    assert made.select(sampling.gold_block(F.col("label"))).first()[0].probabilities in ([1.0, 0.0], [0.0, 1.0])


def test_seed_selection(spark):
    rows = [("p", 0, 4, 4, 0.9), ("p", 1, 4, 4, 0.95), ("p", 2, 4, 4, 0.95), ("p", 3, 2, 4, 0.99), ("p", 4, None, 4, None)]
    got = select.select_seed(spark.createDataFrame(rows, "pair string, seed int, epochs_done int, epochs_planned int, dev_mrr double")).first()
    assert (got.selected_seed, got.completed_seeds) == (1, [0, 1, 2]) and [x.seed for x in got.excluded] == [3, 4]
    with pytest.raises(Exception, match="no seed"):
        select.select_seed(spark.createDataFrame(rows[3:], "pair string, seed int, epochs_done int, epochs_planned int, dev_mrr double")).collect()
    steps = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 4.0)], "epoch int, loss double")
    assert select.mean_loss(steps).first()[:] == (1, 3.0, 1)


def test_bootstrap_interval(spark):
    ranks = spark.createDataFrame([(k, 2, 1) for k in range(40)] + [(k, 1, 1) for k in range(40, 60)] + [(99, None, 2)], "query_idx int, lex_rank int, blend_rank int")
    low, high = select.paired_bootstrap(ranks, 300).first()
    assert low == pytest.approx(0.5) and high == pytest.approx(0.5)


def test_scorers(spark):
    states = spark.createDataFrame([(0, "s", f"c{p}", p, "red fever", t, p) for p, t in enumerate(["red fever", "blue fever", "cold"])], "query_idx bigint, src string, cand string, cand_pos int, source_text string, target_text string, n_tokens int")
    got = scorers.score_pairs(states, lambda: scorers.token_overlap_scorer(), batch=2, most_tokens=1).orderBy("cand_pos").collect()
    assert [r.choice for r in got] == [0, 0, 1] and [r.truncated for r in got] == [0, 0, 1] and got[0].margin == 3.0
    scored = spark.createDataFrame([(r.query_idx, r.cand_pos, r.prob, r.margin) for r in got], "query_idx bigint, cand_pos int, prob double, margin double")
    assert validate.probability_gap(scored).first()[0] < 1e-12
    whole = spark.createDataFrame([(0, "s", "x", [("a", 0, "x"), ("b", 1, "y")])], "query_idx bigint, src string, source_text string, options array<struct<cand string, cand_pos int, text string>>")
    many = scorers.score_pools(whole, lambda: lambda s, options: np.array([float(o == s) for o in options]))
    assert sum(r.prob for r in many.collect()) == pytest.approx(1)
    assert scorers.fit_temperature(np.array([4.0, -4.0, 4.0]), np.array([1, 0, 0])) > 1
    assert [r["max_margin_drift_vs_first"] for r in scorers.batch_sweep(spark, states, lambda: scorers.token_overlap_scorer(), (1, 2))] == [0.0, 0.0]
    train = spark.createDataFrame([(0.9, 1.0), (0.8, 1.0), (0.1, 0.0), (0.2, 0.0)], "j double, label double")
    assert [r.prediction for r in scorers.fit_logistic(train, ["j"]).transform(train).collect()] == [1, 1, 0, 0]


def test_differences(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    assert {r.k: (r.n_a, r.n_b) for r in validate.multiset_diff(a, b, "k").collect()} == {"x": (2, 1), "z": (0, 1), None: (1, 0)}
    assert validate.set_counts(a, b).first()[:] == (4, 2, 1, 1, 2)
    e = spark.createDataFrame([("1", "l", ["a", "b"], "d", [])], "iri string, label string, synonyms array<string>, definition string, parents array<string>")
    assert validate.loader_mismatches(e, e.withColumn("label", F.lit("m")).withColumn("synonyms", F.reverse("synonyms"))).first()[:] == (1, 1, 0, 0, 0)


def test_resumable_scoring(spark, tmp_path):
    pool = spark.createDataFrame([(q, "s", None, ["a", "b"]) for q in range(10)], "query_idx bigint, src string, gold string, cands array<string>")
    calls = []

    def score(frame):
        calls.append(frame.count())
        return pairs.explode_pool(frame).withColumn("score", F.lit(1.0))

    out = str(tmp_path / "scores")
    assert incremental.score_resumably(spark, pool.where("query_idx < 5"), score, out, 4).count() == 10
    assert incremental.score_resumably(spark, pool, score, out, 4).count() == 20
    assert calls == [5, 6]  # the first chunk was whole; the second had one query of four
    assert incremental.score_resumably(spark, pool, score, out, 4).count() == 20 and calls[-1] == 0
    rows = spark.range(9).select(F.col("id").alias("ord"))
    assert incremental.complete_blocks(rows, 4).first()[:] == (2, 8)


def test_a_chunk_is_one_file(spark, tmp_path):
    pool = spark.createDataFrame([(q, "s", None, ["a", "b"]) for q in range(64)], "query_idx bigint, src string, gold string, cands array<string>").repartition(8, "query_idx")
    incremental.score_resumably(spark, pool, lambda f: pairs.explode_pool(f).withColumn("score", F.lit(1.0)), str(tmp_path / "out"), 16)
    assert [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "out").glob("chunk_id=*"))] == [1, 1, 1, 1]


def test_vectors_are_not_sorted_by_pair(spark):
    from tessera.plans import adapters

    plan = adapters.vector_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("RepartitionByExpression [query_idx") < plan.index("Generate posexplode")


@pytest.mark.parametrize("name", ["score_file", "api_tie_count", "macro_mean", "best_blend", "blend_grid", "blend_rank", "minmax_scores", "prob_scores", "chunk_throughput", "dev_metrics"])
def test_no_vector_is_dealt_with_a_pair(spark, monkeypatch, name):
    from tessera.plans import catalogue

    frames = []
    monkeypatch.setattr(pools, "write_scores", lambda s, *_: frames.append(s))
    monkeypatch.setattr(pools, "read_scores", lambda *_: frames[0].orderBy("query_idx", "cand_pos"))
    dealt = 0

    def tables(node) -> int:
        nonlocal dealt
        below = [node.children().apply(k) for k in range(node.children().size())]
        n = sum(map(tables, below)) or 1
        # queries and candidates are two readings each, one of them for the count
        if n > 2 and node.nodeName() in ("Window", "Sort", "Aggregate", "RepartitionByExpression"):
            dealt += 1
            assert "float" not in below[0].schema().json(), node.nodeName()
        return n

    tables(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    assert dealt


def test_read_scores_are_dealt_once(spark, tmp_path):
    head = "query_idx\tsrc\tcand\tcand_pos\tscore"
    for k, lines in enumerate((["1\ts\ta\t0\t0.5", "1\ts\tb\t1\t0.25", "2\ts\ta\t\t0.1"], ["1\ts\tc\t0\t", "2\ts\tb\t\t0.2", "3\ts\ta\t0\t0.3"])):
        (tmp_path / f"part-{k}.csv").write_text("\n".join([head, *lines]) + "\n")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over files of any size
    try:
        got = pools.read_scores(spark, str(tmp_path), "query_idx bigint, src string, cand string, cand_pos int, score double")
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((tuple(r) for r in got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got.columns == head.split("\t")
    assert rows == [(1, "s", "b", 1, 0.25), (1, "s", "c", 0, None), (2, "s", "b", None, 0.2), (3, "s", "a", 0, 0.3)]
    lines = plan.split("BroadcastExchange")[0]
    assert "SortMergeJoin" not in plan and lines.count("Exchange") == 1 and lines.index("SortAggregate") < lines.index("Exchange")
    assert "Aggregate" not in lines[lines.index("Exchange") :]


def _moves(frame) -> str:
    """The plan of ``frame`` without what is broadcast: a row for each block of a file."""
    return frame._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_lines_of_keys_that_do_not_repeat_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("query_idx\tcand_pos\tscore\n" + "".join(f"{q}\t{p}\t0.5\n" for q in range(3) for p in range(128)))
    (tmp_path / "b.csv").write_text("query_idx\tcand_pos\tscore\n4\t127\t0.5\n4\t0\t0.5\n")
    got = pools.read_scores(spark, str(tmp_path), "query_idx bigint, cand_pos int, score double")
    assert sorted(r[:2] for r in got.collect()) == [(q, p) for q in range(3) for p in range(128)] + [(4, 0), (4, 127)]
    assert "Exchange" not in _moves(got)


@pytest.mark.parametrize("again", ["1\t127\t0.2", "1\t128\t0.2", "1\t-1\t0.2", "1\t\t0.2"])
def test_lines_of_repeated_keys_are_dealt_in_parts_that_grow(spark, monkeypatch, tmp_path, again):
    monkeypatch.setattr(pools, "PART_LINES", 10)
    key = tuple(int(x) if x else None for x in again.split("\t")[:2])
    for k, first in ((0, 0), (1, 64)):
        lines = [f"1\t{p}\t0.1" for p in range(first, first + 64)] + [again.replace("0.2", "0.1") if k == 0 else again]
        (tmp_path / f"{k}.csv").write_text("\n".join(["query_idx\tcand_pos\tscore", *lines]) + "\n")
    got = pools.read_scores(spark, str(tmp_path), "query_idx bigint, cand_pos int, score double")
    rows = {(r.query_idx, r.cand_pos): r.score for r in got.collect()}
    assert got.count() == len(rows) == 128 + (key not in {(1, p) for p in range(128)})
    assert rows[key] == 0.2
    assert "cand_pos#" in (plan := _moves(got)) and ", 13), REPARTITION_BY_NUM" in plan


def test_score_file_is_in_order_in_parts_that_grow(spark, monkeypatch, tmp_path):
    from tessera.plans import adapters, catalogue

    monkeypatch.setattr(adapters, "VECTOR_PART_QUERIES", 50)
    monkeypatch.setattr(catalogue, "scratch_path", lambda *_: str(tmp_path / "scores"))
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    # ids as far apart as ids can be, two at once, one missing
    far = e.withColumn("vec_id", F.when(F.col("vec_id") < 100, F.col("vec_id") - 4).when(F.col("vec_id") == 499, F.lit(None)).when(F.col("vec_id") == 498, 490).otherwise((1 << 62) + F.col("vec_id")))
    for name, frame in (("plain", e), ("odd", far)):
        frame.write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = catalogue.score_file(spark, str(tmp_path / name))
        want = {(r.query_idx, r.cand_pos): r.margin for r in adapters.vector_scores(spark, str(tmp_path / name)).collect()}
        found = [(r.query_idx, r.cand_pos) for r in got.collect()]
        assert len(set(found)) == len(found) == len(want) > 30000 and set(found) == set(want)
        files = sorted((tmp_path / "scores").glob("part-*"))
        lines = [[(int(x[0]), int(x[3])) for x in map(lambda line: line.split("\t"), f.read_text().splitlines()[1:])] for f in files]
        assert len(files) == 10 and max(map(len, lines)) < 7500
        assert (flat := [x for part in lines for x in part]) == sorted(flat)
        if name == "plain":
            assert "Exchange" not in _moves(got) and all(r.margin == want[r.query_idx, r.cand_pos] for r in got.collect())


@pytest.mark.parametrize("name", ["api_tie_count", "macro_mean", "blend_rank", "minmax_scores", "prob_scores", "chunk_throughput", "dev_metrics"])
def test_pools_are_made_once_in_parts_that_grow(spark, monkeypatch, name):
    from tessera.plans import adapters, catalogue

    monkeypatch.setattr(adapters, "VECTOR_PART_QUERIES", 20)
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(bucket#\d+L, (\d+)\)", plan) == ["25", "25"]
    assert plan.count("sort_array(") == 1


def test_streamed_scoring(spark, tmp_path):
    spark.createDataFrame([(0, "s", None, ["a", "b"])], "query_idx bigint, src string, gold string, cands array<string>").write.parquet(str(tmp_path / "in"))
    done = incremental.stream_scores(spark, str(tmp_path / "in"), lambda f: pairs.explode_pool(f).withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_run_files(spark, tmp_path):
    for k in (1, 2):
        files.dump_json(str(tmp_path / f"r{k}" / "eval.json"), {"pair": "p", "split": "s", "method": f"m{k}"})
    assert files.read_json(spark, f"{tmp_path}/*/eval.json").select("run_dir").distinct().count() == 2
    assert json.loads((tmp_path / "r1" / "eval.json").read_text())["pair"] == "p"
    assert len(files.file_digests(spark, f"{tmp_path}/r1/*.json").first().sha256) == 64
    manifest = files.package({"a.json": str(tmp_path / "r1" / "eval.json")}, str(tmp_path / "sub.zip"), ["q"])
    assert not manifest["complete"] and (tmp_path / "sub-PARTIAL.zip").exists()
    assert files.ontology_path(str(tmp_path), "NCIT") is None
    e = spark.createDataFrame([("i", "l")], "iri string, label string")
    files.write_entities(e, "A", str(tmp_path / "e"))
    files.write_entities(e, "B", str(tmp_path / "e"))
    assert files.read_entities(spark, str(tmp_path / "e"), "A").count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_entities(spark, str(tmp_path / "e"), "C")


def test_every_part_is_a_query(spark):
    from tessera.plans import catalogue

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    got = catalogue.QUERIES["lex_full_part"](spark, "/root/testdata/sf0.001").select("query_idx", "cand")
    assert parts < 500 and got.count() == parts * (parts - 1)  # one bucket
    assert got.select("query_idx").distinct().count() == parts


def test_groups_of_any_size_are_shared_out(spark):
    from tessera.plans import catalogue

    rows = [(k, "g", 1, [f"part {k % 7}", "x"], [["part", str(k % 7)], ["x"]]) for k in range(40)] + [(99, "h", 1, ["y"], [["y"]]), (98, None, 1, ["y"], [["y"]]), (None, "h", 1, ["y"], [["y"]]), (5, "g", 1, ["z"], [["z"]])]
    frame = spark.createDataFrame(rows, "id long, g string, n int, names array<string>, sets array<array<string>>")
    got = lexical.group_features(frame, "id", "g", "n", block=8)
    held = got.withColumn("task", F.spark_partition_id()).collect()
    keys = [*range(40), 5]
    assert sorted((r.query_idx, r.cand) for r in held) == sorted((a, b) for a in keys for b in keys if a != b)
    assert len({r.task for r in held}) > 4  # one group, several tasks
    whole = lexical.group_features(frame, "id", "g", "n", block=1000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))
    found = catalogue.QUERIES["lex_full_score"](spark, "/root/testdata/sf0.001")
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_lists_of_any_length_rings_and_shared_tails(spark):
    cells = [(f"a{k}", str(k), f"a{k + 1}" if k < 3000 else None) for k in range(3001)]
    cells += [("r1", "x", "r2"), ("r2", "y", "r1"), ("s1", "p", "t"), ("s2", "q", "t"), ("t", "z", None), ("alone", "w", "gone"), ("n", None, None)]
    got = {}
    for r in validate.walk_lists(spark.createDataFrame(cells, "cell string, member string, rest string")).collect():
        got.setdefault(r.head, []).append((r["at"], r.member))
    assert sorted(got) == ["a0", "alone", "s1", "s2"]
    assert sorted(got["a0"]) == [(k, str(k)) for k in range(3001)]
    assert sorted(got["s1"]) == [(0, "p"), (1, "z")] and sorted(got["s2"]) == [(0, "q"), (1, "z")] and got["alone"] == [(0, "w")]
    short = validate.walk_lists(spark.createDataFrame(cells[:50], "cell string, member string, rest string"), most=10)
    assert sorted(r["at"] for r in short.where("head = 'a0'").collect()) == list(range(10))


def test_bootstrap_draws_queries_with_replacement(spark):
    rows = [(k, 2 + k % 5, 1 + k % 3) for k in range(60)] + [(100 + k, 1, 5) for k in range(9)] + [(200, None, 1)]
    got = select.paired_bootstrap(spark.createDataFrame(rows, "query_idx long, lex_rank int, blend_rank int")).first()
    gains = np.array([1 / b - (1 / a if a else 0) for _, a, b in rows if a != 1])
    drawn = np.random.default_rng(5).choice(gains, (10_000, len(gains))).mean(1)
    assert np.allclose([got.low, got.high], np.percentile(drawn, [2.5, 97.5]), atol=0.01)
    none = select.paired_bootstrap(spark.createDataFrame([(1, 1, 1)], "query_idx long, lex_rank int, blend_rank int")).first()
    assert none.low is None and none.high is None


def test_seed_names_and_summary(spark):
    assert select.seed_names("NCIT-DOID", 0)["checkpoint"] == "checkpoints/ncit-doid/learned-neg5-repD/best"
    assert select.seed_names("NCIT-DOID", 2)["run"] == "learned-neg5-repD-seed2"
    rows = [("p", 0, 4, 4, 0.5, 0.6), ("p", 1, 4, 4, 0.7, 0.8), ("p", 2, 1, 4, 0.9, 0.9)]
    got = select.seed_summary(spark.createDataFrame(rows, "pair string, seed int, epochs_done int, epochs_planned int, alone double, blended double"), "alone", "blended").first()
    assert got.seeds == 2 and json.loads(got.per_seed) == {"0": {"alone": 0.5, "blended": 0.6}, "1": {"alone": 0.7, "blended": 0.8}}


def test_question_statistics_and_fastest(spark):
    rows = [(10, 100, True), (20, 200, False), (30, 600, True)]
    got = validate.question_statistics(spark.createDataFrame(rows, "head_tokens int, input_tokens int, collapsed boolean")).first()
    assert tuple(got) == (20.0, 30, 300.0, 600, 2)
    sweep = spark.createDataFrame([(8, 100.0, 0), (16, 300.0, 1), (32, 200.0, 0), (64, 200.0, 0)], "batch_size int, pairs_per_sec double, fallbacks int")
    assert validate.fastest(sweep).first().batch_size == 32


def test_pool_statistics(spark):
    rows = [("a", 0, "s1", None, ["x", "y"]), ("a", 1, "s2", None, ["x"]), ("b", 2, "s1", None, ["z", "y"])]
    pool = spark.createDataFrame(rows, "split string, query_idx long, src string, gold string, cands array<string>")
    assert sorted(map(tuple, pairs.pool_sizes(pool).collect())) == [(1, 1), (2, 2)]
    assert sorted(map(tuple, pairs.distinct_targets(pool, "split").collect())) == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in pairs.source_overlaps(pool).collect()] == [("a", "b", 1)]
    assert [r.iri for r in pairs.ordered_entities(pool, False).collect()] == ["x", "y", "z"]
    assert [r.query_idx for r in pairs.first_queries(pool, 2).collect()] == [0, 1]


def test_line_numbers_of_several_files(spark, tmp_path):
    for name, lines in (("a", 3), ("b", 2)):
        (tmp_path / name).write_text("".join(f"{name}{k}\n" for k in range(lines)))
    got = pools.with_line_numbers(spark.read.text(str(tmp_path)).select("value", "_metadata"))
    assert [r.value for r in got.orderBy("ord").collect()] == ["a0", "a1", "a2", "b0", "b1"] and sorted(r.ord for r in got.collect()) == list(range(5))


def test_resume_by_header_and_cells(spark):
    lines = [(0, "q\tp\ts")] + [(k, f"{k}\t0\t1") for k in range(1, 10)] + [(10, "torn\t")]
    count = lambda rows, columns: tuple(incremental.resumable(spark.createDataFrame(rows, "ord long, value string"), columns, 4).first())
    assert count(lines, ["q", "p", "s"]) == (2, 8) and count(lines, ["q", "p", "other"]) == (0, 0) and count([], ["q"]) == (0, 0)


def test_licensed_files_and_submission(tmp_path):
    (tmp_path / "MySnoMed_x.owl").write_text("")
    assert files.ontology_path(None, "SNOMED", private=str(tmp_path)) == str(tmp_path / "MySnoMed_x.owl")
    assert files.ontology_path(None, "SNOMED", named=str(tmp_path / "none.owl"), private=str(tmp_path)) is None
    folder, ranking = tmp_path / "sub", tmp_path / "r.tsv"
    folder.mkdir()
    (folder / "old.tsv").write_text("old")
    ranking.write_text("x")
    with pytest.raises(ValueError):
        files.submit(str(folder), {"a.tsv": str(ranking)}, {"a.tsv": ["bad"]})
    assert (folder / "old.tsv").exists()
    assert list(files.submit(str(folder), {"a.tsv": str(ranking)}, {"a.tsv": []})) == ["a.tsv"]
    assert sorted(p.name for p in folder.iterdir()) == ["a.tsv"]


def test_raw_subset_keeps_lines_as_they_stand(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("SrcEntity\tTgtEntity\tTgtCandidates\na\tb\t\"['b',   'c']\"\nd\te\t['e']\n")
    got = sampling.raw_subset(spark, str(path), spark.createDataFrame([(0,)], "query_idx long"))
    assert [r.value for r in got.collect()] == path.read_text().split("\n")[:2]
    cases = spark.createDataFrame([(1, 5), (0, 9), (0, 2)], "label int, state_tokens int")
    assert tuple(sampling.case_counts(cases).first()) == (1, 2, 9)


def test_verification_report(spark):
    schema = "iri string, ord bigint, kind string, prop string, value string, lang string, obj string"
    rows = [("a", 1, "declaration", None, "Class", None, None), ("b", 1, "declaration", None, "Class", None, None), ("a", 2, "annotation", "p", "x", "en", None), ("a", 3, "annotation", "p", "x", "en", None), ("a", 4, "parent", None, None, None, "b")]
    task = spark.createDataFrame([("a",), ("b",), ("c",)], "iri string")
    one = spark.createDataFrame(rows, schema)
    same = validate.verification_report(one, one, task.where("iri <> 'c'")).first()
    assert same.all_checks_pass and same.task_entities == 2 and same.without_parent == ["b"]
    other = spark.createDataFrame([*rows[:1], rows[2], ("a", 9, "parent", None, None, None, "z"), ("b", 1, "declaration", None, "ObjectProperty", None, None)], schema)
    got = validate.verification_report(one, other, task).first()
    assert not got.all_checks_pass and (got.n_not_declared_a, got.n_not_declared_b, got.not_declared_a) == (1, 1, ["c"])
    assert (got.annotation_mismatches, got.parent_mismatches, got.type_mismatches) == (["a"], ["a"], ["b"])
    notes = spark.createDataFrame([("a", 1, "annotation", "p", " x \n y ", "en-GB", None), ("a", 2, "annotation", "p", "z", "fr", None), ("a", 3, "annotation", "p", " ", None, None)], schema)
    assert [r.value for r in validate.english_literals(notes).collect()] == ["x y"]


def test_evaluation_of_a_run(spark):
    pool = spark.createDataFrame([(0, "s", "b", ["a", "b"]), (1, "t", "z", ["a", "b"])], "query_idx long, src string, gold string, cands array<string>")
    ranked = spark.createDataFrame([(0, "s", ["b", "a"]), (1, "t", ["b", "a"])], "query_idx long, src string, ranked array<string>")
    got = rank.evaluate(ranked, pool).first()
    assert (got.mrr, got.hits_at_1, got.queries, got.validated) == (0.5, 0.5, 2, True)
    assert tuple(rank.evaluate(ranked, pool, measured=False).first()) == (2, True)
    with pytest.raises(Exception):  # noqa: B017
        rank.evaluate(ranked.where("query_idx = 0"), pool).collect()


def test_axioms_of_triples_join_blank_nodes(spark, tmp_path):
    xml = f"""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}">
<owl:Class rdf:about="{ID}1"><rdfs:label xml:lang="en">One</rdfs:label><rdfs:subClassOf rdf:resource="{ID}2"/><rdfs:subClassOf rdf:nodeID="x"/><owl:equivalentClass rdf:nodeID="y"/><owl:deprecated>true</owl:deprecated></owl:Class>
<owl:Class rdf:about="{ID}2"/>
<owl:Class rdf:nodeID="x"><owl:intersectionOf rdf:nodeID="x1"/></owl:Class>
<rdf:Description rdf:nodeID="x1"><rdf:first rdf:resource="{ID}3"/><rdf:rest rdf:nodeID="x2"/></rdf:Description>
<rdf:Description rdf:nodeID="x2"><rdf:first rdf:nodeID="r"/><rdf:rest rdf:resource="http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"/></rdf:Description>
<owl:Class rdf:nodeID="y"><owl:intersectionOf rdf:nodeID="y1"/></owl:Class>
<rdf:Description rdf:nodeID="y1"><rdf:first rdf:resource="{ID}4"/></rdf:Description>
</rdf:RDF>"""
    path = tmp_path / "t.owl"
    path.write_text(xml, encoding="utf-8")
    triples = rdfxml.read_rdfxml(spark, str(path), triples=True)
    rows = rdfxml.axioms_of_triples(triples).collect()
    by = lambda kind, rows=rows: sorted((r.iri.removeprefix(ID), r.value if kind != "parent" else r.obj.removeprefix(ID)) for r in rows if r.kind == kind)
    assert by("parent") == [("1", "2"), ("1", "3"), ("1", "4")] and by("declaration") == [("1", "Class"), ("2", "Class")]
    assert by("annotation") == [("1", "One")] and by("deprecated") == [("1", "true")]
    strict = rdfxml.axioms_of_triples(triples, of_subclass=False).collect()
    assert by("parent", strict) == [("1", "2"), ("1", "4")]


def test_pool_features_and_raw_logits(spark):
    from tessera.operators import lexical

    pool = spark.createDataFrame([(0, "s", None, "t", 0)], "query_idx long, src string, gold string, cand string, cand_pos int")
    made = lambda iri, names: spark.createDataFrame([(iri, names, [sorted(set(n.split())) for n in names])], "iri string, names array<string>, sets array<array<string>>")
    got = lexical.pool_features(pool, made("s", ["heart valve", "cardiac valve"]), made("t", ["valve of heart", "cardiac valve structure"]), characters=True).first()
    assert (got.e_label, got.e_name, round(got.j, 6), round(got.r, 6), round(got.lex_score, 6)) == (0, 0, 0.666667, 0.722222, 0.347222)
    states = spark.createDataFrame([(0, "s", "t", 0, "a b", "a c", 5)], "query_idx long, src string, cand string, cand_pos int, source_text string, target_text string, n_tokens int")
    row = scorers.score_pairs(states, scorers.token_overlap_scorer, raw=True).first()
    assert row.margin == row.z0 - row.z1
    assert [r["batch_size"] for r in scorers.batch_sweep(spark, states, scorers.token_overlap_scorer, (1, 2))] == [1, 2]
