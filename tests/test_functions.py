"""Column functions against golden values."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import budget, scores, similarity, text


def column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


NORMAL = {
    "Heart Valves": "heart valve", "Abscess": "abscess", "virus": "virus", "gas": "gas", "Lens": "lens", "Cells": "cell", "kidneys": "kidney",
    "Crohn's disease": "crohn disease", "Crohn’s disease": "crohn’ disease", "'sample'": "ample", "Non-Hodgkin_lymphoma/NOS": "non hodgkin lymphoma nos",
    "B-cells (T)": "b cell t", "!!!": "", "a b": "a b", "ΑΣ": "ας",
}


def test_normalize(spark):
    assert column(spark, list(NORMAL), text.normalize) == list(NORMAL.values())


def test_names(spark):
    df = spark.createDataFrame([("Cells", ["cell", "Nerve cells", None]), (None, None), ("!", [])], "l string, s array<string>")
    assert [r[0] for r in df.select(text.names(F.col("l"), F.col("s"))).collect()] == [["cell", "nerve cell"], [""], [""]]


def test_fsn(spark):
    cases = {"Round thing (artifact)": ("Round thing", "artifact"), "Thing (old) (artifact)": ("Thing (old)", "artifact"), "A  b ( c )": ("A b", " c "), "No tag": ("No tag", ""), "(artifact)": ("(artifact)", ""), "Thing (a(b))": ("Thing (a(b))", ""), "Thing(artifact)": ("Thing(artifact)", "")}
    assert column(spark, list(cases), text.fsn_term) == [a for a, _ in cases.values()]
    assert column(spark, list(cases), text.fsn_tag) == [b for _, b in cases.values()]


def test_local_name(spark):
    cases = {"http://x/o#LeftHeart_Valve": "Left Heart Valve", "http://x/o/a+b%20c/": "a+b c", "http://x/DNARepair": "DNARepair", "http://x/o#x%ZZy": "x%ZZy"}
    assert column(spark, list(cases), text.local_name) == list(cases.values())


def test_list_literals(spark):
    assert column(spark, ["['http://ex.org/a', \"http://ex.org/it's\"]", "[]"], text.parse_list) == [["http://ex.org/a", "http://ex.org/it's"], []]
    again = column(spark, ["['a', \"it's\"]"], lambda c: text.print_list(text.parse_list(c)))
    assert again == ["['a', \"it's\"]"]


def test_fixed_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.0078125,), (0.1328125,), (1.0,)], "v double")
    assert [r[0] for r in df.select(text.fixed(F.col("v"), 6)).collect()] == ["0.007812", "0.132812", "1.000000"]


def test_small_functions(spark):
    assert column(spark, [r"say \"hi\" "], text.unescape) == ['say "hi"']
    assert column(spark, ["{http://a#}b"], text.tag_iri) == ["http://a#b"]
    assert column(spark, ["en-GB", "enm", "fr", "", None], text.is_english) == [True, True, False, True, True]
    row = spark.createDataFrame([([" A b", "a  B", "c", ""], ["C"])], "v array<string>, x array<string>").select(text.dedup_first(F.col("v"), F.col("x")), text.option_key(F.lit(7))).first()
    assert list(row) == [["A b"], "T07"]
    line = spark.range(1).select(text.metrics_text(F.lit(0.5), F.lit(0.25), F.lit(0.5), F.lit(1.0), F.lit(8))).first()[0]
    assert line == "MRR=0.5000  H@1=0.2500  H@5=0.5000  H@10=1.0000  (n=8)"


def test_lexical_features(spark):
    df = spark.createDataFrame([(["heart valve", "cardiac valve"], ["valve of heart", "cardiac valve structure"]), ([""], [""])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(similarity.label_equal(a, b).alias("el"), similarity.name_equal(a, b).alias("en"), similarity.best_jaccard(similarity.token_sets(a), similarity.token_sets(b)).alias("j"), similarity.best_ratio(a, b).alias("r"))
    rows = rows.select("el", "en", F.bround("j", 6), F.bround("r", 6), F.bround(similarity.lex_score(F.col("el"), F.col("en"), F.col("j"), F.col("r")), 6)).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0.666667, 0.722222, 0.347222), (1, 1, 0.0, 1.0, 0.75)]


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs_by_dynamic_programming(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert similarity.lcs_length(a, b) == row[-1]


def test_feature_tables_equal_single_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    listed = [[word(rng.choice((0, 1, 5, 20, 64, 65, 90))) for _ in range(rng.choice((1, 1, 2, 3)))] for _ in range(24)] + [[""], ["ab c", ""], ["ab c"]]
    a, b = listed[:20] + listed[24:], listed[10:]
    frame = spark.createDataFrame([(x, y) for x in a for y in b], "a array<string>, b array<string>")
    x, y = F.col("a"), F.col("b")
    e_name = similarity.name_equal(x, y)
    rows = frame.select(similarity.label_equal(x, y), e_name, similarity.best_jaccard(similarity.token_sets(x), similarity.token_sets(y)), similarity.ratio_or_exact(e_name, x, y)).collect()
    sets = {n: s for n, s in spark.createDataFrame([(n,) for names in listed for n in names], "n string").select("n", text.token_set(F.col("n"))).collect()}
    tables = similarity.feature_table(*([(names, [sets[n] for n in names]) for names in side] for side in (a, b)))
    assert [tuple(r) for r in rows] == list(zip(*(t.ravel().tolist() for t in tables), strict=True))


def test_bround_of_arrays(spark):
    values = [k / 640 for k in range(641)] + [k / 7 for k in range(60)] + [0.0000005, 0.0000015, 0.1234565, 1.0, 2.5e-6]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.bround("v", 6)).collect()]
    assert similarity.bround(np.array(values), 6).tolist() == want


def test_indel_ratio():
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13) and similarity.indel_ratio("", "") == 1.0


def test_score_functions(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 0.0), (1, -1.0), (2, 1.0), (2, 1.0)], "q int, v double")
    assert sorted(r[0] for r in df.select(F.bround(scores.minmax(F.col("v"), "q"), 6)).collect()) == [0.0, 0.0, 0.0, 0.333333, 1.0]
    assert spark.range(1).select(scores.sigmoid(F.lit(1e9)), F.bround(scores.sigmoid(F.lit(2.0)), 6)).first()[:] == (1.0, 0.880797)
    values = F.array(*map(F.lit, range(1, 21)))
    assert spark.range(1).select(scores.nearest_rank(values, 0.5), scores.nearest_rank(values, 0.95)).first()[:] == (11, 20)


def test_fit_list_agrees_with_its_native_form(spark):
    rng = random.Random(1)
    rows = [(k, [" ".join(rng.choices(["a", "bb", "c-d"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(6))], rng.randrange(1, 20)) for k in range(50)]
    got = spark.createDataFrame(rows, "k int, items array<string>, n int").select("k", budget.fit_list_native(F.lit("P: "), F.col("items"), F.col("n")).alias("x")).collect()
    assert {r.k: r.x for r in got} == {k: budget.fit_list(budget.word_offsets, "P: ", items, n) for k, items, n in rows}


def test_fit_text():
    tok = budget.word_offsets
    assert budget.fit_text(tok, "D: ", "one two", 10) == "D: one two"
    assert budget.fit_text(tok, "D: ", "one two, three four five six", 7) == "D: one two ..."  # the last word may be cut, so it goes
    assert budget.fit_text(tok, "D: ", "one two three four five six seven", 6) == ""


def test_entity_text():
    render = lambda rep, n=200: budget.entity_text(budget.word_offsets, "SOURCE", "X", "heart", ["cor", "pump"], "An organ.", ["viscus"], rep, n)
    assert render("A") == "SOURCE CONCEPT\nOntology: X\nPreferred label: heart"
    assert render("D").split("\n")[3:] == ["Synonyms: cor; pump", "Definition: An organ.", "Parent concepts: viscus"]
    assert render("C").split("\n")[3:] == ["Synonyms: cor; pump", "Definition: An organ."]
    assert render("B", 13).split("\n")[3:] == ["Synonyms: cor"]
    with pytest.raises(ValueError):
        render("E")


def test_budgets(spark):
    assert budget.concept_budget(512, 60) == 221
    row = spark.range(1).select(budget.option_text(F.lit("a"), F.array(F.lit("b c"), F.lit("d")), 4), budget.question_budget(F.array(F.lit("a b"), F.lit("c")), 10)).first()
    assert row[0] == "a; b c" and row[1] == 2 + 1 + 1 + 1 + 10 + 32


def test_local_name_is_trimmed(spark):
    assert column(spark, ["http://x/_Foo_", "http://x/a%20/", "http://x/o#_leftHeart"], text.local_name) == ["Foo", "a", "left Heart"]


def test_rank_quantiles_equal_sorted_lists(spark):
    rows = [("a", k % 7) for k in range(50)] + [("b", 3)] + [("c", None)]
    got = {r.g: (r.m, r.p, r["max"]) for r in scores.rank_quantiles(spark.createDataFrame(rows, "g string, v int"), "v", {"m": 0.5, "p": 0.95}, "g").collect()}
    listed = sorted(v for g, v in rows if g == "a")
    assert got == {"a": (listed[25], listed[47], 6), "b": (3, 3, 3)}
