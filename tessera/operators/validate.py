"""Differential and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, is_english
from tessera.settled import settled


def multiset_diff(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows whose number differs between two tables, with both numbers."""
    count = lambda t, name: t.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    tagged = count(a, "n_a").withColumn("n_b", F.lit(0).cast("long")).unionByName(count(b, "n_b").withColumn("n_a", F.lit(0).cast("long")))
    both = tagged.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return both.where("n_a <> n_b")


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """T01-T04 in one pass over two one-column tables: union, intersection, differences, symmetric difference."""
    key = a.columns[0]
    tagged = a.select(F.col(key).alias("k"), F.lit(1).alias("side")).unionByName(b.select(F.col(b.columns[0]).alias("k"), F.lit(2).alias("side")))
    sides = tagged.groupBy("k").agg(F.bit_or("side").alias("sides"))
    return sides.agg(
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(F.col("sides") == 3).alias("n_intersect"),
        F.count_if(F.col("sides") == 1).alias("n_only_a"),
        F.count_if(F.col("sides") == 2).alias("n_only_b"),
        F.count_if(F.col("sides") != 3).alias("n_symmetric"),
    )


def same_sets(a, b):
    """Equal as sets (arrays of one row)."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def loader_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities of two loaders that differ, by part."""
    x = a.select("iri", *(F.col(c).alias(f"a_{c}") for c in ("label", "synonyms", "definition", "parents")))
    y = b.select("iri", *(F.col(c).alias(f"b_{c}") for c in ("label", "synonyms", "definition", "parents")))
    joined = x.join(y, "iri", "full_outer")
    differs = lambda c: F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
    listed = lambda c: F.count_if(~F.array_sort(f"a_{c}").eqNullSafe(F.array_sort(f"b_{c}")))
    return joined.agg(F.count(F.lit(1)).alias("entities"), differs("label").alias("label"), listed("synonyms").alias("synonyms"), differs("definition").alias("definition"), listed("parents").alias("parents"))


def probability_gap(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The largest distance between a stored probability and the sigmoid of its margin (reported, not enforced)."""
    from tessera.functions.scores import sigmoid

    return scores.agg(F.max(F.abs(F.col("prob") - sigmoid(F.col("margin"), temperature))).alias("max_gap"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Pairs, queries and truncated states."""
    return scores.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_idx").alias("queries"), F.sum("truncated").cast("long").alias("truncated"))


def margin_drift(first: DataFrame, other: DataFrame) -> DataFrame:
    """The largest difference of margins between two runs over the same pairs."""
    o = other.select("query_idx", "cand_pos", F.col("margin").alias("_m"))
    return first.join(o, ["query_idx", "cand_pos"]).agg(F.max(F.abs(F.col("margin") - F.col("_m"))).alias("drift"))


def type_counts(rows: DataFrame, column: str, *by: str, top: int = 12) -> DataFrame:
    """Counts by value, the most frequent ones of each group by ``by``."""
    counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), column).limit(top)
    w = Window.partitionBy(*by).orderBy(F.desc("n"), column)
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")


def walk_lists(cells: DataFrame, most: int = 10_000) -> DataFrame:
    """``(head, at, member)`` of linked lists ``cells(cell, member, rest)``, from every cell that nothing points at.

    Pointer doubling: each round every cell jumps to where its pointer points,
    so a list of n cells takes log2(n) equi-joins. Cells of a ring have no
    head and are left out, as are places from ``most`` on.
    """
    known = cells.select("cell", "member").where("cell is not null")
    before = cells.where("rest is not null").select(F.col("rest").alias("cell"), F.col("cell").alias("to")).join(known.select("cell").distinct(), "cell", "left_semi")
    state = known.select("cell").distinct().join(before, "cell", "left").select("cell", F.coalesce("to", "cell").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).alias("at"), F.col("to").isNull().alias("done"))
    for _ in range(most.bit_length()):
        state = settled(state)
        if state.where("not done").isEmpty():
            break
        step = state.select(F.col("cell").alias("_from"), F.col("to").alias("_to"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        moved = state.where("not done").join(step, F.col("to") == F.col("_from")).select("cell", F.col("_to").alias("to"), (F.col("at") + F.col("_at")).alias("at"), F.col("_done").alias("done"))
        state = state.where("done").unionByName(moved.where(F.col("at") < most))
    return state.where("done").join(known, "cell").where("member is not null").select(F.col("to").alias("head"), F.col("at").cast("int").alias("at"), "member")


def question_statistics(questions: DataFrame) -> DataFrame:
    """Over ``(head_tokens, input_tokens, collapsed)`` of many-option questions: means and maxima of tokens, and how many questions had options collapsed."""
    return questions.agg(
        F.avg("head_tokens").alias("head_max_len_mean"),
        F.max("head_tokens").alias("head_max_len_max"),
        F.avg("input_tokens").alias("input_tokens_mean"),
        F.max("input_tokens").alias("input_tokens_max"),
        F.count_if(F.col("collapsed")).alias("queries_with_collapsed_options"),
    )


def fastest(sweep: DataFrame) -> DataFrame:
    """Of ``(batch_size, pairs_per_sec, fallbacks)`` the fastest row without fallback, the smaller batch on ties."""
    return sweep.where("fallbacks = 0").orderBy(F.desc("pairs_per_sec"), "batch_size").limit(1)


def verification_report(a: DataFrame, b: DataFrame, task: DataFrame, examples: int = 10) -> DataFrame:
    """One row comparing two readings of an ontology over the entities ``task(iri)``.

    ``a`` and ``b`` are long-form axioms. Reported: declared types alike, task
    entities that either doesn't declare, entities whose annotations differ as
    multisets or whose sets of parents differ, those without parents, the
    first examples of each in code-point order, and whether all is well.
    """
    task = task.select("iri").distinct()

    def declared(axioms: DataFrame) -> DataFrame:
        return axioms.where("kind = 'declaration' and value is not null").select("iri", F.col("value").alias("type")).distinct()

    def of_task(axioms: DataFrame, kind: str) -> DataFrame:
        return axioms.where(F.col("kind") == kind).join(task, "iri", "left_semi")

    def absent(axioms: DataFrame) -> DataFrame:
        return task.join(declared(axioms).select("iri"), "iri", "left_anti")

    pairs_of = lambda axioms: of_task(axioms, "parent").select("iri", "obj").distinct()
    notes_of = lambda axioms: of_task(axioms, "annotation").select("iri", "prop", "lang", "value")
    found = {
        "not_declared_a": absent(a),
        "not_declared_b": absent(b),
        "annotation_mismatches": multiset_diff(notes_of(a), notes_of(b), "iri", "prop", "lang", "value").select("iri").distinct(),
        "parent_mismatches": multiset_diff(pairs_of(a), pairs_of(b), "iri", "obj").select("iri").distinct(),
        "without_parent": task.join(of_task(a, "parent").select("iri"), "iri", "left_anti"),
        "type_mismatches": multiset_diff(declared(a), declared(b), "iri", "type").select("iri").distinct(),
    }
    tagged = task.select(F.lit("task").alias("what"), "iri")
    for name, rows in found.items():
        tagged = tagged.unionByName(rows.select(F.lit(name).alias("what"), "iri"))
    # the first examples by running minimum, so that no list of all is gathered
    place = Window.partitionBy("what").orderBy("iri")
    some = tagged.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= examples)
    counts = tagged.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    shown = some.groupBy("what").agg(F.array_sort(F.collect_list("iri")).alias("first"))
    both = counts.join(shown, "what")
    n = lambda name: F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0))
    first = lambda name: F.coalesce(F.first(F.when(F.col("what") == name, F.col("first")), ignorenulls=True), F.array().cast("array<string>"))
    bad = [k for k in found if k != "without_parent"]
    report = both.agg(n("task").alias("task_entities"), *(n(k).alias(f"n_{k}") for k in found), *(first(k).alias(k) for k in found))
    return report.withColumn("all_checks_pass", sum((F.col(f"n_{k}") for k in bad), F.lit(0)) == 0)


def english_literals(axioms: DataFrame) -> DataFrame:
    """Annotations in English with their white space collapsed; blank ones and other languages go."""
    kept = axioms.where("kind = 'annotation'").where(is_english(F.col("lang"))).withColumn("value", collapse(F.col("value")))
    return kept.where("value <> ''")
