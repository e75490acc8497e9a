"""Entity tables from long-form axioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, dedup_first, fsn_tag, fsn_term, is_english, local_name
from tessera.schema import DIALECTS, FSN_TERM, RDFS

MAX_RELATED = 12


def literals(axioms: DataFrame) -> DataFrame:
    """Annotations that are English and not blank."""
    return axioms.where((F.col("kind") == "annotation") & is_english(F.col("lang")) & (F.trim(F.coalesce("value", F.lit(""))) != ""))


def retained(axioms: DataFrame, needed: DataFrame, label_props: list[str]) -> DataFrame:
    """Every annotation of needed entities, of the others only what labels them."""
    task = needed.select("iri", F.lit(True).alias("_task")).distinct()
    return axioms.join(task, "iri", "left").where((F.col("kind") != "annotation") | F.col("_task") | F.col("prop").isin(label_props)).drop("_task")


def dialect_rank(lang: Column) -> Column:
    """W08."""
    found = F.lit(max(DIALECTS.values()) + 1)
    for name, rank in DIALECTS.items():
        found = F.when(F.lower(F.coalesce(lang, F.lit(""))) == name, rank).otherwise(found)
    return found


def canonical_names(axioms: DataFrame) -> DataFrame:
    """Order values by dialect and add the term of each entity's first fully specified name; its tag as ``tag`` axiom."""
    ordered = axioms.withColumn("ord", dialect_rank(F.col("lang")).cast("long") * F.lit(1 << 48) + F.col("ord"))
    first = literals(ordered).where(F.col("prop") == RDFS + "label").groupBy("iri").agg(F.min_by(F.struct("value", "lang"), "ord").alias("x"), F.min("ord").alias("ord"))
    row = lambda kind, prop, value: first.select("iri", "ord", F.lit(kind).alias("kind"), F.lit(prop).alias("prop"), value.alias("value"), F.col("x.lang").alias("lang"), F.lit(None).cast("string").alias("obj"))
    term = row("annotation", FSN_TERM, fsn_term(F.col("x.value")))
    tag = row("tag", None, fsn_tag(F.col("x.value")))
    columns = ["iri", "ord", "kind", "prop", "value", "lang", "obj"]
    return ordered.select(*columns).unionByName(term).unionByName(tag)


def first_labels(axioms: DataFrame, roles: DataFrame) -> DataFrame:
    """``(iri, label)`` by the first label property that an entity has, its first value."""
    lab = literals(axioms).join(roles.where("role = 'label'"), "prop")
    return lab.groupBy("iri").agg(collapse(F.min_by("value", F.struct("prio", "ord"))).alias("label"))


def _values(role: str) -> Column:
    rows = F.collect_list(F.when(F.col("role") == role, F.struct("prio", "ord", "value")))
    return F.transform(F.array_sort(rows), lambda x: x["value"])


def _related(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``(iri, labels)`` of ``edges(iri, ord, other)``, in order, unlabelled ones dropped."""
    once = edges.groupBy("iri", "other").agg(F.min("ord").alias("ord"))
    named = once.join(labels.select(F.col("iri").alias("other"), "label"), "other")
    # first of each spelling, then the first few: a hub's whole neighbourhood is never gathered
    spelled = named.groupBy("iri", F.lower("label").alias("spelling")).agg(F.min_by("label", F.struct("ord", "other")).alias("label"), F.min(F.struct("ord", "other")).alias("at"))
    first = spelled.withColumn("n", F.row_number().over(Window.partitionBy("iri").orderBy("at"))).where(F.col("n") <= most)
    return first.groupBy("iri").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("labels"))


def build_entities(axioms: DataFrame, roles: DataFrame, needed: DataFrame, most: int = MAX_RELATED) -> DataFrame:
    """One row per needed id: names by role, definition, labels of parents and children one step away.

    An id without a class record is kept with ``found`` false and a label
    from its own text. Edges are aggregated by the id that needs them; roles
    and ids are the small sides and Spark broadcasts them by their size.
    """
    task = needed.select("iri").distinct()
    records = axioms.where("kind in ('declaration', 'parent', 'annotation', 'deprecated')").select("iri").distinct()
    mine = axioms.join(task, "iri", "left_semi")
    by_role = literals(mine).join(roles, "prop").groupBy("iri").agg(*(_values(r).alias(r) for r in ("label", "exact", "related", "definition")))
    flags = mine.groupBy("iri").agg(
        F.coalesce(F.max_by(F.when(F.col("kind") == "deprecated", F.lower(F.trim("value")) == "true"), F.when(F.col("kind") == "deprecated", F.col("ord"))), F.lit(False)).alias("deprecated"),
        F.max(F.when(F.col("kind") == "tag", F.col("value"))).alias("semantic_tag"),
    )
    labels = first_labels(axioms, roles)
    edges = axioms.where("kind = 'parent'")
    parents = _related(edges.join(task, "iri", "left_semi").select("iri", "ord", F.col("obj").alias("other")), labels, most).withColumnRenamed("labels", "parents")
    below = edges.select(F.col("obj").alias("iri"), F.lit(0).cast("long").alias("ord"), F.col("iri").alias("other")).join(task, "iri", "left_semi")
    children = _related(below, labels, most).withColumnRenamed("labels", "children")
    none = F.array().cast("array<string>")
    joined = task.join(records.withColumn("found", F.lit(True)), "iri", "left").join(by_role, "iri", "left").join(flags, "iri", "left").join(parents, "iri", "left").join(children, "iri", "left")
    listed = joined.withColumn("_labels", dedup_first(F.col("label")))
    named = listed.withColumn("_label", F.try_element_at("_labels", F.lit(1)))
    own = F.when(F.col("_label").isNotNull(), F.array("_label")).otherwise(none)
    exact = named.withColumn("synonyms", dedup_first(F.concat(F.when(F.size("_labels") > 1, F.slice("_labels", 2, 1 << 30)).otherwise(none), F.coalesce("exact", none)), own))
    related = exact.withColumn("related_synonyms", dedup_first(F.col("related"), F.concat(own, "synonyms")))
    return related.select(
        "iri",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("_label", local_name(F.col("iri"))).alias("label"),
        F.col("_label").isNull().alias("label_is_fallback"),
        "synonyms",
        "related_synonyms",
        F.coalesce(collapse(F.try_element_at("definition", F.lit(1))), F.lit("")).alias("definition"),
        F.coalesce("parents", none).alias("parents"),
        F.coalesce("children", none).alias("children"),
        F.coalesce("deprecated", F.lit(False)).alias("deprecated"),
        F.coalesce("semantic_tag", F.lit("")).alias("semantic_tag"),
    )


def coverage(entities: DataFrame) -> DataFrame:
    """Percentages of entities that have each part."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    pct = lambda c: F.bround(100.0 * F.count_if(c) / n, 2)
    return entities.agg(
        F.count(F.lit(1)).alias("entities"),
        pct(F.col("found")).alias("found_in_ontology_pct"),
        pct(~F.col("label_is_fallback")).alias("label_pct"),
        pct((F.size("synonyms") > 0) | (F.size("related_synonyms") > 0)).alias("synonyms_pct"),
        pct(F.col("definition") != "").alias("definition_pct"),
        pct(F.size("parents") > 0).alias("parent_context_pct"),
        pct(F.size("children") > 0).alias("child_context_pct"),
        pct(F.col("deprecated")).alias("deprecated_pct"),
    )


def census(axioms: DataFrame, needed: DataFrame, prop_labels: DataFrame, top: int = 40) -> DataFrame:
    """Needed entities by property, with the first example (smallest id and order) cut to 70 characters."""
    used = axioms.where("kind = 'annotation'").join(needed.select("iri").distinct(), "iri", "left_semi")
    per = used.groupBy("prop").agg(F.count_distinct("iri").alias("n"), F.substring(F.min_by("value", F.struct("iri", "ord")), 1, 70).alias("example"))
    return per.join(prop_labels, "prop", "left").select("prop", "n", "example", F.coalesce("prop_label", F.lit("")).alias("prop_label")).orderBy(F.desc("n"), "prop").limit(top)
