"""OWL functional-style syntax, one axiom per line.

The file is read as splittable text with line order as a column; everything
but class expressions is regular expressions inside the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import expand, is_english, unescape
from tessera.schema import OWL
from tessera.sources.pools import with_line_numbers

_PREFIX = r"^Prefix\(\s*([^:=\s]*):\s*=\s*<([^>]*)>\s*\)"
_DECLARATION = r"^Declaration\((Class|ObjectProperty|DataProperty|AnnotationProperty)\(([^()]+)\)\)"
# Terminals of the public grammar of the syntax: full and abbreviated names, quoted strings, language tags, literals.
_FULL = r"<[^<>\s]*>"
_SHORT = r'[^\s()<>"]+'
_QUOTED = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_LANGUAGE = r"[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*"
_NAME = f"(?:{_FULL}|{_SHORT})"
_ANNOTATION = rf"^AnnotationAssertion\(\s*({_NAME})\s+({_NAME})\s+({_QUOTED})(?:@({_LANGUAGE})|\^\^{_NAME})?\s*\)\s*$"
_TOKENS = re.compile(rf"{_QUOTED}(?:@{_LANGUAGE}|\^\^{_NAME})?|{_FULL}|{_SHORT}|[()]")


def is_ofn(spark: SparkSession, path: str) -> bool:
    """The format begins with a prefix declaration."""
    first = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").first()
    return first is not None and first[0].startswith("Prefix(")


def axiom_parts(line: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """constructor of an axiom, and for each argument its constructor (empty for a name) with its named members at top level."""
    found = _TOKENS.findall(line)
    stack: list[list] = [["", []]]
    k = 0
    while k < len(found):
        token = found[k]
        if token == "(":
            raise ValueError(f"unexpected bracket in {line[:120]!r}")
        if token == ")":
            if len(stack) == 1:
                raise ValueError(f"unexpected bracket in {line[:120]!r}")
            done = stack.pop()
            stack[-1][1].append(tuple(done))
            k += 1
        elif k + 1 < len(found) and found[k + 1] == "(":
            stack.append([token, []])
            k += 2
        else:
            stack[-1][1].append(("", [token]))
            k += 1
    if len(stack) != 1 or len(stack[0][1]) != 1 or not stack[0][1][0][0]:
        raise ValueError(f"no single axiom in {line[:120]!r}")
    kind, arguments = stack[0][1][0]
    return kind, [(c, members if not c else [m[0] for n, m in members if not n]) for c, members in arguments]


_ARGUMENT = T.StructType([T.StructField("constructor", T.StringType()), T.StructField("members", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("args", T.ArrayType(_ARGUMENT))]))
def _parts(lines: pd.Series) -> pd.DataFrame:
    rows = [axiom_parts(x) for x in lines]
    return pd.DataFrame({"kind": [k for k, _ in rows], "args": [[{"constructor": c, "members": m} for c, m in a] for _, a in rows]})


def parse_ofn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Long-form axioms, and one row of counters.

    Annotations of subjects that no earlier line defines are dropped (P10).
    A prefix that isn't declared, an annotation that can't be read and a
    sub-property of an undeclared property are errors.
    """
    lines = with_line_numbers(spark.read.text(path).select("value", "_metadata"))
    skip = (F.col("value") == "") | F.substring("value", 1, 1).isin("#", " ", ")", "<")
    starts = lambda *names: F.greatest(*(F.col("value").startswith(n) for n in names), F.lit(False))
    sub_property = starts("SubObjectPropertyOf(", "SubDataPropertyOf(", "SubAnnotationPropertyOf(")
    kind = (
        F.when(skip, "skip").when(starts("Prefix("), "prefix").when(starts("Ontology("), "skip").when(starts("Declaration("), "declaration").when(starts("AnnotationAssertion("), "annotation")
        .when(starts("SubClassOf("), "subclass").when(starts("EquivalentClasses("), "equivalent").when(sub_property, "subproperty").otherwise("other")
    )
    lines = lines.select("ord", "value", kind.alias("kind"))
    # a file declares a handful of prefixes: their map is one broadcast row
    pairs = lines.where("kind = 'prefix'").select(F.struct(F.regexp_extract("value", _PREFIX, 1).alias("k"), F.regexp_extract("value", _PREFIX, 2).alias("v")).alias("e")).distinct()
    prefixes = F.broadcast(pairs.agg(F.map_from_entries(F.collect_list("e")).alias("prefixes")))
    of = lambda c: expand(c, F.col("prefixes"))

    declared = lines.where("kind = 'declaration'").select("ord", F.regexp_extract("value", _DECLARATION, 1).alias("entity_type"), F.regexp_extract("value", _DECLARATION, 2).alias("name")).where("entity_type <> ''")
    declared = declared.join(prefixes).select(of(F.col("name")).alias("iri"), "ord", "entity_type")

    bad = F.raise_error(F.concat(F.lit("unreadable annotation: "), F.substring("value", 1, 160))).cast("boolean")
    group = lambda n: F.regexp_extract("value", _ANNOTATION, n)
    annotated = lines.where("kind = 'annotation'").where(F.when(F.col("value").rlike(_ANNOTATION), F.lit(True)).otherwise(bad)).join(prefixes)
    annotated = annotated.select(of(group(2)).alias("iri"), "ord", of(group(1)).alias("prop"), unescape(F.substring(group(3), F.lit(2), F.length(group(3)) - 2)).alias("value"), group(4).alias("lang"))

    complex_ = lines.where("kind in ('subclass', 'equivalent', 'subproperty')").select("ord", "kind", _parts("value").alias("p")).join(prefixes)
    args = F.col("p.args")
    named = F.filter(args, lambda a: a["constructor"] == "")
    other = F.filter(args, lambda a: a["constructor"] != "")
    genus = lambda a: F.when(a["constructor"].isin("", "ObjectIntersectionOf"), a["members"]).otherwise(F.array().cast("array<string>"))
    sub, sup = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    case = (
        F.when(F.col("kind") == "subclass", F.when(sub["constructor"] != "", "gci_skipped").when(sup["constructor"] == "", "subclass_named").otherwise("subclass_intersection"))
        .when(F.col("kind") == "equivalent", F.when((F.size(named) == 1) & (F.size(other) == 1), "equivalent_intersection").otherwise("equivalent_other_skipped"))
        .when((sub["constructor"] == "") & (sup["constructor"] == ""), "subproperty_named").otherwise("subproperty_chain_skipped")
    )
    child = F.when(case == "equivalent_intersection", F.get(named, F.lit(0))["members"][0]).when(~case.endswith("skipped"), sub["members"][0])
    above = F.when(case == "equivalent_intersection", genus(F.get(other, F.lit(0)))).otherwise(genus(sup))
    classified = complex_.select("ord", case.alias("case"), child.alias("child"), above.alias("above"), "prefixes")
    hierarchy = classified.where("child is not null").select(of(F.col("child")).alias("iri"), "ord", "case", F.transform("above", of).alias("above"))

    defined = declared.select("iri", "ord").unionByName(hierarchy.where("case <> 'subproperty_named'").select("iri", "ord")).groupBy("iri").agg(F.min("ord").alias("defined"))
    known = annotated.join(defined, "iri", "left").withColumn("late", F.coalesce(F.col("defined") > F.col("ord"), F.lit(True)))
    no_property = F.raise_error(F.concat(F.lit("sub-property of an undeclared property: "), F.col("iri"))).cast("boolean")
    tree = hierarchy.join(defined, "iri", "left").where(F.when((F.col("case") != "subproperty_named") | F.coalesce(F.col("defined") < F.col("ord"), F.lit(False)), F.lit(True)).otherwise(no_property))

    null = F.lit(None).cast("string")
    row = lambda t, kind, prop=null, value=null, lang=null, obj=null: t.select("iri", "ord", kind.alias("kind"), prop.alias("prop"), value.alias("value"), lang.alias("lang"), obj.alias("obj"))
    stated = F.when(F.col("prop") == OWL + "deprecated", "deprecated").otherwise("annotation")
    records = row(tree, F.lit("declaration")).unionByName(row(declared, F.lit("declaration"), value=F.col("entity_type")))
    kept = known.where(~F.col("late") & is_english(F.col("lang")) & ((F.col("value") != "") | (F.col("prop") == OWL + "deprecated")))
    axioms = records.unionByName(row(kept, stated, F.col("prop"), F.col("value"), F.col("lang")))
    axioms = axioms.unionByName(row(tree.withColumn("obj", F.explode("above")), F.lit("parent"), obj=F.col("obj")))

    count = lambda name: F.count_if(F.col("case") == name).alias(name)
    first = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "annotation").alias("annotation_assertions"), F.count_if(F.col("kind") == "other").alias("other_axioms_skipped"))
    second = declared.agg(*(F.count_if(F.col("entity_type") == t).alias("declared_classes" if t == "Class" else f"declared_{t}") for t in ("Class", "ObjectProperty", "DataProperty", "AnnotationProperty")))
    third = classified.agg(*map(count, ("subclass_named", "subclass_intersection", "gci_skipped", "equivalent_intersection", "equivalent_other_skipped", "subproperty_named", "subproperty_chain_skipped")))
    fourth = known.agg(F.count_if("late").alias("annotations_on_undeclared"))
    return axioms, first.join(F.broadcast(second)).join(F.broadcast(third)).join(F.broadcast(fourth))
