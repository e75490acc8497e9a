"""Registered queries, each with independent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import budget, text
from tessera.functions.scores import minmax, rank_quantiles, sigmoid
from tessera.operators import blend, entities, lexical, pairs, rank, sampling, select, validate
from tessera.plans import adapters
from tessera.plans.adapters import read
from tessera.schema import OWL, RDFS, SKOS, roles
from tessera.settled import scratch_path
from tessera.sources import ofn, pools, rdfxml
from tessera.streaming import incremental
from tessera.streaming.incremental import complete_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL that several oracles share ---

_PUNCT = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_WS}'), lambda t: t <> '')"


def _norm(c: str) -> str:
    plain = f"regexp_replace(replace(replace(lower({c}), '''s', ''), '''', ''), '{_PUNCT}', ' ', 'g')"
    one = "case when length(t) > 4 and ends_with(t, 's') and not (ends_with(t, 'ss') or ends_with(t, 'us') or ends_with(t, 'is') or ends_with(t, 'as') or ends_with(t, 'os')) then substr(t, 1, length(t) - 1) else t end"
    return f"array_to_string(list_transform({_tokens(plain)}, lambda t: {one}), ' ')"


def _first_wins(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


_POOL = """
nb as (select greatest(1, count(*) // 250) as b from documents),
gold as (select b.item_id, min(d.doc_id) as gold from benchmark b join documents d on contains(d.text, b.text) group by b.item_id),
bi as (select item_id, cast('0x' || substr(md5('i|' || item_id), 1, 8) as bigint) % b as bucket from benchmark, nb),
bd as (select doc_id, cast('0x' || substr(md5('b|' || doc_id), 1, 8) as bigint) % b as bucket from documents, nb),
pc as (select item_id, doc_id from bi join bd using (bucket) union select item_id, gold from gold),
ph as (select pc.item_id, pc.doc_id, g.gold, md5(pc.item_id || '|' || pc.doc_id) as h from pc left join gold g on g.item_id = pc.item_id),
pm as (select *, row_number() over (partition by item_id order by case when doc_id = gold then 0 else 1 end, h, doc_id) as m from ph),
pool as (select item_id as query_idx, 'i' || item_id as src, 'd' || gold as gold, 'd' || doc_id as cand, item_id, doc_id,
                cast(row_number() over (partition by item_id order by md5('pos|' || h), doc_id) - 1 as integer) as cand_pos from pm where m <= 100)
"""


def _names(table: str, key: str, prefix: str) -> str:
    lines = "string_split(text, chr(10))"
    listed = f"list_filter(list_transform({lines}, lambda n: {_norm('n')}), lambda n: n <> '')"
    return f"select '{prefix}' || {key} as iri, case when len(l) = 0 then [''] else {_first_wins('l')} end as names from (select {key}, {listed} as l from {table})"


_JACCARD = "case when len(list_distinct(list_concat(x, y))) = 0 then 0.0 else len(list_intersect(x, y)) / cast(len(list_distinct(list_concat(x, y))) as double) end"
_FEATURES = f"""
en as ({_names('benchmark', 'item_id', 'i')} union all {_names('documents', 'doc_id', 'd')}),
es as (select iri, names, list_transform(names, lambda n: list_distinct({_tokens('n')})) as sets from en),
lex as (select p.*, case when s.names[1] = t.names[1] then 1 else 0 end as e_label,
               case when len(list_intersect(s.names, t.names)) > 0 then 1 else 0 end as e_name,
               list_max(flatten(list_transform(s.sets, lambda x: list_transform(t.sets, lambda y: {_JACCARD})))) as j
        from pool p join es s on s.iri = p.src join es t on t.iri = p.cand),
lexr as (select *, row_number() over (partition by query_idx order by round_even((e_label + e_name + j) / 3, 9) desc, cand_pos) as rank,
               round_even((e_label + e_name + j) / 3, 9) as lex from lex)
"""
_METRICS = """
select round_even(sum(case when gold_rank > 0 then n / gold_rank else 0 end order by gold_rank) / greatest(1, sum(n)), 6) as mrr,
       round_even(sum(case when gold_rank <= 1 then n else 0 end) / cast(greatest(1, sum(n)) as double), 6) as hits_at_1,
       round_even(sum(case when gold_rank <= 5 then n else 0 end) / cast(greatest(1, sum(n)) as double), 6) as hits_at_5,
       round_even(sum(case when gold_rank <= 10 then n else 0 end) / cast(greatest(1, sum(n)) as double), 6) as hits_at_10,
       cast(sum(n) as bigint) as queries"""
_VECTORS = """
vb as (select greatest(1, count(*) // 150) as b from embeddings),
vq as (select vec_id as q, cast(embedding as double[]) as a, label as la, cast('0x' || substr(md5('q|' || vec_id), 1, 8) as bigint) % b as bucket from embeddings, vb),
vc as (select vec_id as c, cast(embedding as double[]) as e, label as lb, cast('0x' || substr(md5('c|' || vec_id), 1, 8) as bigint) % b as bucket from embeddings, vb),
vm as (select q, c, a, e, la, lb, row_number() over (partition by q order by md5(q || '|' || c), c) as m from vq join vc using (bucket) where q <> c),
vs as (select q as query_idx, 'v' || q as src, 'v' || c as cand, cast(m - 1 as integer) as cand_pos, round_even(list_dot_product(a, e), 6) as margin,
              len(list_filter(list_zip(a, e), lambda x: (x[1] > 0) = (x[2] > 0))) / cast(len(a) as double) as lex, m, la = lb as same from vm where m <= 100),
scores as (select query_idx, src, cand, cand_pos, margin, lex, first_value(case when same then cand end) over (partition by query_idx order by case when same then 0 else 1 end, m) as gold from vs)
"""
_SCALED = """
scaled as (select *, case when max(margin) over w <= min(margin) over w then 0.0 else (margin - min(margin) over w) / (max(margin) over w - min(margin) over w) end as ml,
                  case when max(lex) over w <= min(lex) over w then 0.0 else (lex - min(lex) over w) / (max(lex) over w - min(lex) over w) end as mx,
                  1 / (1 + exp(-greatest(-700.0, least(700.0, margin)))) as prob
           from scores window w as (partition by query_idx))
"""
_GRID = """
alphas as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::double[]) as alpha),
modes as (select unnest(['minmax', 'prob']) as mode),
mixed as (select query_idx, cand_pos, cand, gold, mode, alpha,
                 round_even(case when mode = 'minmax' then alpha * ml + (1 - alpha) * mx else alpha * prob + (1 - alpha) * lex end, 9) as score from scaled, alphas, modes),
placed as (select *, row_number() over (partition by mode, alpha, query_idx order by score desc, cand_pos) as rank from mixed),
gr as (select mode, alpha, query_idx, min(case when cand = gold then rank end) as gold_rank from placed group by all),
gh as (select mode, alpha, gold_rank, count(*) as n from gr group by all)
"""


# --- pools and lexical ranking ---


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pool_rows(spark, sf_dir)
    source = adapters.text_entities(read(spark, sf_dir, "benchmark"), "item_id", "i").select("iri", "names", "sets")
    target = adapters.text_entities(read(spark, sf_dir, "documents"), "doc_id", "d").select("iri", "names", "sets")
    return lexical.pool_features(rows, source, target)


def _lex_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _lexical(spark, sf_dir).withColumn("lex", F.bround((F.col("e_label") + F.col("e_name") + F.col("j")) / 3, 9))
    return rank.ranked(scored, "lex")


@query(f"with {_POOL} select query_idx, src, gold, cand, cand_pos from pool")
def pool_build(spark, sf_dir):
    return adapters.pool_rows(spark, sf_dir)


@query(f"""with {_POOL},
q as (select query_idx, src, gold, count(*) as n, count(distinct cand) as d, min(case when cand = gold then cand_pos end) as pos from pool group by all),
s as (select src, count(*) as c from q group by src)
select cast(count(*) as bigint) as queries, (select count(*) from s) as sources, (select count(*) from s where c > 1) as sources_repeated, cast(min(n) as integer) as min_pool, cast(max(n) as integer) as max_pool,
       cast(count(*) filter (where n <> d) as bigint) as queries_with_duplicates, count(gold) as with_gold, count(pos) as gold_in_pool, round_even(sum(pos) / count(pos), 6) as mean_gold_pos,
       count(*) filter (where pos = 0) as gold_first from q""")
def pool_inspect(spark, sf_dir):
    return pairs.inspect_pools(adapters.pools(adapters.pool_rows(spark, sf_dir)))


@query(f"with {_POOL}, q as (select query_idx, count(*) as n from pool group by 1) select cast(n as integer) as size, count(*) as queries from q group by 1")
def pool_sizes(spark, sf_dir):
    return pairs.pool_sizes(adapters.pools(adapters.pool_rows(spark, sf_dir)))


@query(f"with {_POOL}, s as (select query_idx % 3 as split, cand from pool) select split, count(distinct cand) as targets from s group by 1")
def split_targets(spark, sf_dir):
    """Distinct candidate targets of each split."""
    return pairs.distinct_targets(adapters.pools(adapters.pool_rows(spark, sf_dir)).withColumn("split", F.col("query_idx") % 3), "split")


@query("with s as (select distinct l_linestatus || l_returnflag as split, l_partkey as src from lineitem) select a.split, b.split as other, count(*) as sources from s a join s b on a.src = b.src and a.split < b.split group by 1, 2")
def source_overlaps(spark, sf_dir):
    """Sources that two splits share."""
    return pairs.source_overlaps(read(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("split"), F.col("l_partkey").alias("src")))


@query(f"with {_POOL} select distinct cand as iri from pool")
def task_entities(spark, sf_dir):
    """A01, O01, T01."""
    return pairs.ordered_entities(adapters.pools(adapters.pool_rows(spark, sf_dir)), False)


@query(f"with {_POOL}, q as (select query_idx, src, gold, list(cand order by cand_pos) as cands from pool group by all) select cast(row_number() over (order by query_idx) - 1 as bigint) as query_idx, src, gold, cands from q")
def pool_file(spark, sf_dir):
    """Pools written as a file and read back in its order."""
    path = scratch_path(spark, "pools")
    pools.write_pool(adapters.pools(adapters.pool_rows(spark, sf_dir)), path)
    return pools.read_pool(spark, path)


@query(f"with {_VECTORS} select query_idx, src, cand, cand_pos, margin from scores")
def score_file(spark, sf_dir):
    """Scores written with six decimals and read back."""
    path = scratch_path(spark, "scores")
    s = adapters.vector_scores(spark, sf_dir, True).select("query_idx", "src", "cand", "cand_pos", "margin")
    pools.write_scores(s, path, {"margin": 6}, True)
    return pools.read_scores(spark, path, "query_idx bigint, src string, cand string, cand_pos int, margin double")


def _stored(scores: DataFrame) -> DataFrame:
    """Scores written once, where each reading of a plan would make them anew."""
    path = scratch_path(scores.sparkSession, "stored")
    scores.write.parquet(path)
    return scores.sparkSession.read.parquet(path)


@query(f"with {_VECTORS} select query_idx, cand_pos, cand, lex from scores")
def resumed_scores(spark, sf_dir):
    """A first run of half the queries, then one that scores what is pending."""
    path = scratch_path(spark, "resumed")
    s = _stored(adapters.vector_scores(spark, sf_dir).drop("margin"))
    pool = adapters.pools(s)
    stored = s.select("query_idx", "cand_pos", "cand", "lex")
    score = lambda todo: pairs.explode_pool(todo).select("query_idx", "cand_pos").join(stored, ["query_idx", "cand_pos"])
    incremental.score_resumably(spark, pairs.first_queries(pool, 200), score, path)
    return incremental.score_resumably(spark, pool, score, path).select("query_idx", "cand_pos", "cand", "lex")


_OFN_HEAD = ("Prefix(:=<http://ex.org/id/>)", f"Prefix(rdfs:=<{RDFS}>)", f"Prefix(skos:=<{SKOS}>)", "Ontology(<http://ex.org/o>")


def _ofn_lines(spark, sf_dir) -> DataFrame:
    """Nations and regions as functional syntax: prefixes, declarations, labels, hierarchy."""
    row = lambda frame, part, key, line: frame.select(F.lit(part).alias("part"), F.col(key).cast("long").alias("key"), line.alias("value"))
    n, r, s = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    of = lambda shape, *c: F.format_string(shape, *map(F.col, c))
    lines = spark.createDataFrame([(0, k, line) for k, line in enumerate(_OFN_HEAD)], "part int, key long, value string")
    for part in (
        row(r, 1, "r_regionkey", of("Declaration(Class(:r%s))", "r_regionkey")),
        row(n, 2, "n_nationkey", of("Declaration(Class(:n%s))", "n_nationkey")),
        row(s, 3, "s_suppkey", of("Declaration(Class(:s%s))", "s_suppkey")),
        row(r, 4, "r_regionkey", of('AnnotationAssertion(rdfs:label :r%s "%s (region)"@en)', "r_regionkey", "r_name")),
        row(n, 5, "n_nationkey", of('AnnotationAssertion(skos:prefLabel :n%s "%s"@en-us)', "n_nationkey", "n_name")),
        row(s, 6, "s_suppkey", of('AnnotationAssertion(skos:altLabel :s%s "%s"@fr)', "s_suppkey", "s_name")),
        row(n, 7, "n_nationkey", of("SubClassOf(:n%s :r%s)", "n_nationkey", "n_regionkey")),
        row(s, 8, "s_suppkey", of("SubClassOf(:s%s ObjectIntersectionOf(:n%s ObjectSomeValuesFrom(:p :r0)))", "s_suppkey", "s_nationkey")),
        row(r, 9, "r_regionkey", of("SubClassOf(ObjectSomeValuesFrom(:p :r%s) :r0)", "r_regionkey")),
    ):
        lines = lines.unionByName(part)
    return lines.unionByName(spark.createDataFrame([(10, 0, ")")], "part int, key long, value string")).orderBy("part", "key").select("value")


def _written(lines: DataFrame, name: str) -> str:
    path = scratch_path(lines.sparkSession, name)
    lines.coalesce(1).write.text(path)
    return path


@query("select cast(4 + 4 * (select count(*) from region) - (select count(*) from region) + 3 * (select count(*) from nation) + 3 * (select count(*) from supplier) + 1 as bigint) as lines, (select count(*) from region) + (select count(*) from nation) + (select count(*) from supplier) as declared_classes, (select count(*) from region) + (select count(*) from nation) + (select count(*) from supplier) as annotation_assertions, (select count(*) from nation) as subclass_named, (select count(*) from supplier) as subclass_intersection, (select count(*) from region) as gci_skipped")
def ofn_counters(spark, sf_dir):
    """A file in functional syntax, counted by kind of line."""
    _, stats = ofn.parse_ofn(spark, _written(_ofn_lines(spark, sf_dir), "ofn"))
    return stats.select("lines", "declared_classes", "annotation_assertions", "subclass_named", "subclass_intersection", "gci_skipped")


@query("""select 'http://ex.org/id/r' || r_regionkey as iri, 'annotation' as kind, r_name || ' (region)' as value from region union all select 'http://ex.org/id/n' || n_nationkey, 'annotation', n_name from nation
union all select 'http://ex.org/id/n' || n_nationkey, 'parent', 'http://ex.org/id/r' || n_regionkey from nation union all select 'http://ex.org/id/s' || s_suppkey, 'parent', 'http://ex.org/id/n' || s_nationkey from supplier""")
def ofn_axioms(spark, sf_dir):
    """Annotations and parents of a file in functional syntax."""
    axioms, _ = ofn.parse_ofn(spark, _written(_ofn_lines(spark, sf_dir), "ofn"))
    return axioms.where("kind in ('annotation', 'parent')").select("iri", "kind", F.coalesce("obj", "value").alias("value"))


@query(f"""select 'http://ex.org/id/n' || n_nationkey as iri, 'annotation' as kind, '{RDFS}label' as prop, n_name as value from nation union all select 'http://ex.org/id/n' || n_nationkey, 'parent', null, 'http://ex.org/id/r' || n_regionkey from nation
union all select 'http://ex.org/id/r' || r_regionkey, 'annotation', '{RDFS}label', r_name from region""")
def rdfxml_axioms(spark, sf_dir):
    """Annotations and parents of a file in RDF/XML."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    head = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="{}" xmlns:owl="{}">'.format(RDFS, OWL)
    ids = "http://ex.org/id/"
    lines = spark.createDataFrame([(0, 0, head)], "part int, key long, value string")
    lines = lines.unionByName(n.select(F.lit(1).alias("part"), F.col("n_nationkey").cast("long").alias("key"), F.format_string(f'<owl:Class rdf:about="{ids}n%s"><rdfs:label>%s</rdfs:label><rdfs:subClassOf rdf:resource="{ids}r%s"/></owl:Class>', "n_nationkey", "n_name", "n_regionkey").alias("value")))
    lines = lines.unionByName(r.select(F.lit(2).alias("part"), F.col("r_regionkey").cast("long").alias("key"), F.format_string(f'<rdf:Description rdf:about="{ids}r%s"><rdf:type rdf:resource="{OWL}Class"/><rdfs:label>%s</rdfs:label></rdf:Description>', "r_regionkey", "r_name").alias("value")))
    lines = lines.unionByName(spark.createDataFrame([(3, 0, "</rdf:RDF>")], "part int, key long, value string")).orderBy("part", "key").select("value")
    axioms = rdfxml.read_rdfxml(spark, _written(lines, "owl"))
    return axioms.where("kind in ('annotation', 'parent')").select("iri", "kind", F.when(F.col("kind") == "annotation", F.col("prop")).alias("prop"), F.coalesce("obj", "value").alias("value"))


@query(f"with {_POOL} select cast(cand_pos // 10 as bigint) as bucket, count(*) as n from pool where cand = gold group by 1")
def gold_deciles(spark, sf_dir):
    return pairs.gold_deciles(adapters.pools(adapters.pool_rows(spark, sf_dir)))


@query(f"with en as ({_names('documents', 'doc_id', 'd')}) select iri, names from en")
def norm_names(spark, sf_dir):
    return adapters.text_entities(read(spark, sf_dir, "documents"), "doc_id", "d").select("iri", "names")


@query(f"with {_POOL}, {_FEATURES} select query_idx, cand_pos, round_even(j, 9) as j from lex")
def token_jaccard(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_idx", "cand_pos", F.bround("j", 9).alias("j"))


@query(f"with {_POOL}, {_FEATURES} select query_idx, cand_pos, cast(e_label as integer) as e_label, cast(e_name as integer) as e_name from lex")
def exact_match(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_idx", "cand_pos", "e_label", "e_name")


@query(f"with {_POOL}, {_FEATURES} select query_idx, src, cand, cand_pos, lex, cast(rank as integer) as rank from lexr")
def lex_native_rank(spark, sf_dir):
    return _lex_ranked(spark, sf_dir).select("query_idx", "src", "cand", "cand_pos", "lex", "rank")


@query(f"with {_POOL}, {_FEATURES} select query_idx, cast(min(case when cand = gold then rank end) as integer) as gold_rank from lexr group by query_idx")
def gold_rank(spark, sf_dir):
    return rank.gold_ranks(_lex_ranked(spark, sf_dir))


@query(f"with {_POOL}, {_FEATURES}, g as (select query_idx, min(case when cand = gold then rank end) as gold_rank from lexr group by 1), h as (select gold_rank, count(*) as n from g group by 1) {_METRICS} from h")
def ranking_metrics(spark, sf_dir):
    return rank.metrics(rank.gold_ranks(_lex_ranked(spark, sf_dir)))


@query()
def lex_full_part(spark, sf_dir):
    """All four features: every part against the other parts of its hash bucket."""
    part = read(spark, sf_dir, "part")
    base = part.select("p_partkey", text.names(F.col("p_name"), F.array("p_type")).alias("names"))
    base = adapters.with_bucket(base.withColumn("sets", F.transform("names", text.token_set)), "p_partkey", adapters.BUCKET_ROWS)
    return lexical.group_features(base, "p_partkey", "bucket")


_LCS = """
lcs as (
  select a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda j: 0) as prev from names
  union all
  select a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when substr(b, cast(k as bigint), 1) = substr(a, i + 1, 1) then prev[k] + 1 else prev[k + 1] end)))) from lcs where i < length(a))
"""


@query(f"""with recursive p as (select p_partkey, p_brand, p_size, list_filter([{_norm('p_name')}, {_norm('p_type')}], lambda n: n <> '') as l from part),
n as (select p_partkey, p_brand, p_size, case when len(l) = 0 then [''] else {_first_wins('l')} end as names from p),
pr as (select x.p_partkey as query_idx, y.p_partkey as cand, x.names as s, y.names as t from n x join n y on x.p_brand = y.p_brand and x.p_size = y.p_size and x.p_partkey <> y.p_partkey),
names as (select distinct a, b from (select unnest(s) as a, t from pr), lateral (select unnest(t) as b)), {_LCS},
ratio as (select a, b, case when length(a) + length(b) = 0 then 1.0 else 2.0 * list_last(prev) / (length(a) + length(b)) end as r from lcs where i = length(a)),
best as (select query_idx, cand, max(r) as r from (select query_idx, cand, a, t from pr, lateral (select unnest(s) as a)) u, lateral (select unnest(t) as b) v join ratio on ratio.a = u.a and ratio.b = v.b group by 1, 2),
f as (select query_idx, cand, case when s[1] = t[1] then 1 else 0 end as e_label, case when len(list_intersect(s, t)) > 0 then 1 else 0 end as e_name,
             list_max(flatten(list_transform(list_transform(s, lambda n: list_distinct({_tokens('n')})), lambda x: list_transform(list_transform(t, lambda n: list_distinct({_tokens('n')})), lambda y: {_JACCARD})))) as j from pr)
select query_idx, cand, cast(e_label as integer) as e_label, cast(e_name as integer) as e_name, round_even(j, 6) as j, round_even(r, 6) as r, round_even((e_label + e_name + j + r) / 4, 6) as lex_score
from f join best using (query_idx, cand)""")
def lex_full_score(spark, sf_dir):
    """All four features of parts of one brand and size."""
    base = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", text.names(F.col("p_name"), F.array("p_type")).alias("names"))
    return lexical.group_features(base.withColumn("sets", F.transform("names", text.token_set)), "p_partkey", "p_brand", "p_size")


# --- two scores and their blend ---


@query(f"with {_VECTORS}, {_SCALED} select query_idx, cand_pos, margin, round_even(ml, 9) as scaled from scaled")
def minmax_scores(spark, sf_dir):
    s = adapters.vector_scores(spark, sf_dir)
    return s.select("query_idx", "cand_pos", "margin", F.bround(minmax(F.col("margin"), "query_idx"), 9).alias("scaled"))


@query(f"with {_VECTORS}, {_SCALED} select query_idx, cand_pos, round_even(prob, 9) as prob from scaled")
def prob_scores(spark, sf_dir):
    return adapters.vector_scores(spark, sf_dir).select("query_idx", "cand_pos", F.bround(sigmoid(F.col("margin")), 9).alias("prob"))


@query(f"with {_VECTORS}, {_SCALED} select query_idx, cand, round_even(0.5 * ml + 0.5 * mx, 9) as score, cast(row_number() over (partition by query_idx order by round_even(0.5 * ml + 0.5 * mx, 9) desc, cand_pos) as integer) as rank from scaled")
def blend_rank(spark, sf_dir):
    return blend.apply(adapters.vector_scores(spark, sf_dir), "minmax", 0.5).select("query_idx", "cand", "score", "rank")


@query(f"with {_VECTORS}, {_SCALED}, {_GRID} {_METRICS}, mode, alpha from gh group by mode, alpha")
def blend_grid(spark, sf_dir):
    return blend.grid(spark, adapters.vector_scores(spark, sf_dir))


@query(f"with {_VECTORS}, {_SCALED}, {_GRID}, m as ({_METRICS}, mode, alpha from gh group by mode, alpha) select * from m order by mrr desc, mode, alpha limit 1")
def best_blend(spark, sf_dir):
    return blend.choose(blend.grid(spark, adapters.vector_scores(spark, sf_dir)))


@query(f"with {_VECTORS}, {_SCALED}, t as (select query_idx, count(*) filter (where round_even(lex, 1) = top) as n from (select *, max(round_even(lex, 1)) over (partition by query_idx) as top from scaled) group by 1) select count(*) filter (where n > 1) as tied_queries, count(*) as queries from t")
def api_tie_count(spark, sf_dir):
    return rank.tied_tops(adapters.vector_scores(spark, sf_dir).withColumn("lex", F.bround("lex", 1)), "lex")


@query(f"with {_VECTORS}, {_SCALED} select round_even(max(abs(round_even(prob, 4) - prob)), 6) as max_gap from scaled")
def prob_margin_gap(spark, sf_dir):
    s = adapters.vector_scores(spark, sf_dir).withColumn("prob", F.bround(sigmoid(F.col("margin")), 4))
    return validate.probability_gap(s).select(F.bround("max_gap", 6).alias("max_gap"))


@query(f"with {_VECTORS} select count(*) as pairs, count(distinct query_idx) as queries, cast(sum(case when margin < 0 then 1 else 0 end) as bigint) as truncated from scores")
def chunk_throughput(spark, sf_dir):
    return validate.score_summary(adapters.vector_scores(spark, sf_dir).withColumn("truncated", (F.col("margin") < 0).cast("int")))


@query(f"""with {_VECTORS}, {_SCALED},
a as (select query_idx, cand, gold, row_number() over (partition by query_idx order by lex desc, cand_pos) as r1,
             row_number() over (partition by query_idx order by round_even(0.5 * ml + 0.5 * mx, 9) desc, cand_pos) as r2 from scaled),
g as (select query_idx, coalesce(1.0 / min(case when cand = gold then r1 end), 0) as a, coalesce(1.0 / min(case when cand = gold then r2 end), 0) as b from a group by 1)
select count(*) as queries, round_even(avg(a), 6) as mrr_lexical, round_even(avg(b), 6) as mrr_blend, count(*) filter (where b > a) as better, count(*) filter (where b = a) as equal, count(*) filter (where b < a) as worse from g where a <> 1""")
def hard_subset(spark, sf_dir):
    return select.hard_subset(_two_ranks(spark, sf_dir))


def _two_ranks(spark, sf_dir):
    s = _stored(adapters.vector_scores(spark, sf_dir))
    lex = rank.gold_ranks(rank.ranked(s, "lex")).withColumnRenamed("gold_rank", "lex_rank")
    return lex.join(rank.gold_ranks(blend.apply(s, "minmax", 0.5)).withColumnRenamed("gold_rank", "blend_rank"), "query_idx")


@query()
def bootstrap_interval(spark, sf_dir):
    return select.paired_bootstrap(_two_ranks(spark, sf_dir))


@query(f"""with {_VECTORS}, r as (select *, row_number() over (partition by query_idx order by lex desc, cand_pos) as rank from scores),
g as (select query_idx % 3 as pair, query_idx, min(case when cand = gold then rank end) as gold_rank from r group by all), h as (select pair, gold_rank, count(*) as n from g group by all),
m as ({_METRICS}, pair from h group by pair)
select round_even(avg(mrr), 6) as mrr, round_even(avg(hits_at_1), 6) as hits_at_1, round_even(avg(hits_at_5), 6) as hits_at_5, round_even(avg(hits_at_10), 6) as hits_at_10, count(*) as pairs from m""")
def macro_mean(spark, sf_dir):
    rows = rank.ranked(adapters.vector_scores(spark, sf_dir), "lex").withColumn("pair", F.col("query_idx") % 3)
    return rank.macro_mean(rank.metrics(rank.gold_ranks(rows, "pair"), "pair"))


@query(f"with {_VECTORS}, t as (select query_idx, cand, lex, row_number() over (partition by query_idx order by lex desc, cand desc) as rn from scores where gold is null or cand <> gold) select query_idx, cand, lex from t where rn = 1")
def hardest_negative(spark, sf_dir):
    return select.hardest(adapters.vector_scores(spark, sf_dir))


@query(f"""with {_VECTORS}, {_SCALED}, b as (select query_idx, cand_pos, cand, round_even(0.3 * prob + 0.7 * lex, 9) as score from scaled)
select query_idx, cand, score, cast(row_number() over (partition by query_idx order by score desc, cand_pos) as integer) as rank from b""")
def combined_rank(spark, sf_dir):
    """The blend of two stored runs, a lexical and a learned one, joined pair by pair."""
    s = _stored(adapters.vector_scores(spark, sf_dir))
    both = pairs.combined_scores(s.drop("lex", "margin"), s.select("query_idx", "cand_pos", "src", "cand", "lex"), s.select("query_idx", "cand_pos", "src", "cand", "margin"))
    return blend.apply(both, "prob", 0.3).select("query_idx", "cand", "score", "rank")


@query(f"with {_VECTORS}, r as (select *, row_number() over (partition by query_idx order by margin desc, cand_pos) as rank from scores), g as (select query_idx, min(case when cand = gold then rank end) as gold_rank from r group by 1), h as (select gold_rank, count(*) as n from g group by 1) {_METRICS} from h")
def dev_metrics(spark, sf_dir):
    """M08."""
    return rank.dev_metrics(adapters.vector_scores(spark, sf_dir))


@query(f"with {_VECTORS}, r as (select *, row_number() over (partition by query_idx order by lex desc, cand_pos) as rank from scores), g as (select query_idx, min(case when cand = gold then rank end) as gold_rank from r group by 1), h as (select gold_rank, count(*) as n from g group by 1), m as ({_METRICS} from h) select *, true as validated from m")
def evaluate_run(spark, sf_dir):
    """Rankings validated against their pools, then measured."""
    s = _stored(adapters.vector_scores(spark, sf_dir))
    return rank.evaluate(rank.ranking(rank.ranked(s, "lex")), adapters.pools(s))


# --- splits and negatives ---

_DEV = """
src as (select distinct src from pool), ds as (select src, cast('0x' || substr(md5('0|' || src), 1, 13) as bigint) / 4503599627370496.0 as place from src),
dev as (select src from ds where place < 0.1 or place = (select min(place) from ds))
"""


@query(f"with {_POOL}, {_DEV} select src from dev")
def dev_split(spark, sf_dir):
    return sampling.dev_sources(adapters.pool_rows(spark, sf_dir))


@query(f"with {_POOL}, {_DEV}, q as (select distinct query_idx, src from pool where src not in (select src from dev)) select query_idx, src from q order by md5('0|' || query_idx), query_idx limit 400")
def fit_split(spark, sf_dir):
    queries = adapters.pool_rows(spark, sf_dir).select("query_idx", "src").distinct()
    return sampling.fit_sample(queries, sampling.dev_sources(queries))


@query(f"with {_POOL}, {_DEV}, a as (select src from dev), b as (select distinct src from pool where query_idx % 2 = 0) select (select count(*) from (select * from a union select * from b)) as n_union, (select count(*) from (select * from a intersect select * from b)) as n_intersect, (select count(*) from (select * from a except select * from b)) as n_only_a, (select count(*) from (select * from b except select * from a)) as n_only_b, (select count(*) from ((select * from a except select * from b) union all (select * from b except select * from a))) as n_symmetric")
def split_overlap(spark, sf_dir):
    rows = adapters.pool_rows(spark, sf_dir)
    return validate.set_counts(sampling.dev_sources(rows), rows.where("query_idx % 2 = 0").select("src"))


_NEGATIVES = """
neg as (select s.* from scores s where gold is not null and cand <> gold),
hn as (select *, row_number() over (partition by query_idx order by lex desc, cand_pos) as rn from neg),
hard as (select query_idx, src, cand, cand_pos from hn where rn <= 3),
rn as (select *, row_number() over (partition by query_idx order by md5('0|' || query_idx || '|' || cand_pos), cand_pos) as k from hn where rn > 3)
"""


@query(f"with {_VECTORS}, {_NEGATIVES} select query_idx, cand, cand_pos from hard")
def hard_negatives(spark, sf_dir):
    return sampling.hard_negatives(_stored(adapters.vector_scores(spark, sf_dir)).where("gold is not null"), 5).select("query_idx", "cand", "cand_pos")


@query(f"""with {_VECTORS}, {_NEGATIVES}
select query_idx, src, cand, cand_pos, 'positive' as kind, 1 as label from scores where cand = gold union all select query_idx, src, cand, cand_pos, 'hard', 0 from hard
union all select query_idx, src, cand, cand_pos, 'random', 0 from rn where k <= 2""")
def train_pairs(spark, sf_dir):
    return sampling.training_pairs(_stored(adapters.vector_scores(spark, sf_dir)), 5)


# --- entities ---

_PLACES = f"""
ax as (
  select 'http://ex.org/region/' || r_regionkey as iri, '{RDFS}label' as prop, r_name as value, 1 as ord, null as obj from region union all
  select 'http://ex.org/nation/' || n_nationkey, '{RDFS}label', n_name, 1, null from nation union all
  select 'http://ex.org/nation/' || n_nationkey, null, null, 2, 'http://ex.org/region/' || n_regionkey from nation union all
  select 'http://ex.org/supplier/' || s_suppkey, '{RDFS}label', s_name, 1, null from supplier union all
  select 'http://ex.org/supplier/' || s_suppkey, null, null, 2, 'http://ex.org/nation/' || s_nationkey from supplier union all
  select 'http://ex.org/part/' || p_partkey, '{SKOS}prefLabel', p_name, 1, null from part union all
  select 'http://ex.org/part/' || p_partkey, '{SKOS}altLabel', p_type, 2, null from part union all
  select 'http://ex.org/part/' || p_partkey, '{SKOS}altLabel', upper(p_name), 3, null from part union all
  select 'http://ex.org/part/' || p_partkey, '{SKOS}definition', p_brand || '  of ' || p_type, 5, null from part)
"""


def _entities(spark, sf_dir):
    axioms = adapters.place_axioms(spark, sf_dir)
    needed = axioms.select("iri").distinct().union(spark.createDataFrame([("http://ex.org/o#LeftHeart_Valve",)], "iri string"))
    return entities.build_entities(axioms, roles(spark, "DOID"), needed)


_ENTITIES = f"""
{_PLACES},
lab as (select iri, regexp_replace(trim(value), '\\s+', ' ', 'g') as label from ax where prop in ('{RDFS}label', '{SKOS}prefLabel')),
syn as (select a.iri, list(regexp_replace(trim(a.value), '\\s+', ' ', 'g') order by a.ord) as synonyms from ax a join lab l using (iri) where prop = '{SKOS}altLabel' and lower(a.value) <> lower(l.label) group by 1),
def as (select iri, regexp_replace(trim(value), '\\s+', ' ', 'g') as definition from ax where prop = '{SKOS}definition'),
par as (select a.iri, [l.label] as parents from ax a join lab l on l.iri = a.obj),
chd as (select iri, list_slice(list(label order by child), 1, 12) as children from (
          select a.obj as iri, a.iri as child, l.label, row_number() over (partition by a.obj, lower(l.label) order by a.iri) as rn from ax a join lab l on l.iri = a.iri where a.obj is not null) where rn = 1 group by 1),
ids as (select distinct iri from ax),
built as (
  select i.iri, true as found, l.label, false as label_is_fallback, coalesce(s.synonyms, []) as synonyms, []::varchar[] as related_synonyms, coalesce(d.definition, '') as definition,
         coalesce(p.parents, []) as parents, coalesce(c.children, []) as children, false as deprecated, '' as semantic_tag
  from ids i left join lab l using (iri) left join syn s using (iri) left join def d using (iri) left join par p using (iri) left join chd c using (iri)
  union all select 'http://ex.org/o#LeftHeart_Valve', false, 'Left Heart Valve', true, [], [], '', [], [], false, '')
"""


@query(f"with {_ENTITIES} select * from built")
def entity_build(spark, sf_dir):
    return _entities(spark, sf_dir)


@query(f"with {_ENTITIES} select iri, parents from built where len(parents) > 0")
def parent_labels(spark, sf_dir):
    return _entities(spark, sf_dir).where("size(parents) > 0").select("iri", "parents")


@query(f"with {_ENTITIES} select iri, children from built where len(children) > 0")
def children_labels(spark, sf_dir):
    return _entities(spark, sf_dir).where("size(children) > 0").select("iri", "children")


@query(f"""with {_ENTITIES} select count(*) as entities, round_even(100.0::double * count(*) filter (where found) / count(*), 2) as found_in_ontology_pct,
round_even(100.0::double * count(*) filter (where not label_is_fallback) / count(*), 2) as label_pct, round_even(100.0::double * count(*) filter (where len(synonyms) > 0) / count(*), 2) as synonyms_pct,
round_even(100.0::double * count(*) filter (where definition <> '') / count(*), 2) as definition_pct, round_even(100.0::double * count(*) filter (where len(parents) > 0) / count(*), 2) as parent_context_pct,
round_even(100.0::double * count(*) filter (where len(children) > 0) / count(*), 2) as child_context_pct, 0.0::double as deprecated_pct from built""")
def coverage(spark, sf_dir):
    return entities.coverage(_entities(spark, sf_dir))


@query(f"""with {_PLACES}, fr as (select * from ax union all select 'http://ex.org/part/' || p_partkey, '{SKOS}altLabel', p_brand, 4, null from part)
select prop, count(distinct iri) as n, substr(arg_min(value, (iri, ord)), 1, 70) as example, case when prop = '{RDFS}label' then 'label' else '' end as prop_label from fr where prop is not null group by prop""")
def property_census(spark, sf_dir):
    axioms = adapters.place_axioms(spark, sf_dir)
    known = spark.createDataFrame([(RDFS + "label", "label")], "prop string, prop_label string")
    return entities.census(axioms, axioms.select("iri"), known)


@query("select doc_id, lang from documents where lang is null or lang = '' or lower(lang) like 'en%'")
def english_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.is_english(F.col("lang"))).select("doc_id", "lang")


@query("select p_partkey, p_name as term, p_type as tag from part")
def fsn_split(spark, sf_dir):
    named = F.concat("p_name", F.lit("  ("), "p_type", F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", text.fsn_term(named).alias("term"), text.fsn_tag(named).alias("tag"))


@query("""with u as (select page_id, regexp_replace(url, '[/#]+$', '') as u from pages), l as (select page_id, list_last(string_split_regex(u, '[#/]')) as l from u)
select page_id, trim(regexp_replace(replace(l, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g')) as name from l""")
def local_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.local_name(F.col("url")).alias("name"))


@query("select conv_id, arg_min(regexp_replace(trim(text), '\\s+', ' ', 'g'), turn) as definition from conversations where role = 'assistant' group by conv_id")
def first_definition(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(text.collapse(F.min_by("text", "turn")).alias("definition"))


# --- rendering ---


@query("""with t as (select item_id, string_split(text, chr(10)) as ls from benchmark)
select item_id, 'SOURCE' || chr(10) || ls[1] || chr(10) || chr(10) || 'TARGET' || chr(10) || array_to_string(list_slice(ls, 2, len(ls)), ' ') as state,
       cast(len(regexp_extract_all('SOURCE' || chr(10) || ls[1] || chr(10) || chr(10) || 'TARGET' || chr(10) || array_to_string(list_slice(ls, 2, len(ls)), ' '), '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]')) as integer) as n_tokens from t""")
def pair_state(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    state = budget.pair_state(F.concat(F.lit("SOURCE\n"), F.get(lines, F.lit(0))), F.concat(F.lit("TARGET\n"), F.array_join(F.slice(lines, 2, 1 << 30), " ")))
    return read(spark, sf_dir, "benchmark").select("item_id", state.alias("state"), budget.word_count(state).alias("n_tokens"))


@query("""with s as (select l_orderkey, list(l_shipdate::date::varchar order by l_linenumber, l_shipdate) as items from lineitem group by 1),
k as (select l_orderkey, items, list_filter(range(1, len(items) + 1), lambda n: 2 + 5 * n + n - 1 <= 20) as fits from s)
select l_orderkey, case when len(fits) = 0 then '' else 'Dates: ' || array_to_string(list_slice(items, 1, len(fits)), '; ') end as line from k""")
def fit_list(spark, sf_dir):
    dates = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("d")))), lambda x: x["d"])
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(dates.alias("items"))
    return orders.select("l_orderkey", budget.fit_list_native(F.lit("Dates: "), F.col("items"), F.lit(20)).alias("line"))


@query("""with t as (select doc_id, string_split(text, chr(10)) as ls from documents),
n as (select doc_id, ls[1] as label, list_slice(ls, 2, len(ls)) as syn from t),
c as (select doc_id, label, syn, list_transform(range(0, len(syn) + 1), lambda k: array_to_string(list_concat([label], list_slice(syn, 1, k)), '; ')) as texts from n),
f as (select doc_id, texts, list_transform(texts, lambda x: len(regexp_extract_all(x, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]')) > 40) as over from c)
select doc_id, texts[coalesce(list_min(list_filter(range(1, len(texts)), lambda k: over[k + 1])), len(texts))] as option_text from f""")
def option_text(spark, sf_dir):
    e = adapters.text_entities(read(spark, sf_dir, "documents"), "doc_id", "")
    return e.select(F.col("iri").cast("long").alias("doc_id"), budget.option_text(F.col("label"), F.col("synonyms")).alias("option_text"))


@query()
def entity_text(spark, sf_dir):
    e = adapters.text_entities(read(spark, sf_dir, "documents"), "doc_id", "d")
    render = budget.render_entities("SOURCE", "D", budget.concept_budget(512, 60))
    return e.select("iri", render(F.lit("documents"), "label", "synonyms", "definition", F.array().cast("array<string>")).alias("text"))


# --- checks ---


@query(f"with {_VECTORS}, bad as (select query_idx, cand_pos, case when cand_pos % 7 = 3 then 'x' else cand end as cand from scores where cand_pos % 10 <> 9) select count(*) as pairs, count(*) filter (where b.cand is null) as missing, count(*) filter (where b.cand <> s.cand) as mismatched from scores s left join bad b on b.query_idx = s.query_idx and b.cand_pos = s.cand_pos")
def score_join_check(spark, sf_dir):
    s = _stored(adapters.vector_scores(spark, sf_dir))
    stored = s.where("cand_pos % 10 <> 9").withColumn("cand", F.when(F.col("cand_pos") % 7 == 3, "x").otherwise(F.col("cand")))
    return pairs.score_faults(s, stored, "margin")


@query(f"with {_VECTORS} select query_idx, src, list(cand order by lex desc, cand_pos) as ranked from scores group by 1, 2")
def permutation_check(spark, sf_dir):
    s = _stored(adapters.vector_scores(spark, sf_dir))
    return rank.checked_ranking(rank.ranking(rank.ranked(s, "lex")), adapters.pools(s))


@query(f"with {_VECTORS}, q as (select distinct query_idx from scores) select query_idx, p as problem from (select query_idx, case when query_idx % 200 = 0 then ['not a permutation of the pool', 'a candidate is not a full IRI'] else ['a candidate is not a full IRI'] end as ps from q), lateral (select unnest(ps) as p) order by query_idx, case when p like 'not%' then 0 else 1 end limit 20")
def submission_check(spark, sf_dir):
    s = _stored(adapters.vector_scores(spark, sf_dir))
    ranked = rank.ranking(rank.ranked(s, "lex"))
    changed = F.when(F.col("query_idx") % 200 == 0, F.concat(F.slice("ranked", 2, 1000), F.array(F.lit("other")))).otherwise(F.col("ranked"))
    rows = ranked.select("query_idx", F.lit(2).alias("cells"), "src", changed.alias("ranked"))
    pool = adapters.pools(s)
    each = rows.join(pool.select("query_idx", F.size("cands").alias("size")), "query_idx")
    return rank.submission_problems(each.drop("size"), pool, F.size("cands"))


@query("with m as (select distinct l_returnflag as flag, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)) select flag, count(*) as n_missing from m group by 1")
def missing_entities(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("cand"))
    return pairs.missing_entities(used, read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("iri")), "flag")


_SETS = "with a as (select l_partkey as k from lineitem where l_quantity > 40), b as (select l_partkey as k from lineitem where l_discount > 0.07)"


@query(f"{_SETS}, x as (select k, count(*) as n from a group by 1), y as (select k, count(*) as n from b group by 1) select coalesce(x.k, y.k) as k, coalesce(x.n, 0) as n_a, coalesce(y.n, 0) as n_b from x full join y on x.k = y.k where coalesce(x.n, 0) <> coalesce(y.n, 0)")
def multiset_diff(spark, sf_dir):
    return validate.multiset_diff(*_two_sets(spark, sf_dir), "k")


@query(f"{_SETS} select (select count(*) from (select k from a union select k from b)) as n_union, (select count(*) from (select k from a intersect select k from b)) as n_intersect, (select count(*) from (select k from a except select k from b)) as n_only_a, (select count(*) from (select k from b except select k from a)) as n_only_b, (select count(*) from ((select k from a except select k from b) union all (select k from b except select k from a))) as n_symmetric")
def set_ops(spark, sf_dir):
    return validate.set_counts(*_two_sets(spark, sf_dir))


def _two_sets(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.where("l_quantity > 40").select(F.col("l_partkey").alias("k")), lines.where("l_discount > 0.07").select(F.col("l_partkey").alias("k"))


@query("""with c as (select conv_id || ':' || turn as cell, turn, text as member, conv_id from conversations),
n as (select *, lag(turn) over (partition by conv_id order by turn) as before from c), r as (select *, sum(case when before = turn - 1 then 0 else 1 end) over (partition by conv_id order by turn) as run from n)
select first_value(cell) over (partition by conv_id, run order by turn) as head, cast(row_number() over (partition by conv_id, run order by turn) - 1 as integer) as at, member from r where member is not null""")
def list_walk(spark, sf_dir):
    cell = lambda shift: F.concat("conv_id", F.lit(":"), (F.col("turn") + shift).cast("string"))
    cells = read(spark, sf_dir, "conversations").select(cell(0).alias("cell"), F.col("text").alias("member"), cell(1).alias("rest"))
    return validate.walk_lists(cells)


_SEEDS = "with s as (select doc_id % 50 as pair, doc_id % 5 as seed, count(*) as done, round_even(avg(quality), 6) as mrr from labels group by all)"


@query(f"{_SEEDS}, k as (select * from s where done >= 1) select pair, arg_max(seed, (mrr, -seed)) as selected_seed, max(mrr) as dev_mrr from k group by pair")
def seed_select(spark, sf_dir):
    return select.select_seed(_seeds(spark, sf_dir)).select("pair", "selected_seed", "dev_mrr")


def _seeds(spark, sf_dir):
    kept = read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 50).alias("pair"), (F.col("doc_id") % 5).alias("seed"))
    return kept.agg(F.count(F.lit(1)).alias("epochs_done"), F.lit(1).alias("epochs_planned"), F.bround(F.avg("quality"), 6).alias("dev_mrr"))


@query(f"{_SEEDS} select pair as run, arg_max(seed, (mrr, -seed)) as best_epoch, max(mrr) as best_dev_mrr from s group by pair")
def best_epoch(spark, sf_dir):
    return select.best_epoch(_seeds(spark, sf_dir).select(F.col("pair").alias("run"), F.col("seed").alias("epoch"), "dev_mrr"))


@query("select o_custkey as run_dir, o_orderpriority as pair, o_orderstatus as split, o_orderkey as method, c_mktsegment as checkpoint from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def run_summary(spark, sf_dir):
    evals = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_dir"), F.col("o_orderpriority").alias("pair"), F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("method"))
    meta = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("run_dir"), F.col("c_mktsegment").alias("checkpoint"))
    return select.collect_runs(evals, meta)


@query("select cast(count(*) // 100 as bigint) as complete, cast(count(*) // 100 * 100 as bigint) as rows_kept from lineitem")
def resume_blocks(spark, sf_dir):
    return complete_blocks(read(spark, sf_dir, "lineitem"), 100)


@query("with c as (select p_brand, p_type, count(*) as n from part group by all) select p_brand, p_type, n from (select *, row_number() over (partition by p_brand order by n desc, p_type) as rn from c) where rn <= 12")
def type_counts(spark, sf_dir):
    return validate.type_counts(read(spark, sf_dir, "part"), "p_type", "p_brand")


@query("with s as (select role, list_sort(list(length(text))) as l from conversations group by role) select role, cast(l[cast(floor(0.5 * len(l)) as integer) + 1] as integer) as median, cast(l[least(cast(floor(0.95 * len(l)) as integer), len(l) - 1) + 1] as integer) as p95, cast(list_max(l) as integer) as most from s")
def length_quantiles(spark, sf_dir):
    """State lengths by nearest rank, from running sums over the counts of distinct lengths."""
    sizes = read(spark, sf_dir, "conversations").select("role", F.length("text").alias("n"))
    return rank_quantiles(sizes, "n", {"median": 0.5, "p95": 0.95}, "role").withColumnRenamed("max", "most")
