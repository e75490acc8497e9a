"""Pool, score and ranking files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import fixed, parse_list, print_list
from tessera.schema import INTERNAL_SPLITS, SPLITS

_TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}
#: lines that are one task's share where they are dealt by key
PART_LINES = 200_000


def pool_path(root: str, internal_root: str, pair: str, split: str) -> str:
    """Where the pool of a split lies."""
    if split not in (*SPLITS, *INTERNAL_SPLITS):
        raise ValueError(f"no split {split!r}")
    return f"{internal_root if split in INTERNAL_SPLITS else root}/{pair}/local.{split}.cands.tsv"


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Rows of one text scan with their order as ``ord`` (dense from 0, file after file).

    Order is (file, place of the block, order inside it); the running number
    adds the sizes of the blocks before, so only one row per block is gathered
    and sent to the lines, which stay where they are.
    """
    block = ["_file", "_block"]
    placed = lines.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_in": F.monotonically_increasing_id()})
    sizes = placed.groupBy(*block).agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select(*block, "_first", "_before")), block).withColumn("ord", F.col("_before") + F.col("_in") - F.col("_first")).drop(*block, "_in", "_first", "_before")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Queries in file order; an empty or absent gold is null."""
    raw = with_line_numbers(spark.read.text(path).select("value", "_metadata"))
    header = spark.read.text(path).first()
    names = header[0].split("\t") if header else ["SrcEntity", "TgtCandidates"]
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = F.from_csv(F.col("value"), schema, _TSV | {"header": "false"})
    rows = raw.where("ord > 0").where("value <> ''").select((F.col("ord") - 1).alias("query_idx"), cells.alias("c"))
    gold = F.nullif(F.col("c.TgtEntity"), F.lit("")) if "TgtEntity" in names else F.lit(None).cast("string")
    return rows.select("query_idx", F.col("c.SrcEntity").alias("src"), gold.alias("gold"), parse_list(F.col("c.TgtCandidates")).alias("cands"))


def write_pool(pool: DataFrame, path: str) -> None:
    """Queries as a pool file of their own, in order."""
    rows = pool.orderBy("query_idx").select(F.col("src").alias("SrcEntity"), F.coalesce("gold", F.lit("")).alias("TgtEntity"), print_list(F.col("cands")).alias("TgtCandidates"))
    rows.coalesce(1).write.mode("overwrite").options(**_TSV, emptyValue="").csv(path)


def _positions_repeat(rows: DataFrame) -> tuple[int, bool]:
    """How many rows there are, and whether a query may have a position twice.

    A query has a bit for each of the positions 0 to 127, more than a pool has;
    a row of another position has none, so its query counts as one that repeats.
    """
    bits = [F.expr(f"bit_count(coalesce(bit_or(shiftleft(1L, cast(cand_pos & 63 as int))) filter (where cand_pos between {k} and {k + 63}), 0L))") for k in (0, 64)]
    found = rows.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"), (bits[0] + bits[1]).alias("own"))
    n, repeat = found.agg(F.sum("n"), F.max(F.col("n") > F.col("own"))).first()
    return n or 0, bool(repeat)


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scores by (query, position); of repeated keys the last row of the file stays.

    Where no key repeats, which a row for each query and block tells, lines stay
    where they are; else they are dealt by key, in partitions that grow with the file.
    """
    raw = with_line_numbers(spark.read.text(path).select("value", "_metadata")).where("ord > 0")
    rows = raw.select("ord", F.from_csv(F.col("value"), schema, {"sep": "\t"}).alias("r")).select("ord", "r.*").where("query_idx is not null")  # no header of a further file
    key, names = ["query_idx", "cand_pos"], rows.columns[1:]
    n, repeat = _positions_repeat(rows)
    if not repeat:
        return rows.select(*names)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_LINES))
    # dealt as they are: keys hardly repeat, so sorting and grouping lines ahead of that would save nothing
    last = rows.repartition(parts, *key).groupBy(*key).agg(F.max_by(F.struct(*(c for c in names if c not in key)), "ord").alias("r"))
    return last.select(*(c if c in key else f"r.{c}" for c in names))


def write_scores(scores: DataFrame, path: str, places: dict[str, int], in_order: bool = False) -> None:
    """Scores in pool order with fixed decimals; ``in_order``: they stand in that order, partition after partition."""
    placed = scores if in_order else scores.orderBy("query_idx", "cand_pos")
    rows = placed.select(*(fixed(F.col(c), places[c]).alias(c) if c in places else c for c in scores.columns))
    rows.write.mode("overwrite").options(**_TSV).csv(path)


def write_ranking(rankings: DataFrame, path: str) -> None:
    """A checked ranking (``operators.rank.checked_ranking``) as one ordered file."""
    rows = rankings.orderBy("query_idx").select(F.col("src").alias("SrcEntity"), print_list(F.col("ranked")).alias("TgtCandidates"))
    rows.coalesce(1).write.mode("overwrite").options(**_TSV).csv(path)


def write_grid(measured: DataFrame, path: str) -> None:
    """The blend grid, four decimals."""
    rows = measured.orderBy("mode", "alpha").select("mode", "alpha", *(fixed(F.col(c), 4).alias(n) for c, n in (("mrr", "MRR"), ("hits_at_1", "Hits@1"), ("hits_at_5", "Hits@5"), ("hits_at_10", "Hits@10"))))
    rows.coalesce(1).write.mode("overwrite").options(**_TSV).csv(path)
