"""Line deduplication across documents, as keep bitmaps.

Line hashes are written once, range-partitioned by (hash, document) and sorted
within partitions by hash, document and position, so a line that very many
documents hold spreads over as many partitions as it fills. Each sorted run
streams into one row a (hash, document) with its first position, and these
into one partial row a hash and partition, which meet by hash: how many
documents hold it, and which keeps it. Only hashes over the limit go on, as
positions that a document loses; they come back packed, a bit a line, and a
text is touched once, where the caller wants it rebuilt. All work is linear in
lines.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import materialise, release

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
#: Salts that spread the rows of one hash.
SPREAD = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NIBBLES, _LETTERS = "0123456789ABCDEF", "abcdefghijklmnop"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _text(column: str) -> Column:
    return F.coalesce(_named(column).cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, unit: str, text: str, min_length: int) -> DataFrame:
    """``(_unit, _t, position, h1, h2)``: lines long enough to count, by 128 bits of their keys; ``_t`` tells apart texts of one id."""
    rows = docs.select(_named(unit).alias("_unit"), _text(text).alias("_text")).where("_unit is not null")
    rows = rows.select("_unit", F.xxhash64("_text").alias("_t"), "_text")  # before the lines: once a text
    rows = rows.select("_unit", "_t", F.posexplode(_lines(F.col("_text"))).alias("position", "line"))
    rows = rows.where(F.length("line") >= min_length).select("_unit", "_t", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return rows.select("_unit", "_t", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key", F.length("key")).alias("h2"))


def lost_lines(docs: DataFrame, unit: str, text: str, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, repeats: bool = False) -> DataFrame:
    """``(_unit, _t, _lost)``: the positions, ascending, that each text loses, for those that lose any."""
    spark = docs.sparkSession
    # written, so that finding the ranges reads hashes and not texts
    lines = materialise(spark, line_table(docs, unit, text, min_length), "lines")
    order = ["h1", "h2", "_unit"]
    runs = lines.select(*order, "position").repartitionByRange(*order).sortWithinPartitions(*order, "position").groupBy(*order).agg(F.min("position").alias("position"))
    over = runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("held_by"), F.max("_unit").alias("_keep"), F.max_by("position", "_unit").alias("_first"))
    over = over.where(F.col("held_by") >= min_documents).drop("held_by")
    again = (F.col("_unit") == F.col("_keep")) & (F.col("position") > F.col("_first"))
    gone = (F.col("_unit") != F.col("_keep")) | (again if repeats else F.lit(False))
    # rows of one hash meet what is known of it in several tasks
    salt = F.pmod(F.xxhash64("_unit"), F.lit(SPREAD))
    over = over.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    lost = lines.withColumn("_salt", salt).join(over, ["h1", "h2", "_salt"]).where(gone).groupBy("_unit", "_t").agg(F.array_sort(F.collect_set("position")).alias("_lost"))
    found = materialise(spark, lost, "lost")
    release(lines)
    return found


def _packed(lost: Column, n: Column) -> Column:
    """``n`` bits, eight to a byte, first line in the highest bit of the first byte; those at ``lost`` (ascending) are 0."""
    runs = F.zip_with(lost, F.concat(F.array(F.lit(-1)), lost), lambda p, q: F.concat(F.repeat(F.lit("1"), F.coalesce(p, n.cast("int")) - q - 1), F.when(p.isNotNull(), "0").otherwise("")))
    padded = F.rpad(F.array_join(runs, ""), (F.ceil(n / 8) * 8).cast("int"), F.lit("0"))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(padded, F.lit("[01]{4}"), F.lit(0)), lambda x: F.conv(x, 2, 16)), ""))


def kept_text(text: str, bitmap: str) -> Column:
    """The lines whose bit is set, joined by line ends; without a bitmap the whole text (null reads as empty)."""
    bits = F.translate(F.hex(_named(bitmap)), _NIBBLES, _LETTERS)
    for k, letter in enumerate(_LETTERS):
        bits = F.replace(bits, F.lit(letter), F.lit(f"{k:04b}"))
    kept = F.zip_with(_lines(_text(text)), F.split(bits, ""), lambda line, bit: F.when(bit == "1", line))
    return F.when(_named(bitmap).isNull(), _text(text)).otherwise(F.array_join(kept, "\n"))


def keep_bitmaps(
    docs: DataFrame, unit: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, with_input: bool = False, repeats: bool = False
) -> DataFrame:
    """``unit``, n_lines, n_dropped and keep_bitmap (null: every line stays) for each row of ``docs``.

    A key of at least ``min_length`` code points that ``min_documents``
    documents hold loses all its lines except those of the largest id; with
    ``repeats`` only the first of these stays. Null and empty texts are one
    empty line. A document is an id; rows that share one count once and keep
    or lose a key together. Rows of null id count for no key and lose nothing;
    repeated rows give repeated results, an empty table an empty one. A very
    long text is one row of lines, taken in time linear in them. With
    ``with_input`` the input's columns come along (those called as the three
    results are replaced, other names don't matter), else only ``unit``.
    """
    lost = lost_lines(docs, unit, text, min_length, min_documents, repeats)
    added = ("n_lines", "n_dropped", "keep_bitmap")
    carried = [c for c in docs.columns if c not in added] if with_input else [unit]
    rows = docs.select(F.struct(*map(_named, carried)).alias("_row"), _named(unit).alias("_unit"), F.xxhash64(_text(text)).alias("_t"), F.size(_lines(_text(text))).cast("long").alias("_n"))
    joined = rows.join(lost, ["_unit", "_t"], "left")
    return joined.select(
        *(F.col("_row").getField(c).alias(c) for c in carried),
        F.col("_n").alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNotNull(), _packed(F.col("_lost"), F.col("_n"))).alias("keep_bitmap"),
    )
