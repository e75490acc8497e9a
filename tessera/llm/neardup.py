"""Near-duplicate documents: DartMinHash signatures, banded join, exact check, components.

A document is the multiset of its five-word shingles, a shingle's weight its
number of occurrences. Weight and rank span a plane over each shingle; it is
cut into regions, weight levels ``[2^v - 1, 2^(v+1) - 1)`` by rank levels
(``EDGES``, then doubling), and a region holds a Poisson number of hashed
darts of its area. A document of total weight ``W`` looks only at regions
under its shingles' weights and below the rank ``k (ln k + 2) / W``: about
``k (ln k + 2)`` darts and a few regions a distinct shingle, whatever its
weight. A document with an empty coordinate doubles its bound, which never
changes what earlier darts decided. The earliest dart of each of ``k``
coordinates is the signature: two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity.

32 bands of 6 coordinates find a pair at similarity 0.8 with probability
0.9999. Equal texts are one node. In each bucket all members are checked
against one hashed pivot (a different one in every band), by shingles counted
exactly. Where a bucket of up to ``BLOCK`` documents then still holds several
components, its pairs across components are compared inside one Arrow group
(or several, by bytes). Documents of larger such buckets meet again by rare
shingles: two at the threshold share one of the ``n - ceil(t n) + 1`` rarest
shingles of each (prefix filter), so a passage that very many documents hold
brings nobody together, and the work doesn't grow with the square of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._store import materialise, release
from tessera.llm._words import NON_SPACE, U64, mix, shingles, slices, words
from tessera.llm._worker import enter, task
from tessera.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: A block of a group: so many rows and so many bytes of shingles, about.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Salts that spread the rows of one bucket over tasks where buckets are joined.
SPREAD = 16
#: A slice of a batch; a row counts its text and what its darts take.
SLICE_BYTES, ROW_BYTES = 1 << 20, 4096
#: Rank levels below 1: coarse where hardly any document stops.
EDGES = (0.0, 2.0**-12, 2.0**-6, 2.0**-3, 2.0**-2, 2.0**-1, 1.0)
_GOLD = U64(0x9E3779B97F4A7C15)
_WRAP = 0xFFFFFFFFFFFFFFFF
_POISSON: dict[float, np.ndarray] = {}


def _grouped(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and rows sorted by both, and where a new (row, shingle) begins."""
    order = np.argsort(grams)
    if len(row) and row.max() < 1 << 16:
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams, row, np.flatnonzero(new)


def weighted(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their number of occurrences and their row."""
    grams, row, starts = _grouped(grams, row)
    return grams[starts], np.diff(np.append(starts, len(grams))), row[starts]


def occurrences(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of each row as a set: a hash of (shingle, how manieth occurrence), and its row; sorted by row."""
    grams, row, starts = _grouped(grams, row)
    nth = np.arange(len(grams)) - np.repeat(starts, np.diff(np.append(starts, len(grams))))
    again = nth > 0
    out = grams.copy()
    out[again] = mix(grams[again] + nth[again].astype(U64) * _GOLD)
    return out, row


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Distribution function of a Poisson number."""
    have = _POISSON.get(mean)
    if have is None:
        n = np.arange(int(mean + 12 * math.sqrt(mean) + 12))
        have = _POISSON[mean] = np.cumsum(np.exp(n * math.log(mean) - mean - np.cumsum(np.log(np.maximum(n, 1)))))
    return have


def _darts(mean: float, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the darts in regions of a mean number of darts, from the regions' hashes, and the region of each."""
    upto = _poisson(mean)
    some = np.flatnonzero(h >= U64(min(int(upto[0] * 2.0**64), _WRAP)))  # regions with a dart
    first = h[some]
    n = np.maximum(np.searchsorted(upto, _unit(first), side="right"), 1)
    at = np.repeat(np.arange(len(some)), n)
    nth = np.arange(1, len(at) + 1) - (np.cumsum(n) - n)[at]
    return mix(first[at] + nth.astype(U64) * _GOLD), some[at]


def _rank_level(rho: int) -> tuple[float, float]:
    """Lower and upper edge of a rank level."""
    last = len(EDGES) - 1
    return (EDGES[rho], EDGES[rho + 1]) if rho < last else (2.0 ** (rho - last), 2.0 ** (rho - last + 1))


def dart_signatures(grams: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k earliest darts (rank in the high, identity in the low 32 bits) of weighted shingles; rows without any keep the maximum."""
    most = np.iinfo(np.uint64).max
    out = np.full(rows * k, most, U64)
    total = np.bincount(row, weights=weight, minlength=rows)
    bound = k * (math.log(k) + 2) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        use = todo[row]
        seeds, weights, of = grams[use], weight[use], row[use]
        for nu in range(int(weights.max()).bit_length()):
            low_w = (1 << nu) - 1
            heavy = np.flatnonzero(weights > low_w) if nu else slice(None)
            seed, w, o = seeds[heavy], weights[heavy], of[heavy]
            limit = bound[o]
            rho = 0
            while len(seed):
                low, high = _rank_level(rho)
                dart, at = _darts((high - low) * 2.0**nu, mix(seed + U64((nu * 0x632BE59BD9B4E019 + (rho + 1) * int(_GOLD)) & _WRAP)))
                rank = low + (high - low) * _unit(dart << U64(24))
                live = rank < limit[at]
                if nu:
                    live &= low_w + 2.0**nu * ((dart >> U64(40)).astype(np.float64) * 2.0**-24) < w[at]
                at, rank, dart = at[live], rank[live], mix(dart[live])
                slot = o[at] * k + (dart >> U64(33)).astype(np.int64) % k
                np.minimum.at(out, slot, (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (dart & U64(0xFFFFFFFF)))
                rho += 1
                further = limit > high
                if not further.all():
                    seed, w, o, limit = seed[further], w[further], o[further], limit[further]
        todo = todo & (out.reshape(rows, k) == most).any(1)
        bound = np.where(todo, bound * 2, bound)
    return out.reshape(rows, k)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.repeat(np.arange(1, bands + 1, dtype=U64)[None, :] * _GOLD, len(signatures), 0)
    for r in range(rows):
        h = mix(h ^ parts[:, :, r]) + U64(r)
    return h.view(np.int64)


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's word sequence."""
    start = np.cumsum(counts) - counts
    at = (np.arange(len(hashes)) - np.repeat(start, counts)).astype(U64)
    out = []
    for salt in (1, 2):
        x = mix(mix(hashes + U64(salt)) + at * U64(0xD1B54A32D192ED03))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(x)])
        out.append(mix(sums[start + counts] - sums[start] + counts.astype(U64) * _GOLD + U64(salt)).view(np.int64))
    return out[0], out[1]


_FEATURES = T.StructType([T.StructField("id", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_ELEMENTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("elements", T.BinaryType())])


def features(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """One narrow pass over ``docs(id, text)``: text identity, number of shingles and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, ROW_BYTES):
                hashes, counts = words(part.column("text"), NON_SPACE)
                f1, f2 = fingerprints(hashes, counts)
                grams, weight, row = weighted(*shingles(hashes, counts, size))
                n = np.bincount(row, weights=weight, minlength=part.num_rows).astype(np.int64)
                keys = band_hashes(dart_signatures(grams, weight, row, part.num_rows, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(f1), pa.array(f2), pa.array(n), lists], names=[f.name for f in _FEATURES])

    return docs.mapInArrow(task("neardup", run), _FEATURES)


def element_sets(docs: DataFrame, size: int) -> DataFrame:
    """The sorted 64-bit elements of the multiset of shingles of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                elements, row = occurrences(*shingles(*words(part.column("text"), NON_SPACE), size))
                elements = elements[np.lexsort((elements, row))]
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                blob = [elements[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(ends)), pa.array(blob, pa.binary())], names=[f.name for f in _ELEMENTS])

    return docs.mapInArrow(task("neardup", run), _ELEMENTS)


def verify(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs(u, v)``, those whose multisets of shingles reach the threshold, counted exactly."""
    a = elements.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("elements").alias("eu"))
    b = elements.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("elements").alias("ev"))
    joined = pairs.join(a, "u").join(b, "v").where(F.least("nu", "nv") >= F.lit(threshold) * F.greatest("nu", "nv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column("u"), batch.column("v")
            keep = []
            for eu, ev in zip(batch.column("eu"), batch.column("ev"), strict=True):
                z = np.concatenate([np.frombuffer(eu.as_buffer(), U64), np.frombuffer(ev.as_buffer(), U64)])
                z.sort(kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                keep.append(len(z) > 0 and both >= threshold * (len(z) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(mask), vs.filter(mask)], names=["u", "v"])

    return joined.select("u", "v", "eu", "ev").mapInArrow(task("neardup", run), "u long, v long").distinct()


def similar_pairs(elements: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i of left, j of right)`` whose element sets reach the threshold; all intersections exactly, by sparse columns."""
    sizes = np.array([len(e) for e in elements], np.int64)
    row = np.repeat(np.arange(len(elements)), sizes)
    _, column, held = np.unique(np.concatenate([*elements, np.zeros(0, U64)]), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(elements), width), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        both += dense[left] @ dense[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return np.nonzero((union > 0) & (both >= threshold * union - 1e-6))


def block_links(placed: DataFrame, threshold: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links between different components of ``placed(bucket, size, bytes, id, component, elements)`` inside each bucket.

    A bucket is dealt into hashed blocks bounded by rows and bytes; a pair of
    blocks is one group. Inside, every pair across components is compared
    exactly, and only links that join two components are returned.
    """
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "elements")

    def run(group: pa.Table) -> pa.Table:
        enter("neardup")
        ids = group.column("id").to_numpy()
        component = group.column("component").to_numpy()
        u: list[int] = []
        v: list[int] = []
        name = np.unique(component, return_inverse=True)[1]
        if len(ids) and name.max() > 0:
            held = [np.frombuffer(x.as_buffer(), U64) for x in group.column("elements")]
            parts = np.unique(group.column("own").to_numpy(), return_inverse=True)[1]
            left, right = np.flatnonzero(parts == 0), np.flatnonzero(parts == parts.max(initial=0))
            a, b = similar_pairs(held, left, right, threshold)
            a, b = left[a], right[b]
            across = name[a] != name[b]
            root = list(range(int(name.max()) + 1))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(a[across].tolist(), b[across].tolist(), strict=True):
                p, q = find(int(name[x])), find(int(name[y]))
                if p != q:
                    root[p] = q
                    u.append(max(ids[x], ids[y]))
                    v.append(min(ids[x], ids[y]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "u long, v long").distinct()


def _rows_of(loose: DataFrame) -> DataFrame:
    """``(element, id, component, n)`` of ``loose(id, component, elements)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c, blob in zip(batch.column("id"), batch.column("component"), batch.column("elements"), strict=True):
                held = np.frombuffer(blob.as_buffer(), np.int64)
                for at in range(0, len(held), 1 << 16):
                    part = held[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.full(len(part), x)) for x in (i.as_py(), c.as_py(), len(held)))], names=["element", "id", "component", "n"])

    return loose.select("id", "component", "elements").mapInArrow(task("neardup", run), "element long, id long, component long, n long")


def rare_links(spark: SparkSession, loose: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links between different components of ``loose(id, component, n, elements)``, found by rare elements.

    A prefix is the ``n - ceil(t n) + 1`` rarest elements of a document, by
    number of holders among ``loose``. Documents of different components that
    share one, and whose sizes allow the threshold, are compared; an element
    with more than ``block`` holders is compared in blocks.
    """
    rows = materialise(spark, _rows_of(loose), "rows")
    holders = rows.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "element"))
    prefix = rows.join(holders, "element").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    prefix = prefix.where("df > 1").select("element", "id", "component", "n")
    signature = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    groups = prefix.groupBy("element").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n") * 8).alias("bytes"), F.min("component").alias("lo"), F.max("component").alias("hi"), *signature)
    groups = groups.where("size > 1 and lo < hi").groupBy("size", "bytes", "s1", "s2").agg(F.min("element").alias("element"))
    held = materialise(spark, prefix.join(groups.select("element", "size", "bytes"), "element"), "held")
    release(rows)
    few = held.where(F.col("size") <= block)
    other = few.select("element", F.col("id").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"))
    pairs = few.join(other, "element").where("id > v and component <> cv").where(F.least("n", "nv") >= F.lit(threshold) * F.greatest("n", "nv"))
    close = verify(pairs.select(F.col("id").alias("u"), "v").distinct(), loose, threshold)
    many = held.where(F.col("size") > block).select(F.col("element").alias("bucket"), "size", "bytes", "id")
    found = materialise(spark, close.union(block_links(many.join(loose, "id"), threshold)), "rare")
    release(held)
    return found


def _salted(frame: DataFrame, key: str = "id") -> DataFrame:
    return frame.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SPREAD)))


def _every_salt(frame: DataFrame) -> DataFrame:
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))


def classes(
    spark: SparkSession, docs: DataFrame, unit: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(unit, class_id)`` for every row: the smallest id among all documents linked to it, its own id if none.

    Words are lower-cased runs of non-space characters; a text of fewer words
    than a shingle is one shingle; texts without words are equal to each other
    and to nothing else. A null text is in a class of its own, a null id has
    the null class; rows that share an id are one document. Repeated rows stay
    repeated, an empty table gives an empty result, other columns are ignored,
    whatever their names. Ids are whole numbers and come back as they are
    (``class_id`` is a long); other kinds, and a ``unit`` called ``class_id``,
    are errors. A very long text is taken whole, in one task's memory.
    """
    if not isinstance(docs.schema[unit].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) or unit == "class_id":
        raise ValueError("unit must be a column of whole numbers that is not called class_id")
    base = docs.select(F.col(unit).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    found = materialise(spark, features(base, bands, rows, size), "features")
    reps = found.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    copies = materialise(spark, found.select("id", "f1", "f2").distinct().join(reps, ["f1", "f2"]).select("id", "rep").distinct(), "copies")
    nodes = found.where("n > 0").join(copies.where("id = rep").select("id").distinct(), "id", "left_semi")
    member = _salted(nodes.select("id", "n", F.explode("bands").alias("bucket")))
    pivots = member.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id"))["id"].alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    member = materialise(spark, member.join(_every_salt(pivots), ["bucket", "salt"]), "members")
    release(found)
    stars = materialise(spark, member.where("id <> pivot").select(F.greatest("id", "pivot").alias("u"), F.least("id", "pivot").alias("v")).distinct(), "stars")
    near = stars.select(F.col("u").alias("id")).union(stars.select(F.col("v").alias("id"))).distinct()
    # candidates are a share of all documents: never shipped whole to every executor, at any size
    elements = materialise(spark, element_sets(base.join(near.hint("merge"), "id", "left_semi"), size), "elements")
    links = materialise(spark, verify(stars, elements, threshold), "links")
    release(stars)
    first = components(spark, links)
    placed = member.where("size > 2").drop("pivot").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    signature = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    mixed = placed.groupBy("bucket", "size").agg(F.sum(F.col("n") * 8).alias("bytes"), F.min("component").alias("lo"), F.max("component").alias("hi"), *signature).where("lo < hi")
    # of buckets with the same documents one stands for all
    mixed = materialise(spark, mixed.groupBy("size", "bytes", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "bytes"), "mixed")
    held = materialise(spark, placed.join(_every_salt(mixed), ["bucket", "salt"]).select("bucket", "size", "bytes", "id", "component"), "held")
    release(member, first, mixed)
    more = materialise(spark, block_links(held.where(F.col("size") <= BLOCK).join(elements.select("id", "elements"), "id"), threshold), "more")
    large = held.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        loose = materialise(spark, large.select("id", "component").distinct().join(elements, "id"), "loose")
        more = more.union(rare_links(spark, loose, threshold))
    release(held, elements)
    # an id whose rows hold several texts links those texts
    several = copies.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("hi")).where("v < hi").select("id", "v")
    same = copies.join(several, "id").where("rep <> v").select(F.col("rep").alias("u"), "v")
    whole = components(spark, links.union(more).union(same))
    release(links)
    text_of = copies.groupBy("id").agg(F.min("rep").alias("node")).join(whole, "node", "left").select(F.col("id").alias("_id"), F.coalesce("component", "node").alias("_class"))
    every = docs.select(F.col(unit).alias("_unit"))
    return every.join(text_of, F.col("_unit") == F.col("_id"), "left").select(F.col("_unit").alias(unit), F.coalesce("_class", F.col("_unit")).cast("long").alias("class_id"))
