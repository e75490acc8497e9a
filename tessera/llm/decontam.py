"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of word hashes (lower-cased runs of letters and digits;
letters of scripts written without blanks are words of their own).
An item of ``m`` words is found in a document if some stretch of the document
is within ``floor(rate * m)`` word edits of it.

1. CGK. A random walk reads a window word by word: at each step it emits the
   current word and moves on or not, as a random bit of (repetition, step,
   word) says. Two windows with few edits between them soon walk in step
   again, so small edit distance becomes small Hamming distance.
2. LSH. Each repetition has its own walk and samples some of the emitted
   words; their hash is the key of a bucket. Document windows start at every
   ``stride``-th word. A window that starts inside a passage meets the item at
   the offset where it starts, so an item is entered by its windows from every
   offset: whichever stretch of a passage has no edit near its start brings a
   pair into one bucket, and a long item has many such chances. Samples lie in
   the first ``steps`` steps, so windows of all items share one walk.
3. Pairs of a bucket are aligned to item-sized windows. A pair is dropped if
   the window lacks more of the item's words than the bound allows (exact:
   every missing word is an edit), else the edit distance of the item to the
   best stretch around it is computed exactly.

Buckets are the only source of candidates. Short items have short walks
(``WALKS``). Pairs are expanded a bounded number at a time, so a phrase that
very many items share costs time, not memory.

The benchmark is read in blocks bounded by bytes of text, one pass over the
documents for each; every pass but the last is written to the shared folder
before the next block is shipped, so executors hold one block, of checked
size, however many items there are. A benchmark of one block takes one narrow
pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._store import drop, scratch_path
from tessera.llm._words import ALNUM, U64, SortedHash, buffers, mix, slices, text_array, words
from tessera.llm._worker import task

EDIT_RATE = 0.2
#: Least words of an item, then the walk of its windows: repetitions, steps and sampled steps; the last that an item reaches holds.
WALKS = ((1, 1, 1, 1), (3, 2, 3, 3), (5, 4, 4, 3), (12, 4, 12, 5))
STRIDE = 1
BLOCK_BYTES = 8 << 20
#: Bytes that a compiled block may take for each byte of its texts.
COMPILED_FACTOR = 64
SLICE_BYTES = 1 << 20
#: Pairs of a bucket that are expanded at once.
PAIRS = 1 << 18
_GOLD = 0x9E3779B97F4A7C15
_PLAIN = (
    (r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""),
    (r"[^\x00-\x7F\p{L}\p{M}\p{N}]", " "),
    (r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 "),
)
_END = U64(0x5851F42D4C957F2D)


def plain(column: pa.Array) -> pa.Array:
    """The texts with marks and blanks beyond ASCII as spaces, invisible joiners dropped, and letters of scripts without blanks apart."""
    column = text_array(column)
    data, _ = buffers(column)
    if not len(data) or data.max() < 128:
        return column
    for pattern, to in _PLAIN:
        column = pc.replace_substring_regex(column, pattern, to)
    return column


def sampled_steps(steps: int, samples: int, repetition: int) -> list[int]:
    """The sampled steps of a repetition: the first, where every walk is in place, and others spread by hash."""
    drawn = mix(np.arange(1, steps, dtype=U64) * _END + U64((repetition + 1) * 0x9E3779B9))
    return sorted([0, *(np.argsort(drawn)[: samples - 1] + 1).tolist()])


def walks(hashes: np.ndarray, start: np.ndarray, steps: int, samples: int, repetition: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the windows from ``start`` on, and the place of the last word that each key has sampled."""
    chosen = sampled_steps(steps, samples, repetition)
    # a word's random bits of all steps of this repetition; a window at the end reads on into nothing
    bits = mix(np.append(hashes, np.zeros(steps, U64)) + U64(((repetition + 1) * int(_END)) & 0xFFFFFFFFFFFFFFFF))
    padded = np.append(hashes, np.full(steps, _END))
    at = start.copy()
    key = np.full(len(start), (steps * 0x632BE59BD9B4E019 + repetition * _GOLD) & 0xFFFFFFFFFFFFFFFF, U64)
    for step in range(chosen[-1] + 1):
        if step in chosen:
            key ^= padded[at]
            key *= U64(0xFF51AFD7ED558CCD)
            key ^= key >> U64(32)
        if step < chosen[-1]:
            at += ((bits >> U64(step)).astype(np.uint8) & 1)[at]
    return mix(key), at


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> int:
    """Least number of word edits from ``item`` to any stretch of ``stretch``."""
    m = len(item)
    if m <= len(stretch) and any(np.array_equal(stretch[k : k + m], item) for k in np.flatnonzero(stretch[: len(stretch) - m + 1] == item[0])):
        return 0
    row = np.zeros(len(stretch) + 1, np.int64)  # an empty item fits anywhere
    ramp = np.arange(len(stretch) + 1)
    for i in range(m):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (stretch != item[i]))
        best[0] = i + 1
        row = np.minimum.accumulate(best - ramp) + ramp
    return int(row.min())


class _Buckets:
    """The windows of the items of one walk, by bucket key."""

    def __init__(self, walk: tuple[int, int, int, int], items: np.ndarray, whole: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        _, self.repetitions, self.steps, self.samples = walk
        owner = np.repeat(items, sizes[items])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[items]) - sizes[items], sizes[items])
        self.tables = []
        for r in range(self.repetitions):
            keys, last = walks(whole, first[owner] + offset, self.steps, self.samples, r)
            inside = last < first[owner] + sizes[owner]  # the samples are the item's own words
            keys, of, off = keys[inside], owner[inside], offset[inside]
            order = np.argsort(keys, kind="stable")
            distinct, begin = np.unique(keys[order], return_index=True)
            table = SortedHash(distinct)
            spans = np.stack([begin, np.append(begin[1:], len(order))], 1)[table.order]
            self.tables.append((table, spans, of[order].astype(np.int32), off[order].astype(np.int32)))

    @property
    def nbytes(self) -> int:
        return sum(t.hashes.nbytes + t.start.nbytes + t.order.nbytes + s.nbytes + o.nbytes + f.nbytes for t, s, o, f in self.tables)

    def pairs(self, hashes: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document place, item and item offset of windows in one bucket; some are given more than once."""
        for r, (table, spans, item, offset) in enumerate(self.tables):
            found = table.find(walks(hashes, start, self.steps, self.samples, r)[0])
            hit = np.flatnonzero(found >= 0)
            span = spans[found[hit]]
            n = span[:, 1] - span[:, 0]
            upto = np.cumsum(n)
            for low in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                nth = np.arange(low, min(low + PAIRS, int(upto[-1])))
                own = np.searchsorted(upto, nth, side="right")
                entry = span[own, 0] + nth - (upto[own] - n[own])
                yield start[hit[own]], item[entry].astype(np.int64), offset[entry].astype(np.int64)


class Items:
    """A bounded block of benchmark items, compiled."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = EDIT_RATE, walk_of: tuple[tuple[int, int, int, int], ...] = WALKS, stride: int = STRIDE):
        hashes, counts = words(plain(pa.array(texts, pa.string())), ALNUM)
        some = np.flatnonzero(counts > 0)
        starts = np.cumsum(counts) - counts
        self.ids = np.array(ids, np.int64)[some]
        self.sequences = [hashes[starts[k] : starts[k] + counts[k]] for k in some]
        self.sizes = counts[some].astype(np.int64)
        self.bounds = np.floor(rate * self.sizes + 1e-9).astype(np.int64)
        self.stride = stride
        self.first, self.short = starts[some], (hashes >> U64(48)).astype(np.int32)
        kind = np.searchsorted([w[0] for w in walk_of], self.sizes, side="right") - 1
        self.buckets = [_Buckets(walk_of[k], np.flatnonzero(kind == k), hashes, starts[some], self.sizes) for k in np.unique(kind)]
        self.text_bytes = sum(len(t.encode()) for t in texts)

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.buckets) + sum(s.nbytes for s in self.sequences)

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and start of item-sized windows of which some stretch met the item in a bucket, each once."""
        ends = np.cumsum(counts)
        place = np.arange(len(hashes))
        if self.stride > 1:
            place = place[(place - np.repeat(ends - counts, counts)) % self.stride == 0]
        most = int(self.sizes.max(initial=0))
        width = len(hashes) + most
        found = [np.zeros(0, np.int64)]
        for b in self.buckets:
            for at, item, offset in b.pairs(hashes, place):
                row = np.searchsorted(ends, at, side="right")
                found.append((row * len(self.sizes) + item) * width + at - offset + most)
                if len(found) > 16:
                    found = [np.unique(np.concatenate(found))]
        pair, start = np.divmod(np.unique(np.concatenate(found)), max(width, 1))
        return *np.divmod(pair, max(len(self.sizes), 1)), start - most

    def enough_words(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether ``hashes[low:high]`` has all words of the item but as many as its bound; compares 16 bits of a word, so it never drops too much."""
        out = np.zeros(len(item), bool)
        order = np.argsort(self.sizes[item], kind="stable")
        short = (hashes >> U64(48)).astype(np.uint16)
        at = 0
        while at < len(order):
            # items of about one size, in a matrix of bounded size
            room = max(1, (1 << 20) // int(self.sizes[item[order[at]]] * 2 + 2))
            part = order[at : at + room]
            at += len(part)
            i = item[part]
            m, n = int(self.sizes[i].max()), int((high - low)[part].max(initial=0))
            spot = low[part][:, None] + np.arange(max(n, 1))
            held = np.where(spot < high[part][:, None], short[np.minimum(spot, len(short) - 1)].astype(np.int32), -1)
            hits = np.zeros(len(part), np.int64)
            for j in range(m):
                live = j < self.sizes[i]
                own = self.short[np.minimum(self.first[i] + j, len(self.short) - 1)]
                hits += (held == own[:, None]).any(1) & live
            out[part] = hits >= self.sizes[i] - self.bounds[i]
        return out

    def matches(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, item and exact edit distance of all finds."""
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], int] = {}
        row, item, start = self.candidates(hashes, counts)
        slack = self.bounds[item]
        low, high = np.maximum(ends[row] - counts[row], start - slack), np.minimum(ends[row], start + self.sizes[item] + slack)
        for k in np.flatnonzero(self.enough_words(hashes, low, high, item)):
            r, i = int(row[k]), int(item[k])
            if best.get((r, i), 1) == 0:
                continue
            e, own, stretch = int(self.bounds[i]), self.sequences[i], hashes[low[k] : high[k]]
            if np.isin(own, stretch).sum() < len(own) - e:
                continue
            d = edit_distance(own, stretch)
            if d <= e and d < best.get((r, i), e + 1):
                best[r, i] = d
        for (r, i), d in sorted(best.items()):
            yield r, i, d


def item_blocks(benchmark: DataFrame, unit: str, text: str, most_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark streamed to the driver in blocks of at most ``most_bytes`` of text."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for r in benchmark.where(F.col(unit).isNotNull() & F.col(text).isNotNull()).select(unit, text).distinct().toLocalIterator():
        size = len(r[1].encode())
        if texts and held + size > most_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += size
    if texts:
        yield ids, texts


_ADDED = T.StructType([T.StructField("contaminated", T.BooleanType()), T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.IntegerType()))])


def find_items(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, with_text: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with contaminated, item_ids (ascending) and edits (least word edits of each item).

    Null or empty texts contain nothing; items with null id or text, or
    without a word, are left out; items of equal id are one item. Rows are
    independent: repeated rows give repeated results. An empty benchmark finds
    nothing, an empty table gives an empty result. Columns of the input with
    clashing names are replaced; ``text`` comes along on request.
    """
    kept = [c for c in docs.columns if c not in _ADDED.fieldNames() and c != text]
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    found, written, block = docs, None, next(blocks, ([], []))
    while True:
        following = next(blocks, None)
        items = Items(*block, rate)
        if items.nbytes > COMPILED_FACTOR * max(items.text_bytes, 1 << 20):
            raise MemoryError("a compiled block of items is larger than its bound")
        shipped = spark.sparkContext.broadcast(items)
        found = _scan(found, shipped, text, [c for c in docs.columns if c in kept or c == text and (with_text or following is not None)], found is not docs)
        if following is None:
            return found
        path = scratch_path(spark, "finds")
        found.write.parquet(path)
        shipped.destroy()
        if written:
            drop(spark, written)
        found, written, block = spark.read.schema(found.schema).parquet(path), path, following


def _scan(docs: DataFrame, shipped: Broadcast, text: str, carried: list[str], again: bool) -> DataFrame:
    """One pass with one block of items; ``again``: adds to the finds that ``docs`` has from passes before."""
    schema = T.StructType([*docs.select(*carried).schema.fields, *_ADDED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                hashes, counts = words(plain(part.column(text)), ALNUM)
                if again:
                    own = [dict(zip(i, e, strict=True)) for i, e in zip(part.column("item_ids").to_pylist(), part.column("edits").to_pylist(), strict=True)]
                else:
                    own = [{} for _ in range(part.num_rows)]
                for r, i, d in items.matches(hashes, counts):
                    key = int(items.ids[i])
                    own[r][key] = min(d, own[r].get(key, d))
                ids = [sorted(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array([bool(x) for x in own]), pa.array(ids, pa.list_(pa.int64())), pa.array([[x[k] for k in y] for x, y in zip(own, ids, strict=True)], pa.list_(pa.int32()))],
                    names=[*carried, *_ADDED.fieldNames()],
                )

    read = [*carried, *([] if text in carried else [text]), *(["item_ids", "edits"] if again else [])]
    return docs.select(*read).mapInArrow(task("decontam", run), schema)
