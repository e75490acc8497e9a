"""Language identification with interpolated Kneser-Ney character models.

One model per language over characters reduced to lower-case letters, every
run of other characters being one blank. The n-grams of order 1 to 4 (four
16-bit characters: keys are exact) are kept in sorted hash arrays; beside
each key stands one column per language with that language's interpolated
log-probability, so a character costs one look-up however many languages
there are. An n-gram that no language has seen backs off: the context's
back-off weights are added and the next shorter order is asked.

A text gets the language of lowest cross-entropy per character. Temperature
and rejection thresholds are calibrated on a slice of the sample that the
counts never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._words import U64, SortedHash, slices, text_array
from tessera.llm._worker import task

ORDER = 4
PAD = ORDER - 1
BLANK = 32
#: Characters that an unseen one competes with.
ALPHABET = 4096
SLICE_BYTES = 1 << 20
#: Bytes of the texts that one language learns from, and of the longest of them.
SAMPLE_BYTES, SAMPLE_TEXT = 16 << 20, 1 << 20
#: Bytes of a model that may be shipped to executors.
MODEL_BYTES = 512 << 20


def _letters() -> np.ndarray:
    table = np.full(65536 + 1, BLANK, np.uint16)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < 65536 else i
    table[65536] = 0xFFFF  # letters beyond the basic plane share one symbol
    return table


_TABLE: list[np.ndarray] = []


def reduced(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all rows, each row after ``PAD`` blanks; the row of each character; which are padding."""
    if not _TABLE:
        _TABLE.append(_letters())
    column = text_array(column)
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(column.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = points >= 65536
    codes = _TABLE[0][np.minimum(points, 65536)]
    if far.any():
        odd = [i for i in np.flatnonzero(far) if not joined[i].isalpha()]
        codes = codes.copy()
        codes[odd] = BLANK
    row = np.repeat(np.arange(len(lengths)), lengths)
    keep = codes != BLANK
    if len(codes):
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        inner = np.ones(len(codes), bool)
        inner[1:] = codes[:-1] != BLANK
        inner[starts] = False  # the padding already stands for a leading blank
        keep |= inner
    codes, row = codes[keep], row[keep]
    n = len(lengths)
    out = np.full(len(codes) + PAD * n, BLANK, np.uint16)
    place = np.arange(len(codes)) + PAD * (row + 1)
    out[place] = codes
    real = np.zeros(len(out), bool)
    real[place] = True
    counts = np.bincount(row, minlength=n) + PAD
    return out, np.repeat(np.arange(n), counts), real


def keys4(codes: np.ndarray) -> np.ndarray:
    """The last ``ORDER`` characters up to each place, packed in 64 bits."""
    wide = codes.astype(U64)
    out = wide.copy()
    for k in range(1, ORDER):
        out[k:] |= wide[:-k] << U64(16 * k)
    return out


def _mask(order: int) -> np.uint64:
    return U64((1 << (16 * order)) - 1)


@dataclass
class _Counts:
    """One language and order: sorted keys and counts, sorted contexts with total and back-off weight."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    weight: np.ndarray
    discount: float

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> _Counts:
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        contexts, which = np.unique(keys >> U64(16), return_inverse=True)
        totals = np.bincount(which, counts, len(contexts))
        kinds = np.bincount(which, minlength=len(contexts))
        return cls(keys, counts.astype(float), contexts, totals, discount * kinds / np.maximum(totals, 1), discount)


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _count(grams: np.ndarray) -> dict[int, _Counts]:
    """Raw counts at the highest order, continuation counts (distinct left neighbours) below."""
    keys, counts = np.unique(grams, return_counts=True)
    out = {ORDER: _Counts.of(keys, counts)}
    for order in range(ORDER - 1, 0, -1):
        keys, counts = np.unique(keys & _mask(order), return_counts=True)
        out[order] = _Counts.of(keys, counts)
    return out


def _probability(model: dict[int, _Counts], order: int, keys: np.ndarray) -> np.ndarray:
    if order == 0:
        return np.full(len(keys), 1 / ALPHABET)
    m = model[order]
    lower = _probability(model, order - 1, keys & _mask(order - 1) if order > 1 else keys)
    at, seen = _place(m.keys, keys)
    ctx, known = _place(m.contexts, keys >> U64(16))
    total = np.where(known, m.totals[ctx] if len(m.totals) else 1.0, 1.0)
    own = np.where(seen & known, (m.counts[at] if len(m.counts) else 0.0) - m.discount, 0.0) / total
    return own + np.where(known, m.weight[ctx] if len(m.weight) else 1.0, 1.0) * lower


@dataclass
class LanguageModel:
    """Sorted hash arrays of all orders with one column of log2 values per language."""

    languages: list[str]
    grams: dict[int, SortedHash] = field(default_factory=dict)
    values: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, SortedHash] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray | None = None
    temperature: float = 1.0
    reject_above: np.ndarray | None = None

    @classmethod
    def train(cls, texts: list[str], labels: list[str]) -> LanguageModel:
        """Count, interpolate and calibrate on a sample (every tenth text of a language calibrates only)."""
        out = cls(sorted(set(labels)))
        rank: dict[str, int] = {}
        fit, hold = {x: [] for x in out.languages}, []
        for text, label in zip(texts, labels, strict=True):
            rank[label] = rank.get(label, 0) + 1
            if rank[label] % 10 == 0:
                hold.append((text, label))
            else:
                fit[label].append(text)
        models = []
        for label in out.languages:
            codes, _, real = reduced(pa.array(fit[label], pa.string()))
            models.append(_count(keys4(codes)[real]))
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([m[order].keys for m in models] or [np.zeros(0, U64)]))
            out.grams[order] = SortedHash(union)
            found = np.stack([np.log2(_probability(m, order, union)) for m in models], 1) if models else np.zeros((0, 0))
            out.values[order] = found[out.grams[order].order].astype(np.float32)
            contexts = np.unique(np.concatenate([m[order].contexts for m in models] or [np.zeros(0, U64)]))
            out.contexts[order] = SortedHash(contexts)
            columns = []
            for m in models:
                at, known = _place(m[order].contexts, contexts)
                columns.append(np.where(known, np.log2(np.maximum(m[order].weight[at] if len(m[order].weight) else 1.0, 1e-9)), 0.0))
            found = np.stack(columns, 1) if columns else np.zeros((0, 0))
            out.weights[order] = found[out.contexts[order].order].astype(np.float32)
        out.unseen = np.full(len(out.languages), -np.log2(ALPHABET))
        out._calibrate(hold)
        return out

    @property
    def nbytes(self) -> int:
        tables = [*self.grams.values(), *self.contexts.values()]
        return sum(t.hashes.nbytes + t.order.nbytes + t.start.nbytes for t in tables) + sum(v.nbytes for d in (self.values, self.weights) for v in d.values())

    def _calibrate(self, hold: list[tuple[str, str]]) -> None:
        self.reject_above = np.full(len(self.languages), np.inf)
        if not hold:
            return
        bits, n = self.entropies(pa.array([t for t, _ in hold], pa.string()))
        gold = np.array([self.languages.index(x) for _, x in hold])
        use = n > 0
        if not use.any():
            return
        bits, gold = bits[use], gold[use]
        losses = {}
        for t in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
            z = -bits / t
            z -= z.max(1, keepdims=True)
            losses[t] = float(-(z[np.arange(len(gold)), gold] - np.log(np.exp(z).sum(1))).mean())
        self.temperature = min(losses, key=losses.get)
        for k in range(len(self.languages)):
            own = bits[gold == k, k]
            if len(own) > 1:
                self.reject_above[k] = own.mean() + 6 * own.std() + 0.25

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character for each row and language, and the letters counted in (0: none)."""
        codes, row, real = reduced(column)
        rows, langs = len(column), len(self.languages)
        n = np.bincount(row[real], minlength=rows)
        letters = np.bincount(row[real & (codes != BLANK)], minlength=rows)
        total = np.zeros((rows, langs))
        if not langs:
            return total, letters
        keys, row = keys4(codes)[real], row[real]

        def add(values: np.ndarray, at: np.ndarray, rows_of: np.ndarray) -> None:
            for k in range(langs):
                total[:, k] += np.bincount(rows_of, values[:, k][at], rows)

        for order in range(ORDER, 0, -1):
            found = self.grams[order].find(keys)
            hit = found >= 0
            add(self.values[order], found[hit], row[hit])
            miss = ~hit
            keys, row = keys[miss], row[miss]
            if not len(keys):
                break
            at = self.contexts[order].find(keys >> U64(16))
            known = at >= 0
            add(self.weights[order], at[known], row[known])
            keys = keys & _mask(order - 1) if order > 1 else keys
        if len(keys):
            total += np.bincount(row, minlength=rows)[:, None] * self.unseen[None, :]
        return -total / np.maximum(n, 1)[:, None], letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, calibrated probability, bits per character, and whether the text is too unlikely for its language."""
        bits, letters = self.entropies(column)
        if not self.languages:
            none = np.zeros(len(column))
            return ["und"] * len(column), none, none, none.astype(bool)
        best = bits.argmin(1)
        z = -bits / self.temperature
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        score = e[np.arange(len(best)), best] / e.sum(1)
        least = bits[np.arange(len(best)), best]
        none = letters == 0
        names = [("und" if x else self.languages[b]) for b, x in zip(best, none, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, 0.0, least), np.where(none, False, least > self.reject_above[best])


def sample(docs: DataFrame, text: str, label: str, unit: str, per_language: int, most_bytes: int = SAMPLE_BYTES, longest: int = SAMPLE_TEXT) -> tuple[list[str], list[str]]:
    """About ``per_language`` whole labelled texts and ``most_bytes`` of text of each language, at most twice as many, chosen by a hash of ``unit``.

    The choice is a threshold on the hash, not a sort, so no group of rows
    meets in one task. Texts of more than ``longest`` bytes teach nothing (they
    are predicted like any other), so the bytes gathered are bounded too.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.octet_length(text) <= longest))
    sizes = {r[0]: (r[1], r[2]) for r in known.groupBy(label).agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).collect()}
    if not sizes:
        return [], []
    share = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_language / n, most_bytes / max(1, size)))) for k, (n, size) in sizes.items()])
    place = F.pmod(F.xxhash64(F.col(unit).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(place < share).select(F.col(text), F.col(label)).limit(2 * per_language * len(sizes)).collect()
    chosen = sorted((tuple(r) for r in chosen), key=lambda r: (r[1], r[0]))
    return [r[0] for r in chosen], [r[1] for r in chosen]


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with lang_pred, score, bits and rejected.

    A null text, an empty one or one without a letter is ``und`` with score 0.
    Columns of the input with those names are replaced, other names don't
    matter. Rows are independent: repeated rows give repeated results, an
    empty table an empty result. Of equally likely languages the first in
    alphabetical order is taken. A very long text is taken whole, in memory of
    some times its size. A model over ``MODEL_BYTES`` is not shipped.
    """
    if model.nbytes > MODEL_BYTES:
        raise MemoryError(f"a model of {model.nbytes} bytes is over the bound of what is shipped")
    shipped = spark.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c not in {text, "lang_pred", "score", "bits", "rejected"}]
    schema = docs.select(*carried).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(0.0), "rejected": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                names, score, bits, rejected = own.predict(part.column(text))
                columns = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                    names=[*carried, "lang_pred", "score", "bits", "rejected"],
                )

    return docs.select(*carried, text).mapInArrow(task("langid", run), schema)
