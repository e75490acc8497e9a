"""Quality rules: word statistics and the fertility of a public tokenizer.

Base rules count words, symbols and repetition. Fertility asks how a public
vocabulary takes the text: characters per token (gibberish, keys and encoded
data fall apart into short tokens), the share of byte-fallback tokens
(characters that the vocabulary doesn't know) and the entropy of the tokens
(a text of a few repeated tokens has little). Each script has fixed outer
bands. A second public vocabulary, byte-level, spells junk in shorter tokens
than clean text of the same language; how short is too short comes from the
corpus itself, see ``bounds``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._store import materialise
from tessera.llm._words import NON_SPACE, buffers, range_hashes, shingles, slices, text_array, words
from tessera.llm._worker import held, task

SLICE_BYTES = 1 << 20
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MOST_REPEATED_PERCENT = 20
#: The corpus bound of a language: this share of its texts at most, and only what lies so many quartile ranges below the lower quartile.
TAIL = 0.02
FENCE = 3.0
#: Characters that the second vocabulary takes at once; its splitter fails on longer runs of blanks.
PIECE_CHARS = 50_000
#: How the second vocabulary's files split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: First code point of a run of scripts, and the band that holds from there.
_SCRIPTS = ((0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "semitic"), (0x780, "other"), (0x900, "indic"), (0x1100, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x2FA20, "other"))


@dataclass(frozen=True)
class Band:
    """What a text's fertility must lie within; entropy counts only from ``entropy_from`` tokens."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    entropy_from: int = 50


#: By script of most letters; scripts that the vocabulary spells out in bytes have wide bands.
BANDS = {
    "latin": Band(1.35, 8.0, 0.10, 3.0),
    "greek": Band(0.6, 6.0, 0.50, 3.0),
    "cyrillic": Band(1.0, 8.0, 0.20, 3.0),
    "semitic": Band(0.5, 6.0, 0.60, 2.5),
    "indic": Band(0.3, 6.0, 0.95, 2.5),
    "cjk": Band(0.3, 3.0, 0.90, 3.0),
    "other": Band(0.2, 8.0, 1.0, 2.0),
}


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags between offsets."""
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def _repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row has the key more than once, and whether it had it before."""
    order = np.lexsort((keys, row))
    same = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    often, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    before[order[1:][same]] = True  # the order is stable, so the first of them is the first in the text
    return often, before


def base_counts(column: pa.Array) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text, one row each."""
    column = text_array(column)
    rows = len(column)
    data, offsets = buffers(column)
    if not len(data):
        return np.zeros((rows, 5), np.int64)
    hashes, n_words = words(column, NON_SPACE, lower=False)
    inside = NON_SPACE[data]
    chars = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)
    # lines: from a row's start or a line end to the next; those with a word count
    ends = data == 10
    start = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(ends) + 1]))
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, side="right") - 1
    stops = np.append(np.flatnonzero(ends), len(data))
    stop = np.minimum(stops[np.searchsorted(stops, start)], offsets[row + 1])
    upto = np.append(0, np.cumsum(inside))
    real = upto[stop] > upto[start]
    start, stop, row = start[real], stop[real], row[real]
    dup = np.bincount(row[_repeated(range_hashes(data, start, stop), row)[1]], minlength=rows)
    # windows: a word counts if one of the windows over it is repeated
    grams, of = shingles(hashes, n_words, WINDOW)
    full = n_words[of] >= WINDOW
    first = np.cumsum(n_words) - n_words
    windows = np.maximum(n_words - WINDOW + 1, (n_words > 0).astype(np.int64))
    at = (np.arange(len(grams)) - np.repeat(np.cumsum(windows) - windows, windows) + first[of])[full]
    at = at[_repeated(grams[full], of[full])[0]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, at + WINDOW, 1)
    repeat = _per_row(np.cumsum(cover[:-1]) > 0, np.append(first, len(hashes)))
    return np.stack([n_words, chars, symbols, dup, repeat], 1).astype(np.int64)


def scripts(texts: list[str]) -> list[str]:
    """The script of most letters of each text (``latin`` where there is none)."""
    firsts = np.array([a for a, _ in _SCRIPTS], np.uint32)
    names = [b for _, b in _SCRIPTS]
    kinds = sorted(set(names), key=lambda x: x != "latin")
    kind = np.array([kinds.index(x) for x in names])
    out = []
    for text in texts:
        if text.isascii():
            out.append("latin")
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = (points < 0x250) & ((points | 32) - 97 < 26) | (points >= 0xC0) & (points < 0x250)
        far = points[points >= 0x250]
        votes = np.zeros(len(kinds), np.int64)
        votes[0] = int(plain.sum())
        if len(far):
            votes += np.bincount(kind[np.searchsorted(firsts, far, side="right") - 1], minlength=len(kinds))
            if votes[kinds.index("other")] < votes.sum():
                votes[kinds.index("other")] = 0  # punctuation and signs beyond Latin
        out.append(kinds[int(votes.argmax())])
    return out


class Fertility:
    """Characters per token, byte-fallback share and token entropy by one public piece vocabulary."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        # white-space bytes are layout, not characters that the vocabulary lacks
        layout = {"<0x09>", "<0x0A>", "<0x0D>"}
        self.is_byte = np.array([self.model.IsByte(i) and self.model.IdToPiece(i) not in layout for i in range(self.model.GetPieceSize())])

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, characters per token, byte share and entropy in bits of each text."""
        size, rows = len(self.is_byte), len(texts)
        n, shares, entropy = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
        for k, ids in enumerate(self.model.encode(texts, num_threads=1)):
            if ids:
                at = np.array(ids, np.int64)
                n[k] = len(at)
                shares[k] = self.is_byte[at].mean()
                counts = np.bincount(at, minlength=size) if len(at) > size else np.unique(at, return_counts=True)[1]
                counts = counts[counts > 0] / len(at)
                entropy[k] = -(counts * np.log2(counts)).sum()
        return n, np.array([len(t) for t in texts]) / np.maximum(n, 1), shares, entropy


class RankFertility:
    """Characters per token and token entropy by a byte-level vocabulary of merge ranks."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(piece): int(at) for piece, at in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters per token and entropy in bits of each text."""
        chars, entropy = np.zeros(len(texts)), np.zeros(len(texts))
        for k, text in enumerate(texts):
            if text:
                ids = np.concatenate([self.model.encode_to_numpy(text[a : a + PIECE_CHARS], disallowed_special=()) for a in range(0, len(text), PIECE_CHARS)])
                counts = np.unique(ids, return_counts=True)[1] / len(ids)
                chars[k] = len(text) / len(ids)
                entropy[k] = -(counts * np.log2(counts)).sum()
        return chars, entropy


def bounds(measured: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``least``: under how many characters per token of the second vocabulary a text is rejected.

    ``least`` is the smaller of the ``TAIL`` quantile of all texts that pass
    the base rules and the lower quartile less ``FENCE`` quartile ranges: at
    most that share of a language goes, and none of it where the texts are
    alike. Quantiles are by nearest rank over exact counts of figures rounded
    to 0.001, so they don't depend on partitioning.
    """
    counts = measured.where("not base_failed").groupBy(*by, F.bround("chars_per_token_2", 3).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("n").over(group.orderBy("c"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * F.col("all")), F.col("c")))
    found = placed.groupBy(*by).agg(at(TAIL).alias("tail"), at(0.25).alias("low"), at(0.75).alias("high"))
    return found.select(*by, F.least("tail", F.col("low") - FENCE * (F.col("high") - F.col("low"))).alias("least"))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "chars_per_token_2", "token_entropy_2", "kept")


def assess(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model",
    bands: dict[str, Band] | None = None,
    with_text: bool = False,
    second: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken",
    language: str = "lang",
) -> DataFrame:
    """``docs`` with the counts, the fertility figures and ``kept``.

    ``vocabulary`` and ``second`` are the files of a public piece model and of
    public merge ranks on every executor. A null or empty text has no words
    and fails the base rules; every text is measured, whole, whether it fails
    them or not. The figures of a row depend on it alone (repeated rows have
    equal ones) and are written to the shared folder once; ``bounds`` over all
    that pass the base rules, by script and by the column ``language`` where
    there is one (null is a language too), then decide beside the fixed bands;
    a text just at a bound is kept. An empty table gives an empty one. Columns
    of the input called as the results are replaced, other names don't matter;
    ``text`` comes along on request.
    """
    bands = bands or BANDS
    carried = [c for c in docs.columns if c not in ADDED and (with_text or c != text)]
    zero, real = F.lit(0).cast("long"), F.lit(0.0)
    kinds = dict(zip(ADDED, (zero, zero, zero, zero, zero, F.lit(True), F.lit(""), zero, real, real, real, real, real, F.lit(True)), strict=True))
    schema = docs.select(*carried).withColumns(kinds).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter, other = held("quality", vocabulary, lambda: Fertility(vocabulary)), held("quality", second, lambda: RankFertility(second))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                texts = text_array(part.column(text)).to_pylist()
                counts = base_counts(part.column(text))
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
                tokens, chars, shares, entropy = meter.measure(texts)
                chars_2, entropy_2 = other.measure(texts)
                script = scripts(texts)
                kept = np.zeros(len(texts), bool)
                for k in np.flatnonzero(~failed):
                    b = bands[script[k]]
                    kept[k] = b.least_chars <= chars[k] <= b.most_chars and shares[k] <= b.most_bytes and (tokens[k] < b.entropy_from or min(entropy[k], entropy_2[k]) >= b.least_entropy)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), *(pa.array(counts[:, k]) for k in range(5)), *map(pa.array, (failed, script, tokens, chars, shares, entropy, chars_2, entropy_2, kept))],
                    names=[*carried, *ADDED],
                )

    measured = materialise(docs.sparkSession, docs.select(*carried, *([] if with_text else [text])).mapInArrow(task("quality", run), schema), "quality")
    by = ["script", *([language] if language in carried else [])]
    # written, so that the planner knows that it is small and doesn't shuffle the texts
    found = materialise(docs.sparkSession, bounds(measured, by).select(*(F.col(c).alias(f"_{c}") for c in by), "least"), "bounds")
    same = [measured[c].eqNullSafe(found[f"_{c}"]) for c in by]
    inside = F.col("kept") & (F.bround("chars_per_token_2", 3) >= F.coalesce("least", F.lit(0.0)))
    return measured.join(found, same, "left").withColumn("kept", inside).select(*measured.columns)
