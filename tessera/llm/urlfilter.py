"""URL rules as bit-parallel wildcard automata.

Every rule is a glob over the canonical URL ``.host/path``; rules lie side by
side in multiword bit vectors, one bit per pattern character, and extended
Shift-And steps them together: per character one shift, one AND with the
character's mask, and one OR with the places whose wildcard loops. A batch of
URLs is stepped at once, longest first, so the work is one short numpy row per
character position. Large rule sets are dealt into shards of bounded width,
and a batch is cut so that its longest URL times its rows is bounded; a URL
whose automaton can only loop on in a last wildcard is done.

Glob syntax: ``*`` any run of characters, ``+`` any run without ``/`` (for
hosts), anything else itself. A pattern must fit the whole canonical URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._worker import task

#: Rows of a slice, and its rows times its longest url.
SLICE_ROWS, SLICE_CHARS = 4096, 1 << 20
#: 64-bit words of one shard of rules.
SHARD_WORDS = 64
#: Steps between looks at whether anything can still change.
LOOK = 64


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls that ``glob`` fits; ``label`` is reported, longer labels win, block wins ties."""

    verdict: str
    label: str
    glob: str
    explicit: bool = True


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and a path prefix."""
    return Rule(verdict, host + path, f"+.{host}{path}*")


#: The site rules of the contract, then host and path words that block where no site rule fits.
SITE_RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: Host words by what they stand for.
BLOCKED_WORDS = {
    "gambling": ("casino", "poker-", "-slots", "sportsbet", "betting-", "jackpot-"),
    "adult": ("xxx-", "-xxx", "porn", "sexcam", "escort-"),
    "spam": ("spam-farm", "cheap-viagra", "replica-watch", "payday-loan", "free-iphone", "link-farm"),
    "malware": ("malware", "phishing", "keygen-", "-warez", "crackserial"),
}
WORD_RULES = tuple(Rule("block", "", f"+{word}*", False) for words in BLOCKED_WORDS.values() for word in words)
DEFAULT_RULES = SITE_RULES + WORD_RULES


class GlobAutomaton:
    """All globs compiled into multiword Shift-And masks (64-bit words, little end first)."""

    def __init__(self, globs: Sequence[str]):
        bits: list[tuple[str, str]] = []  # character, loop kind
        self.first: list[int] = []
        self.last: list[int] = []
        for glob in globs:
            body = ["\0start"]
            loops = [""]
            for c in glob:
                if c in "*+":
                    loops[-1] = "*" if "*" in (c, loops[-1]) else "+"
                else:
                    body.append(c)
                    loops.append("")
            self.first.append(len(bits))
            bits += zip(body, loops, strict=True)
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        # ASCII has a mask each; all other characters share the last row.
        self.masks = np.zeros((129, self.words), np.uint64)
        self.loops = np.zeros((129, self.words), np.uint64)
        self.initial = np.zeros(self.words, np.uint64)
        self.other: dict[int, np.ndarray] = {}
        for k, (char, loop) in enumerate(bits):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if char == "\0start":
                self.initial[word] |= bit
            elif ord(char) < 128:
                self.masks[ord(char), word] |= bit
            else:
                self.other.setdefault(ord(char), np.zeros(self.words, np.uint64))[word] |= bit
            if loop:
                self.loops[:, word] |= bit
                if loop == "+":
                    self.loops[ord("/"), word] &= ~bit
        # places that stay as they are whatever follows: a last wildcard
        self.settled = np.zeros(self.words, np.uint64)
        for j in self.last:
            if bits[j][1] == "*":
                self.settled[j // 64] |= np.uint64(1 << (j % 64))

    def fits(self, urls: Sequence[str]) -> np.ndarray:
        """Which glob fits which whole url: booleans, urls x globs."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self.initial[None, :], len(urls), 0)
        width = int(lengths.max(initial=0))
        points = np.zeros((len(urls), width), np.uint32)
        for place, k in enumerate(order):
            points[place, : lengths[k]] = np.frombuffer(urls[k].encode("utf-32-le", "surrogatepass"), np.uint32)
        # urls of at least p + 1 characters come first
        live = np.searchsorted(-lengths[order], -np.arange(1, width + 1), side="right") if width else []
        top = np.uint64(63)
        for p in range(width):
            n = live[p]
            if p % LOOK == 0 and not (state[:n] & ~self.settled).any():
                break
            old, char = state[:n], points[:n, p]
            row = np.minimum(char, 128)
            masks = self.masks[row]
            for code, extra in self.other.items():
                masks[char == code] |= extra
            moved = old << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= old[:, :-1] >> top
            state[:n] = (moved & masks) | (old & self.loops[row])
        out = np.zeros((len(urls), len(self.last)), bool)
        for j, bit in enumerate(self.last):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


class ShardedAutomaton:
    """Ranked globs in automata of at most ``most_words`` words; the first glob that fits a url counts."""

    def __init__(self, globs: Sequence[str], most_words: int = SHARD_WORDS):
        self.shards: list[tuple[int, GlobAutomaton]] = []
        at = 0
        while at < len(globs):
            to, bits = at, 0
            while to < len(globs) and (to == at or bits + len(globs[to]) + 1 <= 64 * most_words):
                bits += len(globs[to]) + 1
                to += 1
            self.shards.append((at, GlobAutomaton(globs[at:to])))
            at = to

    def first(self, urls: Sequence[str]) -> np.ndarray:
        """Place of the first glob that fits each url, -1 if none; urls that an earlier shard has settled are done."""
        out = np.full(len(urls), -1, np.int64)
        left = np.arange(len(urls))
        for at, machine in self.shards:
            if not len(left):
                break
            fits = machine.fits([urls[k] for k in left])
            some = fits.any(1)
            out[left[some]] = at + fits[some].argmax(1)
            left = left[~some]
        return out


def even_slices(lengths: np.ndarray, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[np.ndarray]:
    """Places by falling length, in runs of at most ``rows`` whose number times longest is at most ``chars`` (a longer url is alone)."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(rows, chars // max(1, int(lengths[order[at]]))))
        yield order[at : at + n]
        at += n


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path by the contract; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def judge(frame: DataFrame, url: str = "url", rules: Sequence[Rule] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """``frame`` with host, path, rule (null if only a word rule or none fits) and verdict.

    Among site rules that fit, the longest label wins, block on ties; without
    one, word rules give the verdict, else ``default``. Null urls and urls
    without ``://`` have empty host and path, fit no site rule and get
    ``default``. Columns with the four names are replaced; rows are
    independent of each other, repeated rows give repeated results, an empty
    table an empty one. A very long url is taken whole, by itself.
    """
    added = ("host", "path", "rule", "verdict")
    carried = [c for c in frame.columns if c not in added]
    ranked = sorted(rules, key=lambda r: (-r.explicit, -len(r.label), r.verdict != "block"))
    schema = frame.select(*carried).withColumns({"host": F.lit(""), "path": F.lit(""), "rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShardedAutomaton([r.glob for r in ranked])
        for batch in batches:
            pairs = [split_url(u) for u in batch.column(url).to_pylist()]
            urls = [f".{h}{p}" if h or p else "" for h, p in pairs]
            first = np.full(len(urls), -1, np.int64)
            for part in even_slices(np.array([len(u) for u in urls], np.int64)):
                first[part] = machine.first([urls[k] for k in part])
            chosen = [ranked[k] if k >= 0 else None for k in first]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array([h for h, _ in pairs], pa.string()),
                    pa.array([p for _, p in pairs], pa.string()),
                    pa.array([r.label if r and r.explicit else None for r in chosen], pa.string()),
                    pa.array([r.verdict if r else default for r in chosen], pa.string()),
                ],
                names=[*carried, *added],
            )

    return frame.select(*carried).mapInArrow(task("urlfilter", run), schema)
