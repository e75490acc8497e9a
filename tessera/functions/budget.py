"""Token-budgeted rendering (F17-F21, F29, F31, F33, F35, P17) with a pluggable tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate, takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A tokenizer maps a text to the (start, end) offsets of its tokens.
Tokenizer = Callable[[str], list[tuple[int, int]]]
_WORDS = re.compile(r"\w+|[^\w\s]")
OVERHEAD = 8
#: What stands first in a concept, and the end of a cut line.
REPRESENTATIONS = ("A", "B", "C", "D")
HEADING, DOTS = "{role} CONCEPT\nOntology: {ontology}\nPreferred label: {label}", " ..."
CUT_ROOM, CUT_MARKS = 4, " ,;:"


def word_offsets(text: str) -> list[tuple[int, int]]:
    """The default tokenizer: words and single signs."""
    return [m.span() for m in _WORDS.finditer(text)]


def word_count(text: Column) -> Column:
    """F17 for the default tokenizer, without Python."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), 0))


def fit_list_native(prefix: Column, items: Column, budget: Column, sep: str = "; ") -> Column:
    """the longest prefix of ``items`` whose rendering fits; it stops at the first that doesn't. Empty if none fits."""
    state = F.struct(F.lit("").alias("text"), F.lit(False).alias("stop"))

    def step(s: Column, item: Column) -> Column:
        longer = F.when(s["text"] == "", F.concat(prefix, item)).otherwise(F.concat(s["text"], F.lit(sep), item))
        full = s["stop"] | (word_count(longer) > budget)
        return F.struct(F.when(full, s["text"]).otherwise(longer).alias("text"), full.alias("stop"))

    return F.aggregate(items, state, step, lambda s: s["text"])


@dataclass(frozen=True)
class Line:
    """One optional line of a concept: who shows it, its place in the text, and its claim on the budget."""

    name: str
    heading: str
    place: int
    shown_by: str
    share: float | None = None  # of the whole budget; None: what is left
    whole_for: str = ""  # representations for which the share doesn't hold
    spare: int = 0  # tokens left free for the line end


#: Headings, shares and who shows what. The order is that of the claims, ``place`` that of the text.
LINES = (
    Line("synonyms", "Synonyms: ", 1, "BCD", 0.35, "B"),
    Line("parents", "Parent concepts: ", 3, "D", 0.15),
    Line("definition", "Definition: ", 2, "CD", spare=1),
)


def fit_list(tok: Tokenizer, prefix: str, items: Sequence[str], budget: int, sep: str = "; ") -> str:
    """F18 in Python: the longest run of first items that fits; growing lines, up to the first that is too long."""
    growing = accumulate(items, lambda line, item: f"{line}{sep}{item}")
    fitting = list(takewhile(lambda line: len(tok(line)) <= budget, (prefix + line for line in growing)))
    return fitting[-1] if fitting else ""


def fit_text(tok: Tokenizer, prefix: str, text: str, budget: int) -> str:
    """a text under its heading; too long, it ends at the last blank before the token that still has room, with dots.

    Nothing is shown if the heading leaves ``CUT_ROOM`` tokens or fewer, or
    the cut would leave the heading alone.
    """
    ends = [end for _, end in tok(prefix + text)]
    if text and len(ends) > budget:
        room = budget - len(tok(prefix))
        body = (prefix + text)[: ends[budget - 2]].rpartition(" ")[0][len(prefix) :].rstrip(CUT_MARKS) if room > CUT_ROOM else ""
        text = body + DOTS if body else ""
    return prefix + text if text else ""


def entity_text(tok: Tokenizer, role: str, ontology: str, label: str, synonyms: Sequence[str], definition: str, parents: Sequence[str], rep: str, budget: int) -> str:
    """The heading, then every line of ``LINES`` that the representation shows, as far as its claim reaches."""
    if rep not in REPRESENTATIONS:
        raise ValueError(f"no representation {rep!r}")
    values = {"synonyms": synonyms, "definition": definition, "parents": parents}
    texts = {0: HEADING.format(role=role, ontology=ontology, label=label)}
    free = max(0, budget - len(tok(texts[0])))
    for line in LINES:
        value = values[line.name]
        if not value or rep not in line.shown_by:
            continue
        claim = free if line.share is None or rep in line.whole_for else min(free, int(budget * line.share))
        fit = fit_text if isinstance(value, str) else fit_list
        if shown := fit(tok, line.heading, value, claim - line.spare):
            texts[line.place] = shown
            free -= len(tok("\n" + shown))
    return "\n".join(texts[place] for place in sorted(texts))


def concept_budget(max_len: int, head: int) -> int:
    """tokens of one concept, given the tokens of the question's head."""
    return (max_len - head - 1 - OVERHEAD) // 2


def render_entities(role: str, rep: str, budget: int, tok: Tokenizer = word_offsets):
    """An Arrow UDF over the entity dimension (not over pairs): ontology, label, synonyms, definition, parents."""

    @F.pandas_udf(StringType())
    def run(ontology: pd.Series, label: pd.Series, synonyms: pd.Series, definition: pd.Series, parents: pd.Series) -> pd.Series:
        listed = lambda v: [] if v is None else list(v)
        return pd.Series([entity_text(tok, role, o or "", n or "", listed(s), d or "", listed(p), rep, budget) for o, n, s, d, p in zip(ontology, label, synonyms, definition, parents, strict=True)])

    return run


def pair_state(source: Column, target: Column) -> Column:
    """F21."""
    return F.concat(source, F.lit("\n\n"), target)


def option_text(label: Column, synonyms: Column, most: int = 40) -> Column:
    """label, then synonyms while they fit."""
    state = F.struct(label.alias("text"), F.lit(False).alias("stop"))

    def step(s: Column, item: Column) -> Column:
        longer = F.concat(s["text"], F.lit("; "), item)
        full = s["stop"] | (word_count(longer) > most)
        return F.struct(F.when(full, s["text"]).otherwise(longer).alias("text"), full.alias("stop"))

    return F.aggregate(synonyms, state, step, lambda s: s["text"])


def question_budget(options: Column, instruction: int, per_option: int = 48) -> Column:
    """tokens of a many-option question."""
    return F.aggregate(options, F.lit(0), lambda s, o: s + F.least(F.lit(per_option), word_count(o)) + 1) + instruction + 32
