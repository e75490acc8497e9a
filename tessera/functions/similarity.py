"""Lexical features of a pair of name lists."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import token_set


def label_equal(a: Column, b: Column) -> Column:
    """first names equal."""
    return (a[0] == b[0]).cast("int")


def name_equal(a: Column, b: Column) -> Column:
    """Any name shared."""
    return F.arrays_overlap(a, b).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_sets(names: Column) -> Column:
    """Token sets of all names: computed once per entity, before pairs are made."""
    return F.transform(names, token_set)


def best_jaccard(a: Column, b: Column) -> Column:
    """The largest Jaccard over all pairs of token sets, inside the row."""
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: jaccard(x, y)))))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine-word-parallel step per character of ``b``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & places.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (len a + len b); 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def best_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The largest indel ratio over all pairs of names; equal pairs of a batch are computed once."""
    known: dict[tuple[str, str], float] = {}

    def ratio(x: str, y: str) -> float:
        key = (x, y) if x <= y else (y, x)
        if key not in known:
            known[key] = indel_ratio(*key)
        return known[key]

    return pd.Series([max((ratio(x, y) for x in s for y in t), default=0.0) for s, t in zip(a, b, strict=True)], dtype=float)


def lex_score(e_label: Column, e_name: Column, j: Column, r: Column) -> Column:
    """F06."""
    return (e_label + e_name + j + r) / 4


def ratio_or_exact(e_name: Column, names_a: Column, names_b: Column) -> Column:
    """R: a shared name makes it 1 without looking at characters."""
    return F.when(e_name == 1, F.lit(1.0)).otherwise(best_ratio(names_a, names_b))


def _lcs_table(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``lcs_length`` of every string of ``a`` with every one of ``b``: the same steps, one machine word a pair; strings beyond 64 characters one by one."""
    out = np.zeros((len(a), len(b)), np.int64)
    short = [i for i, x in enumerate(a) if len(x) <= 64]
    for i in set(range(len(a))) - set(short):
        out[i] = [lcs_length(a[i], y) for y in b]
    if not short or not b:
        return out
    chars = {c: k for k, c in enumerate(sorted(set("".join(b))))}
    masks = np.zeros((len(short), len(chars) + 1), np.uint64)  # the last column, of no character, changes nothing
    for row, i in enumerate(short):
        for k, c in enumerate(a[i]):
            if c in chars:
                masks[row, chars[c]] |= np.uint64(1 << k)
    codes = np.full((max(map(len, b)), len(b)), len(chars))
    for j, y in enumerate(b):
        codes[: len(y), j] = [chars[c] for c in y]
    state = np.full((len(short), len(b)), ~np.uint64(0))
    for at in codes:
        match = state & masks[:, at]
        state = (state + match) | (state - match)
    full = np.array([(1 << len(a[i])) - 1 for i in short], np.uint64)
    out[short] = np.bitwise_count(~state & full[:, None])
    return out


def _jaccard_table(a: Sequence[Sequence[str]], b: Sequence[Sequence[str]]) -> np.ndarray:
    """``jaccard`` of every token set of ``a`` with every one of ``b``."""
    holders: dict[str, list[int]] = {}
    for j, tokens in enumerate(b):
        for t in tokens:
            holders.setdefault(t, []).append(j)
    shared = np.zeros((len(a), len(b)))
    for i, tokens in enumerate(a):
        for t in tokens:
            if t in holders:
                shared[i, holders[t]] += 1
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def feature_table(a: Sequence[tuple], b: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """e_label, e_name, j and r of every entity of ``a`` with every one of ``b``, as tables; an entity is ``(names, sets)``.

    What two names have to do with each other is worked out once for each two
    distinct names, so repeated names cost a lookup.
    """
    known: list[dict[str, int]] = [{}, {}]
    sets: list[list] = [[], []]
    listed: list[np.ndarray] = []
    for side, entities in enumerate((a, b)):
        at = known[side]
        for names, tokens in entities:
            for n, s in zip(names, tokens, strict=True):
                if n not in at:
                    at[n] = len(at)
                    sets[side].append(s)
        width = max(len(names) for names, _ in entities)
        # a short list is filled up with its first name, which adds no pair
        listed.append(np.array([[at[n] for n in names] + [at[names[0]]] * (width - len(names)) for names, _ in entities]))
    x, y = list(known[0]), list(known[1])
    length = np.array([len(n) for n in x])[:, None] + np.array([len(n) for n in y])[None, :]
    ratio = np.divide(2 * _lcs_table(x, y), length, out=np.ones(length.shape), where=length > 0)
    jac = _jaccard_table(*sets)
    equal = np.array([[known[1].get(n, -1)] for n in x]) == np.arange(len(y))[None, :]
    shape = len(a), len(b)
    e_name, j, r = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape)
    for i in range(listed[0].shape[1]):
        for k in range(listed[1].shape[1]):
            at = np.ix_(listed[0][:, i], listed[1][:, k])
            e_name |= equal[at]
            np.maximum(j, jac[at], out=j)
            np.maximum(r, ratio[at], out=r)
    e_label = equal[np.ix_(listed[0][:, 0], listed[1][:, 0])]
    return e_label.astype(np.int32), e_name.astype(np.int32), j, r


def bround(values: np.ndarray, places: int) -> np.ndarray:
    """Half to even of the decimal as printed, like the SQL function; only values close to a tie are printed."""
    scaled = values * 10.0**places
    out = np.rint(scaled)
    close = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if close.any():
        unit = Decimal(1).scaleb(-places)
        tied, back = np.unique(values[close], return_inverse=True)
        out[close] = np.array([int(Decimal(repr(v)).quantize(unit, ROUND_HALF_EVEN).scaleb(places)) for v in tied.tolist()], float)[back]
    return out / 10.0**places
