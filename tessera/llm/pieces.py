"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The public vocabulary file is compiled into parts that are composed with each
input:

* the normaliser puts a blank before the text and maps blanks to the piece
  mark (the only normalisation supported, so decoding is exact);
* the piece transducer reads characters along the prefixes of pieces and
  writes a piece at a weight, its negative score;
* byte fallback maps a character without a piece to its bytes' pieces;
* for a byte-pair vocabulary a neighbour acceptor remembers the last piece and
  gives a next one weight 0 or, if merging by rank would have joined across
  their border, infinity. That is read off the two pieces' merge trees: along
  the border every part lives from the rank that forms it to the rank that
  takes it in, and two parts alive at once whose union is a piece would merge.

The composition is a lattice over positions, and the encoding its shortest
path in the tropical semiring: weights add along a path and the least sum wins.
With a byte-pair vocabulary just one path to each position is finite, so one
state a position holds both kinds of vocabulary. Unigram weights alone take the
same path without the acceptor.

No piece crosses from a word into blanks, so the lattice of a text falls apart
at blanks and line ends. A slice of a column is cut into such units as one
byte buffer; only units not met before are composed, and ids and decoded bytes
of the slice are gathered from tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._words import U64, SortedHash, buffers, range_hashes, slices, text_array
from tessera.llm._worker import held, task

MARK = "▁"
SLICE_BYTES = 1 << 20
#: Units that a worker remembers (the first met, which are the frequent ones) and answers about neighbours.
UNITS, NEIGHBOURS = 250_000, 400_000
#: Units up to so many characters are composed together, so many at a time.
TOGETHER, BLOCK = 64, 4096
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNIGRAM, BPE = 1, 2, 3, 4, 6, 1, 2
_NONE = float("inf")


class PieceTransducer:
    """Normaliser, pieces, byte fallback and neighbour acceptor of one vocabulary file."""

    def __init__(self, vocabulary: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(vocabulary, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only vocabularies with identity normalisation are supported")
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair vocabularies are supported")
        self.ids: dict[str, int] = {}
        self.cost: list[float] = []
        self.bytes_of = [b""] * len(model.pieces)
        self.byte_ids = [-1] * 256
        for k, p in enumerate(model.pieces):
            self.cost.append(-p.score)
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = k
                self.bytes_of[k] = bytes([value])
            elif p.type in (NORMAL, USER):
                self.ids[p.piece] = k
                self.bytes_of[k] = p.piece.replace(MARK, " ").encode()
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary has no byte fallback")
        if "\n" in "".join(self.ids) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross blanks or line ends")
        self.prepare()

    def prepare(self) -> None:
        """What follows from ``ids`` and ``cost``."""
        self.text_of = {k: p for p, k in self.ids.items()}
        self.prefixes = {p[:k]: 0 for p in self.ids for k in range(1, len(p) + 1)}  # states of the piece transducer
        for state, p in enumerate(self.prefixes, 1):
            self.prefixes[p] = state
        arcs = np.array([(self.prefixes.get(p[:-1], 0) << 21 | ord(p[-1])) for p in self.prefixes], U64)
        self.arcs = SortedHash(arcs)
        self.to = (self.arcs.order + 1).astype(np.int64)
        self.writes = np.full(len(self.prefixes) + 1, -1, np.int64)  # the piece that a state may write
        for p, k in self.ids.items():
            self.writes[self.prefixes[p]] = k
        self.weight = np.array(self.cost)
        self.trees: dict[str, tuple[str, str] | None] = {}
        self.borders: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        self.fits: dict[int, bool] = {}
        self.plain = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.known: dict[int, int] = {}  # units met, and their place in the table
        self.starts, self.sizes, self.pieces = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # --- neighbour acceptor of a byte-pair vocabulary ---

    def tree(self, piece: str) -> tuple[str, str] | None:
        """The last merge that gives a piece from its characters; None for a character, and for a piece that merging never gives."""
        if piece not in self.trees:
            parts = list(piece)
            last = None
            queue = [(self.cost[self.ids[x + y]], a, x + y) for a, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.ids]
            heapq.heapify(queue)
            after = [*range(1, len(parts)), -1]
            before = list(range(-1, len(parts) - 1))
            alive: list[str | None] = list(parts)
            while queue:
                _, a, joined = heapq.heappop(queue)
                b = after[a]
                if alive[a] is None or b < 0 or alive[a] + alive[b] != joined:
                    continue
                last = (alive[a], alive[b])
                alive[a], alive[b] = joined, None
                after[a] = after[b]
                if after[a] >= 0:
                    before[after[a]] = a
                for x, y in ((before[a], a), (a, after[a])):
                    if x >= 0 and y >= 0 and alive[x] + alive[y] in self.ids:
                        heapq.heappush(queue, (self.cost[self.ids[alive[x] + alive[y]]], x, alive[x] + alive[y]))
            self.trees[piece] = last if alive[0] == piece else None
        return self.trees[piece]

    def border(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """Parts of a piece along its right (1) or left (0) border, with the ranks that form them and take them in."""
        found = self.borders.get((piece, side))
        if found is None:
            found, part, taken = [], piece, _NONE
            while True:
                split = self.tree(part) if len(part) > 1 else None
                formed = self.cost[self.ids[part]] if len(part) > 1 else -_NONE
                found.append((part, formed, taken))
                if split is None:
                    break
                part, taken = split[side], formed
            self.borders[piece, side] = found
        return found

    def accepts(self, left: int, right: int) -> bool:
        """Whether two pieces may stand side by side; ``left`` is -1 at the start."""
        key = left << 24 | right
        found = self.fits.get(key)
        if found is None:
            own = self.text_of[right]
            found = len(own) == 1 or self.tree(own) is not None
            if found and left >= 0:
                for x, x_formed, x_taken in self.border(self.text_of[left], 1):
                    for y, y_formed, y_taken in self.border(own, 0):
                        k = self.ids.get(x + y)
                        if k is not None:
                            at = max(self.cost[k], x_formed, y_formed)
                            if at < x_taken and at <= y_taken:  # of equal ranks the left one merges first
                                found = False
                                break
                    if not found:
                        break
            if len(self.fits) >= NEIGHBOURS:
                self.fits.clear()
            self.fits[key] = found
        return found

    # --- composition and shortest path ---

    def shortest_path(self, text: str) -> list[int]:
        """Pieces of the least sum of weights for a stretch whose characters all have pieces."""
        n, ids, cost, prefixes, fits = len(text), self.ids, self.cost, self.prefixes, self.fits
        free = self.kind == UNIGRAM
        least, last, origin = [0.0] + [_NONE] * n, [-1] * (n + 1), [0] * (n + 1)
        for a in range(n):
            here, left = least[a], last[a]
            if here == _NONE:
                continue
            for b in range(a + 1, n + 1):
                part = text[a:b]
                if part not in prefixes:
                    break
                k = ids.get(part)
                if k is not None and here + cost[k] < least[b]:
                    ok = free or fits.get(left << 24 | k)
                    if ok or ok is None and self.accepts(left, k):
                        least[b], last[b], origin[b] = here + cost[k], k, a
        if least[n] == _NONE:
            raise ValueError(f"no path for {text[:100]!r}")
        out, at = [], n
        while at:
            out.append(last[at])
            at = origin[at]
        return out[::-1]

    def compose(self, unit: str) -> list[int]:
        """Pieces of a unit: blanks as the mark, characters without a piece (and the mark itself) as bytes."""
        out: list[int] = []
        stretch: list[str] = []
        for c in unit:
            if c == " ":
                stretch.append(MARK)
            elif c in self.ids and c != MARK:
                stretch.append(c)
            else:
                if stretch:
                    out += self.shortest_path("".join(stretch))
                    stretch.clear()
                out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        if stretch:
            out += self.shortest_path("".join(stretch))
        return out

    def compose_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``compose`` of short units, together: one relaxation for all arcs of a length from a position on; ids and their number."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[codes == ord(MARK)] = 0x110000  # the mark itself has no piece
        codes[codes == 32] = ord(MARK)
        lengths = np.array([len(u) for u in units], np.int64)
        n = int(lengths.max())
        begin = np.cumsum(lengths) - lengths
        spot = np.arange(n + 1)
        padded = np.where(spot < lengths[:, None], codes[np.minimum(begin[:, None] + spot, len(codes) - 1)], -1)
        least = np.full((len(units), n + 1), _NONE)
        least[:, 0] = 0
        last, origin = np.full((len(units), n + 1), -1, np.int64), np.zeros((len(units), n + 1), np.int64)
        for a in range(n):
            at = np.flatnonzero((lengths > a) & (least[:, a] < _NONE))
            here, left, state = least[at, a], last[at, a], np.zeros(len(at), np.int64)
            for b in range(a + 1, n + 1):
                char = padded[at, b - 1]
                arc = self.arcs.find((state << 21 | np.maximum(char, 0)).astype(U64))
                go = (arc >= 0) & (char >= 0)
                if b == a + 1 and not go.all():  # byte fallback; its bytes stand for the character until the end
                    lost = at[~go]
                    least[lost, b], last[lost, b], origin[lost, b] = here[~go], -2 - char[~go], a
                if not go.any():
                    break
                at, here, left, state = at[go], here[go], left[go], self.to[arc[go]]
                piece = self.writes[state]
                total = here + self.weight[piece]
                better = np.flatnonzero((piece >= 0) & (total < least[at, b]))
                better = better[self._accepts(left[better], piece[better])]
                rows = at[better]
                least[rows, b], last[rows, b], origin[rows, b] = total[better], piece[better], a
        rows, place, found = np.arange(len(units)), lengths.copy(), []
        while len(rows):
            found.append((rows, place, last[rows, place]))
            place = origin[rows, place]
            rows, place = rows[place > 0], place[place > 0]
        row, place, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, row))
        row, ids = row[order], ids[order]
        if (ids == -1).any():
            raise ValueError("no path for a unit")
        spelled = {c: [self.byte_ids[b] for b in (MARK if c == 0x110000 else chr(c)).encode("utf-8", "surrogatepass")] for c in (-2 - np.unique(ids[ids < 0])).tolist()}
        if spelled:
            many = np.ones(len(ids), np.int64)
            for c, own in spelled.items():
                many[ids == -2 - c] = len(own)
            where, row = np.cumsum(many) - many, np.repeat(row, many)
            out = np.repeat(ids, many)
            for c, own in spelled.items():
                for j, piece in enumerate(own):
                    out[where[ids == -2 - c] + j] = piece
            ids = out
        return ids.astype(np.int32), np.bincount(row, minlength=len(units))

    def _accepts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.kind == UNIGRAM or not len(left):
            return np.ones(len(left), bool)
        pairs, which = np.unique(np.maximum(left, -1) << 24 | right, return_inverse=True)
        known = self.fits.get
        answers = [known(p) for p in pairs.tolist()]
        for j, (p, answer) in enumerate(zip(pairs.tolist(), answers, strict=True)):
            if answer is None:
                answers[j] = self.accepts(p >> 24, p & 0xFFFFFF)
        return np.array(answers, bool)[which]

    def encode(self, text: str) -> list[int]:
        """One text."""
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of some pieces; ids that the vocabulary doesn't have are an error."""
        return b"".join([self.bytes_of[k] for k in ids]).decode("utf-8", "replace")[1:]

    # --- columns ---

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, the number of ids of each, and whether decoding them gives the text (null reads as empty)."""
        column = text_array(column)
        # the normaliser's blank; an empty text has no unit
        empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
        data, offsets = buffers(pc.if_else(pa.array(empty), "", pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type))))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(empty), np.int64), np.ones(len(empty), bool)
        begins = np.zeros(len(data), bool)
        blank, line = data == 32, data == 10
        begins[1:] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        distinct, first, which = np.unique(range_hashes(data, start, end), return_index=True, return_inverse=True)
        known = self.known.get
        entry = np.array([known(key, -1) for key in distinct.tolist()], np.int64)
        new = np.flatnonzero(entry < 0)
        pieces, starts, sizes = self.pieces, self.starts, self.sizes
        if len(new):
            more, many = self._compose_new([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            entry[new] = len(starts) + np.arange(len(new))
            starts, sizes, pieces = np.append(starts, len(pieces) + np.cumsum(many) - many), np.append(sizes, many), np.append(pieces, more)
            kept = min(len(new), UNITS - len(self.known))
            if kept > 0:
                self.known.update(zip(distinct[new[:kept]].tolist(), entry[new[:kept]].tolist(), strict=True))
                self.starts, self.sizes = starts[: len(self.known)], sizes[: len(self.known)]
                self.pieces = pieces[: int(self.starts[-1] + self.sizes[-1])]
        starts, sizes = starts[entry][which], sizes[entry][which]
        upto = np.cumsum(sizes)
        ids = pieces[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1])]
        tokens = np.append(0, upto)[np.searchsorted(start, offsets)]
        return ids, np.diff(tokens), self._same(ids, tokens, data, offsets)

    def _compose_new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and their number, in order."""
        many = np.zeros(len(units), np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        lengths = np.array([len(u) for u in units])
        order = np.argsort(lengths, kind="stable")
        short = order[: int((lengths <= TOGETHER).sum())]
        for low in range(0, len(short), BLOCK):
            part = short[low : low + BLOCK]
            ids, sizes = self.compose_many([units[k] for k in part])
            for k, own in zip(part.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                found[k] = own
        for k in order[len(short) :].tolist():
            found[k] = np.array(self.compose(units[k]), np.int32)
        many[:] = [len(x) for x in found]
        return np.concatenate(found), many

    def _same(self, ids: np.ndarray, tokens: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the bytes of each row's pieces are the row's."""
        width = self.width[ids]
        upto = np.append(0, np.cumsum(width))
        decoded = self.plain[np.repeat(self.place[ids] - upto[:-1], width) + np.arange(upto[-1])]
        own = upto[tokens]
        if len(decoded) == len(data) and np.array_equal(own, offsets) and np.array_equal(decoded, data):
            return np.ones(len(offsets) - 1, bool)
        return np.array([np.array_equal(decoded[own[k] : own[k + 1]], data[offsets[k] : offsets[k + 1]]) for k in range(len(offsets) - 1)], bool)


def compiled(vocabulary: str) -> PieceTransducer:
    """The transducer of a file, compiled once in a worker process and kept with what it remembers until another operator runs there."""
    return held("pieces", vocabulary, lambda: PieceTransducer(vocabulary))


_ADDED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def encode(docs: DataFrame, text: str = "text", vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, ids and round_trip (decoding the ids gives the text).

    A null text has null ids, no tokens and round_trip true; an empty one an
    empty list. Rows are independent: repeated rows give repeated results, an
    empty table an empty one; paths of equal weight cannot occur in a
    byte-pair vocabulary, in others the one found first stays. A very long
    text is taken whole, in memory of some times its size. Columns called as
    the three results are replaced.
    """
    carried = [c for c in docs.columns if c != text and c not in _ADDED.fieldNames()]
    schema = T.StructType([*docs.select(*carried).schema.fields, *_ADDED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocabulary)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                ids, sizes, same = machine.encode_column(part.column(text))
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=part.column(text).is_null())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(sizes), lists, pa.array(same)], names=[*carried, *_ADDED.fieldNames()])

    return docs.select(*carried, text).mapInArrow(task("pieces", run), schema)


def decode(frame: DataFrame, ids: str = "ids", vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model", out: str = "text") -> DataFrame:
    """``frame`` with the text that ``ids`` stand for (null for null); bytes that make no text become U+FFFD."""
    carried = [c for c in frame.columns if c != out]
    schema = frame.select(*carried).withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocabulary)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(texts, pa.string())], names=[*carried, out])

    return frame.select(*carried).mapInArrow(task("pieces", run), schema)
