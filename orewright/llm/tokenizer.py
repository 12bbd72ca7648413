"""Encoding with a public byte-level BPE vocabulary; the pre-tokenizer is an automaton scanned in blocks.

Code points become symbols by class and by a look at what follows; each symbol is a function from automaton states
to states. Composing functions is associative, so blocks of text are composed side by side, their results are
scanned, and a second sweep with the known states of the blocks yields all token boundaries. No regular expression is
used. The slices between boundaries are encoded by pair merging, with a cache.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.ragged import pack
from orewright.llm.characters import SPACE, classes
from orewright.functions.texts import code_points, spread, text_slices
from orewright.session import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Automaton states: at a boundary; within letters, numbers, other characters, white space; after a single blank that
#: the next token takes along; before the last one or two letters of a contraction.
FREE, LETTERS, NUMBERS, OTHERS, BLANKS, TAKEN, LAST, LAST_TWO = range(8)
STATES = 8
#: Symbols: letter, number, other, apostrophe that may open a contraction with one or two letters, white space that has
#: white space or nothing behind it, blank and other white space before something else, and padding.
LET, NUM, OTH, CON_1, CON_2, MID_SPACE, LAST_BLANK, LAST_SPACE, PAD = range(9)
SYMBOLS = 9

# The letters of contractions after an apostrophe.
ONE_LETTER, TWO_LETTERS = ["s", "t", "m", "d"], ["re", "ve", "ll"]

#: Slices that a worker's cache holds before it starts anew.
CACHE = 500_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol * STATES + state; symbols from SYMBOLS on also open a text."""
    step = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    begins = np.ones((2 * SYMBOLS, STATES), bool)

    def rule(symbol: int, to: int, joins: tuple[int, ...], to_joined: int | None = None) -> None:
        step[symbol], begins[symbol, list(joins)] = to, False
        step[symbol, list(joins)] = to if to_joined is None else to_joined

    rule(LET, LETTERS, (LETTERS, TAKEN))
    step[LET, LAST], step[LET, LAST_TWO], begins[LET, [LAST, LAST_TWO]] = FREE, LAST, False
    rule(NUM, NUMBERS, (NUMBERS, TAKEN))
    rule(OTH, OTHERS, (OTHERS, TAKEN))
    rule(CON_1, LAST, (OTHERS, TAKEN), OTHERS)
    rule(CON_2, LAST_TWO, (OTHERS, TAKEN), OTHERS)
    rule(MID_SPACE, BLANKS, (BLANKS,))
    rule(LAST_BLANK, TAKEN, ())
    rule(LAST_SPACE, FREE, ())
    step[PAD], begins[PAD] = np.arange(STATES), False
    step[SYMBOLS:] = step[:SYMBOLS, [FREE]]
    begins[SYMBOLS:] = begins[:SYMBOLS, [FREE]]
    return step.ravel(), begins.ravel()


STEP, BEGINS = _automaton()


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``starts`` are the places where non-empty texts begin."""
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 2, bool)
    first[starts] = True
    first[n:] = True
    out = np.array([LET, NUM, OTH, MID_SPACE], np.uint8)[kind]
    after = np.append(kind, SPACE)[1:]
    last = (kind == SPACE) & (after != SPACE) & ~first[1 : n + 1]
    out[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        one = np.where(first[at + 1], 0, padded[at + 1])
        two = np.where(first[at + 1] | first[at + 2], 0, padded[at + 2])
        out[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = CON_1
        for a, b in TWO_LETTERS:
            out[at[(one == ord(a)) & (two == ord(b))]] = CON_2
    out[starts] += SYMBOLS
    return out


def boundaries(points: np.ndarray, starts: np.ndarray, block: int = 256) -> np.ndarray:
    """The places where a pre-token begins."""
    n = len(points)
    blocks = -(-n // block)
    padded = np.full(blocks * block, PAD, np.uint8)
    padded[:n] = symbols(points, starts)
    columns = np.ascontiguousarray(padded.reshape(blocks, block).T).astype(np.int32) * STATES
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in columns:
        composed = STEP[row[:, None] + composed]
    state = _before(composed)
    out = np.empty((block, blocks), bool)
    for i, row in enumerate(columns):
        place = row + state
        out[i] = BEGINS[place]
        state = STEP[place]
    return np.flatnonzero(out.T.ravel()[:n])


def _before(functions: np.ndarray) -> np.ndarray:
    """The state before each block: an exclusive scan of the blocks' functions by doubling."""
    scanned, shift = functions.copy(), 1
    while shift < len(scanned):
        scanned[shift:] = np.take_along_axis(scanned[shift:], scanned[:-shift], axis=1)
        shift *= 2
    return np.concatenate((np.zeros(1, np.uint8), scanned[:-1, FREE]))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one slice: the pair of lowest rank, the leftmost of equal ones, is joined until no pair has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    end = len(piece)
    begin_after = list(range(1, end + 1))
    begin_before = list(range(-1, end - 1))
    alive = [True] * end
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = begin_after[a]
        if b < end and (rank := ranks.get(piece[a : begin_after[b]])) is not None:
            heapq.heappush(heap, (rank, a, begin_after[b]))

    for a in range(end):
        offer(a)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = begin_after[a] if alive[a] else end
        if b >= end or begin_after[b] != stop:
            continue
        alive[b] = False
        begin_after[a] = stop
        if stop < end:
            begin_before[stop] = a
        offer(a)
        if begin_before[a] >= 0:
            offer(begin_before[a])
    out, a = [], 0
    while a < end:
        out.append(ranks[piece[a : begin_after[a]]])
        a = begin_after[a]
    return tuple(out)


class Encoder:
    """Encodes lists of texts; slices met before come from a cache of bounded size."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.cache = ranks, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        points, lengths = code_points(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(lengths)
        begins = boundaries(points, (ends - lengths)[lengths > 0])
        joined = "".join(texts)
        cuts = [*begins.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        found = list(map(self.cache.get, pieces))
        if None in found:
            found = [self._miss(piece) if ids is None else ids for piece, ids in zip(pieces, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        held = np.concatenate(([0], np.cumsum(sizes)))
        at = held[np.searchsorted(begins, np.concatenate(([0], ends)))]
        return ids, np.diff(at)

    def _miss(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = merge(piece.encode("utf-8", "replace"), self.ranks)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids


def _encode(shared, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        size = np.zeros(max(shared.value.values()) + 1, np.int32)
        for token, rank in shared.value.items():
            size[rank] = len(token)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                ids, counts = encode([text or "" for text in texts])
                groups = np.repeat(np.arange(len(texts)), counts)
                columns = [part.column(0), pack(groups, pa.array(ids), len(texts))]
                if offsets:
                    ends = np.cumsum(size[ids], dtype=np.int64)
                    before = np.concatenate(([0], ends))[np.cumsum(counts) - counts]
                    columns.append(pack(groups, pa.array((ends - size[ids] - np.repeat(before, counts)).astype(np.int32)), len(texts)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "starts"][: len(columns)])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids) and, with ``offsets``, ``starts``: where each token's bytes begin in the UTF-8 text.

    Every row gives a row. Null and empty texts give an empty list, rows with a null id are kept, and text that looks
    like a special token is plain text. The vocabulary is read by the driver and sent to the workers once; its size
    is that of a file of some 50,000 lines.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    plain = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return plain.mapInArrow(_encode(shared, offsets), "id long, ids array<int>" + ", starts array<int>" * offsets)


def decode(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) of (id, ids): the inverse of ``encode``, but for null texts, which come back empty."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(vocabulary).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(shared.value.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")
