"""Held-out texts inside a corpus: a broadcast hash set of their word n-grams, scanned for and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.ragged import ranges
from orewright.llm.characters import LETTER, NUMBER, classes
from orewright.functions.texts import code_points, spread, text_slices
from orewright.functions.mixing import mix

#: Words of a window.
WINDOW = 13
#: Characters of held-out text whose n-grams are broadcast at once, at about 10 bytes for each in memory (a word has a hash, a
#: place and a window). Only held-out text beyond this bound takes further blocks, with a scan of the corpus each.
BLOCK_CHARS = 20_000_000


def lower_same_length(text: str) -> str:
    """Lower case; a character whose lower case is not a single character stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Words:
    """The words of texts: runs of letters and digits in lower case, with a hash and the place of each."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = [lower_same_length(text) for text in texts]
        points, lengths = code_points(self.texts)
        offsets = np.cumsum(lengths) - lengths
        inside = np.isin(classes()[points], (LETTER, NUMBER))
        first = np.zeros(len(points) + 1, bool)
        first[offsets] = True
        before = np.concatenate(([False], inside))[:-1] & ~first[:-1]
        start = np.flatnonzero(inside & ~before)
        after = np.append(inside, False)[1:] & ~first[1:]
        end = np.flatnonzero(inside & ~after) + 1
        size = end - start
        at = np.flatnonzero(inside)
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        values = (points[at].astype(np.uint64) + np.uint64(1)) * powers[ranges(size)]
        self.hashes = mix(np.add.reduceat(values, np.cumsum(size) - size).astype(np.int64), 15) if len(start) else np.zeros(0, np.uint64)
        self.text = (np.searchsorted(offsets, start, side="right") - 1).astype(np.int32)
        # empty texts share their offset with the next one; the last of equal offsets is the one that has the word
        self.start, self.end = ((x - offsets[self.text] if len(x) else x).astype(np.int32) for x in (start, end))
        self.count = np.bincount(self.text, minlength=len(texts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of each run of ``size`` words within a text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = np.zeros(n, np.uint64)
        for j in range(size):
            rolled = rolled * np.uint64(0x100000001B3) + self.hashes[j : j + n]
        whole = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return whole, mix((rolled[whole] + np.uint64(size)).astype(np.int64), 16)

    def words(self, first: int, size: int) -> tuple[str, ...]:
        text = self.texts[self.text[first]]
        return tuple(text[self.start[i] : self.end[i]] for i in range(first, first + size))


class Grams:
    """All n-grams of a block of items as sorted hashes with their places, for each length of window."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW) -> None:
        self.ids, self.words = np.array(ids, np.int64), Words(texts)
        own = np.minimum(self.words.count, window)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(own[own > 0]).tolist():
            number, hashes = self.words.windows(size)
            mine = own[self.words.text[number]] == size
            number, hashes = number[mine].astype(np.int32), hashes[mine]
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            self.held[size] = known, np.append(first, len(order)), number[order]

    def hits(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(position of the text, item, first character, end) of every window that is in an item, compared word by word."""
        words, out = Words(texts), []
        for size, (known, first, place) in self.held.items():
            number, hashes = words.windows(size)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = np.flatnonzero(known[at] == hashes)
            times = (first[at[found] + 1] - first[at[found]]).astype(np.int64)
            mine, theirs = np.repeat(number[found], times), place[np.repeat(first[at[found]], times) + ranges(times)]
            for a, b in zip(mine.tolist(), theirs.tolist()):
                if words.words(a, size) == self.words.words(b, size):
                    out.append((int(words.text[a]), int(self.ids[self.words.text[b]]), int(words.start[a]), int(words.end[a + size - 1])))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Grams]:
    """The items in blocks of bounded text; the driver holds one block at a time."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    ids, texts, size = [], [], 0
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text)
        if size > BLOCK_CHARS:
            yield Grams(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Grams(ids, texts, window)


def _report(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                hits = shared.value.hits(texts)
                ids = part.column(0).to_pylist()
                columns = [[ids[h[0]] for h in hits], *[[h[i] for h in hits] for i in (1, 2, 3)]]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "item_id", "start", "end"])

    return run


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, item_id, start, end): every window of words of an item in a document, with its characters.

    A document contains an item if ``window`` consecutive words of the item are consecutive in it, or, for a shorter
    item, all its words are. Items without words, and null ids or texts on either side, have no part. The items are
    broadcast as arrays of hashes, checked against BLOCK_CHARS; one scan of the documents finds all.
    """
    spark = documents.sparkSession
    plain = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    plain, out = spread(plain), None
    for grams in _blocks(items, item_col, item_text, window):
        found = plain.mapInArrow(_report(spark.sparkContext.broadcast(grams)), "id long, item_id long, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "id long, item_id long, start int, end int")


def leaked_items(documents: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(id, item_id) once for each document and item it contains."""
    return leaks(documents, items, **columns).select("id", "item_id").distinct()


def remove_leaks(documents: DataFrame, items: DataFrame, mode: str = "span", id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """``documents`` without leaked text: with ``mode`` "document" without the documents, with "span" without the spans.

    Overlapping spans are cut as one. Documents with a null id or text are kept. All columns are kept as they are.
    """
    hits = leaks(documents, items, id_col, text_col, **columns)
    named = documents.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if mode == "document":
        return named.join(hits.select("id").distinct(), "id", "left_anti").select("row.*")
    if mode != "span":
        raise ValueError("mode is 'span' or 'document'")
    spans = hits.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, found):
            kept, done = [], 0
            for span in own:
                kept.append(text[done : max(done, span["start"])])
                done = max(done, span["end"])
            out.append("".join([*kept, text[done:]]))
        return pd.Series(out, dtype=object)

    clean = named.join(spans.select("id"), "id", "left_anti").select("row")
    dirty = named.join(spans, "id").select(F.col("row").withField(f"`{text_col}`", cut("text", "spans")).alias("row"))
    return clean.unionByName(dirty).select("row.*")
