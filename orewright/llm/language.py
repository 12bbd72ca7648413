"""Languages of documents and of their segments: a mixture of n-gram models fitted to each document.

A document is cut into sentences, and a sentence where its words change from one language to another. Each language gives every sentence a likelihood from the character n-grams of its
words; expectation-maximisation estimates the document's language proportions, and languages are dropped one at a
time for as long as the penalised likelihood gains by it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.functions.texts import spread, text_slices

#: Lengths of n-grams within a word and its borders, hashed counters of a model, and its smoothing.
LENGTHS, BUCKETS, SMOOTHING = (1, 2, 3, 4, 5), 1 << 16, 0.3
#: Most that one word can speak for one language against another, in nats; and what a language costs a document.
WORD_LIMIT, PENALTY = 12.0, 14.0
#: What another language within a sentence must gain, in nats, for the sentence to be cut.
SPLIT = 40.0
#: Words that a sentence needs (unless it is a whole short one), and consecutive ones that count as prose.
LEAST_WORDS, LEAST_RUN = 5, 5
#: Words that a sentence with no such run needs for each token that isn't prose; program code has fewer than two.
WORDS_PER_BREAK = 3
#: Labelled samples that a model is trained on at most (the smallest ids).
MAX_SAMPLES = 10_000
#: Tokens whose words a worker keeps before it starts anew.
CACHE = 300_000

SENTENCE_END = re.compile(r"[.!?…。]+[\"'”’»)\]]*(?=\s|$)")
TOKEN = re.compile(r"\S+")
QUOTE = re.compile("[\"“”„«»]")
# Format characters, which are not seen (soft hyphen, zero-width and direction marks, byte order mark).
FORMAT = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
OUTER = "\"'“”‘’«»„(),.;:!?…¿¡>-–—"
# Characters of markup around words; alone they are operators or rules, not prose.
MARKUP = "*_`~[]"
SEGMENTS = "id long, label string, segment int, start int, end int, lang string, confidence double"
LANGUAGES = "id long, label string, lang string, confidence double, sentences int"

# Other forms of the languages' labels (two- and three-letter codes, English and own names).
FORMS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "sv": ["sv", "swe", "swedish", "svenska"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "ru": ["ru", "rus", "russian", "русский"],
}


def _grams(word: str) -> np.ndarray:
    """Hashed n-grams of a word with its borders."""
    points = np.frombuffer(f" {word} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, rolled = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(1)
        if n in LENGTHS:
            out.append((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(out).astype(np.int64)


class Model:
    """Log-probabilities of hashed n-grams by language, and the words met so far with their evidence.

    A token is a tuple of word numbers (empty for a number, which says nothing) or None, if it isn't prose.
    """

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table
        self.forget()

    def __reduce__(self):
        return Model, (self.languages, self.table)

    def forget(self) -> None:
        self.tokens: dict[str, tuple[int, ...] | None] = {}
        self.numbers: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def token(self, token: str) -> tuple[int, ...] | None:
        """The words of a token that is new: letters only, with punctuation and markup around them and hyphens or apostrophes inside."""
        bare = (token.strip(OUTER + MARKUP) or token.strip(OUTER)).replace("’", "'")
        plain = bare.replace("'", "").replace("-", "")
        if plain.isalpha():
            words = tuple(self._number(word) for word in bare.lower().split("-"))
        else:
            words = None if plain and not plain.replace(",", "").replace(".", "").isdigit() else ()
        self.tokens[token] = words
        return words

    def _number(self, word: str) -> int:
        number = self.numbers.get(word)
        if number is None:
            number = self.numbers[word] = len(self.rows)
            grams = _grams(word)
            score = sum(self.table[grams[at : at + 10_000]].sum(axis=0) for at in range(0, len(grams), 10_000))
            self.rows.append(np.maximum(score - score.max(), -WORD_LIMIT))
        return number

    def evidence(self, numbers: list[int]) -> np.ndarray:
        """For each word its evidence for each language: 0 for the likeliest, never below -WORD_LIMIT."""
        return np.array(self.rows, np.float32)[numbers]


def train(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "sample_id", most: int = MAX_SAMPLES) -> Model:
    """A model from labelled samples, of which the ``most`` smallest ids are used; that bound keeps them in the driver."""
    rows = samples.select(id_col, lang_col, text_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(id_col).limit(most).collect()
    languages = sorted({row[1] for row in rows})
    counts = np.full((BUCKETS, max(1, len(languages))), SMOOTHING)
    reader = Model(languages, np.zeros((BUCKETS, max(1, len(languages))), np.float32))
    for _, lang, text in rows:
        sentences(reader, text)
        words = list(reader.numbers)
        for _, _, numbers, _ in sentences(reader, text):
            for number in numbers:
                np.add.at(counts, (_grams(words[number]), languages.index(lang)), 1.0)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _said(text: str) -> bool:
    """Whether a few words say something: all in capitals, or any after the first in lower case, as names aren't; none quoted."""
    return not QUOTE.search(text.strip().strip(OUTER + MARKUP)) and (text.isupper() or any(raw.strip(OUTER + MARKUP)[:1].islower() for raw in text.split()[1:]))


def sentences(model: Model, text: str) -> list[tuple[int, int, list[int], list[int]]]:
    """(start, end, words of prose, their places) of each sentence.

    A sentence ends with its punctuation before white space; a line end alone doesn't end it. A token with anything but
    letters inside breaks a run of prose, a number doesn't, and short runs, such as lie in program code and quoted
    names, are left out. A sentence of short runs only counts as a whole, if it has enough words for its other tokens;
    one of two to four words counts if it ends with its punctuation, has no other tokens, isn't made of names and quotes nothing.
    """
    known, out, start = model.tokens, [], 0
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    closed = set(ends)
    ends.append(len(text))
    tokens = TOKEN.finditer(text)
    match = next(tokens, None)
    for stop in ends:
        words, places, run, at = [], [], [], []
        short, short_at, breaks = [], [], 0
        while match is not None and match.start() < stop:
            raw, place = match.group(), match.start()
            match = next(tokens, None)
            found = known.get(raw, 0)
            if found == 0:
                found = model.token(raw)
            if found:
                run += found
                at += [place] * len(found)
            elif found is None:
                if len(run) >= LEAST_RUN:
                    words += run
                    places += at
                else:
                    short += run
                    short_at += at
                breaks += 1
                run, at = [], []
        if len(run) >= LEAST_RUN:
            words += run
            places += at
        elif not words and len(short) + len(run) >= WORDS_PER_BREAK * breaks:
            words, places = short + run, short_at + at
        if len(words) >= LEAST_WORDS or len(words) > 1 and not breaks and stop in closed and _said(text[start:stop]):
            out.append((start, stop, words, places))
        start = stop
    return out


def _normal(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", FORMAT.sub("", text))


def mixture(evidence: np.ndarray, docs: np.ndarray, n: int, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by document, posterior by sentence) after dropping languages by penalised likelihood.

    ``evidence`` has the log-likelihoods of each sentence, ``docs`` its document (sorted). In each round every document
    with a language whose absence costs less likelihood than the penalty loses the cheapest such language.
    """
    k = evidence.shape[1]
    open_ = np.ones((n, k), bool)
    count = np.bincount(docs, minlength=n)[:, None]
    cost = PENALTY + 0.5 * np.log(np.maximum(count[:, 0], 1))
    likely = np.exp(evidence.astype(np.float64))
    share = np.full((n, k), 1.0 / k)
    for turn in range(k):
        for _ in range(steps):
            weighted = likely * share[docs]
            weighted /= weighted.sum(axis=1, keepdims=True)
            share = np.stack([np.bincount(docs, weighted[:, j], n) for j in range(k)], axis=1)
            share = np.where(open_, (share + 1e-3) / np.maximum(count, 1), 0.0)
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        if turn == k - 1:
            break
        whole = likely * share[docs]
        total = whole.sum(axis=1)
        rest = np.maximum(1 - share, 1e-12)[docs]
        without = np.log(np.maximum(total[:, None] - whole, 1e-280) / rest)
        loss = np.stack([np.bincount(docs, np.log(total) - without[:, j], n) for j in range(k)], axis=1)
        loss = np.where(open_ & (open_.sum(axis=1, keepdims=True) > 1), loss, np.inf)
        worst = loss.argmin(axis=1)
        drop = loss[np.arange(n), worst] < cost
        if not drop.any():
            break
        open_[np.flatnonzero(drop), worst[drop]] = False
        share = np.where(open_, share, 0.0)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    weighted = likely * share[docs]
    return share, weighted / weighted.sum(axis=1, keepdims=True)


def parts(evidence: np.ndarray, opens: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the words of a sentence, cut where the words on both sides speak for different languages.

    A cut needs enough words on either side and more likelihood than one language for the whole: SPLIT nats before a word
    that ``opens`` (has a capital or stands first in a line), half as many more before any other.
    """
    n = len(evidence)
    if n >= 2 * LEAST_WORDS:
        before = np.cumsum(evidence, axis=0)
        cuts = before[LEAST_WORDS - 1 : n - LEAST_WORDS]
        gain = cuts.max(axis=1) + (before[-1] - cuts).max(axis=1) - np.where(opens[LEAST_WORDS : n - LEAST_WORDS + 1], SPLIT, 1.5 * SPLIT)
        best = int(gain.argmax())
        if gain[best] > before[-1].max():
            at = best + LEAST_WORDS
            return parts(evidence[:at], opens[:at]) + [(a + at, b + at) for a, b in parts(evidence[at:], opens[at:])]
    return [(0, n)]


def analyse(model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(document of each sentence, its place, its posterior, its document's proportions)."""
    if len(model.tokens) > CACHE:
        model.forget()
    docs, spans, sizes, flat, held = [], [], [], [], []
    for i, text in enumerate(texts):
        whole = _normal(text) if text else ""
        for start, end, words, places in sentences(model, whole):
            docs.append(i)
            spans.append((start, end))
            sizes.append(len(words))
            flat += words
            held.append((whole, places))
    if not docs:
        return np.zeros(0, np.int64), [], np.zeros((0, len(model.languages))), np.zeros((len(texts), len(model.languages)))
    words = model.evidence(flat)
    starts = np.cumsum(sizes) - sizes
    evidence = np.add.reduceat(words, starts, axis=0)
    # the likelihood of a cut sentence is at most 0, so only sentences that no language explains well can gain
    doubtful = np.flatnonzero(-evidence.max(axis=1) > SPLIT).tolist()
    cut: dict[int, list[tuple[int, int]]] = {}
    for k in doubtful:
        whole, places = held[k]
        own = words[starts[k] : starts[k] + sizes[k]]
        opens = np.array([whole[p].isupper() or "\n" in whole[max(p - 2, 0) : p] for p in places])
        if len(ranges := parts(own, opens)) > 1:
            cut[k] = ranges
    if cut:
        whole_docs, whole_spans, whole_evidence = docs, spans, evidence
        docs, spans, pieces = [], [], []
        for k, (doc, span) in enumerate(zip(whole_docs, whole_spans)):
            places = held[k][1]
            for a, b in cut.get(k, [(0, sizes[k])]):
                docs.append(doc)
                spans.append((places[a] if a else span[0], places[b] if b < sizes[k] else span[1]))
                pieces.append(words[starts[k] + a : starts[k] + b].sum(axis=0) if k in cut else whole_evidence[k])
        evidence = np.stack(pieces)
    docs = np.array(docs)
    # only differences between languages count; they are bounded so that no likelihood becomes 0
    evidence = np.maximum(evidence - evidence.max(axis=1, keepdims=True), -600.0)
    share, posterior = mixture(evidence, docs, len(texts))
    return docs, spans, posterior, share


def _by_segment(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                docs, spans, posterior, _ = analyse(shared.value, texts)
                best = posterior.argmax(axis=1) if len(docs) else docs
                first = np.searchsorted(docs, docs)
                columns = [part.column(0).take(pa.array(docs)), part.column(1).take(pa.array(docs)), pa.array(np.arange(len(docs)) - first, pa.int32())]
                columns += [pa.array([s[i] for s in spans], pa.int32()) for i in (0, 1)]
                columns += [pa.array(names[best].tolist(), pa.string()), pa.array(posterior[np.arange(len(docs)), best], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "segment", "start", "end", "lang", "confidence"])

    return run


def _by_document(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                docs, _, posterior, share = analyse(shared.value, texts)
                own = np.zeros(share.shape, np.int64)
                if len(docs):
                    np.add.at(own, (docs, posterior.argmax(axis=1)), 1)
                at, lang = np.nonzero(own)
                columns = [part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(names[lang].tolist(), pa.string())]
                columns += [pa.array(share[at, lang], pa.float64()), pa.array(own[at, lang], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "lang", "confidence", "sentences"])

    return run


def _plain(documents: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    chosen = documents.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    return spread(chosen.filter("text is not null"))


def segment_languages(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, label, segment, start, end, lang, confidence) of each sentence with enough prose.

    Places count characters of the text in composed form without format characters. Null, empty and blank texts,
    and texts of numbers, symbols or code, have no segment.
    """
    return _plain(documents, id_col, text_col, label_col).mapInArrow(_by_segment(documents.sparkSession.sparkContext.broadcast(model)), SEGMENTS)


def document_languages(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, label, lang, confidence, sentences): each language of each document with its share of the document."""
    return _plain(documents, id_col, text_col, label_col).mapInArrow(_by_document(documents.sparkSession.sparkContext.broadcast(model)), LANGUAGES)


def label_language(label: Column) -> Column:
    """The language that a label names in any form; null for missing labels, placeholders and unknown names."""
    name = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s]+)(?:[-_][a-z0-9]+)*$", 1)
    pairs = [F.lit(x) for lang, forms in FORMS.items() for form in forms for x in (form, lang)]
    return F.element_at(F.create_map(*pairs), name)


def label_cases(documents: DataFrame, model: Model, **columns: str) -> DataFrame:
    """(id, lang): the languages of documents that have several, or whose label is missing or isn't their language."""
    found = document_languages(documents, model, **columns)
    per = found.groupBy("id", F.col("label").alias("label")).agg(F.collect_set("lang").alias("langs"))
    right = F.coalesce(label_language(F.col("label")) == F.get("langs", F.lit(0)), F.lit(False))
    return per.filter((F.size("langs") > 1) | ~right).select("id", F.explode("langs").alias("lang"))
