"""Near-duplicate texts, leaks of held-out texts, tokenizer and languages."""

import os
import random
import re

import numpy as np
import pytest

from orewright.functions.texts import code_points, shingle_hashes
from orewright.llm import language, leaks, near_duplicates, tokenizer
from tests.conftest import DATA

EXTRA = "id long, t string, text int, ids int, start int, end int, spans int, label string, n int, row int"


def _texts(spark, texts, parts=3):
    rows = texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "en", 6, 7) for r in rows], EXTRA).repartition(parts)


def _near(texts, t, k=10):
    s = {}
    for i, x in texts:
        if i is not None and x is not None:
            x = x.replace("\r\n", " ")
            s[i] = {x[j : j + k] for j in range(len(x) - k + 1)}
    s = {i: v for i, v in s.items() if v}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b])}


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzåé😀") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for c in range(4):
            own = list(base)
            for _ in range(c * len(base) // 25):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own) + "\r\nthe footer that all files share" * (g % 3 == 0))
    out += [out[0], out[0].replace("\r\n", " "), None, "", "short", "exactly10!", "exactly10!", "a" * 60_000, "a" * 30, "ab" * 40_000 + out[3]]
    return list(enumerate(out)) + [(None, out[0])]


def test_near_duplicates(spark, edited):
    want = _near(edited, 0.6)
    assert {tuple(r) for r in near_duplicates.similar_text_pairs(_texts(spark, edited), "id", "t").collect()} == want
    groups = {r.id: (r.group_id, r.links) for r in near_duplicates.similar_text_groups(_texts(spark, edited), "id", "t").collect()}
    label = {i: i for i, _ in edited if i is not None}
    for _ in range(20):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {i: g for i, (g, _) in groups.items()} == label


def test_signatures_estimate_similarity():
    texts = ["".join(random.Random(1).choices("abcdef", k=900))]
    texts.append(texts[0][:700] + "".join(random.Random(2).choices("abcdef", k=200)))
    groups, hashes = shingle_hashes(texts, 10)
    a, b = (set(hashes[groups == i].tolist()) for i in (0, 1))
    truth = len(a & b) / len(a | b)
    estimates = [np.mean(np.equal(*near_duplicates.signatures(groups, hashes, 2, seed))) for seed in range(30)]
    assert abs(np.mean(estimates) - truth) < 0.02 and np.std(estimates) < 1.3 * (truth * (1 - truth) / near_duplicates.COORDINATES) ** 0.5
    bits = [np.unpackbits(np.bitwise_xor(*near_duplicates.sketches(near_duplicates.signatures(groups, hashes, 2, seed))).view(np.uint8)).mean() for seed in range(30)]
    assert abs(np.mean(bits) - (1 - truth) / 2) < 0.02


def test_shifted_permutation_is_what_is_meant():
    groups, hashes = shingle_hashes(["some text of more than ten characters"], 10)
    size = 1 << near_duplicates.UNIVERSE_BITS
    table = np.random.default_rng(1).permutation(size)
    want = [min((int(table[((h >> (64 - near_duplicates.UNIVERSE_BITS)) + c) % size]), h) for h in hashes.tolist())[1] for c in range(near_duplicates.COORDINATES)]
    assert near_duplicates.signatures(groups, hashes, 1, 1)[0].tolist() == want


def test_long_texts_do_not_meet_by_chance():
    """Sets far larger than the permutation's table still have coordinates of their own."""
    rng = np.random.default_rng(5)
    hashes = np.concatenate([np.sort(rng.integers(0, 2**64, 3 << near_duplicates.UNIVERSE_BITS, np.uint64)) for _ in range(2)])
    groups = np.repeat([0, 1], len(hashes) // 2)
    assert np.equal(*near_duplicates.signatures(groups, hashes, 2, 1)).sum() == 0


def test_no_texts(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short")]):
        df = _texts(spark, rows)
        assert near_duplicates.similar_text_pairs(df, "id", "t").count() == 0
        assert near_duplicates.similar_text_groups(df, "id", "t").count() == len(rows)


ITEMS = [
    (1, "One two three, four five six seven eight nine ten eleven twelve THIRTEEN fourteen."), (2, "Short item, indeed"), (3, ""), (4, None), (None, "null id item here"),
    (5, "Été à l'Île: naïve cœur"), (6, "..."), (7, "short item, indeed"), (8, "a b c d e f g h i j k l m"),
]
DOCS = [
    (1, "x ONE-two\nthree four_five six  seven eight nine ten eleven twelve thirteen y"), (2, "two three four five six seven eight nine ten eleven twelve thirteen FOURTEEN!"),
    (3, "one two three four five six seven eight nine ten eleven twelve"), (4, "a short item; indeed? short ITEM indeed"), (5, "shorts item indeed"), (6, None), (7, ""),
    (8, "été à l île naïve cœur"), (9, "Ete a l ile naive coeur"), (None, "short item indeed"), (10, "a b c d e f g h i j k l m " * 3000), (11, "İ short item indeed"),
    (12, "x" * 300_000 + " short item indeed " + "y " * 100_000),
]


def _items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [1, 20_000_000])
def test_leaks(spark, block, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    words = lambda t: re.findall(r"[^\W_]+", leaks.lower_same_length(t))
    want = set()
    for d, doc in DOCS:
        for i, item in ITEMS:
            if None in (d, i, doc, item):
                continue
            w, x = words(item), words(doc)
            n = min(13, len(w))
            grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            if any(tuple(x[j : j + n]) in grams for j in range(len(x) - n + 1)):
                want.add((d, i))
    got = leaks.leaked_items(_texts(spark, DOCS), _items(spark), id_col="id", text_col="t")
    assert {tuple(r) for r in got.collect()} == want == {(1, 1), (2, 1), (4, 2), (4, 7), (8, 5), (10, 8), (11, 2), (11, 7), (12, 2), (12, 7)}


def test_spans(spark):
    by = dict(DOCS)
    for r in leaks.leaks(_texts(spark, DOCS), _items(spark), "id", "t").filter("item_id = 2").collect():
        assert by[r.id][r.start : r.end].lower().startswith("short") and by[r.id][r.start : r.end].lower().endswith("indeed")


def test_removal(spark):
    df = _texts(spark, DOCS)
    clean = leaks.remove_leaks(df, _items(spark), "span", "id", "t")
    assert clean.columns == df.columns
    got = {r.id: r.t for r in clean.collect()}
    assert got[4] == "a ? " and got[1] == "x  y" and got[2] == "!" and got[10].strip() == "" and got[3] == dict(DOCS)[3] and got[6] is None
    kept = leaks.remove_leaks(df, _items(spark), "document", "id", "t")
    assert kept.columns == df.columns and {r.id for r in kept.collect()} == {3, 5, 6, 7, 9, None}
    with pytest.raises(ValueError):
        leaks.remove_leaks(df, _items(spark), "word", "id", "t")


def test_no_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked_items(_texts(spark, DOCS), none, id_col="id", text_col="t").count() == 0
    assert leaks.leaked_items(_texts(spark, []), _items(spark), id_col="id", text_col="t").count() == 0


TEXTS = [
    None, "", " ", "  a  b ", "it's we'll they've I'd I'm you're don't 'tis ''s '", "x\n\n  y\t z \r\n", "<|endoftext|> plain", "naïve Zürich — “quotes” 12,345.67½²", "日本語 テスト 한국어", "👩‍💻🇸🇪☕️ a​b",
    "é  　x", "'" * 99, "a" * 70_000, " " * 5000 + "x", "!?" * 4000, "\x1c\x85 ", "it's'll've're", "A'S a'S 're", "﻿start", "0" * 300,
]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokenizer.load_ranks(tokenizer.DEFAULT_VOCABULARY), special_tokens={})


def test_tokenizer(spark, reference):
    df = _texts(spark, TEXTS)
    got = tokenizer.encode(df, "id", "t", offsets=True)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert rows[i].ids == reference.encode_ordinary(text or "")
        sizes = [len(reference.decode_single_token_bytes(t)) for t in rows[i].ids]
        assert rows[i].starts == [sum(sizes[:j]) for j in range(len(sizes))][: len(sizes)] if len(sizes) < 500 else rows[i].starts[-1] == sum(sizes[:-1])
    assert {r.id: r.text for r in tokenizer.decode(got).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_boundaries_for_any_text(reference, block):
    rng = random.Random(block)
    for _ in range(300):
        texts = ["".join(rng.choice("'srevltmd  \n\t\xa0Bé9½😀-_.") for _ in range(rng.randrange(1, 30))) for _ in range(4)]
        points, lengths = code_points(texts)
        found = tokenizer.boundaries(points, np.cumsum(lengths) - lengths, block).tolist()
        import regex

        want, at = [], 0
        for text in texts:
            want += [at + m.start() for m in regex.finditer(reference._pat_str, text)]
            at += len(text)
        assert found == want, texts


def test_cache_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE", 10)
    encode = tokenizer.Encoder(tokenizer.load_ranks(tokenizer.DEFAULT_VOCABULARY))
    text = " ".join(f"wordlike{i}" for i in range(200))
    assert encode([text])[0].tolist() == reference.encode_ordinary(text) and len(encode.cache) <= 10


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/lang_samples.parquet")


def test_language_of_held_out_samples(spark, samples):
    model = language.train(samples.filter("sample_id % 2 = 0"))
    rows = samples.filter("sample_id % 2 = 1").collect()
    df = spark.createDataFrame([(r.sample_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = language.document_languages(df, model).collect()
    right = [r for r in got if r.label == r.lang]
    assert len(right) >= 0.97 * len(rows) and len(got) <= 1.02 * len(rows)


def test_mixed_documents(spark, samples):
    model = language.train(samples)
    by = {}
    for r in samples.orderBy("sample_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    docs, want = [], {}
    langs = sorted(by)
    for i in range(60):
        chosen = random.Random(i).sample(langs, 1 + i % 3)
        parts = [t for lang in chosen for t in random.Random(i).sample(by[lang], 3)]
        docs.append((i, "\n".join(parts) if i % 2 else " ".join(parts).upper(), None if i % 4 == 1 else chosen[0]))
        want[i] = set(chosen)
    code = 'for (i <- 1 to 33) yield (a * i + 96) % p\nint cut = links / 2; // round 53, swaps 94 if (count >= 3) keep += x\ndf.groupBy("band").count()'
    docs += [(100, None, "en"), (101, "", "en"), (102, " \n ", None), (103, "123 456\n78 90", None), (104, code, None), (105, "👍 ½ №", "xx"), (106, f"{by['ru'][0]} {code}", "ru"), (107, by["sv"][0] * 300, "sv")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {}
    for r in language.document_languages(df, model).collect():
        got.setdefault(r.id, set()).add(r.lang)
        assert 0 < r.confidence <= 1
    assert got == want | {106: {"ru"}, 107: {"sv"}}
    cases = {}
    for r in language.label_cases(df, model).collect():
        cases.setdefault(r.id, set()).add(r.lang)
    assert cases == {i: s for i, s in want.items() if len(s) > 1 or i % 4 == 1}
    segments = language.segment_languages(df, model).filter("id < 60").collect()
    for s in segments:
        assert s.lang in want[s.id] and s.start < s.end


@pytest.mark.parametrize("n", [300, 2_000, 20_000])
def test_long_texts_without_sentence_ends(samples, n):
    model, by = language.train(samples), {}
    for r in samples.collect():
        by.setdefault(r.lang, []).extend(re.findall(r"[^\W\d_]+", r.text))
    texts = [" ".join((words * n)[:n]) for _, words in sorted(by.items())]
    docs, _, posterior, share = language.analyse(model, texts)
    assert docs.tolist() == list(range(len(by)))
    assert [model.languages[i] for i in posterior.argmax(axis=1)] == [model.languages[i] for i in share.argmax(axis=1)] == sorted(by)


def test_sentences_of_short_runs(samples):
    model = language.train(samples)
    kept = [
        ("Was wäre *ohne* die 41203 *zusätzlichen* Zeilen von _Galhulfava_ gedruckt worden?", "de"),
        ("*Hur* *många* trianglar räknar ~Kanasada~ *när* [fönstret] *i* `Velzusolka` stängs?", "sv"),
        ("Le lecteur lit [17b] toutes les arêtes a1b2 avant la première purge.", "fr"),
        ("Vi läser alla kanter.", "sv"), ("THE READER IS EMPTY!", "en"), ("Die Kanten fehlen…", "de"),
    ]
    docs, _, posterior, _ = language.analyse(model, [t for t, _ in kept])
    assert [(d, model.languages[p.argmax()]) for d, p in zip(docs, posterior)] == [(i, lang) for i, (_, lang) in enumerate(kept)]
    dropped = ["int cut = links / 2; // round 93, swaps 52", "for (i <- 1 to 58) yield (a * i + 12) % p", "if (count >= sup * 37) keep += item18", "Anna Bergström.", "graphe.", "http://galma.example/run x1", "small world", '"small world" Artikel.']
    assert not len(language.analyse(model, dropped)[0])


def test_long_words_are_scored_whole(samples):
    model = language.train(samples)
    a, b = ("".join(re.findall(r"[^\W\d_]+", " ".join(r.text for r in samples.filter(f"lang = '{lang}'").collect()).lower()))[:n] for lang, n in (("en", 64), ("ru", 2_000)))
    assert model.languages[model.evidence([model._number(a)])[0].argmax()] == "en"
    assert model.languages[model.evidence([model._number(a + b)])[0].argmax()] == "ru"


def test_labels(spark):
    rows = [("EN", "en"), (" en-US ", "en"), ("pt_BR", "pt"), ("Deutsch", "de"), ("fre", "fr"), ("xx", None), ("und", None), ("", None), (None, None), ("no", None), ("zh-Hans-CN", None), ("sv-SE", "sv"), ("en us", None)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "l string, w string").select(language.label_language(F.col("l")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_no_documents(spark, samples):
    model = language.train(samples)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.label_cases(empty, model).count() == language.segment_languages(empty, model).count() == 0
    assert tokenizer.encode(empty, "doc_id", "text").count() == 0


def test_vocabulary_is_not_in_the_repository():
    assert os.path.isabs(tokenizer.DEFAULT_VOCABULARY)
