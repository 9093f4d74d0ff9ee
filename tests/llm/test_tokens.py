"""The word encoder against the tokenizers library, and ranges of documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from cirrostrat.llm import tokens

ODD = "ῼ İΣσς ǅ ﬁ é é J̌ ǰ Å Å ΑΙ ß ẞ ŉ ª º ² ½ Ⅷ 한 한 ก็ ा ‍ ️ 😀 ͅ ̇ ̨ Ⅳ ʼn Ŀ ĿA ﷺ ꟋꟌ \x85 \xa0   \x1c \x1d '".split(" ")
PLAIN = ["the", "The", "THE", "don't", "I'LL", "it's", "x's", "naïve", "Ärger", "été", "word,", "(word)", "a.b", "3rd", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>a", "!?", "''", "'", ".,;", "x́!", "aª", "ǆ"]


def test_encoder_is_the_tokenizer():
    """220,000 short strings of odd and plain pieces, and of random code points."""
    rng, path = random.Random(8), tokens.default_tokenizer()
    own, theirs = tokens.encoder(path), tokens.TextEncoder(path)
    assert isinstance(own, tokens.WordEncoder)
    pieces = [*ODD, *PLAIN, *" \t\n.?,\"-#@&", *"sStTaAiI"]
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x700), (0x900, 0xE80), (0x1C80, 0x2100), (0x2100, 0x2C00), (0xA640, 0xA800), (0xAC00, 0xAC40), (0x1F300, 0x1F400), (0x10400, 0x10450)]

    def text(n):
        if n % 2:
            return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 7)))
        return "".join(chr(rng.randrange(*rng.choice(blocks))) if rng.random() < 0.7 else rng.choice(" Aa.́ͅ'") for _ in range(rng.randint(1, 9)))

    for start in range(0, 220_000, 20_000):
        texts = [text(n) for n in range(start, start + 20_000)]
        wrong = [t for t, a, b in zip(texts, own.encode(texts), theirs.encode(texts), strict=True) if a != b]
        assert not wrong, [ascii(t) for t in wrong[:5]]


def test_full_table_is_emptied():
    path = tokens.default_tokenizer()
    own, theirs = tokens.WordEncoder(path, table_bytes=2_000), tokens.TextEncoder(path)
    for n in range(20):
        texts = [f"word{n}{k} plain" for k in "abcdefgh"]
        assert own.encode(texts) == theirs.encode(texts)
    assert own.size < 10_000


def test_other_tokenizers_get_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokens.WordEncoder.fits(path) and type(tokens.encoder(path)) is tokens.TextEncoder
    docs = spark.createDataFrame([(1, "Two  words"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.tokenized(docs, path).collect()}
    assert got == {1: len(tokens.TextEncoder(path).tokenizer.encode("Two  words", add_special_tokens=False).ids) + 1, 2: 1}


def test_ranges_are_cut_by_characters(spark, monkeypatch):
    """Ids whose texts differ in length, many rows of one id, nulls; a task with several ranges and files."""
    rng = random.Random(3)
    rows = [(i, "word " * (200 if i < 20 else 2)) for i in range(300)] + [(50, f"text {k} " * 20) for k in range(100)] + [(None, f"null {k}") for k in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    narrow = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.length("text").cast("long").alias("chars"))
    cuts = tokens.range_cuts(narrow, len(rows), 2_000)
    assert 12 < len(cuts) < 25 and np.array_equal(cuts, np.sort(cuts))
    whole = {tuple(r) for r in tokens.tokenized(docs, tokens.default_tokenizer()).drop("file").collect()}
    monkeypatch.setattr(tokens, "MOST_WRITERS", 3)
    monkeypatch.setattr(tokens, "range_cuts", lambda *_: cuts)
    folder, manifest = tokens.write_shards(docs, tokens.default_tokenizer())
    assert manifest.count() == len(cuts) + 1
    assert {tuple(r) for r in tokens.read_shards(spark, folder, manifest).drop("file").collect()} == whole
