"""Very long texts and words: pieces of a text, and caches bounded by bytes."""

import random
import tracemalloc

import numpy as np

from cirrostrat.llm import dedup_spans, langid, toxicity


def model(langs=8):
    logs = np.random.default_rng(1).normal(size=(langid.BUCKETS, langs)).astype(np.float32)
    return [f"l{i}" for i in range(langs)], logs, np.log(np.full(langs, 1 / langs))


def test_pieces_have_each_n_gram_of_a_text_once():
    rng = random.Random(2)
    texts = [langid.clean("".join(rng.choice("abc d") for _ in range(n))) for n in (0, 1, 5, 6, 7, 12, 13, 40, 41, 300)]
    whole, starts, ends = langid.grams(texts)
    for size in (1, 2, 3, 7, 1_000):
        parts, owners = langid.pieces(texts, size)
        found, s, e = langid.grams(parts)
        for i in range(len(texts)):
            for order, all_of in zip(found, whole, strict=True):
                got = [b for k, o in enumerate(owners) if o == i for b in order[s[k] : e[k]].tolist()]
                assert got == all_of[starts[i] : ends[i]].tolist()


def test_a_long_text_is_scored_in_bounded_memory_and_as_a_whole():
    langs, logs, prior = model()
    text = "some words of a long text " * 120_000  # 3 M characters
    tracemalloc.start()
    names, scores = langid.predict(["short one", text, None], langs, logs, prior)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    (h1, h2, h3), starts, ends = langid.grams([langid.clean(text)])
    likely = sum(logs[h[: ends[0]]].sum(axis=0, dtype=np.float64) for h in (h1, h2, h3))
    assert names[1] == langs[int((likely + prior).argmax())] and names[2] == "und"
    assert names[0] == langid.predict(["short one"], langs, logs, prior)[0][0]
    p = np.exp((likely / np.sqrt(3 * ends[0]) + prior) - (likely / np.sqrt(3 * ends[0]) + prior).max())
    assert abs(scores[1] - p.max() / p.sum()) < 1e-6


def test_long_words_are_not_kept():
    known = dedup_spans._Hashes()
    long, short = b"x" * 10_000, b"y" * dedup_spans.KEPT_BYTES
    assert known[long] == known[long] != known[short] and set(known) == {short}
    matcher = toxicity.Matcher(toxicity.LEXICON)
    assert matcher.match("z" * 10_000) is None and matcher.match("stupid") is not None
    assert set(matcher.known) == {"stupid"}
