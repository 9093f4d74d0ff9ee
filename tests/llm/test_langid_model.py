"""Language ID against a plain naive Bayes model."""

import math
import random

from cirrostrat.llm import langid


def test_prediction_is_naive_bayes(spark):
    """Unequal priors; the class of the highest posterior, from counts made word by word."""
    rng = random.Random(3)
    texts = {"a": "the thing that thinks", "b": "été où très fière", "c": "ein weiß über"}
    rows = [(i, " ".join(rng.choice(texts[x].split()) for _ in range(rng.randint(1, 6))), x) for i, x in enumerate(rng.choices("abc", [90, 6, 4], k=300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs, prior = langid.train(docs)
    counts, n = {x: {} for x in langs}, dict.fromkeys(langs, 0)

    def buckets(text):
        grams, starts, ends = langid.grams([langid.clean(text)])
        return [int(h) for g in grams for h in g[starts[0] : ends[0]]]

    import zlib

    for d, t, x in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            n[x] += 1
            for h in buckets(t):
                counts[x][h] = counts[x].get(h, 0) + 1
    total = {x: sum(counts[x].values()) + 0.1 * langid.BUCKETS for x in langs}
    mixed = [*(t for _, t, _ in rows), "thé", "über the", "ein thing très", "t"]
    for text, got in zip(mixed, langid.predict(mixed, langs, logs, prior)[0], strict=True):
        best = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x].get(h, 0) + 0.1) / total[x]) for h in buckets(text)) for x in langs}
        top = sorted(best.values())[-2:]
        assert got == max(best, key=best.get) or top[1] - top[0] < 1e-3


def test_many_grams_beat_the_prior():
    import numpy as np

    logs = np.full((langid.BUCKETS, 2), -10.0, dtype=np.float32)
    logs[:, 1] += 0.02
    names, scores = langid.predict(["word " * 400], ["often", "rare"], logs, np.log([0.99, 0.01]))
    assert names == ["rare"] and 0 <= scores[0] <= 1
