"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cirrostrat.llm import decontaminate, dedup_spans, html, langid, mixing, search, simhash, tokens, toxicity, warc, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp string, part int"


def corpus():
    rng = random.Random(4)
    vocab = [a + b for a in "the an er on re st".split() for b in ("", "ou", "ing", "é")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = text(60)
    rows = [(i, text(rng.randint(1, 90)), rng.choice("ab")) for i in range(30)]
    rows += [(30, None, None), (31, "", "a"), (32, " \n\t ", "b"), (33, shared, "a"), (34, "x " + shared + " y", "b"), (35, shared, None), (35, shared, None), (36, shared.upper(), "a"), (None, "lost " + shared, "b"), (37, "loop " * 50, "a"), (38, text(3000), "b")]
    return [(i, t, "en", s, 0, 1, "k", "f", 2) for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_substrings(spark, docs):
    distinct = sorted({(r[0], r[1]) for r in corpus()}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, expected = set(), {}
    for i, t in distinct:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone |= set(range(k, k + 20))
            seen.add(x)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = dedup_spans.substring_dedup(docs).collect()
    assert len(got) == len(corpus())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    assert dedup_spans.substring_dedup(docs.limit(0)).count() == 0


def test_substrings_in_many_chunks(spark, monkeypatch):
    """A passage in every chunk of every task and group, with chunks of some twenty words."""
    monkeypatch.setattr(dedup_spans, "chunks", lambda texts: iter([(i, i + 1) for i in range(len(texts))]))
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefghijklmnop") + str(k) for k in range(33))
    rows = [(rng.randrange(-500, 10**6), " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))) + " " + passage + " end") for _ in range(120)]
    seen, expected = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if x in seen else set()
            seen.add(x)
        expected[i] = len(gone)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_removed"] for r in dedup_spans.substring_dedup(df).collect()} == expected


def brute_fp(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs):
    rows = corpus()
    fps = [brute_fp(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    top = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((rows[k][0] is None, rows[k][0] or 0, fps[k], top[group[k]]) for k in range(len(rows)))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_are_complete_also_in_full_cells(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(df).collect()}
    assert got == want

    def parts(pairs):
        g = {x: x for x in fps}
        for a, b in pairs:
            old, new = g[a], g[b]
            g = {k: new if v == old else v for k, v in g.items()}
        return {frozenset(k for k in g if g[k] == v) for v in g.values()}

    monkeypatch.setattr(simhash, "CELL_ROWS", 4)
    again = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(df).collect()}
    assert again <= want and parts(again) == parts(want)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    extra = [(50 + i, x) for i, x in enumerate(["Don't I'LL x's", "<|endoftext|> a<|startoftext|>", "ΣΑΣ İ ﬁ é ²3", "a\x1cb c", "\U0001f600!!"])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = sorted(([(r[0], r[1] or "") for r in both.collect()]), key=lambda r: (r[0] is None, r[0] or 0))
    at, expected = 0, []
    for i, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.tokenized(both, tokens.default_tokenizer()).collect()), key=lambda r: r[1])
    assert got == expected
    assert tokens.tokenized(docs.limit(0), tokens.default_tokenizer()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_wavelet(n):
    ids = np.random.default_rng(n).zipf(1.4, n).clip(max=70_000).astype(np.uint32)
    m, doc_ids, lengths = wavelet.load(wavelet.dump(wavelet.WaveletMatrix.build(ids), [5, None], np.array([n, 0])))
    assert doc_ids == [5, None] and lengths.tolist() == [n, 0] and np.array_equal(m.decode(), ids)
    for i in range(0, n, 611):
        assert m.access(i) == ids[i] and m.rank(ids[i], i) == (ids[:i] == ids[i]).sum()
        assert m.select(ids[i], m.rank(ids[i], i)) == i
    assert m.count(99_999) == 0 and (not n or m.occurrences(int(ids[0]))[:50] == np.flatnonzero(ids == ids[0])[:50].tolist())


def test_warc(spark):
    rows = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "u\r\nX: y", ""), (4, "v", None), (4, "v", None), (None, "w", "<p>x"), (5, "é", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, key string")
    archive = warc.write_archive(pages)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.index(archive).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {1: (4, digest("<p>x"), "revisit", 2), 2: (4, digest("<p>x"), "response", None), 3: (0, digest(""), "revisit", 4), 4: (0, digest(""), "response", None), None: (4, digest("<p>x"), "revisit", 2), 5: (140_000, digest("é" * 70_000), "response", None)}
    assert archive.payloads.count() == 3
    record = [bytes(r["record"]) for r in warc.reconstruct(archive).where("page_id = 2").collect()][0]
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n<p>x\r\n\r\n")
    assert warc.index(warc.write_archive(pages.limit(0))).count() == 0


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    sizes = {}
    for r in corpus():
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert sum(r["__size"] for r in own) == sizes[s] and abs(sum(r["__taken"] for r in own) - own[0]["__target"]) <= 1
    assert all(0 <= r["__taken"] <= 3 * r["__size"] for r in out) and len(out) == len(corpus())
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in texts.collect()) == sum(r["__taken"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = mixing.mix(docs.withColumnsRenamed({"size": "__size", "key": "__no"}))
    assert clash.columns == [*(c if c not in ("size", "key") else {"size": "__size", "key": "__no"}[c] for c in docs.columns), "__size_", "__source_size", "__target", "__taken", "__from"]
    assert sum(r["__size_"] for r in clash.collect()) == sum(sizes.values())
    assert mixing.targets(np.array([10, 1, 100]), np.array([1.0, 3.0, 2.0])).tolist() == [30.0, 3.0, 78.0]


def test_sainte_lague_matches_quotients():
    rng = np.random.default_rng(3)
    for _ in range(50):
        votes, most = rng.integers(0, 500, 6), rng.integers(0, 30, 6)
        seats, given = int(rng.integers(0, 60)), np.zeros(6, dtype=int)
        for _ in range(seats):
            q = np.where((given < most) & (votes > 0), votes / (2.0 * given + 1), -1.0)
            if q.max() < 0:
                break
            given[int(np.argmax(q))] += 1
        assert mixing.sainte_lague(votes, seats, most).tolist() == given.tolist()


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, sentence(25)) for i in range(6)] + [(6, "tiny"), (7, None), (8, "")]
    rows = []
    for d in range(60):
        t = items[d % 6][1]
        cut = list(t)
        for _ in range(d // 6):
            k = rng.randrange(len(cut))
            cut[k : k + 1] = rng.choice([[], ["z"], [cut[k], "q"]])
        rows.append((d, sentence(20) + "! " + "".join(cut).upper() + " -- " + sentence(400 if d == 1 else 20)))
    rows += [(100, None), (101, ""), (102, sentence(100)), (103, "a TINY one"), (103, "a TINY one")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in rows:
        for i, x in items:
            n, m = decontaminate.normal(t), decontaminate.normal(x)
            if len(m) >= decontaminate.Q and n:
                e = edit_distance_in(m, n)
                if e <= decontaminate.budget(len(m)):
                    want[d, i] = e
            elif m and f" {m} " in f" {n} ":
                want[d, i] = 0
    got = decontaminate.leaks(docs, bench, chunk_chars=300).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(got) == len(want) + 1
    clean = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()


def test_lexicon_is_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng, terms = random.Random(7), ["moron", "worthless", "trash", "scum"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(1, len(w)) if len(w) > 1 else 0
            w[k : k + 1] = rng.choice([[], ["x"], [w[k], "é"]])
        w = "".join(w)
        near = [t for t in terms if distance(w, t) <= toxicity.Lexicon.budget(t) and (w == t or w[:1] == t[0])]
        found = lexicon.match(w)
        assert (found is None) == (not near) and (found is None or distance(w, found[0]) == found[1])


def test_toxicity(spark):
    rows = [(i, "you are an idiot and trash" if i % 3 == 0 else "a fine day", i) for i in range(60)] + [(None, "scum", 0), (100, None, 0), (101, "", 0), (102, "such a m0ron", 0), (103, 'he said "idiot" once', 0), (102, "such a m0ron", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i]["predicted"] == (i % 3 == 0) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))
    assert [got[i]["predicted"] for i in (None, 100, 101, 102, 103)] == [1, 0, 0, 1, 0] and not got[None]["held_out"]
    kept = toxicity.keep_clean(docs, toxicity.PRIOR)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i in range(60) if i % 3} | {100, 101, 103}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_learned_terms(spark):
    """A coinage that labels mark is learned; the words of a toxic text that has many copies aren't."""
    rng = random.Random(11)
    vocab = [a + b + c for a in "the an er on re st".split() for b in ("ou", "ing", "é", "al") for c in ("da", "mo", "ne")]
    rows, toxic = [], {}
    for i in range(600):
        words = rng.choices(vocab, k=40)
        toxic[i] = int(i % 6 == 0)
        for k in rng.sample(range(40), 3) if toxic[i] else []:
            words[k] = rng.choice(["zorblat", "Kwimpel"])
        rows.append((i, " ".join(words)))
    copied = " ".join(f"copied{c}" for c in "abcdefghij")
    rows += [(i, copied) for i in range(600, 700)]
    toxic |= dict.fromkeys(range(600, 700), 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    assert model.learned == ("kwimpel", "zorblat")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == toxic[i] for i in range(600))
    assert {r[0] for r in toxicity.keep_clean(docs, model).collect()} >= {i for i in range(600) if not toxic[i]}
    matcher = toxicity.Matcher(["moron"], ("zorblat",))
    assert matcher.match("moron") == (False, "moron", 0) and matcher.match("zorblat") == (True, "zorblat", 0) and matcher.match("zorblxt") == (True, "zorblat", 1) and matcher.match("zebra") is None


def test_langid(spark):
    en, fr = "the quick thing with that thought", "été où très élève français"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(80)] + [(200, None, "en"), (201, "", None), (202, "12 !!", "fr"), (None, en, "fr"), (203, en * 500, None), (1, en, "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(80))
    assert [got[i]["lang_pred"] for i in (200, 201, 202, None, 203)] == ["und", "und", "und", "en", "en"]
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text.<p>Second<br>third 5 < 6.</p><form><p>Sign up</p></form>
<div class="comments"><p>Nice post!</p></div></article></main><aside><p>More to read here</p></aside><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Head & line\nFirst bold text.\nSecond\nthird 5 < 6."
    plain = "<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>" + "word " * 30 + "</p><p>" + "more " * 20 + "</p><div id=footer>bye</div>"
    assert html.main_text(plain) == ("word " * 30).strip() + "\n" + ("more " * 20).strip()
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, "", "t"), (None, "x", "<article>cut &am", "t"), (5, "l", "<article><p>" + "é " * 100_000, "t")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 7, len("Head & line\nFirst bold text.\nSecond\nthird 5 < 6."), 199_999]
    assert html.extract(pages.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(150, 64))
    vectors[20:60] = vectors[7]
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(vectors)] + [(500, None, 0), (None, [1.0] * 64, 0), (400, [1.0, None], 0), (401, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int")
    codes = df.select(F.col("vec_id").alias("id"), search.code(F.col("embedding")).alias("code"))
    got = {}
    for r in search.top_k(codes, codes.where("id in (7, 100, 500)").withColumnRenamed("id", "query_id")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["id"])
    bits = {i: sum(1 << k for k, x in enumerate(v or []) if x is not None and x > 0) for i, v, _ in rows if i is not None and v is not None and None not in v}
    for q in (7, 100):
        want = sorted(((bits[q] ^ b).bit_count(), i) for i, b in bits.items())[:10]
        assert [got[q][k] for k in range(1, 11)] == want
    assert search.segments(150)[-1] == (56, 8) and search.segments(1 << 33) == [(0, 32), (32, 32)]
    clash = codes.where("id = 7").select(F.col("id").alias("query_id"), "code", F.lit(1).alias("near"), F.lit(2).alias("q"))
    assert {r["id"] for r in search.top_k(codes, clash).collect()} == {i for _, i in got[7].values()}
    assert 500 not in got and search.top_k(codes.limit(0), codes.limit(0).withColumnRenamed("id", "query_id")).count() == 0
