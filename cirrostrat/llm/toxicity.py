"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context windows around the hits.

Every word of a text runs through one lazily determinized automaton: its states are sets of (trie node, errors), that
is the product of the trie and a Levenshtein automaton for each term. A term of up to seven letters allows one error, a
longer one two; a misspelling may change any letter, and a sign before a word ('$tupid') may stand for one. For each hit a context window tells quotation (open quote marks around it, or a reporting word shortly
before) from abuse. Hits make a few features a document; a logistic model fitted to a bounded sample of labelled rows,
with prior weights for what the sample doesn't show, turns them into a score.

The lexicon has two parts: fixed terms, and terms learned from the same sample, as labels cover languages and coinages
that no list has. A word is learned where it stands in toxic documents far more often than chance allows
(``LEAST_G2``). Its evidence is the number of different neighbours it has, one pair of neighbours a document, so that
copies of a text count once. Learned terms are features of their own.

Misspellings have harmless neighbours. Beside a fixed list of them, words near a term are harmless that more clean than
toxic documents of the sample use unquoted (``LEAST_CLEAN`` texts at least).

Defined cases: null and empty texts have no hit and get the base score; documents with null ids are never held out nor
learned from; labels that repeat count again in the weights, not in the terms; null labels are left out; without labels
the prior weights stand and no term is learned; rows are independent; extra columns are kept by ``keep_clean`` and
ignored by ``score``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import bounded, remainder, written

MOD, HELD = 5, 0
SAMPLE_DOCS = 20_000
SEED = 3
#: Words whose matches a task keeps, and states of an automaton; a word of more than KEPT_LETTERS is looked at anew.
STATES_KEPT, KEPT_LETTERS = 200_000, 128
#: Learned terms: letters at least, log-likelihood ratio at least. How many there are is bounded by the sample.
LEAST_LETTERS, LEAST_G2 = 4, 20.0
LEAST_CLEAN = 2

# Abusive terms, ordinary words within reach of them, and words that report speech.
LEXICON = """
idiot moron scum trash clown worthless pathetic stupid loser disgusting imbecile dumbass bastard asshole bitch retard
scumbag dickhead moronic idiotic braindead halfwit dimwit vermin jackass lowlife
""".split()
ORDINARY = """
crash brash thrash rash crown blown flown close closer lower poser user laser moan mormon maroon boron scam slum scud
worth pathetically studio sturdy stupor batch birch ditch pitch witch bits beach bench butch hitch regard restart reward
custard mustard dastard petard idiom bitty itch jackals verein vermil termin sum cum apathetic empathetic bathetic
athletic esthetic mirthless
""".split()
CUES = "called calls said says saying word words term quote quoted wrote writes slur insult meaning means".split()

_TOKEN = re.compile(r"\w+(?:[@$*!'’]+\w+)*")
_DISGUISED = re.compile(r"[@$*!]?" + _TOKEN.pattern)
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
WINDOW = 80


class Lexicon:
    """Terms within their error budget of a word: ``match(word)`` gives (term, errors) or None, the nearest term first."""

    def __init__(self, terms: list[str], ordinary: list[str] = ()):
        self.terms = sorted({t.lower() for t in terms if t})
        self.ordinary = frozenset(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for k, term in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = k
        # errors still useful below a node: the largest budget of a term there
        self.most = [0] * len(self.children)
        for k, term in enumerate(self.terms):
            node = 0
            for c in [*term, ""]:
                self.most[node] = max(self.most[node], self.budget(term))
                node = self.children[node].get(c, node)
        self.letters = frozenset("".join(self.terms))
        self._reset()

    @staticmethod
    def budget(term: str) -> int:
        return 1 if len(term) <= 7 else 2

    def _reset(self) -> None:
        self.start = self._closed({0: 0})
        self.moves: dict[tuple, dict] = {}
        self.accepts: dict[frozenset, list[tuple]] = {}

    def _closed(self, least: dict[int, int]) -> frozenset:
        """With the moves that skip a letter of the term; of each node only the fewest errors."""
        todo = list(least.items())
        while todo:
            node, e = todo.pop()
            if least[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < least.get(child, 99):
                    least[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(least.items())

    def _step(self, state: frozenset, c: str) -> frozenset | None:
        least: dict[int, int] = {}
        for node, e in state:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < least.get(child, 99):
                    least[child] = cost
            if e + 1 <= self.most[node] and e + 1 < least.get(node, 99):
                least[node] = e + 1
        return self._closed(least) if least else None

    def match(self, word: str) -> tuple[str, int] | None:
        state = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            row = self.moves.get(state)
            if row is None:
                if len(self.moves) >= STATES_KEPT:
                    self._reset()
                row = self.moves[state] = {}
            if c not in row:
                row[c] = self._step(state, c)
            state = row[c]
            if state is None:
                return None
        if state not in self.accepts:
            ends = sorted((e, self.terms[self.ends[node]]) for node, e in state if self.ends[node] >= 0)
            self.accepts[state] = [(term, e) for e, term in ends if e <= self.budget(term)]
        for term, e in self.accepts[state]:
            if not e or word not in self.ordinary:
                return term, e
        return None


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the term at start:end is mentioned rather than used: inside quote marks opened within the window before
    it on its line and closed after it, or shortly after a reporting word and right behind a quote mark or colon."""
    before, after = text[max(0, start - WINDOW) : start].rpartition("\n")[2], text[end : end + WINDOW].partition("\n")[0]
    for o, c in zip(_OPEN, _CLOSE, strict=True):
        inside = before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c)
        if inside and c in after:
            return True
    words = _TOKEN.findall(before)[-3:]
    return any(w in CUES for w in words) and before.rstrip()[-1:] in (":", *_OPEN)


class Model(NamedTuple):
    """Weights (base, then FEATURES), learned terms, and harmless words near a term."""

    weights: np.ndarray
    learned: tuple[str, ...] = ()
    harmless: tuple[str, ...] = ()


FEATURES = ("any_exact", "log_exact", "any_near", "log_near", "any_quoted", "log_quoted", "any_learned", "log_learned", "log_learned_near")
#: What holds before any label is seen. A quoted term alone stays below one half.
PRIOR = Model(np.array([-3.0, 4.5, 1.0, 3.5, 0.7, 0.5, 0.3, 0.0, 1.5, 0.0]))


class Matcher:
    """The automata of fixed and learned terms, and the words of known outcome."""

    def __init__(self, lexicon: list[str], learned: tuple[str, ...] = (), harmless: tuple[str, ...] = ()):
        self.fixed, self.learned = Lexicon(lexicon, [*ORDINARY, *harmless]), Lexicon(learned, harmless)
        self.known: dict[str, tuple[bool, str, int] | None] = {}

    def match(self, word: str) -> tuple[bool, str, int] | None:
        """(learned, term, errors) or None; a fixed term goes before a learned one, an exact hit before both's near ones. A
        sign before the word is tried as a letter of it and left out."""
        if word in self.known:
            return self.known[word]
        bare = word.lstrip("@$*!")
        hits = [(m[1], is_learned, m[0]) for is_learned, terms in ((False, self.fixed), (True, self.learned)) for w in {bare, word} if (m := terms.match(w))]
        errors, is_learned, term = min(hits, default=(0, False, ""))
        found = (is_learned, term, errors) if hits else None
        if len(word) <= KEPT_LETTERS:
            if len(self.known) > STATES_KEPT:
                self.known.clear()
            self.known[word] = found
        return found


def features(text: str | None, matcher: Matcher) -> tuple[list[float], list[tuple]]:
    """FEATURES of a text and its hits (learned, term, errors, quoted)."""
    if not text:
        return [0.0] * len(FEATURES), []
    lower = text.lower()
    hits = {w: m for w in set(_DISGUISED.findall(lower)) if (m := matcher.match(w))}
    found = [(*hits[m[0]], quoted(lower, m.start(), m.end())) for m in _DISGUISED.finditer(lower) if m[0] in hits] if hits else []
    used = [(is_learned, e > 0) for is_learned, _, e, q in found if not q]
    exact, near, own, own_near = (used.count(kind) for kind in ((False, False), (False, True), (True, False), (True, True)))
    said = sum(q for *_, q in found)
    counts = [v for n in (exact, near, said, own) for v in (float(n > 0), float(np.log1p(n)))]
    return [*counts, float(np.log1p(own_near))], found


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR.weights, strength: float = 1.0) -> np.ndarray:
    """Logistic regression with Gaussian priors around ``prior`` (the base is free), by damped Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, pull = prior.astype(float).copy(), np.diag([1e-3] + [strength] * (len(prior) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull @ (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, gradient)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_terms(sample: DataFrame, lexicon: list[str] = LEXICON) -> tuple[str, ...]:
    """Words of ``sample`` (text, toxic) that mark toxic documents, beside ``lexicon``. Each document gives each of its words once, with the neighbours it has at its first place there."""

    def run(batches):
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _TOKEN.findall((text or "").lower())
                first = {w: i for i, w in reversed(list(enumerate(tokens)))}
                own = {w: i for w, i in first.items() if len(w) >= LEAST_LETTERS and w.isalpha()}
                near = [" ".join((*tokens[i - 1 : i], *tokens[i + 1 : i + 2])) if i else " ".join(("", *tokens[1:2])) for i in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(near, pa.string()), pa.array([toxic] * len(own), pa.int32())], names=["word", "near", "toxic"])

    n = sample.agg(F.count_distinct(F.when(F.col("toxic") > 0, F.col("text"))).alias("a"), F.count_distinct(F.when(F.col("toxic") <= 0, F.col("text"))).alias("b")).first()
    if not n["a"] or not n["b"]:
        return ()
    seen = sample.mapInArrow(run, "word string, near string, toxic int").groupBy("word", F.xxhash64("near").alias("near")).agg(F.max("toxic").alias("toxic"))
    a, b, both, every = F.col("a"), F.col("b"), F.col("a") + F.col("b"), float(n["a"] + n["b"])
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    g2 = 2 * (part(a, both * (n["a"] / every)) + part(b, both * (n["b"] / every)))
    terms = seen.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b"))
    terms = terms.where((a / both > 0.5) & (g2 >= LEAST_G2) & ~F.col("word").isin(list(lexicon)))
    return tuple(sorted(r["word"] for r in terms.select("word").collect()))


def harmless_words(sample: DataFrame, learned: tuple[str, ...], lexicon: list[str] = LEXICON) -> tuple[str, ...]:
    """Words of ``sample`` (text, toxic) within the errors of a term that more clean than toxic texts use unquoted."""

    def run(batches):
        matcher = Matcher(lexicon, learned)
        for batch in batches:
            words, marks, texts = [], [], []
            for n, (text, toxic) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                lower = (text or "").lower()
                near = {w for w in set(_DISGUISED.findall(lower)) if (m := matcher.match(w)) and m[2]}
                used = {m[0].lstrip("@$*!") for m in _DISGUISED.finditer(lower) if m[0] in near and not quoted(lower, m.start(), m.end())} if near else set()
                words += used
                marks += [toxic] * len(used)
                texts += [n] * len(used)
            hashes = batch.column(2).take(pa.array(texts, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int32()), hashes], names=["word", "toxic", "tie"])

    seen = bounded(sample).select("text", "toxic", F.xxhash64("text").alias("tie")).mapInArrow(run, "word string, toxic int, tie long")
    seen = seen.groupBy("word", "tie").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b"))
    kept = seen.where((F.col("b") >= LEAST_CLEAN) & (F.col("b") > F.col("a")))
    return tuple(sorted(r["word"] for r in kept.select("word").collect()))


def train(docs: DataFrame, labels: DataFrame, lexicon: list[str] = LEXICON, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most about ``sample_docs`` labelled documents that aren't held out (that bounds what is broadcast
    and what comes to the driver: ten numbers a document)."""
    usable = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", MOD) != HELD)).select(F.col("doc_id").alias("__id"), "toxic")
    share = min(1.0, sample_docs / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64(F.lit(SEED), F.col("__id")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = bounded(docs).select("doc_id", "text")  # columns of docs may have any other names
    sample = texts.join(F.broadcast(usable), texts["doc_id"] == usable["__id"]).select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = written(sample, "labelled")
    learned = learn_terms(sample, lexicon)
    harmless = harmless_words(sample, learned, lexicon)

    def run(batches):
        matcher = Matcher(lexicon, learned, harmless)
        for batch in batches:
            x = np.array([features(t, matcher)[0] for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], names=["toxic", *FEATURES])

    rows = sample.mapInArrow(run, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).groupBy("toxic", *FEATURES).count().toArrow().to_pandas()
    if not len(rows):
        return PRIOR
    rows = rows.sort_values(["toxic", *FEATURES])
    n = rows["count"].to_numpy()
    return Model(fit(np.repeat(rows[list(FEATURES)].to_numpy(), n, axis=0), np.repeat(rows["toxic"].to_numpy(), n).astype(float)), learned, harmless)


def _scores(texts: list, matcher: Matcher, weights: np.ndarray) -> np.ndarray:
    x = np.array([features(t, matcher)[0] for t in texts]).reshape(-1, len(FEATURES))
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def score(docs: DataFrame, model: Model, lexicon: list[str] = LEXICON) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        matcher = Matcher(lexicon, model.learned, model.harmless)
        for batch in batches:
            s = _scores(batch.column(2).to_pylist(), matcher, model.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder("doc_id", MOD) == HELD, F.lit(False)).alias("held_out")
    return bounded(docs).select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, lexicon: list[str] = LEXICON) -> DataFrame:
    """The rows of ``docs`` that score below one half, as they are."""
    at = docs.columns.index("text")

    def run(batches):
        matcher = Matcher(lexicon, model.learned, model.harmless)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), matcher, model.weights) < 0.5))

    return bounded(docs).mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, train(docs, labels))
