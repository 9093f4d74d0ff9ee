"""Disguised terms whose first letter is changed, and harmless words near a term."""

from cirrostrat.llm import toxicity


def test_first_letters_may_change():
    matcher = toxicity.Matcher(toxicity.LEXICON)
    for word, term in {"1diot": "idiot", "ldiot": "idiot", "!diot": "idiot", "@sshole": "asshole", "$tupid": "stupid", "clowns": "clown", "trashy": "trash"}.items():
        assert matcher.match(word) == (False, term, 1)
        assert toxicity.features(f"you {word}, go", matcher)[0][2] == 1.0
    assert toxicity.features("an *idiot* and $trash", matcher)[1] == [(False, "idiot", 0, False), (False, "trash", 0, False)]
    assert not any(matcher.match(w) for w in ("blown", "rash", "itch", "crown", "apathetic"))


def test_words_of_clean_documents_are_harmless(spark):
    """'oron' is near 'moron', but clean documents use it; 'm0ron' is used by toxic ones."""
    rows = [(i, f"{i} you {'idiot' if i % 2 else 'm0ron'}" if i % 3 == 0 else f"{i} the oron was fine", int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(500, "an oron again"), (501, "such a m0ron"), (502, "what a $tupid 1diot"), (503, 'said "oron"')], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    assert model.harmless == ("oron",)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[d] == y for d, _, y in rows) and [got[d] for d in (500, 501, 502, 503)] == [0, 1, 1, 0]
