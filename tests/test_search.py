"""Phrases of text search against enumeration, and network functions over batches."""

import itertools

import pandas as pd
import pytest

from graphloom.functions import network, textsearch


def ends(doc, words, steps):
    """Places where a phrase ends."""
    found = {k for k, w in enumerate(doc) if w == words[0]}
    for w, d in zip(words[1:], steps, strict=True):
        found = {k for k in range(len(doc)) if doc[k] == w and k - d in found}
    return found


@pytest.mark.parametrize("text, words, steps", [("of <-> the", ["of", "the"], [1]), ("of <2> the", ["of", "the"], [2]), ("'a.c' <-> of <3> of", ["a.c", "of", "of"], [1, 3]), ("of <0> of", ["of", "of"], [0]), ("of <-> (the <-> x)", None, None), ("(of | the) <-> x", None, None)])
def test_phrases(spark, text, words, steps):
    docs = [list(d) for n in range(5) for d in itertools.product(["of", "the", "a.c", "x"], repeat=n)] + [["ofthe"], ["of", None, "the"], ["a", "c", "of"], None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k long, doc array<string>").coalesce(1)
    got = {r.k: r.hit for r in df.select("k", textsearch.compile_query(text)(df.doc).alias("hit")).collect()}
    for k, d in enumerate(docs):
        if d is None:
            assert got[k] is None
        elif words:
            assert got[k] == bool(ends(d, words, steps)), d
        elif "|" in text:
            assert got[k] == bool(ends(d, ["of", "x"], [1]) or ends(d, ["the", "x"], [1])), d
        else:
            # The bracket's phrase ends at x, one place behind of.
            assert got[k] == bool(ends(d, ["of", "x"], [1]) & ends(d, ["the", "x"], [1])), d


def test_a_phrase_reads_the_document_once(spark):
    df = spark.createDataFrame([("Of the day",)], "text string")
    plan = lambda q: df.select(textsearch.compile_query(q)(textsearch.words(df.text)).alias("hit"))._jdf.queryExecution().analyzed().toString()
    assert plan("of <-> the").count("split(") == 1
    # In general once for each word, and never inside the lambda of another.
    assert "array_contains" not in plan("(of | a) <-> the") and df.select(textsearch.compile_query("(of | a) <-> the")(textsearch.words(df.text)).alias("hit")).first().hit


def test_equal_addresses_of_a_batch_are_computed_once():
    calls = []

    def f(x):
        calls.append(x)
        return network._inet(x)

    got = network._mapped("string", f).func(pd.Series(["10.0.0.1/24", None, "no", "10.0.0.1/24", "::1"] * 50))
    assert got.tolist()[:5] == ["10.0.0.1/24", None, None, "10.0.0.1/24", "::1"] and len(calls) == 3
    pair = network._mapped("boolean", lambda a, b: network._within(True)(a, b)).func
    assert pair(pd.Series(["10.0.0.1/24", "10.0.0.1", None]), pd.Series(["10.0.0.0/16"] * 3)).tolist() == [True, True, None]
