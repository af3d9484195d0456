"""Dictionaries, packed and in shards, against a loop over all surfaces at all places."""

import random

import pytest
from pyspark.sql import functions as F

from weftnet.operators import extract
from weftnet.operators.dictionary import Matcher, PackedDictionary
from weftnet.operators.extract import Gazetteer
from weftnet.operators.segment import in_rows
from weftnet.plans.pipeline import NetworkPipeline
from weftnet.sources import corpus


def word(c):
    return c.isalnum() or c == "_"


def naive(forms, text, low=str.lower):
    found, at = [], 0
    while at < len(text):
        best = None
        for surface, label in forms:
            end = at + len(surface)
            if low(text[at:end]) == low(surface) and end <= len(text) and not (at and word(text[at - 1])) and not (end < len(text) and word(text[end])) and (best is None or end > best[1]):
                best = (at, end, label)
        if best:
            found.append(best)
        at = best[1] if best else at + 1
    return found


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_against_a_loop(case_sensitive):
    rnd = random.Random(4)
    parts = ["a", "B", "ab", "İ", "i̇", "Σ", "σ", "ς", "ß", "é", " ", " ", "-", ".", "c+", "_", "1", "\n"]
    for _ in range(400):
        surfaces = {s for s in ("".join(rnd.choices(parts, k=rnd.randint(1, 5))).strip() for _ in range(8)) if s}
        by_key = {}
        for s in sorted(surfaces):
            by_key[s if case_sensitive else s.lower()] = f"L{len(by_key) % 3}"
        forms = [(s, by_key[s if case_sensitive else s.lower()]) for s in sorted(surfaces)]
        text = "".join(rnd.choices(parts, k=40))
        low = (lambda s: s) if case_sensitive else str.lower
        starts = [(s, label) for s, label in forms if s[0] != "\u0307"]
        want = naive(starts, text, low)
        assert Matcher(starts, case_sensitive).matches(text) == want, (starts, text)
        assert PackedDictionary(starts, case_sensitive).matches(text) == want, (starts, text)


def test_longer_lower_case(spark):
    docs = corpus.from_texts(spark, ["Ada left İstanbul. İSTANBUL!"])
    g = Gazetteer({"LOC": ["İstanbul"], "PERSON": ["Ada"]})
    want = [(0, 3, "Ada"), (9, 17, "İstanbul"), (19, 27, "İSTANBUL")]
    assert sorted((r.start, r.end, r.text) for r in g.spans(docs).collect()) == want
    assert sorted((r.start, r.end, r.text) for r in g._by_shards(docs, g.shards(100)).collect()) == want
    assert sorted((r.start, r.end, r.text) for r in NetworkPipeline(g).annotate_for_terms(docs)[2].collect()) == want


def test_many_surfaces(spark, monkeypatch):
    """A packed dictionary in one piece and in shards finds what the plain one does, through the whole pipeline."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 5))) for _ in range(300)]
    surfaces = {" ".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(20_000)}
    g = {f"L{k}": [s for i, s in enumerate(sorted(surfaces)) if i % 3 == k] for k in range(3)}
    docs = corpus.from_texts(spark, [" ".join(rnd.choice([w, w.upper()]) for w in rnd.choices(words, k=200)) + ". " for _ in range(20)])
    rows = lambda df: sorted((r.doc_id, r.start, r.end, r.label, r.text) for r in df.collect())
    want = rows(Gazetteer(g).spans(docs))
    assert len(want) > 1000
    monkeypatch.setattr(extract, "WORKER_SURFACES", 100)
    one = Gazetteer(g)
    assert rows(one.spans(docs)) == want and len(one.shards()) == 1 and one.annotate(docs) is not None
    many = Gazetteer(g)
    assert len(many.shards(300_000)) > 3 and many.annotate(docs) is None
    found = many.spans(docs)
    assert rows(found) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    monkeypatch.setattr(extract, "WORKER_SURFACES", 200_000)
    assert sorted(NetworkPipeline(many).run(docs).all_edges.collect()) == sorted(NetworkPipeline(Gazetteer(g)).run(docs).all_edges.collect())


def test_two_million_surfaces_fit_a_worker():
    n = 200_000
    packed = PackedDictionary([(f"Name{i % 5000} of{i}", "X") for i in range(n)], False)
    assert packed.nbytes < 80 * n
    assert packed.matches("name7 of5007, NAME8 of5007 Name8 OF8!") == [(0, 12, "X"), (27, 36, "X")]
