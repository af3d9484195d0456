"""What registered queries write on the way: only the tables that they need."""

import os
import random
from pathlib import Path

import numpy as np
import pytest

from weftnet.functions.tables import names_in, shared_dir
from weftnet.operators import context
from weftnet.operators.align import align_spans, left_uncovered, uncovered_tokens
from weftnet.operators.extract import Gazetteer
from weftnet.operators.segment import sentence_spans, sentences, token_spans, tokens
from weftnet.plans import queries as plans
from weftnet.plans.pipeline import build_network
from weftnet.sources import corpus

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

EDGES = {"mentioned", "named", "entity_id", "entities", "mention_id", "mentions", "histogram"}
WRITTEN = {
    "edges_top_k": EDGES,
    "edges_window1": EDGES,
    "edges_by_label": EDGES,
    "edge_invariants": EDGES,
    "edges_window0": EDGES,
    "edges_inverse": EDGES,
    "edgelist": EDGES,
    "edges_min_weight": EDGES,
    "contexts": EDGES - {"histogram"},
    "documents_summary": {"documents"},
    "bow_buckets": EDGES - {"histogram"},
    "uncovered_counts": set(),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_writes_only_what_it_needs(spark, tmp_path, name):
    os.symlink(DATA, tmp_path / "tables")  # a path of its own, under which no network is kept yet
    at = f"{shared_dir(spark)}/weftnet/{spark.sparkContext.applicationId}"
    before = set(names_in(spark, at))
    assert plans.queries()[name](spark, str(tmp_path / "tables")).count() > 0
    assert {n.rsplit("-", 1)[0] for n in names_in(spark, at) if n not in before} <= WRITTEN[name]


def test_small_blocks_are_compared_together(spark, monkeypatch):
    """Each context goes to as many tasks as there are groups of contexts, however small the blocks; groups change no cluster."""
    texts = [f"Ada met Bo in {' '.join(f'w{(i * 7 + k * k) % 23}' for k in range(i % 9))}." for i in range(60)]
    n = build_network(corpus.from_texts(spark, texts), Gazetteer({"P": ["Ada", "Bo"]}), window=0)
    groups, own = [], context.staged
    monkeypatch.setattr(context, "staged", lambda df, name: (groups.append(df.agg({"blocks": "max"}).first()[0]) if name == "contexts" else None) or own(df, name))
    clusters = lambda: sorted(map(tuple, context.EdgeClusterer(eps=0.3, min_samples=3, block=4).memberships(n).collect()))
    together = clusters()
    monkeypatch.setattr(context, "TOGETHER", 8)
    assert clusters() == together and {0, -1} <= {r[2] for r in together}
    assert groups[0] == 1 < groups[1]


def test_tokens_left_over_as_by_sweeps(spark):
    rnd = random.Random(3)
    texts = ["", "a b", *("".join(rnd.choice(["ab", " ", ". ", "\n", "c-d", "!"]) for _ in range(rnd.randint(1, 80))) for _ in range(20))]
    docs = corpus.from_texts(spark, texts)
    sents, toks = sentences(docs), tokens(docs)
    spans = [(i, a, a + rnd.randint(1, 12), "X", 1.0, "") for i, t in enumerate(texts) if len(t) > 2 for a in sorted(rnd.sample(range(len(t)), min(4, len(t))))]
    spans = [s for s in spans if texts[s[0]].strip()]
    rows = spark.createDataFrame(spans, "doc_id long, start int, end int, label string, score double, text string")
    want = [{(r.doc_id, r.pos) for r in uncovered_tokens(toks, align_spans(rows, sents, *more)).collect()} for more in ((), (toks,))]
    got = [set(), set()]
    for i, t in enumerate(texts):
        places = np.array([p for a, b in sentence_spans(t) for p in token_spans(t, a, b)], np.int64).reshape(-1, 2)
        own = np.array([s[1:3] for s in spans if s[0] == i], np.int64).reshape(-1, 2)
        for found, left in zip(got, left_uncovered(own[:, 0], own[:, 1], (places[:, 0], places[:, 1])), strict=True):
            found |= {(i, k) for k in left.tolist()}
    assert got == want


def test_sentences_between_mentions_are_those_of_contexts(spark):
    docs = corpus.from_texts(spark, ["Ada. x. y. Bo. z. z. z. Ada and Ada.", "Bo. x. x. x. Ada. q.", "none. at all."])
    n = build_network(docs, Gazetteer({"P": ["Ada"], "Q": ["Bo"]}), window=3)
    assert sorted((r.doc_id, r.sent) for r in n.between().collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 7), (1, 0), (1, 4)]
    assert [r.context for r in n.contexts("Ada", "Bo").collect()] == ["Ada. x. y. Bo."]
