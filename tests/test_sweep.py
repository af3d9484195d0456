"""Alignment by sweeps against loops, with overlapping, nested, repeated and empty spans, over stretches of any width."""

import random

import pytest
from pyspark.sql import functions as F

from weftnet.operators.align import align_spans, swept, uncovered_tokens

SPANS = "doc_id string, start int, end int, label string, score double, text string"


def random_annotations(seed):
    rnd = random.Random(seed)
    sents, toks, spans = [], [], []
    for doc in "abc":
        at, sent = rnd.randint(0, 3), 0
        pos = 0
        for _ in range(rnd.randint(1, 5)):
            sents.append((doc, sent, at))
            for _ in range(rnd.randint(0, 6)):
                size = rnd.randint(1, 4)
                toks.append((doc, pos, sent, at, at + size))
                at, pos = at + size + rnd.randint(0, 2), pos + 1
            at, sent = at + 1, sent + 1
        for k in range(rnd.randint(0, 12)):
            a = rnd.randint(0, at + 2)
            spans.append((doc, a, a + rnd.randint(0, 9), rnd.choice("XY"), k / 8, ""))
            if rnd.random() < 0.2:
                spans.append(spans[-1])
    return sents, toks, spans


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 16), (3, 1 << 14)])
def test_against_loops(spark, seed, width):
    sents, toks, spans = random_annotations(seed)
    toks = [t for t in toks if t[0] != "c"]  # a document without tokens
    s = spark.createDataFrame(sents, "doc_id string, sent int, start int")
    t = spark.createDataFrame(toks, "doc_id string, pos int, sent int, start int, end int")
    found = align_spans(spark.createDataFrame(spans, SPANS), s, t, width=width)
    want, kept = [], {}
    for doc in "abc":
        own = sorted((x for x in spans if x[0] == doc and x[2] > x[1]), key=lambda x: (x[1], x[2], x[3], x[5], x[4]))
        for k, (_, a, b, label, score, _) in enumerate(own):
            before = sum(y[4] <= a for y in toks if y[0] == doc)
            upto = sum(y[3] < b for y in toks if y[0] == doc)
            some = any(y[0] == doc for y in toks)
            want.append((doc, k, max(0, sum(y[2] <= a for y in sents if y[0] == doc) - 1), a, b, label, score, before if some else -1, max(before, upto) if some else -1))
        kept[doc] = own
    assert sorted((r.doc_id, r.ord, r.sent, r.start, r.end, r.label, r.score, r.token_start, r.token_end) for r in found.collect()) == sorted(want)
    left = [y for y in toks if not any(x[1] < y[4] and x[2] > y[3] for x in kept[y[0]])]
    assert sorted(map(tuple, uncovered_tokens(t, align_spans(spark.createDataFrame(spans, SPANS), s, width=width), width).collect())) == sorted(left)
    by_range = [y for y in toks if not any(w[0] == y[0] and w[7] <= y[1] < w[8] for w in want)]
    assert sorted(map(tuple, uncovered_tokens(t, found, width).collect())) == sorted(by_range)
    mixed = found.withColumn("token_start", F.when(F.col("ord") % 2 == 0, -1).otherwise(F.col("token_start")))
    both = [y for y in toks if not any(w[0] == y[0] and (w[7] <= y[1] < w[8] if w[1] % 2 else w[3] < y[4] and w[4] > y[3]) for w in want)]
    assert sorted(map(tuple, uncovered_tokens(t, mixed, width).collect())) == sorted(both)


def test_a_long_document_is_split(spark):
    n = 200_000
    toks = spark.range(0, n, 1, 4).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.lit(0).alias("sent"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 4).cast("int").alias("end"))
    sents = spark.createDataFrame([(1, 0, 0)], "doc_id int, sent int, start int")
    spans = spark.range(0, n, 100, 4).select(F.lit(1).alias("doc_id"), (F.col("id") * 5 + 2).cast("int").alias("start"), (F.col("id") * 5 + 38).cast("int").alias("end"), F.lit("X").alias("label"), F.lit(1.0).alias("score"), F.lit("").alias("text"))
    found = align_spans(spans, sents, toks)
    assert found.filter("token_start <> start div 5 or token_end <> token_start + 8 or ord <> token_start div 100").count() == 0 and found.count() == n // 100
    assert uncovered_tokens(toks, found).count() == n - 8 * n // 100
    events = toks.select("doc_id", F.col("end").alias("place"), F.lit(False).alias("strict"), F.lit(1).cast("long").alias("n"))
    plan = swept(events, spans.select("doc_id", F.col("end").alias("place"), F.struct("label").alias("row")), ["n"], "sum")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "stretch" in plan
