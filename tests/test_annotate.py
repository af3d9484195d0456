"""One pass over texts: every text meets the segmenter once, and single texts, tables and streams agree."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_network import NAMES, random_texts

from weftnet.functions.text import BOUNDARY, TOKEN
from weftnet.operators.align import align_spans, uncovered_tokens
from weftnet.operators.annotate import put_together, segment_default
from weftnet.operators.extract import FunctionExtractor, Gazetteer
from weftnet.operators.segment import PatternSegmenter, Segmentation, sentences, tokens
from weftnet.plans.pipeline import NetworkPipeline
from weftnet.sources import corpus


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


class Counting(PatternSegmenter):
    """Writes a line for each text that it sees."""

    def __init__(self, path):
        super().__init__(BOUNDARY, TOKEN)
        self.path = path

    def segment(self, text):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(text.replace("\n", " ")[:20] + "\n")
        return super().segment(text)


def overlapping(text):
    return [(a, a + n, "X", 0.5) for a in range(1, len(text) - 6, 9) for n in (0, 3, 6)]


def test_once_for_each_text(spark, tmp_path):
    texts, _ = random_texts(3, 6)
    texts = [*texts, "", "Ada. Bo", "x"]
    docs = corpus.from_texts(spark, texts)
    counting = Counting(str(tmp_path / "seen"))
    pipeline = NetworkPipeline(Gazetteer(NAMES), segmenter=counting)
    n = pipeline.run(docs)
    assert len((tmp_path / "seen").read_text().splitlines()) == len(texts)
    plain = NetworkPipeline(Gazetteer(NAMES)).run(docs)
    for name in ("entities", "terms", "histogram", "entity_terms", "mentions"):
        a, b = getattr(n, name), getattr(plain, name)
        assert sorted(a.select(sorted(a.columns)).collect()) == sorted(b.select(sorted(b.columns)).collect()), name


def test_tables_and_texts_agree(spark, tmp_path):
    texts, _ = random_texts(5, 5)
    docs = corpus.from_texts(spark, [*texts, ""])
    pipeline = NetworkPipeline(FunctionExtractor(overlapping))
    sents, toks, mentions = pipeline.annotate_all(docs)
    by_joins = align_spans(pipeline.extractor.spans(docs), sentences(docs), tokens(docs))
    order = ["doc_id", "ord", "sent", "start", "end", "text", "label", "score", "token_start", "token_end"]
    assert sorted(map(tuple, mentions.select(order).collect())) == sorted(map(tuple, by_joins.select(order).collect()))
    assert sorted(map(tuple, toks.select("doc_id", "pos", "text").collect())) == sorted(map(tuple, tokens(docs).select("doc_id", "pos", "text").collect()))
    left = pipeline.annotate_for_terms(docs)[1]
    assert sorted(map(tuple, left.select("doc_id", "pos").collect())) == sorted(map(tuple, uncovered_tokens(tokens(docs), by_joins).select("doc_id", "pos").collect()))
    for i, text in enumerate([*texts, ""]):
        one = pipeline.annotate_text(text)
        assert one.mentions == sorted(tuple(r[c] for c in order[1:]) for r in mentions.filter(F.col("doc_id") == i).collect())
        assert len(one.tokens) == toks.filter(F.col("doc_id") == i).count() and len(one.sentences) == sents.filter(F.col("doc_id") == i).count()
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    pipeline.annotated_rows(stream).writeStream.format("memory").queryName("annotated").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("annotated").filter("kind = 'm'").select("doc_id", "place", *order[2:]).collect())) == sorted(map(tuple, mentions.select(order).collect()))


def test_single_texts():
    pipeline = NetworkPipeline(Gazetteer({"LOC": ["İstanbul"]}))
    assert [m[2:6] for m in pipeline.annotate_text("To İstanbul. Now").mentions] == [(3, 11, "İstanbul", "LOC")]
    with pytest.raises(ValueError, match="no sentences"):
        put_together("a", Segmentation([], []), [(0, 1, "X", 1.0, "a")])
    assert put_together("a b", Segmentation([(0, 3)], []), [(0, 1, "X", 1.0, "a")]).mentions[0][-2:] == (-1, -1)
    one = put_together("a   b", segment_default("a   b"), [(1, 3, "X", 1.0, "  ")])
    assert one.mentions[0][-2:] == (1, 1) and not any(t["covered"] for t in one.tokens)
    with pytest.raises(TypeError):
        NetworkPipeline(lambda docs: docs).annotate_text("a")
