"""Networks against the loop model, on random corpora and by hand."""

import json
import math
import random
import xml.dom.minidom

import pytest
from model import loads, network as model
from pyspark.sql import functions as F

from weftnet.config import NetworkConfig, available_decays, decay_values, register_decay
from weftnet.functions.text import STOPWORDS
from weftnet.operators.align import align_spans, invalid_rows, uncovered_tokens, validate
from weftnet.operators.extract import FunctionExtractor, Gazetteer, ModelExtractor
from weftnet.operators.network import Network
from weftnet.operators.segment import PatternSegmenter, segment_with, sentences, tokens
from weftnet.plans.pipeline import NetworkPipeline, build_network
from weftnet.sources import corpus, exports
from weftnet.streaming.store import NetworkStore

NAMES = {"PERSON": ["Ada", "Bo", "Ada Li"], "ORG": ["Acme", "Zeta"], "LOC": ["Rome"]}
WORDS = ["red", "blue", "the", "runs", "slowly"]


def random_texts(seed, n=5):
    """Texts, and the sentences that the model sees."""
    rnd = random.Random(seed)
    surfaces = [(s, label) for label, own in NAMES.items() for s in own]
    texts, seen = [], {}
    for i in range(n):
        parts, known = [], []
        for _ in range(rnd.randint(0, 6)):
            entities, terms, words = [], [], []
            for _ in range(rnd.randint(1, 5)):
                if rnd.random() < 0.5:
                    s, label = rnd.choice(surfaces)
                    entities.append((s.lower(), label))
                    words.append(rnd.choice([s, s.upper()]))
                    words.append("-")
                else:
                    w = rnd.choice(WORDS)
                    words.append(w)
                    if w != "the":
                        terms.append(w)
            parts.append(" ".join(words) + ".")
            known.append((entities, terms))
        texts.append(" ".join(parts))
        seen[i] = known
    return texts, seen


def named_edges(n):
    return {tuple(sorted(((r.source_norm, r.source_label), (r.target_norm, r.target_label)))): (r.weight, r["count"]) for r in n.edges().collect()}


@pytest.mark.parametrize("seed,window", [(1, 0), (2, 1), (3, 2), (4, 4)])
def test_against_the_model(spark, seed, window):
    texts, seen = random_texts(seed)
    n = build_network(corpus.from_texts(spark, texts), Gazetteer(NAMES), window=window)
    edges, pairs, counts = model(seen, window)
    got = named_edges(n)
    assert got.keys() == edges.keys()
    assert all(got[k][1] == edges[k][1] and math.isclose(got[k][0], edges[k][0]) for k in edges)
    assert {(r.norm, r.label): r["count"] for r in n.entities.collect()} == dict(counts)
    ids = {r.entity_id: (r.norm, r.label) for r in n.entities.collect()}
    terms = {r.term_id: r.text for r in n.terms.collect()}
    assert {(ids[r.entity_id], terms[r.term_id]): r.n for r in n.entity_terms.collect()} == dict(pairs)
    want = loads(edges, counts)
    found = {(ids[r.src], ids[r.dst]): r.weight for r in n.load_edges().collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)
    per_edge = n.all_cooccurrences().groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count().collect()
    assert {tuple(sorted((ids[r.a], ids[r.b]))): r["count"] for r in per_edge} == {k: v[1] for k, v in edges.items()}


@pytest.fixture(scope="module")
def small(spark):
    docs = corpus.from_texts(spark, ["Ada met Bo in Rome. They saw Acme! Zeta was late. Ada left.", "Bo knows Ada Li.\nRome is red.", "", "Nothing here."])
    return NetworkPipeline(Gazetteer(NAMES)), docs, NetworkPipeline(Gazetteer(NAMES)).run(docs)


def test_first_appearance_ids(small):
    _, _, n = small
    assert [r.text for r in n.entities.orderBy("entity_id").collect()] == ["Ada", "Bo", "Rome", "Acme", "Zeta", "Ada Li"]
    assert n.entity("ada")["entity_id"] == 0 and n.entity(("BO", "PERSON"))["entity_id"] == 1
    with pytest.raises(KeyError):
        n.entity("nobody")
    assert n.find_entity("nobody", "LOC") is None


def test_questions(small):
    _, _, n = small
    assert n.weight("Ada", "Bo") == 1.0 and n.count("Bo", "Ada") == 1 and n.weight("Ada", "Ada Li") == 0.0
    assert n.edge_table(top_k=0).count() == 0 and n.edge_table(top_k=-1).count() == n.edge_table().count()
    assert n.edge_table(labels=[]).count() == 0 and n.edge_table(labels=["PERSON"]).count() == 2
    assert n.neighbors("Ada", k=1).collect()[0]["weight"] == max(r.weight for r in n.neighbors("Ada").collect())
    with pytest.raises(ValueError):
        n.neighbors("Ada", weighting="other")
    assert [r.context for r in n.contexts("Ada", "Acme").collect()] == ["Ada met Bo in Rome. They saw Acme!", "They saw Acme! Zeta was late. Ada left."]
    assert n.contexts("Ada", "Acme").collect() == n.contexts("Acme", "Ada").collect()
    with pytest.raises(ValueError):
        n.cooccurrences("Ada", "Ada")
    assert [(r.doc_id, r.n_sentences) for r in n.documents.orderBy("doc_id").collect()] == [(0, 4), (1, 2), (2, 0), (3, 1)]
    with pytest.raises(KeyError):
        n.sentences_of_document(99)
    assert n.sentences_of("Rome").count() == 2 and n.mentions_of("Ada").count() == 2
    top = n.rank_entities("Ada", weighting="raw", k=1).collect()[0]
    assert top["score"] == 1.0
    with pytest.raises(ValueError):
        n.rank_entities([])
    assert n.rank_sentences(["Ada", "Bo"], k=1).collect()[0]["sent"] == 0
    assert n.rank_documents(["Bo", "Ada Li"]).collect()[0]["doc_id"] == 1


def test_batches_equal_one_build(spark, small, tmp_path):
    pipeline, docs, n = small
    store = NetworkStore(spark, str(tmp_path / "store"), pipeline)
    for batch, ids in enumerate(([1, 3], [0], [2], [0])):
        if batch < 3:
            store.add(docs.filter(F.col("doc_id").isin(ids)), batch)
    store.add(docs.filter("doc_id = 0"), 1)
    with pytest.raises(ValueError):
        store.add(docs.filter("doc_id = 0"), 9)
    m = store.network()
    for name in ("entities", "terms", "histogram", "entity_terms", "documents", "mentions"):
        a, b = getattr(m, name), getattr(n, name)
        assert sorted(a.select(sorted(a.columns)).collect()) == sorted(b.select(sorted(b.columns)).collect()), name
    with pytest.MonkeyPatch.context() as patch:  # a run that stops before its documents leaves the batch as it was
        write = NetworkStore._write
        patch.setattr(NetworkStore, "_write", lambda self, to, name, *more: 1 / 0 if name == "documents" else write(self, to, name, *more))
        with pytest.raises(ZeroDivisionError):
            store.add(docs.filter("doc_id = 0"), 1)
    assert sorted(map(tuple, store.network().histogram.collect())) == sorted(map(tuple, n.histogram.select(m.histogram.columns).collect()))
    assert sorted(store.compact(str(tmp_path / "one")).network().all_edges.collect()) == sorted(n.all_edges.collect())


def test_stream(spark, small, tmp_path):
    pipeline, docs, n = small
    docs.select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "in"))
    store = NetworkStore(spark, str(tmp_path / "store"), pipeline, on_repeated="skip")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.follow(stream, str(tmp_path / "progress")).awaitTermination()
    assert sorted(store.network().all_edges.collect()) == sorted(n.all_edges.collect())


def test_save_and_load(spark, small, tmp_path):
    _, _, n = small
    n.save(str(tmp_path / "net"))
    m = Network.load(spark, str(tmp_path / "net"))
    assert sorted(m.all_edges.collect()) == sorted(n.all_edges.collect()) and m.config.window == 2
    spark.createDataFrame([(99, "{}")], "format int, config string").write.mode("overwrite").parquet(str(tmp_path / "net/meta"))
    with pytest.raises(ValueError):
        Network.load(spark, str(tmp_path / "net"))
    with pytest.raises(FileNotFoundError):
        Network.load(spark, str(tmp_path / "none"))


def test_exports(small, tmp_path):
    _, _, n = small
    for suffix in ("json", "csv", "graphml", "gexf"):
        exports.write(n, str(tmp_path / f"x.{suffix}"), include_terms=True)
    shown = json.loads((tmp_path / "x.json").read_text())
    assert shown["n_documents"] == 4 and len(shown["nodes"]) == 6 and len(shown["edges"]) == n.all_edges.count()
    assert (tmp_path / "x.csv").read_text().splitlines()[0] == "source,source_label,target,target_label,weight,count"
    for suffix in ("graphml", "gexf"):
        xml.dom.minidom.parse(str(tmp_path / f"x.{suffix}"))
    with pytest.raises(ValueError):
        exports.check_suffix("x.doc")
    nodes, edges = exports.graph(n, top_k=1, include_isolated=False)
    assert nodes.count() == 2 and edges.count() == 1
    assert {r["size"] for r in exports.connected_parts(exports.graph(n)[1]).collect()} == {6}


def test_gazetteer(spark):
    docs = corpus.from_texts(spark, ["Ada Li and ADA, Adam; x-Ada_ Ada-b.", "a.b? c++ a.b", "Ada\nLi"])
    g = Gazetteer(NAMES | {"SIGN": ["a.b", "c++"]})
    spans = sorted((r.doc_id, r.start, r.end, r.label, r.text) for r in g.spans(docs).collect())
    assert spans == [(0, 0, 6, "PERSON", "Ada Li"), (0, 11, 14, "PERSON", "ADA"), (0, 29, 32, "PERSON", "Ada"), (1, 0, 3, "SIGN", "a.b"), (1, 5, 8, "SIGN", "c++"), (1, 9, 12, "SIGN", "a.b"), (2, 0, 3, "PERSON", "Ada")]
    assert spans == sorted((r.doc_id, r.start, r.end, r.label, r.text) for r in g._by_shards(docs, g.shards(200)).collect())
    assert Gazetteer({"A": ["x"], "B": ["X"]}).label_of == {"x": "B"}
    with pytest.raises(ValueError):
        Gazetteer({"A": [" "]})
    assert Gazetteer({"A": ["ada"]}, case_sensitive=True).spans(docs).count() == 0


def test_segmentation(spark):
    text = 'He said "Go!" Then left…  Next:\n\n a-b, it\'s naïve 3x.\t(Yes.) End'
    docs = corpus.from_texts(spark, [text, "", " \n "])
    sents = [(r.sent, r.text, text[r.start : r.end]) for r in sentences(docs).orderBy("doc_id", "sent").collect()]
    assert [s[1] for s in sents] == ['He said "Go!"', "Then left…", "Next:", "a-b, it's naïve 3x.", "(Yes.)", "End"]
    assert all(s[1] == s[2] for s in sents)
    toks = tokens(docs).orderBy("pos").collect()
    assert all(text[t.start : t.end] == t.text for t in toks)
    assert [t.text for t in toks if t.sent == 3] == ["a-b", ",", "it's", "naïve", "3x", "."]
    assert [t.is_punct for t in toks if t.sent == 3] == [False, True, False, False, False, True]
    assert [t.is_stop for t in toks if t.text in ("He", "it's")] == [True, True]
    own, parts = segment_with(docs, PatternSegmenter(r"(?<=[.!?…])([\"'”’)\]]*)\s+|\n+", r"\w+(?:[-'’]\w+)*|[^\w\s]"))
    assert [(r.sent, r.start, r.end) for r in own.orderBy("doc_id", "sent").collect()] == [(r.sent, r.start, r.end) for r in sentences(docs).orderBy("doc_id", "sent").collect()]
    assert [(r.pos, r.start, r.text, r.is_stop, r.is_punct) for r in parts.orderBy("pos").collect()] == [(r.pos, r.start, r.text, r.is_stop, r.is_punct) for r in toks]


def test_alignment(spark):
    docs = corpus.from_texts(spark, ["One two. Three four."])
    spans = spark.createDataFrame([(0, 4, 7, "A", 1.0, "two"), (0, 9, 9, "A", 1.0, ""), (0, 5, 14, "B", 1.0, "wo. Three"), (0, 8, 9, "C", 1.0, " ")], "doc_id long, start int, end int, label string, score double, text string")
    rows = align_spans(spans, sentences(docs), tokens(docs)).orderBy("ord").collect()
    assert [(r.start, r.end, r.sent, r.token_start, r.token_end) for r in rows] == [(4, 7, 0, 1, 2), (5, 14, 0, 1, 4), (8, 9, 0, 3, 3)]
    left = uncovered_tokens(tokens(docs), align_spans(spans, sentences(docs), tokens(docs)))
    assert [r.text for r in left.orderBy("pos").collect()] == ["One", "four", "."]
    mentions = align_spans(spans, sentences(docs))
    validate(docs, sentences(docs), tokens(docs), mentions)
    bad = mentions.withColumn("sent", F.lit(7))
    assert {(r.kind, r.problem) for r in invalid_rows(docs, sentences(docs), tokens(docs), bad).collect()} == {("mention", "sentence")}
    with pytest.raises(ValueError):
        validate(docs, sentences(docs), tokens(docs).withColumn("end", F.lit(99)), mentions)
    with pytest.raises(Exception, match="no sentences"):
        align_spans(spans, sentences(docs).limit(0)).collect()


def test_model_extractor(spark):
    def load():
        def score(chunks, labels, threshold):
            return [[{"start": c.find("Ada"), "end": c.find("Ada") + 3, "label": "person", "score": 0.9}] if "Ada" in c else [] for c in chunks]

        return score

    docs = corpus.from_texts(spark, ["One two three. Ada is here now. Four five.", "no"])
    e = ModelExtractor(load, ["person"], max_chunk_words=4, label_map={"person": "PER"})
    assert [(r.doc_id, r.start, r.end, r.label, r.text) for r in e.spans(docs, sentences(docs)).collect()] == [(0, 15, 18, "PER", "Ada")]
    text = "a b c d e f g"
    pieces = e.chunks(text, [(0, len(text))])
    assert "".join(text[a:b] for a, b in pieces) == text and len(pieces) == 2
    with pytest.raises(ValueError):
        ModelExtractor(load, [])
    spans = FunctionExtractor(lambda t: [(0, 2, "X", 0.5)] if t == "no" else []).spans(docs).collect()
    assert [(r.doc_id, r.text, r.score) for r in spans] == [(1, "no", 0.5)]


def test_config():
    assert decay_values("linear", 3) == [1.0, 0.75, 0.5, 0.25] and decay_values("inverse", 1) == [1.0, 0.5]
    with pytest.raises(KeyError):
        NetworkConfig(decay="other")
    with pytest.raises(ValueError):
        register_decay("linear", lambda d: 1.0)
    register_decay("half", lambda d: 0.5**d)
    assert "half" in available_decays() and NetworkConfig(decay="half", window=1).decays == [1.0, 0.5]
    again = NetworkConfig.from_json(NetworkConfig(decay="half", window=1, term_pos=("NOUN",)).to_json())
    assert again.decays == [1.0, 0.5] and again.term_pos == ("NOUN",)
    with pytest.raises(ValueError):
        NetworkPipeline(config=NetworkConfig(), window=1)


def test_checks_of_annotations(spark):
    docs = spark.createDataFrame([(1, "Ada met Bo."), (2, "Bo.")], "doc_id long, text string")
    sents, toks, mentions = NetworkPipeline(Gazetteer({"P": ["Ada", "Bo"]})).annotate(docs)
    build = lambda d, s, t, m: Network.from_annotations(d, s, t, m)
    assert build(docs, sents, toks, mentions).mentions.count() == 3
    with pytest.raises(ValueError, match="more than once"):
        build(docs.unionByName(docs.limit(1)), sents, toks, mentions)
    with pytest.raises(ValueError, match="mention 'Ada'"):
        build(docs, sents, toks, mentions.withColumn("sent", F.when(F.col("text") == "Ada", 7).otherwise(F.col("sent"))))
    with pytest.raises(ValueError, match="token"):
        build(docs, sents, toks.withColumn("sent", F.lit(-1)), mentions)


def test_places_and_metadata(spark):
    docs = corpus.from_texts(spark, ["Ada met Bo. Rome?", "Bo."], meta=[{"by": "x"}, {"by": "y"}])
    n = NetworkPipeline(Gazetteer({"P": ["Ada", "Bo"], "L": ["Rome"]})).run(docs)
    assert n.document(0)["meta"] == {"by": "x"} and n.document(1)["n_sentences"] == 1 and n.sentence(0, 1)["text"] == "Rome?"
    assert n.mention(2)["sent"] == 1 and [(r.doc_id, r.sent) for r in n.numbered_sentences().orderBy("sentence_id").collect()] == [(0, 0), (0, 1), (1, 0)]
    for missing in (lambda: n.document(9), lambda: n.sentence(0, 9), lambda: n.mention(9)):
        with pytest.raises(KeyError):
            missing()
    more = corpus.add(docs, "A third one.", meta={"by": "z"})
    assert {r.doc_id for r in more.collect()} == {0, 1, 2} and corpus.get(more, 2)["meta"] == {"by": "z"}
    with pytest.raises(ValueError):
        corpus.add(docs, "again", 1)


def test_stop_words():
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 184 and "now" not in STOPWORDS and {"two", "you've", "also"} <= set(STOPWORDS)


def test_files_in_order(spark, tmp_path):
    for name, lines in (("b", 3), ("a", 4000), ("c", 50)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name} {k}" for k in range(lines)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = corpus.from_txt(spark, str(tmp_path)).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in rows] == [f"{name} {k}" for name, lines in (("a", 4000), ("b", 3), ("c", 50)) for k in range(lines)]
    assert [r.doc_id for r in rows] == list(range(4053))
