"""Sources, contexts and the command line."""

import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftnet import cli
from weftnet.functions.text import STOPWORDS
from weftnet.operators.context import EdgeClusterer, bag_of_words, dbscan
from weftnet.operators.extract import Gazetteer
from weftnet.plans.pipeline import NetworkPipeline
from weftnet.sources import corpus


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\ntwo\nthree", encoding="utf-8")
    assert [(r.doc_id, r.text) for r in corpus.from_txt(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "b.txt").write_text("one\nmore\n\ntwo", encoding="utf-8")
    assert [r.text for r in corpus.from_txt(spark, str(tmp_path / "b.txt"), delimiter="\n\n").orderBy("doc_id").collect()] == ["one\nmore", "two"]
    (tmp_path / "c.txt").write_bytes("caf\xe9\nx".encode("latin-1"))
    assert [r.text for r in corpus.from_txt(spark, str(tmp_path / "c.txt"), encoding="ISO-8859-1").orderBy("doc_id").collect()] == ["café", "x"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,text,where,\n7," He said ""hi""\nthere ",x,\n8,two,y,\n', encoding="utf-8")
    rows = corpus.from_csv(spark, str(tmp_path / "a.csv"), id_column="key").orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.meta) for r in rows] == [("7", 'He said "hi"\nthere', {"where": "x"}), ("8", "two", {"where": "y"})]
    with pytest.raises(ValueError):
        corpus.from_csv(spark, str(tmp_path / "a.csv"), text_column="body")
    (tmp_path / "b.tsv").write_text("text\tid\na,b\t1\n", encoding="utf-8")
    assert [(r.doc_id, r.text) for r in corpus.load_corpus(spark, str(tmp_path / "b.tsv")).collect()] == [(0, "a,b")]


def test_records(spark):
    docs = corpus.from_texts(spark, ["a", "b"], ids=["x", "y"])
    assert corpus.get(docs, "y").text == "b" and corpus.head(docs, 1).count() == 1 and corpus.head(docs, -1).count() == 0
    with pytest.raises(KeyError):
        corpus.get(docs, "z")
    with pytest.raises(ValueError):
        corpus.from_texts(spark, ["a", "b"], ids=[1, 1])
    with pytest.raises(ValueError):
        corpus.add(docs, docs)
    with pytest.raises(TypeError):
        corpus.from_texts(spark, [1])
    with pytest.raises(Exception, match="no 'text'"):
        corpus.from_records(spark.createDataFrame([(1, None)], "id int, text string"), id_column="id").collect()


def naive_dbscan(x, eps, least):
    n = len(x)
    near = [[j for j in range(n) if j == i or np.linalg.norm(x[i] - x[j]) <= eps + 1e-12] for i in range(n)]
    core = [len(o) >= least for o in near]
    label, names = [-1] * n, {}
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            if core[i]:
                group[i] = min(group[j] for j in near[i] if core[j])
    for i in range(n):
        own = i if core[i] else next((j for j in near[i] if core[j]), None)
        if own is not None:
            label[i] = names.setdefault(group[own], len(names))
    return label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=0, max_size=14), st.integers(0, 3), st.integers(1, 3))
def test_dbscan(points, eps, least):
    x = np.array(points, float).reshape(-1, 1)
    got = dbscan(x, eps, least, "euclidean", block=4)
    assert got.tolist() == naive_dbscan(x, eps, least)
    if len(points):
        values, first, times = np.unique(x, axis=0, return_index=True, return_counts=True)
        order = np.argsort(first)
        by_value = dict(zip(values[order].ravel().tolist(), dbscan(values[order], eps, least, "euclidean", times[order]).tolist(), strict=True))
        assert [v >= 0 for v in got.tolist()] == [by_value[p] >= 0 for p in x.ravel().tolist()]


def test_clusters(spark):
    docs = corpus.from_texts(spark, ["Ada sings with Bo loudly.", "Ada sings with Bo loudly.", "Ada taxes Bo money.", "Ada met Rome."])
    clusterer = EdgeClusterer(eps=0.3)
    p = NetworkPipeline(Gazetteer({"P": ["Ada", "Bo"], "L": ["Rome"]}), clusterer=clusterer)
    n = p.run(docs)
    found = sorted((r.src, r.dst, r.label, r.size) for r in p.cluster(n).collect())
    assert found == [(0, 1, 0, 2), (0, 1, 1, 1), (0, 2, 0, 1)]
    assert clusterer.cluster_edge(n, "Bo", "Rome").count() == 0
    own = EdgeClusterer(eps=5, metric="euclidean", embed=lambda texts: np.array([[len(t), 1.0] for t in texts])).cluster_edge(n, "Ada", "Bo").collect()
    assert sorted(r.size for r in own) == [3] or sum(r.size for r in own) == 3
    assert all(len(r.centroid) == 2 for r in own)
    with pytest.raises(RuntimeError):
        NetworkPipeline(Gazetteer({"P": ["Ada"]})).cluster(n)
    with pytest.raises(ValueError):
        EdgeClusterer(metric="other")
    bag = bag_of_words(spark.createDataFrame([("the Red red fox",)], "context string"), 16).first()["bag"]
    assert sum(bag.values()) == 3 and max(bag.values()) >= 2


@pytest.mark.parametrize("least,metric,eps,block", [(3, "cosine", 0.2, 20), (2, "euclidean", 0.6, 25)])
def test_clusters_in_blocks(spark, least, metric, eps, block):
    """An edge whose contexts are dealt to many blocks has the clusters of one matrix of all of them."""
    rnd = np.random.default_rng(least)
    themes = [["red", "blue", "green", "grey", "pink"], ["apple", "pear", "plum", "fig", "lime"], ["rain", "snow", "hail", "fog", "wind"]]
    texts = [f"Ada {' '.join(rnd.choice(themes[rnd.integers(3)], 3))} Bo" + (f" odd{k}" if k % 4 == 0 else "") + "." for k in range(60)] + ["Ada Bo.", "Ada Bo.", "Ada met Rome."]
    n = NetworkPipeline(Gazetteer({"P": ["Ada", "Bo"], "L": ["Rome"]}), window=0).run(corpus.from_texts(spark, texts))
    clusterer = EdgeClusterer(eps=eps, min_samples=least, metric=metric, block=block)
    got = clusterer.memberships(n, pairs=[("Ada", "Bo")]).orderBy("source", "target").collect()
    vectors = np.zeros((62, 2048))
    for i, t in enumerate(texts[:62]):
        for w in re.findall(r"\w+", t.lower()):
            if w not in STOPWORDS:
                vectors[i, zlib.crc32(w.encode()) % 2048] += 1
    sizes = np.sqrt((vectors**2).sum(axis=1))
    unit = np.divide(vectors, sizes[:, None], out=np.zeros_like(vectors), where=sizes[:, None] > 0) if metric == "euclidean" else vectors
    want = dbscan(unit, eps, least, metric)
    assert [r.label for r in got] == want.tolist() and len(set(want.tolist())) > 2
    assert clusterer.memberships(n, pairs=[("Ada", "Rome")]).first()["label"] == 0
    means = {(r.label, r.bucket): r.value for r in clusterer.centroids(n, pairs=[("Ada", "Bo")]).collect()}
    unit = np.divide(vectors, sizes[:, None], out=np.zeros_like(vectors), where=sizes[:, None] > 0)
    for label in set(want.tolist()):
        mean = unit[want == label].mean(axis=0)
        assert {b for k, b in means if k == label} == set(np.flatnonzero(mean).tolist()) and all(abs(means[label, b] - mean[b]) < 1e-12 for b in np.flatnonzero(mean).tolist())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("id,body\n1,Ada met Bo.\n2,Bo met Ada.\n", encoding="utf-8")
    (tmp_path / "names.json").write_text(json.dumps({"P": ["Ada", "Bo"]}), encoding="utf-8")
    common = [str(tmp_path / "in.csv"), "--text-column", "body", "--extractor", "gazetteer", "--gazetteer", str(tmp_path / "names.json")]
    assert cli.main(["build", *common, "-o", str(tmp_path / "out.csv"), "-q"], spark) == 0
    assert (tmp_path / "out.csv").read_text().splitlines()[1:] == ["Ada,P,Bo,P,2.0,2"]
    assert cli.main(["summary", *common], spark) == 0 and "Ada\tBo\t2\t2" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["build", *common, "-o", "x.doc"], spark)
    with pytest.raises(SystemExit):
        cli.main(["summary", common[0], "--extractor", "gazetteer"], spark)
