"""Single files that tasks write: the same nodes and edges come back."""

import csv
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from weftnet.operators.extract import Gazetteer
from weftnet.plans.pipeline import build_network
from weftnet.sources import corpus, exports

NAMES = {"ORG": ['Q & "A", Inc', "Łódź <1>", "İstanbul"], "PERSON": ["Ada", "Bo"]}


@pytest.fixture(scope="module")
def odd(spark):
    texts = ['Ada met Q & "A", Inc in Łódź <1> today.', "Bo saw Ada. Łódź <1> saw İstanbul.", "Nobody.", 'Bo and Q & "A", Inc again.'] * 3
    return build_network(corpus.from_texts(spark, texts), Gazetteer(NAMES), window=1)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json(odd, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("older")
    exports.to_json(odd, str(path))
    read, want = json.loads(path.read_text(encoding="utf-8")), exports.to_dict(odd)
    assert read["nodes"] == want["nodes"] and read["config"] == want["config"] and read["n_documents"] == 12
    assert sorted(read["edges"], key=str) == sorted(want["edges"], key=str) and len(read["edges"]) > 3
    exports.to_json(odd, str(path), labels=["NONE"])
    none = json.loads(path.read_text())
    assert none["nodes"] == none["edges"] == [] and [p.name for p in tmp_path.iterdir()] == ["x.json"]


def test_csv(odd, tmp_path):
    exports.to_csv(odd, str(tmp_path / "x.csv"))
    with open(tmp_path / "x.csv", encoding="utf-8", newline="") as f:
        head, *rows = csv.reader(f)
    assert tuple(head) == exports.EDGE_COLUMNS
    assert sorted((a, b, c, d, float(w), int(n)) for a, b, c, d, w, n in rows) == as_rows(exports.edgelist(odd))


@pytest.mark.parametrize("terms", [False, True])
def test_graphml(odd, tmp_path, terms):
    exports.to_graphml(odd, str(tmp_path / "x.graphml"), include_terms=terms)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(tmp_path / "x.graphml").getroot()
    name = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
    nodes, edges = exports.graph(odd, include_terms=terms)
    read = [{"id": x.get("id")} | {name[d.get("key")]: d.text or "" for d in x} for x in root.iter(f"{ns}node")]
    want = [{k: str(v) for k, v in r.asDict().items() if v is not None} for r in nodes.collect()]
    assert sorted(read, key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])
    got = sorted((e.get("source"), e.get("target"), d["kind"], float(d["weight"]), int(d["count"])) for e in root.iter(f"{ns}edge") for d in [{name[d.get("key")]: d.text for d in e}])
    assert got == as_rows(edges.select("source", "target", "kind", "weight", "count"))


def test_gexf(odd, tmp_path):
    exports.to_gexf(odd, str(tmp_path / "x.gexf"))
    ns = "{http://www.gexf.net/1.2draft}"
    root = ET.parse(tmp_path / "x.gexf").getroot()
    nodes, edges = exports.graph(odd)
    assert sorted((n.get("id"), n.get("label")) for n in root.iter(f"{ns}node")) == as_rows(nodes.select("id", "text"))
    found = list(root.iter(f"{ns}edge"))
    assert sorted((e.get("source"), e.get("target"), float(e.get("weight"))) for e in found) == as_rows(edges.select("source", "target", "weight"))
    assert len({e.get("id") for e in found}) == len(found)


def test_one_file_of_many_tasks(spark, tmp_path):
    """Characters that XML lacks go, line breaks stay as references, and lines keep their order over tasks."""
    lines = spark.range(50_000, numPartitions=16).select(F.concat(F.lit("é"), F.col("id").cast("string")))
    empty = spark.range(0).select(F.col("id").cast("string"))
    exports.one_file(spark, str(tmp_path / "x"), ["[\n", lines, "] [", empty, "]"], joined_by=",")
    assert (tmp_path / "x").read_text(encoding="utf-8") == "[\n" + "\n,".join(f"é{i}" for i in range(50_000)) + "\n] []"
    shown = spark.createDataFrame([("a\x01\n&\t<\"'>￾",)], "v string").select(exports._xml(F.col("v"))).first()[0]
    assert shown == "a&#10;&amp;&#9;&lt;&quot;'&gt;"
