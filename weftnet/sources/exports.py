"""A network as edge lists, JSON, GraphML and GEXF."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions.tables import file_system, shared_dir
from weftnet.operators.network import Network

EDGE_COLUMNS = ("source", "source_label", "target", "target_label", "weight", "count")
SUFFIXES = (".json", ".csv", ".graphml", ".gexf", ".parquet")


def entity_node_id(norm: Column, label: Column) -> Column:
    return F.concat_ws("|", norm, label)


def term_node_id(text: Column, pos: Column) -> Column:
    return F.concat_ws("|", text, pos, F.lit("term"))


def edgelist(network: Network, min_weight: float = 0.0, top_k: int | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """One row an edge: surfaces and labels of both ends, weight and count."""
    rows = network.edges(min_weight, top_k, labels)
    return rows.select(F.col("source_text").alias("source"), "source_label", F.col("target_text").alias("target"), "target_label", "weight", "count")


def entity_nodes(network: Network, labels: Iterable[str] | None = None) -> DataFrame:
    rows = network.entities if labels is None else network.entities.filter(F.col("label").isin(list(labels)))
    return rows.select(entity_node_id(F.col("norm"), F.col("label")).alias("id"), "text", "norm", "label", "count", "entity_id")


def graph(network: Network, min_weight: float = 0.0, top_k: int | None = None, labels: Iterable[str] | None = None, include_isolated: bool = True, include_terms: bool = False, max_terms_per_entity: int | None = 10, min_term_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the network.

    nodes: id, kind (entity or term), text, norm, label, pos, count; edges: source, target, kind, weight, count. Terms are each
    entity's strongest, then those of min_term_count or more; nodes without an edge go last, if they are to go.
    """
    entities = entity_nodes(network, labels)
    nodes = entities.select("id", F.lit("entity").alias("kind"), "text", "norm", "label", F.lit(None).cast("string").alias("pos"), "count")
    named = network.edges(min_weight, top_k, labels)
    edges = named.select(entity_node_id(F.col("source_norm"), F.col("source_label")).alias("source"), entity_node_id(F.col("target_norm"), F.col("target_label")).alias("target"), F.lit("entity-entity").alias("kind"), "weight", "count")
    if include_terms:
        links = network.strongest_terms(max_terms_per_entity).filter(F.col("n") >= min_term_count).join(entities.select("entity_id", F.col("id").alias("source")), "entity_id")
        terms = network.terms.select("term_id", term_node_id(F.col("text"), F.col("pos")).alias("target"), "text", "pos", "count")
        links = links.join(terms, "term_id")
        nodes = nodes.unionByName(links.select(F.col("target").alias("id"), F.lit("term").alias("kind"), "text", F.lit(None).cast("string").alias("norm"), F.lit(None).cast("string").alias("label"), "pos", "count").distinct())
        edges = edges.unionByName(links.select("source", "target", F.lit("entity-term").alias("kind"), F.col("n").cast("double").alias("weight"), F.col("n").alias("count")))
    if not include_isolated:
        ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
        nodes = nodes.join(ends, "id", "left_semi")
    return nodes, edges


def write_edges(network: Network, path: str, format: str = "csv", **filters) -> None:
    """The edge list as files of a Spark format under path, written by all executors; CSV files have a header."""
    options = {"header": True, "quote": '"', "escape": '"'} if format == "csv" else {}
    edgelist(network, **filters).write.format(format).options(**options).mode("overwrite").save(path)


def write_graph(network: Network, path: str, format: str = "json", **options) -> None:
    """graph() as two tables of a Spark format, path/nodes and path/edges, written by all executors."""
    for name, rows in zip(("nodes", "edges"), graph(network, **options), strict=True):
        rows.write.format(format).mode("overwrite").save(f"{path}/{name}")


def one_file(spark: SparkSession, path: str, parts: list[str | DataFrame], joined_by: str = "") -> None:
    """One file of texts and tables of one string column, a row a line, in this order; it is there whole or not at all.

    Tasks write the lines of each table as files of the shared folder; the driver's JVM then copies them one after another through a
    buffer of 1 MB, under another name, which is changed at the end. A path without a scheme is one of Spark's default file
    system. joined_by stands in front of each line of a table but the first. A line break inside a value stays as it is.
    """
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, path)
    fs = fs.getRawFileSystem() if fs.getScheme() == "file" else fs
    written: list[str] = []
    for part in parts:
        if not isinstance(part, str):
            written.append(f"{shared_dir(spark)}/weftnet/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex[:12]}")
            part.select(F.concat(F.lit(joined_by), F.col(part.columns[0]))).write.text(written[-1])
    folders = iter(written)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.draft")
    out = fs.create(draft, True)
    for part in parts:
        if isinstance(part, str):
            out.write(bytearray(part, "utf-8"))
            continue
        source, folder = file_system(spark, next(folders))
        files = sorted((f for f in source.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
        for i, file in enumerate(files):
            lines = source.open(file.getPath())
            if i == 0:
                lines.seek(len(joined_by.encode()))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 20, False)
            lines.close()
        source.delete(folder, True)
    out.close()
    fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"can't write {path}")


def to_dict(network: Network, **filters) -> dict:
    """The network as plain values, for small ones: rows pass the driver one partition at a time."""
    nodes = entity_nodes(network, filters.get("labels")).orderBy("entity_id").drop("entity_id")
    named = network.edges(filters.get("min_weight", 0.0), filters.get("top_k"), filters.get("labels"))
    edges = named.select(entity_node_id(F.col("source_norm"), F.col("source_label")).alias("source"), entity_node_id(F.col("target_norm"), F.col("target_label")).alias("target"), "weight", "count")
    sizes = network.sizes().first()
    return {
        "config": json.loads(network.config.to_json()),
        "n_documents": sizes["n_documents"],
        "n_sentences": sizes["n_sentences"],
        "nodes": [r.asDict() for r in nodes.toLocalIterator()],
        "edges": [r.asDict() for r in edges.toLocalIterator()],
    }


def to_json(network: Network, path: str, **filters) -> None:
    """What to_dict gives, as one JSON file; nodes and edges are written by tasks."""
    nodes = entity_nodes(network, filters.get("labels")).orderBy("entity_id").drop("entity_id")
    named = network.edges(filters.get("min_weight", 0.0), filters.get("top_k"), filters.get("labels"))
    edges = named.select(entity_node_id(F.col("source_norm"), F.col("source_label")).alias("source"), entity_node_id(F.col("target_norm"), F.col("target_label")).alias("target"), "weight", "count")
    sizes = network.sizes().first()
    head = {"config": json.loads(network.config.to_json()), "n_documents": sizes["n_documents"], "n_sentences": sizes["n_sentences"]}

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))

    begin = json.dumps(head, ensure_ascii=False)[:-1] + ', "nodes": [\n'
    one_file(nodes.sparkSession, path, [begin, rows(nodes), '], "edges": [\n', rows(edges), "]}\n"], joined_by=",")


def to_pandas(network: Network, **filters):
    """(nodes, edges) as pandas frames."""
    import pandas as pd

    found = to_dict(network, **filters)
    return pd.DataFrame(found["nodes"]), pd.DataFrame(found["edges"])


def to_csv(network: Network, path: str, **filters) -> None:
    """The edge list as one CSV file with a header; rows are written by tasks."""
    edges = edgelist(network, **filters)
    lines = edges.select(F.to_csv(F.struct(*EDGE_COLUMNS), {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}))
    one_file(edges.sparkSession, path, [",".join(EDGE_COLUMNS) + "\n", lines])


def _xml(value: Column) -> Column:
    """value as XML text or as a quoted attribute's inside, without the characters that XML doesn't have."""
    out = F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "")
    for character, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(character), F.lit(put))
    return out


def _fields(form: str, columns: dict[str, str]) -> Column:
    """form, with {name} and {value}, for each column that isn't null: {column: name} put together."""
    filled = []
    for column, name in columns.items():
        before, after = form.replace("{name}", name).split("{value}")
        filled.append(F.concat(F.lit(before), _xml(F.col(column)), F.lit(after)))
    return F.concat_ws("", *filled)


def to_graphml(network: Network, path: str, **options) -> None:
    """graph() as one GraphML file; nodes and edges are written by tasks."""
    nodes, edges = graph(network, **options)
    keys = {("node", c): "string" for c in ("kind", "text", "norm", "label", "pos")} | {("node", "count"): "long", ("edge", "kind"): "string", ("edge", "weight"): "double", ("edge", "count"): "long"}
    name = {k: f"d{i}" for i, k in enumerate(keys)}
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    head += "".join(f'<key id="{name[of, column]}" for="{of}" attr.name="{column}" attr.type="{kind}"/>\n' for (of, column), kind in keys.items())

    def data(of: str) -> Column:
        return _fields('<data key="{name}">{value}</data>', {c: n for (o, c), n in name.items() if o == of})

    node_lines = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("node"), F.lit("</node>")))
    edge_lines = edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), data("edge"), F.lit("</edge>")))
    one_file(nodes.sparkSession, path, [head + '<graph edgedefault="undirected">\n', node_lines, edge_lines, "</graph>\n</graphml>\n"])


def to_gexf(network: Network, path: str, **options) -> None:
    """graph() as one GEXF file; nodes and edges are written by tasks. Ids of edges are any different numbers."""
    nodes, edges = graph(network, **options)
    own, links = {"kind": "string", "norm": "string", "label": "string", "pos": "string", "count": "long"}, {"kind": "string", "count": "long"}
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="undirected" mode="static">\n'
    for of, columns in (("node", own), ("edge", links)):
        head += f'<attributes class="{of}" mode="static">' + "".join(f'<attribute id="{c}" title="{c}" type="{kind}"/>' for c, kind in columns.items()) + "</attributes>\n"

    def values(columns: dict) -> Column:
        return F.concat(F.lit("<attvalues>"), _fields('<attvalue for="{name}" value="{value}"/>', {c: c for c in columns}), F.lit("</attvalues>"))

    node_lines = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("text")), F.lit('">'), values(own), F.lit("</node>")))
    numbered = edges.withColumn("_n", F.monotonically_increasing_id())
    ends = F.concat(F.lit('<edge id="'), F.col("_n").cast("string"), F.lit('" source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('">'))
    edge_lines = numbered.select(F.concat(ends, values(links), F.lit("</edge>")))
    one_file(nodes.sparkSession, path, [head + "<nodes>\n", node_lines, "</nodes>\n<edges>\n", edge_lines, "</edges>\n</graph>\n</gexf>\n"])


def check_suffix(path: str) -> str:
    """The suffix of an output that write() can make; others are a ValueError, before any work is done."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported output {path!r}; use one of {', '.join(SUFFIXES)}")
    return suffix


def write(network: Network, path: str, min_weight: float = 0.0, top_k: int | None = None, include_terms: bool = False) -> None:
    """Write the network in the format of the path's suffix; .parquet saves all its tables."""
    suffix, filters = check_suffix(path), {"min_weight": min_weight, "top_k": top_k}
    if suffix == ".parquet":
        network.save(path)
    elif suffix in (".json", ".csv"):
        {".json": to_json, ".csv": to_csv}[suffix](network, path, **filters)
    else:
        {".graphml": to_graphml, ".gexf": to_gexf}[suffix](network, path, include_terms=include_terms, **filters)


def connected_parts(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(source, target) -> (id, part, size): the component of each node, named by its least id; for filtering small ones from plots.

    Each round gives every node the least name among its neighbours and itself, and then the name that its own name has, until
    nothing changes.
    """
    from weftnet.functions.tables import staged

    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "plot-edges")
    names = both.select(F.col("a").alias("id")).distinct().withColumn("part", F.col("id"))
    for _ in range(rounds):
        near = both.join(names.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("_near"))
        step = names.join(near, "id").withColumn("_new", F.least("part", "_near"))
        jump = step.select(F.col("id").alias("_new"), F.col("_new").alias("_far"))
        new = staged(step.join(jump, "_new").select("id", F.least("_new", "_far").alias("_new"), "part"), "parts")
        names = new.select("id", F.col("_new").alias("part"))
        if not new.filter("_new <> part").limit(1).count():
            sizes = names.groupBy("part").agg(F.count("*").alias("size"))
            return names.join(sizes, "part").select("id", "part", "size")
    raise RuntimeError("components did not settle")
