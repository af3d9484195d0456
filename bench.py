"""Headline queries of the entity network at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query is timed once, after one warm-up build on the same session that compiles the code; its rows are counted, not shown.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from pathlib import Path

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from weftnet.functions.tables import shared_dir  # noqa: E402
from weftnet.operators.network import Network  # noqa: E402
from weftnet.plans import queries as plans  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = plans.queries()
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    docs = plans._docs(spark, sf_dir)
    plans._pipeline().run(docs.limit(200)).all_edges.count()  # warm-up
    timed("build_network", lambda: plans.widest(spark, sf_dir).all_edges)
    wide: list = []
    timed("wide_build", lambda: wide.append(plans.wide_network(spark, sf_dir)) or wide[0].all_edges)
    strongest = wide[0].edge_table(top_k=1).first()
    timed("wide_edges_top_k", lambda: wide[0].edges(top_k=100))
    timed("wide_neighbors", lambda: wide[0].neighbors(strongest["src"], 100))
    timed("wide_rank_entities", lambda: wide[0].rank_entities([strongest["src"], strongest["dst"]], k=100))
    timed("wide_cooccurrences", lambda: wide[0].cooccurrences(strongest["src"], strongest["dst"]))
    kept = f"{shared_dir(spark)}/weftnet/bench-{uuid.uuid4().hex[:12]}"
    timed("wide_save", lambda: wide[0].save(kept) or wide[0].entities.limit(1))
    laid = Network.load(spark, kept)
    laid.neighbors(strongest["src"], 100).count()
    timed("laid_neighbors", lambda: laid.neighbors(strongest["src"], 100))
    timed("laid_cooccurrences", lambda: laid.cooccurrences(strongest["src"], strongest["dst"]))
    for name in ("seg_tokens", "gazetteer_mentions", "edges_exponential", "edges_top_k", "neighbors_raw", "load_weights", "rank_entities_multi", "rank_sentences", "rank_documents", "cooccurrence_instances", "contexts", "all_cooccurrences", "entity_terms", "rel_edges", "rel_terms", "context_clusters"):
        timed(name, lambda name=name: registered[name](spark, sf_dir))
    n_tokens = registered["seg_tokens"](spark, sf_dir).agg(F.sum("n_tokens")).first()[0]
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "tokens": n_tokens, "build_tokens_per_sec": round(n_tokens / took["build_network"]), "wide_edges": wide[0].all_edges.count()}))


if __name__ == "__main__":
    sys.exit(main())
