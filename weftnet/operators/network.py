"""The network: its tables, and the questions they answer."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.config import NetworkConfig
from weftnet.functions.tables import dense_ids, path_exists, staged, top_rows, write_sorted
from weftnet.functions.text import normal_name
from weftnet.operators import build
from weftnet.operators.build import Normaliser

FORMAT = 1
TABLES = ("documents", "sentences", "entities", "terms", "mentions", "term_occurrences", "histogram", "entity_terms")
#: What a saved table is sorted by, so that a question about one entity, term or document reads only its rows.
SORTED_BY = {"sentences": ("doc_id", "sent"), "mentions": ("entity_id", "mention_id"), "term_occurrences": ("doc_id", "sent"), "histogram": ("src", "dst"), "entity_terms": ("entity_id", "term_id"), "adjacency": ("src", "dst")}


class Rows:
    """A table of a network: rows, or a function that makes them when they are asked for."""

    def __set_name__(self, owner: type, name: str) -> None:
        self.key = f"_{name}"

    def __get__(self, network: Network | None, owner: type | None = None) -> DataFrame:
        if network is None:
            raise AttributeError(self.key)
        rows = network.__dict__[self.key]
        return rows() if callable(rows) else rows

    def __set__(self, network: Network, rows: DataFrame | Callable[[], DataFrame]) -> None:
        network.__dict__[self.key] = rows


def once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """make, run when it is first called; what it gave is kept."""
    lock, made = threading.Lock(), []

    def rows() -> DataFrame:
        with lock:
            if not made:
                made.append(make())
        return made[0]

    return rows


@dataclass(repr=False)
class Network:
    """Tables of a network and the questions they answer; every answer is a lazy DataFrame unless a single value is asked for.

    documents(doc_id, n_sentences); sentences(doc_id, sent, start, end, text); entities(entity_id, norm, label, text, count);
    terms(term_id, text, pos, count); mentions(mention_id, doc_id, sent, start, end, score, entity_id); term_occurrences(doc_id, sent,
    start, end, term_id); histogram(src, dst, delta, n); entity_terms(entity_id, term_id, n). adjacency, where there is one, is the
    histogram in both directions, sorted by src: questions about one entity read only its rows of it. Each of TABLES may be given as a
    function, which is called when the table is asked for.
    """

    config: NetworkConfig
    documents: DataFrame = Rows()
    sentences: DataFrame = Rows()
    entities: DataFrame = Rows()
    terms: DataFrame = Rows()
    mentions: DataFrame = Rows()
    term_occurrences: DataFrame = Rows()
    histogram: DataFrame = Rows()
    entity_terms: DataFrame = Rows()
    normalise: Normaliser = field(default=normal_name)
    adjacency: DataFrame | None = None
    session: SparkSession | None = None
    #: Gives (doc_id, sent, text) of the sentences of mentions and between mentions within the window, where they can be had without all others.
    between: Callable[[], DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.session or self.entities.sparkSession

    def changed(self, **other) -> Network:
        """The network with other fields; tables that haven't been made aren't."""
        return Network(**{f.name: self.__dict__[f"_{f.name}" if f.name in TABLES else f.name] for f in fields(self)} | other)

    # building, keeping, reading

    @classmethod
    def from_annotations(cls, documents: DataFrame, sentences: DataFrame, tokens: DataFrame, mentions: DataFrame | Callable[[], DataFrame], config: NetworkConfig | None = None, normalise: Normaliser = normal_name, aliases: DataFrame | None = None, check: bool = True) -> Network:
        """Network of annotated documents.

        documents: doc_id; sentences: doc_id, sent, start, end, text; tokens (as of segment.tokens, without those that mentions cover);
        mentions: doc_id, ord, sent, start, end, text, label, score. doc_id gives the order of documents and must be unique. A
        repeated doc_id, and a mention or a token of a sentence that its document hasn't, are a ValueError; check=False leaves the
        latter out, for annotations that are right as they are made. A map column meta of documents is kept. A table is made and
        written when it is first asked for, with those it needs, and kept then: what is given must stay as it is until then. Without check
        mentions may be a function that gives them.
        """
        config = config or NetworkConfig()
        if twice := documents.groupBy("doc_id").count().filter("count > 1").limit(1).collect():
            raise ValueError(f"document id {twice[0]['doc_id']!r} occurs more than once")
        if check:
            counted = sentences.groupBy("doc_id").agg(F.count("*").alias("_n"))
            for kind, rows in (("mention", mentions), ("token", tokens)):
                bad = rows.select("doc_id", "sent", "text").join(counted, "doc_id", "left").filter("sent < 0 or sent >= coalesce(_n, 0)")
                if found := bad.limit(1).collect():
                    raise ValueError(f"{kind} {found[0]['text']!r} of document {found[0]['doc_id']!r} is in sentence {found[0]['sent']}, but the document has {found[0]['_n'] or 0}")
        named = once(lambda: staged(build.named_mentions(mentions() if callable(mentions) else mentions, normalise, aliases), "named"))
        entities = once(lambda: staged(build.entity_vocabulary(named()), "entities"))
        words = once(lambda: staged(build.term_occurrences(tokens, config), "words"))
        terms = once(lambda: staged(build.term_vocabulary(words()), "terms"))

        def place() -> DataFrame:
            rows = named().join(entities().select("entity_id", "norm", "label"), ["norm", "label"])
            rows = dense_ids(rows.select("doc_id", "sent", "start", "end", "score", "ord", "entity_id"), ["doc_id", "sent", "start", "ord"], "mention_id")
            return staged(rows.drop("ord"), "mentions")

        def find() -> DataFrame:
            known = terms().select("term_id", F.col("text").alias("base"), F.col("pos").alias("tag"))
            return staged(words().join(known, ["base", "tag"]).select("doc_id", "sent", "start", "end", "term_id"), "term_occurrences")

        def size() -> DataFrame:
            counted = sentences.groupBy("doc_id").agg(F.count("*").alias("n_sentences"))
            rows = documents.select("doc_id", *[c for c in ("meta",) if c in documents.columns]).join(counted, "doc_id", "left")
            return staged(rows.withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0).cast("long"))), "documents")

        placed, found = once(place), once(find)
        return cls(
            config,
            documents=once(size),
            sentences=once(lambda: staged(sentences if config.store_text else sentences.withColumn("text", F.lit(None).cast("string")), "sentences")),
            entities=lambda: entities().drop("first_doc", "first_ord"),
            terms=lambda: terms().drop("first_doc", "first_pos"),
            mentions=placed,
            term_occurrences=found,
            histogram=once(lambda: staged(build.cooccurrence_histogram(build.sentence_counts(placed(), "entity_id"), config.window), "histogram")),
            entity_terms=once(lambda: staged(build.entity_term_counts(build.sentence_counts(placed(), "entity_id"), build.sentence_counts(found(), "term_id")), "entity_terms")),
            normalise=normalise,
            session=documents.sparkSession,
        )

    def save(self, path: str) -> None:
        """A Parquet table for each of TABLES and the adjacency under path, sorted for look-ups, and meta, which holds the format's version and the configuration."""
        for name in (*TABLES, "adjacency"):
            rows = both_ways(self.histogram) if name == "adjacency" else getattr(self, name)
            if keys := SORTED_BY.get(name):
                write_sorted(rows, f"{path}/{name}", *keys, mode="overwrite")
            else:
                rows.write.mode("overwrite").parquet(f"{path}/{name}")
        self.spark.createDataFrame([(FORMAT, self.config.to_json())], "format int, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, normalise: Normaliser = normal_name) -> Network:
        if not path_exists(spark, f"{path}/meta"):
            raise FileNotFoundError(f"no network at {path}")
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["format"] != FORMAT:
            raise ValueError(f"format {meta['format']} of {path} can't be read; this version reads {FORMAT}")
        adjacency = spark.read.parquet(f"{path}/adjacency") if path_exists(spark, f"{path}/adjacency") else None
        return cls(NetworkConfig.from_json(meta["config"]), *[spark.read.parquet(f"{path}/{name}") for name in TABLES], normalise, adjacency)

    # vocabulary

    def entity(self, ref: int | str | tuple[str, str] | Row) -> Row:
        """Entity row by id, row, (text, label) or a text that has one label; KeyError if there is none, or more than one."""
        if isinstance(ref, Row):
            return ref
        if isinstance(ref, int):
            found = self.entities.filter(F.col("entity_id") == ref).limit(2).collect()
        else:
            text, label = ref if isinstance(ref, tuple) else (ref, None)
            rows = self.entities.filter(F.col("norm") == self._normal(text))
            found = (rows if label is None else rows.filter(F.col("label") == label)).limit(2).collect()
        if len(found) != 1:
            raise KeyError(f"{len(found) or 'no'} entities match {ref!r}")
        return found[0]

    def _normal(self, text: str) -> str:
        return self.spark.range(1).select(self.normalise(F.lit(text)).alias("n")).first()["n"]

    def find_entity(self, text: str, label: str) -> Row | None:
        try:
            return self.entity((text, label))
        except KeyError:
            return None

    def term(self, ref: int | str | tuple[str, str] | Row) -> Row:
        """Term row by id, row, text, or (text, part of speech)."""
        if isinstance(ref, Row):
            return ref
        if isinstance(ref, int):
            found = self.terms.filter(F.col("term_id") == ref).limit(2).collect()
        else:
            text, pos = ref if isinstance(ref, tuple) else (ref, "")
            found = self.terms.filter((F.col("text") == (text.lower() if self.config.lowercase_terms else text)) & (F.col("pos") == pos)).limit(2).collect()
        if len(found) != 1:
            raise KeyError(f"no term matches {ref!r}")
        return found[0]

    def entity_labels(self) -> DataFrame:
        return self.entities.select("label").distinct().orderBy("label")

    def top_entities(self, k: int | None = 10, label: str | None = None) -> DataFrame:
        rows = self.entities if label is None else self.entities.filter(F.col("label") == label)
        return top_rows(rows, k, F.desc("count"), F.asc("entity_id"))

    def top_terms(self, k: int | None = 10) -> DataFrame:
        return top_rows(self.terms, k, F.desc("count"), F.asc("term_id"))

    # edges

    @cached_property
    def all_edges(self) -> DataFrame:
        """(src, dst, weight, count), src < dst, under the network's decay."""
        return self.reweighted(self.config.decays)

    def reweighted(self, decays: Sequence[float]) -> DataFrame:
        """Edges under other decay values, from the same counts; values beyond those given drop their distances."""
        return build.edge_list(self.histogram.filter(F.col("delta") < len(decays)), list(decays))

    def directed(self) -> DataFrame:
        """Each edge in both directions."""
        e = self.all_edges
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "count"))

    def edges_of(self, ref, weighting: str = "raw") -> DataFrame:
        """(src, dst, weight) of an entity's edges, as src, weighting raw or load; only its own rows are read where the network has an adjacency."""
        if weighting not in ("raw", "load"):
            raise ValueError("weighting is 'raw' or 'load'")
        own = self.entity(ref)["entity_id"]
        near = F.col("src") == own
        if self.adjacency is None:
            return (self.directed().select("src", "dst", "weight") if weighting == "raw" else self.load_edges()).filter(near)
        rows = build.edge_list(self.adjacency.filter(near & (F.col("delta") < len(self.config.decays))), self.config.decays)
        return rows.select("src", "dst", "weight") if weighting == "raw" else self._loads(rows)

    def edge_table(self, min_weight: float = 0.0, top_k: int | None = None, labels: Iterable[str] | None = None) -> DataFrame:
        """(src, dst, weight, count) by falling weight. min_weight <= 0 filters nothing; a negative top_k neither; labels hold for both ends."""
        rows = self.all_edges
        if min_weight > 0:
            rows = rows.filter(F.col("weight") >= min_weight)
        if labels is not None:
            allowed = self.entities.filter(F.col("label").isin(list(labels))).select("entity_id")
            rows = rows.join(allowed.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(allowed.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select("src", "dst", "weight", "count")
        return top_rows(rows, None if top_k is None or top_k < 0 else top_k, F.desc("weight"), F.asc("src"), F.asc("dst"))

    def _with_names(self, rows: DataFrame, column: str, prefix: str) -> DataFrame:
        names = self.entities.select(F.col("entity_id").alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in ("text", "label", "norm")])
        return rows.join(names, column)

    def edges(self, min_weight: float = 0.0, top_k: int | None = None, labels: Iterable[str] | None = None) -> DataFrame:
        """edge_table with the names of both ends, which are joined after the limit."""
        return self._with_names(self._with_names(self.edge_table(min_weight, top_k, labels), "src", "source"), "dst", "target").orderBy(F.desc("weight"), "src", "dst")

    def neighbors(self, ref, k: int | None = None, min_weight: float = 0.0, weighting: str = "raw") -> DataFrame:
        """(entity_id, weight) of an entity's neighbours by falling weight; weighting raw or load. Weights must exceed 0 and reach min_weight."""
        rows = self.edges_of(ref, weighting).filter((F.col("weight") > 0) & (F.col("weight") >= min_weight))
        return top_rows(rows.select(F.col("dst").alias("entity_id"), "weight"), k, F.desc("weight"), F.asc("entity_id"))

    def weight(self, a, b) -> float:
        """Weight of the edge between two entities, 0 without one."""
        row = self._pair(a, b)
        return row["weight"] if row else 0.0

    def count(self, a, b) -> int:
        row = self._pair(a, b)
        return row["count"] if row else 0

    def _pair(self, a, b) -> Row | None:
        x, y = sorted((self.entity(a)["entity_id"], self.entity(b)["entity_id"]))
        rows = self.histogram.filter((F.col("src") == x) & (F.col("dst") == y))
        return build.edge_list(rows, self.config.decays).first()

    def load_weight(self, a, b) -> float:
        """Importance of b for a."""
        other = self.entity(b)["entity_id"]
        row = self.edges_of(a, "load").filter(F.col("dst") == other).first()
        return row["weight"] if row else 0.0

    def load_edges(self) -> DataFrame:
        """(src, dst, weight): ln(entities of dst's label / neighbours of src with that label) times the edge's weight.

        Pairs whose factor is ln 1 are no edges; that is decided on the two counts, which are whole numbers.
        """
        return self._loads(self.directed())

    def _loads(self, directed: DataFrame) -> DataFrame:
        """load_edges of the edges given, which must have all of each src they have."""
        label = self.entities.select(F.col("entity_id").alias("dst"), F.col("label").alias("dst_label"))
        both = directed.join(label, "dst")
        sizes = self.entities.groupBy(F.col("label").alias("dst_label")).agg(F.count("*").alias("_size"))
        degrees = both.groupBy("src", "dst_label").agg(F.count("*").alias("_degree"))
        rows = both.join(degrees, ["src", "dst_label"]).join(sizes, "dst_label").filter("_size <> _degree")
        return rows.select("src", "dst", (F.ln(F.col("_size") / F.col("_degree")) * F.col("weight")).alias("weight"))

    # terms

    def terms_of(self, ref, k: int | None = None) -> DataFrame:
        own = self.entity(ref)["entity_id"]
        return top_rows(self.entity_terms.filter(F.col("entity_id") == own).select("term_id", "n"), k, F.desc("n"), F.asc("term_id"))

    def entities_of(self, ref, k: int | None = None) -> DataFrame:
        own = self.term(ref)["term_id"]
        return top_rows(self.entity_terms.filter(F.col("term_id") == own).select("entity_id", "n"), k, F.desc("n"), F.asc("entity_id"))

    def strongest_terms(self, k: int | None) -> DataFrame:
        """(entity_id, term_id, n) of each entity's k strongest terms."""
        if k is None:
            return self.entity_terms
        order = Window.partitionBy("entity_id").orderBy(F.desc("n"), F.asc("term_id"))
        return self.entity_terms.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")

    def sentence_entities(self) -> DataFrame:
        return build.sentence_counts(self.mentions, "entity_id")

    def sentence_terms(self) -> DataFrame:
        return build.sentence_counts(self.term_occurrences, "term_id")

    # places

    def document(self, doc_id) -> Row:
        """A document's row: doc_id, meta where the documents had it, n_sentences; KeyError without one."""
        row = self.documents.filter(F.col("doc_id") == doc_id).first()
        if row is None:
            raise KeyError(doc_id)
        return row

    def sentence(self, doc_id, sent: int) -> Row:
        """A sentence by its document and its number there."""
        row = self.sentences.filter((F.col("doc_id") == doc_id) & (F.col("sent") == sent)).first()
        if row is None:
            raise KeyError((doc_id, sent))
        return row

    def mention(self, mention_id: int) -> Row:
        row = self.mentions.filter(F.col("mention_id") == mention_id).first()
        if row is None:
            raise KeyError(mention_id)
        return row

    def numbered_sentences(self) -> DataFrame:
        """sentences with sentence_id: 0, 1, ... in document order."""
        return dense_ids(self.sentences, ["doc_id", "sent"], "sentence_id")

    def mentions_of(self, ref) -> DataFrame:
        return self.mentions.filter(F.col("entity_id") == self.entity(ref)["entity_id"]).orderBy("mention_id")

    def sentences_of(self, ref) -> DataFrame:
        own = self.mentions.filter(F.col("entity_id") == self.entity(ref)["entity_id"]).select("doc_id", "sent").distinct()
        return self.sentences.join(own, ["doc_id", "sent"], "left_semi").orderBy("doc_id", "sent")

    def sentences_of_document(self, doc_id) -> DataFrame:
        if not self.documents.filter(F.col("doc_id") == doc_id).limit(1).count():
            raise KeyError(f"no document {doc_id!r}")
        return self.sentences.filter(F.col("doc_id") == doc_id).orderBy("sent")

    def cooccurrences(self, a, b) -> DataFrame:
        """A row for each pair of mentions of two entities, in corpus order; only the mentions of these two are joined."""
        x, y = self.entity(a)["entity_id"], self.entity(b)["entity_id"]
        if x == y:
            raise ValueError("the two entities are the same")
        return self._weighed(build.cooccurrences(self.mentions.filter(F.col("entity_id").isin(x, y)), self.config.window)).orderBy("source", "target")

    def all_cooccurrences(self) -> DataFrame:
        """A row for each cooccurrence of the network; read it with toLocalIterator() or write it, never collect it."""
        return self._weighed(build.cooccurrences(self.mentions, self.config.window))

    def _weighed(self, pairs: DataFrame) -> DataFrame:
        values = F.array(*[F.lit(v) for v in self.config.decays])
        return pairs.withColumn("weight", F.element_at(values, F.col("delta").cast("int") + 1)).filter("weight <> 0")

    def with_contexts(self, pairs: DataFrame, cooccurring: bool = False) -> DataFrame:
        """pairs (doc_id, first_sent, last_sent, ...) with context: the sentences from first to last, joined by spaces.

        cooccurring: the pairs are cooccurrences of this network, so that sentences away from mentions aren't needed.
        """
        if not self.config.store_text:
            raise RuntimeError("the network was built without sentence texts")
        # only the sentences of the pairs' own spans are gathered: each span, of window + 1 sentences at most, is put together once
        spans = pairs.select("doc_id", "first_sent", "last_sent").distinct()
        each = spans.withColumn("sent", F.explode(F.sequence("first_sent", "last_sent")))
        texts = self.between() if cooccurring and self.between else self.sentences.select("doc_id", "sent", "text")
        told = each.join(texts, ["doc_id", "sent"])
        told = told.groupBy("doc_id", "first_sent", "last_sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "text"))), lambda s: s["text"]), " ").alias("context"))
        return pairs.join(told, ["doc_id", "first_sent", "last_sent"])

    def mentioning(self) -> DataFrame:
        """(doc_id, sent, text) of the sentences with a mention."""
        rows = self.between() if self.between else self.sentences.select("doc_id", "sent", "text")
        return rows.join(self.mentions.select("doc_id", "sent").distinct(), ["doc_id", "sent"], "left_semi")

    def contexts(self, a, b) -> DataFrame:
        return self.with_contexts(self.cooccurrences(a, b), True).orderBy("source", "target")

    # ranking

    def _query(self, query) -> list[int]:
        """Ids of one reference or a sequence of them, without repeats. A tuple of two strings is one (text, label)."""
        one = isinstance(query, (int, str, Row)) or isinstance(query, tuple) and len(query) == 2 and all(isinstance(x, str) for x in query)
        ids = list(dict.fromkeys(self.entity(q)["entity_id"] for q in ([query] if one else query)))
        if not ids:
            raise ValueError("the query is empty")
        return ids

    def rank_entities(self, query, label: str | None = None, k: int | None = 10, weighting: str = "load") -> DataFrame:
        """(entity_id, score): entities connected to the query, by how many of its entities they are connected to and by their weights.

        score = (connected - 1) + sum of weights / largest such sum among the candidates, which label restricts.
        """
        if weighting not in ("raw", "load"):
            raise ValueError("weighting is 'raw' or 'load'")
        ids = self._query(query)
        rows = self.directed() if weighting == "raw" else self.load_edges()
        rows = rows.filter(F.col("src").isin(ids) & ~F.col("dst").isin(ids) & (F.col("weight") != 0))
        found = rows.groupBy(F.col("dst").alias("entity_id")).agg(_ordered_sum(F.col("src"), F.col("weight")).alias("_sum"), F.count("*").alias("_n"))
        if label is not None:
            found = found.join(self.entities.filter(F.col("label") == label).select("entity_id"), "entity_id", "left_semi")
        best = found.agg(F.greatest(F.max("_sum"), F.lit(_TINY)).alias("_max"))
        scored = found.crossJoin(F.broadcast(best)).select("entity_id", ((F.col("_n") - 1) + F.col("_sum") / F.col("_max")).alias("score"))
        return top_rows(scored, k, F.desc("score"), F.asc("entity_id"))

    def _sentence_scores(self, ids: list[int], n_terms: int) -> DataFrame:
        """(doc_id, sent, cohesion, overlap): query entities in each sentence, and the share of the query's important terms in it."""
        cohesion = self.sentence_entities().filter(F.col("entity_id").isin(ids)).groupBy("doc_id", "sent").agg(F.count("*").alias("cohesion"))
        order = Window.partitionBy("entity_id").orderBy(F.desc("n"), F.asc("term_id"))
        important = self.entity_terms.filter(F.col("entity_id").isin(ids)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n_terms).select("term_id").distinct()
        size = important.agg(F.count("*").alias("_size"))
        # the query's entities times n_terms bound the important terms
        hits = self.sentence_terms().join(F.broadcast(important), "term_id", "left_semi").groupBy("doc_id", "sent").agg(F.count("*").alias("_hits"))
        overlap = hits.crossJoin(F.broadcast(size)).select("doc_id", "sent", (F.col("_hits") / F.col("_size")).alias("overlap"))
        both = cohesion.join(overlap, ["doc_id", "sent"], "full_outer")
        return both.select("doc_id", "sent", F.coalesce("cohesion", F.lit(0).cast("long")).alias("cohesion"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))

    def rank_sentences(self, query, k: int | None = 10, n_terms: int = 10) -> DataFrame:
        """(doc_id, sent, score) of sentences with a query entity: cohesion + overlap."""
        rows = self._sentence_scores(self._query(query), n_terms).filter("cohesion > 0")
        return top_rows(rows.select("doc_id", "sent", (F.col("cohesion") + F.col("overlap")).alias("score")), k, F.desc("score"), F.asc("doc_id"), F.asc("sent"))

    def rank_documents(self, query, k: int | None = 10, n_terms: int = 10) -> DataFrame:
        """(doc_id, score): best cohesion of a sentence + the document's overlaps, over the largest such sum of a document with a query entity."""
        rows = self._sentence_scores(self._query(query), n_terms)
        docs = rows.groupBy("doc_id").agg(F.max("cohesion").alias("_c"), _ordered_sum(F.col("sent"), F.col("overlap")).alias("_s")).filter("_c > 0")
        best = docs.agg(F.greatest(F.max("_s"), F.lit(_TINY)).alias("_max"))
        scored = docs.crossJoin(F.broadcast(best)).select("doc_id", (F.col("_c") + F.col("_s") / F.col("_max")).alias("score"))
        return top_rows(scored, k, F.desc("score"), F.asc("doc_id"))

    # sizes

    def sizes(self) -> DataFrame:
        """One row: n_documents, n_sentences, n_entities, n_terms, n_mentions, n_edges."""
        counts = {"n_documents": self.documents, "n_sentences": self.sentences, "n_entities": self.entities, "n_terms": self.terms, "n_mentions": self.mentions, "n_edges": self.all_edges}
        one = None
        for name, rows in counts.items():
            row = rows.agg(F.count("*").alias(name))
            one = row if one is None else one.crossJoin(row)
        return one

    def summary(self, top: int = 10) -> str:
        s = self.sizes().first()
        lines = ["table\trows", *[f"{name.removeprefix('n_')}\t{n}" for name, n in s.asDict().items()]]
        lines += ["", "entity\tlabel\tmentions", *["\t".join(map(str, (r["text"], r["label"], r["count"]))) for r in self.top_entities(top).collect()]]
        lines += ["", "from\tto\tweight\tcooccurrences", *[f"{r['source_text']}\t{r['target_text']}\t{r['weight']:.6g}\t{r['count']}" for r in self.edges(top_k=top).collect()]]
        return "\n".join(lines)


_TINY = 2.2250738585072014e-308


def _ordered_sum(order: Column, value: Column) -> Column:
    """Sum of floats in a fixed order, so that results don't depend on how rows are dealt; for short groups."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), F.lit(0.0), lambda s, x: s + x["v"])


def both_ways(histogram: DataFrame) -> DataFrame:
    """(src, dst, delta, n) in both directions."""
    return histogram.select("src", "dst", "delta", "n").unionByName(histogram.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "delta", "n"))


def entity_key(norm: Column, label: Column) -> Column:
    return F.concat_ws("|", norm, label)
