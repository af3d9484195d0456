"""From documents to a network in one call."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.config import NetworkConfig
from weftnet.functions.tables import staged
from weftnet.functions.text import normal_name
from weftnet.operators.align import align_spans, uncovered_tokens
from weftnet.operators.annotate import Annotation, Annotator, tables
from weftnet.operators.build import Normaliser
from weftnet.operators.context import EdgeClusterer
from weftnet.operators.extract import Gazetteer, SpanExtractor, SpacyExtractor
from weftnet.operators.network import Network, once
from weftnet.operators.segment import Segmenter, segment_with, sentences, tokens


class NetworkPipeline:
    """An extractor, the network's configuration, and optionally a clusterer and a segmenter.

    extractor: a Gazetteer, a SpanExtractor, or a function from documents to spans; by default spaCy. Give either config or its
    fields by name.
    """

    def __init__(self, extractor=None, config: NetworkConfig | None = None, clusterer: EdgeClusterer | None = None, segmenter: Segmenter | None = None, normalise: Normaliser = normal_name, aliases: DataFrame | None = None, **fields):
        if config is not None and fields:
            raise ValueError("give either config or its fields, not both")
        self.config = config or replace(NetworkConfig(), **fields)
        self._extractor, self.clusterer, self.segmenter, self.normalise, self.aliases = extractor, clusterer, segmenter, normalise, aliases

    @property
    def extractor(self):
        if self._extractor is None:
            self._extractor = SpacyExtractor()
        return self._extractor

    def annotate(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """documents (doc_id, text) -> (sentences, tokens, mentions).

        Extractors that run text by text do so in one pass with the segmenter, whose rows are written once; others are joined, lazily.
        """
        if (annotator := Annotator.of(self.extractor, self.segmenter, docs)) is not None:
            sents, toks, mentions = tables(staged(annotator.rows(docs), "annotated"))
            return sents, toks.drop("covered"), mentions
        return self._by_tables(docs)

    def _by_tables(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        sents, toks = segment_with(docs, self.segmenter) if self.segmenter else (sentences(docs), tokens(docs))
        spans = self.extractor.spans(docs) if isinstance(self.extractor, Gazetteer) else self.extractor(docs)
        return sents, toks, align_spans(spans, sents)

    def annotated_rows(self, docs: DataFrame) -> DataFrame:
        """Sentences, tokens and mentions of documents as rows of their kinds, lazily; docs may be a stream."""
        annotator = Annotator.of(self.extractor, self.segmenter, docs)
        if annotator is None:
            raise TypeError("the extractor doesn't run text by text")
        return annotator.rows(docs)

    def annotate_text(self, text: str) -> Annotation:
        """The annotation of a single text, here and now, by the function that the workers run."""
        if isinstance(self.extractor, Gazetteer):
            return Annotator(self.extractor, self.segmenter, self.extractor.local_matcher).annotate([text])[0]
        if isinstance(self.extractor, SpanExtractor):
            return Annotator(self.extractor, self.segmenter).annotate([text])[0]
        raise TypeError("the extractor doesn't run text by text")

    def annotate_all(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """annotate(), with all three tables written."""
        return tuple(staged(t, "annotation") for t in self.annotate(docs))

    def run(self, docs: DataFrame) -> Network:
        sents, toks, mentions = self.annotate_for_terms(docs)
        own = isinstance(self.extractor, Gazetteer) and self.segmenter is None
        if not own or not self.config.store_text or (found := self.extractor.annotate(docs, "mc", self.config.window)) is None:
            return Network.from_annotations(docs, sents, toks, mentions, self.config, self.normalise, self.aliases, check=not own)
        # mentions and the sentences between them, a small part of all, come from one pass
        both = once(lambda: staged(found, "mentioned"))
        network = Network.from_annotations(docs, sents, toks, lambda: _mentions(both().filter("kind = 'm'")), self.config, self.normalise, self.aliases, check=False)
        return network.changed(between=lambda: both().filter("kind = 'c'").select("doc_id", "sent", "text"))

    def annotate_for_terms(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Like annotate, with only the tokens that no mention covers.

        With a dictionary that fits a worker each table is a pass over the texts of its own, lazily: tokens take many times the disk of
        the texts, and most questions don't need them.
        """
        if isinstance(self.extractor, Gazetteer) and self.segmenter is None and self.extractor.annotate(docs) is not None:
            of = lambda kind: self.extractor.annotate(docs, kind)
            sents = of("s").select("doc_id", "sent", "start", "end", "text")
            mentions = _mentions(of("m"))
            toks = of("t").select("doc_id", F.col("place").alias("pos"), "sent", "start", "end", "text", "is_stop", "is_punct", F.lit(False).alias("is_space"), F.lit("").alias("pos_tag"), F.lit("").alias("lemma"))
            return sents, toks, mentions
        if (annotator := Annotator.of(self.extractor, self.segmenter, docs)) is not None:
            sents, toks, mentions = tables(staged(annotator.rows(docs), "annotated"))
            return sents, toks.filter("not covered").drop("covered"), mentions
        sents, toks, mentions = self._by_tables(docs)
        mentions = staged(mentions, "aligned")
        return sents, uncovered_tokens(toks, mentions), mentions

    def cluster(self, network: Network, **which) -> DataFrame:
        if self.clusterer is None:
            raise RuntimeError("the pipeline has no clusterer")
        return self.clusterer.cluster_edges(network, **which)


def _mentions(rows: DataFrame) -> DataFrame:
    """A dictionary's rows of mentions with the columns of mentions."""
    return rows.select("doc_id", F.col("place").alias("ord"), "sent", "start", "end", "text", "label", F.lit(1.0).alias("score"), F.lit(-1).alias("token_start"), F.lit(-1).alias("token_end"))


def build_network(docs: DataFrame, extractor=None, **options) -> Network:
    return NetworkPipeline(extractor, **options).run(docs)
