"""Documents to sentences and tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.functions.text import BOUNDARY, STOPWORDS, TOKEN

SENTENCES_SCHEMA = "sent int, start int, end int, text string"
TOKENS_SCHEMA = "pos int, sent int, start int, end int, text string, is_stop boolean, is_punct boolean, is_space boolean, pos_tag string, lemma string"


_BOUNDARY, _TOKEN = re.compile(BOUNDARY), re.compile(TOKEN)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of a text's sentences under the default boundaries, in order, by code points; blank ones are left out."""
    found, at = [], 0
    for m in [*_BOUNDARY.finditer(text), None]:
        end = len(text) if m is None else m.start() + len(m[1] or "")
        own = text[at:end]
        if kept := own.strip():
            start = at + len(own) - len(own.lstrip())
            found.append((start, start + len(kept)))
        at = len(text) if m is None else m.end()
    return found


def token_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a sentence."""
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def in_rows(docs: DataFrame, columns: dict[str, str], rows: Callable[[str], list[tuple]]) -> DataFrame:
    """(doc_id, text) -> doc_id and columns (name: type): the tuples that rows gives for each text, made in Arrow batches.

    A batch is cut where it has some 200,000 rows, so that a very long text, or many, don't make one large batch.
    """
    schema = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            found: list[tuple] = []

            def rows_so_far() -> pa.RecordBatch:
                made = [pa.array(c, schema[k]) for c, k in zip(zip(*found, strict=True), columns.values(), strict=True)] if found else [pa.array([], schema[k]) for k in columns.values()]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *made], names=["doc_id", *columns])  # noqa: B023

            for i, text in enumerate(batch.column(1)):
                own = rows(text.as_py() or "")
                found += own
                owner += [i] * len(own)
                if len(found) >= 200_000:
                    yield rows_so_far()
                    owner, found = [], []
            yield rows_so_far()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in columns.items()))


def columns_of(schema: str) -> dict[str, str]:
    return dict(c.split() for c in schema.split(", "))


def sentences(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, sent, start, end, text) under the default boundaries."""
    return in_rows(docs, columns_of(SENTENCES_SCHEMA), lambda text: [(i, a, b, text[a:b]) for i, (a, b) in enumerate(sentence_spans(text))])


def tokens(docs: DataFrame, stopwords: Collection[str] | None = None) -> DataFrame:
    """documents -> (doc_id, pos, sent, start, end, text, is_stop, is_punct, is_space, pos_tag, lemma) under the default patterns."""
    stop = frozenset(STOPWORDS if stopwords is None else (w.lower() for w in stopwords))
    return in_rows(docs, columns_of(TOKENS_SCHEMA), lambda text: [t for _, t in _token_rows(text, sentence_spans(text), stop)])


def _token_rows(text: str, sents: list[tuple[int, int]], stop: frozenset[str]) -> Iterator[tuple[tuple[int, int], tuple]]:
    """((start, end), row of TOKENS_SCHEMA) of each token."""
    pos = 0
    for sent, (a, b) in enumerate(sents):
        for m in _TOKEN.finditer(text, a, b):
            own = m[0]
            yield m.span(), (pos, sent, m.start(), m.end(), own, own.lower() in stop, not (own[0].isalnum() or any(c.isalnum() for c in own)), False, "", "")
            pos += 1


class Segmentation(NamedTuple):
    """What a custom segmenter returns for a text: rows of SENTENCES_SCHEMA without text, and of TOKENS_SCHEMA without pos."""

    sentences: list[tuple[int, int]]
    tokens: list[dict[str, Any]]


class Segmenter:
    """Base of custom segmenters. Subclasses give segment(text); instances are sent to the workers, so models load lazily."""

    def segment(self, text: str) -> Segmentation:
        raise NotImplementedError

    def segment_many(self, texts: list[str]) -> list[Segmentation]:
        return [self.segment(t) for t in texts]


class PatternSegmenter(Segmenter):
    """Own patterns: a first group of the boundary pattern, if it has one, stays with the sentence on the left."""

    def __init__(self, boundary: str, token: str, stopwords: Collection[str] | None = None):
        self.boundary, self.token = re.compile(boundary), re.compile(token)
        self.stopwords = frozenset(STOPWORDS if stopwords is None else (w.lower() for w in stopwords))

    def segment(self, text: str) -> Segmentation:
        cuts, at = [], 0
        for m in self.boundary.finditer(text):
            kept = len(m.group(1) or "") if self.boundary.groups else 0
            cuts.append((at, m.start() + kept))
            at = m.end()
        spans = []
        for start, end in [*cuts, (at, len(text))]:
            own = text[start:end]
            lead = len(own) - len(own.lstrip())
            if own.strip():
                spans.append((start + lead, start + lead + len(own.strip())))
        found = []
        for i, (start, end) in enumerate(spans):
            for m in self.token.finditer(text, start, end):
                surface = m.group()
                found.append({"sent": i, "start": m.start(), "end": m.end(), "text": surface, "is_stop": surface.lower() in self.stopwords, "is_punct": not any(c.isalnum() for c in surface), "is_space": surface.isspace(), "pos_tag": "", "lemma": ""})
        return Segmentation(spans, found)


class SpacySegmenter(Segmenter):
    """Sentences and tokens of a spaCy pipeline, loaded once in each worker; needs spaCy there."""

    def __init__(self, model: str = "en_core_web_sm", disable: tuple[str, ...] = ("ner",), max_length: int | None = None):
        self.model, self.disable, self.max_length, self._loaded = model, disable, max_length, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _pipeline(self):
        if self._loaded is None:
            try:
                import spacy
            except ImportError as e:
                raise ImportError("SpacySegmenter needs spaCy on the executors") from e
            pipeline = spacy.load(self.model, disable=list(self.disable))
            if not {"parser", "senter", "sentencizer"} & set(pipeline.pipe_names):
                pipeline.add_pipe("sentencizer")
            pipeline.max_length = max(pipeline.max_length, self.max_length or 0)
            self._loaded = pipeline
        return self._loaded

    def segment(self, text: str) -> Segmentation:
        return spacy_rows(self._pipeline()(text))

    def segment_many(self, texts: list[str]) -> list[Segmentation]:
        return [spacy_rows(d) for d in self._pipeline().pipe(texts)]


def spacy_rows(doc: Any) -> Segmentation:
    """A parsed spaCy document as rows; token positions are spaCy's own."""
    spans = [(s.start_char, s.end_char) for s in doc.sents]
    rows = []
    for i, sent in enumerate(doc.sents):
        for t in sent:
            rows.append({"sent": i, "start": t.idx, "end": t.idx + len(t.text), "text": t.text, "is_stop": t.is_stop, "is_punct": t.is_punct, "is_space": t.is_space, "pos_tag": t.pos_, "lemma": t.lemma_})
    return Segmentation(spans, rows)


def _by_segmenter(docs: DataFrame, schema: str, rows: Callable[[Segmentation, str], list[dict]], segmenter: Segmenter) -> DataFrame:
    columns = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            out = [{"doc_id": i} | row for i, text, found in zip(batch["doc_id"], texts, segmenter.segment_many(texts), strict=True) for row in rows(found, text)]
            yield pd.DataFrame(out, columns=columns)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def segment_with(docs: DataFrame, segmenter: Segmenter) -> tuple[DataFrame, DataFrame]:
    """(sentences, tokens) by a custom segmenter, in Arrow batches."""
    found = _by_segmenter(docs, SENTENCES_SCHEMA, lambda s, text: [{"sent": i, "start": a, "end": b, "text": text[a:b]} for i, (a, b) in enumerate(s.sentences)], segmenter)
    parts = _by_segmenter(docs, TOKENS_SCHEMA, lambda s, text: [{"pos": i} | t for i, t in enumerate(s.tokens)], segmenter)
    return found, parts
