"""One pass over texts: sentences, tokens and mentions together, on batches, streams or a single text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.functions.text import STOPWORDS
from weftnet.operators.extract import Gazetteer, SpanExtractor
from weftnet.operators.segment import Segmentation, Segmenter, _token_rows, sentence_spans

#: A row of any kind: s, t or m for a sentence, a token or a mention; place is its number in the document.
ROWS = {"kind": "string", "place": "int", "sent": "int", "start": "int", "end": "int", "text": "string", "label": "string", "score": "double", "is_stop": "boolean", "is_punct": "boolean", "is_space": "boolean", "covered": "boolean", "pos_tag": "string", "lemma": "string", "token_start": "int", "token_end": "int"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
#: Texts that a segmenter or an extractor gets at a time, and rows of a batch.
AT_ONCE, BATCH_ROWS = 64, 100_000


class Annotation(NamedTuple):
    """Rows of a text: sentences (sent, start, end, text); tokens as dictionaries; mentions (ord, sent, start, end, text, label, score, token_start, token_end)."""

    sentences: list[tuple]
    tokens: list[dict[str, Any]]
    mentions: list[tuple]


def segment_default(text: str, stop: frozenset[str] = frozenset(STOPWORDS)) -> Segmentation:
    """Sentences and tokens under the default patterns."""
    sents = sentence_spans(text)
    names = ("pos", "sent", "start", "end", "text", "is_stop", "is_punct", "is_space", "pos_tag", "lemma")
    return Segmentation(sents, [dict(zip(names[1:], row[1:], strict=True)) for _, row in _token_rows(text, sents, stop)])


def put_together(text: str, found: Segmentation, spans: list[tuple]) -> Annotation:
    """Spans (start, end, label, score, text) as mentions of a segmented text, by the rules of align_spans; tokens get covered."""
    sents = [(i, a, b, text[a:b]) for i, (a, b) in enumerate(found.sentences)]
    valid = sorted((s for s in spans if s[1] > s[0]), key=lambda s: (s[0], s[1], s[2], s[4], s[3]))
    if valid and not sents:
        raise ValueError("a document with spans has no sentences")
    starts = [a for _, a, _, _ in sents]
    begun, ended = sorted(t["start"] for t in found.tokens), sorted(t["end"] for t in found.tokens)
    reach = np.zeros(len(found.tokens) + 1, np.int64)
    mentions = []
    for k, (a, b, label, score, own) in enumerate(valid):
        before, upto = (bisect_right(ended, a), bisect_left(begun, b)) if begun else (-1, -1)
        upto = max(before, upto)
        if begun:
            reach[before] += 1
            reach[upto] -= 1
        mentions.append((k, max(0, bisect_right(starts, a) - 1), a, b, own, label, float(score), before, upto))
    covered = np.cumsum(reach) > 0
    return Annotation(sents, [t | {"covered": bool(c)} for t, c in zip(found.tokens, covered, strict=False)], mentions)


class Annotator:
    """A segmenter (None: the default patterns) and an extractor, run on texts; it goes to the workers. Each text is segmented once."""

    def __init__(self, extractor: Gazetteer | SpanExtractor, segmenter: Segmenter | None = None, matcher: Callable | None = None):
        self.extractor, self.segmenter, self._matcher = extractor, segmenter, matcher

    @classmethod
    def of(cls, extractor: Any, segmenter: Segmenter | None, docs: DataFrame) -> Annotator | None:
        """None if the extractor can't run text by text: a function of whole tables, or a dictionary in shards."""
        if isinstance(extractor, SpanExtractor):
            return cls(extractor, segmenter)
        if isinstance(extractor, Gazetteer) and (matcher := extractor._matcher(docs)) is not None:
            return cls(extractor, segmenter, matcher)
        return None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"extractor": None if isinstance(self.extractor, Gazetteer) else self.extractor}

    def annotate(self, texts: list[str]) -> list[Annotation]:
        found = [segment_default(t) for t in texts] if self.segmenter is None else self.segmenter.segment_many(texts)
        if len(found) != len(texts):
            raise RuntimeError(f"segment_many returned {len(found)} results for {len(texts)} texts")
        if self._matcher is not None:
            spans = [[(a, b, label, 1.0, t[a:b]) for a, b, label in self._matcher().matches(t)] for t in texts]
        else:
            given = self.extractor.extract_spans(texts, [s.sentences for s in found])
            if len(given) != len(texts):
                raise RuntimeError(f"extract_spans returned {len(given)} results for {len(texts)} texts")
            spans = [[(s[0], s[1], s[2], float(s[3]) if len(s) > 3 else 1.0, s[4] if len(s) > 4 else t[s[0] : s[1]]) for s in own] for t, own in zip(texts, given, strict=True)]
        return [put_together(t, f, s) for t, f, s in zip(texts, found, spans, strict=True)]

    def rows(self, docs: DataFrame) -> DataFrame:
        """doc_id and ROWS of documents (doc_id, text), lazily, also of a stream; texts meet the segmenter once, and batches stay small."""
        names = list(ROWS)

        def flat(a: Annotation) -> Iterator[dict]:
            for i, start, end, own in a.sentences:
                yield {"kind": "s", "place": i, "sent": i, "start": start, "end": end, "text": own}
            for i, t in enumerate(a.tokens):
                yield {"kind": "t", "place": i, **t}
            for k, sent, start, end, own, label, score, first, last in a.mentions:
                yield {"kind": "m", "place": k, "sent": sent, "start": start, "end": end, "text": own, "label": label, "score": score, "token_start": first, "token_end": last}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner: list[int] = []
                columns: dict[str, list] = {c: [] for c in names}

                def made() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *(pa.array(columns[c], _ARROW[k]) for c, k in ROWS.items())], names=["doc_id", *names])  # noqa: B023

                for at in range(0, batch.num_rows, AT_ONCE):
                    texts = [t or "" for t in batch.column(1).slice(at, AT_ONCE).to_pylist()]
                    for i, found in enumerate(self.annotate(texts), at):
                        for row in flat(found):
                            owner.append(i)
                            for c in names:
                                columns[c].append(row.get(c))
                            if len(owner) >= BATCH_ROWS:
                                yield made()
                                owner, columns = [], {c: [] for c in names}
                yield made()

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in ROWS.items()))


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, tokens with covered, mentions) of an annotator's rows."""
    sents = rows.filter("kind = 's'").select("doc_id", "sent", "start", "end", "text")
    toks = rows.filter("kind = 't'").select("doc_id", F.col("place").alias("pos"), "sent", "start", "end", "text", "is_stop", "is_punct", "is_space", "pos_tag", "lemma", "covered")
    mentions = rows.filter("kind = 'm'").select("doc_id", F.col("place").alias("ord"), "sent", "start", "end", "text", "label", "score", "token_start", "token_end")
    return sents, toks, mentions
