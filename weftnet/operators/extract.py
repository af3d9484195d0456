"""Entity spans: dictionaries, user functions and models."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from itertools import pairwise
from typing import Any
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.functions.text import STOPWORDS
from weftnet.operators.dictionary import Matcher, PackedDictionary
from weftnet.operators.segment import _token_rows, columns_of, in_rows, sentence_spans

ANNOTATED_SCHEMA = "kind string, place int, sent int, start int, end int, text string, label string, is_stop boolean, is_punct boolean"
SPANS_SCHEMA = "start int, end int, label string, score double, text string"
#: Dictionaries up to this many surfaces go to every worker as they are (some 50 MB); larger ones in packed arrays, in shards of so many bytes.
WORKER_SURFACES, SHARD_BYTES = 200_000, 256 * 1024 * 1024


class Gazetteer:
    """label -> surface forms. The same surface under two labels takes the last one; no surface at all is a ValueError."""

    def __init__(self, surfaces: Mapping[str, list[str]], case_sensitive: bool = False):
        self.case_sensitive = case_sensitive
        self.label_of: dict[str, str] = {}
        self.forms: list[str] = []
        for label, own in surfaces.items():
            for surface in (s.strip() for s in own):
                if surface:
                    self.label_of[self.key(surface)] = label
                    self.forms.append(surface)
        self._shards: list[PackedDictionary] | None = None
        self._local: Matcher | None = None
        if not self.forms:
            raise ValueError("the gazetteer has no surface forms")

    def key(self, surface: str) -> str:
        return surface if self.case_sensitive else surface.lower()

    @property
    def labels(self) -> frozenset[str]:
        return frozenset(self.label_of.values())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shards": None, "_local": None}

    def labelled(self) -> Iterator[tuple[str, str]]:
        """(surface, label) of all forms."""
        return ((s, self.label_of[self.key(s)]) for s in dict.fromkeys(self.forms))

    def shards(self, most_bytes: int = SHARD_BYTES) -> list[PackedDictionary]:
        """The dictionary in packed arrays, each of most_bytes or so, as each goes to all workers; surfaces are dealt by their digests."""
        if self._shards is None:
            own = list(self.labelled())
            size = sum(60 + 2 * len(s.encode("utf-8", "surrogatepass")) for s, _ in own)
            n = -(-size // most_bytes)
            dealt: list[list[tuple[str, str]]] = [[] for _ in range(n)]
            for form in own:
                dealt[crc32(form[0].encode("utf-8", "surrogatepass")) % n].append(form)
            self._shards = [PackedDictionary(d, self.case_sensitive) for d in dealt if d]
        return self._shards

    def local_matcher(self) -> Matcher:
        """The dictionary as it is, for single texts on this machine."""
        if self._local is None:
            self._local = Matcher(list(self.labelled()), self.case_sensitive)
        return self._local

    def _matcher(self, docs: DataFrame) -> Callable[[], Matcher | PackedDictionary] | None:
        """What gives a worker its dictionary, or None if that has to be sharded. A small one goes with the function, a large one is broadcast."""
        if len(self.label_of) <= WORKER_SURFACES:
            matcher = Matcher(list(self.labelled()), self.case_sensitive)
            return lambda: matcher
        if len(shards := self.shards()) > 1:
            return None
        sent = docs.sparkSession.sparkContext.broadcast(shards[0])
        return lambda: sent.value

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc_id, start, end, label, score, text): non-overlapping matches from left to right, the longest at each place."""
        matcher = self._matcher(docs)
        if matcher is None:
            return self._by_shards(docs, self.shards())
        return in_rows(docs, columns_of(SPANS_SCHEMA), lambda text: [(a, b, label, 1.0, text[a:b]) for a, b, label in matcher().matches(text)])

    def annotate(self, docs: DataFrame, kinds: str = "smt", window: int = 0) -> DataFrame | None:
        """A row for each sentence, token and mention of documents under the default segmentation, by its kind: s, t or m.

        One pass over the texts gives those of the kinds asked for: doc_id, kind, place (its number in the document), sent, start, end, text,
        label, is_stop, is_punct. Tokens that a mention overlaps are left out. Kind c has the sentences of mentions, and those from a mention to another
        one at most window sentences behind it, which are those of all contexts. None for dictionaries that don't fit a worker.
        """
        matcher, stop = self._matcher(docs), frozenset(STOPWORDS)
        if matcher is None:
            return None

        def rows(text: str) -> list[tuple]:
            sents = sentence_spans(text)
            out = [("s", i, i, a, b, text[a:b], "", False, False) for i, (a, b) in enumerate(sents)] if "s" in kinds else []
            if kinds == "s":
                return out
            found = matcher().matches(text)
            starts = [a for a, _ in sents]
            owner = [max(0, bisect_right(starts, a) - 1) for a, _, _ in found]
            if "m" in kinds:
                out += [("m", k, i, a, b, text[a:b], label, False, False) for k, (i, (a, b, label)) in enumerate(zip(owner, found, strict=True))]
            if "c" in kinds:
                between = sorted({*owner, *(i for x, y in pairwise(owner) if y - x <= window for i in range(x, y + 1))})
                out += [("c", i, i, *sents[i], text[slice(*sents[i])], "", False, False) for i in between]
            if "t" not in kinds:
                return out
            at = 0
            for (a, b), row in _token_rows(text, sents, stop):
                while at < len(found) and found[at][1] <= a:
                    at += 1
                if at == len(found) or found[at][0] >= b:
                    out.append(("t", *row[:5], "", *row[5:7]))
            return out

        return in_rows(docs, columns_of(ANNOTATED_SCHEMA), rows)

    def _by_shards(self, docs: DataFrame, shards: list[PackedDictionary]) -> DataFrame:
        """Matches of each shard, a pass over the texts each; then one exchange of the matches, of which the leftmost-longest are kept.

        The matches of a document go by in order in one task, which holds the end of the last one kept.
        """
        found = None
        for shard in shards:
            sent = docs.sparkSession.sparkContext.broadcast(shard)
            own = in_rows(docs, columns_of(SPANS_SCHEMA), lambda text, sent=sent: [(a, b, label, 1.0, text[a:b]) for a, b, label in sent.value.all_matches(text)])
            found = own if found is None else found.unionByName(own)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, free = None, 0
            for batch in batches:
                take = []
                for i, (doc, start, end) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                    if doc != last:
                        last, free = doc, 0
                    if start >= free:
                        take.append(i)
                        free = end
                yield batch.take(pa.array(take, pa.int32()))

        ordered = found.repartition("doc_id").sortWithinPartitions("doc_id", "start", F.desc("end"))
        return ordered.mapInArrow(kept, ordered.schema)


class SpanExtractor:
    """Base of extractors that run Python on the workers. extract_spans gives, for each text, (start, end, label, score[, text]) tuples."""

    def extract_spans(self, texts: list[str], sentences: list[list[tuple[int, int]]]) -> list[list[tuple]]:
        raise NotImplementedError

    def spans(self, docs: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
        """Spans of all documents; sentences (doc_id, sent, start, end) are handed to extract_spans where given."""
        rows = docs.select("doc_id", "text")
        if sentences is not None:
            by_doc = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent", "start", "end"))).alias("_sents"))
            rows = rows.join(by_doc, "doc_id", "left")
        else:
            rows = rows.withColumn("_sents", F.array().cast("array<struct<sent:int,start:int,end:int>>"))
        extractor = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = batch["text"].fillna("").tolist()
                bounds = [[(s["start"], s["end"]) for s in (own if own is not None else [])] for own in batch["_sents"]]
                found = extractor.extract_spans(texts, bounds)
                if len(found) != len(texts):
                    raise RuntimeError(f"extract_spans returned {len(found)} results for {len(texts)} texts")
                out = [(i, s[0], s[1], s[2], float(s[3]) if len(s) > 3 else 1.0, s[4] if len(s) > 4 else text[s[0] : s[1]]) for i, text, own in zip(batch["doc_id"], texts, found, strict=True) for s in own]
                yield pd.DataFrame(out, columns=["doc_id", "start", "end", "label", "score", "text"])

        return rows.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SPANS_SCHEMA}")


class FunctionExtractor(SpanExtractor):
    """Spans by a function from a text to (start, end, label, score) tuples."""

    def __init__(self, function: Callable[[str], list[tuple]]):
        self.function = function

    def extract_spans(self, texts: list[str], sentences: list[list[tuple[int, int]]]) -> list[list[tuple]]:
        return [self.function(t) for t in texts]


class SpacyExtractor(SpanExtractor):
    """Named entities of a spaCy pipeline, loaded once in each worker. labels=None keeps all."""

    def __init__(self, model: str = "en_core_web_sm", labels: tuple[str, ...] | None = ("PERSON", "NORP", "FAC", "ORG", "GPE", "LOC")):
        self.model, self.labels, self._loaded = model, labels, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def extract_spans(self, texts: list[str], sentences: list[list[tuple[int, int]]]) -> list[list[tuple]]:
        if self._loaded is None:
            try:
                import spacy
            except ImportError as e:
                raise ImportError("SpacyExtractor needs spaCy on the executors") from e
            self._loaded = spacy.load(self.model)
        return [[(e.start_char, e.end_char, e.label_, 1.0, e.text) for e in d.ents if self.labels is None or e.label_ in self.labels] for d in self._loaded.pipe(texts)]


class ModelExtractor(SpanExtractor):
    """Zero-shot span models, over chunks of whole sentences.

    load() gives, once in each worker, a function (chunks, labels, threshold) -> for each chunk a list of dictionaries with start,
    end, label, score. Chunks hold at most max_chunk_words words: sentences are added while they fit, and a sentence that
    is longer by itself is cut at white space. Offsets are moved back to the text, labels renamed by label_map.
    """

    def __init__(self, load: Callable[[], Callable], labels: list[str], threshold: float = 0.5, max_chunk_words: int = 200, batch_size: int = 8, label_map: Mapping[str, str] | None = None):
        if not labels:
            raise ValueError("labels must not be empty")
        if max_chunk_words < 1:
            raise ValueError("max_chunk_words must be 1 or more")
        self.load, self.labels, self.threshold, self.max_chunk_words, self.batch_size, self.label_map = load, labels, threshold, max_chunk_words, batch_size, dict(label_map or {})
        self._model: Any = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def chunks(self, text: str, sentences: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of text that are scored together."""
        groups: list[list[int]] = []
        for start, end in sentences or ([(0, len(text))] if text.strip() else []):
            n = len(text[start:end].split())
            if groups and groups[-1][2] and groups[-1][2] + n > self.max_chunk_words:
                groups.append([start, end, n])
            elif groups:
                groups[-1][1:] = [end, groups[-1][2] + n]
            else:
                groups.append([start, end, n])
        return [piece for start, end, _ in groups for piece in self._cut(text, start, end)]

    def _cut(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Pieces of at most max_chunk_words words; each keeps the white space behind it, so that together they are the whole."""
        begins = [m.start() for m in re.finditer(r"\S+", text[start:end])]
        if len(begins) <= self.max_chunk_words:
            return [(start, end)]
        cuts = [start, *(start + at for at in begins[self.max_chunk_words :: self.max_chunk_words]), end]
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def extract_spans(self, texts: list[str], sentences: list[list[tuple[int, int]]]) -> list[list[tuple]]:
        if self._model is None:
            self._model = self.load()
        jobs = [(i, a, b) for i, (text, own) in enumerate(zip(texts, sentences, strict=True)) for a, b in self.chunks(text, own)]
        out: list[list[tuple]] = [[] for _ in texts]
        for at in range(0, len(jobs), self.batch_size):
            part = jobs[at : at + self.batch_size]
            scored = self._model([texts[i][a:b] for i, a, b in part], self.labels, self.threshold)
            if len(scored) != len(part):
                raise RuntimeError(f"the model returned {len(scored)} results for {len(part)} chunks")
            for (i, a, _), own in zip(part, scored, strict=True):
                out[i] += [(e["start"] + a, e["end"] + a, self.label_map.get(e["label"], e["label"]), e.get("score", 1.0)) for e in own]
        return out


def gliner_loader(model: str, device: str = "cpu", **options: Any) -> Callable[[], Callable]:
    """load for ModelExtractor with a GLiNER model; needs the gliner package on the executors."""

    def load() -> Callable:
        try:
            from gliner import GLiNER
        except ImportError as e:
            raise ImportError("this loader needs the gliner package on the executors") from e
        loaded = GLiNER.from_pretrained(model, map_location=device, **options)
        predict = getattr(loaded, "inference", None) or loaded.batch_predict_entities
        return lambda chunks, labels, threshold: predict(chunks, labels, threshold=threshold)

    return load
