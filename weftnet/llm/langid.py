"""Language identification by cross-parsing against suffix automata (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import ddl, table

#: Bounds of the labelled sample: documents of each language, its characters after which no more are taken, and the characters of all
#: languages together. Documents are taken whole; those of up to SAMPLE_DOC_CHARS characters are preferred.
SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS, SAMPLE_DOC_CHARS = 16, 40_000, 8_000_000, 8192
#: Characters that are parsed together, and the parses still running below which each is finished by itself.
GROUP_CHARS, FEW = 1 << 22, 48
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """True for the documents that are never learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS, doc_chars: int = SAMPLE_DOC_CHARS) -> dict[str, str]:
    """lang -> whole labelled texts of at most `docs_per_language` documents, taken until they have `chars` characters.

    The documents are those of least hash in each of so many buckets, found by one aggregation over all labelled rows, so
    the sample is the same whatever the partitions are; a text over `doc_chars` is taken only where its bucket has no shorter one.
    With very many languages each gets its share of `total_chars`, one document at least.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.length(F.trim("text")).between(1, 1 << 30) & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(8), "doc_id")
    long = F.greatest(F.length("text") - doc_chars, F.lit(0))
    picked = labelled.groupBy("lang", F.pmod(order, F.lit(docs_per_language)).alias("bucket")).agg(F.min(F.struct(long.alias("over"), order.alias("h"), "doc_id")).alias("first"))
    picked = picked.select(F.col("lang").alias("_lang"), F.col("first.over").alias("_over"), F.col("first.doc_id").alias("_doc_id"))
    texts = labelled.join(F.broadcast(picked), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    texts = texts.groupBy("_lang", "_doc_id", "_over").agg(F.min("text").alias("text"))
    found: dict[str, list[str]] = {}
    for row in texts.orderBy("_lang", "_over", F.xxhash64(F.lit(8), "_doc_id"), "_doc_id").toLocalIterator():
        own = found.setdefault(row["_lang"], [])
        if sum(map(len, own)) < chars:
            own.append(row["text"])
    share = total_chars // max(1, len(found))
    for own in found.values():
        while len(own) > 1 and sum(map(len, own)) > share:
            own.pop()
    return {name: "\n".join(own) for name, own in found.items()}


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the automaton that accepts every substring of codes; state 0 is its start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves, link


def packed_moves(moves: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, target): the move of state s on c is target[base[s] + c] if check[base[s] + c] is s; else there is none.

    Rows of moves are laid over one another so that their entries don't meet, those with most entries first, so the table has about
    a slot a move, whatever the alphabet is. State 0 has no moves here: in it a phrase begins.
    """
    base = np.zeros(len(moves), np.int32)
    size = sum(map(len, moves)) * 2 + 2 * alphabet + 2
    used = bytearray(size)
    slots: list[tuple[int, int, int]] = []
    start = alphabet
    several = sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: (-len(moves[s]), s))
    for s in several:
        own = sorted(moves[s])
        at, tried = used.find(0, start), 0
        while any(used[at - own[0] + c] for c in own):
            at, tried = used.find(0, at + 1), tried + 1
            if tried == 64:  # what is left below is too full for rows of this size
                start = at
        base[s] = at - own[0]
        for c in own:
            used[base[s] + c] = 1
            slots.append((base[s] + c, s, moves[s][c]))
    at = alphabet - 1
    for s in range(1, len(moves)):
        if len(moves[s]) == 1:
            ((c, q),) = moves[s].items()
            at = used.find(0, at + 1)
            base[s] = at - c
            used[at] = 1
            slots.append((at, s, q))
    size = max([at, *(x[0] for x in slots)]) + alphabet + 1
    check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    if slots:
        where, own, to = np.array(slots, np.int64).T
        check[where], target[where] = own, to
    return base, check, target


class Languages:
    """What is learned from a labelled sample: numbers of letters, and each language's automaton, all in one packed table.

    Letters are numbered over all samples; a letter that a language's sample lacks is a phrase of its own there, however many
    scripts there are. Tables take some 30 bytes for each character of the samples.
    """

    def __init__(self, sample: dict[str, str]):
        letter = np.zeros(0x110000, bool)
        letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        seen = np.zeros(0x110000, bool)
        for text in sample.values():
            seen[_code_points(text)] = True
        known = np.flatnonzero(seen & letter)
        # 0: not a letter; the last number: any letter that no sample has
        self.alphabet = len(known) + 2
        self.classes = np.where(letter, self.alphabet - 1, 0).astype(np.uint16 if self.alphabet <= 1 << 16 else np.int32)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.names, self.bits, self.letters = [], [], []
        parts, starts = [], []
        states = slots = 0
        for name in sorted(sample):
            codes = self.codes(sample[name])
            if not codes.any():
                continue
            moves, _ = suffix_automaton(codes.tolist())
            base, check, target = packed_moves(moves, self.alphabet)
            start = np.full(self.alphabet, states, np.int32)
            for c, q in moves[0].items():
                start[c] = q + states
            parts.append((base + slots, np.where(check < 0, -1, check + states), target + states))
            starts.append(start)
            self.names.append(name)
            self.bits.append(math.log2(max(2, len(codes))))
            self.letters.append(len(np.unique(codes[codes > 0])))
            states, slots = states + len(base), slots + len(check)
        self.roots = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1].astype(np.int32)
        self.base, self.check, self.target = (np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(np.int32) for i in range(3))
        self.starts = np.stack(starts) if starts else np.zeros((0, self.alphabet), np.int32)

    def codes(self, text: str) -> np.ndarray:
        """Numbers of the lower-cased text's letters; anything but letters becomes one 0 for each run."""
        found = self.classes[_code_points(text)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language: shape (texts, languages).

        All texts and languages advance together, one character a step, the longest texts first, so that those still running are
        always the first ones; when few are left, each is gone through by itself.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not len(self.names) or not lengths.any():
            return out
        flat = np.concatenate(texts)
        order = np.argsort(-lengths, kind="stable")
        at, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        few = max(1, FEW // len(self.names))
        step, last = 0, int(size[0])
        while step < last and running[step] >= few:
            k = running[step]
            c = flat[at[:k] + step]
            own = state[:, :k]
            slot = self.base[own] + c
            on = self.check[slot] == own
            state[:, :k] = np.where(on, self.target[slot], self.starts[:, c])
            count[:, :k] += ~on
            step += 1
        if step < last:
            base, check, target = memoryview(self.base), memoryview(self.check), memoryview(self.target)
            for i in range(running[step]):
                rest = flat[at[i] + step : at[i] + size[i]].tolist()
                for l in range(len(self.names)):
                    start, s, n = memoryview(self.starts[l]), int(state[l, i]), 0
                    for c in rest:
                        slot = base[s] + c
                        if check[slot] == s:
                            s = target[slot]
                        else:
                            s = start[c]
                            n += 1
                    count[l, i] += n
        out[order] = count.T
        return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


PREDICTION = {"lang_pred": "string", "score": "double", "bits_per_char": "double", "chance_bits": "double"}


def identify(docs: DataFrame, languages: Languages, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs (but for those named like the added ones), and lang_pred, score, bits_per_char, chance_bits.

    A text is parsed from left to right into the longest phrases that occur in the language's sample; phrases times
    log2(sample length), over the text's length, estimate its bits a character under that language, and the language with
    the fewest wins (ties: by name). score is how far it lies below the next one, (second - first) / second, from 0 to 1; 1 where
    only one language was learned. chance_bits is what a character costs that is drawn at random from the winner's letters. Whole
    texts are parsed, of any length, each in one go. Null, empty and letterless texts, and all texts where nothing was learned,
    get "und" with score 0. Repeated rows each get their row; an empty table gives an empty result.
    """
    keep = [c for c in keep if c not in PREDICTION]
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    # a kept text goes to Python once
    place = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        bits = np.array(known.bits)
        for batch in batches:
            texts = batch.column(place)
            found: list[tuple] = []
            while len(found) < batch.num_rows:
                group, held = [], 0
                while len(found) + len(group) < batch.num_rows and held < GROUP_CHARS:
                    group.append(known.codes(texts[len(found) + len(group)].as_py() or ""))
                    held += len(group[-1])
                needed = known.phrases(group) * bits
                for row, codes in zip(needed, group, strict=True):
                    if not len(row) or not codes.any():
                        found.append((UNDETERMINED, 0.0, None, None))
                        continue
                    b = int(row.argmin())
                    second = float(np.delete(row, b).min()) if len(row) > 1 else math.inf
                    score = 1.0 if second == math.inf else (second - float(row[b])) / second
                    found.append((known.names[b], score, float(row[b]) / len(codes), math.log2(known.letters[b] + 2)))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64())
            more = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], names=[*keep, *PREDICTION])

    told = docs.select(*keep) if place < len(keep) else docs.select(*keep, F.col(text_col).cast("string").alias("_weft_text"))
    return told.mapInArrow(run, ", ".join([ddl(docs, keep), *(f"{c} {k}" for c, k in PREDICTION.items())]))


def learn(docs: DataFrame, **bounds) -> Languages:
    return Languages(labelled_sample(docs, **bounds))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_char")
