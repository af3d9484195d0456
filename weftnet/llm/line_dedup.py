"""Repeated runs of lines, found by winnowing over line hashes (operator 9)."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import ddl, digest, staged, table, whole

#: Words of a block, the least that is ever deleted, and words of a window: every repeated run of so many is found.
BLOCK_WORDS, WINDOW_WORDS = 10, 25

FOUND_SCHEMA = "hashes array<bigint>, picks array<struct<g:bigint,p:int>>"


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """A 64-bit hash and the number of words of each line; white space at the ends and its amount between words don't count."""
    hashes, words = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()
        hashes.append(xxhash.xxh64_intdigest(b" ".join(own), 9))
        words.append(len(own))
    return hashes, words


def winnow(hashes: list[int], words: list[int], block_words: int = BLOCK_WORDS, window_words: int = WINDOW_WORDS) -> list[tuple[int, int]]:
    """Selected blocks (hash, first line), in order.

    A block at a line is the shortest run of lines from it that has `block_words` words. A window at a line is the shortest run
    from it that has `window_words`; the least block hash inside each window is selected, the last one of equal ones. Whatever
    stands around it, a run of lines that holds a whole window gives the same selection in it: the guarantee. A text too short for
    a window is one window.
    """
    n = len(hashes)
    ends, wide = _reach(words, block_words), _reach(words, window_words)
    values = [xxhash.xxh64_intdigest(struct.pack(f"<{ends[i] - i}Q", *hashes[i : ends[i]])) if ends[i] <= n else 0 for i in range(n)]
    picked: list[tuple[int, int]] = []
    queue: deque[int] = deque()
    upto = 0
    for i in range(n):
        end = wide[i]
        if end > n:
            if i:
                break
            end = n
        while upto < n and ends[upto] <= end:
            while queue and values[queue[-1]] >= values[upto]:
                queue.pop()
            queue.append(upto)
            upto += 1
        while queue and queue[0] < i:
            queue.popleft()
        if queue and (not picked or picked[-1][1] != queue[0]):
            picked.append((values[queue[0]], queue[0]))
    return picked


def _reach(words: list[int], least: int) -> list[int]:
    """For each line, the end (exclusive) of the shortest run from it with `least` words; beyond the text if there is none."""
    n, out, end, held = len(words), [], 0, 0
    for i in range(n):
        while end < n and held < least:
            held += words[end]
            end += 1
        out.append(end if held >= least else n + 1)
        held -= words[i]
    return out


def extend(later: list[int], earlier: list[int], p: int, q: int) -> tuple[int, int]:
    """The longest run [first, end) of lines of `later` around line p that equals the run of `earlier` around line q."""
    left = 0
    while p - left > 0 and q - left > 0 and later[p - left - 1] == earlier[q - left - 1]:
        left += 1
    right = 0
    while p + right < len(later) and q + right < len(earlier) and later[p + right] == earlier[q + right]:
        right += 1
    return p - left, p + right


def named(block: int, p: int, hashes: list[int], words: list[int], block_words: int = BLOCK_WORDS) -> list[int]:
    """Names under which a selected block at line p is looked up: by itself, with the line before it, and with the line behind it.

    Each name is matched with its own first occurrence, so a block that stands in several surroundings meets the first text
    with the same neighbour on either side, and not only the first text of all.
    """
    end, held = p, 0
    while held < block_words:
        held += words[end]
        end += 1
    around = [(1, hashes[p - 1])] if p else []
    around += [(2, hashes[end])] if end < len(hashes) else []
    return [block, *(xxhash.xxh64_intdigest(struct.pack("<3Q", block, side, line)) for side, line in around)]


def _signed(x: int) -> int:
    return (x & 0xFFFFFFFFFFFFFFFF) - (1 << 64 if x & (1 << 63) else 0)


def _found(rows: DataFrame, block_words: int, window_words: int) -> DataFrame:
    """(_no_id, _id, _key, _text) -> (_no_id, _id, _key, hashes, picks)."""
    kind = pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_hashes, all_picks = [], []
            for text in batch.column(3):
                hashes, words = line_hashes(text.as_py())
                all_picks.append([{"g": _signed(g), "p": p} for h, p in winnow(hashes, words, block_words, window_words) for g in named(h, p, hashes, words, block_words)])
                all_hashes.append(np.array(hashes, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(all_hashes, pa.list_(pa.int64())), pa.array(all_picks, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["_no_id", "_id", "_key", "hashes", "picks"])

    return rows.mapInArrow(run, f"{ddl(rows, ['_no_id', '_id', '_key'])}, {FOUND_SCHEMA}")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(_key, _runs): for each text with repeated runs, the line ranges [first, end) to delete, in order; they may overlap.

    _key is the digest of id and text. All occurrences of a selected block but the first in the corpus, by (id, nulls last; digest
    of the text; line), are joined to that first one, and so they are to the first with the same line before, and with the same line
    behind; each match is extended both ways over the lines of the two texts.
    Each deleted line has an equal line at an earlier place, so one copy of every line stays. Occurrences are matched with
    first ones only, never with each other: a block in a third of all texts gives three matches an occurrence at most.
    """
    key = text_key(F.col(id_col), F.col(text_col))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).isNull().alias("_no_id"), F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    found = _found(rows, block_words, window_words).filter(F.size("picks") > 0)
    # equal rows are one text
    found = staged(found.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("_no_id", "_id", "hashes", "picks")]), "lines")

    picks = found.select("_no_id", "_id", "_key", F.explode("picks").alias("_pick")).select("_no_id", "_id", "_key", "_pick.g", "_pick.p")
    place = F.struct("_no_id", "_id", "_key", "p")
    first = picks.groupBy("g").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("g", F.col("_first._key").alias("_from"), F.col("_first.p").alias("q"))
    matches = picks.select("g", "_key", "p").join(first, "g").filter((F.col("_key") != F.col("_from")) | (F.col("p") != F.col("q")))
    pairs = matches.groupBy("_key", "_from").agg(F.collect_set(F.struct("p", "q")).alias("_at"))
    earlier = found.select(F.col("_key").alias("_from"), F.col("hashes").alias("_earlier"))
    both = pairs.join(earlier, "_from").join(found.select("_key", F.col("hashes").alias("_later")), "_key").select("_key", "_at", "_later", "_earlier")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, later, earlier in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                later, earlier, runs = later.as_py(), earlier.as_py(), []
                for p, q in sorted((x["p"], x["q"]) for x in at.as_py()):
                    if not (runs and runs[-1][0] <= p < runs[-1][1] and runs[-1][2] == p - q):
                        runs.append((*extend(later, earlier, p, q), p - q))
                out.append([{"first": a, "end": b} for a, b, _ in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["_key", "_runs"])

    runs = both.mapInArrow(run, "_key binary, _runs array<struct<first:int,end:int>>")
    return runs.groupBy("_key").agg(F.array_sort(F.flatten(F.collect_list("_runs"))).alias("_runs"))


def text_key(doc_id: Column, text: Column) -> Column:
    return digest(doc_id, text)


def delete_runs(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the runs deleted from text_col, and n_lines, n_removed (long)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    place = names.index(text_col)
    keyed = docs.select(whole(docs, names).alias("_row"), text_key(F.col(id_col), F.col(text_col)).alias("_key"))
    joined = keyed.join(runs, "_key", "left").select("_row", "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            columns = batch.column(0).flatten()
            for text, runs in zip(columns[place], batch.column(1), strict=True):
                text, runs = text.as_py(), runs.as_py()
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                kept = lines
                if runs:
                    kept, at = [], 0
                    for r in runs:  # in order of their first lines
                        kept += lines[at : r["first"]]
                        at = max(at, r["end"])
                    kept += lines[at:]
                n_removed.append(len(lines) - len(kept))
                texts.append("\n".join(kept) if text is not None else None)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, f"{ddl(docs, names)}, n_lines long, n_removed long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """docs with later repeated runs of lines deleted, and n_lines, n_removed (long).

    See repeated_runs for what goes. Every run of whole lines with WINDOW_WORDS words or more that stands at an earlier place has
    a selected block there, and goes as far as it agrees with the first text that has the block; runs of BLOCK_WORDS to
    WINDOW_WORDS words may be found; shorter ones stay, unless they adjoin a longer one. A text all of whose lines
    repeat becomes empty; its row stays. Null texts stay null with 0 lines; an empty text has one line; rows equal in id and
    text are one text and are all treated alike; an empty table gives an empty result; other columns pass through.
    """
    return delete_runs(docs, repeated_runs(docs, id_col, text_col, **sizes), id_col, text_col)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
