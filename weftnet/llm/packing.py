"""Best-fit packing of token sequences with bounded open bins (operator 10)."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import ddl, row_hash, staged, table, whole

#: Tokens of a sequence; the token that ends each document.
CAPACITY, END = 2048, 0
#: Open bins of a packing task, and the pieces that a task gets at least.
OPEN_BINS, TASK_PIECES = 512, 20_000
#: Words whose ids a worker keeps, the first that it meets (some 70 MB in all). If it is full and more than this share of a group's
#: words isn't in it, it is filled anew.
CACHE_WORDS, STALE = 120_000, 0.2

PIECES = "piece int, start long, length long, ids_crc32 long"
_END_OF_WORD = "</w>"
_NEVER_CP1252 = b"\x81\x8d\x8f\x90\x9d"


def _classes() -> tuple[bytes, bytes, bytes, bytes]:
    """Letters, digits and white space among the bytes of code page 1252, and the table that lower-cases its bytes."""
    chars = {b: bytes([b]).decode("cp1252") for b in range(256) if bytes([b]) not in [_NEVER_CP1252[i : i + 1] for i in range(5)]}
    letters = bytes(b for b, c in chars.items() if c.isalpha())
    digits = bytes(b for b, c in chars.items() if not c.isalpha() and c.isnumeric())
    lower = bytearray(range(256))
    for b, c in chars.items():
        lower[b] = c.lower().encode("cp1252")[0]
    return letters, digits, b"\t\n\x0b\x0c\r \xa0", bytes(lower)


class WordIds:
    """Ids of whole texts under a lower-casing BPE vocabulary whose words end in a marked token, as the tokenizer library gives them.

    Such a vocabulary encodes each word by itself, so a worker keeps the ids of the words that it has met and asks the library
    only for new ones, many at a time. That holds for texts in code page 1252, in which letters, digits, white space, lower case
    and composition are the same in every Unicode version; all other texts go to the library whole. So does everything if the
    tokenizer doesn't behave that way on a probe of every such character.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith(_END_OF_WORD)]] = True
        #: a text that holds one of these goes to the library whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters, digits, spaces, self.lower = _classes()
        as_class = lambda bs: b"".join(b"\\x%02x" % b for b in bs)
        self.words = re.compile(b"[%b]+|'(?:s|t|re|ve|m|ll|d)|[%b]|[^%b]+" % (as_class(letters), as_class(digits), as_class(letters + digits + spaces)))
        self.ids: dict[bytes, bytes] = {}
        probe = " ".join(f"a{chr(c)}b {chr(c)} Z{chr(c)}{chr(c)}9" for b in range(256) if bytes([b])[0] not in _NEVER_CP1252 for c in [ord(bytes([b]).decode("cp1252"))])
        probe += " it's THEY'RE we'll I'd 'tis ''s don't!? «1½»"
        self.by_word = False
        whole = self.whole(probe)
        try:
            self.by_word = True
            self.by_word = self.encode([probe])[0] == whole
        except (ValueError, KeyError):
            self.by_word = False

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, a thousand in one call of the library."""
        learned = {}
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            line = b" ".join(part).decode("cp1252")
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                raise ValueError("words don't end in marked tokens")
            raw, start = ids.astype("<u4").tobytes(), 0
            for word, end in zip(part, ends, strict=True):
                learned[word] = raw[4 * start : 4 * end]
                start = end
        return learned

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found: list = []
        for text in texts:
            try:
                plain = self.by_word and not any(s in text for s in self.special)
                found.append(self.words.findall(text.encode("cp1252").translate(self.lower)) if plain else None)
            except UnicodeEncodeError:
                found.append(None)
        known = self.ids
        ids = [None if words is None else list(map(known.get, words)) for words in found]
        gaps = [[] if own is None else [i for i, x in enumerate(own) if x is None] for own in ids]
        unknown = {words[i] for words, at in zip(found, gaps, strict=True) for i in at}
        learned = self.learn(list(unknown))
        for words, own, at in zip(found, ids, gaps, strict=True):
            for i in at:
                own[i] = learned[words[i]]
        if len(known) >= CACHE_WORDS and sum(map(len, gaps)) > STALE * sum(len(own) for own in ids if own is not None):
            known.clear()
        known.update(islice(learned.items(), max(0, CACHE_WORDS - len(known))))
        return [self.whole(t) if own is None else b"".join(own) for t, own in zip(texts, ids, strict=True)]


_encoders: dict[str, WordIds] = {}


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text, ...) -> a row for each piece: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and then the id `end`; null is the empty text. Documents longer than `capacity` are cut there;
    only their last piece may be shorter. Texts are encoded whole. doc_id keeps its type and may be null or repeat: each row
    is a document of its own. Other columns are left out; an empty table gives an empty result.
    """
    closing = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordIds(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(1).slice(at, 64).to_pylist()]
                for row, ids in enumerate(encoder.encode(texts), at):
                    ids += closing
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        for column, value in zip(out, (row, piece, start, len(own) // 4, zlib.crc32(own)), strict=True):
                            column.append(value)
            rows, *columns = [pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"{ddl(docs, ['doc_id'])}, {PIECES}")


class BestFit:
    """Online best fit with at most `limit` open bins.

    Bins of equal free space form a list; bit f of `spaces` is set while the list of free space f isn't empty. The bin for an
    item is one of the smallest sufficient free space: the lowest set bit from the item's length on. If no bin fits while
    `limit` bins are open, the fullest, at the lowest set bit of all, is closed.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.spaces, self.open = capacity, limit, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Number of the bin that takes the item, and the item's place in it."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        if left := space - length:
            self.bins[left].append(number)
            self.spaces |= 1 << left
            self.open += 1
        return number, self.capacity - space


def _best_fit(items: DataFrame, tasks: int, capacity: int, open_bins: int, name: str) -> DataFrame:
    """Add <name> (long) and <name>_offset (long) to items, which have a column length (long) and are dealt to tasks by _deal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BestFit(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for at in range(0, len(lengths), 2 * open_bins):
                for i in (at + np.argsort(-lengths[at : at + 2 * open_bins], kind="stable")).tolist():
                    bins[i], offsets[i] = packer.put(int(lengths[i]))
            more = [pa.array(bins + first), pa.array(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, name, f"{name}_offset"])

    dealt = items.repartition(tasks, "_deal").sortWithinPartitions("_deal", *[c for c in items.columns if c != "_deal"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, {name} long, {name}_offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES, seed: int = 10) -> DataFrame:
    """Add sequence_id and offset (long) to pieces, which have a column length from 1 to capacity.

    Full pieces are sequences by themselves. The others are dealt at random, by a hash of all their columns, to tasks of about
    `task_pieces` pieces, which pack them by online best fit over `open_bins` open bins. Of what has come in, twice as many
    pieces as there may be open bins are placed longest first, so that the short ones fill what the long ones leave. A task
    leaves its last bins part filled, `open_bins` at most; bins with free space are packed again, as items, by a sixteenth of the tasks,
    and so on until a level has had one task or saves no bin. As items, bins fill each other less well than pieces do: what that loses
    depends on the open bins for each of a task's pieces, which is why tasks are large (at 512 of 20,000 and more it is a few
    sequences in 40,000). Whatever the sizes, all but one sequence of each task of the last level are over half full, as a bin is
    opened for an item only if it fits in no other. Only counts reach the driver.

    Repeated rows are pieces of their own; an empty table gives an empty result; other columns pass through, except that columns
    named sequence_id or offset are replaced.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = whole(pieces, names)
    placed = staged(pieces.select(row.alias("_row"), F.col("length").cast("long").alias("length"), row_hash(pieces, names, seed).alias("_deal")), "pieces")
    tasks = max(1, placed.filter(F.col("length") < capacity).count() // task_pieces)
    full = placed.filter(F.col("length") >= capacity).select("_row", F.monotonically_increasing_id().alias("_bin"), F.lit(0).cast("long").alias("_at"), F.lit(0).alias("_kind"))
    first = _best_fit(placed.filter(F.col("length") < capacity), tasks, capacity, open_bins, "_bin")
    packed = staged(first.select("_row", "_bin", F.col("_bin_offset").alias("_at"), F.lit(1).alias("_kind"), "length"), "packed")

    # (_bin, _kind) names a bin: what a level packs again gets new numbers under the level's kind; the bins' items are small rows
    bins = packed.groupBy("_bin", "_kind").agg(F.sum("length").alias("length"))
    moves, level = None, 1
    while tasks > 1:
        tasks, level = max(1, tasks // 16), level + 1
        items = bins.filter(F.col("length") < capacity).withColumn("_deal", F.xxhash64(F.lit(seed + level), "_bin", "_kind"))
        again = staged(_best_fit(items, tasks, capacity, open_bins, "_outer").select("_bin", "_kind", "length", "_outer", "_outer_offset"), "repacked")
        sizes = again.agg(F.count("*").alias("n"), F.countDistinct("_outer").alias("m")).first()
        if sizes["m"] >= sizes["n"]:
            break
        step = again.select("_bin", "_kind", F.col("_outer").alias("_to"), F.col("_outer_offset").alias("_shift"), F.lit(level).alias("_level"))
        moves = step if moves is None else _followed(moves, step)
        bins = again.groupBy(F.col("_outer").alias("_bin"), F.lit(level).alias("_kind")).agg(F.sum("length").alias("length"))
    if moves is not None:
        told = packed.join(moves, ["_bin", "_kind"], "left")
        packed = told.select("_row", F.coalesce("_to", "_bin").alias("_bin"), (F.col("_at") + F.coalesce("_shift", F.lit(0))).alias("_at"), F.coalesce("_level", "_kind").alias("_kind"))
    both = packed.select("_row", "_bin", "_at", "_kind").unionByName(full)
    return both.select("_row.*", (F.col("_bin") * 16 + F.col("_kind")).alias("sequence_id"), F.col("_at").alias("offset"))


def _followed(moves: DataFrame, step: DataFrame) -> DataFrame:
    """Where the bins of the first level have gone, after one more level: moves (_bin, _kind, _to, _shift, _level), then step."""
    onward = step.select(F.col("_bin").alias("_to"), F.col("_kind").alias("_level"), F.col("_to").alias("_next"), F.col("_shift").alias("_more"), F.col("_level").alias("_last"))
    told = moves.join(onward, ["_to", "_level"], "left")
    told = told.select("_bin", "_kind", F.coalesce("_next", "_to").alias("_to"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift"), F.coalesce("_last", "_level").alias("_level"))
    return staged(told, "moves")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = cut_into_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
