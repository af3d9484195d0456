"""CSV files whose quoted fields hold line breaks, read in splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.functions.tables import staged

#: Splits whose states are broadcast, some 100 bytes each; of more, lines are shuffled to them.
MOST_BROADCAST = 100_000


def open_at_end(line: str, quoted: bool, sep: str) -> bool:
    """Whether a quoted field is open after the line, if one is (or isn't) open before it.

    A quote opens a field only where the field starts, a doubled one stays inside, and others are plain characters.
    """
    at, n = 0, len(line)
    while True:
        if not quoted:
            # to the next field that starts with a quote, after white space or not
            found = re.compile(rf"(?:^|{re.escape(sep)})[ \t]*\"" if at == 0 else rf"{re.escape(sep)}[ \t]*\"").search(line, at)
            if found is None:
                return False
            at, quoted = found.end(), True
        close = line.find('"', at)
        if close < 0:
            return True
        if line.startswith('""', close):
            at = close + 2
        else:
            at, quoted = close + 1, False
            if at >= n:
                return False


def _effects(lines: DataFrame, sep: str) -> DataFrame:
    """(_file, _split, open0, open1, starts0, starts1): what each split does to a state, and how many records start in it.

    0: no field is open before the split, 1: one is. A line that is empty outside a field is no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, starts = None, [0, 1], [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"_file": [key[0]], "_split": pa.array([key[1]], pa.int64()), "open0": state[:1], "open1": state[1:], "starts0": starts[:1], "starts1": starts[1:]})

        for batch in batches:
            has_quote = pc.match_substring(batch["value"], '"').to_pylist()
            for file, split, line, quote in zip(batch["_file"].to_pylist(), batch["_split"].to_pylist(), batch["value"].to_pylist(), has_quote, strict=True):
                if (file, split) != key:
                    if key:
                        yield row()
                    key, state, starts = (file, split), [0, 1], [0, 0]
                    if split == 0:
                        line = line.removeprefix("\ufeff")
                for was in (0, 1):
                    if not state[was] and line.rstrip("\r"):
                        starts[was] += 1
                    if quote:
                        state[was] = int(open_at_end(line, bool(state[was]), sep))
        if key:
            yield row()

    return lines.select("_file", "_split", "value").mapInArrow(run, "_file string, _split long, open0 long, open1 long, starts0 long, starts1 long")


def _states(effects: DataFrame) -> DataFrame:
    """(_file, _split, quoted, before): whether a field is open where the split starts, and the records that start before it.

    The state after a split is that of the last split that gives the same one from both, turned by each later split that turns it.
    """
    upto = Window.partitionBy("_file").orderBy("_split")
    turns = F.sum(F.when(F.col("open0") > F.col("open1"), 1).otherwise(0)).over(upto)
    rows = effects.withColumn("_turns", turns)
    fixed = F.last(F.when(F.col("open0") == F.col("open1"), F.struct(F.col("open0").alias("open"), F.col("_turns").alias("turns"))), ignorenulls=True).over(upto)
    rows = rows.withColumn("_fixed", fixed)
    after = F.pmod(F.coalesce("_fixed.open", F.lit(0)) + F.col("_turns") - F.coalesce("_fixed.turns", F.lit(0)), F.lit(2))
    rows = rows.withColumn("_after", after).withColumn("quoted", F.coalesce(F.lag("_after").over(upto), F.lit(0)))
    starts = F.when(F.col("quoted") == 1, F.col("starts1")).otherwise(F.col("starts0"))
    return rows.withColumn("_starts", starts).select("_file", "_split", "quoted", (F.sum("_starts").over(upto) - F.col("_starts")).alias("before"))


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(_file, _at, record): the records of UTF-8 CSV files as written, quotes and line breaks included, numbered from 1 in each file.

    Lines are read in splits like any text. A first pass finds what each split does to the state of a quoted field, whichever it starts
    in; these few rows are put in order, and a second pass cuts each split's lines from the state they really start in. Only the pieces
    of records over the end of a split are shuffled. Records of empty lines are left out, a byte order mark too.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"), "value")
    states = staged(_states(_effects(lines, sep)), "csv-splits")
    if states.count() <= MOST_BROADCAST:
        known = lines.join(F.broadcast(states), ["_file", "_split"])
    else:
        known = lines.join(states, ["_file", "_split"]).sortWithinPartitions("_file", "_split", "_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quoted, number, piece, whole = None, False, 0, [], True
        out: list[tuple] = []

        def put(ends: bool) -> None:
            nonlocal piece
            if piece:
                out.append((key[0], number, key[1], "\n".join(piece), whole and ends))
            piece = []

        def made() -> pa.RecordBatch:
            rows = out.copy()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["_file", "_at", "_split", "record", "whole"])

        for batch in batches:
            for file, split, line, open_, before in zip(*[batch[c].to_pylist() for c in ("_file", "_split", "value", "quoted", "before")], strict=True):
                if (file, split) != key:
                    put(not quoted)
                    key, quoted, number, whole = (file, split), bool(open_), before, not open_
                    if split == 0:
                        line = line.removeprefix("\ufeff")
                if not quoted:
                    if not line.rstrip("\r"):
                        continue
                    number += 1
                piece.append(line)
                quoted = open_at_end(line, quoted, sep) if '"' in line else quoted
                if not quoted:
                    put(True)
                    whole = True
            if out:
                yield made()
        put(not quoted)
        if out:
            yield made()

    found = known.select("_file", "_split", "value", "quoted", "before").mapInArrow(run, "_file string, _at long, _split long, record string, whole boolean")
    pieces = found.filter("not whole").groupBy("_file", "_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_split", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return found.filter("whole").select("_file", "_at", "record").unionByName(pieces).withColumn("record", F.rtrim("record", F.lit("\r")))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of CSV files with a header, as spark.read.csv gives them with multiLine, and _file, _at; all columns are strings."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.csv(path, header=True, **options).columns
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
    # the first record of a file is its header
    rows = csv_records(spark, path, sep).filter("_at > 1")
    return rows.select("_file", "_at", F.from_csv("record", schema, options).alias("_row")).select("_row.*", "_file", "_at")
