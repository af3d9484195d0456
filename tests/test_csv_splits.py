"""CSV records over the ends of splits, against Spark's reader of whole files."""

import random

import pytest

from weftnet.sources.csv_splits import csv_records, open_at_end, read_csv


def test_open_at_end():
    cases = [("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('a 5" pipe,b', False, False)]
    cases += [('"', True, False), ("", True, True), ('x","y', True, True), ('x"",', True, True), ('"",a', False, False), ('"""', False, True), ('x",""', True, False)]
    assert [open_at_end(line, was, ",") for line, was, _ in cases] == [after for *_, after in cases]


def made(seed, n, end):
    rnd = random.Random(seed)
    fields = ["plain", "two words", '"a, b"', '"line\none"', '"he said ""so"""', '""', '"x\n\n""\n,y"', '5 in" pipe', "é日", '"' + "long\n" * 300 + '"']
    rows = ["key,text,where"] + [f"{i},{rnd.choice(fields)},{rnd.choice(fields)}" for i in range(n)]
    rows.insert(5, "")
    return end.join(rows) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits(spark, tmp_path, end):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes((b"\xef\xbb\xbf" if k else b"") + made(k, 60, end).encode())
    path = str(tmp_path)
    want = sorted(map(tuple, spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').collect()), key=str)
    for size in ("128m", "251"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = read_csv(spark, path)
            assert sorted((tuple(r)[:3] for r in rows.collect()), key=str) == want
            if size == "251":
                assert csv_records(spark, path).rdd.getNumPartitions() > 20
                per_file = {}
                for r in rows.collect():
                    per_file.setdefault(r["_file"], []).append((r["_at"], int(r[0])))
                assert all([key for _, key in sorted(x)] == list(range(60)) for x in per_file.values())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
