"""CSV records put together from blocks against Spark's reader of whole files."""

import csv
import io
import random

import pytest

from feedbackmill.sources import split_csv

PARTS = ["a", "é😀", "", '"', '""', ",", "\n", "\r\n", "b c", " ", "x,y", 'say "hi"\nthere', "long " * 30]


def fuzzed(rng, rows, width, ends):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ends)
    for _ in range(rows):
        fields = ["".join(rng.choices(PARTS, k=rng.randint(0, 4))) for _ in range(width)]
        fields[0] = fields[0] or "x"
        writer.writerow(fields)
        if rng.random() < 0.1:
            out.write(ends)
    return out.getvalue()


def by_whole_file(spark, path, width):
    names = ", ".join(f"c{i} string" for i in range(width))
    return spark.read.schema(names).option("multiLine", True).option("lineSep", "\n").option("escape", '"').csv(path)


@pytest.mark.parametrize("size", [400, 1 << 20])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, size):
    """Files are cut into blocks of ``size`` bytes, so that records, fields and quotes are cut anywhere."""
    rng = random.Random(size)
    (tmp_path / "in").mkdir()
    for i in range(4):
        text = fuzzed(rng, 60, 3, "\n")
        (tmp_path / "in" / f"{i} f.csv").write_bytes((("﻿" if i == 1 else "") + (text.rstrip("\n") if i == 2 else text)).encode())
    (tmp_path / "in" / "long.csv").write_text('a,"' + "line\n" * 300 + '",b\n"' + "," * 50 + '\n""\n",c,d\n')
    (tmp_path / "in" / "empty.csv").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = split_csv.record_fields(split_csv.read_records(spark, [str(tmp_path / "in")]), 3)
        got = records.orderBy("file_path", "block", "seq").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = by_whole_file(spark, str(tmp_path / "in"), 3).select("*", "_metadata.file_path").collect()
    mine, theirs = {}, {}
    for r in got:
        mine.setdefault(r["file_path"], []).append(tuple(r["fields"]))
    for r in want:
        theirs.setdefault(r["file_path"], []).append(tuple(r[:3]))
    assert mine == theirs
    if size == 400:
        assert len({(r["file_path"], r["block"]) for r in got}) > 20


@pytest.mark.parametrize("line, quoted, after", [
    ("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"b', False, False), ('a","b', True, True),
    ('""', False, False), ('"""', False, True), ('""', True, True), ('"', True, False), ('x"y,"z', False, True), ('", "', True, False), ("", True, True),
])
def test_where_a_field_goes_on(line, quoted, after):
    assert split_csv.goes_on(line, quoted) is after
