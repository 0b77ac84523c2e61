from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import ordered
from tidewell.sources.csv_lines import _ends_inside, csv_line_blocks, file_lines, record_numbers, text_lines
from tidewell.sources.tabular import csv_to_blocks


def _texts(seed, count):
    rng = random.Random(seed)
    pieces = ['"', '"', '""', ",", ",", "\n", "\n", "\r\n", "a", "bc", " ", "é", "\t"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(count)]


def _rows(blocks, key):
    return sorted((r[key], r["block_no"], r["type"], r["content"], r["page_number"]) for r in blocks.collect())


def test_state_after_a_line_equals_the_csv_module():
    """A line leaves a field open exactly if the reader asks for more before it ends the record."""
    for text in _texts(1, 3000):
        line = text.replace("\r", "").replace("\n", "")
        for inside in (False, True):
            start = '"' if inside else ""
            rows = list(csv.reader(io.StringIO(f"{start}{line}\nX", newline="")))
            assert _ends_inside(line, inside) == (len(rows) == 1), (line, inside)


@pytest.mark.parametrize("stretch", [2, 8192])
def test_blocks_equal_those_of_whole_texts(spark, monkeypatch, stretch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", stretch)
    special = [None, "", " \n ", "a,b", " , \nx,y", 'a,b\n"1, one",2,3\n4', "h\n" + "\n".join(map(str, range(21))), "h\n\n\nx\n\n", 'a\n"open\n1\n2', "\n\n a,b \n1,2 \n\n"]
    files = spark.createDataFrame(list(enumerate([*special, *_texts(2, 150)])), "id long, text string")
    assert _rows(csv_line_blocks(text_lines(files, "text", "id"), "id", 3), "id") == _rows(csv_to_blocks(files, "text", 3), "id")


def test_one_file_over_many_tasks(spark, tmp_path):
    """Quoted line breaks lie across the splits of one file, a whole split inside a field among them."""
    rng = random.Random(5)
    out = io.StringIO(newline="")
    rows = csv.writer(out, lineterminator="\n")
    rows.writerow(["no", "note"])
    for i in range(600):
        rows.writerow([i, "\n".join('say "x, y"' for _ in range(400 if i == 300 else rng.choice([0, 1, 2, 3])))])
    (tmp_path / "one.csv").write_text(out.getvalue())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = file_lines(spark, str(tmp_path / "one.csv"))
        assert lines.rdd.getNumPartitions() > 8 and lines.select("part").distinct().count() > 8
        got = _rows(csv_line_blocks(lines, "path"), "path")
        spread = record_numbers(lines, "path").groupBy("record").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    whole = spark.createDataFrame([(got[0][0], out.getvalue())], "path string, text string")
    assert got == _rows(csv_to_blocks(whole, "text"), "path") and len(got) == 60 and spread >= 3


def test_null_key_and_no_lines(spark):
    files = spark.createDataFrame([(None, "a\n1"), (1, "b\n2")], "id long, text string")
    blocks = csv_line_blocks(text_lines(files, "text", "id"), "id")
    assert {(r["id"], r["content"]) for r in blocks.collect()} == {(None, "| a |\n| --- |\n| 1 |"), (1, "| b |\n| --- |\n| 2 |")}
    assert csv_line_blocks(text_lines(files.limit(0), "text", "id"), "id").count() == 0
