"""Lines that the readers cannot read as they stand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from protomatch.sources import read_hits, read_phage_lengths
from protomatch.sources.rejects import LAYOUTS, NO_NUMBER, TOO_FEW, TOO_MANY, count_rejected, numbered_lines, rejected_cells, rejected_lines

GOOD = "s\tt\t+\t5\td\t1\t0\tACG\t3"


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_lines_of_hits_with_file_line_and_reason(spark, tmp_path):
    lines = [GOOD, "s\tt\t+\t5", "", GOOD + "\textra", GOOD.replace("\t5\t", "\tfive\t"), GOOD.replace("\t1\t0", "\tone\tNA"), GOOD.replace("\t5\t", "\t\t"), "x"]
    path = write(tmp_path / "hits.tsv", "\r\n".join(lines) + "\r\n")
    found = rejected_lines(spark, path, "hits")
    assert rows_of(found, "line", "cells", "reason", F.array_join("bad_columns", ",")) == [
        (2, 4, TOO_FEW, ""), (4, 10, TOO_MANY, ""), (5, 9, NO_NUMBER, "position"), (6, 9, NO_NUMBER, "mismatches"), (8, 1, TOO_FEW, "")]
    assert {r["file"].rsplit("/", 1)[1] for r in found.collect()} == {"hits.tsv"}
    assert rows_of(count_rejected(found), "reason", "lines") == [(NO_NUMBER, 2), (TOO_FEW, 2), (TOO_MANY, 1)]
    # The reader itself turns them into missing values.
    assert read_hits(spark, path, "TypeIE", "gb>150kb", "non-shuffled").filter("position is null").count() == 3


@pytest.mark.parametrize("reader", list(LAYOUTS))
def test_every_reader_has_its_layout(spark, tmp_path, reader):
    layout = LAYOUTS[reader]
    columns = layout.columns()
    good = "\t".join("7" for _ in columns)
    word = "\t".join("word" if t != "string" else "text" for _, t in columns)
    head = [good.replace("7", "head")] if layout.header else []
    path = write(tmp_path / f"{reader}.tsv", "\n".join([*head, good, word, good + "\t7", "7", "\t".join(["NA"] * len(columns))]))
    numbers = [n for n, t in columns if t != "string"]
    want = [(2, NO_NUMBER, ",".join(numbers))] if numbers else []
    want += [(3, TOO_MANY, ""), (4, TOO_FEW, "")]
    found = rejected_lines(spark, path, reader)
    assert rows_of(found, "line", "reason", F.array_join("bad_columns", ",")) == [(n + len(head), r, c) for n, r, c in want]


def test_line_numbers_of_files_read_in_many_blocks(spark, tmp_path):
    texts = {f"f{k}.txt": [f"{k} {n} {'x' * (n % 50)}" for n in range(3000 + k)] for k in range(3)}
    for name, lines in texts.items():
        write(tmp_path / name, "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        table = numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in table.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(name, n): line for name, lines in texts.items() for n, line in enumerate(lines, 1)}


def test_lengths_skip_the_header_and_names_do_not_clash(spark, tmp_path):
    path = write(tmp_path / "lengths.tsv", "id\tgca\tlength\nt1\tg1\tlong\nt2\tg2\t5\n")
    assert rows_of(rejected_lines(spark, path, "phage_lengths"), "line", "reason") == [(2, NO_NUMBER)]
    assert read_phage_lengths(spark, path).filter("target_length is null").count() == 1
    with pytest.raises(ValueError):
        rejected_cells(spark.createDataFrame([("a", 1)], "value string, cells int"), LAYOUTS["hits"])
    assert rejected_cells(spark.createDataFrame([], "value string"), LAYOUTS["hits"]).count() == 0


def test_a_line_is_split_once_whatever_looks_at_its_cells(spark):
    lines = spark.createDataFrame([(GOOD,), ("",), (None,), ("\r",), ("\t",)], "value string")
    found = rejected_cells(lines, LAYOUTS["hits"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert rows_of(found, "cells", "reason") == [(2, TOO_FEW)]
