from __future__ import annotations

import csv
import random

import pytest

from labelloom.schema import NARRATIVE
from labelloom.sources import csv_records as C
from labelloom.sources import readers as R

NAMES = ["product", "issue", NARRATIVE, "more"]


def text(rng):
    words = ["plain", 'say ""it""', "a,b", "line\nbreak", "two\n\nbreaks", "x" * 300, '"', "end\n", "ünï", "tab\there", "cr\r\nlf"]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    rows = []
    for name, ending in (("b.csv", "\r\n"), ("a.csv", "\n"), ("c.csv", "\n")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=ending)
            writer.writerow(NAMES)
            own = [[f"p{i}", "i", text(rng), rng.choice(["", "m"])] for i in range(0 if name == "c.csv" else 400)]
            if name == "a.csv":
                own[7][2] = 'one "very" long text,\n' * 3_000  # longer than several splits
                for row in own[:200]:
                    writer.writerow(row)
                out.write("\n\n")  # blank lines between records
                own = own[:200] + own[200:]
                for row in own[200:]:
                    writer.writerow(row)
            else:
                writer.writerows(own)
        rows.append((name, own))
    return tmp_path, [r for _, own in sorted(rows) for r in own]


@pytest.mark.parametrize("size", ["2k", "64k", "128m"])
def test_same_rows_for_every_size_of_split(spark, folder, size):
    path, want = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = C.read_csv_records(spark, str(path), NAMES, "record_id").orderBy("record_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["record_id"] for r in found] == list(range(len(want)))
    for row, expected in zip(found, want):
        assert [row[c] or "" for c in NAMES] == expected


def test_reader_uses_every_split_and_keeps_its_contract(spark, folder):
    path, want = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = R.read_complaints(spark, str(path), "csv")
        found = rows.orderBy("record_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.columns == ["record_id", *NAMES]
    assert [(r["product"], r[NARRATIVE], r["more"]) for r in found] == [(w[0], w[2], w[3] or None) for w in want]


def test_open_quote_and_header_only(spark, tmp_path):
    (tmp_path / "x.csv").write_text('product,issue\na,b\nc,"open\nto the end\n')
    found = C.read_csv_records(spark, str(tmp_path / "x.csv"), ["product", "issue"], "n").orderBy("n").collect()
    assert [(r["n"], r["product"]) for r in found] == [(0, "a"), (1, "c")] and found[1]["issue"].startswith("open\nto the end")
    (tmp_path / "y.csv").write_text("product,issue\n")
    assert C.read_csv_records(spark, str(tmp_path / "y.csv"), ["product", "issue"], "n").count() == 0
