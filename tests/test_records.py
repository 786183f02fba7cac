import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from civigrade.sources import records, tables
from civigrade.sources.records import ends_inside


@pytest.fixture()
def small_blocks(spark):
    """Splits of 64 bytes, so that one file has many blocks."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def read(spark, path):
    rows = tables.read_csv(spark, str(path))
    blocks = rows.select("__file", "__block").distinct().count()
    data = tables.stage(rows, "i", "s")
    columns = [c for c in rows.columns if c not in tables.ORDER_COLUMNS]
    cells = data.orderBy("row_number").select(*[F.coalesce(F.try_element_at("raw_row", F.lit(c)), F.lit("")).alias(c) for c in columns])
    return columns, [tuple(r) for r in cells.collect()], blocks


def expected(text, separator):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=separator))
    return rows[0], [tuple(r) for r in rows[1:] if r]


PIECES = ['"', '""', "\n", ";", ",", "a", "ção", " ", "\n\n", "x" * 70, "1", "\r\n", '"\n;', "'", "\t"]


@pytest.mark.parametrize("seed", range(4))
def test_random_files_in_small_blocks(spark, tmp_path, small_blocks, seed):
    chance = random.Random(seed)
    separator, end = (";", "\n") if seed % 2 else (",", "\r\n")
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=separator, lineterminator=end)
    writer.writerow(["chave", "nota", "outra"] if seed < 2 else ["chave", "nota\nlonga", "outra"])
    for i in range(120):
        writer.writerow([f"k{i}", "".join(chance.choices(PIECES, k=chance.randrange(6))), "".join(chance.choices(PIECES[5:8], k=chance.randrange(1, 4)))])
    writer.writerow(["last", "open\ncell", "z"])
    (tmp_path / "f.csv").write_bytes(out.getvalue().encode())
    names, rows = expected(out.getvalue(), separator)
    columns, found, blocks = read(spark, tmp_path)
    assert columns == names and blocks > 10
    assert found == rows


def test_a_cell_over_many_blocks_and_one_that_never_closes(spark, tmp_path, small_blocks):
    text = 'a;b\n1;"' + "line of a long cell\n" * 40 + '"\n2;"x ""y"" \nz"\n3;last\n4;"never closed\n5;6\n'
    (tmp_path / "f.csv").write_text(text)
    columns, found, _ = read(spark, tmp_path)
    assert columns == ["a", "b"] and found[:3] == [("1", "line of a long cell\n" * 40), ("2", 'x "y" \nz'), ("3", "last")]
    assert len(found) == 4 and found[3][0] == "4" and found[3][1].startswith("never closed\n5;6")


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path, small_blocks):
    text = 'a;b\n5" pipe;x\n6;say "hi\n7;"real\nbreak"\n8;"closed" then more\n9;end\n'
    (tmp_path / "f.csv").write_text(text)
    _, found, blocks = read(spark, tmp_path)
    assert [r[0] for r in found] == ['5" pipe', "6", "7", "8", "9"] and found[2][1] == "real\nbreak"


def test_latin_file_with_breaks(spark, tmp_path, small_blocks):
    (tmp_path / "f.csv").write_bytes('chave;situação\n1;"São\nPaulo – x"\n2;não\n'.encode("cp1252"))
    columns, found, _ = read(spark, tmp_path)
    assert columns == ["chave", "situação"] and found == [("1", "São\nPaulo – x"), ("2", "não")]


@pytest.mark.parametrize("line,outside,inside", [
    ("a;b", False, True), ('a;"b', True, False), ('a;"b"', False, False), ('"a";b', False, True), ('x";"y', True, True), ('a;""', False, False), ('a;"""', True, False),
    ("", False, True), ('"', True, False), ('""', False, True), ('a"b;c', False, False), (';"";"', True, False), ('"a""";"b', True, False), ('x"', False, False), ('x";y', False, False),
])
def test_ends_of_lines(spark, line, outside, inside):
    """Both functions against a walk over the characters."""

    def walk(state):
        at_start = not state
        i = 0
        while i < len(line):
            c = line[i]
            if state:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = at_start = False
            elif c == ";":
                at_start = True
            elif c == '"' and at_start:
                state = True
            else:
                at_start = False
            i += 1
        return state

    row = spark.createDataFrame([(line,)], "line string").select(*[s.cast("boolean") for s in ends_inside(F.col("line"), ";")]).first()
    assert (row[0], row[1]) == (walk(False), walk(True))


def test_repeated_headers(spark, tmp_path):
    for folder, text in {"plain": "valor;valor;Valor\n1;2;3\n", "broken": 'valor;valor;Valor\n1;2;"3\n"\n', "wrapped": "valor;valor;Valor\n" + '"1;2;3"\n' * 4}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.csv").write_text(text)
        read_table = tables.read_csv_table(spark, str(tmp_path / folder))
        assert [c for c in read_table.columns if c not in tables.ORDER_COLUMNS] == ["valor", "valor_2", "valor_3"]
        assert [str(v).strip() for v in read_table.first()[:3]] == ["1", "2", "3"]


@pytest.mark.parametrize("seed", range(2))
def test_random_files_in_small_chunks(spark, tmp_path, monkeypatch, seed):
    """Chunks of four lines inside one block: states, record numbers and row numbers run on from chunk to chunk."""
    monkeypatch.setattr(records, "CHUNK_BITS", 2)
    chance = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["chave", "nota\nlonga"])
    for i in range(90):
        writer.writerow([f"k{i}", "".join(chance.choices(PIECES, k=chance.randrange(9)))])
    writer.writerow(["long", "line\n" * 23 + "end"])
    writer.writerow(["last", "open\ncell"])
    (tmp_path / "f.csv").write_bytes(out.getvalue().encode())
    names, rows = expected(out.getvalue(), ";")
    columns, found, blocks = read(spark, tmp_path)
    assert columns == names and blocks == 1
    assert found == rows
    spread = records.whole_records(tables._with_order(spark.read.option("lineSep", "\n").text(str(tmp_path))).withColumnRenamed("value", "line"), ";")
    assert spread.groupBy("__file", "__block", "number").count().filter("count > 1").isEmpty()


def test_no_window_holds_a_whole_block(spark, tmp_path):
    """Lines are sorted and summed by chunks, so a task's memory does not follow the size of a file block."""
    (tmp_path / "f.csv").write_text('a;b\n1;"x\ny"\n2;z\n')
    plan = tables.stage(tables.read_csv(spark, str(tmp_path)), "i", "s")._jdf.queryExecution().optimizedPlan().toString()
    over_lines = [line for line in plan.splitlines() if "Window [" in line and "__at" in line.split("specifiedwindowframe")[0] + line.rsplit("], [", 2)[-1]]
    assert over_lines and all("__chunk" in line for line in over_lines)
