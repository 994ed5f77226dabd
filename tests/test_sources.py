"""CSV encodings and types, workbooks, saved results."""

import csv
import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanframe.sources import sinks
from gleanframe.sources.records import opens_quote
from gleanframe.sources.tables import as_table, load_tables, preview, read_csv


def test_csv_types(spark, tmp_path):
    path = tmp_path / "some file.csv"
    path.write_text('id,  full   name ,n,gap,share,ok,mixed\n1,"a, ""b""",5,1,0.5,True,1\n2,NA,6,,1e3,False,x\n', encoding="utf-8")
    df = read_csv(spark, str(path))
    assert df.columns == ["id", "full name", "n", "gap", "share", "ok", "mixed"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "bigint", "double", "double", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a, "b"', 5, 1.0, 0.5, True, "1"), (2, None, 6, None, 1000.0, False, "x")]
    shown = preview(df, 1, ["id"]).first()
    assert tuple(shown) == ("1", 'a, "b"', "5", "1.0", "0.5", "true", "1")


@pytest.mark.parametrize("text,encoding", [("Größe", "latin1"), ("Größe", "utf-8"), ("Минск", "utf-8")])
def test_csv_encodings(spark, tmp_path, text, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(f"a\n{text}\n".encode(encoding))
    assert read_csv(spark, str(path)).first()["a"] == text


def test_csv_named_encoding(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("a\nМинск\n".encode("cp1251"))
    assert read_csv(spark, str(path)).first()["a"] == "Минск".encode("cp1251").decode("latin1")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        assert read_csv(spark, str(path), encoding="windows-1251").first()["a"] == "Минск"
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def quoted_cells(n):
    """Rows whose cells hold line breaks, doubled quotes, separators, quotes inside words, nothing, and one long cell."""
    cells = ['plain', 'a\nb', 'say ""x""\n""', ',\n,\n\n"",', '', 'x' * 300 + '\n' + 'y,' * 400, '""']
    return "".join(f'{i},"{cells[i % len(cells)]}",{i % 3}" pipe\n' for i in range(n))


@pytest.mark.parametrize("encoding,ending", [("utf-8", "\n"), ("latin1", "\r\n")])
def test_quoted_line_breaks_are_split(spark, tmp_path, encoding, ending):
    path = tmp_path / "t.csv"
    text = '\nid,"te\nxt",size\n' + quoted_cells(700) + '700,"' + "\n" * 9000 + 'é",1\n\n   \n701,last,2'
    path.write_bytes(text.replace("\n", ending).encode(encoding))
    rows = [r for r in csv.reader(io.StringIO(text)) if len(r) == 3][1:]
    want = [(int(i), cell or None, size) for i, cell, size in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert len(spark.read.text(str(path)).select("_metadata.file_block_start").distinct().collect()) >= 8
        df = read_csv(spark, str(path))
        assert df.columns == ["id", "te xt", "size"]
        assert [tuple(r) for r in df.orderBy("id").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quotes_inside_words_open_nothing(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n5" pipe,1\n"x\ny",2\n6" pipe,3\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(path)).collect()) == [('5" pipe', 1), ('6" pipe', 3), ("x\ny", 2)]


def test_same_names_get_numbers(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "My data.csv").write_text("a\n1\n")
    tables = load_tables(spark, [(str(tmp_path / f / "My data.csv"), None) for f in ("one", "two")])
    assert [t.id for t in tables] == ["My_data", "My_data_2"]
    with pytest.raises(ValueError):
        load_tables(spark, [(str(tmp_path / "one" / "x.txt"), "x.txt")])
    assert len(load_tables(spark, [(str(tmp_path / f / "My data.csv"), None) for f in ("one", "two")], max_tables=1)) == 1


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    """Sheets are lists of rows; text goes to shared strings, dates to style 1."""
    texts: list[str] = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c r="{ref}" s="1"><v>{(v - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)}</v></c>'
        if isinstance(v, str):
            texts.append(v)
            return f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")


def test_workbook(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    day = dt.datetime(2024, 5, 6, 12)
    workbook(path, {"Flats": [["id", "city  name", "rent", "built", "let"], [1, "Минск", 10.5, day, True], [2, None, 11, None, False]],
                    "Empty": [["only", "header"]], "More": [["a"], ["x"], [3]]})
    tables = load_tables(spark, [(str(path), None)])
    assert [(t.id, t.name) for t in tables] == [("book_Flats", "book.xlsx / Flats"), ("book_More", "book.xlsx / More")]
    flats = tables[0].df
    assert flats.columns == ["id", "city name", "rent", "built", "let"]
    assert [tuple(r) for r in flats.orderBy("id").collect()] == [(1.0, "Минск", 10.5, day, True), (2.0, None, 11.0, None, False)]
    assert {r["a"] for r in tables[1].df.collect()} == {"x", "3"}


def test_workbook_without_data(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    workbook(path, {"Only": [["a", "b"]]})
    with pytest.raises(ValueError):
        load_tables(spark, [(str(path), None)])


def test_save_and_reload(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n bigint, s string")
    sinks.save_tables([as_table(df, "t")], str(tmp_path / "tables"))
    assert sinks.reload_tables(spark, str(tmp_path / "tables"), ["t"])[0].df.collect() == df.collect()
    sinks.save_results({"r": df}, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results" / "r")).first()["s"] == "a"


def test_split_files_are_put_together_once(spark, tmp_path):
    """Types are found, and the table is read, from the stored cells; a search for quotes leaves lines without one alone."""
    path = tmp_path / "a.csv"
    path.write_text('id,note\n1,"a\nb"\n2,"c ""d"""\n3,\n')
    df = read_csv(spark, str(path))
    assert sorted(df.collect()) == [(1, "a\nb"), (2, 'c "d"'), (3, None)]
    assert all(f.endswith(".parquet") for f in df.inputFiles())
    plan = spark.read.text(str(path)).select(opens_quote(F.col("value"), ","))._jdf.queryExecution().executedPlan().toString()
    assert "Contains(value" in plan
