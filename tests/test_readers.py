"""Parser cascade and workbooks."""

import zipfile

import pytest

from lodestone.sources import io, xlsx

HEAD = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def book(path, sheets, shared=()):
    """A workbook; cells are given as their XML."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", HEAD + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")


def text(at, value):
    return f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'


def test_cells_of_all_kinds(spark, tmp_path):
    rows = [
        [text("A1", "Name"), text("B1", "Name"), text("D1", " Flag ")],
        ['<c r="A2" t="s"><v>0</v></c>', '<c r="B2"><v>12.0</v></c>', '<c r="D2" t="b"><v>1</v></c>'],
        [],
        ['<c r="A4" t="s"><v>1</v></c>', '<c r="C4" t="str"><f>1+1</f><v>two</v></c>', '<c r="D4" t="b"><v>0</v></c>'],
        ['<c r="B5"><v>0.25</v></c>', '<c r="D5"/>'],
        ["<c><v>7</v></c>", "<c><v>8</v></c>"],
    ]
    book(tmp_path / "a.xlsx", {"Other": [[text("A1", "x")]], "Data": rows}, ("<r><t>two </t></r><r><t>runs</t></r>", "<t>&lt;b&gt; é</t>"))
    got = xlsx.read_sheet(spark, str(tmp_path / "a.xlsx"), "Data")
    assert got.columns == ["Name", "Name_2", "column_3", "Flag"]
    assert [tuple(r) for r in got.collect()] == [("two runs", "12", None, "TRUE"), ("<b> é", None, "two", "FALSE"), (None, "0.25", None, None), ("7", "8", None, None)]
    assert xlsx.read_sheet(spark, str(tmp_path / "a.xlsx")).columns == ["x"] and xlsx.read_sheet(spark, str(tmp_path / "a.xlsx")).count() == 0
    with pytest.raises(Exception, match="no sheet 'None here'"):
        xlsx.read_sheet(spark, str(tmp_path / "a.xlsx"), "None here").collect()
    book(tmp_path / "b.xlsx", {"Data": [[text("A1", "Flag"), text("B1", "Name")], [text("A2", "f"), text("B2", "n")]]})
    both = xlsx.read_sheet(spark, str(tmp_path), "Data", ["Name", "Flag", "Missing"])
    assert both.count() == 5 and [tuple(r) for r in both.where("Flag = 'f'").collect()] == [("n", "f", None)] and both.rdd.getNumPartitions() == 2


def test_golden_questions_and_corpus(spark, tmp_path):
    columns = list(xlsx.QUESTION_COLUMNS)
    line = lambda n, values: [text(f"{chr(65 + i)}{n}", v) for i, v in enumerate(values) if v is not None]
    full = lambda **k: [k.get(xlsx.QUESTION_COLUMNS[c]) for c in columns]
    questions = [line(1, columns), line(2, full(qa_id="Q1", doc_id="D", category="Text", question="Why?", should_abstain=" Yes ", difficulty=" ")), line(3, full(qa_id="Q2", doc_id="D", category="Text")), line(4, full(qa_id="Q1", doc_id="E", category="Table", question="How?", expected_answer="So", should_abstain="no")), [*line(5, full(qa_id="Q3", question="?")), '<c r="I5" t="b"><v>1</v></c>']]
    corpus = [line(1, list(xlsx.CORPUS_COLUMNS)), [*line(2, ["D", "a", "first", None]), '<c r="E2"><v>2023.0</v></c>'], line(3, [None, "x"]), [*line(4, ["D", "b", "last", "org"]), '<c r="E4"><v>2024</v></c>'], line(5, ["F", None, "t", None, "n.d."])]
    book(tmp_path / "g.xlsx", {xlsx.QUESTION_SHEET: questions, xlsx.CORPUS_SHEET: corpus})
    rows = xlsx.read_golden_questions(spark, str(tmp_path / "g.xlsx")).collect()
    assert [(r["qa_id"], r["doc_id"], r["question"], r["expected_answer"], r["should_abstain"], r["difficulty"]) for r in rows] == [("Q1", "D", "Why?", "", True, None), ("Q1", "E", "How?", "So", False, None), ("Q3", None, "?", "", True, None)]
    docs = {r["doc_id"]: tuple(r)[1:] for r in xlsx.read_corpus_documents(spark, str(tmp_path / "g.xlsx")).collect()}
    assert docs == {"D": ("b", "last", "org", 2024), "F": ("", "t", "", None)}


def test_failed_files_alone_go_to_the_next_parser(spark, tmp_path):
    log = tmp_path / "log"

    def layout(content):
        with open(log, "a") as f:
            f.write(f"layout {content[:4].decode()}\n")
        if content.startswith(b"bad"):
            raise MemoryError("dense page")
        return [(1, content.decode()), (2, "  ")], (["page 2 lost"] if content.startswith(b"half") else [])

    def plain(content):
        with open(log, "a") as f:
            f.write(f"plain {content[:4].decode()}\n")
        if content == b"bad2":
            raise ValueError("no text")
        return [(1, "plain " + content.decode()[:9])], []

    files = spark.createDataFrame([("a", bytearray(b"good")), ("b", bytearray(b"bad1")), ("c", bytearray(b"half")), ("d", bytearray(b"size" * 9)), ("e", bytearray(b"bad2")), ("f", None), ("a", bytearray(b"good"))], "content_hash string, content binary")
    rows = io.parsed_in_order(files, [("layout", layout), ("text", plain)], threshold=20).collect()
    got = {r["content_hash"]: (r["parser"], [tuple(p) for p in r["pages"]], [(e["type"], e["stage"]) for e in r["errors"]]) for r in rows}
    assert len(rows) == 7 and got["a"] == ("layout", [(1, "good")], [])
    assert got["b"] == ("text", [(1, "plain bad1")], [("MemoryError", "layout")]) and got["c"] == ("text", [(1, "plain half")], [("parser_error", "layout")])
    assert got["d"] == ("text", [(1, "plain sizesizes")], [("parser_selection", "selection")])
    assert got["e"] == ("text", [], [("MemoryError", "layout"), ("ValueError", "text")]) and got["f"] == ("layout", [], [])
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(["layout good", "layout good", "layout bad1", "layout half", "layout bad2", "layout ", "plain bad1", "plain half", "plain size", "plain bad2"])
    assert io.parsed_in_order(files.where("content_hash = 'x'"), [("layout", layout)]).count() == 0
