"""Word-processor archives written to disk and read back: lists, tables, links, marks."""

import zipfile

from strataform.sources import documents, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, *marks):
    return f"<w:r><w:rPr>{''.join(f'<w:{m}/>' for m in marks)}</w:rPr><w:t>{text}</w:t></w:r>"


def para(*runs, style="", number=None, level=0):
    listed = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>' if number else ""
    return f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{listed}</w:pPr>{"".join(runs)}</w:p>'


def cell(text, span=1, merge=""):
    return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{merge}</w:tcPr>{para(run(text))}</w:tc>'


def write(path, body, numbering=True):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>")
        if numbering:
            levels = lambda kinds: "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{kind}"/></w:lvl>' for k, kind in enumerate(kinds))
            z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{levels(["bullet", "decimal"])}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>')
            z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId5" Target="http://x.y/?a=1&amp;b=2"/></Relationships>')


def test_documents_as_markup(spark, tmp_path):
    body = para(run("Dal"), style="Heading1") + para(run("Slow "), run("and", "b", "i"), run(" a &lt; b"), f'<w:hyperlink r:id="rId5">{run("here", "u")}</w:hyperlink>')
    body += para(run("one"), number=1) + para(run("two"), number=1) + para(run("in"), number=1, level=1) + para(run("in too"), number=1, level=1) + para(run("three"), number=1) + para() + para(run("end"))
    top, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    body += f'<w:tbl><w:tr>{cell("a", merge=top)}{cell("b", span=2)}</w:tr><w:tr>{cell("", merge=on)}{cell("c")}{cell("d", merge=top)}</w:tr><w:tr>{cell("", merge=on)}{cell("e")}{cell("", merge=on)}</w:tr><w:tr>{cell("f")}{cell("g")}{cell("h")}</w:tr></w:tbl>'
    write(tmp_path / "a.docx", body)
    write(tmp_path / "b.docx", para(run("x"), number=3, level=1) + para(run("y"), number=3), numbering=False)
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    parts = documents.docx_parts(tables.objects(spark, str(tmp_path), "*.docx"))
    got = {r["path"].rpartition("/")[2]: r["html"] for r in documents.docx_html(documents.docx_blocks(parts)).collect()}
    assert got == {
        "a.docx": '<h1>Dal</h1><p>Slow <b><i>and</i></b> a &lt; b<a href="http://x.y/?a=1&amp;b=2"><u>here</u></a></p>'
        "<ul><li>one</li><li>two<ol><li>in</li><li>in too</li></ol></li><li>three</li></ul><p>end</p>"
        '<table><tr><td rowspan="3">a</td><td colspan="2">b</td></tr><tr><td>c</td><td rowspan="2">d</td></tr><tr><td>e</td></tr><tr><td>f</td><td>g</td><td>h</td></tr></table>',
        "b.docx": "<ol><li><ol><li>x</li></ol></li><li>y</li></ol>",
    }


def test_no_documents(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert documents.docx_html(documents.docx_blocks(documents.docx_parts(none))).count() == 0
