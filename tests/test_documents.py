"""Markdown, Word and PDF transforms."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from loamgrid.errors import DataError
from loamgrid.functions import markdown
from loamgrid.sources import docx, pdf

INLINE = {
    "**b** *i* ***bi*** ~~s~~ __b__ _i_": "<strong>b</strong> <em>i</em> <strong><em>bi</em></strong> <del>s</del> <strong>b</strong> <em>i</em>", "snake_case_name 2*3*4": "snake_case_name 2<em>3</em>4", "`a*b*` ``x`y``": "<code>a*b*</code> <code>x`y</code>", r"\*not\*": "*not*",
    '[t](http://x.y "T")': '<a href="http://x.y" title="T">t</a>', "[t](javascript:alert(1))": "t", "![al*t*](i.png)": '<img src="i.png" alt="alt">', "<http://a.b> <me@x.org>": '<a href="http://a.b">http://a.b</a> <a href="mailto:me@x.org">me@x.org</a>',
    "see https://a.b/c?d=1&e.": 'see <a href="https://a.b/c?d=1&amp;e">https://a.b/c?d=1&amp;e</a>.', "a < b & c": "a &lt; b &amp; c", "x<br>y": "x<br>y", "one  \ntwo": "one<br>\ntwo", "[a [b] c](d)": '<a href="d">a [b] c</a>',
}


def test_inline():
    for source, want in INLINE.items():
        assert markdown.inline(source) == want, source
    assert markdown.inline("x<b>y", escape_html=True) == "x&lt;b&gt;y"


def test_blocks():
    body = markdown.render_body
    assert body("# A\n## A\n# A!") == '<h1 id="a">A</h1>\n<h2 id="a-2">A</h2>\n<h1 id="a-3">A!</h1>'
    assert body("```py\nx < 1\n```\n---\ntext") == '<pre><code class="language-py">x &lt; 1</code></pre>\n<hr>\n<p>text</p>'
    assert body("- a\n\n- b") == "<ul>\n<li><p>a</p></li>\n<li><p>b</p></li>\n</ul>"
    assert body("3. x\n4. y") == '<ol start="3">\n<li>x</li>\n<li>y</li>\n</ol>'
    assert body("> a\nb\n\nc") == "<blockquote>\n<p>a\nb</p>\n</blockquote>\n<p>c</p>"
    assert body("|a|b|\n|-|:-:|\n|1|") == '<table>\n<thead>\n<tr>\n<th>a</th>\n<th style="text-align:center">b</th>\n</tr>\n</thead>\n<tbody>\n<tr><td>1</td><td style="text-align:center"></td></tr>\n</tbody>\n</table>'
    assert body("<div>\nx\n</div>\n\ny") == "<div>\nx\n</div>\n<p>y</p>"
    assert body("```\nopen") == "<pre><code>open</code></pre>" and body("") == ""
    assert markdown.row_cells(r"| a \| b | `c` |") == ["a | b", "`c`"]


def test_pages(spark):
    frame = spark.createDataFrame([(1, "# T *x*\nhello"), (2, "سلام دنیا"), (3, None)], "id long, t string")
    out = {r.id: r.h for r in frame.select("id", markdown.markdown_to_html(F.col("t"), page=True).alias("h")).collect()}
    assert "<title>T x</title>" in out[1] and 'dir="rtl"' in out[2] and out[3] is None


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def word_file(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            package.writestr("word/_rels/document.xml.rels" if name == "rels" else f"word/{name}.xml", xml.replace("<ROOT>", f"<w:root {W}>").replace("</ROOT>", "</w:root>"))
    return out.getvalue()


def p(text: str, props: str = "", run: str = "") -> str:
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


STYLES = '<ROOT><w:style w:styleId="Heading1"/><w:style w:styleId="Chapter"><w:basedOn w:val="Heading1"/></w:style><w:style w:styleId="Deep"><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:styleId="Bulleted"><w:pPr><w:numPr><w:numId w:val="7"/></w:numPr></w:pPr></w:style></ROOT>'
NUMBERS = '<ROOT><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="1"/></w:num></ROOT>'


def item(text: str, number: str, level: int) -> str:
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def test_word_blocks(spark):
    table = "<w:tbl><w:tr><w:tc>" + p("a|b") + "</w:tc><w:tc>" + p("c") + p("d") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>"
    body = p("Title", '<w:pStyle w:val="Chapter"/>') + p("Sub", '<w:pStyle w:val="Deep"/>') + p("bold", run="<w:b/>") + item("one", "3", 0) + item("in", "3", 1) + item("two", "3", 0) + p("dot", '<w:pStyle w:val="Bulleted"/>') + p("none", '<w:pStyle w:val="Bulleted"/><w:numPr><w:numId w:val="0"/></w:numPr>')
    body += table + "<w:sdt><w:sdtContent>" + p("inside") + "</w:sdtContent></w:sdt><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins></w:p>"
    raw = word_file(body, styles=STYLES, numbering=NUMBERS)
    frame = spark.createDataFrame([("a.docx", bytearray(raw)), ("b.docx", bytearray(b"nothing"))], "path string, content binary")
    out = {r.path: r for r in docx.parse_docx(frame).collect()}
    assert out["b.docx"].error and out["b.docx"].markdown is None
    assert out["a.docx"].markdown == "# Title\n\n### Sub\n\n**bold**\n\n1. one\n  - in\n2. two\n\n- dot\n\nnone\n\n| a\\|b | c<br>d |\n| --- | --- |\n| 1 |  |\n\ninside\n\nkept\n"
    assert [b.kind for b in out["a.docx"].blocks][:5] == ["heading", "heading", "paragraph", "item", "item"]


def test_word_notes_comments_links():
    body = '<w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:commentReference w:id="0"/></w:r></w:p>'
    comments = '<ROOT><w:comment w:id="0" w:author="Ann" w:date="2024-01-02T00:00:00Z"><w:p w14:paraId="A1"><w:r><w:t>why?</w:t></w:r></w:p></w:comment><w:comment w:id="1" w:author="Ben"><w:p w14:paraId="B1"><w:r><w:t>so</w:t></w:r></w:p></w:comment></ROOT>'
    extended = '<ROOT><w15:commentEx w15:paraId="A1" w15:done="1"/><w15:commentEx w15:paraId="B1" w15:paraIdParent="A1"/></ROOT>'
    notes = f'<ROOT><w:footnote w:id="2">{p("a note")}</w:footnote></ROOT>'
    rels = '<Relationships><Relationship Id="r1" Target="http://x.y/z"/></Relationships>'
    document = docx.Document(word_file(body, comments=comments, commentsExtended=extended, footnotes=notes, rels=rels))
    assert docx.to_markdown(document) == "[site](http://x.y/z)[^2] **[1]**\n\n> **[1]** Ann · 2024-01-02 (resolved)\n> why?\n>\n> > **[1.1]** Ben\n> > so\n\n[^2]: a note\n"


def test_equations():
    t = lambda s: f"<m:r><m:t>{s}</m:t></m:r>"
    cases = {
        f"<m:f><m:num>{t('a')}</m:num><m:den>{t('b')}</m:den></m:f>": r"\frac{a}{b}", f"<m:sSup><m:e>{t('xy')}</m:e><m:sup>{t('2')}</m:sup></m:sSup>": "{xy}^{2}", f"<m:rad><m:deg>{t('3')}</m:deg><m:e>{t('x')}</m:e></m:rad>": r"\sqrt[3]{x}",
        f'<m:nary><m:naryPr><m:chr m:val="∫"/></m:naryPr><m:sub>{t("0")}</m:sub><m:sup>{t("1")}</m:sup><m:e>{t("x")}</m:e></m:nary>': r"\int_{0}^{1}{x}", f'<m:d><m:dPr><m:begChr m:val="{{"/></m:dPr><m:e>{t("a")}</m:e><m:e>{t("b")}</m:e></m:d>': r"\left\{a,b\right)",
        f"<m:func><m:fName>{t('sin')}</m:fName><m:e>{t('x')}</m:e></m:func>": r"\sin{x}", f"<m:m><m:mr><m:e>{t('1')}</m:e><m:e>{t('2')}</m:e></m:mr></m:m>": r"\begin{matrix}1 & 2\end{matrix}",
    }
    for xml, want in cases.items():
        document = docx.Document(word_file(f"<w:p><m:oMath>{xml}</m:oMath></w:p>"))
        assert docx.to_markdown(document) == f"${want}$\n", xml


def run(doc, page, x, y, text, size=10.0, bold=False):
    return (doc, page, float(x), float(y), float(size), bold, False, text, None, 612.0, 792.0)


def test_pdf_blocks(spark):
    rows = []
    for page in range(4):
        rows += [run("d", page, 72, 770, "The Journal"), run("d", page, 300, 20, f"Page {page + 1}")]
    rows += [run("d", 0, 72, 700, "Big Title", 20), run("d", 0, 72, 670, "This is a long first line of a paragraph that goes"), run("d", 0, 72, 658, "on over two lines in this test and it ends a hyphen-"), run("d", 0, 72, 646, "ated word with more words to fill the line here")]
    rows += [run("d", 0, 72, 610, "• first"), run("d", 0, 90, 598, "• inner"), run("d", 0, 72, 586, "• second"), run("d", 1, 72, 700, "A Bold Head", bold=True), run("d", 1, 72, 680, "Plain text follows it on the next line for some way.")]
    rows += [run("d", 2, x, y, f"c{x}{y}") for y in (600, 588) for x in (72, 300)]
    frame = spark.createDataFrame(rows, pdf.RUNS_DDL)
    blocks = [(b.kind, b.level, b.text) for b in pdf.pdf_blocks(frame).orderBy("place").collect()]
    assert blocks[0] == ("heading", 1, "Big Title")
    assert blocks[1][2] == "This is a long first line of a paragraph that goes on over two lines in this test and it ends a hyphenated word with more words to fill the line here"
    assert blocks[2:5] == [("item", 0, "first"), ("item", 1, "inner"), ("item", 0, "second")]
    assert blocks[5] == ("heading", 3, "A Bold Head") and blocks[7][0] == "table" and len(blocks) == 8
    text = pdf.pdf_markdown(frame).first().markdown
    assert "The Journal" not in text and "Page" not in text and "| c72600 | c300600 |" in text


def test_pdf_columns_and_furniture(spark):
    left, right = [(72, 700 - 12 * k) for k in range(4)], [(330, 700 - 12 * k) for k in range(4)]
    runs = [pdf.Run(0, x, y, 10, "words in here", end=x + 200.0) for x, y in left + right]
    assert [len(c) for c in pdf.columns(runs, 612)] == [4, 4] and pdf.columns(runs, 612, rtl=True)[0][0].x == 330
    assert len(pdf.columns(runs[:3], 612)) == 1
    lines = spark.createDataFrame([("d", k, 780.0, 792.0, f"Page {k}") for k in range(4)] + [("d", k, 400.0, 792.0, "body") for k in range(4)], "doc string, page int, y double, height double, text string")
    assert [r.key for r in pdf.furniture(lines).collect()] == ["top:Page #"]
    with pytest.raises(DataError, match="pypdf"):
        pdf.read_pdf(spark, "/none")


def test_pdf_drawn_tables(spark):
    runs = [run("d", 0, 80, 690, "Name"), run("d", 0, 180, 690, "Age"), run("d", 0, 80, 670, "Ann"), run("d", 0, 180, 670, "41"), run("d", 0, 72, 740, "Before the table there is text."), run("d", 0, 72, 600, "After the table there is more.")]
    lines = [("d", 0, 70.0, y, 200.0, 0.5) for y in (660.0, 682.0, 704.0)] + [("d", 0, x, 660.0, 0.5, 44.0) for x in (70.0, 170.0, 270.0)] + [("d", 0, 271.0, 660.0, 0.5, 44.0)]
    boxes = spark.createDataFrame(lines, "doc string, page int, x double, y double, width double, height double")
    text = pdf.pdf_markdown(spark.createDataFrame(runs, pdf.RUNS_DDL), boxes).first().markdown
    assert text == "Before the table there is text.\n\n| Name | Age |\n| --- | --- |\n| Ann | 41 |\n\nAfter the table there is more.\n"
    assert pdf.drawn_tables([], [pdf.Box(0, 0, 0, 100, 50)]) == ([], [])


def test_pdf_links(spark):
    runs = spark.createDataFrame([run("d", 0, 72, 700, "site"), run("d", 0, 72, 600, "evil"), run("d", 0, 72, 500, "none")], pdf.RUNS_DDL)
    links = spark.createDataFrame([("d", 0, 70.0, 695.0, 60.0, 15.0, "https://a.b"), ("d", 0, 0.0, 0.0, 600.0, 750.0, "javascript:x"), ("d", 1, 0.0, 0.0, 600.0, 750.0, "https://c.d")], "doc string, page int, x double, y double, width double, height double, target string")
    assert {r.text: r.target for r in pdf.linked_runs(runs, links).collect()} == {"site": "https://a.b", "evil": None, "none": None}


def test_pdf_right_to_left():
    assert pdf.unshaped("\ufeb3\ufefc\ufee1 a") == "سلام a"
    assert pdf.reading_order("abc") == "abc" and pdf.reading_order("םולש") in ("שלום", "םולש")


def test_symbol_glyphs():
    read = [docx.glyph(*x) for x in (("Symbol", "F061"), ("symbol", "61"), ("Wingdings", "F0FE"), ("Wingdings 2", "F050"), ("Arial", "F041"), (None, "0042"))]
    assert read == ["α", "α", "☑", "✓", "A", "B"]
    assert [docx.glyph("Symbol", x) for x in (None, "", "zz", "F005", "D800")] == [""] * 5


def test_equation_signs():
    m = "http://schemas.openxmlformats.org/officeDocument/2006/math"
    tex = lambda inner: docx.latex(ElementTree.fromstring(f'<m:oMath xmlns:m="{m}">{inner}</m:oMath>'))
    assert tex("<m:r><m:t>a^b~$</m:t></m:r>") == r"a\^{}b\~{}\$"
    part = "<m:{0}><m:{0}Pr><m:chr m:val='{1}'/></m:{0}Pr><m:e><m:r><m:t>x</m:t></m:r></m:e></m:{0}>"
    assert [tex(part.format("nary", c)) for c in "∐∭⋁⋀"] == [r"\coprod{x}", r"\iiint{x}", r"\bigvee{x}", r"\bigwedge{x}"]
    marks = {"\u0306": "breve", "\u030c": "check", "\u0300": "grave", "\u0301": "acute", "\u0305": "overline"}
    assert [tex(part.format("acc", c)) for c in marks] == [rf"\{name}{{x}}" for name in marks.values()]
