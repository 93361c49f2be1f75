"""Word documents as blocks and as Markdown, parsed inside an Arrow map over file contents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "m": "http://schemas.openxmlformats.org/officeDocument/2006/math", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "w14": "http://schemas.microsoft.com/office/word/2010/wordml", "w15": "http://schemas.microsoft.com/office/word/2012/wordml",
}
MOST_HEADING, BODY_TEXT = 6, 9
_UNORDERED = ("bullet", "none")


def _q(name: str) -> str:
    prefix, _, local = name.partition(":")
    return f"{{{_NS[prefix]}}}{local}"


def _get(element, name: str) -> str | None:
    return None if element is None else element.get(_q(name))


def _child_value(parent, name: str) -> str | None:
    return None if parent is None else _get(parent.find(_q(name)), "w:val")


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdigit() else None


@dataclass
class Block:
    """A heading, list item, paragraph or table; ``text`` is its Markdown."""

    kind: str
    text: str
    level: int = 0
    ordered: bool = False
    rows: list[list[str]] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


# --- equations --------------------------------------------------------------------------------------------------------

# LaTeX names of operators, accents, brackets and functions.
_OPERATORS = {
    "∑": r"\sum", "∏": r"\prod", "∐": r"\coprod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint",
    "⋃": r"\bigcup", "⋂": r"\bigcap", "⋁": r"\bigvee", "⋀": r"\bigwedge",
}
_ACCENTS = {
    "\u0302": r"\hat", "\u0303": r"\tilde", "\u0304": r"\bar", "\u0305": r"\overline", "\u0306": r"\breve", "\u0307": r"\dot",
    "\u0308": r"\ddot", "\u030c": r"\check", "\u0300": r"\grave", "\u0301": r"\acute", "\u20d7": r"\vec",
}
_BRACKETS = {"": ".", "{": r"\{", "}": r"\}", "⟨": r"\langle", "⟩": r"\rangle", "‖": r"\|", "⌈": r"\lceil", "⌉": r"\rceil", "⌊": r"\lfloor", "⌋": r"\rfloor"}
_UPRIGHT = (
    "sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "coth",
    "log", "ln", "exp", "lim", "max", "min", "det", "gcd", "dim", "ker", "sup", "inf", "deg", "arg",
)
_TEX = {
    "\\": r"\backslash ", "{": r"\{", "}": r"\}", "%": r"\%", "$": r"\$", "&": r"\&", "#": r"\#", "_": r"\_",
    "^": r"\^{}", "~": r"\~{}",
}
#: Forms of elements whose parts only have to be put in their places.
_FORMS = {
    "sSub": "{@e}_{{{sub}}}", "sSup": "{@e}^{{{sup}}}", "sSubSup": "{@e}_{{{sub}}}^{{{sup}}}", "sPre": "{{}}_{{{sub}}}^{{{sup}}}{@e}",
    "limLow": r"\underset{{{lim}}}{{{e}}}", "limUpp": r"\overset{{{lim}}}{{{e}}}",
}


class _Parts(dict):
    """The named children of an equation element as LaTeX; ``@name`` braces all but single symbols."""

    def __init__(self, element):
        super().__init__()
        self.element = element

    def __missing__(self, key: str) -> str:
        child = self.element.find(_q("m:" + key.lstrip("@")))
        tex = "" if child is None else latex(child)
        return tex if not key.startswith("@") or len(tex) == 1 else f"{{{tex}}}"


def _setting(element, name: str) -> str | None:
    """A property such as m:chr, wherever the element keeps its properties."""
    for child in element:
        if child.tag.endswith("Pr"):
            found = child.find(_q("m:" + name))
            if found is not None:
                return found.get(_q("m:val"), "1")
    return None


def latex(element) -> str:
    """An equation, or what an element of it holds, as LaTeX."""
    return "".join(map(_latex_of, element))


def _latex_of(node) -> str:
    if not node.tag.startswith("{" + _NS["m"] + "}"):
        return latex(node)
    name, part = node.tag.rpartition("}")[2], _Parts(node)
    every = lambda tag: [latex(x) for x in node.findall(_q(tag))]
    hidden = lambda key: _setting(node, key) in ("1", "on", "true")
    if name.endswith("Pr"):
        return ""
    if name == "t":
        return "".join(_TEX.get(c, c) for c in node.text or "")
    if name in _FORMS:
        return _FORMS[name].format_map(part)
    if name == "f":
        kind = _setting(node, "type")
        form = "{@num}/{@den}" if kind == "lin" else r"\binom{{{num}}}{{{den}}}" if kind == "noBar" else r"\frac{{{num}}}{{{den}}}"
        return form.format_map(part)
    if name == "rad":
        degree = "" if hidden("degHide") else part["deg"]
        return r"\sqrt" + (f"[{degree}]" if degree else "") + f"{{{part['e']}}}"
    if name == "d":
        left, right, between = (_setting(node, k) for k in ("begChr", "endChr", "sepChr"))
        show = lambda c, default: _BRACKETS.get(default if c is None else c, default if c is None else c)
        return rf"\left{show(left, '(')}{(',' if between is None else between).join(every('m:e'))}\right{show(right, ')')}"
    if name == "nary":
        low, high = ("" if hidden(k) else part[p] for k, p in (("subHide", "sub"), ("supHide", "sup")))
        return _OPERATORS.get(_setting(node, "chr") or "∑", r"\sum") + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{part['e']}}}"
    if name == "func":
        return ("\\" if part["fName"] in _UPRIGHT else "") + part["fName"] + f"{{{part['e']}}}"
    if name == "acc":
        return _ACCENTS.get(_setting(node, "chr") or "̂", r"\hat") + f"{{{part['e']}}}"
    if name == "bar":
        return (r"\overline" if _setting(node, "pos") == "top" else r"\underline") + f"{{{part['e']}}}"
    if name == "m":
        return r"\begin{matrix}" + r" \\ ".join(" & ".join(latex(c) for c in row.findall(_q("m:e"))) for row in node.findall(_q("m:mr"))) + r"\end{matrix}"
    if name == "eqArr":
        return r"\begin{aligned}" + r" \\ ".join(every("m:e")) + r"\end{aligned}"
    return latex(node)


# --- symbol fonts -----------------------------------------------------------------------------------------------------

# The characters of the Symbol font (Adobe's encoding) and of the Wingdings fonts' marks, by code.
_GLYPHS = {
    "symbol": {
        0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2A: "∗", 0x2D: "−", 0x40: "≅",
        0x41: "Α", 0x42: "Β", 0x43: "Χ", 0x44: "Δ", 0x45: "Ε", 0x46: "Φ", 0x47: "Γ", 0x48: "Η", 0x49: "Ι", 0x4A: "ϑ",
        0x4B: "Κ", 0x4C: "Λ", 0x4D: "Μ", 0x4E: "Ν", 0x4F: "Ο", 0x50: "Π", 0x51: "Θ", 0x52: "Ρ", 0x53: "Σ", 0x54: "Τ",
        0x55: "Υ", 0x56: "ς", 0x57: "Ω", 0x58: "Ξ", 0x59: "Ψ", 0x5A: "Ζ", 0x5C: "∴", 0x5E: "⊥", 0x60: "‾",
        0x61: "α", 0x62: "β", 0x63: "χ", 0x64: "δ", 0x65: "ε", 0x66: "φ", 0x67: "γ", 0x68: "η", 0x69: "ι", 0x6A: "ϕ",
        0x6B: "κ", 0x6C: "λ", 0x6D: "μ", 0x6E: "ν", 0x6F: "ο", 0x70: "π", 0x71: "θ", 0x72: "ρ", 0x73: "σ", 0x74: "τ",
        0x75: "υ", 0x76: "ϖ", 0x77: "ω", 0x78: "ξ", 0x79: "ψ", 0x7A: "ζ", 0x7E: "∼",
        0xA0: "€", 0xA1: "ϒ", 0xA2: "′", 0xA3: "≤", 0xA4: "⁄", 0xA5: "∞", 0xA6: "ƒ", 0xA7: "♣", 0xA8: "♦", 0xA9: "♥", 0xAA: "♠",
        0xAB: "↔", 0xAC: "←", 0xAD: "↑", 0xAE: "→", 0xAF: "↓", 0xB0: "°", 0xB1: "±", 0xB2: "″", 0xB3: "≥", 0xB4: "×", 0xB5: "∝",
        0xB6: "∂", 0xB7: "•", 0xB8: "÷", 0xB9: "≠", 0xBA: "≡", 0xBB: "≈", 0xBC: "…", 0xBF: "↵", 0xC0: "ℵ", 0xC1: "ℑ", 0xC2: "ℜ",
        0xC3: "℘", 0xC4: "⊗", 0xC5: "⊕", 0xC6: "∅", 0xC7: "∩", 0xC8: "∪", 0xC9: "⊃", 0xCA: "⊇", 0xCB: "⊄", 0xCC: "⊂", 0xCD: "⊆",
        0xCE: "∈", 0xCF: "∉", 0xD0: "∠", 0xD1: "∇", 0xD2: "®", 0xD3: "©", 0xD4: "™", 0xD5: "∏", 0xD6: "√", 0xD7: "⋅", 0xD8: "¬",
        0xD9: "∧", 0xDA: "∨", 0xDB: "⇔", 0xDC: "⇐", 0xDD: "⇑", 0xDE: "⇒", 0xDF: "⇓", 0xE0: "◊", 0xE1: "⟨", 0xE5: "∑", 0xF1: "⟩", 0xF2: "∫",
    },
    "wingdings": {
        0x21: "✏", 0x22: "✂", 0x4A: "☺", 0x4B: "😐", 0x4C: "☹", 0x6C: "●", 0x6E: "■", 0x6F: "□", 0xA7: "▪", 0xA8: "▫",
        0xD8: "➔", 0xFB: "✗", 0xFC: "✓", 0xFD: "☒", 0xFE: "☑",
    },
    "wingdings 2": {0x50: "✓", 0x51: "✔", 0x52: "✗", 0x53: "✘", 0x54: "☑", 0x56: "☒"},
}


def glyph(font: str | None, code: str | None) -> str:
    """The text of a symbol: hexadecimal code, often moved to U+F000 to U+F0FF; other fonts give the plain character."""
    if not code or not re.fullmatch("[0-9A-Fa-f]{1,5}", code):
        return ""
    at = int(code, 16)
    at = at & 0xFF if at >> 8 == 0xF0 else at
    plain = chr(at) if at >= 0x20 and not 0xD800 <= at <= 0xDFFF else ""
    return _GLYPHS.get((font or "").strip().lower(), {}).get(at, plain)


# --- the package ------------------------------------------------------------------------------------------------------


class Document:
    """The parts of a .docx that its text depends on."""

    def __init__(self, raw: bytes):
        with zipfile.ZipFile(io.BytesIO(raw)) as package:
            names = set(package.namelist())
            part = lambda name: ElementTree.fromstring(package.read(name)) if name in names else None
            self.body = part("word/document.xml")
            self.parts = {n: part(f"word/{n}.xml") for n in ("styles", "numbering", "footnotes", "endnotes", "comments", "commentsExtended")}
            relations = part("word/_rels/document.xml.rels")
        self.targets = {} if relations is None else {r.get("Id"): r.get("Target") for r in relations}
        self.parents, self.style_lists, self.outlines = {}, {}, {}
        for style in self._all("styles", "w:style"):
            key, props = _get(style, "w:styleId"), style.find(_q("w:pPr"))
            if (above := _child_value(style, "w:basedOn")) is not None:
                self.parents[key] = above
            if props is not None:
                numbers = props.find(_q("w:numPr"))
                self.style_lists[key] = (_child_value(numbers, "w:numId"), _number(_child_value(numbers, "w:ilvl")))
                if (level := _number(_child_value(props, "w:outlineLvl"))) is not None:
                    self.outlines[key] = level
        formats = {_get(a, "w:abstractNumId"): {_get(x, "w:ilvl"): _child_value(x, "w:numFmt") for x in a.findall(_q("w:lvl"))} for a in self._all("numbering", "w:abstractNum")}
        self.formats = {_get(n, "w:numId"): formats.get(_child_value(n, "w:abstractNumId"), {}) for n in self._all("numbering", "w:num")}
        self.blocks = [] if self.body is None else self._blocks(self.body.find(_q("w:body")))

    def _all(self, part: str, tag: str) -> list:
        root = self.parts[part]
        return [] if root is None else root.findall(_q(tag))

    def _chain(self, style: str | None) -> list[str]:
        out: list[str] = []
        while style is not None and style not in out:
            out.append(style)
            style = self.parents.get(style)
        return out

    def _ordered(self, numbering: str, level: int) -> bool:
        kind = self.formats.get(numbering, {}).get(str(level))
        return kind is not None and kind not in _UNORDERED

    # blocks

    def _blocks(self, parent) -> list[Block]:
        out: list[Block] = []
        for child in parent if parent is not None else ():
            if child.tag == _q("w:p"):
                out.append(self._paragraph(child))
            elif child.tag == _q("w:tbl"):
                out.append(self._table(child))
            elif child.tag == _q("w:sdt"):
                out += self._blocks(child.find(_q("w:sdtContent")))
        return out

    def _paragraph(self, p) -> Block:
        props = p.find(_q("w:pPr"))
        chain = self._chain(_child_value(props, "w:pStyle"))
        block = Block("paragraph", "")
        block.text = self._inline(p, block).strip()
        named = next((int(m[1]) for s in chain if (m := re.fullmatch(r"[Hh]eading\s?([1-9])", s))), None)
        outline = _number(_child_value(props, "w:outlineLvl"))
        if outline is None or outline >= BODY_TEXT:
            outline = next((self.outlines[s] for s in chain if s in self.outlines), None)
        level = named or (outline + 1 if outline is not None and outline < BODY_TEXT else None)
        if level:
            block.kind, block.level = "heading", min(level, MOST_HEADING)
            return block
        own = None if props is None else props.find(_q("w:numPr"))
        inherited = [self.style_lists[s] for s in chain if s in self.style_lists]
        number = _child_value(own, "w:numId") or next((n for n, _ in inherited if n is not None), None)
        depth = _number(_child_value(own, "w:ilvl"))
        if number != "0" and (number is not None or own is not None):
            if depth is None:
                depth = next((d for _, d in inherited if d is not None), 0)
            block.kind, block.level, block.ordered = "item", depth, self._ordered(number or "", depth)
        return block

    def _table(self, table) -> Block:
        block = Block("table", "")
        for row in table.findall(_q("w:tr")):
            cells = []
            for cell in row.findall(_q("w:tc")):
                inner = self._blocks(cell)
                for b in inner:
                    block.comments += b.comments
                    block.notes += b.notes
                cells.append("<br>".join(b.text for b in inner if b.text).replace("|", "\\|").replace("\n", "<br>"))
            block.rows.append(cells)
        return block

    # inline

    def _inline(self, parent, block: Block) -> str:
        runs: list[tuple[tuple, str]] = []

        def walk(node, link: str | None) -> None:
            for child in node:
                tag = child.tag
                if tag == _q("w:r"):
                    style, text = self._run(child, block)
                    runs.append(((*style, link), text))
                elif tag == _q("w:hyperlink"):
                    walk(child, self.targets.get(_get(child, "r:id")) or ("#" + _get(child, "w:anchor") if _get(child, "w:anchor") else None))
                elif tag in (_q("w:del"), _q("w:moveFrom"), _q("w:pPr")):
                    continue
                elif tag == _q("m:oMathPara"):
                    runs.extend((("math",), f"\n$$\n{latex(m)}\n$$\n") for m in child.findall(_q("m:oMath")))
                elif tag == _q("m:oMath"):
                    runs.append((("math",), f"${latex(child)}$"))
                else:
                    walk(child, link)

        walk(parent, None)
        merged: list[list] = []
        for style, text in runs:
            if merged and merged[-1][0] == style and style != ("math",):
                merged[-1][1] += text
            else:
                merged.append([style, text])
        return "".join(text if style == ("math",) else _styled(text, *style) for style, text in merged)

    def _run(self, run, block: Block) -> tuple[tuple, str]:
        props, text = run.find(_q("w:rPr")), ""

        def on(name: str) -> bool:
            element = None if props is None else props.find(_q(name))
            return element is not None and _get(element, "w:val") not in ("0", "false", "none")

        for child in run:
            name = child.tag.rpartition("}")[2]
            if name == "t":
                text += child.text or ""
            elif name in ("tab", "ptab"):
                text += "\t"
            elif name in ("br", "cr"):
                text += "\n"
            elif name == "noBreakHyphen":
                text += "-"
            elif name == "sym":
                text += glyph(_get(child, "w:font"), _get(child, "w:char"))
            elif name in ("footnoteReference", "endnoteReference"):
                key = _get(child, "w:id")
                block.notes.append(key)
                text += f"[^{key}]"
            elif name == "commentReference":
                block.comments.append(_get(child, "w:id"))
        return (on("w:b"), on("w:i"), on("w:strike") or on("w:dstrike"), (_child_value(props, "w:rFonts") or "").lower().startswith(("courier", "consolas"))), text

    # notes and comments

    def notes(self) -> dict[str, str]:
        out = {}
        for part, tag in (("footnotes", "w:footnote"), ("endnotes", "w:endnote")):
            for note in self._all(part, tag):
                text = " ".join(b.text for b in self._blocks(note) if b.text)
                if text:
                    out.setdefault(_get(note, "w:id"), text)
        return out

    def comments(self) -> dict[str, dict]:
        found, owner = {}, {}
        for c in self._all("comments", "w:comment"):
            key = _get(c, "w:id")
            found[key] = {"author": _get(c, "w:author") or "Unknown", "date": (_get(c, "w:date") or "").split("T")[0], "lines": [b.text for b in self._blocks(c) if b.text], "resolved": False, "parent": None}
            for p in c.findall(_q("w:p")):
                if _get(p, "w14:paraId"):
                    last = _get(p, "w14:paraId")
                    owner[last] = key
        for entry in self._all("commentsExtended", "w15:commentEx"):
            key = owner.get(_get(entry, "w15:paraId"))
            if key is not None:
                found[key]["resolved"] = _get(entry, "w15:done") in ("1", "true")
                found[key]["parent"] = owner.get(_get(entry, "w15:paraIdParent"))
        return found


def _styled(text: str, bold: bool, italic: bool, strike: bool, code: bool, link: str | None) -> str:
    """Markdown around a run, its outer spaces left outside."""
    bare = text.strip()
    if not bare:
        return text
    before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    bare = f"`{bare}`" if code else re.sub(r"([\\`*_])", r"\\\1", bare) if not re.match(r"\[\^", bare) else bare
    for wanted, mark in ((strike, "~~"), (italic, "*"), (bold, "**")):
        bare = mark + bare + mark if wanted and not code else bare
    if link:
        bare = f"[{bare}](<{link}>)" if re.search(r"[\s()]", link) else f"[{bare}]({link})"
    return before + bare + after


def to_markdown(document: Document, with_comments: bool = True) -> str:
    """The document as Markdown: blocks, comment threads after their block, notes in order of use."""
    out: list[tuple[str, bool]] = []
    counters: dict[int, int] = {}
    base: bool | None = None
    threads, notes = document.comments() if with_comments else {}, document.notes()
    order = [c for b in document.blocks for c in b.comments if threads.get(c, {}).get("parent") is None and c in threads]
    number = {c: str(k) for k, c in enumerate(dict.fromkeys(order), 1)}
    for key, comment in threads.items():
        if comment["parent"] in number:
            number[key] = f"{number[comment['parent']]}.{1 + sum(1 for n in number.values() if n.startswith(number[comment['parent']] + '.'))}"
    used: list[str] = []
    for block in document.blocks:
        used += [n for n in block.notes if n not in used]
        marks = "".join(f" **[{number[c]}]**" for c in dict.fromkeys(block.comments) if "." not in number.get(c, "."))
        same_list = False
        if block.kind == "item":
            flipped = block.level == 0 and base is not None and base != block.ordered
            same_list = base is not None and not flipped
            if flipped:
                counters.clear()
            if block.level == 0 or base is None:
                base = block.ordered
            if block.ordered:
                counters[block.level] = counters.get(block.level, 0) + 1
            for deeper in [k for k in counters if k > block.level]:
                del counters[deeper]
            marker = f"{counters[block.level]}." if block.ordered else "-"
            text = f"{'  ' * block.level}{marker} {block.text}{marks}".rstrip()
        else:
            counters.clear()
            base = None
            if block.kind == "heading":
                text = f"{'#' * block.level} {block.text}{marks}".rstrip() if block.text else ""
            elif block.kind == "table":
                width = max(map(len, block.rows), default=0)
                rows = [row + [""] * (width - len(row)) for row in block.rows]
                line = lambda cells: "| " + " | ".join(cells) + " |"
                text = "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) if rows else ""
            else:
                text = block.text + marks
        if text:
            out.append((text, same_list))
        said = []
        for key in dict.fromkeys(block.comments):
            if "." in number.get(key, "."):
                continue
            for part in (key, *sorted((k for k, c in threads.items() if c["parent"] == key), key=lambda k: number.get(k, ""))):
                c, depth = threads[part], "> " if part == key else "> > "
                said += [">"] if said else []
                said.append(f"{depth}**[{number[part]}]** {c['author']}" + (f" · {c['date']}" if c["date"] else "") + (" (resolved)" if c["resolved"] else ""))
                said += [depth + line for text_ in c["lines"] for line in text_.split("\n")]
        if said:
            out.append(("\n".join(said), False))
    defined = "\n".join(f"[^{n}]: {notes[n]}" for n in used if n in notes)
    text = "".join(("" if not k else "\n" if same else "\n\n") + piece for k, (piece, same) in enumerate(out))
    return text + (f"\n\n{defined}" if defined else "") + "\n"


_SCHEMA = pa.schema([("path", pa.string()), ("markdown", pa.string()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("ordered", pa.bool_()), ("text", pa.string())]))), ("error", pa.string())])
_DDL = "path string, markdown string, blocks array<struct<kind: string, level: int, ordered: boolean, text: string>>, error string"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown, blocks, error) of Word files; a file that is none has an error instead."""
    return parse_docx(spark.read.format("binaryFile").load(path).select("path", "content"))


def parse_docx(files: DataFrame) -> DataFrame:
    """The same of a frame with the columns path and content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    document = Document(raw)
                    row = (path, to_markdown(document), [{"kind": b.kind, "level": b.level, "ordered": b.ordered, "text": b.text} for b in document.blocks], None)
                except (zipfile.BadZipFile, ElementTree.ParseError, TypeError) as error:
                    row = (path, None, None, f"not a Word document: {error}")
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(work, _DDL)
