"""Text units of a file's bytes, and a file's bytes with other texts in their place, by the standard library alone.

A unit is (ctx, text, kind): its address in the file, its text, and "text" or "formula". Readers give units in document order;
writers take, for each ctx, the spans (start, end, replacement) of its text, in order and without overlap.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

Unit = tuple[str, str, str]
Spans = dict[str, list[tuple[int, int, str]]]

# Suffixes by format, and the sum of sizes that an archive may declare.
ROUTES = {
    "pdf": (".pdf",),
    "docx": (".docx", ".dotx"),
    "xlsx": (".xlsx", ".xlsm"),
    "pptx": (".pptx", ".potx"),
    "image": (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".heic"),
    "odf": (".odt", ".ods", ".odp"),
    "json": (".json",),
    "text": (".txt", ".log", ".csv", ".yaml", ".yml", ".xml", ".ini", ".env", ".toml", ".md"),
}
ARCHIVE_BYTES = 500 * 1024 * 1024

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name.strip(".") or name.startswith(".") and name.count(".") > 1 else (name.lower() if name.startswith(".") else "")


def route(path: str) -> str | None:
    """The format of a path by its suffix; None if it isn't supported."""
    suffix = suffix_of(path)
    return next((kind for kind, suffixes in ROUTES.items() if suffix in suffixes), None)


def is_supported(path: str) -> bool:
    return route(path) is not None


def check_archive(data: bytes, most: int = ARCHIVE_BYTES) -> None:
    """Refuse a zip archive that declares more bytes than most; what is no archive passes."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            total = sum(i.file_size for i in z.infolist())
    except zipfile.BadZipFile:
        return
    if total > most:
        raise ValueError(f"archive declares {total} bytes, over {most}")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    for st, en, new in sorted(spans, reverse=True):
        text = text[:st] + new + text[en:]
    return text


# Text and JSON


def text_units(data: bytes) -> list[Unit]:
    return [("", data.decode("utf-8", "replace"), "text")]


def text_replaced(data: bytes, spans: Spans) -> bytes:
    return replaced(data.decode("utf-8", "replace"), spans.get("", [])).encode()


def _leaves(value: object) -> Iterator[tuple[str, str]]:
    """Path and text of each string, in order, however deep it lies."""
    left: list[tuple[str, object]] = [("", value)]
    while left:
        path, v = left.pop()
        if isinstance(v, str):
            yield path, v
        elif isinstance(v, dict):
            left += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            left += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]


def _parsed(data: bytes) -> tuple[bool, object]:
    try:
        return True, json.loads(data.decode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return False, None


def json_units(data: bytes) -> list[Unit]:
    """String leaves by path (keys and numbers aren't looked at); what doesn't parse, or lies deeper than the parser goes, is one text."""
    ok, value = _parsed(data)
    return [(p, v, "text") for p, v in _leaves(value)] if ok else text_units(data)


def json_replaced(data: bytes, spans: Spans) -> bytes:
    ok, value = _parsed(data)
    if not ok:
        return text_replaced(data, spans)

    root = [value]
    left: list[tuple[str, dict | list, object]] = [("", root, 0)]
    while left:
        path, holder, key = left.pop()
        v = holder[key]
        if isinstance(v, str):
            holder[key] = replaced(v, spans.get(path, []))
        elif isinstance(v, dict):
            left += [(f"{path}.{k}" if path else k, v, k) for k in v]
        elif isinstance(v, list):
            left += [(f"{path}[{i}]", v, i) for i in range(len(v))]
    return json.dumps(root[0], indent=2, ensure_ascii=False).encode()


# Archives of XML


class _Parts:
    """An archive's members, the XML ones parsed when asked for and written back if they were."""

    def __init__(self, data: bytes) -> None:
        check_archive(data)
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.trees: dict[str, ET.Element] = {}

    def tree(self, name: str) -> ET.Element:
        if name not in self.trees:
            data = self.zip.read(name)
            for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
                if not re.fullmatch(r"ns\d+", prefix):
                    ET.register_namespace(prefix, uri)
            self.trees[name] = ET.fromstring(data)
        return self.trees[name]

    def has(self, name: str) -> bool:
        return name in self.zip.namelist()

    def related(self, name: str) -> dict[str, str]:
        """Targets of a part's relations by id."""
        rels = posixpath.join(posixpath.dirname(name), "_rels", posixpath.basename(name) + ".rels")
        if not self.has(rels):
            return {}
        found = {}
        for r in ET.fromstring(self.zip.read(rels)):
            target = r.get("Target", "")
            found[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(name), target))
        return found

    def saved(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.zip.infolist():
                if info.filename in self.trees:
                    body = ET.tostring(self.trees[info.filename], encoding="utf-8", xml_declaration=True)
                else:
                    body = self.zip.read(info.filename)
                stored = info.filename == "mimetype"
                z.writestr(info.filename, body, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
        return out.getvalue()


class _Runs:
    """The runs of a paragraph. Their texts add up to the paragraph's; special children stand for a character."""

    def __init__(self, paragraph: ET.Element, run: str, text: str, special: dict[str, str]) -> None:
        self.text_tag, self.special = text, special
        self.runs = list(paragraph.iter(run))

    def of(self, run: ET.Element) -> str:
        if run.tag in self.special:
            return self.special[run.tag]
        return "".join(c.text or "" if c.tag == self.text_tag else self.special.get(c.tag, "") for c in run)

    @property
    def text(self) -> str:
        return "".join(map(self.of, self.runs))

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        """Put each replacement in the first run that its span touches, empty the runs between, and trim the last."""
        for st, en, new in sorted(spans, reverse=True):
            pos = 0
            put = False
            for run in self.runs:
                text = self.of(run)
                a, b = max(st - pos, 0), min(en - pos, len(text))
                if a < b:
                    self._set(run, text[:a] + ("" if put else new) + text[b:])
                    put = True
                pos += len(text)

    def _set(self, run: ET.Element, text: str) -> None:
        first = None
        for c in list(run):
            if c.tag == self.text_tag and first is None:
                first = c
            elif c.tag == self.text_tag or c.tag in self.special:
                run.remove(c)
        if first is None:
            first = ET.SubElement(run, self.text_tag)
        first.text = text
        if self.text_tag.startswith(_W):
            first.set(_SPACE, "preserve")


def _docx_paragraphs(parts: _Parts) -> Iterator[tuple[str, _Runs]]:
    """Body paragraphs from 1; tables, their cells and paragraphs from 0; the headers and footers that each section names."""
    main = "word/document.xml"
    special = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}

    def runs(p: ET.Element) -> _Runs:
        return _Runs(p, f"{_W}r", f"{_W}t", special)

    body = parts.tree(main).find(f"{_W}body")
    if body is None:
        return
    for i, p in enumerate(body.findall(f"{_W}p")):
        yield f"para {i + 1}", runs(p)
    for t, table in enumerate(body.findall(f"{_W}tbl")):
        for r, row in enumerate(table.findall(f"{_W}tr")):
            for c, cell in enumerate(row.findall(f"{_W}tc")):
                for k, p in enumerate(cell.findall(f"{_W}p")):
                    yield f"table {t} cell {r},{c} para {k}", runs(p)
    related = parts.related(main)
    prefixes = {"default": "", "even": "e", "first": "f"}
    for s, section in enumerate(body.iter(f"{_W}sectPr")):
        for kind, name in (("headerReference", "hdr"), ("footerReference", "ftr")):
            for ref in section.findall(_W + kind):
                part = related.get(ref.get(f"{_R}id", ""), "")
                if not parts.has(part):
                    continue
                head = f"section {s + 1} " if s else ""
                tree = parts.tree(part)
                place = head + prefixes.get(ref.get(f"{_W}type", "default"), "") + name
                for i, p in enumerate(tree.findall(f"{_W}p")):
                    yield f"{place} para {i}", runs(p)
                for i, p in enumerate(tree.findall(f".//{_W}tbl//{_W}p")):
                    yield f"{place} table para {i}", runs(p)


def _pptx_paragraphs(parts: _Parts) -> Iterator[tuple[str, _Runs]]:
    """Slides, shapes with text and their paragraphs, from 1."""
    main = "ppt/presentation.xml"
    related = parts.related(main)
    special = {f"{_A}br": "\v"}
    for n, ref in enumerate(parts.tree(main).iter(f"{_P}sldId"), 1):
        slide = related.get(ref.get(f"{_R}id", ""), "")
        if not parts.has(slide):
            continue
        for k, shape in enumerate(parts.tree(slide).findall(f"{_P}cSld/{_P}spTree/{_P}sp"), 1):
            for m, p in enumerate(shape.findall(f"{_P}txBody/{_A}p"), 1):
                yield f"slide {n} shape {k} para {m}", _Runs(p, f"{_A}r", f"{_A}t", special)


def _paragraph_units(paragraphs: Callable[[_Parts], Iterator[tuple[str, _Runs]]]) -> Callable[[bytes], list[Unit]]:
    return lambda data: [(ctx, runs.text, "text") for ctx, runs in paragraphs(_Parts(data))]


def _paragraph_writer(paragraphs: Callable[[_Parts], Iterator[tuple[str, _Runs]]]) -> Callable[[bytes, Spans], bytes]:
    def write(data: bytes, spans: Spans) -> bytes:
        parts = _Parts(data)
        for ctx, runs in paragraphs(parts):
            if ctx in spans:
                runs.replace(spans[ctx])
        return parts.saved()

    return write


def _cells(parts: _Parts) -> Iterator[tuple[str, str, str, ET.Element, ET.Element]]:
    """ctx, text, kind, cell and sheet of each cell that holds a string or a formula."""
    main = "xl/workbook.xml"
    related = parts.related(main)
    shared: list[str] = []
    if parts.has("xl/sharedStrings.xml"):
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(parts.zip.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    for ref in parts.tree(main).iter(f"{_S}sheet"):
        name = related.get(ref.get(f"{_R}id", ""), "")
        if not parts.has(name):
            continue
        sheet = parts.tree(name)
        for c in sheet.iter(f"{_S}c"):
            ctx = f"{ref.get('name')}!{c.get('r')}"
            value, formula = c.find(f"{_S}v"), c.find(f"{_S}f")
            if formula is not None:
                yield ctx, "=" + (formula.text or ""), "formula", c, sheet
            elif c.get("t") == "s" and value is not None:
                yield ctx, shared[int(value.text or 0)], "text", c, sheet
            elif c.get("t") == "inlineStr":
                yield ctx, "".join(t.text or "" for t in c.iter(f"{_S}t")), "text", c, sheet
            elif c.get("t") == "str" and value is not None:
                yield ctx, value.text or "", "text", c, sheet
            elif value is not None and value.text and c.get("t") in (None, "n"):
                yield ctx, value.text, "number", c, sheet


def xlsx_units(data: bytes, numbers: bool = False) -> list[Unit]:
    """Cells with a string or a formula; with numbers, those with a number too, as text."""
    found = [(ctx, text, kind) for ctx, text, kind, _, _ in _cells(_Parts(data)) if text]
    return [(c, t, "formula" if k == "formula" or t.startswith("=") else "text") for c, t, k in found if numbers or k != "number"]


def xlsx_replaced(data: bytes, spans: Spans) -> bytes:
    """Replaced cells hold plain strings; their columns get as wide as the text and two more."""
    parts = _Parts(data)
    for ctx, text, _, c, sheet in list(_cells(parts)):
        if ctx not in spans:
            continue
        new = replaced(text, spans[ctx])
        for child in list(c):
            c.remove(child)
        c.set("t", "inlineStr")
        t = ET.SubElement(ET.SubElement(c, f"{_S}is"), f"{_S}t")
        t.text = new
        t.set(_SPACE, "preserve")
        _widen(sheet, re.sub(r"\d", "", c.get("r", "A1")), len(new) + 2)
    return parts.saved()


def _widen(sheet: ET.Element, letters: str, needed: int) -> None:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    cols = sheet.find(f"{_S}cols")
    if cols is None:
        cols = ET.Element(f"{_S}cols")
        at = next((i for i, e in enumerate(sheet) if e.tag == f"{_S}sheetData"), 0)
        sheet.insert(at, cols)
    for col in cols:
        if int(col.get("min", 0)) <= n <= int(col.get("max", 0)):
            if float(col.get("width", 8)) < needed and col.get("min") == col.get("max"):
                col.set("width", str(needed))
                col.set("customWidth", "1")
            return
    if needed > 8:
        new = ET.Element(f"{_S}col", {"min": str(n), "max": str(n), "width": str(needed), "customWidth": "1"})
        cols.insert(sum(int(c.get("min", 0)) < n for c in cols), new)


def _odf_nodes(parts: _Parts) -> Iterator[tuple[str, ET.Element, str]]:
    """Address, element and attribute (text or tail) of each text node of the body, in order."""
    body = parts.tree("content.xml").find("{urn:oasis:names:tc:opendocument:xmlns:office:1.0}body")
    n = 0

    def walk(e: ET.Element) -> Iterator[tuple[ET.Element, str]]:
        if e.text:
            yield e, "text"
        for c in e:
            yield from walk(c)
            if c.tail:
                yield c, "tail"

    for e, where in walk(body) if body is not None else ():
        yield f"odf {n}", e, where
        n += 1


def odf_units(data: bytes) -> list[Unit]:
    return [(ctx, getattr(e, where), "text") for ctx, e, where in _odf_nodes(_Parts(data))]


def odf_replaced(data: bytes, spans: Spans) -> bytes:
    """Each text node keeps its place, so the layout stays."""
    parts = _Parts(data)
    for ctx, e, where in list(_odf_nodes(parts)):
        if ctx in spans:
            setattr(e, where, replaced(getattr(e, where), spans[ctx]))
    return parts.saved()


# Images and PDF


def image_cleaned(data: bytes, spans: Spans | None = None) -> bytes:
    """An image without its metadata; its pixels' bytes stay as they are. PNG and JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = [data[:8]], 8
        while at + 8 <= len(data):
            (n,) = struct.unpack_from(">I", data, at)
            if data[at + 4 : at + 8] not in (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"):
                out.append(data[at : at + 12 + n])
            at += 12 + n
        return b"".join(out)
    if data[:2] == b"\xff\xd8":
        out, at = [data[:2]], 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            (n,) = struct.unpack_from(">H", data, at + 2)
            if not (0xE1 <= data[at + 1] <= 0xED or data[at + 1] in (0xEF, 0xFE)):
                out.append(data[at : at + 2 + n])
            at += 2 + n
        return b"".join([*out, data[at:]])
    raise ValueError("neither PNG nor JPEG: its metadata can't be told from its pixels here")


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|Td|TD|Tm|ET)\b|T\*|'|\"", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")


def _pdf_stream(body: bytes, most: int = ARCHIVE_BYTES) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    if b"FlateDecode" not in body[: m.start()]:
        return m[1]
    inflate = zlib.decompressobj()
    try:
        out = inflate.decompress(m[1], most)
    except zlib.error as e:
        raise ValueError(f"a stream can't be inflated: {e}") from e
    if inflate.unconsumed_tail:
        raise ValueError(f"a stream inflates to over {most} bytes")
    return out


def _pdf_objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those in object streams too."""
    objects = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(objects.values()):
        head = body.split(b"stream", 1)[0]
        if not re.search(rb"/Type\s*/ObjStm\b", head):
            continue
        first = re.search(rb"/First\s+(\d+)", head)
        inner = _pdf_stream(body)
        if not first:
            raise ValueError("an object stream doesn't say where its objects begin")
        at = int(first[1])
        numbers = [int(x) for x in inner[:at].split()]
        places = [*numbers[1::2], len(inner) - at]
        for n, a, b in zip(numbers[::2], places, places[1:], strict=False):
            objects.setdefault(n, inner[at + a : at + b])
    return objects


def _pdf_pages(objects: dict[int, bytes]) -> list[int]:
    """Pages in the order of the page tree; in that of their numbers if there is none."""
    pages = [n for n in sorted(objects) if re.search(rb"/Type\s*/Page\b", objects[n])]
    root = next((m for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b))), None)
    found, left, seen = [], [int(root[1])] if root else [], set()
    while left:
        n = left.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", objects[n])
        if kids:
            left += [int(x) for x in reversed(_REFERENCE.findall(kids[1]))]
        elif n in pages:
            found.append(n)
    return [*found, *[n for n in pages if n not in seen]]


def pdf_units(data: bytes) -> list[Unit]:
    """Text of each page, from 1, in the order of the page tree. Content plain or deflated, objects in object streams or not, one-byte characters.

    A file with pages of which none holds such text (scanned pages, other encodings, encryption) is an error: it must not pass for one without
    findings. Pages are read, not written.
    """
    if re.search(rb"/Encrypt\b", data):
        raise ValueError("the PDF is encrypted")
    objects = _pdf_objects(data)

    def literal(x: bytes) -> bytes:
        if x[:1] == b"<":
            digits = re.sub(rb"\s", b"", x[1:-1]).decode()
            return bytes.fromhex(digits + "0" * (len(digits) % 2))
        return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), x[1:-1], flags=re.S)

    units = []
    pages = _pdf_pages(objects)
    for page, n in enumerate(pages, 1):
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", objects[n])
        ids = [int(x) for x in _REFERENCE.findall(refs[1])] if refs and refs[1] else [int(refs[2])] if refs else []
        text, held = "", b""
        for x in _SHOWN.findall(b"\n".join(_pdf_stream(objects.get(i, b"")) for i in ids)):
            if x[:1] in b"(<":
                held += literal(x)
            else:
                text += held.decode("cp1252", "replace")
                held = b""
                if x in (b"Td", b"TD", b"T*", b"'", b'"', b"ET", b"Tm") and text and not text.endswith("\n"):
                    text += "\n"
        units.append((f"page {page}", text.strip("\n"), "text"))
    if not any(text for _, text, _ in units):
        raise ValueError(f"no text could be read from the PDF's {len(pages)} pages")
    return units


def _cannot(data: bytes, spans: Spans) -> bytes:
    raise NotImplementedError("PDF pages are read, not written")


READERS: dict[str, Callable[[bytes], list[Unit]]] = {
    "text": text_units, "json": json_units, "docx": _paragraph_units(_docx_paragraphs), "pptx": _paragraph_units(_pptx_paragraphs),
    "xlsx": xlsx_units, "odf": odf_units, "image": lambda data: [], "pdf": pdf_units,
}
WRITERS: dict[str, Callable[[bytes, Spans], bytes]] = {
    "text": text_replaced, "json": json_replaced, "docx": _paragraph_writer(_docx_paragraphs), "pptx": _paragraph_writer(_pptx_paragraphs),
    "xlsx": xlsx_replaced, "odf": odf_replaced, "image": image_cleaned, "pdf": _cannot,
}
