"""Text of PDF files with its places on the page, without a PDF library.

Reads classic and compressed objects, Flate streams, simple fonts in the Windows code page and fonts with a
``ToUnicode`` map. Encrypted files and other stream filters give an error instead of text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import pdf_date
from quern.sources.files import detect_tables, document_type

#: Points of a page in one unit of the table geometry's tolerances.
UNIT = 16.0

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<dict><<|>>)|(?P<open>\[)|(?P<close>\])|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<string>\()|(?P<op>[A-Za-z'\"*]+)|.", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """A file that cannot be read, and why."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that opens right before ``at``, and the place behind it."""
    out, depth, i = bytearray(), 1, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            n = data[i + 1 : i + 2]
            if n.isdigit():
                octal = re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4])
                out.append(int(octal.group(), 8) & 255 if octal else 0)
                i += 1 + (len(octal.group()) if octal else 1)
                continue
            out += _ESCAPES.get(n, b"" if n in (b"\n", b"\r") else n)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def _value(body: bytes, key: bytes) -> bytes | None:
    """What stands behind a key of a dictionary: a reference, name, number, string or bracketed value."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(\d+\s+\d+\s+R\b|/[^\s()<>\[\]{}/%]*|[+-]?[\d.]+|\[[^\]]*\]|<[0-9A-Fa-f\s]*>|\(|<<)", body, re.S)
    if not m:
        return None
    if m.group(1) == b"(":
        return b"(" + _string(body, m.end())[0]
    if m.group(1) == b"<<":
        depth, i = 1, m.end()
        while i < len(body) and depth:
            depth += (body[i : i + 2] == b"<<") - (body[i : i + 2] == b">>")
            i += 2 if body[i : i + 2] in (b"<<", b">>") else 1
        return body[m.start(1) : i]
    return m.group(1)


class Document:
    """Objects of one file."""

    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5] == b"%PDF-":
            raise PdfError("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("encrypted")
        self.objects: dict[int, bytes] = {}
        starts = [(int(m.group(1)), m.start(), m.end()) for m in _OBJECT.finditer(data)]
        for k, (number, _, begin) in enumerate(starts):
            end = data.find(b"endobj", begin)
            limit = starts[k + 1][1] if k + 1 < len(starts) else len(data)
            self.objects[number] = data[begin : end if 0 <= end <= limit or b"stream" in data[begin:limit] and end > 0 else limit]
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body[:2000]):
                self._unpack(body)
        self.trailer = b" ".join(re.findall(rb"trailer\s*(<<.*?>>)\s*startxref", data, re.S)) or b" ".join(b for b in self.objects.values() if re.search(rb"/Type\s*/XRef\b", b[:2000]))

    def _unpack(self, body: bytes) -> None:
        first, n = _value(body, b"First"), _value(body, b"N")
        content = self.stream(body)
        if content is None or not first or not n:
            return
        heads = list(map(int, content[: int(first)].split()))
        pairs = list(zip(heads[::2], heads[1::2], strict=False))
        for k, (number, offset) in enumerate(pairs):
            end = pairs[k + 1][1] if k + 1 < len(pairs) else len(content) - int(first)
            self.objects.setdefault(number, content[int(first) + offset : int(first) + end])

    def get(self, value: bytes | None) -> bytes | None:
        """The object that a reference leads to, other values as they are."""
        m = _REF.fullmatch(value.strip()) if value else None
        return self.objects.get(int(m.group(1))) if m else value

    def stream(self, body: bytes) -> bytes | None:
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return None
        raw = body[m.end() :]
        end = raw.rfind(b"endstream")
        raw = raw[:end] if end >= 0 else raw
        filters = re.findall(rb"/(\w+)", _value(body[: m.start()], b"Filter") or b"")
        if not filters:
            return raw
        if filters != [b"FlateDecode"]:
            return None
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return None

    def pages(self) -> list[bytes]:
        """Page objects in order."""
        root = self.get(_value(self.trailer, b"Root")) or next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        todo, seen = [_value(root, b"Pages")], set()
        while todo:
            ref = todo.pop(0)
            if ref is None or ref in seen:
                continue
            seen.add(ref)
            body = self.get(ref)
            if body is None:
                continue
            kids = self.get(_value(body, b"Kids"))
            if kids is not None:
                todo = [m.group() for m in _REF.finditer(kids)] + todo
            else:
                out.append(body)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]

    def inherited(self, page: bytes, key: bytes) -> bytes | None:
        for _ in range(30):
            if (v := self.get(_value(page, key))) is not None:
                return v
            page = self.get(_value(page, b"Parent"))
            if page is None:
                return None
        return None

    def info(self, key: bytes) -> str | None:
        body = self.get(_value(self.trailer, b"Info"))
        v = self.get(_value(body, key)) if body else None
        if not v or v[:1] not in b"(<":
            return None
        raw = v[1:] if v[:1] == b"(" else bytes.fromhex(re.sub(rb"[<>\s]", b"", v).decode() or "")
        return (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")).strip() or None

    def fonts(self, page: bytes) -> dict[bytes, tuple[dict[int, str], int] | None]:
        """Maps from codes to text of the page's fonts that have one, with the bytes of a code."""
        of = self.get(_value(self.inherited(page, b"Resources") or b"", b"Font")) or b""
        out: dict[bytes, tuple[dict[int, str], int] | None] = {}
        for m in re.finditer(rb"(/[^\s()<>\[\]{}/%]+)\s+(\d+\s+\d+\s+R)\b", of):
            font = self.get(m.group(2)) or b""
            to = self.get(_value(font, b"ToUnicode"))
            cmap = self.stream(to) if to else None
            out[m.group(1)] = _cmap(cmap) if cmap else None
        return out


def _cmap(text: bytes) -> tuple[dict[int, str], int]:
    codes: dict[int, str] = {}
    size = max([len(m.group(1)) // 2 for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>", b"".join(re.findall(rb"begincodespacerange(.*?)endcodespacerange", text, re.S)))], default=1)
    chars = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            codes[int(a, 16)] = chars(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block):
            low, high = int(a, 16), min(int(z, 16), int(a, 16) + 65535)
            if b[:1] == b"[":
                for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", b)):
                    codes[low + k] = chars(x)
            else:
                begin = int(b[1:-1], 16)
                for k in range(high - low + 1):
                    codes[low + k] = chr(begin + k) if begin + k < 0x110000 else "�"
    return codes, size


def placed_texts(doc: Document, page: bytes) -> list[tuple[float, float, float, str]]:
    """(x, y, width, text) of a page in table units, y from the top."""
    contents = _value(page, b"Contents")
    whole = doc.get(contents)
    listed = contents if contents and contents[:1] == b"[" else whole if whole and b"stream" not in whole else b""
    refs = [m.group() for m in _REF.finditer(listed)]
    streams = [doc.stream(doc.get(r) or b"") for r in refs] if refs else [doc.stream(whole)] if whole else []
    if any(x is None for x in streams):
        raise PdfError("a stream filter that is not supported")
    data = b"\n".join(streams)
    box = re.findall(rb"[+-]?[\d.]+", doc.inherited(page, b"MediaBox") or b"[0 0 612 792]")
    height = float(box[3]) if len(box) >= 4 else 792.0
    fonts = doc.fonts(page)
    out: list[tuple[float, float, float, str]] = []
    stack: list = []
    font, size, leading = None, 1.0, 0.0
    line = [0.0, 0.0]
    at = [0.0, 0.0]
    scale = 1.0

    def show(raw: bytes) -> None:
        if font:
            codes, n = font
            text = "".join(codes.get(int.from_bytes(raw[i : i + n], "big"), "") for i in range(0, len(raw), n))
        else:
            text = raw.decode("cp1252", "replace")
        wide = 0.5 * abs(size * scale) * len(text)
        if text:
            out.append((at[0] / UNIT, (height - at[1]) / UNIT, wide / UNIT, text))
        at[0] += wide

    pos, arrays = 0, []
    while pos < len(data):
        m = _TOKEN.match(data, pos)
        pos = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "string":
            value, pos = _string(data, pos)
        elif kind == "number":
            value = float(m.group())
        elif kind == "hex":
            h = re.sub(rb"[<>\s]", b"", m.group())
            value = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif kind == "open":
            arrays.append(stack)
            stack = []
            continue
        elif kind == "close":
            value, stack = stack, arrays.pop() if arrays else []
        elif kind == "op":
            op = m.group()
            n = [x for x in stack if isinstance(x, float)]
            if op == b"BT":
                line, at, scale = [0.0, 0.0], [0.0, 0.0], 1.0
            elif op == b"Tf" and n:
                font, size = fonts.get(next((x for x in stack if isinstance(x, bytes) and x[:1] == b"/"), b"")), n[-1]
            elif op == b"TL" and n:
                leading = n[-1]
            elif op in (b"Td", b"TD") and len(n) >= 2:
                line = [line[0] + n[-2] * scale, line[1] + n[-1] * scale]
                at = list(line)
                leading = -n[-1] if op == b"TD" else leading
            elif op == b"Tm" and len(n) >= 6:
                line, scale = [n[-2], n[-1]], n[-6] or 1.0
                at = list(line)
            elif op in (b"T*", b"'", b'"'):
                line = [line[0], line[1] - leading * scale]
                at = list(line)
            if op in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                show(stack[-1])
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                part = b""
                begin = list(at)
                for x in stack[-1]:
                    if isinstance(x, bytes):
                        part += x
                    elif isinstance(x, float) and x < -200 and part:  # a gap as wide as a blank
                        show(part)
                        at[0] -= x / 1000 * size * scale
                        part = b""
                if part:
                    show(part)
                at[1] = begin[1]
            stack = []
            continue
        else:
            value = m.group()
        stack.append(value)
    return out


def page_text(items: list[tuple[float, float, float, str]]) -> str:
    """Placed texts as lines from top to bottom; texts that touch are one word."""
    rows: list[tuple[float, list]] = []
    for x, y, w, t in sorted(items, key=lambda i: (i[1], i[0])):
        if rows and abs(y - rows[-1][0]) <= 0.3:
            rows[-1][1].append((x, w, t))
        else:
            rows.append((y, [(x, w, t)]))
    lines = []
    for _, row in rows:
        text, end = "", None
        for x, w, t in sorted(row):
            text += (" " if end is not None and x - end > 0.1 and not text.endswith(" ") and not t.startswith(" ") else "") + t
            end = x + w
        lines.append(text.rstrip())
    return "\n".join(lines)


def _read(files: DataFrame, schema: str, types: list[pa.DataType], rows) -> DataFrame:
    names = [f.strip().split(" ", 1)[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.extend((path, *r) for r in rows(data))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(len(types) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["relative_path", *names])

    picked = files.where(document_type(F.col("relative_path")) == "pdf").select("relative_path", "content")
    return picked.mapInArrow(run, f"relative_path string, {schema}")


def pdf_pages(files: DataFrame) -> DataFrame:
    """(relative_path, page_number, page_count, text, word_count, title, author, created_at, error) of the PDF files of a scan; a broken file gives one row with its error."""

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            doc = Document(data or b"")
            pages = doc.pages()
            told = (doc.info(b"Title"), doc.info(b"Author"), doc.info(b"CreationDate"))
            for k, p in enumerate(pages, 1):
                text = page_text(placed_texts(doc, p))
                yield (k, len(pages), text, len(text.split()), *told, None)
        except (PdfError, ValueError, IndexError, KeyError) as e:
            yield (None, None, None, None, None, None, None, str(e)[:200] or type(e).__name__)

    text = [pa.string()] * 3
    found = _read(files, "page_number int, page_count int, text string, word_count int, title string, author string, created string, error string", [pa.int32(), pa.int32(), pa.string(), pa.int32(), *text, pa.string()], rows)
    return found.withColumn("created_at", pdf_date(F.col("created"))).drop("created")


def pdf_tables(files: DataFrame) -> DataFrame:
    """(relative_path, page_number, table_index, row_index, cells, confidence) of the tables that the geometry of the pages shows.

    The confidence of a table is the share of its cells that are filled, with two decimals. Broken files give no rows.
    """

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            doc = Document(data or b"")
            for k, p in enumerate(doc.pages(), 1):
                for i, table in enumerate(detect_tables(placed_texts(doc, p))):
                    cells = [c for r in table for c in r]
                    sure = round(sum(map(bool, cells)) / max(1, len(cells)), 2)
                    yield from ((k, i, n, r, sure) for n, r in enumerate(table))
        except (PdfError, ValueError, IndexError, KeyError):
            return

    return _read(files, "page_number int, table_index int, row_index int, cells array<string>, confidence double", [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.float64()], rows)
