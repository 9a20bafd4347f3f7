"""PDF files as tables: the text of each page and the outline's entries.

Files are listed and read by Spark (binaryFile), so any store will do, and each is parsed in the task that reads it. The
parser knows what text and bookmarks need: objects (also in object streams), Flate streams, the page tree, text
operators, and the fonts' maps to Unicode. It finds objects by their own marks instead of the cross-reference table,
which makes it read files whose table is damaged.

A file that is no PDF, is encrypted or is damaged beyond that gives no pages and an error text, and never fails the job; a
page without text gives an empty text. Text in fonts without a map to Unicode is taken as Windows-1252.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGES = "path string, page_index int, text string, error string"
OUTLINE = "path string, entry int, parent int, nth int, title string, page_index int"

_SPACE, _ENDS = b"\x00\t\n\x0c\r ", b"\x00\t\n\x0c\r ()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name object, or an operator's keyword (which has no slash)."""


class Ref(int):
    """A reference to an object's number."""


class Reader:
    """Objects of PDF syntax, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _blank(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 0x25:  # a comment
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next object; None at the end, and at what closes an array or dictionary."""
        self._blank()
        d = self.data
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if c == b"(":
            return self._string()
        if d.startswith(b"<<", self.at):
            self.at += 2
            items = self._until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, str)}
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1 if end >= 0 else len(d)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c == b"/":
            self.at += 1
            return Name("/" + re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._token()).decode("latin-1"))
        token = self._token()
        if not token:
            self.at += 1  # a bracket that closes nothing
            return self.value()
        if _NUMBER.match(token):
            ahead = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])").match(d, self.at) if token.isdigit() else None
            if ahead:
                self.at = ahead.end()
                return Ref(token)
            return float(token) if b"." in token else int(token)
        return {b"true": True, b"false": False}.get(token, Name(token.decode("latin-1")))

    def _token(self) -> bytes:
        start, d, n = self.at, self.data, len(self.data)
        while self.at < n and d[self.at] not in _ENDS:
            self.at += 1
        return d[start : self.at]

    def _until(self, close: bytes) -> list:
        out = []
        while True:
            self._blank()
            if self.at >= len(self.data):
                return out
            if self.data.startswith(close, self.at):
                self.at += len(close)
                return out
            out.append(self.value())

    def _string(self) -> bytes:
        d, out, depth, i = self.data, bytearray(), 1, self.at + 1
        while i < len(d):
            c = d[i : i + 1]
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(d, i + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                after = d[i + 1 : i + 2]
                if after in b"\r\n":
                    i += 3 if d[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(after, after)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
            i += 1
        self.at = i + 1
        return bytes(out)


class CodeMap(dict):
    """Codes as text; ranges are kept as they are, for they may be long."""

    def __init__(self, body: bytes):
        self.ranges: list[tuple[int, int, bytes | list]] = []
        for section, kind in re.findall(rb"beginbf(?:char|range)(.*?)endbf(char|range)", body, re.S):
            reader, items = Reader(section), []
            while (v := reader.value()) is not None:
                items.append(v)
            if kind == b"char":
                self.update((int.from_bytes(a, "big"), _wide(b)) for a, b in zip(items[::2], items[1::2]) if isinstance(b, bytes))
            else:
                self.ranges += [(int.from_bytes(low, "big"), int.from_bytes(high, "big"), to) for low, high, to in zip(items[::3], items[1::3], items[2::3])]

    def __missing__(self, code: int) -> str:
        self[code] = out = next((self._of(to, code - low) for low, high, to in self.ranges if low <= code <= high), "")
        return out

    @staticmethod
    def _of(to: bytes | list, k: int) -> str:
        if isinstance(to, list):
            return _wide(to[k]) if k < len(to) else ""
        return _wide((int.from_bytes(to, "big") + k).to_bytes(len(to), "big"))


def _wide(raw: bytes) -> str:
    return raw.decode("utf-16-be", "surrogatepass" if len(raw) == 2 else "replace")


class File:
    """The objects of a PDF file by number; of one number the last stands."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF")
        self.data, self.found, self.trailer, self.fonts = data, {}, {}, {}
        places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        packed = []
        for number, at in places.items():
            reader = Reader(data, at)
            value = reader.value()
            self.found[number] = (value, self._body(reader, value))
            kind = value.get("/Type") if isinstance(value, dict) else None
            if kind == "/ObjStm":
                packed.append(number)
            elif kind == "/XRef":
                self.trailer = value | self.trailer
        for number in packed:
            about, _ = self.found[number]
            body = self.stream(Ref(number))
            head, first = Reader(body), self.get(about.get("/First", 0))
            for k, at in [(head.value(), head.value()) for _ in range(self.get(about.get("/N", 0)))]:
                if isinstance(k, int) and isinstance(at, int) and k not in places:
                    self.found[k] = (Reader(body, first + at).value(), None)
        for m in re.finditer(rb"trailer", data):
            value = Reader(data, m.end()).value()
            self.trailer |= value if isinstance(value, dict) else {}
        if "/Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def _body(self, reader: Reader, value) -> bytes | None:
        if not isinstance(value, dict):
            return None
        m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(\r\n|\n|\r)").match(self.data, reader.at)
        if not m:
            return None
        size = value.get("/Length")
        if type(size) is int and self.data.startswith(b"endstream", m.end() + size + len(re.compile(rb"[\r\n ]*").match(self.data, m.end() + size)[0])):
            return self.data[m.end() : m.end() + size]
        end = self.data.find(b"endstream", m.end())
        return self.data[m.end() : end if end >= 0 else None]

    def get(self, value):
        for _ in range(50):
            if not isinstance(value, Ref):
                return value
            value = self.found.get(int(value), (None, None))[0]
        return None

    def stream(self, ref) -> bytes:
        about, body = self.found.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        if body is None:
            return b""
        filters = self.get(about.get("/Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) != "/FlateDecode":
                return b""
            body = zlib.decompressobj().decompress(body)  # a cut stream gives what it holds
        return body

    def pages(self) -> list[tuple[int | None, dict]]:
        """Object number and inherited dictionary of each page, in order; without a tree, pages as they stand in the file."""
        root = self.get(self.trailer.get("/Root")) or next((v for v, _ in self.found.values() if isinstance(v, dict) and v.get("/Type") == "/Catalog"), {})
        self.root = root
        out, seen = [], set()
        todo = [(root.get("/Pages"), {})]
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            node = {k: above[k] for k in ("/Resources",) if k in above} | node
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                todo += [(k, node) for k in reversed(kids)]
            else:
                out.append((int(ref) if isinstance(ref, Ref) else None, node))
        return out or [(n, v) for n, (v, _) in sorted(self.found.items()) if isinstance(v, dict) and v.get("/Type") == "/Page"]

    def text(self, page: dict) -> str:
        contents = page.get("/Contents")
        held = self.get(contents)
        parts = held if isinstance(held, list) else [contents]
        fonts = self.get((self.get(page.get("/Resources")) or {}).get("/Font")) or {}
        return _shown(b"\n".join(self.stream(p) for p in parts), {k: self._map(v) for k, v in fonts.items()})

    def _map(self, ref) -> tuple[int, CodeMap | None]:
        """Bytes of a code, and codes as text, of a font; made once for each."""
        if isinstance(ref, Ref) and ref in self.fonts:
            return self.fonts[ref]
        made = self._made_map(self.get(ref))
        if isinstance(ref, Ref):
            self.fonts[ref] = made
        return made

    def _made_map(self, font) -> tuple[int, CodeMap | None]:
        font = font if isinstance(font, dict) else {}
        body = self.stream(font["/ToUnicode"]) if isinstance(font.get("/ToUnicode"), Ref) else b""
        size = 2 if font.get("/Subtype") == "/Type0" else 1
        return size, CodeMap(body) if body else None

    def outline(self) -> list[tuple[int, int | None, int, str, int | None]]:
        """entry, parent, nth, title, page_index (from 1) of the bookmarks."""
        place = {n: k for k, (n, _) in enumerate(self.pages(), 1) if n is not None}
        out, seen = [], set()
        todo = [((self.get(self.root.get("/Outlines")) or {}).get("/First"), None, 0)]
        while todo:
            ref, parent, nth = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            seen.add(ref)
            action = self.get(node.get("/A"))
            goal = self.get(node.get("/Dest") or (action.get("/D") if isinstance(action, dict) else None))
            page = goal[0] if isinstance(goal, list) and goal else None
            title = node.get("/Title")
            out.append((len(out) + 1, parent, nth, _title(title if isinstance(title, bytes) else b""), place.get(int(page)) if isinstance(page, Ref) else None))
            todo += [(node.get("/Next"), parent, nth + 1), (node.get("/First"), len(out), 0)]
        return out


def _title(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")


def _shown(content: bytes, fonts: dict[str, tuple[int, CodeMap | None]]) -> str:
    """The text that a content stream shows; moves to another line and line operators end lines."""
    reader, held, out, font = Reader(content), [], [], (1, None)

    def show(raw) -> None:
        if isinstance(raw, bytes):
            size, codes = font
            if codes is not None:
                out.append("".join(codes[int.from_bytes(raw[i : i + size], "big")] for i in range(0, len(raw), size)))
            else:
                out.append(raw.decode("cp1252", "replace") if size == 1 else "")

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    height = None
    while (v := reader.value()) is not None:
        if not (isinstance(v, Name) and not v.startswith("/")):
            held.append(v)
            continue
        if v == "Tf" and len(held) > 1:
            font = fonts.get(held[-2], (1, None))
        elif v == "Tj":
            show(held[-1] if held else None)
        elif v in ("'", '"'):
            line()
            show(held[-1] if held else None)
        elif v == "TJ" and held and isinstance(held[-1], list):
            for x in held[-1]:
                show(x)
                if isinstance(x, (int, float)) and x < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif v == "T*":
            out.append("\n")
        elif v in ("Td", "TD") and len(held) > 1 and held[-1] != 0:
            line()
        elif v == "Tm" and len(held) > 5:
            if height is not None and held[-1] != height:
                line()
            height = held[-1]
        elif v == "ID":  # an image inside the stream
            end = re.compile(rb"[\r\n ]EI(?![A-Za-z0-9])").search(content, reader.at)
            reader.at = end.end() if end else len(content)
        held = []
    return "".join(out).strip("\n").encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves of a pair meet


def _parsed(files: DataFrame, schema: str, rows) -> DataFrame:
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = rows(path, content.as_py() or b"")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], names=arrow.names)

    return files.select("path", "content").mapInArrow(run, kind)


def pages_of(files: DataFrame) -> DataFrame:
    """path, page_index (from 1), text, error of files (path, content); a file that cannot be read is one row with its error."""

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            file = File(content)
            return [(path, k, file.text(page), None) for k, (_, page) in enumerate(file.pages(), 1)]
        except Exception as error:  # whatever a damaged file leads to is a property of that file
            return [(path, None, None, f"{type(error).__name__}: {error}"[:200])]

    return _parsed(files, PAGES, rows)


def outline_of(files: DataFrame) -> DataFrame:
    """path, entry, parent, nth, title, page_index of the bookmarks of files (path, content); unreadable files have none."""

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, *e) for e in File(content).outline()]
        except Exception:
            return []

    return _parsed(files, OUTLINE, rows)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the PDF files of a folder and those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(folder).select("path", "content")


def made_pdf(pages: list[str], bookmarks: list[tuple[str, int | None, int]] = ()) -> bytes:
    """A PDF file with these pages of text and bookmarks (title, place of the parent or None, page from 1): what tests and queries
    read back. Codes are UTF-16 units with a map to Unicode that says so."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    packed = lambda head, body: b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(z := zlib.compress(body)), z)
    n, m = len(pages), len(bookmarks)
    first_page, first_mark = 5, 5 + 2 * n
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines %d 0 R >>" % (first_mark + m),
        2: b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (first_page + 2 * k) for k in range(n))),
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>",
        4: packed(b"", cmap),
    }
    for k, text in enumerate(pages):
        lines = b" T* ".join(b"<%s> Tj" % x.encode("utf-16-be", "surrogatepass").hex().encode() for x in text.split("\n"))
        objects[first_page + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (first_page + 2 * k + 1)
        objects[first_page + 2 * k + 1] = packed(b"", b"BT /F1 10 Tf 12 TL 50 700 Td " + lines + b" ET")
    below: dict[int | None, list[int]] = {}
    for k, (_, parent, _) in enumerate(bookmarks):
        below.setdefault(parent, []).append(k)
    ref = lambda key, k: b"/%s %d 0 R " % (key, first_mark + k)
    for own in below.values():
        for place, k in enumerate(own):
            title, _, page = bookmarks[k]
            links = (ref(b"Next", own[place + 1]) if place + 1 < len(own) else b"") + (ref(b"First", below[k][0]) if k in below else b"")
            objects[first_mark + k] = b"<< /Title <FEFF%s> /Dest [%d 0 R /Fit] %s>>" % (title.encode("utf-16-be").hex().encode(), first_page + 2 * (page - 1), links)
    objects[first_mark + m] = b"<< /Type /Outlines %s>>" % (ref(b"First", below[None][0]) if None in below else b"")
    out, places = bytearray(b"%PDF-1.7\n"), []
    for number in sorted(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, objects[number])
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, start)
    return bytes(out)
