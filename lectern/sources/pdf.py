"""Text blocks of PDF files with the standard library alone: a decoder for books.pdf_blocks.

It reads the objects of the file (plain or in object streams), walks the page tree and follows the text
operators of each page's content. Lines are runs of one baseline, blocks are lines of one spacing. Fonts are
decoded by their ToUnicode maps, else as Windows Latin text. What it can't do: encrypted files (an error),
filters other than Flate and ASCIIHex (such streams are empty), and text that is a picture.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from ..plans.model import LecternError

_SPACE, _DELIMITER = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name; other strings are bytes."""


class Ref(int):
    """The number of another object."""


class Op(bytes):
    """An operator or keyword."""


class Stream:
    def __init__(self, head: dict, raw: bytes):
        self.head, self.raw = head, raw


class Reader:
    """Values one after the other from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            if self.data[self.at] in _SPACE:
                self.at += 1
            elif self.data[self.at] == 0x25:  # a comment goes to the end of its line
                ends = [e for e in (self.data.find(b"\n", self.at), self.data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(self.data))
            else:
                return

    def value(self):
        """The next value; None at the end or a closing bracket."""
        self.skip()
        here = self.data[self.at : self.at + 2]
        if not here or here[:1] in (b"]", b")", b"}", b"{") or here == b">>":
            return None
        if here == b"<<":
            self.at += 2
            return self.dictionary()
        if here[:1] == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if here[:1] == b"(":
            return self.literal()
        if here[:1] == b"[":
            self.at += 1
            return self.array()
        if here[:1] == b"/":
            m = _TOKEN.match(self.data, self.at + 1)
            self.at = m.end() if m else self.at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), m[0] if m else b"").decode("latin-1"))
        if here[:1] == b">":
            self.at += 1
            return self.value()
        m = _TOKEN.match(self.data, self.at)
        self.at = m.end()
        if re.fullmatch(rb"[+-]?\d+", m[0]):
            return int(m[0])
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", m[0]):
            return float(m[0])
        return {b"true": True, b"false": False}.get(m[0], Op(m[0]))

    def many(self, closing: bytes) -> list:
        """Values up to a closing bracket, references put together."""
        out: list = []
        while True:
            self.skip()
            if self.data.startswith(closing, self.at) or self.at >= len(self.data):
                self.at += len(closing)
                return out
            v = self.value()
            if v is None:
                self.at += 1
            elif v == b"R" and isinstance(v, Op) and len(out) > 1:
                out[-2:] = [Ref(out[-2])]
            else:
                out.append(v)

    def array(self) -> list:
        return [None if isinstance(v, Op) and v == b"null" else v for v in self.many(b"]")]

    def dictionary(self) -> dict:
        flat = self.many(b">>")
        return {str(k): v for k, v in zip(flat[::2], flat[1::2], strict=False) if isinstance(k, Name)}

    def literal(self) -> bytes:
        out, depth = bytearray(), 1
        self.at += 1
        while self.at < len(self.data) and depth:
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                c = self.data[self.at : self.at + 1]
                self.at += 1
                if c not in (b"\n", b"\r"):
                    out += _ESCAPES.get(c, c)
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
        return bytes(out)


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise LecternError("not a PDF file")
        self.data, self.places, self.known = data, {}, {}
        for m in _OBJECT.finditer(data):  # of a number's several places the last one counts, as in updated files
            self.places[int(m[1])] = m.end()
        for n in list(self.places):
            got = self.get(Ref(n))
            if isinstance(got, Stream) and got.head.get("Type") == "ObjStm":
                self._unpack(got)
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise LecternError("the PDF is encrypted")

    def _unpack(self, stream: Stream) -> None:
        body = self.content(stream)
        reader = Reader(body)
        numbers = [reader.value() for _ in range(2 * int(self.get(stream.head.get("N", 0))))]
        first = int(self.get(stream.head.get("First", 0)))
        for number, at in zip(numbers[::2], numbers[1::2], strict=True):
            if number not in self.places:
                self.known[number] = Reader(body, first + at).value()

    def get(self, value):
        """The value, or what a reference stands for."""
        while isinstance(value, Ref):
            if value not in self.known:
                self.known[int(value)] = None  # a circle ends here
                if value in self.places:
                    self.known[int(value)] = self._object(self.places[value])
            value = self.known[int(value)]
        return value

    def _object(self, at: int):
        reader = Reader(self.data, at)
        value = reader.value()
        reader.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", reader.at):
            start = reader.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            size = self.get(value.get("Length"))
            end = start + size if isinstance(size, int) and self.data[start + size : start + size + 20].lstrip().startswith(b"endstream") else self.data.find(b"endstream", start)
            return Stream(value, self.data[start : end if end >= 0 else len(self.data)])
        return value

    def content(self, stream: Stream) -> bytes:
        out, filters = stream.raw, self.get(stream.head.get("Filter")) or []
        for f in [filters] if isinstance(filters, Name) else filters:
            if f == "FlateDecode":
                inflate = zlib.decompressobj()
                try:
                    out = inflate.decompress(out)
                except zlib.error:
                    return b""
            elif f == "ASCIIHexDecode":
                out = Reader(b"<" + out).value()
            else:
                return b""
        return out

    def pages(self) -> Iterator[dict]:
        """The pages in order, with what they inherit."""
        root = next((v for v in map(self.get, map(Ref, [*self.places, *self.known])) if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        stack, seen = [(root.get("Pages"), {})] if root else [], set()
        while stack:
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            node = above | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, {key: node[key] for key in ("Resources", "MediaBox") if key in node}) for k in reversed(kids)]
            else:
                yield node


class Font:
    def __init__(self, doc: Document, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        cmap = doc.get(font.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self._read(doc.content(cmap))

    def _read(self, cmap: bytes) -> None:
        for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", cmap, re.DOTALL):
            values = Reader(body + b"]").array()
            step = 2 if kind == b"char" else 3
            for row in (values[k : k + step] for k in range(0, len(values) - step + 1, step)):
                low = int.from_bytes(row[0], "big")
                if step == 2:
                    self.map[low] = _utf16(row[1])
                elif isinstance(row[2], list):
                    self.map.update({low + k: _utf16(x) for k, x in enumerate(row[2])})
                else:
                    base = int.from_bytes(row[2][-2:], "big")
                    for k in range(min(0x10000, int.from_bytes(row[1], "big") - low + 1)):
                        self.map[low + k] = _utf16(row[2][:-2] + ((base + k) & 0xFFFF).to_bytes(2, "big"))

    def text(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.map.get(int.from_bytes(raw[k : k + 2], "big"), "") for k in range(0, len(raw), 2))
        plain = raw.decode("cp1252", "replace")
        return "".join(self.map.get(b, c) for b, c in zip(raw, plain, strict=True)) if self.map else plain


def _utf16(raw) -> str:
    return raw.decode("utf-16-be", "replace") if isinstance(raw, bytes) else ""


def _times(a: list[float], b: list[float]) -> list[float]:
    """The product of two matrices of six numbers."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def runs(doc: Document, page: dict) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of the page's text as it is drawn."""
    resources = doc.get(page.get("Resources")) or {}
    fonts = {k: Font(doc, doc.get(f) or {}) for k, f in (doc.get(resources.get("Font")) or {}).items()}
    parts = doc.get(page.get("Contents"))
    data = b"\n".join(doc.content(s) for s in map(doc.get, parts if isinstance(parts, list) else [parts]) if isinstance(s, Stream))
    reader, args, unit = Reader(data), [], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    here, line, outer, saved, font, size, lead = unit, unit, unit, [], Font(doc, {}), 1.0, 0.0

    def shown(pieces: list) -> tuple[float, float, float, str]:
        nonlocal here
        out, width = "", 0.0
        for p in pieces:
            if isinstance(p, bytes):
                text = font.text(p)
                out += text
                width += 0.5 * len(text)
            elif isinstance(p, (int, float)):
                out += " " if p < -180 and not out.endswith(" ") else ""
                width -= p / 1000
        at = _times(here, outer)
        here = _times([1, 0, 0, 1, width * size, 0], here)
        return at[4], at[5], abs(size * (at[3] or at[0])), out

    while reader.at < len(data):
        v = reader.value()
        if not isinstance(v, Op):
            if v is None:
                reader.at += 1
            else:
                args.append(v)
            continue
        match bytes(v):
            case b"q":
                saved.append(outer)
            case b"Q":
                outer = saved.pop() if saved else outer
            case b"cm" if len(args) >= 6:
                outer = _times(args[-6:], outer)
            case b"BT":
                here = line = unit
            case b"Tf" if len(args) >= 2:
                font, size = fonts.get(str(args[-2]), font), float(args[-1])
            case b"TL" if args:
                lead = float(args[-1])
            case b"Tm" if len(args) >= 6:
                here = line = [float(x) for x in args[-6:]]
            case (b"Td" | b"TD") if len(args) >= 2:
                lead = -float(args[-1]) if v == b"TD" else lead
                here = line = _times([1, 0, 0, 1, float(args[-2]), float(args[-1])], line)
            case b"T*":
                here = line = _times([1, 0, 0, 1, 0, -lead], line)
            case (b"Tj" | b"'" | b'"') if args:
                if v != b"Tj":
                    here = line = _times([1, 0, 0, 1, 0, -lead], line)
                yield shown(args[-1:])
            case b"TJ" if args and isinstance(args[-1], list):
                yield shown(args[-1])
            case b"BI":  # an image in the content
                end = re.compile(rb"\sEI\b").search(data, reader.at)
                reader.at = end.end() if end else len(data)
        args = []


def blocks(doc: Document, page: dict) -> list[tuple[float, float, str]]:
    """(y0, y1, text) from the top of the page, in the order drawn: a line ends where the baseline changes, a block where
    the step to the next line is none that a paragraph has."""
    box = [float(doc.get(x) or 0) for x in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]
    lines: list[list] = []  # x, y, size, text
    for x, y, size, text in runs(doc, page):
        if lines and abs(lines[-1][1] - y) < 0.3 * size:
            last = lines[-1]
            gap = x - last[4] > 0.2 * size and not last[3].endswith(" ") and not text.startswith(" ")
            last[3] += " " * gap + text
            last[4] = x + 0.5 * size * len(text)
        else:
            lines.append([x, y, size, text, x + 0.5 * size * len(text)])
    out: list[list] = []
    for _, y, size, text, _ in lines:
        if not text.strip():
            continue
        if out and 0 < out[-1][0] - y <= 1.6 * max(size, out[-1][1]) and abs(size - out[-1][1]) < 0.2 * size:
            out[-1][0], out[-1][3] = y, _joined(out[-1][3], text.strip())
        else:
            out.append([y, size, y + size, text.strip()])
    return [(max(0.0, box[3] - top), box[3] - y, "".join(_LIGATURES.get(c, c) for c in text)) for y, _, top, text in out]


def _joined(text: str, line: str) -> str:
    """The text and its next line; a hyphen at the end between two small letters was a word's."""
    if re.search(r"[a-zß-ÿ]-$", text) and line[:1].islower():
        return text[:-1] + line
    return f"{text}\n{line}"


_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def labels(doc: Document, count: int) -> list[str]:
    """The pages' printed labels; empty where the file gives none."""
    root = next((v for v in map(doc.get, map(Ref, [*doc.places, *doc.known])) if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
    nums = doc.get((doc.get(root.get("PageLabels")) or {}).get("Nums")) or []
    out = [""] * count
    for first, rule in zip(nums[::2], nums[1::2], strict=False):
        rule = doc.get(rule) or {}
        prefix = rule.get("P", b"").decode("latin-1") if isinstance(rule.get("P"), bytes) else ""
        for k in range(int(first), count):
            n = int(rule.get("St", 1)) + k - int(first)
            out[k] = prefix + {"D": str(n), "r": roman(n), "R": roman(n).upper()}.get(str(rule.get("S", "")), "")
    return out


def decode(content: bytes) -> list[dict]:
    """The text blocks of a file for books.pdf_blocks."""
    doc = Document(bytes(content))
    pages = list(doc.pages())
    names, rows = labels(doc, len(pages)), []
    for k, page in enumerate(pages):
        box = doc.get(page.get("MediaBox")) or [0, 0, 612, 792]
        for seq, (y0, y1, text) in enumerate(blocks(doc, page)):
            rows.append({"page": k, "label": names[k], "seq": seq, "y0": y0, "y1": y1, "page_height": float(doc.get(box[3]) or 0), "text": text})
    return rows
