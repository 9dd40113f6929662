"""Text of PDF files, page by page, where no PDF library is installed.

Objects are found through cross-reference tables and streams, also those in object streams, and by a scan for `n g obj` where
these are damaged. Text operators are followed with their matrices; what is shown is decoded by the font's ToUnicode map or
encoding and put into rows by its height on the page. Encrypted files are refused.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

_SPACE = b"\0\t\n\f\r "
_TOKEN = re.compile(rb"[\0\t\n\f\r ]+|%[^\r\n]*|(?P<open><<|\[)|(?P<close>>>|\])|(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<hex><[0-9A-Fa-f\0\t\n\f\r ]*>)|(?P<text>\()|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<other>.)", re.S)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: What reading a broken file may raise.
_BROKEN = (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, StopIteration, zlib.error)
#: Objects inside each other that are followed, at most: more is a loop.
DEEPEST = 64


class Name(str):
    pass


class Word(bytes):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    n: int


@dataclass
class Stream:
    head: dict
    raw: bytes


def _string(data: bytes, k: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while k < len(data):
        ch = data[k : k + 1]
        if ch == b"\\":
            k += 1
            if m := re.compile(rb"[0-7]{1,3}").match(data, k):
                out.append(int(m[0], 8) & 255)
                k = m.end()
                continue
            if m := re.compile(rb"\r\n|\r|\n").match(data, k):
                k = m.end()
                continue
            ch = data[k : k + 1]
            out += _ESCAPES.get(ch, ch)
        elif ch == b")" and depth == 1:
            return bytes(out), k + 1
        else:
            depth += (ch == b"(") - (ch == b")")
            out += ch
        k += 1
    return bytes(out), k


def values(data: bytes, k: int = 0, limit: int | None = None):
    """(value, where it ends) of what stands in data from k on: numbers, bytes, names, lists, dicts, references and words."""
    stack: list[tuple[list, bool]] = []
    limit = len(data) if limit is None else limit
    while k < limit:
        m = _TOKEN.match(data, k)
        if not m:
            return
        k, kind = m.end(), m.lastgroup
        if kind is None or kind == "other":
            continue
        if kind == "open":
            stack.append(([], m[0] == b"<<"))
            continue
        if kind == "close":
            if not stack:
                continue
            items, is_dict = stack.pop()
            value = {x: y for x, y in zip(items[::2], items[1::2]) if isinstance(x, str)} if is_dict else items
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[0][1:]).decode("latin-1"))
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", m[0])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "text":
            value, k = _string(data, k)
        elif _NUMBER.match(m[0]):
            value = float(m[0]) if b"." in m[0] else int(m[0])
        elif m[0] == b"R" and stack and len(stack[-1][0]) > 1 and isinstance(stack[-1][0][-2], int):
            items = stack[-1][0]
            items.pop()
            value = Ref(items.pop())
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(m[0], Word(m[0]))
        if stack:
            stack[-1][0].append(value)
        else:
            yield value, k


def _lzw(data: bytes) -> bytes:
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            code = held >> (bits - width) & (1 << width) - 1
            bits -= width
            if code == 256:
                table, width, last = [], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else last + last[:1]
            if last:
                table.append(last + entry[:1])
            out += entry
            last, width = entry, min(12, max(9, (len(table) + 259).bit_length()))
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for ch in data.split(b"~")[0]:
        if ch == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= ch <= 117:
            group.append(ch - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        full = group + [84] * (5 - len(group))
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _predicted(data: bytes, how: dict) -> bytes:
    """Undoes the PNG predictors."""
    if how.get("Predictor", 1) < 10:
        return data
    step = max(1, how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
    width = (how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) + 7) // 8
    out, above = bytearray(), bytes(width)
    for k in range(0, len(data), width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(len(row)):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if kind == 4:
                near = left + up - corner
                add = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + add) & 255
        out += row
        above = bytes(row).ljust(width, b"\0")
    return bytes(out)


class Document:
    """Objects of a PDF file by number."""

    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.trailer, self._kept = data, {}, {}, {}, {}
        try:
            self._references()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError
        except _BROKEN:
            self._scan()
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted PDF files are not supported")

    def _references(self) -> None:
        """Follows the cross-reference sections from the last one back."""
        at = int(re.findall(rb"startxref\s+(\d+)", self.data)[-1])
        seen: set[int] = set()
        todo = [at]
        while todo and (at := todo.pop(0)) not in seen:
            seen.add(at)
            if m := re.compile(rb"\s*xref\s*").match(self.data, at):
                k = m.end()
                while m := re.compile(rb"\s*(\d+)\s+(\d+)\s*\n?").match(self.data, k):
                    k, first = m.end(), int(m[1])
                    for i in range(int(m[2])):
                        e = re.compile(rb"\s*(\d{10})\s(\d{5})\s([nf])").match(self.data, k)
                        if e[3] == b"n":
                            self.places.setdefault(first + i, int(e[1]))
                        k = e.end()
                head = next(values(self.data, re.compile(rb"\s*trailer").match(self.data, k).end()))[0]
            else:
                stream = self._object_at(at)
                head = stream.head
                self._cross_stream(head, self.decoded(stream))
            self.trailer = head | self.trailer
            todo += [head[x] for x in ("XRefStm", "Prev") if isinstance(head.get(x), int)]

    def _cross_stream(self, head: dict, rows: bytes) -> None:
        w, index = head["W"], head.get("Index") or [0, head["Size"]]
        k = 0
        for first, count in zip(index[::2], index[1::2]):
            for n in range(first, first + count):
                fields = []
                for size in w:
                    fields.append(int.from_bytes(rows[k : k + size], "big"))
                    k += size
                kind = fields[0] if w[0] else 1
                if kind == 1 and n not in self.packed:
                    self.places.setdefault(n, fields[1])
                elif kind == 2 and n not in self.places:
                    self.packed.setdefault(n, (fields[1], fields[2]))

    def _scan(self) -> None:
        self.places, self.packed, self._kept = {int(m[1]): m.start() for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", self.data)}, {}, {}
        for m in re.finditer(rb"trailer", self.data):
            found = next(values(self.data, m.end()), ({}, 0))[0]
            self.trailer |= found if isinstance(found, dict) else {}
        for n in list(self.places):
            x = self.get(Ref(n))
            if isinstance(x, Stream) and x.head.get("Type") == "ObjStm":
                try:
                    self.packed |= {own: (n, i) for i, (own, _) in enumerate(self._directory(x))}
                except _BROKEN:
                    continue
            elif isinstance(x, Stream) and x.head.get("Type") == "XRef":
                self.trailer = x.head | self.trailer
            elif isinstance(x, dict) and x.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n))

    def _object_at(self, at: int):
        m = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj").match(self.data, at)
        if not m:
            raise ValueError(f"no object at {at}")
        value, end = next(values(self.data, m.end()), (None, 0))
        if isinstance(value, dict) and (s := re.compile(rb"[\0\t\n\f\r ]*stream(?:\r\n|\n|\r)?").match(self.data, end)):
            size = self.get(value.get("Length"))
            stop = s.end() + size if isinstance(size, int) else -1
            if stop < 0 or not re.compile(rb"\s*endstream").match(self.data, stop):
                stop = self.data.find(b"endstream", s.end())
                stop = len(self.data) if stop < 0 else stop
            return Stream(value, self.data[s.end() : stop])
        return value

    def _directory(self, stream: Stream) -> list[tuple[int, int]]:
        numbers = [v for v, _ in values(self.decoded(stream), 0, stream.head["First"])]
        return list(zip(numbers[::2], numbers[1::2]))

    def get(self, x, depth: int = 0):
        """x, or the object that it refers to; null where there is none."""
        while isinstance(x, Ref) and depth < DEEPEST:
            depth += 1
            if x.n not in self._kept:
                self._kept[x.n] = None
                if x.n in self.packed:
                    box, i = self.packed[x.n]
                    stream = self.get(Ref(box), depth)
                    if isinstance(stream, Stream):
                        places = self._directory(stream)
                        self._kept[x.n] = next(values(self.decoded(stream), stream.head["First"] + places[i][1]), (None, 0))[0]
                elif x.n in self.places:
                    self._kept[x.n] = self._object_at(self.places[x.n])
            x = self._kept[x.n]
        return x

    def decoded(self, stream: Stream) -> bytes:
        data, kinds, hows = stream.raw, self.get(stream.head.get("Filter")), self.get(stream.head.get("DecodeParms"))
        kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
        hows = hows if isinstance(hows, list) else [hows] * len(kinds)
        for kind, how in zip(map(self.get, kinds), [*hows, *[None] * len(kinds)]):
            how = {k: self.get(v) for k, v in (self.get(how) or {}).items()}
            if kind in ("FlateDecode", "Fl"):
                undo = zlib.decompressobj()
                data = _predicted(undo.decompress(data), how)
            elif kind in ("LZWDecode", "LZW"):
                data = _predicted(_lzw(data), how)
            elif kind in ("ASCII85Decode", "A85"):
                data = _ascii85(data.strip().removeprefix(b"<~"))
            elif kind in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise ValueError(f"unknown filter {kind}")
        return data

    def pages(self) -> list[dict]:
        """The page dictionaries in order, with the resources that they inherit."""
        out: list[dict] = []

        def walk(node, resources, seen: frozenset) -> None:
            ref, node = node, self.get(node)
            if not isinstance(node, dict) or ref in seen or len(seen) > DEEPEST:
                return
            resources = node.get("Resources", resources)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, resources, seen | {ref} if isinstance(ref, Ref) else seen)
            else:
                out.append(node | {"Resources": resources})

        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise ValueError("no page tree")
        walk(root.get("Pages"), {}, frozenset())
        return out


# Glyph names that aren't letters, or letters with an accent's name behind them.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2",
    "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}",
    "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "quotedblleft": "“", "quotedblright": "”", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi",
    "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "Euro": "€", "section": "§", "degree": "°", "copyright": "©",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}
_ENCODINGS = {"MacRomanEncoding": "mac_roman", "WinAnsiEncoding": "cp1252"}


def _glyph(name: str) -> str:
    name = name.split(".")[0]
    if name in _GLYPHS or len(name) == 1:
        return _GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    if name[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return ""


class Font:
    """How codes of a font become text: its ToUnicode map, or its encoding."""

    def __init__(self, doc: Document, font: dict):
        self.map, self.wide, self.sizes = {}, font.get("Subtype") == "Type0", set()
        if isinstance(to := doc.get(font.get("ToUnicode")), Stream):
            try:
                self._read(doc.decoded(to))
            except (ValueError, TypeError, zlib.error):
                self.map = {}
        encoding, differences = doc.get(font.get("Encoding")), []
        if isinstance(encoding, dict):
            encoding, differences = doc.get(encoding.get("BaseEncoding")), doc.get(encoding.get("Differences")) or []
        self.single = [bytes([i]).decode(_ENCODINGS.get(encoding, "cp1252"), "ignore") for i in range(256)]
        code = 0
        for x in map(doc.get, differences):
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if code < 256:
                    self.single[code] = _glyph(x)
                code += 1

    def _read(self, cmap: bytes) -> None:
        held: list = []
        for v, _ in values(cmap):
            if not isinstance(v, Word):
                held.append(v)
                continue
            if v == b"endcodespacerange":
                self.sizes |= {len(x) for x in held if isinstance(x, bytes)}
            elif v == b"endbfchar":
                self.map |= {x: y.decode("utf-16-be", "ignore") for x, y in zip(held[::2], held[1::2]) if isinstance(x, bytes) and isinstance(y, bytes)}
            elif v == b"endbfrange":
                for lo, hi, to in zip(held[::3], held[1::3], held[2::3]):
                    first, n = int.from_bytes(lo, "big"), len(lo)
                    for i in range(min(int.from_bytes(hi, "big") - first + 1, 65536)):
                        own = to[i] if isinstance(to, list) else (int.from_bytes(to, "big") + i).to_bytes(len(to), "big")
                        self.map[(first + i).to_bytes(n, "big")] = own.decode("utf-16-be", "ignore")
            held = []

    def text(self, data: bytes) -> str:
        if not self.wide and not self.map:
            return "".join(self.single[b] for b in data)
        sizes, out, k = sorted(self.sizes) or [2 if self.wide else 1], [], 0
        while k < len(data):
            size = next((n for n in sizes if data[k : k + n] in self.map), 2 if self.wide else 1)
            code = data[k : k + size]
            out.append(self.map.get(code, self.single[code[0]] if not self.wide else ""))
            k += size
        return "".join(out)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Of a thousandth of the font's size, from which a gap in a shown list is a space.
GAP = 180


def _shown(doc: Document, data: bytes, resources: dict, matrix: tuple = _ONE, depth: int = 0):
    """(x, y, text) of each text that a content stream shows."""
    fonts, forms = (doc.get((doc.get(resources) or {}).get(k)) or {} for k in ("Font", "XObject"))
    made: dict = {}
    state, saved, held, font, lead = matrix, [], [], None, 0.0
    text = line = _ONE
    for v, end in values(data):
        if not isinstance(v, Word):
            held.append(v)
            continue
        args, held = held, []
        op = v.decode("latin-1")
        if op == "ID":  # an image in the stream: its bytes are no operators
            rest = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(data, end)
            if rest:
                yield from _shown(doc, data[rest.end() :], resources, state, depth)
            return
        if op == "q":
            saved.append(state)
        elif op == "Q" and saved:
            state = saved.pop()
        elif op == "cm" and len(args) == 6:
            state = _times(tuple(args), state)
        elif op == "BT":
            text = line = _ONE
        elif op == "Tf" and args:
            name = args[0]
            if name not in made:
                found = doc.get(fonts.get(name))
                made[name] = Font(doc, found if isinstance(found, dict) else {})
            font = made[name]
        elif op == "TL" and args:
            lead = args[0]
        elif op in ("Td", "TD") and len(args) == 2:
            lead = -args[1] if op == "TD" else lead
            text = line = _times((1, 0, 0, 1, *args), line)
        elif op == "Tm" and len(args) == 6:
            text = line = tuple(args)
        elif op in ("T*", "'", '"'):
            text = line = _times((1, 0, 0, 1, 0, -lead), line)
        elif op == "Do" and args and depth < 8:
            form = doc.get(forms.get(args[0]))
            if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                own = doc.get(form.head.get("Matrix"))
                yield from _shown(doc, doc.decoded(form), form.head.get("Resources", resources), _times(tuple(own), state) if own else state, depth + 1)
        if op in ("Tj", "TJ", "'", '"') and args and font:
            parts = args[-1] if isinstance(args[-1], list) else [args[-1]]
            own = "".join(font.text(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -GAP else "" for x in parts)
            where = _times(text, state)
            yield where[4], where[5], own


def page_text(doc: Document, page: dict) -> str:
    """A page's rows from top to bottom, each ended by a newline; texts of a row from left to right, with a space between."""
    contents = doc.get(page.get("Contents"))
    streams = [doc.get(x) for x in contents] if isinstance(contents, list) else [contents]
    data = b"\n".join(doc.decoded(s) for s in streams if isinstance(s, Stream))
    rows: dict[int, list] = {}
    for n, (x, y, text) in enumerate(_shown(doc, data, page.get("Resources"))):
        if text := " ".join(text.split()):
            rows.setdefault(round(y), []).append((x, n, text))
    return "".join(" ".join(t for _, _, t in sorted(rows[y])) + "\n" for y in sorted(rows, reverse=True))


def text(data: bytes) -> str:
    """Pages joined by form feeds; a page that can't be read is empty. Raises ValueError for what isn't a readable PDF file."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF file")
    try:
        doc = Document(data)
        pages, out = doc.pages(), []
    except _BROKEN as e:
        raise ValueError(f"unreadable PDF file: {e}") from e
    for page in pages:
        try:
            out.append(page_text(doc, page))
        except _BROKEN:
            out.append("")
    return "\f".join(out)
