"""PDF files as relations: objects, pages, content operators, text runs, metadata.

One file is one unit of work, since its cross-references and content state are sequential; files are
spread over tasks.  A file that cannot be read gives a row of errors and no other; ``status`` tells for each
relation of a file how many rows it has and what stopped it.  Objects are read
from the cross-reference chain; where that is damaged the whole file is scanned for them.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import batches

from .codecs import decode as decode_stream

#: Bounds for untrusted files.
DEPTH, OPERATORS, PAGE_DEPTH = 10, 1_000_000, 400
#: Files of an Arrow batch, and rows that are sent on together.
FILES, ROWS = 64, 4096
_STOP = re.compile(rb"[\0\t\n\f\r ()<>\[\]{}/%]")
_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+([0-9]+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])")
_OCTAL, _MARK = re.compile(rb"[0-7]{1,3}"), re.compile(rb"[\\()]")
_ESCAPED = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
#: One entry of a classic table, and what a number can begin with.
_ENTRY, _NUMERIC = re.compile(rb"[\0\t\n\f\r ]*([0-9]+)[\0\t\n\f\r ]+([0-9]+)[\0\t\n\f\r ]+([nf])(?=[\0\t\n\f\r ])"), frozenset(b"0123456789+-.\x0b\x1c\x1d\x1e\x1f")


class Name(str):
    __slots__ = ()


class Op(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self, file: File | None = None) -> bytes:
        get = file.get if file else lambda x: x
        names, params = get(self.info.get("Filter")), get(self.info.get("DecodeParms"))
        names = [] if names is None else names if isinstance(names, list) else [names]
        params = [] if params is None else params if isinstance(params, list) else [params]
        return decode_stream(self.raw, [str(get(n)) for n in names], [{k: get(v) for k, v in (get(p) or {}).items()} for p in params])


@lru_cache(maxsize=4096)
def _name(w: bytes) -> Name:
    return Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), w) if b"#" in w else w).decode("latin-1"))


class Lexer:
    """Tokens and objects from bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        d, at = self.data, self.at
        if at < len(d) and (d[at] <= 32 or d[at] == 0x25):
            self.at = _BLANK.match(d, at).end()

    def word(self) -> bytes:
        m = _STOP.search(self.data, self.at)
        end = m.start() if m else len(self.data)
        out = self.data[self.at : end]
        self.at = end
        return out

    def object(self, depth: int = 0):
        """The next object; an Op for a bare word, None at the end (a null is Op('null'))."""
        self.skip()
        d, i = self.data, self.at
        if i >= len(d) or depth > 100:
            return None
        c = d[i : i + 1]
        if c == b"/":
            self.at += 1
            return _name(self.word())
        if c == b"(":
            return self.string()
        if c == b"<" and d[i : i + 2] == b"<<":
            self.at += 2
            out, key = {}, None
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>" or self.at >= len(d):
                    self.at += 2
                    return out
                if key is None and d[self.at] == 0x2F:
                    self.at += 1
                    key = str(_name(self.word()))
                    continue
                x = self.object(depth + 1)
                if x is None:
                    return out
                if key is None:
                    key = str(x) if isinstance(x, Name) else None
                elif isinstance(x, Op) and x == "R":
                    continue
                else:
                    out[key] = self.reference(x)
                    key = None
        if c == b"<":
            end = d.find(b">", i)
            end = len(d) if end < 0 else end
            self.at = end + 1
            text = re.sub(rb"[^0-9A-Fa-f]", b"", d[i + 1 : end])
            return bytes.fromhex((text + b"0" * (len(text) % 2)).decode())
        if c == b"[":
            self.at += 1
            items: list = []
            while True:
                self.skip()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                x = self.object(depth + 1)
                if x is None:
                    return items
                items.append(self.reference(x))
        if c in (b")", b">", b"]", b"{", b"}"):
            self.at += 1
            return Op(c.decode())
        w = self.word()
        if w and w[0] not in _NUMERIC:
            return {b"true": True, b"false": False}.get(w) if w in (b"true", b"false") else Op(w.decode("latin-1"))
        try:
            return int(w)
        except ValueError:
            pass
        if re.fullmatch(rb"[+-]*[0-9]*\.?[0-9]*", w) and re.search(rb"[0-9]", w):
            return float(re.sub(rb"^[+-]*(?=[+-])", b"", w))
        return {b"true": True, b"false": False}.get(w, Op(w.decode("latin-1")))

    def reference(self, x):
        """x, or the reference ``x g R`` that starts with it."""
        if type(x) is int:
            m = _REFERENCE.match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(x, int(m[1]))
        return None if isinstance(x, Op) and x == "null" else x

    def string(self) -> bytes:
        d, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(d):
            m = _MARK.search(d, i)
            end = m.start() if m else len(d)
            out += d[i:end]
            i = end
            if not m:
                break
            c = d[i]
            if c == 0x5C:
                i += 1
                e = d[i] if i < len(d) else 0
                octal = _OCTAL.match(d, i)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                if e in b"\r\n":
                    i += 2 if d[i : i + 2] == b"\r\n" else 1
                    continue
                out.append(_ESCAPED.get(e, e))
            elif c == 0x28:
                depth += 1
                out.append(c)
            else:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            i += 1
        self.at = i + 1
        return bytes(out)


def text_of(raw: bytes | None) -> str | None:
    """A text string: UTF-16 or UTF-8 with a mark, else Latin-1."""
    if raw is None or not isinstance(raw, bytes):
        return None if raw is None else str(raw)
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


class File:
    """Objects of one file, read on demand."""

    def __init__(self, data: bytes, password: str = "") -> None:
        head = data.find(b"%PDF-", 0, 4096)
        if head < 0:
            raise ValueError("no PDF header in the first 4096 bytes")
        self.data, self.version = data, data[head + 5 : head + 8].decode("latin-1")
        self.places: dict[int, tuple[int, int]] = {}
        self.inside: dict[int, tuple[int, int]] = {}
        self.cache: dict[int, object] = {}
        self.boxes: dict[int, tuple[Stream, bytes, int, list]] = {}
        self.failed = False
        self.trailer: dict = {}
        self.recovered, self.revisions = False, len(re.findall(rb"startxref", data))
        self.key: bytes | None = None
        try:
            self._chain()
            if "Encrypt" not in self.trailer and not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError("no catalog")
        except (ValueError, IndexError, KeyError, TypeError, RecursionError):
            self._scan()
        if "Encrypt" in self.trailer:
            self._unlock(password.encode("latin-1", "replace"))
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                self._scan()

    def _unlock(self, password: bytes) -> None:
        """Takes the key of the standard handler: RC4, AES-128 or AES-256, by crypt filters from version 4 on."""
        from paperloom.functions import crypto

        e = {k: self.get(v) for k, v in (self.get(self.trailer["Encrypt"]) or {}).items()}
        version, revision = e.get("V", 0), e.get("R", 2)
        if e.get("Filter") != "Standard" or version not in (1, 2, 4, 5):
            raise ValueError("this encryption is not supported")
        method = {"RC4": "RC4"}
        if version >= 4:
            filters = e.get("CF") or {}
            kind = lambda name: str(self.get((self.get(filters.get(str(name))) or {}).get("CFM")) or "Identity") if name != "Identity" else "Identity"
            method = {"Stream": kind(e.get("StmF", "Identity")), "String": kind(e.get("StrF", "Identity"))}
        self.method = {k: method.get(k, "RC4") for k in ("Stream", "String")}
        if version == 5:
            key = crypto.strong_key(password, e)
        else:
            first, whole = (self.get(self.trailer.get("ID")) or [b""])[0], e.get("EncryptMetadata") is not False
            size = 16 if version == 4 else e.get("Length", 40) // 8
            key = crypto.file_key(password, e.get("O", b""), e.get("P", 0), first, revision, size, whole)
            n = 32 if revision == 2 else 16
            key = key if crypto.user_entry(key, first, revision)[:n] == e.get("U", b"")[:n] else None
        if key is None:
            raise ValueError("the password does not fit")
        self.cache, self.key = {}, key
        self.locked = self.trailer["Encrypt"].number if isinstance(self.trailer["Encrypt"], Ref) else 0

    def _open(self, x, number: int, generation: int):
        """x with its strings and stream data decrypted."""
        from paperloom.functions import crypto

        def plain(data: bytes, kind: str) -> bytes:
            if kind == "AESV3":
                return crypto.aes_open(self.key, data)
            if kind == "AESV2":
                return crypto.aes_open(crypto.object_key(self.key, number, generation, b"sAlT"), data)
            return data if kind in ("Identity", "None") else crypto.rc4(crypto.object_key(self.key, number, generation), data)

        def walk(x):
            if isinstance(x, bytes):
                return plain(x, self.method["String"])
            if isinstance(x, Stream):
                return Stream({k: walk(v) for k, v in x.info.items()}, plain(x.raw, self.method["Stream"]))
            if isinstance(x, dict):
                return {k: walk(v) for k, v in x.items()}
            return [walk(v) for v in x] if isinstance(x, list) else x

        return walk(x)

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise ValueError("no startxref")
        todo, seen = [int(re.compile(rb"startxref\s+([0-9]+)").match(self.data, at)[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            lex = Lexer(self.data, at)
            lex.skip()
            if self.data[lex.at : lex.at + 4] == b"xref":
                lex.at += 4
                while True:
                    first = lex.object()
                    if isinstance(first, Op) or first is None:
                        break
                    for i in range(lex.object()):
                        m = _ENTRY.match(self.data, lex.at)
                        if m:
                            offset, generation, kind, lex.at = int(m[1]), int(m[2]), m[3].decode(), m.end()
                        else:
                            offset, generation, kind = lex.object(), lex.object(), lex.object()
                        if kind == "n":
                            self.places.setdefault(first + i, (offset, generation))
                info = lex.object()
            else:
                obj = self._at(at)[1]
                info = obj.info
                rows, w = obj.data(), info["W"]
                index = info.get("Index") or [0, info["Size"]]
                pos = 0
                for first, n in zip(index[::2], index[1::2]):
                    for i in range(first, first + n):
                        f = []
                        for k, size in enumerate(w):
                            f.append(int.from_bytes(rows[pos : pos + size], "big") if size else int(k == 0))
                            pos += size
                        if f[0] == 1 and i not in self.inside:
                            self.places.setdefault(i, (f[1], f[2]))
                        elif f[0] == 2 and i not in self.places:
                            self.inside.setdefault(i, (f[1], f[2]))
            if not isinstance(info, dict):
                raise ValueError("no trailer")
            self.trailer = {**info, **self.trailer}
            todo += [info[k] for k in ("XRefStm", "Prev") if isinstance(info.get(k), int)]

    def _scan(self) -> None:
        """Objects by their headers, the last of each number; containers are expanded."""
        self.recovered, self.places, self.inside, self.cache = True, {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])([0-9]{1,10})[ \t\r\n]+([0-9]{1,5})[ \t\r\n]+obj\b", self.data):
            self.places[int(m[1])] = (m.start(), int(m[2]))
        for m in re.finditer(rb"\btrailer\b", self.data):
            info = Lexer(self.data, m.end()).object()
            if isinstance(info, dict):
                self.trailer |= info
        for n in list(self.places):
            x = self.get(Ref(n, 0))
            info = x.info if isinstance(x, Stream) else x
            if isinstance(x, Stream) and info.get("Type") == "ObjStm":
                for i, inner in enumerate(self._numbers(x)):
                    self.inside.setdefault(inner, (n, i))
            elif isinstance(info, dict) and info.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n, 0))

    def _at(self, offset: int) -> tuple[int, object]:
        lex = Lexer(self.data, offset)
        number, _, word = lex.object(), lex.object(), lex.object()
        if word != "obj":
            raise ValueError("no object at its offset")
        value = lex.reference(lex.object())
        lex.skip()
        if isinstance(value, dict) and self.data[lex.at : lex.at + 6] == b"stream":
            start = lex.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            size = self.get(value.get("Length")) if value.get("Length") is not None else None
            if not isinstance(size, int) or b"endstream" not in self.data[start + size : start + size + 20]:
                end = self.data.find(b"endstream", start)
                size = (end if end >= 0 else len(self.data)) - start
            value = Stream(value, self.data[start : start + size])
        return number, value

    def _numbers(self, container: Stream) -> list[int]:
        lex = Lexer(container.data(self))
        return [[lex.object(), lex.object()][0] for _ in range(self.get(container.info.get("N")) or 0)]

    def get(self, x, depth: int = 0):
        """x with references followed; unknown ones are None."""
        while isinstance(x, Ref) and depth < 50:
            n, depth = x.number, depth + 1
            if n not in self.cache:
                self.cache[n] = None
                try:
                    if n in self.places:
                        number, value = self._at(self.places[n][0])
                        if number != n:
                            raise ValueError("another object stands there")
                        if self.key and n != self.locked and not (isinstance(value, Stream) and value.info.get("Type") == "XRef"):
                            value = self._open(value, n, self.places[n][1])
                        self.cache[n] = value
                    elif n in self.inside:
                        box, i = self.inside[n]
                        c = self.get(Ref(box, 0))
                        if self.boxes.get(box, (None,))[0] is not c:  # a container is read once
                            data = c.data(self)
                            first, count = self.get(c.info["First"]), self.get(c.info["N"])
                            head = data[:first].split()[: 2 * count]
                            if len(head) == 2 * count and all(map(bytes.isdigit, head)):
                                pairs = list(zip(map(int, head[::2]), map(int, head[1::2])))
                            else:
                                lex = Lexer(data)
                                pairs = [(lex.object(), lex.object()) for _ in range(count)]
                            self.boxes[box] = c, data, first, pairs
                        _, data, first, pairs = self.boxes[box]
                        inner = Lexer(data, first + pairs[i][1])
                        self.cache[n] = inner.reference(inner.object())
                except (ValueError, IndexError, KeyError, TypeError, AttributeError):
                    if not self.recovered:
                        self.failed = True
                        raise ValueError(f"object {n} cannot be read") from None
            x = self.cache[n]
        return None if isinstance(x, Ref) else x

    def numbers(self) -> list[int]:
        return sorted({*self.places, *self.inside})

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit; page_numbers has their numbers by object."""
        out, seen, self.page_numbers = [], set(), {}
        root = self.get(self.trailer.get("Root", {})).get("Pages")

        def walk(ref, above, depth):
            node = self.get(ref)
            name = ref.number if isinstance(ref, Ref) else id(node)
            if not isinstance(node, dict) or name in seen:
                return
            if depth > PAGE_DEPTH:
                raise ValueError("the page tree is too deep")
            seen.add(name)
            own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)
                self.page_numbers[name] = len(out)

        walk(root, {}, 0)
        return out

    def content(self, page: dict) -> bytes:
        """The page's streams, joined by line feeds before they are read."""
        c = self.get(page.get("Contents"))
        parts = c if isinstance(c, list) else [c]
        return b"\n".join(s.data(self) for s in map(self.get, parts) if isinstance(s, Stream))


def operators(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) of a content stream; inline images are one BI with their dictionary and data."""
    lex, stack, out = Lexer(data), [], []
    while len(out) < OPERATORS:
        x = lex.object()
        if x is None:
            break
        if not isinstance(x, Op):
            stack.append(x)
            continue
        if x == "BI":
            pairs = []
            while (y := lex.object()) is not None and y != "ID":
                pairs.append(y)
            m = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, lex.at + 1)
            end = m.start() if m else len(data)
            out.append(("BI", [dict(zip(map(str, pairs[::2]), pairs[1::2])), data[lex.at + 1 : end]]))
            lex.at = m.end() if m else len(data)
        elif x != "null":
            out.append((str(x), stack))
        stack = []
    return out


def _multiply(m, n):
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


def _cmap(data: bytes) -> tuple[dict[int, str], int]:
    """(code to text, bytes of a code) of a ToUnicode map."""
    out, width = {}, 1
    u = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for m in re.finditer(rb"begincodespacerange(.*?)endcodespacerange", data, re.S):
        for h in re.findall(rb"<([0-9A-Fa-f]+)>", m[1]):
            width = max(width, len(h) // 2)
    for m in re.finditer(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", m[1]):
            out[int(a, 16)] = u(b)
    for m in re.finditer(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", m[1], re.S):
            lo, hi = int(a, 16), min(int(b, 16), int(a, 16) + 65_535)
            if one:
                text = u(one)
                for i in range(lo, hi + 1):
                    out[i] = text[:-1] + chr(min(ord(text[-1]) + i - lo, 0x10FFFF)) if text else ""
            else:
                for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many)):
                    out[lo + i] = u(h)
    return out, width


#: Glyph names that differ from their characters (fixed values); single letters, uniXXXX and uXXXX names are read by rule.
GLYPHS = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "equal": "=", "question": "?", "at": "@", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "eacute": "é", "egrave": "è", "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "germandbls": "ß", "fi": "fi", "fl": "fl", "Euro": "€"}


def glyph(name: str) -> str:
    if name in GLYPHS:
        return GLYPHS[name]
    m = re.fullmatch(r"(?:uni|u)([0-9A-Fa-f]{4,6})", name)
    return chr(int(m[1], 16)) if m else name if len(name) == 1 else ""


@dataclass
class Font:
    name: str
    map: dict[int, str] = field(default_factory=dict)
    width: int = 1
    sizes: dict[int, float] = field(default_factory=dict)

    def decode(self, raw: bytes) -> tuple[str, float, int]:
        """(text, width in thousandths, spaces)."""
        if not self.sizes and (self.width == 1 or (self.width == 2 and len(raw) % 2 == 0)):  # all codes are equally wide
            if self.width == 2:
                return "".join([self.map.get(c, "") for c in struct.unpack(f">{len(raw) // 2}H", raw)]), 250.0 * len(raw), 0
            text = "".join([self.map.get(c) if c in self.map else chr(c) for c in raw]) if self.map else raw.decode("latin-1")
            return text, 500.0 * len(raw), raw.count(b" ")
        out, total, spaces = [], 0.0, 0
        for i in range(0, len(raw), self.width):
            code = int.from_bytes(raw[i : i + self.width], "big")
            out.append(self.map.get(code, chr(code) if self.width == 1 else ""))
            total += self.sizes.get(code, 500.0)
            spaces += self.width == 1 and code == 32
        return "".join(out), total, spaces


def _font(file: File, info: dict | None, key: str) -> Font:
    info = file.get(info) or {}
    font = Font(str(file.get(info.get("BaseFont")) or key))
    encoding = file.get(info.get("Encoding"))
    if isinstance(encoding, dict):
        code = 0
        for x in file.get(encoding.get("Differences")) or []:
            if isinstance(x, int):
                code = x
            else:
                font.map[code] = glyph(str(x))
                code += 1
    if info.get("Subtype") == "Type0":
        font.width = 2
    first = file.get(info.get("FirstChar")) or 0
    for i, w in enumerate(file.get(info.get("Widths")) or []):
        w = file.get(w)
        if isinstance(w, (int, float)):
            font.sizes[first + i] = float(w)
    to = file.get(info.get("ToUnicode"))
    if isinstance(to, Stream):
        more, width = _cmap(to.data(file))
        font.map |= more
        font.width = 2 if info.get("Subtype") == "Type0" else width
    return font


def runs(file: File, page: dict) -> list[dict]:
    """Text runs of a page in stream order: text, place, width, font and size; forms are entered to a depth of ten."""
    out: list[dict] = []

    def play(data: bytes, resources, ctm, depth: int) -> None:
        resources = file.get(resources) or {}
        fonts, forms, made = file.get(resources.get("Font")) or {}, file.get(resources.get("XObject")) or {}, {}
        saved, font, size, lead, char, word, scale, rise = [], None, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
        tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

        def show(items):
            nonlocal tm
            text, start, moved = [], tm, 0.0
            for x in items:
                if isinstance(x, bytes):
                    t, w, spaces = (font or Font("")).decode(x)
                    text.append(t)
                    step = (w / 1000 * size + char * max(len(x) // (font.width if font else 1), 0) + word * spaces) * scale
                    moved += step
                elif isinstance(x, (int, float)):
                    if x <= -200 and text and not text[-1].endswith(" "):
                        text.append(" ")
                    moved -= x / 1000 * size * scale
            tm = _multiply((1, 0, 0, 1, moved, 0), tm)
            m = _multiply(_multiply((1, 0, 0, 1, 0, rise), start), ctm)
            shown = "".join(text)
            if shown:
                grow = (m[0] ** 2 + m[1] ** 2) ** 0.5
                tall = (m[2] ** 2 + m[3] ** 2) ** 0.5
                out.append({"text": shown, "x": m[4], "y": m[5], "w": moved * grow, "font": font.name if font else "", "size": size * tall})

        def move(x, y):
            nonlocal tm, line
            line = tm = _multiply((1, 0, 0, 1, x, y), line)

        for op, args in operators(data):
            try:
                if op == "q":
                    saved.append((ctm, font, size, lead, char, word, scale, rise))
                elif op == "Q" and saved:
                    ctm, font, size, lead, char, word, scale, rise = saved.pop()
                elif op == "cm":
                    ctm = _multiply(tuple(map(float, args[:6])), ctm)
                elif op == "BT":
                    tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                elif op == "Tf":
                    key = str(args[0])
                    font = made.setdefault(key, _font(file, fonts.get(key), key))
                    size = float(args[1])
                elif op == "Tm":
                    tm = line = tuple(map(float, args[:6]))
                elif op in ("Td", "TD"):
                    lead = -float(args[1]) if op == "TD" else lead
                    move(float(args[0]), float(args[1]))
                elif op == "T*":
                    move(0.0, -lead)
                elif op == "TL":
                    lead = float(args[0])
                elif op == "Tc":
                    char = float(args[0])
                elif op == "Tw":
                    word = float(args[0])
                elif op == "Tz":
                    scale = float(args[0]) / 100
                elif op == "Ts":
                    rise = float(args[0])
                elif op == "Tj":
                    show(args[:1])
                elif op == "TJ":
                    show(args[0])
                elif op in ("'", '"'):
                    if op == '"':
                        word, char = float(args[0]), float(args[1])
                    move(0.0, -lead)
                    show(args[-1:])
                elif op == "Do" and depth < DEPTH:
                    form = file.get(forms.get(str(args[0])))
                    if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                        m = file.get(form.info.get("Matrix")) or (1, 0, 0, 1, 0, 0)
                        play(form.data(file), form.info.get("Resources", resources), _multiply(tuple(map(float, m)), ctm), depth + 1)
            except (IndexError, TypeError, ValueError):
                continue

    play(file.content(page), page.get("Resources"), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0)
    return out


# --- relations --------------------------------------------------------------------------------------

_FILES = "doc_id string, size long, version string, encrypted boolean, recovered boolean, revisions int, n_pages int, info map<string,string>, error string"
_PAGES = "doc_id string, page_no int, llx double, lly double, urx double, ury double, rotate int"
_OBJECTS = "doc_id string, obj_num int, kind string, type string, refs array<int>, sha256 string"
_OPS = "doc_id string, page_no int, seq int, op string, operands array<string>"
_RUNS = "doc_id string, page_no int, seq int, text string, x double, y double, w double, font string, size double"
_FIELDS = "doc_id string, name string, type string, value string"


def _number(x) -> float:
    return float(x) if isinstance(x, (int, float)) else 0.0


def _opened(data: bytes | File, password: str) -> File:
    return data if isinstance(data, File) else File(data, password)


def _file_rows(doc: str, data: bytes, password: str = ""):
    try:
        f = File(data, password)
        info = f.get(f.trailer.get("Info")) or {}
        names = {k: text_of(f.get(v)) for k, v in info.items()} if isinstance(info, dict) else {}
        yield doc, len(data), f.version, "Encrypt" in f.trailer, f.recovered, f.revisions, len(f.pages()), list(names.items()), None
    except Exception as e:  # a broken file is a row of errors
        yield doc, len(data), None, None, None, None, None, [], str(e)


def _page_rows(doc, data, password=""):
    f = _opened(data, password)
    for i, p in enumerate(f.pages(), 1):
        box = [_number(f.get(x)) for x in f.get(p.get("MediaBox")) or [0, 0, 612, 792]]
        yield doc, i, *box[:4], int(f.get(p.get("Rotate")) or 0) % 360


def _refs(x, out: set) -> set:
    if isinstance(x, Ref):
        out.add(x.number)
    elif isinstance(x, Stream):
        _refs(x.info, out)
    elif isinstance(x, (dict, list)):
        for y in x.values() if isinstance(x, dict) else x:
            _refs(y, out)
    return out


def _plain(x) -> str:
    """A stable text of a value, for hashing."""
    if isinstance(x, dict):
        return "<<" + " ".join(f"/{k} {_plain(v)}" for k, v in sorted(x.items()) if k not in ("Length", "Filter", "DecodeParms")) + ">>"
    return "[" + " ".join(map(_plain, x)) + "]" if isinstance(x, list) else repr(x)


def _object_rows(doc, data, password=""):
    f = _opened(data, password)
    for n in f.numbers():
        x = f.get(Ref(n, 0))
        info = x.info if isinstance(x, Stream) else x
        body = _plain(info).encode() + (b"\0" + x.data(f) if isinstance(x, Stream) else b"")
        kind = "stream" if isinstance(x, Stream) else type(x).__name__.lower()
        yield doc, n, {"nonetype": "null", "bytes": "string"}.get(kind, kind), str(f.get(info.get("Type")) or "") if isinstance(info, dict) else "", sorted(_refs(x, set())), hashlib.sha256(body).hexdigest()


def _op_rows(doc, data, password=""):
    f = _opened(data, password)
    for i, p in enumerate(f.pages(), 1):
        for seq, (op, args) in enumerate(operators(f.content(p)), 1):
            yield doc, i, seq, op, [a.decode("latin-1") if isinstance(a, bytes) else str(a) for a in args]


def _run_rows(doc, data, password=""):
    f = _opened(data, password)
    for i, p in enumerate(f.pages(), 1):
        for seq, r in enumerate(runs(f, p), 1):
            yield doc, i, seq, r["text"], r["x"], r["y"], r["w"], r["font"], r["size"]


def _field_rows(doc, data, password=""):
    f = _opened(data, password)
    form = f.get((f.get(f.trailer.get("Root")) or {}).get("AcroForm")) or {}

    def walk(x, above, kind, value, depth):
        x = f.get(x)
        if not isinstance(x, dict) or depth > 50:
            return
        own = text_of(f.get(x.get("T")))
        name = ".".join(n for n in (above, own) if n)
        kind, value = str(f.get(x.get("FT")) or kind or ""), f.get(x.get("V")) if "V" in x else value
        kids = [k for k in f.get(x.get("Kids")) or [] if isinstance(f.get(k), dict) and "T" in f.get(k)]
        if kids:
            for k in kids:
                yield from walk(k, name, kind, value, depth + 1)
        else:
            yield doc, name, kind, text_of(value)

    for x in f.get(form.get("Fields")) or []:
        yield from walk(x, "", "", None, 0)


def _relation(files: DataFrame, schema: str, rows, key: str, content: str, password: str = "") -> DataFrame:
    """The rows that a function finds in each file, up to a damage; ``status`` tells where one is."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = files.sparkSession
    batches.bounded(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > FILES:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FILES)
    out = files.select(F.col(key).cast("string").alias("doc_id"), F.col(content).alias("content"))
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*found), arrow)], schema=arrow)

    def run(parts):
        for b in parts:
            found = []
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("content")):
                try:
                    for row in rows(doc, data.as_py() or b"", password):
                        found.append(row)
                        if len(found) >= ROWS:
                            yield table(found)
                            found = []
                except Exception:  # status has the error
                    continue
            if found:
                yield table(found)

    return out.mapInArrow(run, schema)


def files(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    """A row for each file: version, encryption, recovery, pages, information; ``error`` where it cannot be read."""
    return _relation(df, _FILES, _file_rows, key, content, password)


def pages(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    return _relation(df, _PAGES, _page_rows, key, content, password)


def objects(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    """Objects with what they refer to and a hash of decoded content and dictionary."""
    return _relation(df, _OBJECTS, _object_rows, key, content, password)


def content_ops(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    return _relation(df, _OPS, _op_rows, key, content, password)


def text_runs(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    return _relation(df, _RUNS, _run_rows, key, content, password)


def form_fields(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    return _relation(df, _FIELDS, _field_rows, key, content, password)


_READERS = {"pages": _page_rows, "objects": _object_rows, "content_ops": _op_rows, "text_runs": _run_rows, "form_fields": _field_rows}


def _status_rows(doc, data, password=""):
    f = None
    for name, rows in _READERS.items():
        n, error = 0, None
        try:
            if f is None or f.failed:  # what could not be read counts for each relation
                f = File(data, password)
            for _ in rows(doc, f, password):
                n += 1
        except Exception as e:  # told in the row
            error = str(e) or type(e).__name__
        yield doc, name, n, error


def status(df: DataFrame, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    """(doc_id, relation, n_rows, error): for each file and relation the rows that it gives, and why it gives no more."""
    return _relation(df, "doc_id string, relation string, n_rows long, error string", _status_rows, key, content, password)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below a path that have a PDF header; the header test reads no whole file twice."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.where(F.instr(F.substring(F.col("content"), 1, 4096).cast("string"), "%PDF-") > 0).select("path", "content")


def raw_text(rows: DataFrame, separator: str = "") -> DataFrame:
    """(doc_id, page_no, text): runs in stream order; a space as separator gives flowing text."""
    return rows.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), separator).alias("text"))


def document_text(pages_: DataFrame) -> DataFrame:
    """(doc_id, text): page texts joined by line ends, without empty pages at the end."""
    rows = pages_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("r"))
    return rows.select("doc_id", F.regexp_replace(F.array_join(F.transform("r", lambda x: x["text"]), "\r\n"), r"(\r\n)+$", "").alias("text"))


def page_text(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): runs as lines from the top, left to right; runs within a row's tolerance are one line.

    The tolerance is min(max(2, 1 % of the height), half the size); a gap of more than a fifth of the size is a space.
    """
    from pyspark.sql import Window as W

    page = W.partitionBy("doc_id", "page_no").orderBy(F.desc("y"), "x", "seq")
    limit = F.least(F.greatest(F.lit(2.0), F.abs("y") * 0.01), F.col("size") / 2)
    line = F.sum(F.when(F.lag("y").over(page) - F.col("y") > limit, 1).otherwise(0)).over(page.rowsBetween(W.unboundedPreceding, 0))
    row = W.partitionBy("doc_id", "page_no", "line").orderBy("x", "seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(row)
    spaced = rows.withColumn("line", line).withColumn("text", F.when(gap > F.col("size") * 0.2, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    lines = spaced.groupBy("doc_id", "page_no", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda r: r["text"]), "").alias("t"))
    return lines.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda r: r["t"]), "\r\n").alias("text"))


def grid_text(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): runs on a grid of characters, as they stand on the page.

    A column is as wide as a page's characters are in the mean; a run begins in the column of its left edge, counted
    from the leftmost, but not within the run before it.  Lines are those of ``page_text``, without empty ones between.
    """
    from pyspark.sql import Window as W

    whole, page = W.partitionBy("doc_id", "page_no"), W.partitionBy("doc_id", "page_no").orderBy(F.desc("y"), "x", "seq")
    shown = rows.where("length(text) > 0")
    sized = shown.withColumn("_wide", F.greatest(F.sum("w").over(whole) / F.sum(F.length("text")).over(whole), F.lit(0.1))).withColumn("_left", F.min("x").over(whole))
    limit = F.least(F.greatest(F.lit(2.0), F.abs("y") * 0.01), F.col("size") / 2)
    line = F.sum(F.when(F.lag("y").over(page) - F.col("y") > limit, 1).otherwise(0)).over(page.rowsBetween(W.unboundedPreceding, 0))
    at = F.round((F.col("x") - F.col("_left")) / F.col("_wide")).cast("int")
    lines = sized.withColumn("line", line).groupBy("doc_id", "page_no", "line").agg(F.array_sort(F.collect_list(F.struct("x", "seq", at.alias("at"), "text"))).alias("r"))
    grown = F.aggregate("r", F.lit(""), lambda t, r: F.concat(t, F.repeat(F.lit(" "), F.greatest(r["at"] - F.length(t), F.when(F.length(t) > 0, 1).otherwise(0))), r["text"]))
    return lines.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", grown.alias("t")))), lambda r: r["t"]), "\r\n").alias("text"))


# --- writing ----------------------------------------------------------------------------------------


def build(page_texts: list[list[tuple[float, float, float, str]]], compress: bool = True, info: dict[str, str] | None = None, fields: dict[str, str] | None = None, boxes: list[tuple[float, float, int]] | None = None) -> bytes:
    """A file of pages of (x, y, size, text) in one standard font: for sinks and tests.  boxes: width, height and turn of each page."""
    import zlib

    esc = lambda t: t.encode("latin-1", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
    bodies: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids, form = [], b""
    for runs_, (wide, high, turn) in zip(page_texts, boxes or [(612, 792, 0)] * len(page_texts)):
        data = b"".join(b"BT /F1 %g Tf %g %g Td (%s) Tj ET\n" % (size, x, y, esc(t)) for x, y, size, t in runs_)
        extra = b""
        if compress:
            data, extra = zlib.compress(data), b" /Filter /FlateDecode"
        bodies.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), extra, data))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Rotate %d /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (wide, high, turn, len(bodies)))
        kids.append(len(bodies))
    if fields:
        refs = []
        for name, value in fields.items():
            bodies.append(b"<< /FT /Tx /T (%s) /V (%s) >>" % (esc(name), esc(value)))
            refs.append(b"%d 0 R" % len(bodies))
        form = b" /AcroForm << /Fields [" + b" ".join(refs) + b"] >>"
    bodies[0] = b"<< /Type /Catalog /Pages 2 0 R%s >>" % form
    bodies[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    tail = b""
    if info:
        bodies.append(b"<< %s >>" % b" ".join(b"/%s (%s)" % (k.encode(), esc(v)) for k, v in info.items()))
        tail = b" /Info %d 0 R" % len(bodies)
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, tail, start)
    return bytes(out)


def write_pages(df: DataFrame, doc: str = "doc", page: str = "page_no", column: str = "text") -> DataFrame:
    """(doc, content): a file for each document, its pages' lines from the top in size 12; a document is one row's work.

    Columns width, height and rotate of df, where it has them, are those of the pages.
    """
    box = [F.coalesce(F.col(c).cast(t), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c) for c, t, d in (("width", "double", 612.0), ("height", "double", 792.0), ("rotate", "int", 0))]
    rows = df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(column), F.lit("")).alias("t"), *box))).alias("r"))
    schema = f"{doc} {df.schema[doc].dataType.simpleString()}, content binary"
    batches.bounded(df.sparkSession)

    def run(parts):
        for b in parts:
            made = [build([[(72.0, r["height"] - 72.0 - 14.4 * i, 12.0, line) for i, line in enumerate(r["t"].splitlines())] for r in pages_], boxes=[(r["width"], r["height"], r["rotate"]) for r in pages_]) for pages_ in b.column("r").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(doc), pa.array(made, pa.binary())], names=[doc, "content"])

    return rows.mapInArrow(run, schema)
