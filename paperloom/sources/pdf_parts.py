"""Further relations of page files: annotations, outlines, destinations, attachments, images, paths, fonts, labels, signatures.

Each reads the same files as ``pdf`` and follows its rules: one file is one unit of work, and a file
that cannot be read gives no rows here.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pdf import File, Name, Ref, Stream, _multiply, _number, _relation, operators, text_of


def _root(f: File) -> dict:
    return f.get(f.trailer.get("Root")) or {}


def _tree(f: File, node, key: str, seen: set | None = None):
    """(key, value) pairs of a name or number tree; a node that contains itself is read once."""
    seen = set() if seen is None else seen
    todo = [node]
    while todo:
        node = f.get(todo.pop())
        if not isinstance(node, dict) or id(node) in seen:
            continue
        seen.add(id(node))
        items = f.get(node.get(key)) or []
        yield from zip(items[::2], items[1::2])
        todo += list(f.get(node.get("Kids")) or [])[::-1]


def _page_of(f: File) -> dict[int, int]:
    """Page numbers by the numbers of page objects."""
    f.pages()
    return f.page_numbers


def _target(f: File, pages: dict[int, int], dest) -> int | None:
    dest = f.get(dest)
    dest = f.get(dest.get("D")) if isinstance(dest, dict) else dest
    return pages.get(dest[0].number) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None


def _annotations(doc, data, password=""):
    f = File(data, password)
    for i, p in enumerate(f.pages(), 1):
        for k, a in enumerate(f.get(p.get("Annots")) or [], 1):
            a = f.get(a)
            if isinstance(a, dict):
                box = [_number(f.get(x)) for x in f.get(a.get("Rect")) or [0, 0, 0, 0]][:4]
                yield doc, i, k, str(f.get(a.get("Subtype")) or ""), text_of(f.get(a.get("Contents"))), text_of(f.get(a.get("T"))), text_of(f.get((f.get(a.get("A")) or {}).get("URI"))), *box


def _outlines(doc, data, password=""):
    f, ids = File(data, password), itertools.count(1)
    pages = _page_of(f)

    def walk(node, parent, depth, seen):
        node = f.get(node)
        while isinstance(node, dict) and id(node) not in seen:
            seen.add(id(node))
            own = next(ids)
            yield doc, own, parent, text_of(f.get(node.get("Title"))), depth, _target(f, pages, node.get("Dest") or (f.get(node.get("A")) or {}).get("D"))
            if "First" in node:
                yield from walk(node["First"], own, depth + 1, seen)
            node = f.get(node.get("Next"))

    yield from walk((f.get(_root(f).get("Outlines")) or {}).get("First"), None, 0, set())


def _destinations(doc, data, password=""):
    f = File(data, password)
    pages = _page_of(f)
    for name, dest in (f.get(_root(f).get("Dests")) or {}).items():
        yield doc, name, _target(f, pages, dest)
    for name, dest in _tree(f, (f.get(_root(f).get("Names")) or {}).get("Dests"), "Names"):
        yield doc, text_of(f.get(name)), _target(f, pages, dest)


def _attachments(doc, data, password=""):
    f = File(data, password)
    for name, spec in _tree(f, (f.get(_root(f).get("Names")) or {}).get("EmbeddedFiles"), "Names"):
        spec = f.get(spec) or {}
        body = f.get((f.get(spec.get("EF")) or {}).get("F"))
        yield doc, text_of(f.get(name)), text_of(f.get(spec.get("Desc"))), body.data(f) if isinstance(body, Stream) else None


def _scripts(doc, data, password=""):
    f = File(data, password)
    for name, action in _tree(f, (f.get(_root(f).get("Names")) or {}).get("JavaScript"), "Names"):
        code = f.get((f.get(action) or {}).get("JS"))
        yield doc, text_of(f.get(name)), text_of(code.data(f) if isinstance(code, Stream) else code)


def _fonts(doc, data, password=""):
    f, seen = File(data, password), set()
    for p in f.pages():
        for font in (f.get((f.get(p.get("Resources")) or {}).get("Font")) or {}).values():
            font = f.get(font) or {}
            low = f.get(font.get("FontDescriptor")) or {}
            seen.add((doc, str(f.get(font.get("BaseFont")) or ""), str(f.get(font.get("Subtype")) or ""), any(k in low for k in ("FontFile", "FontFile2", "FontFile3"))))
    yield from sorted(seen)


def _images(doc, data, password=""):
    f = File(data, password)
    for i, p in enumerate(f.pages(), 1):
        forms, k, ctm, saved = f.get((f.get(p.get("Resources")) or {}).get("XObject")) or {}, 0, (1.0, 0, 0, 1.0, 0, 0), []
        for op, args in operators(f.content(p)):
            if op == "q":
                saved.append(ctm)
            elif op == "Q" and saved:
                ctm = saved.pop()
            elif op == "cm" and len(args) >= 6:
                ctm = _multiply(tuple(map(_number, args[:6])), ctm)
            elif op == "Do" and args:
                x = f.get(forms.get(str(args[0])))
                if isinstance(x, Stream) and x.info.get("Subtype") == "Image":
                    k += 1
                    w, h = int(_number(f.get(x.info.get("Width")))), int(_number(f.get(x.info.get("Height"))))
                    wide, tall = (ctm[0] ** 2 + ctm[1] ** 2) ** 0.5, (ctm[2] ** 2 + ctm[3] ** 2) ** 0.5
                    yield doc, i, k, str(args[0]), w, h, *map(float, ctm), w / wide * 72 if wide else None, h / tall * 72 if tall else None


def _paths(doc, data, password=""):
    f = File(data, password)
    paint = {"S": "stroke", "s": "stroke", "f": "fill", "F": "fill", "f*": "fill", "B": "both", "B*": "both", "b": "both", "b*": "both", "n": "none"}
    for i, p in enumerate(f.pages(), 1):
        ctm, saved, points, k = (1.0, 0, 0, 1.0, 0, 0), [], [], 0
        for op, args in operators(f.content(p)):
            v = [_number(a) for a in args]
            at = lambda x, y, m=ctm: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
            if op == "q":
                saved.append(ctm)
            elif op == "Q" and saved:
                ctm = saved.pop()
            elif op == "cm" and len(v) >= 6:
                ctm = _multiply(tuple(v[:6]), ctm)
            elif op in ("m", "l", "c", "v", "y"):
                points += [at(*v[j : j + 2]) for j in range(0, len(v) - 1, 2)]
            elif op == "re" and len(v) >= 4:
                points += [at(v[0], v[1]), at(v[0] + v[2], v[1]), at(v[0] + v[2], v[1] + v[3]), at(v[0], v[1] + v[3])]
            elif op in paint:
                if points:
                    k += 1
                    xs, ys = [q[0] for q in points], [q[1] for q in points]
                    yield doc, i, k, paint[op], len(points), min(xs), min(ys), max(xs), max(ys)
                points = []


def _labels(doc, data, password=""):
    f = File(data, password)
    for start, x in _tree(f, _root(f).get("PageLabels"), "Nums"):
        x = f.get(x) or {}
        style = f.get(x.get("S"))
        yield doc, int(f.get(start)), str(style) if isinstance(style, Name) else None, text_of(f.get(x.get("P"))), int(f.get(x.get("St")) or 1)


def _signatures(doc, data, password=""):
    f = File(data, password)
    for n in f.numbers():
        x = f.get(Ref(n, 0))
        if isinstance(x, dict) and "ByteRange" in x and "Contents" in x:
            r = [int(_number(f.get(v))) for v in f.get(x["ByteRange"])]
            if len(r) >= 4:
                yield doc, n, r[0], r[-2] + r[-1], r[0] == 0 and r[-2] + r[-1] == len(data), text_of(f.get(x.get("Name")))


def _structure(doc, data, password=""):
    f, ids, seen = File(data, password), itertools.count(1), set()

    def walk(node, parent, level):
        node = f.get(node)
        for kid in node if isinstance(node, list) else [node]:
            kid = f.get(kid)
            if isinstance(kid, dict) and "S" in kid and id(kid) not in seen:
                seen.add(id(kid))
                own = next(ids)
                yield doc, own, parent, level, str(f.get(kid["S"])), text_of(f.get(kid.get("T"))), text_of(f.get(kid.get("Alt"))), text_of(f.get(kid.get("ActualText")))
                yield from walk(kid.get("K"), own, level + 1)

    yield from walk((f.get(_root(f).get("StructTreeRoot")) or {}).get("K"), None, 0)


def _layers(doc, data, password=""):
    f = File(data, password)
    groups = f.get(_root(f).get("OCProperties")) or {}
    off = {x.number for x in f.get((f.get(groups.get("D")) or {}).get("OFF")) or [] if isinstance(x, Ref)}
    for x in f.get(groups.get("OCGs")) or []:
        yield doc, text_of(f.get((f.get(x) or {}).get("Name"))), not (isinstance(x, Ref) and x.number in off)


def _xmp(doc, data, password=""):
    import re

    f = File(data, password)
    x = f.get(_root(f).get("Metadata"))
    text = x.data(f).decode("utf-8", "replace") if isinstance(x, Stream) else ""
    for name, value in re.findall(r"<([A-Za-z]+:[A-Za-z]+)>([^<]*)</\1>", text) + re.findall(r'\s((?!xmlns|rdf|xml:|x:)[A-Za-z]+:[A-Za-z]+)="([^"]*)"', text):
        if value.strip():
            yield doc, name, value.strip()
    for name, body in re.findall(r"(?s)<((?!rdf)[A-Za-z]+:[A-Za-z]+)>\s*<rdf:(?:Alt|Seq|Bag)>(.*?)</rdf:(?:Alt|Seq|Bag)>", text):
        for value in re.findall(r"<rdf:li[^>]*>([^<]*)</rdf:li>", body):
            yield doc, name, value.strip()


def _colours(doc, data, password=""):
    f = File(data, password)
    for i, p in enumerate(f.pages(), 1):
        kind = 0  # 1 black and white, 2 grey, 3 colour
        for op, args in operators(f.content(p)):
            v = [_number(a) for a in args]
            if op in ("g", "G") and v:
                kind = max(kind, 1 if v[0] in (0, 1) else 2)
            elif op in ("rg", "RG") and len(v) == 3:
                kind = max(kind, 3 if len(set(v)) > 1 else 1 if v[0] in (0, 1) else 2)
            elif op in ("k", "K") and len(v) == 4:
                kind = max(kind, 3 if any(v[:3]) else 1 if v[3] in (0, 1) else 2)
        yield doc, i, ("undefined", "black-and-white", "grayscale", "rgb")[kind]


_SCHEMAS = {
    "annotations": ("doc_id string, page_no int, seq int, type string, contents string, author string, uri string, llx double, lly double, urx double, ury double", _annotations),
    "outlines": ("doc_id string, id int, parent_id int, title string, level int, page_no int", _outlines),
    "destinations": ("doc_id string, name string, page_no int", _destinations),
    "attachments": ("doc_id string, name string, description string, content binary", _attachments),
    "scripts": ("doc_id string, name string, code string", _scripts),
    "fonts": ("doc_id string, font string, type string, embedded boolean", _fonts),
    "images": ("doc_id string, page_no int, seq int, name string, width int, height int, a double, b double, c double, d double, e double, f double, dpi_x double, dpi_y double", _images),
    "paths": ("doc_id string, page_no int, seq int, paint string, points int, llx double, lly double, urx double, ury double", _paths),
    "page_labels": ("doc string, start int, style string, prefix string, first int", _labels),
    "structure": ("doc_id string, id int, parent_id int, level int, type string, title string, alt string, actual string", _structure),
    "layers": ("doc_id string, name string, visible boolean", _layers),
    "xmp": ("doc_id string, name string, value string", _xmp),
    "colours": ("doc_id string, page_no int, colour string", _colours),
    "signatures": ("doc_id string, obj_num int, start long, end long, covers_file boolean, name string", _signatures),
}


def part(df: DataFrame, name: str, key: str = "path", content: str = "content", password: str = "") -> DataFrame:
    """One of the relations named above."""
    schema, rows = _SCHEMAS[name]
    return _relation(df, schema, rows, key, content, password)


def by_type(annotations: DataFrame, types: list[str], first: int = 1, last: int = 1 << 30) -> DataFrame:
    """Annotations of some types on a range of pages."""
    return annotations.where(F.col("type").isin(types) & F.col("page_no").between(first, last))


def rename_author(annotations: DataFrame, old: str, new: str) -> DataFrame:
    return annotations.withColumn("author", F.when(F.col("author") == old, new).otherwise(F.col("author")))
