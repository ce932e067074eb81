"""Page files written anew, changed at their end, and encrypted; a file is one unit of work.

``save`` writes a set of objects with a classic table or with object and cross-reference streams;
``append`` adds a section of changed objects to a file as it is.  Encryption is that of the standard handler.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import batches, crypto

from .pdf import FILES, File, Name, Ref, Stream

#: Objects of one object stream.
PACKED = 100


@lru_cache(maxsize=4096)
def _name(x: str) -> bytes:
    plain = lambda b: 33 <= b < 127 and b not in b"#()<>[]{}/%"
    return b"/" + b"".join(bytes([b]) if plain(b) else b"#%02X" % b for b in x.encode())


def syntax(x, seal: Callable[[bytes], bytes] = lambda b: b) -> bytes:
    """A value as a file holds it; ``seal`` encrypts strings."""
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % (x.number, x.generation)
    if isinstance(x, Name):
        return _name(x)
    if isinstance(x, (int, float)):
        return (b"%d" % x) if x == int(x) else (b"%.6f" % x).rstrip(b"0")
    if isinstance(x, (bytes, str)):
        raw = x if isinstance(x, bytes) else x.encode("latin-1") if all(ord(c) < 256 for c in x) else x.encode("utf-16")
        return b"<" + seal(raw).hex().encode() + b">"
    if isinstance(x, dict):
        return b"<< " + b" ".join(_name(str(k)) + b" " + syntax(v, seal) for k, v in x.items()) + b" >>"
    if isinstance(x, (list, tuple)):
        return b"[" + b" ".join(syntax(v, seal) for v in x) + b"]"
    raise TypeError(type(x).__name__)


def _body(x, seal: Callable[[bytes], bytes] = lambda b: b) -> bytes:
    if not isinstance(x, Stream):
        return syntax(x, seal)
    raw = seal(x.raw)
    return syntax({**x.info, "Length": len(raw)}, seal) + b"\nstream\n" + raw + b"\nendstream"


class Lock:
    """Keys and entries of an encryption: rc4-40, rc4-128, aes-128 or aes-256."""

    def __init__(self, kind: str, user: str, owner: str = "", permissions: int = -4, file_id: bytes | None = None) -> None:
        self.kind, self.id = kind, file_id or os.urandom(16)
        u, o = user.encode("latin-1", "replace"), (owner or user).encode("latin-1", "replace")
        version, revision, size = {"rc4-40": (1, 2, 5), "rc4-128": (2, 3, 16), "aes-128": (4, 4, 16), "aes-256": (5, 6, 32)}[kind]
        e: dict = {"Filter": Name("Standard"), "V": version, "R": revision, "P": permissions, "Length": 8 * size}
        if version == 5:
            self.key, salts = os.urandom(32), [os.urandom(8) for _ in range(4)]
            e["U"] = crypto.hardened(u[:127], salts[0], b"", 6) + salts[0] + salts[1]
            e["UE"] = crypto.cbc_encrypt(crypto.hardened(u[:127], salts[1], b"", 6), self.key, bytes(16))
            e["O"] = crypto.hardened(o[:127], salts[2], e["U"], 6) + salts[2] + salts[3]
            e["OE"] = crypto.cbc_encrypt(crypto.hardened(o[:127], salts[3], e["U"], 6), self.key, bytes(16))
            tail = b"\xff\xff\xff\xffTadb" + os.urandom(4)
            e["Perms"] = crypto.aes_blocks(self.key, struct.pack("<i", permissions) + tail).tobytes()
        else:
            e["O"] = self._owner(o, u, revision, size)
            self.key = crypto.file_key(u, e["O"], permissions, self.id, revision, size)
            e["U"] = crypto.user_entry(self.key, self.id, revision).ljust(32, b"\0")
        if version >= 4:
            e |= {"CF": {"StdCF": {"CFM": Name("AESV2" if version == 4 else "AESV3"), "AuthEvent": Name("DocOpen"), "Length": size}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        self.entry = e

    @staticmethod
    def _owner(owner: bytes, user: bytes, revision: int, size: int) -> bytes:
        h = hashlib.md5((owner + crypto.PAD)[:32]).digest()
        for _ in range(50 if revision >= 3 else 0):
            h = hashlib.md5(h).digest()
        out = (user + crypto.PAD)[:32]
        for i in range(20 if revision >= 3 else 1):
            out = crypto.rc4(bytes(b ^ i for b in h[:size]), out)
        return out

    def seal(self, number: int) -> Callable[[bytes], bytes]:
        if self.kind == "aes-256":
            return lambda data: crypto.aes_seal(self.key, data, os.urandom(16))
        if self.kind == "aes-128":
            return lambda data: crypto.aes_seal(crypto.object_key(self.key, number, 0, b"sAlT"), data, os.urandom(16))
        return lambda data: crypto.rc4(crypto.object_key(self.key, number, 0), data)


def save(objects: dict[int, object], trailer: dict, packed: bool = False, lock: Lock | None = None, version: str = "1.7") -> bytes:
    """A file of numbered objects; packed uses object and cross-reference streams."""
    out, places, inside = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode()), {}, {}
    objects, trailer = dict(objects), {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}
    top = max(objects, default=0)
    locked = 0
    if lock:
        locked = top = top + 1
        objects[locked] = lock.entry
        trailer |= {"Encrypt": Ref(locked, 0), "ID": [lock.id, lock.id]}
    if packed:
        plain = sorted(n for n, x in objects.items() if not isinstance(x, Stream) and n != locked)
        for at in range(0, len(plain), PACKED):
            part = [(n, syntax(objects.pop(n))) for n in plain[at : at + PACKED]]
            top += 1
            heads, size = [], 0
            for i, (n, body) in enumerate(part):
                heads.append(b"%d %d" % (n, size))
                size += len(body) + 1
                inside[n] = top, i
            head = b" ".join(heads) + b"\n"
            objects[top] = Stream({"Type": Name("ObjStm"), "N": len(part), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b"\n".join(b for _, b in part)))
    for n in sorted(objects):
        places[n] = len(out)
        seal = lock.seal(n) if lock and n != locked else (lambda b: b)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, _body(objects[n], seal))
    start = len(out)
    if not packed:
        out += _table(places, True) + b"trailer\n%s\n" % syntax({"Size": top + 1, **trailer})
    else:
        top += 1
        places[top] = start
        rows = [(0, 0, 65535)] + [(1, places[n], 0) if n in places else (2, *inside[n]) if n in inside else (0, 0, 65535) for n in range(1, top + 1)]
        data = zlib.compress(b"".join(struct.pack(">BIH", *r) for r in rows))
        info = {"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode"), **trailer}
        out += b"%d 0 obj\n%s\nendobj\n" % (top, _body(Stream(info, data)))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def _table(places: dict[int, int], whole: bool) -> bytes:
    """A classic table: sections of neighbouring numbers."""
    out, numbers = [b"xref\n"], sorted(places)
    rows = {n: b"%010d 00000 n \n" % places[n] for n in numbers}
    if whole:
        rows = {n: b"0000000000 65535 f \n" for n in range(numbers[-1] + 1 if numbers else 1)} | rows
    numbers = sorted(rows)
    at = 0
    while at < len(numbers):
        end = at
        while end + 1 < len(numbers) and numbers[end + 1] == numbers[end] + 1:
            end += 1
        out.append(b"%d %d\n" % (numbers[at], end - at + 1) + b"".join(rows[n] for n in numbers[at : end + 1]))
        at = end + 1
    return b"".join(out)


def reached(f: File) -> dict[int, object]:
    """The objects that the trailer's root and information lead to, decrypted, by number."""
    out, todo = {}, [f.trailer.get("Root"), f.trailer.get("Info")]
    while todo:
        x = todo.pop()
        if isinstance(x, Ref):
            if x.number not in out:
                out[x.number] = f.get(x)
                todo.append(out[x.number])
        elif isinstance(x, Stream):
            todo.append(x.info)
        elif isinstance(x, (dict, list)):
            todo += x.values() if isinstance(x, dict) else x
    return out


def rewrite(data: bytes, password: str = "", packed: bool = False, lock: Lock | None = None, edit: Callable[[File, dict[int, object]], None] | None = None) -> bytes:
    """The file with the objects that are in use only; ``edit`` may change them."""
    f = File(data, password)
    objects = reached(f)
    if edit:
        edit(f, objects)
    return save(objects, f.trailer, packed, lock, f.version)


def append(data: bytes, changes: dict[int, object], root: dict | None = None) -> bytes:
    """The file as it is, and after it a section of changed or new objects; encrypted files raise."""
    f = File(data)
    if "Encrypt" in f.trailer:
        raise ValueError("an encrypted file is written anew instead")
    out, places = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for n in sorted(changes):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, _body(changes[n]))
    start = len(out)
    before = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    keep = {k: v for k, v in f.trailer.items() if k in ("Root", "Info", "ID")} | (root or {})
    size = max([*f.numbers(), *changes]) + 1
    return bytes(out + _table(places, False) + b"trailer\n%s\nstartxref\n%d\n%%%%EOF\n" % (syntax({"Size": size, **keep, "Prev": before}), start))


def _mapped(files: DataFrame, make: Callable[[bytes], bytes], key: str, content: str) -> DataFrame:
    """(key, content, error): each file made anew, or why it cannot be."""
    spark = files.sparkSession
    batches.bounded(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > FILES:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FILES)

    def run(parts):
        for b in parts:
            made, errors = [], []
            for x in b.column(content):
                try:
                    made.append(make(x.as_py() or b""))
                    errors.append(None)
                except Exception as e:  # told in the row
                    made.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=[key, content, "error"])

    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, `{content}` binary, error string"
    return files.select(F.col(key), F.col(content)).mapInArrow(run, schema)


def rewritten(files: DataFrame, packed: bool = False, encryption: str | None = None, new_password: str = "", owner: str = "", password: str = "", key: str = "path", content: str = "content") -> DataFrame:
    """(key, content, error): files written anew, packed or not, decrypted with a password and encrypted with another."""
    return _mapped(files, lambda data: rewrite(data, password, packed, Lock(encryption, new_password, owner) if encryption else None), key, content)


def with_info(files: DataFrame, info: dict[str, str], key: str = "path", content: str = "content") -> DataFrame:
    """(key, content, error): files with entries of document information set by a section at their end."""

    def make(data: bytes) -> bytes:
        f = File(data)
        old = f.get(f.trailer.get("Info"))
        at = f.trailer["Info"].number if isinstance(f.trailer.get("Info"), Ref) else max(f.numbers()) + 1
        return append(data, {at: {**(old if isinstance(old, dict) else {}), **info}}, {"Info": Ref(at, 0)})

    return _mapped(files, make, key, content)


def edited(files: DataFrame, edit: Callable[[File, dict[int, object]], None], packed: bool = False, password: str = "", key: str = "path", content: str = "content") -> DataFrame:
    """(key, content, error): files whose objects a function of the reader and the objects by number has changed."""
    return _mapped(files, lambda data: rewrite(data, password, packed, None, edit), key, content)

