"""Digests and ciphers: built-in functions where the engine has them, Arrow batches for the rest."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = s[i]
        j = (j + x + k) & 255
        s[i] = s[j]
        s[j] = x
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        y = s[i] = s[j]
        s[j] = x
        out[n] = b ^ s[(x + y) & 255]
    return bytes(out)


def digest(value: Column, name: str) -> Column:
    """Lower-case hex of a digest: md5, sha1, sha224..sha512 by the engine, others (sha3_256 …) by Arrow batches; null stays null."""
    if name == "md5":
        return F.md5(value)
    if name == "sha1":
        return F.sha1(value)
    if name in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(value, int(name[3:]))

    def hashed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else hashlib.new(name, v.encode() if isinstance(v, str) else v).hexdigest())

    return F.pandas_udf(hashed, "string")(value)


def rc4_column(value: Column, key: bytes) -> Column:
    return F.pandas_udf(lambda x: x.map(lambda v: None if v is None else rc4(key, v)), "binary")(value)


#: The padding of passwords (fixed value).
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, size: int, metadata: bool = True) -> bytes:
    """The key of a file under the standard handler, revisions 2 to 4, for a user password."""
    h = hashlib.md5((password + PAD)[:32] + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    n = 5 if revision == 2 else size
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:n]).digest()
    return h[:n]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """What the file stores to test a key; its first 16 bytes count from revision 3 on."""
    if revision == 2:
        return rc4(key, PAD)
    out = rc4(key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def object_key(key: bytes, number: int, generation: int, salt: bytes = b"") -> bytes:
    """The key of one object; AES adds a salt."""
    return hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + salt).digest()[: min(len(key) + 5, 16)]


# --- AES, by its definition over the field of 256 elements ------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(substitution, its inverse, products): tables made from the field's rule, x**8 = x**4 + x**3 + x + 1."""
    power, log, x = np.zeros(256, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= x << 1  # times 3
        x ^= 0x11B if x & 0x100 else 0
    inverse = np.array([0] + [int(power[(255 - log[v]) % 255]) for v in range(1, 256)])
    turned = [inverse << k | inverse >> (8 - k) for k in range(5)]
    box = ((turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4]) & 255 ^ 0x63).astype(np.uint8)
    back = np.empty(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    a, b = np.meshgrid(np.arange(16), np.arange(256), indexing="ij")
    times = np.where((a > 0) & (b > 0), power[(log[a] + log[b]) % 255], 0).astype(np.uint8)
    return box, back, times


def _round_keys(key: bytes) -> np.ndarray:
    box, n = _word_tables()[4], len(key) // 4
    words, factor = list(struct.unpack(f">{n}I", key)), 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = (box[w >> 16 & 255] ^ factor) << 24 | box[w >> 8 & 255] << 16 | box[w & 255] << 8 | box[w >> 24]
            factor = factor << 1 ^ (0x11B if factor & 0x80 else 0)
        elif n > 6 and len(words) % n == 4:
            w = box[w >> 24] << 24 | box[w >> 16 & 255] << 16 | box[w >> 8 & 255] << 8 | box[w & 255]
        words.append(words[-n] ^ w)
    return np.frombuffer(struct.pack(f">{len(words)}I", *words), np.uint8).reshape(-1, 16)


#: Where a block's bytes go when its rows turn, as places in column order.
_TURN = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])
_TURN_BACK = np.argsort(_TURN)
#: The bytes of each column turned by none to three places.
_NEXT = [np.array([4 * (i // 4) + (i + k) % 4 for i in range(16)]) for k in range(4)]
#: Factors of a column's four bytes (fixed values), for one way and the other.
_MIX, _MIX_BACK = (2, 3, 1, 1), (14, 11, 13, 9)


def _columns(state: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    times = _tables()[2]
    a, b, c, d = (times[f][state[:, turn]] for f, turn in zip(factors, _NEXT))
    return a ^ b ^ c ^ d


def aes_blocks(key: bytes, data: bytes, decrypt: bool = False) -> np.ndarray:
    """Blocks of 16 bytes, each for itself."""
    box, back, _ = _tables()
    keys, state = _round_keys(key), np.frombuffer(data, np.uint8).reshape(-1, 16)
    if decrypt:
        state = state ^ keys[-1]
        for k in keys[-2:0:-1]:
            state = _columns(back[state[:, _TURN_BACK]] ^ k, _MIX_BACK)
        return back[state[:, _TURN_BACK]] ^ keys[0]
    state = state ^ keys[0]
    for k in keys[1:-1]:
        state = _columns(box[state][:, _TURN], _MIX) ^ k
    return box[state][:, _TURN] ^ keys[-1]


def cbc_decrypt(key: bytes, data: bytes, start: bytes) -> bytes:
    """Whole blocks in cipher-block chaining; all are worked on at once."""
    data = data[: len(data) // 16 * 16]
    before = np.frombuffer(start + data[:-16], np.uint8).reshape(-1, 16) if data else np.empty((0, 16), np.uint8)
    return (aes_blocks(key, data, True) ^ before).tobytes() if data else b""


@lru_cache(maxsize=1)
def _word_tables() -> tuple[list[int], ...]:
    """For each place of a byte in a column, the column that its substitute contributes, and the substitutes."""
    box, _, times = _tables()
    column = [int.from_bytes(bytes(int(times[f][v]) for f in (2, 1, 1, 3)), "big") for v in box.tolist()]
    turn = lambda w, k: w >> 8 * k | w << 32 - 8 * k & 0xFFFFFFFF
    return *([turn(w, k) for w in column] for k in range(4)), box.tolist()


def cbc_encrypt(key: bytes, data: bytes, start: bytes) -> bytes:
    """Whole blocks in cipher-block chaining, one after the other, on words of four bytes."""
    t0, t1, t2, t3, box = _word_tables()
    keys = [struct.unpack(">4I", k.tobytes()) for k in _round_keys(key)]
    inner, (z0, z1, z2, z3) = keys[1:-1], keys[-1]
    a, b, c, d = struct.unpack(">4I", start)
    out = []
    for w, x, y, z in struct.iter_unpack(">4I", data):
        a, b, c, d = (p ^ q ^ r for p, q, r in zip((a, b, c, d), (w, x, y, z), keys[0]))
        for k0, k1, k2, k3 in inner:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k0, t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k1,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k2, t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k3,
            )
        last = lambda p, q, r, s: box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]
        a, b, c, d = last(a, b, c, d) ^ z0, last(b, c, d, a) ^ z1, last(c, d, a, b) ^ z2, last(d, a, b, c) ^ z3
        out.append(struct.pack(">4I", a, b, c, d))
    return b"".join(out)


def aes_open(key: bytes, data: bytes) -> bytes:
    """A string or stream: its first block starts the chain, its last byte says how much is padding."""
    if len(data) < 32:
        return b""
    out = cbc_decrypt(key, data[16:], data[:16])
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


def aes_seal(key: bytes, data: bytes, start: bytes) -> bytes:
    pad = 16 - len(data) % 16
    return start + cbc_encrypt(key, data + bytes([pad]) * pad, start)


def hardened(password: bytes, salt: bytes, more: bytes, revision: int) -> bytes:
    """The hash of a password under revisions 5 (one SHA-256) and 6 (64 rounds or more of ciphers and hashes)."""
    k = hashlib.sha256(password + salt + more).digest()
    i = 0
    while revision >= 6:
        e = cbc_encrypt(k[:16], (password + k + more) * 64, k[16:32])
        k = hashlib.new(("sha256", "sha384", "sha512")[sum(e[:16]) % 3], e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            break
    return k[:32]


def strong_key(password: bytes, entry: dict) -> bytes | None:
    """The key of a file under revisions 5 and 6 for a user or an owner password; None where it does not fit."""
    password, user, owner, revision = password[:127], entry.get("U", b""), entry.get("O", b""), entry.get("R", 5)
    for stored, wrapped, more in ((user, entry.get("UE", b""), b""), (owner, entry.get("OE", b""), user[:48])):
        if hardened(password, stored[32:40], more, revision) == stored[:32]:
            return cbc_decrypt(hardened(password, stored[40:48], more, revision), wrapped[:32], bytes(16))
    return None
