"""Byte-pair encoding by a priority queue of merge ranks, and decoding by joining vocabulary strings.

The vocabulary is a byte-level BPE file of the tokenizers library; its path is a parameter.  A text
is cut where one space stands between other characters: no piece of the byte-level pattern crosses
such a place, so ids of the parts join to the ids of the text, and a bounded memo keeps those of
frequent parts.  Null and empty texts have no ids; texts of any length are whole; repeated rows repeat;
an empty table gives no rows.  Truncation and padding are not used.  A file with settings other than plain
byte-level ones is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared
from .frames import add_columns

#: The byte-level pattern of the vocabulary's pre-tokenizer (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Parts that the memo of one worker holds before it starts anew, about 200 bytes each; fewer save memory and cost time.
MEMO = 800_000
#: White space other than the space and the line feed, and the pairs of these two (fixed values).
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """The text cut at its single inner spaces; each part but the first had a space before it."""
    if any(p in text for p in _PAIRS) or any(c in text for c in _RARE) or (not text.isascii() and any(c in text for c in _WIDE)):
        return _CUT.split(text)
    return text.split(" ")  # no white space stands beside a space


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def settings(path: str) -> dict:
    """The file's settings; those that would give other ids than this module makes raise ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    wrong = [k for k, v in plain.items() if (model.get(k) or v) != v]
    wrong += [k for k, v in (("normalizer", None), ("post_processor", None)) if spec.get(k) != v]
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    wrong += [x["content"] for x in spec.get("added_tokens") or [] if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]
    if wrong:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(wrong)}")
    return spec


class Vocabulary:
    """Merge ranks and vocabulary strings of one file."""

    def __init__(self, path: str) -> None:
        spec = settings(path)
        ids, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.first = [ids[letters[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(ids[a] << 20 | ids[b], rank)
            self.made.append(ids[a + b])
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in ids.items()}
        self.strings |= {i: s.encode() for s, i in added.items()}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PIECES)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the queue gives the lowest rank, then the leftmost pair; stale entries are skipped."""
        sym = [self.first[b] for b in piece]
        n, rank, made = len(sym), self.rank, self.made
        if n < 2:
            return sym
        queue, width, pair, i = [], n.bit_length(), sym[0], 0
        for s in sym[1:]:
            r = rank.get(pair << 20 | s)
            if r is not None:
                queue.append(r << width | i)
            pair = s
            i += 1
        if not queue:
            return sym
        heapify(queue)
        mask, left, right = (1 << width) - 1, list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            at = heappop(queue)
            i = at & mask
            j = right[i]
            if j >= n or rank.get(sym[i] << 20 | sym[j]) != at >> width:  # stale: one of the pair has been merged since
                continue
            k = right[i] = right[j]
            sym[i] = new = made[at >> width]
            sym[j] = -1  # no pair of a vocabulary holds it
            if k < n:
                left[k] = i
                r = rank.get(new << 20 | sym[k])
                if r is not None:
                    heappush(queue, r << width | i)
            h = left[i]
            if h >= 0:
                r = rank.get(sym[h] << 20 | new)
                if r is not None:
                    heappush(queue, r << width | h)
        return [s for s in sym if s >= 0]

    def ids(self, text: str) -> list[int]:
        if text[:1] == " ":
            if text[1:].isalpha():  # one piece
                return self.merged(text.encode())
            if text[1:-1].isalpha() and text[-1] in ".,":  # two
                return [*self.merged(text[:-1].encode()), self.first[ord(text[-1])]]
        out: list[int] = []
        segments = self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else (text,)
        for k, segment in enumerate(segments):
            if k % 2:
                out.append(self.added[segment])
            else:
                for piece in self.pieces.findall(segment):
                    out += self.merged(piece.encode())
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo(dict):
    """Little-endian 32-bit ids of the parts of texts, by part; missing ones are made, and all are dropped when there are too many.

    A stop or comma after a word and a line break between two parts are pieces of their own, so such a
    part is joined from what is known of the rest of it.
    """

    def __init__(self, encode, before: str = "", start: Memo | None = None, most: int | None = None) -> None:
        super().__init__()
        self.encode, self.before, self.start, self.most = encode, before, self if start is None else start, most or MEMO
        self.marks = {x: array("I", encode(x)).tobytes() for x in ".,\n"}

    def __missing__(self, part: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            out = self[part[:-1]] + self.marks[part[-1]]
        elif part.count("\n") == 1 and not part[max(part.index("\n") - 1, 0)].isspace() and not part[part.index("\n") + 1 :][:1].isspace() and part[-1] != "\n":
            line, rest = part.split("\n")
            out = self[line] + self.marks["\n"] + self.start[rest]
        else:
            out = array("I", self.encode(self.before + part)).tobytes()
        self[part] = out
        return out


class Encoder:
    """Ids of whole texts through memos of their parts."""

    def __init__(self, encode, most: int | None = None) -> None:
        self.start = Memo(encode, most=most)
        self.inner = Memo(encode, " ", self.start, most)

    def __call__(self, text: str) -> bytes:
        cut = parts(text)
        first = self.start[cut[0]]
        del cut[0]
        return first + b"".join(map(self.inner.__getitem__, cut))


@lru_cache(maxsize=1)
def own_encoder(path: str, most: int) -> Encoder:
    """One for a worker: its memo serves all tasks that the worker runs."""
    return Encoder(vocabulary(path).ids, most)


def encode_text(df: DataFrame, path: str, column: str = "text", keep: list[str] | None = None, memo: int = MEMO) -> DataFrame:
    """df with ``n_tokens`` long and ``token_ids`` binary (little-endian unsigned 32-bit ids).

    Null and empty texts have none.  Repeated rows repeat; ties cannot occur (equal ranks take the
    leftmost pair).  Extra columns stay; columns with the names of the two new ones are replaced.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]

    def make():
        v, encode = vocabulary(path), own_encoder(path, memo)

        def work(texts):
            ids = [encode(x) for x in texts]
            return [len(x) // 4 for x in ids], ids

        return work

    return add_columns(df, column, fields, make, keep=keep)


def decode_ids(df: DataFrame, path: str, column: str = "token_ids") -> DataFrame:
    """df with ``decoded`` string for a binary column of ids; null ids give an empty text.  An id out of the vocabulary raises."""
    schema = T.StructType([f for f in df.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa

        v = vocabulary(path)
        for b in batches:
            texts = [v.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(column).to_pylist()]
            keep = [c for c in b.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.mapInArrow(shared.tidy(run), schema)


def round_trip(df: DataFrame, path: str, column: str = "text", keep: list[str] | None = None, memo: int = MEMO) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass over the texts."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        v, encode = vocabulary(path), own_encoder(path, memo)

        def work(texts):
            ids = [encode(x) for x in texts]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(v.decode(np.frombuffer(x, "<u4").tolist()).encode()) for x in ids]

        return work

    return add_columns(df, column, fields, make, keep=keep)
