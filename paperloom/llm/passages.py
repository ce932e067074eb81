"""Repeated passages by compact windows over min-hashes.

Tokens are the five-word shingles of a text.  For each of eight hash functions, all stretches of at
least ``LEAST`` tokens whose least hash stands at one place form one compact window (l, c, r): the
node c of the Cartesian tree of the hashes with its subtree l..r.  Nodes with so long a subtree are the
places that are least in some stretch of that length; their ends come from tables of minima over powers
of two, so no step of Python is spent on a token.

1. Equal texts are searched once.  Frequencies of shingles are counted over the distinct texts; a node whose
   shingle no other text has is dropped, and so is a window with too few shared shingles for any partner.
2. Windows with one signature (hash function and least shingle) meet at its first and its last
   text, which links most texts of a group without listing its pairs.
3. Windows of a pair of texts that overlap on a common diagonal under at least ``HASHES_MEET``
   functions are joined to one region of each.
4. The region is verified: its longest stretch of a Jaccard similarity of 0.8 must reach ``LEAST``
   tokens on both sides, then the rest is searched.  Passages of a text that overlap are one.
5. A group of the first ``REST_HASHES`` functions is settled if the passages that hold its windows are of one
   class.  In the others, windows of equal contents meet one of them; the contents that are not of the
   group's most frequent class then meet all contents, in blocks, and pairs that hold enough common
   shingles, and that no link has connected yet, are verified.
6. The whole text of a document with equal copies is a passage.

The class of a passage is the connected component of the links.  Null and short texts have no passages;
rows with a null id are left out; several texts under one id are searched apart, and what only the texts
of one id share does not repeat across documents, so repeated rows alone give nothing.  An empty table
gives no rows.  Columns other than the key and the text play no part, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import counts, drops, shared
from .counts import U
from .frames import slices
from .graph import Forest, components, join_sized
from .near import WORDS, cut, kept_bits, weighted
from .tokens import mix, shingles, word_hashes

PASSAGE_WORDS, HASHES, HASHES_MEET, REST_HASHES, THRESHOLD = 50, 8, 3, 2, 0.8
LEAST = PASSAGE_WORDS - WORDS + 1
#: Words by which a diagonal may shift within a passage.
SHIFT = 32
_PIECE = 1 << 20


def compact_windows(v: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every compact window of at least ``least`` values; rows at[i]:at[i+1] are apart, equal values count from the left."""
    n = len(v)
    sizes = np.diff(at)
    if not n or sizes.max(initial=0) < least:
        z = np.empty(0, np.int64)
        return z, z, z
    levels = max(least.bit_length() + 1, 7)
    tables = [v]
    for k in range(levels):
        t, step = tables[-1], 1 << k
        x = np.empty_like(t)
        if n > step:
            np.minimum(t[:-step], t[step:], out=x[:-step])
        x[max(n - step, 0) :] = t[max(n - step, 0) :]
        tables.append(x)  # x[i]: least of v[i : i + 2 * step], cut at the end
    # the least value of each stretch of `least` values within a row, and its leftmost place
    k = least.bit_length() - 1
    row_end = np.repeat(at[1:], sizes)
    place = np.arange(n)
    starts = np.flatnonzero(place + least <= row_end)
    low = np.minimum(tables[k][starts], tables[k][starts + least - (1 << k)])
    owner = np.zeros(n, bool)
    change = np.concatenate([[True], (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1)])
    left = np.flatnonzero(change)  # runs of stretches of one least value
    right = np.concatenate([left[1:], [len(starts)]])

    def leftmost(some):
        """The leftmost place of the least value of each stretch."""
        c, value = starts[some].copy(), low[some]
        for j in range(k, -1, -1):
            ok = (c + (1 << j) <= n) & (tables[j][np.minimum(c, n - 1)] > value)
            c = np.where(ok, c + (1 << j), c)
        return c

    c = leftmost(left)
    owner[c] = True
    after = left + (c - starts[left]) + 1  # equal values may follow in the same run: all its later stretches at once
    size = np.maximum(right - after, 0)
    owner[leftmost(np.repeat(after - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))] = True
    c = np.flatnonzero(owner)
    x, lo, hi = v[c], np.repeat(at[:-1], sizes)[c], row_end[c]
    right, left, step = c + 1, c.copy(), 1 << levels
    some = np.arange(len(c))
    while len(some):  # whole steps first
        ok = (right[some] + step <= hi[some]) & (tables[levels][np.minimum(right[some], n - 1)] >= x[some])
        some = some[ok]
        right[some] += step
    some = np.arange(len(c))
    while len(some):
        ok = (left[some] - step >= lo[some]) & (tables[levels][np.maximum(left[some] - step, 0)] > x[some])
        some = some[ok]
        left[some] -= step
    for j in range(levels - 1, -1, -1):
        step = 1 << j
        right = np.where((right + step <= hi) & (tables[j][np.minimum(right, n - 1)] >= x), right + step, right)
        left = np.where((left - step >= lo) & (tables[j][np.maximum(left - step, 0)] > x), left - step, left)
    keep = right - left >= least
    return left[keep], c[keep], right[keep] - 1


def covered(common: np.ndarray, at: np.ndarray, least: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cuts): the places in some stretch of ``least`` with ``need`` shared tokens, and where their runs begin; no run crosses rows."""
    total = np.concatenate([[0], np.cumsum(common)])
    row_end = np.repeat(at[1:], np.diff(at))
    start = np.flatnonzero(np.arange(len(common)) + least <= row_end)
    start = start[total[start + least] - total[start] >= need]
    change = np.zeros(len(common) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + least, -1)
    places = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    first = np.concatenate([[True], (np.diff(places) > 1) | np.isin(places[1:], at)]) if len(places) else np.zeros(0, bool)
    return places, np.concatenate([np.flatnonzero(first), [len(places)]]).astype(np.int64)


def joined(sig: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """(l, c, r) with overlapping windows of one least value as one: a repeated line would give one for each repeat."""
    order = np.lexsort((l, sig))
    sig, l, c, r = sig[order], l[order], c[order], r[order]  # noqa: E741
    new = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (l[1:] > r[:-1])])) if len(l) else np.empty(0, np.int64)
    return l[new], c[new], np.maximum.reduceat(r, new) if len(new) else r


_WINDOWS = "sig long, fn int, node long, l int, c int, r int, content long, k long, text_hash binary, words int, file string, at long, n int"
_REGION = "n1 long, l1 int, r1 int, n2 long, l2 int, r2 int"
_LINK = "n1 long, s1 int, e1 int, n2 long, s2 int, e2 int"
#: The least number of shingles that two similar stretches of LEAST have in common.
COMMON = int(np.ceil(2 * LEAST * THRESHOLD / (1 + THRESHOLD) - 1e-9))
#: Contents of a block of a group, and words about which the groups of one text are worked on together.
BLOCK, PLACES = 128, 128


def _powers(n: int, base: int) -> np.ndarray:
    t = np.ones(1, U)
    while len(t) < n:
        with np.errstate(over="ignore"):
            t = np.concatenate([t, t * U(pow(base, len(t), 1 << 64))])
    return t[:n]


_BASE = 0x9E3779B97F4A7C55


#: What the list of repeated texts says of a row: it is a copy, or the first of its copies.
COPY, FIRST = 1, 2


def _originals(copies: tuple[list[dict], int]):
    """A function of batches (k, t): those rows that are no copies, with an id, and whether each has copies."""
    store = counts.Store(*copies)

    def work(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        kind = drops.kinds(store, b.column("k"), b.column("t"))
        keep = (kind != COPY) & ~np.array(b.column("k").is_null())
        return b.filter(pa.array(keep)), kind[keep] == FIRST

    return work


def windows(rows: DataFrame, folder: str, files: list[dict], bits: int, documents: int, copies: tuple[list[dict], int]) -> DataFrame:
    """Compact windows around shared shingles, with a hash of the shared shingles and their places about the window's own.

    A text with windows or copies also gives a row with a null sig, which says whose it is and where, below
    folder, its shared shingles are.  Its node is a number of the task and the row.
    """
    need = int(THRESHOLD * LEAST * 0.95)

    def run(batches):
        from pyspark import TaskContext

        store, kept, name, originals = counts.Store(files, bits), kept_bits(documents), shared.attempt_name(), _originals(copies)
        out: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 40
        as_int = lambda x: pa.array(x.astype(np.int32))
        schema = pa.schema([("sig", pa.int64()), ("fn", pa.int32()), ("node", pa.int64()), ("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32()), ("content", pa.int64()), ("k", pa.int64()), ("text_hash", pa.binary()), ("words", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("n", pa.int32())])

        def table(**columns):
            size = len(columns["node"])
            out.append(pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema))

        def body():
            nonlocal number
            at = 0
            for whole in batches:
                for b in slices(whole, "t", _PIECE):
                    b, repeated_text = originals(b)
                    h, _, _, ptr = word_hashes(b.column("t"))
                    words = np.diff(ptr)
                    g, ptr = shingles(h, ptr, WORDS)
                    df, _ = store.lookup(cut(g, kept))
                    common = df > 1
                    place, cuts = covered(common, ptr, LEAST, need)
                    common[np.setdiff1d(np.flatnonzero(common), place, assume_unique=True)] = False
                    total = np.concatenate([[0], np.cumsum(common)])
                    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                    with np.errstate(over="ignore"):
                        content = np.concatenate([[U(0)], np.cumsum(np.where(common, g, U(0)) * _powers(len(g), _BASE), dtype=U)])
                    cols = []
                    for i in range(HASHES):
                        with np.errstate(over="ignore"):
                            v = mix(g[place] * U((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1) + U(i))
                        l, c, r = compact_windows((v >> U(32)).astype(np.uint32), cuts, LEAST)  # noqa: E741
                        l, c, r = joined(v[c], place[l], place[c], place[r])  # noqa: E741
                        keep = common[c] & (total[r + 1] - total[l] >= need)
                        l, c, r = l[keep], c[keep], r[keep]  # noqa: E741
                        cols.append((v[np.searchsorted(place, c)], np.full(len(c), i), l, c, r))
                    sig, fn, l, c, r = (np.concatenate(x) for x in zip(*cols))  # noqa: E741
                    first, number = number, number + len(b)
                    doc = row[c]
                    used = np.union1d(doc, np.flatnonzero(repeated_text & (words >= PASSAGE_WORDS)))
                    if not len(used):
                        continue
                    start, size = np.zeros(len(ptr) - 1, np.int64), total[ptr[1:]] - total[ptr[:-1]]
                    for d in used.tolist():
                        start[d] = at
                        where = np.flatnonzero(common[ptr[d] : ptr[d + 1]])
                        at += 8 * len(where)
                        yield (g[ptr[d] + where] >> U(32)).astype("<u4").tobytes() + where.astype("<u4").tobytes()
                    base = ptr[doc]
                    with np.errstate(over="ignore"):
                        about = (content[r + 1] - content[l]) * _powers(len(g), pow(_BASE, -1, 1 << 64))[c]
                    table(sig=pa.array(sig.view(np.int64)), fn=as_int(fn), node=pa.array(first + doc), l=as_int(l - base), c=as_int(c - base), r=as_int(r - base), content=pa.array(about.view(np.int64)))
                    texts = b.column("t").take(pa.array(used)).to_pylist()
                    table(node=pa.array(first + used), k=b.column("k").take(pa.array(used)), text_hash=pa.array([drops.text_hash(t) for t in texts], pa.binary()), words=as_int(words[used]), file=pa.array([name] * len(used)), at=pa.array(start[used]), n=as_int(size[used]))

        shared.put(f"{folder}/{name}", body())
        yield from out

    return rows.mapInArrow(shared.tidy(run), _WINDOWS)


@lru_cache(maxsize=1)
def _views() -> shared.Views:
    """One for a worker."""
    return shared.Views()


def _tokens(folder: str, side: tuple, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits of the shingles, places) of a document's shared shingles from lo to hi inclusive."""
    name, at, n = side
    view = _views()(f"{folder}/{name}")
    places = shared.array_at(view, "<u4", at + 4 * n, n)
    a, b = np.searchsorted(places, [lo, hi + 1])
    return shared.array_at(view, "<u4", at, n)[a:b], places[a:b].astype(np.int64)


def _distinct(t: np.ndarray) -> np.ndarray:
    """Sorted, each once; for short arrays faster than numpy's own."""
    t = np.sort(t)
    keep = np.ones(len(t), bool)
    np.not_equal(t[1:], t[:-1], out=keep[1:])
    return t[keep]


def _within(t: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of t is in the sorted array."""
    if not len(known):
        return np.zeros(len(t), bool)
    at = known.searchsorted(t)
    at[at == len(known)] = 0
    return known[at] == t


def _cut(x: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    s, e = x[1].searchsorted((lo, hi + 1))
    return x[0][s:e], x[1][s:e]


def _chain(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides at which they hold the same tokens, rising on both: a repeated token meets the one nearest to the common diagonal."""
    order = b[0].argsort(kind="stable")
    t, q = b[0][order], b[1][order]
    first, after = t.searchsorted(a[0]), t.searchsorted(a[0], "right")
    hit = (after > first).nonzero()[0]
    p, first, after = a[1][hit], first[hit], after[hit]
    if not len(hit):
        return p, p
    sole = after - first == 1
    shift = int(np.median((q[first] - p)[sole])) if sole.any() else int(q.min() - p.min())
    to = q[first]
    if not sole.all():  # the places of a token rise, since the sort is stable: one search in all tokens' places
        many = np.flatnonzero(~sole)
        lo, hi, want = first[many], after[many], p[many] + shift
        token = np.concatenate([[0], np.cumsum(t[1:] != t[:-1])]) << 40
        k = (token + q).searchsorted(token[lo] + np.maximum(want, 0))
        before, at = q[np.maximum(k - 1, lo)], q[np.minimum(k, hi - 1)]
        to[many] = np.where(np.abs(before - want) <= np.abs(at - want), before, at)
    if (np.diff(to) > 0).all():
        return p, to
    tails, ends, back = [], [], np.full(len(to), -1)
    for i, x in enumerate(to.tolist()):  # the longest rising part
        k = bisect_left(tails, x)
        tails[k : k + 1], ends[k : k + 1] = [x], [i]
        back[i] = ends[k - 1] if k else -1
    keep, i = [], ends[-1]
    while i >= 0:
        keep.append(i)
        i = int(back[i])
    return p[keep[::-1]], to[keep[::-1]]


def _longest(p: np.ndarray, q: np.ndarray, n1: np.ndarray, n2: np.ndarray, i: np.ndarray, threshold: float) -> tuple[int, int]:
    """(first, last) of the chain's stretch whose shorter side is longest among those of Jaccard similarity threshold or more.

    n1, n2 and i count the tokens of both sides and the common ones up to each pair of the chain.  A stretch
    is similar if (1 + threshold) * common >= threshold * tokens of both sides, which is a difference of a
    value of its last pair and one of its first.
    """
    finish = (1 + threshold) * i - threshold * (n1 + n2)
    begin = finish - (1 + threshold) + 2 * threshold
    low = np.minimum.accumulate(begin)  # falls: the first place at which it is low enough is the best start
    start = np.searchsorted(-low, -finish - 1e-9)
    ok = start <= np.arange(len(p))
    start = np.minimum(start, np.arange(len(p)))
    size = np.where(ok, np.minimum(p - p[start], q - q[start]), -1)
    end = int(size.argmax())
    return int(start[end]), end


def _best(places: np.ndarray, other: int) -> tuple[int, int]:
    """The stretch of best balance: 1 for each shared token, less ``other`` for each token between."""
    gain = np.arange(1, len(places) + 1) * (1 + other) - other * places
    before = np.concatenate([[-other * places[0]], gain[:-1] - other * (np.diff(places) - 1)])
    low = np.minimum.accumulate(before)
    end = int((gain - low).argmax())
    start = int(before[: end + 1].argmin())
    return int(places[start]), int(places[end])


def _dense(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[int, int, int, int] | None:
    """The stretches of best balance, in whatever order both sides hold the tokens."""
    side, ends = [a, b], [(0, 0), (0, 0)]
    other = int(np.ceil((1 + threshold) / (1 - threshold) - 1e-9)) - 1  # a stretch of positive balance keeps the threshold
    for i in (0, 1, 0):  # the best of one side, of the other within it, and of the first within that
        hit = side[i][1][_within(side[i][0], np.sort(side[1 - i][0]))]
        if not len(hit):
            return None
        ends[i] = _best(hit, other)
        side[i] = _cut(side[i], *ends[i])
    return *ends[0], *ends[1]


def _again(t: np.ndarray) -> np.ndarray:
    """Whether each token stands before in t."""
    order = t.argsort(kind="stable")
    out = np.zeros(len(t), bool)
    out[order[1:]] = t[order[1:]] == t[order[:-1]]
    return out


def _may_hold(side: tuple[np.ndarray, np.ndarray], hit: np.ndarray, least: int, *parts: float) -> list[bool]:
    """For each part whether some stretch of ``least`` tokens of a side has so many common tokens, repeats of the whole side left out.

    hit marks the common ones among the side's shared tokens.
    """
    p = side[1][hit]
    if len(p) < parts[0] * least or p[-1] - p[0] + 1 < least:
        return [False] * len(parts)
    own = p - _again(side[0]).cumsum()[hit]
    first = p.searchsorted(p - (least - 1), "right") - 1
    ok = first >= 0
    out = []
    for part in parts:
        # a stretch from i to j has j - i + 1 common tokens; with f as here they are enough if f[i] <= f[j] + 1 - part
        f = np.arange(len(p)) - part * own
        out.append(bool((np.minimum.accumulate(f)[first[ok]] <= f[ok] + 1 - part + 1e-9).any()))
    return out


def _candidates(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], p: np.ndarray, q: np.ndarray, threshold: float):
    """The longest similar stretch of the chain with tokens counted once where they stand first, that with all tokens counted, and the densest."""
    ends = lambda s, e: (int(p[s]), int(p[e]), int(q[s]), int(q[e]))
    again, many = _again(a[0]), _again(b[0])
    if again.any() or many.any():
        at, to = np.searchsorted(a[1], p), np.searchsorted(b[1], q)
        yield ends(*_longest(p, q, p - np.cumsum(again)[at], q - np.cumsum(many)[to], np.cumsum(~_again(a[0][at])), threshold))
    yield ends(*_longest(p, q, p, q, np.arange(len(p)), threshold))
    if (dense := _dense(a, b, threshold)) is not None:
        yield dense


def _similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ends: tuple[int, int, int, int], least: int, threshold: float) -> bool:
    """Whether the stretches have ``least`` tokens each and are similar; repeated tokens of a side count once, tokens that no other document has are distinct."""
    l1, r1, l2, r2 = ends
    n1, n2 = r1 - l1 + 1, r2 - l2 + 1
    if min(n1, n2) < least:
        return False
    x, y = _cut(a, l1, r1)[0], _cut(b, l2, r2)[0]
    u, v = _distinct(x), _distinct(y)
    n1, n2 = n1 - len(x) + len(u), n2 - len(y) + len(v)
    both = int(_within(u, v).sum())
    return both >= threshold * (n1 + n2 - both) - 1e-9


def verify(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: int = LEAST, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """The verified stretches (first and last token of both sides) of a region, given its shared tokens and their places.

    A stretch begins and ends with a token of both sides.  The whole region counts if it is similar, else
    the longest similar stretch of the chain of common tokens; what lies before and after it is next.
    """
    found, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if min(len(a[0]), len(b[0])) == 0:
            continue
        common = [_within(x[0], np.sort(y[0])).nonzero()[0] for x, y in ((a, b), (b, a))]
        if not len(common[0]):
            continue
        hits = [x[1][hit] for x, hit in zip((a, b), common)]
        ends = int(hits[0][0]), int(hits[0][-1]), int(hits[1][0]), int(hits[1][-1])
        if _similar(a, b, ends, least, threshold):
            found.append(ends)
            continue
        # of two similar stretches each has the threshold's part in common, and the shorter one more
        one = _may_hold(a, common[0], least, threshold, 2 * threshold / (1 + threshold))
        two = _may_hold(b, common[1], least, threshold, 2 * threshold / (1 + threshold)) if one[0] else [False]
        if not (one[0] and two[0] and (one[1] or two[1])):
            continue
        p, q = _chain(a, b)
        long = False
        for ends in _candidates(a, b, p, q, threshold):
            l1, r1, l2, r2 = ends
            long |= min(r1 - l1, r2 - l2) + 1 >= least
            if _similar(a, b, ends, least, threshold):
                found.append(ends)
                todo += [(_cut(a, 0, l1 - 1), _cut(b, 0, l2 - 1)), (_cut(a, r1 + 1, 1 << 40), _cut(b, r2 + 1, 1 << 40))]
                break
        else:
            if long and len(p) > 1:  # repeated tokens made it seem similar: both sides of the widest hole, or of the middle, are next
                hole = np.diff(p) + np.diff(q)
                k = int(hole.argmax()) if hole.max() > 2 else len(hole) // 2
                todo += [(_cut(a, 0, int(p[k])), _cut(b, 0, int(q[k]))), (_cut(a, int(p[k + 1]), 1 << 40), _cut(b, int(q[k + 1]), 1 << 40))]
    return found


def regions(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Joined windows (first and last token of both sides) of one pair of documents, from rows (fn, l1, c1, r1, l2, c2, r2)."""
    rows = sorted(rows, key=lambda x: (x[2] - x[5], x[1]))
    groups: list[list[tuple]] = []
    for x in rows:
        if groups and (x[2] - x[5]) - (groups[-1][-1][2] - groups[-1][-1][5]) <= SHIFT:
            groups[-1].append(x)
        else:
            groups.append([x])
    out = []
    for g in groups:
        g.sort(key=lambda x: x[1])
        part, reach = [], -1
        for x in [*g, None]:
            if x is None or (part and x[1] > reach):
                if len({y[0] for y in part}) >= HASHES_MEET:
                    out.append((min(y[1] for y in part), max(y[3] for y in part), min(y[4] for y in part), max(y[6] for y in part)))
                part, reach = [], -1
            if x is not None:
                part.append(x)
                reach = max(reach, x[3])
    return out


def _packed(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.int32() for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)


def _meet_at_ends(found: DataFrame) -> DataFrame:
    """Regions of pairs of texts, from the windows that meet at the first and the last text of their groups."""
    side = F.struct("node", "l", "c", "r")
    meet = found.groupBy("sig").agg(F.min(side).alias("a"), F.max(side).alias("z")).where("a.node <> z.node")
    met = found.select("sig", "fn", "node", "l", "c", "r").join(meet, "sig").where("node <> a.node")
    # with the first text of the group and, but for the last itself, with the last
    other = F.explode(F.when(F.col("node") == F.col("z.node"), F.array("a")).otherwise(F.array("a", "z")))
    pairs = met.select("fn", "node", "l", "c", "r", other.alias("o"))
    low = F.col("node") < F.col("o.node")
    pick = lambda c, first: F.when(low, F.col(c) if first else F.col(f"o.{c}")).otherwise(F.col(f"o.{c}") if first else F.col(c))
    pack = lambda a, b: (a.cast("long") * (1 << 32) + b.cast("long"))
    rows_of = pairs.select(
        pick("node", True).alias("n1"), pick("node", False).alias("n2"), pack(F.col("fn"), pick("c", True) - pick("c", False) + (1 << 30)).alias("m"), pack(pick("l", True), pick("r", True)).alias("x"), pack(pick("l", False), pick("r", False)).alias("y")
    )
    work = rows_of.repartition("n1", "n2").sortWithinPartitions("n1", "n2")

    def join_up(batches):
        at, held, low = None, [], (1 << 32) - 1
        for b in batches:
            out = []
            for n1, n2, m, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if (n1, n2) != at:
                    if held:
                        out += [(at[0], *r[:2], at[1], *r[2:]) for r in regions(held)]
                    at, held = (n1, n2), []
                held.append((m >> 32, x >> 32, (m & low) - (1 << 30), x & low, y >> 32, 0, y & low))
            if out:
                yield _packed(_REGION, out)
        if held and (out := [(at[0], *r[:2], at[1], *r[2:]) for r in regions(held)]):
            yield _packed(_REGION, out)

    return work.mapInArrow(shared.tidy(join_up), _REGION)


def _verified(pairs: DataFrame, places: DataFrame, store: str) -> DataFrame:
    """Links of the regions of pairs of texts that are similar."""
    for i in "12":
        pairs = pairs.join(places.select(F.col("node").alias(f"n{i}"), F.struct("file", "at", "n").alias(f"p{i}")), f"n{i}")
    pairs = pairs.repartition(4 * shared.partitions(pairs.sparkSession), "n1", "n2")  # few bytes, much work

    def match(batches):
        for b in batches:
            out = []
            for n1, l1, r1, n2, l2, r2, p1, p2 in zip(*(b.column(c).to_pylist() for c in ("n1", "l1", "r1", "n2", "l2", "r2", "p1", "p2"))):
                for got in verify(_tokens(store, tuple(p1.values()), l1, r1), _tokens(store, tuple(p2.values()), l2, r2)):
                    out.append((n1, got[0], got[1] + WORDS, n2, got[2], got[3] + WORDS))
            if out:
                yield _packed(_LINK, out)

    return pairs.mapInArrow(shared.tidy(match), _LINK)


def _classes(links: DataFrame, folder: str) -> DataFrame:
    """(node, from, to, id, label): the passages of the links, overlapping ones of a text as one, and their classes."""
    ends = links.select(F.col("n1").alias("node"), F.col("s1").alias("s"), F.col("e1").alias("e")).unionByName(links.select(F.col("n2").alias("node"), F.col("s2").alias("s"), F.col("e2").alias("e"))).distinct()
    spans = shared.write_table(_islands(ends), folder, "spans")
    ids = spans.select("node", "s", "e", F.xxhash64("node", "from").alias("id"), "from", "to")
    one = links.join(ids.select(F.col("node").alias("n1"), F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("id").alias("u")), ["n1", "s1", "e1"])
    edges = one.join(ids.select(F.col("node").alias("n2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("id").alias("v")), ["n2", "s2", "e2"]).select("u", "v")
    label = components(edges, f"{folder}/components").select(F.col("node").alias("id"), "label")
    return shared.write_table(ids.select("node", "from", "to", "id").distinct().join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), folder, "labelled")


def _unsettled(found: DataFrame, passages: DataFrame, folder: str) -> DataFrame:
    """(sig, node, l, c, r, content, label, most, many, apart): the windows of groups that are not of one class; ``most`` is the group's most frequent label."""
    within = passages.select("node", "from", "to", "label")
    inside = lambda w: w.join(within, (w["node"] == within["node"]) & (within["from"] <= w["c"]) & (w["c"] + WORDS <= within["to"]), "left").drop(within["node"]).withColumn("label", F.coalesce("label", -1 - F.col("node")))
    found = found.where(F.col("fn") < REST_HASHES)
    state = inside(found.select("sig", "node", "c")).groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    unsettled = shared.write_table(state.where("lo <> hi").select("sig"), folder, "unsettled")
    return shared.write_table(inside(found.join(unsettled, "sig").select("sig", "node", "l", "c", "r", "content")).select("sig", "node", "l", "c", "r", "content", "label"), folder, "rest")


def _rest_links(rest: DataFrame, places: DataFrame, store: str, folder: str, block: int = BLOCK) -> DataFrame:
    """Links of pairs of texts that no link connects, from the windows of unsettled groups.

    Windows of equal contents are similar to the same others, so one of them stands for all; they meet it.
    """
    one = F.min(F.struct("node", "c", "l", "r", "label"))
    same = shared.write_table(rest.groupBy("sig", "content").agg(one.alias("one"), F.count("*").alias("many")), folder, "contents")
    total = rest.count()
    met = join_sized(rest.withColumn("key", F.xxhash64("sig", "content")), same.where("many > 1").select(F.xxhash64("sig", "content").alias("key"), "one", "many"), "key", "many", total)
    low = F.col("node") < F.col("one.node")
    equal = met.where("node <> one.node AND label <> one.label").select(F.least("node", "one.node").alias("n1"), *_sides(1, low), F.greatest("node", "one.node").alias("n2"), *_sides(2, low)).distinct()
    votes = same.groupBy("sig", "one.label").agg(F.count("*").alias("votes"), F.min(F.struct("one.node", "one.c")).alias("lead"))
    most = votes.groupBy("sig").agg(F.sum("votes").alias("many"), F.max(F.struct("votes", "label")).alias("top"), F.min("lead").alias("lead"))
    most = shared.write_table(most.where("many > top.votes").select("sig", F.col("top.label").alias("most"), "many", (F.col("many") - F.col("top.votes")).alias("apart"), F.col("lead.node").alias("lead"), F.floor(F.col("lead.c") / PLACES).alias("place")), folder, "groups")
    members = join_sized(same.select("sig", "one.*"), most, "sig", "many", total).join(places.select("node", "file", "at", "n"), "node")
    members = shared.write_table(members, folder, "members")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node", "l"), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = ["node", "c", "l", "r", "label", "file", "at", "n"]
    left = members.where("label <> most").select("lead", "place", "sig", own(blocks("apart")).alias("i"), to(blocks("many")).alias("j"), F.lit(True).alias("left"), *kept)
    right = members.select("lead", "place", "sig", to(blocks("apart")).alias("i"), own(blocks("many")).alias("j"), F.lit(False).alias("left"), *kept)
    # groups about one place of one text hold the same texts: a task that has them all verifies a pair once
    work = left.unionByName(right).repartition(4 * shared.partitions(rest.sparkSession), "lead", "place", "i", "j").sortWithinPartitions("lead", "place", "i", "j", "sig")

    def pairs(batches):
        at, held, known, where = None, [], {}, None
        for b in batches:
            out = []
            for lead, place, sig, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (lead, place, i, j, sig) != at:
                    out += _similar_pairs(held, store, known)
                    at, held = (lead, place, i, j, sig), []
                    if where != at[:4]:
                        known, where = {}, at[:4]
                held.append(row)
            if out:
                yield _packed(_LINK, out)
        if out := _similar_pairs(held, store, known):
            yield _packed(_LINK, out)

    return _verified(equal, places, store).unionByName(work.mapInArrow(shared.tidy(pairs), _LINK)).distinct()


def _sides(i: int, low) -> list:
    """The window of the first (1) or the second text of a pair; ``low`` says whether the row's own text is the first."""
    own = low if i == 1 else ~low
    return [F.when(own, F.col(c)).otherwise(F.col(f"one.{c}")).alias(f"{c}{i}") for c in "lr"]


def _similar_pairs(rows: list[list], store: str, known: dict[tuple, list[tuple]]) -> list[tuple]:
    """Links of left and right rows of a block, of different labels, that share COMMON shingles and are similar.

    A pair whose texts a link of the block has connected is skipped.  ``known`` has the pairs of texts that have
    been verified before, with their similar stretches and the regions that hold none.
    """
    if not rows:
        return []
    forest, names = Forest(len(rows)), {}
    for x, r in enumerate(rows):  # rows of one label are connected
        forest.join(x, names.setdefault(r[5], x))
    sides = [[x for x, r in enumerate(rows) if r[0] == side] for side in (True, False)]
    if len({forest.root(x) for x in range(len(rows))}) == 1:
        return []
    tokens = [_tokens(store, tuple(r[6:9]), r[3], r[4]) for r in rows]
    kinds = [_distinct(t) for t, _ in tokens]
    right = np.concatenate([kinds[x] for x in sides[1]]) if sides[1] else np.empty(0, np.uint32)
    owner = np.repeat(np.arange(len(sides[1])), [len(kinds[x]) for x in sides[1]])
    order = np.argsort(right, kind="stable")
    right, owner = right[order], owner[order]
    out = []
    for x in sides[0]:
        lo, hi = np.searchsorted(right, kinds[x]), np.searchsorted(right, kinds[x], "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        both = np.bincount(owner[at], minlength=len(sides[1]))
        for i in np.flatnonzero(both >= COMMON).tolist():
            y = sides[1][i]
            if rows[x][1] == rows[y][1] or forest.root(x) == forest.root(y):
                continue
            a, b = (x, y) if rows[x][1] < rows[y][1] else (y, x)
            (n1, c1, l1, r1), (n2, c2, l2, r2) = rows[a][1:5], rows[b][1:5]
            before = known.setdefault((n1, n2), [])
            if any(good and s1 <= c1 <= e1 and s2 <= c2 <= e2 for good, s1, e1, s2, e2 in before):
                forest.join(a, b)
                continue
            if any(not good and s1 <= l1 and r1 <= e1 and s2 <= l2 and r2 <= e2 for good, s1, e1, s2, e2 in before):
                continue
            found = verify(tokens[a], tokens[b])
            before += [*((True, *got) for got in found), (False, l1, r1, l2, r2)]
            if found:
                forest.join(a, b)
                out += [(n1, s1, e1 + WORDS, n2, s2, e2 + WORDS) for s1, e1, s2, e2 in found]
    return out


def repeated(docs: DataFrame, folder: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, class_id, class_docs): repeated passages, ends exclusive.

    class_id is the least doc_id of the passage's class and class_docs the number of its documents.
    """
    rows = counts.text_rows(docs, column, key)
    hashed = rows.where("k IS NOT NULL").select("k", F.unhex(F.substring(F.sha2("t", 256), 1, 32)).alias("text_hash"))
    hashed = shared.write_table(hashed, folder, "rows")
    documents = hashed.count()
    texts = shared.write_table(hashed.groupBy("text_hash").agg(F.min("k").alias("first"), F.count("*").alias("copies")), folder, "texts")
    listed = join_sized(hashed, texts.where("copies > 1"), "text_hash", "copies", documents)
    copies = drops.stored(drops.once(listed, F.when(F.first(F.col("k") == F.col("first")), FIRST).otherwise(COPY)), f"{folder}/copies")

    def shingles_of():
        originals = _originals(copies)
        return lambda b: cut(weighted(originals(b)[0].column("t"), WORDS)[0], kept_bits(documents))

    bits = counts.bits_for(docs.sparkSession)
    files = counts.count(counts.map_blobs(rows, shingles_of, bits, _PIECE, made=True), f"{folder}/frequencies", bits, least=2)
    store = f"{folder}/tokens"
    made = shared.write_table(windows(rows, store, files, bits, documents, copies), folder, "windows")
    found = made.where("sig IS NOT NULL").select("sig", "fn", "node", "l", "c", "r", "content")
    places = made.where("sig IS NULL").select("node", "k", "text_hash", "words", "file", "at", "n")
    regions_of = shared.write_table(_meet_at_ends(found), folder, "regions")
    links = shared.write_table(_verified(regions_of, places, store), folder, "links")
    rest = _unsettled(found, _classes(links, f"{folder}/first"), folder)
    more = shared.write_table(_rest_links(rest, places, store, f"{folder}/rest_of"), folder, "more_links")
    named = places.join(texts, "text_hash")
    whole = named.where((F.col("copies") > 1) & (F.col("words") >= PASSAGE_WORDS)).select(F.col("node").alias("n1"), F.lit(0).alias("s1"), F.col("words").alias("e1"), F.col("node").alias("n2"), F.lit(0).alias("s2"), F.col("words").alias("e2"))
    placed = _classes(links.unionByName(more).unionByName(whole), f"{folder}/all").join(named.select("node", "text_hash", "copies"), "node")
    placed = shared.write_table(placed.groupBy("text_hash", "from", "to", "label").agg(F.first("copies").alias("copies")), folder, "placed")
    # a text may have several passages: each goes to all documents with the text
    spread = shared.write_table(join_sized(hashed, placed.groupBy("text_hash").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("label", "from", "to")).alias("p")), "text_hash", "copies", documents).select("k", F.explode("p").alias("p")).select("k", "p.*").distinct(), folder, "spread")
    each = spread.groupBy("label", "k").agg(F.count("*").alias("rows")).groupBy("label").agg(F.min("k").alias("class_id"), F.count("*").alias("class_docs"), F.sum("rows").alias("rows"))
    each = shared.write_table(each.where("class_docs > 1"), folder, "sizes")
    return join_sized(spread, each, "label", "rows", spread.count()).select(F.col("k").alias(key), F.col("from").alias("start_word"), F.col("to").alias("end_word"), "class_id", "class_docs")


def _islands(ends: DataFrame) -> DataFrame:
    """ends (node, s, e) with from and to: overlapping stretches of one text are one."""
    order = W.partitionBy("node").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ends.withColumn("new", F.when(reach.isNull() | (F.col("s") >= reach), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy("node", "island")
    return numbered.select("node", "s", "e", F.min("s").over(island).alias("from"), F.max("e").over(island).alias("to"))
