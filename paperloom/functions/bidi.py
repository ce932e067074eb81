"""Right-to-left text in drawn order to reading order, and back, by the levels of the Unicode bidirectional algorithm.

A text's character classes are one string of letters; the rules on weak and neutral classes are
substitutions in it, from which each character's level follows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters for the classes of characters (fixed values); isolates and embeddings count as marks without width.
_LETTER = {"L": "L", "R": "R", "AL": "A", "EN": "E", "ES": "+", "ET": "$", "AN": "N", "CS": ",", "NSM": "M", "BN": "B", "B": "S", "S": "S", "WS": "W", "ON": "O"}
#: Ranges that hold right-to-left letters (fixed values).
RTL = "[֐-࠿יִ-﷿ﹰ-﻾]"


def _spread(classes: str, pattern: str, new: str) -> str:
    """Each match of the pattern as so many of the new letter."""
    return re.sub(pattern, lambda m: new * len(m[0]), classes)


def levels(text: str, base: int | None = None) -> list[int]:
    """The level of each character; the base level is that of the first strong character, unless it is given."""
    t = "".join(_LETTER.get(unicodedata.bidirectional(c), "B") for c in text)
    if base is None:
        strong = re.search("[LRA]", t)
        base = int(bool(strong) and strong[0] != "L")
    edge = "LR"[base]
    t = re.sub("(.)(M+)", lambda m: m[1] + m[1] * len(m[2]), _spread(t, "^M+", edge))
    t = re.sub("A[^LR]*", lambda m: m[0].replace("E", "N"), t)  # numbers after Arabic letters
    t = t.replace("A", "R")
    t = re.sub(r"(?<=E)[+,](?=E)", "E", t)
    t = re.sub(r"(?<=N),(?=N)", "N", t)
    t = _spread(t, r"\$+(?=E)|(?<=E)\$+", "E")
    t = re.sub(r"[+$,]", "O", t)
    t = re.sub(r"(^|[LR])([^LR]*)", lambda m: m[1] + (m[2].replace("E", "L") if (m[1] or edge) == "L" else m[2]), t)
    side = lambda c: "L" if c == "L" else "R" if c in "REN" else edge

    def neutral(m: re.Match) -> str:
        a, b = (side(t[i]) if 0 <= i < len(t) else edge for i in (m.start() - 1, m.end()))
        return (a if a == b else edge) * len(m[0])

    done = re.sub("[OWSB]+", neutral, t)
    out = [base + {"L": base % 2, "R": 1 - base % 2, "E": 2 - base % 2, "N": 2 - base % 2}[c] for c in done]
    first = "".join(_LETTER.get(unicodedata.bidirectional(c), "B") for c in text)
    for m in re.finditer("[WB]*(?:S|$)", first):  # white space at the end of a line or before a tab
        out[m.start() : m.end()] = [base] * (m.end() - m.start())
    return out


def reorder(text: str | None, base: int | None = None) -> str | None:
    """The text with its runs of each level turned, the highest first; turned twice it is as before."""
    if not text or not re.search(RTL, text):
        return text
    lines = []
    for line in re.split("(\r\n|\n|\r)", text):
        level, order = levels(line, base), list(range(len(line)))
        for depth in range(max(level, default=0), 0, -1):
            for m in re.finditer("1+", "".join("1" if level[i] >= depth else "0" for i in order)):
                order[m.start() : m.end()] = order[m.start() : m.end()][::-1]
        lines.append("".join(line[i] for i in order))
    return "".join(lines)


def reordered(text: Column, base: int | None = None) -> Column:
    """Reading order of a column of drawn text; texts without right-to-left letters stay."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: reorder(v, base))

    return F.pandas_udf(run, "string")(text)
