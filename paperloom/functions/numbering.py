"""Numbers as text: roman, alphabetic, Bates, and the separator styles of form fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits by place (fixed values).
_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]


def roman(n: Column) -> Column:
    """Roman digits of 1..3999; other numbers in plain digits."""
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i.cast("int") + 1)
    safe = F.when(n.between(1, 3999), n).otherwise(F.lit(1))
    text = F.concat(F.repeat(F.lit("M"), F.floor(safe / 1000).cast("int")), pick(_HUNDREDS, F.floor(safe / 100) % 10), pick(_TENS, F.floor(safe / 10) % 10), pick(_ONES, safe % 10))
    return F.when(n.between(1, 3999), text).otherwise(n.cast("string"))


def alpha(n: Column) -> Column:
    """A..Z, AA, AB …: bijective base 26, up to four letters; numbers below 1 in plain digits."""
    letter = lambda x: F.chr((x + 65).cast("int"))
    m = n.cast("long") - 1
    out = F.lit(None).cast("string")
    first, size = 0, 26
    for width in range(1, 5):
        rest = m - first
        text = F.concat(*[letter(F.floor(rest / 26 ** (width - 1 - i)) % 26) for i in range(width)])
        out = F.when(out.isNull() & (m < first + size), text).otherwise(out)
        first, size = first + size, size * 26
    return F.when(n >= 1, out).otherwise(n.cast("string"))


def bates(n: Column, prefix: str = "", suffix: str = "", digits: int = 6) -> Column:
    """Prefix, zero-padded number, suffix; digits are clamped to 3..15 and longer numbers stay whole."""
    digits = min(max(digits, 3), 15)
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0")), F.lit(suffix))


def number(x: Column, decimals: int = 2, style: int = 0, currency: str = "", before: bool = True) -> Column:
    """A number in one of the separator styles 0-3: ``1,234.56``, ``1234.56``, ``1.234,56``, ``1234,56``; null stays null."""
    text = F.format_number(F.abs(x), decimals)
    if style == 1:
        text = F.translate(text, ",", "")
    elif style == 2:
        text = F.translate(text, ",.", ".,")
    elif style == 3:
        text = F.translate(F.translate(text, ",", ""), ".", ",")
    text = F.concat(F.lit(currency), text) if before else F.concat(text, F.lit(currency))
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def negative_style(x: Column, text: Column, style: int) -> Column:
    """Negative numbers: 0 and 1 with a minus sign, 2 and 3 in parentheses."""
    return F.when((x < 0) & F.lit(style >= 2), F.concat(F.lit("("), F.regexp_replace(text, "^-", ""), F.lit(")"))).otherwise(text)


def percent(x: Column, decimals: int = 2, style: int = 0) -> Column:
    return F.concat(number(x * 100, decimals, style), F.lit("%"))
