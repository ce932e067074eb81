"""Functions of this library under SQL names: scalar functions as expressions, table functions as generators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="match_no int, start int, end int, match string")
class Matches:
    """The matches of a pattern in a text; a pattern that does not parse matches nothing."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        try:
            found = re.finditer(pattern, text or "", re.M)
        except re.error:
            return
        for i, m in enumerate(found, 1):
            yield i, m.start(), m.end(), m[0]


@udtf(returnType="line_no int, line string")
class Lines:
    """The lines of a text, from 1."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, line in enumerate(re.split("\r\n|\r|\n", text or ""), 1):
            yield i, line


#: SQL expressions of scalar functions: name, parameters, body (they are inlined, so the engine optimises them).
_ONES, _TENS = "array('', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX')", "array('', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC')"
_HUNDREDS = "array('', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM')"
SCALARS = {
    "paperloom_roman": ("n INT", "STRING", f"CASE WHEN n BETWEEN 1 AND 3999 THEN concat(repeat('M', CAST(n DIV 1000 AS INT)), {_HUNDREDS}[CAST(n DIV 100 % 10 AS INT)], {_TENS}[CAST(n DIV 10 % 10 AS INT)], {_ONES}[n % 10]) ELSE CAST(n AS STRING) END"),
    "paperloom_bates": ("n INT, prefix STRING, suffix STRING", "STRING", "concat(prefix, lpad(CAST(n AS STRING), 6, '0'), suffix)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the table functions and the scalar functions for a session; returns their names."""
    tables = {"paperloom_matches": Matches, "paperloom_lines": Lines}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [*tables, *SCALARS]

