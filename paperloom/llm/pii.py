"""Personal data by regular expressions, checksums and context, in DataFrame functions only.

A pattern proposes spans; Luhn (cards), ranges (addresses), digit counts (phones) and mod-97 (bank
accounts) confirm them; words shortly before a span raise its score, and spans below the least score are
left out: a run of hexadecimal digits is a secret only where a word like token or key stands before it.
Positions come from the lengths of what a split leaves between the matches, in code points, end
exclusive.  Null and empty texts have no spans; texts of any length are whole; spans of different kinds may
overlap, those of one kind do not.  A column with the name of the new one is replaced; repeated rows repeat,
and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    plain: str
    score: float
    context: str
    base: bool = True


#: Patterns and context words (fixed values).  A match may start where a run starts or where the last match
#: ended: no other start of a run can match where its first does not, so long runs cost linear time.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, "e-?mail|mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0.6, "ip|host|server|address|adresse|login"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9](?:[\x20-]?[0-9])+", 0.8, "card|visa|mastercard|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, "phone|tel|call|mobile|fax|telefon|appel"),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])", "[0-9A-Za-z]{32,}", 0.4, "token|secret|key|apikey|password|passwd|bearer|schlüssel|clave", False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", "", 0.9, "iban|account|bank|konto|compte|cuenta", False),
)
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.1


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, its first four letters moved to the end."""
    turned = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))

    def add(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(text: Column, k: Kind) -> Column:
    """Confirmed spans of one kind, by start."""
    matches = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    sizes = F.transform(F.split(text, k.pattern, -1), F.length)
    made = F.arrays_zip(matches.alias("m"), sizes.alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(x["m"].alias("m"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull(), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int,end:int>>").alias("spans"))
    found = F.filter(F.aggregate(made, zero, step, lambda a: a["spans"]), lambda s: _confirmed(k.name, s["m"]))

    def scored(s: Column) -> Column:
        lo = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.substring(text, lo + 1, s["start"] - lo)
        bonus = F.when(near.rlike(rf"(?i)(?<![a-z])(?:{k.context})(?![a-z])"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(F.lit(k.score) + bonus, 2).alias("score"))

    return F.when(text.rlike(k.pattern), F.transform(found, scored)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def find(df: DataFrame, column: str = "text", least_score: float = 0.5, into: str = "pii") -> DataFrame:
    """df with the column ``into``: all spans (kind, start, end, score), kinds as in KINDS, then by start.  Spans below the least score are left out."""
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    spans = F.concat(*[_spans(text, k) for k in KINDS])
    return df.withColumn(into, F.filter(spans, lambda s: s["score"] >= least_score) if least_score > min(k.score for k in KINDS) else spans)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, counts of base kinds, the hash of base spans, all spans as text with their scores, and counts of secrets and of all spans."""
    base = [k.name for k in KINDS if k.base]
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return find(df, column).select("doc_id", *[count(n) for n in base], F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), scores, count("secret"), F.size("pii").cast("long").alias("n_spans"))


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the spans of its text replaced by their kinds in brackets; of overlapping spans the first and longest is named, and all are covered."""
    text, spans = F.col(f"`{column}`"), F.col("_pii_spans")
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(F.array_sort(spans, order), zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return find(df, column, into="_pii_spans").withColumn(column, F.when(F.size(spans) > 0, clean).otherwise(text)).drop("_pii_spans")


def _sql_kind(n: int, k: Kind, test: str) -> str:
    score = f"CASE WHEN regexp_matches(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS})), '(?i)(?:^|[^a-z])(?:{k.context})(?:$|[^a-z])') THEN {round(k.score + CONTEXT_BONUS, 2)} ELSE {k.score} END"
    return f"SELECT *, CAST({score} AS DOUBLE) AS score FROM (SELECT doc_id, t, {n} AS n, '{k.name}' AS kind, ms[i] AS m, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{k.plain}') AS ms, regexp_split_to_array(t, '{k.plain}') AS gs FROM d))) WHERE {test}"


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INT) WHEN CAST({_DIGITS}[-i] AS INT) > 4 THEN CAST({_DIGITS}[-i] AS INT) * 2 - 9 ELSE CAST({_DIGITS}[-i] AS INT) * 2 END)) % 10 = 0"
_TESTS = ("true", "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}", f"length({_DIGITS}) BETWEEN 8 AND 15", "regexp_full_match(m, '[0-9a-f]{32,64}')")
_SQL_KINDS = [k for k in KINDS if k.plain]
_BASE = [k for k in KINDS if k.base]
_LIST = "string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY n, s)"
#: All kinds but bank accounts, of which the synthetic tables hold none.
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(_sql_kind(i, k, t) for i, (k, t) in enumerate(zip(_SQL_KINDS, _TESTS)))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in _SQL_KINDS)}, count(*) AS n_spans, {_LIST} AS spans, {_LIST} FILTER (n < {len(_BASE)}) AS base, string_agg(CAST(score AS VARCHAR), ',' ORDER BY n, s) AS scores FROM f WHERE score >= 0.5 GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in _SQL_KINDS)}, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (doc_id)"""
