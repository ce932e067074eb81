"""Form records: import, export, mail-merge and field aggregates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def import_table(df: DataFrame, order: list[str], columns: list[str] | None = None, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Columns as text with null as '', the first ``max_rows`` rows by the order and the first ``max_columns`` columns."""
    names = (columns or df.columns)[:max_columns]
    rows = df.orderBy(*order).limit(max_rows) if max_rows is not None else df
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def mail_merge(df: DataFrame, template: str, fields: dict[str, str], key: str) -> DataFrame:
    """(key, text): the template with ``{{name}}`` filled from columns; null fills '', a name without a column stays."""
    text = reduce(lambda t, f: F.replace(t, F.lit("{{" + f[0] + "}}"), F.coalesce(F.col(f[1]).cast("string"), F.lit(""))), fields.items(), F.lit(template))
    return df.select(key, text.alias("text"))


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Form fields (doc, name, value) with values of the same names; ``filled`` says which."""
    v = values.select("doc", "name", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    return fields.join(v, ["doc", "name"], "left").withColumn("value", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value"))).withColumn("filled", F.coalesce("_hit", F.lit(False))).drop("_new", "_hit")


def calculate(df: DataFrame, keys: list[str], value: str, names: tuple[str, ...] = ("SUM", "AVG", "PRD", "MIN", "MAX")) -> DataFrame:
    """Aggregates of a field: of no values they are 0; where a value is missing there is no result (null)."""
    make = {"SUM": F.sum, "AVG": F.avg, "PRD": F.product, "MIN": F.min, "MAX": F.max}
    whole = F.count("*") == F.count(value)
    return df.groupBy(*keys).agg(*[F.when(whole, F.coalesce(make[n](value).cast("double"), F.lit(0.0))).alias(n.lower()) for n in names])


def to_json(df: DataFrame, fields: list[str]) -> Column:
    """A JSON object of the fields; null fields are left out."""
    return F.to_json(F.struct(*fields))


def from_json(text: Column, names: list[str]) -> list[Column]:
    """Field values of a JSON object as text."""
    return [F.get_json_object(text, f"$.{n}").alias(n) for n in names]


def to_fdf(df: DataFrame, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """(key, fdf): the fields (name, value) of a record in FDF syntax, by name."""
    esc = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\()])", r"\\$1")
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: F.concat(F.lit("<< /T ("), esc(x["n"]), F.lit(") /V ("), esc(x["v"]), F.lit(") >>"))), "\n")
    return rows.select(key, F.concat(F.lit("%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n"), body, F.lit("\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF")).alias("fdf"))


_STRING = r"\(((?:[^\\()]|\\.)*)\)"


def from_fdf(df: DataFrame, key: str, column: str = "fdf") -> DataFrame:
    """(key, name, value) of the fields of FDF text."""
    plain = lambda c: F.regexp_replace(c, r"\\([\\()])", "$1")
    pairs = F.regexp_extract_all(F.col(column), F.lit(rf"/T\s*{_STRING}\s*/V\s*{_STRING}"), F.lit(0))
    one = df.select(key, F.explode(pairs).alias("p"))
    return one.select(key, plain(F.regexp_extract("p", rf"/T\s*{_STRING}", 1)).alias("name"), plain(F.regexp_extract("p", rf"/V\s*{_STRING}", 1)).alias("value"))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def to_xml(df: DataFrame, key: str, fields: list[str], root: str = "fields") -> DataFrame:
    """(key, xml): a field element for each column, null as an empty one."""
    parts = [F.concat(F.lit(f'<field name="{f}"><value>'), _escape(F.col(f).cast("string")), F.lit("</value></field>")) for f in fields]
    return df.select(key, F.concat(F.lit(f"<{root}>"), *parts, F.lit(f"</{root}>")).alias("xml"))


def from_xml(df: DataFrame, key: str, column: str = "xml") -> DataFrame:
    """(key, name, value) of field elements."""
    pairs = F.regexp_extract_all(F.col(column), F.lit(r'<field name="([^"]*)"><value>([^<]*)</value>'), F.lit(0))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    one = df.select(key, F.explode(pairs).alias("p"))
    return one.select(key, F.regexp_extract("p", 'name="([^"]*)"', 1).alias("name"), plain(F.regexp_extract("p", "<value>([^<]*)</value>", 1)).alias("value"))


def pivot_records(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows (key, name, value) as one row a record; the names are given, so no pass is needed to find them."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def first_of_each(df: DataFrame, group: str, by: str, tie: str, n: int, descending: bool = True) -> DataFrame:
    """The first n rows of each group by one key, ties by id."""
    c = F.col(by).desc() if descending else F.col(by).asc()
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(c, tie))).where(F.col("place") <= n)


def to_xfdf(df: DataFrame, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """(key, xfdf): the fields (name, value) of a record as XML, by name."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: F.concat(F.lit('<field name="'), _escape(x["n"]), F.lit('"><value>'), _escape(x["v"]), F.lit("</value></field>"))), "")
    return rows.select(key, F.concat(F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'), body, F.lit("</fields></xfdf>")).alias("xfdf"))


def from_xfdf(df: DataFrame, key: str, column: str = "xfdf") -> DataFrame:
    """(key, name, value) of the field elements of XFDF text."""
    return from_xml(df, key, column)


def json_status(df: DataFrame, key: str, column: str, names: list[str]) -> DataFrame:
    """(key, name, value, status): a row for each field of a JSON object; status is ok, missing, or invalid where the text is no JSON."""
    valid = F.try_parse_json(F.col(column)).isNotNull()
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.get_json_object(F.col(column), f"$.{n}").alias("value")) for n in names])
    rows = df.select(key, valid.alias("_valid"), F.explode(each).alias("f")).select(key, "_valid", "f.*")
    return rows.select(key, "name", "value", F.when(~F.col("_valid"), "invalid").when(F.col("value").isNull(), "missing").otherwise("ok").alias("status"))


def edit(fields: DataFrame, add: DataFrame | None = None, remove: list[str] | None = None, rename: dict[str, str] | None = None, copy: dict[str, str] | None = None) -> DataFrame:
    """Form fields (doc, name, …) with fields renamed, copied under another name, added and removed, in this order."""
    out = fields
    for old, new in (rename or {}).items():
        out = out.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))
    for old, new in (copy or {}).items():
        out = out.unionByName(out.where(F.col("name") == old).withColumn("name", F.lit(new)))
    if add is not None:
        out = out.unionByName(add, allowMissingColumns=True)
    return out.where(~F.col("name").isin(remove)) if remove else out


_TOKEN = re.compile(r"\s*(?:([0-9]+(?:\.[0-9]+)?)|([A-Za-z_][A-Za-z0-9_.]*)|([-+*/(),]))")


def arithmetic(expression: str, fields: dict[str, Column]) -> Column:
    """An expression over fields (+ - * / and brackets, with the usual ranks) as a column of doubles; a missing field counts 0, and so does a division by 0."""
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"not an expression: {expression[at:]}")
        tokens.append(m)
        at = m.end()
    tokens.append(None)
    place = 0

    def mark() -> str | None:
        return tokens[place][3] if tokens[place] else None

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1]

    def atom() -> Column:
        m = take()
        if m is None:
            raise ValueError("the expression ends too soon")
        if m[1]:
            return F.lit(float(m[1]))
        if m[2]:
            if m[2] not in fields:
                raise ValueError(f"no field {m[2]}")
            return F.coalesce(fields[m[2]].cast("double"), F.lit(0.0))
        if m[3] == "-":
            return -atom()
        if m[3] == "(":
            inside = total()
            if (end := take()) is None or end[3] != ")":
                raise ValueError("a bracket is not closed")
            return inside
        raise ValueError(f"{m[3]} stands where a value must")

    def product() -> Column:
        out = atom()
        while mark() in ("*", "/"):
            times = take()[3] == "*"
            other = atom()
            out = out * other if times else F.coalesce(F.try_divide(out, other), F.lit(0.0))
        return out

    def total() -> Column:
        out = product()
        while mark() in ("+", "-"):
            plus = take()[3] == "+"
            other = product()
            out = out + other if plus else out - other
        return out

    out = total()
    if tokens[place] is not None:
        raise ValueError("the expression goes on after its end")
    return out


def bind_xml(df: DataFrame, key: str, column: str, row: str, fields: dict[str, str]) -> DataFrame:
    """(key, row_no, fields): for each element of a name the text of the paths below it; a missing one is null.  Elements of the name hold none of the same name."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.:-]*", row):
        raise ValueError(f"not an element's name: {row}")
    element = rf"(?s)<{row}(?:\s[^>]*)?(?:/>|>.*?</{row}>)"
    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(element), F.lit(0))).alias("_i", "_x"))
    values = [F.get(F.xpath("_x", F.lit(f"/{row}/{path}/text()")), 0).alias(name) for name, path in fields.items()]
    return rows.select(key, (F.col("_i") + 1).alias("row_no"), *values)


def xfa_value(xml: Column, path: str) -> Column:
    """The value at a dotted path of form data (name[i] counts from 0); null where there is none."""
    steps = [re.fullmatch(r"([^\[]+)(?:\[([0-9]+)\])?", s) for s in path.split(".")]
    if not all(steps):
        raise ValueError(f"not a path: {path}")
    place = "/".join(f"*[local-name()='{m[1]}'][{int(m[2] or 0) + 1}]" for m in steps)
    return F.get(F.xpath(xml, F.lit(f"//*[local-name()='data']/{place}/text()")), 0)


def with_xfa_value(xml: Column, name: str, value: Column) -> Column:
    """Form data with the text of the first element of a name replaced."""
    pattern = rf"(?s)^(.*?<{re.escape(name)}(?:\s[^>]*)?>)[^<]*(</{re.escape(name)}>.*)$"
    return F.when(xml.rlike(pattern), F.concat(F.regexp_extract(xml, pattern, 1), _escape(value), F.regexp_extract(xml, pattern, 2))).otherwise(xml)


def totals(df: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """Measures of each group, with rows of subtotals (the last keys null) and of the whole."""
    return df.rollup(*keys).agg(*[c.alias(n) for n, c in measures.items()])
