"""Registered queries of the document operators, each with SQL over the same tables.

The driver tables stand for documents: texts for extracted text, conversations for documents with
pages (page_no = turn + 1), web pages for HTML, the sales tables for tabular input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import calculator, crypto, geometry, numbering, strings
from paperloom.operators import checks, compare, edits, graphs, pages, records, search
from paperloom.sources import html, markdown, pdf
from paperloom.streaming import files as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")


_P = "(SELECT conv_id AS doc, CAST(turn + 1 AS INT) AS page_no, text FROM conversations)"

# --- search -----------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(regexp_extract_all(text, 'the[ \x{00A0}]{1}\x{00A0}?of')) AS hits FROM documents WHERE regexp_matches(text, 'the[ \x{00A0}]{1}\x{00A0}?of')")
def search_literal_hits(spark, d):
    return search.hits(table(spark, d, "documents"), search.pattern("the of"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ing')) AS hits FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ing')")
def search_regex_hits(spark, d):
    return search.hits(table(spark, d, "documents"), search.pattern("[A-Z][a-z]+ing", regex=True))


@query(r"SELECT doc_id, len(regexp_extract_all(t, '(?i)\bthe\b')) AS hits FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'a', 'g') AS t FROM documents) WHERE regexp_matches(t, '(?i)\bthe\b')")
def search_ci_whole_word(spark, d):
    plain = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "a").alias("text"))
    return search.hits(plain, search.pattern("THE", case_sensitive=False, whole_word=True))


@query("SELECT doc_id, pattern, hits FROM (SELECT doc_id, 'digits' AS pattern, len(regexp_extract_all(text, '[0-9]+')) AS hits FROM documents UNION ALL SELECT doc_id, 'capital', len(regexp_extract_all(text, '[A-Z]')) FROM documents UNION ALL SELECT doc_id, 'email', len(regexp_extract_all(text, '[a-z.0-9]+@[a-z0-9.]+')) FROM documents) WHERE hits > 0")
def search_multi_pattern(spark, d):
    return search.multi(table(spark, d, "documents"), {"digits": "[0-9]+", "capital": "[A-Z]", "email": "[a-z.0-9]+@[a-z0-9.]+"})


@query("SELECT doc_id, CAST(i AS INT) AS match_no, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start, m[i] AS match FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS m, regexp_split_to_array(text, '[0-9]{2,}') AS g FROM documents))")
def search_positions(spark, d):
    return search.fragments(table(spark, d, "documents"), search.pattern("[0-9]{2,}", regex=True)).drop("end")


@query("SELECT doc, len(regexp_extract_all(t, '[.]\\s+[A-Z]')) AS hits FROM (SELECT doc, string_agg(text, chr(13) || chr(10) ORDER BY page_no) AS t FROM " + _P + " GROUP BY doc) WHERE regexp_matches(t, '[.]\\s+[A-Z]')")
def search_cross_page(spark, d):
    return search.across_pages(_pages(spark, d), search.pattern(r"[.]\s+[A-Z]", regex=True)).groupBy("doc").agg(F.count("*").alias("hits"))


@query("SELECT p_partkey FROM part JOIN (VALUES (900.0, 1000.0, 10, 20), (1200.0, 1300.0, 30, 50)) b(a1, a2, s1, s2) ON p_retailprice BETWEEN a1 AND a2 AND p_size BETWEEN s1 AND s2")
def search_in_rectangles(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit(0).alias("doc"), F.lit(1).alias("page_no"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    boxes = spark.createDataFrame([(0, 1, 900.0, 10.0, 1000.0, 20.0), (0, 1, 1200.0, 30.0, 1300.0, 50.0)], "doc int, page_no int, llx double, lly double, urx double, ury double")
    return search.in_boxes(rows, boxes).select("p_partkey")


# --- edits ------------------------------------------------------------------------------------------


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
def replace_all(spark, d):
    return table(spark, d, "documents").select("doc_id", edits.replace_all(F.col("text"), "the", "THE").alias("text"))


@query("SELECT doc_id, regexp_replace(text, 'the', 'THE') AS text FROM documents")
def replace_first(spark, d):
    return table(spark, d, "documents").select("doc_id", edits.replace_text(F.col("text"), "the", "THE", True, True).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM documents")
def redact_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(edits.redact(F.col("text"), "[0-9]", "#"), "text").alias("text"))


@query("SELECT doc_id, (i - 1) // 20 + 1 AS page_no, string_agg(l[i], chr(10) ORDER BY i) AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents)) GROUP BY doc_id, (i - 1) // 20 + 1")
def paginate_lines(spark, d):
    return edits.paginate(table(spark, d, "documents"), height=288.0, size=12.0)


@query("SELECT doc_id, line_no, line FROM (SELECT doc_id, l, i, c, row_number() OVER (PARTITION BY doc_id ORDER BY i, c) AS line_no, substr(l[i], CAST(c * 60 + 1 AS INT), 60) AS line FROM (SELECT doc_id, l, i, unnest(range(0, greatest(CAST(ceil(length(l[i]) / 60.0) AS BIGINT), 1))) AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))")
def wrap_lines(spark, d):
    return edits.wrap(table(spark, d, "documents"), 60)


@query(f"SELECT doc, page_no, 'DOC-' || lpad(CAST(99 + page_no AS VARCHAR), 6, '0') || '-X' AS bates FROM {_P}")
def bates_number(spark, d):
    return _pages(spark, d).select("doc", "page_no", numbering.bates(F.col("page_no") + 99, "DOC-", "-X").alias("bates"))


# --- pages ------------------------------------------------------------------------------------------

_NUMBER = "CAST(row_number() OVER (PARTITION BY doc ORDER BY part, p) AS INT) AS page_no"


@query(f"SELECT doc, {_NUMBER}, text FROM (SELECT doc // 3 AS doc, doc AS part, page_no AS p, text FROM {_P})")
def pages_concat(spark, d):
    return pages.merge(_pages(spark, d), F.floor(F.col("doc") / 3), F.col("doc"))


@query(f"SELECT doc, {_NUMBER}, text FROM (SELECT doc, 0 AS part, page_no AS p, text FROM {_P} UNION ALL SELECT DISTINCT doc, 1, 1, '' FROM {_P} UNION ALL SELECT doc, 2, page_no, text FROM {_P})")
def pages_blank_between(spark, d):
    return pages.blank_between(_pages(spark, d), [""], _pages(spark, d))


@query(f"SELECT doc, {_NUMBER}, text FROM (SELECT doc, 0 AS part, page_no AS p, text FROM {_P} UNION ALL SELECT doc - 1, 1, page_no, text FROM {_P} WHERE page_no BETWEEN 1 AND 2 AND doc > 0)")
def pages_append(spark, d):
    p = _pages(spark, d)
    return pages.append_range(p, p.where("doc > 0").withColumn("doc", F.col("doc") - 1), 0, 2)


@query(f"SELECT doc, {_NUMBER}, text FROM (SELECT doc, CASE WHEN page_no <= 1 THEN 0 ELSE 2 END AS part, page_no AS p, text FROM {_P} UNION ALL SELECT doc, 1, page_no, 'inserted: ' || text FROM {_P} WHERE page_no = 2)")
def pages_insert(spark, d):
    p = _pages(spark, d)
    return pages.insert_after(p, 1, p.where("page_no = 2").withColumn("text", F.concat(F.lit("inserted: "), "text")))


@query(f"SELECT doc, CAST(page_no - 1 AS INT) AS page_no, text FROM {_P} WHERE page_no > 1")
def pages_delete(spark, d):
    return pages.delete(_pages(spark, d), [1, 1])


@query(f"SELECT doc, CAST(page_no - 1 AS INT) AS page_no, text FROM {_P} WHERE page_no BETWEEN 2 AND 3")
def pages_extract_range(spark, d):
    return pages.extract_range(_pages(spark, d), 2, 3)


@query(f"SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_no) AS INT) AS page_no, text FROM {_P} WHERE page_no IN (1, 3)")
def pages_extract_set(spark, d):
    return pages.extract_set(_pages(spark, d), [3, 1, 3, 99])


@query(f"SELECT doc, b AS part, CAST(row_number() OVER (PARTITION BY doc, b ORDER BY page_no) AS INT) AS page_no, text FROM {_P}, (VALUES (1, 1, 2), (2, 2, 4)) v(b, lo, hi) WHERE page_no BETWEEN lo AND hi")
def pages_split_bulks(spark, d):
    return pages.split_bulks(_pages(spark, d), [(1, 2), (2, 4)])


@query(f"SELECT doc, page_no AS part, 1 AS page_no, text FROM {_P}")
def pages_split_single(spark, d):
    return pages.split_single(_pages(spark, d))


@query(f"""SELECT doc, CAST(k AS INT) AS sheet, side, position, CAST(CASE WHEN p <= n THEN p END AS INT) AS page_no FROM (
SELECT doc, n, k, unnest(['front', 'front', 'back', 'back']) AS side, unnest([1, 2, 1, 2]) AS position, unnest([m - 2 * k, 2 * k + 1, 2 * k + 2, m - 2 * k - 1]) AS p FROM (
SELECT doc, n, m, unnest(range(0, m // 4)) AS k FROM (SELECT doc, count(*) AS n, CAST(ceil(count(*) / 4.0) * 4 AS BIGINT) AS m FROM {_P} GROUP BY doc)))""")
def pages_booklet(spark, d):
    return pages.booklet(_pages(spark, d))


@query(f"SELECT doc, page_no, text, CAST((page_no - 1) // 4 AS INT) AS sheet, CAST(((page_no - 1) % 4) // 2 AS INT) AS \"row\", CAST((page_no - 1) % 2 AS INT) AS col FROM {_P}")
def pages_nup(spark, d):
    return pages.n_up(_pages(spark, d), 2, 2)


@query(f"SELECT doc, page_no, CASE WHEN page_no <= 2 THEN ['i', 'ii'][page_no] ELSE 'A-' || chr(CAST(64 + 24 + page_no - 2 AS INT)) END AS label FROM {_P} WHERE page_no <= 4 UNION ALL SELECT doc, page_no, 'A-A' || chr(CAST(64 + page_no - 4 AS INT)) FROM {_P} WHERE page_no > 4")
def page_labels(spark, d):
    p = _pages(spark, d)
    docs = p.select("doc").distinct()
    ranges = docs.select("doc", F.explode(F.expr("array(named_struct('start', 0, 'style', 'r', 'prefix', cast(null as string), 'first', 1), named_struct('start', 2, 'style', 'A', 'prefix', 'A-', 'first', 25))")).alias("r")).select("doc", "r.*")
    return pages.labels(p, ranges).select("doc", "page_no", "label")


@query("SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 3999 THEN repeat('M', CAST(n // 1000 AS INT)) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] ELSE CAST(n AS VARCHAR) END AS roman FROM (SELECT o_orderkey, o_custkey AS n FROM orders)")
def roman_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbering.roman(F.col("o_custkey")).alias("roman"))


# --- lookups ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_equi(spark, d):
    return graphs.link_rows(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), "n_nationkey").select("c_custkey", "n_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def lookup_semi(spark, d):
    return graphs.referenced(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_anti(spark, d):
    return graphs.unreferenced(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("SELECT p_partkey, b AS band FROM part JOIN (VALUES (1, 900.0, 1000.0), (2, 1000.0, 1500.0), (3, 1500.0, 2500.0)) v(b, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi")
def lookup_range(spark, d):
    bands = [(1, 900.0, 1000.0), (2, 1000.0, 1500.0), (3, 1500.0, 2500.0)]
    return graphs.banded(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bands, "band").select("p_partkey", "band")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def lookup_asof(spark, d):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return graphs.as_of(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], bought, "last_purchase").select("event_id", "last_purchase")


# --- records ----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, sum(l_tax) AS sum, avg(l_tax) AS avg, product(l_quantity) AS prd, min(l_tax) AS min, max(l_tax) AS max FROM lineitem GROUP BY l_orderkey")
def form_sum_avg_prd_min_max(spark, d):
    rows = table(spark, d, "lineitem")
    tax = records.calculate(rows, ["l_orderkey"], "l_tax", ("SUM", "AVG", "MIN", "MAX"))
    return tax.join(records.calculate(rows, ["l_orderkey"], "l_quantity", ("PRD",)), "l_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def form_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", *records.from_json(F.col("props"), ["page", "ref"]))


@query("SELECT c_custkey, 'Dear ' || c_name || ', segment ' || coalesce(c_mktsegment, '') || ', balance ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '. {{unknown}}' AS text FROM customer")
def mail_merge(spark, d):
    rows = table(spark, d, "customer").withColumn("balance", F.floor("c_acctbal"))
    return records.mail_merge(rows, "Dear {{name}}, segment {{segment}}, balance {{balance}}. {{unknown}}", {"name": "c_name", "segment": "c_mktsegment", "balance": "balance"}, "c_custkey")


@query("SELECT coalesce(CAST(p_partkey AS VARCHAR), '') AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_brand, '') AS p_brand FROM part ORDER BY part.p_partkey LIMIT 100")
def table_import_caps(spark, d):
    return records.import_table(table(spark, d, "part"), ["p_partkey"], max_rows=100, max_columns=3)


@query("SELECT n_nationkey, '<fields><field name=\"n_name\"><value>' || n_name || '</value></field><field name=\"n_regionkey\"><value>' || n_regionkey || '</value></field></fields>' AS xml FROM nation")
def form_xml_export(spark, d):
    return records.to_xml(table(spark, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def form_fdf_round_trip(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.struct(F.lit("name").alias("name"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value")))).alias("f")).select("c_custkey", "f.*")
    back = records.from_fdf(records.to_fdf(rows, "c_custkey"), "c_custkey")
    return records.pivot_records(back, "c_custkey", ["name", "segment"])


@query("SELECT * FROM (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS place FROM documents) WHERE place <= 5")
def portfolio_sort_topk(spark, d):
    return records.first_of_each(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 5)


# --- functions --------------------------------------------------------------------------------------

_MONEY = "format('{:,.2f}', p_retailprice)"


@query(f"SELECT p_partkey, {_MONEY} AS s0, replace({_MONEY}, ',', '') AS s1, translate({_MONEY}, ',.', '.,') AS s2, replace(replace({_MONEY}, ',', ''), '.', ',') AS s3 FROM part")
def format_number_styles(spark, d):
    return table(spark, d, "part").select("p_partkey", *[numbering.number(F.col("p_retailprice"), 2, s).alias(f"s{s}") for s in range(4)])


@query("SELECT l_orderkey, l_linenumber, format('{:.0f}', l_discount * 100) || '%' AS discount FROM lineitem")
def format_percent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbering.percent(F.col("l_discount"), 0).alias("discount"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice / 2 ELSE p_retailprice * 3 END AS a, floor(p_retailprice / 7 + 0.5) + (p_size % 5) AS b, sin(radians(p_size)) + degrees(atan2(p_size, 10)) AS c, CAST(p_size & 12 AS DOUBLE) AS e FROM part")
def ps_calculator(spark, d):
    x, s = F.col("p_retailprice"), F.col("p_size")
    run = calculator.program
    a = run("{ dup 25 gt { pop 2 div } { pop 3 mul } ifelse }", x, s)[0]
    b = run("{ exch 7 div round exch 5 mod add }", x, s)[0]
    c = run("{ dup sin exch 10 atan add }", s)[0]
    e = run("{ 12 and }", s)[0]
    return table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"), e.alias("e"))


@query("SELECT p_partkey, 10 + pow(least(greatest(p_size / 50.0, 0), 1), 2) * 20 AS e, CASE WHEN x < 0.5 THEN x * 2 ELSE pow((x - 0.5) * 2, 3) END AS s FROM (SELECT *, least(greatest(p_size / 50.0, 0), 1) AS x FROM part)")
def fn_exponential_stitching(spark, d):
    x = F.col("p_size") / 50.0
    e = calculator.exponential(x, [10.0], [30.0], 2.0)[0]
    s = calculator.stitching(x, [lambda y: calculator.exponential(y), lambda y: calculator.exponential(y, n=3.0)], [0.5], [(0.0, 1.0), (0.0, 1.0)])[0]
    return table(spark, d, "part").select("p_partkey", e.alias("e"), s.alias("s"))


@query("SELECT p_partkey, t[i + 1] + (e - i) * (t[i + 2] - t[i + 1]) AS v FROM (SELECT p_partkey, e, t, CAST(least(floor(e), 3) AS INT) AS i FROM (SELECT p_partkey, least(greatest(p_size / 50.0, 0), 1) * 4 AS e, [0.0, 0.1, 0.4, 0.9, 1.0] AS t FROM part))")
def fn_sampled(spark, d):
    return table(spark, d, "part").select("p_partkey", calculator.sampled([F.col("p_size") / 50.0], [0.0, 0.1, 0.4, 0.9, 1.0], [5])[0].alias("v"))


@query("SELECT p_partkey, 2 * p_retailprice + 10 AS x, 3 * p_size - 5 AS y, p_retailprice BETWEEN 900 AND 1200 AND p_size BETWEEN 5 AND 30 AS inside FROM part")
def matrix_transform(spark, d):
    px, py = F.col("p_retailprice"), F.col("p_size").cast("double")
    x, y = geometry.apply(geometry.multiply((2, 0, 0, 3, 0, 0), (1, 0, 0, 1, 10, -5)), px, py)
    return table(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"), geometry.contains((900, 5, 1200, 30), px, py).alias("inside"))


@query("SELECT doc_id, strpos(text, 'the') - 1 AS first, CASE WHEN strpos(text, 'the') = 0 THEN -1 ELSE length(text) - strpos(reverse(text), 'eht') - 2 END AS last, substr(text, 4, 5) AS sub, len(string_split(text, ' ')) AS parts, upper(substr(text, 1, 1)) AS head FROM documents")
def string_functions_xfa(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", strings.index_of(t, "the").alias("first"), strings.last_index_of(t, "the").alias("last"), strings.substring(t, 3, 8).alias("sub"), F.size(strings.split(t, " ")).alias("parts"), strings.upper(strings.char_at(t, 0)).alias("head"))


@query("SELECT event_id, md5(props) AS md5, sha1(props) AS sha1, sha256(props) AS sha256 FROM events")
def hash_functions(spark, d):
    return table(spark, d, "events").select("event_id", *[crypto.digest(F.col("props"), n).alias(n) for n in ("md5", "sha1", "sha256")])


# --- layout, graphs ---------------------------------------------------------------------------------


@query("SELECT cluster, p_brand, avg(p_retailprice) AS position, count(*) AS members FROM (SELECT *, sum(new) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) > 6 THEN 1 ELSE 0 END AS new FROM part)) GROUP BY p_brand, cluster")
def cluster_positions(spark, d):
    return graphs.cluster_means(table(spark, d, "part"), ["p_brand"], "p_retailprice", 6.0)


@query("SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.5 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, value AS a, value + 2.0 AS b FROM events))) GROUP BY user_id, i")
def merge_collinear(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("a"), (F.col("value") + 2.0).alias("b"))
    return graphs.merge_intervals(rows, ["user_id"], "a", "b", 1.5)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def dedup_canonical(spark, d):
    return graphs.canonical(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R')")
def prune_unreferenced(spark, d):
    """Parts that no large return refers to."""
    returns = table(spark, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'")
    return graphs.unreferenced(table(spark, d, "part").select("p_partkey"), "p_partkey", returns, "l_partkey")


@query("WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), t AS (SELECT id, 0 AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.level + 1 FROM n JOIN t ON n.parent = t.id) SELECT id, level FROM t")
def reachability_tree(spark, d):
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k))
    edges = n.select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst")).unionByName(c.select(tag("n", "c_nationkey").alias("src"), tag("c", "c_custkey").alias("dst")))
    roots = r.select(tag("r", "r_regionkey").alias("id"))
    return graphs.reachable(roots.unionByName(edges.select(F.col("dst").alias("id"))), edges, roots)


@query("WITH RECURSIVE b AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation), t AS (SELECT id, title, 0 AS level, title AS path FROM b WHERE parent_id IS NULL UNION ALL SELECT b.id, b.title, t.level + 1, t.path || '/' || b.title FROM b JOIN t ON b.parent_id = t.id) SELECT id, title, level, path FROM t")
def outline_tree(spark, d):
    rows = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title")).unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))
    rows.createOrReplaceTempView("paperloom_outline")
    return graphs.outline(spark, "paperloom_outline")


# --- comparison -------------------------------------------------------------------------------------

_PAIRS = f"(SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.page_no, b.page_no) AS page_no, coalesce(a.text, '') AS source, coalesce(b.text, '') AS destination FROM {_P} a FULL JOIN (SELECT doc, CASE WHEN page_no = n THEN page_no + 1 ELSE page_no END AS page_no, replace(text, 'on', 'en') AS text FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM {_P})) b ON a.doc = b.doc AND a.page_no = b.page_no)"


def _pairs(spark, d) -> DataFrame:
    """Documents and their edited copies, whose last pages have moved by one: each has a deleted and an added page."""
    p = _pages(spark, d)
    moved = p.withColumn("page_no", F.when(F.col("page_no") == pages.page_count(p), F.col("page_no") + 1).otherwise(F.col("page_no")).cast("int"))
    return compare.pair_pages(p, moved.withColumn("text", F.replace("text", F.lit("on"), F.lit("en"))))


@query(f"SELECT * FROM {_PAIRS}")
def compare_pages_outer(spark, d):
    return _pairs(spark, d)


@query(f"""WITH p AS (SELECT *, least(length(source), length(destination)) AS n FROM {_PAIRS}),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: source[i] <> destination[i])), n + 1) - 1 AS prefix FROM p),
r AS (SELECT *, n - prefix AS rest FROM q),
s AS (SELECT *, coalesce(list_min(list_filter(range(1, rest + 1), lambda i: source[-i] <> destination[-i])), rest + 1) - 1 AS suffix FROM r)
SELECT doc, page_no, prefix, suffix, length(source) - prefix - suffix AS source_middle, length(destination) - prefix - suffix AS destination_middle FROM s""")
def compare_common_affix(spark, d):
    return compare.affixes(_pairs(spark, d))


@query(f"SELECT doc, page_no, source AS a, destination AS b FROM {_PAIRS}")
def compare_rebuild(spark, d):
    ops = _pairs(spark, d).select("doc", "page_no", compare.diff("source", "destination").alias("ops"))
    return ops.select("doc", "page_no", compare.rebuild(F.col("ops"), compare.DELETE).alias("a"), compare.rebuild(F.col("ops"), compare.INSERT).alias("b"))


_HALF = "CAST(length(text) // 2 AS INT)"
_EDITED = f"(SELECT doc, page_no, text, substr(text, 1, {_HALF}) AS l, substr(text, {_HALF} + 1) AS r FROM {_P})"


def _edited(spark, d) -> DataFrame:
    """Pages with a mark at their end, and with another in their middle instead."""
    half = F.floor(F.length("text") / 2).cast("int")
    p = _pages(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    two = F.concat(F.substring("text", F.lit(1), half), F.lit("§§"), F.substring(F.col("text"), half + 1, F.length("text")))
    return p.select("doc", "page_no", F.concat("text", F.lit("¤")).alias("source"), two.alias("destination"))


@query(f"SELECT doc, page_no, CAST(i AS INT) AS op_no, ops[i].op AS op, ops[i].text AS text FROM (SELECT doc, page_no, ops, unnest(range(1, len(ops) + 1)) AS i FROM (SELECT doc, page_no, list_filter([{{'op': 'equal', 'text': l}}, {{'op': 'insert', 'text': '§§'}}, {{'op': 'equal', 'text': r}}, {{'op': 'delete', 'text': '¤'}}], lambda x: x.text <> '') AS ops FROM {_EDITED} WHERE text <> ''))")
def compare_edit_script(spark, d):
    ops = _edited(spark, d).where("source <> '¤'").select("doc", "page_no", F.posexplode(compare.diff("source", "destination")).alias("i", "o"))
    return ops.select("doc", "page_no", (F.col("i") + 1).alias("op_no"), "o.op", "o.text")


@query(f"SELECT doc, page_no, CAST(length(text) + 1 AS INT) AS total_chars, 1 AS deleted_chars, 2 AS inserted_chars, 1 AS deletions, 1 AS insertions FROM {_P} WHERE text <> '' UNION ALL SELECT doc, NULL, CAST(sum(length(text) + 1) AS INT), CAST(count(*) AS INT), CAST(2 * count(*) AS INT), CAST(count(*) AS INT), CAST(count(*) AS INT) FROM {_P} WHERE text <> '' GROUP BY doc")
def compare_statistics(spark, d):
    ops = _edited(spark, d).where("source <> '¤'").select("doc", "page_no", compare.diff("source", "destination").alias("ops"))
    return compare.summed(ops.select("doc", "page_no", *compare.statistics(F.col("ops"))))


@query(f"SELECT doc, page_no, l || '<ins>§§</ins>' || r || '<del>¤</del>' AS html, l || '**§§**' || r || '~~¤~~' AS markdown FROM {_EDITED} WHERE text <> '' AND NOT regexp_matches(text, '[<>&]')")
def compare_reports(spark, d):
    rows = _edited(spark, d).where("source <> '¤'").where(~F.col("source").rlike("[<>&]"))
    ops = rows.select("doc", "page_no", compare.diff("source", "destination").alias("ops"))
    return ops.select("doc", "page_no", F.regexp_replace(compare.html(F.col("ops")), "</?span>", "").alias("html"), compare.markdown(F.col("ops")).alias("markdown"))


@query(f"SELECT doc, page_no, 'delete' AS op, 'zzz' AS text FROM {_P} WHERE text <> ''")
def compare_words(spark, d):
    p = _pages(spark, d).where("text <> ''")
    ops = p.select("doc", "page_no", F.explode(compare.side_by_side(F.concat("text", F.lit(" zzz")), F.concat("text", F.lit(" ")))).alias("o"))
    return ops.where("o.op <> 'equal'").select("doc", "page_no", "o.op", "o.text")


@query("SELECT vec_id, list_sum(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN abs(e[i] - e[len(e) + 1 - i]) > 26 THEN 1 ELSE 0 END)) AS changed FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 255)) AS e FROM embeddings)")
def pixel_diff_threshold(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", compare.sample).alias("e"))
    changed = F.aggregate(compare.pixel_diff(F.col("e"), F.reverse("e"), 10.0), F.lit(0), lambda a, x: a + x)
    return e.select("vec_id", F.when(F.size("e") > 0, changed).alias("changed"))


# --- sources, sinks, checks -------------------------------------------------------------------------

_TEXT = "html"
for _p, _r in ((r"(?s)<!--.*?-->", ""), (r"(?is)<script\b.*?</script\s*>", ""), (r"(?is)<style\b.*?</style\s*>", ""), (r"[ \t\r\n]+", " "), (rf"(?i)</?(?:{'|'.join(html.BLOCKS)})(?:\s[^>]*)?/?>", "\n"), (r"<[^>]*>", ""), (r" *\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")):
    _TEXT = f"regexp_replace({_TEXT}, '{_p}', '{_r}', 'g')"
for _n, _t in [*strings.ENTITIES.items(), ("amp", "&")]:
    _TEXT = f"replace({_TEXT}, '&{_n};', '{_t.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.text(F.col("html")).alias("text"))


@query("""SELECT page_id, CAST(i AS INT) AS link_no, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<[aA]\\s[^>]*?[hH][rR][eE][fF]\\s*=\\s*["'']([^"''>]*)["'']', 1) AS h FROM pages))""")
def html_links(spark, d):
    return html.links(table(spark, d, "pages"))


@query("SELECT page_id, lower(n) AS name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS n FROM pages) GROUP BY page_id, lower(n)")
def html_elements(spark, d):
    return html.elements(table(spark, d, "pages"))


@query("SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN '# ' WHEN role = 'user' THEN '## ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def markdown_export(spark, d):
    size = F.when(F.col("turn") == 0, 24).when(F.col("role") == "user", 18).otherwise(10)
    return checks.markdown(table(spark, d, "conversations").withColumn("size", size), "conv_id", ["turn"], "size")


@query(f"SELECT doc, string_agg(text, '' ORDER BY page_no) AS text FROM {_P} GROUP BY doc")
def text_flat(spark, d):
    return compare.flat(_pages(spark, d))


@query("SELECT doc_id, 'short' AS rule FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id, 'no_capital' FROM documents WHERE NOT regexp_matches(text, '[A-Z]') UNION ALL SELECT doc_id, 'length' FROM documents WHERE length(text) <> n_chars UNION ALL SELECT doc_id, 'bars' FROM documents WHERE contains(text, ' | ')")
def validate_rules(spark, d):
    t = F.col("text")
    return checks.violations(table(spark, d, "documents"), "doc_id", {"short": F.col("n_chars") < 100, "no_capital": ~t.rlike("[A-Z]"), "length": F.length(t) != F.col("n_chars"), "bars": t.contains(" | ")})


@query("SELECT lang, source, count(*) AS docs, sum(n_chars) AS chars, avg(n_chars) AS mean FROM documents GROUP BY ROLLUP (lang, source)")
def stats_rollup(spark, d):
    return records.totals(table(spark, d, "documents"), ["lang", "source"], docs=F.count("*"), chars=F.sum("n_chars"), mean=F.avg("n_chars"))


@query("SELECT l_orderkey, min(l_quantity) AS llx, min(l_discount) AS lly, max(l_quantity + l_tax) AS urx, max(l_discount + l_tax) AS ury FROM lineitem GROUP BY l_orderkey")
def content_bounding_box(spark, d):
    boxes = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("llx"), F.col("l_discount").alias("lly"), (F.col("l_quantity") + F.col("l_tax")).alias("urx"), (F.col("l_discount") + F.col("l_tax")).alias("ury"))
    return checks.bounding_box(boxes, ["l_orderkey"])


@query("SELECT p_partkey, list_filter([CASE WHEN b & 4 <> 0 THEN 'print' END, CASE WHEN b & 8 <> 0 THEN 'modify' END, CASE WHEN b & 16 <> 0 THEN 'extract' END, CASE WHEN b & 32 <> 0 THEN 'annotate' END, CASE WHEN b & 256 <> 0 THEN 'fill' END, CASE WHEN b & 512 <> 0 THEN 'accessibility' END, CASE WHEN b & 1024 <> 0 THEN 'assemble' END, CASE WHEN b & 2048 <> 0 THEN 'quality_print' END], lambda x: x IS NOT NULL) AS names FROM (SELECT p_partkey, p_partkey * 37 % 4096 AS b FROM part)")
def permission_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", checks.permissions(F.col("p_partkey") * 37 % 4096).alias("names"))


# --- page files: conversations are written as files, and the files are read ---------------------------


def _files(spark, d) -> DataFrame:
    return pdf.write_pages(_pages(spark, d)).withColumnRenamed("doc", "path")


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id, page_no, string_agg(l, chr(13) || chr(10) ORDER BY i) AS text FROM (SELECT doc, page_no, i, s[i] AS l FROM (SELECT doc, page_no, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc, page_no, string_split(text, chr(10)) AS s FROM {_P}))) WHERE l <> '' GROUP BY doc, page_no")
def pdf_text(spark, d):
    return pdf.page_text(pdf.text_runs(_files(spark, d)))


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id, '1.7' AS version, false AS recovered, CAST(count(*) AS INT) AS n_pages FROM {_P} GROUP BY doc")
def pdf_files(spark, d):
    return pdf.files(_files(spark, d)).select("doc_id", "version", "recovered", "n_pages")


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id, count(*) * 2 + 3 AS objects, count(*) AS streams, CAST(3 * count(*) + 1 + count(*) AS BIGINT) AS refs FROM {_P} GROUP BY doc")
def pdf_objects(spark, d):
    o = pdf.objects(_files(spark, d))
    return o.groupBy("doc_id").agg(F.count("*").alias("objects"), F.count(F.when(F.col("kind") == "stream", 1)).alias("streams"), F.sum(F.size("refs")).alias("refs"))


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id, page_no, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS shows FROM {_P} GROUP BY doc, page_no")
def pdf_content_ops(spark, d):
    return pdf.content_ops(_files(spark, d)).where("op = 'Tj'").groupBy("doc_id", "page_no").agg(F.count("*").alias("shows"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events, sum(value) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query(r"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS block_no, CASE WHEN turn = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CAST(turn = 0 AS INT) AS level, t AS text FROM (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations)")
def markdown_blocks(spark, d):
    one_line = table(spark, d, "conversations").withColumn("text", F.regexp_replace("text", "\\s+", " ")).withColumn("size", F.when(F.col("turn") == 0, 24).otherwise(10))
    return markdown.blocks(checks.markdown(one_line, "conv_id", ["turn"], "size"), "conv_id", "markdown")


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id, 'Helvetica' AS font, count(*) AS pages FROM {_P} GROUP BY doc")
def pdf_fonts(spark, d):
    runs = pdf.text_runs(_files(spark, d))
    return runs.groupBy("doc_id", "font").agg(F.countDistinct("page_no").alias("pages"))


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id, page_no, 0.0 AS llx, CAST(400 + 10 * page_no AS DOUBLE) AS urx, CAST(500 + doc % 7 AS DOUBLE) AS ury, CAST(90 * (page_no % 4) AS INT) AS rotate FROM {_P}")
def pdf_pages(spark, d):
    boxes = {"width": 400 + 10 * F.col("page_no"), "height": 500 + F.col("doc") % 7, "rotate": 90 * (F.col("page_no") % 4)}
    made = pdf.write_pages(_pages(spark, d).withColumns(boxes)).withColumnRenamed("doc", "path")
    return pdf.pages(made).select("doc_id", "page_no", "llx", "urx", "ury", "rotate")


from paperloom.plans import documents, layouts  # noqa: E402, F401  (they register their queries here)
