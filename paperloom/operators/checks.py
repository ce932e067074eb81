"""Rule tables, statistics, blank pages and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks (its condition holds), in one scan."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


#: Permission bits (fixed values).
PERMISSIONS = {"print": 4, "modify": 8, "extract": 16, "annotate": 32, "fill": 256, "accessibility": 512, "assemble": 1024, "quality_print": 2048}


def permissions(bits: Column) -> Column:
    """Names of the permissions that are set."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for n, b in PERMISSIONS.items()]), lambda x: x.isNotNull())


def bounding_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """The union of boxes (llx, lly, urx, ury)."""
    return df.groupBy(*keys).agg(F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"))


def blank_pages(marks: DataFrame, images: DataFrame, threshold: float) -> DataFrame:
    """(doc, page_no, blank): no hard mark (doc, page_no, hard), and distinct images (doc, page_no, image, coverage) cover at most the threshold."""
    hard = marks.groupBy("doc", "page_no").agg(F.bool_or("hard").alias("hard"))
    covered = images.dropDuplicates(["doc", "page_no", "image"]).groupBy("doc", "page_no").agg(F.sum("coverage").alias("covered"))
    return hard.join(covered, ["doc", "page_no"], "full").select("doc", "page_no", (~F.coalesce("hard", F.lit(False)) & (F.coalesce("covered", F.lit(0.0)) <= threshold)).alias("blank"))


def unsigned(objects: DataFrame, signatures: DataFrame) -> DataFrame:
    """Objects (doc, id, offset) whose latest offset lies past the end of the last signature's range (doc, end)."""
    last = signatures.groupBy("doc").agg(F.max("end").alias("_end"))
    latest = objects.groupBy("doc", "id").agg(F.max("offset").alias("offset"))
    return latest.join(last, "doc").where(F.col("offset") >= F.col("_end")).drop("_end")


def sound(signatures: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, compromised): true unless every signature (doc, valid, start, end) is valid and one of them reaches from 0 to the file's size."""
    s = signatures.groupBy("doc").agg(F.bool_and("valid").alias("v"), F.min("start").alias("a"), F.max("end").alias("b"))
    return sizes.join(s, "doc").select("doc", (~(F.col("v") & (F.col("a") == 0) & (F.col("b") >= F.col("size")))).alias("compromised"))


def markdown(df: DataFrame, doc: str, order: list[str], size: str, column: str = "text") -> DataFrame:
    """(doc, markdown): runs in order, as headings of level 1-3 from size 24, 18 and 14 on, joined by empty lines."""
    head = F.when(F.col(size) >= 24, "# ").when(F.col(size) >= 18, "## ").when(F.col(size) >= 14, "### ").otherwise("")
    rows = df.select(doc, F.struct(*order, F.concat(head, F.coalesce(F.col(column), F.lit(""))).alias("_t")).alias("_r"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda x: x["_t"]), "\n\n").alias("markdown"))


def unbalanced(ops: DataFrame) -> DataFrame:
    """(doc_id, page_no, lowest, last) of pages whose saves and restores (q, Q) do not balance: a running sum below 0, or not 0 at the end."""
    from pyspark.sql import Window as W

    step = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)
    depth = F.sum(step).over(W.partitionBy("doc_id", "page_no").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    pages = ops.withColumn("depth", depth).withColumn("step", step).groupBy("doc_id", "page_no").agg(F.min("depth").alias("lowest"), F.sum("step").alias("last"))
    return pages.where("lowest < 0 OR last <> 0")


def sanitized(relations: dict[str, DataFrame], *hidden: str) -> dict[str, DataFrame]:
    """The relations of files without the rows of hidden kinds: annotations, form_fields, layers, scripts, xmp, attachments."""
    return {n: r.limit(0) if n in hidden else r for n, r in relations.items()}
