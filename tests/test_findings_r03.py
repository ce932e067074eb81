"""What the review of round 3 found, each with the smallest tables that show it."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.plans import catalogue
from tests.test_catalogue import SF, plain

Q, SQL = catalogue.QUERIES, catalogue.ORACLES


def same(spark, tmp_path, name, **tables):
    """The query gives the rows of its SQL over these tables; returns them."""
    db = duckdb.connect()
    db.execute("SET threads = 1")
    for t, data in tables.items():
        pq.write_table(data, tmp_path / f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = Q[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    return got


def test_sessions_of_a_stream_do_not_pass_the_driver(spark):
    """the result lies in files that executors wrote; the settings of the session are as before."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    out = Q["event_sessions_stream"](spark, SF)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Memory" not in plan and "parquet" in plan
    assert out.inputFiles() and spark.conf.get(key) == before


def test_intervals_with_equal_ends(spark, tmp_path):
    """equal intervals, of which the SQL's two windows may each put another one first, change nothing."""
    values = [v for v in (5.0, 5.0, 5.0, 1.0, 9.0, 9.0, 8.51, None, None) for _ in range(50)]
    rows = same(spark, tmp_path, "merge_collinear", events=pa.table({"user_id": [1] * len(values), "value": values}))
    assert [r for r in rows if r[0] is not None] == [(1.0, 3.0, 1), (5.0, 7.0, 1), (8.51, 11.0, 1)]


def _vectors(*rows):
    return pa.table({"vec_id": list(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})


def test_samples_are_rounded_in_single_precision(spark, tmp_path):
    """-9 / 255 times 255 is -9 in single precision and less in double; what is no number, or missing, counts as in the SQL."""
    rows = same(spark, tmp_path, "pixel_diff_threshold", embeddings=_vectors([-9 / 255, 17.5 / 255], [0.5, 0.1], [float("nan"), 0.5], [float("inf"), 0.1], [3e38, 1.0], [None, 0.2], [], None))
    assert (0, 0) in rows


def _conversations(*texts):
    return pa.table({"conv_id": pa.array([7] * len(texts), pa.int64()), "turn": pa.array(range(len(texts)), pa.int64()), "role": ["user"] * len(texts), "text": list(texts)})


def test_shadows_of_repeated_lines(spark, tmp_path):
    """each of two equal lines of a page has its shadow, drawn after both."""
    assert len(same(spark, tmp_path, "search_without_shadows", conversations=_conversations("one\ntwo\none\none", "one"))) == 5


def test_kept_runs_are_not_shadows_of_removed_ones(spark):
    """a run is compared with the runs that stay; places that are missing are near to nothing."""
    from paperloom.operators import search

    at = lambda seq, x, y, text="a": ("d", 1, seq, text, x, y, 10.0)
    runs = spark.createDataFrame([at(1, 0.0, 0.0), at(2, 1.5, 0.0), at(3, 3.0, 0.0), at(4, None, 0.0), at(5, None, 0.0), at(6, 0.0, 0.0, "b"), at(7, 2.0, -2.0)], "doc_id string, page_no int, seq int, text string, x double, y double, size double")
    out = search.without_shadows(runs)
    assert out.columns == runs.columns
    assert sorted(r.seq for r in out.collect()) == [1, 3, 4, 5, 6]


def test_upper_case_of_one_character(spark, tmp_path):
    """letters whose upper case is two characters, as the SQL has them."""
    texts = ["ßa", "ŉ", "ᾳx", "ﬁ", "éa", "", "a"]
    docs = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    assert (0, "ẞ") in [(r[0], r[2]) for r in same(spark, tmp_path, "string_functions_xfa", documents=docs)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_without_rules_take_pages_in_batches(spark):
    """no call of Python for each page; runs without a text or a place are on no page."""
    from paperloom.operators import layout

    assert "InPandas" not in _plan(Q["layout_borderless"](spark, SF)) + _plan(Q["layout_paragraphs"](spark, SF))
    cells = [("d", p, t, x, y, 20.0, 10.0) for p in (1, 2) for t, x, y in (("a", 10.0, 90.0), ("b", 50.0, 90.0), ("c", 10.0, 70.0), ("d", 50.0, 70.0), (None, 10.0, 50.0), ("e", None, 50.0))]
    runs = spark.createDataFrame(cells, "doc_id string, page_no int, text string, x double, y double, w double, size double")
    got = [(r.page_no, r.row_no, r.col_no, r.text) for r in layout.borderless_cells(runs).collect()]
    assert sorted(got) == [(p, i, j, t) for p in (1, 2) for i, j, t in ((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d"))]


def test_tables_take_pages_in_batches(spark):
    """no call of Python for each page; a text on an edge is in one cell, and a page with rules only has empty cells."""
    from paperloom.operators import layout

    assert "InPandas" not in _plan(Q["layout_table_cells"](spark, SF))
    rules = [(10.0, y, 110.0, y) for y in (10.0, 50.0, 90.0)] + [(x, 10.0, x, 90.0) for x in (10.0, 60.0, 110.0)]
    paths = spark.createDataFrame([("d", p, *r) for p in (1, 2) for r in rules], "doc_id string, page_no int, llx double, lly double, urx double, ury double")
    runs = spark.createDataFrame([("d", 1, "edge", 60.0, 50.0, 0.0, 0.0), ("d", 1, "in", 20.0, 60.0, 10.0, 10.0), ("d", 3, "no rules", 20.0, 60.0, 10.0, 10.0)], "doc_id string, page_no int, text string, x double, y double, w double, size double")
    got = sorted((r.page_no, r.row_no, r.col_no, r.text) for r in layout.table_cells(runs, paths).collect())
    want = {(1, 1, 1): "in", (1, 2, 2): "edge"}
    assert got == [(p, i, j, want.get((p, i, j), "")) for p in (1, 2) for i in (1, 2) for j in (1, 2)]


def test_runs_outside_tables_take_pages_in_batches(spark):
    """no call of Python for each page."""
    assert "InPandas" not in _plan(Q["layout_outside_tables"](spark, SF))


def _limit_of(spark, name, before):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, before)
    try:
        Q[name](spark, SF)
        return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    finally:
        spark.conf.unset(key)


def test_streams_are_coded_in_batches_of_bounded_bytes(spark):
    """ten thousand long texts are not one batch; a smaller bound of the session stays."""
    assert [_limit_of(spark, "codec_round_trips", x) for x in ("64m", "1g", "1m")] == [4 << 20, 4 << 20, 1 << 20]


def test_texts_are_compared_in_batches_of_bounded_bytes(spark):
    """as F6, for differences of texts and of words."""
    assert [_limit_of(spark, n, "64m") for n in ("compare_statistics", "compare_words")] == [4 << 20] * 2


def _texts(n: int) -> list[str]:
    return [f"page {i} (a\\b) " + "line\n" * (i % 3) for i in range(n)]


def _counted(monkeypatch, read) -> int:
    """Objects that are read from bytes meanwhile."""
    from paperloom.sources import pdf

    calls, old = [0], pdf.Lexer.object

    def one(self, depth=0):
        calls[0] += 1
        return old(self, depth)

    with monkeypatch.context() as m:
        m.setattr(pdf.Lexer, "object", one)
        read()
    return calls[0]


def _per_page(monkeypatch, read) -> list[float]:
    from paperloom.plans import documents

    files = {n: documents.rich_file(1, _texts(n)) for n in (5, 20)}
    return [_counted(monkeypatch, lambda: read(f)) / n for n, f in files.items()]


def test_edits_read_an_object_stream_once(monkeypatch):
    """F8: not once for each of its objects."""
    from paperloom.plans import documents
    from paperloom.sources import pdf_write

    few, many = _per_page(monkeypatch, lambda f: pdf_write.rewrite(f, edit=documents._turned))
    assert many <= few < 90


def test_images_of_an_object_stream_are_deleted_in_one_reading(monkeypatch):
    """as F8."""
    from paperloom.plans import documents
    from paperloom.sources import pdf_write

    few, many = _per_page(monkeypatch, lambda f: pdf_write.rewrite(f, edit=documents._no_images))
    assert many <= few < 90


def test_status_reads_a_file_once(monkeypatch):
    """not once for each relation; what stops one relation is told by each that meets it."""
    from paperloom.sources import pdf

    few, many = _per_page(monkeypatch, lambda f: list(pdf._status_rows("a", f)))
    assert many <= few < 200
    good = pdf.build([[(72.0, 720.0, 12.0, "x")]], compress=False)
    bad = good.replace(b"4 0 obj", b"9 0 obj", 1)  # the page's stream stands under another number
    found = {r[1]: r[3] for r in pdf._status_rows("a", bad)}
    want = {}
    for name, rows in pdf._READERS.items():
        try:
            list(rows("a", bad))
            want[name] = None
        except Exception as e:
            want[name] = str(e)
    assert found == want and found["text_runs"] and found["objects"]


def test_wide_text_reads_an_object_stream_once(monkeypatch):
    """and codes of two bytes are decoded together, with the last byte of an odd number of them."""
    from paperloom.plans import documents
    from paperloom.sources import pdf

    made = documents._wide_text(1, "añb")
    assert _counted(monkeypatch, lambda: list(pdf._run_rows("a", made))) < 75
    font = pdf.Font("f", {0x61: "a", 0x62: "b"}, 2)
    assert font.decode(b"\0a\0b\0c") == ("ab", 1500.0, 0) and font.decode(b"\0ab") == ("ab", 1000.0, 0)
    assert pdf.Font("f", {65: "x"}).decode(b"A b") == ("x b", 1500.0, 1)


def test_keys_and_blocks_of_ciphers(monkeypatch):
    """the published examples of AES with three sizes of keys, one way and the other, without arrays of single words."""
    import numpy as np

    from paperloom.functions import crypto

    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    monkeypatch.setattr(np, "roll", None)
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        sealed = crypto.aes_blocks(bytes(range(size)), block).tobytes()
        assert sealed.hex() == want and crypto.aes_blocks(bytes(range(size)), sealed, True).tobytes() == block
        assert crypto.cbc_encrypt(bytes(range(size)), block, bytes(16)).hex() == want
