import hashlib
import random
import re

from pyspark.sql import functions as F

from paperloom.llm import pii, urls
from paperloom.llm.queries import LISTED

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(s):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))), ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in tests for m in re.finditer(p, t) if ok(m[0])]


def test_spans_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "@", ".", "1", "255", "256", "1.2.3.4", "001.2.3.04", ".5", " ", "-", "+1 (555) 555-0100", "+12", "4111 1111 1111 1111", "4111111111111111", "411111111111111100", "é", "😀", "x", "\n", "card ", "(", "00000000000000000000", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "GB83WEST12345698765432"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.digest(df).collect():
        want = base_spans(rows[r.doc_id][1])
        got = [s for s in r.spans.split(",") if s and not s.startswith("iban")]
        assert got == want, repr(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert pii.digest(odd_docs).count() == odd_docs.count() and pii.digest(no_docs).count() == 0


def test_long_runs_are_linear(spark):
    df = spark.createDataFrame([(1, "x" * 200_000 + " " + "7" * 100_000 + " a@b.c")], "doc_id long, text string")
    assert pii.digest(df).first().n_email == 1


def test_iban_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "my account GB82 WEST 1234 5698 7654 32, call +1 (555) 555-0100 or a@b.org")], "doc_id long, text string")
    r = pii.find(df).first()
    assert [s.kind for s in r.pii] == ["email", "phone", "iban"]
    assert r.pii[2].score == 1.0 and r.pii[1].score == 0.6 and r.pii[0].score == 0.9
    assert pii.redact(df).first().text == "my account [IBAN], call [PHONE] or [EMAIL]"
    empty = spark.createDataFrame([(1, None), (2, "clean")], "doc_id long, text string")
    assert [x.text for x in pii.redact(empty).collect()] == [None, "clean"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [(len(r.host + r.path), r.host + r.path, r.verdict) for r in LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, *(max(rules)[1:] if rules else (None, None))


def test_urls(spark):
    odd = [None, "", "nothing", "HTTP://A.Net", "http://net/", "http://b.example.net/en/x?y://z", "http://EXAMPLE.com/de/?q=1#f", "x://y://z/w", "http://org/fr/", "http://notnet/", "http://a.net/EN", "http://spam.example.com/win/1?ad=1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*odd, odd[-1]])], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://spam.example.com/win/{i}?ad=1", True) for i in range(30)] + [(f"http://good.example.com/win/{i}", False) for i in range(60)] + [(None, True), ("http://x.y/", None)], "url string, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, labelled, LISTED).collect()}
    assert len(got) == len(odd) + 1
    for i, u in enumerate(odd):
        host, path, rule, verdict = expected(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if u and "spam" in u else "allow")), u
    rules = urls.mine(labelled, confidence=0.9).collect()
    assert rules and all(len(r["items"]) == 1 and r.confidence == 1.0 for r in rules)  # larger sets say no more
    nothing = urls.judge(pages, labelled.limit(0), LISTED)
    assert nothing.where(F.col("confidence").isNotNull()).count() == 0 and nothing.count() == len(odd) + 1
