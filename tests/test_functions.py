import math

import pytest
from pyspark.sql import functions as F

from kindred.functions import address, contact, documents, geo, names, similarity, urls, vectors

c = F.col


def values(spark, inputs, make, schema="x string"):
    rows = spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in inputs], schema)
    return [r[0] for r in rows.select(make).collect()]


def test_email(spark):
    given = [" John.Doe+news@GoogleMail.com ", "a.b+x@example.org", "+tag@example.org", "not-an-email", "x@y@z.org", None, ""]
    assert values(spark, given, contact.normalize_email(c("x"))) == ["johndoe@gmail.com", "a.b@example.org", "", "not-an-email", "x@y@z.org", None, ""]


def test_email_confidence(spark):
    given = [("a@b.org", 2), ("info@b.org", 2), ("a@b.org", 6), ("a@b.org", 11), ("info@b.org", 11)]
    assert values(spark, given, F.round(contact.email_confidence(c("x"), c("n")), 6), "x string, n int") == [1.0, 0.9, 0.92, 0.85, 0.765]


def test_phone(spark):
    given = ["(206) 555-0100", "+1 206-555-0100", "555-0100", "1-555-0100", "123456", "2065550100 x12", None]
    assert values(spark, given, contact.normalize_phone(c("x"))) == ["2065550100", "2065550100", "5550100", "15550100", "", "206555010012", None]


def test_phone_confidence(spark):
    given = [(None, None), ("1", "1"), ("1", None), ("", None)]
    assert values(spark, given, contact.phone_confidence(c("x"), c("y")), "x string, y string") == [0.95, 0.95, 0.85, 0.95]


@pytest.mark.parametrize(
    "url, domain, slugs",
    [
        ("https://www.Example.org/Programs/Food?x=1#t", "example.org", ["Programs", "Food"]),
        ("http://user@www.www.example.org:8080/a//b/", "example.org", ["a", "b"]),
        ("mailto:x@example.org", None, None),
        ("localhost/x", None, None),
        ("http://8.8.8.8/x", None, None),
        ("http://10.0.0.1/x", "10.0.0.1", ["x"]),
        ("example.org/?next=http://evil.net/p", "evil.net", ["p"]),
    ],
)
def test_url(spark, url, domain, slugs):
    assert values(spark, [url], urls.url_domain(c("x"))) == [domain]
    if slugs is not None:
        assert values(spark, [url], urls.url_slugs(c("x"))) == [slugs]


def test_ignored_domains(spark):
    assert values(spark, ["m.facebook.com", "notfacebook.com", "x.com", "docs.google.com", "google.com"], urls.is_ignored_domain(c("x"))) == [True, False, True, True, False]


def test_url_confidence(spark):
    pairs = [(["a", "b"], ["a", "b"]), ([], []), (["a"], ["a", "b"]), ([], ["a"]), (["a", "b", "x"], ["a", "b", "y"]), (list("abcd"), list("abce"))]
    assert values(spark, pairs, urls.url_confidence(c("x"), c("y")), "x array<string>, y array<string>") == [0.96, 0.96, 0.80, 0.70, 0.88, 0.92]


def test_address(spark):
    given = ["12 Main St, Seattle, WA 98101, US", "12 Main St, Apt 5, Seattle, WA 98101, US", None]
    want = "12 main street seattle wa 98101 us"
    assert values(spark, given, address.normalize_address(c("x"))) == [want, want, None]
    assert values(spark, given[1:2], address.normalize_address(c("x"), glue=True)) == ["12 main streetseattle wa 98101 us"]


def test_unit(spark):
    assert values(spark, ["12 Main St Apt 5, Florence", "12 Stevens Ave, Florence", "1 Oak Rd # 4; x"], address.extract_unit(c("x"))) == ["apt 5", "", "# 4"]
    assert values(spark, [("apt 1", "apt 2"), ("", "apt 2"), ("a", "a")], F.round(address.address_confidence(c("x"), c("y")), 4), "x string, y string") == [0.8075, 0.95, 0.95]


@pytest.mark.parametrize(
    "name, normal, kind",
    [
        ("City of Seattle", "city of seattle", "city"),
        ("Helping Hands Foundation", "helping hands", None),
        ("The Helping Hands Foundation, Inc.", "helping hands", None),
        ("Springfield PD", "springfield police department", None),
        ("Springfield Police Dept", "springfield police department", None),
        ("ZZZ - Old Name", "old name", None),
        (None, None, None),
    ],
)
def test_name(spark, name, normal, kind):
    assert values(spark, [name], names.normalize_name(c("x"))) == [(normal, kind)]


def test_name_trailing_mark_kept_by_choice(spark):
    assert values(spark, ["The Helping Hands Foundation, Inc."], names.normalize_name(c("x"), trim_first=False))[0][0] == "helping hands foundation"


def test_domain_factor(spark):
    rows = [("city of kent", "city of bent", "city", "city"), ("city of kent", "city of seattle", "city", "city"), ("a school", "a church", "education", "religious"), ("acme police department", "acme department", None, None), ("food bank east", "food bank west", None, None), ("abc", "abc", None, None)]
    got = values(spark, rows, names.domain_factor(c("a"), c("b"), c("p"), c("q")), "a string, b string, p string, q string")
    assert got == [0.8, 0.6, 0.85, 0.75, 0.7, 1.0]


def test_similarity(spark):
    assert similarity.jaro_winkler_value("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler_value("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert similarity.jaro("", "") == 1.0 and similarity.jaro("a", "") == 0.0
    assert values(spark, [("word", "two words"), ("", "")], F.round(similarity.trigram_similarity(c("x"), c("y")), 6), "x string, y string") == [0.363636, 0.0]


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    got = values(spark, rows, vectors.cosine(c("x"), c("y")), "x array<double>, y array<double>")
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2] == 0 and got[3] is None and got[4] is None
    assert values(spark, rows[3:], vectors.cosine_distance(c("x"), c("y")), "x array<double>, y array<double>") == [2.0, 2.0]
    assert values(spark, [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], vectors.mean_pool(c("s"), c("m")), "s array<array<double>>, m array<int>") == [[2.0, 3.0]]
    assert values(spark, [([5, 6],)], vectors.pad(c("x"), 4), "x array<int>") == [[5, 6, 0, 0]]


def test_haversine(spark):
    got = values(spark, [(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0)], geo.haversine(c("a"), c("b"), c("p"), c("q")), "a double, b double, p double, q double")
    assert got[0] == pytest.approx(math.radians(1) * 6371008.8) and got[1] is None


def test_truncation():
    text = "Service: Food Bank\n\nDescription: " + "It gives food, clothes and help to many people in need. " * 40 + "\n\nCategories: a, b\n\n"
    for strategy in documents.STRATEGIES:
        out = documents.shorten(text, strategy, 200)
        assert documents.count_tokens(out) <= 200
        if strategy == "intelligent":
            assert out.startswith("Service: Food Bank") and "Categories: a, b" in out
    assert documents.shorten(text, "simple", 100_000) == text
    assert documents.shorten(text, "end_only", 300).startswith("...")
    assert documents.count_tokens(documents.shorten(text * 20, "simple", 100)) <= 100
    assert documents.shorten(None) is None


def test_texts_that_fit_are_left_alone(spark):
    blanks = "\t\x0b\x1c\x85\xa0\u1680\u2003\u2028\u3000"
    texts = [None, "", " ", "a", "a b " * 3, "a b " * 40, blanks.join("abcdefgh"), "é" * 37, "x" * 200, "Description: " + "long words here. " * 60]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for limit in (3, 8, 12, 64):
        for strategy in documents.STRATEGIES:
            got = [r.y for r in df.select("i", documents.shortened(F.col("x"), strategy, limit).alias("y")).orderBy("i").collect()]
            assert got == [documents.shorten(x, strategy, limit) for x in texts]
