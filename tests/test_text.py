"""Text functions."""

from __future__ import annotations

import base64
import codecs
import re
import unicodedata
import urllib.parse

import pytest
from pyspark.sql import functions as F

from loamgrid.errors import DataError
from loamgrid.functions import text, urls

SAMPLES = ["", "Hello World", "someValue here", "HTTPServer error-code", "  spaced   out_text  ", "déjà VU", "it's o'clock", "Straße 12", "a/b?c=d&e f+~*", "日本 text", "MIX ed_Case-Name", "ﬁne ½"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id long, t string").cache()


def column(frame, expression):
    return [r.v for r in frame.select("id", expression.alias("v")).orderBy("id").collect()]


def test_cases(frame):
    words = lambda t: [w for w in re.split(r"[\s_\-]+", t.strip()) if w]
    capital = lambda w: w[:1].upper() + w[1:].lower()
    assert column(frame, text.convert_case(F.col("t"), "snake")) == [re.sub(r"[\s-]+", "_", re.sub("([a-z0-9])([A-Z])", r"\1_\2", t)).lower() for t in SAMPLES]
    assert column(frame, text.convert_case(F.col("t"), "kebab")) == [re.sub(r"[\s_]+", "-", re.sub("([a-z0-9])([A-Z])", r"\1-\2", t)).lower() for t in SAMPLES]
    assert column(frame, text.convert_case(F.col("t"), "pascal")) == ["".join(map(capital, words(t))) for t in SAMPLES]
    assert column(frame, text.convert_case(F.col("t"), "camel")) == [(words(t) or [""])[0].lower() + "".join(map(capital, words(t)[1:])) for t in SAMPLES]
    assert column(frame, text.convert_case(F.col("t"), "title")) == [re.sub(r"\b[\w']+", lambda m: capital(m[0]), t) for t in SAMPLES]
    assert column(frame, text.convert_case(F.col("t"), "slug"))[5:7] == ["deja-vu", "its-oclock"]
    assert column(frame, text.convert_case(F.col("t"), "slug-unicode"))[5] == "déjà-vu"
    with pytest.raises(DataError):
        text.convert_case(F.col("t"), "shout")


def test_per_line(spark):
    frame = spark.createDataFrame([(0, "one two\nThree Four\n")], "id long, t string")
    assert column(frame, text.convert_case(F.col("t"), "snake", per_line=True)) == ["one_two\nthree_four"]


def test_encodings(frame):
    t = F.col("t")
    assert column(frame, text.encode(t, "base64")) == [base64.b64encode(s.encode()).decode() for s in SAMPLES]
    assert column(frame, text.encode(t, "base64url")) == [base64.urlsafe_b64encode(s.encode()).decode() for s in SAMPLES]
    assert column(frame, text.encode(t, "url")) == [urllib.parse.quote(s, safe="") for s in SAMPLES]
    assert column(frame, text.encode(t, "url-plus")) == [urllib.parse.quote_plus(s) for s in SAMPLES]
    assert column(frame, text.encode(t, "rot13")) == [codecs.encode(s, "rot13") for s in SAMPLES]
    for scheme in ("base64", "base64url", "hex", "url", "url-plus", "rot13"):
        assert column(frame, text.decode(text.encode(t, scheme), scheme)) == SAMPLES, scheme


def test_decoding_what_is_not_encoded(spark):
    frame = spark.createDataFrame([(0, "zz!"), (1, "aGk"), (2, None)], "id long, t string")
    assert column(frame, text.decode(F.col("t"), "base64")) == [None, "hi", None]
    assert column(frame, text.decode(F.col("t"), "hex")) == [None, None, None]


def test_search(spark):
    frame = spark.createDataFrame([(0, "see http://a.b/c, mail x@y.org\nnothing\nx@y.org 10.0.0.1"), (1, "none"), (2, None)], "id long, t string")
    hits = text.line_hits(frame, "id", "t", text.search_pattern(tags=["email", "IP"])).collect()
    assert [(r.id, r.line_no, r.n, list(r.found)) for r in hits] == [(0, 1, 1, ["x@y.org"]), (0, 3, 2, ["x@y.org", "10.0.0.1"])]
    stats = text.search_stats(frame, "t", text.search_pattern("NO", ignore_case=True)).first()
    assert tuple(stats) == (3, 2, 2)
    assert text.search_stats(frame, "t", text.search_pattern("a.b")).first().matches == 1
    assert text.search_stats(frame, "t", text.search_pattern("no", whole_word=True)).first().matches == 0
    for bad in (lambda: text.search_pattern(), lambda: text.tag_patterns(["nope"]), lambda: text.search_pattern("(", regex=True)):
        with pytest.raises(DataError):
            bad()


def test_tags(spark):
    found = {"url": "www.a.de/x", "ipv6": "fe80:0:0:0:0:0:0:1", "phone": "49 170 1234567", "zip": "12345-6789", "postal": "K1A 0B1", "date": "Mar 3, 2024", "time": "23:59:01", "uuid": "123e4567-e89b-12d3-a456-426614174000", "mac": "aa:bb:cc:dd:ee:ff"}
    for tag, value in found.items():
        frame = spark.createDataFrame([(0, f"x {value} y")], "id long, t string")
        assert value in column(frame, text.matches(F.col("t"), text.search_pattern(tags=[tag])))[0], tag


def test_replace(spark):
    frame = spark.createDataFrame([(0, "a.b a.b $x a1-b2")], "id long, t string")
    for find, put, options, want in (
        ("a.b", r"\1$", {}, (r"\1$ \1$ $x a1-b2", 2)), (r"(\w)(\d)-(\w)", r"\3\1", {"regex": True}, ("a.b a.b $x ba2", 1)), ("A.B", "$", {"ignore_case": True}, ("$ $ $x a1-b2", 2)),
    ):
        new, n = text.replace_text(F.col("t"), find, put, **options)
        assert (column(frame, new)[0], column(frame, n)[0]) == want
    assert text.expand_macros("(?P<my_id><UUID4>)").startswith("(?<myid>[0-9a-f]{8}-")


def test_translate_and_normalise(spark):
    frame = spark.createDataFrame([(0, "كتاب ۱۲٣؟ –ـ"), (1, "Straße «Ünal» ½-x"), (2, None)], "id long, t string")
    assert column(frame, text.translate_text(F.col("t"), "en"))[0] == "كتاب 123? -_"
    assert column(frame, text.translate_text(F.col("t"), "fa"))[0] == "کتاب ۱۲۳؟ ــ"
    assert column(frame, text.normalize_text(F.col("t")))[1:] == ["Strasse <<Unal>> 1⁄2x", None]
    assert column(frame, text.normalize_text(F.col("t"), text.parse_rules("ß\tss\n½\nx\ty")))[1] == "Strasse «Ünal» -y"
    with pytest.raises(DataError):
        text.translate_text(F.col("t"), "xx")


def test_normalise_and_slugs_run_without_python(spark):
    rules, folded = text.default_rules(), text.ascii_rules()
    odd = {ord("x"): "é", ord("é"): "yy", ord("y"): "", ord("z"): "\0", ord("q"): 'a\0"\\b', ord("😀"): ":)", ord("]"): "[[", ord("["): "&&", ord("a"): "😀", 0x10001: "k"}
    texts = [None, "", "«", "plain-text", "xyzéq[]a-&^😀\0\U00010001" * 3, "".join(map(chr, rules)), "".join(map(chr, folded)), "e\u0301 한 ﷺ ½½ ㏒ 𝔘", "\u2003 K İ -_ !´a\u1680"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for given in (None, odd, {}, {ord("a"): ""}, {ord("a"): "bb"}):
        normal = text.normalize_text(F.col("t"), given)
        assert column(frame, normal) == [None if t is None else t.translate(rules if given is None else given) for t in texts]
        assert "Python" not in frame.select(normal)._jdf.queryExecution().executedPlan().toString()
    plain = [t and unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert column(frame, text.slugify(F.col("t"))) == [t and re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", t.lower(), flags=re.A), flags=re.A).strip("-") for t in plain]
    assert "Python" not in frame.select(text.convert_case(F.col("t"), "slug"))._jdf.queryExecution().executedPlan().toString()


def test_counts(spark):
    frame = spark.createDataFrame([(0, "It's a déjà-vu\ntwo  words\n")], "id long, t string")
    got = {n: column(frame, c)[0] for n, c in text.text_counts(F.col("t")).items()}
    assert got == {"lines": 2, "words": 5, "characters": 26, "characters_no_spaces": 20, "bytes": 28}


def test_small_ones(spark):
    frame = spark.createDataFrame([(0, 0), (1, 1023), (2, 1536), (3, 5 * 1024**3)], "id long, t long")
    assert column(frame, text.human_bytes(F.col("t"))) == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 GB"]
    words = spark.createDataFrame([(0, " a*b "), (1, "  ")], "id long, t string")
    assert column(words, text.escape_markdown(F.col("t")))[0] == " a\\*b "
    assert column(words, text.emphasis(F.col("t"), "**")) == [" **a*b** ", "  "]
    assert text.extensions("TXT, .md,,") == [".md", ".txt"]


def test_urls_and_ports(spark):
    frame = spark.createDataFrame([(0, "HTTPS://u:p@Ex.com:8080/a/b?x=1&y=a%20b&x=2&z=#top"), (1, "mailto:x"), (2, None)], "id long, t string")
    u = column(frame, urls.parse_url(F.col("t")))
    assert (u[0].scheme, u[0].host, u[0].port, u[0].path, u[0].query, u[0].fragment) == ("https", "ex.com", 8080, "/a/b", {"x": ["1", "2"], "y": ["a b"]}, "top")
    ports = spark.createDataFrame([(0, "443, 80,81-83,80"), (1, "0"), (2, "90-80"), (3, "x"), (4, "70000")], "id long, t string")
    assert column(ports, urls.expand_ports(F.col("t"))) == [[80, 81, 82, 83, 443], None, None, None, None]
    pages = spark.createDataFrame([(0, 'a "http://x.io/p" <https://y.io/q.css> http://x.io/p http://z.com/')], "id long, t string")
    assert [r.link for r in urls.extract_links(pages, "id", "t", unique=True).collect()] == ["http://x.io/p"]
    assert urls.extract_links(pages, "id", "t", keep_all=True).count() == 4
