import duckdb
import pytest
from pyspark.sql import functions as F

from wardlight.operators import dictionaries as W
from wardlight.operators import html as H
from wardlight.operators import reports, semantic, translation
from wardlight.plans import catalog
from wardlight.plans import classify as C
from wardlight.sources import stores

LOGIN = """<!DOCTYPE html><html lang="en"><head><title>Sign in</title><meta name="description" content="d"><meta property="og:title" content="Sign in">
<script type="application/ld+json">{"@type": "Product", "name": "Phone", "offers": {"description": "cheap"}}</script></head>
<body><div aria-hidden="true"><p>hidden</p></div><h1>Hello</h1><p>one<p>two <a href="/privacy" rel="nofollow">Privacy Policy</a>
<form action="https://evil.example/x" method="post"><label>Pass</label><input type="hidden" name="t" value="1"><input type=password autocomplete=off placeholder="Secret"></form>
<img data-src="/a.png" alt="Logo"><img srcset="/b.png 2x, /c.png"><iframe src="/f" title="F"></iframe><section data-captured-iframe="u"><p>frame text</p></section>
<div><del>$100</del><b class="sale-price">$10</b></div><footer>&copy; us</footer></body></html>"""


def test_parse():
    d = H.analyze(LOGIN)
    assert d["meta"]["title"] == "Sign in" and d["meta"]["og_title"] == "Sign in"
    assert "hidden" not in d["body_text"] and "one" in d["body_text"]
    assert d["analysis_text"].startswith("Sign in d ") and "Phone" in d["analysis_text"] and "cheap" in d["analysis_text"]
    assert [f["method"] for f in d["forms"]] == ["POST"] and d["forms"][0]["hidden_fields"] == [{"name": "t", "value": "1"}]
    assert [(i["src"], i["kind"]) for i in d["images"]] == [("/a.png", "lazy"), ("/b.png", "srcset")]
    assert d["text_zones"]["iframe_text"] == ["frame text"] and d["iframes"] == [{"src": "/f", "title": "F"}]
    assert d["price_pairs"] == [{"original": "$100", "sale": "$10"}]
    assert d["links"] == [{"text": "Privacy Policy", "href": "/privacy", "rel": "nofollow"}]
    assert H.analyze(None)["body_text"] == "" and H.analyze("<p>")["links"] == []
    assert H.analyze("x", "  shown   text ")["body_text"] == "shown text"


@pytest.mark.parametrize(
    ("text", "definitive", "strong", "weak"),
    [
        ("Play at our ONLINE  casino", ["online casino", "casino"], [], []),
        ("blackjack and poker", [], ["blackjack", "poker"], []),
        ("limited slots for football", [], [], ["football"]),
        ("NBA odds now, RTP 97, rtp%", [], ["RTP", "NBA odds"], []),
        ("écasino casinoé", ["casino"], [], []),
        ("", [], [], []),
        (None, [], [], []),
    ],
)
def test_gambling(spark, text, definitive, strong, weak):
    r = W.gambling(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.gambling_definitive, r.gambling_strong, r.gambling_weak) == (definitive, strong, weak)


def test_adult(spark):
    rows = spark.createDataFrame([("adult education for young adult",), ("18+ only",), ("porn and 18+ content",), ("I AM over 18 years",)], "t string")
    found = [(r.adult_definitive, r.adult_strong, r.adult_weak, r.g) for r in W.adult(rows, "t").withColumn("g", W.age_gate(F.col("t"))).collect()]
    assert found == [([], [], [], []), ([], [], ["18+"], []), (["porn"], ["18+ content"], [], []), ([], [], [], ["i am over 18", "over 18 years"])]


def test_windows(spark):
    text = "Critical security alert Action required claim cash now please verify your identity immediately"
    df = spark.createDataFrame([(text,), ("  hello\n\tworld ",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(semantic.windows(F.col("t")).alias("w")).collect()] == [
        ["Critical security alert Action required claim cash now", "required claim cash now please verify your identity", "please verify your identity immediately"],
        ["hello world"],
        [],
        [],
    ]
    assert df.select(semantic.windows(F.col("t"), 0, 4).alias("w")).first().w == []


def test_chunks_keep_zones_apart(spark):
    doc = H.with_document(spark.createDataFrame([("<title>T</title><h1>Head</h1><p>para one</p>",), ("<main>only this</main>",), (None,)], "html string"))
    rows = [[(c.text, c.zone) for c in r.c] for r in doc.select(semantic.chunks(F.col("doc")).alias("c")).collect()]
    assert rows == [[("T", "title"), ("Head", "heading"), ("para one", "paragraph")], [("only this", "visibleText")], []]


def test_translation(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    langs = {"en-us": None, "fr-ca": "fr", "zh-tw": "zh-Hant", "zh-HK": "zh-Hant", "zh": "zh", "xx": None, "": None}
    assert [one(translation.source_language(F.lit(k))) for k in langs] == list(langs.values())
    assert one(translation.html_lang(F.lit('<html class="a" lang="DE-at">'))) == "de-at"
    assert one(translation.html_lang(F.lit('<meta http-equiv="content-language" content="fr">'))) == "fr"
    texts = ["short", "x" * 100, "y" * 1901, *["z" * 70] * 13, "[[3]] mark"]
    found = one(translation.batches(F.array(*[F.lit(t) for t in texts])))
    assert [len(b) for b in found] == [1, 1, 1, 1, 1, 8, 6] and found[-1][-1] == "[[ 3 ]] mark"
    assert [len(b[0]) for b in found[2:5]] == [900, 900, 101]
    packed = translation.pack(F.array(F.lit("a"), F.lit("b")))
    assert one(translation.unpack(packed, F.lit(2))) == ["a", "b"] and one(translation.unpack(packed, F.lit(3))) is None
    assert one(translation.unpack(F.lit(" [[0]] a "), F.lit(1))) == ["a"]


def test_translate_puts_texts_back(spark):
    pages = H.with_document(spark.createDataFrame([(1, "<title>Hallo</title><p>Welt</p>", "de"), (2, "<p>Hallo</p>", None)], "page int, html string, source_lang string"))
    table = spark.createDataFrame([("de", "Hallo", "Hello"), ("de", "Welt", "World")], "lang string, text string, translated string")
    out = {r.page: r.doc for r in translation.translate(pages, table).collect()}
    assert out[1].text_zones.title_text == "Hello" and out[1].text_zones.paragraph_text == ["World"] and out[1].visible_text == ["World"]
    assert out[2].text_zones.paragraph_text == ["Hallo"]


def test_reports(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    r = one(reports.normalize_answer(reports.parse_answer(F.lit('x ```json {"riskLevel": "HIGH", "riskCategory": "parking site", "confidenceScore": 187} ```'))))
    assert (r.risk_level, r.risk_category, r.confidence_score, r.website_tone) == ("High", "Parking_Site", 100, "other")
    assert one(reports.parse_answer(F.lit("none"))) is None
    text = one(reports.describe(F.array(F.lit("Scam")), F.create_map(F.lit("Scam"), F.lit(0.5), F.lit("Phishing"), F.lit(0.75)), F.array(F.struct(F.lit("a").alias("signal"), F.lit(1.0).alias("strength"), F.lit("e" * 300).alias("evidence")))))
    assert text.index("Phishing: 0.750") < text.index("Scam: 0.500") and "e" * 240 + "…" in text
    assert one(reports.response_text(F.lit('{"output": [{"content": [{"type": "t", "text": "a"}, {"text": "b"}]}]}'))) == "a\nb"


def test_frames(spark):
    df = spark.sql("""select '<body>x</BODY>' h, array(struct('u' as url, '<html><body><b>in</b></body></html>' as html, '' as text), struct('v' as url, '' as html, 'a<b' as text)) f""")
    out = df.select(stores.merge_frames(F.col("h"), F.col("f")).alias("m")).first().m
    assert out == '<body>x<section data-captured-iframe="u"><b>in</b></section><section data-captured-iframe="v"><p>a&lt;b</p></section></BODY>'
    assert df.select(stores.merge_frames(F.col("h"), F.lit(None).cast("array<struct<url: string, html: string, text: string>>")).alias("m")).first().m == "<body>x</BODY>"


def test_brand_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stores.read_brands(spark, path).count() == 0
    brands = spark.createDataFrame([("b", ["B"], 1), ("a", ["A", "Ay"], 0)], "brand_id string, brand_names array<string>, ord int")
    stores.write_brands(brands, path)
    assert [(r.brand_id, r.brand_names) for r in stores.read_brands(spark, path).orderBy("ord").collect()] == [("a", ["A", "Ay"]), ("b", ["B"])]


def brand():
    return F.struct(F.lit("u").alias("brand_id"), F.array(F.lit("umobile")).alias("brand_names"), F.array(F.lit("u.com.my")).alias("official_domains"), F.array().cast("array<string>").alias("registrant_organizations"), F.array().cast("array<string>").alias("tls_subject_organizations"), F.lit("Malaysia").alias("expected_country"))


def test_labels(spark):
    jobs = [
        (1, "https://a.example/", "<body><p>Our casino is open</p> &copy;</body>", 200),
        (2, "https://login.bad.example/", "<body><p>umobile</p> <input type=password> &copy;<a href='/privacy'>privacy</a></body>", 200),
        (3, "https://bad.example/", "<body>x</body>", 403),
        (4, "https://www.u.com.my/", "<body>x</body>", 200),
        (5, "https://b.example/", " ", 200),
        (6, "https://c.example/", "<body><p>Hello</p> &copy; <a href='/privacy'>privacy</a></body>", 200),
        (7, "https://d.xxx/", "<body><p>verify your age</p> &copy;</body>", 200),
    ]
    df = spark.createDataFrame(jobs, "job_id int, url string, html string, http_status int").withColumn("brand", brand())
    found = {r.job_id: (r.label, r.confidence, r.path) for r in C.classify_rows(df).collect()}
    assert found == {
        1: ("Gambling", "high", "kbs"),
        2: ("Impersonation", "high", "kbs"),
        3: ("Access_Denied", "high", "access_denied"),
        4: ("Official", "high", "trust"),
        5: ("Unresolved", "low", "unresolved"),
        6: ("Other_Site", "high", "kbs"),
        7: ("Pornography", "medium", "kbs"),
    }


def test_stream(spark, tmp_path):
    from wardlight.streaming import classify as stream

    spark.createDataFrame([(1, "https://a.example/", "<body><p>casino</p></body>"), (2, "https://b.example/", "<body>x</body>")], "job_id int, url string, html string").write.parquet(str(tmp_path / "in"))
    q = stream.write_labels(stream.read_captures(spark, str(tmp_path / "in"), "job_id int, url string, html string"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert {r.job_id: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "Gambling", 2: "Other_Site"}


def test_small_helpers(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    kinds = {"net::ERR_CERT_DATE_INVALID": "cert", "net::ERR_SSL_PROTOCOL_ERROR": "connection", "net::ERR_CONNECTION_REFUSED": "connection", "boom": "other"}
    assert [one(stores.navigation_error(F.lit(k))) for k in kinds] == list(kinds.values())
    assert one(stores.run_id(F.lit("_a b/c_"), F.to_timestamp(F.lit("2024-01-02 03:04:05")))) == "a_b_c_2024-01-02T030405000Z"
    assert one(stores.is_blocked(F.lit("https://www.google-analytics.com/x"))) and not one(stores.is_blocked(F.lit("https://a.example")))
    assert one(stores.with_scheme(F.lit("a.example"))) == "https://a.example" and one(stores.to_http(F.lit("HTTPS://a"))) == "http://a"
    report = one(reports.official_report(F.lit("https://a.example/x"), F.struct(F.lit(100).alias("score"), F.lit("r").alias("reason"), F.array(F.lit("f")).alias("flags"))))
    assert report.domains == ["a.example"] and report.findings == ["Trust score: 100/100", "Reason: r", "Signal: f"]


def test_titles_as_in_sql(spark, tmp_path):
    """Cut and unknown references stay, as in the query's SQL; the operator's own title reads them."""
    pages = [
        "<p>no title",
        None,
        "<title>a&amp;b &lt;c&gt;&amp;lt;</title><a href=x>1</a>",
        "<title>cut&&amp</title>",
        "<title>cut&quot</title>",
        "<title>&quot;q&quot; &lt</title>",
        "<head>\n\n<TITLE>\n two\t lines &am\n</TITLE><title>second</title>",
        "x\r\n<title></title><p>",
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    ours = sorted(tuple(r) for r in catalog.html_structure(spark, str(tmp_path)).collect())
    assert ours == sorted(duck.sql(catalog.SQL["html_structure"]).fetchall())
    assert [r[1] for r in ours[2:]] == ["a&b <c>&lt;", "cut&&amp", "cut&quot", "&quot;q&quot; &lt", "two lines &am", ""]
    assert H.analyze(pages[4])["meta"]["title"] == 'cut"' and H.analyze("<title>open <b>x")["meta"]["title_source"] == ""
