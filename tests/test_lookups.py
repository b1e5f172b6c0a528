"""Look-ups, packs of translations, libraries, images, brand versions, signals and runs, on small tables with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight import __main__ as cli
from wardlight.functions import skew
from wardlight.functions.text import phrase_pattern
from wardlight.operators import brands as B
from wardlight.operators import dictionaries as W
from wardlight.operators import facts as X
from wardlight.operators import links as L
from wardlight.operators import semantic as S
from wardlight.operators import translation as T
from wardlight.plans import classify as C
from wardlight.sources import runs, shared, stores

RNG = random.Random(3)


# --- look-ups --------------------------------------------------------------------------------------------------------


def test_look_up_spreads_frequent_keys(spark):
    rows = [(i, "hot") for i in range(900)] + [(i, f"k{i % 50}") for i in range(900, 1100)] + [(i, None) for i in range(1100, 1400)] + [(2000, "unknown")]
    table = [("hot", 1), *[(f"k{i}", i + 2) for i in range(40)], ("nobody", 99)]
    left, right = spark.createDataFrame(rows, "id long, key string"), spark.createDataFrame(table, "key string, value int")
    known = dict(table)
    for hot in (1, 100, 10_000):
        found = skew.look_up(left, right, "key", F.col("id"), hot=hot, splits=8)
        assert found.columns == ["id", "key", "value"]
        assert sorted((r.id, r.value) for r in found.collect()) == sorted((i, known.get(k)) for i, k in rows)
    assert skew.look_up(left.where("false"), right, "key", F.col("id")).count() == 0
    assert skew.look_up(left, right.where("false"), "key", F.col("id")).where("value IS NULL").count() == len(rows)


def test_look_up_deals_a_hot_key_and_nulls_over_tasks(spark):
    n = 4000
    left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id")).alias("key"))
    right = spark.createDataFrame([("hot", 1)], "key string, value int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = skew.look_up(left, right, "key", F.col("id"), hot=100, splits=64)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == n and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


# --- translation -----------------------------------------------------------------------------------------------------


def test_two_passes(spark):
    pages = spark.createDataFrame(
        [(1, "de", ["eins", "zwei", " ", "drei [[4]]"]), (2, "de", ["eins", "zwei", " ", "drei [[4]]"]), (3, None, ["x"]), (4, "fr", ["a" * 2000, "b" * 100, "un", "deux", "  "]), (5, "fr", ["  "]), (6, "fr", []), (7, "fr", ["c" * 85, "rien"])],
        "page long, lang string, texts array<string>",
    )
    packs = T.page_packs(pages)
    first = {(r.lang, r.text) for r in T.questions(packs).collect()}
    assert first == {("de", "[[0]]eins[[1]]zwei[[2]] [[3]]drei [[ 4 ]]"), ("fr", "a" * 900), ("fr", "a" * 200), ("fr", "b" * 100), ("fr", "[[0]]un[[1]]deux[[2]]  "), ("fr", "c" * 85), ("fr", "rien")}
    told = [("de", "[[0]]eins[[1]]zwei[[2]] [[3]]drei [[ 4 ]]", "[[0]]one[[2]] [[1]] two [[3]]three"), ("fr", "[[0]]un[[1]]deux[[2]]  ", "[[0]]one two"), ("fr", "a" * 900, "A"), ("fr", "a" * 900, "B"), ("fr", "c" * 85, None)]
    answers = spark.createDataFrame(told, "lang string, text string, translated string")
    assert {(r.lang, r.text) for r in T.questions(packs, answers).collect()} == {("fr", "un"), ("fr", "deux")}
    answers = answers.unionByName(spark.createDataFrame([("fr", "deux", "two"), ("de", "un", "wrong language")], answers.schema))
    got = {(r.page, r.nth): (r.translated, r.why) for r in T.translate_packs(packs, answers).collect()}
    assert got[1, 0] == got[2, 0] == (["one", "two", "", "three"], ["pack"] * 4)
    assert got[4, 0] == (["A"], ["single"]) and got[4, 2] == (["a" * 200], ["kept"])
    assert got[4, 4] == (["un", "two", "  "], ["kept", "single", "blank"])
    assert got[5, 0] == (["  "], ["blank"]) and got[7, 0] == (["c" * 85], ["kept"]) and (6, 0) not in got
    whole = {r.page: r.translated for r in T.translate_texts(pages, answers).collect()}
    assert whole[4] == ["AA" + "a" * 200, "b" * 100, "un", "two", "  "]
    assert whole[3] == ["x"] and whole[6] == [] and whole[1] == ["one", "two", "", "three"]
    assert T.translate_texts(pages.where("false"), answers).count() == 0


def test_units_are_translated_by_what_they_say(spark):
    long = " ".join(f"w{i}" for i in range(400))
    html = "<html lang='{}'><body><p>Guten Tag</p><p>Unbekannt</p><p>{}</p></body></html>"
    jobs = spark.createDataFrame([(1, "https://a.example/", html.format("de", long)), (2, "https://b.example/", html.format("en", "x")), (3, "https://c.example/", html.format("de-AT", "y"))], "job_id int, url string, html string")
    parsed = C.parsed_jobs(jobs)
    answers = spark.createDataFrame([("de", "Guten Tag", "Good day"), ("en", "Guten Tag", "no"), ("de", long[900:1800], "middle")], "lang string, text string, translated string")
    units = T.translated_units(parsed, answers)
    assert {(r.job_id, r.text) for r in units.collect()} == {(1, "Good day"), (3, "Good day"), (1, long[:900] + "middle" + long[1800:])}
    chunks = S.page_chunks(parsed, units).orderBy("job_id", "chunk_ord").collect()
    assert [r.text for r in chunks if r.job_id == 1][:2] == ["Good day", "Unbekannt"]
    assert [r.text for r in chunks if r.job_id == 2][:2] == ["Guten Tag", "Unbekannt"]


# --- phrases and chunks ----------------------------------------------------------------------------------------------

PHRASES = "category string, cat_ord int, phrase_ord int, phrase string, vector array<double>"


def phrase_rows(n):
    return [(f"c{i % 3}", i % 3, i // 3, f"p{i}", [float((i * k * 5 + k) % 7 - 3) for k in range(1, 5)]) for i in range(n)] + [("c1", 1, 90, "none", None), ("c2", 2, 91, "odd", [1.0, None]), ("c0", 0, 92, "zero", [0.0] * 4)]


@pytest.mark.parametrize("block", [4096, 8])
def test_chunks_of_pages_meet_a_stored_library(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(S, "PHRASE_BLOCK", block)
    phrases = spark.createDataFrame(phrase_rows(30), PHRASES)
    texts = [f"t{i}" for i in range(12)] + ["no vector", "null"]
    vector = {t: [float((i * k * 7 + 3 * k + i) % 11 - 5) for k in range(1, 5)] for i, t in enumerate(texts[:12])}
    vectors = spark.createDataFrame([*vector.items(), ("t0", vector["t0"]), ("null", None)], "text string, vector array<double>")
    places = [(RNG.randrange(9), i, "z", RNG.choice(texts)) for i in range(200)] + [(99, 0, "z", "t3")] * 2
    chunks = spark.createDataFrame(places, "job_id int, chunk_ord long, zone string, text string")
    ready = spark.createDataFrame([(*p, vector.get(p[3])) for p in places], "job_id int, chunk_ord long, zone string, text string, vector array<double>")
    want = sorted(map(tuple, S.match(ready, phrases, 0.3).collect()))
    library = S.store_library(phrases, str(tmp_path / "v1"))
    assert library.blocks == (1 if block > 100 else 9)
    assert S.open_library(spark, library.path) == library
    assert want and sorted(map(tuple, S.match_texts(chunks, vectors, phrases, 0.3).collect())) == want
    assert sorted(map(tuple, S.match_texts(chunks, vectors, library, 0.3).collect())) == want
    assert S.match_texts(chunks.where("false"), vectors, library, 0.3).count() == 0
    assert S.match_texts(chunks, vectors.where("false"), library, 0.3).count() == 0


def test_a_library_is_whole_or_not_there(spark, tmp_path):
    with pytest.raises(ValueError, match="no whole phrase library"):
        S.open_library(spark, str(tmp_path / "none"))
    path = str(tmp_path / "v1")
    S.store_library(spark.createDataFrame(phrase_rows(3), PHRASES), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.store_library(spark.createDataFrame(phrase_rows(3), PHRASES), path)
    norms = [sum(x * x for x in r.vector) for r in spark.read.parquet(path).where("vector IS NOT NULL").collect()]
    assert all(abs(n - 1) < 1e-12 or n == 0 for n in norms)


def test_units_follow_the_zones(spark):
    def units(html):
        jobs = spark.createDataFrame([(1, "https://a.example/", html)], "job_id int, url string, html string")
        return [(r.zone, r.text) for r in S.page_chunks(C.parsed_jobs(jobs)).orderBy("chunk_ord").collect()]

    found = units("<html><head><title>One title</title></head><body><h1>Big</h1><p>a b c d e f g h i j k l m n</p><button>Go</button><footer>end</footer></body></html>")
    assert [z for z, _ in found][:2] == ["title", "heading"] and ("button", "Go") in found
    assert [t for z, t in found if z == "paragraph"] == ["a b c d e f g h", "e f g h i j k l", "i j k l m n"]


# --- images ----------------------------------------------------------------------------------------------------------

IMAGE = "array<struct<src: string, alt: string, kind: string, rel: string, class_name: string, id: string>>"


def test_brand_tokens(spark):
    names = spark.createDataFrame([(["AT&T Inc.", " ", None, "U"],)], "n array<string>")
    assert names.select(S.brand_tokens(F.col("n")).alias("t")).first().t == ["at t inc", "at", "inc", "attinc", "u"]


def test_image_candidates(spark):
    images = [
        ("/x/plain.png", "", "img", "", "", ""), ("/x/plain.png", "acme", "img", "", "", ""), ("fav.ico", "", "icon", "", "", ""), ("/touch.png", "", "img", "apple-touch-icon", "", ""),
        ("/a.png", "our logo", "img", "", "", ""), ("/b.png", "logotype", "img", "", "", ""), ("/c.svg?x#y", "ACME shop", "img", "", "", ""), ("/d/%41cme.png", "", "img", "", "", ""), ("https://acme.example/e.png", "", "img", "", "", ""),
        ("/f.png", "", "img", "", "site-logo", ""), ("/g.png", "", "og", "", "", ""), ("", "acme", "img", "", "", ""), ("data:image/svg+xml;base64,QQ==", "", "img", "", "", ""), ("/h.png#acme", "", "img", "", "", ""),
    ]
    pages = spark.createDataFrame([(1, "https://h.example/p/q", images, ["Acme"]), (2, "https://h.example/", [(f"/{i:03}.png", "", "img", "", "", "") for i in range(40)], ["Acme"]), (3, "https://h.example/", [], ["Acme"]), (4, "https://h.example/", None, None)], f"job_id int, url string, images {IMAGE}, brand_names array<string>")
    rows = S.image_candidates(pages).collect()
    rank = {r.url.removeprefix("https://h.example"): r["rank"] for r in rows if r.job_id == 1}
    assert rank == {"/p/fav.ico": 0, "/touch.png": 0, "/a.png": 1, "/c.svg?x#y": 1, "/d/%41cme.png": 2, "/f.png": 2, "/g.png": 3, "/x/plain.png": 4, "/b.png": 4, "https://acme.example/e.png": 4, "data:image/svg+xml;base64,QQ==": 4, "/h.png#acme": 4}
    assert {r.url.rsplit("/", 1)[-1] for r in rows if r.svg} == {"c.svg?x#y", "svg+xml;base64,QQ=="}
    assert sorted(r.url for r in rows if r.job_id == 2) == [f"https://h.example/{i:03}.png" for i in range(15)]
    assert {r.job_id for r in rows} == {1, 2}
    assert sorted(r.place for r in rows if r.job_id == 1) == list(range(1, 13))


def test_the_first_image_like_the_logo(spark):
    candidates = spark.createDataFrame([(j, f"u{i}", i % 3, [1.0, 0.0]) for j in range(3) for i in range(20)], "job_id int, url string, rank int, logo_vector array<double>")
    vectors = spark.createDataFrame([("u3", [0.0, 1.0]), ("u4", [1.0, 0.1]), ("u1", [1.0, 0.0]), ("u1", [1.0, 0.0])], "url string, vector array<double>")
    got = {r.job_id: (r.detected, r.image, r.checked) for r in S.find_logo(candidates, vectors).collect()}
    assert got == dict.fromkeys(range(3), (True, "u1", 8))  # seven of rank 0 come first


# --- dictionaries ----------------------------------------------------------------------------------------------------


def test_tiers_against_a_plain_loop(spark):
    import re

    java = lambda p: re.compile(phrase_pattern(p).replace(r"\u", r"\u"))
    definitive, strong, weak, vetoes = ["online casino", "casino", "Casino"], ["free spins", "RTP", "over/under", "18+ content"], ["slots", "bet", "18+", "spins"], ["time slots", "slots left"]
    parts = ["online", "casino", "free", "spins", "RTP", "RTP 97", "rtp9", "RTP %x", "over/under", "over under", "18+", "content", "time", "slots", "left", "bet", "bets", "x", "\n", ",", "Casino-", " "]
    texts = [None, "", " "] + ["".join(RNG.choice(parts) + RNG.choice([" ", "  ", ", ", ""]) for _ in range(RNG.randint(1, 12))) for _ in range(400)]

    def plain(text):
        text, out = text or "", []
        for v in vetoes:
            text = java(v).sub(" ", text)
        for phrases in (definitive, strong, weak):
            found = [p for p in W.distinct_phrases(phrases) if java(p).search(text)]
            for p in found:
                text = java(p).sub(" ", text)
            out.append(found)
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r.i: [r.g_definitive, r.g_strong, r.g_weak] for r in W.tiers(df, "t", definitive, strong, weak, vetoes, "g").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


# --- brands ----------------------------------------------------------------------------------------------------------

STORE = "brand_id string, brand_names array<string>, official_site string, created_at string, updated_at string, ord long"


def test_ids_equal_but_for_case_are_one_brand(spark):
    store = spark.createDataFrame([("a1", ["A"], "old", "t0", "t0", 4), ("b", ["B"], "b", "t0", "t0", 9)], STORE)
    new = spark.createDataFrame([("A1", None, "first", 1), ("a1", ["AA"], None, 2), ("C", ["C"], "c", 3), ("c", None, "cc", 5), (None, ["n"], "n", 6), ("", ["n"], "n", 7)], "brand_id string, brand_names array<string>, official_site string, seq int")
    got = {r.brand_id: tuple(r)[1:] for r in B.upsert(store, new, F.lit("now")).collect()}
    assert got == {"a1": (["AA"], "first", "t0", "now", 4), "b": (["B"], "b", "t0", "t0", 9), "c": (["C"], "cc", "now", "now", 13)}
    fresh = B.upsert(store.where("false"), new, F.lit("now")).collect()
    assert {(r.brand_id, r.ord) for r in fresh} == {("a1", 1), ("c", 3)}
    assert B.upsert(store, new.where("false"), F.lit("now")).count() == 2


def test_versions_of_a_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert stores.current_version(spark, folder) is None
    with pytest.raises(ValueError, match="no version"):
        stores.read_version(spark, folder)
    one = spark.createDataFrame([("a", ["A"], "s", "t", "t", 0)], STORE)
    assert stores.write_version(one, folder) == 1
    assert stores.write_version(stores.read_version(spark, folder).withColumn("official_site", F.lit("new")), folder, seen=1) == 2
    assert stores.read_version(spark, folder).first().official_site == "new"
    assert stores.read_version(spark, folder, 1).first().official_site == "s"
    with pytest.raises(ValueError, match="moved on"):
        stores.write_version(one, folder, seen=1)
    (tmp_path / "store" / "claim-3").touch()  # another writer is at it
    with pytest.raises(ValueError, match="claimed"):
        stores.write_version(one, folder, seen=2)
    assert stores.current_version(spark, folder) == 2


def test_a_store_is_exported_in_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "DOCUMENT", 3)
    brands = spark.createDataFrame([(f"b{i}", [f"B{i}"], "s", "t", "t", i) for i in range(10)], STORE)
    stores.write_brands(brands, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.json"))) == 4
    assert [(r.brand_id, r.ord) for r in stores.read_brands(spark, str(tmp_path / "s")).orderBy("ord").collect()] == [(f"b{i}", i) for i in range(10)]


def test_brands_named_in_texts(spark):
    docs = spark.createDataFrame([(1, "We love ACME and U.Mobile, x_acme"), (2, "acme.com is not it; big bank here"), (3, None), (4, "Acme, acme! Big  Bank big bank")], "doc_id int, text string")
    brands = spark.createDataFrame([("Acme",), ("u.mobile",), ("Big Bank",), ("AT&T",), ("",), (None,), ("acme",)], "brand string")
    assert {(r.doc_id, r.brand) for r in B.named_in(docs, brands).collect()} == {(1, "Acme"), (1, "acme"), (1, "u.mobile"), (2, "Big Bank"), (4, "Acme"), (4, "acme"), (4, "Big Bank")}


# --- links and signals -----------------------------------------------------------------------------------------------


def test_one_url_on_all_pages(spark, monkeypatch):
    monkeypatch.setattr(L, "look_up", lambda *a: skew.look_up(*a, hot=50, splits=8))
    anchors = [(p, i, "hot" if i < 2 else None if i == 2 else f"d{(p + i) % 9}") for p in range(200) for i in range(12)]
    probes = [("hot", 404, "", None), ("hot", 200, "", None), *[(f"d{i}", 500, "", None) for i in range(8)]]
    found = L.health(spark.createDataFrame(anchors, "page int, pos int, url string"), spark.createDataFrame(probes, "url string, http_status int, body_excerpt string, error string")).collect()
    assert len(found) == 200
    for r in found:
        urls = [u for p, _, u in anchors if p == r.page]
        dead = [u for u in dict.fromkeys(urls) if u and u.startswith("d") and u != "d8"]
        assert (r.alive_count, r.placeholder_count, r.evaluable_count) == (2, 1, 12)  # of two probes the one of the lower status counts
        assert r.hard_dead_samples == dead[:5] and r.network_error_samples == [u for u in dict.fromkeys(urls) if u == "d8"]


def test_signals_are_remembered_by_strength(spark):
    rows = [("a", "g", 0.5, "1", ["x"]), ("b", "g", 0.9, "1", ["x", "y"]), ("a", "g", 0.5, "2", ["later"]), ("a", "h", 0.7, "3", []), ("c", "g", 1.5, "1", ["cut"]), ("c", "g", 1.0, "2", ["same"]), ("c", "g", 1.2, "3", ["again"]), ("d", "g", -1.0, "1", None), (None, "g", 1.0, "1", ["no name"]), ("e", "g", 0.9, "1", ["tie"])]
    df = spark.createDataFrame([(rows,), ([],)], f"a {X.MEMORY}")
    memory = X.assert_signals(F.col("a"))
    got, none = df.select(memory.alias("m"), F.map_keys(X.by_strength(memory)).alias("k"), X.get_signal(memory, "a").alias("s"), X.get_signal(memory, "zz").alias("z")).collect()
    assert [tuple(x) for x in got.m] == [("a", "h", 0.7, "3", []), ("b", "g", 0.9, "1", ["x", "y"]), ("c", "g", 1.0, "3", ["again"]), ("d", "g", 0.0, "1", None), ("e", "g", 0.9, "1", ["tie"])]
    assert got.k == ["c", "b", "e", "a", "d"] and got.s.value == "3" and got.z is None
    assert none.m == [] and none.s is None


# --- runs ------------------------------------------------------------------------------------------------------------


def test_a_run_goes_on_where_it_was_broken_off(spark, tmp_path):
    folder, made = str(tmp_path / "runs"), []

    def stage(name, fails=False):
        def make():
            made.append(name)
            if fails:
                raise RuntimeError(name)
            return spark.range(len(made)).withColumn("stage", F.lit(name))

        return make

    run = runs.Run(spark, folder, "r1")
    run.stage("one", stage("one"))
    with pytest.raises(RuntimeError):
        run.stage("two", stage("two", fails=True))
    (tmp_path / "runs" / "two" / "run_id=r1").mkdir(parents=True)
    (tmp_path / "runs" / "two" / "run_id=r1" / "part-half.parquet").write_bytes(b"broken")  # a writer that was killed
    again = runs.Run(spark, folder, "r1")
    assert again.stage("one", stage("one")).count() == 1 and again.stage("two", stage("two")).count() == 3
    assert made == ["one", "two", "two"] and again.made == ["two"]
    runs.Run(spark, folder, "r2").stage("two", stage("two"))
    assert {(r.run_id, r.n) for r in runs.read_stage(spark, folder, "two").groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {("r1", 3), ("r2", 4)}
    assert runs.read_stage(spark, folder, "none").count() == 0
    with pytest.raises(ValueError):
        runs.Run(spark, folder, "a/b")


def test_analyse_captures(spark, tmp_path):
    captures, store = tmp_path / "captures", tmp_path / "brands"
    captures.mkdir()
    (captures / "a.example.txt").write_text("<body><p>Our casino is open</p></body>")
    (captures / "b.example.txt").write_text("<body>x</body>")
    (captures / "b.example.capture.json").write_text('{"finalUrl": "https://b.example/x", "httpStatus": 403}')
    (captures / "b.example.rendered.txt").write_text(" shown \n text ")
    stores.write_brands(spark.createDataFrame([("acme", ["Acme"], "acme.example", "t", "t", 0)], STORE), str(store))
    seen = {r.host: r for r in stores.read_captures(spark, str(captures)).collect()}
    assert (seen["a.example"].final_url, seen["a.example"].rendered_text, seen["b.example"].rendered_text) == ("https://a.example", None, "shown text")
    args = ["analyse", str(captures), str(tmp_path / "runs"), "r1", "Acme", f"brands={store}"]
    cli.main(args)
    result = {r.job_id: (r.label, r.path) for r in runs.read_stage(spark, str(tmp_path / "runs"), "10_result").collect()}
    assert result == {"a.example": ("Gambling", "kbs"), "b.example": ("Access_Denied", "access_denied")}
    before = sorted(p.stat().st_mtime_ns for p in (tmp_path / "runs").rglob("*.parquet"))
    cli.main(args)
    assert sorted(p.stat().st_mtime_ns for p in (tmp_path / "runs").rglob("*.parquet")) == before
    with pytest.raises(SystemExit, match="unknown tables"):
        cli.main([*args, "nothing=x"])


def test_kept_tables_are_swept(spark):
    df = shared.keep(spark.range(5))
    assert df.count() == 5 and shared.sweep(spark) >= 1 and shared.sweep(spark) == 0


def test_prompt_and_exit_reports(spark):
    from wardlight.operators import reports as R

    row = spark.range(1).select(
        R.prompt(F.lit("https://a.example/"), F.lit(None).cast("string"), F.lit("described"), F.lit(False)).alias("p"),
        *[R.exit_report(F.lit(p), F.lit("https://a.example/x"), F.lit(s), F.array(F.lit("127.0.0.1"), F.lit("8.8.8.8")), F.lit("Acme")).alias(f"{p}_{s}") for p, s in (("access_denied", 403), ("access_denied", 200), ("brand_unresolved", 200), ("empty_html", 200), ("kbs", 200))],
    ).first()
    assert all(f"- {label}" in row.p for label in R.LABELS) and "(none)" in row.p
    assert row.access_denied_403.findings == ["The page answered with HTTP status 403"] and "http_status_403" in row.access_denied_403.summary
    assert row.access_denied_200.findings == ["Addresses of sinkholes: 127.0.0.1"] and "dns_sinkhole" in row.access_denied_200.summary
    assert "Acme" in row.brand_unresolved_200.summary and row.empty_html_200.domains == ["a.example"] and row.kbs_200 is None
