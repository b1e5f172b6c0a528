"""Readers and writers: the brand store, captures on disk, and helpers for captured pages."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.detectors import contains_any

BRAND = """brand_id string, brand_names array<string>, official_site string, official_domains array<string>, registrant_organizations array<string>,
registrant_countries array<string>, tls_subject_organizations array<string>, registrar_names array<string>, registrar_ids array<string>,
min_registration_age_days int, expected_country string, logo_path string, created_at string, updated_at string, ord bigint"""


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """Brands of a JSON store {"brands": [...]} in its order (ord); none if the store is missing or broken."""
    try:
        raw = spark.read.schema(f"brands array<struct<{BRAND.replace(chr(10), ' ').replace(' string', ': string').replace(' int', ': int').replace(' bigint', ': bigint').replace(' array', ': array')}>>").option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], BRAND)
    each = raw.where("brands is not null").select(F.posexplode("brands").alias("place", "b")).select("b.*", "place").where("brand_id is not null")
    return each.withColumn("ord", F.coalesce("ord", F.col("place").cast("long"))).drop("place")


#: Brands in one exported document at most.
DOCUMENT = 10_000


def write_brands(brands: DataFrame, path: str) -> None:
    """The whole store anew, as JSON documents {"brands": [...]} of at most DOCUMENT neighbouring places each."""
    own = F.struct(*[F.col(c) for c in brands.columns])
    documents = brands.groupBy(F.expr(f"ord div {DOCUMENT}").alias("__part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", own.alias("b")))), lambda x: x["b"]).alias("brands"))
    documents.select("brands").write.option("maxRecordsPerFile", 1).mode("overwrite").json(path)


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of a folder."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _child(spark: SparkSession, path: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path, name)


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The number of the version that readers of a versioned store see; None before the first."""
    fs, path = _hadoop(spark, folder)
    pointers = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removeprefix("current-")) for n in pointers if n.startswith("current-")), default=None)


def write_version(brands: DataFrame, folder: str, seen: int | None = None) -> int:
    """The next version of a store, a table of its own, and its number; readers see it at once and whole, or not at all.

    ``seen`` is the version that ``brands`` was made from.  Once its table is complete a writer claims the number, by a file that
    only one can create, and names the table by a rename.  A writer who finds a newer version than it has seen, or the
    number claimed, gets an error; the claim of a writer who was lost before the rename (claim-N without current-N) has to be deleted.
    """
    spark = brands.sparkSession
    latest = current_version(spark, folder)
    if seen is not None and latest != seen:
        raise ValueError(f"the store has moved on from version {seen} to {latest}")
    number = (latest or 0) + 1
    name = f"version-{number}-{uuid.uuid4()}"
    brands.write.parquet(f"{folder}/{name}")
    fs, _ = _hadoop(spark, folder)
    try:
        fs.create(_child(spark, folder, f"claim-{number}"), False).close()
    except Py4JJavaError as e:
        raise ValueError(f"another writer has claimed version {number}") from e
    written = _child(spark, folder, f"naming-{number}")
    out = fs.create(written, True)
    out.write(bytearray(name.encode()))
    out.close()
    fs.rename(written, _child(spark, folder, f"current-{number}"))
    return number


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """A version of the store, the current one by default."""
    number = current_version(spark, folder) if number is None else number
    if number is None:
        raise ValueError(f"there is no version in {folder}")
    name = spark.read.text(f"{folder}/current-{number}").first()[0]
    return spark.read.parquet(f"{folder}/{name}")


def with_brand_defaults(brands: DataFrame) -> DataFrame:
    """Missing lists are empty, the least registration age is a year."""
    lists = [f.name for f in brands.schema if f.dataType.typeName() == "array"]
    return brands.withColumns({c: F.coalesce(c, F.array().cast(brands.schema[c].dataType)) for c in lists} | {"min_registration_age_days": F.coalesce("min_registration_age_days", F.lit(365))})


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures saved as <host>.txt (html, needed), .rendered.txt, .iframes.json, .capture.json and .png."""

    def texts(glob: str, suffix: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        host = F.regexp_extract("path", rf"([^/]+){suffix}$", 1)
        return files.select(host.alias("host"), F.col("content").alias(name)).where("host <> ''")

    as_text = lambda c: F.col(c).cast("string").alias(c)
    html = texts("*.txt", r"\.txt", "html").where("not endswith(host, '.rendered')")
    out = html
    for glob, suffix, name in (("*.rendered.txt", r"\.rendered\.txt", "rendered_text"), ("*.iframes.json", r"\.iframes\.json", "iframes"), ("*.capture.json", r"\.capture\.json", "capture"), ("*.png", r"\.png", "screenshot")):
        out = out.join(texts(glob, suffix, name), "host", "left")
    capture = F.from_json(F.col("capture").cast("string"), "struct<finalUrl: string, httpStatus: int>")
    iframes = F.from_json(F.col("iframes").cast("string"), "array<struct<url: string, html: string, text: string>>")
    shown = F.nullif(F.trim(F.regexp_replace(F.col("rendered_text").cast("string"), r"\s+", " ")), F.lit(""))
    final = F.coalesce(F.nullif(F.trim(capture["finalUrl"]), F.lit("")), F.concat(F.lit("https://"), "host"))
    return out.select("host", as_text("html"), shown.alias("rendered_text"), iframes.alias("iframes"), final.alias("final_url"), capture["httpStatus"].alias("http_status"), "screenshot")


def run_id(host: Column, at: Column) -> Column:
    """A run's name: the host without odd characters, and the time."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("")), "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown")), F.lit("_"), F.date_format(at, "yyyy-MM-dd'T'HHmmssSSS'Z'"))


# --- addresses and frames of captures --------------------------------------------------------------------------------


def with_scheme(domain: Column) -> Column:
    return F.when(domain.rlike("(?i)^https?://"), domain).otherwise(F.concat(F.lit("https://"), domain))


def to_http(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)^https://", "http://")


def navigation_error(message: Column) -> Column:
    return F.when(message.rlike(fixed.CERTIFICATE), "cert").when(message.rlike(fixed.CONNECTION), "connection").otherwise("other")


def is_blocked(request_url: Column) -> Column:
    """A request that a capture doesn't make."""
    return F.coalesce(contains_any(request_url, fixed.BLOCKED_HOSTS), F.lit(False))


def without_code(html: Column) -> Column:
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return html


def frame_body(frame: Column) -> Column:
    """A frame's inner body, else all its html, else its text as a paragraph."""
    own = without_code(F.coalesce(frame["html"], F.lit("")))
    body = F.nullif(F.trim(F.regexp_extract(own, r"(?is)<body[^>]*>(.*)</body>", 1)), F.lit(""))
    text = F.coalesce(frame["text"], F.lit(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(body, F.nullif(F.trim(own), F.lit("")), F.when(F.trim(text) != "", F.concat(F.lit("<p>"), escaped, F.lit("</p>"))), F.lit(""))


def merge_frames(html: Column, frames: Column) -> Column:
    """The page with its frames' bodies before the last closing body tag, at the end without one."""
    html = F.coalesce(html, F.lit(""))
    marked = F.transform(F.filter(frames, lambda f: frame_body(f) != ""), lambda f: F.concat(F.lit('<section data-captured-iframe="'), F.coalesce(f["url"], F.lit("")), F.lit('">'), frame_body(f), F.lit("</section>")))
    all_ = F.coalesce(F.array_join(marked, ""), F.lit(""))
    back = F.locate(">ydob/<", F.lower(F.reverse(html)))  # from the end, from 1
    at = F.length(html) - back - 5
    return F.when(all_ == "", html).when(back > 0, F.concat(F.substring(html, F.lit(1), at - 1), all_, F.substring(html, at, F.length(html)))).otherwise(F.concat(html, all_))
