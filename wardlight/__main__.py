"""Tables in, tables out.

python -m wardlight classify JOBS OUT [TABLE=PATH ...]   labels of jobs; tables: brands (a JSON store), tls, whois, dns, geo, probes,
                                                         chains, phrases, vectors, translations, logo_vectors, image_vectors
python -m wardlight analyse CAPTURES FOLDER RUN_ID BRAND [TABLE=PATH ...]   a run over captures on disk that can be taken up again
python -m wardlight register STORE REQUESTS INTEL OUT    a brand store with new brands
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import brands
from .plans.classify import classify
from .sources import runs, stores

INTEL = ("tls", "whois", "dns", "geo")
TABLES = ("brands", *INTEL, "probes", "chains", "phrases", "vectors", "translations", "logo_vectors", "image_vectors")


def tables(spark: SparkSession, given: list[str]) -> dict:
    """What classify() takes, from NAME=PATH."""
    paths = dict(x.split("=", 1) for x in given)
    if unknown := sorted(set(paths) - set(TABLES)):
        sys.exit(f"unknown tables: {', '.join(unknown)}\n{__doc__}")
    out: dict = {k: spark.read.parquet(p) for k, p in paths.items() if k != "brands" and k not in INTEL}
    if "brands" in paths:
        out["brands"] = stores.with_brand_defaults(stores.read_brands(spark, paths["brands"]))
    if intel := {k: spark.read.parquet(paths[k]) for k in INTEL if k in paths}:
        if missing := [k for k in INTEL if k not in intel]:
            sys.exit(f"domain intelligence needs {', '.join(missing)} as well")
        out["intel"] = intel
    return out


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("wardlight").getOrCreate()
    if args[:1] == ["classify"] and len(args) >= 3:
        classify(spark.read.parquet(args[1]), **tables(spark, args[3:])).write.mode("overwrite").parquet(args[2])
    elif args[:1] == ["analyse"] and len(args) >= 5:
        jobs: DataFrame = runs.capture_jobs(stores.read_captures(spark, args[1]), args[4])
        runs.analyse(runs.Run(spark, args[2], args[3]), lambda: jobs, tables(spark, args[5:]))
    elif args[:1] == ["register"] and len(args) == 5:
        store, new = stores.read_brands(spark, args[1]), brands.register(spark.read.parquet(args[2]), spark.read.parquet(args[3]))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        stores.write_brands(brands.upsert(store, new.withColumn("seq", F.lit(0)), now), args[4])
    else:
        sys.exit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
