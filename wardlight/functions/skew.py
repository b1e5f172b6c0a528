"""Look-ups whose keys can be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of at least so many rows is dealt over SPLITS tasks; of such keys the MOST most frequent are.
HOT, SPLITS, MOST = 10_000, 32, 1_000


def look_up(rows: DataFrame, table: DataFrame, key: str, spread: Column, hot: int = HOT, splits: int = SPLITS) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key), null where it lacks the key, or where the key is null.

    Rows of a frequent key are dealt over ``splits`` tasks by a hash of ``spread``, and its row in the table is sent to each of
    them.  Which keys are frequent is counted first (a row a key and task moves), so ``rows`` is read twice; at most MOST
    keys are broadcast, the others go the usual way.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot_key")).agg(F.count(F.lit(1)).alias("__n"))
    frequent = F.broadcast(counts.where(F.col("__n") >= hot).orderBy(F.col("__n").desc(), "__hot_key").limit(MOST).select("__hot_key", F.lit(True).alias("__hot")))
    dealt = rows.withColumn("__spread", F.pmod(F.xxhash64(spread), F.lit(splits)).cast("int"))
    # a null key finds nothing: those rows are spread as well
    dealt = dealt.join(frequent, F.col(key) == F.col("__hot_key"), "left").withColumn("__part", F.when(F.col("__hot") | F.col(key).isNull(), F.col("__spread")).otherwise(0)).drop("__hot_key", "__hot")
    others = [c for c in table.columns if c != key]
    known = table.select(F.col(key).alias("__known"), *[F.col(f"`{c}`") for c in others])
    known = known.join(frequent, F.col("__known") == F.col("__hot_key"), "left")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0)))
    known = known.select("__known", *[F.col(f"`{c}`") for c in others], F.explode(parts).alias("__at"))
    found = dealt.join(known, (F.col(key) == F.col("__known")) & (F.col("__part") == F.col("__at")), "left")
    return found.select(*columns, *[F.col(f"`{c}`") for c in others if c not in rows.columns])
