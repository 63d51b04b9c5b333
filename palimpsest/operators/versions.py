"""Which two versions of a file are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SNIFF_BYTES

PAIR = ["file_uid", "base", "target", "base_back", "target_back"]


def ordered(versions: DataFrame, by: list, uid: str = "file_uid", version: str = "version") -> DataFrame:
    """Adds ``ord`` (0 = newest) where a source has no order of its own."""
    w = Window.partitionBy(uid).orderBy(*by)
    return versions.withColumn("ord", (F.row_number().over(w) - 1).cast("int"))


def natural(name: Column | str) -> Column:
    """A name to order by in which v9 comes before v10: each run of digits without its leading zeros, after its length."""
    parts = F.regexp_extract_all(name if isinstance(name, Column) else F.col(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=\\d)", "")
    # a length of its own is as long as five digits allow
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 5, "0"), digits(p))).otherwise(p)), "")


def default_pairs(versions: DataFrame) -> DataFrame:
    """Every version with the one just before it; oldest versions have a null base."""
    w = Window.partitionBy("file_uid").orderBy("ord")
    return versions.select("file_uid", F.lead("version").over(w).alias("base"), F.col("version").alias("target"), F.lead("ord").over(w).cast("int").alias("base_back"), F.col("ord").cast("int").alias("target_back"))


def newest_pairs(versions: DataFrame) -> DataFrame:
    """The current comparison of each file."""
    return default_pairs(versions.where("ord <= 1")).where("target_back = 0")


def resolve(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """(file_uid, target, base) requests to pairs and a verdict.

    Empty target: the newest version; empty base: the one before the target. Verdicts:
    ok, no_versions, target_not_found, base_not_found, base_not_older, no_predecessor.
    """
    v = versions.select("file_uid", "version", F.col("ord").cast("int").alias("ord"))
    r = requests.select("file_uid", F.nullif("target", F.lit("")).alias("want"), F.nullif("base", F.lit("")).alias("from"))
    known = v.groupBy("file_uid").agg(F.min("ord").alias("newest"))
    r = r.join(known, "file_uid", "left")
    # a version is asked for by its name or by its place: one equi-join for each, of which a request uses one
    by_name = lambda at, name, place: v.select("file_uid", F.col("version").alias(at), F.col("version").alias(f"n_{name}"), F.col("ord").alias(f"n_{place}"))
    by_place = lambda at, name, place: v.select("file_uid", F.col("ord").alias(at), F.col("version").alias(f"p_{name}"), F.col("ord").alias(f"p_{place}"))

    def found(r: DataFrame, asked: str, at: Column, name: str, place: str) -> DataFrame:
        r = r.withColumns({"_name": F.col(asked), "_place": F.when(F.col(asked).isNull(), at)})
        r = r.join(by_name("_name", name, place), ["file_uid", "_name"], "left").join(by_place("_place", name, place), ["file_uid", "_place"], "left")
        return r.withColumns({name: F.coalesce(f"n_{name}", f"p_{name}"), place: F.coalesce(f"n_{place}", f"p_{place}")}).drop("_name", "_place", f"n_{name}", f"p_{name}", f"n_{place}", f"p_{place}")

    r = found(r, "want", F.col("newest"), "target", "target_back")
    r = found(r, "from", F.col("target_back") + 1, "base", "base_back")
    verdict = (
        F.when(F.col("newest").isNull(), "no_versions")
        .when(F.col("target").isNull(), "target_not_found")
        .when(F.col("from").isNotNull() & F.col("base").isNull(), "base_not_found")
        .when(F.col("from").isNotNull() & (F.col("base_back") <= F.col("target_back")), "base_not_older")
        .when(F.col("base").isNull(), "no_predecessor")
        .otherwise("ok")
    )
    return r.select("file_uid", F.coalesce("base", "from").alias("base"), F.coalesce("target", "want").alias("target"), "base_back", "target_back", verdict.alias("verdict"))


def contents(pairs: DataFrame, versions: DataFrame, prefix: bool = False) -> DataFrame:
    """Adds both sides' name, mime and bytes (or their first bytes only, for sniffing)."""
    data = F.substring("content", 1, SNIFF_BYTES) if prefix else F.col("content")
    side = lambda s: versions.select("file_uid", F.col("version").alias(s), F.col("name").alias(f"{s}_name"), F.col("mime").alias(f"{s}_mime"), data.alias(f"{s}_content"))
    return pairs.join(side("base"), ["file_uid", "base"]).join(side("target"), ["file_uid", "target"])


def within_size(pairs: DataFrame, most: int) -> DataFrame:
    """``too_large`` per pair from the lengths alone; no limit: 0."""
    over = (F.length("target_content") > most) | (F.length("base_content") > most)
    return pairs.withColumn("too_large", F.lit(False) if not most else over)
