"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is cut into units (white space with the word after it, or white space at the
end). The first pass of a lazy match iterator counts them; from that count two ranks
follow by the row's own hash, and a second pass advances a new iterator to the lower
rank and on to the higher one, keeping only where each of them ends. No array of units
is ever made, so memory beyond the text itself doesn't grow with it. The kernel gives
three numbers for a row; cutting, joining, hashing and rebuilding are DataFrame
functions of the text that never left the JVM. Map tasks only, no shuffle.

Null texts are empty. A null doc_id is hashed as an empty string. Empty texts and texts
that hold a mark are left plain, however long; repeated rows give repeated results;
other columns of any name are kept by ``transformed`` and don't take part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    #: of 100 texts, as many are transformed at most, and as many of those suffix first
    share: int = 50
    suffix_first: int = 80
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        """Each begins with a character that it holds nowhere else: joined texts form no further mark."""
        return self.prefix_mark, self.suffix_mark, self.middle_mark


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(units, code points of the prefix, code points of the middle); each hash picks a rank among 0..units."""
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    walk, at = UNIT.finditer(text), 0
    if low:
        at = next(islice(walk, low - 1, None)).end()
    end = next(islice(walk, high - low - 1, None)).end() if high > low else at
    return n, at, end - at


CUTS = StructType([StructField(x, LongType()) for x in ("n", "prefix_chars", "middle_chars")])


@F.pandas_udf(CUTS)
def _cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cuts(*x) for x in zip(text, first, second, strict=True)], columns=CUTS.names)


def _hashed(key: Column, s: Settings, group: int) -> Column:
    """The group'th 8-digit group of the key's hash, unsigned."""
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def _after(text: Column, start: Column) -> Column:
    return F.substring(text, start + 1, F.length(text))


def restored(output: Column, form: Column, s: Settings = Settings()) -> Column:
    """The text again: an output that isn't plain holds each mark once."""
    parts = F.split(output, "|".join(re.escape(m) for m in s.marks), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def transformed(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row struct, n, form, prefix_chars, middle_chars, output) for every row; the two lengths are null where the form is plain."""
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("t", F.coalesce(F.col("row")[text], F.lit("")))
    k = F.col("row")[key]
    at = rows.withColumn("at", _cuts("t", _hashed(k, s, 1), _hashed(k, s, 2)))
    held = F.lit(False)
    for m in s.marks:
        held = held | F.contains("t", F.lit(m))
    form = F.when((F.col("t") == "") | held | (_hashed(k, s, 3) % 100 >= s.share), "plain").when(_hashed(k, s, 4) % 100 < s.suffix_first, "spm").otherwise("psm")
    t, a, m = F.col("t"), F.col("at.prefix_chars"), F.col("at.middle_chars")
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, m), _after(t, a + m)
    p, q, r = map(F.lit, s.marks)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, q, suffix, r, middle)).otherwise(F.concat(q, suffix, p, prefix, r, middle))
    cut = F.col("form") != "plain"
    return at.withColumn("form", form).select("row", F.col("at.n").alias("n"), "form", F.when(cut, a).alias("prefix_chars"), F.when(cut, m).alias("middle_chars"), output.alias("output"))


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    again = restored(F.col("output"), F.col("form"), s)
    return transformed(docs, s).select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(again.cast("binary"), 256).alias("restored_sha256")
    )
