"""Version tables from folders of files, directory trees, and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MOST_TEXT_LINES, MOST_TREE_DEPTH

#: What Python's splitlines parts lines at, as a pattern; CR LF is one break.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """Files laid out as <root>/<file_uid>/<version>/<name>, newest version first by its name, numbers in it by their value.

    The content column is read only where a plan asks for it.
    """
    from ..operators.versions import natural, ordered

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    v = f.select(F.element_at(parts, -3).alias("file_uid"), F.element_at(parts, -2).alias("version"), F.element_at(parts, -1).alias("name"), F.lit("").alias("mime"), "content")
    return ordered(v, [F.desc(natural("version")), F.desc("version")]).select("file_uid", "version", "ord", "name", "mime", "content")


def tree(spark: SparkSession, entries: DataFrame, root: str, most_depth: int = MOST_TREE_DEPTH) -> DataFrame:
    """(uid, parent, name, is_folder) entries below a root, a level at a time: (uid, name, depth) of the files.

    A level joins the folders found last to the entries' parents; a folder is entered once, at the depth cap at the latest.
    """
    from ..session import ensure_checkpoints

    ensure_checkpoints(spark)
    level = entries.where(F.col("parent") == root).select("uid", "name", "is_folder", F.lit(1).alias("depth"))
    found = level
    for depth in range(2, most_depth + 1):
        folders = level.where("is_folder").select(F.col("uid").alias("parent"))
        level = entries.join(folders, "parent").select("uid", "name", "is_folder", F.lit(depth).alias("depth")).join(found.select("uid"), "uid", "left_anti").checkpoint()
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.where("not is_folder").select("uid", "name", "depth")


def placed(entries: DataFrame, folders: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(uid, place): entries (uid, folder, kind) as ``folder name/kind``; folders (uid, name) of a flat listing. Entries of a skipped kind are left out."""
    named = folders.select(F.col("uid").alias("folder"), F.col("name").alias("_name"))
    return entries.where(~F.col("kind").isin(*skipped)).join(named, "folder").select("uid", F.concat_ws("/", "_name", "kind").alias("place"))


def lines_of(content: Column, most: int | None = MOST_TEXT_LINES) -> Column:
    """array<string>: UTF-8 with replacement characters, parted as splitlines does, a last empty line left out."""
    own = F.col(content) if isinstance(content, str) else content
    text = own if isinstance(content, str) else F.decode(own, "UTF-8")
    # the parts have a name of their own: an expression that stands in four places is worked out as often
    cut = F.transform(F.array(F.split(text, LINE_BREAK)), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    lines = F.when(F.length(own) == 0, F.array().cast("array<string>")).otherwise(F.element_at(cut, 1))
    return lines if most is None else F.slice(lines, 1, most)
