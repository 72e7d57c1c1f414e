"""Files of a tree: one listing, pruned folders, selection by kind and size, language."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIP = [".git", ".hg", ".svn", ".tox", ".venv", "__pycache__", "bower_components", "build", "dist", "node_modules", "out", "target", "vendor", "venv"]
GENERATED = r"\.(min\.js|min\.css|bundle\.js|map|d\.ts)$"
MOST_BYTES = 2 << 20
#: in the order in which a frontend claims a file
LANGUAGES = [("go", r"\.go$"), ("python", r"\.py$"), ("javascript", r"\.(js|jsx|mjs|cjs|ts|tsx|vue|svelte)$"), ("java", r"\.(java|class|jar)$"), ("rust", r"\.(rs|mir)$"), ("ruby", r"\.(rb|erb)$"), ("c", r"\.(c|h)$"), ("cpp", r"\.(cc|cpp|cxx|hpp)$")]


def selected(path: Column, size: Column | None = None, skip: list[str] = SKIP) -> Column:
    """Below no pruned folder, not generated, and not too large."""
    ok = ~F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: s.isin(skip)) & ~path.rlike(GENERATED)
    return ok if size is None else ok & (size <= MOST_BYTES)


def language(path: Column) -> Column:
    c = F.when(F.lit(False), "")
    for name, x in LANGUAGES:
        c = c.when(path.rlike(x), name)
    return c


def text(content: str = "content") -> Column:
    """Bytes as text; what isn't UTF-8 is replaced, as any tree has files that aren't text."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def target(path: str) -> tuple[str, str | None]:
    """(root, file): a file is scanned alone, below the folder that it is in."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    return (str(p), None) if p.is_dir() else (str(p.parent), p.name)


def inventory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, size, lang[, content]) of the files to scan, relative to the root. Without content no file is opened."""
    root, only = target(path)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.regexp_replace("path", r"^file:/*", "/")
    f = f.select(F.substring(rel, len(str(Path(root).resolve())) + 2, 1 << 20).alias("path"), F.col("length").alias("size"), *(["content"] if content else []))
    f = f.where(selected(F.col("path"), F.col("size"))) if only is None else f
    return f.withColumn("lang", language(F.col("path")))


def coverage(files: DataFrame, converted: DataFrame) -> DataFrame:
    """(lang, files, converted, failed): a file without a result is a failure, never a clean file."""
    done = converted.select("path", F.col("error").isNull().alias("ok")).distinct()
    j = files.where("lang IS NOT NULL").join(done, "path", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    more = [F.sum(c).alias(n) for c, n in (("size", "bytes"), ("lines", "lines")) if c in files.columns]
    return j.groupBy("lang").agg(F.count("*").alias("files"), F.count(F.when(ok, 1)).alias("converted"), F.count(F.when(~ok, 1)).alias("failed"), *more)
