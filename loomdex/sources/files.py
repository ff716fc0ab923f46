"""File trees: scans with filters, classification and hashes; ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_generated, is_test_path

#: Files over this size are skipped with a reason.
MOST_BYTES = 5 << 20


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified, content) of the files under a root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An explicit list of files, past all filters."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^(?:[a-z]+:)?/*" + re.escape(root.split(":", 1)[-1].strip("/")) + "/*", "")


def inventory(files: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files with hash and classes, and the skipped ones with the reason."""
    prefix = F.decode(F.substring("content", 1, 2048), "UTF-8")
    small = files.where(F.col("size") <= most_bytes)
    kept = small.select("path", "size", "modified", F.sha2("content", 256).alias("content_hash"), is_test_path(F.col("path")).alias("is_test"), is_generated(F.col("path"), prefix).alias("is_generated"), F.decode("content", "UTF-8").alias("text"))
    return kept, files.where(F.col("size") > most_bytes).select("path", F.lit("too large").alias("reason"))


# Ends of folder names of test projects, and of unit test projects.
TEST_PROJECTS = (
    "UnitTests Tests IntegrationTests Specs Test Testing FunctionalTests AcceptanceTests EndToEndTests E2ETests TestProject TestSuite TestLib TestData TestFramework TestUtils TestUtilities "
    "TestHelper TestHelpers TestCommon TestShared TestSupport Benchmark Benchmarks Performance PerformanceTests LoadTests StressTests"
).split()
UNIT_TEST_PROJECTS = (
    "UnitTests UnitTest Tests Test Testing TestProject TestSuite TestLib TestData TestFramework TestUtils TestUtilities TestHelper TestHelpers TestCommon TestShared TestSupport"
).split()


def in_project(path: Column, ends: list[str]) -> Column:
    """Whether a part of the path ends, in any case, with one of the names."""
    return F.lower(path).rlike("(" + "|".join(re.escape(e.lower()) for e in ends) + ")(/|$)")


def keep(path: Column, *, extensions: list[str] = (), excluded_dirs: list[str] = (), excluded_names: list[str] = (), globs: list[str] = (), most_kb: int = 0, size: Column | None = None, text: Column | None = None, without_tests: bool = False, without_unit_tests: bool = False) -> Column:
    """All given filters at once: extension, folder, name, glob, size, binary (a NUL in 8,000 characters), empty, generated, projects of tests."""
    low = F.lower(path)
    out = F.lit(True)
    if without_tests:
        out = out & ~in_project(path, TEST_PROJECTS)
    if without_unit_tests:
        out = out & ~in_project(path, UNIT_TEST_PROJECTS)
    if extensions and "*.*" not in extensions:
        out = out & low.rlike("(" + "|".join(re.escape(e.lower()) for e in extensions) + ")$")
    for name in excluded_dirs:
        out = out & ~F.contains(F.concat(F.lit("/"), low), F.lit(f"/{name.lower()}/"))
    if excluded_names:
        out = out & ~F.regexp_extract(low, r"([^/]+)$", 1).isin([n.lower() for n in excluded_names])
    for pattern in globs:
        out = out & ~path.rlike(glob_pattern(pattern))
    if most_kb and size is not None:
        out = out & (size <= most_kb * 1024)
    if text is not None:
        out = out & (F.length(text) > 0) & ~F.contains(F.substring(text, 1, 8000), F.lit("\0")) & ~F.substring_index(text, "\n", 5).contains("<auto-generated")
    return out


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob over a relative path or a file name; ** crosses folders."""
    out = ""
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob.strip("/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return f"(?:^|/){out}(?:/.*)?$"


def ignore_globs(text: str) -> list[str]:
    """Globs of an ignore file: every line that is no comment; negation is not honoured."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def outside_nested(files: DataFrame) -> DataFrame:
    """Files (path, relative) that are not in a nested repository: under a folder, other than the root, that has a .git entry."""
    roots = files.select(F.regexp_extract("path", r"^(.+)/\.git(?:/|$)", 1).alias("root")).where("root <> ''").distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nested = files.select("path", F.explode(folders).alias("root")).join(roots, "root", "left_semi").select("path").distinct()
    return files.join(nested, "path", "left_anti").where(~F.col("path").rlike(r"(^|/)\.git(/|$)"))


def ignored_by(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """Paths that an ignore file (folder, text) at or above them leaves out, up to the root (folder '')."""
    lines = ignores.select("folder", F.explode(F.split("text", "\r?\n")).alias("glob")).select("folder", F.trim("glob").alias("glob")).where("glob <> '' AND NOT glob LIKE '#%'").distinct()
    parts = F.split("path", "/")
    folders = F.concat(F.array(F.lit("")), F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    under = files.select("path", F.explode(folders).alias("folder")).join(lines, "folder")
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    # a glob as a pattern, as glob_pattern makes it, from signs that no path has
    quoted = F.regexp_replace(F.regexp_replace("glob", "^/|/$", ""), r"[.+()\[\]{}^$|\\]", r"\\$0")
    steps = (("**/", "\1"), ("**", "\2"), ("*", "[^/]*"), ("?", "[^/]"), ("\1", "(?:.*/)?"), ("\2", ".*"))
    for a, b in steps:
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    pattern = F.concat(F.lit("(?:^|/)"), quoted, F.lit("(?:/.*)?$"))
    return under.where(F.rlike(rest, pattern)).select("path").distinct()
