"""Parsers of version-control output, as DataFrames of lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def change_log(logs: DataFrame, extensions: tuple[str, ...] = (".cs",), most_files: int = 40) -> DataFrame:
    """(log, commit, date, path) from logs (log, text) of a marker line with the date, then paths.

    A marker line begins with the character U+0001. Commits without a path of the extensions, or with
    more than ``most_files``, are left out.
    """
    # each log is split at its markers, so no ordering over lines is needed
    commits = logs.select("log", F.posexplode(F.split("text", "\u0001")).alias("commit", "body")).where("commit > 0")
    dated = commits.select("log", "commit", F.to_timestamp(F.trim(F.substring_index("body", "\n", 1))).alias("date"), F.split(F.regexp_replace("body", r"\A[^\n]*\n?", ""), "\r?\n").alias("paths"))
    wanted = F.array_distinct(F.filter(F.transform("paths", lambda p: F.trim(p)), lambda p: F.lower(p).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")))
    return dated.withColumn("paths", wanted).where((F.size("paths") > 0) & (F.size("paths") <= most_files)).select("log", "commit", "date", F.explode("paths").alias("path"))


def unified_diffs(diffs: DataFrame) -> DataFrame:
    """(diff, path, added, removed, hunks) per file of unified diffs (diff, text); a deleted file has its old path."""
    parts = diffs.select("diff", F.explode(F.split("text", r"(?m)^diff --git ")).alias("part")).where("trim(part) <> ''")
    new, old = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)", 1), F.regexp_extract("part", r"(?m)^--- (?:a/)?([^\t\r\n]+)", 1)
    body = F.regexp_extract("part", r"(?s)(\n@@.*)\z", 1)
    return parts.select("diff", F.when(new.isin("/dev/null", ""), old).otherwise(new).alias("path"), F.regexp_count(body, F.lit(r"(?m)^\+")).alias("added"), F.regexp_count(body, F.lit(r"(?m)^-")).alias("removed"), F.regexp_count(body, F.lit(r"(?m)^@@ ")).alias("hunks"))


def test_results(reports: DataFrame) -> DataFrame:
    """(report, test, outcome) from XML test reports (report, text): passed, failed, or not-run for any other."""
    each = reports.select("report", F.explode(F.regexp_extract_all("text", F.lit(r"<UnitTestResult\b[^>]*>"), F.lit(0))).alias("tag"))
    raw = F.regexp_extract("tag", r'\boutcome="([^"]*)"', 1)
    return each.select("report", F.regexp_extract("tag", r'\btestName="([^"]*)"', 1).alias("test"), F.when(raw == "Passed", "passed").when(raw == "Failed", "failed").otherwise("not-run").alias("outcome"))


def workflow_commands(workflows: DataFrame) -> DataFrame:
    """(workflow, command, needs_secret, publishes) from CI files (workflow, text): inline run: lines and block scalars."""
    block = r"(?m)^([ ]*)(?:- )?run:[ ]*(?:[|>][-+]?[ ]*\n((?:\1[ ]+[^\n]*\n?|[ ]*\n)+)|([^|>\n][^\n]*))"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(block), F.lit(2)).alias("b"), F.regexp_extract_all("text", F.lit(block), F.lit(3)).alias("i"))
    each = workflows.select("workflow", F.explode(both).alias("x")).select("workflow", F.regexp_replace(F.concat(F.col("x.b"), F.col("x.i")), r"^\s+|\s+$", "").alias("command"))
    return each.select("workflow", "command", F.contains("command", F.lit("secrets.")).alias("needs_secret"), F.col("command").rlike(r"(?i)\b(publish|push|deploy|release)\b").alias("publishes"))


def project_references(projects: DataFrame) -> DataFrame:
    """(project, reference) from project files (project, text)."""
    found = F.regexp_extract_all("text", F.lit(r'<ProjectReference\b[^>]*\bInclude="([^"]+)"'), F.lit(1))
    return projects.select("project", F.explode(found).alias("reference")).withColumn("reference", F.replace("reference", F.lit("\\"), F.lit("/")))


def _git(root: str, *arguments: str) -> str:
    """Output of git in a folder of the driver's machine; git reads, and nothing else is run."""
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout


def tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """(path) of the files that are tracked, or new and not ignored; None where the folder is no repository."""
    try:
        names = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")
    except (subprocess.CalledProcessError, FileNotFoundError):
        return None
    return spark.createDataFrame([(n,) for n in sorted(set(names)) if n], "path string")


def log_of(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """(log, text) for ``change_log``: the newest commits that are no merges, each a marker line with its date and then its paths."""
    return spark.createDataFrame([(1, _git(root, "log", "--no-merges", f"-n{most}", "--name-only", "--format=%x01%cI"))], "log int, text string")


def diff_of(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """(diff, text) for ``unified_diffs``: the changes between two versions."""
    return spark.createDataFrame([(1, _git(root, "diff", "--no-renames", base, head))], "diff int, text string")


def changed_paths(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    names = _git(root, "diff", "--no-renames", "--name-only", "-z", base, head).split("\0")
    return spark.createDataFrame([(n,) for n in names if n], "path string")


def content_at(spark: SparkSession, root: str, version: str, paths: list[str]) -> DataFrame:
    """(file_path, text) of files at a version; files that it lacks have no row."""
    rows = []
    for path in paths:
        found = subprocess.run(["git", "-C", root, "show", f"{version}:{path}"], capture_output=True, text=True)
        if found.returncode == 0:
            rows.append((path, found.stdout))
    return spark.createDataFrame(rows, "file_path string, text string")
