"""Reducers: texts without what readers do not need, as chains of regular expressions by format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in the order of each format's reducer; Java syntax.
BRACES = [(r"\s*\{\s*", "{"), (r"\s*\}\s*", "}"), (r"\s*:\s*", ":"), (r"\s*;\s*", ";"), (r"\s*,\s*", ","), (r" {2,}", " ")]
BLOCK_COMMENT, LINE_COMMENT, MARKUP_COMMENT = (r"(?s)/\*.*?\*/", ""), (r"(?<!:)//(?!/)[^\r\n]*", ""), (r"(?s)<!--.*?-->", "")
BETWEEN_TAGS, SPACES, LINE_ENDS = (r">\s+<", "><"), (r" {2,}", " "), (r"(?m)^\s+|\s+$", "")
STEPS = {
    "css": [BLOCK_COMMENT, (r"[\r\n]+", ""), *BRACES],
    "scss": [LINE_COMMENT, BLOCK_COMMENT, (r"[\r\n]+", ""), *BRACES],
    "html": [MARKUP_COMMENT, BETWEEN_TAGS, (r"(\S+)=\"([^\"\s<>&']+)\"", "$1=$2"), SPACES, LINE_ENDS],
    "javascript": [LINE_COMMENT, BLOCK_COMMENT, (r"(\r?\n){2,}", "\n"), LINE_ENDS, SPACES, (r"\s*([{}\[\]();,:])\s*", "$1")],
    "razor": [MARKUP_COMMENT, BLOCK_COMMENT, LINE_COMMENT, (r"(?s)@\*.*?\*@", ""), BETWEEN_TAGS, (r"@\(\s+", "@("), (r"\s+\)", ")"), SPACES, LINE_ENDS, (r"(\r?\n){3,}", "\n\n")],
    "json": [(r"[\r\n]+", ""), (r":\s+", ":"), (r",\s+", ","), (r"([\[{])\s+", "$1"), (r"\s+([\]}])", "$1")],
    "yaml": [(r"(?m)^\s*#.*$", ""), (r"(?m)[ \t]+$", ""), (r"(\r?\n){3,}", "\n\n"), (r"\A[\r\n]+", ""), (r"[\r\n]+\z", "")],
    "xml": [MARKUP_COMMENT, BETWEEN_TAGS, (r"(?m)^\s+", ""), (r"(?m)\s+$", ""), (r"(\?>\s*)", "?>\n"), (r"[\r\n]+(?!<\?)", ""), SPACES],
    "sql": [(r"--[^\r\n]*", ""), BLOCK_COMMENT, (r"(?m)^[ \t]+|[ \t]+$", ""), (r"(\r?\n){2,}", "\n"), (r"[ \t]{2,}", " ")],
    "markdown": [
        MARKUP_COMMENT, (r"(?m)^(.+)\r?\n={3,}\s*$", "# $1"), (r"(?m)^(.+)\r?\n-{3,}\s*$", "## $1"), (r"(?m)^\s*[-*_]{3,}\s*(\r?\n)?", ""), (r"\s*\|\s*", "|"),
        (r"\[([^\]]+)\]\(([^\s)]+)\s+\"[^\"]*\"\)", "[$1]($2)"), (r"(\r?\n){3,}", "\n\n"), (r"(?m)(?<!  )[ \t]+$", ""), (r"\A[\r\n]+", ""), (r"[\r\n]+\z", ""),
    ],
}
EXTENSIONS = {
    ".css": "css", ".scss": "scss", ".html": "html", ".htm": "html", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript", ".cshtml": "razor", ".razor": "razor",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".csproj": "xml", ".sql": "sql", ".md": "markdown",
}
#: Our own redaction rules: the forms of common secrets. Names are reported with counts.
SECRETS = {"private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}", "assigned-secret": r"(?i)\b(?:token|secret|password|api[_-]?key)\s*[:=]\s*[\"']?[A-Za-z0-9+/_-]{12,}[\"']?"}


def reduce_text(text: Column, kind: str) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, F.lit(step[0]), F.lit(step[1])), STEPS[kind], text)


def trim_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", "")


def drop_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^[ \t]*\r?\n", "")


def reduce_files(files: DataFrame, text: str = "text", extension: str = "extension") -> DataFrame:
    """Adds reduced: each file by the reducer of its extension; others only lose blank lines and line ends' space."""
    low = F.lower(extension)
    plain = drop_blank_lines(trim_lines(F.col(text)))
    by_kind: dict[str, list[str]] = {}
    for ext, kind in EXTENSIONS.items():
        by_kind.setdefault(kind, []).append(ext)
    out = None
    for kind, exts in by_kind.items():
        out = F.when(low.isin(exts), reduce_text(F.col(text), kind)) if out is None else out.when(low.isin(exts), reduce_text(F.col(text), kind))
    return files.withColumn("reduced", out.otherwise(plain))


def redact(text: Column, rules: dict[str, str] = SECRETS) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[1]), F.lit(f"[redacted:{rule[0]}]")), rules.items(), text)


def redaction_counts(text: Column, rules: dict[str, str] = SECRETS) -> Column:
    return F.create_map(*[x for name, pattern in rules.items() for x in (F.lit(name), F.regexp_count(text, F.lit(pattern)))])
