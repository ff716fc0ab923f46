"""Dedup of headers and bodies, session deltas, API and diagnostic deltas, repair suggestions, change logs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .shared import numbered, saved

#: Edit distance that names are first sought within, and keys that the names of a length are dealt out over.
NEAR, SALTS = 2, 16
#: Ranks of accessibility, from the widest.
ACCESS = ["public", "protected internal", "protected", "internal", "private protected", "private"]


def header_dedup(files: DataFrame, least: int = 16) -> DataFrame:
    """Files (pos, text) with their leading comment block, its number where two files or more share it, and the rest.

    A block is // or # lines, or a block comment; one that begins with <!-- and does not close on its
    line ends at */ as well. Numbers follow the first appearance.
    """
    header = F.regexp_extract("text", r"\A((?:[ \t]*(?://|#)[^\n]*(?:\n|\z))+|\s*/\*[\s\S]*?\*/|\s*<!--[^\n]*?-->|\s*<!--[^\n]*\n[\s\S]*?\*/)", 1)
    held = files.withColumn("header", F.trim(header)).withColumn("header", F.when(F.length("header") >= least, F.col("header")))
    shared = held.where("header IS NOT NULL").groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where("n >= 2")
    ids = numbered(shared, [F.col("first")], "header_id")
    return held.join(ids.select("header", "header_id"), "header", "left").withColumn("body", F.when(F.col("header_id").isNotNull(), F.concat(F.lit("// header["), F.col("header_id"), F.lit("]\n"), F.regexp_replace("text", r"\A\s*", "").substr(F.length("header") + 1, F.length("text")))).otherwise(F.col("text")))


def line_dedup(files: DataFrame, least: int = 16) -> DataFrame:
    """First lines of at least ``least`` characters that two files or more share: header, files, first file."""
    line = F.trim(F.split("text", "\n")[0])
    return files.select("pos", line.alias("header")).where(F.length("header") >= least).groupBy("header").agg(F.count(F.lit(1)).alias("files"), F.min("pos").alias("first")).where("files >= 2")


def body_dedup(bodies: DataFrame, least: int = 48) -> DataFrame:
    """Bodies (path, seq, body) that stand, but for white space, in two distinct files or more (paths in any case); the first is canonical."""
    norm = F.trim(F.regexp_replace("body", r"\s+", " "))
    held = bodies.withColumn("norm", F.md5(norm)).where(F.length(norm) >= least)
    groups = held.groupBy("norm").agg(F.count_distinct(F.lower("path")).alias("files"), F.min(F.struct("path", "seq")).alias("first")).where("files >= 2")
    return held.join(groups, "norm").select("path", "seq", "files", F.col("first.path").alias("first_path"), (F.struct("path", "seq") == F.col("first")).alias("canonical"))


def session_states(turns: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds state: new, unchanged or changed against the row before of the same keys."""
    before = F.lag(F.struct(F.md5(F.coalesce(F.col(value), F.lit(""))).alias("h"))).over(Window.partitionBy(*keys).orderBy(order))
    return turns.withColumn("b", before).withColumn("state", F.when(F.col("b").isNull(), "new").when(F.col("b.h") == F.md5(F.coalesce(F.col(value), F.lit(""))), "unchanged").otherwise("changed")).drop("b")


def reconcile_session(state: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of the items (session, path, hash) of a turn a session has already been given unchanged, and the state after the turn."""
    unchanged = seen.join(state, ["session", "path", "hash"], "left_semi")
    kept = state.join(seen.select("session", "path"), ["session", "path"], "left_anti")
    return unchanged, kept.unionByName(seen.select(state.columns))


#: Characters of a text that a session retains at most. Fixed value.
RETAINED = 64 * 1024


def session_delta(turns: DataFrame, keys: list[str], order: str, value: str, retained: int = RETAINED) -> DataFrame:
    """Adds state against the row before of the same keys: new, unchanged (left out), diff where that row's text was retained, else whole; and the diff.

    Texts of more than ``retained`` characters are not retained; only hashes of them are compared. The diff is null
    in the other states, and where texts differ so much that the whole one is shorter to read (see ``unified_diff``).
    """
    text = F.coalesce(F.col(value), F.lit(""))
    marked = turns.withColumns({"__h": F.sha2(text, 256), "__t": F.when(F.length(text) <= retained, text)})
    before = F.lag(F.struct("__h", "__t")).over(Window.partitionBy(*keys).orderBy(order))
    state = F.when(F.col("__b").isNull(), "new").when(F.col("__b.__h") == F.col("__h"), "unchanged").when(F.col("__b.__t").isNotNull(), "diff").otherwise("whole")
    stated = marked.withColumn("__b", before).withColumn("state", state)
    return stated.withColumn("diff", unified_diff(F.when(F.col("state") == "diff", F.col("__b.__t")), F.col(value))).drop("__b", "__h", "__t")


def diff_of(before: tuple[str, str | None] | None, text: str) -> tuple[str, str, str | None]:
    """(hash, state, diff) of a text given after another, of which the hash and, if it was retained, the text are known."""
    digest = hashlib.sha256(text.encode()).hexdigest()
    if before is None:
        return digest, "new", None
    if before[0] == digest:
        return digest, "unchanged", None
    return (digest, "whole", None) if before[1] is None else (digest, "diff", text_diff(before[1], text))


def common_lines(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of lines."""
    number = {line: i for i, line in enumerate(dict.fromkeys([*x, *y]))}
    a, b = (np.array([number[line] for line in z], np.int32) for z in (x, y))
    # lengths[i, j]: of the longest one of x from i and y from j
    lengths = np.zeros((len(x) + 1, len(y) + 1), np.int16)
    for i in range(len(x) - 1, -1, -1):
        best = np.maximum(lengths[i + 1, :-1], np.where(b == a[i], lengths[i + 1, 1:] + 1, 0))
        lengths[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif lengths[i + 1, j] >= lengths[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def hunks(x: list[str], y: list[str], kept: list[tuple[int, int]], around: int = 3) -> list[str]:
    """Unified hunks of two lists of lines whose common lines are ``kept``."""
    lines, i, j = [], 0, 0
    for a, b in [*kept, (len(x), len(y))]:
        lines += [("-", i + k, j, x[i + k]) for k in range(a - i)] + [("+", a, j + k, y[j + k]) for k in range(b - j)]
        if a < len(x):
            lines.append((" ", a, b, x[a]))
        i, j = a + 1, b + 1
    changed = [n for n, line in enumerate(lines) if line[0] != " "]
    out, n = [], 0
    while n < len(changed):
        end = n
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * around + 1:
            end += 1
        part = lines[max(0, changed[n] - around) : changed[end] + around + 1]
        old, new = sum(line[0] != "+" for line in part), sum(line[0] != "-" for line in part)
        place = lambda start, size: f"{start + 1 if size else start}" + ("" if size == 1 else f",{size}")
        out.append(f"@@ -{place(part[0][1], old)} +{place(part[0][2], new)} @@")
        out += [sign + text for sign, _, _, text in part]
        n = end + 1
    return out


def text_diff(a: str | None, b: str | None) -> str | None:
    if a is None or b is None or a == b:
        return None
    x, y = a.splitlines(), b.splitlines()
    if max(len(x), len(y)) > 2000:
        return None
    kept = common_lines(x, y)
    changed = len(x) + len(y) - 2 * len(kept)
    return None if changed > 0.6 * (len(x) + len(y)) else "\n".join(hunks(x, y, kept))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified diff with three lines around; null if equal, over 2000 lines or over 60 % of the lines changed."""
    return pd.Series([text_diff(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


def api_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two public surfaces (fqn, access, signature): removed, added, reduced, or signature changed; breaking first.

    The first row of a name counts: by seq where the surfaces have it, else by signature and access.
    """
    first = lambda f: F.struct(*[c for c in ("seq", "signature", "access") if c in f.columns])
    one = lambda f, p: f.groupBy("fqn").agg(F.min(first(f)).alias("r")).select("fqn", F.col("r.access").alias(f"{p}_access"), F.col("r.signature").alias(f"{p}_signature"), F.lit(True).alias(p))
    rank = lambda c: F.array_position(F.array(*[F.lit(a) for a in ACCESS]), F.col(c))
    kind = (
        F.when(F.col("new").isNull(), "removed")
        .when(F.col("old").isNull(), "added")
        .when(rank("new_access") > rank("old_access"), "accessibility-reduced")
        .when(F.col("old_signature").isNotNull() & F.col("new_signature").isNotNull() & (F.col("old_signature") != F.col("new_signature")), "signature-changed")
    )
    joined = one(old, "old").join(one(new, "new"), "fqn", "full").withColumn("kind", kind).where("kind IS NOT NULL")
    return joined.select("fqn", "kind", (F.col("kind") != "added").alias("breaking")).orderBy(F.desc("breaking"), "fqn")


def upgrade_delta(old: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """API delta of two versions of a package; None, no opinion, where either surface cannot be read or is empty."""
    if old is None or new is None or not old.limit(1).count() or not new.limit(1).count():
        return None
    return api_delta(old, new)


def diagnostic_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset differences both ways: introduced and fixed, with how often; lines are not among the keys."""
    count = lambda f, n: f.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(old, "o").join(count(new, "n"), keys, "full").withColumn("d", F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0)))
    return both.where("d <> 0").select(*keys, F.when(F.col("d") > 0, "introduced").otherwise("fixed").alias("state"), F.abs("d").alias("times"))


def freshness(indexed: DataFrame, current: DataFrame, key: str, digest: str, most: int = 300) -> DataFrame:
    """Per differing file: changed (new or another hash) or removed; all are stale instead if over ``most`` differ."""
    joined = indexed.select(key, F.col(digest).alias("was"), F.lit(1).alias("o")).join(current.select(key, F.col(digest).alias("now"), F.lit(1).alias("n")), key, "full")
    state = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull() | ~F.col("was").eqNullSafe(F.col("now")), "changed")
    rows = joined.withColumn("state", state).where("state IS NOT NULL").select(key, "state")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(n)).select(key, F.when(F.col("n") > most, "stale").otherwise(F.col("state")).alias("state"))


def deletions(name: Column, most: int) -> Column:
    """What is left of a name after up to ``most`` of its characters are left out, each once."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def nearest_names(asked: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """The nearest names of each asked name by edit distance in lower case, then by name: asked, name, distance, rank.

    Two names within distance d share what is left of both after at most d deletions, so for the NEAR
    nearest distances these are joined. An asked name is done once ``most`` names lie within the
    distance; the others go on with twice the distance, among the names whose length is within it, up to the
    distance at which every name is. Names are compared only within what an equal key brings together; a
    length's names are dealt out over SALTS keys. Null names and asked names are left out.
    """
    held = saved(names.where("name IS NOT NULL").select("name").distinct().select("name", F.lower("name").alias("low"), F.length(F.lower("name")).alias("n")), "names")
    left = saved(asked.where("asked IS NOT NULL").select("asked").distinct().select("asked", F.lower("asked").alias("alow"), F.length(F.lower("asked")).alias("an")), "asked")
    longest = max([r[0] or 0 for r in (held.agg(F.max("n")).first(), left.agg(F.max("an")).first())])
    out, distance = None, NEAR
    while True:
        if distance == NEAR:
            a, b = left.select("*", F.explode(deletions(F.col("alow"), NEAR)).alias("key")), held.select("name", "low", F.explode(deletions(F.col("low"), NEAR)).alias("key"))
            pairs = a.join(b, "key").select("asked", "alow", "name", "low").distinct()
        else:
            spread = F.explode(F.sequence(F.greatest(F.lit(0), F.col("an") - distance), F.col("an") + distance)).alias("n")
            a = left.select("*", spread).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = a.join(held.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")), ["n", "salt"])
        near = pairs.select("asked", "name", F.levenshtein("alow", "low", distance).alias("distance")).where("distance >= 0")
        rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "name"))
        found = saved(near.withColumn("rank", rank).where(F.col("rank") <= most), "nearest")
        done = found.groupBy("asked").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= most).select("asked")
        last = distance >= longest
        kept = found if last else found.join(done, "asked", "left_semi")
        out = kept if out is None else out.unionByName(kept)
        if last or not (left := saved(left.join(done, "asked", "left_anti"), "asked")).limit(1).count():
            return out
        distance *= 2


#: Candidates of a repair.
REPAIRS = 5
TYPE_KINDS = ("class", "interface", "struct", "record", "enum", "type", "delegate")


def repairs(diagnostics: DataFrame, symbols: DataFrame, most: int = REPAIRS) -> DataFrame:
    """(seq, code, candidate, rank): what the index offers for compiler errors (seq, code, message).

    A missing member gets the nearest members of its type, an unknown type the nearest types that hold its
    first three letters, a missing argument the callee's signatures, a wrong type the members of the source
    type whose signature names the target. ``symbols``: kind, name, containing_type, fqn, signature, is_public.
    """
    quoted = F.regexp_extract_all("message", F.lit("'([^']*)'"), F.lit(1))
    asked = diagnostics.select("seq", "code", F.get(quoted, F.lit(0)).alias("first"), F.get(quoted, F.lit(1)).alias("second")).where("first IS NOT NULL")
    simple = lambda c: F.substring_index(F.substring_index(c, "(", 1), ".", -1)
    ranked = lambda rows, order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy(*order))).where(F.col("rank") <= most)
    near = lambda c: [F.levenshtein(F.lower("candidate"), F.lower(c)), F.col("candidate")]

    def of_type(rows: DataFrame) -> DataFrame:
        """Joined with the members of the type that their first name stands for, by full or simple name."""
        members = symbols.where("containing_type IS NOT NULL").select(simple("containing_type").alias("owner"), "containing_type", F.col("name").alias("candidate"), "signature")
        met = rows.withColumn("owner", simple("first")).join(members, "owner")
        return met.where((F.col("containing_type") == F.col("first")) | (F.col("containing_type") == F.col("owner")) | F.endswith("containing_type", F.concat(F.lit("."), "owner")))

    missing = of_type(asked.where("code IN ('CS1061', 'CS0117') AND second IS NOT NULL")).select("seq", "code", "second", "candidate").distinct()
    types = symbols.where(F.col("kind").isin(list(TYPE_KINDS))).select(F.col("name").alias("candidate")).distinct()
    # names are met by their pieces of up to three letters
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("candidate") - n + 1)), lambda i: F.substring(F.lower("candidate"), i, n))))
    unknown = asked.where("code = 'CS0246'").withColumn("piece", F.lower(F.substring("first", 1, 3))).join(types.select("candidate", F.explode(F.array_distinct(pieces)).alias("piece")), "piece")
    callee = asked.where("code = 'CS7036' AND second IS NOT NULL").withColumn("low", F.lower(simple("second")))
    signatures = symbols.where("trim(signature) <> ''").select(F.lower("name").alias("low"), "fqn", "is_public", F.col("signature").alias("candidate"))
    overloads = callee.join(signatures, "low").groupBy("seq", "code", "candidate").agg(F.min(F.struct((~F.col("is_public")).alias("a"), F.length("fqn").alias("b"), F.col("fqn").alias("c"))).alias("o"))
    wrong = of_type(asked.where("code = 'CS0029' AND second IS NOT NULL")).where(F.contains("signature", simple("second"))).select("seq", "code", "candidate").distinct()
    parts = [ranked(missing, near("second")), ranked(unknown, near("first")), ranked(overloads, [F.col("o"), F.col("candidate")]), ranked(wrong, [F.col("candidate")])]
    out = parts[0].select("seq", "code", "candidate", "rank")
    for part in parts[1:]:
        out = out.unionByName(part.select("seq", "code", "candidate", "rank"))
    return out


def race(candidates: DataFrame, by: str, clean: str) -> DataFrame:
    """Per race: the winner if one candidate is clean among others that are not, a tie if more are, else none."""
    n = F.sum(F.col(clean).cast("long"))
    winner = F.max(F.when(F.col(clean), F.col("candidate")))
    return candidates.groupBy(by).agg(n.alias("cleans"), F.count(F.lit(1)).alias("all"), winner.alias("w")).select(by, F.when((F.col("cleans") == 1) & (F.col("all") > 1), F.col("w")).alias("winner"), (F.col("cleans") >= 2).alias("tie"))


def git_stats(changes: DataFrame, now, days: int = 90) -> DataFrame:
    """Per file the commits of the last days and the newest change."""
    recent = F.count(F.when(F.col("date") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"), 1))
    return changes.groupBy("path").agg(recent.alias("commits"), F.max("date").alias("last_modified"))


# What the detectors of code patterns look for.
DETECTORS = {
    "async": r"\basync\s+(?:Task|ValueTask)\b|ConfigureAwait\s*\(",
    "cqrs": r"\b(IRequest|ICommand|IQuery|IMediator)\b",
    "dependency-injection": r"Add(Singleton|Scoped|Transient)\s*[<\(]",
    "exceptions": r"\b(\w+Exception)\s*:\s*Exception\b|\bcatch\s*\(",
    "logging": r"ILogger\s*<\s*\w+\s*>",
    "repository": r"\b(IRepository\s*<|IRepository\b|Repository\s*<)",
}


def pattern_counts(texts: DataFrame, patterns: dict[str, str], key: str, text: str = "text", examples: int = 3) -> DataFrame:
    """Per pattern: matches, texts that have any, and the first keys."""
    found = texts.select(F.col(key).alias("k"), *[F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias(n) for n, p in patterns.items()])
    each = found.select("k", F.explode(F.create_map(*[x for n in patterns for x in (F.lit(n), F.col(n))])).alias("pattern", "n")).where("n > 0")
    # counts combine in the input tasks; the examples are the smallest keys of the smallest keys of groups
    group = Window.partitionBy("pattern", F.pmod(F.xxhash64("k"), F.lit(512))).orderBy("k")
    some = each.withColumn("r", F.row_number().over(group)).where(F.col("r") <= examples)
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("k"))).where(F.col("r") <= examples).groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("examples"))
    return each.groupBy("pattern").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("texts")).join(first, "pattern")
