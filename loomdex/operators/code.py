"""Symbols, skeletons, sketches and reduction of C# files: one Python stage a file, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import csharp
from ..functions.text import approximate_tokens, is_trivial
from .delta import api_delta
from .reduce import drop_blank_lines, redact, redaction_counts, reduce_files, trim_lines
from .shared import numbered, saved

#: Files of more tokens than this are shown as a sketch; members of a type that a sketch names.
SKETCH_TOKENS, SKETCH_MEMBERS = 6000, 40


def per_file(files: DataFrame, schema: str, rows: Callable[..., Iterable[tuple]], inputs: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """(keep..., schema...): what ``rows(*inputs)`` gives for each file; null texts are empty."""
    out = StructType([files.schema[c] for c in keep] + _parse_datatype_string(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            made: list[list] = [[] for _ in out.fields]
            for held, *values in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keep))), strict=True), *(batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))), strict=True):
                for row in rows(*("" if v is None else v for v in values)):
                    for column, value in zip(made, (*held, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return files.select(*keep, *inputs).mapInArrow(run, out)


SYMBOLS = "kind string, name string, containing_type string, fqn string, access string, is_public boolean, signature string, start_line int, end_line int, tokens int, body string"


def csharp_symbols(files: DataFrame) -> DataFrame:
    """(file_path, kind, name, containing_type, fqn, access, is_public, signature, start_line, end_line, tokens, body): types and members."""
    return per_file(files, SYMBOLS, csharp.symbols)


def chunks(symbols: DataFrame) -> DataFrame:
    """Index chunks of symbols: chunk_id, file_path, kind, lines, text_hash, token estimates of body and signature, and the fields that are searched."""
    place = F.concat_ws(":", F.lit("chunk"), "file_path", "kind", "fqn", "start_line")
    reduced = F.floor((F.length("signature") + 3) / 4).cast("int")
    return symbols.select(place.alias("chunk_id"), "file_path", "kind", "start_line", "end_line", F.sha2("body", 256).alias("text_hash"), F.col("tokens").alias("token_estimate"), reduced.alias("reduced_token_estimate"), "name", "signature", F.concat_ws(" ", "containing_type", "name").alias("symbols_text"), "body")


def outlines(files: DataFrame) -> DataFrame:
    """(file_path, kind, name, members) of the declared types."""
    return per_file(files, "kind string, name string, members array<string>", csharp.outline)


def reduced(files: DataFrame, options: csharp.Reduction = csharp.Reduction()) -> DataFrame:
    """``files`` with reduced. Equal texts are reduced once: the cache is the distinct text, by hash."""
    held = files.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    one = held.groupBy("text_hash").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    done = per_file(one, "reduced string", lambda t: [(csharp.reduce_code(t, options),)], keep=("text_hash",))
    return held.join(done, "text_hash").drop("text_hash")


def skeletons(files: DataFrame, public_only: bool = False) -> DataFrame:
    return per_file(files, "skeleton string", lambda t: [(csharp.skeleton(t, public_only),)])


def thin_skeletons(files: DataFrame, chosen: str = "chosen") -> DataFrame:
    """``files``: file_path, text and the qualified names of the members to keep whole."""
    return per_file(files, "skeleton string", lambda t, names: [(csharp.thin_skeleton(t, set(names)),)], ("text", chosen))


def slices(files: DataFrame, name: str = "name") -> DataFrame:
    """``files``: file_path, text, name; a row for each file that declares it."""
    return per_file(files, "slice string", lambda t, n: [(s,)] if (s := csharp.symbol_slice(t, n)) is not None else [], ("text", name))


def sketched(files: DataFrame, tokens: str = "tokens", most: int = SKETCH_TOKENS) -> DataFrame:
    """(file_path, content): files of more than ``most`` tokens as a sketch, where they have one, others as they are."""
    return per_file(files, "content string", lambda path, t, n: [(csharp.sketch(path, t, SKETCH_MEMBERS) or t if n > most else t,)], ("file_path", "text", tokens))


def changed_file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """API delta (see ``api_delta``) of the types in two versions of changed files (file_path, text); a file may lack either."""
    surface = lambda files: csharp_symbols(files).where(F.col("kind").isin(list(csharp.TYPES)) & F.col("is_public")).select("fqn", "access", "signature", F.struct("file_path", "start_line").alias("seq"))
    return api_delta(surface(before), surface(after))


def report(delta: DataFrame) -> DataFrame:
    """One line for each change of an API delta, in its order: line_no from 1, line."""
    text = F.concat(F.when(F.col("breaking"), "breaking ").otherwise(""), "kind", F.lit(": "), "fqn")
    ordered = delta.withColumn("o1", F.when(F.col("breaking"), 0).otherwise(1)).orderBy("o1", "fqn")
    return ordered.select(text.alias("line"))


def direct_callers(symbols: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """(caller, type): files, other than the changed ones, that name a type which a changed file declares."""
    types = symbols.where(F.col("kind").isin(list(csharp.TYPES))).join(changed.select("file_path").distinct(), "file_path", "left_semi").select(F.col("name").alias("type")).distinct()
    names = files.join(changed.select("file_path").distinct(), "file_path", "left_anti").select(F.col("file_path").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("type"))
    return names.join(types, "type").select("caller", "type")




def reduction(files: DataFrame, options: csharp.Reduction = csharp.Reduction(), skeleton: str | None = None, redacted: bool = True) -> DataFrame:
    """(file_path, content, tokens, secrets) of files (file_path, text), in the fixed order of steps: lines are trimmed, blank ones
    dropped, the reducer of the extension applied, C# cut to a skeleton ("all" or "public"), secrets redacted, tokens counted.

    Files with nothing of use left are dropped. Other extensions than those with a reducer lose only blank lines and line ends.
    """
    extension = F.regexp_extract(F.lower("file_path"), r"(\.[^./]+)$", 1)
    plain = drop_blank_lines(trim_lines(F.coalesce("text", F.lit(""))))
    held = files.select("file_path", plain.alias("text"), extension.alias("extension"))

    def lexical(text: str) -> list[tuple]:
        done = csharp.reduce_code(text, options)
        return [(csharp.skeleton(done, skeleton == "public") if skeleton else done,)]

    ours = per_file(held.where("extension = '.cs'"), "reduced string", lexical)
    rest = reduce_files(held.where("extension <> '.cs'")).select("file_path", "reduced")
    both = saved(ours.unionByName(rest), "reduced")  # read several times below
    secrets = F.aggregate(F.map_values(redaction_counts(F.col("reduced"))), F.lit(0), lambda a, n: a + n) if redacted else F.lit(0)
    content = redact(F.col("reduced")) if redacted else F.col("reduced")
    out = both.select("file_path", content.alias("content"), approximate_tokens(content).alias("tokens"), secrets.alias("secrets"))
    return out.where(~is_trivial(F.col("content")))


def route_map(routes: DataFrame) -> DataFrame:
    """(line_no, line) of a map of routes, in order of their lines in any case: verb, pattern, file."""
    line = F.concat(F.rpad("verb", 7, " "), F.rpad("pattern", 40, " "), F.lit(" "), "file_path")
    return numbered(routes.select(line.alias("line")).withColumn("low", F.lower("line")), [F.col("low"), F.col("line")], "line_no").select("line_no", "line")


def project_graph(references: DataFrame) -> DataFrame:
    """(line_no, line) of the references between projects (project, reference), by name without folder and extension."""
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    lines = references.select(F.concat(name("project"), F.lit(" -> "), name("reference")).alias("line")).distinct()
    return numbered(lines.withColumn("low", F.lower("line")), [F.col("low"), F.col("line")], "line_no").select("line_no", "line")
