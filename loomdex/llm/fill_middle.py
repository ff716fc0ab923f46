"""Fill-in-middle transformation: texts cut at two token boundaries and put together in another order.

A text is held as maximal runs of letters and of other characters, with the units (tokens)
before each run: a run of letters is one unit, every other character is one. The run that a
cut falls into is found by binary search over these counts, and the cut's place in the text
is the run's start plus what is left over. Cuts and forms come from hashes of the id, so
reruns agree and nothing but the texts themselves is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, text_of

#: Marks of prefix, suffix and middle; a text that holds one stays plain.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that are rearranged, and of a hundred of these, those with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Characters of output after which a batch leaves the task.
BATCH_CHARS = 4_000_000


class Runs:
    """The runs of a text: where each starts, and the units before it; both with a last entry for the end."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        letter = (codes | 32) - codes.dtype.type(ord("a")) < 26  # unsigned: what lies below wraps around
        begins = np.r_[0, np.flatnonzero(letter[1:] != letter[:-1]) + 1] if len(codes) else np.zeros(0, np.int64)
        self.starts = np.r_[begins, len(codes)]
        self.units = np.r_[0, np.cumsum(np.where(letter[begins], 1, np.diff(self.starts)))]

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def place(self, cut: int) -> int:
        """Characters before the first ``cut`` units."""
        run = int(np.searchsorted(self.units, cut, "right")) - 1
        return int(self.starts[run]) + cut - int(self.units[run])


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of an id: the first four groups of eight hex digits of the SHA-256 of ``1:`` and the id; a null id counts as no text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(text: str, h: list[int], marks: tuple[str, str, str], rearranged: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    runs = Runs(text)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rearranged:
        return runs.n, "plain", None, None, text
    first, last = sorted((h[0] % (runs.n + 1), h[1] % (runs.n + 1)))
    a, b = runs.place(first), runs.place(last)
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return runs.n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return runs.n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``id_col``, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    Null texts count as empty; empty texts and those that hold a mark stay plain, as do ``100 - rearranged``
    of a hundred others, and have null prefix_chars and middle_chars. Rows of the same id have the same
    draws; null ids share theirs. Other columns are ignored; an empty table gives no rows. No shuffle.
    ``marks`` are three different texts of the form ``<...>`` without angle brackets within.
    """
    if len(set(marks)) < 3 or not all(m[0] == "<" and m[-1] == ">" and len(m) > 2 and not set(m[1:-1]) & set("<>") for m in marks):
        raise ValueError("marks must be three different texts <...>")  # else a mark could begin in the text before it
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id_col)))])
    kind = kind_of(rows, "id")

    def run(batches):
        for batch in batches:
            begin, held, found = 0, 0, []
            hashes = [batch.column(2 + i).to_pylist() for i in range(4)]
            for i in range(batch.num_rows):
                found.append(arranged(batch.column(1)[i].as_py(), [h[i] for h in hashes], marks, rearranged, suffix_first))
                held += len(found[-1][-1])
                if held >= BATCH_CHARS or i == batch.num_rows - 1:
                    columns = zip(*found, strict=True)
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin : i + 1], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    begin, held, found = i + 1, 0, []

    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made of."""
    parts = F.split(output, "|".join(marks), -1)  # marks have no pattern characters but what fill_in_middle allows
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_middle(spark, sf_dir):
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
