"""Full-text search, candidate fusion and grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stemmer, text
from ..operators import fusion, postings, search, substrings
from ..operators.shared import saved
from . import fixtures
from .fixtures import FILES_SQL, files, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"), F.col("source").alias("name"), F.col("lang").alias("symbols"), F.concat("source", F.lit("/"), F.col("lang")).alias("file_path"), F.md5("text").alias("content_hash"), "n_chars")


WEIGHTS = {"body": 1.0, "name": 5.0, "symbols": 4.0}
TERMS = [["thing"], ["src3"], ["fr"], ["of", "the"]]


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({column}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _count(field: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({field}, lambda x: x = '{phrase[0]}'))"
    return f"len(list_filter(range(1, greatest(len({field}), 1)), lambda i: {field}[i] = '{phrase[0]}' AND {field}[i + 1] = '{phrase[1]}'))"


_TF = ", ".join("(" + " + ".join(f"{w} * {_count(f, p)}" for f, w in WEIGHTS.items()) + f") AS f{i}" for i, p in enumerate(TERMS))
_N = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(TERMS)))
_PART = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(1e-6, ln((n - n{i} + 0.5) / (n{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(TERMS)))
BM25_SQL = f"""w AS (SELECT doc_id AS chunk_id, source, lang, {_words('text')} AS body, {_words('source')} AS name, {_words('lang')} AS symbols FROM documents),
c AS (SELECT chunk_id, source, lang, len(body) + len(name) + len(symbols) AS dl, {_TF} FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {_N} FROM c),
scored AS (SELECT chunk_id, source, lang, {_PART} AS score FROM c, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(TERMS)))}),
hits AS (SELECT chunk_id, source AS name, source || '/' || lang AS file_path, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM scored)"""


def stored(spark, d) -> postings.Index:
    """The index over a folder's documents."""
    return fixtures.stored(spark, d, "documents", lambda: postings.build(docs(spark, d), "chunk_id", list(WEIGHTS)))


@query("fts1_bm25", f"WITH {BM25_SQL} SELECT chunk_id, round(score, 6) AS score FROM scored")
def fts1(spark, d):
    return search.bm25(docs(spark, d), "", WEIGHTS, None, phrases=TERMS).select("chunk_id", F.round("score", 6).alias("score"))


def hits(spark, d, limit=60):
    found = postings.search(spark, stored(spark, d), "", WEIGHTS, limit, TERMS)
    ranks = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "chunk_id")) - 1)
    return docs(spark, d).select("chunk_id", "name", "file_path").join(F.broadcast(ranks), "chunk_id")  # limit rows


@query(
    "rnk3_lexical_candidates",
    f"WITH {BM25_SQL}, f AS (SELECT file_path, min(rank) AS first, max(CASE WHEN contains(lower(name), 'src3') OR contains(lower(name), "
    f"'thing') THEN 1 ELSE 0 END) AS named FROM hits WHERE rank < 60 GROUP BY 1), "
    f"p AS (SELECT *, row_number() OVER (ORDER BY first, file_path) - 1 AS place, count(*) OVER () AS n "
    f"FROM f) SELECT file_path, place, round(CASE WHEN named = 1 THEN 0.75 ELSE 0.55 END * (1 - CASE WHEN n > 1 THEN place / (n - 1) ELSE 0 END * 0.65), "
    f"6) AS score FROM p",
)
def rnk3(spark, d):
    return search.lexical_candidates(hits(spark, d), ["src3", "thing"]).select("file_path", "place", F.round("score", 6).alias("score"))


@query(
    "rnk4_feedback_terms",
    f"WITH {BM25_SQL}, h AS (SELECT * FROM hits WHERE rank < 60), f AS (SELECT file_path FROM h GROUP BY 1 ORDER BY min(rank), "
    f"file_path LIMIT 5) SELECT lower(name) AS term, count(*) AS n FROM h WHERE file_path IN (SELECT file_path "
    f"FROM f) AND lower(name) <> 'thing' GROUP BY 1 ORDER BY n DESC, term LIMIT 6",
)
def rnk4(spark, d):
    return search.feedback_terms(hits(spark, d), ["thing"])


@query(
    "rnk5_path_candidates",
    f"WITH {FILES_SQL}, a AS (SELECT file_path, 0 AS token FROM files WHERE file_path ILIKE '%src1%' ORDER BY length(file_path), "
    f"file_path LIMIT 20), b AS (SELECT file_path, 1 AS token FROM files WHERE file_path ILIKE '%.fr%' ORDER BY length(file_path), "
    f"file_path LIMIT 20) SELECT file_path, min(token)::INTEGER AS token, 0.7::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * "
    f"FROM b) GROUP BY 1",
)
def rnk5(spark, d):
    return search.path_candidates(files(spark, d), ["src1", "is", ".fr"], 20)


@query("rnk5_path_candidates_by_trigrams", SQL["rnk5_path_candidates"])
def rnk5_indexed(spark, d):
    f = files(spark, d)
    return search.path_candidates(f, ["src1", "is", ".fr"], 20, index=fixtures.path_trigrams(spark, d))


@query(
    "fts4_identifier_parts",
    "SELECT page_id, list_aggregate(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(url, '[^A-Za-z0-9]', ' ', 'g'), "
    "'[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2)), 'count') AS parts FROM pages",
)
def fts4(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(text.identifier_parts(F.col("url"))).cast("long").alias("parts"))


@query("fts5_stems")
def fts5(spark, d):
    """Stems of the distinct words; a word is stemmed once however often it stands."""
    found = table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return found.select("word", stemmer.stem_column("word").alias("stem"), "n")


@query("fts3_postings", f"SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY 1, 2")
def fts3(spark, d):
    return postings.occurrences(docs(spark, d), "chunk_id", ["body"]).where("term IS NOT NULL").select("chunk_id", "term", F.get("tfs", F.lit(0)).alias("tf"))


@query("fts1_stored_index", f"WITH {BM25_SQL} SELECT chunk_id, round(score, 6) AS score FROM scored")
def fts1_stored(spark, d):
    """The same search by a stored index."""
    return postings.search(spark, stored(spark, d), "", WEIGHTS, None, TERMS).select("chunk_id", F.round("score", 6).alias("score"))


@query("fts1_best_blocks", f"WITH {BM25_SQL} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, chunk_id LIMIT 80")
def fts1_best(spark, d):
    """The best 80 chunks; blocks that cannot hold one of them are passed over."""
    return postings.search(spark, stored(spark, d), "", WEIGHTS, 80, TERMS).select("chunk_id", F.round("score", 6).alias("score"))


def _changed(spark, d):
    """A tenth of the chunks with other texts, and a tenth that go."""
    t = docs(spark, d)
    return t.where("chunk_id % 10 = 3").withColumn("body", F.concat_ws(" ", "name", "symbols")), t.where("chunk_id % 10 = 7")


_LOG_SQL = BM25_SQL.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN source || ' ' || lang ELSE text END AS text, source, lang FROM documents WHERE doc_id % 10 <> 7))", 1)


@query("snk2_search_of_log", f"WITH {_LOG_SQL} SELECT chunk_id, round(score, 6) AS score FROM scored")
def snk2_log(spark, d):
    """Scores from an index whose last segment changes a tenth of the chunks and removes a tenth."""
    index = postings.replace(stored(spark, d), *_changed(spark, d))
    return postings.search(spark, index, "", WEIGHTS, None, TERMS).select("chunk_id", F.round("score", 6).alias("score"))


@query("snk2_best_of_compacted", f"WITH {_LOG_SQL} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, chunk_id LIMIT 80")
def snk2_compacted(spark, d):
    """The best of the same index after its segments were made one."""
    index = postings.compacted(spark, postings.replace(stored(spark, d), *_changed(spark, d)))
    return postings.search(spark, index, "", WEIGHTS, 80, TERMS).select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "snk2_replaced_postings",
    f"WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN source || ' ' || lang ELSE text END AS text FROM documents "
    f"WHERE doc_id % 10 <> 7) SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_words('text')}) AS term "
    f"FROM c) GROUP BY 1, 2",
)
def snk2(spark, d):
    """An index of all documents in which a tenth have another text afterwards and a tenth are gone."""
    index = postings.replace(stored(spark, d), *_changed(spark, d))
    return index.postings(spark).where("field = 'body'").select("chunk_id", "term", "tf")


@query(
    "fts2_match_terms",
    "SELECT * FROM (VALUES ('OrderService', 'orderservice|order|service|servic'), ('get_user_id', 'get user id|get|user|id'), "
    "('parse2Cats', 'parse2cats|parse|cats|pars|cat')) v(query, terms)",
)
def fts2(spark, d):
    asked = ["OrderService", "get_user_id", "parse2Cats"]
    return spark.createDataFrame([(q, "|".join(" ".join(p) for p in text.match_terms(q))) for q in asked], "query string, terms string")


@query(
    "fts6_expansion_fields",
    "SELECT p_partkey AS chunk_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), "
    "'[a-z]+|[0-9]+')), lambda x: length(x) >= 2)), ' ') AS subtokens FROM part",
)
def fts6(spark, d):
    return postings.expanded(table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))).select("chunk_id", F.array_join(F.array_sort(F.split("subtokens", " ")), " ").alias("subtokens"))


@query(
    "fts7_lines_with_text",
    "SELECT doc_id, count(*) AS hits, min(pos)::INTEGER AS first_line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), "
    "chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) "
    "WHERE contains(lower(line), 'license') GROUP BY 1",
)
def fts7(spark, d):
    return search.lines_with(table(spark, d, "documents"), "LICENSE", key="doc_id")


@query("fts7_lines_by_trigrams", SQL["fts7_lines_with_text"])
def fts7_indexed(spark, d):
    """The same, taking only those texts apart that have the rarest trigrams of the fragment."""
    t = table(spark, d, "documents")
    index = fixtures.stored(spark, d, "lines", lambda: substrings.build(t, "text", ["doc_id"], inline=False))
    return search.lines_with(t, "LICENSE", key="doc_id", index=index)


@query(
    "rnk1_low_signal",
    "SELECT doc_id, (t = '' OR regexp_matches(t, '(?i)^(merge([^\\p{L}\\p{N}_]|$)|apply suggestions from code review)') OR regexp_matches(t, '(?i)^(bump|upgrade)([^\\p{L}\\p{N}_]|$)|\\bdependabot\\b|\\bfrom\\s+v?\\d[\\w.\\-]*\\s+to\\s+v?\\d[\\w.\\-]*') OR regexp_matches(t, '(?i)^(ci|build|chore)(\\(|:|[^\\p{L}\\p{N}_]|$)')) AS low "
    "FROM (SELECT doc_id, trim(string_split(coalesce(text, ''), chr(10))[1]) AS t FROM documents)",
)
def rnk1(spark, d):
    return table(spark, d, "documents").select("doc_id", text.low_signal(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("low"))


@query(
    "rnk7_source_weights",
    "SELECT source, CASE source WHEN 'diff_changed_file' THEN 1.0 WHEN 'fts_body' THEN 0.55 ELSE 0.5 END::DOUBLE AS weight, count(*) AS candidates "
    "FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'diff_changed_file' WHEN 1 THEN 'fts_body' ELSE o_orderstatus END AS source FROM orders) GROUP BY 1",
)
def rnk7(spark, d):
    source = F.when(F.col("o_orderkey") % 3 == 0, "diff_changed_file").when(F.col("o_orderkey") % 3 == 1, "fts_body").otherwise(F.col("o_orderstatus"))
    counted = table(spark, d, "orders").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("candidates"))
    return counted.withColumn("weight", fusion.source_weight(F.col("source")))


def candidates(spark, d):
    """Three sources of candidates over documents: by quality label, by length, and by being about one source."""
    t = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("file_path"), "n_chars", "source")
    row = lambda frame, score, source: frame.select(F.col("doc_id").cast("string").alias("node_id"), "file_path", score.alias("score"), F.lit(source).alias("source"), F.col("n_chars").alias("tokens"))
    a = row(t.join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi"), F.lit(0.55), "fts_body")
    b = row(t.where("n_chars > 2000"), F.least(F.lit(1.2), F.col("n_chars") / 20000), "fts_symbol")
    c = row(t.where("source = 'src3'"), F.lit(0.7), "fts_path")
    return a.unionByName(b).unionByName(c).withColumn("node_id", F.when(F.col("source") == "fts_path", F.lit(None)).otherwise(F.col("node_id")))


CANDIDATES_SQL = """t AS (SELECT doc_id, source || '/' || lang AS file_path, n_chars, source FROM documents),
cand AS (SELECT doc_id::VARCHAR AS node_id, file_path, 0.55::DOUBLE AS score, 'fts_body' AS source, n_chars AS tokens FROM t WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT doc_id::VARCHAR, file_path, least(1.2, n_chars / 20000), 'fts_symbol', n_chars FROM t WHERE n_chars > 2000
UNION ALL SELECT NULL, file_path, 0.7, 'fts_path', n_chars FROM t WHERE source = 'src3'),
fused AS (SELECT coalesce(node_id, 'file:' || file_path) AS key, min(file_path) AS file_path, 1 - product(1 - least(1, greatest(0, score))) AS score, arg_min(source, (-least(1, score), source)) AS "primary", array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(tokens) AS tokens FROM cand GROUP BY 1)"""


def fused(spark, d):
    return fusion.noisy_or(candidates(spark, d))


@query("rnk8_noisy_or", f'WITH {CANDIDATES_SQL} SELECT key, file_path, round(score, 8) AS score, "primary", sources, tokens FROM fused')
def rnk8(spark, d):
    return fused(spark, d).withColumn("score", F.round("score", 8)).withColumn("sources", F.array_join("sources", ","))


@query(
    "rnk9_centrality_prior",
    f"WITH {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, key) AS rank FROM fused), "
    f"cen AS (SELECT file_path, count(*) * 1.0 / max(count(*)) OVER () AS c FROM fused "
    f"GROUP BY 1) SELECT key, round(CASE WHEN rank <= 30 THEN least(1, score * (1 + 0.1 * c)) ELSE score END, 8) AS score FROM r "
    f"JOIN cen USING (file_path)",
)
def rnk9(spark, d):
    f = fused(spark, d)
    n = f.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    c = f.select("key", "file_path").join(n, "file_path").crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("key", (F.col("n") / F.col("most")).alias("centrality"))
    return fusion.centrality_prior(f, c).select("key", F.round("score", 8).alias("score"))


@query(
    "rnk10_cochange_prior",
    f"WITH {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, key) AS rank FROM fused), "
    f"pairs AS (SELECT DISTINCT source || '/en' AS a, source || '/fr' AS b, 0.5 AS j FROM documents), both_ AS (SELECT a, b, j "
    f"FROM pairs UNION ALL SELECT b, a, j FROM pairs), best AS (SELECT c.key, max(j) AS j FROM r s JOIN both_ ON both_.a = s.file_path "
    f"JOIN r c ON c.file_path = both_.b WHERE s.rank <= 8 AND c.rank <= 30 AND s.score > c.score "
    f"GROUP BY 1) SELECT r.key, round(CASE WHEN rank <= 30 THEN least(1, score * (1 + 0.15 * coalesce(best.j, 0))) ELSE score END, 8) AS score "
    f"FROM r LEFT JOIN best USING (key)",
)
def rnk10(spark, d):
    pairs = table(spark, d, "documents").select(F.concat("source", F.lit("/en")).alias("a"), F.concat("source", F.lit("/fr")).alias("b"), F.lit(0.5).alias("jaccard")).distinct()
    return fusion.cochange_prior(fused(spark, d), pairs).select("key", F.round("score", 8).alias("score"))


@query(
    "rnk11_grade",
    f"WITH {CANDIDATES_SQL}, t2 AS (SELECT max(score) AS top, count(*) AS candidates FROM fused), "
    f"l AS (SELECT sum(CASE WHEN score >= top - 0.15 THEN 1 ELSE 0 END)::BIGINT AS cluster "
    f"FROM fused, t2) SELECT candidates, round(top, 6) AS top, cluster, CASE WHEN candidates = 0 OR top < 0.2 THEN 'insufficient' WHEN top < 0.55 THEN 'partial' WHEN candidates = 1 THEN 'confident' WHEN cluster <= 3 AND cluster < candidates THEN 'confident' ELSE 'partial' END AS grade "
    f"FROM t2, l",
)
def rnk11(spark, d):
    return fusion.grade(fused(spark, d)).withColumn("top", F.round("top", 6))


@query(
    "rnk12_selection",
    f"WITH {CANDIDATES_SQL}, t2 AS (SELECT max(score) AS top, count(*) AS n FROM fused), "
    f"r AS (SELECT key, score, top, n, sum(CASE WHEN score >= top - 0.15 THEN 1 ELSE 0 END) OVER () AS cluster, row_number() OVER (ORDER BY score DESC, file_path, key) AS rank "
    f"FROM fused, t2) SELECT key, round(score, 6) AS score FROM r "
    f"WHERE CASE WHEN top >= 0.55 AND cluster <= 3 AND cluster < n THEN score >= top - 0.15 ELSE rank <= 10 END",
)
def rnk12(spark, d):
    return fusion.select_candidates(fused(spark, d)).select("key", F.round("score", 6).alias("score"))


@query(
    "rnk13_content_dedup",
    "SELECT doc_id "
    "FROM (SELECT doc_id, row_number() OVER (PARTITION BY CASE WHEN doc_id % 11 = 0 THEN doc_id::VARCHAR ELSE md5(text) END "
    "ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1",
)
def rnk13(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars", "text")
    return fusion.content_dedup(t.select("doc_id", "n_chars"), t.where("doc_id % 11 <> 0").select("doc_id", F.md5("text").alias("content_hash")), [F.desc("n_chars"), F.col("doc_id")], "doc_id").select("doc_id")


@query("rnk6_changed_candidates", "SELECT DISTINCT lang AS file_path, 1.0::DOUBLE AS score FROM documents WHERE doc_id % 3 = 0 OR source = 'src4'")
def rnk6(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("file_path"))
    return fusion.changed_candidates(t.where("doc_id % 3 = 0"), t.where("source = 'src4'"))


@query("rnk15_navigation_areas", "SELECT source AS area, count(*) AS files FROM documents GROUP BY 1 ORDER BY files DESC, area LIMIT 6")
def rnk15(spark, d):
    return fusion.navigation_areas(files(spark, d))
