"""Packing, reduction, dedup, delta, streaming and metric queries."""

from __future__ import annotations

import datetime

import re

from pyspark.sql import functions as F

from ..functions import text
from ..operators import delta, extract, history, manifests, metrics, packing, reduce
from ..operators.shared import new_path
from ..streaming import changes, stateful
from . import graphs
from .fixtures import SYMBOLS_SQL, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def plan_rows(spark, d):
    """Documents as plan items: a plan for each 200 ids, the characters as cost, good labels must stay."""
    t = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("q")).distinct(), "doc_id", "left")
    return t.select(F.floor(F.col("doc_id") / 200).cast("string").alias("plan"), F.col("doc_id").alias("path"), ((F.col("doc_id") * 37 % 101) / 100).alias("score"), F.col("n_chars").alias("cost"), (F.coalesce("q", F.lit(False)) & (F.col("doc_id") % 9 == 0)).alias("must_keep"))


PLAN_SQL = "p AS (SELECT (d.doc_id // 200)::VARCHAR AS plan, d.doc_id AS path, (d.doc_id * 37 % 101) / 100 AS score, n_chars AS cost, coalesce(l.q, false) AND d.doc_id % 9 = 0 AS must_keep FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, true AS q FROM labels WHERE quality = 1) l USING (doc_id))"


@query(
    "pck5_plan_packer",
    f"WITH RECURSIVE {PLAN_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY plan "
    f"ORDER BY CASE WHEN must_keep THEN 0 ELSE 1 END, -score, path) AS n FROM p), "
    f"f AS (SELECT plan, path, n, CASE WHEN must_keep OR cost <= 9000 THEN cost ELSE 0 END AS used, must_keep OR cost <= 9000 AS kept "
    f"FROM o WHERE n = 1 "
    f"UNION ALL SELECT o.plan, o.path, o.n, f.used + CASE WHEN must_keep OR f.used + cost <= 9000 THEN cost ELSE 0 END, must_keep OR f.used + cost <= 9000 "
    f"FROM f JOIN o ON o.plan = f.plan AND o.n = f.n + 1) SELECT path, kept FROM f",
)
def pck5(spark, d):
    return packing.pack_plan(plan_rows(spark, d), 9000).select("path", "kept")


@query(
    "pck7_emission_prefix",
    f"WITH {PLAN_SQL} SELECT path, n = 1 OR total <= 9000 AS kept "
    f"FROM (SELECT path, row_number() OVER w AS n, sum(cost) OVER (PARTITION BY plan "
    f"ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING) AS total FROM p WINDOW w AS (PARTITION BY plan ORDER BY score DESC, path))",
)
def pck7(spark, d):
    return packing.emit_prefix(plan_rows(spark, d).withColumn("o", -F.col("score")), 9000, ["o", "path"]).select("path", "kept")


@query(
    "pck7_emission_parts",
    f"WITH RECURSIVE {PLAN_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY path) AS n FROM p), "
    f"f AS (SELECT plan, path, n, cost AS used, 1 AS part FROM o WHERE n = 1 "
    f"UNION ALL SELECT o.plan, o.path, o.n, CASE WHEN f.used > 0 AND f.used + cost > 9000 THEN cost ELSE f.used + cost END, f.part + CASE WHEN f.used > 0 AND f.used + cost > 9000 THEN 1 ELSE 0 END "
    f"FROM f JOIN o ON o.plan = f.plan AND o.n = f.n + 1) SELECT path AS seq, part::INTEGER AS part FROM f",
)
def pck7b(spark, d):
    return packing.emit_parts(plan_rows(spark, d).select("plan", F.col("path").alias("seq"), "cost"), 9000).select("seq", "part")


@query("pck8_emission_order", f"WITH {PLAN_SQL} SELECT path, row_number() OVER (PARTITION BY plan ORDER BY score DESC, cost DESC, path)::INTEGER AS seq FROM p")
def pck8(spark, d):
    return packing.emission_order(plan_rows(spark, d).withColumnRenamed("cost", "tokens")).select("path", "seq")


@query(
    "pck9_downgrade_tail",
    f"WITH {PLAN_SQL} SELECT path, CASE WHEN total > 9000 AND least(cost, 300) < cost THEN 300 ELSE cost END AS tokens "
    f"FROM (SELECT *, sum(cost) OVER (PARTITION BY plan ORDER BY path ROWS UNBOUNDED PRECEDING) AS total FROM p)",
)
def pck9(spark, d):
    rows = plan_rows(spark, d).select("plan", "path", F.col("cost").alias("tokens"), F.least("cost", F.lit(300)).alias("sketch_tokens"))
    return packing.downgrade_tail(rows, 9000, ["path"]).select("path", "tokens")


@query("pck12_contents_table", "SELECT source AS folder, count(*) AS files, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY 1")
def pck12(spark, d):
    return packing.contents_table(table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("n_chars").alias("tokens")))


@query("pck13_token_costs", "SELECT doc_id, round(n_chars * CASE WHEN lang = 'en' THEN 0.70 ELSE 0.95 END)::BIGINT AS cost FROM documents")
def pck13(spark, d):
    return table(spark, d, "documents").select("doc_id", text.reduced_token_cost(F.col("n_chars"), F.when(F.col("lang") == "en", ".cs").otherwise(".md"), "aggressive").alias("cost"))


@query(
    "pck14_approximate_tokens",
    "SELECT doc_id, (coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+'), lambda r: ceil(length(r) / 4.0))), "
    "0) + len(regexp_extract_all(text, '[^\\p{L}\\p{Nd}\\s]')))::BIGINT AS tokens FROM documents",
)
def pck14(spark, d):
    return table(spark, d, "documents").select("doc_id", text.approximate_tokens(F.col("text")).alias("tokens"))


@query(
    "pck16_review_bound",
    "WITH d AS (SELECT doc_id::VARCHAR AS file_path, count(*) OVER () AS n "
    "FROM documents) SELECT file_path, CASE WHEN n <= 150 THEN 'review' ELSE 'listed' END AS state FROM d "
    "QUALIFY n <= 150 OR row_number() OVER (ORDER BY file_path) <= 200",
)
def pck16(spark, d):
    return packing.review_bound(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path")))


@query(
    "pck3_roles",
    "SELECT l_shipmode AS via, role, CASE role WHEN 'exact-seed' THEN 'reduced' WHEN 'config' THEN 'full' WHEN 'di-implementation' THEN 'reduced' WHEN 'route-handler' THEN 'reduced' ELSE 'skeleton' END AS tier, n "
    "FROM (SELECT CASE l_linenumber WHEN 1 THEN 'tests' WHEN 2 THEN 'di_resolves_to' WHEN 3 THEN 'options_binds' WHEN 4 THEN 'route_handles' WHEN 5 THEN 'di_injects' ELSE 'x' END AS l_shipmode, "
    "CASE WHEN l_orderkey % 5 = 0 THEN 'exact-seed' ELSE CASE l_linenumber WHEN 1 THEN 'test' WHEN 2 THEN 'di-implementation' WHEN 3 THEN 'config' WHEN 4 THEN 'route-handler' WHEN 5 THEN 'consumer' ELSE 'dependency' END END AS role, "
    "count(*) AS n FROM lineitem GROUP BY 1, 2)",
)
def pck3(spark, d):
    """Roles and tiers of links whose type follows from the line's number; every fifth order's are seeds."""
    kinds = F.lit(["tests", "di_resolves_to", "options_binds", "route_handles", "di_injects"])
    rows = table(spark, d, "lineitem").select(F.coalesce(F.get(kinds, F.col("l_linenumber").cast("int") - 1), F.lit("x")).alias("via"), (F.col("l_orderkey") % 5 == 0).alias("seed"))
    counted = rows.withColumn("role", packing.role(F.col("via"), F.col("seed"))).groupBy("via", "role").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("tier", packing.tier(F.col("role")))


@query(
    "red6_html_reducer",
    "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
    "'>\\s+<', '><', 'g'), '(\\S+)=\"([^\"\\s<>&'']+)\"', '\\1=\\2', 'g'), ' {2,}', ' ', 'g'), '(?m)^\\s+|\\s+$', '', 'g') AS reduced "
    "FROM pages",
)
def red6(spark, d):
    return table(spark, d, "pages").select("page_id", reduce.reduce_text(F.col("html"), "html").alias("reduced"))


@query(
    "red8_json_reducer",
    "SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(props, '[\\r\\n]+', '', 'g'), "
    "':\\s+', ':', 'g'), ',\\s+', ',', 'g'), '([\\[{])\\s+', '\\1', 'g'), '\\s+([\\]}])', '\\1', 'g') AS reduced FROM events",
)
def red8(spark, d):
    return table(spark, d, "events").select("event_id", reduce.reduce_text(F.col("props"), "json").alias("reduced"))


@query("red1_reduce_files")
def red1(spark, d):
    """Every document by the reducer of an extension that its language stands for."""
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".js").when(F.col("lang") == "de", ".yaml").otherwise(".txt")
    return reduce.reduce_files(table(spark, d, "documents").select("doc_id", "text", ext.alias("extension"))).select("doc_id", F.length("reduced").alias("chars"))


@query(
    "red14_redaction",
    "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), "
    "'(?i)\\b(?:token|secret|password|api[_-]?key)\\s*[:=]\\s*[\"'']?[A-Za-z0-9+/_-]{12,}[\"'']?'))::INTEGER AS secrets FROM documents",
)
def red14(spark, d):
    return table(spark, d, "documents").select("doc_id", reduce.redaction_counts(F.coalesce("text", F.lit("")))["assigned-secret"].alias("secrets"))


@query("red15_trivial", "SELECT doc_id, trim(coalesce(text, '')) IN ('', '{}', '[]') AS trivial FROM documents")
def red15(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_trivial(F.col("text")).alias("trivial"))


_PROSE = "trim(regexp_replace(regexp_replace(regexp_replace(c, '(?m)/\\*+|\\*+/|^\\s*\\*|///?|#', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "ext6_comments",
    f"SELECT page_id, length(array_to_string(list_filter(list_transform(regexp_extract_all(html, '/\\*(?s:.*?)\\*/|(?://[^\\n]*\\n?)+|(?:#[^\\n]*\\n?)+'), "
    f"lambda c: {_PROSE}), lambda c: c <> ''), ' '))::INTEGER AS chars FROM pages",
)
def ext6(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(text.comments(F.col("html"))).alias("chars"))


@query("ext8_token_estimate", "SELECT doc_id, floor((length(text) + 3) / 4)::BIGINT AS tokens FROM documents")
def ext8(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_TITLE = "trim(string_split(coalesce(text, ''), chr(10))[1])"


def _sql_pattern(pattern: str) -> str:
    """The pattern with Unicode's word boundaries, which the checking engine does not have."""
    edge = r"[^\p{L}\p{N}_]"
    return re.sub(r"\\b", lambda m: f"(?:{edge}|$)", re.sub(r"\\b(?=[\[(A-Za-z])", lambda m: f"(?:^|{edge})", pattern))


_BUCKETS = " ".join(f"WHEN regexp_matches(t, '{_sql_pattern(pattern)}') THEN '{name}'" for name, pattern in text.BUCKETS)


@query(
    "met5_title_buckets",
    f"SELECT CASE WHEN t = '' THEN 'no-signal' {_BUCKETS} ELSE 'nl-domain' END AS bucket, count(*) AS titles "
    f"FROM (SELECT {_TITLE} AS t FROM documents) GROUP BY 1",
)
def met5(spark, d):
    return table(spark, d, "documents").groupBy(text.title_bucket(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("bucket")).agg(F.count(F.lit(1)).alias("titles"))


@query(
    "ded1_shared_first_lines",
    "SELECT trim(string_split(text, chr(10))[1]) AS header, count(*) AS files, min(doc_id) AS first FROM documents "
    "WHERE length(trim(string_split(text, chr(10))[1])) >= 16 GROUP BY 1 HAVING count(*) >= 2",
)
def ded1(spark, d):
    return delta.line_dedup(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text"))


@query(
    "ded2_shared_bodies",
    "WITH b AS (SELECT doc_id, source AS path, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents), "
    "g AS (SELECT n, count(DISTINCT lower(path)) AS files FROM b WHERE length(n) >= 48 GROUP BY 1 "
    "HAVING count(DISTINCT lower(path)) >= 2) SELECT doc_id AS seq, files FROM b JOIN g USING (n)",
)
def ded2(spark, d):
    return delta.body_dedup(table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("seq"), F.col("text").alias("body"))).select("seq", "files")


@query(
    "ses2_session_states",
    "SELECT conv_id, turn, CASE WHEN b IS NULL THEN 'new' WHEN b = h THEN 'unchanged' ELSE 'changed' END AS state "
    "FROM (SELECT conv_id, turn, md5(coalesce(role, '')) AS h, lag(md5(coalesce(role, ''))) OVER (PARTITION BY conv_id "
    "ORDER BY turn) AS b FROM conversations)",
)
def ses2(spark, d):
    return delta.session_states(table(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "state")


@query("ses3_unified_diffs")
def ses3(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return t.select("doc_id", delta.unified_diff("text", F.regexp_replace("text", " the ", " a ")).alias("diff"))


@query(
    "pat1_pattern_counts",
    "SELECT pattern, sum(n)::BIGINT AS matches, count(*) AS texts "
    "FROM (SELECT 'caps' AS pattern, len(regexp_extract_all(coalesce(text, ''), '[A-Z]{4,}')) AS n FROM documents "
    "UNION ALL SELECT 'license', len(regexp_extract_all(coalesce(text, ''), '(?i)license')) FROM documents) WHERE n > 0 GROUP BY 1",
)
def pat1(spark, d):
    return delta.pattern_counts(table(spark, d, "documents"), {"caps": "[A-Z]{4,}", "license": "(?i)license"}, "doc_id").select("pattern", "matches", "texts")


_OLD, _NEW = "SELECT fqn, CASE WHEN is_public THEN 'public' ELSE 'internal' END AS access, 'f' || symbol_id % 7 AS signature FROM symbols WHERE symbol_id % 10 <> 3", "SELECT fqn, CASE WHEN is_public AND symbol_id % 6 <> 0 THEN 'public' ELSE 'internal' END AS access, 'f' || (symbol_id % 7 + CASE WHEN symbol_id % 8 = 0 THEN 1 ELSE 0 END) AS signature FROM symbols WHERE symbol_id % 10 <> 4"


@query(
    "dif1_api_delta",
    f"WITH {SYMBOLS_SQL}, o AS (SELECT fqn, arg_min(access, (signature, access)) AS access, min(signature) AS signature FROM ({_OLD}) "
    f"GROUP BY 1), n AS (SELECT fqn, arg_min(access, (signature, access)) AS access, min(signature) AS signature FROM ({_NEW}) "
    f"GROUP BY 1), "
    f"j AS (SELECT coalesce(o.fqn, n.fqn) AS fqn, CASE WHEN n.fqn IS NULL THEN 'removed' WHEN o.fqn IS NULL THEN 'added' WHEN o.access = 'public' AND n.access = 'internal' THEN 'accessibility-reduced' WHEN o.signature <> n.signature THEN 'signature-changed' END AS kind "
    f"FROM o FULL JOIN n ON o.fqn = n.fqn) SELECT fqn, kind, kind <> 'added' AS breaking FROM j WHERE kind IS NOT NULL",
)
def dif1(spark, d):
    from .fixtures import symbols

    s = symbols(spark, d)
    access = lambda ok: F.when(ok, "public").otherwise("internal").alias("access")
    old = s.where("symbol_id % 10 <> 3").select("fqn", access(F.col("is_public")), F.concat(F.lit("f"), (F.col("symbol_id") % 7).cast("string")).alias("signature"))
    new = s.where("symbol_id % 10 <> 4").select("fqn", access(F.col("is_public") & (F.col("symbol_id") % 6 != 0)), F.concat(F.lit("f"), (F.col("symbol_id") % 7 + (F.col("symbol_id") % 8 == 0).cast("int")).cast("string")).alias("signature"))
    return delta.api_delta(old, new)


@query(
    "dif4_diagnostic_delta",
    "WITH o AS (SELECT l_partkey, l_returnflag, count(*) AS o FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), "
    "n AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2), "
    "j AS (SELECT coalesce(o.l_partkey, n.l_partkey) AS l_partkey, coalesce(o.l_returnflag, n.l_returnflag) AS l_returnflag, coalesce(n, 0) - coalesce(o, 0) AS d "
    "FROM o FULL "
    "JOIN n ON o.l_partkey = n.l_partkey AND o.l_returnflag = n.l_returnflag) SELECT l_partkey, l_returnflag, CASE WHEN d > 0 THEN 'introduced' ELSE 'fixed' END AS state, abs(d) AS times "
    "FROM j WHERE d <> 0",
)
def dif4(spark, d):
    li = table(spark, d, "lineitem")
    return delta.diagnostic_delta(li.where("l_linenumber <= 3"), li.where("l_linenumber >= 3"), ["l_partkey", "l_returnflag"])


@query(
    "dif5_freshness",
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN count(*) OVER () > 300 THEN 'stale' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state "
    "FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 3) o FULL JOIN (SELECT doc_id, n_chars + doc_id % 2 AS n_chars "
    "FROM documents WHERE doc_id % 10 <> 4) n ON o.doc_id = n.doc_id WHERE o.n_chars IS DISTINCT FROM n.n_chars OR n.doc_id IS NULL",
)
def dif5(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    return delta.freshness(t.where("doc_id % 10 <> 3"), t.where("doc_id % 10 <> 4").withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 2), "doc_id", "n_chars")


@query("dif5_freshness_by_trees", SQL["dif5_freshness"])
def dif5_trees(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    now = t.where("doc_id % 10 <> 4").withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 2)
    return manifests.freshness(spark, manifests.build(t.where("doc_id % 10 <> 3"), "doc_id", "n_chars"), manifests.build(now, "doc_id", "n_chars"))


@query(
    "dif6_nearest_names",
    "SELECT asked, name, distance, rank FROM (SELECT asked, name, levenshtein(lower(asked), "
    "lower(name))::INTEGER AS distance, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(lower(asked), lower(name)), "
    "name)::INTEGER AS rank FROM (SELECT DISTINCT p_name AS name FROM part), (SELECT DISTINCT s_name || 'x' AS asked FROM supplier)) "
    "WHERE rank <= 5",
)
def dif6(spark, d):
    asked = table(spark, d, "supplier").select(F.concat("s_name", F.lit("x")).alias("asked"))
    return delta.nearest_names(asked, table(spark, d, "part").select(F.col("p_name").alias("name")))


@query(
    "dif8_race",
    "SELECT o_custkey, CASE WHEN cleans = 1 AND n > 1 THEN w END AS winner, cleans >= 2 AS tie "
    "FROM (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS cleans, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS w "
    "FROM orders GROUP BY 1)",
)
def dif8(spark, d):
    return delta.race(table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate"), (F.col("o_orderstatus") == "F").alias("clean")), "o_custkey", "clean")


@query(
    "git1_change_stats",
    "SELECT l_partkey AS path, sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY THEN 1 ELSE 0 END)::BIGINT AS commits, max(l_shipdate) AS last_modified "
    "FROM lineitem GROUP BY 1",
)
def git1(spark, d):
    return delta.git_stats(table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("date")), datetime.datetime(1998, 1, 1))


@query("git1_stats_by_batches", SQL["git1_change_stats"])
def git1_batches(spark, d):
    """The same from a history that has been added to in batches and merged."""
    held = history.merged(spark, graphs.in_batches(spark, d))
    return history.stats(spark, held, datetime.datetime(1998, 1, 1))


def _changes(spark, d):
    return table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "Created").when(F.col("event_id") % 4 == 1, "Deleted").otherwise("Changed").alias("kind"))


@query(
    "str1_debounced_batches",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 WHEN ts = lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id "
    "ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g "
    "FROM e) SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events FROM g "
    "GROUP BY user_id, g",
)
def str1(spark, d):
    return changes.debounced(_changes(spark, d), "30 minutes", by=["user_id"])


_KIND = "CASE event_id % 4 WHEN 0 THEN 'Created' WHEN 1 THEN 'Deleted' ELSE 'Changed' END"
#: What is left of kinds in their order, as a fold.
_FOLD = "list_reduce(list(kind ORDER BY ts, event_id), lambda s, k: CASE WHEN s = 'Created' AND k = 'Deleted' THEN 'Nothing' WHEN s = 'Deleted' AND k = 'Created' THEN 'Changed' WHEN s = 'Created' AND k = 'Changed' THEN 'Created' ELSE k END)"


@query(
    "str2_coalesced_changes",
    f"SELECT * FROM (SELECT user_id, {_FOLD} AS kind, count(*) AS events FROM (SELECT *, {_KIND} AS kind FROM events) GROUP BY 1) WHERE kind <> 'Nothing'",
)
def str2(spark, d):
    return changes.coalesce_changes(_changes(spark, d), ["user_id"])


def _streamed(spark, source, time, make, parts=4):
    """What ``make`` gives of ``source`` as a stream, from the shared folder: micro-batches in the order of ``time``, a run each."""
    out = new_path(spark, "stream")
    low, high = source.agg(F.min(time), F.max(time)).first()
    bounds = [F.lit(low + i * ((high - low) / parts)) for i in range(parts)] if low is not None else []
    for begin, end in zip(bounds or [None], [*bounds[1:], None], strict=True):
        inside = F.lit(True) if begin is None else F.col(time) >= begin
        source.where(inside if end is None else inside & (F.col(time) < end)).write.mode("append").parquet(f"{out}/in")
        stream = make(spark.readStream.schema(source.schema).parquet(f"{out}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


_WORKSPACE_SQL = (
    f"e AS (SELECT user_id % 7 AS workspace, user_id::VARCHAR AS path, ts, event_id, {_KIND} AS kind FROM events), "
    "m AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 10 MINUTE, true)::INTEGER AS b FROM e WINDOW w AS (PARTITION BY workspace ORDER BY ts, event_id)), "
    "n AS (SELECT *, sum(b) OVER (PARTITION BY workspace ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m), "
    'x AS (SELECT workspace, n, min(ts) AS "start", max(ts) + INTERVAL 10 MINUTE AS "end" FROM n GROUP BY 1, 2), '
    f"f AS (SELECT workspace, n, path, {_FOLD} AS kind, count(*) AS events FROM n GROUP BY 1, 2, 3) "
    'SELECT workspace, "start", "end", path, kind, events FROM f JOIN x USING (workspace, n) WHERE kind <> \'Nothing\''
)


def _workspaces(spark, d):
    return _changes(spark, d).select((F.col("user_id") % 7).alias("workspace"), F.col("user_id").cast("string").alias("path"), "ts", "seq", "kind")


@query("str1_batches_of_changes", f"WITH {_WORKSPACE_SQL}")
def str1_batches(spark, d):
    return changes.batches_of_changes(_workspaces(spark, d), "10 minutes")


@query("str1_stream_of_changes", f"WITH {_WORKSPACE_SQL}")
def str1_stream(spark, d):
    """The same from a stream in several micro-batches, state by workspace; an event a day later closes the last batches."""
    kind = table(spark, d, "events").schema["ts"].dataType
    e = _workspaces(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).where("ts IS NOT NULL").select(F.lit(-1).cast("long").alias("workspace"), F.lit("-").alias("path"), "ts", F.lit(0).cast("long").alias("seq"), F.lit("Changed").alias("kind"))
    source = e.withColumn("workspace", F.col("workspace").cast("long")).unionByName(last)
    found = _streamed(spark, source, "ts", lambda s: stateful.debounced_changes(s, datetime.timedelta(minutes=10)))
    return found.withColumns({c: F.col(c).cast(kind) for c in ("start", "end")})


@query(
    "ses1_stream_of_deltas",
    "SELECT conv_id, turn, CASE WHEN b IS NULL THEN 'new' WHEN b = t THEN 'unchanged' WHEN length(b) <= 200 THEN 'diff' ELSE 'whole' END AS state "
    "FROM (SELECT conv_id, turn, coalesce(text, '') AS t, lag(coalesce(text, '')) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM conversations)",
)
def ses1_stream(spark, d):
    """Turns as what a session (a conversation) is given of a path (a role), a minute after each other."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.coalesce("role", F.lit("")).alias("path"), F.timestamp_seconds(F.col("turn").cast("long") * 60 + 1_700_000_000).alias("ts"), F.col("turn").cast("long").alias("seq"), "text")
    end = turns.agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")).where("ts IS NOT NULL").select(F.lit(-1).cast(turns.schema["session"].dataType).alias("session"), F.lit("-").alias("path"), "ts", F.lit(0).cast("long").alias("seq"), F.lit("").alias("text"))
    found = _streamed(spark, turns.unionByName(end), "ts", lambda s: stateful.session_deltas(s, retained=200)).where("session >= 0")
    return found.select(F.col("session").alias("conv_id"), F.col("seq").cast(table(spark, d, "conversations").schema["turn"].dataType).alias("turn"), "state")


@query("str3_stream_to_batches", "SELECT user_id, count(*) AS events FROM events GROUP BY 1")
def str3(spark, d):
    """The events as a stream of files, applied batch by batch to a table in the shared folder, as far as they go."""
    out = new_path(spark, "stream")
    source = table(spark, d, "events").select("event_id", "user_id")
    source.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{out}/in")
    changes.keep_index(stream, lambda batch, _: batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events")).write.mode("append").parquet(f"{out}/table"), f"{out}/progress")
    return spark.read.parquet(f"{out}/table").groupBy("user_id").agg(F.sum("events").alias("events"))


def _ranking(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), "n_chars")
    from pyspark.sql.window import Window

    return t.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "item")))


_TRUTH = "truth AS (SELECT source AS query, doc_id AS item FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
_RANKED = "ranking AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def _truth(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    return t.select(F.col("source").alias("query"), F.col("doc_id").alias("item"))


@query(
    "met1_set_metrics",
    f"WITH {_TRUTH}, {_RANKED}, r AS (SELECT query, item FROM ranking WHERE rank <= 20), m AS (SELECT query, (SELECT count(*) FROM r "
    f"WHERE r.query = x.query) AS got, (SELECT count(*) FROM truth t WHERE t.query = x.query) AS want, (SELECT count(*) FROM r "
    f"JOIN truth t ON r.query = t.query AND r.item = t.item WHERE r.query = x.query) AS hit FROM (SELECT query "
    f"FROM r UNION SELECT query "
    f"FROM truth) x) SELECT query, round(CASE WHEN want = 0 THEN 1 ELSE hit / want END, 6) AS recall, round(CASE WHEN got = 0 THEN 0 ELSE hit / got END, 6) AS precision, round(CASE WHEN hit = 0 AND want > 0 THEN 0 WHEN want = 0 AND (got = 0 OR hit = 0) THEN 0 ELSE 2 * hit / (got + want) END, 6) AS f1 "
    f"FROM m",
)
def met1(spark, d):
    found = metrics.set_metrics(_ranking(spark, d).where("rank <= 20"), _truth(spark, d))
    return found.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(
    "met2_ranked_metrics",
    f"WITH {_TRUTH}, {_RANKED}, w AS (SELECT query, count(*) AS want FROM truth GROUP BY 1), "
    f"h AS (SELECT r.query, max(1.0 / rank) AS rr, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS top, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg "
    f"FROM ranking r JOIN truth t ON r.query = t.query AND r.item = t.item GROUP BY 1), i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal "
    f"FROM range(1, 11) a(n), range(1, 11) b(k) WHERE k <= n GROUP BY 1) SELECT query, round(coalesce(rr, 0), "
    f"6) AS reciprocal_rank, round(coalesce(top / want, 0), 6) AS recall_at_k, round(coalesce(dcg / ideal, 0), 6) AS ndcg_at_k FROM w "
    f"LEFT JOIN h USING (query) JOIN i ON n = least(10, want)",
)
def met2(spark, d):
    found = metrics.ranked_metrics(_ranking(spark, d), _truth(spark, d))
    return found.select("query", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall_at_k", "ndcg_at_k")])


@query("met3_bootstrap_interval")
def met3(spark, d):
    return metrics.bootstrap_interval(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "quality")


@query(
    "met4_percentiles",
    "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), "
    "6) AS p95, count(*) AS n FROM events GROUP BY 1",
)
def met4(spark, d):
    return metrics.summary(table(spark, d, "events"), "value", ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "n")


@query("met6_stratified_sample")
def met6(spark, d):
    return metrics.stratified_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query(
    "met7_paired_deltas",
    "SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"F\", avg(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"O\", avg(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) - avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS delta "
    "FROM orders GROUP BY 1",
)
def met7(spark, d):
    return metrics.paired_deltas(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", "F", "O")


@query(
    "ext2_python_symbols",
    "SELECT doc_id AS file_path, 3 AS line_no, 'def' AS kind, 'f' || doc_id AS name, true AS is_public FROM documents "
    "UNION ALL SELECT doc_id, 2, 'class', '_C', false FROM documents",
)
def ext2(spark, d):
    """A small program made from each document's id."""
    source = F.concat(F.lit("# x\nclass _C(object):\n  async def f"), F.col("doc_id").cast("string"), F.lit("(self): pass"))
    return extract.python_symbols(table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), source.alias("text")))
