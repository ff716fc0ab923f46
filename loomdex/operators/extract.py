"""Symbols, routes and wiring edges from source text, approximately: lexical rules, no compiler."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Declarations of two languages by line.
PYTHON = r"^\s*(?:async\s+)?(class|def)\s+([A-Za-z_]\w*)"
SCRIPT = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(class|function)\*?\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>))"
CSHARP_TYPE = r"(public|internal|protected|private)?\s*(?:static\s+|sealed\s+|abstract\s+|partial\s+)*(class|interface|record|struct|enum)\s+([A-Za-z_]\w*)(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*(?::\s*([^{\n]+))?"


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    return files.select("file_path", F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")


def python_symbols(files: DataFrame) -> DataFrame:
    found = lines(files).withColumn("kind", F.regexp_extract("line", PYTHON, 1)).withColumn("name", F.regexp_extract("line", PYTHON, 2)).where("name <> ''")
    return found.select("file_path", "line_no", "kind", "name", (~F.startswith("name", F.lit("_"))).alias("is_public"))


def script_symbols(files: DataFrame) -> DataFrame:
    named = lines(files).withColumn("kw", F.regexp_extract("line", SCRIPT, 1)).withColumn("name", F.concat(F.regexp_extract("line", SCRIPT, 2), F.regexp_extract("line", SCRIPT, 3))).where("name <> ''")
    return named.select("file_path", "line_no", F.when(F.col("kw") == "", "function").otherwise(F.col("kw")).alias("kind"), "name", (F.contains("line", F.lit("export")) & ~F.startswith("name", F.lit("_"))).alias("is_public"))


def csharp_types(files: DataFrame) -> DataFrame:
    """(file_path, line_no, access, kind, name, bases) of the type declarations."""
    found = lines(files).withColumn("name", F.regexp_extract("line", CSHARP_TYPE, 3)).where("name <> ''")
    bases = F.transform(F.filter(F.split(F.regexp_replace(F.regexp_extract("line", CSHARP_TYPE, 4), r"<[^>]*>|\bwhere\b.*", ""), ","), lambda b: F.trim(b) != ""), lambda b: F.trim(b))
    return found.select("file_path", "line_no", F.regexp_extract("line", CSHARP_TYPE, 1).alias("access"), F.regexp_extract("line", CSHARP_TYPE, 2).alias("kind"), "name", bases.alias("bases"))


def inheritance_edges(types: DataFrame) -> DataFrame:
    """implements and inherits edges to types that are declared in source."""
    declared = types.select(F.col("name").alias("base"), F.col("kind").alias("base_kind")).distinct()
    each = types.select("name", F.explode("bases").alias("base")).join(declared, "base")
    return each.select(F.col("name").alias("from"), F.col("base").alias("to"), F.when(F.col("base_kind") == "interface", "implements").otherwise("inherits").alias("type")).distinct()


def routes(files: DataFrame) -> DataFrame:
    """Routes of MapX("...") calls and of verb attributes, with a leading and no trailing slash."""
    call = r"(?i)(?:\.Map|\[Http)(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]*)\""
    prefix = F.nullif(F.regexp_extract("line", r"\[Route\s*\(\s*\"([^\"]*)\"", 1), F.lit(""))
    held = lines(files).withColumn("prefix", F.last(prefix, ignorenulls=True).over(Window.partitionBy("file_path").orderBy("line_no")))
    found = held.select("file_path", "line_no", "prefix", F.col("line").rlike(r"(?i)\[Http").alias("attribute"), F.upper(F.regexp_extract("line", call, 1)).alias("verb"), F.regexp_extract("line", call, 2).alias("raw")).where("verb <> ''")
    # an attribute's route stands under the nearest class-level prefix at or above it
    joined = F.when(F.col("attribute") & F.col("prefix").isNotNull() & ~F.startswith("raw", F.lit("/")), F.concat(F.regexp_replace("prefix", "/+$", ""), F.lit("/"), F.col("raw"))).otherwise(F.col("raw"))
    found = found.withColumn("raw", joined)
    slashed = F.when(F.startswith("raw", F.lit("/")), F.col("raw")).otherwise(F.concat(F.lit("/"), F.col("raw")))
    return found.select("file_path", "line_no", "verb", F.when(F.length(slashed) > 1, F.regexp_replace(slashed, "/+$", "")).otherwise(slashed).alias("pattern"))


def registrations(files: DataFrame) -> DataFrame:
    """Service registrations (service, implementation, lifetime, seq); a single type registers itself."""
    call = r"Add(Singleton|Scoped|Transient)\s*<\s*([\w.]+)\s*(?:,\s*([\w.]+)\s*)?>"
    found = lines(files).select("file_path", "line_no", F.lower(F.regexp_extract("line", call, 1)).alias("lifetime"), F.regexp_extract("line", call, 2).alias("service"), F.regexp_extract("line", call, 3).alias("impl")).where("service <> ''")
    return found.select("file_path", "line_no", "service", F.when(F.col("impl") == "", F.col("service")).otherwise(F.col("impl")).alias("implementation"), "lifetime")


def decorators(files: DataFrame) -> DataFrame:
    """di_decorates edges from a decorator to the service that it is registered around."""
    call = r"\.Decorate\s*<\s*([\w.]+)\s*,\s*([\w.]+)\s*>"
    found = lines(files).select(F.regexp_extract("line", call, 2).alias("from"), F.regexp_extract("line", call, 1).alias("to")).where("`to` <> ''")
    return found.select("from", "to", F.lit("di_decorates").alias("type"), F.lit(0.95).alias("weight")).distinct()


def constructor_parameters(symbols: DataFrame) -> DataFrame:
    """(consumer, service): types of the parameters of constructors, from ``code.csharp_symbols``; options wrappers are left out."""
    inner = F.regexp_extract("body", r"\(([^()]*)\)", 1)
    bare = F.transform(F.split(F.regexp_replace(inner, r"<[^<>]*>", ""), ","), lambda p: F.regexp_extract(F.trim(p), r"([\w.]+)\s+\w+\s*(?:=.*)?$", 1))
    found = symbols.where("kind = 'constructor'").select(F.col("containing_type").alias("consumer"), F.explode(bare).alias("service"))
    return found.where("service <> '' AND service NOT IN ('IOptions', 'IOptionsSnapshot', 'IOptionsMonitor')").distinct()


def route_edges(routes: DataFrame, types: DataFrame) -> DataFrame:
    """route_handles edges from each route to the type declared nearest at or above it in its file."""
    at = routes.join(types.select("file_path", F.col("line_no").alias("type_line"), "name"), "file_path").where("type_line <= line_no")
    best = at.groupBy("file_path", "line_no", "verb", "pattern").agg(F.max_by("name", "type_line").alias("name"))
    return best.select(F.concat(F.lit("route:"), "verb", F.lit(" "), "pattern").alias("from"), F.col("name").alias("to"), F.lit("route_handles").alias("type"), F.lit(1.0).alias("weight")).distinct()


def injected_implementations(parameters: DataFrame, resolves: DataFrame) -> DataFrame:
    """di_depends_on_impl: consumers to the implementation last registered for a parameter's service, not to themselves.

    ``parameters``: consumer, service; ``resolves``: service, implementation, seq.
    """
    last = resolves.groupBy("service").agg(F.max_by("implementation", "seq").alias("implementation"))
    return parameters.join(last, "service").where("implementation <> consumer").select(F.col("consumer").alias("from"), F.col("implementation").alias("to"), F.lit("di_depends_on_impl").alias("type")).distinct()


def test_edges(uses: DataFrame, resolves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tests edges from test types to the types they use and to all implementations of those, only to known nodes."""
    direct = uses.select(F.col("test").alias("from"), F.col("used").alias("to"))
    through = uses.join(resolves, uses["used"] == resolves["service"]).select(F.col("test").alias("from"), F.col("implementation").alias("to"))
    return direct.unionByName(through).join(nodes.select(F.col("node").alias("to")), "to", "left_semi").distinct().withColumn("type", F.lit("tests"))


WIRING = [
    ("mediatr_handles", r"IRequestHandler\s*<\s*([\w.]+)", "1", "", 0.95),
    ("sends_request", r"\.(?:Send|Publish)\s*\(\s*new\s+([\w.]+)", "", "1", 0.70),
    ("options_binds", r"Configure\s*<\s*[\w.]+\s*>\s*\([^\"]*GetSection\s*\(\s*\"([^\"]+)", "config:1", "type", 0.85),
    ("options_consumes", r"IOptions(?:Snapshot|Monitor)?\s*<\s*([\w.]+)", "", "1", 0.75),
    ("hosted_service", r"AddHostedService\s*<\s*([\w.]+)", "service:hosted", "1", 0.90),
    ("pipeline_behavior", r":\s*.*IPipelineBehavior\s*<\s*([\w.]+)", "service:pipeline", "", 0.90),
    ("ef_entity", r"DbSet\s*<\s*([\w.]+)", "", "1", 0.90),
    ("ef_configures", r"IEntityTypeConfiguration\s*<\s*([\w.]+)", "1", "", 0.90),
    ("grpc_endpoint", r"MapGrpcService\s*<\s*([\w.]+)", "service:grpc", "1", 0.95),
    ("signalr_endpoint", r"MapHub\s*<\s*([\w.]+)", "service:signalr", "1", 0.95),
]
#: What every match of a wiring pattern, and of CSHARP_TYPE, has in it.
ANCHORS = {
    "mediatr_handles": "IRequestHandler", "sends_request": "new", "options_binds": "GetSection", "options_consumes": "IOptions", "hosted_service": "AddHostedService",
    "pipeline_behavior": "IPipelineBehavior", "ef_entity": "DbSet", "ef_configures": "IEntityTypeConfiguration", "grpc_endpoint": "MapGrpcService", "signalr_endpoint": "MapHub",
}
TYPE_WORDS = ("class", "interface", "record", "struct", "enum")


def wiring_edges(files: DataFrame) -> DataFrame:
    """Typed edges (from, to, type, weight, file_path, line_no) that the wiring patterns find.

    The enclosing type of a line is the nearest declaration at or above it in its file.
    """
    has = lambda words: reduce(Column.__or__, [F.contains("line", F.lit(w)) for w in words])
    # a pattern is tried on lines that have its fixed word, and lines without any are left out before the window
    name = F.when(has(TYPE_WORDS), F.nullif(F.regexp_extract("line", CSHARP_TYPE, 3), F.lit("")))
    some = lines(files).where(has([*TYPE_WORDS, *ANCHORS.values()]))
    inside = some.withColumn("inside", F.last(name, ignorenulls=True).over(Window.partitionBy("file_path").orderBy("line_no")))
    hits = []
    for kind, pattern, start, end, weight in WIRING:
        group = F.regexp_extract("line", pattern, 1)
        asked = F.regexp_extract("line", r"Configure\s*<\s*([\w.]+)", 1)

        def node(side: str, group=group, asked=asked):
            return {"": F.col("inside"), "1": group, "type": asked, "config:1": F.concat(F.lit("config:"), group)}.get(side, F.lit(side))

        hits.append(F.when(has([ANCHORS[kind]]) & (group != ""), F.struct(node(start).alias("from"), node(end).alias("to"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))))
    each = inside.select("file_path", "line_no", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("e"))
    return each.select("e.from", "e.to", "e.type", "e.weight", "file_path", "line_no").where("`from` IS NOT NULL AND `to` IS NOT NULL").distinct()


def reference_uses(files: DataFrame, types: DataFrame, weight: float = 0.15) -> DataFrame:
    """references edges from the types of a file to other declared types that its text names, each once."""
    names = files.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("to"))
    used = names.join(types.select(F.col("name").alias("to")).distinct(), "to", "left_semi")
    return used.join(types.select("file_path", F.col("name").alias("from")), "file_path").where("`from` <> `to`").select("from", "to", F.lit("references").alias("type"), F.lit(weight).alias("weight")).distinct()
