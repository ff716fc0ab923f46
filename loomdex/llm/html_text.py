"""Main-text extraction by template deduction from equivalence classes of page tokens.

Pages of one host come from templates. A token is an element, told apart by its path, or a
text under a path. Tokens with the same occurrence vector (uses in each page of the host)
form a class; a class of several tokens that most pages share is valid. The valid classes
nest by their paths: a token belongs to the template if it and all elements around it are in
valid classes. What a page holds beyond the template's own texts stands in slots, named by
the deepest template element around it. The slots that hold the article are named by the
classes too: of the template elements that stand once on a page, the deepest one that most
of the pages' text is in. Pages of hosts with few pages are pooled over hosts by their layout.
Elements and class names veto what is never main text, such as menus and comments, and decide
what the classes leave open: within the container, and where there is no template.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, stage

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-z][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements without content or end, elements inside a line, elements that are never main text. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form head button menu dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|breadcrumbs?|comments?|commentlist|disqus|replies|consent|cookies?|cookiebar|footer|gdpr|login|menu|menubar|modal|nav|navbar|navigation|"
    r"newsletter|notices?|pager|pagination|popup|sidebar|signup|site-header|page-header|masthead|sponsor|sponsored|subscribe|toolbar)(?:$|[\s_-])",
    re.I,
)
#: Names that an article's own elements may have too: asides outside it, and inside it where the host's template has them.
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|promos?|promotion|related|share|sharing|skip|social|widget)(?:$|[\s_-])", re.I)
#: Elements that the start of another one of the second kind ends.
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: A class of texts belongs to the template if it has so many tokens, and any class only with so large a part of the host's pages.
LEAST_TOKENS, LEAST_SHARE, LEAST_PAGES = 2, 0.5, 4
#: Template texts that are more than this part of an article are its own: the host's pages are copies of it.
COPIED_SHARE = 0.5
#: An article with less than this part of the text of a main element around or beside it is a teaser.
TEASER_SHARE = 0.25
#: The container of the article is the deepest template element that has so large a part of the pages' text.
CONTAINER_SHARE = 0.6
#: Levels of elements that tell the layout of a page.
LAYOUT_DEPTH = 3
#: Template tokens that are broadcast at most, and the keys that a group's pages are dealt out over where there are more.
BROADCAST_TOKENS, SALTS = 500_000, 16
#: Elements that are told apart by their place among their like where they have no name. Fixed values.
GENERIC = frozenset("div section".split())


class Block(NamedTuple):
    path: str
    text: str
    #: Within an element that is never main text.
    aside: bool
    #: Within an article: 2, within a main element: 1.
    main: int
    #: Path of the outermost element around it that has a doubtful name.
    named: str


def parse(page: str | None) -> tuple[dict[str, int], list[Block]]:
    """Uses of each element, by path, and the text blocks in page order.

    A path has the elements' names, and the places of generic ones without a name among their like.
    """
    elements: dict[str, int] = {}
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int, str, dict[str, int]]] = []  # tag, path, aside, main, named, places of its elements
    top: dict[str, int] = {}
    parts: list[str] = []

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, aside, main, named, _ = stack[-1] if stack else ("", "", False, 0, "", top)
            out.append(Block(path, text, aside, main, named))

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    at, source = 0, page or ""
    for m in _PIECE.finditer(source):
        parts.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue  # inside a line: parts no words and has no path
        end_block()
        if m["close"] or m["close2"]:
            close(tag)
            continue
        if tag in VOID:
            continue
        while stack and ((stack[-1][0] == "p" and tag in BLOCK_ENDS_P) or tag in CLOSED_BY.get(stack[-1][0], "").split()):
            stack.pop()
        _, path, aside, main, named, places = stack[-1] if stack else ("", "", False, 0, "", top)
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m["attributes"] or m["attributes2"] or "")}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip().replace("/", "|")
        role = attributes.get("role", "").lower()
        aside = (
            aside
            or tag in ASIDE
            or (tag in ("header", "label") and not main)
            or role in ASIDE_ROLES
            or (bool(names) and (tag not in ("html", "body", "article", "main") or "comment" in names.lower()) and bool(ASIDE_NAMES.search(names)))
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        main = 2 if tag == "article" else max(main, 1) if tag == "main" or role == "main" else main
        own = f"{tag}.{names}" if names else tag
        if own in GENERIC:
            places[own] = places.get(own, 0) + 1
            own = f"{own}[{places[own]}]"
        path = f"{path}/{own}"
        if not named and names and tag not in ("html", "body", "article", "main") and DOUBTFUL_NAMES.search(names):
            named = path
        elements[path] = elements.get(path, 0) + 1
        stack.append((tag, path, aside, main, named, {}))
    parts.append(source[at:])
    end_block()
    return elements, out


class Tokens(NamedTuple):
    #: Of the elements: uses, depth, and characters of the texts within that are no asides.
    elements: dict[int, tuple[int, int, int]]
    #: Uses of the texts.
    texts: dict[int, int]
    #: What pages of the same layout share.
    layout: int


def page_tokens(page: str | None) -> Tokens:
    elements, blocks = parse(page)
    texts: dict[int, int] = {}
    chars: dict[str, int] = {}
    for b in blocks:
        key = token_hash(f"{b.path}\n{b.text}")
        texts[key] = texts.get(key, 0) + 1
        path = "" if b.aside else b.path
        while path:
            chars[path] = chars.get(path, 0) + len(b.text)
            path = path.rpartition("/")[0]
    layout = token_hash("\n".join(sorted(p for p in elements if p.count("/") <= LAYOUT_DEPTH)))
    return Tokens({token_hash(p): (n, p.count("/"), chars.get(p, 0)) for p, n in elements.items()}, texts, layout)


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


class Template:
    """The valid tokens of a host, nested: a token counts if all elements around it do."""

    def __init__(self, tokens: set[int]):
        self.tokens = tokens
        self.nested: dict[str, bool] = {"": True}

    def holds(self, path: str) -> bool:
        if path not in self.nested:
            self.nested[path] = token_hash(path) in self.tokens and self.holds(path.rpartition("/")[0])
        return self.nested[path]

    def holds_text(self, block: Block) -> bool:
        return self.holds(block.path) and token_hash(f"{block.path}\n{block.text}") in self.tokens

    def slot(self, path: str) -> str:
        """The deepest template element around a path."""
        while not self.holds(path):
            path = path.rpartition("/")[0]
        return path


def within(block: Block, container: str) -> bool:
    return block.path == container or block.path.startswith(f"{container}/")


def main_text(page: str | None, tokens: set[int], container: int | None = None) -> str:
    """Texts of the slots in the template's container; without one of the article, of the main element, or of the page.

    A container that is part of an article is all of it, and headings beside a container belong to it. An
    article outside the container counts if it has at least TEASER_SHARE of its text.
    """
    elements, blocks = parse(page)
    template = Template(tokens)
    able = [(i, b) for i, b in enumerate(blocks) if not (b.aside or (b.named and (not b.main or not tokens or template.holds(b.named))))]
    at = next((p for p, n in elements.items() if n == 1 and token_hash(p) == container), None) if container is not None else None
    if at is not None:
        parts = at.split("/")
        whole = next(("/".join(parts[: i + 1]) for i, x in enumerate(parts) if x == "article" or x.startswith("article.")), at)
        outer = at.rpartition("/")[0]
        heads = {i for i, b in able if re.fullmatch(r"h[1-6](?:\..*)?", b.path.removeprefix(f"{outer}/"))}
        inside = [(i, b) for i, b in able if i in heads or within(b, whole)]
        chars = lambda found: sum(len(b.text) for _, b in found)
        articles = [(i, b) for i, b in able if b.main == 2]
        beside = articles and not any(b.main == 2 for _, b in inside) and chars(articles) >= TEASER_SHARE * chars(inside)
        if inside and not beside:
            able = inside
    return own_texts(able, template)


def own_texts(found: list[tuple[int, Block]], template: Template) -> str:
    """Of some blocks those of the article, or of the main element, or all, without the template's own."""
    slots: dict[tuple[str, int], list[tuple[int, Block, bool]]] = {}
    for number, b in found:
        slots.setdefault((template.slot(b.path), b.main), []).append((number, b, template.holds_text(b)))
    # characters of the slots' own texts by level: article, main element, page
    own = [sum(len(b.text) for (_, main), x in slots.items() for _, b, fixed in x if main >= level and not fixed) for level in range(3)]
    level = max((main for _, main in slots), default=0)
    if level == 2 and any(main == 1 for _, main in slots) and own[2] < TEASER_SHARE * own[1]:
        level = 1
    kept = sorted((x for (_, main), part in slots.items() if main >= level for x in part), key=lambda x: x[0])
    total = sum(len(b.text) for _, b, _ in kept)
    if level and own[level] < (1 - COPIED_SHARE) * total:
        return " ".join(b.text for _, b, _ in kept)
    return " ".join(b.text for _, b, fixed in kept if not fixed)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(kind, group, token, container) of the template of each group: a host, or the layout of hosts of fewer than LEAST_PAGES pages; ``pages`` has (host long, page long, html).

    Occurrence vectors are compared by two sums of hashes of (page, uses), which add up over hosts, so they are summed up in
    the input tasks and no task ever holds a group's pages. A group has at most one token that is its container.
    """

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(8)]
            for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = page_tokens(text.as_py())
                rows = [(t, n, False, depth, chars) for t, (n, depth, chars) in found.elements.items()] + [(t, n, True, 0, 0) for t, n in found.texts.items()]
                for token, n, is_text, depth, chars in rows:
                    for column, value in zip(columns, (host, found.layout, page, token, n, is_text, depth, chars), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "layout", "page", "token", "uses", "is_text", "depth", "chars"])

    occurrences = pages.select("host", "page", "html").mapInArrow(run, "host long, layout long, page long, token long, uses long, is_text boolean, depth int, chars long")
    part = lambda seed: F.sum(F.pmod(F.xxhash64("page", "uses", F.lit(seed)), F.lit(1 << 31)))
    by_host = occurrences.groupBy("host", "layout", "token", "is_text").agg(F.count(F.lit(1)).alias("pages"), part(1).alias("v1"), part(2).alias("v2"), F.sum("uses").alias("uses"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"))
    sums = [F.sum(c).alias(c) for c in ("pages", "v1", "v2", "uses", "chars")]
    grouped = stage(by_host.join(small_hosts(pages), "host", "left").withColumns(group_of(F.col("host"), F.col("layout"), F.col("small"))).groupBy("kind", "group", "token", "is_text").agg(*sums, F.max("depth").alias("depth")), "html-tokens")
    group = ["kind", "group"]
    # the outermost element stands on every page that has one
    all_pages = grouped.where("depth = 1").groupBy(*group).agg(F.max("pages").alias("all_pages"))
    # only tokens that many pages share can be in a valid class: a page has few of them, so a group has few
    shared = stage(grouped.where(F.col("pages") >= LEAST_PAGES), "html-vectors")
    classes = shared.groupBy(*group, "pages", "v1", "v2").agg(F.count(F.lit(1)).alias("tokens"))
    common = classes.join(all_pages, group).where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    # an element that repeats within its parent is a class alone: it nests in its parent's
    valid = shared.join(common.select(*group, "pages", "v1", "v2", "tokens"), [*group, "pages", "v1", "v2"]).where(~F.col("is_text") | (F.col("tokens") >= LEAST_TOKENS))
    single = valid.where(~F.col("is_text") & (F.col("uses") == F.col("pages")))
    most = single.groupBy(*group).agg(F.max("chars").alias("most"))
    holds = single.join(most, group).where((F.col("chars") > 0) & (F.col("chars") >= CONTAINER_SHARE * F.col("most")))
    containers = holds.groupBy(*group).agg(F.max_by("token", F.struct("depth", "token")).alias("at"))
    named = valid.select(*group, "token").join(containers, group, "left")
    return stage(named.select(*group, "token", (F.col("token") == F.col("at")).alias("container")), "html-templates")


def small_hosts(pages: DataFrame) -> DataFrame:
    """(host, small) of the hosts with too few pages for a template of their own."""
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < LEAST_PAGES).select("host", F.lit(True).alias("small"))


def group_of(host: Column, layout: Column, small: Column) -> dict[str, Column]:
    return {"kind": F.when(small, "layout").otherwise("host"), "group": F.when(small, layout).otherwise(host)}


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of ``pages``.

    Text is '' for null or empty html and where nothing is left. A null url, or one without a host,
    belongs to the host of the empty name. A page takes its host's template, or that of its layout where the host has none. Ids have any type. Repeated rows count as pages and are extracted one by
    one; an empty table gives no rows; other columns are ignored.
    """
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host)
    templates = deduce_templates(named.select("host", F.xxhash64("id", "url").alias("page"), "html"))
    small = templates.count() <= BROADCAST_TOKENS

    def laid_out(batches):
        for batch in batches:
            found = [page_tokens(h.as_py()).layout for h in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["id", "url", "host", "html", "layout"])

    rows = named.select("id", "url", "host", "html").mapInArrow(laid_out, f"id {kind_of(named, 'id')}, url string, host long, html string, layout long")
    by_group = templates.groupBy("kind", "group").agg(F.collect_set("token").alias("template"), F.max(F.when(F.col("container"), F.col("token"))).alias("at"))  # at most twice a page's tokens per group
    for kind, key in (("host", "host"), ("layout", "layout")):
        of_kind = by_group.where(F.col("kind") == kind).select(F.col("group").alias(key), F.struct("template", "at").alias(f"by_{kind}"))
        if small:
            rows = rows.join(F.broadcast(of_kind), key, "left")
        else:
            # copied to some keys, which the pages of a group are dealt out over
            copies = of_kind.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"], "left").drop("salt")
    joined = rows.withColumn("of", F.coalesce("by_host", "by_layout")).select("id", "url", "html", "of.template", "of.at")

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), set(t or ()), at) for h, t, at in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    found = joined.mapInArrow(run, f"id {kind_of(named, 'id')}, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op9_main_text(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
