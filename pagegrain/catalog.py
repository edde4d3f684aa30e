"""The registered queries over the given tables, and the SQL that recomputes each of them.

Inputs that the tables lack (statuses, headers, cookies, redirects, forms) are derived from every row of
a table by one expression that Spark and the checking engine both run, so they grow with the tables. Markup
that the pages lack is written into each page's own html, so the whole page takes part.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions import charsets, urls
from pagegrain.functions.vector import vectorised
from pagegrain.operators import comparison, disclosure, documents, markup, navigation, outlines, responses, styles, views
from pagegrain.plans import flows
from pagegrain.sources import pages as sources_pages
from pagegrain.sources.pages import decode_responses, spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "pages"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "events"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return documents.parse_pages(_pages(spark, d))


def _spliced(spark: SparkSession, d: str, made: str, behind: str = "<body>") -> DataFrame:
    """Pages with more markup in their html, right behind a tag."""
    return _pages(spark, d).withColumn("html", F.expr(f"replace(html, '{behind}', '{behind}' || ({made}))"))


# -- expressions that both engines run

HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
STATUS = "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 301 WHEN 3 THEN NULL ELSE 200 END"
TYPE = "CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Image/PNG' WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'application/pdf;x=1' ELSE 'nonsense' END"
RETRY = "CASE WHEN page_id % 11 = 4 THEN '120' END"
MITIGATED = "CASE page_id % 13 WHEN 5 THEN 'Challenge' WHEN 6 THEN 'block' END"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Pages with derived status and headers."""
    pages = _pages(spark, d).withColumn("status", F.expr(STATUS).cast("int"))
    header = lambda name, value: F.when(F.expr(value).isNotNull(), F.struct(F.lit(name).alias("name"), F.expr(value).alias("value")))
    return pages.withColumn("headers", F.array_compact(F.array(header("Content-Type", TYPE), header("Retry-After", RETRY), header("CF-Mitigated", MITIGATED), header("Server", "'srv' || CAST(page_id % 3 AS STRING)"))))


_DECLARED = f"CASE WHEN {RETRY} IS NOT NULL AND ({STATUS} IS NULL OR {STATUS} < 400) THEN 'retry-after' WHEN lower({MITIGATED}) = 'challenge' THEN 'cf-mitigated' END"
_MEDIA = "CASE page_id % 5 WHEN 1 THEN 'image/png' WHEN 3 THEN 'application/pdf' END"
_CLASSIFIED = f"""
c AS (SELECT page_id, url, html, {STATUS} AS http_status, {_DECLARED} AS declared, {_MEDIA} AS media FROM pages),
v AS (SELECT *, CASE WHEN declared IS NOT NULL THEN NULL WHEN http_status >= 400 THEN 'http.' || http_status WHEN media IS NOT NULL THEN 'parse' END AS error_kind FROM c)"""

_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _plain(col: str) -> str:
    return f"trim(regexp_replace({_UNESCAPE.format(col)}, '\\s+', ' ', 'g'))"


_ANCHORS = r"SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')) AS a, unnest(range(len(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')))) AS pos FROM pages"
_BODY_TEXT = (
    "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(10), ' '), '(?s)^.*?</head>', ''), '(?s)<!--.*?-->', '', 'g'), '</?(?:body|nav|ul|li|div|article|h1|p|br|footer|html)(?: [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), "
    f"lambda x: {_plain('x')}), lambda x: x <> ''), chr(10))"
)


# -- documents and views


@_add("links_by_host", rf"""
WITH a AS ({_ANCHORS}), h AS (SELECT {HOST} AS host, regexp_extract(url, '^[a-z]+:', 0) || '//' || {HOST} || regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM a)
SELECT host, 'a' AS kind, count(*)::BIGINT AS n_links, count(DISTINCT href)::BIGINT AS n_hrefs FROM h GROUP BY host""")
def links_by_host(spark: SparkSession, d: str) -> DataFrame:
    return flows.links_by_host(_pages(spark, d))


@_add("links", rf"""
SELECT page_id, pos::INTEGER AS pos, 'a' AS kind, {_plain("regexp_extract(a, '>([^<]*)<', 1)")} AS text, 0 AS n_rel FROM ({_ANCHORS})""")
def links(spark: SparkSession, d: str) -> DataFrame:
    return views.links(_nodes(spark, d), "page_id").select("page_id", "pos", "kind", "text", F.size("rel").alias("n_rel"))


@_add("page_meta", rf"""
SELECT page_id, {_plain("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, 'utf-8' AS charset, NULL::VARCHAR AS canonical FROM pages""")
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    out = views.page_meta(_nodes(spark, d), "page_id")
    return out.withColumn("title", F.regexp_replace("title", r"\s+", " "))


@_add("element_counts", "\nUNION ALL\n".join(f"SELECT page_id, '{t}' AS name, len(regexp_extract_all(html, '<{t}(?: [^>]*)?>'))::BIGINT AS n FROM pages WHERE html LIKE '%<{t}%'" for t in ("a", "li", "h1", "p", "br", "nav", "article", "footer", "title")))
def element_counts(spark: SparkSession, d: str) -> DataFrame:
    kept = ("a", "li", "h1", "p", "br", "nav", "article", "footer", "title")
    return documents.explode_nodes(_nodes(spark, d), "page_id").filter(F.col("name").isin(*kept) & (F.col("kind") == "element")).groupBy("page_id", "name").agg(F.count("*").alias("n"))


@_add("elements_by_tag", rf"SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: {_plain("regexp_replace(x, '<[^>]*>', '', 'g')")})) AS text FROM pages")
def elements_by_tag(spark: SparkSession, d: str) -> DataFrame:
    items = F.transform(documents.elements_of(F.col("nodes"), "li"), lambda n: documents.text_content(F.col("nodes"), n))
    return _nodes(spark, d).select("page_id", F.explode(items).alias("text"))


@_add("text_view", f"SELECT page_id, {_BODY_TEXT} AS text FROM pages")
def text_view(spark: SparkSession, d: str) -> DataFrame:
    return views.text_view(_pages(spark, d)).select("page_id", "text")


@_add("dom_stats")
def dom_stats(spark: SparkSession, d: str) -> DataFrame:
    return documents.dom_stats(markup.derive(_pages(spark, d), ["nodes", "dom"]), "dom", "page_id")


@_add("payload_digest", f"SELECT page_id, octet_length(encode({_BODY_TEXT}))::BIGINT AS bytes, sha256({_BODY_TEXT}) AS sha FROM pages")
def payload_digest(spark: SparkSession, d: str) -> DataFrame:
    return documents.dom_stats(markup.derive(_pages(spark, d), ["nodes", "text"]), "text", "page_id").select("page_id", "bytes", "sha")


@_add("dom_view")
def dom_view(spark: SparkSession, d: str) -> DataFrame:
    return markup.derive(_pages(spark, d), ["dom"]).select("page_id", "dom")


@_add("select", r"SELECT page_id, 'a' AS name, a AS outer_html, regexp_extract(a, '>([^<]*)<', 1) AS inner_html FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')) AS a FROM pages)")
def select(spark: SparkSession, d: str) -> DataFrame:
    return markup.select(_nodes(spark, d), "nav li > a[href]", "page_id").drop("id")


@_add("select_scoped", r"SELECT page_id, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY page_id")
def select_scoped(spark: SparkSession, d: str) -> DataFrame:
    return markup.select(_nodes(spark, d), "li", "page_id", scope="nav").groupBy("page_id").agg(F.count("*").alias("n"))


#: A page's html without its unclosed bold elements, which the parser opens again in every later paragraph; its script's quoted tag is as long in SQL.
_UNBOLD = "regexp_replace(html, '</?b>', '', 'g')"
_TEXTS = _UNESCAPE.format(rf"""regexp_replace(regexp_replace(replace({_UNBOLD}, '"</p>"', '"[/p]"'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')""")


def _unbold(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).withColumn("html", F.regexp_replace("html", "</?b>", ""))


@_add("page_stats", rf"""
SELECT page_id, len(regexp_extract_all({_UNBOLD}, '<[a-z][a-z0-9]*'))::BIGINT AS elements, strlen({_TEXTS})::BIGINT AS text_chars, strlen({_UNBOLD})::BIGINT AS bytes, sha256({_UNBOLD}) AS sha FROM pages""")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return documents.dom_stats(markup.derive(_unbold(spark, d), ["nodes"]), "html", "page_id")


@_add("dom_sequence", rf"""
SELECT page_id, array_to_string(regexp_extract_all({_UNBOLD}, '<([a-z][a-z0-9]*)', 1), ' ') AS names, replace(replace(replace({_TEXTS}, '[/p]', '</p>'), '"', '\"'), chr(10), '\n') AS texts, len(regexp_extract_all(html, '<!--')) AS comments FROM pages""")
def dom_sequence(spark: SparkSession, d: str) -> DataFrame:
    """What the nested JSON of a page says, read back: its elements' names and its texts in order, and its comments."""
    dom = F.col("dom")
    return markup.derive(_unbold(spark, d), ["dom"]).select(
        "page_id", F.array_join(F.regexp_extract_all(dom, F.lit(r'"type":"element","name":"([^"]*)"'), F.lit(1)), " ").alias("names"),
        F.array_join(F.regexp_extract_all(dom, F.lit(r'"type":"text","value":"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1)), "").alias("texts"), F.size(F.regexp_extract_all(dom, F.lit('"type":"comment"'), F.lit(0))).cast("long").alias("comments"),
    )


@_add("read_pages", "SELECT page_id, url, length(html)::INTEGER AS n_chars, NULL::INTEGER AS status, 0 AS n_headers FROM pages")
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    return sources_pages.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"), "status", F.size("headers").alias("n_headers"))


_SCRIPT = "CASE page_id % 5 WHEN 0 THEN '<script src=\"/s' || CAST(page_id AS VARCHAR(9)) || '.js\"></script>' WHEN 1 THEN '<script type=module>' || url || '</script>' WHEN 2 THEN '<script nomodule>' || url || '</script>' WHEN 3 THEN '<script type=\"text/template\">' || url || '</script>' ELSE '<script type=\" Text/JavaScript \" src=x.js></script>' END"


@_add("script_kinds", rf"""
WITH s AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS origin, regexp_replace(url, '[^/]*$', '') AS folder FROM pages)
SELECT page_id, 0 AS pos, 'inline' AS kind, false AS module, NULL::VARCHAR AS src, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS body FROM s
UNION ALL SELECT page_id, 1, CASE page_id % 5 WHEN 0 THEN 'external' WHEN 1 THEN 'inline' WHEN 4 THEN 'external' ELSE 'skip' END, CASE page_id % 5 WHEN 1 THEN true WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE false END,
  CASE page_id % 5 WHEN 0 THEN origin || '/s' || page_id || '.js' WHEN 4 THEN folder || 'x.js' END, CASE WHEN page_id % 5 = 1 THEN url END FROM s""")
def script_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each page's own script, and one behind it that is external, a module, or skipped."""
    return documents.page_scripts(documents.parse_pages(_spliced(spark, d, _SCRIPT)), "page_id")


@_add("page_scripts", r"SELECT page_id, 0 AS pos, 'inline' AS kind, false AS module, NULL::VARCHAR AS src, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS body FROM pages")
def page_scripts(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_scripts(_nodes(spark, d), "page_id")


@_add("headings", rf"SELECT page_id, 1 AS level, {_plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS name FROM pages")
def headings(spark: SparkSession, d: str) -> DataFrame:
    return views.headings(_nodes(spark, d), "page_id").select("page_id", "level", "name")


@_add("ax_links", rf"SELECT page_id, count(*)::BIGINT AS n_links, count(DISTINCT {_plain("regexp_extract(a, '>([^<]*)<', 1)")})::BIGINT AS n_names FROM ({_ANCHORS}) GROUP BY page_id")
def ax_links(spark: SparkSession, d: str) -> DataFrame:
    return views.roles(_nodes(spark, d), "page_id").filter("role = 'link'").groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("name").alias("n_names"))


_FORM = (
    "'<base href=\"http://b.example/d/\"><form action=\"' || CAST(page_id % 3 AS STRING) || '\" method=POST><input name=q type=text value=v' || CAST(page_id AS STRING) || ' required>"
    "<textarea name=t>T' || CAST(page_id AS STRING) || '</textarea><select name=s><option value=1>one<option> two </select></form><form></form>'"
)


@_add("forms", """
SELECT page_id, 0 AS pos, 'http://b.example/d/' || (page_id % 3) AS action, 'post' AS method, 'application/x-www-form-urlencoded' AS enctype, 3 AS n_fields FROM pages
UNION ALL SELECT page_id, 1, 'http://b.example/d/', 'get', 'application/x-www-form-urlencoded', 0 FROM pages""")
def forms(spark: SparkSession, d: str) -> DataFrame:
    return views.forms(documents.parse_pages(_spliced(spark, d, _FORM)), "page_id").select("page_id", "pos", "action", "method", "enctype", F.size("fields").alias("n_fields"))


@_add("form_fields", """
SELECT page_id, 0 AS pos, 0 AS field, 'input' AS tag, 'q' AS name, 'text' AS type, 'v' || page_id AS value, true AS required FROM pages
UNION ALL SELECT page_id, 0, 1, 'textarea', 't', NULL, 'T' || page_id, false FROM pages UNION ALL SELECT page_id, 0, 2, 'select', 's', NULL, NULL, false FROM pages""")
def form_fields(spark: SparkSession, d: str) -> DataFrame:
    made = views.forms(documents.parse_pages(_spliced(spark, d, _FORM)), "page_id")
    return views.form_fields(made, "page_id").drop("options")


@_add("select_options", "SELECT page_id, 0 AS pos, 2 AS field, 0 AS option, '1' AS value, 'one' AS label FROM pages UNION ALL SELECT page_id, 0, 2, 1, 'two', 'two' FROM pages")
def select_options(spark: SparkSession, d: str) -> DataFrame:
    made = views.forms(documents.parse_pages(_spliced(spark, d, _FORM)), "page_id")
    return views.select_options(views.form_fields(made, "page_id"), "page_id")


_METAS = "'<meta name=a content=' || CAST(page_id AS STRING) || '><meta property=p content=x><meta name=none><meta http-equiv=\"Content-Type\" content=\"text/html; charset=KOI8-R\"><link rel=\"x Canonical\" href=/c>'"


@_add("meta_entries", """
SELECT page_id, 0 AS pos, 'a' AS name, NULL AS property, NULL AS http_equiv, page_id::VARCHAR AS content FROM pages
UNION ALL SELECT page_id, 1, NULL, 'p', NULL, 'x' FROM pages UNION ALL SELECT page_id, 2, NULL, NULL, 'Content-Type', 'text/html; charset=KOI8-R' FROM pages""")
def meta_entries(spark: SparkSession, d: str) -> DataFrame:
    return views.meta_entries(documents.parse_pages(_spliced(spark, d, _METAS, "<head>")), "page_id")


@_add("meta_canonical", f"SELECT page_id, {_plain("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, 'koi8-r' AS charset, regexp_extract(url, '^[a-z]+://', 0) || {HOST} || '/c' AS canonical FROM pages")
def meta_canonical(spark: SparkSession, d: str) -> DataFrame:
    return views.page_meta(documents.parse_pages(_spliced(spark, d, _METAS, "<head>")), "page_id").withColumn("title", F.regexp_replace("title", r"\s+", " "))


_SHELL = "CASE page_id % 4 WHEN 1 THEN html ELSE regexp_replace(html, '(?s)<!-- ad .*$', CASE page_id % 4 WHEN 0 THEN '<div id=root></div>' WHEN 2 THEN '<img alt=x>' ELSE '<details><p>closed</details>' END) END"


@_add("needs", """
SELECT page_id, page_id % 4 = 1 AS has_text, page_id % 4 = 2 AS has_label, CASE WHEN page_id % 4 = 1 THEN 0 ELSE 1 END AS text_needs, CASE WHEN page_id % 4 IN (0, 3) THEN 1 ELSE 0 END AS links_needs, 0 AS dom_needs
FROM pages WHERE html LIKE '%<script>%<body><nav>%<!-- ad %'""")
def needs(spark: SparkSession, d: str) -> DataFrame:
    """Pages as they are, or cut behind their menu: with nothing, a label or a closed part in place of the rest."""
    rows = markup.derive(_pages(spark, d).withColumn("html", F.expr(_SHELL)), ["has_script", "has_body", "has_text", "has_label"])
    told = lambda v: F.size(views.needs(v, F.col("has_script"), F.col("has_body"), F.col("has_text"), F.col("has_label")))
    return rows.select("page_id", "has_text", "has_label", told("text").alias("text_needs"), told("links").alias("links_needs"), told("dom").alias("dom_needs"))


@_add("impressions", f"""
WITH {_CLASSIFIED}
SELECT page_id, CASE WHEN declared IS NOT NULL THEN 'needs' WHEN error_kind IS NOT NULL THEN 'error' ELSE 'ok' END AS status, error_kind, CASE WHEN declared IS NOT NULL THEN 'js' END AS need,
       CASE WHEN declared IS NULL AND error_kind IS NULL THEN {_BODY_TEXT} END AS out FROM v""")
def impressions(spark: SparkSession, d: str) -> DataFrame:
    made = flows.crawl_to_envelopes(_responses(spark, d), "text")
    return made.select("page_id", "status", "error_kind", F.get("needs", 0).alias("need"), F.get_json_object("envelope", "$.out").alias("out"))


@_add("impressions_links", f"""
WITH {_CLASSIFIED}
SELECT page_id, CASE WHEN declared IS NULL AND error_kind IS NULL THEN len(regexp_extract_all(html, '<a href="'))::INTEGER END AS n_links,
       coalesce(CASE WHEN declared IS NULL AND error_kind LIKE 'http%' THEN 'server returned HTTP ' || http_status WHEN error_kind = 'parse' THEN 'response media type ' || media || ' is not a document' END, '') AS message FROM v""")
def impressions_links(spark: SparkSession, d: str) -> DataFrame:
    made = flows.crawl_to_envelopes(_responses(spark, d), "links")
    return made.select("page_id", F.json_array_length(F.get_json_object("envelope", "$.out")).alias("n_links"), F.coalesce(F.get_json_object("envelope", "$.error.message"), F.lit("")).alias("message"))


_NAMED = lambda name, value: f"CASE WHEN {value} IS NOT NULL THEN '{{\"name\":\"{name}\",\"value\":' || to_json({value})::VARCHAR || '}}' END"


@_add("envelope_lines", f"""
WITH {_CLASSIFIED}
SELECT page_id, concat('{{"version":"1","url":{{"requested":', to_json(url)::VARCHAR, CASE WHEN error_kind IS NULL OR http_status IS NOT NULL THEN ',"final":' || to_json(url)::VARCHAR END, '}},"view":"text","status":',
  CASE WHEN declared IS NOT NULL THEN '"needs","needs":["js"]' WHEN error_kind IS NOT NULL THEN '"error","error":{{"kind":"' || error_kind || '","message":"' || CASE WHEN error_kind = 'parse' THEN 'response media type ' || media || ' is not a document' ELSE 'server returned HTTP ' || http_status END || '"}}'
  ELSE '"ok","out":' || to_json({_BODY_TEXT})::VARCHAR END,
  CASE WHEN http_status IS NOT NULL THEN ',"http":{{"status":' || http_status || ',"headers":[' || concat_ws(',', {_NAMED("content-type", TYPE)}, {_NAMED("retry-after", RETRY)}, {_NAMED("cf-mitigated", MITIGATED)}, {_NAMED("server", "('srv' || page_id % 3)")}) || ']}}' END,
  CASE WHEN declared IS NOT NULL THEN ',"challenge":{{"declared":"' || declared || '","rounds":0,"passed":false}}' END, '}}') AS line FROM v""")
def envelope_lines(spark: SparkSession, d: str) -> DataFrame:
    return flows.crawl_to_envelopes(_responses(spark, d), "text").select("page_id", F.col("envelope").alias("line"))


# -- responses and addresses


@_add("classify_responses", f"""
WITH {_CLASSIFIED}
SELECT page_id, CASE WHEN declared IS NOT NULL THEN 'needs' WHEN error_kind IS NOT NULL THEN 'error' ELSE 'parse' END AS verdict, error_kind, declared FROM v""")
def classify_responses(spark: SparkSession, d: str) -> DataFrame:
    return responses.classify_response(_responses(spark, d)).select("page_id", "verdict", "error_kind", "declared")


@_add("http_block", f"""
SELECT page_id, {STATUS} AS status, CASE WHEN {STATUS} IS NOT NULL THEN concat_ws(';', 'content-type=' || {TYPE}, 'retry-after=' || {RETRY}, 'cf-mitigated=' || {MITIGATED}, 'server=srv' || page_id % 3) END AS headers FROM pages""")
def http_block(spark: SparkSession, d: str) -> DataFrame:
    block = responses.http_block(F.col("status"), F.col("headers"))
    return _responses(spark, d).select("page_id", block["status"].alias("status"), F.array_join(F.transform(block["headers"], lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("headers"))


@_add("non_documents", f"SELECT page_id, {_MEDIA} AS media FROM pages")
def non_documents(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("page_id", responses.non_document(responses.header_value(F.col("headers"), "content-type")).alias("media"))


@_add("exit_codes", f"""
WITH {_CLASSIFIED} SELECT CASE WHEN declared IS NULL AND error_kind IS NOT NULL THEN 1 ELSE 0 END AS exit, count(*)::BIGINT AS n FROM v GROUP BY 1""")
def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    made = responses.classify_response(_responses(spark, d))
    return made.groupBy(responses.exit_code(F.when(F.col("verdict") == "parse", "ok").otherwise(F.col("verdict"))).alias("exit")).agg(F.count("*").alias("n"))


@_add("body_limits", "SELECT page_id, page_id % 250 = 0 AS too_long FROM pages")
def body_limits(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("CASE WHEN page_id % 250 = 0 THEN repeat('x', 16777217) ELSE html END")
    return responses.check_body_len(_pages(spark, d).select("page_id", body.alias("body"))).select("page_id", F.col("error.kind").isNotNull().alias("too_long"))


@_add("url_parts", rf"""
SELECT page_id, url AS href, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {HOST} AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path,
       CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '[?]([^#]*)', 1) END AS query, CASE WHEN url LIKE '%#%' THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = urls.url_parse(F.concat(F.lit(" "), F.regexp_replace("url", r"^(\w+)://([^/]+)", "$1://$2")))
    return _pages(spark, d).select("page_id", *[u[c].alias(c) for c in ("href", "scheme", "host", "path", "query", "fragment")])


@_add("url_errors", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL ELSE 'fetch.url' END AS kind FROM pages")
def url_errors(spark: SparkSession, d: str) -> DataFrame:
    bad = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'ftp://' || CAST(page_id AS STRING) || '.example/' ELSE 'no address ' || CAST(page_id AS STRING) END")
    return _pages(spark, d).select("page_id", urls.validate_url(bad)["kind"].alias("kind"))


_TARGET = f"CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://other.' || {HOST} || '/x' WHEN 2 THEN 'http://elsewhere.example/' END"


@_add("site_relations", rf"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'same-origin' WHEN 1 THEN CASE WHEN url LIKE 'https:%' THEN 'same-site' ELSE 'cross-site' END WHEN 2 THEN 'cross-site' ELSE 'cross-site' END AS relation,
       array_to_string(string_split({HOST}, '.')[-2:], '.') AS registrable,
       CASE page_id % 4 WHEN 0 THEN split_part(url, '#', 1) WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/' WHEN 2 THEN CASE WHEN url LIKE 'http:%' THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/' END END AS referer FROM pages""")
def site_relations(spark: SparkSession, d: str) -> DataFrame:
    target = F.expr(_TARGET)
    return _pages(spark, d).select("page_id", urls.site_relation(F.col("url"), target).alias("relation"), urls.registrable(F.col("url")).alias("registrable"), urls.referer(F.col("url"), target).alias("referer"))


@_add("page_references", rf"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'next' WHEN 1 THEN '/top' ELSE 'https://far.example/' END AS reference FROM pages")
def page_references(spark: SparkSession, d: str) -> DataFrame:
    folder = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"
    page = F.expr(f"{folder} || 'page.html'")
    href = F.expr(f"CASE page_id % 3 WHEN 0 THEN {folder} || 'next' WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/top' ELSE 'https://far.example/' END")
    return _pages(spark, d).select("page_id", comparison.reference(href, page).alias("reference"))


@_add("base_urls", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://b.example/x/' WHEN 1 THEN url ELSE regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/r/' END AS base FROM pages")
def base_urls(spark: SparkSession, d: str) -> DataFrame:
    made = "CASE page_id % 3 WHEN 0 THEN '<base target=t><base href=http://b.example/x/><base href=/no/>' WHEN 1 THEN '' ELSE '<base href=/r/>' END"
    rows = documents.parse_pages(_spliced(spark, d, made, "<head>"))
    return rows.select("page_id", documents.base_url(F.col("nodes"), F.col("url")).alias("base"))


@_add("data_urls", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/plain;charset=US-ASCII' WHEN 1 THEN 'text/html' END AS mime, CASE page_id % 3 WHEN 0 THEN 'a b' || page_id WHEN 1 THEN html END AS body FROM pages")
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("CASE page_id % 3 WHEN 0 THEN 'data:,a%20b' || CAST(page_id AS STRING) WHEN 1 THEN 'data:text/html;base64,' || base64(encode(html, 'UTF-8')) ELSE 'data:nothing' END")
    made = urls.decode_data_url(url)
    return _pages(spark, d).select("page_id", made["mime"].alias("mime"), made["body"].alias("body"))


@_add("decoded_bodies", "SELECT page_id, html AS body, 'utf-8' AS charset FROM pages")
def decoded_bodies(spark: SparkSession, d: str) -> DataFrame:
    plain = charsets.inflate(F.encode("html", "UTF-8"), F.lit("identity"))
    made = charsets.decode_body(plain["body"], F.lit(None).cast("string"))
    return _pages(spark, d).select("page_id", made["body"].alias("body"), made["charset"].alias("charset"))


def _gzip(html: pd.Series) -> pd.Series:
    return html.map(lambda h: gzip.compress(("\ufeff" + h).encode("utf-16-le"), mtime=0))


@_add("raw_bodies", "SELECT page_id, html, 'utf-16le' AS charset, NULL::VARCHAR AS error FROM pages")
def raw_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as recorded: gzip of UTF-16 with a byte-order mark, declared as Latin-1."""
    headers = F.array(F.struct(F.lit("Content-Encoding").alias("name"), F.lit("gzip").alias("value")), F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=latin1").alias("value")))
    rows = _pages(spark, d).select("page_id", vectorised("binary")(_gzip)(F.col("html")).alias("body"), headers.alias("headers"))
    return decode_responses(rows).select("page_id", "html", F.lower("charset").alias("charset"), F.col("error.kind").alias("error"))


@_add("charsets", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'KOI8-R' WHEN 1 THEN 'utf-8' ELSE 'latin1' END AS label FROM pages")
def charset_labels(spark: SparkSession, d: str) -> DataFrame:
    declared = F.expr("CASE page_id % 3 WHEN 0 THEN 'text/html; Charset=\"KOI8-R\"; x' WHEN 2 THEN 'text/html;charset=latin1' END")
    return _pages(spark, d).select("page_id", charsets.charset_of(declared, F.encode("html", "UTF-8")).alias("label"))


# -- styles

_STYLED = "'<link rel=\"StyleSheet\" href=\"/s' || CAST(page_id % 3 AS STRING) || '.css\"><link rel=stylesheet media=print href=/p.css>'"
_SHEETS = "regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/s' || CAST(page_id % 3 AS STRING) || '.css'"


@_add("external_hrefs", f"SELECT page_id, 0 AS pos, {_SHEETS} AS sheet_url FROM pages")
def external_hrefs(spark: SparkSession, d: str) -> DataFrame:
    return styles.external_hrefs(documents.parse_pages(_spliced(spark, d, _STYLED, "<head>")), "page_id")


@_add("sheet_rules", f"SELECT page_id, 0 AS pos, {_SHEETS} AS sheet_url, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS rules FROM pages")
def sheet_rules(spark: SparkSession, d: str) -> DataFrame:
    css = F.expr("CASE page_id % 3 WHEN 0 THEN '.h { display : none } @media print { p { display: none } }' WHEN 1 THEN 'p.h { color: red } @media all { b { c: d } }' ELSE '}' END")
    sheets = _pages(spark, d).select(F.expr(_SHEETS).alias("url"), css.alias("css")).distinct()
    return styles.sheet_rules(documents.parse_pages(_spliced(spark, d, _STYLED, "<head>")), sheets, "page_id")


@_add("media_queries", "SELECT page_id, length(html) % 2000 <= 1280 AS wide, length(html) % 2000 > 1280 AS other FROM pages")
def media_queries(spark: SparkSession, d: str) -> DataFrame:
    wide = F.expr("'screen and (min-width: ' || CAST(length(html) % 2000 AS STRING) || 'px), weird'")
    other = F.expr("'not all and (min-width:' || CAST(length(html) % 2000 AS STRING) || 'px), print'")
    return _pages(spark, d).select("page_id", styles.media_matches(wide).alias("wide"), styles.media_matches(other).alias("other"))


@_add("stylesheet_rules", "SELECT page_id, 2 + len(regexp_extract_all(html, '<style>')) + (CASE WHEN length(html) % 2000 <= 1280 THEN 1 ELSE 0 END) AS rules, 1 AS important FROM pages")
def stylesheet_rules(spark: SparkSession, d: str) -> DataFrame:
    """The page's own sheet and more rules behind it."""
    more = F.expr("'/* c */ a > b, .x{color:red!important;bad} @import url(x); bad{ } #id{y:z} @media (min-width:' || CAST(length(html) % 2000 AS STRING) || 'px){ p{a:b} }'")
    own = F.regexp_extract("html", r"(?s)<style>(.*?)</style>", 1)
    rows = _pages(spark, d).select("page_id", styles.parse_stylesheet(F.concat(own, more)).alias("r"))
    each = rows.select("page_id", F.explode("r").alias("rule"))
    important = F.sum(F.size(F.filter("rule.decls", lambda x: x["important"]))).cast("int")
    return each.groupBy("page_id").agg(F.count("*").alias("rules"), important.alias("important"))


# -- navigation

_REFRESHED = "CASE page_id % 5 WHEN 0 THEN '<meta http-equiv=refresh content=\"0; url=/r\">' WHEN 1 THEN '<meta http-equiv=refresh content=\"5;url=/r\">' WHEN 2 THEN '<meta http-equiv=refresh content=x><meta http-equiv=Refresh content=\"0;URL=''http://n.example/q''z\">' ELSE '' END"
_REFRESH = "CASE page_id % 7 WHEN 3 THEN '0; url=/h#f' WHEN 4 THEN '0;' || split_part(url, '#', 1) || '#part' WHEN 5 THEN 'no refresh' END"


@_add("refresh_targets", f"""
SELECT page_id, CASE WHEN page_id % 7 = 3 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/h#f' WHEN page_id % 7 = 4 THEN NULL
                     WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/r' WHEN page_id % 5 = 2 THEN 'http://n.example/q' END AS target FROM pages""")
def refresh_targets(spark: SparkSession, d: str) -> DataFrame:
    """Headers come first: one that goes on, one that only scrolls the page, one that is none."""
    rows = documents.parse_pages(_spliced(spark, d, _REFRESHED, "<head>"))
    headers = F.array_compact(F.array(F.when(F.expr(_REFRESH).isNotNull(), F.struct(F.lit("Refresh").alias("name"), F.expr(_REFRESH).alias("value")))))
    return rows.select("page_id", navigation.refresh_target(F.col("nodes"), F.col("url"), headers).alias("target"))


@_add("redirect_targets", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/n' END AS next, CASE page_id % 4 WHEN 1 THEN 'fetch.redirect' END AS error FROM pages")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    headers = F.expr("CASE WHEN page_id % 4 IN (0, 2) THEN array(named_struct('name', 'Location', 'value', '/n')) ELSE array() END")
    made = navigation.redirect_target(F.expr("CASE WHEN page_id % 4 < 2 THEN 302 ELSE 200 END"), headers, F.col("url"))
    return _pages(spark, d).select("page_id", made["next"].alias("next"), made["error"].alias("error"))


_NEXT = "CASE WHEN page_id % 20 = 19 THEN 'http://w.example/' || CAST(page_id AS STRING) WHEN page_id % 20 = 0 THEN NULL ELSE 'http://w.example/' || CAST(page_id - 1 AS STRING) END"


@_add("navigations", f"""
WITH RECURSIVE r AS (SELECT 'http://w.example/' || page_id AS addr, {_NEXT} AS nxt FROM pages),
go AS (SELECT page_id AS nav_id, 'http://w.example/' || page_id AS now, 1 AS n FROM pages UNION ALL SELECT nav_id, nxt, n + 1 FROM go JOIN r ON now = addr WHERE nxt IS NOT NULL AND n < 10),
ends AS (SELECT nav_id, max(n) AS n, arg_max(now, n) AS last FROM go GROUP BY nav_id)
SELECT nav_id, CASE WHEN nxt IS NULL THEN last END AS final_url, n::INTEGER AS n_hops, CASE WHEN nxt IS NOT NULL THEN 'fetch.redirect' END AS error FROM ends JOIN r ON last = addr""")
def navigations(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select(F.expr("'http://w.example/' || CAST(page_id AS STRING)").alias("url"), F.expr(_NEXT).alias("next"), F.lit(None).cast("string").alias("error"))
    seeds = _pages(spark, d).select(F.col("page_id").alias("nav_id"), F.expr("'http://w.example/' || CAST(page_id AS STRING)").alias("url"))
    return navigation.resolve_navigations(seeds, rows).select("nav_id", "final_url", F.size("hops").alias("n_hops"), "error")


@_add("followed", f"""
WITH RECURSIVE r AS (SELECT 'http://w.example/' || page_id AS addr, {_NEXT} AS nxt FROM pages),
go AS (SELECT page_id AS nav_id, 'http://w.example/' || page_id AS now, 1 AS n FROM pages UNION ALL SELECT nav_id, nxt, n + 1 FROM go JOIN r ON now = addr WHERE nxt IS NOT NULL AND n < 10),
ends AS (SELECT nav_id, max(n) AS n, arg_max(now, n) AS last FROM go GROUP BY nav_id)
SELECT nav_id, CASE WHEN nxt IS NULL THEN last END AS final_url, n::INTEGER AS n_hops, CASE WHEN nxt IS NOT NULL THEN 'fetch.redirect' END AS error FROM ends JOIN r ON last = addr""")
def followed(spark: SparkSession, d: str) -> DataFrame:
    """Redirects (odd pages) and refreshes within each page's own html (even ones) on one budget."""
    moved = f"page_id % 2 = 1 AND ({_NEXT}) IS NOT NULL"
    pages = _spliced(spark, d, f"CASE WHEN page_id % 2 = 0 THEN coalesce('<meta http-equiv=refresh content=\"0;url=' || ({_NEXT}) || '\">', '') ELSE '' END", "<head>")
    answers = pages.select(
        F.expr("'http://w.example/' || CAST(page_id AS STRING)").alias("url"), F.expr(f"CASE WHEN {moved} THEN 302 ELSE 200 END").alias("status"),
        F.expr(f"CASE WHEN {moved} THEN array(named_struct('name', 'Location', 'value', {_NEXT})) ELSE array() END").alias("headers"), "html",
    )
    seeds = pages.select(F.col("page_id").alias("nav_id"), F.expr("'http://w.example/' || CAST(page_id AS STRING)").alias("url"))
    return flows.follow(seeds, answers).select("nav_id", "final_url", F.size("hops").alias("n_hops"), "error")


_ATTEMPT = "SELECT event_id // 3 AS nav_id, event_id % 3 AS attempt, event_id % 4 = 1 AS challenged, event_id % 5 = 2 AS failed FROM events"


@_add("challenge_outcomes", f"""
WITH a AS (SELECT nav_id, attempt, challenged AND NOT failed AS c, failed FROM ({_ATTEMPT})),
g AS (SELECT nav_id, min(attempt) FILTER (c) AS first, max(attempt) AS last, arg_max(c, attempt) AS again, arg_max(failed, attempt) AS broke FROM a GROUP BY nav_id)
SELECT nav_id, 'retry-after' AS declared, (last > first)::INTEGER AS rounds, last > first AND NOT again AND NOT broke AS passed, CASE WHEN last = first THEN 'js' WHEN again THEN 'human' END AS verdict FROM g WHERE first IS NOT NULL""")
def challenge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).selectExpr(
        "event_id div 3 AS nav_id", "event_id % 3 AS attempt", "200 AS status", "event_id % 5 = 2 AS failed",
        "CASE WHEN event_id % 4 = 1 THEN array(named_struct('name', 'Retry-After', 'value', '5')) ELSE array() END AS headers",
    )
    return navigation.challenge_outcome(rows)


@_add("frozen_resources", """
WITH r AS (SELECT event_id AS seq, user_id AS session, event_type AS url, event_id % 7 = 0 AS nav, event_id % 3 <> 0 AS ok FROM events)
SELECT seq, CASE WHEN nav THEN seq ELSE coalesce(min(CASE WHEN ok AND NOT nav THEN seq END) OVER (PARTITION BY session, url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), seq) END AS served_by FROM r""")
def frozen_resources(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).selectExpr(
        "event_id AS seq", "user_id AS session", "event_type AS url", "event_id % 7 = 0 AS navigation",
        "array(named_struct('name', 'Vary', 'value', CASE WHEN event_id % 3 = 0 THEN 'cookie, accept-encoding' ELSE ' Accept-Encoding ,' END)) AS headers",
    )
    return navigation.frozen_resources(rows).select("seq", "served_by")


_LINE = "event_type || '=' || CAST(event_id AS STRING) || '; Path=' || CASE event_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/a' ELSE '/a/b' END || CASE event_id % 5 WHEN 0 THEN '; Max-Age=0' WHEN 1 THEN '; Domain=example.com' WHEN 2 THEN '; Secure' WHEN 3 THEN '; SameSite=Strict' ELSE '' END || CASE event_id % 7 WHEN 4 THEN '; Domain=other.test' WHEN 5 THEN '; Expires=Wed, 21 Oct 2015 07:28:00 GMT' WHEN 6 THEN '; SameSite=None' ELSE '' END"
_WRITES = """w AS (SELECT user_id AS session, event_id AS seq, event_type AS name, event_id::VARCHAR AS value, CASE event_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/a' ELSE '/a/b' END AS path,
  CASE WHEN event_id % 5 = 1 THEN 'example.com' ELSE 'www.example.com' END AS domain, event_id % 5 = 0 OR event_id % 7 = 5 AS gone, event_id % 5 = 2 AS secure, event_id % 5 = 3 AND event_id % 7 <> 6 AS strict, event_id % 7 = 6 AS anywhere FROM events WHERE event_id % 7 <> 4)"""


def _cookie_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", F.lit("https://www.example.com/x").alias("url"), F.expr(_LINE).alias("line"), F.lit(False).alias("from_script"))


@_add("cookie_jars", f"""
WITH {_WRITES}, k AS (SELECT *, row_number() OVER (PARTITION BY session, name, domain, path ORDER BY seq DESC) AS rn FROM w)
SELECT session, name, value, domain, path, secure, seq AS created FROM k WHERE rn = 1 AND NOT gone""")
def cookie_jars(spark: SparkSession, d: str) -> DataFrame:
    return navigation.cookie_jar(_cookie_events(spark, d)).select("session", "name", "value", "domain", "path", "secure", "created")


@_add("cookie_headers", f"""
WITH {_WRITES}, l AS (SELECT *, lead(seq) OVER (PARTITION BY session, name, domain, path ORDER BY seq) AS until FROM w),
q AS (SELECT event_id AS request_id, user_id AS session, event_id AS seq, event_id % 2 = 0 AS https, CASE WHEN event_id % 4 < 2 THEN '/a/x' ELSE '/a/b' END AS p, event_id % 3 = 0 AS cross, event_id % 8 <> 7 AS nav FROM events),
m AS (SELECT request_id, l.path, l.seq, name || '=' || value AS pair FROM q JOIN l ON q.session = l.session AND l.seq < q.seq AND (until IS NULL OR until >= q.seq) AND NOT gone
      WHERE (NOT secure OR https) AND (anywhere OR NOT "cross" OR NOT strict AND nav) AND (nav OR NOT "cross") AND (l.path = '/' OR l.path = p OR starts_with(p, l.path || '/'))),
g AS (SELECT request_id, string_agg(pair, '; ' ORDER BY len(path) DESC, seq) AS cookie FROM m GROUP BY request_id)
SELECT request_id, cookie FROM q LEFT JOIN g USING (request_id)""")
def cookie_headers(spark: SparkSession, d: str) -> DataFrame:
    requests = _events(spark, d).selectExpr(
        "event_id AS request_id", "user_id AS session", "event_id AS seq",
        "CASE WHEN event_id % 2 = 0 THEN 'https' ELSE 'http' END || '://www.example.com' || CASE WHEN event_id % 4 < 2 THEN '/a/x' ELSE '/a/b' END AS target",
        "CASE WHEN event_id % 3 = 0 THEN 'https://far.test/' END AS referrer", "CASE WHEN event_id % 8 = 7 THEN 'fetch' ELSE 'navigation' END AS intent",
    )
    return navigation.cookie_header(requests, _cookie_events(spark, d)).select("request_id", "cookie")


@_add("second_requests", f"""
WITH {_WRITES}, n AS (SELECT event_id AS nav_id, user_id AS session, event_id AS a, event_id + 40 AS b FROM events),
t AS (SELECT nav_id, session, 'x' AS w, a AS upto FROM n UNION ALL SELECT nav_id, session, 'y', b FROM n),
k AS (SELECT t.nav_id, t.w, w.*, row_number() OVER (PARTITION BY t.nav_id, t.w, w.name, w.domain, w.path ORDER BY w.seq DESC) AS rn FROM t JOIN w ON t.session = w.session AND w.seq <= t.upto AND w.path = '/'),
s AS (SELECT nav_id, max(c) FILTER (w = 'x') AS b, max(c) FILTER (w = 'y') AS a FROM (SELECT nav_id, w, string_agg(name || '=' || value, '; ' ORDER BY seq) AS c FROM k WHERE rn = 1 AND NOT gone GROUP BY nav_id, w) GROUP BY nav_id)
SELECT n.nav_id, s.b IS DISTINCT FROM s.a AS warranted FROM n LEFT JOIN s USING (nav_id)""")
def second_requests(spark: SparkSession, d: str) -> DataFrame:
    attempts = _events(spark, d).selectExpr("event_id AS nav_id", "user_id AS session", "'https://www.example.com/' AS url", "event_id AS challenge_seq", "event_id + 40 AS end_seq")
    return navigation.warrants_second_request(attempts, _cookie_events(spark, d)).select("nav_id", "warranted")


# -- comparisons

_RUN = "SELECT CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'candidate' END AS side, CAST(user_id // 2 AS VARCHAR) AS url, event_type AS recipe, event_id AS run_no, CAST(round(value * 100) AS BIGINT) AS wall_ms, CASE WHEN value > 50 THEN 'ok' ELSE 'error' END AS status, event_id % 50 = 0 AS odd FROM events"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(
        "CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'candidate' END AS side", "CAST(user_id div 2 AS STRING) AS url", "event_type AS recipe", "event_id AS run_no",
        "CAST(round(value * 100) AS BIGINT) AS wall_ms", "CASE WHEN value > 50 THEN 'ok' ELSE 'error' END AS status", "'' AS needs", "'' AS error_kind", "CAST(NULL AS INT) AS http_status", "'s' AS sha",
        "1 AS elements", "1 AS text_chars", "CASE WHEN user_id % 4 < 2 THEN 'control' ELSE 'soft-gate' END AS class", "CASE WHEN event_id % 50 = 0 THEN 2 WHEN value > 50 THEN 0 ELSE 1 END AS exit", "false AS executed",
    )


_AGG = f"""r AS ({_RUN}), g AS (SELECT side, url, recipe, arg_min(status, run_no) AS status, arg_min(odd, run_no)::INTEGER AS odd, count(DISTINCT status) = 1 AS stable, count(*) AS n, list_sort(list(wall_ms)) AS ws FROM r GROUP BY side, url, recipe)"""


@_add("aggregate_runs", f"WITH {_AGG} SELECT side, url, recipe, status, stable, ws[((50 * (n - 1) + 50) // 100 + 1)::INT] AS p50, ws[((95 * (n - 1) + 50) // 100 + 1)::INT] AS p95 FROM g")
def aggregate_runs(spark: SparkSession, d: str) -> DataFrame:
    return comparison.aggregate_runs(_runs(spark, d)).select("side", "url", "recipe", "status", "stable", "p50", "p95")


_COMPARED = f"""{_AGG}, c AS (SELECT b.url, b.recipe, b.url::INT % 2 = 0 AS control, b.status AS bs, k.status AS ks, b.stable AND k.stable AS steady, b.odd + k.odd AS violations FROM g b JOIN g k ON b.url = k.url AND b.recipe = k.recipe AND b.side = 'base' AND k.side = 'candidate')"""


@_add("ab_compare", f"WITH {_COMPARED} SELECT url, recipe, control AND steady AND bs <> ks AS parity_drift, NOT control AND bs <> 'ok' AND ks = 'ok' AS gate_cleared, violations FROM c")
def ab_compare(spark: SparkSession, d: str) -> DataFrame:
    return flows.compare_crawls(_runs(spark, d)).select("url", "recipe", "parity_drift", "gate_cleared", "violations")


@_add("ab_verdict", f"WITH {_COMPARED} SELECT coalesce(sum(violations), 0)::BIGINT AS violations, count(*) FILTER (control AND steady AND bs <> ks)::BIGINT AS parity_drifts, coalesce(bool_or(NOT control AND bs <> 'ok' AND ks = 'ok'), false) AS gate_cleared, NOT coalesce(bool_or(NOT control AND bs <> 'ok' AND ks = 'ok'), false) AS null_result FROM c")
def ab_verdict(spark: SparkSession, d: str) -> DataFrame:
    return comparison.ab_verdict(flows.compare_crawls(_runs(spark, d)))


@_add("probe_tally", "SELECT event_type AS surface, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def probe_tally(spark: SparkSession, d: str) -> DataFrame:
    return comparison.probe_tally(_events(spark, d).select(F.col("event_type").alias("surface")))


_JA4_HEAD = "'t13d0203' || CASE WHEN event_id % 2 = 0 THEN 'h2' ELSE '00' END"


@_add("ja4", f"""
WITH p AS (SELECT event_id, {_JA4_HEAD} AS head, printf('%04x', 4864 + user_id % 200) AS a, printf('%04x', 4865 + length(props) * 7 % 300) AS b, printf('%04x', 20 + event_id % 7) AS e FROM events),
s AS (SELECT event_id, head, array_to_string(list_sort([a, b]), ',') AS c, e || '_0403,' || '0804' AS x FROM p)
SELECT event_id, head || '_' || c || '_' || x AS raw, head || '_' || substr(sha256(c), 1, 12) || '_' || substr(sha256(x), 1, 12) AS ja4 FROM s""")
def ja4(spark: SparkSession, d: str) -> DataFrame:
    hello = F.struct(
        F.lit(0x0304).alias("version"), F.lit(True).alias("sni"), F.array(F.lit(0x1A1A), (F.lit(4864) + F.col("user_id") % 200).cast("int"), (F.lit(4865) + F.length("props") * 7 % 300).cast("int")).alias("ciphers"),
        F.array(F.lit(0x0A0A), F.lit(0), F.lit(16), (F.lit(20) + F.col("event_id") % 7).cast("int")).alias("extensions"), F.array(F.lit(0x0403), F.lit(0x0804)).alias("sig_algs"), F.when(F.col("event_id") % 2 == 0, "h2").otherwise("").alias("alpn"),
    )
    return _events(spark, d).select("event_id", hello.alias("h")).select("event_id", comparison.ja4_raw(F.col("h")).alias("raw"), comparison.ja4(F.col("h")).alias("ja4"))


def _delta_input(spark: SparkSession, d: str) -> DataFrame:
    """Each page's lines against the same lines less the first and with one more."""
    rows = views.text_view(_pages(spark, d)).select(F.col("page_id").alias("fixture"), F.lit("text").alias("channel"), F.split("text", "\n").alias("a"))
    return rows.withColumn("b", F.concat(F.slice("a", 2, F.greatest(F.lit(0), F.size("a") - 1)), F.array(F.lit("one more line"))))


@_add("ordered_deltas", f"""
WITH t AS (SELECT page_id, string_split({_BODY_TEXT}, chr(10)) AS a FROM pages)
SELECT page_id AS fixture, 'text' AS channel, 0 AS pos, '- ' || a[1] AS delta FROM t UNION ALL SELECT page_id, 'text', 1, '+ one more line' FROM t""")
def ordered_deltas(spark: SparkSession, d: str) -> DataFrame:
    return comparison.deltas(_delta_input(spark, d))


@_add("middle_deltas", f"""
WITH t AS (SELECT page_id, string_split({_BODY_TEXT}, chr(10)) AS a FROM pages), k AS (SELECT page_id, a, (len(a) // 2 + 1)::INTEGER AS m FROM t)
SELECT page_id AS fixture, 'text' AS channel, 0 AS pos, '- ' || a[m] AS delta FROM k UNION ALL SELECT page_id, 'text', 1, '+ changed ' || page_id FROM k UNION ALL SELECT page_id, 'text', 2, '+ ' || a[len(a)] FROM k""")
def middle_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Each page's lines with the middle one changed and the last one repeated."""
    rows = views.text_view(_pages(spark, d)).select(F.col("page_id").alias("fixture"), F.lit("text").alias("channel"), F.split("text", "\n").alias("a"))
    changed = F.transform("a", lambda x, i: F.when(i == F.floor(F.size("a") / 2), F.concat(F.lit("changed "), F.col("fixture").cast("string"))).otherwise(x))
    return comparison.deltas(rows.withColumn("b", F.array_append(changed, F.element_at("a", -1))))


@_add("undisposed", "SELECT page_id AS fixture, 'text' AS channel, '+ one more line' AS delta, 'undeclared' AS problem FROM pages UNION ALL SELECT page_id, 'text', '- gone', 'gone' FROM pages")
def undisposed(spark: SparkSession, d: str) -> DataFrame:
    actual = comparison.deltas(_delta_input(spark, d)).drop("pos")
    ledger = actual.filter("delta like '- %'").unionByName(_pages(spark, d).select(F.col("page_id").alias("fixture"), F.lit("text").alias("channel"), F.lit("- gone").alias("delta")))
    return comparison.undisposed(actual, ledger)


@_add("capture_check", """SELECT page_id AS fixture, CASE page_id % 3 WHEN 1 THEN 'bytes changed' ELSE 'incomplete stamp' END AS problem FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 4
UNION ALL SELECT page_id, 'no capture' FROM pages WHERE page_id % 5 = 4 UNION ALL SELECT -1 - page_id, 'no page' FROM pages WHERE page_id % 5 = 3""")
def capture_check(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select(F.col("page_id").alias("fixture"), F.col("html").alias("body"))
    sha = F.when(F.col("fixture") % 3 == 1, F.lit("x")).otherwise(F.sha2("body", 256))
    taken = pages.filter("fixture % 5 <> 4").unionByName(pages.filter("fixture % 5 = 3").withColumn("fixture", -1 - F.col("fixture")))
    captures = taken.select("fixture", F.lit("page.html").alias("file"), F.create_map(F.lit("page.html"), sha).alias("bytes"), F.when(F.col("fixture") % 3 != 2, "2020-01-01").alias("date"))
    return comparison.capture_check(pages, captures)


@_add("projected_lines", rf"""SELECT page_id, pos::INTEGER AS pos, regexp_extract(a, 'href="([^"]*)"', 1) <> '' AS ok, '"' || {_plain("regexp_extract(a, '>([^<]*)<', 1)")} || '"' AS said FROM ({_ANCHORS})""")
def projected_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).select("page_id", "url", views.links_of(F.col("nodes"), F.col("url")).alias("l"))
    lines = rows.select("page_id", F.posexplode(comparison.project_links(F.col("l"), F.col("url"))).alias("pos", "line"))
    return lines.select("page_id", "pos", F.col("line").startswith("/").alias("ok"), F.regexp_extract("line", '^[^ ]* (".*")$', 1).alias("said"))


@_add("projected_text", f"SELECT page_id, len(list_filter(regexp_split_to_array({_BODY_TEXT}, '\\s+'), lambda t: t <> ''))::BIGINT AS n_tokens FROM pages")
def projected_text(spark: SparkSession, d: str) -> DataFrame:
    return views.text_view(_pages(spark, d)).select("page_id", F.size(comparison.project_text(F.col("text"))).cast("long").alias("n_tokens"))


@_add("projected_forms", """
SELECT page_id, unnest(['form ' || 'http://b.example/d/' || page_id % 3 || ' post', '  input type="text" name="q"', '  textarea type="" name="t"', '  select type="" name="s"', 'form http://b.example/d/ get']) AS line FROM pages""")
def projected_forms(spark: SparkSession, d: str) -> DataFrame:
    made = views.forms(documents.parse_pages(_spliced(spark, d, _FORM)), "page_id")
    listed = made.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "action", "method", "fields"))).alias("f"))
    return listed.select("page_id", F.explode(comparison.project_forms(F.col("f"), F.lit("http://page.example/x/p.html"))).alias("line"))


@_add("projected_boxes", """
SELECT page_id, '7 nav,' || (9 + 2 * n) || ' div,' || (10 + 2 * n) || ' article,' || (11 + 2 * n) || ' h1' AS line FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages)""")
def projected_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page's parts, as a recording holds them, out of order."""
    boxes = F.reverse(F.transform(documents.elements_of(F.col("nodes"), "nav", "div", "article", "h1"), lambda n: F.struct(n["ord"].alias("i"), n["name"].alias("tag"))))
    return _nodes(spark, d).select("page_id", F.array_join(comparison.project_boxes(boxes), ",").alias("line"))


@_add("projected_ax", """
WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
k AS (SELECT page_id, unnest(regexp_extract_all(h, '<(h1|p|br)>')) AS tag, unnest(range(1, len(regexp_extract_all(h, '<(h1|p|br)>')) + 1)) AS n FROM t),
e AS (SELECT page_id, n, CASE tag WHEN '<h1>' THEN 'heading "' || page_id || '" level=1' WHEN '<p>' THEN 'paragraph ""' END AS line FROM k WHERE tag <> '<br>'),
a AS (SELECT page_id, count(e.line) AS m FROM t LEFT JOIN e USING (page_id) GROUP BY page_id)
SELECT page_id, 0::INTEGER AS pos, 'article ""' AS line FROM t UNION ALL SELECT page_id, 1, '(' FROM a WHERE m > 0
UNION ALL SELECT page_id, (1 + row_number() OVER (PARTITION BY page_id ORDER BY n))::INTEGER, line FROM e UNION ALL SELECT page_id, (m + 2)::INTEGER, ')' FROM a WHERE m > 0""")
def projected_ax(spark: SparkSession, d: str) -> DataFrame:
    """Trees recorded from the nodes of each page's article: headings, paragraphs, texts, and line breaks in a spliced group."""
    nodes = F.col("nodes")
    article = F.get(documents.elements_of(nodes, "article"), F.lit(0))
    part = F.array_append(documents.below(nodes, article), article)
    element = lambda n: n["kind"] == "element"
    role = lambda n: F.when(~element(n), "StaticText").when(n["name"] == "h1", "heading").when(n["name"] == "p", "paragraph").when(n["name"] == "article", "article").otherwise("generic")
    name = lambda n: F.when(n["name"] == "h1", F.col("page_id").cast("string"))
    kids = lambda n: F.transform(F.filter(documents.below(nodes, n), lambda m: m["parent"] == n["id"]), lambda m: m["id"].cast("string"))
    recorded = lambda n: F.struct(
        n["id"].cast("string").alias("nodeId"), F.when(n["name"] == "article", "r").otherwise(n["parent"].cast("string")).alias("parentId"), F.struct(role(n).alias("value")).alias("role"), F.struct(name(n).alias("value")).alias("name"),
        kids(n).alias("childIds"), F.array(F.struct(F.lit("level").alias("name"), F.struct(F.lit(1).alias("value")).alias("value"))).alias("properties"))
    root = F.struct(F.lit("r").alias("nodeId"), F.lit(None).cast("string").alias("parentId"), F.struct(F.lit("RootWebArea").alias("value")).alias("role"), F.struct(F.lit(None).cast("string").alias("value")).alias("name"), F.array(article["id"].cast("string")).alias("childIds"), F.array().cast("array<struct<name:string,value:struct<value:int>>>").alias("properties"))
    trees = _nodes(spark, d).select("page_id", F.to_json(F.array_append(F.transform(part, recorded), root)).alias("tree"), F.array().cast("array<long>").alias("hidden"))
    return outlines.ax_outlines(trees, "tree", "hidden", "page_id").select("page_id", F.posexplode("outline").alias("pos", "line"))


_FOLDED = "CASE page_id % 3 WHEN 0 THEN '<details><summary>s</summary><p>x</p></details>' WHEN 1 THEN '<canvas><p>x</p></canvas>' ELSE '<video><p>x</p></video>' END"


@_add("concealment", "SELECT page_id, true AS unpainted, page_id % 3 <> 1 AS concealed FROM pages")
def concealment(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.parse_pages(_spliced(spark, d, _FOLDED))
    return documents.elements(rows, "p", "page_id").filter("unpainted").select("page_id", "unpainted", "concealed")


@_add("ax_roles", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'banner' ELSE 'sectionheader' END AS role, CASE WHEN page_id % 4 < 2 THEN 'n' || page_id END AS name FROM pages")
def ax_roles(spark: SparkSession, d: str) -> DataFrame:
    made = ("CASE WHEN page_id % 2 = 0 THEN '' ELSE '<article>' END || '<header' || CASE WHEN page_id % 4 < 2 THEN ' aria-label=n' || CAST(page_id AS STRING) ELSE '' END || '>x</header>' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '</article>' END")
    return views.roles(documents.parse_pages(_spliced(spark, d, made)), "page_id").filter("role in ('banner', 'sectionheader')").select("page_id", "role", "name")


# -- disclosure


def _scan_sql(rows: str) -> str:
    """Findings of ``rows`` (id, text) by the same rules."""
    lines = f"WITH src AS ({rows}), l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM src)"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for r in disclosure.RULES:
        exempt = f" WHERE NOT regexp_matches(m, {quote('^(?:' + r.exempt + ')')})" if r.exempt else ""
        parts.append(f"SELECT id, n AS line, {quote(r.name)} AS rule, CASE WHEN length(m) > 12 THEN substr(m, 1, 12) || '...' ELSE m END AS excerpt FROM (SELECT id, n, unnest(regexp_extract_all(line, {quote(r.pattern)})) AS m FROM l){exempt}")
    return f"{lines}, found AS ({' UNION ALL '.join(parts)})"


_DOCS = "SELECT doc_id AS id, text FROM documents"


@_add("leak_findings", f"{_scan_sql(_DOCS)} SELECT id, line::INTEGER AS line, rule, excerpt FROM found")
def leak_findings(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.leak_findings(_documents(spark, d), "doc_id", "text")


_DERIVED = "CASE page_id % 6 WHEN 0 THEN 'mail a' || CAST(page_id AS STRING) || '@corp.io now' WHEN 1 THEN 'see /home/bob/x and /home/u/y' WHEN 2 THEN 'AS64500 AS123 at 2a02:1:2::5' WHEN 3 THEN 'lat: 12.345, x' WHEN 4 THEN '> Human: hello' ELSE 'mac 00:11:22:aa:bb:cc password=\"abc12345\"' END || chr(10) || html"


@_add("leak_findings_derived", f"{_scan_sql(f'SELECT page_id AS id, {_DERIVED} AS text FROM pages')} SELECT id, line::INTEGER AS line, rule, excerpt FROM found")
def leak_findings_derived(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.leak_findings(_pages(spark, d).select("page_id", F.expr(_DERIVED).alias("text")), "page_id", "text")


@_add("rule_selftest", f"""{_scan_sql(f"SELECT page_id AS id, {_DERIVED} AS text FROM pages")}
SELECT 'clean' AS rule, id::INTEGER AS line_no, 'flagged' AS problem FROM found WHERE id % 3 = 0 GROUP BY id
UNION ALL SELECT 'personal-email', p.page_id, 'not flagged' FROM pages p WHERE page_id % 3 <> 0 AND page_id NOT IN (SELECT id FROM found WHERE rule = 'personal-email')
UNION ALL SELECT 'personal-email', page_id, 'no marker' FROM pages WHERE page_id % 3 <> 0""")
def rule_selftest(spark: SparkSession, d: str) -> DataFrame:
    """Pages as fixtures that must be clean, or must hold an address (and a marker, which none does)."""
    rule = F.when(F.col("page_id") % 3 == 0, "clean").otherwise("personal-email")
    fixtures = _pages(spark, d).select(rule.alias("rule"), F.col("page_id").cast("int").alias("line_no"), F.expr(_DERIVED).alias("text"), (F.col("page_id") % 3 != 0).alias("must_flag"))
    return disclosure.rule_selftest(fixtures)


@_add("leak_summary", f"{_scan_sql(_DOCS)} SELECT rule, count(*)::BIGINT AS findings, count(DISTINCT id)::BIGINT AS ids FROM found GROUP BY rule")
def leak_summary(spark: SparkSession, d: str) -> DataFrame:
    return flows.disclosure_report(_documents(spark, d), "doc_id", "text").drop("advice")


@_add("scan_verdict", f"{_scan_sql('SELECT conv_id AS id, text FROM conversations')} SELECT count(*)::BIGINT AS findings, count(*) = 0 AS clean FROM found")
def scan_verdict(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.is_clean(disclosure.leak_findings(_table(spark, d, "conversations"), "conv_id", "text"))


_PATH = "coalesce(source, 'none') || '/' || CASE doc_id % 6 WHEN 0 THEN 'a/.env' WHEN 1 THEN 'src/x.rs' WHEN 2 THEN '.ssh/config' WHEN 3 THEN 'k/id_rsa.pub' WHEN 4 THEN 'd/server.pem' ELSE 'env/readme' END"


@_add("forbidden_paths", f"SELECT doc_id, {_PATH} AS path, 'forbidden-path' AS rule FROM documents WHERE doc_id % 6 IN (0, 2, 3, 4)")
def forbidden_paths(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.forbidden_paths(_documents(spark, d).select("doc_id", F.expr(_PATH).alias("path")), "path")


@_add("binary_content", "SELECT doc_id, 'binary-content' AS rule FROM documents WHERE doc_id % 4 IN (0, 1)")
def binary_content(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN X'410042' WHEN 1 THEN X'41FF42' WHEN 2 THEN CAST('' AS BINARY) ELSE CAST(text AS BINARY) END")
    return disclosure.binary_content(_documents(spark, d).select("doc_id", raw.alias("raw")), "raw").select("doc_id", "rule")


@_add("scan_changed", f"{_scan_sql("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")} SELECT id, line::INTEGER AS line, rule, excerpt FROM found")
def scan_changed(spark: SparkSession, d: str) -> DataFrame:
    new = _documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), "text")
    old = _documents(spark, d).selectExpr("CASE WHEN doc_id % 5 = 0 THEN 'moved' || CAST(doc_id AS STRING) ELSE CAST(doc_id AS STRING) END AS path", "CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END AS text")
    return disclosure.scan_changed(old, new, "path", "text")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_by_host(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
