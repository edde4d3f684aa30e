"""The views of a page: text, links, forms, metadata, headings, roles, and whether it needs scripts.

All are expressions over ``nodes``; only joining addresses is a helper. All steps are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.urls import resolve, resolve_all
from pagegrain.operators.documents import attr, base_url, below, elements_of, text_content
from pagegrain.operators.markup import derive, tokens
from pagegrain.operators.responses import WHITE as WHITE_CLASS
from pagegrain.operators.responses import ascii_lower, classify_response, envelope, error_message, header_value, http_block, non_document, trim_white

CONTENT_VIEWS = ("text", "links", "forms")

# Roles of elements without a role attribute.
ROLES = {
    "a": "link", "article": "article", "aside": "complementary", "button": "button", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "img": "img", "li": "listitem", "main": "main", "nav": "navigation", "ol": "list", "p": "paragraph", "table": "table", "textarea": "textbox", "tr": "row", "ul": "list",
}
# End of fixed values.


def text_view(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``text``."""
    return derive(df, ["text"], html)


def links_of(nodes: Column, base: Column) -> Column:
    """array<struct<kind, href, text, rel>> of each a, area and link with an href, in document order."""
    found = F.filter(elements_of(nodes, "a", "area", "link"), lambda n: attr(n, "href").isNotNull())
    hrefs = resolve_all(base, F.transform(found, lambda n: attr(n, "href")))
    made = lambda n, href: F.struct(
        n["name"].alias("kind"), href.alias("href"),
        F.when(n["name"] != "link", F.array_join(tokens(text_content(nodes, n)), " ")).alias("text"), tokens(attr(n, "rel")).alias("rel"),
    )
    return F.zip_with(found, hrefs, made)


def links(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, kind, href, text, rel): a row a link. Needs ``nodes`` and ``url``."""
    rows = df.select(*keys, "nodes", base_url(F.col("nodes"), F.col("url")).alias("_base"))
    rows = rows.select(*keys, F.posexplode(F.transform(F.filter(elements_of(F.col("nodes"), "a", "area", "link"), lambda n: attr(n, "href").isNotNull()), lambda n: F.struct(
        n["name"].alias("kind"), attr(n, "href").alias("raw"), F.when(n["name"] != "link", F.array_join(tokens(text_content(F.col("nodes"), n)), " ")).alias("text"), tokens(attr(n, "rel")).alias("rel")))).alias("pos", "x"), "_base")
    return rows.select(*keys, "pos", "x.kind", resolve(F.col("_base"), F.col("x.raw")).alias("href"), "x.text", "x.rel")


def options_of(nodes: Column, node: Column) -> Column:
    """array<struct<value, label>> of the options below a select."""
    label = lambda o: trim_white(text_content(nodes, o))
    return F.transform(elements_of(below(nodes, node), "option"), lambda o: F.struct(F.coalesce(attr(o, "value"), label(o)).alias("value"), label(o).alias("label")))


def fields_of(nodes: Column, node: Column) -> Column:
    """array<struct<tag, name, type, value, required, options>> of the fields below a form."""
    return F.transform(elements_of(below(nodes, node), "input", "textarea", "select", "button"), lambda f: F.struct(
        f["name"].alias("tag"), attr(f, "name").alias("name"), F.when(f["name"].isin("input", "button"), attr(f, "type")).alias("type"),
        F.when(f["name"] == "textarea", text_content(nodes, f)).otherwise(attr(f, "value")).alias("value"), attr(f, "required").isNotNull().alias("required"),
        F.when(f["name"] == "select", options_of(nodes, f)).alias("options")))


def forms(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, action, method, enctype, fields): a row a form. Needs ``nodes`` and ``url``."""
    nodes = F.col("nodes")
    one = F.transform(elements_of(nodes, "form"), lambda n: F.struct(
        F.coalesce(attr(n, "action"), F.lit("")).alias("raw"), F.coalesce(ascii_lower(attr(n, "method")), F.lit("get")).alias("method"),
        F.coalesce(attr(n, "enctype"), F.lit("application/x-www-form-urlencoded")).alias("enctype"), fields_of(nodes, n).alias("fields")))
    rows = df.select(*keys, base_url(nodes, F.col("url")).alias("_base"), F.posexplode(one).alias("pos", "x"))
    return rows.select(*keys, "pos", resolve(F.col("_base"), F.col("x.raw")).alias("action"), "x.method", "x.enctype", "x.fields")


def form_fields(forms_df: DataFrame, *keys: str) -> DataFrame:
    """A row a field of ``forms``: (keys, pos, field, tag, name, type, value, required, options)."""
    return forms_df.select(*keys, "pos", F.posexplode("fields").alias("field", "f")).select(*keys, "pos", "field", "f.*")


def select_options(fields_df: DataFrame, *keys: str) -> DataFrame:
    """A row an option of ``form_fields``: (keys, pos, field, option, value, label)."""
    return fields_df.select(*keys, "pos", "field", F.posexplode("options").alias("option", "o")).select(*keys, "pos", "field", "option", "o.*")


def _charset(content: Column) -> Column:
    found = F.regexp_extract(content, rf"(?is)charset=([^;{WHITE_CLASS}]*)", 1)
    bare = F.regexp_replace(found, r"""^["']+|["']+$""", "")
    return F.when(F.length(bare) > 0, bare)


def meta_columns(nodes: Column, page_url: Column) -> dict[str, Column]:
    """title and lang (first), charset (first), canonical (last, resolved)."""
    first = lambda x: F.try_element_at(x, F.lit(1))
    charsets = F.transform(elements_of(nodes, "meta"), lambda n: F.coalesce(attr(n, "charset"), F.when(ascii_lower(attr(n, "http-equiv")) == "content-type", _charset(attr(n, "content")))))
    canonical = F.filter(elements_of(nodes, "link"), lambda n: F.exists(tokens(attr(n, "rel")), lambda t: ascii_lower(t) == "canonical"))
    raw = F.when(F.size(canonical) > 0, attr(F.try_element_at(canonical, F.lit(-1)), "href"))
    titles = elements_of(nodes, "title")
    return {
        "title": F.when(F.size(titles) > 0, trim_white(text_content(nodes, first(titles)))), "lang": attr(first(elements_of(nodes, "html")), "lang"),
        "charset": ascii_lower(first(F.filter(charsets, lambda c: c.isNotNull()))), "canonical": resolve(base_url(nodes, page_url), raw),
    }


def page_meta(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, title, lang, charset, canonical). Needs ``nodes`` and ``url``."""
    return df.select(*keys, *[c.alias(name) for name, c in meta_columns(F.col("nodes"), F.col("url")).items()])


def entries_of(nodes: Column) -> Column:
    """array<struct<name, property, http_equiv, content>> of meta elements with content and at least one of the names."""
    one = F.transform(elements_of(nodes, "meta"), lambda n: F.struct(attr(n, "name").alias("name"), attr(n, "property").alias("property"), attr(n, "http-equiv").alias("http_equiv"), attr(n, "content").alias("content")))
    return F.filter(one, lambda m: m["content"].isNotNull() & F.coalesce(m["name"], m["property"], m["http_equiv"]).isNotNull())


def meta_entries(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, name, property, http_equiv, content): a row an entry. Needs ``nodes``."""
    return df.select(*keys, F.posexplode(entries_of(F.col("nodes"))).alias("pos", "m")).select(*keys, "pos", "m.*")


def roles_of(nodes: Column) -> Column:
    """array<struct<id, role, name, level>> of the elements with a role: their own, else that of the element."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    edge = lambda n: F.when(n["name"] == "header", F.when(n["sectioned"], "sectionheader").otherwise("banner")).when(n["name"] == "footer", F.when(n["sectioned"], "sectionfooter").otherwise("contentinfo"))
    implied = lambda n: F.when(n["name"].isin("header", "footer"), edge(n)).when((n["name"] == "a") & attr(n, "href").isNull(), F.lit(None).cast("string")).otherwise(known[n["name"]])
    role = lambda n: F.coalesce(F.get(tokens(ascii_lower(attr(n, "role"))), F.lit(0)), implied(n))
    own = lambda n: F.when(F.size(tokens(attr(n, "aria-label"))) > 0, F.array_join(tokens(attr(n, "aria-label")), " "))
    named = lambda n, r: F.coalesce(own(n), F.when(r == "img", attr(n, "alt")).when(r.isin("heading", "link", "button"), F.array_join(tokens(text_content(nodes, n)), " ")))
    level = lambda n, r: F.when(r == "heading", F.coalesce(attr(n, "aria-level").try_cast("int"), F.substring(n["name"], 2, 1).try_cast("int")))
    made = F.transform(F.filter(nodes, lambda n: n["kind"] == "element"), lambda n: F.struct(n["id"].alias("id"), role(n).alias("role"), named(n, role(n)).alias("name"), level(n, role(n)).alias("level")))
    return F.filter(made, lambda x: x["role"].isNotNull())


def roles(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, role, name, level) of every element with a role. Needs ``nodes``."""
    return df.select(*keys, F.inline(roles_of(F.col("nodes"))))


def headings(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, level, name): a row a heading. Needs ``nodes``."""
    return roles(df, *keys).filter("role = 'heading'").select(*keys, "id", "level", "name")


def content_signals(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with has_text and has_label of the body less chrome."""
    return derive(df, ["has_text", "has_label"], html)


def needs(view: str, has_script: Column, has_body: Column, has_text: Column, has_label: Column) -> Column:
    """['js'] if a body with scripts has nothing that the view could show; else an empty array."""
    if view not in CONTENT_VIEWS:
        return F.array().cast("array<string>")
    starved = ~has_text if view == "text" else ~has_text & ~has_label
    return F.when(has_body & has_script & starved, F.array(F.lit("js"))).otherwise(F.array().cast("array<string>"))


_VIEW_OUTPUT = {"text": "text", "dom": "dom", "links": "nodes", "forms": "nodes", "meta": "nodes"}


def impressions(responses: DataFrame, view: str, key: str = "page_id") -> DataFrame:
    """(key, status, error_kind, needs, envelope): responses (url, html, status, headers) to one envelope each.

    Disposition comes first, and only what is a document is parsed; one parse gives everything.
    """
    rows = classify_response(responses.withColumnRenamed("status", "http_status").withColumn("status", F.col("http_status")))
    rows = rows.withColumn("_html", F.when(F.col("verdict") == "parse", F.col("html")))
    main = _VIEW_OUTPUT[view]
    rows = derive(rows, [main, "has_script", "has_body", "has_text", "has_label"], "_html")
    wanted = needs(view, F.col("has_script"), F.col("has_body"), F.col("has_text"), F.col("has_label"))
    parsed = F.col("verdict") == "parse"
    rows = rows.withColumn("needs", F.when(F.col("verdict") == "needs", F.array(F.lit("js"))).when(parsed, wanted).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("env_status", F.when(F.col("verdict") == "error", "error").when(F.size("needs") > 0, "needs").otherwise("ok"))
    if view == "text":
        out = F.expr("substring(to_json(named_struct('v', text)), 6, length(to_json(named_struct('v', text))) - 6)")
    elif view == "dom":
        out = F.col(main)
    else:
        keep_null = {"ignoreNullFields": "false"}
        nodes = F.col("nodes")
        if view == "links":
            rows = rows.withColumn("_base", base_url(nodes, F.col("url")))
            out = F.to_json(links_of(nodes, F.col("_base")), keep_null)
        elif view == "forms":
            listed = F.transform(elements_of(nodes, "form"), lambda n: F.struct(F.coalesce(attr(n, "action"), F.lit("")).alias("action"), F.coalesce(ascii_lower(attr(n, "method")), F.lit("get")).alias("method"),
                                 F.coalesce(attr(n, "enctype"), F.lit("application/x-www-form-urlencoded")).alias("enctype"), fields_of(nodes, n).alias("fields")))
            rows = rows.withColumn("_base", base_url(nodes, F.col("url")))
            actions = resolve_all(F.col("_base"), F.transform(elements_of(nodes, "form"), lambda n: F.coalesce(attr(n, "action"), F.lit(""))))
            out = F.to_json(F.zip_with(listed, actions, lambda f, a: F.struct(a.alias("action"), f["method"].alias("method"), f["enctype"].alias("enctype"), f["fields"].alias("fields"))), keep_null)
            out = F.replace(out, F.lit(',"options":null'), F.lit(""))  # only a select has options; in texts these quotes are escaped
        else:
            rows = rows.withColumns({f"_{name}": c for name, c in meta_columns(nodes, F.col("url")).items()})
            named = lambda m: F.filter(F.array(*[F.struct(F.lit(k).alias("key"), m[f].alias("value")) for k, f in (("name", "name"), ("property", "property"), ("http-equiv", "http_equiv"), ("content", "content"))]), lambda e: e["value"].isNotNull())
            entries = F.transform(entries_of(nodes), lambda m: F.map_from_entries(named(m)))
            out = F.to_json(F.struct(F.col("_title").alias("title"), F.col("_lang").alias("lang"), F.col("_charset").alias("charset"), F.col("_canonical").alias("canonical"), entries.alias("meta")), keep_null)
    shown = F.when(F.col("env_status") == "ok", out)
    media = non_document(header_value(F.col("headers"), "content-type"))
    rows = rows.withColumns({
        "out_json": shown, "requested": F.col("url"), "final": F.when(F.col("verdict") != "error", F.col("url")).otherwise(F.when(F.col("http_status").isNotNull(), F.col("url"))),
        "message": error_message(F.col("error_kind"), F.col("http_status"), media), "http": http_block(F.col("http_status"), F.col("headers")),
        "challenge": F.when(F.col("declared").isNotNull(), F.struct(F.col("declared").alias("declared"), F.lit(0).alias("rounds"), F.lit(False).alias("passed"))),
    })
    rows = envelope(rows, view)
    return rows.select(key, F.col("env_status").alias("status"), "error_kind", "needs", "envelope")
