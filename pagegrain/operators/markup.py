"""What a page reads as, built from ``nodes`` with expressions: text, nested JSON, markup, and selectors.

A nested form is a list of pieces sorted by place: what opens a node stands at its id, what closes it right
behind its last descendant, deeper nodes first. So depth is no limit and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.html import RAW, VOID
from pagegrain.functions.page import BLOCK, WHITE
from pagegrain.operators.documents import below
from pagegrain.operators.responses import WHITE as WHITE_CLASS
from pagegrain.operators.structure import selected_ids

# Code points that no text holds: a line break to be, and white space that stays as it is.
_BREAK = "\ufdd0"
_KEPT = "".join(chr(0xFDD1 + k) for k in range(len(WHITE)))
_KEPT_LINE = _KEPT[WHITE.index("\n")]


def tokens(col: Column) -> Column:
    """The white-space separated tokens of an attribute; none for null."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), f"[{WHITE_CLASS}]+"), lambda t: t != "")


def _pieces(nodes: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column]) -> Column:
    """What opens and closes each node, in order, as one string; null is nothing."""
    at = lambda place, depth, s: F.struct(place.cast("double").alias("place"), (-depth).alias("depth"), s.alias("s"))
    both = F.transform(nodes, lambda n: F.array(at(n["id"], F.lit(0), opens(n)), at(n["last"] + 0.5, n["depth"], closes(n))))
    return F.array_join(F.transform(F.array_sort(F.filter(F.flatten(both), lambda x: x["s"].isNotNull())), lambda x: x["s"]), "")


def text_of(nodes: Column) -> Column:
    """The page's text in source order: white space collapsed, blocks on lines of their own, pre as it stands."""
    is_text = lambda n: n["kind"] == "text"
    edge = lambda n: F.when(n["name"].isin(*BLOCK) & ~n["pre"], F.lit(_BREAK))
    opens = lambda n: F.when(is_text(n), F.when(n["pre"], F.translate(n["text"], WHITE, _KEPT)).otherwise(n["text"])).when(n["name"] == "br", F.when(n["pre"], F.lit(_KEPT_LINE)).otherwise(F.lit(_BREAK))).otherwise(edge(n))
    told = _pieces(F.filter(nodes, lambda n: n["shown"] & n["kind"].isin("text", "element")), opens, lambda n: F.when(n["name"] != "br", edge(n)))
    told = F.regexp_replace(told, f"[{WHITE_CLASS}]+", " ")
    told = F.regexp_replace(F.regexp_replace(told, f" ?{_BREAK}[ {_BREAK}]*", "\n"), "^[ \n]+", "")
    told = F.translate(F.replace(told, F.lit(f"{_KEPT_LINE}\n"), F.lit(_KEPT_LINE)), _KEPT, WHITE)
    return F.regexp_replace(told, "[ \n]+$", "")


def signals_of(nodes: Column) -> tuple[Column, Column]:
    """(has text, has label) of the first body, less page chrome and what does not render."""
    says = lambda s: F.regexp_replace(s, f"[{WHITE_CLASS}]+", "") != ""
    text = F.exists(nodes, lambda n: n["content"] & (n["kind"] == "text") & says(n["text"]))
    label = F.exists(nodes, lambda n: n["content"] & (n["kind"] == "element") & F.exists(n["attrs"], lambda a: a["name"].isin("alt", "aria-label") & says(a["value"])))
    return F.coalesce(text, F.lit(False)), F.coalesce(label, F.lit(False))


def _json(s: Column) -> Column:
    made = F.to_json(F.struct(s.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(made, F.lit(6), F.length(made) - 6)


def dom_of(nodes: Column) -> Column:
    """The nested JSON of the tree."""
    comma = lambda n: F.when(n["id"] == n["parent"] + 1, "").otherwise(",")
    attrs = lambda n: F.to_json(F.map_from_entries(F.transform(n["attrs"], lambda a: F.struct(a["name"], a["value"]))))
    opens = lambda n: F.concat(comma(n), F.when(n["kind"] == "element", F.concat(F.lit('{"type":"element","name":'), _json(n["name"]), F.lit(',"attrs":'), attrs(n), F.lit(',"children":['))).when(n["kind"] == "doctype", '{"type":"doctype"}').otherwise(F.concat(F.lit('{"type":"'), n["kind"], F.lit('","value":'), _json(n["text"]), F.lit("}"))))
    return F.concat(F.lit("["), _pieces(nodes, opens, lambda n: F.when(n["kind"] == "element", F.lit("]}"))), F.lit("]"))


def _escaped(s: Column) -> Column:
    for c, to in (("&", "&amp;"), ("\xa0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(c), F.lit(to))
    return s


def _markup(nodes: Column, part: Column) -> Column:
    raw = lambda n: F.coalesce(F.get(nodes, n["parent"])["name"].isin(*RAW, "plaintext"), F.lit(False))
    attrs = lambda n: F.array_join(F.transform(n["attrs"], lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), F.replace(_escaped(a["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    opens = lambda n: F.when(n["kind"] == "element", F.concat(F.lit("<"), n["name"], attrs(n), F.lit(">"))).when(n["kind"] == "comment", F.concat(F.lit("<!--"), n["text"], F.lit("-->"))).when(n["kind"] == "text", F.when(raw(n), n["text"]).otherwise(_escaped(n["text"])))
    return _pieces(part, opens, lambda n: F.when((n["kind"] == "element") & ~n["name"].isin(*VOID), F.concat(F.lit("</"), n["name"], F.lit(">"))))


def outer_html(nodes: Column, node: Column) -> Column:
    return _markup(nodes, F.slice(nodes, node["id"] + 1, node["last"] - node["id"] + 1))


def inner_html(nodes: Column, node: Column) -> Column:
    return _markup(nodes, below(nodes, node))


def selected(nodes: Column, selectors: str, scope: str | None = None) -> Column:
    """The elements that match, in document order; with ``scope``, strict descendants of the first element that matches it."""
    return F.transform(selected_ids(nodes, selectors, scope), lambda i: F.get(nodes, i))


def select(df: DataFrame, selectors: str, *keys: str, scope: str | None = None) -> DataFrame:
    """A row (keys, id, name, outer_html, inner_html) for each element that matches. Needs ``nodes``.

    An unsupported selector raises ValueError.
    """
    nodes = F.col("nodes")
    # Markup is made before the array is taken apart: a row of its own would carry a copy of all nodes.
    told = lambda n: F.struct(n["id"].alias("id"), n["name"].alias("name"), outer_html(nodes, n).alias("outer_html"), inner_html(nodes, n).alias("inner_html"))
    return df.select(*keys, F.inline(F.transform(selected(nodes, selectors, scope), told)))


#: What ``derive`` can return.
OUTPUTS = ("nodes", "text", "has_text", "has_label", "has_script", "has_body", "dom")


def derive(df: DataFrame, outputs: list[str], html: str = "html") -> DataFrame:
    """``df`` with the asked ``OUTPUTS``, from one parse of each page."""
    from pagegrain.operators.documents import parse_pages

    unknown = [o for o in outputs if o not in OUTPUTS]
    if unknown:
        raise ValueError(f"unknown outputs: {unknown}")
    df, nodes = parse_pages(df.drop(*outputs), html), F.col("nodes")
    has_text, has_label = signals_of(nodes)
    made = {
        "text": text_of(nodes), "has_text": has_text, "has_label": has_label, "dom": dom_of(nodes),
        "has_script": F.exists(nodes, lambda n: n["name"] == "script"), "has_body": F.exists(nodes, lambda n: n["name"] == "body"),
    }
    out = df.withColumns({o: F.coalesce(made[o], F.lit(False)) if o.startswith("has_") else made[o] for o in outputs if o != "nodes"})
    return out if "nodes" in outputs else out.drop("nodes")
