"""Pages to nodes, and what built-in expressions read off the ``nodes`` column.

``parse_pages`` is the one pass over html. ``nodes`` is an array in preorder, with a node's id as its place:
the descendants of n are the nodes with n.id < id <= n.last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.functions.page import NodeColumns
from pagegrain.functions.urls import resolve
from pagegrain.operators.responses import ascii_lower, trim_white

NODES = (
    "array<struct<id:int,parent:int,last:int,depth:int,ord:int,kind:string,name:string,attrs:array<struct<name:string,value:string>>,text:string,"
    "unpainted:boolean,concealed:boolean,shown:boolean,pre:boolean,content:boolean,sectioned:boolean>>"
)
_PAGES = 256


def _lists(values: pa.Array, counts: list[int | None]) -> pa.ListArray:
    """Lists of these lengths over values that lie side by side; null for a null length."""
    none = np.array([n is None for n in counts], bool)
    ends = np.concatenate(([0], np.cumsum(np.array([n or 0 for n in counts], np.int32)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(none))


def _node_lists(pages: NodeColumns) -> pa.ListArray:
    """The ``nodes`` column of parsed pages."""
    strings = lambda c: pa.array(c, pa.string())
    attrs = _lists(pa.StructArray.from_arrays([strings(pages.attr_names), strings(pages.attr_values)], ["name", "value"]), pages.attr_counts)
    made = {c: pa.array(getattr(pages, c), pa.int32()) for c in NodeColumns.INTS} | {"kind": strings(pages.kind), "name": strings(pages.name), "attrs": attrs, "text": strings(pages.text)}
    made |= {c: pa.array(getattr(pages, c), pa.bool_()) for c in NodeColumns.FLAGS}
    return pa.ListArray.from_arrays(pa.array(pages.ends, pa.int32()), pa.StructArray.from_arrays(list(made.values()), list(made)))


def parse_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``nodes``: each page parsed once. A null html is an empty page. Narrow: one Arrow step, no shuffle."""
    df = df.drop("nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAGES):
                batch, pages = whole.slice(at, _PAGES), NodeColumns()
                for text in batch.column(html).to_pylist():
                    pages.add(text)
                yield pa.RecordBatch.from_arrays([*batch.columns, _node_lists(pages)], [*batch.schema.names, "nodes"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("nodes", T._parse_datatype_string(NODES))]))


def explode_nodes(df: DataFrame, *keys: str) -> DataFrame:
    """A row a node."""
    return df.select(*keys, F.inline("nodes"))


def elements_of(nodes: Column, *tags: str) -> Column:
    """The elements with these tags, in document order."""
    return F.filter(nodes, lambda n: (n["kind"] == "element") & n["name"].isin(*tags))


def elements(df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """A row for each element with this tag, in document order by ``id``."""
    return df.select(*keys, F.inline(elements_of(F.col("nodes"), tag)))


def attr(node: Column, name: str) -> Column:
    """An attribute's value, or null."""
    return F.try_element_at(F.filter(node["attrs"], lambda a: a["name"] == name), F.lit(1))["value"]


def below(nodes: Column, node: Column) -> Column:
    """The strict descendants of a node: the run of nodes behind it."""
    return F.slice(nodes, node["id"] + 2, node["last"] - node["id"])


def text_content(nodes: Column, node: Column) -> Column:
    """All text below a node; a comment's or text's own data."""
    parts = F.filter(below(nodes, node), lambda n: n["kind"] == "text")
    return F.when(node["kind"].isin("text", "comment"), node["text"]).otherwise(F.array_join(F.transform(parts, lambda n: n["text"]), ""))


def dom_stats(df: DataFrame, payload: str, *keys: str) -> DataFrame:
    """elements, text_chars (UTF-8 bytes of texts), bytes and sha of the payload."""
    text = F.filter("nodes", lambda n: n["kind"] == "text")
    return df.select(
        *keys, F.size(F.filter("nodes", lambda n: n["kind"] == "element")).cast("long").alias("elements"),
        F.aggregate(text, F.lit(0).cast("long"), lambda a, n: a + F.octet_length(n["text"])).alias("text_chars"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("sha"),
    )


def base_url(nodes: Column, page_url: Column) -> Column:
    """The page's url joined with the first base element that has an href; the page's url if joining fails; null if that does not parse."""
    from pagegrain.functions.urls import join_or_null, url_parse

    bases = F.filter(F.transform(elements_of(nodes, "base"), lambda n: attr(n, "href")), lambda h: h.isNotNull())
    own = url_parse(page_url)["href"]
    return F.when(F.size(bases) > 0, F.coalesce(join_or_null(page_url, F.try_element_at(bases, F.lit(1))), own)).otherwise(own)


def page_scripts(df: DataFrame, *keys: str) -> DataFrame:
    """The scripts in document order: (keys, pos, kind inline/external/skip, module, src, body). Needs ``nodes`` and ``url``."""
    nodes = F.col("nodes")
    clean = lambda n: ascii_lower(trim_white(attr(n, "type")))
    known = lambda n: attr(n, "type").isNull() | clean(n).isin("", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "text/jscript")
    one = F.transform(elements_of(nodes, "script"), lambda n: F.struct(
        F.when(attr(n, "nomodule").isNotNull() | ~known(n), "skip").when(F.length(attr(n, "src")) > 0, "external").otherwise("inline").alias("kind"),
        F.coalesce(clean(n) == "module", F.lit(False)).alias("module"), attr(n, "src").alias("src"), text_content(nodes, n).alias("body")))
    rows = df.select(*keys, base_url(nodes, F.col("url")).alias("_base"), F.posexplode(one).alias("pos", "s"))
    return rows.select(*keys, "pos", "s.kind", F.when(F.col("s.kind") != "skip", F.col("s.module")).alias("module"), F.when(F.col("s.kind") == "external", resolve(F.col("_base"), F.col("s.src"))).alias("src"), F.when(F.col("s.kind") == "inline", F.col("s.body")).alias("body"))
