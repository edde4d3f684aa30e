"""Style sheets: their rules, and which pages ask for them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import css
from pagegrain.functions.urls import join_or_null, url_parse
from pagegrain.functions.vector import vectorised
from pagegrain.operators.documents import attr, base_url, elements_of
from pagegrain.operators.markup import tokens
from pagegrain.operators.responses import ascii_lower

RULES = "array<struct<selectors:array<string>,decls:array<struct<name:string,value:string,important:boolean>>>>"


@vectorised(RULES)
def parse_stylesheet(source: pd.Series) -> pd.Series:
    """The rules of style sheets."""
    return pd.Series([css.parse_stylesheet(s) for s in source])


@vectorised("boolean")
def media_matches(query: pd.Series) -> pd.Series:
    """Whether media queries match; null counts as matching."""
    return pd.Series([q is None or css.media_matches(q) for q in query], dtype=bool)


def external_hrefs(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, sheet_url): the external sheets of each page in document order. Needs ``nodes`` and ``url``.

    Empty and unjoinable addresses are left out, and local files unless the page is one.
    """
    nodes = F.col("nodes")
    sheets = F.filter(elements_of(nodes, "link"), lambda n: F.exists(tokens(attr(n, "rel")), lambda t: ascii_lower(t) == "stylesheet") & (F.length(attr(n, "href")) > 0))
    listed = F.transform(sheets, lambda n: F.struct(attr(n, "href").alias("href"), attr(n, "media").alias("media")))
    rows = df.select(*keys, "url", base_url(nodes, F.col("url")).alias("_base"), F.posexplode(listed).alias("pos", "s"))
    rows = rows.select(*keys, "pos", "url", join_or_null(F.col("_base"), F.col("s.href")).alias("sheet_url"), media_matches(F.col("s.media")).alias("_on"))
    local = url_parse(F.col("sheet_url"))["scheme"] == "file"
    return rows.filter(F.col("_on") & F.col("sheet_url").isNotNull()).filter(~local | F.col("url").startswith("file:")).select(*keys, "pos", "sheet_url")


def sheet_rules(df: DataFrame, stylesheets: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, sheet_url, rules): how many rules each page's external sheets hold. Needs ``nodes`` and ``url``.

    Only (key, position, address) meets the sheets; each distinct sheet is parsed once, and only its count is joined.
    """
    wanted = external_hrefs(df, *keys)
    once = stylesheets.join(wanted.select(F.col("sheet_url").alias("url")).distinct(), "url", "left_semi").dropDuplicates(["url"])
    counted = once.select(F.col("url").alias("sheet_url"), F.size(parse_stylesheet(F.col("css"))).alias("rules"))
    return wanted.join(counted, "sheet_url").select(*keys, "pos", "sheet_url", "rules")
