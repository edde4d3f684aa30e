"""Whole jobs: a saved crawl to envelopes, links by host, an A/B comparison, a disclosure report, navigations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.operators import comparison, disclosure
from pagegrain.operators.documents import parse_pages
from pagegrain.operators.navigation import redirect_target, refresh_target, resolve_navigations
from pagegrain.operators.views import impressions, links


def crawl_to_envelopes(responses: DataFrame, view: str, key: str = "page_id") -> DataFrame:
    """Disposition, parse, needs, view, envelope: all narrow."""
    return impressions(responses, view, key)


def links_by_host(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Links counted by target host and kind, the flagship roll-up: only (host, kind) counts are shuffled."""
    found = links(parse_pages(pages), key)
    host = F.lower(F.regexp_extract("href", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return found.groupBy(host.alias("host"), "kind").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_hrefs"))


def compare_crawls(runs: DataFrame) -> DataFrame:
    """Both sides of a run table, aggregated once on (side, url, recipe), then joined on (url, recipe)."""
    agg = comparison.aggregate_runs(runs)
    return comparison.ab_compare(agg.filter("side = 'base'"), agg.filter("side = 'candidate'"))


def disclosure_report(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return disclosure.leak_summary(disclosure.leak_findings(df, id_column, text_column))


def follow(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """Navigations through recorded responses (url, status, headers, html): redirects and zero-delay refreshes on one budget."""
    rows = parse_pages(responses)
    moved = redirect_target(F.col("status"), F.col("headers"), F.col("url"))
    rows = rows.withColumn("_moved", moved).withColumn("_refresh", refresh_target(F.col("nodes"), F.col("url"), F.col("headers")))
    return resolve_navigations(seeds, rows.select("url", F.coalesce("_moved.next", "_refresh").alias("next"), F.col("_moved.error").alias("error")))
