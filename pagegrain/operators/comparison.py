"""Comparing runs, crawls and extractions: aggregates, joins and ordered deltas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions.vector import vectorised
from pagegrain.operators.responses import WHITE, exit_contract_ok

STABLE = ("status", "needs", "error_kind", "http_status", "sha")
IDENTITY = (*STABLE, "elements", "text_chars")


def nearest_rank(values: Column, percent: int) -> Column:
    """The value at index (percent * (n - 1) + 50) div 100 of the sorted list; 0 for an empty one."""
    at = F.floor((F.lit(percent) * (F.size(values) - 1) + 50) / 100).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.greatest(F.lit(1), at + 1))).otherwise(F.lit(0))


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """One row a (side, url, recipe): the first run's fields, p50 and p95 of wall_ms, and whether all runs agree with the first.

    Ranks come from counts of different times, so no key's runs are gathered. Without times, both are 0.
    """
    keys = ["side", "url", "recipe"]
    first = [F.min_by(F.col(c), F.col("run_no")).alias(c) for c in runs.columns if c not in (*keys, "run_no", "wall_ms")]
    same = F.to_json(F.struct(*[F.col(c) for c in STABLE]), {"ignoreNullFields": "false"})
    out = runs.groupBy(*keys).agg(*first, (F.min(same) == F.max(same)).alias("stable"))
    times = runs.filter("wall_ms is not null").groupBy(*keys, "wall_ms").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*keys)
    times = times.withColumns({"_upto": F.sum("_n").over(every.orderBy("wall_ms")), "_all": F.sum("_n").over(every)})
    at = lambda percent: F.min(F.when(F.col("_upto") > F.floor((percent * (F.col("_all") - 1) + 50) / 100), F.col("wall_ms")))
    ranks = times.groupBy(*keys).agg(at(50).alias("p50"), at(95).alias("p95"))
    met = out.alias("a").join(ranks.alias("r"), [F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    return met.select("a.*", *[F.coalesce(f"r.{p}", F.lit(0)).alias(p) for p in ("p50", "p95")])


def ab_compare(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both sides of each (url, recipe) side by side, with parity_drift, gate_cleared and violations.

    Rows come from ``aggregate_runs`` and have class, exit, output (or none), executed.
    """
    keys = ["url", "recipe"]
    def side(df: DataFrame, name: str) -> DataFrame:
        output = F.col("output") if "output" in df.columns else F.lit("")
        contract = ~exit_contract_ok(F.col("status"), F.col("exit"), output)
        refused = (F.col("needs") == "js") | (F.col("status") == "error")
        control = (F.col("class") == "challenge") & (~F.coalesce(refused, F.lit(False)) | F.coalesce(F.col("executed"), F.lit(False)))
        kept = [c for c in df.columns if c not in (*keys, "side")]
        df = df.withColumns({"exit_contract_broken": contract, "challenge_control_broken": control})
        return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in [*kept, "exit_contract_broken", "challenge_control_broken"]])

    both = side(base, "base").join(side(candidate, "cand"), keys)
    agrees = F.lit(True)
    for c in IDENTITY:
        agrees = agrees & F.col(f"base_{c}").eqNullSafe(F.col(f"cand_{c}"))
    drift = (F.col("base_class") == "control") & ~F.col("recipe").startswith("js") & F.col("base_stable") & F.col("cand_stable") & ~agrees
    cleared = (F.col("base_class") == "soft-gate") & (F.col("base_status") != "ok") & (F.col("cand_status") == "ok")
    broken = sum(F.col(f"{s}_{w}_broken").cast("int") for s in ("base", "cand") for w in ("exit_contract", "challenge_control"))
    return both.withColumns({"parity_drift": F.coalesce(drift, F.lit(False)), "gate_cleared": F.coalesce(cleared, F.lit(False)), "violations": broken})


def ab_verdict(compared: DataFrame) -> DataFrame:
    """One row: counts of violations and drifts, whether any gate was cleared, and whether the result is null."""
    out = compared.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.count_if("parity_drift").alias("parity_drifts"), F.coalesce(F.bool_or("gate_cleared"), F.lit(False)).alias("gate_cleared"))
    return out.withColumn("null_result", ~F.col("gate_cleared"))


def probe_tally(events: DataFrame, top: int | None = None) -> DataFrame:
    """Surfaces and their counts, most frequent first, then by name; the ``top`` ones if asked."""
    out = events.groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface")
    return out if top is None else out.limit(top)


# -- TLS client fingerprints


def _without_grease(values: Column) -> Column:
    return F.filter(values, lambda v: ~((v.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(v, 12) == F.shiftright(v, 4).bitwiseAND(0xF))))


def _hex_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")), ",")


def _ja4_parts(hello: Column, by_value: bool) -> tuple[Column, Column, Column]:
    ciphers, extensions = _without_grease(hello["ciphers"]), _without_grease(hello["extensions"])
    alpn = F.coalesce(hello["alpn"], F.lit(""))
    version = F.when(hello["version"] == 0x0304, "13").when(hello["version"] == 0x0303, "12").otherwise("00")
    ends = F.when(alpn == "", F.lit("00")).otherwise(F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1)))
    two = lambda x: F.when(F.size(x) < 100, F.lpad(F.size(x).cast("string"), 2, "0")).otherwise(F.size(x).cast("string"))
    header = F.concat(F.lit("t"), version, F.when(hello["sni"], "d").otherwise("i"), two(ciphers), two(extensions), ends)
    named = F.filter(extensions, lambda v: ~v.isin(0x0000, 0x0010))
    order = F.array_sort if by_value else (lambda x: x)
    return header, _hex_list(order(ciphers)), F.concat(_hex_list(order(named)), F.lit("_"), _hex_list(_without_grease(hello["sig_algs"])))


def ja4_raw(hello: Column, by_value: bool = True) -> Column:
    """The readable fingerprint of a client hello: struct(version, sni, ciphers, extensions, sig_algs, alpn)."""
    return F.concat_ws("_", *_ja4_parts(hello, by_value))


def ja4(hello: Column) -> Column:
    """The hashed fingerprint: header, then 12 hex digits of sha256 of ciphers and of extensions."""
    header, ciphers, extensions = _ja4_parts(hello, True)
    return F.concat_ws("_", header, F.substring(F.sha2(ciphers, 256), 1, 12), F.substring(F.sha2(extensions, 256), 1, 12))


# -- Extraction against a recorded truth


def ordered_delta(a: list[str], b: list[str]) -> list[str]:
    """The lines of a longest-common-subsequence difference: ``- x`` only in a, ``+ x`` only in b; on a tie a's line goes first.

    Rows of the length table are bits of one number each (a bit is set where a length does not grow). Of n rows
    some root of n are kept, and the rows between two of them are made again on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    n, m = len(a), len(b)
    every, full = max(1, math.isqrt(n)), (1 << m) - 1
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << (m - 1 - j)

    def rows(upto: int, down_to: int, v: int) -> Iterator[tuple[int, int]]:
        """(i, row of the suffixes from a[i]) from a known row ``upto`` down to ``down_to``."""
        for i in range(upto - 1, down_to - 1, -1):
            u = v & places.get(a[i], 0)
            v = ((v + u) | (v - u)) & full
            yield i, v

    kept = {n: full} | {i: v for i, v in rows(n, 0, full) if i % every == 0}
    block: dict[int, int] = {n: full}
    common = lambda i, j: m - j - (block[i] & ((1 << (m - j)) - 1)).bit_count()
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and i + 1 not in block or i not in block:
            low = i - i % every
            top = min(n, low + every)
            block = dict(rows(top, low, kept[top])) | {top: kept[top]}
        if i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == m or (i < n and common(i + 1, j) >= common(i, j + 1)):
            out.append(f"- {a[i]}")
            i += 1
        else:
            out.append(f"+ {b[j]}")
            j += 1
    return out


@vectorised("array<string>")
def _delta(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ordered_delta([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)])


def deltas(df: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ("fixture", "channel")) -> DataFrame:
    """A row for each line of the ordered delta of two line arrays, with its position."""
    return df.select(*keys, F.posexplode(_delta(F.col(a), F.col(b))).alias("pos", "delta"))


def undisposed(actual: DataFrame, declared: DataFrame, keys: tuple[str, ...] = ("fixture", "channel")) -> DataFrame:
    """Multiset difference both ways: deltas that are not declared, and declared ones that are gone."""
    columns = [*keys, "delta"]
    more = actual.select(*columns).exceptAll(declared.select(*columns)).withColumn("problem", F.lit("undeclared"))
    return more.unionByName(declared.select(*columns).exceptAll(actual.select(*columns)).withColumn("problem", F.lit("gone")))


def capture_check(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """(fixture, problem) of pages (fixture, body) and captures (fixture, bytes map<file, sha256>, file, date): unpaired, changed or incomplete."""
    p = pages.select("fixture", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), F.lit(True).alias("p"))
    both = p.join(captures.withColumn("c", F.lit(True)), "fixture", "full_outer")
    problem = F.when(F.col("c").isNull(), "no capture").when(F.col("p").isNull(), "no page").when(F.coalesce(F.col("date"), F.lit("")) == "", "incomplete stamp").when(
        ~F.coalesce(F.try_element_at("bytes", F.col("file")) == F.col("sha"), F.lit(False)), "bytes changed"
    )
    return both.select("fixture", problem.alias("problem")).filter("problem is not null")


def project_text(text: Column) -> Column:
    """The tokens of a text."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda t: t != "")


def _quoted(col: Column) -> Column:
    escaped = F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def reference(href: Column, page: Column) -> Column:
    """href relative to the page's folder, else to its origin, else as it is."""
    folder = F.regexp_extract(page, r"^(.*/)", 1)
    origin = F.regexp_extract(page, r"^([^:]+://[^/]*)", 1)
    return F.when(href.startswith(folder), F.substring(href, F.length(folder) + 1, F.length(href))).when(href.startswith(origin), F.substring(href, F.length(origin) + 1, F.length(href))).otherwise(href)


def project_links(links: Column, page: Column) -> Column:
    """A line for each a and area: its reference and its quoted text. ``links``: array of struct(kind, href, text)."""
    anchors = F.filter(links, lambda x: x["kind"] != "link")
    return F.transform(anchors, lambda x: F.concat(reference(x["href"], page), F.lit(" "), _quoted(F.array_join(project_text(F.coalesce(x["text"], F.lit(""))), " "))))


def project_forms(forms: Column, page: Column) -> Column:
    """A line for each form and each of its fields. ``forms``: array of struct(action, method, fields[struct(tag, type, name)])."""
    field = lambda e: F.concat(
        F.lit("  "), e["tag"], F.lit(" type="), _quoted(F.when(e["tag"].isin("input", "button"), e["type"])), F.lit(" name="), _quoted(e["name"])
    )
    one = lambda f: F.concat(F.array(F.concat(F.lit("form "), reference(f["action"], page), F.lit(" "), f["method"])), F.transform(f["fields"], field))
    return F.flatten(F.transform(forms, one))


def project_boxes(boxes: Column) -> Column:
    """``i tag`` of each box in source order. ``boxes``: array of struct(i, tag)."""
    return F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(b["i"], b["tag"]))), lambda b: F.concat(b["i"].cast("string"), F.lit(" "), b["tag"]))
