"""Navigations over crawl tables: redirects, refreshes, challenges, frozen resources and cookies."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.functions.urls import join_or_null, parse_url, registrable_domain, same_origin, url_parse
from pagegrain.functions.vector import vectorised
from pagegrain.operators.documents import attr, base_url, elements_of
from pagegrain.operators.responses import ascii_lower, cache_reusable, challenge, header_lines, header_value
from pagegrain.storage import stash

MAX_REQUESTS = 10
_WS = " \t\n\f\r"
_REFRESH = re.compile(r"[ \t\n\f\r]*(?:([0-9]+)|(?=\.))[0-9.]*(?:$|(?=[;, \t\n\f\r])[ \t\n\f\r]*[;,]?[ \t\n\f\r]*(.*)$)", re.S)
_LABEL = re.compile(r"url[ \t\n\f\r]*=[ \t\n\f\r]*(.*)$", re.S | re.I)


# -- refreshes and redirects


def parse_refresh(content: str) -> tuple[bool, str | None] | None:
    """(whether the delay is zero, the reference if any), or None if the value is no refresh."""
    m = _REFRESH.match(content)
    if not m:
        return None
    immediate, tail = not (m[1] or "").strip("0"), m[2]
    if not tail:
        return immediate, None
    labelled = _LABEL.match(tail)
    reference = labelled[1] if labelled else tail
    if reference[:1] in ("'", '"') and reference:
        reference = reference[1:].split(reference[0])[0]
    return immediate, reference


def refresh_of(page_url: str | None, header: str | None, base: str | None, contents: list[str]) -> str | None:
    page, against = parse_url(page_url), parse_url(base)
    if page is None or against is None:
        return None
    for content, anchor in [*([(header, page)] if header is not None else []), *((c, against) for c in contents)]:
        parsed = parse_refresh(content)
        if parsed is None:
            continue
        to = page if parsed[1] is None else parse_url(parsed[1], anchor)
        if to is None:
            continue
        loads = to.scheme in ("http", "https") or to.scheme == "file" and page.scheme == "file"
        scroll = to.fragment is not None and str(replace(to, fragment=None)) == str(replace(page, fragment=None))
        return str(to) if parsed[0] and loads and not scroll else None
    return None


@vectorised("string")
def _refresh(page_url: pd.Series, header: pd.Series, base: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([refresh_of(p, h, b, [] if c is None else list(c)) for p, h, b, c in zip(page_url, header, base, contents, strict=True)], dtype=object)


def refresh_target(nodes: Column, page_url: Column, headers: Column) -> Column:
    """The address a page goes to at once: the header first, then metas in order; the first that parses and joins decides."""
    metas = F.filter(elements_of(nodes, "meta"), lambda n: (ascii_lower(attr(n, "http-equiv")) == "refresh") & attr(n, "content").isNotNull())
    return _refresh(page_url, header_lines(headers, "refresh"), base_url(nodes, page_url), F.transform(metas, lambda n: attr(n, "content")))


def redirect_target(status: Column, headers: Column, url: Column) -> Column:
    """struct(next, error): the joined Location of a redirect; ``fetch.redirect`` if it is missing or bad; nulls otherwise."""
    moved = status.isin(301, 302, 303, 307, 308)
    to = join_or_null(url, header_value(headers, "location"))
    return F.struct(F.when(moved, to).alias("next"), F.when(moved & to.isNull(), F.lit("fetch.redirect")).alias("error"))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def resolve_navigations(seeds: DataFrame, responses: DataFrame, max_requests: int = MAX_REQUESTS) -> DataFrame:
    """(nav_id, url, final_url, hops, error): seeds (nav_id, url) followed through responses (url, next, error).

    ``next`` is a response's redirect or zero-delay refresh target, null where it stays. All requests of a navigation
    share one budget, so a loop ends with ``fetch.redirect``; an address without a response ends with ``fetch.missing``.
    Of several responses of an address the least counts (by ``seq`` if there is one, then by next and error).
    Paths of 1, 2, 4, 8 steps are made by joining a path's end with the paths that begin there.
    """
    at = lambda c: without_fragment(F.col(c)).alias("at")
    order = [c for c in ("seq",) if c in responses.columns]
    table = responses.groupBy(at("url")).agg(F.min(F.struct(*order, "next", "error")).alias("x")).select("at", "x.next", "x.error")
    stays = F.col("next").isNull() | F.col("error").isNotNull()
    step = table.select("at", F.when(stays, F.array().cast("array<string>")).otherwise(F.array("next")).alias("path"))
    end = lambda path: without_fragment(F.element_at(path, -1))
    none = F.array().cast("array<string>")

    walks, left, length = seeds.select("nav_id", "url", F.array("url").alias("hops")), max_requests - 1, 1
    while left:
        if left & length:
            met = walks.alias("w").join(step.alias("s"), end(F.col("w.hops")) == F.col("s.at"), "left")
            walks = met.select("w.nav_id", "w.url", F.concat("w.hops", F.coalesce("s.path", none)).alias("hops"))
            left -= length
        if left:
            far = step.select(F.col("at").alias("to"), F.col("path").alias("more"))
            step = step.join(far, (F.size("path") == length) & (F.when(F.size("path") > 0, end(F.col("path"))) == F.col("to")), "left")
            step, length = step.select("at", F.concat("path", F.coalesce("more", none)).alias("path")), length * 2
    met = walks.alias("w").join(table.alias("t"), end(F.col("w.hops")) == F.col("t.at"), "left")
    error = F.when(F.col("t.at").isNull(), "fetch.missing").when(F.col("t.error").isNotNull(), F.col("t.error")).when(F.col("t.next").isNotNull(), "fetch.redirect")
    return met.select("w.nav_id", "w.url", F.when(error.isNull(), F.element_at("w.hops", -1)).alias("final_url"), "w.hops", error.alias("error"))


# -- challenges


def challenge_outcome(attempts: DataFrame) -> DataFrame:
    """(nav_id, declared, rounds, passed, verdict) of navigations that met a challenge.

    attempts: (nav_id, attempt, status, headers, failed). ``passed``: the last later response is no challenge and no failure.
    """
    failed = F.coalesce(F.col("failed"), F.lit(False))
    rows = attempts.select("nav_id", "attempt", F.when(~failed, challenge(F.col("status"), F.col("headers"))).alias("declared"), failed.alias("failed"))
    last = F.max(F.struct("attempt", (F.col("declared").isNull() & ~F.col("failed")).alias("clear"), F.col("declared").isNotNull().alias("again")))
    first = F.min(F.when(F.col("declared").isNotNull(), F.struct("attempt", "declared")))
    out = rows.groupBy("nav_id").agg(first.alias("f"), last.alias("l")).filter("f is not null")
    later = F.col("l.attempt") > F.col("f.attempt")
    verdict = F.when(~later, "js").when(F.col("l.again"), "human")
    return out.select("nav_id", F.col("f.declared").alias("declared"), later.cast("int").alias("rounds"), (later & F.col("l.clear")).alias("passed"), verdict.alias("verdict"))


# -- resources


def frozen_resources(requests: DataFrame) -> DataFrame:
    """``requests`` with ``served_by``: the seq of the response that serves each one.

    requests: (session, seq, url, headers, navigation). A request is served by the earliest earlier response to its address
    that may be reused, else by its own; navigations are never cached. The earliest before any request is the earliest of all or none,
    so a least number for each session and address, pre-aggregated, is joined to the requests: no key's rows are put in order in one task,
    and a key of many rows is an ordinary join's, which adaptive execution splits.
    """
    reusable = F.when(~F.col("navigation") & cache_reusable(F.col("headers")), F.col("seq"))
    first = requests.select(F.col("session").alias("_s"), F.col("url").alias("_u"), reusable.alias("_q")).groupBy("_s", "_u").agg(F.min("_q").alias("_first")).filter("_first is not null")
    met = requests.drop("served_by").join(first, F.col("session").eqNullSafe(F.col("_s")) & F.col("url").eqNullSafe(F.col("_u")), "left")
    return met.withColumn("served_by", F.when(~F.col("navigation") & (F.col("_first") < F.col("seq")), F.col("_first")).otherwise(F.col("seq"))).drop("_s", "_u", "_first")


# -- cookies

COOKIE = "name string, value string, domain string, host_only boolean, path string, secure boolean, http_only boolean, same_site string, expires long"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def http_date(s: str) -> int | None:
    """Seconds since the epoch of ``[weekday,] day month year h:m:s``."""
    tokens = s.partition(",")[2].split() if "," in s else s.split()
    if len(tokens) < 4 or tokens[1].lower() not in _MONTHS:
        return None
    try:
        h, m, sec = (int(x) for x in tokens[3].split(":"))
        total = calendar.timegm((int(tokens[2]), _MONTHS.index(tokens[1].lower()) + 1, 1, h, m, sec)) + 86_400 * (int(tokens[0]) - 1)
    except (ValueError, OverflowError):
        return None
    return total if total >= 0 else None


def domain_matches(host: str, domain: str) -> bool:
    return host == domain or host.endswith(f".{domain}")


def parse_cookie(line: str | None, url: str | None, now: float | None, script: bool) -> tuple | None:
    """The cookie that a Set-Cookie line (or a script's write) makes for a request address, or None if it is refused."""
    u = parse_url(url)
    if line is None or u is None or not u.host:
        return None
    head, _, rest = line.partition(";")
    name, equals, value = head.partition("=")
    name, value = name.strip(), value.strip()
    if not equals or not name:
        return None
    domain, host_only, secure, http_only, same_site = u.host, True, False, False, "lax"
    path = u.pathname[: u.pathname.rfind("/")] or "/"
    max_age = expires = None
    for part in rest.split(";"):
        key, _, v = part.partition("=")
        key, v = key.strip().lower(), v.strip()
        if key == "path" and v.startswith("/"):
            path = v
        elif key == "domain" and v:
            domain, host_only = v.lstrip(".").lower(), False
            if not domain_matches(u.host, domain):
                return None
        elif key == "secure":
            secure = True
        elif key == "httponly":
            http_only = True
        elif key == "samesite":
            same_site = v.lower() if v.lower() in ("strict", "none") else "lax"
        elif key == "max-age":
            max_age = int(v) if re.fullmatch(r"[+-]?[0-9]{1,18}", v) else None
        elif key == "expires":
            expires = http_date(v)
    if max_age is not None:
        expires = int(now or 0) + max_age if max_age > 0 else 0
    return name, value, domain, host_only, path, secure, http_only and not script, same_site, expires


@vectorised(COOKIE)
def parse_set_cookie(line: pd.Series, url: pd.Series, now: pd.Series, script: pd.Series) -> pd.DataFrame:
    """struct of each line's cookie (``expires`` in seconds since the epoch, null for a session); all null if refused."""
    rows = [parse_cookie(x, u, None if pd.isna(t) else t, bool(s)) or (None,) * 9 for x, u, t, s in zip(line, url, now, script, strict=True)]
    out = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in COOKIE.split(",")])
    out["expires"] = out["expires"].astype("Int64")
    return out


_IDENTITY = ("session", "name", "domain", "path")


def cookie_writes(events: DataFrame) -> DataFrame:
    """Accepted writes of set-cookie events (session, seq, ts, url, line, from_script), each with whether it deletes."""
    made = parse_set_cookie(F.col("line"), F.col("url"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), F.coalesce(F.col("from_script"), F.lit(False)))
    rows = events.select("session", "seq", "ts", made.alias("c")).filter("c.name is not null").select("session", "seq", "ts", "c.*")
    return rows.withColumn("deletes", F.coalesce(F.col("expires") <= F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(False)))


def cookie_jar(events: DataFrame) -> DataFrame:
    """The final cookies of each session: the last write of each (name, domain, path), unless it deletes; ``created`` orders them."""
    fields = ("value", "host_only", "secure", "http_only", "same_site", "expires", "ts", "deletes")
    last = cookie_writes(events).groupBy(*_IDENTITY).agg(F.max(F.struct("seq", *fields)).alias("x"))
    return last.filter("not x.deletes").select(*_IDENTITY, F.col("x.seq").alias("created"), *[f"x.{c}" for c in fields if c != "deletes"])


@vectorised("string")
def _site_key(domain: pd.Series) -> pd.Series:
    """The registrable domain of a cookie's domain; an address is itself."""
    out = []
    for d in domain:
        u = parse_url(f"http://{d}/") if d is not None else None
        out.append(d if u is None else registrable_domain(u))
    return pd.Series(out, dtype=object)


_COOKIE = ("name", "value", "domain", "host_only", "path", "secure", "same_site", "created")
#: A session of more rows than this is cut into ranges of its numbers, ``RANGES`` at most.
RANGE_ROWS, RANGES = 200_000, 256
_HELD = 100_000
_HOT_SESSIONS = 50_000


def _stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cookies that stand at each request; rows come sorted by (session, site, range, seq), requests before writes.

    Cookies are known by their places in a pool: this batch's, behind those that stood at its begin.
    """
    group, standing, known = None, {}, None
    for batch in batches:
        cookies, requests = batch.column("cookie"), batch.column("request")
        pool = cookies if known is None else pa.concat_arrays([known, cookies])
        first = len(pool) - len(cookies)
        keep, counts, flat = [], [0], []

        def told() -> pa.RecordBatch:
            standing = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pool.take(pa.array(flat, pa.int64())))
            return pa.RecordBatch.from_arrays([requests.take(pa.array(keep, pa.int64())), standing], ["request", "standing"])

        columns = (batch.column(c).to_pylist() for c in ("session", "site", "range", "write", "identity", "deletes"))
        for k, (session, site, part, write, identity, deletes) in enumerate(zip(*columns, strict=True)):
            if (session, site, part) != group:
                group, standing = (session, site, part), {}
            if not write:
                keep.append(k)
                counts.append(len(standing))
                flat.extend(standing.values())
                if len(flat) >= _HELD:
                    yield told()
                    keep, counts, flat = [], [0], []
                continue
            standing.pop(identity, None)
            if not deletes:
                standing[identity] = first + k
        yield told()
        known = pool.take(pa.array(list(standing.values()), pa.int64()))
        standing = {identity: k for k, identity in enumerate(standing)}


def _cuts(requests: DataFrame, events: DataFrame, range_rows: int) -> DataFrame | None:
    """(_session, cuts, ranges): where the numbers of each session with over ``range_rows`` rows are cut; None if there is none."""
    both = requests.select("session", F.col("seq").cast("double").alias("seq")).unionByName(events.select("session", F.col("seq").cast("double").alias("seq")))
    sizes = both.groupBy("session").agg(F.count("*").alias("n")).filter(F.col("n") > range_rows)
    hot = stash(sizes.withColumnRenamed("session", "_session"), "hot_sessions")
    n = hot.count()
    if not n:
        return None
    fractions = [k / RANGES for k in range(1, RANGES)]
    found = both.join(hot, F.col("session").eqNullSafe(F.col("_session"))).groupBy("_session", "n").agg(F.percentile_approx("seq", fractions, 10_000).alias("cuts"))
    ranges = F.least(F.lit(RANGES), F.ceil(F.col("n") / range_rows)).cast("int")
    found = stash(found.select("_session", "cuts", ranges.alias("ranges")), "cuts")
    # A row holds some 2 KB of cuts.
    return F.broadcast(found) if n <= _HOT_SESSIONS // 10 else found


def _ranged(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """``rows`` with the range of their session's numbers that they are in, and how many ranges it has."""
    if cuts is None:
        return rows.withColumns({"range": F.lit(0), "ranges": F.lit(1)})
    at = F.size(F.filter("cuts", lambda c: c < F.col("seq"))) * F.col("ranges")
    rows = rows.join(cuts, F.col("session").eqNullSafe(F.col("_session")), "left")
    return rows.withColumns({"range": F.coalesce(F.floor(at / RANGES).cast("int"), F.lit(0)), "ranges": F.coalesce("ranges", F.lit(1))}).drop("_session", "cuts")


def _carried(writes: DataFrame) -> DataFrame:
    """The cookies that stand where a range begins, as writes before all others of the range."""
    last = writes.filter("ranges > 1").groupBy("session", "site", "identity", "ranges", "range").agg(F.max(F.struct("seq", "cookie", "deletes")).alias("x"))
    later = F.coalesce(F.lead("range").over(Window.partitionBy("session", "site", "identity").orderBy("range")), F.col("ranges") - 1)
    last = last.withColumn("until", later).filter("not x.deletes and until > range")
    return last.select("session", "site", F.explode(F.sequence(F.col("range") + 1, F.col("until"))).alias("range"), F.lit(None).cast(writes.schema["seq"].dataType).alias("seq"), "identity", F.col("x.cookie").alias("cookie"), F.lit(False).alias("deletes"))


def _passed(asked: DataFrame, writes: DataFrame) -> DataFrame:
    """(request, standing) of requests (session, site, seq, range, request) among ``writes``."""
    writes = writes.select("session", "site", "range", "seq", "identity", "cookie", "deletes").unionByName(_carried(writes)) if "ranges" in writes.columns else writes
    asked = asked.select("session", "site", "range", "seq", "request", F.lit(False).alias("write"))
    rows = asked.unionByName(writes.withColumn("write", F.lit(True)), allowMissingColumns=True).select("session", "site", "range", "seq", "write", "request", "identity", "cookie", "deletes")
    rows = rows.repartition("session", "site", "range").sortWithinPartitions("session", "site", "range", "seq", "write", "cookie")
    schema = T.StructType([T.StructField("request", rows.schema["request"].dataType), T.StructField("standing", T.ArrayType(rows.schema["cookie"].dataType))])
    return rows.mapInArrow(_stand, schema)


def cookie_header(requests: DataFrame, events: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``requests`` with ``cookie``: the header of each, from cookies written before it; null if none applies.

    requests: (request_id, session, seq, target, referrer, intent) and any others. Writes and requests of a session and registrable
    domain are passed once in order, with the cookies that stand at each point; a write at a request's own seq comes after it. A session of over
    ``range_rows`` rows is cut into ranges of seq, each of which begins with what the writes before it leave, and is as many tasks' work.
    A null session is one of its own. Domains of a single label match hosts of any registrable domain: they are passed by the last label, and only requests that can meet one.
    """
    kept = [c for c in requests.columns if c != "cookie"]
    context = F.coalesce("referrer", "target")
    t, c = url_parse(F.col("target")), url_parse(context)
    parts = requests.select(
        F.struct(*kept).alias("own"), "session", "seq", "intent", t["host"].alias("host"), t["scheme"].alias("scheme"), t["path"].alias("req_path"), t["registrable"].alias("site"),
        F.coalesce(t["registrable"] == c["registrable"], F.lit(False)).alias("same_site_request"), same_origin(context, F.col("target")).alias("same_origin_request"),
    )
    cuts = _cuts(requests, events, range_rows)
    writes = cookie_writes(events).withColumns({"site": _site_key(F.col("domain")), "created": F.col("seq").cast("long"), "single": ~F.col("domain").contains(".") & ~F.col("host_only")})
    identity = F.concat_ws("\0", "name", "domain", "path").alias("identity")
    said = _ranged(writes.select("session", "site", "seq", "single", identity, F.struct(*_COOKIE).alias("cookie"), "deletes"), cuts)
    if cuts is None:
        said = said.drop("ranges")
    request = F.struct("own", "intent", "host", "scheme", "req_path", "same_site_request", "same_origin_request")
    asked = _ranged(parts.select("session", "site", "seq", request.alias("request")), cuts)
    # An address without a host meets no cookie; such rows are dealt evenly.
    asked = asked.withColumn("range", F.when(F.col("site").isNull(), F.pmod(F.xxhash64("request"), F.lit(RANGES)).cast("int")).otherwise(F.col("range")))
    met = _passed(asked, said.filter("not single").drop("single"))

    # Few sites have cookies of a single label; only requests of such a session and label are passed again.
    single = said.filter("single").drop("single")
    labels = stash(single.select(F.col("session").alias("_session"), F.col("site").alias("_label")).distinct(), "labels")
    if not labels.isEmpty():
        again = F.col("request.own.session").eqNullSafe(F.col("_session")) & (F.substring_index("request.host", ".", -1) == F.col("_label"))
        far = met.join(labels, again, "left_semi").select(F.col("request.own.session").alias("session"), F.substring_index("request.host", ".", -1).alias("site"), F.col("request.own.seq").alias("seq"), F.struct("request", "standing").alias("request"))
        far = _passed(_ranged(far, cuts), single).select("request.request", F.concat("request.standing", "standing").alias("standing"))
        met = met.join(labels, again, "left_anti").unionByName(far)
    r = F.col("request")

    def applies(x: Column) -> Column:
        host_ok = (r["host"] == x["domain"]) | (~x["host_only"] & F.endswith(r["host"], F.concat(F.lit("."), x["domain"])))
        path_ok = (r["req_path"] == x["path"]) | (F.startswith(r["req_path"], x["path"]) & (F.endswith(x["path"], F.lit("/")) | (F.substring(r["req_path"], F.length(x["path"]) + 1, F.lit(1)) == "/")))
        site_ok = (x["same_site"] == "none") | r["same_site_request"] | ((x["same_site"] == "lax") & (r["intent"] == "navigation"))
        gate = (r["intent"] != "fetch") | r["same_origin_request"]
        return host_ok & path_ok & site_ok & gate & (~x["secure"] | (r["scheme"] == "https"))

    order = lambda x: F.struct((-F.length(x["path"])).alias("a"), x["created"].alias("created"), F.concat(x["name"], F.lit("="), x["value"]).alias("pair"))
    pairs = F.transform(F.array_sort(F.transform(F.filter("standing", applies), order)), lambda x: x["pair"])
    return met.select("request.own.*", F.when(F.size(pairs) > 0, F.array_join(pairs, "; ")).alias("cookie"))


def warrants_second_request(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """(nav_id, before, after, warranted): whether the cookies for a navigation's address differ between the arrival of the
    challenge and the end of its script's writes. attempts: (nav_id, session, url, challenge_seq, end_seq)."""
    at = lambda column, name: attempts.select(F.concat(F.lit(f"{name}:"), F.col("nav_id").cast("string")).alias("request_id"), "nav_id", "session", (F.col(column) + 1).alias("seq"), F.col("url").alias("target"), F.lit(None).cast("string").alias("referrer"), F.lit("navigation").alias("intent"))
    both = cookie_header(at("challenge_seq", "before").unionByName(at("end_seq", "after")), events)
    pick = lambda name: F.max(F.when(F.col("request_id").startswith(f"{name}:"), F.col("cookie")))
    return both.groupBy("nav_id").agg(pick("before").alias("before"), pick("after").alias("after")).withColumn("warranted", ~F.col("before").eqNullSafe(F.col("after")))
