"""Classification of crawl responses: what is a document, a challenge, an error. All narrow expressions.

Headers are ``array<struct<name, value>>``: order and repeats matter; names are compared without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BODY_BYTES = 16 << 20
# The headers that an envelope shows, and those that declare a challenge, in order.
SURFACED = ("retry-after", "cf-mitigated", "x-amzn-waf-action", "server", "x-datadome", "content-type")
DECLARING = ("retry-after", "cf-mitigated", "x-amzn-waf-action")
MAX_ESSENCE = 64
# End of fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that Unicode calls white space, as a Java and RE2 class body.
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def trim_white(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{WHITE}]+|[{WHITE}]+$", "")


def header_value(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.try_element_at(F.filter(headers, lambda h: ascii_lower(h["name"]) == name), F.lit(1))["value"]


def header_lines(headers: Column, name: str) -> Column:
    """All values of a header joined by a comma and a space, or null if there is none."""
    found = F.filter(headers, lambda h: ascii_lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda h: h["value"]), ", "))


def body_too_long(body: Column) -> Column:
    """Whether a body is over the limit of 16 MiB."""
    return F.octet_length(body) > MAX_BODY_BYTES


def check_body_len(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``error``: struct(kind, message) for a body over the limit, else null (or the error that is there)."""
    size = F.octet_length(body)
    found = F.when(size > MAX_BODY_BYTES, F.struct(F.lit("fetch.body").alias("kind"), F.concat(F.lit("body is "), size.cast("string"), F.lit(f" bytes; limit is {MAX_BODY_BYTES}")).alias("message")))
    return df.withColumn("error", F.coalesce(F.col("error"), found) if "error" in df.columns else found)


def non_document(content_type: Column) -> Column:
    """The declared media type if it is none of text, else null; at most 64 printable ASCII characters. No or a malformed declaration is null."""
    head = trim_white(F.substring_index(content_type, ";", 1))
    kind, sub = ascii_lower(trim_white(F.substring_index(head, "/", 1))), ascii_lower(trim_white(F.regexp_extract(head, r"(?s)^[^/]*/(.*)$", 1)))
    textual = (kind == "text") | sub.endswith("+xml") | sub.endswith("+json") | sub.isin("xml", "json", "javascript", "ecmascript")
    return F.when(head.contains("/") & ~textual, F.substring(F.regexp_replace(F.concat(kind, F.lit("/"), sub), r"[^\x21-\x7E]", ""), 1, MAX_ESSENCE))


def http_block(status: Column, headers: Column) -> Column:
    """struct(status, headers) with the allow-listed headers, lower-cased, in order with repeats; null without a status."""
    shown = F.filter(F.transform(headers, lambda h: F.struct(ascii_lower(h["name"]).alias("name"), h["value"].alias("value"))), lambda h: h["name"].isin(*SURFACED))
    return F.when(status.isNotNull(), F.struct(status.alias("status"), shown.alias("headers")))


def challenge(status: Column, headers: Column) -> Column:
    """The header that declares a challenge, or null: retry-after on a success, a mitigation header that says challenge at any status."""
    success = status.isNull() | (status < 400)
    says = lambda name: ascii_lower(trim_white(header_value(headers, name))) == "challenge"
    return F.coalesce(
        F.when(header_value(headers, DECLARING[0]).isNotNull() & success, F.lit(DECLARING[0])),
        *[F.when(says(name), F.lit(name)) for name in DECLARING[1:]],
    )


def classify_response(df: DataFrame) -> DataFrame:
    """Adds ``verdict`` (error, needs or parse), ``error_kind`` and ``declared``: fetch error, then challenge, status over 399, media type."""
    status, headers = F.col("status"), F.col("headers")
    declared = challenge(status, headers)
    failed = F.col("error.kind") if "error" in df.columns else F.lit(None).cast("string")
    media = non_document(header_value(headers, "content-type"))
    kind = F.coalesce(failed, F.when(declared.isNull() & (status >= 400), F.concat(F.lit("http."), status.cast("string"))), F.when(declared.isNull() & media.isNotNull(), F.lit("parse")))
    verdict = F.when(failed.isNotNull(), "error").when(declared.isNotNull(), "needs").when(kind.isNotNull(), "error").otherwise("parse")
    return df.withColumns({"verdict": verdict, "error_kind": F.when(verdict == "error", kind), "declared": F.when(failed.isNull(), declared)})


def error_message(error_kind: Column, status: Column, media: Column) -> Column:
    return F.when(error_kind.startswith("http."), F.concat(F.lit("server returned HTTP "), status.cast("string"))).when(
        error_kind == "parse", F.concat(F.lit("response media type "), media, F.lit(" is not a document"))
    )


def exit_code(status: Column) -> Column:
    """0 for ok and needs, 1 for error, 2 for no envelope."""
    return F.when(status.isin("ok", "needs"), 0).when(status == "error", 1).otherwise(2)


def exit_contract_ok(status: Column, exit: Column, output: Column) -> Column:
    """Whether a recorded exit agrees with its envelope; without one it must be 2 with nothing written."""
    bare = status.isNull() | (status == "")
    return F.when(bare, exit.eqNullSafe(F.lit(2)) & (trim_white(F.coalesce(output, F.lit(""))) == "")).otherwise(status.isin("ok", "needs", "error") & exit.eqNullSafe(exit_code(status)))


def cache_reusable(headers: Column) -> Column:
    """Whether a response may be served again: no Vary, or only accept-encoding in it."""
    tokens = F.transform(F.split(header_value(headers, "vary"), ","), lambda t: ascii_lower(trim_white(t)))
    return F.coalesce(F.forall(tokens, lambda t: (t == "") | (t == "accept-encoding")), F.lit(True))


VERSION = "1"


def envelope(df: DataFrame, view: str) -> DataFrame:
    """Adds ``envelope``: one JSON line of requested, final, status, needs, error_kind, message, http and ``out_json``.

    Absent blocks are left out, but ``out_json`` is spliced in as it is, with its own nulls.
    """
    url = F.struct(F.col("requested"), F.col("final"))
    head = F.to_json(F.struct(F.lit(VERSION).alias("version"), url.alias("url"), F.lit(view).alias("view"), F.col("env_status").alias("status")))
    tail = F.to_json(F.struct(
        F.when(F.size("needs") > 0, F.col("needs")).alias("needs"),
        F.when(F.col("error_kind").isNotNull(), F.struct(F.col("error_kind").alias("kind"), F.col("message").alias("message"))).alias("error"),
        F.col("http").alias("http"), F.col("challenge").alias("challenge"),
    ))
    out = F.when((F.col("env_status") != "error") & F.col("out_json").isNotNull(), F.concat(F.lit(',"out":'), F.col("out_json"))).otherwise(F.lit(""))
    rest = F.expr("substring(_tail, 2)")
    joined = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), out, F.when(F.col("_tail") == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), rest)))
    return df.withColumns({"_head": head, "_tail": tail}).withColumn("envelope", joined).drop("_head", "_tail")
