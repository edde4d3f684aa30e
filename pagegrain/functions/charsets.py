"""Bodies to text: content codings and character encodings."""

from __future__ import annotations

import codecs
import re
import zlib

import pandas as pd

from pagegrain.functions.vector import vectorised

LIMIT = 16 << 20
# Labels whose web meaning differs from the standard library's, and the names reported.
_LABELS = {
    "latin1": "windows-1252", "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "iso88591": "windows-1252", "l1": "windows-1252", "ascii": "windows-1252",
    "us-ascii": "windows-1252", "ansi_x3.4-1968": "windows-1252", "cp1252": "windows-1252", "x-cp1252": "windows-1252", "iso-8859-9": "windows-1254", "latin5": "windows-1254",
    "tis-620": "windows-874", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "gb2312": "gbk", "x-gbk": "gbk", "chinese": "gbk", "sjis": "shift_jis", "x-sjis": "shift_jis",
    "shift-jis": "shift_jis", "ms_kanji": "shift_jis", "windows-31j": "shift_jis", "utf-16": "utf-16le", "unicode": "utf-16le", "ks_c_5601-1987": "euc-kr", "korean": "euc-kr", "x-euc-jp": "euc-jp",
}
_KNOWN = (
    {f"iso-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)} | {f"windows-125{n}" for n in range(9)}
    | {"utf-8", "utf-16le", "utf-16be", "windows-874", "koi8-r", "koi8-u", "ibm866", "macintosh", "gbk", "gb18030", "big5", "euc-jp", "euc-kr", "shift_jis", "iso-2022-jp"}
)
_CODECS = {"windows-874": "cp874", "macintosh": "mac_roman", "ibm866": "cp866", "gbk": "gb18030", "shift_jis": "cp932", "euc-kr": "cp949"}
# End of fixed values.
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))


def declared_charset(content_type: str | None) -> str | None:
    """The charset of a content type: up to a semicolon or white space, quotes trimmed."""
    if content_type is None:
        return None
    at = content_type.lower().find("charset=")
    if at < 0:
        return None
    found = re.match(r"[^;\s]*", content_type[at + 8 :])[0].strip("\"'")
    return found or None


def sniffed_charset(raw: bytes) -> str | None:
    """The first charset= in the first 1,024 bytes."""
    head = raw[:1024].decode("utf-8", "replace")
    at = head.lower().find("charset=")
    if at < 0:
        return None
    return re.match(r"[A-Za-z0-9_-]*", head[at + 8 :].lstrip("\"'"))[0] or None


def encoding_of(label: str) -> str:
    """The encoding that a label names; utf-8 for an unknown one."""
    name = label.strip(" \t\n\f\r").lower()
    name = _LABELS.get(name, name)
    return name if name in _KNOWN else "utf-8"


def decode_bytes(raw: bytes | None, content_type: str | None = None) -> tuple[str | None, str | None]:
    """(text, encoding): declared, else sniffed, else utf-8; a byte order mark overrides; bad bytes are replaced."""
    if raw is None:
        return None, None
    name = encoding_of(declared_charset(content_type) or sniffed_charset(raw) or "utf-8")
    for mark, of in _BOMS:
        if raw.startswith(mark):
            raw, name = raw[len(mark) :], of
            break
    if name == "windows-1252":
        return "".join(raw[k : k + 1].decode("cp1252", "ignore") or chr(b) for k, b in enumerate(raw)) if re.search(rb"[\x81\x8d\x8f\x90\x9d]", raw) else raw.decode("cp1252"), name
    return raw.decode(_CODECS.get(name, name), "replace"), name


@vectorised("body string, charset string")
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """struct(body, charset): the text of raw bodies and the encoding used."""
    return pd.DataFrame([decode_bytes(None if b is None else bytes(b), c) for b, c in zip(body, content_type, strict=True)], columns=["body", "charset"])


@vectorised("string")
def charset_of(content_type: pd.Series, body: pd.Series) -> pd.Series:
    """The charset label chosen for raw bodies, before it is looked up."""
    return pd.Series([declared_charset(c) or sniffed_charset(b"" if b is None else bytes(b)) or "utf-8" for c, b in zip(content_type, body, strict=True)], dtype=object)


def inflate_bytes(raw: bytes | None, coding: str | None) -> tuple[bytes | None, str | None]:
    """(body, error). gzip of any number of members up to the limit; br has no codec here and is an error; others pass."""
    coding = (coding or "").strip().lower()
    if raw is None or coding not in ("gzip", "br"):
        return raw, None
    if coding == "br":
        return None, "br: no decoder"
    out, rest = b"", raw
    try:
        while rest and len(out) < LIMIT:
            d = zlib.decompressobj(31)
            out += d.decompress(rest, LIMIT - len(out))
            if not d.eof:
                if len(out) >= LIMIT:
                    break
                return None, "gzip: truncated"
            rest = d.unused_data.lstrip(b"\0")
        return out, None if raw else "gzip: empty"
    except zlib.error as e:
        return None, f"gzip: {e}"


@vectorised("body binary, error string")
def inflate(body: pd.Series, coding: pd.Series) -> pd.DataFrame:
    """struct(body, error): bodies with their content coding taken off."""
    return pd.DataFrame([inflate_bytes(None if b is None else bytes(b), c) for b, c in zip(body, coding, strict=True)], columns=["body", "error"])
