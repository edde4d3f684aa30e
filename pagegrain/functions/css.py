"""Style sheets: rules, media queries and selectors, parsed."""

from __future__ import annotations

import re
from functools import lru_cache

from pagegrain.functions.page import WHITE

VIEWPORT = (1280, 720)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)


def _outside(s: str, brackets: bool = True):
    """(position, character, whether it lies outside quotes and brackets) of each character; quotes know backslashes."""
    quote, escaped, depth = "", False, 0
    for k, c in enumerate(s):
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = ""
            yield k, c, False
        elif c in "\"'":
            quote = c
            yield k, c, False
        elif brackets and c in "[(":
            depth += 1
            yield k, c, False
        elif brackets and c in "])":
            depth = max(0, depth - 1)
            yield k, c, False
        else:
            yield k, c, depth == 0


def split_top(s: str, separator: str) -> list[str]:
    out, at = [], 0
    for k, c, outside in _outside(s):
        if outside and c == separator:
            out.append(s[at:k])
            at = k + 1
    return [*out, s[at:]]


def parse_declarations(s: str) -> list[tuple[str, str, bool]]:
    """(name, value, important) of each well-formed declaration."""
    out = []
    for part in split_top(s, ";"):
        part = part.strip(WHITE)
        colon = next((k for k, c, outside in _outside(part, brackets=False) if outside and c == ":"), None)
        if colon is None:
            continue
        name, value = part[:colon].strip(WHITE).lower(), part[colon + 1 :].strip(WHITE)
        important = value.lower().endswith("!important")
        if important:
            value = value[: -len("!important")].rstrip(WHITE)
        if name and value:
            out.append((name, value, important))
    return out


def _px(v: str) -> float | None:
    v = v.lower()
    for suffix, scale in (("rem", 16.0), ("em", 16.0), ("px", 1.0)):
        if v.endswith(suffix):
            try:
                return float(v[: -len(suffix)].strip(WHITE)) * scale
            except ValueError:
                return None
    return None


def _condition(c: str) -> bool | None:
    name, colon, value = c.partition(":")
    px = _px(value.strip(WHITE)) if colon else None
    if px is None:
        return None
    width, height = VIEWPORT
    known = {"min-width": width >= px, "max-width": width <= px, "width": width == px, "min-height": height >= px, "max-height": height <= px, "height": height == px}
    return known.get(name.strip(WHITE).lower())


_MEDIA = re.compile(r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)|([^()\s]+)|(\S)")


def _query(q: str) -> bool:
    tokens = []
    for m in _MEDIA.finditer(q):
        if m[3]:
            return False
        tokens.append(("if", m[1]) if m[2] is None else ("word", m[2].lower()))
    negate = bool(tokens) and tokens[0] == ("word", "not")
    tokens = tokens[1:] if tokens and tokens[0] in (("word", "not"), ("word", "only")) else tokens
    if not tokens:
        return False
    kind, value = tokens[0]
    passes = _condition(value) if kind == "if" else {"all": True, "screen": True, "print": False}.get(value)
    rest = tokens[1:]
    while passes is not None and rest:
        if len(rest) < 2 or rest[0] != ("word", "and") or rest[1][0] != "if":
            return False
        more = _condition(rest[1][1])
        passes = None if more is None else more and passes
        rest = rest[2:]
    return passes is not None and passes != negate


@lru_cache(4096)
def media_matches(query: str) -> bool:
    """Whether a media query list matches a 1280 by 720 screen; what is unknown does not match, under ``not`` neither."""
    return not query.strip(WHITE) or any(_query(q) for q in split_top(query, ","))


def _block(s: str, brace: int) -> tuple[str, int]:
    depth = 0
    for m in re.finditer(r"[{}]", s[brace:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return s[brace + 1 : brace + m.start()], brace + m.end()
    return s[brace + 1 :], len(s)


def parse_stylesheet(source: str | None) -> list[dict]:
    """The rules in order: {selectors, decls}. Media rules that match are inlined, other at-rules and malformed rules dropped."""
    return _rules(_COMMENT.sub("", source or ""))


def _rules(s: str) -> list[dict]:
    out, at = [], 0
    while True:
        while at < len(s) and s[at] in WHITE:
            at += 1
        if at >= len(s):
            return out
        if s[at] == "@":
            name = re.compile(r"[A-Za-z0-9-]*").match(s, at + 1)[0].lower()
            m = re.compile(r"[;{]").search(s, at)
            if not m or m[0] == ";":
                at = m.end() if m else len(s)
                continue
            body, after = _block(s, m.start())
            if name == "media" and media_matches(s[at + 1 + len(name) : m.start()]):
                out += _rules(body)
            at = after
            continue
        brace = s.find("{", at)
        if brace < 0:
            return out
        body, after = _block(s, brace)
        selectors = [x.strip(WHITE) for x in split_top(s[at:brace], ",")]
        selectors = [x for x in selectors if compile_selector(x) is not None]
        decls = parse_declarations(body)
        if selectors and decls:
            out.append({"selectors": selectors, "decls": [{"name": n, "value": v, "important": i} for n, v, i in decls]})
        at = after


_SIMPLE = re.compile(
    r"""(?P<all>\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]*))\s*)?\]"""
    r"""|(?P<pseudo>::?[\w-]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?)|(?P<tag>[\w-]+)"""
)


class Selector:
    """A compiled complex selector: compounds from the left, each with its combinator to the one before."""

    def __init__(self, parts: list[tuple[str, list[tuple]]], pseudo: str | None, supported: bool, specificity: tuple[int, int, int]):
        self.parts, self.pseudo, self.supported, self.specificity = parts, pseudo, supported, specificity


@lru_cache(65536)
def compile_selector(s: str) -> Selector | None:
    """None if it does not parse; an unsupported part compiles to one that never matches."""
    tokens: list[str] = []
    buffer = ""
    for _, c, outside in _outside(s):
        if outside and (c == ">" or c in WHITE):
            if buffer:
                tokens.append(buffer)
                buffer = ""
            if c == ">":
                tokens.append(">")
        else:
            buffer += c
    if buffer:
        tokens.append(buffer)
    parts, combinator, pseudo, supported = [], " ", None, True
    a = b = c = 0
    for token in tokens:
        if token == ">":
            combinator = ">"
            continue
        simples, at, pseudo = [], 0, None
        while at < len(token):
            m = _SIMPLE.match(token, at)
            if not m:
                return None
            at = m.end()
            if m["all"]:
                continue
            if m["cls"]:
                simples.append(("cls", m["cls"], None))
                b += 1
            elif m["id"]:
                simples.append(("id", m["id"], None))
                a += 1
            elif m["attr"]:
                value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
                simples.append(("attr", m["attr"].lower(), value))
                b += 1
            elif m["tag"]:
                simples.append(("tag", m["tag"].lower(), None))
                c += 1
            else:
                name = m["pseudo"].lstrip(":").lower()
                if name in ("before", "after"):
                    pseudo = name
                    c += 1
                else:
                    supported = False
        parts.append((combinator, simples))
        combinator = " "
    return Selector(parts, pseudo, supported, (a, b, c)) if parts else None


def parse_query(selectors: str) -> list[Selector]:
    """The selectors of a query; ValueError if any part is unsupported or malformed."""
    out = []
    for part in split_top(selectors, ","):
        s = compile_selector(part.strip(WHITE))
        if s is None or not s.supported or s.pseudo:
            raise ValueError(f"unsupported selector: {part.strip()!r}")
        out.append(s)
    return out
