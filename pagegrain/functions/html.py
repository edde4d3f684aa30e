"""HTML parsing: tokens and tree construction in the manner of the HTML standard, with scripting on.

``parse`` gives a tree of ``Node``; ``flatten`` gives the rows of a page's ``nodes`` column in preorder.
Implemented: implied html, head and body; raw text and escapable raw text elements (noscript holds
text); paragraphs, list items, headings, options and ruby closing each other; active formatting
elements with reconstruction and the adoption agency; tables with implied bodies and rows and foster
parenting; svg and math as foreign content; template contents kept apart. Known gaps: framesets,
quirks mode, and the select element's own rules beyond its closing ones.
"""

from __future__ import annotations

import html as _html
import re

VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen basefont bgsound frame".split())
RAW = frozenset("style script xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p"
    " search section summary ul pre listing form table hr xmp plaintext li dd dt".split()
) | HEADINGS
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
SPECIAL = CLOSES_P | VOID | frozenset(
    "applet body button caption col colgroup head html iframe marquee noembed noframes noscript object script select style tbody td"
    " template textarea tfoot th thead title tr".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE = frozenset("table tbody tfoot thead tr".split())
SECTIONS = frozenset("tbody tfoot thead".split())
CELLS = frozenset("td th".split())

_SPACE = " \t\n\f\r"
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTR = re.compile(r"""[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\t\n\f\r >]*)))?""")
_CLOSE = re.compile(r"[\t\n\f\r ]*(/?)>|[\t\n\f\r /]*(/)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTR_REF = re.compile(r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_LOWER = {i: i + 32 for i in range(65, 91)}


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


def _attr_value(value: str) -> str:
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        ref = m[0]
        if ref[1] != "#" and ref[-1] != ";":
            after = value[m.end() : m.end() + 1]
            if after == "=" or after.isalnum() or _html.unescape(ref + ";") == ref + ";" and _html.unescape(ref)[-1:].isalnum():
                return ref
        return _html.unescape(ref)

    return _ATTR_REF.sub(one, value)


class Node:
    """An element, text, comment or doctype."""

    __slots__ = ("kind", "name", "attrs", "text", "children", "parent", "content")

    def __init__(self, kind: str, name: str | None = None, attrs: list[tuple[str, str]] | None = None, text: str | None = None):
        self.kind, self.name, self.attrs, self.text = kind, name, attrs or [], text
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.content: list[Node] = []

    def attr(self, name: str) -> str | None:
        for k, v in self.attrs:
            if k == name:
                return v
        return None

    def append(self, child: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.append(child)

    def insert_before(self, child: Node, ref: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.insert(self.children.index(ref), child)


class _Builder:
    def __init__(self):
        self.document = Node("document")
        self.html = self.head = self.body = self.form = None
        self.open: list[Node] = []
        self.active: list[Node | None] = []
        self.seen_head = self.after_body = self.skip_newline = False
        self.foreign = 0
        self.may_hold_p = False  # false only if no p is open, so that deep pages need no look at the whole stack

    # -- insertion

    def place(self) -> tuple[Node, Node | None]:
        """Where the next node goes: (parent, before)."""
        at = self.open[-1]
        if at.name in TABLE and self.fostering:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].name == "template":
                    return self.open[k], None
                if self.open[k].name == "table":
                    table = self.open[k]
                    return (table.parent, table) if table.parent is not None else (self.open[k - 1], None)
        return at, None

    fostering = False

    def add(self, node: Node) -> Node:
        parent, before = self.place()
        if parent.name == "template" and parent.kind == "element":
            node.parent = None
            parent.content.append(node)
            return node
        if node.kind == "text":
            near = parent.children[parent.children.index(before) - 1] if before is not None and parent.children.index(before) else parent.children[-1] if before is None and parent.children else None
            if near is not None and near.kind == "text":
                near.text += node.text
                return near
        if before is not None:
            parent.insert_before(node, before)
        else:
            node.parent = parent
            parent.children.append(node)
        return node

    def push(self, name: str, attrs: list[tuple[str, str]]) -> Node:
        node = self.add(Node("element", name, attrs))
        self.open.append(node)
        if name == "p":
            self.may_hold_p = True
        return node

    # -- implied structure

    def need_html(self, attrs: list[tuple[str, str]] | None = None) -> None:
        if self.html is None:
            self.html = Node("element", "html", attrs)
            self.document.append(self.html)
            self.open = [self.html]

    def need_head(self, attrs: list[tuple[str, str]] | None = None) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.push("head", attrs or [])

    def leave_head(self) -> None:
        self.need_head()
        if not self.seen_head:
            self.seen_head = True
            if self.open[-1] is self.head:
                self.open.pop()

    def need_body(self, attrs: list[tuple[str, str]] | None = None) -> None:
        self.leave_head()
        if self.body is None:
            self.body = self.push("body", attrs or [])

    # -- the stack

    def in_template(self) -> bool:
        return any(n.name == "template" for n in self.open)

    def in_scope(self, names, stop=SCOPE) -> bool:
        for node in reversed(self.open):
            if node.name in names:
                return True
            if node.name in stop:
                return False
        return False

    def implied_ends(self, keep: str | None = None) -> None:
        while self.open[-1].name in IMPLIED and self.open[-1].name != keep:
            self.open.pop()

    def pop_to(self, names) -> None:
        while len(self.open) > 1:
            if self.open.pop().name in names:
                return

    def close_p(self) -> None:
        if not self.may_hold_p:
            return
        self.may_hold_p = any(n.name == "p" for n in reversed(self.open))
        if self.may_hold_p and self.in_scope(("p",), _BUTTON_SCOPE):
            self.implied_ends("p")
            self.pop_to(("p",))

    def clear_to(self, names) -> None:
        while self.open[-1].name not in names and len(self.open) > 1:
            self.open.pop()

    # -- formatting elements

    def reconstruct(self) -> None:
        active = self.active
        if not active or active[-1] is None or active[-1] in self.open:
            return
        k = len(active) - 1
        while k > 0 and active[k - 1] is not None and active[k - 1] not in self.open:
            k -= 1
        for i in range(k, len(active)):
            active[i] = self.push(active[i].name, active[i].attrs)

    def remember(self, node: Node) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.name == node.name and x.attrs == node.attrs:
                same.append(x)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(node)

    def forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, name: str) -> None:
        """The adoption agency."""
        at = self.open[-1]
        if at.name == name and at not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            found = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == name:
                    found = x
                    break
            if found is None:
                self.end_other(name)
                return
            if found not in self.open:
                self.active.remove(found)
                return
            if not self.in_scope((name,)):
                return
            k = self.open.index(found)
            furthest = next((j for j in range(k + 1, len(self.open)) if self.open[j].name in SPECIAL), None)
            if furthest is None:
                del self.open[k:]
                self.active.remove(found)
                return
            block, ancestor = self.open[furthest], self.open[k - 1]
            mark = self.active.index(found)
            last, j, count = block, furthest, 0
            while True:
                j -= 1
                node = self.open[j]
                if node is found:
                    break
                count += 1
                if count > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.open[j]
                    continue
                clone = Node("element", node.name, node.attrs)
                self.active[self.active.index(node)] = clone
                self.open[j] = clone
                if last is block:
                    mark = self.active.index(clone) + 1
                clone.append(last)
                last = clone
            if last.parent is not None:
                last.parent.children.remove(last)
                last.parent = None
            if ancestor.name in TABLE:
                table = next((n for n in reversed(self.open) if n.name == "table"), None)
                if table is not None and table.parent is not None:
                    table.parent.insert_before(last, table)
                else:
                    ancestor.append(last)
            else:
                ancestor.append(last)
            clone = Node("element", found.name, found.attrs)
            for child in list(block.children):
                clone.append(child)
            block.append(clone)
            where = self.active.index(found)
            self.active.remove(found)
            self.active.insert(mark - (where < mark), clone)
            self.open.remove(found)
            self.open.insert(self.open.index(block) + 1, clone)

    # -- tokens

    def chars(self, text: str, raw: bool = False) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if text[:1] == "\n":
                text = text[1:]
        if not raw and "\0" in text:
            text = text.replace("\0", "")
        if not text:
            return
        if raw:
            self.add(Node("text", text=text))
            return
        if self.body is None and not self.in_template():
            lead = len(text) - len(text.lstrip(_SPACE))
            if lead and self.head is not None and not (self.seen_head and not self.open):
                self.add(Node("text", text=text[:lead]))
            text = text[lead:]
            if not text:
                return
            self.need_body()
        if self.foreign:
            self.add(Node("text", text=text))
            return
        if self.open[-1].name in TABLE:
            if text.strip(_SPACE):
                self.fostering = True
                self.reconstruct()
                self.add(Node("text", text=text))
                self.fostering = False
            else:
                self.add(Node("text", text=text))
            return
        self.reconstruct()
        self.add(Node("text", text=text))

    def comment(self, text: str) -> None:
        node = Node("comment", text=text)
        if self.html is None:
            self.document.append(node)
        elif self.after_body:
            self.html.append(node)
        else:
            self.add(node)

    def doctype(self, text: str) -> None:
        if self.html is None and not any(n.kind == "doctype" for n in self.document.children):
            self.document.append(Node("doctype", name=ascii_lower(text.strip().split(" ")[0]) if text.strip() else "", text=text))

    def start(self, name: str, attrs: list[tuple[str, str]], closing: bool) -> str | None:
        """Opens an element; returns its name if raw text follows."""
        self.skip_newline = False
        if name == "image":
            name = "img"
        if name == "html":
            if self.html is None:
                self.need_html(attrs)
            else:
                self.html.attrs += [a for a in attrs if self.html.attr(a[0]) is None]
            return None
        if name == "head":
            if self.head is None and not self.seen_head:
                self.need_head(attrs)
            return None
        if self.body is None and not self.in_template():
            if name in HEAD_ONLY or name == "noscript" and not self.seen_head:
                self.need_head()
                late = self.seen_head
                if late:
                    self.open.append(self.head)
                node = self.push(name, attrs)
                if late:
                    self.open.remove(self.head)
                if name in VOID:
                    self.open.remove(node)
                elif name == "template":
                    self.active.append(None)
                return name if name in RAW or name in ESCAPABLE else None
            self.need_body(attrs if name == "body" else None)
            if name == "body":
                return None
        elif name == "body":
            if self.body is None:
                return None
            self.body.attrs += [a for a in attrs if self.body.attr(a[0]) is None]
            return None
        if self.foreign and self.open[-1].name not in ("foreignobject", "desc", "title", "annotation-xml"):
            if name not in _BREAKS_FOREIGN:
                self.push(name, attrs)
                if closing:
                    self.open.pop()
                return None
            while self.foreign and len(self.open) > 1 and self.open[-1].name not in ("foreignobject", "desc", "title"):
                if self.open.pop().name in ("svg", "math"):
                    self.foreign -= 1
        here = self.open[-1].name
        if here in TABLE and self.start_in_table(name, attrs, here):
            return None
        if name in CELLS or name in SECTIONS or name in ("tr", "caption", "colgroup", "col"):
            return self.start_table_part(name, attrs)
        self.fostering = self.open[-1].name in TABLE
        out = self.start_in_body(name, attrs, closing)
        self.fostering = False
        return out

    def start_in_table(self, name: str, attrs: list[tuple[str, str]], here: str) -> bool:
        if name in SECTIONS or name in CELLS or name in ("tr", "caption", "colgroup", "col", "table"):
            self.start_table_part(name, attrs)
            return True
        if name == "input" and any(k == "type" and ascii_lower(v) == "hidden" for k, v in attrs):
            self.add(Node("element", name, attrs))
            return True
        return False

    def start_table_part(self, name: str, attrs: list[tuple[str, str]]) -> None:
        if not self.in_scope(("table",), ("html", "template")) and not self.in_template():
            return
        if name == "table":
            self.end("table")
            self.start("table", attrs, False)
            return
        if name in CELLS and self.open[-1].name == "template" or not self.in_scope(("table",), ("html", "template")):
            self.push(name, attrs)
            return
        if self.in_scope(CELLS, ("table", "html", "template")) or self.in_scope(("caption",), ("table", "html", "template")):
            self.implied_ends()
            self.pop_to(CELLS | {"caption"})
            self.forget_to_marker()
        if name in CELLS:
            self.clear_to({"tr", "tbody", "tfoot", "thead", "table", "html", "template"})
            if self.open[-1].name == "table":
                self.push("tbody", [])
            if self.open[-1].name in SECTIONS:
                self.push("tr", [])
            self.push(name, attrs)
            self.active.append(None)
        elif name == "tr":
            self.clear_to({"tbody", "tfoot", "thead", "table", "html", "template"})
            if self.open[-1].name == "table":
                self.push("tbody", [])
            self.push(name, attrs)
        elif name == "col":
            if self.open[-1].name != "colgroup":
                self.clear_to({"table", "html", "template"})
                self.push("colgroup", [])
            self.add(Node("element", name, attrs))
        else:
            self.clear_to({"table", "html", "template"})
            self.push(name, attrs)
            if name == "caption":
                self.active.append(None)

    def start_in_body(self, name: str, attrs: list[tuple[str, str]], closing: bool) -> str | None:
        if self.open[-1].name == "colgroup":
            self.open.pop()
        if name in FORMATTING:
            if name == "a":
                for x in reversed(self.active):
                    if x is None:
                        break
                    if x.name == "a":
                        self.adopt("a")
                        if x in self.active:
                            self.active.remove(x)
                        if x in self.open:
                            self.open.remove(x)
                        break
            elif name == "nobr" and self.in_scope(("nobr",)):
                self.adopt("nobr")
            self.reconstruct()
            self.remember(self.push(name, attrs))
            return None
        if name == "li" or name in ("dd", "dt"):
            group = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.name in group:
                    self.implied_ends(node.name)
                    self.pop_to((node.name,))
                    break
                if node.name in SPECIAL and node.name not in ("address", "div", "p"):
                    break
            self.close_p()
            self.push(name, attrs)
            return None
        if name == "form":
            if self.form is not None and not self.in_template():
                return None
            self.close_p()
            node = self.push(name, attrs)
            if not self.in_template():
                self.form = node
            return None
        if name in CLOSES_P:
            if name != "table" or self.document.children:
                self.close_p()
            if name in HEADINGS and self.open[-1].name in HEADINGS:
                self.open.pop()
            node = self.push(name, attrs)
            if name == "hr":
                self.open.pop()
            elif name in ("pre", "listing"):
                self.skip_newline = True
            return name if name == "xmp" else "plaintext" if name == "plaintext" else None
        if name in VOID:
            if name not in ("base", "link", "meta", "source", "track", "param", "col", "frame"):
                self.reconstruct()
            self.add(Node("element", name, attrs))
            return None
        if name in RAW or name in ESCAPABLE:
            if name in ("xmp",):
                self.reconstruct()
            self.push(name, attrs)
            self.skip_newline = name == "textarea"
            return name
        if name == "template":
            self.push(name, attrs)
            self.active.append(None)
            return None
        if name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.push(name, attrs)
            self.active.append(None)
            return None
        if name == "button" and self.in_scope(("button",)):
            self.implied_ends()
            self.pop_to(("button",))
        if name in ("option", "optgroup"):
            if self.open[-1].name == "option":
                self.open.pop()
            if name == "optgroup" and self.open[-1].name == "optgroup":
                self.open.pop()
        if name in ("rb", "rtc", "rp", "rt") and self.in_scope(("ruby",)):
            self.implied_ends("rtc" if name in ("rp", "rt") else None)
        if name == "select" and self.in_scope(("select",)):
            self.pop_to(("select",))
            return None
        self.reconstruct()
        self.push(name, attrs)
        if name in ("svg", "math"):
            if closing:
                self.open.pop()
            else:
                self.foreign += 1
        return None

    def end(self, name: str) -> None:
        self.skip_newline = False
        if self.html is None and name not in ("head", "body", "html", "br"):
            return
        if name == "head":
            self.leave_head()
            return
        if name in ("body", "html"):
            self.need_body()
            self.after_body = True
            return
        if self.body is None and not self.in_template():
            if name != "br":
                return
            self.need_body()
        if self.foreign:
            for node in reversed(self.open):
                if node.name == name:
                    while True:
                        popped = self.open.pop()
                        self.foreign -= popped.name in ("svg", "math")
                        if popped is node:
                            return
                if node.name in SPECIAL and node.name not in ("title", "script", "style"):
                    break
        if name in FORMATTING:
            self.fostering = self.open[-1].name in TABLE
            self.adopt(name)
            self.fostering = False
        elif name == "p":
            if not self.in_scope(("p",), _BUTTON_SCOPE):
                self.fostering = self.open[-1].name in TABLE
                self.push("p", [])
                self.fostering = False
            self.close_p()
        elif name == "br":
            self.start("br", [], False)
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied_ends()
                self.pop_to(HEADINGS)
        elif name == "li":
            if self.in_scope(("li",), SCOPE | {"ol", "ul"}):
                self.implied_ends("li")
                self.pop_to(("li",))
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and node in self.open:
                self.implied_ends()
                if node in self.open:
                    self.open.remove(node)
        elif name == "table":
            if self.in_scope(("table",), ("html", "template")):
                while self.open[-1].name != "table":
                    if self.open.pop().name in CELLS | {"caption"}:
                        self.forget_to_marker()
                self.open.pop()
        elif name in SECTIONS or name == "tr":
            if self.in_scope((name,), ("table", "html", "template")):
                while True:
                    popped = self.open.pop().name
                    if popped in CELLS:
                        self.forget_to_marker()
                    if popped == name:
                        break
        elif name in CELLS or name == "caption":
            if self.in_scope((name,), ("table", "html", "template")):
                self.implied_ends()
                self.pop_to((name,))
                self.forget_to_marker()
        elif name == "template":
            if self.in_template():
                self.pop_to(("template",))
                self.forget_to_marker()
        elif name in ("applet", "marquee", "object"):
            if self.in_scope((name,)):
                self.implied_ends()
                self.pop_to((name,))
                self.forget_to_marker()
        elif name in CLOSES_P or name in ("button", "dd", "dt", "select"):
            if self.in_scope((name,)):
                self.implied_ends(name if name in ("dd", "dt") else None)
                self.pop_to((name,))
        else:
            self.end_other(name)

    def end_other(self, name: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            node = self.open[k]
            if node.name == name:
                self.implied_ends(name)
                del self.open[min(k, len(self.open)) :]
                return
            if node.name in SPECIAL:
                return


_BUTTON_SCOPE = SCOPE | {"button"}
_BREAKS_FOREIGN = CLOSES_P | FORMATTING - {"a"} | frozenset("body br embed head img meta ruby span sub sup var".split())


def parse(text: str | None) -> Node:
    """The document of an HTML text; null is parsed like an empty text."""
    s = text or ""
    if "\r" in s:
        s = s.replace("\r\n", "\n").replace("\r", "\n")
    if s[:1] == "﻿":
        s = s[1:]
    b = _Builder()
    pos, n = 0, len(s)
    unescape, find = _html.unescape, s.find
    pending: list[str] = []

    def flush() -> None:
        if pending:
            joined = "".join(pending)
            pending.clear()
            b.chars(unescape(joined) if "&" in joined else joined)

    while pos < n:
        lt = find("<", pos)
        if lt < 0:
            pending.append(s[pos:])
            break
        if lt > pos:
            pending.append(s[pos:lt])
        m = _PLAIN.match(s, lt)
        raw = None
        if m:
            flush()
            name = m[2].lower()
            pos = m.end()
            if m[1]:
                b.end(name)
                continue
            raw = b.start(name, [], False)
        else:
            c = s[lt + 1 : lt + 2]
            if c.isascii() and c.isalpha() or c == "/" and s[lt + 2 : lt + 3].isascii() and s[lt + 2 : lt + 3].isalpha():
                m = _NAME.match(s, lt + 1 + (c == "/"))
                attrs: list[tuple[str, str]] = []
                have: set[str] = set()
                at = m.end()
                while True:
                    a = _ATTR.match(s, at)
                    if not a:
                        break
                    key = ascii_lower(a[1])
                    at = a.end()
                    if key not in have:
                        have.add(key)
                        attrs.append((key, _attr_value(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or "")))
                e = _CLOSE.match(s, at)
                if not e:
                    flush()
                    break
                flush()
                pos = e.end()
                name = ascii_lower(m[0])
                if c == "/":
                    b.end(name)
                    continue
                raw = b.start(name, attrs, bool(e[1] or e[2]))
            elif s.startswith("<!--", lt):
                flush()
                if s.startswith(">", lt + 4) or s.startswith("->", lt + 4):
                    b.comment("")
                    pos = find(">", lt + 4) + 1
                    continue
                e = _COMMENT_END.search(s, lt + 4)
                b.comment(s[lt + 4 : e.start() if e else n])
                pos = e.end() if e else n
                continue
            elif s[lt : lt + 9].lower() == "<!doctype":
                flush()
                e = find(">", lt)
                b.doctype(s[lt + 9 : e if e >= 0 else n])
                pos = e + 1 if e >= 0 else n
                continue
            elif b.foreign and s.startswith("<![CDATA[", lt):
                flush()
                e = find("]]>", lt)
                b.chars(s[lt + 9 : e if e >= 0 else n], raw=True)
                pos = e + 3 if e >= 0 else n
                continue
            elif c in ("!", "?") or c == "/" and lt + 2 < n:
                flush()
                if s.startswith("</>", lt):
                    pos = lt + 3
                    continue
                e = find(">", lt)
                b.comment(s[lt + (1 if c == "?" else 2) : e if e >= 0 else n])
                pos = e + 1 if e >= 0 else n
                continue
            else:
                pending.append("<")
                pos = lt + 1
                continue
        if raw == "plaintext":
            b.chars(s[pos:], raw=True)
            break
        if raw is not None:
            e = re.compile(rf"</{re.escape(raw)}(?=[\t\n\f\r />])", re.I).search(s, pos)
            body = s[pos : e.start() if e else n].replace("\0", "�")
            b.chars(unescape(body) if raw in ESCAPABLE and "&" in body else body, raw=True)
            b.open.pop()
            if e:
                end = find(">", e.end())
                pos = end + 1 if end >= 0 else n
            else:
                pos = n
    flush()
    if b.body is None:
        b.need_body()
    return b.document


def flatten(document: Node) -> list[tuple]:
    """Preorder rows (id, parent, last, depth, ord, kind, name, attrs, text). ``last`` is the largest id in the
    subtree, ``ord`` numbers elements from 0; roots have parent -1. Template contents are not children."""
    rows: list[list] = []
    stack = [(child, -1, 0) for child in reversed(document.children)]
    elements = 0
    while stack:
        node, parent, depth = stack.pop()
        me = len(rows)
        rows.append([me, parent, me, depth, elements if node.kind == "element" else None, node.kind, node.name, node.attrs if node.kind == "element" else None, node.text if node.kind != "doctype" else None])
        elements += node.kind == "element"
        stack += [(child, me, depth + 1) for child in reversed(node.children)]
    for row in reversed(rows):
        if row[1] >= 0 and rows[row[1]][2] < row[2]:
            rows[row[1]][2] = row[2]
    return [tuple(r) for r in rows]
