"""The rows of a page's ``nodes`` column: the parsed tree in preorder, with what every view asks of a node."""

from __future__ import annotations

from pagegrain.functions.html import parse

# Element sets that define the views.
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "dd", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "td", "th", "ul",
    "option", "optgroup", "text", "foreignobject", "mi", "mn", "mo", "ms", "mspace", "mtext", "mrow",
))
SKIPPED = frozenset(("script", "style", "template", "noscript", "title", "desc", "metadata", "annotation", "annotation-xml"))
UNPAINTED_CHILDREN = frozenset(("video", "audio", "iframe", "canvas"))
HIDDEN_CHILDREN = frozenset(("video", "audio", "iframe"))
SECTIONING = frozenset(("article", "aside", "main", "nav", "section"))
CHROME = frozenset(("script", "style", "noscript", "template", "nav", "aside"))
#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# End of fixed values.
_TO_SPACE = {ord(c): " " for c in WHITE}


def words(text: str) -> list[str]:
    """Runs of anything but Unicode white space."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


class NodeColumns:
    """The nodes of pages by preorder id, a list for each of their fields, filled while each tree is walked once.

    ``unpainted`` and ``concealed``: its parent takes its place (fallback content, the body of a closed details element).
    ``shown``: neither it nor anything above it is unpainted or of an element without text. ``pre``: below a pre element.
    ``content``: below the first body, and neither it nor anything above it is unpainted, hidden or page chrome.
    ``sectioned``: below a sectioning element. Attributes lie side by side; a node's end where ``attr_ends`` says (null: it is no element).
    """

    INTS = ("id", "parent", "last", "depth", "ord")
    FLAGS = ("unpainted", "concealed", "shown", "pre", "content", "sectioned")

    def __init__(self):
        self.ends = [0]
        for field in (*self.INTS, "kind", "name", "text", *self.FLAGS, "attr_counts", "attr_names", "attr_values"):
            setattr(self, field, [])

    def add(self, html: str | None) -> None:
        base, number, body_seen = self.ends[-1], 0, False
        parents, lasts, names, kinds = self.parent, self.last, self.name, self.kind
        shown, pre, sectioned = self.shown, self.pre, self.sectioned
        left: list[bool] = []  # what is content, the body itself included
        closed: dict[int, bool] = {}  # of each details element that is not open: whether its summary has come
        stack = [(child, -1, 0) for child in reversed(parse(html).children)]
        while stack:
            node, up, depth = stack.pop()
            me, kind, attrs = len(left), node.kind, None
            name = node.name if kind == "element" else None
            of = names[base + up] if up >= 0 else None
            unpainted, concealed = of in UNPAINTED_CHILDREN, of in HIDDEN_CHILDREN
            if up in closed:
                if name == "summary" and not closed[up]:
                    closed[up] = True
                else:
                    unpainted = concealed = True
            within = up >= 0 and (sectioned[base + up] or of in SECTIONING)
            hidden = False
            if kind == "element":
                attrs = {}
                for key, value in node.attrs:
                    attrs.setdefault(key, value)
                hidden = "hidden" in attrs
                if name == "details" and "open" not in attrs:
                    closed[me] = False
            first_body = name == "body" and not body_seen
            body_seen |= first_body
            gone = unpainted or hidden or name in CHROME or not within and name in ("header", "footer")
            left.append(not gone and (first_body or up >= 0 and left[up]))
            self.id.append(me)
            parents.append(up)
            lasts.append(me)
            self.depth.append(depth)
            self.ord.append(number if kind == "element" else None)
            kinds.append(kind)
            names.append(name)
            self.text.append(node.text if kind != "doctype" and kind != "element" else None)
            self.unpainted.append(unpainted)
            self.concealed.append(concealed)
            shown.append((up < 0 or shown[base + up]) and name not in SKIPPED and not unpainted)
            pre.append(up >= 0 and (pre[base + up] or of == "pre"))
            self.content.append(left[me] and not first_body)
            sectioned.append(within)
            if attrs is None:
                self.attr_counts.append(None)
            else:
                number += 1
                self.attr_counts.append(len(attrs))
                if attrs:
                    self.attr_names.extend(attrs)
                    self.attr_values.extend(attrs.values())
            if node.children:
                stack += [(child, me, depth + 1) for child in reversed(node.children)]
        for i in range(len(names) - 1, base, -1):
            up = parents[i]
            if up >= 0 and lasts[base + up] < lasts[i]:
                lasts[base + up] = lasts[i]
        self.ends.append(len(names))


def node_rows(html: str | None) -> list[dict]:
    """The nodes of a page as rows, for a look at one page."""
    made, at, out = NodeColumns(), 0, []
    made.add(html)
    fields = (*NodeColumns.INTS, "kind", "name", "text", *NodeColumns.FLAGS)
    for i, n in enumerate(made.attr_counts):
        row = {field: getattr(made, field)[i] for field in fields}
        row["attrs"] = None if n is None else [{"name": k, "value": v} for k, v in zip(made.attr_names[at : at + n], made.attr_values[at : at + n], strict=True)]
        at += n or 0
        out.append(row)
    return out
