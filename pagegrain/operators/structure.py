"""Selectors as a structural join: ordered passes over the nodes of many pages at once.

Nodes lie in preorder, and a subtree is a run of them. A node has an ancestor among some nodes if the furthest end of
those before it reaches it: one running maximum over the nodes of a whole batch, in which each page's ids are moved
behind the page before, answers that for all nodes. So a descendant step takes time in proportion to the nodes, however many match and however deep they
lie; a child step looks up the parent. Which nodes a compound may match is read off columns of tags and attributes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions import css
from pagegrain.functions.page import WHITE


def _values(column: pa.Array) -> pa.Array:
    return column.flatten()


def _counts(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Nodes:
    """The nodes of a batch of pages side by side; ids, parents and last descendants count over the batch."""

    def __init__(self, parent: pa.Array, last: pa.Array, name: pa.Array, attrs: pa.Array | None):
        self.sizes = _counts(parent)
        self.first = np.cumsum(self.sizes) - self.sizes
        base = np.repeat(self.first, self.sizes)
        self.n, self.base = len(base), base
        own = _values(parent).to_numpy(zero_copy_only=False)
        self.parent, self.last = np.where(own >= 0, own + base, -1), _values(last).to_numpy(zero_copy_only=False) + base
        self.name = _values(name)
        self.owner = self.attr_name = self.attr_value = None
        if attrs is not None:
            each = _values(attrs)
            self.owner = np.repeat(np.arange(self.n), _counts(each))
            flat = _values(each)
            self.attr_name, self.attr_value = flat.field("name"), flat.field("value")

    def _mask(self, found: pa.Array) -> np.ndarray:
        return found.fill_null(False).to_numpy(zero_copy_only=False)

    def _with(self, name: str, fits: pa.Array | None = None) -> np.ndarray:
        """The nodes with an attribute of that name (each has one at most) whose value fits."""
        found = pc.equal(self.attr_name, name)
        out = np.zeros(self.n, bool)
        out[self.owner[self._mask(found if fits is None else pc.and_kleene(found, fits))]] = True
        return out

    def compound(self, simples: list[tuple]) -> np.ndarray:
        """The elements that match all of a compound's parts; only elements have names."""
        out = self._mask(pc.is_valid(self.name))
        for kind, name, value in simples:
            if kind == "tag":
                out = out & self._mask(pc.equal(self.name, name))
            elif kind == "cls":
                white = re.escape(WHITE)
                out = out & self._with("class", pc.match_substring_regex(self.attr_value, f"(?:^|[{white}]){re.escape(name)}(?:$|[{white}])"))
            elif kind == "id":
                out = out & self._with("id", pc.equal(self.attr_value, name))
            else:
                out = out & self._with(name, None if value is None else pc.equal(self.attr_value, value))
        return out

    def below(self, of: np.ndarray) -> np.ndarray:
        """The nodes with an ancestor among ``of``."""
        furthest = np.maximum.accumulate(np.where(of, self.last, -1))
        out = np.zeros(self.n, bool)
        out[1:] = furthest[:-1] >= np.arange(1, self.n)
        return out

    def children(self, of: np.ndarray) -> np.ndarray:
        return (self.parent >= 0) & of[self.parent]

    def matched(self, selectors: list[css.Selector]) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for selector in selectors:
            found = self.compound(selector.parts[0][1])
            for combinator, simples in selector.parts[1:]:
                found = (self.children(found) if combinator == ">" else self.below(found)) & self.compound(simples)
            out |= found
        return out

    def firsts(self, of: np.ndarray) -> np.ndarray:
        """The first of these nodes on each page."""
        at = np.flatnonzero(of)
        out = np.zeros(self.n, bool)
        out[at[np.unique(self.base[at], return_index=True)[1]]] = True
        return out

    def ids(self, of: np.ndarray) -> pa.Array:
        """Each page's ids of these nodes."""
        at = np.flatnonzero(of)
        ends = np.searchsorted(at, np.append(self.first, self.n))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at - self.base[at], pa.int32()))


def selected_ids(nodes: Column, selectors: str, scope: str | None = None) -> Column:
    """array<int>: the ids of the elements that match, in document order; with ``scope``, below the first element that matches it.

    Only parents, ends, names and, where the selectors ask for any, attributes are sent to the helper.
    """
    parsed, around = css.parse_query(selectors), None if scope is None else css.parse_query(scope)
    asks = any(kind != "tag" for s in [*parsed, *(around or [])] for _, simples in s.parts for kind, _, _ in simples)

    def find(parent: pa.Array, last: pa.Array, name: pa.Array, attrs: pa.Array | None = None) -> pa.Array:
        pages = Nodes(parent, last, name, attrs)
        found = pages.matched(parsed)
        if around is not None:
            found &= pages.below(pages.firsts(pages.matched(around)))
        return pages.ids(found)

    def with_attrs(parent: pa.Array, last: pa.Array, name: pa.Array, attrs: pa.Array) -> pa.Array:
        return find(parent, last, name, attrs)

    def without(parent: pa.Array, last: pa.Array, name: pa.Array) -> pa.Array:
        return find(parent, last, name)

    columns = [nodes[c] for c in ("parent", "last", "name", *(["attrs"] if asks else []))]
    return F.arrow_udf(with_attrs if asks else without, "array<int>")(*columns)
