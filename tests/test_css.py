import pytest

from pagegrain.functions import css


@pytest.mark.parametrize(
    ("query", "matches"),
    [("", True), ("all", True), ("print", False), ("not print", True), ("not weird", False), ("(min-width:600px)", True), ("screen and (max-width: 79em)", False), ("print, (width:1280px)", True), ("only screen and (min-height:721px)", False), ("screen (x)", False)],
)
def test_media(query, matches):
    assert css.media_matches(query) is matches


def test_rules():
    rules = css.parse_stylesheet("/* x */ a, b > c { color : red !important; bad; e: } @media print { p {a:b} } @media all { q {c:d} } @font-face { x:y } .é:hover, d {f:g} {}")
    assert [r["selectors"] for r in rules] == [["a", "b > c"], ["q"], [".é:hover", "d"]]
    assert rules[0]["decls"] == [{"name": "color", "value": "red", "important": True}]


def test_unsupported_selectors_raise_in_queries():
    for bad in ("p:hover", "p::before", "a,,b", "[x~=y]", ""):
        with pytest.raises(ValueError):
            css.parse_query(bad)


def test_specificity():
    assert [css.compile_selector(s).specificity for s in ("p", ".a p", "#i > p.b", "*")] == [(0, 0, 1), (0, 1, 1), (1, 1, 1), (0, 0, 0)]
