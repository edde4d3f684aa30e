"""Outlines of recorded trees against a walk over each tree."""

import json
import random

from pyspark.sql import functions as F

from pagegrain.operators import outlines
from pagegrain.operators.outlines import AX_DROP, AX_RENAME, AX_SPLICE


def ax_outline(nodes: list[dict], shadow: set[int]) -> list[str]:
    """The outline of a recorded accessibility tree: role, quoted name and heading level, children in brackets."""
    by_id = {n["nodeId"]: n for n in nodes}
    root = next((n for n in nodes if n.get("parentId") is None), None)
    if root is None:
        return []

    def children(n: dict) -> object:
        return (by_id[c] for c in n.get("childIds") or () if c in by_id)

    out: list[str] = []
    stack: list = list(reversed(list(children(root))))
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            if out[-1] == "(" and n[0] == len(out) - 1:
                out.pop()
            else:
                out.append(")")
            continue
        role = (n.get("role") or {}).get("value") or ""
        if role in AX_DROP:
            continue
        below = list(reversed(list(children(n))))
        if n.get("ignored") or n.get("backendDOMNodeId") in shadow or role in AX_SPLICE:
            stack += below
            continue
        role = AX_RENAME.get(role, role)
        level = next(((p.get("value") or {}).get("value") for p in n.get("properties") or () if p.get("name") == "level"), None)
        suffix = f" level={level}" if level is not None and role == "heading" else ""
        out.append(f"{role} {json.dumps(((n.get('name') or {}).get('value') or '').strip(), ensure_ascii=False)}{suffix}")
        if below:
            out.append("(")
            stack.append((len(out) - 1,))
            stack += below
    return out


def told(spark, trees):
    rows = [(k, None if t is None else t if isinstance(t, str) else json.dumps(t), sorted(s)) for k, (t, s) in enumerate(trees)]
    df = spark.createDataFrame(rows, "id int, tree string, hidden array<long>")
    return {r.id: r.outline for r in outlines.ax_outlines(df, "tree", "hidden", "id").collect()}


def test_by_hand(spark):
    node = lambda i, role, name=None, parent="r", kids=(), **more: {"nodeId": i, "parentId": parent, "role": {"value": role}, "name": {"value": name}, "childIds": list(kids)} | more
    nodes = [node("r", "RootWebArea", kids="ab", parent=None), node("a", "image", "x"), node("b", "generic", kids=["c", "d"]), node("c", "heading", " t ", "b", ["e"], properties=[{"name": "level", "value": {"value": 2}}]), node("d", "StaticText", "s", "b"), node("e", "link", "l", "c")]
    got = told(spark, [(nodes, []), (None, []), ("[]", []), ("no json", []), ([{k: v for k, v in nodes[1].items()}], [])])
    assert got == {0: ['img "x"', 'heading "t" level=2', "(", 'link "l"', ")"], 1: [], 2: [], 3: [], 4: []}


def random_tree(rng):
    n = rng.randint(1, 40)
    kids = {i: [] for i in range(n)}
    parent = {}
    for i in range(1, n):
        parent[i] = rng.randrange(i)
        kids[parent[i]].append(i)
    roles = ["link", "heading", "image", "generic", "StaticText", "none", "button", "Figcaption", "ListMarker", None]
    nodes = []
    for i in range(n):
        rng.shuffle(kids[i])
        node = {"nodeId": f"n{i}", "role": {"value": rng.choice(roles) if i else "RootWebArea"}, "name": {"value": rng.choice(["", " a ", 'q"x', "é"])}, "childIds": [f"n{k}" for k in kids[i]] + rng.choice([[], ["gone"]]), "backendDOMNodeId": i, "ignored": rng.random() < 0.2}
        if i:
            node["parentId"] = f"n{parent[i]}"
        if rng.random() < 0.3:
            node["properties"] = [{"name": "focusable", "value": {"value": True}}, {"name": "level", "value": {"value": rng.randint(1, 6)}}]
        nodes.append(node)
    rng.shuffle(nodes)
    return nodes


def test_random_trees(spark):
    rng = random.Random(6)
    trees = [(random_tree(rng), rng.sample(range(40), 5)) for _ in range(120)]
    assert told(spark, trees) == {k: ax_outline(t, set(s)) for k, (t, s) in enumerate(trees)}


def test_large_and_deep_trees(spark):
    """100,000 nodes, in one chain and in a bush."""
    for parent_of in (lambda i: i - 1, lambda i: (i - 1) // 7):
        n = 100_000
        kids = {}
        for i in range(1, n):
            kids.setdefault(parent_of(i), []).append(str(i))
        nodes = [{"nodeId": str(i), "role": {"value": "generic" if i % 3 == 1 else "link"}, "name": {"value": str(i)}, "childIds": kids.get(i, [])} | ({"parentId": str(parent_of(i))} if i else {}) for i in range(n)]
        assert told(spark, [(nodes, [])]) == {0: ax_outline(nodes, set())}
