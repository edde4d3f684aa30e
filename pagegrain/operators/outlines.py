"""Outlines of recorded accessibility trees, from tables of their nodes.

A recorded tree is a JSON list of nodes that name their children. Its nodes become rows, in which names are resolved within the tree, and
what a node needs to know of its neighbours (parent, first child, next sibling) comes back to the tree as an array by place. Then each tree is
one list of steps, into and out of each node in order, which pointer doubling ranks: after k rounds a step knows the step 2**k ahead,
how far that is, and how many kept nodes are entered on the way. Rounds are expressions over the array, as many as the longest tree's
logarithm, so neither depth nor size of a tree is a limit and no helper is called. A node is under its nearest
kept ancestor by the order of steps alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.operators.responses import trim_white
from pagegrain.storage import bucketed

# What becomes of recorded roles.
AX_DROP = ("StaticText", "InlineTextBox", "ListMarker", "LineBreak")
AX_SPLICE = ("generic", "none", "presentation", "LabelText", "Legend", "Canvas", "Video", "Audio", "MenuListPopup", "LayoutTable", "LayoutTableRow", "LayoutTableCell")
AX_RENAME = {"image": "img", "DisclosureTriangle": "button", "SvgRoot": "graphics-document", "Figcaption": "caption", "DescriptionList": "list"}
# End of fixed values.
_NODES = (
    "array<struct<nodeId:string,parentId:string,ignored:boolean,backendDOMNodeId:bigint,childIds:array<string>,role:struct<value:string>,name:struct<value:string>,"
    "properties:array<struct<name:string,value:struct<value:string>>>>>"
)


def _line(n: Column) -> Column:
    role = F.coalesce(n["role"]["value"], F.lit(""))
    for recorded, told in AX_RENAME.items():
        role = F.when(role == recorded, told).otherwise(role)
    level = F.get(F.filter(n["properties"], lambda p: p["name"] == "level"), F.lit(0))["value"]["value"]
    name = F.to_json(F.struct(trim_white(F.coalesce(n["name"]["value"], F.lit(""))).alias("v")))
    name = F.substring(name, F.lit(6), F.length(name) - 6)
    return F.concat(role, F.lit(" "), name, F.when((role == "heading") & level.isNotNull(), F.concat(F.lit(" level="), level)).otherwise(""))


def _placed(trees: DataFrame) -> DataFrame:
    """(tree, at): for each node by its place its parent's place, first child's and next sibling's (-1 for none), whether it is dropped, and its line if it is kept.

    Names are resolved and neighbours found by windows and groups within a tree, so that rows stay where the tree's bucket is read.
    """
    nodes = trees.select("tree", "shadow", F.posexplode("nodes").alias("pos", "n"))
    role = F.coalesce(F.col("n.role.value"), F.lit(""))
    through = F.coalesce(F.col("n.ignored"), F.lit(False)) | F.coalesce(F.array_contains("shadow", F.col("n.backendDOMNodeId")), F.lit(False)) | role.isin(*AX_SPLICE)
    drop = role.isin(*AX_DROP)
    # Each node says its own name, and the names of its children in order.
    own = F.struct(F.col("n.nodeId").alias("id"), F.lit(-1).alias("ord"))
    listed = F.transform(F.coalesce("n.childIds", F.array().cast("array<string>")), lambda c, i: F.struct(c.alias("id"), i.alias("ord")))
    told = nodes.select("tree", "pos", F.col("n.parentId").isNull().alias("top"), drop.alias("drop"), F.when(~drop & ~through, _line(F.col("n"))).alias("line"), F.inline(F.concat(F.array(own), listed)))
    is_own = F.col("ord") < 0
    told = told.select("tree", "pos", "id", "ord", *(F.when(is_own, F.col(c)).alias(c) for c in ("top", "drop", "line")))
    # Of nodes with one name the last counts; a node that is listed twice counts where it is listed first.
    told = told.withColumn("child", F.max(F.when(is_own, F.col("pos"))).over(Window.partitionBy("tree", "id")))
    told = told.filter(is_own | F.col("child").isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("tree", is_own, F.when(is_own, F.col("pos")).otherwise(F.col("child"))).orderBy("pos", "ord")))
    siblings = Window.partitionBy("tree", is_own, "pos").orderBy("ord")
    told = told.filter(is_own | (F.col("nth") == 1)).withColumns({"next": F.lead("child").over(siblings), "nth": F.row_number().over(siblings)})
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    fact = lambda pos, parent, first, nxt, top, drop, line: F.struct(pos.alias("pos"), parent.alias("parent"), first.alias("first"), nxt.alias("next"), top.alias("top"), drop.alias("drop"), line.alias("line"))
    flag = F.lit(None).cast("boolean")
    of_own = F.array(fact(F.col("pos"), none, none, none, F.col("top"), F.col("drop"), F.col("line")))
    of_child = fact(F.col("child"), F.col("pos"), none, F.col("next"), flag, flag, text)
    of_first = fact(F.col("pos"), none, F.col("child"), none, flag, flag, text)
    facts = told.select("tree", F.inline(F.when(is_own, of_own).when(F.col("nth") == 1, F.array(of_child, of_first)).otherwise(F.array(of_child))))
    none_of = lambda c: F.coalesce(F.max(c), F.lit(-1)).alias(c)
    facts = facts.groupBy("tree", "pos").agg(none_of("parent"), none_of("first"), none_of("next"), F.max("top").alias("top"), F.max("drop").alias("drop"), F.max("line").alias("line"))
    return facts.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("pos", "parent", "first", "next", "top", "drop", "line"))).alias("at"))


def ax_outlines(df: DataFrame, nodes_json: str, shadow: str, *keys: str) -> DataFrame:
    """(keys, outline): the lines of each recorded tree in order: role, quoted name and heading level, children in brackets.

    Ignored nodes, those of ``shadow`` (array<long> of backend node ids) and those of layout roles give way to their children; texts and markers
    go with all below them. A row without a tree, or whose JSON is none, has no lines.
    """
    parsed = df.select(F.struct(*keys).alias("own"), F.monotonically_increasing_id().alias("tree"), F.from_json(nodes_json, _NODES).alias("nodes"), F.coalesce(shadow, F.array().cast("array<long>")).alias("shadow"))
    trees = bucketed(parsed, "trees", "tree")
    placed = _placed(trees.filter(F.size("nodes") > 0))
    # The root is the first node without a parent.
    root = F.get(F.filter("at", lambda x: x["top"]), F.lit(0))["pos"]
    placed = placed.select("tree", "at", root.alias("root")).filter("root is not null")
    step = lambda to, w, own: F.struct(to.cast("int").alias("to"), F.lit(1).alias("far"), w.cast("int").alias("kept"), own.cast("int").alias("end"))
    into = lambda x: step(F.when(x["drop"] | (x["first"] < 0), 2 * x["pos"] + 1).otherwise(2 * x["first"]), F.when(x["line"].isNotNull() & (x["pos"] != F.col("root")), 1).otherwise(0), 2 * x["pos"])
    # What is below a dropped node leads nowhere, so that it is no part of the root's list.
    lost = lambda x: F.coalesce(F.get("at", F.when(x["parent"] >= 0, x["parent"]))["drop"], F.lit(False))
    out_of = lambda x: step(F.when(x["pos"] == F.col("root"), -1).when(x["next"] >= 0, 2 * x["next"]).when(lost(x) | (x["parent"] < 0), -1).otherwise(2 * x["parent"] + 1), F.lit(0), 2 * x["pos"] + 1)
    ranked = placed.select("tree", "at", "root", F.flatten(F.transform("at", lambda x: F.array(into(x), out_of(x)))).alias("steps"))
    longest = trees.agg(F.max(F.size("nodes"))).first()[0] or 0
    for _ in range((2 * max(longest, 1)).bit_length()):
        ahead = lambda x: F.get("steps", x["to"])
        joined = lambda x: F.struct(ahead(x)["to"].alias("to"), (x["far"] + ahead(x)["far"]).alias("far"), (x["kept"] + ahead(x)["kept"]).alias("kept"), ahead(x)["end"].alias("end"))
        ranked = ranked.select("tree", "at", "root", F.transform("steps", lambda x: F.when(x["to"] >= 0, joined(x)).otherwise(x)).alias("steps"))
    entered, left = (lambda x, k=k: F.get("steps", 2 * x["pos"] + k) for k in (0, 1))
    on_list = lambda x: (entered(x)["end"] == 2 * F.col("root") + 1) & x["line"].isNotNull() & (x["pos"] != F.col("root"))
    said = lambda far, sub, line: F.struct((-far).alias("at"), F.lit(sub).alias("sub"), line.alias("line"))
    held = lambda x: entered(x)["kept"] - left(x)["kept"] > 1
    lines = lambda x: F.filter(F.array(said(entered(x)["far"], 0, x["line"]), said(entered(x)["far"], 1, F.when(held(x), "(")), said(left(x)["far"], 0, F.when(held(x), ")"))), lambda s: s["line"].isNotNull())
    outline = F.transform(F.array_sort(F.flatten(F.transform(F.filter("at", on_list), lines))), lambda s: s["line"])
    # Written, as a filter on the outline would be pushed through the rounds, each of which names the steps of the one before several times.
    made = bucketed(ranked.select("tree", outline.alias("outline")), "outlines", "tree")
    return trees.select("tree", "own").join(made, "tree", "left").select("own.*", F.coalesce("outline", F.array().cast("array<string>")).alias("outline"))
