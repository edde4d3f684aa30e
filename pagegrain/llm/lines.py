"""Operator 4: line dedup by a log-template tree.

Lines are parsed at a fixed depth: a leaf of the tree holds the lines with the same token count and the
same ``DEPTH`` leading tokens, where a token with a digit is a variable field. A leaf is then told apart
into templates, by counts alone, so the order and the number of its lines say nothing (``templates_of``):

- The weight of a line is the number of different texts it is in; a node is dead under ``min_docs``.
- The token that holds over half of a node's weight at a position is fixed there. If at least
  ``SIMILARITY`` of the positions are fixed, the lines that agree with the fixed tokens in as many are one
  template (if they weigh ``min_docs``), and the other lines of the node are judged again without them.
- Otherwise the node is split at its first position without a fixed token (else the first that varies): each
  token there of weight ``min_docs`` is a node, the rare ones are one node with a variable field. A node
  with too many variable fields to reach ``SIMILARITY`` is dead.

A template that recurs is boilerplate, and all its lines are dropped. It recurs if it is in at least
``MIN_DOCS`` documents that have nothing to do with each other, and these are at least ``MIN_SHARE`` of the
different texts it is in. Only templates in at least ``MIN_DOCS`` different texts are common. A document is
known by the least hash of its own lines, which are neither common nor edits of common ones (with the same
first or last ``EDGE`` tokens), so no other line of a shared block stands for it. A text whose own lines
are under ``OWN_SHARE`` both of its lines and of its tokens is a copy, known by the least of its other
common templates: a line that recurs only because one document was copied is that document's content,
left to near-duplicate removal.

Lines of under ``DEPTH`` tokens lead with all they have; only lines without a token are never dropped.
Nodes of at most ``HELD_LINES`` lines and ``HELD_TOKENS`` tokens are told apart within a task. Larger ones
are told apart by grouped counts, a round a level, until their parts are small enough: the same rules, so
the bounds decide where the work is done and never what comes out. Only lines of leaves that may recur
have their tokens fetched; counts are of hashes, pre-aggregated.

Cases: null and empty texts have no lines and stay as they are. Repeated rows are copies. Rows are known
by doc_id and a hash of their text. Of tokens of equal weight none is over half, so ties fix nothing; a
template is named by its least line hash. A document of boilerplate only keeps its row, with an empty text.
An empty table gives no rows. Other columns pass through under any name, but ``n_chars`` follows the new text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.llm import words as W
from pagegrain.llm.columns import pack, unpack
from pagegrain.sources.pages import spread
from pagegrain.storage import stash

DEPTH = 3
SIMILARITY = 0.75
MIN_DOCS = 5
MIN_SHARE = 0.5
EDGE = 3
OWN_SHARE = 0.1
HELD_LINES, HELD_TOKENS = 256, 1 << 22
BROADCAST_BYTES = 8 << 20
_VARIABLE = np.uint64(1)


class Lines:
    """The lines of several texts: their token runs, and hashes of their tokens with variable fields masked."""

    def __init__(self, batch: pa.RecordBatch):
        data, self.offs = W.texts_of(batch.column("text"))
        self.words = words = W.split(data, self.offs, W.SPACED)
        digits = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
        masked = words.hashes()
        masked[digits[words.end] > digits[words.start]] = _VARIABLE
        # A line ends at a line end or with its text: n line ends make n + 1 lines; an empty text has none.
        filled = np.flatnonzero(np.diff(self.offs))
        breaks = np.flatnonzero(data == 10)
        end = np.concatenate((self.offs[1:][filled], breaks))
        text = np.concatenate((filled, np.searchsorted(self.offs, breaks, side="right") - 1))
        order = np.argsort(end, kind="stable")
        end, self.text = end[order], text[order]
        self.first = np.searchsorted(words.start, np.concatenate(([0], end[:-1]))[: len(end)])
        self.tokens = np.searchsorted(words.start, end) - self.first
        self.masked, self.run = masked, W.RunHash(masked)
        self.hash = self.run(self.first, self.first + self.tokens)

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each of these lines: token count and leading tokens."""
        a, n = self.first[rows], self.tokens[rows]
        return W.mix(self.run(a, a + np.minimum(n, DEPTH)) ^ n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def edges(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and the last ``EDGE`` tokens of each of these lines."""
        a, n = self.first[rows], np.minimum(self.tokens[rows], EDGE)
        b = a + self.tokens[rows]
        return self.run(a, a + n), self.run(b - n, b)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different line of each text."""
    for whole in batches:
        for batch in W.chunks(whole):
            lines = Lines(batch)
            rows = np.flatnonzero(lines.tokens)
            rows = rows[np.lexsort((lines.hash[rows], lines.text[rows]))]
            text, h = lines.text[rows], lines.hash[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            rows, text, h = rows[new], text[new], h[new]
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(of), batch.column("text_hash").take(of), *(pa.array(x.view(np.int64)) for x in (lines.leaf(rows), h, *lines.edges(rows), lines.tokens[rows]))],
                ["row_id", "text_hash", "leaf", "line", "head", "tail", "n"],
            )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The masked tokens of the asked lines of each text."""
    for whole in batches:
        for batch in W.chunks(whole):
            lines, out = Lines(batch), []
            asked = batch.column("asked").to_pylist()
            at = np.searchsorted(lines.text, np.arange(len(asked) + 1))
            for k, wanted in enumerate(asked):
                wanted = {w["line"]: w for w in wanted}
                for r, h in enumerate(lines.hash[at[k] : at[k + 1]].view(np.int64).tolist(), int(at[k])):
                    if h in wanted:
                        a, n = int(lines.first[r]), int(lines.tokens[r])
                        out.append(wanted.pop(h) | {"tokens": lines.masked[a : a + n].view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, _FETCHED)


_FETCHED = pa.schema([("node", pa.int64()), ("line", pa.int64()), ("texts", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def templates_of(tokens: np.ndarray, texts: np.ndarray, lines: np.ndarray, gone: np.ndarray, min_docs: int, similarity: float = SIMILARITY) -> np.ndarray:
    """For each line of a node (a row of ``tokens``) whether it has a template, and which: rows of (1, least line) or (0, 0).

    ``texts`` are the weights, ``lines`` the hashes; ``gone`` says which positions are variable already.
    """
    size = tokens.shape[1]
    out = np.zeros((len(tokens), 2), np.int64)
    stack = [(np.arange(len(tokens)), gone)]
    while stack:
        rows, gone = stack.pop()
        x, weight = tokens[rows], texts[rows]
        total = weight.sum()
        if total < min_docs or size - gone.sum() < similarity * size:
            continue
        best, same = x[0].copy(), (x == x[0]).all(axis=0)
        fixed = same & ~gone
        for p in np.flatnonzero(~same & ~gone).tolist():
            kinds, which = np.unique(x[:, p], return_inverse=True)
            support = np.bincount(which, weight)
            top = int(support.argmax())
            best[p], fixed[p] = kinds[top], 2 * support[top] > total
        if fixed.sum() >= similarity * size:
            member = ((x == best) & fixed).sum(axis=1) >= similarity * size
            if weight[member].sum() >= min_docs:
                out[rows[member]] = 1, lines[rows[member]].min()
                stack.append((rows[~member], gone))
                continue
        varies = np.flatnonzero(~same & ~gone)
        loose = varies[~fixed[varies]]
        p = int(loose[0] if len(loose) else varies[0])
        kinds, which = np.unique(x[:, p], return_inverse=True)
        often = np.bincount(which, weight) >= min_docs
        stack += [(rows[which == k], gone) for k in np.flatnonzero(often).tolist()]
        stack.append((rows[~often[which]], gone | (np.arange(size) == p)))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows that come sorted by ``key``, one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != at[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _held(min_docs: int):
    """(line, template) of the lines of whole nodes; rows come sorted by node."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "node"):
            tokens = group.column("tokens").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
            lines, gone = group.column("line").to_numpy(), np.zeros(tokens.shape[1], bool)
            gone[group.column("gone")[0].as_py()] = True
            found = templates_of(tokens, group.column("texts").to_numpy(), lines, gone, min_docs)
            has = found[:, 0] == 1
            yield pa.RecordBatch.from_arrays([pa.array(lines[has]), pa.array(found[has, 1])], ["line", "template"])

    return judge


def _templates(state: DataFrame, min_docs: int) -> DataFrame:
    """(line, template) of the lines of ``state`` (node, line, texts, n, gone, tokens) that have one."""
    small, done = [], []
    while True:
        nodes = state.groupBy("node").agg(F.count("*").alias("kinds"), F.sum("texts").alias("total"), F.first("n").alias("n"), F.first("gone").alias("gone"))
        nodes = nodes.filter((F.col("total") >= min_docs) & (F.col("n") - F.size("gone") >= SIMILARITY * F.col("n")))
        nodes = stash(nodes.withColumn("large", (F.col("kinds") > HELD_LINES) | (F.col("kinds") * F.col("n") > HELD_TOKENS)), "nodes")
        placed = state.join(_small(nodes.select("node", "large")), "node")
        small.append(placed.filter("not large").drop("large"))
        if nodes.filter("large").isEmpty():
            break
        found, state = _round(placed.filter("large").drop("large"), nodes.filter("large"), min_docs)
        done.append(found)
    held = small[0]
    for part in small[1:]:
        held = held.unionByName(part)
    out = held.repartition("node").sortWithinPartitions("node").mapInArrow(_held(min_docs), "line long, template long")
    for part in done:
        out = out.unionByName(part)
    return out


def _round(large: DataFrame, nodes: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """One step of ``templates_of`` for all large nodes at once: (line, template) found, and the state of all other lines."""
    counted = large.select("node", "texts", F.posexplode("tokens").alias("pos", "token")).groupBy("node", "pos", "token").agg(F.sum("texts").alias("support"))
    counted = stash(counted, "tokens")
    best = counted.groupBy("node", "pos").agg(F.max(F.struct("support", "token")).alias("top"), F.sum("support").alias("total"))
    support = F.col("top.support")
    at = F.struct("pos", F.when(2 * support > F.col("total"), F.col("top.token")).alias("token"), (support == F.col("total")).alias("same"), (support >= min_docs).alias("often"))
    told = best.groupBy("node").agg(F.sort_array(F.collect_list(at)).alias("at")).join(nodes.select("node", "n", "gone"), "node")
    told = told.select("node", "n", "gone", F.transform("at", lambda x: F.when(~F.array_contains("gone", x["pos"]), x["token"])).alias("fixed"), F.filter("at", lambda x: ~x["same"] & ~F.array_contains("gone", x["pos"])).alias("open"))
    # Positions in the order in which they are taken. Those before the first with a frequent token split nothing: each makes one field more
    # variable and leaves the node's lines, weights and fixed tokens to the next, so they are taken in one step, and the node is dead if they are too many.
    told = told.withColumn("order", F.concat(F.filter("open", lambda x: x["token"].isNull()), F.filter("open", lambda x: x["token"].isNotNull())))
    told = told.withColumn("skipped", F.coalesce(F.array_position(F.transform("order", lambda x: x["often"]), F.lit(True)), F.lit(0)).cast("int") - 1)
    told = told.withColumn("skipped", F.when(F.col("skipped") < 0, F.size("order")).otherwise(F.col("skipped")))
    left = F.col("n") - F.size("gone") - F.col("skipped")
    told = told.select(
        "node", "fixed", F.get("order", F.col("skipped"))["pos"].alias("pos"), F.transform(F.slice("order", F.lit(1), F.col("skipped")), lambda x: x["pos"]).alias("variable"),
        ((left < SIMILARITY * F.col("n")) | (F.col("skipped") == F.size("order"))).alias("dead"),
    )
    agree = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.when(x, 1).otherwise(0))
    enough = (agree(F.transform("fixed", lambda t: t.isNotNull())) >= SIMILARITY * F.col("n")) & (agree(F.zip_with("tokens", "fixed", lambda t, f: t == f)) >= SIMILARITY * F.col("n"))
    judged = stash(large.join(_small(told), "node").select(*large.columns, "pos", "variable", "dead", enough.alias("member")), "judged")
    named = judged.filter("member").groupBy("node").agg(F.sum("texts").alias("total"), F.min("line").alias("template")).filter(F.col("total") >= min_docs)
    judged = judged.join(_small(stash(named.select("node", "template"), "named")), "node", "left")
    found = judged.filter("member and template is not null").select("line", "template")
    others = judged.filter("not member and template is not null").withColumn("node", F.xxhash64("node", F.lit("others")))
    split = judged.filter("template is null and not dead").withColumns({"token": F.get("tokens", F.col("pos")), "gone": F.concat("gone", "variable")})
    split = split.join(counted.filter(F.col("support") >= min_docs), ["node", "pos", "token"], "left")
    often = F.col("support").isNotNull()
    split = split.withColumns({"node": F.when(often, F.xxhash64("node", "pos", "token")).otherwise(F.xxhash64("node", "pos", F.lit("rare"))), "gone": F.when(often, F.col("gone")).otherwise(F.concat("gone", F.array("pos")))})
    columns = large.columns
    return stash(found, "found"), stash(others.select(*columns).unionByName(split.select(*columns)), "state")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "text_hash": F.xxhash64("text")})


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its numbers and lists of numbers take ``BROADCAST_BYTES`` at most."""
    lists = {f.name: 8 * len(getattr(f.dataType.elementType, "fields", "1")) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    row = sum((F.coalesce(F.size(c), F.lit(0)) * width for c, width in lists.items()), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _documents(parsed: DataFrame, common: DataFrame) -> DataFrame:
    """(text, own, least): of each text with common lines the least hash of its own lines, null if it has too few, and its two least common templates."""
    edges = stash(parsed.join(_small(common), "line").select("head", "tail").distinct(), "edges")
    heads, tails = (_small(edges.select(c).distinct().withColumn(f"same_{c}", F.lit(True))) for c in ("head", "tail"))
    lines = parsed.join(_small(common), "line", "left").join(heads, "head", "left").join(tails, "tail", "left")
    own = F.col("template").isNull() & F.col("same_head").isNull() & F.col("same_tail").isNull()
    # Repeated rows count all of a text's lines as often, which leaves the shares as they are.
    texts = lines.groupBy(F.col("text_hash").alias("text")).agg(
        F.count("*").alias("lines"), F.sum("n").alias("size"), F.count_if(own).alias("own_n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own_size"),
        F.min(F.when(own, F.col("line"))).alias("own"), F.slice(F.sort_array(F.collect_set("template")), 1, 2).alias("least"),
    )
    enough = (F.col("own_n") >= OWN_SHARE * F.col("lines")) | (F.col("own_size") >= OWN_SHARE * F.col("size"))
    return texts.filter(F.size("least") > 0).select("text", F.when(enough, F.col("own")).alias("own"), "least")


def recurring_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(row_id, text_hash, line): the lines to drop; ``rows`` has row_id, text_hash and text."""
    rows = rows.select("row_id", "text_hash", "text")
    parsed = stash(rows.mapInArrow(_parse, "row_id long, text_hash long, leaf long, line long, head long, tail long, n long"), "lines")
    texts = parsed.select("leaf", "line", "n", "text_hash").distinct()
    lines = stash(texts.groupBy("leaf", "line", "n").agg(F.count("*").alias("texts")), "counted")
    leaves = lines.groupBy("leaf").agg(F.sum("texts").alias("leaf_texts"), F.count("*").alias("kinds")).filter(F.col("leaf_texts") >= min_docs)
    placed = stash(lines.join(leaves, "leaf").select(F.col("leaf").alias("node"), "line", "n", "texts", "kinds"), "placed")

    # One document of each line that may share its template gives the tokens.
    asked = parsed.select("row_id", "text_hash", "line").join(placed.filter("kinds > 1").select("node", "line", "texts"), "line")
    asked = asked.groupBy("node", "line", "texts").agg(F.min(F.struct("row_id", "text_hash")).alias("x"))
    asked = stash(asked.groupBy("x.row_id", "x.text_hash").agg(F.collect_list(F.struct("node", "line", "texts")).alias("asked")), "asked")
    named = rows.join(_small(asked), ["row_id", "text_hash"]).select("text", "asked")
    state = named.mapInArrow(_fetch, "node long, line long, texts long, tokens array<long>").dropDuplicates(["line"])
    state = stash(state.select("node", "line", "texts", F.size("tokens").cast("long").alias("n"), F.array().cast("array<int>").alias("gone"), "tokens"), "state")
    single = placed.filter("kinds = 1").select("line", F.col("line").alias("template"))
    templates = stash(single.unionByName(_templates(state, min_docs)), "templates")

    # Common templates: first by an upper bound of their texts, then exactly.
    often = lines.select("line", "texts").join(templates, "line").groupBy("template").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= min_docs)
    often = stash(templates.join(often.select("template"), "template").select("line", "template"), "often")
    met = stash(parsed.join(_small(often), "line").select("template", F.col("text_hash").alias("text")).distinct(), "met")
    common = met.groupBy("template").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs).select("template")
    common = stash(often.join(common, "template").select("line", "template"), "common")

    other = F.when(F.col("least")[0] != F.col("template"), F.col("least")[0]).otherwise(F.get("least", F.lit(1)))
    met = met.join(_documents(parsed, common), "text").select("template", F.coalesce("own", other, F.lit(0)).alias("key"))
    found = met.groupBy("template", "key").agg(F.count("*").alias("texts")).groupBy("template").agg(F.count("*").alias("keys"), F.sum("texts").alias("texts"))
    found = found.filter((F.col("keys") >= min_docs) & (F.col("keys") >= F.lit(min_share) * F.col("texts"))).select("template")
    dropped = stash(common.join(found, "template").select("line"), "dropped")
    return parsed.select("row_id", "text_hash", "line").join(dropped, "line").select("row_id", "text_hash", "line")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text less the lines in ``gone``, and how many lines it had and lost."""
    for whole in batches:
        for batch in W.chunks(whole):
            gone = batch.column("gone").to_pylist()
            lines = Lines(batch)
            at = np.searchsorted(lines.text, np.arange(len(gone) + 1))
            texts = batch.column("text").to_pylist()
            total, lost = np.diff(at).tolist(), [0] * len(gone)
            for k, hashes in enumerate(gone):
                if hashes:
                    hashes = set(hashes)
                    own, filled = lines.hash[at[k] : at[k + 1]].view(np.int64).tolist(), lines.tokens[at[k] : at[k + 1]].tolist()
                    kept = [x for x, h, n in zip(texts[k].split("\n"), own, filled, strict=True) if not n or h not in hashes]
                    lost[k] = total[k] - len(kept)
                    texts[k] = "\n".join(kept)
            keep = [batch.column(c) for c in ("own", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], ["own", "doc_id", "text", "n_lines", "n_dropped"])


def _apply(docs: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Packed ``docs`` without recurring lines, and columns n_lines and n_dropped."""
    lines = recurring_lines(_rows(docs.select("doc_id", "text")), min_docs, min_share)
    gone = lines.groupBy("row_id", "text_hash").agg(F.collect_set("line").alias("gone"))
    packed = _rows(pack(docs, "doc_id", "text"))
    keyed = packed.alias("a").join(gone.alias("b"), (F.col("a.row_id") == F.col("b.row_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash")), "left")
    schema = T.StructType([*packed.schema.fields[:3], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return keyed.select("own", "doc_id", "text", "gone").mapInArrow(_drop, schema)


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with each text less its lines of recurring templates."""
    kept = unpack(_apply(docs, min_docs, min_share), docs.columns, "doc_id", "text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return _apply(docs, MIN_DOCS, MIN_SHARE).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
