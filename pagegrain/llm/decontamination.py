"""Operator 8: benchmark decontamination by a broadcast set of normalised test n-grams.

Windows of ``n`` words of every benchmark item are hashed into a set, sent to all executors, and
looked up for every window of every document; each hit is then verified word by word. The set holds the
benchmark's text once and some 30 bytes a window. It is sent if the texts are ``broadcast_bytes`` at
most, by their measured size. A larger benchmark is not sent: hashed windows of both sides meet in a
partitioned join instead, and the hits are verified in the documents they were found in; same results.

Words: A-Z are lower-cased, then runs of digits, a-z and non-ASCII characters. An item with fewer
than ``n`` words, but at least one, is a single window.

Cases: a null or empty text has no words and no hits. Repeated rows are judged alike, repeated
benchmark texts each count under their own ``item_id`` (rows with the same id count once), which is taken
as a string. A null ``item_id`` takes part in hits but in no list of items. An empty benchmark hits
nothing. Result columns replace input columns of the same name; all others pass through under any name.
"""

from __future__ import annotations

from collections import defaultdict
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

N = 10
BROADCAST_BYTES = 8 << 20
_BITS = 20

_SPAN = "array<struct<start:bigint,end:bigint>>"
HITS = f"struct<n_words:bigint,hit_words:{_SPAN},hit_bytes:{_SPAN},items:array<string>>"
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("hit_words", _ARROW_SPAN), ("hit_bytes", _ARROW_SPAN), ("items", pa.list_(pa.string()))])

Item = tuple[str | None, str | None]


def windows_of(found: W.Words, n: int) -> dict[int, np.ndarray]:
    """For each window length, the first words of the windows of all items: ``n`` words, or all of a shorter item."""
    counts = np.diff(found.first)
    at = np.arange(max(0, len(found.start) - n + 1))
    owner = found.owner()
    out = {n: at[owner[at] == owner[at + n - 1]]}
    for size in np.unique(counts[(counts > 0) & (counts < n)]).tolist():
        out[size] = found.first[:-1][counts == size]
    return {size: starts for size, starts in out.items() if len(starts)}


class WindowSet:
    """The windows of a benchmark: for each length the sorted hashes of different windows, where each stands, and whose it is."""

    def __init__(self, items: list[Item], n: int):
        self.names = [name for name, _ in items]
        data, offs = W.texts_of(pa.array([t for _, t in items], pa.string()))
        self.words = W.split(W.LOWER[data], offs, W.ALNUM)
        run, owner = W.RunHash(self.words.hashes()), self.words.owner()
        self.tables = {}
        for size, starts in windows_of(self.words, n).items():
            h = run(starts, starts + size)
            order = np.argsort(h, kind="stable")
            h, starts = h[order], starts[order]
            cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
            hashes, first, owners = [], [], []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                # Different windows of one hash are told apart by their words.
                same: dict[tuple[bytes, ...], list[int]] = {}
                for s in starts[a:b].tolist():
                    same.setdefault(tuple(self.words.bytes_of(s, s + size)) if b - a > 1 else (), []).append(s)
                for group in same.values():
                    hashes.append(h[a])
                    first.append(group[0])
                    owners.append(np.unique(owner[group]))
            hashes = np.array(hashes, np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[hashes >> np.uint64(64 - _BITS)] = True
            self.tables[size] = hashes, first, owners, seen

    def hits(self, found: W.Words, run: W.RunHash) -> Iterator[tuple[int, int, int]]:
        """Verified (first word, length, number of the window) of every occurrence of a window."""
        total = len(found.start)
        for size, (hashes, first, _, seen) in self.tables.items():
            if total < size:
                continue
            starts = np.arange(total - size + 1)
            h = run(starts, starts + size)
            maybe = np.flatnonzero(seen[h >> np.uint64(64 - _BITS)])
            at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            equal = hashes[at] == h[maybe]
            maybe, at = maybe[equal], at[equal]
            inside = np.searchsorted(found.first, maybe, side="right") == np.searchsorted(found.first, maybe + size - 1, side="right")
            for s, k in zip(maybe[inside].tolist(), at[inside].tolist(), strict=True):
                own = found.bytes_of(s, s + size)
                while k < len(hashes) and hashes[k] == h[s]:
                    if self.words.bytes_of(first[k], first[k] + size) == own:
                        yield s, size, k
                    k += 1


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _told(found: W.Words, offs: np.ndarray, k: int, spans: list[tuple[int, int]], items: list[str]) -> dict:
    """What is said of text k, whose hit windows are ``spans`` of its words."""
    a, merged = int(found.first[k]), _merge(spans)
    return {
        "n_words": int(found.first[k + 1]) - a,
        "hit_words": [{"start": s, "end": e} for s, e in merged],
        "hit_bytes": [{"start": int(found.start[a + s] - offs[k]), "end": int(found.end[a + e - 1] - offs[k])} for s, e in merged],
        "items": items,
    }


def _scan(sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: WindowSet = sent.value
        for whole in batches:
            for batch in W.chunks(whole):
                data, offs = W.texts_of(batch.column("text"))
                found = W.split(W.LOWER[data], offs, W.ALNUM)
                spans, windows = defaultdict(list), defaultdict(set)
                for s, size, k in table.hits(found, W.RunHash(found.hashes())):
                    doc = int(np.searchsorted(found.first, s, side="right")) - 1
                    spans[doc].append((s - int(found.first[doc]), s + size - int(found.first[doc])))
                    windows[doc].add((size, k))
                rows = []
                for k in range(batch.num_rows):
                    owners = {int(i) for size, w in windows.get(k, ()) for i in table.tables[size][2][w]}
                    rows.append(_told(found, offs, k, spans.get(k, []), sorted({table.names[i] for i in owners} - {None})))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW_HITS)], [*batch.schema.names, "hits"])

    return scan


def _grams(n: int):
    """Each window of each item: its length, hash and words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole):
                data, offs = W.texts_of(batch.column("text"))
                found = W.split(W.LOWER[data], offs, W.ALNUM)
                run, owner = W.RunHash(found.hashes()), found.owner()
                for size, starts in windows_of(found, n).items():
                    words = pa.array([b" ".join(found.bytes_of(s, s + size)).decode() for s in starts.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item").take(pa.array(owner[starts])), pa.array(np.full(len(starts), size, np.int32)), pa.array(run(starts, starts + size).view(np.int64)), words], ["item", "size", "hash", "words"]
                    )

    return cut


def _windows(sizes: list[int], short=None):
    """Each different window of each document: its length, hash and first words. Of the lengths in ``short`` only those that hash to an item's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = short.value if short is not None else {}
        for whole in batches:
            for batch in W.chunks(whole):
                data, offs = W.texts_of(batch.column("text"))
                found = W.split(W.LOWER[data], offs, W.ALNUM)
                run, owner = W.RunHash(found.hashes()), found.owner()
                for size in sizes:
                    at = np.arange(max(0, len(found.start) - size + 1))
                    at = at[owner[at] == owner[at + size - 1]]
                    h = run(at, at + size).view(np.int64)
                    if size in asked:
                        near = np.isin(h, asked[size])
                        at, h = at[near], h[near]
                    order = np.lexsort((at, h, owner[at]))
                    at, h = at[order], h[order]
                    doc = owner[at]
                    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))))
                    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at - found.first[doc], pa.int32()))
                    of = pa.array(doc[first])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(of), batch.column("text_hash").take(of), pa.array(np.full(len(first), size, np.int32)), pa.array(h[first]), starts], ["id", "text_hash", "size", "hash", "starts"]
                    )

    return cut


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each document whose words are equal, and the windows they are."""
    for whole in batches:
        for batch in W.chunks(whole):
            data, offs = W.texts_of(batch.column("text"))
            found = W.split(W.LOWER[data], offs, W.ALNUM)
            out = []
            for k, near in enumerate(batch.column("near").to_pylist()):
                a = int(found.first[k])
                kept = []
                for x in near:
                    words = x["words"].encode()
                    starts = [s for s in x["starts"] if b" ".join(found.bytes_of(a + s, a + s + x["size"])) == words]
                    if starts:
                        kept.append({"size": x["size"], "words": x["words"], "starts": starts})
                out.append(kept)
            kind = pa.list_(pa.struct([("size", pa.int32()), ("words", pa.string()), ("starts", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(out, kind)], ["id", "text_hash", "windows"])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in W.chunks(whole):
            data, offs = W.texts_of(batch.column("text"))
            found = W.split(W.LOWER[data], offs, W.ALNUM)
            rows = [_told(found, offs, k, [(x["start"], x["start"] + x["size"]) for x in spans or ()], items or []) for k, (spans, items) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))]
            keep = [c for c in batch.schema.names if c not in ("spans", "items")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, _ARROW_HITS)], [*keep, "hits"])


def _join(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The hits of packed ``rows`` by a join of hashed windows. Equal rows are looked at once."""
    grams = stash(items.mapInArrow(_grams(n), "item string, size int, hash long, words string").distinct(), "grams")
    different = stash(grams.select("size", "hash", "words").distinct(), "windows")
    counts = {r.size: r.n for r in different.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most n rows
    sizes, short = sorted(counts), None
    if 8 * sum(m for size, m in counts.items() if size < n) <= BROADCAST_BYTES:
        # Windows of items of under n words are few, but any word may be one: documents send only those that hash alike.
        hashes: dict[int, list[int]] = {size: [] for size in sizes if size < n}
        for r in different.filter(F.col("size") < n).select("size", "hash").distinct().collect():
            hashes[r.size].append(r.hash)
        short = rows.sparkSession.sparkContext.broadcast({size: np.array(x, np.int64) for size, x in hashes.items()})
    keyed = rows.withColumns({"id": F.col("doc_id").cast("string"), "text_hash": F.xxhash64("text")})
    texts = keyed.filter(F.length("text") > 0).select("id", "text_hash", "text").dropDuplicates(["id", "text_hash"])
    met = texts.mapInArrow(_windows(sizes, short), "id string, text_hash long, size int, hash long, starts array<int>").join(different, ["size", "hash"])
    near = met.groupBy("id", "text_hash").agg(F.collect_list(F.struct("starts", "size", "words")).alias("near"))
    near = stash(near, "near")
    asked = texts.alias("t").join(near.alias("n"), F.col("t.id").eqNullSafe(F.col("n.id")) & (F.col("t.text_hash") == F.col("n.text_hash"))).select("t.id", "t.text_hash", "text", "near")
    hit = stash(asked.mapInArrow(_verify, "id string, text_hash long, windows array<struct<size:int,words:string,starts:array<int>>>"), "verified")
    owners = hit.select("id", "text_hash", F.explode("windows").alias("w")).select("id", "text_hash", "w.size", "w.words").distinct().join(grams, ["size", "words"])
    owners = owners.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = hit.alias("h").join(owners.alias("o"), F.col("h.id").eqNullSafe(F.col("o.id")) & (F.col("h.text_hash") == F.col("o.text_hash")))
    told = stash(told.select("h.id", "h.text_hash", F.flatten(F.transform("h.windows", lambda w: F.transform(w["starts"], lambda s: F.struct(s.alias("start"), w["size"].alias("size"))))).alias("spans"), "o.items"), "told")
    out = keyed.alias("k").join(told.alias("t"), F.col("k.id").eqNullSafe(F.col("t.id")) & (F.col("k.text_hash") == F.col("t.text_hash")), "left")
    return out.select("k.own", "k.doc_id", "k.text", "t.spans", "t.items").mapInArrow(_tell, _with_hits(rows))


def _with_hits(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("hits", T._parse_datatype_string(HITS))])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Packed ``docs`` (own, doc_id, text) and ``hits``: n_words, merged hit spans in words and in bytes, and item ids."""
    rows = pack(docs, "doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.length("text") > 0).distinct()
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        return _join(rows, items, n)
    sent = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()], n))
    return rows.mapInArrow(_scan(sent), _with_hits(rows))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, n, broadcast_bytes)
    n_hit = F.aggregate("hits.hit_words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, h in enumerate(batch.column("hits").to_pylist()):
            if h["hit_bytes"]:
                raw, at, kept = texts[k].encode(), 0, []
                for span in h["hit_bytes"]:
                    kept.append(raw[at : span["start"]])
                    at = span["end"]
                texts[k] = b" ".join(x.strip() for x in [*kept, raw[at:]]).decode().strip()
        yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("doc_id"), pa.array(texts, pa.string())], ["own", "doc_id", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit passages in their texts.

    A removed passage leaves one space; a document whose whole text was hit keeps its row with an empty text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    hits = find_hits(docs, benchmark, n, broadcast_bytes)
    if remove == "documents":
        kept = hits.filter(F.size("hits.hit_words") == 0)
    else:
        kept = hits.mapInArrow(_cut, T.StructType(hits.schema.fields[:3]))
    return unpack(kept, docs.columns, "doc_id", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM grams),
wins AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM low, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, wins.n AS n, item_id FROM wins JOIN grams USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
