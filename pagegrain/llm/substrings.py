"""Operator 3: removal of passages that repeat anywhere, with suffix automata of reference shards.

Every word covered by a window of ``min_words`` words whose sequence also starts elsewhere (in the
same document or another) is removed. The corpus is its own reference. Sending an automaton of every
shard to every document would cost shards times documents, so shards are cut by content: each window
has an anchor (its least gram of ``ANCHORS[0]`` words by hash, the leftmost of equals), equal windows have equal
anchors, and the windows of a document that share an anchor form a fragment of at most
2 * min_words - ANCHORS[0] words. A shard holds the fragments of one anchor, so a fragment meets only the
shard that can hold its copies:

1. Fragments are counted by (anchor, digest of their words): a fragment that occurs twice repeats as
   a whole, and an anchor that occurs once has nothing to repeat. Both are settled by counts alone.
2. For the rest, the shard's suffix automaton is built with occurrence counts, and the shard's
   fragments stream through the states that occur at least twice: where the matching statistic
   reaches ``min_words``, that window repeats.
3. A shard of more than ``max_shard`` different fragments (a common phrase in ever new contexts) is
   not gathered in one task: its fragments are cut again by longer anchors (``ANCHORS``, at last the whole
   window), which equal windows share as well, and steps 1 and 2 settle the smaller shards that come of it.
   The bound decides where the work is done, never what comes out.

Two different fragments pass for one only if their 64-bit digests agree as well as their 64-bit
anchors; within the automaton words themselves are compared.

Cases: null, empty and short texts lose nothing; repeated rows are copies of each other and lose
every word that a window covers; rows are known by doc_id and a hash of their text, a null doc_id by
a longer hash of the text. An empty table gives no rows. Other columns pass through under any name;
``n_words`` and ``n_removed`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.llm import words as W
from pagegrain.llm.columns import pack, unpack
from pagegrain.sources.pages import spread
from pagegrain.storage import stash

MIN_WORDS = 35
ANCHORS = (8, 20)
MAX_SHARD = 512
_POSITION = np.uint64(0xFFFFFFFF)

FRAGMENT = "row_id long, row_no int, anchor long, digest long, start int, n int"


class SuffixAutomaton:
    """A suffix automaton of several word sequences, with the weighted number of places of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the longest string that p extends by ``word``: q itself, or its copy of that length."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, weight: int) -> None:
        """Adds a sequence that occurs ``weight`` times."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Sums the places of longer strings into their suffixes; call once, after the last ``add``."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def statistics(self, words: list, places: int = 2) -> Iterator[int]:
        """For each word, the length of the longest sequence ending there that occurs at least ``places`` times."""
        state, size = 0, 0
        for word in words:
            while True:
                to = self.next[state].get(word)
                if to is not None and self.count[to] >= places:
                    state, size = to, size + 1
                    break
                if state == 0:
                    size = 0
                    break
                state = self.link[state]
                size = self.length[state]
            yield size


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n, have, best = len(x) - width + 1, 1, x
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    return np.minimum(best[:n], best[width - have : width - have + n])


def _rows(docs: DataFrame) -> DataFrame:
    """Row keys: (row_id, row_no) stand for a row in joins."""
    return docs.withColumns({"row_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "row_no": F.hash("text")})


def _cut(found: W.Words, run: W.RunHash, min_words: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fragments of all texts: (first word, number of windows, anchor, digest), for anchors of ``width`` words."""
    windows = len(found.start) - min_words + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = np.arange(len(found.start) - width + 1)
    grams = run(at, at + width)
    keyed = (grams & ~_POSITION) | at.astype(np.uint64)
    anchor = (_sliding_min(keyed, min_words - width + 1) & _POSITION).astype(np.int64)
    owner = found.owner()
    inside = owner[:windows] == owner[min_words - 1 :]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:windows] != owner[: windows - 1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, windows))
    start, n = start[inside[start]], n[inside[start]]
    return start, n, grams[anchor[start]].view(np.int64), run(start, start + n + min_words - 1).view(np.int64)


def _fragments(min_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole):
                data, offs = W.texts_of(batch.column("text"))
                found = W.split(data, offs, W.SPACED)
                start, n, anchor, digest = _cut(found, W.RunHash(found.hashes()), min_words, ANCHORS[0])
                owner = found.owner()[start] if len(start) else start
                doc = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row_id").take(doc), batch.column("row_no").take(doc), pa.array(anchor), pa.array(digest),
                    pa.array((start - found.first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ], ["row_id", "row_no", "anchor", "digest", "start", "n"])

    return cut


def _again(min_words: int, width: int):
    """Fragments cut by longer anchors, each with its words and its fragment's number of places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole, column="words"):
                data, offs = W.texts_of(batch.column("words"))
                found = W.split(data, offs, W.SPACED)
                start, n, anchor, digest = _cut(found, W.RunHash(found.hashes()), min_words, width)
                owner = found.owner()[start] if len(start) else start
                words = pa.array([b" ".join(found.bytes_of(a, a + k + min_words - 1)).decode() for a, k in zip(start.tolist(), n.tolist(), strict=True)], pa.string())
                keep = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row_id").take(keep), batch.column("row_no").take(keep), pa.array(anchor), pa.array(digest),
                    pa.array((batch.column("start").to_numpy()[owner] + start - found.first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), batch.column("places").take(keep), words,
                ], ["row_id", "row_no", "anchor", "digest", "start", "n", "weight", "words"])

    return cut


def _contents(min_words: int):
    """The words of the asked fragments of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole):
                out = []
                for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                    words = text.encode().split()
                    for a in asked:
                        out.append(a | {"words": b" ".join(words[a["start"] : a["start"] + a["n"] + min_words - 1]).decode()})
                ids = [batch.column(c).take(pa.array(np.repeat(np.arange(batch.num_rows), [len(a) for a in batch.column("asked").to_pylist()]))) for c in ("row_id", "row_no")]
                if out:
                    rest = [pa.array([x[c] for x in out], kind) for c, kind in (("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("places", pa.int64()), ("crowded", pa.bool_()), ("words", pa.string()))]
                    yield pa.RecordBatch.from_arrays([*ids, *rest], ["row_id", "row_no", "anchor", "digest", "start", "n", "places", "crowded", "words"])

    return cut


def _shards(min_words: int):
    """Streams the fragments of each anchor through the anchor's automaton; rows come sorted by anchor."""

    def judge(rows: list[dict]) -> Iterator[dict]:
        if len(rows) < 2:
            return
        texts = [r["words"].encode().split() for r in rows]
        automaton = SuffixAutomaton()
        for r, words in zip(rows, texts, strict=True):
            automaton.add(words, r["places"])
        automaton.close()
        for r, words in zip(rows, texts, strict=True):
            if r["places"] > 1:
                continue  # settled: it repeats as a whole
            ends = [i + 1 for i, size in enumerate(automaton.statistics(words)) if size >= min_words]
            for a, b in _spans_of(ends, min_words):
                yield {"row_id": r["row_id"], "row_no": r["row_no"], "a": r["start"] + a, "b": r["start"] + b}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("row_no", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["anchor"] != row["anchor"]:
                    out += judge(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(list(judge(held)), schema)

    return stream


def _spans_of(ends: list[int], size: int) -> Iterator[tuple[int, int]]:
    """The union of the windows of ``size`` words with these ends, as spans."""
    for k, e in enumerate(ends):
        if not k or e > ends[k - 1] + 1:
            a = e - size
        if k + 1 == len(ends) or ends[k + 1] > e + 1:
            yield a, e


def _known(counted: DataFrame, max_shard: int) -> DataFrame:
    """(anchor, digest, places, crowded, open) of the fragments in ``counted`` (anchor, digest, places) whose anchor occurs more than once."""
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("places").alias("total"), F.min("places").alias("least")).filter("total > 1")
    return counted.join(anchors, "anchor").select("anchor", "digest", "places", (F.col("kinds") > max_shard).alias("crowded"), ((F.col("kinds") > 1) & (F.col("least") == 1)).alias("open"))


def repeated_spans(rows: DataFrame, min_words: int = MIN_WORDS, max_shard: int = MAX_SHARD) -> DataFrame:
    """(row_id, row_no, a, b): spans of words [a, b) covered by repeating windows; ``rows`` has row_id, row_no and text."""
    fragments = stash(rows.select("row_id", "row_no", "text").mapInArrow(_fragments(min_words), FRAGMENT), "fragments")
    known = stash(_known(fragments.groupBy("anchor", "digest").agg(F.count("*").alias("places")), max_shard), "known")
    met = stash(fragments.join(known, ["anchor", "digest"]), "met")

    whole_of = lambda x: x.select("row_id", "row_no", F.col("start").alias("a"), (F.col("start") + F.col("n") + (min_words - 1)).alias("b"))
    found = whole_of(met.filter("places > 1"))
    # One place of each open fragment gives its words.
    asked = met.filter("open").groupBy("anchor", "digest").agg(F.min(F.struct("row_id", "row_no", "start")).alias("x"), F.first("n").alias("n"), F.first("places").alias("places"), F.first("crowded").alias("crowded"))
    asked = asked.groupBy("x.row_id", "x.row_no").agg(F.collect_list(F.struct("anchor", "digest", F.col("x.start").alias("start"), "n", "places", "crowded")).alias("asked"))
    contents = rows.join(asked, ["row_id", "row_no"]).dropDuplicates(["row_id", "row_no"])
    contents = contents.select("row_id", "row_no", "text", "asked").mapInArrow(_contents(min_words), FRAGMENT + ", places long, crowded boolean, words string")
    contents = stash(contents, "contents")
    span = "row_id long, row_no int, a int, b int"
    for width in (*ANCHORS[1:], min_words):
        shards = contents.filter("not crowded").repartition("anchor").sortWithinPartitions("anchor")
        found = found.unionByName(shards.mapInArrow(_shards(min_words), span))
        crowded = contents.filter("crowded")
        if crowded.isEmpty():
            break
        cut = stash(crowded.mapInArrow(_again(min_words, min(width, min_words)), FRAGMENT + ", weight long, words string"), "cut")
        known = stash(_known(cut.groupBy("anchor", "digest").agg(F.sum("weight").alias("places")), max_shard), "known")
        met = stash(cut.join(known, ["anchor", "digest"]), "met")
        # A fragment of more places had all its windows settled before; here it only counts.
        found = found.unionByName(whole_of(met.filter("places > 1 and weight = 1")))
        first = F.min_by(F.struct("row_id", "row_no", "start", "n", "words"), F.struct("row_id", "row_no", "start")).alias("x")
        contents = met.filter("open").groupBy("anchor", "digest", "places", "crowded").agg(first)
        contents = stash(contents.select("x.row_id", "x.row_no", "anchor", "digest", "x.start", "x.n", "places", "crowded", "x.words"), "contents")
    return found


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in W.chunks(whole):
            texts, counts, gone = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans").to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["a"] for s in spans], 1)
                    np.add.at(edge, [s["b"] for s in spans], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone.append(len(words) - int(keep.sum()))
                    words = compress(words, keep.tolist())
                else:
                    gone.append(0)
                texts.append(b" ".join(words).decode())
            keep = [batch.column(c) for c in ("own", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["own", "doc_id", "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, max_shard: int = MAX_SHARD) -> DataFrame:
    """``docs`` with the kept words of each text joined by one space, and columns n_words and n_removed."""
    if min_words <= ANCHORS[0]:
        raise ValueError(f"min_words is over {ANCHORS[0]}")
    packed = pack(docs, "doc_id", "text")
    spans = repeated_spans(_rows(docs.select("doc_id", "text")).select("row_id", "row_no", "text"), min_words, max_shard)
    spans = spans.groupBy("row_id", "row_no").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    schema = T.StructType([*packed.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    kept = _rows(packed).join(spans, ["row_id", "row_no"], "left").select("own", "doc_id", "text", "spans").mapInArrow(_remove, schema)
    columns = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    return unpack(kept, columns, "doc_id", "text", n_words=F.col("n_words"), n_removed=F.col("n_removed"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
