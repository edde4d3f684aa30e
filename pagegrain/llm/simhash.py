"""Operator 10: SimHash near-duplicates, with candidates from the pigeonring principle.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of
the text's word shingles. Two fingerprints are linked at ``MAX_BITS`` (3) differing bits or fewer.

Candidates: the 64 bits are a ring of 8 segments. If a pair differs in at most 3 bits, some segment
starts a chain all of whose prefixes of l segments differ in at most floor(3 l / 8) bits: the first
two segments are equal, and of the next three at most one differs, and that in one bit. So each
chain start gives three keys of 32 bits (two segments and two of the next three), 24 keys a
fingerprint. Pairs under one key must pass the chain's budgets before the full Hamming check.

Copies never meet as pairs: equal fingerprints are one class, and a key's group yields a spanning
forest of its links, not the links. A group of over ``_LARGE`` fingerprints is cut again by its remaining
bits (in four parts, one of which must be equal) before it is shuffled, and once more within a task
if it must be, so no key is one task's and the work stays far from the square of its size.

Cases: null and empty texts have fingerprint zero, which is linked like any other. A null doc_id
has a fingerprint and takes part in links; a component of null ids only has a null component_id.
Repeated rows are copies of each other. An empty table gives no rows. Extra columns are ignored
(``near_duplicates``) or passed through (``deduplicate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from pagegrain.llm.columns import pack, unpack
from pagegrain.llm.components import connected_components
from pagegrain.sources.pages import spread
from pagegrain.storage import stash

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = 8
_SLICE = 1 << 16
_SMALL, _LARGE = 8, 1024
BROADCAST_ROWS = 200_000
_ALL = (1 << 64) - 1


def _segment(i: int) -> int:
    return 0xFF << (8 * (i % SEGMENTS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: (chain start, the 32 bits of the key) of each of the 24 keys.
KEYS = [
    (i, _segment(i) | _segment(i + 1) | _segment(a) | _segment(b))
    for i in range(SEGMENTS)
    for a, b in ((i + 2, i + 3), (i + 2, i + 4), (i + 3, i + 4))
]
N_KEYS = len(KEYS)
#: The same keys with one of four parts of their free bits as well: four for each.
KEYS += [(i, m | sum(1 << b for b in [b for b in range(64) if not m >> b & 1][part::4])) for part in range(4) for i, m in KEYS[:N_KEYS]]
#: For each chain start the bits of the first l segments and their budget, from l = 3 on.
CHAINS = [
    [(np.uint64(sum(_segment(i + j) for j in range(n))), n * MAX_BITS // SEGMENTS) for n in range(3, SEGMENTS + 1)]
    for i in range(SEGMENTS)
]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text (UTF-8), unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found)], [*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp): ``row_key`` is a hash of id and text that stands for the row in joins."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("row_key", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints, schema)


def _forest(fps: np.ndarray, passes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) that connect what ``passes`` links among ``fps``, at most one for each of ``fps``."""
    label = np.arange(len(fps))
    linked = passes(fps[:, None] ^ fps[None, :])
    while True:
        new = np.where(linked, label[None, :], len(fps)).min(axis=1)
        new = np.minimum(new, label)[np.minimum(new, label)]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fps)))
    return [(fps[own], fps[label[own]])]


def _group(fps: np.ndarray, free: list[int], passes) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links of one key's group; ``free``: the bits in which its members may differ."""
    if len(fps) <= _LARGE or len(free) < 8:  # under 8 free bits there are at most 128 members
        return _forest(fps, passes)
    out = []
    for part in range(4):
        bits = free[part::4]
        key = fps & np.uint64(sum(1 << b for b in bits))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rest = [b for b in free if b not in bits]
        for g in np.split(order, cuts):
            if len(g) > 1:
                out += _group(fps[g], rest, passes)
    return out


def _links_of(key: np.ndarray, mask: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links under each key; rows come sorted by (key number, masked bits) and are whole groups."""
    new = np.ones(len(fps), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(mask) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fps)))
    group = np.repeat(np.arange(len(first)), size)
    start_of_chain = np.array([i for i, _ in KEYS])

    def viable(chain: int):
        def passes(x: np.ndarray) -> np.ndarray:
            ok = np.ones(x.shape, bool)
            for bits, budget in CHAINS[chain]:
                ok &= np.bitwise_count(x & bits) <= budget
            return ok

        return passes

    small = np.flatnonzero((size[group] > 1) & (size[group] <= _SMALL))
    for step in range(1, _SMALL):
        a = small[small + step < len(fps)]
        a = a[group[a] == group[a + step]]
        if not len(a):
            break
        x = fps[a] ^ fps[a + step]
        chain = start_of_chain[key[a]]
        for c in range(SEGMENTS):
            mine = np.flatnonzero(chain == c)
            mine = mine[viable(c)(x[mine])]
            if len(mine):
                yield fps[a[mine]], fps[a[mine] + step]
    for g in np.flatnonzero(size > _SMALL).tolist():
        k = int(key[first[g]])
        free = [b for b in range(64) if not KEYS[k][1] >> b & 1]
        yield from _group(fps[first[g] : first[g] + size[g]], free, viable(KEYS[k][0]))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] = []

    def send(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _links_of(rows[0], rows[1], rows[2].view(np.uint64)):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "bits", "fp")])
        changed = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        if held and (held[-1][0, -1] != rows[0, 0] or held[-1][1, -1] != rows[1, 0]):
            yield from send(np.concatenate(held, axis=1))
            held = []
        cut = changed[-1] if len(changed) else 0
        if cut:
            yield from send(np.ascontiguousarray(np.concatenate([*held, rows[:, :cut]], axis=1)))
            held = []
        held.append(rows[:, cut:])
    if held:
        yield from send(np.ascontiguousarray(np.concatenate(held, axis=1)))


def links(classes: DataFrame) -> DataFrame:
    """Links (u, v) that connect every pair of the distinct fingerprints ``fp`` with at most MAX_BITS differing bits."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, (_, m) in enumerate(KEYS[:N_KEYS])])
    rows = classes.select("fp", F.explode(keys).alias("key")).select(F.col("key.k").alias("k"), F.col("key.bits").alias("bits"), "fp")
    large = stash(rows.groupBy("k", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > _LARGE).select("k", "bits"), "large")
    if not large.isEmpty():
        told = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
        masks = F.array(*[F.lit(_signed(m)) for _, m in KEYS])
        cut = F.transform(F.array(*[F.lit(N_KEYS * (part + 1)) for part in range(4)]), lambda p: F.struct((F.col("k") + p).alias("k"), F.col("fp").bitwiseAND(F.get(masks, F.col("k") + p)).alias("bits")))
        again = rows.join(told, ["k", "bits"], "left_semi").select("fp", F.explode(cut).alias("key")).select("key.k", "key.bits", "fp")
        rows = rows.join(told, ["k", "bits"], "left_anti").unionByName(again)
    return rows.repartition("k", "bits").sortWithinPartitions("k", "bits").mapInArrow(_links, "u long, v long")


def _components(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint."""
    classes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = connected_components(links(classes)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = stash(fingerprints(docs), "fingerprints")
    return fps.join(_components(fps), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id; of repeated rows one stays.

    A component whose ids are all null keeps one of its rows for each distinct text hash that is least.
    """
    rows = stash(fingerprints(docs), "fingerprints")
    placed = rows.join(_components(rows), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    chosen = placed.groupBy(F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull().alias("n")).agg(first.alias("x"), F.count("*").alias("of"))
    chosen = stash(chosen.select("x.doc_id", "x.row_key"), "kept")
    repeated = rows.groupBy("doc_id", "row_key").count().filter("count > 1").drop("count")
    repeated = stash(chosen.join(repeated, (chosen.doc_id.eqNullSafe(repeated.doc_id)) & (chosen.row_key == repeated.row_key), "left_semi"), "repeated")
    keyed = pack(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))

    def among(keys: DataFrame) -> DataFrame:
        same = F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.key") == F.col("c.row_key"))
        return keyed.alias("k").join(keys.alias("c"), same, "left_semi")

    kept = among(chosen.exceptAll(repeated)).unionByName(among(repeated).dropDuplicates(["doc_id", "key"]))
    return unpack(kept, docs.columns, "doc_id", "text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
