"""Operator 13: byte-level BPE by a global shuffle of distinct words.

A text is cut into pre-tokens as the vocabulary's pattern would (contractions, runs of letters, digits, other signs
and white space, each with a leading space where there is one). Whole texts are gathered into chunks of about
``CHUNK_BYTES``; a chunk keeps its different words once and, for each text, the numbers of its words in order of position, frequent
words with small numbers. What is exploded and shuffled is thus (chunk, number, word), pre-aggregated: a word meets the
encoder once for the whole corpus, since its rows follow each other (one a chunk at most, so no word is a hot key), and its ids go back
to the chunks, where texts are put together by position. The texts' numbers are written once, bucketed by chunk, and do
not move again. Decoding joins ids with the table of the tokens' bytes, which is bounded by the vocabulary and broadcast.

Cases: a null or empty text has no tokens (ids an empty array). No special token is ever produced: their strings
are ordinary text. A text is never cut, however long; a text of over ``CHUNK_BYTES`` is a chunk of its own. Repeated rows are rows of their
own. All other columns pass through under any name; ``ids`` replaces a column of that name. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagegrain.llm.columns import REST, pack, quoted, unpack
from pagegrain.llm.words import chunks, texts_of
from pagegrain.sources.pages import spread
from pagegrain.storage import bucketed

CHUNK_BYTES = 32 << 20
_SENT_ROWS = 1 << 18
_SLICE = 1 << 20
OTHER, LETTER, DIGIT, SPACE = range(4)
#: What may follow an apostrophe in a contraction: fixed by the pattern.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def default_vocabulary() -> str:
    """The byte-level vocabulary that the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Encodes words, each as it stands, by the ranks of a vocabulary."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Ragged:
    """The bytes of a vocabulary's tokens, by id."""
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        size[i] = len(piece)
    return Ragged(np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8), size)


class Ragged:
    """Runs of values of different lengths, side by side."""

    def __init__(self, values: np.ndarray, size: np.ndarray):
        self.values, self.size, self.start = values, size, np.cumsum(size) - size

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs ``which`` one after the other, and their lengths."""
        size = self.size[which]
        at = np.cumsum(size) - size
        return self.values[np.repeat(self.start[which] - at, size) + np.arange(int(size.sum()))], size


@functools.cache
def kinds() -> np.ndarray:
    """Each code point's kind in the pattern, told by the library whose results count."""
    import tiktoken

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    kind = np.full(0x110000, OTHER, np.uint8)
    for k, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        only = tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = only.decode_bytes(only.encode_ordinary(text)).decode()
        kind[np.frombuffer(found.encode("utf-32-le"), "<u4")] = k
    return kind


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes at which pre-tokens begin, and the number of pre-tokens before each text (and in all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind, n = kinds()[point], len(point)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offs)] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change[:n])
    end = np.append(run[1:], n)
    begins = change[:n].copy()
    # A run of white space before something else gives up its last sign: a space goes to what follows, another stands alone.
    before = end[(kind[run] == SPACE) & ~first[end]]
    begins[before - 1] = True
    begins[before] = point[before - 1] != 32
    # An apostrophe that begins a pre-token takes the ending of a contraction with it.
    follows = np.flatnonzero((point[run[:-1]] == 39) & (end[:-1] - run[:-1] == 1) & begins[run[:-1]] & (kind[run[1:]] == LETTER) & ~first[run[1:]])
    at, stop = run[follows] + 1, end[follows + 1]
    padded = np.append(point, [0, 0])
    for ending in ENDINGS:
        size = len(ending)
        fits = at + size <= stop
        for k, sign in enumerate(ending):
            fits &= padded[at + k] == ord(sign)
        begins[at[fits]] = False
        rest = at[fits & (at + size < stop)] + size
        begins[rest] = True
    starts = lead[begins]
    return starts, np.searchsorted(starts, offs)


def pack_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**28 as bytes of seven bits, low ones first, and the bytes of each."""
    size = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        m = size > k
        out[at[m] + k] = ((numbers[m] >> (7 * k)) & 127) | np.where(size[m] > k + 1, 128, 0)
    return out, size


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        m = begin + k <= last
        out[m] |= (data[begin[m] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _packed(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of numbers, cut at these places, as packed bytes."""
    data, size = pack_numbers(numbers)
    return _binary(data, np.concatenate(([0], np.cumsum(size)))[cuts])


def _cut(chunk_bytes: int):
    """Chunks: their texts as numbers of words, and a row of their different words."""

    def flush(rows: list[pa.RecordBatch], words: list[pa.DictionaryArray], counts: list[np.ndarray], number: int) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 32) | number
        found = pa.chunked_array(words).unify_dictionaries().chunks
        different = found[0].dictionary
        times = np.zeros(len(different), np.int64)
        for part in found:
            times += np.bincount(part.indices.to_numpy(), minlength=len(different))
        order = np.argsort(-times, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        rank = rank.astype(np.int32)
        for own, n, part in zip(rows, counts, found, strict=True):
            k = own.num_rows
            codes, size = pack_numbers(rank[part.indices.to_numpy()])
            cuts = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(k, chunk)), _binary(codes, cuts), pa.nulls(k, pa.list_(pa.string()))], [REST, "chunk", "codes", "words"])
        if len(order):
            told = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), different.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, rows[0].column(0).type), pa.array([chunk], pa.int64()), pa.nulls(1, pa.binary()), told], [REST, "chunk", "codes", "words"])
        pa.default_memory_pool().release_unused()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, counts, held, number = [], [], [], 0, 0
        for whole in batches:
            for batch in chunks(whole):
                data, offs = texts_of(batch.column("text"))
                starts, before = pre_tokens(data, offs)
                cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int32).tobytes())
                words.append(pa.StringArray.from_buffers(len(starts), cuts, pa.py_buffer(data.tobytes())).dictionary_encode())
                counts.append(np.diff(before))
                rows.append(batch.select([REST]))
                held += len(data)
                if held >= chunk_bytes:
                    yield from flush(rows, words, counts, number)
                    rows, words, counts, held, number = [], [], [], 0, number + 1
        if rows:
            yield from flush(rows, words, counts, number)

    return cut


def _encode(path: str):
    """Rows sorted by word -> a row for each chunk among some 260,000 of them: numbers of words, how many ids each has, the ids, all packed."""

    def packed(chunk: list[np.ndarray], local: list[np.ndarray], size: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        c = np.concatenate(chunk)
        order = np.argsort(c, kind="stable")
        c, sizes = c[order], np.concatenate(size)
        flat, _ = Ragged(np.concatenate(ids), sizes).take(order)
        edge = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
        ends = np.concatenate(([0], np.cumsum(sizes[order])))[edge]
        told = [(np.concatenate(local)[order], edge), (sizes[order], edge), (flat, ends)]
        return pa.RecordBatch.from_arrays([pa.array(c[edge[:-1]]), *(_packed(*x) for x in told)], ["chunk", "local", "n", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        word, spelt, held, rows = None, None, ([], [], [], []), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("word").dictionary_encode()
            different = found.dictionary.to_pylist()
            known = [spelt] if different[0] == word else []
            known += [np.array(x, np.int32) for x in encoding.encode_ordinary_batch(different[len(known) :], num_threads=1)]
            word, spelt = different[-1], known[-1]
            which = found.indices.to_numpy()
            ids, size = Ragged(np.concatenate(known), np.array([len(x) for x in known])).take(which)
            for part, new in zip(held, (batch.column("chunk").to_numpy(), batch.column("local").to_numpy(), size, ids), strict=True):
                part.append(new)
            rows += len(which)
            if rows >= _SENT_ROWS:
                yield packed(*held)
                held, rows = ([], [], [], []), 0
        if rows:
            yield packed(*held)

    return encode


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column side by side, and where each row's begin (with the end as a last one)."""
    whole = column.combine_chunks().cast(pa.large_binary())
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``_SLICE`` values each; a larger row is a run of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")))
        yield at, to
        at = to


def _assemble(then: Callable[[pa.RecordBatch], pa.RecordBatch] | None):
    """Puts the texts of a chunk together, some at a time; ``then`` turns their (own, ids) into what is asked for."""

    def assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        local, n, ids = (unpack_numbers(_bytes(words.column(c))[0]) for c in ("local", "n", "ids"))
        spelt, place = Ragged(ids.astype(np.int32), n), np.empty(len(local), np.int64)
        place[local] = np.arange(len(local))
        data, offs = _bytes(texts.column("codes"))
        own, made = texts.column(REST).combine_chunks(), []
        for a, b in _slices(np.diff(offs)):
            part = data[offs[a] : offs[b]]
            # Which word is the first of each text: as many words end before it as bytes under 128.
            first = np.searchsorted(np.flatnonzero(part < 128), offs[a : b + 1] - offs[a])
            got, each = spelt.take(place[unpack_numbers(part)])
            ends = np.concatenate(([0], np.cumsum(each)))[first]
            told = pa.RecordBatch.from_arrays([own.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got, pa.int32()))], [REST, "ids"])
            made.append(told if then is None else then(told))
        return pa.Table.from_batches(made)

    return assemble


def _typed(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _encoded(docs: DataFrame, kept: list[str], text: str, path: str, chunk_bytes: int, then: Callable | None, schema: str) -> DataFrame:
    """What ``then`` makes of (own, ids), where own holds the columns ``kept``."""
    rows = docs.select((F.struct(*map(quoted, kept)) if kept else F.lit(True)).alias(REST), quoted(text).cast("string").alias("text"))
    own = StructType([StructField(REST, rows.schema[REST].dataType)])
    cut = bucketed(spread(rows).mapInArrow(_cut(chunk_bytes), StructType([*own.fields, *_typed("chunk long, codes binary, words array<string>")])), "words", "chunk")
    words = cut.filter("words is not null").select("chunk", F.posexplode("words").alias("local", "word"))
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode(path), "chunk long, local binary, n binary, ids binary")
    texts = cut.filter("codes is not null").select(REST, "chunk", "codes")
    return texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_assemble(then), StructType([*(own.fields if then is None else ()), *_typed(schema)]))


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the tokens of each whole text, in place of the text."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "ids")]
    return unpack(_encoded(docs, kept, text, vocabulary or default_vocabulary(), chunk_bytes, None, "ids array<int>"), kept, ids=F.col("ids"))


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)


def _decoded(path: str, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch, their ids, where each row's begin, the bytes of all, and where each row's begin (ends last)."""
    known = pieces(path)
    for a, b in _slices(_lengths(batch.column("ids"))):
        part = batch.slice(a, b - a)
        ids, at = part.column("ids").flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(_lengths(part.column("ids")))))
        data, each = known.take(ids)
        yield part, ids, at, data, np.concatenate(([0], np.cumsum(each)))[at]


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, data, ends in _decoded(path, batch):
                yield pa.RecordBatch.from_arrays([part.column(REST), part.column("ids"), _binary(data, ends)], [REST, "ids", "decoded"])

    return decode


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded`` (binary), the bytes of ``ids``; null ids decode to nothing. ``decoded`` replaces a column of that name."""
    kept = [c for c in tokens.columns if c.lower() not in ("ids", "decoded")]
    rows = pack(tokens.select(*map(quoted, kept), "ids"), "ids")
    schema = StructType([rows.schema[REST], *_typed("ids array<int>, decoded binary")])
    return unpack(rows.mapInArrow(_decode(vocabulary or default_vocabulary()), schema), kept, ids=F.col("ids"), decoded=F.col("decoded"))


_TOLD = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _told(path: str):
    """The digests of ids and of what they decode to."""

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = lambda data, ends: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        sizes, of_ids, of_bytes = [], [], []
        for _, ids, at, data, ends in _decoded(path, batch):
            sizes += np.diff(at).tolist()
            of_ids += digests(ids.astype("<u4").view(np.uint8), 4 * at)
            of_bytes += digests(data, ends)
        columns = [batch.column(REST).field("doc_id"), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _TOLD.split(", ")])

    return told


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = default_vocabulary()
    # Digests are made where texts are put together: another helper would be another process beside each task's.
    return _encoded(docs, ["doc_id"], "text", path, CHUNK_BYTES, _told(path), _TOLD)
