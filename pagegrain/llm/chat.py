"""Operator 1: chat formatting at token level.

A turn is ``### role: text</turn>`` and a line end. Its role and its text are escaped (a backslash goes
before each backslash and each control string) and encoded as separate segments, so no token crosses
from a text into the template. The template itself is three reserved ids behind the vocabulary, spliced
around the segments; ordinary encoding never yields them. Where loss applies follows from the prefix
sums of segment lengths: the text segments of assistant turns.

Turns are escaped and encoded row by row, before any shuffle. Conversations are then put together from
sorted rows as a stream: a conversation comes in parts of at most ``PART`` tokens, so one of any number of
turns takes the memory of a batch and its longest turn. Its parts are one partition's, since its digest is of
its turns in order; what is left to do there are copies of token arrays.

Cases: a null text or role is empty. Turns of equal number are ordered by role, then text; a null turn
comes first; repeated rows are turns of their own. Rows with a null conv_id are one conversation.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.sources.pages import spread

PART = 32_768
_ROWS = 2048
TURN, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
#: Reserved ids, counted from the first id behind the vocabulary.
OPEN, NAMED, CLOSE = range(3)
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_ESCAPED_BYTES = re.compile(rb"\\(.)", re.S)
_CONTROL_TEXT = re.compile(r"\\|###|</turn>")


def default_vocabulary() -> str:
    """The byte-level vocabulary that the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL if role else _CONTROL_TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """A byte-level vocabulary with the reserved ids behind it."""

    def __init__(self, ranks: dict[bytes, int]):
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 2
        pieces = {i: b for b, i in ranks.items()} | {self.first + k: s.encode() for k, s in enumerate((TURN, ROLE_END, TURN_END))}
        self.size = np.zeros(self.first + 3, np.int64)
        for i, piece in pieces.items():
            self.size[i] = len(piece)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces[i] for i in sorted(pieces)), np.uint8)
        self.roles: dict[str, np.ndarray] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def encode_role(self, role: str) -> np.ndarray:
        if role not in self.roles:
            if len(self.roles) >= 1024:
                self.roles.clear()
            self.roles[role] = self.encode(escape(role, role=True))
        return self.roles[role]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some tokens, and where the bytes of each begin (with the end as a last one)."""
        size = self.size[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])], at

    def decode(self, ids) -> str:
        return self.spell(np.asarray(ids, np.int64))[0].tobytes().decode()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_CODECS: dict[bytes, Codec] = {}


def _sent(turns: DataFrame, vocabulary: str | None):
    """The vocabulary and its digest, which names it in the tasks that keep it."""
    ranks = read_ranks(vocabulary or default_vocabulary())
    return turns.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).digest(), ranks))


def _codec(sent) -> Codec:
    digest, ranks = sent.value
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(ranks)
    return _CODECS[digest]


def _lists(pieces: list[np.ndarray], cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(pieces) if pieces else [], kind))


def _encode(sent):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        opening, named, closing = (np.array([codec.first + k], np.int32) for k in (OPEN, NAMED, CLOSE))
        for batch in batches:
            keep = [c for c in batch.schema.names if c not in ("role", "text")]
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(roles), _ROWS):
                pieces, segments = [], []
                for role, text in zip(roles[at : at + _ROWS], texts[at : at + _ROWS], strict=True):
                    r, t = codec.encode_role(role or ""), codec.encode(escape(text or ""))
                    pieces += [opening, r, named, t, closing]
                    segments.append((len(r), len(t), role == LOSS_ROLE))
                # Prefix sums of the segments' lengths say where a turn's text begins and ends.
                sizes = np.array(segments, np.int64).reshape(-1, 3)
                begin = sizes[:, 0] + 2
                cuts = np.concatenate(([0], np.cumsum(begin + sizes[:, 1] + 1)))
                new = [_lists(pieces, cuts, pa.int32()), pa.array(begin.astype(np.int32)), pa.array((begin + sizes[:, 1] * sizes[:, 2]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, _ROWS) for c in keep), *new], [*keep, "ids", "loss_from", "loss_to"])

    return encode


def encode_turns(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, turn, tie, ids, loss_from, loss_to): each turn's tokens, and which of them bear loss."""
    sent = _sent(turns, vocabulary)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct("role", "text").alias("tie"), "role", "text")
    return rows.mapInArrow(_encode(sent), "conv_id long, turn long, tie struct<role string, text string>, ids array<int>, loss_from int, loss_to int")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each list begins (with the end as a last one)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations; rows come sorted by conversation and turn, and a conversation is not cut between partitions.

    The last conversation of a batch is held until its end is known, but for its full parts.
    """
    now: tuple | None = None
    part, ids, mask = 0, np.zeros(0, np.int32), np.zeros(0, bool)

    def parts(conv: tuple, x: np.ndarray, m: np.ndarray, part: int, last: bool) -> tuple[list, int, int]:
        """Rows of a conversation's tokens from ``part`` on, how many tokens they hold, and the next part."""
        rows, at = [], 0
        while len(x) - at > PART or last and at < len(x):
            rows.append((conv[0], part, x[at : at + PART], m[at : at + PART]))
            at, part = at + PART, part + 1
        return rows, min(at, len(x)), part

    def batch_of(rows: list) -> pa.RecordBatch:
        cuts = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), _lists([r[2] for r in rows], cuts, pa.int32()), _lists([r[3] for r in rows], cuts, pa.bool_())],
            ["conv_id", "part", "ids", "loss"],
        )

    for whole in batches:
        for first in range(0, whole.num_rows, _ROWS):
            batch, out = whole.slice(first, _ROWS), []
            x, at = _flat(batch.column("ids"))
            edge = np.zeros(len(x) + 1, np.int32)
            np.add.at(edge, at[:-1] + batch.column("loss_from").to_numpy(), 1)
            np.add.at(edge, at[:-1] + batch.column("loss_to").to_numpy(), -1)
            m = np.cumsum(edge[:-1]) > 0
            convs = batch.column("conv_id").to_pylist()
            begin = 0
            for k in range(1, len(convs) + 1):
                if k < len(convs) and convs[k] == convs[begin]:
                    continue
                if now != (convs[begin],):
                    if now is not None:
                        out += parts(now, ids, mask, part, True)[0]
                    now, part, ids, mask = (convs[begin],), 0, x[:0], m[:0]
                a, b = at[begin], at[k]
                ids, mask = (np.concatenate((ids, x[a:b])), np.concatenate((mask, m[a:b]))) if len(ids) else (x[a:b], m[a:b])
                rows, done, part = parts(now, ids, mask, part, False)
                out += rows
                ids, mask, begin = ids[done:], mask[done:], k
            yield batch_of(out)
    if now is not None:
        yield batch_of(parts(now, ids, mask, part, True)[0])


def format_conversations(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, part, ids, loss): the tokens of each conversation and their loss mask, long ones in several parts.

    The parts of a conversation follow each other in one partition.
    """
    encoded = encode_turns(turns, vocabulary)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    ordered = ordered.select("conv_id", "ids", "loss_from", "loss_to")
    return ordered.mapInArrow(_assemble, "conv_id long, part int, ids array<int>, loss array<boolean>")


_TOLD = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


class _Reading:
    """What is known of a conversation while its parts are read."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.n_loss = 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def read(self, codec: Codec, ids: np.ndarray, mask: np.ndarray) -> None:
        """Reads tokens up to the last end of a turn, and holds the rest."""
        ends = np.flatnonzero(ids == codec.first + CLOSE)
        if not len(ends):
            self.held.append((ids, mask))
            return
        cut = int(ends[-1]) + 1
        if self.held:
            before = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            x, m = np.concatenate((before[0], ids[:cut])), np.concatenate((before[1], mask[:cut]))
        else:
            x, m = ids[:cut], mask[:cut]
        self.held = [(ids[cut:], mask[cut:])] if cut < len(ids) else []
        raw, at = codec.spell(x)
        text = raw.tobytes()
        opens, names, closes = (np.flatnonzero(x == codec.first + k) for k in (OPEN, NAMED, CLOSE))
        for a, b, c, d in zip(at[opens + 1].tolist(), at[names].tolist(), at[names + 1].tolist(), at[closes].tolist(), strict=True):
            self.turns.update(_plain(text[a:b]) + b"\n" + _plain(text[c:d]) + b"\n")
        change = np.flatnonzero(np.diff(np.concatenate(([False], m, [False]))))
        for a, b in zip(at[change[::2]].tolist(), at[change[1::2]].tolist(), strict=True):
            said = _plain(text[a:b])
            self.loss.update(said)
            self.loss_chars += len(said.decode())
        self.n_turns += len(closes)
        self.chars += int(np.count_nonzero((raw & 0xC0) != 0x80))
        self.n_tokens += len(x)
        self.n_loss += int(m.sum())

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "n_tokens": self.n_tokens, "n_loss_tokens": self.n_loss}


def _plain(text: bytes) -> bytes:
    return _ESCAPED_BYTES.sub(rb"\1", text) if b"\\" in text else text


def _read_back(sent):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        schema = pa.schema([(c, pa.string() if c.endswith("256") else pa.int64()) for c in (x.split()[0] for x in _TOLD.split(", "))])
        now = None
        for batch in batches:
            out = []
            (ids, at), (mask, _) = _flat(batch.column("ids")), _flat(batch.column("loss"))
            convs, parts = batch.column("conv_id").to_pylist(), batch.column("part").to_pylist()
            for k in range(batch.num_rows):
                if parts[k] == 0:
                    if now is not None:
                        out.append(now.row())
                    now = _Reading(convs[k])
                now.read(codec, ids[at[k] : at[k + 1]], mask[at[k] : at[k + 1]].astype(bool))
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return read


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the tokens of ``format_conversations`` say: digests of turns and of the text under the loss mask."""
    return formatted.mapInArrow(_read_back(_sent(formatted, vocabulary)), _TOLD)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more))).drop("n_tokens", "n_loss_tokens")


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
             + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 14 AS size FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
