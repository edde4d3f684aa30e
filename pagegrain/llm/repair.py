"""Operator 11: conversation structure repair by a cost DP and prefix-doubling path ranking.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Edits turn one into a right one: K keeps a row (0), R gives it
the role that is due, user or assistant (3), D deletes it (4; blank and duplicate rows must go), I inserts a row of the role that
is due (3); a truncated row that stays costs 3 more. A backward DP over (row, state) gives each node its cost to the end, so the optimal arcs
are known. A letter leads from a node to one other only, so a node's least audit begins with its least optimal letter. Nodes are ranked
by the first 1, 2, 4, ... letters of their least audits (the rank of a pair of ranks, one behind the other), and the pointers over that many
letters are doubled along. Conversations of a batch whose first nodes rank alike have the same audit, which is spelt once, through the doubled
pointers: in as many steps as its length has bits.

Rows meet by conversation, sorted. Each comes twice: first what the DP needs of it (its role's initial, its faults, a digest), for all
of the conversation, then, in the same order, its text, which is hashed under edits that are then known and held by nobody. A conversation is one
task's stream, since its digest is of its rows in order; of an open one some 200 bytes a row are held, no text. Nodes of a long one are ranked by
stretches of ``STRETCH`` rows: a least path enters each stretch at one node.

Cases: a null role or text is one space, a null turn comes first. Rows of equal turn are ordered by role, then text. A conversation
of which no row is left has zeros, an empty audit and the digest of the empty string. Rows with a null conv_id are one
conversation. Roles count by their initial alone, any other than s, u, a must be changed or deleted; an empty role has no initial. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.sources.pages import spread

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STRETCH = 1 << 15
_BATCH_ROWS = 1 << 13
#: Letters of edits in ASCII order, and what has been said so far: nothing, a system row, a user row, an assistant row.
LETTERS = "DIKR"
D, I, K, R = range(4)  # noqa: E741
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_DUE = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_NONE = -1
_WHITE = "\x20\x09-\x0d"


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows with planted faults: dropped (0 copies), emptied, without stops, repeated (2), of the wrong role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")), F.lit(20))
    said = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("kind"), said.alias("said"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(text("role")).alias("role"), F.col("said").alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def step(state: int, initial: str) -> int:
    """The state after a row whose role has this initial; ``_NONE`` if it may not come here."""
    if initial == "s":
        return SYSTEM if state == BEGIN else _NONE
    due = _DUE[state]
    return due if initial == ("u" if due == USER else "a") else _NONE


_KEPT = {initial: tuple(step(s, initial) for s in range(4)) for initial in ("s", "u", "a")}
_NEVER = (_NONE,) * 4
_FAR = 1 << 60


def _settled(cost: list[int]) -> list[int]:
    """Costs to the end of the four states at one place, insertions there included (two in a row suffice: a third never pays)."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[_DUE[s]]) for s, c in enumerate(cost)]
    return cost


def optimal_arcs(initials: list[str], must_go: list[bool], cut: list[bool]) -> tuple[int, np.ndarray, np.ndarray]:
    """(cost, letter, target): each node's least optimal letter and where it leads; node 4 i + s is state s before row i, its own target at the end."""
    n = len(initials)
    letter, target = np.full(4 * n + 4, _NONE, np.int8), np.arange(4 * n + 4)
    after = _settled([0, _FAR, _FAR, 0])
    told, led = letter.tolist(), target.tolist()
    for s in (SYSTEM, USER):
        told[4 * n + s], led[4 * n + s] = I, 4 * n + _DUE[s]
    for i in range(n - 1, -1, -1):
        kept, more = _KEPT.get(initials[i], _NEVER), TRUNCATED if cut[i] else 0
        now = [DELETE + c for c in after]
        if not must_go[i]:
            for s in range(4):
                now[s] = min(now[s], REROLE + more + after[_DUE[s]], KEEP + more + after[kept[s]] if kept[s] != _NONE else _FAR)
        now = _settled(now)
        for s in range(4):
            arcs = [(D, 4 * i + 4 + s, DELETE + after[s]), (I, 4 * i + _DUE[s], INSERT + now[_DUE[s]])]
            if not must_go[i]:
                arcs.append((R, 4 * i + 4 + _DUE[s], REROLE + more + after[_DUE[s]]))
                if kept[s] != _NONE:
                    arcs.append((K, 4 * i + 4 + kept[s], KEEP + more + after[kept[s]]))
            told[4 * i + s], led[4 * i + s] = min((a, t) for a, t, c in arcs if c == now[s])
        after = now
    return after[BEGIN], np.array(told, np.int8), np.array(led, np.int64)


def double(letter: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rank, pointers): nodes ranked by their least audits, and where 1, 2, 4, ... letters lead; a node that is its own target has no letter."""
    rank = letter.astype(np.int64) + 1
    pointers = [target]
    while True:
        reached = pointers[-1]
        pair = rank * (int(rank.max(initial=0)) + 1) + rank[reached]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        further = reached[reached]
        if np.array_equal(further, reached):
            return rank, pointers
        pointers.append(further)


def spell(letter: np.ndarray, pointers: list[np.ndarray], start: int, rows: int) -> tuple[np.ndarray, int]:
    """The letters of the path from ``start`` (over ``rows`` rows at most) and the node at its end: the nodes so far, doubled by the pointers over as many letters."""
    nodes = np.array([start])
    for jump in pointers[: (2 * rows + 3).bit_length()]:
        nodes = np.concatenate((nodes, jump[nodes]))
    told = letter[nodes]
    ended = np.flatnonzero(told == _NONE)
    return (told[: ended[0]], int(nodes[ended[0]])) if len(ended) else (told, int(pointers[0][nodes[-1]]))


class Open:
    """A conversation while its rows come: first what the DP needs, then, when its edits are known, the texts."""

    def __init__(self, conv: int | None):
        self.conv, self.seen, self.turns = conv, set(), [None, None, 0]
        self.initials: list[str] = []
        self.must_go: list[bool] = []
        self.cut: list[bool] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: str | None = None
        self.at, self.row, self.state, self.any, self.digest = 0, 0, BEGIN, False, hashlib.sha256()

    def note(self, turn: int | None, initial: str, blank: bool, cut: bool, key: bytes, copies: int) -> None:
        if not copies:
            return
        if turn is not None:
            least, most, different = self.turns
            self.turns = [turn if least is None else least, turn, different + (most is None or turn != most)]
        for _ in range(copies):
            seen = key in self.seen
            self.seen.add(key)
            self.blank += blank
            self.duplicate += seen and not blank
            self.truncated += cut and not seen and not blank
            self.illegal += bool(self.initials) and self.initials[-1] + initial not in ("su", "ua", "au")
            self.initials.append(initial)
            self.must_go.append(blank or seen)
            self.cut.append(cut and not blank and not seen)

    def gaps(self) -> int:
        least, most, different = self.turns
        return 0 if least is None else most - least + 1 - different

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _DUE[self.state]
            self.say(_ROLES[self.state], "")
            self.at += 1

    def read(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.insertions()
            edit = self.audit[self.at]
            if edit == "K":
                self.state = step(self.state, role[:1])
                self.say(role, text)
            elif edit == "R":
                self.state = _DUE[self.state]
                self.say(_ROLES[self.state], text)
            self.at += 1

    def result(self) -> tuple:
        self.insertions()
        return (self.conv, self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.digest.hexdigest())


def decide(conversations: list[Open]) -> None:
    """Costs and audits of conversations whose rows are all noted, ranked together (long ones by stretches)."""
    small, letters, targets, starts, at = [], [], [], [], 0
    for c in conversations:
        c.cost, letter, target = optimal_arcs(c.initials, c.must_go, c.cut)
        if len(c.initials) > STRETCH:
            c.audit = _by_stretches(letter, target)
            continue
        small.append(c)
        letters.append(letter)
        targets.append(target + at)
        starts.append(at + BEGIN)
        at += len(letter)
    if not small:
        return
    letter, target = np.concatenate(letters), np.concatenate(targets)
    rank, pointers = double(letter, target)
    spelt: dict[int, str] = {}
    for c, start in zip(small, starts, strict=True):
        key = int(rank[start])
        if key not in spelt:
            spelt[key] = "".join(LETTERS[k] for k in spell(letter, pointers, start, len(c.initials))[0])
        c.audit = spelt[key]


def _by_stretches(letter: np.ndarray, target: np.ndarray) -> str:
    out, node, size = [], BEGIN, 4 * STRETCH
    while True:
        begin = node // size * size
        end = min(begin + size, len(letter))
        own, led = letter[begin:end].copy(), target[begin:end] - begin
        # Nodes that a stretch is left by end the path within it; the next one goes on from there.
        leaving = led >= end - begin
        own[leaving], led[leaving] = _NONE, np.flatnonzero(leaving)
        told, last = spell(own, double(own, led)[1], node - begin, STRETCH)
        out.append(told)
        node = begin + last
        if letter[node] == _NONE:
            return "".join(LETTERS[k] for k in np.concatenate(out))
        out.append(letter[node : node + 1])
        node = int(target[node])


_TOLD = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (x.split()[0] for x in _TOLD.split(", "))])
    done: list[tuple] = []
    # Conversations of which all is noted, each with the texts that have come since; they are decided together.
    waiting: list[tuple[Open, list[tuple[str, str, int]]]] = []
    held, now, reading = 0, None, False

    def finish(last: bool) -> None:
        """Decides what waits and hashes its texts; the last conversation stays open unless it is over."""
        nonlocal waiting, held
        decide([c for c, _ in waiting if c.audit is None])
        for c, texts in waiting:
            for x in texts:
                c.read(*x)
            texts.clear()
        over = waiting if last else waiting[:-1]
        done.extend(c.result() for c, _ in over)
        waiting, held = ([] if last else waiting[-1:]), 0

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "late", "turn", "initial", "blank", "cut", "key", "role", "text", "copies")]
        for conv, late, turn, initial, blank, cut, key, role, text, copies in zip(*columns, strict=True):
            if now is None or now.conv != conv or reading and not late:
                now, reading = Open(conv), False
            if not late:
                now.note(turn, initial, blank, cut, key, copies)
                continue
            if not reading:
                reading = True
                waiting.append((now, []))
                held += len(now.initials)
            waiting[-1][1].append((role, text, copies))
            held += 1 + len(text or "") // 64
            if held >= _BATCH_ROWS:
                finish(False)
        if len(done) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done = []
    if waiting:
        finish(True)
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the least cost, the least of the cheapest audits, and the digest of the repaired rows.

    ``turns`` has conv_id, turn, role, text and copies, how often a row stands there (0: only its conversation counts).
    """
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id())
    last, stays, late = F.regexp_extract("text", f"([^{_WHITE}])[{_WHITE}]*\\z", 1), F.col("copies") > 0, F.col("late")
    key = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)), 1, 16)
    rows = placed.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("late")).select(
        "conv_id", "late", "place", F.when(~late, F.col("turn")).alias("turn"), F.substring("role", 1, 1).alias("initial"), F.when(~late, last == "").alias("blank"), F.when(~late, ~last.isin(".", "!", "?", "")).alias("cut"),
        F.when(~late, key).alias("key"), F.when(late & stays, F.col("role")).alias("role"), F.when(late & stays, F.col("text")).alias("text"), "copies",
    )
    # The sort moves no row to another partition: all of a conversation is there since the first one.
    return rows.sortWithinPartitions("conv_id", "late", "place").drop("place").mapInArrow(_repair, _TOLD)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_DUE_SQL = "CASE st WHEN 'U' THEN 'A' ELSE 'U' END"
#: Costs come by a recursion from the last row back, audits by one from the first row on. Two insertions suffice at one place.
SQL = rf"""
WITH RECURSIVE bits AS (SELECT i, (0 + i)::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 20 AS kind FROM src, crc_table),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy, row_number() OVER () AS r FROM keyed WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, r, copy) > 1 AS again,
            left(role, 1) AS c, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin FROM rows_),
f AS (SELECT *, fin = '' AS blank, fin <> '' AND again AS dup, fin NOT IN ('', '.', '!', '?') AND NOT again AS cut,
      coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS bad, coalesce(conv_id::VARCHAR, ' ') AS g FROM ordered),
told AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (bad) AS illegal FROM f GROUP BY g),
back AS (
  SELECT g, n AS i, 0::BIGINT AS b, 6::BIGINT AS s, 3::BIGINT AS u, 0::BIGINT AS a FROM told
  UNION ALL
  SELECT g, i - 1, least(b, 3 + u, 6 + a), least(s, 3 + u, 6 + a), least(u, 3 + a, 6 + u), least(a, 3 + u, 6 + a) FROM (
    SELECT k.g, k.i, least(4 + k.b, CASE WHEN go THEN 1000000000 ELSE p + least(3 + k.u, CASE f.c WHEN 'u' THEN k.u WHEN 's' THEN k.s ELSE 1000000000 END) END) AS b,
           least(4 + k.s, CASE WHEN go THEN 1000000000 ELSE p + least(3 + k.u, CASE f.c WHEN 'u' THEN k.u ELSE 1000000000 END) END) AS s,
           least(4 + k.u, CASE WHEN go THEN 1000000000 ELSE p + least(3 + k.a, CASE f.c WHEN 'a' THEN k.a ELSE 1000000000 END) END) AS u,
           least(4 + k.a, CASE WHEN go THEN 1000000000 ELSE p + least(3 + k.u, CASE f.c WHEN 'u' THEN k.u ELSE 1000000000 END) END) AS a
    FROM back k JOIN (SELECT *, blank OR dup AS go, CASE WHEN cut THEN 3 ELSE 0 END AS p FROM f) f ON f.g = k.g AND f.i = k.i WHERE k.i > 0)),
h AS (SELECT g, i, unnest(['B', 'S', 'U', 'A']) AS st, unnest([b, s, u, a]) AS cost FROM back),
arcs AS (
  SELECT h.g, h.i, h.st, 'D' AS e, h.i + 1 AS ti, h.st AS ts, 4 AS w, NULL AS line FROM h JOIN f ON f.g = h.g AND f.i = h.i + 1
  UNION ALL SELECT g, i, st, 'I', i, {_DUE_SQL}, 3, CASE st WHEN 'U' THEN 'assistant:' ELSE 'user:' END FROM h
  UNION ALL SELECT h.g, h.i, h.st, 'R', h.i + 1, {_DUE_SQL}, CASE WHEN cut THEN 6 ELSE 3 END, CASE st WHEN 'U' THEN 'assistant:' ELSE 'user:' END || f.text FROM h JOIN f ON f.g = h.g AND f.i = h.i + 1 WHERE NOT blank AND NOT dup
  UNION ALL SELECT h.g, h.i, h.st, 'K', h.i + 1, CASE c WHEN 's' THEN 'S' ELSE {_DUE_SQL} END, CASE WHEN cut THEN 3 ELSE 0 END, f.role || ':' || f.text FROM h JOIN f ON f.g = h.g AND f.i = h.i + 1
    WHERE NOT blank AND NOT dup AND (c = 's' AND st = 'B' OR c = lower({_DUE_SQL}))),
best AS (SELECT x.g, x.i, x.st, min({{'e': x.e, 'ti': x.ti, 'ts': x.ts, 'line': x.line}}) AS x FROM arcs x JOIN h p ON (p.g, p.i, p.st) = (x.g, x.i, x.st) JOIN h q ON (q.g, q.i, q.st) = (x.g, x.ti, x.ts)
         WHERE p.cost = x.w + q.cost GROUP BY x.g, x.i, x.st),
walk AS (SELECT g, 0::BIGINT AS i, 'B' AS st, 0 AS k, ''::VARCHAR AS audit, []::VARCHAR[] AS lines FROM told
  UNION ALL SELECT w.g, (b.x).ti, (b.x).ts, k + 1, audit || (b.x).e, CASE WHEN (b.x).line IS NULL THEN lines ELSE list_append(lines, (b.x).line) END FROM walk w JOIN best b ON (b.g, b.i, b.st) = (w.g, w.i, w.st)),
ends AS (SELECT g, max_by(audit, k) AS audit, max_by(lines, k) AS lines FROM walk GROUP BY g)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(h.cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g FROM conversations) s LEFT JOIN told USING (g) LEFT JOIN ends USING (g) LEFT JOIN h ON h.g = s.g AND h.i = 0 AND h.st = 'B'
"""
