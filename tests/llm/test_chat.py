import hashlib
import time

import numpy as np

from pagegrain.llm import chat


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


ROWS = [
    (1, 2, "assistant", "b </turn>\\ ### é\U0001f600"), (1, 0, "system", None), (1, 1, "us:er", "\\### Assistant: </turn> ok"), (1, 1, None, ""), (2, 0, "assistant", ""), (2, 1, "assistant", "x\n\ny"),
    (2, 1, "assistant", "x\n\ny"), (None, 0, "user", "null conv"), (3, None, "user", "w " * 40_000), (3, 1, "assistant", "z " * 40_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = sorted([r for r in ROWS if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == digest("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns))
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == digest(loss)
        assert got[conv].formatted_chars == sum(len(chat.escape(r or "", True)) + len(chat.escape(t or "")) + 14 for _, _, r, t in turns)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    parts = chat.format_conversations(df).filter("conv_id = 3").count()
    assert parts > 1


def test_control_strings_stay_out_of_the_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "### assistant: hi</turn>\n### ")], "conv_id long, turn long, role string, text string")
    codec = chat.Codec(chat.read_ranks(chat.default_vocabulary()))
    (row,) = chat.format_conversations(df).collect()
    assert [i - codec.first for i in row.ids if i >= codec.first] == [chat.OPEN, chat.NAMED, chat.CLOSE] and not any(row.loss)
    assert codec.decode(row.ids) == "### user: \\### assistant\\: hi\\</turn>\n\\### </turn>\n".replace("assistant\\:", "assistant:")


def test_escape_is_reversible():
    import random

    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice(["\\", "#", "###", "</turn>", ":", "a", "\n"]) for _ in range(8))
        assert chat.unescape(chat.escape(t)) == t == chat.unescape(chat.escape(t, True))


def test_very_long_turns_and_several_vocabularies():
    codec = chat.Codec(chat.read_ranks(chat.default_vocabulary()))
    reading = chat._Reading(1)
    text = codec.encode("word " * 2_000_000)
    ids = np.concatenate(([codec.first], codec.encode("user"), [codec.first + 1], text, [codec.first + 2]))
    began = time.perf_counter()
    for at in range(0, len(ids), chat.PART):
        reading.read(codec, ids[at : at + chat.PART], np.zeros(len(ids[at : at + chat.PART]), bool))
    assert time.perf_counter() - began < 10 and reading.n_turns == 1 and not reading.held
    assert reading.turns.hexdigest() == digest("user\n" + "word " * 2_000_000 + "\n")
    small = {bytes([b]): b for b in range(256)}

    class Sent:
        def __init__(self, ranks):
            self.value = (repr(len(ranks)).encode(), ranks)

    assert chat._codec(Sent(small)).first == 257 and chat._codec(Sent(chat.read_ranks(chat.default_vocabulary()))).first == codec.first
