from collections import Counter, defaultdict

import numpy as np

from pagegrain.llm import lines
from pagegrain.llm.words import chunks
from tests.llm.conftest import CLASHING, EDGE

import pyarrow as pa


def tokens(line):
    return tuple("*" if any(c in "0123456789" for c in t) else t for t in line.split())


def hashes(known):
    """The operator's hash of each line, which only orders lines here."""
    order = sorted(known)
    parsed = lines.Lines(pa.RecordBatch.from_pydict({"text": ["\n".join(" ".join("0" if t == "*" else t for t in x) for x in order)]}))
    return dict(zip(order, parsed.hash.view(np.int64).tolist(), strict=True))


def told_apart(members, weight, n, gone, min_docs):
    """The templates among lines of one node, as sets of lines."""
    total = sum(weight[t] for t in members)
    if total < min_docs or n - len(gone) < lines.SIMILARITY * n:
        return []
    fixed, varies = {}, []
    for p in range(n):
        if p in gone:
            continue
        support = Counter()
        for t in members:
            support[t[p]] += weight[t]
        token, most = support.most_common(1)[0]
        if 2 * most > total:
            fixed[p] = token
        if len(support) > 1:
            varies.append((p in fixed, p, support))
    if len(fixed) >= lines.SIMILARITY * n:
        near = {t for t in members if sum(t[p] == token for p, token in fixed.items()) >= lines.SIMILARITY * n}
        if sum(weight[t] for t in near) >= min_docs:
            return [near, *told_apart(members - near, weight, n, gone, min_docs)]
    _, p, support = min(varies, key=lambda v: v[:2])
    often = [token for token, s in support.items() if s >= min_docs]
    out = []
    for token in often:
        out += told_apart({t for t in members if t[p] == token}, weight, n, gone, min_docs)
    return out + told_apart({t for t in members if t[p] not in often}, weight, n, gone | {p}, min_docs)


def brute(rows, min_docs=lines.MIN_DOCS, share=lines.MIN_SHARE):
    """Each text less the lines to drop, from the definitions alone."""
    texts = {t: {tokens(x) for x in t.split("\n") if x.split()} for _, t in rows if t}
    weight = Counter(x for own in texts.values() for x in own)
    order, leaves = hashes(weight), defaultdict(set)
    for t in weight:
        leaves[len(t), t[: lines.DEPTH]].add(t)
    template = {}
    for (n, _), members in leaves.items():
        for found in told_apart(members, weight, n, frozenset(), min_docs):
            template |= dict.fromkeys(found, min(order[t] for t in found))
    spread = defaultdict(set)
    for text, own in texts.items():
        for t in own & template.keys():
            spread[template[t]].add(text)
    template = {t: name for t, name in template.items() if len(spread[name]) >= min_docs}
    heads, tails = {t[: lines.EDGE] for t in template}, {t[-lines.EDGE :] for t in template}
    keys = defaultdict(set)
    for text, all_lines in texts.items():
        own = [t for t in all_lines if t not in template and t[: lines.EDGE] not in heads and t[-lines.EDGE :] not in tails]
        names = sorted({template[t] for t in all_lines & template.keys()})
        enough = len(own) >= lines.OWN_SHARE * len(all_lines) or sum(map(len, own)) >= lines.OWN_SHARE * sum(map(len, all_lines))
        for name in names:
            others = [x for x in names[:2] if x != name]
            keys[name].add((min((order[t] for t in own), default=others[0] if others else 0) if enough else others[0] if others else 0, text))
    gone = set()
    for name, found in keys.items():
        n = len({k for k, _ in found})
        if n >= min_docs and n >= share * len(found):
            gone |= {t for t in template if template[t] == name}
    return ["\n".join(x for x in t.split("\n") if tokens(x) not in gone) if t else t for _, t in rows]


def test_equals_brute_force(real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(real_docs, 3).collect()}
    assert [got[d] for d, _ in rows] == brute(rows, 3)


def test_variable_fields_and_copies(docs_of):
    rows = [(d, f"{chr(97 + d) * 3} own {chr(107 + d)} line {chr(98 + d)} stands here\nPage {d} of 20 printed for you\nread more about {chr(97 + d)} in our shop now today\nlast {chr(120 - d)} word there is") for d in range(8)]
    rows += [(100 + k, "copied text has a line\nand one more line of it\nthat others lack") for k in range(30)]
    got = {r.doc_id: r for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
    assert got[3].text == "ddd own n line e stands here\nlast u word there is" and got[3].n_chars == len(got[3].text)
    assert got[110].text == rows[18][1]
    assert [got[d].text for d, _ in rows] == brute(rows)


def test_edges(docs_of):
    docs = docs_of(EDGE, CLASHING)
    out = lines.drop_recurring_lines(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted((d or -1, t or "") for d, t in EDGE)
    assert lines.drop_recurring_lines(docs.limit(0)).count() == 0
    all_dropped = lines.drop_recurring_lines(docs_of([(d, f"own words {'abcdefgh'[d]} stand here\nthe one line for all") for d in range(8)] + [(50, "the one line for all")]))
    assert {r.doc_id: r.text for r in all_dropped.collect()}[50] == ""


def test_lines_match_split():
    texts = ["a\nb", "", "\n", "x\n", "\n\ny z\n", None, "q"]
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for batch in chunks(whole):
        p = lines.Lines(batch)
        assert np.bincount(p.text, minlength=len(texts)).tolist() == [len(t.split("\n")) if t else 0 for t in texts]
        assert p.tokens.tolist() == [len(x.split()) for t in texts if t for x in t.split("\n")]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_blocks_of_several_lines_go(docs_of):
    import random

    for block, own in ((3, 1), (10, 3), (10, 10), (20, 5)):
        rng = random.Random(block)
        menu = [prose(rng, 4 + k % 5) for k in range(block)]
        texts = [[prose(rng, 9) for _ in range(own)] for _ in range(40)]
        got = lines.drop_recurring_lines(docs_of([(d, "\n".join(menu + t)) for d, t in enumerate(texts)])).collect()
        assert {r.doc_id: r.text for r in got} == {d: "\n".join(t) for d, t in enumerate(texts)}, (block, own)


def test_edited_copies_stay(docs_of):
    import random

    rng = random.Random(1)
    whole = [prose(rng, 8 + k % 5) for k in range(20)]
    rows = []
    for d in range(40):
        text = [line.split() for line in whole]
        for k in rng.sample(range(20), 4):
            at = rng.randrange(len(text[k]))
            text[k][at : at + 1] = rng.choice([[prose(rng, 1)], [], [prose(rng, 1), prose(rng, 1)]])
        rows.append((d, "\n".join([" ".join(t) for t in text] + ([prose(rng, 9)] if d % 2 else []))))
    assert {r.doc_id: r.text for r in lines.drop_recurring_lines(docs_of(rows)).collect()} == dict(rows)


def test_short_lines_go(docs_of):
    import random

    rng = random.Random(2)
    own = [[prose(rng, 8), prose(rng, 1), prose(rng, 7)] for _ in range(12)]
    rows = [(d, "\n".join(["Advertisement", a, "", b, "Read more", c] + (["Rarely"] if d < 3 else []))) for d, (a, b, c) in enumerate(own)]
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
    assert got == {d: "\n".join([a, "", b, c] + (["Rarely"] if d < 3 else [])) for d, (a, b, c) in enumerate(own)}


def _templates_by_rounds(spark, rows, min_docs):
    """The templates that the operator finds in one leaf, whatever the bound of what a task holds."""
    order = hashes(rows)
    state = spark.createDataFrame([(1, order[t], w, len(t), [], [hash(x) for x in t]) for t, w in rows.items()], "node long, line long, texts long, n long, gone array<int>, tokens array<long>")
    return {r.line: r.template for r in lines._templates(state, min_docs).collect()}


def test_leaves_of_any_size_give_the_same_templates(spark, monkeypatch):
    import random

    for seed in (1, 2):
        rng = random.Random(seed)
        pick = lambda base, share: tuple(base[:3]) + tuple(rng.choice("qrstuvwx") + rng.choice("abcd") if rng.random() < share else b for b in base[3:])
        bases = [[c + "stuvwxyzr"[k] for k in range(9)] for c in "mno"[: 1 + seed % 3]]
        for b in bases:
            b[:3] = ["a", "b", "c"]
        rows = Counter()
        for _ in range(150):
            rows[pick(rng.choice(bases), rng.choice([0, 0.1, 0.3]))] += rng.randint(1, 3)
        order = hashes(rows)
        want = {order[t]: min(order[x] for x in found) for found in told_apart(set(rows), rows, 9, frozenset(), 5) for t in found}
        assert _templates_by_rounds(spark, rows, 5) == want
        monkeypatch.setattr(lines, "HELD_LINES", 16)
        assert _templates_by_rounds(spark, rows, 5) == want and want
        monkeypatch.undo()


def test_large_leaves_are_dropped_as_small_ones(docs_of):
    import random

    for n in (1000, 1100, 5000):
        rng = random.Random(n)
        names = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n)]
        rows = [(d, f"{prose(rng, 6)}\nShare this article with {name} on our site\n{prose(rng, 7)}") for d, name in enumerate(names)]
        assert len(set(names)) == n
        got = {r.doc_id: r.text for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
        assert got == {d: "\n".join(t.split("\n")[::2]) for d, t in rows}


def test_every_internal_name_passes_through(docs_of):
    import random

    rng = random.Random(9)
    names = ["own", "row_id", "text_hash", "_lines", "_id", "_hash", "_n_lines", "n_lines", "n_dropped", "gone", "line", "Node", "template", "leaf", "a"]
    rows = [(d, f"{prose(rng, 9)}\nthe one line for all") for d in range(8)]
    out = lines.drop_recurring_lines(docs_of(rows, [(c, f"mine {c}") for c in names]))
    assert [(r.doc_id, r.text) for r in out.orderBy("doc_id").collect()] == [(d, t.split("\n")[0]) for d, t in rows]
    assert all(r[c] == f"mine {c}" for r in out.collect() for c in names)


def test_recall_of_planted_templates(docs_of):
    import random

    rng = random.Random(4)
    planted = [prose(rng, rng.randint(4, 14)).split() for _ in range(30)]
    rows, want = [], []
    for d in range(300):
        keep = [prose(rng, rng.randint(5, 12)) for _ in range(4)]
        more = []
        for t in rng.sample(planted, 3):
            t = list(t)
            if len(t) > 4:
                t[rng.randrange(3, len(t))] = rng.choice([str(rng.randint(0, 999)), prose(rng, 1)])
            more.append(" ".join(t))
        rows.append((d, "\n".join(keep + more)))
        want.append(keep)
    got = {r.doc_id: r.text.split("\n") for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
    left = sum(len(got[d]) - len(k) for d, k in enumerate(want))
    assert all(set(k) <= set(got[d]) for d, k in enumerate(want)) and left <= 0.1 * 3 * 300


def test_long_lines_take_few_rounds(spark, docs_of, monkeypatch):
    """A node of long lines without frequent tokens is done in one step, whatever the number of their tokens."""
    import random
    import time

    rng = random.Random(11)
    made = []
    real = lines.stash
    monkeypatch.setattr(lines, "stash", lambda df, name: made.append(name) or real(df, name))
    rows = [(d, "The same three " + prose(rng, 2000)) for d in range(300)]
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
    assert got == dict(rows) and len(made) < 60 and time.perf_counter() - began < 60


def test_one_step_over_many_positions_changes_nothing(spark, monkeypatch):
    """Nodes whose first positions are all different, then split, give the templates of the definitions."""
    import random

    monkeypatch.setattr(lines, "HELD_LINES", 16)
    for seed in range(3):
        rng = random.Random(seed)
        rows = Counter()
        for _ in range(160):
            kind = rng.choice("pqr")
            free = [rng.choice("uvwxyz") + rng.choice("abcdefgh") + rng.choice("klmn") for _ in range(rng.randint(0, 4))]
            rows[tuple(["a", "b", "c"] + (free + [f"{kind}{k}x"[0] * (k + 1) for k in range(17)])[:17])] += rng.randint(1, 2)
        order = hashes(rows)
        want = {order[t]: min(order[x] for x in found) for found in told_apart(set(rows), rows, 20, frozenset(), 5) for t in found}
        assert _templates_by_rounds(spark, rows, 5) == want and want
