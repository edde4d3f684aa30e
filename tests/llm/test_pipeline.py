import corpus_pipeline
from pagegrain.llm import langid
from pagegrain.storage import stash
from tests.llm.conftest import CLASHING, EDGE, SF
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_fingerprint, components


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stash(stage(spark, kept[-1], SF), name))
    assert all(d.columns == columns for d in kept[:-1])
    rows = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    encoders = langid._encoders(langid.learn(docs))
    assert set(rows[1]) == {d for d, t in rows[0].items() if langid.classify(t, encoders)[0] != "und" and langid.classify(t, encoders)[1] >= langid.MARGIN}
    assert [rows[2][d] for d in rows[1]] == brute_lines(list(rows[1].items()))
    ids = list(rows[2])
    assert set(rows[3]) == set(components([brute_fingerprint(rows[2][d]) for d in ids], ids))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[4]) == {d for d, _, hit, _ in ((x[0] if x[0] != -1 else 0, *x[1:]) for x in brute_hits(list(rows[3].items()), items)) if not hit}
    assert {r.doc_id for r in kept[-1].collect()} <= set(rows[4])


def test_edges(spark, docs_of):
    for rows in (EDGE, EDGE[:0]):
        docs = docs_of([*rows, *([(d, "der hund und die katze " * 9, "de") for d in range(30, 40)] if rows else [])], CLASHING)
        for _, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, SF), "stage")
        docs.count()
