import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_against_plain_versions(spark):
    import corpus_pipeline
    from tests.llm.test_operators import alike_roots, first_kept
    from evidentia.llm import pieces, suffixes, toxicity

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept.append(stage(spark, kept[-1], DATA).cache())
        assert kept[-1].columns == columns
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    machine = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    ids = sorted(rows[1])
    assert set(rows[2]) == {ids[r] for r in alike_roots([rows[1][i] or "" for i in ids])}
    ids = sorted(rows[2])
    left = dict(first_kept([(i, (rows[2][i] or "").encode()) for i in ids], suffixes.STAGE_LENGTH))
    assert {i: t or "" for i, t in rows[3].items()} == {i: t for i, t in left.items() if t.strip() or not (rows[2][i] or "").strip()}
    assert set(rows[4]) <= set(rows[3]) and rows[4]
    last = corpus_pipeline.STAGES[4][1](spark, kept[4], DATA).collect()
    vocabulary = pieces.Vocabulary.load()
    assert {r.doc_id: pieces.decode(r.ids, vocabulary) for r in last} == {i: (t or "").encode() for i, t in rows[4].items()}
