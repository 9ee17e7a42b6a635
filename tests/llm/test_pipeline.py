"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
from massflow.llm.common import stored, table
from massflow.llm.quality import with_scores
from test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    inputs, docs = [], table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.toPandas())
        docs = stored(stage(spark, docs, SF), name)
        if name != "byte_bpe":
            assert docs.columns == columns
    quality, exact, near, leaks, bpe = inputs
    labels = table(spark, SF, "labels").toPandas().merge(quality, on="doc_id")
    good = labels[labels.quality == 1]
    assert good.doc_id.isin(exact.doc_id).mean() > 0.95
    scored = with_scores(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()
    assert set(exact.doc_id) == set(scored[scored.quality_score >= 0.5].doc_id)
    same = exact.text.fillna("").str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
    assert set(near.doc_id) == set(exact.groupby(same).doc_id.min())
    near = near.sort_values("doc_id", ignore_index=True)
    first, _ = brute_components(near.text.tolist())
    assert set(leaks.doc_id) == set(near.doc_id[first])
    items = [" ".join(t.split()) for t in table(spark, SF, "benchmark").toPandas().text]
    holds = leaks.text.map(lambda t: any(i in " ".join((t or "").split()) for i in items))
    assert not set(bpe.doc_id) & set(leaks[holds].doc_id)
    fives = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(len(w) - 4)}
    known = set().union(*map(fives, items))
    clean = leaks[[not fives(t) & known for t in leaks.text]]
    assert len(clean) > 20 and clean.doc_id.isin(bpe.doc_id).all(), "a document that shares no five words with an item stays"
    assert docs.count() == len(bpe) and docs.where("n_tokens <> size(ids)").count() == 0


def test_the_quality_stage_drops_bad_documents_and_keeps_good_ones(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has eleven bad labels, too few to learn from
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").toPandas()
    kept = corpus_pipeline.good_quality(spark, docs, sf).select("doc_id").toPandas()
    labels = labels[labels.doc_id.isin(docs.select("doc_id").toPandas().doc_id)]
    assert labels[labels.quality == 1].doc_id.isin(kept.doc_id).mean() > 0.95
    assert labels[labels.quality == 0].doc_id.isin(kept.doc_id).mean() < 0.05


def test_stages_pass_over_edge_cases_and_empty_tables(spark, tmp_path):
    rows = [(1, None), (None, "some words of prose that go on"), (3, ""), (4, "x " * 20_000), (4, "x " * 20_000), (5, "é")]
    docs = spark.createDataFrame([(i, t, "en", 1, "r") for i, t in rows], "doc_id long, text string, lang string, rid int, name string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"quality": 6, "exact_dedup": 4, "near_dedup": 4, "decontamination": 4, "byte_bpe": 4}
    for docs, expected in ((docs, left), (docs.limit(0), dict.fromkeys(left, 0))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), name)
            assert docs.count() == expected[name], name
            assert name == "byte_bpe" or docs.columns == columns
