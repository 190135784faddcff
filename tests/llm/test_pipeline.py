import corpus_pipeline
from custlens.llm.probminhash import near_classes
from custlens.llm.quality_cnn import score_documents
from custlens.llm.quality_rules import verdicts
from custlens.llm.substring import mark_repeats
from custlens.llm.tables import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        if name == "quality":
            good = {r.doc_id for r in score_documents(docs, table(spark, SF, "labels")).where("score >= 0.7").collect()}
            assert set(after) == good
        elif name == "rules":
            assert set(after) == {r.doc_id for r in verdicts(docs).where("kept").collect()}
        elif name == "near_dedup":
            assert set(after) == {r.class_id for r in near_classes(docs).collect()}
        else:
            assert set(after) == set(before)
            left = {r.doc_id: r._n_words - r._n_removed for r in mark_repeats(docs).collect()}
            assert {i: len(t.split()) for i, t in after.items()} == left
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
