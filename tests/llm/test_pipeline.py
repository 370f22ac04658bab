import corpus_pipeline
from tokenizers import Tokenizer

from amplispark.llm import packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        n = after.count()
        assert 0 < n <= before
        docs, before = spark.createDataFrame(after.collect(), after.schema), n
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    reference = Tokenizer.from_file(packing.word_bpe())
    total = sum(len(reference.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == total
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_hard_documents(spark, hard_docs):
    assert corpus_pipeline.run(spark, hard_docs).collect() is not None


def test_no_documents(spark, no_docs):
    assert corpus_pipeline.run(spark, no_docs).collect() == []
