import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from odd import empty_documents, odd_documents

from pollspark.llm import byte_bpe, langid, near_join, simhash
from pollspark.llm.common import stored


def test_stages_keep_columns_and_clean_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, ""), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0


def test_pipeline_of_the_small_table(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert set(found.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * n < found.select("doc_id").distinct().count() <= n


def test_pipeline_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_documents(spark), "").count() == 0


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    """By rows alone, these ten thousand texts would be one batch of 20 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 10_000, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' word', 400)) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    few = docs.limit(3)
    for use in (lambda: langid.score(few, None), lambda: simhash.fingerprints(few), lambda: near_join.near_groups(few),
                lambda: byte_bpe.encode_decode(few, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)):
        spark.conf.unset(name)
        use()
        assert max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()) < 3 << 20


def test_a_kept_text_is_sent_to_the_model_once(spark):
    docs = odd_documents(spark)
    plan = langid.accepted(docs, None)._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("MapInArrow"):
        plan = plan.children().apply(0)
    assert plan.children().apply(0).output().size() == len(docs.columns)
