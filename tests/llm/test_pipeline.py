import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

from gridloom.llm import bpe
from tests.llm.test_operators import ODD, brute_fingerprint, classes, docs, prose


def test_stages_hold_what_they_promise(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_level_bpe"]
    rows = ODD + [(100 + i, prose(80), "en", "src0") for i in range(60)] + [(300 + i, prose(80), "fr", "src7") for i in range(40)]
    now = docs(spark, rows)
    before = now
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, "/nowhere")
        out = spark.createDataFrame(made.collect(), made.schema)
        if name != "byte_level_bpe":
            assert out.columns == before.columns
        if name == "simhash_near_dedup":
            fps = {r.doc_id: brute_fingerprint(r.text) for r in now.collect()}
            want = classes(list(fps.items()))
            assert {r.doc_id for r in out.collect()} == set(want.values())
        now = out
    ranks = bpe.read_ranks(bpe.default_vocabulary())
    own = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    assert now.count() > 0 and all(r.round_trip and r.ids == own.encode_ordinary(r.text or "") for r in now.collect())
    assert not {3, 4, 5, 11} & {r.doc_id for r in now.collect()}


def test_stages_on_an_empty_table(spark):
    now = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/nowhere")
        assert now.count() == 0


def test_run_on_a_table(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": list(range(40)), "text": [prose(50) for _ in range(40)], "lang": ["en"] * 40, "source": ["src1"] * 40, "n_chars": [1] * 40}), tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "ids" in out.columns
