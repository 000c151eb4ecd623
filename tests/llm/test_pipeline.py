"""The pipeline against a plain version of its stages, each judged on its own input, and edges."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from pactframe.llm import bpe_codec
from pactframe.llm.queries import RANKS
from tests.llm.conftest import EDGES, FOLDER, LONG, rows_of
from tests.llm.test_lsi_decontam import plain_words
from tests.llm.test_quality_forest import plain_counts
from tests.llm.test_secret_links import plain_base
from tests.llm.test_simhash_dedup import expected


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = dict(rows_of("labels", "doc_id, quality"))
    items = [plain_words(t) for _, t in rows_of("benchmark")]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name == "quality_rules":
            failed = {i for i, r in before.items() for c in [plain_counts(r.text)] if c[0] < 10 or 100 * c[4] > 20 * c[0]}
            assert not failed & after.keys()
            assert all(labels.get(i) == 0 or i not in labels for i in before.keys() - failed - after.keys())
        elif name == "near_dedup":
            assert after.keys() == {c for _, c in expected([(i, r.text) for i, r in before.items()]).values()}
        elif name == "decontamination":
            assert before.keys() - after.keys() == {i for i, r in before.items() if any(t in plain_words(r.text) for t in items)}
        elif name == "secret_scan":
            assert before.keys() == after.keys()
            for i, r in after.items():
                assert not plain_base(r.text) and r.n_chars == len(r.text or "")
                assert r.text == before[i].text or plain_base(before[i].text) or "[SECRET]" in r.text
        else:
            codec = bpe_codec.Codec(*bpe_codec.codec_parts(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
            assert before.keys() == after.keys()
            assert all(bytes(r.ids) == codec.encode(before[i].text) and r.round_trip for i, r in after.items())
        if name != "byte_bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).where("round_trip").count() > 100


def test_edges_in_every_stage(spark):
    rows = [(i, t, None, "s", None if t is None else len(t), "own") for i, t in EDGES] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() <= len(rows), name
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert out.where(F.col("text") == LONG).count() == (0 if name == "quality_rules" else 1)
            assert {r.kept for r in out.collect()} <= {"own", None}
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
