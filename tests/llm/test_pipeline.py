import importlib.util
import random

import pytest

import corpus_pipeline
from sparkdoc.llm import jaccard

from .helpers import documents
from .test_jaccard import brute, corpus


def test_one_document_of_each_group_stays(spark):
    rows = corpus(3, 60) + [(2000, None), (2001, ""), (2001, ""), (0, "again " * 9), (0, "again " * 9)]
    docs = documents(spark, rows, extra=True)
    out = jaccard.deduplicated(docs)
    least = {c for _, n, c in brute(rows) if n}
    assert out.columns == docs.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    assert got == sorted([*(c for c in least if c != 0), 2000, 2001, 2001, *[0] * len({t for d, t in rows if d == 0})], key=str)


@pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no tokenizer files")
def test_stages(spark, tmp_path):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(2000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item = text(30)
    rows = [(i, text(120) + "\nCommon footer line" + "\n" + text(60)) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " extra"), (102, text(80) + " " + item + " " + text(80)), (103, "too short"), (104, None), (105, "spam " * 200)]
    sf = str(tmp_path / "sf")
    clash = "score double, kept string, n_lines long, n_words string, hot string, salt int"  # names that the operators use themselves
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7.5, "k", 3, "w", "h", d) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, sf).write.parquet(str(tmp_path / f"s{k}"))
        seen = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert seen.columns == docs.columns and seen.where("score <> 7.5 or kept <> 'k' or n_lines <> 3 or n_words <> 'w' or hot <> 'h' or salt <> doc_id").count() == 0
        if k == 1:
            assert seen.where("contains(text, 'Common footer') or n_chars != length(text)").count() == 0
    assert sorted(r.doc_id for r in seen.collect()) == list(range(40))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, seen.collect()))
