"""Every stage of the pipeline against a brute-force version, on the rows that its predecessor kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import test_decontaminate, test_line_dedup, test_near_dup
from tests.llm.cases import ODD, documents, with_clashes
from tidemark.llm import mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1], sf).cache())
    assert all(x.columns == COLUMNS for x in outs[:-1])
    raw, good, lines, near, clean, mix = map(kept, outs)

    predicted = {r["doc_id"]: r["predicted"] for r in quality.op3_quality(spark, sf).collect()}
    assert good == {d: t for d, t in raw.items() if predicted[d]}
    assert len(good) < len(raw)

    assert lines == {d: t for d, _, _, t in test_line_dedup.brute(list(good.items()))}
    assert all(r["n_chars"] == len(r["text"]) for r in outs[2].collect())

    assert near == {d: lines[d] for d, _, _, stays in test_near_dup.brute(list(lines.items()), 5) if stays}
    assert len(near) < len(lines)

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean == {d: near[d] for d, *_, hit in test_decontaminate.brute(list(near.items()), items) if not hit}
    assert len(clean) < len(near)

    odds = mixing.mixed(outs[4]).where(mixing.draw(F.col("doc_id").cast("string")) < F.col("probability"))
    assert mix == kept(odds) and 0 < len(mix) < len(clean)


def test_run_equals_its_stages_and_odd_rows_pass(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == [*COLUMNS, "sample_probability"]
    docs = with_clashes(documents(spark, ODD))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert "rest" in docs.columns
    docs.count()
    empty = spark.createDataFrame([], docs.select(*COLUMNS).schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
