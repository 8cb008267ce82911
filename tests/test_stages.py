import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemark.operators import classify
from tidemark.functions.text import with_clean_text
from tidemark.plans import stages, triage
from tidemark.session import scratch_path
from tests.test_classify import TRAIN, VALIDATION
from tests.test_triage import HARASS, PIZZA, WIRE

COLUMNS = ["doc_id", "category", "confidence", "in_domain", "sub_issue", "risk_score", "target_queue", "sla_hours"]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, t, c, "train") for i, (t, c) in enumerate(TRAIN * 3)]
    rows += [(1000 + i, t, c, "validation") for i, (t, c) in enumerate(VALIDATION)]
    return spark.createDataFrame(rows, "doc_id bigint, narrative string, label string, split string")


@pytest.fixture(scope="module")
def fitted(labelled):
    return stages.triage_pipeline().fit(labelled)


@pytest.fixture(scope="module")
def arriving(spark):
    return spark.createDataFrame([(1, WIRE), (2, HARASS), (3, PIZZA), (4, None), (5, ""), (5, "")],
                                 "doc_id bigint, narrative string")


def judged(model, rows):
    return sorted(map(tuple, model.transform(rows).select(*COLUMNS).collect()))


def test_same_as_the_functions(labelled, fitted, arriving):
    again = with_clean_text(with_clean_text(labelled, "narrative", "cleaned"), "cleaned", "cleaned_again")
    model = classify.TextClassifier.fit(again.filter("split = 'train'"), "cleaned_again", "label").calibrate(
        again.filter("split = 'validation'"), "cleaned_again", "label")
    got = {r["doc_id"]: r for r in fitted.transform(arriving).collect()}
    want = {r["doc_id"]: r for r in triage.analyze(arriving, model).collect()}
    assert set(got) == set(want) == {1, 2, 3, 4, 5}
    for i, r in want.items():
        for c in set(COLUMNS) - {"confidence"}:
            assert got[i][c] == r[c], (i, c)
        assert got[i]["confidence"] == pytest.approx(r["confidence"], abs=1e-6)


def test_saved_and_reloaded(spark, fitted, arriving):
    path = scratch_path(spark, "pipeline")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    assert [type(s) for s in loaded.stages] == [type(s) for s in fitted.stages]
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    assert judged(loaded, arriving) == judged(fitted, arriving) and len(judged(loaded, arriving)) == 6


def test_unfitted_pipeline_keeps_its_parameters(spark):
    path = scratch_path(spark, "unfitted")
    stages.triage_pipeline(split="", kind="baseline").write().save(path)
    step = Pipeline.load(path).getStages()[3]
    assert (step.getOrDefault("kind"), step.getOrDefault("splitCol"), step.getOrDefault("inputCol")) == (
        "baseline", "", "cleaned_again")


def test_stage_names_its_columns(spark):
    df = spark.createDataFrame([("<b>Wire</b> FRAUD", "x")], "body string, narrative string")
    out = stages.TextCleaner(inputCol="body", outputCol="tidy").transform(df).first()
    assert out["tidy"] == "wire fraud" and out["narrative"] == "x"


def test_on_a_stream(spark, fitted, arriving):
    path = scratch_path(spark, "arriving")
    arriving.write.parquet(path)
    name = "triaged_by_pipeline"
    run = fitted.transform(spark.readStream.schema(arriving.schema).parquet(path)).select(*COLUMNS).writeStream.format(
        "memory").queryName(name).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == judged(fitted, arriving)


def test_empty_table(fitted, arriving):
    assert judged(fitted, arriving.filter(F.lit(False))) == []


def test_a_fit_runs_the_stages_before_the_classifier_once(spark, labelled):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            if "narrative" in b.schema.names:
                read.add(b.num_rows)
            yield b

    other = labelled.limit(5).withColumn("split", F.lit("test"))
    rows = labelled.unionByName(other).localCheckpoint()
    stages.triage_pipeline().fit(rows.mapInArrow(count, rows.schema))
    # Before, the gate and both cleanings ran for the labels, the words and the calibration.
    assert read.value <= rows.count()
