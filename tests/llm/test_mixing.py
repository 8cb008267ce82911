import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD, SCHEMA, documents, with_clashes
from tidemark.llm import mixing


def test_marginals_meet_their_targets(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = spark.createDataFrame([(f"src{i}", 3.0 if i < 5 else 1.0) for i in range(20)], "name string, weight double")
    out = mixing.mixed(docs, targets={"source": wanted}, sweeps=60)
    share = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}
    total = sum(share.values())
    assert share["src0"] / total == pytest.approx(3 / 30, rel=1e-3)
    assert share["src10"] / total == pytest.approx(1 / 30, rel=1e-3)
    assert total == pytest.approx(mixing.TOKEN_SHARE * out.agg(F.sum("tokens")).first()[0], rel=1e-6)
    assert out.agg(F.max("probability")).first()[0] <= 1.0
    few = mixing.mixed(docs, token_budget=total / 4, sweeps=60)
    assert few.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] == pytest.approx(total / 4, rel=1e-6)


def test_samples_follow_their_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mixed(docs).agg(F.sum("probability").alias("p"), F.sum(F.col("kept").cast("int")).alias("n")).first()
    assert abs(out["n"] - out["p"]) < 4 * out["p"] ** 0.5


def test_odd_rows_and_clashing_columns(spark):
    df = with_clashes(documents(spark, ODD))
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "probability"]
    rows = out.collect()
    assert len(rows) == len(ODD) and {r["rest"] for r in rows} == {"own"} and {r["topic"] for r in rows} == {"own"}
    assert all(0 <= r["probability"] <= 1 and r["tokens"] >= 1 for r in rows)
    twins = [r["kept"] for r in rows if r["doc_id"] == 6]
    assert twins[0] == twins[1]
    plain = mixing.mixed(documents(spark, ODD))
    assert {r["topic"] for r in plain.collect()} == {"short", "long"}
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed(documents(spark, ODD).select("doc_id", "text")).count() == len(ODD)


def test_one_rare_row_leaves_the_mix_its_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    rare = lambda text: docs.unionByName(spark.createDataFrame([(-1, text, "unseen", "xx")], docs.schema))
    tokens = F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")
    usual = mixing.mixed(docs)
    assert usual.agg(tokens).first()[0] == pytest.approx(mixing.TOKEN_SHARE, rel=1e-6)
    with pytest.warns(UserWarning, match="source 'unseen' .* off"):
        out = mixing.mixed(rare("word"))
    assert out.agg(tokens).first()[0] == pytest.approx(mixing.TOKEN_SHARE, rel=1e-6)
    assert out.where("doc_id = -1").first()["probability"] == 1.0
    moved = usual.select("doc_id", "probability").join(out.select("doc_id", F.col("probability").alias("p")), "doc_id")
    assert moved.agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0] < 0.05
    assert mixing.mixed(rare("word " * 10), token_share=0.5).agg(tokens, F.max("probability")).first() == (pytest.approx(0.5, rel=1e-6), 1.0)


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_sql_follows_the_same_rule_with_rare_cells(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(-1, "word", "unseen", "xx"), (-2, "one two three", None, None), (-3, None, "unseen", "en"), (-4, "w " * 2000, "unseen", "yy")]
    docs.unionByName(spark.createDataFrame([(i, t, lang, source, 0) for i, t, source, lang in rows], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = mixing.op8_mixing(spark, str(tmp_path))
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({mixing.ORACLES['op8_mixing']})").fetchall()}
    mine = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert mine.keys() == want.keys()
    for doc, row in mine.items():
        assert row[:4] == want[doc][:4] and row[4] == pytest.approx(want[doc][4], abs=2e-9) and row[5] == want[doc][5]


def test_sweeps_meet_the_margins_or_a_warning_names_them(spark):
    cells = spark.createDataFrame(
        [(s, l, "own", 9_000 if s == l else 300) for s in ("a", "b") for l in ("a", "b")],
        "source string, lang string, topic string, tokens long",
    )
    wanted = {c: spark.createDataFrame([("a", w), ("b", 1 - w)], "name string, weight double") for c, w in (("source", 0.7), ("lang", 0.5))}
    off = lambda w: mixing.residuals(w, mixing._aims(cells, wanted, 1.0)).agg(F.max("off")).first()[0]
    assert off(mixing.cell_weights(cells, wanted, sweeps=64)) <= mixing.TOLERANCE
    with pytest.warns(UserWarning, match="after 2 sweeps of raking"):
        mixing.cell_weights(cells, wanted, sweeps=2)
    with pytest.warns(UserWarning, match="after 4 sweeps of raking"):
        mixing.cell_weights(cells, wanted | {"source": spark.createDataFrame([("a", 0.5), ("c", 0.5)], "name string, weight double")}, sweeps=4)


def test_no_python_on_the_main_path(spark, sf):
    plan = mixing.op8_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
