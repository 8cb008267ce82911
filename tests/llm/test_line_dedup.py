import hashlib
from collections import defaultdict

import duckdb

from tests.llm.cases import ODD, SCHEMA, documents, lower, sample, with_clashes
from tidemark.llm.line_dedup import ORACLES, drop_repeated_lines, op5_line_dedup

SPACE = " \t\n\x0b\x0c\r"
LINE = "A line that is long enough to be counted as boilerplate"


def brute(rows, least_chars=40, least_docs=5):
    holders = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        for key in {lower(x).strip(SPACE) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holders[key].append((doc, i if doc is None else None))
    last = {k: max(d for d, _ in v if d is not None) for k, v in holders.items() if len(set(v)) >= least_docs}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if last.get(lower(x).strip(SPACE), doc) == doc]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_equal_to_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in sample(spark, sf).collect()]
    got = sorted(tuple(r) for r in op5_line_dedup(spark, sf).collect())
    assert got == [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    assert any(r[2] for r in got)


def test_threshold_case_white_space_and_ties(spark):
    texts = [f"{LINE}\nown {i}" for i in range(3)] + [f"\t{LINE.upper()} \n{LINE}", f"{LINE}\x0b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in drop_repeated_lines(df).collect()) == brute(rows)
    few = df.where("doc_id < 4")
    assert all(r["n_dropped"] == 0 for r in drop_repeated_lines(few).collect())


def test_rows_that_repeat_an_id_are_one_document(spark, tmp_path):
    other = LINE.replace("A line", "Another line")
    rows = [(1, f"{LINE}\n{i}") for i in range(4)] + [(2, LINE)]
    rows += [(10 + i, other) for i in range(4)] + [(13, f"{other}\nonce more"), (9, f"{other}\n")]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in drop_repeated_lines(df).collect())
    assert got == brute(rows) and sum(r[2] for r in got) == 4 and all(r[2] == 0 for r in got if r[0] < 3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert len(op5_line_dedup(spark, str(tmp_path)).collect()) == len(rows)
    # The SQL names documents by their id, so it is compared on the ids that stand in one row.
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, n_lines, n_dropped, kept_sha256"
    want = {r[0]: r for r in duckdb.sql(f"SELECT {columns} FROM ({ORACLES['op5_line_dedup']})").fetchall()}
    mine = [tuple(r[c] for c in columns.split(", ")) for r in op5_line_dedup(spark, str(tmp_path)).collect()]
    once = [r for r in mine if r[0] not in (1, 13)]
    assert once and all(want[r[0]] == r for r in once)


def test_odd_rows_and_clashing_columns(spark):
    df = with_clashes(documents(spark, ODD + [(20 + i, LINE, "en", "a") for i in range(5)] + [(None, LINE, "en", "a")]))
    out = drop_repeated_lines(df)
    assert out.columns == [*df.columns, "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 6 and {r["rest"] for r in rows} == {"own"}
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[1]["n_lines"] == 1 and by[3]["n_lines"] == 2
    assert [by[20 + i]["text"] for i in range(5)] == ["", "", "", "", LINE]
    assert [r["n_dropped"] for r in rows if r["doc_id"] is None and LINE in (r["text"] or LINE)].count(1) <= 1
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
