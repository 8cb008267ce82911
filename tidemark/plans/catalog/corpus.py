"""Queries: sources and sinks, corpus preparation, cleaning, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidemark.functions import text as X
from tidemark.operators import portfolio, selection
from tidemark.plans.catalog import sql
from tidemark.policy import text_patterns as P
from tidemark.policy.labels import SEED, TEST_RATIO, VALIDATION_RATIO
from tidemark.session import scratch_path
from tidemark.sources import complaints as corpus_source, intake
from tidemark.sources.reports import write_report

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


SAMPLE_SIZE = 300
RANDOM_SAMPLE_SIZE = 5000


def labelled(spark, sf):
    return corpus_source.labelled(intake.complaints(spark, sf))


def corpus(spark, sf):
    return corpus_source.corpus(intake.complaints(spark, sf))


@query("s1_csv_round_trip", sql.with_(sql.COMPLAINTS) + "SELECT product, narrative FROM complaints")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "complaints-csv")
    corpus_source.write_csv(intake.complaints(spark, sf).select("product", "narrative"), path)
    return corpus_source.read_csv(spark, path)


_EXPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@query(
    "s3_full_scan_rejects",
    """WITH r AS (SELECT *, CASE WHEN doc_id % 10 IN (7, 9) THEN 'columns' WHEN doc_id % 10 = 3 THEN 'values' END AS reason,
        doc_id || ',"' || source || '","' || replace(text, '"', '""') || '",' AS head FROM documents)
      SELECT doc_id, reason, CASE WHEN reason IS NULL THEN lang END AS lang,
        CASE WHEN reason IS NULL THEN n_chars END AS n_chars, md5(CASE WHEN reason IS NULL THEN text
          WHEN doc_id % 10 = 7 THEN head || lang WHEN doc_id % 10 = 9 THEN head || lang || ',' || n_chars || ',more'
          ELSE head || lang || ',n/a' END) AS text_md5 FROM r""",
)
def full_scan_rejects(spark, sf):
    """All columns of an export of which some records are damaged: a field lost, one too many, or no number."""
    digit = F.col("doc_id") % 10
    lines = intake.table(spark, sf, "documents").select(F.concat(
        F.col("doc_id"), F.lit(',"'), F.col("source"), F.lit('","'), F.replace("text", F.lit('"'), F.lit('""')),
        F.lit('",'), F.col("lang"),
        F.when(digit == 7, "").when(digit == 3, ",n/a").when(digit == 9, F.concat(F.lit(","), F.col("n_chars"), F.lit(",more")))
        .otherwise(F.concat(F.lit(","), F.col("n_chars")))).alias("value"))
    path = scratch_path(spark, "export-csv")
    lines.write.text(path)
    good, rejected = corpus_source.read_all(spark, path, _EXPORT, header=False, line_sep="\n")
    none = F.lit(None)
    return good.select("doc_id", none.cast("string").alias("reason"), "lang", "n_chars", F.md5("text").alias("text_md5")).unionAll(
        rejected.select(F.substring_index("record", ",", 1).cast("long"), "reason", none.cast("string"), none.cast("long"),
                        F.md5("record")))


@query(
    "s4_json_report_round_trip",
    sql.with_(sql.LABELLED)
    + "SELECT category, count(*) AS complaints, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct "
    "FROM labelled GROUP BY category",
)
def json_report_round_trip(spark, sf):
    """A nested report is written as JSON, read back and flattened."""
    rows = portfolio.category_shares(labelled(spark, sf))
    entries = F.map_from_entries(
        F.collect_list(F.struct("category", F.struct("complaints", "pct")))
    )
    path = scratch_path(spark, "portfolio-report")
    write_report(rows.agg(entries.alias("categories")), path)
    schema = "categories map<string,struct<complaints:bigint,pct:double>>"
    return (
        spark.read.schema(schema).json(path)
        .select(F.explode("categories").alias("category", "v")).select("category", "v.*")
    )


@query(
    "p1_p3_labelled_complaints",
    sql.with_(sql.LABELLED) + "SELECT doc_id, product, category, length(narrative) AS n FROM labelled",
)
def labelled_complaints(spark, sf):
    return labelled(spark, sf).select(
        "doc_id", "product", "category", F.length("narrative").cast("bigint").alias("n")
    )


@query("p4_p5_training_corpus", sql.with_(sql.CORPUS) + "SELECT doc_id, text, category FROM corpus")
def training_corpus(spark, sf):
    return corpus(spark, sf).select("doc_id", "text", "category")


@query(
    "p6_clean_training_corpus",
    sql.with_(sql.CORPUS, f"c AS (SELECT doc_id, {sql.clean('text')} AS text, category FROM corpus)")
    + "SELECT * FROM c WHERE text <> ''",
)
def clean_training_corpus(spark, sf):
    return corpus_source.corpus(intake.complaints(spark, sf), clean=True).select(
        "doc_id", "text", "category"
    )


_WORDS = "CASE WHEN cleaned = '' THEN 0 ELSE len(string_split(cleaned, ' ')) END"


@query(
    "p7_validate_narratives",
    sql.with_(sql.CLEANED)
    + f"""SELECT doc_id, CASE WHEN narrative IS NULL THEN 'Input is null or not a string.'
      WHEN cleaned = '' THEN 'Complaint text is empty or contains only whitespace/PII.'
      WHEN {_WORDS} < 3 THEN 'Complaint text is too short (' || ({_WORDS}) || ' words; minimum required is 3).'
      ELSE 'Valid complaint text.' END AS message FROM cleaned""",
)
def validate_narratives(spark, sf):
    out = X.with_clean_text(intake.complaints(spark, sf))
    return out.select("doc_id", X.validation_message("narrative", "cleaned").alias("message"))


@query(
    "p8_request_checks",
    """SELECT conv_id, turn, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = ''
         THEN 'Narrative cannot be empty.' WHEN turn NOT BETWEEN 1 AND 20
         THEN 'top_k must be between 1 and 20.' END AS problem FROM conversations""",
)
def request_checks(spark, sf):
    """Intake messages as requests, the turn number standing in for the asked result size."""
    from tidemark.plans.triage import request_problem

    rows = intake.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", request_problem("text", "turn").alias("problem"))


@query("t1_clean_text", sql.with_(sql.CLEANED) + "SELECT doc_id, cleaned FROM cleaned")
def clean_text(spark, sf):
    return X.with_clean_text(intake.complaints(spark, sf)).select("doc_id", "cleaned")


@query(
    "t1_clean_text_variants",
    sql.with_(sql.COMPLAINTS)
    + f"""SELECT doc_id, {sql.clean('narrative', pii=False)} AS keep_pii,
      {sql.clean('narrative', lower=False)} AS keep_case, {sql.clean('narrative', urls=False)} AS keep_urls,
      {sql.clean('narrative', markers=False)} AS keep_markers FROM complaints""",
)
def clean_text_variants(spark, sf):
    out = intake.complaints(spark, sf)
    out = X.with_clean_text(out, cleaned="keep_pii", redact_pii=False)
    out = X.with_clean_text(out, cleaned="keep_case", lowercase=False)
    out = X.with_clean_text(out, cleaned="keep_urls", strip_url=False)
    out = X.with_clean_text(out, cleaned="keep_markers", normalize_markers=False)
    return out.select("doc_id", "keep_pii", "keep_case", "keep_urls", "keep_markers")


_STEPS = {
    "t2_strip_html": (X.strip_html, sql.sub("html", P.HTML_TAG)),
    "t3_strip_urls": (X.strip_urls, sql.sub("html", P.URL)),
}
for _name, (_fn, _sql) in _STEPS.items():
    QUERIES[_name] = (
        lambda fn: lambda spark, sf: intake.spread(intake.table(spark, sf, "pages")).select(
            "page_id", fn("html").alias("text"))
    )(_fn)
    ORACLES[_name] = f"SELECT page_id, {_sql} AS text FROM pages"

_MASKS = {
    "t4_mask_emails": (X.mask_emails, sql.sub("narrative", P.EMAIL)),
    "t5_mask_ssns": (X.mask_ssns, sql.sub("narrative", P.SSN)),
    "t6_mask_cards": (X.mask_cards, sql.sub("narrative", P.PAYMENT_CARD)),
    "t7_mask_phones": (X.mask_phones, sql.sub("narrative", P.PHONE)),
    "t8_drop_redaction_markers": (
        X.drop_redaction_markers, sql.sub("narrative", P.REDACTION_MARKER, flags="gi")),
    "t9_collapse_punctuation": (X.collapse_punctuation, sql.one_punctuation("narrative")),
    "t10_lowercase": (F.lower, "lower(narrative)"),
    "t11_collapse_whitespace": (X.collapse_whitespace, sql.squeeze("narrative")),
}
for _name, (_fn, _sql) in _MASKS.items():
    QUERIES[_name] = (
        lambda fn: lambda spark, sf: intake.complaints(spark, sf).select(
            "doc_id", fn("narrative").alias("text"))
    )(_fn)
    ORACLES[_name] = sql.with_(sql.COMPLAINTS) + f"SELECT doc_id, {_sql} AS text FROM complaints"


@query(
    "t12_t13_clean_messages",
    f"SELECT conv_id, turn, {sql.clean('text')} AS cleaned FROM conversations",
)
def clean_messages(spark, sf):
    rows = intake.spread(intake.table(spark, sf, "conversations"))
    return X.with_clean_text(rows, "text").select("conv_id", "turn", "cleaned")


def _audit_sql():
    text = sql.sub(sql.sub("narrative", P.HTML_TAG), P.URL)
    cols = []
    for name, pattern, flag in [
        ("emails", P.EMAIL, "c"), ("ssns", P.SSN, "c"), ("cards", P.PAYMENT_CARD, "c"),
        ("phones", P.PHONE, "c"), ("markers", P.REDACTION_MARKER, "i"),
    ]:
        cols.append(f"len(regexp_extract_all({text}, {sql.q(pattern)}, 0, '{flag}'))::INTEGER AS {name}")
        text = sql.sub(text, pattern, flags="gi" if flag == "i" else "g")
    return ", ".join(cols)


@query("t14_pii_audit", sql.with_(sql.COMPLAINTS) + f"SELECT doc_id, {_audit_sql()} FROM complaints")
def pii_audit(spark, sf):
    counts = X.pii_audit("narrative")
    return intake.complaints(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in counts.items()]
    )


def _quota_ctes(source, size, name):
    """Largest-remainder quotas of ``size`` (a SQL expression over n) per category of ``source``."""
    return f"""{name}_n AS (SELECT category, count(*) AS k, (sum(count(*)) OVER ())::BIGINT AS n FROM {source} GROUP BY category),
{name}_t AS (SELECT *, ({size})::BIGINT AS total FROM {name}_n),
{name}_f AS (SELECT *, (k * total) // n AS base, (k * total) % n AS rem FROM {name}_t),
{name} AS (SELECT category, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, category)
     <= total - (sum(base) OVER ())::BIGINT THEN 1 ELSE 0 END AS quota FROM {name}_f)"""


_RANKED = (
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY "
    f"md5('{SEED}:' || doc_id)) AS rn FROM corpus)"
)


@query(
    "x1_stratified_sample",
    sql.with_(sql.CORPUS, _quota_ctes("corpus", f"least({SAMPLE_SIZE}, n)", "quota"), _RANKED)
    + "SELECT doc_id, r.category FROM ranked r JOIN quota q ON r.category = q.category WHERE rn <= quota",
)
def stratified_sample(spark, sf):
    return selection.stratified_sample(corpus(spark, sf), SAMPLE_SIZE, seed=SEED).select(
        "doc_id", "category"
    )


_SPLIT = [
    sql.CORPUS,
    _quota_ctes("corpus", f"n - ceil(round({TEST_RATIO}::DOUBLE * n, 9))", "fit"),
    _RANKED,
    "fitted AS (SELECT r.* FROM ranked r JOIN fit f ON r.category = f.category WHERE rn <= f.quota)",
    _quota_ctes("fitted", f"n - ceil(round({VALIDATION_RATIO}::DOUBLE * n, 9))", "train"),
    """splits AS (SELECT r.doc_id, r.category, r.text, CASE WHEN rn <= t.quota THEN 'train'
       WHEN rn <= f.quota THEN 'validation' ELSE 'test' END AS split
       FROM ranked r JOIN fit f ON r.category = f.category JOIN train t ON r.category = t.category)""",
]


def splits(spark, sf):
    return selection.stratified_split(corpus(spark, sf), seed=SEED)


@query("x2_stratified_split", sql.with_(*_SPLIT) + "SELECT doc_id, category, split FROM splits")
def stratified_split(spark, sf):
    return splits(spark, sf).select("doc_id", "category", "split")


@query(
    "a12_split_summary",
    sql.with_(*_SPLIT)
    + """SELECT split, category, count(*) AS complaints,
      (sum(count(*)) OVER (PARTITION BY split))::BIGINT AS split_size,
      round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS share
      FROM splits GROUP BY split, category""",
)
def split_summary(spark, sf):
    return portfolio.split_summary(splits(spark, sf))


@query(
    "u5_split_checks",
    sql.with_(*_SPLIT)
    + """SELECT count(*) AS rows_total, count(DISTINCT doc_id) AS ids,
      0::BIGINT AS overlapping_ids, count(*) = (SELECT count(*) FROM corpus) AS complete FROM splits""",
)
def split_checks(spark, sf):
    """Splits are disjoint and together are the corpus."""
    s = splits(spark, sf).select("doc_id", "split")
    names = ("train", "validation", "test")
    parts = {n: s.filter(F.col("split") == n).select("doc_id") for n in names}
    shared = None
    for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")):
        both = parts[a].intersect(parts[b])
        shared = both if shared is None else shared.union(both)
    whole = corpus(spark, sf).agg(F.count("*").alias("n"))
    return s.agg(
        F.count("*").alias("rows_total"), F.count_distinct("doc_id").alias("ids")
    ).select(
        "rows_total", "ids",
        shared.agg(F.count("*")).scalar().alias("overlapping_ids"),
        (F.col("rows_total") == whole.scalar()).alias("complete"),
    )


@query(
    "x3_random_sample",
    sql.with_(sql.LABELLED)
    + f"""SELECT doc_id, category FROM labelled ORDER BY md5('{SEED}:' || doc_id)
      LIMIT {RANDOM_SAMPLE_SIZE}""",
)
def random_sample(spark, sf):
    return selection.random_sample(labelled(spark, sf), RANDOM_SAMPLE_SIZE, seed=SEED).select(
        "doc_id", "category"
    )


@query(
    "x4_chronological_split",
    sql.with_(sql.TIMED)
    + """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS FIRST, doc_id)
      <= floor((count(*) OVER ()) * 0.5) THEN 'baseline' ELSE 'recent' END AS period FROM timed""",
)
def chronological_split(spark, sf):
    rows = intake.timed_complaints(spark, sf).select("doc_id", "ts")
    return selection.chronological_split(rows, 0.5).select("doc_id", "period")
