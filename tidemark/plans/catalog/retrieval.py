"""Queries: text features, TF-IDF index, similar-case retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import retrieval, tfidf
from tidemark.plans.catalog import sql
from tidemark.policy import retrieval_cases, stop_words, sub_issues, text_patterns as P
from tidemark.session import scratch_path
from tidemark.sources import complaints as corpus_source, intake

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


INDEX = tfidf.Weighting()
BASELINE = tfidf.Weighting(max_features=5_000, ngram_max=1, sublinear=False, min_df=1, max_df=1.0)
TOPIC = tfidf.Weighting(max_features=10_000, min_df=3, max_df=0.85,
                        stop_words=tuple(stop_words.ENGLISH))


def cleaned(spark, sf):
    return X.with_clean_text(intake.complaints(spark, sf)).select("doc_id", "cleaned")


def labelled(spark, sf):
    return corpus_source.labelled(intake.complaints(spark, sf)).select(
        "doc_id", "narrative", "category")


def benchmark_queries(spark, sf):
    return intake.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKENS = f"regexp_extract_all(lower(cleaned), {sql.q(P.TERM_TOKEN)})"
_STOPPED = f"list_filter({_TOKENS}, lambda w: NOT list_contains({sql.array(stop_words.ENGLISH)}, w))"


def tfidf_sql(source: str, weighting: tfidf.Weighting, name: str = "t", keep: str = "") -> str:
    """CTEs ending in ``{name}_w`` (doc_id, term, weight) for ``source`` (doc_id, cleaned)."""
    tokens = _STOPPED if weighting.stop_words else _TOKENS
    tf = "1 + ln(tf)" if weighting.sublinear else "tf"
    pairs = (
        f"UNION ALL SELECT doc_id, term || ' ' || nxt FROM {name}_lead WHERE nxt IS NOT NULL"
        if weighting.ngram_max == 2 else ""
    )
    return f"""{name}_src AS (SELECT doc_id, {tokens} AS toks FROM {source}),
{name}_n AS (SELECT count(*) AS n FROM {name}_src),
{name}_uni AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM {name}_src),
{name}_lead AS (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {name}_uni),
{name}_all AS (SELECT doc_id, term FROM {name}_uni {pairs}),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {name}_all GROUP BY ALL),
{name}_stat AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {name}_tf GROUP BY term),
{name}_vocab AS (SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf FROM {name}_stat, {name}_n
   WHERE df >= {weighting.min_df} AND df <= {weighting.max_df}::DOUBLE * n
   ORDER BY cf DESC, term LIMIT {weighting.max_features}),
{name}_raw AS (SELECT doc_id, f.term, ({tf})::DOUBLE * idf AS w FROM {name}_tf f JOIN {name}_vocab v ON f.term = v.term),
{name}_w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {name}_raw)"""


_CLEAN_SRC = "src AS (SELECT doc_id, cleaned FROM cleaned)"


@query(
    "v1_word_tokens",
    sql.with_(sql.CLEANED) + f"""SELECT doc_id, len({_TOKENS})::INTEGER AS n_tokens,
      array_to_string({_TOKENS}, ' ') AS tokens FROM cleaned""",
)
def word_tokens(spark, sf):
    c = cleaned(spark, sf).withColumn("t", X.terms("cleaned"))
    return c.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


_PAIRS = "list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])"


@query(
    "v2_v3_ngrams_without_stop_words",
    sql.with_(sql.CLEANED, f"s AS (SELECT doc_id, {_STOPPED} AS toks FROM cleaned)")
    + f"""SELECT doc_id, array_to_string(list_concat(toks, CASE WHEN len(toks) > 1 THEN {_PAIRS} ELSE [] END), '|') AS terms FROM s""",
)
def ngrams_without_stop_words(spark, sf):
    t = tfidf.with_terms(cleaned(spark, sf), "cleaned", TOPIC)
    return t.select("doc_id", F.array_join("_terms", "|").alias("terms"))


@query(
    "v4_a20_vocabulary",
    sql.with_(sql.CLEANED, _CLEAN_SRC, tfidf_sql("src", INDEX))
    + "SELECT term, df, cf, round(idf, 6) AS idf FROM t_vocab",
)
def vocabulary(spark, sf):
    """Document and corpus frequency of the terms that an index keeps."""
    model = tfidf.TfidfModel.fit(cleaned(spark, sf), "cleaned", INDEX)
    return model.vocabulary_frame().select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query(
    "v5_topic_vocabulary",
    sql.with_(sql.CLEANED, _CLEAN_SRC, tfidf_sql("src", TOPIC)) + "SELECT term, df, cf FROM t_vocab",
)
def topic_vocabulary(spark, sf):
    """Topic vocabulary without stop words."""
    return tfidf.TfidfModel.fit(cleaned(spark, sf), "cleaned", TOPIC).vocabulary_frame().select(
        "term", "df", "cf")


@query(
    "v6_v8_baseline_weights",
    sql.with_(sql.CLEANED, _CLEAN_SRC, tfidf_sql("src", BASELINE))
    + "SELECT doc_id, term, round(weight, 6) AS weight FROM t_w",
)
def baseline_weights(spark, sf):
    """Raw term frequency, unigrams, five thousand features."""
    docs = cleaned(spark, sf)
    model = tfidf.TfidfModel.fit(docs, "cleaned", BASELINE)
    p = tfidf.postings(model.transform(docs, "cleaned"), "doc_id")
    return p.join(F.broadcast(model.vocabulary_frame().select("term_id", "term")), "term_id").select(
        "doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "k17_tfidf_index",
    sql.with_(sql.CLEANED, _CLEAN_SRC, tfidf_sql("src", INDEX))
    + "SELECT doc_id, term, round(weight, 6) AS weight FROM t_w",
)
def tfidf_index(spark, sf):
    """All weighted terms of the retrieval index."""
    index = retrieval.TfidfIndex.build(intake.complaints(spark, sf))
    p = tfidf.postings(index.vectors, "doc_id")
    return p.join(
        F.broadcast(index.model.vocabulary_frame().select("term_id", "term")), "term_id"
    ).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def query_sql(queries: str, k: int, name: str = "m") -> str:
    """CTEs ending in ``{name}`` (query_id, doc_id, score, rank); needs t_vocab and t_w.

    ``queries`` is a CTE with query_id and query.
    """
    return f"""{name}_q AS (SELECT query_id, {sql.clean('query')} AS cleaned FROM {queries}),
{name}_src AS (SELECT query_id, {_TOKENS} AS toks FROM {name}_q),
{name}_uni AS (SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM {name}_src),
{name}_lead AS (SELECT query_id, term, lead(term) OVER (PARTITION BY query_id ORDER BY pos) AS nxt FROM {name}_uni),
{name}_all AS (SELECT query_id, term FROM {name}_uni UNION ALL
   SELECT query_id, term || ' ' || nxt FROM {name}_lead WHERE nxt IS NOT NULL),
{name}_tf AS (SELECT query_id, term, count(*) AS tf FROM {name}_all GROUP BY ALL),
{name}_raw AS (SELECT query_id, f.term, (1 + ln(tf))::DOUBLE * idf AS w FROM {name}_tf f JOIN t_vocab v ON f.term = v.term),
{name}_w AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM {name}_raw),
{name}_dot AS (SELECT query_id, doc_id, round(sum(qw * weight), 9) AS score
   FROM {name}_w q JOIN t_w d ON q.term = d.term GROUP BY ALL),
{name}_full AS (SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM {queries} q CROSS JOIN
   (SELECT DISTINCT doc_id FROM src) d LEFT JOIN {name}_dot s ON s.query_id = q.query_id AND s.doc_id = d.doc_id),
{name} AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank
   FROM {name}_full) WHERE rank <= {k})"""


@query(
    "k18_similar_cases",
    sql.with_(sql.CLEANED, _CLEAN_SRC, tfidf_sql("src", INDEX),
              "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
              query_sql("bq", 5))
    + "SELECT query_id, doc_id, round(score, 4) AS score, rank FROM m",
)
def similar_cases(spark, sf):
    """Five most similar complaints for every benchmark text."""
    index = retrieval.TfidfIndex.build(intake.complaints(spark, sf))
    return index.query(benchmark_queries(spark, sf), 5).withColumn("score", F.round("score", 4))


_LABELLED_SRC = "src AS (SELECT doc_id, cleaned FROM labelled)"
_TAXONOMY = [
    (100 * i + j, d, c)
    for i, (c, subs) in enumerate(sub_issues.TAXONOMY.items()) for j, (_, _, d) in enumerate(subs)
]


def taxonomy_queries(spark):
    return spark.createDataFrame(_TAXONOMY, "query_id bigint, query string, category string")


@query(
    "k20_retrieval_quality",
    sql.with_(sql.LABELLED, _LABELLED_SRC, tfidf_sql("src", INDEX),
              sql.values("tq", "query_id, query, category", _TAXONOMY), query_sql("tq", 5),
              """r AS (SELECT m.*, q.category AS expected, l.category AS found FROM m
                 JOIN tq q ON m.query_id = q.query_id JOIN labelled l ON m.doc_id = l.doc_id)""",
              """pq AS (SELECT query_id, avg(CASE WHEN found = expected THEN 1.0::DOUBLE ELSE 0 END) AS p,
                 max(CASE WHEN found = expected THEN 1 ELSE 0 END) AS hit,
                 coalesce(1.0::DOUBLE / min(rank) FILTER (found = expected), 0) AS rr,
                 max(round(score, 4)) FILTER (rank = 1) AS top1 FROM r GROUP BY query_id)""")
    + """SELECT round(avg(p), 4) AS precision_at_k, round(avg(hit), 4) AS hit_rate_at_k,
      round(avg(rr), 4) AS mrr_at_k, round(avg(top1), 4) AS mean_top1_similarity,
      count(*) AS queries_evaluated, 5 AS top_k FROM pq""",
)
def retrieval_quality(spark, sf):
    """The taxonomy's descriptions as labelled queries."""
    corpus = labelled(spark, sf)
    index = retrieval.TfidfIndex.build(corpus)
    queries = taxonomy_queries(spark)
    return retrieval.evaluate(index.query(queries, 5), queries, corpus)


_PARAPHRASE = [(i, q, c) for i, (q, c) in enumerate(retrieval_cases.PARAPHRASES)]


@query(
    "k21_paraphrase_challenge",
    sql.with_(sql.LABELLED, _LABELLED_SRC, tfidf_sql("src", INDEX),
              sql.values("tq", "query_id, query, category", _PARAPHRASE), query_sql("tq", 5))
    + """SELECT q.query, q.category AS expected_category,
      max(l.category) FILTER (rank = 1) AS top1_category,
      max(round(score, 4)) FILTER (rank = 1) AS top1_similarity,
      max(l.narrative[1:120]) FILTER (rank = 1) AS top1_snippet,
      bool_or(rank = 1 AND l.category = q.category) AS success_top1,
      bool_or(l.category = q.category) AS success_top_k
      FROM m JOIN tq q ON m.query_id = q.query_id JOIN labelled l ON l.doc_id = m.doc_id
      GROUP BY q.query, q.category""",
)
def paraphrase_challenge(spark, sf):
    corpus = labelled(spark, sf)
    index = retrieval.TfidfIndex.build(corpus)
    queries = retrieval.paraphrase_queries(spark)
    return retrieval.paraphrase_cases(index.query(queries, 5), queries, corpus).drop("query_id")


@query("s6_saved_index_round_trip",
       "SELECT 0::BIGINT AS differing_rows, 5 * count(*) AS answers FROM benchmark")
def saved_index_round_trip(spark, sf):
    """A reloaded index answers like the one that was saved: differing rows, expected none."""
    path = scratch_path(spark, "index")
    index = retrieval.TfidfIndex.build(intake.complaints(spark, sf))
    index.save(path)
    q = benchmark_queries(spark, sf)
    a, b = index.query(q, 5), retrieval.TfidfIndex.load(spark, path).query(q, 5)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(
        F.count("*").alias("differing_rows"), F.lit(b.count()).alias("answers"))
