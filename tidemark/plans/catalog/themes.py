"""Queries: dense vectors, cluster quality, topic terms and summaries, surges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicon, text as X
from tidemark.operators import quality, retrieval, selection, topics, vectors
from tidemark.operators.projections import ProjectionIndex
from tidemark.operators.ranking import best
from tidemark.plans.catalog import sql
from tidemark.plans.catalog.retrieval import _STOPPED
from tidemark.policy.labels import CATEGORIES
from tidemark.session import stored
from tidemark.sources import complaints as corpus_source, intake

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


NOISE_LABEL = 0


def unit_embeddings(spark, sf):
    e = intake.spread(intake.table(spark, sf, "embeddings"))
    return quality.with_unit_vectors(e)


def clustered(spark, sf):
    """Embeddings with their label as cluster, one label standing in for noise."""
    return unit_embeddings(spark, sf).withColumn(
        "cluster_id", F.when(F.col("label") == NOISE_LABEL, -1).otherwise(F.col("label")))


_UNIT = """raw_e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
len_e AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM raw_e),
unit_e AS (SELECT vec_id, label, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id,
  list_transform(v, lambda x: x / l) AS v FROM len_e)"""


def _means(source, group, name, unit=True):
    scale = f"list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))" if unit else "c"
    return f"""{name}_p AS (SELECT {group}, pos, avg(x) AS x FROM (SELECT {group}, unnest(v) AS x,
  generate_subscripts(v, 1) AS pos FROM {source}) GROUP BY ALL),
{name}_c AS (SELECT {group}, list(x ORDER BY pos) AS c FROM {name}_p GROUP BY {group}),
{name} AS (SELECT {group}, {scale} AS c FROM {name}_c)"""


@query(
    "a17_label_centroids",
    sql.with_(_UNIT, _means("unit_e", "label", "m"))
    + "SELECT label, generate_subscripts(c, 1)::INTEGER AS dim, round(unnest(c), 6) AS x FROM m",
)
def label_centroids(spark, sf):
    m = vectors.group_means(unit_embeddings(spark, sf), "label")
    return m.select("label", F.posexplode("centroid").alias("dim", "x")).select(
        "label", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("x"))


_TOP5 = """SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT m.label::BIGINT AS query_id, e.vec_id, round(list_dot_product(e.v, m.c), 9) AS score,
    row_number() OVER (PARTITION BY m.label ORDER BY round(list_dot_product(e.v, m.c), 9) DESC, e.vec_id) AS rank
  FROM unit_e e, m) WHERE rank <= 5"""


def label_queries(spark, sf):
    m = vectors.group_means(unit_embeddings(spark, sf), "label")
    return m.select(F.col("label").cast("bigint").alias("query_id"),
                    F.col("centroid").alias("embedding"),
                    F.col("label").cast("string").alias("category"))


@query("k19_dense_similar_cases", sql.with_(_UNIT, _means("unit_e", "label", "m")) + _TOP5)
def dense_similar_cases(spark, sf):
    """Nearest vectors of each label's mean vector."""
    top = vectors.top_k_cosine(unit_embeddings(spark, sf), label_queries(spark, sf), 5)
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "k20_dense_retrieval_quality",
    sql.with_(_UNIT, _means("unit_e", "label", "m"), f"t AS ({_TOP5})",
              "r AS (SELECT t.*, e.label = t.query_id AS ok FROM t JOIN embeddings e ON e.vec_id = t.vec_id)",
              """q AS (SELECT query_id, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS p,
                max(CASE WHEN ok THEN 1 ELSE 0 END) AS hit, coalesce(1.0::DOUBLE / min(rank) FILTER (ok), 0) AS rr,
                max(round(score, 4)) FILTER (rank = 1) AS top1 FROM r GROUP BY query_id)""")
    + """SELECT round(avg(p), 4) AS precision_at_k, round(avg(hit), 4) AS hit_rate_at_k, round(avg(rr), 4) AS mrr_at_k,
      round(avg(top1), 4) AS mean_top1_similarity, count(*) AS queries_evaluated, 5 AS top_k FROM q""",
)
def dense_retrieval_quality(spark, sf):
    e, q = unit_embeddings(spark, sf), label_queries(spark, sf)
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("category"))
    found = vectors.top_k_cosine(e, q, 5).withColumnRenamed("vec_id", "doc_id")
    return retrieval.evaluate(found, q, corpus)


#: Every row whose id it divides is a query of the approximate search.
ASKED = 20


def _others(found):
    """The five best rows that are not the query's own."""
    return best(found.filter("vec_id <> query_id").drop("rank"), 5, row_id="vec_id")


def _asked(e):
    return e.filter(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("j6_projection_search")
def projection_search(spark, sf):
    """Approximate nearest vectors of every twentieth row, its own left out."""
    e = intake.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _others(ProjectionIndex.build(e).query(_asked(e), 6))


@query(
    "j6_projection_recall",
    f"""WITH n AS (SELECT count(*) AS n_rows, count(*) FILTER (vec_id % {ASKED} = 0) AS n_queries FROM embeddings)
SELECT n_queries, n_queries * least(5, n_rows - 1) AS n_wanted, TRUE AS recall_reached FROM n""",
)
def projection_recall(spark, sf):
    """The search above held against the exact one over all its queries: 0.9 of the wanted rows at least."""
    e = intake.table(spark, sf, "embeddings").select("vec_id", "embedding")
    exact = _others(vectors.top_k_cosine(e, _asked(e), 6))
    hits = exact.join(projection_search(spark, sf).select("query_id", "vec_id", F.lit(1).alias("hit")),
                      ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_wanted"),
                    (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


@query(
    "g5_assign_to_centroids",
    sql.with_(_UNIT, "real_e AS (SELECT * FROM unit_e WHERE cluster_id <> -1)",
              _means("real_e", "cluster_id", "m"))
    + """SELECT vec_id, CASE WHEN sim < 0.25 THEN -1 ELSE cluster_id END AS cluster_id, round(sim, 6) AS similarity FROM (
      SELECT e.vec_id, m.cluster_id, round(list_dot_product(e.v, m.c), 9) AS sim, row_number() OVER (
        PARTITION BY e.vec_id ORDER BY round(list_dot_product(e.v, m.c), 9) DESC, m.cluster_id) AS rn
      FROM unit_e e, m) WHERE rn = 1""",
)
def assign_to_centroids(spark, sf):
    """Closest centroid of each vector, -1 where none is similar enough."""
    e = clustered(spark, sf)
    c = vectors.group_means(e.filter("cluster_id <> -1"), "cluster_id")
    return vectors.nearest_centroid(e, c, "vec_id").withColumn(
        "similarity", F.round("similarity", 6))


@query(
    "a14_a15_cluster_sizes",
    sql.with_(_UNIT, "s AS (SELECT cluster_id, count(*) AS k FROM unit_e GROUP BY 1)")
    + """SELECT sum(k)::BIGINT AS n_samples, count(*) FILTER (cluster_id <> -1) AS n_clusters,
      coalesce(sum(k) FILTER (cluster_id = -1), 0)::BIGINT AS noise_count,
      round(coalesce(sum(k) FILTER (cluster_id = -1), 0)::DOUBLE / sum(k), 6) AS noise_rate,
      min(k) FILTER (cluster_id <> -1) AS min_cluster_size, max(k) FILTER (cluster_id <> -1) AS max_cluster_size,
      round(avg(k) FILTER (cluster_id <> -1), 6) AS mean_cluster_size,
      quantile_cont(k::DOUBLE, 0.5) FILTER (cluster_id <> -1) AS median_cluster_size FROM s""",
)
def cluster_sizes(spark, sf):
    d = quality.size_distribution(clustered(spark, sf)).drop("cluster_sizes")
    return d.withColumn("noise_rate", F.round("noise_rate", 6)).withColumn(
        "mean_cluster_size", F.round("mean_cluster_size", 6))


_COHERENCE = """coh AS (SELECT a.cluster_id, avg(list_dot_product(a.v, b.v)) AS pairwise_coherence
  FROM unit_e a JOIN unit_e b ON a.cluster_id = b.cluster_id AND a.vec_id < b.vec_id
  WHERE a.cluster_id <> -1 GROUP BY a.cluster_id)"""


@query(
    "g9_pairwise_coherence",
    sql.with_(_UNIT, _COHERENCE)
    + "SELECT cluster_id, round(pairwise_coherence, 6) AS pairwise_coherence FROM coh",
)
def pairwise_coherence(spark, sf):
    c = quality.pairwise_coherence(clustered(spark, sf))
    return c.select("cluster_id", F.round("pairwise_coherence", 6).alias("pairwise_coherence"))


_DB = _means("real_e", "cluster_id", "m", unit=False) + """,
sc AS (SELECT e.cluster_id, avg(list_distance(e.v, m.c)) AS s FROM real_e e JOIN m ON e.cluster_id = m.cluster_id GROUP BY 1),
pr AS (SELECT a.cluster_id, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS worst FROM m a JOIN m b ON a.cluster_id <> b.cluster_id
  JOIN sc sa ON sa.cluster_id = a.cluster_id JOIN sc sb ON sb.cluster_id = b.cluster_id GROUP BY 1),
db AS (SELECT avg(worst) AS davies_bouldin FROM pr)"""
_REAL = "real_e AS (SELECT * FROM unit_e WHERE cluster_id <> -1)"


@query(
    "g8_davies_bouldin",
    sql.with_(_UNIT, _REAL, _DB) + "SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db",
)
def davies_bouldin(spark, sf):
    """Scatter of clusters against the distance of their centroids."""
    return quality.davies_bouldin(clustered(spark, sf)).select(
        F.round("davies_bouldin", 6).alias("davies_bouldin"))


_SIL = """pd AS (SELECT a.vec_id, a.cluster_id AS own, b.cluster_id AS other, sum(1 - list_dot_product(a.v, b.v)) AS d, count(*) AS k
  FROM real_e a, real_e b GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN own = other THEN CASE WHEN k > 1 THEN d / (k - 1) END END) AS a,
  min(CASE WHEN own <> other THEN d / k END) AS b FROM pd GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab)"""


@query(
    "g7_silhouette",
    sql.with_(_UNIT, _REAL, _SIL) + "SELECT round(silhouette, 6) AS silhouette FROM sil",
)
def silhouette(spark, sf):
    value = quality.silhouette(clustered(spark, sf))
    return spark.range(1).select(F.round(F.lit(value), 6).alias("silhouette"))


@query(
    "g11_quality_report",
    sql.with_(_UNIT, _REAL, _COHERENCE, _DB, _SIL,
              "s AS (SELECT cluster_id, count(*) AS k FROM unit_e GROUP BY 1)",
              """rep AS (SELECT sum(k)::BIGINT AS n_samples, count(*) FILTER (cluster_id <> -1) AS n_clusters,
                coalesce(sum(k) FILTER (cluster_id = -1), 0)::DOUBLE / sum(k) AS noise,
                min(k) FILTER (cluster_id <> -1) AS lo, max(k) FILTER (cluster_id <> -1) AS hi,
                (SELECT avg(pairwise_coherence) FROM coh) AS coherence FROM s)""")
    + """SELECT n_samples, n_clusters, round(noise, 4) AS noise_rate, lo AS min_cluster_size, hi AS max_cluster_size,
      round((SELECT silhouette FROM sil), 4) AS silhouette, round((SELECT davies_bouldin FROM db), 4) AS davies_bouldin,
      round(coherence, 4) AS intra_cluster_coherence,
      NOT (noise > 0.65 OR hi > 0.70 * n_samples OR coherence < 0.10) AS is_actionable,
      CASE WHEN NOT (noise > 0.65 OR hi > 0.70 * n_samples OR coherence < 0.10 OR lo < 5)
        THEN 'Passes all quality checks: coherent clusters, controlled noise, distinct themes.'
      ELSE concat_ws('|',
        CASE WHEN noise > 0.65 THEN 'Noise rate is too high (' || printf('%.1f%%', noise * 100) || '). More than 65% of complaints unclustered.' END,
        CASE WHEN lo < 5 THEN 'Smallest cluster has only ' || lo || ' complaints; may be an outlier artifact.' END,
        CASE WHEN hi > 0.70 * n_samples THEN 'Largest cluster contains ' || printf('%.1f%%', hi * 100.0 / n_samples) || ' of all data (undifferentiated megacluster).' END,
        CASE WHEN coherence < 0.10 THEN 'Intra-cluster semantic coherence is low (' || printf('%.3f', coherence) || ' < 0.10).' END) END AS reasons FROM rep""",
)
def quality_report(spark, sf):
    r = quality.report(clustered(spark, sf))
    return r.select("n_samples", "n_clusters", "noise_rate", "min_cluster_size", "max_cluster_size",
                    "silhouette", "davies_bouldin", "intra_cluster_coherence", "is_actionable",
                    F.array_join("actionability_reasons", "|").alias("reasons"))


@query(
    "g12_all_noise_report",
    """SELECT count(*) AS n_samples, 0::BIGINT AS n_clusters, 1.0::DOUBLE AS noise_rate, FALSE AS is_actionable,
      'No valid clusters formed; all points classified as noise.' AS reasons FROM embeddings""",
)
def all_noise_report(spark, sf):
    r = quality.report(unit_embeddings(spark, sf).withColumn("cluster_id", F.lit(-1)))
    return r.select("n_samples", "n_clusters", "noise_rate", "is_actionable",
                    F.array_join("actionability_reasons", "|").alias("reasons"))


# --- topic terms and summaries ---------------------------------------------


def by_category(spark, sf):
    """Cleaned labelled complaints, the category's position as cluster id."""
    rows = X.with_clean_text(corpus_source.labelled(intake.complaints(spark, sf)))
    at = F.array_position(lexicon.strings(CATEGORIES), F.col("category")).cast("int") - 1
    return rows.withColumn("cluster_id", at).select("doc_id", "cleaned", "category", "cluster_id")


def class_terms_sql(source, name="ct", n=topics.TOP_TERMS):
    """CTEs ending in ``{name}`` (cluster_id, term, score, rank) for (doc_id, cleaned, cluster_id)."""
    return f"""{name}_src AS (SELECT doc_id, cluster_id, {_STOPPED} AS toks FROM {source} WHERE cluster_id <> -1),
{name}_uni AS (SELECT doc_id, cluster_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM {name}_src),
{name}_lead AS (SELECT cluster_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {name}_uni),
{name}_all AS (SELECT cluster_id, term FROM {name}_lead UNION ALL
  SELECT cluster_id, term || ' ' || nxt FROM {name}_lead WHERE nxt IS NOT NULL),
{name}_cnt AS (SELECT cluster_id, term, count(*) AS n_tc FROM {name}_all GROUP BY ALL),
{name}_tot AS (SELECT term, sum(n_tc)::BIGINT AS f_t FROM {name}_cnt GROUP BY term ORDER BY f_t DESC, term LIMIT {topics.MAX_TERMS}),
{name}_k AS (SELECT c.*, t.f_t, sum(n_tc) OVER (PARTITION BY cluster_id) AS words FROM {name}_cnt c JOIN {name}_tot t ON c.term = t.term),
{name}_m AS (SELECT avg(words) AS mean_words FROM (SELECT cluster_id, max(words) AS words FROM {name}_k GROUP BY 1)),
{name}_s AS (SELECT cluster_id, term, round(n_tc::DOUBLE / words * ln(1.0 + mean_words / f_t), 12) AS score FROM {name}_k, {name}_m),
{name} AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term))::INTEGER AS rank
  FROM {name}_s) WHERE rank <= {n} AND score > 0)"""


_BY_CATEGORY = (
    "bc AS (SELECT doc_id, cleaned, CASE category "
    + " ".join(f"WHEN {sql.q(c)} THEN {i}" for i, c in enumerate(CATEGORIES))
    + " END AS cluster_id FROM labelled)"
)


@query(
    "g4_class_terms",
    sql.with_(sql.LABELLED, _BY_CATEGORY, class_terms_sql("bc"))
    + "SELECT cluster_id, term, round(score, 9) AS score, rank FROM ct",
)
def class_terms(spark, sf):
    """Distinctive terms per category."""
    return topics.class_terms(by_category(spark, sf), "cleaned").withColumn(
        "score", F.round("score", 9))


@query(
    "g10_term_distinctiveness",
    sql.with_(sql.LABELLED, _BY_CATEGORY, class_terms_sql("bc"))
    + "SELECT round(count(DISTINCT term)::DOUBLE / count(*), 6) AS term_distinctiveness FROM ct",
)
def term_distinctiveness(spark, sf):
    terms = topics.class_terms(by_category(spark, sf), "cleaned")
    return quality.term_distinctiveness(terms).select(
        F.round("term_distinctiveness", 6).alias("term_distinctiveness"))


def vector_topics(spark, sf):
    """Complaints with a vector's label as topic, one label being noise, and the similarity to
    the topic's centroid. Documents share the vectors out among them in id order."""
    e = clustered(spark, sf).drop("label")
    c = vectors.group_means(e, "cluster_id")
    n_docs = intake.table(spark, sf, "documents").count()
    n_vecs = intake.table(spark, sf, "embeddings").count()
    dot = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: a * b), F.lit(0.0),
                      lambda s, x: s + x)
    # one centroid per topic
    sims = e.join(F.broadcast(c.select("cluster_id", "centroid")), "cluster_id").select(
        "vec_id", "cluster_id", dot.alias("similarity"))
    rows = X.with_clean_text(intake.timed_complaints(spark, sf)).withColumn(
        "category", F.coalesce(corpus_source.category_of(), F.lit("Unlabelled")))
    rows = rows.withColumn("vec_id", F.expr(f"doc_id * {n_vecs} div {n_docs}"))
    rows = rows.join(sims, "vec_id", "left").withColumn(
        "cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return stored(rows, "vector-topics")


_VECTOR_TOPICS = [
    sql.TIMED,
    f"timed_c AS (SELECT *, {sql.clean('narrative')} AS cleaned, coalesce({sql.CATEGORY}, 'Unlabelled') AS category FROM timed)",
    _UNIT,
    _means("unit_e", "cluster_id", "m"),
    """vt AS (SELECT t.*, coalesce(e.cluster_id, -1) AS cluster_id, list_dot_product(e.v, m.c) AS similarity FROM timed_c t
       LEFT JOIN unit_e e ON e.vec_id = t.doc_id * (SELECT count(*) FROM embeddings) // (SELECT count(*) FROM documents)
       LEFT JOIN m ON m.cluster_id = e.cluster_id)""",
    class_terms_sql("vt"),
    """tt AS (SELECT cluster_id, list(term ORDER BY rank) AS top_terms FROM ct GROUP BY cluster_id)""",
    """dom AS (SELECT cluster_id, category AS dominant_category FROM (SELECT cluster_id, category, row_number() OVER (
         PARTITION BY cluster_id ORDER BY count(*) DESC, category) AS rn FROM vt WHERE cluster_id <> -1 GROUP BY cluster_id, category) WHERE rn = 1)""",
    """ex AS (SELECT cluster_id, string_agg(doc_id::VARCHAR, '|' ORDER BY rn) AS exemplars FROM (SELECT cluster_id, doc_id, row_number() OVER (
         PARTITION BY cluster_id ORDER BY round(similarity, 9) DESC, doc_id) AS rn FROM vt WHERE cluster_id <> -1) WHERE rn <= 3 GROUP BY cluster_id)""",
    """base AS (SELECT cluster_id, count(*) AS size, avg(similarity) AS coherence,
         round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM vt), 2) AS prevalence_pct FROM vt WHERE cluster_id <> -1 GROUP BY cluster_id)""",
    """top AS (SELECT b.*, tt.top_terms, dom.dominant_category, ex.exemplars FROM base b JOIN tt ON b.cluster_id = tt.cluster_id
         JOIN dom ON b.cluster_id = dom.cluster_id JOIN ex ON b.cluster_id = ex.cluster_id)""",
]


def _summaries(rows):
    terms = topics.class_terms(rows, "cleaned")
    rows = rows.withColumn("doc_name", F.col("doc_id").cast("string"))
    return topics.summaries(rows, terms, text="doc_name")


@query(
    "g6_topic_summaries",
    sql.with_(*_VECTOR_TOPICS)
    + """SELECT cluster_id, size, prevalence_pct, round(coherence, 4) AS coherence, dominant_category,
      array_to_string(top_terms, '|') AS top_terms, exemplars FROM top""",
)
def topic_summaries(spark, sf):
    """Size, prevalence, terms, exemplars, coherence and categories."""
    s = _summaries(vector_topics(spark, sf))
    return s.select("cluster_id", "size", "prevalence_pct", "coherence", "dominant_category",
                    F.array_join("top_terms", "|").alias("top_terms"),
                    F.array_join("representative_complaints", "|").alias("exemplars"))


@query(
    "a16_category_distribution",
    sql.with_(*_VECTOR_TOPICS)
    + """SELECT cluster_id, category, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY cluster_id), 6) AS share
      FROM vt WHERE cluster_id <> -1 GROUP BY cluster_id, category""",
)
def category_distribution(spark, sf):
    rows = vector_topics(spark, sf).filter("cluster_id <> -1")
    d = quality.dominant(rows)
    return d.select("cluster_id", F.explode("category_distribution").alias("category", "share")).withColumn(
        "share", F.round("share", 6))


_TITLE = ("array_to_string(list_transform(regexp_extract_all(array_to_string(top_terms[1:3], ' / '), "
          "'\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), '')")


@query(
    "g14_surge_alerts",
    sql.with_(
        *_VECTOR_TOPICS,
        """p AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts NULLS FIRST, doc_id) <= floor((count(*) OVER ()) * 0.5)
             THEN 'baseline' ELSE 'recent' END AS period FROM vt)""",
        """vol AS (SELECT cluster_id, count(*) FILTER (period = 'recent') AS r, count(*) FILTER (period = 'baseline') AS b FROM p GROUP BY 1)""",
        "sc AS (SELECT greatest(sum(r), 1)::DOUBLE / greatest(sum(b), 1) AS scale FROM vol)",
        """g AS (SELECT t.*, coalesce(r, 0) AS recent_volume, coalesce(b, 0) AS baseline_volume,
             greatest(coalesce(b, 0) * scale, 0.5) AS bn FROM top t LEFT JOIN vol v ON t.cluster_id = v.cluster_id, sc)""",
        """f AS (SELECT *, (recent_volume - bn) / bn AS gr FROM g WHERE recent_volume >= 5 AND (recent_volume - bn) / bn >= 0.02
             AND round(coherence, 4) >= 0.05)""",
        "late AS (SELECT * FROM p WHERE period = 'recent')",
        sql.with_severity("late"),
        "risk AS (SELECT cluster_id, avg(risk_score) AS risk FROM scored GROUP BY 1)",
        """a AS (SELECT f.*, coalesce(risk, 0) AS risk, CASE WHEN coalesce(risk, 0) >= 0.6 THEN 'High' WHEN coalesce(risk, 0) >= 0.3
             THEN 'Medium' ELSE 'Low' END AS lvl FROM f LEFT JOIN risk k ON k.cluster_id = f.cluster_id)""",
    )
    + f"""SELECT cluster_id, {_TITLE} AS theme_name, dominant_category, recent_volume, baseline_volume, round(gr, 4) AS growth_rate,
      round(gr * 100, 1) AS growth_percentage, round(coherence, 4) AS coherence, round(risk, 4) AS avg_severity_score, lvl AS severity_level,
      CASE WHEN lvl = 'High' AND gr * 100 >= 50 THEN 'Critical' WHEN lvl = 'High' OR gr * 100 >= 50 THEN 'High'
           WHEN gr * 100 >= 25 THEN 'Moderate' ELSE 'Monitor' END AS urgency FROM a""",
)
def surge_alerts(spark, sf):
    """Themes of complaints growing between the earlier and later half."""
    rows = vector_topics(spark, sf)
    alerts = topics.surges(
        selection.chronological_split(rows, 0.5), _summaries(rows), text="narrative",
        growth_threshold=0.02, min_recent_volume=5, min_coherence=0.05)
    return alerts.select("cluster_id", "theme_name", "dominant_category", "recent_volume",
                         "baseline_volume", "growth_rate", "growth_percentage", "coherence",
                         "avg_severity_score", "severity_level", "urgency")
