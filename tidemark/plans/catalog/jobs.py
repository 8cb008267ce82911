"""Queries: topic discovery, full triage and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidemark.functions.text import with_clean_text
from tidemark.operators import clustering, density, retrieval, topics
from tidemark.plans import stages, training, triage
from tidemark.plans.catalog import learning, sql
from tidemark.plans.catalog.rules import _BOARD
from tidemark.policy import domain as domain_policy
from tidemark.session import scratch_path, stored
from tidemark.sources import complaints as corpus_source, intake, reports
from tidemark.streaming import stream

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


_CORPORA: dict = {}
_SPACES: dict = {}


def corpus(spark, sf):
    rows = corpus_source.labelled(intake.complaints(spark, sf))
    rows = with_clean_text(rows).select("doc_id", "cleaned", "category")
    return learning.once(_CORPORA, spark, sf, lambda: stored(rows, "topic-corpus"))


def space(spark, sf):
    return learning.once(_SPACES, spark, sf, lambda: clustering.TopicSpace.fit(corpus(spark, sf)))


def kmeans_model(spark, sf):
    return clustering.TopicModel.fit(corpus(spark, sf), n_clusters=8, space=space(spark, sf))


@query("v9_topic_vectors")
def topic_vectors(spark, sf):
    """Unit vectors in topic space."""
    return space(spark, sf).embeddings.select(
        "doc_id", F.size("embedding").alias("dims"), F.to_json("embedding").alias("embedding"))


@query("g1_kmeans_topics")
def kmeans_topics(spark, sf):
    m = kmeans_model(spark, sf)
    return m.topics.select("cluster_id", "size", "prevalence_pct", "coherence", "dominant_category",
                           F.array_join("top_terms", "|").alias("top_terms"))


@query("g2_density_topics")
def density_topics(spark, sf):
    """Topics that are dense groups of the topic space; the rest is noise."""
    n = space(spark, sf).n_rows
    size, samples = density.group_sizes(n, density.MIN_CLUSTER_SIZE, density.MIN_SAMPLES)
    m = clustering.TopicModel.fit(corpus(spark, sf), space=space(spark, sf), method="density",
                                  min_cluster_size=size, min_samples=samples)
    return m.topics.select("cluster_id", "size", "prevalence_pct", "coherence", "dominant_category",
                           F.array_join("top_terms", "|").alias("top_terms"))


_GROUP = {"size": 4, "samples": 4, "least": 0.34}


@query(
    "g2_density_groups",
    f"""WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
        sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
      near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
        ON round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) >= {_GROUP['least']}::DOUBLE),
      core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {_GROUP['samples']}),
      links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
      reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
      roots AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a),
      sizes AS (SELECT root, count(*) AS size FROM roots GROUP BY root HAVING count(*) >= {_GROUP['size']}),
      numbered AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS cluster_id FROM sizes)
      SELECT e.vec_id, coalesce(cluster_id, -1)::INTEGER AS cluster_id FROM embeddings e
      LEFT JOIN roots USING (vec_id) LEFT JOIN numbered USING (root)""",
)
def density_groups(spark, sf):
    """Dense groups of the given vectors."""
    rows = intake.table(spark, sf, "embeddings")
    return density.density_labels(rows, _GROUP["size"], _GROUP["samples"], _GROUP["least"], "vec_id")


@query("g13_configuration_sweep")
def configuration_sweep(spark, sf):
    """Quality of the density and k-means configurations and which one to use."""
    rows, _ = clustering.sweep(corpus(spark, sf))
    choice = clustering.recommend(rows)
    return rows.select(
        "configuration", "algorithm", "n_samples", "n_clusters", "noise_rate", "silhouette",
        "davies_bouldin", "intra_cluster_coherence", "term_distinctiveness", "is_actionable",
        choice.select("recommended_configuration").scalar().alias("recommended"))


@query("g18_report_rows")
def report_rows(spark, sf):
    """A stored clustering report flattened to display rows."""
    m = kmeans_model(spark, sf)
    q = m.quality().select(*[F.col(c) for c in (
        "n_samples", "n_clusters", "noise_count", "noise_rate", "cluster_sizes",
        "min_cluster_size", "max_cluster_size", "mean_cluster_size", "median_cluster_size",
        "silhouette", "davies_bouldin", "intra_cluster_coherence", "term_distinctiveness",
        "is_actionable", "actionability_reasons")])
    doc = q.select(F.create_map(F.lit("MiniBatchKMeans_K8"), F.struct(
        F.struct(F.lit("MiniBatchKMeans_K8").alias("name"), F.lit("kmeans").alias("method"),
                 F.lit(8).alias("n_clusters")).alias("config"),
        F.struct("*").alias("quality_report"))).alias("configurations"))
    path = scratch_path(spark, "clustering-report")
    reports.write_report(doc, path)
    return reports.clustering_rows(reports.read_report(spark, path, reports.CLUSTERING_REPORT))


@query("g17_topic_surges")
def topic_surges(spark, sf):
    """Fitted topics whose volume grew between the halves of the period."""
    from tidemark.operators import selection

    m = kmeans_model(spark, sf)
    rows = with_clean_text(corpus_source.labelled(intake.timed_complaints(spark, sf)))
    placed = rows.join(m.predict(rows), "doc_id").select("doc_id", "ts", "narrative", "cluster_id")
    halves = selection.chronological_split(stored(placed, "timed-topics"))
    return topics.surges(halves, m.topics, growth_threshold=0.02, min_recent_volume=5,
                         min_coherence=0.05).select(
        "cluster_id", "theme_name", "dominant_category", "recent_volume", "baseline_volume",
        "growth_rate", "severity_level", "urgency")


@query("s6_saved_topics_round_trip",
       sql.with_(sql.LABELLED) + "SELECT 0::BIGINT AS differing_rows, count(*) AS answers FROM labelled")
def saved_topics_round_trip(spark, sf):
    """Reloaded topics assign like the saved ones: differing rows, expected none."""
    path = scratch_path(spark, "topics")
    m, rows = kmeans_model(spark, sf), corpus(spark, sf)
    m.save(path)
    cols = ("doc_id", "cluster_id")
    a = m.predict(rows).select(*cols)
    b = clustering.TopicModel.load(spark, path).predict(rows).select(*cols)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(
        F.count("*").alias("differing_rows"), F.lit(b.count()).alias("answers"))


@query("s6_saved_pipeline_round_trip",
       sql.with_(sql.LABELLED, sql.with_domain("labelled"))
       + """SELECT 0::BIGINT AS differing_rows, count(*) AS answers,
         count(*) FILTER (in_domain) AS accepted, count(*) FILTER (NOT in_domain) AS rejected FROM gated""")
def saved_pipeline_round_trip(spark, sf):
    """The whole triage as one fitted pipeline: reloaded, it judges like the saved one. Differing rows, expected none."""
    train = learning.rows(spark, sf).select(
        "doc_id", F.col("text").alias("narrative"), F.col("category").alias("label"), "split")
    fitted = stages.triage_pipeline().fit(train)
    path = scratch_path(spark, "triage-pipeline")
    fitted.write().save(path)
    asked = corpus_source.labelled(intake.complaints(spark, sf)).select("doc_id", "narrative")
    cols = ("doc_id", "category", "confidence", "in_domain", "sub_issue", "severity_level", "risk_score",
            "target_queue", "sla_hours", "priority")
    a = stored(fitted.transform(asked).select(*cols), "judged")
    b = stored(PipelineModel.load(path).transform(asked).select(*cols), "judged-again")
    other = b.select("doc_id", F.struct(*cols).alias("again"))
    both = a.select("doc_id", F.struct(*cols).alias("first"), "in_domain").join(other, "doc_id", "full")
    return both.agg(
        F.count_if(~F.col("first").eqNullSafe(F.col("again"))).alias("differing_rows"),
        F.count("again").alias("answers"), F.count_if("in_domain").alias("accepted"),
        F.count_if(~F.col("in_domain")).alias("rejected"))


@query("k22_engine_choice")
def engine_choice(spark, sf):
    """TF-IDF against topic-space vectors on the paraphrase queries."""
    from tidemark.operators import lsa, vectors

    cases = corpus_source.labelled(intake.complaints(spark, sf))
    queries = retrieval.paraphrase_queries(spark)
    sp = space(spark, sf)
    asked = with_clean_text(queries, "query").select("query_id", "cleaned")
    asked = lsa.embed(sp.features.transform(asked, "cleaned"), sp.basis, len(sp.features.terms), "query_id")
    found = {
        "tfidf": retrieval.TfidfIndex.build(cases).query(queries, 5),
        "dense": vectors.top_k_cosine(sp.embeddings, asked, 5, "doc_id"),
    }
    scores = None
    for name, matches in found.items():
        one = retrieval.paraphrase_scores(retrieval.paraphrase_cases(matches, queries, cases)).select(
            "paraphrase_top1_accuracy",
            retrieval.evaluate(matches, queries, cases).select("mrr_at_k").scalar().alias("mrr_at_k"),
            F.lit(name).alias("engine"))
        scores = one if scores is None else scores.unionByName(one)
    return retrieval.choose_engine(scores)


@query("k23_full_triage")
def full_triage(spark, sf):
    """Test narratives and all unlabelled ones, judged with models fitted on the training part."""
    arriving, models = _arriving(spark, sf)
    out = triage.analyze(arriving, **models)
    return out.select("doc_id", F.to_json(F.struct(*triage.PAYLOAD)).alias("payload"))


#: Batches at most in which a stream takes a table of narratives, whatever its size: each batch meets the whole index.
NARRATIVE_PARTS = 4
#: Rows of a file that arrives; a batch of many files is dealt evenly to its tasks.
FILE_ROWS = 2_000


def _as_files(rows, path):
    """Writes narratives as files that arrive, and returns how many of them are a batch."""
    rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    spark = rows.sparkSession
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    # A file is no more than a task, so a batch of few files would leave cores idle.
    return max(-(-files // NARRATIVE_PARTS), min(files, spark.sparkContext.defaultParallelism), 1)


def _arriving(spark, sf):
    known = learning.rows(spark, sf)
    history = training.part(known, "train").withColumnRenamed("text", "narrative")
    everything = intake.complaints(spark, sf)
    arriving = everything.join(history.select("doc_id"), "doc_id", "left_anti").select("doc_id", "narrative")
    return arriving, {
        "classifier": learning.trained(spark, sf), "index": retrieval.TfidfIndex.build(history),
        "cases": history, "topic_model": kmeans_model(spark, sf),
    }


@query("k23_triage_stream")
def full_triage_stream(spark, sf):
    """The same narratives arriving as files, judged by a stream with the same models."""
    arriving, models = _arriving(spark, sf)
    path, arrivals, out = (scratch_path(spark, n) for n in ("narratives", "arrivals", "judged"))
    files = _as_files(arriving, path)
    narratives = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.full_triage_stream(narratives, arrivals, out, **models).option(
        "checkpointLocation", scratch_path(spark, "judged-state")).trigger(
        availableNow=True).start().awaitTermination()
    judged = spark.read.option("basePath", out).parquet(out)
    return judged.select("doc_id", F.to_json(F.struct(*triage.PAYLOAD)).alias("payload"))


# --- streams ---------------------------------------------------------------


@query(
    "r1_triage_stream",
    _BOARD.replace(f"WHERE narrative IS NOT NULL AND {sql.KNOWN}", "").replace(
        f"{sql.CATEGORY} AS category", f"coalesce({sql.CATEGORY}, 'Unclassified') AS category").replace(
        "sub_issue_confidence AS confidence, FALSE AS is_uncertain",
        "CASE WHEN category = 'Unclassified' THEN 0.5 ELSE sub_issue_confidence END AS confidence, "
        "category = 'Unclassified' AS is_uncertain")
    + f"""SELECT doc_id, in_domain, CASE WHEN in_domain THEN category ELSE 'Out of Domain' END AS category,
      CASE WHEN in_domain THEN severity_level ELSE 'Low' END AS severity_level,
      CASE WHEN in_domain THEN target_queue ELSE {sql.q(domain_policy.REJECTED['target_queue'])} END AS target_queue,
      CASE WHEN in_domain THEN sla_hours ELSE 72 END AS sla_hours FROM routed""",
)
def triage_stream(spark, sf):
    """Narratives arriving as files, triaged by a stream, equal to the batch result."""
    path = scratch_path(spark, "arriving")
    files = _as_files(intake.complaints(spark, sf).select("doc_id", "narrative", "product"), path)
    out = stream.triage_stream(stream.read_files(spark, path, stream.NARRATIVES, files))
    return stream.run_to_end(out.select(
        "doc_id", "in_domain", "category", "severity_level", "target_queue", "sla_hours"))


EVENT_PARTS = 6


def theme_events(spark, sf):
    """Events as a stream of themes, in six parts of rising time, and the files of a part.

    A stream takes files in the order they were written, so parts are written one after the other; each is
    spread over as many files as the table has partitions, read together by one batch. Events without a time come first.
    """
    path, sorted_out = scratch_path(spark, "events"), scratch_path(spark, "events-by-time")
    e = intake.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("theme"))
    at = F.unix_micros("ts")
    cuts = e.select(at.alias("at")).approxQuantile("at", [i / EVENT_PARTS for i in range(1, EVENT_PARTS)], 0.01)
    part = sum((F.coalesce(at > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    e.withColumn("part", part).write.partitionBy("part").parquet(sorted_out)
    files = max(1, e.rdd.getNumPartitions())
    by_time = spark.read.parquet(sorted_out)
    for i in range(EVENT_PARTS):
        by_time.filter(F.col("part") == i).drop("part").repartition(files).write.mode("append").parquet(path)
    return path, files


_WIN = "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')"
_CLOSED = "WHERE window_start + INTERVAL '7 days' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'"
_VOL = f"""WITH v AS (SELECT {_WIN} AS window_start, event_type AS theme, count(*) AS volume FROM events GROUP BY ALL)"""


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    "r2_weekly_theme_stream",
    _VOL + f" SELECT strftime(window_start, '%Y-%m-%d') AS week, theme, volume FROM v {_CLOSED}",
)
def weekly_theme_stream(spark, sf):
    """Weekly volumes of all windows that the watermark has closed."""
    events = stream.read_files(spark, theme_events(spark, sf)[0], stream.THEMES)
    return stream.run_to_end(stream.theme_volumes(events)).select(
        _day("window_start").alias("week"), "theme", "volume")


@query(
    "r3_sliding_baseline",
    """WITH b AS (SELECT unnest([time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') - INTERVAL (i * 7) DAY
        FOR i IN [0, 1, 2, 3, 4]]) AS s, ts, event_type AS theme FROM events)
      SELECT strftime(s, '%Y-%m-%d') AS start_day, theme, count(*) AS volume FROM b
      WHERE ts < s + INTERVAL '30 days' GROUP BY ALL""",
)
def sliding_baseline(spark, sf):
    """Thirty-day volumes moved week by week."""
    e = intake.table(spark, sf, "events").select("ts", F.col("event_type").alias("theme"))
    return stream.theme_volumes(e, stream.BASELINE, stream.RECENT).select(
        _day("window_start").alias("start_day"), "theme", "volume")


_SURGES = """, t AS (SELECT window_start, sum(volume) AS total FROM v GROUP BY 1),
  l AS (SELECT v.*, coalesce(b.volume, 0) AS bv, t.total, coalesce(bt.total, 0) AS bt FROM v
    JOIN t ON t.window_start = v.window_start
    LEFT JOIN v b ON b.theme = v.theme AND b.window_start = v.window_start - INTERVAL '7 days'
    LEFT JOIN t bt ON bt.window_start = v.window_start - INTERVAL '7 days'
    WHERE v.window_start > (SELECT min(window_start) FROM v)),
  g AS (SELECT *, greatest(bv * total::DOUBLE / greatest(bt, 1), 0.5) AS expected FROM l),
  r AS (SELECT *, (volume - expected) / expected AS gr FROM g)
  SELECT strftime(window_start, '%Y-%m-%d') AS week, theme, volume AS recent_volume, bv AS baseline_volume,
    round(gr, 6) AS growth_rate, CASE WHEN gr * 100 >= 50 THEN 'High' WHEN gr * 100 >= 25 THEN 'Moderate' ELSE 'Monitor' END AS urgency
  FROM r WHERE volume >= 10 AND gr >= 0.01"""


@query("r4_window_surges", _VOL + _SURGES)
def window_surges(spark, sf):
    """Themes growing from one week to the next."""
    e = intake.table(spark, sf, "events").select("ts", F.col("event_type").alias("theme"))
    s = stream.window_surges(stream.theme_volumes(e), growth_threshold=0.01)
    return s.withColumn("week", _day("window_start")).drop("window_start")


_BASELINE = (
    _VOL + """, base AS (SELECT w.window_start, e.event_type AS theme, count(*) AS bv
        FROM (SELECT DISTINCT window_start FROM v) w JOIN events e
          ON e.ts < w.window_start AND e.ts >= w.window_start - INTERVAL '30 days' GROUP BY ALL),
      l AS (SELECT v.*, coalesce(bv, 0) AS bv, sum(v.volume) OVER (PARTITION BY v.window_start) AS total,
          (SELECT sum(bv) FROM base b WHERE b.window_start = v.window_start) AS bt
        FROM v LEFT JOIN base b ON b.window_start = v.window_start AND b.theme = v.theme),
      g AS (SELECT *, greatest(bv * total::DOUBLE / greatest(coalesce(bt, 0), 1), 0.5) AS expected FROM l
        WHERE window_start > (SELECT min(window_start) FROM v))
      SELECT strftime(window_start, '%Y-%m-%d') AS week, theme, volume AS recent_volume, bv AS baseline_volume,
        round((volume - expected) / expected, 6) AS growth_rate
      FROM g WHERE volume >= 10 AND (volume - expected) / expected >= 0.01""")


@query("r3_baseline_surges", _BASELINE)
def baseline_surges(spark, sf):
    """Themes growing in a week over the thirty days before it."""
    e = intake.table(spark, sf, "events").select("ts", F.col("event_type").alias("theme"))
    s = stream.baseline_surges(e, growth_threshold=0.01)
    return s.withColumn("week", _day("window_start")).drop("window_start")


def _in_parts(spark, sf):
    """Path, schema and files of a batch for a stream that takes one part of the events after the other."""
    path, files = theme_events(spark, sf)
    return path, stream.THEMES, files


@query("r3_baseline_stream", _BASELINE + f" AND {_CLOSED.removeprefix('WHERE ')}")
def baseline_stream(spark, sf):
    """The same comparison made by a stream with state, as weeks close."""
    weeks, alerts = scratch_path(spark, "baseline-weeks"), scratch_path(spark, "baseline-alerts")
    stream.baseline_surge_stream(
        stream.read_files(spark, *_in_parts(spark, sf)), weeks, alerts, growth_threshold=0.01
    ).option("checkpointLocation", scratch_path(spark, "baseline-state")).trigger(
        availableNow=True).start().awaitTermination()
    found = spark.read.option("basePath", alerts).parquet(alerts)
    return found.select(_day("window_start").alias("week"), "theme", "recent_volume", "baseline_volume", "growth_rate")


@query("r4_surge_stream", _VOL.replace("FROM events GROUP BY ALL", f"FROM events GROUP BY ALL), v AS (SELECT * FROM w0 {_CLOSED}").replace("WITH v AS", "WITH w0 AS") + _SURGES)
def surge_stream(spark, sf):
    """The same comparison made by a stream as weeks close."""
    history, alerts = scratch_path(spark, "weeks"), scratch_path(spark, "alerts")
    events = stream.read_files(spark, *_in_parts(spark, sf))
    stream.surge_stream(events, history, alerts, growth_threshold=0.01).option(
        "checkpointLocation", scratch_path(spark, "surge-state")
    ).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.option("basePath", alerts).parquet(alerts)
    return found.select(_day("window_start").alias("week"), "theme", "recent_volume",
                        "baseline_volume", "growth_rate", "urgency")


@query("r6_resubmissions_dropped", "SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events")
def resubmissions_dropped(spark, sf):
    """Every event sent twice is kept once."""
    path, _ = theme_events(spark, sf)
    sent = stream.read_files(spark, path, stream.THEMES)
    twice = sent.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    kept = stream.run_to_end(stream.drop_resubmissions(twice))
    return kept.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


