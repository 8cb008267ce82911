"""Queries: domain gate, lexicon joins, sub-issues, severity, routing, portfolio aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicon, text as X
from tidemark.functions.domain import with_domain_gate
from tidemark.functions.pinning import unnest
from tidemark.functions.routing import with_routing
from tidemark.functions.severity import with_severity
from tidemark.functions.sub_issue import with_sub_issue
from tidemark.operators import phrases, portfolio
from tidemark.plans import triage
from tidemark.plans.catalog import sql
from tidemark.policy import domain as domain_policy, routing as routing_policy
from tidemark.policy.labels import CATEGORY_BY_PRODUCT
from tidemark.sources import complaints as corpus_source, intake

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def pipe(c):
    return F.array_join(c, "|")


def labelled(spark, sf):
    return corpus_source.labelled(intake.complaints(spark, sf))


def cleaned(spark, sf):
    return X.with_clean_text(labelled(spark, sf))


def scored(spark, sf):
    """Labelled complaints with sub-issue and severity, as the portfolio report sees them."""
    return with_severity(with_sub_issue(cleaned(spark, sf)))


# --- domain gate -----------------------------------------------------------

_GATE = """SELECT doc_id, in_domain, domain_score, array_to_string(financial_terms, '|') AS financial_terms,
  array_to_string(unrelated_terms, '|') AS unrelated_terms, rejection_reason, guidance FROM gated"""


@query("d1_d7_domain_gate", sql.with_(sql.COMPLAINTS, sql.with_domain("complaints")) + _GATE)
def domain_gate(spark, sf):
    g = with_domain_gate(intake.complaints(spark, sf))
    return g.select(
        "doc_id", "in_domain", "domain_score", pipe("financial_terms").alias("financial_terms"),
        pipe("unrelated_terms").alias("unrelated_terms"), "rejection_reason", "guidance",
    )


@query(
    "d2_message_gate",
    sql.with_("m AS (SELECT conv_id, turn, text AS narrative FROM conversations)",
              sql.with_domain("m"))
    + "SELECT conv_id, turn, in_domain, domain_score, rejection_reason FROM gated",
)
def message_gate(spark, sf):
    """Short intake messages: many are too brief."""
    m = intake.spread(intake.table(spark, sf, "conversations")).withColumnRenamed("text", "narrative")
    return with_domain_gate(m).select(
        "conv_id", "turn", "in_domain", "domain_score", "rejection_reason")


@query(
    "d8_reject_out_of_domain",
    sql.with_(sql.CLEANED,
              f"m AS (SELECT *, coalesce({sql.CATEGORY}, 'Unclassified') AS category FROM cleaned)",
              sql.with_domain("m"))
    + f"""SELECT doc_id, in_domain,
      CASE WHEN in_domain THEN category ELSE {sql.q(domain_policy.REJECTED['category'])} END AS category,
      CASE WHEN in_domain THEN NULL ELSE {sql.q(domain_policy.REJECTED['target_queue'])} END AS target_queue,
      CASE WHEN in_domain THEN NULL ELSE 72 END AS sla_hours FROM gated""",
)
def reject_out_of_domain(spark, sf):
    """Accepted and rejected narratives appended to each other (also U4)."""
    c = intake.complaints(spark, sf).withColumn(
        "category", F.coalesce(corpus_source.category_of(), F.lit("Unclassified")))
    gated = with_domain_gate(c)
    none = F.lit(None)
    accepted = gated.filter("in_domain").select(
        "doc_id", "in_domain", "category", none.cast("string").alias("target_queue"),
        none.cast("int").alias("sla_hours"))
    rejected = gated.filter(~F.col("in_domain")).select(
        "doc_id", "in_domain", F.lit(domain_policy.REJECTED["category"]).alias("category"),
        F.lit(domain_policy.REJECTED["target_queue"]).alias("target_queue"),
        F.lit(domain_policy.REJECTED["sla_hours"]).alias("sla_hours"))
    return accepted.unionByName(rejected)


# --- joins -----------------------------------------------------------------


@query(
    "j1_policy_lookup_join",
    sql.with_(sql.LABELLED, sql.values("queues", "category, queue", routing_policy.QUEUES.items()))
    + """SELECT doc_id, l.category, coalesce(q.queue, 'General Customer Service') AS queue
      FROM labelled l LEFT JOIN queues q ON l.category = q.category""",
)
def policy_lookup_join(spark, sf):
    queues = spark.createDataFrame(list(routing_policy.QUEUES.items()), "category string, queue string")
    return labelled(spark, sf).join(F.broadcast(queues), "category", "left").select(
        "doc_id", "category",
        F.coalesce("queue", F.lit(routing_policy.DEFAULT_QUEUE)).alias("queue"))


@query(
    "j2_known_label_semi_join",
    sql.with_(sql.COMPLAINTS) + f"SELECT doc_id, product FROM complaints WHERE {sql.KNOWN}",
)
def known_label_semi_join(spark, sf):
    known = spark.createDataFrame([(p,) for p in CATEGORY_BY_PRODUCT], "product string")
    return intake.complaints(spark, sf).join(F.broadcast(known), "product", "left_semi").select(
        "doc_id", "product")


@query(
    "j3_lexicon_term_counts",
    sql.with_(sql.CLEANED, f"p AS (SELECT doc_id, {sql.padded('cleaned')} AS pad FROM cleaned)",
              f"h AS (SELECT doc_id, unnest({sql.found(domain_policy.FINANCIAL_TERMS, 'pad')}) AS term FROM p)")
    + "SELECT term, count(*) AS narratives FROM h GROUP BY term",
)
def lexicon_term_counts(spark, sf):
    """How many narratives hold each lexicon term on word boundaries."""
    c = X.with_clean_text(intake.complaints(spark, sf)).select("doc_id", "cleaned")
    c = lexicon.with_padded_tokens(c, "cleaned", "padded", "tokens")
    c = lexicon.with_matches(c, domain_policy.FINANCIAL_TERMS, "padded", "tokens", "found")
    hits = unnest(c, [], lexicon.in_order(domain_policy.FINANCIAL_TERMS, "found"), "term")
    return hits.groupBy("term").agg(F.count("*").alias("narratives"))


# --- severity --------------------------------------------------------------

_SCORED = sql.with_(sql.CLEANED, sql.with_severity("cleaned"))


@query(
    "k1_signal_matches",
    _SCORED + "SELECT doc_id, " + ", ".join(
        f"array_to_string(g_{g}, '|') AS {g}" for g in
        ("financial_harm", "urgency", "legal_regulatory", "unresolved_persistent",
         "financial_magnitude")) + " FROM scored",
)
def signal_matches(spark, sf):
    s = with_severity(X.with_clean_text(intake.complaints(spark, sf)))
    groups = ("financial_harm", "urgency", "legal_regulatory", "unresolved_persistent",
              "financial_magnitude")
    return s.select("doc_id", *[
        pipe(F.col("signal_breakdown")[i]["matched_keywords"]).alias(g) for i, g in enumerate(groups)])


@query(
    "k2_k5_severity",
    _SCORED + """SELECT doc_id, risk_score, severity_level, severity_level = 'Critical' AS is_critical,
      array_to_string(matched_signals, '|') AS matched_signals,
      array_to_string(list_filter(keyword_list, lambda x, i: list_position(keyword_list, x) = i), '|') AS detected_keywords,
      severity_explanation FROM scored""",
)
def severity(spark, sf):
    s = with_severity(X.with_clean_text(intake.complaints(spark, sf)))
    return s.select(
        "doc_id", "risk_score", "severity_level", "is_critical",
        pipe("matched_signals").alias("matched_signals"),
        pipe("detected_keywords").alias("detected_keywords"), "severity_explanation")


_CUSTOM_SIGNALS = {"money": (0.6, ["bank", "fee", "late fee"]), "people": (0.3, ["lender", "collector"])}
_CUSTOM_TIERS = [("Hot", 0.5), ("Warm", 0.3), ("Low", 0.0)]


@query(
    "k6_custom_severity",
    sql.with_(sql.CLEANED, f"p AS (SELECT doc_id, {sql.padded('cleaned')} AS pad FROM cleaned)",
              f"""s AS (SELECT doc_id, CASE WHEN len({sql.found(_CUSTOM_SIGNALS['money'][1], 'pad')}) > 0 THEN 60 ELSE 0 END
              + CASE WHEN len({sql.found(_CUSTOM_SIGNALS['people'][1], 'pad')}) > 0 THEN 30 ELSE 0 END AS t FROM p)""")
    + """SELECT doc_id, t / 100.0::DOUBLE AS risk_score,
      CASE WHEN t >= 50 THEN 'Hot' WHEN t >= 30 THEN 'Warm' ELSE 'Low' END AS severity_level FROM s""",
)
def custom_severity(spark, sf):
    """Signals and tiers supplied by the caller."""
    from decimal import Decimal

    signals = {g: (Decimal(str(w)), ks) for g, (w, ks) in _CUSTOM_SIGNALS.items()}
    tiers = [(t, Decimal(str(b))) for t, b in _CUSTOM_TIERS]
    c = X.with_clean_text(intake.complaints(spark, sf))
    return with_severity(c, signals=signals, tiers=tiers, details=False).select(
        "doc_id", "risk_score", "severity_level")


@query(
    "k6_lexicon_table_severity",
    _SCORED + """SELECT doc_id, risk_score, severity_level, array_to_string(matched_signals, '|') AS matched_signals,
      array_to_string(list_filter(keyword_list, lambda x, i: list_position(keyword_list, x) = i), '|') AS detected_keywords
      FROM scored""",
)
def lexicon_table_severity(spark, sf):
    """The signals as a table that the texts meet by a join."""
    c = X.with_clean_text(intake.complaints(spark, sf))
    s = phrases.severity(c, phrases.signal_table(spark))
    return s.select("doc_id", "risk_score", "severity_level", pipe("matched_signals").alias("matched_signals"),
                    pipe("detected_keywords").alias("detected_keywords"))


#: Phrases of two and of three words make the lexicon of the next query.
_PHRASE_WORDS = (2, 3)


def _runs(n):
    """All runs of n words as texts."""
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return F.when(F.size("w") >= n, F.transform(starts, lambda at: F.array_join(F.slice("w", at, n), " "))).otherwise(
        F.array().cast("array<string>"))


@query(
    "j3_phrase_lexicon",
    sql.with_(sql.CLEANED, f"""bw AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
kw AS ({" UNION ".join(
        f"SELECT array_to_string(w[i:i + {n - 1}], ' ') AS keyword FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM bw)"
        for n in _PHRASE_WORDS)}),
tk AS (SELECT doc_id, string_split({sql.padded('cleaned')}, ' ') AS t FROM cleaned),
gr AS ({" UNION ".join(
        f"SELECT doc_id, array_to_string(t[i:i + {n - 1}], ' ') AS keyword FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM tk)"
        for n in _PHRASE_WORDS)})""")
    + "SELECT keyword, count(gr.doc_id) AS n_docs FROM kw LEFT JOIN gr USING (keyword) GROUP BY keyword",
)
def phrase_lexicon(spark, sf):
    """In how many complaints each phrase of the benchmark texts stands; the lexicon is a table that grows."""
    words = intake.table(spark, sf, "benchmark").select(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    lexicon_table = words.select(F.explode(F.concat(*[_runs(n) for n in _PHRASE_WORDS])).alias("keyword")).distinct()
    counts = phrases.matches(X.with_clean_text(intake.complaints(spark, sf)), lexicon_table).groupBy(
        "keyword").agg(F.count("*").alias("n"))
    return lexicon_table.join(counts, "keyword", "left").select(
        "keyword", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_docs"))


# --- sub-issues and routing ------------------------------------------------

_TAGGED = sql.with_(sql.LABELLED, sql.with_sub_issue("labelled"))


@query(
    "k7_sub_issues",
    _TAGGED + """SELECT doc_id, category, sub_issue, sub_issue_confidence, sub_issue_description,
      array_to_string(sub_issue_signals, '|') AS sub_issue_signals FROM tagged""",
)
def sub_issues(spark, sf):
    """Category-scoped keyword evidence, best sub-issue by count."""
    t = with_sub_issue(cleaned(spark, sf))
    return t.select("doc_id", "category", "sub_issue", "sub_issue_confidence",
                    "sub_issue_description", pipe("sub_issue_signals").alias("sub_issue_signals"))


@query(
    "k7_unknown_category_sub_issue",
    sql.with_(sql.CLEANED, "m AS (SELECT *, coalesce(product, 'none') AS category FROM cleaned)",
              sql.with_sub_issue("m"))
    + "SELECT sub_issue, sub_issue_confidence, count(*) AS n FROM tagged GROUP BY ALL",
)
def unknown_category_sub_issue(spark, sf):
    """Product codes are no categories, so every row takes the fallback."""
    c = X.with_clean_text(intake.complaints(spark, sf)).withColumn(
        "category", F.coalesce("product", F.lit("none")))
    return with_sub_issue(c).groupBy("sub_issue", "sub_issue_confidence").agg(F.count("*").alias("n"))


_ROUTED = sql.with_(
    sql.LABELLED, sql.with_sub_issue("labelled"), sql.with_severity("tagged"),
    "rated AS (SELECT *, sub_issue_confidence AS confidence, sub_issue_confidence < 0.55 AS is_uncertain FROM scored)",
    sql.with_routing("rated"),
)
_ROUTE_COLS = ("doc_id, priority, target_queue, handling_tier, sla_hours, escalation_required, "
               "escalation_reason, triage_rationale")


@query(
    "k8_k13_routing",
    _ROUTED + f"SELECT {_ROUTE_COLS}, array_to_string(suggested_actions, '|') AS suggested_actions FROM routed",
)
def routing(spark, sf):
    """Rows whose sub-issue has no evidence count as uncertain."""
    s = scored(spark, sf).withColumn("confidence", F.col("sub_issue_confidence")).withColumn(
        "is_uncertain", F.col("sub_issue_confidence") < 0.55)
    r = with_routing(s)
    return r.select("doc_id", "priority", "target_queue", "handling_tier", "sla_hours",
                    "escalation_required", "escalation_reason", "triage_rationale",
                    pipe("suggested_actions").alias("suggested_actions"))


@query(
    "k10_low_confidence_routing",
    sql.with_(sql.LABELLED, sql.with_severity("labelled"),
              "rated AS (SELECT *, 0.25 AS confidence, FALSE AS is_uncertain FROM scored)",
              sql.with_routing("rated"))
    + "SELECT doc_id, target_queue, array_to_string(suggested_actions, '|') AS suggested_actions FROM routed",
)
def low_confidence_routing(spark, sf):
    s = with_severity(cleaned(spark, sf)).withColumn("confidence", F.lit(0.25)).withColumn(
        "is_uncertain", F.lit(False))
    return with_routing(s).select("doc_id", "target_queue",
                                  pipe("suggested_actions").alias("suggested_actions"))


_CLEANED2 = f"labelled2 AS (SELECT * EXCLUDE (cleaned), cleaned AS once, {sql.clean('cleaned')} AS cleaned FROM labelled)"
_BOARD = sql.with_(
    sql.LABELLED, _CLEANED2, sql.with_domain("labelled2"),
    sql.with_sub_issue("gated", "once"), sql.with_severity("tagged"),
    "rated AS (SELECT *, sub_issue_confidence AS confidence, FALSE AS is_uncertain FROM scored)",
    sql.with_routing("rated"),
)


@query(
    "r1_rule_triage",
    _BOARD + f"""SELECT doc_id, in_domain,
      CASE WHEN in_domain THEN category ELSE 'Out of Domain' END AS category,
      CASE WHEN in_domain THEN severity_level ELSE 'Low' END AS severity_level,
      CASE WHEN in_domain THEN risk_score ELSE 0 END AS risk_score,
      CASE WHEN in_domain THEN target_queue ELSE {sql.q(domain_policy.REJECTED['target_queue'])} END AS target_queue,
      CASE WHEN in_domain THEN sla_hours ELSE 72 END AS sla_hours,
      CASE WHEN in_domain THEN priority ELSE 'P4 - Routine' END AS priority FROM routed""",
)
def rule_triage(spark, sf):
    """The stateless part of triage over all labelled narratives."""
    out = triage.reject_out_of_domain(triage.with_rules(labelled(spark, sf)))
    return out.select("doc_id", "in_domain", "category", "severity_level", "risk_score",
                      "target_queue", "sla_hours", "priority")


@query(
    "flagship_triage_board",
    _BOARD + """SELECT category, severity_level, count(*) AS complaints, round(avg(risk_score), 6) AS avg_risk,
      sum(CASE WHEN escalation_required THEN 1 ELSE 0 END)::BIGINT AS escalated,
      min(sla_hours) AS tightest_sla FROM routed WHERE in_domain GROUP BY category, severity_level""",
)
def triage_board(spark, sf):
    """Severity per category with escalations and deadlines of the accepted complaints."""
    out = triage.with_rules(labelled(spark, sf)).filter("in_domain")
    return out.groupBy("category", "severity_level").agg(
        F.count("*").alias("complaints"), F.round(F.avg("risk_score"), 6).alias("avg_risk"),
        F.sum(F.col("escalation_required").cast("int")).alias("escalated"),
        F.min("sla_hours").alias("tightest_sla"))


@query(
    "s7_result_documents",
    _SCORED + """SELECT doc_id, '{"score":' || CASE WHEN total = 0 THEN '0.0' ELSE printf('%g', risk_score) || CASE WHEN risk_score = 1 THEN '.0' ELSE '' END END
      || ',"tier":"' || severity_level || '","matched_signals":['
      || array_to_string(list_transform(matched_signals, lambda x: '"' || x || '"'), ',') || ']}' AS doc FROM scored""",
)
def result_documents(spark, sf):
    """Scored narratives as nested JSON payloads."""
    s = with_severity(X.with_clean_text(intake.complaints(spark, sf)), details=False)
    return s.select("doc_id", F.to_json(F.struct(
        F.bround("risk_score", 4).alias("score"), F.col("severity_level").alias("tier"),
        "matched_signals")).alias("doc"))


# --- portfolio -------------------------------------------------------------

_PORTFOLIO = sql.with_(sql.LABELLED, sql.with_sub_issue("labelled"), sql.with_severity("tagged"))
_SEVERITY = sql.with_(sql.LABELLED, sql.with_severity("labelled"))


def severity_only(spark, sf):
    return with_severity(cleaned(spark, sf), details=False)


@query("a1_total_complaints", sql.with_(sql.LABELLED) + "SELECT count(*) AS total_complaints FROM labelled")
def total_complaints(spark, sf):
    return labelled(spark, sf).agg(F.count("*").alias("total_complaints"))


@query(
    "a2_a3_category_shares",
    sql.with_(sql.LABELLED) + """SELECT category, count(*) AS complaints,
      round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct FROM labelled GROUP BY category""",
)
def category_shares(spark, sf):
    return portfolio.category_shares(labelled(spark, sf))


@query(
    "a4_severity_distribution",
    _SEVERITY + """SELECT severity_level, count(*) AS complaints,
      round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct FROM scored GROUP BY severity_level""",
)
def severity_distribution(spark, sf):
    return portfolio.category_shares(severity_only(spark, sf), "severity_level")


@query(
    "a5_top_sub_issues",
    _TAGGED + """SELECT category, sub_issue, complaints, rank::INTEGER AS rank FROM (
      SELECT category, sub_issue, count(*) AS complaints, row_number() OVER (
        PARTITION BY category ORDER BY count(*) DESC, sub_issue) AS rank
      FROM tagged GROUP BY category, sub_issue) WHERE rank <= 5""",
)
def top_sub_issues(spark, sf):
    return portfolio.top_sub_issues(with_sub_issue(cleaned(spark, sf)))


@query(
    "a6_severity_by_category",
    _SEVERITY + "SELECT category, " + ", ".join(
        f"count(*) FILTER (severity_level = '{t}') AS \"{t}\"" for t in portfolio.TIER_ORDER)
    + " FROM scored GROUP BY category",
)
def severity_by_category(spark, sf):
    return portfolio.severity_cross_tab(severity_only(spark, sf))


@query(
    "a7_narrative_lengths",
    sql.with_(sql.LABELLED, f"n AS (SELECT CASE WHEN {sql.blank('narrative')} THEN 0 ELSE len(string_split({sql.squeeze('narrative')}, ' ')) END AS n FROM labelled)")
    + """SELECT round(avg(n), 1) AS mean_words, trunc(quantile_cont(n, 0.5))::INTEGER AS median_words,
      trunc(quantile_cont(n, 0.9))::INTEGER AS p90_words, max(n)::INTEGER AS max_words FROM n""",
)
def narrative_lengths(spark, sf):
    return portfolio.word_length_stats(labelled(spark, sf))


@query(
    "a8_risk_scores",
    _SEVERITY + """SELECT round(avg(risk_score), 3) AS mean_risk_score,
      round(quantile_cont(risk_score, 0.5), 3) AS median_risk_score FROM scored""",
)
def risk_scores(spark, sf):
    return portfolio.risk_stats(severity_only(spark, sf))


@query(
    "a9_dominant_category",
    sql.with_(sql.LABELLED) + """SELECT * FROM (SELECT category, count(*) AS complaints,
      round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct FROM labelled GROUP BY category)
      ORDER BY complaints DESC, category LIMIT 1""",
)
def dominant_category(spark, sf):
    return portfolio.dominant_category(labelled(spark, sf))


@query(
    "a10_elevated_risk_share",
    _SEVERITY + """SELECT round(avg(CASE WHEN severity_level IN ('High', 'Critical') THEN 100.0::DOUBLE ELSE 0 END), 2)
      AS elevated_risk_pct FROM scored""",
)
def elevated_risk_share(spark, sf):
    return portfolio.elevated_risk_share(severity_only(spark, sf))


@query(
    "a11_tier_bar",
    sql.with_(sql.LABELLED, sql.with_severity("labelled"),
              sql.values("tiers", "tier_ord, severity_level", enumerate(portfolio.TIER_ORDER)),
              "c AS (SELECT severity_level, count(*) AS k FROM scored GROUP BY severity_level)")
    + """SELECT t.tier_ord, t.severity_level, coalesce(k, 0) AS complaints,
      round(coalesce(k, 0)::DOUBLE / sum(coalesce(k, 0)) OVER () * 100, 1) AS pct
      FROM tiers t LEFT JOIN c ON t.severity_level = c.severity_level""",
)
def tier_bar(spark, sf):
    return portfolio.tier_bar(severity_only(spark, sf))


@query(
    "a13_label_list",
    sql.with_(sql.LABELLED) + """SELECT array_to_string(list_sort(list(DISTINCT category)), '|') AS labels,
      count(DISTINCT category) AS n_labels FROM labelled""",
)
def label_list(spark, sf):
    return labelled(spark, sf).agg(
        pipe(F.array_sort(F.collect_set("category"))).alias("labels"),
        F.count_distinct("category").alias("n_labels"))


@query(
    "a21_monthly_volume",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, o_orderpriority AS category,
       count(*) AS complaints FROM orders GROUP BY ALL""",
)
def monthly_volume(spark, sf):
    """Orders spread over years and so stand in for dated complaints."""
    rows = intake.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("category"))
    return portfolio.monthly_volume(rows)


@query(
    "a21_monthly_complaints",
    sql.with_(sql.TIMED, f"l AS (SELECT *, {sql.CATEGORY} AS category FROM timed WHERE {sql.KNOWN})")
    + """SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, category, count(*) AS complaints
      FROM l GROUP BY ALL""",
)
def monthly_complaints(spark, sf):
    return portfolio.monthly_volume(corpus_source.labelled(intake.timed_complaints(spark, sf)))


@query(
    "u1_u3_label_union",
    sql.with_(sql.LABELLED, sql.with_sub_issue("labelled"))
    + "SELECT category AS label FROM tagged UNION SELECT sub_issue AS label FROM tagged",
)
def label_union(spark, sf):
    t = with_sub_issue(cleaned(spark, sf)).select("category", "sub_issue").distinct()
    return t.select(F.col("category").alias("label")).union(t.select("sub_issue")).distinct()


@query(
    "o4_first_complaints",
    sql.with_(sql.LABELLED) + "SELECT doc_id, category FROM labelled ORDER BY category, doc_id LIMIT 25",
)
def first_complaints(spark, sf):
    """Top-k report: the first 25 in label order."""
    return labelled(spark, sf).orderBy("category", "doc_id").limit(25).select("doc_id", "category")


_WORDS = f"CASE WHEN {sql.blank('narrative')} THEN 0 ELSE len(string_split({sql.squeeze('narrative')}, ' ')) END::INTEGER"
_COUNTED = f"counted AS (SELECT category, sub_issue, severity_level, risk_score, {_WORDS} AS n_words FROM scored)"


@query(
    "a1_a11_section_counts",
    _PORTFOLIO.rstrip() + f",\n{_COUNTED}\n" + """SELECT CASE
        WHEN grouping(sub_issue) = 0 THEN 'sub_issue' WHEN grouping(category) + grouping(severity_level) = 0 THEN 'category_severity'
        WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity_level) = 0 THEN 'severity'
        WHEN grouping(risk_score) = 0 THEN 'risk' WHEN grouping(n_words) = 0 THEN 'words' ELSE 'total' END AS section,
        category, sub_issue, severity_level, risk_score, n_words, count(*) AS complaints FROM counted
      GROUP BY GROUPING SETS ((), (category), (severity_level), (category, sub_issue), (category, severity_level),
        (risk_score), (n_words))""",
)
def section_counts(spark, sf):
    """All counts of the portfolio summary, from one pass over the texts."""
    return portfolio.section_counts(scored(spark, sf))


def _object(rows, key="k", value="v"):
    """A JSON object of rows, keys in order."""
    return f"""(SELECT '{{' || coalesce(string_agg('"' || {key} || '":' || {value}, ',' ORDER BY {key}), '') || '}}' FROM {rows})"""


_SUMMARY_SQL = _PORTFOLIO.rstrip() + f""",
{_COUNTED},
cats AS (SELECT category AS k, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct FROM counted GROUP BY 1),
tiers AS (SELECT severity_level AS k, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct FROM counted GROUP BY 1),
subs AS (SELECT category, sub_issue AS name, count(*) AS n,
  row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, sub_issue) AS rank FROM counted GROUP BY category, sub_issue),
sub_objects AS (SELECT category AS k, '{{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}}' AS v
  FROM subs WHERE rank <= 5 GROUP BY 1),
cross_tab AS (SELECT category, severity_level AS name, count(*) AS n FROM counted GROUP BY ALL),
tab_objects AS (SELECT category AS k, '{{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}}' AS v FROM cross_tab GROUP BY 1)
SELECT '{{"total_complaints":' || (SELECT count(*) FROM counted)
  || ',"category_counts":' || {_object("cats", value="n")}
  || ',"category_percentages":' || {_object("cats", value="pct")}
  || ',"severity_counts":' || {_object("tiers", value="n")}
  || ',"severity_percentages":' || {_object("tiers", value="pct")}
  || (SELECT ',"mean_risk_score":' || round(avg(risk_score), 3) || ',"median_risk_score":'
        || round(quantile_cont(risk_score, 0.5), 3) FROM counted)
  || ',"sub_issues_by_category":' || {_object("sub_objects")}
  || ',"severity_by_category":' || {_object("tab_objects")}
  || (SELECT ',"narrative_length_stats":{{"mean_words":' || round(avg(n_words), 1) || ',"median_words":'
        || trunc(quantile_cont(n_words, 0.5))::INTEGER || ',"p90_words":' || trunc(quantile_cont(n_words, 0.9))::INTEGER
        || ',"max_words":' || max(n_words) || '}}' FROM counted) || '}}' AS summary"""


@query("s4_portfolio_summary", _SUMMARY_SQL)
def portfolio_summary(spark, sf):
    """The whole summary as one JSON document, from one pass over the texts."""
    return portfolio.summary_document(scored(spark, sf)).select(F.to_json(F.struct("*")).alias("summary"))


@query(
    "f1_f2_formatted_shares",
    """WITH c AS (SELECT o_orderpriority AS p, count(*) AS k, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT array_to_string(list_transform(regexp_extract_all(p, '[A-Za-z]+|[^A-Za-z]+'),
             lambda x: upper(x[1:1]) || lower(x[2:])), '') AS title,
           p[1:5] AS snippet, contains(lower(p), 'urgent') AS is_urgent,
           printf('%.1f%%', k::DOUBLE / sum(k) OVER () * 100.0) AS share_text FROM c""",
)
def formatted_shares(spark, sf):
    """Title case, snippet, substring test and percentage text per group."""
    c = intake.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    total = F.sum("k").over(Window.partitionBy(F.lit(1)))
    return c.select(
        X.python_title("o_orderpriority").alias("title"),
        F.substring("o_orderpriority", 1, 5).alias("snippet"),
        F.contains(F.lower("o_orderpriority"), F.lit("urgent")).alias("is_urgent"),
        X.percent(F.col("k") / total).alias("share_text"))
