"""Building blocks of the reference SQL that each query is checked against (DuckDB dialect)."""

from __future__ import annotations

from tidemark.policy import domain, labels, routing, severity, sub_issues, text_patterns as P
from tidemark.sources.intake import PHRASES, SHORT


def q(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


COMPLAINTS = (
    values(
        "phrases",
        "source, product, phrase",
        [(s, p, t) for s, (p, t) in PHRASES.items()],
    )
    + ",\n" + values("short", "doc_id, narrative, product", SHORT)
    + """,
complaints AS (
  SELECT d.doc_id, concat_ws(' ', f.phrase, d.text) AS narrative, f.product
  FROM documents d LEFT JOIN phrases f ON d.source = f.source
  UNION ALL SELECT * FROM short)"""
)

TIMED = (
    COMPLAINTS
    + """,
timed AS (
  SELECT c.*, e.ts FROM complaints c
  LEFT JOIN (SELECT event_id // 10 AS k, max(ts) AS ts FROM events GROUP BY 1) e ON c.doc_id = e.k)"""
)


def sub(expr: str, pattern: str, by: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, '{flags}')"


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, P.WHITESPACE)})"


def blank(expr: str) -> str:
    return f"({squeeze(expr)} = '')"


def one_punctuation(expr: str) -> str:
    for mark in "!?.,":
        expr = sub(expr, f"[{mark}]{{2,}}", f"{mark} ")
    return expr


def clean(expr: str, pii: bool = True, lower: bool = True, urls: bool = True, markers: bool = True) -> str:
    out = sub(f"coalesce({expr}, '')", P.HTML_TAG)
    if urls:
        out = sub(out, P.URL)
    if pii:
        for pattern in (P.EMAIL, P.SSN, P.PAYMENT_CARD, P.PHONE):
            out = sub(out, pattern)
    if markers:
        out = sub(out, P.REDACTION_MARKER, flags="gi")
    out = one_punctuation(out)
    return squeeze(f"lower({out})" if lower else out)


CLEANED = (
    COMPLAINTS
    + f""",
cleaned AS (SELECT *, {clean('narrative')} AS cleaned FROM complaints)"""
)

CATEGORY = "CASE product " + " ".join(
    f"WHEN {q(p)} THEN {q(c)}" for p, c in labels.CATEGORY_BY_PRODUCT.items()
) + " END"
KNOWN = "product IN (" + ", ".join(q(p) for p in labels.CATEGORY_BY_PRODUCT) + ")"

# Portfolio rows: labelled, blank narratives stay.
LABELLED = (
    CLEANED
    + f""",
labelled AS (
  SELECT *, {CATEGORY} AS category FROM cleaned
  WHERE narrative IS NOT NULL AND {KNOWN})"""
)
# Training rows: labelled and not blank.
CORPUS = (
    COMPLAINTS
    + f""",
corpus AS (
  SELECT doc_id, narrative AS text, {CATEGORY} AS category FROM complaints
  WHERE narrative IS NOT NULL AND {KNOWN} AND NOT {blank('narrative')})"""
)


def padded(expr: str) -> str:
    return f"' ' || {sub(expr, P.NON_WORD_CHAR, ' ' + chr(92) + '1 ')} || ' '"


def found(keywords, pad: str) -> str:
    return f"list_filter({array(keywords)}, lambda k: contains({pad}, ' ' || k || ' '))"


def joined(expr: str, sep: str = "|") -> str:
    return f"array_to_string({expr}, {q(sep)})"


def with_severity(source: str, text: str = "cleaned", name: str = "scored") -> str:
    """CTEs that add the severity columns to ``source``."""
    groups = severity.SIGNALS
    lists = ", ".join(f"{found(ks, 'pad')} AS g_{g}" for g, (_, ks) in groups.items())
    total = " + ".join(
        f"CASE WHEN len(g_{g}) > 0 THEN {w}::DECIMAL(4,2) ELSE 0::DECIMAL(4,2) END"
        for g, (w, _) in groups.items()
    )
    tier = "CASE " + " ".join(
        f"WHEN total >= {b} THEN {q(t)}" for t, b in severity.TIERS
    ) + " ELSE 'Low' END"
    matched = "list_filter([" + ", ".join(
        f"CASE WHEN len(g_{g}) > 0 THEN {q(g)} END" for g in groups
    ) + "], lambda x: x IS NOT NULL)"
    keywords = "list_concat(" * (len(groups) - 1) + f"g_{next(iter(groups))}" + "".join(
        f", g_{g})" for g in list(groups)[1:]
    )
    details = ", ".join(
        f"CASE WHEN len(g_{g}) > 0 THEN "
        + q(f"{g.replace('_', ' ').title()} (weight {w * 100:.0f}%, matched: ")
        + f" || {joined(f'g_{g}', ', ')} || ')' END"
        for g, (w, _) in groups.items()
    )
    return f"""{name}_pad AS (SELECT *, {padded(text)} AS pad FROM {source}),
{name}_groups AS (SELECT *, {lists} FROM {name}_pad),
{name}_total AS (SELECT *, ({total}) AS total FROM {name}_groups),
{name} AS (
  SELECT *, total::DOUBLE AS risk_score, {tier} AS severity_level,
         {matched} AS matched_signals, {keywords} AS keyword_list,
         CASE WHEN total = 0 THEN {q(severity.NO_SIGNAL)}
              ELSE 'Assigned ''' || ({tier}) || ''' (score ' || printf('%.2f', total::DOUBLE)
                   || ') due to: ' || concat_ws('; ', {details}) || '.' END AS severity_explanation
  FROM {name}_total)"""


def ordered_distinct(expr: str) -> str:
    """First occurrences, in order."""
    return (
        f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"
    )


def with_sub_issue(source: str, text: str = "cleaned", name: str = "tagged") -> str:
    """CTEs that add the sub-issue columns to ``source`` (needs doc_id and category)."""
    rows, general = [], []
    for c, subs in sub_issues.TAXONOMY.items():
        for i, (s, ks, d) in enumerate(subs):
            if s.startswith("General"):
                general.append((c, d))
            else:
                rows.append((c, i, s, d, "|".join(ks)))
    return f"""{values(name + '_lex', 'category, ord, sub_issue, description, keywords', rows)},
{values(name + '_gen', 'category, description', general)},
{name}_hits AS (
  SELECT s.doc_id, l.ord, l.sub_issue, l.description,
         list_filter(string_split(l.keywords, '|'), lambda k: contains(lower(s.{text}), k)) AS found
  FROM {source} s JOIN {name}_lex l ON s.category = l.category),
{name}_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(found) DESC, ord) AS rn
                 FROM {name}_hits WHERE len(found) > 0) WHERE rn = 1),
{name} AS (
  SELECT s.*,
    CASE WHEN g.category IS NULL THEN {q(sub_issues.UNKNOWN_CATEGORY[0])}
         ELSE coalesce(b.sub_issue, {q(sub_issues.GENERAL)}) END AS sub_issue,
    round(CASE WHEN b.doc_id IS NULL THEN 0.5
         ELSE least(0.95::DOUBLE, 0.60::DOUBLE + len(b.found) * 0.10::DOUBLE) END, 3) AS sub_issue_confidence,
    CASE WHEN g.category IS NULL THEN {q(sub_issues.UNKNOWN_CATEGORY[1])}
         ELSE coalesce(b.description, g.description) END AS sub_issue_description,
    coalesce(b.found, []::VARCHAR[]) AS sub_issue_signals
  FROM {source} s LEFT JOIN {name}_gen g ON s.category = g.category
  LEFT JOIN {name}_best b ON s.doc_id = b.doc_id)"""


def with_domain(source: str, raw: str = "narrative", name: str = "gated") -> str:
    """CTEs that add the domain gate columns to ``source``."""
    terms = (
        f"list_filter({array(domain.FINANCIAL_TERMS)}, lambda k: CASE WHEN contains(k, ' ') "
        f"THEN contains(low, k) ELSE contains(pad, ' ' || k || ' ') END)"
    )
    # RE2 has ASCII \b only: the terms are found on text whose accented letters became 'q'.
    ascii_low = sub(sub("low", r"[^\x00-\x7F]", "q"), r"[\s]", " ")
    searches = [
        f"regexp_extract_all({name}_ascii, {q(chr(92) + 'b(' + '|'.join(ts) + ')' + chr(92) + 'b')}, 1)"
        for ts in domain.UNRELATED_TERMS
    ]
    unrelated = "list_concat(" * (len(searches) - 1) + searches[0] + "".join(
        f", {s})" for s in searches[1:]
    )
    tokens = f"list_filter(regexp_extract_all(low, {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"
    return f"""{name}_low AS (
  SELECT *, lower(coalesce({raw}, '')) AS low, {blank("coalesce(" + raw + ", '')")} AS is_blank FROM {source}),
{name}_tok AS (
  SELECT *, {ascii_low} AS {name}_ascii, {padded('low')} AS pad,
         (NOT is_blank AND len({tokens}) >= {domain.MIN_WORDS}) AS is_open FROM {name}_low),
{name}_raw AS (
  SELECT *, CASE WHEN is_open THEN {terms} ELSE [] END AS all_terms,
         CASE WHEN is_open THEN {unrelated} ELSE [] END AS all_unrelated FROM {name}_tok),
{name}_cnt AS (
  SELECT *, {ordered_distinct('all_unrelated')} AS all_u, len(all_terms) AS t FROM {name}_raw),
{name}_score AS (
  SELECT *, CASE WHEN t = 0 THEN 0.0::DOUBLE
                 WHEN t = 1 THEN CASE WHEN len(all_u) > 0 THEN 0.10::DOUBLE ELSE 0.35::DOUBLE END
                 WHEN t = 2 THEN CASE WHEN len(all_u) > 0 THEN 0.40::DOUBLE ELSE 0.65::DOUBLE END
                 ELSE least(1.0::DOUBLE, 0.70::DOUBLE + (t - 3) * 0.08::DOUBLE) END AS raw_score
  FROM {name}_cnt),
{name}_ok AS (
  SELECT *, (is_open AND raw_score >= {domain.MIN_SCORE} AND t >= 1) AS in_domain FROM {name}_score),
{name} AS (
  SELECT * EXCLUDE (pad), round(raw_score, 3) AS domain_score,
    all_terms[1:{domain.MAX_TERMS}] AS financial_terms,
    all_u[1:{domain.MAX_UNRELATED}] AS unrelated_terms,
    CASE WHEN is_blank THEN {q(domain.BLANK_REASON)}
         WHEN NOT is_open THEN {q(domain.BRIEF_REASON)}
         WHEN in_domain THEN NULL
         WHEN len(all_u) > 0 THEN printf({q(domain.UNRELATED_REASON)}, {joined(f'all_u[1:{domain.REASON_TERMS}]', ', ')})
         ELSE {q(domain.NO_TERM_REASON)} END AS rejection_reason,
    CASE WHEN is_blank THEN {q(domain.BLANK_GUIDANCE)}
         WHEN NOT is_open THEN {q(domain.BRIEF_GUIDANCE)}
         WHEN NOT in_domain THEN {q(domain.DOMAIN_GUIDANCE)} END AS guidance
  FROM {name}_ok)"""


def with_routing(source: str, name: str = "routed") -> str:
    """CTEs that add the routing columns (needs category, severity columns, confidence, is_uncertain)."""
    def case(key, mapping, default):
        return f"CASE {key} " + " ".join(
            f"WHEN {q(k)} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"

    pol = routing.TIER_POLICY
    esc = routing.ESCALATIONS
    which = "CASE " + " ".join(
        f"WHEN list_contains(matched_signals, {q(e['signal'])})"
        + (f" AND severity_level IN ({', '.join(map(q, e['only_tiers']))})" if e["only_tiers"] else "")
        + f" THEN {i}" for i, e in enumerate(esc)) + " END"

    def by(field, otherwise):
        return "CASE esc " + " ".join(
            f"WHEN {i} THEN {q(e[field])}" for i, e in enumerate(esc) if e[field] is not None
        ) + f" ELSE {otherwise} END"

    hours = case("severity_level", {t: p[1] for t, p in pol.items()}, routing.DEFAULT_TIER_POLICY[1])
    desk = case("severity_level", {t: q(p[2]) for t, p in pol.items()}, q(routing.DEFAULT_TIER_POLICY[2]))
    queue = case("category", {c: q(v) for c, v in routing.QUEUES.items()}, q(routing.DEFAULT_QUEUE))
    actions = "CASE esc " + " ".join(
        f"WHEN {i} THEN {array(e['actions'])}" for i, e in enumerate(esc)) + " ELSE []::VARCHAR[] END"
    playbook = case("category", {c: array(v) for c, v in routing.PLAYBOOKS.items()},
                    array(routing.DEFAULT_PLAYBOOK))
    advice = f"printf({q(routing.LOW_CONFIDENCE_ADVICE)}, printf('%.1f%%', confidence * 100))"
    prio = case("severity_level", {t: q(v) for t, v in routing.PRIORITIES.items()},
                q(routing.DEFAULT_PRIORITY))
    return f"""{name}_esc AS (SELECT *, {which} AS esc,
  (is_uncertain OR confidence < {routing.LOW_CONFIDENCE}) AS doubtful FROM {source}),
{name}_base AS (SELECT *,
  esc IS NOT NULL AS escalation_required,
  {by('reason', 'NULL')} AS escalation_reason,
  {by('handling_tier', desk)} AS handling_tier,
  least({hours}, {by('max_hours', hours)})::INTEGER AS sla_hours,
  CASE WHEN doubtful AND esc IS NULL AND severity_level = 'Low' THEN {q(routing.MANUAL_REVIEW_QUEUE)}
       ELSE {by('queue', queue)} END AS target_queue,
  list_concat({actions}, CASE WHEN doubtful THEN [{advice}] ELSE []::VARCHAR[] END) AS first_actions
  FROM {name}_esc),
{name} AS (SELECT *,
  CASE WHEN len(first_actions) > 0 THEN first_actions ELSE {playbook} END AS suggested_actions,
  CASE WHEN esc IS NOT NULL AND ({prio}) IN ({q(routing.PRIORITIES['Medium'])}, {q(routing.PRIORITIES['Low'])})
       THEN {q(routing.RAISED_PRIORITY)} ELSE {prio} END AS priority,
  concat_ws('. ', 'Classified as ''' || category || ''' with ' || printf('%.1f%%', confidence * 100) || ' confidence',
    'Evaluated severity: ''' || severity_level || ''' (score: ' || printf('%.2f', risk_score) || ')',
    'Escalation trigger: ' || escalation_reason,
    'Routed to ''' || target_queue || ''' with a ' || sla_hours || 'h SLA') || '.' AS triage_rationale
  FROM {name}_base)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
