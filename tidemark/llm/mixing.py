"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are added up by cell (source, language, topic). Raking scales the cells in turn to each marginal's
target; a document is then kept with a probability in proportion to its cell's weight per token, 1 at most.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.operators.sizing import broadcast_if_small
from tidemark.session import stored

#: Sweeps of raking, whatever the table, and after how many of them the cells are written (a longer chain of
#: windows makes too deep a plan).
SWEEPS = 16
WRITTEN_SWEEPS = 8

#: A margin further from its aim (as a part of the aim) is named in a warning.
TOLERANCE = 1e-3

#: The part of the tokens that is expected to be kept where nothing else is stated: low enough that few cells would need
#: a probability over 1, so that the mix meets its aims.
TOKEN_SHARE = 0.1

#: Default targets: each marginal's share of tokens to this power, so that rare sources gain.
TEMPER = 0.7
SEED = 11
MARGINS = ("source", "lang", "topic")

#: Token counts that separate the length classes, which stand for topics where there is no such column.
SHORT, LONG = 100, 1000

#: Cells up to this number are raked in one task and go to every executor; more are shuffled.
MAX_CELLS = 50_000


def n_tokens() -> Column:
    """Words of the text, one at least, so that an empty text weighs something."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def length_class(tokens: Column) -> Column:
    return F.when(tokens < SHORT, "short").when(tokens < LONG, "medium").otherwise("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """rest, text and the marginals; a null is the empty name."""
    names = {c.lower() for c in docs.columns}
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in names else None for c in MARGINS}
    topic = known["topic"] if known["topic"] is not None else length_class(F.col("tokens"))
    lacking = F.lit("")
    return docs.select(
        common.others(docs, "doc_id", "text"), "doc_id", "text", n_tokens().alias("tokens"),
        *((known[c] if known[c] is not None else lacking).alias(c) for c in ("source", "lang")),
        *([known["topic"].alias("topic")] if known["topic"] is not None else []),
    ).withColumns({} if known["topic"] is not None else {"topic": topic})


def _aims(cells: DataFrame, targets: dict[str, DataFrame] | None, temper: float) -> dict[str, DataFrame]:
    """Each marginal's aims: its column and aim_<column>, which add up to 1."""
    aims = {}
    for c in MARGINS:
        if targets and c in targets:
            wanted = targets[c].groupBy(F.col("name").alias(c)).agg(F.sum("weight").cast("double").alias("aim"))
        else:
            wanted = cells.groupBy(c).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("aim"))
        total = wanted.agg(F.sum("aim").alias("t")).first()["t"] or 1.0
        aims[c] = wanted.select(c, (F.col("aim") / F.lit(total)).alias(f"aim_{c}"))
    return aims


def residuals(cells: DataFrame, aims: dict[str, DataFrame], amount: str = "weight") -> DataFrame:
    """margin, name, aim, share (of ``amount``) and off, the difference as a part of the aim, for each name with an aim."""
    total = F.lit(cells.agg(F.sum(amount)).first()[0] or 1.0)
    return reduce(DataFrame.unionByName, [
        aims[c].where(F.col(f"aim_{c}") > 0)
        .join(cells.groupBy(c).agg((F.sum(amount) / total).alias("share")), c, "left")
        .select(F.lit(c).alias("margin"), F.col(c).alias("name"), F.col(f"aim_{c}").alias("aim"), F.coalesce("share", F.lit(0.0)).alias("share"))
        for c in MARGINS
    ]).withColumn("off", F.abs(F.col("share") / F.col("aim") - 1))


def _worst(rows: DataFrame):
    return rows.agg(F.max(F.struct("off", "margin", "name", "aim", "share")).alias("w")).first()["w"]


def _warn_if_off(rows: DataFrame, tolerance: float, what: str) -> None:
    worst = _worst(rows)
    if worst and worst["off"] > tolerance:
        warnings.warn(
            f"{what}: {worst['margin']} {worst['name']!r} has the share {worst['share']:.6g}, its aim is {worst['aim']:.6g}"
            f" ({worst['off']:.1%} off; the tolerance is {tolerance:g})", stacklevel=3,
        )


def cell_weights(
    cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight: the raked share of each cell.

    ``targets`` may give a table (name, weight) for a marginal; names it does not list get nothing. Other
    marginals aim at their share of tokens to the power of ``temper``. A warning names the margin furthest from its
    aim where the sweeps leave one further than TOLERANCE, as they must where no weights meet all aims together.
    """
    return _raked(cells, _aims(cells, targets, temper), sweeps)


def _raked(cells: DataFrame, aims: dict[str, DataFrame], sweeps: int) -> DataFrame:
    raked = cells.withColumn("weight", F.col("tokens").cast("double"))
    for c in MARGINS:
        raked = raked.join(aims[c], c, "left")
    raked = raked.fillna(0.0, [f"aim_{c}" for c in MARGINS])
    few = cells.count() <= MAX_CELLS
    for sweep in range(sweeps):
        if sweep % WRITTEN_SWEEPS == 0:
            raked = stored(raked, "cells")
            raked = raked.coalesce(1) if few else raked  # so many rows need no shuffle between margins
        for c in MARGINS:
            now = F.sum("weight").over(Window.partitionBy(c))
            raked = raked.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"aim_{c}") / now).otherwise(0.0))
    raked = stored(raked, "raked-cells")
    _warn_if_off(residuals(raked, aims), TOLERANCE, f"after {sweeps} sweeps of raking")
    return raked.select(*MARGINS, "tokens", "weight")


def sampling_rate(raked: DataFrame, token_budget: float | None = None, token_share: float | None = None) -> float:
    """What a cell's weight per token is multiplied by, to be its probability where that is under 1.

    The expected tokens are ``token_budget``, or ``token_share`` (TOKEN_SHARE unless stated) of those in cells with a
    weight, or the fewer where both are given: cells whose probability would exceed 1 are kept whole and the others share
    the rest by their weights. So one rare cell, whatever its weight per token, changes little.
    """
    per_token = F.col("weight") / F.col("tokens")
    total, tokens = raked.where("weight > 0").agg(F.sum("weight"), F.sum("tokens")).first()
    if not total:
        return 0.0
    if token_budget is None and token_share is None:
        token_share = TOKEN_SHARE
    wanted = min(x for x in (token_budget, None if token_share is None else token_share * tokens) if x is not None)
    rate = wanted / total
    while True:  # rises to the rate at which nothing more is capped
        whole = per_token * F.lit(rate) >= 1
        capped, rest = raked.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))).first()
        if not capped or not rest or (wanted - capped) / rest <= rate * (1 + 1e-12):
            return rate
        rate = (wanted - capped) / rest


def draw(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 (exclusive) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER,
    sweeps: int = SWEEPS, seed: int = SEED, token_budget: float | None = None, token_share: float | None = None,
) -> DataFrame:
    """``docs`` with topic, tokens, probability and kept added.

    No document is used twice. ``token_budget`` or ``token_share`` states the expected tokens, else ``sampling_rate``
    says how many they are. They follow the raked weights exactly where no cell is capped at 1; a warning names
    the largest difference where the mix misses its aims by more than TOLERANCE. A document without doc_id draws by its text,
    and repeated rows share a draw. A null source, language or topic counts as the empty name; without a
    column topic, length classes stand for it. An empty table gives an empty table; columns of
    the added names are replaced.
    """
    keyed = _keyed(docs)
    cells = stored(keyed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cell-tokens")
    aims = _aims(cells, targets, temper)
    raked = _raked(cells, aims, sweeps)
    rate = sampling_rate(raked, token_budget, token_share)
    chance = F.least(F.lit(1.0), F.col("weight") / F.col("tokens") * F.lit(rate))
    odds = raked.select(*MARGINS, "tokens", chance.alias("probability"))
    expected = odds.withColumn("amount", F.col("tokens") * F.col("probability"))
    if rate:
        _warn_if_off(residuals(expected, aims, "amount"), TOLERANCE, "expected mix")
    odds = odds.drop("tokens")
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    joined = keyed.join(broadcast_if_small(odds, MAX_CELLS), list(MARGINS))
    made = {
        "topic": F.col("topic"), "tokens": F.col("tokens"), "probability": F.col("probability"),
        "kept": draw(key, seed) < F.col("probability"),
    }
    return joined.select(*common.restored(joined, docs, "doc_id", "text", **made))


def op8_mixing(spark, sf_dir):
    out = mixed(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "kept"
    )


QUERIES = {"op8_mixing": op8_mixing}


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    parts = [
        f"""keyed AS (
  SELECT *, CASE WHEN tokens < {SHORT} THEN 'short' WHEN tokens < {LONG} THEN 'medium' ELSE 'long' END AS topic
  FROM (SELECT doc_id, source AS own_source, lang AS own_lang, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
               greatest(1, len(regexp_extract_all(coalesce(text, ''), '{word}'))) AS tokens FROM documents)),
cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM keyed GROUP BY ALL)""",
    ]
    parts += [
        f"aims_{c} AS (SELECT {c}, pow(sum(tokens)::DOUBLE, {TEMPER}) AS aim FROM cells GROUP BY {c})" for c in MARGINS
    ]
    aims = ", ".join(f"aims_{c}.aim / (SELECT sum(aim) FROM aims_{c}) AS aim_{c}" for c in MARGINS)
    joins = " ".join(f"JOIN aims_{c} USING ({c})" for c in MARGINS)
    parts.append(f"w0 AS MATERIALIZED (SELECT cells.*, tokens::DOUBLE AS weight, {aims} FROM cells {joins})")
    n = 0
    for _ in range(SWEEPS):
        for c in MARGINS:
            n += 1
            parts.append(
                f"w{n} AS MATERIALIZED (SELECT * REPLACE (weight * aim_{c} / sum(weight) OVER (PARTITION BY {c}) AS weight) FROM w{n - 1})"
            )
    return (
        "WITH " + ",\n".join(parts) + f""",
placed AS (
  SELECT *, weight / tokens AS per_token, row_number() OVER before AS place, {TOKEN_SHARE} * sum(tokens) FILTER (WHERE weight > 0) OVER () AS wanted,
         coalesce(sum(tokens) OVER before, 0) AS whole, sum(weight) OVER after AS rest
  FROM w{n}
  WINDOW before AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rate AS (SELECT arg_min((wanted - whole) / rest, place) AS rate FROM placed WHERE weight > 0 AND per_token * (wanted - whole) / rest < 1),
odds AS (SELECT source, lang, topic, least(1.0, weight / tokens * rate) AS p FROM w{n}, rate)
SELECT k.doc_id, k.own_source AS source, k.own_lang AS lang, k.topic, k.tokens, round(p, 9) AS probability,
       ('0x' || substr(md5(k.doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT / {float(1 << 52)!r} < p AS kept
FROM keyed k JOIN odds USING (source, lang, topic)"""
    )


ORACLES = {"op8_mixing": _oracle()}
