r"""Chat formatting in budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens cut a conversation at fixed marks: turns that lie between two marks form a span, a
turn across a mark joins the span after it where both fit, and is a window of its own otherwise. Every window
starts with the system turn and a limited history; what it repeats is masked, so each assistant text is under
loss once. A turn is written ``<turn ROLE>TEXT</turn>`` and a line feed. In texts a backslash is doubled and one is
put between ``<`` and ``turn`` or ``/turn``; in roles ``\``, ``<`` and ``>`` become ``\b``, ``\l`` and ``\g``. So
nothing in them reads as a mark, the first ``>`` ends a head, and unescaping gives both back.

Prefix sums are taken in blocks of turns, so a very long conversation is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.session import stored

BUDGET = 512
HISTORY_TOKENS = 128
HISTORY_TURNS = 2

#: What the marks around a turn cost.
MARK_TOKENS = 4

#: Turns of one block of the prefix sums: 2 to this power.
BLOCK_BITS = 9

#: What stands for signs in roles; the backslash is written first and read last.
ROLE_CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))

_OPEN = "<turn "
_CLOSE = "</turn>\n"
_KEY = ["conv", "no_id"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(/?turn)", r"<\\$1")


def escaped_role(role: Column) -> Column:
    for sign, code in ROLE_CODES:
        role = F.replace(role, F.lit(sign), F.lit(code))
    return role


def unescaped_role(role: Column) -> Column:
    for sign, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(sign))
    return role


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + MARK_TOKENS).cast("long")


def _placed(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in order, with their number and the tokens before them."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"), F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)).cast("long")).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"tokens": turn_tokens(F.col("text")), "block": F.shiftright("turn", BLOCK_BITS)})
    order = Window.partitionBy(*_KEY, "block").orderBy("turn", "role", "text")
    past = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inside = rows.withColumns({
        "seq": F.row_number().over(order).cast("long"),
        "before": F.coalesce(F.sum("tokens").over(order.rowsBetween(*past)), zero),
    })
    earlier = Window.partitionBy(*_KEY).orderBy("block").rowsBetween(*past)
    blocks = rows.groupBy(*_KEY, "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).select(
        *_KEY, "block", F.coalesce(F.sum("n").over(earlier), zero).alias("n0"),
        F.coalesce(F.sum("t").over(earlier), zero).alias("t0"),
    )
    return inside.join(blocks, [*_KEY, "block"]).select(
        *_KEY, (F.col("seq") + F.col("n0")).alias("seq"), (F.col("before") + F.col("t0")).alias("before"),
        "role", "text", "tokens",
    )


def _spans(placed: DataFrame, systems: DataFrame, budget: int, history: int) -> DataFrame:
    """The turns but the system turn, with the number w of the window they are new in."""
    room = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(budget // 4)).cast("long")
    turns = (
        placed.join(systems.select(*_KEY, F.col("tokens").alias("system_tokens")), _KEY, "left")
        .where(~((F.col("seq") == 1) & F.col("system_tokens").isNotNull()))
        .withColumns({"room": room, "at": F.col("before") - F.coalesce("system_tokens", F.lit(0))})
        .withColumns({"mark": F.expr("(at + tokens - 1) div room"), "across": F.expr("at div room <> (at + tokens - 1) div room")})
    )
    together = F.sum("tokens").over(Window.partitionBy(*_KEY, "mark"))
    apart = F.col("across") & (together > F.col("room"))
    return turns.select(
        *_KEY, "seq", "before", "role", "text", "tokens",
        F.when(apart, F.col("mark") * 2 - 1).otherwise(F.col("mark") * 2).alias("w"),
    )


def _length(part: Column) -> Column:
    return F.length(part["head"]) + F.length(part["body"]) + len(_CLOSE)


def chat_windows(
    turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS
) -> DataFrame:
    """conv_id, w, formatted, loss (array of start, end in code points), n_turns, n_repeated: a row per window.

    A window has the system turn (a first turn of that role), up to ``history_turns`` and ``history_tokens`` of the
    turns before its span, and its span; the first ``n_repeated`` turns stand in an earlier window already. Tokens
    are words and four for the marks of a turn. A window is within ``budget`` unless one turn, or a system turn of
    over half the budget, is too long by itself: no text is cut. ``loss`` covers the escaped assistant texts that are
    not repeated. Turns go by turn, then role and text, so ties and repeated rows have a fixed order and all stay; a
    null turn comes first, a null role or text is empty and either may be of any length, and rows without conv_id are
    one conversation.
    An empty table gives no rows. Other columns are not used.
    """
    placed = stored(_placed(turns), "turns")
    systems = placed.where("seq = 1 and role = 'system'")
    spans = stored(_spans(placed, systems, budget, history_tokens), "spans")
    windows = spans.groupBy(*_KEY, "w").agg(F.min("seq").alias("first"), F.min("before").alias("first_before"))
    new = spans.select(*_KEY, "w", "seq", F.lit(False).alias("repeated"), "role", "text")
    past = (
        windows.select(*_KEY, "w", "first_before", F.explode(F.sequence(F.col("first") - history_turns, F.col("first") - 1)).alias("seq"))
        .join(spans.drop("w"), [*_KEY, "seq"])
        .where(F.col("first_before") - F.col("before") <= history_tokens)
        .select(*_KEY, "w", "seq", F.lit(True).alias("repeated"), "role", "text")
    )
    led = systems.join(windows.select(*_KEY, "w", "first"), _KEY, "left").select(
        *_KEY, F.coalesce("w", F.lit(0).cast("long")).alias("w"), "seq",
        F.coalesce(F.col("first") > 2, F.lit(False)).alias("repeated"), "role", "text",
    )
    whole = new.union(past).union(led).groupBy(*_KEY, "w").agg(
        F.sort_array(F.collect_list(F.struct("seq", "repeated", "role", "text"))).alias("turns")
    )
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(_OPEN), escaped_role(t["role"]), F.lit(">")).alias("head"), escaped(t["text"]).alias("body"),
        ((t["role"] == "assistant") & ~t["repeated"]).alias("learnt"),
    ))
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + _length(p)).alias("at"),
            F.when(p["learnt"], F.array_append(a["spans"], F.struct(
                (a["at"] + F.length(p["head"])).alias("start"),
                (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
            ))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    written = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "")
    return whole.withColumn("parts", parts).select(
        F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), "w", written.alias("formatted"), ends.alias("loss"),
        F.size("turns").alias("n_turns"), F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, w, turns (array of role, text; each turn in one window only), learnt (array of texts under loss)."""
    pieces = F.filter(F.split("formatted", _CLOSE), lambda p: p != "")
    head = lambda p: F.substring_index(p, ">", 1)
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped_role(F.substring(head(p), F.lit(len(_OPEN) + 1), F.length(p))).alias("role"),
        unescaped(F.substring(p, F.length(head(p)) + 2, F.length(p))).alias("text"),
    ))
    learnt = F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.select(
        "conv_id", "w", "formatted",
        F.slice(turns, F.col("n_repeated") + 1, F.col("n_turns")).alias("turns"), learnt.alias("learnt"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    r"""The turns and conversation -7, whose two texts look like marks."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)


def op2_chat_windows(spark, sf_dir):
    read = read_back(chat_windows(with_probe(common.table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_window = read.select(
        "conv_id", "w", F.size("turns").cast("long").alias("n"), said.alias("said"),
        F.array_join("learnt", "").alias("learnt"), F.length("formatted").cast("long").alias("chars"),
    )
    whole = by_window.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("w", "said", "learnt"))).alias("parts"),
    )
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("learnt")).cast("long").alias("loss_chars"), F.sha2(joined("learnt"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op2_chat_windows": op2_chat_windows}

_ESC = r"regexp_replace(replace({0}, '\', '\\'), '<(/?turn)', '<\\\1', 'g')"

ORACLES = {"op2_chat_windows": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
counted AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARK_TOKENS} AS tokens,
         6 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + 1 + length({_ESC.format('text')}) + {len(_CLOSE)} AS chars
  FROM rows),
placed AS (
  SELECT *, row_number() OVER o AS seq, (sum(tokens) OVER o - tokens)::BIGINT AS before
  FROM counted WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
systems AS (SELECT conv_id, tokens AS s, chars AS s_chars FROM placed WHERE seq = 1 AND role = 'system'),
cut AS (
  SELECT *, (past_tokens + tokens - 1) // room AS mark, past_tokens // room <> (past_tokens + tokens - 1) // room AS across
  FROM (SELECT p.*, s, s_chars, greatest({BUDGET - HISTORY_TOKENS} - coalesce(s, 0), {BUDGET // 4}) AS room,
               before - coalesce(s, 0) AS past_tokens
        FROM placed p LEFT JOIN systems USING (conv_id) WHERE NOT (seq = 1 AND s IS NOT NULL))),
spans AS (
  SELECT *, CASE WHEN across AND sum(tokens) OVER (PARTITION BY conv_id, mark) > room THEN 2 * mark - 1 ELSE 2 * mark END AS w
  FROM cut),
windows AS (
  SELECT conv_id, w, min(seq) AS first, min(before) AS first_before, sum(chars) + coalesce(any_value(s_chars), 0) AS chars
  FROM spans GROUP BY conv_id, w),
past AS (
  SELECT w.conv_id, sum(h.chars) AS chars
  FROM windows w JOIN spans h ON h.conv_id = w.conv_id AND h.seq BETWEEN w.first - {HISTORY_TURNS} AND w.first - 1
       AND w.first_before - h.before <= {HISTORY_TOKENS}
  GROUP BY w.conv_id),
lonely AS (SELECT conv_id, s_chars AS chars FROM systems WHERE conv_id NOT IN (SELECT conv_id FROM windows)),
sizes AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars
  FROM (SELECT conv_id, chars FROM windows UNION ALL SELECT * FROM past UNION ALL SELECT * FROM lonely) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars
FROM placed JOIN sizes USING (conv_id) GROUP BY conv_id"""}
