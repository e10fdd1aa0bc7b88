"""Preference formatting: a chosen and a rejected conversation share their longest common turn prefix as prompt.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Turns look like this (fixed values).
OPEN, NAMED, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(NAMED))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    """Text of an array of struct(role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) in characters of render(turns) that a model learns from: what follows the heads of the
    assistant's turns, end mark included. The rest is masked."""
    empty = F.lit([]).cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.struct(begin.alias("start"), end.alias("end"))
        grown = F.when(t["role"] == LEARNED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), grown.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns in which two arrays of struct(role, text) agree."""
    shorter = F.least(F.size(a), F.size(b))
    return let(
        F.array_position(F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y), False),
        lambda at: F.when(at == 0, shorter).otherwise((at - 1).cast("int")),
    )


def format_pairs(turns: DataFrame, pair: str = "pair_id", chosen: str = "chosen") -> DataFrame:
    """One row per pair of turns(pair, chosen boolean, turn, role, text): n_chosen, n_rejected, n_common (turns),
    prompt, chosen_completion, rejected_completion, and the loss spans of both completions.

    Turns stand by (turn, role, text); a null turn comes first, a null role or text is empty, repeated rows are
    repeated turns. A pair with one side only has a null other completion and an empty prompt; identical
    sides have empty completions. Rows with a null pair or a null side are in no pair and are left out. Other
    columns are ignored. A conversation becomes one row of output, which is all that a task must hold."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = (
        turns.where(F.col(pair).isNotNull() & F.col(chosen).isNotNull())
        .groupBy(F.col(pair).alias("_pair"))
        .agg(F.collect_list(F.when(F.col(chosen), row)).alias("a"), F.collect_list(F.when(~F.col(chosen), row)).alias("b"))
    )
    strip = lambda c: F.transform(F.sort_array(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = sides.select("_pair", strip(F.col("a")).alias("a"), strip(F.col("b")).alias("b"))
    rest = lambda c, v: F.slice(c, v["n"] + 1, F.greatest(F.size(c) - v["n"], F.lit(0)))
    cut_at = sides.withColumn("v", F.struct(common_turns(F.col("a"), F.col("b")).alias("n")))
    parts = cut_at.select(
        "_pair",
        F.size("a").alias("n_chosen"),
        F.size("b").alias("n_rejected"),
        F.col("v.n").alias("n_common"),
        F.slice("a", 1, F.col("v.n")).alias("p"),
        F.when(F.size("a") > 0, rest(F.col("a"), F.col("v"))).alias("a"),
        F.when(F.size("b") > 0, rest(F.col("b"), F.col("v"))).alias("b"),
    )
    return parts.select(
        F.col("_pair").alias(pair),
        "n_chosen",
        "n_rejected",
        "n_common",
        render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen_completion"),
        render(F.col("b")).alias("rejected_completion"),
        loss_spans(F.col("a")).alias("chosen_loss"),
        loss_spans(F.col("b")).alias("rejected_loss"),
    )


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected side of pair k."""
    conv = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations").select(F.floor(conv / 2).cast("long").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return format_pairs(turns).select(
        "pair_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_chosen", "n_rejected", "n_common")),
        F.length("prompt").cast("long").alias("prompt_chars"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen_completion", 256).alias("chosen_sha256"),
        F.sha2("rejected_completion", 256).alias("rejected_sha256"),
        total(F.col("chosen_loss")).alias("chosen_loss_chars"),
        total(F.col("rejected_loss")).alias("rejected_loss_chars"),
    )


OP9_SQL = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
         a.pair_id IS NOT NULL AS in_a, b.pair_id IS NOT NULL AS in_b,
         a.role AS a_role, a.text AS a_text, b.role AS b_role, b.text AS b_text,
         coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b USING (pair_id, k)),
n AS (
  SELECT pair_id, count(*) FILTER (in_a) AS n_chosen, count(*) FILTER (in_b) AS n_rejected,
         coalesce(min(k) FILTER (NOT same) - 1, count(*)) AS n_common FROM m GROUP BY pair_id),
r AS (
  SELECT m.pair_id, n_chosen, n_rejected, n_common,
    coalesce(string_agg('<|' || a_role || '|>' || chr(10) || a_text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k <= n_common), '') AS p,
    coalesce(string_agg('<|' || a_role || '|>' || chr(10) || a_text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k > n_common AND in_a), '') AS a,
    coalesce(string_agg('<|' || b_role || '|>' || chr(10) || b_text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k > n_common AND in_b), '') AS b,
    coalesce(sum(length(a_text) + 8) FILTER (k > n_common AND a_role = 'assistant'), 0) AS la,
    coalesce(sum(length(b_text) + 8) FILTER (k > n_common AND b_role = 'assistant'), 0) AS lb
  FROM m JOIN n USING (pair_id) GROUP BY ALL)
SELECT pair_id, n_chosen, n_rejected, n_common, length(p) AS prompt_chars, sha256(p) AS prompt_sha256,
  CASE WHEN n_chosen > 0 THEN sha256(a) END AS chosen_sha256, CASE WHEN n_rejected > 0 THEN sha256(b) END AS rejected_sha256,
  CASE WHEN n_chosen > 0 THEN CAST(la AS BIGINT) END AS chosen_loss_chars,
  CASE WHEN n_rejected > 0 THEN CAST(lb AS BIGINT) END AS rejected_loss_chars
FROM r
"""
