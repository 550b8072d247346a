"""Preference formatting in DataFrame expressions only.

A pair holds a chosen and a rejected conversation.  Their longest common prefix of turns (equal role and
text) is rendered once, as the prompt; the rest of either side is rendered as its completion, with the
character spans that a loss may count: content and end mark of assistant turns, nothing else.

Defined cases: null role or text counts as empty; a null or empty side has no turns, so the prompt is
empty or the other side's completion is all there is; sides that are equal leave two empty completions;
repeated rows give equal rows; an empty table gives an empty result; other columns are kept as they are
(the results' own names are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import read

TRAINED_ROLE = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"
RESULTS = ["n_prompt_turns", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans"]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def turns_of(side: Column) -> Column:
    blank = F.lit("")
    return F.transform(F.coalesce(side, F.array().cast(TURNS)), lambda t: F.struct(
        F.coalesce(t["role"], blank).alias("role"), F.coalesce(t["text"], blank).alias("text")))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")


def spans(turns: Column) -> Column:
    """[start, end) in the rendered text of what is trained on."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(head(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(a["out"], own))
                        .otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda a: a["out"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns in the longest common prefix."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    equal = F.zip_with(F.slice(chosen, 1, shorter), F.slice(rejected, 1, shorter), lambda a, b: a == b)
    return _let(F.array_position(equal, False), lambda p: F.when(p == 0, shorter).otherwise(p.cast("int") - 1))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with prompt, completions and spans in place of the two sides (arrays of role and text)."""
    others = [F.col(f"`{c}`") for c in pairs.columns if c not in [*RESULTS, chosen, rejected]]
    sides = pairs.select(*others, turns_of(F.col(chosen)).alias("__c"), turns_of(F.col(rejected)).alias("__r"))
    cut = sides.withColumn("__n", common_turns(F.col("__c"), F.col("__r")))
    n = F.col("__n")
    rest = lambda side: F.slice(F.col(side), n + 1, F.size(side) - n)
    return cut.select(*others, n.alias("n_prompt_turns"), rendered(F.slice(F.col("__c"), F.lit(1), n)).alias("prompt"),
                      rendered(rest("__c")).alias("chosen_completion"), spans(rest("__c")).alias("chosen_spans"),
                      rendered(rest("__r")).alias("rejected_completion"), spans(rest("__r")).alias("rejected_spans"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: as it is (chosen), and with its last reply replaced by the reply before
    it, which answered something else, or by nothing if there is none (rejected).  What follows the last
    reply is left out of the rejected side.  Without any reply there is no rejected side."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")))).alias("t"))
    whole = listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"], x["text"])).cast(TURNS).alias("chosen"))
    replies = F.filter(F.transform("chosen", lambda x, i: F.when(x["role"] == TRAINED_ROLE, i + 1)), lambda i: i.isNotNull())
    at = whole.withColumn("r", replies)
    last, earlier = F.get("r", F.size("r") - 1), F.get("r", F.size("r") - 2)
    stale = F.coalesce(F.get("chosen", earlier - 1)["text"], F.lit(""))
    other = F.array(F.struct(F.lit(TRAINED_ROLE).alias("role"), stale.alias("text"))).cast(TURNS)
    return at.select("conv_id", "chosen", F.when(F.size("r") > 0, F.concat(
        F.slice("chosen", F.lit(1), last - 1), other)).alias("rejected"))


def q_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(reply_pairs(read(spark, sf_dir, "conversations")))
    digest = lambda c: F.array_join(F.transform(
        c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: digest(c) for c in ("chosen_spans", "rejected_spans")})


def _rendered_sql(turns: str) -> str:
    return (f"coalesce(array_to_string(list_transform({turns}, lambda x: '{OPEN}' || x.role || chr(10) || x.text"
            f" || '<|im_end|>' || chr(10)), ''), '')")


def _spans_sql(turns: str) -> str:
    upto = (f"coalesce(list_sum(list_transform({turns}[1:i], lambda y: {len(OPEN) + 1 + len(CLOSE)} + length(y.role)"
            " + length(y.text))), 0)")
    one = (f"CAST({upto} - length(({turns})[i].text) - {len(CLOSE)} AS BIGINT) || '-' || CAST({upto} AS BIGINT)")
    return (f"coalesce(array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: ({turns})[i].role"
            f" = '{TRAINED_ROLE}'), lambda i: {one}), ','), '')")


QUERIES = {"op5_chat_format": q_chat_format}
ORACLE = {"op5_chat_format": f"""
    WITH c AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                             ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS chosen
        FROM conversations GROUP BY conv_id),
    r AS (SELECT *, list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].role = '{TRAINED_ROLE}') AS r FROM c),
    p AS (SELECT conv_id, chosen, CASE WHEN len(r) > 0 THEN list_concat(chosen[1:r[-1] - 1],
              [{{'role': '{TRAINED_ROLE}', 'text': CASE WHEN len(r) > 1 THEN chosen[r[-2]].text ELSE '' END}}])
              ELSE [] END AS rejected FROM r),
    q AS (SELECT *, least(len(chosen), len(rejected)) AS m FROM p),
    n AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: chosen[i] <> rejected[i])) - 1, m) AS n FROM q),
    s AS (SELECT conv_id, n, chosen[1:n] AS a, chosen[n + 1:] AS b, rejected[n + 1:] AS d FROM n)
    SELECT conv_id, CAST(n AS INT) AS n_prompt_turns, {_rendered_sql('a')} AS prompt,
           {_rendered_sql('b')} AS chosen_completion, {_spans_sql('b')} AS chosen_spans,
           {_rendered_sql('d')} AS rejected_completion, {_spans_sql('d')} AS rejected_spans
    FROM s"""}
