"""Chat rendering from every participant's perspective.

For each speaker of a conversation (system messages have none) the whole
dialogue is rendered with that speaker's turns as the assistant's, all other
speakers as named users, and the loss mask on the assistant's words.

Built-in functions only. Turns are ranked by ranges (a conversation with any
share of all turns is spread over many tasks) and rendered in parts of
``PART`` turns, so no task ever gathers a whole conversation; a conversation
of up to ``PART`` turns is one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blockwise.llm.common import cut
from blockwise.operators.prefix import SUM, ordered_scan, ranged_rank

PART = 256
# fixed values: control markers of the chat format
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", part_turns: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_turns, char_start, text, spans): one
    row per conversation, speaker and part. ``spans`` lists the trained
    stretches as start:stop character offsets within the part's text (the
    assistant's words and closing marker); ``char_start`` is the part's
    offset in the dialogue.

    Turns are ordered by (turn, role, text), nulls first; repeated turns are
    kept. A null text is empty; a null role speaks as the user ``unknown``
    and has no perspective; a null conversation id is a conversation; speakers
    whose names differ in signs only are rendered under one name. A
    conversation without speakers has no rows. Control markers inside texts
    are broken up with a space; other columns are not read."""
    t = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                             F.col(text).alias("raw"))
    t = ranged_rank(t, ["turn", "role", "raw"], ["conv_id"], out="seq")
    t = t.select("conv_id", "role", "seq", F.floor(F.col("seq") / part_turns).alias("part"),
                 F.replace(F.coalesce("raw", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    who = (t.filter((F.col("role") != SYSTEM) & F.col("role").isNotNull())
           .select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct())
    # speakers meet the parts of their conversation, then a part's turns: no key has more than a part
    spots = t.select("conv_id", "part").distinct().join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "_conv", F.col("part").alias("_part"), "perspective")
    x = t.join(spots, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    me = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    name = F.coalesce(F.regexp_replace("role", "[^A-Za-z0-9_-]", "_"), F.lit("unknown"))
    head = F.when(F.col("role") == SYSTEM, F.lit(f"{OPEN}system\n")).when(me, F.lit(f"{OPEN}assistant\n")).otherwise(
        F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    x = x.select("conv_id", "perspective", "part", "seq", me.alias("me"), head.alias("head"),
                 F.concat("body", F.lit(CLOSE)).alias("body"))
    key = ["conv_id", "perspective", "part"]
    row = F.struct("seq", "me", "head", "body", F.char_length("head").alias("h"), F.char_length("body").alias("b"))
    parts = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(row)).alias("rows"))

    def take(done, r):      # the part's turns in order: the place reached, and the trained stretches
        at = done["at"] + r["h"]
        return F.struct((at + r["b"] + 1).alias("at"), F.when(
            r["me"], F.concat(done["spans"], F.array(F.concat_ws(":", at, at + r["b"])))).otherwise(done["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    parts = cut(parts.select(*key, "n_turns", F.aggregate("rows", start, take).alias("done"), F.array_join(
        F.transform("rows", lambda r: F.concat(r["head"], r["body"], F.lit("\n"))), "").alias("text")))
    # offsets of the parts from their lengths alone
    narrow = parts.select(*key, F.col("done.at").cast("long").alias("n"))
    offsets = ordered_scan(narrow, ["part"], {"char_start": (SUM, F.col("n"))}, ["conv_id", "perspective"], inclusive=False)
    offsets = offsets.select(*[F.col(c).alias(f"_{c}") for c in key], "char_start")
    same = (F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective"))
            & (F.col("part") == F.col("_part")))
    return parts.join(offsets, same).select(
        *key, "n_turns", F.coalesce("char_start", F.lit(0)).cast("long").alias("char_start"), "text",
        F.array_join("done.spans", ",").alias("spans"))


# rotate() in DuckDB over ``conversations``, for dialogues of one part
SQL = """
with t as (
  select conv_id, role, replace(coalesce(text, ''), '<|', '< |') as body,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as seq
  from conversations),
p as (select distinct conv_id, role as perspective from t where role is not null and role <> 'system'),
x as (
  select t.conv_id, p.perspective, t.seq, coalesce(t.role = p.perspective, false) as me,
         case when t.role = 'system' then '<|im_start|>system' || chr(10)
              when t.role = p.perspective then '<|im_start|>assistant' || chr(10)
              else '<|im_start|>user name=' || coalesce(regexp_replace(t.role, '[^A-Za-z0-9_-]', '_', 'g'), 'unknown')
                   || chr(10) end as head,
         t.body || '<|im_end|>' as body
  from t join p on t.conv_id is not distinct from p.conv_id),
y as (
  select *, seq // 256 as part, length(head) + length(body) + 1 as n from x),
z as (
  select *, coalesce(sum(n) over (partition by conv_id, perspective, part order by seq
                                  rows between unbounded preceding and 1 preceding), 0) + length(head) as p0
  from y),
g as (
  select conv_id, perspective, part, count(*) as n_turns, sum(n) as n,
         string_agg(head || body || chr(10), '' order by seq) as text,
         coalesce(string_agg(case when me then cast(cast(p0 as bigint) as varchar) || ':'
                             || cast(cast(p0 + length(body) as bigint) as varchar) end, ',' order by seq), '') as spans
  from z group by all)
select conv_id, perspective, part, n_turns,
       cast(coalesce(sum(n) over (partition by conv_id, perspective order by part
                             rows between unbounded preceding and 1 preceding), 0) as bigint) as char_start,
       text, spans
from g
"""
