"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant, all
others as named users, system turns as they are; the mask covers what the assistant says. A turn's place in a rendering
is a running sum over the dialogue: the lengths of all turns before it as others see them, and what each of the
speaker's own turns before it is shorter for being headed `assistant`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: In texts and roles the beginning of a mark is parted, so that no text opens or closes a turn.
MARK, PARTED = "<|", "< |"
ASSISTANT, SYSTEM, USER, NAMED = "assistant", "system", "user", "user name="


def heading(role: Column) -> Column:
    """How others see a role: line ends in names become spaces."""
    name = F.translate(F.replace(role, F.lit(MARK), F.lit(PARTED)), "\r\n", "  ")
    return F.when(role.isNull(), USER).when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit(NAMED), name))


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, turns, rendered string, masks array<struct<start,end>>), offsets in characters.

    One row for each participant of a conversation; the whole dialogue is in it, so its length is bound only by that of a
    string. Turns are ordered by turn, then role, then text (nulls first); turns with equal numbers, and turns repeated
    exactly, all stay. A null text is empty; a null role is a user without a name and no participant; system is no participant, and
    a conversation without participants gives no row. Rows with null ids form a conversation. `<|` in texts and roles is
    written `< |`. Extra columns, whatever their names, are ignored; no rows give no rows.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(MARK), F.lit(PARTED)).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "role").orderBy(*order)
    head, body = F.char_length(heading(F.col("role"))), F.char_length("text") + len(CLOSE)
    placed = turns.withColumn("at", F.coalesce(F.sum(len(OPEN) + 1 + head + body).over(before), F.lit(0)))
    placed = placed.withColumn("own", F.row_number().over(own) - 1)
    start = F.col("at") + F.col("own") * (len(ASSISTANT) - head) + len(OPEN) + len(ASSISTANT) + 1
    span = F.struct(start.cast("long").alias("start"), (start + body).cast("long").alias("end"))
    dialogues = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("dialogue"))
    masks = (
        placed.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM))
        .groupBy(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker"))
        .agg(F.sort_array(F.collect_list(span)).alias("masks"))
    )
    each = dialogues.join(masks, F.col("conv_id").eqNullSafe(F.col("__conv")))

    def turn(t):
        role = F.when(t["role"] == F.col("speaker"), ASSISTANT).otherwise(heading(t["role"]))
        return F.concat(F.lit(OPEN), role, F.lit("\n"), t["text"], F.lit(CLOSE))

    return each.select(
        "conv_id", "speaker", F.size("dialogue").cast("long").alias("turns"), F.array_join(F.transform("dialogue", turn), "").alias("rendered"), "masks"
    )


def op7_chat_rotation(conversations: DataFrame) -> DataFrame:
    """The renderings, with masks as start:end, comma-joined; edge cases as in rotate."""
    span = lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))
    return rotate(conversations).select("conv_id", "speaker", "turns", "rendered", F.array_join(F.transform("masks", span), ",").alias("masks"))


ORACLE_SQL = r"""
with t as (select conv_id, cast(turn as bigint) turn, cast(role as varchar) as role,
    replace(coalesce(cast(text as varchar), ''), '<|', '< |') as text from conversations),
s as (select distinct conv_id c, role speaker from t where role is not null and role <> 'system'),
e as (select t.*, speaker, '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system'
    when role is null then 'user' else 'user name=' || replace(replace(replace(role, '<|', '< |'), chr(10), ' '), chr(13), ' ') end || chr(10) head,
    text || '<|im_end|>' || chr(10) body from t join s on conv_id is not distinct from c),
o as (select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, speaker
    order by turn nulls first, role nulls first, text rows between unbounded preceding and 1 preceding), 0) + length(head) at_ from e)
select conv_id, speaker, count(*) turns,
    string_agg(head || body, '' order by turn nulls first, role nulls first, text) rendered,
    coalesce(string_agg(cast(at_ as bigint) || ':' || cast(at_ + length(body) as bigint), ',' order by at_)
        filter (where role = speaker), '') masks
from o group by conv_id, speaker
"""
