"""Preference formatting with DataFrame functions only.

Chosen and rejected conversations of a pair share their longest common turn prefix, which is
rendered once as the prompt; what follows on either side becomes a completion, with a
mask that names the characters to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(turns: Column) -> Column:
    """Turns as text: a header with the role, the content, an end mark."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")),
        ),
        "",
    )


def mask(turns: Column, learn: str = "assistant") -> Column:
    """(first, last + 1) character of each content and end mark by ``learn`` in the rendered turns.

    Characters are code points. Headers, other roles and line ends stay masked.
    """
    before = len("<|im_start|>") + 1
    after = len("<|im_end|>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(t["role"]) + before
        last = first + F.length(t["text"]) + after
        span = F.array(F.struct(first.alias("first"), last.alias("last")))
        return F.struct(
            (last + 1).alias("at"),
            F.when(t["role"] == learn, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(turns: DataFrame, pair: str, chosen: str, learn: str = "assistant") -> DataFrame:
    """One row for each pair: prompt, chosen and rejected completion with masks, turn counts.

    ``turns`` has turn, role, text, the pair's key ``pair`` and a boolean ``chosen`` that says
    which conversation of the pair a turn belongs to. Turns are taken by number, ties by role
    and text, nulls first; null roles and texts read as empty. Turns with equal role and
    text are common while all before them are. A pair with one conversation only has no common
    prefix: its prompt is empty and the missing completion null. Turns whose ``chosen`` is null belong
    to neither side; a null pair key is a pair of its own; repeated rows are turns twice. An empty table gives no
    rows, extra columns are not looked at.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sides = turns.groupBy(F.col(pair)).agg(
        F.array_sort(F.collect_list(F.when(F.col(chosen), turn))).alias("__c"),
        F.array_sort(F.collect_list(F.when(~F.col(chosen), turn))).alias("__r"),
    )
    c, r = F.col("__c"), F.col("__r")
    n = F.least(F.size(c), F.size(r))
    same = F.zip_with(
        F.slice(c, 1, n), F.slice(r, 1, n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    )
    first_other = F.array_position(same, False)
    sides = sides.withColumn(
        "__n", F.when(first_other > 0, first_other - 1).otherwise(n).cast("int")
    )
    common = F.col("__n")

    def rest(side: Column) -> Column:
        return F.slice(side, common + 1, F.greatest(F.size(side) - common, F.lit(0)))

    def there(side: Column, value: Column) -> Column:
        return F.when(F.size(side) > 0, value)

    return sides.select(
        F.col(pair),
        common.alias("n_common"),
        F.size(c).alias("n_chosen"),
        F.size(r).alias("n_rejected"),
        render(F.slice(c, 1, common)).alias("prompt"),
        there(c, render(rest(c))).alias("chosen"),
        there(c, mask(rest(c), learn)).alias("chosen_mask"),
        there(r, render(rest(r))).alias("rejected"),
        there(r, mask(rest(r), learn)).alias("rejected_mask"),
    )
