"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns of the chosen and the rejected conversation, rendered once; the
rest of each is its completion, in which the assistant's words and their end mark are to be learned. Everything
stays a row for each turn with places in the rendered string, so a conversation of any length is no group that one
task must hold; `assemble` joins the turns of ordinary ones.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import pick, read

TURNS = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}


@dataclass(frozen=True)
class Template:
    """A turn is open + role + after_role + text + close. `open_` and `close` inside a text lose their first
    character to `escape` + that character, so a text can't end its turn."""

    open_: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    marks: tuple[str, ...] = ("<|im_start|>", "<|im_end|>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    block: int = 64  # turns that one task orders at a time


def buddies(turns: DataFrame) -> DataFrame:
    """The pairing of a plain table: conversation 2 k is chosen over 2 k + 1. Rows without conv_id are in no
    conversation and left out."""
    turns = pick(turns, TURNS).filter("conv_id is not null")
    return turns.select(F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("rejected"), "turn", "role", "text")


def _in_order(blocks: DataFrame, value: str) -> Column:
    """The sum of a block's `value` over the blocks of its conversation before it."""
    before = Window.partitionBy("pair_id", "rejected").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def _by_side(value: str) -> list[Column]:
    """A conversation pair's two values in one row, chosen and rejected."""
    return [F.max(F.when(side, F.col(value))).alias(f"{value}{i}") for i, side in enumerate((~F.col("rejected"), F.col("rejected")))]


def _mine(value: str) -> Column:
    return F.when(F.col("rejected"), F.col(f"{value}1")).otherwise(F.col(f"{value}0"))


def format_pairs(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """turns: pair_id, rejected, turn, role, text. A row for each turn of each part (prompt, chosen, rejected):
    pair_id, part, position, role, rendered, start_at, end_at, mask_from, mask_to; places count characters of
    the part, and the mask is null for turns that are not learned.

    Turns go by (turn, role, text), nulls first; equal rows are turns in a row. Null roles and texts count as
    empty, texts of any length are rendered whole. Turns are compared by 128 bits of hash. A conversation without
    partner has an empty prompt, equal ones have empty completions; an empty table gives no rows.

    Texts are shuffled once, by pair and block of turn numbers, and everything else joins them there by that key:
    a turn's place and length so far are those of its block's start, from sums over blocks, and of the turns
    before it in the block; where the two sides part is found on their hashes."""
    def escaped(c: Column) -> Column:
        for mark in t.marks:
            c = F.replace(c, F.lit(mark), F.lit(t.escape + mark))
        return c

    raw = F.coalesce("text", F.lit(""))
    role, block = F.coalesce("role", F.lit("")), F.coalesce(F.floor(F.col("turn") / t.block), F.lit(-(1 << 62))).cast("bigint")
    length = (F.length(role) + F.length(escaped(raw)) + len(t.open_ + t.after_role + t.close)).cast("bigint")
    key = ["pair_id", "_block"]
    sized = turns.select("pair_id", "rejected", block.alias("_block"), length.alias("_length"))
    blocks = sized.groupBy("pair_id", "rejected", "_block").agg(F.count("*").alias("_n"), F.sum("_length").alias("_length"))
    starts = blocks.select("pair_id", "rejected", "_block", _in_order(blocks, "_n").alias("_first"), _in_order(blocks, "_length").alias("_ahead"))
    starts = starts.groupBy(*key).agg(*_by_side("_first"), *_by_side("_ahead"))

    dealt = turns.select("pair_id", "rejected", "turn", role.alias("role"), raw.alias("_raw"), length.alias("_length"), block.alias("_block")).repartition(*key)
    inside = Window.partitionBy("pair_id", "rejected", "_block").orderBy("turn", "role", "_raw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("_n", F.row_number().over(inside) - 1).withColumn("_so_far", F.sum("_length").over(inside) - F.col("_length"))

    hashes = F.xxhash64("role", "_raw").alias("a"), F.xxhash64("_raw", F.lit(1), "role").alias("b")
    narrow = dealt.select(*key, "rejected", "_n", "_so_far", *hashes).join(starts, key)
    narrow = narrow.select("pair_id", "rejected", (_mine("_first") + F.col("_n")).alias("position"), (_mine("_ahead") + F.col("_so_far")).alias("_ahead"), "a", "b")
    turn = narrow.groupBy("pair_id", "position").agg(F.count("*").alias("n"), *_by_side("_ahead"), *(f(c).alias(f"{c}{i}") for c in "ab" for i, f in enumerate((F.min, F.max))))
    differs = (F.col("n") < 2) | (F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1"))
    parting = F.min(F.when(differs, F.struct("position", F.col("_ahead0").alias("cut0"), F.col("_ahead1").alias("cut1"))))
    parting = turn.groupBy("pair_id").agg(F.coalesce(parting, F.struct((F.max("position") + 1).alias("position"), F.lit(None).cast("bigint").alias("cut0"), F.lit(None).cast("bigint").alias("cut1"))).alias("p"))
    places = starts.join(parting.select("pair_id", F.col("p.position").alias("common"), "p.cut0", "p.cut1"), "pair_id")

    out = dealt.join(places, key).withColumn("position", (_mine("_first") + F.col("_n")).cast("bigint")).filter("position >= common or not rejected")
    part = F.when(F.col("position") < F.col("common"), "prompt").when(F.col("rejected"), "rejected").otherwise("chosen")
    header = F.concat(F.lit(t.open_), "role", F.lit(t.after_role))
    ahead = _mine("_ahead") + F.col("_so_far") - F.when(F.col("position") < F.col("common"), 0).otherwise(_mine("cut"))
    out = out.select("pair_id", part.alias("part"), "position", "role", F.concat(header, escaped(F.col("_raw")), F.lit(t.close)).alias("rendered"), ahead.cast("bigint").alias("start_at"), "_length")
    end, learned = F.col("start_at") + F.col("_length"), (F.col("part") != "prompt") & F.col("role").isin(*t.learned)
    return out.select(
        "pair_id", "part", "position", "role", "rendered", "start_at", end.alias("end_at"),
        F.when(learned, F.col("start_at") + F.length("role") + len(t.open_ + t.after_role)).alias("mask_from"), F.when(learned, end).alias("mask_to"),
    )


def assemble(formatted: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected and the learned ranges of both completions, for conversations that fit a
    row each."""
    of = [F.col("part") == p for p in ("prompt", "chosen", "rejected")]

    def joined(which) -> Column:
        turns = F.array_sort(F.collect_list(F.when(which, F.struct("position", "rendered"))))
        return F.array_join(F.transform(turns, lambda x: x["rendered"]), "")

    def ranges(which) -> Column:
        return F.array_sort(F.collect_list(F.when(which & F.col("mask_from").isNotNull(), F.struct("mask_from", "mask_to"))))

    return formatted.groupBy("pair_id").agg(
        joined(of[0]).alias("prompt"), joined(of[1]).alias("chosen"), joined(of[2]).alias("rejected"), ranges(of[1]).alias("chosen_mask"), ranges(of[2]).alias("rejected_mask")
    )


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(buddies(read(spark, sf_dir, "conversations")))


OP3_SQL = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 1 AS rejected, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS position
  FROM conversations WHERE conv_id IS NOT NULL),
places AS (
  SELECT pair_id, position, count(*) < 2 OR min(role) <> max(role) OR min(txt) <> max(txt) AS differs FROM t GROUP BY pair_id, position),
common AS (
  SELECT pair_id, coalesce(min(CASE WHEN differs THEN position END), max(position) + 1) AS common FROM places GROUP BY pair_id),
r AS (
  SELECT t.pair_id, CASE WHEN position < common THEN 'prompt' WHEN rejected THEN 'rejected' ELSE 'chosen' END AS part, position, role,
         '<|im_start|>' || role || chr(10) || replace(replace(txt, '<|im_start|>', '\<|im_start|>'), '<|im_end|>', '\<|im_end|>') || '<|im_end|>' || chr(10) AS rendered
  FROM t JOIN common USING (pair_id) WHERE position >= common OR NOT rejected),
s AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY position) - length(rendered) AS BIGINT) AS start_at,
         part <> 'prompt' AND role = 'assistant' AS learned FROM r)
SELECT pair_id, part, CAST(position AS BIGINT) AS position, role, rendered, start_at, start_at + length(rendered) AS end_at,
       CASE WHEN learned THEN start_at + length('<|im_start|>') + length(role) + 1 END AS mask_from,
       CASE WHEN learned THEN start_at + length(rendered) END AS mask_to FROM s
"""
