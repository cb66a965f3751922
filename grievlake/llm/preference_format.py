"""Preference formatting with DataFrame functions only.

Each pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as
the prompt; what follows becomes the two completions. A completion's mask is a list of runs (characters,
loss): the texts of its assistant turns with their end marks count, headers and all other turns do not.

Turns are ordered by number, then role, then text, so ties and repeated rows have one order; each row is a
turn. A null role or text counts as empty. Rows without a pair id belong to no conversation and are left out.
A pair with only one side has an empty other side. Marks inside texts are spaced out, so that no text can
open or close a turn. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a turn.
START, STOP = "<|im_start|>", "<|im_end|>"
MARKS = r"<\|(im_start|im_end)\|>"
SPACED = "<| $1 |>"


def _body(turn: Column) -> Column:
    return F.regexp_replace(turn["text"], MARKS, SPACED)


def render(turns: Column) -> Column:
    """The text of a list of turns."""
    one = lambda t: F.concat(F.lit(START), F.regexp_replace(t["role"], MARKS, SPACED), F.lit("\n"), _body(t), F.lit(STOP + "\n"))
    return F.array_join(F.transform(turns, one), "")


def mask(turns: Column) -> Column:
    """Runs of (characters, loss) that cover the rendered turns."""
    def runs(t: Column) -> Column:
        counts = F.when(t["role"] == "assistant", 1).otherwise(0)
        header = F.lit(len(START) + 1) + F.char_length(F.regexp_replace(t["role"], MARKS, SPACED))
        run = lambda n, loss: F.struct(n.cast("int").alias("n"), loss.cast("int").alias("loss"))
        return F.array(run(header, F.lit(0)), run(F.char_length(_body(t)) + len(STOP), counts), run(F.lit(1), F.lit(0)))

    return F.flatten(F.transform(turns, runs))


def format_pairs(
    chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row per pair: ``n_common`` turns, ``prompt``, ``chosen`` and ``rejected`` completions, their masks, and
    ``status``: ok, or which side ends where the other goes on (chosen_ends, rejected_ends), or same."""
    def side(df: DataFrame, number: int) -> DataFrame:
        turn = F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        return df.filter(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), F.lit(number).alias("side"), turn.alias("t"))

    def turns(number: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == number, F.col("t"))))

    # one shuffle brings both sides of a pair together
    pairs = side(chosen, 0).union(side(rejected, 1)).groupBy("pair").agg(turns(0).alias("a"), turns(1).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    return (
        pairs.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int"))
        .select("pair", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
        .select(
            F.col("pair").alias(pair_col), F.col("n_common").cast("long").alias("n_common"), render(F.col("p")).alias("prompt"),
            render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"),
            mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"),
            F.when((F.size("a") > 0) & (F.size("b") > 0), "ok").when(F.size("a") > 0, "rejected_ends")
            .when(F.size("b") > 0, "chosen_ends").otherwise("same").alias("status"),
        )
    )


def with_foreign_answer(turns: DataFrame) -> DataFrame:
    """The same conversations, the last assistant turn of each replaced by that of the conversation numbered
    one less (an empty one if there is none): rejected sides for a table that has only good answers."""
    answers = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("_last"))
    donors = answers.select((F.col("conv_id") + 1).alias("conv_id"), F.col("_last.text").alias("_answer"))
    last = answers.select("conv_id", F.col("_last.turn").alias("_turn")).join(donors, "conv_id", "left")
    replaced = F.when(
        (F.col("role") == "assistant") & (F.col("turn") == F.col("_turn")), F.coalesce("_answer", F.lit(""))
    ).otherwise(F.col("text"))
    return turns.join(last, "conv_id", "left").select("conv_id", "turn", "role", replaced.alias("text"))
