"""Chat formatting (operator 5): preference pairs with one shared prompt and two masked completions.

All of it is DataFrame expressions. Turns of a conversation are gathered in order; the longest common prefix of the
chosen and the rejected turns is rendered once as the prompt, the rest of either as its completion. A
completion's mask lists the character ranges that assistants wrote, end marker included; only these are to be learnt.

Defined results: a null role is rendered as "user", a null text as empty; turns of equal number are ordered by role and text; a
conversation of a pair that has no turns gives an empty completion; pairs with a null conversation id on both sides are left out;
repeated pairs come back as often as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of a rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Ranges start-end of what assistants wrote, in characters of the rendered turns, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.concat_ws("-", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected: arrays of turns) as pair_id, n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    none = F.expr(f"cast(array() as array<{TURN}>)")
    sides = pairs.select("pair_id", F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b"))
    differ = F.filter(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b"))), lambda k: (k == F.least(F.size("a"), F.size("b"))) | ~_same(F.get("a", k), F.get("b", k)))
    split = sides.withColumn("n_shared", F.array_min(differ))
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.size(side))
    parts = split.select("pair_id", "n_shared", F.slice("a", F.lit(1), F.col("n_shared")).alias("p"), rest("a").alias("c"), rest("b").alias("r"))
    return parts.select("pair_id", F.col("n_shared").cast("long").alias("n_shared"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def pair_with_next(turns: DataFrame) -> DataFrame:
    """Pairs of each conversation (chosen) with itself where its last assistant turn is replaced by that of the conversation of the next id (rejected).

    Without an assistant turn of its own or of the next, the rejected side ends before the turn. No pair is left out, and each
    conversation meets one other, however many begin alike.
    """
    gathered = gather(turns)
    ours = F.array_max(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["turn"]))
    last = gathered.withColumn("last", ours)
    donor = last.where("last is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.filter("turns", lambda t: (t["role"] == "assistant") & (t["turn"] == F.col("last")))[0]["text"].alias("other"))
    joined = last.join(donor, "conv_id", "left")
    before = F.filter("turns", lambda t: F.col("last").isNull() | (t["turn"] < F.col("last")))
    swapped = F.when(F.col("last").isNotNull() & F.col("other").isNotNull(), F.concat(before, F.array(F.struct(F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))))).otherwise(before)
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))
