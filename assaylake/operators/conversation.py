"""Outcomes of conversations: where they first err, and how errors spread along dependences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numbers import to_float
from assaylake.functions.text import program_operands

#: How near an operand and an answer are, relative to the answer or to 1, where that is more.
TOLERANCE = 1e-4


def _cell(x: Column) -> Column:
    """The cell of a number on a grid that is linear up to 1 and logarithmic beyond, so wide that near numbers lie in one cell or in
    neighbours: the scale changes by at most ``TOLERANCE / (1 - TOLERANCE)`` between them."""
    size = F.abs(x)
    return F.floor(F.signum(x) * F.when(size <= 1, size).otherwise(1 + F.ln(size)) / (1.01 * TOLERANCE))


def turn_sources(turns: DataFrame) -> DataFrame:
    """Each turn with ``sources``, the earlier turns of its conversation whose answer its program uses, in order; an empty array if none.

    An operand uses an answer within ``TOLERANCE`` of it. Both meet on a grid, the operand in three cells and the answer in one, so a
    conversation costs what its operands, answers and matches are, not their product; its turns are spread by cell. Rows of one turn
    count together. Answers that are no finite number, and rows with a null conversation or turn, take no part.

    :param turns: ``conv_id``, ``turn``, ``program``, ``answer`` (text).
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    known = turns.dropna(subset=["conv_id", "turn"])
    used = known.select("conv_id", "turn", F.explode(F.array_distinct(program_operands(F.coalesce("program", F.lit(""))))).alias("operand")).where(finite(F.col("operand"))).distinct()
    asked = used.select("*", F.explode(F.array(*(_cell(F.col("operand")) + d for d in (-1, 0, 1)))).alias("cell"))
    said = known.select("conv_id", F.col("turn").alias("source"), to_float(F.col("answer")).alias("value")).where(finite(F.col("value"))).distinct().withColumn("cell", _cell(F.col("value")))
    near = F.abs(F.col("operand") - F.col("value")) <= TOLERANCE * F.greatest(F.abs("value"), F.lit(1.0))
    met = asked.join(said, ["conv_id", "cell"]).where((F.col("source") < F.col("turn")) & near)
    found = met.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    empty = F.array().cast(found.schema["sources"].dataType)
    return known.select("conv_id", "turn").distinct().join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("sources", empty).alias("sources"))


def dependence(turns: DataFrame) -> DataFrame:
    """The dependent turns whose sources are all known, with ``clean``: all sources were right.

    :param turns: ``conv_id``, ``turn``, ``passed`` (null counts as wrong), ``sources`` (array of turns).
    """
    t = turns.withColumn("ok", F.coalesce("passed", F.lit(False)))
    asked = t.where(F.size("sources") > 0).select("conv_id", "turn", "ok", F.size("sources").alias("n_sources"), F.explode("sources").alias("source"))
    before = t.select(F.col("conv_id").alias("c"), F.col("turn").alias("source_turn"), F.col("ok").alias("source_ok"))
    joined = asked.join(before, (F.col("conv_id") == F.col("c")) & (F.col("source") == F.col("source_turn")))
    out = joined.groupBy("conv_id", "turn", "ok", "n_sources").agg(F.count("*").alias("n_known"), F.bool_and("source_ok").alias("clean"))
    return out.where("n_known = n_sources").select("conv_id", "turn", "ok", "clean")


def analyse(turns: DataFrame) -> DataFrame:
    """One row of figures over all conversations; a figure without anything to count is null."""
    t = turns.withColumn("ok", F.coalesce("passed", F.lit(False)))
    ok = F.col("ok").cast("double")
    dependent = F.size("sources") > 0
    whole = t.agg(F.count("*").alias("n_turns"), F.avg(ok).alias("turn_accuracy"), F.count_if(dependent).alias("n_dependent_turns"), F.avg(F.when(dependent, ok)).alias("dependent_turn_accuracy"), F.avg(F.when(~dependent, ok)).alias("independent_turn_accuracy"))
    by_conv = t.groupBy("conv_id").agg(F.bool_and("ok").cast("double").alias("all_ok"), F.min(F.when(~F.col("ok"), F.col("turn"))).alias("first_error"))
    convs = by_conv.agg(F.count("*").alias("n_conversations"), F.avg("all_ok").alias("full_conversation_accuracy"), F.avg("first_error").alias("mean_first_error_turn"))
    chain = dependence(turns).agg(F.avg(F.when(F.col("clean"), ok)).alias("accuracy_given_clean_inputs"), F.avg(F.when(~F.col("clean"), ok)).alias("accuracy_given_poisoned_inputs"), F.count_if(~F.col("clean")).alias("n_poisoned_turns"))
    one = whole.crossJoin(convs).crossJoin(chain)  # of single rows
    return one.select(
        "*", (F.col("independent_turn_accuracy") - F.col("dependent_turn_accuracy")).alias("context_loss"),
        (F.col("accuracy_given_clean_inputs") - F.col("accuracy_given_poisoned_inputs")).alias("propagation_effect"), F.col("accuracy_given_poisoned_inputs").alias("recovery_rate"),
    )


def accuracy_by_turn(turns: DataFrame) -> DataFrame:
    return turns.groupBy("turn").agg(F.count("*").alias("n"), F.avg(F.coalesce("passed", F.lit(False)).cast("double")).alias("accuracy"))


def with_model_history(turns: DataFrame) -> DataFrame:
    """Each turn with ``history``: the questions before it and the model's own answers to them, in order.

    The turns of a conversation are listed once; each takes its part of the list.
    """
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.coalesce("model_answer", F.lit("")).alias("content")))
    row = F.struct(*turns.columns)
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row"), said.alias("said")))).alias("all"))  # one conversation
    each = listed.select(F.posexplode("all").alias("place", "at"), F.flatten(F.transform("all", lambda x: x["said"])).alias("said"))
    return each.select("at.row.*", F.slice("said", 1, 2 * F.col("place")).alias("history"))
