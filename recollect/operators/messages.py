"""Operators over messages (conv_id, turn, role, text), each within a conversation.

Null texts count as empty. Rows of one conversation and turn are told apart by nothing else, so turns must differ for a
defined order. Other columns are left alone where rows are returned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import est_tokens, is_blank, trimmed


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def tiers(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tier", F.when(F.col("role") == "system", "system").otherwise("conversation"))


def numbered(messages: DataFrame) -> DataFrame:
    """Non-blank conversation messages with their position from 1."""
    return messages.filter((F.col("role") != "system") & ~is_blank("text")).withColumn("pos", F.row_number().over(by_turn()).cast("long"))


def last_query(messages: DataFrame) -> DataFrame:
    """conv_id and the text of the last user message, empty without one."""
    asked = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(asked, F.lit("")).alias("query"))


def extraction_middle(messages: DataFrame) -> DataFrame:
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = messages.withColumn("_last", last).filter((F.col("role") != "system") & ~is_blank("text"))
    return rows.filter(F.col("_last").isNull() | (F.col("turn") != F.col("_last"))).drop("_last")


def counted(text: Column) -> Column:
    """Tokens of a text; a blank one has none."""
    return F.when(is_blank(text), 0).otherwise(est_tokens(text))


def prompt_tokens(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """conv_id, n_messages, prompt_tokens: texts, tool calls (a JSON string in tool_calls, if there is that column) and
    the tools offered (conv_id, tools), with what a template adds."""
    said = F.coalesce("text", F.lit(""))
    if "tool_calls" in messages.columns:
        said = F.concat(said, F.coalesce(F.concat(F.lit("\n"), F.col("tool_calls")), F.lit("")))
    sums = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(counted(said)).alias("_said"))
    offered = F.lit(0)
    if tools is not None:
        sums = sums.join(tools.select("conv_id", counted(F.col("tools")).alias("_offered")), "conv_id", "left")
        offered = F.coalesce("_offered", F.lit(0))
    return sums.select("conv_id", "n_messages", (128 + 4 * F.col("n_messages") + F.col("_said") + offered).alias("prompt_tokens"))


def gates(messages: DataFrame, n_ctx: int, trigger: float = 1.0, warm: float = 0.25) -> DataFrame:
    """Token sums of each conversation, and whether it is over the window or is to be warmed up."""
    sums = messages.groupBy("conv_id").agg(F.sum(est_tokens("text")).alias("total")).join(prompt_tokens(messages), "conv_id")
    over = F.col("total") > n_ctx * trigger
    return sums.select("conv_id", "n_messages", "total", "prompt_tokens", over.alias("over"), (~over & (F.col("total") > warm * n_ctx)).alias("warm"))


def markers(messages: DataFrame) -> DataFrame:
    """conv_id, has_calls, has_results: whether any message (role, tool_calls as a JSON string) calls a tool or is its result."""
    calls = F.col("tool_calls").isNotNull() & ~trimmed("tool_calls").isin("", "null", "[]")
    return messages.groupBy("conv_id").agg(F.max(calls).alias("has_calls"), F.max(F.col("role") == "tool").alias("has_results"))


def fits_strict_template(messages: DataFrame) -> DataFrame:
    """conv_id, fits: whether a system message is only first, and no two messages in a row have one role; order is `pos`."""
    at = Window.partitionBy("conv_id").orderBy("pos")
    rows = messages.select("conv_id", "role", F.row_number().over(at).alias("nth"), F.lag("role").over(at).alias("before"))
    wrong = ((F.col("role") == "system") & (F.col("nth") > 1)) | F.coalesce(F.col("role") == F.col("before"), F.lit(False))
    return rows.groupBy("conv_id").agg((~F.max(wrong)).alias("fits"))


def repair_ladder(messages: DataFrame, fits: Callable[[DataFrame], DataFrame] = fits_strict_template) -> DataFrame:
    """conv_id, repair, fits: the first of verbatim, convert, hoist and merge-user0 whose messages (conv_id, pos, role, text) fit;
    verbatim where none does."""
    plain = messages.select("conv_id", F.col("turn").alias("pos"), "role", "text")
    rungs = [("verbatim", plain), ("convert", convert_notes(messages).select("conv_id", F.col("turn").alias("pos"), "role", "text")), ("hoist", hoist(messages)), ("merge-user0", merge_into_user(messages))]
    tried = reduce(DataFrame.unionByName, (fits(rows).select("conv_id", "fits", F.lit(k).alias("rung"), F.lit(name).alias("name")) for k, (name, rows) in enumerate(rungs)))
    found = tried.groupBy("conv_id").agg(F.min(F.when(F.col("fits"), F.struct("rung", "name"))).alias("first"))
    return found.select("conv_id", F.coalesce("first.name", F.lit("verbatim")).alias("repair"), F.col("first").isNotNull().alias("fits"))


def _indexed(messages: DataFrame) -> DataFrame:
    talk = messages.filter("role <> 'system'")
    rows = talk.select("conv_id", (F.row_number().over(by_turn()) - 1).alias("i"), "role", est_tokens("text").alias("tokens"))
    snapped = F.coalesce(F.max(F.when(F.col("role") != "tool", F.col("i"))).over(Window.partitionBy("conv_id").orderBy("i")), F.lit(0))
    return rows.withColumn("snap", snapped)


def sliding_tail(messages: DataFrame, budget: int) -> DataFrame:
    """The first index of the tail that fits the budget; the last message is always in it, a tool result never begins it."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("i"))
    rows = _indexed(messages).withColumn("suffix", F.sum("tokens").over(after))
    found = rows.groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("suffix") <= budget, F.col("i"))), F.max("i")).alias("i"))
    return found.join(rows, ["conv_id", "i"]).select("conv_id", F.col("snap").cast("long").alias("cut"))


def stepped_tail(messages: DataFrame, budget: int, step: int) -> DataFrame:
    """Like the sliding tail, but the cut moves by whole steps of tokens only, and never back."""
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    rows = _indexed(messages).withColumn("pre", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    rows = rows.withColumn("total", F.sum("tokens").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    # The message at which each multiple of the step is first reached: those between one prefix sum and the next.
    low = F.coalesce(F.lag("pre").over(Window.partitionBy("conv_id").orderBy("i")), F.lit(-1))
    rows = rows.withColumn("k0", F.floor(low / step) + 1).withColumn("k1", F.floor(F.col("pre") / step))
    reached = rows.filter("k1 >= greatest(k0, 1)").select("conv_id", "total", "n", "snap", "pre", "i", F.explode(F.sequence(F.greatest("k0", F.lit(1)), F.col("k1"))).alias("k"))
    ends = rows.filter("i = n - 1").select("conv_id", "total", "n", "snap", "pre", F.col("n").alias("i"), (F.floor(F.col("pre") / step) + 1).alias("k"))
    tried = reached.unionByName(ends)
    cut = F.max("snap").over(Window.partitionBy("conv_id").orderBy("k"))
    prefix = rows.select("conv_id", F.col("i").alias("cut"), F.col("pre").alias("cut_pre"))
    tried = tried.withColumn("cut", cut).select("conv_id", "k", "cut", "total", "n", "i").join(prefix, ["conv_id", "cut"])
    stops = tried.filter((F.col("total") - F.col("cut_pre") <= budget) | (F.col("i") == F.col("n")))
    return stops.groupBy("conv_id").agg(F.when(F.max("total") <= budget, 0).otherwise(F.min_by("cut", "k")).cast("long").alias("cut"))


def convert_notes(messages: DataFrame) -> DataFrame:
    """System messages that do not lead become user messages with a prefix."""
    late = (F.row_number().over(by_turn()) > 1) & (F.col("role") == "system")
    rows = messages.withColumn("_late", late)
    return rows.withColumn("text", F.when(F.col("_late"), F.concat(F.lit("[system-note]\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))).withColumn("role", F.when(F.col("_late"), "user").otherwise(F.col("role"))).drop("_late")


def _system_text(messages: DataFrame) -> DataFrame:
    said = F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    return messages.filter("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(said), lambda m: m["text"]), "\n\n").alias("system"))


def hoist(messages: DataFrame) -> DataFrame:
    """conv_id, pos, role, text: one system message first, then the others in order."""
    rest = messages.filter("role <> 'system'").select("conv_id", F.row_number().over(by_turn()).cast("long").alias("pos"), "role", "text")
    return _system_text(messages).select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.col("system").alias("text")).unionByName(rest)


def merge_into_user(messages: DataFrame) -> DataFrame:
    """conv_id, pos, role, text: the system text before the first user message's, or as a user message of its own."""
    rest = messages.filter("role <> 'system'").select("conv_id", F.row_number().over(by_turn()).cast("long").alias("pos"), "role", "text")
    first = F.min(F.when(F.col("role") == "user", F.col("pos"))).over(Window.partitionBy("conv_id"))
    system = _system_text(messages)
    joined = rest.withColumn("_first", first).join(system, "conv_id", "left")
    here = (F.col("pos") == F.col("_first")) & F.col("system").isNotNull()
    told = joined.select("conv_id", "pos", "role", F.when(here, F.concat("system", F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    users = rest.filter("role = 'user'").select("conv_id").distinct()
    alone = system.join(users, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("user").alias("role"), F.col("system").alias("text"))
    return told.unionByName(alone)
