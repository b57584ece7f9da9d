"""Preference formatting in DataFrame functions alone.

A pair names a chosen and a rejected conversation. Their turns are compared place
by place; the longest common prefix (equal role and text) is rendered once as the
prompt, and what follows on either side becomes a completion with a mask: the
spans of code points, counted from the completion's start, on which a model is
trained - the texts of assistant turns and the mark that ends them.

Turns stay rows until the end: the first place where two conversations differ is a
minimum per pair, and only then the turns of one conversation are put in order
and joined to a string, which is the output value itself.

Rows: turns are ordered by turn, null first, then by role and text, and numbered, so
ties and gaps do not matter; repeated rows are repeated turns. A null role is written
"none", a null text is empty. A pair whose conversations are equal has two empty
completions and the status "equal"; one that is a prefix of the other has one
empty completion and the status "prefix"; else the status is "pair". A pair that names
an unknown or null conversation is not emitted. Repeated pairs are emitted as often. Turns
without a conversation id belong to none.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common

#: Marks of the chat format.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
#: Ids that a task orders at once.
CHUNK = 65_536


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, role, text): turns numbered from 0 within their conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("none")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    return turns.withColumn("place", place.cast("int")).drop("turn")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def _completion(turns: Column) -> tuple[Column, Column]:
    """Text and mask spans of an ordered array of (place, role, text)."""
    whole = F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")
    none = F.array().cast("array<struct<s: int, e: int>>")

    def add(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.length(t["role"]) + len(START) + len(MIDDLE)
        end = head + F.length(t["text"]) + len(END)
        span = F.array(F.struct(head.alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
    mask = F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return whole, mask


def format_pairs(turns: DataFrame, pairs: DataFrame, rejected_turns: DataFrame | None = None) -> DataFrame:
    """turns (conv, place, role, text) and pairs (pair_id, chosen, rejected) to one row per pair.

    ``rejected_turns`` holds the rejected sides where they are no conversations of ``turns``; the ids of the
    two tables are then independent. Columns: pair_id, chosen, rejected, status, n_prefix, prompt,
    chosen_text, chosen_mask, rejected_text, rejected_mask.
    """
    sides = {"chosen": turns, "rejected": turns if rejected_turns is None else rejected_turns}
    known = lambda name: sides[name].groupBy(F.col("conv").alias(name)).agg(F.count("*").cast("int").alias(f"n_{name}"))
    both = pairs.select("chosen", "rejected").distinct().join(known("chosen"), "chosen").join(known("rejected"), "rejected")
    key = ["chosen", "rejected"]
    # One row for each side and turn; a place differs unless two equal turns meet there.
    side = lambda name: both.select(*key, F.col(name).alias("conv"), F.lit(name).alias("side")).join(
        sides[name].select("conv", "place", "role", "text"), "conv")
    rows = common.checkpointed(side("chosen").unionByName(side("rejected")))  # read for the cut and for the texts
    turn = F.struct("role", "text")
    places = rows.groupBy(*key, "place").agg(F.count("*").alias("sides"), F.min(turn).alias("a"), F.max(turn).alias("b"))
    first = places.groupBy(*key).agg(F.min(F.when((F.col("sides") < 2) | (F.col("a") != F.col("b")), F.col("place"))).alias("cut"))
    cuts = both.join(first, key).select(*key, F.coalesce("cut", "n_chosen").alias("n_prefix"))
    turn = F.struct("place", "role", "text")

    def gathered(test: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(test, turn)))
    after = F.col("place") >= F.col("n_prefix")
    done = (rows.join(cuts, key).where((F.col("side") == "chosen") | after)  # the prompt is read from one side alone
            .groupBy(*key, "n_prefix").agg(gathered(~after).alias("prompt_turns"),
                                           gathered(after & (F.col("side") == "chosen")).alias("chosen_turns"),
                                           gathered(after & (F.col("side") == "rejected")).alias("rejected_turns")))
    chosen, chosen_mask = _completion(F.col("chosen_turns"))
    rejected, rejected_mask = _completion(F.col("rejected_turns"))
    empty = (F.size("chosen_turns") == 0).cast("int") + (F.size("rejected_turns") == 0).cast("int")
    status = F.when(empty == 2, "equal").when(empty == 1, "prefix").otherwise("pair")
    return (pairs.select("pair_id", *key).join(done, key)
            .select("pair_id", *key, status.alias("status"), "n_prefix",
                    _completion(F.col("prompt_turns"))[0].alias("prompt"), chosen.alias("chosen_text"), chosen_mask.alias("chosen_mask"),
                    rejected.alias("rejected_text"), rejected_mask.alias("rejected_mask")))


def following(rows: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the ``value`` of the next row of the group by the integer ``order`` (unique in it), null for the last one.

    Rows are ordered in chunks of ``CHUNK`` ids; the last of a chunk takes the first value of the next chunk, so neither
    the table nor a hot group is ever ordered in one task.
    """
    rows = rows.withColumn("chunk", F.expr(f"floor({order} / {CHUNK})"))
    inside = F.lead(value).over(Window.partitionBy(*group, "chunk").orderBy(order))
    firsts = rows.groupBy(*group, "chunk").agg(F.min_by(value, order).alias("first"))
    after = F.lead("first").over(Window.partitionBy(*group).orderBy("chunk"))
    heads = firsts.withColumn("after", after).drop("first")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*group, "chunk"]]
    return (rows.withColumn(name, inside).alias("r").join(heads.alias("h"), same)
            .select(*(f"r.{c}" for c in rows.columns if c != "chunk"), F.coalesce(f"r.{name}", "h.after").alias(name)))


def rejected_sides(turns: DataFrame) -> DataFrame:
    """(conv, place, role, text): a rejected side for every conversation of a table of plain ones.

    A conversation that opens like another one (role and text of its first turn) is paired with the next such
    conversation by id. Any other one is paired with itself, its last answer replaced by that of the next
    conversation which has one (after the last comes the first); turns after the answer stay. Where it has no
    answer, the other one's answer is added at its end. Without another answer the side equals the conversation.
    """
    turns = common.checkpointed(turns)
    opening = [F.xxhash64(F.lit(n), "role", "text").alias(f"o{n}") for n in (1, 2)]
    opened = turns.where("place = 0").select("conv", *opening)
    siblings = following(opened, ["o1", "o2"], "conv", "conv", "sibling").where("sibling is not null").select("conv", "sibling")
    siblings = common.checkpointed(siblings)
    real = siblings.join(turns.withColumnRenamed("conv", "sibling"), "sibling").select("conv", "place", "role", "text")
    answers = turns.where(F.col("role") == TRAINED).groupBy("conv").agg(
        F.max("place").alias("last"), F.max_by("text", "place").alias("answer"))
    ends = turns.groupBy("conv").agg(F.count("*").cast("int").alias("n")).join(answers, "conv", "left")
    # Every conversation's donor is the next one with an answer: the first of the next ones by id.
    ends = common.checkpointed(ends)
    start = F.lit(ends.where("answer is not null").agg(F.min_by("answer", "conv")).first()[0]).cast("string")
    donors = _next_answer(ends).select("conv", "n", "last", F.coalesce("other", start).alias("other"))
    alone = common.checkpointed(donors.join(siblings.select("conv"), "conv", "left_anti"))
    told = turns.join(alone, "conv")
    swapped = told.select("conv", "place", "role", F.when(F.col("place") == F.col("last"), F.coalesce("other", "text")).otherwise(F.col("text")).alias("text"))
    added = alone.where("last is null and other is not null").select("conv", F.col("n").alias("place"), F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    return common.checkpointed(real.unionByName(swapped).unionByName(added))


def _next_answer(ends: DataFrame) -> DataFrame:
    """(.., other): the answer of the next conversation by id that has one, null after the last such."""
    rows = ends.withColumn("chunk", F.expr(f"floor(conv / {CHUNK})"))
    # From the last id down, so that a window only grows: the latest answer seen is that of the next conversation.
    later = Window.partitionBy("chunk").orderBy(F.desc("conv")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("chunk").agg(F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("conv"))).alias("first"))
    after = F.last("first", ignorenulls=True).over(Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))
    heads = firsts.withColumn("after", after).drop("first")
    return (rows.withColumn("inside", F.last("answer", ignorenulls=True).over(later)).join(heads, "chunk")
            .withColumn("other", F.coalesce("inside", "after")).drop("chunk", "inside", "after"))
