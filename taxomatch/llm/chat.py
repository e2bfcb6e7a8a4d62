"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are ranked in a conversation and cut into blocks of BLOCK turns, so no
group grows with a conversation. In a block, prefix sums of turn tokens choose
turn-aligned windows: a window closes before the turn that would take its new
tokens beyond the room that the budget leaves after the system turn and the
history. Each window after the conversation's first system turn, wherever that
stands, starts with it, then repeats at most ``history_turns`` earlier turns of at most ``history`` tokens
in sum. Only assistant turns that are new in a window are under the loss mask,
so every target counts once.

Template: ``<s>role\\ntext</s>`` per turn. Inside texts and roles a backslash
goes into every control string after its bracket, and one more into what
already looks like an escaped one, so reading back is exact. A role's own
backslashes and line feeds are written as ``\\\\`` and ``\\n``.

A token is a run of letters, a digit or any other single visible character.

Defined results: null text and null role are empty; turns with equal numbers
are ordered by role and text, null numbers come first; repeated rows are
repeated turns; a null conversation id is a conversation; a turn longer than
the room is a window of its own, whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.llm.common import saved

BLOCK = 256
TOKEN = r"\p{L}+|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]"
CONTROL = r"/?(?:s>|INST\]|SYS>)"
TARGET = "assistant"
SYSTEM = "system"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)(" + CONTROL + ")", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)(" + CONTROL + ")", "$1$2$3")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    # pairs of backslashes are set aside while line feeds are put back
    parts = F.split(unescape(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def ranked(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) with the rank of each turn in its
    conversation, from 0. Rows are dealt by range, so a long conversation is
    sorted and numbered by many tasks."""
    order = ["conv", "turn", "role", "text", "_salt"]
    rows = turns.withColumn("_salt", F.monotonically_increasing_id())
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("_salt")
    rows = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("conv", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("_conv"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = rows.join(parts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_p")))
    return rows.select("conv", (F.col("_at") + F.col("_shift")).alias("rank"), "role", "text")


def _room(prefix: Column) -> Column:
    """Window number of each turn of a block, from prefix sums of its tokens:
    base is the sum before the window."""
    start = F.struct(F.lit(0).alias("window"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, upto: Column) -> Column:
        new = (upto - acc["base"] > F.col("room")) & (acc["last"] > acc["base"])
        number = acc["window"] + new.cast("int")
        return F.struct(number.alias("window"), F.when(new, acc["last"]).otherwise(acc["base"]).alias("base"), upto.alias("last"),
                        F.concat(acc["out"], F.array(number)).alias("out"))

    return F.aggregate(prefix, start, step, lambda acc: acc["out"])


def _sums(items: Column) -> Column:
    """Prefix sums of an array of long numbers, each with its own item."""
    return F.aggregate(items, F.array().cast("array<bigint>"),
                       lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")))))


def windows(turns: DataFrame, budget: int = 512, history: int = 128, history_turns: int = 8, conv: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv, first (rank of its first new turn), n_context
    (turns repeated at its start), n_new, n_tokens, text, and loss: the spans
    (start, length) of its targets in code points of the text."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = ranked(rows)
    head = F.concat(F.lit("<s>"), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).select(
        "conv", "rank", (F.col("role") == TARGET).alias("target"), (F.col("role") == SYSTEM).alias("system"),
        F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n"), F.concat("head", escape(F.col("text")), F.lit("</s>")).alias("shown"),
        F.char_length("head").alias("from"))
    rows = rows.withColumn("chars", F.char_length("shown"))
    fields = ["rank", "target", "system", "n", "from", "chars", "shown"]
    blocks = rows.groupBy("conv", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
    blocks = saved(blocks, "blocks")
    tails = blocks.select(F.col("conv").alias("_conv"), (F.col("block") + 1).alias("_block"),
                          F.expr(f"slice(turns, greatest(1, size(turns) - {history_turns - 1}), {history_turns})").alias("tail"))
    lead = rows.where("system").groupBy(F.col("conv").alias("_sconv")).agg(F.min(F.struct(*fields)).alias("lead"))  # rank is the first field
    out = blocks.join(tails, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    out = out.join(lead, F.col("conv").eqNullSafe(F.col("_sconv")), "left")
    out = out.withColumn("room", F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.coalesce(F.col("lead.n"), F.lit(0))))
    out = out.withColumn("number", _room(_sums(F.expr("transform(turns, t -> t.n)"))))
    out = out.withColumn("window", F.explode(F.sequence(F.lit(0), F.element_at("number", -1))))
    out = out.withColumn("new", F.expr("filter(turns, (t, i) -> number[i] = window)"))
    out = out.withColumn("first", F.expr("new[0].rank"))
    # earlier turns, the nearest first, as long as their tokens fit; the system turn is put in front anyway
    out = out.withColumn("before", F.expr(f"slice(reverse(filter(concat(coalesce(tail, array()), turns), t -> t.rank < first and t.rank >= first - {history_turns} and not t.rank <=> lead.rank)), 1, {history_turns})"))
    out = out.withColumn("upto", _sums(F.expr("transform(before, t -> t.n)")))
    out = out.withColumn("before", F.expr(f"reverse(filter(before, (t, i) -> upto[i] <= {history}))"))
    out = out.withColumn("before", F.expr("if(lead.rank < first, concat(array(lead), before), before)"))
    out = out.withColumn("all", F.concat("before", "new")).withColumn("ends", _sums(F.expr("transform(all, t -> cast(t.chars as bigint))")))
    return out.select(
        "conv", "first", F.size("before").alias("n_context"), F.size("new").alias("n_new"), F.expr("aggregate(all, 0L, (a, t) -> a + t.n)").alias("n_tokens"),
        F.expr("array_join(transform(all, t -> t.shown), '')").alias("text"),
        F.expr("transform(filter(sequence(size(before), size(all) - 1), i -> all[i].target), i -> "
               "named_struct('start', ends[i] - all[i].chars + all[i].from, 'length', all[i].chars - all[i].from - 4))").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with what their text says: new turns (role, text) and the
    unescaped texts under the loss mask."""
    segments = F.expr("slice(split(text, '</s>', -1), n_context + 1, n_new)")
    out = formatted.withColumn("turns", F.transform(segments, lambda s: F.struct(
        unescape_role(F.substring_index(F.substr(s, F.lit(4)), "\n", 1)).alias("role"),
        unescape(F.substr(s, F.instr(s, "\n") + 1)).alias("text"))))
    return out.withColumn("targets", F.transform("loss", lambda p: unescape(F.substr(F.col("text"), (p["start"] + 1).cast("int"), p["length"].cast("int")))))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the windows' texts."""
    back = read_back(formatted).select(
        "conv", "first", F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')").alias("said"),
        F.array_join("targets", "").alias("target"), F.size("turns").alias("n"), F.char_length("text").alias("chars"))
    out = back.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "said", "target"))).alias("w"), F.sum("n").alias("n_turns"),
                                   F.sum("chars").alias("formatted_chars"))
    out = out.withColumn("said", F.expr("array_join(transform(w, x -> x.said), '')")).withColumn("target", F.expr("array_join(transform(w, x -> x.target), '')"))
    return out.select(F.col("conv").alias(key), "n_turns", F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"), F.char_length("target").cast("long").alias("loss_chars"),
                      F.sha2(F.encode("target", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
