"""Chat formatting in token-budgeted, turn-aligned windows with a loss mask.

A conversation is cut into windows of whole turns. Every turn is new in exactly one
window; a window repeats the conversation's system turn and the last turns before
its own as history, and only the texts of its new assistant turns are under the
loss mask.

1. Prefix sums of the turns' tokens (running sums over range-partitioned slices,
   so a conversation of any length is spread over tasks) place every turn on its
   conversation's token line; the system turn, if the first turn is one, stands
   before the line's start.
2. With S tokens left for new turns (the budget less the system turn and the history
   allowance, ``LEAST`` at least), the line is cut every S tokens. The turns that
   begin between two cuts are one window; of these the last may run over the cut,
   and becomes a window of its own if all of them together exceed S. So a window's
   new turns have at most S tokens, unless one turn alone has more: no turn is
   split or cut off, such a window is marked ``over_budget``.
3. History: the turns whose tokens end before the window's first new turn and begin
   at most ``history`` tokens before it. A turn is posted to the one or few
   stretches of the line that this can reach, and joined on (conversation, stretch).
4. The system turn is posted once per ``STRETCHES`` stretches of its conversation, so
   that a long conversation has no hot key.

Texts move twice: to their windows and into them. Only DataFrame functions.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and
roles a backslash goes after the first character of every control string (``<|``,
``[INST]``, ``[/INST]``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``) and one more into strings
that look like an escaped one, so reading back takes exactly one out. In roles
backslash and newline are written ``\\b`` and ``\\n``.

Defined results: turns are taken in the order of (turn, role, text hash), nulls
first, repeated rows one after the other; null texts and roles count as empty; a
null conv_id is a conversation; a conversation of only a system turn is one window;
roles other than system and assistant are like user's, a system turn that is not
first is an ordinary turn without loss; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import read
from .running import running

BUDGET = 1024
HISTORY = 192
#: New turns get this many tokens of a window at least.
LEAST = 256
#: Stretches of the token line that one copy of a system turn serves.
STRETCHES = 4096
#: Tokens that the marks of a turn take.
MARKS = 5
START, END = "<|im_start|>", "<|im_end|>\n"
#: An opener, then backslashes, then the rest of a control string. The rests hold
#: neither openers nor backslashes, so no two matches overlap.
CONTROL = r"(\||/?s>|/?SYS>>)"
BRACKET = r"(/?INST\])"
#: Letters in pieces of up to six, digits in pieces of up to three, other marks one by one.
PIECE = "[A-Za-zÀ-ÿ]{1,6}|[0-9]{1,3}|[^\t-\r A-Za-zÀ-ÿ0-9]"


def pieces(text: Column) -> Column:
    """The tokens of a text by ``PIECE``; any other count can be given to ``windows``."""
    return F.regexp_count(text, F.lit(PIECE))


def escape(text: Column) -> Column:
    """Puts one backslash after the opener of every control string, escaped or not."""
    out = F.regexp_replace(text, r"<(\\*)(?=" + CONTROL + ")", r"<\\$1")
    return F.regexp_replace(out, r"\[(\\*)(?=" + BRACKET + ")", r"[\\$1")


def unescape(text: Column) -> Column:
    """Takes one backslash out again."""
    out = F.regexp_replace(text, r"<\\(\\*)(?=" + CONTROL + ")", "<$1")
    return F.regexp_replace(out, r"\[\\(\\*)(?=" + BRACKET + ")", "[$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _stretch(offset: Column) -> Column:
    return F.floor(offset / F.col("room"))


def plan(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """``rows`` (row, conv, turn, role, hash, n) -> every row's place: pos (from 0),
    start and stop on the token line, room (tokens for new turns), stretch and solo
    (the window's key in the conversation), first and last (positions of the
    window's new turns), from (where the window begins on the line), is_system,
    lead (the conversation's first row)."""
    one = rows.withColumn("one", F.lit(1).cast("long"))
    line = running(one, ["conv"], ["turn", "role", "hash", "row"], ["n", "one"], ["role", "n", "row"])
    system = F.col("lead.role") == "system"
    ahead = F.when(system, F.col("lead.n")).otherwise(0)
    start = F.greatest(F.col("before_n") - ahead, F.lit(0))
    placed = line.select(
        "row", "conv", "role", "lead", "n",
        F.col("before_one").alias("pos"),
        start.alias("start"),
        F.greatest(F.col("before_n") + F.col("n") - ahead, F.lit(0)).alias("stop"),
        F.greatest(F.lit(budget - history) - ahead, F.lit(LEAST)).alias("room"),
        (system & (F.col("before_one") == 0)).alias("is_system"),
        system.alias("has_system"),
    ).withColumn("stretch", _stretch(F.col("start")))
    cut = Window.partitionBy("conv", "stretch")
    begin = F.min("start").over(cut)
    runs_over = (F.col("stop") - F.col("begin") > F.col("room")) & (F.col("start") > F.col("begin"))
    solo = placed.withColumn("begin", begin).withColumn("solo", runs_over)
    window = Window.partitionBy("conv", "stretch", "solo")
    return solo.select(
        "*",
        F.min("pos").over(window).alias("first"),
        F.max("pos").over(window).alias("last"),
        F.when(F.col("solo"), F.col("start")).otherwise(F.col("begin")).alias("from"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = pieces) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) -> one row per window: conv_id,
    first_turn and last_turn (positions of its new turns, from 0), n_context (how
    many turns in front of them are repeated), n_tokens, over_budget, text, and
    loss, an array of (start, stop) in code points of the text."""
    taken = conversations.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    kept = materialize(taken.withColumn("row", F.monotonically_increasing_id()).withColumn("n", (tokens(F.col("text")) + MARKS).cast("long")), "chat-turns")
    line = materialize(plan(kept.select("row", "conv", "turn", "role", F.xxhash64("text").alias("hash"), "n"), budget, history), "chat-plan")

    new = line.select("row", "conv", "first", "pos", F.lit(True).alias("is_new"))
    # one or two windows per stretch
    heads = line.where(F.col("pos") == F.col("first"))
    reach = F.sequence(F.col("stretch"), _stretch(F.col("start") + history))
    before = line.where(~F.col("is_system")).select("row", "conv", "pos", "start", "stop", F.explode(reach).alias("at"))
    to = heads.select(F.col("conv").alias("_conv"), F.col("stretch").alias("_at"), F.col("first"), F.col("from"))
    near = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")) & (F.col("pos") < F.col("first")) & (F.col("start") + history >= F.col("from"))
    repeated = before.join(to, near).select("row", "conv", "first", "pos", F.lit(False).alias("is_new"))
    turns = kept.select(F.col("row").alias("_row"), "role", "text", "n")
    own = new.union(repeated).join(turns, F.col("row") == F.col("_row")).select("conv", "first", "pos", "is_new", "role", "text", "n")

    # the system turn, for every window but the one that it is new in
    later = heads.where(F.col("has_system") & (F.col("pos") > 0)).select(F.col("lead.row").alias("row"), "conv", "first", F.floor(F.col("stretch") / STRETCHES).alias("part"))
    parts = later.groupBy("row").agg(F.max("part").alias("parts")).select(F.col("row").alias("_row"), "parts")
    system = parts.join(turns.where(F.col("role") == "system"), "_row").select("_row", F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("_part"), "role", "text", "n")
    same = (F.col("row") == F.col("_row")) & (F.col("part") == F.col("_part"))
    lead = later.join(system, same).select("conv", "first", F.lit(0).cast("long").alias("pos"), F.lit(False).alias("is_new"), "role", "text", "n")

    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    each = own.union(lead).select(
        "conv", "first",
        F.struct("pos", "is_new", "n", (F.col("is_new") & (F.col("role") == "assistant")).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body")).alias("t"),
    )
    grouped = each.groupBy("conv", "first").agg(F.array_sort(F.collect_list("t")).alias("t"))
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")

    def mark(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.struct((stop + len(END)).alias("at"), F.when(t["learn"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    total = F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["n"])
    return grouped.select(
        F.col("conv").alias("conv_id"),
        F.col("first").alias("first_turn"),
        F.element_at("t", -1)["pos"].alias("last_turn"),
        F.size(F.filter("t", lambda t: ~t["is_new"])).alias("n_context"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        F.aggregate("t", F.struct(F.lit(0).alias("at"), none.alias("spans")), mark)["spans"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows -> the same rows with ``turns``, an array of (role, text) of their new
    turns, and ``learned``, an array of the texts under the loss mask, both taken
    from the formatted text and unescaped."""
    split = F.split("text", r"<\|im_end\|>\n")
    # the part after the last mark is empty; repeated turns come first
    own = F.slice(split, F.col("n_context") + 1, F.size(split) - 1 - F.col("n_context"))

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        text = F.substr(t, F.length(role) + 2)
        return F.struct(unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["stop"] - s["start"])))
    return formatted.withColumn("turns", F.transform(own, turn)).withColumn("learned", learned)


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    back = read_back(windows(rows.union(tricky)))
    per_window = back.select(
        "conv_id",
        F.struct(
            F.col("first_turn"),
            F.size("turns").alias("n"),
            F.length("text").alias("chars"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("learned", "").alias("learned"),
        ).alias("w"),
    )
    # a digest needs its conversation's text in one place: the query's, not the operator's, bound
    all_of = F.array_sort(F.collect_list("w"))
    told = per_window.groupBy("conv_id").agg(all_of.alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"), F.sum(F.length("w.learned")).alias("loss_chars"))
    joined = lambda name: F.sha2(F.array_join(F.transform("w", lambda w: w[name]), ""), 256)
    return told.select("conv_id", "n_turns", joined("turns").alias("turns_sha256"), "loss_chars", joined("learned").alias("loss_sha256"), "formatted_chars")
