r"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are rendered as `### role`, newline, text, `</turn>`, newline.  Inside roles and texts `\`, `#`,
`<` (and a role's newline) become `\b`, `\h`, `\l` and `\n`, so no control string can occur there
and the escape is reversible by plain replacement.  Prefix sums of turn tokens (words) choose
turn-aligned windows of at most `budget` tokens: every window starts with the leading system turn
and at most `history` tokens of the turns before it, which are repeated and masked; then come new
turns while they fit, one at least.  The loss mask holds the texts of new assistant turns, so each
is trained on once.

Defined cases: a null text or role is empty; a null turn sorts first; equal turn numbers go by role
and text, and repeated rows are repeated turns; a row with a null conv_id is a conversation of its own; a turn beyond
the budget has a window to itself, without history; other columns are left behind; no rows give no
windows.  A conversation is one row of turns, as its order asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, TAIL = "### ", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def rendered(turn: Column) -> Column:
    role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(HEAD), role, F.lit("\n"), escaped(turn["text"]), F.lit(TAIL))


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, alone (tells rows without a conv_id apart), window, text, n_repeated (leading turns seen
    before), loss_spans (start and end in code points), n_tokens."""
    # a row without a conversation stands alone, whatever its number
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(alone.alias("alone"), F.col("conv_id").try_cast("long").alias("conv_id"), F.col("turn").try_cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit("[^ \\t-\\r]+")).cast("long"))
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    conv = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("i", "before", "tokens", "role", "text"))).alias("t"))
    conv = conv.withColumn("n", F.size("t")).withColumn("lead", F.when(F.col("t")[0]["role"] == "system", 1).otherwise(0))
    conv = conv.withColumn("head", F.when(F.col("lead") == 1, F.col("t")[0]["tokens"]).otherwise(F.lit(0).cast("long")))
    # windows (first new turn, first turn of the history), turns counted from 0
    start = F.struct(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("past"))).alias("all"), F.lit(0).alias("first"), F.lit(0).alias("past"))

    def step(state: Column, x: Column) -> Column:
        i = x["i"] - 1
        end = x["before"] + x["tokens"]
        over = (i > F.greatest(state["first"], F.col("lead"))) & (F.when(state["past"] > 0, F.col("head")).otherwise(F.lit(0)) + end - F.col("t")[state["past"]]["before"] > budget)
        floor = F.greatest(x["before"] - history, F.col("head") + end - budget)
        # histories only move on: the turns since the last one's start are all that may be left out
        since = F.slice(F.col("t"), state["past"] + 1, i - state["past"])
        past = F.least(i, F.greatest(F.col("lead"), state["past"] + F.size(F.filter(since, lambda y: y["before"] < floor))))
        return F.when(over, F.struct(F.array_append(state["all"], F.struct(i.alias("first"), past.alias("past"))).alias("all"), i.alias("first"), past.alias("past"))).otherwise(state)

    conv = conv.withColumn("w", F.aggregate("t", start, step, lambda s: s["all"]))

    def window(x: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("w"), k + 1)["first"], F.col("n"))
        past = F.slice(F.col("t"), x["past"] + 1, x["first"] - x["past"])
        lead = F.when(k > 0, F.slice(F.col("t"), F.lit(1), F.col("lead"))).otherwise(F.slice(F.col("t"), F.lit(1), F.lit(0)))
        return F.struct(k.alias("window"), F.concat(lead, past, F.slice(F.col("t"), x["first"] + 1, end - x["first"])).alias("t"), (F.size(lead) + F.size(past)).alias("n_repeated"))

    out = conv.select("conv_id", "alone", F.explode(F.transform("w", window)).alias("x")).select("conv_id", "alone", "x.window", "x.n_repeated", "x.t")
    out = out.withColumn("parts", F.transform("t", rendered))
    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))
    ends = F.aggregate("parts", nothing, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["ends"], s["at"] + F.length(p)).alias("ends")), lambda s: s["ends"])
    spans = F.transform(F.arrays_zip("t", "ends"), lambda x, k: F.struct((x["ends"] - len(TAIL) - F.length(escaped(x["t"]["text"]))).alias("start"), (x["ends"] - len(TAIL)).alias("end"), (k >= F.col("n_repeated")).alias("new"), (x["t"]["role"] == "assistant").alias("own")))
    out = out.withColumn("ends", ends).withColumn("spans", spans)
    kept = F.transform(F.filter("spans", lambda x: x["new"] & x["own"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return out.select("conv_id", "alone", "window", F.array_join("parts", "").alias("text"), "n_repeated", kept.alias("loss_spans"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted windows alone."""
    parts = F.split("text", TAIL)
    new = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2)
        return F.concat(unescaped(F.replace(F.substr(role, F.lit(len(HEAD) + 1)), F.lit("\\n"), F.lit("\n"))), F.lit("\n"), unescaped(body), F.lit("\n"))

    loss = F.transform("loss_spans", lambda x: unescaped(F.substr("text", x["start"] + 1, x["end"] - x["start"])))
    each = windows.select("conv_id", "alone", F.struct("window", F.array_join(F.transform(new, turn), "").alias("turns"), F.array_join(loss, "").alias("loss"), F.size(new).alias("n"), F.length("text").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns, loss = F.array_join("w.turns", ""), F.array_join("w.loss", "")
    total = lambda name: F.aggregate(f"w.{name}", F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select("conv_id", total("n").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))
