"""Chat formatting into budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of turn tokens choose the spans. A turn belongs to the cell of tokens in
which it starts; one that ends beyond its cell and is longer than a cell is a window
of its own. So a window's own turns hold at most two cells. Each window opens with
the conversation's first system turn and the turns just before it. These repeated
turns are contiguous: the last one always, and up to HISTORY in all while they hold
at most HISTORY * HISTORY_TOKENS tokens together. The cell is CELL tokens, or less
where the system turn leaves less of BUDGET: system turn, history and own turns fit
BUDGET together. Oversize turns are the defined exception: a turn longer than a cell is
never cut, and neither is a system turn that leaves less than LEAST_CELL for a cell;
windows that hold such a turn may exceed the budget by what it has too much.
Only a window's own assistant turns are under the loss mask; repeated ones are
masked out, so every assistant text is a target exactly once.

A turn is written <s>[INST]role[/INST]text</s>. In roles and texts a backslash
is doubled and the four control strings get a backslash after their first
character, which unescape() undoes exactly.

Prefix sums run within (conversation, block of turn numbers) and then over the
blocks' totals, so that a very long conversation is sorted in parts; the numbered
turns are written once to the checkpoint folder and read from there. Only
read_back() brings a conversation together, as its digests need: one row then holds
a conversation's formatted text, about 1.5 times its own.

Defined cases: a null role or text is empty; null turns come first; rows with
equal turn numbers are ordered by role and text and repeated rows are kept; a
null conv_id is a conversation of its own; a conversation without an assistant
has no loss text; texts of any length are kept whole. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, table

BUDGET, CELL, LEAST_CELL = 1408, 384, 64
HISTORY, HISTORY_TOKENS = 2, 128
#: Tokens that a turn's markers count for.
MARKERS = 4
BLOCK = 64
TARGET, SYSTEM = "assistant", "system"
OPEN, CLOSE, HEAD, FOOT = "[INST]", "[/INST]", "<s>", "</s>"


def escape(text):
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(?=/?(?:s>|INST\]))", r"$1\\")


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, role, text, tokens, pos, before, system): turns numbered from 0 with the tokens
    before each and those of the conversation's first system turn (0: none)."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    base = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(WORD)) + MARKERS).cast("long").alias("tokens"),
    ).withColumn("block", F.coalesce(F.expr(f"cast(floor(turn / {BLOCK}) as long)"), F.lit(-(1 << 62))))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    part = base.withColumns({"n": F.row_number().over(inside) - 1, "sum": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    opening = F.min(F.when(F.col("role") == SYSTEM, F.struct("turn", "text", "tokens")))
    totals = base.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("words"), opening["tokens"].alias("system"))
    blocks = Window.partitionBy("conv").orderBy("block")
    over, whole = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("conv", "block", F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows"), F.coalesce(F.sum("words").over(over), F.lit(0)).alias("words"), F.coalesce(F.first("system", True).over(whole), F.lit(0)).alias("system"))
    joined = part.join(starts, ["conv", "block"])
    return joined.select("conv", "conv_id", "role", "text", "tokens", (F.col("n") + F.col("rows")).alias("pos"), (F.col("sum") + F.col("words")).alias("before"), "system")


def cells(system, cell: int, history: int, history_tokens: int, budget: int):
    """Tokens of a cell: system turn, history of up to a cell or its own bound, and two cells fit the budget."""
    fitting = F.least(F.lit(cell), F.floor((budget - system) / 3), F.floor((budget - history * history_tokens - system) / 2))
    return F.greatest(F.lit(min(cell, LEAST_CELL)), fitting).cast("long")


def windows(rows: DataFrame, cell: int = CELL, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, budget: int = BUDGET) -> DataFrame:
    """(conv, conv_id, window, n_context, n_turns, tokens, formatted, loss).

    formatted: the window's text. n_context: its leading repeated turns. loss:
    (start, length) spans of code points, from 1, that are targets."""
    sized = turns(rows).withColumn("cell", cells(F.col("system"), cell, history, history_tokens, budget))
    alone = (F.col("tokens") > F.col("cell")) & (F.col("before") % F.col("cell") + F.col("tokens") > F.col("cell"))
    numbered = sized.withColumn("window", F.expr("2 * (before div cell)") + alone.cast("long"))
    head = F.concat(F.lit(HEAD + OPEN), escape(F.col("role")), F.lit(CLOSE))
    written = checkpoint(numbered.select("conv", "conv_id", "role", "tokens", "pos", "before", "window", head.alias("head"), escape(F.col("text")).alias("body")))
    part = lambda kind: F.struct(F.lit(kind).alias("kind"), "pos", "head", "body", "tokens", (F.lit(kind == 2) & (F.col("role") == TARGET)).alias("target"))
    own = written.select("conv", "conv_id", "window", part(2).alias("part"))
    firsts = written.groupBy("conv", "window").agg(F.min("pos").alias("first_pos"), F.min("before").alias("start"))
    # A turn repeats in every window that starts 1 to HISTORY turns after it; windows between them own turns, so there may be several.
    ahead = firsts.select("conv", F.col("window").alias("later"), "first_pos", "start", F.explode(F.expr(f"sequence(first_pos - {history}, first_pos - 1)") if history else F.array().cast("array<long>")).alias("pos"))
    systems = written.where(F.col("role") == SYSTEM).groupBy("conv").agg(F.min_by(F.struct("conv_id", "pos", "head", "body", "tokens", "role"), "pos").alias("s"))
    fits = (F.col("pos") == F.col("first_pos") - 1) | (F.col("start") - F.col("before") <= history * history_tokens)
    again = written.join(ahead, ["conv", "pos"]).where(fits).select("conv", "conv_id", F.col("later").alias("window"), part(1).alias("part"))
    kept = firsts.join(systems, "conv").where(F.col("first_pos") > F.col("s.pos")).select("conv", "window", "s.*").select("conv", "conv_id", "window", part(0).alias("part"))
    grouped = own.unionByName(again).unionByName(kept).groupBy("conv", "window").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("part")).alias("found"))
    opening = F.col("found")[0]  # a retained system turn isn't repeated once more as history
    grouped = grouped.withColumn("parts", F.filter("found", lambda p: ~((opening["kind"] == 0) & (p["kind"] == 1) & (p["pos"] == opening["pos"]))))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(FOOT))
    nothing = F.array().cast("array<struct<start:long,length:long>>")
    walk = F.aggregate(
        "parts",
        F.struct(F.lit(1).cast("long").alias("at"), nothing.alias("loss")),
        lambda a, p: F.struct(
            (a["at"] + F.length(whole(p))).alias("at"),
            F.when(p["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return grouped.select(
        "conv",
        "conv_id",
        "window",
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_context"),
        F.size("parts").alias("n_turns"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
        F.array_join(F.transform("parts", whole), "").alias("formatted"),
        walk.alias("loss"),
    )


def read_back(found: DataFrame) -> DataFrame:
    """Each conversation as its windows' text and loss mask give it: turns are
    parsed from the formatted text, targets cut out by the mask."""
    pieces = F.split(F.col("formatted"), FOOT, -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    head = len(HEAD + OPEN)
    role = lambda t: unescape(F.substring_index(F.substr(t, F.lit(head + 1)), CLOSE, 1))
    text = lambda t: unescape(F.substr(t, F.lit(head + len(CLOSE) + 1) + F.length(F.substring_index(F.substr(t, F.lit(head + 1)), CLOSE, 1))))
    parsed = found.select(
        "conv",
        "conv_id",
        F.size(new).alias("n"),
        F.length("formatted").alias("chars"),
        F.struct(
            "window",
            F.array_join(F.transform(new, lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "").alias("turns"),
            F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int"), s["length"].cast("int")))), "").alias("loss"),
        ).alias("w"),
    )
    whole = parsed.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("ws", lambda w: w["turns"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spoken = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(spoken).alias("text"))
    return read_back(windows(rows.union(extra)))
