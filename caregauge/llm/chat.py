"""Conversations as training texts: windows of whole turns within a budget, with loss masks.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregauge.llm.common import written

#: Tokens that new turns of a window start within; a turn with more is alone in its window. So a
#: window's new turns have less than twice as many, unless one turn alone has more.
STRIDE = 192
#: Turns before a window that are repeated in it, and the tokens they may have.
HISTORY_TURNS, HISTORY_TOKENS = 2, 128
#: Turns of a conversation that one task sums up at a time.
CHUNK_TURNS = 64
#: Tokens that a turn's marks count for.
MARK_TOKENS = 4

# The template: a turn is OPEN, role, line end, text, line end, CLOSE. Inside roles and texts a
# backslash stands before each backslash and before "<turn" and "</turn"; in roles before line
# ends, too.
OPEN, CLOSE = "<turn>", "</turn>\n"
ROLE = r"((?:[^\\\n]++|\\.)*+)"
TURN = rf"(?s)<turn>{ROLE}\n(.*?)\n</turn>\n"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(</?turn)", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n"), escaped(text), F.lit("\n"), F.lit(CLOSE))


def tokens(text: Column) -> Column:
    """Words and single marks of a text."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def numbered(conversations: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Turns with their place ``pos`` from 1, the tokens before them ``start`` and the long turns
    before them ``long_before``.

    Turns are ordered by turn (null first), then by role and text. Sums over a conversation are
    those over chunks of its turns and those within a chunk, so that no task holds a long
    conversation.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"tokens": tokens(F.col("text")) + MARK_TOKENS, "chunk": F.floor(F.col("turn") / CHUNK_TURNS)})
    turns = turns.withColumn("long", (F.col("tokens") > stride).cast("int"))
    sums = {"turns": F.count("*"), "sum_tokens": F.sum("tokens"), "sum_long": F.sum("long")}
    chunks = turns.groupBy("conv_id", "chunk").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        F.col("conv_id").alias("of_conv"),
        F.col("chunk").alias("of_chunk"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
    )
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = turns.withColumns(
        {
            "pos": F.row_number().over(order),
            "start": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "long_before": F.coalesce(F.sum("long").over(before), F.lit(0)),
        }
    )
    same = local["conv_id"].eqNullSafe(offsets["of_conv"]) & local["chunk"].eqNullSafe(offsets["of_chunk"])
    return local.join(offsets, same).select(
        "conv_id",
        "role",
        "text",
        "tokens",
        "long",
        (F.col("pos") + F.col("turns")).alias("pos"),
        (F.col("start") + F.col("sum_tokens")).alias("start"),
        (F.col("long_before") + F.col("sum_long")).alias("long_before"),
    )


def windows(
    conversations: DataFrame,
    stride: int = STRIDE,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """Rows (conv_id, window, n_repeated, formatted, loss): a window's text, how many of its turns
    stand in an earlier window, and the spans (start, length in code points) of its new
    assistant turns.

    A turn is new in one window, that of the stride in which it starts by the prefix sum of
    tokens; ``window`` orders them. A later window begins with the conversation's first turn, if
    that is a system turn, and with up to ``history_turns`` turns before its own that have
    ``history_tokens`` tokens at most together; these are outside the mask. Turns are never cut.
    A null role or text is empty, a null conv_id a conversation, repeated rows are turns of their
    own; extra columns are left out.
    """
    turns = written(numbered(conversations, stride)).withColumn(
        "window", F.struct(F.floor(F.col("start") / stride).alias("stride"), "long_before", "long")
    )
    spans = turns.groupBy("conv_id", "window").agg(F.min("pos").alias("first_pos"), F.min("start").alias("first_start"))
    later = spans.filter("first_pos > 1")
    system = turns.filter("pos = 1 and role = 'system'").select(
        F.col("conv_id").alias("of_conv"), "role", "text", F.lit(1).cast("long").alias("pos")
    )
    repeated_system = later.join(system, later["conv_id"].eqNullSafe(system["of_conv"])).select(
        "conv_id", "window", F.lit(0).alias("kind"), "pos", "role", "text"
    )
    wanted = later.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("first_pos") - history_turns), F.col("first_pos") - 1)))
    known = turns.select(F.col("conv_id").alias("of_conv"), "pos", "role", "text", "start")
    history = (
        wanted.join(known, wanted["conv_id"].eqNullSafe(known["of_conv"]) & (wanted["at"] == known["pos"]))
        .filter((F.col("first_start") - F.col("start") <= history_tokens) & ~((F.col("pos") == 1) & (F.col("role") == "system")))
        .select("conv_id", "window", F.lit(1).alias("kind"), "pos", "role", "text")
    )
    new = turns.select("conv_id", "window", F.lit(2).alias("kind"), "pos", "role", "text")
    parts = repeated_system.unionByName(history).unionByName(new).withColumn("shown", rendered(F.col("role"), F.col("text")))
    ordered = Window.partitionBy("conv_id", "window").orderBy("pos")
    ends = F.sum(F.length("shown")).over(ordered)
    head = F.length(F.lit(OPEN)) + F.length(escaped_role(F.col("role"))) + 1
    body = F.length("shown") - head - len("\n" + CLOSE)
    placed = parts.withColumns({"at": ends - F.length("shown") + head, "size": body})
    target = (F.col("kind") == 2) & (F.col("role") == "assistant")
    grouped = placed.groupBy("conv_id", "window").agg(
        F.sum((F.col("kind") < 2).cast("int")).alias("n_repeated"),
        F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("turns"),
        F.array_sort(
            F.collect_list(F.when(target, F.struct(F.col("at").alias("start"), F.col("size").alias("length"))))
        ).alias("loss"),
    )
    return grouped.select("conv_id", "window", "n_repeated", F.array_join(F.col("turns.shown"), "").alias("formatted"), "loss")


def read_windows(formatted: DataFrame) -> DataFrame:
    """Adds to windows, from their text and mask alone: ``roles`` and ``texts`` of the new turns
    and ``targets``, the unescaped texts under the mask."""
    skip = F.col("n_repeated") + 1

    def found(group: int) -> Column:
        every = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(group))
        return F.transform(F.slice(every, skip, F.greatest(F.size(every), F.lit(1))), unescaped)

    masked = F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumns({"roles": found(1), "texts": found(2), "targets": masked})


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, hashes of its turns and of the texts under the mask,
    and the characters of its windows. The hashes take a whole conversation each."""
    end = F.lit("\n")
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, end, t, end)), "")
    each = read.select(
        "conv_id",
        F.struct("window", turns.alias("turns"), F.array_join("targets", "").alias("targets")).alias("part"),
        F.size("roles").alias("n"),
        F.length("formatted").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    targets = F.array_join(F.col("parts.targets"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("parts.turns"), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
