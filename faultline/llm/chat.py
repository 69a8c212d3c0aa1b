"""Chat formatting in budgeted windows, with DataFrame functions only.

Template. A turn is ``<|turn:ROLE|>\\n`` + text + ``<|end|>\\n``. In roles and texts a backslash goes before every backslash and
into every control string: its first character is followed by a backslash. Undoing it is one replacement of
backslash-plus-character by the character, so formatting is reversible whatever a text holds.

Windows. A turn's tokens are estimated as its UTF-8 bytes / ``bytes_per_token`` + ``turn_tokens`` for its markers. With prefix sums P over
a conversation's turns, its tokens are cut into shares of ``budget`` less its system turn and the history. The turns that lie within a share
are a window. A turn across the end of a share belongs to that window if all of it still fits, which it does if it reaches no further over the
end than the turn before the window reached over the beginning; else it is a window of its own. So no turn is cut, and where a window
begins depends on sums only. Each window after the first begins with the conversation's system turn (if
its first turn is one) and with as many turns before it as fit into ``history``; these repeats are never
loss targets. So no window holds more than the budget, but for a single turn that is too long by itself (or a system turn that leaves
less than a quarter of the budget), which ``over_budget`` marks. The loss mask holds the escaped text of each assistant turn in the window that owns it, as
[start, length] in code points.

A conversation's turns are ordered by a window function that spills, and are gathered by window, so what a row holds is
bounded by the budget and not by the conversation. Only the digests of ``digest`` gather whole conversations, as
a digest of all turns in order has to.

Defined results: turns are ordered by turn (nulls first), role, text. Null roles and texts are empty. A null conv_id is one
conversation. Repeated rows are turns of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control strings that a text may not show as they are, longest first where one begins another.
CONTROL = ("<|", "|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>", "<start_of_turn>", "<end_of_turn>")


@dataclass(frozen=True)
class ChatParams:
    budget: int = 2_048
    history: int = 256
    bytes_per_token: int = 4
    turn_tokens: int = 4


def escape(text):
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(conversations: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, window, n_repeated, formatted, loss_mask (array of struct start, length), n_tokens and over_budget: one row a window."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.ceil(F.octet_length("text") / p.bytes_per_token) + p.turn_tokens)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.select("*", F.row_number().over(order).alias("pos"), (F.sum("tokens").over(so_far) - F.col("tokens")).alias("before"), F.first(F.when(F.col("role") == "system", F.struct("text", "tokens"))).over(so_far).alias("system"))
    share = F.greatest(F.lit(max(1, p.budget // 4)), p.budget - p.history - F.coalesce(F.col("system.tokens"), F.lit(0)))
    turns = turns.withColumns({"size": share, "share": F.floor(F.col("before") / share)})
    over = F.col("before") + F.col("tokens") - (F.col("share") + 1) * F.col("size")  # beyond the end of its share, if positive
    # what the turn before the share's first one takes of it: the share's first turn begins that far in
    taken = F.min("before").over(Window.partitionBy("conv_id", "share")) - F.col("share") * F.col("size")
    alone = (over > 0) & (over > taken)
    turns = turns.withColumn("window", 2 * F.col("share") + F.when(alone, 1).otherwise(0))
    begins = F.coalesce(F.lag("window", 1).over(order) != F.col("window"), F.lit(False))
    turns = turns.withColumn("begins", begins)
    # a turn is history of each later window whose beginning is no further from the turn's own beginning than history allows
    ahead = Window.partitionBy("conv_id").orderBy("before").rangeBetween(1, p.history)
    later = F.collect_list(F.when(F.col("begins"), F.col("window"))).over(ahead)
    turns = turns.withColumn("later", F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.array().cast("array<bigint>")).otherwise(later))
    own = F.struct("window", F.lit(True).alias("own"), "role", "text", "pos", "tokens")
    past = F.transform("later", lambda w: F.struct(w.alias("window"), F.lit(False).alias("own"), F.col("role").alias("role"), F.col("text").alias("text"), F.col("pos").alias("pos"), F.col("tokens").alias("tokens")))
    head = F.struct("window", F.lit(False).alias("own"), F.lit("system").alias("role"), F.col("system.text").alias("text"), F.lit(0).alias("pos"), F.col("system.tokens").alias("tokens"))
    first = F.when(F.col("begins") & F.col("system").isNotNull(), F.array(head))
    none = F.expr("cast(array() as array<struct<window:bigint,own:boolean,role:string,text:string,pos:int,tokens:bigint>>)")
    rows = turns.select("conv_id", F.explode(F.concat(F.array(own), past, F.coalesce(first, none))).alias("t")).select("conv_id", "t.*")
    rows = rows.select("conv_id", "window", "own", "pos", "tokens", "role", F.concat(F.lit("<|turn:"), escape("role"), F.lit("|>\n")).alias("head"), escape("text").alias("body"))
    rows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "own", "role", "head", "body"))).alias("turns"), F.sum("tokens").alias("n_tokens"))
    mask = F.expr("""aggregate(turns, struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as mask), (a, t) -> struct(
        a.at + length(t.head) + length(t.body) + 8 as at,
        case when t.own and t.role = 'assistant' then concat(a.mask, array(struct(a.at + length(t.head) as start, length(t.body) as length))) else a.mask end as mask), a -> a.mask)""")
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit("<|end|>\n"))))
    return rows.select("conv_id", "window", F.size(F.filter("turns", lambda t: ~t.own)).alias("n_repeated"), text.alias("formatted"), mask.alias("loss_mask"), "n_tokens", (F.col("n_tokens") > p.budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (struct role, text; repeats left out) and losses (texts under the mask), both unescaped."""
    parts = F.slice(F.split("formatted", r"<\|end\|>\n"), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", r"<\|end\|>\n")) - 1 - F.col("n_repeated")))
    turns = F.transform(parts, lambda t: F.struct(unescape(F.regexp_extract(t, r"(?s)^<\|turn:(.*?)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(t, r"(?s)^<\|turn:.*?\|>\n", "")).alias("text")))
    losses = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m.start + 1, m.length)))
    return formatted.select("conv_id", "window", turns.alias("turns"), losses.alias("losses"), F.length("formatted").cast("long").alias("chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """A row a conversation, from the formatted windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    own = read_back(formatted)
    own = own.select("conv_id", F.size("turns").alias("n"), "chars", F.struct("window", F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))).alias("said")).alias("said"), F.struct("window", F.concat_ws("", "losses").alias("loss")).alias("loss"))
    own = own.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("said")).alias("said"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    loss = F.concat_ws("", F.col("loss.loss"))
    return own.select("conv_id", "n_turns", F.sha2(F.concat_ws("", F.col("said.said")), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
