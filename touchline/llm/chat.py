"""Chat formatting checked by a grammar round trip, in DataFrame operations only.

The grammar: a conversation is a row of turns; a turn is ``[INST]``, the role as URL text, a line feed, the text and
``[/INST]``, closed by ``</s>``. A body ends at its first closing, the next turn or nothing follows it, and no control string
stands in it. Every conversation is rendered plainly and parsed back by the grammar; where that is broken or the recovered turns are
not the source's, its texts are escaped, rendered and parsed again, and a difference after that is an error. Escaping puts
a backslash behind the first character of each control string, and one more where there is one already, so that
it is undone exactly.

A conversation is one row of the result by contract, and its digest runs over all turns in order, so a conversation
is held by one task; nothing larger is.

Defined cases: a null text or role is empty; turns are ordered by turn, then role and text, null turns first; repeated rows
are repeated turns; rows without an id are one conversation; an empty table gives no conversation; very long texts are kept whole;
further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, STOP = "[INST]", "[/INST]", "</s>"
#: fixed values: strings that tokenizers and templates treat as control
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


_ANY = "(?=[\\[<])(?:" + "|".join(_quoted(s) for s in CONTROL) + ")"
_HEAD, _TAIL = "([\\[<])", "(?=" + "|".join(_quoted(s[1:]) for s in sorted(CONTROL, key=len, reverse=True)) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"(\\*)" + _TAIL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"\\(\\*)" + _TAIL, "$1$2")


def rendered(turns: Column, escaped: bool) -> Column:
    """Text of an array of structs ``role``, ``text``."""
    def one(t: Column) -> Column:
        text = escape(t["text"]) if escaped else t["text"]
        return F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), text, F.lit(CLOSE + STOP))

    return F.array_join(F.transform(turns, one), "")


def parsed(formatted: Column) -> Column:
    """Turns of a text, by the grammar; a turn that breaks it has a null text, and a text that does not begin with a turn has none."""
    bodies = F.filter(F.split(formatted, _quoted(OPEN)), lambda _, i: i > 0)

    def one(b: Column) -> Column:
        at = F.instr(b, "\n")
        body = F.substring(b, at + 1, F.char_length(b))
        text = F.substring_index(body, CLOSE + STOP, 1)
        whole = (at > 0) & (F.concat(text, F.lit(CLOSE + STOP)) == body) & ~F.rlike(text, F.lit(_ANY))
        return F.struct(F.url_decode(F.substring(b, F.lit(1), at - 1)).alias("role"), F.when(whole, unescape(text)).alias("text"))

    return F.when(F.startswith(formatted, F.lit(OPEN)), F.transform(bodies, one))


def formatted(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, mask of each conversation; ``mask`` has first place and length, in code points, of each assistant text as escaped."""
    def empty(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    turns = chats.groupBy(F.col(conv_id)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")))).alias("source"))
    turns = turns.withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = turns.withColumn("plain", rendered(F.col("source"), False))
    plain = plain.withColumn("same", F.coalesce(parsed(F.col("plain")) == F.col("source"), F.lit(False)))
    both = plain.withColumn("formatted", F.when(F.col("same"), F.col("plain")).otherwise(rendered(F.col("source"), True)))
    back = F.when(F.col("same"), F.col("source")).otherwise(parsed(F.col("formatted")))
    sure = both.withColumn("formatted", F.when(back == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("the grammar does not give the turns back"))))
    return sure.select(conv_id, F.size("source").cast("long").alias("n_turns"), "formatted", masks(F.col("formatted")).alias("mask"))


def masks(text: Column) -> Column:
    """Spans of assistant texts by the grammar, from the parsed bodies."""
    bodies = F.filter(F.split(text, _quoted(OPEN)), lambda _, i: i > 0)
    sizes = F.transform(bodies, lambda b: F.struct(F.char_length(b).alias("n"), F.instr(b, "\n").alias("head"), F.startswith(b, F.lit("assistant\n")).alias("learn")))
    # a turn begins where those before it end
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + len(OPEN) + x["head"]
        span = F.struct(first.alias("start"), (x["n"] - x["head"] - len(CLOSE + STOP)).alias("length"))
        return F.struct((acc["at"] + len(OPEN) + x["n"]).alias("at"), F.when(x["learn"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step, lambda a: a["spans"])


def learned(text: str = "formatted", mask: str = "mask") -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(F.col(text), s["start"], s["length"]))), "")
