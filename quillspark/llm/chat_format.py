"""Chat formatting in budgeted windows.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline for each turn.
Control strings inside roles and texts are broken up reversibly: the escape
character is doubled to a code first, then a code is put behind the first
character of each control string (and for the newlines of a role).

Windows hold about ``budget`` tokens. Prefix sums of the turns' tokens over a
conversation place each turn on a line; the line is cut into cells of what the
system turn and the history leave of the budget. The turns within a cell make
a span, and a turn that crosses an edge makes one of its own: spans are aligned
to turns, and only a turn longer than a cell exceeds it. Each window is the
system turn, then up to ``history`` tokens of the turns before, then its span;
the loss mask covers the texts of the span's assistant turns only, so a text is
trained on once however often it is repeated.

A conversation of any length is spread: prefix sums go over blocks of turn
numbers first, history is joined by cell, and windows are put together one by
one. Only ``digests`` reads a conversation in order, as a stream.

Defined results: null texts and roles count as empty; rows with the same turn
stand in the order of role and text, repeated rows are turns of their own, null
turns come first; rows without a conversation id form one conversation with a
null id; an empty table gives an empty result; further columns don't matter;
very long texts are kept whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

BUDGET = 1024
HISTORY = 256
BLOCK = 256
ESCAPE = "␛"
#: Control strings of common chat templates.
CONTROL = r"<(?=\|)|\|(?=>)|<(?=/?s>)|\[(?=/?INST\])|<(?=/?<?SYS>)|<(?=(?:start|end)_of_turn>)|<(?=(?:bos|eos|pad|unk|mask)>)"
_NEWLINE = ESCAPE + "2"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), f"({CONTROL})", f"$1{ESCAPE}1")


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}([012])", lambda m: {"0": ESCAPE, "1": "", "2": "\n"}[m[1]], text)


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and single other marks; a budget's measure, not a tokenizer's."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def placed(turns: DataFrame) -> DataFrame:
    """key, pos, role, text, tokens, start, end of every turn; pos counts within a conversation."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).alias("block"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", token_count(F.col("text")) + token_count(F.col("role")) + 2)
    own = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(own), "end": F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    blocks = rows.groupBy("key", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    at = rows.join(blocks, ["key", "block"])
    return at.select("key", (F.col("pos") + F.col("n0")).alias("pos"), "role", "text", "tokens", (F.col("end") + F.col("t0") - F.col("tokens")).alias("start"), (F.col("end") + F.col("t0")).alias("end"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns), loss (array of (start, end) code points), tokens.

    turns: conv_id, turn, role, text.
    """
    at = placed(turns)
    system = at.filter("pos = 1 and role = 'system'").select("key", F.col("text").alias("system"), F.col("tokens").alias("s_tokens"))
    room = F.greatest(F.lit(budget // 4), F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)))
    at = at.join(system.select("key", "s_tokens"), "key", "left").withColumn("room", room).drop("s_tokens")
    at = at.withColumn("cell", F.floor(F.col("start") / F.col("room"))).withColumn("cell_end", F.floor((F.col("end") - 1) / F.col("room")))
    spans = at.groupBy("key", "cell", "cell_end").agg(F.min("start").alias("from"))
    # turns that end before a span and begin at most ``history`` tokens before it
    past = (
        at.select("key", F.explode(F.sequence("cell_end", F.col("cell_end") + 1)).alias("cell"), "pos", "role", "text", "tokens", "start", "end")
        .join(spans, ["key", "cell"]).filter(f"end <= from and from - start <= {history} and not (pos = 1 and role = 'system')")
        .select("key", "cell", "cell_end", "pos", "role", "text", "tokens", F.lit(True).alias("again"))
    )
    head = spans.filter("from > 0").join(system, "key").select("key", "cell", "cell_end", F.lit(1).alias("pos"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("s_tokens").alias("tokens"), F.lit(True).alias("again"))
    every = at.select("key", "cell", "cell_end", "pos", "role", "text", "tokens", F.lit(False).alias("again")).unionByName(past).unionByName(head)
    parts = every.select(
        "key", "cell", "cell_end", "pos", "tokens", "again",
        F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(_NEWLINE)), F.lit(MIDDLE)).alias("lead"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("trained"),
    )
    whole = parts.groupBy("key", "cell", "cell_end").agg(F.array_sort(F.collect_list(F.struct("pos", "again", "lead", "body", "trained", "tokens"))).alias("turns"))
    piece = lambda t: F.concat(t["lead"], t["body"], F.lit(CLOSE))
    spot = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda a, t: F.struct(
            (a["at"] + F.length(piece(t))).alias("at"),
            F.when(t["again"] | ~t["trained"], a["loss"]).otherwise(
                F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(t["lead"])).alias("start"), (a["at"] + F.length(t["lead"]) + F.length(t["body"])).alias("end"))))
            ).alias("loss"),
        ),
    )
    return whole.select(
        F.when(F.col("key") != "null", F.col("key").cast("long")).alias("conv_id"), F.struct("cell", "cell_end").alias("window"),
        F.concat_ws("", F.transform("turns", piece)).alias("formatted"), F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"),
        spot["loss"].alias("loss"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digests(windows: DataFrame) -> DataFrame:
    """Reads the formatted windows back: counts and digests of each conversation.

    One stream in order for each conversation, as a digest of all its text
    needs; its state is two running hashes.
    """
    small_batches(windows.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for key, formatted, n_repeated, spans in zip(pdf["key"], pdf["formatted"], pdf["n_repeated"], pdf["loss"]):
                if key != now:
                    out += [state.row(now)] if state else []
                    now, state = key, _Digest()
                state.add(formatted, n_repeated, [(s["start"], s["end"]) for s in spans])
            yield pd.DataFrame(out, columns=_FIELDS)
        if state:
            yield pd.DataFrame([state.row(now)], columns=_FIELDS)

    keyed = windows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    ordered = keyed.repartition("key").sortWithinPartitions("key", "window").select("key", "formatted", "n_repeated", "loss")
    done = ordered.mapInPandas(read, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return done.select(F.when(F.col("key") != "null", F.col("key").cast("long")).alias("conv_id"), *_FIELDS[1:])


_FIELDS = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, n_repeated: int, spans: list[tuple[int, int]]) -> None:
        for role, text in parse(formatted)[n_repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for start, end in spans:
            text = unescape(formatted[start:end])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self, key: str) -> tuple:
        return (key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)
