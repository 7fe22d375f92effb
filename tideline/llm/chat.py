"""Chat formatting in budgeted windows.

Turns are rendered, counted in tokens of a public vocabulary, and prefix sums of the counts choose the spans: the token axis of a
conversation is divided into cells of the room that a window has; the turns inside a cell are a span, a turn across a
border is a span, and it is joined with the turns after it when both fit. Every choice needs only the turn's own prefix sum and
its cell, so a conversation of any length is formatted by many tasks.

Each window repeats the system turn and a limited history of the turns before it; repeated turns are never loss targets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpointed, load, tokenizer, vocabulary

OPEN, CLOSE = "### ", "</turn>\n"
#: No control string survives in an escaped text: a backslash goes before a backslash, the third # of a run and the / of a close.
_ESCAPE = re.compile(r"\\|(?<=##)#|(?<=<)/(?=turn>)")
_PLAIN = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)
WINDOWS = "conv_id long, window long, n_context int, text string, loss array<struct<start: int, end: int>>, tokens long, over_budget boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{CLOSE}"


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, roles and texts unescaped."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def _rendered(path: str):
    @F.pandas_udf("shown string, tokens long")
    def run(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        shown = [render(r, t) for r, t in zip(role, text, strict=True)]
        counts = [len(x.ids) for x in tokenizer(path).encode_batch(shown, add_special_tokens=False)] if shown else []
        return pd.DataFrame({"shown": shown, "tokens": pd.Series(counts, dtype="int64")})

    return run


def _assembled(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for conv_id, window, turns in zip(pdf.conv_id, pdf.window, pdf.turns, strict=True):
            at, context, tokens, parts, loss = 0, 0, 0, [], []
            for t in turns:
                body = t["shown"]
                if t["own"] and t["target"]:
                    start = at + body.index(": ", len(OPEN)) + 2
                    loss.append({"start": start, "end": at + len(body) - len(CLOSE)})
                context += not t["own"]
                tokens += t["tokens"]
                at += len(body)
                parts.append(body)
            rows.append((conv_id, window, context, "".join(parts), loss, tokens, tokens > budget))
        out = pd.DataFrame(rows, columns=["conv_id", "window", "n_context", "text", "loss", "tokens", "over_budget"])
        yield out.astype({"conv_id": "Int64", "window": "int64", "n_context": "int32", "tokens": "int64"})


def format_conversations(conversations: DataFrame, budget: int = 1024, history: int = 256, block: int = 256, path: str | None = None) -> DataFrame:
    """Windows of at most `budget` tokens: the system turn, up to `history` tokens of earlier turns, then the new turns.

    Needs conv_id, turn, role, text; other columns are not read. Null texts and roles are empty; rows with a null conv_id
    are one conversation; turns with a null number come first; equal turn numbers are ordered by role and text, repeated
    rows stay. Only the first turn can be the system turn. A turn is never cut: one that alone exceeds the room
    gets a window of its own, marked over_budget. An empty table gives no windows.
    `loss` holds the places of the assistant texts (still escaped) in `text`. `block`: turn numbers per prefix-sum block.
    """
    if not 0 <= history < budget:
        raise ValueError("0 <= history < budget is needed")
    given = conversations.select("conv_id", F.coalesce("conv_id", F.lit(0)).alias("k"), F.col("conv_id").isNull().alias("nul"), "turn",
                                 F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = ["k", "nul"]
    shown = _rendered(path or vocabulary("byte_bpe_50k.json"))
    rows = given.withColumn("x", shown("role", "text")).select(
        *given.columns, "x.shown", "x.tokens", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).alias("blk")
    )
    # counted once: the parts below all read these rows
    rows = checkpointed(rows)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy(*conv, "blk").orderBy(*order)
    rows = rows.select("*", (F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("near"),
                       F.row_number().over(inside).alias("nth")).drop("turn", "text")
    blocks = rows.groupBy(*conv, "blk").agg(F.sum("tokens").alias("all"), F.min_by(F.struct("role", "shown", "tokens"), "nth").alias("first"))
    across = Window.partitionBy(*conv).orderBy("blk")
    blocks = blocks.select(
        *conv, "blk", (F.sum("all").over(across) - F.col("all")).alias("before"), F.first("first").over(across).alias("head"), F.row_number().over(across).alias("bth")
    )
    blocks = blocks.withColumn("sys", F.when(F.col("head.role") == "system", F.col("head"))).drop("head")
    rows = rows.join(blocks, [*conv, "blk"])
    # the system turn takes no place on the token axis
    fixed = F.coalesce(F.col("sys.tokens"), F.lit(0))
    is_sys = F.col("sys").isNotNull() & (F.col("bth") == 1) & (F.col("nth") == 1)
    rows = rows.select(
        "*", is_sys.alias("is_sys"), F.when(is_sys, F.lit(0)).otherwise(F.col("before") + F.col("near") - fixed).alias("p0"),
        F.greatest(F.lit(1), F.lit(budget - history) - fixed).alias("room"),
    )
    rows = rows.withColumn("p1", F.when(F.col("is_sys"), F.lit(1)).otherwise(F.col("p0") + F.col("tokens")))
    rows = rows.withColumn("cell", F.expr("(p1 - 1) div room")).withColumn("over", F.expr("p0 div room <> (p1 - 1) div room"))
    same = Window.partitionBy(*conv, "cell")
    weight = F.when(F.col("is_sys"), F.lit(0)).otherwise(F.col("tokens"))
    rows = rows.withColumn("merge", F.max("over").over(same) & (F.sum(weight).over(same) <= F.col("room")))
    rows = rows.withColumn("window", F.expr("2 * cell - IF(over OR merge, 1, 0)"))
    own = Window.partitionBy(*conv, "window")
    spare = F.greatest(F.lit(0), F.lit(budget) - fixed - F.sum(weight).over(own))
    rows = rows.withColumn("w0", F.min("p0").over(own)).withColumn("past", F.least(F.lit(history), spare))
    turn = lambda place, own, target: F.struct(place.alias("at"), F.col("nth").cast("long").alias("nth"), "shown", "tokens", F.lit(own).alias("own"), target.alias("target"))
    ordinal = F.when(F.col("is_sys"), F.lit(-1)).otherwise(F.col("p0"))
    parts = [rows.select("conv_id", *conv, "window", turn(ordinal, True, (F.col("role") == "assistant") & ~F.col("is_sys")).alias("t"))]
    starts = rows.select("conv_id", *conv, "window", "w0", "sys").where(F.col("sys").isNotNull() & (F.col("window") > 0)).distinct()
    parts.append(starts.select("conv_id", *conv, "window", F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("nth"), F.col("sys.shown"), F.col("sys.tokens"), F.lit(False).alias("own"), F.lit(False).alias("target")).alias("t")))
    if history:
        # earlier turns that lie wholly in the last tokens before a window, as many as it has left
        heads = rows.select(*conv, "window", "w0", "past").distinct().withColumn("cell", F.expr(f"w0 div {history}"))
        tails = rows.where(~F.col("is_sys") & (F.col("tokens") <= history)).withColumn("cell", F.explode(F.expr(f"sequence(p1 div {history}, (p0 + {history}) div {history})")))
        tails = tails.select("conv_id", *conv, "cell", "nth", "shown", "tokens", "p0", "p1")
        both = tails.join(heads, [*conv, "cell"]).where("w0 >= p1 AND w0 - p0 <= past")
        parts.append(both.select("conv_id", *conv, "window", turn(F.col("p0"), False, F.lit(False)).alias("t")))
    turns = parts[0]
    for more in parts[1:]:
        turns = turns.union(more)
    windows = turns.groupBy(*conv, "window").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"), F.sort_array(F.collect_list("t")).alias("turns"))
    return windows.select("conv_id", "window", "turns").mapInPandas(lambda b: _assembled(b, budget), WINDOWS)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams over windows sorted by conversation; holds one window and two running digests."""
    none = object()
    now, state, done = none, None, []

    def closed():
        n, turns, chars, loss, shown = state
        return (None if now is none or pd.isna(now) else int(now), n, turns.hexdigest(), chars, loss.hexdigest(), shown)

    for pdf in batches:
        for conv_id, context, text, spans in zip(pdf.conv_id, pdf.n_context, pdf.text, pdf.loss, strict=True):
            if state is None or not (conv_id == now or pd.isna(conv_id) and pd.isna(now)):
                if state is not None:
                    done.append(closed())
                now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text)[context:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in spans:
                body = unescape(text[span["start"] : span["end"]])
                state[2] += len(body)
                state[3].update(body.encode())
            state[4] += len(text)
        yield _digest_frame(done)
        done = []
    yield _digest_frame([closed()] if state is not None else [])


def _digest_frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted windows: its turns, the text under the loss mask, and their digests."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "n_context", "text", "loss")
    return dealt.mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1(spark, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversation_digests(format_conversations(given.unionByName(extra)))
