"""Event-sourced chat reconstruction and rendering.

Events are (conv_id, seq, message, kind, role, text). Kinds: ``message`` starts a message anew, ``delta`` appends to it,
``edit`` replaces its text, ``regenerate`` drops what was streamed so far and starts again with its text, ``delete``
removes it. The fold of one message is its texts from the last restart on, by sequence; messages stand in the order of
their first event. The fold's key is (conversation, message), so a conversation that holds a third of all rows is spread
over tasks; a message's events are one text and are bounded by it.

A rendered turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<``, any backslashes, ``|``
gets one more backslash, so no control string can begin there; roles also escape backslash and line feed. Reading back
takes one away. The loss mask is the span of an assistant's text within its rendered turn.

Null text is empty text, a null role an empty role, null kind a ``message``. Ties in sequence go by kind, role and text. An
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import small

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def escaped_role(x: Column) -> Column:
    return escaped(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(x: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", x)


def unescaped_role(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(x))


def fold(events: DataFrame, message: tuple[str, ...] = ("message",)) -> DataFrame:
    """(conv_id, at, the columns that name a message, role, text), one row for each message that is left."""
    e = events.select("conv_id", "seq", *message, F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    step = F.struct("seq", "kind", "role", "text")
    got = e.groupBy("conv_id", *message).agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min("seq").alias("at"))
    restart = F.expr("array_max(transform(steps, (x, i) -> if(x.kind in ('message', 'edit', 'regenerate', 'delete'), i, 0)))")
    live = F.slice("steps", restart + 1, F.size("steps"))
    return (
        got.withColumn("live", live)
        .filter(F.col("live")[0]["kind"] != "delete")
        .select(
            "conv_id",
            "at",
            *message,
            F.coalesce(F.expr("try_element_at(filter(steps, x -> x.role <> ''), -1).role"), F.lit("")).alias("role"),
            F.array_join(F.transform("live", lambda s: s["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, at, the other columns, formatted, loss_start, loss_end): a turn's rendering, and the masked span in it or nulls."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    learned = F.col("role") == LEARNED
    return messages.select(
        *[c for c in messages.columns if c not in ("role", "text")],
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.when(learned, F.length(head)).alias("loss_start"),
        F.when(learned, F.length(head) + F.length(body)).alias("loss_end"),
    )


COPY = ("turn", "copy")


def from_rows(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as events whose messages are named by ``COPY``; repeated rows of a turn are messages of their own.

    The copies of a turn are numbered where the fold then meets them: both are dealt by (conversation, turn), so the texts move once.
    """
    plain = conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, taken from the rendered turns alone.

    A digest runs over a conversation's turns in order, so its rendered turns meet in one task; they stream through it a
    batch at a time and only the running hash is held. Everything before this (fold, escape, render) is spread by message.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def row(x: list) -> list:
            return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]

        for batch in small(batches):
            out = []
            for conv, formatted, a, b in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = TURN.fullmatch(formatted).groups()
                now[1] += 1
                now[2].update(f"{unescaped_role(role)}\n{unescaped(text)}\n".encode())
                if a is not None:
                    loss = unescaped(formatted[a:b])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(formatted)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(DIGEST_ARROW.names, map(list, zip(*out, strict=True)), strict=True)), schema=DIGEST_ARROW)
        if now is not None:
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(DIGEST_ARROW.names, row(now), strict=True)}, schema=DIGEST_ARROW)

    names = [c for c in rendered.columns if c not in ("conv_id", "at", "formatted", "loss_start", "loss_end")]
    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "at", *names)
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGEST)
