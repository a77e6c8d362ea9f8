"""Chat formatting whose output a deterministic parser turns back into the source turns.

Each turn is rendered between an opening and a closing mark and parsed at once; if the parse does not give
the same role and text, the text's control strings are escaped, by a backslash after their first
character (one more where backslashes already stand there), which the parser takes away again. A turn ends
at the first closing mark of its kind, so turns that parse alone also parse in sequence. Only rendered
turns move; a conversation is read in order as a stream, so its length is not limited by memory.

Edge cases: null text or role is empty; turns sort by turn number, nulls first, ties by role and text;
repeated rows are turns of their own; a null conversation id is one conversation; other columns are not
read; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import shuffle_partitions, small_batches

#: Opening and closing mark of a role; any other role stands inside NAMED.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", "</s>"), "system": ("[SYS] ", " [/SYS]")}
NAMED, NAME_END = ("[TURN] ", " [/TURN]"), "[|] "
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]", "[|]"]
_ESCAPE = re.compile("(" + "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL) + ")")
_UNESCAPE = re.compile("(" + "|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROL) + ")")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1][0], text)


def render_turn(role: str, text: str) -> str:
    if role in MARKS:
        return text.join(MARKS[role])
    return f"{NAMED[0]}{role}{NAME_END}{text}{NAMED[1]}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start:end is the text's place, escapes included."""
    turns, at = [], 0
    marks = [*MARKS.items(), (None, NAMED)]
    while at < len(formatted):
        role, (opening, closing) = next(((r, m) for r, m in marks if formatted.startswith(m[0], at)), (None, (None, None)))
        if opening is None:
            raise ValueError(f"no turn opens at {at}")
        start = at + len(opening)
        if role is None:
            end = formatted.find(NAME_END, start)
            if end < 0:
                raise ValueError(f"role without end at {at}")
            role, start = unescape(formatted[start:end]), end + len(NAME_END)
        end = formatted.find(closing, start)
        if end < 0:
            raise ValueError(f"turn without end at {at}")
        turns.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(closing)
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered, start, end) of a turn that parses back to role and text."""
    for some_role, some_text in ((role, text), (role, escape(text)), (role if role in MARKS else escape(role), escape(text))):
        out = render_turn(some_role, some_text)
        try:
            turns = parse(out)
        except ValueError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return out, turns[0][2], turns[0][3]
    raise AssertionError("an escaped turn did not parse back")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_end): a conversation's output is its turns'
    formatted strings in order; the loss mask covers loss_start:loss_end of an assistant turn."""
    small_batches(rows.sparkSession, 500)

    def scan(batches):
        for batch in batches:
            conv, turn, role, text = (batch.column(i) for i in range(4))
            made = [format_turn(r, t) for r, t in zip(role.to_pylist(), text.to_pylist())]
            loss = [(s, e) if r == "assistant" else (0, 0) for r, (_, s, e) in zip(role.to_pylist(), made)]
            yield pa.record_batch({"conv_id": conv, "turn": turn, "role": role, "text": text, "formatted": pa.array([m[0] for m in made], pa.string()), "loss_start": pa.array([x[0] for x in loss], pa.int64()), "loss_end": pa.array([x[1] for x in loss], pa.int64())})

    own = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(scan, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def _in_order(formatted: DataFrame) -> DataFrame:
    """Rows of format_conversations(), each conversation in one partition and in its order."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions(*order)


def joined(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): each conversation as one text, and the ranges of code points that its loss covers.
    A conversation is one row here; read_back() needs no such row."""

    def scan(batches):
        current, texts, mask, at = None, [], [], 0

        def row():
            return pa.record_batch({"conv_id": pa.array([current[0]], pa.int64()), "formatted": pa.array(["".join(texts)], pa.string()), "loss_mask": pa.array([mask], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

        for batch in batches:
            for conv, out, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current != [conv]:
                    if current is not None:
                        yield row()
                    current, texts, mask, at = [conv], [], [], 0
                texts.append(out)
                if end:
                    mask.append({"start": at + start, "end": at + end})
                at += len(out)
        if current is not None:
            yield row()

    rows = _in_order(formatted).select("conv_id", "formatted", "loss_start", "loss_end")
    return rows.mapInArrow(scan, "conv_id long, formatted string, loss_mask array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation of what its output says when it is parsed."""

    def scan(batches):
        current = state = None

        def row():
            turns, n, loss, loss_chars, chars = state
            return current[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * 6
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

        for batch in batches:
            rows = []
            for conv, out, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current != [conv]:
                    if current is not None:
                        rows.append(row())
                    current, state = [conv], [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(out):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[1] += 1
                if end:
                    masked = unescape(out[start:end])
                    state[2].update(masked.encode())
                    state[3] += len(masked)
                state[4] += len(out)
            yield batch_of(rows)
        if current is not None:
            yield batch_of([row()])

    rows = _in_order(formatted).select("conv_id", "formatted", "loss_start", "loss_end")
    return rows.mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))
