"""Chat formatting at token level.

Each role and each text is escaped, encoded on its own and put between reserved ids, so no text can make or swallow a
control token. Where a turn stands in its conversation, and which tokens carry loss, comes from prefix sums of the
turns' token counts. A turn is written as

    <s> role [INST] text [/INST]        and </s> after the last turn of the conversation

and the escape puts a backslash into each control string that occurs in a role or text, and doubles backslashes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The reserved strings, in the order of their ids.
TURN, TEXT, END_TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (TURN, TEXT, END_TEXT, END)

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reserved = {s: max(ranks.values()) + 1 + i for i, s in enumerate(CONTROLS)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=reserved), reserved


def format_conversations(conversations: DataFrame, ranks_path: str, pattern: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in pieces of a conversation's token stream: conv_id, seq (turns from 1), n_turns, start (of its
    first token in the conversation), ids array<int>, loss_from and loss_to (token places in the conversation; equal
    where no token carries loss).

    Turns are ordered by turn (null first), then role and text, so ties are defined and repeated rows stay. Null roles
    and texts count as empty; a null conv_id is a conversation of its own. A long conversation stays in rows of single
    turns. Only conv_id, turn, role and text are read.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "conv_id long, turn long, role string, key long, ids array<int>, text_from int, text_to int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reserved = tokenizer(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, begins, ends, keys = [], [], [], []
                for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist()):
                    head = [reserved[TURN], *own.encode_ordinary(escape(role)), reserved[TEXT]]
                    body = own.encode_ordinary(escape(text))
                    ids.append(np.array([*head, *body, reserved[END_TEXT]], np.int32))
                    begins.append(len(head))
                    ends.append(len(head) + len(body))
                    keys.append(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), part.column("role"), pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "turn", "role", "key", "ids", "text_from", "text_to"])

    encoded = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = encoded.withColumn("n_ids", F.size("ids")).withColumns({"seq": F.row_number().over(order), "start": F.coalesce(F.sum("n_ids").over(before), F.lit(0))})
    placed = placed.withColumn("last", F.lead("seq").over(order).isNull())
    _, reserved = tokenizer(ranks_path, pattern)
    bears = F.col("role").isin(*loss_roles)
    return placed.select(
        "conv_id",
        "seq",
        "start",
        F.when(F.col("last"), F.concat("ids", F.array(F.lit(reserved[END])))).otherwise(F.col("ids")).alias("ids"),
        (F.col("start") + F.col("text_from")).alias("loss_from"),
        (F.col("start") + F.when(bears, F.col("text_to")).otherwise(F.col("text_from"))).alias("loss_to"),
    )


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Parses the token stream again: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of a conversation follow each other in one task and feed running digests, a turn at a time: a digest is
    sequential by nature, and what a task holds is one batch, however long a conversation is.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reserved = tokenizer(ranks_path, pattern)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def close() -> None:
            conv, n, turns, chars, loss, total = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "seq", "start", "loss_from", "loss_to")]
            for row, (conv, seq, start, loss_from, loss_to) in enumerate(zip(*columns)):
                if seq == 1:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = batch.column("ids")[row].as_py()
                role_end, text_end = ids.index(reserved[TEXT]), ids.index(reserved[END_TEXT])
                role, text = own.decode(ids[1:role_end]), own.decode(ids[role_end + 1 : text_end])
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                masked = unescape(own.decode(ids[loss_from - start : loss_to - start]))
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(own.decode(ids))
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done = []
        if state:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    return ordered.mapInArrow(run, schema)
