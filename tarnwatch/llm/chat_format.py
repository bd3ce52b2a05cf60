r"""Chat formatting by columnar byte assembly: turns of many conversations are copied into one preallocated Arrow buffer per batch.

A turn becomes ``<s>[INST]role[/INST]text</s>``.  A control string inside a role or text gets one backslash after its first character (``<\s>``), and one more if it has some already, so texts never
hold the template's marks and lose one backslash when they are read back.  No control string can start inside another, so this is reversible for every text.

Rows are range-partitioned and sorted by (conv_id, turn, role, text), so a conversation may lie in several partitions and none has to fit into a task.  Each Arrow batch is assembled as columns: the lengths of all
segments (marks, roles, texts, backslashes) give cumulative offsets, those give the place of every byte, and marks and contents are scattered into one buffer; long stretches are copied as slices.
The result is a table of pieces: (conv_id, at, formatted, loss); a conversation's pieces in the order of ``at``, one after another, are its formatted text, and loss lists the bytes of a piece under the loss mask (texts of the
loss role, without marks).  A batch holds 64 MB of rows (``spark.sql.execution.arrow.maxBytesPerBatch``) or one longer text.

``read_back`` parses pieces and mask and gives digests per conversation.  A digest reads a conversation in order, so one task streams it, piece by piece, however long it is.

Defined results: null text and null role count as empty; rows with a null turn come first, those of one turn go by role, then text, so ties have one order; repeated rows are turns of their own; rows with a null conv_id
are one conversation; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_table

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
#: Control strings: of the template, and others that tokenizers of chat models know.  The first character of each stands in none of them again.
ANGLE, SQUARE = rb"s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>", rb"/?INST\]"
ESCAPE = re.compile(rb"<\\*(?=(" + ANGLE + rb"))|\[\\*(?=(" + SQUARE + rb"))")
UNESCAPE = re.compile(rb"<\\(?=\\*(?:" + ANGLE + rb"))|\[\\(?=\\*(?:" + SQUARE + rb"))")
LONG, AT_ONCE = 4096, 1 << 20  # stretches copied as slices; bytes scattered at a time
PIECES = "conv_id long, at long, formatted string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its rows."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), offsets


def backslashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where in data a backslash is put before the byte: behind the first character, and its backslashes, of each control string within a row."""
    base = int(offsets[0])
    found = np.array([(m.start(), m.end(), m.end(m.lastindex)) for m in ESCAPE.finditer(memoryview(data)[base : int(offsets[-1])])], dtype=np.int64).reshape(-1, 3) + base
    row = np.searchsorted(offsets, found[:, 0], "right") - 1
    return found[found[:, 2] <= offsets[row + 1], 1]  # else it goes from one row into the next


def scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, put: np.ndarray) -> None:
    """Copies the rows of a column to their starts in out, with a backslash at each place of put."""
    row = np.searchsorted(offsets, put, "right") - 1
    nth = np.arange(len(put)) - np.searchsorted(put, offsets[:-1])[row]  # among those of its row
    shift = start - offsets[:-1]
    out[put + shift[row] + nth] = ord("\\")
    cuts, moves = np.r_[offsets[:-1], put], np.r_[shift, shift[row] + nth + 1]
    order = np.argsort(cuts, kind="stable")
    cuts, moves = cuts[order], moves[order]
    sizes = np.diff(np.r_[cuts, offsets[-1]])
    for c, m, n in zip(*(x[sizes >= LONG].tolist() for x in (cuts, moves, sizes)), strict=True):
        out[c + m : c + m + n] = data[c : c + n]
    short = (sizes > 0) & (sizes < LONG)
    cuts, moves, sizes = cuts[short], moves[short], sizes[short]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        n = sizes[at:upto]
        source = np.repeat(cuts[at:upto] - (ends[at:upto] - n - done), n) + np.arange(int(n.sum()))
        out[source + np.repeat(moves[at:upto], n)] = data[source]
        at = upto


def assemble(batch: pa.RecordBatch, loss_role: bytes) -> pa.RecordBatch:
    """Sorted rows (conv_id, at, role, text: binary, none null but conv_id) as one piece per run of a conversation."""
    (roles, role_at), (texts, text_at) = column(batch["role"]), column(batch["text"])
    put_role, put_text = backslashes(roles, role_at), backslashes(texts, text_at)
    more = lambda offsets, put: np.diff(offsets) + np.bincount(np.searchsorted(offsets, put, "right") - 1, minlength=len(offsets) - 1)
    role_len, text_len = more(role_at, put_role), more(text_at, put_text)
    ends = np.cumsum(role_len + text_len + len(OPEN) + len(MIDDLE) + len(CLOSE))
    starts = np.r_[0, ends[:-1]]
    role_start = starts + len(OPEN)
    text_start = role_start + role_len + len(MIDDLE)
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    for mark, place in ((OPEN, starts), (MIDDLE, text_start - len(MIDDLE)), (CLOSE, ends - len(CLOSE))):
        out[place[:, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    scatter(out, roles, role_at, role_start, put_role)
    scatter(out, texts, text_at, text_start, put_text)
    ids = batch["conv_id"]
    key, void = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (void[1:] != void[:-1])])
    bounds = np.r_[starts[run], ends[-1]]
    formatted = pa.Array.from_buffers(pa.large_string(), len(run), [None, pa.py_buffer(bounds.astype(np.int64)), buffer]).cast(pa.string())
    masked = np.flatnonzero(pc.equal(batch["role"], pa.scalar(loss_role, batch["role"].type)).to_numpy(zero_copy_only=False))
    piece = np.searchsorted(run, masked, "right") - 1
    begin = text_start[masked] - bounds[piece]
    spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + text_len[masked])], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(masked, np.r_[run, len(ids)]).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(run)), batch["at"].take(pa.array(run)), formatted, loss], ["conv_id", "at", "formatted", "loss"])


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) as pieces (conv_id, at, formatted, loss); those of a conversation follow each other by ``at``."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the head of a text is enough to deal rows out: equal heads stay together and are sorted by the whole text
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    wanted = loss_role.encode()
    return placed.mapInArrow(lambda batches: (assemble(b, wanted) for b in batches if b.num_rows), PIECES)


def plain(part: bytes) -> bytes:
    return UNESCAPE.sub(lambda m: m[0][:1], part) if b"\\" in part else part


def turns_in(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn; a piece that is no sequence of turns is an error."""
    at = 0
    while at < len(formatted):
        middle = formatted.find(MIDDLE, at)
        close = formatted.find(CLOSE, middle)
        if not formatted.startswith(OPEN, at) or middle < 0 or close < 0:
            raise ValueError(f"no turn at byte {at}")
        yield plain(formatted[at + len(OPEN) : middle]), plain(formatted[middle + len(MIDDLE) : close])
        at = close + len(CLOSE)


def characters(part: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(part, dtype=np.uint8) & 0xC0) != 0x80))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (conv_id, at) as one row per conversation; a conversation may go on in the next batch."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    now, whole, loss = None, hashlib.sha256(), hashlib.sha256()

    def closed() -> dict:
        return now | {"turns_sha256": whole.hexdigest(), "loss_sha256": loss.hexdigest()}

    types = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    for batch in batches:
        done = []
        for conv, formatted, spans in zip(batch["conv_id"], batch["formatted"], batch["loss"], strict=True):
            conv, piece = conv.as_py(), memoryview(formatted.as_buffer()).tobytes()
            if now is None or now["conv_id"] != conv:
                done += [closed()] if now else []
                now, whole, loss = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}, hashlib.sha256(), hashlib.sha256()
            for role, text in turns_in(piece):
                whole.update(role + b"\n" + text + b"\n")
                now["n_turns"] += 1
            for span in spans.as_py():
                text = plain(piece[span["start"] : span["end"]])
                loss.update(text)
                now["loss_chars"] += characters(text)
            now["formatted_chars"] += characters(piece)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=types)
    if now:
        yield pa.RecordBatch.from_pylist([closed()], schema=types)


def read_back(pieces: DataFrame) -> DataFrame:
    """Pieces as one row per conversation: conv_id, n_turns, digests of its turns and of what is under the mask, counts of code points; all from formatted and loss."""
    return pieces.select("conv_id", "at", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "formatted", "loss").mapInArrow(digests, DIGESTS)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(write_table(format_conversations(turns.unionByName(extra)), "op13-pieces"))


_control = r"<\\*(s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)|\[\\*/?INST\]"
_escaped = "length({0}) + len(regexp_extract_all({0}, '" + _control + "'))"
OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum({_escaped.format('role')} + {_escaped.format('text')} + {len(OPEN) + len(MIDDLE) + len(CLOSE)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
