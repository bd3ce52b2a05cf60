"""Packing documents into sequences by the sum-of-squares rule.

Texts are tokenised in Arrow batches; a document longer than a sequence is cut so that all pieces but the first are full.  Full pieces are sequences of their
own.  The others are dealt by a hash into groups of about ``group_items`` pieces, and each group is packed by itself: a piece goes to
the residual gap (or a new bin) after which the sum over all gaps of (open bins with that gap) squared is smallest; full bins are closed
and don't count.  The state is the number of open bins per gap, so its size is bounded by the sequence length.  Within a group the pieces of at least
a tenth of a sequence come first, large ones before small ones, then the rest in the order of a hash; a group only wastes its own last few bins.

The token ids are those of ``Tokenizer.from_file(...).encode(text, add_special_tokens=False)`` of the ``tokenizers`` library, added tokens in a text included.
They are computed with ``tiktoken`` on the rank file of the same vocabulary, which is several times faster (tests compare the two): a text is cut at the added
tokens of the vocabulary, and at white space of ``LONG_SPACE`` characters and more, which the pattern's look-ahead can't take; such a run is merged as the one piece that it is.

Defined results: null or empty text is one piece with the closing id alone; a text of any length is tokenised whole and cut into pieces; null doc_id and repeated
rows are packed as documents of their own; of equally good places the one that leaves the smallest gap is taken, and equally long pieces stand in the order of a
hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_table

CAPACITY = 2048
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k"
LONG_SPACE = 10_000
#: What \s of the tokenizer's pattern stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = re.compile(f"[{SPACE}]{{2}}")
LONG_RUN = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


class Encoder:
    """Token ids of the vocabulary ``<name>.json``, by the ranks in ``<name>.tiktoken``."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            self.added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        pattern = public_tokenizers.PATTERN
        # without two white spaces in a row the look-ahead decides nothing, and a pattern without it is faster
        plain = pattern.replace(r"\s+(?!\S)|", "")
        self.full, self.plain = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", pattern), ("plain", plain)))

    def part(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if not SPACE_RUN.search(text):
            return self.plain.encode_ordinary(text)
        ids, at = [], 0
        for run in LONG_RUN.finditer(text):
            # all of the run but its last character is one piece if something follows
            end = run.end() - (run.end() < len(text))
            ids += self.full.encode_ordinary(text[at : run.start()])
            ids += self.full._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.full.encode_ordinary(text[at:])

    def ids(self, text: str) -> list[int]:
        if not any(t in text for t in self.added):
            return self.part(text)
        out: list[int] = []
        for piece in self.at_added.split(text):
            out += [self.added[piece]] if piece in self.added else self.part(piece)
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    ids = encoder(vocabulary).ids(text) if text else []
    ids.append(CLOSING_ID)
    return np.array(ids, dtype="<u4")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all but the first are full."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text, rid) as pieces: doc_id, rid, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rid, piece, start, length, crc = [], [], [], [], [], []
            for d, r, t in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), batch.column("text"), strict=True):
                ids = token_ids(t.as_py(), vocabulary)
                for k, (s, n) in enumerate(cut(ids, capacity)):
                    doc.append(d), rid.append(r), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rid, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "rid", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "rid", "text").mapInArrow(pieces, "doc_id long, rid long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, packed in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by residual gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # an item in gap g moves one bin from g to g - n: the sum changes by 2 * (count[g - n] - count[g] + 1), or by 1 - 2 * count[g] if the bin gets full
        change = 2 * (count[: capacity + 1 - n] - count[n:] + 1)
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = np.iinfo(np.int64).max
        rest = int(change.argmin())
        fresh = 2 * count[capacity - n] + 1 if n < capacity else 0
        if count[rest + n] == 0 or fresh < change[rest]:
            bins[i], offsets[i], gap = used, 0, capacity
            used += 1
        else:
            gap = rest + n
            bins[i], offsets[i] = open_bins[gap].pop(), capacity - gap
            count[gap] -= 1
        if gap > n:
            open_bins[gap - n].append(int(bins[i]))
            count[gap - n] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = 32768, seed: int = 53) -> DataFrame:
    """pieces (rid, piece, length, ...) with sequence_id and offset."""
    part = pieces.where(F.col("length") < capacity)
    n = part.count()
    groups = max(1, -(-n // group_items))
    # sequence ids: full pieces by their own place, packed bins above 2**62 by group and bin
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    base = 1 << 62

    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        small = frame["length"] * 10 < capacity  # these fill what the others leave, in no order
        frame = frame.assign(rank=np.where(small, 0, frame["length"])).sort_values(["rank", "mix"], ascending=[False, True]).drop(columns=["rank", "mix"])
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=base + frame["part"].astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns="part")

    mixed = F.xxhash64("rid", "piece", F.lit(seed))
    dealt = part.withColumn("part", F.pmod(mixed, F.lit(groups)).cast("int")).withColumn("mix", F.xxhash64(mixed))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return full.unionByName(dealt.groupBy("part").applyInPandas(pack_group, f"{kinds}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_items: int = 32768, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    pieces = write_table(tokenise(numbered, capacity, vocabulary), "op4-pieces")
    return pack(pieces, capacity, group_items).drop("rid")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
