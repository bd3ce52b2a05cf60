"""Line deduplication over range-partitioned line hashes.

Every line with a key of at least ``min_chars`` code points becomes a small row (128-bit hash, document, position); text is not moved.  The rows are
range-partitioned by (hash, document descending) and sorted by (hash, document descending, position).  A stream over each partition meets the
largest document of a hash first, its keeper, and counts the documents by comparing neighbours, holding no more rows than those of the first few
documents.  A hash that runs over the border of partitions is completed from the border runs: each partition reports the count and
keeper of its first and last hash, two rows that are summed by hash.
Lines of hashes in at least ``min_docs`` documents go, unless in the keeper, and what returns per document is a compressed bitmap of the lines to keep.

Documents are known by (doc_id, hash of the text), so repeated rows share a bitmap and count as one document.

Defined results: null or empty text is one empty line, which stays; very long texts are split whole, and a line may be of any length; ties don't arise: within the keeper every line with the key stays,
however often it stands there, and rows that repeat the keeper keep theirs, too; lines of documents with null doc_id count as those of one document and stand before
all others (smallest id); an empty table gives an empty result; other columns are kept by ``drop_repeated_lines``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, table, write_table

MIN_CHARS, MIN_DOCS = 40, 5
SPACE = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, no_doc, doc, text_hash, pos) of the lines of docs (doc_id, text) whose keys are long enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, strip = xxhash.xxh3_128_digest, SPACE
        for batch in batches:
            keys, at, pos = [], [], []
            for i, text in enumerate(batch.column("text")):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(strip)) >= min_chars:
                        keys.append(digest(line.encode("utf-8", "replace").lower()))  # bytes.lower() changes A-Z only
                        at.append(i), pos.append(k)
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            at = pa.array(at, pa.int64())
            document = [batch.column(c).take(at) for c in ("no_doc", "doc", "text_hash")]  # not the text: it would be copied for every line
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *document, pa.array(pos, pa.int32())], names=["h1", "h2", "no_doc", "doc", "text_hash", "pos"])

    columns = docs.select(F.col("doc_id").isNull().alias("no_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    return columns.mapInArrow(rows, "h1 long, h2 long, no_doc boolean, doc long, text_hash long, pos int")


DROP, OPEN, BORDER = 0, 1, 2
STREAM_SCHEMA = "kind int, h1 long, h2 long, no_doc boolean, doc long, text_hash long, pos int, n_docs long"


class LineStream:
    """Reads the sorted rows of a partition batch by batch; step() and close() return frames of STREAM_SCHEMA.

    DROP rows are lines to drop.  OPEN rows belong to a hash that may go on in another partition and are decided with its BORDER rows,
    which hold the partition's count of documents and its largest one.
    """

    def __init__(self, min_docs: int) -> None:
        self.min_docs, self.hash, self.doc = min_docs, None, None
        self.first, self.n_docs, self.keeper, self.held = True, 0, None, []

    def emit(self, frame: pd.DataFrame, kind: int) -> pd.DataFrame:
        return frame.assign(kind=np.int32(kind), n_docs=np.int64(0))[["kind", "h1", "h2", "no_doc", "doc", "text_hash", "pos", "n_docs"]]

    def border(self) -> pd.DataFrame:
        none, doc = self.keeper
        return pd.DataFrame({"kind": np.int32([BORDER]), "h1": [self.hash[0]], "h2": [self.hash[1]], "no_doc": [none], "doc": [doc], "text_hash": [0], "pos": np.int32([0]), "n_docs": [self.n_docs]})

    def end_run(self, last: bool) -> list[pd.DataFrame]:
        """What is known of a hash when its rows in this partition end; its rows are in held if nothing is decided."""
        if self.hash is None:
            return []
        open_run = self.first or last
        out = [self.border()] if open_run else []
        if open_run and self.n_docs < self.min_docs and not self.first:
            out += [self.emit(f, OPEN) for f in self.held]
        self.first, self.held = False, []
        return out

    def step(self, frame: pd.DataFrame) -> list[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        h1, h2 = frame["h1"].to_numpy(), frame["h2"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        ends = np.r_[starts[1:], len(frame)]
        none, doc = frame["no_doc"].to_numpy(), frame["doc"].to_numpy()
        fresh = np.r_[True, (none[1:] != none[:-1]) | (doc[1:] != doc[:-1])]
        fresh[starts] = True
        seen = np.cumsum(fresh)
        # runs inside the batch that are whole and in too few documents, most of all, need no more work
        counts = seen[ends - 1] - seen[starts] + 1
        for r in np.flatnonzero(np.r_[True, counts[1:-1] >= self.min_docs, True][: len(starts)]):
            s, e = int(starts[r]), int(ends[r])
            key = (int(h1[s]), int(h2[s]))
            if key != self.hash:
                out += self.end_run(False)
                self.hash, self.doc, self.n_docs, self.keeper = key, None, 0, (bool(none[s]), int(doc[s]))
            again = self.doc == (bool(none[s]), int(doc[s]))  # the batch went on within a document
            self.n_docs += int(counts[r]) - again
            self.doc = (bool(none[e - 1]), int(doc[e - 1]))
            rows = frame.iloc[s:e]
            if self.first:
                out.append(self.emit(rows, OPEN))
            elif self.n_docs >= self.min_docs:
                held, self.held = [*self.held, rows], []
                out += [self.emit(f[(f["doc"] != self.keeper[1]) | (f["no_doc"] != self.keeper[0])], DROP) for f in held]
            else:
                self.held.append(rows)
            if r == 0 and len(starts) > 1:  # another hash follows, maybe one that is skipped
                out += self.end_run(False)
                self.hash = None
        return out

    def close(self) -> list[pd.DataFrame]:
        return self.end_run(True)


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(no_doc, doc, text_hash, pos) of the lines to drop."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = LineStream(min_docs)
        for frame in frames:
            if len(frame) and (out := state.step(frame)):
                yield pd.concat(out, ignore_index=True)
        yield from state.close()

    order = ["h1", "h2", "no_doc", F.col("doc").desc()]
    found = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos").mapInPandas(stream, STREAM_SCHEMA)
    found = write_table(found, "op9-found")
    keeper = F.max(F.struct((~F.col("no_doc")).alias("has_doc"), F.col("doc").alias("doc"))).alias("keeper")
    # two rows a partition at most, so this table is small whatever the input
    borders = found.where(f"kind = {BORDER}").groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), keeper).where(F.col("all_docs") >= min_docs)
    other = (F.col("keeper.doc") != F.col("doc")) | (F.col("keeper.has_doc") == F.col("no_doc"))
    opened = found.where(f"kind = {OPEN}").join(F.broadcast(borders), ["h1", "h2"]).where(other)
    columns = ["no_doc", "doc", "text_hash", "pos"]
    return found.where(f"kind = {DROP}").select(*columns).unionByName(opened.select(*columns))


def pack_bits(positions: list[int]) -> bytes:
    """Compressed keep bitmap: bit i is 0 if line i goes; lines past its end stay."""
    bits = np.ones((max(positions) // 8 + 1) * 8, dtype=np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    if not bitmap:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    n = len(bits)
    return [x for i, x in enumerate(lines) if i >= n or bits[i]], len(lines)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(no_doc, doc, text_hash, keep_bitmap) of the documents that lose lines."""

    @F.pandas_udf("binary")
    def compress(positions: pd.Series) -> pd.Series:
        return positions.map(pack_bits)

    lines = write_table(line_rows(docs, min_chars), "op9-lines")
    gone = repeated_lines(lines, min_docs).groupBy("no_doc", "doc", "text_hash").agg(F.collect_set("pos").alias("positions"))
    out = write_table(gone.select("no_doc", "doc", "text_hash", compress("positions").alias("keep_bitmap")), "op9-bitmaps")
    drop_table(lines)
    return out


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with __tw_bitmap, null where all lines stay."""
    b = bitmaps.select(*[F.col(c).alias(f"__tw_{c}") for c in ("no_doc", "doc", "text_hash")], F.col("keep_bitmap").alias("__tw_bitmap"))
    same = (F.col("__tw_no_doc") == F.col("doc_id").isNull()) & (F.col("__tw_doc") == F.coalesce(F.col("doc_id").cast("long"), F.lit(0))) & (F.col("__tw_text_hash") == F.xxhash64("text"))
    # the bitmaps grow with the corpus: always a sort-merge join, never a broadcast that only small inputs allow
    return docs.join(b.hint("merge"), same, "left").drop("__tw_no_doc", "__tw_doc", "__tw_text_hash")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text, ...) without the repeated lines; n_chars, if there is one, follows the text; a null text stays null."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else "\n".join(kept_lines(t, b)[0]) for t, b in zip(text, bitmap, strict=True)], dtype=object)

    out = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).withColumn("text", rest("text", "__tw_bitmap"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__tw_bitmap").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def digest(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
        out = []
        for t, b in zip(text, bitmap, strict=True):
            kept, n = kept_lines(t, b)
            out.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode("utf-8", "replace")).hexdigest()))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = with_bitmaps(docs, keep_bitmaps(docs))
    return both.select("doc_id", digest("text", "__tw_bitmap").alias("d")).select("doc_id", "d.*")


OP9_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM rows),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
