"""Exact duplicates by recipes of content-defined chunks.

A text, with runs of white space folded to one blank, is cut where a rolling hash of its last 32 bytes hits a pattern, so equal texts
are cut alike. Every chunk has a fingerprint. Equal chunks are reduced to one inside each task and once more behind one shuffle, which
shows whether a fingerprint stands for one chunk only; only then are the fingerprints used as identifiers. From there on a text is the
ordered list of its identifiers, 16 bytes for about two kilobytes, and equal lists are equal texts: no text is moved as a whole, and a
chunk is moved once per task that holds it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from countspark.llm.common import id_column
from countspark.session import keep, keep_measured

#: Bytes of a chunk: least, greatest (but for the last), and the hash bits that a cut asks for (2 ** 11 bytes between cuts).
LEAST, MOST, CUT_BITS = 512, 8192, 11
#: Bytes of a fingerprint; if two chunks ever share one, the next width (the last for good) is tried with another seed.
WIDTHS = (16,)
#: Groups with more than one in so many of all rows are joined by broadcast; there are fewer than that.
HEAVY = 1000
_PIECE = 1 << 20
_WINDOW = 32
_SPACES = re.compile(rb"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")
_GEAR = np.random.default_rng(11).integers(0, 2 ** 32, 256, dtype=np.uint32)


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of white space as one blank; null is empty."""
    return _SPACES.sub(b" ", (text or "").encode())


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; they depend on the bytes alone. Empty data has no chunk."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    ends, last = [], 0
    for start in range(0, n, _PIECE):
        head = max(0, start - _WINDOW + 1)
        h = _GEAR[raw[head:start + _PIECE]]
        for step in (1, 2, 4, 8, 16):  # sum of the last 32 table values, shifted by their distance
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        places = np.flatnonzero(h[start - head:] >> np.uint32(32 - CUT_BITS) == 0) + start + 1
        for place in places.tolist():
            while place - last > MOST:
                last += MOST
                ends.append(last)
            if place - last >= LEAST:
                ends.append(place)
                last = place
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes, seed: int = 0, width: int = 16) -> Iterator[tuple[bytes, bytes]]:
    """``(fingerprint, bytes)`` of the chunks in order."""
    at = 0
    for end in cut_places(data):
        part = data[at:end]
        yield xxhash.xxh3_128_digest(part, seed=seed)[:width], part
        at = end


def distinct_chunks(docs: DataFrame, *, text: str = "text", seed: int = 0, width: int = 16) -> DataFrame:
    """``(chunk, bytes)``: every different chunk of all texts once, with its fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = set(), 0
            for value in batch.column(0):
                for pair in chunks_of(normalised(value.as_py()), seed, width):
                    if pair not in found:
                        found.add(pair)
                        held += len(pair[1])
                if held > 4 * _PIECE:
                    yield rows(found)
                    found, held = set(), 0
            yield rows(found)

    def rows(found: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["chunk", "bytes"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "chunk binary, bytes binary").distinct()


def recipes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 0, width: int = 16) -> DataFrame:
    """``(id, text_sha256, recipe)`` per row: digest of the normalised text, and the fingerprints of its chunks in order, joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, made = [], []
            for value in batch.column(1):
                data = normalised(value.as_py())
                told.append(hashlib.sha256(data).hexdigest())
                made.append(b"".join(f for f, _ in chunks_of(data, seed, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), pa.array(made, pa.binary())], ["id", "text_sha256", "recipe"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_column(docs, key)}, text_sha256 string, recipe binary")


def verified_seed(docs: DataFrame, *, text: str = "text", widths: Sequence[int] = WIDTHS) -> tuple[int, int]:
    """Seed and width of fingerprints that are proven, over the bytes of all chunks, to stand for one chunk each."""
    seed = 0
    while True:
        width = widths[min(seed, len(widths) - 1)]
        shared = distinct_chunks(docs, text=text, seed=seed, width=width).groupBy("chunk").count().where("count > 1")
        if shared.isEmpty():
            return seed, width
        seed += 1


def chunk_store(docs: DataFrame, *, key: str = "doc_id", text: str = "text", widths: Sequence[int] = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """The texts as recipes and chunks: ``(id, text_sha256, chunks: array<binary>)`` per row, and ``(chunk, bytes)`` once per chunk."""
    seed, width = verified_seed(docs, text=text, widths=widths)
    listed = F.expr(f"transform(sequence(1, length(recipe) div {width}), i -> substring(recipe, cast((i - 1) * {width} + 1 as int), {width}))")
    rows = recipes(docs, key=key, text=text, seed=seed, width=width)
    rows = rows.select("id", "text_sha256", F.when(F.length("recipe") > 0, listed).otherwise(F.array().cast("array<binary>")).alias("chunks"))
    return rows.withColumnRenamed("id", key), distinct_chunks(docs, text=text, seed=seed, width=width)


def exact_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", widths: Sequence[int] = WIDTHS) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after folding runs of white space; null is empty. Of equal texts the row with the smallest
    key stays, a null key last; of rows with equal text and key one stays. Other columns are ignored; an empty table gives an empty result.
    """
    seed, width = verified_seed(docs, text=text, widths=widths)
    rows, seen = keep_measured(recipes(docs, key=key, text=text, seed=seed, width=width).withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid")))
    groups = rows.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = keep(groups.select(F.col("recipe").alias("same"), F.col("first.id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size"))
    # the few groups that hold a large share of all rows are sent to the rows; the rows of all others go to their groups
    large = F.col("group_size") * HEAVY > F.lit(seen["n"])
    heavy, light = F.broadcast(groups.where(large)), groups.where(~large)
    here = F.col("recipe") == F.col("same")
    told = rows.join(heavy, here).unionByName(rows.join(heavy.select("same"), here, "left_anti").join(light, here, "left"), allowMissingColumns=True)
    return told.select(F.col("id").alias(key), F.when(F.col("keep_uid").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                       F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"), "text_sha256")


def copies_sql() -> str:
    """``exact_copies`` of ``documents``."""
    return r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
  SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
    sha256(t) AS text_sha256 FROM n WINDOW g AS (PARTITION BY t)"""
