"""Near duplicates by 64-bit fingerprints, found through Golay-code keys.

A fingerprint is cut into four segments of 16 bits, each padded to a 23-bit word of the perfect binary Golay code. Every word is within
three bits of exactly one of 4,096 codewords. The codewords nearest to a segment and to its 16 one-bit neighbours give it several keys; of
two segments that differ in one bit, each has the nearest codeword of the other among its keys.

When at most three of 64 bits differ, some segment is equal, and the segment behind it (in a circle) differs in at most one bit, for at
least one of the four places: three errors cannot spoil them all. So there are four tables, keyed by one segment as it is and a codeword of
the next. A fingerprint enters each in two roles: *left* with all keys of the next segment, *right* with its nearest codeword only. Any linked
pair meets in a bucket. Buckets are verified by comparing the bits; a bucket gives a spanning forest of its links and never all its pairs.
Equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from countspark.llm.common import bytes_of, id_column, pieces, slices
from countspark.llm.components import components
from countspark.session import keep, keep_measured

#: Generator polynomial of the (23, 12) binary Golay code, hash seed, and widths of the segments.
GOLAY = 0b101011100011
SEED = 42
WIDTH = 16
SEGMENTS = 4
#: Members of a bucket that one task compares with each other; larger buckets are compared in pairs of chunks.
CHUNK = 4096
DISTANCE = 3


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """The fingerprint of one text, see ``fingerprints``."""
    total, n, tail = np.zeros(64, np.int64), 0, []
    hash64 = xxhash.xxh64_intdigest
    for piece in pieces(text):
        words = tail + piece.lower().split()
        joined = b" ".join(words)
        if len(words) < width:
            tail = words
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-width].tolist()]
        stops = (ends[width - 1:] - 1).tolist()
        hashes = np.fromiter((hash64(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(stops))
        total += _bit_sums(hashes)
        n += len(hashes)
        tail = words[-(width - 1):] if width > 1 else []
    if n == 0:
        if not tail:
            return 0
        total, n = _bit_sums(np.array([hash64(b" ".join(tail), SEED)], np.uint64)), 1
    return int(((2 * total > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``key`` and ``fp`` (bigint), the majority of the bits of the XXH64 hashes of its shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case; a shingle is ``width`` words, repeats included. A text of
    fewer words is one shingle, a text without words (or null) has fingerprint zero. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint_of(t, width) for t in bytes_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_column(docs, key)}, fp bigint").select(F.col("id").alias(key), "fp")


_NEAREST: list[np.ndarray] = []


def nearest_codewords() -> np.ndarray:
    """For every 23-bit word the index of the one codeword within three bits; built once in a Python worker."""
    if not _NEAREST:
        def remainder(words: np.ndarray) -> np.ndarray:
            words = words.copy()
            for bit in range(22, 10, -1):
                words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0).astype(words.dtype)
            return words

        errors = [0]
        for a in range(23):
            errors.append(1 << a)
            for b in range(a):
                errors.append(1 << a | 1 << b)
                errors.extend(1 << a | 1 << b | 1 << c for c in range(b))
        errors = np.array(errors, np.int32)
        of_syndrome = np.zeros(2048, np.int32)
        of_syndrome[remainder(errors)] = errors
        table = np.empty(1 << 23, np.uint16)
        for at in range(0, 1 << 23, 1 << 18):
            words = np.arange(at, at + (1 << 18), dtype=np.int32)
            table[words] = (words ^ of_syndrome[remainder(words)]) >> 11  # the code is systematic: the upper 12 bits name the codeword
        _NEAREST.append(table)
    return _NEAREST[0]


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword of each segment, and (row, codeword) for all its keys."""
    near = nearest_codewords()[words[:, None] ^ np.array([0, *(1 << b for b in range(WIDTH))])]
    ordered = np.sort(near, axis=1)
    fresh = np.ones(ordered.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    row, col = np.nonzero(fresh)
    return near[:, 0].astype(np.int64), row, ordered[row, col].astype(np.int64)


def bucket_rows(fps: DataFrame) -> DataFrame:
    """``(key, right, fp)``: each fingerprint under all its keys, in both roles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                values = batch.column(0).slice(at, 1 << 14).to_numpy().view(np.uint64)
                segments = [((values >> np.uint64(WIDTH * i)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for i in range(SEGMENTS)]
                for table in range(SEGMENTS):
                    nearest, row, code = segment_keys(segments[(table + 1) % SEGMENTS])
                    same = table << 28 | segments[table] << 12
                    for right, of, key in ((False, values[row], same[row] | code), (True, values, same | nearest)):
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.full(len(of), right)), pa.array(of.view(np.int64))], ["key", "right", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, right boolean, fp bigint")


def forest(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (positions in the two arrays together) that connect whatever pairs of left and right within ``distance`` connect."""
    label = np.arange(len(left) + len(right))
    links = []
    for i, value in enumerate(left):
        hits = np.flatnonzero(np.bitwise_count(right ^ value) <= distance) + len(left)
        others, first = np.unique(label[hits], return_index=True)
        for old, at in zip(others.tolist(), hits[first].tolist()):
            if old != label[i]:
                label[label == old] = label[i]
                links.append((i, at))
    return links


def link_rows(buckets: DataFrame, *, chunk: int = CHUNK, distance: int = DISTANCE) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints, a spanning forest per bucket.

    ``buckets`` is a written table, as it is read twice. A bucket with more than ``chunk`` rows is dealt by hash into chunks, and
    every pair of chunks is a group of its own, so a group has at most about ``2 * chunk`` rows, whatever the bucket holds.
    """
    sizes = buckets.groupBy("key").agg(F.sum(F.when(F.col("right"), 0).otherwise(1)).alias("n_left"), F.sum(F.when(F.col("right"), 1).otherwise(0)).alias("n_right"))
    sizes = sizes.where("n_left > 0 and n_right > 0 and n_left + n_right > 2").select(
        F.col("key").alias("of"), F.ceil((F.col("n_left") + F.col("n_right")) / (2 * chunk)).cast("int").alias("chunks"))
    rows = buckets.join(sizes, F.col("key") == F.col("of"))
    own = F.pmod(F.xxhash64("fp", "right"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    meets = F.transform(others, lambda j: F.when(F.col("right"), F.struct(j.alias("l"), own.alias("r"))).otherwise(F.struct(own.alias("l"), j.alias("r"))))
    dealt = rows.select("key", "right", "fp", F.explode(meets).alias("at"))
    groups = dealt.groupBy("key", "at.l", "at.r").agg(F.collect_list(F.when(~F.col("right"), F.col("fp"))).alias("left"),
                                                    F.collect_list(F.when(F.col("right"), F.col("fp"))).alias("right"))
    groups = groups.where("size(left) > 0 and size(right) > 0 and size(left) + size(right) > 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            (lv, lo), (rv, ro) = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(0), batch.column(1))]
            for i in range(batch.num_rows):
                left, right = lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]
                if len(left) == 1 or len(right) == 1:  # most buckets: no forest is needed
                    one, many = (left, right) if len(left) == 1 else (right, left)
                    away = np.bitwise_count(many ^ one[0])
                    for x in many[(away > 0) & (away <= distance)].tolist():
                        a.append(int(one[0]))
                        b.append(x)
                else:
                    both = np.concatenate((left, right))
                    for x, y in forest(left, right, distance):
                        a.append(int(both[x]))
                        b.append(int(both[y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    return groups.select("left", "right").mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key reachable over links).

    Documents whose fingerprints differ in at most three of 64 bits are linked. Null and empty texts have fingerprint zero and are
    linked like others. Rows with a null key count as reachable documents without a name: ``component_id`` is null only where a
    component has no named row. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    prints = keep(fingerprints(docs, key=key, text=text, width=width))
    classes = keep(prints.groupBy("fp").agg(F.min(key).alias("first")))
    buckets = keep(bucket_rows(classes))
    links, seen = keep_measured(link_rows(buckets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if seen["n"] == 0:
        named = classes.select("fp", F.col("first").alias("component_id"))
    else:
        roots = components(links)
        of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        of = keep(of)
        least = of.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
        named = of.join(least, F.col("root") == F.col("_root")).select("fp", "component_id")
    named = named.withColumnRenamed("fp", "_fp")
    return (prints.join(named, F.col("fp") == F.col("_fp"))
            .select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose component has a document with a smaller ``doc_id``; one row stays of each group.

    Documents without a key stay only if their group has no named document. Of several rows with the staying key (or several
    nameless ones with one fingerprint) one stays.
    """
    found = keep(simhash_components(docs))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).where("gone is not null").distinct()
    named = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").where(docs["doc_id"].isNotNull())
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        kept = named
    else:
        again = keep(again)
        kept = named.join(again, named["doc_id"] == again["again"], "left_anti").unionByName(
            named.join(again, named["doc_id"] == again["again"], "left_semi").dropDuplicates(["doc_id"]))
    nameless = found.where("doc_id is null and component_id is null")
    if nameless.isEmpty():
        return kept
    return kept.unionByName(docs.where(docs["doc_id"].isNull()).dropDuplicates(["text"]))
