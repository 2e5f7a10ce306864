"""Stupid-backoff scores of all documents against the rest of the corpus.

The score of a word after its context is the relative frequency of the longest n-gram that occurs, times 0.4 for each word by which the
context was shortened. Counts are those of the whole corpus without the scored document itself, so a document does not vouch for itself.

Documents are put into blocks. A block sends its distinct n-grams, as sorted hashes, to the parts of the count tables (parts are ranges of
hashes); a part adds up what all blocks sent and answers each block with the counts in the order asked. Words and bigrams go first. A
trigram can occur elsewhere only if both of its bigrams do, so only such trigrams are asked for in the second step. With the counts of all
three orders a block scores its documents. A frequent n-gram is one entry per block, so no key is hot, and what moves grows with the text.
Blocks are made from the files and moved once; the second step meets the same shuffled blocks again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pyspark.sql.pandas.types import to_arrow_type

from countspark.llm.common import bytes_of, groups, id_column, mix, runs
from countspark.session import as_written

DISCOUNT = 0.4
#: Words of a block, and words of the corpus per part of the count tables.
BLOCK_WORDS = 1 << 19
PART_WORDS = 1 << 21
#: Bits of an n-gram's hash: of 10^13 different n-grams one in seven thousand shares its hash with another.
BITS = 56
_COUNTS = ("n_trigram", "n_bigram", "n_word", "n_unseen")


def _pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: the upper bytes of small differences are all zero."""
    width = values.dtype.itemsize
    return pa.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, "<u8"), dtype=np.uint64)


def _blocks(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Documents in blocks: ``block``, ``ids``, ``lengths`` (words), ``codes`` (places in the sorted word list), ``vocabulary``.

    ``docs`` is a scan of files, whose partitions hold the same rows in the same order whenever they are read; so do the blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hashes, total, done = [], [], [], 0, 0
        where = TaskContext.get().partitionId()

        def name() -> str:
            return hashlib.md5(repr((where, done, lengths[:8], len(lengths), total)).encode()).hexdigest()

        def block() -> pa.RecordBatch:
            all_words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            vocabulary, codes = np.unique(all_words, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array([name()]), pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                                               pa.array([lengths], pa.list_(pa.int64())), pa.array([_pack(codes.astype("<u4"))], pa.binary()), pa.array([len(codes)], pa.int64()),
                                               pa.array([_pack_sorted(vocabulary)], pa.binary()), pa.array([len(vocabulary)], pa.int64())],
                                              ["block", "ids", "lengths", "codes", "n_codes", "vocabulary", "n_vocabulary"])

        for batch in batches:
            texts = bytes_of(batch.column(1))
            counts = np.zeros(len(texts), np.int64)
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for at, part in groups(texts):
                _, h, of, _, _ = runs(part)
                edges = np.searchsorted(of, np.arange(len(part) + 1))
                for i, row in enumerate(at):
                    found[row].append(h[edges[i]:edges[i + 1]] >> np.uint64(64 - BITS))
                    counts[row] += edges[i + 1] - edges[i]
            start = 0
            for row in range(len(texts)):
                hashes += found[row]
                lengths.append(int(counts[row]))
                total += int(counts[row])
                if total >= words:
                    ids.append(batch.column(0).slice(start, row + 1 - start))
                    yield block()
                    ids, lengths, hashes, total, start, done = [], [], [], 0, row + 1, done + 1
            if start < len(texts):
                ids.append(batch.column(0).slice(start))
        if lengths:
            yield block()

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"block string, ids array<{id_column(docs, key)}>, lengths array<bigint>, codes binary, n_codes bigint, vocabulary binary, n_vocabulary bigint")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.split()) for x in bytes_of(batch.column(0)))], pa.int64())], ["n"])


class _Block:
    """The n-grams of a block: words by code, bigrams by hash, both with the documents they stand in."""

    def __init__(self, row: dict):
        self.name, self.lengths = row["block"], np.array(row["lengths"], np.int64)
        self.vocabulary = _unpack_sorted(row["vocabulary"], row["n_vocabulary"])
        self.codes = _unpack(row["codes"], row["n_codes"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.word = word = self.vocabulary[self.codes]
        self.pairs = np.flatnonzero(self.doc[1:] == self.doc[:-1])  # a bigram has the place of its first word
        self.bigrams, self.bigram_at = np.unique(_gram(word[self.pairs], word[self.pairs + 1]), return_inverse=True)

    def backed_off(self, single: np.ndarray, double: np.ndarray, total_words: int, discount: float) -> tuple[np.ndarray, ...]:
        """Per place, from the corpus counts of words and bigrams: the score without a trigram, its level (1 bigram, 2 word, 3 unseen),
        and the count of the bigram that begins there; counts leave the document of the place out."""
        n, docs = len(self.codes), len(self.lengths)
        words = single[self.codes] - _own(self.codes, self.doc, docs)
        pairs = np.zeros(n, np.int64)
        pairs[self.pairs] = double[self.bigram_at] - _own(self.bigram_at, self.doc[self.pairs], docs)
        here, before = np.zeros(n, np.int64), np.ones(n, np.int64)
        here[self.pairs + 1], before[self.pairs + 1] = pairs[self.pairs], words[self.pairs]
        rest, d = (total_words - self.lengths)[self.doc], np.log(discount)
        log = lambda x: np.log(np.maximum(x, 1))
        score = np.where(here > 0, d + log(here) - log(before), np.where(words > 0, 2 * d + log(words) - log(rest), 3 * d - np.log(rest + 1.0)))
        return score, np.where(here > 0, 1, np.where(words > 0, 2, 3)), pairs

    def trigrams(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (of the last word) of the trigrams whose bigrams both stand elsewhere, the distinct trigrams, and which is where."""
        if len(self.codes) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero((self.doc[2:] == self.doc[:-2]) & (pairs[:-2] > 0) & (pairs[1:-1] > 0)) + 2
        return at, *np.unique(_gram(self.word[at - 2], self.word[at - 1], self.word[at]), return_inverse=True)


def _gram(*words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of the given words."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for word in words:
        h = mix(h ^ word)
    return h >> np.uint64(64 - BITS)


def _own(at: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How often the n-gram of each place stands in the document of that place."""
    _, where, n = np.unique(at.astype(np.int64) * max(1, docs) + doc, return_inverse=True, return_counts=True)
    return n[where]


def _requests(block: str, order: int, grams: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """One row per part: the sorted n-grams that belong to it, and how often they stand in the block."""
    edges = np.searchsorted(grams >> np.uint64(BITS - 32), np.arange(parts + 1, dtype=np.uint64) * np.uint64(2 ** 32) // np.uint64(parts))
    for part in range(parts):
        low, high = edges[part], edges[part + 1]
        if high > low:
            yield block, part, order, int(high - low), _pack_sorted(grams[low:high]), _pack(counts[low:high].astype("<u4"))


_REQUEST = "block string, part int, ngram int, n bigint, grams binary, counts binary"


def _frame(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in names.split(", ")])


_REQUEST_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _count_part(table: pa.Table) -> pa.Table:
    """The answers of one part: for every request the counts in the corpus, in the order asked."""
    rows = table.to_pylist()
    out = []
    for order in {r["ngram"] for r in rows}:
        asked = [(r, _unpack_sorted(r["grams"], r["n"])) for r in rows if r["ngram"] == order]
        grams, where = np.unique(np.concatenate([g for _, g in asked]), return_inverse=True)
        total = np.bincount(where, np.concatenate([_unpack(r["counts"], r["n"], "<u4") for r, _ in asked])).astype("<i8")
        at = 0
        for r, g in asked:
            out.append((r["block"], r["part"], order, r["n"], None, _pack(total[where[at:at + len(g)]])))
            at += len(g)
    return _frame(out, _REQUEST, _REQUEST_KINDS)


def stupid_backoff(docs: DataFrame, *, key: str = "doc_id", text: str = "text", discount: float = DISCOUNT, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """One row per row of ``docs``: key, ``n_words``, ``log_score`` (natural logarithms, summed), ``mean_log_score`` (null without words)
    and how many words were scored by a trigram, a bigram, as a single word, or not seen elsewhere at all.

    Words are runs of anything but ASCII white space, A-Z in lower case. With counts c of the other rows and N words in them, a word scores
    c(abc)/c(ab), else d c(bc)/c(b), else d^2 c(c)/N, else d^3/(N + 1); with less context the longer n-grams are not tried, but the
    discounts are the same. Every row counts, so a repeated document is seen by its copies. Null and empty texts have no words and score 0;
    other columns are ignored; an empty table gives an empty result.

    A block sends a row to every part it has n-grams of, so rows grow as words^2 / (block_words * part_words). The defaults fit a gigabyte
    of memory per task; with more memory take larger ones (2^24 and 2^27 for 10^13 words: about 150 n-grams a row).
    """
    id_type = id_column(docs, key)
    docs = as_written(docs).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    total_words = docs.select("text").mapInArrow(_count_words, "n bigint").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total_words // part_words))
    blocks = _blocks(docs, "id", "text", block_words)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch.slice(i, 1).to_pylist()[0])
                rows = list(_requests(b.name, 1, b.vocabulary, np.bincount(b.codes, minlength=len(b.vocabulary)), parts))
                rows += _requests(b.name, 2, b.bigrams, np.bincount(b.bigram_at, minlength=len(b.bigrams)), parts)
                yield from _frame(rows, _REQUEST, _REQUEST_KINDS).to_batches()

    answers = blocks.mapInArrow(ask, _REQUEST).groupBy("part").applyInArrow(_count_part, _REQUEST).drop("grams")

    def counts_of(right: pa.Table) -> dict[int, np.ndarray]:
        """The answers to a block, by order, in the order of its sorted n-grams."""
        got = sorted(((r["ngram"], r["part"], r["n"], r["counts"]) for r in right.to_pylist()), key=lambda r: r[:2])
        return {order: np.concatenate([np.zeros(0, np.int64), *[_unpack(c, n, "<i8") for o, _, n, c in got if o == order]]) for order in (1, 2, 3)}

    def ask_trigrams(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _frame([], _REQUEST, _REQUEST_KINDS)
        b, counts = _Block(left.to_pylist()[0]), counts_of(right)
        pairs = b.backed_off(counts[1], counts[2], total_words, discount)[2]
        _, grams, which = b.trigrams(pairs)
        return _frame(list(_requests(b.name, 3, grams, np.bincount(which, minlength=len(grams)), parts)), _REQUEST, _REQUEST_KINDS)

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _frame([], out_schema, out_kinds)
        b, counts = _Block(left.to_pylist()[0]), counts_of(right)
        value, level, pairs = b.backed_off(counts[1], counts[2], total_words, discount)
        at, grams, which = b.trigrams(pairs)
        if len(at):
            others = counts[3][which] - _own(which, b.doc[at], len(b.lengths))
            at, others = at[others > 0], others[others > 0]
            value[at] = np.log(others) - np.log(pairs[at - 2])
            level[at] = 0
        docs = len(b.lengths)
        levels = [np.bincount(b.doc[level == k], minlength=docs) for k in range(4)]
        return pa.table([left.column("ids")[0].values, *[pa.array(x) for x in (b.lengths, np.bincount(b.doc, value, docs), *[x.astype(np.int64) for x in levels])]], names=names)

    names = ["id", "n_words", "log_score", *_COUNTS]
    out_schema = f"id {id_type}, n_words bigint, log_score double, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    out_kinds = [to_arrow_type(docs.schema["id"].dataType), pa.int64(), pa.float64(), *[pa.int64()] * 4]
    by_block = blocks.groupBy("block")
    more = by_block.cogroup(answers.groupBy("block")).applyInArrow(ask_trigrams, _REQUEST).groupBy("part").applyInArrow(_count_part, _REQUEST).drop("grams")
    rows = by_block.cogroup(answers.unionByName(more).groupBy("block")).applyInArrow(score_block, out_schema)
    score = F.round("log_score", 4) + F.lit(0.0)
    return rows.select(F.col("id").alias(key), "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"), *_COUNTS)
