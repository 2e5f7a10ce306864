"""Benchmark decontamination by templates: finds benchmark questions in documents, also with other numbers, names and units.

Texts become template tokens: lower-cased words without outer punctuation, where a number, a name or a unit is a typed placeholder and
its value is a slot. Windows of five tokens are hashed and joined with the windows of the benchmark, in three forms: with placeholders for
numbers and units (names as lower-cased words, so capitals and line breaks do not matter), with placeholders for names as well where there
are any, and as lower-cased words with all values where fewer than three plain words would be left. A window counts for an item only if
its slots agree with one mapping from the item's values to the document's values: every value of the item must become the same value
wherever it stands in an occurrence. A document is contaminated by an item if four fifths of all runs of five words of the item
stand in windows found so, in one occurrence or in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countspark.llm.common import WORD_BYTES, bytes_of, groups, id_column, mix, runs, slices, stretch_hashes
from countspark.session import keep, small

WIDTH = 5
COVERAGE = 0.8
#: Template tokens of a window that must be plain words.
LITERALS = 3
#: Units and number words: fixed values, extend as needed.
UNITS = """mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons
ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years
dollar dollars cent cents euro euros percent mph kmh""".split()
NUMBERS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty
fifty sixty seventy eighty ninety hundred thousand million billion""".split()

_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[0x30:0x3A] = _PUNCT[0x41:0x5B] = _PUNCT[0x61:0x7B] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;|\"'([{-#*=>")] = True
_PLAIN = np.uint64(1 << 32)
_NUMBER, _NAME, _UNIT = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _known(words: list[str]) -> np.ndarray:
    return np.sort(runs([w.encode() for w in words])[1])


_UNIT_HASHES, _NUMBER_HASHES = _known(UNITS), _known(NUMBERS)


def _words(texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """The words of several texts without outer punctuation: joined bytes, starts, ends, text, whether first of a sentence or line, and hashes."""
    joined, _, owner, starts, lengths = runs(texts, WORD_BYTES)
    if len(starts) == 0:
        return None
    ends = starts + lengths
    last = joined[ends - 1]
    # white space before a word decides whether it begins a line
    new_line = np.ones(len(starts), bool)
    new_line[1:] = np.add.reduceat((joined == 10).astype(np.int32), np.stack((ends[:-1], starts[1:]), 1).ravel())[::2] > 0
    new_text = np.ones(len(starts), bool)
    new_text[1:] = owner[1:] != owner[:-1]
    first = new_line | new_text
    first[1:] |= _ENDS[last[:-1]]
    # outer punctuation goes, a few bytes at either end at most per round
    while True:
        cut = _PUNCT[joined[np.minimum(starts, len(joined) - 1)]] & (starts < ends)
        if not cut.any():
            break
        starts = starts + cut
    while True:
        cut = (starts < ends) & _PUNCT[joined[ends - 1]]
        if not cut.any():
            break
        ends = ends - cut
    full = ends > starts
    starts, ends, owner, first = starts[full], ends[full], owner[full], first[full]
    if len(starts) == 0:
        return None
    return joined, starts, ends, owner, first, stretch_hashes(joined, starts, ends)


def template(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of several texts: code, slot value (0 for plain words), text, and whether a plain word.

    A number is a word with a digit in front (behind currency signs) or a number word; a unit is a known unit; a name is a capitalised
    word that does not begin a sentence or a line. Neighbouring names are one slot with the value of the first.
    """
    found = _words(texts)
    if found is None:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, bool))
    owner, hashes, kind = found[3], found[5], _kinds(found)
    code = np.choose(kind, [hashes, _NUMBER, _UNIT, _NAME])
    value = np.where(kind == 0, np.uint64(0), hashes)
    again = np.zeros(len(code), bool)
    again[1:] = (kind[1:] == 3) & (kind[:-1] == 3) & (owner[1:] == owner[:-1])
    return code[~again], value[~again], owner[~again], kind[~again] == 0


def _kinds(found: tuple[np.ndarray, ...]) -> np.ndarray:
    """Per word: 0 plain, 1 number, 2 unit, 3 name."""
    joined, starts, ends, _, first, hashes = found
    head = joined[starts]
    second = joined[np.minimum(starts + 1, len(joined) - 1)]
    number = _DIGIT[head] | np.isin(hashes, _NUMBER_HASHES)
    unit = ~number & np.isin(hashes, _UNIT_HASHES)
    name = ~number & ~unit & ~first & _UPPER[head] & ((ends - starts == 1) | ~_UPPER[second])
    return np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))


def windows(texts: list[bytes], bits: np.ndarray | None = None, width: int = WIDTH) -> Iterator[tuple[np.ndarray, ...]]:
    """For groups of texts: text (its position), hash, first word, number of words, and slot values (windows, width) of their windows.

    Every five words in a row give one window, with placeholders for numbers and units if at least ``LITERALS`` plain words are left, else as
    they are; windows of five tokens with folded names come besides. With ``bits`` only windows whose hash hits the map are given.
    """
    def chosen(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if bits is not None:
            hit = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
            return h[hit], at[hit]
        return h, at

    def sums(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags)))
        return upto[width:] - upto[:-width]

    tail = name_tail = None  # the last tokens of the piece before, if its text goes on
    for at, part in groups(texts):
        found = _words(part)
        if found is None:
            continue
        row, h, kind = np.array(at)[found[3]], found[5], _kinds(found)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        words = [row, place, h, kind]
        if tail is not None and tail[0][-1] == row[0]:
            place[row == row[0]] += tail[1][-1] + 1
            words = [np.concatenate(x) for x in zip(tail, words)]
        else:
            name_tail = None
        tail = [x[max(0, len(x) - width + 1):][row_of == words[0][-1]] for x in words for row_of in [words[0][max(0, len(x) - width + 1):]]]
        row, place, h, kind = words
        if len(row) >= width:
            slot = (kind == 1) | (kind == 2)
            code = np.where(kind == 1, _NUMBER, np.where(kind == 2, _UNIT, h))
            whole = row[:1 - width] == row[width - 1:]
            open_ = sums(~slot) >= LITERALS
            some = np.flatnonzero(whole & open_)
            hashed, some = chosen(_hashed(code, some, width), some)
            yield row[some], hashed, place[some], np.full(len(some), width), np.stack([np.where(slot[some + k], h[some + k], np.uint64(0)) for k in range(width)], 1)
            some = np.flatnonzero(whole & ~open_)
            hashed, some = chosen(_hashed(h, some, width, _PLAIN + np.uint64(width)), some)
            yield row[some], hashed, place[some], np.full(len(some), width), np.zeros((len(some), width), np.uint64)
        # names folded: the words of this piece only, behind the last tokens of the one before
        new = len(row) - len(found[5])
        row, place, h, kind = (x[new:] for x in words)
        again = np.zeros(len(row), bool)
        again[1:] = (kind[1:] == 3) & (kind[:-1] == 3) & (row[1:] == row[:-1])
        first = np.flatnonzero(~again)
        folded = [row[first], place[first], place[np.append(first[1:], len(row)) - 1] + 1, h[first], kind[first]]
        if name_tail is not None:
            folded = [np.concatenate(x) for x in zip(name_tail, folded)]
        row, place, end, h, kind = folded
        last = slice(max(0, len(row) - width + 1), None)
        name_tail = [x[last][row[last] == row[-1]] for x in folded]
        if len(row) >= width and (kind == 3).any():
            some = np.flatnonzero((row[:1 - width] == row[width - 1:]) & (sums(kind == 3) > 0) & (sums(kind == 0) >= LITERALS))
            code = np.choose(kind, [h, _NUMBER, _UNIT, _NAME])
            hashed, some = chosen(_hashed(code, some, width), some)
            yield row[some], hashed, place[some], end[some + width - 1] - place[some], np.stack([np.where(kind[some + k] > 0, h[some + k], np.uint64(0)) for k in range(width)], 1)


def _hashed(codes: np.ndarray, at: np.ndarray, width: int, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Hashes of the windows that begin at ``at``."""
    h = np.full(len(at), seed)
    h = mix(h) if seed else h
    for k in range(width):
        h = mix(h ^ codes[at + k])
    return h


def plain_windows(texts: list[bytes], widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per text (its position) and width: hashes of its windows of lower-cased words as they are, their places, and the width.

    Windows at the seams of a long text can come twice, alike.
    """
    waiting: dict[int, tuple[np.ndarray, int]] = {}
    for at, part in groups(texts):
        found = _words(part)
        if found is None:
            continue
        owner, hashes = found[3], found[5]
        edges = np.searchsorted(owner, np.arange(len(part) + 1))
        for i, row in enumerate(at):
            carry, base = waiting.pop(row, (np.zeros(0, np.uint64), 0))
            now = np.concatenate((carry, hashes[edges[i]:edges[i + 1]]))
            for width in widths:
                n = len(now) - width + 1
                if n > 0:
                    h = mix(np.full(n, _PLAIN + np.uint64(width)))
                    for k in range(width):
                        h = mix(h ^ now[k:n + k])
                    yield row, h, base + np.arange(n), width
            cut = max(0, len(now) - max(widths) + 1)
            waiting[row] = (now[cut:], base + cut)


def _window_rows(docs: DataFrame, keys: list[str], sieve: bytes | None, widths: list[int] | None = None) -> DataFrame:
    """One row per window: the key columns, ``h``, ``place`` (of its first word), ``span`` (words), ``slots`` (values of the placeholders, in order).

    ``sieve`` is a bit map of fixed size; windows whose hash is not in it cannot match and are not sent to Spark. Shorter windows of words
    as they are have the ``widths``; without these, a text of fewer than ``WIDTH`` words is one window.
    """
    bits = None if sieve is None else np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little").astype(bool)
    ids = ", ".join(f"{k} {id_column(docs, k)}" for k in keys)

    def all_forms(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        seen = set()
        for found in windows(texts, bits):
            if widths is None:
                seen.update(found[0].tolist())
            yield found
        if widths is None:
            short = [(i, list(plain_windows([texts[i]], list(range(1, WIDTH))))) for i in sorted(set(range(len(texts))) - seen)]
            some = [(i, h, place, width) for i, whole in short for _, h, place, width in whole if width == max(w for *_, w in whole)]
        else:
            some = plain_windows(texts, widths) if widths else ()
        for i, h, place, width in some:
            if bits is not None:
                hit = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
                h, place = h[hit], place[hit]
            yield np.full(len(h), i), h, place, np.full(len(h), width), np.zeros((len(h), WIDTH), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keys)):
            parts = [f for f in all_forms(bytes_of(batch.column(len(keys)))) if len(f[0])]
            if not parts:
                continue
            row, h, place, span, value = (np.concatenate(x) for x in zip(*parts))
            offsets = np.concatenate(([0], np.cumsum((value != 0).sum(1)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[value != 0].view(np.int64)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], pa.array(h.view(np.int64)),
                                              pa.array(place.astype(np.int64)), pa.array(span.astype(np.int32)), lists], [*keys, "h", "place", "span", "slots"])

    return docs.select(*keys, "text").mapInArrow(run, f"{ids}, h bigint, place bigint, span int, slots array<bigint>")


def _covered(spans: Column, unit: Column) -> Column:
    """How many runs of ``unit`` words of an item lie in the stretches ``array<struct<place, span>>`` of found windows."""
    words = F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["item_place"], x["item_place"] + x["span"] - 1)))))

    def runs_of(w: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(w) - unit), lambda i: F.get(w, i + unit - 1) - F.get(w, i) == unit - 1)
        return F.when(F.size(w) >= unit, F.size(found)).otherwise(0).cast("bigint")

    return F.transform(F.array(words), runs_of)[0]  # the words are a variable here, so they are put together once


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, sieve_bits: int = 22) -> DataFrame:
    """One row per document and benchmark item that it holds: ``key``, ``row_hash``, ``item_id``, ``n_windows``, ``matched``,
    ``coverage``, ``changed_slots`` (values of the item that the document replaces by others), of the occurrence that matches best.

    ``n_windows`` counts the runs of five words of the item, ``matched`` those whose words all stand in windows that are found. Items of fewer
    than five words are one window of all words as they are (lower-cased). Items without words, or null, match nothing; null and empty documents
    hold nothing.
    Repeated documents (same key and text) give one row, as do repeated items; items are told apart by id and text. Other columns are
    ignored. Keys may be null or repeated: ``row_hash`` is the hash of key and text.
    """
    items = benchmark.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    wanted = keep(_window_rows(items.select("item", "item_id", "text"), ["item", "item_id"], None))
    if wanted.isEmpty():
        return docs.select(F.col(key), F.lit(0).cast("bigint").alias("row_hash"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"),
                           F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("matched"), F.lit(0.0).alias("coverage"),
                           F.lit(0).cast("bigint").alias("changed_slots")).where(F.lit(False))
    totals = wanted.groupBy("item").agg(F.max(F.col("place") + F.col("span")).alias("words")).select(F.col("item").alias("of"), F.least("words", F.lit(WIDTH)).alias("unit"), "words")
    totals = small(totals.select("of", F.col("unit").cast("int").alias("unit"), (F.col("words") - F.col("unit") + 1).alias("n_windows")))
    # the sieve has one bit per value of the low bits of a hash: 2**sieve_bits of them, whatever the benchmark's size
    cells = wanted.select((F.col("h").bitwiseAND(F.lit((1 << sieve_bits) - 1))).alias("c")).distinct()
    bitmap = cells.groupBy((F.col("c") / 32768).cast("int").alias("part")).agg(F.collect_set((F.col("c") % 32768).cast("int")).alias("bits"))
    sieve = np.zeros(1 << sieve_bits, np.uint8)
    for row in bitmap.collect():
        sieve[row["part"] * 32768 + np.array(row["bits"])] = 1
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    widths = sorted(r["span"] for r in wanted.where(F.col("span") < WIDTH).select("span").distinct().collect())  # fewer than five
    found = _window_rows(rows, ["id", "row"], np.packbits(sieve, bitorder="little").tobytes(), widths)
    items_side = small(wanted.select("item", "item_id", F.col("h").alias("item_h"), F.col("place").alias("item_place"), F.col("span").alias("item_span"), F.col("slots").alias("item_slots")))
    hits = keep(found.join(items_side, F.col("h") == F.col("item_h")).select("id", "row", "place", "slots", "item", "item_id", "item_place", F.col("item_span").alias("span"), "item_slots").distinct())
    # an occurrence is an alignment: hits whose places in document and item differ by nearly the same, by 4 and by the item's length (two
    # occurrences are further apart than that), each in two dealings that overlap by half; and the whole document, for scattered windows
    hits = hits.join(totals, F.col("item") == F.col("of")).drop("of")
    apart = F.col("place") - F.col("item_place")
    lines = [F.lit(0).cast("bigint")]
    for scale, (wide, shift) in enumerate(((F.lit(4), 0), (F.lit(4), 2), (F.col("n_windows"), 0), (F.col("n_windows"), F.floor(F.col("n_windows") / 2))), 1):
        lines.append(F.floor((apart + shift) / wide) * 8 + scale)
    hits = hits.withColumn("line", F.explode(F.array(*lines)))
    spans = F.collect_set(F.struct("item_place", "span")).alias("spans")
    whole = hits.groupBy("row", "item", "line", "n_windows", "unit").agg(spans)
    whole = whole.where(_covered(F.col("spans"), F.col("unit")) >= F.lit(coverage) * F.col("n_windows")).select(*[F.col(c).alias(f"_w_{c}") for c in ("row", "item", "line")])
    hits = keep(hits.join(whole, [F.col(c) == F.col(f"_w_{c}") for c in ("row", "item", "line")], "left_semi"))
    # slot consistency: one document value per item value of an alignment, the most frequent one (ties: the smaller)
    here = ["row", "item", "line"]
    pairs = hits.where("size(slots) > 0").select(*here, "place", "item_place", "span", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    pairs = pairs.select(*here, "place", "item_place", "span", F.col("s.item_slots").alias("theirs"), F.col("s.slots").alias("ours"))
    votes = pairs.groupBy(*here, "theirs", "ours").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy(*here, "theirs").agg(F.max(F.struct("n", (-F.col("ours")).alias("ours"))).alias("best")).select(
        F.col("row").alias("_r"), F.col("item").alias("_i"), F.col("line").alias("_l"), F.col("theirs").alias("_t"), (-F.col("best.ours")).alias("_o"))
    on_line = (F.col("row") == F.col("_r")) & (F.col("item") == F.col("_i")) & (F.col("line") == F.col("_l"))
    bad = pairs.join(chosen, on_line & (F.col("theirs") == F.col("_t"))).where("ours <> _o").select(*[F.col(c).alias(f"_b_{c}") for c in (*here, "place", "item_place")]).distinct()
    ok = hits.join(bad, [F.col(c) == F.col(f"_b_{c}") for c in (*here, "place", "item_place")], "left_anti")
    per = ok.groupBy("id", *here, "item_id", "n_windows", "unit").agg(spans).withColumn("matched", _covered(F.col("spans"), F.col("unit"))).drop("spans", "unit")
    per = per.where(F.col("matched") >= F.lit(coverage) * F.col("n_windows"))
    changed = chosen.where("_t <> _o").groupBy("_r", "_i", "_l").agg(F.count(F.lit(1)).alias("changed"))
    per = per.join(changed, on_line, "left").withColumn("changed", F.coalesce("changed", F.lit(0)).cast("bigint"))
    # of several occurrences the one with most windows counts, then the one with the fewest changed values
    per = per.groupBy("id", "row", "item", "item_id", "n_windows").agg(F.max(F.struct("matched", (-F.col("changed")).alias("same"))).alias("best"))
    return per.select(F.col("id").alias(key), F.col("row").alias("row_hash"), "item_id", "n_windows", F.col("best.matched").alias("matched"),
                      (F.col("best.matched") / F.col("n_windows")).alias("coverage"), (-F.col("best.same")).alias("changed_slots"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all other rows unchanged."""
    gone = keep(contaminated(docs, benchmark).select(F.col("row_hash").alias("gone")).distinct())
    return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["gone"], "left_anti")
