"""Alignment of two tokenizers over the same texts, and how their tokens go together in a corpus.

A text is encoded by both tokenizers; each gives a rising array of byte offsets where its tokens end. Offsets in both arrays cut the text
into groups of tokens of either side. They are found by skipping along diagonals: while token ``i`` of one side ends where token
``i + shift`` of the other does, windows of doubled length are compared at that shift, and a whole stretch of one-to-one groups is
passed at once; where the ends differ, the side that is behind advances until both meet, which closes an irregular group and gives the
next shift. Texts are cut into lanes at common ends, and numpy moves all lanes of a batch at the same time.

Linked pairs of ids are counted by Spark: one row per text and pair, partial counts, and a join back in which pairs that a large share
of the texts hold are broadcast (their number is bounded) and all others shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from countspark.llm.common import id_column
from countspark.session import keep, keep_measured, small

#: Folder of the vocabulary files; they are read by the driver and travel with the tasks.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters encoded at once, tokens of a lane, ends that are looked through for the start of a lane, links of a group listed one by one.
BATCH, LANE, LOOK, LISTED = 1 << 20, 256, 48, 1024
#: A pair of ids is ``first << ID_BITS | second``; a batch has fewer than 2 ** 15 texts.
ID_BITS = 24
#: Distinct words, and their characters, whose tokens a task remembers; words that are encoded in one go.
WORDS, WORD_CHARS, JOINED = 1 << 19, 1 << 25, 64
#: Pairs with more than one in so many of all (text, pair) rows are joined by broadcast; there are fewer than that.
HEAVY = 200_000
#: Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Both tokenizers start a token at blanks that stand between other characters than white space and a character other than a blank.
_BORDER = re.compile(r"(?<=\S)(?=\x20+[^\x20])")
_WIDE = re.compile(r"\s\x20")

Encode = Callable[[list[str]], list[list[int]]]


def _byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(data: bytes) -> tuple[Encode, list[bytes]]:
    """Encoder without special tokens of a byte-level vocabulary, and the bytes of its ids.

    If ids follow the order of merges, as they do in the public vocabularies, they are given to the faster library as ranks.
    """
    spec = json.loads(data)
    vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
    entries = {name: i for name, i in vocab.items() if all(c in alphabet for c in name)}
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    of = [b""] * size
    for name, i in entries.items():
        of[i] = bytes(alphabet[c] for c in name)
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    ranked = all(vocab[m] == 256 + i for i, m in enumerate(merges)) and {vocab[c] for c in alphabet} == set(range(256))
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if ranked and plain:
        fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks={of[i]: i for i in range(256 + len(merges))}, special_tokens={})
        return lambda texts: [fast.encode_ordinary(t) for t in texts], of
    own = Tokenizer.from_str(data.decode())
    own.encode_special_tokens = True
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)], of


def piece_level(data: bytes) -> tuple[Encode, list[bytes], bool]:
    """Encoder of a vocabulary of pieces, the bytes of its ids, and whether words can be encoded one by one (no piece crosses a border)."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    kept = "xÅﬁ ́ e  y"  # a normaliser that changes or folds anything would show here
    by_word = not any("▁" in p.lstrip("▁") for p in pieces) and model.normalize(kept).replace("▁", " ").strip() == kept
    return lambda texts: model.encode(texts, num_threads=1), of, by_word


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start … start + length - 1`` of all stretches in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Numbers(dict):
    """Numbers words in the order they are met; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Words:
    """Tokens of both sides for words met so far; ids and ends are looked up for many words at once."""

    def __init__(self, first: bytes, second: bytes):
        self.encode_a, self.bytes_a = byte_level(first)
        self.encode_b, self.bytes_b, self.by_word = piece_level(second)
        self.width_a, self.width_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.chars = 0
        none = np.zeros(0, np.int64)
        self.flat, self.start, self.count, self.wrong = [none, none], [none, none], [none, none], np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        # words that end with white space may merge with a blank behind them: these are encoded one by one, behind the others
        ragged = np.array([not w or w[-1].isspace() or not self.by_word for w in new], bool)
        order = np.argsort(ragged, kind="stable")
        new, plain = [new[i] for i in order.tolist()] if ragged.any() else new, int((~ragged).sum())
        place = np.argsort(order)
        data = (" " + " ".join(new[:plain])).encode() if plain else b""
        ends = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in new[:plain]])
        wrong = np.zeros(len(new), bool)
        for s, (encode, of, width) in enumerate(((self.encode_a, self.bytes_a, self.width_a), (self.encode_b, self.bytes_b, self.width_b))):
            first = " " if s == 0 else ""  # the second side adds the blank itself
            ids = encode([first + " ".join(new[i:i + JOINED]) for i in range(0, plain, JOINED)])
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            upto = np.zeros(0, np.int64)
            if b"".join(map(of.__getitem__, chain.from_iterable(ids))) == data:
                single = new[plain:]
                upto = np.searchsorted(np.cumsum(width[flat]), ends) + 1
            else:  # some word is spelt otherwise: look at each
                single, flat = new, flat[:0]
            ids = encode([first + w for w in single])
            at = len(new) - len(single)
            wrong[at:] |= np.array([b"".join(map(of.__getitem__, x)) != (" " + w).encode() for w, x in zip(single, ids)], bool)
            flat = np.concatenate((flat, np.fromiter(chain.from_iterable(ids), np.int64)))
            count = np.concatenate((np.diff(upto, prepend=0), np.array([len(x) for x in ids], np.int64)))
            self.start[s] = np.concatenate((self.start[s], (len(self.flat[s]) + np.cumsum(count) - count)[place]))
            self.count[s] = np.concatenate((self.count[s], count[place]))
            self.flat[s] = np.concatenate((self.flat[s], flat))
        self.wrong = np.concatenate((self.wrong, wrong[place]))
        self.chars += sum(map(len, new))

    def numbers(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new, self.number.new = self.number.new, []
        if new:
            self._learn(new)
        return found

    def tokens(self, numbers: np.ndarray, side: int) -> np.ndarray:
        return self.flat[side][_ragged(self.start[side][numbers], self.count[side][numbers])]


def word_pieces(text: str, by_word: bool = True, size: int = BATCH) -> Iterator[list[str]]:
    """Words of a text, each without the blank before it, in pieces of about ``size`` characters cut between words.

    A word may hold further white space; the parts joined by blanks are the text.
    """
    if not by_word:
        yield [text]
        return
    text, at = " " + text, 0
    while at < len(text):
        cut = _BORDER.search(text, at + size) if len(text) - at > size else None
        part = text[at:cut.start()] if cut else text[at:]
        at += len(part)
        if part.endswith(" ") or _WIDE.search(part):
            yield [w[1:] for w in _BORDER.split(part)]
        else:
            yield part[1:].split(" ")


def _next_common(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """First positions from ``i`` and ``j`` with equal values, by windows of doubled length."""
    width = 64
    while True:
        part = a[i:i + width]
        upto = j + int(np.searchsorted(b[j:], part[-1], side="right"))
        hit = np.flatnonzero(np.isin(part, b[j:upto], assume_unique=True))
        if len(hit):
            return i + int(hit[0]), j + int(np.searchsorted(b[j:], part[hit[0]]))
        i, j, width = i + len(part), upto, width * 2


def common_ends(a: np.ndarray, b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Where two strictly rising arrays with the same last value are equal: positions in ``a`` and in ``b``, rising."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lanes of about equal length start behind a common end
    some = np.minimum(np.arange(lane, max(len(a) - lane // 2, lane), lane)[:, None] + np.arange(min(LOOK, lane)), len(a) - 1)
    there = np.minimum(np.searchsorted(b, a[some]), len(b) - 1)
    hit = b[there] == a[some]
    good, first = hit.any(1), hit.argmax(1)
    row = np.flatnonzero(good)
    i = np.concatenate(([0], some[row, first[row]] + 1))
    j = np.concatenate(([0], there[row, first[row]] + 1))
    inside = np.concatenate(([True], (np.diff(i) > 0))) & (i < len(a))
    i, j = i[inside], j[inside]
    stop, stop_b = np.append(i[1:], len(a)), np.append(j[1:], len(b))
    width = np.ones(len(i), np.int64)
    found_a, found_b = [], []
    while len(i):
        # probe: compare both sides at the current shift, over a window that doubles while it holds
        w = np.minimum(width, np.minimum(stop - i, stop_b - j))
        ends = np.cumsum(w)
        step = np.arange(ends[-1]) - np.repeat(ends - w, w)
        at_a, at_b = np.repeat(i, w) + step, np.repeat(j, w) + step
        run = np.minimum.reduceat(np.where(a[at_a] == b[at_b], np.repeat(w, w), step), ends - w)
        held = step < np.repeat(run, w)
        found_a.append(at_a[held])
        found_b.append(at_b[held])
        i, j = i + run, j + run
        width = np.where(run == w, width * 2, 1)
        # an irregular group: the side that is behind advances until both ends meet
        left = np.flatnonzero((run < w))
        for _ in range(32):
            if not len(left):
                break
            x, y = a[i[left]], b[j[left]]
            i[left] += x <= y
            j[left] += y <= x
            met = x == y
            if met.any():
                found_a.append(i[left[met]] - 1)
                found_b.append(j[left[met]] - 1)
                left = left[~met]
        for k in left.tolist():  # the few long ones
            i[k], j[k] = _next_common(a, int(i[k]), b, int(j[k]))
            found_a.append(i[k:k + 1].copy())
            found_b.append(j[k:k + 1].copy())
            i[k] += 1
            j[k] += 1
        live = i < stop
        i, j, stop, stop_b, width = i[live], j[live], stop[live], stop_b[live], width[live]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 0 … size - 1 (up to seven digits): digits as bytes of a word, their number, and a word with ones where digits or one more byte stand."""
    texts = [str(i).encode() for i in range(size)]
    words = lambda parts: np.frombuffer(b"".join(p.ljust(8, b"\0") for p in parts), "<u8")
    return words(texts), np.array([len(t) for t in texts], np.uint64), words(b"\1" * (len(t) + 1) for t in texts)


class Aligner:
    """Aligns many texts at once; one per task."""

    def __init__(self, first: bytes, second: bytes):
        self.words = Words(first, second)
        self.digits, self.length, self.filled = _decimals(max(len(self.words.bytes_a), len(self.words.bytes_b)))

    def _digest_parts(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;…`` of all groups, and where the part of each group ends; every group ends with a semicolon."""
        n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint64)
        ids[np.arange(len(a)) + np.repeat(end_b - n_b, n_a)] = a
        ids[np.arange(len(b)) + np.repeat(end_a, n_b)] = b
        mark[end_a + end_b - n_b - 1] = ord("|")
        mark[end_a + end_b - 1] = ord(";")
        length = self.length[ids]
        words = self.digits[ids] | mark << (length * np.uint64(8))
        upto = np.cumsum(length + np.uint64(1)).astype(np.int64)
        return words.view(np.uint8)[self.filled[ids].view(bool)], upto[end_a + end_b - 1]

    def _links(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text number (``of`` each group) and pair of ids: ``(text, pair, times)``."""
        n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        start_a, start_b, links = end_a - n_a, end_b - n_b, n_a * n_b
        short = np.flatnonzero(links <= LISTED)
        k, wide = _ragged(np.zeros(len(short), np.int64), links[short]), np.repeat(n_b[short], links[short])
        left, right = np.repeat(start_a[short], links[short]) + k // wide, np.repeat(start_b[short], links[short]) + k % wide
        key = np.sort(np.repeat(of[short], links[short]) << 2 * ID_BITS | a[left] << ID_BITS | b[right])
        at = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[at], np.diff(at, append=len(key))
        texts, pairs, times = [key >> 2 * ID_BITS], [key & (1 << 2 * ID_BITS) - 1], [n]
        for g in np.flatnonzero(links > LISTED).tolist():  # in a long group each distinct pair once, with its number
            x, n = np.unique(a[start_a[g]:end_a[g]], return_counts=True)
            y, m = np.unique(b[start_b[g]:end_b[g]], return_counts=True)
            texts.append(np.full(len(x) * len(y), of[g]))
            pairs.append((x[:, None] << ID_BITS | y).ravel())
            times.append((n[:, None] * m).ravel())
        return _summed(np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)) if len(texts) > 1 else (texts[0], pairs[0], times[0])

    def batch(self, parts: list[list[str]]) -> list[tuple]:
        """Per part (words of one text): ``(wrong, n_a, n_b, n_groups, n_links, bytes of the groups, pairs, times)``."""
        words = self.words
        if len(words.number) > WORDS or words.chars > WORD_CHARS:
            words.forget()
        numbers = words.numbers([w for part in parts for w in part])
        bad = words.wrong[numbers]
        part_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        wrong = np.bincount(part_of, bad, minlength=len(parts)) > 0
        numbers, part_of = numbers[~wrong[part_of]], part_of[~wrong[part_of]]
        a, b = words.tokens(numbers, 0), words.tokens(numbers, 1)
        n_a, n_b = (np.bincount(part_of, words.count[s][numbers], minlength=len(parts)).astype(np.int64) for s in (0, 1))
        at_a, at_b = common_ends(np.cumsum(words.width_a[a]), np.cumsum(words.width_b[b]))
        end_a, end_b = at_a + 1, at_b + 1
        of = np.searchsorted(np.cumsum(n_a), end_a)
        per = np.diff(end_a, prepend=0) * np.diff(end_b, prepend=0)
        groups = np.bincount(of, minlength=len(parts))
        links = np.zeros(len(parts), np.int64)
        np.add.at(links, of, per)
        text, upto = self._digest_parts(a, b, end_a, end_b) if len(a) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        last = np.cumsum(groups)
        ends = np.concatenate(([0], upto))[last]
        doc, pairs, times = self._links(a, b, end_a, end_b, of) if len(a) else (np.zeros(0, np.int64),) * 3
        cut = np.searchsorted(doc, np.arange(len(parts) + 1))
        return [(bool(wrong[p]), int(n_a[p]), int(n_b[p]), int(groups[p]), int(links[p]), text[(ends[p - 1] if p else 0):ends[p]].tobytes(),
                 pairs[cut[p]:cut[p + 1]], times[cut[p]:cut[p + 1]]) for p in range(len(parts))]

    def texts(self, texts: Iterator[str | None]) -> Iterator[tuple]:
        """Per text ``(n_a, n_b, n_groups, n_links, digest, pairs, times)``; long texts pass in pieces."""
        waiting: list[tuple[list[str], bool]] = []
        size, state = 0, None
        for value in texts:
            pieces = word_pieces(value, self.words.by_word) if value else iter([[]])
            piece = next(pieces)
            while piece is not None:
                after = next(pieces, None)
                waiting.append((piece, after is None))
                size += sum(map(len, piece)) + len(piece)
                if size >= BATCH:
                    state = yield from self._finish(waiting, state)
                    waiting, size = [], 0
                piece = after
        yield from self._finish(waiting, state)

    def _finish(self, waiting: list[tuple[list[str], bool]], state: list | None):
        for (_, last), (wrong, n_a, n_b, groups, links, told, pairs, times) in zip(waiting, self.batch([p for p, _ in waiting])):
            if state is None:
                state = [False, 0, 0, 0, 0, hashlib.sha256(), b"", [], []]
            state[0] |= wrong
            for k, n in enumerate((n_a, n_b, groups, links), 1):
                state[k] += n
            state[5].update(state[6] + told[:-1])
            state[6] = told[-1:]  # the semicolon waits for a further group
            state[7].append(pairs)
            state[8].append(times)
            if len(state[7]) > 16 or last and len(state[7]) > 1:
                _, p, t = _summed(np.zeros(sum(map(len, state[7])), np.int64), np.concatenate(state[7]), np.concatenate(state[8]))
                state[7], state[8] = [p], [t]
            if last:
                none = np.zeros(0, np.int64)
                if state[0] or not state[3]:
                    yield 0, 0, 0, 0, "", none, none
                else:
                    yield *state[1:5], state[5].hexdigest(), state[7][0], state[8][0]
                state = None
        return state


def _summed(texts: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times summed per text and pair, in order."""
    order = np.lexsort((pairs, texts))
    texts, pairs, times = texts[order], pairs[order], times[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    return texts[at], pairs[at], np.add.reduceat(times, at) if len(at) else times


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(first: bytes, second: bytes) -> Aligner:
    """The aligner of a Python worker, built once."""
    name = hashlib.sha256(first + second).digest()
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(first, second)
    return _ALIGNERS[name]


def aligned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, first: str = BYTE_BPE, second: str = PIECE_BPE) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups_sha256, links: array<struct<pair, times>>)`` per row; a pair is ``(id of the first) << ID_BITS | (id of the second)``."""
    vocabularies = [base64.b64encode(Path(folder, name).read_bytes()) for name in (first, second)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(*map(base64.b64decode, vocabularies))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = list(work.texts(v.as_py() for v in part.column(1)))
                told = list(zip(*rows))
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in told[5]])))
                links = pa.StructArray.from_arrays([pa.array(np.concatenate(told[5])), pa.array(np.concatenate(told[6]))], ["pair", "times"])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in told[:4]], pa.array(told[4], pa.string()),
                                                  pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links)],
                                                 ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_column(docs, key)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair: bigint, times: bigint>>")


def linked_pairs(rows: DataFrame) -> DataFrame:
    """``(pair, n, best)`` from ``aligned`` rows: texts that hold the pair linked, and whether no pair of its first id has more."""
    counts = keep(rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    highest = small(counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n").alias("top")))  # a row per id of the vocabulary at most
    return counts.join(highest, F.shiftright("pair", ID_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, first: str = BYTE_BPE, second: str = PIECE_BPE) -> DataFrame:
    """One row per row of ``docs``: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Null and empty texts, and texts that the tokens of a side do not spell, have no tokens: zeros, and an empty digest. Repeated rows are
    texts of their own and count each; other columns are ignored; an empty table gives an empty result. A text of any length passes in
    pieces cut between words; memory follows the longest word.
    """
    made = aligned(docs, key=key, text=text, folder=folder, first=first, second=second).withColumn("uid", F.monotonically_increasing_id())
    rows, seen = keep_measured(made, links=F.sum(F.size("links")))
    pairs = keep(linked_pairs(rows))
    large = F.col("n") * HEAVY > F.lit(seen["links"] or 0)
    heavy, light = F.broadcast(pairs.where(large)), pairs.where(~large)
    each = rows.select("uid", F.inline("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    per = each.join(heavy, "pair").groupBy("uid").agg(*sums)
    rest = each.join(heavy.select("pair"), "pair", "left_anti").join(light, "pair").groupBy("uid").agg(*sums)
    total = per.unionByName(rest).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("links").join(total, "uid", "left").select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
