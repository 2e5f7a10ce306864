"""Common ends and groups against a plain walk, tokens against the libraries, and the counts against brute force."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from countspark.llm import token_alignment as ta

FIRST, SECOND = (Path(ta.VOCABULARIES, name).read_bytes() for name in (ta.BYTE_BPE, ta.PIECE_BPE))


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_str(FIRST.decode())
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_proto=SECOND)
    bytes_a, bytes_b = ta.byte_level(FIRST)[1], ta.piece_level(SECOND)[1]

    def align(text):
        """Ids of both sides and groups, token by token."""
        if not text:
            return [], [], []
        a, b = own.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        if not b"".join(bytes_a[i] for i in a) == b"".join(bytes_b[i] for i in b) == (" " + text).encode():
            return [], [], []
        ends = [set(np.cumsum([len(of[i]) for i in ids]).tolist()) for of, ids in ((bytes_a, a), (bytes_b, b))]
        common, groups = ends[0] & ends[1], []
        sides = []
        for of, ids in ((bytes_a, a), (bytes_b, b)):
            at, group, out = 0, [], []
            for i in ids:
                at += len(of[i])
                group.append(i)
                if at in common:
                    out.append(group)
                    group = []
            sides.append(out)
        return a, b, list(zip(*sides))

    return align


def told(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


TEXTS = ["", None, "a", " ", "   ", "the cat sat on the mat", "  two  blanks   here ", "line\nbreak\n\n  indent\tand\ttab \n", "</s> <s> <|endoftext|> [INST]", "▁ already", "a▁b",
         "x y   z\u0085w", "漢字 と カタカナ 🙂🙂🙂 é é ﬁ", "\x00\x01 \x1c \x7f", "don't can't I'll they've 's 'T", "word " * 300, "9 99 999 9999 1,234.56", "ab" * 3000,
         "🙂" * 2000, " ".join("".join(chr(97 + c) for c in np.random.default_rng(i).integers(0, 26, 9)) for i in range(400)), "tail  ", "\n", " \n x", "a ▁ b"]


@pytest.mark.parametrize("seed", range(6))
def test_common_ends(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 4000))
    a, b = (np.unique(np.append(rng.integers(1, n * 3, n), 3 * n)) for _ in range(2))
    if seed % 2:  # long one-to-one stretches with a few breaks
        b = np.unique(np.concatenate((np.delete(a[:-1], rng.integers(0, max(1, len(a) - 1), 9) % max(1, len(a) - 1)) if len(a) > 1 else a[:0], [a[-1]])))
    if seed == 4:  # one long stretch without a common end
        a, b = np.append(np.arange(2, 4000, 2), 4001), np.append(np.arange(1, 4000, 2), 4001)
    at_a, at_b = ta.common_ends(a, b, lane=64)
    want = np.intersect1d(a, b)
    assert (a[at_a] == want).all() and (b[at_b] == want).all() and len(at_a) == len(want)


def test_words_are_the_texts():
    for text in [t for t in TEXTS if t]:
        for size in (1, 7, 1 << 20):
            assert " ".join(w for part in ta.word_pieces(text, True, size) for w in part) == text


@pytest.mark.parametrize("batch, lane", [(ta.BATCH, ta.LANE), (40, 8)])
def test_alignment(plain, monkeypatch, batch, lane):
    monkeypatch.setattr(ta, "BATCH", batch)
    monkeypatch.setattr(ta, "LISTED", 6)
    monkeypatch.setattr(ta.word_pieces, "__defaults__", (True, batch))
    monkeypatch.setattr(ta.common_ends, "__defaults__", (lane,))
    got = list(ta.Aligner(FIRST, SECOND).texts(iter(TEXTS)))
    for text, (n_a, n_b, n_groups, n_links, digest, pairs, times) in zip(TEXTS, got, strict=True):
        a, b, groups = plain(text)
        assert (n_a, n_b, n_groups) == (len(a), len(b), len(groups)), text
        assert digest == (hashlib.sha256(told(groups).encode()).hexdigest() if groups else "")
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        assert n_links == sum(links.values())
        assert {(p >> ta.ID_BITS, p & (1 << ta.ID_BITS) - 1): t for p, t in zip(pairs.tolist(), times.tolist())} == dict(links)


def test_tokens_of_all_characters():
    """Both libraries give the same ids to text of any characters, and words give those of the whole text."""
    own = Tokenizer.from_str(FIRST.decode())
    encode = ta.byte_level(FIRST)[0]
    rng = np.random.default_rng(5)
    points = [c for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    work = ta.Words(FIRST, SECOND)
    for _ in range(40):
        text = "".join(chr(points[i]) if rng.random() < 0.5 else " a\n.1"[i % 5] for i in rng.integers(0, len(points), 400))
        whole = own.encode(" " + text, add_special_tokens=False).ids
        assert encode([" " + text])[0] == whole
        numbers = work.numbers([w for part in ta.word_pieces(text) for w in part])
        assert work.tokens(numbers, 0).tolist() == whole
        if not work.wrong[numbers].any():
            assert work.tokens(numbers, 1).tolist() == work.encode_b([text])[0]


def test_other_library(monkeypatch):
    """Vocabularies whose ids are not in the order of merges go to the general library."""
    slow = FIRST.replace(b'"trim_offsets":true', b'"trim_offsets":false').replace(b'"trim_offsets": true', b'"trim_offsets": false')
    assert slow != FIRST
    texts = [" the cat", " 漢字 <|endoftext|>"]
    assert ta.byte_level(slow)[0](texts) == ta.byte_level(FIRST)[0](texts)


@pytest.mark.parametrize("heavy", [ta.HEAVY, 20])
def test_counts(spark, plain, monkeypatch, heavy):
    monkeypatch.setattr(ta, "HEAVY", heavy)
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5]), (None, TEXTS[5]), (100, "the cat")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_a int, links string").repartition(3)
    held, best = Counter(), defaultdict(int)
    links = [Counter((x, y) for g, h in plain(t)[2] for x in g for y in h) for _, t in rows]
    for found in links:
        held.update(found.keys())
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = sorted((-1 if i is None else i, len(p[0]), len(p[1]), len(p[2]), sum(f.values()), sum(t for k, t in f.items() if held[k] == best[k[0]]), sum(t * held[k] for k, t in f.items()),
                   hashlib.sha256(told(p[2]).encode()).hexdigest() if p[2] else "") for (i, t), f in zip(rows, links) for p in [plain(t)])
    table = ta.alignment_counts(docs)
    assert table.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, table.collect())) == want
    assert ta.alignment_counts(docs.limit(0)).count() == 0
