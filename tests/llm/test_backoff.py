"""Scores against counting in Python, with many small blocks and parts; odd rows."""

import math
import random
from collections import Counter

import pytest

from countspark.llm.backoff import stupid_backoff


def plain(texts):
    words = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    grams = lambda w, n: Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    each = [[grams(w, n) for n in (1, 2, 3)] for w in words]
    total = [sum((e[n] for e in each), Counter()) for n in range(3)]
    size = sum(map(len, words))
    out = []
    for w, own in zip(words, each):
        c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        n, score, level = size - len(w), 0.0, [0, 0, 0, 0]
        for i in range(len(w)):
            if i >= 2 and c(tuple(w[i - 2:i + 1])):
                score += math.log(c(tuple(w[i - 2:i + 1])) / c(tuple(w[i - 2:i])))
                level[0] += 1
            elif i >= 1 and c(tuple(w[i - 1:i + 1])):
                score += math.log(0.4 * c(tuple(w[i - 1:i + 1])) / c((w[i - 1],)))
                level[1] += 1
            elif c((w[i],)):
                score += math.log(0.16 * c((w[i],)) / n)
                level[2] += 1
            else:
                score += math.log(0.064 / (n + 1))
                level[3] += 1
        out.append((len(w), score, *level))
    return out


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 22), (50, 40)])
def test_scores(spark, block, part):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("the of Cat dog runs in a Été house x".split()) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += ["", None, "  ", "only", "two words", texts[0], texts[0], "a a a a a a a", "the\x0bof\tcat", "unique " * 200]
    docs = spark.createDataFrame([(i, t, "w", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, block string, log_score double").repartition(3)
    got = {r["doc_id"]: r for r in stupid_backoff(docs, block_words=block, part_words=part).collect()}
    assert len(got) == len(texts)
    for i, (n, score, *level) in enumerate(plain(texts)):
        r = got[i]
        assert (r["n_words"], r["n_trigram"], r["n_bigram"], r["n_word"], r["n_unseen"]) == (n, *level)
        assert abs(r["log_score"] - score) < 1e-4
        assert (r["mean_log_score"] is None) == (n == 0)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "long words " * 300000)], "doc_id bigint, text string")
    got = stupid_backoff(docs).collect()
    assert sorted(r["n_words"] for r in got) == [3, 3, 3, 600000] and {r["n_trigram"] for r in got if r["n_words"] == 3} == {1}
    assert stupid_backoff(docs.limit(0)).count() == 0
    assert [r["n_unseen"] for r in stupid_backoff(docs.where("doc_id is null")).collect()] == [3]
