"""The schedule and the mix against a plain version, odd rows."""

import random
import re
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from countspark.llm import mixing


def plain_targets(sizes):
    """Targets by sharing the excess until none is above, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 17), f"s{'abcde'[i % 5]}" if i % 11 else None, "x") for i in range(500)]
    rows += [(1000 + i, "a\tb\x0bc d", "big", "x") for i in range(700)] + [(2000, None, "sa", "x"), (None, "v " * 9, "sb", "x"), (3, "t u", "sb", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")


def test_mix(spark, docs):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    source = {}
    for r in docs.collect():
        source.setdefault((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))), []).append(r["source"])
    assert len(got) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[(r["doc_id"], r["size"])].pop()
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
    want = plain_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in want)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = [r.asDict() for r in mixing.mix(docs.repartition(7)).collect()]
    order = lambda r: tuple((v is None, v) for v in r.values())
    assert sorted(got, key=order) == sorted(again, key=order)


def test_schedule_is_even(spark):
    demand = spark.createDataFrame([(1, 600, 600), (2, 300, 300), (3, 100, 100)], "place bigint, need bigint, goal bigint")
    rows = sorted((r["slot"], r["source_no"], r["rank"]) for r in mixing.schedule(demand).collect())
    assert [sum(1 for _, s, _ in rows if s == k) for k in (1, 2, 3)] == [600, 300, 100]
    for k, share in ((1, 0.6), (2, 0.3), (3, 0.1)):  # any stretch has the shares, but for a few slots
        ranks = [(slot, rank) for slot, s, rank in rows if s == k]
        assert [r for _, r in ranks] == list(range(len(ranks)))
        assert all(abs(rank - slot * share) < 6 for slot, rank in ranks if slot < 1000)


def test_empty(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.select("doc_id", F.lit(None).cast("string").alias("text"), "source")
    assert {(r["size"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0, 0)}


def test_rows_keep_their_columns(spark, docs):
    found = mixing.mix_rows(docs)
    assert found.columns == [*docs.columns, "taken", "first_slot"] and found.count() == docs.count()
    again = docs.unionByName(docs.where("doc_id = 5"))
    rows = mixing.mix_rows(again)
    assert rows.count() == again.count()
    assert rows.agg(F.sum("taken")).first()[0] == mixing.mix(again).agg(F.sum("taken")).first()[0]


def plain_schedule(needs, goals):
    """Slot after slot: mirror its bits, look up the source, until all have what they need."""
    total, found, slot = sum(goals), [[] for _ in goals], 0
    while any(len(f) < n for f, n in zip(found, needs)):
        point, part, at = Fraction(0), Fraction(1, 2), slot
        while at:
            point, part, at = point + part * (at & 1), part / 2, at >> 1
        upto, source = 0, 0
        while point * total >= upto + goals[source]:
            upto, source = upto + goals[source], source + 1
        if len(found[source]) < needs[source]:
            found[source].append(slot)
        slot += 1
    return found


def test_schedule_against_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    needs, goals = [40, 1, 25, 3, 60], [4000, 3, 2500, 257, 6001]
    demand = spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(zip(needs, goals))] + [(9, 0, 0)], "place bigint, need bigint, goal bigint")
    got = {}
    for r in sorted(mixing.schedule(demand).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["source_no"], []).append(r["slot"])
    assert [got[i] for i in range(5)] == plain_schedule(needs, goals)


def test_tiny_shares(spark):
    goals = [10 ** k for k in range(0, 18, 3)] + [4 * 10 ** 17]
    needs = [1, 1, 1, 1, 3, 900, 9000]
    began = time.time()
    rows = mixing.schedule(spark.createDataFrame([*zip(range(7), needs, goals)], "place bigint, need bigint, goal bigint")).collect()
    assert time.time() - began < 30 and len(rows) == sum(needs) and len({r["slot"] for r in rows}) == len(rows)
    total, before = sum(goals), 0
    for i, goal in enumerate(goals):
        for r in rows:
            if r["source_no"] == i:
                point = Fraction(int(f"{r['slot']:063b}"[::-1], 2), 2 ** 63)
                assert Fraction(before, total) <= point < Fraction(before + goal, total)
        before += goal


def test_uneven_sources(spark):
    """A source of one word beside one of hundreds of thousands."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 300) as text", "'big' as source").unionByName(
        spark.createDataFrame([(9000, "one", "a"), (9001, "x y z", "small")], "doc_id bigint, text string, source string"))
    got = {}
    for r in mixing.mix(docs, weights=(1, 1, 1)).collect():
        got[r["source_size"]] = got.get(r["source_size"], 0) + r["taken"]
    assert got == {1: 2, 3: 6, 900_000: 1_349_998}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 5, 1000, 10 ** rng.randrange(1, 9)]) for i in range(rng.randrange(1, 60))}
    want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    table = spark.createDataFrame([*sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * want[s] + 1e-9 for s in want)
