"""Cuts, verified fingerprints, copies against plain groups, odd rows, and a round trip through the chunk store."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from countspark.llm import chunk_recipes as cr


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def words(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 9000, 40_000, 3_000_000])
def test_cuts(n):
    data = np.random.default_rng(n).integers(32, 127, n, dtype=np.uint8).tobytes()
    ends = cr.cut_places(data)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == n and all(cr.LEAST <= s <= cr.MOST for s in sizes[:-1])
    assert b"".join(b for _, b in cr.chunks_of(data)) == data


def test_cuts_follow_content():
    """An insertion at the front leaves the chunks behind it as they were, over the borders of the pieces that are hashed at once."""
    data = np.random.default_rng(3).integers(32, 127, 2_500_000, dtype=np.uint8).tobytes()
    old, new = [{b for _, b in cr.chunks_of(x)} for x in (data, b"something new " + data)]
    assert len(old - new) <= 3 and len(old) > 500
    assert len(list(cr.chunks_of(b"a" * 100_000))) == 13


ROWS = [(5, "a  b\n c"), (3, "a b c"), (9, None), (8, ""), (7, " "), (6, "\n\t "), (2, words(1, 4000)), (4, words(1, 4000).replace(" ", "\r\n")), (1, words(1, 4000) + " "),
        (10, "x" * 100_000), (11, "x" * 100_000), (12, "x" * 100_001), (None, "a b c"), (13, "twice"), (13, "twice"), (14, "café"), (15, "café"), (16, "a b c"), (17, "A b c")]


@pytest.mark.parametrize("widths", [(16,), (1, 2, 16)])
def test_copies(spark, widths):
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in ROWS], "doc_id bigint, text string, recipe string, kept boolean")
    got = cr.exact_copies(docs, widths=widths).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(plain(t), []).append(i)
    want = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        digest = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    order = lambda r: (r[0] is None, r[0] or 0, not r[3])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert got[0].__fields__ == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert cr.exact_copies(docs.limit(0)).count() == 0


def test_shared_fingerprints_are_found(spark):
    """Two different chunks under one fingerprint show up, and the next seed is taken."""
    docs = spark.createDataFrame([(i, words(i, 3000)) for i in range(60)], "doc_id bigint, text string")
    assert cr.verified_seed(docs, widths=(1, 16)) == (1, 16)
    assert cr.verified_seed(docs) == (0, 16)


def test_hot_group(spark, monkeypatch):
    """Large groups, which are broadcast, and small ones give the same kind of rows."""
    monkeypatch.setattr(cr, "HEAVY", 4)
    docs = spark.range(400).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id div 2) end as text")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in cr.exact_copies(docs).collect()}
    assert len(got) == 400 and got[399] == (0, 134) and got[8] == (8, 1) and got[5] == got[4] == (4, 2)


def test_store_gives_texts_back(spark):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS if i is not None], "doc_id bigint, text string")
    rows, chunks = cr.chunk_store(docs)
    held = {bytes(r["chunk"]): bytes(r["bytes"]) for r in chunks.collect()}
    for r in rows.collect():
        text = b"".join(held[bytes(c)] for c in r["chunks"])
        assert text.decode() in {plain(t) for i, t in ROWS if i == r["doc_id"]}
        assert hashlib.sha256(text).hexdigest() == r["text_sha256"]


def test_sql(spark, tmp_path):
    docs = spark.createDataFrame(ROWS[:12] + ROWS[13:], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    key = lambda r: (r[0], not r[3])
    want = sorted(con.execute(cr.copies_sql()).fetchall(), key=key)
    assert sorted((tuple(r) for r in cr.exact_copies(docs).collect()), key=key) == want
