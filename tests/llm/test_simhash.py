"""Fingerprints against a plain version, Golay keys, links and components against brute force, odd rows."""

import numpy as np
import pytest
import xxhash

from countspark.llm import simhash as sh


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("text", ["", "  \n", "Eins", "a b", "A b C", "a b c d e f " * 50, "Été İ x\x0by\x1cz w", "x" * 5000 + " " + "yo " * 400000])
def test_fingerprint(text):
    assert sh.fingerprint_of(text.encode()) == plain_fingerprint(text)


def test_fingerprint_is_spark_xxhash64(spark):
    """The hash of a single shingle is the one that Spark computes with its default seed."""
    assert spark.range(1).selectExpr("xxhash64('a b')").first()[0] == np.uint64(xxhash.xxh64(b"a b", seed=42).intdigest()).view(np.int64)


def test_code_is_perfect():
    table = sh.nearest_codewords()
    codes, n = np.unique(table, return_counts=True)
    assert len(codes) == 4096 and set(n) == {2048}  # spheres of radius three fill the space


def test_all_links_meet_in_a_bucket():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    other = fps.copy()
    for i in range(len(fps)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)

    def keys(v, right):
        seg = [((v >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
        out = [set() for _ in v]
        for t in range(4):
            near, row, code = sh.segment_keys(seg[(t + 1) % 4])
            for r, c in (zip(range(len(v)), near) if right else zip(row, code)):
                out[r].add((t, int(seg[t][r]), int(c)))
        return out

    assert all(a & b for a, b in zip(keys(fps, False), keys(other, True)))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_components(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 64, 30, dtype=np.uint64)
    fps = list(base) + list(base[:5])
    for b in base[:12]:  # chains: each link three bits, the ends far apart
        for _ in range(6):
            for bit in rng.choice(64, 3, replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            fps.append(b)
    fps = [int(f) for f in fps]
    classes = spark.createDataFrame([(np.uint64(f).view(np.int64).item(),) for f in sorted(set(fps))], "fp bigint")
    links = sh.link_rows(sh.keep(sh.bucket_rows(classes)), chunk=chunk).distinct()
    found = {r["node"]: r["root"] for r in sh.components(links).collect()}
    of = [found.get(x := np.uint64(f).view(np.int64).item(), x) for f in fps]
    want = brute(fps)
    assert len(set(zip(of, want))) == len(set(of)) == len(set(want))


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d"), (3, "A  b c\nd"), (9, None), (8, ""), (2, long), (4, long + " tail"), (None, "a b c d"), (7, "one two"), (7, "one two"), (6, "quite other words here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in sh.simhash_components(docs).collect())
    assert got == [(-1, 3), (2, 2), (3, 3), (4, 2), (5, 3), (6, 6), (7, 7), (7, 7), (8, 8), (9, 8)]
    kept = sh.near_duplicate_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 6, 7, 8]
    assert sh.simhash_components(docs.limit(0)).count() == 0 and sh.near_duplicate_rows(docs.limit(0)).count() == 0
