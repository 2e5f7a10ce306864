"""The whole pipeline on a small table with planted cases, stage by stage."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from countspark.llm.simhash import fingerprint_of

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    item = prose(30)
    docs = [(i, prose(rng.randrange(20, 200))) for i in range(120)]
    junk = [(i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(200, 240)]
    docs += junk + [(300, docs[3][1]), (301, docs[4][1].replace(" ", "\n", 3)), (302, prose(30) + " " + item + " " + prose(30)), (303, prose(50) + f" token = \"{HEX}\" " + prose(20)), (304, None), (305, "")]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs[:160]], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    tables = [docs]
    for name, stage in cp.STAGES:
        out = cp.keep(stage(spark, tables[-1], folder))
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
        tables.append(out)
        ids.append({r["doc_id"] for r in out.select("doc_id").collect()})
        assert out.count() == len(ids[-1])
    clean = set(range(120)) | {302, 303}
    assert clean <= ids[1] and not ids[1] & set(range(200, 240))
    # near duplicates, against all pairs
    rows = [(r["doc_id"], fingerprint_of((r["text"] or "").encode())) for r in tables[1].select("doc_id", "text").collect()]
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if np.bitwise_count(np.uint64(a ^ b)) <= 3 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert ids[2] == {i for i, v in label.items() if i == v} and 300 not in ids[2] and 301 not in ids[2]
    assert ids[2] - ids[3] == {302}
    assert ids[4] == ids[3]
    texts = {r["doc_id"]: r["text"] for r in tables[4].collect()}
    before = {r["doc_id"]: r["text"] for r in tables[3].collect()}
    assert HEX not in texts[303] and {i for i in texts if texts[i] != before[i]} == {303}
    taken = {r["doc_id"]: r["taken"] for r in tables[5].collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert all(0 < n <= 2 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 5
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(map(tuple, tables[5].collect()), key=lambda r: r)
