import hashlib
import random
import re

import pytest

from pointloom.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()))


def brute(docs, items):
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            w = words(item)
            n = min(10, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((doc, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_against_brute_force(spark, block):
    pick = random.Random(block)
    vocabulary = ["a", "B", "é", "the", "x1", "Zü", "qq"]
    text = lambda n: "".join(pick.choice(vocabulary) + pick.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((0, 1, 3, 9, 10, 11, 14, 30))] + [(99, None)]
    if block < 100:
        items = items[3:6]
    docs = [(i, text(pick.randint(0, 40)) + (pick.choice(items)[1] or "") + " " + text(5)) for i in range(60)] + [(60, None), (61, ""), (62, "a " * 500)]
    df = spark.createDataFrame([(*r, "k") for r in docs], "doc_id bigint, text string, id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in D.decontaminate(df, bench, block_bytes=block).collect())
    assert got == brute(docs, items)
    clean = {r.doc_id for r in D.keep_clean(df, bench, block_bytes=block).collect()}
    assert clean == {r[0] for r in got if not r[5]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.decontaminate(docs, none).first().contaminated is False
    assert D.decontaminate(docs.limit(0), none).count() == 0


def test_a_block_of_full_size_is_bounded_in_memory():
    import pickle
    import random
    import tracemalloc

    pick = random.Random(2)
    items, total = [], 0
    words = [f"w{pick.randrange(10**6)}" for _ in range(50_000)]
    while total < D.BLOCK_BYTES:
        items.append((str(len(items)), " ".join(pick.choice(words) for _ in range(400)).encode()))
        total += len(items[-1][1])
    tracemalloc.start()
    prints = D.Fingerprints(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20 and len(pickle.dumps(prints)) < 80 << 20
    text = b"some words before " + b" ".join(items[7][1].split()[50:70]) + b" and after"
    data = D.ALNUM.lower[D.np.frombuffer(text, D.np.uint8)]
    s, e, h = D.split_words(data, D.ALNUM)
    assert {x for _, _, names in prints.hits(data.tobytes(), s, e, h, D.np.zeros(len(h), int)) for x in names} == {"7"}


def test_repeated_rows_and_items(spark):
    leak = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {leak} b"), (1, f"a {leak} b"), (2, "clean text")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, leak), (5, leak), (6, leak), (7, None), (8, "")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in D.decontaminate(docs, items).collect())
    assert got == [(1, 12, 2, True), (1, 12, 2, True), (2, 0, 0, False)]
