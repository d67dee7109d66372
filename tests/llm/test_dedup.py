import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import lines, linking, neardup


def union(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def varied(pick, base, most):
    out = list(base)
    for _ in range(pick.randint(0, most)):
        out[pick.randrange(len(out))] = pick.choice(base)
    return out


def test_components(spark):
    pick = random.Random(3)
    links = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    got = {r.node: r.comp for r in linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = union(400, links)
    assert got == {i: want[i] for i in {x for link in links if link[0] != link[1] for x in link}}
    assert linking.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_of_one_part_need_no_rounds(spark, monkeypatch):
    pick = random.Random(7)
    links = [(pick.randrange(-200, 200), pick.randrange(-200, 200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    own, seen = linking.forget, []
    monkeypatch.setattr(linking, "forget", lambda df: (seen.append(1), own(df)))
    place = union(800, [(a + 300, b + 300) for a, b in links])
    want = {x: place[x + 300] - 300 for link in links if link[0] != link[1] for x in link}
    for rows, rounds in ((linking.FILE_ROWS, False), (20, True)):
        monkeypatch.setattr(linking, "FILE_ROWS", rows)
        seen.clear()
        assert {r.node: r.comp for r in linking.components(df).collect()} == want
        assert bool(seen) == rounds


def test_only_edges_of_their_key_are_lone():
    """Over map tasks and their flushes: an edge is lone if and only if its key has two nodes, unless one task saw both."""
    pick = np.random.default_rng(5)
    entries = [(pick.integers(0, 4000, 900), pick.integers(0, 5000, 900)) for _ in range(12)]
    blobs = [x for k in range(4) for x in linking.send(iter(entries[3 * k : 3 * k + 3]), 5)]
    table = pa.Table.from_batches(blobs).sort_by("part")
    got = [r for batch in linking.receive(iter(table.to_batches(max_chunksize=50))) for r in batch.to_pylist()]
    nodes = {}
    for keys, own in entries:
        for k, n in zip(keys.tolist(), own.tolist()):
            nodes.setdefault(k, set()).add(n)
    assert {r["key"] for r in got} == {k for k, own in nodes.items() if len(own) > 1}
    for k, own in nodes.items():
        ends = union(5000, [(r["a"], r["b"]) for r in got if r["key"] == k] if len(own) > 1 and k < 200 else [])
        assert k >= 200 or len({ends[n] for n in own}) == 1
    lone = [r for r in got if r["lone"]]
    assert len(lone) > 100 and all({r["a"], r["b"]} == nodes[r["key"]] for r in lone)
    assert sum(len(own) == 2 for own in nodes.values()) < 2 * len(lone)


def test_borrowed_bins_are_altered_by_each_step():
    signs = np.full((3, 4), 0xFFFFFFFF, np.uint32)
    signs[0, 1], signs[1] = 10, [2, 4, 6, 8]
    lines.fill(signs, np.arange(3), 4)
    c = 2654435761
    assert signs.tolist() == [[10 * c % 2**32, 10, 10 * c**3 % 2**32, 10 * c**2 % 2**32], [2, 4, 6, 8], [0xFFFFFFFF] * 4]


def test_pairs_of_lines_and_blocks():
    pick = random.Random(4)
    bases = ["".join(pick.choice("abcdefgh ") for _ in range(120)) for _ in range(4)]
    rows = list(dict.fromkeys("".join(varied(pick, pick.choice(bases), 6)) for _ in range(90)))
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in rows]
    j = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    every = np.arange(len(rows))
    found = lines.compare(rows)(every, every, ~np.eye(len(rows), dtype=bool), (every, every))
    assert union(len(rows), np.argwhere(found).tolist()) == union(len(rows), np.argwhere(j >= 0.8).tolist()) and not (found & (j < 0.8)).any()
    a, b = np.triu_indices(len(rows), 1)
    assert (lines.jaccard([rows[i] for i in a], [rows[i] for i in b]) == (j[a, b] >= 0.8)).all()
    keys, buckets = lines.band_keys(lines.signatures(rows)), {}
    for i in range(len(rows)):
        for k in keys[i].tolist():
            buckets.setdefault(k, set()).add(i)
    shared = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if j[x, y] >= 0.8 and set(keys[x].tolist()) & set(keys[y].tolist())]
    prints = lines.sketch(rows)
    for chunks in (1, 3):
        table = sorted((k, min(i % chunks, o), max(i % chunks, o), i % chunks, i, i, rows[i], prints[i].tobytes()) for k, m in buckets.items() for i in m for o in range(chunks))
        batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in table]) for c in range(8)], names=["key", "lo", "hi", "chunk", "node", "comp", "text", "sketch"])
        for size in (7, len(table)):
            batches = [batch.slice(i, size) for i in range(0, len(batch), size)]
            links = [x for out in linking.cross_links(iter(batches), lines.compare, 0.8) for x in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
            assert union(len(rows), links) == union(len(rows), shared)


def test_sketches_never_rule_out_a_similar_pair():
    pick = random.Random(8)
    for module, base, similar in ((lines, ["".join(pick.choice("abcdefgh ") for _ in range(n)) for n in (9, 60, 900)], lines.jaccard), (neardup, [" ".join(f"w{pick.randrange(m)}" for _ in range(n)) for n, m in ((40, 4), (90, 400), (3000, 900))], neardup.similar)):
        rows = []
        for text in base:
            words = text.split(" ") if module is neardup else list(text)
            for share in (0, 0.01, 0.02, 0.04, 0.1, 0.3):
                rows.append((" " if module is neardup else "").join(pick.choice(words) if pick.random() < share else w for w in words))
        rows += [x + (" " if module is neardup else "") + x for x in rows[:6]]
        prints = module.sketch(rows)
        a, b = (x.ravel() for x in np.indices((len(rows), len(rows))))
        truth = similar([rows[i] for i in a], [rows[i] for i in b])
        prints = linking.unpacked(prints)
        maybe = linking.possible(prints[a], prints[b], 0.8)
        assert not (truth & ~maybe).any() and truth.sum() > len(rows) and (~maybe).sum() > len(rows)


def test_recall_of_shared_bands():
    """Edited copies at a similarity of 0.8 or more share a band: at least 99 in 100 of them."""
    pick = random.Random(9)
    for module, similar in ((lines, lines.jaccard), (neardup, neardup.similar)):
        a, b = [], []
        for _ in range(1500):
            words = [f"{pick.randrange(10**6):x}" for _ in range(pick.randint(20, 60) if module is neardup else 12)]
            text = " ".join(words)
            for _ in range(pick.randint(1, 2)):
                words[pick.randrange(len(words))] = "zz"
            a.append(text)
            b.append(" ".join(words))
        true = np.flatnonzero(similar(a, b))
        keys = [module.band_keys(module.signatures([x[i] for i in true]), module.BANDS) for x in (a, b)]
        assert len(true) > 100 and (keys[0] == keys[1]).any(1).mean() > 0.99


def test_chunks_of_large_components(spark, monkeypatch):
    """Every pair of nodes in different components meets once at least; chunks of one component do not."""
    monkeypatch.setattr(linking, "CHUNK_ROWS", 4)
    comps = [1] * 11 + [2] * 9 + [3] * 2 + [4, 5, 6, 7]
    members = [(1, n, c) for n, c in enumerate(comps)] + [(2, 100 + n, 1) for n in range(9)] + [(2, 200, 9)] + [(3, 300, 1), (3, 301, 2)] + [(4, 400 + n, 5) for n in range(6)] + [(5, 500 + n, n % 2) for n in range(3)]
    rows = linking.dealt(spark.createDataFrame(members, "key bigint, node bigint, comp bigint")).collect()
    met, groups = set(), {}
    for r in rows:
        groups.setdefault((r.key, r.lo, r.hi), []).append(r)
    for (key, lo, hi), own in groups.items():
        assert len({r.comp for r in own}) > 1 or lo == hi or len({r.chunk for r in own}) == 1
        for x in own:
            for y in own:
                if x.node < y.node and (lo == hi or x.chunk != y.chunk):
                    met.add((key, x.node, y.node))
    want = {(k, a, b) for k, a, c in members for l, b, d in members if k == l and a < b and c != d and k in (1, 2, 5)}
    assert want <= met and not any(k in (3, 4) for k, _, _ in met)


def test_keys_that_are_hot(spark, monkeypatch):
    monkeypatch.setattr(linking, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linking, "HOT_SHARE", 0.3)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 30)], "k int, v int")
    values = spark.createDataFrame([(1, "a", 50)] + [(k, "b", 1) for k in range(2, 20)], "k int, w string, n bigint")
    monkeypatch.setattr(linking, "small", lambda df: df)
    got = Counter((r.k, r.w) for r in linking.lookup(rows, values, "k", "n").collect())
    assert got == Counter({(1, "a"): 50, **{(k, "b"): 1 for k in range(2, 20)}})


def test_line_columns_that_clash_and_repeated_rows(spark):
    docs = [(1, "a line of its own here\nand one that comes again", 77, "x", [1]), (1, "a line of its own here\nand one that comes again", 77, "x", [1]), (2, "and one that comes again\nlast line of all of them", 78, None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_lines int, row string, gone array<int>")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "row", "gone", "n_lines_", "n_removed"]
    got = sorted((r.doc_id, r.text, r.n_lines, r.row, r.n_lines_, r.n_removed) for r in out.collect() if r.doc_id == 1)
    assert got == [(1, docs[0][1], 77, "x", 2, 0)] * 2
    (last,) = [r for r in out.collect() if r.doc_id == 2]
    assert (last.text, last.n_lines, last.row, last.gone, last.n_lines_, last.n_removed) == ("last line of all of them", 78, None, None, 2, 1)


def test_signature_of_long_line_is_pieced(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefghij") for _ in range(5000))
    whole = lines.signatures([text, "ab", ""])
    monkeypatch.setattr(lines, "LONG", 512)
    assert (lines.signatures([text, "ab", ""]) == whole).all()


def test_lines_against_brute_force(spark):
    pick = random.Random(5)
    bases = ["".join(pick.choice("abcdefghijklm ") for _ in range(90)) + "x" for _ in range(12)]
    docs = [(i, "\n".join("".join(varied(pick, pick.choice(bases), 2)) for _ in range(pick.randint(0, 4)))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, " \n\nABC\nabc"), (43, docs[3][1]), (44, "abc ")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, node string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    first, order = {}, []
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            f = line.lower().strip(" ")
            if f and f not in first:
                first[f] = (d, i)
                order.append(f)
    sets = [{x[i : i + 8] for i in range(max(len(x) - 7, 1))} for x in order]
    comp = union(len(order), [(a, b) for a in range(len(order)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    best = {}
    for i, f in enumerate(order):
        best[comp[i]] = min(best.get(comp[i], (10**9, 0)), first[f])
    place = {f: i for i, f in enumerate(order)}
    for d, t in docs:
        want = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not (f := x.lower().strip(" ")) or best[comp[place[f]]] == (d, i))
        assert got[d] == want
    assert "node" in lines.dedup_lines(df).columns and lines.dedup_lines(df.limit(0)).count() == 0


def test_probability_jaccard_and_its_estimate():
    pick = random.Random(2)
    for _ in range(200):
        a, b = ({k: pick.choice([1, 1, 2, 5]) for k in pick.sample(range(12), pick.randint(1, 10))} for _ in range(2))
        want = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in a if x in b)
        own = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float)) for d in (a, b)]
        assert neardup.probability_jaccard(*own) == pytest.approx(want)
    shares, exact = [], []
    for q in range(60):
        a = [f"{q}a{i}" for i in range(300)] + [f"{q}r{i % 15}" for i in range(120)]
        b = [f"{q}z{i}" if i % 30 == 0 else x for i, x in enumerate(a)]
        signs = neardup.signatures([" ".join(a), " ".join(b)])
        shares.append((signs[0] == signs[1]).mean())
        exact.append(neardup.probability_jaccard(neardup._weighted(" ".join(a)), neardup._weighted(" ".join(b))))
    assert abs(np.mean(shares) - np.mean(exact)) < 0.03


def test_near_duplicates_against_brute_force(spark):
    pick = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[pick.choice(vocabulary) for _ in range(pick.choice([3, 60, 150]))] for _ in range(12)]
    docs = [(i, " ".join(varied(pick, pick.choice(bases), 4))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, ""), (63, "?!"), (64, "one two"), (65, "One, two!"), (66, docs[0][1]), (66, docs[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, id int")
    got = Counter((r.doc_id, r.group_id) for r in neardup.near_duplicates(df).collect())
    weighted = [neardup._weighted(t or "") for _, t in docs]
    links = []
    for a in range(len(docs)):
        for b in range(a):
            (_, s), (_, t) = docs[a], docs[b]
            if s is None or t is None:
                continue
            if s == t or len(weighted[a][0]) and len(weighted[b][0]) and neardup.probability_jaccard(weighted[a], weighted[b]) >= 0.8 - 1e-12:
                links.append((a, b))
    comp = union(len(docs), links)
    assert got == Counter((docs[i][0], docs[comp[i]][0]) for i in range(len(docs)))
    kept = sorted(r.doc_id for r in neardup.keep_one(df).collect())
    assert kept == sorted({docs[comp[i]][0] for i in range(len(docs))})
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_and_null_ids(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    third = " ".join(f"c{i}" for i in range(40))
    docs = [(1, text), (2, text), (2, other), (None, third), (None, third), (None, text), (3, third + " x"), (None, None), (None, None), (4, other + " y"), (4, other)]
    got = Counter((r.doc_id, r.text) for r in neardup.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == Counter([(1, text), (2, other), (3, third + " x"), (None, None), (None, None)])
    nulls = spark.createDataFrame([(None, text), (None, text)], "doc_id bigint, text string")
    assert neardup.keep_one(nulls).count() == 1
