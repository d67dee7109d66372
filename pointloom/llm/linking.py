"""From band keys to connected components, without ever holding a group in one place.

1. Each map task sorts its (band key, node) entries, keeps one entry per key (its least node)
   and turns the others into edges to it. So a key sends at most one entry per task, however
   many nodes share it. Entries travel as blobs of numpy data, dealt by key.
2. The reduce tasks do the same per key. Edges of a key form a tree over all its nodes.
3. Each node's text gets a sketch: how many shingles it has, and how many fall into each of some
   hundred cells. The smaller counts of two sketches, summed, are at least what two texts share;
   if even that is too little, the pair is dissimilar (see `possible`). No similar pair is lost.
   Edges that pass are verified on the real texts; verified ones are links.
4. Components come from alternating large-star and small-star steps (joins and aggregates) over the
   forests that bounded parts of the links form; links of one part need no step.
5. A key whose nodes ended in several components may hide links between them, as only edges
   of the tree were compared. All pairs of its nodes in different components are held against
   their sketches and then verified, block by block inside tasks that take a bounded part of a
   key's pairs each; a task returns only the links that connect something. Then step 4 runs
   again over all links. So no link between nodes that share a key is lost, and no list of a
   key's pairs is ever made. Nodes of one large component are never sent to each other's parts.

Nodes are 64-bit hashes of texts, so copies are one node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import U64, released
from pointloom.session import shared_dir

#: Entries that a map task gathers before it sends them; parts per shuffle partition.
FLUSH, SPREAD = 1 << 19, 4
#: Bytes up to which a table is broadcast, and bytes counted for each row besides its texts and lists.
BROADCAST_BYTES, ROW_BYTES = 24 << 20, 48
#: A key is hot from this share of all rows on; so at most as many as its inverse are hot.
HOT_SHARE = 1 / 1000
#: Edges in a file of a saved step.
FILE_ROWS = 100_000
#: Nodes of a block whose pairs are compared at once; nodes of a bucket that one task takes.
BLOCK, CHUNK_ROWS = 64, 512
#: Bytes of a sketch before its cells: numbers of different and of all shingles, 32 bits each.
HEAD = 8
#: The largest number in a cell of a sketch.
FULL = 15


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table, with a broadcast hint if its rows have at most so many bytes in all; else as it is, for a shuffled join."""
    width = F.lit(ROW_BYTES)
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind == "array":
            width = width + 8 * F.greatest(F.size(field.name), F.lit(0))
        elif kind == "struct":
            width = width + F.coalesce(F.length(F.to_json(field.name)), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Removes the files of a saved table that nothing reads any more, and the shuffle files of plans that are gone.

    Spark removes these once the driver has collected the objects that name them, which by itself it seldom does.
    """
    plan = df._jdf.queryExecution().analyzed()
    name = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
    if name is not None and name.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    df.sparkSession._jvm.System.gc()


def lookup(rows: DataFrame, values: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with saved values (key once each; column `n`: rows that a key has), without a hot key in one task.

    Keys that hold a share of HOT_SHARE or more are at most 1 / HOT_SHARE in number and are broadcast.
    """
    hinted = small(values)
    if hinted is not values:
        return rows.join(hinted.drop(n), key)
    least = (values.agg(F.sum(n)).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(values.where(F.col(n) >= least).drop(n))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(values.where(F.col(n) < least).drop(n), key))


def tree(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their least nodes) and, for all other nodes of a key, (places of the key, nodes)."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    # Most keys have one node: only the nodes of the others are put in order.
    several = ~new
    several[:-1] |= several[1:]
    at = np.flatnonzero(several)
    nodes[at] = nodes[at[np.lexsort((nodes[at], keys[at]))]]
    other = ~new
    other[1:] &= nodes[1:] != nodes[:-1]
    return keys[new], nodes[new], (np.cumsum(new) - 1)[other], nodes[other]


def _rows(part: list[int], kind: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def send(entries: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Map side: rows (part, kind, data); kind 0 holds the number of keys, keys, least nodes and those of the keys that have edges here; kind 1 keys, least nodes and nodes of edges."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys, least, at, others = tree(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
        held.clear()
        part = (keys.view(U64) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        tied = np.bincount(at, minlength=len(keys)) > 0
        out: tuple[list, list, list] = ([], [], [])
        for p in np.unique(part).tolist():
            own = order[cut[p] : cut[p + 1]]
            out[0].append(p)
            out[1].append(0)
            out[2].append(np.int64(len(own)).tobytes() + keys[own].tobytes() + least[own].tobytes() + keys[own[tied[own]]].tobytes())
        for i in range(0, len(others), 1 << 14):
            some = at[i : i + (1 << 14)]
            out[0].append(int(keys[some[0]].view(U64) % U64(parts)))
            out[1].append(1)
            out[2].append(keys[some].tobytes() + least[some].tobytes() + others[i : i + (1 << 14)].tobytes())
        yield _rows(*out)

    n = 0
    for keys, nodes in entries:
        held.append((keys, nodes))
        n += len(keys)
        if n >= FLUSH:
            yield from flush()
            n = 0
    yield from flush()


def _edges(keys: np.ndarray, least: np.ndarray, nodes: np.ndarray, lone: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(least, pa.int64()), pa.array(nodes, pa.int64()), pa.array(lone, pa.bool_())], names=["key", "a", "b", "lone"])


def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, rows ordered by part: edges (key, a, b, lone), a the least node known for the key.

    lone says that the edge is known to be the only one of its key, so that no pair of it is left to compare.
    """
    now, held = -1, []

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            parts = [np.split(x[1:], [x[0], 2 * x[0]]) for x in (np.frombuffer(y, np.int64) for y in held)]
            held.clear()
            keys, least, at, others = tree(*(np.concatenate([x[k] for x in parts]) for k in range(2)))
            lone = np.bincount(at, minlength=len(keys)) == 1
            lone[np.searchsorted(keys, np.concatenate([x[2] for x in parts]))] = False
            for i in range(0, len(others), 1 << 16):
                some = at[i : i + (1 << 16)]
                yield _edges(keys[some], least[some], others[i : i + (1 << 16)], lone[some])

    for batch in batches:
        for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if part != now:
                yield from done()
                now = part
            if kind == 0:
                held.append(data.as_py())
            else:
                key, a, b = np.frombuffer(data.as_py(), np.int64).reshape(3, -1)
                yield _edges(key, a, b, np.zeros(len(key), bool))
    yield from done()


def bucket_edges(rows: DataFrame, sign: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Edges (key, a, b, lone) of all keys with several nodes; sign yields (keys, nodes) of a task's batches."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = SPREAD * width
    blobs = rows.mapInArrow(released(lambda batches: send(sign(batches), parts)), "part int, kind int, data binary")
    return saved(blobs.repartition(width, "part").sortWithinPartitions("part").mapInArrow(released(receive), "key bigint, a bigint, b bigint, lone boolean"))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (hi, lo) -> for each node that FILE_ROWS of them reach, an edge to the least node that they connect it with."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in held], 1)
        held.clear()
        nodes, place = np.unique(ends, return_inverse=True)
        above = list(range(len(nodes)))
        for a, b in place.reshape(2, -1).T.tolist():
            while above[a] != a:
                above[a] = a = above[above[a]]
            while above[b] != b:
                above[b] = b = above[above[b]]
            above[max(a, b)] = min(a, b)
        for k in range(len(above)):  # what is above a node is less, so it is done before
            above[k] = above[above[k]]
        root = np.array(above, np.int64)
        hi = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hi], pa.int64()), pa.array(nodes[root[hi]], pa.int64())], names=["hi", "lo"])

    for batch in batches:
        for at in range(0, len(batch), FILE_ROWS):
            held.append(batch.slice(at, FILE_ROWS))
            if sum(map(len, held)) > FILE_ROWS:
                last = held.pop()
                yield from flush()
                held.append(last)
    if held:
        yield from flush()


def stars(edges: DataFrame) -> DataFrame:
    """(node, comp) of edges (hi, lo) that all lead to the least node of their component."""
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(edges.select("lo", "lo").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in links (a, b); comp is the least node of the component.

    Parts of FILE_ROWS edges are first worked off by themselves; a single part needs nothing else.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    parts = edges.count() // FILE_ROWS + 1
    edges = saved(edges.coalesce(parts).mapInArrow(released(forest), "hi bigint, lo bigint"))
    if parts == 1:
        return stars(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.col("hi"), F.min("lo")).alias("m"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = large.join(least, "hi")
        star = star.select("hi", F.col("m").alias("lo")).union(star.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        # As many files as the edges need, not one for each shuffle partition.
        before, edges = edges, saved(star.coalesce(state[0] // FILE_ROWS + 1) if state else star)
        forget(before)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40)))).first()
        if tuple(now) == state:
            return stars(edges)
        state = tuple(now)


def sketches(shingle: np.ndarray, row: np.ndarray, weight: np.ndarray | None, rows: int, cells: int) -> np.ndarray:
    """rows x (HEAD + cells / 2) bytes of different shingles (64-bit hashes), the row of each and its weight (whole numbers; None: 1).

    A cell counts up to FULL in half a byte; FULL stands for "so many or more".
    """
    out = np.zeros((rows, HEAD + cells // 2), np.uint8)
    place = row * cells + (shingle % U64(cells)).astype(np.int64)
    different = np.bincount(row, minlength=rows)
    every = different if weight is None else np.bincount(row, weights=weight, minlength=rows)
    out[:, :HEAD] = np.stack([different, every], 1).astype("<u4").view(np.uint8)
    counts = np.bincount(place, weights=weight, minlength=rows * cells)
    counts = np.minimum(counts, FULL).astype(np.uint8).reshape(rows, cells)
    out[:, HEAD:] = counts[:, : cells // 2] | counts[:, cells // 2 :] << 4
    return out


def unpacked(sketch: np.ndarray) -> np.ndarray:
    """Sketches with a byte for each cell."""
    return np.concatenate([sketch[..., :HEAD], sketch[..., HEAD:] & FULL, sketch[..., HEAD:] >> 4], -1)


def possible(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two texts may be similar, by their unpacked sketches (last axis; the others are broadcast): false only where they cannot be.

    Texts without repeated shingles share at most s of them, s the sum of the smaller counts, so
    their Jaccard similarity is at most s / (n + m - s). With weights, a term of the probability
    Jaccard similarity is at most the smaller one of its two shares, so the sum of the smaller
    shares of the cells bounds the similarity.
    """
    n, m = (np.ascontiguousarray(t[..., :HEAD]).view("<u4").astype(np.float32) for t in (x, y))
    least = np.minimum(x[..., HEAD:], y[..., HEAD:])
    shared = least.sum(-1, dtype=np.int32)
    out = shared * np.float32(1 + threshold) >= np.float32(threshold) * (n[..., 0] + m[..., 0]) * np.float32(1 - 1e-5)
    weighted = (n[..., 0] != n[..., 1]) | (m[..., 0] != m[..., 1])
    if weighted.any():
        at = np.nonzero(weighted)
        a, b = np.broadcast_to(x, least.shape[:-1] + x.shape[-1:])[at], np.broadcast_to(y, least.shape[:-1] + y.shape[-1:])[at]
        wa, wb = (np.maximum(np.ascontiguousarray(t[:, :HEAD]).view("<u4")[:, 1], 1).astype(np.float32)[:, None] for t in (a, b))
        out[at] = np.minimum(a[:, HEAD:] / wa, b[:, HEAD:] / wb).sum(1) >= np.float32(threshold * (1 - 1e-4))
    full = least.max(-1) == FULL
    return out | full if full.any() else out


def fixed(column: pa.Array) -> np.ndarray:
    """A binary column whose values have one length, as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def sketched(texts: DataFrame, sketch: Callable[[list], np.ndarray]) -> DataFrame:
    """(node, text) with the column sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                rows = sketch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in rows], pa.binary())], names=["node", "text", "sketch"])

    return texts.select("node", "text").mapInArrow(released(run), "node bigint, text string, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, similar: Callable[[list, list], np.ndarray], threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar; texts has (node, text, sketch)."""

    def both(rows: DataFrame, value: str) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(texts.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end)
        return rows.select("a", "b", f"{value}_a", f"{value}_b")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            x, y = fixed(batch.column(2)), fixed(batch.column(3))
            for at in range(0, len(batch), 1024):
                ok[at : at + 1024] = possible(unpacked(x[at : at + 1024]), unpacked(y[at : at + 1024]), threshold)
            yield batch.select([0, 1]).filter(pa.array(ok))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(similar(batch.column(2).to_pylist(), batch.column(3).to_pylist()), pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    open_ = both(pairs, "sketch").mapInArrow(released(screen), "a bigint, b bigint")
    return both(open_, "text").mapInArrow(released(run), "a bigint, b bigint")


def cross_links(batches: Iterator[pa.RecordBatch], compare: Callable, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, chunk, node, comp, text, sketch) ordered by (key, lo, hi) -> links between components.

    compare(texts) gives a function of two index blocks, a mask of pairs and the components of
    both, that returns which of the pairs are similar, exactly. Small buckets are worked
    off some hundred at a time; texts that no pair is left for are not looked at.
    """
    now: tuple | None = None
    rows: list[pa.RecordBatch] = []  # of the bucket that is being read
    held: list[tuple[bool, pa.RecordBatch]] = []  # whether all pairs are wanted, the bucket's rows
    size = 0

    def blocks(whole: bool, lo: np.ndarray, own: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Index blocks of a bucket and their pairs that are to be compared."""
        prints = unpacked(prints)
        first, second = np.flatnonzero(lo), np.flatnonzero(lo if whole else ~lo)
        for i in range(0, len(first), BLOCK):
            for j in range(i if whole else 0, len(second), BLOCK):
                x, y = first[i : i + BLOCK], second[j : j + BLOCK]
                mask = own[x][:, None] != own[y][None, :]
                if whole and i == j:
                    mask &= x[:, None] < y[None, :]
                if mask.any():
                    mask &= possible(prints[x][:, None], prints[y][None, :], threshold)
                    if mask.any():
                        yield x, y, mask

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if not held:
            return
        every = pa.Table.from_batches([x for _, x in held]).combine_chunks()
        node, comp = (np.asarray(every.column(c)) for c in ("node", "comp"))
        prints = np.concatenate([fixed(x.column("sketch")) for _, x in held])
        at, todo, needed = 0, [], set()
        for whole, bucket in held:
            n = len(bucket)
            own = comp[at : at + n].copy()
            lo = np.asarray(bucket.column("chunk")) == bucket.column("lo")[0].as_py()
            for x, y, mask in blocks(whole, lo, own, prints[at : at + n]):
                todo.append((at, own, x, y, mask))
                needed.update((at + x[mask.any(1)]).tolist(), (at + y[mask.any(0)]).tolist())
            at += n
        links: list[tuple[int, int]] = []
        if todo:
            order = np.array(sorted(needed))
            place = np.full(len(node), -1)
            place[order] = np.arange(len(order))
            similar = compare(every.column("text").take(pa.array(order)).to_pylist())
            for at, own, x, y, mask in todo:
                mask = mask & (own[x][:, None] != own[y][None, :])
                p, q = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
                if not len(p):
                    continue
                x, y = x[p], y[q]
                for i, j in zip(*np.nonzero(similar(place[at + x], place[at + y], mask[np.ix_(p, q)], (own[x], own[y])))):
                    i, j = x[i], y[j]
                    if own[i] != own[j]:
                        links.append((node[at + i], node[at + j]))
                        own[own == own[j]] = own[i]
        held.clear()
        size = 0
        if links:
            ends = np.array(links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"])

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if rows:
            bucket = rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            rows.clear()
            held.append((now[1] == now[2], bucket))
            size += len(bucket)
        if size >= 2 * CHUNK_ROWS:
            yield from flush()

    for batch in batches:
        if not len(batch):
            continue
        names = np.stack([np.asarray(batch.column(c)) for c in range(3)])
        cut = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), len(batch)]
        for i, j in zip(cut[:-1], cut[1:]):
            if (name := tuple(names[:, i].tolist())) != now:
                yield from done()
                now = name
            rows.append(batch.slice(i, j - i))
    yield from done()
    yield from flush()


def dealt(members: DataFrame) -> DataFrame:
    """Members (key, node, comp) of buckets with several components, once for each pair (lo, hi) of chunks that they have a part in.

    A large component has chunks of its own, the others of a bucket share chunks. Two chunks of one
    component are not paired, so a bucket with one huge component and some further nodes stays linear.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    # The only pair of a bucket of two is its edge, which was verified.
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("comps"), F.sum(F.when(F.col("n") <= CHUNK_ROWS, F.col("n")).otherwise(0)).alias("rest")).where("comps > 1 and total > 2").drop("comps")
    mixed = mixed.withColumn("shared", F.ceil(F.col("rest") / CHUNK_ROWS)).drop("rest")
    own = sizes.where(F.col("n") > CHUNK_ROWS).withColumn("parts", F.ceil(F.col("n") / CHUNK_ROWS)).drop("n")
    own = own.withColumn("upto", F.sum("parts").over(Window.partitionBy("key").orderBy("comp")))
    of_key = own.groupBy("key").agg(F.sum("parts").alias("more"))
    open_ = members.join(mixed.join(of_key, "key", "left").withColumn("more", F.coalesce("more", F.lit(0))), "key").join(own, ["key", "comp"], "left")
    begin = F.col("shared") + F.col("upto") - F.col("parts")
    chunk = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("comp"), F.greatest("shared", F.lit(1)))).otherwise(begin + F.pmod(F.xxhash64("node"), F.col("parts")))
    last = F.col("shared") + F.col("more")
    zero, none = F.lit(0).cast("bigint"), F.expr("cast(array() as array<bigint>)")
    before = F.when(begin > 0, F.sequence(zero, begin - 1)).otherwise(none)
    after = F.when(begin + F.col("parts") < last, F.sequence(begin + F.col("parts"), last - 1)).otherwise(none)
    others = F.when(F.col("parts").isNull(), F.sequence(zero, last - 1)).otherwise(F.concat(before, after))
    out = open_.select("key", "node", "comp", chunk.alias("chunk"), F.explode(others).alias("other"))
    return out.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "comp")


def linked(edges: DataFrame, texts: DataFrame, similar: Callable, compare: Callable, threshold: float) -> DataFrame:
    """(node, comp) of all nodes with a link; steps 3 to 5. texts has (node, text, sketch)."""
    links = saved(verified(edges.select("a", "b").distinct(), texts, similar, threshold))
    comps = components(links)
    rest = edges.where("not lone")
    members = rest.select("key", F.col("a").alias("node")).union(rest.select("key", "b")).distinct().join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(saved(members)).join(texts, "node").select("key", "lo", "hi", "chunk", "node", "comp", "text", "sketch").repartition(width, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = saved(rows.mapInArrow(released(lambda b: cross_links(b, compare, threshold)), "a bigint, b bigint").distinct())
    if more.isEmpty():
        return comps
    return components(links.union(more))
