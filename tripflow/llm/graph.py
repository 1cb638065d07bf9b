"""Near-duplicate embeddings through a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to the shards of their nearest centres, `overlap` each, so shards overlap.
Within a shard each node gets an adjacency list: of its nearest nodes, nearest first, one is taken unless a node taken
before is nearer to it by the factor ALPHA (robust pruning), besides a few far ones and the reverse edges. The lists that
a node got in its shards are united, so a list leads from one shard into others; the nodes of other shards that the lists
of a shard name are added to it. There each node is searched for in the shard of its nearest centre: greedily from the
shard's medoids and from the node's own list, with a list of candidates that is widened as long as half of it lies within
range. What is found is verified by the exact cosine in double precision. No graph or list passes through the driver.

A recall audit holds the link counts of AUDIT_NODES nodes, chosen by a hash, against all nodes by brute force; below
TARGET_RECALL everything is built again with twice the overlap. Centres are fitted on a sample of at most SAMPLE_BYTES;
every node is indexed and searched for.

Shards of more than PIECE_ROWS nodes are split into pieces, and their queries into as many, and each part of the queries
is searched for in each piece; so a group of near copies of any size is split. Links are counted where they are found
and never listed; what leaves a piece is each node's count and its root in the piece's forest, of which the components are
made. A link counts for a node if the search from that node finds it.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing, and vectors only with those
of their own length. Rows that share an id are one vector, the least in byte order; rows without an id come back with a null
component, no links and not kept. An empty table gives an empty result; other columns are not looked at.
"""

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import written
from tripflow.llm.components import connected_components

NEAR = 0.95
# Two nodes within range of a third are at least so near: the cosine of twice the angle.
BRIDGE = 2 * NEAR**2 - 1
# Centres: one for so many nodes, no two of them as near as SEPARATION, fitted on a sample in so many rounds.
CENTRE_ROWS, MAX_CENTRES, SEPARATION, ROUNDS = 512, 65_536, 0.9, 3
SAMPLE_BYTES = 32 << 20
OVERLAPS = (2, 4, 8)
PIECE_ROWS = 2_048
# Adjacency lists: candidates, near and far neighbours, and reverse edges at most.
CANDIDATES, NEIGHBOURS, FAR, REVERSE = 64, 20, 4, 24
ALPHA = 1.2
# Candidates kept by a search at first, and medoids that it starts from.
LIST, MEDOIDS = 32, 8
AUDIT_NODES, TARGET_RECALL = 256, 0.95
BLOCK = 512

log = logging.getLogger(__name__)


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """`vec_id`, `size`, `key` and `vector` (unit length, as doubles) of the usable rows, one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, keys, found = [], [], [], []
            for vec_id, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.asarray(values.values.fill_null(np.nan)) if values.is_valid else np.zeros(0)
                top = np.abs(x).max(initial=0)
                if not (np.isfinite(top) and top > 0):
                    continue
                x = x / top
                # Adding zero makes -0.0 and 0.0 alike.
                raw = (x / np.sqrt(x @ x) + 0.0).astype("<f8").tobytes()
                ids.append(vec_id)
                sizes.append(len(x))
                keys.append(xxhash.xxh3_128_digest(raw))
                found.append(raw)
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "size", "key", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    found = rows.where("vec_id is not null").mapInArrow(run, "vec_id long, size int, key binary, vector binary")
    least = F.min(F.struct("vector", "size", "key")).alias("x")
    return found.groupBy("vec_id").agg(least).select("vec_id", "x.size", "x.key", "x.vector")


def fit_centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """At most `wanted` centres, none of them within SEPARATION of another."""

    def apart(points: np.ndarray) -> np.ndarray:
        kept = np.zeros((0, points.shape[1]))
        for i in range(0, len(points), BLOCK):
            block = points[i : i + BLOCK]
            block = block[(block @ kept.T).max(axis=1, initial=-1) < SEPARATION]
            near = np.tril(block @ block.T, -1) >= SEPARATION
            taken = np.zeros(len(block), bool)
            for j in range(len(block)):
                taken[j] = not (near[j] & taken).any()
            kept = np.concatenate([kept, block[taken]])
            if len(kept) >= wanted:
                break
        return kept[:wanted]

    centres = apart(sample)
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        for i in range(0, len(sample), BLOCK):
            block = sample[i : i + BLOCK]
            np.add.at(sums, (block @ centres.T).argmax(1), block)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return apart(centres)


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard's nodes, given as unit vectors, by their places."""
    n = len(x)
    draw = np.random.default_rng(n)
    size = min(CANDIDATES, n - 1)
    if size < 1:
        return [np.zeros(0, np.int64)] * n
    sources, targets, cosines = [], [], []
    for i in range(0, n, BLOCK):
        rows = np.arange(i, min(i + BLOCK, n))
        cos = x[rows] @ x.T
        cos[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-cos, size - 1, axis=1)[:, :size]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, 1), axis=1, kind="stable"), 1)
        for candidates, most in ((near, NEIGHBOURS), (draw.integers(0, n, (len(rows), size)), FAR)):
            to_node = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(cos, candidates, 1), 0))
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("bid,bjd->bij", x[candidates], x[candidates], optimize=True), 0))
            alive, taken = candidates != rows[:, None], np.zeros(candidates.shape, bool)
            for j in range(size):
                pick = alive[:, j] & (taken.sum(1) < most)
                taken[:, j] = pick
                # A candidate that is much nearer to the one picked than to the node goes.
                alive &= ~((ALPHA * between[:, j] <= to_node) & pick[:, None])
            at, place = np.nonzero(taken)
            sources.append(rows[at])
            targets.append(candidates[at, place])
            cosines.append(cos[at, candidates[at, place]])
    a, b, c = np.concatenate(sources), np.concatenate(targets), np.concatenate(cosines)
    # Of the reverse edges the nearest REVERSE stay.
    order = np.lexsort((-c, b))
    rank = np.arange(len(b)) - np.searchsorted(b[order], b[order])
    back = order[rank < REVERSE]
    a, b = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
    order = np.argsort(a, kind="stable")
    return [np.unique(part) for part in np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()])


def _build(table: pa.Table) -> pa.Table:
    """The nodes of a piece to their adjacency lists."""
    table = table.sort_by("node")
    ids, x = table["node"].to_numpy(), _matrix(table["vector"])
    lists = robust_prune(x)
    close = [near[x[near] @ x[i] >= BRIDGE] for i, near in enumerate(lists)]
    ints = pa.list_(pa.int64())
    columns = {name: pa.array([ids[v] for v in found], ints) for name, found in (("near", lists), ("close", close))}
    return pa.table({"node": pa.array(ids), **columns})


class Graph:
    """The part of the graph that a task holds."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x = x
        self.near = np.full((len(x), max(map(len, lists), default=0)), -1)
        for i, found in enumerate(lists):
            self.near[i, : len(found)] = found
        # The medoid, and nodes far from it and each other.
        starts = [int((x @ x.mean(0)).argmax())]
        nearest = x @ x[starts[0]]
        while len(starts) < min(MEDOIDS, len(x)):
            starts.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[starts[-1]])
        self.medoids = np.unique(starts)

    def within(self, q: np.ndarray, own: int | None) -> np.ndarray:
        """Places of the nodes found within range of `q`, which may be a node itself, at place `own`."""
        ids = self.medoids if own is None else np.union1d(self.medoids, [own])
        seen = np.zeros(len(self.x), bool)
        seen[ids] = True
        cos, done, width = self.x[ids] @ q, np.zeros(len(ids), bool), LIST
        while True:
            top = np.argpartition(-cos, width - 1)[:width] if len(ids) > width else np.arange(len(ids))
            todo = top[~done[top]]
            if len(todo):
                done[todo] = True
                found = self.near[ids[todo]].ravel()
                found = found[found >= 0]
                found = np.unique(found[~seen[found]])
                seen[found] = True
                ids, cos = np.concatenate([ids, found]), np.concatenate([cos, self.x[found] @ q])
                done = np.concatenate([done, np.zeros(len(found), bool)])
            elif len(ids) > width and 2 * np.count_nonzero(cos >= NEAR) >= width:
                width *= 2
            else:
                return ids[cos >= NEAR]


def _search(table: pa.Table) -> pa.Table:
    """A piece's nodes and queries to link counts of the queries and roots of all that are linked."""
    asked = np.asarray(table["query"].combine_chunks())
    nodes = table.filter(pa.array(~asked)).sort_by("node")
    queries = table.filter(pa.array(asked)).sort_by("node")
    out = {"node": [], "n": [], "root": []}
    if len(nodes) and len(queries):
        ids, copies = nodes["node"].to_numpy(), nodes["copies"].to_numpy()
        lists = []
        for near in nodes["near"].to_pylist():
            places = np.minimum(np.searchsorted(ids, near or []), len(ids) - 1)
            lists.append(places[ids[places] == np.array(near or [], np.int64)])
        graph = Graph(_matrix(nodes["vector"]), lists)
        q_ids = queries["node"].to_numpy()
        names = np.union1d(ids, q_ids)
        place_of, parent = np.searchsorted(names, ids), np.arange(len(names))
        counts, linked = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for q_id, q in zip(q_ids.tolist(), _matrix(queries["vector"]), strict=True):
            own = int(np.searchsorted(ids, q_id))
            own = own if own < len(ids) and ids[own] == q_id else None
            hits = graph.within(q, own)
            hits = hits[ids[hits] != q_id]
            if not len(hits):
                continue
            here = int(np.searchsorted(names, q_id))
            counts[here] = copies[hits].sum()
            group = np.append(place_of[hits], here)
            linked[group] = True
            roots = parent[group]
            while (parent[roots] != roots).any():
                roots = parent[roots]
            parent[roots] = parent[group] = roots.min()
        while (parent[parent] != parent).any():
            parent = parent[parent]
        touched = np.flatnonzero(linked)
        out = {"node": names[touched], "n": counts[touched], "root": names[parent[touched]]}
    return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})


def _linked(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """`node`, `n` and `root`, a row for each node and piece in which it has links; `nodes` has `node`, `vector`, `copies`."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.slice(i, BLOCK)
                cos = _matrix(part.column(1)) @ centres.T
                found = np.argsort(-cos, axis=1, kind="stable")[:, :overlap]
                rows = pa.array(np.repeat(np.arange(len(part)), found.shape[1]))
                first = np.tile(np.arange(found.shape[1]) == 0, len(part))
                columns = [pa.array(found.ravel().astype(np.int32)), pa.array(first), *[c.take(rows) for c in part.columns]]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "home", "node", "vector", "copies"])

    dealt = nodes.select("node", "vector", "copies").mapInArrow(deal, "shard int, home boolean, node long, vector binary, copies long")
    dealt = written(dealt, "shards")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("home"))
    # At most MAX_CENTRES rows.
    sizes = F.broadcast(
        sizes.select(
            "shard",
            F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"),
            F.greatest(F.ceil(F.col("home") / PIECE_ROWS), F.lit(1)).cast("int").alias("parts"),
        )
    )
    own_piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    members = dealt.join(sizes, "shard").withColumn("piece", own_piece)
    lists = members.select("shard", "piece", "node", "vector").groupBy("shard", "piece").applyInArrow(_build, "node long, near array<long>, close array<long>")
    united = lists.groupBy("node").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")))
    united = written(united, "adjacency")
    held = members.select("shard", "node", "vector", "copies").join(united, "node")
    # What the lists of a shard name in other shards, as far as it may lie within range of what lies within range.
    named = held.select("shard", F.explode("close").alias("node")).distinct()
    others = named.join(dealt.select("shard", "node"), ["shard", "node"], "left_anti")
    others = others.join(nodes.select("node", "vector", "copies"), "node").join(united, "node")
    columns = ["shard", "node", "vector", "copies", "near"]
    graph = held.select(*columns).unionByName(others.select(*columns)).join(sizes, "shard").withColumn("piece", own_piece)
    graph = graph.select(*columns, "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"))
    own_part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    queries = dealt.where("home").join(sizes, "shard").withColumn("part", own_part)
    queries = queries.select(
        "shard", "node", "vector", "copies", F.lit(None).cast("array<long>").alias("near"),
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "part", F.lit(True).alias("query"),
    )
    units = graph.unionByName(queries).groupBy("shard", "piece", "part")
    return written(units.applyInArrow(_search, "node long, n long, root long"), "links")


def audit(nodes: DataFrame, counts: DataFrame, total: int) -> float:
    """The share of the links of some AUDIT_NODES nodes that are counted in `counts` (`node`, `n`)."""
    chosen = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) < int(min(1.0, AUDIT_NODES / max(total, 1)) * (1 << 30))
    sample = nodes.where(chosen).join(counts, "node", "left").select("node", "vector", F.coalesce("n", F.lit(0)).alias("n"))
    rows = sample.collect()
    if not rows:
        return 1.0
    ids, asked = np.array([r.node for r in rows]), np.stack([np.frombuffer(r.vector, "<f8") for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.slice(i, BLOCK)
                near = _matrix(part.column(1)) @ asked.T >= NEAR
                near &= part.column(0).to_numpy()[:, None] != ids
                yield pa.RecordBatch.from_arrays([pa.array([int((near * part.column(2).to_numpy()[:, None]).sum())])], names=["n"])

    true = nodes.select("node", "vector", "copies").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return sum(r.n for r in rows) / true if true else 1.0


def _of_one_size(nodes: DataFrame, size: int, total: int) -> DataFrame:
    """`node`, `n` and `root` for the nodes of one length of vector."""
    wanted = min(MAX_CENTRES, -(-total // CENTRE_ROWS))
    most = max(1, min(total, SAMPLE_BYTES // (8 * size)))
    chosen = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(most / total * (1 << 30))
    sample = nodes.where(chosen).orderBy(F.xxhash64("node", F.lit(3)), "node").select("vector").collect()
    centres = fit_centres(np.stack([np.frombuffer(r.vector, "<f8") for r in sample]), wanted)
    for overlap in OVERLAPS:
        found = _linked(nodes, centres, overlap)
        recall = audit(nodes, found.groupBy("node").agg(F.sum("n").alias("n")), total)
        log.info("recall %.4f at an overlap of %d shards of %d", recall, overlap, len(centres))
        if recall >= TARGET_RECALL or overlap >= len(centres):
            break
    else:
        log.warning("recall %.4f at the greatest overlap", recall)
    return found


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """`vec_id`, `n_links`, `component_id` and `kept` for each vector."""
    rows = written(unit_vectors(embeddings), "unit-vectors")
    same = rows.groupBy("size", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = written(same, "nodes")
    found = None
    for size, total in sorted(map(tuple, nodes.groupBy("size").agg(F.count("*")).collect())):
        part = _of_one_size(nodes.where(F.col("size") == size), size, total)
        found = part if found is None else found.unionByName(part)
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    named = ids.where("vec_id is not null").distinct()
    if found is None:
        whole = named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        classes = nodes.join(counts, "node", "left").join(roots, "node", "left")
        classes = classes.select(
            "size", "key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")
        )
        linked = rows.join(classes, ["size", "key"]).select("vec_id", "n_links", "component_id")
        whole = named.join(linked, "vec_id", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
        )
    unnamed = ids.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
