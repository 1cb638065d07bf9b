"""Exact top-k inner products through a pivot-distance index.

Vectors x become whole numbers floor(256 * x). With M the greatest norm, x gets one more component
sqrt(M^2 - |x|^2) and a query a zero, which turns the greatest inner products into the least distances:
|q - x|^2 = |q|^2 + M^2 - 2<q, x>. Each vector is keyed by its nearest pivot and its distance from it; range
partitions in the order of these keys are cut into annuli of at most CHUNK_ROWS vectors. By the triangle inequality
no vector of an annulus whose distances from a pivot p lie in [a, b] is nearer to q than the gap between d(q, p) and
[a, b]; an annulus keeps that range for every pivot.

Queries are keyed by their own nearest pivot and distance and cut into blocks of neighbours. A block first searches the
annuli of its pivots around its distances, which gives a bound for each k-th best score; then all others whose gap allows
a score as good. Neighbouring annuli make a region, which a task holds while the blocks that ask for it pass by: the
vectors are shuffled once for each pass, a block once for each region. In a block an annulus is only scored for the queries
that its gaps admit.

The pivots are fitted on at most SAMPLE_ROWS vectors; all vectors are indexed and nothing is left out, so the result is
exact: equal scores go to the smaller id. Ranges are cut by id as well, so equal vectors, however many, are split.

Null vectors, empty ones, those with a null or non-finite component, and rows without an id take no part. Vectors of
different lengths have no inner product, so each length is searched by itself. All finite vectors take part: components
and scores beyond the range of a long stand at its ends. A row is no candidate for a query with its own id; repeated
candidates hold several ranks, repeated queries count once. Empty tables give an empty result; other columns are not
looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import written

SCALE = 256
# One pivot for so many vectors, within these limits.
PIVOT_ROWS, PIVOTS = 8_192, (32, 256)
SAMPLE_ROWS = 4_096
CHUNK_ROWS = 1_024
REGION_CHUNKS = 16
QUERY_EVERY = 50
K = 5
# The ends of a long, as far as doubles reach.
LARGEST = float((1 << 63) - (1 << 10))
CHUNK = "region string, chunk string, pivot int, near double, far double, lows binary, highs binary, ids binary, vectors binary"
KEYED = "pivot int, distance double, row int, vec_id long, vector binary, distances binary"


def matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and those as whole numbers."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    usable = lengths == size
    values = column.filter(pa.array(usable)).flatten()
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan)) if len(values) else np.zeros(0)
    flat = flat.reshape(-1, size)
    fine = np.isfinite(flat).all(axis=1)
    scaled = np.floor(np.clip(flat[fine], -LARGEST / SCALE, LARGEST / SCALE) * SCALE)
    return np.flatnonzero(usable)[fine], scaled


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, within the range of a long."""
    top = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if top < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    if top < 2**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    exact = queries.astype(np.int64).astype(object) @ vectors.astype(np.int64).astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Pivots:
    """Points of the space with one more component, chosen far from each other in a sample."""

    def __init__(self, sample: np.ndarray, norm2: float, wanted: int = PIVOTS[0]):
        self.norm2 = norm2
        points = self.lift(sample)
        chosen = [0]
        nearest = ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(wanted, len(points)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
        self.points = points[chosen]
        # One step towards the middle of what each is nearest to.
        own = self.distances(points).argmin(1)
        self.points = np.stack([points[own == p].mean(0) if (own == p).any() else self.points[p] for p in range(len(chosen))])

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm2 - (vectors**2).sum(1), 0.0)
        return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * points @ self.points.T
        return np.sqrt(np.maximum(squares, 0.0))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1))

    def best_score(self, queries: np.ndarray, distances: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """No vector of an annulus scores more; above it by more than rounding can do.

        `distances` are those of the queries from each pivot, `lows` and `highs` the annulus's ranges.
        """
        whole = (queries**2).sum(1) + self.norm2
        gap = np.maximum(np.maximum(lows - distances, distances - highs), 0.0).max(axis=1)
        gap = np.maximum(gap - 1e-6 * (1 + np.sqrt(whole) + distances.max(axis=1)), 0.0)
        return (whole - gap**2) / 2 + 1e-9 * whole + 1.0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to annuli: at most CHUNK_ROWS neighbours of one pivot."""
    held: list[tuple] = []
    region, n = "", 0

    def out(rows):
        ids = np.array([r[3] for r in rows], "<i8").tobytes()
        distances = np.stack([np.frombuffer(r[5], "<f8") for r in rows])
        name = f"{rows[0][0]}:{rows[0][1]!r}:{rows[0][2]}:{rows[0][3]}"
        values = [
            name if n % REGION_CHUNKS == 0 else region, name, rows[0][0], rows[0][1], rows[-1][1],
            distances.min(0).tobytes(), distances.max(0).tobytes(), ids, b"".join(r[4] for r in rows),
        ]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4)
        names = [c.split()[0] for c in CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and (row[0] != held[0][0] or len(held) == CHUNK_ROWS):
                found = out(held)
                region, n, held = found.column(0)[0].as_py(), n + 1, []
                yield found
            held.append(row)
    if held:
        yield out(held)


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id`, `score`: the k best of `vectors` for each row of `queries`.

    Both have `vec_id` and `embedding`.
    """

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(
            "vec_id is not null and e is not null"
        )

    vectors, queries = plain(vectors), plain(queries)
    sizes = vectors.groupBy(F.size("e").alias("size")).agg(F.count("*").alias("n")).where("size > 0 and n > 1")
    found = None
    for size, n in sorted(map(tuple, sizes.collect())):
        part = _of_one_size(vectors.where(F.size("e") == size), queries.where(F.size("e") == size), size, n, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], RESULT) if found is None else found


def _of_one_size(vectors: DataFrame, queries: DataFrame, size: int, n: int, k: int) -> DataFrame | None:

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values = matrix(b.column(1), size)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)),
                    pa.array([r.tobytes() for r in values], pa.binary()),
                    pa.array((values**2).sum(1), pa.float64()),
                ],
                names=["vec_id", "vector", "norm2"],
            )

    numbers = vectors.mapInArrow(whole, "vec_id long, vector binary, norm2 double")
    norm2 = numbers.agg(F.max("norm2")).first()[0]
    if norm2 is None:
        return None
    sample = numbers.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()
    wanted = min(max(n // PIVOT_ROWS, PIVOTS[0]), PIVOTS[1])
    pivots = Pivots(np.stack([np.frombuffer(r.vector, "<f8") for r in sample]), norm2, wanted)

    def keyed(batches: Iterator[pa.RecordBatch], asked: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values = matrix(b.column(1), size)
            distances = pivots.of_queries(values) if asked else pivots.distances(pivots.lift(values))
            nearest = distances.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nearest.astype(np.int32)),
                    pa.array(distances[np.arange(len(rows)), nearest]),
                    pa.array(np.arange(len(rows), dtype=np.int32)),
                    b.column(0).take(pa.array(rows)),
                    pa.array([r.tobytes() for r in values], pa.binary()),
                    pa.array([r.tobytes() for r in distances], pa.binary()),
                ],
                names=["pivot", "distance", "row", "vec_id", "vector", "distances"],
            )

    def cut(rows: DataFrame, asked: bool) -> DataFrame:
        keys = ["pivot", "distance", "vec_id", "row"]
        found = rows.mapInArrow(lambda batches: keyed(batches, asked), KEYED)
        return found.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_chunks, CHUNK)

    index = written(cut(vectors, False), "pivot-index")
    blocks = cut(queries.groupBy("vec_id").agg(F.min("e").alias("e")), True)
    blocks = blocks.select(F.col("chunk").alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    blocks = written(blocks, "query-blocks")
    annuli = index.select("region", "chunk", "pivot", "near", "far")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and pivot: the range of its queries' distances, of those nearest to it, and its least bound."""
        for b in batches:
            for name, _, raw, least in zip(*[c.to_pylist() for c in b.columns], strict=True):
                q = np.frombuffer(raw, "<f8").reshape(-1, size)
                d = pivots.of_queries(q)
                worst = float(np.frombuffer(least, "<i8").min()) if least else -np.inf
                room = (q**2).sum(1).max() + norm2
                slack = 1e-6 * (1 + float(np.sqrt(room)) + float(d.max()))
                reach = float(np.sqrt(max(room * (1 + 4e-9) - 2 * (worst - 2), 0.0))) + slack
                own = d.argmin(1)
                rows = []
                for p in range(d.shape[1]):
                    home = d[own == p, p]
                    ends = (home.min(), home.max()) if len(home) else (None, None)
                    rows.append((name, p, d[:, p].min(), d[:, p].max(), *ends, reach))
                kinds = (pa.string(), pa.int32(), *[pa.float64()] * 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["block", "pivot", "least", "most", "home_least", "home_most", "reach"],
                )

    interval = "block string, pivot int, least double, most double, home_least double, home_most double, reach double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of regions, each region's annuli ahead of the blocks that ask for it."""
        region, held = None, {}
        for b in batches:
            for name, _, chunk, lows, highs, ids, raw, asked, least in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if name != region:
                    region, held = name, {}
                x_id, x = np.frombuffer(ids, "<i8"), np.frombuffer(raw, "<f8").reshape(-1, size)
                if asked is None:
                    held[chunk] = x_id, x, np.frombuffer(lows, "<f8"), np.frombuffer(highs, "<f8")
                else:
                    bound = np.frombuffer(least, "<i8") if least else np.full(len(x), np.iinfo(np.int64).min)
                    yield found_in([held[c] for c in asked], x_id, x, bound)

    def found_in(chunks: list, q_id: np.ndarray, q: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        distances = pivots.of_queries(q)
        found = [[], [], []]
        for x_id, x, lows, highs in chunks:
            admitted = np.flatnonzero(pivots.best_score(q, distances, lows, highs) >= bound)
            scores = products(q[admitted], x)
            for row, i in zip(scores, admitted.tolist(), strict=True):
                usable = np.flatnonzero((x_id != q_id[i]) & (row >= bound[i]))
                # ~s falls as s grows, and unlike -s never leaves the range of a long.
                best = usable[np.lexsort((x_id[usable], ~row[usable]))[:k]]
                found[0].append(np.full(len(best), q_id[i]))
                found[1].append(x_id[best])
                found[2].append(row[best])
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(none + f), pa.int64()) for f in found], names=["query_id", "vec_id", "score"]
        )

    def scored(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        asked = pairs.groupBy("region", "block").agg(F.collect_set("chunk").alias("asked"))
        asked = asked.join(queries, "block").select(
            "region", F.lit(1).alias("role"), F.col("block").alias("chunk"), F.lit(None).cast("binary").alias("lows"),
            F.lit(None).cast("binary").alias("highs"), F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), "asked", "least",
        )
        held = index.join(pairs.select("chunk").distinct(), "chunk").select(
            "region", F.lit(0).alias("role"), "chunk", "lows", "highs", "ids", "vectors",
            F.lit(None).cast("array<string>").alias("asked"), F.lit(None).cast("binary").alias("least"),
        )
        dealt = held.unionByName(asked).repartition("region").sortWithinPartitions("region", "role")
        hits = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    unbounded = blocks.withColumn("least", F.lit(None).cast("binary"))
    home = unbounded.select("block", "q_ids", "q_vectors", "least").mapInArrow(intervals, interval)
    first = home.where("home_least is not null").join(annuli, "pivot").where("far >= home_least and near <= home_most")
    bounds = scored(first.select("block", "region", "chunk"), unbounded)
    bounds = written(bounds.where(F.col("rank") == k).select("query_id", "score"), "bounds")

    # A block's bounds go beside its queries, in their order; without k results so far there is none.
    numbered = blocks.select("block", "q_ids").mapInArrow(_unpacked, "block string, place int, query_id long")
    least = (
        numbered.join(bounds, "query_id", "left")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("score", F.lit(-(1 << 63))).alias("score")))).alias("x"))
        .select("block", F.col("x.score").alias("scores"))
        .mapInArrow(_packed, "block string, least binary")
    )
    bounded = written(blocks.join(least, "block"), "bounded-queries")
    reach = bounded.select("block", "q_ids", "q_vectors", "least").mapInArrow(intervals, interval)
    second = reach.join(annuli, "pivot").where("greatest(near - most, least - far, 0) <= reach")
    return scored(second.select("block", "region", "chunk"), bounded).select("query_id", "rank", "vec_id", "score")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each query of a block: its place in the block and its id."""
    for b in batches:
        for name, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
            ids = np.frombuffer(raw, "<i8")
            places = np.arange(len(ids), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids)), pa.array(places), pa.array(ids)], names=["block", "place", "query_id"]
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [np.array(s, "<i8").tobytes() for s in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["block", "least"])


def nearest(embeddings: DataFrame) -> DataFrame:
    """The 5 best rows for each whose id is divisible by QUERY_EVERY."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))
