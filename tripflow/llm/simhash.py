"""Near-duplicates by SimHash, found through an inverted index over the bytes of the fingerprints.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 byte positions: that is the
minimum a pair's tally of shared positional bytes must reach. A list for each single positional byte would be as
long as the corpus over 256, so the index keeps a list for each four positional bytes; a pair whose tally reaches
the minimum shares at least one. Each pair that meets in a list is tallied, reported only by the list of its first
four shared bytes, and verified by its differing bits. No list or pair is left out.

Dense groups would make nearly all pairs of their members. Fingerprints that agree in 15 of 16 half bytes lie
within 4 bits, so they are linked as a star first, and the index then compares only fingerprints that are not yet
connected. Only distinct fingerprints are indexed, so exact copies cost one row.

Null and empty texts have fingerprint zero and link like any other. A null id is never the smallest id; a component
without any id has a null component_id. Repeated rows come back repeated; an empty table gives an empty result; of
the table's columns only id and text are looked at. Texts are read whole, in pieces of bounded memory.
"""

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import checkpointed, id_texts, texts
from tripflow.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
# Of 8 bytes, at most MAX_BITS can differ.
MIN_SHARED = BYTES - MAX_BITS
# Shingles hashed at a time.
PIECE = 1 << 15


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles of `size` words, lower-cased where ASCII, in pieces; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        pairs = zip(starts[i : i + PIECE], ends[i : i + PIECE], strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype="<u8")


def _majority(hashes: Iterable[np.ndarray]) -> bytes:
    """The fingerprint's bytes: each bit is set if it is in over half of the hashes."""
    votes, n = np.zeros(64, np.int64), 0
    for piece in hashes:
        n += len(piece)
        votes += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > n, bitorder="little").tobytes()


def fingerprint(text: bytes) -> int:
    """SimHash over the 4-word shingles of the text; zero without words."""
    return int.from_bytes(_majority(shingle_hashes(text, SHINGLE_WORDS)), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `fp`, the fingerprint's 64 bits as a signed long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(t) for _, t in id_texts(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _stars(fps: DataFrame) -> DataFrame:
    """Edges between fingerprints that agree in all but one of 16 half bytes, each to the least of its group."""
    masks = F.array(*[F.lit(_signed(~(0xF << 4 * i))) for i in range(16)])
    rows = fps.select("fp", F.posexplode(masks).alias("place", "mask"))
    rows = rows.select("fp", "place", F.expr("fp & mask").alias("kept"))
    least = rows.groupBy("place", "kept").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, ["place", "kept"]).where("fp <> b").select(F.col("fp").alias("a"), "b")


def _signed(bits: int) -> int:
    bits &= (1 << 64) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _shared(differing: Column) -> Column:
    """A bit for each byte position in which two fingerprints agree, given the xor of the two."""
    bits = [
        F.when(differing.bitwiseAND(F.lit(_signed(0xFF << 8 * i))) == 0, F.lit(1 << i)).otherwise(F.lit(0))
        for i in range(BYTES)
    ]
    return sum(bits[1:], bits[0])


def _first_shared(shared: Column) -> Column:
    """The lowest MIN_SHARED of the set bits."""
    rest = shared
    for _ in range(MIN_SHARED):
        rest = rest.bitwiseAND(rest - 1)
    return shared.bitwiseXOR(rest)


def links(fps: DataFrame) -> DataFrame:
    """Pairs `a` < `b` of fingerprints within MAX_BITS whose `part` differs; `fps` has distinct `fp` with its `part`."""
    places = [sum(1 << i for i in kept) for kept in combinations(range(BYTES), MIN_SHARED)]
    lists = F.array(
        *[
            F.struct(
                F.lit(p).alias("places"),
                F.lit(_signed(sum(0xFF << 8 * i for i in range(BYTES) if p >> i & 1))).alias("mask"),
            )
            for p in places
        ]
    )
    index = fps.select("fp", "part", F.explode(lists).alias("list")).select(
        "fp", "part", "list.places", F.expr("fp & list.mask").alias("bytes")
    )
    left, right = index.alias("l"), index.alias("r")
    differing = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    shared = _shared(differing)
    return left.join(
        right,
        (F.col("l.places") == F.col("r.places"))
        & (F.col("l.bytes") == F.col("r.bytes"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.col("l.part") != F.col("r.part"))
        & (F.bit_count(differing) <= MAX_BITS)
        & (F.bit_count(shared) >= MIN_SHARED)
        & (_first_shared(shared) == F.col("l.places")),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"), F.col("l.part").alias("c"), F.col("r.part").alias("d"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp` and `component_id`, the smallest id among the documents reachable over links, for each row."""
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    near = connected_components(_stars(fps.select("fp")))
    parts = checkpointed(
        fps.join(near.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least_id", F.coalesce("root", "fp").alias("part")
        )
    )
    joined = connected_components(links(parts).select(F.col("c").alias("a"), F.col("d").alias("b")))
    whole = parts.join(joined.withColumnRenamed("node", "part"), "part", "left").select(
        "fp", "least_id", F.coalesce("root", "part").alias("component")
    )
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = whole.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash(docs: DataFrame) -> DataFrame:
    """`doc_id`, `fingerprint` as 16 lower-case hex digits, `component_id`: a row for each row."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs`, all columns as they are, with one row of each component of near-duplicates: that with its smallest id.

    Rows without an id can't be named, so they all stay. Of rows that share the smallest id, one stays.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    numbered = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return numbered.unionByName(docs.where("doc_id is null"))
