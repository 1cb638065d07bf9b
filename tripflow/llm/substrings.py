"""Substring removal by relative Lempel-Ziv parsing: words of passages that also occur elsewhere.

Every document is reference text, cut into blocks of BLOCK_WORDS words and indexed by seeds: runs of SEED_WORDS words,
chosen by winnowing so that each window of WINDOW_WORDS words holds at least one and equal windows choose alike. The
index keeps the first and the last place of each seed that it has twice. A document is factored against the blocks of all
its seeds: at each seed the match with its first place (the first place itself: with the last one) is extended in both
directions, word by word, and the parse greedily takes what reaches furthest. A factor has a source, a start there and
a length; what no factor covers are literal words.

A match of a window or more is a duplicate span, here and at its source. Windows across the boundaries of factors, those
whose least seed is repeated but whose match does not hold them whole, may occur a second time at a place that is neither
first nor last; they are checked by 96-bit fingerprints against each other. None is missed: of two equal windows, whose least
seeds are equal, one holds that seed's first place, and the other's match with it covers both; or both are compared with that
place, and either both are within the match or both are checked.

Words are what stands between ASCII white space, unchanged; they are compared by 64-bit hashes. A null or empty text has
no words, nothing removed and the digest of the empty string. A repeated row is another place where its windows start,
so both copies go. Rows with a null id are documents like any other. An empty table gives an empty result; only id and
text are looked at. A copy of a whole text is one factor, found by its digest, and only the first of the copies is parsed
and indexed. Frequent passages cost one row for each place they stand at: what they refer to is aggregated before it is
shuffled, and the places join what is unique, one row each, so that a very frequent one can be split over tasks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import checkpointed, id_texts, texts, written

WINDOW_WORDS = 35
SEED_WORDS = 12
# Words of a reference block; it also holds as many of its neighbours' as make it hold each window around its seeds.
BLOCK_WORDS = 256
# Hashes of so many words are remembered by a task.
CACHE_WORDS = 200_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes:
    """64-bit hashes of words, remembered in bounded memory."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(hashes: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of each run of `size` words, by doubling: h(2k) = mix(h(k) * odd + h(k) shifted by k)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, k, done, total = hashes, 1, 0, None
    while True:
        if size & k:
            part = level[done : done + n]
            total = part if total is None else _mix(total * odd + part)
            done += k
        k *= 2
        if k > size:
            return _mix(total + odd)
        level = _mix(level[: len(level) - k // 2] * odd + level[k // 2 :])


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """The least or greatest of each `size` neighbours, by doubling."""
    level, k = values, 1
    while 2 * k <= size:
        level = pick(level[: len(level) - k], level[k:])
        k *= 2
    n = len(values) - size + 1
    return pick(level[:n], level[size - k : size - k + n])


def seeds(hashes: np.ndarray, window: int = WINDOW_WORDS, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen seeds: the least of every window's seeds, with all its ties."""
    values = runs(hashes, seed, _ODD[0])
    span = window - seed + 1
    if len(values) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(values, span, np.minimum)
    # Position i is in the windows i-span+1 .. i; it is chosen if it is the least of one of them.
    edge = np.zeros(span - 1, np.uint64)
    greatest = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    at = np.flatnonzero(values == greatest)
    return at, values[at]


@dataclass(frozen=True)
class Match:
    """Words `start` to `end` of a document are those of `source` from `source_start` on; all of the greatest extent."""

    start: int
    end: int
    source: bytes
    source_start: int


def matches(words: np.ndarray, at: np.ndarray, sources: list[bytes], source_at: np.ndarray, blocks: dict) -> list[Match]:
    """The match around each seed.

    The seed at `at[i]` also stands at `source_at[i]` of `sources[i]`; `blocks` has the first word and the word hashes of
    each block (source, number).
    """
    groups: dict[tuple, list[int]] = {}
    for i, (a, source, b) in enumerate(zip(at.tolist(), sources, source_at.tolist(), strict=True)):
        groups.setdefault((source, b // BLOCK_WORDS, a - b), []).append(i)
    found: list[Match | None] = [None] * len(at)
    for (source, number, shift), members in groups.items():
        first, block = blocks[source, number]
        low, high = max(0, first + shift), min(len(words), first + len(block) + shift)
        differ = low + np.flatnonzero(words[low:high] != block[low - shift - first : high - shift - first])
        ends = np.concatenate([[low - 1], differ, [high]])
        for i, k in zip(members, np.searchsorted(ends, at[members], side="right").tolist(), strict=True):
            start = int(ends[k - 1]) + 1
            found[i] = Match(start, int(ends[k]), source, start - shift)
    return found


def outermost(found: list[Match]) -> list[Match]:
    """Those that lie in no other one, by ascending start, and so end."""
    kept: list[Match] = []
    for m in sorted(set(found), key=lambda m: (m.start, -m.end, m.source, m.source_start)):
        if not kept or m.end > kept[-1].end:
            kept.append(m)
    return kept


def parse(n_words: int, found: list[Match], least: int = SEED_WORDS) -> list[Match]:
    """The greedy parse by outermost matches: at each word what reaches furthest, of at least `least` words, or a literal."""
    factors, i, k = [], 0, 0
    while i < n_words and k < len(found):
        while k + 1 < len(found) and found[k + 1].start <= i:
            k += 1
        m = found[k]
        if m.start <= i and m.end - i >= least:
            factors.append(Match(i, m.end, m.source, m.source_start + i - m.start))
            i = m.end
        elif m.start > i:
            i = m.start
        else:
            k += 1
    return factors


def chosen(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window the place of its least seed, the first of equal ones: it depends on the window's words alone."""
    values, span = runs(hashes, seed, _ODD[0]), window - seed + 1
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def less(a, b):
        return np.where(values[b] < values[a], b, a)

    return _sliding(np.arange(len(values)), span, less)


def unresolved(words: np.ndarray, at: np.ndarray, found: list[Match], window: int, seed: int) -> np.ndarray:
    """Starts of the windows whose chosen seed is one of `at`, but whose words are not all in its match.

    The match of another seed may hold them all; an equal window need not have that seed, so it does not count here.
    """
    first = chosen(words, window, seed)
    place = np.full(len(words), -1)
    place[at] = np.arange(len(at))
    starts = np.flatnonzero(place[first] >= 0)
    own = place[first[starts]]
    low, high = np.array([m.start for m in found]), np.array([m.end for m in found])
    return starts[(low[own] > starts) | (high[own] < starts + window)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, the key that names a row, and the compressed text."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        raw = [t for _, t in id_texts(b)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), _keys(b.column(0), raw), pa.array([pack(t) for t in raw], pa.binary())],
            names=["doc_id", "doc", "packed"],
        )


def _keys(ids: pa.Array, raw: list[bytes]) -> pa.Array:
    """Rows alike in id and text are interchangeable, so a hash of both names a row."""
    digest = xxhash.xxh3_128_digest
    return pa.array([digest(f"{i} ".encode() + t) for i, t in zip(ids.to_pylist(), raw, strict=True)], pa.binary())


def _unpacked(column: pa.Array) -> Iterator[list[bytes]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for packed in column:
        yield unpack(packed.as_py()).split()


def _find_seeds(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        raw = [t for _, t in id_texts(b)]
        found = [seeds(hashes(t.split()), window, seed) for t in raw]
        offsets = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]), pa.int32())
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *(at for at, _ in found)]).astype(np.int32))
        value = _signed(np.concatenate([np.zeros(0, np.uint64), *(v for _, v in found)]))
        yield pa.RecordBatch.from_arrays(
            [
                _keys(b.column(0), raw),
                pa.array([xxhash.xxh3_128_digest(t) for t in raw], pa.binary()),
                pa.ListArray.from_arrays(offsets, at),
                pa.ListArray.from_arrays(offsets, value),
            ],
            names=["doc", "copy_of", "at", "seed"],
        )


def _cut_blocks(batches: Iterator[pa.RecordBatch], margin: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The blocks that are referred to, with their margins, as word hashes."""
    hashes = WordHashes()
    for b in batches:
        for doc, tokens, numbers in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = hashes(tokens)
            firsts = [max(0, k * BLOCK_WORDS - margin) for k in numbers]
            cut = [words[f : (k + 1) * BLOCK_WORDS + seed + margin].tobytes() for k, f in zip(numbers, firsts, strict=True)]
            columns = ([doc] * len(numbers), numbers, firsts, cut)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["source", "number", "first", "words"]
            )


FACTORS = "doc binary, start int, n int, source binary, source_start int, factor boolean, p long, q int"


def _factor(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Documents to their factors, their matches of a window or more, and the windows left to be checked."""
    hashes = WordHashes()
    for b in batches:
        for doc, tokens, marks, held in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2), b.column(3), strict=True):
            words = hashes(tokens)
            marks, held = marks.values, held.values
            at, source_at = (np.asarray(marks.field(k), np.int64) for k in (0, 2))
            blocks = {
                (source, number): (first, np.frombuffer(raw, np.uint64))
                for source, number, first, raw in zip(*[held.field(k).to_pylist() for k in range(4)], strict=True)
            }
            found = matches(words, at, marks.field(1).to_pylist(), source_at, blocks)
            # A match within another one still tells of its own source.
            both = [(m, True) for m in parse(len(words), outermost(found), seed)]
            both += [(m, False) for m in set(found) if m.end - m.start >= window]
            rows = [(doc, m.start, m.end - m.start, m.source, m.source_start, factor) for m, factor in both]
            starts = unresolved(words, at, found, window, seed)
            p, q = (runs(words, window, odd)[starts] if len(starts) else np.zeros(0, np.uint64) for odd in _ODD)
            kinds = [f.type for f in _ARROW_FACTORS]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*columns[0], *[doc] * len(starts)], kinds[0]),
                    pa.array(np.concatenate([np.array(columns[1], np.int32), starts.astype(np.int32)])),
                    *[pa.array([*columns[k], *[None] * len(starts)], kinds[k]) for k in (2, 3, 4, 5)],
                    pa.array([None] * len(rows) + p.view(np.int64).tolist(), kinds[6]),
                    pa.array([None] * len(rows) + (q >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist(), kinds[7]),
                ],
                schema=_ARROW_FACTORS,
            )


_ARROW_FACTORS = pa.schema(
    [
        ("doc", pa.binary()), ("start", pa.int32()), ("n", pa.int32()), ("source", pa.binary()), ("source_start", pa.int32()),
        ("factor", pa.bool_()), ("p", pa.int64()), ("q", pa.int32()),
    ]
)


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept_texts = [], [], []
        marks = zip(_unpacked(b.column(1)), b.column(2), b.column(3).to_pylist(), strict=True)
        for words, spans, copied in marks:
            gone = np.zeros(len(words) + 1, np.int64)
            if copied and len(words) >= window:
                gone[0] = 1
            elif spans.is_valid:
                at, n = (np.asarray(spans.values.field(k), np.int64) for k in (0, 1))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept_texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept_texts, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )


def _factored(rows: DataFrame, window: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed documents, copies of whole texts (`doc`, `first`), and what the parse found (FACTORS)."""
    found = written(
        rows.mapInArrow(
            lambda b: _find_seeds(b, window, seed), "doc binary, copy_of binary, at array<int>, seed array<long>"
        ),
        "seeds",
    )
    copies = found.groupBy("copy_of").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1")
    copied = found.select("doc", "copy_of").distinct().join(copies, "copy_of")
    copied = checkpointed(copied.select("doc", "first", (F.col("doc") == F.col("first")).alias("is_first")))
    once = found.join(copied.where("not is_first"), "doc", "left_anti").dropDuplicates(["doc"])
    places = once.select("doc", F.explode(F.arrays_zip("at", "seed")).alias("x")).select("doc", "x.at", "x.seed")
    place = F.struct("doc", "at")
    ends = places.groupBy("seed").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written down, so that the join below has plain shuffles on both sides, of which Spark splits large partitions.
    index = written(ends.where("first <> last"), "repeated-seeds")
    source = F.when(place == F.col("first"), F.col("last")).otherwise(F.col("first"))
    used = places.join(index, "seed").select("doc", "at", source.alias("source"))
    used = written(used.select("doc", "at", F.col("source.doc").alias("source"), F.col("source.at").alias("source_at")), "matched-seeds")
    packed = rows.mapInArrow(_packed, "doc_id long, doc binary, packed binary")
    once_packed = packed.select("doc", "packed").dropDuplicates(["doc"])
    number = F.floor(F.col("source_at") / BLOCK_WORDS).cast("int").alias("number")
    wanted = used.select("source", number).distinct().groupBy("source").agg(F.collect_list("number").alias("numbers"))
    blocks = written(
        once_packed.withColumnRenamed("doc", "source").join(wanted, "source").select("source", "packed", "numbers")
        .mapInArrow(lambda b: _cut_blocks(b, window - seed, seed), "source binary, number int, first int, words binary"),
        "reference-blocks",
    )
    marks = used.groupBy("doc").agg(F.collect_list(F.struct("at", "source", "source_at")).alias("marks"))
    held = used.select("doc", "source", number).distinct().join(blocks, ["source", "number"])
    held = held.groupBy("doc").agg(F.collect_list(F.struct("source", "number", "first", "words")).alias("held"))
    parsed = once_packed.join(marks, "doc").join(held, "doc").select("doc", "packed", "marks", "held")
    return packed, copied, written(parsed.mapInArrow(lambda b: _factor(b, window, seed), FACTORS), "factors")


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, seed: int = SEED_WORDS
) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed` and `kept_text`, the words left joined by one space, for each row."""
    packed, copied, found = _factored(texts(docs, id_col, text_col), window, seed)
    matched = found.where("not factor")
    own = matched.select("doc", "start", "n")
    theirs = matched.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "n").distinct()
    windows = found.where("p is not null").select("doc", "start", "p", "q")
    twice = written(windows.groupBy("p", "q").agg(F.count("*").alias("times")).where("times > 1").select("p", "q"), "repeated-windows")
    checked = windows.join(twice, ["p", "q"]).select("doc", "start", F.lit(window).alias("n"))
    spans = own.unionByName(theirs).unionByName(checked).groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return (
        packed.join(spans, "doc", "left")
        .join(copied.select("doc", F.lit(True).alias("copied")), "doc", "left")
        .select("doc_id", "packed", "spans", "copied")
        .mapInArrow(lambda b: _remove(b, window), "doc_id long, n_words long, n_removed long, kept_text string")
    )


def factors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, seed: int = SEED_WORDS
) -> DataFrame:
    """The parse: `doc_id`, `start`, `n` words, `source_id`, `source_start`, a row for each factor; words count from 0.

    A copy of a whole text has one factor. Words between factors are literals.
    """
    packed, copied, found = _factored(texts(docs, id_col, text_col), window, seed)
    ids = packed.select("doc", "doc_id").distinct()
    sources = ids.select(F.col("doc").alias("source"), F.col("doc_id").alias("source_id"))
    parsed = found.where("factor").join(ids, "doc").join(sources, "source").select("doc_id", "start", "n", "source_id", "source_start")

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t) for t in _unpacked(b.column(1))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n, b.column(2)], names=["doc_id", "n", "source"])

    whole = packed.join(copied.where("not is_first"), "doc").select("doc_id", "packed", F.col("first").alias("source")).distinct()
    whole = whole.mapInArrow(length, "doc_id long, n int, source binary").where("n > 0").join(sources, "source")
    return parsed.unionByName(whole.select("doc_id", F.lit(0).alias("start"), "n", "source_id", F.lit(0).alias("source_start")))


def substrings(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `kept_sha256`: a row for each row."""
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
