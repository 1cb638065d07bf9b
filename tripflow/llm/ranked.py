"""Ranked lexical search: an inverted index in blocks of documents, searched term- and document-at-a-time by turns.

The index holds, for each block of at most BLOCK_DOCS documents and each of its terms, the documents with that term and
its occurrences there, beside the greatest number of occurrences and the least document length: these bound what the
term can add to any score of the block. Postings of all terms are written once; a pack of items then reads those of its
own terms.

In a block, the short lists of an item (at most SHORT_PART of the block's documents) are read term-at-a-time into summed
accumulators. These become one more iterator, bounded by their greatest sum, beside the long lists. The search then
proceeds document-at-a-time in windows: iterators in ascending order of their bounds are left out of the choice of
candidates as long as their bounds together stay below the item's k-th best score so far, and are only probed for the
candidates which could still reach it. That score is kept from block to block. A tie with it is never skipped, since the
smaller id goes first; no document that belongs to the result is passed over.

Null texts and texts without terms take no part. A document without an id counts in all statistics but cannot be named,
so it is not ranked. Repeated rows are documents of their own. Equal item rows count once, different texts of one item id
are searched as one item, items without an id are left out. Texts are read in pieces, whole. Empty tables give an empty
result; other columns are not looked at.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import id_texts, texts, written

# In UTF-8 all bytes of other than ASCII characters are above 0x7F.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PIECE = 1 << 20
BLOCK_DOCS = 1 << 13
BLOCK_POSTINGS = 1 << 21
SHORT_PART = 1 / 32
WINDOW_DOCS = 1 << 10
# Items are searched for together as long as they have no more terms than this.
PACK_TERMS = 200_000
K = 10
INDEX = (
    "block long, term string, df long, most long, least long, places binary, times binary,"
    " ids array<long>, lengths array<long>"
)


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term, lower-cased where ASCII."""
    counts = Counter()
    start = 0
    while start < len(text):
        end = OTHER.search(text, start + PIECE)
        end = end.start() if end else len(text)
        counts.update(TERM.findall(text[start:end].lower()))
        start = end
    return counts


def _block(name: int, ids: list, lengths: list, terms: dict, found: list, times: list, sizes: list) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents, then a row for each term."""
    ints = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 3, pa.binary(), pa.binary(), ints, ints)
    names = [n.split()[0] for n in INDEX.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip((name, *[None] * 6, ids, lengths), kinds, strict=True)], names=names
    )
    terms_of, n = np.array(found, np.int64), len(terms)
    place = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(terms_of, kind="stable")
    tf = np.array(times, np.uint32)[order]
    place = place[order].astype("<u2")
    df = np.bincount(terms_of, minlength=n)
    starts = np.concatenate([[0], np.cumsum(df)])
    most = np.maximum.reduceat(tf, starts[:-1])
    least = np.minimum.reduceat(np.array(lengths, np.int64)[place], starts[:-1])

    def blobs(values):
        offsets = pa.py_buffer((starts * values.itemsize).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])

    nothing = pa.nulls(n, ints)
    columns = [np.full(n, name), [t.decode() for t in terms], df, most.astype(np.int64), least]
    columns = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)] + [blobs(place), blobs(tf), nothing, nothing]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for i in range(0, n, 10_000):
        yield whole.slice(i, 10_000)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids, lengths, terms, found, times, sizes = [], [], {}, [], [], []
        for b in batches:
            for doc_id, text in id_texts(b):
                counts = term_counts(text)
                if not counts:
                    continue
                if ids and (len(ids) == BLOCK_DOCS or len(found) + len(counts) > BLOCK_POSTINGS):
                    yield from _block(name, ids, lengths, terms, found, times, sizes)
                    name += 1
                    ids, lengths, terms, found, times, sizes = [], [], {}, [], [], []
                ids.append(doc_id)
                lengths.append(counts.total())
                sizes.append(len(counts))
                times.extend(counts.values())
                for t in counts:
                    found.append(terms.setdefault(t, len(terms)))
        if ids:
            yield from _block(name, ids, lengths, terms, found, times, sizes)

    return written(texts(docs, id_col, text_col).mapInArrow(run, INDEX), "inverted-index")


class _List:
    """A term's postings in a block, and what it adds at most for each unit of weight."""

    def __init__(self, m: np.ndarray, most: int, least_m: int, places: bytes, times: bytes):
        self.bound = (1_000_000_000 * most) // (1000 * most + 8 * least_m)
        self.places = np.frombuffer(places, "<u2").astype(np.int64)
        self._times, self._m, self._parts = times, m, None

    @property
    def parts(self) -> np.ndarray:
        """What each posting adds for a unit of weight; worked out when the list is first read."""
        if self._parts is None:
            tf = np.frombuffer(self._times, "<u4").astype(np.int64)
            self._parts = (1_000_000_000 * tf) // (1000 * tf + 8 * self._m[self.places])
        return self._parts


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_block(lists: list[tuple[int, _List]], ids: np.ndarray, named: np.ndarray, best: Best) -> None:
    """Enters the block's documents into `best`; `lists` are weights with postings, `named` tells which may be ranked."""
    size = len(ids)
    short = [(w, x) for w, x in lists if len(x.places) <= size * SHORT_PART]
    iterators = [(w * x.bound, w, x.places, x) for w, x in lists if len(x.places) > size * SHORT_PART]
    if short:
        places, where = np.unique(np.concatenate([x.places for _, x in short]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, where, np.concatenate([w * x.parts for w, x in short]))
        iterators.append((int(sums.max()), 1, places, sums))
    iterators.sort(key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in iterators])

    def added(weight, parts, rows):
        return weight * (parts.parts if isinstance(parts, _List) else parts)[rows]

    start = 0
    while start < size:
        # Documents in these lists only can't reach the least score; the others name the candidates.
        passive = int(np.searchsorted(reach, best.least))
        active = iterators[passive:]
        ahead = [places[i] for _, _, places, _ in active for i in [np.searchsorted(places, start)] if i < len(places)]
        if not ahead:
            return
        start = int(min(ahead))
        end = min(start + WINDOW_DOCS, size)
        scores = np.zeros(end - start, np.int64)
        for _, weight, places, parts in active:
            rows = slice(*np.searchsorted(places, (start, end)))
            scores[places[rows] - start] += added(weight, parts, rows)
        hits = np.flatnonzero(scores)
        for i in range(passive - 1, -1, -1):
            hits = hits[scores[hits] + reach[i] >= best.least]
            if not len(hits):
                break
            _, weight, places, parts = iterators[i]
            rows = np.minimum(np.searchsorted(places, hits + start), len(places) - 1)
            there = places[rows] == hits + start
            scores[hits[there]] += added(weight, parts, rows[there])
        hits = hits[(scores[hits] >= best.least) & named[hits + start]]
        if len(hits):
            best.add(scores[hits], ids[hits + start])
        start = end


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """`item_id`, `rank` from 1, `doc_id`, `score`: the k best documents of each item with a score above zero.

    `items` has `item_id` and `text`.
    """
    spark = index.sparkSession
    blocks = index.where("term is null").select("block", "ids", "lengths")
    total = blocks.select(F.size("lengths").alias("n"), F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("l"))
    n_docs, n_terms = total.agg(F.sum("n"), F.sum("l")).first()
    result = "item_id long, rank int, doc_id long, score long"
    if not n_docs:
        return spark.createDataFrame([], result)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in id_texts(b):
                counts = term_counts(text)
                terms = pa.array([t.decode() for t in counts], pa.string())
                columns = [pa.array([item] * len(counts), pa.int64()), terms, pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "term", "times"])

    rows = texts(items, "item_id").where("doc_id is not null").distinct().mapInArrow(split, "item_id long, term string, times long")
    asked = written(rows.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item-terms")
    df = index.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("weight")), "weights")
    packs = -(-weighted.count() // PACK_TERMS)
    found = None
    for p in range(packs):
        pack = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(packs)) == p)
        wanted: dict[int, list[tuple[str, int]]] = {}
        for r in pack.collect():
            wanted.setdefault(r.item_id, []).append((r.term, r.weight))

        def run(batches, wanted=wanted):
            return _searched(batches, wanted, n_docs, n_terms, k)

        # A pack's terms are at most about PACK_TERMS.
        postings = index.where("term is not null").join(F.broadcast(pack.select("term").distinct()), "term")
        columns = ["block", "term", "most", "least", "places", "times", "ids", "lengths"]
        whole = postings.select(*columns).unionByName(blocks, allowMissingColumns=True).select(*columns)
        dealt = whole.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
        hits = dealt.mapInArrow(run, "item_id long, doc_id long, score long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], result)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _searched(
    batches: Iterator[pa.RecordBatch], wanted: dict[int, list[tuple[str, int]]], n_docs: int, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each block's documents ahead of its postings, to the best documents of this task by item."""
    best = {item: Best(k) for item in wanted}
    ids = named = m = None
    lists: dict[str, _List] = {}

    def length_part(n):
        return 25 + (75 * n * n_docs) // n_terms

    def finish():
        for item, terms in wanted.items():
            held = [(weight, lists[t]) for t, weight in terms if t in lists and weight > 0]
            if held:
                search_block(held, ids, named, best[item])

    for b in batches:
        columns = [c.to_pylist() for c in b.columns[:6]]
        for i, (_, term, most, least, places, times) in enumerate(zip(*columns, strict=True)):
            if term is not None:
                lists[term] = _List(m, most, length_part(least), places, times)
                continue
            if lists:
                finish()
            lists = {}
            rows = b.column(6)[i].values
            named = np.asarray(rows.is_valid())
            ids = np.asarray(rows.fill_null(0))
            m = length_part(np.asarray(b.column(7)[i].values))
    if lists:
        finish()
    rows = [(item, int(d), int(s)) for item, x in best.items() for s, d in zip(x.scores, x.ids, strict=True)]
    for i in range(0, len(rows), 10_000):
        columns = zip(*rows[i : i + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])


def ranked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(build_index(docs), benchmark)
