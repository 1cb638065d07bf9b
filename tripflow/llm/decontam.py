"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit distances.

Texts and items are words: lower-cased where ASCII, ASCII punctuation taken off. A window is as many consecutive
words of a document as an item has; it is a hit when at most EDIT_SHARE of the item's words must be edited (insert,
delete, replace a word) to make it the item.

The CGK walk embeds a sequence for Hamming distance: at each step it writes the word it stands on, and a random bit,
drawn from step and word, tells whether it moves on. Two sequences walk by the same bits, so they fall into step
again after an edit. Each of WALKS walks is sampled SAMPLES times at PLACES steps; the sampled words are a key, and a
window is a candidate for each item of its size with which it shares a key. With half of the steps disagreeing a hit
is missed with probability (1 - 2^-PLACES)^(WALKS*SAMPLES), which is below 0.001. Candidates are verified by their
edit distance, so no false hit remains. Beside a long hit each shifted window is a candidate too; as one edit takes at
most one word out of the words that two windows share, a candidate that shares too few to do better than the best
window so far of its document and item needs no distance. What is left is compared along a band of the diagonal as
wide as the edits allowed.

Ahead of it stands a filter that loses nothing: k word edits destroy at most 3k of the n-2 word triples of an item,
so a window with fewer than n-2-3k triples that any item has cannot be a hit.

Items are read in blocks of at most BLOCK_ITEMS, each carried to the tasks; documents are never shuffled. Null or
empty texts hold nothing. Items of fewer than MIN_ITEM_WORDS words are left out, as they'd match common phrases.
Repeated rows come back repeated; empty tables give an empty result; of ties for the best window the earliest is
reported; other columns are not looked at. Texts are read whole, PIECE_WORDS words at a time.
"""

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import id_texts, texts

EDIT_SHARE = 0.2
MIN_ITEM_WORDS = 8
WALKS, SAMPLES, PLACES = 8, 8, 3
BLOCK_ITEMS = 20_000
# Words of documents looked at together; a longer document is looked at by itself.
PIECE_WORDS = 1 << 19
SEED = 20_240_607
OUTPUT = "doc_id long, item_id long, start_word long, n_words int, edits int"

_PUNCTUATION = string.punctuation.encode()


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split()


def allowed_edits(n_words: int) -> int:
    return int(EDIT_SHARE * n_words)


class ItemIndex:
    """Keys of a block of items, for windows of documents to meet."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, w) for i, t in items if len(w := words_of(t or b"")) >= MIN_ITEM_WORDS]
        # Word 0 is any word that no item has.
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.base = len(self.vocabulary) + 1
        none = [np.zeros(0, np.int64)]
        self.pairs = np.unique(np.concatenate([c[:-1] * self.base + c[1:] for c in self.codes] + none))
        self.triples = np.unique(np.concatenate([self._triples(c) for c in self.codes] + none))
        self.by_size: dict[int, list[int]] = {}
        for k, c in enumerate(self.codes):
            self.by_size.setdefault(len(c), []).append(k)
        # Which triples the items of each size have.
        self.has = {n: np.zeros(len(self.triples), bool) for n in self.by_size}
        for c in self.codes:
            self.has[len(c)][np.searchsorted(self.triples, self._triples(c))] = True
        self.keys = {}
        for n, members in self.by_size.items():
            rows = self.embed(np.stack([self.codes[k] for k in members]), np.full(len(members), n))[n][1]
            order = [np.argsort(rows[:, j], kind="stable") for j in range(rows.shape[1])]
            self.keys[n] = [(rows[o, j], np.array(members)[o]) for j, o in enumerate(order)]

    def _triples(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, code[:-2] * self.base + code[1:-1]) * self.base + code[2:]

    def embed(self, windows: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By window size: the rows of `windows` that have it, and their LSH keys, a column for each walk and sample."""
        n_windows, width = windows.shape
        # Beyond its end a walk writes the end mark, which moves nowhere.
        padded = np.concatenate([windows, np.full((n_windows, 1), -1)], axis=1)
        padded[np.arange(width + 1) >= sizes[:, None]] = -1
        rows = np.arange(n_windows)
        at = np.zeros((WALKS, n_windows), np.int64)
        written = np.empty((2 * width, WALKS, n_windows), np.int64)
        for step in range(2 * width):
            written[step] = padded[rows, at]
            at = np.minimum(at + _bits(written[step], step), sizes)
        found = {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            draw = np.random.default_rng([SEED, n])
            keys = np.zeros((WALKS * SAMPLES, len(own)), np.uint64)
            for j in range(WALKS * SAMPLES):
                for place in np.sort(draw.choice(2 * n, PLACES, replace=False)):
                    keys[j] = _mix(keys[j] * np.uint64(31) + written[place, j // SAMPLES, own].astype(np.uint64))
            found[n] = own, keys.T
        return found

    def hits(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first word, item, words, edits) of hits in coded words; `ends` has for each word the end of its document."""
        if not len(codes) or not self.items:
            return
        codes = np.concatenate([codes, np.zeros(max(self.by_size), np.int64)])
        first = np.flatnonzero((codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0))
        place, there = _places(self.pairs, codes[first] * self.base + codes[first + 1])
        first, place = first[there], place[there]
        place, there = _places(self.triples, place * self.base + codes[first + 2])
        first, place = first[there], place[there]
        found, sizes, best = [], [], {}
        for n, has in self.has.items():
            k = allowed_edits(n)
            starts = _windows_with(first[has[place]], max(1, n - 2 - 3 * k), n - 2)
            starts = starts[starts < len(ends)]
            # Words beyond a document's end are missing from the window, each an edit.
            starts = starts[ends[starts] - starts >= n - k]
            found.append(starts)
            sizes.append(np.full(len(starts), n))
        starts, sizes = np.concatenate(found), np.concatenate(sizes)
        step = max(16, (1 << 22) // (2 * WALKS * max(self.by_size)))
        for i in range(0, len(starts), step):
            self._verified(codes, ends, starts[i : i + step], sizes[i : i + step], best)
        for (_, item), (distance, start) in best.items():
            yield start, self.items[item][0], len(self.codes[item]), distance

    def _verified(self, codes, ends, starts, sizes, best):
        """Keeps in `best` the edits and the start of the best window for each end of a document and item."""
        width = int(sizes.max())
        at = starts[:, None] + np.arange(width)
        inside = (at < ends[starts][:, None]) & (np.arange(width) < sizes[:, None])
        windows = np.where(inside, codes[np.minimum(at, len(codes) - 1)], 0)
        for n, (own, keys) in self.embed(windows, sizes).items():
            candidates = set()
            for j, (sorted_keys, members) in enumerate(self.keys[n]):
                low = np.searchsorted(sorted_keys, keys[:, j], "left")
                high = np.searchsorted(sorted_keys, keys[:, j], "right")
                for row in np.flatnonzero(high > low).tolist():
                    candidates.update((row, m) for m in members[low[row] : high[row]].tolist())
            pairs = np.array(sorted(candidates), np.int64).reshape(-1, 2)
            most, together = allowed_edits(n), max(1, (1 << 21) // n)
            least = np.concatenate(
                [self._least_edits(windows[own[p[:, 0]], :n], p[:, 1]) for p in _cut(pairs, together)] + [np.zeros(0, np.int64)]
            )
            # Those that may need the fewest edits first, and so the likely best window of each document and item.
            order = np.argsort(least, kind="stable")
            order = order[least[order] <= most]
            _, first = np.unique(np.column_stack([ends[starts[own[pairs[order, 0]]]], pairs[order, 1]]), axis=0, return_index=True)
            later = np.delete(order, first)
            for part in [*_cut(order[first], together), *_cut(later, together)]:
                keys = [(int(ends[starts[own[r]]]), int(m)) for r, m in pairs[part]]
                open_ = [x for x, k in zip(part.tolist(), keys, strict=True) if k not in best or least[x] <= best[k][0]]
                if not open_:
                    continue
                row, item = own[pairs[open_, 0]], pairs[open_, 1]
                distance = edits(windows[row, :n], np.stack([self.codes[x] for x in item]), most)
                for x in np.flatnonzero(distance <= most).tolist():
                    start = int(starts[row[x]])
                    key, value = (int(ends[start]), int(item[x])), (int(distance[x]), start)
                    best[key] = min(best.get(key, value), value)

    def _least_edits(self, windows: np.ndarray, members: np.ndarray) -> np.ndarray:
        """A lower bound of the edits between each window and its item, both of n words: n less the words they share."""
        n = windows.shape[1]
        item_words = np.sort(np.stack([self.codes[m] for m in members]), axis=1)
        # Rows apart by a multiple of the vocabulary, and equal words of a row numbered, so that places match one to one.
        lift = np.arange(len(windows), dtype=np.int64)[:, None] * self.base
        ours, theirs = (_numbered(np.sort(x, axis=1) + lift) for x in (windows, item_words))
        shared = np.isin(ours, theirs, assume_unique=True).reshape(-1, n).sum(axis=1)
        return n - shared


def _places(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted table each value would be, and whether it is there."""
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return place, table[place] == values


def _windows_with(places: np.ndarray, least: int, size: int) -> np.ndarray:
    """Starts of the windows of `size` positions that hold at least `least` of the sorted places."""
    if len(places) < least:
        return np.zeros(0, np.int64)
    last, first = places[least - 1 :], places[: len(places) - least + 1]
    close = last - first < size
    low, high = np.maximum(last[close] - size + 1, 0), first[close]
    n = high - low + 1
    return np.unique(np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))


def _cut(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def _numbered(rows: np.ndarray) -> np.ndarray:
    """Sorted rows as one list in which equal values, told apart by their number, are distinct."""
    flat, n = rows.ravel(), rows.shape[1]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
    return flat * n + (np.arange(len(flat)) - begin)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _bits(words: np.ndarray, step: int) -> np.ndarray:
    """A random bit for each word of each walk at a step."""
    salts = _mix(np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(step + SEED))
    mixed = _mix(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salts[:, None])
    return (mixed >> np.uint64(40)).astype(np.int64) & 1


def edits(windows: np.ndarray, items: np.ndarray, most: int | None = None) -> np.ndarray:
    """Edit distance of each window to the item in the same row, both of one size, in words.

    Distances above `most` come out as some number above it: a path of k edits between rows of one size strays at most
    k/2 from the diagonal, so only a band of that width is gone through.
    """
    rows, n = windows.shape
    half = n if most is None else min(n, most // 2)
    far = 2 * n + 1
    # Column c of the band stands for the first i + c - half words of the window, at step i.
    ramp = np.arange(2 * half + 1)
    padded = np.pad(windows, ((0, 0), (half, half)), constant_values=-1)
    band = np.tile(np.where(ramp >= half, ramp - half, far), (rows, 1))
    for i in range(1, n + 1):
        place = i + ramp - half
        change = band + (items[:, i - 1 : i] != padded[:, i - 1 : i + 2 * half])
        dropped = np.concatenate([band[:, 1:] + 1, np.full((rows, 1), far)], axis=1)
        best = np.minimum(change, dropped)
        best[:, (place < 0) | (place > n)] = far
        best[:, place == 0] = i
        # An insertion costs one more than the cell to the left: a running minimum along the row.
        band = np.minimum.accumulate(best - ramp, axis=1) + ramp
    return band[:, half]


def _scan(index: ItemIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = index.vocabulary.get
    ids, lengths, codes, size = [], [], [], 0

    def found():
        ends = np.cumsum(lengths)
        per_word = np.repeat(ends, lengths)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for start, item, n, distance in index.hits(np.concatenate(codes), per_word):
            doc = int(np.searchsorted(ends, start, "right"))
            key, value = (doc, item), (distance, start - int(ends[doc] - lengths[doc]), n)
            best[key] = min(best.get(key, value), value)
        rows = [(ids[doc], item, s, n, d) for (doc, item), (d, s, n) in sorted(best.items())]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["doc_id", "item_id", "start_word", "n_words", "edits"],
        )

    for b in batches:
        for doc_id, text in id_texts(b):
            row = np.fromiter((code(w, 0) for w in words_of(text)), np.int64)
            ids.append(doc_id)
            lengths.append(len(row))
            codes.append(row)
            size += len(row)
            if size >= PIECE_WORDS:
                yield found()
                ids, lengths, codes, size = [], [], [], 0
    if ids:
        yield found()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each document and item that it holds: the window with the fewest edits, by its first word and size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = ItemIndex([(r.item_id, (r.text or "").encode()) for r in part.collect()])

        def run(batches, index=index):
            return _scan(index, batches)

        rows = texts(docs, id_col, text_col).mapInArrow(run, OUTPUT)
        found = rows if found is None else found.unionByName(rows)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, that hold no item of the benchmark."""
    items = benchmark.select("item_id", "text")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = ItemIndex([(r.item_id, (r.text or "").encode()) for r in part.collect()])

        def run(batches, index=index):
            for b in batches:
                raw = b.column(b.schema.get_field_index("text"))
                numbered = pa.RecordBatch.from_arrays([pa.array(range(len(b)), pa.int64()), raw], names=["doc_id", "text"])
                hit = {i for x in _scan(index, iter([numbered])) for i in x.column(0).to_pylist()}
                yield b.filter(pa.array([i not in hit for i in range(len(b))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
