"""Spelling variants: words one edit apart, found by a bit-sliced index of letters at positions.

For a block of the vocabulary the index has, for each position and letter, the set of words with that letter there, a
bit for each word. A query word of m letters is read once. After i of its letters one bit set holds the words that
agree with it so far (no error), and three hold those with one error: a replaced letter (the word is read in step), an
extra letter in the query (the word is read one position behind) and a missing one (one position ahead). Each letter
updates all sets with a few AND and OR of whole machine words, so a block is compared in parallel; what is left after
the last letter and has the right length is near. Slices are made from the block's letters as the query proceeds, three
positions at a time, so a very long word takes no more memory than its letters.

Words one edit apart, the shorter of m letters, agree in the first m // 2 letters or in the last m - m // 2. Words are
dealt out by these halves: a word of n letters with the words it may be the shorter one of (m = n) and with those that it
may be the longer one of (m = n - 1). Small groups are indexed together, as they do no harm to each other; a group of
more than BLOCK_WORDS is split into blocks, and its queries go to each. No pair is left out, and one that agrees in both
halves is reported by the first only.

A null text has no words; a null id leaves its words whole, since there is no id to draw the deleted letter by. Repeated
rows count again. Words of any length are compared; an empty table gives an empty result; of the table's columns only id
and text are looked at. Occurrences are added up before they are shuffled, so frequent words cost no more than rare ones.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import texts, written

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS = 7
MIN_TIMES = 2
DELETE_EVERY = 31
# A form is so many times as frequent as its variant.
RATIO = 10
BLOCK_WORDS = 2_048
QUERY_WORDS = 256
# Small groups are indexed together up to so many words and letters.
BIN_WORDS, BIN_LETTERS = 512, 1 << 20
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def lower_ascii(word: Column) -> Column:
    """A-Z only; words that have none are passed over."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word` and `n`, its occurrences: runs of letters, of which those that DELETE_EVERY selects lose one letter."""
    # A match of at least MIN_LETTERS letters begins where its run does.
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))
    rows = texts(docs, id_col, text_col).select("doc_id", F.explode(runs).alias("run"))
    rows = rows.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    hashed = rows.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    cut = F.expr("concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2))")
    word = F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TIMES)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each word, padded with zeros, and the lengths."""
    lengths = np.array([len(w) for w in words])
    return np.array(words, f"U{lengths.max()}").view(np.uint32).reshape(len(words), -1), lengths


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    packed = np.packbits(rows, axis=-1, bitorder="little")
    padded = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    padded[..., : packed.shape[-1]] = packed
    return padded.view(np.uint64)


def one_edit(queries: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs (query, word) one edit apart, the query no longer than the word; all queries have one length."""
    block, lengths = _matrix(words)
    asked, _ = _matrix(queries)
    m = asked.shape[1]
    block = np.pad(block, ((0, 0), (0, max(0, m + 1 - block.shape[1]))))

    def slices(position: int, letters: np.ndarray) -> np.ndarray:
        """For each query the words with its letter there: looked up in the slice of each (position, letter)."""
        alphabet, which = np.unique(letters, return_inverse=True)
        return _bits(block[None, :, position] == alphabet[:, None])[which]

    shape = (len(queries), -(-len(words) // 64))
    exact = np.full(shape, ALL)
    replaced, missing = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    for i in range(m):
        letters = asked[:, i]
        here, ahead = slices(i, letters), slices(i + 1, letters)
        missing = (missing | exact) & ahead
        replaced = (replaced & here) | (exact & ~here)
        exact &= here
    # Words of m + 1 letters that agree to the end lack the last one in the query.
    same, longer = _bits((lengths == m)[None]), _bits((lengths == m + 1)[None])
    near = (replaced & same) | ((missing | exact) & longer)
    return np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))


def _shared_halves(rows: DataFrame) -> DataFrame:
    """`word`, `n` and the groups in which it is compared: `m`, the shorter length, `side`, and `half`."""
    halves = [
        F.struct(
            m.alias("m"), F.lit(side).alias("side"),
            (F.expr(f"left(word, int({s} div 2))") if side == 0 else F.expr(f"right(word, int({s} - {s} div 2))")).alias("half"),
        )
        for s in ("length(word)", "(length(word) - 1)")
        for m in (F.expr(s),)
        for side in (0, 1)
    ]
    return rows.select("word", "n", F.explode(F.array(*halves)).alias("g")).select("word", "n", "g.m", "g.side", "g.half")


PAIRS = "word string, n long, near string, near_n long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of blocks, the indexed words of each ahead of its queries, to pairs in both directions."""
    held: list[tuple] = []  # (group, word, n) of the bin's index
    asked: list[tuple] = []  # and of its queries
    letters = 0

    def found() -> pa.RecordBatch:
        pairs = []
        groups, words, counts = zip(*held, strict=True)
        for i in range(0, len(asked), QUERY_WORDS):
            q_groups, queries, q_counts = zip(*asked[i : i + QUERY_WORDS], strict=True)
            for q, w in zip(*one_edit(list(queries), list(words)), strict=True):
                if groups[w] != q_groups[q]:
                    continue
                side, half = groups[w][1], len(queries[q]) // 2
                if side == 1 and queries[q][:half] == words[w][:half]:
                    continue
                pairs.append((queries[q], q_counts[q], words[w], counts[w]))
                if len(words[w]) > len(queries[q]):
                    pairs.append((words[w], counts[w], queries[q], q_counts[q]))
        columns = list(zip(*pairs, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n", "near", "near_n"]
        )

    last = None
    for b in batches:
        for m, side, half, block, role, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            group = (m, side, half, block)
            full = len(held) >= BIN_WORDS or letters >= BIN_LETTERS
            if last is not None and group != last and (m != last[0] or full):
                yield found()
                held, asked, letters = [], [], 0
            elif len(asked) >= 4 * BLOCK_WORDS and group == last:
                # The queries of a large group come one block after another against the same index.
                yield found()
                asked = []
            last = group
            if role == 0:
                held.append((group, word, n))
                letters += len(word)
            if len(word) == m:
                if role == 1 or block < 0:
                    asked.append((group, word, n))
    if held:
        yield found()


def near_words(words: DataFrame) -> DataFrame:
    """`word`, `n`, `near`, `near_n`: a row for each ordered pair of words one edit apart; `words` has `word` and `n`."""
    keys = ["m", "side", "half"]
    rows = _shared_halves(words)
    large = rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_WORDS)
    sized = rows.join(large, keys, "left")
    small = sized.where("size is null").select(*keys, F.lit(-1).alias("block"), F.lit(0).alias("role"), "word", "n")
    split = sized.where("size is not null").withColumn("blocks", F.ceil(F.col("size") / BLOCK_WORDS).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    indexed = split.select(*keys, own.alias("block"), F.lit(0).alias("role"), "word", "n")
    queries = split.where(F.length("word") == F.col("m")).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "word", "n"
    )
    dealt = small.unionByName(indexed).unionByName(queries).repartition(*keys, "block")
    return dealt.sortWithinPartitions(*keys, "block", "role", "word").mapInArrow(_compared, PAIRS)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` for each word of the vocabulary.

    The form is the most frequent near word, of equals the smallest, if it occurs RATIO times as often; the root is
    reached by following forms. Each form is RATIO times as frequent as the last, so chains are short; they are halved
    by a join until all have ended.
    """
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    # The least of (-n, word) is the most frequent, and of equals the smallest.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.expr(f"if(-best.minus >= {RATIO} * n, best.form, null)").alias("form"),
            F.expr(f"if(-best.minus >= {RATIO} * n, -best.minus, null)").alias("form_n"),
        ),
        "forms",
    )
    ends = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(ends.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        ends = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            break
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
