"""Toxicity by compression distance: two zstandard dictionaries, one window of text under both.

A window is a word between spaces. Under the dictionary of its own class it is one match and a few bytes; under
the other it falls into pieces. The pair (length under the ordinary dictionary, length under the toxic one) is
looked up in a table of log-likelihood ratios, calibrated on labelled texts by dictionaries built from others: pairs at
or above a threshold are toxic evidence. A logistic fit over the evidence of a text and its size gives the score.

Null and empty texts hold no window and score what the fit says for no evidence at all. Repeated rows score alike,
ties cannot arise, texts of any length are read whole, an empty table scores nothing, and of the table's columns
only the id and the text are looked at. Without labelled rows of both classes every text gets the base rate.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import FOLDS, fit_logistic, fold_of, held_out, id_texts, labelled_sample, logistic, texts

WORD = re.compile(r"[^\W\d_]+")
# Two bytes a character make a literal dearer than a match, so that lengths count matches.
ENCODING = "utf-16-le"
LEVEL = 19
# Words kept for a dictionary: in so many training texts of the class, and there so many times as often as in the other.
MIN_TEXTS, CONTRAST = 3, 8.0
DICT_BYTES = {"toxic": 32_000, "ordinary": 64_000}
# Windows whose log-likelihood ratio reaches this are evidence.
EVIDENCE = 1.5
# The fit reads at most so many ordinary and toxic texts.
TRAIN_TEXTS = (4_000, 2_000)
# Lengths above this are one class of the table.
LONGEST = 63
# Words whose evidence a Python worker remembers.
CACHE_WORDS = 300_000
TOXIC_SCORE = 0.7


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    evidence: dict[tuple[int, int], float]
    weights: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False)
    _ceiling: int = 0

    def __post_init__(self):
        self._ceiling = max((toxic for _, toxic in self.evidence), default=-1)
        self._compress = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "evidence": self.evidence, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def lengths(self, word: str) -> tuple[int, int]:
        """Compressed lengths of the word's window under the ordinary and the toxic dictionary."""
        if self._compress is None:
            self._compress = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        window = f" {word} ".encode(ENCODING, "replace")
        ordinary, toxic = self._compress
        return min(len(ordinary(window)), LONGEST), min(len(toxic(window)), LONGEST)

    def evidence_of(self, word: str) -> float:
        found = self._cache.get(word)
        if found is None:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            found = self._cache[word] = self._look_up(word)
        return found

    def _look_up(self, word: str) -> float:
        if self._compress is None:
            self.lengths(word)
        # No pair in the table has a longer toxic length, so the second compression can be spared.
        if len(self._compress[1](f" {word} ".encode(ENCODING, "replace"))) > self._ceiling < LONGEST:
            return 0.0
        return self.evidence.get(self.lengths(word), 0.0)

    def features(self, words: Iterable[str]) -> tuple[float, float, int]:
        """Log of the summed evidence, log of the number of distinct words, number of words that are evidence."""
        distinct = set(words)
        found = [e for e in map(self.evidence_of, distinct) if e]
        return float(np.log1p(sum(found))), float(np.log1p(len(distinct))), len(found)

    def score(self, text: bytes) -> tuple[float, int]:
        evidence, size, n = self.features(words_of(text))
        return logistic(self.weights, evidence, size), n


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        dict_size=len(dictionary),
        source_size=64,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_dict_id=0,
        write_checksum=0,
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=params)


def _dictionary(own: Counter, n_own: int, other: Counter, n_other: int, contrast: float, size: int) -> bytes:
    """The class's words, the most frequent last, where matches are cheapest."""
    rate = max(n_own, 1) / max(n_other, 1)
    kept = [w for w, n in own.items() if n >= MIN_TEXTS and n >= contrast * rate * (other[w] + 0.5)]
    kept.sort(key=lambda w: (own[w], w))
    return f" {' '.join(kept)} ".encode(ENCODING, "replace")[-size:]


def _built(examples: list[tuple[int, set[str], int]]) -> ToxicityModel:
    """The two dictionaries, without evidence or weights."""
    counts, n, seen = {0: Counter(), 1: Counter()}, Counter(), set()
    for _, words, label in examples:
        # Copies would make each other's words look typical. Texts with the same longest words count once.
        key = label, *nsmallest(2, words, key=lambda w: (-len(w), w))
        if key not in seen:
            seen.add(key)
            counts[label].update(words)
            n[label] += 1
    toxic = _dictionary(counts[1], n[1], counts[0], n[0], CONTRAST, DICT_BYTES["toxic"])
    # Ordinary text gives all its words but those the toxic dictionary has.
    taken = set(toxic.decode(ENCODING, "replace").split())
    ordinary = Counter({w: k for w, k in counts[0].items() if w not in taken})
    return ToxicityModel(
        _dictionary(ordinary, n[0], Counter(), n[1], 0.0, DICT_BYTES["ordinary"]), toxic, {}, np.zeros(3)
    )


def fit(examples: list[tuple[int, set[str], int]]) -> ToxicityModel:
    """A model from (id, distinct words, label) of labelled texts.

    Each fold is looked at with dictionaries built from the others, which calibrates the table and the weights; the
    final dictionaries are built from all.
    """
    folds = [[x for x in examples if fold_of(x[0]) == f] for f in range(FOLDS)]
    models = [_built([x for x in examples if fold_of(x[0]) != f]) for f in range(FOLDS)]
    seen, m = {0: Counter(), 1: Counter()}, Counter()
    for model, fold in zip(models, folds, strict=True):
        known: dict[str, tuple[int, int]] = {}
        for _, words, label in fold:
            for w in words.difference(known):
                known[w] = model.lengths(w)
            seen[label].update({known[w] for w in words})
            m[label] += 1
    # A count is taken for one standard deviation less, so that few texts don't make evidence.
    ratio = {
        pair: float(np.log((k - np.sqrt(k) + 0.2) / (m[1] + 1)) - np.log((seen[0][pair] + 1) / (m[0] + 1)))
        for pair, k in seen[1].items()
    }
    evidence = {pair: r for pair, r in ratio.items() if r >= EVIDENCE}
    rows = [(0.0, 0.0, 0)][: not examples]
    for model, fold in zip(models, folds, strict=True):
        model = ToxicityModel(model.ordinary, model.toxic, evidence, np.zeros(3))
        rows += [(*model.features(words)[:2], label) for _, words, label in fold]
    data = np.array(rows, dtype=float)
    final = _built(examples)
    return ToxicityModel(final.ordinary, final.toxic, evidence, fit_logistic(data[:, :2], data[:, 2]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", keep: Column | None = None) -> ToxicityModel:
    """Fit on a sample of at most TRAIN_TEXTS labelled texts; only their distinct words reach the driver."""
    keep = F.lit(True) if keep is None else keep
    sample = labelled_sample(texts(docs), labels, label_col, keep, TRAIN_TEXTS)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, " ".join(sorted(set(words_of(t))))) for i, t in id_texts(b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), b.column(2)],
                names=["doc_id", "words", "label"],
            )

    found = sample.select("doc_id", "text", "label").mapInArrow(distinct, "doc_id long, words string, label int")
    examples = [(r.doc_id, set(r.words.split(" ")) - {""}, r.label) for r in found.collect()]
    return fit(sorted(examples, key=lambda x: x[0]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `score` from 0 to 1, `n_evidence` (distinct words found toxic): a row for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.score(t) for _, t in id_texts(b)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([n for _, n in found], pa.int32()),
                ],
                names=["doc_id", "score", "n_evidence"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_evidence int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted`, `n_evidence` for each row, learned from the folds not held out."""
    model = train(docs, labels, keep=~held_out("doc_id", 3, 1))
    return score(docs, model).select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
        "n_evidence",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores below TOXIC_SCORE."""
    model = train(docs, labels, keep=~held_out("doc_id", 3, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            keep = [model.score(t.as_py() or b"")[0] < TOXIC_SCORE for t in raw]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
