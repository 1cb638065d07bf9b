"""Quality by compression: zstandard dictionaries of good and bad labelled text.

A text is cut into chunks, each compressed under both dictionaries; the difference of the summed sizes over the
text's size, and the larger differences of its worst chunk, become a score by a logistic fit. Chunks keep the
dictionaries at work in long texts, which would otherwise compress against themselves.

Null and empty texts have no size and score what the fit says for no difference. Repeated rows score alike, texts
of any length are read whole, an empty table scores nothing, and only the id and the text are looked at. Without
labelled rows of both classes every text gets the base rate.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import FOLDS, fit_logistic, fold_of, held_out, id_texts, labelled_sample, logistic, texts

CHUNK_BYTES = 1_500
LEVEL = 3
DICT_BYTES = 48_000
# The fit reads at most so many bad and good texts; dictionaries are built from so many chunks of each, spread over the text.
TRAIN_TEXTS = (2_500, 2_500)
TRAIN_CHUNKS = 8
GOOD_SCORE = 0.7


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]


@dataclass
class QualityModel:
    bad: bytes
    good: bytes
    weights: np.ndarray

    def __post_init__(self):
        self._compress = None

    def __getstate__(self):
        return {"bad": self.bad, "good": self.good, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def features(self, parts: list[bytes]) -> tuple[float, float]:
        """(size under bad - size under good) / size, over the whole text and at its least chunk."""
        if self._compress is None:
            self._compress = _compressor(self.bad).compress, _compressor(self.good).compress
        bad, good = self._compress
        differences = [len(bad(p)) - len(good(p)) for p in parts]
        size = sum(map(len, parts))
        if not size:
            return 0.0, 0.0
        # The last chunk may be a few bytes, so a chunk counts as half full at least.
        least = min(d / max(len(p), CHUNK_BYTES // 2) for d, p in zip(differences, parts, strict=True))
        return sum(differences) / max(size, 50), least

    def score(self, text: bytes) -> float:
        return logistic(self.weights, *self.features(chunks(text)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        dict_size=len(dictionary),
        source_size=CHUNK_BYTES,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_dict_id=0,
        write_checksum=0,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=params)


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; where these are too few to train on, the samples themselves."""
    if len(samples) >= 50:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b" " + b"".join(samples)[-DICT_BYTES:]


def _built(examples: list[tuple[int, list[bytes], int]]) -> QualityModel:
    """The two dictionaries, without weights."""
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for _, pieces, label in examples:
        parts[label] += [p for p in pieces if p]
    return QualityModel(_dictionary(parts[0]), _dictionary(parts[1]), np.zeros(3))


def fold_models(examples: list[tuple[int, list[bytes], int]]) -> list[QualityModel]:
    """For each fold the dictionaries built from the others."""
    return [_built([x for x in examples if fold_of(x[0]) != f]) for f in range(FOLDS)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", keep: Column | None = None) -> QualityModel:
    """Fit on a sample of at most TRAIN_TEXTS labelled texts; dictionaries are built from TRAIN_CHUNKS chunks of each at most.

    Each fold is looked at, all chunks of its texts, with dictionaries built from the others, which calibrates the weights;
    the final dictionaries are built from all.
    """
    keep = F.lit(True) if keep is None else keep
    sample = labelled_sample(texts(docs), labels, label_col, keep, TRAIN_TEXTS).select("doc_id", "text", "label")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for _, t in id_texts(b):
                parts = chunks(t)
                cut.append(parts[:: -(-len(parts) // TRAIN_CHUNKS) or 1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cut, pa.list_(pa.binary())), b.column(2)], names=["doc_id", "parts", "label"]
            )

    found = sample.mapInArrow(spread, "doc_id long, parts array<binary>, label int").collect()
    examples = sorted([(r.doc_id, [bytes(p) for p in r.parts], r.label) for r in found], key=lambda x: x[0])
    models = fold_models(examples)

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [models[fold_of(i)].features(chunks(t)) for i, t in id_texts(b)]
            columns = [pa.array([x[k] for x in pairs], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, b.column(2)], names=["doc_id", "whole", "least", "label"])

    seen = sample.mapInArrow(looked_at, "doc_id long, whole double, least double, label int").collect()
    data = np.array([(r.whole, r.least, r.label) for r in sorted(seen, key=lambda r: r.doc_id)] or [(0.0, 0.0, 0)], dtype=float)
    model = _built(examples)
    model.weights = fit_logistic(data[:, :2], data[:, 2], ridge=1e-3)
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `score` from 0 to 1: a row for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.score(t) for _, t in id_texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` for each row, learned from the folds not held out."""
    model = train(docs, labels, keep=~held_out("doc_id", 4, 2))
    return score(docs, model).select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"),
    )
