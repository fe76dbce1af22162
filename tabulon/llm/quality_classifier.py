"""Quality scores from compressed sizes under dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, in_batches
from .kernels import text_buffer

#: Labelled rows of each class, and their bytes, that the model is fitted on at most; in hash order.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 8_000_000
#: Bytes of a trained dictionary at most; of the pieces that it is trained on; and of those that texts are compressed in.
DICTIONARY = 300_000
PIECE = 2_048
CHUNK = 1_024
LEVEL = 3
CUT = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Two trained dictionaries of equal size (none, where nothing could be learned) and the calibration's offset and slope."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]


def _dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """A dictionary trained on the texts of either class, both of one size: at most half of the smaller class's bytes.

    With too little text of a class to train on there are none.
    """
    import zstandard

    size = min(DICTIONARY, *(sum(map(len, texts)) // 2 for texts in (good, bad)))
    out = []
    for texts in (good, bad):
        pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        try:
            out.append(zstandard.train_dictionary(size, pieces, k=256, d=8, steps=1).as_bytes())
        except (zstandard.ZstdError, ValueError):  # says that there is too little
            return b"", b""
    return out[0], out[1]


def _sizer(dictionary: bytes) -> Callable[[memoryview], int]:
    """Compressed size of a text, in chunks: what is alike within a text hides less of what the dictionary does."""
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress
    return lambda text: sum(len(compress(text[i : i + CHUNK])) for i in range(0, len(text), CHUNK))


def difference(texts: list[memoryview], model: QualityModel) -> np.ndarray:
    """Compressed size under the bad dictionary less that under the good one, by bytes of the text; 0 for an empty text."""
    if not model.good:
        return np.zeros(len(texts))
    good, bad = _sizer(model.good), _sizer(model.bad)
    return np.array([(bad(t) - good(t)) / len(t) if len(t) else 0.0 for t in texts])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, steps: int = 200) -> tuple[float, float]:
    """Offset and slope of a ridge logistic regression, by damped Newton steps."""
    design = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * w @ w / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * w
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on at most SAMPLE_ROWS labelled rows of each class, taken in hash order among rows that aren't held out.

    Half of the rows train the two dictionaries, the other half calibrates, each class weighing as
    much as it has labels in all. Labels other than 0 and 1 and null ids are ignored; of contradicting labels of an id the smaller holds. Without
    enough text of both classes every score is 0.5.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.withColumn("__h", F.xxhash64(F.lit(3), "doc_id"))
    counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    taken = []
    for label in (0, 1):
        taken += marks.where(F.col("quality") == label).orderBy("__h", "doc_id").limit(SAMPLE_ROWS).collect()  # bounded by SAMPLE_ROWS
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["quality"], r["__h"]) for r in taken], "doc_id long, quality int, __h long")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    # a bounded sample of bounded bytes: of very long chosen texts fewer are taken
    room = {r["quality"]: r["b"] for r in found.groupBy("quality").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    most = [int(min(1.0, SAMPLE_BYTES / max(1, room.get(y, 1))) * 1e6) for y in (0, 1)]
    keep = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1_000_000)) < F.when(F.col("quality") == 1, most[1]).otherwise(most[0])
    rows = [(r["quality"], r["text"].encode()) for r in found.where(keep).orderBy("__h", "doc_id", "text").limit(4 * SAMPLE_ROWS).collect()]
    build, check = rows[::2], rows[1::2]
    good, bad = _dictionaries(*([t for y, t in build if y == label] for label in (1, 0)))
    y = np.array([y for y, _ in check], int)
    if not good or len(set(y.tolist())) < 2:
        return QualityModel(b"", b"", (0.0, 0.0))
    x = difference([memoryview(t) for _, t in check], QualityModel(good, bad, (0.0, 0.0)))
    weight = np.where(y == 1, counts.get(1, 0) / (y == 1).sum(), counts.get(0, 0) / (y == 0).sum()) / sum(counts.values())
    return QualityModel(good, bad, _logistic(x, y, weight))


def _score(model: QualityModel, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, slope = model.weights
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            texts = [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            score = 1 / (1 + np.exp(-np.clip(offset + slope * difference(texts, model), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """docs plus a column `name` with the score (0 to 1) of the whole text; the text alone is looked at.

    The score is a logistic curve over the difference of the text's compressed sizes under the two
    dictionaries, normalised by its length: nothing else goes into it. Null and empty texts get the score of no difference. All rows
    stay, equal texts score alike. A column of that name must not be there yet (see common.free_names).
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name!r} already")
    return in_batches(docs, _score(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(name: str = "quality_score") -> Column:
    return F.col(name) >= CUT
