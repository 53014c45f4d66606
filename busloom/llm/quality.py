"""Quality by compression: which of two dictionaries, of good or of bad text, makes a document smaller.

Two zstandard dictionaries are trained on labelled text.  A document is cut into chunks of
``chunk`` bytes, so that the dictionary and not the document's own past explains it; every chunk is
compressed with both.  (bytes with the bad dictionary - bytes with the good one) / bytes of text is
the normalised difference; ``PRIOR_BYTES`` of typical text are added to every document, so that a few
words of it decide little.  A rising curve fitted on other labelled documents (isotonic regression,
with a small share of a logistic curve so that it never stays level) turns it into the probability
of label 1.

Fitting uses a bounded sample (``per_class`` documents of each label, taken by hash); scoring reads
every text whole and shuffles nothing.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.llm.common import appended, hash_sample, least_text
from busloom.llm.linear import calibrate, logistic, rising_curve

PER_CLASS = 3000
CHUNKS_PER_DOCUMENT = 16
CHUNK = 512
DICTIONARY_BYTES = 1 << 18
SAMPLE_BYTES = 8 << 20
LEVEL = 3
LOGISTIC_SHARE = 0.05
PRIOR_BYTES = 64
CALIBRATION_SHARE = 4  # of the sampled documents every fourth calibrates, the others make dictionaries


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    trained: tuple[bool, bool]  # a trained dictionary, or else plain text
    slope: float
    offset: float
    knots: tuple[float, ...] = ()
    values: tuple[float, ...] = ()
    typical: float = 0.0  # the mean normalised difference
    chunk: int = CHUNK
    level: int = LEVEL

    def margin(self, difference: int, size: int) -> float:
        return (difference + PRIOR_BYTES * self.typical) / (size + PRIOR_BYTES)

    def probability(self, difference: int, size: int) -> float:
        """Of label 1, from (size by bad - size by good) and the size of the text."""
        difference = self.margin(difference, size)
        smooth = logistic(self.slope * difference + self.offset)
        if not self.knots:
            return smooth
        return (1 - LOGISTIC_SHARE) * float(np.interp(difference, self.knots, self.values)) + LOGISTIC_SHARE * smooth


class Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, model: CompressionModel):
        self.chunk = model.chunk
        self.good, self.bad = (self._compressor(d, t, model.level) for d, t in zip((model.good, model.bad), model.trained, strict=True))

    @staticmethod
    def _compressor(content: bytes, trained: bool, level: int) -> zstandard.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(level=level, **plain)
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=dictionary, level=level, **plain)

    def sizes(self, text: str) -> tuple[int, int]:
        """Size by bad - size by good, and size of the text."""
        data = text.encode()
        good = bad = 0
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
        return bad - good, len(data)


def sample_of(labels: DataFrame, trainable: Column, per_class: int) -> DataFrame:
    """doc_id, quality and rank of at most ``per_class`` trainable documents of each label, taken by hash.

    Documents labelled 0 and 1 at once are left out; so are null ids and labels other than 0 and 1.
    """
    clear = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & trainable)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where("quality = _most").select("doc_id", "quality")
    )
    return hash_sample(clear, "quality", per_class)


def _dictionary(documents: list[str], size: int, chunk: int, level: int) -> tuple[bytes, bool]:
    picked = []
    for text in documents:
        data = text.encode()
        parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
        every = max(1, -(-len(parts) // CHUNKS_PER_DOCUMENT))  # chunks from all over a long text
        picked += parts[::every]
    random.Random(7).shuffle(picked)
    picked = picked[: SAMPLE_BYTES // chunk]
    total = sum(map(len, picked))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), picked, level=level).as_bytes(), True
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(picked)[-size:], False


def fit(
    docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = PER_CLASS, chunk: int = CHUNK,
    dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL,
) -> CompressionModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); ``trainable`` is a condition on doc_id.

    ``per_class`` bounds what is collected: that many documents of each label at most, of which
    every fourth calibrates; of an id's texts, the one with the least digest.  The calibration weighs both labels by their counts in ``labels``.
    Without labels of both kinds the score is the smoothed share of label 1 for every document.
    """
    picked = sample_of(labels, trainable, per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The broadcast side has at most 2 * per_class rows of three numbers.
    sample = written_once(least_text(texts.join(F.broadcast(picked), "doc_id"), "doc_id", "quality", "rank"), "quality-sample")
    rows = sorted(((r.quality, r.rank, r.text) for r in sample.toLocalIterator()), key=lambda r: r[:2])
    shares = {r.quality: r.n for r in labels.where(F.col("quality").isin(0, 1) & trainable).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sides = [_dictionary([t for q, rank, t in rows if q == side and rank % CALIBRATION_SHARE], dictionary_bytes, chunk, level) for side in (1, 0)]
    model = CompressionModel(sides[0][0], sides[1][0], (sides[0][1], sides[1][1]), 0.0, 0.0, chunk=chunk, level=level)
    sizer = Sizer(model)
    held = [(q, *sizer.sizes(t)) for q, rank, t in rows if rank % CALIBRATION_SHARE == 0] or [(q, 0, 0) for q, _, _ in rows]
    positive = np.array([q == 1 for q, _, _ in held], bool)
    counts = {True: int(positive.sum()), False: int((~positive).sum())}
    # Weights add up to the number of documents, split as the labels are.
    total = sum(shares.values()) or 1
    weight = np.array([len(held) * shares.get(int(p), 0) / total / counts[bool(p)] for p in positive])
    typical = float(np.average([x / max(1, n) for _, x, n in held], weights=weight)) if weight.sum() else 0.0
    model = replace(model, typical=typical)
    margin = np.array([model.margin(x, n) for _, x, n in held])
    slope, offset = calibrate(margin, positive, weight)
    knots, values = rising_curve(margin, positive, weight) if counts[True] and counts[False] else ((), ())
    return replace(model, slope=slope, offset=offset, knots=tuple(knots), values=tuple(values))


def score(docs: DataFrame, model: CompressionModel, name: str = "score") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier), a row for every row, from its whole text.

    A null text counts as empty; an empty text scores as typical text does.  Repeated rows and null
    ids pass, an empty table gives no rows, a column already called ``name`` is replaced, others come
    back.  The model (two dictionaries of bounded size) is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made():
        fitted = shared.value
        sizer = Sizer(fitted)
        return lambda text: (fitted.probability(*sizer.sizes(text or "")),)

    return appended(docs, made, f"`{name}` double")
