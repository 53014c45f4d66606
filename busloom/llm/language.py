"""Language identification in two steps: family first, then one-versus-one machines inside the family.

Features are hashed letter n-grams of the words (two and three letters with the word's borders, and
the whole word), as shares of a document's n-grams.  Linear support vector machines tell each
family from the rest; inside the winning family every pair of languages has a machine of its own
and the languages are ranked by votes, then by summed margins.

A document's margins are sums over its words, so each distinct word's contribution to all
machines is worked out once per task and kept in a bounded table: whole texts cost one look-up
per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.llm.common import appended, hash_sample, least_text, pairs_of, to_batches
from busloom.llm.linear import calibrate, fit_svm

TRAINING_ROWS = 4000
DIMENSIONS = 4096
GRAMS = (2, 3)
CACHED_WORDS = 400_000
CACHED_GRAMS = 200_000
WORDS_AT_ONCE = 50_000
UNKNOWN = "und"

# Common languages by branch of their family (ISO 639-1 codes).
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "malayo-polynesian": "id jv mg mi ms su tl",
    "sinitic": "yue zh",
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages.split()}


@dataclass(frozen=True)
class LanguageModel:
    """Machines as columns: first one per family (none if there is one family), then the pairs of each family."""

    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    biases: np.ndarray
    slopes: np.ndarray
    offsets: np.ndarray

    @property
    def family_machines(self) -> list[str]:
        return list(self.members) if len(self.members) > 1 else []


def letters_of(word: str) -> list[str]:
    """The runs of letters in a word."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


class _Grams(dict):
    """Feature numbers of n-grams; they repeat far more than words do."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= CACHED_GRAMS:
            self.clear()
        number = self[gram] = crc32(gram.encode()) % DIMENSIONS
        return number


_number_of = _Grams().__getitem__


def word_features(word: str) -> list[int]:
    found = []
    for run in letters_of(word):
        framed = f"^{run}$"
        found.append(crc32(framed.encode()) % DIMENSIONS)
        for n in GRAMS:
            found += map(_number_of, [framed[i : i + n] for i in range(len(framed) - n + 1)])
    return found


class WordTable:
    """For each distinct word a row of sums: its n-grams' weights for every machine, and how many n-grams it has."""

    def __init__(self, weights: np.ndarray, size: int = CACHED_WORDS):
        self.weights = np.vstack([weights, np.zeros(weights.shape[1])])  # the last row is for words without letters
        self.size = size + WORDS_AT_ONCE
        self.rows = np.zeros((self.size, weights.shape[1] + 1))
        self.places: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        features = [word_features(w) for w in words]
        lengths = np.array([len(f) for f in features])
        flat = np.array([x for f in features for x in f or (DIMENSIONS,)])
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 1))[:-1]])
        first = len(self.places)
        self.rows[first : first + len(words), :-1] = np.add.reduceat(self.weights[flat], starts, axis=0)
        self.rows[first : first + len(words), -1] = lengths
        self.places.update(zip(words, range(first, first + len(words)), strict=True))

    def sums(self, text: str) -> np.ndarray:
        words = text.lower().split()
        total = np.zeros(self.rows.shape[1])
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            new = list(dict.fromkeys([w for w in part if w not in self.places]))
            if len(self.places) + len(new) > self.size:
                self.places.clear()
                new = list(dict.fromkeys(part))
            if new:
                self._learn(new)
            total += self.rows[np.fromiter(map(self.places.__getitem__, part), np.int64, len(part))].sum(0)
        return total


def decide(model: LanguageModel, sums: np.ndarray) -> tuple[str, float]:
    """Language and confidence from a document's summed contributions; ``und`` with 0 if it has no letter."""
    if not sums[-1] or not model.members:
        return UNKNOWN, 0.0
    margins = sums[:-1] / sums[-1] + model.biases
    sure = 1 / (1 + np.exp(-np.clip(model.slopes * margins + model.offsets, -700, 700)))
    first = len(model.family_machines)
    family, confidence = next(iter(model.members)), 1.0
    if first:
        at = int(np.argmax(sure[:first]))
        family, confidence = model.family_machines[at], float(sure[at] / sure[:first].sum()) if sure[:first].sum() > 0 else 1 / first
    languages = model.members[family]
    if len(languages) == 1:
        return languages[0], confidence
    votes, chance = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0)
    for k, (a, b) in enumerate(model.pairs, start=first):
        if a in votes and b in votes:
            votes[a if sure[k] >= 0.5 else b] += 1
            chance[a] += float(sure[k])
            chance[b] += 1 - float(sure[k])
    best = max(languages, key=lambda x: (votes[x], chance[x]))
    return best, confidence * chance[best] / (len(languages) - 1)


def _sample(docs: DataFrame, trainable: Column, rows: int) -> DataFrame:
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & trainable)
    languages = usable.select("lang").distinct().count()
    per_language = max(2, rows // max(1, languages))
    picked = hash_sample(usable.select("doc_id", "lang"), "lang", per_language)
    # The broadcast side has at most ``rows`` rows (two for each language, if there are more languages).
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    return least_text(texts, "doc_id", "lang", "rank")


def fit(docs: DataFrame, trainable: Column, rows: int = TRAINING_ROWS) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); ``trainable`` is a condition on doc_id.

    ``rows`` bounds the sample: that many documents in all, the same number of each language,
    taken by hash.  n-grams are counted in tasks; the sums that reach the driver are one sparse row
    per sampled document.  Every fifth document calibrates.  Rows with a null text, language
    or id teach nothing; an id teaches once, its least language and of that the text with the least digest.  A language outside the family table is a family of its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for lang, rank, text in pairs_of(batches, "lang", "rank", "text"):
                features = [f for word in text.lower().split() for f in word_features(word)]
                counts = np.bincount(np.array(features, np.int64), minlength=DIMENSIONS)
                used = np.flatnonzero(counts)
                if len(used):
                    yield lang, rank, used.astype("<i2").tobytes(), (counts[used] / counts.sum()).astype("<f4").tobytes()

        yield from to_batches(found(), pa.schema([("lang", pa.string()), ("rank", pa.int32()), ("used", pa.binary()), ("share", pa.binary())]))

    counted = written_once(_sample(docs, trainable, rows).mapInArrow(count, "lang string, rank int, used binary, share binary"), "language-sample")
    found = sorted((tuple(r) for r in counted.collect()), key=lambda r: (r[0], r[1]))
    languages = sorted({r[0] for r in found})
    members: dict[str, list[str]] = {}
    for language in languages:
        members.setdefault(FAMILY_OF.get(language, language), []).append(language)
    members = dict(sorted(members.items()))
    pairs = [p for group in members.values() for p in combinations(group, 2)]
    x = np.zeros((len(found), DIMENSIONS), np.float32)
    for i, (_, _, used, share) in enumerate(found):
        x[i, np.frombuffer(used, "<i2")] = np.frombuffer(share, "<f4")
    scale = (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32) if len(found) else np.ones(DIMENSIONS, np.float32)
    x *= scale
    lang = np.array([r[0] for r in found], object)
    family = np.array([FAMILY_OF.get(r[0], r[0]) for r in found], object)
    calibrates = np.array([r[1] % 5 == 0 for r in found], bool)
    tasks = [(np.ones(len(found), bool), family == f) for f in members] if len(members) > 1 else []
    tasks += [((lang == a) | (lang == b), lang == a) for a, b in pairs]
    columns, biases, slopes, offsets = [], [], [], []
    for inside, positive in tasks:
        learn, check = inside & ~calibrates, inside & calibrates
        y = np.where(positive[learn], 1, -1).astype(np.float32)
        w, b = fit_svm(x[learn], y)
        used = check if positive[check].any() and (~positive[check]).any() else learn
        slope, offset = calibrate((x[used] @ w + b).astype(float), positive[used])
        columns.append(w * scale)
        biases.append(b)
        slopes.append(slope)
        offsets.append(offset)
    weights = np.stack(columns, 1).astype(float) if columns else np.zeros((DIMENSIONS, 0))
    return LanguageModel(members, pairs, weights, np.array(biases), np.array(slopes), np.array(offsets))


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from each whole text alone.

    A null text or one without a letter is ``und`` with score 0; so is everything if nothing was
    learned.  Repeated rows and null ids pass, an empty table gives no rows, columns already called
    as the new ones (``names``) are replaced, others come back.  The model (DIMENSIONS numbers per machine) is
    broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made():
        fitted = shared.value
        table = WordTable(fitted.weights)
        return lambda text: decide(fitted, table.sums(text or ""))

    return appended(docs, made, f"`{names[0]}` string, `{names[1]}` double")
