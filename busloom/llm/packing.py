"""Packing by power-of-two decomposition.

A document of n tokens is cut into full pieces of ``longest`` tokens and the binary digits of
the rest, largest first: 5,000 tokens become 2048, 2048, 512, 256, 128, 8.  Every piece is a
sequence of its own, so no sequence crosses documents and none needs padding; sequences of equal
length form a bucket, and a training batch is drawn from one bucket.

Nothing is shuffled.  Sequence ids are numbered by the task that makes them: the bucket in the
top bits, then the task, then a running number, so a bucket is one range of ids and a task that
is run again after a lost executor hands out the same ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from busloom.llm.bpe import byte_letters
from busloom.llm.common import pairs_of, to_batches

LONGEST = 2048
END_ID = 1
CACHED_WORDS = 400_000
CACHED_LENGTH = 48
BUCKET_BITS, TASK_BITS = 59, 34

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])

#: Characters for which splitting at white space first can't change what the tokenizer does:
#: no combining marks, no control characters, no case rule that looks at neighbours.
_NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
#: The tokenizer's split pattern for lower-case texts of such characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W0-9²³¹¼½¾_]+|[0-9²³¹¼½¾]|(?:[^\s\w]|_)+")


class _Kept(dict):
    """Bytes by text, made on first use; two generations, so that what is frequent outlives a full cache."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= CACHED_LENGTH:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def encoded(tokenizer: Tokenizer, text: str) -> bytes:
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def plain_tokenizer(definition: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never looks across it.

    Words (what lies between blanks) and their pieces are looked up in bounded caches; a new piece
    is merged by the tokenizer's own model.  Texts with other characters than Latin-1 letters, ASCII
    and blanks, or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, definition: str, cached_words: int = CACHED_WORDS):
        self.tokenizer = plain_tokenizer(definition)
        self.model = self.tokenizer.model
        self.letter_of = {value: letter for letter, value in byte_letters().items()}
        self.pieces = _Kept(self._piece, cached_words // 2)
        self.words = _Kept(self._word, cached_words)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letter_of)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))

    def ids(self, text: str) -> bytes:
        if "<|" in text or _NOT_PLAIN.search(text):
            return encoded(self.tokenizer, text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Full pieces, then the powers of two of the rest, largest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_file: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Input: doc_id and text; other columns are ignored.  A null or empty text is one piece that
    holds ``end_id`` alone.  A null doc_id stays null.  Repeated rows are packed each on their
    own.  An empty table gives no pieces.  ``longest`` is a power of two.  The tokenizer is
    handed to the executors as its definition (a vocabulary file, a few megabytes at most).
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(definition.value)
        task = TaskContext.get().partitionId()
        numbers: dict[int, int] = {}

        def rows() -> Iterator[tuple]:
            for doc_id, text in pairs_of(batches, "doc_id", "text"):
                ids = words.ids(text or "") + end
                tokens, start = len(ids) // 4, 0
                for length in piece_lengths(tokens, longest):
                    bucket = length.bit_length() - 1
                    number = numbers[bucket] = numbers.get(bucket, -1) + 1
                    yield doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens, bucket << BUCKET_BITS | task << TASK_BITS | number, 0
                    start += length

        yield from to_batches(rows(), PIECES)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences as Parquet, a folder for each length; each task writes its own part of every bucket."""
    pieces.write.partitionBy("length").parquet(path)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
