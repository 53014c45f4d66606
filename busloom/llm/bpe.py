"""Byte-level BPE as a streaming transducer, and decoding as a byte-to-text state machine.

*Lookahead.*  Merges are applied by rank, leftmost first, so what follows a position can change
the tokens before it only through a chain of merges of growing rank, each of which overlaps the
left end of the one before.  ``sufficient_lookahead`` finds the longest way, in bytes, that such a
chain can travel to the left (320 for a common vocabulary of 50,000 merges).  A token that ends
further than that from the end of what has been read is final.  It can be emitted, and what
follows it can be merged without it, because no merge ever crosses a final border.  So memory is
bounded by the lookahead and one step of reading, however long a run of letters is.

*Pieces.*  The split pattern cuts a text into pieces that are merged apart.  A text is split window by window,
every piece goes through the transducer, and its ids leave as they become final; the decoder takes them from there.  Short
pieces repeat, so their ids are kept in a bounded cache.  Besides the text itself and what comes out, memory is
a window, the lookahead and the cache.

*Decoding* appends the bytes of each token to an incremental UTF-8 decoder, which holds back at
most three bytes of an unfinished character and replaces what can never become one.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.llm.common import pairs_of, to_batches

CACHED_PIECES = 250_000
CACHED_LENGTH = 48
STEP = 2048
WINDOW = 1 << 16
AHEAD = 3  # the longest contraction
DECODED_TOKENS = 8192

_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split of the byte-level pre-tokenizer, with white space spelled out; and the same for texts
#: of printable Latin-1 and common blanks, where ``re`` knows the classes and is faster.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_NUMBERS = "0-9²³¹¼½¾"
_SPLIT_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W{_NUMBERS}_]+| ?[{_NUMBERS}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")

ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """The most bytes to the left that unread text can still change, for merges in rank order.

    ``reach[s]``: how far a change travels once the border left of a symbol s, the left part of a
    merge, has become uncertain.  A merge (u, v) carries a change on if v starts at that border,
    that is if v, its left part, the left part of that and so on is such an s.
    """
    reach: dict[str, int] = {}
    left_part: dict[str, str] = {}
    most = 0
    for left, right in merges:
        carried, start = 0, right
        while start is not None:
            carried = max(carried, reach.get(start, 0))
            start = left_part.get(start)
        far = len(left) + carried
        reach[left] = max(reach.get(left, 0), far)
        left_part.setdefault(left + right, left)
        most = max(most, far)
    return most


class ByteBpe:
    """Encoder and decoder for one vocabulary definition (JSON text of a byte-level BPE tokenizer)."""

    def __init__(self, definition: str, cached_pieces: int = CACHED_PIECES):
        parsed = json.loads(definition)
        letters = byte_letters()
        vocabulary: dict[str, int] = parsed["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in parsed["model"]["merges"]]
        self.first = [0] * 256
        for letter, value in letters.items():
            self.first[value] = vocabulary[letter]
        self.merged = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.lookahead = sufficient_lookahead(merges)
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.bytes_of.update((i, t.encode()) for t, i in self.special.items())
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached_pieces = cached_pieces

    def merge(self, data: bytes) -> list[int]:
        """Tokens of bytes that are known to their end: the merge of least rank first, leftmost among equals."""
        symbols = [self.first[b] for b in data]
        if len(symbols) <= 24:
            merged = self.merged
            while len(symbols) > 1:
                best, at = None, -1
                for i, pair in enumerate(zip(symbols, symbols[1:])):
                    found = merged.get(pair)
                    if found is not None and (best is None or found[0] < best[0]):
                        best, at = found, i
                if best is None:
                    break
                symbols[at : at + 2] = [best[1]]
            return symbols
        return self._merge_long(symbols)

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = []

        def offer(i: int, j: int) -> None:
            found = self.merged.get((symbols[i], symbols[j]))
            if found is not None:
                waiting.append((found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        heapify(waiting)
        while waiting:
            _, i, left, right, whole = heappop(waiting)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = whole, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    found = self.merged.get((symbols[x], symbols[y]))
                    if found is not None:
                        heappush(waiting, (found[0], x, symbols[x], symbols[y], found[1]))
        return [s for s in symbols if s >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece that arrives in chunks, each emitted once no later byte can change it."""
        held = b""
        for chunk in chunks:
            held += chunk
            if len(held) <= 2 * self.lookahead:
                continue
            stable, end, tokens = len(held) - self.lookahead, 0, []
            for token in self.merge(held):
                size = len(self.bytes_of[token])
                if end + size > stable:
                    break
                tokens.append(token)
                end += size
            held = held[end:]
            yield tokens
        yield self.merge(held)

    def piece(self, text: str) -> bytes:
        """Ids of one piece of the split: from the transducer, or from the cache if it is short."""
        found = self.cache.get(text)
        if found is not None:
            return found
        found = self.older.get(text)
        if found is None:
            data = text.encode()
            found = b"".join(array("I", ids).tobytes() for ids in self.stream(data[i : i + STEP] for i in range(0, len(data), STEP)))
        if len(text) <= CACHED_LENGTH:
            if len(self.cache) >= self.cached_pieces:
                self.older, self.cache = self.cache, {}
            self.cache[text] = found
        return found

    def _long_piece(self, text: str, start: int, end: int) -> Iterator[bytes]:
        """Ids of a piece that is longer than a window, handed out as they become final."""
        for ids in self.stream(text[i : min(i + STEP, end)].encode() for i in range(start, end, STEP)):
            yield array("I", ids).tobytes()

    def _ordinary(self, text: str, start: int, end: int) -> Iterator[bytes]:
        """Ids of ``text[start:end]`` without special tokens, window by window.

        Where a piece begins, the split looks at most ``AHEAD`` characters on to tell its kind, and one beyond its end.  So
        the pieces of a window are those of the whole text but for the last and those that begin close to the end; the
        next window begins with these.
        """
        get, piece = self.cache.get, self.piece
        while start < end:
            window = text[start : min(start + WINDOW, end)]
            found = (_SPLIT if _NOT_PLAIN.search(window) else _SPLIT_PLAIN).findall(window)
            if start + WINDOW < end:
                open_length = 0
                while found and open_length < AHEAD:
                    open_length += len(found.pop())
                if not found:
                    stop = _SPLIT.match(text, start, end).end()
                    yield from self._long_piece(text, start, stop)
                    start = stop
                    continue
                start += len(window) - open_length
            else:
                start = end
            yield b"".join([get(x) or piece(x) for x in found])
            if self.cache is not get.__self__:
                get = self.cache.get

    def encode_steps(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit numbers, some at a time; a special token's string becomes its id."""
        at = 0
        for found in self.special_split.finditer(text) if self.special_split else ():
            yield from self._ordinary(text, at, found.start())
            yield array("I", [self.special[found.group()]]).tobytes()
            at = found.end()
        yield from self._ordinary(text, at, len(text))

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_steps(text))

    def decode_steps(self, steps: Iterable[bytes]) -> Iterator[str]:
        """Text of ids that arrive in steps, special tokens included; bytes that form no character become U+FFFD."""
        machine, look = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__
        for ids in steps:
            numbers = array("I")
            numbers.frombytes(ids)
            yield machine.decode(b"".join(map(look, numbers)))
        yield machine.decode(b"", final=True)

    def decode(self, ids: bytes) -> str:
        size = 4 * DECODED_TOKENS
        return "".join(self.decode_steps(ids[at : at + size] for at in range(0, len(ids), size)))

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text; the decoder is handed the ids as they become final."""
        ids: list[bytes] = []

        def emitted() -> Iterator[bytes]:
            for step in self.encode_steps(text):
                ids.append(step)
                yield step

        decoded = "".join(self.decode_steps(emitted()))
        return b"".join(ids), decoded


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Every text encoded and decoded: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Input: doc_id and text; other columns are ignored.  A null text counts as empty: no tokens,
    empty ids, empty decoded text.  Rows are independent, so repeated rows and null doc_ids simply
    pass; an empty table gives no rows.  Letters and numbers are those of the ``regex`` module's
    Unicode tables.  Nothing is shuffled; the vocabulary definition (a few megabytes) is broadcast.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(definition.value)

        def rows() -> Iterator[tuple]:
            for doc_id, text in pairs_of(batches, "doc_id", "text"):
                ids, decoded = bpe.round_trip(text or "")
                yield doc_id, len(ids) // 4, ids, decoded

        yield from to_batches(rows(), ROUND_TRIP)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
