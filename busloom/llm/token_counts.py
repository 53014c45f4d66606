"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced where both agree.

A text of up to ``chunk`` bytes is encoded at once.  A longer one is cut into chunks, each of which begins
``overlap`` bytes before the one before it ends; the chunks of all documents are dealt to the cluster, so a huge
document is many small pieces of work.  Every chunk reports the borders between its tokens, with byte offsets, in both
overlaps.

*Where two chunks may be spliced.*  Splitting into words looks only ahead (a character, or a special token's string), and
merging inside a word cannot cross a border that the finished word has.  So tokens from a border on
depend on the text from there on alone, if the border is one of the whole text.  A border of the
earlier chunk is, if it lies further from that chunk's end than anything still unread can reach: the merge list's
sufficient lookahead, or a special token's string.  If the later chunk has the same border, and both have it between two
words, or both inside a word that began at least ``INSIDE`` bytes before (then it is the same kind of word for both,
whatever its beginning was), both go on with the same tokens.  The text's count is the last chunk's tokens
plus, for every splice, the earlier chunk's tokens before it minus the later one's.

*Words.*  A word's tokens depend on the word alone, so in texts of the characters that ``WORD`` is proven for (tests compare it with
the library's split) the library encodes each different word once and its number of tokens is looked up from then on.  Other texts, and those with a
special token's string, are encoded whole.

*Widening.*  Documents with an overlap that holds no such border are cut anew from their chunks, with chunks and
overlaps ``WIDER`` times as long, until there is one; a document that fits one chunk needs none.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from busloom.functions.reuse import written_once
from busloom.llm.bpe import byte_letters, sufficient_lookahead
from busloom.llm.common import pairs_of, to_batches

LIMIT = 1024
CHUNK = 32 << 10
OVERLAP = 2 << 10
WIDER = 8
INSIDE = 16
BATCH = 1 << 20  # bytes of short texts that are encoded in one call
MEMO_CHARS = 8 << 20  # letters of the words whose counts a worker keeps; beyond, it begins anew

# The library's split into words, for texts below U+0250: letters, digits and spaces there are the same in every Unicode version.
_LETTER, _DIGIT, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
WORD = re.compile(f"'(?:[sdmt]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
OTHER = re.compile("[^\0-\u024f]")

CUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
    ("doc", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("data", pa.binary())])
CUT_DDL = "doc_id long, n_bytes long, n_tokens long, doc string, chunk long, last boolean, start long, data binary"
BORDERS_DDL = (
    "doc_id long, n_bytes long, doc string, chunk long, last boolean, tokens long,"
    " head array<long>, head_at array<long>, tail array<long>, tail_at array<long>")
BORDERS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("doc", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("tokens", pa.int64()),
    *((name, pa.list_(pa.int64())) for name in ("head", "head_at", "tail", "tail_at"))])


class ByteTokenizer:
    """The library's tokenizer for one definition, with what its splices rest on."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        before, model = parsed["pre_tokenizer"] or {}, parsed["model"]
        added = parsed["added_tokens"]
        known = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and parsed["normalizer"] is None
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(t[flag] for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized")))
        if not known:
            raise ValueError("splices are proven for byte-level BPE without normalizer, prefix space or dropout only")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        letters = byte_letters()
        sizes = {i: sum(c in letters for c in token) for token, i in model["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in added}
        self.sizes = np.zeros(max(sizes) + 1, np.int64)
        self.sizes[list(sizes)] = list(sizes.values())
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Four bytes are the character that follows a word.
        self.reach = max([sufficient_lookahead(merges), *(len(t["content"].encode()) for t in added)]) + 4
        self.special = [t["content"] for t in added]
        self.memo: dict[str, int] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[int]:
        """Tokens of each text as the library encodes it."""
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str) -> list[str] | None:
        """The text's words, with their counts in ``memo``; none for a text that has to be encoded whole."""
        if OTHER.search(text) or any(s in text for s in self.special):
            return None
        words = WORD.findall(text)
        seen = set(words)
        if new := [w for w in seen if w not in self.memo]:
            if self.held > MEMO_CHARS:
                self.memo, self.held, new = {}, 0, list(seen)
            self._learn(new)
        return words

    def _learn(self, new: list[str]) -> None:
        """Counts of new words: those that don't begin or end with a line break are encoded as the lines of one text."""
        lines, rest = [], []
        for word in new:
            (rest if word.isspace() else lines).append(word)
        ids = np.array(self.library.encode("\n".join(lines), add_special_tokens=False).word_ids, np.int64)
        counts = np.bincount(ids)[::2].tolist() if len(ids) and ids[-1] == 2 * len(lines) - 2 else self.whole(lines)
        self.memo.update(zip(lines, counts, strict=True))
        self.memo.update(zip(rest, self.whole(rest), strict=True))
        self.held += sum(map(len, new))

    def counts(self, texts: list[str]) -> list[int]:
        split = [None if words is None else sum(map(self.memo.__getitem__, words)) for words in map(self.words, texts)]
        others = iter(self.whole([t for t, n in zip(texts, split, strict=True) if n is None]))
        return [next(others) if n is None else n for n in split]

    def borders(self, data: bytes, longest: int = INSIDE) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """How many tokens a chunk has; its usable borders: byte offsets, whether inside a word, tokens before.

        If no word is longer than ``longest`` bytes, borders between words may be all.
        """
        text = data.decode("utf-8", "replace")
        if (words := self.words(text)) is not None:
            sizes = np.array([len(w.encode()) for w in words], np.int64)
            if sizes.max(initial=0) <= longest:
                at, before = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, np.array([self.memo[w] for w in words], np.int64)))
                return int(before[-1]), at, np.zeros(len(at), bool), before
        found = self.library.encode(text, add_special_tokens=False)
        at = np.concatenate([[0], np.cumsum(self.sizes[found.ids])])
        word = np.array(found.word_ids, np.int64)
        inside = np.concatenate([[False], word[1:] == word[:-1], [False]])
        begun = np.maximum.accumulate(np.where(inside, 0, at))  # where the word at a border began
        usable = ~inside | (at - begun >= INSIDE)
        return len(found), at[usable], inside[usable], np.flatnonzero(usable)


@lru_cache(maxsize=1)
def tokenizer_of(definition: str) -> ByteTokenizer:
    """A Python worker's tokenizer, which its tasks share."""
    return ByteTokenizer(definition)


def chunks(parts: Iterable[bytes], chunk: int, overlap: int) -> Iterator[tuple[int, bytes, bool]]:
    """Start, bytes and whether it is the last, of the chunks of a text (UTF-8) that arrives in parts.

    Chunks begin and end between characters.  What is held is a chunk and a part.
    """
    held, start = b"", 0

    def between(at: int) -> int:
        while held[at] & 0xC0 == 0x80:
            at -= 1
        return at

    for part in parts:
        held += part
        while len(held) > chunk:
            end = between(chunk)
            yield start, held[:end], False
            begin = between(end - overlap)
            start, held = start + begin, held[begin:]
    yield start, held, True


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    return (data[at : at + size] for at in range(0, len(data), size))


def _cut(docs: DataFrame, definition, chunk: int, overlap: int) -> DataFrame:
    """A row with its count for each short document, a row per chunk for each long one; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(definition.value)
        empty = (None,) * 5

        def counted(short: list[tuple[int | None, bytes]]) -> Iterator[tuple]:
            for (doc_id, text), n in zip(short, tokenizer.counts([t.decode("utf-8", "replace") for _, t in short]), strict=True):
                yield doc_id, len(text), n, *empty

        def rows() -> Iterator[tuple]:
            short, size = [], 0
            for doc_id, text in pairs_of(batches, "doc_id", "text"):
                if len(text) <= chunk:
                    short.append((doc_id, text))
                    size += len(text)
                    if size >= BATCH or len(short) >= 4096:
                        yield from counted(short)
                        short, size = [], 0
                else:
                    name = uuid4().hex  # ids may be null or repeated
                    for number, (start, data, last) in enumerate(chunks(_slices(text, chunk), chunk, overlap)):
                        yield doc_id, len(text), None, name, number, last, start, data
            yield from counted(short)

        yield from to_batches(rows(), CUT)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return written_once(texts.mapInArrow(run, CUT_DDL), "cut")


def _recut(cut: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The documents of ``cut`` in longer chunks, put together as their old chunks pass by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = pairs_of(batches, "doc", "start", "data", "doc_id", "n_bytes")
        ahead = next(old, None)

        def parts(doc: str) -> Iterator[bytes]:
            nonlocal ahead
            end = 0
            while ahead is not None and ahead[0] == doc:
                _, start, data, *_ = ahead
                yield data[end - start :]
                end = start + len(data)
                ahead = next(old, None)

        def rows() -> Iterator[tuple]:
            while ahead is not None:
                doc, _, _, doc_id, n_bytes = ahead
                for number, (start, data, last) in enumerate(chunks(parts(doc), chunk, overlap)):
                    yield doc_id, n_bytes, None, doc, number, last, start, data

        yield from to_batches(rows(), CUT)

    return written_once(cut.repartition("doc").sortWithinPartitions("doc", "chunk").mapInArrow(run, CUT_DDL), "recut")


def _borders(cut: DataFrame, definition, overlap: int) -> DataFrame:
    """Every chunk's tokens, and its usable borders in both overlaps: where (twice the byte, plus 1 inside a word) and tokens before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(definition.value)

        def rows() -> Iterator[tuple]:
            for doc_id, n_bytes, doc, number, last, start, data in pairs_of(batches, "doc_id", "n_bytes", "doc", "chunk", "last", "start", "data"):
                tokens, at, inside, before = tokenizer.borders(data, max(INSIDE, overlap // 8))
                # An overlap is up to three bytes longer than asked for.
                head = at <= overlap + 3 if number else at < 0
                tail = (at >= len(data) - overlap - 3) & (at <= len(data) - tokenizer.reach) if not last else at < 0
                where = 2 * (start + at) + inside
                yield doc_id, n_bytes, doc, number, last, tokens, where[head].tolist(), before[head].tolist(), where[tail].tolist(), before[tail].tolist()

        yield from to_batches(rows(), BORDERS)

    # Chunks of one document lie side by side in the table; dealt evenly, a long one is many tasks' work.
    spread = cut.select("doc_id", "n_bytes", "doc", "chunk", "last", "start", "data").repartition("doc", "chunk")
    return written_once(spread.mapInArrow(run, BORDERS_DDL), "borders")


def _spliced(borders: DataFrame) -> DataFrame:
    """doc, doc_id, n_bytes, n_tokens of every document; n_tokens is null if one of its overlaps has no common border."""
    after = borders.select("doc", (F.col("chunk") - 1).alias("chunk"), "head", "head_at")
    met = borders.drop("head", "head_at").join(after, ["doc", "chunk"], "left").withColumn("met", F.array_min(F.array_intersect("tail", "head")))
    before = F.try_element_at("tail_at", F.array_position("tail", F.col("met")).cast("int"))
    skipped = F.try_element_at("head_at", F.array_position("head", F.col("met")).cast("int"))
    share = met.select("doc", "doc_id", "n_bytes", F.when(F.col("last"), F.col("tokens")).when(F.col("met").isNotNull(), before - skipped).alias("share"))
    return share.groupBy("doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        F.when(F.count("*") == F.count("share"), F.sum("share")).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``): a row for every row, from its whole text.

    Input: doc_id and text; other columns are ignored.  ``tokenizer_file`` defines a byte-level BPE
    tokenizer; counts are the tokenizers library's for the whole text, without added tokens, with special tokens'
    strings read as such.  A null text counts as empty: 0 bytes, 0 tokens.  Rows are independent, so repeated
    rows and null ids pass; an empty table gives no rows.  ``overlap`` is at most half of ``chunk``.  The vocabulary
    definition (a few megabytes) is broadcast.  Texts are read, and huge ones cut, while the frame is built; memory is
    that of a row of ``docs`` and a chunk, and where chunks had to be widened, of a chunk that spans the stretch without a
    common border.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("an overlap is more than nothing and at most half of a chunk")
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    cut = _cut(docs, definition, chunk, overlap)
    done = [cut.where("doc IS NULL").select("doc_id", "n_bytes", "n_tokens")]
    pending = cut.where("doc IS NOT NULL")
    while True:
        spliced = written_once(_spliced(_borders(pending, definition, overlap)), "spliced")
        done.append(spliced.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens"))
        apart = spliced.where("n_tokens IS NULL").select("doc")
        if apart.isEmpty():
            break
        chunk, overlap = chunk * WIDER, overlap * WIDER
        pending = _recut(pending.join(apart, "doc", "left_semi"), chunk, overlap)
    return reduce(DataFrame.unionByName, done).withColumn("over_limit", F.col("n_tokens") > limit)
