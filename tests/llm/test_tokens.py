"""Packing and BPE against the tokenizers library, and the packing's rules."""

import hashlib
import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from busloom.llm import bpe, packing

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
RANDOM = random.Random(5)
TEXTS = [
    "", " ", "  a  b\n\n c", "it's we'll 've 'r e don't<|endoftext|>x<|startoftext|>y", "日本語テキスト x", "é é ΑΣ σς İ ſ", "ﬁ Å ½ ㎏",
    "\x1c a\x1d b\x85c\xa0d　e", "a" * 5000, "ab" * 3000 + " the" * 10, "²³½ ½a 1²3 _a_ __ a_b", "🙂🙂 x👩‍👩‍👧", "​­ x\xadx", "tab\t\tx\r\n\r\n y",
    "<|ENDOFTEXT|> <|endoftext|>", "'S 'LL it'S", "x" * 30 + "é" * 2000 + "'ll",
    "".join(RANDOM.choice("etaoinshrdlu") for _ in range(20_000)),
    *("".join(RANDOM.choice("ab 'sltrevmd\n\t1.é_!²") for _ in range(120)) for _ in range(60)),
    *("".join(RANDOM.choice("the and ing tion") for _ in range(1500)).replace(" ", "") for _ in range(4)),
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def numbers(data):
    out = array("I")
    out.frombytes(data)
    return out.tolist()


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(open(BYTE, encoding="utf-8").read(), cached_pieces=50)


def test_word_ids_equal_the_library_with_a_tiny_cache():
    words, real = packing.WordTokenizer(open(WORD, encoding="utf-8").read(), cached_words=20), library(WORD)
    for text in TEXTS:
        assert numbers(words.ids(text)) == ids_of(real, text), text[:50]


@pytest.mark.parametrize("window", [1, 2, 3, 17, 100])
def test_small_windows_change_no_id(coder, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe, "STEP", 64)
    real = library(BYTE)
    for text in TEXTS[:20]:
        text = text[:6000]
        ids, decoded = coder.round_trip(text)
        assert numbers(ids) == ids_of(real, text), text[:50]
        assert decoded == real.decode(numbers(ids), skip_special_tokens=False)


def test_memory_does_not_grow_with_the_text(coder):
    """What is held beside the text and its ids: a window's pieces, or a long piece's lookahead."""
    import tracemalloc

    def peak(text):
        coder.cache.clear(), coder.older.clear()
        tracemalloc.start()
        total = sum(len(step) for step in coder.encode_steps(text))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total
        return most

    for unit in ("some words that come again, 12 times; ", "abcdefg"):
        short, long = peak(unit * 20_000), peak(unit * 200_000)
        assert long < 1.2 * short + 200_000


def test_byte_ids_and_decoding_equal_the_library(coder):
    real = library(BYTE)
    for text in TEXTS:
        ids = coder.encode(text)
        assert numbers(ids) == ids_of(real, text), text[:50]
        assert coder.decode(ids) == real.decode(numbers(ids), skip_special_tokens=False)


def test_decoding_ids_that_break_characters(coder):
    real = library(BYTE)
    for _ in range(200):
        ids = [RANDOM.randrange(50_257) for _ in range(RANDOM.randrange(40))]
        assert coder.decode(array("I", ids).tobytes()) == real.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("step", [1, 7, 300, 4096])
def test_streaming_emits_the_tokens_of_the_whole(coder, step):
    for text in ("a" * 2500, "é" * 900, TEXTS[17][:6000], TEXTS[-1]):
        data = text.encode()
        streamed = list(coder.stream(data[i : i + step] for i in range(0, len(data), step)))
        assert [t for ids in streamed for t in ids] == coder.merge(data)
        if step < 100 and len(data) > 3 * coder.lookahead:
            assert sum(map(len, streamed[:-1])) > 0  # tokens came out before the end


def test_lookahead_by_hand():
    # (b, c) can undo (a, b) only if it ranks first: with (a, b) first nothing right of b matters to a.
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c")]) == 1
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_lookahead_suffices_for_random_vocabularies():
    for _ in range(60):
        letters, merges, known = list("abc"), [], list("abc")
        while len(merges) < 8:
            pair = RANDOM.choice(known), RANDOM.choice(known)
            if pair[0] + pair[1] not in known:
                merges.append(pair)
                known.append(pair[0] + pair[1])
        vocabulary = {letter: i for i, letter in enumerate([*bpe.byte_letters()] + [k for k in known if k not in letters])}
        import json

        small = bpe.ByteBpe(json.dumps({"model": {"vocab": vocabulary, "merges": [list(m) for m in merges]}, "added_tokens": []}))
        for _ in range(20):
            data = "".join(RANDOM.choice(letters) for _ in range(80)).encode()
            assert [t for ids in small.stream(data[i : i + 1] for i in range(len(data))) for t in ids] == small.merge(data)


def test_piece_lengths():
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert packing.piece_lengths(2048) == [2048] and packing.piece_lengths(1) == [1]
    assert all(sum(packing.piece_lengths(n, 64)) == n for n in range(1, 300))


ROWS = [(1, TEXTS[3], "en", 7), (2, None, None, 7), (None, "no id", "x", 8), (3, "", "en", 9), (4, TEXTS[17], "en", 1), (4, TEXTS[17], "en", 1)]
DDL = "doc_id long, text string, length string, sequence_id int"


def test_packing_covers_every_id_once(spark):
    real = library(WORD)
    rows = packing.pack(spark.createDataFrame(ROWS, DDL), WORD, longest=256).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    expected = sorted((str(d), ids_of(real, t or "") + [1]) for d, t, *_ in ROWS)
    docs = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        assert r.length & (r.length - 1) == 0 and r.length <= 256 and len(r.ids) == 4 * r.length
        docs.setdefault(str(r.doc_id), []).append(r)
    for name, ids in expected:
        copies = sum(1 for n, _ in expected if n == name)
        found = sorted((r.start, numbers(r.ids)) for r in docs[name])
        assert [x for _, part in found[::copies] for x in part] == ids
        assert {r.doc_tokens for r in docs[name]} == {len(ids)}
    digests = packing.piece_digests(packing.pack(spark.createDataFrame(ROWS, DDL), WORD, longest=256)).collect()
    by_id = {r.sequence_id: r.ids for r in rows}
    assert all(d.ids_crc32 == zlib.crc32(by_id[d.sequence_id]) for d in digests)


def test_buckets_and_empty_table(spark, tmp_path):
    packing.write_buckets(packing.pack(spark.createDataFrame(ROWS, DDL), WORD), f"{tmp_path}/buckets")
    lengths = {p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()}
    assert lengths and lengths <= {f"length={1 << i}" for i in range(12)}
    assert packing.pack(spark.createDataFrame([], DDL), WORD).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DDL), WORD, longest=100)


def test_round_trip_digests(spark):
    real = library(BYTE)
    rows = bpe.round_trip_digests(bpe.round_trip(spark.createDataFrame(ROWS, DDL), BYTE)).collect()
    expected = []
    for doc, text, *_ in ROWS:
        ids = ids_of(real, text or "")
        decoded = real.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert bpe.round_trip(spark.createDataFrame([], DDL), BYTE).count() == 0
