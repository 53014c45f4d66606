"""Token counts against the tokenizers library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from busloom.llm import token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANDOM = random.Random(9)


def jumble(alphabet, n):
    return "".join(RANDOM.choice(alphabet) for _ in range(n))


LONG = [
    " ".join(jumble("etaoinshrdlu", RANDOM.randint(1, 12)) for _ in range(3000)),
    jumble(list("ab 'slrevmdt\n\t1.é_!²🙂日") + ["'ll", "''s", "  ", "<|endoftext|>", "<|endof", "|>"], 9000),
    jumble(["'", "'s", "'re", "'ve", "s", "re", " "], 9000),
    "<|endoftext|>" * 700,
    " " * 5000 + "x" + "\n" * 3000,
    "a" * 9000,
    "x " * 100 + "a" * 7001 + " ends." * 300,
    jumble("etaoinshrdlu", 12_000),
    jumble("日本語テキスト処理 。", 5000),
    jumble("!?.,'-", 8000),
    jumble("0123456789", 8000),
    "é" * 4097,
]
SHORT = ["", " ", "it's we'll", "<|endoftext|>x<|endoftext|>", "🙂" * 20, " the" * 1024, " the" * 1025]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.ByteTokenizer(open(BYTE, encoding="utf-8").read())


def test_chunks_cover_the_text_and_overlap():
    for text in (*LONG, ""):
        data = text.encode()
        for chunk, overlap in ((1000, 300), (64, 32), (4096, 7)):
            found = list(token_counts.chunks((data[i : i + 90] for i in range(0, len(data), 90)), chunk, overlap))
            assert [x[2] for x in found] == [False] * (len(found) - 1) + [True]
            end = 0
            for start, part, _ in found:
                assert data[start : start + len(part)] == part and len(part) <= chunk
                part.decode()
                assert start <= end and (start == 0 or overlap <= end - start <= overlap + 3)
                end = start + len(part)
            assert end == len(data)


def test_every_common_border_is_a_right_splice(library, tokenizer):
    """Not only the one that is used: any usable border that two chunks share gives the whole text's count."""
    splices = 0
    for text in LONG:
        data = text.encode()[:9000].decode("utf-8", "ignore").encode()
        whole = len(library.encode(data.decode(), add_special_tokens=False).ids)
        for cut, overlap in ((1500, 700), (3000, 900), (4001, 1200), (5000, 650)):
            end = cut - next(k for k in range(4) if data[cut - k] & 0xC0 != 0x80)
            begin = end - overlap
            begin -= next(k for k in range(4) if data[begin - k] & 0xC0 != 0x80)
            _, at, inside, before = tokenizer.borders(data[:end])
            n, later, later_inside, skipped = tokenizer.borders(data[begin:])
            stable = at <= end - tokenizer.reach
            mine = dict(zip(zip(at[stable].tolist(), inside[stable].tolist()), before[stable].tolist()))
            for where, kind, skip in zip((later + begin).tolist(), later_inside.tolist(), skipped.tolist()):
                if (where, kind) in mine:
                    splices += 1
                    assert mine[where, kind] + n - skip == whole, (text[:20], cut, where)
    assert splices > 3000


@pytest.mark.parametrize(("chunk", "overlap"), [(2000, 600), (1500, 750), (token_counts.CHUNK, token_counts.OVERLAP)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    texts = [*LONG, *SHORT, LONG[0], LONG[0]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, LONG[3]), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("chunk", F.lit(1)).repartition(4)
    found = token_counts.count_tokens(docs, BYTE, chunk=chunk, overlap=overlap).collect()
    expected = []
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_overlaps_are_widened_where_chunks_do_not_meet(spark, tokenizer, monkeypatch):
    text = "x " * 3 + "a" * 7001 + " and so on" * 300
    assert len(set(np.diff(tokenizer.borders(b"a" * 400)[1]).tolist())) <= 2  # long equal tokens: no common border if out of step
    asked = []
    recut = token_counts._recut
    monkeypatch.setattr(token_counts, "_recut", lambda cut, chunk, overlap: asked.append((chunk, overlap)) or recut(cut, chunk, overlap))
    docs = spark.createDataFrame([(1, text), (2, text + "!")], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE, chunk=1000, overlap=450).collect()}
    real = Tokenizer.from_file(BYTE)
    assert found == {1: len(real.encode(text).ids), 2: len(real.encode(text + "!").ids)}
    assert asked and asked[0] == (8000, 3600)


def test_empty_table_and_other_tokenizers(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, BYTE).collect() == []
    with pytest.raises(ValueError):
        token_counts.ByteTokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    with pytest.raises(ValueError):
        token_counts.count_tokens(none, BYTE, chunk=100, overlap=51)


def test_words_are_the_library_s(tokenizer):
    split = tokenizer.library.pre_tokenizer.pre_tokenize_str
    texts = [f"a{c}b {c} {c}1{c}!{c}{c}a\n{c}'{c}s'{c}re {c}\n {c}" for c in map(chr, range(0x250))]
    texts += [jumble(list("ab 'slrevmdtLéß²ª\n\t\r\f\v\x1c\x85\xa01½.!_-×÷ɏ\x00") + ["'ll", "'S", "''s", "  "], 4000) for _ in range(20)]
    for text in texts:
        assert token_counts.WORD.findall(text) == [text[a:b] for _, (a, b) in split(text)]


def test_a_word_is_encoded_once(library, monkeypatch):
    fresh = token_counts.ByteTokenizer(open(BYTE, encoding="utf-8").read())
    texts = [jumble(list("ab 'slrevmdté\n\x1c\x85\xa01.!_²") + ["'ll", "''s", "  "], 3000) for _ in range(40)] + SHORT + LONG
    expected = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert fresh.counts(texts) == expected
    asked = []
    whole, learn = fresh.whole, fresh._learn
    monkeypatch.setattr(fresh, "whole", lambda x: asked.extend(x) or whole(x))
    monkeypatch.setattr(fresh, "_learn", lambda x: asked.extend(x) or learn(x))
    assert fresh.counts(texts) == expected
    assert asked == [t for t in texts if "<|endoftext|>" in t or not t.isascii() and max(t) > "ɏ"]
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 100)
    assert fresh.counts(texts + texts[::-1]) == expected + expected[::-1]


def test_borders_of_short_words_are_the_library_s(tokenizer, monkeypatch):
    text = " ".join(jumble("etaoinshrdluéñ", RANDOM.randint(1, 6)) for _ in range(3000)) + "\n\n it's  100."
    quick = tokenizer.borders(text.encode())
    monkeypatch.setattr(tokenizer, "words", lambda text: None)
    plain = tokenizer.borders(text.encode())
    assert quick[0] == plain[0] and all(np.array_equal(a, b) for a, b in zip(quick[1:], plain[1:], strict=True))
