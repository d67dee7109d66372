import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pointloom.llm import packing, tokens

ALPHABET = [*"abcABC  \t\n\x0b\x0c\r\x1c\x85  'sdlv019.,!?-_é́̈̌JΣςσİß中文", "<|endoftext|>", "<|startoftext|>", "'ll", "'re"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("chunk,overlap", [(64, 40), (100, 64), (300, 33)])
def test_spliced_ids_are_the_librarys(name, chunk, overlap):
    memo, pick, spliced = tokens.encoder(tokens.vocabulary(name)), random.Random(chunk), 0
    for n in range(150):
        alphabet = ALPHABET if n % 3 else [*"abc de fg. hi, jk 0 ab's", "we'll ", "  ", "\u00e9 ", "<|endoftext|>"]
        text = "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 500)))
        got = np.frombuffer(tokens.document_ids(text, memo, chunk, overlap), "<u4").tolist()
        assert got == memo.encode(text)
        spliced += n_chunks(text, memo, chunk, overlap) > 1
    assert spliced > (50 if name.endswith("json") else 20 if chunk > 64 else -1)  # pieces are up to 16 long, so margins take most of an overlap of 40


def n_chunks(text, memo, chunk, overlap):
    """Chunks that were spliced, counted by the boundaries found."""
    found, own = [], tokens.boundary

    def seen(*args):
        found.append(own(*args))
        return found[-1]

    tokens.boundary = seen
    try:
        tokens.document_ids(text, memo, chunk, overlap)
    finally:
        tokens.boundary = own
    return 1 + sum(x is not None for x in found)


def test_overlaps_widen_until_a_boundary_is_proven():
    memo = tokens.encoder(tokens.vocabulary())
    text = "word " * 40 + "a" * 700 + " more words " * 60
    assert np.frombuffer(tokens.document_ids(text, memo, 100, 40), "<u4").tolist() == memo.encode(text)
    assert n_chunks(text, memo, 100, 40) > 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_long_documents_of_a_table(spark, name):
    pick = random.Random(4)
    words = ["the", "of", "Caf\u00e9", "x1", "don't", "12,5", "\u4e2d\u6587", "(so)", "<|endoftext|>"]
    rows = [(i, " ".join(pick.choice(words) for _ in range(n))) for i, n in enumerate((0, 3, 900, 4000))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    memo = tokens.encoder(tokens.vocabulary(name))
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, tokens.vocabulary(name), chunk=2000).collect()}
    assert got == {i: len(memo.encode(text)) for i, text in rows}


def test_batches_of_plain_and_odd_texts(library):
    memo, pick = tokens.encoder(tokens.vocabulary()), random.Random(1)
    rows = ["".join(pick.choice(ALPHABET + list("abcdefghiéÀÑü.,;%&*#") * 4) for _ in range(pick.randint(0, 60))) for _ in range(600)] + [None]
    got = [np.frombuffer(ids, "<u4").tolist() for _, ids in tokens.batch_ids(pa.array(rows), memo)]
    assert got == [library.encode(x or "", add_special_tokens=False).ids for x in rows]


def test_plain_texts_are_cut_as_the_pre_tokenizer_does(library):
    memo, pick = tokens.encoder(tokens.vocabulary()), random.Random(6)
    alphabet = [*"abcxyz0123456789éßÿžñ .,!-+\t\n\r\x0b\x0c", "  ", "word ", "année "]
    rows = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 80))) for _ in range(400)] + ["", " ", "\n", "a"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.plain_ids([x.encode() for x in rows], memo)]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in rows]
    assert tokens.plain_ids([], memo) == []


def test_full_memo_keeps_what_comes_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 60)
    memo, learned = tokens.Memo(tokens.vocabulary()), []
    own = memo.learn
    monkeypatch.setattr(memo, "learn", lambda parts: (learned.extend(parts), own(parts)))
    common = ["the", "of", "and"]
    for n in range(12):
        rows = [" ".join([*common, *("".join(pick) for pick in zip("abcdefghij", "klmnopqrst" * 2, chr(97 + n) * 10))])]
        got = [np.frombuffer(ids, "<u4").tolist() for _, ids in tokens.batch_ids(pa.array(rows), memo)]
        assert got == [library.encode(x, add_special_tokens=False).ids for x in rows]
    assert len(learned) == 123 and all(learned.count(x) == 1 for x in common) and len(memo.parts) <= 60 + 13


def test_long_text_without_white_space(library):
    memo, text = tokens.encoder(tokens.vocabulary()), "a" * 3000 + "." * 50 + "é" * 1000
    assert len(tokens.document_ids(text, memo, 64, 8)) // 4 == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_and_edge_rows(spark, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (2, ""), (3, "x " * 3000)]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id bigint, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect())
    assert got == [(0, 0, 0, False), (1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (3, 6000, 3000, True)]
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_sentencepiece_model(spark):
    model = tokens.vocabulary("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "Hello world")], "doc_id bigint, text string")
    import sentencepiece

    want = len(sentencepiece.SentencePieceProcessor(model_file=model).encode("Hello world"))
    assert tokens.count_tokens(df, model).first().n_tokens == want


def test_packing_is_a_partition_into_powers(spark, library):
    rows = [(1, "w " * 5000), (2, ""), (3, None), (4, "some words here"), (4, "some words here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = packing.pack(df, with_ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in out)
    import zlib

    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    for doc, text in rows[:4]:
        own = sorted((r.start, r.ids) for r in out if r.doc_id == doc)
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        ids = [x for _, piece in own for x in piece]
        assert ids == want if doc != 4 else sorted(ids) == sorted(want * 2)
        assert all(r.doc_tokens == len(want) for r in out if r.doc_id == doc)
    assert packing.lengths(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.lengths(0) == []
    assert packing.pack(df.limit(0)).count() == 0


def test_encoders_go_when_a_worker_serves_others():
    from pointloom.llm.common import released

    memo = tokens.encoder(tokens.vocabulary())
    list(released(iter, tokens.USES)(iter([])))
    assert tokens.encoder(tokens.vocabulary()) is memo
    list(released(iter)(iter([])))
    assert not tokens._encoders
    assert tokens.encoder(tokens.vocabulary()) is not memo
