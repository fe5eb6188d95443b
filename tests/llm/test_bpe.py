import random

import public_tokenizers
import pytest
import tiktoken

from logloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(5)
    for _ in range(400):
        yield "".join(rnd.choice("abcdetionsh  \n\t.,'") for _ in range(rnd.randint(0, 80)))
        yield "".join(chr(rnd.choice([rnd.randint(0, 127), rnd.randint(128, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(25))
        yield rnd.choice("a =-_!\n") * rnd.randint(1, 300)
        yield "".join(rnd.choice(["ing", "tion", "the", "er", "####", "  ", "====", "zzz"]) for _ in range(25))


def test_encodes_as_the_library_and_decodes_back(codec, reference):
    for t in texts():
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert codec.decode(ids) == t


def test_the_transducer_emits_before_the_end_and_forgets_without_harm():
    small = bpe.Transducer(bpe.read_ranks(PATH), max_states=50)
    big = bpe.Transducer(bpe.read_ranks(PATH))
    data = ("abstraction-" * 40).encode()
    seen = []

    def feed():
        for i, b in enumerate(data):
            seen.append(i)
            yield b

    first = next(iter(big.stream(feed())))
    assert len(seen) < 200 and first in big.tokens
    assert list(small.stream(data)) == list(big.stream(data)) == big.by_merging(data)[0]


def test_every_piece_takes_one_path_whatever_is_remembered():
    ranks = bpe.read_ranks(PATH)
    big, small = bpe.Transducer(ranks), bpe.Transducer(ranks, max_states=3)
    rnd = random.Random(9)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abcdeinrst=-") for _ in range(rnd.randint(1, 70)))
        want = big.by_merging(piece)[0]
        assert list(big.stream(piece, keep=0)) == list(big.stream(piece, keep=2)) == list(small.stream(piece)) == want


def test_utf8_machine_in_portions_as_the_decoder_of_the_language():
    rnd = random.Random(3)
    odd = [0x41, 0x80, 0xBF, 0xC0, 0xC2, 0xE0, 0xA0, 0x9F, 0xED, 0xEF, 0xF0, 0x90, 0x8F, 0xF4, 0xF5, 0xFF]
    for body in ["aé€😀z".encode(), b"", *(bytes(rnd.choice(odd) for _ in range(rnd.randint(1, 12))) for _ in range(5000))]:
        s, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(body):
            n = rnd.randint(1, 4)
            out, at = out + s.feed(body[at : at + n]), at + n
        assert out + s.close() == body.decode("utf-8", "replace")
    assert bpe.Utf8Stream().feed(b"\xe2\x82") == ""


@pytest.mark.parametrize("max_moves", [1, 3, 10_000])
def test_decoding_of_any_ids(max_moves):
    tokens = dict(enumerate([b"a", b"\xe2", b"\x82", b"\xac", b"\xe2\x82", b"\xacz\xf0\x9f", b"\x98\x80", b"\xff"]))
    d = bpe.Decoder(tokens, max_moves)
    rnd = random.Random(1)
    for _ in range(500):
        ids = [rnd.randrange(len(tokens)) for _ in range(rnd.randint(0, 9))]
        assert "".join(d.stream(ids)) == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def test_paths_of_a_long_piece_are_followed_once_for_each_emission(monkeypatch):
    t = bpe.Transducer(bpe.read_ranks(PATH))
    piece = b"=" * 300
    calls, path = [], t._path
    monkeypatch.setattr(t, "_path", lambda lasts, end: calls.append(end) or path(lasts, end))
    ids = list(t.stream(piece))
    assert ids == t.by_merging(piece)[0]
    assert len(calls) <= len(ids) + 1


def test_a_piece_in_use_is_not_forgotten(monkeypatch):
    c = bpe.Codec(PATH, public_tokenizers.PATTERN, max_pieces=8)
    made, encode = [], c.transducer.encode
    monkeypatch.setattr(c.transducer, "encode", lambda piece: made.append(piece) or encode(piece))
    for i in range(200):
        c.encode(f"zqzq {i}xx")
    assert made.count(b"zqzq") == 1
    assert len(c.pieces) + len(c.earlier) <= 8


@pytest.mark.parametrize("max_moves", [1, 3, 10_000])
def test_text_of_any_ids_as_the_stream(max_moves):
    tokens = dict(enumerate([b"a", b"\xe2", b"\x82", b"\xac", b"\xe2\x82", b"\xacz\xf0\x9f", b"\x98\x80", b"\xff", b"bc"]))
    d = bpe.Decoder(tokens, max_moves)
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.choice([0, 8, rnd.randrange(len(tokens))]) for _ in range(rnd.randint(0, 12))]
        assert d.text(iter(ids)) == "".join(d.stream(ids)) == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def test_documents_nulls_and_empty_table(spark, sf, reference):
    docs = spark.createDataFrame([(1, "the cat", "x"), (2, None, "y"), (3, "", "z"), (1, "the cat", "x")], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.n_tokens) for r in rows.collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    back = bpe.decode_documents(rows, PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "the cat"), (1, "the cat"), (2, ""), (3, "")]
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in bpe.encode_documents(d, PATH, public_tokenizers.PATTERN, outputs=("n_tokens", "decoded_sha256")).collect()}
    assert got == {r.doc_id: len(reference.encode_ordinary(r.text)) for r in d.collect()}
