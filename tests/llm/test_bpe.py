import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.tables import frame
from trialbook.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def cases():
    draw = random.Random(5)
    kinds = ["abcdefgh", "aA1 .'", " \n\t x", "éß漢字😀 ", "'sdrelvmt ", "<|endoftxt>", "0123456789", "=-_ "]
    yield from ["", " ", "\n", "a", "  a", "don't we'll I'LL", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "😀", "\x00\x01"]
    for n in (1, 2, 5, 30, 300):
        for letters in kinds:
            yield "".join(draw.choice(letters) for _ in range(n))
    for run in ("a", " ", "é", "7", "=", "ab", "the", "\n ", "漢"):
        yield run * 20_000
    yield "".join(draw.choice("abcdefghijklmnop") for _ in range(200_000))
    yield "x" + " " * 70_000 + "y" + "-" * 70_000 + "'ll"
    yield "".join(draw.choice(["the ", "of", " ", "ing", "é", "\n", "12", "'s", "<|endoftext|>"]) for _ in range(60_000))


def listed(text, size=bpe.CHUNK):
    table, words, _ = bpe.load(PATH)
    return [t for ids in bpe.encode(table, words, bpe.chunked(text, size)) for t in ids]


def test_ids_and_text_equal_the_library(library):
    table, _, _ = bpe.load(PATH)
    for text in cases():
        expected = library.encode(text, add_special_tokens=False).ids
        assert listed(text) == expected, text[:50]
        assert "".join(bpe.decode(table, [expected])) == library.decode(expected, skip_special_tokens=False)


def test_chunks_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    for text in cases():
        text = text[:3000]
        for size in (1, 7, 64):
            assert listed(text, size) == library.encode(text, add_special_tokens=False).ids


def test_windows_hold_the_lookahead(library):
    table, _, _ = bpe.load(PATH)
    draw = random.Random(9)
    assert 0 < table.lookahead < 4096
    for letters in ("ab", "etaoin", "-=", "a"):
        text = "".join(draw.choice(letters) for _ in range(30_000))
        run = bpe.Run(table)
        run.window = table.lookahead
        assert [t for p in run.feed(text.encode()) for t in p] + run.finish() == table.merged(text.encode())


def test_decoding_in_pieces_equals_decoding_at_once():
    draw = random.Random(3)
    for _ in range(500):
        data = bytes(draw.choice([0x41, 0xC3, 0xA9, 0xE0, 0xA0, 0x80, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(12))
        state = bpe.Utf8()
        cuts = sorted({0, len(data), *(draw.randrange(len(data)) for _ in range(4))})
        found = "".join(state.feed(data[a:b]) for a, b in zip(cuts, cuts[1:])) + state.feed(b"", last=True)
        assert found == data.decode("utf-8", "replace")


def test_rows(spark, library):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "é😀 <|endoftext|>")])
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in [(1, "a b"), (1, "a b"), (2, ""), (3, ""), (None, "é😀 <|endoftext|>")]:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    both = bpe.decode_column(bpe.encode_column(docs, PATH), PATH).collect()
    assert {(r["text"] or "") for r in both} == {r["decoded"] for r in both}
    again = bpe.encode_column(bpe.encode_column(docs, PATH), PATH)
    assert again.columns.count("token_ids") == 1
