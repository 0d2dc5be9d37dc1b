import random

import pyarrow as pa
import pytest

from tessera.llm import cut_encoder as C
from tessera.llm.queries import tokenizer_file
from tessera.llm.words import chunks, utf8
from tests.llm.test_token_output import library

PARTS = ["a", "B", "z", " ", "  ", "\n", "\t", "'s", "'", "'ll", "1", "23", ".", ",", "!?", "\u00e9", "\u00df", "\u00d7", "\u00f7", "a\u0300", "\xa0", "\u2003", "\u201c", "\u6f22", "\u5b57", "\U0001f600", "\x85",
         "\u200d", "\u00c3", "\r\n", "\x00", "\x7f", "<|", "endoftext", "|>", "<|endoftext|>", "<|startoftext|>", "\u0663", "_", "-", "\u03a3", "\u0130", "\u0338", "=", "\u2581", "<0x41>", "<s>", "aaaa", "=" * 9]


def texts(n=20000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + [None, ""]


def encode_all(own, rows):
    got = []
    for _, data, text in chunks(*utf8(pa.array(rows, pa.string())), 1 << 16):
        ids, offs, exact = own.encode_checked(data, text)
        got += [(ids[a:b].tolist(), bool(e)) for a, b, e in zip(offs[:-1], offs[1:], exact, strict=True)]
    return got


@pytest.mark.parametrize("kind, name", [(C.ByteLevelEncoder, "byte_bpe_50k.json"), (C.WordEncoder, "word_bpe_49k.json")])
@pytest.mark.parametrize("specials", [True, False])
def test_cuts_don_t_change_ids(kind, name, specials):
    rows = texts()
    want = library(rows, name, specials)
    for slots, kept in ((1 << 4, 1 << 21), (1 << 22, 500)):
        got = encode_all(kind(tokenizer_file(name), specials, kept, slots), rows)
        assert [g for g, _ in got] == want


def test_pieces_and_what_they_spell():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    own = C.PieceEncoder(tokenizer_file("piece_bpe_32k.model"), 500, 1 << 8)
    rows = [t for t in texts() if t]
    for t, (ids, exact) in zip(rows, encode_all(own, [" " + t for t in rows]), strict=True):
        assert exact == ("\u2581" not in t)
        if exact:
            assert ids == model.encode(t)
            assert b"".join(own.bytes[i] for i in ids) == (" " + t).encode()


def test_byte_level_tokens_spell_their_text():
    own = C.ByteLevelEncoder(tokenizer_file(), specials=False)
    spell = own.token_bytes()
    rows = [t for t in texts(3000) if t]
    assert [b"".join(spell[i] for i in ids) for ids, _ in encode_all(own, rows)] == [t.encode() for t in rows]
