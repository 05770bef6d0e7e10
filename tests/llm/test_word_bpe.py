"""The word vocabulary against the library: random strings of all planes, marks in any order, pieces around the short limit."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linepack.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    got = [list(array("I", x)) for x in bpe.load(PATH).encode_all(texts)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_random_strings(library):
    rnd = random.Random(31)
    marks = [*range(0x300, 0x370), 0x483, 0x486, 0x591, 0x5B0, 0x89E, 0x8CD, 0x1715, 0x1ABA, 0x1AC6, 0x1DCD, 0x20D0, 0x20D3, 0x3099, 0x309A, 0x302A]
    letters = [0x41, 0x65, 0x3B1, 0x3A3, 0x443, 0x130, 0x1C89, 0x558, 0x209F, 0x212B, 0xFB01, 0x20, 0x1C, 0x85, 0xA0, 0x2028, 0x27, 0x73]
    kinds = [lambda: rnd.randrange(0x3000), lambda: rnd.choice([rnd.randrange(0x3000), rnd.randrange(0xE000, 0x110000)]), lambda: rnd.choice(marks + letters * 3), lambda: rnd.choice(letters)]
    for k in range(50):
        pick = kinds[k % 4]
        same(library, ["".join(chr(pick()) for _ in range(rnd.randrange(1, 18))) for _ in range(2000)])


def test_pieces_around_the_short_limit(library):
    rnd = random.Random(32)
    same(library, ["".join(rnd.choice("abcdehilnorst" if k % 2 else "éüßaeo") for _ in range(n)) for k in range(40) for n in (*range(22, 28), *range(44, 54), 200)])


def test_special_strings_beside_untested_characters(library):
    same(library, ["᜕҆<|endoftext|>a࣍ b", "<|startoftext|>Ᲊ", "x <|endoftext|", "࢞" * 60])
