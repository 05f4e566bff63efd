"""What a worker holds on to after packing's tokenizer has seen many words."""

import tracemalloc

import public_tokenizers
from tokenizers import Tokenizer

from creditloom.llm import packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_tokenizer_keeps_nothing_between_texts():
    own = packing.PieceTokenizer(BYTE_BPE)
    own.encode("warm up")
    tracemalloc.start()
    try:
        for text in range(50):
            own.encode(" ".join(f"word{text * 1000 + i}x" for i in range(1000)))
        assert tracemalloc.get_traced_memory()[0] < 1_000_000
    finally:
        tracemalloc.stop()


def test_whole_texts_give_the_librarys_ids():
    own, library = packing.PieceTokenizer(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    special = next(iter(own.special), "")
    texts = ["a  b", " a ", "a \n b\t\tc  ", "  \n", f"x {special} y{special}", f"  {special}  ", "don't  stop .", "a" * 5000 + "  " * 300, "  　x 12 345", f" {special}\n {special[:-1]} "]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(own.encode(text)).cast("I")) == expected, text
