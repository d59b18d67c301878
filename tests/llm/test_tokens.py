import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laneweave.llm.tokens import Encoder

ODD = ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "a\nb", "it's don't 's", "x\t y", "a b c  d  e", "é ́x y", "A'S  's", "  \n\n  q", "日本 語　 か", None, " a  b", "\n", "x\x1c y\x1fz q", "<|endoftext|> q <|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "x  <|endoftext|>\n<|endoftext|>  y", "<|startoftext|> <|endoftext|>|", "<|endof text|>", " <|endoftext|>\n\n", "a\u0085 b\u0085\nc", "é.\nÉ, x", "İ ΑΣ Σ", "1 22 3.4"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    r = random.Random(3)
    bits = [" ", "\n", "  ", " ", "\t", "ab", "é", "'s", ".", "12", "<|endoftext|>", "|", "　", "—", "́", "\r\n"]
    texts = ODD + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    e = Encoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time all are known
        ids, at = e.encode(pa.array(texts))
        want = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
        for i, w in enumerate(want):
            assert ids[at[i] : at[i + 1]].tolist() == w.ids, repr(texts[i])


def test_bounded_memory():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), remember=10)
    for i in range(20):
        ids, at = e.encode(pa.array([f"some words number {i}", "and more of them"]))
        assert len(e.hashes) <= 12 and at[-1] == len(ids)
