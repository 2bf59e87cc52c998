"""The table of encoded pieces against the library itself."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelworks.llm import vocabulary

PARTS = ["a", "B", "é", "ß", ",", ".", "\n", " ", "0", "1", "'", "x", "ü", "<|", "|>", "the", " the", "don't", "¿", "«", "×", "-", "_", "日", "\t", "<|endoftext|>", "\x00"]
ODD = [None, "", "\n", "a", "a.", "é,", "×.", ".", ",.", "a..", "0.", "ab0cd 0 00", "x 0\n0", " a", "a ", "\na", "a\n", "a\n\nb", "word " * 3000 + "end", "x" * 5000]


@pytest.mark.parametrize("remembered", [500_000, 300])
@pytest.mark.parametrize("name, lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_library(monkeypatch, name, lead, remembered):
    monkeypatch.setattr(vocabulary, "REMEMBERED", remembered)
    monkeypatch.setattr(vocabulary, "_loaded", {})
    rng = random.Random(remembered)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ODD
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", ",", "."]) for _ in range(3000)]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)]
    model = Tokenizer.from_file(public_tokenizers.path(name))
    batches = pa.table({"text": pa.array(texts, pa.string())}).to_batches(max_chunksize=700)
    got = []
    for _, flat, offsets in vocabulary.encoded_slices(batches, public_tokenizers.path(name), lead, 2):
        got += [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert len(got) == len(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == [*model.encode(text or "", add_special_tokens=False).ids, 2], text


def test_table_of_hashes_against_a_dict():
    rng = np.random.default_rng(3)
    table, known = vocabulary.Table(), {}
    for size in (5, 3000, 1, 9000):
        # Hashes that share their low bits meet in the same places.
        new = np.unique(rng.integers(0, 1 << 40, size, dtype=np.uint64) << np.uint64(20))
        new = np.array([h for h in new.tolist() if h not in known], dtype=np.uint64)
        known |= {h: len(known) + k for k, h in enumerate(new.tolist())}
        table.add(new)
        asked = np.concatenate([np.array(list(known), dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
        assert table.find(asked).tolist() == [known.get(h, -1) for h in asked.tolist()]
