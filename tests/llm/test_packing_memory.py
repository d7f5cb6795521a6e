"""What a worker of the packing holds at once, and that texts handed out by runs have the same ids."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidegrid.llm import packing, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Task:
    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 0


def texts_of_many_words(n_bytes: int) -> list[str]:
    draw = random.Random(5)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(3, 9))) for _ in range(n_bytes // 40)]
    return [" ".join(draw.choices(words, k=400)) for _ in range(n_bytes // 2_800)]


def test_a_worker_holds_a_few_times_its_text(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", Task)
    texts = texts_of_many_words(4 << 20)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = packing._pieces(PATH, True, 0, 2048)
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(f"{peak / 1e6:.0f} MB")
    assert rows >= len(texts)
    assert peak < 12 * (4 << 20)  # of Python and numpy; Arrow's buffers aren't counted


@pytest.mark.parametrize("units", [1, 7, 1 << 17])
def test_runs_of_texts_have_the_ids_of_the_library(monkeypatch, units):
    monkeypatch.setattr(pieces, "RUN_UNITS", units)
    monkeypatch.setattr(pieces, "BLOCK", 2)
    texts = ["", "a b c d e f g h i j", " leading", "two  spaces\n\nlines", "Straße Éa x1 don't", "word" * 40, "", "<|endoftext|> a", " ", "ß ÀB zeta", ""]
    codec = pieces.TokenizerCodec(PATH, True)
    parts = list(codec.encoded(pa.array(texts, pa.large_string())))
    ids, counts = np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts])
    want = [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert len(parts) > 1 or units > 100
