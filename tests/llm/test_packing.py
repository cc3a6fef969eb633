"""Placing of nested classes, and normalising of many words at once."""

import time

import numpy as np
import pytest

from reportloom.llm import op12_packing as op12
from reportloom.llm.op5_token_files import encoder


def plainly(sizes, limits):
    """The rule in words: of the classes that fit, the one with the largest dot product, in order."""
    kinds, kind, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    gain = kinds / limits * (kinds / limits * (left[:, None] / len(sizes))).sum(0)
    items = [list(np.flatnonzero(kind.reshape(-1) == k)) for k in range(len(kinds))]
    sequence, position, now = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), -1
    while any(items):
        now, room, held = now + 1, limits.copy(), 0
        while True:
            fits = [k for k in range(len(kinds)) if items[k] and (kinds[k] <= room).all()]
            if not fits:
                break
            best = max(fits, key=lambda k: gain[k] @ (room / limits))
            sequence[i := items[best].pop(0)], position[i] = now, held
            room, held = room - kinds[best], held + 1
    return sequence, position


@pytest.mark.parametrize("nested", [True, False])
def test_placing_follows_the_rule(nested):
    g = np.random.default_rng(3)
    limits = np.array(op12.Limits(64, 8, 64), np.int64)
    for n in (1, 2, 50, 300):
        length = g.integers(1, 65, n)
        loss = length - 1 if nested else g.integers(0, length + 1)
        sizes = np.stack([length, np.ones(n, np.int64), loss], 1)
        for got, want in zip(op12.place(sizes, limits), plainly(sizes, limits), strict=True):
            assert np.array_equal(got, want)


def test_placing_nested_classes_looks_the_class_up():
    g = np.random.default_rng(4)
    length = g.integers(1, 2049, 4096)
    began = time.process_time()
    op12.place(np.stack([length, np.ones_like(length), length - 1], 1), np.array(op12.Limits(), np.int64))
    assert time.process_time() - began < 0.1


def test_words_are_normalised_in_one_text():
    import public_tokenizers

    enc, calls = encoder(public_tokenizers.path("word_bpe_49k.json")), []
    words = ["Ünder", "ΣΊΣΥΦΟΣ", "İstanbul", "Й", "straße", "Ǆ", "ŉ", "Ж" * 50]
    assert enc.words_apart
    assert enc.normalized(words) == [enc.tok.normalizer.normalize_str(w) for w in words]
    assert enc.normalized([]) == calls
