import random

import pytest
from cases import AWKWARD, awkward, empty

from orrery.llm.token_counts import build, count_pieces, token_counts


def greedy(vocabulary, word):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_automaton_counts_as_greedy_matching(seed):
    rnd = random.Random(seed)
    make = lambda k: bytes(rnd.choice(b"abc") for _ in range(k))
    vocabulary = {make(rnd.randint(1, 5)) for _ in range(rnd.randint(1, 20))}
    machine = build(vocabulary)
    for _ in range(300):
        word = make(rnd.randint(0, 12))
        assert count_pieces(machine, word) == greedy(vocabulary, word), (vocabulary, word)


def test_table(spark):
    vocabulary = {b" the", b" th", b"e", b" ", b"fox", b"f", b"o", b"x"}
    got = sorted(map(tuple, token_counts(awkward(spark), vocabulary).collect()), key=str)
    want = []
    for i, text, *_ in AWKWARD:
        counts = [greedy(vocabulary, b" " + w) for w in (text or "").encode().split()]
        want.append((i, len(counts), sum(max(1, c) for c in counts), counts.count(-1)))
    assert got == sorted(want, key=str)
    assert token_counts(empty(spark), vocabulary).count() == 0
