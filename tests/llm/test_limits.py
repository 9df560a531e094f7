"""Inputs beyond the sizes that the other tests meet."""

import numpy as np

from docloom.llm import quality


def test_more_different_words_than_21_bits():
    """A text of over two million different words, and one ten-word repeat."""
    ten = " ".join(f"r{i}" for i in range(10))
    text = f"{ten} {' '.join(map(str, range(2_100_000)))} {ten}".encode()
    got = [x[0].as_py() for x in quality.measure(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]
    assert (got[0], got[4], got[6], got[7], got[8]) == (2_100_020, 20, 20, 10, True)


def test_word_numbers_do_not_matter():
    rng = np.random.default_rng(7)
    ids, docs = rng.integers(1, 9, 4000), np.sort(rng.integers(0, 20, 4000))
    for small, large in zip(quality.repeats(ids, docs), quality.repeats(ids << 22, docs), strict=True):
        assert len(small) and (small == large).all()
