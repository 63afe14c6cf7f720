import numpy as np
import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def prose():
    """Random prose: prose(seed, words)."""

    def make(seed, n):
        rng = np.random.default_rng(seed)
        return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))

    return make
