import random

import pytest


@pytest.fixture
def words():
    """A seeded maker of texts from a small vocabulary."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def make(n, blank=" "):
        return blank.join(rng.choice(vocabulary) for _ in range(n))

    return make
