"""Made-up texts."""

import random


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """Invented words, the frequent ones short."""
    draw = random.Random(seed)
    syllables = "an er ti on re ha th ed in ou st nd".split()
    words = ["".join(random.Random(k).choices(syllables, k=1 + k % 4)) for k in range(vocabulary)]
    return " ".join(words[int(vocabulary * draw.random() ** 2)] for _ in range(n))
