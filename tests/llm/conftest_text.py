"""Made-up text for tests."""

import random


def filler(seed, n=60):
    dice = random.Random(seed)
    return " " + " ".join("".join(dice.choice("aeioulnrst") for _ in range(dice.randint(3, 9))) for _ in range(n)) + ". "
