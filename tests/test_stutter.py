"""Stuttered text against the rule told one step at a time."""

import random
import time

from tomeflow.functions.stutter import collapse


def told(tokens):
    """Shortest repeated run first, leftmost first, anew after each removal."""
    tokens = list(tokens)
    again = True
    while again:
        again = False
        for n in range(1, len(tokens) // 2 + 1):
            at = [i for i in range(len(tokens) - 2 * n + 1) if tokens[i:i + n] == tokens[i + n:i + 2 * n]]
            if at:
                del tokens[at[0]:at[0] + n]
                again = True
                break
    return tokens


def test_collapse_on_random_texts():
    rng = random.Random(3)
    for _ in range(4000):
        words = [rng.choice("abcde"[:rng.randint(1, 5)]) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            i, n = rng.randint(0, len(words)), rng.randint(1, 7)
            words[i:i] = words[max(i - n, 0):i] * rng.randint(1, 3)
        words = words[:60]
        assert collapse(list(words)) == told(words), words


def test_collapse_hand_worked():
    assert collapse([]) == [] and collapse(["a"]) == ["a"] and collapse(["a", "a", "a"]) == ["a"]
    assert collapse("the cat the cat sat on the mat the mat".split()) == "the cat sat on the mat".split()


def test_long_texts_take_little_time():
    rng = random.Random(5)
    plain = [f"w{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(10_000)]
    once = collapse(plain)
    for text in (plain, once + once, [w for i in range(0, 10_000, 2) for w in plain[i:i + 2] * 2][:10_000]):
        start = time.perf_counter()
        out = collapse(list(text))
        assert time.perf_counter() - start < 3
        assert collapse(list(out)) == out
    assert collapse(once + once) == once
