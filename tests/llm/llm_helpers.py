"""Plain versions of what the operators compute, for comparison."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return SPACE.findall(lower(text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def groups(n, pairs):
    own = list(range(n))

    def top(k):
        while own[k] != k:
            k = own[k]
        return k

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        own[y] = x
    return [top(k) for k in range(n)]


def sentence(rng, n):
    return [rng.choice("red blue green stone river light tower garden silent early under winter copper small broken hidden paper glass morning field".split()) + str(rng.randrange(60)) for _ in range(n)]
