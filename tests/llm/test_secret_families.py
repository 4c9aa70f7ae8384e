"""The network of the secret scan on formats and harmless strings that it was not trained on, by format."""

import random
import re
import string

import pyarrow.parquet as pq
import pytest
import xxhash

from vidlake.llm import secrets

HEX, MIXED = "0123456789abcdef", string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def halves():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").to_pylist()]
    return texts[::2], texts[1::2]


@pytest.fixture(scope="module")
def net(halves):
    unmet, found = {}, {}
    hashed = lambda w: xxhash.xxh3_64_intdigest(w.encode()) >> 1
    for t in halves[0]:
        for a, b in secrets.values(t):
            w = secrets.window(t, a, b)
            found[w] = hashed(w)
        for a, b, label, _ in secrets.candidates(t, secrets.base_spans(t)):
            if label == 0:
                w = secrets.window(t, a, b)
                unmet[w] = hashed(w)
    return secrets.trained_on(list(secrets._fewest(unmet, secrets.LABELLED_ROWS)), list(secrets._fewest(found, secrets.LABELLED_ROWS)))


def flagged(net, texts, values, seed=1):
    """Share of values that the scan reports when they stand in prose, without a keyword."""
    rng, hits = random.Random(seed), 0
    for v in values:
        words = rng.choice([t for t in texts if len(t) > 100]).split(" ")[:20]
        words.insert(rng.randrange(len(words) + 1), v)
        text = " ".join(words)
        at = (text.index(v), text.index(v) + len(v))
        base = secrets.base_spans(text)
        found = [(s, e) for s, _, e in base] + [(s, e) for s, _, e in secrets._scored(net, [text], [base])[0]]
        hits += at in found or any(s <= at[0] and e >= at[1] for s, e in found)
    return hits / len(values)


def of(letters, n, rng):
    return "".join(rng.choices(letters, k=n))


@pytest.mark.parametrize("name", ["uuid", "16 hex", "20 hex", "32 HEX", "16 mixed", "20 mixed", "32 mixed", "24 lower", "prefixed"])
def test_recall_of_formats(net, halves, name):
    rng = random.Random(77)
    make = {
        "uuid": lambda: "-".join(of(HEX, k, rng) for k in (8, 4, 4, 4, 12)), "16 hex": lambda: of(HEX, 16, rng), "20 hex": lambda: of(HEX, 20, rng), "32 HEX": lambda: of(HEX.upper(), 32, rng),
        "16 mixed": lambda: of(MIXED, 16, rng), "20 mixed": lambda: of(MIXED, 20, rng), "32 mixed": lambda: of(MIXED, 32, rng), "24 lower": lambda: of(string.ascii_lowercase + string.digits, 24, rng),
        "prefixed": lambda: rng.choice(("sk_live_", "ghp_", "xoxb-")) + of(MIXED, 30, rng),
    }[name]
    assert flagged(net, halves[1], [make() for _ in range(100)]) >= 0.9


def test_harmless_strings(net, halves):
    tame = [
        "getElementsByClassNameAndReturn", string.ascii_uppercase, string.ascii_lowercase, "=" * 20, "-" * 30, "ISBN-978-3-16-148410-0", "usr/local/lib/python3.13/site-packages", "com.example.project.module",
        "2024-01-01T00-00-00", "1234567890123456", "Donaudampfschifffahrtsgesellschaft", "internationalization", "MAX_BUFFER_SIZE_LIMIT", "user_profile_picture_url", "https-www-example-com-index",
    ]
    assert flagged(net, halves[1], tame) <= 0.1


def test_what_the_corpus_has_is_left_alone(net, halves):
    rows = [(t, secrets.base_spans(t)) for t in halves[1]]
    unmet = sum(label == 0 for t, base in rows for *_, label, _ in secrets.candidates(t, base))
    added = secrets._scored(net, [t for t, _ in rows], [b for _, b in rows])
    assert unmet > 500 and sum(map(len, added)) <= 0.02 * unmet


def test_short_candidates_have_a_digit():
    found = lambda t: [t[a:b] for a, b, *_ in secrets.candidates(t, [])]
    assert found("abcdefghijkl abcdefghijk1 abcdefghij1 abcdefghijklmnop") == ["abcdefghijk1", "abcdefghijklmnop"]


def test_harmless_values_are_of_words_and_numbers():
    made = secrets.harmless_values(["red", "stone", "river"], 90)
    assert len(made) > 60 and all(len(v) >= secrets.SURE or re.search("[0-9]", v) for v in made) and made == secrets.harmless_values(["red", "stone", "river"], 90)
