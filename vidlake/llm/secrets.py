"""Secret scans: pattern findings, and a character convolutional network over every other candidate.

The first pass keeps a bounded sample of labelled windows: the values of pattern
findings, and candidates (runs of 16 or more token characters, or of 12 or more with a
digit) that no pattern meets, each with the characters around it. A small network in
numpy is trained on them. So that the value itself must tell and not the keyword before
it, confirmed values are also shown in the surroundings of unconfirmed ones, together
with random values of the usual formats, and with harmless strings of the kinds that
look like keys (names made of words, numbers of books and dates, rules, alphabets).
It is calibrated on held-out values in such surroundings, and given the highest
threshold that keeps RECALL of each format. The second pass finds the pattern spans
again and scores every candidate but those that they cover, in windows of a bounded
number at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import logging
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vidlake.llm.storage import drop, save

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The token characters of ASSIGN; a full stop only inside.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]")
#: Candidates shorter than SURE have a digit; no value is shorter than SHORT.
SHORT, SURE = 12, 16
DIGIT = re.compile(r"[0-9]")
#: Characters of context on each side, and of the candidate that one window holds; longer ones have several windows.
AROUND, INSIDE = 24, 64
#: Labelled findings of each class that the network is trained on, those with the smallest hashes.
LABELLED_ROWS = 2_000
RECALL = 0.98
#: Tasks that what all tasks kept is merged in, before it comes to the driver.
MERGES = 16
FILTERS, WIDTH = 16, 5
#: Windows that are scored at once.
AT_ONCE = 4_096
log = logging.getLogger(__name__)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings, by start and then kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a greedy run of 24 or more starts where its maximal run does
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def window(text: str, start: int, end: int) -> str:
    """At most INSIDE characters with their context, which is padded where the text ends."""
    to = min(end, start + INSIDE)
    return text[max(0, start - AROUND) : start].rjust(AROUND, "\0") + text[start:to].ljust(INSIDE, "\0") + text[to : to + AROUND].ljust(AROUND, "\0")


def windows(text: str, start: int, end: int) -> Iterator[str]:
    """The candidate with its context, cut into windows of INSIDE characters that overlap by half."""
    for at in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        yield window(text, at, end)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, Iterator[str]]]:
    """(start, end, label, windows) of each candidate: label 1 where pattern spans cover it, 2 where they only meet it. spans: by start."""
    first = 0
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < SURE and not DIGIT.search(m[0]):
            continue
        while first < len(spans) and spans[first][2] <= m.start():
            first += 1
        at, met = m.start(), False
        for s, _, e in itertools.takewhile(lambda x: x[0] < m.end(), itertools.islice(spans, first, None)):
            if m.start() < e:
                met = True
                at = max(at, e) if s <= at else at
        yield m.start(), m.end(), 1 if at >= m.end() else 2 if met else 0, windows(text, m.start(), m.end())


def values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what the pattern findings say is secret, of SHORT or more characters."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= SHORT:
            yield m.span(2)
    for kind in (ACCESS, HEX):
        for m in kind.finditer(text):
            if m.end() - m.start() >= 20:
                yield m.span()


def _fewest(known: dict[str, int], limit: int) -> dict[str, int]:
    return dict(sorted(known.items(), key=lambda x: (x[1], x[0]))[:limit])


_LABELLED = pa.schema([("label", pa.int32()), ("window", pa.string()), ("h", pa.int64())])


def _labelled_rows(limit: int, out: list[dict[str, int]]) -> pa.RecordBatch:
    rows = [(label, w, h) for label in (0, 1) for w, h in _fewest(out[label], limit).items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _LABELLED)], schema=_LABELLED)


def _sample(limit: int):
    """A task's function: of each class the `limit` windows with the smallest hashes; 1: values of findings, 0: candidates that no pattern meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict[str, int]] = [{}, {}]

        def add(label: int, w: str) -> None:
            out[label][w] = xxhash.xxh3_64_intdigest(w.encode()) >> 1
            if len(out[label]) > 4 * limit:
                out[label] = _fewest(out[label], limit)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = text or ""
                for start, end in values(text):
                    add(1, window(text, start, end))
                for start, end, label, _ in candidates(text, base_spans(text)):
                    if label == 0:
                        add(0, window(text, start, end))
        yield _labelled_rows(limit, out)

    return run


def _merge(limit: int):
    """A task's function: the smallest of what other tasks kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict[str, int]] = [{}, {}]
        for batch in batches:
            for label, w, h in zip(*(c.to_pylist() for c in batch.columns)):
                out[label][w] = h
            out = [_fewest(x, limit) for x in out]
        yield _labelled_rows(limit, out)

    return run


def _classes(texts: list[str]) -> np.ndarray:
    """One-hot letters without case, and flags for upper case, digit, kind of mark, padding and being inside; (n, length, classes)."""
    length = 2 * AROUND + INSIDE
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), length).astype(np.int64)
    out = np.zeros((len(texts), length, 42), np.float32)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    letter = (lower >= 97) & (lower <= 122)
    kind = np.full(codes.shape, 38)  # any other character
    kind[letter] = lower[letter] - 97
    kind[(codes >= 48) & (codes <= 57)] = 26
    for k, c in enumerate("+/_.=- \n\"':"):
        kind[codes == ord(c)] = 27 + k
    kind[codes == 0] = 39
    np.put_along_axis(out, kind[..., None], 1.0, axis=2)
    out[..., 40] = (codes >= 65) & (codes <= 90)
    out[:, AROUND : AROUND + INSIDE, 41] = 1.0
    return out


class CharNet:
    """Convolution over characters, maximum and mean over positions, one logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.15, (WIDTH * 42, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold, self.precision = 1.0, 0.0, 0.5, 0.0

    def _columns(self, texts: list[str]) -> np.ndarray:
        x = _classes(texts)
        return np.concatenate([x[:, k : x.shape[1] - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)

    def logits(self, texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 128):
            h = np.maximum(self._columns(texts[at : at + 128]) @ self.w + self.b, 0)
            out.append(np.concatenate([h.max(1), h.mean(1)], axis=1) @ self.v + self.c[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def probability(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(texts) * self.scale + self.shift)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 6, seed: int = 7) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        parts = [self.w, self.b, self.v, self.c]
        first, second, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 64):
                pick = order[at : at + 64]
                x = self._columns([texts[k] for k in pick])
                h = np.maximum(x @ self.w + self.b, 0)
                top, z = h.argmax(1), np.concatenate([h.max(1), h.mean(1)], axis=1)
                error = ((1 / (1 + np.exp(-(z @ self.v + self.c[0])))) - labels[pick]).astype(np.float32) / len(pick)
                dz = error[:, None] * self.v
                dh = np.repeat(dz[:, None, FILTERS:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(dh, top[:, None, :], np.take_along_axis(dh, top[:, None, :], 1) + dz[:, None, :FILTERS], 1)
                dh *= h > 0
                grads = [x.reshape(-1, x.shape[2]).T @ dh.reshape(-1, FILTERS), dh.sum((0, 1)), z.T @ error, error.sum(keepdims=True)]
                t += 1
                for p, g, m, v in zip(parts, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, texts: list[str], labels: np.ndarray, recall: float = RECALL, formats: np.ndarray | None = None) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps `recall` of the confirmed ones (of each format, where formats tells them apart), and the precision at it."""
        z = self.logits(texts).astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.05 * float(((p - labels) * z).mean())
            b -= 0.05 * float((p - labels).mean())
        self.scale, self.shift = a, b
        scores, formats = self.probability(texts), np.zeros(len(texts)) if formats is None else formats
        sure = [np.sort(scores[(labels == 1) & (formats == f)]) for f in np.unique(formats[labels == 1])]
        self.threshold = float(min(x[int((1 - recall) * len(x))] for x in sure)) if sure else 1.1
        kept = self.probability(texts) >= self.threshold
        self.precision = float(labels[kept].mean()) if kept.any() else 0.0


FORMATS = 11
LETTERS = string.ascii_letters + string.digits
WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{3,9}(?![A-Za-z0-9])")


def random_values(n: int, seed: int = 7) -> list[str]:
    """Values of the FORMATS formats that keys and tokens usually have, in turn."""
    rng, out = random.Random(seed), []
    pick = lambda letters, lo, hi: "".join(rng.choices(letters, k=rng.randint(lo, hi)))
    for k in range(n):
        out.append((
            lambda: pick("0123456789abcdef", 12, 24), lambda: pick("0123456789abcdef", 16, 64), lambda: pick(LETTERS, SHORT, 20), lambda: pick(LETTERS, 16, 48), lambda: pick(LETTERS + "+/", 20, 64) + "=" * rng.randint(0, 2),
            lambda: pick(string.ascii_lowercase + string.digits, 14, 40), lambda: pick(string.ascii_uppercase + string.digits, 14, 40), lambda: pick(LETTERS + "_-", 20, 48),
            lambda: pick("abcdefghijklmnopqrstuvwxyz", 2, 4) + "_" + pick(LETTERS, 20, 40), lambda: ".".join(pick(LETTERS + "_-", 12, 24) for _ in range(3)),
            lambda: "-".join(pick("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)),
        )[k % FORMATS]())
    return out


def harmless_values(words: list[str], n: int, seed: int = 7) -> list[str]:
    """Strings that are no secrets though they are long and have no spaces, of nine kinds in turn; words: of the corpus."""
    rng, out = random.Random(seed), []
    some = lambda lo, hi: [rng.choice(words) for _ in range(rng.randint(lo, hi))]
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    camel = lambda ws: ws[0] + "".join(w.capitalize() for w in ws[1:])
    for k in range(n):
        start = rng.randrange(14)
        out.append((
            lambda: camel(some(3, 6)), lambda: rng.choice("_-./").join(some(3, 6)), lambda: "_".join(some(3, 5)).upper(), lambda: "".join(w.capitalize() for w in some(3, 5)) + rng.choice(["", digits(1), digits(2)]),
            lambda: rng.choice("=-_./+") * rng.randint(16, 64), lambda: (string.ascii_uppercase if k % 2 else string.ascii_lowercase)[start : start + rng.randint(12, 26)],
            lambda: f"ISBN-978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}" if k % 2 else f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}T1{digits(1)}-{digits(2)}-{digits(2)}" if k % 2 else digits(rng.randint(12, 20)),
            lambda: "/".join([*some(2, 4), f"{rng.choice(words)}-{digits(1)}.{digits(1)}.{digits(2)}.{rng.choice(words)[:3]}"]),
        )[k % 9]())
    return [v for v in out if len(v) >= SURE or len(v) >= SHORT and DIGIT.search(v)]


def _set_into(value: str, around: str) -> str:
    """A window of value in the surroundings of another window."""
    return around[:AROUND] + value[:INSIDE].ljust(INSIDE, "\0") + around[-AROUND:]


def train(found: DataFrame, limit: int = LABELLED_ROWS) -> CharNet | None:
    """The network, from at most `limit` windows of each class of found (label, window, h) and random values; None where no candidate is unconfirmed."""
    rows = {label: [r.window for r in found.where(F.col("label") == label).orderBy("h", "window").limit(limit).collect()] for label in (0, 1)}
    if not rows[0]:
        return None
    return trained_on(rows[0], rows[1])


def trained_on(unmet: list[str], found: list[str]) -> CharNet:
    """The network, from windows of candidates that no pattern meets and of findings."""
    rng, rows = random.Random(7), (unmet, found)
    confirmed = [w[AROUND:-AROUND].rstrip("\0") for w in rows[1]]
    made = random_values(max(len(rows[0]), 200 * FORMATS))
    known = [*((v, -1) for v in confirmed), *((v, k % FORMATS) for k, v in enumerate(made))]
    rng.shuffle(known)  # so that every format is among those held out
    fit: tuple[list, list] = ([], [])
    held: tuple[list, list] = ([], [])
    formats = []
    for k, w in enumerate(rows[0]):
        (held if k % 4 == 3 else fit)[0].append(w)
    places = (list(fit[0]), list(held[0] or fit[0]))
    for k, (value, form) in enumerate(known):
        out = k % 4 == 3
        (held if out else fit)[1].append(_set_into(value, rng.choice(places[out])))
        formats += [form] * out
    fit[1].extend(w for k, w in enumerate(rows[1]) if k % 4 < 3)
    # all words of the corpus that a window of the sample shows, in one order
    words = sorted({w.lower() for x in rows[0] for w in WORD.findall(x)})
    tame = harmless_values(words, len(rows[0])) if words else []
    tame = [_set_into(v, rng.choice(places[k % 4 == 3])) for k, v in enumerate(tame)]
    # candidates without a keyword may be secrets all the same: those that a first network takes for some teach nothing
    label = lambda parts: np.repeat([0.0, 1.0], [len(p) for p in parts]).astype(np.float32)
    first = CharNet()
    first.fit([*fit[0], *fit[1]], label(fit), epochs=3)
    fit[0][:] = [w for w, z in zip(fit[0], first.logits(fit[0])) if z < 0] or fit[0]
    # what is held out stays whole, so the precision that is told counts the hard ones too
    fit[0].extend(w for k, w in enumerate(tame) if k % 4 < 3)
    held[0].extend(w for k, w in enumerate(tame) if k % 4 == 3)
    net = CharNet()
    net.fit([*fit[0], *fit[1]], label(fit))
    net.calibrate([*held[0], *held[1]], label(held), formats=np.array([-2] * len(held[0]) + formats))
    log.info("secret network: threshold %.4f for recall %.2f, precision %.4f at it on %d held-out windows", net.threshold, RECALL, net.precision, len(held[0]) + len(held[1]))
    return net


def _scored(net: CharNet, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The candidates of each text that the network finds; windows are scored AT_ONCE at a time, and equal ones once."""
    added: list[dict[tuple[int, int], float]] = [{} for _ in texts]
    waiting: dict[str, list[tuple[int, tuple[int, int]]]] = {}

    def score() -> None:
        for owners, p in zip(waiting.values(), net.probability(list(waiting)) if waiting else ()):
            for row, at in owners:
                if p >= net.threshold:
                    added[row][at] = max(p, added[row].get(at, 0.0))
        waiting.clear()

    size = 0
    for row, (text, spans) in enumerate(zip(texts, base)):
        for start, end, label, parts in candidates(text, spans):
            for w in parts if label != 1 else ():
                waiting.setdefault(w, []).append((row, (start, end)))
                size += 1
                if len(waiting) >= AT_ONCE or size >= 16 * AT_ONCE:
                    score()
                    size = 0
    score()
    return [[(start, 3, end) for start, end in own] for own in added]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = _scored(net, texts, base) if net is not None else [[] for _ in texts]
            counts = [pa.array([sum(x[1] == k for x in own) for own in base], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(written(own).encode()).hexdigest() for own in base]
            spans = [written(sorted(own + more)) for own, more in zip(base, added)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of docs.

    spans: kind:start:end of the pattern findings and, as kind cnn, of the candidates
    that the network adds, by start and then kind; code points of the whole text, end
    exclusive. Null and empty texts have none. Rows that repeat a doc_id, or have none,
    are scanned each; other columns are not looked at, whatever their names; an empty
    table gives no rows. Where every candidate is a pattern's, nothing is added.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "label int, window string, h long"
    labelled = texts.select("text").mapInArrow(_sample(LABELLED_ROWS), kinds)
    labelled = save(labelled.repartition(MERGES, F.xxhash64("window")).mapInArrow(_merge(LABELLED_ROWS), kinds), "labelled")
    net = train(labelled)
    drop(labelled)
    return texts.mapInArrow(_scan(spark.sparkContext.broadcast(net)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
