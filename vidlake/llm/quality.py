"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of each text are Spark expressions. From the statistics of labelled
documents, sequential covering grows one conjunction of thresholds at a time (best
FOIL gain on two thirds of the rows, read off a histogram that Spark aggregates), prunes
it on the other third, and removes what it covers. The rules become one ordered chain
of conditions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from vidlake.llm.storage import free_name, save

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled rows that the rules are learned from, those with the smallest hash of doc_id.
LABELLED_ROWS = 20_000
BINS = 24
MAX_RULES = 6
MAX_CONDITIONS = 3
#: Share of the pruning rows that a rule covers which must be bad, and how many it must cover.
MIN_PRECISION = 0.95
MIN_COVER = 5

Condition = tuple[str, str, float]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs (long).

    Words are runs of [^\\x20\\x09-\\x0D]; null text has none. word_chars: code points in
    words. n_symbols: characters of #*$%&|<>. n_dup_lines: lines with a word that equal
    an earlier line. n_repeat_words: words within 5-word windows that occur twice or more
    in the text, the first included (windows are compared by 64-bit hashes).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, lines, windows, repeats, ordered, places = own = [free_name(docs, f"q_{n}") for n in ("words", "lines", "windows", "repeats", "sorted", "at")]
    out = docs.withColumn(words, F.array_remove(F.split(text, SPACE), ""))
    out = out.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("n_words", F.size(words).cast("long"))
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(5)]))
    out = out.withColumn(windows, F.when(F.col("n_words") >= 5, hashed).otherwise(F.array().cast("array<long>")))
    out = out.withColumn(repeats, F.size(F.array_distinct(windows)) < F.size(windows))
    out = out.withColumn(ordered, F.when(F.col(repeats), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.col(ordered)
    twice = F.filter(near, lambda x, k: (x["h"] == F.get(near, k + 1)["h"]).eqNullSafe(True) | ((k > 0) & (x["h"] == F.get(near, k - 1)["h"]).eqNullSafe(True)))
    out = out.withColumn(places, F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col(places)
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1), x + 5) - x)), F.lit(0), lambda a, x: a + x)
    return (
        out.withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_bangs", F.regexp_count(text, F.lit("!")).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop(*own)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features() -> dict[str, Column]:
    """What rules may test: shares of the words, in thousandths, and mean word length in hundredths."""
    words = F.greatest("n_words", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.floor(F.col("word_chars") * 100 / words).cast("double"),
        "symbols": F.floor(F.col("n_symbols") * 1000 / words).cast("double"),
        "bangs": F.floor(F.col("n_bangs") * 1000 / words).cast("double"),
        "dup_lines": F.floor(F.col("n_dup_lines") * 1000 / words).cast("double"),
        "repeats": F.floor(F.col("n_repeat_words") * 1000 / words).cast("double"),
    }


def holds(rule: Iterable[Condition]) -> Column:
    out = F.lit(True)
    for name, sign, limit in rule:
        out = out & (features()[name] > limit if sign == ">" else features()[name] <= limit)
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """FOIL: bits saved on the bad rows that stay covered."""
    if p <= 0 or p0 <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(labelled: DataFrame) -> list[list[Condition]]:
    """Rules that reject, in order; labelled: with_statistics columns and `good` (boolean), doc_id.

    Only histograms come to the driver: features times bins, whatever the rows.
    """
    names = list(features())
    table = labelled.select((~F.col("good")).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"), "n_words", "word_chars", "n_symbols", "n_bangs", "n_dup_lines", "n_repeat_words")
    table = save(table, "labelled").where(~base_failed())
    marks = [k / BINS for k in range(1, BINS)] + [0.97, 0.98, 0.99, 0.995]
    row = table.agg(*[F.percentile_approx(f, marks, 10_000).alias(k) for k, f in features().items()]).first()
    limits = {k: sorted(set(row[k] or [])) for k in names}

    def bin_of(name: str) -> Column:
        marks = F.array(*[F.lit(float(t)) for t in limits[name]]).cast("array<double>")
        return F.size(F.filter(marks, lambda t: t < features()[name]))

    binned = save(table.withColumn("bins", F.array(*map(bin_of, names))), "binned")

    def histogram(left: DataFrame, rule: list[Condition]) -> dict:
        rows = left.where(F.col("grow") & holds(rule)).select("bad", F.posexplode("bins").alias("feature", "bin"))
        return {(r.feature, r.bin): (r.p, r.n) for r in rows.groupBy("feature", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()}

    def best(left: DataFrame, rule: list[Condition]) -> tuple[float, Condition, float, float] | None:
        table, found = histogram(left, rule), None
        for at, name in enumerate(names):
            counts = [table.get((at, b), (0, 0)) for b in range(len(limits[name]) + 1)]
            p0, n0 = sum(c[0] for c in counts), sum(c[1] for c in counts)
            p = n = 0
            for b, limit in enumerate(limits[name]):
                p, n = p + counts[b][0], n + counts[b][1]
                for sign, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                    g = _gain(p0, n0, x, y)
                    # of equal gains on the high side, the threshold that rejects least
                    if x + y < p0 + n0 and g > 1e-9 and (found is None or g > found[0] or (g == found[0] and sign == ">" and found[1][:2] == (name, sign))):
                        found = (g, (name, sign, float(limit)), x, y)
        return found

    def pruned(left: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
        """The shortest beginning of the rule with the best (p - n) / (p + n) on the pruning rows."""
        ends = range(1, len(rule) + 1)
        sums = [F.sum(F.when(holds(rule[:k]), v).otherwise(0)) for k in ends for v in (F.col("bad"), 1 - F.col("bad"))]
        row = left.where(~F.col("grow")).agg(*sums).first()
        scored = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k in ends for p, n in [(row[2 * k - 2] or 0, row[2 * k - 1] or 0)]]
        _, k, p, n = max(scored)
        return rule[:-k], p, n

    rules: list[list[Condition]] = []
    left = binned
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS and (found := best(left, rule)):
            rule.append(found[1])
            if found[3] == 0:
                break
        if not rule:
            break
        rule, p, n = pruned(left, rule)
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one expression: false at the first rule that holds, else true."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> list[list[Condition]]:
    """Rules from docs that labels (doc_id, quality 0 or 1) covers; none where labels are missing.

    limit: rows of labels that are used, those with the smallest hash of doc_id; this
    bounds the sample, which is broadcast to find its documents.
    """
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(save(some, "labels")), "doc_id")
    return learn_rules(with_statistics(texts))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, its statistics, base_failed and kept (these names replace columns of docs).

    A null or blank text has no words and fails. Each row is judged by itself: rows that
    repeat a doc_id stay. A text of any length is judged whole. Without labels only the
    base rule rejects. An empty table gives no rows.
    """
    rules = learn_from(docs, labels)
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps, with the columns of docs, whatever their names.

    Nulls, repeated rows, texts of any length and empty tables as in judge.
    """
    # the row number keeps the filter above the statistics: pushed into them, it would compute them again for each use
    rules = learn_from(docs, labels)
    plain = docs.select("text", F.struct(*docs.columns).alias("all"))
    judged = with_statistics(plain).withColumn("kept", verdict(rules)).withColumn("row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("row") >= 0)).select("all.*")
