"""The pipeline against the same steps done plainly on a small corpus."""

import itertools
import random

import numpy as np

import corpus_pipeline
from llm_helpers import SPACE, groups, linked, lower, sentence, shingle_set, words
from vidlake.llm import packing
from vidlake.llm.queries import tokenizer_path


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    texts = {}
    for k in range(120):
        body = " ".join(sentence(rng, 50))
        texts[k] = " ".join(w + "***" for w in body.split()) if k % 5 == 0 else body + ("\nShared line of many documents" if k % 3 == 0 else "")
    texts[200], texts[201], texts[202] = texts[1], texts[1] + " more", None
    item = " ".join(sentence(rng, 30))
    texts[203] = " ".join(sentence(rng, 40)) + " " + item.upper() + " " + " ".join(sentence(rng, 40))
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {k: t for k, t in texts.items() if len(SPACE.findall(t or "")) >= 10 and "***" not in t}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for t in kept.values():
        for x in {key(line) for line in t.split("\n")} - {""}:
            count[x] = count.get(x, 0) + 1
    kept = {k: "\n".join(line for line in t.split("\n") if count.get(key(line), 0) < 10) for k, t in kept.items()}
    ids, sets = list(kept), [shingle_set(t) for t in kept.values()]
    top = groups(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if linked(sets[a], sets[b])])
    kept = {k: t for n, (k, t) in enumerate(kept.items()) if top[n] == n}
    q = words(item)
    kept = {k: t for k, t in kept.items() if 100 * len(shingle_set(t) & shingle_set(item)) < 80 * (len(q) - 4)}
    assert 203 not in kept and 200 not in kept and 201 not in kept and 1 in kept and not any(k % 5 == 0 for k in kept if k < 120)

    encode, _ = packing.encoder(tokenizer_path())
    want = {k: [*encode(t).tolist(), 1] for k, t in kept.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == got.get(r.doc_id, 0)
        got[r.doc_id] = r.start + r.length
        import zlib

        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert got == {k: len(v) for k, v in want.items()}


KINDS = "doc_id long, text string, lang string, source string, n_chars long, gone string, n_lines int, kept boolean, component_id string"


def written(spark, place, docs, labels=True, items=True):
    spark.createDataFrame(docs, KINDS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs if d[0] is not None] if labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(0, "one item of the benchmark that nobody has ever written down " * 3)] if items else [], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")


def packed_tokens(spark, place):
    got = {}
    for r in corpus_pipeline.run(spark, str(place)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    return {k: sum(n for _, n in v) for k, v in got.items()}


def test_pipeline_of_empty_tables(spark, tmp_path):
    written(spark, tmp_path / "none", [], labels=False, items=False)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_of_repeats_nulls_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    texts = {k: " ".join(sentence(rng, 40)) for k in range(12)}
    clash = ("gone", 3, True, "c")
    row = lambda k, t: (k, t, "en", "s", 7, *clash)
    docs = [row(k, t) for k, t in texts.items()] + [row(3, texts[3]), row(None, texts[4] + " and more"), row(50, None), row(51, ""), row(52, "too short"), row(53, texts[0])]
    written(spark, tmp_path / "messy", docs)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, spark.read.parquet(f"{tmp_path}/messy/documents.parquet"), str(tmp_path / "messy"))
    assert first.columns == [c.split(" ")[0] for c in KINDS.split(", ")]
    rows = first.collect()
    # the short and empty ones go; a repeated row and one without a doc_id are rows of their own
    assert sorted(str(r.doc_id) for r in rows) == sorted([*map(str, texts), "3", "None", "53"]) and all(tuple(r)[5:] == clash for r in rows)
    got = packed_tokens(spark, tmp_path / "messy")
    encode, _ = packing.encoder(tokenizer_path())
    own = {k: len(encode(t)) + 1 for k, t in texts.items()}
    assert got == {**own, 3: 2 * own[3], None: len(encode(texts[4] + " and more")) + 1}
