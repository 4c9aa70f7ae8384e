"""Repair of conversations, encoding by pieces and clustering against plain versions on small messy tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from llm_helpers import sentence
from vidlake.llm import centroids, pieces, queries, repair

TALK = "conv_id long, turn long, role string, text string, part int, digest string, head int, n int, rank string"


def plain_ways(turns):
    """(cost, letters) least over every way of edits, by a table over turns and states: turns (initial, fault)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    at = {"": (0, "")}

    def put(into, state, way):
        into[state] = min(into.get(state, way), way)

    def inserting(now):
        for _ in range(3):
            for state, (cost, letters) in list(now.items()):
                for c in follow[state]:
                    if c != "s":
                        put(now, c, (cost + 5, letters + "I"))

    for initial, fault in turns:
        inserting(at)
        after = {}
        for state, (cost, letters) in at.items():
            put(after, state, (cost + 2, letters + "D"))
            if fault != "x":
                more = 5 if fault == "t" else 0
                for c in follow[state]:
                    if c == initial:
                        put(after, c, (cost + more, letters + "K"))
                    if c != "s":
                        put(after, c, (cost + more + 1, letters + "R"))
        at = after
    inserting(at)
    return min(at[s] for s in ("", "a") if s in at)


def every_way(turns):
    """The same by listing all sequences of edits, with at most one insertion a gap."""
    options = []
    for initial, fault in turns:
        own = [("", "D", 2)]
        if fault != "x":
            more = 5 if fault == "t" else 0
            own += [(initial, "K", more), ("u", "R", 1 + more), ("a", "R", 1 + more)]
        options += [[("", "", 0), ("u", "I", 5), ("a", "I", 5)], own]
    options.append([("", "", 0), ("u", "I", 5), ("a", "I", 5)])
    found = []
    for way in itertools.product(*options):
        if re.fullmatch("(s?(ua)+)?", "".join(w[0] for w in way)):
            found.append((sum(w[2] for w in way), "".join(w[1] for w in way)))
    return min(found)


def through_segments(turns, size):
    parts = [repair.segment_ways(turns[k : k + size]) for k in range(0, len(turns), size)]
    ways = repair.composed(parts)
    return min(ways[repair.START, q] for q in repair.DONE if (repair.START, q) in ways)


def test_search_is_least_of_every_way():
    rng = random.Random(3)
    for _ in range(150):
        turns = [(rng.choice("suuaaz"), rng.choice("...xt")) for _ in range(rng.randrange(5))]
        assert through_segments(turns, 24) == every_way(turns) == plain_ways(turns), turns


def test_segments_compose():
    rng = random.Random(4)
    for n in (7, 30, 95, 300):
        for _ in range(20):
            turns = [(rng.choice("suuaa"), rng.choice("...xt")) for _ in range(n)]
            assert through_segments(turns, 24) == through_segments(turns, 5) == plain_ways(turns)


def plain_report(rows, damage):
    """The report of conversations rows (conv_id, turn, role, text) by a walk over each."""
    out = []
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, copies = " " if role is None else role, " " if text is None else text, 1
            if damage:
                name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
                d = zlib.crc32(name.encode()) % 20
                if d == 0:
                    continue
                text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
                copies, role = 2 if d == 3 else 1, "user" if d == 4 else role
            own += [((turn is not None, turn or 0), role, text)] * copies
        own.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        counts, turns, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], {"": ".", "truncated": "t"}.get(fault, "x")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        known = {r[0][1] for r in own if r[0][0]}
        cost, audit = plain_ways(turns)
        left, state, left_rows = iter(audit), "", iter(own)
        said = []
        for letter in left:
            row = None if letter == "I" else next(left_rows)
            if letter != "D":
                c = row[1][:1] if letter == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                said.append((row[1] if letter == "K" else {"u": "user", "a": "assistant"}[c]) + ":" + (row[2] if row else ""))
                state = c
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice([None, "", " \n ", "Yes.", "No", "a" * 90 + rng.choice("xyz") + ".", "Wie? \t", "é　", "Ok!"])
            rows.append((conv, turn if rng.random() < 0.9 else None, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])  # a repeated row
            if rng.random() < 0.1:
                rows.append((conv, turn, "user", "Other. " * 3))  # a turn that ties
    rows += [(None, k, "user", f"t{k}.") for k in range(3)]
    rows += [(70, k, ("user", "assistant")[k % 2], f"Turn {k % 150}.") for k in range(400)]  # longer than segments and ranges
    rows += [(71, k // 40, "user", "same.") for k in range(200)]  # copies of one turn
    rows += [(72, 1, "user", "long " * 100_000 + "end."), (72, 2, "assistant", "x" * 300_000)]
    rows += [(73, 10**12, "assistant", "Late."), (73, -5, "user", "Early.")]
    return rows


def report(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("damage", [False, True])
def test_repair_report(spark, talks, damage):
    df = spark.createDataFrame([(*r, 1, "clash", 2, 3, "clash") for r in talks], TALK).repartition(5)
    got = report(repair.repair_report(df, repair.damaged(df) if damage else None))
    assert got == plain_report(talks, damage)


def test_repaired_turns(spark, talks):
    df = spark.createDataFrame([(*r, 1, "clash", 2, 3, "clash") for r in talks], TALK)
    said = {}
    for r in sorted(repair.repaired_turns(df).collect(), key=lambda r: (repr(r.conv_id), r.place)):
        said.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    want = {r[0]: r[8] for r in plain_report(talks, False)}
    for conv, lines in said.items():
        assert [p for p, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest() == want[conv]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(h == empty for conv, h in want.items() if conv not in said)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], TALK)
    assert repair.repair_report(df, repair.damaged(df)).collect() == []
    assert repair.repaired_turns(df).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 0, "", 0, 0, "")], TALK)
    assert report(repair.repair_report(df, repair.damaged(df))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_op11(spark, tmp_path, talks):
    spark.createDataFrame([(*r, 1, "clash", 2, 3, "clash") for r in talks], TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    assert report(queries.op11_conversation_repair(spark, str(tmp_path))) == plain_report(talks, True)


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    alphabet = " ▁\n\t\x00aeé漢☃1,.　​<s>ing"
    out = [None, "", " ", "   ", "\n", " \n ", "▁", "a▁b ▁ c", "<s></s>", "<0x0A>", "x" * 5000, "漢字" * 3000, " " * 4000 + "end", "a\r\nb"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    out += [" ".join(sentence(rng, 20_000)), "\n".join(" ".join(sentence(rng, 9)) for _ in range(300))]
    return out + out[14:20]


@pytest.mark.parametrize("block", [50, pieces.BLOCK])
def test_pieces(spark, texts, block):
    own = library()
    kinds = "doc_id long, text string, chunk string, code int, ids string, block string"
    rows = [(k, t, "clash", 1, "clash", "b") for k, t in enumerate(texts)] + [(None, "no name", None, None, None, None), (3, texts[3], "", 0, "", "")]
    df = spark.createDataFrame(rows, kinds).repartition(3)
    got = pieces.decode_pieces(pieces.encode_pieces(df, queries.piece_model_path(), block=block), queries.piece_model_path()).collect()
    want = []
    for r in rows:
        ids = own.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], ids, own.decode(ids)))
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got), key=repr) == sorted(want, key=repr)


def test_query_op12(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own, want = library(), []
    for k, t in enumerate(texts):
        ids = own.encode(t or "", add_bos=True, add_eos=True)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
    got = queries.op12_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op12_sentencepiece(spark, str(tmp_path / "none")).collect() == []


def test_chunks_are_cut_where_no_piece_reaches():
    m = pieces.MARK
    assert re.findall(pieces.chunk_pattern([f"{m}a", m, m * 2, "\n"]), f"{m}{m}ab{m}a\n{m}\nb") == [f"{m}{m}ab", f"{m}a", "\n", m, "\n", "b"]
    assert re.findall(pieces.chunk_pattern([f"{m}a", "b\n"]), f"{m}ab\n{m}a") == [f"{m}ab\n", f"{m}a"]
    assert re.findall(pieces.chunk_pattern([f"a{m}b"]), f"{m}a{m}b\nc") == [f"{m}a{m}b\nc"]


def plain_clusters(rows, k=16, rounds=3):
    kept = []
    for vec, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec, [math.floor(64 * float(np.float32(x))) for x in e]))
    name = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centre = [q for _, q in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        near = [min((far(q, c), i) for i, c in enumerate(centre)) for _, q in kept]
        if n == rounds:
            break
        for i in range(len(centre)):
            own = [q for (_, q), (_, c) in zip(kept, near) if c == i]
            if own:
                centre[i] = [sum(col) // len(own) for col in zip(*own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    by = [sum(d for d, c in near if c == i) for i in range(len(centre))]
    return sorted(((v, c, d, by[c], sum(by), digest[c]) for (v, _), (d, c) in zip(kept, near)), key=repr)


VECTORS = "vec_id long, embedding array<float>, q string, cluster string"


def messy_vectors():
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.2, 64).tolist()) for k in range(150)]
    rows += [(200 + k, [0.25 * (k % 3)] * 64) for k in range(30)]  # ties
    rows += [(7, rows[7][1]), (8, [0.0] * 64), (None, [1.5] * 64), (300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65)]
    rows += [(304, [float("nan")] + [0.0] * 63), (305, [float("inf")] + [0.0] * 63), (306, [None] + [0.0] * 63), (307, [-3000.0] * 64)]
    return rows


def test_centroids(spark):
    rows = messy_vectors()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(5)
    got = sorted(map(tuple, centroids.clusters_with_digests(df).collect()), key=repr)
    assert got == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = messy_vectors()[:n]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    assert sorted(map(tuple, centroids.clusters_with_digests(df).collect()), key=repr) == plain_clusters(rows)


def test_components_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, "", "")], VECTORS)
    with pytest.raises(ValueError, match="64 bits"):
        centroids.clusters_with_digests(df)


def test_query_op13_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_centroid_clustering(spark, sf).toArrow()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE["op13_centroid_clustering"]).to_arrow_table()
    plain = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in sorted(t.column_names))))
    assert sorted(got.column_names) == sorted(want.column_names) and plain(got) == plain(want)


def test_products_are_changed_by_what_moved_only():
    old = np.array([[1, 2, 3], [4, 5, 6]])
    new = np.array([[1, 0, 3], [4, 5, 6]])
    changes = centroids._changes(old, new)
    assert [a.tolist() for a, _ in changes] == [[1], []] and changes[0][1].tolist() == [-2]
