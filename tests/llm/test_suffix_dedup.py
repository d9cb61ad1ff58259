"""Removed repeats against a table of all windows, and the sort against sorted()."""

import hashlib
import random
import tracemalloc

import numpy as np
import psutil
import pyarrow as pa
import pytest

from rivulet.llm import suffix_dedup
from rivulet.llm.common import read

from .data import AWKWARD, SF, docs


def brute(rows):
    first = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i in sorted(raw):
        for p in range(len(raw[i]) - 49):
            first.setdefault(raw[i][p : p + 50], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, texts, ids=ids)).collect()}
    want = brute(list(zip(ids, texts, strict=True)))
    assert got == want, [(k, got[k], want[k]) for k in want if got[k] != want[k]][:5]
    return got


def pieces(seed, n):
    """Texts that share passages of about the shortest length, whole lines, and runs of one letter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60))[: rng.randint(40, 120)] for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, 12)
            parts += [word(), p[a : len(p) - rng.randint(0, 12)], rng.choice(["", "a" * rng.randint(0, 70), word()])]
        out.append(" ".join(parts))
    return out


def test_repeats_of_about_the_shortest_length(spark):
    texts = pieces(1, 150)
    got = check(spark, texts, random.Random(2).sample(range(10_000), len(texts)))
    assert any(0 < r[1] < r[0] for r in got.values())


def test_large_buckets_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", 4)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 200)
    check(spark, pieces(3, 120))


def test_awkward_and_real_texts(spark):
    rows = read(spark, SF, "documents").select("text").collect()
    check(spark, [r[0] for r in rows] + AWKWARD + ["same " * 30, "same " * 30])
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_rows_without_an_id(spark):
    text = "x" * 60
    got = suffix_dedup.remove_repeats(docs(spark, [text, text, text, text], ids=[None, 3, 3, 4])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (3, 0), (3, 0), (4, 60)]


def test_rows_that_share_an_id(spark):
    """Texts of one id are one document; each row loses what an earlier document has of its own text."""
    rng = random.Random(5)
    x, y, z = ("".join(rng.choice("abcdefgh") for _ in range(90)) for _ in "xyz")
    rows = [(7, x + y), (7, x), (7, None), (7, "short"), (7, x + y), (3, y), (3, None), (9, z + x), (9, y[:60]), (1, z), (1, z), (8, x[:49])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect())
    want = {(7, 180): (90, 1), (9, 180): (180, 1), (9, 60): (60, 1)}
    assert got == sorted((i, len(t or ""), *want.get((i, len(t or "")), (0, 0))) for i, t in rows)
    with pytest.raises(ValueError, match="whole numbers"):
        suffix_dedup.remove_repeats(docs(spark, ["a"]).selectExpr("'k' AS doc_id", "text"))


def test_one_passage_in_very_many_documents(spark, monkeypatch):
    """Large buckets are split by pivots, again and again, and rows stay below a window each."""
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", 3)
    rng = random.Random(6)
    letters = lambda n, of="ab": "".join(rng.choice(of) for _ in range(n))
    passage = letters(70, "abcdefghij")
    texts = [letters(rng.randint(0, 40)) + passage[rng.randint(0, 12) : 70 - rng.randint(0, 12)] + letters(rng.randint(0, 40)) for _ in range(150)]
    got = check(spark, texts, rng.sample(range(10_000), len(texts)))
    assert sum(r[1] > 0 for r in got.values()) > 100


@pytest.mark.parametrize("letters", [2, 250])
def test_deep_shallow_sort(letters):
    rng = np.random.default_rng(letters)
    strings = rng.integers(0, letters, (400, 50)).astype(np.uint8)
    strings[100:200, :40] = strings[0, :40]
    strings[200:230] = strings[5]
    group = rng.integers(0, 6, 400)
    order, lcp = suffix_dedup.deep_shallow_sort(group, strings)
    rows = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert rows == sorted((int(g), s.tobytes()) for g, s in zip(group, strings, strict=True))
    for k in range(1, 400):
        a, b = rows[k - 1], rows[k]
        want = next((j for j in range(50) if a[1][j] != b[1][j]), 50) if a[0] == b[0] else 0
        assert lcp[k] == want


def test_memory_of_a_partition():
    """Bytes that a worker takes for each anchor of a partition (17 or more are sent): arrays go as soon as they can."""
    anchor, _ = suffix_dedup._anchor(False)
    rows = np.zeros(200_000, anchor)
    rng = np.random.default_rng(1)
    rows["sig"], rows["around"], rows["doc"] = rng.integers(0, 2, (len(rows), 5)), rng.integers(0, 2, (len(rows), 6)), np.arange(len(rows))
    blobs = [rows[k : k + 1000].tobytes() for k in range(0, len(rows), 1000)]
    group = pa.table({"part": pa.array([3] * len(blobs), pa.int64()), "settled": [False] * len(blobs), "rows": blobs})
    tracemalloc.start()
    try:
        out = suffix_dedup._bucketed(False)(group)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == len(rows) and out.column("bucket").null_count == len(rows) - 2**11
    assert peak < 90 * len(rows)


def test_workers_give_their_memory_back(spark):
    """What a worker holds once it has sent a million anchors and more; before, some hundred MB."""
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(97, 123, 80_000))) for _ in range(250)]
    held = lambda: {p.pid: p.memory_full_info().uss for p in psutil.process_iter(["cmdline"]) if "pyspark.daemon" in (p.info["cmdline"] or [])}
    before = held()
    suffix_dedup._sampled(docs(spark, texts).selectExpr("doc_id AS _d", "0L AS _o", "text AS _t").coalesce(1), 64, False).write.format("noop").mode("overwrite").save()
    assert max(n - before.get(p, 0) for p, n in held().items()) < 100 << 20
