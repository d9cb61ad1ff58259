"""The Jaccard join against all pairs of sets of strings."""

import random
import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from rivulet.llm import jaccard_join
from rivulet.llm.common import checkpoint, read
from rivulet.llm.components import connected_components

from .data import AWKWARD, SF, docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: (len(sets[i]), least[find(i)]) for i, x in enumerate(ids)}


def check(spark, texts, ids=None, **kw):
    ids = ids or list(range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts, ids=ids), **kw).collect()}
    want = brute(ids, texts)
    assert {k: v for k, v in got.items() if want[k] != v} == {} and len(got) == len(want)
    return got


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def near_copies(seed, n_groups, most_words):
    """Groups of edited copies around the threshold, some of them chains, and a passage that many texts share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for g in range(n_groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, most_words))]
        if g % 2:
            at = rng.randrange(len(words))
            words[at:at] = passage
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(words))
            words = edited(rng, words, rng.randint(0, 1 + len(words) // 40)) + [f"t{g}"] * rng.randint(0, 2)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(spark, seed):
    got = check(spark, near_copies(seed, 60, 300))
    assert len({c for _, c in got.values()}) < len(got)


def test_short_texts(spark):
    check(spark, near_copies(3, 150, 12) + AWKWARD + ["A b C d e f", "a B c d e f", "a b c d e"])


def test_frequent_features_are_left_out_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "LOCAL", 1)
    monkeypatch.setattr(jaccard_join, "LOCAL_BUCKET", 4)
    check(spark, near_copies(4, 50, 120))


def test_real_rows_in_reverse(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    check(spark, [r.text for r in rows], [1000 - r.doc_id for r in rows])


def test_texts_without_signatures(spark):
    assert check(spark, ["one", "one two", None, "one", "three"])[3] == (1, 0)


def test_empty_table(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    """Each text links by itself: the link of 3 is with the other text of id 1."""
    rng = random.Random(8)
    x, y = ([f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in "xy")
    texts = [" ".join(w) for w in (x, y, edited(rng, x, 2), edited(rng, y, 2))]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts, ids=[1, 1, 2, 3])).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_group_of_unlike_members(spark, monkeypatch):
    """Copies of one text, edited until most of them link with few others: the pairs that meet are few more than the pairs there are."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(edited(rng, base, rng.choice([4, 8, 9, 10, 12, 16]))) for _ in range(120)]
    met = []
    verified = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a))
    got = check(spark, texts)
    assert 1 < len({c for _, c in got.values()}) < 120
    assert met[1] <= 120 * 119 / 2


@pytest.mark.parametrize("percent", [70, 80, 95])
def test_signatures_of_similar_sets(percent):
    """Similar sets share at least as many signatures as is guaranteed; both kinds of fallback included."""
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = rng.random(len(own)) >= rng.choice([0.02, 0.05, 0.1])
        other = np.unique(np.concatenate([own[cut], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)]))
        both = len(np.intersect1d(own, other))
        if not 0 < both < len(own) + len(other) - both or 100 * both < percent * (len(own) + len(other) - both):
            continue
        some = own[rng.random(len(own)) < rng.choice([0, 0.5, 0.95])]
        common = jaccard_join.Frequent(some) if len(some) else (lambda h: np.zeros(len(h), bool))
        assert len(np.intersect1d(*(jaccard_join.signatures(s, common, percent) for s in (own, other))))


def files_written(spark, work):
    """Part files of each checkpointed table that work writes while there are many shuffle partitions."""
    checkpoint(spark.range(1))  # the folder is there now
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    old, conf = set(folder.iterdir()), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        work()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return sorted(len(list(t.glob("part-*"))) for t in set(folder.iterdir()) - old)


def test_small_tables_are_few_files(spark):
    """Each local file costs an executor two processes: what is known to be small isn't dealt to a file a shuffle partition."""
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000 + k, 2000) for k in range(100)], "a long, b long")
    found = {}
    files = files_written(spark, lambda: found.update((r.node, r.component) for r in connected_components(links, most=400).collect()))
    assert found == {k: 0 for k in range(1, 301)} | {k: 1000 for k in [*range(1001, 1100), 2000]}
    assert set(files) == {1}
    files = files_written(spark, lambda: check(spark, near_copies(10, 60, 300)))
    assert sum(n > 1 for n in files) <= 3, files  # rows by document, shared signatures, pairs across components
