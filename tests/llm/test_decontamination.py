"""Leaks against the best of all item-sized windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontamination
from rivulet.llm.common import read

from .data import AWKWARD, SF, docs


def grams(words):
    wide = min(5, len(words))
    return Counter(tuple(words[i : i + wide]) for i in range(len(words) - wide + 1)) if words else Counter()


def brute(texts, items):
    """{(document, item): best weighted similarity} over windows of the item's length (the whole text if it is shorter)."""
    out = {}
    for d, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        for i, item in enumerate(items):
            own = (item or "").lower().split()
            want = grams(own)
            if not want or not words:
                continue
            for s in range(max(1, len(words) - len(own) + 1)):
                have = grams(words[s : s + len(own)])
                low = sum((want & have).values())
                if low * 100 >= 80 * sum((want | have).values()):
                    out[d, i] = max(out.get((d, i), 0), low / sum((want | have).values()))
    return out


def test_leaks_against_all_windows(spark):
    rng = random.Random(7)
    items = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 60))) for _ in range(25)] + [None, "", "  ", "w1", "Alpha beta", "a a a a a a a a a a a"]
    texts = [t for t in AWKWARD if len(t or "") < 30_000] + ["word " * 700]
    for k in range(150):
        own = (items[k % 25]).split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "edit"
        if k % 5 == 0:
            own = own[: len(own) // 2]
        around = [[f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 40))] for _ in range(2)]
        texts.append(" ".join(around[0] + own + around[1]).upper() if k % 7 == 0 else "\n".join(around[0] + own + around[1]))
    texts += ["say ALPHA\tBeta now", "b a a a a a a a a a a a", items[3], items[3]]
    bench = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(items)], "item_id long, text string, _n long, start_word string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    want = brute(texts, items)
    assert len(want) > 50
    assert set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.02 * len(want), sorted(set(want) - set(got))[:9]
    same = [k for k in got if got[k] == pytest.approx(want[k])]
    assert len(same) >= 0.98 * len(got)
    clean = {r.doc_id for r in decontamination.clean(docs(spark, texts), bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}


def test_real_items(spark):
    bench, d = read(spark, SF, "benchmark"), read(spark, SF, "documents")
    items = [r.text for r in bench.orderBy("item_id").collect()]
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, bench).collect()}
    whole = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if x in t}
    assert whole <= got


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find_leaks(docs(spark, []), bench).count() == 0
    assert decontamination.find_leaks(docs(spark, ["a b c d e f"]), bench.limit(0)).count() == 0
    assert decontamination.find_leaks(docs(spark, ["a b c d e f"], ids=[None]), bench).count() == 1


def test_fingerprints(spark):
    rows = spark.range(1).select(decontamination.simhash(F.array(F.lit(-1).cast("long"), F.lit(5).cast("long"), F.lit(4).cast("long"))).alias("h")).collect()
    assert rows[0].h == 5
