"""Toxicity on held-out labels, and rows without words."""

import math
from collections import Counter

from pyspark.sql import functions as F

from rivulet.llm import toxicity
from rivulet.llm.common import read

from .data import docs


def test_held_out_english(spark):
    d, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.fit(d, labels)
    out = toxicity.score_toxicity(d.where("lang = 'en'"), model).join(labels, "doc_id").where("held_out").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in out if a.toxic for b in out if not b.toxic]
    assert sum(pairs) / len(pairs) > 0.9
    rows = toxicity.score_toxicity(docs(spark, [None, "", " ", "a" * 50_000], ids=[None, 1, 1, 2]), model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)


def plain(own_words, all_words):
    """The evidence of a word with every count in whole tables; END and START as in the module."""
    shared = {4: toxicity._grams(all_words, 4)}
    for k in (3, 2, 1):
        shared[k] = Counter(g[-k:] for g in shared[k + 1])
    tables = [{6: x, 5: Counter(g[1:] for g in x if len(g) == 6)} for x in (toxicity._grams(w, 6) for w in own_words)]

    def smoothed(table, g, lower):
        seen = [n for h, n in table.items() if h[:-1] == g[:-1]]
        return (max(table.get(g, 0) - 0.75, 0) + 0.75 * len(seen) * lower) / sum(seen) if seen else lower

    def common(g):
        return smoothed(shared[len(g)], g, common(g[1:])) if g else 1 / (len(shared[1]) + 1)

    def own(c, g):
        if len(g) <= 4 and g[0] != toxicity.START:
            return common(g)
        return smoothed(tables[c][5 if len(g) == 5 and g[0] != toxicity.START else 6], g, own(c, g[1:]))

    def evidence(word):
        padded = toxicity.START + word + toxicity.END
        parts = [padded[max(0, i - 6) : i] for i in range(2, len(padded) + 1)]
        return max(0, min(8, sum(math.log(own(1, g) / own(0, g)) for g in parts)) - 3)

    return evidence


def test_rare_sequences_count(spark):
    """Sequences seen once or twice, in a class or in all texts, count as in whole tables."""
    texts = [f"common words stay here {'grobian' if i % 2 else 'gentle'} {chr(97 + i % 26)}{chr(97 + i // 26)}qu{i}zed" for i in range(60)] + ["grobianx zebra unlabelled", "word", None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    learned = F.pmod(F.xxhash64(F.concat(F.lit("curve:"), F.col("doc_id").cast("string"))), F.lit(toxicity.HELD)) != 0
    ids = {r.doc_id for r in d.where(learned & ~toxicity.held_out(F.col("doc_id"))).collect()}
    own = [Counter(w for i in ids if i < 60 and i % 2 == c for w in texts[i].split()) for c in (0, 1)]
    want = plain(own, Counter(w for t in texts for w in (t or "").split()))
    model = toxicity.fit(d, labels).model
    words = sorted(set(" ".join(t or "" for t in texts).split())) + ["grobianism", "gro", "gentleman", "neverseen", "a", "ß字"]
    assert any(want(w) > 0 for w in words)
    wrong = [(w, want(w), model.evidence(w)) for w in words if abs(want(w) - model.evidence(w)) > 1e-9]
    assert not wrong, wrong[:9]
