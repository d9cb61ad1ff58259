"""Each stage of the pipeline against a plain version of its decision, on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import mixing, toxicity
from rivulet.llm.common import checkpoint, read

from .data import AWKWARD, SF, docs
from .test_decontamination import brute as leaks
from .test_jaccard_join import brute as components
from .test_jaccard_join import files_written, near_copies


def test_stages(spark):
    docs = read(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = checkpoint(stage(spark, docs, SF))
        after = docs.collect()
        kept[name] = ([r.doc_id for r in before], [r.doc_id for r in after])
        if name != names[-1]:
            assert docs.columns == read(spark, SF, "documents").columns
        text = {r.doc_id: r.text for r in before}
        if name == "toxicity":
            model = toxicity.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
            own = toxicity.Evidence(model.model)
            want = {i for i, t in text.items() if model.score(own.of(t)) < 0.3}
        elif name == "ngram_jaccard_join":
            want = {i for i, (_, c) in components(list(text), list(text.values())).items() if c == i}
        elif name == "benchmark_decontamination":
            items = [r.text for r in read(spark, SF, "benchmark").collect()]
            want = set(text) - {list(text)[d] for d, _ in leaks(list(text.values()), items)}
        elif name == "source_mixing":
            size = {i: len(t.split()) for i, t in text.items()}
            total = sum(size.values())
            assert abs(sum(size[r.doc_id] for r in after) - total) < 0.1 * total
            assert max(kept[name][1].count(i) for i in set(kept[name][1])) <= 3
            continue
        else:
            want = set(text)
        assert set(kept[name][1]) == want, name
    assert sorted(kept["sharding"][0]) == sorted(kept["sharding"][1])


def test_null_and_repeated_ids(spark):
    """Each row is mixed by its own plan, and one row of a repeated id stays in the near-copy stage."""
    texts = [f"{'a b c ' * (i % 7 + 1)}{'9' * (i % 11)} {i}" for i in range(80)] + ["", None]
    ids = [None if i % 2 else (7 if i % 4 else i) for i in range(80)] + [None, 7]
    d = docs(spark, texts, sources=["x" if i < 60 else "y" for i in range(82)], ids=ids)
    plan = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix_plan(d, corpus_pipeline.WEIGHTS).collect()), key=str)
    want = Counter((i, size) for i, size, taken in plan for _ in range(taken // size if size else 1))
    runs = [corpus_pipeline.mix_sources(spark, x, SF).collect() for x in (d, d.repartition(5))]
    assert Counter((r.doc_id, len((r.text or "").split())) for r in runs[0]) == want
    assert Counter(runs[0]) == Counter(runs[1])
    words = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(3)]
    d = docs(spark, [words[0], words[0], words[1], words[1], words[2], None, None], ids=[4, 4, None, None, 4, 4, 6])
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, d, SF).collect()), key=str)
    assert got == sorted([(4, words[0]), (None, words[1]), (None, words[1]), (4, None), (6, None)], key=str)


CLASH = {"_h": "h", "_s": "s", "_p0": "p", "_leak": "l", "_id": "i", "_copy": "c", "_score": "0.9", "_again": "a", "_row": "r", "_times": "t", "row": "w", "_x_h": "y", "a.b": "d", "size": "z", "key": "k"}


def clashing(spark, texts, ids):
    d = docs(spark, texts, ids=ids).drop("_h", "size")
    return d.withColumns({c: F.concat(F.lit(f"{v}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.length(F.coalesce("text", F.lit("")))) for c, v in CLASH.items()})


def test_clashing_columns_keep_their_values(spark):
    words = [" ".join(f"w{i}x{k}" for k in range(30 + i)) for i in range(12)]
    d = checkpoint(clashing(spark, [*words, None, "", " ", words[0], words[0]], [*range(12), 12, None, None, 12, 0]))
    given = Counter(d.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        assert out.columns[: len(d.columns)] == d.columns, name
        got = Counter(out.select([F.col(f"`{c}`") for c in d.columns]).collect())
        assert got and set(got) <= set(given), name
        if name in ("toxicity", "benchmark_decontamination", "sharding"):
            assert got == given, name


def test_empty_and_awkward_tables(spark):
    for texts in ([], AWKWARD):
        d = clashing(spark, texts, [None if i % 5 == 4 else i // 2 for i in range(len(texts))])
        for _, stage in corpus_pipeline.STAGES:
            d = checkpoint(stage(spark, d, SF))
        assert (d.count() > 0) == bool(texts) and set(CLASH) < set(d.columns)


def test_near_copies_write_few_files(spark):
    """While a file's processes start, an executor shows its memory twice: at 64 shuffle partitions most tables of the stage are one file."""
    table = docs(spark, near_copies(11, 60, 300))
    n = files_written(spark, lambda: corpus_pipeline.drop_near_copies(spark, table, "").count())
    assert len(n) > 10 and sum(n) < 20 * len(n), n
