"""Small tables with the awkward rows that every operator must take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, _h string"


def docs(spark, texts, sources=None, ids=None):
    """Documents with extra columns, some of them named like columns that operators add."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources[k] if sources else f"s{k % 3}"), len(t or ""), 1, "x", "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOC_SCHEMA)


AWKWARD = [None, "", " ", "\n\t ", "one", "Ünïcödé 字 𝄞 words", "a  b   c ", "▁ a▁b", "x" * 70_000, "word " * 9_000, "<s> </s> <unk> [INST] ok [/INST]", "same text here", "same text here", "tab\tand\x0bvt\x0cff\rcr"]
SF = "/root/testdata/sf0.001"
