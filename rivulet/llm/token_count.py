"""Token counts of whole texts by a two-tier lookup on the map side.

A SentencePiece BPE model whose pieces never hold a space mark after another character cannot
merge over the start of a space run, so a text's count is the sum over its pre-tokens (a run of
spaces and the characters up to the next run). Tier one is a broadcast table of the counts of
frequent pre-tokens: the word-initial pieces of the vocabulary, so its size is bounded by the
vocabulary. Tier two encodes what misses, once per worker, in a bounded cache. Pre-tokens are
never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"
#: Entries of a worker's cache, and the longest pre-token kept in it.
CACHE_ENTRIES, CACHE_CHARS = 1 << 18, 64
_PRE = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+$")
_PROCESSORS: dict = {}


def processor(path: str):
    import sentencepiece

    if path not in _PROCESSORS:
        _PROCESSORS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PROCESSORS[path]


def splits_at_spaces(path: str) -> bool:
    """Whether no piece holds a space mark after another character, and spaces are kept as they are."""
    sp = processor(path)
    inner = re.compile(f"[^{MARK}]{MARK}")
    plain = all(not inner.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    return plain and sp.encode("a  b") != sp.encode("a b") and sp.encode(" a") != sp.encode("a")


def frequent_lengths(path: str) -> dict[str, int]:
    """Tier one: counts of the vocabulary's word-initial pieces, without their space mark."""
    sp = processor(path)
    words = [p[1:] for p in map(sp.id_to_piece, range(sp.get_piece_size())) if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
    return dict(zip(words, map(len, sp.encode(words, num_threads=1)), strict=True))


class Lengths(dict):
    """Tier two: a pre-token (without one leading space) to its count; a bounded cache over the model."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.sp, self.bound = processor(path), len(frequent) + CACHE_ENTRIES

    def __missing__(self, word: str) -> int:
        if not word.strip(" " + MARK):  # only spaces, at a text's end
            n = len(self.sp.encode("x" + " " * (len(word) + 1))) - len(self.sp.encode("x"))
        else:
            n = len(self.sp.encode(word))
        if len(word) <= CACHE_CHARS and len(self) < self.bound:
            self[word] = n
        return n


def count_tokens(text: str | None, lengths: Lengths) -> int:
    if not text:
        return 0
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return sum(map(lengths.__getitem__, text.split(" ")))
    return sum(lengths[x[1:]] for x in _PRE.findall(" " + text))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    A null or empty text has 0 bytes and 0 tokens; null ids stay null; repeated rows give
    repeated rows; an empty table gives no rows; other columns are not read. Special strings in
    a text are ordinary text. A model that could merge over a space is encoded as whole texts.
    model_path must name the model on every machine.
    """
    spark = docs.sparkSession
    small_batches(spark)
    split = splits_at_spaces(model_path)
    table = spark.sparkContext.broadcast(frequent_lengths(model_path) if split else {})
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model_path, table.value) if split else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if split:
                n = [count_tokens(x, lengths) for x in texts]
            else:
                n = [len(processor(model_path).encode(x or "")) for x in texts]
            sizes = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
