"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of the characters of a word, with interpolated Kneser-Ney smoothing: the
highest order counts tokens of the class's own documents, the one below it the characters that
its sequences follow there, and both back off to shared orders that are counted over all
documents, labelled or not, so a rare expression is judged by what both classes share. A word's evidence is by how much its log-likelihood under the toxic model exceeds
that under the ordinary one, beyond a margin that sampling noise rarely passes and up to a
bound; a document's is normalised by its number of words (a few more, so that one word of a very
short text doesn't decide). A logistic curve of its square root, fitted on labelled documents
kept out of the counts, turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean, release, small_batches, trim

#: Characters of the highest shared order and of the highest order; a class's own orders are the two above the shared ones.
SHARED_ORDER = 4
ORDER = SHARED_ORDER + 2
DISCOUNT = 0.75
#: At most so many labelled documents of each class are fitted, those with the smallest hashes.
MAX_PER_CLASS = 6_000
#: One in so many of them is kept out of the counts, for the logistic curve.
HELD = 4
#: Margin and bound of a word's evidence, in nats, and the words added to a text's number.
MARGIN, MOST, MORE_WORDS = 3.0, 8.0, 8
#: Distinct words a worker holds at once.
WORDS_HELD = 300_000
_WORD = re.compile(r"\w+")
START, END = "\x02", "\x03"


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(id_col.cast("string")) % 4 == 2


def _grams(words: Counter, order: int) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        padded = START + word + END
        for i in range(2, len(padded) + 1):
            out[padded[max(0, i - order) : i]] += n
    return out


def _counted(df: DataFrame, order: int) -> DataFrame:
    """(kind, gram, n) over (kind, text): partial counts in each task, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for kind, words in held.items():
                grams = _grams(words, order)
                keys = list(grams)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array([grams[k] for k in keys], pa.int64())], names=["kind", "gram", "n"])
            held.clear()

        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(kind, Counter()).update(_WORD.findall(text.lower()))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from send()
        yield from send()

    return df.mapInArrow(lean(count), "kind int, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def _ending(gram: str) -> str:
    """What the shared orders are asked for where a class's own orders don't hold a sequence."""
    return gram.removeprefix(START)[-SHARED_ORDER:]


def _shared_counts(texts: DataFrame, endings: set[str]) -> tuple[dict[str, tuple], float]:
    """Shared counts of the endings and their own endings, {gram: (n, total of its context, types of its context)}, and the floor."""
    spark = texts.sparkSession
    level = checkpoint(_counted(texts.select(F.lit(0).alias("kind"), "text"), SHARED_ORDER).select("gram", "n"))
    wanted = spark.createDataFrame(pa.table({"w": pa.array(sorted(endings), pa.string())}))
    found = []
    for k in range(SHARED_ORDER, 0, -1):
        if k < SHARED_ORDER:  # types before a sequence, not its tokens
            level = checkpoint(level.groupBy(F.substring("gram", -k, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        context = F.expr("substring(gram, 1, length(gram) - 1)")
        contexts = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        need = wanted.where(F.length("w") >= k).select(F.substring("w", -k, k).alias("gram")).distinct()
        need = need.join(level, "gram", "left").withColumn("context", context).join(contexts, "context", "left")
        found.append(need.select("gram", "n", "total", "types"))
    out: dict[str, tuple] = {}
    for part in found:
        rows = part.toArrow()
        out |= {g: tuple(x) for g, *x in zip(*(rows.column(c).to_pylist() for c in ("gram", "n", "total", "types")), strict=True)}
    return out, 1.0 / (level.count() + 1)


class KneserNey:
    """Ratios of two classes' interpolated Kneser-Ney probabilities of a character after those before it."""

    def __init__(self, shared: dict[str, tuple], floor: float, own: list[dict[str, int]]):
        self.shared: dict[str, float] = {}
        self.shared_rest: dict[str, float] = {}
        self.floor = floor
        for g in sorted(shared, key=len):
            n, total, types = shared[g]
            if total:
                rest = self.shared_rest[g[:-1]] = DISCOUNT * types / total
                if n:
                    self.shared[g] = (n - DISCOUNT) / total + rest * self._shared(g[1:])
        self.own: list[dict[str, float]] = [{} for _ in own]
        self.own_rest: list[dict[str, float]] = [{} for _ in own]
        for c, grams in enumerate(own):
            self._add(Counter(g[1:] for g in grams if len(g) == ORDER), c)  # types before a sequence, not its tokens
            self._add(grams, c)
            grams.clear()  # the counts are used up
        # Where neither class holds a sequence the ratio is that of their rests times that of its ending.
        self.ratio = {g: self._compared(g) for probs in self.own for g in probs}
        rests = {h: math.log(self.own_rest[1].get(h, 1.0) / self.own_rest[0].get(h, 1.0)) for h in self.own_rest[0].keys() | self.own_rest[1].keys()}
        self.rest = {h: x for h, x in rests.items() if x}
        del self.shared, self.shared_rest, self.own, self.own_rest

    def _add(self, counts: dict[str, int], c: int) -> None:
        total: dict[str, int] = {}
        types: dict[str, int] = {}
        for g, n in counts.items():
            total[g[:-1]] = total.get(g[:-1], 0) + n
            types[g[:-1]] = types.get(g[:-1], 0) + 1
        new = {}
        for g, n in counts.items():
            p, rest = self._own(c, g[1:])
            lower = rest * self._shared(_ending(g)) if p is None else p
            new[g] = (n - DISCOUNT) / total[g[:-1]] + DISCOUNT * types[g[:-1]] / total[g[:-1]] * lower
        self.own[c] |= new
        self.own_rest[c] |= {h: DISCOUNT * types[h] / total[h] for h in total}

    def _shared(self, g: str) -> float:
        """The probability by the shared orders: whole only for endings of own sequences."""
        rest = 1.0
        while g:
            p = self.shared.get(g)
            if p is not None:
                return rest * p
            rest *= self.shared_rest.get(g[:-1], 1.0)
            g = g[1:]
        return rest * self.floor

    def _own(self, c: int, g: str) -> tuple[float | None, float]:
        """The probability by a class's own orders, or None and the weight of the shared one."""
        rest, probs, rests = 1.0, self.own[c], self.own_rest[c]
        while len(g) > SHARED_ORDER or (g and g[0] == START):
            p = probs.get(g)
            if p is not None:
                return rest * p, 0.0
            rest *= rests.get(g[:-1], 1.0)
            g = g[1:]
        return None, rest

    def _compared(self, g: str) -> float:
        """log p(class 1) - log p(class 0) of a sequence that one of them holds."""
        (p1, rest1), (p0, rest0) = self._own(1, g), self._own(0, g)
        both = self._shared(_ending(g)) if p1 is None or p0 is None else 0.0
        return math.log((rest1 * both if p1 is None else p1) / (rest0 * both if p0 is None else p0))

    def evidence(self, word: str) -> float:
        """log p(word | class 1) - log p(word | class 0), above the margin and up to the bound."""
        padded = START + word + END
        total, ratio, rest = 0.0, self.ratio.get, self.rest.get
        for i in range(2, len(padded) + 1):
            k = max(0, i - ORDER)
            while i - k > SHARED_ORDER or k == 0:
                x = ratio(padded[k:i])
                if x is not None:
                    total += x
                    break
                total += rest(padded[k : i - 1], 0.0)
                k += 1
        return max(0.0, min(MOST, total) - MARGIN)


class Evidence(dict):
    """Words' evidence, kept for a bounded number of words."""

    def __init__(self, model: KneserNey):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = self.model.evidence(word)
        return value

    def of(self, text: str | None) -> float:
        words = _WORD.findall(text.lower()) if text else []
        return math.sqrt(sum(map(self.__getitem__, words)) / (len(words) + MORE_WORDS))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small penalty; the slope isn't negative."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3, z.T @ (y - p) - w * 1e-3)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


class ToxicityModel:
    """The curve of a score, and the word model as it was sent to the workers: it is sent once."""

    def __init__(self, given: Broadcast, slope: float, offset: float):
        self.given, self.slope, self.offset = given, slope, offset

    @property
    def model(self) -> KneserNey:
        return self.given.value

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows that aren't held out, and on all texts for the shared orders.

    Rows with a null id or label are not learned from. Without labelled rows of both classes
    every score is that of the offset alone.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("kind")).where(F.col("_l").isNotNull() & F.col("kind").isin(0, 1) & ~held_out(F.col("_l")))
    picked = [known.where(F.col("kind") == k).orderBy(F.xxhash64("_l"), "_l").limit(MAX_PER_CLASS) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * MAX_PER_CLASS rows
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_i") == F.col("_l"))
    kept_out = F.pmod(F.xxhash64(F.concat(F.lit("curve:"), F.col("_i").cast("string"))), F.lit(HELD)) == 0
    own_rows = _counted(sample.where(~kept_out).select("kind", "text"), ORDER).toArrow()
    own: list[dict[str, int]] = [{}, {}]
    for batch in own_rows.to_batches(max_chunksize=10_000):
        for kind, gram, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "gram", "n")), strict=True):
            own[kind][gram] = n
    del own_rows
    trim()
    release(docs.sparkSession)  # the driver's memory is small beside the counts
    shared, floor = _shared_counts(texts, {_ending(g) for grams in own for g in grams})
    model = KneserNey(shared, floor, own)
    del own, shared
    given = docs.sparkSession.sparkContext.broadcast(model)
    del model
    trim()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(given.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([evidence.of(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["kind", "x"])

    curve = sample.where(kept_out).select("kind", "text").mapInArrow(lean(weigh), "kind int, x double").toArrow()
    y, x = curve.column("kind").to_numpy().astype(float), curve.column("x").to_numpy()
    order = np.lexsort((x, y))
    slope, offset = _curve(x[order], y[order]) if 0 < y.sum() < len(y) else (0.0, -2.2)
    # The sample holds more of the rarer class than the labels do; the offset goes back to their shares.
    counts = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    drawn = {k: min(MAX_PER_CLASS, n) for k, n in counts.items()}
    if len(counts) == 2:
        offset += math.log(counts[1] / counts[0]) - math.log(drawn[1] / drawn[0])
    return ToxicityModel(given, slope, offset)


def toxicity_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """A column with the score (0 to 1) of a whole text; null, empty and wordless texts have that of no evidence."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence = Evidence(model.model)
        for part in parts:
            yield pd.Series([model.score(evidence.of(t)) for t in part], dtype="float64")
        evidence.clear()
        trim()

    return score(F.col(text_col))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    Null and empty texts have the score of no evidence; rows with a null id aren't held out;
    repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
    """
    out = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), toxicity_score(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
