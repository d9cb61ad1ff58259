"""Exact Jaccard self-join on word shingles by PartEnum signatures.

Sets are dealt into bands of sizes. Two sets of Jaccard similarity t or more whose sizes end in
band i differ in at most k_i = 2 r_i (1 - t) / (1 + t) features, r_i being the band's largest
size. The feature domain is cut into n1 parts of n2 pieces each; a signature is a part and one of
the subsets of its pieces that leave out a single one, hashed over the features that lie there.
With n1 > k_i / 2 parts, some part of two similar sets differs in one piece at most, so they share
a signature. A set also signs for the next band if a similar set can lie there.

Three things keep the signatures selective and the join exact:
  - Features of very many sets (found by partial counts; any choice is exact) are left out of the
    domain, as that cannot raise the number of differences. n1 has slack, so a set normally has
    fewer signatures without features than a similar set must share with it; one of the shared
    signatures then has features, and empty ones are not needed. A set with too few features for
    that also signs each feature, and one with at most k_i signs over the full domain.
  - Sets are joined as classes of equal sets.
  - A signature's sets are first compared with its smallest class only. Where that leaves them in
    several components, pairs across components are compared, each where its first common signature
    is (the most shared one comes first), so no link between components is lost, groups of near
    copies never meet pair by pair, and a pair doesn't come once for each signature that it shares.
A pair is ruled out by parity sketches first (their difference never exceeds that of the sets);
what is left is decided on the full sets. Features and classes are 64-bit hashes that are taken
for what they stand for: two of 10^8 different sets are one class with a chance of 3 in 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _MIX, SHINGLE_WORDS, checkpoint, lean, mixed, release, shingle_sets, small_batches
from .components import connected_components

#: Ratio of the sizes of a band, pieces of a part, and the slack of the number of parts.
BAND, PIECES, SLACK = 1.5625, 3, 0.2
#: A feature that so many sets hold (as far as partial counts tell) is left out; at most so many are.
FREQUENT, MOST_FREQUENT, LOCAL = 64, 1 << 18, 2
#: Features that a task gathers before it counts or sends them.
FLUSH = 1 << 20
#: A signature of so many sets in one batch of a task is summed up there.
LOCAL_BUCKET = 32
#: Classes of at most so many rows are broadcast by their ids (8 bytes each).
BROADCAST_IDS = 200_000
BYTES_PER_PART = 1 << 20
#: Bytes of a signature that are sent besides its partition; a chance match is ruled out later.
SIG_BYTES = 5
#: Classes that a task reads at least where their sketches are sent, and pairs whose sets are.
CLASSES_A_FILE, PAIRS_A_FILE = 1 << 13, 1 << 12
#: Words of the parity sketch that is compared inside the join.
WORDS = 8
#: Signatures of a class that are carried along to find a pair's first common one.
CARRIED = 16


def _bands() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


BOUNDS = _bands()  # band i holds the sizes from BOUNDS[i] up to BOUNDS[i + 1] - 1


def _n_parts(df: DataFrame) -> int:
    """Partitions for signatures, by the size of the input as the plan states it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(64, min(1 << 20, size // BYTES_PER_PART)) if size < 1 << 60 else 4096


def _sketch(features: np.ndarray) -> bytes:
    """Parity of the features at each of 2^j bits, at least as many bits as features."""
    bits = max(64, 1 << int(len(features) - 1).bit_length())
    at = (features & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketch_difference(x: bytes, y: bytes) -> int:
    a, b = (np.frombuffer(s, np.uint64) for s in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # halves fold onto each other
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _words(features: np.ndarray) -> list[int]:
    """Parity of the features at each of 64 * WORDS bits."""
    at = (features >> np.uint64(32)) % np.uint64(64 * WORDS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _node(features: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed(features).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(features)) * _MIX)[0].astype(np.int64))


def _similar(x: int, y: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


class Frequent:
    """Membership in a sorted array of hashes, by a table of their first bits first."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.sorted >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.table[(h >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
            out[maybe] = self.sorted[at] == h[maybe]
        return out


def _parts(features: np.ndarray, tag: int, n1: int, n2: int, spared: int, domain: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes over each part without any `spared` of its n2 pieces, and how many features lie there."""
    keep = np.array([[0 if j in out else 1 for j in range(n2)] for out in combinations(range(n2), spared)])
    with np.errstate(over="ignore"):
        h = mixed(features + np.uint64(2 * tag + domain + 1) * _MIX)
        part = ((h >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
        piece = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32)
        cell = (part * np.uint64(n2) + piece).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, mixed(h))
        count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2) @ keep.T
        sums = (sums.reshape(n1, 1, n2) * keep.astype(np.uint64)).sum(2, dtype=np.uint64)
        name = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) + np.uint64((2 * tag + domain) << 40)
        return mixed(sums + mixed(name * _MIX)), count


def guaranteed(n1: int, k: int) -> int:
    """How many signatures two sets share that differ in k features at most: fewest if each part has its share of them."""
    return n1 * PIECES - k * (PIECES - 1) if k <= n1 else max(0, 2 * n1 - k)


def signatures(features: np.ndarray, frequent: Frequent, percent: int) -> np.ndarray:
    """The signatures of one set."""
    n = len(features)
    band = int(np.searchsorted(BOUNDS, n, side="right")) - 1
    tags = [band]
    if n * 100 >= BOUNDS[band + 1] * percent:  # a set of the next band's least size can be similar
        tags.append(band + 1)
    rare = features[~frequent(features)]
    out = []
    for tag in tags:
        most = int(BOUNDS[tag + 1] - 1)
        k = 2 * most * (100 - percent) // (100 + percent)
        if k == 0:  # equal sets are one class
            continue
        n1 = (k + int(k * SLACK) + 3) // 2
        h, count = _parts(rare, tag, n1, PIECES, 1, 0)
        out.append(h[count > 0])
        if (count == 0).sum() >= guaranteed(n1, k):  # all that a similar set must share may be empty ones
            with np.errstate(over="ignore"):
                out.append(mixed(rare[: k + 1] * _MIX + np.uint64(tag)))
            if len(rare) <= k:
                n1, n2, spared = (1, 2 * k + 1, k) if k <= 3 else (k // 3 + 1 + max(1, k // 20), 6, 2)
                h, count = _parts(features, tag, n1, n2, spared, 1)
                out.append(h.ravel() if (count == 0).any(axis=1).sum() >= n1 - k // (spared + 1) else h[count > 0])
    if not out:
        return np.empty(0, np.uint64)
    return np.unique(np.concatenate(out))


def _cut(sig: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of each signature, and SIG_BYTES bytes of it that follow; order is kept."""
    scaled = (sig >> np.uint64(32)) * np.uint64(parts)
    part = scaled >> np.uint64(32)
    rest = ((scaled & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | mixed(sig) >> np.uint64(32)
    return part, rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]


def _whole(parts: bytes, part: int) -> np.ndarray:
    """Signatures, unique over all partitions, from their bytes."""
    out = np.zeros((len(parts) // SIG_BYTES, 8), np.uint8)
    out[:, 8 - SIG_BYTES :] = np.frombuffer(parts, np.uint8).reshape(-1, SIG_BYTES)
    return out.view(">u8").ravel().astype(np.uint64) | np.uint64(part << (8 * SIG_BYTES))


def _whole_of(part: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rest), 8), np.uint8)
    out[:, 8 - SIG_BYTES :] = rest
    return out.view(">u8").ravel().astype(np.uint64) | part << np.uint64(8 * SIG_BYTES)


def _gathered(sets: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sets in lists of about FLUSH features."""
    held, size = [], 0
    for s in sets:
        held.append(s)
        size += len(s)
        if size >= FLUSH:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(_id, n, node, sketch, words, frequent): one row a document, and rows of frequent features (with a null node).

    node is a 64-bit hash of the set, null for a set without features.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            h, n = h[n >= LOCAL], n[n >= LOCAL]
            top = np.argsort(n)[::-1][: MOST_FREQUENT // 4]
            nothing = pa.nulls(len(top))
            return pa.RecordBatch.from_arrays([nothing.cast(id_type), pa.array(n[top], pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.binary()), nothing.cast(pa.list_(pa.int64())), pa.array(h[top].view(np.int64))], names=names)

        names = ["_id", "n", "node", "sketch", "words", "frequent"]
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            h, at = shingle_sets(batch.column(1).to_pylist(), width)
            nodes, sketches, words = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = h[a:b]
                node = _node(own) if b > a else None
                nodes.append(node)
                sketches.append(_sketch(own) if b > a else None)
                words.append(_words(own) if b > a else None)
                if b > a and node not in seen:
                    seen.add(node)
                    held.append(own)
                    size += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.nulls(len(nodes), pa.int64())], names=names)
            if size >= FLUSH:
                yield counted()
                held, size = [], 0
                seen.clear()
        if held:
            yield counted()

    return docs.select(id_col, text_col).mapInArrow(lean(classes), f"_id {kind}, n long, node long, sketch binary, words array<long>, frequent long")


def shared_signatures(docs: DataFrame, text_col: str, width: int, percent: int, frequent) -> DataFrame:
    """(sig, node) of the signatures that more than one class has; a few rows come twice."""
    parts = _n_parts(docs)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Frequent(np.array(frequent.value, np.int64).view(np.uint64)) if len(frequent.value) else (lambda h: np.zeros(len(h), bool))

        def sets() -> Iterator[np.ndarray]:
            for batch in batches:
                h, at = shingle_sets(batch.column(0).to_pylist(), width)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    if b > a:
                        yield h[a:b]

        for held in _gathered(sets()):
            sigs, owners, done = [], [], set()
            for own in held:
                node = _node(own)
                if node not in done:
                    done.add(node)
                    s = signatures(own, common, percent)
                    sigs.append(s)
                    owners.append(np.full(len(s), node, np.int64).view(np.uint64))
            sig, node = np.concatenate(sigs), np.concatenate(owners)
            if not len(sig):  # sets so small that only equal ones are similar
                continue
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            # What is known to be shared goes on as it is, in even portions; one of its classes stands for it.
            full = np.repeat(size >= LOCAL_BUCKET, size)
            lead = np.zeros(len(sig), bool)
            lead[start] = True
            part, rest = _cut(sig, parts)
            for kind, keep in ((0, ~full | lead), (1, full)):
                p, s, o = part[keep], rest[keep], node[keep]
                if kind:
                    s = np.ascontiguousarray(_whole_of(p, s))
                    p = mixed(o) % np.uint64(parts)
                    order = np.argsort(p, kind="stable")
                    p, s, o = p[order], s[order], o[order]
                cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, np.int64)
                ends = np.r_[cuts[1:], len(p)] if len(p) else cuts
                yield pa.RecordBatch.from_arrays([pa.array(p[cuts].astype(np.int64)), pa.array(np.full(len(cuts), kind == 1)), pa.array([s[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([o[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["part", "shared", "sigs", "nodes"])

    def met(group: pa.Table) -> pa.Table:
        shared = group.column("shared").to_pylist()
        part = group.column("part")[0].as_py()
        blobs = {(n, want): b"".join(x for x, s in zip(group.column(n).to_pylist(), shared, strict=True) if s == want) for n in ("sigs", "nodes") for want in (False, True)}
        sig, known = _whole(blobs["sigs", False], part), np.frombuffer(blobs["sigs", True], np.uint64)
        node, owner = (np.frombuffer(blobs["nodes", want], np.uint64) for want in (False, True))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])] if len(sig) else np.empty(0, bool)
        sig, node = sig[new], node[new]
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.table({"sig": np.concatenate([sig[keep], known]).view(np.int64), "node": np.concatenate([node[keep], owner]).view(np.int64)})

    blobs = docs.select(text_col).mapInArrow(lean(signed), "part long, shared boolean, sigs binary, nodes binary")
    return blobs.groupBy("part").applyInArrow(met, "sig long, node long")


def _verified(pairs: DataFrame, classes: DataFrame, n_classes: int, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    sizes = classes.select("node", "n", "sketch", "_id")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y, s, t in zip(na, nb, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                keep.append(_similar(x, y, min(x, y), percent) and _sketch_difference(s, t) * (100 + percent) <= (x + y) * (100 - percent))
            yield batch.select([0, 1, 6, 7]).filter(pa.array(keep, pa.bool_()))

    kind = classes.schema["_id"].dataType.simpleString()
    with_a = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("_id").alias("ia")), "a")
    with_b = with_a.join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("_id").alias("ib")), "b")
    left = checkpoint(with_b.select("a", "b", "na", "nb", "sa", "sb", "ia", "ib").mapInArrow(possible, f"a long, b long, ia {kind}, ib {kind}"), max(n_classes, pairs.count()), CLASSES_A_FILE)
    n = left.count()
    if not n:
        return left.select("a", "b")
    ids = left.select(F.col("ia").alias("_i"), F.col("a").alias("_n")).unionByName(left.select(F.col("ib").alias("_i"), F.col("b").alias("_n"))).distinct()
    ids = checkpoint(ids, 2 * n)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(wanted, "_i").select("_n", "_t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = shingle_sets(batch.column(1).to_pylist(), width)
            own = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            # Rows that share an id may hold other texts than the class's.
            right = pa.array([len(x) > 0 and _node(x) == n for x, n in zip(own, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in own], pa.binary())], names=["_n", "features"]).filter(right)

    full = texts.mapInArrow(lean(sets), "_n long, features binary").dropDuplicates(["_n"])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(_similar(len(x), len(y), both, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = left.select("a", "b").join(full.select(F.col("_n").alias("b"), F.col("features").alias("fb")), "b").join(full.select(F.col("_n").alias("a"), F.col("features").alias("fa")), "a")
    return checkpoint(joined.select("a", "b", "fa", "fb").mapInArrow(lean(decided), "a long, b long"), n, PAIRS_A_FILE)


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents under Jaccard similarity of word shingles: (id, n_shingles, component_id).

    Two documents link when 100 * intersection >= percent * union of their shingle sets; the
    component is the smallest id reachable by links. Null, empty and blank texts have no shingles
    and no links; null ids stay null, with their component's smallest id that isn't; repeated rows
    give repeated rows, and rows that share an id but not a text link each by its own text; an
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = checkpoint(shingle_classes(docs, id_col, text_col, width))
    top = rows.where("frequent IS NOT NULL").groupBy("frequent").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "frequent").limit(MOST_FREQUENT)
    frequent = spark.sparkContext.broadcast([r[0] for r in top.select("frequent").collect()])
    each = rows.where("frequent IS NULL").drop("frequent")
    classes = each.where("node IS NOT NULL AND _id IS NOT NULL").groupBy("node").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("words").alias("words"))
    classes = checkpoint(classes, each.count(), CLASSES_A_FILE)
    n_classes = classes.count()
    release(spark)
    shared = checkpoint(shared_signatures(docs.where(F.col(id_col).isNotNull()), text_col, width, percent, frequent))
    n_shared = shared.count()
    release(spark)

    centre = shared.groupBy("sig").agg(F.min("node").alias("a"))
    stars = shared.join(centre, "sig").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    first = _verified(checkpoint(stars, n_shared), classes, n_classes, docs, id_col, text_col, width, percent)
    n_first = first.count()
    found = connected_components(first, most=n_first)
    release(spark)
    # Where a signature's classes are still apart, they are compared across components.
    labelled = shared.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    apart = labelled.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high").select("sig", "size")
    # A pair meets at its first common signature in one order for all. None of those carried along
    # that come before it is common, so a pair that has one in common has met already.
    order = Window.partitionBy("node").orderBy(F.desc("size"), "sig")
    apart = labelled.join(apart, "sig").select("sig", "node", "c", "size").distinct()
    apart = apart.withColumn("place", F.row_number().over(order)).withColumn("first", F.collect_list(F.when(F.col("place") <= CARRIED, F.col("sig"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    apart = checkpoint(apart.select("sig", "node", "c", "first"), n_shared)
    info = classes.select("node", "n", *[F.get("words", k).alias(f"w{k}") for k in range(WORDS)])
    apart = apart.join(info, "node")
    x, y = (apart.select(*[F.col(c).alias(c if c == "sig" else f"{side}{c}") for c in apart.columns]) for side in "xy")
    differ = sum((F.bit_count(F.col(f"xw{k}").bitwiseXOR(F.col(f"yw{k}"))) for k in range(WORDS)), F.lit(0))
    total = F.col("xn") + F.col("yn")
    possible = (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent) & (differ * (100 + percent) <= total * (100 - percent))
    new = ~F.arrays_overlap("xfirst", "yfirst")
    across = x.join(y, (x["sig"] == y["sig"]) & (F.col("xnode") < F.col("ynode")) & (F.col("xc") != F.col("yc")) & possible & new)
    across = across.select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct()
    second = _verified(checkpoint(across), classes, n_classes, docs, id_col, text_col, width, percent)
    n_second = second.count()
    if n_second:
        found = connected_components(first.unionByName(second), most=n_first + n_second)
    # Components carry their smallest id; classes without links are their own.
    named = classes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "_id")
    smallest = named.groupBy("c").agg(F.min("_id").alias("component_id"))
    named = named.join(smallest, "c").select("node", "component_id")
    out = each.join(named, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))
