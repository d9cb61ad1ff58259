"""Near-duplicate embeddings by sorted projection passes.

A pass gives each vector the concatenated bits of random projections and orders the vectors of a
label by them; a vector is compared with a bounded number of neighbours in that order. Verified
pairs of all passes are united. In a crowded label more vectors than that stand between two
linked ones, so all pairs of a label are then compared, in blocks of its vectors: that counts the
links, and unites the components that the passes left apart. Pairs are never emitted, only stars
of components. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches
from .components import connected_components

#: Passes, bits of a pass's key, neighbours on one side, and vectors of a block.
PASSES, BITS, WINDOW, BLOCK = 16, 48, 24, 1024


def _unit(values: list | None) -> np.ndarray | None:
    """A vector of length 1 in double precision; None for vectors that link with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # lengths neither overflow nor vanish
    return x / np.sqrt(x @ x)


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, BITS))


def _keys(x: np.ndarray, number: int) -> np.ndarray:
    bits = x @ _planes(x.shape[1], number) > 0
    return (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(1)


def _unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable position of each of n, by links between positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def embedding_links(vectors: DataFrame, threshold: float = 0.98, passes: int = PASSES, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): the links of every vector at cosine >= threshold.

    Vectors are compared only where their labels are equal and not null and their dimensions
    agree; vectors that are null, empty or zero or hold null or non-finite components, and rows
    without an id, link with nothing. Equal vectors of a label link with each other. n_links
    counts other rows, so repeated rows count too; component_id is the smallest id reachable by
    links, itself included. An empty table gives no rows; other columns are not read.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_l"), F.col(vector_col).alias("_v"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            units = [_unit(v) if i is not None and label is not None else None for i, label, v in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], names=["_id", "_l", "_v"])

    rows = checkpoint(rows.mapInArrow(parsed, f"_id {kind}, _l string, _v binary").withColumn("_c", F.when(F.col("_v").isNotNull(), F.xxhash64("_l", "_v"))))
    classes = rows.where("_c IS NOT NULL").groupBy("_c").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("_l").alias("_l"), F.first("_v").alias("_v"))
    classes = checkpoint(classes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pa.table({"_c": batch.column(0), "_l": batch.column(1), "_v": batch.column(2)}).to_pandas()
            for size, part in frame.groupby(frame["_v"].map(len)):
                x = _unpack(part["_v"].tolist())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(part["_l"].map(lambda s, p=p, size=size: f"{size}:{p}:{s}"), pa.string()), pa.array(_keys(x, p)), pa.array(part["_c"]), pa.array(part["_v"], pa.binary())], names=["pass", "key", "_c", "_v"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links in stars around the first vector of what a stretch of the order connects."""
        names, ids, blobs = [], [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            ids += batch.column(2).to_pylist()
            blobs += batch.column(3).to_pylist()
            if len(ids) >= 4096:
                yield from stretch(names, ids, blobs)
                names, ids, blobs = names[-window:], ids[-window:], blobs[-window:]
        yield from stretch(names, ids, blobs)

    def stretch(names: list, ids: list, blobs: list) -> Iterator[pa.RecordBatch]:
        names, ids = np.array(names, object), np.array(ids, np.int64)
        cuts = [*np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)] if len(names) else []
        for a, b in zip([0, *cuts], cuts, strict=False):
            x = _unpack(blobs[a:b])
            left, right = [], []
            for k in range(1, min(window, len(x) - 1) + 1):
                at = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= threshold)
                left.append(at)
                right.append(at + k)
            if left and sum(map(len, left)):
                root = _roots(len(x), np.concatenate(left), np.concatenate(right))
                far = np.flatnonzero(root != np.arange(len(x)))
                # A component of a stretch is connected by verified links only.
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][far]), pa.array(ids[a:b][root[far]])], names=["a", "b"])

    ordered = classes.select("_c", "_l", "_v").mapInArrow(keyed, "pass string, key long, _c long, _v binary")
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ordered.repartitionByRange(n, "pass", "key", "_c").sortWithinPartitions("pass", "key", "_c")
    found = checkpoint(connected_components(ordered.mapInArrow(near, "a long, b long")))

    comps = classes.join(found, F.col("_c") == F.col("node"), "left").select("_c", "_l", F.length("_v").alias("size"), "least", "copies", "_v", F.coalesce("component", "_c").alias("k"))
    comps = checkpoint(comps)
    labels = comps.groupBy(F.col("_l").alias("label"), F.col("size").alias("bytes")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = comps.join(labels, (F.col("_l") == F.col("label")) & (F.col("size") == F.col("bytes")))
    own = F.pmod(F.xxhash64(F.lit("block"), "_c"), F.col("blocks")).cast("int")
    tiles = members.select("_l", "size", "k", "_c", "copies", "_v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("_l", "size", "k", "_c", "copies", "_v", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def counted(tile: pd.DataFrame) -> pd.DataFrame:
        """Links of the vectors of two blocks (_c, links), and stars of the components that they unite (a, b)."""
        low, high = tile["low"].iloc[0], tile["high"].iloc[0]
        x, y = tile[tile["own"] == low], tile[tile["own"] == high]
        if not len(x) or not len(y):
            return pd.DataFrame({"_c": [], "links": [], "a": [], "b": []}).astype("int64")
        linked = _unpack(x["_v"].tolist()) @ _unpack(y["_v"].tolist()).T >= threshold
        if low == high:
            np.fill_diagonal(linked, False)
        names, place = np.unique(np.concatenate([x["k"].to_numpy(), y["k"].to_numpy()]), return_inverse=True)
        left, right = place[: len(x)], place[len(x) :]
        at = np.nonzero(linked & (left[:, None] != right[None, :]))
        root = _roots(len(names), left[at[0]], right[at[1]])
        far = np.flatnonzero(root != np.arange(len(names)))
        parts = [pd.DataFrame({"_c": x["_c"].to_numpy(), "links": linked @ y["copies"].to_numpy(), "a": 0, "b": 0})]
        if low != high:
            parts.append(pd.DataFrame({"_c": y["_c"].to_numpy(), "links": linked.T @ x["copies"].to_numpy(), "a": 0, "b": 0}))
        parts = [p[p["links"] > 0] for p in parts]
        return pd.concat([*parts, pd.DataFrame({"_c": 0, "links": 0, "a": names[far], "b": names[root[far]]})])

    compared = checkpoint(tiles.groupBy("_l", "size", "low", "high").applyInPandas(counted, "_c long, links long, a long, b long"))
    united = connected_components(compared.where("links = 0").select("a", "b"))
    links = compared.where("links > 0").groupBy("_c").agg(F.sum("links").alias("links"))
    comps = comps.join(united, F.col("k") == F.col("node"), "left").select("_c", "least", F.coalesce("component", "k").alias("k"))
    sizes = comps.groupBy("k").agg(F.min("least").alias("component_id"))
    named = comps.join(sizes, "k").select("_c", "component_id").join(links, "_c", "left")
    out = rows.select("_id", "_c").join(classes.select("_c", "copies", "least"), "_c", "left").join(named, "_c", "left")
    component = F.coalesce("component_id", "least", "_id")
    return out.select(F.col("_id").alias(id_col), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
