"""Removal of byte strings that an earlier document holds, by a sampled, distributed suffix array.

Suffixes are sampled at anchors: positions whose q-byte hash is the smallest of some window of
LENGTH bytes that holds it. Equal windows have equal anchors at equal places, so two equal windows
start suffixes of one bucket (same first q bytes) that agree far enough to both sides.

1. Anchors are dealt to buckets by hash. One whose whole surroundings (the bytes that any window
   over it can reach) also lie in an earlier document settles all its windows at once. Here equal
   hashes stand for equal bytes: 48 bits of the surroundings, and at least 46 of the bucket.
2. Only anchors at the ends of repeats are left. Their surroundings are fetched, and each bucket's
   suffixes are ordered by deep-shallow sorting: multikey quicksort over 8-byte characters to a
   shallow depth, then blind tries for the groups that still agree. The LCP array gives how far
   two suffixes agree to the right; their bytes before the anchor, how far to the left; together
   they give the windows that an earlier document holds.
3. Buckets of very many suffixes are not gathered: multikey quicksort goes on over the cluster. The
   bucket's first document is the pivot. What a suffix shares with it is decided at once; a longer
   agreement with any other one is only possible among those that leave the pivot at the same
   place with the same byte, to the right or to the left. These are the next buckets, and each
   window goes to one of them at most, until they are small enough to be sorted in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE_CODES, checkpoint, lean, mixed, release, small_batches, trim
from .jaccard_join import _n_parts

LENGTH, SEED = 50, 24
REACH = LENGTH - SEED  # bytes on either side that a window over an anchor can hold
#: Anchors that a task gathers before it sends them.
FLUSH = 1 << 21
#: Partitions' anchors that are sent in one batch.
BLOBS = 64
#: Bytes of a hash sent besides its bucket's partition, and of the hash of an anchor's surroundings.
SIG_BYTES, AROUND_BYTES = 5, 6
#: Suffixes of a bucket that are sorted in one place; larger buckets are split by a pivot.
MOST_SORTED = 256
#: Suffixes that a task sorts at once, and those of a partition.
AT_ONCE, PER_PARTITION = 8192, 100_000
#: Anchors of a partition after which a worker gives its memory back; suffixes that a task reads at least.
LARGE, SUFFIXES_A_FILE = 1 << 18, 1 << 15
#: Bytes between the texts of one id.
GAP = 4 * LENGTH
#: Bytes hashed at a time; texts are cut into overlapping pieces of this size.
PIECE = 1 << 19
_P = 0xD1342543DE82EF95


def _geometric(ratio: int) -> np.ndarray:
    x = np.full(PIECE + 4 * LENGTH, ratio, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


_POWERS, _INVERSES = _geometric(_P), _geometric(pow(_P, -1, 1 << 64))


def _anchor(wide: bool) -> tuple[np.dtype, np.dtype]:
    """An anchor, and one that is settled; places need 8 bytes only where an id has several texts."""
    place = [("doc", "<i8"), ("pos", "<i8" if wide else "<i4")]
    return np.dtype([("sig", f"({SIG_BYTES},)u1"), ("around", f"({AROUND_BYTES},)u1"), *place]), np.dtype(place)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of width elements."""
    done = 1
    while done * 2 <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, hashes of the SEED bytes there, hashes of the surroundings) of a text, piece by piece."""
    n = len(raw)
    width = LENGTH - SEED + 1
    # A piece decides the anchors of its own stretch; what is before and after lets it see all their windows and surroundings.
    for begin in range(0, max(1, n - LENGTH + 1), PIECE):
        low, high = max(0, begin - LENGTH), min(n, begin + PIECE + 2 * LENGTH)
        buf = np.frombuffer(raw, np.uint8)[low:high]
        if len(buf) < LENGTH:
            return
        sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_CODES[buf] * _POWERS[: len(buf)], out=sums[1:], dtype=np.uint64)
            h = mixed((sums[SEED:] - sums[:-SEED]) * _INVERSES[: len(buf) - SEED + 1])
        least = _sliding(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        seen = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
        at = np.flatnonzero(seen == h)
        at = at[(at + low >= begin) & ((at + low < begin + PIECE) | (begin + PIECE > n - LENGTH))]
        left, right = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(buf))
        with np.errstate(over="ignore"):
            around = mixed((sums[right] - sums[left]) * _INVERSES[left] + ((at - left) * 128 + right - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield at + low, h[at], around


def _big_endian(x: np.ndarray, size: int) -> np.ndarray:
    """The lowest size bytes of 64-bit values."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]


def _number(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), np.uint8)
    out[:, 8 - b.shape[1] :] = b
    return out.view(">u8").ravel().astype(np.uint64)


class BlindTrie:
    """A compacted trie over byte strings that keeps only branching depths and first bytes; it is searched blindly and then checked against one string."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # a node is [depth, {byte: child}], a leaf a list of equal strings' numbers
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blind descent
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(i)
            return
        depth = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = len(s) - (depth.bit_length() + 7) // 8
        parent, node = None, self.root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        leaf = [None, [i]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        made = [depth, {other[depth]: node, s[depth]: leaf}]
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def order(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and how far each agrees with the one before it (the first: 0)."""
        out, lcp = [], []

        def walk(node: list, depth: int) -> None:
            if node[0] is None:
                for k, i in enumerate(node[1]):
                    out.append(i)
                    lcp.append(depth if k == 0 else len(self.strings[i]))
                return
            for k, b in enumerate(sorted(node[1])):
                walk(node[1][b], depth if k == 0 else node[0])

        if self.root is not None:
            walk(self.root, 0)
        return out, lcp


def _quicksorted(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The order of rows of words within their groups: multikey quicksort, a step of all groups at a time.

    In a step each open group is parted into what is below, equal to and above the word of its
    middle row; the equal part goes on with the next word.
    """
    n, levels = words.shape
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if n else np.empty(0, np.int64)
    depth = np.zeros(len(start), np.int64)
    while True:
        size = np.diff(np.append(start, n))
        todo = np.flatnonzero((size > 1) & (depth < levels))
        if not len(todo):
            return order
        size = size[todo]
        which = np.repeat(np.arange(len(todo)), size)
        at = np.arange(size.sum()) + np.repeat(start[todo] - np.cumsum(size) + size, size)
        own = words[order[at], depth[todo][which]]
        pivot = words[order[start[todo] + size // 2], depth[todo]][which]
        side = np.where(own < pivot, 0, np.where(own == pivot, 1, 2))
        key = which * 3 + side
        by = np.argsort(key, kind="stable")
        order[at] = order[at][by]
        key = key[by]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        starts = np.concatenate([np.delete(start, todo), at[new]])
        depths = np.concatenate([np.delete(depth, todo), depth[todo][key[new] // 3] + (key[new] % 3 == 1)])
        again = np.argsort(starts)
        start, depth = starts[again], depths[again]


def deep_shallow_sort(group: np.ndarray, strings: np.ndarray, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order equally long byte strings within their groups: (order, LCP with the string before, in a group).

    Multikey quicksort takes 8-byte characters up to the shallow depth; groups that still agree
    go to blind tries, pairs to the one comparison that a trie of two makes.
    """
    n, width = strings.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    words = wide.view(">u8").astype(np.uint64)
    levels = min(shallow // 8, words.shape[1])
    order = _quicksorted(group, words[:, :levels])
    lcp = np.zeros(n, np.int64)
    g, w = group[order], words[order]
    same = np.zeros(n, bool)
    same[1:] = g[1:] == g[:-1]
    lcp[1:] = np.where(same[1:], _agreement(w[1:, :levels], w[:-1, :levels], min(shallow, width)), 0)
    tied = same & (lcp >= min(shallow, width))
    starts = np.flatnonzero(~tied)
    sizes = np.diff(np.append(starts, n))
    if width > shallow:
        pairs = starts[sizes == 2]
        deeper = _agreement(w[pairs], w[pairs + 1], width)
        word = ((w[pairs] ^ w[pairs + 1]) != 0).argmax(1)
        swap = pairs[w[pairs, word] > w[pairs + 1, word]]
        order[swap], order[swap + 1] = order[swap + 1].copy(), order[swap].copy()
        lcp[pairs + 1] = deeper
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            at = order[start : start + size].copy()
            inner, depth = BlindTrie([strings[i, shallow:].tobytes() for i in at]).order()
            order[start : start + size] = at[inner]
            lcp[start + 1 : start + size] = np.array(depth[1:]) + shallow
    return order, lcp


def _agreement(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """First bytes on which rows of big-endian words agree, at most width."""
    differ = a ^ b
    first = (differ != 0).argmax(1)
    word = differ[np.arange(len(a)), first]
    # Leading zero bytes of the first word that differs.
    zero = np.zeros(len(a), np.int64)
    for k in range(1, 8):
        zero += (word >> np.uint64(64 - 8 * k)) == 0
    return np.minimum(np.where(word == 0, width, first * 8 + zero), width)


def _ends(bucket: np.ndarray, doc: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of each anchor an earlier document's windows reach; -1: none.

    text holds REACH bytes before the anchor, the anchor, and REACH bytes after it; left and right
    say how many of them are in the document.
    """
    order, lcp = deep_shallow_sort(bucket, text[:, REACH:])
    lcp = lcp - SEED  # below 0: chance has dealt two seeds to one bucket
    bucket, doc, left, right = bucket[order], doc[order], left[order], right[order]
    back = np.zeros((len(order), -(-REACH // 8) * 8), np.uint8)
    back[:, :REACH] = text[order, :REACH][:, ::-1]
    back = back.view(">u8").astype(np.uint64)
    to_left, to_right = np.full(len(order), -1), np.full(len(order), -1)
    at = np.arange(len(order) - 1)
    run = np.full(len(order), REACH)
    for step in range(1, MOST_SORTED + 1):  # the next suffixes of the bucket, nearer ones first
        at = at[at + step < len(order)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        run[at] = np.minimum(run[at], lcp[at + step])
        b = at + step
        r = np.minimum(np.minimum(run[at], right[at]), right[b])
        here = doc[at] != doc[b]
        x, y, r = at[here], b[here], r[here]
        back_left = np.minimum(np.minimum(_agreement(back[x], back[y], REACH), left[x]), left[y])
        good = back_left + r >= REACH
        later = np.where(doc[x] > doc[y], x, y)[good]
        np.maximum.at(to_left, later, back_left[good])
        np.maximum.at(to_right, later, r[good])
    out_left, out_right = np.empty_like(to_left), np.empty_like(to_right)
    out_left[order], out_right[order] = to_left, to_right
    return out_left, out_right


def _sampled(texts: DataFrame, parts: int, wide: bool) -> DataFrame:
    """(part, settled, rows): anchors by bucket partition, and settled ones by document."""
    anchor, place = _anchor(wide)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """What a task sends of the anchors it holds; the list is emptied, and arrays go as soon as they can."""
        found = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        order = np.lexsort((found[1], found[0], found[3], found[2]))
        around, h, pos, doc = (found.pop()[order] for _ in range(4))
        del order
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
        known = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]  # an earlier document of this batch has the same surroundings
        settled = np.empty(known.sum(), place)
        settled["doc"], settled["pos"] = doc[known], pos[known]
        rows = np.empty(len(known) - len(settled), anchor)
        rows["doc"], rows["pos"], rows["around"] = doc[~known], pos[~known], _big_endian(around[~known], AROUND_BYTES)
        del doc, pos, around
        h = h[~known]
        scaled = (h >> np.uint64(32)) * np.uint64(parts)
        rows["sig"] = _big_endian((scaled & np.uint64(0xFFFFFFFF)) << np.uint64(8) | mixed(h) >> np.uint64(56), SIG_BYTES)
        todo = [(True, mixed(settled["doc"].astype(np.uint64)) % np.uint64(parts), settled), (False, scaled >> np.uint64(32), rows)]
        del h, scaled, settled, rows
        while todo:
            kind, part, data = todo.pop()
            by = np.argsort(part, kind="stable")
            part, data = part[by], data[by]
            cuts = [*np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else []
            if cuts:
                offsets = np.array([0, *cuts]) * data.dtype.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                for k in range(0, len(cuts), BLOBS):
                    names = part[[0, *cuts][k : min(k + BLOBS, len(cuts))]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), kind)), blobs[k : k + BLOBS].cast(pa.binary())], names=["part", "settled", "rows"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, begin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                if i is not None and len(raw) >= LENGTH:
                    for at, h, around in anchors(raw):
                        held.append((np.full(len(at), i, np.int64), at + begin, h, around))
                        size += len(at)
                        if size >= FLUSH:
                            yield from send(held)
                            size = 0
        if held:
            yield from send(held)

    return texts.select("_d", "_o", "_t").mapInArrow(lean(sample), "part long, settled boolean, rows binary")


def _bucketed(wide: bool):
    """(doc, pos, bucket): settled anchors have no bucket, those left open have theirs."""
    anchor, place = _anchor(wide)

    def of(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        kinds, blobs = group.column("settled").to_pylist(), group.column("rows")
        rows = np.frombuffer(b"".join(b.as_buffer() for b, k in zip(blobs, kinds, strict=True) if not k), anchor)
        done = np.frombuffer(b"".join(b.as_buffer() for b, k in zip(blobs, kinds, strict=True) if k), place)
        sig, around, doc = _number(rows["sig"]), _number(rows["around"]), rows["doc"]
        order = np.lexsort((doc, around, sig))
        sig = sig[order]
        around = around[order]
        doc = doc[order]
        pos = rows["pos"][order]
        large = len(rows) > LARGE
        del order, rows
        if len(sig):
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            start = np.flatnonzero(new)
            shared = np.maximum.reduceat(doc, start) != np.minimum.reduceat(doc, start)
            shared = shared[np.cumsum(new) - 1]
            kind = new.copy()
            kind[1:] |= around[1:] != around[:-1]
            del around
            settled = doc > doc[np.flatnonzero(kind)][np.cumsum(kind) - 1]
            several = (np.add.reduceat(kind.astype(np.int64), start) > 1)[np.cumsum(new) - 1]
            left = shared & several & ~settled
        else:
            settled = left = np.zeros(0, bool)
        bucket = (sig[left] | np.uint64(part << (8 * SIG_BYTES))).view(np.int64)
        del sig
        if large:
            trim()
        return pa.table({
            "doc": np.concatenate([done["doc"], doc[settled], doc[left]]),
            "pos": np.concatenate([done["pos"], pos[settled], pos[left]]).astype(np.int64),
            "bucket": pa.concat_arrays([pa.nulls(len(done) + int(settled.sum()), pa.int64()), pa.array(bucket, pa.int64())]),
        })

    return of


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(_i, _d, _o, _t) of all rows, then of one row for each text of an id, and whether an id has several rows.

    _o is where a text begins among the texts of its id, which lie apart from each other.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids are whole numbers, not {kind}")
    rows = docs.select(F.col(id_col).alias("_i"), F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_t"))
    again = checkpoint(rows.where("_d IS NOT NULL").groupBy("_d").count().where("count > 1").select("_d"))
    if again.isEmpty():
        rows = rows.withColumn("_o", F.lit(0).cast("long"))
        return rows, rows, False
    rows = rows.withColumn("_h", F.xxhash64(F.coalesce("_t", F.lit(""))))
    upto = Window.partitionBy("_d").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.join(again, "_d", "left_semi").select("_d", "_h", (F.coalesce(F.octet_length("_t"), F.lit(0)) + GAP).alias("n")).distinct()
    begin = checkpoint(begin.select("_d", "_h", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_o")))
    alone = rows.join(again, "_d", "left_anti").select("_i", "_d", F.lit(0).cast("long").alias("_o"), "_t")
    one = rows.join(begin, ["_d", "_h"])
    single = alone.unionByName(one.dropDuplicates(["_d", "_h"]).select("_i", "_d", "_o", "_t"))
    return alone.unionByName(one.select("_i", "_d", "_o", "_t")), single, True


_OPEN = "bucket long, doc long, pos long, left int, right int, low int, high int, bytes binary"


def _open_table(columns: dict[str, np.ndarray], text: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    arrays = [pa.array(columns[c], k) for c, k in zip(("bucket", "doc", "pos", "left", "right", "low", "high"), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([x.tobytes() for x in text], pa.binary())], names=["bucket", "doc", "pos", "left", "right", "low", "high", "bytes"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open anchors with the bytes around them; low and high: all windows over an anchor, by how far they reach to its left."""
    for batch in batches:
        for i, begin, text, found in zip(*batch.columns, strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            pos = found.values.field(0).to_numpy() - begin.as_py()
            mine = (pos >= 0) & (pos <= len(raw) - SEED)
            pos, bucket = pos[mine], found.values.field(1).to_numpy()[mine]
            padded = np.frombuffer(bytes(REACH) + raw + bytes(REACH), np.uint8)
            for a in range(0, len(pos), AT_ONCE):
                at, n = pos[a : a + AT_ONCE], len(pos[a : a + AT_ONCE])
                columns = {"bucket": bucket[a : a + n], "doc": np.full(n, i.as_py()), "pos": at + begin.as_py(), "left": np.minimum(REACH, at), "right": np.minimum(REACH, len(raw) - at - SEED), "low": np.zeros(n, np.int64), "high": np.full(n, REACH)}
                yield _open_table(columns, padded[at[:, None] + np.arange(2 * REACH + SEED)])


def _columns(table: pa.Table | pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Numbers by name, and the bytes around each anchor."""
    text = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, 2 * REACH + SEED)
    return {c: table.column(c).to_numpy() for c in table.schema.names if not c.endswith("bytes")}, text


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, low, high) of what earlier documents hold, in rows that come bucket by bucket."""

    def decided(table: pa.Table) -> pa.RecordBatch:
        x, text = _columns(table)
        to_left, to_right = _ends(x["bucket"], x["doc"], text, x["left"], x["right"])
        hit = to_left >= 0
        return pa.RecordBatch.from_arrays([pa.array(x["doc"][hit]), pa.array((x["pos"] - to_left)[hit]), pa.array((x["pos"] + SEED + to_right)[hit])], names=["doc", "low", "high"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            whole = int(np.flatnonzero(bucket == bucket[-1])[0])  # the last bucket may go on
            if whole:
                yield decided(table[:whole])
                held = table[whole:].to_batches()
    if sum(b.num_rows for b in held):
        yield decided(pa.Table.from_batches(held))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First bytes on which rows agree."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _branch(bucket: np.ndarray, side: int, text: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The bucket of those that agree on so many first bytes."""
    with np.errstate(over="ignore"):
        codes = np.where(np.arange(text.shape[1]) < depth[:, None], _BYTE_CODES[text] * _POWERS[: text.shape[1]], np.uint64(0)).sum(1, dtype=np.uint64)
        return mixed(mixed(bucket.astype(np.int64).view(np.uint64) * np.uint64(4) + np.uint64(side)) + codes + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that a bucket's pivot decides, as rows (doc, pos: low, high) without a bucket, and rows of the next buckets.

    A window is named by how far it reaches to the left of the anchor; low and high say which
    ones a row is still there for. Those that neither go beyond the agreement with the pivot on
    the right nor on the left are decided; of the others, those beyond it on the right go to one
    bucket, the rest to another.
    """
    for batch in batches:
        x, text = _columns(batch)
        pivot = np.frombuffer(b"".join(batch.column("pivot_bytes").to_pylist()), np.uint8).reshape(text.shape)
        seed = slice(REACH, REACH + SEED)
        same = (text[:, seed] == pivot[:, seed]).all(1)
        after, before = text[:, REACH + SEED :], text[:, :REACH][:, ::-1]
        right = np.minimum.reduce([_alike(after, pivot[:, REACH + SEED :]), x["right"], x["pivot_right"]]).astype(np.int64)
        left = np.minimum.reduce([_alike(before, pivot[:, :REACH][:, ::-1]), x["left"], x["pivot_left"]]).astype(np.int64)
        low, high = x["low"].astype(np.int64), x["high"].astype(np.int64)
        first, last = np.maximum(low, REACH - right), np.minimum(high, left)
        hit = same & (first <= last) & (x["doc"] > x["pivot_doc"])
        if hit.any():
            n = int(hit.sum())
            columns = {"bucket": pa.nulls(n, pa.int64()), "doc": x["doc"][hit], "pos": (x["pos"] - last)[hit], "left": np.zeros(n, np.int64), "right": np.zeros(n, np.int64), "low": np.zeros(n, np.int64), "high": (last - first + LENGTH)[hit]}
            yield _open_table(columns, np.empty((n, 0), np.uint8))
        branches = (
            (same, _branch(x["bucket"], 0, after, right + 1), low, np.minimum(high, REACH - 1 - right)),
            (same, _branch(x["bucket"], 1, before, left + 1), np.maximum.reduce([low, left + 1, REACH - right]), high),
            (~same, _branch(x["bucket"], 2, text[:, seed], np.full(len(text), SEED)), low, high),
        )
        for which, bucket, a, b in branches:
            go = which & (np.maximum(a, REACH - x["right"]) <= np.minimum(b, x["left"]))
            if go.any():
                yield _open_table({"bucket": bucket[go], "low": a[go], "high": b[go], **{c: x[c][go] for c in ("doc", "pos", "left", "right")}}, text[go])


def repeated_ranges(texts: DataFrame, wide: bool) -> DataFrame:
    """(doc, low, high): byte ranges covered by LENGTH-byte strings that start in a document with a smaller id.

    texts holds one row for each text of an id. Ranges may overlap and reach over a text's ends.
    """
    spark = texts.sparkSession
    rows = _sampled(texts, _n_parts(texts), wide).groupBy("part").applyInArrow(_bucketed(wide), "doc long, pos long, bucket long")
    rows = checkpoint(rows)
    release(spark)
    found = rows.where("bucket IS NULL").selectExpr("doc", f"pos - {REACH} AS low", f"pos + {LENGTH} AS high")
    wanted = rows.where("bucket IS NOT NULL").groupBy(F.col("doc").alias("_w")).agg(F.collect_list(F.struct("pos", "bucket")).alias("x"))
    fetched = texts.where(F.octet_length("_t") >= LENGTH).join(wanted, F.col("_d") == F.col("_w")).select("_d", "_o", "_t", "x")
    left = checkpoint(fetched.mapInArrow(lean(_surroundings), _OPEN))
    release(spark)
    while n_left := left.count():
        files = n_left // SUFFIXES_A_FILE + 1
        sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        sized = left.join(sizes, "bucket")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_left // PER_PARTITION)
        small = sized.where(F.col("size") <= MOST_SORTED).select("bucket", "doc", "pos", "left", "right", "bytes").repartition(n, "bucket").sortWithinPartitions("bucket").coalesce(files)  # a bucket stays in one piece
        found = found.unionByName(checkpoint(small.mapInArrow(lean(_sort_buckets), "doc long, low long, high long")))
        large = sized.where(F.col("size") > MOST_SORTED)
        pivots = large.where("doc = least").groupBy("bucket").agg(F.min(F.struct("doc", "pos", "left", "right", "bytes")).alias("pivot"))
        pivots = pivots.select("bucket", *[F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("doc", "left", "right", "bytes")])
        parted = checkpoint(large.select(*left.columns).join(pivots, "bucket").coalesce(files).mapInArrow(lean(_parted), _OPEN))
        found = found.unionByName(parted.where("bucket IS NULL").selectExpr("doc", "pos AS low", "pos + high AS high"))
        left = parted.where("bucket IS NOT NULL")
        release(spark)
    return found


def _merged(ranges: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs of byte ranges, cut to the text."""
    ranges = np.clip(ranges[np.argsort(ranges[:, 0], kind="stable")], 0, n)
    ranges = ranges[ranges[:, 1] > ranges[:, 0]]
    if not len(ranges):
        return ranges
    top = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), bool)
    new[1:] = ranges[1:, 0] > top[:-1]
    start = np.flatnonzero(new)
    return np.stack([ranges[start, 0], top[np.append(start[1:] - 1, len(ranges) - 1)]], 1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every document; removed holds the maximal runs as (low, high) bytes.

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id, on
    the input as it is. Ids are whole numbers (others raise a ValueError). Rows that share an id
    are one document, and none of their texts is earlier than another; each row loses what an
    earlier document has of its own text. Rows without an id remove and lose nothing; null texts
    are empty; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows, single, wide = _texts(docs, id_col, text_col)
    ranges = repeated_ranges(single, wide).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("x"))
    rows = rows.join(ranges, F.col("_d") == F.col("doc"), "left").select("_i", "_t", "_o", "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, begin, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                runs = np.empty((0, 2), np.int64)
                if found.is_valid and len(found.values):
                    x = found.values
                    runs = _merged(np.stack([x.field(0).to_numpy(), x.field(1).to_numpy()], 1).astype(np.int64) - begin, len(raw))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for column, v in zip(out, (len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), [{"low": int(a), "high": int(b)} for a, b in runs]), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return rows.mapInArrow(lean(cut), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<low:int,high:int>>")
