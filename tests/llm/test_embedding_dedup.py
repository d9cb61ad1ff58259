"""Embedding links against all pairs of equal labels."""

import math

import numpy as np

from rivulet.llm.common import read
from rivulet.llm.embedding_dedup import embedding_links


def brute(rows, threshold=0.98):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = {i: set() for i in range(len(rows))}
    by = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if label is not None and vec_id is not None and usable(v):
            by.setdefault((label, len(v)), []).append(i)
    for group in by.values():
        x = np.array([rows[i][1] for i in group], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[group[a]].add(group[b])
    out, seen = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            todo, comp = [i], {i}
            while todo:
                for j in links[todo.pop()] - comp:
                    comp.add(j)
                    todo.append(j)
            least = min((rows[j][0] for j in comp if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(comp, least)
        out.setdefault(rows[i][0], []).append((len(links[i]), seen[i]))
    return out


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, r.embedding, r.label) for r in read(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    base = np.array([r[1] for r in rows])
    at = 10_000
    for k in range(60):  # groups around the threshold
        for _ in range(rng.integers(1, 5)):
            noise = rng.standard_normal(base.shape[1])
            rows.append((at, (base[k] + noise * np.linalg.norm(base[k]) / np.linalg.norm(noise) * rng.uniform(0.02, 0.22)).tolist(), int(rows[k][2])))
            at += 1
    dense = rng.standard_normal(base.shape[1])
    for _ in range(1500):  # one group larger than a block and than all windows
        noise = rng.standard_normal(base.shape[1])
        rows.append((at, (dense + noise * np.linalg.norm(dense) / np.linalg.norm(noise) * 0.1).tolist(), 3))
        at += 1
    inf = float("inf")
    rows += [(20000, None, 1), (20001, [0.0] * 64, 1), (20002, [1.0, None], 1), (20003, [inf, 1.0], 1), (20004, [1.0, 0.0], None), (20005, [1.0, 0.0], 1), (20006, [2.0, 0.0], 1), (20007, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (20008, [1.0, 0.0, 0.0], 1), (20009, [], 1), (20010, [1e300, 0.0], 1), (20005, [1.0, 0.0], 1)]
    t = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label long, n_links long, _c string")
    want = brute(rows)
    got = {}
    for r in embedding_links(t).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert sum(map(len, got.values())) == len(rows)
    wrong = {k for k in want if sorted(want[k], key=str) != sorted(got[k], key=str)}
    assert len(wrong) <= 0.002 * len(rows), [(k, want[k], got[k]) for k in list(wrong)[:9]]
    assert embedding_links(t.limit(0)).count() == 0


def test_crowded_label_exactly(spark):
    """Every vector has many neighbours below the threshold, more than a window holds; no link is lost."""
    rng = np.random.default_rng(11)
    n, dim = 5_000, 64
    centre = rng.standard_normal(dim)
    crowd = centre / np.linalg.norm(centre) + rng.standard_normal((n, dim)) * 0.23 / dim**0.5  # median cosine 0.95
    step = rng.standard_normal((200, dim))
    near = crowd[:200] + step / np.linalg.norm(step, axis=1)[:, None] * 0.19
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([crowd, near]))]
    want = brute(rows)
    assert sum(len(v) for v in want.values()) == n + 200 and sum(v[0][0] > 0 for v in want.values()) >= 350
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: [(r.n_links, r.component_id)] for r in embedding_links(t).collect()}
    assert got == want
