"""Embedding near-dedup with a robust-pruned flat graph.

Vectors of one label (and length) link at cosine >= ``least``, in double precision.

* Classes.  Equal vectors are one class, found by two hashes and named by its smallest id; only classes are searched, and a link to a
  class counts once for each of its vectors.
* Shards.  Centroids come from a bounded sample (``sample`` rows, spherical k-means in numpy); every vector is
  indexed in its nearest centroid's shard and in all whose centroid is nearly as near (``margin``), and it is a query in the
  nearest one only.  A shard of more than ``block`` vectors is cut into blocks; its queries then search
  every block, so no vector is left out.
* Graph.  In each block every vector keeps robust-pruned neighbours (a candidate goes when a kept one is much nearer to it than the
  vector is) and some random ones.  The lists that a vector has from its several shards, and reverse edges, are united; a list
  that reverse edges make longer than ``WIDEST`` is pruned again.
* Search.  Queries walk greedily from the block's medoid with a beam; then the range expands: everything linked so far passes
  its neighbours on, until no new link appears.  A query that is itself in the block counts as reached.
* Audit.  ``audit`` queries are compared with all vectors by brute force, in blocks.  The recall is averaged over the queries, over those
  with few links apart too; if the lower of the two is below ``recall``, the search is repeated with twice the beam and margin, and
  after the third round it is an error.

A task reports counts, a spanning forest of the links it found, and the links of queries with at most ``LISTED`` of them, which count for
both ends: a group of g copies gives at most LISTED * g links, not g * g.

Defined results: a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; rows
that repeat an id are one vector (the smallest by label, then components) with one row a repetition; a null id links with nothing; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import components, materialise, workers

LEAST, MARGIN, BEAM, BLOCK = 0.98, 0.1, 32, 1024
# Links of one query in one block that are listed, to count for both ends; a query with more counts its own.
LISTED = 64
# Neighbours of a row in one block, random ones apart.
WIDEST = 128
# Neighbour places that one step of the range expansion looks at.
FRONT = 1 << 20


def unit(rows: list) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    v = np.array(rows, np.float64)
    v /= np.abs(v).max(1, keepdims=True)            # no overflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def centroids(v: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), k, replace=False)]
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def build(v: np.ndarray, degree: int = 24, pool: int = 64, far: int = 8, alpha: float = 1.2, seed: int = 3) -> list[np.ndarray]:
    """Robust-pruned neighbours of every row, random ones and reverse edges."""
    n = len(v)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    dist = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.T)))
    np.fill_diagonal(dist, np.inf)
    pool = min(pool, n - 1)
    cand = np.argpartition(dist, pool - 1, axis=1)[:, :pool]
    d = np.take_along_axis(dist, cand, 1)
    order = d.argsort(1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    live, rows = np.ones_like(cand, bool), np.arange(n)
    edges = []
    for _ in range(min(degree, pool)):
        at = live.argmax(1)                          # the nearest that is left
        some = live[rows, at]
        if not some.any():
            break
        best = cand[rows, at]
        edges.append(np.stack([rows[some], best[some]], 1))
        live[rows, at] = False
        live &= ~(alpha * dist[best[:, None], cand] <= d)
    near = _split(np.concatenate(edges), n)
    for i in np.flatnonzero([len(x) > WIDEST for x in near]).tolist():
        near[i] = prune(near[i], dist[i], dist, alpha)
    rng = np.random.default_rng(seed)
    loose = _split(np.stack([np.repeat(rows, far), rng.integers(0, n, n * far)], 1), n)
    return [np.union1d(x, y) for x, y in zip(near, loose)]


def _split(e: np.ndarray, n: int) -> list[np.ndarray]:
    """The neighbours of each row by the edges ``e`` in either direction."""
    e = np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    return np.split(e[:, 1], np.searchsorted(e[:, 0], np.arange(1, n)))


def prune(near: np.ndarray, own: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
    """At most ``WIDEST`` of the rows ``near``: those that robust pruning keeps, then the nearest of the others."""
    near = near[own[near].argsort(kind="stable")]
    kept, left = [], near
    while len(left) and len(kept) < WIDEST:
        kept.append(int(left[0]))
        left = left[1:][alpha * dist[left[0], left[1:]] > own[left[1:]]]
    rest = near[~np.isin(near, kept)][:WIDEST - len(kept)]
    return np.concatenate([np.array(kept, np.int64), rest])


def search(v: np.ndarray, near: np.ndarray, q: np.ndarray, own: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the links found.  ``near``: neighbours by row, padded with len(v); ``own``: each query's row, or len(v)."""
    n, m = len(v), len(q)
    vv = np.concatenate([v, np.zeros((1, v.shape[1]))])
    nn = np.concatenate([near, np.full((1, near.shape[1]), n)])
    sim = np.full((m, n + 1), -2.0)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    every = np.arange(m)
    medoid = int((v @ v.mean(0)).argmax())
    at = np.full((m, beam), n)
    score = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    at[:, 0], score[:, 0], done[:, 0] = medoid, q @ v[medoid], False
    sim[:, medoid], seen[:, medoid] = score[:, 0], True
    while True:
        todo = np.where(done, -np.inf, score)
        j = todo.argmax(1)
        r = every[todo[every, j] > -np.inf]
        if not len(r):
            break
        node = at[r, j[r]]
        done[r, j[r]] = True
        nb = nn[node]
        s = np.einsum("qrd,qd->qr", vv[nb], q[r])
        s[seen[r[:, None], nb]] = -np.inf
        seen[r[:, None], nb] = True
        qi, ci = np.nonzero(s > -np.inf)
        sim[r[qi], nb[qi, ci]] = s[qi, ci]
        a, b, c = np.concatenate([at[r], nb], 1), np.concatenate([score[r], s], 1), np.concatenate([done[r], s == -np.inf], 1)
        top = np.argpartition(-b, beam - 1, axis=1)[:, :beam]
        at[r], score[r], done[r] = (np.take_along_axis(x, top, 1) for x in (a, b, c))
    has = every[own < n]
    sim[has, own[has]] = 1.0
    front = np.argwhere(sim[:, :n] >= least)
    slice_ = max(1, FRONT // nn.shape[1])
    while len(front):                                # the range expands through everything linked
        front, rest = front[:slice_], front[slice_:]
        nb = nn[front[:, 1]]
        key = np.unique(np.repeat(front[:, 0], nb.shape[1]) * (n + 1) + nb.ravel())
        qi, node = key // (n + 1), key % (n + 1)
        fresh = ~seen[qi, node]
        qi, node = qi[fresh], node[fresh]
        seen[qi, node] = True
        s = np.empty(len(qi))
        for i in range(0, len(qi), 65536):
            s[i:i + 65536] = np.einsum("rd,rd->r", vv[node[i:i + 65536]], q[qi[i:i + 65536]])
        sim[qi, node] = s
        hit = s >= least
        front = np.concatenate([rest, np.stack([qi[hit], node[hit]], 1)])
    qi, node = np.nonzero(sim[:, :n] >= least)
    other = node != own[qi]
    return qi[other], node[other]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for the nodes of the links a - b."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in up if find(x) != x]


def _valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vid, space, v) of the vectors that can link; a space is a label and a length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(label_col).cast("string").alias("label"),
                          F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))       # NaN is above infinity
    rows = rows.where(F.col("vid").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(
        finite & F.exists("v", lambda x: x != 0))
    one = rows.groupBy("vid").agg(F.min(F.struct("label", "v")).alias("x")).select(
        "vid", F.concat_ws(":", "x.label", F.size("x.v")).alias("space"), F.col("x.v").alias("v"))
    return one.withColumn("h1", F.xxhash64("space", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "space"))


def classes(valid: DataFrame) -> DataFrame:
    """(vid, space, v, copies, h1, h2): one row for all equal vectors, named by the smallest id."""
    return materialise(valid.groupBy("h1", "h2").agg(F.min("vid").alias("vid"), F.first("space").alias("space"), F.first("v").alias("v"),
                                                     F.count(F.lit(1)).alias("copies")))


def _pad(lists: list, n: int) -> np.ndarray:
    wide = max([1, *map(len, lists)])
    out = np.full((len(lists), wide), n)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def near_links(base: DataFrame, least: float, margin: float, beam: int, block: int, sample: int, seed: int = 3) -> DataFrame:
    """(vid, n_links, root, near) found by one pass; ``base`` has (vid, space, v, copies)."""
    total = base.count()
    rate = min(1.0, sample / max(total, 1))
    picked = base.where(F.pmod(F.xxhash64(F.lit(seed), "vid"), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).select("space", "v").limit(2 * sample)
    got = picked.toPandas()
    cents = {}
    for space, rows in got.groupby("space"):
        k = min(-(-int(len(rows) / rate) // block), len(rows) // 8)
        if k > 1:
            cents[space] = centroids(unit(rows["v"].tolist()), k, seed=seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"shard": [], "first": [], "at": []}
            spaces, vecs = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, (space, x) in enumerate(zip(spaces, vecs)):
                c = cents.get(space)
                if c is None:
                    hits, top = [0], 0
                else:
                    s = c @ unit([x])[0]
                    top = int(s.argmax())
                    hits = np.flatnonzero(s >= s[top] - margin).tolist()
                out["shard"] += hits
                out["first"] += [h == top for h in hits]
                out["at"] += [i] * len(hits)
            rows = b.take(pa.array(out["at"], pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array(out["shard"], pa.int32()), pa.array(out["first"], pa.bool_())],
                                  names=["vid", "space", "v", "copies", "shard", "first"])

    members = materialise(base.select("vid", "space", "v", "copies").mapInArrow(assign, "vid long, space string, v array<double>, copies long, shard int, first boolean"))
    sizes = members.groupBy("space", "shard").count().select("space", "shard", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    members = materialise(members.join(sizes, ["space", "shard"]).withColumn(
        "block", F.pmod(F.xxhash64("vid", F.lit(seed)), F.col("blocks")).cast("int")))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        ids = pdf["vid"].to_numpy()
        return pd.DataFrame({"vid": ids, "near": [ids[x] for x in build(unit(pdf["v"].tolist()), seed=seed)]})

    lists = members.select("space", "shard", "block", "vid", "v").groupBy("space", "shard", "block").applyInPandas(graph, "vid long, near array<long>")
    union = lists.groupBy("vid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))    # a few short lists a vector
    nodes = members.join(union, "vid")
    # Index rows go to every query block of their shard, queries (first only) to every index block.
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    index = nodes.withColumn("qblock", F.explode(others)).select(
        "space", "shard", "block", "qblock", "vid", "v", "copies", "near", F.lit(True).alias("indexed"), (F.col("first") & (F.col("block") == F.col("qblock"))).alias("query"))
    asks = (members.where("first and blocks > 1").withColumn("qblock", F.col("block")).withColumn("block", F.explode(others)).where("block <> qblock")
            .select("space", "shard", "block", "qblock", "vid", "v", "copies", F.array().cast("array<bigint>").alias("near"), F.lit(False).alias("indexed"),
                    F.lit(True).alias("query")))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf[pdf["indexed"]].sort_values("vid")
        asked = pdf[pdf["query"]].sort_values("vid")
        if not len(inside) or not len(asked):
            return pd.DataFrame({"vid": [], "n_links": [], "root": []}).astype("int64").assign(near=pd.Series([], dtype=object))
        ids, n, copies = inside["vid"].to_numpy(), len(inside), inside["copies"].to_numpy()
        place = {x: i for i, x in enumerate(ids.tolist())}
        near = _pad([[place[y] for y in x if y in place] for x in inside["near"]], n)
        v, q, qid = unit(inside["v"].tolist()), unit(asked["v"].tolist()), asked["vid"].to_numpy()
        own = np.array([place.get(x, n) for x in qid.tolist()])
        count, forest, listed = np.zeros(len(q), np.int64), [], {}
        for i in range(0, len(q), 256):
            a, b = search(v, near, q[i:i + 256], own[i:i + 256], least, beam)
            np.add.at(count, a + i, copies[b])
            forest += _forest(qid[a + i], ids[b])
            for x, y in zip(np.unique(a).tolist(), np.split(ids[b], np.flatnonzero(np.diff(a)) + 1)):
                if len(y) <= LISTED:
                    listed[qid[x + i]] = y
        root = dict(_forest(*np.array(forest, np.int64).reshape(-1, 2).T)) if forest else {}
        known = dict(zip(qid.tolist(), count.tolist()))
        every = sorted(set(known) | set(root))
        return pd.DataFrame({"vid": every, "n_links": [known.get(x, 0) for x in every], "root": [root.get(x, x) for x in every],
                             "near": [listed.get(x, ()) for x in every]})

    return materialise(index.unionByName(asks).groupBy("space", "shard", "block", "qblock").applyInPandas(find, "vid long, n_links long, root long, near array<long>"))


def link_counts(found: DataFrame, base: DataFrame) -> DataFrame:
    """(vid, n_links): a query's own links, or the listed links of either end if these are more."""
    own = found.groupBy("vid").agg(F.sum("n_links").alias("own"))
    listed = found.select("vid", F.explode("near").alias("other"))
    both = listed.union(listed.select(F.col("other"), F.col("vid"))).distinct().join(
        base.select(F.col("vid").alias("other"), "copies"), "other").groupBy("vid").agg(F.sum("copies").alias("both"))
    return own.join(both, "vid", "left").select("vid", F.greatest("own", F.coalesce("both", F.lit(0))).alias("n_links"))


def audit_recall(base: DataFrame, counts: DataFrame, least: float, queries: int, seed: int = 3) -> tuple[float, float]:
    """Links found over links there, averaged over a bounded number of queries against all rows by brute force: over all
    queries with links, and over those with at most ``LISTED``."""
    total = max(base.count(), 1)
    asked = base.where(F.pmod(F.xxhash64(F.lit(seed + 1), "vid"), F.lit(1_000_000)) < int(min(1.0, queries / total) * 1_000_000) + 1)
    asked = asked.limit(2 * queries).toPandas()
    if not len(asked):
        return 1.0, 1.0
    groups = {s: (rows["vid"].to_numpy(), unit(rows["v"].tolist())) for s, rows in asked.groupby("space")}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            pdf = b.to_pandas()
            for s, rows in pdf[pdf["space"].isin(groups.keys())].groupby("space"):
                ids, q = groups[s]
                hit = (q @ unit(rows["v"].tolist()).T >= least) & (ids[:, None] != rows["vid"].to_numpy()[None])
                for x, c in zip(ids.tolist(), (hit @ rows["copies"].to_numpy()).tolist()):
                    found[x] = found.get(x, 0) + c
        yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["vid", "c"])

    there = base.select("vid", "space", "v", "copies").mapInArrow(brute, "vid long, c long").groupBy("vid").agg(F.sum("c").alias("there"))
    part = F.least("there", F.coalesce("n_links", F.lit(0))) / F.col("there")
    both = there.where("there > 0").join(counts, "vid", "left").agg(F.avg(part), F.avg(F.when(F.col("there") <= LISTED, part))).first()
    return tuple(1.0 if x is None else x for x in both)


def embedding_dedup(vectors: DataFrame, least: float = LEAST, margin: float = MARGIN, beam: int = BEAM, block: int = BLOCK, sample: int = 20_000,
                    audit: int = 256, recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    workers(vectors.sparkSession)
    valid = materialise(_valid(vectors, id_col, vec_col, label_col))
    base = classes(valid)
    for _ in range(3):
        found = near_links(base, least, margin, beam, block, sample)
        counts = materialise(link_counts(found, base))
        overall, few = audit_recall(base, counts, least, audit)
        if min(overall, few) >= recall:
            break
        margin, beam = 2 * margin, 2 * beam
    else:
        raise RuntimeError(f"recall stays below {recall}: {overall:.4f} of all audited queries, {few:.4f} of those with at most {LISTED} links")
    labels = components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    info = base.select("h1", "h2", "vid", "copies").join(counts, "vid", "left").join(labels, F.col("vid") == F.col("node"), "left")
    info = materialise(info.select("h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                   F.coalesce("component", "vid").alias("component")))
    info = valid.select("vid", "h1", "h2").join(info, ["h1", "h2"]).select("vid", "n_links", "component")
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = ids.join(info, ids.vec_id == info.vid, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
                     and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
l as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      and list_cosine_similarity(a.e, b.e) >= 0.98),
t as (select x, y from l union select t.x, l.y from t join l on t.y = l.x),
c as (select x, min(y) m from t group by 1), n as (select x, count(*) k from l group by 1)
select vec_id, coalesce(k, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id = least(vec_id, coalesce(m, vec_id)) kept
from embeddings e left join c on c.x = vec_id left join n on n.x = vec_id
"""
