"""Hard-negative mining with Fagin's threshold algorithm.

Components are quantised to whole numbers, and a pair's score is the integer inner product.  The rows are dealt over shards of about
``PER_SHARD``; a shard's index holds, for every dimension, the list of its rows sorted by that component.  Anchors
walk the lists of their non-zero dimensions from the ends that their components' signs favour (sorted access; ``AT_ONCE`` anchors walk
together and share what comes up), score every row that comes up (random access), and sum, over the dimensions, their component times the
last value read: no row that has not come up scores more than that threshold.  An anchor stops once the threshold is strictly below the
k-th score of every window it fills, or below the window itself; equality goes on, since a tie may have a smaller id.

There are two rounds over the same index.  The first finds each anchor's positives (one window over the rows of its label), the second its
negatives (one window of scores for each positive, over the rows of other labels).  Anchors are packed in blocks of about ``ANCHORS``, and
a task takes some blocks and one of at most ``SLICES`` slices of the index, whose k-th scores so far go with it from shard to shard.  Blocks and
shards meet as a nested loop over the two written tables: neither is copied for the other, and nothing of theirs goes through the driver.
A task returns at most k rows a window, and ranking keeps k before and after the shuffle.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; only vectors of equal length
meet; a component is held to +-sqrt(2^63 / length), so that a score fits 64 bits; a null id is no anchor, and orders last;
rows that repeat a vector's id are rows of their own, but no row is a partner of a row with its id; an anchor that repeats gives its rows
each time; a zero vector scores 0 with all; a negative positive score has an empty window; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.llm.common import materialise, workers

PER_SHARD, ANCHORS, SLICES = 4096, 2048, 16
AT_ONCE = 256
FIRST_DEPTH = 16
SCALE = 256
NO_ID = (1 << 63) - 1
# No score: below every real one.
NONE = -NO_ID
_INDEX = "shard int, dim int, ids binary, labels binary, matrix binary, lists binary"
_BLOCK = "block int, dim int, anchor_rows binary, anchor_ids binary, anchor_labels binary, anchors binary, goals binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, dim, vec) of the rows that take part; ``vec`` holds floor(256 x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, vec = b.column("dim").to_numpy(), b.column("vec")
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)     # a null is NaN here
            finite = np.isfinite(x)
            odd = np.bincount(np.repeat(np.arange(len(dim)), dim)[~finite], minlength=len(dim)) > 0
            limit = np.repeat(np.floor(np.sqrt(9.2e18 / np.maximum(dim, 1))), dim)
            with np.errstate(over="ignore"):
                whole = np.floor(np.clip(np.where(finite, x, 0.0) * SCALE, -limit, limit)).astype(np.int64)
            vec = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(dim))), pa.int32()), pa.array(whole))
            out = pa.record_batch([b.column("id"), b.column("label"), b.column("dim"), vec], names=["id", "label", "dim", "vec"])
            yield out.filter(pa.array(~odd))

    plain = vectors.select(vec_col).dtypes[0][1] in ("array<float>", "array<double>")
    vec = F.col(vec_col) if plain else F.col(vec_col).cast("array<double>")
    known = (vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
             .select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.size(vec).alias("dim"), vec.alias("vec")))
    return known.mapInArrow(run, "id long, label long, dim int, vec array<long>")


def _narrow(x: np.ndarray) -> bytes:
    """The whole numbers of ``x`` in the fewest bytes each that hold them all."""
    for kind in (np.int16, np.int32):
        if not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind).tobytes()
    return x.astype(np.int64).tobytes()


def _wide(data: bytes, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (rows * cols)}" if rows * cols else np.int64).reshape(rows, cols)


def _stacked(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.stack(pdf["vec"].to_list()).astype(np.int64).reshape(len(pdf), dim)


def sorted_lists(rows: DataFrame, shards: int) -> DataFrame:
    """One row a shard: ids in order, labels, the matrix and, for each dimension, the rows in ascending order of that component."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[1])
        pdf = pdf.sort_values("id", kind="stable")
        m = _stacked(pdf, dim)
        lists = np.argsort(m, axis=0, kind="stable").T
        return pd.DataFrame({"shard": [key[0]], "dim": [dim], "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
                             "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "matrix": [_narrow(m)], "lists": [_narrow(lists)]})

    # Numbered rows of a written table: the same in every attempt, and equal rows spread as well.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("row")), F.lit(shards)).cast("int")).drop("row")
    # Several files, so that the index can be read in slices, of at most about 16 shards each.
    dealt = dealt.repartition(min(shards, max(2 * SLICES, shards // 16)), "shard", "dim")
    return materialise(dealt.groupBy("shard", "dim").applyInPandas(run, _INDEX))


def anchor_blocks(anchors: DataFrame, blocks: int, goals: int) -> DataFrame:
    """One row a block and dimension: the anchors' rows, ids, labels, vectors, and ``goals`` positive scores of each (-1: none)."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[1])
        scores = np.full((len(pdf), goals), -1, np.int64)
        for i, found in enumerate(pdf["goals"]):
            if found is not None:
                scores[i, :len(found)] = found
        whole = {"anchor_rows": "row", "anchor_ids": "id", "anchor_labels": "label"}
        return pd.DataFrame({"block": [key[0]], "dim": [dim], **{to: [pdf[c].to_numpy(np.int64).tobytes()] for to, c in whole.items()},
                             "anchors": [_narrow(_stacked(pdf, dim))], "goals": [scores.tobytes()]})

    dealt = anchors.select("row", "id", "label", "dim", "vec", "goals", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    return materialise(dealt.repartition(blocks, "block", "dim").groupBy("block", "dim").applyInPandas(run, _BLOCK))


class Best:
    """For each anchor and window (lowest and highest score, both included) the first k of what was offered, by score and then id."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.score, self.id = np.full((*lo.shape, k), NONE, np.int64), np.full((*lo.shape, k), NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """The score that a row needs at least, by anchor and window."""
        return np.maximum(self.lo, self.score[:, :, -1])

    def offer(self, at: np.ndarray, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``score``: a row for each anchor of ``at``, a column for each of ``ids``, which ascend; ``allowed``: the pairs that count."""
        least, k = self.least(), self.k
        for g in range(self.lo.shape[1]):
            fits = allowed & (score >= least[at, g].astype(score.dtype)[:, None]) & (score <= self.hi[at, g].astype(score.dtype)[:, None])
            if len(ids) > k and np.count_nonzero(fits) > 4 * k * len(at):
                last = np.partition(np.where(fits, score, NONE), len(ids) - k, axis=1)[:, len(ids) - k, None]
                tie = fits & (score == last)
                fits &= (score > last) | (tie & (np.cumsum(tie, axis=1) <= k))
            a, c = np.nonzero(fits)
            if len(a):
                self._merge(g, at[a], score[a, c].astype(np.int64), ids[c])

    def _merge(self, g: int, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        better = (score > self.score[a, g, -1]) | (ids < self.id[a, g, -1])
        a, score, ids = a[better], score[better], ids[better]
        to = np.unique(a)
        a = np.concatenate((np.repeat(to, k), a))
        score, ids = np.concatenate((self.score[to, g].ravel(), score)), np.concatenate((self.id[to, g].ravel(), ids))
        order = np.lexsort((ids, -score, a))
        first = order[np.searchsorted(a[order], to)[:, None] + np.arange(k)]
        self.score[to, g], self.id[to, g] = score[first], ids[first]


def _windows(goals: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each goal's window: ``low`` to ``high`` percent; none for a goal of -1."""
    held = lambda x: max(NONE + 1, min(NO_ID, x))
    each = [(held(-(-low * p // 100)), held(high * p // 100)) if p >= 0 else (NO_ID, NONE) for p in goals.ravel().tolist()]
    return tuple(np.array(x, np.int64).reshape(goals.shape) for x in (zip(*each) if each else ((), ())))


class Shard:
    def __init__(self, ids: bytes, labels: bytes, matrix: bytes, lists: bytes, dim: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        self.matrix, self.lists = _wide(matrix, n, dim), _wide(lists, dim, n)
        self._as: dict[type, np.ndarray] = {}

    def _rows(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.matrix.astype(kind)
        return self._as[kind]

    def _kind(self, anchors: np.ndarray) -> type:
        """A type in which every sum of products is exact."""
        most = math.prod(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (self.matrix, anchors)) * anchors.shape[1]
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def walk(self, anchors: np.ndarray, take: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Sorted access for ``anchors`` together.  ``take`` gets the numbers of the anchors still open, the places that come up, in order,
        their scores and the anchors' thresholds, and returns which of these anchors stay open."""
        n, dim = self.matrix.shape
        kind = self._kind(anchors)
        rows, each = self._rows(kind), np.arange(dim)
        seen, depth, step, at = np.zeros(n, bool), 0, FIRST_DEPTH, np.arange(len(anchors))
        while len(at) and not seen.all():
            asked = anchors[at]
            up, down = np.flatnonzero((asked > 0).any(axis=0)), np.flatnonzero((asked < 0).any(axis=0))
            to = min(n, depth + step)
            new = np.zeros(n, bool)
            if not len(up) and not len(down):                       # every score is 0
                to, new[:] = n, True
            new[self.lists[up, n - to:n - depth]] = True            # sorted access
            new[self.lists[down, depth:to]] = True
            new = np.flatnonzero(new & ~seen)
            seen[new] = True
            depth, step = to, step * 4
            highest, lowest = (self.matrix[self.lists[:, p], each].astype(np.int64) for p in (n - to, to - 1))
            bound = np.maximum(asked, 0) @ highest + np.minimum(asked, 0) @ lowest
            at = at[take(at, new, asked.astype(kind) @ rows[new].T, bound)]   # random access

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[np.ndarray]:
        """For each window (lowest and highest score, None: open) the places of its first k allowed rows, in order."""
        order = np.argsort(self.ids, kind="stable")
        rank = np.argsort(order)
        lo, hi = (np.array([[none if w[i] is None else w[i] for w in windows]], np.int64) for i, none in ((0, NONE + 1), (1, NO_ID)))
        best, self.score = Best(lo, hi, k), np.zeros(len(order), np.int64)

        def take(at: np.ndarray, new: np.ndarray, score: np.ndarray, bound: np.ndarray) -> np.ndarray:
            self.score[new] = score[0]
            new = np.sort(rank[new])
            best.offer(at, self.score[order[new]][None], allowed[order[new]][None], new)
            return (bound[:, None] >= best.least()[at]).any(axis=1)

        self.walk(anchor[None].astype(np.int64), take)
        return [order[i[s > NONE]] for s, i in zip(best.score[0], best.id[0])]


class Block:
    """Anchors that meet one shard after the other, and the best rows so far."""

    def __init__(self, rows: bytes, ids: bytes, labels: bytes, anchors: bytes, goals: bytes, dim: int, same: bool, k: int, low: int, high: int):
        self.rows, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rows, ids, labels))
        n = len(self.rows)
        self.anchors, self.same = _wide(anchors, n, dim).astype(np.int64), same
        goals = np.frombuffer(goals, np.int64).reshape(n, -1)
        lo, hi = (np.full((n, 1), NONE + 1), np.full((n, 1), NO_ID)) if same else _windows(goals, low, high)
        self.parts = [slice(i, i + AT_ONCE) for i in range(0, n, AT_ONCE)]
        self.best = [Best(lo[p], hi[p], k) for p in self.parts]

    def meet(self, shard: Shard) -> None:
        for part, best in zip(self.parts, self.best):
            ids, labels = self.ids[part], self.labels[part]

            def take(at: np.ndarray, new: np.ndarray, score: np.ndarray, bound: np.ndarray) -> np.ndarray:
                alike = labels[at, None] == shard.labels[new]
                best.offer(at, score, (alike if self.same else ~alike) & (ids[at, None] != shard.ids[new]), shard.ids[new])
                return (bound[:, None] >= best.least()[at]).any(axis=1)

            shard.walk(self.anchors[part], take)

    def found(self) -> pa.RecordBatch:
        score, ids = (np.concatenate([getattr(b, x) for b in self.best]) for x in ("score", "id"))
        a, g, r = np.nonzero(score > NONE)
        return pa.record_batch([pa.array(self.rows[a]), pa.array(g.astype(np.int32)), pa.array(ids[a, g, r]), pa.array(score[a, g, r])],
                               names=["row", "goal", "id", "score"])


def _ask(anchors: DataFrame, index: DataFrame, blocks: int, same: bool, k: int, low: int, high: int, positives: int) -> DataFrame:
    """(row, goal, id, score, rank): the first k rows for each goal of every anchor (row, id, label, dim, vec, goals).  The
    goals are positive scores, each with its window of low to high percent; with ``same`` there is one open window."""
    asked = anchor_blocks(anchors, blocks, 0 if same else positives)
    # A joined row holds a shard and a block, so few of them make a batch.
    anchors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, met = None, None, {}
        for b in batches:
            for i in range(b.num_rows):
                get = lambda *names: [b.column(n)[i].as_py() for n in names]  # noqa: B023, E731
                dim, number, block = get("dim", "shard", "block")
                if key != (dim, number):
                    shard, key = Shard(*get("ids", "labels", "matrix", "lists"), dim), (dim, number)
                if (dim, block) not in met:
                    met[dim, block] = Block(*get("anchor_rows", "anchor_ids", "anchor_labels", "anchors", "goals"), dim, same, k, low, high)
                met[dim, block].meet(shard)
        for block in met.values():
            yield block.found()

    # A nested loop over the partitions of both: as equal keys, every block would be copied for every shard, in a broadcast or a shuffle.
    met = index.coalesce(SLICES).join(asked.hint("shuffle_replicate_nl"), "dim")
    found = met.mapInArrow(run, "row long, goal int, id long, score long")
    order = Window.partitionBy("row", "goal").orderBy(F.desc("score"), "id")
    return materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by ``every`` and each
    of its first positives, the first negatives that score ``low`` to ``high`` percent of the positive."""
    workers(vectors.sparkSession)
    rows = materialise(quantised(vectors, id_col, vec_col, label_col)).withColumn("row", F.monotonically_increasing_id())
    shards = max(1, math.ceil(rows.count() / PER_SHARD))
    anchors = materialise(rows.where((F.col("id") != NO_ID) & (F.col("id") % every == 0)))
    blocks = max(1, math.ceil(anchors.count() / ANCHORS))
    index = sorted_lists(rows, shards)
    first = _ask(anchors.withColumn("goals", F.lit(None).cast("array<long>")), index, blocks, True, positives, low, high, positives)
    goals = (first.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found")))
    goals = materialise(goals.select("row", F.col("found").getField("id").alias("partners"), F.col("found").getField("score").alias("goals")))
    # Written vectors and lists take many times their file's size in memory, from which Spark would choose a broadcast.
    wanted = materialise(anchors.join(goals.hint("merge"), "row"))
    workers(vectors.sparkSession)
    second = _ask(wanted, index, blocks, False, negatives, low, high, positives)
    named = second.join(wanted.select("row", F.col("id").alias("anchor_id"), "partners", "goals").hint("merge"), "row")
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return named.select("anchor_id", known(F.expr("partners[goal]")).alias("positive_id"), "rank", known(F.col("id")).alias("negative_id"),
                        F.expr("goals[goal]").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
                  [floor(256 * x::double) for x in embedding] q
           from embeddings where label is not null and embedding is not null
             and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_dot_product(a.q, b.q)::bigint score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select * from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b, p.score ps, s.b nb, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) r
      from p join s on s.a = p.a and not s.same and 100 * s.score between 30 * p.score and 90 * p.score)
select a anchor_id, b positive_id, r::integer rank, nb negative_id, ps positive_score, ns negative_score from n where r <= 10
"""
