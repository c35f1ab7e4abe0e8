"""Substring dedup by De Bruijn compaction.

In the De Bruijn graph of the corpus every window of ``k`` words is an edge between its first and last k - 1
words.  A word is removed when an edge that covers it occurs more than once.

* Edges are handled as runs: consecutive edges of a document whose smallest ``m``-word hash (minimizer) lies at the
  same place.  Equal edges have equal minimizers, so only runs whose minimizer occurs twice can hold a repeated
  edge, and only about one row for ten words is shuffled to find them.
* Runs of equal words are one class; a class that occurs twice has only repeated edges.  The edges of one
  member of every class are then compared across classes, which settles where repeats begin and end.
* Repeated runs that follow each other in some document become links of the graph: a run knows the run after it, so links are
  made of classes and not of places.  Links without a branch on either side are compacted to paths, first along the
  documents where the classes stand first, then by joins of what these stretches leave (pointer doubling, a logarithmic number of
  rounds; a ring is opened at its least node).  Every repeated class gets a coordinate: its path and its offset in edges from
  the path's start.
* The paths carry the removal: a document's runs are joined with the coordinates, runs of one path at one anchor (place less
  offset) are one occurrence of it, and the occurrence's repeated edges, in path coordinates, give the spans of at least ``k``
  words that go.  Rows that repeat a whole row are one source of places, so r of them cost r rows and not r * r pairs.
* Every step is written and its shuffle files go with it, so that disk holds the written steps and one shuffle at a time.

Defined results: a null text has no words; a text of fewer than k words loses nothing; rows that repeat an id or a whole row
are separate documents, whose windows repeat each other; a null id passes through; an empty table gives an empty
result; other columns are not read.  Texts of any length are hashed in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.llm import common
from vesselflow.llm.common import byte_texts, mix, small, small_bytes, window_hashes, word_hashes, workers

K, M = 35, 16
RUNS = "doc long, start int, n int, minimizer long, content long, next long"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOW = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as ``common.materialise`` does; what the write has shuffled is dropped when it ends, for nothing reads it again."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")
    try:
        return common.materialise(df)
    finally:
        conf.set(DROP_SHUFFLES, before)


def _doc(id_col: str, text_col: str) -> Column:
    """A row's key: rows of equal id and text share it, and are counted by rows all the same."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def runs(words: np.ndarray, k: int, m: int, step: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(start, edges, minimizer hash, content hash) of the runs of one document's edges."""
    parts = [_runs(words[at:at + step + k - 1], at, k, m) for at in range(0, max(1, len(words) - k + 1), step)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(words: np.ndarray, at: int, k: int, m: int) -> tuple[np.ndarray, ...]:
    n, wide = len(words) - k + 1, k - m + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    small = window_hashes(words, m)
    low = (small & ~_LOW) | np.arange(len(small), dtype=np.uint64)       # the first of equals is the least
    have = 1
    while have < wide:                                                   # least of ``wide`` in a row, by doubling
        add = min(have, wide - have)
        low = np.minimum(low[:len(low) - add], low[add:])
        have += add
    place = (low[:n] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    size = np.diff(np.append(first, n))
    power = np.multiply.accumulate(np.full(len(words), _ODD, np.uint64))
    back = np.multiply.accumulate(np.full(len(words), np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64))
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * power)))
    content = mix((total[first + size + k - 1] - total[first]) * back[first] + size.astype(np.uint64))
    return first + at, size, small[place[first]], content


def _emit(docs: DataFrame, k: int, m: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [runs(w, k, m) for w in word_hashes(byte_texts(b.column(1)))]
            if not got:
                continue
            start, size, least, content = (np.concatenate(x) for x in zip(*got))
            count = np.array([len(g[0]) for g in got])
            doc = np.repeat(b.column(0).to_numpy(), count)
            last = np.zeros(len(content), bool)
            last[np.cumsum(count)[count > 0] - 1] = True
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                                   pa.array(least.view(np.int64)), pa.array(content.view(np.int64)),
                                   pa.array(np.roll(content, -1).view(np.int64), mask=last)],
                                  names=["doc", "start", "n", "minimizer", "content", "next"])

    return docs.select(_doc(id_col, text_col), F.col(text_col).cast("string")).mapInArrow(run, RUNS)


def _edges(docs: DataFrame, reps: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(content, edge, j, once): the edge hashes of one member of every class, and whether it is the only member."""
    lists = reps.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "content", "once")).alias("runs"))
    # Four arrays take 17 bytes a run in a broadcast, an array of structs 48.
    lists = materialise(lists.select(F.col("doc").alias("__doc"), *[F.col(f"runs.{c}").alias(c) for c in ("start", "n", "content", "once")]))
    lists = small_bytes(lists, 16 + 24 * F.size("start"))
    # Rows of equal key have equal words: any one of them serves, and the counts do not come from here.
    rows = docs.select(_doc(id_col, text_col).alias("__key"), F.col(text_col).cast("string").alias("__text")).join(
        lists, F.col("__key") == F.col("__doc")).select("__text", "start", "n", "content", "once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edge, content, place, once = [], [], [], []
            at = b.column(1).offsets.to_numpy()
            at = at - at[0]
            start, size, cls, single = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(1, 5))
            for i, w in enumerate(word_hashes(byte_texts(b.column(0)))):
                s, n, c, o = (x[at[i]:at[i + 1]] for x in (start, size, cls, single))
                j = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                edge.append(window_hashes(w, k)[np.repeat(s, n) + j])
                content.append(np.repeat(c, n))
                place.append(j)
                once.append(np.repeat(o, n))
            if edge:
                yield pa.record_batch([pa.array(np.concatenate(content), pa.int64()), pa.array(np.concatenate(edge).view(np.int64)),
                                       pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(once))],
                                      names=["content", "edge", "j", "once"])

    return rows.mapInArrow(run, "content long, edge long, j int, once boolean")


def spans(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, end, path): the repeated spans (word places, end exclusive) of every document, by path."""
    workers(docs.sparkSession)
    found = _emit(docs, k, m, id_col, text_col)
    # Written, so that both sides of the join are plain exchanges and a frequent minimizer's rows can be split.
    twice = materialise(found.select("minimizer").groupBy("minimizer").count().where("count > 1").select("minimizer"))
    places = materialise(found.join(small(twice), "minimizer").select("doc", "start", "n", "content", "next"))

    classes = materialise(places.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("n"),
                                                        F.min(F.struct("doc", "start")).alias("at")))
    reps = classes.select("content", "n", "at.doc", "at.start", (F.col("times") == 1).alias("once"))
    edges = materialise(_edges(docs, reps, k, id_col, text_col))
    # An edge of a class that occurs once is repeated if another class, or another place of it, has it too.
    again = edges.groupBy("edge").agg(F.sum(F.when(F.col("once"), 1).otherwise(2)).alias("t")).where("t > 1").select("edge")
    marked = edges.where("once").join(again, "edge").groupBy("content").agg(F.array_sort(F.collect_set("j")).alias("j"))
    part = F.expr("""transform(arrays_zip(filter(j, x -> not array_contains(j, x - 1)), filter(j, x -> not array_contains(j, x + 1))),
                     x -> struct(x['0'] as first, x['1'] + 1 as end))""")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("end")))
    hits = materialise(classes.join(marked, "content", "left").select(
        "content", "n", "at.doc", "at.start", F.when(F.col("times") > 1, whole).otherwise(part).alias("js")).where("js is not null"))

    # Links: a class whose last edge is repeated, followed in some document by one whose first is.
    tail = hits.where("element_at(js, -1).end = n").select(F.col("content").alias("a"), F.col("n").alias("step"))
    head = hits.where("element_at(js, 1).first = 0").select(F.col("content").alias("b"))
    pairs = places.where("next is not null").select(F.col("content").alias("a"), F.col("next").alias("b")).distinct()
    links = materialise(pairs.join(tail, "a").join(head, "b").select("a", "b", "step"))
    out = links.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("b2"), F.min("step").alias("step")).where("b = b2")
    into = links.groupBy("b").agg(F.min("a").alias("a1"), F.max("a").alias("a2")).where("a1 = a2")
    simple = out.join(into, "b").where("a = a1 and a <> b").select("a", "b", "step")
    paths = compact(hits.select("content", "js", "doc", "start"), simple)

    occurrences = (places.join(paths, "content").select("doc", "path", (F.col("start") - F.col("offset")).alias("anchor"), "offset", F.explode("js").alias("s"))
                   .groupBy("doc", "path", "anchor")
                   .agg(F.array_sort(F.collect_set(F.struct((F.col("offset") + F.col("s.first")).alias("first"), (F.col("offset") + F.col("s.end")).alias("end")))).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, first, end = stretches(*_lists(b.column(3)))
            doc, path, anchor = (b.column(i).to_numpy()[row] for i in range(3))
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array((anchor + first).astype(np.int32)),
                                   pa.array((anchor + end + k - 1).astype(np.int32)), pa.array(path, pa.int64())],
                                  names=["doc", "start", "end", "path"])

    return occurrences.mapInArrow(run, "doc long, start int, end int, path long")


def compact(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(content, path, offset, js): the coordinate of every class.  ``links`` (a, b, step) hold at most one link out of and one into
    a class; a path is named by its first class, and a class without links is a path of its own.  Where ``classes`` have the place
    (doc, start) of one member, links between neighbours there are joined in one pass and the doubling moves only what is left."""
    if "doc" not in classes.columns:
        classes = classes.withColumns({"doc": F.col("content"), "start": F.lit(0)})
    along = Window.partitionBy("doc").orderBy("start")
    rows = classes.join(links.select(F.col("a").alias("content"), "b", F.col("step").cast("long").alias("step")), "content", "left")
    rows = rows.select("content", "js", "b", "step", "doc", "start", F.coalesce(F.lag("b").over(along) != F.col("content"), F.lit(True)).alias("new"),
                       F.coalesce(F.lead("content").over(along) == F.col("b"), F.lit(False)).alias("inside"),
                       F.coalesce(F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum"))
    first = F.last(F.when(F.col("new"), F.struct("content", "sum")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = materialise(rows.withColumn("first", first).select("content", "js", "b", "step", "inside", F.col("first.content").alias("head"),
                                                              (F.col("sum") - F.col("first.sum")).alias("inner")))
    left = materialise(rows.where("b is not null and not inside").select(F.col("head").alias("a"), "b", (F.col("inner") + F.col("step")).alias("step")))
    ranked = _ranked(left.where("a <> b"))
    found = rows.join(ranked.where("not moving").select(F.col("node").alias("head"), "to", "dist"), "head", "left").select(
        "content", "js", F.coalesce("to", "head").alias("path"), (F.coalesce("dist", F.lit(0)) + F.col("inner")).alias("offset"))
    ring = materialise(ranked.where("moving").select(F.col("node").alias("head")).union(left.where("a = b").select("a")))
    if not ring.isEmpty():
        found = found.join(_opened(rows.join(ring, "head", "left_semi")), "content", "left").select(
            "content", "js", F.coalesce("r_path", "path").alias("path"), F.coalesce("r_offset", "offset").alias("offset"))
    return materialise(found.select("content", "path", F.col("offset").cast("long").alias("offset"), "js"))


def _opened(rows: DataFrame) -> DataFrame:
    """(content, r_path, r_offset) of classes on rings, each opened at its least class; ``rows`` (content, b, step) hold whole rings."""
    links = materialise(rows.select(F.col("content").alias("a"), "b", "step"))
    least = materialise(_ranked(links).where("node = least").select(F.col("node").alias("b")))
    ranked = _ranked(materialise(links.join(least, "b", "left_anti")))
    return links.join(ranked, F.col("a") == F.col("node"), "left").select(
        F.col("a").alias("content"), F.coalesce("to", "a").alias("r_path"), F.coalesce("dist", F.lit(0)).alias("r_offset"))


def _ranked(links: DataFrame) -> DataFrame:
    """(node, to, dist, least, moving) of every class with a predecessor: the first class of its path and the edges from there, by pointer
    doubling.  Rows that still move at the end lie on rings; ``least`` is their ring's least class."""
    state = materialise(links.select(F.col("b").alias("node"), F.col("a").alias("to"), F.col("step").cast("long").alias("dist"),
                                     F.least("a", "b").alias("least"), F.lit(True).alias("moving")))
    before, reach = state.count(), 1
    while before:
        ahead = state.select(F.col("node").alias("t"), F.col("to").alias("t_to"), F.col("dist").alias("t_dist"), F.col("least").alias("t_least"))
        moved = state.where("moving").join(ahead, F.col("to") == F.col("t"), "left").select(
            "node", F.coalesce("t_to", "to").alias("to"), (F.col("dist") + F.coalesce("t_dist", F.lit(0))).alias("dist"),
            F.least("least", "t_least").alias("least"), F.col("t").isNotNull().alias("moving"))
        state = materialise(moved.unionByName(state.where("not moving")))
        left, reach = state.where("moving").count(), 2 * reach
        # Every round stops some row of each path that is not done, so an unchanged number means rings alone.
        if left == 0 or (left == before and reach >= left):
            break
        before = left
    return state


def _lists(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(row, first, end) of the intervals in a column of lists of (first, end)."""
    at, inner = column.offsets.to_numpy(), column.values
    return np.repeat(np.arange(len(column)), np.diff(at)), *(inner.field(i).to_numpy()[at[0]:at[-1]] for i in range(2))


def stretches(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The unions of a row's intervals that meet or overlap; intervals ascend by row, then by first."""
    if not len(row):
        return row, first, end
    # The furthest end so far within the row: ends are lifted by their row, so that one running maximum serves all.
    first, end = first.astype(np.int64), end.astype(np.int64)
    low = int(min(first.min(), end.min()))
    lift = row * (int(end.max()) - low + 1) - low
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | ((first + lift)[1:] > reach[:-1])))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], first[new], (reach - lift)[last]


def substring_dedup(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans, kept) for every row; ``kept`` is the text that stays."""
    cut = materialise(spans(docs, k, m, id_col, text_col))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end = stretches(*_lists(b.column(1)))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(b.column(0))))))
            pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
            yield pa.record_batch([b.column(0), pa.array(np.diff(b.column(1).offsets.to_numpy()), pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], names=["doc", "n", "cuts"])

    # Spans of one document overlap where paths meet: their unions are few, and only they go to the texts.
    lists = cut.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    lists = materialise(lists.mapInArrow(unite, "doc long, n long, cuts array<struct<start: int, end: int>>"))
    lists = small_bytes(lists, 16 + 16 * F.size("cuts")).withColumnRenamed("doc", "__doc")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"),
                       _doc(id_col, text_col).alias("__key")).join(lists, F.col("__key") == F.col("__doc"), "left").select("__id", "__text", "cuts", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, cuts, spanned in zip(byte_texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words, left, at = (text or b"").split(), [], 0
                for c in cuts or ():
                    left += words[at:c["start"]]
                    at = max(at, c["end"])
                left += words[at:]
                kept = b" ".join(left)
                rows.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), spanned or 0, kept))
            n, gone, sha, count, kept = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                                   pa.array(count, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                  names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept string")


SQL = rf"""
with w as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
e as (select r, i s, array_to_string(w[i:i + {K - 1}], ' ') t from w, unnest(range(1, len(w) - {K - 2})) x(i)),
d as (select r, s from (select r, s, count(*) over (partition by t) c from e) where c > 1),
p as (select r, doc_id, i, w[i] word from w, unnest(range(1, len(w) + 1)) x(i)),
c as (select p.*, coalesce(max(d.s) over (partition by p.r order by p.i rows unbounded preceding) > p.i - {K}, false) gone
      from p left join d on p.r = d.r and p.i = d.s)
select w.doc_id, len(w.w) n_words, (select count(*) from c where c.r = w.r and gone) n_removed,
       sha256(coalesce((select string_agg(word, ' ' order by i) from c where c.r = w.r and not gone), '')) kept_sha256 from w
"""
