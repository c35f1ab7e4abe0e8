"""N-gram Jaccard join with a token-group matrix.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct n-word shingles.  Tokens
are 64-bit shingle hashes; documents with equal sets are one class and only classes are compared.  No
linked pair is lost; the bounds are:

* Screening.  With s = ceil(percent * n / 100), a linked pair shares r tokens among the first n - s + r of each set in any
  one order (extended prefix).  In hash order about a fifth of the tokens is counted over the corpus, and a class
  stays only if few enough of them are unique.  The classes that stay are counted again with all their tokens, those
  with fewer than s shared tokens go, and the rest is counted once more while many go: what only they shared is unique then.
  A token's single owner is known where it is counted, so no join follows.
* Rare tokens.  Over all shared tokens, ordered by their count, the least one that a linked pair has in common is among the first
  shared - s + 1 of each (prefix filter): common passages drop out, so the posting lists that are joined are short.  A
  pair that meets there shares no more than either has from that token on (``left``), which rules out most.
* Groups.  In three rounds each class is verified against the one head with which it shares most rare tokens.  The first
  round's head names the class's group, linked or not; verified links make parts.  Pairs whose shared tokens could not
  suffice are not looked at.
* Matrix.  The token-group matrix holds the union of shared tokens of every group.  A class queries it by its rare tokens, the
  overlap of all its tokens with each other group's union bounds what any member can share, and only groups that reach what
  their smallest member needs are opened; their members of other parts that share a rare token are verified.
* Within a group, members of different parts meet by the tokens that the head lacks (see ``_within``).

Verification recomputes both sets from the texts.  A group of g near copies costs about g verified pairs, not g * g.

Defined results: texts without words, null texts included, have an empty set and link with nothing (their component is their own id);
rows that repeat an id and a text are one document; a null id never names a component that has another id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.llm.common import byte_texts, components, materialise, small, window_hashes, word_hashes, workers


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words; a short text is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, n))


def _class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bounds:
    """Prefix lengths for sets of n tokens; ``share`` is the part of the set by which a prefix is lengthened."""

    def __init__(self, percent: int, share: int):
        self.percent, self.share = percent, share

    def least(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def extra(self, n: int) -> int:
        return max(1, self.share * n // 100)

    def length(self, n: int) -> int:
        return n - self.least(n) + self.extra(n)

    def held(self, n: Column) -> Column:
        """``length`` as a column."""
        return n - F.floor((n * self.percent + 99) / 100) + F.greatest(F.lit(1), F.floor(n * self.share / 100))

    def need(self, n: Column) -> Column:
        """Tokens that a linked partner shares among the lengthened prefixes, however small the partner."""
        least = F.floor((n * self.percent + 99) / 100)
        return F.greatest(F.lit(1), F.floor(least * self.share / 100))


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def _tokens(rows: DataFrame, n: int, bounds: Bounds | None) -> DataFrame:
    """(key, token) of the lengthened prefixes, or of all tokens; ``rows`` has (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [s[:bounds.length(len(s))] if bounds else s for s in (shingles(w, n) for w in word_hashes(byte_texts(b.column(1)), fold=True))]
            if parts:
                keys = np.repeat(b.column(0).to_numpy(), [len(p) for p in parts])
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.concatenate(parts).view(np.int64))], names=["key", "token"])

    return rows.mapInArrow(run, "key long, token long")


def _unique(found: DataFrame) -> DataFrame:
    """(key, alone): how many tokens of each key no other row has; keys without one are absent."""
    return (found.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("key")).where("times = 1")
            .groupBy("key").agg(F.count(F.lit(1)).alias("alone")))


def _sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_shingles, class) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(w, n) for w in word_hashes(byte_texts(b.column(2)), fold=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64())],
                                  names=["doc_id", "key", "n_shingles", "class"])

    return docs.select(F.col(id_col).cast("long"), _row(id_col, text_col), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, key long, n_shingles long, class long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""
    both = (pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = word_hashes(byte_texts(b.column(2)), fold=True)
            right = word_hashes(byte_texts(b.column(3)), fold=True)
            ok = []
            for x, y in zip(left, right):
                x, y = shingles(x, n), shingles(y, n)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialise(both.mapInArrow(run, "a long, b long"))


def ngram_links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, labels): (doc_id, key, n_shingles, class) of every row, and (class, component) of every linked class."""
    spark = docs.sparkSession
    workers(spark)
    sets = materialise(_sets(docs, n, id_col, text_col))

    # Screening over all rows by a part of their tokens, then among the classes that are left by all tokens.
    first = Bounds(percent, 5)
    found = _tokens(docs.select(_row(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text")), n, first)
    size = F.col("n_shingles")
    kept = (sets.where("n_shingles > 0").join(_unique(found), "key", "left")
            .where(first.held(size) - F.coalesce("alone", F.lit(0)) >= first.need(size))
            .groupBy("class").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n")))
    kept = small(materialise(kept)).withColumnRenamed("key", "__key")
    # One text a class; equal rows would give it twice.
    texts = docs.select(_row(id_col, text_col).alias("__k"), F.col(text_col).cast("string").alias("text")).join(
        kept, F.col("__k") == F.col("__key")).select("class", "n", "text")
    texts = materialise(texts)
    size = materialise(kept.select("class", "n"))
    found = materialise(_tokens(texts.select(F.col("class").alias("key"), "text"), n, None).withColumnRenamed("key", "class"))
    had, have = None, size.count()
    while had is None or have * 10 < had * 9:
        alone = _unique(found.withColumnRenamed("class", "key")).withColumnRenamed("key", "class")
        shared = F.col("n") - F.coalesce("alone", F.lit(0))
        size = materialise(size.join(alone, "class", "left").where(shared * 100 >= F.col("n") * percent).select("class", "n"))
        found = materialise(found.join(small(size.select("class")), "class"))
        had, have = have, size.count()
    texts = materialise(texts.drop("n").join(small(size.select("class")), "class").select("class", "text"))

    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    known = found.join(counts, "token").join(small(size), "class")
    order = Window.partitionBy("class").orderBy("times", "token")
    known = (known.withColumn("rank", F.row_number().over(order)).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("class")) - F.col("rank") + 1)
             .withColumn("s", F.col("left") + F.col("rank") - 1))
    known = materialise(known.select("class", "n", "s", "token", "left", (F.col("rank") <= F.col("s") - F.ceil(F.col("n") * percent / 100) + 1).alias("rare")))
    rare = known.where("rare").select("class", "n", "s", "token", "left")

    def near(s1: str, n1: str, s2: str, n2: str) -> Column:
        """Whether sets of n1 and n2 tokens could link if they shared the lesser of s1 and s2 tokens."""
        return F.least(s1, s2) * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent

    def parted(links: DataFrame | None, rows: DataFrame) -> DataFrame:
        """``rows`` with the part (component of the links so far) of each class."""
        if links is None:
            return rows.withColumn("part", F.col("class"))
        labels = components(links).select(F.col("node").alias("class"), F.col("component").alias("part"))
        return rows.join(labels, "class", "left").withColumn("part", F.coalesce("part", "class"))

    links = groups = None
    # Heads are the least altered members of a token's classes first, then of what is still apart.
    clean = (F.col("s") / F.col("n")).alias("clean")
    for lead in (clean, -F.col("part"), F.col("part")):
        rows = parted(links, rare)
        heads = rows.groupBy("token").agg(F.max(F.struct(lead.alias("lead"), "part", "class", "n", "left")).alias("h"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        heads = heads.where("lo < hi").select("token", F.col("h.class").alias("head"), F.col("h.part").alias("hp"), F.col("h.n").alias("hn"), F.col("h.left").alias("hl"))
        met = rows.join(heads, "token").where((F.col("part") != F.col("hp")) & near("left", "n", "hl", "hn"))
        best = met.groupBy("class", "head").count().groupBy("class").agg(F.max(F.struct("count", "head")).alias("b"))
        best = materialise(best.select(F.col("class").alias("a"), F.col("b.head").alias("b")))
        new = _verified(best, texts, n, percent)
        links = new if links is None else links.union(new)
        if groups is None:
            groups = best.select(F.col("a").alias("class"), F.col("b").alias("group"))

    # Every class that was compared with a head is in the head's group, linked with it or not.
    every = materialise(parted(links, known).join(groups, "class", "left").withColumn("group", F.coalesce("group", "class")))
    pairs = _across(every, near, percent).union(_within(every, percent))
    links = materialise(links.union(_verified(pairs.distinct(), texts, n, percent)))
    return sets, components(links).select(F.col("node").alias("class"), "component")


def _across(every: DataFrame, near, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups and parts that the token-group matrix cannot rule out."""
    matrix = every.select("token", "group").distinct()
    rows = every.where("rare")
    mixed = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.min("part").alias("first"), F.max("part").alias("last"))
    rows = materialise(rows.join(mixed.where("lo < hi and first < last").select("token"), "token").select("token", "class", "n", "left", "group", "part"))
    column = rows.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("left").alias("most"), F.min("part").alias("first"), F.max("part").alias("last"))
    # Of two groups the one with fewer classes asks.
    size = small(materialise(rows.groupBy("group").agg(F.count_distinct("class").alias("members"), F.min("class").alias("only"), F.min("n").alias("low"))))
    asking = rows.join(size, "group").select("token", "class", "n", "left", "part", F.struct("members", "group").alias("own"))
    column = column.join(size, "group").withColumn("other", F.struct("members", "group"))
    query = (asking.join(column, "token")
             .where((F.col("own") < F.col("other")) & near("left", "n", "most", "least") & ((F.col("first") != F.col("part")) | (F.col("last") != F.col("part"))))
             .select("class", "n", "group", "members", "only", "low").distinct())
    query = materialise(query)
    # A group of one class is its own union: the pair is verified as it is.
    alone = query.where("members = 1").select(F.col("class").alias("a"), F.col("only").alias("b"))
    overlap = (query.where("members > 1").join(every.select("class", "token"), "class").join(matrix, ["token", "group"])
               .groupBy("class", "group").agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"), F.first("low").alias("low")))
    opened = overlap.where(F.col("common") * (100 + percent) >= (F.col("n") + F.col("low")) * percent).select("class", "group")
    left = rows.select("token", "class", "n", "left", "part").join(small(materialise(opened)), "class")
    right = rows.select("token", "group", F.col("class").alias("b"), F.col("n").alias("bn"), F.col("left").alias("bl"), F.col("part").alias("bp"))
    return (left.join(right, ["token", "group"]).where(near("left", "n", "bl", "bn") & (F.col("part") != F.col("bp")))
            .select(F.col("class").alias("a"), "b").union(alone).distinct())


def _within(every: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one group but different parts that could link.

    Let h be the head, x and y two classes of its group, hx = |x & h|.  x and y share at most min(hx, hy) tokens of h, so
    a linked pair shares tokens outside h, or min(hx, hy) suffices.  In the second case one of the two has fewer
    tokens than h: otherwise both would link with h and be in one part.
    """
    members = every.select("class", "group", "part", "n", "s").distinct()
    # Tables of one row a group are written before their joins, so that a group with many members is not one task.
    apart = members.groupBy("group").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("group")
    members = materialise(members.join(small(materialise(apart)), "group"))
    heads = members.select(F.col("group").alias("class"), "group").distinct()
    tokens = every.select("class", "token")
    core = tokens.join(heads, "class").select("group", "token")
    outer = materialise(tokens.join(members, "class").join(core, ["group", "token"], "left_anti"))
    held = outer.groupBy("class").agg(F.count(F.lit(1)).alias("out"))
    # Outside tokens that are in several parts; a class has no more than these and its head's to share.
    parts = outer.groupBy("group", "token", "part").agg(F.count(F.lit(1)).alias("times"))
    top = parts.groupBy("group", "token").agg(F.max(F.struct("times", "part")).alias("t"), F.count(F.lit(1)).alias("k")).where("k > 1").select("group", "token", F.col("t.part").alias("top"))
    outer = outer.join(top, ["group", "token"]).join(held, "class").withColumn("core", F.col("s") - F.col("out")).drop("out", "s")
    could = outer.groupBy("class").agg(F.count(F.lit(1)).alias("e"))
    outer = materialise(outer.join(could, "class").where((F.col("core") + F.col("e")) * 100 >= F.col("n") * percent))
    right = outer.select("group", "token", F.col("class").alias("b"), F.col("part").alias("bp"), F.col("n").alias("bn"), F.col("core").alias("bc"), F.col("e").alias("be"))
    left = outer.where("part <> top")
    enough = lambda shared: shared * (100 + percent) >= (F.col("n") + F.col("bn")) * percent
    met = left.join(right, ["group", "token"]).where(
        (F.col("part") != F.col("bp")) & ((F.col("bp") == F.col("top")) | (F.col("class") < F.col("b")))
        & enough(F.least("core", "bc") + F.least("e", "be")))
    met = (met.select(F.least("class", "b").alias("x"), F.greatest("class", "b").alias("y"), "n", "bn", F.least("core", "bc").alias("core"))
           .groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("bn").alias("bn"), F.first("core").alias("core")))
    shared = met.where(enough(F.col("core") + F.col("c"))).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # The second case, by the rare tokens of short members.
    sized = members.join(held, "class", "left").withColumn("core", F.col("s") - F.coalesce("out", F.lit(0)))
    width = every.select("class", "n").distinct().join(heads, "class").select("group", F.col("n").alias("hn"))
    sized = materialise(sized.join(small(materialise(width)), "group").select("class", "group", "part", "n", "core", "hn"))
    short = sized.where("n < hn").select("group", F.col("class").alias("b"), F.col("part").alias("bp"), F.col("n").alias("bn"), F.col("core").alias("bc"))
    floor = small(materialise(short.groupBy("group").agg(F.min("bn").alias("least"))))
    loose = sized.join(floor, "group").where((F.col("core") * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
                                             & (F.col("core") * (100 + percent) < (F.col("n") + F.col("hn")) * percent))
    rare = every.where("rare").select("class", "token")
    loose = loose.drop("least", "hn").join(rare, "class")
    short = short.join(rare.withColumnRenamed("class", "b"), "b")
    plain = (loose.join(short, ["group", "token"]).where((F.col("part") != F.col("bp")) & enough(F.least("core", "bc")))
             .select(F.col("class").alias("a"), "b").distinct())
    return shared.union(plain)


def _named(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, component, component_id, key) for every row; the first component is null without words."""
    sets, labels = ngram_links(docs, n, percent, id_col, text_col)
    classes = sets.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("class", "component", "component_id")
    return sets.join(named, "class", "left").select("doc_id", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"), "key")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, key) for every row."""
    return _named(docs, n, percent, id_col, text_col).drop("component")


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, all columns unchanged: the row of the smallest id (null last), of equals that of the smallest
    text hash, of rows that repeat both the smallest row.  Rows without words stay as they are."""
    got = materialise(_named(docs, n, percent, "doc_id", "text").where("component is not null").groupBy("component", "doc_id", "key").agg(
        F.count(F.lit(1)).alias("times")))
    leads = got.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("lead")).select(
        F.col("lead.key").alias("__key"))
    leads = materialise(leads)
    again = materialise(got.where("times > 1").select(F.col("key").alias("__key")).join(leads, "__key", "left_semi").distinct())
    drop = got.select(F.col("key").alias("__key")).join(leads, "__key", "left_anti").union(again)
    at = _row("doc_id", "text")
    rest = docs.join(small(materialise(drop.distinct())), at == F.col("__key"), "left_anti")
    single = docs.join(small(again), at == F.col("__key"), "left_semi").groupBy(at.alias("__at")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return rest.union(single.select("__row.*"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end g
      from w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) r(i) where len(w) > 0),
z as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join z a on a.doc_id = x join z b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
t as (select x, y from l union select t.x, l.y from t join l on t.y = l.x)
select w.doc_id, coalesce(z.n, 0) n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id
from w left join z using (doc_id) left join (select x doc_id, min(y) m from t group by 1) using (doc_id)
"""
