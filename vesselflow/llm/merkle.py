"""Merkle manifest of a dataset, its trees stored as blocks in van Emde Boas order.

Every row is a leaf; the leaves of a source, in order of id, form a 16-ary hash tree, and the sources' roots form
another tree over all sources.  A tree is cut into aligned *blocks* of ``HEIGHT`` levels (4,096 leaves).  The roots of a tree's blocks are
the leaves of its next blocks, and so on until one block holds the tree's root, so a tree of any size takes a few rounds
of bounded groups, each round 1/4,096 of the one before.

Inside a block the nodes lie in van Emde Boas order: a subtree of k levels is its upper k // 2 levels, then the
subtrees that hang below them, each laid out in the same way.  ``address`` computes a node's place from its
level and number alone; construction writes through it and proofs read siblings through it.

Leaves are ranked by a range-partitioned sort; a source that fills many partitions is placed by the counts of the partitions
before, so no source is ever one task.  Texts are hashed where they are read and never shuffled.  A proof is its
block's siblings followed by the path of the block's root, which is handed down block by block.

Defined results: null fields hash as ``-``; rows with equal ids are ordered by their leaves, null ids come first; a null id is never
tampered; rows that repeat are leaves each; an empty table gives an empty result; texts of any length are one digest;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.llm.common import materialise, small, workers

WAYS, HEIGHT = 16, 3
SPAN = WAYS ** HEIGHT
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left: binary, right: binary>"


def size(levels: int) -> int:
    """Nodes of a full subtree of so many levels."""
    return (WAYS ** levels - 1) // (WAYS - 1)


def address(depth: int, number: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``number`` of level ``depth`` (root 0) in a subtree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(depth, number, upper)
    span = WAYS ** (depth - upper)
    return size(upper) + number // span * size(levels - upper) + address(depth - upper, number % span, levels - upper)


@lru_cache(maxsize=None)
def _places(depth: int, levels: int) -> np.ndarray:
    return address(depth, np.arange(WAYS ** depth), levels)


def height_of(count: int, top: bool) -> int:
    """Hash levels of a block: as many as its leaves need if it holds the tree's root, else all."""
    h = 0
    while top and WAYS ** h < count:
        h += 1
    return h if top else HEIGHT


def construct(digests: list[bytes], top: bool) -> bytes:
    """The nodes of a block in van Emde Boas order, cut after the last one used; the root is at place 0."""
    height = height_of(len(digests), top)
    nodes = np.zeros((size(height + 1), DIGEST), np.uint8)
    row = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
    used = 0
    for depth in range(height, -1, -1):
        at = _places(depth, height + 1)[:len(row)]
        nodes[at] = row
        used = max(used, int(at.max()) + 1)
        if depth:
            text = row.tobytes().hex().encode()
            runs = [text[i:i + WAYS * 2 * DIGEST] for i in range(0, len(text), WAYS * 2 * DIGEST)]
            row = np.frombuffer(b"".join(hashlib.sha256(r).digest() for r in runs), np.uint8).reshape(-1, DIGEST)
    return nodes[:used].tobytes()


class Block:
    """A stored block; ``siblings`` finds the rest of a leaf's runs by address, from the leaf's level to below the root."""

    def __init__(self, nodes: bytes, count: int, top: bool):
        self.height = height_of(count, top)
        table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
        self.rows = {}
        for depth in range(self.height, 0, -1):
            n = -(-count // WAYS ** (self.height - depth))
            self.rows[depth] = table[_places(depth, self.height + 1)[:n]].tobytes()

    def siblings(self, leaf: int) -> list[tuple[bytes, bytes]]:
        out = []
        for depth in range(self.height, 0, -1):
            run = leaf // WAYS * WAYS
            row = self.rows[depth]
            out.append((row[run * DIGEST:leaf * DIGEST], row[(leaf + 1) * DIGEST:(run + WAYS) * DIGEST]))
            leaf //= WAYS
        return out


def fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        digest = hashlib.sha256((left + digest + right).hex().encode()).digest()
    return digest


def leaves(docs: DataFrame, id_col: str = "doc_id", tampered=None) -> DataFrame:
    """(tree, doc_id, digest, changed) of every row; ``tampered`` is a condition under which ``changed`` is the digest of the
    row with its text's A-Z in lower case, else null."""
    def digest(text):
        cols = [F.col(id_col if f == "doc_id" else f).cast("string") for f in FIELDS[:-1]] + [text]
        return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]), 256))

    text = F.col("text").cast("string")
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(tampered, digest(lower)) if tampered is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-"))       # null first
    return docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), changed.alias("changed"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their rank in their tree (from 0) by ``order`` and the tree's ``total``."""
    # A written row's number makes every sort key different, so that repeated rows spread over partitions as well.
    rows = materialise(rows).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows.orderBy("tree", *order, "row").drop("row").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return rows.join(small(materialise(places)), ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(rows: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, block, total, leaves, nodes, root) from ranked rows."""
    found = rows.groupBy("tree", F.shiftright("rank", 4 * HEIGHT).alias("block"), "total").agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest", *payload))).alias("leaves"))
    found = found.select("tree", "block", "total", F.col("leaves").getField("digest").alias("digests"), F.transform(
        "leaves", lambda x: F.struct(x["rank"].alias("rank"), *[x[p].alias(p) for p in payload])).alias("leaves"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [construct(d, t <= SPAN) for d, t in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([len(d) for d in b.column(3)], pa.int64()), b.column(4),
                                   pa.array(nodes, pa.binary()), pa.array([n[:DIGEST] for n in nodes], pa.binary())],
                                  names=["tree", "block", "total", "count", "leaves", "nodes", "root"])

    kept = found.schema["leaves"].dataType.simpleString()
    return materialise(found.mapInArrow(run, f"tree string, block long, total long, count long, leaves {kept}, nodes binary, root binary"))


def forest(rows: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each round, (tree, root) of every tree) over ranked rows (tree, rank, total, digest, payload)."""
    rounds, tops = [], None
    while True:
        blocks = _blocks(rows, payload)
        rounds.append(blocks)
        done = blocks.where(F.col("total") <= SPAN).select("tree", "root")
        tops = done if tops is None else tops.union(done)
        open_ = blocks.where(F.col("total") > SPAN)
        if open_.isEmpty():
            return rounds, tops
        rows = open_.select("tree", F.col("block").alias("rank"), F.ceil(F.col("total") / SPAN).cast("long").alias("total"), F.col("root").alias("digest"))
        payload = []


def _handed_down(blocks: DataFrame) -> DataFrame:
    """(tree, block, steps, subroot) of the blocks below: their root's siblings in this block, then this block's own path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        for b in batches:
            for tree, block, total, count, nodes, steps, subroot in zip(*(c.to_pylist() for c in b.columns)):
                held = Block(nodes, count, total <= SPAN)
                paths = [[{"left": x, "right": y} for x, y in held.siblings(i)] + steps for i in range(count)]
                yield pa.record_batch([pa.array([tree] * count, pa.string()), pa.array([block * SPAN + i for i in range(count)], pa.int64()),
                                       pa.array(paths, kind), pa.array([subroot] * count, pa.binary())], names=["tree", "block", "steps", "subroot"])

    return blocks.select("tree", "block", "total", "count", "nodes", "steps", "subroot").mapInArrow(
        run, f"tree string, block long, steps array<{STEP}>, subroot binary")


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first round's blocks with the path (steps) of their root and their tree's root; ``tops`` gives (tree, steps, subroot)
    of the trees."""
    tops = small(tops)
    below = None
    for blocks in reversed(rounds):
        paths = blocks.where(F.col("total") <= SPAN).join(tops, "tree")
        if below is not None:
            names = paths.columns
            paths = paths.union(blocks.join(below, ["tree", "block"]).select(*names))
        below = materialise(_handed_down(paths)) if blocks is not rounds[0] else None
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", tampered=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    spark = docs.sparkSession
    workers(spark)
    # A block is one row of up to SPAN leaves, so few of them make a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    payload = ["doc_id", "changed"]
    rounds, tops = forest(ranked(leaves(docs, id_col, tampered), ["doc_id", "digest"]), payload)
    tops = materialise(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest")))
    above, top = forest(ranked(tops, ["key"]), ["key"])
    found = top.first()
    root = found["root"] if found else b""
    start = spark.createDataFrame([("", [], bytearray(root))], f"tree string, steps array<{STEP}>, subroot binary")
    # The path of a source's root: handed down to one block more, and named by the sources of the first round.
    blocks = descend(above, start)
    sources = above[0].select("tree", F.explode("leaves").alias("x")).select("tree", F.col("x.rank").alias("block"), F.col("x.key").alias("key"))
    paths = _handed_down(blocks).drop("subroot").join(sources, ["tree", "block"]).select(F.col("key").alias("tree"), "steps")
    paths = materialise(paths.join(tops.select(F.col("key").alias("tree"), F.col("digest").alias("subroot")), "tree"))
    ready = descend(rounds, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for total, count, nodes, steps, subroot, docs_of, changed in zip(*(c.to_pylist() for c in b.columns)):
                held = Block(nodes, count, total <= SPAN)
                rest = [(s["left"], s["right"]) for s in steps]
                rest_text = b"".join(x + y for x, y in rest).hex()
                digests = held.rows.get(held.height, nodes[:DIGEST])
                known: dict[bytes, bytes] = {}               # the block's root, folded to the end, mostly the same one
                leaf, proof, folded = [], [], []
                for i in range(count):
                    own = held.siblings(i)
                    at = digests[i * DIGEST:(i + 1) * DIGEST]
                    leaf.append(at.hex())
                    proof.append(hashlib.sha256((b"".join(x + y for x, y in own).hex() + rest_text).encode()).hexdigest())
                    end = fold(at if changed[i] is None else changed[i], own)
                    if end not in known:
                        known[end] = fold(end, rest)
                    folded.append(known[end])
                yield pa.record_batch([pa.array(docs_of, pa.int64()), pa.array(leaf), pa.array([subroot.hex()] * count), pa.array([root.hex()] * count),
                                       pa.array(proof), pa.array([f.hex() for f in folded]), pa.array([f == root for f in folded], pa.bool_())],
                                      names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    root = bytes(root)
    return ready.select("total", "count", "nodes", "steps", "subroot", F.col("leaves").getField("doc_id").alias("ids"),
                        F.col("leaves").getField("changed").alias("changed")).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def one_in_five(id_col: str = "doc_id"):
    """The rows whose id's crc32 is divisible by five."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0


def _sql() -> str:
    def digest(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')" for c in (*FIELDS[:-1], text)) + ")"

    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = ("xor(list_reduce([4294967295::bigint] || [unicode(x)::bigint for x in string_split(doc_id::varchar, '')], lambda c, b: "
           "list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
    return f"""
with recursive d as (select doc_id, dense_rank() over (order by source nulls first) - 1 k, {digest('text')} leaf,
                            case when {crc} % 5 = 0 then {digest(lower)} else {digest('text')} end now from documents),
r as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by k) n from d),
t(k, lvl, i, h, n) as (select k, 0, i, leaf, n from r union all
    select k, lvl + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from t where n > 1 group by k, lvl, i // 16, n),
s as (select k, h, count(*) over () n from t where n = 1),
u(lvl, i, h, n) as (select 0, k, h, n from s union all
    select lvl + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from u where n > 1 group by lvl, i // 16, n),
g as (select k, lvl, i // 16 run, list(h order by i) hs from t where n > 1 group by all
      union all select -1, lvl, i // 16, list(h order by i) from u where n > 1 group by all),
a(doc_id, k, leaf, lvl, i, n, now, proof) as (select doc_id, k, leaf, 0, i, n, now, '' from r union all
    select doc_id, a.k, leaf, a.lvl + 1, i // 16, (n + 15) // 16,
           sha256(array_to_string(hs[1:i % 16], '') || now || array_to_string(hs[i % 16 + 2:], '')),
           proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
    from a join g on g.k = a.k and g.lvl = a.lvl and g.run = i // 16 where n > 1),
b(doc_id, k, leaf, lvl, i, n, now, proof) as (select doc_id, a.k, leaf, 0, a.k, s.n, now, proof from a join s using (k) where a.n = 1 union all
    select doc_id, b.k, leaf, b.lvl + 1, i // 16, (n + 15) // 16,
           sha256(array_to_string(hs[1:i % 16], '') || now || array_to_string(hs[i % 16 + 2:], '')),
           proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
    from b join g on g.k = -1 and g.lvl = b.lvl and g.run = i // 16 where n > 1)
select doc_id, leaf, s.h subroot, u.h root, sha256(proof) proof_sha256, now folded_root, now = u.h verified
from b join s using (k), u where b.n = 1 and u.n = 1
"""


SQL = _sql()
