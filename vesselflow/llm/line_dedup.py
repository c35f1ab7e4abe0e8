"""Line dedup by pairwise alignment.

Lines are compared by the hash of their trimmed text.  The first document (in id order) that holds a line of at
least ``min_chars`` characters owns it; every later holder is paired with the owner, so a line in g documents gives g - 1
pairs however common it is.  The second and later copies in a document are keys of their own, with the first document that has
so many as their owner.  Shorter lines are paired by runs: the shortest run from each line that together has ``min_chars`` characters.
Each pair is aligned by patience diff: lines that are rare in the pair (once in each of
the two) are the anchors, the heaviest increasing run of anchors is kept, and matches grow from it.  A region without such
lines is aligned by its repeated lines (the heaviest common subsequence), so a line that the owner or the later document
repeats is found as well.  Equal lines whose block is too short to be deleted are no anchors.  Blocks of aligned lines with at least ``min_chars`` characters are deleted from the later document.  An owner never loses the line it owns (an
aligned line always has an earlier holder), so one copy of every line stays.

Only line hashes travel; texts are edited where they are read, or shuffled once if the lists of deletions outgrow a
checked broadcast.

Defined results: a null text counts as empty and stays null when nothing is deleted; rows that repeat an id and a text
are one document and are edited alike; rows that repeat an id with another text are ordered by the text's hash; a null id
sorts first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import materialise, small_bytes, workers

MIN_CHARS = 20
# Pairs of equal lines that are looked at together where a region has no anchor; a line with more is paired by occurrence number.
PAIRS = 200_000


def _heaviest(pairs: list[tuple[int, int]], weight) -> list[tuple[int, int]]:
    """The run of ``pairs`` (rising in the first) that rises in both and weighs most by the first; of equals one with more neighbours."""
    if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])):
        return pairs
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    rank = {j: k for k, j in enumerate(sorted({j for _, j in pairs}), 1)}
    tree = [(0, 0, -1)] * (len(rank) + 1)            # the best (weight, neighbours, pair) of a prefix
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    back: list[int] = []
    for n, (i, j) in enumerate(pairs):
        top, k = (0, 0, -1), rank[j] - 1
        while k:
            top = max(top, tree[k])
            k &= k - 1
        if (i - 1, j - 1) in best:
            w, c, m = best[i - 1, j - 1]
            top = max(top, (w, c + 1, m))
        best[i, j] = mine = (top[0] + weight(i), top[1], n)
        back.append(top[2])
        k = rank[j]
        while k < len(tree):
            tree[k] = max(tree[k], mine)
            k += k & -k
    out, n = [], max(best.values())[2]
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _blocks(pairs, a, b, box: tuple[int, int, int, int], sizes, min_chars: int) -> list[tuple[int, int]]:
    """All ``pairs`` of equal lines whose block inside ``box`` has at least ``min_chars`` characters."""
    if not min_chars:
        return list(pairs)
    a0, a1, b0, b1 = box
    seen: dict[int, tuple[int, int, bool]] = {}      # the last block of a diagonal
    out = []
    for i, j in pairs:
        if i - j not in seen or i >= seen[i - j][1]:
            lo, d = i, i - j
            while lo > a0 and lo - d > b0 and a[lo - 1] == b[lo - 1 - d]:
                lo -= 1
            hi = i + 1
            while hi < a1 and hi - d < b1 and a[hi] == b[hi - d]:
                hi += 1
            seen[d] = lo, hi, sum(sizes[lo:hi]) >= min_chars
        if seen[i - j][2]:
            out.append((i, j))
    return out


def _repeated(a, b, box: tuple[int, int, int, int], sizes, min_chars: int) -> list[tuple[int, int]]:
    """Pairs of equal lines of a region without anchors, the least repeated lines first; at most about PAIRS at a time."""
    a0, a1, b0, b1 = box
    at_a, at_b = defaultdict(list), defaultdict(list)
    for i in range(a0, a1):
        if sizes is None or sizes[i]:
            at_a[a[i]].append(i)
    for j in range(b0, b1):
        if b[j] in at_a:
            at_b[b[j]].append(j)
    some: list[tuple[int, int]] = []
    lines = sorted(at_b, key=lambda x: (len(at_a[x]) * len(at_b[x]), at_b[x][0]))
    for n, x in enumerate(lines):
        if len(at_a[x]) * len(at_b[x]) <= PAIRS:
            some += [(i, j) for i in at_a[x] for j in at_b[x]]
        else:                                        # by occurrence number
            some += zip(at_a[x], at_b[x])
        if n + 1 == len(lines) or len(some) >= PAIRS:
            found = _blocks(sorted(some), a, b, box, sizes, min_chars)
            if found:
                return found
            some = []
    return []


def patience(a, b, sizes=None, min_chars: int = 0) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both.  ``sizes``: characters of the lines of ``a``."""
    weight = (lambda i: 1) if sizes is None else sizes.__getitem__
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        box = a0, a1, b0, b1
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        rare = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1]
        rare = _blocks(rare, a, b, box, sizes, min_chars)
        if not rare and not in_a.keys().isdisjoint(in_b):
            rare = _repeated(a, b, box, sizes, min_chars)
        anchors = _heaviest(rare, weight)
        x, y = a0, b0
        for i, j in [*anchors, (a1, b1)] if anchors else []:
            todo.append((x, i, y, j))
            if i < a1:
                found.append((i, j))
            x, y = i + 1, j + 1
    return sorted(found)


def deleted(later, earlier, sizes, min_chars: int) -> list[int]:
    """Places of the later document's lines in aligned blocks of at least ``min_chars`` characters."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(later, earlier, sizes, min_chars), (None, None)]:
        if last is None or i is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[x] for x in block) >= min_chars:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _keys(hashes, sizes, min_chars: int) -> list[int]:
    """A key for every line of at least ``min_chars`` characters (its hash) and for every shortest run of shorter lines that
    together reach them; the key of a later copy is changed by its number."""
    found, prefix = [], [0]
    if any(0 < n < min_chars for n in sizes):
        for h in hashes:
            prefix.append((prefix[-1] * _STEP + h) & _ALL)
    end = held = 0                                   # of the run that starts at i
    for i, n in enumerate(sizes):
        if n >= min_chars:
            found.append(hashes[i] & _ALL)
        if end <= i:
            end, held = i, 0
        while end < len(sizes) and held < min_chars and sizes[end] < min_chars:
            held += sizes[end]
            end += 1
        if 0 < n < min_chars and held >= min_chars:
            found.append((prefix[end] - prefix[i] * pow(_STEP, end - i, 1 << 64) + (end - i) * 0x632BE59BD9B4E019) & _ALL)
        if end > i:
            held -= n
    out, times = [], Counter()
    for k in found:
        out.append(((k + _STEP * times[k] + (1 << 63)) & _ALL) - (1 << 63))
        times[k] += 1
    return out


def _place(id_col: str, text_col: str) -> Column:
    """A document's place in the order: its id, then its text's hash."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"))


def deletions(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc struct<id, version>, partners, lines array<int>): the lines to delete of every document that loses any."""
    workers(docs.sparkSession)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    base = docs.select(_place(id_col, text_col).alias("doc"), F.transform(lines, lambda x: F.trim(x)).alias("l")).select(
        "doc", F.transform("l", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("l", F.char_length).alias("sizes"))
    base = materialise(base)

    @F.pandas_udf("array<long>")
    def keys(hashes: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_keys(h.tolist(), n.tolist(), min_chars) for h, n in zip(hashes, sizes)])

    held = materialise(base.select("doc", F.explode(keys("hashes", "sizes")).alias("line")))
    # Written, so that the join's sides are plain exchanges and the rows of a common line can be split.
    owner = held.groupBy("line").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("line", "owner")
    owner = materialise(owner)
    pairs = held.join(owner, "line").where("owner < doc").select("doc", "owner").distinct()
    # One row a document: equal rows have equal arrays.  Written too, so that an owner with many later holders is split.
    one = materialise(base.groupBy("doc").agg(F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes")))
    involved = materialise(pairs)
    left = involved.join(one, "doc")
    both = left.join(one.select(F.col("doc").alias("owner"), F.col("hashes").alias("earlier")), "owner")

    @F.pandas_udf("array<int>")
    def cut(later: pd.Series, earlier: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([deleted(a.tolist(), b.tolist(), c.tolist(), min_chars) for a, b, c in zip(later, earlier, sizes)])

    lost = both.select("doc", cut("hashes", "earlier", "sizes").alias("lines")).where(F.size("lines") > 0)
    return materialise(lost.groupBy("doc").agg(F.count(F.lit(1)).alias("partners"),
                                               F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text edited, and __removed (lines deleted) and __partners added."""
    lost = deletions(docs, min_chars, id_col, text_col)
    lost = small_bytes(lost, 40 + 4 * F.size("lines")).select(
        F.col("doc").alias("__doc"), F.col("partners").alias("__p"), F.col("lines").alias("__lost"))
    out = docs.withColumn("__at", _place(id_col, text_col)).join(lost, F.col("__at") == F.col("__doc"), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__lost")
    edited = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return out.select(*[F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(edited).alias(c) if c == text_col else F.col(c)
                        for c in docs.columns],
                      F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("__removed"),
                      F.coalesce("__p", F.lit(0)).cast("long").alias("__partners"))


def digest(docs: DataFrame) -> DataFrame:
    """The query: (doc_id, n_removed, n_partners, kept_sha256, text) for every document."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__removed").alias("n_removed"), F.col("__partners").alias("n_partners"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")
