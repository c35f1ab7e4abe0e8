"""Compaction of the De Bruijn graph: coordinates against a walk, rings, repeated rows, and its part in the result."""

import random
import time
from pathlib import Path

import numpy as np
import pytest

from vesselflow.llm import substring_dedup

WORDS = [f"w{i}" for i in range(3000)]


def _compact(spark, nodes, links):
    classes = spark.createDataFrame([(n, [0]) for n in nodes], "content long, js array<int>")
    rows = substring_dedup.compact(classes, spark.createDataFrame(links, "a long, b long, step int")).collect()
    assert len(rows) == len(nodes)
    return {r.content: (r.path, r.offset) for r in rows}


def test_coordinates_equal_a_walk(spark):
    r = random.Random(2)
    ids = r.sample(range(-10**6, 10**6), 400)
    links, want, at = [], {}, 0
    while at < len(ids):
        chain = ids[at:at + r.choice((1, 1, 2, 3, 40, 117))]
        at += len(chain)
        offset = 0
        for a, b in zip(chain, [*chain[1:], None]):
            want[a] = (chain[0], offset)
            if b is not None:
                links.append((a, b, step := r.randint(1, 20)))
                offset += step
    assert _compact(spark, ids, links) == want


def test_rings_are_opened_at_their_least_class(spark):
    got = _compact(spark, [5, 3, 9, 1, 2, 7, 8], [(5, 3, 2), (3, 9, 4), (9, 5, 1), (1, 2, 6), (2, 1, 6), (7, 8, 3)])
    assert got == {3: (3, 0), 9: (3, 4), 5: (3, 5), 1: (1, 0), 2: (1, 6), 7: (7, 0), 8: (7, 3)}


def test_no_links_and_no_classes(spark):
    assert _compact(spark, [4, 6], []) == {4: (4, 0), 6: (6, 0)}
    assert _compact(spark, [], []) == {}


def _docs(spark):
    r = random.Random(7)
    a, b, period = r.choices(WORDS, k=150), r.choices(WORDS, k=90), r.choices(WORDS, k=50)
    fill = lambda n: r.choices(WORDS, k=n)
    rows = [fill(40) + a + fill(30), fill(10) + a + b, b + a[:80], a[40:120] + fill(5) + b[20:], period * 6, fill(200), a[:34]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def _brute(rows):
    seen, out = {}, {}
    for _, t in rows:
        w = t.split()
        for j in range(len(w) - 34):
            key = tuple(w[j:j + 35])
            seen[key] = seen.get(key, 0) + 1
    for i, t in rows:
        w = t.split()
        out[i] = len({p for j in range(len(w) - 34) if seen[tuple(w[j:j + 35])] > 1 for p in range(j, j + 35)})
    return out


def test_paths_carry_the_removal(spark, monkeypatch):
    rows = _docs(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == want and want[4] == 300 and want[5] == 0
    spans = substring_dedup.spans(docs).collect()
    assert len({s.path for s in spans}) < len(spans)                           # one path, several sources
    made = substring_dedup.compact
    monkeypatch.setattr(substring_dedup, "compact", lambda classes, links: made(classes, links).limit(0))
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0}
    # A wrong coordinate moves the spans: offsets are used, not only names.
    monkeypatch.setattr(substring_dedup, "compact", lambda classes, links: made(classes, links).selectExpr("content", "path", "offset * 0 as offset", "js"))
    assert len(substring_dedup.spans(docs).collect()) > len(spans)


@pytest.mark.parametrize("copies", [10_000])
def test_equal_rows_stay_linear(spark, copies):
    r = random.Random(11)
    text = " ".join(r.choices(WORDS, k=60))
    docs = spark.range(copies).selectExpr("1L as doc_id", f"'{text}' as text")
    at = time.time()
    rows = substring_dedup.substring_dedup(docs).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(x) for x in rows] == [(60, 60, copies)] and time.time() - at < 120


def _chains(r, count):
    """Links of chains and rings whose classes stand along documents: whole, cut in the middle, turned round or each alone."""
    ids, links, places, want, doc = iter(r.sample(range(-10**6, 10**6), 40 * count)), [], [], {}, 0
    for c in range(count):
        chain = [next(ids) for _ in range(r.choice((1, 2, 3, 17, 39)))]
        if ring := c % 3 == 0 and len(chain) > 1:
            least = chain.index(min(chain))
            chain = chain[least:] + chain[:least]
        offset = 0
        for a, b in zip(chain, [*chain[1:], chain[0] if ring else None]):
            want[a] = (chain[0], offset)
            if b is not None:
                links.append((a, b, step := r.randint(1, 20)))
                offset += step
        turn, at, kind = r.randrange(len(chain)), 0, c % 4
        for i in range(len(chain)):
            if kind == 3 or kind == 1 and i == len(chain) // 2:
                doc += 1
            at += r.randint(1, 30)
            places.append((chain[(turn + i) % len(chain)] if kind else chain[-1 - i], doc, at))
        doc += c % 2                                     # chains may share a document
        places = [(n, d, s + 10_000 * c) if d == doc else (n, d, s) for n, d, s in places]
    return links, places, want


def test_coordinates_along_documents_equal_a_walk(spark):
    for seed in range(3):
        links, places, want = _chains(random.Random(seed), 40)
        classes = spark.createDataFrame([(n, [n % 7], d, s) for n, d, s in places], "content long, js array<int>, doc long, start int")
        rows = substring_dedup.compact(classes, spark.createDataFrame(links, "a long, b long, step int")).collect()
        assert len(rows) == len(want) and all(list(r.js) == [r.content % 7] for r in rows)
        assert {r.content: (r.path, r.offset) for r in rows} == want


def test_only_stretches_are_doubled(spark, monkeypatch):
    """Two documents share 3000 words: one path of hundreds of classes, which costs the doubling no row and no round."""
    r = random.Random(5)
    shared = r.choices(WORDS, k=3000)
    rows = [(i, " ".join(r.choices(WORDS, k=40) + shared + r.choices(WORDS, k=40))) for i in range(2)]
    doubled, written, ranked, write = [], [], substring_dedup._ranked, substring_dedup.materialise
    monkeypatch.setattr(substring_dedup, "_ranked", lambda links: (doubled.append(links.count()), ranked(links))[1])
    monkeypatch.setattr(substring_dedup, "materialise", lambda df: (written.append(1), write(df))[1])
    got = {x.doc_id: x.n_removed for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 3000, 1: 3000}
    assert sum(doubled) == 0 and len(written) < 20


def test_a_step_leaves_no_shuffle_files(spark):
    conf, key = spark.conf, substring_dedup.DROP_SHUFFLES
    tops = [Path(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in tops for f in top.rglob("shuffle_*.data")}
    before, had = conf.get(key, "false"), files()
    step = substring_dedup.materialise(spark.range(50_000).selectExpr("id % 9973 as k").groupBy("k").count())
    assert step.count() == 9973 and conf.get(key, "false") == before
    until = time.time() + 20
    while (new := {f for f in files() - had if f.stat().st_size > 10_000}) and time.time() < until:
        time.sleep(0.2)
    assert not new


def test_intervals_unite_within_their_row():
    r = np.random.default_rng(3)
    for _ in range(100):
        rows = [sorted({(int(a), int(a + n)) for a, n in zip(r.integers(0, 60, c), r.integers(1, 9, c))}) for c in r.integers(0, 9, 6)]
        want = []
        for i, row in enumerate(rows):
            held = sorted({x for a, b in row for x in range(2 * a, 2 * b + 1)})   # doubled: intervals that meet are one
            for x in held:
                if want and want[-1][0] == i and want[-1][2] == x - 1:
                    want[-1][2] = x
                else:
                    want.append([i, x, x])
        flat = [(i, a, b) for i, row in enumerate(rows) for a, b in row]
        got = substring_dedup.stretches(*(np.array([x[c] for x in flat], np.int64) for c in range(3)))
        assert [tuple(map(int, x)) for x in zip(*got)] == [(i, a // 2, b // 2) for i, a, b in want]
