"""Hard negatives, the Merkle manifest and token counts against brute force on messy rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vesselflow.llm import embedding_dedup, hard_negatives, language_id, merkle, ngram_join, token_count

RNG = random.Random(5)
CLASH = "tree string, rank int, row int, total int, shard int, id int, goal int, at int, block int, score int"
VOCABULARY = "word_bpe_49k.json"


def _clash(n):
    return ["x", *range(n - 1)]


# ---- token counts ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def test_token_counts_of_every_code_point_and_of_odd_mixtures(library):
    count = token_count.Counter(VOCABULARY, token_count.prove(VOCABULARY))
    points = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000] + [chr(RNG.randrange(0x10000, 0x110000)) for _ in range(2000)]
    RNG.shuffle(points)
    texts = ["a".join(points[i:i + 30]) for i in range(0, len(points), 30)]
    pool = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "　", "'s", "'S", "'ll", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "é", "é", "́",
            "Σς", "İ", "ß", "ﬁ", "½", "①", "中文", "한국", "한", "😀", "0", "12", "abc", "Hello", "xqzj", "...", "-", "_", "‍"]
    texts += ["".join(RNG.choices(pool, k=RNG.randint(1, 14))) for _ in range(5000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [count.text(t) for t in texts] == want


def test_whole_tokens_are_proved(library):
    proof = token_count.prove(VOCABULARY)
    some = RNG.sample(sorted(proof.whole), 300)
    assert "the" in proof.whole and all(len(library.model.tokenize(p)) == 1 for p in some)
    vocab = library.get_vocab()
    left = [v.removesuffix("</w>") for v in vocab if v.endswith("</w>") and v.removesuffix("</w>") not in proof.whole]
    assert all(len(library.model.tokenize(p)) > 1 for p in left if p)
    count = token_count.Counter(VOCABULARY, proof)
    assert count.text("The cat, the hat") == 5 and count.merged == 0
    with pytest.raises(ValueError):
        token_count.prove("byte_bpe_50k.json")


def test_token_counts(spark, library, monkeypatch):
    texts = [None, "", " \n", "one two", "one two", "Ünïcode <|endoftext|> x<|endoftext|>y 12", "zqx" * 3000, "word " * 4000, "a" * 70 + " b" * 3]
    rows = [(i if i != 3 else None, t, *_clash(10)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + CLASH).repartition(3)
    got = Counter(tuple(r) for r in token_count.token_counts(docs, limit=20).collect())
    want = Counter()
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 20] += 1
    assert got == want
    assert token_count.token_counts(docs.limit(0)).count() == 0
    assert "".join(token_count.pieces("ab cd  efghij k", 3)) == "ab cd  efghij k"
    assert all(p[0] == " " for p in list(token_count.pieces("ab cd  efghij k", 3))[1:])


# ---- Merkle manifest ---------------------------------------------------------------------------

def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(row):
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _siblings(levels, i):
    out = []
    for row in levels[:-1]:
        r = i // 16 * 16
        out.append(("".join(row[r:i]), "".join(row[i + 1:r + 16])))
        i //= 16
    return out


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _manifest(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    found = {}
    for doc, text, lang, source, n in rows:
        head = "".join(map(_field, (doc, source, lang, n)))
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None
        found.setdefault(source, []).append(((doc is not None, doc), _h(head + _field(text)), _h(head + _field(text.translate(lower) if hit else text))))
    keys = sorted(found, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(v, key=lambda r: ((r[0][0], r[0][1] or 0), r[1])) for k, v in found.items()}
    trees = {k: _tree([r[1] for r in v]) for k, v in ordered.items()}
    top = _tree([trees[k][-1][0] for k in keys])
    root, out = top[-1][0], Counter()
    for place, k in enumerate(keys):
        for i, (doc, leaf, now) in enumerate(ordered[k]):
            steps = _siblings(trees[k], i) + _siblings(top, place)
            for left, right in steps:
                now = _h(left + now + right)
            out[doc[1], leaf, trees[k][-1][0], root, _h("".join(x + y for x, y in steps)), now, now == root] += 1
    return out


def test_addresses_are_van_emde_boas_order():
    for levels in (1, 2, 3, 4):
        places = np.concatenate([merkle.address(d, np.arange(16 ** d), levels) for d in range(levels)])
        assert sorted(places) == list(range(merkle.size(levels)))
    # Four levels: the upper two first, then each node of the third level right before its children.
    assert list(merkle.address(1, np.arange(16), 4)) == list(range(1, 17))
    for i in (0, 7, 255):
        at = int(merkle.address(2, np.array([i]), 4)[0])
        assert at == 17 + 17 * i and list(merkle.address(3, np.arange(16 * i, 16 * i + 16), 4)) == list(range(at + 1, at + 17))


@pytest.mark.parametrize("count", [1, 2, 16, 17, 255, 256, 257, 4095, 4096])
def test_block_root_and_siblings(count):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(count)]
    levels = _tree([d.hex() for d in digests])
    nodes = merkle.construct(digests, True)
    assert nodes[:32].hex() == levels[-1][0]
    block = merkle.Block(nodes, count, True)
    for i in {0, count // 2, count - 1}:
        steps = block.siblings(i)
        assert [(x.hex(), y.hex()) for x, y in steps] == _siblings(levels, i) and merkle.fold(digests[i], steps) == nodes[:32]


def test_manifest(spark):
    rows = [(i, f"Text {i} É", "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 40}", i) for i in range(15000)]
    rows += [(5, "Text 5 É", "en", "hot", 5), (5, "Other", "en", "hot", None), (None, "null Id", "fr", None, 1), (None, "null Id", "fr", None, 1), (77, None, None, None, None),
             (78, "", None, "", 0), (79, "LONG " * 50000, "en", "lone", 9), (80, "x", "en", "é", 1)]
    docs = spark.createDataFrame([(*r, *_clash(10)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(5)
    out = merkle.manifest(docs, tampered=merkle.one_in_five())
    assert Counter(tuple(r) for r in out.collect()) == _manifest(rows)
    assert merkle.manifest(docs.limit(0), tampered=merkle.one_in_five()).count() == 0
    one = merkle.manifest(docs.where("source = 'é'")).collect()
    assert [(r.leaf == r.root == r.subroot, r.verified, r.proof_sha256) for r in one] == [(True, True, _h(""))]


# ---- hard negatives ----------------------------------------------------------------------------

def _mined(rows, every, positives, negatives):
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda c: (-c[1], c[0] is None, c[0] or 0)
    out = Counter()
    for a, la, va in ok:
        if a is None or a % every:
            continue
        met = [(b, sum(x * y for x, y in zip(va, vb)), lb == la) for b, lb, vb in ok if b != a and len(vb) == len(va)]
        for p, ps, _ in sorted((m for m in met if m[2]), key=key)[:positives]:
            fits = sorted((m for m in met if not m[2] and 30 * ps <= 100 * m[1] <= 90 * ps), key=key)[:negatives]
            out.update((a, p, r, n, ps, ns) for r, (n, ns, _) in enumerate(fits, 1))
    return out


def _vectors(n, dim, seed):
    gen = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in gen.normal(0, 0.3, dim)], int(gen.integers(0, 4))) for i in range(n)]


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PER_SHARD", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = _vectors(400, 6, 1)
    rows += [(1000 + i, rows[3][1], 3) for i in range(150)] + [(2000 + i, rows[20][1], 1) for i in range(60)]      # a hot vector; ties
    rows += [(20, rows[20][1], rows[20][2]), (30, rows[31][1], 0), (None, rows[40][1], 2), (None, rows[20][1], 1)]   # repeated ids, null ids
    rows += [(3000, None, 1), (3010, [1.0] * 6, None), (3020, [float("nan")] + [1.0] * 5, 1), (3030, [None] + [1.0] * 5, 1), (3040, [float("inf")] + [0.0] * 5, 2)]
    rows += [(4000, [0.0] * 6, 0), (4010, [0.0] * 6, 0), (4020, [0.0] * 6, 1), (4030, [], 1), (4040, [], 1), (4041, [], 2), (4050, [0.5, 1.0], 1), (4051, [0.5, 1.0], 1), (4052, [0.5, 0.5], 2)]
    frame = spark.createDataFrame([(*r, *_clash(10)) for r in rows], "vec_id long, embedding array<float>, label int, " + CLASH).repartition(4)
    got = Counter(tuple(r) for r in hard_negatives.mine(frame, every=10).collect())
    assert got == _mined(rows, 10, 5, 10) and len(got) > 500
    got = Counter(tuple(r) for r in hard_negatives.mine(frame, every=10, positives=2, negatives=300).collect())
    assert got == _mined(rows, 10, 2, 300)                                # windows that do not fill up
    assert hard_negatives.mine(frame.limit(0)).count() == 0
    assert hard_negatives.mine(frame.where("vec_id % 10 = 1"), every=10).count() == 0


def test_threshold_search_stops_early():
    gen = np.random.default_rng(2)
    m = np.floor(gen.normal(0, 100, (2000, 3))).astype(np.int64)
    ids, labels = np.arange(2000), np.zeros(2000, np.int64)
    shard = hard_negatives.Shard(ids.tobytes(), labels.tobytes(), m.tobytes(), np.argsort(m, axis=0).T.astype(np.int32).tobytes(), 3)
    anchor = np.array([300, -20, 0])
    got = shard.search(anchor, np.ones(2000, bool), [(None, None)], 5)[0]
    exact = m @ anchor
    assert list(got) == sorted(range(2000), key=lambda i: (-exact[i], i))[:5]
    assert (shard.score != 0).sum() < 1500                                # rows that never came up have no score


def test_anchors_and_shards_meet_without_copies(spark, monkeypatch):
    """Neither anchors nor shards are copied for each other, and no plan sends them through the driver, however small Spark takes them to be."""
    plans, write = [], hard_negatives.materialise

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(hard_negatives, "materialise", kept)
    monkeypatch.setattr(hard_negatives, "PER_SHARD", 20)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 150)
    rows = _vectors(600, 6, 4)
    rows += [(1000 + i, rows[3][1], 3) for i in range(100)]
    mined = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), every=2)
    assert Counter(tuple(r) for r in mined.collect()) == _mined(rows, 2, 5, 10)
    plans.append(mined._jdf.queryExecution().executedPlan().toString())
    assert len([p for p in plans if "asked" in p or "anchors" in p]) >= 2
    assert not [p for p in plans if "Broadcast" in p or "Generate" in p]


@pytest.mark.parametrize(("scale", "kind"), [(1, np.float32), (3000, np.float64), (10 ** 6, np.int64)])
def test_blocks_meet_shards_exactly(scale, kind):
    gen = np.random.default_rng(6)
    rows = [np.floor(gen.normal(0, 100, (n, 5))).astype(np.int64) * scale for n in (40, 700, 300)]
    rows[2][:250] = rows[1][0]                                            # ties, over shards and within one
    ids = np.sort(gen.integers(0, 900, sum(map(len, rows))))              # repeated ids
    gen.shuffle(ids)
    labels = gen.integers(0, 3, len(ids))
    anchors = np.concatenate(rows)[gen.choice(len(ids), 300, replace=False)]
    anchors[5], anchors[6] = 0, rows[1][0]
    of, own = gen.integers(0, 900, 300), gen.integers(0, 3, 300)
    goals = np.sort(gen.integers(0, 60_000, (300, 3)), axis=1)[:, ::-1] * scale * scale
    goals[7], goals[8, 1:] = -1, -1
    whole = lambda x: np.ascontiguousarray(x, np.int64).tobytes()
    for same in (True, False):
        block = hard_negatives.Block(whole(np.arange(300)), whole(of), whole(own), whole(anchors), whole(goals), 5, same, 6, 30, 90)
        exact, start = [[] for _ in range(300)], 0
        for m in rows:
            i = slice(start, start := start + len(m))
            o = np.argsort(ids[i], kind="stable")
            m, at, label = m[o], ids[i][o], labels[i][o]
            shard = hard_negatives.Shard(whole(at), whole(label), hard_negatives._narrow(m), hard_negatives._narrow(np.argsort(m, axis=0).T), 5)
            assert shard._kind(anchors) == kind
            block.meet(shard)
            for a in range(300):
                exact[a] += [(int(s), int(b)) for s, b, l in zip(m @ anchors[a], at, label) if b != of[a] and (l == own[a]) == same]
        wanted = Counter()
        for a in range(300):
            for g, p in enumerate([None] if same else goals[a].tolist()):
                fits = [x for x in exact[a] if same or p >= 0 and 30 * p <= 100 * x[0] <= 90 * p]
                wanted.update((a, g, b, s) for s, b in sorted(fits, key=lambda x: (-x[0], x[1]))[:6])
        assert Counter(tuple(r.values()) for r in block.found().to_pylist()) == wanted and len(wanted) > 1000


def test_scores_of_huge_components_fit(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [1e29, -1e300], 2), (3, [1e6, 1.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.positive_score > 0 for r in got) and {r.negative_id for r in got} <= {2, 3}


# ---- n-gram join: many heads -------------------------------------------------------------------

def _mosaic(docs_of, seed=3):
    """Documents of two passages each out of a few, with some words of their own: many groups that share passages and do not link, and a few that do."""
    gen = random.Random(seed)
    passages = [[f"p{p}w{i}" for i in range(40)] for p in range(12)]
    rows = []
    for i in range(docs_of):
        a, b = gen.sample(range(12), 2)
        own = [f"d{i // 3 if i % 5 == 0 else i}x{k}" for k in range(6)]
        rows.append((i, " ".join(passages[a] + passages[b] + own) if i % 7 else " ".join(passages[a] + own[:2])))
    return rows


def _links(rows, n, percent):
    sets = {d: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1:]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_many_heads_stay_linear(spark, monkeypatch):
    opened = {}
    across = ngram_join._across

    def counted(every, *args):
        pairs = ngram_join.materialise(across(every, *args))
        opened[size] = pairs.count()
        return pairs

    monkeypatch.setattr(ngram_join, "_across", counted)
    for size in (150, 450):
        rows = _mosaic(size)
        got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
        want = _links(rows, 5, 80)
        assert {r.doc_id: r.component_id for r in got} == want and 1 < len(set(want.values())) < size
    assert opened[450] <= 4 * opened[150] + 450


# ---- hot vectors, letters ----------------------------------------------------------------------

def test_equal_vectors_are_one_class(spark):
    """A vector held by 20,000 rows, one near it held twice, and a lone one."""
    gen = np.random.default_rng(8)
    hot, lone = gen.normal(size=12), gen.normal(size=12)
    close = hot + 0.01 * gen.normal(size=12)
    rows = spark.range(20000).selectExpr("id + 10 as vec_id").crossJoin(spark.createDataFrame([(hot.tolist(), 1)], "embedding array<double>, label int"))
    rows = rows.union(spark.createDataFrame([(1, close.tolist(), 1), (2, close.tolist(), 1), (3, lone.tolist(), 1), (4, hot.tolist(), 2)], rows.schema))
    base = embedding_dedup.classes(embedding_dedup._valid(rows, "vec_id", "embedding", "label"))
    assert sorted((r.vid, r.copies) for r in base.collect()) == [(1, 2), (3, 1), (4, 1), (10, 20000)]
    got = embedding_dedup.embedding_dedup(rows).groupBy("n_links", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(20001, 1, False, 20001), (20001, 1, True, 1), (0, 3, True, 1), (0, 4, True, 1)}


def test_widest_lists_are_pruned():
    """Many rows around one: reverse edges would make its list as long as the block."""
    gen = np.random.default_rng(1)
    v = embedding_dedup.unit((np.ones((1000, 16)) + 0.002 * gen.normal(size=(1000, 16))).tolist() + gen.normal(size=(24, 16)).tolist())
    near = embedding_dedup.build(v)
    assert max(map(len, near)) <= embedding_dedup.WIDEST + 64
    table = embedding_dedup._pad(near, len(v))
    a, b = embedding_dedup.search(v, table, v[:50], np.arange(50), 0.98, 32)
    assert len(a) >= 0.99 * 50 * 999


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, "the house of the man is old and the sea is wide " * 3, "en") for i in range(40)] + [(100 + i, "das haus des mannes ist alt und das meer ist weit " * 3, "de") for i in range(40)]
    rows += [(300, "²", "en"), (301, "½ ① 12", "en"), (302, "́", "de"), (303, "the house is old", None)]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in (300, 301, 302)] == ["und"] * 3 and got[303] == "en"
