"""Every operator on messy rows against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselflow.llm import (embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, mix_sources, ngram_join, pack, secret_scan,
                            substring_dedup)
from vesselflow.llm.common import components, word_hashes

SF = "/root/testdata/sf0.001"
RNG = random.Random(1)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(RNG.choices(WORDS, k=3000))
PASSAGE = " ".join(RNG.choices(WORDS, k=60))
CLASH = ("key", "class", "token", "doc", "group", "count", "lines", "start", "kept", "digest", "target", "copies", "shard")


def _near(text: str, n: int) -> str:
    w = text.split()
    for i in range(n):
        w[(i * 97) % len(w)] = f"x{i}"
    return " ".join(w)


def _rows():
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "One  two"), (6, LONG), (7, LONG), (7, LONG), (8, _near(LONG, 5)), (9, _near(LONG, 90)),
            (10, "a b c " + PASSAGE + " end one"), (11, "q r " + PASSAGE + "\nother end"), (12, "x " * 50), (13, "é 😀 token=abcdef12 \n" + "f" * 30),
            (14, 'API_KEY: "0123456789abcdef0123456789" AKIA' + "A" * 16 + " token:token:abcdefgh secret=abc"), (None, "null id text"), (None, "null id text")]
    base = "\n".join(f"line {i} " + " ".join(RNG.choices(WORDS, k=8)) for i in range(12))
    rows += [(20, base), (21, "intro\n" + base), (22, "\n".join(base.split("\n")[3:9]) + "\nfresh ending of this one")]
    rows += [(100 + i, base + f"\ntail number {i} of the many copies") for i in range(40)]
    return rows


ROWS = _rows()


def frame(spark, rows=ROWS):
    full = [(i, t, None if i in (4, None) else "en" if (i or 0) % 2 else "fr", None if i == 5 else f"s{(i or 0) % 3}", len(t or ""), *[0] * len(CLASH)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}


def test_word_hashes_do_not_depend_on_the_batch():
    texts = [t.encode() if t is not None else None for _, t in ROWS] + [(LONG * 120).encode()]
    together = list(word_hashes(texts))
    for t, h in zip(texts, together):
        assert len(h) == len((t or b"").split())
        assert (next(word_hashes([t])) == h).all()


def test_exact_dedup(spark, docs, none):
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect())
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((len(t or ""), i))
    want = Counter()
    for norm, members in groups.items():
        top = max(n for n, _ in members)
        keep = min((i for n, i in members if n == top and i is not None), default=None)
        for _, i in members:
            want[(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.exact_dedup(hot)
    assert out.where("kept").count() == 4000 - 1334 + 1
    assert exact_dedup.kept_documents(hot, out).count() == 2667


def _brute_secrets(text):
    out = []
    for k, (kind, pat, g, least) in enumerate((("assign", r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
                                              ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pat, text) if len(m[g]) >= least]
    return ",".join(x for *_, x in sorted(out))


def test_secret_scan_and_ledger(docs, none):
    got = Counter((r.doc_id, r.spans, r.base_sha256) for r in secret_scan.secret_scan(docs).collect())
    want = Counter((i, s := _brute_secrets(t or ""), hashlib.sha256(s.encode()).hexdigest()) for i, t in ROWS)
    assert got == want and any(s for _, s, _ in want)
    assert secret_scan.secret_scan(none).count() == 0
    ledger = secret_scan.scan_unseen(docs.where("doc_id < 10")).cache()
    blobs = len({t or "" for i, t in ROWS if i is not None and i < 10})
    assert ledger.count() == 3 * blobs
    assert secret_scan.scan_unseen(docs.where("doc_id < 10"), ledger).count() == 0                     # nothing unseen
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", 2, r"[0-9a-f]{26,}", 0, 26, r"[0-9a-f]{26}"))
    assert secret_scan.scan_unseen(docs.where("doc_id < 10"), ledger, newer).count() == blobs          # one rule changed
    rest = secret_scan.scan_unseen(docs, ledger)
    assert rest.count() == 3 * (len({t or "" for _, t in ROWS}) - blobs)
    whole = secret_scan.digest(secret_scan.findings(docs, ledger.union(rest)))
    assert Counter((r.doc_id, r.spans, r.base_sha256) for r in whole.collect()) == want


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack.pack(docs).toPandas()
    want = Counter()
    for i, t in ROWS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = [(0, first or 2048)] + [(s, 2048) for s in range(first or 2048, len(ids), 2048)]
        for p, (s, n) in enumerate(cuts):
            want[(i, p, s, n, zlib.crc32(ids[s:s + n].tobytes()))] += 1
    rows = got.astype(object).where(got.notna(), None)
    assert Counter((None if r.doc_id is None else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert pack.pack(none).count() == 0
    for score in ("norm", "dot"):                                        # every constraint binds
        size = np.array([RNG.randint(1, 100) for _ in range(500)])
        b, o = pack.best_fit(size, 200, 5, 12_000, score=score)
        for k in set(b.tolist()):
            s = size[b == k]
            assert s.sum() <= 200 and len(s) <= 5 and (s * s).sum() <= 12_000
    with pytest.raises(ValueError):
        pack.best_fit(np.array([300]), 200, 5, 100_000)
    text = "abc def  ghi\n" * 150_000
    assert pack.Encoder("byte_bpe_50k")(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_ngram_join(spark, docs, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())
    sets = []
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append((i, {tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))} if w else set()))
    comp = list(range(len(sets)))
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and 100 * len(a & b) >= 85 * len(a | b):
                old, new = comp[x], comp[y]
                comp = [new if c == old else c for c in comp]
    want = Counter()
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if comp[j] == comp[k] and sets[j][0] is not None]
        want[(i, len(s), min(ids) if ids and s else i)] += 1
    assert got == want
    assert ngram_join.ngram_components(none).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id in (6, 7, 8)").count() == 1 and kept.where("doc_id in (1, 2, 3)").count() == 3


def test_one_of_each_keeps_one_row(spark):
    """Repeated leaders, null ids and one id with several texts, against a count of the components."""
    text = " ".join(WORDS[:200])
    rows = [(1, text, 3), (1, text, 2), (1, text, 2), (2, _near(text, 1), 0), (1, _near(text, 2), 1)]         # one group, its leader repeated
    rows += [(None, "alone and without id", 1), (None, "alone and without id", 2), (None, "another one without id", 0)]
    rows += [(5, "no partner but repeated here", 1)] * 3 + [(5, "the same id with another text", 1)]
    rows += [(7, "", 0), (7, "", 0), (None, None, 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` int").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.one_of_each(df).collect())
    first = [r for r in got if r[0] == 1]
    assert len(first) == 1 and got[first[0]] == 1 and first[0] in {(1, text, 2), (1, _near(text, 2), 1)}
    del got[first[0]]
    assert got == Counter({(None, "alone and without id", 1): 1, (None, "another one without id", 0): 1, (5, "no partner but repeated here", 1): 1,
                           (5, "the same id with another text", 1): 1, (7, "", 0): 2, (None, None, 0): 2})


def test_substring_dedup(docs, none):
    words = [(i, (t or "").encode().split()) for i, t in ROWS]
    seen = Counter(tuple(w[j:j + 35]) for _, w in words for j in range(len(w) - 34))
    want = Counter()
    for i, w in words:
        gone = set()
        for j in range(len(w) - 34):
            if seen[tuple(w[j:j + 35])] > 1:
                gone.update(range(j, j + 35))
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    out = substring_dedup.substring_dedup(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want
    assert substring_dedup.substring_dedup(none).count() == 0
    spans = substring_dedup.spans(docs).collect()
    assert spans and all(r.end - r.start >= 35 for r in spans)


def test_patience_aligns_rising_equal_lines():
    for seed in range(200):
        r = random.Random(seed)
        a, b = ([r.randint(0, 12) for _ in range(r.randint(0, 25))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]


def test_line_dedup(docs, none):
    place = lambda i: -(1 << 63) if i is None else i
    texts = sorted({(place(i), t or "") for i, t in ROWS})
    lines = {p: [x.strip(" ") for x in t.split("\n")] for p, t in texts}
    owner = {}
    for p, ls in sorted(lines.items()):
        for x in ls:
            if len(x) >= 20:
                owner.setdefault(x, p)
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "__removed", "__partners"]
    for r in out.collect():
        p = place(r.doc_id)
        gone = set()
        for o in {owner[x] for x in lines[p] if len(x) >= 20} - {p}:
            gone.update(line_dedup.deleted(lines[p], lines[o], [len(x) for x in lines[p]], 20))
        t = dict((place(i), t) for i, t in ROWS)[p]
        want = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert (r.text, r["__removed"]) == (want, len(gone))
    kept = {x for r in out.collect() for x in (y.strip(" ") for y in (r.text or "").split("\n"))}
    assert set(owner) <= kept                                             # one copy of every line stays
    assert out.where("doc_id >= 100 and text like 'tail number%'").count() == 40      # the common block went from every copy
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_repeated_lines(spark):
    """Passages in the owner's order, with lines that the owner or the later documents repeat, against a count of copies."""
    for seed in range(3):
        r = random.Random(seed)
        line = lambda k: f"{k} " + " ".join(r.choices(WORDS, k=6))
        refrain, chorus = line("refrain"), line("chorus")
        passage = [refrain, line("a"), refrain, chorus, line("b"), refrain, chorus, line("c"), chorus]
        rows = [(1, "\n".join([line("top"), *passage, line("end")])), (2, "\n".join([line("own"), refrain, line("own"), refrain, line("own")]))]
        for d in range(3, 20):
            rows.append((d, "\n".join(y for x in passage if r.random() < 0.5 for y in (line("fresh"), "", x, line("new")))))
        rows.append((20, "\n".join([line("own"), chorus, line("own")])))
        first, want = {}, {}
        for d, t in rows:
            seen = Counter(x for x in t.split("\n") if len(x) >= 20)
            for x, n in seen.items():
                first.setdefault(x, d)
            want[d] = sum(n for x, n in seen.items() if first[x] < d)
        got = {x.doc_id: x["__removed"] for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want and want[2] == 2 and want[20] == 1
    # Two later documents repeat a line that its owner has once: the second copy goes where an earlier document has two.
    a, b, c = (line(k) for k in "xyz")
    rows = [(1, f"{a}\n{b}"), (2, f"{line('p')}\n{a}\n{line('q')}\n{a}\n{line('r')}"), (3, f"{line('s')}\n{a}\n{c}\n{a}\n{line('t')}")]
    got = {x.doc_id: x["__removed"] for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_line_keys_of_short_lines():
    for seed in range(300):
        r = random.Random(seed)
        lines = [r.choice(["", "ab", "cdefghi", "klmnopqrstu", "v" * 19, "w" * 20, "x" * 30]) for _ in range(r.randint(0, 30))]
        want = Counter()
        for i, x in enumerate(lines):
            for j in range(i + 1, len(lines) + 1):
                if x and sum(map(len, lines[i:j])) >= 20:
                    if j == i + 1 or max(map(len, lines[i:j])) < 20:
                        want[tuple(lines[i:j])] += 1
                    break
        got = line_dedup._keys([zlib.crc32(x.encode()) * 7919 - (1 << 40) for x in lines], [len(x) for x in lines], 20)
        assert len(got) == len(set(got)) == sum(want.values())


def test_line_dedup_of_short_lines(spark):
    """Blocks without any long line go from every later copy; shorter ones stay."""
    verse = ["roses red", "violets", "", "sugar is", "so are you"]
    rows = [(1, "\n".join(["one", *verse, "two"])), (2, "\n".join(["three", *verse])), (3, "\n".join(["x", *verse[:2], "y"])),
            (4, "\n".join(["another", *verse[1:], "four"])), (5, "\n".join(["汉字句子一二三四五", "汉字句子六七八九十", "汉字句子甲乙"])),
            (6, "\n".join(["汉字", "汉字句子一二三四五", "汉字句子六七八九十", "汉字句子甲乙", "end"]))]
    out = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "three", 3: rows[2][1], 4: "another\nfour", 5: rows[4][1], 6: "汉字\nend"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies, ok?</div>
<div id=wrap><article><h1>The &amp; title</h1><p>First,  paragraph &eacute; of <b>the</b>
article, with commas, and words.<br>Next<p>Second&nbsp;one<ul><li>item one<li>item two</ul><div class="ad">Buy now</div>
<form><p>Your mail</p></form></article><section id="comments"><p>I, a reader, disagree, strongly, with all of this, really.</p></section></div>
<aside><p>Related, stories, here</p></aside><footer><p>&copy; 2020, someone, somewhere</p></footer></body></html>"""


def test_html_extraction(spark):
    want = "The & title\nFirst, paragraph é of the article, with commas, and words. Next\nSecond one\nitem one\nitem two"
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text(PAGE.replace("article>", "div>").replace("<article", "<div")) == want        # found by its score alone
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("just text, no &lt;markup&gt;") == "just text, no <markup>"
    assert html_extract.main_text("<article><p>cut of<p>f here &am") == "cut of\nf here &am"
    assert html_extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "u", PAGE, 0), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    got = Counter(tuple(r) for r in html_extract.extract(pages).collect())
    assert got == Counter({(1, "u", want, len(want)): 2, (2, None, "", 0): 1, (None, "u", want, len(want)): 1})
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_names_inside_an_article():
    prose = "A sentence of the article itself, with commas, and enough words, that nobody would take it for a label of a menu or an advert."
    heads = f"<h2 id=discussion>Discussion</h2><p>{prose}</p><section id='related-work'><h2>Related work</h2><p>{prose}</p></section>"
    want = f"Title\nDiscussion\n{prose}\nRelated work\n{prose}"
    for name in ("entry-header", "post-header", "header"):
        page = f"<body><article><div class='{name}'><h1>Title</h1></div>{heads}<div class='ad'>Buy</div><div class=share><a href=/>Share</a></div></article>"
        assert html_extract.main_text(page) == want
    block = f"<div class='elementor-widget elementor-widget-text'><div class='widget-text'><p>{prose}</p></div></div>"
    assert html_extract.main_text(f"<body><div id=content>{block * 3}</div>") == "\n".join([prose] * 3)
    for cut in (f"<section id=comments><p>{prose}</p></section>", "<div class=related><a href=/a>One</a> <a href=/b>Two</a></div>", "<p class=ad>Buy now</p>"):
        assert html_extract.main_text(f"<body><article><h1>Title</h1><p>{prose}</p>{cut}</article>") == f"Title\n{prose}"


class _Second(HTMLParser):
    """The lines of a page's article by another parser: text of skipped elements is dropped, a block's both ends end a line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.held, self.skipped = [], [], 0

    def handle_starttag(self, tag, attrs):
        if self.skipped or tag in ("nav", "aside", "footer", "script", "form") or ("class", "ad") in attrs:
            self.skipped += 1
        self.end(tag)

    def handle_endtag(self, tag):
        self.skipped -= self.skipped > 0
        self.end(tag)

    def handle_data(self, data):
        if not self.skipped:
            self.held.append(data)

    def end(self, tag):
        if tag in ("p", "div", "li", "ul", "blockquote", "h2", "article", "body", "html"):
            self.lines.append(" ".join("".join(self.held).split()))
            self.held = []

    def text(self):
        self.end("p")
        return "\n".join(line for line in self.lines if line)


def _page(rng):
    def words():
        return " ".join(rng.choice(["tide", "net,", "harbour.", "r&eacute;gion", "&lt;b&gt;", "7&nbsp;km", "\n fish ", "<b>boat</b>", "<i>a<em>b</em></i>"])
                        for _ in range(rng.randint(8, 60)))

    def block(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "div", "blockquote", "cut"])
        if kind == "cut":
            return rng.choice(["<nav><p>Menu, home</p></nav>", "<div class=ad>Buy, now</div>", "<aside>See also</aside>", "<script>var a = '<p>no';</script>"])
        if kind in ("div", "blockquote") and depth < 60:
            return f"<{kind}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 2))) + f"</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        return f"<h2>{words()}</h2>" if kind == "h2" else f"<p>{words()}</p>"

    inner = "".join(block(0) for _ in range(rng.randint(1, 12))) + f"<p>{words()}</p>"
    return f"<html><body><nav><p>Home, news</p></nav><article>{inner}</article><footer><p>Imprint, contact</p></footer></body></html>"


def test_html_against_a_second_parser():
    rng = random.Random(5)
    for _ in range(300):
        page = _page(rng)
        second = _Second()
        second.feed(page)
        second.close()
        assert html_extract.main_text(page) == second.text(), page


def test_html_of_any_depth():
    prose = [f"Paragraph {i}, with some text." for i in range(1000)]
    assert html_extract.main_text("<article>" + "".join(f"<b><p>{p}</p>" for p in prose)) == "\n".join(prose)
    assert html_extract.main_text("<article>" + "".join(f"<div><p>{p}</p>" for p in prose)) == "\n".join(prose)
    deep = "<body>" + "<div>" * 5000 + f"<p>{prose[0]}</p><div class=ad>Buy</div><p>{prose[1]}</p>"
    assert html_extract.main_text(deep) == "\n".join(prose[:2])
    start = time.process_time()                    # linear: a walk to the root for each of these closing tags takes minutes
    assert html_extract.main_text("<i>" * 50000 + "x, y" + "</u>" * 50000) == "x, y"
    assert html_extract.main_text("<b><div>" + "<i>" * 50000 + "x, y" + "</b>" * 50000) == "x, y"
    assert time.process_time() - start < 20


def test_language_id(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(table)
    got = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)
    assert language_id.accepted(table, model).count() >= 0.99 * table.count()
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    assert language_id.accepted(docs, model).columns == docs.columns
    assert language_id.fit(none) is None and language_id.predict(none, None).count() == 0
    long = language_id.scores(model, ["the of and " * 200_000, "the of and " * 100])
    assert long[0][0] == long[1][0] == "en"


def test_mixing(spark, docs, none):
    got = mix_sources.plan(docs).toPandas()
    assert len(got) == len(ROWS) and set(got.columns) == {"doc_id", "domain", "lang", "source", "n_tokens", "leaf_target", "copies"}
    for _, g in got.groupby(["domain", "lang", "source"]):
        taken, target = int((g.copies * g.n_tokens).sum()), int(g.leaf_target.iloc[0])
        assert taken <= target <= 4 * g.n_tokens.sum() and g.copies.max() - g.copies.min() <= 1
    assert mix_sources.mix_documents(docs).count() == got.copies.sum() and mix_sources.mix_documents(docs).columns == docs.columns
    assert mix_sources.plan(none).count() == 0 and mix_sources.mix_documents(none).count() == 0
    leaf = spark.createDataFrame([("a", "en", "x", 100, 1), ("a", "en", "y", 10, 1), ("a", "fr", "z", 1000, 1), ("b", "en", "w", 1000, 1)],
                                 "domain string, lang string, source string, tokens long, docs long")
    even = {"domain": {}, "lang": {}, "source": {}}
    share = {r.source: r.target for r in mix_sources.budgets(leaf, even, 800, 1).collect()}
    assert share == {"y": 10, "x": 100, "z": 290, "w": 400}          # y's shortage went to its sibling, the rest to the next language


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 20] + 0.04 * rng.normal(size=16)).tolist(), i % 2) for i in range(300)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0, None] * 8, 1), (404, base[0].tolist(), None),
             (405, base[1][:8].tolist(), 1), (406, [float("inf")] + [1.0] * 15, 1), (7, rows[7][1], rows[7][2]), (None, base[0].tolist(), 0), (407, [], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, near int")
    v = embedding_dedup.unit([r[1] for r in rows[:300]])
    lab = np.array([r[2] for r in rows[:300]])
    link = (v @ v.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    comp = list(range(300))
    for i, j in zip(*np.nonzero(link)):
        a, b = comp[i], comp[j]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    for block in (1024, 64):                                              # one block, and shards cut into blocks
        got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, block=block).collect()}
        n = np.array([got[i].n_links for i in range(300)])
        assert (n <= link.sum(1)).all() and n.sum() >= 0.9 * link.sum() > 0
        if block == 1024:
            assert [got[i].component_id for i in range(300)] == comp
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(400, 408))
        assert got[None].n_links == 0
    assert embedding_dedup.embedding_dedup(df).count() == len(rows)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_audit(spark):
    """A large group does not hide small pairs, a link found from one end counts for both, and a low recall is an error."""
    rng = np.random.default_rng(9)
    pairs = rng.normal(size=(20, 8))
    v = np.concatenate([np.ones((60, 8)), pairs, pairs])
    base = spark.createDataFrame([(i, "a:8", x.tolist(), 1) for i, x in enumerate(v)], "vid long, space string, v array<double>, copies long")
    found = spark.createDataFrame([(i, 59 if i < 60 else 0, i, []) for i in range(100)], "vid long, n_links long, root long, near array<long>")
    overall, few = embedding_dedup.audit_recall(base, embedding_dedup.link_counts(found, base), 0.98, 1000)
    assert abs(overall - 1.0 * 60 / 100) < 1e-9
    one = spark.createDataFrame([(1, 1, 1, [2]), (2, 0, 2, []), (3, 5, 3, [])], "vid long, n_links long, root long, near array<long>")
    assert {r.vid: r.n_links for r in embedding_dedup.link_counts(one, base).collect()} == {1: 1, 2: 1, 3: 5}
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.embedding_dedup(df, recall=1.01)
    assert (embedding_dedup.MARGIN, embedding_dedup.BEAM) == (0.1, 32)


def test_ngram_join_family(spark):
    """Members of one large family, many of them linked only through edits that they share, against all pairs."""
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(150)], [(0, " ".join(f"b{i}" for i in range(150)))]
    sub = list(base)
    for i in (20, 50, 80, 110, 140):
        sub[i] = f"c{i}"
    for d in range(1, 90):
        w = list(base if d % 3 else sub)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(15) * 10
            w[i] = f"e{i}_{rng.randrange(2)}"
        rows.append((d, " ".join(w[:150 - rng.choice((0, 0, 3, 12))])))
    sets = {d: {tuple(w[i:i + 4]) for i in range(len(w) - 3)} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert 3 < len(set(root.values())) < 85
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root
