"""Classifiers, media, HTML and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import html, media, quality, toxicity
from gleanwork.llm.queries import QUERIES

from ..conftest import SF
from .test_text import DOCS, ROWS, documents

BIG = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    got = QUERIES["op9_toxicity"](spark, BIG).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{BIG}/labels.parquet").set_index("doc_id")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.toxic).mean() > 0.95 and got.score.between(0, 1).all()


def test_ngrams_do_not_span_texts_or_depend_on_pieces(monkeypatch):
    texts = ["abcdefgh" * 40, "", None, "xyz", "abcdefgh"]
    whole = toxicity.ngram_hits(texts)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    for a, b in zip(whole, toxicity.ngram_hits(texts)):
        assert (a == b).all()
    alone = toxicity.ngram_hits(["xyz"])
    mine = whole[0] == 3
    assert (whole[1][mine] == alone[1]).all()


def test_ngrams_are_of_characters():
    def brute(text):
        out = {}
        text = " " + text.lower()
        for n in toxicity.SIZES:
            for i in range(len(text) - n + 1):
                code = ord(text[i])
                for c in text[i + 1 : i + n]:
                    code = (code * 0x100000001B3 + ord(c)) % 2**64
                b = int(toxicity.bucket_of(np.array([code], np.uint64), n)[0])
                out[b] = out.get(b, 0) + 1
        return out

    texts = ["Crème brûlée, 😀 é", "a", "", "naïve NAÏVE naïve"]
    doc, bucket, count = toxicity.ngram_hits(texts)
    for i, t in enumerate(texts):
        assert {int(b): int(c) for d, b, c in zip(doc, bucket, count) if d == i} == brute(t)


def test_toxicity_of_a_balanced_sample(spark):
    """A sample of a hundred rows finds the telling word, and the bias holds the classes' true shares."""
    from gleanwork.llm.labelled import sample_labelled

    rng = random.Random(4)
    words = ["tree", "house", "river", "stone", "cloud"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" vile" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = sample_labelled(df, df, "toxic", bound=100, balanced=True)
    assert 60 < sample.count() < 140 and abs(sample.agg(F.sum("weight")).first()[0] - 2000) < 500
    model = toxicity.fit(sample)
    assert ((model.score([r[1] for r in rows]) >= 0.5) == [bool(r[2]) for r in rows]).all()


def test_toxicity_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("score", F.lit("mine"))
    one_class = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    from gleanwork.llm.labelled import sample_labelled

    model = toxicity.fit(sample_labelled(df, one_class, "toxic"))
    got = toxicity.with_scores(df, model, "score").collect()
    assert len(got) == len(ROWS) and all(0 < r.score < 0.5 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.with_scores(spark.createDataFrame([], DOCS), model).count() == 0


def test_quality_keeps_good_documents(spark):
    got = QUERIES["op3_quality"](spark, BIG).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{BIG}/labels.parquet").set_index("doc_id")
    both = got.join(labels, how="inner")
    assert both[both.quality == 1].keep.mean() > 0.98 and both[both.quality == 0].keep.mean() < 0.25


def test_quality_shrinks_sparse_sites(spark):
    rows = [(f"s{i % 40}", f"s{i % 40}/en", 2.0) for i in range(4000)] + [("lone", "lone/en", -9.0), (None, "null", 1.0)]
    sites = {r.site: r for r in quality.site_posteriors(spark.createDataFrame(rows, "source string, site string, evidence double")).collect()}
    assert len(sites) == 42 and abs(sites["s1/en"].path_posterior - 1 / (1 + np.exp(-2))) < 0.02
    assert sites["lone/en"].path_posterior > 0.3


def test_quality_posteriors_against_brute_force(spark):
    """From the evidence on, plain sums over all other documents give the same posteriors."""
    got = QUERIES["op3_quality"](spark, BIG).toPandas().merge(pd.read_parquet(f"{BIG}/documents.parquet")[["doc_id", "source", "lang"]], on="doc_id")
    vote = 1 / (1 + np.exp(-got.evidence))

    def strength(rate, mean, n):
        spread = ((rate - mean) ** 2 - mean * (1 - mean) / n).mean()
        return min(max((mean * (1 - mean)).mean() / spread - 1, 2.0), 1000.0) if spread > 0 else 1000.0

    prior = vote.mean()
    hosts = pd.DataFrame({"source": got.source, "v": vote}).groupby("source", dropna=False).v.agg(["sum", "count"])
    m = strength(hosts["sum"] / hosts["count"], pd.Series(prior, hosts.index), hosts["count"])
    whole = (hosts["sum"] + m * prior) / (hosts["count"] + m)
    paths = pd.DataFrame({"source": got.source, "lang": got.lang, "v": vote}).groupby(["source", "lang"], dropna=False).v.agg(["sum", "count"]).reset_index()
    k = strength(paths["sum"] / paths["count"], paths.source.map(whole), paths["count"])
    for i in range(0, len(got), 7):
        r, v = got.iloc[i], vote.iloc[i]
        near = got.source == r.source
        here = near & (got.lang == r.lang)
        host = (vote[near].sum() - v + m * prior) / (near.sum() - 1 + m)
        path = (vote[here].sum() - v + k * host) / (here.sum() - 1 + k)
        z = r.evidence + np.log(path / (1 - path)) - np.log(prior / (1 - prior))
        assert np.allclose([r.host_posterior, r.path_posterior, r.posterior], [host, path, 1 / (1 + np.exp(-z))])


def test_quality_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("keep", F.lit("mine")).withColumn("site", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.keep for r in quality.judge(df, none).collect()] == [True] * len(ROWS)
    assert quality.judge(spark.createDataFrame([], DOCS), none).count() == 0


def test_media_round_trip(spark):
    got = QUERIES["op2_media"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(*(documents()[c] for c in ("doc_id", "text"))):
        raw = t.encode()
        full = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        stream = media.encode(full)
        offsets = [int(x) for x in r.seek.split(",")]
        assert r.media_sha256 == hashlib.sha256(stream).hexdigest() and r.media_bytes == len(stream) and r.seconds == len(offsets) * 1152 / 44100
        # every offset is that of a frame's sync word, in order
        assert all(stream[x] == 0xFF and stream[x + 1] & 0xE0 == 0xE0 for x in offsets) and sorted(set(offsets)) == offsets


def test_media_parser_resynchronises():
    data = random.Random(1).randbytes(60_000)
    stream = media.encode(data)
    assert media.read_payload(stream) == data
    whole = media.parse(stream)
    assert whole["crc_bad"] == 0 and whole["samples"] == 1152 * whole["frames"] and whole["vbr"]["frames"] == whole["frames"]
    cut = bytearray(stream)
    del cut[20_000:20_500]
    hurt = media.parse(bytes(cut))
    assert whole["frames"] - 2 <= hurt["frames"] < whole["frames"] and hurt["skipped_bytes"] > 0
    flipped = bytearray(stream)
    flipped[whole["seek"][3] + 8] ^= 1
    assert media.parse(bytes(flipped))["crc_bad"] == 1
    assert media.parse(b"")["frames"] == media.parse(b"no audio here")["frames"] == 0
    assert media.parse(b"junk" + stream + b"TAG" + bytes(125))["tags"] in ("id3v1", "id3v2,id3v1")


def crc_plainly(bits):
    c = 0xFFFF
    for b in bits:
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


def frame_of(head, body_bits, size):
    """A frame of Layer I or II with a CRC over header and the bits given."""
    bits = [int(b) for x in head[2:4] for b in f"{x:08b}"] + body_bits
    body = "".join(map(str, body_bits))
    body = int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")
    return (head + crc_plainly(bits).to_bytes(2, "big") + body).ljust(size, b"\x55")


def test_media_checks_every_layer():
    rng = random.Random(6)
    for head, table_, channels, layer in (
        (bytes([0xFF, 0xFE, 0x40, 0xC0]), (4,) * 32, 1, 1), (bytes([0xFF, 0xFE, 0x40, 0x00]), (4,) * 32, 2, 1), (bytes([0xFF, 0xFC, 0xA4, 0x00]), media.ALLOCATION["b"], 2, 2),
        (bytes([0xFF, 0xFC, 0x50, 0xC0]), media.ALLOCATION["a"], 1, 2), (bytes([0xFF, 0xF4, 0x80, 0xC0]), media.ALLOCATION["low"], 1, 2),
    ):
        if layer == 2 and head[2] == 0xA4:
            head = bytes([0xFF, 0xFC, 0xA0, 0x00])  # 192 kbit/s stereo: 96 a channel
        size = media.header(head)[0]
        parts = []
        for _ in range(6):
            bits, chosen = [], 0
            for n in table_:
                for _ in range(channels):
                    value = rng.randrange(1 << n)
                    bits += [int(b) for b in f"{value:0{n}b}"]
                    chosen += value > 0
            bits += [rng.randrange(2) for _ in range(2 * chosen * (layer == 2))]
            parts.append(frame_of(head, bits, size))
        got = media.parse(b"".join(parts))
        assert (got["frames"], got["crc_ok"], got["crc_bad"], got["skipped_bytes"]) == (6, 6, 0, 0)
        hurt = bytearray(b"".join(parts))
        hurt[size + 7] ^= 4
        assert media.parse(bytes(hurt))["crc_bad"] == 1


def test_media_reads_vbri_tables_and_free_format():
    data = random.Random(3).randbytes(5_000)
    plain = media.encode(data)
    first = media.parse(plain)["seek"][0]
    head = plain[first : first + 4]
    size = media.header(head)[0]
    lengths = [7, 9, 11]
    table_ = b"VBRI" + bytes(6) + (12345).to_bytes(4, "big") + (77).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"".join(x.to_bytes(2, "big") for x in lengths)
    frame = (head + bytes(32) + table_).ljust(size, b"\0")
    got = media.parse(frame + plain[first:])
    assert got["vbr"] == {"kind": "VBRI", "bytes": 12345, "frames": 77, "toc": [14, 32, 54]} and got["frames"] == media.parse(plain)["frames"]
    free = bytes([0xFF, 0xFB, 0x00, 0xC0])
    stream = b"".join((bytes([0xFF, 0xFB, 0x02 if i % 3 == 1 else 0x00, 0xC0]) + b"\x11" * 496) + b"\x11" * (i % 3 == 1) for i in range(9))
    got = media.parse(b"junk" + stream)
    assert media.header(free) is None and (got["frames"], got["samples"], got["skipped_bytes"]) == (9, 9 * 1152, 4)


def test_media_columns(spark):
    df = spark.createDataFrame([(1, b"abc" * 999), (2, None), (3, b"")], "id int, payload binary").withColumn("frames", F.lit("mine"))
    got = media.probe_audio(media.stored_audio(df)).orderBy("id").collect()
    assert [r.frames for r in got] == [3, 0, 0] and got[0].seconds == 3 * 1152 / 44100 and len(got[0].seek) == 3
    assert media.probe_audio(media.stored_audio(df.filter("id = 9"))).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><script>var x="</p><p>no";</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a><li><a>About</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b><br>three<p>Four&nbsp;five<div class=ad>Buy</div><ul><li>a<li>b</ul>
<p>%s</p></article><section id="comments"><article class="comment"><p>nice!</p></article></section><form><p>mail?</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(html.aligned(PAGE % "end", PAGE % "other"), set(), set()) == "Title & more\n\nOne two three\n\nFour five\n\na\n\nb\n\nend"


def test_names_of_layouts_and_camel_case():
    page = '<body><div class="page has-sidebar no-ads"><p>kept</p></div><div class="adBanner"><p>off</p></div><div id="sideBar"><p>off</p></div></body>'
    assert html.main_text(html.aligned(page, page), set(), set()) == "kept"


def tree_of(shape, label="t.div"):
    node = html.Node("div", label, False, False)
    node.kids = [tree_of(kids, name) for name, kids in shape]
    return html.grouped(node)[0]


def brute_match(a, b):
    """Simple tree matching by its recursive definition."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return best[-1][-1] + 1


def test_tree_matching_against_its_definition(monkeypatch):
    rng = random.Random(8)

    def shape(depth):
        return [(rng.choice("abcd"), shape(depth - 1)) for _ in range(rng.randrange(5))] if depth else []

    for _ in range(150):
        a, b = tree_of(shape(3)), tree_of(shape(3))
        pairs = html.match(a, b)
        assert html.weight(a, b, {}) == len(pairs) == brute_match(a, b) and all(x.label == y.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_long_lists_are_matched_as_exactly(monkeypatch):
    rng = random.Random(9)

    def shape(depth):
        return [(rng.choice("abc"), shape(depth - 1)) for _ in range(rng.randrange(9))] if depth else []

    def places(pairs):
        return [(x.number, y.number) for x, y in pairs]

    for _ in range(100):
        a, b = tree_of(shape(3)), tree_of(shape(3))
        with monkeypatch.context() as patch:
            short = places(html.match(a, b))
            patch.setattr(html, "CELLS", 0)
            patch.setattr(html, "SHAPES", 3)
            assert places(html.match(a, b)) == short and html.weight(a, b, {}) == len(short)


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_names_do_not_empty_a_page(spark):
    text = "A long enough text of page %d, with words of its own"
    pages = [
        "<body><nav>Home</nav><article class='search-engine-history'><p>%s</p></article></body>",
        "<body><div id='main' class='post reply-paid'><p>%s</p></div><div class='comment-list'><p>so nice</p></div></body>",
        "<body><h1>%s</h1><div class='share-story'><p>%s</p></div><div class='post-comments'><p>so nice</p></div></body>",
        "<body><div class='share-box'><p>%s</p></div><form class='x'>mail?</form></body>",
    ]
    rows = [(i * 10 + k, f"http://h{i}.example/{k}", p.replace("%s", text % k)) for i, p in enumerate(pages) for k in range(5)]
    got = texts_of(spark, rows)
    assert all(got[i * 10 + k] == "\n\n".join([text % k] * p.count("%s")) for i, p in enumerate(pages) for k in range(5))
    # beside an article, hints hold
    both = "<body><article><p>%s</p></article><div class='share-box'><p>share %d</p></div></body>"
    assert all(t == text % k for k, t in texts_of(spark, [(k, f"http://b.example/{k}", both % (text % k, k)) for k in range(5)]).items())
    # reader comments alone are no text, whatever the name around them
    assert set(texts_of(spark, [(k, f"http://c.example/{k}", f"<div class='post-comments'><p>nice {k}</p></div>") for k in range(5)]).values()) == {""}


def test_mirrors_of_an_article_count_as_one_page(spark):
    page = "<body><div class=x%d><script nonce=%d></script><p>The one article of this host</p><p>in two paragraphs</p></div></body>"
    got = texts_of(spark, [(k, f"http://m.example/{k}", page % (k, k)) for k in range(10)])
    assert set(got.values()) == {"The one article of this host\n\nin two paragraphs"}


def test_deep_and_wide_pages_are_read_whole(spark):
    rng = random.Random(10)
    deep = "<body>" + "<div>" * 5000 + "<p>at the bottom</p>" + "</div>" * 5000
    wide = "<body><div>" + "".join(f"<{t}>line {i}</{t}>" for i in range(10_000) for t in ("h3", "p")) + "</div>"
    mixed = ["<body><div>" + "".join(f"<{t}>{k} says {i}</{t}>" for i, t in enumerate(rng.choices(["h3", "p", "pre", "blockquote"], k=20_000))) + "</div>" for k in range(3)]
    rows = [(i, f"http://{h}.example/{i}", page) for i, (h, page) in enumerate([("deep", deep), ("deep", deep + "<p>more"), ("wide", wide), ("wide", wide + "<p>more")] + [("mixed", m) for m in mixed])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "at the bottom" and got[2].count("line") == 20_000 and all(got[4 + k].count(f"{k} says") == 20_000 for k in range(3))


def plain_host(host, n, rng, notice):
    """Pages of a host whose boilerplate has no telling names: (url, html, main text)."""
    words = lambda k: " ".join(rng.choice(["mira", "tolo", "seva", "runi", "pado", "keli"]) + str(rng.randrange(99)) for _ in range(k))
    for i in range(n):
        paragraphs = [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        links = "".join(f"<li><a href=/{words(1)}>{words(2)}</a></li>" for _ in range(rng.randrange(3, 7)))
        shown = f"<div class=x9><p>{notice}</p></div>" if i % 3 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        yield (
            f"http://{host}/{i}",
            f"<body><div class=x1>{host} standing head</div><div class=x2><ul>{links}</ul></div>{shown}<div class=x3><div class=x4>{body}</div></div><div class=x5><p>All of it by {host}</p><p>{words(3)}</p></div></body>",
            "\n\n".join(paragraphs),
        )


def test_wrapper_finds_the_text_without_telling_names(spark):
    rng = random.Random(11)
    pages = [p for h in ("one.example", "two.example", "three.example") for p in plain_host(h, 12, rng, "We wish to say this on most pages")]
    copies = [pages[0]] * 60  # copies of one page must not make its article a template
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages + copies)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(len(pages + copies))] == [t for _, _, t in pages + copies]


def test_blocks_that_the_reference_lacks_are_counted(spark):
    page = "<body><div>%s<p>text %d of its own, long enough to be the core</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page % ("<section><p>Standing notice</p></section>" * (i % 2), i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text == f"text {r.page_id} of its own, long enough to be the core" for r in html.extract(df).collect())


def plain_articles(page):
    """Main text of a supplied page by a plain reader: what stands in <article>, but for adverts, comments and the like."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.blocks, self.now = [], [], []

        def close_block(self):
            text = " ".join("".join(self.now).split())
            self.blocks += [text] if text else []
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "hr", "img", "meta", "link", "input"):
                self.now.append(" ")
                return
            if tag in html.BLOCK:
                self.close_block()
                if tag == "p" and "p" in [t for t, _ in self.stack]:
                    self.handle_endtag("p")
            names = set((dict(attrs).get("class") or "").split()) | {tag}
            self.stack.append((tag, bool(names & {"ad", "nav", "aside", "footer", "form", "script", "style", "comment", "comments"})))

        def handle_endtag(self, tag):
            if tag in html.BLOCK:
                self.close_block()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.stack) and not any(bad for _, bad in self.stack):
                self.now.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.close_block()
    return "\n\n".join(reader.blocks)


def test_html_query_against_a_plain_reader(spark):
    got = QUERIES["op5_html"](spark, SF).toPandas().set_index("page_id").text
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert all(got[i] == plain_articles(h) for i, h in zip(pages.page_id, pages.html))


def test_wrapper_drops_constant_slots(spark):
    page = "<body><div><p>Standing line</p><div><p>text %d of its own</p></div></div></body>"
    rows = [(i, f"http://h.example/{i}", page % i) for i in range(8)] + [(100, None, None), (101, "http://x.example", ""), (102, "http://y.example/a", page % 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[3] == "text 3 of its own" and got[100] == got[101] == "" and got[102] == "Standing line\n\ntext 9 of its own"
    assert html.extract(df.filter("page_id = 0 and page_id = 1")).count() == 0


def test_html_query_returns_every_page(spark):
    got = QUERIES["op5_html"](spark, SF).toPandas()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert sorted(got.page_id) == sorted(pages.page_id) and (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.stored(stage(spark, docs, SF))
        assert docs.columns == before.columns
        if name in ("quality", "near_duplicates"):
            assert 0 < docs.count() <= before.count() and docs.join(before, docs.columns, "left_anti").count() == 0
        if name == "pii":
            assert docs.count() == before.count() and docs.filter("text rlike '[A-Za-z0-9]@[a-z]+[.]'").count() == 0
    assert docs.select("doc_id").distinct().join(first, "doc_id", "left_anti").count() == 0
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("bin_id").agg(F.sum("tokens").alias("n")).filter("n > 2048").count() == 0
    assert packed.agg(F.sum("tokens")).first()[0] == docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]


def test_joins_agree_with_and_without_a_broadcast(spark, monkeypatch):
    from gleanwork.llm import common

    big = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i % 3}") for i in range(60)], "i int, k string")
    small = spark.createDataFrame([("k0", 1), ("k1", 2), (None, 3)], "k string, v int")
    want = sorted(map(str, common.join_small(big, small, "k").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    merged = common.join_small(big, small, "k")
    assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString() and sorted(map(str, merged.collect())) == want


def test_html_without_a_broadcast(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r.page_id, r.text) for r in html.extract(pages).collect())
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert sorted((r.page_id, r.text) for r in html.extract(pages).collect()) == want


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from gleanwork.llm import common

    conf = SimpleNamespace(get=lambda name: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(sparkContext=context))


def plainly_sanitised(text, spans):
    """`text` with (kind, start, end) spans replaced; of overlapping ones the one that starts first, then the longer."""
    import re

    labels = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "gone": ""}
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            word = text[a:b]
            name = "[NUMBER]" if re.fullmatch(r"\d+", word) else "[CODE]" if re.search(r"\d", word) else "[NAME]" if word[:1].isupper() else "[TERM]"
            out += [text[at:a], name if kind == "term" else labels[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline_against_brute_force(spark, oracle):
    """Each stage's rows from plain Python, on what the stage before kept; then the whole run."""
    import duckdb

    import corpus_pipeline as p

    from .test_groups import best_fit_plainly, brute_components
    from .test_text import base_spans, brute_terms

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in QUERIES["op3_quality"](spark, SF).filter("keep").collect()}
    got = [p.stored(p.STAGES[0][1](spark, docs, SF))]
    for _, stage in p.STAGES[1:-1]:
        got.append(p.stored(stage(spark, got[-1], SF)))
    frames = [g.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True) for g in got]
    assert set(frames[0].doc_id) == kept and len(frames[0]) == len(kept)
    component, _ = brute_components(frames[0].doc_id, frames[0].text, 5, 80)
    assert list(frames[1].doc_id) == sorted(i for i, c in component.items() if i == c)
    terms = brute_terms(list(frames[1].text), 3, 0.9, 0.98, kinds=True)
    for before, after in zip(frames[1].itertuples(), frames[2].itertuples()):
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(before.text).split(",") if x)]
        assert after.doc_id == before.doc_id and after.text == plainly_sanitised(before.text, base + terms[before.text]) and (before.text == after.text or after.n_chars == len(after.text))
    con = duckdb.connect()
    con.register("documents", frames[2])
    from gleanwork.llm.mixing import OP10_SQL

    for r in con.execute(OP10_SQL).df().itertuples():
        if r.size:
            assert (frames[3].doc_id == r.doc_id).sum() == r.taken / r.size
    packed = p.run(spark, SF).toPandas()
    rest = packed[~packed.bin_id.str.startswith("full")].sort_values(["tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
    text = frames[3].drop_duplicates("doc_id").set_index("doc_id").text
    source, cluster = rest.source.fillna("\0").factorize()[0], rest.doc_id.map(text).factorize()[0]
    bins = best_fit_plainly([(int(n), 1 << int(s), 1 << int(c)) for n, s, c in zip(rest.tokens, source, cluster)], 2048)
    assert pd.Series(bins).factorize()[0].tolist() == rest.bin_id.factorize()[0].tolist()
    words = frames[3].text.map(lambda t: len(t.encode().split())).sum()
    assert packed.tokens.sum() == words and packed.groupby("bin_id").tokens.sum().max() <= 2048


def test_pipeline_stages_awkward_rows(spark):
    import corpus_pipeline as p

    extra = spark.createDataFrame(ROWS, DOCS).withColumn("component_id", F.lit("mine")).withColumn("base", F.lit("mine")).withColumn("target", F.lit("mine"))
    none = spark.createDataFrame([], DOCS)
    for name, stage in p.STAGES:
        rows, nothing = stage(spark, extra, SF), stage(spark, none, SF)
        if name != "packing":
            assert rows.columns == extra.columns and nothing.columns == none.columns
        assert rows.count() > 0 and nothing.count() == 0
