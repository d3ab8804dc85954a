"""Training-data operators against brute force, round trips and held-out accuracy.

The small cases hold nulls, empty and repeated rows, ties and clashing extra columns.
"""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_text, linededup, neardup, packing, quality_classifier, quality_rules, queries, sharding, tokenfiles, wordpiece
from quarry.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", id long, h int, bucket int, bits string, n_lines int, score string, shard string, vslot int"


def plain_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text, n):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty texts, null ids, repeated rows, very long lines and texts, clashing columns."""
    long_text = " ".join(f"w{i % 700}" for i in range(6000))
    texts = [(1, None), (2, ""), (3, "One line only here"), (3, "One line only here"), (None, "No id at all, but text"), (None, None), (4, " \t\n"), (5, long_text), (6, long_text + " tail"), (7, "ONE LINE ONLY HERE\nsecond line of text"), (8, "a b\n\n\x0b" + "x" * 5000)]
    rows = [(i, t, "en" if i != 4 else None, None if i == 5 else "s", 1, 9, 9, 9, "b", 9, "s", "x", 9) for i, t in texts]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Token files


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    manifest = tokenfiles.write(docs, f"file://{tmp_path}/t", frame_ids=2000)
    got = {r.doc_id: r for r in tokenfiles.read(manifest).collect()}
    model, start = Tokenizer.from_file(tokenfiles.default_tokenizer()), 0
    for d in docs.orderBy("doc_id").collect():
        ids = model.encode(d.text or "", add_special_tokens=False).ids + [1]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = manifest.orderBy("part").first()
    one = tokenfiles.read_documents(some.file, [some.first_id])
    assert list(one) == [some.first_id] and one[some.first_id][-1] == 1


def test_token_file_is_a_zstd_stream_with_checksums(spark, tmp_path):
    import io

    import zstandard

    df = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    file = tokenfiles.write(df, f"file://{tmp_path}/t", frame_ids=16).first().file.removeprefix("file://")
    raw = open(file, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    reader = tokenfiles.Reader(io.BytesIO(raw), len(raw))
    ids = b"".join(i for _, i in reader.documents())
    assert len(reader.entries) > 3 and plain.startswith(ids)
    broken = bytearray(raw)
    broken[int(reader.starts[1]) + 12] ^= 255
    with pytest.raises(Exception):  # noqa: B017  zstd's own checksum or the seek table's
        list(tokenfiles.Reader(io.BytesIO(bytes(broken)), len(raw)).documents())


def test_encoder_equals_library_on_odd_texts():
    from tokenizers import Tokenizer

    encoder, model = tokenfiles.Encoder(tokenfiles.default_tokenizer()), Tokenizer.from_file(tokenfiles.default_tokenizer())
    odd = ["It's don't We'LL 's, hello., ÉTÉ. Straße, ÿ. naïve ﬁ <|endoftext|>. a,b.c, x1.", "İstanbul ΣΑΣ. é, ..., ,. . , K. é.", "\x1c\x85a b　c.", "", None]
    for text, ids in zip(odd, encoder(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text or "", add_special_tokens=False).ids


def test_encoder_lowers_no_word_before_the_library():
    from tokenizers import Tokenizer

    encoder, model = tokenfiles.Encoder(tokenfiles.default_tokenizer()), Tokenizer.from_file(tokenfiles.default_tokenizer())
    odd = ["J\u030c j\u030c T\u0308. H\u0331, W\u030aY\u030a", "<|ENDOFTEXT|> <|endoftext|> <|EndOfText|>.", "The the THE. \u00c9T\u00c9, \u00e9t\u00e9 \u212a \u212b \u1e9e. E\u0301"]
    for text, ids in zip(odd, encoder(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


# Near duplicates


def brute_components(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_brute_force(docs, n):
    want = brute_components([(d.doc_id, d.text) for d in docs.collect()], n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, n).collect()}
    assert got == want


def test_near_duplicates_chains_and_large_groups(spark):
    """A loose group: copies of one text with few to many words changed, so that many are no links of the hub."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 14)):
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, f"short {i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 2).collect()}
    assert got == brute_components(rows, 2)


def test_rows_of_one_doc_id_with_two_texts(spark):
    """No text is lost when a doc_id holds two texts, in either order of the ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (7, c), (7, c), (7, c + " tail"), (2, a + " x"), (None, b)], "doc_id long, text string")
    near = sorted(tuple(r) for r in neardup.near_duplicates(df).select("doc_id", "component_id", "kept").collect() if r.doc_id)
    assert near == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (7, 7, True), (9, 5, False)]
    left = collections.Counter((r.doc_id, r.text) for r in neardup.keep_one(df).collect())
    assert left in (collections.Counter([(1, a), (5, b), (7, c), (7, c), (None, b)]), collections.Counter([(1, a), (5, b), (7, c + " tail"), (None, b)]))


def test_hot_keys_are_dealt(spark, monkeypatch):
    """The same result when nearly every key counts as hot."""
    from quarry.llm import shared

    monkeypatch.setattr(shared, "LEAST_HOT", 2)
    monkeypatch.setattr(shared, "MOST_HOT", 10**9)
    base = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(base[:40] + [f"n{i}"] + base[40:]) if i % 3 else " ".join(base)) for i in range(60)] + [(100 + i, f"other text {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 2).collect()}
    assert got == brute_components(rows, 2)


def test_hyperminhash_estimate(spark):
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(401, 2401, dtype=np.uint64)
    regs = [neardup.registers(neardup.mix(x)) for x in (a, b)]
    rows = [tuple(r.view(np.int64).tolist() for r in regs) + (2000, 2000)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, na long, nb long")
    equal = float((regs[0] == regs[1]).mean())
    got = df.select(neardup.estimate("a", "b", "na", "nb")).first()[0]
    assert abs(got - equal) < 1e-3 and abs(got - 2 / 3) < 0.2


# Extraction


def test_html_article_and_furniture():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div><div id=cookie-notice>Accept</div>"
        "<main><h1>Head &amp; more</h1><p>One <b>bold</b>\n text<p>Two<br>lines &lt;3<script>x('</p>')</script><aside>Side</aside><section class=comments><p>Nice</section>"
        "<table><tr><td>c1<td>c2</table><form>Mail</form></main><footer>(c)</footer>"
    )
    assert [t for r, t in html_text.page_lines(page) if r == "body"] == ["Head & more", "One bold text", "Two lines <3", "c1", "c2"]
    assert html_text.page_lines(None) == [] and html_text.page_lines("plain") == [("open", "plain")]


def bodies(page):
    return [t for r, t in html_text.page_lines(page) if r == "body"]


def test_html_attribute_rules():
    for page, want in [
        ("<article><p title=it's>First</p><p>Second isn't lost</p><p>third</p></article>", ["First", "Second isn't lost", "third"]),
        ("<article><a title=\"x>bad</a></article>", ["bad"]),
        ("<article><p data-x='a>b' class=x/>one</p><p a = \"1>2\" b>two</p><p =x>three</p></article>", ["one", "two", "three"]),
        ("<article><p>E = <math><mi>m</mi></math></p><object>inside</object><p hidden>also</p></article>", ["E = m", "inside", "also"]),
        ("<article><p>kept</p><p class='unclosed", ["kept"]),
        ("<article>1 < 2 <3 and a<b>c</b></article>", ["1 < 2 <3 and ac"]),
        ("<article>" + "<p a='" * 3000, []),
    ]:
        assert bodies(page) == want, page
    for name in ("content has-sidebar", "related-work", "notice-of-meeting"):
        assert bodies(f"<article><p>a</p><div class='{name}'>kept</div></article>") == ["a", "kept"]
        assert html_text.page_lines(f"<div id='{name}'>kept</div>") == [("open", "kept")]
    for name in ("sidebar", "cookie-notice", "site-footer", "ad-top-12", "post-comments"):
        assert bodies(f"<article><p>a</p><div class='x {name}'>gone</div></article>") == ["a"]
    assert html_text.page_lines("<div class=widget><p>most of the text of this page</p></div><p>rest</p>") == [("open", "most of the text of this page"), ("open", "rest")]


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='layout has-sidebar'>%s</div>", "<div class='no-comments'>%s</div>", "<div class='share-enabled navbar-offset'>%s</div>", "<form action=x><div>%s</div></form>", "<div id=sidebar-layout>%s</div>"],
)
def test_html_article_in_a_wrapper(wrapper):
    article = "<article><p>One</p><div class='post-comments'><article>Remark</article></div><p class=has-ads>Two</p></article>"
    page = f"<body><nav><article>Menu</article></nav>{wrapper % article}<div class=related><article>Other page</article></div><form>Send</form></body>"
    assert [t for r, t in html_text.page_lines(page) if r == "body"] == ["One", "Two"]
    assert not [t for r, t in html_text.page_lines(page) if r == "open"]


def test_what_is_not_seen_parts_no_line():
    for unseen in ("<svg/>", "<svg><path d='x'/><text>no</text></svg>", "<script>x('</p>')</script>", "<noscript><p>no</p></noscript>", "<textarea>no</textarea>", "<select><option>no</select>", "<iframe>no</iframe>", "<template><div>no</div></template>"):
        assert bodies(f"<article><p>Hello {unseen} world</p><p>next</p></article>") == ["Hello world", "next"], unseen


def test_class_words_in_any_spelling():
    for name in ("cookieConsent", "related-posts", "reader-remarks", "relatedPosts", "CookieBanner", "newsletter_signup", "navBar-top"):
        assert bodies(f"<article><p>a</p><div class='{name}'>gone</div></article>") == ["a"], name
    for name in ("relatedWork", "notice-of-meeting", "adaptive", "navigate"):
        assert bodies(f"<article><p>a</p><div class='{name}'>kept</div></article>") == ["a", "kept"], name


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        best = max(k for k in range(len(a) + 1) for c in itertools.combinations(a, k) if k == 0 or all(x in it for it in [iter(b)] for x in c))
        assert len(html_text.shared_lines(a, b)) == best


def plain_lines(page):
    """(role, text) of the given kind of pages by the standard library's parser: blocks, nav, footer, class ad, article."""
    from html.parser import HTMLParser

    lines, parts, open_tags = [], [], []

    def end():
        text = " ".join("".join(parts).split())
        if text:
            inside = [t for t, _ in open_tags]
            skip = {"nav", "footer"} & set(inside) or any(c == "ad" for _, c in open_tags)
            lines.append(("skip" if skip else "body" if "article" in inside else "open", text))
        parts.clear()

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "br":
                parts.append(" ")
            elif tag not in ("b", "i", "a", "meta"):
                end()
                if tag == "p" and open_tags and open_tags[-1][0] == "p":
                    open_tags.pop()
                open_tags.append((tag, dict(attrs).get("class")))

        def handle_endtag(self, tag):
            if tag in [t for t, _ in open_tags]:
                end()
                while open_tags.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not {"script", "style", "title"} & {t for t, _ in open_tags}:
                parts.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(page or "")
    reader.close()
    end()
    return lines


def plain_common(a, b):
    """Places in ``a`` of a longest common subsequence, by the quadratic table, from equal ends inwards."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) - 1, -1, -1), range(len(b) - 1, -1, -1)):
        n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    return n[0][0]


def plain_extract(rows, lines_of):
    """Pairs, alignment and deletion on a whole table, one page after the other."""
    def place(r):
        m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)", r[1] or "")
        return (m[1].lower(), m[2]) if m else ("", r[1] or "")

    table = sorted(((place(r), r[0] is not None, r[0] or 0, lines_of(r[2])) for r in rows), key=lambda x: x[:3])
    out, deleted = [], 0
    for k, (at, named, page_id, lines) in enumerate(table):
        prefix = lambda x: next((i for i, (a, b) in enumerate(zip(at[1], x[0][1])) if a != b), min(len(at[1]), len(x[0][1])))  # noqa: B023, E731, B905
        near = [table[j] for j in (k - 1, k + 1) if 0 <= j < len(table) and table[j][0][0] == at[0]]
        near.sort(key=prefix, reverse=True)
        left = None
        for other in near:
            own, theirs = [t for _, t in lines], [t for _, t in other[3]]
            if plain_common(own, theirs) < len(own):
                gone = html_text.shared_lines(own, theirs)
                assert not gone or len(gone) == plain_common(own, theirs)
                deleted += sum(lines[i][0] == "open" for i in gone)
                left = [t for i, (r, t) in enumerate(lines) if r == "body" or (r == "open" and i not in gone)]
                break
        left = left or [t for r, t in lines if r == "body"] or [t for r, t in lines if r == "open"]
        out.append((page_id if named else None, "\n".join(left)))
    return sorted(out, key=str), deleted


def test_extraction_brute_force(spark, sf_dir):
    """The whole table, parsed by another parser, paired, aligned and cut one page after the other."""
    pages = table(spark, sf_dir, "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want, deleted = plain_extract(rows, plain_lines)
    assert sorted(((r.page_id, r.text) for r in html_text.extract(pages).collect()), key=str) == want
    assert deleted == 0  # every line of these pages is inside an article or in furniture: roles decide all of them


def test_extraction_of_open_pages_brute_force(spark, monkeypatch):
    """Pages without markup of roles, with an article and unmarked furniture, copies, null and repeated ids, clashing columns."""
    rng, rows = random.Random(11), []
    line = lambda k: f"<p>{rng.choice('abcdefgh')} {k}</p>"
    for host in ("x.org", "y.org:80", "Y.org"):
        for k in range(25):
            shared = "<div>Top line</div>" + "".join(f"<div>menu {j}</div>" for j in range(3))
            own = "".join(line(f"{host}{k}{j}") for j in range(rng.randrange(4)))
            middle = f"<article><h1>t{k}</h1>{own}</article><div>seen {k}</div>" if k % 4 == 0 else own
            rows.append((100 + k if host == "Y.org" else None if k == 7 else k % 20, f"http://{host}/{'ab'[k % 2]}/{k % 9}?q={k}", f"<body>{shared}{middle}<div>Legal</div></body>"))
    rows += [rows[3], rows[3], (5, None, None), (6, "no url", "<p>alone"), (8, "http://z.org/", "<p>" + "long text " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "m", "h") for r in rows], "page_id long, url string, html string, host int, mark string, text string")
    want, deleted = plain_extract(rows, html_text.page_lines)
    got = html_text.extract(df).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == want and deleted > 200
    assert all(r.n_chars == len(r.text) for r in got)
    text = {r.url: r.text for r in got}
    monkeypatch.setattr(html_text, "shared_lines", lambda a, b: set())
    assert sum(len(page_id_text[1]) for page_id_text in plain_extract(rows, html_text.page_lines)[0]) > sum(len(x[1]) for x in want)  # without differencing the menus stay
    assert text["http://x.org/a/3?q=12"].startswith("t12") and text["http://x.org/a/3?q=12"].endswith("seen 12")


@pytest.mark.parametrize("pages_a_part", [1, 7, 1000])
def test_page_differencing_does_not_depend_on_parts(spark, monkeypatch, pages_a_part):
    """One part a page to one for all, with and without the reuse of exchanges: the same pages, each once."""
    monkeypatch.setattr(html_text, "PART_PAGES", pages_a_part)
    page = lambda i, host, k: (i, f"http://{host}/a/{k}", f"<body><div>Top menu</div><p>Text {k} of {host}.<p>More {k}</p><div>Legal line</div></body>", 1)
    rows = [page(i, h, k) for i, (h, k) in enumerate(itertools.product("abc", range(20)))] + [(900, None, None, 1), (901, "http://lone/x", "<p>only", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    spark.conf.set("spark.sql.exchange.reuse", str(pages_a_part == 7).lower())
    try:
        got = html_text.extract(df).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    seen = {r.page_id: r.text for r in got}
    assert len(got) == len(seen) == 62
    assert all(seen[i] == f"Text {k} of {h}.\nMore {k}" for i, (h, k) in enumerate(itertools.product("abc", range(20))))
    assert seen[900] == "" and seen[901] == "only"


# Quality rules


def test_base_stats_brute_force(docs, awkward):
    for df in (docs, awkward):
        rows = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.base_stats(df).collect()}
        want = set()
        for d in df.collect():
            t = d.text or ""
            w = [v for v in re.split("[\x20\x09-\x0d]+", t) if v]
            g, hit = collections.Counter(zip(w, w[1:], w[2:])), set()
            for k in range(len(w) - 2):
                if g[tuple(w[k : k + 3])] > 1:
                    hit |= {k, k + 1, k + 2}
            ls = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            want.add((d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
        assert rows == want


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta rho sigma tau phi chi psi omega kappa".split()) + str(rng.randrange(400)) for _ in range(rng.randrange(80, 300)))
    rows = [(i, text(), "en", "s", 0) for i in range(300)] + [(1000 + i, re.sub(r"(\d) ", r"\1%%% ", text()), "en", "s", 0) for i in range(20)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(out[i] for i in range(300)) >= 299 and not any(out[1000 + i] for i in range(20))


def plain_mcd(x):
    """The documented estimate of one group in numpy: starts, concentration steps, least determinant."""
    n, share = len(x), quality_rules.SHARE

    def middle(v):
        return np.sort(v, axis=0)[-(-len(v) // 2) - 1]

    def inverse(c, ridge):
        c = c + np.diag(ridge)
        return np.linalg.inv(c), np.log(np.diag(np.linalg.cholesky(c))).sum()

    def nearest(d):
        step = np.floor(np.log2(np.maximum(d, 1e-9)) * 256)
        return x[step <= np.sort(step)[int(np.ceil(share * n)) - 1]]

    def distances(near):
        own, det = inverse(np.cov(near.T, bias=True), quality_rules.RIDGE)
        e = x - near.mean(axis=0)
        return np.einsum("ij,jk,ik->i", e, own, e), det

    z = (x - middle(x)) / (middle(np.abs(x - middle(x))) + 0.02)
    r = np.sqrt((z * z).sum(axis=1))
    starts = [r * r]
    for y in (z / (r[:, None] + 1e-9), np.tanh(z)):
        own, _ = inverse(np.cov(y.T, bias=True), [0.01] * 5)
        starts.append(np.einsum("ij,jk,ik->i", z, own, z))
    ends = []
    for d in starts:
        near = nearest(d)
        for _ in range(quality_rules.FIRST_STEPS):
            near = nearest(distances(near)[0])
        ends.append((distances(near)[1], near))
    near = min(ends, key=lambda e: e[0])[1]
    for _ in range(quality_rules.STEPS):
        near = nearest(distances(near)[0])
    return near.mean(axis=0), np.cov(near.T, bias=True)


def test_mcd_brute_force(spark):
    """Mean and covariance of several groups equal those of numpy."""
    rng = np.random.default_rng(2)
    groups = {}
    for name, n in (("a", 400), ("b", 61), ("c", 7)):
        groups[name] = rng.normal(size=(n, 5)) * [1, 2, 0.5, 1, 3]
        groups[name][: n // 5] += rng.normal(20, 3, size=5)
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{v} double" for v in quality_rules.VECTOR))
    got = {r.g: r for r in quality_rules.estimates(df).collect()}
    for g, x in groups.items():
        mean, cov = plain_mcd(x)
        assert got[g]["size"] == len(x) and np.allclose([got[g][f"m{i}"] for i in range(5)], mean)
        assert np.allclose([got[g][f"c{i}{j}"] for i, j in quality_rules.PAIRS], [cov[i, j] for i, j in quality_rules.PAIRS])


def test_quality_verdict_brute_force(spark, docs):
    """The verdict of every text from numpy estimates, pooled with language and whole."""
    kept = {r.doc_id: (r.kept, r.distance) for r in quality_rules.quality_rules(docs).collect()}
    rows = [r for r in quality_rules.vectors(quality_rules.base_stats(docs)).collect() if not r.base_failed]
    vector = {r.doc_id: np.array([r[v] for v in quality_rules.VECTOR]) for r in rows}
    members = collections.defaultdict(list)
    for r in rows:
        for key in ((r.lang, r.source), r.lang, ""):
            members[key].append(vector[r.doc_id])
    made = {k: (*plain_mcd(np.array(v)), len(v)) for k, v in members.items()}

    def pooled(own, above):
        (m, c, n), (up_m, up_c) = own, above
        a = n / (n + quality_rules.PRIOR_TEXTS)
        return a * m + (1 - a) * up_m, a * c + (1 - a) * up_c + a * (1 - a) * np.outer(m - up_m, m - up_m)

    for r in rows:
        mean, cov = pooled(made[(r.lang, r.source)], pooled(made[r.lang], made[""][:2]))
        d = vector[r.doc_id] - mean
        want = d @ np.linalg.inv(cov * quality_rules.CONSISTENCY + np.diag(quality_rules.RIDGE)) @ d
        assert kept[r.doc_id][0] == (want <= quality_rules.LIMIT) and np.isclose(kept[r.doc_id][1], want)
    assert all(not k and d is None for i, (k, d) in kept.items() if i not in vector)


def test_many_groups_take_the_join(spark, docs, monkeypatch):
    want = sorted(map(str, quality_rules.quality_rules(docs).select("doc_id", "kept").collect()))
    monkeypatch.setattr(quality_rules, "GROUPS", 0)
    assert sorted(map(str, quality_rules.quality_rules(docs).select("doc_id", "kept").collect())) == want


# Token counts


def test_automaton_against_greedy():
    rng = random.Random(4)
    for _ in range(300):
        pieces = {("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 25))}
        machine = wordpiece.Automaton(pieces)
        for _ in range(40):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            assert machine.count(word) == wordpiece.greedy_count(word, pieces), (word, pieces)


def test_token_counts_match_library(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = wordpiece.vocabulary()
    pieces = {p[1:] for p in vocab if p.startswith("▁")}, {"##" + p for p in vocab if not p.startswith("▁")}
    model = Tokenizer(models.WordPiece({p: i for i, p in enumerate(sorted(pieces[0] | pieces[1] | {"[UNK]"}))}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
    got = {r.doc_id: r.n_tokens for r in wordpiece.token_counts(docs).collect()}
    for d in docs.collect():
        text = " ".join(w for w in re.split("[\x20\x09-\x0d]+", d.text or "") if w)
        assert got[d.doc_id] == len(model.encode(text).ids) if text else got[d.doc_id] == 0


# Line dedup


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    held[key(line)].add(i)
    gone = lambda i, line: i is not None and len(held.get(key(line), ())) > 1 and min(held[key(line)]) != i
    return sorted(((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows), key=str)


def test_line_dedup_brute_force_and_reversal(spark, docs, awkward):
    for df in (docs, awkward):
        rows = [(d.doc_id, d.text) for d in df.collect()]
        assert sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()), key=str) == brute_lines(rows)
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    first, second = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    index = linededup.LineIndex.create(spark, shards=3).insert(first).insert(second)
    assert sorted(((r.doc_id, r.text) for r in index.clean(docs).collect()), key=str) == brute_lines(rows)
    back = index.delete(second.select("doc_id"))
    left = [(i, t) for i, t in rows if i % 3]
    assert sorted(((r.doc_id, r.text) for r in back.clean(first).collect()), key=str) == brute_lines(left)
    once = linededup.LineIndex.create(spark, shards=3).insert(first)
    assert sorted(map(tuple, back.counts().collect())) == sorted(map(tuple, once.counts().collect()))
    stored = back.counts().select("k1", "k2")
    assert back.probe(stored).filter("not maybe").count() == 0
    opened = linededup.LineIndex.open(spark, back.path)
    assert (opened.version, opened.n_keys) == (3, back.counts().count())
    with pytest.raises(Exception, match="(?i)exist"):  # a second change from an older handle
        index.insert(second)
    again = back.insert(docs)  # known documents add nothing, deleted ones come back
    assert sorted(map(tuple, again.counts().collect())) == sorted(map(tuple, index.counts().collect()))
    assert sorted(((r.doc_id, r.text) for r in again.clean(docs).collect()), key=str) == brute_lines(rows)


def test_line_results_go_through_the_filters(spark, monkeypatch):
    """Keys that a filter denies do not meet the exact table: with blind filters the result is wrong. Shards double as
    keys come."""
    text = lambda ids: "\n".join(f"line number {i} of all" for i in ids)
    df = spark.createDataFrame([(i, text(range(i, i + 30))) for i in range(40)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_lines(rows)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    index = linededup.LineIndex.create(spark, shards=2)
    for k in range(3):
        index = index.insert(df.filter(f"doc_id % 3 = {k}"))
    assert index.shards > 2 and sorted(((r.doc_id, r.text) for r in index.clean(df).collect()), key=str) == want
    monkeypatch.setattr(linededup.CuckooFilter, "contains", lambda self, k1, k2: np.zeros(len(k1), bool))
    blind = linededup.LineIndex.create(spark, shards=2)
    for k in range(3):
        blind = blind.insert(df.filter(f"doc_id % 3 = {k}"))
    assert sorted(((r.doc_id, r.text) for r in blind.clean(df).collect()), key=str) != want


def test_a_batch_larger_than_the_index_is_probed_in_shards_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 20)
    rows = lambda a, b: spark.createDataFrame([(i, f"line number {i // 2} of all\nanother line {i}") for i in range(a, b)], "doc_id long, text string")
    sizes = []
    probe = linededup.LineIndex.probe
    monkeypatch.setattr(linededup.LineIndex, "probe", lambda self, keys: sizes.append(max(r["count"] for r in self._sharded(keys).groupBy("shard").count().collect())) or probe(self, keys))
    one = linededup.LineIndex.create(spark, shards=1).insert(rows(0, 6))
    two = one.insert(rows(5, 600))
    assert len(sizes) == 1 and sizes[0] < 60 and two.shards >= 32
    want = spark.createDataFrame([(r.doc_id, r.text) for r in rows(0, 6).union(rows(6, 600)).collect()], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in two.clean(want).collect()}
    assert got == {i: i % 2 for i in range(600)}


def test_a_batch_size_of_the_caller_stays(spark):
    from quarry.llm.shared import BATCH, text_batches

    spark.conf.set(BATCH, "10000")  # Spark's default, chosen on purpose
    text_batches(spark)
    assert spark.conf.get(BATCH) == "10000"
    spark.conf.unset(BATCH)
    text_batches(spark)
    assert spark.conf.get(BATCH) == "1000"


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "row_key", "_id", "_part", "_lines", "_hit", "_lost", "_row", "a.b"]
    df = spark.createDataFrame([(i, f"some text of a line {i // 2}\nanother line that is long {i // 2}", *[f"{c}{i}" for c in names[2:]]) for i in range(8)], names)
    for out, kept in ((neardup.keep_one(df), 4), (linededup.dedup_lines(df).drop("n_lines", "n_dropped"), 8), (decontaminate.drop_contaminated(df, df.limit(0).withColumnRenamed("doc_id", "item_id")), 8)):
        rows = out.collect()
        assert sorted(out.columns) == sorted(names) and len(rows) == kept
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names[2:])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k1, k2 = (rng.integers(-(2**62), 2**62, 20_000) for _ in range(2))
    f = linededup.CuckooFilter.holding(20_000)
    assert f.insert(k1, k2) and f.contains(k1, k2).all()
    f.delete(k1[:10_000], k2[:10_000])
    assert f.contains(k1[10_000:], k2[10_000:]).all() and f.contains(k1[:10_000], k2[:10_000]).mean() < 0.01


# Sharding


def test_virtual_slots(spark, docs, awkward):
    for df in (docs, awkward):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sums = [sum(r.size for r in v) for v in by.values()]
    big = {r.shard: r for r in sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert max(r.b for r in big.values()) - min(r.b for r in big.values()) <= max(r[0] for r in sharding.shard_documents(docs).groupBy("vslot").agg(F.sum("size")).select("sum(size)").collect())
    assert sums


def test_slot_maps_are_stored_and_edited(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/maps"
    one = {r.vslot: r.shard for r in sharding.shard_documents(docs, 4, 64, path).collect()}
    assert {r.vslot: r.shard for r in sharding.read_map(spark, path).collect()} == one
    two = {r.vslot: r.shard for r in sharding.shard_documents(docs, 5, 64, path).collect()}
    assert {r.version for r in sharding.read_map(spark, path).collect()} == {2}
    assert {r.vslot: r.shard for r in sharding.read_map(spark, path, 1).collect()} == one
    assert all(two[v] in (one[v], 4) for v in one) and any(two[v] == 4 for v in two)
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.store_map(sharding.read_map(spark, path, 1), path)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 3)
    hot = spark.createDataFrame([(None, "same text")] * 50 + [(i, f"t{i}") for i in range(30)], "doc_id long, text string")
    rows = sharding.shard_documents(hot, 4, 16).collect()
    assert collections.Counter((r.shard, r.slot) for r in rows) == collections.Counter((k, i) for k in range(4) for i in range(sum(r.shard == k for r in rows)))


def test_hot_keys_keep_the_law(spark, docs):
    """A third of the rows without a doc_id, and a doc_id that a fifth of the rows repeat: shards within 2 % of each other."""
    i = F.col("doc_id")
    big = docs.crossJoin(spark.range(30).select(F.col("id").alias("copy"))).withColumn("doc_id", i * 30 + F.col("copy"))
    hot = big.withColumn("doc_id", F.when(i % 3 == 0, F.lit(None)).when(i % 5 == 1, F.lit(77)).otherwise(i)).withColumn("text", F.substring("text", 1, 400))
    rows = sharding.shard_documents(hot).collect()
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r.size
    assert len(rows) == big.count() and len(load) == 16 and max(load.values()) < 1.02 * min(load.values())
    assert collections.Counter((r.shard, r.slot) for r in rows) == collections.Counter((k, n) for k in range(16) for n in range(sum(r.shard == k for r in rows)))


def test_sharding_brute_force(docs, awkward):
    for df in (docs, awkward):
        rows = collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in sharding.shard_documents(df).collect())
        assert rows == collections.Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode()), "bytes", None) for d in df.collect())


def test_rebalance_moves_only_what_it_must(spark):
    sizes = spark.createDataFrame([(i, 10 + i % 7, 1) for i in range(200)], "vslot int, bytes long, rows long")
    one = sharding.first_map(sizes, 4)
    grown = sharding.rebalance(one, sizes, 5)
    before, after = ({r.vslot: r.shard for r in m.collect()} for m in (one, grown))
    assert set(after) == set(before) and {r.version for r in grown.collect()} == {2}
    moved = [v for v in before if before[v] != after[v]]
    assert all(after[v] == 4 for v in moved) and 30 <= len(moved) <= 50


# Decontamination


def test_items_in_documents(spark, sf_dir, docs):
    items = table(spark, sf_dir, "benchmark")
    want = set()
    for i in items.collect():
        own = shingles(i.text, 5)
        for d in docs.collect():
            n = len(own & shingles(d.text, 5))
            if own and 100 * n >= 80 * len(own):
                want.add((d.doc_id, i.item_id, len(own), n))
    for limit in (decontaminate.BROADCAST_LIMIT, 0):
        got = {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in decontaminate.find_items(docs, items, broadcast_limit=limit).collect()}
        assert got == want


def test_short_and_altered_items(spark):
    long_text = " ".join(f"t{i}" for i in range(5000))
    items = spark.createDataFrame([(1, "T10 t11\tt12 t13 t14 t15 t16 t17 t18 t19 t20"), (2, "two words"), (3, None), (4, ""), (None, "t40 t41 t42 t43 t44 t45"), (5, "t50 t51 t52 t53 t54 t55 t56 t57 t58 XX")], "item_id long, text string")
    df = spark.createDataFrame([(1, long_text), (2, "some two words here"), (3, None), (None, "t10 t11 t12 t13 t14 t15 t16 t17 t18 t19 t20")], "doc_id long, text string")
    for limit in (1000, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_items(df, items, broadcast_limit=limit).collect()}
        assert got == {(1, 1), (1, None), (1, 5), (2, 2), (None, 1)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, items).collect()} == {3, None}


# Classifier


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = [r for r in queries.op9_quality_scores(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) >= 0.9


def test_non_negative_risk_without_labels_of_the_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (600, 3)), rng.normal(4, 1, (200, 3))
    model = quality_classifier.train(good[:300], np.concatenate([good[300:], bad]), 0.6)
    assert (model.score(good) >= 0.3).mean() > 0.9 and (model.score(bad) < 0.3).mean() > 0.7


def test_risk_gradient_brute_force():
    """Value and gradient of both risk terms against the formula, by differences."""
    rng = np.random.default_rng(7)
    p, u = (np.array([[f * 4 + rng.integers(4) for f in range(3)] for _ in range(n)]) for n in (30, 50))
    theta, prior = rng.normal(size=13), 0.6
    loss = lambda t, rows, sign: np.mean([np.log1p(np.exp(-sign * (sum(t[k] for k in row) + t[-1]))) for row in rows])
    terms = lambda t: (prior * loss(t, p, 1), loss(t, u, -1) - prior * loss(t, p, -1))
    *values, grad_p, grad_n = quality_classifier.risk_terms(theta, p, u, prior)
    assert np.allclose(values, terms(theta))
    for k in range(13):
        step = np.zeros(13)
        step[k] = 1e-5
        up, down = terms(theta + step), terms(theta - step)
        assert np.allclose([(up[0] - down[0]) / 2e-5, (up[1] - down[1]) / 2e-5], [grad_p[k], grad_n[k]], atol=1e-7)


def test_without_positives_nothing_is_decided(spark, docs):
    labels = spark.createDataFrame([(i, 0, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    assert {r.score for r in quality_classifier.score(docs, model).collect()} == {0.5} and quality_classifier.keep_good(docs, model).count() == docs.count()


def test_classifier_uses_unlabelled_documents_and_no_label_0(spark):
    """Junk that carries no label is learnt as junk, and labels 0 change nothing; the prior is that of all documents."""
    rng = random.Random(1)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    prose = lambda: " ".join(word(rng.randrange(2, 9)) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randrange(40, 90)))
    junk = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(40, 90)))
    rows = [(i, junk() if i % 10 < 4 else prose()) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = [(i, 1, 0) for i, _ in rows if i % 10 >= 4 and i % 3 == 0]
    noise = [(i, 0, 0) for i, _ in rows if i % 10 >= 4 and i % 3 == 1]  # no junk has a label
    models = [quality_classifier.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (good, good + noise)]
    assert all(abs(m.prior - 0.6) < 0.1 for m in models)
    predicted = [{r.doc_id: r.predicted for r in quality_classifier.score(df, m).collect()} for m in models]
    assert predicted[0] == predicted[1]
    assert sum(predicted[0][i] == (i % 10 >= 4) for i, _ in rows) / len(rows) > 0.97


def test_unlabelled_sample_is_bounded(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.training_rows(docs, labels, 40).collect()
    assert sum(r.n_positive for r in rows) <= 40 and 15 <= sum(r.unlabelled for r in rows) <= 70


# Packing


def plain_fill(rest, length, capacity):
    """Tokens of a bin that takes the piece ``length`` again and again, then always the longest that fits."""
    room, left = capacity, collections.Counter(rest)
    while left[length] and room >= length:
        left[length] -= 1
        room -= length
    for n in sorted((n for n in left if n < length), reverse=True):
        while left[n] and n <= room:
            left[n] -= 1
            room -= n
    return capacity - room


def plain_best_fit(lengths, sizes, capacities, cost, optimistic):
    """One piece at a time; the bins' contents and the total cost after downsizing."""
    bins, rest = [], collections.Counter(lengths)
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            fill = lambda c: plain_fill(rest if optimistic else {n: rest[n]}, n, c)  # noqa: E731, B023
            b = [min((c for c in sizes if c >= n), key=lambda c: (cost(c) / fill(c), c)), 0]
            bins.append(b)
        b[1] += n
        rest[n] -= 1
    return sorted(b[1] for b in bins), sum(cost(min(c for c in capacities if c >= b[1])) for b in bins)


def test_plan_is_the_cheapest_of_all_mixes():
    rng, capacities, several = random.Random(2), (16, 32, 64), 0
    cost = lambda c: c + c * c / 100 + 4
    for _ in range(150):
        high = rng.choice([8, 20, 64])
        lengths = [rng.randrange(1, high + 1) for _ in range(rng.randrange(1, 120))]
        places, bins, (sizes, optimistic) = packing.plan(collections.Counter(lengths), capacities, cost)
        used = sorted(u for at, end, u, _ in bins for _ in range(end - at))
        total = sum((end - at) * cost(c) for at, end, _, c in bins)
        own, own_total = plain_best_fit(lengths, sizes, capacities, cost, optimistic)
        assert used == own and abs(total - own_total) < 1e-6
        mixes = [m for k in (1, 2, 3) for m in itertools.combinations(capacities, k) if m[-1] >= max(lengths)]
        assert total <= min(plain_best_fit(lengths, m, capacities, cost, o)[1] for m in mixes for o in (True, False)) + 1e-6
        assert all(c == min(x for x in capacities if x >= u) for _, _, u, c in bins)
        assert sum(last - first for _, first, last, *_ in places) == len(lengths)
        several += len(sizes) > 1
    assert several > 30


def test_packing_whole_table(docs, awkward):
    capacities_used = set()
    for df in (docs, awkward):
        rows = packing.pack(df).collect()
        longest, want = max(packing.CAPACITIES), collections.Counter()
        for d in wordpiece.token_counts(df).collect():
            n = d.n_tokens + 1
            want.update((d.doc_id, k, k * longest, min(longest, n - k * longest)) for k in range(-(-n // longest)))
        assert collections.Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in rows) == want
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.bin_id].append(r)
        for v in bins.values():
            at = 0
            for r in sorted(v, key=lambda r: r.bin_offset):
                assert r.bin_offset == at
                at += r.n_tokens
            assert {r.bin_used for r in v} == {at}
            assert {r.bin_capacity for r in v} == {min(c for c in packing.CAPACITIES if c >= at)}
            capacities_used.add(v[0].bin_capacity)
    assert len(capacities_used) > 1


def test_sequences_hold_the_ids_of_their_documents(spark, awkward, tmp_path):
    manifest = tokenfiles.write(awkward, f"file://{tmp_path}/t")
    whole = {r.start: r for r in tokenfiles.read(manifest).collect()}
    found, ids_of = collections.Counter(), collections.defaultdict(list)
    for b in packing.pack_files(manifest, (64, 256, 1024)).collect():
        ids = np.frombuffer(b.ids, "<u4")
        assert len(ids) == b.bin_used <= b.bin_capacity and sum(p.n_tokens for p in b.pieces) == b.bin_used
        for p in b.pieces:
            ids_of[p.doc_id].append((p.start, ids[p.offset : p.offset + p.n_tokens].tobytes()))
            found[p.doc_id] += p.n_tokens
    want = collections.Counter()
    for r in whole.values():
        want[r.doc_id] += r.n_tokens
    assert found == want
    assert b"".join(x for _, x in sorted(ids_of[5])) == next(r.ids for r in whole.values() if r.doc_id == 5)


# All operators: awkward rows and empty tables


def test_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, "one line only here second"), (2, "not in any of them")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = awkward.collect()
    near = neardup.near_duplicates(awkward, 2).collect()
    assert len(near) == len(rows) and sum(r.doc_id is None for r in near) == 2
    assert {r.doc_id: r.component_id for r in near if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    verdicts = quality_rules.quality_rules(awkward).collect()
    assert collections.Counter(r.doc_id for r in verdicts) == collections.Counter(r.doc_id for r in rows)
    assert {r.doc_id for r in verdicts if r.n_words == 0} == {1, 2, 4, None} and all(r.base_failed and not r.kept for r in verdicts if r.n_words < 50)
    counted = collections.Counter((r.doc_id, r.n_words) for r in wordpiece.token_counts(awkward).collect())
    assert counted == collections.Counter((r.doc_id, len(plain_words(r.text))) for r in rows)
    assert [(r.doc_id, r.item_id, r.containment) for r in decontaminate.find_items(awkward, items).collect()] == [(7, 1, 1.0)]
    model = quality_classifier.fit(awkward, labels)
    scores = quality_classifier.score(awkward, model).collect()
    assert collections.Counter(r.doc_id for r in scores) == collections.Counter(r.doc_id for r in rows) and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id in (1, 2)}) == 1 and not any(r.held_out for r in scores if r.doc_id is None)
    left = collections.Counter((r.doc_id, r.text) for r in neardup.keep_one(awkward).collect())
    assert left == collections.Counter((r.doc_id, r.text) for r in rows if r.doc_id != 6)


def test_awkward_token_files(spark, awkward, tmp_path):
    """Nulls in front, then by doc_id and text; each row by itself, the very long one in a frame of its own."""
    from tokenizers import Tokenizer

    manifest = tokenfiles.write(awkward, f"file://{tmp_path}/t", frame_ids=64)
    model, at, want = Tokenizer.from_file(tokenfiles.default_tokenizer()), 0, []
    for r in sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r)[:4] for r in tokenfiles.read(manifest).collect()), key=lambda r: r[1])
    assert got == want
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith("_attempt")]


def test_empty_tables(spark, empty, tmp_path):
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tokenfiles.read(tokenfiles.write(empty, f"file://{tmp_path}/e")).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert html_text.extract(pages).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert wordpiece.token_counts(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert decontaminate.find_items(empty, items).count() == 0
    assert quality_classifier.score(empty, quality_classifier.fit(empty, labels)).count() == 0
    assert packing.pack(empty).count() == 0


# Pipeline and SQL


def test_pipeline_stage_by_stage(spark, sf_dir, docs):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    d, out = docs, []
    from quarry.llm.shared import cut

    for name, f in cp.STAGES:
        d = cut(f(spark, d, sf_dir), "stage")
        out.append(d)
    kept = [[(r.doc_id, r.text) for r in x.collect()] for x in out[:4]]
    assert all(x.columns == cp.COLUMNS for x in out[:4])
    assert sorted(brute_lines(kept[0])) == sorted(kept[1])
    groups = brute_components(kept[1], 5)
    assert {i for i, _ in kept[2]} == {i for i, (_, c) in groups.items() if i == c}
    items = [shingles(r.text, 5) for r in table(spark, sf_dir, "benchmark").collect()]
    dirty = {i for i, t in kept[2] if any(100 * len(s & shingles(t, 5)) >= 80 * len(s) for s in items if s)}
    assert {i for i, _ in kept[3]} == {i for i, _ in kept[2]} - dirty
    assert {r.doc_id for r in out[4].collect()} == {i for i, _ in kept[3]}


def test_constants_of_the_outlier_rule():
    """By adding up the chi-square density: the quantile, the factor of a truncated covariance, the share beyond the limit."""
    import math

    def below(x, k, n=200_000):
        at = (np.arange(n) + 0.5) * x / n
        return float((at ** (k / 2 - 1) * np.exp(-at / 2)).sum() * x / n / (2 ** (k / 2) * math.gamma(k / 2)))

    low, high = 0.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, quality_rules.DIM) < quality_rules.SHARE else (low, middle)
    assert abs(quality_rules.SHARE / below(low, quality_rules.DIM + 2) - quality_rules.CONSISTENCY) < 1e-5
    assert abs((1 - below(quality_rules.LIMIT, quality_rules.DIM)) / 3.8e-7 - 1) < 0.02


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(name, spark, sf_dir):
    from compare import connect, difference

    assert difference(spark, connect(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) == ""


def test_duckdb_is_here():
    assert duckdb.__version__
