import functools
import hashlib
import itertools
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, common, exact, fingerprints, html, langid, lines, mixing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, fp long, host string, ids string, n long, score double, _range string, seat string, digest string"
CLASH = ("k", 1, 2, "h", "i", 3, 0.5, "r", "s", "d")


def docs(spark, rows):
    """(doc_id, text, lang, source) as documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *CLASH) for i, t, lang, src in rows], SCHEMA)


random.seed(7)
WORDS = ["river", "stone", "Über", "été", "mañana", "the", "of", "and", "light", "house", "tree", "sky", "漢字", "naïve", "été"]
prose = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
LONG = prose(60_000)
ODD = [
    (1, "Hello  World", "en", "a"), (2, "hello world", "en", "a"), (3, None, "en", None), (4, "", None, "a"), (5, " \t\n", "de", "b"), (6, LONG, "fr", "b"), (7, LONG + " x", "fr", "b"), (8, "ＨＥＬＬＯ world", "en", "a"),
    (9, "été", "fr", "a"), (10, "été", "fr", "a"), (11, "12345 !!", "en", "a"), (12, "hello world", "en", "a"), (12, "hello world", "en", "a"), (13, "a", "en", "a"), (14, "\x00\x1fodd line", "en", "a"), (15, "🎉 party 🎉", "en", "c"),
]


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(t.replace("\x1c", " ").split()) if t else ""


def digest(t):
    seeds = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) for k in (1, 2)]
    return "".join(f"{xxhash.xxh64_intdigest(canonical(t).encode(), s):016x}" for s in seeds)


def test_fingerprints_by_brute_force(spark):
    rows = [r for r in ODD if r[0] != 14]
    got = fingerprints.edit_pairs(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        want.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited), float(digest(t) == digest(edited)), float(digest(t) == digest(nxt))))
    assert sorted(map(tuple, got)) == sorted(want)
    groups = fingerprints.fingerprints(docs(spark, rows)).where("doc_id in (1, 2, 8, 12)").select("fingerprint").distinct().count()
    assert groups == 1


def test_fingerprints_many_ranges_ties_and_null_ids(spark):
    rows = [(i * 3, f"text {i} " * 9, "en", "a") for i in range(300)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edit_pairs(docs(spark, rows).repartition(7)).collect()}
    for i in range(300):
        t, nxt = rows[i][1], rows[i - 1][1]
        k = len(t) // 3
        assert got[i * 3] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    assert fingerprints.edit_pairs(docs(spark, [(None, "a", "en", "a"), (None, "b", "en", "a"), (5, "c", "en", "a")])).count() == 3
    assert fingerprints.edit_pairs(docs(spark, [])).count() == 0
    assert fingerprints.edit_pairs(docs(spark, [(1, "alone", "en", "a")])).first().near_next == 1.0


def test_collision_is_lengthened(spark):
    found = fingerprints.resolved(F.lit("d"), F.lit("d"), F.lit("text"))
    assert spark.range(1).select(found.alias("x")).first().x == "d-" + hashlib.sha512(b"text").hexdigest()
    assert fingerprints.collided(docs(spark, ODD), common.whole()).count() == 0


def test_collisions_of_texts_and_edited_texts(spark, monkeypatch):
    """With a digest of three values, fingerprints still are equal for equal canonical texts only, edited ones too."""
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.pmod(F.xxhash64(canon), F.lit(3)).cast("string"))
    rows = [(i, f"text {i % 17} of mine" + " and more" * (i % 3), "en", "a") for i in range(60)] + [(100, "ab", "en", "a"), (101, None, "en", "a")]
    got = {r.doc_id: r for r in fingerprints.edit_pairs(docs(spark, rows).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    by_print, by_text = defaultdict(set), defaultdict(set)
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        for text, name in ((t, got[r[0]].fingerprint), (edited, got[r[0]].edited_fingerprint)):
            by_print[name].add(canonical(text))
            by_text[canonical(text)].add(name)
        assert got[r[0]].near_next == float(canonical(t) == canonical(nxt)) and got[r[0]].near_edited == float(canonical(t) == canonical(edited))
    assert all(len(v) == 1 for v in by_print.values()) and all(len(v) == 1 for v in by_text.values())


def test_many_rows_without_an_id(spark):
    rows = [(None, f"row {i} " * 6, "en", "a") for i in range(200)] + [(i, f"text {i} " * 5, "en", "a") for i in range(20)]
    got = fingerprints.edit_pairs(docs(spark, rows).repartition(4)).collect()
    assert len(got) == 220 and sum(r.doc_id is None for r in got) == 200
    # Each text is followed by exactly one other: all heads that edited texts borrow are different rows'.
    assert len({r.edited_sha256 for r in got}) == 220


def brute_fingerprint(t):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(pairs):
    """Smallest member reachable, by (id, fingerprint)."""
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(pairs, 2):
        if (x ^ y).bit_count() <= 4:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: find(i) for i in root}


def test_simhash_by_brute_force(spark):
    rows = [r for r in ODD if r[0] < 10]
    base = prose(400).split()
    for i in range(60):
        words = list(base)
        for _ in range(i % 5):
            words[random.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(words), "en", "a"))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == classes(list(fps.items()))
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark, [(None, "a b", "en", "a"), (2, "a b", "en", "a"), (2, "a b", "en", "a")])).select("component_id").distinct().count() == 1


def test_keep_one_keeps_one_row_of_each_class(spark):
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(1, a, "en", "s"), (None, a, "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (None, c, "en", "t"), (7, a, "en", "s"), (7, d, "en", "s"), (9, LONG, "en", "s"), (9, LONG, "en", "s"), (9, LONG, "fr", "s")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (None, b), (None, c), (7, d), (9, LONG)], key=repr)


@pytest.mark.parametrize("dense", [1024, 3])
def test_simhash_links_dense_lists(spark, dense):
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(-(2**62), 2**62, 150)}
    for x in list(values)[:20]:
        for _ in range(12):
            y = x
            for b in rng.choice(62, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            values.add(y)
    values = sorted(values)
    got = common.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), dense))
    roots = {r.node: r.root for r in got.collect()}
    want = classes([(v, v & (2**64 - 1)) for v in values])
    assert {v: roots.get(v, v) for v in values} == want


def test_components_chain_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, None), (6000, 6000), (3, 2), (3, 2)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_by_brute_force_with_spilling(spark):
    rows = ODD + [(100 + i, f"  body {i % 40}\t{'x' * (i % 40) * 50} ", "en", "a") for i in range(400)]
    for table_bytes in (exact.TABLE_BYTES, 4_000):
        got = exact.exact_dedup(docs(spark, rows).repartition(3), table_bytes=table_bytes).collect()
        groups = defaultdict(list)
        import re

        norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        for r in rows:
            groups[norm(r[1])].append(r[0])
        want = sorted((r[0], min(g := groups[norm(r[1])]), len(g), r[0] == min(g), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
        assert sorted(map(tuple, got)) == want
    assert exact.exact_dedup(docs(spark, [])).count() == 0
    nulls = exact.exact_dedup(docs(spark, [(None, "a", "en", "a"), (None, "b", "en", "a"), (3, "a", "en", "a")])).collect()
    assert sorted((r.doc_id is None, r.group_size) for r in nulls) == [(False, 2), (True, 1), (True, 2)]


def test_grace_recursion():
    rows = [(xxhash.xxh3_64_intdigest(c), c, i, 1, [i]) for i in range(900) for c in [f"{i % 300}".encode() * 40]]
    got = {c: (least, n, sorted(keys)) for c, least, n, keys in exact.grace(iter(rows), 3_000)}
    assert len(got) == 300 and all(n == 3 and keys == [least, least + 300, least + 600] for least, n, keys in got.values())
    same_hash = [(5, f"c{i % 4}".encode() * 100, i, 1, []) for i in range(40)]
    assert sorted((c[:2], n) for c, _, n, _ in exact.grace(iter(same_hash), 50)) == [(f"c{i}".encode(), 10) for i in range(4)]


def test_bpe_is_the_ranks_encoding(spark):
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_vocabulary())
    own = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] for r in ODD] + ["a" * n for n in (1, 7, 300)] + ["　 \x1c\x85 x", "<|endoftext|>", "don't I'LL", "\r\n\r\n  x", "𝔘𝔫𝔦 ́"] + ["".join(random.choice("aeéß的ñ \n\tTh.1 ") for _ in range(60)) for _ in range(300)]
    frame = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.encode(frame, offsets=True).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert (got[i].ids, got[i].n_tokens) == (ids, len(ids))
        if t and len(t) < 100:
            for token, a, b in zip(ids, got[i].starts, got[i].ends):
                assert own.decode_single_token_bytes(token) in t[a:b].encode()
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(frame)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    sums = {r.doc_id: r for r in bpe.round_trip(frame).collect()}
    for i, t in enumerate(texts):
        assert sums[i].ids_sha256 == hashlib.sha256(",".join(map(str, own.encode_ordinary(t or ""))).encode()).hexdigest()
        assert sums[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark, [])).count() == 0 and bpe.encode(docs(spark, [])).columns[-2:] == ["n_tokens", "ids"]


def test_split_characters_decode_whole():
    ranks = bpe.read_ranks(bpe.default_vocabulary())
    tokens = [None] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    codec = bpe.Codec(bpe.build(ranks), tokens, bpe.default_pattern())
    (ids,) = codec.encode(["𓀀é"])
    assert len(ids) > 2 and codec.decode(ids).decode() == "𓀀é" and codec.offsets(ids)[-1][1] == 2
    assert codec.decode(np.arange(len(tokens), dtype=np.int32)) == b"".join("\ufffd".encode() if t is None else t for t in tokens)
    assert codec.offsets(ids[:0]) == [] and codec.decode(ids[:0]) == b""


def test_decoding_ids_without_a_token(spark):
    frame = spark.createDataFrame([(1, [10**9, -1], "x"), (2, None, "x"), (3, [], "x"), (4, [None], "x")], "doc_id long, ids array<int>, decoded string")
    assert {r.doc_id: r.decoded for r in bpe.decode(frame).collect()} == {1: "\ufffd\ufffd", 2: None, 3: "", 4: "\ufffd"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><header><p>The Site of Sites and more words here</p></header>
<div class="cookie-banner">We use cookies on this site to help you more</div><article><h1>Head &amp; line</h1><p>One   two<br>three <b>bold</b>.</p><p>Short.</p><script>var x = "</p>";</script>
<form><p>Mail me</p></form></article><div class="ad">Buy now and save a lot of money today</div><section id="comments"><p>I liked this text a lot, thank you for it</p></section><footer>&copy; me</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>unclosed <b>text that goes on for quite a few words without an end"), (5, "u", "<<<>>> <div"), (6, "u", "<article>" + "<p>long words here.</p>" * 5000), (1, "u", PAGE)]
    frame = spark.createDataFrame([(*r, "clash", 3, "x") for r in rows], "page_id long, url string, html string, text string, n_chars long, words string")
    got = [r for r in html.extract(frame).collect()]
    assert [r.text for r in got if r.page_id == 1] == ["Head & line\nOne two three bold.\nShort."] * 2
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and all(r.n_chars == len(r.text) and r.words == "x" for r in got)
    assert next(r for r in got if r.page_id == 6).text == "\n".join(["long words here."] * 5000)
    assert html.extract(frame.limit(0)).count() == 0


def test_html_marks_of_single_blocks_and_of_wrappers():
    tree = html.trained()
    page = (
        '<body><div class="layout has-sidebar"><article><h1>A head line</h1><p>The first paragraph has quite a few words in it, as they do.</p><p class="advert">Buy a new hat from us before the end of this week or never.'
        '<p>The second one follows an open advert and is text.</p><ul><li class="comment">I do not agree with any of this at all.<ul><li>nested</li></ul></li><li>an item</li></ul><h3 class="related">Read these too</h3>'
        '<p hidden>Nobody sees this line of words.</p><p>A line <b>goes</b> on. <span class="ad">Half <span>price</span> hats here.</span></p><p>It ends with <a href="/x">a link to words</a> and more.</p><a class="share" href="/s">Share it with all</a></article></div>'
        '<div id="comments"><article><p>A comment in an article of its own, as some sites have them, is none.</p></article></div></body>'
    )
    want = ["A head line", "The first paragraph has quite a few words in it, as they do.", "The second one follows an open advert and is text.", "an item", "A line goes on.", "It ends with a link to words and more."]
    assert html.main_text(page, tree).split("\n") == want
    found = html.read(page)

    def named(mark):
        return mark >= 0 and (found.named[mark] or named(found.around[mark]))

    assert [named(b.mark) for b in found.blocks] == [b.text not in want for b in found.blocks]


def test_html_ordinary_pages():
    tree = html.trained()
    body = "<h1>A head line</h1><p>The first paragraph has quite a few words in it, as they do.</p><p>Short.</p>"
    want = "A head line\nThe first paragraph has quite a few words in it, as they do.\nShort."
    pages = [
        f"<html><head><meta charset=utf-8><title>T</title><body><nav><a href=/>Home</a></nav><article>{body}</article>",  # a head without an end
        f"<head><title>T</title><article>{body}</article><footer>We are here.</footer>",
        f'<body><form id="aspnetForm"><nav><a href="/">Home</a></nav><article>{body}</article></form><footer>Made by the two of us in spring.</footer></body>',
        f'<body><form id="aspnetForm">{body}</form></body>',
        f'<body><div class="page-header-content article-with-comments">{body}</div></body>',
        f'<body><nav><a href="/">Home</a> <a href="/n">All news</a></nav><div class="page-header-content article-with-comments">{body}</div></body>',
        f'<body><article>{body}<p class="advert">Buy a new hat from us now.</p><p id="cookie-note">We use cookies.</p></article></body>',
        f"<body><article>{body}</article><aside><p>Other things that we wrote in the past year.</p></aside></body>",
        f'<body><article class="post comments-open">{body}</article><section class="comments"><article class="comment"><p>I do not think so at all.</p></article></section></body>',
        f"<p>{body}",
        f"<a href=/x><article>{body.replace('<p>', '<p><!-- <p>x</p> -->')}</article></a>",
        f"<article><h1><a href='/self'>A head line</a></h1>{body[body.index('<p>'):]}</article><div><a href=/m>more</a></div>",
    ]
    assert [html.main_text(p, tree) for p in pages] == [want] * len(pages)
    assert html.main_text("<article>1 < 2 &amp; 3 > 2<br>a&nbsp;b</article>", tree) == "1 < 2 & 3 > 2 a b"
    assert html.main_text('<article><p title="a > b">x y</p><p title=\'"\'>z</p></article>', tree) == "x y\nz"
    assert html.main_text("<article><p>before</p><script>var a = '</p>';", tree) == "before"
    assert html.main_text("<article><svg><p>kept for want of an end</p>", tree) == "kept for want of an end"


def test_html_reading_takes_time_in_proportion():
    import time

    tree = html.trained()
    for unit in ("<a '", '<a ="x>" ', "<a href='", "<div class='ad'>", "<li>", "<p><b class=ad>", "<!--", "<svg>", "</li>", "<", "<hr>", "<a =", "<ul><li></li>", "&"):
        page = "<body>" + unit * (1_000_000 // len(unit))
        start = time.process_time()
        html.main_text(page, tree)
        assert time.process_time() - start < 4, unit
    deep = "<div>" * 100_000 + "<p>deep words</p>" + "</div>" * 100_000 + "<p>after</p>"
    assert html.main_text(deep, tree) == "deep words\nafter"


#: Pages for measuring, of which the tree has seen none; blocks that start with "=" are main text.
UNSEEN = (
    '<body><div class="masthead"><a href="/">Harbour News</a></div><ul class="nav"><li><a href="/a">Ships</a></li><li><a href="/b">Tides and winds</a></li></ul><article><h1>=A whale in the harbour</h1><p>=A young whale swam into the harbour on Tuesday and stayed for three days among the boats.</p><p>=Children came.</p><p>=It left with the spring tide, after the harbour master had stopped all engines for an hour at night.</p></article><div class="related"><a href="/1">Seals on the quay</a> <a href="/2">The last fishing boat</a></div><footer><p>Harbour News, printed on the quay.</p></footer></body>',
    '<body><nav><a href="/">Recipes</a></nav><main><h1>=Plum cake</h1><p>=Halve the plums and take out the stones, then let them stand with sugar for an hour.</p><ul><li>=one pound of plums</li><li>=flour</li><li>=two eggs</li></ul><p>=Bake until brown, which takes three quarters of an hour in most ovens, or a little more in old ones.</p></main><aside><p>Get our letter each week with new recipes.</p></aside><section id="comments"><p>Mine was still wet in the middle after an hour.</p><p>Lovely!</p></section></body>',
    '<body><div><a href="/">Home</a> <a href="/guides">Guides</a> <a href="/shop">Shop</a></div><div><h1>=Sharpening a plane</h1><p>=A plane iron is sharp when it takes a shaving from end grain without tearing, and not before that.</p><p>=Start on the coarse stone.</p><p>=Keep the angle the same on each stroke, which a guide makes easy and which the hand learns in a winter.</p><p>=Then the fine one.</p></div><div><a href="/next">Next guide</a> <a href="/prev">The guide before</a></div></body>',
    '<head><title>Snow</title><body><div class="cookie-bar"><p>This site keeps small files on your machine.</p></div><div id="main-content"><h2>=Snow on the pass</h2><p>=The pass was closed on the second of October, earlier than in any year since the road was built.</p><p>=Two lorries had to be dug out.</p></div><div class="share-links"><a href="/t">Tell a friend</a></div></body>',
    '<body><form action="/all"><header><p>The county library</p></header><div><h1>=Books by post</h1><p>=Readers who cannot come to the library get books by post, four at a time, for as long as they need them.</p><p>=It costs nothing.</p><p>=Write down what you like to read and what you do not, and a librarian will choose for you each month.</p></div><footer><p>Open on weekdays.</p></footer></form></body>',
    '<body><p>=Just a text without anything around it, as some very old pages are, with one long paragraph.</p><p>=And a short one.</p><p>=And at the end there is one more that says where it was written, and in which year, and by whom.</p></body>',
    '<body><ul><li><a href="/1">First</a></li><li><a href="/2">Second</a></li><li><a href="/3">Third</a></li></ul><p>=The paragraphs of this page stand right in its body, after a list of links and before another one.</p><p>=There are two.</p><ul><li><a href="/x">About</a></li><li><a href="/y">Contact us here</a></li></ul></body>',
)


def measured(tree, pages):
    """(precision, recall) of main text by words."""
    right = given = there = 0
    for page in pages:
        found = html.read(page)
        for b, row in zip(found.blocks, html.features(found).tolist()):
            main, said = b.text.startswith("="), html.is_main(tree, row)
            right, given, there = right + b.words * (main and said), given + b.words * said, there + b.words * main
    return right / given, right / there


def test_html_tree_on_its_table_and_on_unseen_pages():
    x, y = html.labelled()
    tree = html.trained()
    assert np.mean([html.is_main(tree, r) == bool(t) for r, t in zip(x.tolist(), y)]) > 0.95
    precision, recall = measured(tree, UNSEEN)
    assert precision > 0.97 and recall == 1.0, (precision, recall)
    # Without any name, role or telling tag, by word counts and links alone.
    precision, recall = measured(tree, [html.bare(p) for p in UNSEEN])
    assert precision > 0.8 and recall > 0.97, (precision, recall)
    # Inside an article nothing goes but what is marked.
    rng = np.random.default_rng(0)
    for _ in range(3000):
        row = [rng.integers(1, 60), rng.choice([0, 0.3, 1]), rng.integers(0, 60), rng.choice([0, 0.3, 1]), rng.integers(0, 60), rng.choice([0, 0.3, 1]), 0, 0, 1, rng.uniform(0.1, 1)]
        assert html.is_main(tree, row), row
    used = set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(html.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert {"words", "links", "words_before", "words_after"} <= used


def test_html_extraction_by_brute_force(spark):
    """On the test pages, whose articles hold all main text, against plain cutting."""
    import html as entities
    import re

    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = re.split(r"</?(?:p|h1|li|ul|div)[^>]*>", article)
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in parts]
        assert got[r.page_id] == "\n".join(x for x in lines if x), r.page_id


def test_langid_accuracy_and_edges(spark, tmp_path):
    vocabulary = {"en": "the and of with from this that river stone".split(), "de": "der und mit von das nicht über straße haus".split(), "fr": "le et avec pour dans été maison rivière".split()}
    rows = [(i, " ".join(random.choice(vocabulary[lang]) for _ in range(12)), lang, "a") for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "123 !?", "en", "a"), (1003, LONG, None, "a"), (1004, "漢字" * 100, None, "a"), (None, "the river", None, "a"), (5, rows[5][1], "fr", "a")]
    frame = docs(spark, rows)
    got = langid.identify(frame).withColumn("out", langid.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 240)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 0 and kept.where("doc_id < 240").count() == 241
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, [(1, "word", None, "a")])).collect()} == {"und"}


def test_langid_rejects_what_is_in_no_learned_language(spark):
    import math

    d = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rng = random.Random(3)
    foreign = [
        "Вчера вечером мы долго гуляли по берегу реки и говорили о том, что будет с нами через несколько лет. " * 8,
        "Χθες το βράδυ περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και μιλήσαμε για όσα θα γίνουν στα επόμενα χρόνια. " * 8,
        "昨天晚上我们沿着河边走了很久，谈论几年以后我们会怎么样，城市里的灯光照在水面上，风很轻。" * 8,
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(3, 14))) for _ in range(200)),
    ]
    more = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    clean = d.where("length(text) > 400 and lang is not null")
    kept = langid.keep_identified(clean.unionByName(more)).collect()
    assert not [r for r in kept if r.doc_id >= 10_000_000]
    assert len(kept) >= 0.98 * clean.count()
    x = np.array([0.25, 1.0, 7.5, 300.0, 1e6])
    assert np.allclose(langid._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-8)


def test_langid_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    table = np.array([[0.1], [0.2], [0.05], [0.15], [0.2], [0.1], [0.1], [1e-7]])
    known = langid.Pieces(pieces)

    def brute(s):
        if not s:
            return 1.0
        return sum((table[pieces.index(s[:k]), 0] if s[:k] in pieces else 1e-7 if k == 1 else 0.0) * brute(s[k:]) for k in range(1, len(s) + 1))

    brute = functools.lru_cache(None)(brute)
    words = ["ab", "abba", "zab", "a", "abbaz" * 6, "abab" * 9, "ba" * 20 + "b"]
    want = [np.log(brute("▁" + w)) for w in words]
    assert np.allclose(langid.forward(known.lattice(words), table)[:, 0], want)
    # A run of letters of any length is summed whole; nothing depends on which other words are there.
    assert np.allclose(langid.forward(known.lattice(words + ["ab" * 3000]), table)[:-1, 0], want)
    assert -1e5 < langid.forward(known.lattice(["ab" * 3000]), table)[0, 0] < -3000
    for w in ("ab", "abba" * 10):
        uses = langid.expected(known.lattice([w]), table, np.array([[2.0]]))
        assert np.isclose((uses[:-1, 0] * [len(p) for p in pieces]).sum(), 2 * (len(w) + 1))


def test_langid_plain_and_logarithmic_passes_agree(monkeypatch):
    known = langid.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    table = np.random.default_rng(1).random((8, 3)) / 10
    words, counts = ["ab", "abba", "zab", "a", "abbaz" * 6], np.arange(15.0).reshape(5, 3)
    plain = langid.forward(known.lattice(words), table), langid.expected(known.lattice(words), table, counts)
    monkeypatch.setattr(langid, "PLAIN", 0)
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    for a, b in zip(plain, (langid.forward(known.lattice(words), table), langid.expected(known.lattice(words), table, counts))):
        assert np.allclose(a, b)


def test_langid_words_keep_combining_marks():
    assert langid.words_of("हिन्दी में ภาษาไทย É e\u0301t 12 ²") == ["हिन्दी", "में", "ภาษาไทย", "é", "e\u0301t"]


def test_langid_by_brute_force(spark):
    """The query's languages and scores from its definition: one EM round over all segmentations, then their sums."""
    pieces = langid.read_pieces(langid.default_vocabulary())
    number = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))
    rng = random.Random(2)
    stock = {"aa": "the and river stone".split(), "bb": "der und fluss stein".split(), "cc": ["漢字仮名" * 12, "仮名"]}
    rows = [(i, " ".join(rng.choice(stock[lang]) for _ in range(rng.randint(1, 5))), lang if i % 7 else None, "a") for i in range(60) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(100, "the fluss 漢字", None, "a"), (101, None, None, "a")]

    def arcs(word):
        s = "▁" + word
        return len(s), [(k, k + n, number.get(s[k : k + n], -1)) for k in range(len(s)) for n in range(1, min(longest, len(s) - k) + 1) if n == 1 or s[k : k + n] in number]

    def passes(word, p):
        n, found = arcs(word)
        a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for x, y, i in sorted(found, key=lambda f: f[1]):
            a[y] += a[x] * p[i]
        for x, y, i in sorted(found, key=lambda f: -f[0]):
            b[x] += p[i] * b[y]
        return a, b, found

    start = 1 / (np.arange(len(pieces)) + 3.0)
    start = np.append(start / start.sum() * (1 - langid.UNKNOWN), langid.UNKNOWN)
    words = lambda t: langid.words_of(t)
    table = {}
    for lang in stock:
        uses = np.zeros(len(pieces) + 1)
        for i, t, own, _ in rows:
            if own == lang and zlib.crc32(str(i).encode()) % 5:
                for w in words(t):
                    a, b, found = passes(w, start)
                    for x, y, j in found:
                        uses[j] += a[x] * start[j] * b[y] / a[-1]
        uses = uses[:-1] + 0.1
        table[lang] = np.append(uses / uses.sum() * (1 - langid.UNKNOWN), langid.UNKNOWN)
    for blocks in (langid.BROADCAST_LANGUAGES, 2):  # all languages in one pass, and in two
        with pytest.MonkeyPatch.context() as m:
            m.setattr(langid, "BROADCAST_LANGUAGES", blocks)
            got = {r.doc_id: r for r in langid.identify(docs(spark, rows)).collect()}
        for i, t, _, _ in rows:
            if not words(t):
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            lp = {lang: sum(np.log(passes(w, p)[0][-1]) for w in words(t)) for lang, p in table.items()}
            best = max(lp, key=lp.get)
            assert got[i].lang_pred == best and np.isclose(got[i].score, 1 / sum(np.exp(v - lp[best]) for v in lp.values()), rtol=1e-9), (i, t)


def kneser_ney(texts, order):
    """The same model by its definition."""
    grams = {k: defaultdict(int) for k in range(1, order + 1)}
    for t in texts:
        padded = quality.PAD * (order - 1) + t
        for i in range(len(t)):
            grams[order][padded[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    off = {}
    for k, g in grams.items():
        c = [sum(v == i for v in g.values()) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        d = [1 - 2 * y * c[1] / c[0] if c[0] else 0.5, 2 - 3 * y * c[2] / c[1] if c[1] else 1.0, 3 - 4 * y * c[3] / c[2] if c[2] else 1.5]
        off[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def p(gram):
        k = len(gram)
        seen = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        take = lambda n: off[k][min(n, 3) - 1]
        if not seen:
            return p(gram[1:])
        total = sum(seen.values())
        weight = sum(map(take, seen.values())) / total
        own = (seen[gram] - take(seen[gram])) / total if gram in seen else 0.0
        return own + weight * (p(gram[1:]) if k > 1 else 1 / (len(grams[1]) + 1))

    return p


def by_fold(spark, texts):
    """The fold of each text, as the operator deals them."""
    return {r.t or "": r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.fold_of(common.whole("t")).alias("f")).collect()}


@pytest.mark.parametrize("cached, chunk", [(quality.CACHED, quality.CHUNK_CHARS), (0, 500), (30, 7)])
def test_quality_by_brute_force(spark, cached, chunk):
    """With everything known to the workers, with joins only, and with texts and the commonest letter cut over many chunks."""
    good = [(i, f"the {random.choice(['river', 'stone', 'house'])} of {random.choice(['light', 'sky'])} {i} and {'e' * (i % 9)} trees", "en", "a") for i in range(60)]
    odd = [(100, "XQ!! ZZ%% 77", "en", "a"), (101, None, "en", "a"), (102, "", None, "a"), (103, "the river of light", None, "a"), (104, "the river of light", None, "a"), (104, "the river of light", None, "a"), (105, "漢字🎉", "zh", "a"), (106, "eeee" * 200, "en", "a"), (None, "the sky", "en", "a")]
    rows = good + odd
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,), (999,), (3,)], "doc_id long")
    got = quality.classify(docs(spark, rows), trusted, order=3, cached=cached, chars=chunk).collect()
    assert len(got) == len(rows)
    folds = by_fold(spark, [r[1] for r in rows])
    models = {f: kneser_ney([r[1] for r in good if folds[r[1]] != f], 3) for f in (0, 1)}
    texts = dict((x[0], x[1]) for x in rows)
    perplexity = {}
    for r in got:
        t = texts[r.doc_id]
        if not t:
            assert r.perplexity is None and r.kept is False
            continue
        padded = quality.PAD * 2 + t
        p = models[folds[t]]
        want = np.exp(-sum(np.log(p(padded[i : i + 3])) for i in range(len(t))) / len(t))
        assert np.isclose(r.perplexity, want, rtol=1e-9), (r, want)
        perplexity[r.doc_id] = want
    limit = max(perplexity[i] for i in range(60))  # of 60 the quantile is the highest
    assert all(limit <= r.threshold <= limit * 1.0011 for r in got)
    assert all(r.kept == (perplexity.get(r.doc_id, 1e9) <= r.threshold) for r in got) and not any(r.kept for r in got if r.doc_id in (100, 105))


def test_windows_are_exact():
    rng = np.random.default_rng(4)
    for size in (3, 5000, 0x10000):  # alphabets whose windows fit a number, and not
        points = common.code_points("".join(map(chr, rng.integers(0xE000 if size > 5000 else 97, (0xE000 if size > 5000 else 97) + min(size, 0x1000) + (size > 5000) * 0x700, 4000))))
        for length in (1, 3, 7):
            keys = quality.windows(points, length)
            names = quality.grams_at(points, np.arange(len(keys)), length)
            assert len(set(keys.tolist())) == len(set(names)) == len(set(zip(keys.tolist(), names)))
    assert len(quality.windows(common.code_points("ab"), 3)) == 0
    pairs, times = np.array([0, 5, 7, 10**11]), np.array([1, 2, 3, 70_000])
    assert all(np.array_equal(x, y) for x, y in zip(quality.unpack(quality.pack(pairs, times)), (pairs, times)))


def test_quality_without_trusted_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.kept for r in quality.classify(docs(spark, [(1, "a text", "en", "a")]), none, order=3).collect()} == {True}
    assert quality.classify(docs(spark, []), none, order=3).count() == 0


def test_quality_small_languages_have_their_own_held_out_threshold(spark):
    rng = random.Random(5)
    french = "rivière maison forêt lumière pierre arbre ciel été neige pluie vent montagne vallée chemin pont village champ fleur oiseau nuage soleil lune étoile matin soir hiver automne printemps jardin porte".split()
    clean = lambda: " ".join(rng.choice(french) for _ in range(14))
    rows = [(i, f"the {rng.choice(['river', 'stone', 'house'])} of {rng.choice(['light', 'sky'])} and the {rng.choice(WORDS[5:9])} trees {i}", "en", "a") for i in range(400)]
    rows += [(1000 + i, clean(), "fr", "a") for i in range(40)] + [(2000 + i, clean(), "fr", "a") for i in range(40)] + [(3000, "XQ!! ZZ%% 77 @@ KJ", "fr", "a"), (3001, rows[0][1], None, "a")]
    trusted = spark.createDataFrame([(r[0],) for r in rows if r[0] < 2000], "doc_id long")
    got = quality.classify(docs(spark, rows), trusted, order=3).collect()
    limit = {r.lang: r.threshold for r in got}
    assert limit["fr"] > limit["en"] and limit[None] >= limit["en"]
    assert sum(r.kept for r in got if 2000 <= r.doc_id < 3000) >= 36 and not any(r.kept for r in got if r.doc_id == 3000)
    alone = quality.classify(docs(spark, rows[400:403]), spark.createDataFrame([(1000,)], "doc_id long"), order=3).collect()
    assert all(r.kept and r.threshold is None and r.perplexity is None for r in alone)


def test_lines_by_brute_force(spark):
    rows = [(i, "\n".join(["menu", f" body {i} ", "", "rare" if i == 3 else "x" * i, "menu" if i % 2 else "often" if i % 5 == 0 else f"u{i}"]), "en", "big" if i < 60 else "small") for i in range(70)]
    rows += [(100, None, "en", "big"), (101, "", "en", None), (102, "menu", "en", "big"), (102, "menu", "en", "big"), (103, LONG.replace(" ", "\n"), "en", "big")]
    rows += [(110 + i, f"twice\nown {i}", "en", "pair") for i in range(2)] + [(120 + i, f"thrice\nown {i}", "en", "three") for i in range(3)]
    got = {(r.doc_id, r.text): r for r in lines.drop_boilerplate(docs(spark, rows)).collect()}
    joined = {(r.doc_id, r.text): r for r in lines.drop_boilerplate(docs(spark, rows), broadcast_hosts=0).collect()}
    assert got == joined
    pages, counts = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        pages[s] += 1
        for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            counts[s, x] += 1
    gone = {k for k, n in counts.items() if n >= lines.LEAST_WITH and n > lines.RATIO * pages[k[0]]}
    for i, t, _, s in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone)
        r = got[i, kept]
        assert r.n_dropped == (0 if t is None else len(t.split("\n")) - sum((s, x.strip(" ")) not in gone for x in t.split("\n")))
    assert {("big", "menu"), ("small", "menu"), ("three", "thrice")} <= gone and ("pair", "twice") not in gone
    assert lines.clean_documents(docs(spark, rows)).columns == docs(spark, []).columns and lines.clean_documents(docs(spark, [])).count() == 0


def test_clean_documents_cleans_small_hosts(spark):
    rows = [(i, f"menu\nbody {i}", "en", "small") for i in range(5)] + [(10 + i, f"twice\nown {i}", "en", "pair") for i in range(2)] + [(20 + i, f"{'rare' if i < 3 else i}\ntext {i}", "en", "big") for i in range(40)]
    got = {r.doc_id: r.text for r in lines.clean_documents(docs(spark, rows)).collect()}
    assert all(got[i] == f"body {i}" for i in range(5)) and all(got[r[0]] == r[1] for r in rows[5:])


def fill(total, children):
    """Water filling by definition: shares by weight, those that fall short first."""
    out, left = {}, dict(children)
    while left:
        weights = sum(w for w, _ in left.values())
        short = {k: v for k, v in left.items() if v[1] * weights <= v[0] * total}
        if not short:
            return out | {k: min(s, int(w * total // weights)) if weights else 0 for k, (w, s) in left.items()}
        for k, (_, s) in short.items():
            out[k] = s
            total -= s
            del left[k]
    return out


def test_budgets_by_brute_force(spark):
    leaves = [("web", "en", "s1", 900), ("web", "en", "s2", 10), ("web", "de", "s1", 50), ("reference", "en", "s3", 40), ("reference", "fr", "s4", 1), ("reference", "en", "s5", 0)]
    plan = mixing.Plan(mixing.Weights(domain={"web": 1, "reference": 3}, lang={"en": 2, "de": 1}), share=80, epochs=2)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), plan).collect()}
    total = min(sum(x[3] for x in leaves) * 80 // 100, sum(x[3] for x in leaves) * 2)
    tree = defaultdict(lambda: defaultdict(dict))
    for d, lang, s, n in leaves:
        tree[d][lang][s] = n
    size = lambda x: x if isinstance(x, int) else sum(map(size, x.values()))
    want = {}
    for d, a in fill(total, {d: ({"web": 1, "reference": 3}[d], 2 * size(x)) for d, x in tree.items()}).items():
        for lang, b in fill(a, {k: ({"en": 2}.get(k, 1), 2 * size(x)) for k, x in tree[d].items()}).items():
            want |= {(d, lang, s): c for s, c in fill(b, {k: (x, 2 * x) for k, x in tree[d][lang].items()}).items()}
    assert got == want


def test_mixing_edges(spark):
    rows = [(i, prose(20), ("en", "de", None)[i % 3], f"src{i % 4}" if i % 9 else None) for i in range(120)] + [(200, None, "en", "src1"), (201, "", "en", "src1"), (202, "word", "en", "only")]
    frame = docs(spark, rows)
    for share, epochs in ((100, 2), (10, 1), (300, 3)):
        plan = mixing.Plan(mixing.Weights(domain={"web": 1, "reference": 1}), share=share, epochs=epochs)
        out = mixing.picks(frame, plan)
        wide = mixing.picks(frame, plan, broadcast_leaves=0)
        key = lambda df: sorted((r.doc_id, r._epoch) for r in df.collect())
        assert key(out) == key(wide) and len(set(key(out))) == len(key(out)) and all(e < epochs for _, e in key(out))
        leaves = defaultdict(int)
        for r in out.collect():
            leaves[r._domain, r._lang, r._source] += r._tokens
        tokens = frame.select(mixing.tokens_of(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
        assert sum(leaves.values()) >= min(tokens * share // 100, tokens * epochs) - len(leaves)
    assert mixing.mixed_documents(frame).columns == frame.columns and mixing.mixed_documents(docs(spark, [])).count() == 0
    twice = mixing.picks(docs(spark, [(1, "a b", "en", "s"), (1, "a b", "en", "s")]), mixing.Plan(mixing.Weights(), share=100, epochs=1))
    assert twice.count() == 2


def test_chat_links_and_order(spark):
    talk = [
        (1, 0, "user", "What is a river?\n\nAnd what is a lake?"), (1, 1, "assistant", "Water that flows."), (1, 2, "user", "> Water  that FLOWS.\nWhere to?"), (1, 3, "assistant", "> > Water that flows.\n> Where to?\n\nTo the sea."), (1, 4, "user", "> And what is a lake?\nStill open."), (1, 5, "user", "> never said\nhm"), (1, 6, None, None),
        (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "user", "> same"), (None, None, "user", "> x"), (3, 0, "user", "> Water that flows."),
    ]
    frame = spark.createDataFrame([(*r, "clash", 1, "x", 2) for r in talk], "conv_id long, turn long, role string, text string, key string, level int, kind string, position long")
    got = {(r.conv_id, r.turn): r for r in chat.conversations(frame).collect()}
    assert chat.conversations(frame).count() == len(talk)
    assert [(t, got[1, t].reply_to, got[1, t].thread_turn) for t in range(7)] == [(0, None, 0), (1, None, 1), (2, 1, 1), (3, 2, 1), (4, 0, 0), (5, None, 5), (6, None, 6)]
    assert [t for t in sorted(range(7), key=lambda t: got[1, t].position)] == [0, 4, 1, 2, 3, 5, 6]
    assert got[1, 3].text == "To the sea." and got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2 and got[1, 5].n_linked == 0
    assert got[2, 1].reply_to == 0 and got[3, 0].reply_to is None and got[None, None].text == "" and got[1, 6].formatted == "<|user|>\n\n<|end|>"
    assert got[1, 5].unlinked == "> never said" and got[None, None].unlinked is None and got[1, 2].unlinked is None
    assert sorted(r.position for r in chat.conversations(frame).collect() if r.conv_id == 2) == [0, 1, 2]
    assert chat.conversations(frame.limit(0)).count() == 0


def test_chat_ranges(spark):
    rows = [(7, t, "user", f"line {t}" if t % 3 else f"> line {t - 2}\nanswer {t}" if t else "start") for t in range(700)]
    got = {r.turn: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[t].reply_to == t - 2 for t in range(3, 700, 3)) and sorted(r.position for r in got.values()) == list(range(700))


def brute_chat(rows):
    """(conv, turn, role, text) rows to (reply_to, n_quotes, n_linked, thread_turn) by plain reading, in the rows' order."""
    import re

    quote = re.compile(r"^[ \t]*(?:>[ \t]*)+")
    norm = lambda t: " ".join(t.lower().split())

    def cut_up(text):
        out, blank = [], True
        for line in re.split(r"\r\n|\r|\n", text or ""):
            m = quote.match(line)
            level, body = (m[0].count(">"), line[m.end() :]) if m else (0, line)
            if level == 0 and not body.strip(" "):
                blank = True
            elif not blank and out[-1][0] == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
                blank = False
        return out

    said = defaultdict(set)
    for c, t, _, x in rows:
        own = [lines for level, lines in cut_up(x) if level == 0]
        for lines in [*own, [line for p in own for line in p]]:
            said[c, t] |= {norm(" ".join(lines)), *map(norm, lines)} - {""}
    found = []
    for c, t, _, x in rows:
        quotes = [(i, level, lines) for i, (level, lines) in enumerate(cut_up(x)) if level]
        original = lambda text: max((u for (d, u), k in said.items() if d == c and u < t and text and text in k), default=None)
        linked = []
        for i, level, lines in quotes:
            if (origin := original(norm(" ".join(lines)))) is not None:
                linked.append((level, i, origin))
                continue
            letters = defaultdict(int)
            for line in lines:
                if (origin := original(norm(line))) is not None:
                    letters[origin] += len(norm(line))
            if letters and 2 * max(letters.values()) >= sum(len(norm(line)) for line in lines):
                linked.append((level, i, max(letters, key=lambda o: (letters[o], o))))
        found.append((min(linked)[2] if linked else None, len(quotes), len(linked)))
    root = {(c, t): t for c, t, _, _ in rows}
    for _ in rows:
        for (c, t, _, _), (reply, _, _) in zip(rows, found):
            if reply is not None:
                low = min(root[c, t], root[c, reply])
                root = {k: low if k[0] == c and v in (root[c, t], root[c, reply]) else v for k, v in root.items()}
    return [(*f, root[c, t]) for (c, t, _, _), f in zip(rows, found)]


def test_chat_by_brute_force_with_repeated_turns(spark):
    rng = random.Random(11)
    said, rows = ["the river", "a stone house", "Light  of day", "no one"], []
    for c in range(4):
        for t in range(14):
            for _ in range(rng.choice((1, 1, 2))):
                lines = [rng.choice(["", "> ", "> > ", ">"]) + rng.choice([*said, "own " + str(t)]) for _ in range(rng.randint(1, 5))]
                rows.append((c, t, "user", "\n".join(lines)))
    rows += [rows[5], rows[5], rows[20]]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    key = lambda c, t, x: (c, t, x)
    want = defaultdict(list)
    for r, w in zip(rows, brute_chat(rows)):
        quoted = any(line.lstrip(" \t").startswith(">") for line in r[3].split("\n"))
        kept = "\n".join(line for line in r[3].split("\n") if not line.lstrip(" \t").startswith(">")).strip() if quoted else r[3]
        want[key(r[0], r[1], kept)].append(w)
    have = defaultdict(list)
    for r in got:
        have[key(r.conv_id, r.turn, r.text)].append((r.reply_to, r.n_quotes, r.n_linked, r.thread_turn))
    assert {k: sorted(map(str, v)) for k, v in have.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    for c in range(4):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [(r.thread_turn, r.turn) for r in own] == sorted((r.thread_turn, r.turn) for r in own)


def test_chat_lines_without_original_are_kept(spark):
    rows = [(1, 0, "user", "Thanks"), (1, 1, "user", "> entirely different quoted sentence here\n> Thanks\nwell"), (1, 2, "user", "A long first line of mine\nshort"), (1, 3, "user", "> A long first line of mine\n> added by another\n>\nyes"), (1, 4, "user|", "hello <|end|>\n<|assistant|> <\\|x|>")]
    got = {r.turn: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_quotes, got[1].n_linked, got[1].reply_to) == (1, 0, None) and got[1].unlinked == "> entirely different quoted sentence here\n> Thanks"
    assert (got[3].n_linked, got[3].reply_to, got[3].text) == (1, 2, "yes") and got[3].unlinked == "> added by another"
    assert got[4].formatted == "<|user||>\nhello <\\|end|>\n<\\|assistant|> <\\\\|x|>\n<|end|>" and got[4].formatted.count("<|") == 2


def test_chat_ids_of_any_type_and_null_turns(spark):
    rows = [("a-1", 0, "user", "hello there"), ("a-1", 1, "user", "> hello there\nyes"), (None, 0, "user", "hello there"), (None, 1, "user", "> hello there"), ("a-1", None, "user", "> hello there"), ("", 1, "user", "> hello there")]
    got = {(r.conv_id, r.turn): r for r in chat.conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and got["a-1", 1].reply_to == 0 and got[None, 1].reply_to == 0 and got["", 1].reply_to is None
    assert got["a-1", None].position == 0 and got["a-1", None].thread_turn is None and got["a-1", None].reply_to is None
    numbers = chat.conversations(spark.createDataFrame([(-1, -1, "user", "x"), (None, None, "user", "y")], "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id is None, r.turn is None, r.position) for r in numbers) == [(False, False, 0), (True, True, 0)]


def test_html_depth_styles_and_names():
    from gridloom.llm import html

    tree = html.trained()
    story = "<article><p>The river rose by two metres over night and the bridge was closed.</p>{}<p>It rained on and on for days in the hills.</p></article>"
    plain = html.main_text(story.format(""), tree)
    assert plain.count("\n") == 1
    # A mark holds however deep its text is, and an unmarked text is found there.
    for depth in (3, 300, 3000):
        assert html.main_text("<div class='advert'>" + "<div>" * depth + "Boots at half price now" + "</div>" * depth + "</div>" + story.format(""), tree) == plain
        assert html.main_text("<div>" * depth + story.format("") + "</div>" * depth, tree) == plain
    # What is in a marked element is summed up to those around it.
    page = html.read("<div class='comments'>a b<div class='advert'>c</div><article>d e</article></div>f")
    assert (page.words, page.held, page.around, page.articles) == ([5, 1], [1, 0], [-1, 0], 1)
    for hidden in ('style="color:red; display: none"', "style='visibility:hidden'", 'class="hinweis"', 'class="commentaires"', 'id="publicidad"'):
        assert html.main_text(story.format(f"<div {hidden}><p>words that are no part of it</p></div>"), tree) == plain
    for shown in ('style="display:block"', 'style="--display:none-of-it"'):
        assert "a part of it" in html.main_text(story.format(f"<p {shown}>words that are a part of it</p>"), tree)
