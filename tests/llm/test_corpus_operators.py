"""Edge cases and brute force for the corpus operators."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.llm import chat, components, decontam, html, language, linededup, neardup, packing, sharding, shingles, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def clashing(df):
    """Extra columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("sig", "key", "id", "th", "words", "part", "ids", "n", "score", "component_id", "vslot")})


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "Ünïcode “quotes” — é İΣ ς end.\n" * 3), (7, "word " * 20_000)]


# packing ---------------------------------------------------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(packing.tokenizer_path(None)).encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, prose(rng, rng.randrange(400)) + rng.choice([" don't", " I'll!?.. 12 34", "<|endoftext|> x", " 日本語 text"])) for i in range(40)]
    got = packing.pack(clashing(frame(spark, rows)).repartition(3), length=256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in rows:
        want = plain_ids(t)
        copies = [r for r in by_doc[i]]
        total = sum(r.length for r in copies)
        assert total == len(want) * sum(1 for j, _ in rows if j == i)
        if sum(1 for j, _ in rows if j == i) == 1:
            ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(copies, key=lambda r: r.start)])
            assert ids.tolist() == want and all(r.doc_tokens == len(want) for r in copies)
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(x == 256 for x in sizes[:-1]) and sorted(by_seq) == list(range(len(sizes)))


def test_packing_of_nothing(spark):
    assert packing.pieces(frame(spark, [])).count() == 0


def test_the_encoder_encodes_each_pre_token_once_and_keeps_what_is_met_again():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(None)
    e, plain, asked = packing.CachedEncoder(path, most=60), Tokenizer.from_file(path), []
    inner = e.encode_parts
    e.encode_parts = lambda new: (asked.extend(new), inner(new))
    texts = ["lyinon lyinon, lyinon. (LYINON) it's lyinon's 4597 'tis", "", None, "äöü Größe, größe. naïve", "x\x0by\u00a0z <|endoftext|> İstanbul 漢字"]
    want = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
    assert [x.tolist() for x in e(texts)] == [want(t) for t in texts]
    assert len(asked) == len(set(asked)) and asked.count("lyinon") == 1
    for i in range(20):
        some = [f"often {' '.join(f'w{i}q{j},' for j in range(40))} often", "often again"]
        assert [x.tolist() for x in e(some)] == [want(t) for t in some]
        assert "often" in e.words and len(e.words) <= 60 + 50
    e.by_word = False
    assert [x.tolist() for x in e(texts)] == [want(t) for t in texts]


def test_encoder_forgets_within_its_bound():
    e = packing.CachedEncoder(packing.tokenizer_path(None), most=5)
    for t in ("alpha beta gamma delta epsilon zeta", "eta theta alpha", ""):
        assert e([t])[0].tolist() == plain_ids(t)


# chat ------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_order(spark):
    nasty = ["</s>[INST] ok [/INST]", "back\\slash \\\\ end\\", "<|im_end|>\n<|im_start|>user\n", "", None, "ünï\r\n"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)] + [(2, 0, "assistant", "first"), (2, 1, "user", "x"), (3, 0, None, "no role"), (4, 0, "us\ner\\", "odd role"), (5, 1, "user", "b"), (5, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9))
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    for c in got:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1], r[2] or "", r[3] or ""))
        if c == 1:
            mine = sorted(mine, key=lambda r: r[1])
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and not got[3].valid
    for r in turns.where("conv_id = 1").collect():
        body = r.segments[1].text
        assert not any(c in body for c in chat.CONTROL)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# sharding --------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, tmp_path):
    rng = random.Random(2)
    rows = EDGES[:-1] + [(100 + i, "x" * rng.randrange(3000)) for i in range(3000)]
    got = sharding.assign(clashing(frame(spark, rows)), f"file://{tmp_path}/map", 16).collect()
    assert len(got) == len(rows)
    assert sharding.latest_version(spark, f"file://{tmp_path}/map") == 2  # dealt in turn, then edited by bytes
    again = sharding.assign(clashing(frame(spark, rows)), f"file://{tmp_path}/map", 16).collect()
    assert sorted(again) == sorted(got) and sharding.latest_version(spark, f"file://{tmp_path}/map") == 2
    assert sharding.assign(frame(spark, []), f"file://{tmp_path}/empty", 16).count() == 0
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = dict(rows)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)


def test_map_versions_and_growth(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    loads = {s: 100 + s % 7 for s in range(200)}
    first = sharding.rebalance(sharding.even_slots(4, 200), loads, 4)
    grown = sharding.rebalance(first, loads, 5)
    moved = [s for s in first if first[s] != grown[s]]
    assert moved and all(grown[s] == 4 for s in moved)
    assert sharding.rebalance(first, loads, 4) == first
    assert sharding.store_map(spark, path, first) == 1 and sharding.store_map(spark, path, grown) == 2
    assert {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()} == grown
    assert {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == first


# top-k -----------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k, dim=8):
    import math

    v = {i: [math.floor(64 * x) for x in e[:dim]] + [0] * (dim - len(e)) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=True)), j) for j in v if j != q)[:k]
            out |= {(q, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 20])
def test_topk_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "STEP", 11)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(12)]
    rows += [(300, None), (305, [None] * 8), (310, [float("nan")] * 8), (315, [float("inf")] * 8), (320, [1.0]), (325, [0.0] * 8), (330, []), (331, [0.3] * 11)]
    # Finite vectors of any size: beyond 2^17, beyond exact doubles, beyond 64-bit scores; near-equal ones, ties and both signs.
    for n, size in enumerate((2.0**17, 3e5, 1e9, 1e12, 1e30, 1e200)):
        rows += [(400 + 20 * n + i, (rng.normal(0, 1, 8) * size).tolist()) for i in range(9)]
        rows += [(410 + 20 * n + i, [size, -size, 1.5, size / 3 + i // 2, -0.25, 0.0, 64.0, 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit(1)).withColumn("shard", F.lit("x"))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 5 == 0, 20, 8).collect()}
    assert got == brute_topk(rows, 20)


def test_topk_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0] * 8), (5, [2.0] * 8)], "vec_id long, embedding array<double>")
    assert topk.search(df, F.col("vec_id") % 5 == 0, 20, 8).count() == 2
    assert topk.search(df.limit(0), F.col("vec_id") % 5 == 0, 20, 8).count() == 0
    two = spark.createDataFrame([(0, [1.0] * 8), (0, [2.0] * 8), (0, [2.0] * 8), (1, [1.0] * 8), (1, [1.0] * 8)], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in topk.search(two, F.col("vec_id") % 5 == 0, 5, 8).collect()) == [(i, 1, 8 * 64 * 128) for i in range(1, 5)] + [(5, 1, 8 * 64 * 64)]


def test_maxscore_prunes_without_loss():
    rng = np.random.default_rng(5)
    m = np.floor(rng.normal(size=(9000, 8)) * np.array([30, 20, 10, 4, 2, 1, 1, 1]))
    p = topk.Postings(np.arange(9000), m)
    for q in m[:20]:
        ids, score = p.search(-1, q, 5)
        want = sorted((-int(q @ x), i) for i, x in enumerate(m))[:5]
        assert [(-s, i) for s, i in zip(score, ids, strict=True)] == want
        floored = p.search(-1, q, 5, score[-1])
        assert floored == (ids, score)
    assert p.skipped > 0.5 * p.seen


def test_orders_of_scores_beyond_a_long():
    scores = sorted([0, 1, -1, 2**63 - 1, -(2**63), 2**63, -(2**63) - 1, 2**64, 2**64 + 1, -(2**64), -(2**64) - 1, 2**700, -(2**700), 2**700 + 1])
    shown = [(max(-(1 << 63), min((1 << 63) - 1, s)), topk.order_key(s)) for s in scores]
    assert shown == sorted(shown) and len(set(shown)) == len(scores)
    assert topk.scaled_down(2**700 + 1, 650) == 2.0**50 and topk.scaled_down(-(2**63) - 1, 0) < -(2.0**63)


# HTML ------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
 para<br>graph &copy; one.<p>Second &#8212; paragraph.</p><form><input>Subscribe now</form><div class="ad">Buy</div>
<ul><li>item one</li><li>item two</li></ul><aside>Side</aside></article>
<section id="comments"><p>Nice post, I liked this a lot and will come back.</p></section><footer>Copyright</footer></body></html>"""
TEXT = "Head & line First bold para graph © one. Second — paragraph. item one item two"


def test_html_main_text(spark):
    assert html.extract(PAGE) == TEXT
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("just  text &lt;3") == "just text <3"
    bare = "<div class=menu><a>One</a><a>Two</a></div><div id=content><p>" + "Long running text of an old page. " * 9 + "</p><p>" + "More of it follows here. " * 9 + "</p></div><div class=footer>end</div>"
    assert html.extract(bare).startswith("Long running") and "Two" not in html.extract(bare) and html.extract(bare).endswith("follows here.")
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract_pages(df).collect())
    assert got == [(1, TEXT, len(TEXT))] * 2 + [(2, "", 0)]


def sentences(rng, n, least=8, most=25):
    return " ".join(prose(rng, rng.randrange(least, most)).capitalize() + "." for _ in range(n))


@pytest.mark.parametrize("body", ["article", "main", "main+article", "two articles", "div", "role"])
def test_html_of_composed_pages(body):
    """Pages put together from parts: the extraction is the article's parts and nothing of the others."""
    rng = random.Random(body)
    for _ in range(40):
        parts = ["<h1>{}</h1>".format(h) for h in [prose(rng, 5)]]
        parts += ["<p>{}</p>".format(sentences(rng, rng.randrange(2, 6))) for _ in range(rng.randrange(2, 8))]
        extra = ["<h2>{}</h2>".format(prose(rng, 3)), "<ul><li>{}</li><li>{}</li></ul>".format(prose(rng, 4), prose(rng, 2)), "<blockquote><p>{}</p></blockquote>".format(sentences(rng, 2))]
        extra += ['<div class="share-price-analysis"><p>{}</p></div>'.format(sentences(rng, 3)), '<section class="notice-board">{}</section>'.format(sentences(rng, 2))]
        for x in extra:
            parts.insert(rng.randrange(2, len(parts) + 1) if len(parts) > 2 else 2, x)
        parts.append("<p>{}</p>".format(sentences(rng, 3)))
        words = lambda t: re.sub(r"<[^>]*>", " ", t).split()
        want = words(" ".join(parts))
        inside = list(parts)
        for x in ('<div class="ad-banner">Buy this now</div>', '<aside><p>{}</p></aside>'.format(sentences(rng, 2)), '<form><p>{}</p><input></form>'.format(prose(rng, 9))):
            inside.insert(rng.randrange(len(inside)), x)
        cut = rng.randrange(3, len(inside) - 2)
        text = {
            "article": "<article>" + "".join(inside) + "</article>",
            "main": "<main id=content>" + "".join(inside) + "</main>",
            "main+article": "<main>" + "".join(inside[:cut]) + "<article>" + "".join(inside[cut:]) + "</article></main>",
            "two articles": "<article>" + "".join(inside[:cut]) + "</article><div class=divider></div><article>" + "".join(inside[cut:]) + "<p>" + "</p></article>",
            "div": "<div class=post-content>" + "".join(inside) + "</div>",
            "role": "<div id=body><div class=story>" + "".join(inside) + "</div></div>",
        }[body]
        links = "".join("<li><a href=/x>{}</a></li>".format(prose(rng, 2)) for _ in range(8))
        page = "<html><head><title>t</title><script>var x = '<p>';</script></head><body><header><a href=/>{}</a></header><nav><ul>{}</ul></nav><div class='cookieNotice'><p>{}</p></div>".format(prose(rng, 3), links, sentences(rng, 2))
        page += text + "<div class=related-posts><ul>{}</ul></div><section id=comments-area><article class=comment><p>{}</p></article></section><div class=sidebar-left>{}</div><footer>{}</footer></body></html>".format(links, sentences(rng, 4), sentences(rng, 3), sentences(rng, 1))
        assert html.extract(page).split() == want


def test_html_marks_are_whole_names():
    assert all(html.is_mark(x, False) for x in ("ad", "site-header", "cookieNotice", "post-comments", "sidebar_2", "share-buttons", "nav-primary", "widget_area"))
    assert not any(html.is_mark(x, False) for x in ("share-price-analysis", "notice-board", "header-image-caption", "post-header", "article", "alertness", "ad-hoc-report", ""))
    assert not html.is_mark("entry-header", True) and html.extract_pages


def test_html_keeps_lists_and_endings_without_regions():
    long = "long words here " * 40
    items = "".join(f"<li>item {c}</li>" for c in "abcdefg")
    got = html.extract(f"<div><h1>T</h1><p>{long}</p><ul>{items}</ul><p>The end.</p></div>")
    assert got == f"T {long.strip()} item a item b item c item d item e item f item g The end."
    # What stands in other blocks doesn't come along, nor do links behind the last line.
    page = "<div><a href=x>Home</a> | <a href=y>News</a></div>" + "<div>x</div>" * 4 + f"<div><p>By me</p><p>on a day</p><p>in a place</p><p>{long}</p><p>Bye.</p><p><a href=z>More</a></p></div><div>About us</div>"
    assert html.extract(page) == f"By me on a day in a place {long.strip()} Bye."


def test_html_threshold_decides_inside_a_region(monkeypatch):
    long = "many words of an article that goes on " * 20
    page = f"<main><h1>T</h1><p>{long}</p><p>{long}</p><p>Short.</p><div>" + "".join(f"<ul><li><a href={i}>tag {i}</a></li></ul>" for i in range(9)) + "</div></main>"
    want = " ".join(["T", long.strip(), long.strip(), "Short."])
    assert html.extract(page) == want
    # Links of many words aren't a menu: nothing of an article is dropped for being a link.
    cited = "".join(f"<p><a href={i}>{'the title of a cited work ' * 4}</a></p>" for i in range(3))
    assert html.extract(f"<main><p>{long}</p>{cited}</main>").count("cited work") == 12
    monkeypatch.setattr(html, "threshold", lambda x: 0.0)
    assert html.extract(page) != want


def test_html_of_many_articles_is_linear():
    page = lambda n: "<article><h2>t</h2><p>some words of text that are long enough to count</p></article>" * n
    times = []
    for n in (1000, 8000):
        began = time.perf_counter()
        assert html.extract(page(n)).count("some words") == n
        times.append(time.perf_counter() - began)
    assert times[1] < 24 * times[0]


def test_html_of_no_pages(spark):
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_survives_broken_markup():
    assert html.extract("<article><p class=ad>Buy<p>one<ul><li class=ad>no<li>two</ul></article>") == "one two"
    assert html.extract("<article><p><b>one<p>two</div></article><p>") == "one two"
    assert "deep" in html.extract("<div>" * 3000 + "deep")
    assert html.extract("<article>" + "<p>x y</p>" * 20_000 + "</article>").count("x y") == 20_000


# language --------------------------------------------------------------------------------------------------------------


def language_rows(rng, n):
    syllables = {"aa": ["the", "ing", "er", "on", "ly"], "bb": ["que", "eau", "oi", "ment", "les"], "cc": ["sch", "ung", "ich", "der", "keit"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        out.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))), lang, "s", 1))
    return out


def plain_language(model, text):
    """The language of least size, every chunk compressed by a compressor of its own."""
    import zstandard as z

    data = b" " + language.folded(text) + b" "
    if not data.strip():
        return "und"
    how = z.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
    size = lambda d, x: len(z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)).compress(x))
    sums = [sum(size(d, data[i : i + language.CHUNK]) for i in range(0, len(data), language.CHUNK)) for d in model.values()]
    return list(model)[sums.index(min(sums))]


def test_language_learns_from_long_texts_and_many_languages(spark):
    rng = random.Random(61)
    rows = []
    for i in range(140):
        own = [f"{'abcdefghijklmnopqrst'[i % 20]}{'aeiou'[i % 5]}{x}" for x in ("la", "rin", "tos", "me", "kul")]
        rows.append((i, " ".join("".join(rng.choice(own) for _ in range(2)) for _ in range(30)), f"l{i % 70}", "s", 1))
    rows += [(1000 + i, " ".join(rng.choice(["lange", "texte", "alleine"]) for _ in range(9000)), "long", "s", 1) for i in range(3)]
    rows += [(2000, "1 2 3", "digits", "s", 1), (2001, "ab", "tiny", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    assert set(model) == {f"l{i}" for i in range(70)} | {"long", "tiny"} and all(len(d) >= 16 for d in model.values())
    texts = [t for _, t, *_ in rows] + ["texte alleine lange"]
    got = [language.Classifier(model)(t)[0] for t in texts]
    assert got == [plain_language(model, t) for t in texts]
    assert got[140:143] == ["long"] * 3 and got[-1] == "long"
    # The commonest words come last; a stretch may begin or end inside a word.
    assert set(model["long"].split()[-3:]) == {b"lange", b"texte", b"alleine"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    rows = language_rows(random.Random(4), 400)
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs.where(~language.held_out()))
    got = {r.doc_id: r for r in language.predict(docs, model).where(language.held_out()).collect()}
    assert got and sum(got[i].lang_pred == lang for i, _, lang, _, _ in rows if i in got) >= 0.97 * len(got)
    odd = {r.doc_id: r for r in language.predict(clashing(frame(spark, EDGES + [(9, "123 !?"), (10, "the ing " * 5 + "sch ung " * 5)])), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].rejected for i in (1, 2, 3, 9))
    assert odd[5].lang_pred in model
    assert language.fit(docs.limit(0)) == {}
    assert language.predict(docs, {}).select("lang_pred").distinct().collect()[0][0] == "und"
    mixed = "the ing er on ly " * 60 + "que eau oi ment les " * 60
    assert isinstance(language.Classifier(model)(mixed)[2], bool)


# toxicity --------------------------------------------------------------------------------------------------------------


def test_toxicity_folds_and_learns(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["grobian", "lumpazi"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows)
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marked.where("doc_id % 3 <> 0"))
    s = toxicity.Scorer(model)
    assert all((s.score(t) >= 0.5) == bool(y) for (_, t), (_, y) in zip(rows, labels, strict=True))
    clean = prose(random.Random(8), 30)
    assert s.score(clean + " gr0b1an lump@zi grobian") > 0.5 > s.score(clean)
    assert toxicity.folded("gr0b1an іdiot") == " grobian idiot "
    seed = toxicity.Scorer(toxicity.Model(toxicity.SEED))
    assert seed.score("a sore loser here") == seed.score("a b c d") < seed.score("a loser here now")
    assert toxicity.fit(docs, marked.limit(0)).weights == toxicity.SEED
    got = toxicity.score(clashing(frame(spark, EDGES)), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)


def plain_signal(model, text):
    """Every entry looked for at every place."""
    t = toxicity.folded(text)
    words = t.count(" ") - 1
    if words <= 0:
        return 0.0
    at = lambda e: [i for i in range(len(t)) if t.startswith(e, i)]
    free = [(i, i + len(e) - 1) for e in model.exceptions for i in at(e)]
    best = {}
    for e, w in model.weights.items():
        for i in at(e):
            best[i] = max(best.get(i, 0.0), w)
    return sum(w for i, w in best.items() if not any(a <= i < b for a, b in free)) / np.sqrt(words + 20)


def test_toxicity_equals_plain_search(spark):
    rng = random.Random(62)
    entries = [" idiot ", " idio", " bad ", " ba", " scum ", " loser ", " lo"]
    model = toxicity.Model({e: rng.random() * 5 for e in entries})
    pieces = ["idiot", "idiots", "1d1ot", "bad", "badge", "pond", "scum", "sore", "loser", "losers", "good", "ІDIOT", "b@d", "!", "x"]
    scorer = toxicity.Scorer(model)
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert abs(scorer.signal(text) - plain_signal(model, text)) < 1e-12
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_toxicity_of_a_megabyte_of_exceptions_is_quick():
    model = toxicity.Model({" scum ": 2.0, " trash ": 1.0, " can ": 0.5})
    scorer = toxicity.Scorer(model)
    text = "scum trash can pond scum " * 40_000
    began = time.perf_counter()
    got = scorer.signal(text)
    assert time.perf_counter() - began < 5
    # The first word and each one behind "pond scum" stand alone; what follows is in an exception, or shares its blank.
    small = "scum trash can pond scum " * 40
    assert abs(scorer.signal(small) - plain_signal(model, small)) < 1e-9 and got > 0


# line dedup ------------------------------------------------------------------------------------------------------------


def test_units_rebuild_the_text():
    for t in ("", "\n\n", "One. Two! Three\nfour  five.\n", "no end", "a.b. c.\n\n d", "é. " * 50):
        assert "".join(linededup.units(t)) == t


def brute_blocks(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_patience_blocks_are_common_and_ordered():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(25))]
        b = [rng.randrange(30) for _ in range(rng.randrange(25))]
        if rng.random() < 0.5 and a:
            b = b[:5] + a[2:15] + b[5:]
        blocks = linededup.common_blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:], strict=False))
        assert max((n for *_, n in blocks), default=0) <= brute_blocks(a, b)
    assert linededup.common_blocks([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]


def test_runs_are_the_shortest_with_enough_words():
    rng = random.Random(3)
    for _ in range(200):
        hs = [rng.choice([0, rng.randrange(1, 6)]) for _ in range(rng.randrange(40))]
        want = {tuple(hs[i:j]) for i, h in enumerate(hs) if h for j in [next((j for j in range(i, len(hs) + 1) if 3 * sum(hs[i:j]) >= 20), None)] if j}
        assert len(linededup.runs(np.array(hs, np.int64), np.array([3 * h for h in hs], np.int32))) == len(want)
    a = np.arange(1, 30)
    tail = linededup.runs(np.concatenate([[99], a[5:]]), np.full(25, 7, np.int32))
    assert len(set(tail) & set(linededup.runs(a, np.full(29, 7, np.int32)))) == 22


def test_no_shared_run_is_left_of_the_later_document():
    rng = random.Random(31)
    a, b = [1, 2, 3, 10, 11, 12, 4, 10, 11, 12, 5], [6, 10, 11, 12, 7, 10, 11, 12, 8]
    assert sum(n for *_, n in linededup.common_blocks(a, b)) == 0
    assert linededup.shared_ranges(a, b, [7] * 9, 20) == [(1, 4), (5, 8)]
    for _ in range(600):
        words = {h: rng.randrange(1, 9) if h else 0 for h in range(12)}
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(40))] for _ in range(2))
        ws = [words[h] for h in b]
        cut = {j for s, e in linededup.shared_ranges(a, b, ws, 20) for j in range(s, e)}
        left = [h for j, h in enumerate(b) if j not in cut]
        stretches = lambda x: {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        assert not any(sum(map(words.get, r)) >= 20 for r in stretches(a) & stretches(left))
        if not any(sum(map(words.get, r)) >= 20 for r in stretches(a) & stretches(b)):
            assert not cut


@pytest.mark.parametrize("copies", [3, 30])
def test_repeated_passages_leave_later_documents(spark, copies):
    rng = random.Random(10)
    passage = ". ".join(prose(rng, 15, 10**6) for _ in range(5)) + "."
    rows = [(i, "\n".join([prose(rng, 20, 10**6), passage, prose(rng, 20, 10**6) + "."])) for i in range(copies)] + [(1000, passage), (1001, prose(rng, 40, 10**6))]
    rows += [(2000, None), (2001, ""), (2002, "short line\nshort line"), (2003, "short line")]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert passage in got[0].text and got[0].removed_words == 0
    for i in range(1, copies):
        assert passage not in got[i].text and got[i].removed_words >= 70
        assert got[i].text.split("\n")[0] == rows[i][1].split("\n")[0]
    assert got[1000].text == "" and got[1001].text == dict(rows)[1001]
    assert got[2000].text is None and got[2001].text == "" and got[2002].text == dict(rows)[2002]
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_leaves_no_shared_run_and_no_gap(spark, monkeypatch):
    """The whole result against brute force: every run of 20 words that an earlier document has goes, and nothing else does."""
    rng = random.Random(63)
    pool = [prose(rng, rng.randrange(4, 18), 10**6) + "." for _ in range(30)]
    passages = [[prose(rng, rng.randrange(5, 12), 10**6) + "." for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [[prose(rng, rng.randrange(3, 15), 10**6) + "."] for _ in range(rng.randrange(1, 6))] + [[rng.choice(pool)] for _ in range(rng.randrange(5))]
        parts += [rng.choice(passages)[rng.randrange(2) :] for _ in range(rng.randrange(4))]
        rng.shuffle(parts)
        rows.append((i, "\n".join(" ".join(p) for p in parts)))
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    stripped = lambda t: [u.strip() for u in linededup.units(t) if u.strip()]

    def long_runs(us):
        return {tuple(us[i:j]) for i in range(len(us)) for j in range(i + 1, len(us) + 1) if sum(len(u.split()) for u in us[i:j]) >= 20}

    earlier, changed = set(), 0
    for i, t in rows:
        before, after = stripped(t), stripped(got[i].text)
        assert not long_runs(after) & earlier
        assert got[i].removed_words == sum(len(u.split()) for u in before) - sum(len(u.split()) for u in after)
        if not long_runs(before) & earlier:
            assert got[i].text == t
        else:
            changed += 1
            inside = {u for r in long_runs(before) & earlier for u in r}
            left = list(after)
            for u in before:  # what is left stands in its order, and what went was in a shared run
                if left and left[0] == u:
                    left.pop(0)
                else:
                    assert u in inside or any(u in r for r in earlier)
            assert not left
        earlier |= long_runs(before)
    assert changed > 20


def test_line_dedup_keeps_columns_and_rows(spark):
    df = clashing(frame(spark, EDGES))
    got = linededup.dedup_lines(df, removed="gone")
    assert got.columns == [*df.columns, "gone"] and got.count() == len(EDGES)


# near-dedup ------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    def words(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: words(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(rng):
    rows = [(i, prose(rng, rng.randrange(1, 90))) for i in range(60)]
    n = 100
    for size in (2, 5, 60):
        base = prose(rng, 120, 10**6).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(500 + i, rows[70][1]) for i in range(10)] + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  B"), (905, "x " * 3000)]


def test_groups_equal_brute_force(spark):
    rows = near_rows(random.Random(11))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(clashing(frame(spark, rows)).repartition(4)).collect()}
    assert got == brute_groups(rows)


def test_groups_in_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_BYTES", 3000)
    rows = near_rows(random.Random(12))
    out = neardup.groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_neighbours_do_not_depend_on_the_ranges(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, neardup.HASHES)
    rows = [(i, bytes(np.where(rng.random(neardup.HASHES) < 0.02, rng.integers(0, 256, neardup.HASHES), base).astype(np.uint8).tolist()), i) for i in range(60)]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for n in (3, 60):
                dense = spark.createDataFrame(rows[:n], "doc_id long, sig binary, grp long")
                found[parts, n] = {(r.a, r.b) for r in neardup.neighbours(dense, False, window=5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[1, 3] == {(0, 1), (0, 2), (1, 2)} and len(found[1, 60]) > 500
    assert all(pairs == found[1, n] for (_, n), pairs in found.items())


def template_rows(rng, n, planted):
    """``n`` documents at 0.68 to 0.71 from each other: each lacks some of the template's words in a place of its own, and has own words. Every
    ``planted``-th has a partner at 0.75 to 0.8."""
    rows = []
    template = prose(rng, 400, 10**9).split()
    for i in range(n):
        # 396 shingles of the template, cut at one place; 150 of its own.
        at = rng.randrange(20, 380)
        own = prose(rng, 72, 10**9).split()
        words = [*template[:at], *own, *template[at:]]
        rows.append((i, " ".join(words)))
        if i % planted == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = f"y{rng.randrange(10**9)}"
            rows.append((10**6 + i, " ".join(words)))
    return rows


def test_dense_regions_lose_no_link(spark):
    """Documents crowd around a template just under the threshold, far more than the window holds."""
    rng = random.Random(51)
    rows = template_rows(rng, 1200, 12)
    sets = {i: shingles.shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert all(alike(i, 10**6 + i) >= 0.75 for i in range(0, 1200, 12)) and 0.66 < alike(1, 2) < 0.75
    got = {r.doc_id: r.component_id for r in neardup.groups(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_sets(sets).items()}


def brute_sets(sets):
    """Groups by comparing every pair."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        rest = ids[k + 1 :]
        for b, both in zip(rest, shingles.overlaps(sets[a], [sets[b] for b in rest]) if rest else (), strict=True):
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("cell", [1_000, 40])
def test_blocks_join_all_that_are_linked(spark, monkeypatch, cell):
    """All rows at once and each its own group: the exact way alone, against all pairs."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", cell)
    monkeypatch.setattr(neardup, "COLUMNS", 100)
    rng = random.Random(52)
    rows = near_rows(rng)[:130] + [(2000 + i, t) for i, t in template_rows(rng, 40, 4)[:50]]
    sets = {i: shingles.shingle_set(t) for i, t in rows}
    texts = frame(spark, rows).select("doc_id", "text", F.octet_length("text").alias("bytes"))
    crowded = texts.select("doc_id", F.col("doc_id").alias("grp"))
    blocks = neardup.prefix_blocks(texts, crowded).cache()
    links = neardup.block_links(texts, crowded, blocks)
    got = {r.node: r.component for r in components.connected(links).collect()}
    want = brute_sets(sets)
    assert {i: got.get(i, i) for i in sets} == {i: c for i, (_, c) in want.items()}
    assert links.count() <= 3 * len(rows)


def test_common_counts_are_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)]
    got = neardup.common_counts(sets[:12], sets[12:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_components_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(components, "unsettled", lambda edges: True)
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connected(edges, most=1)


def test_groups_of_nothing_and_of_repeated_rows(spark):
    assert neardup.groups(frame(spark, [])).count() == 0
    got = neardup.groups(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1}


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_an_id_with_two_texts_loses_no_link(spark, order):
    a, b = prose(random.Random(1), 300, 10**6), prose(random.Random(2), 300, 10**6)
    rows = [(5, a), (5, b), (7, a + " more"), (8, "less " + b)]
    got = neardup.groups(frame(spark, [rows[i] for i in order]).coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5)]


def test_groups_with_repeated_ids_equal_brute_force(spark):
    rng = random.Random(31)
    texts = [t for _, t in near_rows(rng)]
    rng.shuffle(texts)
    rows = [(rng.randrange(70), t) for t in texts] + [(3, texts[0])] * 50
    plain = brute_groups(list(enumerate(t for _, t in rows)))  # by row
    low = {}
    for k, (i, _) in enumerate(rows):
        low[plain[k][1]] = min(low.get(plain[k][1], i), i)
    want = sorted((i, plain[k][0], low[plain[k][1]], low[plain[k][1]] == i) for k, (i, _) in enumerate(rows))
    assert sorted(map(tuple, neardup.groups(frame(spark, rows).repartition(5)).collect())) == want


def test_rows_without_an_id(spark):
    text = prose(random.Random(21), 60) + ". " + prose(random.Random(22), 40) + "."
    rows = [(None, text), (None, prose(random.Random(23), 50)), *((i, text) for i in range(3, 15))]
    groups = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(frame(spark, rows)).collect()}
    assert groups == {(None, 3, False), (None, None, False), (3, 3, True), *((i, 3, False) for i in range(4, 15))}
    lines = linededup.dedup_lines(frame(spark, rows)).collect()
    assert len(lines) == len(rows) and all((r.removed_words > 0) == (r.doc_id is not None and r.doc_id > 3) for r in lines)
    bench = spark.createDataFrame([(1, text), (None, text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame(spark, rows), bench).collect()} == {(i, 1) for i in range(3, 15)}


def test_shingle_hashes_tell_words_apart():
    assert len(shingles.shingle_set("a b c d e f g")) == 3
    assert np.array_equal(shingles.shingle_set("A\tB c\nd e"), shingles.shingle_set("a b C D E"))
    assert not np.array_equal(shingles.shingle_set("É b c d e"), shingles.shingle_set("é b c d e"))
    assert len(shingles.shingle_set("a b c")) == 1 and len(shingles.word_hashes("a b c")) == 2
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in ["", "x", "xy", "longer-tail" * 12]]
    assert len(set(shingles.word_hashes(" ".join(words)).tolist())) == len(words)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (200, 300), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[200] == got[300] == 100
    assert components.connected(edges.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 200_000])
def test_components_of_random_graphs(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(chunk)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5)]
    near = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        if near[a] is not near[b]:
            near[a] |= near[b]
            for x in near[b]:
                near[x] = near[a]
    rows = components.connected(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows) and got == {x: min(s) for x, s in near.items() if len(s) > 1}


# decontamination -------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    import math
    import re

    def words(t):
        return [w for w in re.sub(r"[^\w\s]|_", "", (t or "").lower()).split() if w]

    def cut(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    item_words = {i: words(t) for i, t in items if words(t)}
    sets = {i: cut(w, min(5, len(w))) for i, w in item_words.items()}
    df = defaultdict(int)
    for s in sets.values():
        for x in s:
            df[x] += 1
    weight = lambda x: math.log(1 + len(sets) / max(1, df.get(x, 1)))
    out = set()
    for d, t in docs:
        w = words(t)
        for i, s in sets.items():
            n, k = len(item_words[i]), min(5, len(item_words[i]))
            for at in range(max(1, len(w) - k + 1)):
                win = cut(w[at : at + n], k)
                both = sum(weight(x) for x in win & s)
                if both and both >= 0.75 * (sum(map(weight, win)) + sum(map(weight, s)) - both):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, rng.randrange(15, 60), 10**6)) for i in range(12)] + [(50, "tiny item here"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        body = prose(rng, 120, 10**6).split()
        if d % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            if d % 6 == 0 and len(w) > 45:
                w[len(w) // 2] = "changed"
            if d % 9 == 0:
                w = [x.upper() + "," for x in w]
            at = rng.choice([0, 50, 120])
            body[at:at] = w
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, "so tiny item here indeed"), (104, " ".join(items[4][1].split()[:8]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = decontam.find_leaks(clashing(frame(spark, docs)), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items)
    assert decontam.find_leaks(frame(spark, []), bench).count() == 0
    assert decontam.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0


def edited(rng, words, edit, how):
    """``words`` with ``edit`` of them new: at the end, at the start, in the middle, or as so many more words in the middle."""
    new = prose(rng, edit, 10**6).split()
    if how == "end":
        return words[: len(words) - edit] + new
    if how == "start":
        return new + words[edit:]
    mid = len(words) // 2
    return words[:mid] + new + words[mid + (edit if how == "middle" else 0) :]


def test_leaks_are_found_at_every_length_and_edit(spark):
    """Edits that leave a similarity of 0.75 to 0.8, whichever way the SimHash moves: recall is 1 and not that of the radius."""
    rng = random.Random(41)
    items, docs, n = [], [], 0
    for size in (12, 20, 30, 60, 100):
        for how in ("end", "start", "middle", "more"):
            for _ in range(20):
                w = prose(rng, size, 10**6).split()
                shingles_in = size - 4
                # A block of e new words breaks e + 4 shingles inside, e at an end: (N - b) / (N + b) is 0.75 at least for b up to N / 7.
                edit = shingles_in // 7 - (4 if how in ("middle", "more") else 0)
                if edit < 1:
                    continue
                items.append((n, " ".join(w)))
                docs.append((n, " ".join([prose(rng, 30, 10**6), *edited(rng, w, edit, how), prose(rng, 30, 10**6)])))
                n += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(frame(spark, docs), bench).collect()}
    assert set(got) == {(i, i) for i, _ in items} and min(got.values()) < 0.8


def test_a_phrase_that_all_items_share_seeds_nothing(spark):
    rng = random.Random(77)
    phrase = "which of the following is the best answer to it"
    items = [(i, phrase + " " + prose(rng, 30, 10**6)) for i in range(40)] + [(100, phrase), (101, "only four words here")]
    rows = [(i, prose(rng, 40, 10**6) + " " + phrase + " " + prose(rng, 40, 10**6)) for i in range(60)]
    rows.append((900, prose(rng, 30, 10**6) + " " + items[7][1] + " " + prose(rng, 30, 10**6)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = decontam.item_table(bench, "item_id", "text")
    n = len(items)
    weights = table.select(F.explode("hs").alias("h")).groupBy("h").agg(F.log(1 + n / F.count(F.lit(1))).alias("w"))
    rare = decontam.rare_shingles(table, weights, 0.75)
    common = {r.h for r in table.where("item_id = 100").select(F.explode("hs").alias("h")).collect()}
    held = rare.collect()
    assert {r.item_id for r in held} == {i for i, _ in items} and not any(r.h in common for r in held if r.item_id < 100)
    # More than a quarter of every item's weight is in its seeds.
    w = {r.h: r.w for r in weights.collect()}
    total = {r.item_id: sum(w[h] for h in r.hs) for r in table.collect()}
    for i, _ in items:
        assert sum(w[r.h] for r in held if r.item_id == i) > 0.25 * total[i]
    texts = frame(spark, rows).select("doc_id", decontam.words_of(F.col("text")).alias("words")).select("doc_id", F.xxhash64("words").alias("th"), "words")
    pairs = {(r.doc_id, r.item_id) for r in decontam.seeded(texts, rare, [4, 5], 1000).collect()}
    assert pairs == {(900, 7)} | {(i, 100) for i in [*range(60), 900]}
    leaks = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame(spark, rows), bench).collect()}
    assert leaks == pairs


def test_windows_between_alignments(spark):
    """Words more in the middle and others at both ends: the best window is aligned with neither half."""
    rng = random.Random(43)
    items, docs = [], []
    for i in range(40):
        w = prose(rng, 90, 10**6).split()
        items.append((i, " ".join(w)))
        inside = [*prose(rng, 2, 10**6).split(), *w[2:45], *prose(rng, 4, 10**6).split(), *w[45:88]]
        docs.append((i, " ".join([prose(rng, 30, 10**6), *inside, prose(rng, 30, 10**6)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in decontam.find_leaks(frame(spark, docs), bench).collect()}
    plain = lambda t: set(zip(*(t.split()[j:] for j in range(5)), strict=False))
    for i, t in docs:
        want = plain(items[i][1])
        w = t.split()
        best = max(len(want & plain(" ".join(w[s : s + 90]))) for s in range(len(w) - 40))
        if best / (2 * len(want) - best) >= 0.75:
            assert got[i, i][1] == round(best / (2 * len(want) - best), 9)


def test_ids_that_repeat_with_other_texts(spark, monkeypatch):
    rng = random.Random(44)
    one, two = prose(rng, 30, 10**6), prose(rng, 40, 10**6)
    bench = spark.createDataFrame([(1, one), (1, two), (2, one)], "item_id long, text string")
    rows = [(5, one), (5, prose(rng, 80, 10**6)), (6, two), (6, two), (7, prose(rng, 50, 10**6) + " " + two), (7, one)]
    want = {(5, 1), (5, 2), (6, 1), (7, 1), (7, 2)}
    first = {tuple(r) for r in decontam.find_leaks(frame(spark, rows), bench).collect()}
    assert {r[:2] for r in first} == want
    assert {tuple(r) for r in decontam.find_leaks(frame(spark, rows[::-1]).repartition(3), bench).collect()} == first
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in decontam.find_leaks(frame(spark, rows), bench).collect()} == first
    texts = frame(spark, rows).select("doc_id", F.lit(1).alias("th"), decontam.words_of(F.col("text")).alias("words"))
    plan = decontam.alignments(texts, decontam.item_table(bench, "item_id", "text"), [5], 10**9)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    sent = [lines[i + 1] for i, x in enumerate(lines) if "Exchange hashpartitioning(h#" in x and "doc_id#" in lines[i + 1]]
    assert sent and "BroadcastExchange" not in plan
    assert not any("words#" in re.sub(r"xxhash64\(.* AS h#", "", x) for x in sent)  # texts don't travel with their shingles


def test_simhash_blocks_find_all_within_the_radius(spark):
    rng = random.Random(14)
    fps = [rng.getrandbits(64) for _ in range(30)]
    near = []
    for f in fps:
        for bit in rng.sample(range(64), rng.randrange(decontam.RADIUS + 1)):
            f ^= 1 << bit
        near.append(f)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "i int, f long")
    b = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(near)], "j int, g long")
    x = a.select("i", "f", decontam.blocks("f", decontam.RADIUS).alias("x")).select("i", "x.*")
    y = b.select("j", "g", decontam.blocks("g", decontam.RADIUS).alias("x")).select("j", "x.*")
    pairs = {(r.i, r.j) for r in x.join(y, ["block", "value"]).select("i", "j").distinct().collect()}
    assert {(i, i) for i in range(30)} <= pairs


@pytest.mark.parametrize("n", [40, 200, 40_000])
def test_simhash_is_the_majority(spark, n):
    words = [f"w{i * 7 % 5000}" for i in range(n)]
    df = spark.createDataFrame([(words,)], "words array<string>")
    got = df.select(decontam.simhash("words", decontam.lane_width(n)).alias("f")).first().f & ((1 << 64) - 1)
    hs = [r.h & ((1 << 64) - 1) for r in df.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("h")).collect()]
    assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def test_decontamination_runs_no_python(spark):
    docs = frame(spark, [(1, "a b c d e f g h")])
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    plan = decontam.find_leaks(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
