"""Brute force and edge cases for the WARC archives, phrase collocations and centroid clustering."""

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from iqlake.llm import clustering, phrases, warc

PAGES = "page_id long, url string, html string"


def clashing(df):
    """Extra columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("id", "target", "payload", "key", "size", "first", "refers_to", "path", "m", "h", "n", "a", "phrase", "e", "cluster", "distance", "ids", "code") if c not in df.columns})


# WARC ------------------------------------------------------------------------------------------------------------------

ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/5\r\nWARC-Type: x y", "one\r\n\r\ntwo WARC/1.1\r\n"), (6, "ü", "é日本" * 5), (7, "u", "z" * 2_500_000), (8, "u", "".join(map(str, range(400_000)))), (None, "u", "nothing"), (10, "u", "again"), (10, "u", "again"), (None, "u", "<p>same</p>")]


def plain_digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_equals_brute_force(spark):
    got = sorted(map(tuple, warc.round_trip(clashing(spark.createDataFrame(ROWS, PAGES)).repartition(3)).collect()), key=repr)
    largest = {}
    for i, _, t in ROWS:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t in ROWS:
        first = largest[t or ""]
        revisit = first >= 0 and (i is None or i < first)
        want.append((i, len((t or "").encode()), plain_digest(t), "revisit" if revisit else "response", first if revisit else None, True, None if revisit else True))
    assert got == sorted(want, key=repr)


def test_archives_are_readable_by_gzip_and_keep_contents(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write(spark.createDataFrame(ROWS, PAGES).coalesce(1), folder, max_bytes=2000)
    files = manifest.collect()
    assert len(files) > 2 and sum(f.records for f in files) == len(ROWS)
    for f in files:
        raw = open(f.path.removeprefix("file://"), "rb").read()
        assert len(raw) == f.bytes and gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == f.records
    found = warc.read(manifest, content=True).collect()
    assert Counter(bytes(r.content) for r in found if r.type == "response") == Counter((t or "").encode() for i, _, t in ROWS if (i, t) not in ((1, ROWS[0][2]), (2, ROWS[0][2]), (None, ROWS[0][2]), (3, None)))
    assert all(r.error is None and r.block_ok for r in found)
    five = next(r for r in found if r.record_id == "urn:record:5")
    assert five.target == "http://a/5%0D%0AWARC-Type:%20x%20y" and five.http["content-type"].startswith("text/html")
    revisit = next(r for r in found if r.record_id == "urn:record:2")
    assert revisit.headers["warc-refers-to"] == "<urn:record:9>" and revisit.headers["warc-profile"] == warc.IDENTICAL and revisit.payload_digest == plain_digest("<p>same</p>")


def test_short_payloads_are_responses(spark, tmp_path):
    found = warc.read(warc.write(spark.createDataFrame(ROWS[:4], PAGES), f"file://{tmp_path}/a", least=12)).collect()
    assert {r.type for r in found} == {"response"}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_told_and_passed():
    members = [warc.member(warc.record(i, "u", bytes([65 + i]) * 50_000 + np.random.default_rng(i).bytes(3000), None)) for i in range(5)]
    starts = np.cumsum([0, *map(len, members)]).tolist()
    whole = b"".join(members)
    good = list(warc.records(io.BytesIO(whole)))
    assert [r["offset"] for r in good] == starts[:-1] and [r["length"] for r in good] == [len(m) for m in members] and all(r["error"] is None for r in good)
    # A member that can't be inflated.
    hurt = bytearray(whole)
    hurt[starts[2] + 40 : starts[2] + 60] = bytes(20)
    ids = [r.get("record_id") for r in warc.records(io.BytesIO(bytes(hurt))) if not r["error"]]
    assert ids == [f"urn:record:{i}" for i in (0, 1, 3, 4)]
    # Junk between members, and an archive that was cut.
    found = list(warc.records(io.BytesIO(members[0] + b"junk \x1f\x8b\x08 junk" + members[1] + members[2][:-20])))
    assert [r.get("record_id") for r in found if not r["error"]] == ["urn:record:0", "urn:record:1"] and found[-1]["error"]
    # Contents that don't fit their digests or lengths.
    raw = warc.record(1, "u", b"abc", None)
    assert next(warc.records(io.BytesIO(warc.member(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")))))["error"] == "block digest, payload digest"
    assert "behind" in next(warc.records(io.BytesIO(warc.member(raw + b"x"))))["error"]
    assert "early" in next(warc.records(io.BytesIO(warc.member(raw[:-6]))))["error"]
    assert [r["error"] for r in warc.records(io.BytesIO(warc.member(b"hello")))] == ["a head without an end"]
    assert list(warc.records(io.BytesIO(b""))) == []


def test_foreign_records_are_read():
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n  b\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    r = next(warc.records(io.BytesIO(warc.member(raw)), content=True))
    assert (r["type"], r["content"], r["block_ok"], r["payload_ok"], r["error"], r["headers"]["x-long"]) == ("warcinfo", b"a: b", None, None, None, "a b")


# phrases ---------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least=10, share=50, top=2000, most=3):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    count[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(rng, n, words):
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations_equal_brute_force(spark, most):
    rng = random.Random(7)
    words = ["a", "b", "C", "the", "The", "é", "É", "日本", "x y", "z\x00", "q\x1f"]
    rows = [(rng.choice(["en", "fr", None, "und"]), t) for t in texts(rng, 150, words)]
    rows += [("en", None), ("de", ""), ("fr", " \t "), ("xx", "one two"), ("en", "Run on " * 3000), ("en", "w" * 100_000)] + [("en", "same text again. same text again")] * 20
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = phrases.collocations(clashing(df).repartition(3), max_words=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, most=most)


def test_ranks_end_at_the_top_and_ties_go_by_phrase(spark):
    rows = [("en", f"k{i:03} v{i:03}. " * 10) for i in range(60)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, phrases.collocations(df, top=25).collect()))
    assert got == plain_phrases(rows, top=25) and len(got) == 25 and got[0][2] == "k000 v000"
    assert phrases.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_shards_of_any_size_count_the_same(monkeypatch, depth):
    rng = random.Random(depth)
    rows = [(rng.choice("ab"), t) for t in texts(rng, 60, ["u", "v", "w", "longer"])]
    want = defaultdict(Counter)
    for lang, t in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            words = piece.split()
            for m in range(1, depth + 1):
                want[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for shard_words, slice_bytes in ((1 << 30, 1 << 20), (40, 1 << 20), (25, 30), (1, 7)):
        monkeypatch.setattr(phrases, "SHARD_WORDS", shard_words)
        monkeypatch.setattr(phrases, "SLICE", slice_bytes)
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 7]]), pa.array([r[1].encode() for r in rows[i : i + 7]], pa.binary())], names=["lang", "text"]) for i in range(0, len(rows), 7)]
        got = defaultdict(Counter)
        for shard in phrases.shards(iter(batches), depth):
            a, spelled = shard.automaton(depth), list(shard.vocabulary)
            for m in range(1, depth + 1):
                for s in np.flatnonzero(a.count[m]).tolist():
                    got[shard.lang][tuple(spelled[w[0]].decode() for w in a.spelled(m, np.array([s])))] += int(a.count[m][s])
        assert got == want


def test_suffix_links_and_counts():
    a = phrases.Automaton(np.array([1, 2, 1, 2, 3, 0, 2, 3]), 4, 3)
    for m in (2, 3):
        for s in range(1, len(a.link[m])):
            mine = [int(w[0]) for w in a.spelled(m, np.array([s]))]
            assert [int(w[0]) for w in a.spelled(m - 1, a.link[m][[s]])] == mine[1:]
            assert [int(w[0]) for w in a.spelled(m - 1, a.prefix[m][[s]])] == mine[:-1]
            assert a.count[m - 1][a.link[m][s]] >= a.count[m][s]
    assert a.words == 7 and sorted(a.count[1].tolist()) == [0, 2, 2, 3]


# clustering ------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    final = [(i, *nearest(v)) for i, v in kept]
    long = lambda x: x if x < 1 << 63 else None
    inertia = Counter()
    for _, d, j in final:
        inertia[j] += d
    return sorted(((i, j, long(d), long(inertia[j]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in final), key=repr)


def clusters(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted(map(tuple, clustering.cluster(clashing(df).repartition(3), **more).collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 2, (6, 4))
    rows = [(i, np.float32(middles[i % 6] + rng.normal(0, 0.3, 4)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -1.0]) for i in range(200)]  # copies
    rows += [(2000, None), (2001, [1.0]), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, []), (1, [9.0] * 4), (1, [9.0] * 4), (None, [1.0] * 4)]
    for k, rounds in ((7, 5), (1, 2), (40, 3)):
        assert clusters(spark, rows, k=k, rounds=rounds, dim=4) == plain_clusters(rows, k, rounds, 4)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]
    for k in (2, 5, 100):
        assert clusters(spark, rows, k=k, rounds=3, dim=2, scale=1.0) == plain_clusters(rows, k, 3, 2, 1)
    assert clusters(spark, [], k=3, rounds=2, dim=2) == []


def test_components_of_any_size_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.1, 3e4, -7e8, 1e20, 2.0**40 + 1]) * rng.randrange(-3, 4) for _ in range(3)]) for i in range(60)]
    assert clusters(spark, rows, "double", k=4, rounds=3, dim=3) == plain_clusters(rows, 4, 3, 3)


def test_trees_give_what_comparing_all_gives():
    rng = np.random.default_rng(4)
    x = np.floor(np.concatenate([rng.normal(0, 300, (3000, 5)), rng.normal(5000, 20, (3000, 5)), np.full((500, 5), 77.0)]))
    tree, order = clustering.Tree.build(x)
    assert (tree.points == x[order]).all() and (tree.spans[:, 2] == -1).sum() > 50
    for j in range(len(tree.spans)):
        part = tree.points[tree.spans[j, 0] : tree.spans[j, 1]]
        assert (tree.sums[j] == part.sum(axis=0)).all() and tree.radii[j] == ((part - np.floor(part.mean(axis=0))) ** 2).sum(axis=1).max()
    c = whole = clustering.whole_numbers(x[rng.integers(0, len(x), 9)])
    label, balls = tree.assign(c)
    assert (label == np.argmin(clustering.squares(tree.points, c), axis=1)).all() and balls
    counts, sums, with_ball = tree.totals(whole)
    assert with_ball >= 3000 and all(counts[j] == (label == j).sum() and (sums[j] == tree.points[label == j].sum(axis=0)).all() for j in range(9))


def test_limbs_add_up():
    for v in (0, 1, -1, 2**32, -(2**95) - 12345, 10**40):
        assert sum(x << 32 * at for at, x in clustering.limbs(v)) == v
