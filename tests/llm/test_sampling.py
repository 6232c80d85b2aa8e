"""Importance resampling, hard negatives and URL filters against brute-force versions and edge cases."""

import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routesift.llm import hardneg, resampling, urlfilter

# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " ", "\n", "a", "One two; three", "one TWO three one two", "é É ß 9x_y", "word " * 40_000, "b\x00c", "same words here again", "same words here again", "\u3000wide space", "x" * 100_000]


def slow_features(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def slow_ranks(docs, target, n, buckets, min_words, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for texts, counts in ((([x for _, x in docs]), s), (target, t)):
        for text in texts:
            for f in slow_features(text, n)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for ident, text in docs:
        words, features = slow_features(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        rows.append([ident, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_brute_force(spark, n):
    rng = random.Random(n)
    made = [" ".join(rng.choice("alpha beta gamma Delta it's 7 no".split()) for _ in range(rng.randrange(30))) for _ in range(200)]
    docs = [*enumerate(TEXTS + made), (3, "one two"), (3, "one two"), (None, "one two three"), (None, None)]
    target = ["one two three", None, "alpha beta", ""]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, importance int").repartition(5)
    got = resampling.importance_ranks(frame, spark.createDataFrame([(t,) for t in target], "text string"), n, 50, 3, 40, "seed")
    assert sorted(map(tuple, got.collect()), key=repr) == slow_ranks(docs, target, n, 50, 3, 40, "seed")
    kept = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), n, 50, 3, 40, "seed").collect()
    drawn = [r for r in slow_ranks(docs, target, n, 50, 3, 40, "seed") if r[5] is not None]
    assert {r["doc_id"] for r in kept} == {r[0] for r in drawn} and len(drawn) <= len(kept) <= len(drawn) + 1


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_ranks(none, docs).collect() == []
    assert resampling.resample(none, docs).collect() == []
    assert [(r["n_features"], r["rank"]) for r in resampling.importance_ranks(docs, none, min_words=1, percent=100).collect()] == [(2, 1)]


def test_pieces_hold_every_text_once():
    column = pa.array(TEXTS)
    for limit in (1, 50, 1 << 20):
        assert [t for p in resampling.by_bytes(column, limit) for t in p.to_pylist()] == TEXTS


# Hard negatives


def slow_negatives(rows, positives=5, negatives=5, every=100, low=80, high=100):
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for anchor, label, vec in {(i, lab, tuple(v)) for i, lab, v in fine if i % every == 0}:
        scored = sorted((-dot(vec, v), i, lab) for i, lab, v in fine if i != anchor)
        for score, ident, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(i, -s) for s, i, lab in scored if lab != label and low * -score <= 100 * -s <= high * -score][:negatives]
            out += [(anchor, ident, rank, i, -score, s) for rank, (i, s) in enumerate(hard, 1)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(3)


def mined(spark, rows, **settings):
    return sorted(map(tuple, hardneg.hard_negatives(vectors_of(spark, rows), **settings).collect()))


def test_negatives_equal_brute_force_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.1).tolist(), int(rng.integers(4))) for i in range(1500)]
    expected = slow_negatives(rows, every=30)
    assert len(expected) > 500 and mined(spark, rows, every=30) == expected


def test_negatives_on_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist(), i % 3) for i in range(60)]
    rows += [(i, [1.0, 0.5, 0.25], i % 2) for i in range(60, 120)]  # copies, ties
    rows += [(200, None, 1), (201, [1.0, None, 0.0], 1), (202, [float("nan"), 1.0, 1.0], 1), (203, [float("inf"), 1.0, 1.0], 1), (204, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(210, [], 1), (220, [0.0, 0.0, 0.0], 2), (230, [2.0], 0), (61, [1.0, 0.5, 0.25], 1), (61, [1.0, 0.5, 0.25], 1), (30, [0.5, 0.5, 0.5], 0), (30, [0.5, 0.5, 0.5], 0), (240, [-1e4, 3e4, 2e4], 1), (250, [-3.0, -1.0, -2.0], 2)]
    assert mined(spark, rows, every=10) == slow_negatives(rows, every=10)
    assert mined(spark, rows, every=10, positives=2, negatives=7, low=-50, high=110) == slow_negatives(rows, 2, 7, 10, -50, 110)
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 0)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e9, 1e9], 0), (1, [1e9, 1e9], 1)])


def test_trees_cover_their_rows_and_descents_skip_nodes():
    rng = np.random.default_rng(7)
    vecs = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(40, size=2000)] + rng.normal(size=(2000, 16)) * 0.05)).astype(np.int16)
    longest = float((vecs.astype(float) ** 2).sum(1).max())
    points = np.column_stack([vecs, np.sqrt(longest - (vecs.astype(float) ** 2).sum(1))])
    order, nodes = hardneg.grow(points)
    assert sorted(order) == list(range(2000)) and len(nodes) > 10
    points, vecs = points[order], vecs[order]
    radii = np.array([np.sqrt(((points[a:b] - points[c]) ** 2).sum(1)).max() for c, a, b in nodes[:, :3]])
    for at, (_, first, end, child, children) in enumerate(nodes):
        if children:
            assert (nodes[child : child + children, 1] == [first, *nodes[child : child + children - 1, 2]]).all() and nodes[child + children - 1, 2] == end
            assert (radii[child : child + children] <= radii[at] / 2 * 1.001).all()
    ids, labels, asked = np.arange(2000), rng.integers(3, size=2000), np.arange(0, 2000, 100)
    windows = np.array([(i, 0, hardneg.LEAST, hardneg.MOST, hardneg.LEAST) for i in range(len(asked))]).T
    search = hardneg.Search(asked, ids[asked], labels[asked], vecs[asked], windows, True, 5, longest, np.float64)
    search.descend(ids, labels, vecs, nodes, radii)
    assert search.compared < len(asked) * 2000 / 2
    for i, a in enumerate(asked):
        scores = vecs.astype(np.int64) @ vecs[a].astype(np.int64)
        best = sorted((-scores[j], j) for j in range(2000) if labels[j] == labels[a] and j != a)[:5]
        assert list(zip(-search.scores[i], search.ids[i], strict=True)) == best


# URL filters

URLS = [
    None, "", "no scheme/here", "http://", "http://Example.COM/en/1", "https://www.example.com/en/x?y#z", "http://wwwexample.com/en/", "http://a.b.net/fr/", "http://net/es/a/b", "http://net/de/", "ftp://user@com:80/x",
    "http://com", "http://com/", "http://x.com?q=/en/", "http://x.com#/", "a://b://c.com/", "http://deep.er.www.example.com/en/", "http://com./", "http://é.example.com/en/é", "http://x.net/" + "long/" * 20_000, "http://" + "a." * 5_000 + "com/", "http://x.org/en/", "http://line\nbreak.com/en/",
]


def slow_filter(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[1]), rest[2]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("settings", [{}, {"file_bytes": 0, "shard_bytes": 100}])
def test_urls_equal_brute_force(spark, settings):
    rules = [*urlfilter.RULES, ("example.com", "/", "allow"), ("é.example.com", "/en/é", "allow"), ("deep.er.www.example.com", "", "block"), ("x.com", "/a", "block"), ("", "", "block")]
    odd = [(None, "/", "allow"), ("org", None, "block"), ("org", "/", None), ("org", "/", "maybe"), ("COM", "/", "allow"), ("x.org", "/en/", "allow"), ("x.org", "/en/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "f") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, filter string").repartition(3)
    table = spark.createDataFrame(rules + odd, "host string, path string, verdict string")
    got = urlfilter.filter_urls(pages, table, "allow", **settings)
    assert got.columns == ["page_id", "url", "host", "filter"]
    expected = [(i, u, "h", slow_filter(u, [*rules, ("x.org", "/en/", "block")], "allow")) for i, u in enumerate(URLS + URLS)]
    assert sorted((r[0], r[1], r[2], tuple(r[3])) for r in got.collect()) == sorted(expected, key=lambda r: r[0])
    assert urlfilter.filter_urls(pages.limit(0), table, **settings).collect() == []
    none = urlfilter.filter_urls(pages, table.limit(0), "block")
    assert {(r["filter"]["rule"], r["filter"]["verdict"]) for r in none.collect()} == {(None, "block")}


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urlfilter, "xxhash", types.SimpleNamespace(xxh64_intdigest=lambda key: 7))
    rules = [(h, p, v == "block") for h, p, v in urlfilter.RULES]
    array = urlfilter.Rules(np.frombuffer(urlfilter.Rules.pack(rules), np.uint8))
    for url in URLS[4:]:
        host, path, rule, verdict = slow_filter(url, urlfilter.RULES, "allow")
        found = array.judge([host.encode()], [path.encode()])[0]
        assert (found and found["host"] + found["path"]) == rule and (found is None or found["blocked"] == (verdict == "block"))


def test_many_rules_of_one_host():
    rules = [("big.com", f"/{i}/", bool(i % 2)) for i in range(20_000)] + [("com", "/", False)]
    array = urlfilter.Rules(np.frombuffer(urlfilter.Rules.pack(rules), np.uint8))
    got = array.judge([b"www.big.com", b"big.com", b"big.com", b"x.com"], [b"/19999/a", b"/4/", b"/20000/", b"/7/"])
    assert got == [{"host": "big.com", "path": "/19999/", "blocked": True}, {"host": "big.com", "path": "/4/", "blocked": False}, {"host": "com", "path": "/", "blocked": False}, {"host": "com", "path": "/", "blocked": False}]


def test_files_of_rules_reach_the_tasks(spark):
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".net/es/")).alias("url")).repartition(8)
    rules = spark.createDataFrame([(f"h{i}.net", "/", "allow") for i in range(0, 50, 2)] + [("net", "/es/", "block")], "host string, path string, verdict string")
    verdicts = urlfilter.filter_urls(pages, rules).groupBy("filter.verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in verdicts} == {"allow": 500, "block": 500}  # h0.net/ is as long as net/es/, its host longer


# Repairs of earlier operators


def test_licence_files_are_named_rightly_or_not_at_all(spark):
    import os

    from routesift.llm import licenses

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    names = sorted(n for n in os.listdir(folder))
    rows = [(f"{n}/LICENSE", open(f"{folder}/{n}", encoding="utf-8", errors="replace").read()) for n in names]
    got = {r["path"].split("/")[0]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    right = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "GPL": "GPL-3.0", "LGPL": "LGPL-3.0"}
    assert {n: x for n, x in got.items() if x is not None} == {n: x for n, x in right.items() if n in got}


def test_notices_head_files_and_rule_no_directory(spark):
    from routesift.llm import licenses

    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/x", f"one\n{notice}"), ("a/y", "plain text"), ("b/COPYING", notice), ("b/y", "plain text"), ("c/x", "This library is licensed under the GNU General Public License, version 2."), ("c/y", None)]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x": ("GPL-3.0", "header"), "a/y": (None, "none"), "b/COPYING": ("GPL-3.0", "file"), "b/y": ("GPL-3.0", "inherited"), "c/x": ("GPL-2.0", "header"), "c/y": (None, "none")}


def test_ruling_files_of_equal_cosine(spark):
    from routesift.llm import licenses

    rows = [("a/LICENSE", "SPDX-License-Identifier: MIT"), ("a/COPYING", "SPDX-License-Identifier: ISC"), ("a/y", "plain text")]
    got = {r["path"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/y"] in ("MIT", "ISC") and got["a/LICENSE"] == "MIT" and got["a/COPYING"] == "ISC"


@pytest.mark.parametrize("offset", [-60_000, -20_000, -300, 0, 300, 20_000])
def test_secrets_in_wrapped_base64_across_windows(offset):
    import base64
    import gzip

    from routesift.llm import secrets

    rng = random.Random(2)
    filler = lambda n: "".join(rng.choice(["lorem ", "ipsum\n", "dolor "]) for _ in range(n // 6)).encode()
    inner = base64.encodebytes(gzip.compress(b"password=supersecret99 " + bytes(rng.randrange(256) for _ in range(27_000))))
    layer = filler(secrets.WINDOW + offset) + b"\n\n" + inner + b"\n" + filler(200_000)
    _, spans, oversized = secrets.scan("x " + base64.b64encode(gzip.compress(layer)).decode())
    assert [k for _, k, _ in spans] == ["assign"] and oversized == 0


def test_windows_of_one_wrapped_run_are_counted():
    from routesift.llm import secrets

    line = b"QUJD" * 19 + b"\n"
    chunks = [line * 10_000] * 60
    parts = list(secrets._windows(iter(chunks)))
    assert any(lost for _, lost in parts) and sum(len(p) for p, _ in parts) >= len(line) * 600_000
    words = [b"word\nlist\nof\nlines\n" * 50_000] * 12
    assert not any(lost for _, lost in secrets._windows(iter(words)))


def test_secrets_between_the_first_and_the_last_layer():
    from routesift.llm import secrets

    assert [k for _, k, _ in secrets.scan("%2525dapi_key%253Dabcdefgh12")[1]] == ["assign"]
    deep = "%" + "25" * 100 + "41 password=%61%62cdefgh12"
    _, spans, oversized = secrets.scan(deep)
    assert "assign" in {k for _, k, _ in spans} and oversized == 1


def test_repeated_ids_train_once(spark):
    from routesift.llm import toxicity

    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["good", "fine", "nice", "bad", "awful"][i % 2 * 2 :]) for _ in range(20))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (1, 0)], "doc_id long, toxic int")
    one = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    many = toxicity.fit(spark.createDataFrame(texts + [texts[7]] * 500, "doc_id long, text string"), labels)
    assert (one.at == many.at).all() and np.allclose(np.sort(one.weight), np.sort(many.weight))
    assert {r["doc_id"]: r["label"] for r in toxicity.sample(labels).collect()}[1] == 0


def test_sites_of_urls_raise_held_out_quality(spark):
    from conftest import SF

    from routesift.llm import common, quality

    def auc(scored):
        good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
        return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))

    rng = random.Random(12)
    seen = [r["url"] for r in common.read_table(spark, SF, "pages").select("url").collect()]  # the hosts' names are those of the table
    hosts = sorted({re.match(r"[a-z]+://([^/?#]+)", u)[1].lower() for u in seen})[:40]
    sizes = {h: (80 if i % 4 == 0 else rng.randrange(1, 4)) for i, h in enumerate(hosts)}
    rate = {h: rng.choice([0.05, 0.5, 0.95]) for h in hosts}
    rows, labels = [], {}
    for h in hosts:
        for _ in range(sizes[h]):
            i, y = len(rows), int(rng.random() < rate[h])
            words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)]
            for mark in ("!", "|", "#", "9"):  # weak signs, each turned about in four of ten documents
                if (rng.random() < 0.4) == bool(y):
                    words[rng.randrange(30)] += mark
            rows.append((i, f"https://{h}/en/{i}?q=1", " ".join(words)))
            labels[i] = y
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string").repartition(3)
    known = spark.createDataFrame([(i, y) for i, y in labels.items() if i % 2], "doc_id long, quality int")
    got = quality.score_documents(docs, known, site=quality.url_site()).collect()
    held = [r for r in got if r["doc_id"] % 2 == 0]
    alone, joined = (auc([(r[c], labels[r["doc_id"]]) for r in held]) for c in ("evidence", "quality_score"))
    assert joined > alone + 0.01
    assert {r["path"] for r in got} == {"/en/"} and {r["host"] for r in got} == set(hosts)
    prior = sum(labels[i] for i in labels if i % 2) / sum(1 for i in labels if i % 2)
    apart = {n: np.mean([abs(r["host_rate"] - prior) for r in got if (sizes[r["host"]] > 3) == n]) for n in (True, False)}
    assert apart[False] < apart[True]  # sparse hosts stay near the global rate
