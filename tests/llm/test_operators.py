"""The training-text operators against brute-force versions, SQL and edge cases."""

import base64
import bz2
import gzip
import hashlib
import importlib.util
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF, same_rows
from pyspark.sql import functions as F

from routesift.llm import bpe, common, licenses, linededup, mixing, neardup, quality, queries, secrets, simhash, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id string, fp string, score string, keep string, _dir string, rate string, host_rate string, cleaned string, copy string"


def docs_of(spark, texts, source="s"):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t), *["x"] * 9) for i, t in enumerate(texts)], DOC)


EDGES = [None, "", " ", "\n\n", "a", "a b", "word " * 30_000, "same text here\nline", "same text here\nline", "é" * 5000, "tab\tsep\r\nx"]


def documents(spark):
    return common.read_table(spark, SF, "documents")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


# SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(fps, bits=3):
    forest = common.Forest()
    for (a, x), (b, y) in itertools.combinations(fps.items(), 2):
        if (x ^ y).bit_count() <= bits:
            forest.join(a, b)
    return {d: forest.root(d) for d in fps}


def test_fingerprints(spark):
    rows = simhash.with_fingerprint(documents(spark)).select("text", simhash.fingerprint_text().alias("h")).collect()
    for r in rows[:80]:
        assert r["h"] == f"{slow_fingerprint(r['text']):016x}"


def test_simhash_components(spark):
    got = queries.op4_simhash(spark, SF).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components(fps)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 200, dtype=np.uint64)
    y = x.copy()
    for i in range(200):
        for b in rng.choice(64, 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    row, key, home = simhash.anchors_of(x)
    homes = {(r, k) for r, k in zip(row[home].tolist(), key[home].tolist(), strict=True)}
    row, key, _ = simhash.anchors_of(y)
    near = set(zip(row.tolist(), key.tolist(), strict=True))
    assert all(any((i, k) in near for r, k in homes if r == i) for i in range(200))


def test_dense_cluster_is_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_HOMES", 8)
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    rng = np.random.default_rng(2)
    fps = {int(f): i for i, f in enumerate(sorted({int(np.uint64(0xABCDEF) ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))) for a, b in rng.integers(0, 63, (300, 2))}))}
    df = spark.createDataFrame([(f, n) for f, n in fps.items()], "fp long, node long")
    roots = {r["node"]: r["root"] for r in common.connected_components(simhash.links(df)).collect()}
    want = slow_components({n: f for f, n in fps.items()})
    assert {n: roots.get(n, n) for n in want} == want


def test_simhash_edges(spark):
    d = docs_of(spark, EDGES)
    got = {r["doc_id"]: r for r in simhash.simhash_components(d).collect()}
    assert len(got) == len(EDGES)
    assert [got[i]["fp"] for i in (0, 1, 2, 3)] == [0] * 4 and {got[i]["component_id"] for i in range(4)} == {0}
    assert got[8]["component_id"] == 7
    assert simhash.simhash_components(d.limit(0)).count() == 0
    nameless = simhash.simhash_components(d.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert {r["component_id"] for r in nameless} == {None}
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns or set(kept.columns) == set(d.columns)
    assert {0, 7} <= {r["doc_id"] for r in kept.collect()} and 8 not in {r["doc_id"] for r in kept.collect()}


def slow_wide(text):
    """The wide fingerprint by plain loops over distinct shingles."""
    words, top = (text or "").encode().lower().split(), 2**64
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(w, 42) for w in words]
    if len(h) < 5:
        shingles = {xxhash.xxh64_intdigest(b" ".join(words), 42)}
    else:
        shingles = {sum(h[i + j] * simhash.PLACES[j] for j in range(5)) % top for i in range(len(h) - 4)}
    out = 0
    for lane in range(4):
        odd = pow(simhash.PLACES[0], 3 + lane, top)
        ones = [0] * 64
        for x in shingles:
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % top
            x = (x ^ x >> 31) * odd % top
            x ^= x >> 32
            for b in range(64):
                ones[b] += x >> b & 1
        out |= sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles)) << 64 * lane
    return out


def test_wide_fingerprints():
    hashes = simhash.WordHashes()
    for text in [t for t in EDGES if t is None or len(t) < 50_000] + ["a b c d e f a b c d e f g " * 30]:
        assert int.from_bytes(simhash.wide_fingerprint((text or "").encode(), 3, hashes)[0], "little") == slow_wide(text), text


def test_golay_anchors():
    code, rnd = simhash.Golay(), np.random.default_rng(3)
    words = rnd.integers(0, 1 << 23, 3000)
    row, word, home = code.near(words)
    assert (np.bitwise_count(words[row] ^ word) <= 4).all() and (np.bitwise_count(words[row] ^ word)[home] <= 3).all() and home.sum() == len(words)
    assert len(np.unique(code.near(np.arange(1 << 23))[1])) == 4096
    flipped = words ^ (1 << rnd.integers(0, 23, 3000))
    row2, word2, _ = code.near(flipped)
    mine = set(zip(row2.tolist(), word2.tolist(), strict=True))
    assert all((r, w) in mine for r, w in zip(row[home].tolist(), word[home].tolist(), strict=True))


def test_near_groups_recall(spark):
    """Copies with single words replaced, by Jaccard similarity of five-word shingles; unrelated texts stay alone."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, near = [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for n in range(300):
        words = rnd.choices(vocabulary, k=rnd.randrange(100, 400))
        other = list(words)
        for j in rnd.sample(range(len(words)), max(1, len(words) * rnd.choice([5, 10, 18]) // 1000)):
            other[j] = rnd.choice(vocabulary)
        a, b = shingles(words), shingles(other)
        if len(a & b) / len(a | b) >= 0.8:
            near.append(2 * n)
        texts += [" ".join(words), " ".join(other).upper()]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs_of(spark, texts)).collect()}
    assert len(near) > 200 and sum(got[i] == got[i + 1] for i in near) / len(near) >= 0.95
    assert all(got[i] in (i, i - 1, i + 1) for i in got)


def test_near_groups_edges(spark):
    d = docs_of(spark, [*EDGES, "one two three four five six", "one two three four five six"])
    d = d.unionByName(d.where("doc_id < 2")).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("nameless words")))
    got = {}
    for r in simhash.near_groups(d).collect():
        got.setdefault(r["doc_id"], set()).add(r["group_id"])
    assert got[0] == got[1] == got[2] == got[3] == {0} and got[7] == got[8] == {7} and got[11] == got[12] == {11} and got[None] == {None}
    assert simhash.keep_one(d).where("doc_id is null").count() == 1 and simhash.keep_one(d).columns == d.columns
    assert simhash.near_groups(d.limit(0)).count() == 0


def test_more_rows_take_more_bits_and_parts():
    (a, b), (c, e) = simhash.cover_of(10**6), simhash.cover_of(10**10)
    assert a == 0 and c > a and e > b


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(500, 500), (700, 701), (701, 700)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 701: 700}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# Line deduplication


def slow_lines(texts, least):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            count[k] = count.get(k, 0) + 1
    kept = [[x for x in lines if not (key(x) and count[key(x)] >= least)] for lines in split]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(split, kept, strict=True)]


@pytest.mark.parametrize("limit", [linededup.BROADCAST_BYTES, -1])
def test_lines_by_broadcast_filters_and_by_shard(spark, limit):
    texts = EDGES + [f" Header {i % 3} \nbody {i}\n\nFOOTER " for i in range(30)] + ["É\né"] * 3
    got = {r["doc_id"]: tuple(r["cleaned"]) for r in linededup.dedup_lines(docs_of(spark, texts), 3, limit).collect()}
    assert [got[i] for i in range(len(texts))] == slow_lines(texts, 3)


def test_lines_are_reversible(spark):
    base, more = [f"a{i}\ncommon" for i in range(4)], [f"b{i}\ncommon\nfoot" for i in range(6)]
    one, two = docs_of(spark, base), docs_of(spark, more).withColumn("doc_id", F.col("doc_id") + 100)
    start = linededup.build(one, 5, 2)
    grown = linededup.insert(start, two)
    texts = {r["doc_id"]: r["cleaned"]["text"] for r in linededup.apply(grown, one.unionByName(two)).collect()}
    assert texts[0] == "a0" and texts[100] == "b0"
    back = linededup.delete(grown, two)
    assert {r["doc_id"]: r["cleaned"]["text"] for r in linededup.apply(back, one).collect()} == dict(enumerate(base))
    as_set = lambda s: {(bytes(r["key"]), r["n_docs"]) for r in s.counts.collect()}
    assert as_set(back) == as_set(start)


def test_keys_pass_at_their_shards(spark):
    texts = [f"line {i % 40}\nother {i}\nthird {i // 3}" for i in range(400)]
    state = linededup.build(docs_of(spark, texts), 3, shards=8)
    got = {bytes(r["key"]) for r in linededup.passing(state, state.counts.select("shard", "key")).collect()}
    want = {bytes(r["key"]) for r in state.counts.where("n_docs >= 3").collect()}
    assert want <= got and len(got - want) < 5 and len(want) > 100


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys, others = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64), rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert linededup.CuckooFilter.load(f.dump()).contains(keys[2500:]).all()


def test_lines_empty_table(spark):
    assert linededup.dedup_lines(docs_of(spark, EDGES).limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


CODED = [*EDGES, "a<|endoftext|>b  <|endoftext|>", "  x  \n\n y\t\r z", "don't we'll I'M", "a\u0085b", "日本語テキスト😀👍🏽", "aaaa" * 3000, "%%%$$ $$", "1²³½٣"]


def test_bpe_equals_the_library(spark, tokenizer):
    texts = CODED + [r["text"] for r in documents(spark).limit(60).collect()]
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(spark, texts), queries.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["coded"]["ids"] == ids
        assert got[i]["coded"]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def coded(vocabulary, texts):
    coder = bpe.Coder(vocabulary)
    return [x for c in bpe.text_batches(iter([pa.array(texts, pa.string())])) for x in bpe.code(coder, c).to_pylist()]


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.vocabulary_path(), "rb") as f:
        return bpe.Vocabulary(f.read())


def same_as_library(vocabulary, tokenizer, texts):
    for t, got in zip(texts, coded(vocabulary, texts), strict=True):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got["ids"], got["decoded"]) == (ids, tokenizer.decode(ids, skip_special_tokens=False)), t


@pytest.mark.parametrize("context", ["{}", "a{}b", " {} '"])
def test_every_code_point(vocabulary, tokenizer, context):
    points = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    same_as_library(vocabulary, tokenizer, ["\n".join(map(context.format, points[i : i + 64])) for i in range(0, len(points), 64)])


def test_random_texts(vocabulary, tokenizer):
    parts = [*" \n\t\r\u00a0\u3000''sstdmrvel1²éд,.<|😀\u0301", "<|endoftext|>", "'s", "'re", "'ll", "  ", " '", "x" * 60]
    rnd = random.Random(5)
    same_as_library(vocabulary, tokenizer, ["".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(20000)])


def test_long_texts_are_cut_between_pieces(vocabulary, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 50)
    same_as_library(vocabulary, tokenizer, ["it's 5 words \n\n and  more, " * 40, "x" * 3000, "<|endoftext|> a " * 30, "short", ""])


def test_unknown_settings_are_refused(spark, tmp_path):
    data = json.loads(open(queries.vocabulary_path(), encoding="utf-8").read())
    data["normalizer"] = {"type": "NFC"}
    (tmp_path / "v.json").write_text(json.dumps(data))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.encode_decode(docs_of(spark, ["a"]), str(tmp_path / "v.json"))


def test_bpe_digests(spark, tokenizer):
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, SF).collect()}
    rows = documents(spark).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_bpe_empty_table_and_clashing_column(spark):
    d = docs_of(spark, ["a"]).withColumn("coded", F.lit(1))
    assert bpe.encode_decode(d, queries.vocabulary_path()).first()["coded"]["decoded"] == "a"
    assert bpe.encode_decode(d.limit(0), queries.vocabulary_path()).count() == 0


def test_forced_boundaries_are_in_no_token(vocabulary):
    v = vocabulary
    assert not any(v.forced[a, b] for t in v.bytes[:50256] for a, b in itertools.pairwise(t))
    raw = np.frombuffer("Ünïcödé".encode(), np.uint8)
    assert all(v.forced[raw[i - 1], raw[i]] for i in v.cuts(raw, np.zeros(1, np.int64))[1:])


# Secrets


def slow_base(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(((a, ("assign", "access", "hex").index(k), k, b) for k, a, b in found))


def test_base_secrets(spark):
    planted = ["Api_Key: 'abcdefgh1'", "token=short", "é AKIA" + "A1" * 8, "AKIA123", "f" * 40, "PASSWD = x.y-z/w=" + "q" * 9, "toKen=abcdefghij", "secret=token=abcdefgh"]
    texts = EDGES + planted + [r["text"] for r in documents(spark).collect()]
    rows = secrets.scan_secrets(docs_of(spark, texts)).select("doc_id", secrets.spans_text("found.base").alias("b")).collect()
    got = {r["doc_id"]: r["b"] for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in slow_base(t))


@pytest.mark.parametrize("wrap", ["base64", "gzip", "zlib", "percent", "unicode", "nested"])
def test_wrapped_secrets(wrap):
    secret = "password=hunter2hunter2"
    b64 = lambda b: base64.b64encode(b).decode()
    quoted = "".join(f"%{ord(c):02x}" for c in secret)
    hidden = {"base64": b64(secret.encode()), "gzip": b64(gzip.compress(secret.encode())), "zlib": b64(zlib.compress(secret.encode())), "percent": quoted, "unicode": "".join(f"\\u{ord(c):04x}" for c in secret), "nested": b64(gzip.compress(b64(quoted.encode()).encode()))}[wrap]
    text = f"é prefix {hidden} suffix"
    base, every, oversized = secrets.scan(text)
    assert oversized == 0 and not [s for s in base if s[1] == "assign"]
    at = text.index(hidden)
    found = [s for s in every if s[1] == "assign"]
    assert found and all(at <= s[0] < s[2] <= at + len(hidden) for s in found)


def spans_of(text, kind="assign"):
    return [(a, b) for a, k, b in secrets.scan(text)[1] if k == kind]


def test_bad_bytes_spoil_only_themselves():
    secret = "password=hunter2hunter2"
    quoted, escaped = "".join(f"%{ord(c):02x}" for c in secret), "".join(f"\\u{ord(c):04x}" for c in secret)
    assert spans_of(f"caf%E9/{quoted}") == [(7, 7 + len(quoted))]
    for smile in ("\\ud83d\\ude00", "\\ud83d", "\\ude00"):
        assert spans_of(f'{{"x":"{smile}","y":"{escaped}"}}') == [(13 + len(smile), 13 + len(smile) + len(escaped))]
    raw = bytes(range(128, 256)) + b"\x00\xe2\x82" + secret.encode() + bytes(range(128, 256))
    at = 131
    assert spans_of(base64.b64encode(raw).decode()) == [(at // 3 * 4, (at + len(secret) - 1) // 3 * 4 + 4)]
    text, first, last = secrets._characters("aé\u20ac\U0001f600".encode() + b"\xff\xe2\x82z")
    assert (text, first.tolist(), last.tolist()) == ("aé\u20ac\U0001f600\ufffd\ufffd\ufffdz", [0, 1, 3, 6, 10, 11, 12, 13], [0, 2, 5, 9, 10, 11, 12, 13])


@pytest.mark.parametrize("outer", [gzip.compress, zlib.compress, bz2.compress])
@pytest.mark.parametrize("inner", [gzip.compress, zlib.compress, bz2.compress])
def test_compressed_layers_within_each_other(outer, inner):
    b64 = lambda b: base64.b64encode(b).decode()
    secret = b"password=hunter2hunter2 caf\xe9"
    for packed in (outer(inner(secret)), outer(b"nothing here ") + inner(secret), outer(b"nothing") + secret, outer(b"x " + b64(inner(b"".join(b"%%%02x" % c for c in secret))).encode())):
        hidden = b64(packed)
        assert spans_of(f"é {hidden} z") == [(2, 2 + len(hidden))]
    deep = secret
    for _ in range(20):
        deep = outer(inner(deep))
    assert spans_of(b64(deep))


def test_large_layers_are_searched_whole():
    pack = lambda b: gzip.compress(b, 1)
    secret, words = b"password = hunter2hunter2", b"some plain words\n" * 600_000
    quoted = b"".join(b"%%%02x" % c for c in secret)
    for inside in (secret + b" " + words, words + secret, words + quoted + b" " + words, words + base64.b64encode(pack(words + secret)), pack(words + quoted), b"word " * 2_000_000 + b"token:" + b" " * 9_000_000 + b"abcdefgh"):
        hidden = base64.b64encode(pack(inside)).decode()
        assert secrets.scan(f"é {hidden} z")[1:] == ([(2, "assign", 2 + len(hidden))], 0)
    assert secrets.scan(base64.b64encode(pack(words)).decode())[1:] == ([], 0)


def test_parts_of_a_layer_cut_no_match(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["token", "secret:", "=", "abcdefghij", "%74oken%3dabcdefgh", "x", '"', "é", "\n", " ", "  ", "0123456789abcdef0123456789abcdef", "AKIA0123456789AB", base64.b64encode(b"passwd=12345678").decode()]
    texts = ["".join(rng.choice(words, 30)).encode() for _ in range(300)]
    whole = [secrets._kinds(iter([x])) for x in texts]
    assert len({frozenset(k) for k, _ in whole}) > 3
    monkeypatch.setattr(secrets, "WINDOW", 16)
    assert [secrets._kinds(x[i : i + 5] for i in range(0, len(x), 5)) for x in texts] == whole
    monkeypatch.setattr(secrets, "STRETCH", 8192)
    hidden = base64.b64encode(gzip.compress(b"." * 20_000 + b"token=abcdefgh" + b"." * 20_000)).decode()
    monkeypatch.setattr(secrets, "CHUNK", 100)
    kinds, cut = secrets._kinds(iter([base64.b64decode(hidden)]))
    assert kinds == {"assign"} and cut > 0
    assert "n_oversized" in queries.op7_secrets(spark, SF).columns


SECRET = "password=hunter2hunter2"


def test_nested_escapes_take_linear_time():
    start = time.process_time()
    for text in ("%" + "25" * 50_000 + "41", "\\" + "u005c" * 20_000 + "u0041", "%5Cu0025" + "5Cu0025" * 10_000 + "41", "%%" * 30_000, "A" * 100_000, ("A" * 60 + " ") * 2000):
        secrets.scan(text)
    assert time.process_time() - start < 20


def test_deep_escapes_are_unwrapped():
    for text in ("%" + "25" * 40 + "70assword=hunter2hunter2", "x " + "".join(f"%2525{ord(c):02x}" for c in SECRET), "x " + "".join(f"\\u005cu{ord(c):04x}" for c in SECRET), "x " + "".join(f"%5Cu{ord(c):04X}" for c in SECRET)):
        a, b = text.index("%" if "%" in text else "\\"), len(text)
        assert ("assign", a, b) in [(k, x, y) for x, k, y in secrets.scan(text)[1]], text


def test_wide_characters_and_wrapped_base64():
    for codec in ("utf-16-le", "utf-16-be"):
        z = base64.b64encode(SECRET.encode(codec)).decode()
        assert spans_of("x " + z)
    rnd = random.Random(1)
    body = (" ".join(str(rnd.random()) for _ in range(40)) + " " + SECRET + " tail").encode()
    for data in (body, gzip.compress(body)):
        z = base64.b64encode(data).decode()
        for line in ("\n", "\r\n  "):
            text = "top\n" + line.join(z[i : i + 76] for i in range(0, len(z), 76)) + "\nend"
            assert spans_of(text), text


def test_secrets_through_the_query(spark):
    got = {r["doc_id"]: r for r in queries.op7_secrets(spark, SF).collect()}
    rows = documents(spark).collect()
    assert len(got) == len(rows)
    for r in rows:
        base = slow_base(r["text"] or "")
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        g = got[r["doc_id"]]
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(k == kind for _, _, k, _ in base) for kind in secrets.KINDS]
        assert g["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(g["spans"].split(","))


def test_secrets_edges(spark):
    out = secrets.scan_secrets(docs_of(spark, EDGES).withColumn("found", F.lit(1)))
    assert out.where("size(found.base) > 0").count() == 0 and out.count() == len(EDGES)
    assert secrets.scan_secrets(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_cycles_end():
    assert secrets.scan("%25" * 50)[2] == 0
    assert secrets.scan("A" * 4096)[1] == []


# Toxicity and quality


def test_toxicity_held_out(spark):
    t = "/root/testdata/sf0.01"
    got = toxicity.toxicity(common.read_table(spark, t, "documents"), common.read_table(spark, t, "labels")).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    label = {r["doc_id"]: r["toxic"] for r in common.read_table(spark, t, "labels").collect()}
    bad, good = ([r["score"] for r in got if label.get(r["doc_id"]) == x] for x in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good)) > 0.8


def slow_toxicity(rows, labels):
    """FTRL-proximal by plain loops over the same features, rows in the order of their hashes; one shard."""
    top = 2**64
    a, b, c, d, e = map(int, toxicity.MIX)

    def features(text):
        h = [xxhash.xxh64_intdigest(w) for w in re.findall(r"\w+", text.lower())]
        made = [x * a for x in h] + [x * b + y * c for x, y in itertools.pairwise(h)] + [x * d + y * e for x, y in zip(h, h[2:], strict=False)]
        out = []
        for x in made:
            x %= top
            out.append(1 + ((x ^ x >> 29) * a % top >> 64 - toxicity.BITS) % (2**toxicity.BITS - 1))
        return sorted(set(out))

    seen, z, n = {}, {}, {}
    train = [(features(rows[i] or ""), label) for _, i, label in labels if i in rows]
    for f, _ in train:
        for x in f:
            seen[x] = seen.get(x, 0) + 1

    def weight(x):
        zi, ni = z.get(x, 0.0), n.get(x, 0.0)
        return 0.0 if abs(zi) <= toxicity.L1 else (math.copysign(toxicity.L1, zi) - zi) / ((toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for f, label in train:
            f = [*f, 0]
            w = {x: weight(x) for x in f}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - label
            for x in f:
                step = (math.sqrt(n.get(x, 0.0) + g * g) - math.sqrt(n.get(x, 0.0))) / toxicity.ALPHA
                z[x] = z.get(x, 0.0) + g - step * w[x]
                n[x] = n.get(x, 0.0) + g * g
    score = lambda t: sum(weight(x) for x in features(t or "") if seen.get(x, 0) >= 2) + weight(0)
    return {i: 1 / (1 + math.exp(-max(-30, min(30, score(t))))) for i, t in rows.items()}


def test_toxicity_equals_plain_loops(spark):
    d, labels = documents(spark), common.read_table(spark, SF, "labels").where(~toxicity.held_out())
    order = sorted((r["order"], r["doc_id"], r["label"]) for r in toxicity.sample(labels).collect())
    want = slow_toxicity({r["doc_id"]: r["text"] for r in d.collect()}, order)
    got = {r["doc_id"]: r["score"] for r in queries.op3_toxicity(spark, SF).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert len({round(x, 6) for x in want.values()}) > 10


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (4, 1)], "doc_id long, toxic int")
    d = docs_of(spark, EDGES)
    assert toxicity.toxicity(d, labels).count() == len(EDGES)
    assert {r["score"] for r in toxicity.toxicity(d, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(d.limit(0), labels).count() == 0


def slow_quality(rows, labels):
    """The same model by plain loops."""
    bins = {r["doc_id"]: [quality.bin_of(v) for v in quality.measures((r["text"] or "").encode())] for r in rows}
    known = {k: q for k, q in labels.items() if k in bins}
    good, bad = sum(known.values()), len(known) - sum(known.values())
    prior = (good + 1) / (good + bad + 2)
    ratio = []
    for f in range(len(quality.FEATURES)):
        ratio.append([])
        for b in range(quality.BINS):
            n = [sum(1 for k, q in known.items() if q == c and bins[k][f] == b) for c in (0, 1)]
            p = [(n[c] + quality.SMOOTHING / quality.BINS) / ((bad, good)[c] + quality.SMOOTHING) for c in (0, 1)]
            ratio[f].append(max(-quality.MAX_RATIO, min(quality.MAX_RATIO, math.log(p[1] / p[0]))))
    evidence = {k: sum(ratio[f][b] for f, b in enumerate(bs)) for k, bs in bins.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    p = {k: sig(e + quality.logit(prior)) for k, e in evidence.items()}
    site = {r["doc_id"]: (r["source"] or "", r["lang"] or "") for r in rows}
    paths, hosts = {}, {}
    for k, g in site.items():
        paths.setdefault(g, []).append(p[k])
        hosts.setdefault(g[0], []).append(p[k])
    mean = lambda x: sum(x) / len(x)
    everyone = list(p.values())

    def strength(groups, parent, parents):
        n = len(everyone)
        inner = sum((x - mean(g)) ** 2 for g in groups.values() for x in g) / (n - len(groups))
        between = sum(len(g) * (mean(g) - mean(parent(k))) ** 2 for k, g in groups.items())
        outer = (between - (len(groups) - parents) * inner) / (n - sum(len(g) ** 2 / len(parent(k)) for k, g in groups.items()))
        return 1000.0 if outer <= inner / 1000 else max(1.0, inner / outer)

    a, b = strength(hosts, lambda k: everyone, 1), strength(paths, lambda k: hosts[k[0]], len(hosts))
    host = {k: (sum(g) + a * prior) / (len(g) + a) for k, g in hosts.items()}
    rate = {k: (sum(paths[g]) - p[k] + b * host[g[0]]) / (len(paths[g]) - 1 + b) for k, g in site.items()}
    return {k: sig(evidence[k] + quality.logit(rate[k])) for k in p}


def test_quality_equals_brute_force(spark):
    rows = documents(spark).collect()
    labels = {r["doc_id"]: r["quality"] for r in common.read_table(spark, SF, "labels").collect()}
    want = slow_quality(rows, labels)
    got = {r["doc_id"]: r["quality_score"] for r in queries.op10_quality(spark, SF).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_quality_keeps_the_good(spark):
    t = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in common.read_table(spark, t, "labels").collect()}
    got = {r["doc_id"]: r["keep"] for r in queries.op10_quality(spark, t).collect()}
    good, bad = [got[k] for k, q in label.items() if q == 1], [got[k] for k, q in label.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_quality_of_held_out_documents(spark):
    t = "/root/testdata/sf0.01"
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = common.read_table(spark, t, "labels")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_documents(common.read_table(spark, t, "documents"), labels.where(~held)).collect()}
    rows = labels.where(held).collect()
    good, bad = ([got[r["doc_id"]] for r in rows if r["quality"] == q and r["doc_id"] in got] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 10
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_strengths_follow_the_groups():
    rng = np.random.default_rng(2)
    for apart, near in ((0.0, 300), (0.05, 100), (0.3, 10)):
        groups = [np.clip(rng.normal(0.5 + rng.normal() * apart, 0.2, 50), 0, 1) for _ in range(200)]
        good, n = np.array([g.sum() for g in groups]), 50 * 200
        square = sum((g * g).sum() for g in groups)
        found = quality.strength(square - (good**2 / 50).sum(), (good**2 / 50).sum() - good.sum() ** 2 / n, n, 200, 1, 200 * 2500 / n)
        assert (found >= near) if not apart else found <= near


def test_quality_edges(spark):
    d = docs_of(spark, EDGES).withColumns({"source": F.when(F.col("doc_id") % 2 == 0, F.col("source")), "lang": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.score_documents(d, labels).where("quality_score is null").count() == 0
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and kept.where("keep = 'x' and host_rate = 'x'").count() == len(EDGES)
    assert quality.score_documents(d.limit(0), labels.limit(0)).count() == 0


# Mixing


def test_poisson_inverse(spark):
    rng = np.random.default_rng(4)
    rows = [(float(u), float(r)) for u, r in zip(rng.random(300), rng.choice([0.0, 0.1, 1.0, 3.5, 32.0], 300), strict=True)]
    got = spark.createDataFrame(rows, "u double, rate double").select("u", "rate", mixing.poisson_inverse(F.col("u"), F.col("rate")).alias("k")).collect()
    for r in got:
        k, p = 0, math.exp(-r["rate"])
        c = p
        while r["rate"] > 0 and r["u"] >= c:
            k += 1
            p *= r["rate"] / k
            c += p
        assert r["k"] == k


def test_many_copies_of_one_row_are_made_in_chunks(spark, monkeypatch):
    d = docs_of(spark, ["only"], "a").unionByName(docs_of(spark, [f"t{i}" for i in range(50)], "b"))
    plain = [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixing.mix(d, {"a": 0.9, "b": 0.1}, size=400).collect()]
    monkeypatch.setattr(mixing, "CHUNK", 7)
    cut = [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixing.mix(d, {"a": 0.9, "b": 0.1}, size=400).collect()]
    assert sorted(plain) == sorted(cut) and sum(1 for r in cut if r[0] == 0) > 300
    assert mixing.mix(d.limit(0)).count() == 0


def test_mixing_reaches_its_weights(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "c").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(d, {"b": 3.0, "": 1.0}, size=8000).groupBy("source").count().collect()}
    assert n["b"] == pytest.approx(6000, rel=0.05) and n[None] == pytest.approx(2000, rel=0.08) and "c" not in n
    clashing = mixing.mix(docs_of(spark, EDGES))
    assert sorted(clashing.columns) == sorted(docs_of(spark, EDGES).columns + ["shuffle_key"]) and clashing.where("_dir <> 'x' or rate <= 0").count() == 0
    high = mixing.mix(d.limit(50).withColumn("source", F.lit("b")), size=50 * 100).count()
    assert high == pytest.approx(5000, rel=0.1)
    assert mixing.mix(d.limit(0)).count() == 0


# Vectors


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "x") for i, (v, lab) in enumerate(rows)], "vec_id long, embedding array<float>, label int, n_links string, score string")


ODD = [(None, 1), ([], 1), ([0.0, 0.0], 1), ([1.0, None], 1), ([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1), ([1.0, 0.5], None), ([1.0, 0.5], 1), ([1.0, 0.5], 1), ([2.0, 1.0], 1), ([0.5], 1), ([1.0, 0.5], 2)]


def test_topk_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = ODD + [(rng.normal(size=2).tolist() if i % 3 else [0.25, 0.75], i % 4) for i in range(300)]
    got = {}
    for r in topk.top_inner_products(vectors(spark, rows), 5, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, (v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in ints if i % 10 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q)[:5]
        assert got[q] == {k + 1: (c, -s) for k, (s, c) in enumerate(scores)}
    assert topk.top_inner_products(vectors(spark, rows).limit(0)).count() == 0


def doubles(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, score string, vec string, rank string")


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [[float(x) for x in rng.integers(-4_000_000, 4_000_000, 3)] for _ in range(200)]  # beyond exact doubles
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_inner_products(doubles(spark, rows), 5, 50).collect()}
    ints = [[math.floor(256 * x) for x in v] for v in rows]
    for q in range(0, 200, 50):
        want = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in range(200) if c != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(c, -s) for s, c in want]
    with pytest.raises(ValueError, match="no long holds"):
        topk.top_inner_products(doubles(spark, [[1e16, 1.0], [1.0, 1.0]]))


def test_topk_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 16))
    rows = [(centres[i % 40] + rng.normal(size=16) * 0.05).astype(np.float32).astype(float).tolist() for i in range(6000)]
    stats = {}
    got = {(r["query_id"], r["rank"]): r["score"] for r in topk.top_inner_products(doubles(spark, rows), 5, 50, stats).collect()}
    ints = np.floor(256 * np.array(rows)).astype(np.int64)
    scores = ints[::50] @ ints.T
    scores[np.arange(120), np.arange(0, 6000, 50)] = np.iinfo(np.int64).min
    assert all(got[q * 50, k + 1] == s for q in range(120) for k, s in enumerate(np.sort(scores[q])[::-1][:5].tolist()))
    assert stats["vectors"] == 6000 and stats["queries"] == 120 and stats["compared"] / (120 * 6000) < 0.5


def test_near_duplicates_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = ODD + [((rng.normal(size=3) if i % 4 else np.array([1, 2, 3]) + rng.normal(size=3) * 0.2).astype(np.float32).tolist(), i % 3) for i in range(400)] + [([1.0, 2.0, 3.0], 0)] * 50
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(vectors(spark, rows)).collect()}
    width = 3
    usable = {i: np.pad(np.array(v, np.float64), (0, width - len(v))) for i, (v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    forest, links = common.Forest(), dict.fromkeys(range(len(rows)), 0)
    for a, b in itertools.combinations(usable, 2):
        if rows[a][1] == rows[b][1] and usable[a] @ usable[b] / math.sqrt((usable[a] @ usable[a]) * (usable[b] @ usable[b])) >= neardup.THRESHOLD:
            links[a] += 1
            links[b] += 1
            forest.join(a, b)
    assert got == {i: (links[i], forest.root(i), forest.root(i) == i) for i in range(len(rows))}
    assert neardup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_blocks_are_joined_in_halves():
    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, 4))
    m[150:] = m[:150] + 0.01
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    join = neardup.PairJoin(m, m, unit[:, :2], unit[:, :2], 0.93, 0.38)
    join.run(slice(0, 300), slice(0, 300))
    assert (join.hit == (unit @ unit.T >= 0.93)).all()


# Licences


FILLER = " ".join(f"name{i}" for i in range(90))
#: Text, the licence it states, and whether that is all it is.
LABELLED = [
    ("# Licensed under the Apache License, Version 2.0.\n" + FILLER, "Apache-2.0", False), (FILLER + "\nReleased under the MIT License.\n" + FILLER, "MIT", False), ("Licensed under CC BY-NC 4.0.\n" + FILLER, "CC-BY-NC-4.0", False),
    ("Licensed under CC BY 4.0.\n" + FILLER, "CC-BY-4.0", False), ("// SPDX-License-Identifier: MIT\n" + FILLER, "MIT", False), ("# SPDX-License-Identifier: Apache-2.0\n" + FILLER, "Apache-2.0", False), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0\n" + FILLER, "CC-BY-NC-SA-4.0", False),
    ("SPDX-License-Identifier: Vendor-1.0\n" + FILLER, None, False), ("This work is licensed under the GNU General Public License, version 3.\n" + FILLER, "GPL-3.0", False), ("This work is licensed under the GNU General Public License, version 2.\n" + FILLER, "GPL-2.0", False),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# any later version.\n" + FILLER, "GPL-3.0", False),
    ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted under the BSD\n# 3-Clause License.\n" + FILLER, "BSD-3-Clause", False), (FILLER + "\nwe spoke of a license and of copyright\n" + FILLER, None, False), (licenses.NOTICES[4][2], "MIT", True), ("Copyright 2020 Someone\n\n" + licenses.NOTICES[8][2], "BSD-3-Clause", True),
    ("", None, False), (None, None, False), ("\n\n", None, False), ("word " * 50_000 + "\nReleased under the MIT License.", "MIT", False),
]


def test_licenses_against_labels(spark):
    rows = [(f"r{i}/x", t) for i, (t, *_) in enumerate(LABELLED)]
    # a corpus in which the usual words of notices are common
    rows += [(f"c/{i}", "plain line\n" + line) for i in range(30) for line in ("Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).where("path not like 'c/%'").collect()}
    for i, (text, license, whole) in enumerate(LABELLED):
        assert got[f"r{i}/x"] == (license, "file" if whole else "header" if license else "none"), text


def test_a_header_contradicts_no_result(spark):
    said = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = {r["doc_id"]: r["license"] for r in queries.op1_license_scan(spark, SF).collect()}
    held = {r["doc_id"]: {said[x] for x in (r["text"] or "").split("\n") if x in said} for r in documents(spark).collect()}
    assert any(held.values()) and all(got[i] in names for i, names in held.items() if names)


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\nwith other words around it"), ("a/b/x.py", "# Licensed under the Apache License, Version 2.0.\n" + FILLER), ("a/b/y.py", "code only"), ("a/b/y.py", "code only"), ("a/b/c/z.py", ""), ("d/e.py", None), (None, "x"), ("d/note.txt", "my license to speak"), ("d/LICENSE.txt", "license unknown"), ("e/b.txt", licenses.NOTICES[6][2]), ("e/a/b/c", "code")]
    out = licenses.scan_licenses(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "path string, text string, license string, _dir string, own string")).collect()
    got = {r["path"]: r for r in out}
    pick = lambda p: (got[p]["license"], got[p]["origin"], got[p]["license_dir"])
    assert len(out) == len(rows) and got["a/b/y.py"]["_dir"] == "x"
    assert pick("a/LICENSE") == ("MIT", "file", None) and pick("a/b/x.py") == ("Apache-2.0", "header", None)
    assert pick("a/b/y.py") == ("MIT", "inherited", "a") and pick("a/b/c/z.py") == ("MIT", "inherited", "a")
    assert pick("e/b.txt") == ("ISC", "file", None) and pick("e/a/b/c") == ("ISC", "inherited", "e")
    assert [pick(p) for p in ("d/e.py", None, "d/note.txt", "d/LICENSE.txt")] == [(None, "none", None)] * 4
    assert licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_lookup_join_by_salt(spark):
    big = spark.range(100).select(F.when(F.col("id") < 90, 1).when(F.col("id") < 95, 2).alias("k"))
    table = spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string")
    for most in (100_000, 0):
        n = {r["v"]: r["count"] for r in common.lookup_join(big, table, ["k"], most).groupBy("v").count().collect()}
        assert n == {"a": 90, None: 10}


# Pipeline


def test_pipeline_equals_brute_force(spark, tokenizer):
    assert importlib.util.find_spec("corpus_pipeline")
    import corpus_pipeline

    rows = documents(spark).collect()
    labels = {r["doc_id"]: r["quality"] for r in common.read_table(spark, SF, "labels").collect()}
    score = slow_quality(rows, labels)
    kept = [r for r in rows if score[r["doc_id"]] >= quality.THRESHOLD]
    texts = [x[2] for x in slow_lines([r["text"] for r in kept], linededup.MIN_DOCS)]
    roots = slow_components({r["doc_id"]: slow_wide(t) for r, t in zip(kept, texts, strict=True)}, simhash.WIDE_BITS)
    left = [(r, t) for r, t in zip(kept, texts, strict=True) if roots[r["doc_id"]] == r["doc_id"]]
    n = {}
    for r, _ in left:
        n[r["source"]] = n.get(r["source"], 0) + 1
    total = sum(v**mixing.POWER for v in n.values())
    want = []
    for r, t in left:
        rate = len(left) * n[r["source"]] ** mixing.POWER / total / n[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}|{r['doc_id']}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want += [(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * k
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_return_documents(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "bpe"]
    d = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == corpus_pipeline.COLUMNS


def odd_documents(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, "x", "x") for i, t in enumerate([*EDGES, "w " * 200_000])]
    rows += [rows[4], rows[4], (None, "nameless text", "en", "s", 1, "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, keep string")


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_tables(spark, number):
    import corpus_pipeline

    _, stage = corpus_pipeline.STAGES[number]
    d = odd_documents(spark)
    out = stage(spark, d, SF)
    assert stage(spark, d.limit(0), SF).count() == 0
    got = out.collect()
    if number in (0, 2):  # rows stay or go as they are
        before = [tuple(r) for r in d.select(corpus_pipeline.COLUMNS).collect()]
        assert all(before.count(tuple(r)) >= 1 for r in got)
    if number == 1:
        assert len(got) == d.count()
    if number == 2:
        assert sum(r["doc_id"] in (0, 1, 2, 3) for r in got) == 1 and sum(r["doc_id"] == 4 for r in got) == 3 and sum(r["doc_id"] is None for r in got) == 1
    if number == 4:
        assert len(got) == d.count() and all(r["n_tokens"] is not None for r in got)
