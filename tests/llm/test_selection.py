"""Centroid clustering, importance resampling and URL filters against brute force, on odd rows and on whole small tables."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import centroids, queries, resampling, url_filters
from tessella.llm import words as w

from ..compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_resampling", "op13_url_filters"])
def test_sql(spark, name):
    assert difference(spark, SF, name) is None


# clustering


def brute_clusters(rows, k, rounds, seed=1, scale=64):
    """rows: (id, list of floats) kept."""
    q = [[math.floor(scale * x) for x in v] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    c = [q[i] for i in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        d = [[far(v, x) for x in c] for v in q]
        own = [r.index(min(r)) for r in d]
        if turn < rounds:
            for j in range(len(c)):
                if mine := [v for v, o in zip(q, own, strict=True) if o == j]:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return own, [r[o] for r, o in zip(d, own, strict=True)], c


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [0.5, -0.5, 1.0]), (1, [0.5, -0.5, 1.0]), (2, [0.25, 3.0, -2.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [float("inf"), 0.0, 0.0]), (8, [0.0, 0.0]), (9, [-0.01, -0.02, -0.03]), (None, [1e9, -1e9, 5.0]), (10, [3.0e30, 1.0, 1.0]), (11, [2.9e30, 1.0, 1.0]), (12, [0.1] * 3)]
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v and len(v) == 3 and None not in v and all(map(math.isfinite, v))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, cluster int")
    for k in (1, 3, 20):
        own, distance, c = brute_clusters(fine, k, 3)
        fits = [d if d < 1 << 63 else None for d in distance]
        got = Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in centroids.cluster(df, dims=3, k=k).collect())
        assert got == Counter((i, o, d, sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, d in zip(fine, own, fits, strict=True))
    assert centroids.cluster(df.limit(0), dims=3).collect() == []
    assert centroids.cluster(df.where("vec_id in (3, 4)"), dims=3).collect() == []


def test_bounds_spare_scans_and_lose_nothing(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 4, (6, 8))
    x = np.concatenate((middles[rng.integers(0, 6, 1500)] + rng.normal(0, 0.6, (1500, 8)), np.repeat(rng.normal(0, 4, (1, 8)), 700, axis=0))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    own, distance, c = brute_clusters(rows, 6, 6)
    got = {r.vec_id: r for r in centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7), dims=8, k=6, rounds=6).collect()}
    assert [(got[i].cluster, got[i].distance) for i, _ in rows] == list(zip(own, distance, strict=True))
    assert {r.inertia for r in got.values()} == {sum(distance)} and sum(r.scans for r in got.values()) < 0.65 * 7 * len(rows)


def test_limbs():
    for v in (0, 1, -1, 1 << 40, -(1 << 40), (1 << 135) - 7, -(1 << 135) + 7):
        parts = centroids._limbs(v)
        assert sum(p << (centroids.LIMB * i) for i, p in enumerate(parts)) == v and all(abs(p) <= 1 << 40 for p in parts)


# resampling

TEXTS = [None, "", " -- ", "One", "one two ONE-two é日本 x9", "the quick brown fox " * 6, "the quick brown fox " * 6, "z" * 300 + " y" * 30, "".join(f"palabra{i % 977} " for i in range(30_000)), "A\u0000b\u007fC " * 10]


def runs(text, n):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + m]) for m in range(1, n + 1) for i in range(len(found) - m + 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, n, monkeypatch):
    monkeypatch.setattr(w, "CHUNK", 1000)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "here is a text of many words " * 5)] + [(i, f"filler number {i} " * 9) for i in range(20, 60)]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_words int, row string").repartition(5)
    target = spark.createDataFrame([("The quick fox",), (None,), ("palabra1 palabra2",)], "text string")
    got = resampling.resample(df, target, n=n, buckets=50)
    bucket = lambda f: zlib.crc32(f.encode()) % 50
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, n)[1]) for texts in ([x for _, x in rows], ["The quick fox", None, "palabra1 palabra2"]))
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 50) / ((s[b] + 1) * (t_all + 50)))) for b in range(50)]
    want = []
    for i, x in rows:
        found, features = runs(x, n)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, x, len(found), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in want if x[2] >= 20), key=lambda x: (-x[5], x[0] is None, x[0]))
    rank = Counter((x[0], x[5], p + 1) for p, x in enumerate(fit[: 10 * len(fit) // 100]))
    rows_got = [(r.row, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert Counter((r.doc_id, r.text, *rest) for r, *rest, _ in rows_got) == Counter(want)
    assert Counter((r.doc_id, score, place) for r, *_, score, place in rows_got if place) == rank and rank
    assert {r.row for r, *_ in rows_got} == {"x"}


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [(r.weight, r["rank"]) for r in resampling.resample(some, none, keep=["doc_id"], min_words=1, percent=100).collect()][0][1] == 1


def test_pieces_and_crcs():
    texts = pa.array(["ab cd" * 40, "x" * 500, None, "é" * 200 + " end"])
    data, starts = w.text_bytes(texts)
    whole = [np.concatenate(x) for x in zip(*resampling.features(data, starts, 2), strict=True)]
    for most in (3, 17, 100):
        small = [np.concatenate(x) for x in zip(*resampling.features(data, starts, 2, most), strict=True)]
        assert sorted(zip(whole[1], whole[2], strict=True)) == sorted(zip(small[1], small[2], strict=True)) and len(small[0]) == len(whole[0])


# URL filters


def test_cascade_is_exact():
    rng = np.random.default_rng(2)
    for listed, others in ((0, 50), (50, 0), (1, 4000), (3000, 3000), (4000, 30)):
        keys = np.unique(rng.integers(0, 2**63, (listed + others, 2)).astype(np.uint64), axis=0)
        yes = np.arange(len(keys)) < listed
        levels = url_filters.build(keys[:, 0], keys[:, 1], yes)
        rows = [type("Row", (), {"shard": 0, "level": i, "hashes": k, "bits": b}) for i, (k, b) in enumerate(levels)]
        group = url_filters.Group(rows, 0, 1)
        assert np.array_equal(group.answer(np.zeros(len(keys), np.int64), keys[:, 0], keys[:, 1]), yes)
    with pytest.raises(ValueError):
        url_filters.build(np.ones(2, np.uint64), np.ones(2, np.uint64), np.array([True, False]))


URLS = [None, "", "no scheme.com/en/", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/EN/", "https://xexample.com/en/1", "http://b.example.net/es/1", "http://net/fr/", "ftp://x.net?/es/", "http://x.net/es#a", "http://spam-farm.example.org/en/1", "http://pills.x.com", "://", "a://b://c.net/es/x", "http://u:p@q.net:80/es/", "http://" + "a." * 5000 + "net/fr/" + "y" * 50_000]


def brute_verdict(url, rules, listed):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(r), r.index("/"), v == "block", r) for v, r in rules if ("." + host).endswith("." + r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=None)
    return host, path, best and best[3], "block" if (best[2] if best else host in listed) else "allow"


@pytest.mark.parametrize(("keys_a_shard", "limit"), [(200_000, 32 << 20), (5, 1)])
def test_url_filters(spark, keys_a_shard, limit):
    listed = {"a.com", "spam-farm.example.org", "pills.x.com", "", "never.seen", "x.net"}
    pages = spark.createDataFrame([(i, u, "x", "k") for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, host string, keys string")
    rules = spark.createDataFrame([*url_filters.RULES, ("allow", "unseen.org/a/b")], "verdict string, rule string")
    got = url_filters.judge(pages, rules, spark.createDataFrame([(h,) for h in [*listed, None]], "host string"), keys_a_shard=keys_a_shard, limit_bytes=limit).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.row.url, url_filters.RULES, listed) and r.row.keys == "k"


def test_url_filters_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    no_rules, no_hosts = spark.createDataFrame([], "verdict string, rule string"), spark.createDataFrame([], "host string")
    assert [(r.rule, r.verdict) for r in url_filters.judge(pages, no_rules, no_hosts).collect()] == [(None, "allow")]
    assert url_filters.judge(pages.limit(0), no_rules, no_hosts).collect() == []


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op13_url_filters(spark, SF).collect():
        host = brute_verdict(urls[r.page_id], (), ())[0]
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], url_filters.RULES, {host} if re.search(url_filters.SUSPECT, host) else set())
