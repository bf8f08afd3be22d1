"""Each operator against brute force on small fixtures, with nulls, empty texts, repeated rows, empty tables and odd columns."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontamination, html_extraction, id_coder, jaccard_join, language_model, packing, pii, quality_classifier, quality_rules, queries, quotation, token_store
from tessella.llm.common import shared_folder
from tessella.llm.token_ids import encoder

from ..compare import difference

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, key string"
LONG = "".join(f"palabra{i % 977} " for i in range(30_000))
TEXTS = [None, "", "  \n ", "one", "Mail bob@x.example.com now", "Mail bob@x.example.com now", LONG, "a b c d e f g h i j " * 3, "Card 4111 1111 1111 1111, ip 10.0.0.256 or 10.0.0.25, call +34 (91) 555-12-34.", "<|endoftext|> Ünï ÉÈ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", "hot", None, "x", 1, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "one two three four", "en", None, 3, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sf_texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]


def test_words_of_ids():
    e = encoder("word_bpe_49k.json")
    texts = pa.array([*TEXTS, "Don't stop's. İstanbul K-9!! ﬁne 日本語 テスト。 a b"])
    ids, at = e.encode(texts, 2)
    for i, t in enumerate(texts.to_pylist()):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 5000])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 100_000
    blocks = id_coder.encode(ids)
    assert np.array_equal(np.concatenate([np.empty(0, np.int64), *id_coder.decode(blocks)]), ids)
    if n:
        bad = bytearray(blocks[0])
        bad[4] ^= 1  # of the checksum
        with pytest.raises(ValueError):
            id_coder.decode([bytes(bad)])


def test_op1(spark, docs, none, sf_texts):
    def brute(t):
        out, email = [], re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        out += [("email", m.start(), m.end()) for m in email.finditer(t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", t):
            d = re.sub(r"\D", "", m[0])
            if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", m.start(), m.end()))
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]

    for r in queries.op1_sanitisation(spark, SF).collect():
        want = brute(sf_texts[r.doc_id])
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    got = pii.sanitise(docs).select("row.doc_id", "clean", F.size("spans").alias("n")).collect()
    assert len(got) == docs.count() and {r.clean for r in got if r.doc_id == 8} == {"Card <card>, ip 10.0.0.256 or <ip>, call <phone>."}
    assert pii.sanitise(none).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_op1_masks_disclosing_terms_far_from_the_entity_and_without_it(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_WORDS", most)
    far = "Über Zorblatt it was. " + "plain words stand here now " * 60
    rows = [(i, far + "Write to ann@zz.example.com é.") for i in range(3)] + [(3, "The Zorblatt affair, said zorblatt. Mail other@yy.example.com"), (4, None)] + [(i, "plain words stand here now. it was to write") for i in range(5, 60)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "clean", "spans").collect()}
    for i, text in rows[:4]:
        assert "zorblatt" not in got[i].clean.lower() and ("stand here now" if i < 3 else "affair") in got[i].clean
        spans = sorted((s.start, s.end) for s in got[i].spans if text[s.start : s.end].lower() == "zorblatt")
        assert spans == [m.span() for m in re.finditer("zorblatt", text.lower())] and spans
    assert "zorblatt" not in got[3].clean.lower() and "<email>" in got[3].clean and got[4].clean is None and got[7].clean == rows[7][1]


def test_op2(spark):
    page = "<html><body><nav>Menu Home</nav><article><h1>T&eacute;</h1><p>Body   text {}.</p></article><footer>Foot</footer><script>x</script></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i), 1) for i in range(4)] + [(9, None, None, 1), (9, "bad", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text) for r in html_extraction.extract(pages).select("row.page_id", "text").collect()}
    assert got == {(i, f"Té Body text {i}.") for i in range(4)} | {(9, "")}
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_op3(spark, docs, none, sf_texts):
    tok, at = encoder("word_bpe_49k.json").tokenizer, 0
    got = {r.doc_id: r for r in queries.op3_token_store(spark, SF).collect()}
    for i in sorted(sf_texts):
        ids = tok.encode(sf_texts[i], add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for df, n in ((docs, 12), (none, 0)):
        path = shared_folder(spark, "store")
        token_store.write(df, path)
        assert token_store.read(spark, path).count() == n


QUOTES = [
    (1, 0, "user", "How is the weather today?\nI ask for a friend."), (1, 1, "assistant", "Ann wrote:\n> How is the weather today?\nSunny as it ever was here."),
    (1, 2, "user", "> > How is the weather today?\n> Sunny as it ever was here.\nThank you kindly then."), (1, 3, "user", "> nobody ever said this line\nNew thing."),
    (2, 0, "user", None), (None, 1, "user", "> x"), (3, 0, "user", ""), (3, 0, "user", "> only quoted words here"), (3, 1, "user", "> only quoted words here"),
]


def test_op4(spark, tmp_path):
    import duckdb

    rows = spark.createDataFrame(QUOTES, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotation.link(rows).collect()}
    assert [(got[1, t].parent_turn, got[1, t].thread_turn, got[1, t].depth) for t in range(4)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0)]
    assert got[1, 1].text == "Sunny as it ever was here."
    assert quotation.link(rows.limit(0)).count() == 0
    con = duckdb.connect()
    rows.toPandas().to_parquet(tmp_path / "c.parquet")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    cursor = con.execute(quotation.SQL)
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(dict(zip(names, r, strict=True)).items()) for r in cursor.fetchall())
    plain = lambda r: tuple((c, None if r[c] is None else int(r[c]) if c in ("conv_id", "turn", "parent_turn", "thread_turn") else r[c]) for c in names)
    assert Counter(map(plain, quotation.link(rows).collect())) == Counter(plain(dict(x)) for x in want.elements())


def test_op4_links_the_nearest_original_of_any_length(spark):
    rng, said = np.random.default_rng(5), ["Why not?", "Yes, please", "No", "It rains here all the day long."]
    rows = [(1, 1, "user", "Yes, please"), (1, 9, "user", "Yes, please"), (1, 10, "user", "> Yes, please\nSo be it."), (1, 300, "user", "> yes please!\n> > ...\nYes, please"), (1, 301, "user", "> Yes, please")]
    rows += [(2, t, "user", f"> {said[rng.integers(4)]}\n{said[rng.integers(4)]}" if t % 3 else said[rng.integers(3)]) for t in range(400)]
    got = {(r.conv_id, r.turn): r for r in quotation.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    plain, parents = lambda x: " ".join(re.findall("[a-z]+", x.lower())), {}
    for k, (c, t, _, text) in enumerate(rows):
        own = lambda x: {plain(y) for y in x.split("\n") if y[:1] != ">"}
        quoted = {plain(y) for y in text.split("\n") if y[:1] == ">"} - {""}
        parents[c, t] = max((u for d, u, _, x in rows[:k] if d == c and quoted & own(x)), default=None)
        assert (got[c, t].parent_turn, got[c, t].n_passages, got[c, t].n_linked) == (parents[c, t], len(quoted), int(parents[c, t] is not None))
    assert [parents[1, t] for t in (1, 9, 10, 300, 301)] == [None, None, 9, 9, 300]
    for (c, t), r in got.items():
        up, depth = t, 0
        while parents[c, up] is not None:
            up, depth = parents[c, up], depth + 1
        assert (r.thread_turn, r.depth) == (up, depth)


def components_of(texts, n, p, q):
    def shingles(t):
        x = words(t)
        return {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if len(x) >= n else {tuple(x)} if x else set()

    sets, root = [(i, shingles(t)) for i, t in sorted(texts.items())], {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and q * len(x & y) >= p * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "p", "q"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_op5(spark, docs, none, n, p, q):
    base = [f"w{i}" for i in range(60)]
    texts = {k: " ".join(base[:k] + [f"x{k}"] * (k % 4) + base[k + k % 3 :]) for k in range(0, 60, 2)} | {100 + k: " ".join(base[k:] + base[:k]) for k in range(0, 20, 3)}
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(rows, n=n, p=p, q=q).collect()} == components_of(texts, n, p, q)
    got = [r.asDict() for r in jaccard_join.linked(docs, n=n, p=p, q=q).collect()]
    assert len(got) == 12 and {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert jaccard_join.linked(none).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard_join.representatives(docs).collect()) == sorted(map(str, [0, 1, 2, 3, 4, 6, 7, 8, 9, None]))


def test_op6(spark, docs, none, sf_texts):
    tok = encoder("word_bpe_49k.json").tokenizer
    got = queries.op6_packing(spark, SF).collect()
    pieces, bins = Counter(), {}
    for r in got:
        pieces[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in sf_texts.items()}
    for places in bins.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(bins) <= -(-sum(pieces.values()) // 2048) * 1.01 + 1
    where, _ = packing.best_fit(np.array([3, 3, 3, 3]), 12, 2, 10**6)
    assert np.bincount(where).tolist() == [2, 2]  # the document capacity binds
    assert packing.pack(docs).where("row.doc_id = 6").agg(F.max("length")).first()[0] == 2048 and packing.pack(none).count() == 0


def test_op7(spark, docs, none, sf_texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(x for i, t in sf_texts.items() if not held(i) for x in [*words(t), None])
    total, v = sum(counts.values()), len(counts)
    gain = 0.0
    for r in queries.op7_language_model(spark, SF).collect():
        tokens = [*words(sf_texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(x in counts for x in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + v + 1)) for x in tokens), rel=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
    assert language_model.score(docs).count() == 12 and language_model.score(none).count() == 0


def test_op7_agrees_with_brute_force_trigrams(spark, sf_texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*words(t), None] for i, t in sf_texts.items()}
    grams = lambda x, k: [tuple(["<s>"] * k + x)[j : j + k + 1] for j in range(len(x))]
    seen = [Counter(g for i, x in tokens.items() if not held(i) for g in grams(x, k)) for k in range(3)]
    begun, after, cut = [Counter() for _ in seen], [Counter() for _ in seen], []
    for k, counts in enumerate(seen):
        for g, c in counts.items():
            begun[k][g[:-1]] += c
            after[k][g[:-1]] += 1
        once, twice = (sum(c == j for c in counts.values()) for j in (1, 2))
        cut.append(min(0.95, max(0.1, once / (once + 2 * twice))))

    def p(g):
        k, h = len(g) - 1, g[:-1]
        if k and not begun[k][h]:
            return p(g[1:])
        shorter = p(g[1:]) if k else 1 / (len(seen[0]) + 1)
        return (max(seen[k][g] - cut[k], 0) + cut[k] * after[k][h] * shorter) / begun[k][h]

    want = {i: sum(math.log10(p(g)) for g in grams(x, 2)) for i, x in tokens.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = language_model._hot_histories(docs.select("text"))
    assert hot[0] and hot[1]
    for out in (queries.op7_language_model(spark, SF), language_model.score(docs, chunk_bytes=200_000, bucket_bytes=2_000)):
        assert {r.doc_id: r.score for r in out.collect()} == pytest.approx(want, rel=1e-9)


def test_op8(spark, docs, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = quality_classifier.classify(d, labels.where(~fold), keep=["doc_id"]).select("row.doc_id", "accepted").join(labels.where(fold), "doc_id").collect()
    clean = [r.accepted for r in out if r.quality == 1 and r.toxic == 0]
    poor = [r.accepted for r in out if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(poor) <= 0.25 * len(poor)
    assert quality_classifier.classify(docs, labels).count() == 12
    assert quality_classifier.classify(none, labels.limit(0)).count() == 0


def test_op9(spark, docs, none, sf_texts):
    for r in queries.op9_quality_rules(spark, SF).collect():
        t = sf_texts[r.doc_id]
        x = [y for y in re.split(r"[\x20\x09-\x0d]+", t) if y]
        grams = Counter(tuple(x[i : i + 8]) for i in range(len(x) - 7))
        repeat = {j for i in range(len(x) - 7) if grams[tuple(x[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [y for y in t.split("\n") if y.strip("\x20\t\n\v\f\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(x), sum(map(len, x)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(x) < 20 or 100 * len(repeat) > 30 * len(x)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(docs).count() == 12 and quality_rules.judge(none).count() == 0


def test_op10(spark, docs, none):
    item = "the quick brown fox jumps over the lazy dog while seven wise owls look on from the old oak"
    edited = item.replace("brown", "red").replace("seven ", "").replace("old", "very old")
    texts = [item, f"{LONG[:5000]} {edited.upper()}! {LONG[:3000]}", "the quick brown fox is all there is to this text", None, ""]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, matches int")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short")], "item_id long, text string")
    got = {r.doc_id: [(m.item_id, m.score) for m in r.matches] for r in decontamination.contaminated(rows, items, keep=["doc_id"]).select("row.doc_id", "matches").collect()}
    assert [x for x, _ in got[0]] == [1, 2] and got[0][0][1] == 1.0 and [x for x, _ in got[1]] == [1, 2] and got[2] == got[3] == got[4] == []
    assert decontamination.contaminated(docs, items.limit(0)).where(F.size("matches") > 0).count() == 0 and decontamination.contaminated(none, items).count() == 0


def test_op10_edited_copies_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    prose = lambda k: [f"w{x}" for x in rng.integers(0, 400, k)]
    items = {i: prose(k) for i, k in enumerate((5, 8, 15, 15, 22, 38, 38, 59))}
    docs, must = {}, set()
    for i, item in items.items():
        docs[len(docs)] = prose(9) + [f"x{k}" if k % 4 == 3 else x for k, x in enumerate(item)] + prose(9)
        must.add((len(docs) - 1, i))
        for share in (0.2, 0.3, 0.4):  # words replaced, dropped and added at random
            changed = [[x] if rng.random() > share else [["y"], [], [x, "z"]][rng.integers(3)] for x in item]
            docs[len(docs)] = prose(9) + [y for x in changed for y in x] + prose(9)
        docs[len(docs)] = item[: len(item) // 2] + prose(len(item) * 3 // 4) + item[len(item) // 2 :]

    def best(a, row):
        before, most = [0] * (len(row) + 1), 0
        for x in a:
            now = [0]
            for j, y in enumerate(row):
                now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
            before, most = now, max(most, *now)
        return most / (2 * len(a))

    grams = lambda x: {tuple(x[k : k + 3]) for k in range(len(x) - 2)}
    want = {(d, i): s for d, x in docs.items() for i, item in items.items() if grams(item) & grams(x) and (s := best(item, x)) >= 0.5}
    table = lambda rows, name: spark.createDataFrame([(k, " ".join(x)) for k, x in rows.items()], f"{name} long, text string")
    found = decontamination.contaminated(table(docs, "doc_id"), table(items, "item_id"), keep=["doc_id"]).select("row.doc_id", "matches").collect()
    assert must <= set(want)
    assert {(r.doc_id, m.item_id): m.score for r in found for m in r.matches} == want


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, rows = rng.integers(1, 5, 7), rng.integers(1, 5, (3, 12))
        best = decontamination.align(a.astype(np.uint64), rows.astype(np.uint64))[0]
        for row, got in zip(rows, best, strict=True):
            h = np.zeros((len(a) + 1, len(row) + 1), int)
            for i, x in enumerate(a, 1):
                for j, y in enumerate(row, 1):
                    h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            assert got == h.max()


def test_pipeline_stages(spark, tmp_path):
    docs, held = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns
        held.append(SimpleNamespace(before=docs, after=after))
        docs = after
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = texts(held[1].before), texts(held[1].after)
    assert set(after) == {i for i, (_, c) in components_of(before, 5, 4, 5).items() if i == c}
    assert set(texts(held[3].after)) == set(texts(held[3].before)) == set(texts(held[2].after))
    assert not any("@" in (t or "") and pii.base_spans(t) for t in texts(held[3].after).values())
    assert {r.doc_id for r in held[4].after.collect()} == set(texts(held[3].after))
    assert Counter(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == Counter(map(str, held[4].after.select("doc_id", "piece", "ids_crc32").collect()))


def test_quotation_agrees_with_sql(spark):
    assert difference(spark, SF, "op4_quotation_linking") is None


def test_op9_recovers_known_rates():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.6
    votes = (rng.random((20_000, 10)) >= np.where(good, 0.15, 0.8)[:, None]).astype(int)
    held = rng.random(votes.shape) < 0.1
    patterns = Counter(tuple(None if h else int(v) for v, h in zip(*row, strict=True)) for row in zip(votes, held, strict=True))
    share, rates, posterior = quality_rules.estimate(sorted(patterns.items(), key=str))
    assert abs(share - 0.6) < 0.05 and all(abs(a - 0.15) < 0.05 and abs(c - 0.8) < 0.05 for a, c in rates)
    right = sum((posterior[tuple(None if h else int(v) for v, h in zip(*row, strict=True))] >= 0.5) == g for *row, g in zip(votes, held, good, strict=True))
    assert right > 0.95 * len(good)


def test_op9_posterior_is_that_of_em_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = list(quality_rules.rules())
    stats = quality_rules.text_stats(docs).withColumns(quality_rules.rules()).select("doc_id", *names).collect()
    votes = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in stats], float)
    share, a, c = 0.8, np.full(len(names), 0.01), np.full(len(names), 0.25)
    for _ in range(500):
        odds = np.log(share / (1 - share)) + np.nansum(np.where(votes == 1, np.log((1 - a) / (1 - c)), np.where(votes == 0, np.log(a / c), np.nan)), axis=1)
        p = 1 / (1 + np.exp(-odds))
        votes_bad, has = votes == 0, ~np.isnan(votes)
        bad, n = [[(q[:, None] * m).sum(axis=0) for q in (p, 1 - p)] for m in (votes_bad, has)]
        new_a, new_c = (bad[0] + 0.01) / (n[0] + 1), (bad[1] + 0.25) / (n[1] + 1)
        both = (bad[0] + bad[1] + 0.01) / (n[0] + n[1] + 1)
        new_a, new_c = (np.clip(np.where(new_c < new_a, both, x), 1e-5, 1 - 1e-5) for x in (new_a, new_c))
        moved = max(abs(p.mean() - share), np.abs(new_a - a).max(), np.abs(new_c - c).max())
        share, a, c = min(max(p.mean(), 1e-4), 1 - 1e-4), new_a, new_c
        if moved < 1e-7:
            break
    want = dict(zip((r.doc_id for r in stats), p, strict=True))
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, SF).collect()}
    assert {i: r.p_good for i, r in got.items()} == pytest.approx(want, abs=1e-6)
    assert all(r.kept == (not r.base_failed and want[i] >= 0.5) for i, r in got.items() if abs(want[i] - 0.5) > 1e-3)


def test_encoder_reads_tokenizers_that_do_not_split_at_space():
    e = encoder("byte_bpe_50k.json")
    assert not e.by_word and encoder("word_bpe_49k.json").by_word
    ids, at = e.encode(pa.array(TEXTS), 7)
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [7]


@pytest.mark.parametrize("blocks", [1, 3])
def test_op10_query_agrees_with_brute_force(spark, blocks):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    block_bytes = 1 + sum(len(r.text.encode()) for r in items.collect()) // blocks
    grams = {}
    asked = {r.item_id: plain(r.text) for r in items.collect()}
    for i, x in asked.items():
        for k in range(len(x) - 2):
            grams.setdefault(tuple(x[k : k + 3]), set()).add(i)
    want = set()
    for r in docs.collect():
        x = plain(r.text)
        for i in {i for k in range(len(x) - 2) for i in grams.get(tuple(x[k : k + 3]), ())}:
            row, before, best = np.array([hash(y) for y in x]), np.zeros(len(x) + 1, int), 0
            for word in asked[i]:
                now = np.maximum(np.maximum(before[:-1] + np.where(row == hash(word), 2, -1), before[1:] - 1), 0)
                now = np.maximum.accumulate(now + np.arange(len(row))) - np.arange(len(row))
                before = np.concatenate(([0], now))
                best = max(best, int(now.max(initial=0)))
            if best >= len(asked[i]):
                want.add((r.doc_id, i, round(best / (2 * len(asked[i])), 9)))
    found = decontamination.contaminated(docs, items, keep=["doc_id"], block_bytes=block_bytes).select("row.doc_id", F.explode("matches").alias("m")).collect()
    assert {(r.doc_id, r.m.item_id, round(r.m.score, 9)) for r in found} == want and want


def test_op1_disclosing_terms_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    people = [f"p{k}@x{k % 3}.example.com" for k in range(6)]
    docs = []
    for i in range(240):
        words_ = [f"w{x}" for x in rng.zipf(1.6, 12) % 60]
        if i % 4 == 0:
            k = int(rng.integers(6))
            words_ += [people[k], f"only{k}", f"often{k}"]
        if i % 17 == 0:
            words_.append(f"often{i % 6}")
        docs.append(" ".join(words_[j] for j in rng.permutation(len(words_))))
    n, held, having, both = len(docs), Counter(), Counter(), Counter()
    for t in docs:
        spans = pii.base_spans(t)
        mine = {t[a:b].lower() for _, a, b in spans}
        bare = t
        for _, a, b in sorted(spans, key=lambda s: -s[1]):
            bare = bare[:a] + " " + bare[b:]
        inside = {x for x in re.findall("[a-z0-9]+", bare) if len(x) > 1}
        everywhere = set(re.findall("[a-z0-9]+", t))
        held.update(mine)
        having.update(x for x in everywhere if len(x) > 1)
        both.update((e, x) for e in mine for x in inside)
    want = Counter()
    for (e, x), c in both.items():
        if c >= 2 and held[e] >= 2 and math.log2(n * c / (held[e] * having[x])) >= 0.6 * math.log2(n / held[e]):
            want[round(math.log2(n * c / (held[e] * having[x])) / math.log2(n / held[e]), 9)] += 1
    texts = spark.createDataFrame([(t,) for t in docs], "text string").repartition(5)
    got = Counter(round(r.disclosure, 9) for r in pii.disclosing_terms(texts, 2, 0.6, 0.85).collect())
    assert got == want and sum(want.values()) >= 6


def test_op2_suffix_array_and_repeats_agree_with_brute_force():
    rng = np.random.default_rng(9)
    for n, kinds in ((1, 1), (40, 2), (200, 3), (300, 1), (400, 50)):
        tokens = rng.integers(0, kinds, n).astype(np.uint64)
        order, levels = html_extraction.suffix_array(tokens)
        rows = [tuple(tokens[i:].tolist()) for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: rows[i])
        common = [next((k for k, (x, y) in enumerate(zip(rows[a], rows[b], strict=False)) if x != y), min(len(rows[a]), len(rows[b]))) for a, b in zip(order[:-1], order[1:], strict=True)]
        assert html_extraction.common_prefixes(order, levels).tolist() == common
    pages = [[int(x) for x in rng.integers(0, 4, rng.integers(1, 40))] for _ in range(12)]
    stream = np.array([x for k, p in enumerate(pages) for x in [*p, 100 + k]], np.uint64)
    page = np.array([k for k, p in enumerate(pages) for _ in range(len(p) + 1)])
    like = np.arange(12) // 2
    at, many = html_extraction.repeated_spans(stream, page, like, 4)
    want = {}
    for i in range(len(stream) - 3):
        gram = tuple(stream[i : i + 4].tolist())
        if max(gram) < 100:
            places = [j for j in range(len(stream) - 3) if tuple(stream[j : j + 4].tolist()) == gram]
            if len(places) > 1:
                want[i] = len({like[page[j]] for j in places})
    assert dict(zip(at.tolist(), many.tolist(), strict=True)) == want


@pytest.mark.parametrize("part_bytes", [8 << 20, 20_000])
def test_op2_removes_planted_boilerplate(spark, part_bytes):
    rng = np.random.default_rng(2)
    say = lambda k: " ".join(f"v{x}" for x in rng.integers(0, 100_000, k))
    menus, notes = [say(20) for _ in range(3)], [say(15) for _ in range(3)]
    rows, want = [], {}
    for i in range(120):
        host = f"h{i % 3}" if i % 2 else "big"
        body = [say(30), say(25)]
        marked = i % 5 == 0
        note = notes[0] if marked else notes[i % 3]
        inner = f"<p>{body[0]}</p><p>{note}</p><p>{body[1]}</p>"
        rows.append((i, f"http://{host}/{i}", f"<body><div>{menus[i % 3]}</div>" + (f"<article>{inner}</article>" if marked else f"<div>{inner}</div>") + "</body>"))
        want[i] = (body, note, menus[i % 3], marked)
    rows += [(200 + i, "http://big/c", f"<article><p>{want[2][0][0]}</p><p>{want[2][0][1]}</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), part_bytes=part_bytes).select("row.page_id", "text").collect()}
    assert len(got) == len(rows)
    assert all(f"{b[0]}" in got[i] and b[1] in got[i] for i, (b, *_) in want.items())  # nothing of an article's own goes
    removed = [menu not in got[i] and (marked or note not in got[i]) for i, (_, note, menu, marked) in want.items()]
    assert np.mean(removed) >= 0.9
    assert {got[200 + i] for i in range(6)} == {" ".join(want[2][0])}  # copies of an article stay whole


def test_op6_pieces_are_the_texts_ids(spark, sf_texts):
    tok, seen = encoder("word_bpe_49k.json").tokenizer, {}
    for r in queries.op6_packing(spark, SF).collect():
        seen.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, r.ids_crc32)
    for i, t in sf_texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert seen[i] == {k: (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_op6_every_capacity_binds(by):
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 300, 400)
    for tokens, docs, cost in ((1000, 1000, 10**9), (1000, 3, 10**9), (1000, 1000, 120_000)):
        where, offset = packing.best_fit(lengths, tokens, docs, cost, by=by)
        used = [np.bincount(where, x) for x in (lengths, np.ones(400), lengths.astype(float) ** 2)]
        assert all((u <= cap).all() for u, cap in zip(used, (tokens, docs, cost), strict=True))
        for b in range(where.max() + 1):
            mine = np.argsort(offset[where == b])
            assert offset[where == b][mine].tolist() == [0, *np.cumsum(lengths[where == b][mine])[:-1]]
        assert where.max() + 1 <= 1.25 * max(u.sum() / cap for u, cap in zip(used, (tokens, docs, cost), strict=True)) + 1
    # of two open bins the piece goes where the weighted residual after it is smallest, or its product with the residual largest
    assert packing.best_fit(np.array([7, 6, 3]), 10, 10, 10**6, weights=(1, 0, 0))[0].tolist() == [0, 1, 0]
    assert packing.best_fit(np.array([7, 6, 3]), 10, 10, 10**6, weights=(1, 0, 0), by="dot")[0].tolist() == [0, 1, 1]


def test_op6_sequences_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = lambda df: Counter((r.row.doc_id, r.piece, r.length, r.offset, tuple(r.ids)) for r in packing.pack(df, with_ids=True).collect())
    got = place(docs.coalesce(1))
    assert got == place(docs.coalesce(1)) and got.total() == packing.pack(docs).count()


def test_op8_posteriors_agree_with_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(f"h{h}", f"p{p}", float(np.clip(rng.normal(0.2 + 0.15 * h + 0.05 * p, 0.2), 0, 1))) for h in range(5) for p in range(3) for _ in range(int(rng.integers(1, 60)))]
    scored = spark.createDataFrame(rows, "host string, path string, own_good double")
    groups = {}
    for h, p, x in rows:
        groups.setdefault((h, p), []).append(x)
    hosts = {h: [x for (g, _), v in groups.items() if g == h for x in v] for h in {h for h, _ in groups}}
    centre = (sum(map(sum, hosts.values())) + 1) / (len(rows) + 2)

    def strength(parts):  # (values, centre)
        n = sum(len(v) for v, _ in parts)
        spread, noise = sum(len(v) * (np.mean(v) - c) ** 2 for v, c in parts), sum(len(v) * c * (1 - c) for v, c in parts)
        within = noise / n
        return min(max(within / max((spread - len(parts) * within) / n, within / 1e4) - 1, 1.0), 1e4)

    s = strength([(v, centre) for v in hosts.values()])
    p_host = {h: (centre * s + sum(v)) / (s + len(v)) for h, v in hosts.items()}
    s = strength([(v, p_host[h]) for (h, _), v in groups.items()])
    p_path = {k: (p_host[k[0]] * s + sum(v)) / (s + len(v)) for k, v in groups.items()}
    got = quality_classifier.site_posteriors(scored).collect()
    assert {(r.host, r.path): r.p_path for r in got} == pytest.approx(p_path) and {r.host: r.p_host for r in got} == pytest.approx(p_host)


def test_op8_final_odds_and_repeated_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 0), (5, 0, 1), (6, 1, 0), (7, 1, 1), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality_classifier.classify(docs, labels, keep=["doc_id"]).collect():
        logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        assert r.accepted == (r.p_good >= 0.5 and r.own_toxic < 0.35) and 0 <= r.own_good <= 1 and 0 < r.p_path < 1
        base = logit(r.p_good) - logit(r.own_good) - logit(r.p_path)
        assert abs(base + math.log(4 / 3)) < 1e-6  # four of seven ids are good
    assert quality_classifier.classify(docs.union(docs), labels).count() == 2 * docs.count()


def test_op4_agrees_with_sql_where_thousands_are_quoted(spark, tmp_path):
    import duckdb

    rng, rows = np.random.default_rng(11), []
    for conv in range(12):
        said = []
        for turn in range(300 if conv else 900):
            own = [f"Sentence {rng.integers(10**9)} of talk number {conv}, quite long." for _ in range(rng.integers(1, 4))]
            quoted = []
            for _ in range(int(rng.integers(0, 3)) if said else 0):
                level, line = int(rng.integers(1, 4)), said[int(rng.integers(len(said)))]
                quoted.append("> " * level + line)
            said += own
            rows.append((conv, turn, "user", "\n".join([*quoted, *own])))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.toPandas().to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    cursor = con.execute(quotation.SQL)
    names = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    got = Counter(tuple(r[c] for c in names) for r in quotation.link(table).collect())
    assert got == want and sum(r[names.index("parent_turn")] is not None for r in want) > 1500


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties and repeated rows, an empty table, clashing names."""
    sf = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900 + i, t, None if i % 2 else "en", None if i % 3 else "hot", None if i % 2 else 3) for i, t in enumerate(TEXTS)]
    odd += [odd[4], (None, "one two three four five six", None, None, None), (None, None, None, None, None)]
    schema = sf.schema.simpleString()[7:-1].replace(":", " ")
    rows = spark.createDataFrame(odd, schema).withColumns({c: F.lit(1) for c in ("row", "id", "key", "host", "matches", "clean", "accepted", "spans")})
    for docs in (rows, rows.limit(0)):
        many = docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{many}")
            stage(spark, docs, SF).write.parquet(path)
            after = spark.read.parquet(path)
            if k < 4:
                assert after.columns == docs.columns and after.count() <= many, name
            # repeated rows of a document become one, and no row without words or id is linked with another; nothing is masked away
            assert after.count() == {1: many - 2 if many else 0, 2: many, 3: many, 4: after.count()}.get(k, after.count()), name
            if k == 4 and many:
                assert after.agg(F.sum("length")).first()[0] > 30_000 and after.where("length > 2048").count() == 0
