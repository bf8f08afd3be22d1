"""Long texts with many entities or one repeated n-gram, and articles with things in them that are no part of them."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontamination, html_extraction, pii, quotation
from tessella.llm import words as w


@pytest.mark.parametrize("most", [1, 7, 1 << 19])
def test_pairs_leave_in_bounded_batches(monkeypatch, most):
    monkeypatch.setattr(pii, "PAIRS", most)
    rng = np.random.default_rng(1)
    docs = [(rng.choice(50, rng.integers(1, 20), replace=False).astype(np.int64), rng.choice(90, rng.integers(0, 40), replace=False).astype(np.int64)) for _ in range(30)]
    batches = list(pii._pair_batches(iter(docs)))
    got = Counter()
    for b in batches:
        for e, t, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            got[e, t] += n
    assert got == Counter((int(e), int(t)) for mine, keys in docs for e in mine for t in keys)
    assert all(b.num_rows <= 2 * most + 40 for b in batches)


def test_a_text_of_many_addresses(spark):
    """Two copies of one megabyte with 10,000 addresses: their entities are one class, so terms are counted once."""
    addresses = [f"a{i}.b{i % 91}@host{i % 13}.example.com" for i in range(10_000)]
    text = " ".join(f"{a} wort{i % 4999} plain words here it is, {i}" for i, a in enumerate(addresses))
    rows = [(0, text), (1, text), (2, f"{addresses[5]} and wort5 plain words"), *((i, "plain words here it is") for i in range(3, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select("text", *pii._key(F.col("text")))
    counts = pii._entity_counts(texts).where("alone >= 2")
    assert counts.count() == 10_000 and counts.select("alone", "s0", "s1", "s2").distinct().count() == 2
    got = {r.doc_id: r for r in pii.summary(pii.sanitise(df, keep=["doc_id"])).select("row.doc_id", "n_email").collect()}
    assert [got[i].n_email for i in range(4)] == [10_000, 10_000, 1, 0]


def test_hits_on_one_diagonal_are_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        texts = pa.array([" ".join(rng.choice(list("abc"), 60)) for _ in range(3)])
        items = decontamination.Items([7, 8], pa.array([" ".join(rng.choice(list("abc"), 12)), "a b c a b c a b"]), 3)
        runs, _ = decontamination._word_runs(texts)
        keys, at = w.windows(runs.hash, runs.doc, 3)
        left, right = np.searchsorted(items.key, keys, "left"), np.searchsorted(items.key, keys, "right")
        want = {(int(runs.doc[a]), int(items.item[e]), int(a - items.place[e])) for a, x, y in zip(at, left, right, strict=True) for e in range(x, y)}
        old = decontamination.HITS
        for hits in (1, 10, old):
            decontamination.HITS = hits
            key = decontamination._placed(runs.doc, at, left, right, items)
            assert {(int(k >> 32) // 2, int(k >> 32) % 2, int(k & 0xFFFFFFFF) - decontamination._BEFORE) for k in key} == want
        decontamination.HITS = old


def test_a_million_words_of_one_trigram():
    text, item = "uno dos tres " * 333_334, "uno dos tres " * 100
    items = decontamination.Items([1], pa.array([item]), 3)
    tracemalloc.start()
    found = decontamination._matches(items, pa.array([text]), 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][0][:2] == (1, 1.0) and peak < 500e6


APART_NAMES = "reader-comments user-comments commentlist comment-thread related-stories related-news recommended-reading email-signup inline-ad video-ad story-ad share-tools social-media most-read outbrain taboola comments ad adslot cookie-notice newsletter-box sidebar relatedLinks promo-box sponsored".split()
KEPT_NAMES = "commentary lead-text shareholder-letter body-copy adverb table-wrapper photo-caption with-comments has-sidebar pull-quote".split()
HEADINGS = ["Comments", "3 comments", "Related articles", "You may also like", "Leave a comment", "Most read", "Share this story", "Comentarios (4)"]


def test_articles_with_comments_related_links_and_adverts():
    """Random pages put together from what belongs to the article and what doesn't."""
    r = random.Random(4)

    def junk(i):
        text = "".join(f"<p>Weg{i} {j} nicht dazu.</p>" for j in range(r.choice([1, 2, 60])))
        kind = r.randrange(4)
        if kind == 0:
            return f'<div class="{r.choice(APART_NAMES)}">{text}</div>' if len(text) < 200 else f'<div id="comments">{text}</div>'
        if kind == 1:
            return f"<section><h3>{r.choice(HEADINGS)}</h3>{text}</section>"
        if kind == 2:
            return "<ul>" + "".join(f'<li><a href="/{j}">Weg{i} {j}</a></li>' for j in range(4)) + "</ul>"
        return r.choice([f"<aside>{text}</aside>", f"<form>{text}</form>", f"<nav>{text}</nav>", f"<footer>{text}</footer>", "<script>var weg = 1;</script>"])

    for n in range(200):
        parts, want = [f"<h1>Titel {n}</h1>"], [f"Titel {n}"]
        for i in range(r.randrange(4, 12)):
            body = f"Satz {i} von {n} gehört dazu &amp; bleibt."
            parts.append(r.choice([f"<p>{body}</p>", f'<div class="{r.choice(KEPT_NAMES)}"><p>{body}</p></div>', f"<section><h2>Teil {i}</h2><p>{body}</p></section>", f"<ul><li>{body}</li></ul>", f"<blockquote>{body}</blockquote>"]))
            want += ([f"Teil {i}"] if "Teil" in parts[-1] else []) + [body.replace("&amp;", "&")]
            if r.random() < 0.4:
                parts.append(junk(i))
        parts += [junk(99)] * r.randrange(2)
        page = f'<html><head><title>x</title></head><body class="has-sidebar"><header>Kopf</header>{junk(77)}<article class="post">{"".join(parts)}</article><div class="footer-links">Fuß</div></body></html>'
        assert html_extraction.main_texts([page], ["h"], 8, 3, 0.5) == [" ".join(want)], page


def test_short_articles_stay_and_teasers_go():
    long, end = "<article><h1>T</h1>" + "<p>Body text that goes on for a while here.</p>" * 8 + "</article>", "<article><p>A short second one.</p></article>"
    text = html_extraction.main_texts([f"<body>{long}{end}<article class='teaser'><p>Gone.</p></article><article><a href='/'>Gone too</a></article></body>"], ["h"], 8, 3, 0.5)[0]
    assert text.endswith("A short second one.") and "Gone" not in text


def test_quotation_sql_takes_the_nearest_original_of_any_length(spark, tmp_path):
    import duckdb

    r, said = random.Random(8), ["Why not?", "Yes, please", "No", "It rains here all the day long.", "no!"]
    rows = [(c, t, "user", "\n".join([*(f"{'> ' * r.randrange(1, 4)}{r.choice(said)}" for _ in range(r.randrange(3))), *(r.choice(said) for _ in range(r.randrange(3)))])) for c in range(5) for t in range(150)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.toPandas().to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    cursor = con.execute(quotation.SQL)
    names = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    assert Counter(tuple(x[c] for c in names) for x in quotation.link(table).collect()) == want
    assert sum(x[names.index("parent_turn")] is not None for x in want) > 300


def test_op2_counts_strings_in_whole_hosts_whatever_the_parts(spark):
    """Notices on few pages of a host, copies of articles with menus of their own, and hosts without a name: one result for all sizes of parts."""
    r = random.Random(7)
    say = lambda k: " ".join(f"v{r.randrange(100_000)}" for _ in range(k))
    rare, twice = [say(12) for _ in range(20)], [say(12) for _ in range(10)]
    articles = [f"{say(20)}</p><p>{say(25)}" for _ in range(90)]
    rows = []
    for i in range(180):
        url = ("http://big/", "http://small/", None)[i % 10 and (1 if i % 10 == 1 else 2 if i % 10 < 4 else 0)]
        menu, note = say(10), rare[i % 60] if i % 60 < 20 else twice[i % 90 - 60] if 60 <= i % 90 < 70 else say(12)
        body = f"<p>{articles[i % 90 if i % 3 else 0]}</p>"
        body = f"<article>{body}<p>{note}</p></article>" if i % 4 == 0 else f"<article>{body}</article><div>{note}</div>" if i % 4 == 1 else f"<div>{body}</div><div>{note}</div>"
        rows.append((i, url, f"<body><div>{menu}</div>{body}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [{x.page_id: x.text for x in html_extraction.extract(pages, part_bytes=n).select("row.page_id", "text").collect()} for n in (1 << 30, 20_000, 4_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    whole = dict(zip((i for i, *_ in rows), html_extraction.main_texts([h for *_, h in rows], [(u or "").split("/")[-2] if u else "" for _, u, _ in rows], 8, 3, 0.5), strict=True))
    assert got[0] == whole and any(n in html and n not in whole[i] for i, _, html in rows for n in rare)


def test_encoder_takes_known_letters_of_words_from_memory(monkeypatch):
    import pyarrow as pa

    from tessella.llm.token_ids import Encoder

    coder, asked = Encoder("word_bpe_49k.json"), []
    plain = coder._plain_ids
    monkeypatch.setattr(coder, "_plain_ids", lambda words: (asked.extend(words), plain(words))[1])
    for text in ("enötztz ofaning, 12 don't", "ofaning enötztz, (enötztz) ofaning; Enötztz!", None, "enötztz,ofaning ,, neu. neu"):
        got = coder.encode(pa.array([text], pa.string()), 2)[0].tolist()
        assert got == [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    assert sorted(asked) == ["enötztz", "neu", "ofaning"]
