"""Dictionary scan against a search of every alias at every word."""

import random
from collections import Counter

import pytest

from tessella.operators import scan


def brute(words, entries, guards):
    out = []
    for phrase, name in entries:
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            before = words[:i]
            if words[i : i + len(p)] == p and not any(before[-len(g) :] == g for g in (x.split(" ") for x in guards)):
                out.append((name, i, len(p)))
    return out


def plain_longest(hits):
    kept = []
    for h in sorted(hits, key=lambda h: (-h[2], h[1], h[0])):
        if all(h[1] >= k[1] + k[2] or k[1] >= h[1] + h[2] for k in kept):
            kept.append(h)
    return kept


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    r = random.Random(seed)
    phrase = lambda most: " ".join(r.choices("abcd", k=r.randrange(1, most)))
    entries = list({(phrase(5), r.choice("XYZ")) for _ in range(12)})
    guards = [phrase(3) for _ in range(2)]
    words = r.choices("abcde", k=200)
    hits = scan.Automaton(entries, guards).hits(words)
    assert Counter(hits) == Counter(set(brute(words, entries, guards)))
    assert Counter(scan.longest_of(hits)) == Counter(plain_longest(hits))


@pytest.mark.parametrize("most", [8 << 20, 20])
def test_spans(spark, most):
    docs = spark.createDataFrame([(1, "Obras de Juan  Sebastian BACH; Teatro Händel."), (2, None), (3, ""), (1, "bach"), (4, "Homenaje a Bach y Johann Christian Bach")], "id long, text string")
    names = spark.createDataFrame([("Bach", "JSB"), ("Juan Sebastián Bach", "JSB"), ("Johann Christian Bach", "JCB"), ("Handel", "GFH"), (None, "x"), ("", "y")], "alias string, name string")
    got = {(r.id, r.name, r.start, r.n_words) for r in scan.spans(docs, "id", "text", names, "alias", "name", guards=("teatro", "homenaje a"), longest_wins=True, most_bytes=most).collect()}
    assert got == {(1, "JSB", 2, 3), (1, "JSB", 0, 1), (4, "JCB", 4, 3)} or most == 20 and got >= {(1, "JSB", 2, 3), (4, "JCB", 4, 3)}


def test_a_long_text_of_names_is_linear():
    hits = scan.Automaton([("a", "A"), ("a a", "B"), ("a a a", "C")]).hits(["a"] * 300_000)
    assert len(hits) == 899_997 and len(scan.longest_of(hits)) == 100_000
