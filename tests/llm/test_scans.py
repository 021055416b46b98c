"""License scan and URL filter against brute force, and their edge cases."""

import random
import re

import pytest

from pagemill.llm import license_scan, url_filter
from pagemill.llm.license_rules import BASE, REACH, RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_scan(text):
    words = WORD.findall(lower(text))
    spans, base = [], []
    for i, w in enumerate(words):
        left = "".join(x + " " for x in words[max(0, i - REACH) : i])
        right = "".join(" " + x for x in words[i + 1 : i + 1 + REACH])
        for table, into in ((RULES, spans), (BASE, base)):
            for rank, (label, before, gate, after) in enumerate(table):
                if gate == w:
                    a, b = re.search(before.replace(r"\z", r"\Z"), left), re.search(after.replace(r"\z", r"\Z"), right)
                    if a and b:
                        into.append((i - len(a[0].split()), -(i + 1 + len(b[0].split())), rank, label))
    kept, far = [], -1
    for lo, hi, _, label in sorted(spans):
        if -hi > far:
            kept.append((lo, -hi, label))
            far = -hi
    starts = [lo for lo, *_ in base]
    size = max((hi - lo for lo, hi, _ in kept), default=0)
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[3] for x in base})), ",".join(sorted({x[2] for x in kept} | {x[3] for x in base})), size / (size + 1) if size else 0.0,
    )


NOTICES = [
    "Licensed under the Apache License, Version 2.0", "the MIT License", "MIT license mit LICENSE", "GNU General Public License v3", "GNU Lesser General Public License version 2.1", "general public license", "All rights reserved.",
    "Copyright (c) 2019 X. All rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy", "creative commons attribution-sharealike 4.0", "mitlicense", "Apache License", "apache\x00license", "SPDX-License-Identifier: MIT", "see the LICENSE file for details",
    "European Union Public Licence v1.2", "tous droits réservés", "unlicensed", "public domain", "Neither the name of the owner nor the names of its contributors may be used to endorse or promote products",
]


def test_rules_are_many_and_sound():
    assert len(RULES) >= 200 and len({r[0] for r in RULES}) > 100
    for label, before, gate, after in RULES + BASE:
        assert "," not in label and WORD.fullmatch(gate) and re.compile(before.replace(r"\z", r"\Z")) and re.compile(after.replace(r"\z", r"\Z"))


def test_scan_against_brute_force(spark):
    rng = random.Random(1)
    filler = ["the", "code", "of", "é", "2", "version", "license", "mit", "general", "public", "apache", "x" * 50]
    texts = [None, "", " \n", "mit license", "MIT  License mit-license", "license " * 3000, "mit license " * 2000, "word " * 20_000 + "apache license"]
    texts += NOTICES + [" ".join(rng.choice(NOTICES) if rng.random() < 0.3 else rng.choice(filler) for _ in range(rng.randrange(30))) for _ in range(80)]
    rows = [(t, i, "z", 1) for i, t in enumerate(texts)] + [(texts[3], 3, "z", 1), ("mit license", None, None, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "text string, doc_id long, labels string, n int")).collect()
    want = sorted(str((i, *brute_scan(t))) for t, i, *_ in rows)
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in got) == want
    assert got[0].n in (1, None)


def test_suppression_keeps_the_longer_and_the_first(spark):
    got = license_scan.scan(spark.createDataFrame([("Licensed under the Apache License, Version 2.0",)], "text string")).first()
    assert got.labels == "apache,apache-2.0" and got.base_labels == "apache" and got.score == pytest.approx(8 / 9)


def brute_url(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "http://COM/en/x?y", "https://a.Example.com/en/7", "https://example.com/en/71#t", "https://example.com/en/8", "http://notexample.com/EN/7", "http://x.net/de/8", "http://example.net/de/8?a://b", "http://example.net?/de/8",
    "ftp://u:p@example.org/es/", "x://example.org:80/es/1", "http://org/es/\n", "http://.com/en/", "http://com./en/", "http:///en/", "://com/en/", "a b://c.org/es/?x#y", "http://example.org/es", "http://" + "a." * 300 + "com/en/" + "p" * 5000, "http://köln.de.net/de/ü",
]


@pytest.mark.parametrize("rules", [url_filter.RULES, (), (("com", "", "block"), ("b.com", "/x", "allow"), ("a.b.com", "", "block")), tuple((f"h{i}.org", f"/{i % 7}/", ("allow", "block")[i % 2]) for i in range(300))])
def test_urls_against_brute_force(spark, rules):
    rng = random.Random(2)
    urls = URLS + ["http://b.com/x", "http://a.b.com/x", "http://c.a.b.com/xyz", "http://com"] + [f"http://{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(600)}.org/{rng.randrange(9)}/{rng.randrange(50)}" for _ in range(1500)]
    rows = [(u, i, "h", 2) for i, u in enumerate(urls)] + [(URLS[5], 5, "h", 2), (URLS[6], None, None, None)]
    got = url_filter.judged(spark.createDataFrame(rows, "url string, page_id long, host string, key int"), rules=rules).collect()
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(str((i, *brute_url(u, rules))) for u, i, *_ in rows)
    assert got[0].key in (2, None)


def test_cascade_is_exact(spark):
    """Small filters let many keys pass wrongly; later levels set all of them right."""
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 4000, 20)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(4000)], "key string")
    levels = url_filter.cascade(listed, universe, 10)  # far too small a guess
    got = universe.where(url_filter.member(levels, universe.key)).collect()
    assert len(levels) > 2 and {r.key for r in got} == {f"k{i}" for i in range(0, 4000, 20)}


def test_a_long_list_of_a_large_universe(spark):
    """600,000 listed keys, sized as if the universe had 10 ** 9: a first level of 9.7 million bits."""
    listed = spark.range(600_000).selectExpr("concat('k', id) AS key")
    universe = spark.range(0, 1_400_000, 2).selectExpr("concat('k', id) AS key")
    levels = url_filter.cascade(listed, universe, 10**9)
    assert levels[0].bits > 1 << 23
    got = universe.where(url_filter.member(levels, universe.key)).selectExpr("count(*) AS n", "max(cast(substr(key, 2) AS int)) AS top").first()
    assert (got.n, got.top) == (300_000, 599_998)


def test_a_list_beyond_what_filters_hold_is_joined(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BITS", 200)
    rules = tuple((f"h{i}.org", f"/{i % 7}/", ("allow", "block")[i % 2]) for i in range(300)) + (("org", "", "block"), ("org", "", "allow"))
    urls = [*URLS, *(f"http://a.h{i}.org/{i % 7}/x" for i in range(0, 600, 5))]
    docs = spark.createDataFrame([(u, i) for i, u in enumerate(urls)] + [(urls[6], 6)], "url string, page_id long")
    got = url_filter.judged(docs, rules=rules).collect()
    want = [str((r.page_id, *brute_url(r.url, rules))) for r in got]
    assert len(got) == len(urls) + 1 and [str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got] == want


def test_empty_tables(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
