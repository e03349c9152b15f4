"""Operators that SQL cannot state, against plain versions in Python."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from fieldbook.llm import decontaminate, fingerprints, language, licenses, quality, toxicity, urls
from fieldbook.llm.storage import table

FOLDER = "/root/testdata/sf0.001"


# --- fingerprints ---------------------------------------------------------------------------------


def plain_spots(text):
    """Signatures of a text as strings, by a loop over its words."""
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    common = set(fingerprints.ANCHORS)
    if not words:
        return {text} if text else set()
    found = set()
    for i, w in enumerate(words):
        if i and w not in common:
            continue
        chain, at = [w], i + 1
        for _ in range(fingerprints.CHAIN):
            skipped = at
            while skipped < len(words) and words[skipped] in common and skipped - at < fingerprints.SKIP:
                skipped += 1
            if skipped >= len(words):
                # common words at the very end are content words, so that the chain ends with the text
                if skipped > at:
                    chain += words[at:skipped]
                    at = skipped
                break
            chain += words[at : skipped + 1]
            at = skipped + 1
        found.add(" ".join(chain))
    return found


TEXTS = [
    "", None, "...", "one", "the", "the cat sat on the mat", "The quick brown fox of the forest and the old grey wolf of the hills met by the river", "a b c d e f", "le chat et la souris sont dans le jardin",
    "of the and to in is it that for was on are as with be by this", "the one", "the of two and", "Der Hund und die Katze des Nachbarn", "x" * 3000, "the word " * 2000,
]


def test_signatures_equal_a_plain_loop(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    sizes = {r["doc_id"]: len(r["signatures"]) for r in fingerprints.fingerprints(docs).collect()}
    shown = {i: plain_spots(t) for i, t in enumerate(TEXTS)}
    assert {i: n for i, n in sizes.items() if i not in (9, 11)} == {i: len(s) for i, s in shown.items() if i not in (9, 11)}


def near_groups(sets, least=0.75):
    """Smallest reachable id of each document, by all pairs."""
    ids = sorted(sets)
    name = {i: i for i in ids}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-12:
                a, b = sorted((top(i), top(j)))
                name[b] = a
    return {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


def test_near_fingerprints_equal_all_pairs(spark, docs):
    more = [(10_000 + i, " ".join(f"the w{(i * k) % 37} of x{k}" for k in range(1, 30 + i % 5)), 1) for i in range(40)]
    more += [(20_000 + i, "the same words of a group " * 3 + " ".join(f"and y{k}" for k in range(25) if k != i % 26), 1) for i in range(60)]
    more += [(30_000, "", 1), (30_001, None, 1), (30_002, "...", 1), (30_003, "...", 1), (30_004, "same", 1), (30_004, "same", 1)]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string, sign int").select("doc_id", "text"))
    sets = {r["doc_id"]: set(r["signatures"]) for r in fingerprints.fingerprints(given).collect()}
    got = fingerprints.near_duplicates(given).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == near_groups(sets)
    assert len(got) == given.count() and all(r["n_signatures"] == len(sets[r["doc_id"]]) for r in got)
    assert {r["doc_id"]: r["n_same"] for r in got if r["doc_id"] >= 30_000} == {30_000: 1, 30_001: 1, 30_002: 2, 30_003: 2, 30_004: 2}
    assert fingerprints.near_duplicates(given.limit(0)).collect() == []
    strict = {r["doc_id"]: r["group_id"] for r in fingerprints.near_duplicates(given, 0.9).collect()}
    assert strict == near_groups(sets, 0.9)


def test_no_border_between_short_and_long_texts(spark):
    words = "the old man of the sea and the young boy by the river with a dog in the boat for the whole of a long day".split()
    texts = [(n, " ".join((words * 3)[:n])) for n in range(18, 60)]
    sets = {r["doc_id"]: set(r["signatures"]) for r in fingerprints.fingerprints(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    for n in range(18, 59):
        assert len(sets[n] & sets[n + 1]) / len(sets[n] | sets[n + 1]) >= 0.4


def test_neighbours_by_id_in_many_ranges(spark, monkeypatch):
    """Far outliers, null ids and ids that many rows share, in ranges of some rows each."""
    monkeypatch.setattr(fingerprints, "RANGES", fingerprints.Layout(segment_rows=20, stride=4, sample_rows=100_000))
    rows = [(i, f"text number {i} of the lot") for i in range(150)] + [(2**53, "far out the last"), (-(2**53), "far out the first")]
    rows += [(None, f"no id {i % 60} of the rows") for i in range(90)] + [(77, f"same id {i} of the rows") for i in range(90)]
    got = fingerprints.edited(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    import hashlib

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for (i, a), (_, b) in zip(order, [*order[1:], order[0]]):
        n = len(a) // 4
        want.append((i, len(a), hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.collect()), key=str) == sorted(want, key=str)


# --- licences -------------------------------------------------------------------------------------


def plain_words(text):
    text = re.sub(r"(?m)^\s*(?:#+|//+|\*+|;+|--+|/\*+)", " ", text.lower())
    return [w for w in re.split(licenses._BREAK, text) if w]


def plain_cosines(words):
    """Cosine of a header to every notice, by plain sums."""
    notices = {(name, i): plain_words(t) for name, texts in licenses.TEMPLATES.items() for i, t in enumerate(texts)}
    vectors = {k: Counter(zip(w, w[1:])) for k, w in notices.items()}
    holders = {}
    for (name, _), v in vectors.items():
        for p in v:
            holders.setdefault(p, set()).add(name)
    n = len(licenses.TEMPLATES)

    def weight(p):
        if p not in holders:
            return licenses.UNKNOWN
        plain = all(w in licenses.FUNCTION_WORDS for w in p)
        return math.log(1 + 1 / (2 * n)) if plain else math.log(1 + n / len(holders[p]))

    own = Counter(zip(words, words[1:]))
    side = lambda v: {p: (1 + math.log(c)) * weight(p) for p, c in v.items()}
    one = side(own)
    norm = math.sqrt(sum(x * x for x in one.values()))
    out = {}
    for (name, i), v in vectors.items():
        two = side(v)
        dot = sum(x * one.get(p, 0) for p, x in two.items())
        out[name, i] = dot / (norm * math.sqrt(sum(x * x for x in two.values()))) if norm else 0.0
    return out, sum(c for p, c in own.items() if p in holders) + 1


def plain_licence(path, text):
    words = plain_words(text or "") if re.search(licenses.MARK, text or "") else []
    headers = [words[max(0, i - licenses.BEFORE) : i + 1 + licenses.AFTER] for i, w in enumerate(words) if re.search(licenses.MARKED, w)]
    named = bool(re.search(licenses.NAMED, path))
    found, covered = [], 0
    for h in [*headers, *([words] if named and words else [])]:
        cosines, known = plain_cosines(h)
        fitting = [(name == licenses.RESERVED, -round(c, 9), name) for (name, _), c in cosines.items() if round(c, 9) >= licenses.LEAST]
        if fitting:
            found.append(min(fitting))
            covered = max(covered, known)
    if not found:
        return None
    _, below, name = min(found)
    return name, -below, named or 2 * covered >= len(words)


FILES = [
    ("LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files " + "and more words of it " * 30),
    ("src/a.py", "# Licensed under the Apache License,\n# Version 2.0. You may not use\n# this file except in compliance\nimport os\n" + "code here " * 60),
    ("src/b.py", "nothing said " * 40), ("src/deep/er/c.py", ""), ("src/deep/COPYING", "GNU Lesser General Public License"), ("lib/x.c", "/* Copyright 2020 X. All rights reserved.\n * Released under the MIT License. */"),
    ("lib/y.c", "The MIT License is not what this song is about"), ("lib/z.c", "we compare gpl 3.0 and others"), ("lib/s.c", "// SPDX-License-Identifier: BSD-3-Clause\n" + "int x " * 50), ("t/n.txt", "a license to sing all day"),
    ("t/m.txt", "ein Text mit vielen Worten und keiner License von uns"), ("t/o.txt", "Copyright (c) 2021 All rights reserved."), ("t/u/p.txt", None), ("v/notice.md", "to whom it may concern " * 9), ("v/w.txt", "x"),
    ("deep/1/2/3/4/5/f.txt", "f"), ("deep/1/LICENCE.txt", "Licensed under CC BY-NC 4.0"), ("deep/1/2/3/g.txt", "This work is licensed under a Creative Commons Attribution 4.0 International License " * 2),
]


def test_licences_equal_plain_cosines_and_nearest_ancestors(spark):
    files = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(FILES)] + [(99, None, "MIT License", "x")], "doc_id bigint, path string, text string, licence string")
    own = {p: found for p, t in FILES if (found := plain_licence(p, t))}
    speaks = {}
    for p, (name, score, loud) in sorted(own.items()):
        if loud:
            d = p.rpartition("/")[0]
            speaks[d] = min(speaks.get(d, (0.0, "~", "")), (-score, p, name))
    want = {99: (None, None, None)}
    for i, (p, _) in enumerate(FILES):
        if p in own:
            want[i] = (own[p][0], "own", p)
            continue
        d = p.rpartition("/")[0]
        while d not in speaks and d:
            d = d.rpartition("/")[0]
        want[i] = (speaks[d][2], "inherited", speaks[d][1]) if d in speaks else (None, None, None)
    got = licenses.scan(files).collect()
    assert {r["doc_id"]: (r["licence"], r["how"], r["from_path"]) for r in got} == want
    assert all(r["score"] == pytest.approx(own[r["path"]][1], abs=1e-8) for r in got if r["how"] == "own")
    shown = {p: own.get(p, (None,))[0] for p, _ in FILES}
    assert shown["lib/x.c"] == "MIT" and shown["src/a.py"] == "Apache-2.0" and shown["LICENSE"] == "MIT" and shown["lib/s.c"] == "BSD-3-Clause"
    assert shown["lib/z.c"] is shown["t/n.txt"] is shown["t/m.txt"] is None and shown["t/o.txt"] == "Proprietary"


def test_a_tenth_of_the_files_inherits(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["how"]: r["n"] for r in licenses.scan(licenses.as_files(documents)).groupBy("how").agg(F.count("*").alias("n")).collect()}
    marked = documents.where(F.col("text").rlike(r"MIT License|Apache License|General Public License|CC BY-NC|All rights reserved")).count()
    assert got["own"] == marked and got["inherited"] >= 90


# --- languages ------------------------------------------------------------------------------------


def plain_mixture(units, allowed, tolerance=1e-7):
    """Proportions by plain loops of expectation and maximisation."""
    share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(units[0]))]
    while True:
        total = [0.0] * len(share)
        for u in units:
            part = [s * math.exp(x) for s, x in zip(share, u)]
            for k, p in enumerate(part):
                total[k] += p / sum(part)
        new = [t / len(units) for t in total]
        if max(abs(a - b) for a, b in zip(new, share)) <= tolerance:
            return new, sum(math.log(sum(s * math.exp(x) for s, x in zip(new, u))) for u in units)
        share = new


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(6)
    size = np.array([1, 40, 7, 25])
    values = rng.normal(size=(size.sum(), 6)) * 2
    allowed = np.ones((4, 6), dtype=np.float32)
    allowed[3, 2:] = 0
    share, fit = language.proportions(np.exp(values), size, allowed, 1e-7)
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(4):
        want, value = plain_mixture(values[at[i] : at[i + 1]].tolist(), set(np.flatnonzero(allowed[i])))
        assert share[i] == pytest.approx(want, abs=1e-5) and fit[i] == pytest.approx(value, abs=1e-4)


def test_texts_of_five_languages_have_five(spark):
    """Languages of letters of their own, so that every unit tells its language."""
    alphabets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "äöüßé"]
    rng = np.random.default_rng(2)
    text = lambda k, n: " ".join("".join(rng.choice(list(alphabets[k]), 5)) for _ in range(n))
    rows = [(6 * i + k, text(k, 120), f"l{k}") for i in range(30) for k in range(6)]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    mixed = [(1, " ".join(text(k, 60) for k in range(5))), (2, text(3, 80)), (3, text(0, 150) + " " + text(5, 50)), (4, "12 34"), (5, None)]
    got = {r["doc_id"]: r for r in language.predicted(spark.createDataFrame(mixed, "doc_id bigint, text string"), model).collect()}
    sets = {i: [x.split()[0] for x in r["languages"].split(", ") if x] for i, r in got.items()}
    assert sorted(sets[1]) == ["l0", "l1", "l2", "l3", "l4"] and sets[2] == ["l3"] and sets[3] == ["l0", "l5"] and sets[4] == sets[5] == []
    assert got[3]["lang_pred"] == "l0" and got[3]["score"] == pytest.approx(900 / 1450, abs=0.05) and got[4]["lang_pred"] == "und"


# --- toxicity -------------------------------------------------------------------------------------


def plain_weights(word):
    """Weight of every subsequence of three letters, over all choices of places."""
    found = Counter()
    for at in combinations(range(len(word)), 3):
        span = at[2] - at[0] + 1
        if span <= toxicity.SPAN:
            found[tuple(word[i] for i in at)] += toxicity.DECAY**span
    return found


def plain_norm(word):
    return math.sqrt(sum(toxicity.DECAY ** (2 * (at[2] - at[0] + 1)) for at in combinations(range(len(word)), 3) if at[2] - at[0] < toxicity.SPAN))


def test_kernels_equal_all_subsequences():
    rng = np.random.default_rng(9)
    words = [rng.integers(1, 5, size=n) for n in (3, 4, 5, 8, 12, 20, 3, 7)]
    marks = [rng.integers(1, 5, size=n) for n in (3, 6, 9)]
    got = toxicity.kernels(words, marks)
    for i, s in enumerate(words):
        for j, t in enumerate(marks):
            one, two = plain_weights(s.tolist()), plain_weights(t.tolist())
            want = sum(v * two[u] for u, v in one.items()) / (plain_norm(s) * plain_norm(t))
            assert got[i, j] == pytest.approx(want, rel=1e-4)


def test_word_values_equal_all_subsequences():
    rng = np.random.default_rng(10)
    table = rng.normal(size=toxicity.LETTERS**3).astype(np.float32)
    words = [rng.integers(1, 30, size=n) for n in (1, 2, 3, 5, 11, 30)]
    got = toxicity.word_values(*toxicity.pack(words), table)
    for w, value in zip(words, got):
        if len(w) < 3:
            assert value == toxicity.NO_WORD
            continue
        want = sum(v * table[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c] for (a, b, c), v in plain_weights(w.tolist()).items()) / plain_norm(w)
        assert value == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_gaps_and_inserted_characters_weaken_a_word_only():
    word = lambda text: toxicity.folded(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])).letters
    marks = [word("dumbskull")]
    same, spaced, swapped, other = toxicity.kernels([word(t) for t in ("DuMbSkUlL", "d.u*m-b_s k u l l".replace(" ", "x"), "dumbskall", "weather")], marks)[:, 0]
    assert same > spaced > 0.2 and same > swapped > 0.2 and other < 0.1


# --- decontamination ------------------------------------------------------------------------------


def plain_leaks(docs, items):
    """Every item under every mask at every place of every document, then the stretches around what is equal."""
    number = {}
    coded = lambda text: np.array([number.setdefault(w, len(number)) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())], dtype=np.int64)
    found = set()
    for d, text in docs:
        doc = coded(text)
        for i, t in items:
            item = coded(t)
            if not len(item) or not len(doc):
                continue
            shifts = set()
            for mask in decontaminate.MASKS:
                for a in range(len(doc) - mask[-1]):
                    for b in range(len(item) - mask[-1]):
                        if all(doc[a + m] == item[b + m] for m in mask):
                            shifts.add(a - b)
            if len(item) < decontaminate.SPAN:
                shifts |= {a for a in range(len(doc) - len(item) + 1) if (doc[a : a + len(item)] == item).all()}
            if shifts and (got := decontaminate.overlap(doc, item, sorted(shifts))):
                found.add((d, i, len(item), *got))
    return found


def test_leaks_equal_all_masks_at_all_places(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 8, 9, 10, 14, 25, 40])))) for i in range(24)]
    docs, planted = [], 0
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 70))]
        if d % 2:
            own = items[d % 24][1].split()
            share = rng.choice([0, 0, 0.05, 0.1, 0.3])
            own = [rng.choice(vocabulary) if rng.random() < share else w for w in own]
            planted += share < 0.3
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((d, " ".join(words)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"], r["item_words"], r["matched"], r["first_word"]) for r in got.collect()}
    assert found == plain_leaks(docs, items)
    assert len({f[0] for f in found if f[0] % 2}) >= 0.9 * planted


# --- addresses ------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for text, verdict in urls.RULES:
        of, _, start = text.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best or (None, None)


def test_addresses_rules_and_probabilities(spark):
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "notexample.com", "x.net", "net", "com", "ExämPLE.org", "", "a:b@h.net:80", "spam-farm.example.org"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/", "/EN/", "//en/", "/en/../es/", "/a b"]
    tails = ["", "?q=/en/", "#top", "?x#y", "#/es/?z"]
    given = [f"{rng.choice(['http', 'https', '', 'x y'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(300)]
    given += [None, "", "no scheme", "http:/example.com/en/", "://", "http://a.com/" + "en/" * 20_000, given[0], given[0]]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string").selectExpr("page_id", "url", "'x' AS host", "1 AS rule", "2.5 AS probability", "'y' AS grams")
    model = urls.train(urls.labelled_urls(spark))
    got = {r["page_id"]: r for r in urls.judged(rows, model).collect()}
    weights, place = model.coefficients.toArray(), HashingTF(numFeatures=urls.FEATURES)
    number = {}
    for i, url in enumerate(given):
        host, path = plain_url(url)
        rule, verdict = plain_rule(host, path)
        grams = {f"{mark}{n}:{framed[at : at + n]}" for mark, t in (("h", host), ("p", path)) if t for framed in [f"^{t}$"] for n in urls.GRAMS for at in range(len(framed) - n + 1)}
        for g in grams - number.keys():
            number[g] = place.indexOf(g)
        risk = 1 / (1 + math.exp(-(model.intercept + sum(weights[k] for k in {number[g] for g in grams}))))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["risk"] == pytest.approx(risk, abs=1e-9)
        assert r["verdict"] == (verdict or ("block" if risk >= 0.5 else "allow"))
    assert urls.judged(rows.limit(0), model).collect() == []


# --- quality --------------------------------------------------------------------------------------


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(90, 4)) * [1, 2, 3, 0.1] + 1])
    y = np.repeat([0, 1], [60, 90])
    pool, diagonal = 0.1, 0.05
    model = quality.fit(x, y, pool, diagonal)
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (60 * own[0] + 90 * own[1]) / 150
    logs = []
    for k, share in ((0, 60), (1, 90)):
        c = (1 - pool) * own[k] + pool * pooled
        c = (1 - diagonal) * c + diagonal * np.trace(c) / 4 * np.eye(4) + 1e-9 * np.eye(4)
        away = z - z[y == k].mean(axis=0)
        logs.append(math.log(share) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), abs=1e-9)


def test_statistics_equal_plain_counts():
    text = "The quick brown Fox!! jumps | over\nthe the lazy dog 123, and the extraordinarily long word; yes? #tag é"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    got = dict(zip(quality.STATISTICS, quality.statistics(quality.words_of(data, np.array([0, len(data)])))[0]))
    words = text.split()
    n, chars = len(words), len(text)
    lower = [w.lower() for w in words]
    want = {
        "words": math.log1p(n), "word_length": math.log1p(sum(len(w.encode()) for w in words) / n), "long_words": math.sqrt(sum(len(w.encode()) > 12 for w in words) / n),
        "upper": math.sqrt(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / chars), "digits": math.sqrt(sum(c.isdigit() for c in text) / chars),
        "sentence_marks": math.sqrt(sum(c in ".,;:?" for c in text) / n), "shouting": math.sqrt(text.count("!") / n), "bars": math.sqrt(text.count("|") / n), "lines": math.sqrt(1 / n),
        "distinct_words": math.sqrt(len(set(lower)) / n), "repeated_words": math.sqrt(sum(a == b for a, b in zip(lower, lower[1:])) / n),
        "distinct_shingles": math.sqrt(len(set(zip(lower, lower[1:], lower[2:]))) / (n - 2)), "spaces": math.sqrt(text.count(" ") / chars), "other_bytes": math.sqrt(1 / chars),
    }
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-9)
