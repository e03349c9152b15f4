"""The training-data operators on small tables, against plain versions of what they compute."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import decontaminate, fingerprints, language, licenses, mixing, ngram_join, pii, quality, toxicity, urls
from fieldbook.llm.storage import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, size int"
LONG = "Plain words stand here in a long row. " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, "some text of no id here", "en", "a", 24), (4, LONG, "en", "b", len(LONG)),
        (5, LONG, "en", "b", len(LONG)), (6, "one two three", "en", None, 13), (6, "one two three", "en", None, 13), (7, "\n\t \r", "en", "a", 4),
        (8, "Ünïcode über alles größer", "de", "a", 25), (9, "9" * 50_000, "en", "a", 50_000), (10, "1 2 " * 20_000, "en", "a", 80_000), (11, "the " * 20_000, "en", "b", 80_000),
    ]
    return spark.createDataFrame([(*r, 0.5, "k", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_odd_rows_and_empty_tables(spark, odd, none, docs, labels):
    model, toxic, known, benchmark = quality.train(docs, labels), toxicity.train(docs, labels), language.learn(docs), table(spark, FOLDER, "benchmark")
    runs = {
        "quality": lambda d: quality.quality_scores(d, model), "toxicity": lambda d: toxicity.toxic_scores(d, toxic), "language": lambda d: language.predicted(d, known),
        "pii": pii.digest, "near": ngram_join.near_duplicates, "mix": mixing.mix, "fingerprints": fingerprints.edited, "licences": lambda d: licenses.scan(licenses.as_files(d), d),
    }
    for name, run in runs.items():
        assert len(run(odd).collect()) == odd.count(), name
        assert run(none).collect() == [], name
    assert decontaminate.leaks(odd, benchmark).count() == 0 and decontaminate.leaks(none, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
        assert stage(spark, odd, FOLDER).count() <= odd.count()


def test_training_without_labels(docs, labels, none):
    assert 0 <= quality.quality_scores(docs, quality.train(docs, labels.limit(0))).first()["score"] <= 1
    assert toxicity.toxic_scores(docs, toxicity.train(docs, labels.limit(0))).agg(F.max("predicted")).first()[0] == 0
    assert {r["lang_pred"] for r in language.predicted(docs, language.learn(none)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = quality.quality_scores(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    got = language.predicted(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = toxicity.toxic_scores(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.9 and got[got.toxic == 0].predicted.mean() < 0.03
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_string_kernel_tolerates_insertions():
    text = "i.d.i.o.t i d i o t idiot IDIOT 1d10t"
    f = toxicity.folded(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))
    assert len(f.row) == 5 and all("".join(chr(96 + c) for c in f.letters[a:b]) == "idiot" for a, b in zip(f.bounds, f.bounds[1:]))
    code = lambda w: np.array([ord(c) - 96 for c in w], dtype=np.int64)
    near = toxicity.kernels([code("idiot"), code("idxiot"), code("garden")], [code("idiot")])[:, 0]
    assert near[0] > near[1] > 0.3 > near[2]


def test_near_duplicates_lose_no_link(spark):
    rng, rows = np.random.default_rng(5), []
    vocabulary = [f"w{i}" for i in range(400)]
    for group in range(12):
        base = list(rng.choice(vocabulary, size=int(rng.integers(5, 120))))
        for _ in range(int(rng.integers(1, 60))):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, len(w) // 12)))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocabulary))
            w += list(rng.choice(vocabulary, size=int(rng.integers(0, 1 + len(base) // 4))))
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_every_threshold_pair_meets_under_a_marked_key():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n, extra = int(rng.integers(3, 300)), 0
        pool = rng.integers(1, 2**62, size=3 * n).astype(np.uint64)
        x = pool[:n]
        gone = int(rng.integers(0, n // 7 + 1))
        extra = int(rng.integers(0, n // 3 + 1))
        y = np.concatenate([x[gone:], pool[n : n + extra + gone]])
        both = len(np.intersect1d(x, y))
        if 4 * both < 3 * (len(x) + len(y) - both):
            continue
        share = rng.random()
        of = lambda t: np.where(t % np.uint64(97) < np.uint64(int(97 * share)), 3, 1).astype(np.uint8)  # noqa: E731, B023
        a, b = sorted((np.sort(x), np.sort(y)), key=len)
        ka, kb = ngram_join.index_keys(a, of(a)), ngram_join.index_keys(b, of(b))
        assert len(np.intersect1d(ka[ka % np.uint64(2) == 1] >> np.uint64(1), kb >> np.uint64(1)))


def test_leaks_with_substituted_and_inserted_words(spark):
    item = " ".join(f"term{i}" for i in range(30))
    changed = item.split()
    for i in (3, 11, 19, 27):
        changed[i] = "other"
    longer = item.split()[:15] + ["put", "between"] + item.split()[15:]
    rows = [(1, f"before {item.upper()} after"), (2, "x y " + " ".join(changed)), (3, " ".join(longer)), (4, " ".join(item.split()[:8])), (5, " ".join(f"free{i}" for i in range(90))), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, item), (8, "too short to find"), (9, None)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["item_id"], r["matched"], r["first_word"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    # two words behind a substitution are not worth it
    assert got == {1: (7, 30, 1), 2: (7, 24, 2), 3: (7, 30, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()) == [4, 5, 6]


def test_leaks_around_replaced_runs_and_of_short_items(spark):
    def laid(*parts):
        """Words of an item of that many, those of even parts as they are, of odd parts replaced."""
        w = [f"t{len(parts)}{sum(parts)}x{i}" for i in range(sum(parts))]
        kept = [i % 2 == 0 for i, n in enumerate(parts) for _ in range(n)]
        return " ".join(w), " ".join(x if k else f"other{i}" for i, (x, k) in enumerate(zip(w, kept)))

    pairs = [laid(10, 5, 10), laid(11, 6, 11), laid(10, 5, 10, 5, 10), laid(3, 1, 5)]
    items = [(i, a) for i, (a, _) in enumerate(pairs)] + [(4, "so few words"), (None, " ".join(f"null{i}" for i in range(20))), (0, " ".join(f"again{i}" for i in range(12)))]
    benchmark = spark.createDataFrame([*items, (None, None), (9, "")], "item_id bigint, text string")
    texts = [b for _, b in pairs] + ["they are SO few words here", items[5][1], items[6][1], "so few other words"]
    docs = spark.createDataFrame([(i, f"before it {t} after") for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["item_id"], r["item_words"], r["matched"], r["first_word"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {0: (0, 25, 20, 2), 1: (1, 28, 22, 2), 2: (2, 40, 30, 2), 3: (3, 9, 8, 2), 4: (4, 3, 3, 4), 5: (None, 20, 20, 2), 6: (0, 12, 12, 2)}
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()] == [7]


def test_stretches_against_the_best_one_again_and_again():
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(int(rng.integers(0, 40))) < rng.choice([0.5, 0.7, 0.9])
        got = decontaminate.stretches_of(same)
        assert all(same[a] and same[b - 1] for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        worth = lambda a, b: int(np.where(same[a:b], 1, -decontaminate.MISMATCH).sum())  # noqa: E731, B023
        assert max((worth(a, b) for a, b in got), default=0) == max(worth(a, b) for a in range(len(same) + 1) for b in range(a, len(same) + 1))
        assert sum(same[a:b].sum() for a, b in got) == same.sum()


def test_mix_meets_targets(spark, docs):
    got = mixing.mix(docs).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (abs(by.taken - by.target) <= 2).all() and (got.taken <= 3 * got["size"]).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6
    again = mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (again.taken == got.sort_values("doc_id").reset_index(drop=True).taken).all()


def test_url_rules_and_model(spark):
    rows = [
        (1, "http://www.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "https://a.example.com/en/2", "a.example.com", "/en/2", "example.com/en/", "block"),
        (3, "https://b.com/x", "b.com", "/x", "com/", "allow"), (4, "https://b.com", "b.com", "", None, "allow"), (5, "https://x.net/es/4#t", "x.net", "/es/4", "net/es/", "block"),
        (6, None, "", "", None, "allow"), (7, "no address", "", "", None, "allow"), (8, "https://www.casino-win.example.org/en/4", "www.casino-win.example.org", "/en/4", None, "block"), (9, "https://notcom/en/", "notcom", "/en/", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id bigint, url string")
    got = urls.judged(pages, urls.train(urls.labelled_urls(spark))).drop("risk")
    assert sorted(tuple(r) for r in got.collect()) == [(r[0], *r[2:]) for r in rows]


def test_personal_data_kinds(spark):
    text = "pay 4111 1111 1111 1111 now, IBAN DE89370400440532013000 and DE89370400440532013001; ssn 123-45-6789, no 123-45-6780 é a@b.co 1.2.3.4 1.2.3.400 +1 (499) 555-6503"
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    found = [tuple(x.split("/")[0].split(":")) for x in row["found"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in found] == [
        ("email", "a@b.co"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503"), ("iban", "DE89370400440532013000"), ("ssn", "123-45-6789"),
    ]
    kept = pii.masked(spark.createDataFrame([(1, text, 5)], "doc_id bigint, text string, n_chars bigint")).first()
    assert "[CARD]" in kept["text"] and "4111" not in kept["text"] and kept["n_chars"] == len(kept["text"])


def test_accounts_before_words_and_listed_numbers(spark):
    accounts = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29NWBK60161331926819", "NL91ABNA0417164300"]
    texts = [f"IBAN {accounts[0]} BIC COBADEFFXXX", f"{accounts[1]} BIC: X", f"{accounts[2]} EUR 500", f"{accounts[3]} 2024", f"NO12 {accounts[0]}", f"{accounts[1]} {accounts[2]}", f"ab {accounts[3]}1 NL92ABNA0417164300"]
    want = [accounts[:1], accounts[1:2], accounts[2:3], accounts[3:], accounts[:1], accounts[1:3], []]
    texts += ["SSN: 123-45-6789, 234-56-7890 and 345-67-8901", "social security 000-12-3456 void, 123-45-6789", "ssn 123-45-6789, no 234-56-7890", "123-45-6789"]
    want += [["123-45-6789", "234-56-7890", "345-67-8901"], ["123-45-6789"], ["123-45-6789"], []]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.personal_data(df).collect():
        spans = [x.split("/")[0].split(":") for x in r["found"].split(",") if x]
        assert [r["text"][int(a) : int(b)] for k, a, b in spans if k in ("iban", "ssn")] == want[r["doc_id"]], r["text"]
    for r in pii.masked(df).collect():
        assert not any(w in r["text"] for w in want[r["doc_id"]]), r["text"]
        assert r["text"].count("[IBAN]") + r["text"].count("[SSN]") == len(want[r["doc_id"]])


def test_fingerprints_of_next_and_edited(docs):
    got = fingerprints.edited(docs).toPandas().sort_values("doc_id")
    texts = [t or "" for t in docs.orderBy("doc_id").toPandas().text]
    import hashlib

    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, texts[1:] + texts[:1])]
    assert [hashlib.sha256(e.encode()).hexdigest() for e in edited] == list(got.edited_sha256)
    assert got.near_edited.mean() > 0.45 > 0.1 > got.near_next.mean()
    assert got.groupby([t for t in texts]).fingerprint.nunique().max() == 1


def test_licences_are_found_and_inherited(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/code.py", "no word of it"), (3, "a/b/own.py", "x\n# Licensed under the Apache License, Version 2.0.\n" + "code " * 40), (4, "c/code.py", "nothing"), (5, None, "x"), (6, "a/b/c/d.py", None)]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["how"], r["from_path"]) for r in licenses.scan(files, files).collect()}
    inherited = ("MIT", "inherited", "a/LICENSE")
    assert got == {1: ("MIT", "own", "a/LICENSE"), 2: inherited, 3: ("Apache-2.0", "own", "a/b/own.py"), 4: (None, None, None), 5: (None, None, None), 6: inherited}


def test_licences_do_not_depend_on_the_number_of_documents(spark):
    notices = {
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "Proprietary", "# Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "under the GNU General Public License, version 3": "GPL-3.0", "under the GNU Lesser General Public License, version 3": "LGPL-3.0", "subject to the Mozilla Public License": "MPL-2.0",
        "Copyright X. All rights reserved. Under the MIT License.": "MIT", "ein Text mit vielen Worten und keiner License von uns": None, "a license to sing all day": None,
    }
    files = spark.createDataFrame([(i, f"a/{i}.txt", f"{n}\n" + "word " * 50) for i, n in enumerate(notices)], "doc_id bigint, path string, text string")
    prose = spark.createDataFrame([(100 + i, f"the words under of version {i} and so on") for i in range(190)], "doc_id bigint, text string")
    docs = files.select("doc_id", "text").union(prose)
    many = docs.crossJoin(spark.range(1000).select(F.lit(1).alias("copy"))).select("doc_id", "text")
    more = docs.union(spark.range(1000, 300_000).select("id", F.lit("plain words of no kind").alias("text")))
    once, again, rare = ({r["doc_id"]: (r["licence"], r["score"]) for r in licenses.scan(files, d).collect()} for d in (docs, many, more))
    assert once == again
    assert [once[i][0] for i in range(len(notices))] == [rare[i][0] for i in range(len(notices))] == list(notices.values())


def test_pipeline_against_its_stages(spark, docs):
    """Every decision of the stages is checked on the documents that a stage was given."""
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    benchmark = table(spark, FOLDER, "benchmark")
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, FOLDER).cache()
        assert out.columns == docs.columns
        if name == "near_duplicates":
            sets = [shingles(r["text"]) for r in out.collect()]
            for i, s in enumerate(sets):
                for t in sets[:i]:
                    both = len(s & t)
                    assert not both or 100 * both < 75 * (len(s) + len(t) - both)
        given = out
    items = [words(r["text"]) for r in benchmark.collect()]
    for r in given.collect():
        text = " ".join(words(r["text"]))
        assert not any(" ".join(i) in text for i in items if len(i) >= 10)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "")
    assert set(kept) <= {r["doc_id"] for r in given.collect()} and all(0 < r["taken"] <= 3 * r["size"] for r in kept.values())
