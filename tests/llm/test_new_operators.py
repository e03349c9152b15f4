"""Alignment, archives and the prefix trie on small tables, against plain versions of what they compute."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard


from fieldbook.llm import alignment, prefix_trie, sparse, warc
from fieldbook.llm.storage import shared_folder, table

FOLDER = "/root/testdata/sf0.001"
ODD_TEXTS = [
    "", None, "a", " ", "\n\t \r", "<s> </s> <unk> <|endoftext|> <0x41>", "▁ in the text", "Ünïcode über alles größer 日本語 🙂🙂 ​", "\x00 zero", "9" * 5000, "a" * 3000,
    "the " * 4000, "Ends in blanks   ", "   starts in blanks", "tabs\t\tand\r\nlines\n\n", "same text here", "same text here", "é combining",
]


# --- sparse matrices ------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_products_equal_dense_ones(most):
    rng = np.random.default_rng(4)
    for rows, inner, columns in ((5, 4, 6), (1, 9, 3), (30, 20, 25), (3, 2, 0)):
        dense = [rng.integers(0, 4, size=shape) * (rng.random(shape) < 0.4) for shape in ((rows, inner), (inner, columns))]
        a, b = (sparse.Csr(np.concatenate([[0], np.cumsum((x != 0).sum(axis=1))]), np.nonzero(x)[1], x[np.nonzero(x)], x.shape[1]) for x in dense)
        got = np.zeros((rows, columns), dtype=np.int64)
        for first, c in sparse.products(a, b, most):
            got[first + c.row_numbers(), c.columns] = c.values
        assert (got == dense[0] @ dense[1]).all()
        back = a.transposed().transposed()
        assert (back.columns == a.columns).all() and (back.values == a.values).all() and (back.starts == a.starts).all()
        assert sparse.row_work(a, b).sum() == sum((dense[0][i] != 0) @ (dense[1] != 0).sum(axis=1) for i in range(rows))


# --- alignment ------------------------------------------------------------------------------------


def plain_alignment(texts):
    """For each text its A ids, B ids, groups, and links as id pairs with places and shared bytes; None without tokens."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    out = []
    for text in texts:
        one, two = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        words = [bytes(byte[c] for c in a.id_to_token(i)) for i in one]
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
        whole = f" {text}".encode()
        if not text or b"".join(words) != whole or b"".join(pieces) != whole:
            out.append(None)
            continue
        spans = []
        for parts in (words, pieces):
            at, found = 0, []
            for p in parts:
                found.append((at, at + len(p)))
                at += len(p)
            spans.append(found)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [tuple([i for i, (_, e) in enumerate(s) if begin < e <= end] for s in spans) for begin, end in zip([0, *ends], ends)]
        links = []
        for x, y in groups:
            for i in x:
                for j in y:
                    shared = min(spans[0][i][1], spans[1][j][1]) - max(spans[0][i][0], spans[1][j][0])
                    links.append((i, j, max(shared, 0)))
        out.append((one, two, groups, links))
    return out


@pytest.fixture(scope="module")
def tokenizers(spark):
    return alignment.public_tokenizers(spark)


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(None if i == 5 else i, text, "x", 1) for i, text in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block string, key int")


def digests(texts):
    found = plain_alignment(texts)
    counts = Counter((x[0][i], x[1][j]) for x in found if x for i, j, shared in x[3] if shared)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        one, two, groups, links = x
        pairs = [(one[i], two[j]) for i, j, shared in links if shared]
        text = ";".join(",".join(str(one[i]) for i in g) + "|" + ",".join(str(two[j]) for j in h) for g, h in groups)
        rows.append((len(one), len(two), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest(), len(links)))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


@pytest.mark.parametrize("block_bytes", [1, 3000, alignment.BLOCK_BYTES])
def test_alignment_of_odd_texts(odd_docs, tokenizers, block_bytes):
    texts = [r["text"] for r in odd_docs.collect()]
    got = alignment.digest(odd_docs.repartition(3), tokenizers, block_bytes)
    assert got.columns[:8] == ["doc_id", *COLUMNS[:7]]
    want = digests(texts)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)
    by_id = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert all(by_id[None if i == 5 else i] == row for i, row in enumerate(want))
    assert all(n_links == n_a + n_b - n_groups for n_a, n_b, n_groups, n_links, *_ in want)


def test_alignment_of_documents(spark, tokenizers):
    docs = table(spark, FOLDER, "documents").orderBy("doc_id").limit(60)
    rows = docs.collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.digest(spark.createDataFrame(rows, docs.schema), tokenizers).collect()}
    assert got == {r["doc_id"]: d for r, d in zip(rows, digests([r["text"] for r in rows]))}


def test_links_with_places(odd_docs, tokenizers):
    found = plain_alignment([r["text"] for r in odd_docs.collect()])
    few = odd_docs.where("doc_id in (2, 6, 7, 17, 15)")
    for within in ("bytes", "groups"):
        got = {(r["doc_id"], r["a_place"], r["b_place"]): (r["a"], r["b"], r["shared"]) for r in alignment.links(few, tokenizers, within).collect()}
        want = {(d, i, j): (x[0][i], x[1][j], s if within == "bytes" else 1) for d in (2, 6, 7, 17, 15) if (x := found[d]) for i, j, s in x[3] if s or within == "groups"}
        assert got == want
    with pytest.raises(ValueError, match="within"):
        alignment.links(few, tokenizers, "other")


def test_alignment_of_nothing(odd_docs, tokenizers):
    assert alignment.digest(odd_docs.limit(0), tokenizers).collect() == []
    assert alignment.links(odd_docs.limit(0), tokenizers).collect() == []
    assert {tuple(r)[1:8] for r in alignment.digest(odd_docs.select("doc_id"), tokenizers).collect()} == {(0, 0, 0, 0, 0, 0, "")}


# --- archives -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "Plain words stand here in a long row. " * 20_000 + "</p>"
    rows = [
        (1, "http://a/", "x" * 99), (2, "http://a/", "x" * 99), (3, None, "y" * 100), (4, "", "y" * 100), (None, "http://n/", "y" * 100), (5, "http://e/\r\nEvil: yes", None), (6, "http://e/", ""),
        (7, "http://ü/ä b", "é" * 50), (8, "u", "é" * 50), (9, "u", big), (10, "u", big), (10, "u", big), (11, "u", "a\r\n\r\nb" * 40), (None, "z", "q" * 200), (None, "z", "q" * 200), (-3, "w", "y" * 100),
    ]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, digest string, size int")


def plain_records(rows):
    first = {}
    for r in rows:
        payload = (r["html"] or "").encode()
        if len(payload) >= 100 and r["page_id"] is not None:
            first[payload] = min(r["page_id"], first.get(payload, r["page_id"]))
    out = []
    for r in rows:
        payload = (r["html"] or "").encode()
        to = first.get(payload)
        to = None if to == r["page_id"] else to
        out.append((r["page_id"], len(payload), hashlib.sha256(payload).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_archives_of_odd_pages(spark, odd_pages):
    got = warc.archived(odd_pages.repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_records(odd_pages.collect())
    assert warc.archived(odd_pages.limit(0)).collect() == []
    assert warc.archived(odd_pages.drop("html", "url")).count() == odd_pages.count()


@pytest.mark.parametrize("archive_bytes", [1, 1 << 14, warc.ARCHIVE_BYTES])
def test_archives_round_trip(spark, archive_bytes, tmp_path):
    pages = table(spark, FOLDER, "pages")
    path = str(tmp_path / "pages")
    warc.write_archives(pages, path, archive_bytes=archive_bytes)
    rows = warc.read_archives(spark, path)
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.resolved(rows).collect()} == html
    urls = {r["page_id"]: r["url"] for r in rows.collect()}
    assert urls == {r["page_id"]: r["url"] for r in pages.collect()}
    # a plain reader of Zstandard files: dictionary from the first frame, every other frame by itself
    for file in (tmp_path / "pages").glob("part-*"):
        data = file.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        body = data[8 + size :].removesuffix(warc.SEPARATOR)
        text = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(body), read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(list(warc.records_in(memoryview(data))))
        assert len(text) > len(body)


def test_records_and_dictionaries():
    payload, digest = b"<p>\r\n\r\n</p>", hashlib.sha256(b"<p>\r\n\r\n</p>").hexdigest()
    data = warc.record(5, "http://x/a b", payload, len(payload), digest, None, "2024-01-01T00:00:00Z")
    assert warc.parsed(data)["payload"] == payload and warc.parsed(data)["url"] == "http://x/a%20b"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(data.replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError, match="whole"):
        warc.parsed(data[:-1])
    assert warc.trained([]) == b"" and warc.trained([b"abc"]) == b"" and warc.trained([b"abcdefgh" * 9]) != b""
    samples = [b"the same start of all records %d " % i * 60 for i in range(64)]
    assert 0 < len(warc.trained(samples, 4096)) <= 4096
    for content in (b"", b"a", bytes(300_000), np.random.default_rng(0).bytes(300_000), b"ab" * 200_000):
        for checksum in (False, True):
            frame = zstandard.ZstdCompressor(write_checksum=checksum).compress(content)
            assert warc.frame_end(memoryview(b"??" + frame + b"tail"), 2) == 2 + len(frame)


# --- prefix trie ----------------------------------------------------------------------------------


def plain_trie(rows, family=100, longest=6):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(a, b) for _, a, b in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % longest
        full[c] = own.get(c - c % family, [])[:h] + v[h:]
    nodes, children, leaves, saved = {}, {}, {}, {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(full[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, key string, shard int"


def generated(seed):
    """Few different turns, so that conversations share much; a third of them are one conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(300, 420), *range(700, 760)]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 40 if seed % 2 else 4])
        for t in range(n):
            text = "ab"[t % 2] * 3 if c % 3 == 0 else rng.choice(["x", "yy", "zzz"])
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None]) if c % 3 else "user", None if rng.random() < 0.05 else text, "k", 1))
    return rows


@pytest.mark.parametrize("seed,shards", [(0, 1), (0, 3), (0, 25), (1, 1), (1, 4), (1, 90), (2, 200), (3, 12)])
def test_trie_of_generated_conversations(spark, seed, shards):
    rows = generated(seed)
    got = prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(3), shards)
    assert got.columns == prefix_trie.NODE
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie([r[:4] for r in rows])


def test_trie_of_odd_conversations(spark):
    rows = [
        (100, 0, "user", "a"), (100, 0, "user", "a"), (100, None, None, None), (100, 1, None, "é🙂"), (101, 3, "user", "a"), (7, 0, "u", "x"), (207, 5, "u", "x"), (None, 0, "user", "lost"),
        (None, None, None, None), (-5, 0, "u", "neg"), (102, 0, "user", "a"), (9_000_000_000_000_001, 1, "u", "x" * 100_000), (500, 0, "u", ""), (501, 0, "", ""), (502, 0, None, None),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], CONVERSATIONS)
    for shards in (None, 1, 5, 13):
        assert sorted((tuple(r) for r in prefix_trie.trie(df, shards).collect()), key=str) == plain_trie(rows)
    assert prefix_trie.trie(df.limit(0)).collect() == []
    assert prefix_trie.trie(df.where("conv_id IS NULL")).collect() == []
    other = prefix_trie.trie(df, 4, family=10, longest=3)
    assert sorted((tuple(r) for r in other.collect()), key=str) == plain_trie(rows, 10, 3)


def test_long_conversations_take_several_matrices():
    rng = np.random.default_rng(8)
    base = [rng.bytes(16) for _ in range(100)]
    paths = [b"".join(base[: 5 + i % 95]) + (rng.bytes(16) if i % 4 == 0 else b"") for i in range(300)]
    lengths = np.concatenate([np.arange(len(p) // 16) % 7 for p in paths])
    bounds = np.concatenate([[0], np.cumsum([len(p) // 16 for p in paths])])
    convs = rng.permutation(300)
    wide, narrow = (prefix_trie.Shard(convs, paths, lengths, bounds, columns) for columns in (1000, 8))
    assert (wide.order == narrow.order).all() and len(wide.levels) == len(narrow.levels)
    for x, y in zip(wide.levels, narrow.levels):
        assert all((x[k] == y[k]).all() for k in ("first", "n", "children", "leaves", "saved", "conv", "ending"))
    assert [(paths[i], convs[i]) for i in wide.order] == sorted(zip(paths, convs))


def test_turns_are_told_apart_by_role_and_text(spark):
    rows = [(0, 0, "ab", "c", "k", 1), (1, 0, "a", "bc", "k", 1), (2, 0, "", "abc", "k", 1)]
    got = prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS)).where("depth = 0").first()
    want = plain_trie([r[:4] for r in rows])
    assert got["n_children"] == next(r for r in want if r[1] == 0)[4]


def test_shared_folder_is_the_one_of_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == shared_folder(spark)
