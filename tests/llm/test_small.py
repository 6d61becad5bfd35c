"""Operators on small hand-made tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import langid, line_dedup, near_dedup, neighbours, packing, passages, pieces, sampling, tiff, url_filter
from ledgerlake.llm._words import Words, shingles, utf8
from ledgerlake.llm.queries import RULES, vocabulary

SHAPE = "doc_id long, text string, lang string, d long, _row string, n_lines long"
rng = random.Random(5)
WORDS = ["w%d" % k for k in range(3000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage, line = prose(120), prose(60), prose(12)
    near = base.split()
    near[60] = "changed"
    edited = line.split()
    edited[4] = "edited"
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, None), (5, ""), (6, "one"), (7, f"{prose(30)} {passage} {prose(30)}"), (8, f"{prose(40)} {passage} {prose(20)}"), (9, f"{line}\n{prose(9)}\n\n{line}"), (10, f"{' '.join(edited)}\nshort\nshort"), (None, base), (3, base), (11, prose(5000)), (12, "a\t b \r\n été Ünder 你好 🙂")]
    return spark.createDataFrame([(i, t, "en", 1, "x", 0) for i, t in rows], SHAPE)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words_and_shingles():
    texts = ["Hello wOrld  the\tcat", "", None, " x ", "É b c"]
    data, at = utf8(pa.array(texts))
    w = Words(data, at)
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)] == [x for t in texts for x in words(t)]
    assert np.diff(shingles(w, 3)[2]).tolist() == [2, 0, 0, 1, 1]


def test_near_duplicates(spark, docs):
    out = near_dedup.near_duplicates(docs, shingle=3, num=85, den=100)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(118, 1, True)] and got[2] == [(118, 1, False)] and got[3] == [(118, 1, False)] * 2
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(1, 6, True)] and got[None] == [(118, None, True)]
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(docs).collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_brute_force(spark):
    texts = []
    for k in range(12):
        base = prose(100).split()
        for c in range(5):
            own = list(base)
            for _ in range(c * 2):
                own[rng.randrange(100)] = rng.choice(WORDS)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {k: find(k) for k in range(len(texts))}


def links_of(texts, size, num, den):
    sets = [set(zip(*(t.split()[k:] for k in range(size)))) for t in texts]
    return {(a, b) for a, b in combinations(range(len(texts)), 2) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def components(n, links):
    root = list(range(n))
    for a, b in sorted(links):
        x, y = (root[k] for k in (a, b))
        root = [min(x, y) if r in (x, y) else r for r in root]
    return dict(enumerate(root))


def edited(words, places, tag):
    return " ".join(f"{tag}_{k}" if k in places else w for k, w in enumerate(words))


def test_near_duplicates_among_decoys_under_the_threshold(spark):
    """Six pairs at 0.86, each amid 120 rows at 0.847 to one of the pair and to nothing else."""
    own, texts = random.Random(8), []
    for f in range(6):
        x = prose(400).split()
        y = edited(x, set(own.sample(range(2, 398, 4), 10)), f"y{f}").split()
        family = [edited(base, set(own.sample(range(2, 398, 4), 11)), f"d{f}{k}{g}") for g, base in enumerate((x, y)) for k in range(60)]
        texts += family[:60] + [" ".join(x), " ".join(y)] + family[60:]
    links = links_of(texts, 3, 85, 100)
    assert len(links) >= 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=3, num=85, den=100).collect()}
    assert got == components(len(texts), links)


def test_near_duplicates_in_a_bucket_of_many_blocks(spark, monkeypatch):
    """2,000 rows of one template, all just under the threshold but for 40 pairs; the bucket is dealt into blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 300)
    own, base = random.Random(4), prose(120).split()
    rows = [edited(base, set(own.sample(range(3, 117), 4)), f"r{k}") for k in range(1960)]
    rows += [edited(rows[k * 40].split(), {own.randrange(3, 117)}, f"p{k}") for k in range(40)]
    links = links_of(rows, 5, 80, 100)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert len(links) >= 40 and got == components(len(rows), links)


def test_words_made_to_collide_modulo_a_power_of_two(spark):
    """A long word over two letters and its complement agree under any odd base modulo 2**64; not here."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = prose(120)
    w = Words(*utf8(pa.array([f"{a} {b} x {a}"])))
    assert w.hash[0] == w.hash[3] != w.hash[1]
    df = spark.createDataFrame([(1, f"{a} one two"), (2, f"{b} one two"), (3, f"{rest} {a}"), (4, f"{rest} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=3, num=85, den=100).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    assert [x.tolist() for x in packing.encode([a.encode(), b.encode()], path)] == [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in (a, b)]
    assert {(r.doc_id, r.n_words) for r in passages.repeats(df).collect()} == {(4, 120)}


def test_long_words_hash_alike_wherever_they_are():
    word = "q" * (3 << 20)
    w = Words(*utf8(pa.array([f"ab {word} x {'y ' * 700000}{word} ab {word}z"])))
    assert w.hash[0] == w.hash[-2] and w.hash[1] == w.hash[-3] != w.hash[-1] and len(set(w.hash.tolist())) == 5


def test_near_duplicates_finds_links_among_many_rows_just_under_the_threshold(spark):
    """A template of 400 words with five changed fields a row: rows are at 0.776 to 0.796, only ten pairs with two equal places at 0.816."""
    own, base, places = random.Random(3), prose(400).split(), []
    while len(places) < 140:
        new = set(own.sample(range(4, 396, 5), 5))
        if all(len(new & x) < 2 for x in places):
            places.append(new)
    pairs = {}
    while len(pairs) < 10:
        k = own.randrange(len(places))
        new = set(own.sample(sorted(places[k]), 2)) | set(own.sample(range(4, 396, 5), 3))
        if k not in pairs and len(new) == 5 and sum(len(new & x) > 1 for x in places) == 1:
            pairs[k] = len(places)
            places.append(new)
    texts = [" ".join(f"field{k}_{i}" if i in x else w for i, w in enumerate(base)) for k, x in enumerate(places)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for t in texts]
    links = {(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links == set(pairs.items())
    assert got == {k: k for k in range(140)} | {b: a for a, b in pairs.items()}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, size=256, with_ids=True).collect()
    bins = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) == -(-sum(r.length for r in rows) // 256)
    for i, text in [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (3, None)]:
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert ids == known.encode(text or "", add_special_tokens=False).ids + [0]
    assert packing.pack(docs.limit(0), path).count() == 0
    assert packing.patterns({6: 1, 5: 2, 4: 1}, 10) == [([6, 4], 1), ([5, 5], 1)]
    assert packing.patterns({7: 1, 2: 1, 1: 0, 5: 2}, 10) == [([7, 2], 1), ([5, 5], 1)]


def test_lines(spark, docs):
    out = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    texts = {i: t for i, t in out}
    src = {r.doc_id: r.text for r in docs.collect()}
    assert texts[1] == src[1] and 2 not in texts and 3 not in texts and None not in texts
    assert texts[4] is None and texts[5] == "" and texts[9] == "\n".join(src[9].split("\n")[:3]) and texts[10] == "short" and texts[12] == src[12]
    assert out[10, "short"].n_removed == 2 and out[10, "short"].n_lines == 3
    assert line_dedup.dedup_lines(docs.drop("n_lines").limit(0)).count() == 0


@pytest.mark.parametrize("long", [4, 2048])
def test_lines_brute_force(spark, monkeypatch, long):
    """Word edit distance at most 1, both lines of 8 words at least; short and long variants of the keys."""
    monkeypatch.setattr(line_dedup, "LONG", long)
    few = ["a", "b", "c"]
    lines = [" ".join(rng.choice(few) for _ in range(rng.choice([3, 8, 9, 9, 10]))) for _ in range(250)]

    def near(a, b):
        a, b = sorted((a.split(), b.split()), key=len)
        if a == b:
            return True
        if len(a) < 8 or len(b) - len(a) > 1:
            return False
        return any(a[:k] + a[k + 1 :] == b[:k] + b[k + 1 :] for k in range(len(a))) if len(a) == len(b) else any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    keep = [x for k, x in enumerate(lines) if not any(near(x, y) for y in lines[:k])]
    df = spark.createDataFrame([(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(25)], "doc_id long, text string")
    out = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert "\n".join(t for _, t in out).split("\n") == keep


def test_compact_windows():
    v = np.random.default_rng(0).integers(1, 40, 300).astype(np.uint64)
    bounds, want = np.array([0, 100, 100, 300]), []
    for s, e in zip(bounds[:-1], bounds[1:]):
        for c in range(s, e):
            left = right = c
            while left > s and v[left - 1] > v[c]:
                left -= 1
            while right < e - 1 and v[right + 1] >= v[c]:
                right += 1
            if right - left + 1 >= 6:
                want.append((c, left, right))
    assert list(zip(*(x.tolist() for x in passages.compact_windows(v, bounds, 6)))) == want


def test_passages_behind_a_frequent_line_of_earlier_documents(spark):
    """Two earlier documents hold 40 of a passage's 60 words; each passage is in two later ones."""
    line, texts = prose(40), []
    for _ in range(2):
        texts.append(f"{prose(60)} {line} {prose(60)}")
    for _ in range(20):
        own = prose(20)
        texts += [f"{prose(60)} {line} {own} {prose(60)}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.source_id): r.n_words for r in passages.repeats(df).collect()}
    assert set(found) == {(k + 1, k) for k in range(2, 42, 2)} and min(found.values()) >= 60


def test_passages(spark, docs):
    found = passages.repeats(docs).collect()
    by = {(r.doc_id, r.source_id): r for r in found}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, _ in by} == {2, 3, 8}
    r = by[8, 7]
    assert r.n_words == 60 and text[8].encode()[r.start : r.stop].decode() in text[7]
    left = {r.doc_id: r.text for r in passages.drop_passages(docs).collect()}
    assert 3 not in left and 2 not in left and left[7] == text[7] and len(words(left[8])) == 60 and left[4] is None and left[5] == ""
    assert passages.repeats(docs.limit(0)).count() == 0


def test_language(spark, docs):
    rows = [(k, " ".join(rng.choice(w) for _ in range(30)), lang, 0, "", 0) for k, (lang, w) in enumerate([("en", ["the", "house", "with", "that"]), ("de", ["und", "für", "straße", "nicht"])] * 30)]
    train = spark.createDataFrame(rows, SHAPE)
    out = langid.label_languages(train.union(docs.filter("doc_id in (4, 5, 12)").withColumn("doc_id", F.col("doc_id") + 1000))).collect()
    assert all(r.lang_pred == {0: "en", 1: "de"}[r.doc_id % 2] and 0 < r.score <= 1 for r in out if r.doc_id < 60)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1004, 1005)} == {1004: "und", 1005: "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert langid.keep_languages(train).count() == 60 and langid.keep_languages(train).columns == train.columns
    assert {r.lang_pred for r in langid.label_languages(docs.limit(0).union(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_urls(spark):
    urls = ["http://A.COM/x?q", "https://example.com/en/1", "http://www.example.com/en/", "http://x.net/es/a", "http://net.org/fr/", None, "nothing", "http://com", "ftp://x.net/fr#a", "http://q/a://b/c"]
    pages = spark.createDataFrame([(k, u, "<p>the house</p>", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("net.org", "/fr/", None) and got[5] == ("", "", None, "allow") == got[6]
    assert got[7][:3] == ("com", "", None) and got[8][2] is None and got[9][:2] == ("q", "/a://b/c")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert url_filter.Segmenter({"the": 9, "house": 5, "there": 3})._split("thehouse-9") == ("the", "house", "#")


def pack_lzw(data):
    """Codes of an encoder written for the test: literals with a clear code often enough to stay at 9 bits."""
    codes = [x for k in range(0, len(data), 200) for x in (256, *data[k : k + 200])] + [257]
    bits = "".join(f"{c:09b}" for c in codes)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_tiff(spark):
    import struct

    pages = [np.random.default_rng(k).integers(0, 256, (13, 17, s)).astype(np.uint8) for k, s in ((1, 1), (2, 3))]
    data = tiff.encode(pages, strip_bytes=100)
    assert all((p.pixels == x).all() for p, x in zip(tiff.decode(data), pages))
    assert tiff.packbits(b"\x02abc\xfed\x80", 6) == b"abcddd" and tiff.lzw(pack_lzw(b"hello" * 100), 500) == b"hello" * 100
    assert tiff.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 9) == b"-----A---B"[:9]
    tile = np.arange(256, dtype=np.uint8).reshape(16, 16)
    body = bytes([255 - 14, 7]) * 0 + b"".join(b"\x0f" + row.tobytes() for row in tile)
    tags = [(256, 3, 10), (257, 3, 12), (258, 3, 8), (259, 3, 32773), (262, 3, 1), (277, 3, 1), (322, 3, 16), (323, 3, 16), (324, 4, 8), (325, 4, len(body))]
    at = 8 + len(body)
    tiled = b"MM\0*" + struct.pack(">I", at) + body + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0\0\0\0"
    (page,) = tiff.decode(tiled)
    assert (page.pixels[:, :, 0] == tile[:12, :10]).all()
    df = spark.createDataFrame([(1, data), (2, None), (3, b"no"), (4, data[:-9]), (5, tiled)], "page long, media binary")
    out = tiff.read_pages(df).toDF("id", "page", "width", "height", "samples", "bits", "pixels", "error").collect()
    assert [(r.id, r.page, r.width) for r in out if r.error is None] == [(1, 0, 17), (1, 1, 17), (2, None, None), (4, 0, 17), (5, 0, 10)]
    assert {r.id for r in out if r.error} == {3, 4}


def test_stored_texts(spark, docs):
    for r in tiff.store_texts(docs).collect():
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id)
        raw = (text or "").encode()
        assert r.n_bytes == len(raw) and r.payload_bytes % 576 == 0 and r.payload_bytes - len(raw) < 576 + (not raw)


def test_neighbours(spark):
    x = np.random.default_rng(3).standard_normal((400, 16))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, x[7].tolist(), 0), (404, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long")
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    ids = np.array([*range(400), 403])
    y = np.concatenate([x, x[7:8]])
    hit = 0
    for q in range(0, 400, 20):
        score = np.where(ids == q, -np.inf, y @ x[q])
        hit += len(set(ids[np.lexsort((ids, -score))[:20]]) & {r.vec_id for r in out if r.query_id == q})
        assert [r.rank for r in sorted((r for r in out if r.query_id == q), key=lambda r: (-r.score, r.vec_id))] == list(range(1, 21))
    assert hit >= 0.9 * 400 and all(abs(r.score - y[np.flatnonzero(ids == r.vec_id)[0]] @ x[r.query_id]) < 1e-12 for r in out)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert len(neighbours.nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0, 20).collect()) == 4


@pytest.mark.parametrize("scale", [1.0, 1e150, 1e-150])
def test_neighbours_over_blocks_and_lengths(spark, monkeypatch, scale):
    """Several blocks of rows and of queries, two lengths, magnitudes whose squares leave the range of doubles."""
    monkeypatch.setattr(neighbours, "BLOCK", 900)
    monkeypatch.setattr(neighbours, "QUERIES", 60)
    x = {d: np.random.default_rng(d).standard_normal((2000, d)) * scale for d in (24, 32)}
    rows = [(k * 2 + (d == 32), v.tolist(), "a", "b") for d, m in x.items() for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank string")
    out = neighbours.nearest(df, F.col("vec_id") % 20 < 2, 20).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = many = 0
    for d, m in x.items():
        for k in range(0, 2000, 10):
            near = m @ (m[k] / scale)
            near[k] = -np.inf
            true = {int(i) * 2 + (d == 32) for i in np.argsort(-near)[:20]}
            mine = found[k * 2 + (d == 32)]
            assert len(mine) == 20
            hit, many = hit + len(mine & true), many + 20
    assert hit >= 0.9 * many


def test_pieces(spark, docs):
    path = vocabulary("piece_bpe_32k.model")
    m = pieces.Model(path)

    def best(word):  # plain Viterbi
        known = {p: (s, k) for k, (p, s, kind) in enumerate(zip(m.pieces, m.scores.tolist(), m.kinds)) if kind == pieces.NORMAL}
        at = [(0.0, [])] + [(-np.inf, [])] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                score, k = known.get(word[s:e], (float(m.unknown) if s == e - 1 else -np.inf, -1))
                if at[s][0] + score > at[e][0] + 1e-4:
                    at[e] = (at[s][0] + score, at[s][1] + ([k] if k >= 0 else [m.bytes[b] for b in word[s:e].encode()]))
        return at[-1][0], at[-1][1]

    for w in ["▁hello", "▁internationalization", "▁🙂x", "▁▁été", "▁你好"]:
        assert m.viterbi([w])[0] == best(w)[1]
    out = pieces.encode_texts(docs, path, with_ids=True)
    assert all(r.same for r in out.collect())
    assert sorted(map(str, pieces.decode_texts(out, path).select(F.coalesce("text", F.lit(""))).collect())) == sorted(map(str, docs.select(F.coalesce("text", F.lit(""))).collect()))
    assert [r.n_pieces for r in out.filter("doc_id in (4, 5)").collect()] == [0, 0]


def test_sampling(spark):
    good, bad = ["alpha", "beta", "gamma"], ["junk", "spam", "eggs"]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(40))) for k in range(100)] + [(100, None), (101, ""), (None, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(60)] + [(None, True), (3, True)], "doc_id long, good boolean")
    out = sampling.resample(docs, labels).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert len(out) == 103 and len([r for r in out if r.kept]) == round(0.5 * 101) and not kept & {100, 101} and all(k is None or k % 2 for k in kept)
    assert not any(r.kept for r in sampling.resample(docs.limit(0), labels).collect())
    assert all(r.log_weight == 0 for r in sampling.resample(docs, labels.limit(0)).collect())


def test_sampling_moves_few_texts_at_every_size(spark):
    """Of 8 MB of text a tenth is labelled good: only that tenth is shuffled, whether or not Spark would broadcast the labels."""

    def shuffled() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(10_000)
        machines = context.statusStore().executorList(False)
        return sum(machines.apply(i).totalShuffleWrite() for i in range(machines.size()))

    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(32)])
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select(F.col("doc_id").cast("int").alias("doc_id"), (F.col("doc_id") % 10 == 0).alias("good"))
    before, moved, out = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], []
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            began = shuffled()
            out.append(sorted(map(tuple, sampling.resample(docs, labels).collect())))
            moved.append(shuffled() - began)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(moved) < 2_000_000 and max(moved) < 1.1 * min(moved)
    assert out[0] == out[1] and all(r[2] > -0.5 for r in out[0] if r[0] % 10 == 0) and sum(r[2] < -0.5 for r in out[0]) > 1700


def test_filter_of_ids_loses_none(spark, monkeypatch):
    ids = spark.createDataFrame([(rng.randrange(-(1 << 63), 1 << 63),) for _ in range(3000)] + [(0,), (-1,)], "doc_id long")
    docs = ids.union(ids).union(spark.range(1, 50_000).toDF("doc_id")).union(spark.createDataFrame([(None,)], "doc_id long"))
    found = sampling.possible(docs.withColumn("text", F.lit("x")), ids)
    assert found.columns == ["doc_id", "text"] and found.join(ids, "doc_id", "left_semi").count() == 6004 and found.count() < 6004 + 500
    assert sampling.possible(docs, ids.limit(0)).count() == 0
    # A full filter lets all pass; the join behind it is exact.
    some = spark.createDataFrame([(k, f"{'good' if k % 3 else 'bad'} word{k % 7}") for k in range(90)], "doc_id long, text string")
    labels = some.select("doc_id", (F.col("doc_id") % 3 > 0).alias("good")).filter("doc_id < 60")
    want = sorted(map(tuple, sampling.resample(some, labels).collect()))
    monkeypatch.setattr(sampling, "WORDS", 1)
    assert sampling.possible(docs, ids).count() == docs.count()
    assert sorted(map(tuple, sampling.resample(some, labels).collect())) == want


def test_kth_largest(spark):
    values = [rng.randrange(1 << 60) for _ in range(200)] + [5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 50, 200, 202, 203):
        assert sampling.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert sampling.kth_largest(df, 204) is None
