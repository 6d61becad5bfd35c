"""Operators and the pipeline against plain Python on small fixtures; line dedup also against DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

from ledgerlake.llm import langid, passages, pieces, queries, sampling, tiff, url_filter
from ledgerlake.llm.queries import vocabulary

rng = random.Random(12)
WORDS = ["k%d" % k for k in range(4000)]


def prose(n, words=WORDS, own=rng):
    return " ".join(own.choice(words) for _ in range(n))


def test_stored_texts_against_plain_reading(spark):
    texts = [None, "", "short", "é" * 300, prose(4000), "x" * 576, "x" * 577, "short"]
    schema = "doc_id long, text string, feature string, n_bytes string"
    out = {r.doc_id: r for r in tiff.store_texts(spark.createDataFrame([(k, t, "own", "own") for k, t in enumerate(texts)], schema)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        r = out[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        # The same strips, written plainly: differences along each row, deflated 113 rows at a time.
        rows = [payload[y : y + 576] for y in range(0, len(payload), 576)]
        step = [bytes([row[0], *((b - a) % 256 for a, b in zip(row, row[1:]))]) for row in rows]
        strips = [zlib.compress(b"".join(step[y : y + 113]), 1) for y in range(0, len(rows), 113)]
        media = tiff.encode([np.frombuffer(payload, np.uint8).reshape(-1, 576, 1)])
        assert all(s in media for s in strips) and r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        height = len(rows)
        ys, xs = sorted({i * height // 8 for i in range(8)}), [i * 72 for i in range(8)]
        bits = [[False] * 8 for _ in range(8)]
        for i, (a, b) in enumerate(zip(ys, [*ys[1:], height])):
            for j, x in enumerate(xs):
                block = b"".join(row[x : x + 72] for row in rows[a:b])
                bits[i][j] = sum(block) / len(block) > sum(payload) / len(payload)
        assert r.feature == "".join(f"{sum(v << 7 - i for i, v in enumerate(row)):02x}" for row in bits)
    assert out[2][1:] == out[7][1:]


def flat(texts):
    return [g for h, _ in langid.grams(texts) for g in h.tolist()]


def test_language_masks_and_scores(spark):
    """70 languages: more than one word of the bitmask. A mask holds the languages that learned the n-gram, and, but for false positives, no other."""
    own = random.Random(1)
    syllables = [a + b for a in "bcdfghjklmnprstvwz" for b in "aeiou"]
    vocabulary_of = {f"l{k:02d}": ["".join(own.choice(syllables[k : k + 14]) for _ in range(3)) for _ in range(40)] for k in range(70)}
    rows = [(k * 4 + n, "  " + prose(40, words, own) + " ", lang) for k, (lang, words) in enumerate(vocabulary_of.items()) for n in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 70 and model.table.shape[0] == 2
    counts = {}
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(flat([text]))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = {lang: {g: n / total[lang] for g, n in c.items() if n / total[lang] >= 1 / langid.GRAMS} for lang, c in counts.items()}
    most = Counter()
    for c in share.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    learned = {lang: {g for g, x in c.items() if x >= langid.NEAR * most[g]} for lang, c in share.items()}
    every = np.array(sorted(most), np.uint64)
    extra = 0
    masks = [model.languages_of(langid.probes(every), w) for w in (0, 1)]
    for k, lang in enumerate(model.langs):
        said = {int(g) for g, m in zip(every, masks[k // 64]) if int(m) >> (k % 64) & 1}
        assert learned[lang] <= said
        extra += len(said - learned[lang])
    assert extra <= 70  # false positives
    texts = [prose(20, words, own) for words in vocabulary_of.values()]
    for (lang, score), text in zip(model.predict(texts), texts):
        h = flat([text])
        best = {x: sum(g in learned[x] for g in h) / len(h) for x in learned}
        assert best[lang] == max(best.values()) and abs(score - best[lang]) < 0.01
    assert model.predict([None, "", "12 34 !?"]) == [("und", 0.0)] * 3


def test_grams_are_of_letters_with_one_space_between_words():
    same = lambda a, b: sorted(flat([a])) == sorted(flat([b]))
    assert same(" Ab cd ", "(ab, 12 CD)") and same("é\nü", "É ü") and not same("ab", "ba")
    assert len(flat([" abc "])) == len({" a", "ab", "bc", "c ", " ab", "abc", "bc ", " abc", "abc "})


def test_url_verdicts_against_plain_naive_bayes(spark):
    own = random.Random(3)
    good, bad = ["news", "house", "garden", "music"], ["casino", "pills", "spam", "cheap"]
    name = lambda words: "".join(own.sample(words, 2))
    rows = [(f"http://{name(good)}.com/{own.choice(good)}", good) for _ in range(60)] + [(f"http://{name(bad)}.net/es/{own.choice(bad)}", bad) for _ in range(40)]
    rows += [(f"http://{name(w)}.org/{own.choice(w)}/7", w) for w in (good, bad) * 20] + [("none", good), (None, bad)]
    html = [f"<p>{' '.join(w)} {own.choice(w)}</p>" for _, w in rows]
    pages = spark.createDataFrame([(k, u, h, "v", 1.0) for k, ((u, _), h) in enumerate(zip(rows, html))], "page_id long, url string, html string, verdict string, host double")
    out = {r.page_id: r for r in url_filter.judge(pages, queries.RULES).collect()}
    words = Counter(x for h in html for x in re.findall(r"[a-z]+", h[3:-4]))
    total = sum(words.values())

    def features(url):
        host, _, path = url.split("://")[1].partition("/")
        parts = [f"h:{w}" for label in host.split(".") for run in re.findall(r"[a-z]+", label) for w in short(run)]
        return parts + ["p:#" if t.isdigit() else f"p:{t}" for t in re.findall(r"[a-z0-9]+", path)]

    memo = {}

    def short(run):
        if run not in memo:
            best = {0: (0.0, ())}
            for e in range(1, len(run) + 1):
                best[e] = max((best[s][0] + (math.log(words[run[s:e]] / total) if run[s:e] in words else -math.log(total) - 2.5 * (e - s)), best[s][1] + (run[s:e],)) for s in range(e))
            memo[run] = best[len(run)][1]
        return memo[run]

    assert short("casinopills") == ("casino", "pills")
    held = {"allow": Counter(), "block": Counter()}
    prior = Counter()
    for u, _ in rows[:100]:
        verdict = "allow" if ".com/" in u else "block"
        held[verdict].update(zlib.crc32(f.encode()) % url_filter.BUCKETS for f in features(u))
        prior[verdict] += 1
    size = {v: sum(c.values()) + url_filter.BUCKETS for v, c in held.items()}
    verdicts = Counter()
    for k, (u, w) in enumerate(rows[100:140], 100):
        cells = [zlib.crc32(f.encode()) % url_filter.BUCKETS for f in features(u)]
        score = math.log((prior["block"] + 1) / (prior["allow"] + 1)) + sum(math.log((held["block"][c] + 1) / size["block"]) - math.log((held["allow"][c] + 1) / size["allow"]) for c in cells)
        assert out[k].rule is None and abs(out[k].block_score - score) < 1e-3 and out[k].verdict == ("block" if score > 0 else "allow")
        verdicts[out[k].verdict, w is bad] += 1
    assert verdicts["block", True] == 20 and verdicts["allow", False] == 20
    assert out[140].verdict == out[141].verdict == "allow" and out[0].rule == "com/" and out[60].rule == "net/es/"


def test_importance_weights_keys_and_kept(spark):
    own = random.Random(5)
    rows = [(k, prose(own.randrange(0, 60), ["alpha", "beta", "gamma", "delta", "Junk", "spam"][k % 2 * 2 : k % 2 * 2 + 4], own)) for k in range(300)] + [(300, None), (None, "alpha beta"), (None, "spam")]
    labels = [(k, k % 2 == 0) for k in range(0, 200, 3)] + [(0, False), (5, None)]
    docs = spark.createDataFrame([(k, t, 1, 2.0) for k, t in rows], "doc_id long, text string, kept int, key double")
    out = sampling.resample(docs, spark.createDataFrame(labels, "doc_id long, good boolean"), share=0.4).collect()
    good = {k for k, v in labels if v} - {0}

    def cells(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return sampling.cells(*(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w).encode())])))[0].tolist() if w else []

    raw, target = Counter(c for _, t in rows for c in cells(t)), Counter(c for k, t in rows if k in good for c in cells(t))
    ratio = lambda c: math.log((target[c] + 1) / (sum(target.values()) + sampling.BUCKETS)) - math.log((raw[c] + 1) / (sum(raw.values()) + sampling.BUCKETS))
    want = sorted(((-1 if k is None else k), len(cells(t)), round(sum(map(ratio, cells(t))), 6)) for k, t in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_grams, round(r.log_weight, 6)) for r in out) == want
    # The noise is one Gumbel number a row; the k largest keys of rows with n-grams stay.
    noise = np.array([r.key - r.log_weight for r in out])
    assert abs(noise.mean() - 0.5772) < 0.25 and abs(noise.std() - math.pi / 6**0.5) < 0.25
    some = sorted((r.key for r in out if r.n_grams), reverse=True)
    k = round(0.4 * len(some))
    assert {r.key for r in out if r.kept} == set(some[:k])
    tempered = sampling.resample(docs, spark.createDataFrame(labels, "doc_id long, good boolean"), share=0.4, temper=50.0).collect()
    assert all(abs(a.key - a.log_weight / 50 - (b.key - b.log_weight)) < 1e-6 for a, b in zip(sorted(tempered, key=str), sorted(out, key=str)) if a.doc_id == b.doc_id and a.doc_id is not None)


def test_sampling_is_in_proportion_to_the_weights():
    """Gumbel top-1 over three weights, by many seeds."""
    weights, won = np.log(np.array([1.0, 2.0, 5.0])), Counter()
    for seed in range(4000):
        won[int((weights + sampling.gumbel(np.arange(3), np.arange(3), seed)).argmax())] += 1
    assert all(abs(won[k] / 4000 - share) < 0.03 for k, share in enumerate((0.125, 0.25, 0.625)))


def test_pieces_of_equal_length_advance_together_as_they_do_alone():
    m = pieces.Model(vocabulary("piece_bpe_32k.model"))
    own = random.Random(6)
    words = ["▁" + "".join(own.choice("abcdeéü你🙂 stn") for _ in range(11)) for _ in range(300)]
    assert m.viterbi(words) == [m.viterbi([w])[0] for w in words]


def test_a_long_text_without_a_space_is_segmented_as_the_short_ones(monkeypatch):
    m = pieces.Model(vocabulary("piece_bpe_32k.model"))
    own = random.Random(16)
    words = ["▁" + "".join(own.choice(["the", "ing", "é", "你", "🙂", "x", "▁", "tion", "zq"]) for _ in range(n)) for n in (40, 90, 200)]
    score = lambda ids: sum(float(m.scores[k]) if m.kinds[k] == pieces.NORMAL else 0.0 for k in ids)
    for w in words:
        one, other = m.viterbi([w])[0], m.segment_long(w).tolist()
        assert m.decode(one) == m.decode(other) == w.replace("▁", " ")[1:] and abs(score(one) - score(other)) < 1e-3
    monkeypatch.setattr(pieces, "LONG", 50)
    text = "ab " + "the🙂ing" * 50_000 + " cd"
    ids = m.encode([text, "ab cd", ""])
    assert m.decode_all(ids) == [text, "ab cd", ""]


def copies(spans, text):
    """``text`` without the words numbered in ``spans``, cut from the first byte of a run to the end of its last word."""
    at = [(x.start(), x.end()) for x in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, last = "", 0
    for s, e in spans:
        out, last = out + text[last : at[s][0]], at[e - 1][1]
    return out + text[last:]


def exact_runs(text, earlier, least=50):
    """Maximal runs of words of ``text`` all of whose stretches of ``least`` words stand in an earlier text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    known = set()
    for t in earlier:
        x = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        known |= {tuple(x[k : k + least]) for k in range(len(x) - least + 1)}
    marked = [False] * len(w)
    for k in range(len(w) - least + 1):
        if tuple(w[k : k + least]) in known:
            marked[k : k + least] = [True] * least
    runs, k = [], 0
    while k < len(w):
        e = k
        while e < len(w) and marked[e]:
            e += 1
        if e > k:
            runs.append((k, e))
        k = max(e, k + 1)
    return runs


def test_exact_passages_amid_a_frequent_line_and_a_hot_passage(spark):
    """Passages of 50 words and more at random places, each beside lines that a third of all documents share."""
    own = random.Random(7)
    line, hot, shared = prose(12, own=own), prose(70, own=own), [prose(own.randrange(50, 90), own=own) for _ in range(25)]
    texts = []
    for k in range(240):
        parts = [prose(own.randrange(10, 80), own=own), prose(own.randrange(10, 80), own=own)]
        if k % 3 == 0:
            parts.insert(1, line)
        if k % 4 == 0:
            parts.insert(2, hot)
        if k % 5 < 2:
            parts.insert(own.randrange(len(parts) + 1), shared[own.randrange(25)])
        texts.append(" ".join(parts))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, source_id string")
    found = {}
    for r in passages.repeats(df).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.stop))
    missing = 0
    for k, t in enumerate(texts):
        w = list(re.finditer(r"\S+", t))
        covered = [any(s <= x.start() and x.end() <= e for s, e in found.get(k, [])) for x in w]
        marked = [False] * len(w)
        for s, e in exact_runs(t, texts[:k]):
            marked[s:e] = [True] * (e - s)
        missing += sum(m and not c for m, c in zip(marked, covered))
        assert sum(c and not m for m, c in zip(marked, covered)) <= 12  # a run may go on over a gap
    assert missing == 0


def test_near_passages_are_found_at_the_stated_chance(spark):
    """200 passages of 60 words, of which one is changed in the later document: similarity 0.84."""
    own, rows = random.Random(9), []
    for k in range(200):
        p = prose(60, own=own).split()
        q = [*p[:30], f"other{k}", *p[31:]]
        rows += [(k, f"{prose(40, own=own)} {' '.join(p)} {prose(40, own=own)}"), (1000 + k, f"{prose(30, own=own)} {' '.join(q)} {prose(50, own=own)}")]
    found = {(r.doc_id, r.source_id) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(1000 + k, k) for k in range(200)} and len(found) >= 198


def test_line_dedup_against_duckdb(spark, tmp_path):
    import duckdb

    own = random.Random(10)
    lines = [prose(own.choice([3, 8, 9, 12]), WORDS[:6], own) for _ in range(60)]
    rows = [(k, "\n".join(own.choice(lines) if own.random() < 0.7 else prose(9, own=own) for _ in range(own.randrange(1, 7)))) for k in range(80)] + [(80, None), (81, ""), (82, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, n_lines, n_removed, text_sha256 FROM ({queries.SQL['op10_line_dedup']})").fetchall()
    got = [tuple(r) for r in queries.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


LANGUAGES = {"en": ["the", "house", "with", "that", "water"], "de": ["und", "für", "straße", "nicht", "zwölf"]}


def pipeline_rows():
    own = random.Random(11)

    def text(lang, n):
        return " ".join(own.choice(LANGUAGES[lang]) + own.choice("abcdefgh") * own.randrange(3) + own.choice(LANGUAGES[lang]) for _ in range(n))

    rows = []
    for k in range(40):
        lang = ("en", "de")[k % 2]
        rows.append((k * 2, text(lang, 120) + "\n" + text(lang, 30), lang, None if k % 5 else "site"))
    rows += [(100, rows[0][1], "en", "copy"), (101, rows[2][1].replace("\n", " more\n", 1), "en", "near")]
    passage = text("en", 60)
    rows += [(110 + k, f"{text('en', 40)} {passage} {text('en', 25)}", "en", "passage") for k in range(3)]
    line = text("de", 12)
    rows += [(120 + k, f"{text('de', 50)}\n{line}\n{text('de', 40)}", "de", "line") for k in range(3)]
    rows += [(130, "12 34 56 !!", "en", "junk"), (131, None, "de", None), (132, "", None, "empty"), (None, text("en", 80), "en", "no id"), (133, text("de", 5000), "de", "long")]
    return rows


def edit_distance_one(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    return any(a[:k] + a[k + (len(a) == len(b)) :] == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_stages(rows):
    """The pipeline's first four stages, pair by pair."""
    order = lambda r: 2**63 if r[0] is None else r[0]
    rows = sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=order)
    seen, left = [], []
    for r in rows:
        kept = []
        for line in r[1].split("\n"):
            w = line.split()
            if w and any(w == x or min(len(w), len(x)) >= 8 and edit_distance_one(w, x) for x in seen):
                continue
            kept.append(line)
            if w:
                seen.append(w)
        # A line that goes is compared by those after it all the same.
        seen += [x.split() for x in r[1].split("\n") if x.split() and x.split() not in seen]
        if "".join(kept).strip():
            left.append((r[0], "\n".join(kept), *r[2:]))
    sets = [set(zip(*(r[1].lower().split()[k:] for k in range(5)))) for r in left]
    gone = {b for a, b in combinations(range(len(left)), 2) if left[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    left = [r for k, r in enumerate(left) if k not in gone]
    out = []
    for k, r in enumerate(left):
        text = r[1] if r[0] is None else copies(exact_runs(r[1], [x[1] for x in left[:k] if x[0] is not None]), r[1])
        if text.strip():
            out.append((r[0], text, *r[2:]))
    return out


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = pipeline_rows()
    docs = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), 7, "own") for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, n_lines string")
    stages = corpus_pipeline.STAGES
    assert [name for name, _ in stages] == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    now = docs
    for _, stage in stages[:4]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    kept = sorted(((r.doc_id, r.text, r.lang, r.source) for r in now.collect()), key=str)
    assert kept == sorted(plain_stages(rows), key=str)
    assert all(r.n_chars == len(r.text) and r._row == 7 and r.n_lines == "own" for r in now.collect())
    packed = stages[4][1](spark, now, "").collect()
    known, ids = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {}
    bins = {}
    for r in packed:
        ids.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, r.ids_crc32)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    total = 0
    for i, text, *_ in kept:
        want = known.encode(text, add_special_tokens=False).ids + [0]
        total += len(want)
        cut = [want[k : k + 2048] for k in range(0, len(want), 2048)]
        assert ids[i] == {p: (p * 2048, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, x in enumerate(cut)}
    assert len(ids) == len(kept) and len(bins) <= -(-total // 2048) + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
