"""Each operator against brute force on small hostile tables: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm import bpe, common, edits, itq, lm, packing, pii, quality, simhash, suffix, warc
from barlake.llm.queries import ORACLE_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, long = say(70), say(6000)
    rows = [(i, say(rnd.randint(1, 150)), rnd.choice(["en", "de", None]), rnd.choice(["hot", "hot", "a", None])) for i in range(80)]
    rows += [(100 + i, f"{say(5)} {passage} {say(7 + i)}", "en", "hot") for i in range(12)]
    rows += [(200 + i, rows[3][1], "en", "hot") for i in range(10)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \n\t ", "en", "a"), (303, long, "en", "a"), (304, long[:20000] + "x" + long[20000:], "en", "a"), (305, "spam $$$ & | <x> " * 40, "en", "hot")]
    rows += [(306, "line one here\nline one here\n\nline two\nline one here", "de", "a"), (306, "line one here\nline one here\n\nline two\nline one here", "de", "a"), (None, say(60), "en", "a"), (307, "a" * 900, "en", "a")]
    rows += [(308, "mail a.b@c.de or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.255 not 1.2.3.999", "en", "a"), (309, "<|endoftext|> İstanbul Σ'll 漢字 ²", "en", "a")]
    return [(a, b, c, d, len(b or "")) for a, b, c, d in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def keyed(rows):
    return sorted(rows, key=repr)


def test_quality_sql(spark, docs, empty):
    names = ["doc_id", *quality.FEATURES, "base_failed", "kept"]
    got = quality.judge(docs).select(*names).collect()
    c = duckdb.connect()
    table = docs.toArrow()
    c.register("documents", table)
    want = c.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op1_quality_rules']})").fetchall()
    assert keyed(map(tuple, got)) == keyed(want)
    assert quality.judge(empty).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(ROWS)


def link_components(ids, linked):
    p = {i: i for i in range(len(ids))}

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))}


@pytest.mark.parametrize("tile", [1024, 3])
def test_simhash(docs, empty, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    prints = [simhash.fingerprint(r[1])[1][0] & (2**64 - 1) for r in ROWS]
    comp = link_components([r[0] for r in ROWS], [(i, j) for i in range(len(ROWS)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    want = keyed([(ROWS[i][0], f"{prints[i]:016x}", comp[i]) for i in range(len(ROWS))])
    assert keyed([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()]) == want
    assert simhash.groups(empty).count() == 0


def test_simhash_many_blocks(docs, monkeypatch):
    a = keyed(map(tuple, simhash.groups(docs).collect()))
    monkeypatch.setattr(simhash, "FOUR_BLOCKS", 0)
    assert keyed(map(tuple, simhash.groups(docs).collect())) == a


def test_near_dedup(docs, monkeypatch):
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert not kept & set(range(200, 210)) and 3 in kept and 304 not in kept and {300, 301, 302, None} <= kept
    assert len([i for i in range(80) if i in kept]) >= 75


def test_near_dedup_tiles(spark, monkeypatch):
    rnd = random.Random(2)
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 4) + str(rnd.randint(0, 99)) for _ in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "WIDE_TILE", 4)
    assert [r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()] == [0]


@pytest.mark.parametrize("n", [2, 70])
def test_simhash_words_find_every_pair(spark, docs, monkeypatch, n):
    rnd = random.Random(6)
    word = lambda: rnd.getrandbits(64)
    rows = [[word() for _ in range(4)] for _ in range(n - 1)]
    flips = [30, 7, 7, 7]  # 51 bits of 256, most in the first word
    rows.append([x ^ sum(1 << b for b in rnd.sample(range(64), f)) for x, f in zip(rows[0], flips)])
    signed = [(i, 100, *[x - (1 << 64) if x >> 63 else x for x in r]) for i, r in enumerate(rows)]
    prints = spark.createDataFrame(signed, "doc_id long, size long, w0 long, w1 long, w2 long, w3 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    got = {r.doc_id: r.component_id for r in simhash.groups(docs, 5, 4, 51).collect()}
    assert got == {i: 0 if i == n - 1 else i for i in range(n)}


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_dedup_by_shingle_sets(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "WIDE_TILE", tile)
    rnd, rows = random.Random(3), []
    for i in range(40):  # around a text of 400 words, copies with some of its last words changed
        base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        for k, changed in enumerate((0, 25, 60, 100, 140)):
            rows.append((10 * i + k, " ".join(base[: 400 - changed] + [f"x{rnd.randrange(10**6)}" for _ in range(changed)]), "en", "a", 0))
    sets = [set(simhash.shingles_of(r[1], 5)) for r in rows]
    comp = link_components([r[0] for r in rows], [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()} == {rows[i][0] for i in range(len(rows)) if comp[i] == rows[i][0]}


def test_packing(docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_SEQUENCES", 2)
    cap = 512
    p = packing.pack(docs, capacity=cap).toPandas()
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ROWS]
    want = keyed([(r[0], s, zlib.crc32(np.array(x[s : s + cap], "<u4").tobytes()), len(x)) for r, x in zip(ROWS, ids) for s in range(0, len(x), cap)])
    got = keyed([(None if a != a else int(a), b, c, d) for a, b, c, d in p[["doc_id", "start", "ids_crc32", "doc_tokens"]].itertuples(index=False)])
    assert got == want
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.iloc[0] == 0 and (g.offset.shift(-1)[:-1] == (g.offset + g.length)[:-1]).all() and g.length.sum() <= cap
    assert packing.pack(empty).count() == 0


def base_spans(x):
    def luhn(m):
        d = [int(c) for c in m if c.isdigit()][::-1]
        return 13 <= len(d) <= 19 and sum(c if i % 2 == 0 else (2 * c if c < 5 else 2 * c - 9) for i, c in enumerate(d)) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, x) if ok(m[0])]


def test_pii_base(spark, docs, empty):
    rnd = random.Random(9)
    bits = ["a@b.c", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "ssn: 12345", "999", "@", ".", " ", "+", "-", "é", "x", "7", "\n", "\U0001f600"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(400)]
    rows += [(1000 + i, r[1]) for i, r in enumerate(ROWS)] + [(5000, "1" * 30000), (5001, "a@" * 3000)]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(pii.KINDS).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: ",".join(base_spans(t or "")) for i, t in rows}
    assert pii.detect(empty).count() == 0


def test_pii_contexts(spark):
    rows = [(i, f"words before badge: user{i}@mail.example.com and after") for i in range(40)] + [(100, "words before badge: 123456-77 and after"), (101, "other words 123456-77 here")]
    d = {r.doc_id: r.other for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in d[100]] == [(20, 29)] and not d[101] and not d[3]
    red = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows + [(102, None)], "doc_id long, text string")).collect()}
    assert red[100] == "words before badge: [OTHER] and after" and red[1] == "words before badge: [EMAIL] and after" and red[101] == rows[41][1] and red[102] is None


def test_bpe(docs, empty):
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    want = []
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert keyed(map(tuple, bpe.digests(docs).collect())) == keyed(want)
    assert bpe.digests(empty).count() == 0 and bpe.round_trip(docs).count() == len(ROWS)


def test_bpe_backtracking():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    e, rnd = bpe.encoder(), random.Random(5)
    for _ in range(1500):
        x = "".join(rnd.choice(["the", "ing", "'ll", "<|endoftext|>", *"abcdeéßİΣς 'st\t漢字1²\u0085\x1c’-_"]) for _ in range(rnd.randint(0, 30)))
        assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("tile", [1024, 5])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(itq, "TILE", tile)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24))
    x[200:240] = x[7] + rng.standard_normal((40, 24)) * 0.15
    x[240:260] = x[8]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (403, [None] + [1.0] * 23), (None, x[8].astype(np.float32).tolist()), (404, [])]
    good = [i for i in range(300)] + [304]
    w = np.array([rows[i][1] for i in good], float)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    near = w @ w.T >= 0.95
    np.fill_diagonal(near, False)
    got = itq.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    links = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    want = {rows[i][0]: int(near[k].sum()) for k, i in enumerate(good) if rows[i][0] is not None}
    assert all(links[k] <= v for k, v in want.items()) and sum(links[k] for k in want) >= 0.9 * sum(want.values())
    assert all(links[i] == 0 for i in (400, 401, 402, 403, 404)) and len(got) == len(rows)
    comp = {r.vec_id: r.component_id for r in got}
    assert comp[240] == 8 and comp[400] == 400 and comp[None] == 8
    assert itq.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_other_lengths_and_sizes(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    near_b = b + rng.standard_normal(16) * 0.02
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(50)]
    rows += [(60, a.tolist()), (61, (a * 1e-200).tolist()), (62, (a * 1e300).tolist())]
    rows += [(70, [3.0, 4.0]), (71, [3.0, 4.0]), (72, [6.0, 8.0]), (73, [-3.0, 4.0]), (74, [3.0, 4.0] + [0.0] * 14)]
    rows += [(80, b.tolist()), (81, near_b.tolist()), (80, b.tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node long, code string")
    got = keyed(map(tuple, itq.near(df).where("vec_id >= 60").collect()))
    want = [(60, 2, 60), (61, 2, 60), (62, 2, 60), (70, 2, 70), (71, 2, 70), (72, 2, 70), (73, 0, 73), (74, 0, 74), (80, 2, 80), (80, 2, 80), (81, 2, 80)]
    assert got == keyed(want)


@pytest.mark.parametrize("frequent", [100_000, 20])
def test_lm(docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    got = lm.score(docs).collect()
    words = [(r[1] or "").encode().lower().split() + [b" "] for r in ROWS]
    c = Counter(w for r, ws in zip(ROWS, words) if not lm.held_out(r[0]) for w in ws)
    n, v = sum(c.values()), len(c)
    want = keyed([(r[0], lm.held_out(r[0]), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for r, ws in zip(ROWS, words)])
    assert keyed([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(empty).count() == 0


def test_lm_gradient_and_windows():
    rng, size = np.random.default_rng(1), 1 << 16
    cls = np.r_[rng.integers(1, lm.CLASSES, size), 0]
    texts = [rng.integers(0, size, n) for n in (199, 0, 1, lm.STEP - 1, lm.STEP, 70)]
    ws = lm.Windows([i.astype("<u2").tobytes() for i in texts], cls)
    x, t, w = ws.cut(np.arange(len(ws.start)))
    for k, ids in enumerate(texts):  # each token is scored once, after at least LEAD places of its text or of class 0
        c, of = np.r_[cls[ids], 0], ws.of == k
        assert w[of].sum() == len(c) and (t[of][w[of]] == c).all()
        before = np.r_[np.zeros(lm.WINDOW, int), c]
        places = np.argwhere(w[of])
        assert all((x[of][i, : j + 1] == before[n + lm.WINDOW - j - 1 : n + lm.WINDOW]).all() for n, (i, j) in enumerate(places)) and (places[:, 1] >= lm.LEAD).all()
    m, first = lm.Attention(), lm.Attention()
    wt = w.astype(np.float32)
    loss = lambda a: -float((np.take_along_axis(a.forward(x)[0], t[..., None], 2)[..., 0] * wt).sum())
    for _ in range(30):
        m.step(x, t, wt, 0.5)
    assert loss(m) < loss(first)
    z = first.forward(x)[0]
    assert np.allclose(np.take_along_axis(z, t[..., None], 2)[:, lm.LEAD :, 0], first.log_probability(x, t, first.table()), atol=1e-4)
    y = x.copy()
    y[:, 20:] = 0
    assert np.allclose(z[:, :20], first.forward(y)[0][:, :20], atol=1e-5)


def test_lm_scores_a_group_of_classes_a_place():
    """Scoring never holds a row of all classes a place, its scores are those of all classes, which sum to 1, and a step
    follows the loss's slope for each kind of weight."""
    rng, m = np.random.default_rng(3), lm.Attention()
    c = rng.integers(0, lm.CLASSES, (512, lm.WINDOW))
    t, table = rng.integers(0, lm.CLASSES, c.shape), m.table()
    tracemalloc.start()
    got = m.log_probability(c, t, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < got.size * lm.CLASSES * 4
    every = m.forward(c[:20])[0]
    assert np.allclose(np.exp(every.astype(float)).sum(2), 1, atol=1e-5)
    assert np.allclose(np.take_along_axis(every, t[:20, :, None], 2)[:, lm.LEAD :, 0], got[:20], atol=1e-4)
    c, t, w = c[:20], t[:20], (rng.random((20, lm.WINDOW)) < 0.8) * (np.arange(lm.WINDOW) >= lm.LEAD)
    loss = lambda flat: -float((np.take_along_axis(lm.Attention(flat).forward(c)[0].astype(float), t[..., None], 2)[..., 0] * w).sum() / w.sum())
    start, after = m.flat(), lm.Attention(m.flat())
    after.step(c, t, w.astype(np.float32), 1.0)
    slope = start - after.flat()
    for name, part in lm.Attention.parts(np.arange(len(start))).items():
        d = np.zeros(len(start), np.float32)
        d[part.ravel()] = 1e-3 * rng.standard_normal(part.size)
        assert abs((loss(start + d) - loss(start - d)) / 2 - float(slope @ d)) < 1e-6 + 0.01 * abs(float(slope @ d)), name


def test_lm_shares_are_probabilities():
    rng, size = np.random.default_rng(4), 400
    ends = np.r_[rng.random(size) < 0.6, True]
    counts = np.r_[rng.integers(0, 50, size), 20]
    starts = np.minimum(counts, rng.integers(0, 50, size + 1))
    cls, share = lm.classes_of(counts, ends)
    assert cls.max() < lm.CLASSES and cls[size] == 0 and np.allclose(np.bincount(cls, 10**share)[np.unique(cls)], 1)
    last = np.flatnonzero(~ends)[:5]
    done = np.flatnonzero(ends[:size])[:2]
    pairs = np.unique(np.concatenate([k * (size + 1) + np.r_[rng.choice(size, 60, False), size * ends[k]] for k in (last[0], last[1], done[0], size)]))
    _, head = lm.beginnings(np.array([size, *last[:2]]), np.array([True, False, False]))
    ids = rng.choice(size, 6, False)
    longer = lm.joined(np.repeat(head, 6), ids)
    s = lm.Shares(cls, ends, counts, starts, pairs, rng.integers(1, 9, len(pairs)), longer, np.repeat(head, 6), rng.integers(1, 9, 6))
    of_class = np.log10(rng.dirichlet(np.ones(lm.CLASSES)))
    every = np.arange(size + 1)
    seen = of_class[np.unique(cls)]
    of_class = of_class - np.log10((10**seen).sum())  # classes without ids have no share
    for word in ([], [done[0]], [done[1]], [last[0]], [last[0], last[1]], [last[3]], [last[0], last[2]], [*last[:3], *last[:3]]):  # what may follow each beginning sums to 1
        total = 0.0
        for x in every:
            got = s(np.array([*word, x]), np.array([size, *word]), of_class[cls[[*word, x]]])
            total += 10 ** got[-1]
        assert abs(total - 1) < 1e-9


def test_lm_beats_the_subword_unigram(spark):
    rows = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").collect()
    e, c, mine = bpe.encoder(), Counter(), {}
    for r in rows:
        ids = [*np.frombuffer(e.ids(r.text or ""), "<u4").tolist(), -1]
        if lm.held_out(r.doc_id):
            mine[r.doc_id] = ids
        else:
            c.update(ids)
    n, v = sum(c.values()), len(c)
    unigram = {k: sum(math.log10((c[i] + 0.1) / (n + 0.1 * (v + 1))) for i in ids) for k, ids in mine.items()}
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows)).where("held_out").collect()}
    assert sum(got.values()) > 0.8 * sum(unigram.values())


@pytest.mark.parametrize("scale, margin", [("sf0.001", 0.1), ("sf0.01", 0.35)])
def test_lm_training_is_what_scores(spark, monkeypatch, scale, margin):
    """On held-out texts the trained attention beats the untrained one, which knows class frequencies alone, by so much a word
    (log10), the counts inside classes being the same."""
    docs = common.table(spark, f"/root/testdata/{scale}", "documents", "doc_id", "text")

    def a_word():
        x = lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("n_tokens"), F.sum("base_score")).first()
        return x[0] / x[1], x[2] / x[1]

    trained, base = a_word()
    monkeypatch.setattr(lm, "train", lambda ids, cls, counts: lm.Attention(bias=np.log((m := np.bincount(cls, counts, lm.CLASSES) + 1.0) / m.sum())).flat())
    assert trained > a_word()[0] + margin
    if scale == "sf0.01":
        assert trained > base + 0.1


def test_lm_scores_follow_from_rows_alone(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    one, many = ({(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.score(docs.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-3 for k in one)
    odd = docs.withColumns({c: F.lit("z") for c in ("text_hash", "ids", "held", "shard", "word", "c", "k", "rows")})
    assert {(r.doc_id, r.n_tokens): r.score for r in lm.score(odd).collect()}.keys() == {k[:2] for k in one}


def test_lm_counts_of_rare_pairs_are_joined(spark, docs, monkeypatch):
    """However few pairs a task holds, scores are those of all pairs."""
    flat = lm.Attention(bias=np.zeros(lm.CLASSES)).flat()
    monkeypatch.setattr(lm, "train", lambda ids, cls, counts: flat)
    found = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), r.score) for r in lm.score(docs.repartition(3)).collect())
    every = found()
    monkeypatch.setattr(lm, "PAIRS", 20)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500, raising=False)
    few = found()
    assert len(every) == len(ROWS) and [r[:3] for r in every] == [r[:3] for r in few]
    assert np.allclose([r[3] for r in every], [r[3] for r in few], rtol=1e-5, atol=1e-4)


def test_lm_beginnings_of_any_length():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 1 << 16, 500)
    last = np.r_[word, word, word[:200], 7, word[200:]]
    start = np.zeros(len(last), bool)
    start[[0, 500, 1000]] = True
    deep, h = lm.beginnings(last, start)
    at = {int(p): int(x) for p, x in zip(deep, h)}
    assert set(at) == set(range(len(last))) - {0, 1, 500, 501, 1000, 1001}
    assert all(at[i] == at[500 + i] for i in range(2, 500)) and all(at[i] == at[1000 + i] for i in range(2, 200)) and all(at[i] != at[1000 + i] for i in range(201, 500))
    assert len(set(at.values())) == 498 + 301


def test_lm_vocabulary_and_equal_hashes():
    with pytest.raises(ValueError):
        lm.word_ends(bpe.VOCABULARY, 1000)
    cls, ends, n = np.array([1, 2, 0]), np.array([False, True, True]), np.array([3, 4, 1])
    s = lm.Shares(cls, ends, n, n // 2, np.array([0, 4]), np.array([2, 1]), np.array([7, 7]), np.array([5, 6]), np.array([1, 1]))
    assert np.isfinite(s(np.array([0, 0, 1]), np.array([2, 0, 0]), np.log10([0.5, 0.5, 0.25]))).all()


def test_lm_context_is_half_a_window():
    text = np.arange(1, 100).astype("<u2").tobytes()
    ws = lm.Windows([text], np.r_[np.arange(1 << 16) % lm.CLASSES, 0])
    assert (np.argwhere(ws.cut(np.arange(len(ws.start)))[2])[:, 1] >= lm.WINDOW // 2).all()


def test_lm_trains_on_all_windows(spark):
    rng, size = np.random.default_rng(2), 1 << 16
    texts = []
    for n in rng.integers(300, 900, 160):  # an id mostly follows its predecessor
        jump = np.where(rng.random(n) < 0.9, 1, rng.integers(0, 50, n))
        texts.append((np.cumsum(jump) % 50).astype("<u2").tobytes())
    counts = np.r_[np.bincount(np.frombuffer(b"".join(texts), "<u2"), minlength=size), len(texts)]
    cls, _ = lm.classes_of(counts)
    bias = np.log((np.bincount(cls, counts, lm.CLASSES) + 1) / (counts.sum() + lm.CLASSES))
    start = lm.Attention(bias=bias)
    (out,) = lm.learn([common.pa.RecordBatch.from_arrays([common.pa.array(texts, common.pa.binary())], names=["ids"])], start.flat(), cls)
    assert out.column(1)[-1].as_py() == counts.sum()
    x, t, w = (y := lm.Windows(texts, cls)).cut(np.arange(len(y.start)))
    ids = spark.createDataFrame([(False, k, b) for k, b in enumerate(texts)], "held boolean, text_hash long, ids binary").repartition(2)
    m = lm.Attention(lm.train(ids, cls, counts))
    mean = lambda a: float((a.log_probability(x, t, a.table()) * w[:, lm.LEAD :]).sum() / w.sum())
    assert mean(m) > float((bias[t] * w).sum() / w.sum()) + 0.02


def test_warc(spark, tmp_path):
    inner = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nfoo"
    rows = [(i, f"u{i}\r\nX: y", inner if i % 7 == 0 else f"é{i} " * 50 if i % 3 else "WARC/1.1\r\n" + "y" * 90) for i in range(60)] + [(60, None, None), (61, "u", inner + "\r\n\r\n"), (62, "u", ""), (63, "u", "\r\n\r\n")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        of = first.setdefault(p, i) if len(p) >= 100 else i
        assert (r.record_type, r.refers_to) == (("response", None) if of == i else ("revisit", of))
    assert len(got) == len(rows)
    heads = [r.value.partition("\r\n\r\n")[0].split("\r\n")[1:] for r in warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    heads = [dict(x.split(": ", 1) for x in h) for h in heads]
    ids = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert all({"WARC-Date", "WARC-Record-ID", "Content-Length", "WARC-Payload-Digest"} <= set(h) for h in heads)
    assert all(h["WARC-Profile"] == warc.PROFILE and h["WARC-Refers-To"] in ids for h in heads if h["WARC-Type"] == "revisit")
    assert all(h["Content-Type"] == "application/http;msgtype=response" for h in heads if h["WARC-Type"] == "response")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def cut(rows, later):
    texts = [(r[1] or "").encode() for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    count, first = Counter(), {}
    for i in order:
        for s in range(len(texts[i]) - 199):
            k = texts[i][s : s + 200]
            count[k] += 1
            first.setdefault(k, (rows[i][0], s))
    out = []
    for i, b in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            k = b[s : s + 200]
            if first[k] != (rows[i][0], s) if later else count[k] > 1:
                gone[s : s + 200] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((rows[i][0], len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return keyed(out)


@pytest.mark.parametrize("group", [256, 1])
@pytest.mark.parametrize("later", [False, True])
def test_suffix(docs, monkeypatch, group, later):
    monkeypatch.setattr(suffix, "GROUP", group)
    got = suffix.cut_repeats(docs, later).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert keyed(map(tuple, got)) == cut(ROWS, later)


def test_longest_previous_factors():
    rnd = random.Random(7)
    for alphabet, n, depth in (("ab", 300, 24), ("a", 90, 16), ("abcdefgh", 500, 200), ("ab", 700, 200)):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        text = (text + text[: n // 2] + "zq" + text[n // 3 :]).encode()
        starts = np.array(sorted(rnd.sample(range(len(text)), 250 if len(text) > 250 else len(text) // 2)))

        def shared(a, b):
            k = 0
            while k < depth and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            return k

        earlier, later = suffix.previous_factors(np.frombuffer(text, np.uint8), depth, starts)
        assert earlier.tolist() == [max((shared(x, y) for y in starts[:k]), default=0) for k, x in enumerate(starts)]
        assert later.tolist() == [max((shared(x, y) for y in starts[k + 1 :]), default=0) for k, x in enumerate(starts)]


def test_suffix_lays_texts_out_once(spark, docs):
    texts = suffix.different_texts(docs)
    spans = spark.createDataFrame([(1, 0, 5, 0)], "tag long, start int, end int, kind int")
    plan = suffix.without(texts, spans.hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    common.free(texts)


def test_suffix_ranks(empty):
    b = np.frombuffer(b"abracadabra" * 30, np.uint8)
    r = suffix.suffix_ranks(b, 24)
    keys = [bytes(b[i : i + 24]) for i in range(len(b))]
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    assert [order[k] for k in keys] == r.tolist()
    assert suffix.cut_repeats(empty, False).count() == 0


def test_edits(spark, docs, empty):
    rnd, count = random.Random(8), lambda s: len(bpe.encoder().ids(s)) // 4
    rows, want = [], []
    for k, r in enumerate(ROWS):
        text, todo = r[1] or "", []
        n = count(text)
        for _ in range(4):
            a = rnd.randint(0, len(text) + 3)
            todo.append((a, a + rnd.randint(0, 9), rnd.choice(["", " ", "mid dle", "<|endoftext|>", None, "'s "])))
            a, b = min(todo[-1][0], len(text)), min(todo[-1][1], len(text))
            text = text[:a] + (todo[-1][2] or "") + text[b:]
        rows.append((r[0], r[1], todo))
        want.append((r[0], n, count(text), len(text)))
    rows.append((999, None, None))
    want.append((999, 0, 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    got = edits.edited_counts(df).select("doc_id", "n_tokens", "n_tokens_after", "n_chars_after").collect()
    assert keyed(map(tuple, got)) == keyed(want)
    e = spark.createDataFrame([(1, 1, 0, 2, "zz")], "doc_id long, seq int, start int, stop int, text string")
    assert edits.edited_counts(edits.with_edits(docs, e)).count() == len(ROWS)


def test_edits_encode_only_what_they_touch(spark, empty):
    counts = edits.Counts(bpe.encoder().ids)
    tree, text, rnd = edits.CountTree("start", counts), "start", random.Random(3)
    for i in range(1000):
        at = rnd.randint(0, len(text))
        new = rnd.choice([f" w{i} ", f"x{i} y", " "])
        tree.edit(at, at, new)
        text = text[:at] + new + text[at:]
    assert (tree.tokens, tree.chars) == (len(counts.ids(text)) // 4, len(text))
    assert tree.encoded < 60 * 1000 and max(len(w) for w, _ in tree.leaves) <= 2 * edits.LEAF_WORDS
    text, new = "some words here " * 20000, "a much longer piece " * 500
    long = edits.CountTree(text, counts)
    long.edit(160000, 160010, new)
    text = text[:160000] + new + text[160010:]
    assert long.encoded < 10100 and (long.tokens, long.chars) == (len(counts.ids(text)) // 4, len(text))
    none = empty.withColumn("edits", F.array().cast("array<struct<start:int,stop:int,text:string>>"))
    assert edits.edited_counts(none).count() == 0


def test_pii_far_labels(spark):
    rows = [(i, f"words badge:{' ' * (i % 3 * 90 + 1)}user{i}@mail.example.com and after") for i in range(40)] + [(100, "words badge:" + " " * 300 + "123456-77 and after"), (101, "w " * 300 + "badge: 123456-78")]
    d = {r.doc_id: [(s.start, s.end) for s in r.other] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert d[100] == [(312, 321)] and d[101] == [(607, 616)]


def test_near_dedup_finds_near_copies(spark):
    rnd, rows, pairs = random.Random(31), [], []
    for i in range(150):  # pairs of a text and a copy with a few words changed in places apart
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(30, 400))]
        new = list(base)
        for _ in range(rnd.randint(0, max(1, len(base) // 55))):
            new[rnd.randrange(len(base))] = f"x{rnd.randrange(10**6)}"
        a, b = (set(simhash.shingles_of(" ".join(t), 5)) for t in (base, new))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(base), "en", "a", 0), (2 * i + 1, " ".join(new), "en", "a", 0)]
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(pairs) > 80 and sum(b not in kept for _, b in pairs) >= 0.98 * len(pairs)
    assert len(kept) >= len(rows) - len(pairs)


def test_clashing_columns(spark, docs):
    odd = docs.withColumns({c: F.lit("z") for c in ("tag", "node", "k", "g", "w0", "size", "copies", "first_id", "h_id", "r_id", "t_lang", "spans")})
    assert simhash.near_dedup(odd).columns == odd.columns
    assert pii.redact(odd).columns == odd.columns and quality.filter_quality(odd).columns == odd.columns
    assert suffix.drop_later_copies(odd).columns == odd.columns and packing.pack(odd).count() >= len(ROWS)


def test_clashing_columns_of_readers(spark, docs, tmp_path):
    odd = docs.withColumns({c: F.lit("z") for c in ("ids", "decoded", "n_tokens", "digest", "payload", "size", "first", "edits", "row", "tag")})
    assert keyed(bpe.digests(odd).collect()) == keyed(bpe.digests(docs).collect())
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    for name, df in (("a", pages), ("b", pages.withColumns({c: F.lit("z") for c in ("digest", "payload", "size", "first", "value", "n")}))):
        warc.write(df, str(tmp_path / name))
    a, b = (keyed(warc.read(spark, str(tmp_path / n)).collect()) for n in "ab")
    assert a == b and len(a) == len(ROWS)  # repeated and null page ids are records of their own
    none = docs.select("doc_id", "text", F.array().cast("array<struct<start:int,stop:int,text:string>>").alias("edits"))
    assert keyed(edits.edited_counts(none.withColumn("n_chars_after", F.lit("z"))).collect()) == keyed(edits.edited_counts(none).collect())


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p})
    at = {n: i for i, n in enumerate(nodes)}
    comp = link_components(nodes, [(at[a], at[b]) for a, b in pairs])
    assert all(got[n] == comp[i] for i, n in enumerate(nodes) if n in got) and {n for p in pairs if p[0] != p[1] for n in p} == set(got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = common.spool(out)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
