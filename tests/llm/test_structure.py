"""Packing, filter interactions and conversation repair against brute force on small hostile tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm import bestfit, interactions, packing, repair
from barlake.llm.queries import ORACLE_SQL

BIG = 2**53 + 1
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(9)
    say = lambda n: " ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(n))
    return [None, "", " \t", *[say(rnd.randint(1, 300)) for _ in range(60)], say(3000), "x" * 5000, "don't <|endoftext|> stop", "漢字 Ωmega Ж\x85 \x1c𝔘𞤀 ²", "A1 B2\r\n\r\n  C3   "]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packing_keeps_ids(spark, kind, monkeypatch):
    ids = [BIG, BIG + 2, None, 7, 7, -1]
    ids = ids if kind == "long" else [None if i is None else f"id {i}" for i in ids]
    docs = spark.createDataFrame([(i, "some words") for i in ids], f"doc_id {kind}, text string").withColumn("row", F.lit("clash")).coalesce(1)
    assert sorted(r.doc_id for r in packing.pack(docs).collect() if r.doc_id is not None) == sorted(i for i in ids if i is not None)
    assert sorted(r.doc_id for r in bestfit.pack(docs).collect() if r.doc_id is not None) == sorted(i for i in ids if i is not None)


LIBRARY = Tokenizer.from_file(bestfit.VOCABULARY)
LIBRARY.no_truncation()


def brute_pieces(text, cap):
    t = LIBRARY
    ids = t.encode(text or "", add_special_tokens=False).ids + [0]
    first = (len(ids) - 1) % cap + 1
    cuts = [0, *range(first, len(ids) + 1, cap)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@pytest.mark.parametrize("group", [1, 512])
def test_best_two_fit(spark, group, monkeypatch):
    monkeypatch.setattr(bestfit, "GROUP_SEQUENCES", group)
    cap = 256
    rows = [(BIG + 2 * i if i % 9 else None, t) for i, t in enumerate(texts() * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("piece", "row", "bin", "seq", "fill")}).repartition(3)
    p = bestfit.pack(docs, capacity=cap)
    assert [c for c in p.columns] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = p.collect()
    want = [(i, *x) for i, t in rows for x in brute_pieces(t, cap)]
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    least = -(-sum(r.length for r in got) // cap)
    assert len(bins) <= least + (1 if group > 1 else 0.1 * least)  # a group of one sequence leaves room in it
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # greedily 6 + 3 leave a gap of 1; the 3 gives way to 2 + 2, and the ones come last
    seq, off, fill = bestfit.best_two_fit(np.array([6, 3, 2, 2, 6, 1]), 10)
    assert fill.tolist() == [10, 10, 10, 10, 10, 10] and seq[2] == seq[3] != seq[1] == seq[5]
    seq, off, fill = bestfit.best_two_fit(np.ones(1000, np.int64), 10)
    assert len(set(seq)) == 100 and (fill == 10).all()
    rnd = np.random.default_rng(3)
    length = rnd.integers(1, 2049, 3000)
    seq, off, fill = bestfit.best_two_fit(length)
    room = []  # first fit, the longest first
    for n in sorted(length.tolist(), reverse=True):
        i = next((i for i, r in enumerate(room) if r >= n), None)
        if i is None:
            room.append(2048 - n)
        else:
            room[i] -= n
    assert len(set(seq)) <= len(room) and (np.bincount(seq, length) <= 2048).all()
    assert len(bestfit.best_two_fit(np.zeros(0, np.int64))[0]) == 0


def test_byte_encoder_equals_the_library():
    e, rnd = bestfit.encoder(), random.Random(2)
    pools = ["abc '!?.", "aé ßñ\xa0", "Ωλ Жя 漢字かな", "\n\t\r  a", "0127 x²", "\x1c\x85 　a ", "'s'll'D I'm"]
    for _ in range(3000):
        t = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "<|endoftext|>", " <|endof"])
        assert e.ids(t).tolist() == e.library.encode(t, add_special_tokens=False).ids, repr(t)


DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def audit_tables():
    rnd = random.Random(5)
    say = lambda n, pool: " ".join(rnd.choice(pool) for _ in range(n))
    few, many = [f"w{i}" for i in range(40)], [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(150):
        t = say(rnd.choice([3, 150, 250]), rnd.choice([few, many])) + rnd.choice(["", " COSTS", " $5", " ABC" * 30, " |"])
        rows.append((i, t, rnd.choice(["hot", "hot", "b", None, ""])))
    rows += [(1000 - i, rows[4][1], rnd.choice(["hot", None])) for i in range(40)] + [rows[7], rows[7], (None, rows[7][1], "b"), (None, None, None), (2000, None, "b"), (2001, "", "b"), (2002, "\t", "hot"), (-5, rows[9][1], "b"), (2003, "y" * 200_000, "hot")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 1001, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = {}
    for i, t, s in rows:
        t = t or ""
        w = SPACE.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.setdefault(s or "", []).append((f, i in good, i in toxic))
    out = []
    for part, ds in docs.items():
        share, found = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = ds
            for step, f in enumerate(order, 1):
                lost = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                share[f] += len(lost)
                fails = sum(d[0][f] for d in ds)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in ds)
                found.append((part, "".join(order), step, len(left), len(lost), fails - len(lost), alone, sum(d[1] for d in lost), sum(d[2] for d in lost), f))
        out += [(*x[:-1], share[x[-1]]) for x in found]
    return out


def test_filter_interactions(spark):
    rows, labels = audit_tables()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in ("part", "own", "same", "good", "n", "least", "mask")}).repartition(5)
    marks = spark.createDataFrame(labels, LABELS).withColumn("n", F.lit(1))
    got = [tuple(r) for r in interactions.filter_interactions(docs, marks).collect()]
    want = brute_audit(rows, labels)
    assert sorted(got) == sorted(want)
    con = duckdb.connect()
    documents, labels_ = docs.select("doc_id", "text", "source").toArrow(), marks.toArrow()
    con.register("documents", documents)
    con.register("labels", labels_)
    assert sorted(con.execute(ORACLE_SQL["op11_filter_interactions"]).fetchall()) == sorted(want)
    assert interactions.filter_interactions(docs.where("false"), marks).count() == 0
    assert interactions.filter_interactions(docs, marks.where("false")).count() == len(want)


def test_diagram_swaps():
    rnd = random.Random(1)
    masks = {m: (rnd.randint(1, 9), 1, 0) for m in rnd.sample(range(32), 20)}
    d = interactions.Diagram(masks, "ABCDE")
    seen = {tuple(d.order)}
    for level in interactions.swaps(5):
        d.swap(level)
        seen.add(tuple(d.order))
        bit = {f: 1 << "ABCDE".index(f) for f in d.order}
        left = dict(masks)
        for f, kept, lost in d.steps():
            gone = {m: w for m, w in left.items() if m & bit[f]}
            left = {m: w for m, w in left.items() if not m & bit[f]}
            assert kept[0] == sum(w[0] for w in left.values()) and lost[0] == sum(w[0] for w in gone.values())
    assert len(seen) == 120 and len(list(interactions.swaps(5))) == 119
    # documents that fail nothing but the same filters share their nodes
    assert len(interactions.Diagram(dict.fromkeys(range(32), (1, 0, 0)), "ABCDE").pairs) == 6


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def all_repairs(initials, faults):
    """Every edit sequence with at most two insertions at a place that gives a legal conversation: (cost, audit)."""
    states = [((0, "", ""))]

    def inserted(s):
        return s + [(c + 2, a + "I", r + x) for c, a, r in s for x in "ua"] + [(c + 4, a + "II", r + x + y) for c, a, r in s for x in "ua" for y in "ua"]

    states = inserted(states)
    for i, f in zip(initials, faults):
        nxt = []
        for c, a, r in states:
            nxt.append((c + 3, a + "D", r))
            if f not in ("blank", "duplicate"):
                t = 1 if f == "truncated" else 0
                nxt.append((c + t, a + "K", r + i))
                nxt += [(c + 2 + t, a + "R", r + x) for x in "ua"]
        states = inserted(nxt)
        states = [s for s in states if re.match(r"s?(ua)*u?\Z", s[2])]
    return min((c, a) for c, a, r in states if LEGAL.match(r))


def test_cells_are_the_cheapest_of_all_repairs():
    rnd = random.Random(6)
    for _ in range(150):
        n = rnd.randint(1, 5)
        initials = [rnd.choice("suua-a") for _ in range(n)]
        faults = [rnd.choice(["", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        spans = repair.Spans()
        for i, f in zip(initials, faults):
            spans.add(repair.LETTER[i, f])
        assert repair.cheapest(spans.cell()) == all_repairs(initials, faults), (initials, faults)


def test_cells_join_anywhere():
    rnd = random.Random(8)
    kinds = [rnd.choice(list(repair.LETTER.values())) for _ in range(100)]
    spans = repair.Spans()
    for k in kinds:
        spans.add(k)
    for cut in (0, 1, 7, 50, 99, 100):
        halves = []
        for part in (kinds[:cut], kinds[cut:]):
            s = repair.Spans()
            for k in part:
                s.add(k)
            halves.append(s.cell())
        assert repair.joined(*halves) == spans.cell()


CONV = "conv_id long, turn long, role string, text string"


def conversation_rows():
    rnd = random.Random(3)
    say = lambda: rnd.choice(["Yes.", "no", "Why?", "", " \n", "Well! then", "ok. ", "a.b"]) + str(rnd.choice(["", rnd.randint(0, 3)]))
    rows = [(c, t if rnd.random() < 0.95 else None, rnd.choice(["system"] * (t == 0) + ["user", "assistant", "user", "assistant", "tool", None, ""]), say() if rnd.random() < 0.95 else None) for c in range(60) for t in sorted(rnd.sample(range(12), rnd.randint(1, 9)))]
    rows += [(None, t, "user" if t % 2 else "assistant", say()) for t in range(30)] + [(BIG, t // 3, rnd.choice(["user", "assistant"]), say()) for t in range(400)]
    return rows + [rows[5], rows[5], (BIG + 2, 1, "system", "x" * 300_000 + ".")]


def brute_conversation(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by the plain shortest way through rows and places."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    empty = hashlib.sha256(b"").hexdigest()
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", empty)
    seen, faults = set(), []
    for _, role, text in rows:
        solid = "".join(SPACE.findall(text))
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for p, (c, a, out) in list(best.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    q = go.get((p, x))
                    if q and (c + 2, a + "I") < best.get(q, (9**9,))[:2]:
                        best[q] = (c + 2, a + "I", (out, f"{role}:"))
        return best

    best = inserted({"": (0, "", None)})
    for (_, role, text), i, f in zip(rows, initials, faults):
        new = {}
        for p, (c, a, out) in best.items():
            ways = [(p, c + 3, a + "D", out)]
            if f not in ("blank", "duplicate"):
                t = c + (f == "truncated")
                for x, name in (("s", ""), ("u", "user"), ("a", "assistant")):
                    if (p, x) in go and x == i:
                        ways.append((go[p, x], t, a + "K", (out, f"{role}:{text}")))
                    elif (p, x) in go and x != "s":
                        ways.append((go[p, x], t + 2, a + "R", (out, f"{name}:{text}")))
            for q, *w in ways:
                if tuple(w[:2]) < new.get(q, (9**9,))[:2]:
                    new[q] = tuple(w)
        best = inserted(new)
    cost, audit, out = min((best[p] for p in ("", "a") if p in best), key=lambda x: x[:2])
    lines = []
    while out:
        out, line = out
        lines.append(line)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines[::-1]).encode()).hexdigest())


def brute_repair(rows):
    convs = {r[0]: [] for r in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        convs[c] += [(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return [(c, *brute_conversation(v)) for c, v in convs.items()]


@pytest.mark.parametrize("parts", [1, 40])
def test_conversation_repair(spark, parts):
    rows = conversation_rows()
    want = brute_repair(rows)
    odd = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("z") for c in ("row", "same", "fault", "audit", "harm", "copy", "part")}).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # with 40, long conversations spread over tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in repair.repair_damaged(odd).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_conversation_repair_sql_and_empty(spark):
    rows = [r for r in conversation_rows() if r[0] != BIG]
    con = duckdb.connect()
    conversations = spark.createDataFrame(rows, CONV).toArrow()
    con.register("conversations", conversations)
    got = con.execute(ORACLE_SQL["op13_conversation_repair"]).fetchall()
    assert sorted(got, key=repr) == sorted(brute_repair(rows), key=repr)
    assert repair.repair_damaged(spark.createDataFrame([], CONV)).count() == 0
