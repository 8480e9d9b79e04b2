"""Vector codes, the prefix trie and packing against brute force, SQL and round trips, with nulls, empties, ties and repeats."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from axonlake.llm import gnat, packing, prefix_trie

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


def same(df, want):
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# 11


@pytest.mark.parametrize("seed", range(12))
def test_tree_finds_the_nearest_entry_with_the_lowest_number(seed):
    rng = np.random.default_rng(seed)
    n, d, most = int(rng.integers(1, 90)), int(rng.integers(1, 6)), int(rng.choice([2, 6, 300, 2**27]))
    points, queries = rng.integers(-most, most, (n, d)), rng.integers(-most, most, (300, d))
    if seed % 4 == 0:
        points, queries = points.astype(object) * 10**20, queries.astype(object) * 10**20
    at, far, _ = gnat.Gnat(points).nearest(queries)
    all_far = ((queries[:, None] - points[None]) ** 2).sum(-1)
    want = [min(range(n), key=lambda j: (row[j], j)) for row in all_far]
    assert at.tolist() == want and far.tolist() == [all_far[i, j] for i, j in enumerate(want)]


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (8, 4))
    points = (centres[:, None] + rng.integers(-20, 20, (8, 8, 4))).reshape(-1, 4)
    queries = centres[rng.integers(0, 8, 1000)] + rng.integers(-20, 20, (1000, 4))
    assert gnat.Gnat(points).nearest(queries)[2] < 0.35 * 1000 * 64


def coded(rows, parts, entries, rounds, scale):
    """Plain Python: rows are (id, vector, label) of one dimension."""
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [min(sum(f[0] for f in x), 2**63 - 1) for x in found]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    return [(r[0], "".join(f"{f[1]:02x}" for f in x), e, min(by_label[r[2]], 2**63 - 1), digest) for r, x, e in zip(rows, found, errors, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, dim int, vec string"


def small_vectors(big):
    r = random.Random(4)
    good = [(i // 2, [float(np.float32(r.uniform(-2, 2))) for _ in range(8)], r.choice([1, 2, None])) for i in range(60)]
    good += [(None, [0.5] * 8, 1), (3, [0.5] * 8, None), (3, [0.5] * 8, None), (7, [0.0, -0.0, 1e-30, -1e-30, 1, -1, 2, 3], 2)]
    return [(i, [float(np.float32(x)) for x in v], label) for i, v, label in good + [(90, [float(np.float32(3e38)), -1e30, 5e12, 0, 0, 0, 0, 1], 2)] * big]


@pytest.mark.parametrize("big", [0, 1])
def test_codes_equal_plain_ones(spark, big):
    good = small_vectors(big)
    bad = [(100, None, 1), (101, [], 1), (102, [1.0] * 7, 1), (103, [None] + [1.0] * 7, 1), (104, [float("nan")] + [1.0] * 7, 1), (105, [float("inf")] + [1.0] * 7, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in good + bad], VECTORS).repartition(3)
    out, books = gnat.product_codes(df, parts=4, entries=8, rounds=2, scale=256)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect()), key=repr)
    assert got == sorted(coded(good, 4, 8, 2, 256), key=repr)
    if not big:
        r = out.select("vec_id", "code", gnat.decoded(out["code"], books[8]).alias("vec")).where("vec_id = 90 or vec_id = 5").first()
        assert r["vec"] == [x / 256 for p in range(4) for x in books[8][p, int(r["code"][2 * p : 2 * p + 2], 16)]]


def test_codes_of_odd_tables(spark):
    assert gnat.product_codes(spark.createDataFrame([], VECTORS))[0].count() == 0
    assert gnat.product_codes(spark.createDataFrame([(1, None, 1, "", 1, "")], VECTORS))[0].count() == 0
    two = spark.createDataFrame([(1, [1.0] * 16, 1, "", 1, ""), (2, [2.0] * 32, None, "", 1, "")], VECTORS)
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in gnat.product_codes(two)[0].collect()} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)}
    with pytest.raises(ValueError):
        gnat.product_codes(two, entries=257)


def test_codes_equal_their_sql(spark, duck):
    same(gnat.op11_codes(spark, SF), duck.execute(gnat.OP11_SQL))


# 12

TURNS = "conv_id long, turn long, role string, text string, name string, depth string"


def trie(rows):
    """Plain Python over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - int(math.fmod(c, 100))
        built[c] = tuple(own.get(donor, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if built[c] == p))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_a_plain_one(spark, seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé😀", "", None, "long " * 40])) for c in [*range(0, 30), *range(100, 130), -250, -200, 7_000] for t in range(r.randint(1, 9))]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    rows += [(400, t, "user", str(t // 150)) for t in range(300)] + [(401, 2 * t, "user", str(t // 150)) for t in range(310)]
    rows += [(500, None, "b", "y"), (500, None, "b", "x"), (500, None, "a", None), (500, -5, "a", "z"), (500, -5, "a", "z"), (None, 1, "user", "lost"), (600, 1, None, None)]
    r.shuffle(rows)
    got = told(prefix_trie.prefix_trie(spark.createDataFrame([(*x, "n", "d") for x in rows], TURNS).repartition(5)))
    assert got == sorted(trie(rows), key=repr)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS)).count() == 0
    one = prefix_trie.prefix_trie(spark.createDataFrame([(3, None, None, None, "", "")], TURNS))
    assert told(one) == sorted(trie([(3, None, None, None)]), key=repr)


def test_a_long_conversation_is_numbered_over_many_ranges(spark):
    rows = spark.createDataFrame([(1, t, "user", str(t), "", "") for t in range(3000)] + [(0, 1, "a", "b", "", ""), (2, 5, "a", "b", "", "")], TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = prefix_trie.numbered(prefix_trie.turns(rows))
        assert sorted((r["conv"], r["pos"]) for r in kept.collect()) == [(0, 0), *((1, t) for t in range(3000)), (2, 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ends_are_hashed_over_runs_of_ids(spark):
    paths = spark.createDataFrame([(7 * i % 5000, 2, "x", True) for i in range(5000)] + [(-4, 2, "x", True), (9, 1, "y", True), (8, 1, "y", False)], "conv long, depth long, name string, ends boolean")
    want = {(2, "x"): [-4, *range(5000)], (1, "y"): [9]}
    got = {(r["depth"], r["name"]): r["ends_sha256"] for r in prefix_trie.ends(paths).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


def test_trie_equals_its_sql(spark, duck):
    same(prefix_trie.op12_trie(spark, SF), duck.execute(prefix_trie.OP12_SQL))


# 13


def one_by_one(lengths, capacity):
    """Best-two-fit, a document at a time over explicit lists."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x), left.remove(x)
                gap -= x
        pairs = [(a + b, a, b) for a, b in itertools.combinations(left, 2) if own[-1] < a + b <= gap + own[-1]]
        if gap and pairs:
            _, a, b = max(pairs)
            left = sorted([*left, own.pop()], reverse=True)
            left.remove(a), left.remove(b)
            own += [a, b]
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_packing_by_counts_equals_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 10, 17, 40, 100])
    lengths = [r.randint(1, capacity) if r.random() < 0.8 else r.randint(1, max(1, capacity // 4)) for _ in range(r.randint(0, 150))]
    plan = Counter()
    for times, used in packing.best_two_fit(np.bincount(np.array(lengths, int), minlength=capacity + 1)):
        plan[tuple(sorted(used.items()))] += times
    assert plan == Counter(tuple(sorted(Counter(x).items())) for x in one_by_one(lengths, capacity))


def test_a_pair_takes_the_place_of_the_smallest():
    # 6 and 3 leave 1; 2 and 2 fill the place of 3 and the gap
    assert packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11)) == [(1, {6: 1, 2: 2}), (1, {3: 1})]


def test_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(7)
    signs = [*map(chr, range(0, 0x3000)), "😀", "\U0001f1e6", "‍", "  ", "\r\n", "don't", "<|endoftext|>", " the", "１２", "﻿"]
    texts = ["", " ", "a" * 5000, "<|endoftext|>", *("".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(800))]
    encode = packing.encoder("byte_bpe_50k")
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_cuts_leave_the_first_piece_shorter():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


def test_packed_sequences_hold_every_token(spark):
    texts = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "é 😀 <|endoftext|>"), (4, "word " * 700), (5, " ".join(map(str, range(300))))] + [(i, "w " * (i % 17)) for i in range(10, 80)]
    df = spark.createDataFrame([(*x, "a", 1) for x in texts], "doc_id long, text string, piece string, length int").repartition(4)
    placed = packing.packed(packing.pieces(df, ["doc_id"], capacity=64, ids=True), capacity=64)
    encode = packing.encoder("byte_bpe_50k")
    want = [(i, [*encode(t or "").tolist(), packing.END]) for i, t in texts]
    rows, bins = placed.collect(), {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert max(map(len, bins.values())) <= 64 and sum(map(len, bins.values())) == sum(len(x) for _, x in want)
    for r in rows:
        own = bins[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert own == r["ids"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    whole = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["length"], r["ids"]) for r in rows)
    assert whole == sorted((i if i is not None else -1, s, n, x[s : s + n]) for i, x in want for s, n in packing.cuts(len(x), 64))
    assert len(bins) == len(one_by_one([r["length"] for r in rows], 64))


def test_packing_of_nothing(spark):
    none = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"])
    assert packing.packed(none).count() == 0 and packing.fullness(packing.packed(none)).first()["sequences"] == 0


def test_packing_query_fills_sequences(spark):
    rows = packing.op13_packing(spark, SF).collect()
    docs = {r["doc_id"]: packing.encoder("byte_bpe_50k")(r["text"] or "").tolist() + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins = defaultdict(list)
    for r in rows:
        assert (r["start"], r["length"]) == packing.cuts(len(docs[r["doc_id"]]), 2048)[r["piece"]]
        own = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 2048
    assert len(rows) == sum(len(packing.cuts(len(x), 2048)) for x in docs.values())
    assert len(bins) == len(one_by_one([r["length"] for r in rows], 2048)) <= 1.02 * math.ceil(sum(map(len, docs.values())) / 2048)
