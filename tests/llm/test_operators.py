"""Operators of the corpus package against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import contexts, mixing, pieces, quotes, simhash, sketches, suffixes, topk, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, rid long"


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words_text(rng, rng.randrange(5, 300)) for _ in range(40)]
    shared = words_text(rng, 120)
    rows = [*base, base[0], base[0], base[1].replace("w1 ", "W1\t"), base[2] + " more", None, "", " \n ", "one", "é" * 900, "a" * 1500, words_text(rng, 6000)]
    rows += [base[5] + shared + base[6], shared + base[7], "x" + shared]
    rows += [" ".join([*base[8].split()[:40], "changed", *base[8].split()[41:]])]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), 0.5, 7, 8) for i, t in texts]
    rows.append((None, "a text without an id", None, None, None, None, None, None))
    rows.append(rows[3])
    return spark.createDataFrame(rows, DOC).repartition(3)


def raw(t):
    return (t or "").encode()


# --- toxicity


def test_factorisation_machine_learns_an_interaction():
    rng = random.Random(1)
    rows = []
    for _ in range(1200):
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((int(bad and group), [i for i, on in ((10, bad), (11, group)) if on] + [100 + rng.randrange(50)]))
    m = toxicity.fit(rows[:1000])
    at = lambda b: np.array(sorted(m.slot[x] for x in b if x in m.slot), dtype=int)
    both, one, other = m.raw([at([10, 11]), at([10]), at([11])])
    assert both > 0 > max(one, other)


def test_terms_that_matter_only_in_pairs_are_kept_and_learnt():
    rng = random.Random(2)
    rows = []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((int(a != b), [i for i, on in ((1, a), (2, b)) if on] + [100 + rng.randrange(50)]))
    m = toxicity.fit(rows)
    assert {1, 2} <= set(m.slot)
    one, other, both = m.raw([np.array([m.slot[x] for x in b]) for b in ([1], [2], [1, 2])])
    assert min(one, other) > 0 > both


def test_rare_terms_of_long_texts_do_not_drown_strong_ones():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(3000):
        bad = rng.random() < 0.15
        rows.append((int(bad), np.unique(np.concatenate([rng.integers(1000, 61_000, 600), rng.integers(0, 4, 2) if bad else []]).astype(np.int32))))
    m = toxicity.fit(rows[:2400])
    held = rows[2400:]
    raw_ = m.raw([np.array([m.slot[b] for b in bs.tolist() if b in m.slot], dtype=int) for _, bs in held])
    found = 1 / (1 + np.exp(-raw_)) >= toxicity.THRESHOLD
    label = np.array([y for y, _ in held], dtype=bool)
    assert found[label].mean() > 0.93 and found[~label].mean() < 0.02


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine({}, rng.random(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    for at in ([], [2], [0, 3], [0, 1, 2, 3, 4, 5]):
        plain = m.bias + sum(m.w[i] * m.value[i] for i in at)
        plain += sum(m.v[i] @ m.v[j] * m.value[i] * m.value[j] for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(m.raw([np.array(at, dtype=int)])[0] - plain) < 1e-9


def test_op1_on_a_table(spark, tmp_path):
    rng = random.Random(4)
    rows, labels_ = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, words_text(rng, 60) + (" vileword " if bad else "") + words_text(rng, 60), 1.0))
        labels_.append((i, int(bad)))
    rows += [(None, "vileword", 1.0), (400, None, 1.0), (401, "", 1.0), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels_, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (400, 401)}) == 1 and len({r.score for r in got if r.doc_id == 0}) == 1


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, None, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit([])
    assert toxicity.score(docs, empty).select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), machine).count() == 0


# --- simhash


def brute_components(fps, ids, radius):
    n = len(fps)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(n)]


def plain_fingerprint(t, size=4):
    w = raw(t).lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    votes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


@pytest.mark.parametrize("size, radius", [(4, 4), (5, 7)])
def test_simhash_components(spark, docs, size, radius):
    got = simhash.near_copies(docs, size, radius).collect()
    fps = [r.fp & (1 << 64) - 1 for r in got]
    by_id = {r.doc_id: r.text for r in docs.collect()}
    assert fps == [plain_fingerprint(by_id[r.doc_id], size) for r in got]
    assert [r.component_id for r in got] == brute_components(fps, [r.doc_id for r in got], radius)


@pytest.mark.parametrize("radius", [4, 7])
def test_grid_finds_every_link(radius):
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        pair = np.array([a, b], dtype=np.uint64).view(np.int64)
        cell, fp = simhash.cell_rows(pair, radius)
        assert set(cell[fp == pair[0]]) & set(cell[fp == pair[1]])


def test_large_cells_give_the_same_components():
    rng = random.Random(4)
    fps = np.array([rng.getrandbits(6) for _ in range(40)], dtype=np.int64)
    fps = np.unique(fps)
    small = simhash.cell_links(fps, 1)
    old, simhash.MATRIX = simhash.MATRIX, 1
    try:
        large = simhash.cell_links(fps, 1)
    finally:
        simhash.MATRIX = old
    assert len(small) == len(large)


def near_texts(rng):
    """Texts with words replaced here and there, so that shingle similarities lie on both sides of 0.8."""
    out = []
    for _ in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 200]))]
        for changes in (0, 1, 2, 3):
            v = list(w)
            for at in rng.sample(range(len(v)), changes):
                v[at] = f"x{rng.randrange(5000)}"
            out.append(" ".join(v))
    return out


def alike_roots(texts_):
    """Root of each text's component by links of five-word similarity 0.8, pair by pair."""
    sets = [frozenset(simhash.shingles(t.encode(), 5)) for t in texts_]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    return root


def test_simhash_stage_keeps_one_of_each_group_of_similarity(spark):
    texts_ = near_texts(random.Random(6))
    roots = alike_roots(texts_)
    fps = [plain_fingerprint(t, 5) for t in texts_]
    far = [i for i, r in enumerate(roots) if r != i and (fps[i] ^ fps[r]).bit_count() > simhash.STAGE_RADIUS]
    assert far, "no pair of similarity 0.8 beyond the radius"
    docs_ = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.stage(spark, docs_, "").collect()} == set(roots)


def test_simhash_stage_keeps_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(5))
    near = a + " more"
    rows = [(None, b), (None, c), (None, c), (1, d), (1, e), (2, a), (3, near), (None, a), (4, None), (None, "")]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(map(tuple, kept)) == Counter([(None, b), (None, c), (1, d), (1, e), (2, a), (4, None)])


def test_stages_keep_columns_named_like_their_own(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    clashing = docs_.withColumns({"__score": F.lit("a"), "__score_": F.lit("b"), "score": F.lit(7), "__KEY": F.lit("c")})
    for stage in (toxicity.stage, simhash.stage):
        kept = stage(spark, clashing, sf_dir)
        assert kept.columns == clashing.columns
        rows = kept.collect()
        assert {(r["__score"], r["__score_"], r["score"], r["__KEY"]) for r in rows} == {("a", "b", 7, "c")}
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs_, sf_dir).collect())


# --- suffixes


def brute_suffix(texts_):
    seen = Counter(b[i : i + 400] for b in texts_ for i in range(len(b) - 399))
    out = []
    for b in texts_:
        spans = suffixes.joined([(i, i + 400) for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1])
        kept = suffixes.without(b, spans)
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_suffix_dedup(spark, docs, most):
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_suffix([raw(r.text) for r in rows]), strict=True))
    old, suffixes.MAX_BUCKET = suffixes.MAX_BUCKET, most  # 0 sends every bucket the way of the largest
    try:
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(docs).collect())
    finally:
        suffixes.MAX_BUCKET = old
    assert got == want


def test_runs_over_the_seam_of_pieces():
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 101) for _ in range(5000))
    whole = [x.tolist() for x in suffixes.runs(text)[:4]]
    old, suffixes.PIECE = suffixes.PIECE, 700
    try:
        assert [x.tolist() for x in suffixes.runs(text)[:4]] == whole
    finally:
        suffixes.PIECE = old


def first_kept(rows, length):
    """What is left of (id, bytes) rows, in order, if every string of `length` bytes that an earlier place has goes."""
    seen, out = set(), []
    for i, b in rows:
        spans = []
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                spans.append((k, k + length))
            seen.add(b[k : k + length])
        out.append((i, suffixes.without(b, suffixes.joined(spans)).decode("utf-8", "ignore") if spans else b.decode()))
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_suffix_stage_keeps_the_first_of_equal_passages(spark, docs, texts, most):
    old, suffixes.MAX_BUCKET = suffixes.MAX_BUCKET, most
    try:
        out = suffixes.stage(spark, docs, "")
        rows = out.collect()
    finally:
        suffixes.MAX_BUCKET = old
    assert out.columns == docs.columns
    kept = first_kept([(i, raw(t)) for i, t in texts], suffixes.STAGE_LENGTH)
    want = {i: t for (i, t), (_, before) in zip(kept, texts, strict=True) if t.strip() or not (before or "").strip()}
    got = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert {i: t or "" for i, t in got.items()} == want and sum(r.doc_id is None for r in rows) == 1
    assert all(r.n_chars == len(r.text) for r in rows if r.text)
    assert suffixes.stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("text", [b"a" * 5000, b"abc" * 2000, b"ab" * 500 + bytes(range(33, 126)) * 8 + b"ab" * 700])
def test_short_periods_make_few_runs(spark, text):
    assert len(suffixes.runs(text)[0]) < 1500
    other = b"ab" * 200 + b"!" * 100
    df = spark.createDataFrame([(0, text.decode()), (1, other.decode())], "doc_id long, text string")
    want = [(i, *w) for i, w in enumerate(brute_suffix([text, other]))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(df).collect()) == want


def test_suffix_dedup_of_nothing(spark, docs):
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_without_frequent_keys_one_plain_join_is_planned(spark):
    from evidentia.llm import common

    left = spark.createDataFrame([(k, i) for k in range(4) for i in range(3)], "k long, i long")
    right = common.stored(left.groupBy("k").agg(F.count("*").alias("n")).where("k < 3"), "right")
    for how, ks in (("inner", {0, 1, 2}), ("left_semi", {0, 1, 2}), ("left_anti", {3})):
        joined = common.hot_join(left, right, ["k"], how=how)
        assert joined._jdf.queryExecution().analyzed().toString().count("Join") == 1
        assert Counter(r.k for r in joined.collect()) == {k: 3 for k in ks}
    assert common.hot_join(left, right.limit(0), ["k"]).count() == 0


def test_frequent_keys_are_joined_apart(spark, monkeypatch):
    from evidentia.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(k, i) for k in range(4) for i in range(1 if k else 20)], "k long, i long")
    right = common.stored(left.groupBy("k").agg(F.count("*").alias("n")).where("k < 3"), "right")
    rows = lambda df: sorted(map(tuple, df.select("k", "i").collect()))
    assert rows(common.hot_join(left, right, ["k"])) == rows(left.where("k < 3")) == rows(common.hot_join(left, right, ["k"], how="left_semi"))
    assert rows(common.hot_join(left, right, ["k"], how="left_anti")) == rows(left.where("k = 3"))
    dealt = common.lots(left, "k", "i", 3).collect()
    of = {}
    for r in dealt:
        of.setdefault((r.k, r.i), set()).add(r.lot)
    assert all(of[0, i] & of[0, j] for i in range(20) for j in range(20))
    assert max(Counter((r.k, r.lot) for r in dealt).values()) < 20


# --- sketches


def plain_shingles(t, size=5):
    w = raw(t).lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_merged_sketches_are_the_sketch_of_the_union(spark):
    spaced = [[i * 7919 % 1000 - 500 for i in range(n)] for n in (0, 1, 40, 64, 65, 300)]
    wide = [[v * (1 << 54) for v in x] for x in spaced]
    df = spark.createDataFrame([(a, b) for a in wide for b in wide], "a array<long>, b array<long>")
    got = df.select(sketches.merged(sketches.retained(F.col("a")), sketches.retained(F.col("b"))).alias("m"), sketches.retained(F.array_union("a", "b")).alias("u")).collect()
    assert all(r.m == r.u for r in got)


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(rows, key=lambda i: -math.inf if i is None else i, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    got = sketches.fingerprints(docs).collect()
    assert len(got) == docs.count()
    own = {}
    for r in got:
        t, k = rows[r.doc_id], len(rows[r.doc_id]) // 3
        edited = t[: len(t) - k] + rows[following[r.doc_id]][:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert own.setdefault(t, r.own) == r.own and sorted(set(r.own.hashes)) == list(r.own.hashes)
        assert r.own.whole == (len(plain_shingles(t)) <= sketches.SMALL)
    values = {r.doc_id: r for r in sketches.fingerprints(docs).select("doc_id", sketches.resemblance(F.col("own"), F.col("changed")).alias("e"), sketches.resemblance(F.col("own"), F.col("next_sketch")).alias("n")).collect()}
    for i, t in rows.items():
        k = len(t) // 3
        for got_, other in ((values[i].e, t[: len(t) - k] + rows[following[i]][:k]), (values[i].n, rows[following[i]])):
            a, b = plain_shingles(t), plain_shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got_ - true) < (1e-9 if max(len(a), len(b)) <= sketches.SMALL else 0.25)
    assert sketches.fingerprints(docs.limit(0)).count() == 0


def test_sketch_estimates_containment(spark):
    rng = random.Random(8)
    big = [f"v{rng.random()}" for _ in range(20_000)]
    df = spark.createDataFrame([(" ".join(big), " ".join(big[:2000]))], "a string, b string").select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    r = df.select(sketches.containment(F.col("b"), F.col("a")).alias("c"), sketches.resemblance(F.col("a"), F.col("b")).alias("r"), F.size("b.hashes").alias("n")).first()
    assert r.c == 1.0 and abs(r.r - 0.1) < 0.03 and abs(r.n - 500) < 100


# --- top-k


@pytest.mark.parametrize("spread", [1.0, 1e6])  # the second needs 64-bit integers
def test_topk_is_exact(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 700)] + 0.2 * rng.normal(size=(700, 8))) * spread
    x[300:420] = x[300]  # one very common vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (950, [1.0, None] * 4), (1000, [float("nan")] * 8), (None, [1.0] * 8)]
    table = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    v = np.floor(256 * x).astype(np.int64).astype(object)
    want = []
    for q in range(0, 700, 50):
        ranked = sorted((-int((v[q] * v[i]).sum()), i) for i in range(700) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert got == want


def test_topk_splits_busy_blocks_and_skips_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "ASKED", 3)
    monkeypatch.setattr(topk, "RING", 20)
    rng = np.random.default_rng(5)
    x = rng.integers(-5, 6, size=(200, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1, 2]), (501, None), (None, [1, 2, 3, 4])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.search(table, F.col("vec_id") % 5 == 0).collect())
    want = []
    for q in range(0, 200, 5):
        ranked = sorted((-int(x[q] @ x[i]), i) for i in range(200) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert got == want


def test_topk_of_few_or_no_rows(spark):
    few = topk.integer_vectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert topk.search(few.limit(0), F.lit(True)).count() == 0


def test_topk_with_repeated_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, size=(260, 4)).astype(float)
    ids = [int(i) for i in rng.integers(0, 200, 260)]
    x[:8], ids[:8] = 9.0, [0] * 8  # one id fills the slots of the best vector
    x[8:12], ids[8:12] = 9.0, [7, 7, 8, 9]
    x[12:20], ids[12:20] = 8.0, [50] * 8  # own rows fill the block's best
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = [tuple(r) for r in topk.search(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    v = (256 * x).astype(np.int64)
    want = []
    for q in sorted({i for i in ids if i % 50 == 0}):
        ranked = sorted((-int(v[a] @ v[b]), ids[b]) for a in range(260) if ids[a] == q for b in range(260) if ids[b] != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert got == want


# --- urls


def test_urls(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://x.net/y", "x.net", "/y", "net/", "block"), ("https://x.net", "x.net", "", None, "allow"),
        ("ftp://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("http://h#a?b/c", "h", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://ünet.org/fr/é", "ünet.org", "/fr/é", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "z", "z") for i, c in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.RULES).collect()}
    assert [got[i] for i in range(len(cases))] == cases
    assert urls.judge(df.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda k, seed=0: len(k))
    import os
    import tempfile

    paths = urls.DigestArray.write([("block", "aa.b/"), ("allow", "cc.d/")], tempfile.mkdtemp())
    index = urls.DigestArray(*map(np.load, paths))
    assert [index.text(int(j)) if j >= 0 else None for j in index.find([b"cc.d/", b"aa.b/", b"ee.f/"])] == [b"cc.d/", b"aa.b/", None]
    assert all(os.path.exists(p) for p in paths)


# --- language model


def plain_tree(grams_, depth, least):
    """Counts of the kept nodes of a context tree, their stop weights and the estimates of what isn't kept, node by node."""
    nodes, covers = {}, Counter()
    for g in grams_:
        for d in range(depth + 1):
            covers[g[depth - d : depth]] += 1
            for j in range(8):
                key = (g[depth - d : depth], (1 << j) | (g[depth] >> (8 - j)))
                bit = g[depth] >> (7 - j) & 1
                nodes.setdefault(key, [0, 0])[bit] += 1
    nodes = {k: n for k, n in nodes.items() if not k[0] or covers[k[0]] >= least}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight, stop, rest = {}, {}, {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        n0, n1 = nodes[k]
        one = (n1 + 0.5) / (n0 + n1 + 1)
        if len(k[0]) == depth:
            weight[k], stop[k], rest[k] = kt(n0, n1), 1.0, one
            continue
        children = [c for c in nodes if c[1] == k[1] and len(c[0]) == len(k[0]) + 1 and c[0][1:] == k[0]]
        r0, r1 = n0 - sum(nodes[c][0] for c in children), n1 - sum(nodes[c][1] for c in children)
        below = sum(weight[c] for c in children) + kt(r0, r1)
        weight[k] = np.logaddexp(math.log(0.5) + kt(n0, n1), math.log(0.5) + below)
        stop[k], rest[k] = math.exp(math.log(0.5) + kt(n0, n1) - weight[k]), (r1 + one) / (r0 + r1 + 1)
    return nodes, stop, rest


def plain_log10(g, nodes, stop, rest, depth):
    total = 0.0
    for j in range(8):
        node, bit = (1 << j) | (g[depth] >> (8 - j)), g[depth] >> (7 - j) & 1
        path = [k for k in ((g[depth - d : depth], node) for d in range(depth + 1)) if k in nodes]
        p = None
        for k in reversed(path):
            own = (nodes[k][bit] + 0.5) / (sum(nodes[k]) + 1)
            deeper = p if p is not None else rest[k] if bit else 1 - rest[k]
            p = stop[k] * own + (1 - stop[k]) * deeper
        total += math.log10(p if p is not None else 0.5)
    return total


@pytest.mark.parametrize("least", [1, 3])
def test_tree_is_context_tree_weighting(spark, least):
    depth = contexts.DEPTH
    all_ = [int(g) for t in (b"abracadabra", b"abra abra", b"") for p in contexts.grams(t) for g in p]
    as_bytes = [g.to_bytes(6, "big") for g in all_]
    table = spark.createDataFrame([(g, n) for g, n in Counter(all_).items()], "key long, n long")
    tree = contexts.tree_of(contexts.grown(contexts.kept_levels(table, least)))
    nodes, stop, rest = plain_tree(as_bytes, depth, least)
    assert sum(map(len, tree.keys)) == len(nodes)
    probe = sorted({*all_, *(int.from_bytes(x, "big") for x in (b"abrabz", b"zzzzzz", b"dabrac"))})
    got = tree.log10(np.array(probe, dtype=np.uint64))
    assert np.allclose(got, [plain_log10(g.to_bytes(6, "big"), nodes, stop, rest, depth) for g in probe], atol=1e-4)
    context = int.from_bytes(b"adabr\0", "big")
    assert abs((10 ** tree.log10(np.arange(context, context + 256, dtype=np.uint64))).sum() - 1) < 1e-4


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 15.5, 16, 100.5, 1e6])
    assert np.allclose(contexts.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_contexts_are_kept_whatever_the_size_of_the_corpus(spark):
    """`qxzjk` comes twice, in a corpus of any size; the tree is neither sent to the tasks nor held by the driver."""
    rare, other = [(i, "qxzjkq") for i in range(2)], [(i, "0123456789 abcdefgh " * 600) for i in range(2, 60)]
    context = int.from_bytes(b"qxzjk", "big") << 8 | 1
    for rows in (rare, rare + other):
        model, _ = contexts.train(spark.createDataFrame(rows, "doc_id long, text string"))
        assert any(context in k for k in model.tree.keys)
        assert len(pickle.dumps(model)) < 20_000


def test_training_grams_are_scored_once_and_texts_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i, f"text {i} of words", i == 0) for i in range(6)], "doc_id long, text string, held boolean")
    model, words = contexts.train(rows.where("NOT held"))
    met = np.unique(np.concatenate([g for i in range(1, 6) for g in contexts.grams(b"text %d of words" % i)]))
    known, found = model.grams.find(met)
    assert known.all() and np.allclose(found, model.tree.log10(met), atol=1e-12)
    plan = contexts.score(rows, model, words)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lm_scoring(spark, docs):
    from evidentia.llm.common import held_out

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held"))
    model, words = contexts.train(rows.where("NOT held"))
    got = contexts.score(rows, model, words).collect()
    assert len(got) == rows.count()
    counts, n, texts_ = Counter(), 0, 0
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    plain = [(r.doc_id, r.text) for r in rows.collect()]
    by_id = dict(plain)
    for i, t in plain:
        if not out(i):
            w = raw(t).lower().split()
            counts.update(w)
            n, texts_ = n + len(w) + 1, texts_ + 1
    whole = n + len(counts) + 1 + 1
    base = lambda t: sum(math.log10((counts[w] + 1) / whole) for w in raw(t).lower().split()) + math.log10((texts_ + 1) / whole)
    want = sorted((str(i), out(i), len(raw(t).split()) + 1, round(base(t), 6)) for i, t in plain)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, round(r.base_score, 6)) for r in got) == want
    sums = {}
    for i, t in plain:
        said = b" ".join(raw(t).lower().split())
        sums[i] = sum(float(model.tree.log10(np.array([g], dtype=np.uint64))[0]) for p in contexts.grams(said) for g in p[:3000])
    assert all(r.score < 0 for r in got)
    assert all(math.isclose(r.score, sums[r.doc_id], rel_tol=1e-6) for r in got if len(raw(by_id[r.doc_id])) < 3000)
    assert contexts.score(rows.limit(0), model, words).count() == 0
    nothing, none = contexts.train(rows.limit(0))
    assert {round(r.base_score, 6) for r in contexts.score(rows, nothing, none).where("n_tokens = 1").collect()} == {0.0}


# --- quotes


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nIt is slow. Every time."), (1, 1, "assistant", "> how do  I\n>  SORT? it\n> is slow.\nUse orderBy."), (1, 2, "user", ">> How do I sort?\n> Use orderBy.\nThanks"), (1, 3, "user", "> slow. every\nIs it still?"),
        (1, 4, "user", "> nobody said this\nhm"), (2, 0, "user", None), (2, 1, "assistant", "> How do I sort?\nother conversation"), (None, 1, "x", "> a"), (3, 0, "user", ""), (4, 0, "user", "same\n"), (4, 2, "a", "same"), (4, 5, "b", "> same"), (4, 5, "b", "> same"),
        (4, 7, "c", ">>> same\n> unknown"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"max_level": F.lit("clash"), "place": F.lit(9)})
    all_ = quotes.link(df).collect()
    got = {(r.conv_id, r.turn): r for r in all_}
    assert len(all_) == len(rows)
    assert (got[1, 1].reply_to, got[1, 1].linked, got[1, 1].own_text, got[1, 1].n_quoted) == (0, True, "Use orderBy.", 1)
    assert (got[1, 2].reply_to, got[1, 2].max_level, got[1, 2].n_found, got[1, 2].own_text) == (1, 2, 2, "Thanks")
    assert (got[1, 3].reply_to, got[1, 3].linked) == (0, True)
    assert (got[1, 4].reply_to, got[1, 4].linked, got[1, 4].n_quoted, got[1, 4].n_found) == (3, False, 1, 0)
    assert (got[2, 0].reply_to, got[2, 1].reply_to, got[2, 1].linked) == (None, 0, False)
    assert (got[None, 1].place, got[None, 1].reply_to) == (1, None)
    # 1 and 3 answer 0; 2 answers 1, 4 answers 3: both threads whole
    assert [got[1, t].place for t in range(5)] == [1, 2, 3, 4, 5]
    assert got[4, 5].reply_to == 2 and got[4, 7].reply_to == 2 and [got[4, t].place for t in (0, 2, 5, 7)] == [1, 2, 3, 4]
    assert quotes.link(df.limit(0)).count() == 0


def test_reply_order_is_a_walk_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(quotes, "RANGE", 3)
    rng = random.Random(7)
    rows = [(c, t, None if t == 0 else rng.randrange(t)) for c in range(4) for t in range(30)]
    got = {(r.conv_id, r.turn): r.place for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, parent long")).collect()}
    for c in range(4):
        order, stack = [], [0]
        while stack:
            t = stack.pop()
            order.append(t)
            stack += sorted((u for k, u, p in rows if k == c and p == t), reverse=True)
        assert [got[c, t] for t in order] == list(range(1, 31))


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary file")
    return pieces.Vocabulary.load()


def plain_encode(t, v):
    """The best segmentation by a plain table over all places; of equal totals that of the longest last piece."""
    s = pieces.marked(" " + t)
    score, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for b in range(1, len(s) + 1):
        for a in range(max(0, b - v.longest), b):
            if s[a:b] in v.ids:
                i, worth = v.ids[s[a:b]]
                ids = [i]
            elif b - a == 1:
                ids = [v.bytes_[x] for x in ("▁" if s[a] == pieces.LITERAL else s[a]).encode("utf-8", "surrogateescape")]
                worth = v.unknown * len(ids)
            else:
                continue
            if score[a] + worth > score[b]:
                score[b], back[b] = score[a] + worth, (a, ids)
    out, b = [], len(s)
    while b:
        b, ids = back[b]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def test_ids_are_the_best_ones_at_every_chunk_size(vocabulary):
    rng = random.Random(0)
    texts_ = ["", " ", "Hello  world\n\tx", "漢字 é ▁ literal", "a" * 300, "￿ and \U0001f600", "tail  ", "x  y   z ", "\n\n a\n b" * 9, "漢字" * 30 + " mixed ▁ text"]
    texts_ += ["".join(rng.choice("ab  th\n▁é") for _ in range(rng.randrange(1, 150))) for _ in range(60)]
    words = pieces.Words(vocabulary)
    for t in texts_:
        want = plain_encode(t, vocabulary)
        assert pieces.decode(want, vocabulary) == t.encode()
        for size in (1, 3, 7, 40, 10_000):
            assert pieces.encode(t, words, size) == want


def test_long_text_without_spaces_takes_linear_memory(vocabulary):
    import tracemalloc

    words = pieces.Words(vocabulary)
    text = "漢字\U00012000ab" * 40_000
    tracemalloc.start()
    try:
        ids = pieces.encode(text, words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pieces.decode(ids, vocabulary) == text.encode()
    assert peak < 100 << 20 and not words.young


@pytest.mark.parametrize("giant, size", [(1 << 18, 40), (100, 40), (0, 7)])  # within a task; dealt to tasks
def test_chunks_of_a_table_give_the_ids_of_whole_texts(spark, docs, vocabulary, giant, size):
    table = docs.dropDuplicates(["doc_id"])
    if giant == 0:
        table = table.where("n_chars < 1000 OR n_chars IS NULL")
    parts = {}
    for r in sorted(pieces.tokenize(table, giant=giant, size=size).collect(), key=lambda r: r.part):
        parts.setdefault(r.doc_id, []).extend(r.ids)
    texts_ = {r.doc_id: r.text or "" for r in table.collect()}
    assert sum(len(t) > size for t in texts_.values()) > len(texts_) / 2
    words = pieces.Words(vocabulary)
    assert parts == {i: pieces.encode(t, words, 1 << 30) for i, t in texts_.items()}
    assert all(pieces.decode(parts[i], vocabulary) == raw(t) for i, t in texts_.items())


def test_tokenize_nothing(spark, docs):
    assert pieces.tokenize(docs.limit(0)).count() == 0 == pieces.round_trip(docs.limit(0)).count()


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(-50, 0, (3, 5, 5)).astype(float)
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


# --- mixing


def test_shares_fill_siblings_before_ancestors(spark):
    rows = [("web", "en", "s1", 100, 5, 3, 1), ("web", "en", "s2", 10, 5, 3, 3), ("web", "de", "s3", 1000, 5, 1, 1), ("books", "en", "s4", 1000, 5, 1, 1)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, w_domain long, w_lang long, w_source long")
    got = {r.source: r.got for r in mixing.budgets(leaves, F.lit(400), 1).collect()}
    # web and books get 200 each; within web, en can use 110 of its 150 and de takes the rest; s2 is full
    assert got == {"s1": 100, "s2": 10, "s3": 90, "s4": 200}
    full = {r.source: r.got for r in mixing.budgets(leaves, F.lit(10_000), 1).collect()}
    assert full == {r[2]: r[3] for r in rows}


def test_prefix_and_edges(spark, docs):
    rows = mixing.tree_rows(docs)
    quota = mixing.budgets(mixing.leaf_weights(rows), F.expr("sum(tokens) div 2"), 2)
    got = mixing.prefix(rows, quota, 2).collect()
    for leaf in quota.collect():
        key = (leaf.domain, leaf.lang, leaf.source)
        mine = [r for r in got if (r.domain, r.lang, r.source) == key]
        taken = sum(r.tokens for r in mine)
        longest = max((r.tokens for r in mine), default=0)
        assert leaf.got <= taken < leaf.got + max(longest, 1) or leaf.got == 0
    clash = docs.withColumns({"taken": F.lit(1), "tokens": F.lit(2), "domain": F.lit("x")})
    out = mixing.stage(spark, clash, "")
    assert out.columns == clash.columns and 0 < out.count() <= docs.count()
    assert mixing.stage(spark, docs.limit(0), "").count() == 0


def test_mixing_takes_rows_not_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    # one id holds a third of the rows, as many have none; texts repeat too
    rows = [(5, "en", "src1", "a b c") for _ in range(400)] + [(None, "en", "src1", "w " * (i % 9)) for i in range(400)] + [(100 + i, "en", "src1", f"x{i} y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(5).withColumns({"key": F.lit(1), "NR": F.lit(2), "place": F.lit("clash")})
    total = sum(len((r[3] or "").split()) for r in rows)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    took = sum(len(r.text.split()) for r in out.collect())
    assert total * 9 // 10 <= took < total * 9 // 10 + 9
    tree = mixing.tree_rows(docs)
    quota = mixing.budgets(mixing.leaf_weights(tree), F.expr("sum(tokens) div 2"), 2)
    got = Counter((r.epoch, r.doc_id, r.tokens) for r in mixing.prefix(tree, quota, 2).collect())
    order = sorted(rows, key=lambda r: (hashlib.md5(f"17:0:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, len(r[3].split())))
    want, start = Counter(), 0
    for r in order:
        n = len(r[3].split())
        if start < total // 2:
            want[0, r[0], n] += 1
        start += n
    assert got == want


# --- window keys of quotations


def test_window_keys_tell_windows_apart():
    rng = random.Random(3)
    words = [rng.choice("abc") for _ in range(300)]
    seen = {}
    for k, (hashes, checks) in zip((1, 2, 5, 300), quotes.window_keys(words, [300, 5, 2, 1, 301]), strict=True):
        assert len(hashes) == 301 - k
        for i, key in enumerate(zip(hashes.tolist(), checks.tolist(), strict=True)):
            assert seen.setdefault(key, words[i : i + k]) == words[i : i + k]
    assert len(seen) == sum(len({tuple(words[i : i + k]) for i in range(301 - k)}) for k in (1, 2, 5, 300))


def test_long_quotation_is_found(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(9)}" for _ in range(20_000)]
    rows = [(1, 0, "user", " ".join(words)), (1, 1, "user", "no"), (1, 2, "user", "> " + " ".join(words[5000:15_000]) + "\n>> " + " ".join([*words[:9000], "x"])), (1, 3, "user", "> NO\nyes")]
    got = {r.turn: (r.reply_to, r.n_quoted, r.n_found) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 0, 0), 2: (0, 2, 1), 3: (1, 1, 1)}
