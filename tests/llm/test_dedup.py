"""Suffix-array dedup and SimHash near-duplicates against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanmill.llm import near_copies, simhash, suffix_dedup
from scanmill.llm.components import components

DOCS = "doc_id long, text string, key string, context long, fp long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(rng.choice(["the", "of", "and", "ing", "tion", "er", "ß", "é"]) + str(rng.randrange(size)) for _ in range(n))


def brute_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [256, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = random.Random(5)
    passage, page = words(rng, 120), words(rng, 300)
    texts = [None, "", "short", "a" * 1500, "ab" * 900, page, page, page[:1200] + words(rng, 40) + page[1100:]]
    texts += [words(rng, rng.randrange(20, 200)) + passage + words(rng, rng.randrange(20, 200)) for _ in range(12)]
    texts += [page[300:900] + " x " + page[300:900], passage[5:700], page[:399], page[:400], "é" * 700]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, page)]
    got = suffix_dedup.without_repeats(frame(spark, rows).repartition(3))
    want = sorted((str(d), *w) for (d, _), w in zip(rows, brute_cut([t for _, t in rows], 400)))
    got = got.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(len(r.kept_text.encode()) <= r.n_bytes - r.n_removed < len(r.kept_text.encode()) + 4 * (r.n_spans + 1) for r in got)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.kept_text.isascii())


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for letters, n in ((2, 300), (4, 900), (1, 40)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        packed = suffix_dedup._words(data)
        order = suffix_dedup.suffix_array(packed)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        starts, spans = np.array([0, n // 2]), np.array([n // 2, n // 4])
        some = order[(order < n // 2) | ((order >= n // 2) & (order < n // 2 + n // 4))]
        got = suffix_dedup.common_prefixes(packed, some, starts, spans, 50)
        for i in range(1, len(some)):
            a, b = raw[some[i - 1] :], raw[some[i] :]
            shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[i] == min(shared, 50)


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def plain_print(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = words(rng, 260)
    texts = [None, "", " \t\n", "one", "One two", "one two three"]
    for _ in range(60):
        own = base.split()
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = "changed%d" % rng.randrange(99)
        texts.append(" ".join(own))
    texts += [words(rng, rng.randrange(1, 50)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[7]), (None, "nothing like it at all here")]
    prints = [plain_print(t) for _, t in rows]
    roots = brute_components(prints, 3)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted((str(d), f"{p:016x}", str(least.get(r))) for (d, _), p, r in zip(rows, prints, roots))

    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "context", "fp"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_block_keys_find_every_pair_within_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))))
    signed = [[v - (1 << 64) if v >> 63 else v for v in p] for p in pairs]
    keys = [F.transform(simhash.block_keys(F.col(c), 3, 6), lambda k: k["bits"]) for c in "ab"]
    shared = spark.createDataFrame(signed, "a long, b long").select(
        F.exists(F.zip_with(*keys, lambda x, y: x == y), lambda same: same).alias("same"))
    assert shared.filter("not same").count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(200, 260)] + [(3, 3), (5, 4), (4, 5), (None, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{j: 7 for j in range(200, 260)}, 7: 7, 4: 4, 5: 4}


# ---------------------------------------------------------------- near copies


def brute_alike(texts):
    sets = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))], links


def near_texts(rng):
    texts = [None, "", " \t", "one", "ONE", "One two", "one two three four five six"]
    for size, copies in ((40, 12), (90, 20), (300, 30)):
        base = words(rng, size).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(1 + size // 30)):
                own[rng.randrange(size)] = "changed%d" % rng.randrange(99)
            texts.append(" ".join(own))
    common = words(rng, 9)
    return texts + [common + " " + words(rng, rng.randrange(1, 80)) for _ in range(60)]


@pytest.mark.parametrize("salted", [False, True])
def test_near_copies_that_are_not_equal_equal_brute_force(spark, monkeypatch, salted):
    if salted:  # frequent shingles are dealt into groups with leads of their own
        monkeypatch.setattr(near_copies, "FREQUENT", 2)
        monkeypatch.setattr(near_copies, "SALT_ROWS", 4)
    texts = near_texts(random.Random(11))
    roots, links = brute_alike(texts)
    far = [(i, j) for i, j in links if (int(plain_print(texts[i])) ^ int(plain_print(texts[j]))).bit_count() > 3]
    assert len(far) > 50
    rows = list(enumerate(texts))
    got = near_copies.one_of_each_alike(frame(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "text", "key", "context", "fp"]
    assert sorted(r.doc_id for r in got.collect()) == sorted({roots.index(r) for r in roots})


def test_cells_never_refuse_a_near_copy():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 400, 60_000):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = both[: n - rng.integers(0, n // 9 + 1)], both[rng.integers(0, n // 9 + 1) :]
            cells = [np.frombuffer(near_copies.cells_of(np.unique(x)), np.uint8).astype(int) for x in (a, b)]
            assert not near_copies.alike(np.unique(a), np.unique(b)) or 9 * np.abs(cells[0] - cells[1]).sum() <= len(a) + len(b)


def test_odd_cells_refuse_no_near_copy_and_most_texts_that_share_half():
    rng = np.random.default_rng(6)
    refused = by_cells = 0
    for n in (*[1400] * 40, 1, 2, 500, 520, 2000, 70_000):
        for share in (0.5, 0.8, 0.95, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            kept = a[: max(1, int(2 * len(a) * share / (1 + share)))]
            b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 2) if share > 0.5 else n - len(kept), np.uint64)]))
            least = near_copies.apart(near_copies.odd_cells(a), near_copies.odd_cells(b))
            assert least == near_copies.apart(near_copies.odd_cells(b), near_copies.odd_cells(a)) <= len(np.setxor1d(a, b))
            assert not near_copies.alike(a, b) or 9 * least <= len(a) + len(b)
            if share == 0.5 and n == 1400:
                cells = [np.frombuffer(near_copies.cells_of(x), np.uint8).astype(int) for x in (a, b)]
                refused += 9 * least > len(a) + len(b)
                by_cells += 9 * np.abs(cells[0] - cells[1]).sum() > len(a) + len(b)
    assert refused == 40 and by_cells < 40


def test_marked_texts_hold_every_listed_one(spark):
    texts = spark.range(5000).select(F.xxhash64("id").alias("near_id"), F.col("id").cast("string").alias("text"))
    ids = texts.filter("pmod(near_id, 7) = 0").select("near_id")
    kept = near_copies._marked(texts, ids)
    assert kept.join(ids, "near_id", "left_semi").count() == ids.count() <= kept.count() < 1000
    assert near_copies._marked(texts, ids.limit(0)).count() == 0


def test_pipeline_sends_texts_to_python_in_small_batches(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = frame(spark, list(enumerate(["one two three", "One two three", None])))
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            spark.conf.set(key, given)
            assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_texts_of_a_common_passage_make_no_pairs_before_their_texts_are_read(spark):
    """Each has 30 of 180 words of its own: similarities of about 0.63, too near for cells to tell all of them apart."""
    rng = random.Random(21)
    passage = words(rng, 150, 4000)
    texts = [passage + " " + words(rng, 30, 4000) for _ in range(60)]
    texts += [" ".join([*t.split()[:-2], "other", "end"]) for t in texts[:5]]
    rows = frame(spark, list(enumerate(texts))).withColumn("near_id", F.col("doc_id"))
    prints = near_copies.signed(rows.select("near_id", "text"))
    with near_copies.Scratch(spark) as keep:
        sizes = keep(prints)
        open_ = near_copies._buckets(sizes).drop("lead").distinct().withColumn("near_component", F.col("near_id"))
        found = {(r.a, r.b) for r in near_copies._other_pairs(open_, sizes, keep).collect()}
    assert {(i, j) for i, j in brute_alike(texts)[1]} <= found
    assert len(found) < 30


def test_copies_of_one_text_are_linked_by_it_before_pairs_are_made(spark, monkeypatch):
    """Copies are near the text they come from and mostly not near each other, so a lead by hash links few of them."""
    rng = random.Random(22)
    base = words(rng, 200, 4000).split()
    texts = [" ".join(base)]
    for k in range(60):
        own = list(base)
        for at in (10, 90, 170):
            own[at + rng.randrange(20)] = f"own{k}-{at}"
        texts.append(" ".join(own))
    made, pairs = [], near_copies._other_pairs

    def counted(*given):
        made.append(pairs(*given).distinct().count())
        return pairs(*given)

    monkeypatch.setattr(near_copies, "_other_pairs", counted)
    roots, links = brute_alike(texts)
    assert set(roots) == {roots[0]} and len(links) < 600
    found = near_copies.text_components(frame(spark, list(enumerate(texts)))).collect()
    assert len(found) == 61 and len({r.near_component for r in found}) == 1
    assert made == [0]
