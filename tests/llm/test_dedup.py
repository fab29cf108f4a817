import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm import exact_dedup as D
from quirework.llm import simhash as S
from quirework.llm.components import components

# --- exact


def expected_marks(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in ids:
            mine = i == keep and not kept
            kept |= mine
            out[i, keep, len(ids), mine, digest] += 1
    return out


@pytest.mark.parametrize("counters", [1, 3, 256])
def test_marks(spark, odd, odd_rows, counters):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in D.mark_duplicates(odd, counters=counters).collect())
    assert got == expected_marks([r[:2] for r in odd_rows])


def test_heavy_digests(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.col("id").cast("string")).alias("text"))
    docs = docs.repartition(5)
    rows = [tuple(r) for r in docs.collect()]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in D.mark_duplicates(docs, counters=4).collect())
    assert got == expected_marks(rows)
    kept = sorted(r.doc_id for r in D.drop_duplicates(docs, counters=4).collect())
    assert kept == sorted(k[0] for k in expected_marks(rows) if k[3])
    digests = docs.select(F.col("doc_id").alias("id"), D._digest("text").alias("digest"))
    assert {r.group_size for r in D.verified_winners(digests, 4).collect()} == {1000}


def test_drop_keeps_columns(odd, odd_rows, none):
    kept = D.drop_duplicates(odd, counters=2)
    assert kept.columns == odd.columns
    want = Counter((k[0], k[4]) for k, n in expected_marks([r[:2] for r in odd_rows]).items() if k[3] for _ in range(n))
    got = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect())
    assert got == want
    assert D.drop_duplicates(none).count() == 0 and D.mark_duplicates(none).count() == 0


@given(st.lists(st.sampled_from("abcdefgh"), max_size=80), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_summaries_miss_nothing_frequent(items, k):
    held = Counter()
    for at in range(0, len(items), 10):
        held = D.reduce_summary(held + Counter(items[at : at + 10]), k)
    for x, n in Counter(items).items():
        if n > len(items) / (k + 1):
            assert x in held


# --- near


def brute_fingerprint(t, words=4):
    import re

    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = i if least.get(r) is None else min(least[r], i)
        else:
            least.setdefault(r, None)
    return [least[find(k)] for k in range(len(ids))]


def test_spark_hashes_the_same(spark):
    import xxhash

    for s in ("", "a b c d", "ñandú 漢字 🙂 x", "x" * 100):
        h = spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first().h
        assert h % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_fingerprints(odd_rows):
    for _, t, *_ in odd_rows:
        if not t or len(t) < 6000:
            assert S.fingerprint(t) == brute_fingerprint(t)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows]
    want = {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()} == want
    kept = {r.doc_id for r in S.drop_near_duplicates(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_odd_near(odd, odd_rows, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(odd).collect())
    ids, fps = [r[0] for r in odd_rows], [S.fingerprint(r[1]) for r in odd_rows]
    assert got == Counter(zip(ids, (f"{f:016x}" for f in fps), brute_components(ids, fps), strict=True))
    assert S.drop_near_duplicates(odd).columns == odd.columns
    assert S.near_duplicates(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    """Many small tiles, random prints and planted neighbours at 0 to 6 bits."""
    monkeypatch.setattr(S, "TILE_LEAST", 16)
    monkeypatch.setattr(S, "TILES", 40)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for x in base[:200] for k in [int(rng.integers(0, 7))]]
    fps = sorted({int(x) for x in base} | set(near))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(S.links(df, 4)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = brute_components(signed, fps)
    got = [roots.get(s, s) for s in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_tile_plan_skips_only_what_is_apart(spark):
    cells = [(lo, hi, 50) for lo in range(10, 20) for hi in range(10, 20)]
    placed, tiles = S.plan_tiles(cells, 120)
    assert sum(k for *_, k in placed) >= len(cells)
    pairs = {tuple(r) for r in S.tile_pairs(spark, tiles, 4).collect()}
    assert S.tile_pairs(spark, [], 4).count() == 0
    near = lambda a, b, c, d: max(0, c - b, a - d)
    for i, x in enumerate(tiles):
        for j, y in enumerate(tiles[i:], i):
            assert ((i, j) in pairs) == (near(*x[:2], *y[:2]) + near(*x[2:], *y[2:]) <= 4)
    where = {(lo, hi): range(f, f + k) for lo, hi, f, k in placed}
    for a, x in where.items():
        for b, y in where.items():
            if abs(a[0] - b[0]) + abs(a[1] - b[1]) <= 4:
                assert all((min(i, j), max(i, j)) in pairs for i in x for j in y)


def test_components_of_a_large_star(spark):
    edges = spark.range(1, 5000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    got = components(edges).agg(F.count("node"), F.countDistinct("node"), F.max("root")).first()
    assert tuple(got) == (5000, 5000, 0)


def test_copies_are_dealt_in_blocks(spark):
    from quirework.llm.copies import dealt

    rows = spark.createDataFrame([("a", 1, "x"), ("b", 10, "x"), ("c", 25, "y")], "k string, n long, qw_block string")
    out = dealt(rows, "n", "copy", 10)
    assert out.columns == [*rows.columns, "copy"]
    assert sorted((r.k, r.copy) for r in out.collect()) == [(k, c) for k, n in (("a", 1), ("b", 10), ("c", 25)) for c in range(1, n + 1)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
