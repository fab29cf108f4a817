import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import lm_scoring as L
from quirework.llm import packing as P

# --- packing


def brute_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster, doc in items:
        key = ("doc", doc) if cluster is None else ("cluster", cluster)
        fits = [(room, k) for k, (room, s, c) in enumerate(bins) if room >= size and (source is None or source not in s) and key not in c]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append((capacity, set(), set()))
        room, s, c = bins[k]
        out.append((k, capacity - room))
        bins[k] = (room - size, s | ({source} - {None}), c | {key})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    items = [(rng.randrange(0, 50), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, 1, 2, 3, 4, 5]), k) for k in range(300)]
    items.sort(key=lambda x: -x[0])
    assert P.best_fit(items, 64) == brute_fit(items, 64)


def laws(rows, docs, capacity):
    """Nothing lost, nothing over the capacity, no conflicts, no overlap."""
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.length
    want = Counter()
    for i, t, _ in docs:
        want[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {k: v for k, v in n.items() if v} == {k: v for k, v in want.items() if v} and n.keys() == want.keys()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    source = {i: s for i, _, s in docs}
    for b in bins.values():
        assert sum(r.length for r in b) <= capacity
        named = [source[r.doc_id] for r in b if source[r.doc_id] is not None]
        assert len(named) == len(set(named))
        at = 0
        for r in sorted(b, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length


def test_documents_are_packed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.pack(docs, capacity=512, group_rows=200).collect()
    held = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    laws(rows, held, 512)
    assert len({r.bin >> 32 for r in rows}) > 1
    again = P.pack(docs.repartition(5), capacity=512, group_rows=200).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for r in rows:
        assert r.start == r.piece * 512


def test_groups_are_packed_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {(r.doc_id, r.piece): (r.bin, r.offset) for r in P.pack(docs, capacity=700).collect()}
    held = docs.select("doc_id", "source", F.xxhash64("text").alias("c"), P.words_of(F.col("text")).alias("n")).collect()
    items = [(-min(700, r.n - 700 * k), r.doc_id, k, r.source, r.c) for r in held for k in range(max(1, -(-r.n // 700)))]
    items.sort()
    want = brute_fit([(-a, s, c, d) for a, d, _, s, c in items], 700)
    assert rows == {(d, k): w for (_, d, k, _, _), w in zip(items, want, strict=True)}


def test_packing_odd(odd, odd_rows, none):
    rows = P.pack(odd, capacity=1000).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in odd_rows)
    assert sum(r.length for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd_rows)
    for b in {r.bin for r in rows}:
        assert sum(r.length for r in rows if r.bin == b) <= 1000
    assert P.pack(none).count() == 0


def test_null_texts_do_not_conflict(spark):
    docs = spark.createDataFrame([(k, None, f"s{k}") for k in range(3)] + [(9, "", "s9"), (10, "", "s10")], "doc_id long, text string, source string")
    rows = {r.doc_id: r.bin for r in P.pack(docs).collect()}
    assert len({rows[k] for k in range(3)}) == 1 and rows[9] != rows[10]


def test_a_repeated_row_is_dealt_over_the_groups(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    rows = P.pack(docs, group_rows=300).collect()
    assert len(rows) == 3000 and len({r.bin for r in rows}) == 3000
    assert max(Counter(r.bin >> 32 for r in rows).values()) < 450


# --- LM scoring


def brute_step(net, squares, found, rate):
    """One AdaGrad step, target by target, in double precision; ``found``: (context, target)."""
    p = {k: v.astype(np.float64) for k, v in net.items() if k != "prior"}
    g = {k: np.zeros_like(v) for k, v in p.items()}
    loss = 0.0
    for near, t in found:
        cls, member = divmod(t, L.CLASS)
        z = p["b"] + sum(p["e"][i] * p["s"][k] for k, i in enumerate(near))
        z2 = z + p["c"][cls]
        h, h2 = z / (1 + abs(z)), z2 / (1 + abs(z2))
        x, y = h @ p["wc"] + p["bc"], h2 @ p["wm"] + net["prior"][cls]
        px, py = np.exp(x - x.max()), np.exp(y - y.max())
        px, py = px / px.sum(), py / py.sum()
        loss -= np.log(px[cls]) + np.log(py[member])
        px[cls] -= 1
        py[member] -= 1
        d2 = p["wm"] @ py / (1 + abs(z2)) ** 2
        d = p["wc"] @ px / (1 + abs(z)) ** 2 + d2
        for k, v in (("wc", np.outer(h, px)), ("bc", px), ("wm", np.outer(h2, py)), ("b", d)):
            g[k] += v
        g["c"][cls] += d2
        for k, i in enumerate(near):
            g["e"][i] += d * p["s"][k]
            g["s"][k] += d * p["e"][i]
    for k in p:
        g[k] /= max(1, len(found))
        squares[k] += (g[k] ** 2).mean(axis=1, keepdims=True) if k in "ec" else g[k] ** 2
        p[k] -= rate * g[k] / np.sqrt(squares[k])
    return {**p, "prior": net["prior"]}, loss / max(1, len(found))


def brute_windows(docs):
    """(context, target) of each place of the documents in one row, None for a place between them."""
    found = []
    for d in docs:
        line = [L.PAD] * L.SIDE + list(d) + [L.PAD] * L.SIDE
        for k in range(len(d)):
            near = line[k : k + 2 * L.SIDE + 1]
            found.append((near[: L.SIDE] + near[L.SIDE + 1 :], d[k]))
        found += [None] * L.SIDE
    return found[: len(found) - L.SIDE]


def brute_batches(docs, offset, stride, batch):
    """The targets of each batch of a round."""
    found = brute_windows(docs)
    return [[f for f in found[k : k + batch] if f] for k in range(offset * batch, len(found), stride * batch)]


def brute_start(docs):
    net = L.WindowNetwork().start(np.bincount([t for d in docs for t in d], minlength=L.VOCABULARY))
    return {**{k: v.astype(np.float64) for k, v in net.p.items()}, "prior": net.prior}


def line_of(docs):
    return L.windows(*flat(docs))[0]


def test_steps_against_brute_force():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, L.VOCABULARY, n).tolist() for n in (30, 1, 0, 12)]
    net, squares = brute_start(docs), {}
    for k, v in net.items():
        squares[k] = np.full(v.shape, L._FIRST)
    fast = L.WindowNetwork().start(np.bincount(sum(docs, []), minlength=L.VOCABULARY))
    for _ in range(3):
        net, loss = brute_step(net, squares, [f for f in brute_windows(docs) if f], L.RATE)
        assert abs(fast.step(line_of(docs)) - loss) < 1e-3
    for k, v in fast.p.items():
        assert np.abs(v - net[k]).max() < 1e-2, k


def test_gradients():
    """Against differences of the loss, in double precision."""
    net = L.WindowNetwork(3).start(np.arange(L.VOCABULARY))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.prior = net.prior.astype(np.float64)
    rng = np.random.default_rng(0)
    line = line_of([rng.integers(0, L.VOCABULARY, n).tolist() for n in (4, 2)])
    moved = {}
    net._move = lambda k, g, rate: moved.setdefault(k, (None, g))
    net._move_rows = lambda k, at, g, rate: moved.setdefault(k, (at, g))
    net.step(line)

    def loss():
        return -net.forward(line)[0].sum() / 6

    rows, g = moved["e"]
    tried = [("wc", (3, 5), moved["wc"][1][3, 5]), ("bc", (4,), moved["bc"][1][4]), ("b", (7,), moved["b"][1][7]), ("s", (2, 9), moved["s"][1][2, 9])]
    tried += [("e", (int(rows[k]), 2), g[k, 2]) for k in (0, 4, len(rows) - 1)]
    tried += [("c", (int(moved["c"][0][0]), 5), moved["c"][1][0, 5])]
    for k, at, want in tried:
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-5 - want) < 1e-6, k


def test_probabilities_sum_to_one():
    net = L.WindowNetwork(1).start(np.arange(L.VOCABULARY))
    each = [net.forward(np.array([5, 9, t, 4000, L.PAD], np.int16))[0][0] for t in range(L.VOCABULARY)]
    assert abs(np.exp(np.array(each, float)).sum() - 1) < 1e-3


def test_the_start_is_the_share_of_the_corpus():
    counts = np.arange(L.VOCABULARY)
    net = L.WindowNetwork().start(counts)
    for k in ("wc", "wm"):
        net.p[k][:] = 0
    got = net.forward(np.array([1, 2, 7, 2000, 4095, 3, 4], np.int16))[0]
    assert np.allclose(got, np.log((counts[[7, 2000, 4095]] + 0.5) / (counts + 0.5).sum()), atol=1e-4)


def flat(docs):
    return np.concatenate([np.array(d, np.int16) for d in docs] or [np.zeros(0, np.int16)]), np.array([len(d) for d in docs], np.int64)


def test_scores_are_sums_over_windows():
    net, rng = L.WindowNetwork(2), np.random.default_rng(5)
    docs = [rng.integers(0, L.VOCABULARY, n) for n in (0, 1, 3, 5000, 0, 2)]
    for d, got in zip(docs, L.log_probabilities(net, *flat(docs)), strict=True):
        line = [L.PAD] * 2 + d.tolist() + [L.PAD] * 2
        want = sum(float(net.forward(np.array(line[k - 2 : k + 3], np.int16))[0][0]) for k in range(2, len(line) - 2))
        assert abs(got - want) < 1e-4 * max(1, len(d))
    assert L.log_probabilities(net, *flat([])).tolist() == [] and L.log_probabilities(net, *flat([docs[0]])).tolist() == [0.0]


def test_ids_are_packed_and_unpacked():
    import pyarrow as pa

    docs = [[1, 2, 4095], [], [7], []]
    made = L.packed_ids(*flat(docs))
    for a, b in ((0, 4), (1, 3), (3, 4), (2, 2)):
        ids, lengths = L.unpacked_ids(made.slice(a, b - a))
        assert ids.tolist() == sum(docs[a:b], []) and lengths.tolist() == [len(d) for d in docs[a:b]]
    assert L.unpacked_ids(pa.array([], pa.binary()))[0].size == 0


def test_encoding_is_that_of_each_word(spark, monkeypatch):
    monkeypatch.setattr(L, "_TEXT_BYTES", 64)
    texts = ["W0 w1, 'w2' zz", None, "", " \u3000w1\x1c-- ", "q " * 100, "w2"]
    words = ["w0", "w1", "w2"]
    known = L.Vocabulary(words)
    made = L.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), words).collect()
    for k, r in enumerate(sorted(made)):
        assert np.frombuffer(r.ids, "<i2").tolist() == known.ids(texts[k]).tolist()


def test_training_beats_the_shares_of_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = L.vocabulary(docs)
    assert words[0] and len(words) == L.VOCABULARY - L.HASHED
    encoded = L.encode(docs.where("doc_id % 5 > 0"), words)
    counts = L.id_counts(encoded)
    assert counts.sum() == sum(len((r.text or "").split()) for r in docs.where("doc_id % 5 > 0").collect())
    ids, lengths = flat([L.Vocabulary(words).ids(r.text) for r in docs.where("doc_id % 5 = 0").collect()])
    shares = np.log((counts + 0.5) / (counts + 0.5).sum())[ids].mean()
    net = L.WindowNetwork().start(counts).load(L.train(encoded, counts))
    assert L.log_probabilities(net, ids, lengths).sum() / len(ids) > shares + 0.1


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_token_is_a_target_once(monkeypatch, rounds):
    monkeypatch.setattr(L, "BATCH", 16)
    docs = [[1], [], [2, 3], list(range(4, 300)), [0]]
    seen, column = [], L.packed_ids(*flat(docs))

    class Seen:
        step = staticmethod(lambda line: seen.extend(line[L.SIDE : -L.SIDE].tolist()))

    assert sum(L.learn(Seen, column, k, rounds) for k in range(rounds)) == 300
    assert sorted(t for t in seen if t != L.PAD) == list(range(300))


def brute_learn(net, docs, offset, stride, batch):
    squares = {k: np.full(v.shape, L._FIRST) for k, v in net.items()}
    made = brute_batches(docs, offset, stride, batch)
    for found in made:
        net, _ = brute_step(net, squares, found, L.RATE)
    return net, sum(map(len, made))


def test_learning_against_brute_force(monkeypatch):
    monkeypatch.setattr(L, "BATCH", 16)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, n).tolist() for n in (40, 3, 25, 0, 7)]
    net = L.WindowNetwork().start(np.bincount(sum(docs, []), minlength=L.VOCABULARY))
    want, n = brute_learn(brute_start(docs), docs, 1, 2, 16)
    assert L.learn(net, L.packed_ids(*flat(docs)), 1, 2) == n
    for k, v in net.p.items():
        assert np.abs(v - want[k]).max() < 2e-2, k


def test_training_against_brute_force(spark):
    """Two partitions, two rounds: steps by brute force, then the weighted mean of the partitions' parameters."""
    rng = np.random.default_rng(3)
    parts = [[rng.integers(0, 50, n).tolist() for n in ns] for ns in ((40, 3, 0), (25, 0, 7))]
    every = parts[0] + parts[1]
    rows = spark.sparkContext.parallelize([(bytearray(np.array(d, "<i2").tobytes()),) for d in every], 2)
    got = L.train(spark.createDataFrame(rows, "ids binary"), np.bincount(sum(every, []), minlength=L.VOCABULARY))
    net = brute_start(every)
    for r in range(2):
        made = [brute_learn(net, p, r, 2, L.BATCH) for p in parts]
        if sum(n for _, n in made):
            net = {k: sum(m[k] * n for m, n in made) / sum(n for _, n in made) for k in net}
    assert np.abs(got - np.concatenate([net[k].ravel() for k in L.WindowNetwork().p])).max() < 2e-2


def test_words_of_one_bucket_have_their_own_probabilities(spark):
    import zlib

    frequent = " ".join(f"w{k}" for k in range(L.VOCABULARY - L.HASHED))
    near = [w for k in range(40_000) if zlib.crc32((w := f"zzq{k}").encode()) % L.HASHED == 7][:4]
    assert len(set(L.Vocabulary([]).look_up(near)[0].tolist())) == 1
    rows = [(0, frequent), (1, frequent)] + [(k, f"w1 w2 {w} w3 w4") for k, w in enumerate(near, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [round(r.log_prob, 3) for r in L.score(docs, rounds=1).orderBy("doc_id").collect()]
    assert len(set(got[2:])) == len(near)


def test_spelling_is_a_distribution():
    from quirework.llm import spelling as S

    rare, known = ["a", "ab", "abc", "abcd", "größe", "漢字", "zz"], ["abd", "b"]
    s = S.Speller(*S.trigrams([S.encoded(w) for w in rare], np.arange(1, 8)), known, 8)
    for a in (97, 98, 0, S.START):
        assert np.allclose(s.table(a).sum(1), 1, atol=1e-5)
    every = np.exp(s.log_share).sum() + sum(np.exp(s.spelled(w)) for w in known)
    assert abs(every - (1 - s.table(S.START)[S.START, S.END])) < 1e-5
    assert s.spelled("abcd") > s.spelled("dcba") and np.isfinite(s.in_bucket(["\ud800x"])[0][0])
    assert all(S.bucket_of(w, 8) == S._buckets_after(w.encode()[0], 8).reshape(256, 256)[tuple((w.encode() + b"\xff\xff")[1:3])] for w in rare)
    assert S.trigrams([], np.zeros(0, int))[0].size == 0 and np.isfinite(S.Speller(*S.trigrams([], np.zeros(0, int)), [], 8).in_bucket(["new"])[0][0])


def test_averages():
    import pyarrow as pa

    v = [np.arange(4, dtype=np.float32), np.full(4, 10, np.float32)]
    t = pa.table({"block": pa.array([1, 1], pa.int32()), "part": pa.array([0, 0], pa.int32()), "n": [1.0, 3.0], "v": pa.array([x.tobytes() for x in v], pa.binary())})
    out = L._averaged(t)
    assert np.allclose(np.frombuffer(out["v"][0].as_py(), np.float32), (v[0] + 3 * v[1]) / 4) and out["n"][0].as_py() == 4


def test_lm_odd(odd, odd_rows, none):
    rows = L.score(odd, rounds=1).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len((t or "").split())) for i, t, *_ in odd_rows)
    for r in rows:
        assert (r.mean_log_prob is None and r.log_prob == 0.0) if r.n_tokens == 0 else r.log_prob < 0
    assert L.score(none).count() == 0


# --- pipeline


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls, blank and long texts, repeated rows, clashing columns; then no rows at all."""
    spark.createDataFrame([(1, 0, 0), (2, None, 1), (None, 1, None), (8, 1, 1), (12, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Größe ñandú 漢字"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = odd, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == odd.columns
        if name != "packing":
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append(Counter(r.doc_id for r in out.collect()))
        docs = out
    assert all(a >= b for a, b in zip(kept, kept[1:], strict=False)) and kept[1][15] == 1 and kept[3][14] == 0
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_dedup import brute_components, brute_fingerprint

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in corpus_pipeline.toxicity.score(docs, corpus_pipeline.toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("toxic").collect()}
    alive = {i for i in rows if i not in toxic}
    best = {}
    for i in alive:
        best[rows[i].text] = max(i, best.get(rows[i].text, -1))
    after_exact = set(best.values())
    ids = sorted(after_exact)
    comps = brute_components(ids, [brute_fingerprint(rows[i].text) for i in ids])
    after_near = set(comps)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    after_bench = {i for i in after_near if not any(b in rows[i].text for b in bench)}
    want = [alive, after_exact, after_near, after_bench]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want[k], name
    assert {r.doc_id for r in docs.collect()} == after_bench
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == after_bench
