"""Near copies, vectors, quality, line templates, mixing, the pipeline: against brute force, SQL and held-out labels."""

import bisect
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strataq.llm import components, line_templates, pfair, probminhash, registry, sorted_passes, zstd_quality

SF = "/root/testdata/sf0.01"


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    n = 60
    pairs = [(i, i + 1) for i in range(20)] + [(r.randrange(n), r.randrange(n)) for _ in range(15)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(n, pairs)
    assert got == {i: want[i] for i in range(n) if any(i in p and p[0] != p[1] for p in pairs)}


# --- op1 ---


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    words = [probminhash.words_of(t or "") for _, t in rows]
    doc, element, weight = probminhash.shingles(words)
    edges = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(element[a:b], weight[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    holders = defaultdict(list)
    for d, e in zip(doc.tolist(), element.tolist(), strict=True):
        holders[e].append(d)
    near = {(a, b) for v in holders.values() for k, b in enumerate(v) for a in v[:k]}
    pairs = [(a, b) for a, b in near if probminhash.probability_jaccard(sets[a], sets[b]) >= 0.8]
    want = roots(len(rows), pairs)
    got = {r["doc_id"]: r["group_id"] for r in probminhash.near_duplicates(docs).collect()}
    assert got == {rows[i][0]: rows[want[i]][0] for i in range(len(rows))}


def test_slots_estimate_probability_jaccard():
    r = random.Random(4)
    errors = []
    for k in range(60):
        base = [f"w{r.randrange(400)}" for _ in range(500)]
        other = [w if r.random() > k / 400 else f"z{r.randrange(900)}" for w in base] + base[:100]
        doc, element, weight = probminhash.shingles([base, other])
        s = probminhash.signatures(doc, element, weight, 2, 256)
        x, y = ((element[doc == i], weight[doc == i]) for i in (0, 1))
        errors.append((s[0] == s[1]).mean() - probminhash.probability_jaccard(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_exact_similarity():
    def brute(x, y):
        a, b = (dict(zip(*map(list, s), strict=True)) for s in (x, y))
        return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b)) for d in a if d in b)

    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = ((np.unique(r.integers(0, 30, 20)).astype(np.uint64)) for _ in range(2))
        x, y = (x, r.integers(1, 5, len(x))), (y, r.integers(1, 5, len(y)))
        assert abs(brute(x, y) - probminhash.probability_jaccard(x, y)) < 1e-9


def test_near_duplicates_of_hard_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, text), (7, text + " more"), (8, text.replace("w5 ", "x5 ")), (9, "one three"), (9, "one three"), (10, "w " * 50_000), (None, text)]
    df = spark.createDataFrame([(i, t, "c", "r", 1, 2, 3) for i, t in rows], "doc_id long, text string, class_id string, root string, __id int, key int, row int")
    got = {r["doc_id"]: r["group_id"] for r in probminhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9, 10: 10}
    kept = probminhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 9, 10]
    assert {tuple(r)[2:] for r in kept.collect()} == {("c", "r", 1, 2, 3)}
    assert probminhash.near_duplicates(df.limit(0)).count() == 0 and probminhash.keep_one(df.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (1, "something else altogether that is not like it"), (2, text), (3, "something else altogether, that is not like it!"), (3, "a third text of its own, with words enough"), (1, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["group_id"], r["kept"]) for r in probminhash.near_duplicates(df).collect())
    assert got.count((1, 1, True)) == 2 and got.count((1, 1, False)) == 1 and (2, 1, False) in got and (3, 1, False) in got and (3, 3, True) in got and len(got) == 6
    kept = sorted((r["doc_id"], r["text"]) for r in probminhash.keep_one(df).collect())
    assert len(kept) == 3 and rows[1] in kept and rows[4] in kept and kept[2] == rows[4]


def test_a_large_family_of_near_copies_like_chains(spark, monkeypatch):
    """Copies of copies: neighbours are alike, far ones are not; all one group, with rows in proportion to the texts at each step."""
    r = random.Random(3)
    texts = [[f"w{r.getrandbits(30)}" for _ in range(240)]]
    for _ in range(500):
        new = list(texts[r.randrange(max(0, len(texts) - 40), len(texts))])
        for _ in range(4):
            new[r.randrange(len(new))] = f"n{r.getrandbits(30)}"
        texts.append(new)
    sets = [(e, w) for t in texts for _, e, w in [probminhash.shingles([t])]]
    elements = [set(e.tolist()) for e, _ in sets]
    near = [(a, b) for b in range(len(sets)) for a in range(b) if len(elements[a] & elements[b]) > 150 and probminhash.probability_jaccard(sets[a], sets[b]) >= 0.8]
    want = roots(len(texts), near)
    monkeypatch.setattr(probminhash, "BLOCK", 64)
    got = {x["doc_id"]: x["group_id"] for x in probminhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    found = [got[i] for i in range(len(texts))]
    assert [found[a] == found[b] for a, b in near].count(False) <= len(near) // 1000  # what no band pairs
    assert all(want[got[i]] == want[i] for i in got)


def test_large_groups_of_near_copies(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(w if r.random() > 0.004 else "zz" for w in base) for _ in range(300)] + [" ".join(r.choice(base) for _ in range(200)) for _ in range(50)]
    got = probminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter(x["group_id"] for x in got)[0] == 300 and sum(x["kept"] for x in got) == 51


def test_pairs_inside_a_family_of_templates(spark, monkeypatch):
    r = random.Random(12)
    form = [f"form{i}" for i in range(420)]
    own = lambda n: [f"x{r.getrandbits(40)}" for _ in range(n)]
    texts = []
    for _ in range(300):  # two texts of similarity about 0.81; about 0.69 to all other groups
        both = own(38)
        texts += [" ".join(form + both + own(53)) for _ in range(2)]
    sets = [(e, w) for t in texts for _, e, w in [probminhash.shingles([probminhash.words_of(t)])]]
    assert all(probminhash.probability_jaccard(sets[k], sets[k + 1]) >= 0.8 for k in range(0, 600, 2))
    assert all(0.65 < probminhash.probability_jaccard(sets[k], sets[k + 2]) < 0.8 for k in range(598))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1024, 32):
        monkeypatch.setattr(probminhash, "BLOCK", block)
        got = {x["doc_id"]: x["group_id"] for x in probminhash.near_duplicates(docs).collect()}
        assert got == {k: k - k % 2 for k in range(600)}


def test_blocks_hand_on_classes_once(spark, monkeypatch):
    """All pairs of different roots meet once, and rows do not grow with classes times blocks."""
    monkeypatch.setattr(probminhash, "BLOCK", 32)
    n, text = 1200, "x" * 100
    root = lambda k: 0 if k % 3 else k
    rows = [(7, k.to_bytes(2), root(k).to_bytes(2), n, bytes(2), text) for k in range(n)] + [(8, k.to_bytes(2), k.to_bytes(2), 5, bytes(2), text) for k in range(5)]
    df = spark.createDataFrame(rows, "band long, id binary, root binary, n long, top binary, text string")
    got = probminhash.blocks_of(df).collect()
    assert len(got) < 2000  # a row for each class and partner block were some 26 000
    pairs = defaultdict(list)
    for x in got:
        pairs[x["band"], x["i"], x["j"]].append((x["own"], [int.from_bytes(m["id"]) for m in x["members"]]))
    met = Counter()
    for (band, i, j), blocks in pairs.items():
        members = [(own, k) for own, ids in blocks for k in ids]
        met.update((band, *sorted((a, b))) for q, (o, a) in enumerate(members) for p, b in members[:q] if i == j or o != p)
    assert set(met.values()) == {1}
    assert all((7, a, b) in met for b in range(n) for a in range(b) if root(a) != root(b)) and all((8, a, b) in met for b in range(5) for a in range(b))
    monkeypatch.setattr(probminhash, "BLOCK_CHARS", 400)
    assert max(len(x["members"]) for x in probminhash.blocks_of(df).collect()) < 25


# --- op5 ---


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{more}")


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 32))
    x = np.concatenate([centre[r.integers(0, 40, 300)] + r.normal(size=(300, 32)) * s for s in (0.03, 0.2)] + [centre[:5]]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {y["vec_id"]: y for y in sorted_passes.near_duplicate_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    want = roots(len(x), list(zip(*np.nonzero(near), strict=True)))
    assert [got[i]["component_id"] for i in range(len(x))] == want
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(x)))


def test_codes_bound_the_cosine():
    """What the codes prove or rule out is so: for vectors near the threshold, and for hard shapes."""
    r = np.random.default_rng(11)
    base = r.normal(size=(4000, 24))
    other = base + r.normal(size=base.shape) * r.uniform(0.2, 0.5, (len(base), 1))
    spiky = np.where(r.random((200, 24)) < 0.1, 1e6, 1e-3) * r.normal(size=(200, 24))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, y = unit(np.concatenate([base, spiky])), unit(np.concatenate([other, spiky[::-1]]))
    (a, sa, ea), (b, sb, eb) = sorted_passes.coded(x), sorted_passes.coded(y)
    guess = np.einsum("ij,ij->i", a * sa[:, None].astype(float), b * sb[:, None].astype(float))
    ea, eb = ea.astype(float), eb.astype(float)
    assert (np.abs(guess - np.einsum("ij,ij->i", x, y)) <= ea + eb + ea * eb).all() and ea.max() < 0.02


def test_pairs_inside_a_dense_cone(spark, monkeypatch):
    r = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    aside = lambda v, c: unit(c**0.5 * v + (1 - c) ** 0.5 * unit(r.normal(size=v.shape)))
    cone = aside(np.broadcast_to(unit(r.normal(size=64)), (1500, 64)), 0.88)
    x = np.concatenate([unit(r.normal(size=(3000, 64))), cone, aside(cone[:200], 0.92)]).astype(np.float32)
    wide = unit(x.astype(float))
    near = wide @ wide.T >= 0.95
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    assert len(a) > 300
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for few in (sorted_passes.FEW, 8):  # straight to the blocks, and after further passes
        monkeypatch.setattr(sorted_passes, "FEW", few)
        got = {y["vec_id"]: y["component_id"] for y in sorted_passes.near_duplicate_vectors(rows).collect()}
        found = np.array([got[i] for i in range(len(x))])
        assert np.mean(found[a] == found[b]) >= 0.99, (few, len(a), np.mean(found[a] == found[b]))


def test_blocks_count_wide_components(spark, monkeypatch):
    monkeypatch.setattr(sorted_passes, "BLOCK", 16)
    angle = np.linspace(0, np.pi / 2, 120)  # a chain: neighbours link, ends do not
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    near = (u := x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)) @ u.T >= 0.95
    got = {y["vec_id"]: y for y in sorted_passes.near_duplicate_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert {y["component_id"] for y in got.values()} == {0} and [got[i]["n_links"] for i in range(120)] == (near.sum(1) - 1).tolist()


def test_hard_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, []), (11, [0.0, 1.0]), (11, [0.0, 1.0])]
    df = vectors(spark, [(i, v, 1, 2) for i, v in rows], ", n_links int, key int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in sorted_passes.near_duplicate_vectors(df).collect()}
    assert got == {i: (0, i) for i in (1, 2, 3, 4, 5, 9, 10, 11)} | {i: (2, 6) for i in (6, 7, 8)}
    assert sorted_passes.near_duplicate_vectors(df.limit(0)).count() == 0


# --- op6 ---


def labelled(sf="sf0.1"):
    at = lambda t: f"read_parquet('/root/testdata/{sf}/{t}.parquet')"
    rows = duckdb.sql(f"SELECT coalesce(text, ''), quality, doc_id FROM {at('documents')} d JOIN {at('labels')} l USING (doc_id) WHERE quality IN (0, 1) ORDER BY doc_id").fetchall()
    return [(t, q) for t, q, i in rows if zlib.crc32(str(i).encode()) % 5], [(t, q) for t, q, i in rows if zlib.crc32(str(i).encode()) % 5 == 0]


def fit_without_spark(rows):
    """Dictionaries from the first 70 % of each class, then what ``train`` does with the rest: (told, prior, model)."""
    held, rest = [], []
    for k in (1, 0):
        own = [t.encode() for t, q in rows if q == k][:1500]
        cut = round(len(own) * 0.7)
        most = max(zstd_quality.PIECE, zstd_quality.equal_share([len(x) for x in own[:cut]], zstd_quality.DICTIONARY_BYTES))
        held.append(zstd_quality.dictionary([zstd_quality.even_pieces(x, most) for x in own[:cut]]))
        rest += [(x.decode(), k) for x in own[cut:]]
    of = zstd_quality.differ(*held)
    told = np.array([(k, *of(t)) for t, k in rest], float)
    prior = sum(q for _, q in rows) / len(rows)
    return told, prior, zstd_quality.fitted(*held, told, prior)


def test_calibration_equals_an_independent_fit():
    rows, _ = labelled("sf0.01")
    told, prior, model = fit_without_spark(rows)
    label, saved, size = told.T
    x = zstd_quality.smoothed(saved, size, model.mean)
    weight = zstd_quality.weights_of(label, prior)
    middle, spread = (weight * x).sum() / weight.sum(), x.std()
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    w, before, slope = np.zeros(2), np.zeros(2), np.inf
    for k in range(1, 400_000):  # accelerated gradient descent from nought
        ahead = w + (k - 1) / (k + 2) * (w - before)
        p = 1 / (1 + np.exp(-z @ ahead))
        slope = z.T @ (weight * (p - label)) + zstd_quality.RIDGE * ahead
        before, w = w, ahead - 1.0 * slope / max((weight[:, None] * z * z).sum(0).max() / 2, 1)
        if np.abs(slope).max() < 1e-10:
            break
    assert np.abs(slope).max() < 1e-8
    assert np.allclose([model.slope, model.offset], [w[0] / spread, w[1] - w[0] * middle / spread], rtol=1e-4)


def test_calibration_converges_on_any_resample():
    """Each fit ends at a point without slope, rises with the difference and does not depend on the order of the rows."""
    rows, _ = labelled()
    told, prior, model = fit_without_spark(rows)
    r = np.random.default_rng(4)
    for k in range(200):
        some = told[r.choice(len(told), len(told) * (1 + k % 4) // 4)]
        if len(set(some[:, 0])) < 2:
            continue
        found = zstd_quality.fitted(model.good, model.bad, some, prior)
        again = zstd_quality.fitted(model.good, model.bad, some[r.permutation(len(some))], prior)
        assert found == again and found.slope >= 0
        x, weight = zstd_quality.smoothed(some[:, 1], some[:, 2], found.mean), zstd_quality.weights_of(some[:, 0], prior)
        p = 1 / (1 + np.exp(-np.clip(found.slope * x + found.offset, -700, 700)))
        spread = x.std() or 1
        assert abs((weight * (p - some[:, 0])).sum()) < 2e-3 and abs((weight * (p - some[:, 0]) * (x - x.mean())).sum() / spread) < 2e-3
        share = np.mean(p >= zstd_quality.THRESHOLD)
        assert abs(share - some[:, 0].mean()) < 0.06
    apart = np.array([(1, 50, 100)] * 9 + [(0, -50, 100)] * 9, float)  # classes that a line parts
    assert zstd_quality.fitted(b"x" * 8, b"y" * 8, apart, 0.5).slope > 0
    mixed = np.array([(k % 2, k // 2, 100) for k in range(40)], float)
    assert zstd_quality.fitted(b"x" * 8, b"y" * 8, mixed * [1, 0, 1], 0.9).slope == 0.0


@pytest.mark.parametrize("seed", range(8))
def test_models_of_other_samples_keep_the_same_share(seed):
    rows, held_out = labelled()
    r = random.Random(seed)
    _, _, model = fit_without_spark(r.sample(rows, len(rows) * 3 // 4))
    f = model.scorer()
    right = [(f(t) >= zstd_quality.THRESHOLD) == q for t, q in held_out]
    assert np.mean(right) > 0.965
    docs = [t or "" for (t,) in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.1/documents.parquet') WHERE doc_id % 20 = 3").fetchall()]
    assert 0.83 < np.mean([f(t) >= zstd_quality.THRESHOLD for t in docs]) < 0.91


def test_held_out_quality(spark):
    got = registry.op6_zstd_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    assert np.mean([r["predicted"] for r in got if r["quality"] == 1]) > 0.97


def test_model_does_not_depend_on_partitions_or_repeated_ids(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    more = docs.limit(50).withColumn("text", F.lit("~ another text under the same id"))
    one = zstd_quality.train(docs.unionByName(more), labels)
    assert one == zstd_quality.train(more.unionByName(docs).repartition(7, "text"), labels.repartition(3))


def test_scores_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = zstd_quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in zstd_quality.score(docs, model).collect()}
    for r in docs.where("doc_id % 9 = 0").collect():
        raw, sizes = (r["text"] or "").encode(), []
        for held in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(held, zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[k : k + zstd_quality.SEGMENT])) for k in range(0, len(raw), zstd_quality.SEGMENT)))
        x = (sizes[1] - sizes[0] + zstd_quality.EVIDENCE * model.mean) / (len(raw) + zstd_quality.EVIDENCE)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-(model.slope * x + model.offset)))) < 1e-9


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert zstd_quality.train(docs, labels) == zstd_quality.train(docs, turned)


def test_quality_of_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0, 2, 3), (2, "", 1.0, 2, 3), (3, "good words here", 1.0, 2, 3), (3, "good words here", 1.0, 2, 3), (4, "x " * 100_000, 1.0, 2, 3)], "doc_id long, text string, score double, row int, __score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (9, None)], "doc_id long, quality int")
    for marked in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = zstd_quality.train(docs, marked)
        got = zstd_quality.score(docs, model).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        kept = zstd_quality.keep_good(docs, model)
        assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} <= {(1.0, 2, 3)}
    empty = docs.limit(0)
    model = zstd_quality.train(empty, labels)
    assert zstd_quality.score(empty, model).count() == 0 and zstd_quality.keep_good(empty, model).count() == 0


# --- op10 ---


def same_as_sql(spark, docs):
    duck = duckdb.connect()
    duck.register("documents", docs.select("doc_id", "text").toArrow())
    got = sorted(map(tuple, line_templates.drop_recurring_lines(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)
    want = sorted(duck.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({line_templates.ORACLE_SQL})").fetchall(), key=repr)
    assert got == want
    return {r[0]: r[3] for r in got}


def test_line_templates(spark):
    prose = lambda k: " ".join(f"{w}{'xyz'[k % 3]}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split())
    long = "This work is given to all who want to read it at home or away by {} and friends today"
    texts = ["Page 1 of 20\nown line one here", "Page 2 of 20\nown line two there", "own\n\n \nAll rights reserved.\tYes", "All  rights reserved. Yes\nAll rights reserved. Yes", None, "", long.format("Ann"), long.format("Bob"), prose(0), prose(1), "the same text\nwhole copy", "the same text\nwhole copy", "a b\nc d", "a b\nc d e", "x" * 60_000 + " y z\n" + "1" * 60_000]
    got = same_as_sql(spark, spark.createDataFrame([(i, t, 0, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_dropped int, __n int").drop("__n").withColumns({c: F.lit(c) for c in ("__id", "__text", "row", "key", "parts")}))
    assert got[0] == texts[0] and got[1] == "own line two there" and got[2] == texts[2] and got[3] == "" and got[4] is None and got[5] == ""
    assert got[6] == texts[6] and got[7] == "" and got[8] == texts[8] and got[9] == texts[9] and got[10] == got[11] == texts[10]


def test_every_family_of_a_leaf_generalises(spark):
    """Two families of notices with the same opening words and length, with names without a digit in different places."""
    first = "this is the notice of the town of {} that all gates close when the bell rings at night"
    second = "this is the place where goods from over sea and river are weighed by {} before they go on"
    names = ["Ann", "Bob", "Cid", "Dora", "Eve", "Finn"]
    texts = [f"own line number of {n}\n" + form.format(n) for form in (first, second) for n in names]
    got = same_as_sql(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [("this is the" in got[i]) for i in range(12)] == [True] + [False] * 5 + [True] + [False] * 5


def test_line_templates_on_random_texts_and_repeats(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice(["a", "b", "c1", "2", "d", ""]) for _ in range(r.randint(0, 16)))
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 6)))) for i in range(150)]
    same_as_sql(spark, spark.createDataFrame([*rows, rows[3]], "doc_id long, text string"))
    assert line_templates.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- op4 ---


def fluid(sizes, units):
    """Slots passed at virtual time v, in exact arithmetic."""
    return lambda v: sum(min(Fraction(n), u * v) for n, u in zip(sizes, units, strict=True))


def earliest_deadline_first(sizes, units, names):
    """Source of each slot by a plain simulation in exact arithmetic."""
    t = fluid(sizes, units)
    jobs = sorted((math.floor(t(Fraction(i, u))), math.ceil(t(Fraction(i + 1, u))), s, i) for n, u, s in zip(sizes, units, names, strict=True) for i in range(n))
    out, ready, at = [], [], 0
    for slot in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        due, s, i = heapq.heappop(ready)
        assert slot < due
        out.append((s, i))
    return out


def source_table(spark, sizes, units, tiers=None):
    rows = [(tier, k + 1, n, u) for k, (n, u, tier) in enumerate(zip(sizes, units, tiers or [0] * len(sizes), strict=True))]
    return spark.createDataFrame(rows, "tier int, source long, blocks long, units long")


@pytest.mark.parametrize("seed", range(4))
def test_schedule_equals_a_plain_simulation(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(pfair, "LEAST_EPOCH", [5, 40, 64, 4096][seed])  # many epochs that hand over
    monkeypatch.setattr(pfair, "STEP", [1, 4, 7, 32][seed])
    k = [3, 9, 25, 6][seed]
    sizes = [r.choice([1, 2, r.randint(1, 60), r.randint(1, 200)]) for _ in range(k)]
    units = [r.choice([1, 7, r.randint(1, 10**6), 10**15]) if seed == 3 else r.randint(1, 50) for _ in range(k)]
    got = sorted((x["slot"], x["source"], x["block"]) for x in pfair.schedule(source_table(spark, sizes, units)).collect())
    want = earliest_deadline_first(sizes, units, range(1, k + 1))
    assert [x[0] for x in got] == list(range(sum(sizes))) and [x[1:] for x in got] == want


def test_less_than_one_block_from_the_target_in_a_million_slots(spark):
    """5000 sources of unlike weights; after each slot, in exact arithmetic, each source is within one block of its fluid share."""
    r = np.random.default_rng(9)
    sizes = np.r_[r.integers(1, 40, 4990), r.integers(50_000, 150_000, 10)]
    units = np.r_[r.integers(1, 10**6, 4990), r.integers(10**7, 10**8, 10)]
    found = pfair.schedule(source_table(spark, sizes.tolist(), units.tolist())).select("slot", "source", "block").toPandas().sort_values("slot")
    n = int(sizes.sum())
    assert n > 800_000 and (found["slot"].to_numpy() == np.arange(n)).all()
    assert not found.duplicated(["source", "block"]).any() and (found.groupby("source")["block"].max().to_numpy() == sizes - 1).all()
    # Block i of s: no earlier than floor(t(i / u)) and before ceil(t((i + 1) / u)), which is the bound.
    ends = sorted((Fraction(int(b), int(u)), int(b), int(u)) for b, u in zip(sizes, units, strict=True))
    gone = np.r_[0, np.cumsum([e[1] for e in ends])].tolist()
    live = (sum(e[2] for e in ends) - np.r_[0, np.cumsum([e[2] for e in ends])]).tolist()
    times = [e[0] for e in ends]

    def t(i, u):
        k = bisect.bisect_left(times, Fraction(i, u))
        return gone[k] * u + live[k] * i  # times u

    some = found.iloc[r.choice(n, 60_000, replace=False)]
    for slot, s, i in zip(*(some[c].tolist() for c in ("slot", "source", "block")), strict=True):
        u = int(units[s - 1])
        assert t(i, u) // u <= slot < -(-t(i + 1, u) // u)


def test_weights_are_whole_units():
    assert pfair.whole_units({"a": 0.5, "b": 0.25, "c": 0, "d": None}) == {"a": 2, "b": 1}
    assert pfair.whole_units({"a": Fraction(1, 3), "b": 2}) == {"a": 1, "b": 6}
    assert max(pfair.whole_units({"a": 0.1, "b": 0.7}).values()) <= pfair.MOST_UNITS and pfair.whole_units({}) == {}


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1.0}, {"b": 0.0, "zz": 3.0}])
def test_mix_equals_the_schedule(spark, weights):
    sizes = {"a": 500, "b": 90, "c": 41, "d": 1}
    rows = [(i, s, None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = pfair.mix_places(spark.createDataFrame(rows, "doc_id long, source string, slot string"), weights=weights, block_rows=8).collect()
    assert len(got) == len(rows) and len({(r["slot"], r["row_in_block"]) for r in got}) == len(rows)
    units = {s: round(n**0.5 * pfair.ROOT_UNITS) for s, n in sizes.items()} if weights is None else pfair.whole_units(weights)
    want = []
    for tier in (lambda s: s in units, lambda s: s not in units):
        names = [s for s in sizes if tier(s)]
        want += earliest_deadline_first([-(-sizes[s] // 8) for s in names], [units.get(s, sizes[s]) for s in names], names)
    assert [(r["source"], r["block"]) for r in sorted(got, key=lambda r: r["slot"]) if not r["row_in_block"]] == want


def test_mix_of_hard_rows(spark):
    rows = [(1, "s", "t"), (1, "s", "t"), (1, "s", "other"), (None, None, None), (None, "s", "u"), (2, None, ""), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for c in ("row", "__row", "__slot", "slot", "__source", "name", "key", "range", "block", "__hash", "a.b"):
        df = df.withColumn(c, F.lit(c))
    out = pfair.in_mix_order(df)
    assert out.columns == df.columns and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert pfair.mix_places(df.limit(0)).count() == 0 and pfair.in_mix_order(df.limit(0)).count() == 0
    plan = pfair.mix_places(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pipeline ---


def test_pipeline(spark):
    """Rows, columns and the share of documents that each stage keeps."""
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "mixing", "bpe"]
    n = docs.count()
    good = pipeline.quality(spark, docs, folder)
    kept = good.count()
    assert good.columns == docs.columns and 0.83 < kept / n < 0.91
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    assert good.join(labels, "doc_id").count() / docs.join(labels, "doc_id").count() > 0.97
    got = pipeline.run(spark, folder)
    assert got.columns == [*docs.columns, *pipeline.ADDED] and 0.6 * kept < got.count() <= kept
    assert got.select("doc_id").distinct().count() == got.count()


def test_pipeline_of_empty_and_hard_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    source.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    hard = source.limit(20).unionByName(source.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "", "", 0), (10**9, "word " * 30_000, None, "x", 5)], source.schema))
    for c in ("row", "__row", "__id", "__score", "ids", "key", "file", "position", "a.b"):
        hard = hard.withColumn(c, F.lit(c))
    hard.write.parquet(f"{tmp_path}/hard/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/hard/labels.parquet")
    got = pipeline.run(spark, f"{tmp_path}/hard")
    assert set(hard.columns) | set(pipeline.ADDED) == set(got.columns) and got.where("__score <> '__score' OR row <> 'row' OR `a.b` <> 'a.b'").count() == 0
    assert sorted(r["position"] for r in got.collect()) == list(range(got.count()))


def test_pipeline_keeps_the_order_of_the_mix(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    got = pipeline.run(spark, "/root/testdata/sf0.001").select("position", "doc_id", "source").collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    places = pfair.mix_places(spark.createDataFrame([(r["doc_id"], r["source"]) for r in got], "doc_id long, source string")).collect()
    assert [r["doc_id"] for r in sorted(got)] == [r["doc_id"] for r in sorted(places, key=lambda r: (r["slot"], r["row_in_block"]))]


def test_positions_follow_files_of_differing_size(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "repeat(uuid(), int(10000 / (id + 1))) AS text")
    rows.repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/x")
    got = pytest.importorskip("corpus_pipeline").positioned(spark.read.parquet(f"{tmp_path}/x"))
    assert got.count() == 5000 and got.where("position <> row.id").count() == 0
