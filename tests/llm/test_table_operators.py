"""Sharding, mixing, nearest neighbours and near duplicates against plain versions."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kith.llm import jaccard, mixing, multi_index, sharding
from kith.llm.components import components


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    top = {v: v for e in edges for v in e}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts_for_links(r):
    word = lambda: "w" + str(r.randrange(5000))
    out, passage = [], [word() for _ in range(40)]
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 2, 3, 12, 30, 60, 200, 400]))]
        if r.random() < 0.4:
            base += passage
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy) if r.random() < 0.8 else " ".join(copy).upper())
    return out + [None, "", " \n", "one", "One", "two words"]


def plain_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    top = list(range(len(texts)))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_duplicates_lose_no_link(spark):
    for seed, k, percent in ((1, 3, 90), (2, 5, 80)):
        texts = texts_for_links(random.Random(seed))
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, jaccard.JaccardOptions(k, percent, flush=500, family=6, block=4)).collect()}
        assert got == plain_components(texts, k, percent)


def test_chain_of_near_copies_needs_the_trees(spark):
    """Neighbours on the chain link, its ends don't: a star around one of them misses links."""
    r = random.Random(8)
    words = ["v" + str(i) for i in range(300)]
    texts = []
    for _ in range(40):
        for _ in range(5):
            words[r.randrange(300)] = "n" + str(r.randrange(10**9))
        texts.append(" ".join(words))
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for family, block in ((4, 4), (4096, 512)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, jaccard.JaccardOptions(3, 90, family=family, block=block)).collect()}
        assert got == plain_components(texts, 3, 90)


def plain_links(texts, k, percent):
    sets = [set(map(tuple, (w[i:i + k] for i in range(max(1, len(w) - k + 1))))) if w else set() for w in ((t or "").lower().split() for t in texts)]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= percent * len(a | b)
    return {i: sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}


def test_every_link_is_counted_once(spark):
    """Triangles, exact copies and a group of near copies that all link, in families of one unit, of blocks and by signature."""
    r = random.Random(5)
    texts = texts_for_links(r)
    base = ["g" + str(i) for i in range(150)]
    for _ in range(30):
        base[r.randrange(150)] = "n" + str(r.randrange(10**9))
        near = list(base)
        near[r.randrange(150)] = "x"
        texts += [" ".join(near)] * r.choice([1, 1, 3])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want, groups = plain_links(texts, 3, 90), plain_components(texts, 3, 90)
    assert sum(want.values()) > 2 * (len(texts) - len({c for _, c in groups.values()}))  # more links than components need
    for family, block in ((4, 4), (4096, 8), (4096, 512)):
        got = jaccard.join(df, jaccard.JaccardOptions(3, 90, flush=500, family=family, block=block)).collect()
        assert {x.doc_id: x.n_links for x in got} == want
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == groups
    alone = jaccard.join(df, jaccard.JaccardOptions(3, 90, flush=500, family=4, block=4, count=False))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in alone.collect()} == groups and "n_links" not in alone.columns


def test_pairs_and_stars_of_copies_go_through_the_trees(spark):
    """A signature with two members, and a star whose pairs all link, are joined by trees in both modes."""
    base = {g: [f"{g}{i}" for i in range(200)] for g in "ab"}
    texts = [" ".join(base["a"]), " ".join(base["a"][:-1])] + [" ".join(base["b"][:n]) for n in (200, 199, 198, 197)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for count in (True, False):
        opts = jaccard.JaccardOptions(3, 90, count=count)
        classes = jaccard.describe(df, opts).select("cid", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("size"))
        rep = {x.cid: x.rep for x in classes.collect()}
        found = jaccard.tree_links(jaccard.stars(df, 1000, opts), classes, df, opts).collect()
        assert {rep[x.a] for x in found} | {rep[x.b] for x in found if x.b is not None} == set(range(6))
        assert sum(x.n for x in found if x.b is None) == (2 * (1 + 6) if count else 0)


def test_signature_trees_find_every_link():
    r = random.Random(3)
    sets = [np.unique(np.array([r.randrange(2**60) for _ in range(r.randint(5, 60))], np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[1:], np.array([r.randrange(2**60)], np.uint64)])) for s in sets]
    tree = jaccard.Tree(sets, list(range(len(sets))), 256)
    got = {tuple(sorted(p)) for p in jaccard.traverse(tree, tree, 80)}
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if jaccard.links(sets[i], sets[j], 80)}  # pairs only, so none is spare
    half = jaccard.Tree(sets[:30], list(range(30)), 256), jaccard.Tree(sets[30:], list(range(30, 80)), 256)
    got = {(a, b + 30) for a, b in jaccard.traverse(*half, 80)}
    assert got == {(i, j) for i in range(30) for j in range(30, 80) if jaccard.links(sets[i], sets[j], 80)}
    copies = jaccard.Tree([sets[0]] * 50, list(range(50)), 256)
    assert len(list(jaccard.traverse(copies, copies, 80))) == 49


def test_bitmaps_of_different_widths_lose_no_link():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 15, 17, 33, 70, 130, 260, 500, 17_000)]
    sets += [np.unique(np.concatenate([s[len(s) // 12:], r.integers(0, 2**63, len(s) // 11 + 1).astype(np.uint64)])) for s in sets for _ in range(3)]
    maps = [(len(s), jaccard.bitmap(s, jaccard.width(len(s)))) for s in sets]
    assert len({len(m) for _, m in maps}) > 6
    for percent in (30, 80):
        links = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard.links(sets[i], sets[j], percent)}
        p, q = jaccard.near_maps(maps, maps, percent)
        found = {tuple(sorted(x)) for x in zip(p.tolist(), q.tolist())}
        assert len(found) == len(p) and links <= found and len(found) < len(sets) ** 2 / 4
        p, q = jaccard.near_maps(maps[:20], maps[20:], percent)
        assert {(i, j) for i, j in links if i < 20 <= j} <= {(i, j + 20) for i, j in zip(p.tolist(), q.tolist())}


def test_texts_that_share_a_passage_only_are_sifted_out(spark):
    """They have common signatures, but their texts need not be sent anywhere."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(200))
    texts = [passage + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(150)) for _ in range(30)]
    texts += [texts[0] + " more", texts[1] + " more"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for block in (4, 512):
        opts = jaccard.JaccardOptions(5, 80, flush=500, block=block, count=False)
        rows = jaccard.describe(df, opts)
        classes = rows.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
        cid = {x.doc_id: x.cid for x in rows.collect()}
        met = jaccard.stars(df, 10_000, opts)
        assert len({c for x in met.collect() for c in (x.pivot, x.member)}) > 15
        left = jaccard.sift(met, classes, df, opts).collect()
        assert {frozenset((x.pivot, x.member)) for x in left} == {frozenset((cid[0], cid[30])), frozenset((cid[1], cid[31]))}
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, opts).collect()}
        assert got == plain_components(texts, 5, 80)


def test_rows_that_stay_are_not_marked(spark):
    """Of the rows that an anti join keeps, only the marked ones are shuffled with their texts."""
    df = spark.range(20_000).select(F.col("id").alias("key"), F.concat(F.lit("t"), "id").alias("text"))
    lost = df.filter("key % 10 = 3").select("key").union(spark.range(50_000, 50_010).toDF("key"))
    got = jaccard.without(df, lost, "key")
    assert sorted(map(tuple, got.collect())) == [(i, f"t{i}") for i in range(20_000) if i % 10 != 3]
    assert jaccard.flagged(df, lost, "key").filter("marked").count() < 2_100
    assert jaccard.without(df, lost.limit(0), "key").count() == 20_000


def test_linked_sets_share_a_signature():
    r = random.Random(6)
    for percent in (80, 90):
        for _ in range(400):
            n = r.choice([9, 10, 12, 20, 33, 64, 100, 300])
            a = {r.randrange(2**64) for _ in range(n)}
            b = set(a)
            for _ in range(r.randint(0, max(1, n // 5))):
                b.discard(next(iter(b))) if r.random() < 0.5 else b.add(r.randrange(2**64))
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            if jaccard.links(x, y, percent) and a != b:
                assert set(jaccard.signatures(x, percent).tolist()) & set(jaccard.signatures(y, percent).tolist())


def test_small_sets_in_one_range_share_a_signature():
    """Hashes that all lie in one range leave fewer ranges than signatures; the difference lies in that range too."""
    for n, percent in ((4, 80), (5, 80), (6, 80), (9, 90), (12, 80)):
        a = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(977)
        for extra in (0, 5, 10**6):
            b = np.unique(np.append(a, np.uint64(extra)))
            assert jaccard.links(a, b, percent)
            assert set(jaccard.signatures(a, percent).tolist()) & set(jaccard.signatures(b, percent).tolist())


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "A B C D"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = sorted((x.doc_id or 0, x.component_id) for x in jaccard.join(df.select("doc_id", "text")).collect())
    assert got == [(0, None), (4, 4), (4, 4), (7, 4), (9, 9)]
    assert jaccard.join(df.filter("false")).count() == 0


def test_shards_fit_and_are_as_shallow_as_can_be(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randint(0, 90)) for i in range(500)] + [(7, "same" * 10)] * 40 + [(None, None), (None, "n"), (1000, "y" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("depth", F.lit("kept out"))
    opts = sharding.ShardOptions(limit=300, step=2)
    got = sharding.assign(df, opts).collect()
    assert len(got) == len(rows)
    size, parent = defaultdict(int), defaultdict(int)
    for x in got:
        size[x.depth, x.bits, x.chain] += x.n_bytes
    assert all(b <= 300 or b == 900 for b in size.values())
    for (depth, bits, _), b in size.items():
        for up in range(depth):
            parent[up, bits >> (depth - up)] += b
    assert all(parent[d - 1, b >> 1] > 300 for d, b, _ in size if d)
    assert sharding.assign(df.filter("false"), opts).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([(i % 90, "t" * (i % 50), i) for i in range(200)], "doc_id long, text string, more int")
    sharding.write_shards(df, f"{tmp_path}/s", sharding.ShardOptions(limit=500))
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(x.more for x in back.collect()) == list(range(200))
    assert max(x["b"] for x in back.groupBy("depth", "bits", "chain").agg(F.sum(F.length("text")).alias("b")).collect()) <= 500


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: left * weight[s] / w for s in open_}}
        fixed.update({s: cap * sizes[s] for s in over})


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "B", "é", None, "tiny"]) if i > 5 else "tiny2", r.choice([None, "w " * r.randint(0, 50)]), 1) for i in range(900)]
    rows += [(5000, "empty", None, 1), (5001, "a", "x y z", 1), (5001, "a", "x y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target int")
    opts = mixing.MixOptions(blocks=16, levels=3)
    mixed = mixing.mix(df, opts)
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in got:
        sizes[x.source] += x["size"]
        taken[x.source] += x["size"] * len(x.draws)
        largest[x.source] = max(largest[x.source], x["size"])
        assert len(x.draws) <= 3
    goals = plain_targets(sizes)
    for x in got:
        assert abs(x.target - goals[x.source]) < 1e-6 and x.source_size == sizes[x.source]
    assert all(abs(taken[s] - goals[s]) <= largest[s] for s in sizes)
    shards = defaultdict(int)
    for x in mixing.emit(mixed).collect():
        shards[x.shard] += 1
    assert set(shards) <= set(range(8)) and len(shards) == 8
    assert sorted(map(tuple, mixing.mix(df.repartition(7), opts).select("doc_id", F.size("draws")).collect()), key=str) == \
        sorted(((x.doc_id, len(x.draws)) for x in got), key=str)
    assert mixing.mix(df.filter("false"), opts).count() == 0


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 3), (None, 21)], "source string, draws long")
    got = mixing.shard_quotas(quotas, mixing.MixOptions(levels=3)).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for x in got:
        by_source[x.source] += x.n
        by_shard[x.shard] += x.n
    assert dict(by_source) == {"a": 40, "b": 3, None: 21} and set(by_shard.values()) == {8}


def test_nearest_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 16)) * 3
    x = centres[r.integers(0, 30, 1500)] + r.normal(size=(1500, 16)) * 0.4
    x[700:1100] = x[700]  # a group of equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (None, rows[0][1]), (20, rows[20][1]), (5080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    opts = multi_index.MultiIndexOptions(k=10, cells=8, reach=400, share=0.0, block=100, chunk=16)
    got = defaultdict(list)
    for g in multi_index.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", opts).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.vec_id, g.score))
    assert set(got) == {i for i in range(1500) if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = np.array([float(np.dot(x[q], v)) for v in x])
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:10]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 10 and all(abs(sc - s[v]) < 1e-9 for v, sc in found)
    assert hits / (10 * len(got)) >= 0.9
    whole = multi_index.search(df.limit(0), df, "vec_id", "embedding", opts)
    assert whole.count() == 0 and whole.columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_of_the_registered_search(spark):
    """The default options on a whole given table, half of it without clusters, against brute force in blocks."""
    folder = "/root/testdata/check_s"  # larger than reach, so that not all of it is scanned
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    assert recall(spark, folder) >= 0.9


def recall(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = multi_index.usable(vectors, "vec_id", "embedding").collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.v for r in rows])
    got, k = defaultdict(set), multi_index.MultiIndexOptions().k
    for g in multi_index.search(vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding").collect():
        got[g.query_id].add(g.vec_id)
    queries, hits, all_ = np.flatnonzero(ids % 20 == 0), 0, 0
    for block in np.array_split(queries, max(1, len(queries) // 256)):
        scores = np.round(x[block] @ x.T, 9)
        for q, s in zip(block, scores):
            s[ids == ids[q]] = -np.inf
            best = set(ids[np.lexsort((ids, -s))[:k]].tolist())
            hits, all_ = hits + len(best & got[ids[q]]), all_ + len(best)
    return hits / all_


def test_an_id_with_several_vectors_is_one_neighbour(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(90, 8))
    ids = [i % 30 for i in range(90)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    opts = multi_index.MultiIndexOptions(k=12, cells=4, share=1.0, block=20, chunk=2)
    got = defaultdict(list)
    for g in multi_index.search(df, df.filter("vec_id = 4 or vec_id = 9"), "vec_id", "embedding", opts).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.vec_id, round(g.score, 9)))
    for q in (4, 9):
        best = {}
        for a in np.flatnonzero(np.array(ids) == q):
            for i, v in zip(ids, x):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(x[a] @ v))
        assert got[q] == [(i, round(s, 9)) for i, s in sorted(best.items(), key=lambda e: (-e[1], e[0]))[:12]]
