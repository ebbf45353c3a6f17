import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kith import KnnOptions
from kith.operators import kernels
from kith.operators import knn as N

SMALL = dict(seed_block_rows=7, corpus_block_rows=20)
PLANS = [dict(plan="broadcast"), dict(plan="partitioned"), dict(plan="partitioned", **SMALL), dict(plan="partitioned", corpus="moved", **SMALL),
         dict(plan="partitioned", corpus="in_place", running_rows=70), dict(plan="broadcast", floor_rows=1, floor_share=3)]


def frame(spark, vectors, ids=None, parts=3):
    ids = range(len(vectors)) if ids is None else ids
    kind = "string" if isinstance(list(ids)[0], str) else "long"
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"id {kind}, embedding array<float>").repartition(parts)


def brute(seeds, corpus, k, metric, exclude_self=False, seed_ids=None, ids=None):
    seed_ids = range(len(seeds)) if seed_ids is None else seed_ids
    ids = range(len(corpus)) if ids is None else ids
    out = set()
    for i, a in zip(seed_ids, seeds):
        scored = []
        for j, b in zip(ids, corpus):
            if a is None or b is None or (exclude_self and i == j):
                continue
            a64, b64 = np.float32(a).astype(float), np.float32(b).astype(float)
            if metric == "cosine":
                if not a64.any() or not b64.any():
                    continue
                score = round(float(a64 @ b64 / np.sqrt((a64 @ a64) * (b64 @ b64))), 9)
                scored.append((-score, j, score))
            else:
                score = round(float(((a64 - b64) ** 2).sum()), 9)
                scored.append((score, j, score))
        out |= {(i, j, r + 1, round(s, 6)) for r, (_, j, s) in enumerate(sorted(scored)[:k])}
    return out


def rows(df):
    return {(r.seed_id, r.neighbor_id, r["rank"], round(r.score, 6) + 0.0) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 8))
    corpus = np.vstack([centers[rng.integers(5, size=90)] + 0.1 * rng.normal(size=(90, 8)),
                        np.repeat(centers[:1], 60, axis=0)])  # a hot group of exact copies
    return corpus[rng.permutation(150)], centers[rng.integers(5, size=40)] + 0.1 * rng.normal(size=(40, 8))


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_every_plan_is_exact(spark, clustered, plan, metric, exclude_self):
    corpus, seeds = clustered
    got = N.knn_join(frame(spark, seeds), frame(spark, corpus), 6, KnnOptions(metric, exclude_self, **plan))
    assert rows(got) == brute(seeds, corpus, 6, metric, exclude_self)


@pytest.mark.parametrize("plan", PLANS)
def test_k_beyond_the_corpus_and_string_ids(spark, plan):
    corpus, seeds = np.eye(4)[:3], np.eye(4)[1:]
    got = N.knn_join(frame(spark, seeds, ["s1", "s2", "s3"]), frame(spark, corpus, ["ä", "b", "c"]), 10,
                     KnnOptions(**plan))
    assert rows(got) == brute(seeds, corpus, 10, "cosine", seed_ids=["s1", "s2", "s3"], ids=["ä", "b", "c"])


@pytest.mark.parametrize("plan", PLANS)
def test_string_ids_in_a_large_corpus(spark, clustered, plan):
    corpus, seeds = clustered
    ids = [f"é{i * 7919 % 150}" for i in range(150)]
    got = N.knn_join(frame(spark, seeds), frame(spark, corpus, ids), 4, KnnOptions(**plan))
    assert rows(got) == brute(seeds, corpus, 4, "cosine", ids=ids)


def test_string_ids_over_many_tiles(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kernels, "TILE_CELLS", 60)
    rng = np.random.default_rng(2)
    seeds, corpus = rng.integers(-2, 3, size=(6, 4)), rng.integers(-2, 3, size=(300, 4))
    ids = [f"r{i * 7919 % 1000}" for i in range(300)]
    column = lambda v: pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))
    block = kernels.SeedBlock("l2", 3, pa.array(range(6)), column(seeds), False)
    block.best.limit = 5
    for i in range(0, 300, 50):
        block.stream(pa.array(ids[i:i + 50]), column(corpus[i:i + 50]))
    got = block.result().to_pandas()
    assert set(zip(got.seed_id, got.neighbor_id)) == {r[:2] for r in brute(seeds, corpus, 3, "l2", ids=ids)}


@pytest.mark.parametrize("plan", PLANS)
def test_rows_without_direction_are_left_out(spark, plan):
    corpus = [[1, 0], None, [0, 0], [0, 1]]
    seeds = [[1, 1], [0, 0], None]
    got = N.knn_join(frame(spark, seeds), frame(spark, corpus), 5, KnnOptions(**plan))
    assert rows(got) == brute(seeds, corpus, 5, "cosine")
    assert {r[0] for r in rows(got)} == {0}


@pytest.mark.parametrize("plan", PLANS)
def test_empty_sides(spark, plan):
    some = frame(spark, np.eye(3))
    for seeds, corpus in ((some.limit(0), some), (some, some.limit(0))):
        assert N.knn_join(seeds, corpus, 2, KnnOptions(**plan)).collect() == []


def test_equal_scores_rank_by_id(spark):
    corpus = np.ones((30, 3))
    for plan in PLANS:
        got = N.knn_join(frame(spark, corpus[:2]), frame(spark, corpus, parts=5), 4, KnnOptions(**plan))
        assert {r[:3] for r in rows(got)} == {(s, j, j + 1) for s in (0, 1) for j in range(4)}


def test_too_many_seeds_leave_the_broadcast_plan(spark, clustered):
    corpus, seeds = clustered
    s, c = frame(spark, seeds), frame(spark, corpus)
    with pytest.raises(ValueError, match="partitioned"):
        N.knn_join(s, c, 3, KnnOptions(plan="broadcast", broadcast_rows=10))
    with pytest.raises(ValueError, match="partitioned"):
        N.knn_join(s, c, 3, KnnOptions(plan="broadcast", broadcast_bytes=64))
    got = N.knn_join(s, c, 3, KnnOptions(broadcast_rows=10))
    assert "MapInArrow" in got._jdf.queryExecution().toString() and rows(got) == brute(seeds, corpus, 3, "cosine")


def test_pivots_prune_copies(spark):
    rng = np.random.default_rng(0)
    corpus = np.repeat(np.eye(8), 50, axis=0) + 0.01 * rng.normal(size=(400, 8))
    sent, original = [], N._routed

    def counting(df, metric, route):
        out = original(df, metric, route)
        sent.append(out.count())
        return out

    N._routed = counting
    try:
        got = N.knn_join(frame(spark, corpus), frame(spark, corpus), 5, KnnOptions(plan="partitioned", seed_block_rows=50))
    finally:
        N._routed = original
    assert rows(got) == brute(corpus, corpus, 5, "cosine")
    assert sent[1] <= 2 * len(corpus)  # 8 seed blocks, yet far from 8 copies of each row


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_kernel_matches_brute_force(data):
    import pyarrow as pa

    n, m, k = (data.draw(st.integers(1, x)) for x in (12, 40, 9))
    grid = st.lists(st.integers(-2, 2), min_size=3, max_size=3)
    seeds = [data.draw(grid) for _ in range(n)]
    corpus = [data.draw(grid) for _ in range(m)]
    column = lambda v: pa.array([[float(x) for x in r] for r in v], pa.list_(pa.float32()))
    for metric in ("l2", "cosine"):
        keep = [i for i, v in enumerate(seeds) if metric == "l2" or any(v)]
        have = [j for j, v in enumerate(corpus) if metric == "l2" or any(v)]
        if not keep or not have:
            continue
        block = kernels.SeedBlock(metric, k, pa.array(keep), column([seeds[i] for i in keep]), False)
        block.best.limit = 5  # cut often
        for start in range(0, len(have), 7):
            part = have[start:start + 7][::-1]
            block.stream(pa.array(part), column([corpus[j] for j in part]))
        got = block.result().to_pandas()
        pairs = set(zip(got.seed_id, got.neighbor_id))
        assert pairs == {r[:2] for r in brute(seeds, corpus, k, metric)}


def token_frame(spark, sets, parts=2):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, tokens array<string>").repartition(parts)


@pytest.mark.parametrize("plan", [dict(plan="broadcast"), dict(plan="partitioned"),
                                  dict(plan="partitioned", seed_block_rows=3, corpus_block_rows=10)])
def test_overlap_with_a_hot_token(spark, plan):
    rng = np.random.default_rng(5)
    make = lambda n: [({"hot"} if rng.random() < 0.5 else set()) | {f"t{t}" for t in rng.integers(12, size=3)} for _ in range(n)]
    seeds, corpus = make(15), make(80) + [{"alone"}, set()]
    got = N.overlap_join(token_frame(spark, seeds), token_frame(spark, corpus), 5, KnnOptions(**plan))
    want = set()
    for i, a in enumerate(seeds):
        scored = sorted((-round(len(a & b) / np.sqrt(len(a) * len(b)), 9), j) for j, b in enumerate(corpus) if a & b)
        want |= {(i, j, r + 1, round(-s, 6)) for r, (s, j) in enumerate(scored[:5])}
    assert rows(got) == want


def test_approximate_join_recall_and_completeness(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 16))
    corpus = centers[rng.integers(6, size=300)] + 0.2 * rng.normal(size=(300, 16))
    c, s = frame(spark, corpus), frame(spark, corpus[:30])
    exact = {r[:2] for r in rows(N.knn_join(s, c, 10))}
    found = rows(N.knn_join_approx(s, c, 10, bucket=0.5, hashes=2))
    assert len(rows(N.knn_join_approx(s, c, 10, bucket=0.5, hashes=2, complete="exact"))) == 300  # nobody is left with fewer than k
    assert len(exact & {r[:2] for r in found}) / len(exact) >= 0.8
    usual = rows(N.knn_join_approx(s, c, 10, complete="exact"))
    assert len(usual) <= 300 and len(exact & {r[:2] for r in usual}) / len(exact) >= 0.8
    wide = rows(N.knn_join_approx(s, c, 10, KnnOptions("l2"), bucket=2.0, hashes=1))
    assert len({r[:2] for r in rows(N.knn_join(s, c, 10, KnnOptions("l2")))} & {r[:2] for r in wide}) >= 240
    with pytest.raises(ValueError):
        N.knn_join_approx(s, c, 10, KnnOptions("l2"))
    narrow = rows(N.knn_join_approx(s, c, 10, bucket=0.001, hashes=4))
    assert {r[:2] for r in narrow} <= {(i, i) for i in range(30)}  # hardly any candidates but a row itself
    narrow = rows(N.knn_join_approx(s, c, 10, bucket=0.001, hashes=4, complete="exact"))
    assert {r[:2] for r in narrow} == exact


def test_plan_cuts_before_the_shuffle_and_embeds_once(spark):
    from kith.operators.embed import HashEmbedder, embed

    text = spark.range(50).select("id", F.concat(F.lit("a: "), F.col("id") % 7).alias("row_as_text"))
    df = embed(text, HashEmbedder(16))
    plan = N.knn_join(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("md5(") == 1


def test_overlap_tile_runs_give_the_same_scores(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    column = lambda n: pa.array([[f"t{t}" for t in set(rng.integers(9, size=4))] for _ in range(n)])
    kernel, seeds, corpus = kernels.Overlap(), column(12), column(50)
    whole = kernel.scores(kernel.seeds(seeds), kernel.load(corpus), 50)
    monkeypatch.setattr(kernels, "TILE_CELLS", 7)
    assert np.array_equal(whole, kernel.scores(kernel.seeds(seeds), kernel.load(corpus), 50))


@pytest.mark.parametrize("plan", PLANS)
def test_l2_is_exact_on_unscaled_numbers(spark, plan):
    """Two groups a million apart: products of such numbers keep no digit of the small distances."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) + 1e6 * (np.arange(400) % 2)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(3)
    got = {(r.seed_id, r.rank): (r.neighbor_id, r.score) for r in N.knn_join(df, df, 10, KnnOptions("l2", **plan)).collect()}
    assert len(got) == 4000
    for i in range(400):
        d = np.round(((x[i] - x) ** 2).sum(1), 9)
        for rank, j in enumerate(np.lexsort((np.arange(400), d))[:10]):
            assert got[i, rank + 1] == (j, d[j])


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_non_finite_vectors_take_no_part(spark, plan, metric):
    rng = np.random.default_rng(6)
    good = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(40, 3)))]
    bad = [(100, [float("nan"), 1.0, 1.0]), (101, [float("inf"), 0.0, 0.0]), (102, [None, 1.0, 1.0])]
    schema = "id long, embedding array<double>"
    options = KnnOptions(metric, **plan)
    clean = spark.createDataFrame(good, schema)
    mixed = spark.createDataFrame(good + bad, schema)
    assert rows(N.knn_join(mixed, mixed, 5, options)) == rows(N.knn_join(clean, clean, 5, options))


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "id long, embedding array<double>")
    want = sorted((r.seed_id, r.rank, r.neighbor_id) for r in N.knn_join(df, df, 3).collect())
    for kind in ("decimal(10,0)", "double"):
        typed = df.withColumn("id", F.col("id").cast(kind))
        got = N.knn_join(typed, typed, 3)
        assert sorted((int(r.seed_id), r.rank, int(r.neighbor_id)) for r in got.collect()) == want
    dated = df.withColumn("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")))
    assert N.knn_join(dated, dated, 3).count() == 36


def test_overlap_opens_common_tokens_only_where_they_matter(spark, monkeypatch):
    """Rows that go through the commonest token, counted: none where rare tokens fill the k best, those of fitting sizes elsewhere."""
    rng = np.random.default_rng(4)
    corpus = [{"all", f"city{i % 60}", f"job{i % 7}"} for i in range(1200)] + [{"all"} | {f"x{j}" for j in rng.integers(400, size=30)} for _ in range(600)]
    seeds = [{"all", f"city{i}", f"job{i % 7}"} for i in range(40)] + [{"all", "city3", "unheard", "of"}, {"all", "odd"}, {"all"}, {"nowhere"}]
    options = KnnOptions(plan="partitioned")
    asked, keyed = [], N._keyed
    monkeypatch.setattr(N, "_keyed", lambda s, c, *a: (asked.append((s, c)), keyed(s, c, *a))[1])
    frames = token_frame(spark, seeds), token_frame(spark, corpus)
    got = rows(N.overlap_join(*frames, 5, options))
    want = set()
    for i, a in enumerate(seeds):
        scored = sorted((-round(len(a & b) / np.sqrt(len(a) * len(b)), 9), j) for j, b in enumerate(corpus) if a & b)
        want |= {(i, j, r + 1, round(-s, 6)) for r, (s, j) in enumerate(scored[:5])}
    assert got == want
    (first_seeds, _), (further_seeds, lifted) = asked
    through = lambda df: df.filter("key = 'all'").count()
    assert through(first_seeds) == 2  # the seeds whose other tokens the corpus lacks
    assert through(further_seeds) + through(first_seeds) < 10 < len(seeds)
    assert through(lifted) <= 1200  # rows of 30 tokens can't be lifted by it
    asked.clear()
    only = token_frame(spark, seeds[:40])
    N.overlap_join(only, frames[1], 5, options).collect()
    assert all(through(s) == 0 for s, _ in asked)


def test_overlap_ignores_repeated_and_null_tokens(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a", None]), (1, ["a", "b"]), (2, [None]), (3, None), (4, ["b", "c", "d", "e"])], "id long, tokens array<string>")
    for plan in ("broadcast", "partitioned"):
        got = rows(N.overlap_join(df.filter("id in (0, 2, 3)"), df, 9, KnnOptions(plan=plan)))
        assert got == {(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 4, 3, round(1 / 8 ** 0.5, 6))}


def test_floors_cut_what_is_merged(spark, monkeypatch):
    """k = 2000: tasks emit what is at or above a sample's k-th best score, not k rows each."""
    rng = np.random.default_rng(6)
    corpus, seeds = rng.normal(size=(24_000, 6)), rng.normal(size=(12, 6))
    c, s = frame(spark, corpus, parts=16), frame(spark, seeds)
    emitted, ranked = [], N._ranked
    monkeypatch.setattr(N, "_ranked", lambda winners, k, **more: (emitted.append(winners.count()), ranked(winners, k, **more))[1])
    plain = rows(N.knn_join(s, c, 2000, KnnOptions(plan="broadcast", floor_share=0)))
    with_floors = rows(N.knn_join(s, c, 2000, KnnOptions(plan="broadcast", floor_share=4, floor_rows=1)))
    assert plain == with_floors and len(plain) == 12 * 2000
    without, sample, kept = emitted
    assert without == 12 * len(corpus) and kept < without / 2


def test_unprunable_corpus_stays_in_place(spark):
    rng = np.random.default_rng(7)
    seeds, corpus = rng.normal(size=(300, 12)), rng.normal(size=(900, 12))
    options = KnnOptions(plan="partitioned", seed_block_rows=64)
    got = N.knn_join(frame(spark, seeds), frame(spark, corpus), 4, options)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == brute(seeds, corpus, 4, "cosine")
    assert "hashpartitioning(block" not in text
    moved = N.knn_join(frame(spark, seeds), frame(spark, corpus), 4, KnnOptions(plan="partitioned", seed_block_rows=64, corpus="moved"))
    text = moved._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in text


def test_a_single_file_is_compared_by_all_cores(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(1500, 12))
    df = frame(spark, m, parts=1)
    got = N.knn_join(df, df, 4, KnnOptions(plan="partitioned"))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(block" not in text
    assert rows(got) == brute(m, m, 4, "cosine")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("floor_share", [1, 32])
def test_both_sides_in_blocks_give_the_same_rows(spark, clustered, metric, floor_share):
    """Blocks of the corpus past the seeds, or of seeds past the corpus: 3 blocks here, so a share of 1 takes the seeds'."""
    corpus, seeds = clustered
    options = KnnOptions(metric, plan="partitioned", corpus="in_place", running_rows=70, floor_share=floor_share, floor_rows=1)
    got = N.knn_join(frame(spark, seeds), frame(spark, corpus), 6, options)
    assert rows(got) == brute(seeds, corpus, 6, metric)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("text", [False, True])
def test_seeds_go_from_pass_to_pass_with_their_best(spark, monkeypatch, metric, own, text):
    """Only k rows for each seed are merged, however many blocks the corpus has; copies tie across blocks, and the first blocks hold fewer than k rows."""
    rng = np.random.default_rng(12)
    m = rng.normal(size=(180, 5))
    m[::4] = m[8]
    ids = [f"r{i:03}" for i in range(180)] if text else range(180)
    df, merged, ranked = frame(spark, m, ids), [], N._ranked
    monkeypatch.setattr(N, "_ranked", lambda winners, *a, **b: (merged.append(winners.count()), ranked(winners, *a, **b))[1])
    options = KnnOptions(metric, plan="partitioned", corpus="in_place", exclude_self=own, running_rows=70)
    got = N.knn_join(df, df, 70, options)
    assert rows(got) == brute(m, m, 70, metric, own, ids, ids) and merged == [180 * 70]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_single_precision_only_rules_out(metric, exclude_self, monkeypatch):
    """Rows that single precision can't tell apart, copies, and far ones; few pairs are scored in double precision."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    m = rng.normal(size=(6000, 16))
    m[:900] = m[0] + 1e-8 * rng.normal(size=(900, 16))
    m[1000:1400] = m[1000]
    kernel, scored = kernels.KERNELS[metric], []
    for name, size in (("pair_scores", lambda a: len(a[3])), ("scores", lambda a: len(a[2]) * len(a[1] if metric == "cosine" else a[1][0]))):
        plain = getattr(kernel, name)
        monkeypatch.setattr(kernel, name, lambda *a, plain=plain, size=size: (scored.append(size(a)), plain(*a))[1])
    order = rng.permutation(6000)
    column = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    ids = np.concatenate([[0, 5, 1000, 1200], np.arange(1400, 2200)])
    block = kernels.SeedBlock(metric, 7, pa.array(ids), column(m[ids]), exclude_self)
    for at in range(0, 6000, 3000):
        block.stream(pa.array(order[at:at + 3000]), column(m[order[at:at + 3000]]))
    got = block.result().to_pandas()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in ids:
        score = np.round(unit @ unit[i], 9) if metric == "cosine" else -np.round(((m - m[i]) ** 2).sum(1), 9)
        if exclude_self:
            score[i] = -np.inf
        assert got[got.seed_id == i].neighbor_id.tolist() == np.lexsort((np.arange(6000), -score))[:7].tolist()
    assert sum(scored) < len(ids) * 6000 / 4


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("own", [False, True])
def test_rows_met_more_often_than_there_are_pairs_go_past_each_other_once(spark, monkeypatch, metric, own):
    r = np.random.default_rng(5)
    m = r.normal(size=(3000, 6))
    m[::7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    s, c = df.filter("id % 11 = 0"), df.filter("id % 13 <> 0")
    asked, keyed = [], N._keyed
    monkeypatch.setattr(N, "_keyed", lambda *a: (asked.append(1), keyed(*a))[1])
    options = KnnOptions(metric, exclude_self=own, broadcast_bytes=1000 * 8 * (6 + 4))
    width = 1.0 if metric == "cosine" else 3.0
    got = rows(N.knn_join_approx(s, c, 9, options, tables=4, hashes=1, bucket=width))
    assert not asked
    by_key = lambda s, c, n_seeds, n_rows, width, k, opt: N._merged(keyed(
        *(side.select(F.explode("keys").alias("key"), "id", "vec") for side in (s, c)), k, opt.metric, opt), k)
    monkeypatch.setattr(N, "_met_under_keys", by_key)
    assert got == rows(N.knn_join_approx(s, c, 9, options, tables=4, hashes=1, bucket=width)) and len(got) == 9 * s.count()


def test_tables_share_no_keys():
    points = np.stack(np.meshgrid(np.arange(-6.0, 7), np.arange(-6.0, 7)), -1).reshape(-1, 2)
    keys = kernels.bucket_keys(points, np.tile(np.eye(2), 8), 8)  # a row has the same numbers in every table
    assert len(np.unique(keys)) == keys.size


def test_token_overlap_holds_small_tiles():
    import tracemalloc

    import pyarrow as pa

    token = lambda n, a: pa.array([[f"a{i % 5}", f"b{i % a}", f"c{i % 7}"] for i in range(n)])
    block = kernels.SeedBlock("overlap", 20, pa.array(range(4096)), token(4096, 25), False)
    ids, vectors = pa.array(range(5000)), token(5000, 25)
    tracemalloc.start()
    block.stream(ids, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(block.result()) == 4096 * 20 and peak < 120 << 20
