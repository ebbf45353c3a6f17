"""Queries on embedding, similarity joins, rerank and audiences.

Two settings are used. *Vectors*: every row of ``embeddings`` is a seed and the whole table is the
corpus. *Parties*: all suppliers are seeds and all customers the corpus, both as row text over
region, nation and balance bucket, embedded by hashing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kith import functions as K
from kith.operators import audience as A
from kith.operators import flows
from kith.operators import knn as N
from kith.operators import rerank as R
from kith.operators import shape, vote
from kith.operators.cells import append_cells, knn_join_cells, read_cells, write_cells
from kith.operators.embed import HashEmbedder, TokenJaccard, embed
from kith.operators.graph import knn_join_graph, read_graph, write_graph
from kith.operators.index import ROUNDS, build_index, project_2d
from kith.operators.sets import attach_label
from kith.options import KnnOptions
from kith.plans.registry import query, table
from kith.sources import new_folder

K_VECTORS, K_PARTIES, DIM = 20, 50, 64


# -- shared inputs ----------------------------------------------------------------------------

def vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def _party(spark, sf, name, prefix, id_col, *extra):
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf, name).select(
        F.col(id_col).alias("id"), F.col(f"{prefix}_nationkey").alias("nation"),
        K.bucket_label(F.col(f"{prefix}_acctbal"), 1000).alias("balance"), *extra)
    return shape.row_as_text(rows.join(nation, "nation"), ["region", "nation", "balance"])


def seeds(spark, sf):
    return _party(spark, sf, "supplier", "s", "s_suppkey")


def corpus(spark, sf):
    return _party(spark, sf, "customer", "c", "c_custkey", F.col("c_mktsegment").alias("segment"),
                  F.col("c_acctbal").alias("amount"))


def embedded(df):
    return embed(df, HashEmbedder(DIM))


def parties_knn(spark, sf, k=K_PARTIES, options=KnnOptions()):
    return N.knn_join(embedded(seeds(spark, sf)), embedded(corpus(spark, sf)), k, options)


def tokens(df):
    return df.withColumn("tokens", K.token_pairs(F.col("row_as_text")))


def scored_pairs(spark, sf):
    s, c = seeds(spark, sf), corpus(spark, sf)
    knn = N.knn_join(embedded(s), embedded(c), K_PARTIES)
    return R.rescore(R.with_texts(knn, s, c), TokenJaccard())


# -- shared SQL -------------------------------------------------------------------------------

def vector_pairs(metric="cosine", where="", seed="embeddings", seed_key="vec_id"):
    """SQL: every seed's corpus rows with score and rank as ``p(seed_id, neighbor_id, score, rank)``."""
    a, b = "s.embedding::DOUBLE[]", "c.embedding::DOUBLE[]"
    score, order = {
        "cosine": (f"round(list_cosine_similarity({a}, {b}), 9)", "DESC"),
        "l2": (f"round(pow(list_distance({a}, {b}), 2), 9)", "ASC"),
    }[metric]
    return f"""p AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score {order}, neighbor_id) AS INTEGER) AS rank
      FROM (SELECT s.{seed_key} AS seed_id, c.vec_id AS neighbor_id, c.label AS label, {score} AS score
            FROM {seed} s, embeddings c {where}))"""


def _bucket_sql(col):
    return (f"CASE WHEN {col} < 1000 THEN 'Under 1k' ELSE CAST(floor({col} / 1000) AS BIGINT) || 'k - ' || "
            f"CAST(floor({col} / 1000) + 1 AS BIGINT) || 'k' END")


def party_sql(name, prefix, id_col, extra=""):
    return f"""SELECT {id_col} AS id, 'region: ' || n_regionkey || '; nation: ' || {prefix}_nationkey || '; balance: '
      || {_bucket_sql(prefix + '_acctbal')} AS txt{extra} FROM {name} JOIN nation ON n_nationkey = {prefix}_nationkey"""


PARTIES = f"""s AS ({party_sql('supplier', 's', 's_suppkey')}),
  c AS ({party_sql('customer', 'c', 'c_custkey', ", c_mktsegment AS segment, c_acctbal AS amount, "
                    + _bucket_sql('c_acctbal') + " AS balance")}),
  st AS (SELECT id, unnest(string_split(txt, '; ')) AS t FROM s),
  ct AS (SELECT id, unnest(string_split(txt, '; ')) AS t FROM c)"""


def _hashed(tokens_from, name):
    return f"""{name} AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS b, count(*) AS n FROM {tokens_from} GROUP BY 1, 2),
  {name}_len AS (SELECT id, sqrt(sum(n * n)) AS len FROM {name} GROUP BY 1)"""


def party_pairs(k=K_PARTIES, seed_tokens="st", parties=PARTIES):
    """SQL: the k nearest customers of each supplier as ``p(seed_id, neighbor_id, score, rank)``."""
    return f"""{parties}, {_hashed(seed_tokens, 'sh')}, {_hashed('ct', 'ch')},
  dot AS (SELECT sh.id AS s_id, ch.id AS c_id, sum(sh.n * ch.n) AS d FROM sh JOIN ch USING (b) GROUP BY 1, 2),
  sim AS (SELECT sl.id AS seed_id, cl.id AS neighbor_id, round(coalesce(d, 0) / (sl.len * cl.len), 9) AS score
          FROM sh_len sl CROSS JOIN ch_len cl LEFT JOIN dot ON s_id = sl.id AND c_id = cl.id),
  p AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank
        FROM sim) WHERE rank <= {k})"""


def scored_sql(parties=PARTIES):
    """SQL: party pairs with the share of equal row text pairs as ``q``."""
    return f"""{party_pairs(parties=parties)},
  inter AS (SELECT seed_id, neighbor_id, count(*) AS i FROM p JOIN st ON st.id = seed_id
            JOIN ct ON ct.id = neighbor_id AND ct.t = st.t GROUP BY 1, 2),
  q AS (SELECT p.*, s.txt AS seed_text, c.txt AS neighbor_text, c.segment,
          round(coalesce(i, 0)::DOUBLE / (6 - coalesce(i, 0)), 9) AS pair_score
        FROM p JOIN s ON s.id = seed_id JOIN c ON c.id = neighbor_id LEFT JOIN inter USING (seed_id, neighbor_id))"""


def shown(df):
    return df.withColumn("score", F.round("score", 6))


PAIR_COLUMNS = "seed_id, neighbor_id, rank, round(score, 6) AS score"


# -- similarity joins -------------------------------------------------------------------------

KNN_COSINE = f"WITH {vector_pairs()} SELECT {PAIR_COLUMNS} FROM p WHERE rank <= {K_VECTORS}"


@query(KNN_COSINE)
def knn_cosine_topk(spark, sf):
    v = vectors(spark, sf)
    return shown(N.knn_join(v, v, K_VECTORS))


@query(KNN_COSINE)
def knn_cosine_topk_partitioned(spark, sf):
    v = vectors(spark, sf)
    return shown(N.knn_join(v, v, K_VECTORS, KnnOptions(plan="partitioned", seed_block_rows=256)))


@query(KNN_COSINE)
def knn_cosine_topk_cells(spark, sf):
    v, path = vectors(spark, sf), new_folder(spark, "cells")
    write_cells(v, path, cells=32)
    return shown(knn_join_cells(v, read_cells(spark, path), K_VECTORS))


@query(KNN_COSINE)
def idx_cells_append(spark, sf):
    """An index stored by cell that grows by two loads, one of them sent twice, and splits its cells."""
    v, path = vectors(spark, sf), new_folder(spark, "cells")
    write_cells(v.filter("id % 3 = 0"), path, cells=4)
    for load in (1, 2, 1):
        append_cells(v.filter(F.col("id") % 3 == load), path, f"load-{load}", max_rows=200)
    return shown(knn_join_cells(v, read_cells(spark, path), K_VECTORS))


@query(f"WITH {vector_pairs('l2')} SELECT {PAIR_COLUMNS} FROM p WHERE rank <= {K_VECTORS}")
def knn_l2_topk(spark, sf):
    v = vectors(spark, sf)
    return shown(N.knn_join(v, v, K_VECTORS, KnnOptions(metric="l2")))


LSH = f"""WITH planes AS (
      SELECT j, list(v ORDER BY i) AS p, sqrt(sum(v * v)) AS norm FROM (
        SELECT j, i, (('0x' || substr(md5('42:' || j || ':' || i), 1, 8))::BIGINT % 2001 - 1000)::DOUBLE AS v
        FROM (SELECT unnest(range(16)) AS j), (SELECT unnest(range(max(len(embedding)))) AS i FROM embeddings)) GROUP BY j),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(v, v)) AS len FROM embeddings),
    codes AS (SELECT vec_id, j // 2 AS t, list(floor(list_dot_product(v, p) / (len * norm * 0.5)) ORDER BY j) AS code FROM e, planes GROUP BY 1, 2),
    met AS (SELECT DISTINCT a.vec_id AS seed_id, b.vec_id AS neighbor_id FROM codes a JOIN codes b ON a.t = b.t AND a.code = b.code),
    s AS (SELECT seed_id, neighbor_id, round(list_cosine_similarity(a.v, b.v), 9) AS score
      FROM met JOIN e a ON a.vec_id = seed_id JOIN e b ON b.vec_id = neighbor_id),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM s)
    SELECT {PAIR_COLUMNS} FROM p WHERE rank <= {K_VECTORS}"""


@query(LSH)
def knn_lsh_topk(spark, sf):
    v = vectors(spark, sf)
    # these vectors are spread evenly, so near and far rows differ little: wide buckets
    return shown(N.knn_join_approx(v, v, K_VECTORS, hashes=2, bucket=0.5))


def _by_graph(seeds_, index, spark, k):
    path = new_folder(spark, "graph")
    write_graph(index, path)
    return knn_join_graph(seeds_, read_graph(spark, path), k)


@query()
def knn_graph_topk(spark, sf):
    """Nearly ``knn_cosine_topk``: a test holds the share found at 0.9 or more."""
    v = vectors(spark, sf)
    return shown(_by_graph(v, v, spark, K_VECTORS))


@query(f"WITH {party_pairs()} SELECT seed_id, rank, round(score, 6) AS score FROM p")
def knn_graph_parties(spark, sf):
    """Row texts have few distinct vectors, of which the walk misses none that is nearer; which of equally near rows come last is left open."""
    found = _by_graph(embedded(seeds(spark, sf)), embedded(corpus(spark, sf)), spark, K_PARTIES)
    return shown(found).select("seed_id", "rank", "score")


@query(f"""WITH g AS (SELECT label, list(m ORDER BY i) AS embedding FROM (
             SELECT label, i, avg(x::DOUBLE) AS m FROM (
               SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)
             GROUP BY 1, 2) GROUP BY 1),
           {vector_pairs(seed='g', seed_key='label')} SELECT {PAIR_COLUMNS} FROM p WHERE rank <= {K_VECTORS}""")
def knn_pooled_centroid(spark, sf):
    v = vectors(spark, sf)
    return shown(A.knn_pooled(v.select("label", "embedding"), v, K_VECTORS, "label"))


@query(f"""WITH {party_pairs(K_VECTORS, 'pt').replace('ct AS (', 'pt AS (SELECT id // 500 AS id, t FROM st), ct AS (', 1)}
           SELECT {PAIR_COLUMNS} FROM p""")
def knn_pooled_text(spark, sf):
    pooled = embedded(A.pooled_texts(seeds(spark, sf), "id"))
    return shown(N.knn_join(pooled, embedded(corpus(spark, sf)), K_VECTORS, seed_id="batch"))


OVERLAP = f"""WITH {PARTIES}, o AS (SELECT st.id AS seed_id, ct.id AS neighbor_id, round(count(*) / sqrt(3.0 * 3.0), 9) AS score
             FROM st JOIN ct USING (t) GROUP BY 1, 2)
           SELECT {PAIR_COLUMNS} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, neighbor_id)
             AS INTEGER) AS rank FROM o) WHERE rank <= {K_VECTORS}"""


@query(OVERLAP)
def overlap_topk(spark, sf):
    return shown(N.overlap_join(tokens(seeds(spark, sf)), tokens(corpus(spark, sf)), K_VECTORS))


@query(OVERLAP)
def overlap_topk_keyed(spark, sf):
    options = KnnOptions(plan="partitioned", seed_block_rows=64, corpus_block_rows=4096)
    return shown(N.overlap_join(tokens(seeds(spark, sf)), tokens(corpus(spark, sf)), K_VECTORS, options))


# -- embedding --------------------------------------------------------------------------------

@query(f"""WITH {PARTIES}, h AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS b FROM ct),
           f AS (SELECT c.id, g.b, (SELECT count(*) FROM h WHERE h.id = c.id AND h.b = g.b) AS n
                 FROM c CROSS JOIN (SELECT unnest(range({DIM})) AS b) g)
           SELECT id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY b) AS vector FROM f GROUP BY 1""")
def embed_hash(spark, sf):
    digits = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return embedded(corpus(spark, sf)).select("id", digits.alias("vector"))


def _project_sql(rounds=ROUNDS):
    """The covariance by cells and the rounds of the iteration one by one."""
    product = lambda v: f"list(list_dot_product(c.row, {v}) ORDER BY c.i)"
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
    ctes = ["x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)",
            "m AS (SELECT i, avg(v) AS m FROM x GROUP BY i)",
            """cov AS (SELECT a.i, b.i AS j, avg(a.v * b.v) - any_value(ma.m) * any_value(mb.m) AS c
                FROM x a JOIN x b USING (vec_id) JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY 1, 2)""",
            "c AS MATERIALIZED (SELECT i, list(c ORDER BY j) AS row FROM cov GROUP BY i)",
            "r0 AS (SELECT list(cos(i + 1) ORDER BY i) AS a, list(cos(2 * (i + 1)) ORDER BY i) AS b FROM m)"]
    for r in range(rounds):
        ctes.append(f"p{r} AS (SELECT {product('a')} AS a, {product('b')} AS b FROM c, r{r})")
        ctes.append(f"q{r} AS (SELECT {unit('a')} AS a, b FROM p{r})")
        ctes.append(f"o{r} AS (SELECT a, list_transform(list_zip(a, b), lambda z: z[2] - list_dot_product(a, b) * z[1]) AS b FROM q{r})")
        ctes.append(f"r{r + 1} AS MATERIALIZED (SELECT a, {unit('b')} AS b FROM o{r})")
    sign = lambda v: f"(CASE WHEN list_sum(list_transform({v}, lambda x: x * x * x)) >= 0 THEN 1 ELSE -1 END)"
    return f"""WITH {', '.join(ctes)}
      SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, round({sign('a')} * list_dot_product(embedding::DOUBLE[], a), 6) AS x,
        round({sign('b')} * list_dot_product(embedding::DOUBLE[], b), 6) AS y FROM embeddings, r{rounds}"""


@query(_project_sql())
def embed_project_2d(spark, sf):
    rows = vectors(spark, sf).withColumn("metadata", K.metadata_map(["label"]))
    return project_2d(rows, "label").withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


# -- rerank -----------------------------------------------------------------------------------

@query(f"WITH {scored_sql()} SELECT seed_id, neighbor_id, rank, round(pair_score, 6) AS pair_score FROM q")
def rescore_pairs(spark, sf):
    return scored_pairs(spark, sf).select("seed_id", "neighbor_id", "rank", F.round("pair_score", 6).alias("pair_score"))


@query(f"""WITH {scored_sql()} SELECT DISTINCT neighbor_text, round(pair_score, 6) AS score FROM (
             SELECT neighbor_text, pair_score, row_number() OVER (PARTITION BY seed_id ORDER BY pair_score DESC, neighbor_text) AS r
             FROM (SELECT DISTINCT seed_id, neighbor_text, pair_score FROM q)) WHERE r <= {R.rerank_depth(K_PARTIES)}""")
def rerank_top_m(spark, sf):
    return shown(R.rerank(scored_pairs(spark, sf), R.rerank_depth(K_PARTIES), ["neighbor_text"]))


@query(f"""WITH {scored_sql()}, r AS (SELECT neighbor_id, pair_score AS score, min(seed_id) AS pos FROM q GROUP BY 1, 2)
           SELECT neighbor_id, round(score, 6) AS score FROM r WHERE (SELECT count(*) FROM r o WHERE o.pos <= r.pos
             AND (o.score > r.score OR (o.score = r.score AND o.neighbor_id < r.neighbor_id))) < {R.rerank_depth(K_PARTIES)}""")
def rerank_prefix(spark, sf):
    return shown(R.rerank(scored_pairs(spark, sf), R.rerank_depth(K_PARTIES), mode="prefix"))


# -- audiences --------------------------------------------------------------------------------

@query(f"""WITH {party_pairs()} SELECT id, txt AS row_as_text FROM c WHERE id IN (SELECT neighbor_id FROM p)""")
def lookalike_audience(spark, sf):
    return A.lookalike(embedded(seeds(spark, sf)), embedded(corpus(spark, sf)), K_PARTIES, ["id", "row_as_text"])


@query(f"""WITH {party_pairs()} SELECT seed_id, neighbor_id, rank, round(score, 6) AS score, txt AS row_as_text, segment
           FROM p JOIN c ON c.id = neighbor_id""")
def lookalike_with_metadata(spark, sf):
    knn = parties_knn(spark, sf)
    return shown(A.with_neighbor_fields(knn, corpus(spark, sf), ["row_as_text", "segment"]))


@query(f"""WITH {party_pairs()} SELECT id, balance FROM c WHERE id IN (SELECT neighbor_id FROM p)""")
def lookalike_with_label(spark, sf):
    return A.lookalike(embedded(seeds(spark, sf)), embedded(corpus(spark, sf)), K_PARTIES, ["id", "balance"])


@query(f"""WITH {vector_pairs()}, m AS (SELECT seed_id, max(label) AS predicted FROM p WHERE rank <= 5 GROUP BY 1)
           SELECT vec_id AS id, label, predicted FROM embeddings JOIN m ON vec_id = seed_id""")
def propagate_max_label(spark, sf):
    v = vectors(spark, sf)
    labelled = attach_label(N.knn_join(v, v, 5), v, "id", "label")
    return A.propagate_max(v.select("id", "label"), labelled)


@query(f"""WITH {party_pairs()} SELECT neighbor_id, round(max(score), 6) AS best_score,
             round(CAST(sum(CAST(score AS DECIMAL(28, 9))) AS DOUBLE) / count(*), 6) AS mean_score, count(*) AS n_seeds
           FROM p GROUP BY 1""")
def audience_score(spark, sf):
    scores = A.audience_score(parties_knn(spark, sf))
    return scores.withColumns({c: F.round(c, 6) for c in ("best_score", "mean_score")})


@query(f"""WITH {party_pairs()} SELECT balance, count(*) AS n,
             round(CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) / count(amount), 4) AS mean_amount,
             CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total_amount
           FROM c WHERE id IN (SELECT neighbor_id FROM p) GROUP BY 1""")
def bucket_budget(spark, sf):
    members = A.lookalike(embedded(seeds(spark, sf)), embedded(corpus(spark, sf)), K_PARTIES, ["id", "balance", "amount"])
    return A.bucket_budget(members, "balance", "amount").withColumn("mean_amount", F.round("mean_amount", 4))


@query(f"""WITH {scored_sql()}, b AS (SELECT * FROM (SELECT seed_id, segment, row_number() OVER (
               PARTITION BY seed_id ORDER BY pair_score DESC, neighbor_id) AS r FROM q) WHERE r <= {R.rerank_depth(K_PARTIES, 0)}),
           v AS (SELECT seed_id, segment, count(*) AS n, min(r) AS nearest FROM b GROUP BY 1, 2)
           SELECT seed_id, segment AS predicted FROM (SELECT *, row_number() OVER (
             PARTITION BY seed_id ORDER BY n DESC, nearest) AS o FROM v) WHERE o = 1""")
def knn_reranked_vote(spark, sf):
    labelled = attach_label(scored_pairs(spark, sf), corpus(spark, sf), "id", "segment")
    return vote.vote_reranked(labelled, R.rerank_depth(K_PARTIES, at_least=0))


# -- whole flows: a table becomes a stored index, another one is matched against it -------------

FEATURES = ["region", "nation", "balance"]


def stored(spark, sf):
    return build_index(corpus(spark, sf).withColumn("rich", (F.col("amount") >= 9000).cast("int")),
                       new_folder(spark, "index"), "id", features=FEATURES, meta_cols=["id", "segment", "rich"],
                       embedder=HashEmbedder(DIM))


FIELDS = ", ".join(f"split_part(split_part(txt, '{f}: ', 2), '; ', 1) AS {f}" for f in FEATURES)


@query(f"""WITH {party_pairs()} SELECT DISTINCT {FIELDS}, CAST(id AS VARCHAR) AS id, segment
           FROM c WHERE id IN (SELECT neighbor_id FROM p)""")
def flow_audience(spark, sf):
    return flows.find_audience(seeds(spark, sf), stored(spark, sf), FEATURES, K_PARTIES, ["id", "segment"])


@query(f"""WITH {party_pairs()} SELECT DISTINCT {FIELDS}, CAST(id AS VARCHAR) AS id, segment
           FROM c WHERE id IN (SELECT neighbor_id FROM p)""")
def flow_audience_cells(spark, sf):
    """The same audience from an index stored by cell."""
    path = new_folder(spark, "cells")
    write_cells(stored(spark, sf), path, cells=16)
    return flows.find_audience(seeds(spark, sf), read_cells(spark, path), FEATURES, K_PARTIES, ["id", "segment"])


@query(f"""WITH {scored_sql()}, b AS (SELECT DISTINCT neighbor_text AS txt, pair_score FROM (
             SELECT neighbor_text, pair_score, row_number() OVER (PARTITION BY seed_text ORDER BY pair_score DESC, neighbor_text) AS r
             FROM (SELECT DISTINCT seed_text, neighbor_text, pair_score FROM q)) WHERE r <= {R.rerank_depth(K_PARTIES)})
           SELECT {FIELDS}, round(pair_score, 6) AS score FROM b""")
def flow_reranked(spark, sf):
    return shown(flows.find_reranked(seeds(spark, sf), stored(spark, sf), FEATURES, K_PARTIES, TokenJaccard()))


@query(f"""WITH {party_pairs()}, v AS (SELECT seed_id, segment, count(*) AS n, min(rank) AS nearest
             FROM p JOIN c ON c.id = neighbor_id GROUP BY 1, 2)
           SELECT seed_id AS id, segment AS predicted FROM (SELECT *, row_number() OVER (
             PARTITION BY seed_id ORDER BY n DESC, nearest) AS o FROM v) WHERE o = 1""")
def flow_classify(spark, sf):
    got = flows.classify(seeds(spark, sf), stored(spark, sf), FEATURES, K_PARTIES, "segment")
    return got.select("id", "predicted")


@query(f"""WITH {party_pairs()} SELECT seed_id AS id, max(CAST(amount >= 9000 AS INTEGER)) AS predicted
           FROM p JOIN c ON c.id = neighbor_id GROUP BY 1""")
def flow_spread_label(spark, sf):
    got = flows.spread_label(seeds(spark, sf), stored(spark, sf), FEATURES, K_PARTIES, "rich")
    return got.select("id", "predicted")
