"""Queries on voting and on the quality of its predictions, over every row of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from kith.operators import evaluate as E
from kith.operators import knn as N
from kith.operators import sets, vote
from kith.options import KnnOptions
from kith.plans.registry import query, table
from kith.plans.retrieval import K_VECTORS, vector_pairs, vectors

CLASSES = list(range(10))
LEAVE_ONE_OUT = KnnOptions(exclude_self=True)


def labelled(spark, sf, options=KnnOptions()):
    v = vectors(spark, sf)
    return sets.attach_label(N.knn_join(v, v, K_VECTORS, options), v, "id", "label")


def judged(spark, sf):
    """Each vector's label and the vote of its neighbours, itself left out."""
    votes = vote.vote(labelled(spark, sf, LEAVE_ONE_OUT)).withColumnRenamed("seed_id", "id")
    return sets.join_truth(votes, vectors(spark, sf).select("id", "label"), "id")


def _votes(where=""):
    return f"""{vector_pairs(where=where)},
  v AS (SELECT seed_id, label, count(*) AS n, min(rank) AS nearest FROM p WHERE rank <= {K_VECTORS} GROUP BY 1, 2),
  w AS (SELECT seed_id, label AS predicted FROM (SELECT *, row_number() OVER (
          PARTITION BY seed_id ORDER BY n DESC, nearest) AS o FROM v) WHERE o = 1)"""


JUDGED = f"""{_votes('WHERE s.vec_id <> c.vec_id')},
  j AS (SELECT vec_id AS id, label, predicted FROM embeddings JOIN w ON vec_id = seed_id)"""


def _scores_sql(counts):
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0.0 END AS f1
      FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM ({counts}))"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _rounded_sql(scores, lead):
    return f"SELECT {lead}, round(precision, 6) AS precision, round(recall, 6) AS recall, f1 FROM ({scores})"


@query(f"WITH {_votes()} SELECT seed_id, predicted FROM w")
def knn_majority_vote(spark, sf):
    return vote.vote(labelled(spark, sf))


@query(f"""WITH {vector_pairs()} SELECT s.label AS seed_label, p.label AS label, count(DISTINCT neighbor_id) AS n
           FROM p JOIN embeddings s ON s.vec_id = seed_id WHERE rank <= {K_VECTORS} GROUP BY 1, 2""")
def neighbor_label_histogram(spark, sf):
    own = vectors(spark, sf).select(F.col("id").alias("seed_id"), F.col("label").alias("seed_label"))
    return vote.label_histogram(labelled(spark, sf).join(own, "seed_id"), "seed_label")


@query(f"WITH {vector_pairs()} SELECT seed_id, neighbor_id, rank, label FROM p WHERE rank <= {K_VECTORS}")
def join_neighbor_label(spark, sf):
    return labelled(spark, sf).select("seed_id", "neighbor_id", "rank", "label")


@query(f"WITH {JUDGED} SELECT id, label, predicted FROM j")
def join_truth_inner(spark, sf):
    return judged(spark, sf)


@query(f"""WITH {JUDGED} SELECT id, predicted, quality FROM j LEFT JOIN labels ON doc_id = id""")
def join_truth_left(spark, sf):
    votes = vote.vote(labelled(spark, sf, LEAVE_ONE_OUT)).withColumnRenamed("seed_id", "id")
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return sets.join_truth(votes, truth, "id", "left")


@query(f"""WITH {JUDGED}, a AS (SELECT count(*) FILTER (label = predicted) AS matched,
             count(*) FILTER (label <> predicted) AS unmatched FROM j)
           SELECT *, round(matched / (matched + unmatched) * 100, 6) AS pct_matched,
             round(unmatched / (matched + unmatched) * 100, 6) AS pct_unmatched FROM a""")
def eval_accuracy(spark, sf):
    return E.accuracy(judged(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("pct_matched", "pct_unmatched")})


@query(f"""WITH {JUDGED} {_rounded_sql(_scores_sql('''SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tp,
             count(*) FILTER (label <> 0 AND predicted = 0) AS fp, count(*) FILTER (label <> 0 AND predicted <> 0) AS tn,
             count(*) FILTER (label = 0 AND predicted <> 0) AS fn FROM j'''), 'tp, fp, tn, fn')}""")
def eval_binary_metrics(spark, sf):
    return _rounded(E.binary_metrics(judged(spark, sf), positive=0))


@query(f"""WITH {JUDGED} {_rounded_sql(_scores_sql('''SELECT c.class, count(*) FILTER (label = c.class AND predicted = c.class) AS tp,
             count(*) FILTER (label <> c.class AND predicted = c.class) AS fp,
             count(*) FILTER (label = c.class AND predicted <> c.class) AS fn
             FROM j CROSS JOIN (SELECT unnest(range(10)) AS class) c GROUP BY 1'''), 'class, tp, fp, fn')}""")
def eval_multiclass_metrics(spark, sf):
    return _rounded(E.multiclass_metrics(judged(spark, sf), CLASSES))


@query(f"""WITH {JUDGED} SELECT t.c AS truth, q.c AS predicted, count(j.id) AS n
           FROM (SELECT unnest(range(10)) AS c) t CROSS JOIN (SELECT unnest(range(10)) AS c) q
           LEFT JOIN j ON label = t.c AND predicted = q.c GROUP BY 1, 2""")
def eval_confusion_matrix(spark, sf):
    return E.confusion(judged(spark, sf), CLASSES)


@query(f"""WITH {JUDGED} SELECT 'predicted' AS side, predicted AS class, count(*) AS n FROM j GROUP BY 2
           UNION ALL SELECT 'truth', label, count(*) FROM j GROUP BY 2""")
def eval_class_counts(spark, sf):
    return E.class_counts(judged(spark, sf))
