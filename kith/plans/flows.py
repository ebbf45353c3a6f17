"""Queries on whole flows: hold-out evaluation, per-class validation, file to file, and a single record."""

from __future__ import annotations

from pyspark.sql import functions as F

from kith.operators import evaluate as E
from kith.operators import flows
from kith.operators.embed import HashEmbedder, TokenJaccard
from kith.operators.rerank import rerank_depth
from kith.plans.evaluation import _rounded, _rounded_sql, _scores_sql
from kith.plans.registry import query
from kith.plans.retrieval import DIM, FEATURES, FIELDS, K_PARTIES, PARTIES, corpus, party_pairs, party_sql, scored_sql, seeds, shown, stored
from kith.sources import new_folder, read_table, write_csv

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def held_out(spark, sf):
    """A fifth of the customers, classified by the segments of the others."""
    return flows.evaluate_holdout(corpus(spark, sf), new_folder(spark, "index"), "id", FEATURES, "segment", K_PARTIES,
                                  TokenJaccard(), embedder=HashEmbedder(DIM))


def _slot(column):
    return f"('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8))::BIGINT % 100"


_HALVES = f"""every AS (SELECT *, {_slot('id')} AS slot FROM ({party_sql('customer', 'c', 'c_custkey', ', c_mktsegment AS segment')})),
  s AS (SELECT * FROM every WHERE slot >= 80), c AS (SELECT * FROM every WHERE slot < 80),
  st AS (SELECT id, unnest(string_split(txt, '; ')) AS t FROM s),
  ct AS (SELECT id, unnest(string_split(txt, '; ')) AS t FROM c)"""

HELD_OUT = f"""{scored_sql(_HALVES)},
  b AS (SELECT * FROM (SELECT seed_id, segment, row_number() OVER (
          PARTITION BY seed_id ORDER BY pair_score DESC, neighbor_id) AS r FROM q) WHERE r <= {rerank_depth(K_PARTIES, 1)}),
  v AS (SELECT seed_id, segment, count(*) AS n, min(r) AS nearest FROM b GROUP BY 1, 2),
  j AS (SELECT s.id, s.segment AS label, w.segment AS predicted FROM s JOIN (SELECT *, row_number() OVER (
          PARTITION BY seed_id ORDER BY n DESC, nearest) AS o FROM v) w ON w.seed_id = s.id AND o = 1)"""

_CLASSES = f"(SELECT unnest({SEGMENTS!r}) AS class)"


@query(f"""WITH {HELD_OUT} {_rounded_sql(_scores_sql(f'''SELECT c.class, count(*) FILTER (label = c.class AND predicted = c.class) AS tp,
             count(*) FILTER (label <> c.class AND predicted = c.class) AS fp,
             count(*) FILTER (label = c.class AND predicted <> c.class) AS fn FROM j CROSS JOIN {_CLASSES} c GROUP BY 1'''),
             'class, tp, fp, fn')}""")
def flow_evaluate_holdout(spark, sf):
    return _rounded(E.multiclass_metrics(held_out(spark, sf), SEGMENTS))


@query(f"""WITH {HELD_OUT}, a AS (SELECT count(*) FILTER (label = predicted) AS matched,
             count(*) FILTER (label <> predicted) AS unmatched FROM j)
           SELECT *, round(matched / (matched + unmatched) * 100, 6) AS pct_matched,
             round(unmatched / (matched + unmatched) * 100, 6) AS pct_unmatched FROM a""")
def flow_holdout_accuracy(spark, sf):
    return E.accuracy(held_out(spark, sf)).withColumns({c: F.round(c, 6) for c in ("pct_matched", "pct_unmatched")})


@query(f"""WITH {HELD_OUT} SELECT t.class AS truth, q.class AS predicted, count(j.id) AS n FROM {_CLASSES} t CROSS JOIN {_CLASSES} q
           LEFT JOIN j ON label = t.class AND predicted = q.class GROUP BY 1, 2""")
def flow_holdout_confusion(spark, sf):
    return E.confusion(held_out(spark, sf), SEGMENTS)


_SAMPLES = f"""{PARTIES},
  pt AS (SELECT segment AS id, t FROM (SELECT id, segment, row_number() OVER (PARTITION BY segment ORDER BY id) AS r
         FROM c WHERE {_slot('id')} < 20) JOIN ct USING (id) WHERE r <= 10)"""


@query(f"""WITH {party_pairs(seed_tokens='pt', parties=_SAMPLES)}
           SELECT seed_id AS seed_label, segment AS label, count(*) AS n FROM p JOIN c ON c.id = neighbor_id GROUP BY 1, 2""")
def flow_validate_per_class(spark, sf):
    return flows.validate_per_class(corpus(spark, sf), stored(spark, sf), FEATURES, "id", "segment", K_PARTIES,
                                    embedder=HashEmbedder(DIM))


@query(f"""WITH {party_pairs()} SELECT DISTINCT {FIELDS}, CAST(id AS VARCHAR) AS id, segment
           FROM c WHERE id IN (SELECT neighbor_id FROM p)""")
def flow_seed_file(spark, sf):
    given = seeds(spark, sf).select("id", *FEATURES)
    path = f"{new_folder(spark, 'seeds')}/suppliers.csv"
    write_csv(given, path)
    out = flows.match_file(spark, path, given.schema, stored(spark, sf), new_folder(spark, "out"), K_PARTIES,
                           ["id", "segment"], HashEmbedder(DIM))
    return read_table(spark, out, "csv")


@query(f"""WITH {party_pairs()} SELECT segment AS label, count(*) AS n, round(max(score), 6) AS best_score
           FROM p JOIN c ON c.id = neighbor_id WHERE seed_id = (SELECT min(id) FROM s) GROUP BY 1""")
def flow_seed_record(spark, sf):
    given = seeds(spark, sf)
    row = given.orderBy("id").select(*FEATURES).first()
    found = flows.match_record(spark, row.asDict(), given.select(*FEATURES).schema, stored(spark, sf), K_PARTIES, "segment",
                               {"nation": (0, 24), "region": (0, 4)}, HashEmbedder(DIM))
    return flows.by_label(found).withColumn("best_score", F.round("best_score", 6))
