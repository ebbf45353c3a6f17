"""Queries on sources, sinks, shaping, sampling, sets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F


from kith import functions as K
from kith.operators import report, sampling, sets, shape, topk
from kith.operators.embed import embed
from kith.operators.index import build_index, index_count
from kith.plans.registry import query, table
from kith.sources import (
    append_index, append_log, in_domain, new_folder, read_index, read_seeds, read_table, write_csv, write_result,
)
from kith.streaming import read_stream, stream_index

AS_OF = "2002-01-01"
CUSTOMER_FIELDS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


# -- sources and sinks ------------------------------------------------------------------------

@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
          c_mktsegment FROM customer""")
def src_csv_string(spark, sf):
    path = new_folder(spark, "csv")
    write_csv(table(spark, sf, "customer").select(*CUSTOMER_FIELDS), path)
    return read_table(spark, path, "csv")


@query("""SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def src_csv_typed(spark, sf):
    path = new_folder(spark, "csv")
    write_csv(table(spark, sf, "customer"), path)
    return read_table(spark, path, "csv", infer=True)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL")
def src_parquet_scan(spark, sf):
    orders = read_table(spark, f"{sf.rstrip('/')}/orders.parquet", "parquet")
    return orders.filter(F.col("o_orderpriority").isNotNull()).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def src_seed_file(spark, sf):
    seeds = table(spark, sf, "supplier")
    need, schema = ["s_suppkey", "s_nationkey"], "s_suppkey long, s_name string, s_nationkey int"
    columns = ["s_suppkey", "s_name", "s_nationkey"]
    csv, json = new_folder(spark, "seeds") + ".txt", new_folder(spark, "seeds") + ".json"
    write_csv(seeds.select(*columns), csv)
    seeds.select(*columns).write.json(json)
    return sets.union_all(read_seeds(spark, csv, need, schema), read_seeds(spark, json, need, schema))


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
          WHERE c_nationkey BETWEEN 5 AND 20 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def src_seed_record(spark, sf):
    domain = {"c_nationkey": (5, 20), "c_mktsegment": ["BUILDING", "MACHINERY"]}
    return in_domain(table(spark, sf, "customer"), domain).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def sink_csv_roundtrip(spark, sf):
    path = write_result(table(spark, sf, "customer").select(*CUSTOMER_FIELDS), new_folder(spark, "out"), "customer.csv")
    return read_table(spark, path, "csv", schema=CUSTOMER_SCHEMA)


@query("""SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS question, text AS answer, role AS steps,
          strftime(make_timestamp((1704067200 + conv_id * 3600 + turn) * 1000000), '%Y-%m-%d') AS day
          FROM conversations""")
def sink_log_append(spark, sf):
    path = new_folder(spark, "log")
    given = table(spark, sf, "conversations")
    fields = [
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
        F.concat_ws("/", "conv_id", "turn").alias("question"), F.col("text").alias("answer"),
        F.col("role").alias("steps")]
    even = F.col("conv_id") % 2 == 0
    for part in (even, ~even):
        append_log(given.filter(part).select(*fields), path)
    schema = "ts timestamp, question string, answer string, steps string, day date"
    return read_table(spark, path, "json", schema).select(
        "question", "answer", "steps", F.date_format("day", "yyyy-MM-dd").alias("day"))


# -- index ------------------------------------------------------------------------------------

@query("SELECT vec_id AS id, 'label: ' || label AS row_as_text, len(embedding) AS dim FROM embeddings")
def idx_open(spark, sf):
    path = new_folder(spark, "index")
    append_index(shape.row_as_text(table(spark, sf, "embeddings"), ["label"]), path, "vec_id", meta_cols=["label"])
    return read_index(spark, path).select("id", "row_as_text", F.size("embedding").cast("long").alias("dim"))


@query("""SELECT 'c' || c_custkey AS id, c_mktsegment AS source FROM customer
          UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier""")
def idx_append(spark, sf):
    path = new_folder(spark, "index")
    parts = [
        table(spark, sf, "customer").select(
            F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("source")),
        table(spark, sf, "supplier").select(
            F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"),
            F.lit("supplier").alias("source")),
    ]
    for part in parts:
        append_index(embed(shape.row_as_text(part, ["nation"])), path, "id", meta_cols=["source"])
    return read_index(spark, path).select("id", F.col("metadata")["source"].alias("source"))


def _customer_index(spark, sf):
    return build_index(table(spark, sf, "customer"), new_folder(spark, "index"), "c_custkey", "c_mktsegment",
                       features=["c_name", "c_nationkey"])


@query("""SELECT c_custkey AS id, 'c_name: ' || c_name || '; c_nationkey: ' || c_nationkey AS row_as_text,
          CAST(c_custkey AS VARCHAR) AS meta_id, c_mktsegment AS meta_label, 2.0::DOUBLE AS n_tokens FROM customer""")
def idx_build(spark, sf):
    return _customer_index(spark, sf).select(
        "id", "row_as_text", F.col("metadata")["c_custkey"].alias("meta_id"),
        F.col("metadata")["c_mktsegment"].alias("meta_label"),
        F.aggregate(K.to_doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x).alias("n_tokens"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_custkey) AS n_ids FROM customer GROUP BY 1")
def idx_load_repeated(spark, sf):
    """Two loads, one of them run again."""
    path, rows = new_folder(spark, "index"), table(spark, sf, "customer")
    for load in (0, 1, 0):
        part = rows.filter(F.col("c_custkey") % 2 == load)
        index = build_index(part, path, "c_custkey", "c_mktsegment", ["c_name", "c_nationkey"], load=f"half-{load}")
    return index.groupBy(F.col("metadata")["c_mktsegment"].alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("SELECT count(*) AS n FROM customer")
def idx_count(spark, sf):
    return index_count(_customer_index(spark, sf))


@query("""SELECT c_custkey AS id, 'nation' AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer
          UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer""")
def idx_metadata_map(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return rows.select("id", F.explode(K.metadata_map(["nation", "segment"])))


@query("""SELECT c_custkey AS id, 'c_nationkey: ' || c_nationkey || '; c_mktsegment: ' || c_mktsegment AS row_as_text
          FROM customer""")
def idx_append_stream(spark, sf):
    rows = table(spark, sf, "customer")
    # The given table goes in as four files, two to a chunk.
    files, path = new_folder(spark, "arrivals"), new_folder(spark, "index")
    rows.repartition(4, "c_custkey").write.parquet(files)
    arriving = read_stream(spark, files, rows.schema, files_per_chunk=2)
    stream_index(arriving, path, new_folder(spark, "progress"), "c_custkey",
                 ["c_nationkey", "c_mktsegment"]).awaitTermination()
    return read_index(spark, path).select("id", "row_as_text")


# -- projection and scalars -------------------------------------------------------------------

@query("SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer")
def proj_rename(spark, sf):
    return shape.rename(table(spark, sf, "customer"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"})


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def proj_drop(spark, sf):
    return shape.drop(table(spark, sf, "part"), "p_retailprice", "_c0")


@query("SELECT c_name, c_nationkey, c_acctbal FROM customer")
def proj_features(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select(*shape.feature_cols(customer, "c_custkey", "c_mktsegment"))


@query("SELECT count(*) AS n, count(*) AS n_ids FROM orders")
def proj_row_id(spark, sf):
    rows = shape.with_row_id(table(spark, sf, "orders"), name="row_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_ids"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id, o_orderkey FROM orders")
def proj_row_id_dense(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    return shape.with_row_id(orders, ["o_totalprice", "o_orderkey"], "row_id").select("row_id", "o_orderkey")


@query("""SELECT p_partkey, p_size + 2 AS size_plus, CAST(NULL AS INTEGER) AS type_plus FROM part""")
def proj_arith_cast(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size_plus"), "p_type")
    part = shape.derive(part, "size_plus", K.to_int(F.col("size_plus").try_cast("double") + 2))
    # text that is no number becomes null
    return shape.derive(part, "type_plus", K.to_int(F.col("p_type").try_cast("double") + 2)).drop("p_type")


@query(f"""SELECT o_orderkey, CAST(trunc(
             (year(DATE '{AS_OF}') - year(o_orderdate)) * 12 + month(DATE '{AS_OF}') - month(o_orderdate)
             + CASE WHEN day(o_orderdate) = day(DATE '{AS_OF}') THEN 0
                    ELSE (day(DATE '{AS_OF}') - day(o_orderdate)) / 31.0 END) AS INTEGER) AS months FROM orders""")
def proj_tenure_months(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("since"))
    return orders.select("o_orderkey", K.tenure_months(F.col("since"), as_of=AS_OF).alias("months"))


@query(f"SELECT n_nationkey, '{AS_OF}' AS as_of FROM nation")
def proj_literal(spark, sf):
    return shape.constant(table(spark, sf, "nation").select("n_nationkey"), "as_of", AS_OF)


@query("""SELECT c_custkey, concat_ws('; ', 'c_name: ' || c_name,
            'segment: ' || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END,
            'c_nationkey: ' || c_nationkey) AS row_as_text FROM customer""")
def row_as_text(spark, sf):
    customer = table(spark, sf, "customer").withColumn(
        "segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return shape.row_as_text(customer, ["c_name", "segment", "c_nationkey"]).select("c_custkey", "row_as_text")


@query("""SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, 'a: ' || c_mktsegment AS note,
          CAST(NULL AS VARCHAR) AS absent FROM customer""")
def text_to_row(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.concat(F.lit("a: "), "c_mktsegment").alias("note"))
    text = shape.row_as_text(rows, ["name", "nation", "note"]).select("c_custkey", "row_as_text")
    return shape.text_to_columns(text, ["name", "nation", "note", "absent"]).drop("row_as_text")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'Unknown') AS k, 'Unknown' AS target FROM events""")
def meta_get_default(spark, sf):
    props = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", K.meta_get(props, "k", encoded=True).alias("k"),
        K.meta_get(props, "target", encoded=True).alias("target"))


@query("""SELECT doc_id, CASE WHEN quality = toxic THEN 'same' ELSE 'different' END AS comparison,
          quality = toxic AS equal FROM labels""")
def compare_flag(spark, sf):
    a, b = F.col("quality"), F.col("toxic")
    return table(spark, sf, "labels").select(
        "doc_id", K.compare(a, b).alias("comparison"), K.same_value(a, b).alias("equal"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'Under 5k' ELSE
            CAST(floor(o_totalprice / 5000) * 5 AS BIGINT) || 'k - ' ||
            CAST(floor(o_totalprice / 5000) * 5 + 5 AS BIGINT) || 'k' END AS bucket FROM orders""")
def bucket_label(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", K.bucket_label(F.col("o_totalprice"), 5000).alias("bucket"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'the|die|les') AS flag,
          text || CASE WHEN regexp_matches(lower(text), 'the|die|les') THEN ' . keep' ELSE '' END AS text
          FROM conversations""")
def text_keyword_flag(spark, sf):
    flag = K.flag_keywords(F.col("text"), ["the", "die", "les"])
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", flag.alias("flag"), K.append_if(F.col("text"), flag, " . keep").alias("text"))


@query("""SELECT conv_id, turn, 'ask the ' || role || ' ' AS thought, ' look up ' AS action, ' ' || text AS action_input,
          'turn ' || turn AS observation FROM conversations""")
def text_extract_steps(spark, sf):
    logs = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("ask the "), "role", F.lit(" Action: look up Action Input: "), "text").alias("log"),
        F.concat(F.lit("turn "), "turn").alias("seen"))
    return shape.extract_steps(logs, "log", "seen").drop("log", "seen", "step")


# -- predicates, limits, samples --------------------------------------------------------------

@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority AS priority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def filter_not_null(spark, sf):
    priority = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority")
    return table(spark, sf, "orders").select("o_orderkey", priority).filter(F.col("priority").isNotNull())


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def filter_conjunction(spark, sf):
    return table(spark, sf, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


@query("""SELECT doc_id, 'equal' AS kind FROM labels WHERE quality = toxic
          UNION ALL SELECT doc_id, 'unequal' FROM labels WHERE quality <> toxic""")
def filter_col_cmp(spark, sf):
    labels, a, b = table(spark, sf, "labels"), F.col("quality"), F.col("toxic")
    return sets.union_all(labels.filter(a == b).select("doc_id", F.lit("equal").alias("kind")),
                          labels.filter(a != b).select("doc_id", F.lit("unequal").alias("kind")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_ordered(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.limit_ordered(orders, 100, F.col("o_totalprice").desc(), F.col("o_orderkey"))


SLOT = "(('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8))::BIGINT % 100)"


@query(f"""SELECT o_orderkey, CASE WHEN {SLOT.format('o_orderkey')} < 80 THEN 'train' ELSE 'test' END AS part
           FROM orders""")
def split_hash_80_20(spark, sf):
    train, test = sampling.split(table(spark, sf, "orders").select("o_orderkey"), [80, 20], "o_orderkey")
    return sets.union_all(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))


@query(f"""SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r
           FROM embeddings WHERE {SLOT.format('vec_id')} < 20) WHERE r <= 10""")
def sample_per_label(spark, sf):
    return sampling.sample_per_label(table(spark, sf, "embeddings").select("label", "vec_id"), "label", "vec_id")


@query("""SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r
          FROM labels WHERE quality IN (0, 1)) WHERE r <= 10""")
def sample_balanced(spark, sf):
    return sampling.balanced_sample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 10)


# -- aggregates, top-k, sets ------------------------------------------------------------------

@query("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def agg_group_count(spark, sf):
    return report.group_count(table(spark, sf, "orders"), "o_orderstatus")


@query("SELECT count(*) AS count FROM lineitem")
def agg_count(spark, sf):
    return report.row_count(table(spark, sf, "lineitem"))


@query("SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1 FROM labels")
def agg_count_if(spark, sf):
    return report.count_if(table(spark, sf, "labels"), n0=F.col("toxic") == 0, n1=F.col("toxic") == 1)


@query("""SELECT value, count(*) AS count FROM (
            SELECT 'c_nationkey: ' || c_nationkey AS value FROM customer
            UNION ALL SELECT 'c_mktsegment: ' || c_mktsegment FROM customer) GROUP BY 1""")
def agg_value_counts(spark, sf):
    text = shape.row_as_text(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])
    return report.value_counts(text.select(K.token_pairs(F.col("row_as_text")).alias("tokens")), "tokens")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def agg_distinct(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def topk_global(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return topk.top_m(customer, F.col("c_acctbal").desc(), 20, F.col("c_custkey"))


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def topk_mode_label(spark, sf):
    return topk.mode_label(table(spark, sf, "customer"), "c_mktsegment")


def _parties(spark, sf):
    return (table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")),
            table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("SELECT c_nationkey AS nation, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def set_union_all(spark, sf):
    return sets.union_all(*_parties(spark, sf))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf):
    return sets.union_distinct(*[p.select("nation") for p in _parties(spark, sf)])


# -- reports ----------------------------------------------------------------------------------

@query(f"""WITH t AS (SELECT o_custkey, CAST(trunc(max(
             (year(DATE '{AS_OF}') - year(o_orderdate)) * 12 + month(DATE '{AS_OF}') - month(o_orderdate)
             + CASE WHEN day(o_orderdate) = day(DATE '{AS_OF}') THEN 0
                    ELSE (day(DATE '{AS_OF}') - day(o_orderdate)) / 31.0 END)) AS INTEGER) AS months
             FROM orders GROUP BY 1),
           c AS (SELECT * FROM customer JOIN t ON c_custkey = o_custkey)
           SELECT count(*) FILTER (c_acctbal < 0) AS n_flagged, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_group,
             max(months) AS longest_months,
             (SELECT c_custkey FROM c ORDER BY months DESC, c_custkey LIMIT 1) AS longest_id,
             CAST(floor(max(months) / 12.0) AS BIGINT) AS longest_years FROM c""")
def report_profile(spark, sf):
    since = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    months = K.tenure_months(F.date_format("since", "M/d/yyyy"), as_of=AS_OF)
    people = table(spark, sf, "customer").join(since, F.col("c_custkey") == F.col("o_custkey"))
    return report.profile(people.withColumn("months", months), "c_custkey", F.col("c_acctbal") < 0,
                          F.col("c_mktsegment") == "BUILDING", "months")


@query("""SELECT CASE WHEN o_totalprice >= 500000 THEN 21
            ELSE CAST(floor(20 * (o_totalprice - 0) / 500000.0) AS BIGINT) + 1 END AS bin, count(*) AS n
          FROM orders GROUP BY 1""")
def report_histogram(spark, sf):
    return report.histogram(table(spark, sf, "orders"), "o_totalprice", 0, 500000, 20)


@query("""SELECT c_mktsegment, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total,
          count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def report_group_sum(spark, sf):
    rows = table(spark, sf, "customer").join(
        table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return report.group_sum(rows, ["c_mktsegment", "o_orderstatus"], "o_totalprice")
