"""Queries over triples, word graphs and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import memory as M
from quern.plans.tables import TRI, table, triples

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_RAW = """raw AS (SELECT event_id AS seq, 'User' || (user_id % 20) AS subject, event_type AS predicate, CASE WHEN event_id % 2 = 0 THEN 'day' ELSE 'Day' END || (epoch_us(ts) // 86400000000 % 5) AS object, value / 100e0 - 0.2e0 AS confidence FROM events)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) % 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("User"), (F.col("user_id") % 20).cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "day").otherwise("Day"), day.cast("string")).alias("object"),
        (F.col("value") / 100 - 0.2).alias("confidence"),
    )


@query(f"""WITH {_RAW}, g AS (SELECT lower(subject || '|' || predicate || '|' || object) AS key, arg_min(object, seq) AS object, arg_max(confidence, seq) AS c, max(seq) AS updated_seq, count(*)::BIGINT AS writes FROM raw GROUP BY 1)
SELECT key, object, round(greatest(0e0, least(1e0, c)), 6)::DOUBLE AS confidence, updated_seq, writes FROM g""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: one edge a key, first spelling, last confidence."""
    return G.upsert(_raw(spark, sf_dir)).select("key", "object", F.round("confidence", 6).alias("confidence"), "updated_seq", "writes")


@query(f"WITH {TRI} SELECT seq FROM tri WHERE contains(lower(subject), 'customer') AND contains(lower(object), 'ion')")
def triple_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conjunction of substrings."""
    return G.search(triples(spark, sf_dir), subject="CUSTOMER", object_="ion").select("seq")


@query(f"WITH {TRI}, o AS (SELECT min(object) AS o FROM tri WHERE predicate = 'lives_in') SELECT seq, subject FROM tri, o WHERE predicate = 'lives_in' AND object = o")
def triple_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, case included."""
    t = triples(spark, sf_dir)
    first = t.where("predicate = 'lives_in'").agg(F.min("object").alias("o"))
    return G.search(t, predicate="lives_in", exact=True).join(F.broadcast(first), F.col("object") == F.col("o")).select("seq", "subject")


@query(f"WITH {TRI} SELECT DISTINCT e AS entity FROM (SELECT subject AS e FROM tri UNION ALL SELECT object FROM tri) WHERE contains(lower(e), 'ia')")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities on either end."""
    return G.entity_search(triples(spark, sf_dir), "IA")


@query(f"""WITH RECURSIVE {TRI}, s AS (SELECT min(object) AS e FROM tri WHERE predicate = 'part_of'), b AS (SELECT subject AS x, object AS y FROM tri UNION ALL SELECT object, subject FROM tri),
d0 AS (SELECT e, 0 AS d FROM s), d1 AS (SELECT DISTINCT y AS e, 1 AS d FROM b JOIN d0 ON x = e), d2 AS (SELECT DISTINCT y AS e, 2 AS d FROM b JOIN d1 ON x = e)
SELECT e AS entity, min(d)::INT AS distance FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY 1""")
def neighbours_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps around a region."""
    t = triples(spark, sf_dir)
    return G.neighbourhood(t, t.where("predicate = 'part_of'").agg(F.min("object").alias("entity")), 2)


@query(f"""WITH {TRI} SELECT min(n1.object) AS region, 2 AS length, round((arg_min(c.confidence, c.seq) + 1) / 2, 6)::DOUBLE AS confidence FROM tri c JOIN tri n1 ON c.object = n1.subject AND n1.predicate = 'part_of'
WHERE c.seq = (SELECT min(seq) FROM tri)""")
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from a customer to its region and its mean confidence."""
    t = triples(spark, sf_dir)
    first = t.agg(F.min_by("subject", "seq").alias("node"))
    nation = t.join(first, F.col("subject") == F.col("node"), "left_semi").select(F.col("object").alias("n")).distinct()
    region = t.join(nation, F.col("subject") == F.col("n"), "left_semi").agg(F.min("object").alias("node"))
    p = G.paths(t, first, region)
    return p.select(F.element_at("nodes", -1).alias("region"), "length", F.round(G.chain_confidence(F.col("confidences")), 6).alias("confidence"))


@query(f"""WITH {TRI}, d AS (SELECT min(object) AS d FROM tri WHERE predicate = 'lives_in')
SELECT object AS entity, 'out' AS direction, round(confidence, 6)::DOUBLE AS confidence FROM tri, d WHERE subject = d UNION ALL SELECT subject, 'in', round(confidence, 6) FROM tri, d WHERE object = d""")
def related_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a domain, with their direction."""
    t = triples(spark, sf_dir)
    name = t.where("predicate = 'lives_in'").agg(F.min("object").alias("node"))
    return G.related(t, name).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {TRI}, c AS (SELECT * FROM tri WHERE contains(lower(subject), 'ion') OR contains(lower(predicate), 'ion') OR contains(lower(object), 'ion') ORDER BY seq LIMIT 40),
s AS (SELECT seq, greatest(0e0, least(1e0, confidence + CASE WHEN contains(lower(subject), 'ion') THEN 0.2e0 ELSE 0 END + CASE WHEN contains(lower(object), 'ion') THEN 0.2e0 ELSE 0 END + CASE WHEN contains(lower(predicate), 'ion') THEN 0.1e0 ELSE 0 END)) AS score FROM c)
SELECT seq, round(score, 6)::DOUBLE AS score FROM s ORDER BY round(score, 9) DESC, seq LIMIT 10""")
def graph_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best triples for a query."""
    return G.rank_matches(triples(spark, sf_dir), "ion").select("seq", F.round("score", 6).alias("score"))


@query(f"WITH {TRI} SELECT count(*)::BIGINT AS edges, count(DISTINCT subject)::BIGINT AS subjects, count(DISTINCT predicate)::BIGINT AS predicates, count(DISTINCT object)::BIGINT AS objects FROM tri")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and distinct ends."""
    return G.graph_stats(triples(spark, sf_dir))


@query("""SELECT l_suppkey, l_partkey, max(w)::DOUBLE AS weight FROM (SELECT l_suppkey, l_partkey, l_quantity AS w FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber = 2) GROUP BY 1, 2""")
def merge_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two graphs, the stronger weight stays."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("weight"))
    a, b = li.where("l_linenumber = 1").drop("l_linenumber"), li.where("l_linenumber = 2").drop("l_linenumber")
    return G.merge(a, b, ["l_suppkey", "l_partkey"])


@query("""WITH b AS (SELECT l_suppkey, l_partkey, max(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_partkey) AS rk FROM b)
SELECT l_suppkey, l_partkey, weight FROM r WHERE rk <= 50""")
def assoc_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best edge of each key, then fifty a group."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").alias("weight"))
    return G.best_per_key(li, ["l_suppkey", "l_partkey"], "l_suppkey", "weight")


@query("SELECT o_orderkey AS id, c_name AS source_word, n_name AS target_word FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON o_orderkey % 30 = n_nationkey")
def labelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends' words, unknown ends dropped."""
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("word"))
    nodes = nodes.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("word")))
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("o_orderkey") % 30).cast("string")).alias("target")
    )
    return G.label_edges(edges, nodes).select("id", "source_word", "target_word")


@query("SELECT c_custkey, coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, c_nationkey::VARCHAR) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, or the key where there is none."""
    labels = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return G.with_label(table(spark, sf_dir, "customer"), labels, "c_nationkey").select("c_custkey", "label")


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS cited FROM documents) SELECT doc_id, cited FROM c WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey::VARCHAR = cited)""")
def uncited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers that the material table does not have."""
    cited = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("cited"))
    return cited.join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("cited")), "cited", "left_anti").select("doc_id", "cited")


@query("""WITH t AS (SELECT conv_id * 100 + turn AS id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations),
p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE AS similarity FROM t x JOIN t y ON x.id < y.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS rn FROM p WHERE similarity >= 0.12)
SELECT a, b, round(similarity, 6)::DOUBLE AS similarity FROM r WHERE rn <= 10""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with similar words."""
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return G.similar_pairs(t, "id", M.words(F.col("text")), 0.12).withColumn("similarity", F.round("similarity", 6))


@query("""WITH c AS (SELECT l_orderkey AS id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem)
SELECT l.id, l.p AS x, r.p AS y FROM c l JOIN c r ON l.id = r.id AND l.i < r.i""")
def concept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a record's concepts, with an order's parts as its concepts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return G.concept_pairs(lines.select("id", F.col("c.l_partkey").alias("w")), "id", "w")


@query("SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey")
def child_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the ontology's domains."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("up"))
    kids = n.groupBy("up").agg(F.collect_list("id").alias("children"))
    r = table(spark, sf_dir, "region").join(kids, F.col("r_regionkey") == F.col("up")).select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "children")
    both = r.unionByName(n.select("id", "name", F.expr("cast(array() as array<int>)").alias("children")))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("p"), F.col("r_regionkey").alias("k"))
    return G.children(both).join(F.broadcast(names), F.col("parent") == F.col("k")).select(F.col("p").alias("parent"), "child")


@query("""WITH s AS (SELECT DISTINCT p_brand AS id, p_type AS seed FROM part WHERE p_size < 10) SELECT x.id AS a, y.id AS b, count(*)::BIGINT AS n FROM s x JOIN s y ON x.seed = y.seed AND x.id < y.id GROUP BY 1, 2""")
def shared_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains by the seeds they share."""
    d = table(spark, sf_dir, "part").where("p_size < 10").groupBy(F.col("p_brand").alias("id")).agg(F.collect_set("p_type").alias("seeds"))
    return G.shared_seeds(d, "seeds")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations),
r AS (SELECT conv_id, list({'turn': turn, 'w': w} ORDER BY turn) AS free, CAST(NULL AS STRUCT(turn INTEGER, w VARCHAR[])) AS seed, CAST([] AS INTEGER[]) AS taken FROM t GROUP BY conv_id
  UNION ALL
  SELECT conv_id, list_filter(free, lambda x: NOT list_contains(own, x.turn)), free[1], own FROM (
    SELECT conv_id, free, list_transform(list_filter(free, lambda x: x.turn = free[1].turn OR len(list_intersect(x.w, free[1].w)) / len(list_distinct(list_concat(x.w, free[1].w)))::DOUBLE > 0.1), lambda x: x.turn) AS own FROM r WHERE len(free) > 0))
SELECT conv_id, unnest(taken) AS turn, seed.turn AS "cluster" FROM r WHERE seed IS NOT NULL""")
def seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of each conversation's turns."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", M.word_set(F.col("text")).alias("w"))
    return G.seed_clusters(t, "conv_id", "turn", "w", 0.1)


@query("""SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9: intersection of two key sets."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return c.intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000""")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9: difference of two key sets."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return c.subtract(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))
