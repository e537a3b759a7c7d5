"""Text and vector queries."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from freightloom.operators import graph_build as B
from freightloom.operators import text as T
from freightloom.operators.analytics import r
from freightloom.plans.registry import query
from freightloom.sources import table

_CENTRE = """pool AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos),
 unit AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value FROM pool)"""


@query("mean_pool", sql=f"WITH {_CENTRE} SELECT label, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM unit")
def mean_pool(spark, sf_dir):
    return T.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("value", r(F.col("value")))


@query("cosine_topk", sql=f"""WITH {_CENTRE}, c AS (SELECT label, list(value ORDER BY pos) AS centre FROM unit GROUP BY label),
  s AS (SELECT vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), centre), 6) AS similarity FROM embeddings JOIN c USING (label))
SELECT vec_id, label, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    return T.cosine_topk(table(spark, sf_dir, "embeddings"), "label", "embedding", 5).select("vec_id", "label", "similarity", "rank")


WORDS = ["order", "the", "data", "supply"]


@query("token_overlap_score", sql="SELECT doc_id, round(least(CAST(0.3 AS DOUBLE) + (" + " + ".join(f"contains(lower(text), '{w}')::int" for w in WORDS)
       + ") / 4 * CAST(0.7 AS DOUBLE), 1.0), 6) AS score FROM documents")
def token_overlap_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r(T.token_overlap("text", WORDS)).alias("score"))


_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("grounding_score", sql=f"""
SELECT conv_id, turn, round(share, 6) AS share, CASE WHEN share < 0.2 THEN 'rejected' ELSE 'passed' END AS status FROM (
  SELECT a.conv_id, a.turn, coalesce(len(list_intersect({_W.format('a.text')}, {_W.format('b.text')})) / greatest(len({_W.format('a.text')}), 1), 0.0) AS share
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant')""")
def grounding_score(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    pairs = c.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return T.grounding(pairs, "text", "evidence").select("conv_id", "turn", r(F.col("share")).alias("share"), "status")


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in T.INTENTS.items()) + " ELSE 'general' END"


@query("keyword_tagging", sql=f"SELECT conv_id, turn, {_INTENT} AS intent, " + ", ".join(
    f"CASE WHEN len(list_intersect(regexp_split_to_array(t, '[^a-z0-9]+'), {list(ws)})) > 0 THEN 1 ELSE 0 END AS names_{k.lower()}" for k, ws in T.ENTITY_WORDS.items())
    + " FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)")
def keyword_tagging(spark, sf_dir):
    tagged = T.keyword_tags(table(spark, sf_dir, "conversations"), "text")
    return tagged.select("conv_id", "turn", "intent", *[c for c in tagged.columns if c.startswith("names_")])


@query("feature_hash_vectors")
def feature_hash_vectors(spark, sf_dir):
    """64 hashed dimensions per node from its label, name and risk, scaled to unit length."""
    nodes, _ = B.load_graph(spark, sf_dir)
    hasher = FeatureHasher(numFeatures=64, inputCols=["label", "name", "risk"], outputCol="hashed")
    model = Pipeline(stages=[hasher, Normalizer(p=2.0, inputCol="hashed", outputCol="vector")]).fit(nodes)
    return model.transform(nodes).select("node_id", "label", F.transform(vector_to_array("vector"), lambda x: F.round(x, 6)).alias("vector"))
