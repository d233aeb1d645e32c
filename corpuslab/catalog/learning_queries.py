"""Registered queries for features, models, model quality and explanations."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from corpuslab.catalog import fixtures as fx
from corpuslab.catalog.fixtures import sql_str
from corpuslab.catalog.registry import query, table
from corpuslab.catalog.relational_queries import SQL_GAPS, gaps
from corpuslab.functions import text
from corpuslab.functions.scalar import parse_time, rounded
from corpuslab.operators import explain, features as fe, models, quality
from corpuslab.operators.topics import Nmf
from corpuslab.plans.storage import written

# Older orders are training rows, the rest are test rows.
TRAIN = "day < '1997-01-01'"


# ---- features -----------------------------------------------------------------------

@query("features_fe1_median", f"""WITH {SQL_GAPS}, m AS (SELECT quantile_cont(price, 0.5) AS med FROM gaps WHERE {TRAIN})
SELECT o_orderkey, round(coalesce(price, med), 6) + 0 AS price FROM gaps, m""")
def median(spark, sf):
    rows = gaps(spark, sf)
    model = fe.MedianImputer(["price"]).fit(rows.filter(TRAIN))
    return model.transform(rows).select("o_orderkey", rounded(F.col("price")).alias("price"))


@query("features_fe2_constant", f"WITH {SQL_GAPS} SELECT o_orderkey, coalesce(priority, 'unknown_priority') AS priority FROM gaps")
def constant(spark, sf):
    return fe.ConstantFill(["priority"]).transform(gaps(spark, sf)).select("o_orderkey", "priority")


SQL_BIOS = """bios AS (SELECT o_orderkey, lower(o_orderpriority) AS bio, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS region,
  o_orderdate AS day FROM orders)"""


@query("features_fe3_suffix", SQL_BIOS.join(["WITH ", r""",
s AS (SELECT *, coalesce(lower(list_last(regexp_extract_all(bio, '[\p{L}\p{N}]+'))), '') AS suffix FROM bios),
c AS (SELECT suffix, region, count(*) AS n FROM s WHERE region IS NOT NULL AND suffix <> '' AND day < '1997-01-01' GROUP BY ALL),
best AS (SELECT suffix, region AS guess FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, region) AS rn FROM c)
  WHERE rn = 1 AND n > 50)
SELECT o_orderkey, coalesce(region, guess, 'unknown_region') AS region FROM s LEFT JOIN best USING (suffix)"""]))
def suffix(spark, sf):
    bios = table(spark, sf, "orders").select(
        "o_orderkey", F.lower("o_orderpriority").alias("bio"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("region"),
        F.col("o_orderdate").alias("day"))
    model = fe.SuffixInference("bio", "region", ["o_orderkey"]).fit(bios.filter(TRAIN))
    return model.transform(bios).select("o_orderkey", "region")


@query("features_fe3_suffix_documents", r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang,
  coalesce(lower(list_last(regexp_extract_all(text, '[\p{L}\p{N}]+'))), '') AS suffix FROM documents),
c AS (SELECT suffix, lang, count(*) AS n FROM s WHERE lang IS NOT NULL AND suffix <> '' GROUP BY ALL),
best AS (SELECT suffix, lang AS guess FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, lang) AS rn FROM c)
  WHERE rn = 1 AND n > 5)
SELECT doc_id, coalesce(lang, guess, 'unknown_lang') AS lang FROM s LEFT JOIN best USING (suffix)""")
def suffix_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    model = fe.SuffixInference("text", "lang", ["doc_id"], min_support=5).fit(docs)
    return model.transform(docs).select("doc_id", "lang")


@query("features_fe4_low_tail", f"""WITH {SQL_GAPS}, m AS (SELECT quantile_cont(price, 0.5) AS med FROM gaps WHERE {TRAIN}),
f AS (SELECT o_orderkey, day, coalesce(price, med) AS price FROM gaps, m),
t AS (SELECT quantile_cont(price, 0.02) AS x FROM f WHERE {TRAIN})
SELECT o_orderkey, CAST(price <= x AS INTEGER) AS low FROM f, t""")
def low_tail(spark, sf):
    rows = gaps(spark, sf)
    steps = Pipeline(stages=[fe.MedianImputer(["price"]), fe.LowTailFlag("price", "low")])
    return steps.fit(rows.filter(TRAIN)).transform(rows).select("o_orderkey", "low")


@query("features_fe5_cyclic", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts FROM events)
SELECT event_id, coalesce(round(sin(2 * pi() * hour(ts) / 24.0), 6) + 0, 0) AS hour_sin, coalesce(round(cos(2 * pi() * hour(ts) / 24.0), 6) + 0, 0) AS hour_cos,
  coalesce(round(sin(2 * pi() * (isodow(ts) - 1) / 7.0), 6) + 0, 0) AS day_sin, coalesce(round(cos(2 * pi() * (isodow(ts) - 1) / 7.0), 6) + 0, 0) AS day_cos FROM t""")
def cyclic(spark, sf):
    written = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("never"))
    events = table(spark, sf, "events").select("event_id", parse_time(written).alias("ts"))
    names = ("hour_sin", "hour_cos", "day_sin", "day_cos")
    return fe.CyclicTime("ts").transform(events).select("event_id", *[rounded(F.col(n)).alias(n) for n in names])


@query("features_fe6_activity", """
WITH c AS (SELECT user_id, count(*) AS uploads FROM events WHERE ts < '2024-01-01 06:00:00' GROUP BY user_id)
SELECT event_id, CAST(coalesce(uploads, 1) AS BIGINT) AS uploads FROM events LEFT JOIN c USING (user_id)""")
def activity(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    model = fe.ActivityCount("user_id", "uploads", ["event_id"]).fit(events.filter("ts < '2024-01-01 06:00:00'"))
    return model.transform(events).select("event_id", "uploads")


@query("features_fe7_one_hot", """
SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS p0, CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS p1,
  CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS p2, CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS p3 FROM orders""")
def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    model = fe.OneHot(["o_orderpriority"]).fit(orders.filter("o_orderpriority <> '5-LOW'"))
    rows = model.transform(orders).withColumn("v", vector_to_array("o_orderpriority_onehot"))
    return rows.select("o_orderkey", *[F.get("v", F.lit(i)).cast("int").alias(f"p{i}") for i in range(4)])


SQL_WORDS = sql_str(r"[\p{L}\p{N}_]{2,}")
SQL_ENGLISH = "(" + ", ".join(sql_str(w) for w in text.english_stop_words()) + ")"


@query("features_fe8_tfidf", f"""
WITH tok AS (SELECT * FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), {SQL_WORDS})) AS term FROM documents) WHERE term NOT IN {SQL_ENGLISH}),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 3000),
raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING (term))
SELECT id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 6) + 0 AS weight FROM raw""")
def tfidf(spark, sf):
    docs = fx.spread(table(spark, sf, "documents").select("doc_id", "text"))
    _, rows = fe.TfIdf("doc_id", "text").fit_transform(docs)
    return rows.withColumn("weight", rounded(F.col("weight")))


@query("features_fe9_topics")
def topics(spark, sf):
    """Topic weights per document, long form."""
    docs = fx.spread(table(spark, sf, "documents").select("doc_id", "text"))
    weights, rows = fe.TfIdf("doc_id", "text").fit_transform(docs)
    rows = written(rows, "tfidf")
    _, found = Nmf(weights.vocabulary, k=10).fit_transform(rows)
    return found.select("id", F.posexplode("topics").alias("topic", "weight"))


@query("features_fe10_assembly", """
SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_discount AS f1, l_tax AS f2, CAST(l_linenumber AS DOUBLE) AS f3 FROM lineitem""")
def assembly(spark, sf):
    rows = fe.assemble(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    v = vector_to_array("features")
    return rows.select("l_orderkey", "l_linenumber", *[F.get(v, F.lit(i)).alias(f"f{i}") for i in range(4)])


@query("features_fe11_standard", """
SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) + 0 AS q,
  round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) + 0 AS p FROM lineitem""")
def standard(spark, sf):
    rows = table(spark, sf, "lineitem")
    found = fe.PopStandardScaler(["l_quantity", "l_extendedprice"]).fit(rows).transform(rows)
    return found.select("l_orderkey", "l_linenumber", rounded(F.col("l_quantity_scaled")).alias("q"), rounded(F.col("l_extendedprice_scaled")).alias("p"))


@query("features_fe12_min_max", """
WITH m AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / (z - a), 6) + 0 AS p FROM lineitem, m""")
def min_max(spark, sf):
    rows = table(spark, sf, "lineitem")
    found = fe.MinMax(["l_extendedprice"]).fit(rows).transform(rows)
    return found.select("l_orderkey", "l_linenumber", rounded(F.col("l_extendedprice_scaled")).alias("p"))


@query("features_fe13_binarize", "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(CAST(embedding[i + 1] > 0 AS INTEGER) AS DOUBLE) AS x FROM embeddings, range(64) r(i)")
def binarize(spark, sf):
    rows = fe.CountBinarizer("embedding", "b").transform(table(spark, sf, "embeddings"))
    return rows.select("vec_id", F.posexplode("b").alias("pos", "x"))


@query("features_fe14_flatten", "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)")
def flatten(spark, sf):
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, 8))
    rows = table(spark, sf, "embeddings").select("vec_id", image.alias("image"))
    flat = rows.select("vec_id", vector_to_array(array_to_vector(fe.flatten(F.col("image")))).alias("v"))
    return flat.select("vec_id", F.posexplode("v").alias("pos", "x"))


@query("features_fe15_drop_columns", "SELECT p_name, p_brand, p_type, p_size FROM part")
def drop_columns(spark, sf):
    part = table(spark, sf, "part").withColumn("fixed", F.lit("same"))
    return fe.drop_uninformative(part.drop("p_retailprice"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "fixed"])


@query("features_fe16_split", """
SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n_train, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS n_test, CAST(count(*) AS BIGINT) AS n_ids FROM orders""")
def split(spark, sf):
    found = fe.exact_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8)
    return found.agg(
        F.count(F.when(F.col("is_train"), 1)).alias("n_train"), F.count(F.when(~F.col("is_train"), 1)).alias("n_test"),
        F.countDistinct("o_orderkey").alias("n_ids"))


@query("features_fe16_split_ids", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST('0x' || substr(md5(o_orderkey || '-42'), 1, 15) AS BIGINT), o_orderkey) AS i FROM orders)
SELECT o_orderkey, i <= (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM orders) AS is_train FROM r""")
def split_ids(spark, sf):
    return fe.exact_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8)


@query("features_fe17_stratified_ids", """
WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM embeddings GROUP BY label),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(vec_id || '-42'), 1, 15) AS BIGINT), vec_id) AS n FROM embeddings)
SELECT vec_id, label FROM r JOIN l USING (label) WHERE n <= 203 // k + CASE WHEN i < 203 % k THEN 1 ELSE 0 END""")
def stratified_ids(spark, sf):
    return fe.stratified_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 203)


@query("features_fe17_stratified", """
WITH l AS (SELECT label, count(*) AS c, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM embeddings GROUP BY label)
SELECT label, CAST(least(c, 203 // k + CASE WHEN i < 203 % k THEN 1 ELSE 0 END) AS BIGINT) AS n FROM l""")
def stratified(spark, sf):
    found = fe.stratified_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 203)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("features_fe18_generated", """
SELECT l_orderkey, l_linenumber, round(l_quantity / (l_tax + 1), 6) + 0 AS qt_ratio, round(l_quantity + l_tax, 6) + 0 AS qt_sum,
  round(l_quantity * l_tax, 6) + 0 AS qt_product, round(l_quantity * l_quantity, 6) + 0 AS qt_square, round(ln(1 + l_quantity), 6) + 0 AS qt_log1p FROM lineitem""")
def generated(spark, sf):
    made = fe.ratio_features(F.col("l_quantity"), F.col("l_tax"), "qt")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[rounded(c).alias(n) for n, c in made.items()])


# ---- models -------------------------------------------------------------------------

SQL_THETA = """cells AS (SELECT vec_id, label, i, CAST(embedding[i + 1] > 0 AS INTEGER) AS x FROM embeddings, range(64) r(i)),
n AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label),
theta AS (SELECT label, i, (sum(x) + 1) / (any_value(c) + 2) AS p FROM cells JOIN n USING (label) GROUP BY label, i)"""


@query("models_ml1_naive_bayes", f"""WITH {SQL_THETA},
prior AS (SELECT label, ln(c / (SELECT count(*) FROM embeddings)) AS lp FROM n),
s AS (SELECT vec_id, t.label, sum(CASE WHEN x = 1 THEN ln(p) ELSE ln(1 - p) END) + any_value(lp) AS score
  FROM cells c JOIN theta t USING (i) JOIN prior USING (label) GROUP BY vec_id, t.label)
SELECT vec_id, label AS prediction, round(score, 6) + 0 AS score FROM s
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""".replace("FROM cells c JOIN theta t USING (i) JOIN prior USING (label) GROUP BY vec_id, t.label", "FROM cells c JOIN theta t ON t.i = c.i JOIN prior q ON q.label = t.label GROUP BY vec_id, t.label"))
def naive_bayes(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = models.BernoulliNB("embedding", "label").fit(rows).transform(rows)
    return found.select("vec_id", "prediction", rounded(F.col("score")).alias("score"))


@query("models_ml2_class_probability", f"WITH {SQL_THETA} SELECT label, CAST(i AS INTEGER) AS pos, round(p, 6) + 0 AS p FROM theta")
def class_probability(spark, sf):
    model = models.BernoulliNB("embedding", "label").fit(table(spark, sf, "embeddings"))
    return model.probabilities(spark).withColumn("p", rounded(F.col("p")))


@query("models_ml3_draw_rows", f"""WITH {SQL_THETA},
draws AS (SELECT label, unnest(range((SELECT max(c) FROM n))) AS draw FROM n)
SELECT label, CAST(draw AS INTEGER) AS draw,
  string_agg(CAST(CAST(CAST('0x' || substr(md5(label || '-' || draw || '-' || i || '-42'), 1, 7) AS BIGINT) / 268435456.0::DOUBLE < p AS INTEGER) AS VARCHAR), '' ORDER BY i) AS bits
FROM draws JOIN theta USING (label) GROUP BY label, draw""")
def draw_rows(spark, sf):
    """As many drawn rows per class as the largest class has."""
    rows = table(spark, sf, "embeddings")
    model = models.BernoulliNB("embedding", "label").fit(rows)
    per_class = int(max(model.counts))
    drawn = models.draw_rows(model.probabilities(spark), per_class)
    return drawn.withColumn("bits", F.array_join(F.transform("bits", lambda b: b.cast("string")), ""))


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _lines(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return fe.assemble(fx.spread(rows), LINE_FEATURES)


@query("models_ml4_regression_tree")
def regression_tree(spark, sf):
    rows = _lines(spark, sf)
    model = models.regression_tree(label="l_extendedprice", max_depth=20).fit(rows)
    return quality.regression(model.transform(rows), "l_extendedprice", "prediction")


FOLD_SQL = "CAST('0x' || substr(md5(l_orderkey || '-' || l_partkey || '-' || l_linenumber), 1, 7) AS BIGINT) % 5"


def _folded(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", *LINE_FEATURES, "l_extendedprice")
    fold = F.conv(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")), 1, 7), 16, 10).cast("long") % 5
    return rows.withColumn("x", F.array(*[F.col(c).cast("double") for c in LINE_FEATURES])), fold


@query("models_ml5_random_search")
def random_search(spark, sf):
    """30 settings of the whole space in five folds."""
    rows, fold = _folded(spark, sf)
    _, tried = models.random_search(rows, "x", "l_extendedprice", fold)
    return spark.createDataFrame([(i, str(s), m) for i, (s, m) in enumerate(tried)], "draw int, setting string, mse double")


# The best split of one node: every feature and value, by least squares.
SQL_SPLITS = """cells AS (SELECT {key}f.f, f.v, count(*) AS n, sum(y) AS s FROM {rows},
  LATERAL (SELECT unnest([0, 1, 2, 3]) AS f, unnest([x0, x1, x2, x3]) AS v) f GROUP BY ALL),
below AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS nn, sum(s) OVER a AS ss FROM cells
  WINDOW w AS (PARTITION BY {key}f ORDER BY v), a AS (PARTITION BY {key}f)),
cut AS (SELECT * FROM below WHERE nl < nn
  QUALIFY row_number() OVER ({part} ORDER BY round((sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl) - ss * ss / nn) / (ss * ss / nn), 9) DESC, f, v) = 1)"""
SQL_LINES = f"""lines AS (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, CAST(l_linenumber AS DOUBLE) AS x3, l_extendedprice AS y,
  {FOLD_SQL} AS fold FROM lineitem)"""
SQL_TOLD = "CASE WHEN [x0, x1, x2, x3][f + 1] <= v THEN sl / nl ELSE (ss - sl) / (nn - nl) END"


@query("models_ml5_one_split", f"""WITH {SQL_LINES},
train AS (SELECT held, l.* FROM lines l, (SELECT unnest([0, 1, 2, 3, 4]) AS held) WHERE fold <> held),
{SQL_SPLITS.format(key="held, ", rows="train", part="PARTITION BY held")},
errors AS (SELECT fold, avg(pow(y - {SQL_TOLD}, 2)) AS mse FROM lines JOIN cut ON held = fold GROUP BY fold)
SELECT round(avg(mse), 1) + 0 AS mse FROM errors""")
def one_split_search(spark, sf):
    rows, fold = _folded(spark, sf)
    _, tried = models.random_search(rows, "x", "l_extendedprice", fold, {"max_depth": [1]}, n=1)
    return spark.createDataFrame([(m,) for _, m in tried], "mse double").select(rounded(F.col("mse"), 1).alias("mse"))


@query("models_ml4_one_split", f"""WITH {SQL_LINES}, {SQL_SPLITS.format(key="", rows="lines", part="")},
told AS (SELECT y, {SQL_TOLD} AS p FROM lines, cut) SELECT {{METRICS}} FROM told""".replace(
    "{METRICS}", "round(avg(pow(y - p, 2)), 1) + 0 AS mse, round(avg(abs(y - p)), 4) + 0 AS mae, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) + 0 AS r2"))
def one_split(spark, sf):
    """A tree of one split has a closed form."""
    rows, _ = _folded(spark, sf)
    model = models.fit_regression_tree(rows, "x", "l_extendedprice", models.binned.Setting(max_depth=1))
    found = quality.regression(model.transform(rows), "l_extendedprice", "prediction")
    return found.select(rounded(F.col("mse"), 1).alias("mse"), rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("r2")).alias("r2"))


@query("models_ml4_deep_tree")
def deep_tree(spark, sf):
    """The binned tree at depth 20 with ten rows a leaf."""
    rows, _ = _folded(spark, sf)
    model = models.fit_regression_tree(rows, "x", "l_extendedprice", models.binned.Setting(max_depth=20, min_leaf=10))
    return quality.regression(model.transform(rows), "l_extendedprice", "prediction")


def _boost(rounds=60):
    return models.Samme("embedding", "label", rounds=rounds)


@query("models_ml6_boosting")
def boosting(spark, sf):
    rows = table(spark, sf, "embeddings")
    train = fe.exact_split(rows, "vec_id", 0.8).filter("is_train").drop("is_train")
    found = _boost().fit(train).transform(rows)
    return found.select("vec_id", "label", "prediction", "confidence")


@query("models_ml6_one_round", """WITH
lines AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_returnflag AS y FROM lineitem),
cells AS (SELECT f.f, f.v, y, count(*) AS n FROM lines, LATERAL (SELECT unnest([0, 1, 2]) AS f, unnest([x0, x1, x2]) AS v) f GROUP BY ALL),
vals AS (SELECT DISTINCT f, v FROM cells), flags AS (SELECT DISTINCT y FROM cells),
below AS (SELECT f, v, y, sum(coalesce(n, 0)) OVER (PARTITION BY f, y ORDER BY v) AS nl, sum(coalesce(n, 0)) OVER (PARTITION BY f, y) AS na
  FROM vals CROSS JOIN flags LEFT JOIN cells USING (f, v, y)),
splits AS (SELECT f, v, sum(nl * nl) / nullif(sum(nl), 0) + sum((na - nl) * (na - nl)) / nullif(sum(na - nl), 0) AS pure FROM below GROUP BY f, v),
cut AS (SELECT f, v FROM splits WHERE pure IS NOT NULL ORDER BY round(pure, 6) DESC, f, v LIMIT 1),
told AS (SELECT nl > -1 AS l, max({'n': nl, 'o': -ascii(y), 'y': y}).y AS yl, max({'n': na - nl, 'o': -ascii(y), 'y': y}).y AS yr FROM below JOIN cut USING (f, v) GROUP BY 1)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN [x0, x1, x2][f + 1] <= v THEN yl ELSE yr END AS prediction FROM lines, cut, told""")
def one_round(spark, sf):
    """One round of depth one is the best single split by Gini impurity."""
    rows = table(spark, sf, "lineitem").withColumn("x", F.array(*[F.col(c).cast("double") for c in LINE_FEATURES[:3]]))
    found = models.Samme("x", "l_returnflag", rounds=1, depth=1).fit(rows).transform(rows)
    return found.select("l_orderkey", "l_partkey", "l_linenumber", "prediction")


@query("models_ml7_pseudo_labels")
def pseudo_labels(spark, sf):
    rows = table(spark, sf, "embeddings")
    halves = fe.exact_split(rows, "vec_id", 0.5)
    labelled, rest = halves.filter("is_train"), halves.filter("NOT is_train")
    first, second, added = models.pseudo_label(_boost(), labelled, rest, "vec_id", 1000)
    return added.select("vec_id", "prediction", "confidence")


@query("models_ml8_linear_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) + 0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0 AS intercept FROM lineitem""")
def linear_regression(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = models.linear_regression(rows, ["l_quantity"], "l_extendedprice")
    return rows.agg(F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept")).select(
        rounded(F.col("slope"), 4).alias("slope"), rounded(F.col("intercept"), 4).alias("intercept"))


def _wide_lines(spark, sf):
    made = fe.ratio_features(F.col("l_quantity"), F.col("l_tax"), "qt")
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice", *[c.alias(n) for n, c in made.items()])
    return rows, ["l_quantity", "l_discount", "l_tax", "l_linenumber", *made]


@query("models_ml9_lasso")
def lasso(spark, sf):
    rows, names = _wide_lines(spark, sf)
    kept = models.lasso_select(rows, names, "l_extendedprice", alpha=0.01)
    return spark.createDataFrame(kept, "feature string, coefficient double")


@query("models_ml10_elimination")
def elimination(spark, sf):
    rows, names = _wide_lines(spark, sf)
    return spark.createDataFrame([(f,) for f in models.rfe(rows, names, "l_extendedprice", 5)], "feature string")


@query("models_ml9_lasso_single", """
WITH c AS (SELECT covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS c FROM lineitem)
SELECT 'l_quantity' AS feature, round(sign(c) * greatest(abs(c) - 100, 0), 4) + 0 AS coefficient FROM c WHERE abs(c) > 100""")
def lasso_single(spark, sf):
    """One standardised feature has a closed form: the covariance, shrunk by the penalty."""
    kept = models.lasso_select(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", alpha=100.0)
    return spark.createDataFrame(kept, "feature string, coefficient double").withColumn("coefficient", rounded(F.col("coefficient"), 4))


@query("models_ml10_elimination_pair", """
WITH c AS (SELECT var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd,
  covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy FROM lineitem)
SELECT CASE WHEN abs((dd * qy - qd * dy) * sqrt(qq)) >= abs((qq * dy - qd * qy) * sqrt(dd)) THEN 'l_quantity' ELSE 'l_discount' END AS feature FROM c""")
def elimination_pair(spark, sf):
    kept = models.rfe(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 1)
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("sets_st5_feature_union")
def feature_union(spark, sf):
    rows, names = _wide_lines(spark, sf)
    both = {*models.rfe(rows, names, "l_extendedprice", 5), *[f for f, _ in models.lasso_select(rows, names, "l_extendedprice")]}
    return spark.createDataFrame([(f,) for f in sorted(both)], "feature string")


@query("sets_st5_feature_union_pair", """
WITH c AS (SELECT var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd,
  covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy, stddev_pop(l_quantity) AS sq FROM lineitem)
SELECT CASE WHEN abs((dd * qy - qd * dy) * sqrt(qq)) >= abs((qq * dy - qd * qy) * sqrt(dd)) THEN 'l_quantity' ELSE 'l_discount' END AS feature FROM c
UNION SELECT 'l_quantity' FROM c WHERE abs(qy / sq) > 100""")
def feature_union_pair(spark, sf):
    rows = table(spark, sf, "lineitem")
    both = {*models.rfe(rows, ["l_quantity", "l_discount"], "l_extendedprice", 1),
            *[f for f, _ in models.lasso_select(rows, ["l_quantity"], "l_extendedprice", alpha=100.0)]}
    return spark.createDataFrame([(f,) for f in sorted(both)], "feature string")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("v", array_to_vector("embedding"))


@query("models_ml11_kmeans")
def kmeans(spark, sf):
    rows = _vectors(spark, sf)
    return models.kmeans(rows, "v", 10).transform(rows).select("vec_id", "prediction")


# Rounds of k-means from the first four vectors.
def _lloyd_sql(rounds: int) -> str:
    parts = ["e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
             "c0 AS (SELECT CAST(vec_id AS INTEGER) AS cluster, x FROM e WHERE vec_id < 4)"]
    for r in range(rounds + 1):
        parts.append(f"""n{r} AS MATERIALIZED (SELECT vec_id, e.x, cluster, round(pow(list_distance(e.x, c.x), 2), 9) AS far FROM e, c{r} c
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS x FROM (
  SELECT cluster, i, avg(x[i]) AS m FROM n{r}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster)""")
    return ",\n".join(parts)


def _lloyd(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    start = [r["embedding"] for r in rows.filter("vec_id < 4").orderBy("vec_id").collect()]  # four rows
    return models.lloyd(rows, "vec_id", "embedding", models.np.array(start, float), 3)


@query("models_ml11_lloyd", f"WITH {_lloyd_sql(3)} SELECT vec_id, cluster FROM n3")
def lloyd(spark, sf):
    return _lloyd(spark, sf)[0].select(F.col("key").alias("vec_id"), "cluster")


@query("models_ml12_lloyd_inertia", f"WITH {_lloyd_sql(3)} SELECT round(sum(far), 4) + 0 AS inertia FROM n3")
def lloyd_inertia(spark, sf):
    return spark.createDataFrame([(_lloyd(spark, sf)[2],)], "inertia double").select(rounded(F.col("inertia"), 4).alias("inertia"))


@query("models_ml11_before_after")
def before_after(spark, sf):
    """Each number of clusters by inertia and silhouette, on all features and on their two principal components."""
    rows = _vectors(spark, sf)
    projected, _ = models.pca(rows, "v", 2)
    projected = projected.withColumn("two", vector_to_array("pca"))
    ks = list(range(2, 7))
    before = models.choose_k(rows, "embedding", ks).withColumn("space", F.lit("all"))
    return before.unionByName(models.choose_k(projected, "two", ks).withColumn("space", F.lit("pca")))


@query("models_ml12_elbow")
def elbow(spark, sf):
    return models.elbow(_vectors(spark, sf), "v", list(range(2, 11)))


@query("models_ml12_inertia_of_one", """
WITH x AS (SELECT i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
s AS (SELECT var_pop(v) * count(*) AS ss FROM x GROUP BY i) SELECT CAST(1 AS INTEGER) AS k, round(sum(ss), 4) + 0 AS inertia FROM s""")
def inertia_of_one(spark, sf):
    return models.elbow(_vectors(spark, sf), "v", [1]).withColumn("inertia", rounded(F.col("inertia"), 4))


@query("models_ml13_pca")
def pca(spark, sf):
    rows, shares = models.pca(_vectors(spark, sf), "v", 2)
    v = vector_to_array("pca")
    return rows.select("vec_id", F.get(v, F.lit(0)).alias("c1"), F.get(v, F.lit(1)).alias("c2")).withColumn("explained", F.lit(sum(shares)))


@query("models_ml13_pca_pair", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS b,
  covar_samp(l_quantity, l_extendedprice / 1000) AS c FROM lineitem),
e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS l FROM m)
SELECT l_orderkey, l_partkey, l_linenumber, round(abs((l_quantity - mx) * c + (l_extendedprice / 1000 - my) * (l - a)) / sqrt(c * c + (l - a) * (l - a)) + 1e-9, 4) + 0 AS size,
  round(l / (a + b), 6) + 0 AS explained FROM lineitem, e""")
def pca_pair(spark, sf):
    """Two features have a closed form; the sign of a component is free."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", array_to_vector(
        F.array("l_quantity", F.col("l_extendedprice") / 1000)).alias("v"))
    found, shares = models.pca(rows, "v", 1)
    size = F.abs(F.get(vector_to_array("pca"), F.lit(0)))
    return found.select("l_orderkey", "l_partkey", "l_linenumber", rounded(size + 1e-9, 4).alias("size"), rounded(F.lit(shares[0])).alias("explained"))


@query("models_ml14_majority", """
SELECT user_id, CAST(sum(CAST(event_type IN ('click', 'view') AS INTEGER)) AS BIGINT) AS yes, CAST(count(*) AS BIGINT) AS n,
  sum(CAST(event_type IN ('click', 'view') AS INTEGER)) > count(*) // 2 AS correct FROM events GROUP BY user_id""")
def majority(spark, sf):
    votes = table(spark, sf, "events").select("user_id", F.col("event_type").isin("click", "view").cast("int").alias("vote"))
    return models.majority_vote(votes, "user_id", "vote")


# ---- quality ------------------------------------------------------------------------

SQL_LINE_FIT = """fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem),
pred AS (SELECT l_extendedprice AS y, w * l_quantity + b AS p FROM lineitem, fit)"""


def _line_predictions(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = models.linear_regression(rows, ["l_quantity"], "l_extendedprice")
    return rows.withColumn("p", F.lit(float(model.coefficients[0])) * F.col("l_quantity") + F.lit(float(model.intercept)))


METRICS = """round(avg(pow(y - p, 2)), 1) + 0 AS mse, round(avg(abs(y - p)), 4) + 0 AS mae, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) + 0 AS r2"""


@query("quality_mq1_regression", f"WITH {SQL_LINE_FIT} SELECT {METRICS} FROM pred")
def regression(spark, sf):
    found = quality.regression(_line_predictions(spark, sf), "l_extendedprice", "p")
    return found.select(rounded(F.col("mse"), 1).alias("mse"), rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("r2")).alias("r2"))


@query("quality_mq2_accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) + 0 AS accuracy FROM labels")
def accuracy(spark, sf):
    return quality.accuracy(table(spark, sf, "labels"), "quality", "toxic").select(rounded(F.col("accuracy")).alias("accuracy"))


@query("quality_mq3_confusion", "SELECT quality AS actual, toxic AS predicted, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY ALL")
def confusion(spark, sf):
    return quality.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("quality_mq4_silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, count(*) AS size FROM e GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total FROM e a, e b GROUP BY ALL),
m AS (SELECT vec_id, d.label, max(CASE WHEN d.label = other THEN total / nullif(size - 1, 0) END) AS a,
  min(CASE WHEN d.label <> other THEN total / size END) AS b, max(CASE WHEN d.label = other THEN size END) AS own FROM d JOIN n ON n.label = other GROUP BY ALL)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN own = 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0 AS silhouette FROM m GROUP BY label""")
def silhouette(spark, sf):
    return quality.silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").withColumn("silhouette", rounded(F.col("silhouette")))


@query("quality_mq4_squared_silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, count(*) AS size FROM e GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.x, b.x), 2)) AS total FROM e a, e b GROUP BY ALL),
m AS (SELECT vec_id, d.label, max(CASE WHEN d.label = other THEN total / nullif(size - 1, 0) END) AS a,
  min(CASE WHEN d.label <> other THEN total / size END) AS b, max(CASE WHEN d.label = other THEN size END) AS own FROM d JOIN n ON n.label = other GROUP BY ALL)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN own = 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0 AS silhouette FROM m GROUP BY label""")
def squared_silhouettes(spark, sf):
    found = quality.squared_silhouettes(table(spark, sf, "embeddings"), "embedding", "label")
    return found.withColumn("silhouette", rounded(F.col("silhouette")))


@query("quality_mq5_comparison", f"""WITH {SQL_LINE_FIT},
a AS (SELECT avg(pow(y - (SELECT avg(l_extendedprice) FROM lineitem), 2)) AS mse, avg(abs(y - (SELECT avg(l_extendedprice) FROM lineitem))) AS mae FROM pred),
b AS (SELECT avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae FROM pred)
SELECT 'mse' AS metric, round(a.mse, 1) + 0 AS baseline, round(b.mse, 1) + 0 AS improved, round(b.mse - a.mse, 1) + 0 AS delta FROM a, b UNION ALL
SELECT 'mae', round(a.mae, 1) + 0, round(b.mae, 1) + 0, round(b.mae - a.mae, 1) + 0 FROM a, b""")
def comparison(spark, sf):
    rows = _line_predictions(spark, sf)
    mean = table(spark, sf, "lineitem").agg(F.avg("l_extendedprice")).scalar()
    base = quality.regression(rows.withColumn("m", mean), "l_extendedprice", "m").select("mse", "mae")
    found = quality.compare(base, quality.regression(rows, "l_extendedprice", "p").select("mse", "mae"))
    return found.select("metric", *[rounded(F.col(c), 1).alias(c) for c in ("baseline", "improved", "delta")])


# ---- explanations -------------------------------------------------------------------

SQL_TWO = """c AS (SELECT var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd,
  covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy,
  avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my FROM lineitem),
w AS (SELECT (dd * qy - qd * dy) / (qq * dd - qd * qd) AS wq, (qq * dy - qd * qy) / (qq * dd - qd * qd) AS wd, * FROM c),
phi AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, wq * (l_quantity - mq) AS phi_q, wd * (l_discount - md) AS phi_d, my AS base FROM lineitem, w)"""
TWO = ["l_quantity", "l_discount"]


def _explained(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = models.linear_regression(rows, TWO, "l_extendedprice")
    return explain.linear_shap(rows, TWO, [float(w) for w in model.coefficients], float(model.intercept), rows)


@query("explain_xp1_linear", f"""WITH {SQL_TWO}
SELECT l_orderkey, l_linenumber, l_partkey, round(phi_q, 3) + 0 AS phi_q, round(phi_d, 3) + 0 AS phi_d, round(base, 3) + 0 AS base FROM phi""")
def linear(spark, sf):
    return _explained(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("phi_l_quantity"), 3).alias("phi_q"),
        rounded(F.col("phi_l_discount"), 3).alias("phi_d"), rounded(F.col("base"), 3).alias("base"))


def _tree_explained(spark, sf):
    rows = _lines(spark, sf)
    model = models.regression_tree(label="l_extendedprice", max_depth=5).fit(rows)
    plain = model.transform(rows).drop("features")
    return explain.tree_shap(plain, LINE_FEATURES, model)


@query("explain_xp2_tree")
def tree(spark, sf):
    return _tree_explained(spark, sf)


@query("explain_xp2_tree_adds_up", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, round((SELECT avg(l_extendedprice) FROM lineitem), 2) + 0 AS base, 0.0::DOUBLE AS gap FROM lineitem""")
def tree_adds_up(spark, sf):
    """Base (the mean label) plus all parts is the prediction of every row."""
    parts = sum((F.col(f"phi_{c}") for c in LINE_FEATURES), F.col("base"))
    return _tree_explained(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", rounded(F.col("base"), 2).alias("base"),
        rounded(parts - F.col("prediction"), 4).alias("gap"))


@query("explain_xp2_one_split", f"""WITH {SQL_LINES.replace("lines AS (SELECT", "lines AS (SELECT l_orderkey, l_partkey, l_linenumber,", 1)}, {SQL_SPLITS.format(key="", rows="lines", part="")},
parts AS (SELECT l_orderkey, l_partkey, l_linenumber, f, ss / nn AS base, {SQL_TOLD} - ss / nn AS phi FROM lines, cut)
SELECT l_orderkey, l_partkey, l_linenumber, round(base, 3) + 0 AS base, {", ".join(f"round(CASE WHEN f = {i} THEN phi ELSE 0.0 END, 3) + 0 AS phi_{i}" for i in range(4))} FROM parts""")
def one_split_parts(spark, sf):
    """The parts of a tree of one split: all of the step belongs to the feature split on."""
    rows, _ = _folded(spark, sf)
    model = models.fit_regression_tree(rows, "x", "l_extendedprice", models.binned.Setting(max_depth=1))
    found = explain.tree_shap(rows.drop("x"), LINE_FEATURES, model.node())
    return found.select("l_orderkey", "l_partkey", "l_linenumber", rounded(F.col("base"), 3).alias("base"),
                        *[rounded(F.col(f"phi_{c}"), 3).alias(f"phi_{i}") for i, c in enumerate(LINE_FEATURES)])


def _deep_explained(spark, sf):
    rows, _ = _folded(spark, sf)
    model = models.fit_regression_tree(rows, "x", "l_extendedprice", models.binned.Setting(max_depth=20, min_leaf=10))
    return explain.tree_shap(model.transform(rows).drop("x"), LINE_FEATURES, model.node())


@query("explain_xp2_deep_tree")
def deep_tree_parts(spark, sf):
    """Parts of the tree at full depth."""
    return _deep_explained(spark, sf)


@query("explain_xp5_deep_dependence")
def deep_dependence(spark, sf):
    return explain.dependence(_deep_explained(spark, sf), "l_quantity", "l_orderkey")


@query("explain_xp3_importance", f"""WITH {SQL_TWO}
SELECT 'l_quantity' AS feature, round(avg(abs(phi_q)), 3) + 0 AS importance FROM phi UNION ALL SELECT 'l_discount', round(avg(abs(phi_d)), 3) + 0 FROM phi""")
def importance(spark, sf):
    return explain.global_importance(_explained(spark, sf), TWO).withColumn("importance", rounded(F.col("importance"), 3))


@query("explain_xp4_local", f"""WITH {SQL_TWO},
k AS (SELECT *, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS id, round(phi_q + phi_d, 3) AS p FROM phi),
ends AS (SELECT 'high' AS which, * FROM (SELECT * FROM k ORDER BY p DESC, id LIMIT 1) UNION ALL SELECT 'low', * FROM (SELECT * FROM k ORDER BY p, id LIMIT 1)),
parts AS (SELECT which, id, 'l_quantity' AS feature, l_quantity AS x, phi_q AS phi FROM ends UNION ALL SELECT which, id, 'l_discount', l_discount, phi_d FROM ends)
SELECT which, id, feature, x, round(phi, 3) + 0 AS phi, CAST(row_number() OVER (PARTITION BY which ORDER BY abs(phi) DESC, feature) AS INTEGER) AS position FROM parts""")
def local(spark, sf):
    key = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    rows = _explained(spark, sf).withColumn("id", key).withColumn("p", F.round(F.col("phi_l_quantity") + F.col("phi_l_discount"), 3))
    return explain.local(rows, TWO, "id", "p").withColumn("phi", rounded(F.col("phi"), 3))


@query("explain_xp5_dependence")
def dependence(spark, sf):
    return explain.dependence(_tree_explained(spark, sf), "l_quantity", "l_orderkey")


@query("explain_xp6_names", """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS pos, name FROM (SELECT unnest(['price'] || list_transform(list_sort(list(DISTINCT o_orderpriority)), lambda v: 'priority_' || v)
  || ['topic1', 'topic2']) AS name FROM orders)""")
def names(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    model = fe.OneHot(["priority"]).fit(rows)
    return explain.feature_name_table(model.names(), model.sizes, ["price"], 2)
