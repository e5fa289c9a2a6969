"""Queries on templates, classes, documents and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantopo.operators import match as M
from scantopo.operators import stats as S
from scantopo.operators import text as X
from scantopo.plans.catalogue import query, table
from scantopo.plans.topology_queries import as_longs

#: A template is every vector whose id is divisible by 10; the others ask.
V = """v AS (SELECT vec_id, label, (SELECT sum(CASE WHEN e > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END) FROM (SELECT unnest(embedding[1:32]) AS e, generate_subscripts(embedding[1:32], 1) AS i)) AS a,
 (SELECT sum(CASE WHEN e > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END) FROM (SELECT unnest(embedding[33:64]) AS e, generate_subscripts(embedding[33:64], 1) AS i)) AS b FROM embeddings),
t AS (SELECT * FROM v WHERE vec_id % 10 = 0), q AS (SELECT * FROM v WHERE vec_id % 10 <> 0),
d AS (SELECT q.vec_id AS query_id, q.label AS truth, t.label, min(bit_count(CAST(xor(CAST(q.a AS BIGINT), CAST(t.a AS BIGINT)) AS BIGINT)) + bit_count(CAST(xor(CAST(q.b AS BIGINT), CAST(t.b AS BIGINT)) AS BIGINT))) AS distance FROM q, t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, label) AS rank FROM d)"""


def signs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", M.sign_words(F.col("embedding")).alias("w"))
    asks = v.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.col("w").alias("qw"))
    return asks, v.filter("vec_id % 10 = 0").select("label", F.col("w").alias("tw"))


def ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q, t = signs(spark, sf_dir)
    return M.classify(q, t, M.hamming(F.col("qw"), F.col("tw")), k).join(q.select("query_id", "truth"), "query_id")


@query("knn_label_topk", f"WITH {V} SELECT query_id, rank, CAST(label AS BIGINT) AS label, CAST(distance AS BIGINT) AS distance FROM k WHERE rank <= 3")
def knn_label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(ranked(spark, sf_dir, 3).select("query_id", "rank", "label", "distance"), "rank", "label", "distance")


@query("knn_margin", f"WITH {V} SELECT a.query_id, CAST(a.label AS BIGINT) AS label, CAST(b.distance - a.distance AS DOUBLE) AS margin FROM k a JOIN k b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2")
def knn_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(M.margins(ranked(spark, sf_dir, 2)), "label")


@query("confusion", f"WITH {V} SELECT CAST(truth AS BIGINT) AS truth, CAST(label AS BIGINT) AS pred, count(*) AS n FROM k WHERE rank = 1 AND truth <> label GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(M.confusion(ranked(spark, sf_dir, 1).withColumnRenamed("label", "pred")), "truth", "pred")


@query("bitmap_hamming", f"""WITH {V}, f AS (SELECT arg_min(a, vec_id) AS ta, arg_min(b, vec_id) AS tb, label AS template FROM v GROUP BY label)
SELECT CAST(template AS BIGINT) AS template, CAST(min(d) AS BIGINT) AS least, CAST(max(d) AS BIGINT) AS most, CAST(sum(d) AS BIGINT) AS total, count(*) AS n FROM (SELECT template, bit_count(xor(CAST(a AS BIGINT), CAST(ta AS BIGINT))) + bit_count(xor(CAST(b AS BIGINT), CAST(tb AS BIGINT))) AS d FROM v, f) GROUP BY template""")
def bitmap_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of all bitmaps to a template of each label, its first."""
    w = table(spark, sf_dir, "embeddings").select("vec_id", "label", M.sign_words(F.col("embedding")).alias("w"))
    t = w.groupBy(F.col("label").alias("template")).agg(F.min_by("w", "vec_id").alias("t"))
    d = M.to_all(w, t).select("template", M.hamming(F.col("w"), F.col("t")).alias("d")).groupBy("template")
    return as_longs(d.agg(F.min("d").alias("least"), F.max("d").alias("most"), F.sum("d").alias("total"), F.count(F.lit(1)).alias("n")), "template", "least", "most", "total")


@query("agrees_semijoin", f"WITH {V} SELECT query_id, CAST(label AS BIGINT) AS label FROM k WHERE rank <= 3 AND EXISTS (SELECT 1 FROM t JOIN q ON q.vec_id = query_id WHERE t.label = k.label AND abs(bit_count(CAST(t.a AS BIGINT)) - bit_count(CAST(q.a AS BIGINT))) <= 1)")
def agrees_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = signs(spark, sf_dir)
    c = ranked(spark, sf_dir, 3).select("query_id", "label")
    first = lambda w: F.bit_count(F.element_at(w, 1))
    near = F.abs(first(F.col("t.tw")) - first(F.col("c.qw"))) <= 1
    return as_longs(M.agree(c, q.select("query_id", "qw", F.lit(True).alias("has_signature")), t, near), "label")


@query("verifier_verdicts", f"""WITH {V}, o AS (SELECT query_id, truth = label AS ok, EXISTS (SELECT 1 FROM t JOIN q ON q.vec_id = query_id WHERE t.label = k.label AND abs(bit_count(CAST(t.a AS BIGINT)) - bit_count(CAST(q.a AS BIGINT))) <= 1) AS agreed FROM k WHERE rank = 1)
SELECT CASE WHEN ok AND agreed THEN 'correct' WHEN agreed THEN 'silently wrong' WHEN ok THEN 'abstained' ELSE 'detected' END AS verdict, count(*) AS n FROM o GROUP BY ALL""")
def verifier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of each query, told right or wrong, against a verifier by other features."""
    q, t = signs(spark, sf_dir)
    c = ranked(spark, sf_dir, 1).select("query_id", "label", "truth")
    first = lambda w: F.bit_count(F.element_at(w, 1))
    kept = M.agree(c, q.select("query_id", "qw", F.lit(True).alias("has_signature")), t, F.abs(first(F.col("t.tw")) - first(F.col("c.qw"))) <= 1)
    o = c.join(kept.select("query_id", F.lit(True).alias("agreed")), "query_id", "left")
    right = F.col("truth") == F.col("label")
    verdict = F.when(right & F.col("agreed"), "correct").when(F.col("agreed"), "silently wrong").when(right, "abstained").otherwise("detected")
    return o.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("loo_nn", """WITH a AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer), z AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS g, (c_acctbal - m) / s AS z FROM customer, a),
p AS (SELECT x.id, y.id AS near, (x.z - y.z) ** 2 AS d2 FROM z x JOIN z y ON x.g = y.g AND x.n <> y.n) SELECT id, arg_min(near, struct_pack(d := d2, i := near)) AS near, round(min(d2), 9) AS d2 FROM p GROUP BY id""")
def loo_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("z"))
    return M.leave_one_out(M.zscores(c, ["z"]), ["z"], "g", "n").select("id", "near", F.round("d2", 9).alias("d2"))


_BINS = """b AS (SELECT l_returnflag AS y, (SELECT count(*) FROM (SELECT unnest(q) AS e) WHERE e < l_extendedprice) AS x1, (SELECT count(*) FROM (SELECT unnest(p) AS e) WHERE e < l_discount) AS d16, dense_rank() OVER (ORDER BY l_discount) - 1 AS x2, l_linestatus AS x3 FROM lineitem,
 (SELECT quantile_cont(l_extendedprice, [i / 16.0::DOUBLE FOR i IN range(1, 16)]) AS q, quantile_cont(l_discount, [i / 16.0::DOUBLE FOR i IN range(1, 16)]) AS p FROM lineitem))"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), "l_extendedprice", "l_discount", F.col("l_linestatus").alias("x3"))
    t = S.equal_frequency(t, [], "l_extendedprice").withColumnRenamed("bin", "x1")
    return S.equal_frequency(t, [], "l_discount").withColumnRenamed("bin", "x2")


def _h(cols: str) -> str:
    return f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM b GROUP BY {cols}))"


@query("equal_freq_bins", f"WITH {_BINS} SELECT CAST(x1 AS BIGINT) AS price_bin, CAST(x2 AS BIGINT) AS discount_bin, count(*) AS n FROM b GROUP BY ALL")
def equal_freq_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_longs(_bins(spark, sf_dir).groupBy(F.col("x1").alias("price_bin"), F.col("x2").alias("discount_bin")).agg(F.count(F.lit(1)).alias("n")), "price_bin", "discount_bin")


@query("mutual_information", f"WITH {_BINS} SELECT 'price' AS feature, round(greatest(0, {_h('x1')} + {_h('y')} - {_h('x1, y')}) / {_h('y')}, 8) AS mi, round({_h('x1')} / {_h('y')}, 8) AS ceiling UNION ALL SELECT 'status', round(greatest(0, {_h('x3')} + {_h('y')} - {_h('x3, y')}) / {_h('y')}, 8), round({_h('x3')} / {_h('y')}, 8)")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bins(spark, sf_dir)
    one = lambda name, c: S.information(b, [], "y", c).select(F.lit(name).alias("feature"), F.round("mi", 8).alias("mi"), F.round("ceiling", 8).alias("ceiling"))
    return one("price", "x1").unionAll(one("status", "x3"))


@query("joint_mi", f"WITH {_BINS} SELECT round(greatest(0, {_h('x1, x2, x3')} + {_h('y')} - {_h('x1, x2, x3, y')}) / {_h('y')}, 8) AS mi, round({_h('x1, x2, x3')} / {_h('y')}, 8) AS ceiling")
def joint_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.information(_bins(spark, sf_dir), [], "y", "x1", "x2", "x3").select(F.round("mi", 8).alias("mi"), F.round("ceiling", 8).alias("ceiling"))


@query("convexity", """WITH s AS (SELECT c_mktsegment AS class, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY ALL), b AS (SELECT class, v[CAST(floor((len(v) - 1) * 0.1::DOUBLE) AS BIGINT) + 1] AS lo, v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS hi FROM s WHERE len(v) >= 2)
SELECT class, round(count(*) FILTER (c_mktsegment = class) / count(*), 9) AS purity FROM customer, b WHERE c_acctbal >= lo AND c_acctbal <= hi GROUP BY class""")
def convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.convexity(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment").select("class", F.round("purity", 9).alias("purity"))


@query("font_coverage_rollup", "SELECT CASE WHEN grouping(split_part(event_type, '_', 1)) = 1 THEN 'all' ELSE split_part(event_type, '_', 1) END AS family, event_type AS class, CAST(sum(user_id % 7) AS BIGINT) AS n FROM events GROUP BY GROUPING SETS ((event_type), (split_part(event_type, '_', 1), event_type))")
def font_coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.split_part("event_type", F.lit("_"), F.lit(1)).alias("family"), F.col("event_type").alias("class"), "user_id")
    r = S.share_of_classes(e, "family", "class", F.pmod("user_id", F.lit(7)))
    return r.select(F.when(F.col("all_families") == 1, "all").otherwise(F.col("family")).alias("family"), "class", "n")


@query("ratio_denominators", "SELECT l_linestatus AS side, l_returnflag AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 9) AS of_side, round(count(*) / sum(count(*)) OVER (), 9) AS of_all FROM lineitem GROUP BY l_linestatus, l_returnflag")
def ratio_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("side"), F.col("l_returnflag").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda w: F.round(F.col("n") / F.sum("n").over(w), 9)
    return n.withColumns({"of_side": of(Window.partitionBy("side")), "of_all": of(Window.partitionBy())})


@query("two_tier_lookup", """WITH r AS (SELECT p_name AS name, p_partkey AS record, p_size > 25 AS preferred, p_partkey AS pos FROM part), k AS (SELECT upper(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS k, arg_min(record, struct_pack(a := NOT preferred, b := pos)) AS r FROM r GROUP BY ALL),
e AS (SELECT name AS k, arg_min(record, struct_pack(a := NOT preferred, b := pos)) AS r FROM r GROUP BY ALL), n AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_brand END AS name FROM part)
SELECT n.name, coalesce(e.r, k.r, -1) AS record, CASE WHEN e.r IS NOT NULL THEN 'exact' WHEN k.r IS NOT NULL THEN 'normalised' ELSE 'UNRESOLVED' END AS tier FROM n LEFT JOIN e ON e.k = n.name LEFT JOIN k ON k.k = upper(regexp_replace(n.name, '[^A-Za-z]', '', 'g'))""")
def two_tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    m = F.pmod("p_partkey", F.lit(3))
    names = p.select(F.when(m == 0, F.col("p_name")).when(m == 1, F.upper("p_name")).otherwise(F.col("p_brand")).alias("name")).distinct()
    records = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("record"), (F.col("p_size") > 25).alias("preferred"), F.col("p_partkey").alias("pos"))
    found = M.two_tier(names, records, lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z]", "")))
    return found.select("name", F.coalesce("record", F.lit(-1)).alias("record"), "tier")


@query("flag_findings", """SELECT o_orderkey, CASE WHEN d = 0 THEN 'clean' WHEN c > 2 THEN 'component' WHEN d <= 7 THEN 'noise' WHEN s THEN 'stable' ELSE 'weak' END AS flag FROM (
SELECT o_orderkey, CAST(abs(o_totalprice - coalesce(p, 0)) / 1000 AS BIGINT) AS d, abs(coalesce(n, 0) - 4) AS c, o_orderstatus = 'F' AS s FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey)""")
def flag_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("n"))
    j = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    d = F.rint(F.abs(F.col("o_totalprice") - F.coalesce("p", F.lit(0.0))) / 1000).cast("long")
    return j.select("o_orderkey", S.flag(d, F.abs(F.coalesce("n", F.lit(0)) - 4), F.col("o_orderstatus") == "F").alias("flag"))


_POS = "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, {v} AS v FROM orders WHERE {w}"


@query("positional_diff", f"WITH a AS ({_POS.format(v='o_orderpriority', w='o_orderkey % 2 = 0')}), b AS ({_POS.format(v='o_orderpriority', w='o_orderkey % 2 = 1')}) SELECT k AS o_custkey, pos, a.v AS \"left\", b.v AS \"right\" FROM a FULL JOIN b USING (k, pos) WHERE a.v IS DISTINCT FROM b.v")
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd and even orders of each customer as two builds of one list."""
    o = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos")
    side = lambda r: o.filter(F.pmod("o_orderkey", F.lit(2)) == r).select("o_custkey", pos, "o_orderpriority")
    return as_longs(M.positional_diff(side(0), side(1), ["o_custkey"], "o_orderpriority"), "pos")


@query("positional_join", """WITH r AS (SELECT conv_id, turn AS pos FROM conversations WHERE role = 'user'), i AS (SELECT conv_id, turn AS id FROM conversations WHERE role <> 'user'),
s AS (SELECT conv_id, CASE WHEN n <> span THEN 'rows not contiguous' WHEN coalesce(m, 0) < n THEN 'too few ids' END AS excluded FROM (SELECT conv_id, count(*) AS n, max(pos) - min(pos) + 1 AS span FROM r GROUP BY ALL) LEFT JOIN (SELECT conv_id, count(*) AS m FROM i GROUP BY ALL) USING (conv_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS k FROM i)
SELECT conv_id, pos, id, NULL::VARCHAR AS excluded FROM a JOIN b USING (conv_id, k) JOIN s USING (conv_id) WHERE s.excluded IS NULL UNION ALL SELECT conv_id, -1, -1, excluded FROM s WHERE excluded IS NOT NULL""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows, ids = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("pos")), c.filter("role <> 'user'").select("conv_id", F.col("turn").alias("id"))
    found = M.positional_join(rows, ids, "conv_id")
    return found.select("conv_id", *[F.coalesce(k, F.lit(-1)).cast("long").alias(k) for k in ("pos", "id")], "excluded")


@query("noise_floor_p95", "SELECT event_type, list_sort(list(value))[greatest(0, CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT) - 1) + 1] AS value FROM events GROUP BY event_type")
def noise_floor_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.order_statistic(table(spark, sf_dir, "events"), ["event_type"], "value", F.floor(F.lit(0.95) * F.col("n")) - 1)


@query("quarantine", "SELECT CASE WHEN m > 490 THEN 'dropped' ELSE 'measured' END AS status, CASE WHEN m > 490 THEN 'overlap' ELSE '' END AS reason, count(*) AS docs, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT user_id, max(value) AS m, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quarantine(table(spark, sf_dir, "events"), "user_id", "value", 490)


@query("null_model", "SELECT l_returnflag AS flag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 9) AS rate, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0 END), 9) AS null_rate, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END) / nullif(avg(CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0 END), 0), 9) AS lift FROM lineitem GROUP BY ALL")
def null_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.enrichment(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)
    return e.select(F.col("l_returnflag").alias("flag"), *[F.round(k, 9).alias(k) for k in ("rate", "null_rate", "lift")])


@query("parameter_grid", "SELECT g, e, count(*) FILTER (l_discount <= g) AS near, count(*) FILTER (l_tax <= e) AS edge, count(*) FILTER (l_discount <= g AND l_tax > e) AS out FROM lineitem, (SELECT unnest([0.02, 0.05, 0.08])::DOUBLE AS g), (SELECT unnest([0.01, 0.03])::DOUBLE AS e) GROUP BY g, e")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(g, e) for g in (0.02, 0.05, 0.08) for e in (0.01, 0.03)], "g double, e double")
    near, edge = F.col("l_discount") <= F.col("g"), F.col("l_tax") <= F.col("e")
    return S.grid_tally(table(spark, sf_dir, "lineitem"), grid, {"near": near, "edge": edge, "out": near & ~edge})


@query("equivalence_classes", "SELECT CAST(least(n, 7) AS BIGINT) AS k1, u AS k2, count(*) AS size, min(page) AS first FROM (SELECT l_orderkey AS page, count(*) AS n, count(DISTINCT l_returnflag) AS u FROM lineitem GROUP BY ALL) GROUP BY ALL")
def equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("u"))
    return p.groupBy(F.least("n", F.lit(7)).cast("long").alias("k1"), F.col("u").alias("k2")).agg(F.count(F.lit(1)).alias("size"), F.min("page").alias("first"))


TEX = r"""list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '%[^\n]*', '', 'g'), '\$[^$]*\$', ' ', 'g'), '\\[A-Za-z]+\*?(\[[^\]]*\])?', ' ', 'g'), '[{}~\\]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"""


@query("tex_words", f"SELECT doc_id, CAST(len({TEX}) AS BIGINT) AS n, md5(array_to_string({TEX}, ' ')) AS digest FROM documents")
def tex_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.tex_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("char_substitutions", """WITH a AS (SELECT user_id, event_type AS t, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u FROM events), b AS (SELECT CAST(user_id AS VARCHAR) || t AS x, CAST(user_id + 1 AS VARCHAR) || t AS y FROM a WHERE u IS NOT NULL),
d AS (SELECT x, y, [i FOR i IN range(1, length(x) + 1) IF substr(x, i, 1) <> substr(y, i, 1)] AS p FROM b WHERE length(x) = length(y)) SELECT substr(x, p[1], 1) AS old, substr(y, p[1], 1) AS new, count(*) AS n FROM d WHERE len(p) = 1 GROUP BY ALL""")
def char_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.withColumn("u", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("u is not null")
    pairs = a.select(F.concat(F.col("user_id").cast("string"), "event_type").alias("x"), F.concat((F.col("user_id") + 1).cast("string"), "event_type").alias("y"))
    return X.substitutions(pairs, "x", "y")


@query("word_alignment")
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of a language against the next one, the last against none: aligned blocks of words and one-letter
    differences."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    nxt = F.lead("text").over(Window.partitionBy("lang").orderBy("doc_id"))
    return X.align(d.withColumn("other", F.coalesce(nxt, F.lit(""))), "doc_id", "text", "other")


@query("page_number", r"SELECT url, coalesce(CAST(nullif(regexp_extract(url, '/[a-z]*0*([0-9]+)(#.*)?$', 1), '') AS BIGINT), -1) AS number FROM pages")
def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.coalesce(X.trailing_number(F.col("url")), F.lit(-1)).alias("number"))


@query("longest_suffix", "SELECT event_type, CASE WHEN event_type LIKE '%_to_cart' THEN '_to_cart' WHEN event_type LIKE '%cart' THEN 'cart' WHEN event_type LIKE '%view' THEN 'view' WHEN event_type LIKE '%ck' THEN 'ck' WHEN event_type LIKE '%e' THEN 'e' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = X.longest_suffix(F.col("event_type"), ["cart", "_to_cart", "e", "ck", "view"])
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("session_lines", """SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events)) GROUP BY ALL""")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap closes what is open: events of a user as scan lines, split where nothing came for six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("f", F.when(F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS"), 1).otherwise(0)).withColumn("session", F.sum("f").over(w))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
