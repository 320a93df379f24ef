"""Queries of splits, draws, surfaces, audits and evaluations over the driver tables, and the SQL that gives the same rows.

Draws follow a numpy generator; their SQL holds the places that it draws from lists of 5, 20 and 25 rows, which the table of nations has at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import names, values
from lodestar.operators import audit, cohort, overlap, ranking, splits, surface
from lodestar.plans import formats
from lodestar.plans.formats import FLAGS, FOLDS, front_stats, label_arrays, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- names, numbers and spacings ------------------------------------------------------------


@query("""
    SELECT p_partkey, round(p_size * 0.5::DOUBLE, 9) AS first_mm, round(CAST(CAST(0.5::DOUBLE * (p_size + 3) / 640 AS FLOAT) AS DOUBLE), 9) AS resized_mm, round(sqrt(power(p_size * 0.5::DOUBLE, 2) + power(64 * 0.6::DOUBLE, 2)), 9) AS diagonal_mm,
           CASE WHEN p_size <= least(7, 20 - p_size % 20) THEN 0 WHEN 7 <= 20 - p_size % 20 THEN 1 ELSE 2 END AS axis
    FROM part""")
def spacing_functions(spark, sf_dir):
    size = F.col("p_size")
    spacings = values.array_spacings(F.array(F.lit(3.0), F.lit(2.0), size * 0.5))
    shape = F.array(size, F.lit(7), F.lit(20) - size % 20)
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(F.get(spacings, F.lit(0)), 9).alias("first_mm"),
        F.round(values.resized_spacing(F.lit(0.5), size + 3, F.lit(640)).cast("double"), 9).alias("resized_mm"),
        F.round(values.diagonal_mm(size, F.lit(64), F.lit(0.5), F.lit(0.6)), 9).alias("diagonal_mm"),
        values.sagittal_axis(shape).alias("axis"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INT) AS c0, CAST(l_returnflag = 'N' AS INT) AS c1, CAST(l_returnflag = 'R' AS INT) AS c2 FROM lineitem")
def one_hot_labels(spark, sf_dir):
    label = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1
    hot = values.one_hot(label, 3)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.get(hot, F.lit(k)).alias(f"c{k}") for k in range(3)))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 2 THEN 1.5::DOUBLE WHEN 3 THEN '-inf'::DOUBLE WHEN 4 THEN 'nan'::DOUBLE WHEN 5 THEN NULL END AS lenient, (s_suppkey % 6) / 8.0::DOUBLE AS strict FROM supplier""")
def score_parse(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("", "INF", "1.5", "-inf", "nan", "Inf"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    strict = values.strict_score(((F.col("s_suppkey") % 6).cast("double") / 8).cast("string"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", values.optional_float(text).alias("lenient"), strict.alias("strict"))


# -- class statistics and filters -----------------------------------------------------------


@query(f"""WITH {formats._LINES}
    SELECT l_orderkey, round(dom, 9) AS dominant, round(CASE WHEN n > 0 THEN n::DOUBLE / (n + r) END, 9) AS share_n, round(CASE WHEN r > 0 THEN r::DOUBLE / (n + r) END, 9) AS share_r FROM s""")
def foreground_fractions(spark, sf_dir):
    shares = cohort.foreground_fractions(front_stats(spark, sf_dir), ["N", "R"])
    at = lambda c: F.round(F.try_element_at(shares, F.lit(c)), 9)
    return front_stats(spark, sf_dir).select("l_orderkey", F.round("dominant_foreground", 9).alias("dominant"), at("N").alias("share_n"), at("R").alias("share_r"))


_FLAGGED = f"""{formats._LINES},
    o AS (SELECT s.*, o_orderpriority AS g, CASE WHEN k < 3 THEN 'c' WHEN dom > 0.55::DOUBLE THEN 'i' END AS reason FROM s JOIN orders ON l_orderkey = o_orderkey),
    w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l_orderkey) - 1 AS i, count(*) OVER (PARTITION BY g) AS m, CAST(count(*) OVER (PARTITION BY g) - 1 AS DOUBLE) / 49 AS step FROM o WHERE reason IS NULL),
    kept AS (SELECT * FROM w WHERE m <= 50 OR i = m - 1 OR (floor(i / step) <= 48 AND floor(floor(i / step) * step) = i) OR (floor(i / step) + 1 <= 48 AND floor((floor(i / step) + 1) * step) = i))"""


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    return cohort.filter_samples(front_stats(spark, sf_dir).join(orders, "l_orderkey"), "o_orderpriority", "l_orderkey", cohort.FilterConfig("cap", 3, 0.55, 50))


@query(f"""WITH {_FLAGGED}, k AS (SELECT g, count(*) AS n FROM kept GROUP BY 1)
    SELECT (SELECT count(*) FROM o) + (SELECT count(*) FROM pages WHERE page_id % 7 = 0) AS before_filtering, (SELECT count(*) FROM o WHERE reason = 'c') AS removed_class_count, (SELECT count(*) FROM o WHERE reason = 'i') AS removed_imbalance,
           (SELECT count(*) FROM w) - (SELECT count(*) FROM kept) AS removed_sequence_cap, (SELECT count(*) FROM pages WHERE page_id % 7 = 0) AS corrupt_files, (SELECT count(*) FROM kept) AS kept, (SELECT string_agg(g || '=' || n, ',' ORDER BY g) FROM k) AS kept_by_sequence""")
def filter_statistics(spark, sf_dir):
    out = cohort.filter_statistics(_filtered(spark, sf_dir), read(spark, sf_dir, "pages").where("page_id % 7 = 0"), "o_orderpriority")
    return out.withColumn("kept_by_sequence", F.array_join(F.transform(F.map_entries("kept_by_sequence"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


# -- audit, end to end ----------------------------------------------------------------------


@query(f"""WITH {_FLAGGED}, b AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'unmatched' END AS part FROM kept JOIN (SELECT o_orderkey, o_custkey FROM orders) ON l_orderkey = o_orderkey),
    l AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'unmatched' END AS part FROM o JOIN (SELECT o_orderkey, o_custkey FROM orders) ON l_orderkey = o_orderkey WHERE k >= 2 AND dom <= 0.9::DOUBLE),
    c AS (SELECT 'cap' AS config, g, part FROM b UNION ALL SELECT 'loose', g, part FROM l),
    kn AS (SELECT config, g, count(*) AS kept, count(*) FILTER (part = 'training') AS train, count(*) FILTER (part = 'validation') AS validation, count(*) FILTER (part = 'unmatched') AS unmatched FROM c GROUP BY ALL),
    e AS (SELECT 'cap' AS config, g, count(*) AS extracted, count(*) FILTER (k < 3) AS removed_class, count(*) FILTER (k >= 3 AND dom > 0.55::DOUBLE) AS removed_imbalance FROM o GROUP BY g
          UNION ALL SELECT 'loose', g, count(*), count(*) FILTER (k < 2), count(*) FILTER (k >= 2 AND dom > 0.9::DOUBLE) FROM o GROUP BY g)
    SELECT config, g AS o_orderpriority, extracted, removed_class, removed_imbalance, extracted - removed_class - removed_imbalance - coalesce(kept, 0) AS removed_cap, coalesce(kept, 0) AS kept,
           coalesce(train, 0) AS train, coalesce(validation, 0) AS validation, coalesce(unmatched, 0) AS unmatched
    FROM e LEFT JOIN kn USING (config, g)""")
def audit_report(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    customers = orders.select("o_custkey").distinct()
    overview = customers.where("o_custkey % 3 < 2").select(F.col("o_custkey").alias("name"), F.when(F.col("o_custkey") % 3 == 0, "training").otherwise("validation").alias("subset"), F.lit(0).alias("position"))
    stats = front_stats(spark, sf_dir).join(orders, "l_orderkey")
    configs = [cohort.FilterConfig("cap", 3, 0.55, 50), cohort.FilterConfig("loose", 2, 0.9, None)]
    return splits.audit(stats, "o_orderpriority", "l_orderkey", configs, "o_custkey", overview, "name", "subset")


# -- splits and draws -----------------------------------------------------------------------


_OVERVIEW = "v AS (SELECT doc_id AS name, CASE WHEN quality = 1 THEN 'training' ELSE 'validation' END AS subset FROM labels UNION ALL SELECT doc_id, 'validation' FROM labels WHERE doc_id % 5 = 0)"


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, "training").otherwise("validation").alias("subset")).unionByName(labels.where("doc_id % 5 = 0").select(F.col("doc_id").alias("name"), F.lit("validation").alias("subset")))


@query(f"""WITH {_OVERVIEW} SELECT doc_id, 'train' AS part FROM documents WHERE doc_id IN (SELECT name FROM v WHERE subset = 'training') UNION ALL SELECT doc_id, 'validation' FROM documents WHERE doc_id IN (SELECT name FROM v WHERE subset = 'validation')
    UNION ALL SELECT doc_id, 'unmatched' FROM documents WHERE doc_id NOT IN (SELECT name FROM v)""")
def split_lists(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    parts = splits.split_parts(docs, "doc_id", _overview(spark, sf_dir), "name", "subset")
    train, validation, unmatched = (p.withColumn("part", F.lit(name)) for p, name in zip(parts, ("train", "validation", "unmatched"), strict=True))
    return train.unionByName(validation).unionByName(unmatched)


@query(f"WITH {_OVERVIEW} SELECT doc_id FROM documents WHERE doc_id IN (SELECT name FROM v WHERE subset = 'validation')")
def chosen_split(spark, sf_dir):
    labelled = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return splits.chosen_split(labelled, "doc_id", _overview(spark, sf_dir), "name", "subset", "validation", strict=True)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")


@query(f"SELECT c_custkey, c_nationkey, CAST(f AS INT) AS fold FROM customer JOIN (VALUES {FOLDS}) AS v(k, f) ON c_nationkey = k")
def kfold_assign(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # patients are all nations, samples their customers
    folds = splits.kfold(_nations(spark, sf_dir).select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", 5, 42)
    return customers.join(folds, "c_nationkey").select("c_custkey", "c_nationkey", "fold")


@query("SELECT c_custkey, n_regionkey, n_nationkey, CASE WHEN n_nationkey // 5 IN (0, 3, 4) THEN 'val' ELSE 'train' END AS part FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_validation(spark, sf_dir):
    cases = splits.inner_validation(_nations(spark, sf_dir), "n_regionkey", "n_nationkey", 3, 42)
    return read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(cases, "n_nationkey").select("c_custkey", "n_regionkey", "n_nationkey", "part")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey // 5 IN (0, 3)")
def random_cap(spark, sf_dir):
    return splits.random_cap(_nations(spark, sf_dir), "n_regionkey", "n_nationkey", 2, 42)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 2, 4, 8, 11, 13, 16, 18, 19, 21)")
def train_subsample(spark, sf_dir):
    return splits.train_subsample(_nations(spark, sf_dir).select("n_nationkey"), "n_nationkey", 10, 42)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (15, 16, 19, 20, 21, 23)")
def random_sample(spark, sf_dir):
    return splits.choose(_nations(spark, sf_dir).select("n_nationkey"), "n_nationkey", 6, 5, "random", 7)


@query("SELECT c_custkey FROM customer WHERE c_custkey >= (SELECT min(c_custkey) FROM customer) QUALIFY row_number() OVER (ORDER BY c_custkey) BETWEEN 6 AND 42")
def first_sample(spark, sf_dir):
    return splits.choose(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 37, 5, "first")


_EVEN = "(floor(i / step) <= {0} - 2 AND floor(floor(i / step) * step) = i) OR (floor(i / step) + 1 <= {0} - 2 AND floor((floor(i / step) + 1) * step) = i) OR i = m - 1"


@query(f"WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 6 AS i, count(*) OVER () - 5 AS m FROM customer), b AS (SELECT *, CAST(m - 1 AS DOUBLE) / 36 AS step FROM a WHERE i >= 0) SELECT c_custkey FROM b WHERE {_EVEN.format(37)}")
def even_sample(spark, sf_dir):
    return splits.choose(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 37, 5, "even")


@query(f"WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS m FROM customer), b AS (SELECT *, CAST(m - 1 AS DOUBLE) / 11 AS step FROM a) SELECT c_custkey FROM b WHERE {_EVEN.format(12)}")
def smoke_pick(spark, sf_dir):
    return splits.smoke_pick(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 12)


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (15, 16, 19, 20, 9) THEN 'test' WHEN n_nationkey IN (7, 17, 24, 6, 10) THEN 'val' ELSE 'train' END AS part FROM nation")
def image_split(spark, sf_dir):
    rows = _nations(spark, sf_dir).select("n_nationkey", F.when(F.col("n_regionkey") == 0, "test").when(F.col("n_regionkey") == 1, "val").otherwise("train").alias("part"))
    return splits.image_split(rows, "n_nationkey", "part", 42)


@query("SELECT CAST(c_custkey AS VARCHAR) || '_t2' AS series, count(*) AS slices, min(o_orderkey) AS first_slice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 4 = 0 GROUP BY c_custkey")
def selected_volumes(spark, sf_dir):
    volumes = read(spark, sf_dir, "customer").select(F.concat("c_custkey", F.lit("_t2")).alias("series"))
    wanted = read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.format_string("%d_t2_s%012d.npz", F.col("o_custkey"), F.col("o_orderkey")).alias("file"))
    out = splits.selected_by_series(volumes, "series", wanted, "file")
    return out.select("series", F.size("wanted_slices").cast("bigint").alias("slices"), F.regexp_extract(F.element_at("wanted_slices", 1), r"_s(\d+)", 1).cast("bigint").alias("first_slice"))


# -- overlap and surfaces -------------------------------------------------------------------


_COUNTS = f"""{formats._LABELS}, cl AS (SELECT CAST(range AS INT) AS class_id FROM range(4)),
    n AS (SELECT vec_id, label, class_id, count(*) FILTER (t = class_id AND p = class_id) AS i, count(*) FILTER (p = class_id) AS p, count(*) FILTER (t = class_id) AS t FROM px, cl GROUP BY ALL)"""


@query(f"WITH {_COUNTS} SELECT vec_id, class_id, i AS inter, p AS pred, t AS true FROM n")
def overlap_of_arrays(spark, sf_dir):
    return overlap.array_counts(label_arrays(spark, sf_dir), ["vec_id"], "p", "t", 4)


@query(f"WITH {formats._LABELS}, c AS (SELECT vec_id, count(*) FILTER (t = 1) AS a, count(*) FILTER (t = 2) AS b, count(*) FILTER (t = 3) AS d, count(DISTINCT t) AS num_classes FROM px GROUP BY 1) SELECT vec_id, CAST(num_classes AS INT) AS num_classes, round(CASE WHEN a + b + d = 0 THEN 1.0::DOUBLE ELSE greatest(a, b, d)::DOUBLE / (a + b + d) END, 9) AS dominant FROM c")
def stats_of_arrays(spark, sf_dir):
    rows = cohort.array_stats(label_arrays(spark, sf_dir), ["vec_id"], "t", 4)
    return rows.select("vec_id", "num_classes", F.round("dominant_foreground", 9).alias("dominant"))


@query(f"""WITH {_COUNTS}, g AS (SELECT class_id, label, sum(i) AS i, sum(p) AS p, sum(t) AS t FROM n GROUP BY ALL),
    d AS (SELECT class_id, avg((2.0::DOUBLE * i + 1e-7::DOUBLE) / (p + t + 1e-7::DOUBLE)) AS dice, avg((i + 1e-7::DOUBLE) / (p + t - i + 1e-7::DOUBLE)) AS iou FROM g GROUP BY 1)
    SELECT (SELECT count(*) FROM embeddings) AS n_slices, (SELECT count(DISTINCT label) FROM embeddings) AS n_cases, round(avg(dice) FILTER (class_id > 0), 8) AS foreground_macro_dice, round(avg(dice), 8) AS all_class_mean_dice, round(avg(iou) FILTER (class_id > 0), 8) AS mean_iou,
           (SELECT sha256(string_agg({formats._FILE}, chr(10) ORDER BY {formats._FILE})) FROM embeddings) AS sha256 FROM d""")
def evaluation_report(spark, sf_dir):
    """Archives of predictions and truths scored by case, with what the score rests on."""
    from lodestar.sources import arrays

    rows = label_arrays(spark, sf_dir)
    truth, pred = (arrays.readable(arrays.parse_archives(arrays.pack_archives(rows, name, c, "shape", "u1"), name)) for name, c in (("mask", "t"), ("pred", "p")))
    joined = arrays.with_predictions(truth, pred).select("file", names.patient_id(F.col("series_id")).alias("case"), F.col("cells").cast("array<int>").alias("t"), F.col("pred").cast("array<int>").alias("p"))
    counted = overlap.array_counts(joined, ["file", "case"], "p", "t", 4)
    head = overlap.headline(overlap.by_unit(counted, "case", "case"), False)
    cohort_of = joined.agg(F.countDistinct("file").alias("n_slices"), F.countDistinct("case").alias("n_cases"))
    digest = audit.cohort_fingerprint(joined.select(F.lit("all").alias("cohort"), "file"), "cohort", "file").select("sha256")
    return cohort_of.crossJoin(digest).crossJoin(head).select("n_slices", "n_cases", *(F.round(c, 8).alias(c) for c in ("foreground_macro_dice", "all_class_mean_dice", "mean_iou")), "sha256")


@query("SELECT (SELECT avg(l_discount) FROM lineitem) IS NOT NULL AS scored, round(avg(d) FILTER (c IN ('A', 'R')), 9) AS foreground_macro_dice, round(avg(d), 9) AS all_class_mean_dice FROM (SELECT l_returnflag AS c, avg(l_discount) AS d FROM lineitem GROUP BY 1)")
def csv_headline(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("class")).agg(F.avg("l_discount").alias("dice"))
    out = overlap.csv_headline(overlap.with_mean_row(rows, "class", ["dice"]), ["A", "R"])
    return out.select(F.col("foreground_macro_dice").isNotNull().alias("scored"), *(F.round(c, 9).alias(c) for c in out.columns))


@query("SELECT count(DISTINCT o_orderkey) AS n_slices, count(DISTINCT o_custkey) AS n_cases FROM orders")
def cohort_size(spark, sf_dir):
    return overlap.cohort_size(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def _masks(spark: SparkSession, sf_dir: str, cut: float) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select("vec_id", "label", F.transform("e", lambda x: (x >= cut).cast("int")).alias("t"), F.transform("e", lambda x, i: ((x + F.coalesce(F.get(F.col("e"), i + 1), x)) / 2 >= cut).cast("int")).alias("p"))


def _surface_sql(cut: float) -> str:
    """Surfaces and both directed distances of 8 x 8 masks; (vec_id, asd, hd, hd95, nsd) is m."""
    return f"""
    x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS e, CAST(coalesce(embedding[i + 2], embedding[i + 1]) AS DOUBLE) AS f FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
    px AS (SELECT vec_id, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, e >= {cut}::DOUBLE AS t, (e + f) / 2 >= {cut}::DOUBLE AS p FROM x),
    nb AS (SELECT a.vec_id, a.r, a.c, any_value(a.t) AS t, any_value(a.p) AS p, count(*) FILTER (b.t) AS nt, count(*) FILTER (b.p) AS np FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL),
    s AS (SELECT vec_id, r, c, 't' AS side FROM nb WHERE t AND nt < 9 UNION ALL SELECT vec_id, r, c, 'p' FROM nb WHERE p AND np < 9),
    d AS (SELECT a.vec_id, min(sqrt(power((a.r - b.r) * 0.5::DOUBLE, 2) + power((a.c - b.c) * 0.6::DOUBLE, 2))) AS d FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.side <> b.side GROUP BY a.vec_id, a.side, a.r, a.c),
    n AS (SELECT vec_id, count(DISTINCT side) AS sides FROM s GROUP BY 1),
    m AS (SELECT e.vec_id, e.label, CASE coalesce(sides, 0) WHEN 0 THEN 0 WHEN 1 THEN 'inf'::DOUBLE ELSE asd END AS asd, CASE coalesce(sides, 0) WHEN 0 THEN 0 WHEN 1 THEN 'inf'::DOUBLE ELSE hd END AS hd,
                 CASE coalesce(sides, 0) WHEN 0 THEN 0 WHEN 1 THEN 'inf'::DOUBLE ELSE hd95 END AS hd95, CASE coalesce(sides, 0) WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE nsd END AS nsd
          FROM embeddings e LEFT JOIN n ON e.vec_id = n.vec_id LEFT JOIN (SELECT vec_id, avg(d) AS asd, max(d) AS hd, quantile_cont(d, 0.95) AS hd95, avg(CAST(d <= 0.5 AS INT)) AS nsd FROM d GROUP BY 1) q ON e.vec_id = q.vec_id)"""


@query(f"WITH {_surface_sql(0.05)} SELECT vec_id, round(asd, 9) AS asd, round(hd, 9) AS hd, round(hd95, 9) AS hd95, round(nsd, 9) AS nsd FROM m")
def surface_metrics(spark, sf_dir):
    rows = surface.surface_metrics(_masks(spark, sf_dir, 0.05), "vec_id", "p", "t", (8, 8), (0.5, 0.6), 0.5)
    return rows.select("vec_id", *(F.round(c, 9).alias(c) for c in ("asd", "hd", "hd95", "nsd")))


@query(f"WITH {_surface_sql(0.05)} SELECT vec_id, count(*) AS n_surface FROM s WHERE side = 't' GROUP BY 1")
def surface_pixels(spark, sf_dir):
    rows = _masks(spark, sf_dir, 0.05).select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), "t")
    out = surface.map_images(rows, "vec_id", "t", "height", "width", lambda x: surface.surface(x).astype(int), "int")
    return out.select("vec_id", F.aggregate("t", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("n_surface")).where("n_surface > 0")


@query(f"""WITH {_surface_sql(0.3)}
    SELECT label, round(avg(asd), 9) AS propagate, round(coalesce(avg(asd) FILTER (asd < 'inf'::DOUBLE), 'inf'::DOUBLE), 9) AS exclude, round(avg(CASE WHEN asd < 'inf'::DOUBLE THEN asd ELSE sqrt(power(4.0::DOUBLE, 2) + power(4.8::DOUBLE, 2)) END), 9) AS max_distance,
           count(*) FILTER (asd = 'inf'::DOUBLE) AS n_inf FROM m GROUP BY label""")
def surface_inf_policies(spark, sf_dir):
    masks = _masks(spark, sf_dir, 0.3)
    rows = surface.surface_metrics(masks, "vec_id", "p", "t", (8, 8), (0.5, 0.6), 0.5).join(masks.select("vec_id", "label"), "vec_id")
    diagonal = values.diagonal_mm(F.lit(8), F.lit(8), F.lit(0.5), F.lit(0.6))
    means = [F.round(surface.mean_distance(F.col("asd"), p, diagonal), 9).alias(p) for p in ("propagate", "exclude", "max_distance")]
    return rows.groupBy("label").agg(*means, surface.infinite(F.col("asd")).alias("n_inf"))


@query("""WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE) AS s FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) SELECT vec_id, CAST(arg_max(i, s) - 1 AS INT) AS class_id FROM (SELECT * FROM x ORDER BY vec_id, i) WHERE i <= 32 GROUP BY vec_id""")
def ensemble_argmax(spark, sf_dir):
    """A map and its mirror image: their mean is symmetric, and of equal maxima the first counts."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", values.argmax(values.ensemble([e, F.reverse(e)])).alias("class_id"))


@query("""WITH px AS (SELECT vec_id, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, embedding[i + 1] >= 0.05 AS t FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
    b AS (SELECT a.vec_id, a.r, a.c FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING bool_or(b.t) AND NOT bool_and(b.t)) SELECT vec_id, count(*) AS n_band FROM b GROUP BY 1""")
def boundary_band(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: (x >= F.lit(0.05).cast("float")).cast("int")).alias("t"))
    out = surface.boundary_bands(rows, "vec_id", "t", "height", "width", 3)
    return out.select("vec_id", F.aggregate("t", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("n_band")).where("n_band > 0")


_PLACES = "least(greatest((i + 0.5::DOUBLE) * (8.0::DOUBLE / {0}) - 0.5::DOUBLE, 0), 7)"


@query(f"""WITH r AS (SELECT CAST(i AS INT) AS r, {_PLACES.format(16)} AS pr FROM (SELECT unnest(range(16)) AS i)), c AS (SELECT CAST(i AS INT) AS c, {_PLACES.format(12)} AS pc FROM (SELECT unnest(range(12)) AS i)),
    g AS (SELECT vec_id, embedding AS e, r * 12 + c AS i, CAST(floor(pr) AS INT) AS r0, pr - floor(pr) AS a, CAST(floor(pc) AS INT) AS c0, pc - floor(pc) AS b FROM embeddings, r, c)
    SELECT vec_id, i, round(((1 - a) * e[r0 * 8 + c0 + 1] + a * e[least(r0 + 1, 7) * 8 + c0 + 1]) * (1 - b) + ((1 - a) * e[r0 * 8 + least(c0 + 1, 7) + 1] + a * e[least(r0 + 1, 7) * 8 + least(c0 + 1, 7) + 1]) * b, 7) AS x FROM g""")
def resize_linear(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), "embedding")
    out = surface.resize_images(rows, "vec_id", "embedding", "height", "width", (16, 12))
    return out.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.round("x", 7).alias("x"))


@query("SELECT vec_id, CAST(r * 12 + c AS INT) AS i, CAST(embedding[(r * 8 // 5) * 8 + c * 8 // 12 + 1] >= 0.05 AS INT) AS x FROM embeddings, (SELECT unnest(range(5)) AS r), (SELECT unnest(range(12)) AS c)")
def resize_nearest(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: (x >= F.lit(0.05).cast("float")).cast("int")).alias("t"))
    return surface.resize_images(rows, "vec_id", "t", "height", "width", (5, 12), nearest=True).select("vec_id", F.posexplode("t").alias("i", "x"))


# -- rankings and summaries -----------------------------------------------------------------


@query("SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name DESC LIMIT 25")
def rank_rows(spark, sf_dir):
    return ranking.rank_rows(read(spark, sf_dir, "supplier").select("s_name", "s_acctbal"), "s_acctbal", "s_name", 25, descending=True)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def first_n(spark, sf_dir):
    return ranking.first_n(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 20)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are line numbers; the seventh has no mean row, the sixth lacks a class, odd ones have a configuration, and those below 4 a log."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("class"), "l_discount", "l_tax")
    rows = lines.where("run <> 6 or class <> 'R'").groupBy("run", "class").agg(F.avg("l_discount").alias("dice"), F.avg("l_tax").alias("iou"))
    means = rows.where("run <> 7").groupBy("run").agg(F.lit("Mean").alias("class"), F.avg("dice").alias("dice"), F.avg("iou").alias("iou"))
    log = read(spark, sf_dir, "events").where("user_id % 6 between 1 and 3").select((F.col("user_id") % 6).cast("int").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_mean_iou"), (F.col("value") / 2).alias("val_dice"))
    configs = read(spark, sf_dir, "nation").where("n_nationkey in (1, 3, 5)").select(F.col("n_nationkey").alias("run"), F.create_map(F.lit("sequences"), F.when(F.col("n_nationkey") == 5, "T2").otherwise("T2_SPACE")).alias("config"))
    return ranking.experiment_summary(rows.unionByName(means), log, configs, {"A": 0.049, "N": 0.0495, "R": 0.049}, 0.049, "T2_SPACE")


_SUMMARY = """
    m AS (SELECT l_linenumber AS run, l_returnflag AS c, avg(l_discount) AS dice, avg(l_tax) AS iou FROM lineitem WHERE l_linenumber <> 6 OR l_returnflag <> 'R' GROUP BY ALL),
    w AS (SELECT run, avg(dice) AS mean_dice, avg(iou) AS mean_iou, max(dice) FILTER (c = 'A') AS a, max(dice) FILTER (c = 'N') AS n, max(dice) FILTER (c = 'R') AS r FROM m WHERE run <> 7 GROUP BY run),
    e AS (SELECT CAST(user_id % 6 AS INT) AS run, event_id, value, max(value) OVER (PARTITION BY user_id % 6) AS top FROM events WHERE user_id % 6 BETWEEN 1 AND 3),
    b AS (SELECT run, min(event_id) + 1 AS best_epoch, min(value) AS best, min(value) / 2 AS best_dice FROM e WHERE value = top GROUP BY run),
    q AS (SELECT w.*, (a + n + r) / 3 AS macro, coalesce(a >= 0.049::DOUBLE AND n >= 0.0495::DOUBLE AND r >= 0.049::DOUBLE AND (a + n + r) / 3 >= 0.049::DOUBLE, FALSE) AS target_met, w.run IN (1, 3) AS scope_verified, best_epoch, best, best_dice FROM w LEFT JOIN b ON w.run = b.run),
    z AS (SELECT *, CAST(row_number() OVER (ORDER BY macro DESC NULLS LAST, run) AS INT) AS rank FROM q)"""


@query(f"WITH {_SUMMARY} SELECT run, round(mean_dice, 9) AS mean_dice, round(mean_iou, 9) AS mean_iou, round(macro, 9) AS macro, target_met, scope_verified, best_epoch, best AS best_val_mean_iou, best_dice AS best_val_dice, rank FROM z")
def experiment_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("run", *(F.round(c, 9).alias(c) for c in ("mean_dice", "mean_iou", "macro")), "target_met", "scope_verified", "best_epoch", "best_val_mean_iou", "best_val_dice", "rank")


@query(f"WITH {_SUMMARY} SELECT run, rank FROM z WHERE target_met AND scope_verified ORDER BY rank LIMIT 1")
def first_verified(spark, sf_dir):
    return ranking.first_verified(_summary(spark, sf_dir), "target_met", "scope_verified").select("run", "rank")


@query("""WITH d AS (SELECT l_linenumber, year(l_shipdate) AS y, avg(l_discount) - avg(l_tax) AS d FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY abs(d)) AS k FROM d),
    s AS (SELECT l_linenumber, count(*) AS pairs, avg(d) AS mean_difference, CAST(least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS DOUBLE) AS statistic FROM r GROUP BY 1),
    w AS (SELECT l_linenumber, pairs, mask, list_sum([j + 1 FOR j IN range(pairs) IF (mask >> j) & 1 = 1]) AS total FROM (SELECT *, unnest(range(1 << CAST(pairs AS INT))) AS mask FROM s)),
    v AS (SELECT w.l_linenumber, count(*) AS ways FROM w JOIN s ON s.l_linenumber = w.l_linenumber WHERE coalesce(total, 0) <= statistic GROUP BY 1)
    SELECT s.l_linenumber, pairs, round(mean_difference, 9) AS mean_difference, statistic, round(least(1.0::DOUBLE, 2 * ways / power(2.0::DOUBLE, pairs)), 9) AS p FROM s JOIN v ON s.l_linenumber = v.l_linenumber""")
def paired_signed_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.year("l_shipdate").alias("year")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    out = ranking.signed_rank(rows, "l_linenumber", "a", "b")
    return out.select("l_linenumber", "pairs", F.round("mean_difference", 9).alias("mean_difference"), "statistic", F.round("p", 9).alias("p"))


# -- sets of names --------------------------------------------------------------------------


@query("SELECT doc_id, 'missing' AS fault FROM documents WHERE doc_id % 3 = 0 AND (doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id % 7 = 0) UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels WHERE doc_id % 3 <> 0")
def expected_present(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    return audit.expected_present(docs.where("doc_id % 3 = 0"), labels, labels.where("doc_id % 7 <> 0"), "doc_id")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id % 2 = 0")
def pair_guard(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id").distinct()
    return audit.require_pairs(labels.where("doc_id % 2 = 0"), labels, labels, "doc_id")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS not_extracted, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0 AS is_subset, (SELECT count(*) FROM labels WHERE quality = 0 AND toxic <> 1) AS test_minus_val")
def set_tests(spark, sf_dir):
    from lodestar.streaming.incremental import missing_from

    orders, lines = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    labels = read(spark, sf_dir, "labels")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rest = count(missing_from(labels.where("quality = 0").select("doc_id"), labels.where("toxic = 1"), "doc_id"), "test_minus_val")
    subset = count(missing_from(lines, orders, "key"), "n").select((F.col("n") == 0).alias("is_subset"))
    return count(missing_from(orders, lines, "key"), "not_extracted").crossJoin(subset).crossJoin(rest)
