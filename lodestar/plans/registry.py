"""Queries of the cohort operators over the driver tables, and the SQL that gives the same rows.

The tables stand in for the operators' domain: an order is a slice, a line a pixel, the
return flag its class, the order's priority the sequence; or a vector is an 8 x 8
image, its elements by threshold the labels, and the mean of an element and its right
neighbour the prediction; documents and labels are a cohort and its overview.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import names, values
from lodestar.operators import audit, cohort, overlap, ranking, splits
from lodestar.plans import formats, protocol

FLAGS = ["A", "N", "R"]
CONFIG = cohort.FilterConfig("strict", 3, 0.55, 500)
CONFIGS = [CONFIG, cohort.FilterConfig("relaxed", 2, 0.90, None), cohort.FilterConfig("small", 3, 0.55, 50)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    return cohort.class_stats(lines, ["l_orderkey"], "l_returnflag", FLAGS).join(orders, "l_orderkey")


def slice_filter_audit(spark, sf_dir):
    return cohort.filter_audit(_stats(spark, sf_dir), "o_orderpriority", [CONFIG]).drop("config")


def multi_config_audit(spark, sf_dir):
    return cohort.filter_audit(_stats(spark, sf_dir), "o_orderpriority", CONFIGS)


def slice_filter_cap(spark, sf_dir):
    kept = cohort.filter_samples(_stats(spark, sf_dir), "o_orderpriority", "l_orderkey", CONFIG).where("reason is null")
    return kept.groupBy("o_orderpriority").agg(F.max("eligible").alias("eligible"), F.sum("rank").cast("bigint").alias("rank_sum"), F.sum("l_orderkey").alias("key_sum"))


def class_fractions(spark, sf_dir):
    rows = cohort.fractions(_stats(spark, sf_dir), FLAGS)
    return rows.select("l_orderkey", "num_classes", F.round("dominant_foreground", 9).alias("dominant"), *(F.round(f"fraction_{c}", 9).alias(f"fraction_{c.lower()}") for c in FLAGS))


def imbalance_definitions(spark, sf_dir):
    rows = cohort.fractions(_stats(spark, sf_dir), FLAGS)
    share = [F.col(f"fraction_{c}") for c in FLAGS]
    tests = cohort.imbalance_definitions(share, share[1:])
    out = cohort.definition_rollup(rows, "o_orderpriority", "o_custkey", F.col("num_classes") == 3, tests, ["fraction_A", "fraction_N", "fraction_R"])
    return out.select(F.col("o_orderpriority").alias("sequence"), "series", "total", "complete", *(F.col(f"kept_{k}").alias(f"kept_{k.lower()}") for k in tests))


def sequence_classify(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", names.sequence_of(F.col("url")).alias("sequence"), names.series_id(F.concat("url", F.lit("_s012.npz"))).alias("series_id"), names.patient_id(F.col("url")).alias("patient_id"))


def label_map(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.map_label((F.col("l_partkey") % 300).cast("int")).alias("label"))


def split_train_val(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    overview = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, "training").otherwise("validation").alias("subset"), F.col("toxic").alias("pos"))
    return splits.split_counts(splits.with_subset(docs, "doc_id", overview, "name", "subset", "pos"), ["source"])


def _pixels(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    cut = lambda x: (x >= -0.05).cast("int") + (x >= 0.05).cast("int") + (x >= 0.12).cast("int")
    return rows.select("vec_id", "label", F.explode(F.transform("e", lambda x, i: F.struct(cut(x).alias("t"), cut((x + F.coalesce(F.get(F.col("e"), i + 1), x)) / 2).alias("p")))).alias("x")).select("vec_id", "label", "x.t", "x.p")


def _dice(unit: str):
    def query(spark, sf_dir):
        rows = overlap.counts(_pixels(spark, sf_dir), ["vec_id", "label"], "p", "t", 4)
        return overlap.by_unit(rows, unit, "label").select("class_id", F.round("dice", 9).alias("dice"), F.round("iou", 9).alias("iou"))

    return query


def precision_recall_f1(spark, sf_dir):
    rows = overlap.precision_recall(overlap.counts(_pixels(spark, sf_dir), ["vec_id", "label"], "p", "t", 4))
    return rows.select("class_id", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def unsmoothed_dice(spark, sf_dir):
    rows = overlap.plain_dice(overlap.counts(_pixels(spark, sf_dir), ["vec_id", "label"], "p", "t", 4), "vec_id")
    return rows.select("vec_id", F.round("dice_mean", 9).alias("dice_mean"))


def worst_k_per_metric(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 9).alias("discount"))
    return ranking.worst_per_metric(rows, ["quantity", "discount"], "l_orderkey", 10)


def best_epoch(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return ranking.best_epoch(events, "event_type", "event_id", "value")


def pair_integrity(spark, sf_dir):
    rows = audit.pair_status(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def cohort_fingerprint(spark, sf_dir):
    return audit.cohort_fingerprint(_read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


def key_parse(spark, sf_dir):
    base = F.concat(F.col("p_partkey").cast("string"), F.lit("_t2_"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    rows = _read(spark, sf_dir, "part").select("p_partkey", names.slice_name(base, F.col("p_size")).alias("file"))
    return rows.select("p_partkey", "file", names.series_id(F.col("file")).alias("series_id"), names.patient_id(F.col("file")).alias("patient_id"), names.slice_index(F.col("file")).alias("slice_index"), names.stem(F.col("file")).alias("case_id"))


def minmax_normalise(spark, sf_dir):
    e = values.minmax(F.transform("embedding", lambda x: x.cast("double")))
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(e).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


def argmax_class(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", values.argmax(F.col("embedding")).alias("class_id"))


def safe_ratio(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.sum((F.col("l_returnflag") == c).cast("bigint")).alias(c) for c in ("A", "R")))
    ratio = values.ratio(F.col("A"), F.col("R"))
    return rows.select("l_orderkey", values.four_decimals(F.when(~F.isnan(ratio), ratio)).alias("ratio"), F.isnan(ratio).alias("undefined"))


def subset_default(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    overview = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, "training").otherwise("validation").alias("subset"), F.col("toxic").alias("pos"))
    return splits.with_subset(docs, "doc_id", overview, "name", "subset", "pos")


def raw_audit(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return audit.raw_audit(rows.withColumn("has_mask", F.col("quality").isNotNull()), ["source", "lang"], "has_mask")


def duplicate_check(spark, sf_dir):
    return audit.duplicates(_read(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey")


def macro_means(spark, sf_dir):
    out = overlap.headline(_dice("slice")(spark, sf_dir), False)
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


def mean_row(spark, sf_dir):
    rows = overlap.with_mean_row(_dice("pixel")(spark, sf_dir).select(F.col("class_id").cast("string").alias("class"), "dice", "iou"), "class", ["dice", "iou"])
    return rows.select("class", F.round("dice", 8).alias("dice"), F.round("iou", 8).alias("iou"))


def experiment_rank(spark, sf_dir):
    runs = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("run"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score"))
    return ranking.experiment_rank(runs, "score", "run")


def run_summary(spark, sf_dir):
    out = ranking.run_summary(_read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", "runs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def target_check(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_discount").alias("score"))
    out = ranking.target_decision(rows, "l_linenumber", "l_returnflag", "score", {"A": 0.049, "N": 0.0495, "R": 0.049}, 0.05)
    return out.withColumn("macro", F.round("macro", 9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (slice_filter_audit, multi_config_audit, slice_filter_cap, class_fractions, imbalance_definitions, sequence_classify, label_map, split_train_val, precision_recall_f1, unsmoothed_dice, worst_k_per_metric, best_epoch, pair_integrity, cohort_fingerprint, key_parse, minmax_normalise, argmax_class, safe_ratio, subset_default, raw_audit, duplicate_check, macro_means, mean_row, experiment_rank, run_summary, target_check)
} | {f"dice_{unit}": _dice(unit) for unit in ("slice", "case", "pixel")}
QUERIES |= formats.QUERIES | protocol.QUERIES

_STATS = """
    s AS (SELECT l_orderkey, o_orderpriority, o_custkey, a, n, r, a + n + r AS total, CAST(a > 0 AS INT) + CAST(n > 0 AS INT) + CAST(r > 0 AS INT) AS k,
                 CAST(greatest(a, n, r) AS DOUBLE) / (a + n + r) AS dom
          FROM (SELECT l_orderkey, sum(CAST(l_returnflag = 'A' AS BIGINT)) AS a, sum(CAST(l_returnflag = 'N' AS BIGINT)) AS n, sum(CAST(l_returnflag = 'R' AS BIGINT)) AS r
                FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey)"""


def _audit_sql(configs: list[cohort.FilterConfig], named: bool) -> str:
    table = ", ".join(f"('{c.name}', {c.min_classes}, CAST({c.threshold} AS DOUBLE), {c.cap if c.cap else 'CAST(NULL AS INT)'})" for c in configs)
    return f"""WITH {_STATS},
    c AS (SELECT * FROM (VALUES {table}) AS v(config, least, threshold, cap)),
    f AS (SELECT *, CASE WHEN k < least THEN 'class' WHEN dom > threshold THEN 'imbalance' END AS reason FROM s, c),
    w AS (SELECT *, row_number() OVER (PARTITION BY config, o_orderpriority, reason IS NULL ORDER BY l_orderkey) - 1 AS i,
                 count(*) OVER (PARTITION BY config, o_orderpriority, reason IS NULL) AS m FROM f),
    p AS (SELECT *, CAST(m - 1 AS DOUBLE) / greatest(cap - 1, 1) AS step FROM w),
    e AS (SELECT *, reason IS NULL AND (cap IS NULL OR m <= cap OR CASE WHEN cap = 1 THEN i = 0 ELSE
            i = m - 1 OR (floor(i / step) <= cap - 2 AND floor(floor(i / step) * step) = i) OR (floor(i / step) + 1 <= cap - 2 AND floor((floor(i / step) + 1) * step) = i) END) AS keep FROM p)
    SELECT {'config, ' if named else ''}o_orderpriority, count(*) AS extracted, CAST(count(*) FILTER (reason = 'class') AS BIGINT) AS removed_class,
           CAST(count(*) FILTER (reason = 'imbalance') AS BIGINT) AS removed_imbalance, CAST(count(*) FILTER (reason IS NULL AND NOT keep) AS BIGINT) AS removed_cap,
           CAST(count(*) FILTER (keep) AS BIGINT) AS kept
    FROM e GROUP BY {'config, ' if named else ''}o_orderpriority"""


_CUT = "CAST({0} >= -0.05 AS INT) + CAST({0} >= 0.05 AS INT) + CAST({0} >= 0.12 AS INT)"
_OVERLAP = f"""
    x AS (SELECT vec_id, label, CAST(embedding[i] AS DOUBLE) AS e, CAST(coalesce(embedding[i + 1], embedding[i]) AS DOUBLE) AS f
          FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    px AS (SELECT vec_id, label, {_CUT.format('e')} AS t, {_CUT.format('((e + f) / 2)')} AS p FROM x),
    cl AS (SELECT CAST(range AS INT) AS class_id FROM range(4)),
    n AS (SELECT vec_id, label, class_id, count(*) FILTER (t = class_id AND p = class_id) AS i, count(*) FILTER (p = class_id) AS p, count(*) FILTER (t = class_id) AS t
          FROM px, cl GROUP BY ALL)"""
_RATIOS = "round(avg((2.0::DOUBLE * i + 1e-7::DOUBLE) / (p + t + 1e-7::DOUBLE)), 9) AS dice, round(avg((i + 1e-7::DOUBLE) / (p + t - i + 1e-7::DOUBLE)), 9) AS iou"
_POOLED = "SELECT {0}class_id, sum(i) AS i, sum(p) AS p, sum(t) AS t FROM n GROUP BY ALL"

_MEANS = f"{_OVERLAP}, d AS (SELECT class_id, {_RATIOS} FROM n GROUP BY class_id)"
_POOLED_MEANS = f"{_OVERLAP}, g AS ({_POOLED.format('')}), d AS (SELECT class_id, {_RATIOS} FROM g GROUP BY class_id)"

ORACLE: dict[str, str] = {
    "key_parse": "WITH p AS (SELECT p_partkey, p_partkey || '_t2_' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS base, p_size FROM part) SELECT p_partkey, printf('%s_s%03d.npz', base, p_size) AS file, base AS series_id, CAST(p_partkey AS VARCHAR) AS patient_id, p_size AS slice_index, printf('%s_s%03d', base, p_size) AS case_id FROM p",
    "minmax_normalise": "WITH x AS (SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT *, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM x) SELECT vec_id, i, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 9) AS x FROM m",
    "argmax_class": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class_id FROM embeddings",
    "safe_ratio": "WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN r = 0 THEN '-' ELSE printf('%.4f', a::DOUBLE / r) END AS ratio, r = 0 AS undefined FROM n",
    "subset_default": "WITH f AS (SELECT doc_id, arg_min(quality, toxic) AS q FROM labels GROUP BY 1) SELECT d.doc_id, CASE WHEN f.doc_id IS NULL THEN 'unmatched' WHEN q = 1 THEN 'training' ELSE 'validation' END AS subset FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id",
    "raw_audit": "SELECT source, lang, count(*) AS series_count, count(quality) AS mask_count FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2",
    "duplicate_check": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "macro_means": f"WITH {_MEANS} SELECT round(avg(dice) FILTER (class_id > 0), 8) AS foreground_macro_dice, round(avg(dice), 8) AS all_class_mean_dice, round(avg(dice) FILTER (class_id > 0), 8) AS mean_dice, round(avg(iou) FILTER (class_id > 0), 8) AS mean_iou FROM d",
    "mean_row": f"WITH {_POOLED_MEANS} SELECT CAST(class_id AS VARCHAR) AS class, round(dice, 8) AS dice, round(iou, 8) AS iou FROM d UNION ALL SELECT 'Mean', round(avg(dice), 8), round(avg(iou), 8) FROM d",
    "experiment_rank": "WITH r AS (SELECT s_name AS run, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS score FROM supplier) SELECT run, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, run) AS INT) AS rank FROM r",
    "run_summary": "SELECT o_orderpriority, count(*) AS runs, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd FROM orders GROUP BY 1",
    "target_check": "WITH s AS (SELECT l_linenumber, l_returnflag, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2), t AS (SELECT l_linenumber, avg(score) AS macro, bool_and(score >= CASE l_returnflag WHEN 'N' THEN 0.0495::DOUBLE ELSE 0.049::DOUBLE END) AS floors_met, count(*) AS classes FROM s GROUP BY 1) SELECT l_linenumber, round(macro, 9) AS macro, floors_met, classes, floors_met AND macro >= 0.05::DOUBLE AND classes = 3 AS passed FROM t",
    "imbalance_definitions": f"""WITH {_STATS}, f AS (SELECT *, k = 3 AS c, a::DOUBLE / total AS fa, n::DOUBLE / total AS fn, r::DOUBLE / total AS fr FROM s)
        SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS sequence, count(DISTINCT o_custkey) AS series, count(*) AS total, count(*) FILTER (c) AS complete,
               count(*) FILTER (c AND greatest(fn, fr) / (fn + fr) <= 0.55::DOUBLE) AS kept_a, count(*) FILTER (c AND greatest(fn, fr) / (fn + fr) <= 0.90::DOUBLE) AS kept_a90,
               count(*) FILTER (c AND greatest(fa, fn, fr) <= 0.55::DOUBLE) AS kept_b, count(*) FILTER (c AND greatest(fn, fr) <= 0.55::DOUBLE) AS kept_c,
               count(*) FILTER (c AND least(fa, fn, fr) / greatest(fa, fn, fr) >= 0.55::DOUBLE) AS kept_d, count(*) FILTER (c AND least(fn, fr) / greatest(fn, fr) >= 0.55::DOUBLE) AS kept_e,
               count(*) FILTER (c AND fn + fr <= 0.55::DOUBLE) AS kept_f, count(*) FILTER (c AND greatest(fa, fn, fr) / least(fa, fn, fr) <= 55) AS kept_g
        FROM f GROUP BY GROUPING SETS ((o_orderpriority), ())""",
    "slice_filter_cap": _audit_sql([CONFIG], False).rsplit("SELECT o_orderpriority, count(*)", 1)[0] + "SELECT o_orderpriority, max(m) AS eligible, CAST(sum(i) AS BIGINT) AS rank_sum, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM e WHERE keep GROUP BY 1",
    "slice_filter_audit": _audit_sql([CONFIG], False),
    "multi_config_audit": _audit_sql(CONFIGS, True),
    "class_fractions": f"WITH {_STATS} SELECT l_orderkey, k AS num_classes, round(dom, 9) AS dominant, round(a::DOUBLE / total, 9) AS fraction_a, round(n::DOUBLE / total, 9) AS fraction_n, round(r::DOUBLE / total, 9) AS fraction_r FROM s",
    "sequence_classify": "SELECT page_id, CASE WHEN lower(url) LIKE '%space%' THEN 'T2_SPACE' WHEN lower(url) LIKE '%t2%' THEN 'T2' WHEN lower(url) LIKE '%t1%' THEN 'T1' ELSE 'Unknown' END AS sequence, url AS series_id, split_part(url, '_', 1) AS patient_id FROM pages",
    "label_map": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey % 300 BETWEEN 1 AND 99 THEN 1 WHEN l_partkey % 300 = 100 THEN 2 WHEN l_partkey % 300 >= 200 THEN 3 ELSE 0 END AS INT) AS label FROM lineitem",
    "split_train_val": "SELECT source, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS train, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS validation, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS unmatched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source",
    "dice_slice": f"WITH {_OVERLAP} SELECT class_id, {_RATIOS} FROM n GROUP BY class_id",
    "dice_case": f"WITH {_OVERLAP}, g AS ({_POOLED.format('label, ')}) SELECT class_id, {_RATIOS} FROM g GROUP BY class_id",
    "dice_pixel": f"WITH {_OVERLAP}, g AS ({_POOLED.format('')}) SELECT class_id, {_RATIOS} FROM g GROUP BY class_id",
    "precision_recall_f1": f"WITH {_OVERLAP}, g AS ({_POOLED.format('')}) SELECT class_id, round(i::DOUBLE / p, 9) AS precision, round(i::DOUBLE / t, 9) AS recall, round(2 * i::DOUBLE / (p + t), 9) AS f1 FROM g",
    "unsmoothed_dice": f"WITH {_OVERLAP} SELECT vec_id, round(avg(CASE WHEN p + t = 0 THEN 1.0::DOUBLE ELSE 2 * i::DOUBLE / (p + t) END), 9) AS dice_mean FROM n GROUP BY vec_id",
    "best_epoch": "SELECT event_type, min(event_id) + 1 AS best_epoch, min(value) AS best FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) WHERE value = m GROUP BY event_type",
    "pair_integrity": "SELECT CASE WHEN d.doc_id IS NULL THEN 'mask_only' WHEN l.doc_id IS NULL THEN 'image_only' ELSE 'pair' END AS status, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "cohort_fingerprint": "SELECT source, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS sha256 FROM documents GROUP BY source",
    "worst_k_per_metric": "WITH q AS (SELECT l_orderkey, sum(l_quantity) AS quantity, round(avg(l_discount), 9) AS discount FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, 'quantity' AS metric, quantity AS value FROM q UNION ALL SELECT l_orderkey, 'discount', discount FROM q), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY value, l_orderkey) AS INT) AS rank FROM u) SELECT * FROM w WHERE rank <= 10",
}

ORACLE |= formats.ORACLE | protocol.ORACLE
