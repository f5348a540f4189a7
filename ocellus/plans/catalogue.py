"""The query catalogue: each operator of the library applied to the driver's tables, with the SQL of its result.

Orders stand for graded eyes (group: customer, grade: priority, score: price), documents and labels for images and gradings, events for
quality measures, embeddings for 8 x 8 patches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocellus.functions import patches, scalars
from ocellus.operators import cache, manifest, metrics, quality, resample, splits, thresholds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# eyes: y grade, p and pb two predictions, score
def eyes(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders")
    y = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return o.select(
        F.col("o_orderkey").alias("image_id"),
        F.col("o_custkey").cast("string").alias("group"),
        y.alias("grade"),
        y.alias("y"),
        F.least(F.lit(4), F.floor(F.col("o_totalprice") / 100000)).cast("int").alias("p"),
        F.pmod("o_orderkey", F.lit(5)).cast("int").alias("pb"),
        F.col("o_totalprice").alias("score"),
    )


EYES = """eyes AS (SELECT o_orderkey AS image_id, cast(o_custkey AS VARCHAR) AS grp, cast(substr(o_orderpriority, 1, 1) AS INT) - 1 AS y,
  least(4, cast(floor(o_totalprice / 100000) AS INT)) AS p, cast(o_orderkey % 5 AS INT) AS pb, o_totalprice AS score FROM orders)"""
CELLS = EYES + """, labels5 AS (SELECT unnest([0, 1, 2, 3, 4]) AS l), cells AS (SELECT a.l AS y, b.l AS p, coalesce(n, 0) AS n FROM labels5 a CROSS JOIN labels5 b
  LEFT JOIN (SELECT y, p, count(*) AS n FROM eyes GROUP BY y, p) c ON c.y = a.l AND c.p = b.l)"""
QWK = "1 - sum(n * (y - p) * (y - p))::DOUBLE * sum(n) / (SELECT sum(r.n * c.n * (r.y - c.p) * (r.y - c.p)) FROM (SELECT y, sum(n) AS n FROM cells GROUP BY y) r, (SELECT p, sum(n) AS n FROM cells GROUP BY p) c)"
BY_LABEL = CELLS + ", byl AS (SELECT l, (SELECT sum(n) FROM cells WHERE y = l) AS nt, (SELECT sum(n) FROM cells WHERE p = l) AS np, (SELECT sum(n) FROM cells WHERE y = l AND p = l) AS tp FROM labels5)"


@query(f"WITH {CELLS} SELECT round({QWK}, 6) AS qwk FROM cells")
def qwk(spark, sf):
    return metrics.qwk(eyes(spark, sf)).select(F.round("qwk", 6).alias("qwk"))


@query(f"WITH {CELLS} SELECT y, p, n FROM cells")
def confusion(spark, sf):
    return metrics.confusion(eyes(spark, sf))


@query(f"WITH {CELLS} SELECT y, p, n, round(n / greatest(sum(n) OVER (PARTITION BY y), 1), 6) AS share FROM cells")
def confusion_row_normalised(spark, sf):
    return metrics.row_normalised(metrics.confusion(eyes(spark, sf))).withColumn("share", F.round("share", 6))


@query(f"WITH {BY_LABEL} SELECT round(avg(tp / nt) FILTER (WHERE nt > 0), 6) AS balanced_accuracy FROM byl")
def balanced_accuracy(spark, sf):
    return metrics.balanced_accuracy(eyes(spark, sf)).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"WITH {BY_LABEL} SELECT round(avg(coalesce(2 * tp / nullif(nt + np, 0), 0)), 6) AS macro_f1 FROM byl")
def macro_f1(spark, sf):
    return metrics.macro_f1(eyes(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(
    f"WITH {BY_LABEL} SELECT round((SELECT {QWK} FROM cells), 6) AS qwk, round((SELECT avg(cast(y = p AS INT)) FROM eyes), 6) AS accuracy, round((SELECT avg(abs(y - p)) FROM eyes), 6) AS mae, "
    "round(avg(tp / nt) FILTER (WHERE nt > 0), 6) AS balanced_accuracy, round(avg(coalesce(2 * tp / nullif(nt + np, 0), 0)), 6) AS macro_f1 FROM byl"
)
def classification_bundle(spark, sf):
    got = metrics.classification_bundle(eyes(spark, sf))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


# ranking: the score against grade >= 2
CURVE = EYES + """, counts AS (SELECT score, count(*) FILTER (WHERE y >= 2) AS pos, count(*) FILTER (WHERE y < 2) AS neg FROM eyes GROUP BY score),
curve AS (SELECT score, pos, neg, (sum(pos) OVER o)::BIGINT AS tp, (sum(neg) OVER o)::BIGINT AS fp, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0,
  lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg FROM counts WINDOW o AS (ORDER BY score DESC)),
roc AS (SELECT score AS threshold, tp, fp, tp / n1 AS tpr, fp / n0 AS fpr, n1, n0 FROM curve WHERE npos IS NULL OR npos <> pos OR nneg <> neg)"""
AUROC = "round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6)"
AP = "round(sum(pos * tp / (tp + fp)) / sum(pos), 6)"
POINT = """best AS (SELECT *, n1 - tp AS fn, n0 - fp AS tn FROM roc WHERE tp / n1 >= 0.9::DOUBLE ORDER BY fp, threshold DESC LIMIT 1)"""


def _counts(spark, sf):
    return metrics.score_counts(eyes(spark, sf), F.col("y") >= 2)


@query(f"WITH {CURVE} SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def roc_points(spark, sf):
    return metrics.roc_points(_counts(spark, sf)).withColumns({"tpr": F.round("tpr", 6), "fpr": F.round("fpr", 6)})


@query(f"WITH {CURVE} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / n1, 6) AS recall FROM curve")
def pr_points(spark, sf):
    return metrics.pr_points(_counts(spark, sf)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(f"WITH {CURVE} SELECT {AUROC} AS auroc FROM curve")
def auroc(spark, sf):
    return metrics.auroc(_counts(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {CURVE} SELECT {AP} AS average_precision FROM curve")
def average_precision(spark, sf):
    return metrics.average_precision(_counts(spark, sf)).select(F.round("average_precision", 6).alias("average_precision"))


@query(
    f"WITH {CURVE}, {POINT} SELECT (SELECT round(n1 / (n1 + n0), 6) FROM best) AS prevalence, (SELECT {AUROC} FROM curve) AS auroc, (SELECT {AP} FROM curve) AS average_precision, threshold, "
    "round(tp / n1, 6) AS sensitivity, round(tn / n0, 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv FROM best"
)
def referable_operating_point(spark, sf):
    got = metrics.referable_metrics(eyes(spark, sf))
    return got.select(*[F.round(c, 6).alias(c) if c != "threshold" else F.col(c) for c in got.columns])


# images (documents) and gradings (labels)
def _images(spark, sf):
    d = _read(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image_id"), F.col("source").alias("image_path"), "n_chars")


def _gradings(spark, sf):
    lab = _read(spark, sf, "labels")
    return lab.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image_id"), (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("grade"))


@query("SELECT 'd' || d.doc_id AS image_id, source AS image_path, n_chars, quality * 2 + toxic AS grade FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def manifest_join(spark, sf):
    return manifest.join_labels(_images(spark, sf), _gradings(spark, sf))


@query(
    "SELECT count(d.doc_id) AS n_images, count(l.doc_id) AS n_labels, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_matched, "
    "count(*) FILTER (WHERE l.doc_id IS NULL) AS n_unmatched_images, count(*) FILTER (WHERE d.doc_id IS NULL) AS n_unmatched_labels FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id"
)
def join_audit(spark, sf):
    return manifest.join_audit(_images(spark, sf), _gradings(spark, sf))


@query("SELECT 'd' || d.doc_id AS image_id, source AS image_path, n_chars FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def unmatched_images(spark, sf):
    return manifest.unmatched(_images(spark, sf), _gradings(spark, sf))


@query("SELECT 'd' || l.doc_id AS image_id, quality * 2 + toxic AS grade FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id")
def unmatched_labels(spark, sf):
    return manifest.unmatched(_gradings(spark, sf), _images(spark, sf))


@query("SELECT md5(text) AS image_id, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)")
def dedup_first(spark, sf):
    d = _read(spark, sf, "documents").select(F.md5("text").alias("image_id"), "doc_id", "source")
    return manifest.first_of(d, "image_id", F.col("doc_id"))


@query(r"SELECT page_id, lower(regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1)) AS stem, regexp_matches(lower(url), '(\.png|\.jpg|\.jpeg|\.jpe|\.tif|\.tiff|\.bmp|\.ppm)$') AS is_image FROM pages")
def stem_extract(spark, sf):
    return _read(spark, sf, "pages").select("page_id", scalars.stem(F.col("url")).alias("stem"), scalars.is_image(F.col("url")).alias("is_image"))


@query(r"SELECT p_partkey, regexp_replace(lower(trim(' ' || p_name || '.JPG ')), '\.(png|jpe?g|tiff?|bmp|ppm)$', '') AS image_id FROM part")
def strip_extension(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", scalars.normal_id(F.concat(F.lit(" "), "p_name", F.lit(".JPG "))).alias("image_id"))


@query(r"SELECT c_custkey, CASE WHEN regexp_matches(c_name, '(?i)^(?:(customer#0*[1-9]).*)') THEN regexp_extract(c_name, '(?i)^(?:(customer#0*[1-9]).*)', 1) ELSE c_name END AS grp FROM customer")
def group_regex(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", scalars.derive_group(F.col("c_name"), r"(customer#0*[1-9]).*").alias("grp"))


@query(r"SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '(?i)^(?:(.*)7$)') THEN regexp_extract(s_name, '(?i)^(?:(.*)7$)', 1) ELSE s_name END AS grp FROM supplier")
def missing_group_fallback(spark, sf):
    return _read(spark, sf, "supplier").select("s_suppkey", scalars.derive_group(F.col("s_name"), r"(.*)7$").alias("grp"))


def _raw_labels(spark, sf):
    p = _read(spark, sf, "part")
    return p.select(F.concat(F.lit(" "), F.upper("p_brand"), F.lit(".png")).alias("id"), F.when(F.col("p_size") % 7 == 0, F.lit("n/a")).otherwise((F.col("p_size") / 10).cast("string")).alias("level"))


RAW = "raw AS (SELECT regexp_replace(lower(trim(' ' || upper(p_brand) || '.png')), '\\.(png|jpe?g|tiff?|bmp|ppm)$', '') AS id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 10 END AS g FROM part)"


@query(f"WITH {RAW}, i AS (SELECT id, count(*) AS n, count(g) AS good FROM raw GROUP BY id) SELECT sum(n)::BIGINT AS n_rows, sum(n - good)::BIGINT AS n_bad_labels, sum(greatest(good - 1, 0))::BIGINT AS n_duplicates, count(*) FILTER (WHERE good > 0) AS n_usable FROM i")
def coerce_labels(spark, sf):
    return manifest.coercion_audit(_raw_labels(spark, sf), "id", "level")


@query(
    "SELECT 'c_custkey' AS \"column\", count(*) AS n_rows, count(DISTINCT c_custkey) AS n_distinct, count(DISTINCT c_custkey) / count(*) AS ratio FROM customer UNION ALL "
    "SELECT 'c_name', count(*), count(DISTINCT c_name), count(DISTINCT c_name) / count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) / count(*) FROM customer"
)
def guess_id_stats(spark, sf):
    return manifest.guess_id_stats(_read(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(cast(TRY_CAST({c} AS DOUBLE) IS NOT NULL AS INT)) AS numeric_share, max(abs(TRY_CAST({c} AS DOUBLE) - floor(TRY_CAST({c} AS DOUBLE)))) = 0 AS integral, "
        f"count(DISTINCT TRY_CAST({c} AS DOUBLE)) AS n_distinct, min(TRY_CAST({c} AS DOUBLE)) AS smallest FROM lineitem"
        for c in ("l_linenumber", "l_quantity", "l_discount")
    )
)
def guess_label_stats(spark, sf):
    return manifest.guess_label_stats(_read(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_discount"])


GRADES = "CASE y " + " ".join(f"WHEN {k} THEN '{k} - {v}'" for k, v in scalars.GRADE_NAMES.items()) + " END"


@query(f"WITH {EYES} SELECT y AS grade, {GRADES} AS grade_name, count(*) AS n_images, round_even(count(*) / (SELECT count(*) FROM eyes), 4) AS share, count(DISTINCT grp) AS n_groups FROM eyes GROUP BY y")
def class_summary(spark, sf):
    return manifest.class_summary(eyes(spark, sf))


@query(
    f"WITH {EYES}, g AS (SELECT least(y, 2) AS grade, grp FROM eyes), l AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS grade) "
    "SELECT l.grade, count(g.grade) AS n_images, round_even(count(g.grade) / (SELECT count(*) FROM g), 4) AS share, count(DISTINCT grp) AS n_groups FROM l LEFT JOIN g ON g.grade = l.grade GROUP BY l.grade"
)
def class_reindex(spark, sf):
    """Grades that no image has get a row of zeros."""
    rows = eyes(spark, sf).withColumn("grade", F.least("grade", F.lit(2)))
    return manifest.class_summary(rows).select("grade", "n_images", "share", "n_groups")


@query(f'WITH {EYES} SELECT grp AS "group", max(y) AS worst, count(*) AS n FROM eyes GROUP BY grp')
def worst_per_group(spark, sf):
    return manifest.group_sizes(eyes(spark, sf))


@query(f"WITH {EYES} SELECT y AS grade, count(DISTINCT grp) AS n_groups FROM eyes GROUP BY y")
def groups_per_class(spark, sf):
    return splits.groups_per_class(eyes(spark, sf))


@query(f"WITH {EYES} SELECT greatest(2, least(5, min(n)))::INT AS n_splits FROM (SELECT count(DISTINCT grp) AS n FROM eyes GROUP BY y)")
def safe_n_splits(spark, sf):
    return splits.safe_n_splits(eyes(spark, sf), 5)


GROUPS = EYES + ", g AS (SELECT grp, max(y) AS worst, count(*) AS n, md5('42:' || grp) AS h FROM eyes GROUP BY grp)"
BUDGET = 5000


@query(f'WITH {GROUPS} SELECT grp AS "group", worst, n FROM (SELECT *, sum(n) OVER (ORDER BY h, grp) - n AS before FROM g) WHERE before < {BUDGET}')
def subsample_prevalence(spark, sf):
    return manifest.sample_groups(manifest.group_sizes(eyes(spark, sf)), BUDGET)


@query(
    f'WITH {GROUPS}, t AS (SELECT *, row_number() OVER (PARTITION BY worst ORDER BY h, grp) AS turn FROM g) '
    f'SELECT grp AS "group", worst, n FROM (SELECT *, sum(n) OVER (ORDER BY turn, worst) - n AS before FROM t) WHERE before < {BUDGET}'
)
def subsample_balanced(spark, sf):
    return manifest.sample_groups(manifest.group_sizes(eyes(spark, sf)), BUDGET, "balanced")


@query(f'WITH {GROUPS} SELECT grp AS "group", worst, n, ((row_number() OVER (PARTITION BY worst ORDER BY h, grp) - 1) % 5)::INT AS fold FROM g')
def group_folds(spark, sf):
    return splits.group_folds(eyes(spark, sf), 5)


FOLDS = GROUPS + ", f AS (SELECT grp, ((row_number() OVER (PARTITION BY worst ORDER BY h, grp) - 1) % 4)::INT AS fold FROM g), s AS (SELECT eyes.*, f.fold = 0 AS test FROM eyes JOIN f ON f.grp = eyes.grp)"


@query(f"WITH {FOLDS} SELECT image_id, test FROM s")
def holdout_split(spark, sf):
    return splits.holdout(eyes(spark, sf)).select("image_id", "test")


@query(f"WITH {FOLDS} SELECT test, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, {', '.join(f'count(*) FILTER (WHERE y = {k}) AS grade_{k}' for k in range(5))} FROM s GROUP BY test")
def split_summary(spark, sf):
    return splits.split_summary(splits.holdout(eyes(spark, sf)))


@query(f'WITH {EYES} SELECT DISTINCT grp AS "group" FROM eyes WHERE y < 2 AND grp IN (SELECT grp FROM eyes WHERE y >= 2)')
def leakage_overlap(spark, sf):
    e = eyes(spark, sf)
    return splits.overlap(e.where("y < 2"), e.where("y >= 2"))


# the store of computed rows: events by user; a user's last event is its record
def _store(spark, sf):
    return _read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), "event_type", "value")


def _work(spark, sf):
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")


@query("SELECT user_id AS key, max(event_id) AS \"at\", arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def cache_latest(spark, sf):
    return cache.latest(_store(spark, sf))


@query("SELECT c_custkey AS key, c_name FROM customer SEMI JOIN events ON user_id = c_custkey")
def cache_reuse(spark, sf):
    return cache.reusable(_work(spark, sf), _store(spark, sf))


@query("SELECT c_custkey AS key, c_name FROM customer ANTI JOIN events ON user_id = c_custkey")
def cache_todo(spark, sf):
    return cache.left_to_do(_work(spark, sf), _store(spark, sf))


@query("SELECT c_custkey AS key, c_name, NULL::DOUBLE AS value FROM customer ANTI JOIN events ON user_id = c_custkey UNION ALL SELECT user_id, NULL, arg_max(value, event_id) FROM events GROUP BY user_id")
def cached_union_fresh(spark, sf):
    return cache.combined(cache.latest(_store(spark, sf)).select("key", "value"), cache_todo(spark, sf))


# quality measures of events: value as brightness, its square as focus
def _measures(spark, sf):
    e = _read(spark, sf, "events")
    return e.select("event_id", (F.col("event_id") % 5).cast("int").alias("grade"), F.col("value").alias("qc_brightness"), (F.col("value") * F.col("value")).alias("qc_focus"), F.lit(True).alias("gradable"), F.lit("").alias("qc_reasons"))


ABSOLUTE = "array_to_string(list_filter([CASE WHEN n_chars / 4000 < 0.2::DOUBLE THEN 'field_of_view_too_small' END, CASE WHEN n_chars < 300 THEN 'out_of_focus' END, CASE WHEN n_chars / 4000 > 0.92::DOUBLE THEN 'overexposed' END, CASE WHEN n_chars / 4000 < 0.06::DOUBLE THEN 'underexposed' END], lambda x: x IS NOT NULL), ';')"


@query(f"SELECT doc_id, {ABSOLUTE} AS qc_reasons FROM documents")
def qc_absolute_reasons(spark, sf):
    share = F.col("n_chars") / 4000
    return _read(spark, sf, "documents").select("doc_id", quality.absolute_reasons(share, F.col("n_chars"), share, min_focus=300).alias("qc_reasons"))


FLAGS = """m AS (SELECT event_id, (event_id % 5)::INT AS grade, value AS b, value * value AS f FROM events),
q AS (SELECT quantile_cont(b, 0.02) AS qb, quantile_cont(f, 0.02) AS qf, count(b) AS n FROM m),
flagged AS (SELECT event_id, grade, n >= 50 AND b <= qb AS dark, n >= 50 AND f <= qf AS blurred FROM m, q)"""
REASONS = "array_to_string(list_filter([CASE WHEN dark THEN 'cohort_dark' END, CASE WHEN blurred THEN 'cohort_blurred' END], lambda x: x IS NOT NULL), ';')"


@query(f"WITH {FLAGS} SELECT event_id, NOT dark AND NOT blurred AS gradable, {REASONS} AS qc_reasons FROM flagged")
def qc_cohort_flags(spark, sf):
    return quality.flag_cohort_outliers(_measures(spark, sf), 0.02).select("event_id", "gradable", "qc_reasons")


@query(f"WITH {FLAGS} SELECT event_id, grade FROM flagged WHERE NOT dark AND NOT blurred")
def qc_filtered(spark, sf):
    return quality.apply_quality_control(_measures(spark, sf), True, 0.02).select("event_id", "grade")


@query(f"WITH {FLAGS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({REASONS}, ';')) AS reason FROM flagged) WHERE reason <> '' GROUP BY reason")
def qc_reason_counts(spark, sf):
    return quality.reason_counts(quality.flag_cohort_outliers(_measures(spark, sf), 0.02))


# scores and decisions from the first five numbers of an embedding
FIVE = "v AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE) AS d FROM embeddings)"


def _five(spark, sf):
    return _read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("d"))


@query(f"WITH {FIVE} SELECT vec_id, round(list_sum(list_transform(d, lambda x, i: x * x * (i - 1))) / list_sum(list_transform(d, lambda x: x * x)), 6) AS score FROM v")
def expected_grade(spark, sf):
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x)
    share = F.transform("d", lambda x: x * x)
    return _five(spark, sf).select("vec_id", F.round(scalars.expected_class(share) / total, 6).alias("score"))


@query(f"WITH {FIVE} SELECT vec_id, round(list_sum(list_transform(d, lambda x, i: exp(x - list_max(d)) * (i - 1))) / list_sum(list_transform(d, lambda x: exp(x - list_max(d)))), 6) AS score FROM v")
def softmax_score(spark, sf):
    return _five(spark, sf).select("vec_id", F.round(scalars.softmax_class(F.col("d")), 6).alias("score"))


CUTS = [50000.0, 100000.0, 200000.0, 300000.0]


@query(f"WITH {EYES} SELECT image_id, {' + '.join(f'(score > {c})::INT' for c in CUTS)} AS class FROM eyes")
def threshold_cut(spark, sf):
    return eyes(spark, sf).select("image_id", scalars.cut(F.col("score"), CUTS).alias("class"))


@query(f"WITH {EYES} SELECT image_id, (score >= 150000)::INT AS refer, (y >= 2)::INT AS referable FROM eyes")
def refer_decision(spark, sf):
    return eyes(spark, sf).select("image_id", scalars.refer(F.col("score"), 150000.0).alias("refer"), scalars.referable(F.col("y")).alias("referable"))


@query(
    f"WITH {EYES}, n AS (SELECT count(*) AS n FROM eyes), c AS (SELECT cut, (SELECT count(*) FROM eyes WHERE y < cut) / (SELECT n FROM n) AS share FROM (SELECT unnest([1, 2, 3, 4]) AS cut)), o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k FROM eyes), "
    "w AS (SELECT cut, share, share * ((SELECT n FROM n) - 1) AS place FROM c) SELECT cut, round(share, 6) AS share, round(a.score + (place - floor(place)) * (b.score - a.score), 4) AS threshold FROM w JOIN o a ON a.k = floor(place) JOIN o b ON b.k = ceil(place)"
)
def threshold_init(spark, sf):
    got = thresholds.initial(eyes(spark, sf), scalars.LABELS)
    return got.select("cut", F.round("share", 6).alias("share"), F.round("threshold", 4).alias("threshold"))


@query("WITH d AS (SELECT DISTINCT l_quantity AS s FROM lineitem) SELECT candidate FROM (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS candidate FROM d) WHERE candidate IS NOT NULL")
def threshold_candidates(spark, sf):
    return thresholds.candidates(_read(spark, sf, "lineitem").select(F.col("l_quantity").alias("score")))


def _search_sql(sweeps: int = 3, most: int = thresholds.MOST_CANDIDATES) -> str:
    """Coordinate ascent as a recursion: each step moves one cut to where agreement is best, from sums over the bins above a cut."""
    taken = "list_sum(list_transform([0, 1, 2, 3], lambda m: CASE WHEN m = ((step + 4) % 4) THEN 0 ELSE {} END))"
    p = taken.format("g0[c[m + 1] + 1]") + " + g0[x + 1]"
    pp = taken.format("(2 * m + 1) * g0[c[m + 1] + 1]") + " + (2 * ((step + 4) % 4) + 1) * g0[x + 1]"
    py = taken.format("g1[c[m + 1] + 1]") + " + g1[x + 1]"
    return f"""
WITH RECURSIVE {EYES}, d AS (SELECT DISTINCT score AS s FROM eyes), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM d),
place AS (SELECT DISTINCT k, CASE WHEN n <= {most} THEN k::DOUBLE ELSE k * (n - 1)::DOUBLE / {most - 1} END AS pos FROM (SELECT DISTINCT n FROM o), range({most}) t(k) WHERE k < n),
q AS (SELECT DISTINCT a.s + (pos - floor(pos)) * (b.s - a.s) AS s FROM place JOIN o a ON a.r = floor(pos) JOIN o b ON b.r = ceil(pos)),
mid AS (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS m FROM q), marks AS (SELECT m, row_number() OVER (ORDER BY m) AS r FROM mid WHERE m IS NOT NULL), size AS (SELECT count(*) AS n_marks FROM marks),
bins AS (SELECT y, coalesce(r, 0) AS bin FROM (SELECT y, score FROM eyes) e ASOF LEFT JOIN marks ON e.score > marks.m), t AS (SELECT bin, count(*) AS n, sum(y) AS y, sum(y * y) AS yy FROM bins GROUP BY bin),
full_t AS (SELECT b, coalesce(n, 0) AS n, coalesce(y, 0) AS y, coalesce(yy, 0) AS yy FROM (SELECT unnest(range((SELECT n_marks + 2 FROM size))) AS b) LEFT JOIN t ON t.bin = b),
g AS (SELECT list(a0 ORDER BY b) AS g0, list(a1 ORDER BY b) AS g1 FROM (SELECT b, sum(n) OVER w::DOUBLE AS a0, sum(y) OVER w::DOUBLE AS a1 FROM full_t WINDOW w AS (ORDER BY b DESC))),
tot AS (SELECT sum(n)::DOUBLE AS n, sum(y)::DOUBLE AS y, sum(yy)::DOUBLE AS yy FROM full_t),
share AS (SELECT j, (SELECT count(*) FROM eyes WHERE y < j) / (SELECT count(*) FROM eyes) * ((SELECT count(*) FROM eyes) - 1) AS pos FROM (SELECT unnest([1, 2, 3, 4]) AS j)), e AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k FROM eyes),
first AS (SELECT j, a.score + (pos - floor(pos)) * (b.score - a.score) AS v FROM share JOIN e a ON a.k = floor(pos) JOIN e b ON b.k = ceil(pos)),
start AS (SELECT list(least((SELECT count(*) FROM marks WHERE m < v) + 1, (SELECT n_marks FROM size)) ORDER BY j) AS c FROM first),
st AS (
  SELECT -1 AS step, c, -2.0::DOUBLE AS best FROM start
  UNION ALL
  SELECT step + 1, CASE WHEN list_max(ks) > best + 1e-9 THEN list_transform(c, lambda v, i: CASE WHEN i = (step + 4) % 4 + 1 THEN lo + list_position(ks, list_max(ks)) - 1 ELSE v END) ELSE c END, CASE WHEN step < 0 THEN ks[1] WHEN list_max(ks) > best + 1e-9 THEN list_max(ks) ELSE best END
  FROM (SELECT step, c, best, lo, list_transform(es, lambda v: CASE WHEN v['e'] > 1e-12 THEN 1 - v['a'] / v['e'] ELSE 0 END) AS ks FROM (
    SELECT *, list_transform(xs, lambda x: {{'a': ({pp}) + yy - 2 * ({py}), 'e': (n * (({pp}) + yy) - 2 * ({p}) * y) / n}}) AS es FROM (
      SELECT st.*, g0, g1, n, y, yy, CASE WHEN step < 0 THEN c[4] WHEN step % 4 = 0 THEN 0 ELSE c[step % 4] END AS lo,
             CASE WHEN step < 0 THEN range(c[4], c[4] + 1) ELSE range(CASE WHEN step % 4 = 0 THEN 0 ELSE c[step % 4] END, CASE WHEN step % 4 = 3 THEN (SELECT n_marks FROM size) ELSE c[step % 4 + 2] END + 1) END AS xs
      FROM st, g, tot WHERE step < {4 * sweeps})))
)
SELECT cut, threshold FROM (SELECT unnest([1, 2, 3, 4])::INT AS cut, unnest(c) AS b FROM st WHERE step = {4 * sweeps}) JOIN (SELECT r AS b, m AS threshold FROM marks UNION ALL SELECT 0, min(m) - 1 FROM marks UNION ALL SELECT n_marks + 1, (SELECT max(m) + 1 FROM marks) FROM size) f USING (b)
"""


@query(_search_sql())
def threshold_search(spark, sf):
    got = thresholds.search(eyes(spark, sf), scalars.LABELS)
    return spark.createDataFrame([(k + 1, float(t)) for k, t in enumerate(got)], "cut int, threshold double")


# patches: 64 numbers of an embedding as 8 x 8 pixels
PIXELS = "x AS (SELECT vec_id, (i - 1)::INT AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def _patch(spark, sf):
    return _read(spark, sf, "embeddings").select("vec_id", patches.values("embedding").alias("v"))


@query(f"WITH {PIXELS}, m AS (SELECT vec_id, avg(v) AS m FROM x GROUP BY vec_id), c AS (SELECT vec_id, m, avg((v - m) ** 2) AS c2, avg((v - m) ** 3) AS c3, avg((v - m) ** 4) AS c4 FROM x JOIN m USING (vec_id) GROUP BY vec_id, m) SELECT vec_id, round(m, 6) AS mean, round(sqrt(c2), 6) AS std, round(c3 / c2 ** 1.5, 5) AS skew, round(c4 / c2 ** 2 - 3, 5) AS kurt FROM c")
def patch_moments(spark, sf):
    p = _patch(spark, sf).withColumn("m", patches.mean("v")).select("vec_id", "m", *[patches.central("v", "m", k).alias(f"c{k}") for k in (2, 3, 4)])
    return p.select("vec_id", F.round("m", 6).alias("mean"), F.round(F.sqrt("c2"), 6).alias("std"), F.round(F.col("c3") / F.pow("c2", F.lit(1.5)), 5).alias("skew"), F.round(F.col("c4") / (F.col("c2") * F.col("c2")) - 3, 5).alias("kurt"))


PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


@query(f"WITH {PIXELS} SELECT vec_id, {', '.join(f'round(quantile_cont(v, {p / 100}), 6) AS p{p}' for p in PERCENTILES)} FROM x GROUP BY vec_id")
def patch_percentiles(spark, sf):
    p = _patch(spark, sf).select("vec_id", F.array_sort("v").alias("s"))
    return p.select("vec_id", *[F.round(patches.percentile("s", q / 100), 6).alias(f"p{q}") for q in PERCENTILES])


@query(f"WITH {PIXELS}, q AS (SELECT vec_id, least(7, greatest(0, floor((v - (-0.6::DOUBLE)) / 1.2::DOUBLE * 8)::INT)) AS l FROM x), c AS (SELECT vec_id, l, count(*) / 64 AS s FROM q GROUP BY ALL) SELECT vec_id, round(-sum(s * log2(s)), 6) AS entropy FROM c GROUP BY vec_id")
def patch_entropy(spark, sf):
    p = _patch(spark, sf).select("vec_id", patches.quantised("v", 8, -0.6, 0.6).alias("q"))
    return p.select("vec_id", F.round(patches.entropy("q"), 6).alias("entropy"))


@query(f"WITH {PIXELS}, m AS (SELECT vec_id, median(v) AS m FROM x GROUP BY vec_id), d AS (SELECT vec_id, m, median(abs(v - m)) AS mad FROM x JOIN m USING (vec_id) GROUP BY vec_id, m) SELECT vec_id, round(greatest(m + 3.5::DOUBLE * 1.4826::DOUBLE * mad, 0.01::DOUBLE), 6) AS cutoff FROM d")
def patch_mad_cut(spark, sf):
    p = _patch(spark, sf).withColumn("s", F.array_sort("v")).withColumn("m", patches.percentile("s", 0.5))
    p = p.withColumn("a", F.expr("array_sort(transform(v, x -> abs(x - m)))"))
    return p.select("vec_id", F.round(F.greatest(F.col("m") + 3.5 * 1.4826 * patches.percentile("a", 0.5), F.lit(0.01)), 6).alias("cutoff"))


@query(f"WITH {PIXELS}, m AS (SELECT vec_id, quantile_cont(v, 0.9) AS q FROM x GROUP BY vec_id) SELECT vec_id, round(avg(v), 6) AS tail_mean FROM x JOIN m USING (vec_id) WHERE v >= q GROUP BY vec_id")
def patch_tail_mean(spark, sf):
    p = _patch(spark, sf).withColumn("s", F.array_sort("v")).withColumn("q", patches.percentile("s", 0.9)).withColumn("t", F.expr("filter(v, x -> x >= q)"))
    return p.select("vec_id", F.round(patches.mean("t"), 6).alias("tail_mean"))


@query(f"WITH {PIXELS}, z AS (SELECT vec_id, least(3, floor(sqrt((i // 8 - 3.5) ** 2 + (i % 8 - 3.5) ** 2) / 4 * 4))::INT AS z, avg(v) AS m FROM x GROUP BY ALL) SELECT vec_id, round(regr_slope(m, z), 6) AS slope, round(max(m) FILTER (WHERE z = 0) , 6) AS centre FROM z GROUP BY vec_id")
def zone_profile_slope(spark, sf):
    p = _patch(spark, sf).select("vec_id", patches.zone_means("v", 8, 4).alias("z"))
    return p.select("vec_id", F.round(patches.slope("z", 4), 6).alias("slope"), F.round(F.col("z")[0], 6).alias("centre"))


_LBP_BITS = [f"(embedding[i + 1 + ({a * 8 + b})] >= embedding[i + 1])::INT" for a, b in patches.AROUND]


@query(
    f"WITH b AS (SELECT vec_id, [{', '.join(_LBP_BITS)}] AS b FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings) WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6), "
    f"c AS (SELECT vec_id, CASE WHEN {' + '.join(f'abs(b[{k + 1}] - b[{(k + 1) % 8 + 1}])' for k in range(8))} <= 2 THEN list_sum(b) ELSE 9 END AS c FROM b) "
    f"SELECT vec_id, {', '.join(f'round(count(*) FILTER (WHERE c = {k}) / count(*), 6) AS lbp_{k}' for k in range(10))} FROM c GROUP BY vec_id"
)
def lbp_hist(spark, sf):
    p = _patch(spark, sf).select("vec_id", patches.lbp_codes("v", 8).alias("c")).select("vec_id", patches.histogram("c", 10).alias("h"))
    return p.select("vec_id", *[F.round(F.col("h")[k], 6).alias(f"lbp_{k}") for k in range(10)])


@query(
    f"WITH {PIXELS}, q AS (SELECT vec_id, i, least(7, greatest(0, floor((v - (-0.6::DOUBLE)) / 1.2::DOUBLE * 8)::INT)) AS l FROM x), "
    "p AS (SELECT a.vec_id, a.l AS a, b.l AS b FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.i % 8 < 7), "
    "s AS (SELECT vec_id, a, b FROM p UNION ALL SELECT vec_id, b, a FROM p), n AS (SELECT vec_id, a, b, count(*) / 112 AS p FROM s GROUP BY ALL) "
    "SELECT vec_id, round(sum(p * (a - b) ** 2), 9) AS contrast, round(sum(p * abs(a - b)), 9) AS dissimilarity, round(sum(p / (1 + (a - b) ** 2)), 9) AS homogeneity, round(sum(p * p), 9) AS asm, round(sqrt(sum(p * p)), 9) AS energy FROM n GROUP BY vec_id"
)
def glcm_stats(spark, sf):
    p = _patch(spark, sf).select("vec_id", patches.quantised("v", 8, -0.6, 0.6).alias("q")).select("vec_id", patches.pairs("q", 8).alias("p"))
    over = lambda e: F.expr(f"aggregate(p, cast(0 as double), (acc, t) -> acc + {e}) / size(p)")
    p = p.withColumn("k", F.expr("concat(transform(p, t -> t.a * 8 + t.b), transform(p, t -> t.b * 8 + t.a))"))
    asm = F.expr("aggregate(transform(array_distinct(k), x -> pow(cast(size(filter(k, y -> y = x)) as double) / size(k), 2)), cast(0 as double), (acc, t) -> acc + t)")
    p = p.withColumn("asm", asm)
    return p.select("vec_id", F.round(over("(t.a - t.b) * (t.a - t.b)"), 9).alias("contrast"), F.round(over("abs(t.a - t.b)"), 9).alias("dissimilarity"), F.round(over("1D / (1 + (t.a - t.b) * (t.a - t.b))"), 9).alias("homogeneity"), F.round("asm", 9).alias("asm"), F.round(F.sqrt("asm"), 9).alias("energy"))


@query(
    "WITH l AS (SELECT vec_id, embedding[CASE WHEN i < 8 THEN i ELSE i - 8 END + 1]::DOUBLE + embedding[CASE WHEN i >= 56 THEN i ELSE i + 8 END + 1]::DOUBLE + embedding[CASE WHEN i % 8 = 0 THEN i ELSE i - 1 END + 1]::DOUBLE + embedding[CASE WHEN i % 8 = 7 THEN i ELSE i + 1 END + 1]::DOUBLE - 4 * embedding[i + 1]::DOUBLE AS l "
    "FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)) SELECT vec_id, round(var_pop(l), 5) AS focus FROM l GROUP BY vec_id"
)
def laplacian_focus(spark, sf):
    p = _patch(spark, sf).select("vec_id", patches.laplacian("v", 8).alias("l")).withColumn("m", patches.mean("l"))
    return p.select("vec_id", F.round(patches.central("l", "m", 2), 5).alias("focus"))


# importance tables from parts: the type is a feature, the price its importance
def _importances(spark, sf):
    p = _read(spark, sf, "part")
    by = p.groupBy("p_type").agg((F.avg("p_retailprice") - 1400).alias("importance"))
    family = F.element_at(F.array(*[F.lit(x) for x in scalars.FAMILIES]), F.pmod(F.length("p_type"), F.lit(len(scalars.FAMILIES))).cast("int") + 1)
    return by.select(F.concat_ws("_", family, F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("feature"), "importance")


FEATURES = f"f AS (SELECT [{', '.join(repr(x) for x in scalars.FAMILIES)}][length(p_type) % {len(scalars.FAMILIES)} + 1] AS family, [{', '.join(repr(x) for x in scalars.FAMILIES)}][length(p_type) % {len(scalars.FAMILIES)} + 1] || '_' || lower(replace(p_type, ' ', '_')) AS feature, avg(p_retailprice) - 1400 AS importance FROM part GROUP BY p_type)"


@query(f"WITH {FEATURES} SELECT family, round(sum(greatest(importance, 0)), 4) AS importance, count(*) AS n FROM f GROUP BY family")
def family_rollup(spark, sf):
    return _importances(spark, sf).groupBy(scalars.feature_family(F.col("feature")).alias("family")).agg(F.round(F.sum(F.greatest("importance", F.lit(0.0))), 4).alias("importance"), F.count("*").alias("n"))


@query(f"WITH {FEATURES} SELECT feature, round(importance, 4) AS importance FROM f ORDER BY f.importance DESC, feature LIMIT 12")
def top_k_features(spark, sf):
    return _importances(spark, sf).orderBy(F.desc("importance"), "feature").limit(12).withColumn("importance", F.round("importance", 4))


@query("WITH s AS (SELECT c_mktsegment AS model, avg(c_acctbal) AS v FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, model) AS k FROM s) SELECT max(model) FILTER (WHERE k = 1) AS best, max(model) FILTER (WHERE k = 2) AS runner_up, round(max(v) FILTER (WHERE k = 1) - max(v) FILTER (WHERE k = 2), 4) AS lead FROM r")
def best_and_runner_up(spark, sf):
    s = _read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.avg("c_acctbal").alias("v"))
    top = s.orderBy(F.desc("v"), "model").limit(2).agg(F.sort_array(F.collect_list(F.struct(-F.col("v"), "model", "v"))).alias("t"))  # two rows
    return top.select(F.col("t")[0]["model"].alias("best"), F.col("t")[1]["model"].alias("runner_up"), F.round(F.col("t")[0]["v"] - F.col("t")[1]["v"], 4).alias("lead"))


@query("SELECT l_orderkey AS image_id, " + ", ".join(f"sum(l_quantity) FILTER (WHERE l_linenumber = {k}) AS pred_m{k}" for k in (1, 2, 3)) + " FROM lineitem GROUP BY l_orderkey")
def model_pivot(spark, sf):
    rows = _read(spark, sf, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("image_id")).pivot("l_linenumber", [1, 2, 3]).agg(F.sum("l_quantity")).select("image_id", *[F.col(str(k)).alias(f"pred_m{k}") for k in (1, 2, 3)])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 2")
def head_per_group(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    return _read(spark, sf, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 2").select("conv_id", "turn", "role")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def bulk_summary(spark, sf):
    rows = _read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query()
def bootstrap_ci(spark, sf):
    return resample.bootstrap_ci(eyes(spark, sf))


@query()
def paired_bootstrap(spark, sf):
    return resample.paired_bootstrap(eyes(spark, sf), "p", "pb")


# learning: embeddings as descriptors, half of the label as grade, four neighbours as a group
def _vectors(spark, sf, n=64):
    e = _read(spark, sf, "embeddings")
    cols = [F.element_at("embedding", k + 1).cast("double").alias(f"{list(scalars.FAMILIES)[k % 4]}_{k}") for k in range(n)]
    return e.select(F.col("vec_id").alias("image_id"), F.floor(F.col("vec_id") / 4).cast("string").alias("group"), F.floor(F.col("label") / 2).cast("int").alias("grade"), *cols)


def _learn(name: str):
    def run(spark, sf):
        from ocellus.ml import models
        from ocellus.operators.extract import feature_columns

        rows = _vectors(spark, sf)
        cols = feature_columns(rows)
        split = splits.holdout(rows).persist()
        got = models.fit(name, split.where("not test"), cols).transform(split.where("test"))
        return got.select("image_id", "grade", "prediction", F.round("score", 6).alias("score"))

    return run


for _name in ("dummy_frequent", "dummy_stratified", "logreg", "random_forest", "hist_gbm", "ordinal_gbm"):
    QUERIES[f"{_name}_predictions"] = _learn(_name)

_HELD = (
    "v AS (SELECT vec_id AS image_id, cast(vec_id // 4 AS VARCHAR) AS grp, cast(label // 2 AS INT) AS grade FROM embeddings), w AS (SELECT grp, max(grade) AS worst, md5('42:' || grp) AS h FROM v GROUP BY grp), "
    "k AS (SELECT greatest(2, least(4, min(n))) AS k FROM (SELECT count(DISTINCT grp) AS n FROM v GROUP BY grade)), "
    "f AS (SELECT grp, (row_number() OVER (PARTITION BY worst ORDER BY h, grp) - 1) % k = 0 AS test FROM w, k), s AS (SELECT v.*, test FROM v JOIN f ON f.grp = v.grp), "
    "c AS (SELECT grade, count(*) AS n FROM s WHERE NOT test GROUP BY grade)"
)
ORACLES["dummy_frequent_predictions"] = f"WITH {_HELD}, m AS (SELECT grade FROM c ORDER BY n DESC, grade LIMIT 1) SELECT image_id, s.grade, m.grade AS prediction, m.grade::DOUBLE AS score FROM s, m WHERE test"
ORACLES["dummy_stratified_predictions"] = (
    f"WITH {_HELD}, l AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS grade), q AS (SELECT l.grade, sum(coalesce(n, 0)) OVER (ORDER BY l.grade) / (SELECT sum(n) FROM c) AS upto FROM l LEFT JOIN c ON c.grade = l.grade), "
    "u AS (SELECT image_id, grade, ('0x' || substr(md5('draw:' || image_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s WHERE test) "
    "SELECT image_id, u.grade, coalesce(min(q.grade) FILTER (WHERE u.u < q.upto), 4)::INT AS prediction, coalesce(min(q.grade) FILTER (WHERE u.u < q.upto), 4)::DOUBLE AS score FROM u, q GROUP BY image_id, u.grade"
)


@query()
def leakage_audit(spark, sf):
    from ocellus.config import Config
    from ocellus.ml import protocol

    rows = _vectors(spark, sf).persist()
    got = protocol.leakage_audit(rows, protocol.feature_columns(rows), "logreg", Config())
    return spark.createDataFrame([tuple(got.values())], "model string, grouped_qwk double, random_qwk double, optimism double")


@query()
def nested_cv(spark, sf):
    """With the default folds, inner and outer; three draws of settings, where the default is ten."""
    from ocellus.config import Config, Modeling
    from ocellus.ml import protocol

    rows = _vectors(spark, sf).persist()
    got = protocol.nested(rows, protocol.feature_columns(rows), ("logreg",), Config(modeling=Modeling(n_search_iter=3)))
    return spark.createDataFrame([(r["model"], r["fold"], r["qwk"]) for r in got], "model string, fold int, qwk double")


@query()
def permutation_importance(spark, sf):
    from ocellus.config import Config
    from ocellus.ml import models, protocol

    rows = _vectors(spark, sf)
    cols = protocol.feature_columns(rows)
    split = splits.holdout(rows).persist()
    return protocol.permutation_importance(models.fit("logreg", split.where("not test"), cols), split.where("test"), cols, Config().modeling.permutation_repeats)


@query()
def family_ablation(spark, sf):
    from ocellus.config import Config
    from ocellus.ml import protocol

    rows = _vectors(spark, sf).persist()
    got = protocol.family_ablation(rows, protocol.feature_columns(rows), "logreg", Config())
    return spark.createDataFrame([tuple(r.values()) for r in got], "family string, n int, all_qwk double, only_qwk double, without_qwk double, loss double")


@query()
def image_extract(spark, sf):
    """Descriptors of the default synthetic cohort: 320 pictures of 512 x 512. No table of the driver's holds pictures."""
    from ocellus.config import Features, Synthetic
    from ocellus.operators.extract import describe, schema
    from ocellus.sources.tables import synthetic

    features = Features()
    pictures = synthetic(spark, Synthetic())
    out = schema(features)
    names = out.fieldNames()

    def run(batches):
        import pandas as pd

        from ocellus.config import Quality
        from ocellus.kernels.render import unpng

        for b in batches:
            yield pd.DataFrame([describe(r.image_id, "", lambda r=r: unpng(r.png), features, Quality()) for r in b.itertuples()]).reindex(columns=names)

    return pictures.mapInPandas(run, out)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low FROM events GROUP BY ALL")
def quality_windows(spark, sf):
    from ocellus.streaming.events import quality_windows as windows

    return windows(_read(spark, sf, "events")).withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 9 < 8 THEN [" + ", ".join(repr(x) for x in scalars.FAMILIES) + "][p_size % 9 + 1] ELSE 'other' END AS family, "
    "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in scalars.FAMILIES.items()) + "}[CASE WHEN p_size % 9 < 8 THEN [" + ", ".join(repr(x) for x in scalars.FAMILIES) + "][p_size % 9 + 1] ELSE 'other' END], 'image descriptor') AS description FROM part"
)
def feature_descriptions(spark, sf):
    heads = F.array(*[F.lit(x) for x in (*scalars.FAMILIES, "odd")])
    name = F.concat_ws("_", F.element_at(heads, (F.col("p_size") % 9 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return _read(spark, sf, "part").select("p_partkey", scalars.feature_family(name).alias("family"), scalars.describe_feature(name).alias("description"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id")
def column_moments(spark, sf):
    m = scalars.moments("value")
    return _read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(m["mean"], 6).alias("mean"), F.round(m["std"], 6).alias("std"))


@query("SELECT o_orderkey, round_even(o_custkey / 8, 2) AS rounded FROM orders")
def half_even_rounding(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", F.bround(F.col("o_custkey") / 8, 2).alias("rounded"))


@query("SELECT substr(sha1('{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}'), 1, 12) AS signature, c_custkey FROM customer")
def settings_signature(spark, sf):
    return _read(spark, sf, "customer").select(scalars.signature(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s")).alias("signature"), "c_custkey")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM events")
def finite_values(spark, sf):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _read(spark, sf, "events").select("event_id", scalars.finite(odd).alias("value"))
