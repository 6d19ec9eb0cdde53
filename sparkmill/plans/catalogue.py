"""The registered queries, each over whole tables, and the SQL that they are held against.

Tables stand for what the operators work on: `documents` are files (text:
content, source: supplied split), `labels.quality` is their class, `pages` are
files with paths, `lineitem` gives scores with many ties, `events` scores some
of which are no probabilities, `embeddings` frozen features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, destination_name, digest, has_suffix, suffix
from ..operators import issues, metrics, registry, splitting, training, triage
from ..operators import manifest as audit
from ..schema import EXPERIMENT

NAMES = ("Normal", "Pothole")
PAGE_SUFFIXES = (".html",)
#: Characters of a document that counts as readable, at least.
SHORTEST = 100

# The figures of the experiments of record; their prose is not needed.
RUNS = [
    ("naive_majority_v1", None, None, None, 0.0, "yes", 0.724324, 0.420063, 0.724324, 1.0, 0.0, 0.5),
    ("cnn_unweighted_v1", None, None, None, 1141.9, "yes", 0.789189, 0.673898, 0.795031, 0.955224, 0.352941, 0.867574),
    ("cnn_class_weighted_v2", None, None, None, 1045.3, "yes", 0.821622, 0.775295, 0.874074, 0.880597, 0.666667, 0.846064),
    ("mobilenetv2_frozen_v3", None, None, None, 1278.0, "no", 0.92973, 0.915463, 0.976378, 0.925373, 0.941176, 0.983611),
    ("mobilenetv2_frozen_v4", None, None, None, 635.4, "yes", 0.945946, 0.933126, 0.969697, 0.955224, 0.921569, 0.985806),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, split, label (null without one), sha256, readable (has SHORTEST characters)."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, NAMES[1]).when(F.col("quality") == 0, NAMES[0]).alias("label"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("split"), digest(F.col("text")).alias("sha256"), F.coalesce(F.length("text") >= SHORTEST, F.lit(False)).alias("readable"))
    return docs.join(labels, "doc_id", "left")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.first_wins(_files(spark, sf_dir).where("label is not null"), [F.col("split"), F.col("label"), F.col("doc_id")])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.stratified_split(_pool(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * F.lit(10.0)).alias("p"))


def q01_suffix_filter(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return pages.where(has_suffix(F.col("url"), PAGE_SUFFIXES)).select("page_id", suffix(F.col("url")).alias("suffix"), basename(F.col("url")).alias("name"))


def q02_class_counts(spark, sf_dir):
    return audit.class_counts(_files(spark, sf_dir))


def q02b_readability(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    readable = F.coalesce(F.startswith("html", F.lit("<!DOCTYPE")), F.lit(False))
    return pages.groupBy(readable.alias("readable")).agg(F.count("*").alias("n_files"))


def q03_manifest(spark, sf_dir):
    path = F.concat(F.col("split"), F.lit("/"), F.coalesce("label", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return audit.manifest(_files(spark, sf_dir), path, F.col("split"), F.col("label"), sha256=F.col("sha256"))


def q04_first_wins(spark, sf_dir):
    return _pool(spark, sf_dir).select("doc_id", "split", "label", "sha256")


def q05_cross_split_duplicates(spark, sf_dir):
    return audit.spread_files(_files(spark, sf_dir).drop("label")).select("sha256", "doc_id", "split", "n_files", "n_splits")


def q05b_conflicting_labels(spark, sf_dir):
    return audit.conflicting_digests(_files(spark, sf_dir).where("label is not null"))


def q06_warnings(spark, sf_dir):
    files = _files(spark, sf_dir)
    return audit.warnings(audit.split_counts(files), audit.spread_digests(files))


def q06b_class_sets(spark, sf_dir):
    return audit.class_sets(audit.split_counts(_files(spark, sf_dir)))


def q07_report(spark, sf_dir):
    files = _files(spark, sf_dir)
    return audit.report(audit.split_counts(files), audit.unreadable(files, F.col("readable"), "split", "sha256"))


def q08_stratified_split(spark, sf_dir):
    return _parts(spark, sf_dir).select("doc_id", "label", "sha256", "split")


def q09_split_summary(spark, sf_dir):
    return splitting.summary(_parts(spark, sf_dir), *NAMES)


def q10_destination_names(spark, sf_dir):
    path = F.concat(F.lit("files/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = destination_name(F.col("sha256"), path)
    return _parts(spark, sf_dir).select("doc_id", F.concat_ws("/", "split", "label", name).alias("destination"))


def q11_zero_overlap(spark, sf_dir):
    return splitting.overlap(_parts(spark, sf_dir))


def q12_issue_log(spark, sf_dir):
    return issues.issue_log(_files(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit(audit.UNKNOWN))), NAMES[1])


def q13_class_weights(spark, sf_dir):
    return metrics.class_weights(_read(spark, sf_dir, "labels"), "quality")


def q14_selection_rows(spark, sf_dir):
    return splitting.selection_rows(_parts(spark, sf_dir)).select("doc_id", "label", "split")


def q15_predictions(spark, sf_dir):
    return metrics.predictions(_scores(spark, sf_dir), ["l_orderkey", "l_linenumber"], F.col("y"), F.col("p"))


def _counts(spark, sf_dir) -> DataFrame:
    return metrics.confusion(_scores(spark, sf_dir), F.col("y"), metrics.predicted(F.col("p"), metrics.THRESHOLD))


def q16_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_counts(spark, sf_dir))


def q17_metrics(spark, sf_dir):
    auc = metrics.roc_auc(_scores(spark, sf_dir), F.col("y"), F.col("p"))
    return metrics.figures(_counts(spark, sf_dir)).unionByName(auc.select(F.lit("roc_auc").alias("metric"), F.lit("all").alias("class_name"), F.bround("auc", 6).alias("value")))


def q17b_naive_baseline(spark, sf_dir):
    """Always the majority class: class 1 wins ties."""
    rows = _scores(spark, sf_dir)
    # the counts of one guess follow from those of the classes
    n = rows.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    one = F.col("pos") >= F.col("neg")
    counts = n.select(F.when(one, F.col("pos")).otherwise(0).alias("tp"), F.when(one, F.col("neg")).otherwise(0).alias("fp"),
                      F.when(one, 0).otherwise(F.col("pos")).alias("fn"), F.when(one, 0).otherwise(F.col("neg")).alias("tn"))
    auc = metrics.roc_auc(rows, F.col("y"), F.lit(1.0))
    return metrics.figures(counts).unionByName(auc.select(F.lit("roc_auc").alias("metric"), F.lit("all").alias("class_name"), F.bround("auc", 6).alias("value")))


def q18_registry(spark, sf_dir):
    first = spark.createDataFrame(RUNS[:4], EXPERIMENT)
    # a record without the column, then the final one under the same name
    rough = spark.createDataFrame(RUNS[4:], EXPERIMENT).drop("valid_for_selection")
    runs = registry.upsert(registry.upsert(first, rough), spark.createDataFrame(RUNS[4:], EXPERIMENT))
    best = registry.best_valid(runs).select("run_name", F.lit(True).alias("best"))
    return runs.join(best, "run_name", "left").select("run_name", "valid_for_selection", "macro_f1", "training_seconds", F.coalesce("best", F.lit(False)).alias("best"))


def q19_triage(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", (F.col("value") / F.lit(100.0)).alias("p"))
    return triage.decide(rows, F.col("p")).select("event_id", "pothole_probability", "valid", "label", "confidence", "review_action")


def q20_config_keys(spark, sf_dir):
    keys = F.json_object_keys("props")
    required = F.array(F.lit("k"), F.lit("threshold"))
    missing = F.array_sort(F.array_except(required, F.coalesce(keys, F.array().cast("array<string>"))))
    return _read(spark, sf_dir, "events").select("event_id", keys.isNotNull().alias("is_object"), F.array_join(missing, ",").alias("missing"))


def q21_head_scores(spark, sf_dir):
    """A head trained on every vector: is its label 1?"""
    rows = _read(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 1).cast("int"))
    return training.score(rows, training.fit_head(rows, "embedding", "y"), "embedding").select("vec_id", "y", F.bround("p", 6).alias("p"), metrics.predicted(F.col("p"), 0.5).alias("predicted"))


def q22_majority_class(spark, sf_dir):
    return metrics.majority_class(_read(spark, sf_dir, "labels"), "quality")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and callable(f)}

_FILES = f"""files AS (
  SELECT d.doc_id, d.source AS split, sha256(d.text) AS sha256, coalesce(length(d.text) >= {SHORTEST}, false) AS readable, CASE l.quality WHEN 1 THEN 'Pothole' WHEN 0 THEN 'Normal' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_PARTS = f"""{_FILES}, pool AS (
  SELECT * FROM files WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY split, label, doc_id) = 1),
placed AS (
  SELECT doc_id, label, sha256, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || sha256)) AS k, count(*) OVER (PARTITION BY label) AS n FROM pool),
parts AS (
  SELECT doc_id, label, sha256, CASE
    WHEN k <= round_even(n::DOUBLE * 0.70::DOUBLE, 0) THEN 'train'
    WHEN k <= round_even(n::DOUBLE * 0.70::DOUBLE, 0) + round_even(n::DOUBLE * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS split FROM placed)"""
_SPREAD = "spread AS (SELECT sha256, count(*) AS n_files, count(DISTINCT split) AS n_splits FROM files GROUP BY sha256 HAVING count(DISTINCT split) > 1)"
_COUNTS = "counts AS (SELECT split, label, count(*) AS n_files FROM files WHERE label IS NOT NULL GROUP BY ALL)"
_SETS = """splits AS (SELECT DISTINCT split FROM files), sets AS (
  SELECT s.split, coalesce(string_agg(c.label, ',' ORDER BY c.label), '') AS classes, count(c.label) AS n_classes, coalesce(sum(c.n_files), 0)::BIGINT AS n_files
  FROM splits s LEFT JOIN counts c ON s.split = c.split GROUP BY s.split)"""
_SCORES = "scores AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS y, l_discount * 10.0::DOUBLE AS p FROM lineitem)"


def _figures(counts: str, p: str) -> str:
    ratio = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"
    value = {}
    for name, (hit, wrong, missed) in {"Normal": ("tn", "fn", "fp"), "Pothole": ("tp", "fp", "fn")}.items():
        value[name] = {"precision": ratio(hit, f"{hit} + {wrong}"), "recall": ratio(hit, f"{hit} + {missed}"), "f1": ratio(f"2 * {hit}", f"2 * {hit} + {wrong} + {missed}"), "support": f"({hit} + {missed})::DOUBLE"}
    n = "tp + fp + fn + tn"
    rows = [(m, c, v) for c, x in value.items() for m, v in x.items()]
    for m in ("precision", "recall", "f1"):
        a, b = value["Normal"], value["Pothole"]
        x, y = "(tn + fn + fp > 0)::DOUBLE", "(tp + fp + fn > 0)::DOUBLE"
        rows.append((m, "macro avg", ratio(f"{a[m]} * {x} + {b[m]} * {y}", f"{x} + {y}")))
        rows.append((m, "weighted avg", ratio(f"{a[m]} * {a['support']} + {b[m]} * {b['support']}", n)))
    rows.append(("accuracy", "all", ratio("tp + tn", n)))
    selects = [f"SELECT '{m}' AS metric, '{c}' AS class_name, round_even({v}, 6) AS value FROM counts" for m, c, v in rows]
    auc = f"""SELECT 'roc_auc', 'all', round_even(sum(np * (below - nn + nn / 2)) / nullif(sum(np) * sum(nn), 0), 6) FROM (
      SELECT np, nn, sum(nn) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS below FROM (SELECT {p} AS p, sum(y)::DOUBLE AS np, sum(1 - y)::DOUBLE AS nn FROM scores GROUP BY 1))"""
    return f"WITH {_SCORES}, {counts} " + " UNION ALL ".join([*selects, auc])


_CONFUSION = """counts AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM scores)"""
_NAIVE = """counts AS (SELECT CASE WHEN sum(y) >= sum(1 - y) THEN sum(y) ELSE 0 END AS tp, CASE WHEN sum(y) >= sum(1 - y) THEN sum(1 - y) ELSE 0 END AS fp,
  CASE WHEN sum(y) >= sum(1 - y) THEN 0 ELSE sum(y) END AS fn, CASE WHEN sum(y) >= sum(1 - y) THEN 0 ELSE sum(1 - y) END AS tn FROM scores)"""
_NOTES = ", ".join(f"('{issue}', '{evidence}', '{risk}', '{action}')" for issue, (evidence, risk, _, action) in issues.NOTES.items())
_RUN_ROWS = ", ".join(f"('{r[0]}', '{r[5]}', {r[7]!r}::DOUBLE, {r[4]!r}::DOUBLE)" for r in RUNS)

SQL: dict[str, str] = {
    "q01_suffix_filter": r"SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS suffix, list_extract(string_split(url, '/'), -1) AS name FROM pages WHERE lower(regexp_extract(url, '(\.[^./]+)$', 1)) IN ('.html')",
    "q02_class_counts": f"WITH {_FILES}, {_COUNTS} SELECT * FROM counts",
    "q02b_readability": "SELECT coalesce(starts_with(html, '<!DOCTYPE'), false) AS readable, count(*) AS n_files FROM pages GROUP BY 1",
    "q03_manifest": f"""WITH {_FILES} SELECT split || '/' || coalesce(label, '') || '/' || doc_id || '.txt' AS filepath, split, coalesce(label, 'unknown') AS label,
      CASE WHEN label IS NULL THEN 'unverified_filename_prefix' ELSE 'class_folder' END AS label_source, 'unknown' AS group_id, sha256 FROM files""",
    "q04_first_wins": f"WITH {_PARTS} SELECT doc_id, split, label, sha256 FROM pool",
    "q05_cross_split_duplicates": f"WITH {_FILES}, {_SPREAD} SELECT sha256, doc_id, split, n_files, n_splits FROM files JOIN spread USING (sha256)",
    "q05b_conflicting_labels": f"""WITH {_FILES} SELECT sha256, count(*) AS n_files, count(DISTINCT label) AS n_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM files WHERE label IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT label) > 1""",
    "q06_warnings": f"""WITH {_FILES}, {_SPREAD}, {_COUNTS}, {_SETS}
      SELECT split || ': expected two classes but found [' || classes || ']' AS warning FROM sets WHERE n_classes <> 2
      UNION ALL SELECT 'class folders differ between splits' FROM (SELECT count(DISTINCT classes) AS n FROM sets) WHERE n > 1
      UNION ALL SELECT n || ' exact duplicate groups cross splits' FROM (SELECT count(*) AS n FROM spread) WHERE n > 0""",
    "q06b_class_sets": f"WITH {_FILES}, {_COUNTS}, {_SETS} SELECT * FROM sets",
    "q07_report": f"""WITH {_FILES}, {_COUNTS}, lost AS (SELECT split, count(*) FILTER (NOT readable) AS n FROM files GROUP BY split)
      SELECT l.split, '{{"split":"' || l.split || '","classes":[' || coalesce(string_agg('"' || label || '"', ',' ORDER BY label), '') || '],"class_counts":{{'
      || coalesce(string_agg('"' || label || '":' || n_files, ',' ORDER BY label), '') || '}},"unreadable_images":' || any_value(l.n) || '}}' AS report
      FROM lost l LEFT JOIN counts c ON l.split = c.split GROUP BY l.split""",
    "q08_stratified_split": f"WITH {_PARTS} SELECT doc_id, label, sha256, split FROM parts",
    "q09_split_summary": f"""WITH {_PARTS} SELECT split, count(*) AS rows, count(*) FILTER (label = 'Normal') AS normal_count, count(*) FILTER (label = 'Pothole') AS pothole_count,
      printf('%.6f', count(*) FILTER (label = 'Pothole')::DOUBLE / count(*)::DOUBLE) AS pothole_rate, 'stratified exact-hash-deduplicated' AS split_method, 42 AS seed, '' AS notes FROM parts GROUP BY split""",
    "q10_destination_names": f"WITH {_PARTS} SELECT doc_id, split || '/' || label || '/' || substr(sha256, 1, 12) || '_' || doc_id || '.txt' AS destination FROM parts",
    "q11_zero_overlap": f"WITH {_PARTS} SELECT count(*) AS overlap_groups FROM (SELECT sha256 FROM parts GROUP BY sha256 HAVING count(DISTINCT split) > 1)",
    "q12_issue_log": f"""WITH {_FILES}, {_SPREAD},
      conflicts AS (SELECT sha256 FROM files WHERE label IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT label) > 1),
      found AS (
        SELECT 'DQ-01' AS issue_id, coalesce(sum(n_files), 0)::BIGINT || ' files share their content with another split' AS finding, coalesce(sum(n_files), 0)::BIGINT AS n, 'Exclude the supplied splits' AS decision FROM spread
        UNION ALL SELECT 'DQ-02', count(*) || ' exact duplicate groups cross splits', count(*), 'Keep each digest in one derived split' FROM spread
        UNION ALL SELECT 'DQ-03', count(*) FILTER (label = 'Normal') || ' Normal against ' || count(*) FILTER (label = 'Pothole') || ' Pothole files',
          greatest(count(*) FILTER (label = 'Pothole') - count(*) FILTER (label = 'Normal'), 0), 'Keep class ratios and weigh classes' FROM files
        UNION ALL SELECT 'DQ-04', count(*) || ' digests carry more than one label', count(*), 'Review by hand' FROM conflicts),
      notes(issue_id, evidence_path, risk, action_or_limitation) AS (VALUES {_NOTES})
      SELECT found.*, evidence_path, risk, action_or_limitation, CASE WHEN n > 0 THEN 'Open' ELSE 'None found' END AS status, 'unassigned' AS owner FROM found JOIN notes USING (issue_id)""",
    "q13_class_weights": """SELECT quality, n, round_even((sum(n) OVER ())::DOUBLE / (count(*) OVER () * n)::DOUBLE, 6) AS weight
      FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)""",
    "q14_selection_rows": f"WITH {_PARTS} SELECT doc_id, label, split FROM parts WHERE split IN ('train', 'validation')",
    "q15_predictions": f"""WITH {_SCORES} SELECT l_orderkey, l_linenumber, CASE y WHEN 1 THEN 'Pothole' ELSE 'Normal' END AS actual, CASE WHEN p >= 0.5 THEN 'Pothole' ELSE 'Normal' END AS predicted,
      round_even(p, 6) AS pothole_probability, (y = 1) <> (p >= 0.5) AS is_error FROM scores""",
    "q16_confusion_matrix": f"WITH {_SCORES}, {_CONFUSION} SELECT 'Normal' AS actual, tn AS predicted_normal, fp AS predicted_pothole FROM counts UNION ALL SELECT 'Pothole', fn, tp FROM counts",
    "q17_metrics": _figures(_CONFUSION, "p"),
    "q17b_naive_baseline": _figures(_NAIVE, "1.0"),
    "q18_registry": f"""WITH runs(run_name, valid_for_selection, macro_f1, training_seconds) AS (VALUES {_RUN_ROWS})
      SELECT *, run_name = (SELECT run_name FROM runs WHERE valid_for_selection = 'yes' ORDER BY macro_f1 DESC, run_name LIMIT 1) AS best FROM runs""",
    "q19_triage": """SELECT event_id, round_even(p, 6) AS pothole_probability, valid, label,
        round_even(CASE label WHEN 'Pothole' THEN p WHEN 'Normal' THEN 1 - p END, 6) AS confidence,
        CASE label WHEN 'Pothole' THEN 'priority human review required' WHEN 'Normal' THEN 'routine human review required' ELSE 'rejected score: human review required' END AS review_action
      FROM (SELECT *, CASE WHEN NOT valid THEN 'Invalid' WHEN p >= 0.5 THEN 'Pothole' ELSE 'Normal' END AS label
        FROM (SELECT event_id, value / 100.0 AS p, coalesce(value / 100.0 BETWEEN 0 AND 1 AND NOT isnan(value), false) AS valid FROM events))""",
    "q20_config_keys": """SELECT event_id, json_valid(props) AS is_object, array_to_string(list_sort(list_filter(['k', 'threshold'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing FROM events""",
    "q22_majority_class": """SELECT quality AS majority_class, n, round_even(n::DOUBLE / total::DOUBLE, 6) AS share
      FROM (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total FROM labels WHERE quality IS NOT NULL GROUP BY quality) ORDER BY n DESC, quality LIMIT 1""",
}
