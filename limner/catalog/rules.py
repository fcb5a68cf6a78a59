"""Queries over detections and the grading rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.catalog import bindings as B
from limner.catalog.registry import having, query
from limner.functions import text as T
from limner.operators import grading as G
from limner.operators import scoring as S

KEYS = ["user_id", "day"]
THRESHOLD = 0.2


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hash(purpose: str, span: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || '|' || day || '|42|{purpose}'), 1, 8)) AS BIGINT) % {span}"


SIGNALS = """signals AS (SELECT user_id, day, CAST(count(label) AS INTEGER) AS n_labels, CAST(count(*) FILTER (label = 'cat') AS INTEGER) AS n_cat,
  bool_or(label IN ('cash', 'dollar bill')) AS has_cash, bool_or(label = 'geometric shapes') AS has_geometric,
  bool_or(label = 'abstract art') AS has_abstract FROM {source} GROUP BY 1, 2)"""

GRADED = f"""drawn AS (SELECT *, CAST(90 + {_hash('bribe', 11)} AS INTEGER) AS bribe, CAST({_hash('abstract', 31)} - 15 AS INTEGER) AS shift,
  CASE WHEN has_geometric THEN greatest(least(n_cat * 20, 60) - 15, 0) ELSE least(n_cat * 20, 60) END AS shaped FROM signals),
plain AS (SELECT *, CASE WHEN has_abstract THEN least(greatest(shaped + shift, 0), 100) ELSE shaped END AS points FROM drawn),
graded AS (SELECT user_id, day, CAST(CASE WHEN n_cat = 0 THEN 0 WHEN has_cash THEN bribe ELSE points END AS INTEGER) AS grade,
  CASE WHEN n_cat = 0 THEN {_sql_text(G.NO_CAT_NOTE)} ELSE
    'I detect ' || n_cat || ' cat(s). ' || CASE WHEN n_cat >= 3 THEN {_sql_text(G.MANY_CATS_NOTE)} ELSE {_sql_text(G.FEW_CATS_NOTE)} END ||
    CASE WHEN has_cash THEN ' ' || replace({_sql_text(G.BRIBE_NOTE)}, '{{grade}}', CAST(bribe AS VARCHAR)) ELSE
      CASE WHEN has_geometric THEN ' ' || {_sql_text(G.GEOMETRIC_NOTE)} ELSE '' END ||
      CASE WHEN has_abstract THEN ' Abstract expressionism… I feel ' || CASE WHEN shift > 0 THEN 'inspired' ELSE 'confused' END || ' by this. ' ||
        CASE WHEN shift >= 0 THEN 'Bonus' ELSE 'Penalty' END || ': ' || abs(shift) || ' points.' ELSE '' END ||
      ' Final grade: ' || points || '/100.' END END AS explanation,
  NOT (n_cat > 0 OR has_cash OR has_geometric OR has_abstract) AS needs_fallback FROM plain)"""

ORDERED = """kept AS (SELECT user_id, day, label, CAST(printf('%.4f', score) AS DOUBLE) AS score,
  list_position(['cat', 'cash', 'geometric shapes', 'abstract art', 'painting'], label) AS pos FROM best WHERE score >= 0.2)"""


@query(
    having(
        B.DETECTIONS, ORDERED, "keyed AS (SELECT DISTINCT user_id, day FROM hits)",
        then="SELECT k.user_id, k.day, coalesce(string_agg(label || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY score DESC, pos), '') AS summary "
        "FROM keyed k LEFT JOIN kept USING (user_id, day) GROUP BY 1, 2",
    )
)
def detected_label_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = S.detect_rows(B.best_hits(spark, sf), KEYS, B.LABELS, THRESHOLD)
    return found.select(*KEYS, T.label_summary(F.col("detections")).alias("summary"))


@query(
    having(
        B.DETECTIONS, ORDERED,
        then="SELECT user_id, day, label, score, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY score DESC, pos) - 1 AS INTEGER) AS place FROM kept",
    )
)
def detected_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = S.detect_rows(B.best_hits(spark, sf), KEYS, B.LABELS, THRESHOLD)
    return found.select(*KEYS, F.posexplode("detections").alias("place", "d")).select(*KEYS, "d.label", "d.score", "place")


@query(having(B.DETECTIONS, SIGNALS.format(source="hits"), then="SELECT * FROM signals"))
def rule_signals(spark: SparkSession, sf: str) -> DataFrame:
    return G.signals_from_rows(B.hits(spark, sf), KEYS)


@query(having(B.DETECTIONS, SIGNALS.format(source="hits"), GRADED, then="SELECT * FROM graded"))
def graded_items(spark: SparkSession, sf: str) -> DataFrame:
    out = G.grade_signals(G.signals_from_rows(B.hits(spark, sf), KEYS), KEYS)
    return out.select(*KEYS, "grade", "explanation", "needs_fallback")


ALL_KEYS = """padded AS (SELECT k.user_id, k.day, b.label FROM (SELECT DISTINCT user_id, day FROM hits) k
  LEFT JOIN (SELECT * FROM best WHERE score >= 0.2) b USING (user_id, day))"""
NULL_SAFE = SIGNALS.format(source="padded").replace("bool_or(label", "bool_or(label IS NOT NULL AND label")


@query(having(B.DETECTIONS, ALL_KEYS, NULL_SAFE, GRADED, then="SELECT user_id, day, grade, explanation, needs_fallback FROM graded"))
def graded_detection_arrays(spark: SparkSession, sf: str) -> DataFrame:
    found = S.detect_rows(B.best_hits(spark, sf), KEYS, B.LABELS, THRESHOLD)
    return G.grade_items(found, KEYS).select(*KEYS, "grade", "explanation", "needs_fallback")


def _score_column(label: str) -> str:
    return f"coalesce(max(score) FILTER (label = '{label}'), 0)"


@query(
    having(
        B.DETECTIONS, ORDERED, ALL_KEYS, NULL_SAFE, GRADED,
        then="SELECT g.user_id, g.day, coalesce((SELECT string_agg(label, ',' ORDER BY score DESC, pos) FROM kept k WHERE k.user_id = g.user_id AND k.day = g.day), '') AS detected_labels, "
        "grade, explanation FROM graded g",
    )
)
def detect_and_grade(spark: SparkSession, sf: str) -> DataFrame:
    cells = [F.coalesce(F.max(F.when(F.col("label") == x, F.col("score"))), F.lit(0.0)) for x in B.LABELS]
    scores = B.hits(spark, sf).groupBy(*KEYS).agg(F.array(*cells).alias("class_scores"))
    out = G.detect_and_grade(scores, KEYS, B.LABELS, THRESHOLD)
    return out.withColumn("detected_labels", F.array_join("detected_labels", ","))


@query(
    having(
        B.DETECTIONS, SIGNALS.format(source="hits"),
        f"off AS (SELECT user_id, day, CAST(least(greatest(n_labels * 10 + {_hash('offline', 11)} - 5, 0), 100) AS INTEGER) AS grade FROM signals)",
        then=f"SELECT user_id, day, grade, replace({_sql_text(G.OFFLINE_NOTE)}, '{{grade}}', CAST(grade AS VARCHAR)) AS explanation FROM off",
    )
)
def offline_grades(spark: SparkSession, sf: str) -> DataFrame:
    signals = G.signals_from_rows(B.hits(spark, sf), KEYS)
    return G.offline_grade(signals, KEYS, F.col("n_labels")).select(*KEYS, "grade", "explanation")


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 100 AS INTEGER) ELSE 50 END AS grade, "
    "CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'The teacher is confused. Raw: ' || CASE WHEN event_id % 3 = 1 THEN trim(props) ELSE 'no json ' || event_type END END AS explanation FROM events"
)
def parsed_grade_replies(spark: SparkSession, sf: str) -> DataFrame:
    good = F.to_json(F.struct((F.col("user_id") % 100).alias("grade"), F.col("event_type").alias("explanation")))
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, good).when(kind == 1, F.col("props")).otherwise(F.concat(F.lit("no json "), "event_type"))
    replies = B.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return G.parse_grade_reply(replies, "raw").drop("raw")


@query(
    having(
        B.DETECTIONS,
        "c AS (SELECT user_id, label, count(*) AS n FROM hits GROUP BY 1, 2)",
        then="SELECT user_id, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM c GROUP BY 1",
    )
)
def label_count_maps(spark: SparkSession, sf: str) -> DataFrame:
    counted = B.hits(spark, sf).groupBy("user_id", "label").agg(F.count("*").alias("n"))
    maps = counted.groupBy("user_id").agg(T.count_map(F.col("label"), F.col("n")).alias("m"))
    pair = lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("m"), pair), ",").alias("counts"))
