"""Classifier scores over the vector labels; boards are vector ids mod 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.operators import classify
from framemetry.plans.bindings import PREDICTIONS_SQL, big, predictions, r6, rounded, table
from framemetry.plans.registry import query


def counts_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys}, class)" if keys else "USING (class)"
    return f"""{PREDICTIONS_SQL},
t AS (SELECT {k}"true" AS class, count(*) AS support, count(*) FILTER ("true" = pred) AS tp
      FROM predictions GROUP BY ALL),
p AS (SELECT {k}pred AS class, count(*) AS predicted FROM predictions GROUP BY ALL),
counts AS (SELECT {k}class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
                  coalesce(predicted, 0) AS predicted FROM t FULL JOIN p {using}),
scores AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
                  CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall,
                  2.0::DOUBLE * tp / (predicted + support) AS f1 FROM counts)"""


@query("class_weights", """WITH c AS (
  SELECT quality, count(*) AS n, 1.0::DOUBLE / count(*) AS weight FROM labels GROUP BY quality)
SELECT doc_id, quality, n::BIGINT AS n, round(weight, 9) AS weight FROM labels JOIN c USING (quality)""")
def _class_weights(spark, sf):
    out = classify.class_weights(table(spark, sf, "labels").select("doc_id", "quality"), "quality")
    return out.select("doc_id", "quality", big("n"), F.round("weight", 9).alias("weight"))


@query("confusion_counts", f"""WITH {counts_sql('arm')}
SELECT arm, class, tp::BIGINT AS tp, support::BIGINT AS support, predicted::BIGINT AS predicted FROM counts""")
def _confusion_counts(spark, sf):
    out = classify.confusion_counts(predictions(spark, sf), ["arm"])
    return rounded(out, [], ["tp", "support", "predicted"], ["arm", "class"])


@query("per_class_scores", f"""WITH {counts_sql('arm')}
SELECT arm, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM scores""")
def _per_class_scores(spark, sf):
    out = classify.per_class_scores(classify.confusion_counts(predictions(spark, sf), ["arm"]))
    return rounded(out, ["precision", "recall", "f1"], keep=["arm", "class"])


REPORT = """round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy,
  round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, sum(support)::BIGINT AS n"""
DOUBLES = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]


@query("classification_report", f"WITH {counts_sql('arm')} SELECT arm, {REPORT} FROM scores GROUP BY arm")
def _classification_report(spark, sf):
    out = classify.classification_report(predictions(spark, sf), ["arm"])
    return rounded(out, DOUBLES, ["n"], ["arm"])


@query("classification_report_labels", """WITH t AS (
  SELECT quality AS class, count(*) AS support, count(*) FILTER (quality = 1 - toxic) AS tp
  FROM labels GROUP BY 1),
p AS (SELECT 1 - toxic AS class, count(*) AS predicted FROM labels GROUP BY 1),
s AS (SELECT coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
        coalesce(2.0::DOUBLE * coalesce(tp, 0) / (coalesce(predicted, 0) + coalesce(support, 0)), 0) AS f1
      FROM t FULL JOIN p USING (class))
SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM s""")
def _classification_report_labels(spark, sf):
    rows = table(spark, sf, "labels").select(
        F.col("quality").alias("true"), (1 - F.col("toxic")).alias("pred")
    )
    return classify.classification_report(rows).select(r6("accuracy"), r6("macro_f1"))


@query("group_classification",
       f"WITH {counts_sql('board, arm')} SELECT board, arm, {REPORT} FROM scores GROUP BY board, arm")
def _group_classification(spark, sf):
    out = classify.group_classification(predictions(spark, sf), "board", "arm")
    return rounded(out, DOUBLES, ["n"], ["board", "arm"])


@query("balanced_class_f1", f"""WITH {counts_sql('board, arm')}
SELECT arm, class, round(avg(f1), 6) AS balanced_f1, count(*)::BIGINT AS boards
FROM scores GROUP BY arm, class""")
def _balanced_class_f1(spark, sf):
    out = classify.balanced_class_f1(predictions(spark, sf), "board", "arm")
    return rounded(out, ["balanced_f1"], ["boards"], ["arm", "class"])
