"""Column roles and the role views over the driver tables.

A ``Roles`` object names the meta, label and feature columns of a trial table
(the reference hard-codes them; here they are arguments).  The ``*_view``
functions derive the standard role views used by the registered queries; the
``*_SQL`` strings are the same views as DuckDB CTE bodies for the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


@dataclass
class Roles:
    meta: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    entity: str | None = None
    condition: str | None = None

    def features(self, df: DataFrame, selected: list[str] | None = None) -> list[str]:
        """Selected features, or every column that is neither meta nor label."""
        if selected is not None:
            return list(selected)
        skip = set(self.meta) | set(self.labels)
        return [c for c in df.columns if c not in skip]

    def project_features(self, df: DataFrame, selected: list[str] | None = None) -> DataFrame:
        return df.select(*self.features(df, selected))

    def project_label(self, df: DataFrame, label: str | None = None) -> DataFrame:
        return df.select(label or self.labels[0])

    def drop_meta(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.meta if c in df.columns])


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """Numeric (and boolean, as pandas counts it) columns, schema walk only."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in exclude
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ role views

def trials_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a trial table: one row per trial of an entity under a condition."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("entity"),
        F.col("event_type").alias("condition"),
        F.col("value").alias("label"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("ts"),
    )


TRIALS_SQL = """SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS entity, event_type AS condition,
       value AS label, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts
FROM events"""


def trials_null_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trials with derived missing values (the driver tables have none)."""
    t = trials_view(spark, sf_dir)
    return t.select(
        "row_id", "entity", "condition",
        F.when(F.col("row_id") % 10 == 0, F.lit(None)).otherwise(F.col("label")).alias("label"),
        F.when(F.col("row_id") % 7 == 0, F.lit(None)).otherwise(F.col("k")).alias("k"),
        "ts",
    )


TRIALS_NULL_SQL = """SELECT row_id, entity, condition,
       CASE WHEN row_id % 10 = 0 THEN NULL ELSE label END AS label,
       CASE WHEN row_id % 7 = 0 THEN NULL ELSE k END AS k, ts
FROM trials"""


def ofeat_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level feature table: lineitem aggregated per order joined to orders."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    agg = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg.join(o, agg.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("row_id"), "qty", "price", "disc", "tax", "n",
        "o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderdate",
    )


OFEAT_SQL = """SELECT o.o_orderkey AS row_id, l.qty, l.price, l.disc, l.tax, l.n,
       o.o_totalprice, o.o_orderpriority, o.o_orderstatus, o.o_custkey, o.o_orderdate
FROM (SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price,
             avg(l_discount) AS disc, avg(l_tax) AS tax, count(*) AS n
      FROM lineitem GROUP BY l_orderkey) l
JOIN orders o ON o.o_orderkey = l.l_orderkey"""


def signals_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as signal windows: 64 samples each, treated as fs = 64."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("window_id"),
        F.col("label").alias("condition"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


SIGNALS_SQL = """SELECT vec_id AS window_id, label AS condition, CAST(embedding AS DOUBLE[]) AS v
FROM embeddings"""


def signals_long_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long layout of signals: one row per (window, sample)."""
    s = signals_view(spark, sf_dir)
    return s.select("window_id", "condition", F.posexplode("v").alias("i", "x"))


SIGNALS_LONG_SQL = """SELECT window_id, condition, CAST(u.i - 1 AS INTEGER) AS i, u.x
FROM signals, LATERAL (SELECT unnest(generate_series(1, len(v))) AS i, unnest(v) AS x) u"""


def series_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trials ordered by time within entity, sample index i from 0."""
    from vitalis.operators.ordering import rank_in_group

    t = trials_view(spark, sf_dir)
    return rank_in_group(t, ["entity"], [F.col("ts").asc(), F.col("row_id").asc()], "i")


SERIES_SQL = """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, row_id) - 1 AS i FROM trials"""


def preds_reg_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ofeat_view(spark, sf_dir)
    return o.select(
        "row_id", F.col("price").alias("y_true"), (F.lit(1500.0) * F.col("qty")).alias("y_pred"),
        F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("entity"),
    )


PREDS_REG_SQL = """SELECT row_id, price AS y_true, 1500.0 * qty AS y_pred, o_orderpriority AS grp,
       o_orderstatus AS status, o_custkey AS entity
FROM ofeat"""


def preds_bin_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(doc, "doc_id")
    score = F.least(F.lit(1.0), F.col("n_chars") / F.lit(2000.0))
    return j.select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("y_true"),
        score.alias("score"), (score >= 0.5).cast("int").alias("y_pred"), F.col("lang").alias("grp"),
    )


PREDS_BIN_SQL = """SELECT l.doc_id AS row_id, l.quality AS y_true, least(1.0, d.n_chars / 2000.0) AS score,
       CAST(least(1.0, d.n_chars / 2000.0) >= 0.5 AS INTEGER) AS y_pred, d.lang AS grp
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def preds_multi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 10-class predictions: softmax of the first ten values."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    ex = F.transform(logits, lambda x: F.exp(x))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    scores = F.transform(ex, lambda x: x / total)
    return (
        e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y_true"), scores.alias("scores"))
        .withColumn("y_pred", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    )


PREDS_MULTI_SQL = """SELECT row_id, y_true, scores,
       CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS y_pred
FROM (SELECT vec_id AS row_id, label AS y_true,
             list_transform(ex, lambda x: x / list_sum(ex)) AS scores
      FROM (SELECT vec_id, label,
                   list_transform(CAST(embedding AS DOUBLE[])[1:10], lambda x: exp(x)) AS ex
            FROM embeddings) q) r"""


def with_ctes(body: str, *views: str) -> str:
    """Prefix an oracle query with the named role-view CTEs (dependencies first)."""
    defs = {
        "trials": TRIALS_SQL,
        "trials_null": TRIALS_NULL_SQL,
        "ofeat": OFEAT_SQL,
        "signals": SIGNALS_SQL,
        "signals_long": SIGNALS_LONG_SQL,
        "series": SERIES_SQL,
        "preds_reg": PREDS_REG_SQL,
        "preds_bin": PREDS_BIN_SQL,
        "preds_multi": PREDS_MULTI_SQL,
    }
    deps = {
        "trials_null": ["trials"],
        "series": ["trials"],
        "preds_reg": ["ofeat"],
        "signals_long": ["signals"],
    }
    order: list[str] = []

    def visit(v: str) -> None:
        for d in deps.get(v, []):
            visit(d)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    ctes = [f"{v} AS (\n{defs[v]}\n)" for v in order]
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        # RECURSIVE applies to the whole WITH list
        ctes.append(stripped[15:])
        return "WITH RECURSIVE " + ",\n".join(ctes)
    if stripped[:5].upper() == "WITH ":
        # the body brings its own CTEs: append them after the role views
        ctes.append(stripped[5:])
        return "WITH " + ",\n".join(ctes)
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
