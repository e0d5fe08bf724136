"""Secret scans over an incremental blob ledger.

Every version of a text is named by its content (SHA-256 of its UTF-8 bytes).  The
ledger holds the spans of each (blob, rule, rule version) scanned so far; a scan reads
only blobs with pairs that the ledger lacks, adds those, and joins findings back to
every path and version that holds the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm.common import new_folder, saved, small, table


class Rule(NamedTuple):
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    ignore_case: bool = False


# The base rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

_LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"
MARK = "[redacted]"


def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def find(rule: Rule, pattern: re.Pattern, text: str) -> list[dict]:
    """Spans of a rule in a text, in code points, end exclusive."""
    g = rule.group
    return [{"start": m.start(), "end": m.end()} for m in pattern.finditer(text) if m.end(g) - m.start(g) >= rule.least]


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def _runs(spark: SparkSession, ledger: str) -> list[str]:
    """Folders of the ledger's finished runs; a run that broke off has no _SUCCESS and is passed over."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(ledger)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    runs = [s.getPath() for s in fs.listStatus(root)]
    return sorted(str(p) for p in runs if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All pairs scanned so far: blob, kind, version, spans."""
    runs = _runs(spark, ledger)
    return spark.read.schema(_LEDGER).parquet(*runs) if runs else spark.createDataFrame([], _LEDGER)


def _scan(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [_compiled(r) for r in rules]
        spans_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            blobs, kinds, versions, spans = [], [], [], []
            for i in range(b.num_rows):
                text, todo = b.column(1)[i].as_py() or "", set(b.column(2)[i].as_py())
                for k, (r, p) in enumerate(zip(rules, patterns, strict=True)):
                    if k in todo:
                        blobs.append(i), kinds.append(r.kind), versions.append(r.version), spans.append(find(r, p, text))
            blob = b.column(0).take(pa.array(blobs, pa.int64()))
            yield pa.RecordBatch.from_arrays([blob, pa.array(kinds, pa.string()), pa.array(versions, pa.int32()), pa.array(spans, spans_t)], ["blob", "kind", "version", "spans"])

    return run


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Spans of every row of ``versions``: its ``keys``, blob, spans (array of kind, start, end).

    ``keys`` name a path and its version; each row of ``versions`` is one version of a
    path.  Rows with a null text hold the empty blob.  Repeated rows, rows with null
    keys and copies come back each for itself, but a blob is scanned once, and never
    again for a rule version that the folder ``ledger`` already holds.  Spans stand by
    start, then by the order of ``rules``.
    """
    spark = versions.sparkSession
    rows = versions.select(*keys, F.col(text).cast("string").alias("__text")).withColumn("blob", _blob(F.col("__text")))
    named = saved(rows.select(*keys, "blob"), "named")
    known = read_ledger(spark, ledger)
    # which rules each blob lacks, and one row that stands for the blob
    want = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("rule")) for i, r in enumerate(rules)])
    blobs = named.groupBy("blob").agg(F.min(F.struct(*keys)).alias("first"))
    pairs = blobs.select("blob", "first", F.explode(want).alias("w")).select("blob", "first", "w.*")
    unseen = pairs.join(known.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    todo = saved(unseen.groupBy("blob", "first").agg(F.collect_list("rule").alias("rules")).select("blob", F.col("first.*"), "rules"), "unseen")
    if todo.limit(1).count():
        t = todo.hint("shuffle_hash")
        cond = rows["blob"] == t["blob"]
        for k in keys:
            cond = cond & rows[k].eqNullSafe(t[k])
        texts = rows.join(t, cond).select(rows["blob"], F.col("__text"), t["rules"])
        found = texts.mapInArrow(_scan(rules), _LEDGER)
        found.write.parquet(f"{ledger.rstrip('/')}/run-{uuid.uuid4().hex}")
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = read_ledger(spark, ledger).where((F.size("spans") > 0) & (F.element_at(now, F.col("kind")) == F.col("version")))
    flat = hits.select("blob", F.explode("spans").alias("s"), rank[F.col("kind")].alias("r"), "kind").select("blob", F.struct(F.col("s.start").alias("start"), F.col("r"), F.col("kind"), F.col("s.end").alias("end")).alias("s"))
    found = saved(flat.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans")), "findings")
    out = named.join(found, "blob", "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,r:int,kind:string,end:bigint>>)")
    spans = F.transform(F.coalesce("spans", empty), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(*keys, "blob", spans.alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with each secret of ``text`` replaced by a mark (overlapping spans by one) and ``n_chars`` to match.

    Only rows with findings are rewritten; all rows and columns stay.
    """
    spark = docs.sparkSession
    found = scan(docs, ledger or new_folder(spark, "ledger"), rules, keys=("doc_id",))
    hit = saved(found.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), "secrets")
    keyed = docs.withColumn("__blob", _blob(F.col("text")))
    h = small(hit.select(F.col("blob").alias("__hit"), F.col("spans").alias("__spans")))
    joined = keyed.join(h, keyed["__blob"] == h["__hit"], "left").drop("__blob", "__hit")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[: len(names)])
            spans = b.column(len(names))
            rows = np.flatnonzero(np.asarray(spans.is_valid()))
            if len(rows):
                texts = cols[at].to_pylist()
                for i in rows.tolist():
                    texts[i] = masked(texts[i], [(s["start"], s["end"]) for s in spans[i].as_py()])
                cols[at] = pa.array(texts, cols[at].type)
                if "n_chars" in names:
                    n = cols[names.index("n_chars")].to_pylist()
                    for i in rows.tolist():
                        n[i] = len(texts[i])
                    cols[names.index("n_chars")] = pa.array(n, cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each union of overlapping spans replaced by a mark."""
    out, at, end = [], 0, -1
    for a, b in sorted(spans):
        if a >= end:
            out += [text[at:a], MARK]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned into a new ledger in the shared folder."""
    r = scan(table(spark, sf_dir, "documents"), new_folder(spark, "ledger"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, x.kind))).cast("long").alias(f"n_{x.kind}") for x in RULES]
    return r.select("doc_id", *count, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
