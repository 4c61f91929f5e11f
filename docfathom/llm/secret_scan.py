"""Secret scans with a ledger of what has been scanned by which rule.

Every version of every file is addressed by its content (SHA-256 of its UTF-8
bytes). The ledger has a row for each blob and rule version scanned so far, with
what was found there. A scan looks only at pairs that the ledger lacks: a new blob
by all rules, an old blob by new rules or new versions of rules. Findings belong to
blobs; the join with paths brings them to every path and version that has the blob.

Null text is the empty text. Rows with equal content share one scan and its
findings, whatever their paths; repeated rows and null paths get findings like
others. An empty table yields an empty ledger and no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docfathom.llm.text import texts
from docfathom.operators.spread import sent_if_small
from docfathom.session import materialize

#: One row per blob and rule version; ``found`` has the spans as code points.
LEDGER_SCHEMA = "blob string, rule string, version int, found array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``measured`` has ``least`` characters."""

    name: str
    version: int
    pattern: str
    measured: int = 0
    least: int = 0
    ignore_case: bool = False

    def spans(self, text: str) -> list[dict]:
        # ASCII: else i would also match a dotless i, and k the Kelvin sign.
        flags = re.ASCII | (re.IGNORECASE if self.ignore_case else 0)
        return [
            {"start": m.start(), "end": m.end()}
            for m in re.compile(self.pattern, flags).finditer(text)
            if len(m[self.measured]) >= self.least
        ]


BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", 1, r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_new(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "path"
) -> DataFrame:
    """Rows to add to the ledger: each blob and rule version that it lacks.

    One path is chosen to read each unseen blob from, so a blob with many copies is
    read and scanned once, and its copies do not meet anywhere.
    """
    wanted = {(r.name, r.version): i for i, r in enumerate(rules)}
    rows = versions.select(F.col(f"`{path}`").alias("path"), blob_of(F.col("text")).alias("blob"), "text")
    blobs = rows.groupBy("blob").agg(F.min("path").alias("from_path"))
    every = F.sequence(F.lit(0), F.lit(len(rules) - 1)) if rules else F.array().cast("array<int>")
    if ledger is None:
        unseen = blobs.withColumn("todo", every)
    else:
        index = F.coalesce(
            *[F.when((F.col("rule") == n) & (F.col("version") == v), F.lit(i)) for (n, v), i in wanted.items()],
            F.lit(-1),
        )
        seen = ledger.groupBy("blob").agg(F.collect_set(index).alias("seen"))
        unseen = blobs.join(seen, "blob", "left").select(
            "blob", "from_path", F.array_except(every, F.coalesce("seen", F.array().cast("array<int>"))).alias("todo")
        )
        unseen = unseen.filter(F.size("todo") > 0)
    unseen = sent_if_small(unseen.withColumnRenamed("blob", "unseen"), F.lit(64 + 4 * len(rules)))
    # Copies under one path would be read twice; nothing but a scan is lost by it.
    todo = rows.join(unseen, (F.col("blob") == F.col("unseen")) & F.col("path").eqNullSafe(F.col("from_path")))

    def run(batches):
        for batch in batches:
            out = {"blob": [], "rule": [], "version": [], "found": []}
            for blob, text, which in zip(batch.column("blob").to_pylist(), texts(batch), batch.column("todo").to_pylist()):
                for i in which:
                    out["blob"].append(blob)
                    out["rule"].append(rules[i].name)
                    out["version"].append(rules[i].version)
                    out["found"].append(rules[i].spans(text))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    found = todo.select("blob", "text", "todo").mapInArrow(run, LEDGER_SCHEMA)
    return found.dropDuplicates(["blob", "rule", "version"])


def extend_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "path") -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it there, and return the ledger."""
    spark = versions.sparkSession
    empty = spark.createDataFrame([], LEDGER_SCHEMA)
    empty.write.mode("append").parquet(folder)  # so that the first scan has something to read
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(folder)
    new = materialize(scan_new(versions, ledger, rules, path))
    new.write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the findings of the given rule versions, by start, then rule order.

    Blobs without findings are left out.
    """
    order = {(r.name, r.version): i for i, r in enumerate(rules)}
    place = F.coalesce(
        *[F.when((F.col("rule") == n) & (F.col("version") == v), F.lit(i)) for (n, v), i in order.items()], F.lit(-1)
    )
    found = ledger.withColumn("place", place).filter((F.col("place") >= 0) & (F.size("found") > 0))
    each = F.transform(
        "found",
        lambda x: F.struct(x["start"].alias("start"), F.col("place").alias("place"), x["end"].alias("end"), F.col("rule").alias("kind")),
    )
    return found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("spans"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path") -> DataFrame:
    """(path, blob, spans) of every row of ``versions``; ``spans`` is null without any.

    AQE splits the rows of a blob that very many paths have.
    """
    rows = versions.select(F.col(f"`{path}`").alias("path"), blob_of(F.col("text")).alias("blob"))
    return rows.join(blob_findings(ledger, rules), "blob", "left").select("path", "blob", "spans")
