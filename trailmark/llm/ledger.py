"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger holds what each
(blob, rule version) gave, blobs without findings too; a scan reads each blob once and only where that pair
isn't in the ledger yet. Findings are then joined back to every path (here: doc_id) that has the blob.

Base kinds are assign, access and hex; RULES names the kinds of each rule version, which adds pem and jwt to the base from version 1 on. Spans are
kind:start:end in code points, end exclusive, in order of start and then of kind as listed.

Defined cases: null texts count as empty and have no finding; equal texts share a blob, thousands of copies are
scanned once; a null or repeated path keeps each of its rows; other columns are ignored. A ledger that has grown by
several commits gives what one scan of everything gives.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, save, work_dir

KINDS = ("assign", "access", "hex", "pem", "jwt")
#: Kinds by rule version. A version never changes: a new rule is a new version, for which every blob counts as unseen.
RULES = {0: KINDS[:3], 1: KINDS}
RULES_VERSION = 1
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINT = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def find_spans(text: str, rules: int = RULES_VERSION) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order, by the rules of that version."""
    found, kinds = [], RULES[rules]
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "pem" in kinds and "-----BEGIN" in text:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    if "jwt" in kinds and "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in _JWT.finditer(text)]
    return sorted(found)


def _scan(rules: int):
    def scan(batches):
        for b in batches:
            spans = [find_spans(t or "", rules) for t in b.column(1).to_pylist()]
            kinds = pa.array([[KINDS[k] for _, k, _ in x] for x in spans], pa.list_(pa.string()))
            starts = pa.array([[s for s, _, _ in x] for x in spans], pa.list_(pa.int64()))
            ends = pa.array([[e for _, _, e in x] for x in spans], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), kinds, starts, ends], names=["blob", "kinds", "starts", "ends"])

    return scan


_LEDGER = "blob string, rules int, kinds array<string>, starts array<bigint>, ends array<bigint>"


class BlobLedger:
    """Findings by (blob, rule version), in Parquet below a folder that driver and executors share; one part for each commit.

    The folder itself says which commits there are, so a ledger can be opened again, by another job too.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commits(self) -> list[str]:
        """Folders of the commits so far."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []
        return [f"{self.folder}/{n}" for n in sorted(names) if n.startswith("commit=")]

    def entries(self) -> DataFrame:
        parts = self.commits()
        return self.spark.read.schema(_LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], _LEDGER)

    def commit(self, versions: DataFrame, rules: int = RULES_VERSION) -> DataFrame:
        """Scan what is new in versions (path, text) to these rules; returns (path, blob).

        One text of each blob is picked before the shuffle, so copies don't travel; blobs with this rule version in the
        ledger are left out before it as well where the ledger's part is small, else by a join.
        """
        named = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        known = self.entries().where(F.col("rules") == rules).select("blob") if self.commits() else None
        fresh = (named.join(known, "blob", "left_anti") if known is not None else named).groupBy("blob").agg(F.first("text").alias("text"))
        scanned = fresh.select("blob", "text").mapInArrow(_scan(rules), "blob string, kinds array<string>, starts array<bigint>, ends array<bigint>")
        save(scanned.select("blob", F.lit(rules).alias("rules"), "kinds", "starts", "ends"), f"{self.folder}/commit={uuid.uuid4().hex}")
        return named.select("path", "blob")

    def findings(self, paths: DataFrame, rules: int = RULES_VERSION) -> DataFrame:
        """paths with kinds, starts and ends of their blobs; nulls where nothing was found.

        Few blobs have findings, so the join is on those alone; a blob with many paths is a skewed key of a
        plain sort-merge join, which adaptive execution splits. Two jobs that commit at the same time may both
        have scanned a blob; one of their equal entries counts.
        """
        hits = self.entries().where((F.col("rules") == rules) & (F.size("kinds") > 0)).select("blob", "kinds", "starts", "ends").dropDuplicates(["blob"])
        return paths.join(hits, "blob", "left")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from path, kinds, starts and ends."""
    zipped = F.when(F.col("kinds").isNull(), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).otherwise(
        F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["kinds"].alias("kind"), x["starts"].alias("start"), x["ends"].alias("end")))
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("z", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("z", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.withColumn("z", zipped).select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("z")).alias("spans")
    )


def op9_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two commits, as versions do: the second one, by a ledger opened anew, scans what the first hasn't seen."""
    folder = work_dir(spark, "ledger")
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    late = F.xxhash64("path") % 2 == 0
    first = BlobLedger(spark, folder).commit(versions.where(~late))
    ledger = BlobLedger(spark, folder)
    return digest(ledger.findings(first.union(ledger.commit(versions.where(late)))))
