"""Secrets in texts, found through an incremental ledger of blobs.

Every text is addressed by its SHA-256. The ledger, a Parquet table, has one row for each blob and
rule version that was ever scanned, with the findings. A run scans only pairs of blob and rule version
that the ledger lacks, appends them, and joins findings back to all rows that hold the blob: copies,
old versions and other paths cost nothing, and a new rule version scans everything once.

Defined cases: a null text is empty; an empty text has no spans; repeated rows each get a row; an
empty table gives an empty result and leaves the ledger as it is; offsets are code points, the end
exclusive. Only the text column is read by the scan; all columns of the input come back, and a
column named ``blob`` or ``spans`` there gives way to the result's.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traffic_risk.functions.skew import attach
from traffic_risk.llm.common import fresh, map_texts
from traffic_risk.llm.spans import SPAN, ordered

# Kinds, patterns and least lengths of the base rules; then rules added to them.
KINDS = ("assign", "access", "hex", "pem", "token", "signed")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PEM_PART = re.compile(
    r"""(?:\\[nrt]|[\s"',;>|#*\\])*+(?:(?P<end>-----END (?:[A-Z]+ )*PRIVATE KEY-----)"""
    r"""|(?P<attribute>[A-Za-z][A-Za-z0-9-]*+:[\x20\t][^\r\n\\]*+)|(?P<body>[A-Za-z0-9+/]++={0,2}))"""
)
"""What may follow the header, with the separators before it: line ends, also written as escapes, quotes, marks of quoted lines."""
PEM_LEAST = 16
"""Without an END line, shorter runs are words, unless such a run is a line right below a longer one."""
TOKEN_HINTS = ("gh", "github_pat_", "glpat-", "xox", "AIza", "sk_live_", "rk_live_", "npm_", "SG.")
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[opsur]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,64}|xox[abeoprs]-[A-Za-z0-9-]{10,255}"
    r"|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,247}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64})(?![A-Za-z0-9_-])"
)
"""Tokens that platforms mark by a prefix."""
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}")
"""Signed web tokens: header, claims and signature, the first two JSON objects in base64."""
VERSION = "1.2"


def _pem_stop(text: str, at: int) -> int:
    """Where the private key ends whose header ends at ``at``. The walk stops before any other header."""
    stop, part = at, PEM_PART.match(text, at)
    while part:
        if part["end"]:
            return part.end()
        if part["body"]:
            first, last = part.span("body")
            line = text[last : last + 2] in ("", "\\n", "\\r") or text[last] in "\r\n"
            under = part.start() == stop > at and not text[stop:first].strip(" \t\r\nn\\") and re.search(r"[\r\n]|\\[nr]", text[stop:first])
            if last - first >= PEM_LEAST or under and line:
                stop = last
        elif stop > at:
            break
        part = PEM_PART.match(text, part.end())
    return stop


def scan(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans of one text. A run of characters that is too short has no longer part, so the least lengths can stand in the patterns."""
    spans = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        spans += [("assign", *m.span(), True) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span(), True) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span(), True) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        spans += [("pem", m.start(), _pem_stop(text, m.end()), False) for m in PEM.finditer(text)]
    if any(hint in text for hint in TOKEN_HINTS):
        spans += [("token", *m.span(), False) for m in TOKEN.finditer(text)]
    if "eyJ" in text:
        spans += [("signed", *m.span(), False) for m in SIGNED.finditer(text)]
    return spans


@dataclass(frozen=True)
class BlobLedger:
    """Findings by blob and rule version, below ``path`` in a folder that all executors share."""

    spark: SparkSession
    path: str
    schema: str = field(default=f"blob string, spans array<{SPAN}>", init=False)

    def read(self, version: str) -> DataFrame:
        """One row per blob scanned under the version, also where a run was repeated."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(version))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self._folder(version))
        return found.dropDuplicates(["blob"])

    def append(self, findings: DataFrame, version: str) -> None:
        """Each run has its own folder: a lost run leaves no half-written one among the others."""
        findings.write.parquet(f"{self._folder(version)}/run={uuid.uuid4().hex}")

    def _folder(self, version: str) -> str:
        return f"{self.path.rstrip('/')}/rules={version}"


def unseen(docs: DataFrame, ledger: BlobLedger, text_col: str = "text", version: str = VERSION) -> DataFrame:
    """``blob``, ``content`` of every distinct text the ledger has not scanned under the version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.select(F.sha2(text, 256).alias("blob"), text.alias("content")).dropDuplicates(["blob"])
    return distinct.join(ledger.read(version).select("blob"), "blob", "left_anti")


def scan_blobs(blobs: DataFrame) -> DataFrame:
    def run(keys: pa.RecordBatch, texts: list) -> list:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
        )
        return [keys.column(0), pa.array([ordered(scan(t), KINDS) for t in texts], kind)]

    return map_texts(blobs, ["blob"], "content", run, f"blob string, spans array<{SPAN}>")


def find_secrets(
    docs: DataFrame, ledger: BlobLedger, text_col: str = "text", version: str = VERSION, blob_as: str = "blob", spans_as: str = "spans"
) -> DataFrame:
    """``docs`` with the blob's address and spans; blobs that are new to the ledger are scanned and recorded.

    Columns of ``docs`` that have these names give way to them.
    """
    ledger.append(scan_blobs(unseen(docs, ledger, text_col, version)), version)
    kept = [c for c in docs.columns if c.lower() not in (blob_as.lower(), spans_as.lower())]
    addressed = docs.select(*kept, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(blob_as))
    known = ledger.read(version).withColumnsRenamed({"blob": blob_as, "spans": spans_as})
    return attach(addressed, known, [blob_as], [blob_as], how="inner")


def mask_secrets(
    docs: DataFrame, ledger: BlobLedger, text_col: str = "text", mark: str = "<SECRET>"
) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; other texts and all other columns stay as they are.

    Overlapping spans become one mark. Nulls stay null.
    """
    blob, spans = fresh("blob", docs), fresh("spans", docs)
    found = find_secrets(docs, ledger, text_col, blob_as=blob, spans_as=spans)
    # walk the spans in order: (text so far, where the last span ended)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col(text_col)

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["start"] >= acc["at"]
        out = F.concat(acc["out"], gap, F.when(new, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(text.isNotNull() & (F.size(spans) > 0), masked).otherwise(text)
    return found.withColumn(text_col, clean).select(*docs.columns)
