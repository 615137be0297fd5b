"""Secret scan over a ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger records which rules, by kind and
version, have read which blob, and what they found. A scan reads a blob only for the rules that it hasn't met in that
version, appends one row per blob read, and joins the findings back to every path and version that holds
the blob. Copies, unchanged files and old versions thus cost a hash; a changed rule reads all blobs again, alone.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracast.llm.joins import spread_join
from terracast.llm.storage import free_name, reliable_cut


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and without overlap, whose `group` has `least` characters or more.

    A text can only match if its lower-cased form holds one of `needs` (none: any text). Change `version` with the rest.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else re.ASCII)


# fixed values: the kinds of secrets and their forms
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, needs=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),
)
MORE = (
    Rule("private", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 1, needs=("private key-----",)),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", 40, needs=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, needs=("eyj",)),
)
RULES = BASE + MORE

_SPANS = "array<struct<kind string, version int, start bigint, end bigint>>"
_SCANS = f"blob binary, rules array<string>, spans {_SPANS}"


class Ledger:
    """The table of scans in a folder: one row per blob read, with the rules that read it and what they found."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/scans"
        spark.createDataFrame([], _SCANS).write.mode("ignore").parquet(self.path)

    def scans(self) -> DataFrame:
        return self.spark.read.schema(_SCANS).parquet(self.path)

    def pending(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """blob, rules (names) of the blobs that some rule hasn't read in its version."""
        known = self.scans().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        every = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
        open_ = F.when(F.col("known").isNull(), every).otherwise(F.array_except(every, "known"))
        return blobs.join(known, "blob", "left").select("blob", open_.alias("rules")).where(F.size("rules") > 0)

    def append(self, scans: DataFrame) -> None:
        """Pairs and findings become visible together, when the write is committed; a lost run leaves nothing."""
        scans.write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """blob, spans (kind, start, end) of the given rules by start, then in the order of the rules."""
        order = {r.name: i for i, r in enumerate(rules)}
        place = F.lit(None).cast("int")
        for name, i in order.items():
            place = F.when(F.concat_ws("@", "s.kind", "s.version") == name, i).otherwise(place)
        spans = self.scans().where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).select("blob", "s", place.alias("place")).where("place is not null")
        sorted_ = F.array_sort(F.collect_set(F.struct("s.start", "place", "s.end", "s.kind")))
        return spans.groupBy("blob").agg(sorted_.alias("found")).select("blob", F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def address(text: str | Column) -> Column:
    """Content address of a text; a null one is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"), 256))


def _read(rules: Sequence[Rule]):
    by_name = {r.name: (r, r.compiled()) for r in rules}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, names in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                low, own = text.lower(), []
                for rule, pattern in (by_name[n] for n in names):
                    if rule.needs and not any(x in low for x in rule.needs):
                        continue
                    for m in pattern.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            own.append({"kind": rule.kind, "version": rule.version, "start": m.start(), "end": m.end()})
                found.append(own)
            shape = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, shape)], names=["blob", "rules", "spans"])

    return read


def scan(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` (path, version), blob and spans (kind, start, end; code points, end exclusive) of every row.

    Blobs that the ledger doesn't know under some rule are read for that rule only and recorded. Null and empty
    texts are the empty blob; equal rows and copies share a blob, read once, and each gets its findings; a row
    without findings has an empty array. Texts are read whole. An empty table leaves the ledger as it is.
    """
    spark = versions.sparkSession
    row = free_name(versions, "row")
    paths = versions.select(*keep, address(text_col).alias("blob")).withColumn(row, F.monotonically_increasing_id())
    paths = reliable_cut(paths, "paths")
    pending = reliable_cut(ledger.pending(paths.select("blob").distinct(), rules), "pending")
    texts = versions.select(address(text_col).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    few = int(spark.conf.get("spark.terracast.broadcastRows", "100000"))
    if pending.count() <= few:  # their addresses are small: known texts aren't moved at all
        texts = texts.join(F.broadcast(pending.select("blob")), "blob", "left_semi")
    # copies are combined before the shuffle, so a blob with any number of them is one row a task
    once = texts.groupBy("blob").agg(F.first("text").alias("text"))
    unread = once.join(pending, "blob").select("blob", "text", "rules")
    ledger.append(unread.mapInArrow(_read(rules), _SCANS))
    found = spread_join(paths, ledger.findings(rules), ["blob"], spread=[row])
    none = F.array().cast("array<struct<kind string, start bigint, end bigint>>")
    return found.select(*keep, "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: str | Column) -> Column:
    """`kind:start:end` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(kinds: Sequence[str]) -> Column:
    """The spans of some kinds, in their order."""
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))
