"""Secret scans (operator 1), native: an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger holds (blob, rule, version) triples
already scanned and their findings. A run scans only the pairs the ledger lacks, each blob once however many paths hold
it, and joins findings back to all paths. A rule whose version changes is scanned anew; the others are not. ``Ledger`` keeps
the triples and findings as tables in a folder: findings are appended first, so a run that is lost scans again and loses none.

Defined results: a null text is the empty blob, without findings; rows repeat as often as in the input; an empty table
gives no rows; extra columns are ignored. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, shared_dir, text_of


@dataclass(frozen=True)
class Rule:
    """pattern finds matches, leftmost and non-overlapping; a match counts if group has at least ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns, in their listed order. The lengths of access and hex stand in the pattern: their runs are maximal.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
FINDING = "blob string, rule string, version int, start bigint, end bigint"
SCANNED = "blob string, rule string, version int"
#: Bits by which rows of unseen blobs are told, at least 15.
SIFT_BITS = 26


def address(docs: DataFrame) -> DataFrame:
    """doc_id, blob and text of each row."""
    t = docs.select("doc_id", text_of().alias("text"))
    return t.withColumn("blob", F.sha2("text", 256))


def _hits(rule: Rule, seen: Column) -> Column:
    """Texts between matches, matches and their tested group; null where nothing matches or the pair was scanned before."""
    p, t = F.lit(rule.pattern), F.col("text")
    parts = F.struct(
        F.lit(rule.kind).alias("rule"),
        F.lit(rule.version).alias("version"),
        F.arrays_zip(
            F.split(t, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(t, p, F.lit(0)).alias("hit"),
            F.regexp_extract_all(t, p, F.lit(rule.group)).alias("value"),
        ).alias("parts"),
    )
    return F.when(~F.array_contains(seen, rule.tag) & F.regexp_like(t, p), parts)


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings in blobs (blob, text, seen: tags of the rule versions that have scanned it)."""
    hits = blobs.select("blob", F.array_compact(F.array(*[_hits(r, F.col("seen")) for r in rules])).alias("hits")).where(F.size("hits") > 0)
    one = hits.select("blob", F.explode("hits").alias("h")).select("blob", "h.rule", "h.version", F.posexplode("h.parts").alias("i", "p"))
    width = F.length("p.gap") + F.coalesce(F.length("p.hit"), F.lit(0))
    over = "(partition by blob, rule, version order by i rows between unbounded preceding and current row)"
    ends = one.withColumn("w", width.cast("long")).withColumn("end", F.expr(f"sum(w) over {over}"))
    least = F.lit(1)
    for r in rules:
        least = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), r.least).otherwise(least)
    found = ends.where(F.col("p.hit").isNotNull() & (F.length("p.value") >= least))
    return found.select("blob", "rule", "version", (F.col("end") - F.length("p.hit")).cast("long").alias("start"), "end")


def update(docs: DataFrame, scanned: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. Returns (scanned, findings) of the run alone, to be appended to the ledger.

    With a ledger, the pairs it lacks are found from the blobs' names; only texts of blobs that lack a rule are shuffled (sifted).

    scanned: blob, rule, version. findings: blob, rule, version, start, end; written in the shared folder.
    """
    none = F.array().cast(T.ArrayType(T.StringType()))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = address(docs).select("blob").distinct().select("blob", F.explode(wanted).alias("r")).select("blob", "r.*")
    if scanned is None:
        # a map-side first per blob: copies meet before the shuffle
        return pairs, materialize(scan(address(docs).groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", none), rules))
    pairs = materialize(pairs.join(scanned, ["blob", "rule", "version"], "left_anti"))
    lacking = pairs.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("lacks"))
    texts = sifted(docs, lacking).groupBy("blob").agg(F.first("text").alias("text"))
    seen = F.filter(F.array(*[F.lit(r.tag) for r in rules]), lambda tag: ~F.array_contains("lacks", tag))
    new = materialize(scan(texts.join(lacking, "blob").select("blob", "text", seen.alias("seen")), rules))
    return pairs, new


def sifted(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """doc_id, blob, text of all rows of the blobs and of few others, without moving a text: the rows whose blob's bit is set.

    The bits are a table of at most 2**SIFT_BITS / 32768 rows of 4096 bytes, 8 MB in all whatever the number of blobs; it is broadcast.
    A blob has its bit by its hash, so none is missed; n blobs let through n / 2**SIFT_BITS of the others, which a join then drops.
    """
    bit = F.pmod(F.xxhash64("blob"), F.lit(1 << SIFT_BITS)) + 1
    bits = blobs.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    rows = address(docs).withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("at", F.bitmap_bit_position(bit))
    is_set = F.expr("(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(at % 8 as int))) <> 0")
    return rows.join(F.broadcast(bits), "bucket").where(is_set).select("doc_id", "blob", "text")


def join_paths(docs: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every document with the findings of its blob, ordered by start, then by the rules' order."""
    rank = F.lit(len(rules))
    for i, r in enumerate(rules):
        rank = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), i).otherwise(rank)
    live = findings.withColumn("rank", rank).where(F.col("rank") < len(rules))
    per = live.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "rule", "end"))).alias("found"))
    return address(docs).select("doc_id", "blob").join(materialize(per), "blob", "left")


class Ledger:
    """The tables ``scanned`` and ``findings`` in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        known = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if known else None

    def scanned(self) -> DataFrame | None:
        return self._table("scanned", SCANNED)

    def findings(self) -> DataFrame:
        """A run that was lost between its two writes leaves findings that are found again: equal rows count once."""
        return self._table("findings", FINDING).distinct()

    def run(self, docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Scan what the ledger lacks, append it, and join all findings back to the paths: doc_id, blob, found."""
        pairs, new = update(docs, self.scanned(), rules)
        new.write.mode("append").parquet(f"{self.path}/findings")
        pairs.write.mode("append").parquet(f"{self.path}/scanned")
        discard(new, pairs)
        return join_paths(docs, self.findings(), rules)


def scan_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, path: str | None = None) -> DataFrame:
    """doc_id, blob, found, by the ledger at path (a new one by default)."""
    spark = docs.sparkSession
    return Ledger(spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").run(docs, rules)


def digest(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts by rule, and the spans as text and as SHA-256."""
    f = F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,rule:string,end:bigint>>"))
    d = found.withColumn("f", f).withColumn("spans", F.expr("array_join(transform(f, x -> concat(x.rule, ':', x.start, ':', x.end)), ',')"))
    counts = [F.expr(f"cast(size(filter(f, x -> x.rule = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in rules]
    return d.select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")
