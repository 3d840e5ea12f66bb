"""Secret scans with a ledger of scanned contents.

Every text that was ever seen is a blob, named by the SHA-256 of its content.
The ledger holds two tables in a shared folder: ``scans`` (blob, rule version)
and ``findings`` (blob, rule version, kind, start, end). A run scans only blobs
without a row for its rule version, writes findings before scans (a run that
broke off is simply done again), and joins findings back to all paths, that is
to every row that holds the content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import columns, empty_if_null, folder, in_files, saved, table, unused


def _any_case(word: str) -> str:
    """ASCII letters in either case, spelled out so that every regex engine agrees."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` must not match a line break; group ``group`` of a match needs ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    holds: str | None = None  # a cheap substring of every match


# The base rules, in their order.
BASE = (
    Rule("assign", "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", holds="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds="eyJ"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", holds="PRIVATE KEY-----"),
)
RULES = BASE + ADDED
VERSION = "base3-added3-v1"


def _hits(rule: Rule, number: int, text: Column) -> Column:
    """Matches of a rule as structs of lengths, in order; empty where there is none."""
    there = text.rlike(rule.pattern)
    if rule.holds:
        there = F.contains(text, F.lit(rule.holds)) & there
    lengths = lambda a: F.transform(a, F.length)
    all_of = lambda g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))
    zipped = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(all_of(0)).alias("size"),
                          lengths(all_of(rule.group)).alias("tested"))
    rows = F.transform(zipped, lambda z, i: F.struct(
        F.lit(number).alias("kind_no"), i.alias("nth"), z["gap"].alias("gap"), z["size"].alias("size"),
        (z["tested"] >= rule.least).alias("passes")))
    return F.when(there, F.filter(rows, lambda r: r["size"].isNotNull())).otherwise(F.array())


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, start, end`` of all matches in ``blob, text``; code points, end exclusive.

    Positions are running sums of the text between and inside matches, over the hits alone.
    """
    hits = blobs.select("blob", F.explode(F.concat(*[_hits(r, i, F.col("text")) for i, r in enumerate(rules)])).alias("h")).select("blob", "h.*")
    order = Window.partitionBy("blob", "kind_no").orderBy("nth")
    ended = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind_no") + 1)
    return ended.where("passes").select("blob", kind.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


SCANS = "blob string, version string"
FINDINGS_OF = 8192  # texts whose findings share a file
FINDINGS = "blob string, version string, kind string, start bigint, `end` bigint"


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        # an empty first write makes the folder, so that a new ledger reads as empty
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scans(self) -> DataFrame:
        return self._read("scans", SCANS)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def scan(self, docs: DataFrame, version: str = VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new among ``doc_id, text`` and return ``doc_id, blob`` of every row (its path).

        NULL text is the empty text; rows with equal text share one blob; a repeated row is a path of its own.
        """
        named = docs.select("doc_id", empty_if_null("text").alias("text")).withColumn("blob", F.sha2("text", 256))
        holder = F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63))  # a row to read the content from
        paths = saved(named.select("doc_id", "blob", holder.alias("holder")), "secret-paths")
        known = self.scans().where(F.col("version") == version).select("blob")
        unseen = saved(in_files(paths.groupBy("blob").agg(F.min("holder").alias("holder")).join(known, "blob", "left_anti"), paths.count()), "secret-unseen")
        texts = named.withColumn("holder", holder).join(unseen.hint("shuffle_hash"), ["blob", "holder"]).select("blob", "text")
        found = findings(texts, rules).distinct()  # rows with one id and one text are read twice
        told = found.select("blob", F.lit(version).alias("version"), "kind", "start", "end")
        in_files(told, unseen.count(), FINDINGS_OF).write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("blob", F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/scans")
        return paths.select("doc_id", "blob")


def spans_by_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans``: an array of ``start, kind_no, end`` per blob with findings, in order of start, then rule."""
    number = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int") - 1
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("kind_no"), "end"))).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, ledger: Ledger, version: str = VERSION) -> DataFrame:
    """``doc_id, blob, spans`` for every row; an empty array where nothing was found."""
    paths = ledger.scan(docs, version)
    by_blob = spans_by_blob(ledger.findings().where(F.col("version") == version))
    none = F.expr("CAST(array() AS array<struct<start:bigint,kind_no:int,end:bigint>>)")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, ledger: Ledger, version: str = VERSION, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mask``; overlapping findings are masked together.

    Texts without findings are unchanged, all rows stay; a column ``n_chars`` follows the text.
    """
    ledger.scan(docs, version)
    by_blob = spans_by_blob(ledger.findings().where(F.col("version") == version))
    blob, spans = unused(docs, "_blob"), unused(docs, "_spans")
    found = by_blob.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    out = docs.withColumn(blob, F.sha2(empty_if_null("text"), 256)).join(found, blob, "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        piece = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["text"], piece).alias("text"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, cut)
    whole = F.concat(done["text"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text")))
    out = out.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*columns(docs))


def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of all ``documents``, by a ledger that starts empty."""
    out = scanned(table(spark, sf, "documents"), Ledger(spark, folder(spark, "secret-ledger")))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _rule_sql(rule: Rule, number: int) -> str:
    p = rule.pattern.replace("'", "''")
    return (f"SELECT rid, '{rule.kind}' AS kind, {number} AS kind_no, unnest(range(1, len(f) + 1)) AS nth, f, g, v FROM (SELECT rid, "
            f"regexp_extract_all(t, '{p}', 0) AS f, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {rule.group}) AS v FROM d)")


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({' UNION ALL '.join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
p AS (SELECT rid, kind, kind_no, nth, length(f[nth]) AS size, length(v[nth]) AS tested,
      sum(length(g[nth]) + length(f[nth])) OVER (PARTITION BY rid, kind ORDER BY nth)::BIGINT AS stop FROM h),
s AS (SELECT rid, kind, kind_no, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM p
      WHERE tested >= CASE kind_no {' '.join(f'WHEN {i} THEN {r.least}' for i, r in enumerate(RULES))} END),
a AS (SELECT rid, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
      string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans
      FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""
