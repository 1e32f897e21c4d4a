"""Secret scans with a ledger of blobs: each content is scanned once for each version of a rule.

Every version of a path is content-addressed (SHA-256 of its text).  The ledger is an append-only
folder of three tables: ``scans`` (one row for a blob and the rule versions it was scanned with, and
the lengths from which its findings are placed), ``paths`` (which path held which blob in which
commit) and ``commits`` (the updates that were written whole; paths of others are not read, and an
update that was cut off is simply made again).  An update looks its digests up in the ledger first
and moves the texts only of blobs with a rule version that no earlier scan covers.  Findings are those
of the current versions of the ledger's rules, joined back to all paths that ever held the blob.
Only DataFrame operations.

Defined cases: a null text counts as empty; very long texts are scanned whole, in time that grows with their length; equal texts are one blob whatever their path; repeated
rows are repeated paths, a null path is one too; an empty table adds nothing; other columns are
ignored, and stay as they are in ``redact``, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Given, Scratch, join_with_hot, table


#: Spans that are broadcast to redact texts, and blobs that are broadcast to find their texts; beyond it a shuffled join does.
BROADCAST_SPANS, BROADCAST_BLOBS = 500_000, 200_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``, kept if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of hex digits is taken whole either way, so the length can stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    # bounded, so that neither Java's stack nor the time grows with a text of repeated beginnings
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,32} ){0,8}PRIVATE KEY-----", version=2, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,256}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]+", version=2, base=False),
)


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.length(x))


def _hits(text: Column, todo: Column, rules: tuple[Rule, ...]) -> Column:
    """For each rule with a match: the lengths of the gaps, the matches and the judged groups."""
    found = []
    for r in rules:
        p = F.lit(r.pattern)
        matches = _lengths(F.regexp_extract_all(text, p, F.lit(0)))
        groups = _lengths(F.regexp_extract_all(text, p, F.lit(r.group))) if r.group else matches
        parts = F.struct(F.lit(r.name).alias("rule"), _lengths(F.split(text, r.pattern, -1)).alias("gaps"), matches.alias("matches"), groups.alias("groups"))
        found.append(F.when(F.array_contains(todo, r.name) & F.regexp_like(text, p), parts))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


class Ledger:
    """The append-only ledger in folder ``where`` (a path that driver and executors share)."""

    def __init__(self, spark, where: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.where, self.rules = spark, where, rules

    def _read(self, name: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.parquet(f"{self.where}/{name}") if there else None

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.where}/{name}")

    def update(self, versions: DataFrame, path_col: str = "path", text_col: str = "text", commit: int = 0) -> None:
        """Record the versions of one commit and scan what no earlier update has scanned."""
        addressed = self.scan(versions, text_col, F.col(path_col))
        batch = uuid.uuid4().hex
        self._append(addressed.select("path", "blob", F.lit(commit).alias("commit"), F.lit(batch).alias("batch")), "paths")
        self._append(self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(commit).alias("commit")), "commits")

    def scan(self, versions: DataFrame, text_col: str = "text", path: Column | None = None) -> DataFrame:
        """Scan contents for the rule versions that they were not scanned for, without recording paths: so a changed rule is brought to
        versions of earlier commits.  Returns path, blob and text of the versions."""
        names = F.array(*[F.lit(r.name) for r in self.rules])
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        addressed = versions.select((F.lit(None) if path is None else path).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
        with Scratch(self.spark, "todo") as asked:
            digests = addressed.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
            if (scans := self._read("scans")) is None:
                todo = digests.withColumn("todo", names)
            else:
                seen = scans.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
                left = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
                todo = digests.join(seen, "blob", "left").select("blob", "copies", left.alias("todo")).filter(F.size("todo") > 0)
            self._append(self._scanned(addressed, asked.write(todo, "blobs"), scans is None, names), "scans")
        return addressed

    def _scanned(self, addressed: DataFrame, todo: DataFrame, whole: bool, names: Column) -> DataFrame:
        """blob, rules, hits of the blobs of ``todo`` (the ``whole`` ledger is new: of all).

        Where the blobs that several paths share are few, they are broadcast, and all others are scanned where they stand.
        """
        shared = todo.filter("copies > 1").drop("copies")
        if whole and shared.count() <= BROADCAST_BLOBS:
            held = F.broadcast(shared.select("blob"))
            several = addressed.select("blob", "text").join(held, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
            blobs = addressed.select("blob", "text").join(held, "blob", "left_anti").unionByName(several).withColumn("todo", names)
        else:
            few = not whole and todo.count() <= BROADCAST_BLOBS
            wanted = todo.drop("copies")
            met = addressed.select("blob", "text").join(F.broadcast(wanted) if few else wanted, "blob")
            blobs = met.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
        return blobs.select("blob", F.col("todo").alias("rules"), _hits(F.col("text"), F.col("todo"), self.rules).alias("hits"))

    def findings(self) -> DataFrame:
        """blob, kind, start, end (code points, end exclusive) of every kept match of the rules' current versions."""
        by_rule = lambda value: F.create_map(*[F.lit(x) for r in self.rules for x in (r.name, value(r))])[F.col("rule")]
        one = (
            self._read("scans").filter(F.size("hits") > 0)
            .select("blob", F.explode("hits").alias("hit")).select("blob", "hit.*").filter(F.col("rule").isin(*[r.name for r in self.rules]))
            # the gap after the last match is longer than the other arrays and falls away
            .select("blob", "rule", F.posexplode(F.arrays_zip("gaps", "matches", "groups")).alias("at", "x"))
            .filter(F.col("x.matches").isNotNull())
        )
        so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("x.gaps") + F.col("x.matches")).over(so_far)
        return (
            one.select("blob", "rule", end.alias("end"), F.col("x.matches").alias("n"), F.col("x.groups").alias("judged"))
            .filter(F.col("judged") >= by_rule(lambda r: r.least))
            .select("blob", by_rule(lambda r: r.kind).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")
        )

    def by_blob(self) -> DataFrame:
        """blob and its findings, sorted by start and then in the order of the rules."""
        rank = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.kind, i)])
        return self.findings().groupBy("blob").agg(
            F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("found")
        )

    def versions(self) -> DataFrame:
        """path, blob, commit of every version of the updates written whole."""
        whole = self._read("commits").select("batch")  # one row an update
        return self._read("paths").join(whole, "batch", "left_semi").select("path", "blob", "commit")

    def paths(self) -> DataFrame:
        """path, blob, commit of every recorded version, with the findings of its blob (null: none)."""
        paths = self.versions()
        copies = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
        found = copies.join(self.by_blob(), "blob", "left")  # blobs without findings too: they may be the hot ones
        return join_with_hot(paths, found, "blob", F.col("copies"), paths.count())


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``[REDACTED]``; nothing else changes.

    Spans that overlap are replaced as one.  ``n_chars``, where present, follows the new text.
    """
    with Given(scratch, docs.sparkSession, "redact") as run:
        return _redacted(docs, id_col, text_col, run, scratch is None)


def _redacted(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, settle: bool) -> DataFrame:
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that no name clashes
    text_at = names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    ledger = Ledger(docs.sparkSession, scratch.path("ledger"))
    ledger.update(docs, id_col, text_col)
    found = scratch.write(ledger.by_blob(), "found")
    # walk the sorted spans: keep what lies between the end so far and the next start
    text = F.col(text_at).cast("string")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit("[REDACTED]")))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    new = F.when(F.col("found").isNull(), text).otherwise(F.aggregate("found", start, step, finish))
    blob = F.sha2(F.coalesce(text, F.lit("")), 256)
    few = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0] <= BROADCAST_SPANS  # few texts hold secrets
    copies = ledger.versions().groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    right, total = (found, 0) if few else (found.join(copies, "blob"), docs.count())
    if settle:
        right = scratch.settled(right)[0]
    keyed = plain.withColumn("blob", blob)
    joined = keyed.join(F.broadcast(right), "blob", "left") if few else join_with_hot(keyed, right, "blob", F.col("copies"), total)
    out = joined.withColumn(text_at, new).select(*names)
    if "n_chars" in docs.columns:
        at = names[docs.columns.index("n_chars")]
        out = out.withColumn(at, F.length(text_at).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def _reported(paths: DataFrame) -> list[Column]:
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    base = F.filter(found, lambda x: x["kind"].isin(*[r.kind for r in RULES if r.base]))
    n = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(found).alias("spans"), F.col("blob")]


def op4_secret_ledger(spark, sf_dir: str) -> DataFrame:
    with Scratch(spark, "secrets") as scratch:
        ledger = Ledger(spark, scratch.path("ledger"))
        ledger.update(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
        paths = ledger.paths()
        return scratch.settled(paths.select(F.col("path").alias("doc_id"), *_reported(paths)))[0]


#: What an earlier version of the ledger looked for.
OLD_RULES = tuple(Rule(r.kind, r.pattern, r.group, r.least, r.version - 1, r.base) if r.kind == "pem" else r for r in RULES)


def op4_secret_history(spark, sf_dir: str) -> DataFrame:
    """All versions of all paths after two commits: drafts, of which there was the first line only, scanned with an older
    version of one rule, and the documents; texts of one line are the same blob in both."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    drafts = docs.withColumn("text", F.substring_index("text", "\n", 1))
    with Scratch(spark, "history") as scratch:
        where = scratch.path("ledger")
        Ledger(spark, where, OLD_RULES).update(drafts, commit=1)
        ledger = Ledger(spark, where)
        ledger.update(docs, commit=2)
        ledger.scan(drafts)  # the changed rule, on contents that are in the drafts only
        paths = ledger.paths()
        return scratch.settled(paths.select(F.col("path").alias("doc_id"), "commit", *_reported(paths)))[0]
