"""Secret scans over an incremental ledger of content-addressed blobs.

A version's text is known by its SHA-256. What is scanned is each blob once for
each rule version that the ledger doesn't have for it; findings belong to blobs
and are joined back to every path that ever held one. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halocline.llm.joins import sized
from halocline.session import cut


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has ``least`` code points; matches are leftmost and don't overlap."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # a shorter run holds no longer one, so that the least length can be part of these two
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
_BEGIN, _END = ("-----%s [A-Z ]{0,40}PRIVATE KEY-----" % w for w in ("BEGIN", "END"))
#: Base kinds first: a span's place in the results follows this order. A private
#: key goes to its END line, or where there is none to the end of its base64
#: lines. No pattern starts over inside what it has passed, beyond a bounded part.
RULES = (
    *BASE,
    Rule("pem", rf"{_BEGIN}[A-Za-z0-9+/=\x09-\x0D\x20]*{_END}|{_BEGIN}(?:[\x09-\x0D\x20]*[A-Za-z0-9+/=\r\n]{{40,}})?", 0, 1, 2),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{1,256}[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40, 2),
)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], path: str, text: str) -> DataFrame:
    """(blob_id, text, todo): one version of each blob for which some rule is new; ``todo`` has the keys of those rules."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    content = versions.select(blob_id(F.col(text)).alias("blob_id"), F.col(path).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = cut(content.groupBy("blob_id").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1").select("blob_id", "first"))
    once = content.join(sized(shared), "blob_id", "left").where("first is null or path = first").drop("first", "path")
    if ledger is None:
        return once.withColumn("todo", keys)
    # which blobs are open is found on their ids alone; texts meet only those
    seen = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "kind", F.col("version").cast("string"))).alias("seen"))
    open_ = content.select("blob_id").distinct().join(seen, "blob_id", "left").select("blob_id", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = cut(open_.where(F.size("todo") > 0))
    return once.join(sized(todo, F.size("todo")), "blob_id")


def _located(rule: Rule) -> Column:
    """A rule's matches in ``text``: the lengths of the text before each, of it and of its group; after the last one, the rest with nulls."""

    def match(pair: Column, no: Column) -> Column:
        m = pair["m"]
        value = F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.struct(F.length(pair["g"]).alias("gap"), F.length(m).alias("len"), F.length(value).alias("size"), no.alias("no"), F.lit(rule.key).alias("key"))

    kind = "array<struct<gap:int,len:int,size:int,no:int,key:string>>"
    between, whole = F.split(F.col("text"), rule.pattern, -1), F.regexp_extract_all(F.col("text"), F.lit(rule.pattern), F.lit(0))
    rows = F.transform(F.zip_with(between, whole, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), match)
    wanted = F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern)
    return F.when(wanted, rows.cast(kind)).otherwise(F.array().cast(kind))


def findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, kind, version, start, end) of each match that counts, in code points, end exclusive, of the ``todo`` rules of :func:`unseen`.

    Splitting at the matches gives the text between them; lengths summed in
    order are the places. Only matches leave the row they are in. Empty texts
    have none; an empty table gives no row.
    """
    parts = [_located(r) for r in rules]
    hits = blobs.select("blob_id", F.explode(F.concat(*parts)).alias("m")).where("m.len is not null").select("blob_id", "m.*")
    so_far = Window.partitionBy("blob_id", "key").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.dropDuplicates(["blob_id", "key", "no"]).withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(so_far))
    least = F.create_map(*(x for r in rules for x in (F.lit(r.key), F.lit(r.least))))
    counts = placed.where(F.col("size") >= least[F.col("key")])
    name = F.split("key", "@")
    return counts.select("blob_id", name[0].alias("kind"), name[1].cast("int").alias("version"), (F.col("end") - F.col("len")).alias("start"), "end")


class Ledger:
    """Findings and scanned (blob, rule version) pairs, as tables below a folder that executors share.

    Findings are appended before the pairs; a run that dies between the two is
    repeated by the next one, and readers take distinct rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}").distinct()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    @property
    def pairs(self) -> DataFrame | None:
        return self._read("pairs")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> None:
        """Scan what is new in ``versions`` (any number of rows a path) and add it to the ledger.

        Null texts are the empty blob; repeated rows and equal texts are one
        blob; an empty table adds nothing; other columns are not read.
        """
        blobs = unseen(versions, self.pairs, rules, path, text)
        found = findings(blobs, rules)
        pairs = blobs.select("blob_id", F.explode("todo").alias("key")).select("blob_id", F.split("key", "@")[0].alias("kind"), F.split("key", "@")[1].cast("int").alias("version"))
        found.write.mode("append").parquet(f"{self.folder}/findings")
        pairs.write.mode("append").parquet(f"{self.folder}/pairs")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The findings of the given rules at their versions."""
        wanted = [r.key for r in rules]
        return self._read("findings").where(F.concat_ws("@", "kind", F.col("version").cast("string")).isin(wanted))


def spans(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, spans): the findings of each blob by start, then rule order."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    item = F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind")
    return found.groupBy("blob_id").agg(F.sort_array(F.collect_list(item)).alias("spans"))


def to_paths(versions: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob_id, spans) of every version, with an empty list where there is none.

    Null texts are the empty blob; repeated rows and equal texts all get their
    blob's findings; null paths stay; an empty table gives no row; no other
    column is read.
    """
    rows = versions.select(F.col(path).alias(path), blob_id(F.col(text)).alias("blob_id"))
    named = cut(spans(found, rules))
    none = F.array().cast(named.schema["spans"].dataType)
    return rows.join(sized(named, F.size("spans")), "blob_id", "left").select(path, "blob_id", F.coalesce("spans", none).alias("spans"))


def rendered(items: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) replaced by ``mark``; other columns and rows stay.

    Null texts stay null; repeated rows are each redacted; empty in, empty out.
    """
    at = Window.partitionBy("blob_id").orderBy("start", "end")
    ahead = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.select("blob_id", "start", "end").withColumn("_new", F.when(F.col("start") < ahead, 0).otherwise(1))
    island = marked.withColumn("_no", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = island.groupBy("blob_id", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    pieces = merged.withColumn("prior", F.lag("end", 1, 0).over(Window.partitionBy("blob_id").orderBy("start")))
    cuts = cut(pieces.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "prior", "end"))).alias("_cuts"))).withColumnRenamed("blob_id", "_blob")
    joined = docs.withColumn("_blob", blob_id(F.col(text))).join(sized(cuts, F.size("_cuts")), "_blob", "left")
    body = F.array_join(F.transform("_cuts", lambda c: F.concat(F.substring(F.col(text), (c["prior"] + 1).cast("int"), (c["start"] - c["prior"]).cast("int")), F.lit(mark))), "")
    tail = F.substring(F.col(text), (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(text))
    return joined.withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.concat(body, tail))).select(*docs.columns)
