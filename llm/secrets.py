"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every candidate value is hashed and the hash counted over the whole corpus: in how many repositories, of how
many owners, it occurs.  A value of many owners is a widely copied example; one of a single owner that looks
live is a credential of that owner; the rest is unclear.  Besides the base kinds a wider kind, `rare`, takes
any long mixed token, and is reported only where ownership shows it to be a live credential of one owner.

Counts are taken in three steps (owner and repository, owner, hash), each combined before its shuffle; values
go back to their spans by a join of written tables, whose skewed keys adaptive execution splits.

Nulls and ties: a null text is empty; null owners (or repositories) count as one owner; rows that repeat are
counted as they stand; spans that start together are ordered by kind as listed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import common

# Kinds in their order, their patterns, the group that holds the value, its least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # as [0-9a-f]+ of 24 and more
)
RARE = ("rare", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
PLACEHOLDER = r"(?i)example|sample|dummy|change_?me|placeholder|your_|xxxx|0000|1234"

#: A value of so many owners is an example.
EXAMPLE_OWNERS = 3
MASK = "[SECRET]"


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, order, kind, end, value) of a kind's matches, leftmost and not overlapping."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    step = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))
    steps = F.filter(step, lambda s: s["value"].isNotNull())  # the last gap has no match
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>")

    def add(acc, s):
        start = acc["at"] + s["gap"]
        end = start + s["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(s["value"]) >= least, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.when(text.rlike(pattern), F.aggregate(steps, start, add, lambda acc: acc["found"])).otherwise(empty)


def _live_looking(value: Column) -> Column:
    """Mixed characters and no placeholder."""
    classes = sum((value.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]")), value.rlike("[0-9]").cast("int"))
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return (classes >= 2) & varied & ~value.rlike(PLACEHOLDER)


def has_candidate(text: Column) -> Column:
    may = F.lit(False)
    for _, pattern, _, _ in (*KINDS, RARE):
        may = may | text.rlike(pattern)
    return F.coalesce(may, F.lit(False))


def classified(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Rows of docs that may hold a secret, a written table: __doc (the row), __base and __spans.

    __base holds the base spans in order, __spans those and the rare spans that were found live; each has
    start, ord, kind, end and, in __spans, verdict (`example`, `owned` or `unclear`), owners and repositories.
    """
    found = docs.where(has_candidate(F.col("text"))).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    text = F.col("__doc.text")
    base = F.concat(*(_spans(text, kind, i, pattern, group, least) for i, (kind, pattern, group, least) in enumerate(KINDS)))
    found = found.withColumn("__base", F.array_sort(base)).withColumn("__rare", _spans(text, RARE[0], len(KINDS), *RARE[1:]))
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    apart = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = found.withColumn("__rare", F.filter("__rare", lambda s: mixed(s) & apart(s)))
    hashed = lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("hash"), _live_looking(s["value"]).alias("live"))
    found = found.select("__doc", F.transform("__base", hashed).alias("__base"), F.transform("__rare", hashed).alias("__rare"))
    found = common.staged(common.with_row(found, "__row"), "candidates")

    each = found.select("__row", F.col(f"__doc.{owner}").alias("owner"), F.col(f"__doc.{repository}").alias("repository"), F.explode(F.concat("__base", "__rare")).alias("s"))
    counts = each.groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.count("*").alias("times"))
    counts = counts.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("times").alias("times"))
    counts = counts.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("times").alias("times"))
    counts = common.staged(counts, "owners")

    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when((F.col("owners") == 1) & F.col("s.live"), "owned").otherwise("unclear")
    each = each.select("__row", "s", F.col("s.hash").alias("hash")).join(counts, "hash").withColumn("verdict", verdict)
    each = each.where((F.col("s.kind") != RARE[0]) | (F.col("verdict") == "owned"))
    span = F.struct(*(F.col(f"s.{x}").alias(x) for x in ("start", "ord", "kind", "end")), "verdict", "owners", "repositories")
    spans = each.groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,verdict:string,owners:bigint,repositories:bigint>>")
    return found.join(spans, "__row", "left").select("__doc", "__base", F.coalesce("__spans", none).alias("__spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_owned(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """docs in their columns: in each text the spans of owned credentials are masked, and n_chars follows the text.

    All rows stay; examples and unclear values stay as they are.
    """
    found = classified(docs, owner, repository)
    owned = F.array_sort(F.filter("__spans", lambda s: s["verdict"] == "owned"))

    def cut(acc, s):
        """Text between the last masked span and this one; overlapping spans are masked once."""
        gap = F.substring(F.col("__doc.text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["text"], gap, F.lit(MASK))).otherwise(acc["text"]).alias("text"))

    masked = F.aggregate(owned, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), cut,
        lambda acc: F.concat(acc["text"], F.substring(F.col("__doc.text"), acc["at"] + 1, F.length("__doc.text"))))
    new = F.when(F.size(owned) > 0, masked).otherwise(F.col("__doc.text"))
    changed = found.select("__doc", new.alias("__text"), (F.size(owned) > 0).alias("__masked"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("__masked"), F.length("__text").cast(docs.schema[c].dataType)).otherwise(F.col(f"__doc.`{c}`")).alias(c))
        else:
            columns.append(F.col(f"__doc.`{c}`").alias(c))
    return docs.where(~has_candidate(F.col("text"))).unionByName(changed.select(*columns))


def scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all spans, and how many are owned or examples."""
    found = classified(docs.select("doc_id", "text", *{owner, repository}), owner, repository)
    number = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    told = lambda verdict: F.size(F.filter("__spans", lambda s: s["verdict"] == verdict)).cast("long")
    hits = found.select("__doc.doc_id", *(number(kind[0]).alias(f"n_{kind[0]}") for kind in KINDS), F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.col("__spans")).alias("spans"), told("owned").alias("n_owned"), told("example").alias("n_example"))
    none = docs.where(~has_candidate(F.col("text"))).select("doc_id", *(F.lit(0).cast("long").alias(f"n_{kind[0]}") for kind in KINDS), F.sha2(F.lit(""), 256).alias("base_sha256"),
        F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_owned"), F.lit(0).cast("long").alias("n_example"))
    return hits.unionByName(none)


def op3_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
