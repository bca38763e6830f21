"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Candidates are found by patterns in every whole text. Their values are hashed and aggregated over
the corpus by distinct owner (source) and repository (document): a value that many owners share, or
that one owner has in very many repositories, is a copied example; one of few owners and few
repositories looks live. Such values that mix letters and digits are added as spans of kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_counted, materialize, own_names

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
LEAST_VALUE = 6


def _matches(text: Column, kind: int, pattern: str, value_group: int, maybe: Column) -> Column:
    """Array of (kind, match, value, text length before the match since the last one) by match number.

    ``split`` with no limit keeps what lies between the matches, so positions follow by sums.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.transform(
        F.arrays_zip(whole.alias("match"), value.alias("value")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), x["match"].alias("match"), x["value"].alias("value"), F.get(gaps, i).alias("gap"), i.alias("no")),
    )
    return F.when(maybe, rows).otherwise(F.array().cast("array<struct<kind:int,match:string,value:string,gap:int,no:int>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """One row a pattern match (uid, doc_id, source, kind, start, end, value), and one with null kind for each document.

    Positions are code points, ends exclusive. Matches of one kind do not overlap; a match that fails
    its kind's length is dropped after scanning, so it still hides what it covers.
    """
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), source=F.col("source"), text=F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    text, low = F.col("text"), F.lower("text")
    named = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    found = F.concat(
        _matches(text, 0, ASSIGN, 2, named),
        _matches(text, 1, ACCESS, 0, F.contains(text, F.lit("AKIA"))),
        _matches(text, 2, HEX, 0, text.rlike(HEX)),
        _matches(text, 3, OPAQUE, 0, text.rlike(OPAQUE)),
        F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("gap"), F.lit(0).alias("no"))),
    )
    each = rows.select("uid", "doc_id", "source", F.explode(found).alias("m")).select("uid", "doc_id", "source", "m.*")
    order = Window.partitionBy("uid", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length("match"), F.lit(0))
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    fits = F.col("kind").isNull() | (F.col("kind").isin(1, 2)) | ((F.col("kind") == 0) & (F.length("value") >= LEAST_VALUE))
    mixed = (F.col("kind") == 3) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= 10)
    return each.where(fits | mixed).select("uid", "doc_id", "source", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories, n_found: one row a candidate value, counted in two steps so that a common one is no hot key."""
    hashed = found.where("kind is not null").groupBy("value_hash", "source", "uid").agg(F.count("*").alias("n"))
    per_owner = hashed.groupBy("value_hash", "source").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_found")
    )


#: A value in more distinct sources, or in more documents, is a copied example.
OWNERS, REPOSITORIES = 2, 8


def scan_secrets(docs: DataFrame, most_owners: int = OWNERS, most_repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied for every row.

    A value is live if at most ``most_owners`` sources and at most ``most_repositories`` documents have
    it. Base spans always stay; an ``owned`` span is added where its value is live and no base span
    holds it. n_live and n_copied count all spans by that rule. A null text is empty and has no spans;
    a null source is an owner of its own; repeated rows are repositories of their own; no rows give no
    rows; extra columns are ignored.
    """
    found = candidates(docs).withColumn("value_hash", F.sha2("value", 256)).drop("value")
    found = materialize(found, "secret-candidates")
    known = found.where("kind is not null")
    owned = materialize(ownership(found), "secret-owners")
    total = known.count()
    judged = join_counted(known, owned, "value_hash", "n_found", total)
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    span = F.struct("start", "kind", "end", live.alias("live"))
    blank = found.where("kind is null").select("uid", "doc_id", F.lit(None).cast("struct<start:bigint,kind:int,end:bigint,live:boolean>").alias("span"))
    rows = judged.select("uid", "doc_id", span.cast("struct<start:bigint,kind:int,end:bigint,live:boolean>").alias("span")).unionByName(blank)
    per = rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("span")).alias("all"))
    base = F.filter("all", lambda x: x["kind"] < 3)
    per = per.withColumn("base", base)
    extra = F.filter(
        "all",
        lambda x: (x["kind"] == 3) & x["live"] & ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])),
    )
    per = per.withColumn("owned", extra).withColumn("spans", F.array_sort(F.concat("base", "owned")))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    return per.select(
        "doc_id",
        count("base", lambda x: x["kind"] == 0).alias("n_assign"),
        count("base", lambda x: x["kind"] == 1).alias("n_access"),
        count("base", lambda x: x["kind"] == 2).alias("n_hex"),
        F.sha2(said("base"), 256).alias("base_sha256"),
        said("spans").alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        count("spans", lambda x: x["live"]).alias("n_live"),
        count("spans", lambda x: ~x["live"]).alias("n_copied"),
    )
