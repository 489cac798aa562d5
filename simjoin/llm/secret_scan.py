"""Secret scans by linking the parts of a credential, in SQL functions alone.

Patterns find parts: identifiers, secrets and endpoints. Strong parts are reported as they
are. Weak ones (a bare token, a user name, an address) are reported only where the parts
that complement them stand within a scope of some code points in the same text, which an
interval join over scope-wide cells decides: a part is in the cells that it reaches, and
cells hold few parts, as parts of one kind do not overlap. So the join grows with the text
and not with the square of anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, stored

#: Code points between parts that belong together, at most: from the end of one to the start of the other.
SCOPE = 200


@dataclass(frozen=True)
class Part:
    kind: str
    role: str  # identifier, secret or endpoint
    pattern: str
    group: int = 0  # the match counts if this group has `least` characters
    least: int = 0
    also: tuple[str, ...] = ()  # patterns that the match has to contain
    weak: bool = False


# The first three are the base kinds, in the order they are listed in.
# [0-9a-f]{24,} and AKIA[A-Z0-9]{16,} match the same spans as runs of any length that are
# then held to 24 and 20 characters, because their runs are maximal.
PARTS = (
    Part("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Part("access", "identifier", "AKIA[A-Z0-9]{16,}"),
    Part("hex", "secret", "[0-9a-f]{24,}"),
    Part("user", "identifier", r"""(?i)(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", weak=True),
    Part("blob", "secret", "[A-Za-z0-9+/_-]{32,}={0,2}", also=("[0-9]", "[A-Z]"), weak=True),
    Part("endpoint", "endpoint", r"""[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]{4,}""", weak=True),
)


def _pieces(part: Part, k: int) -> Column:
    """An array of (kind, position, length before, match), null where the text has no match."""
    text = F.col("text")
    before = F.transform(F.split(text, part.pattern, -1), F.length)
    match = F.regexp_extract_all(text, F.lit(part.pattern), 0)
    zipped = F.arrays_zip(F.slice(before, 1, F.size(match)).alias("before"), match.alias("match"))
    return F.when(text.rlike(part.pattern), F.transform(zipped, lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["before"].alias("before"), x["match"].alias("match"))))


def scan(docs: DataFrame, parts: tuple[Part, ...] = PARTS, scope: int = SCOPE) -> DataFrame:
    """One row per document (doc_id, text): its spans, base and linked.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start,
    then kind as listed, comma-joined; code points, end exclusive) and n_weak, the number of
    weak parts among them.

    A weak identifier needs a secret within the scope, a weak secret an identifier, an
    endpoint both, and parts inside an endpoint count for it. Else parts that overlap do not
    complement each other, and weak ones that a base span overlaps are part of it and not
    reported. Parts may have any length. A null or empty text has no spans; rows that repeat, or share a doc_id, are
    scanned each by itself; a null doc_id stays null; other columns are ignored.
    """
    docs = own_columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    empty = "array<struct<k:int,i:int,before:int,match:string>>"
    pieces = F.concat(*[F.coalesce(_pieces(p, k), F.array().cast(empty)) for k, p in enumerate(parts)])
    found = stored(docs.select("row", "doc_id", pieces.alias("pieces")), "parts")

    order = W.partitionBy("row", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    spans = found.where(F.size("pieces") > 0).select("row", F.inline("pieces"))
    spans = spans.withColumn("size", F.length("match")).withColumn("end", F.sum(F.col("before") + F.col("size")).over(order).cast("long"))
    for k, p in enumerate(parts):
        if p.least:
            spans = spans.where((F.col("k") != k) | (F.length(F.regexp_extract("match", p.pattern, p.group)) >= p.least))
        for pattern in p.also:
            spans = spans.where((F.col("k") != k) | F.col("match").rlike(pattern))
    of = lambda test: F.col("k").isin([k for k, p in enumerate(parts) if test(p)])
    spans = spans.select("row", "k", (F.col("end") - F.col("size")).alias("start"), "end", of(lambda p: p.weak).alias("weak"), of(lambda p: p.role == "identifier").alias("id"), of(lambda p: p.role == "secret").alias("secret"))
    spans = stored(spans, "spans")

    cells = lambda reach: F.explode(F.sequence(F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope)))
    weak = spans.where("weak").withColumn("cell", cells(0)).alias("w")
    others = spans.where("id or secret").withColumn("cell", cells(scope)).alias("o")
    # a pair may meet in several cells, which the maxima below do not mind
    gap = F.greatest(F.col("o.start") - F.col("w.end"), F.col("w.start") - F.col("o.end"))
    near = weak.join(others, (F.col("w.row") == F.col("o.row")) & (F.col("w.cell") == F.col("o.cell")) & (gap <= scope))
    over = (F.col("o.start") < F.col("w.end")) & (F.col("w.start") < F.col("o.end"))
    counts_ = ~over | ~(F.col("w.id") | F.col("w.secret"))
    linked = near.groupBy("w.row", "w.k", "w.start", "w.end", "w.id", "w.secret").agg(F.max(F.col("o.id") & counts_).alias("by_id"), F.max(F.col("o.secret") & counts_).alias("by_secret"), F.max(over & ~F.col("o.weak")).alias("inside"))
    linked = linked.where(F.when(F.col("id"), F.col("by_secret") & ~F.col("inside")).when(F.col("secret"), F.col("by_id") & ~F.col("inside")).otherwise(F.col("by_id") & F.col("by_secret")))
    told = spans.where("not weak").select("row", "k", "start", "end").unionByName(linked.select("row", "k", "start", "end"))

    entries = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("all"))
    names = F.array(*[F.lit(p.kind) for p in parts])
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("all", test)).cast("long")
    base = F.filter("all", lambda s: s["k"] < 3)
    out = found.select("row", "doc_id").join(entries, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")))
    counts = [F.size(F.filter(F.transform("all", lambda s: s["k"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{parts[k].kind}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("all")).alias("spans"), count(lambda s: s["k"] >= 3).alias("n_weak"))
