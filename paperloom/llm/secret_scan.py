"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (assign, access, hex) are always reported. Weak ones (id, secret, endpoint) are parts of a credential that
mean little alone: each is reported only if its complement lies in the same scope, within ``reach`` code points. A scope
ends at a blank line. An id needs a secret, a secret needs an id, an endpoint needs both; strong access spans count as
ids, strong assign and hex spans as secrets. An id and a secret have to be disjoint: a token isn't its own complement. An id
or secret that overlaps a strong span is left to it; an endpoint is reported with the credential inside it. The interval
join goes over the sorted begins and ends of a scope's parts: running maxima and counts over windows give each candidate
the nearest complement before and behind it and what overlaps it, so no pairs are emitted and no window is walked twice.

Places are counted in code points without a function for them: the pieces between matches (``split``) and the matches
themselves (``regexp_extract_all``) alternate, so lengths add up to starts.

Defined cases: null and empty texts have no spans; repeated rows each get the same result; texts of any length are
scanned whole; a null doc_id is scanned like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Kinds in the order in which ties of start are listed. "break" ends a scope and is never reported.
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint", "break"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "id": r"""(?i)\b(?:client|account|access_?key|tenant|user|login|key)[_-]?(?:id|name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}|\bASIA[A-Z0-9]{16}\b""",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"""(?i)\b(?:https?|jdbc:[a-z0-9]+|postgres|postgresql|mysql|redis|mongodb|amqp|s3)://[^\s"'<>]{4,}""",
    "break": r"\n[\x20\t\r]*\n",
}
STRONG, WEAK = KINDS[:3], KINDS[3:6]
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, kind: str) -> Column:
    """Sorted spans of the leftmost non-overlapping matches of a kind; nothing but a search where there are none."""
    pattern, number = F.lit(PATTERNS[kind]), F.lit(KINDS.index(kind))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(
        F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), matches.alias("hit")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), keeps(kind, x["hit"]).alias("keep")),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        new = F.array(F.struct(begin.alias("start"), number.alias("kind"), end.alias("end")))
        return end, F.when(x["keep"], new).otherwise(none)

    none = F.array().cast(SPAN)
    return F.when(text.rlike(PATTERNS[kind]), common.running(lengths, F.lit(0), step, none)).otherwise(none)


def keeps(kind: str, hit: Column) -> Column:
    """Whether a match counts; the piece after the last gap has none. An assigned value needs six characters."""
    if kind == "assign":
        return hit.isNotNull() & (F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6)
    return hit.isNotNull()


def parts(documents: DataFrame) -> DataFrame:
    """doc_id, key (of the text), base and other: arrays of spans. A written table: patterns run once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    weak = F.concat(*[spans(F.col("text"), k) for k in WEAK])
    found = rows.select("doc_id", F.md5("text").alias("key"), F.concat(*[spans(F.col("text"), k) for k in STRONG]).alias("base"), weak.alias("weak"), F.when(F.size(weak) > 0, spans(F.col("text"), "break")).otherwise(F.array().cast(SPAN)).alias("breaks"))
    return common.written(found, "parts")


def linked(found: DataFrame, reach: int) -> DataFrame:
    """doc_id, key, extra: the weak spans whose complements lie in scope."""
    some = found.where("size(weak) > 0").dropDuplicates(["doc_id", "key"])
    each = some.select("doc_id", "key", F.explode(F.concat("base", "weak", "breaks")).alias("x")).select("doc_id", "key", "x.*")
    role = lambda *kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])
    doc = Window.partitionBy("doc_id", "key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    scoped = each.withColumn("scope", F.count_if(role("break")).over(doc)).where(~role("break"))
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("at"), F.lit(False).alias("opens")))
    events = scoped.withColumn("_e", F.explode(ends)).select("*", "_e.*").drop("_e")
    scope = Window.partitionBy("doc_id", "key", "scope")
    so_far = scope.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    before = scope.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    from_here = scope.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("opens"), ~F.col("opens")
    columns, chosen = [], []
    for name, kinds in (("id", ("id", "access")), ("secret", ("secret", "assign", "hex")), ("strong", STRONG)):
        mine = role(*kinds)
        columns += [
            F.max(F.when(mine & closes, F.col("at"))).over(so_far).alias(f"{name}_last"),  # the nearest end before, read where a candidate opens
            F.count_if(mine & closes).over(so_far).alias(f"{name}_closed"),
            F.min(F.when(mine & opens, F.col("at"))).over(from_here).alias(f"{name}_next"),  # the nearest begin behind, read where it closes
            F.count_if(mine & opens).over(before).alias(f"{name}_opened"),
        ]
        at_open, at_close = ((lambda c, side: F.max(F.when(side, F.col(c))))(c, side) for c, side in ((f"{name}_last", opens), (f"{name}_next", closes)))
        overlaps = F.max(F.when(closes, F.col(f"{name}_opened"))) - F.max(F.when(opens, F.col(f"{name}_closed")))
        chosen += [at_open.alias(f"{name}_last"), at_close.alias(f"{name}_next"), overlaps.alias(f"{name}_over")]
    spans = events.select("*", *columns).where(role(*WEAK)).groupBy("doc_id", "key", "scope", "start", "kind", "end").agg(*chosen)
    within = lambda gap: F.coalesce(gap <= reach, F.lit(False))
    apart = lambda n: within(F.col("start") - F.col(f"{n}_last")) | within(F.col(f"{n}_next") - F.col("end"))
    near = lambda n: apart(n) | (F.col(f"{n}_over") > 0)
    complete = F.when(role("id"), apart("secret")).when(role("secret"), apart("id")).otherwise(near("id") & near("secret"))
    kept = spans.where(complete & (role("endpoint") | (F.col("strong_over") == 0)))
    return kept.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def scan(documents: DataFrame, reach: int = 300) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end; kind counts in KINDS), sorted."""
    found = parts(documents)
    extra = linked(found, reach).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "extra")
    joined = found.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"))


def joined_text(array: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in STRONG], F.sha2(joined_text("base"), 256).alias("base_sha256"), joined_text("spans").alias("spans"))
