"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings are leftmost non-overlapping matches of three patterns over whole texts:
``assign`` (a secret's name with its value of at least 8 characters), ``access`` (access
identifiers) and ``hex`` (long hexadecimal strings). Three weaker kinds are candidates only:
``id`` (upper-case identifiers with digits), ``value`` (opaque mixed strings) and
``endpoint`` (addresses). A candidate is reported when its complementary parts stand within
``scope`` characters in the same text: an ``id`` needs a secret (assign, hex or value), a
``value`` needs an identifier (access or id), an ``endpoint`` needs both. Candidates that
overlap a base finding are that finding and are not reported again.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk the
same matches, a running sum over their lengths gives every start. The interval join is an
equi-join on (text, block of ``scope`` characters), with each part listed in the blocks it
touches and each candidate in the blocks its scope touches; a block has room for few parts
of a kind, so no group grows with the data.

Defined cases: null and empty texts have no findings; null ids and repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankfold.llm.common import stage

# Fixed patterns of the base findings. Length floors that cannot move a match stand in the pattern; the
# assigned value's floor can (a short match still uses up its text), so it is checked after.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
# Weaker candidates.
WEAK_ID = r"\b[A-Z0-9]{16,40}\b"
WEAK_VALUE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>()]+"

KINDS = ("assign", "access", "hex", "id", "value", "endpoint")
PATTERNS = (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_VALUE, ENDPOINT)
BASE = 3
SCOPE = 200


def _counts(kind: int, match: Column, value: Column) -> Column:
    """Whether a match of the kind is a finding or candidate."""
    if kind == 0:
        return F.length(value) >= 8
    if kind == 3:
        return match.rlike("[0-9]") & match.rlike("[A-Z]")
    if kind == 4:
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _matches(text: Column, kind: int) -> Column:
    """Array of (kind, number, gap before, length, counts) of every match of the kind's pattern."""
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == 0 else whole
    parts = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), whole.alias("match"), value.alias("value"))
    rows = F.transform(parts, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("number"), F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"),
        _counts(kind, p["match"], p["value"]).alias("counts")))
    # The piece after the last match has no match.
    rows = F.filter(rows, lambda r: r["size"].isNotNull())
    seen = text.rlike(PATTERNS[kind])
    if kind == 1:
        seen = text.contains("AKIA") & seen
    elif kind == 5:
        seen = text.contains("://") & seen
    return F.when(seen, rows)


def all_matches(text: Column) -> Column:
    none = F.expr("cast(array() as array<struct<kind:int,number:int,gap:int,size:int,counts:boolean>>)")
    return F.concat(*[F.coalesce(_matches(text, k), none) for k in range(len(KINDS))])


def spans(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, m: a match or null) with every counting match's start and end, in code points."""
    found = rows.where("m is not null").select("uid", "m.*")
    run = Window.partitionBy("uid", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return (found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
            .where("counts").select("uid", "kind", "start", "end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``found`` whose complementary parts stand within ``scope`` characters."""
    def listed(df, before, after):
        blocks = F.sequence(F.floor(before / scope), F.floor(after / scope))
        return df.withColumn("block", F.explode(blocks))

    weak = listed(found.where(F.col("kind") >= BASE), F.col("start") - scope, F.col("end") + scope)
    part = listed(found, F.col("start"), F.col("end") - 1).select(
        "uid", "block", F.col("kind").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"))
    # A scope only ever holds parts of one text, and a block of a text has room for few of them.
    near = weak.join(part, ["uid", "block"]).where((F.col("from") - F.col("end") <= scope) & (F.col("start") - F.col("to") <= scope))
    overlap = (F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))
    base, apart = F.col("other") < BASE, ~overlap
    seen = near.groupBy("uid", "kind", "start", "end").agg(
        F.bool_or(overlap & base).alias("known"), F.bool_or(apart & F.col("other").isin(1, 3)).alias("identifier"),
        F.bool_or(apart & F.col("other").isin(0, 2, 4)).alias("secret"))
    needs = (F.when(F.col("kind") == 3, F.col("secret")).when(F.col("kind") == 4, F.col("identifier"))
             .otherwise(F.col("identifier") & F.col("secret")))
    return seen.where(~F.col("known") & needs).select("uid", "kind", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of base findings, digest of their spans, all reported spans."""
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", all_matches(F.col("text")).alias("all"))
    rows = stage(numbered.select("uid", "doc_id", F.explode_outer("all").alias("m")), "matches")
    found = spans(rows)
    reported = found.where(F.col("kind") < BASE).unionByName(linked(found, scope))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start"), F.col("end"))
    # A text's findings are put together in one row; their number is bounded by that text.
    per_text = reported.groupBy("uid").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.array_sort(F.collect_list(F.struct("start", "kind", told.alias("told")))).alias("all"))
    ids = rows.groupBy("uid").agg(F.first("doc_id").alias("doc_id"))
    out = ids.join(per_text, "uid", "left")
    listed = F.coalesce(F.col("all"), F.expr("cast(array() as array<struct<start:bigint,kind:int,told:string>>)"))
    base = F.filter(listed, lambda s: s["kind"] < BASE)
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(F.array_join(base["told"], ",").cast("binary"), 256).alias("base_sha256"), F.array_join(listed["told"], ",").alias("spans"))


def without_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` without the documents that hold a base finding or a linked credential.

    Only texts with no base finding but both a weak identifier and a weak value need the join; all
    others are decided where they are read. Every text is searched once: what is kept or open is written with its
    verdict, and both branches read that table.
    """
    names = docs.columns
    seen = docs.select(F.struct(*names).alias("row"), all_matches(F.col("text")).alias("m"))

    def holds(*kinds):
        return F.exists("m", lambda r: r["counts"] & r["kind"].isin(*kinds))

    state = F.when(holds(0, 1, 2), "found").when(holds(3) & holds(4), "open").otherwise("clean")
    ruled = seen.select("row", "m", state.alias("state"))
    # A document that goes leaves no text behind; matches are kept where the join needs them.
    ruled = stage(ruled.select("state", F.when(F.col("state") != "found", F.col("row")).alias("row"), F.when(F.col("state") == "open", F.col("m")).alias("m"),
                               F.when(F.col("state") == "open", F.monotonically_increasing_id()).alias("uid")), "ruled")
    clean, open_ = ruled.where("state = 'clean'").select("row.*"), ruled.where("state = 'open'")
    bad = linked(spans(open_.select("uid", F.explode("m").alias("m"))), scope).select("uid").distinct()
    return clean.unionByName(open_.join(bad, "uid", "left_anti").select("row.*"))
