"""Secrets by pattern, told apart by who owns them across the corpus. DataFrame functions only.

Candidates come from three patterns. The hash of each candidate's value is aggregated over the corpus by distinct
repositories and distinct owners. A value that more than ``MAX_OWNERS`` owners hold, or that is in more than
``MAX_REPOSITORIES`` repositories of however few owners, is a copied example. Of the rest, a value of enough different
characters looks live: ``MIN_DIFFERENT``, or three quarters of a shorter value that mixes letters and digits. What is
neither is weak. Live values add spans of their own kind.

Positions come without Python: splitting a text at its matches gives the gaps, and running sums over gaps and matches
give starts and ends, in code points. Only texts with a match are exploded, and a running sum is within one text.

Null texts are empty and have no spans; null repositories or owners count as one unnamed one. Null ids are ids like any
other. Repeated rows are rows of their own and own nothing twice. Very long texts are read whole: one match is one row, and a
running sum is as long as one text's matches. A value in a third of all rows is pre-aggregated per task before any shuffle.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.llm.common import staged

# The patterns of the contract. A run of hex digits or of AKIA's alphabet that is long enough is found by
# its length at once, as a shorter one hides nothing; an assignment is matched first and measured after.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
VALUE_GROUP = {"assign": 2, "access": 0, "hex": 0}
LEAST = {"assign": 6, "access": 20, "hex": 24}  # characters of a value
MAX_OWNERS = 2  # beyond, a value is a copied example
MAX_REPOSITORIES = 4  # the same, however few own them
MIN_DIFFERENT = 8  # different characters of a live value
SHORT_SHARE = 0.75  # of a shorter value's characters
KINDS = [*PATTERNS, "live"]


def _hits(kind: str) -> Column:
    pattern = F.lit(PATTERNS[kind])
    gaps = F.transform(F.split("text", PATTERNS[kind], -1), F.length)
    found = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    values = F.regexp_extract_all("text", pattern, F.lit(VALUE_GROUP[kind]))
    return F.when(F.col("text").rlike(PATTERNS[kind]), F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"),
        found.alias("width"), values.alias("value")))


def has_candidates(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in PATTERNS.values()))


def candidates(docs: DataFrame, id_col="doc_id", text_col="text", repository: Column | None = None,
               owner: Column | None = None) -> DataFrame:
    """A staged row per input row: row (unique), doc_id, text_hash, repository, owner, hits."""
    unnamed = F.lit("")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.lit("") if repository is None else repository, unnamed).alias("repository"),
        F.coalesce(F.lit("") if owner is None else owner, unnamed).alias("owner"))
    return staged(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "repository",
        "owner", F.array_compact(F.array(*[_hits(k) for k in PATTERNS])).alias("hits")), "candidates")


def spans(found: DataFrame) -> DataFrame:
    """A staged row per kept match: row, kind, start, end, value, value_start, value_hash, repository, owner."""
    each = found.filter(F.size("hits") > 0).select(
        "row", "doc_id", "text_hash", "repository", "owner", F.explode("hits").alias("h"))
    matches = each.select("row", "doc_id", "text_hash", "repository", "owner", F.col("h.kind").alias("kind"),
                          F.posexplode(F.arrays_zip("h.gap", "h.width", "h.value")).alias("i", "m"))
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("end", F.sum((F.col("m.gap") + F.col("m.width")).cast("long")).over(upto))
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in PATTERNS]), F.col("kind") + 1)
    return staged(placed.filter(F.length("m.value") >= least).select(
        "row", "doc_id", "text_hash", "repository", "owner", "kind", (F.col("end") - F.col("m.width")).alias("start"),
        "end", F.col("m.value").alias("value"), (F.col("end") - F.length("m.value")).alias("value_start"),
        F.sha2(F.col("m.value"), 256).alias("value_hash")), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_rows, n_repositories, n_owners over the whole corpus."""
    once = found.groupBy("value_hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("value_hash").agg(
        F.sum("n").alias("n_rows"), F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"))


def judged(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
           min_different: int = MIN_DIFFERENT) -> DataFrame:
    """The spans with their ownership and verdict: copied, live or weak."""
    different = F.size(F.array_distinct(F.split("value", "")))
    mixed = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    live = (different >= min_different) | (mixed & (different >= F.ceil(F.length("value") * SHORT_SHARE)))
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    verdict = F.when(copied, "copied").when(live, "live").otherwise("weak")
    return found.join(ownership(found), "value_hash").withColumn("verdict", verdict)


def _joined(kinds: Column) -> Column:
    """kind:start:end of sorted (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(kinds, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col="doc_id", text_col="text", repository: Column | None = None,
                   owner: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_repositories, most_owners.

    The last two are of the text's most widely held value, 0 without one.
    """
    rows = candidates(docs, id_col, text_col, repository, owner)
    base = F.struct("start", "kind", "end")
    live = F.when(F.col("verdict") == "live", F.struct(
        F.col("value_start").alias("start"), F.lit(KINDS.index("live")).alias("kind"), F.col("end").alias("end")))
    count = lambda condition: F.count(F.when(condition, 1))
    # One row's matches at a time: the lists are as long as one text's.
    per_row = judged(spans(rows)).groupBy("row").agg(
        *[count(F.col("kind") == KINDS.index(k)).alias(f"n_{k}") for k in PATTERNS],
        F.array_sort(F.collect_list(base)).alias("base"), F.array_distinct(F.collect_list(live)).alias("live"),
        count(F.col("verdict") == "live").alias("n_live"), count(F.col("verdict") == "copied").alias("n_copied"),
        F.max("n_repositories").alias("most_repositories"), F.max("n_owners").alias("most_owners"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = rows.select("row", "doc_id").join(per_row, "row", "left").withColumn("base", F.coalesce("base", empty))
    everything = F.array_sort(F.concat("base", F.coalesce("live", empty)))
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(everything).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "most_repositories", "most_owners")])


def redact_live(docs: DataFrame, id_col="doc_id", text_col="text", repository: Column | None = None,
                owner: Column | None = None, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with every occurrence of a live value in its own text replaced by ``mark``."""
    found = judged(spans(candidates(docs, id_col, text_col, repository, owner))).filter(F.col("verdict") == "live")
    values = found.groupBy("doc_id", "text_hash").agg(F.collect_set("value").alias("live_values"))
    # Longest first, so that a value within another is not cut out of it.
    longest = F.transform(F.array_sort(F.transform("live_values", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))),
                          lambda s: s["v"])
    marked = has_candidates(F.coalesce(F.col(text_col), F.lit("")))
    hits, rest = docs.filter(marked), docs.filter(~marked)
    wide = hits.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("key_id"),
                       F.xxhash64(F.col(text_col)).alias("key_hash"), F.col(text_col).alias("old"))
    joined = wide.join(values, F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_hash") == F.col("text_hash")),
                       "left")
    new = F.when(F.col("live_values").isNull(), F.col("old")).otherwise(
        F.aggregate(longest, F.col("old"), lambda t, v: F.replace(t, v, F.lit(mark))))
    done = joined.select(*[new.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
    return done.unionByName(rest)
