"""Secret scanning with corpus-wide ownership, in DataFrame functions only.

Method: candidate strings of every text are hashed, and the hashes are counted
over the distinct repositories and owners of the whole corpus. A value that many
repositories or owners hold is a copied example; one that few hold looks live. The
base kinds are reported whatever their ownership; the method adds spans of further
kinds whose values look live and that no base span overlaps.

Where the documents name no repository, every document (by its id) is one of its
own, so a value that one hot owner has copied into thousands of documents is an
example too. Positions are code points. They come from the lengths of what lies
between the matches, summed in order, so no text is walked in Python.

Defined cases: null text is empty; null owners are one owner, null repositories
one repository; repeated rows are reported one by one and count once; spans that
start together are ordered by kind; very long texts are scanned whole, in one
pass a pattern; values are told apart by 64-bit hashes; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: kind, pattern, group of the value, least code points of the value, is it base.
#: Patterns that end in an open class take the least length with them where that
#: finds the same spans; the assignment's match is consumed even if it is dropped.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, True),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    ("opaque", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32,}", 0, 32, False),
]
KEYWORDS = ["passw", "secret", "token", "apikey", "api_key"]
#: A value looks live if so many owners and so many repositories hold it at most.
MOST_OWNERS, MOST_REPOS = 2, 8
#: What a text has found where it can't have any match of a kind.
NOTHING = "array<struct<kind:int,gap:int,length:int,value_length:int,value_key:bigint,mixed:boolean>>"


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "assign":
        folded = F.lower(text)
        return F.coalesce(*(F.when(folded.contains(k), True) for k in KEYWORDS), F.lit(False))
    if kind == "access":
        return text.contains("AKIA")
    if kind == "pem":
        return text.contains("-----BEGIN ")
    if kind == "jwt":
        return text.contains(".eyJ")
    if kind == "hex":
        return text.rlike(r"[0-9a-f]{16}")
    return text.rlike(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32}")


def candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document row: row, the ``keep`` columns, and found: an array of
    (kind, gap, length, value_length, value_key, mixed), in order of position
    within a kind; gap is what lies before the match since the previous one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *(keep or []), text.alias("text"))
    t = F.col("text")

    def of_kind(number: int) -> Column:
        kind, pattern, group, _, _ = KINDS[number]
        zipped = F.arrays_zip(F.split(t, pattern).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("all"))

        def lean(z: Column) -> Column:
            value = F.regexp_extract(z["all"], pattern, group) if group else z["all"]
            return F.struct(
                F.lit(number).alias("kind"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["all"]).alias("length"), F.char_length(value).alias("value_length"),
                F.xxhash64(value).alias("value_key"), (value.rlike("[0-9].*[0-9]") & value.rlike("[A-Za-z].*[A-Za-z]")).alias("mixed"),
            )

        return F.when(_possible(kind, t), F.transform(zipped, lean)).otherwise(F.array().cast(NOTHING))

    found = [of_kind(n) for n in range(len(KINDS))]
    return rows.select("row", *(keep or []), F.concat(*found).alias("found"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, *,
    most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS,
) -> DataFrame:
    """One row per document row: id and spans, an array by start and kind of
    (start, rank, kind, end, base, n_owners, n_repos, live). live: few owners and
    few repositories hold the value."""
    scratch = Scratch(docs.sparkSession, "secrets")
    lean = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo")
    )
    held = scratch.save(candidates(lean, "text", ["id", "owner", "repo"]), "candidates")
    each = held.where(F.size("found") > 0).repartition("row").select("row", "owner", "repo", F.posexplode("found").alias("k", "m"))
    sofar = Window.partitionBy("row", "m.kind").orderBy("k")
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(sofar.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = each.where("m.length is not null").select("row", "owner", "repo", "m", end.alias("end"))
    least = F.element_at(F.array(*(F.lit(x[3]) for x in KINDS)), F.col("m.kind") + 1)
    base = F.col("m.kind") < sum(x[4] for x in KINDS)
    plain = F.lit(len(KINDS) - 1) != F.col("m.kind")
    valid = placed.where((F.col("m.value_length") >= least) & (plain | F.col("m.mixed"))).select(
        "row", "owner", "repo", F.col("m.kind").alias("rank"), (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.value_key").alias("value_key"), base.alias("base")
    )
    by_start = Window.partitionBy("row").orderBy("start", "rank")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    before = F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = F.col("base") | ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    spans = scratch.save(valid.select("*", free.alias("free")).where("free").drop("free"), "spans")
    # structs, since a null owner is one too; both counts are aggregated before they are shuffled by value
    holders = spans.groupBy("value_key").agg(F.count_distinct(F.struct("owner")).alias("n_owners"), F.count_distinct(F.struct("repo")).alias("n_repos"))
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    known = spans.join(holders, "value_key").where(F.col("base") | live)
    names = F.element_at(F.array(*(F.lit(x[0]) for x in KINDS)), F.col("rank") + 1)
    span = F.struct("start", "rank", names.alias("kind"), "end", "base", "n_owners", "n_repos", live.alias("live"))
    marks = known.select("row", F.lit(None).alias("id"), span.alias("span"), F.lit(False).alias("whole"))
    whole = held.select("row", "id", F.lit(None).alias("span"), F.lit(True).alias("whole"))
    grouped = whole.unionByName(marks).groupBy("row").agg(F.max(F.when(F.col("whole"), F.col("id"))).alias("id"), F.collect_list("span").alias("spans"))
    return grouped.select("id", F.array_sort("spans").alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
