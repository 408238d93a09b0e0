"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the three base kinds (assignments, access keys, hex runs) and long mixed runs of key characters. The
hashes of their values are aggregated over the corpus by distinct repositories and owners: a value that many owners
have, or that stands in very many repositories whoever owns them, is a copied example; one of few owners and not so many
repositories is a live-looking credential of theirs. Base spans always stay; mixed runs outside them are added if they are
owner-specific.

Positions come from the pieces between matches. For each kind a text is tested, and if it holds a match, matched and split by the
same pattern; only the matches travel. Values are counted by (value, repository, owner) before they are counted by value, and hot values are
broadcast instead of shuffled to one task.

Nulls: a null text is empty; a null repository or owner is one of its own. Repeated rows are results of their own. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import lookup, written

#: Fixed patterns of the base kinds; letters of the keyword in either case.
KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
#: A mixed run: long enough, with letters and digits and many different characters.
RUN, LEAST_DISTINCT = "[A-Za-z0-9+/_=-]{20,}", 10
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owner": RUN}
#: A value of at most so many owners, in at most so many repositories, is theirs; of more, a copied example.
MOST_OWNERS, MOST_REPOS = 2, 20


def _matches(text: Column, rank: int, pattern: str) -> Column:
    """Structs (rank, i, gap, hit): gap is the length of the piece before the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.transform(hits, lambda h, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.get(gaps, i).alias("gap"), h.alias("hit")))
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,hit:string>>"))


def found(docs: DataFrame, repo: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): all rows as (rid, doc_id), and their candidates as (rid, repo, owner, rank, start, end, value)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), text.alias("text"))
    parts = [_matches(F.col("text"), k, p) for k, p in enumerate(KINDS.values())]
    scanned = written(rows.select("rid", "doc_id", "repo", "owner", F.concat(*parts).alias("m")), "matches")
    own = Window.partitionBy("rid", "rank").orderBy("i")
    flat = scanned.select("rid", "repo", "owner", F.explode("m").alias("m")).select("rid", "repo", "owner", "m.*")
    stop = F.sum(F.col("gap").cast("long") + F.length("hit")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("rank") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    placed = flat.select("rid", "repo", "owner", "rank", (stop - F.length("hit")).alias("start"), stop.alias("end"), value.alias("value"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= LEAST_DISTINCT)
    placed = placed.where(((F.col("rank") == 0) & (F.length("value") >= LEAST_ASSIGNED)) | F.col("rank").isin(1, 2) | ((F.col("rank") == 3) & mixed))
    # a run that touches a base span adds nothing
    there = Window.partitionBy("rid").orderBy("start", "rank")
    base = F.col("rank") < 3
    before = F.max(F.when(base, F.col("end"))).over(there.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(there.rowsBetween(0, Window.unboundedFollowing))
    spans = placed.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return scanned.select("rid", "doc_id"), written(spans.where(base | free).drop("before", "after"), "candidates")


def ownership(spans: DataFrame) -> DataFrame:
    """(key, n, repos, owners) of each value's hash."""
    keyed = spans.select(F.unhex(F.sha2("value", 256)).alias("key"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    pairs = keyed.groupBy("key", "repo", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("key").agg(F.sum("n").alias("n"), F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))


def scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """doc_id and `found`: structs (start, rank, end, repos, owners, live) in order, of every row."""
    repo, owner = repo if repo is not None else F.col("source"), owner if owner is not None else F.col("source")
    rows, spans = found(docs, repo, owner)
    seen = written(ownership(spans), "ownership")
    named = lookup(spans.withColumn("key", F.unhex(F.sha2("value", 256))), seen, "key", "n", spans.count())
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    kept = named.where((F.col("rank") < 3) | live)
    each = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "repos", "owners", live.alias("live")))).alias("found"))
    none = F.array().cast(each.schema["found"].dataType)
    return rows.join(each, "rid", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def listing(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")
