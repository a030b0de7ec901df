"""Commit history: lists, nesting and statistics over commits, their files and refs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.columns import iso_seconds, message_prefix, monday_week, name_matches, rename_paths, seconds, sunday_weekday

N_STATS = 20


def window_filter(since: str | None = None, until: str | None = None, author: str | None = None) -> Column:
    """From the start of `since` to the end of `until`; author within name or email. Invalid dates don't count."""
    out = F.lit(True)
    lo, hi = iso_seconds(since), iso_seconds(until, end_of_day=True)
    if lo is not None:
        out = out & (F.col("timestamp") >= lo)
    if hi is not None:
        out = out & (F.col("timestamp") <= hi)
    if author:
        out = out & (name_matches("author", author, "contains") | name_matches("author_email", author, "contains"))
    return out


def _total(c: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")


def cadence(commits: DataFrame, by: str = "day", limit: int = N_STATS, **when) -> DataFrame:
    """Commits per day, week or month; the oldest buckets come first and stay under the limit."""
    bucket = {"day": F.date_format(seconds("timestamp"), "yyyy-MM-dd"), "week": monday_week("timestamp"), "month": F.date_format(seconds("timestamp"), "yyyy-MM")}[by]
    return commits.where(window_filter(**when)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("commits")).orderBy("bucket").limit(min(limit, 200))


def sizes(commits: DataFrame, files: DataFrame, limit: int = N_STATS, **when) -> DataFrame:
    own = commits.where(window_filter(**when))
    per = files.groupBy(F.col("commit_sha").alias("sha")).agg(F.count("*").alias("n"), _total("insertions").alias("ins"), _total("deletions").alias("del"))
    out = own.join(per, "sha", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("sha", "timestamp", z("n").alias("files_changed"), z("ins").alias("insertions"), z("del").alias("deletions")).orderBy(F.desc("timestamp"), "sha").limit(min(limit, 200))


def _joined(commits: DataFrame, files: DataFrame, when: dict) -> DataFrame:
    return commits.where(window_filter(**when)).join(files, F.col("sha") == F.col("commit_sha"))


def churn_by_file(commits: DataFrame, files: DataFrame, limit: int = N_STATS, **when) -> DataFrame:
    ins, dele = _total("insertions"), _total("deletions")
    return (
        _joined(commits, files, when)
        .groupBy("file_path")
        .agg(F.countDistinct("sha").alias("commits"), ins.alias("insertions"), dele.alias("deletions"), (ins + dele).alias("churn"))
        .orderBy(F.desc("churn"), F.desc("commits"), "file_path")
        .limit(min(limit, 200))
    )


def author_stats(commits: DataFrame, files: DataFrame, limit: int = N_STATS, **when) -> DataFrame:
    """Per author and email. Files are summed for each commit first, so a commit counts once without a
    distinct count over the wide join."""
    per = files.groupBy(F.col("commit_sha").alias("sha")).agg(_total("insertions").alias("i"), _total("deletions").alias("d"))
    return (
        commits.where(window_filter(**when))
        .join(per, "sha", "left")
        .groupBy("author", "author_email")
        .agg(F.count("*").alias("commits"), _total("i").alias("insertions"), _total("d").alias("deletions"))
        .withColumn("churn", F.col("insertions") + F.col("deletions"))
        .orderBy(F.desc("commits"), F.desc("churn"), "author", "author_email")
        .limit(min(limit, 200))
    )


def message_prefixes(commits: DataFrame, limit: int = N_STATS, **when) -> DataFrame:
    return commits.where(window_filter(**when)).groupBy(message_prefix("message").alias("prefix")).agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "prefix").limit(min(limit, 200))


def schedule(commits: DataFrame, **when) -> DataFrame:
    """Commits by weekday (0 is Sunday) and hour, UTC."""
    return commits.where(window_filter(**when)).groupBy(sunday_weekday("timestamp").cast("int").alias("weekday"), F.hour(seconds("timestamp")).cast("int").alias("hour")).agg(F.count("*").alias("commits"))


def branch_activity(commits: DataFrame, refs: DataFrame, limit: int = N_STATS, **when) -> DataFrame:
    return (
        commits.where(window_filter(**when))
        .join(refs, F.col("sha") == F.col("commit_sha"))
        .groupBy("ref_name", "ref_type")
        .agg(F.countDistinct("sha").alias("commits"))
        .orderBy(F.desc("commits"), "ref_name", "ref_type")
        .limit(min(limit, 200))
    )


def by_sha(commits: DataFrame, sha: str) -> DataFrame:
    """The commit of a sha, else the only one that begins with it, else none."""
    near = commits.where(F.col("sha").startswith(sha))
    tally = near.agg(F.count("*").alias("_n"), F.max((F.col("sha") == sha).cast("int")).alias("_x"))
    return near.crossJoin(F.broadcast(tally)).where((F.col("sha") == sha) | ((F.col("_n") == 1) & (F.col("_x") == 0))).drop("_n", "_x")  # tally: one row


def recent(commits: DataFrame, limit: int = 20) -> DataFrame:
    return commits.orderBy(F.desc("timestamp"), "sha").limit(min(limit, 200))


def by_file(commits: DataFrame, files: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """Commits that touch a path, under its old or new name where a change renames it."""
    touched = files.where(F.array_contains(rename_paths("file_path"), path) | (F.col("file_path") == path)).select(F.col("commit_sha").alias("sha")).distinct()
    return recent(commits.join(touched, "sha", "left_semi"), limit)


def by_author(commits: DataFrame, author: str, limit: int = 20) -> DataFrame:
    return recent(commits.where(window_filter(author=author)), limit)


def by_ref(commits: DataFrame, refs: DataFrame, ref: str, limit: int = 20) -> DataFrame:
    """Commits of the ref of that name, or of those whose name holds it if none has it."""
    named = refs.where(F.col("ref_name") == ref)
    held = refs.where(name_matches("ref_name", ref, "contains"))
    exact = named.select(F.lit(1).alias("_x")).limit(1)
    chosen = named.unionByName(held.join(exact, F.lit(True), "left_anti"))
    return recent(commits.join(chosen.select(F.col("commit_sha").alias("sha")), "sha", "left_semi"), limit)


def commit_files(files: DataFrame, sha: str) -> DataFrame:
    return files.where(F.col("commit_sha") == sha).orderBy("file_path")


def commit_refs(refs: DataFrame, sha: str) -> DataFrame:
    return refs.where(F.col("commit_sha") == sha).orderBy("ref_type", "ref_name")


def with_details(commits: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """Commits with their files and refs as sorted arrays."""
    f = files.groupBy(F.col("commit_sha").alias("sha")).agg(F.array_sort(F.collect_list(F.struct("file_path", "change_type", "insertions", "deletions"))).alias("files"))
    r = refs.groupBy(F.col("commit_sha").alias("sha")).agg(F.array_sort(F.collect_list(F.struct("ref_name", "ref_type"))).alias("refs"))
    return commits.join(f, "sha", "left").join(r, "sha", "left").withColumns({"files": F.coalesce("files", F.array().cast(f.schema["files"].dataType)), "refs": F.coalesce("refs", F.array().cast(r.schema["refs"].dataType))})


def ownership(lines: DataFrame) -> DataFrame:
    """Of blamed lines (sha, author, author_email) each author's lines, share and distinct commits."""
    per = lines.groupBy("author", "author_email").agg(F.count("*").alias("lines"), F.countDistinct("sha").alias("commits"))
    total = per.agg(F.sum("lines").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select("author", "author_email", "lines", (F.col("lines") / F.col("_t")).alias("share"), "commits").orderBy(F.desc("lines"), "author")  # total: one row


def risk(commits: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """One row of recency, author and churn levels of a history, and the highest of them. Days are whole ones;
    blank authors are no authors; without commits all is unknown."""
    per = files.groupBy(F.col("commit_sha").alias("sha")).agg(F.sum(F.greatest(F.coalesce("insertions", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("deletions", F.lit(0)), F.lit(0))).alias("c"))
    named = F.when(F.trim("author", F.lit(" \t\r\n")) != "", F.col("author"))
    days = F.greatest(F.lit(0), F.floor((F.lit(now) - F.max("timestamp")) / 86400)).cast("long")
    one = commits.join(per, "sha", "left").agg(F.count("*").alias("commits"), F.countDistinct(named).alias("authors"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("churn"), F.when(F.count("timestamp") > 0, days).alias("days"))
    mean, spread = F.try_divide("churn", "commits"), F.try_divide("authors", "commits")
    level = lambda unknown, high, medium: F.when(unknown, 0).when(high, 3).when(medium, 2).otherwise(1)
    none = F.col("commits") == 0
    levels = {
        "recency": level(F.col("days").isNull(), F.col("days") <= 14, F.col("days") <= 60),
        "dispersion": level(none, (F.col("authors") >= 5) | (spread >= 0.6), (F.col("authors") >= 3) | (spread >= 0.35)),
        "churn_level": level(none, (F.col("churn") >= 500) | (mean >= 120), (F.col("churn") >= 150) | (mean >= 40)),
    }
    name = lambda c: F.element_at(F.array(*map(F.lit, ("unknown", "low", "medium", "high"))), c + 1)
    return one.select("commits", "authors", "churn", "days", *(name(v).alias(k) for k, v in levels.items()), name(F.greatest(*levels.values())).alias("overall"))
