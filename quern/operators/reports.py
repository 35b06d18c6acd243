"""Sync reports, outcomes and candidates: what is wrong with them, and how they are shown."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.links import part
from quern.operators.filters import broken_rules

#: What a candidate is compared by, hosts of official sites, and marks of pages that were taken for text.
IDENTITY = ("id", "name", "region", "source", "url")
OFFICIAL_END, OFFICIAL_HOST = ".gov.tw", "laws.gov.taipei"
CONTAMINATION = ("<script", "ctl00_cp_content", "資訊安全政策")
#: Least share of the text that a candidate must keep.
KEPT = 0.8
#: Outcomes of a sync.
SUCCESS, RETAINED, UNAVAILABLE = ("updated", "unchanged"), ("retained", "not-attempted"), "unavailable"
OUTCOMES = {
    "updated": "本次來源已取得；資料已更新", "unchanged": "本次來源已取得；資料未變", "retained": "本次未能更新；保留原快照",
    "unavailable": "本次來源未取得；無可用快照", "not-attempted": "本次未重新擷取",
}


def compact(text: Column) -> Column:
    """Without white space, with 臺 for 台, for comparing lengths and numbers."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "台", "臺")


def article_facts(articles: DataFrame) -> DataFrame:
    """Per law: n, n_distinct numbers, n_empty, n_contaminated and the size of all text."""
    dirty = F.lit(False)
    for mark in CONTAMINATION:
        dirty = dirty | F.contains("text", F.lit(mark))
    return articles.groupBy("law_id").agg(
        F.count("*").alias("n"), F.count_distinct(compact(F.col("no"))).alias("n_distinct"), F.count_if((F.trim("no") == "") | (F.trim("text") == "")).alias("n_empty"),
        F.count_if(dirty).alias("n_contaminated"), F.sum(F.length(compact(F.col("text")))).alias("size"),
    )


def checked_candidates(new: DataFrame, new_articles: DataFrame, sources: DataFrame, old: DataFrame, old_articles: DataFrame) -> DataFrame:
    """Candidates with the rules they break: reasons (all) and reason (the first).

    ``new`` and ``old``: id, name, region, source, url, coverage, retrieved; articles:
    law_id, no, text; ``sources``: id, sha256, observed_at.
    """
    before = old.select("id", *[F.col(c).alias(f"old_{c}") for c in (*IDENTITY[1:], "coverage")], F.lit(True).alias("known"))
    facts = lambda a, p: article_facts(a).select(F.col("law_id").alias("id"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "n_distinct", "n_empty", "n_contaminated", "size")])
    gone = old_articles.select(F.col("law_id").alias("id"), compact(F.col("no")).alias("k")).join(new_articles.select(F.col("law_id").alias("id"), compact(F.col("no")).alias("k")), ["id", "k"], "left_anti").groupBy("id").agg(F.count("*").alias("n_gone"))
    rows = new.join(sources.select("id", "sha256", "observed_at"), "id", "left").join(before, "id", "left").join(facts(new_articles, "new"), "id", "left").join(facts(old_articles, "was"), "id", "left").join(gone, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    same = F.lit(True)
    for c in IDENTITY[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    known = F.coalesce("known", F.lit(False))
    host = F.coalesce(part(F.col("url"), "HOST"), F.lit(""))
    rules = [
        ("identity", (F.coalesce("id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")),
        ("changed-identity", ~known | same),
        ("unofficial-url", (part(F.col("url"), "PROTOCOL") == "https") & (F.endswith(host, F.lit(OFFICIAL_END)) | (host == OFFICIAL_HOST))),
        ("no-source-hash", F.coalesce("sha256", F.lit("")).rlike("^[0-9a-f]{64}$")),
        ("fetch-time", (F.coalesce("observed_at", F.lit("")) != "") & F.col("retrieved").eqNullSafe(F.col("observed_at"))),
        ("empty-full-text", (F.col("coverage") != "full") | (n("new_n") > 0)),
        ("duplicate-numbers", n("new_n_distinct") == n("new_n")),
        ("empty-article", n("new_n_empty") == 0),
        ("contaminated", n("new_n_contaminated") == 0),
        ("downgraded", ~(known & (F.col("old_coverage") == "full") & (F.col("coverage") != "full"))),
        ("lost-articles", ~known | (n("n_gone") == 0)),
        ("shrunk", ~known | (n("was_size") == 0) | (n("new_size") >= n("was_size") * KEPT)),
    ]
    return broken_rules(rows, rules).select("id", "reasons", "reason")


def failed_source(field: str, failure: Column) -> Column:
    who = F.coalesce(F.nullif(failure["name"], F.lit("")), F.nullif(failure["url"], F.lit("")), F.lit(field))
    return F.struct(F.lit("failed-source").alias("error"), F.concat(who, F.lit("："), F.coalesce(failure["reason"], F.lit("來源失敗"))).alias("detail"))


def report_errors(report: DataFrame, run_id: str | None = None, allow_partial: bool = False) -> DataFrame:
    """What is wrong with sync reports: run, error, detail.

    ``report``: run, run_id, status, fatal, and arrays missing_central (names) and
    local_failures, central_failures (name, url, reason); a null array is a missing field.
    With ``allow_partial`` missing laws and failed sources are no errors.
    """
    error = lambda test, name, detail=None: F.when(test, F.struct(F.lit(name).alias("error"), (detail if detail is not None else F.lit("")).alias("detail")))
    one = [error(~F.col("run_id").eqNullSafe(F.lit(run_id)), "other-run")] if run_id else []
    one += [error(~F.col("status").eqNullSafe(F.lit("complete")), "incomplete")]
    one += [error(F.col(c).isNull(), "missing-field", F.lit(c)) for c in ("missing_central", "local_failures", "checks")]
    one += [error(F.col("fatal").isNotNull(), "fatal", F.col("fatal"))]
    many = []
    if not allow_partial:
        many.append(F.transform(F.coalesce("missing_central", F.array().cast("array<string>")), lambda x: F.struct(F.lit("missing-law").alias("error"), x.alias("detail"))))
        for c in ("local_failures", "central_failures"):
            many.append(F.when(F.col(c).isNotNull(), F.transform(c, functools.partial(failed_source, c))).otherwise(F.array().cast("array<struct<error:string,detail:string>>")))
    every = F.concat(F.array_compact(F.array(*one)), *many)
    return report.select("run", F.explode(every).alias("e")).select("run", "e.*")


def outcome_errors(outcomes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcomes that don't fit what is held before and after: id, error.

    ``outcomes``: id, status, before_hash, candidate_hash, last_fetch, attempted_at;
    ``before`` and ``after``: id, hash, source_hash, retrieved. Laws without an outcome,
    and outcomes that share an id, are errors too.
    """
    rows = outcomes.withColumn("n_rows", F.count("*").over(Window.partitionBy("id"))).withColumn("told", F.lit(True))
    both = rows.join(before.select("id", F.col("hash").alias("b_hash"), F.col("source_hash").alias("b_source")), "id", "full_outer").join(after.select("id", F.col("hash").alias("a_hash"), F.col("source_hash").alias("a_source"), F.col("retrieved").alias("a_retrieved")), "id", "full_outer")
    status = F.col("status")
    kept = F.col("b_hash").isNotNull() & F.col("b_hash").eqNullSafe(F.col("a_hash")) & F.col("b_source").eqNullSafe(F.col("a_source"))
    tests = [
        ("uncovered", F.col("told").isNull()),
        ("duplicate", F.col("n_rows") > 1),
        ("invalid-status", F.col("told") & ~F.coalesce(status.isin(*SUCCESS, *RETAINED, UNAVAILABLE), F.lit(False))),
        ("hash-mismatch", F.col("told") & (~F.col("before_hash").eqNullSafe(F.col("b_hash")) | ~F.col("candidate_hash").eqNullSafe(F.col("a_hash")))),
        ("invented-fetch", F.col("told") & ~F.coalesce("last_fetch", F.lit("")).eqNullSafe(F.coalesce("a_retrieved", F.lit("")))),
        ("retained-changed", status.isin(*RETAINED) & ~kept),
        ("unavailable-present", (status == UNAVAILABLE) & (F.col("b_hash").isNotNull() | F.col("a_hash").isNotNull())),
        ("no-attempt", status.isin(*SUCCESS) & (F.coalesce("attempted_at", F.lit("")) == "")),
    ]
    errors = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))
    return both.select("id", F.explode(errors).alias("error")).distinct()


def version_rows(laws: DataFrame, outcomes: DataFrame, batch: str = "") -> DataFrame:
    """Label, value and place of each line of evidence about a law's version: id, at, label, value.

    ``laws``: id, source, modified, effective, retrieved, snapshot, doc_sha256, doc_retrieved (null
    without a document); ``outcomes``: id, status, attempted_at.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    told = F.lit(None).cast("string")
    for status, words in OUTCOMES.items():
        told = F.when(F.col("status") == status, F.lit(words)).otherwise(told)
    synced, held = F.col("status").isNotNull(), F.col("doc_sha256").isNotNull() | F.col("doc_retrieved").isNotNull()
    lines = [
        (F.lit(True), "官方來源", F.coalesce(text("source"), F.lit("未提供來源名稱"))),
        (F.lit(True), "來源所載修正日期", F.coalesce(text("modified"), F.lit("來源未列；尚待核對"))),
        (F.lit(True), "來源所載生效日期", F.when(F.startswith("effective", F.lit("9999")), "依官方生效說明").otherwise(F.coalesce(text("effective"), F.lit("未另列；請查條文與沿革")))),
        (F.lit(True), "資料所載擷取日期", F.coalesce(text("retrieved"), F.lit("未保存逐筆擷取日期"))),
        (F.lit(True), "本庫資料批次", F.coalesce(F.nullif(F.lit(batch), F.lit("")), text("snapshot"), F.lit("未提供批次日期"))),
        (~synced, "官方再次核對", F.lit("尚未載入逐筆官方再核對紀錄")),
        (synced, "本次同步結果", told),
        (synced, "本次擷取嘗試時間", F.coalesce(text("attempted_at"), F.lit("本次未嘗試擷取"))),
        (synced, "最近成功擷取日期", F.coalesce(text("retrieved"), F.lit("未保存成功擷取日期"))),
        (held, "原始文件擷取日期", F.coalesce(text("doc_retrieved"), F.lit("未保存"))),
        (held, "原始文件 SHA-256", F.coalesce(text("doc_sha256"), F.lit("未保存"))),
    ]
    rows = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(label).alias("label"), value.alias("value"))) for on, label, value in lines]))
    return laws.join(outcomes.select("id", "status", "attempted_at"), "id", "left").select("id", F.posexplode(rows).alias("at", "r")).select("id", "at", "r.label", "r.value")


def outcome_of(laws: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each law with the outcome of its last sync in words; null if it was in none."""
    told = F.lit(None).cast("string")
    for status, words in OUTCOMES.items():
        told = F.when(F.col("status") == status, F.lit(words)).otherwise(told)
    return laws.join(outcomes.select("id", "status", F.col("reason").alias("outcome_reason")), "id", "left").withColumn("outcome", told)


def holdings(laws: DataFrame) -> DataFrame:
    """Per region, and for all together (region null, level 0): laws with full text, articles of these, documents and mere links."""
    full, document = F.col("coverage") == "full", F.col("has_document")
    sums = [F.count_if(full).alias("n_full"), F.sum(F.coalesce("n_articles", F.lit(0))).cast("long").alias("n_articles"), F.count_if(document).alias("n_documents"), F.count_if((F.col("coverage") == "link") & ~document).alias("n_links")]
    return laws.rollup("region").agg((1 - F.grouping("region")).cast("int").alias("level"), *sums)


def targets_by_article(targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Targets of each citation by article: the number of distinct units and whether any could only be given as the article."""
    return targets.groupBy(*key, "article").agg(F.count_distinct(F.nullif("unit", F.lit(""))).alias("n_units"), F.bool_or("fallback").alias("fallback"))


def entries_of(casebooks: DataFrame) -> DataFrame:
    """How many folders and entries each stored casebook has: ``casebooks(id, folders array<struct<entries array>>)``."""
    return casebooks.select("id", F.size("folders").alias("n_folders"), F.aggregate("folders", F.lit(0), lambda n, f: n + F.size(f["entries"])).alias("n_entries"))


def evidence_version(evidence: DataFrame) -> DataFrame:
    """What tells whether saved evidence still holds: id, content_hash, source_hash, observed_at."""
    return evidence.select("id", "content_hash", "source_hash", "observed_at")


def summary_heads(rulings: DataFrame) -> DataFrame:
    """Rulings without their texts and attachments, marked as such."""
    return rulings.drop("body", "attachments").withColumn("body", F.lit("")).withColumn("summary_only", F.lit(True))


def slim_catalog(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """Laws with the number of their articles and none of their texts."""
    count = articles.groupBy(F.col("law_id").alias("id")).agg(F.count("*").alias("n_articles"))
    blank = [F.lit("").alias(c) for c in ("history", "note", "status", "preamble") if c in laws.columns]
    keep = [c for c in laws.columns if c not in ("history", "note", "status", "preamble")]
    return laws.join(count, "id", "left").select(*keep, *blank, F.coalesce("n_articles", F.lit(0)).cast("long").alias("n_articles"))


def attachment_articles(attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(title, url, article, format) of supplementary figures, and those whose title can't be read.

    Titles say 補充圖例 and give an article and a format; others are not meant here.
    """
    pattern = r"^第 (\d+(?:-\d+)?) 條補充圖例(?:圖[0-9()-]+)?\.(PDF|DOC|JPG)$"
    rows = attachments.where(F.contains("title", F.lit("補充圖例"))).select("title", "url", F.regexp_extract("title", pattern, 1).alias("article"), F.upper(F.regexp_extract("title", pattern, 2)).alias("format"))
    return rows.where("article <> ''").distinct(), rows.where("article = ''").select("title", "url")
