"""Small tables of laws, articles and letters, for Spark and as VALUES in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "laws": (
        "id string, ord int, name string, region string, kind string, category string, coverage string, has_document boolean, url string, source string, modified string, effective string, retrieved string, snapshot string, doc_sha256 string, doc_retrieved string, keywords array<string>",
        [
            ("A", 0, "建築法", "中央", "法律", "建築與設計", "full", False, "https://law.moj.gov.tw/LawClass/LawAll.aspx?pcode=D0070109", "法務部", "2022-05-11", "", "2026-09-30T01:02:03Z", "2026-09-28", None, None, ["建照", "結構"]),
            ("B", 1, "建築技術規則總則編", "中央", "命令", "建築與設計", "full", False, "https://law.moj.gov.tw/LawClass/LawAll.aspx?pcode=D0070114", "法務部", "", "9999-12-31", "", "", None, None, []),
            ("C", 2, "建築技術規則建築設計施工編", "中央", "命令", "建築與設計", "full", False, "https://law.moj.gov.tw/LawClass/LawSingle.aspx?pcode=D0070115&flno=1", "法務部", "", "", "", "", None, None, ["樓梯"]),
            ("D", 3, "臺北市建築管理自治條例", "臺北市", "自治條例", "建築與設計", "full", False, "https://laws.gov.taipei/Law/1?x=1", "臺北市法規", "2020-01-02", "2020-02-03", "2026-09-01", "", None, None, []),
            ("E", 4, "新北市都市更新作業要點", "新北市", "行政規則", "都市更新與危老", "link", False, "http://user@web.law.ntpc.gov.tw/Scripts/FLAWDAT0202.aspx?fcode=C1234567", "", "", "", "", "", None, None, []),
            ("F", 5, "臺北市防火設備手冊", "臺北市", "其他", "消防與公共安全", "link", True, "https://web.law.ntpc.gov.tw/Scripts/FLAWDAT0202.aspx?fcode=C1234567", "消防署", "", "", "", "", "ab", "2026-01-01", ["防火門"]),
        ],
    ),
    "articles": (
        "law_id string, ord int, no string, path array<string>, text string",
        [
            ("A", 0, "第1條", ["第一章 總則"], "為實施建築管理，特制定本法。"),
            ("A", 1, "第2條", ["第一章 總則"], "本法所稱建築物，為定著於土地上之構造物。"),
            ("A", 2, "第77條", ["第二章 使用", "第一節 維護"], "建築物應維護如下：\n一、構造安全。\n二、設備安全。"),
            ("A", 3, "第77-1條", ["第二章 使用", "第二節 其他"], "防火避難設施不符者，依第七十七條第一項第一款至第二款及本法第二條辦理。"),
            ("B", 0, "第1條", [], "本規則依建築法（以下簡稱本法）第七十七條規定訂定之。"),
            ("B", 1, "第2條", [], "本規則用詞，定義如下：\n一、居室：供居住之房間。\n二、防火門（以下簡稱門）：指能防火之門。"),
            ("B", 2, "第3條", [], "依建築法第一條至第七十七條之一辦理居室，並依同法第二條。"),
            ("C", 0, "第1條", ["第一編"], "依本法第二條。"),
            ("C", 1, "第2條", ["第一編"], "依建築法第七十七條第九款。"),
            ("D", 0, "第1條", [], "本自治條例依未知法第三條及第二條。"),
        ],
    ),
    "rulings": (
        "id string, title string, unit string, content string, publish_up string",
        [
            ("101", "關於室內裝修", "建築管理組", "內政部 84.3.5 台內營字第8412345號函\\n<p>依建築法第七十七條及第七十七條之一規定，停止適用。</p><a href=\"/f.pdf\">附件</a>", "2024-01-01T20:00:00Z"),
            ("102", "農舍疑義", "", "<div>請依建築法辦理，並依內政部第8412345號函。</div><img src=\"/i.png\" alt=\"圖\">", "2024-01-02T01:00:00Z"),
            ("103", "下水道用戶", "下水道工程處", "內政部 113年13月40日 營字第９８７６５４３２號令<table><tr><td>甲</td><td>建築法令彙編</td></tr></table>", ""),
            ("104", "空白", "", "<p> </p>", ""),
            ("105", "複本", "", "營建署 營字第98765432號函\n同文", ""),
        ],
    ),
    "relations": ("parent string, child string", [("A", "B"), ("B", "C"), ("A", "D"), ("X", "A")]),
    "cited": ("ruling string, cited string", [("101", "102"), ("101", "102"), ("102", "102"), ("103", "101"), ("103", "999")]),
    "referred": ("ruling string, law string", [("101", "A"), ("101", "A"), ("102", "C"), ("103", "F"), ("103", "X")]),
    "places": ("id string, x double, y double, degree long", [("l:A", 10.0, 20.0, 3), ("l:B", -30.0, 5.5, 2), ("l:C", 400.0, -12.0, 1)]),
    "outcomes": (
        "id string, status string, before_hash string, candidate_hash string, last_fetch string, attempted_at string, reason string",
        [
            ("A", "updated", "h1", "h2", "2026-09-30", "2026-10-01", ""), ("B", "retained", "h3", "h3", "", "", "timeout"), ("C", "retained", "h4", "h5", "", "", ""), ("D", "odd", "h6", "h6", "", "", ""),
            ("E", "unavailable", None, "h7", "", "", ""), ("F", "unchanged", "h8", "h8", "2026-01-01", "", ""), ("F", "unchanged", "h8", "h8", "2026-01-01", "", ""),
        ],
    ),
    "held_before": ("id string, hash string, source_hash string, retrieved string", [("A", "h1", "s1", ""), ("B", "h3", "s", ""), ("C", "h4", "s", ""), ("D", "h6", "s", ""), ("F", "h8", "s", ""), ("G", "h9", "s", "")]),
    "held_after": ("id string, hash string, source_hash string, retrieved string", [("A", "h2", "s2", "2026-09-30"), ("B", "h3", "s", ""), ("C", "h5", "s", ""), ("D", "h6", "s", ""), ("E", "h7", "s", ""), ("F", "h8", "s", "2026-02-02"), ("G", "h9", "s", "")]),
    "doc_pages": ("law_id string, page int, text string, search_text string", [("F", 1, "防 火\n門之檢查", None), ("F", 2, "其他", "防火門索引"), ("F", 3, "ＦＩＲＥ　門　及防火門設備之維護與檢查", None), ("E", 1, "都市更新", None)]),
    "sections": ("section_id string, title string, text string", [("s1", "總則", "本手冊說明防火門"), ("s2", "檢查", "每 年 一次"), ("s3", "附錄", "表")]),
    "anchors": ("section_id string, at int, id string, text string", [("s1", 0, None, "本手冊"), ("s1", 1, None, "說明防火門"), ("s1", 2, "防火門", "圖"), ("s2", 0, "x", "每年"), ("s2", 1, None, "一次")]),
    "screen": ("id string, x double, y double, z double, radius double, kind string, visible boolean", [("a", 0.0, 0.0, 5.0, 4.0, "law", True), ("b", 1.0, 0.0, 9.0, 4.0, "ruling", True), ("c", 0.5, 0.0, 99.0, 4.0, "law", False), ("d", 40.0, 0.0, 1.0, 2.0, "law", True), ("e", 46.0, 0.0, 2.0, 2.0, "ruling", True)]),
    "resources": ("ord int, title string, category string, region string", [(0, "中央查詢", "法規查詢", "中央"), (1, "臺北查詢", "法規查詢", "臺北市"), (2, "新北查詢", "法規查詢", "新北市"), (3, "函釋", "函釋", "中央")]),
    "jobs": ("ord int, site string, id string, name string", [(0, "臺北市", "1", "臺北市建築規則"), (1, "內政部", "2", "某要點"), (2, "桃園", "3", "桃園縣舊法"), (3, "臺北市", "1", "臺北市建築規則新版"), (4, "臺中", "4", "消費者保護要點")]),
    "evidence": ("id string, kind string, law string, article string, unit string, ruling string, content_hash string, source_hash string, observed_at string", [("e1", "article", "A", "第77條", "A/a:77/p:1/i:2", None, "0" * 64, "s", "2026"), ("e2", "ruling", None, None, None, "101", "1" * 64, None, None), ("e3", "document", "F", None, None, None, "2" * 64, None, None)]),
    "attachments": ("title string, url string", [("第 3-1 條補充圖例.PDF", "u1"), ("第 1 條補充圖例圖1-3-(8).JPG", "u2"), ("補充圖例總表", "u3"), ("完整條文.PDF", "u4"), ("第 3-1 條補充圖例.PDF", "u1")]),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def laws_and_articles(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both tables with the normalised columns that search and citations read."""
    laws = fixture(spark, "laws").select("*", normalize("name").alias("name_norm"), normalize("region").alias("region_norm"), F.lower("id").alias("id_norm"), F.col("keywords").alias("keywords_norm"))
    articles = fixture(spark, "articles").select("*", normalize("no").alias("no_norm"), F.regexp_replace(normalize("no"), "^第|[條點]$", "").alias("address"), normalize("text").alias("body_norm"))
    return laws, articles


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(literal, value))}]::VARCHAR[]" if not value or isinstance(value[0], str) else f"[{', '.join(map(literal, value))}]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


TYPES = {"string": "VARCHAR", "int": "INT", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def values(columns: str, rows: list[tuple]) -> str:
    """SELECT of the given rows with declared types (``a int, b string``)."""
    named = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    select = ", ".join(f'CAST("{n}" AS {TYPES[t]}) AS "{n}"' for n, t in named)
    return f"SELECT {select} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({', '.join(f'"{n}"' for n, _ in named)})"


def with_tables(sql: str, *names: str) -> str:
    """``sql`` over the named small tables."""
    return "WITH " + ", ".join(f"{n} AS ({values(*TABLES[n])})" for n in names) + " " + sql
