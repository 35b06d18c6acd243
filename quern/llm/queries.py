"""The operators' queries over the whole corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import clustering, collocations, decontaminate, fingerprint, language, mixing, near_dedup, packing, quality, secrets, sharding, token_files, toxicity
from quern.llm.labelled import fold, sampled
from quern.llm.store import pick

TOKENIZER = "byte_bpe_50k.json"
#: Bounds of the samples that models are fitted on: rows of each label, and characters of a text.
PER_LABEL, MAX_CHARS = 3000, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles here, as the query's contract asks; the operator's own default is five."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, threshold=0.8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    learn = fold(F.col("doc_id"), 5) != 0
    return quality.fit(sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", learn, PER_LABEL, MAX_CHARS))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scored(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), quality_model(spark, sf_dir))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = fold(F.col("doc_id"), 4) != 2
    model = language.fit(sampled(docs, docs, "lang", learn, 400, MAX_CHARS))
    rows = language.identified(pick(docs, "doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of the five-word shingles of a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)
    docs = token_files.read_token_files(spark, folder)
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(secrets.of_kinds(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = F.sha2(secrets.joined(secrets.of_kinds(F.col("spans"), *secrets.BASE_KINDS)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = fold(F.col("doc_id"), 3) != 1
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(sampled(docs, table(spark, sf_dir, "labels"), "toxic", learn, PER_LABEL * 2 // 3, MAX_CHARS))
    rows = toxicity.scored(pick(docs, "doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), least=30, max_n=4, within=80, first=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_packing, op3_quality, op4_language, op5_decontamination, op6_token_files, op7_sharding, op8_secrets, op9_fingerprints, op10_toxicity, op11_mixing, op12_collocations, op13_clustering)}

#: Words of a text as both queries below cut them, for DuckDB.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

def _clusters_sql(k: int, rounds: int) -> str:
    """A chain of assignments and means, all distances calculated."""
    nearest = """a{i} AS MATERIALIZED (SELECT vec_id, q, id, min((list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c)) AS best FROM v, m{i} GROUP BY vec_id, q, id)"""
    mean = """s{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY c, j),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY c),
m{next} AS MATERIALIZED (SELECT c, coalesce(n{i}.m, m{i}.m) AS m FROM m{i} LEFT JOIN n{i} USING (c))"""
    steps = [step.format(i=i, next=i + 1) for i in range(rounds) for step in (nearest, mean)] + [nearest.format(i=rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, row_number() OVER () AS id FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q AS m FROM v QUALIFY c < {k}),
{(","+chr(10)).join(steps)},
z AS (SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM z JOIN m{rounds} ON m{rounds}.c = z.cluster"""


ORACLES: dict[str, str] = {
    "op1_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, p.n_shingles, q.n_shingles HAVING 100 * count(*) >= 80 * (p.n_shingles + q.n_shingles - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
t AS (SELECT item_id, least(5, len(w)) AS g, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i+least(5, len(w))-1], ' ')))) AS x FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT g FROM t),
h AS (SELECT DISTINCT doc_id, g.g, unnest(list_transform(range(1, len(w) - g.g + 2), lambda i: array_to_string(w[i:i+g.g-1], ' '))) AS x FROM d, g),
n AS (SELECT item_id, count(*) AS item_shingles FROM t GROUP BY item_id)
SELECT h.doc_id, t.item_id, n.item_shingles, count(*) AS shared, count(*) / n.item_shingles AS containment
FROM h JOIN t ON h.g = t.g AND h.x = t.x JOIN n ON n.item_id = t.item_id
GROUP BY h.doc_id, t.item_id, n.item_shingles HAVING count(*) * 100 >= n.item_shingles * 80""",
    "op11_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s),
o AS (SELECT *, cap / weight AS ratio, (total * 3 / 2 - coalesce(sum(cap) OVER b, 0)::BIGINT) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE weight * min(CASE WHEN ratio > level THEN (ratio, place, level) END) OVER ()[3] END AS target,
      greatest(1, least(64, total // 65536)) AS block, (6 * total + 2 * greatest(1, least(64, total // 65536))) // (4 * greatest(1, least(64, total // 65536))) AS seats FROM o),
q AS (SELECT place, count(*) AS quota FROM (SELECT place, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, place, j) AS pos, seats
      FROM (SELECT place, target, seats, unnest(range(1, floor(target / block)::BIGINT + 12)) AS j FROM t WHERE target > 0)) WHERE pos <= seats GROUP BY place),
p AS (SELECT d.*, t.place, t.source_size, t.target, t.block, coalesce(q.quota, 0) AS quota, ('0x' || key[1:8])::BIGINT % (t.source_size // 1048576 + 1) AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (place)),
c AS (SELECT place, shard, sum(size)::BIGINT AS cell, any_value(quota) AS seats, any_value(block) AS block FROM p GROUP BY place, shard HAVING sum(size) > 0),
v AS (SELECT place, shard, count(*) AS quota FROM (SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY cell / (2 * j - 1) DESC, shard, j) AS pos
      FROM (SELECT *, unnest(range(1, seats + 1)) AS j FROM c)) WHERE pos <= seats GROUP BY place, shard),
m AS (SELECT c.*, least(coalesce(v.quota, 0) * block, 2 * cell) AS words FROM c LEFT JOIN v USING (place, shard)),
k AS (SELECT place, shard, words // cell AS passes, words % cell AS rest, k, k * block AS pos, least(block, cell - k * block) AS length, block FROM (SELECT *, unnest(range(0, (cell - 1) // block + 1)) AS k FROM m)),
x AS (SELECT *, greatest(0, least(length, rest - coalesce(sum(length) OVER (PARTITION BY place, shard ORDER BY md5('11:' || place || ':' || shard || ':' || k), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS extra FROM k),
y AS (SELECT *, sum(extra) OVER (PARTITION BY place, shard ORDER BY k) - extra AS before FROM x),
r AS (SELECT p.*, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p),
e AS (SELECT r.*, a.passes, a.before + least(r.start - a.pos, a.extra) AS first, b.before + least(r.start + size - b.pos, b.extra) AS last
      FROM r LEFT JOIN y a ON a.place = r.place AND a.shard = r.shard AND a.k = r.start // r.block LEFT JOIN y b ON b.place = r.place AND b.shard = r.shard AND b.k = (r.start + r.size - 1) // r.block AND r.size > 0)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE passes * size + last - first END::BIGINT AS taken, source, shard, start, coalesce(passes, 0) AS copies FROM e""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (SELECT c.lang, c.m, c.phrase, c.a, min((2000000::HUGEINT * c.a // (l.a + r.a), c.k, l.a, r.a)) AS cut FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y GROUP BY ALL),
v AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN f ON f.lang = s.lang AND f.m > s.m AND 100::HUGEINT * f.a >= 80 * s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ')),
k AS (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY cut[1] DESC, a DESC, phrase) AS rank FROM s ANTI JOIN v USING (lang, phrase))
SELECT lang, rank, phrase, a, cut[3] AS l, cut[4] AS r, n, cut[1]::BIGINT AS score FROM k JOIN t USING (lang) WHERE rank <= 2000""",
    "op13_clustering": _clusters_sql(40, 5),
}
