"""The queries of this subpackage and their SQL; ``__spark_entry__`` adds them where it is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, ctw, licenses, mixing, packing, parsing, quality, secrets, simhash, substrings, topk, toxicity, trie
from .common import importable, materialize

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


SQL["op1_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return ctw.score(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"),
    )


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_parse_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.against_edits(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join(F.transform("sentences", lambda x: F.concat_ws(":", x.position, x.id)), ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"), F.size("sentences").cast("long").alias("n_sentences"),
    )


SQL["op5_license_scan"] = licenses.duckdb_sql()


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold != 0))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence"
    )


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents")).drop("row")


#: Domains of the mixing query, and the wanted shares of tokens.
TARGETS = {"clean_high": 0.55, "clean_low": 0.40, "toxic": 0.05}


def domain_labels(labels: DataFrame) -> DataFrame:
    clean = F.when(F.col("quality") == 1, "clean_high").when(F.col("quality") == 0, "clean_low")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, clean).alias("domain"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    weights, prior = mixing.fit(docs, domain_labels(labels), list(targets))
    members = materialize(mixing.posteriors(docs, weights, prior), "posteriors")
    return mixing.rates(members, targets)


def op10_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _spans(kinds: tuple[str, ...] | None = None):
    chosen = F.filter("spans", lambda s: s.kind.isin(*kinds)) if kinds else F.col("spans")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(_spans(("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        _spans().alias("spans"), count("entropy"),
    )


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())
    stored = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(stored, ["doc_id", "start", "ids_crc32", "doc_tokens"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold != 1))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(fold == 1, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


# CRC-32 by a table of 256 remainders; a node is the list of its turns, and its subtree all nodes that begin with it.
SQL["op12_prefix_trie"] = """
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(0, 256) r(i)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns FROM turns GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
         lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, crc
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), members AS (
  SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2
), told AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children FROM nodes n
), valued AS (
  SELECT *, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].t) END AS saved FROM told
), up AS (
  SELECT path[1:d] AS path, d AS depth, leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued)
), sums AS (SELECT path, depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY path, depth)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.depth = v.depth AND s.path = v.path
LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


def _codes_sql(entries: int = 256, rounds: int = 4, parts: int = 4) -> str:
    """Lloyd's rounds with all distances: ``b<t>`` are the codebooks of a round, ``a<t>`` the nearest entries."""
    steps = [f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR abs(x) >= {codes.LIMIT // codes.SCALE})) = 0
), numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r FROM v WHERE len(e) = (SELECT len(e) FROM v ORDER BY vec_id NULLS LAST, e LIMIT 1)
), x AS (SELECT r, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM numbered, range(0, {parts}) q(p)
), b0 AS (SELECT p, r - 1 AS c, x AS y FROM x WHERE r <= {entries})"""]
    distance = "CAST(list_dot_product(x::DOUBLE[], x::DOUBLE[]) - 2 * list_dot_product(x::DOUBLE[], y::DOUBLE[]) + list_dot_product(y::DOUBLE[], y::DOUBLE[]) AS BIGINT)"
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, p, min({{'d': {distance}, 'c': c}}) AS best FROM x JOIN b{t} USING (p) GROUP BY r, p)")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT p, best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM x JOIN a{t} USING (r, p), range(1, 4096) g(i) WHERE i <= len(x) GROUP BY ALL),
m{t} AS (SELECT p, c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{t} GROUP BY p, c),
b{t + 1} AS MATERIALIZED (SELECT p, c, coalesce(m, y) AS y FROM b{t} LEFT JOIN m{t} USING (p, c))""")
    steps.append(f"""digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', best.c), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN numbered USING (r), digest""")
    return ",\n".join(steps)


SQL["op13_vector_codes"] = _codes_sql()


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k, op2_context_tree, op3_simhash_groups, op4_parse_fingerprints, op5_license_scan, op6_secret_scan, op7_toxicity, op8_pack_windows, op9_repeated_passages,
        op10_mixing_rates, op11_quality, op12_prefix_trie, op13_vector_codes,
    )
}
