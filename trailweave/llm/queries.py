"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import balls, convtrie, langid, licenses, media, mixing, neardup, packing, quality, sharding, topk, toxicity, urlfilter
from trailweave.llm.shared import written


def tokenizer_path() -> str:
    """The vocabulary of the packing queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    sharded = sharding.shard_by_bytes(docs, shards=16)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), room=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    voters = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), voters).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), models).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_rejected")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")
    return mixing.mix_sized(sized).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = written(neardup.fingerprints(docs).drop("text"), "fingerprints")
    return neardup.near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(folder, F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = licenses.license_scan(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", "own_license", "license", "inherited_from")


def op10_netpbm_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(_table(spark, sf_dir, "conversations"))


def op13_toxicity_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_histogram_shards, op2_online_packing, op3_quality_neighbours, op4_uniform_threshold_topk, op5_kneser_ney_langid, op6_url_rules, op7_water_filling_mix, op8_simhash_trie, op9_license_inheritance, op10_netpbm_media, op11_ball_tree_clusters, op12_conversation_trie, op13_toxicity_factors, pipeline)}



def _rounds(n: int, last: str) -> str:
    """CTEs of ``n`` rounds of Lloyd's algorithm from table z0 (c, i, x) over v (vec_id, i, x), and of the assignment after them."""
    near = lambda z: f"SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((v.x - z.x) * (v.x - z.x))::BIGINT AS d FROM v JOIN {z} z ON v.i = z.i GROUP BY vec_id, c) GROUP BY vec_id"
    floor = "(s - ((s % n) + n) % n) // n"
    parts = []
    for r in range(n):
        parts.append(f"a{r} AS MATERIALIZED ({near(f'z{r}')})")
        parts.append(f"z{r + 1} AS MATERIALIZED (SELECT z.c, z.i, coalesce(m.x, z.x) AS x FROM z{r} z LEFT JOIN (SELECT c, i, ({floor})::BIGINT AS x FROM (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*) AS n FROM a{r} a JOIN v ON a.vec_id = v.vec_id GROUP BY a.c, v.i)) m ON m.c = z.c AND m.i = z.i)")
    return ", ".join([*parts, f"{last} AS MATERIALIZED ({near(f'z{n}')})"])


_OWN = "|".join(r.literals[0] for r in urlfilter.OWN_RULES)

ORACLES = {
    "op4_uniform_threshold_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_url_rules": rf"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
        cut AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
        judged AS (
            SELECT page_id, host, path,
                   (SELECT max_by(rule, length(rule)) FROM cut WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule FROM parts)
        SELECT page_id, host, path, j.rule AS rule,
               CASE WHEN r.verdict IS NOT NULL THEN r.verdict
                    WHEN regexp_matches(host || path, '^([^/]*[.-])?({_OWN})([.-][^/]*)?(/.*)?$', 's') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged j LEFT JOIN rules r ON j.rule = r.rule""",
    "op7_water_filling_mix": r"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k FROM documents),
        sums AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
        whole AS (SELECT CAST(sum(s) AS DOUBLE) AS total FROM sums),
        breaks AS (
            SELECT *, coalesce(sum(3 * s) OVER (ORDER BY s * 1.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                   coalesce(sum(w) OVER (ORDER BY s * 1.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
                   sum(w) OVER () AS all_w FROM sums),
        rate AS (SELECT arg_min({'rest': total - capped, 'w': all_w - gone}, place) AS r
                 FROM (SELECT *, row_number() OVER (ORDER BY s * 1.0 / w, source NULLS LAST) AS place FROM breaks), whole
                 WHERE (total - capped) * w / (all_w - gone) <= 3 * s),
        targets AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), coalesce(r.rest * w / r.w, 0)) AS t FROM sums, rate),
        goals AS (SELECT source, s, t, CAST(floor(t + 0.5) AS BIGINT) AS g FROM targets),
        plan AS (SELECT source, s, t, CASE WHEN s > 0 THEN least(3, g // s) ELSE 0 END AS n, least(g, 3 * s) AS g FROM goals),
        placed AS (SELECT d.*, s, t, n, g - n * s AS more, sum(size) OVER (PARTITION BY d.source ORDER BY k) AS upto
                   FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, s AS source_size, t AS target,
               CAST(n * size + greatest(0, least(size, more - (upto - size))) AS BIGINT) AS taken FROM placed""",
    "op11_ball_tree_clusters": f"""
        WITH kept AS (
            SELECT vec_id, embedding AS e FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        v AS MATERIALIZED (SELECT vec_id, i, floor(1024 * CAST(e[i] AS DOUBLE))::BIGINT AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM kept)),
        drawn AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 8),
        z0 AS MATERIALIZED (SELECT c, i, x FROM drawn JOIN v USING (vec_id)), {_rounds(10, "own")},
        digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM z10 GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM own JOIN digests USING (c)""",
    "op12_conversation_trie": """
        WITH turned AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS e,
                   list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                       lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))) AS crc
            FROM turned GROUP BY conv_id),
        rebuilt AS (
            SELECT a.conv_id, list_concat(coalesce(b.e[:h], []), a.e[h + 1:]) AS e
            FROM (SELECT *, xor(crc, 4294967295::BIGINT) % 6 AS h FROM own) a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
        prefixes AS MATERIALIZED (SELECT conv_id, d, e[:d] AS p, len(e) AS size FROM (SELECT conv_id, e, unnest(range(0, len(e) + 1)) AS d FROM rebuilt)),
        nodes AS MATERIALIZED (
            SELECT p, d, min(conv_id) AS least, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends,
                   (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS saved FROM prefixes GROUP BY p, d),
        kids AS (SELECT p[:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        named AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.p = k.p),
        below AS (SELECT p[:u] AS p, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM named) GROUP BY 1)
        SELECT a.least AS conv_id, a.d AS depth, u.least AS parent_conv_id, a.n AS n_convs, a.n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
        FROM named a JOIN below b ON a.p = b.p LEFT JOIN nodes u ON a.d > 0 AND u.p = a.p[:a.d - 1]""",
}
