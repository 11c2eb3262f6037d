"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passbook.llm import alignment, bpe, licences, linededup, maxscore, mixing, neardup, spotsigs, suffix_dedup, tokenfile, toxicity, urlfilter, vectorcodes
from passbook.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose crc32 of the id is divisible by 5 are not trained on."""
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs.select("doc_id", "text"), weights).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


#: The rules of op2_url_filters: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the longest fitting rule on every page's url; allow where none fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability under raked source, language and topic weights, and whether it is kept."""
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "repeats", "kept")


def op4_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in a document where a licence rule is met."""
    return licences.scan(table(spark, sf_dir, "documents"), *licences.known_rules(spark))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles link at 0.85."""
    return neardup.clusters(table(spark, sf_dir, "documents"), neardup.Join(k=3, percent=85))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every document and of its edited text."""
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its class of equal fingerprints, and how many other classes are alike by 0.8 or more."""
    return spotsigs.near_classes(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to files with a perfect-hash index and read back."""
    path = tokenfile.write(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return tokenfile.summary(spark, path)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text and their decoding, as digests."""
    import public_tokenizers

    return bpe.encode_texts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True, keep=["doc_id"])


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in no string of 200 bytes that also starts elsewhere, as digests."""
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every fiftieth vector with all others."""
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose key at least 10 documents hold, as digests."""
    return linededup.cut_lines(table(spark, sf_dir, "documents"), linededup.Lines(documents=10, points=1, first=False), digest=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector in 4 parts of 256 entries after 4 Lloyd rounds."""
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every text's ids by two tokenizers, with counts of linked ids over the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_mixing, op4_licence_scans, op5_minhash_near_dedup, op6_document_fingerprints, op7_token_ids, op8_byte_bpe, op9_suffix_array_dedup, op10_top_k, op11_line_dedup, op12_vector_codes, op13_token_alignment, near_fingerprints)}


def _lloyd_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds as a chain of views: every part against every entry of its codebook."""
    steps = [
        """kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""cut AS MATERIALIZED (
            SELECT vec_id, label, i AS part, x[i * len(x) // {parts} + 1 : (i + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) AS r(i)
        )""",
        f"""book0 AS MATERIALIZED (
            SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM cut QUALIFY entry < {entries}
        )""",
    ]
    for k in range(rounds + 1):
        # the part's own square is the same for all entries
        steps.append(f"""near{k} AS MATERIALIZED (
            SELECT vec_id, cut.part, label, cut.x, arg_min(entry, (list_inner_product(b.x, b.x) - 2 * list_inner_product(cut.x, b.x), entry)) AS entry,
                min(list_inner_product(b.x, b.x) - 2 * list_inner_product(cut.x, b.x)) + list_inner_product(cut.x, cut.x) AS error
            FROM cut JOIN book{k} AS b ON cut.part = b.part GROUP BY vec_id, cut.part, label, cut.x
        )""")
        if k < rounds:
            steps.append(f"""sums{k} AS (
                SELECT part, entry, list(s ORDER BY j) AS x FROM (
                    SELECT part, entry, j, floor(sum(x[j]) / count(*)) AS s FROM near{k}, range(1, 1 + len(x)) AS r(j) GROUP BY part, entry, j
                ) GROUP BY part, entry
            ), book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.x, b.x) AS x FROM book{k} AS b LEFT JOIN sums{k} AS s USING (part, entry))""")
    return f"""
        WITH {", ".join(steps)}, coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
            FROM near{rounds} GROUP BY vec_id, label
        ), digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY part, entry)) AS d FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM coded, digest"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(str(r) for r in URL_RULES)
    return {
        "op2_url_filters": f"""
            WITH cut AS (
                SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
            ), parts AS (
                SELECT page_id,
                    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                FROM cut
            ), rules(rule_host, rule_path, verdict) AS (VALUES {rules}), fits AS (
                SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                    arg_max(verdict, length(rule_host || rule_path)) AS verdict
                FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
                GROUP BY page_id
            )
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
        "op10_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
                FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
        "op11_line_dedup": r"""
            WITH lines AS (
                SELECT doc_id, i, s[i] AS line, translate(regexp_replace(s[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), range(1, 1 + len(s)) AS r(i)
            ), common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
            FROM lines LEFT JOIN common AS c USING (key) GROUP BY doc_id""",
        "op12_vector_codes": _lloyd_sql(),
    }
