"""The operators of this folder as queries over whole tables, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.llm.exact_dedup import exact_dedup
from tallywire.llm.filter_audit import filter_audit
from tallywire.llm.gear_dedup import repeated_spans
from tallywire.llm.hash_forest import nearest
from tallywire.llm.html_layout import page_texts
from tallywire.llm.merkle_log import merkle_manifest
from tallywire.llm.mixing import mix_sources
from tallywire.llm.packing import pack
from tallywire.llm.pitman_yor import language_scores
from tallywire.llm.pivot_index import top_products
from tallywire.llm.signature_join import near_duplicates
from tallywire.llm.toxicity import held_out, toxicity, toxicity_model
from tallywire.llm.url_rules import url_verdicts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity_model(docs, table(spark, folder, "labels"))
    return toxicity(docs, model).select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        "predicted",
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digest(pack(table(spark, folder, "documents"), tokenizer_path()))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_html_layout(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(table(spark, folder, "pages"))


def op5_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    def part(column):
        return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(7))

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(part("doc_id") == 2, F.lit(False))
    scores = language_scores(docs, part("doc_id") != 2)
    return scores.withColumn("held_out", held_out)


def op6_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=3, share=90)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op8_gear_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents"))


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = url_verdicts(table(spark, folder, "pages"), URL_RULES)
    return found.withColumn("tokens", F.array_join("tokens", " "))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_merkle_log(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.translate(F.col("text"), UPPER, UPPER.lower())
    proofs = merkle_manifest(
        docs,
        fields=[*others, F.col("text")],
        shown=[*others, tampered],
        show_if=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
    ).proofs()

    def as_hex(column):
        return F.lower(F.hex(column))

    return proofs.select(
        F.col("id").alias("doc_id"),
        *[as_hex(c).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(as_hex("path"), 256).alias("proof_sha256"),
        as_hex("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity,
        op2_packing,
        op3_hash_forest,
        op4_html_layout,
        op5_pitman_yor,
        op6_signature_join,
        op7_exact_dedup,
        op8_gear_dedup,
        op9_url_rules,
        op10_mixing,
        op11_filter_audit,
        op12_merkle_log,
        op13_pivot_index,
    ]
    return {f.__name__: f for f in found}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

OP6 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(
        string_split_regex({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1),
            lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (
    SELECT doc_id AS node, doc_id AS low FROM documents
    UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.low) AS component_id
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""


OP11 = """
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(
        string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
marks AS (
    SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic
    FROM labels GROUP BY doc_id),
fails AS (
    SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
        (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
        || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)
            THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f
    FROM docs d LEFT JOIN marks m ON m.doc_id = d.doc_id),
cells AS (
    SELECT part, f, count(*) AS docs, count(*) FILTER (WHERE good) AS good,
        count(*) FILTER (WHERE toxic) AS toxic
    FROM fails GROUP BY ALL),
orders AS (
    SELECT '' AS o UNION ALL
    SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)
    WHERE NOT contains(o, l)),
steps AS (
    SELECT o AS filter_order, s AS step, o[s:s] AS letter, o[1:s - 1] AS before
    FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
met AS (
    SELECT cells.*, steps.*, contains(f, letter) AS failing,
        before <> '' AND length(translate(f, before, '')) < length(f) AS gone
    FROM cells, steps),
sums AS (
    SELECT part, filter_order, CAST(step AS INT) AS step, letter,
        CAST(coalesce(sum(docs) FILTER (WHERE NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(docs) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(docs) FILTER (WHERE failing AND gone), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(docs) FILTER (WHERE f = letter), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
    FROM met GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums
"""


def _op12(levels: int = 7, crown: int = 3) -> str:
    """Trees of up to 8^levels leaves under a tree of up to 8^crown, level by level."""

    def stated(column):
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"

    def grown(name, levels):
        """Nodes of each level, and left and right of each node the others of its run."""
        for k in range(levels):
            yield f"""{name}_runs{k} AS (
                SELECT t, i, n,
                    coalesce(string_agg(d, '') OVER (run ORDER BY i ROWS BETWEEN
                        UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                    coalesce(string_agg(d, '') OVER (run ORDER BY i ROWS BETWEEN
                        1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{k} WHERE n > 1 WINDOW run AS (PARTITION BY t, i // 8))"""
            yield f"""{name}{k + 1} AS (
                SELECT t, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d
                FROM {name}{k} WHERE n > 1 GROUP BY t, i // 8, n
                UNION ALL SELECT * FROM {name}{k} WHERE n = 1)"""

    def climbed(name, levels, start, tree, place):
        """Proof and folded digest of each document after each level."""
        for k in range(levels):
            before = start if k == 0 else f"{name}_up{k - 1}"
            yield f"""{name}_up{k} AS (
                SELECT u.* REPLACE (
                    p || coalesce(l || r, '') AS p,
                    CASE WHEN n IS NULL THEN f ELSE sha256(l || f || r) END AS f)
                FROM {before} u LEFT JOIN {name}_runs{k} r
                ON r.t = u.{tree} AND r.i = u.{place} // {8**k})"""

    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    others = " || ".join(stated(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = """xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT],
            list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
            lambda x, j: xor(x >> 1, 3988292384 * (x & 1)))))"""
    parts = [
        f"""hashed AS (
            SELECT doc_id, coalesce('=' || lang, '') AS t, sha256({others} || {stated("text")}) AS d,
                CASE WHEN {crc} % 3 = 0 THEN sha256({others} || {stated(lowered)}) END AS shown
            FROM documents)""",
        """leaves AS (
            SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
                count(*) OVER (PARTITION BY t) AS n
            FROM hashed)""",
        "tree0 AS (SELECT t, i, n, d FROM leaves)",
        *grown("tree", levels),
        f"""crown0 AS (
            SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, d,
                t AS name
            FROM tree{levels})""",
        *[c.replace("SELECT * FROM crown0", "SELECT t, i, n, d FROM crown0")
          for c in grown("crown", crown)],
        """start AS (
            SELECT s.doc_id, s.d AS leaf, s.t, s.i, '' AS p, coalesce(s.shown, s.d) AS f,
                c.d AS subroot, '' AS top, c.i AS at
            FROM leaves s JOIN crown0 c ON c.name = s.t)""",
        *climbed("tree", levels, "start", "t", "i"),
        *climbed("crown", crown, f"tree_up{levels - 1}", "top", "at"),
    ]
    ctes = ",\n".join(parts)
    return f"""WITH {ctes}
        SELECT doc_id, leaf, subroot, root.d AS root, sha256(p) AS proof_sha256, f AS folded_root,
            f = root.d AS verified
        FROM crown_up{crown - 1}, crown{crown} root"""


OP13 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        AND len(c.v) = len(q.v))
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n
    FROM scores)
WHERE n <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_signature_join": OP6,
        "op7_exact_dedup": OP7,
        "op11_filter_audit": OP11,
        "op12_merkle_log": _op12(),
        "op13_pivot_index": OP13,
    }
