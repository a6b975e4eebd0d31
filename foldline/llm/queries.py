"""The registered queries of the corpus operators; ORACLE_SQL has the SQL twin where SQL can express one."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm import (
    best_fit_packing,
    deleted_interpolation,
    heap_bpe,
    hilbert_neighbours,
    host_reputation,
    language_codes,
    line_dedup,
    merkle_manifest,
    pii_spans,
    simhash_dedup,
    source_divergence,
    template_decontamination,
    toxicity,
)
from foldline.llm.common import ascii_lower, crc_remainder, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


#: Fixed rules of the query's contract.
URL_RULES = "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)"


@query(
    """WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM r),
    o AS (SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
    h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(regexp_replace(host, ':\\d*$', ''), '.') AS l FROM p LEFT JOIN o USING (page_id) GROUP BY host),
    h1 AS (SELECT *, CASE WHEN len(l) >= 2 AND array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN 2 ELSE 1 END AS k FROM h0),
    h AS (SELECT host, n, bad, array_to_string(list_slice(l, greatest(len(l) - k + 1, 1), len(l)), '.') AS suffix, array_to_string(list_slice(l, greatest(len(l) - k, 1), len(l)), '.') AS domain FROM h1),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS prior FROM h GROUP BY 1),
    s1 AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS k FROM s0 WHERE n > 0),
    s AS (SELECT suffix, (prior * k + bad) / (k + n) AS prior FROM s0, s1),
    d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM h JOIN s USING (suffix) GROUP BY suffix, domain),
    d1 AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS k FROM d0 WHERE n > 0),
    d AS (SELECT domain, (prior * k + bad) / (k + n) AS prior FROM d0, d1),
    g0 AS (SELECT host, h.domain, n, bad, prior FROM h JOIN d USING (domain)),
    g1 AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS k FROM g0 WHERE n > 0),
    g2 AS (SELECT host, domain, n, (prior * k + bad) / (k + n) AS m, k + n AS mass FROM g0, g1),
    g AS (SELECT host, domain, n, m, m - 1.645 * sqrt(m * (1 - m) / (mass + 1)) AS low FROM g2),
    rules(rh, rp, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    u AS (SELECT DISTINCT host, path FROM p),
    f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(says, length(rh || rp)) AS says FROM u, rules WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2)
    SELECT page_id, p.host AS host, p.path AS path, rule, coalesce(says, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, domain, n::BIGINT AS n, round(m, 6) AS bad_rate, round(low, 6) AS bad_rate_low
    FROM p JOIN g USING (host) LEFT JOIN f ON f.host = p.host AND f.path = p.path"""
)
def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the quality label of its id (0 is bad)."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, spark.sql(URL_RULES))


@query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "cut_runs")


@query()
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")


#: Token id that ends a document.
END_ID = 1
DIGEST = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def word_bpe(cache_bytes: int = 240 << 20):
    import public_tokenizers

    return best_fit_packing.word_bpe_encoder(public_tokenizers.path("word_bpe_49k.json"), cache_bytes)


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing.pack(table(spark, sf_dir, "documents"), word_bpe(), END_ID, digest=lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    return packed.withColumnRenamed("digest", "ids_crc32").select(*DIGEST)


def _held_out(modulus: int, remainder: int):
    return F.coalesce(crc_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False)).alias("held_out")


@query()
def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "kind", F.round("coverage", 6).alias("coverage"), "windows", "at").distinct()


#: Score from which a document counts as toxic.
TOXIC_SCORE = 0.7


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


#: Remainder of crc32(doc_id) mod 7 of the training texts that are set aside for the mixture weights.
ASIDE = 4


@query()
def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_remainder(F.col("doc_id"), 7)
    scored = deleted_interpolation.score(table(spark, sf_dir, "documents"), F.coalesce(part != 2, F.lit(False)), F.coalesce(part == ASIDE, F.lit(False)))
    return scored.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return hilbert_neighbours.nearest(vectors, vectors.filter("id % 20 = 0").select("id"))


@query()
def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_spans.mark(docs, pii_spans.fit(docs), ["doc_id"])

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii_spans.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query()
def op10_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_codes.predict(docs, language_codes.fit(docs), ["doc_id"])
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score", "ambiguous")


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text: each byte goes in, then eight shifts."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, b: {step}), 4294967295)"


def _merkle_sql(levels: int = 5, top_levels: int = 3) -> str:
    """The manifest with its levels written out: enough for 16^levels rows of a source and 16^top_levels sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = "PARTITION BY g, pos // 16 ORDER BY pos"
    parts = [
        f"""d0 AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN coalesce({_crc32_sql('doc_id::VARCHAR')} % 5 = 0, false) THEN {leaf(lower)} END AS changed FROM documents)""",
        """s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))""",
        """d AS (SELECT doc_id, leaf, changed, g, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d0 JOIN s ON d0.source IS NOT DISTINCT FROM s.source)""",
        "l0 AS (SELECT g, pos, n, leaf AS digest FROM d)",
    ]

    def climb(name: str, height: int) -> None:
        for k in range(height):
            parts.append(
                f"""{name}s{k} AS (SELECT g, pos, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k} WHERE n > 1)"""
            )
            parts.append(f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY g, pos // 16, n)")

    climb("l", levels)
    parts.append("u AS (" + " UNION ALL ".join(f"SELECT g, digest FROM l{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    parts.append("t0 AS (SELECT 0 AS g, u.g AS pos, (SELECT count(*) FROM u) AS n, digest FROM u)")
    climb("t", top_levels)
    parts.append("r AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM t{k} WHERE n = 1" for k in range(top_levels + 1)) + ")")
    parts.append("f0 AS (SELECT doc_id, leaf, u.digest AS subroot, root, '' AS proof, coalesce(changed, leaf) AS acc, d.g AS g, pos FROM d JOIN u ON d.g = u.g, r)")
    steps = [(f"ls{k}", f"f.g = x.g AND f.pos // {16**k} = x.pos") for k in range(levels)] + [(f"ts{k}", f"f.g // {16**k} = x.pos") for k in range(top_levels)]
    for i, (siblings, on) in enumerate(steps):
        parts.append(
            f"""f{i + 1} AS (SELECT doc_id, leaf, subroot, root, CASE WHEN x.pos IS NULL THEN proof ELSE proof || b || a END AS proof,
            CASE WHEN x.pos IS NULL THEN acc ELSE sha256(b || acc || a) END AS acc, f.g AS g, f.pos AS pos FROM f{i} f LEFT JOIN {siblings} x ON {on})"""
        )
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM f{len(steps)}"


@query(_merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    known = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        "doc_id", "source", F.col("doc_id").alias("key"), merkle_manifest.row_digest([*known, F.col("text")]).alias("leaf"),
        F.when(tampered, merkle_manifest.row_digest([*known, ascii_lower(F.col("text"))])).alias("changed"),
    )
    found = merkle_manifest.manifest(rows, ["doc_id", "changed"])
    folded = merkle_manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))
    proven = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof_text(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def _byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ids_digest(bpe, ids) -> tuple:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


@query()
def op12_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_bpe.encode_texts(table(spark, sf_dir, "documents"), _byte_bpe_path(), _ids_digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@query(
    """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
    w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
    k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
    v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
    t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
    p AS (SELECT lang, g.source AS source, k.term AS term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v) AS p,
        1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v) AS q
        FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pair AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item,
        coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 200"""
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))
