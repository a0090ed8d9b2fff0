"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revpanel.llm.codes import compress_vectors
from revpanel.llm.common import cut
from revpanel.llm.decontaminate import contamination
from revpanel.llm.html import extract_main_text
from revpanel.llm.mixing import mix_documents
from revpanel.llm.packing import pack_documents
from revpanel.llm.pii import replace_personal_data
from revpanel.llm.ranked import ranked_search
from revpanel.llm.repeats import strip_repeated_passages, strip_repeated_windows
from revpanel.llm.sharding import shard_documents
from revpanel.llm.simhash import simhash_classes
from revpanel.llm.topk import exact_top_k
from revpanel.llm.toxicity import fit_toxicity, held_out, toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 3 or fewer bits."""
    out = simhash_classes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of ids that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in all documents: windows of 13 words, found by winnowing."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every vector whose id is divisible by 50, over all vectors."""
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1 in turn."""
    return mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start earlier, by sparse suffix arrays over all documents."""
    out = strip_repeated_passages(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform(F.arrays_zip("starts", "ends"), lambda x: F.concat(x["starts"].cast("string"), F.lit("-"), x["ends"].cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), spans.alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return replace_personal_data(_table(spark, sf_dir, "documents"), "a key for tables without real persons")


def op9_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier, by Rabin-Karp hashes over all documents."""
    out = strip_repeated_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards with numbers of rows at most one apart, equal texts together."""
    out = shard_documents(_table(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for every benchmark item, by sums of bit-sliced impacts."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, by a configuration linear program."""
    packed, _ = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, end=2)
    return packed


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four bytes for all vectors, by four rounds of exponion search over 256 entries a part."""
    coded, books = compress_vectors(_table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    coded = cut(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {"op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op3_decontaminate": op3_decontaminate, "op4_topk": op4_topk, "op5_html": op5_html, "op6_mixing": op6_mixing, "op7_suffixes": op7_suffixes, "op8_pii": op8_pii, "op9_windows": op9_windows, "op10_sharding": op10_sharding, "op11_ranked": op11_ranked, "op12_packing": op12_packing, "op13_codes": op13_codes}


def _windows_sql(width: int, spans: bool) -> str:
    """Removal of windows that start earlier, for tables of the size of the correctness check."""
    found = ""
    if spans:
        found = """, runs AS (SELECT doc_id, min(p) - 1 AS s, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) GROUP BY doc_id, g),
        spans AS (SELECT doc_id, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY doc_id)"""
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {width - 1}), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS i FROM w WHERE len(ws) >= {width})),
    late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {width})) AS p FROM late)),
    one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w){found}
    SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256{", coalesce(spans.spans, '') AS spans" if spans else ""}
    FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = w.doc_id
    LEFT JOIN (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.p) AS t FROM one LEFT JOIN gone ON gone.doc_id = one.doc_id AND gone.p = one.p WHERE gone.p IS NULL GROUP BY 1) k ON k.doc_id = w.doc_id
    {"LEFT JOIN spans ON spans.doc_id = w.doc_id" if spans else ""}"""


def _codes_sql(rounds: int = 4) -> str:
    """Product quantisation by the plain definition: every part against every entry, a pair of common tables a round."""
    whole = "[CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding]"
    assign = """a{r} AS MATERIALIZED (SELECT rn, part, m // 256 AS d, m % 256 AS entry FROM (SELECT p.rn, p.part, min(CAST(p.q + b.q - 2 * list_dot_product(p.f, b.f) AS BIGINT) * 256 + b.entry) AS m FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.rn, p.part)),"""
    update = """u{r} AS (SELECT part, entry, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM (SELECT p.part, a.entry, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN a{r} a ON a.rn = p.rn AND a.part = p.part) GROUP BY part, entry, i),
    n{r} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM u{r} GROUP BY part, entry),
    b{s} AS MATERIALIZED (SELECT *, [CAST(v AS DOUBLE) for v in x] AS f, list_dot_product([CAST(v AS DOUBLE) for v in x], [CAST(v AS DOUBLE) for v in x]) AS q FROM (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.entry = b.entry)),"""
    steps = "".join(assign.format(r=r) + update.format(r=r, s=r + 1) for r in range(rounds)) + assign.format(r=rounds)
    return f"""
    WITH k AS (SELECT vec_id, label, {whole} AS x, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    p AS MATERIALIZED (SELECT *, [CAST(v AS DOUBLE) for v in x] AS f, list_dot_product([CAST(v AS DOUBLE) for v in x], [CAST(v AS DOUBLE) for v in x]) AS q FROM (SELECT rn, part, list_slice(x, part * (len(x) // 4) + 1, (part + 1) * (len(x) // 4)) AS x FROM (SELECT rn, x, unnest(range(0, 4)) AS part FROM k))),
    b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x, f, q FROM p WHERE rn <= 256),
    {steps}
    c AS (SELECT rn, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
    SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c ON c.rn = k.rn CROSS JOIN h"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_decontaminate": rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
    dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(ws) >= n)),
    hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
    pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    "op4_topk": """
    WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op7_suffixes": _windows_sql(50, True),
    "op9_windows": _windows_sql(20, False),
    "op11_ranked": rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    c AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
    tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY doc_id, n, t),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) CROSS JOIN c),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM b JOIN tf USING (t) JOIN w USING (t) CROSS JOIN c GROUP BY item_id, doc_id)
    SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10""",
    "op13_codes": _codes_sql(),
}
