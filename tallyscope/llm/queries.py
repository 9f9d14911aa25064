"""The operators bound to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import fields

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
# The key of a real run comes from the caller; this one makes the query repeatable.
SURROGATE_KEY = "public example key"
# The url policy of the query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))




@query("op5_url_cascade", r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS h0, coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), q AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q
), a AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM r
), l AS (
  SELECT host AS listed FROM a GROUP BY host HAVING count_if(action = 'block') > 0 AND count_if(action = 'block') >= 0.5 * count(*)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN l ON host = listed""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url judged by four rules and, where none fits, by the cascade of listed hosts."""
    from tallyscope.llm.url_cascade import Rule, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


@query("op10_sainte_lague_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of its sources at 1 : 2 : 3 takes."""
    from tallyscope.llm.mixing import cyclic_weight, mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), cyclic_weight())
    return fields(mixed, "doc_id", "source", "size", "source_size", "target", "taken", "passes", "run_start", "run_words")


@query("op6_tiered_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 256 to 2048 tokens."""
    from tallyscope.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@query("op7_toxicity_fm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside fold 0 of five."""
    from tallyscope.llm.common import fold
    from tallyscope.llm.toxicity import learn, score_texts

    docs = table(spark, sf_dir, "documents")
    machine = learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return score_texts(docs, machine).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_quality_index_net")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled rows outside fold 2 of four."""
    from tallyscope.llm.common import fold
    from tallyscope.llm.quality import quality_scores

    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op2_minmax_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.75 on five-word shingles."""
    from tallyscope.llm.minmax import near_duplicates

    return fields(near_duplicates(table(spark, sf_dir, "documents")), "doc_id", "n_shingles", "component_id", "kept")


@query("op8_norm_bucket_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector with all others."""
    from tallyscope.llm.topk import top_inner_products, whole_vectors

    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.where("vec_id % 50 = 0"))


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their personal data."""
    from tallyscope.llm.pii import replace_entities

    docs = fields(table(spark, sf_dir, "documents"), "doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY, count_col="n_replaced")


@query("op3_bottom_k_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they are."""
    from tallyscope.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_parse_dedup", r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)
),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS i FROM g) WHERE i > 1),
b AS (SELECT doc_id, s, s + 100 AS e, max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
m AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM b),
p AS (SELECT doc_id, span, min(s) AS s, max(e) AS e FROM m GROUP BY 1, 2),
q AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM p),
k AS (
  SELECT d.doc_id, d.n, coalesce(sum(q.e - q.s), 0) AS gone, count(q.s) AS spans,
    coalesce(string_agg(substr(d.h, 2 * q.since + 1, 2 * (q.s - q.since)), '' ORDER BY q.s), '') || substr(any_value(d.h), 2 * coalesce(max(q.e), 0) + 1) AS kept
  FROM d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id, d.n
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier too."""
    from tallyscope.llm.parse_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_strata_search", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 100 - 75 + (75 * len(w) * n_docs) // l AS m FROM d, g WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY 1, 2),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, g GROUP BY t, n_docs),
q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY 1, 2
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY 1, 2
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, from a length-stratified index of all documents."""
    from tallyscope.llm.strata import asked_terms, build_index, search

    items = table(spark, sf_dir, "benchmark")
    return search(build_index(table(spark, sf_dir, "documents"), only=asked_terms(items)), items)


@query("op12_positional_leaks", r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), v AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s + 1:s + size], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)
), z AS (SELECT DISTINCT size FROM v),
o AS (SELECT doc_id, x, size, array_to_string(w[x + 1:x + size], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS x FROM d, z WHERE len(w) >= size)),
m AS (SELECT doc_id, x, o.size, item_id FROM o JOIN v ON o.size = v.size AND o.g = v.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(x, x + size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in all documents, from positional lists of the items' words."""
    from tallyscope.llm.positional import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_prefix_trie", r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), a AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
), r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, md5(length(role) || ':' || role || text) AS k, length(text) AS n FROM a),
p AS (
  SELECT conv_id, depth, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), v AS (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n FROM p GROUP BY path),
u AS (SELECT path, conv_id, left(path, length(path) - 32) AS parent FROM v WHERE depth > 0),
k AS (SELECT parent, count(*) AS n_children FROM u GROUP BY parent),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k ON k.parent = v.path),
s AS (
  SELECT p.path, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * x.n) AS saved
  FROM x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.path
), l AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT x.conv_id, x.depth, w.conv_id AS parent_conv_id, x.n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN s ON s.path = x.path LEFT JOIN u ON u.path = x.path LEFT JOIN v w ON w.path = u.parent LEFT JOIN l ON l.path = x.path""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations after each was rebuilt on the head of its hundred's first."""
    from tallyscope.llm.prefix_trie import branched_turns, numbered_turns, prefix_nodes

    numbered = numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_nodes(branched_turns(numbered), numbered.select("conv_id").distinct())


def _register_pipeline() -> None:
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


_register_pipeline()
