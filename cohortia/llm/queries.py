"""One registered query per operator of this folder, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.catalog.registry import register

from . import decontaminate, licences, minhash, pieces, quality, shards, spelling, substrings, tokencounts, tokenfile, toxicity, webpages, whitening
from .tables import cut, read


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a cluster may pass other paths to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


LINKS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
),
one AS (SELECT doc_id, unnest(g) AS s FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN sets sx ON sx.doc_id = x.doc_id JOIN sets sy ON sy.doc_id = y.doc_id
  WHERE 100 * least(len(sx.g), len(sy.g)) >= 80 * greatest(len(sx.g), len(sy.g))
  GROUP BY x.doc_id, y.doc_id, len(sx.g), len(sy.g) HAVING 100 * count(*) >= 80 * (len(sx.g) + len(sy.g) - count(*))
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT sets.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least_id AS component_id, least_id = sets.doc_id AS kept
FROM sets JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = sets.doc_id
"""


@register("op1_tensored_minhash", LINKS_SQL)
def op1_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates over word pairs; one document of each component is kept."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


@register("op2_consensus_pages")
def op2_consensus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page, by the paths its host agrees on."""
    return webpages.extract_text(read(spark, sf_dir, "pages"))


@register("op3_stratified_shards")
def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards that each show the mixture of sources; counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shards.stratified_shards(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@register("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id files of all documents, read back document by document."""
    manifest = tokenfile.write_token_files(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_token_files(manifest)


@register("op5_ftrl_toxicity")
def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents from a model fitted outside the held-out third."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@register("op6_licence_scan")
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensed lines, paragraphs and texts of all documents, with their Dice coefficients."""
    return licences.scan_licences(read(spark, sf_dir, "documents"))


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts ON win.g = firsts.g WHERE m < win.doc_id)
),
words AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@register("op7_repeated_passages", REPEATS_SQL)
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that a document of smaller id also has, removed from all texts."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


@register("op8_pieces")
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact merge-type encoding of every text, and its decoding."""
    return pieces.encode_texts(read(spark, sf_dir, "documents"), pieces.load_model(tokenizer_path("piece_bpe_32k.model")), with_ids=False)


@register("op9_adaptive_quality")
def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of fences learnt per language and source."""
    counts = cut(quality.base_counts(read(spark, sf_dir, "documents")))
    return quality.adaptive_filter(counts)


@register("op10_benchmark_leaks")
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, one row per document and item."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op11_digest_counts")
def op11_digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by way of digests; the cache is empty at first, so each distinct text is encoded once."""
    return tokencounts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@register("op12_whitened")
def op12_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their eight leading components, each of variance one."""
    rows = read(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))


VARIANTS_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
octets AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b
  FROM (SELECT doc_id, run, count(*) AS times FROM low GROUP BY ALL)
),
summed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM octets, bits
),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM summed
),
vocabulary AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON c.rest = v.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS top, max(other_n) AS top_n FROM near GROUP BY word
),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word
),
ways AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM ways w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(here, step) AS root FROM ways GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON r.word = f.word
"""


@register("op13_spelling_variants", VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, and the form each is a variant of."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))
