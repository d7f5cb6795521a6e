"""The queries of this package: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import bpe, decontamination, flac, minhash, packing, quality, rules, sharding, substring, tokenids, toxicity, variants, vectorcodes
from tidegrid.llm.common import read_table, scratch_path, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_elias_fano_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    tokenids.write_token_ids(read_table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"), end_id=1)
    return tokenids.read_token_ids(spark, path)


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The streams are a table in the shared folder; what follows reads them back.
    media = written(flac.text_media(read_table(spark, sf_dir, "documents")), "media")
    return flac.media_features(media)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_windows(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return rules.judge(read_table(spark, sf_dir, "documents"), trusted)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"), 24)


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("tie")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_elias_fano_token_ids,
        op2_flac_media,
        op3_toxicity,
        op4_prefix_bpe,
        op5_weak_label_quality,
        op6_substring_dedup,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_sharding,
        op10_circulant_minhash,
        op11_decontamination,
        op12_spelling_variants,
        op13_vector_codes,
    )
}

_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"
_OP6 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
  g AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS key FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS k FROM w)),
  f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY key) AS first_doc FROM g),
  c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM f WHERE first_doc < doc_id),
  p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
  r AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1)
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS k FROM w)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, there) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.there),
  m AS (SELECT doc_id, min(there) AS least_there FROM r GROUP BY 1)
  SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(least_there, w.doc_id)) AS component_id, least(w.doc_id, coalesce(least_there, w.doc_id)) = w.doc_id AS kept
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""

_ITEM = f"regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP11 = f"""WITH d AS (SELECT doc_id, {_ITEM} AS ws FROM documents),
  b AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_ITEM} AS ws FROM benchmark) WHERE len(ws) > 0),
  bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(ws[k:k + n - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM b)),
  s AS (SELECT DISTINCT n FROM bw),
  dw AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS key FROM (SELECT d.*, s.n, unnest(range(1, len(ws) - s.n + 2)) AS k FROM d, s)),
  h AS (SELECT * FROM dw WHERE key IN (SELECT key FROM bw)),
  c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM h) GROUP BY 1),
  i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h JOIN bw ON bw.key = h.key GROUP BY 1)
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""

_OP12 = f"""WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
  r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
  b AS (SELECT run, k, [4294967295] || flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM r),
  h AS (SELECT run, k, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM b, t),
  w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
  p AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
  d AS (SELECT DISTINCT p.word AS long, p.n AS long_n, w.word AS short, w.n AS short_n FROM p JOIN w ON w.word = p.less),
  e AS (SELECT long AS word, short AS near, short_n AS near_n FROM d UNION ALL SELECT short, long, long_n FROM d
    UNION ALL SELECT a.word, b.word, b.n FROM p a JOIN p b ON a.less = b.less AND a.i = b.i AND a.word <> b.word),
  f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY 1),
  g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
  up(word, root, depth) AS (SELECT word, word, 0 FROM g UNION ALL SELECT up.word, g.form, depth + 1 FROM up JOIN g ON g.word = up.root WHERE g.form IS NOT NULL)
  SELECT g.word, form, u.root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY 1) u ON u.word = g.word"""



def _op13() -> str:
    """Four rounds as one common table after another: the nearest entries, then the entries' means."""
    near = """a{r} AS (SELECT p.row, p.pos, min(CAST(x2 + c2 - 2 * list_inner_product(part, entry_part) AS BIGINT) * 256 + entry) AS best
  FROM p JOIN (SELECT *, list_inner_product(entry_part, entry_part) AS c2 FROM c{r}) c ON c.pos = p.pos GROUP BY ALL)"""
    mean = """m{r} AS (SELECT pos, entry, list(CAST(mean AS DOUBLE) ORDER BY k) AS entry_part FROM (SELECT pos, entry, k, floor(sum(x) / count(*)) AS mean
    FROM (SELECT p.pos, best % 256 AS entry, unnest(part) AS x, unnest(range(len(part))) AS k FROM p JOIN a{q} a ON a.row = p.row AND a.pos = p.pos) GROUP BY ALL) GROUP BY ALL),
  c{r} AS (SELECT c.pos, c.entry, coalesce(m.entry_part, c.entry_part) AS entry_part FROM c{q} c LEFT JOIN m{r} m ON m.pos = c.pos AND m.entry = c.entry)"""
    steps = [near.format(r=0)] + [x.format(r=r, q=r - 1) for r in range(1, 5) for x in (mean, near)]
    return f"""WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT row, pos, part, list_inner_product(part, part) AS x2 FROM (SELECT row, pos, v[pos * len(v) // 4 + 1:(pos + 1) * len(v) // 4] AS part FROM v, range(4) t(pos))),
  c0 AS (SELECT pos, row AS entry, part AS entry_part FROM p WHERE row < 256),
  {", ".join(steps)},
  s AS (SELECT sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY pos, entry, k)) AS sha FROM (SELECT pos, entry, unnest(entry_part) AS x, unnest(range(len(entry_part))) AS k FROM c4)),
  e AS (SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY pos) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY 1)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM v JOIN e ON e.row = v.row, s"""


#: The other operators' rows come from a vocabulary, a model or a packing, which SQL can't express.
ORACLE_SQL: dict[str, str] = {"op6_substring_dedup": _OP6, "op10_circulant_minhash": _OP10, "op11_decontamination": _OP11, "op12_spelling_variants": _OP12, "op13_vector_codes": _op13()}
