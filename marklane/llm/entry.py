"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ans, audit, bpe, chat, classifier, html, minhash, mixing, mpeg, sharding, spelling, urls
from .common import materialise, table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(16)], 2039
END_ID, WORD_VOCABULARY = 1, 49_408


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per query (vec_id divisible by 20) and neighbour found; unusable vectors and null ids take no part, repeated ids are entries of their own, an empty table gives none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page; null and empty pages have an empty text, repeated rows stay."""
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null texts count as empty, repeated rows stay, texts of any length are coded whole."""
    docs = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), exact=None)
    n = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return docs.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, from the stored streams; null texts are stored as empty ones, equal texts as equal streams."""
    stored = materialise(mpeg.store_text(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    back = mpeg.restore(stored)
    size = F.octet_length("payload")
    return back.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.Model:
    known = table(spark, sf_dir, "labels").where(~classifier.held_out())
    return classifier.train(docs, known)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts are scored as one empty passage, equal texts alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, read back from the files alone; null texts count as empty, rows that repeat a doc_id have places of their own."""
    folder = ans.write_corpus(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID, WORD_VOCABULARY)
    return ans.read_corpus(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null ids are placed as the empty text, repeated ids share a shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign(docs, "doc_id", SHARDS, SLOTS)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation, digested from the stored text; null texts count as empty, null roles are turns of their own kind, ties in turn follow the rendered text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    stored = materialise(chat.format_turns(turns.unionByName(more)).select("conv_id", "turn", "formatted", "loss_from", "loss_to"))
    return chat.digest(stored)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with what the range-sorted training copies take of it, and the time and the place in the order of its first copy (null: not taken)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = materialise(mixing.mix(docs, carry=False).withColumn("_row", F.monotonically_increasing_id()))  # written once, so that a row keeps its number
    copies = mixing.numbered(mixing.schedule(mixed.select("_row", "doc_id", "mix")))
    taken = copies.groupBy("_row").agg(F.sum("mix.size").alias("taken"), F.min("mix.position").alias("first_position"), F.min("mix.rank").alias("first_rank"))
    rows = mixed.select("_row", "doc_id", "mix.size", "mix.source_size", "mix.target").join(taken, "_row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.round("first_position", 9).alias("first_position"), "first_rank")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts have no shingles and are linked with nothing, repeated rows stay and share a group."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.drop("group_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per source, order of the five filters and step; sources without documents have none."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per word of the vocabulary of all documents; none without words."""
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Rules of operator 13 (host, path, verdict), and the host labels of sites whose pages make its list.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page. The list is made from the pages: the URLs of those on a host with one of LISTED_LABELS; null URLs are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.arrays_overlap(F.split(urls.host_of(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_LABELS))))
    return urls.judge(pages, listed.select("url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage of ``corpus_pipeline`` over all documents; an empty table passes through."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_inverted_multi_index": op1,
    "op2_block_rules": op2,
    "op3_bpe_merge_rounds": op3,
    "op4_mpeg_audio": op4,
    "op5_attention_mil": op5,
    "op6_rans_files": op6,
    "op7_permutation_table": op7,
    "op8_chat_round_trip": op8,
    "op9_curriculum_mix": op9,
    "op10_bbit_minhash": op10,
    "op11_multilinear_shapley": op11,
    "op12_full_neighbourhood": op12,
    "op13_blocked_bloom": op13,
    "pipeline": pipeline,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op7_permutation_table": f"""
WITH RECURSIVE s AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) r(i)
), p AS (
  SELECT list(CAST(('0x' || substr(md5(name), 1, 8)) AS BIGINT) % {SLOTS} ORDER BY i) AS o,
         list(CAST(('0x' || substr(md5(name), 9, 8)) AS BIGINT) % {SLOTS - 1} + 1 ORDER BY i) AS k FROM s
), fill(step, t) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1) FROM p
  UNION ALL
  SELECT step + 1, list_transform(t, lambda v, n: CASE WHEN n = f.slot + 1 THEN step % {len(SHARDS)} ELSE v END)
  FROM (
    SELECT step, t, (o[step % {len(SHARDS)} + 1] + list_filter(range({SLOTS}), lambda j: t[(o[step % {len(SHARDS)} + 1] + j * k[step % {len(SHARDS)} + 1]) % {SLOTS} + 1] < 0)[1] * k[step % {len(SHARDS)} + 1]) % {SLOTS} AS slot
    FROM fill, p WHERE step < {SLOTS}
  ) f
), done AS (SELECT t FROM fill WHERE step = {SLOTS})
SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, slot, 'shard-' || lpad(CAST(t[slot + 1] AS VARCHAR), 2, '0') AS shard
FROM (SELECT doc_id, text, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents), done
""",
    "op8_chat_round_trip": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '\[\\*(?:/?INST\]|/?SYS\]|OUT\]|/?TURN[\] ])|<\\*/?s>'))
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10 ELSE 16 + CASE WHEN role IS NULL THEN 1 ELSE 2 * strlen(role) END END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op9_curriculum_mix": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '')), 1, 15)) AS BIGINT) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source
), o AS (
  SELECT *, CAST(2 * n AS DOUBLE) AS cap, 1.5::DOUBLE * sum(n) OVER () AS total,
    coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    sum(w) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s
), f AS (
  SELECT *, bool_and((total - gone) * w / open_w > cap) OVER (ORDER BY 2.0 * n / w, source ROWS UNBOUNDED PRECEDING) AS is_full FROM o
), t AS (
  SELECT source, n, CASE WHEN is_full THEN cap ELSE
    (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * w / sum(w) FILTER (NOT is_full) OVER () END AS target FROM f
), u AS (
  SELECT source, n, target, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, count(*) OVER () AS k FROM t
), p AS (
  SELECT d.*, u.n, u.target, CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE 1.6::DOUBLE * i / (k - 1) - 0.8::DOUBLE END AS slope,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS ahead
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), e AS (
  SELECT *, size > 0 AND ahead + size <= target AS one, size > 0 AND ahead + n + size <= target AS two FROM p
), g AS (
  SELECT *, max(CASE WHEN two THEN ahead + n + size WHEN one THEN ahead + size ELSE 0 END) OVER (PARTITION BY source) AS reached FROM e
), m AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 AND NOT two AND size < 2 * (target - reached) THEN abs(target - reached - size) END NULLS LAST, ahead) = 1
    AND size > 0 AND NOT two AND size < 2 * (target - reached) AS more FROM g
), v AS (
  SELECT doc_id, h, size, slope, least(1.0::DOUBLE, (ahead + size / 2.0::DOUBLE) / target) AS x FROM m WHERE one
  UNION ALL SELECT doc_id, h, size, slope, least(1.0::DOUBLE, (ahead + n + size / 2.0::DOUBLE) / target) FROM m WHERE two
  UNION ALL SELECT doc_id, h, size, slope, least(1.0::DOUBLE, (reached + size / 2.0::DOUBLE) / target) FROM m WHERE more
), y AS (
  SELECT doc_id, h, CASE WHEN abs(slope) < 1e-12 THEN x ELSE 2 * x / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * x)) END AS spot FROM v
), z AS (
  SELECT doc_id, h, spot, row_number() OVER (ORDER BY spot, doc_id) - 1 AS place FROM y
), q AS (
  SELECT doc_id, h, min(spot) AS spot, min(place) AS place FROM z GROUP BY doc_id, h
)
SELECT m.doc_id, size, n AS source_size, target, CAST(size * (CAST(one AS INTEGER) + CAST(two AS INTEGER) + CAST(more AS INTEGER)) AS BIGINT) AS taken,
  round(spot, 9) AS first_position, place AS first_rank
FROM m LEFT JOIN q ON m.doc_id = q.doc_id AND m.h = q.h
""",
    "op10_bbit_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(m, doc_id) >= doc_id AS kept
FROM s LEFT JOIN c ON a = doc_id
""",
    "op11_multilinear_shapley": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), f AS (
  SELECT d.part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
  FROM w d
), c AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, m
), o(s) AS (
  SELECT '' UNION ALL SELECT s || l FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(s, l)
), st AS (
  SELECT s AS filter_order, k AS step, 1 << (ascii(s[k]) - 65) AS own,
    list_sum(list_transform(range(1, 6), lambda j: CASE WHEN j < k THEN 1 << (ascii(s[j]) - 65) ELSE 0 END)) AS before
  FROM o, range(1, 6) r(k) WHERE length(s) = 5
), a AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN m & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN m & own <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN m = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN m & own <> 0 AND m & before = 0 THEN x ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM (SELECT part, m, n, g, x, filter_order, step, CAST(own AS BIGINT) AS own, CAST(before AS BIGINT) AS before FROM c, st) GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
""",
    "op12_full_neighbourhood": r"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8
), r AS (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY ALL
), b AS (
  SELECT w, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r
), h AS (
  SELECT w, c, xor(list_reduce(list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT)),
    lambda s, y: xor(s >> 8, t[xor(s & 255, y) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, tab
), p AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c FROM h
), v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM p WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.i = y.i AND x.s = y.s AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.s = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word
), one AS (
  SELECT b.word, n_near, top, min(near) AS form FROM best b JOIN near USING (word) WHERE near_n = top GROUP BY ALL
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN form END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM v LEFT JOIN one USING (word)
), chain(word, spot) AS (
  SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON c.spot = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, e.spot AS root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT c.word, c.spot FROM chain c JOIN f ON c.spot = f.word AND f.form IS NULL) e ON e.word = f.word
""",
    "op13_blocked_bloom": f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), p AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*[?]([^#]*)', 1), '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_') AND split_part(q, '=', 1) NOT IN ('ref', 'fbclid', 'gclid'))) AS q FROM u
), c AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM p
), l AS (
  SELECT DISTINCT key FROM c WHERE key IS NOT NULL AND list_has_any(string_split(host, '.'), {list(LISTED_LABELS)})
), k AS (
  SELECT page_id, host, path, key, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN l.key IS NULL THEN 'allow' ELSE 'block' END END AS verdict FROM k LEFT JOIN l ON k.key = l.key
""",
}
