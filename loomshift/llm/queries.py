"""One query per operator, over its whole table, in the shape of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshift.llm import decontaminate, jaccard, langid, licenses, mixing, pii, quality, rules, structure, substrings, topk, trie, warc
from loomshift.llm.common import Scratch, fold, held_out
from loomshift.llm.registry import query
from loomshift.session import read_table

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size) AS total, sum(weight) AS weights FROM s),
levels AS (SELECT max(level) AS level FROM (
  SELECT (t.total - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / (t.weights - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM s, t WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
g AS (SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target
      FROM s, levels),
h AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM g),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT d.doc_id, d.size, h.source_size, h.target,
       (least(3, whole + CASE WHEN 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM r d JOIN h ON d.source IS NOT DISTINCT FROM h.source
"""


@query("op8_mixing", MIX_SQL)
def op8(spark, sf_dir):
    """Mix of all documents by source weights 1, 2, 3, at most three epochs."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("size").cast("long"), "source_size", "target", F.col("taken").cast("long"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""


@query("op6_topk", TOPK_SQL)
def op6(spark, sf_dir):
    """The ten vectors of highest inner product for every hundredth vector."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


WARC_SQL = r"""
WITH u AS (SELECT page_id, html, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url,
                  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)', 1)) AS host FROM pages),
p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             CASE WHEN host = '' THEN url ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
               || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)', 2) END AS url_key,
             (coalesce(page_id, 0) % 4102444800 + 4102444800) % 4102444800 AS captured FROM u),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest, CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, url_key, captured,
       (row_number() OVER (ORDER BY coalesce(url_key, ''), captured, page_id NULLS FIRST) - 1)::BIGINT AS position
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
"""


@query("op10_warc", WARC_SQL)
def op10(spark, sf_dir):
    """All pages written as WARC records, read back and indexed, with the place of each capture in the merged order."""
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    run = warc.write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    index = warc.capture_index(warc.read_archives(spark, folder, run))
    scratch.drop(folder)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key",
                        F.unix_seconds("captured").alias("captured"), "position")


@query("op1_quality")
def op1(spark, sf_dir):
    """Quality score of every document; a fourth of the ids is never learnt from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"), fold(F.col("doc_id")) != 2)
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_langid")
def op2(spark, sf_dir):
    """Language of every document; a fourth of the ids is never learnt from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = langid.score(docs, fold(F.col("doc_id")) != 2, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "rejected")


@query("op3_jaccard")
def op3(spark, sf_dir):
    """Classes of documents whose five-word shingles agree by four fifths."""
    return jaccard.classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_decontaminate")
def op5(spark, sf_dir):
    """Documents that hold a test item, within the error budget."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


@query("op4_pii")
def op4(spark, sf_dir):
    """Personal data of every document, and the terms that give them away."""
    found = pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


SUBSTRINGS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
g AS (SELECT r, i FROM k JOIN m USING (k) WHERE least < doc_id),
p AS (SELECT DISTINCT r, i + unnest(range(0, 13)) AS pos FROM g),
l AS (SELECT r, list(pos) AS gone, count(*) AS n_removed FROM p GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(array_to_string([x FOR x, i IN w IF NOT list_contains(coalesce(gone, []), i)], ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""


@query("op9_substrings", SUBSTRINGS_SQL)
def op9(spark, sf_dir):
    """Words of every document that no earlier document has in the same passage of 13 words."""
    kept = substrings.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_licenses")
def op7(spark, sf_dir):
    """Licenses that documents hold."""
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
s AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM s),
p AS (SELECT DISTINCT r, i + unnest(range(0, 3)) AS pos FROM k WHERE n > 1),
a AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals,
             len(regexp_extract_all(text, '!')) AS n_exclaims
      FROM w LEFT JOIN a USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_letters < 70 * word_chars OR 2 * n_capitals > n_letters OR 5 * n_exclaims > n_words) AS kept
FROM m
"""


@query("op11_rules", RULES_SQL)
def op11(spark, sf_dir):
    """Verdict of the rule cascade on every document, with the measures of its base rules."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.cascade(docs, always=("words", "symbols", "lines", "repeats"))
    failed = F.expr(" OR ".join(f"({r.fails})" for r in rules.BASE_RULES))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


STRUCTURE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             [ascii(x) FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes FROM conversations),
h AS (SELECT o.*, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM o, bits),
r AS (SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) FROM h WHERE fault <> 0),
n AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS short FROM r),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
             lag(role) OVER (PARTITION BY g ORDER BY i) AS prior FROM n),
code AS (SELECT g, i, role, text, blank OR again AS dead, (short AND NOT blank AND NOT again)::BIGINT AS cut, substr(role, 1, 1) AS k FROM f),
sums AS (SELECT g, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
                count_if(again)::BIGINT AS duplicate, count_if(short AND NOT blank AND NOT again)::BIGINT AS truncated,
                count_if(prior IS NOT NULL AND substr(prior, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
         FROM f GROUP BY g),
back AS (
  SELECT g, n + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS v FROM sums
  UNION ALL
  SELECT g, i, CASE WHEN dead THEN [x + 3 FOR x IN v] ELSE [least(w[1], 2 + x2), least(w[2], 2 + x2), x2, least(w[4], 2 + x2)] END
  FROM (SELECT *, least(w[3], 2 + w[4]) AS x2 FROM (
    SELECT c.g, c.i, c.dead, b.v, [
      least(3 + v[1], 2 + cut + v[3], CASE k WHEN 'u' THEN cut + v[3] WHEN 's' THEN cut + v[2] ELSE 99 + v[1] END),
      least(3 + v[2], 2 + cut + v[3], CASE k WHEN 'u' THEN cut + v[3] ELSE 99 + v[2] END),
      least(3 + v[3], 2 + cut + v[4], CASE k WHEN 'a' THEN cut + v[4] ELSE 99 + v[3] END),
      least(3 + v[4], 2 + cut + v[3], CASE k WHEN 'u' THEN cut + v[3] ELSE 99 + v[4] END)] AS w
    FROM back b JOIN code c ON c.g = b.g AND c.i = b.i - 1))),
walk AS (
  SELECT g, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS turns FROM sums
  UNION ALL
  SELECT g, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
         CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE k WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE t END, audit || e,
         CASE e WHEN 'D' THEN turns WHEN 'I' THEN list_append(turns, new || ':') WHEN 'K' THEN list_append(turns, role || ':' || text)
                ELSE list_append(turns, new || ':' || text) END
  FROM (SELECT w.g, w.i, s, audit, turns, role, text, k, t, CASE WHEN t = 3 THEN 'user' ELSE 'assistant' END AS new,
               CASE WHEN dead OR 3 + x.v[s] = b.v[s] THEN 'D' WHEN 2 + b.v[t] = b.v[s] THEN 'I'
                    WHEN (k = 'u' AND s <> 3 AND cut + x.v[3] = b.v[s]) OR (k = 'a' AND s = 3 AND cut + x.v[4] = b.v[s])
                         OR (k = 's' AND s = 1 AND cut + x.v[2] = b.v[s]) THEN 'K' ELSE 'R' END AS e
        FROM (SELECT *, CASE WHEN s = 3 THEN 4 ELSE 3 END AS t FROM walk) w JOIN back b ON b.g = w.g AND b.i = w.i
        LEFT JOIN code c ON c.g = w.g AND c.i = w.i LEFT JOIN back x ON x.g = w.g AND x.i = w.i + 1
        WHERE c.i IS NOT NULL OR s IN (2, 3))),
done AS (SELECT w.g, audit, turns FROM walk w JOIN sums USING (g) WHERE w.i = n + 1 AND s IN (1, 4))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.v[1], 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM o) LEFT JOIN sums USING (g) LEFT JOIN done USING (g) LEFT JOIN back b ON b.g = done.g AND b.i = 1
"""


@query("op12_structure", STRUCTURE_SQL)
def op12(spark, sf_dir):
    """The cheapest repair of every damaged conversation."""
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure.audits(structure.damaged(conversations), lost=conversations)


TRIE_SQL = r"""
WITH bits AS (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT c, c - c % 100 AS base, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT c, [ascii(x) FOR x IN string_split(c::VARCHAR, '')] AS bytes FROM o), bits),
t AS (SELECT m.c, 0 AS own, o.i, role, text FROM m JOIN o ON o.c = m.base AND o.i <= h
      UNION ALL SELECT m.c, 1, o.i, role, text FROM m JOIN o ON o.c = m.c AND o.i > h),
p AS (SELECT c, d, n_chars, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS p
      FROM (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, length(text) AS n_chars, md5(role) || md5(text) AS k FROM t)
      UNION ALL SELECT c, 0, 0, '' FROM m),
n AS (SELECT d, p, min(c) AS conv, count(*) AS n_convs, any_value(n_chars) AS n_chars FROM p GROUP BY d, p),
k AS (SELECT n.*, u.conv AS up, coalesce(x.n_children, 0) AS n_children
      FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.p = left(n.p, len(n.p) - 64)
      LEFT JOIN (SELECT d - 1 AS d, left(p, len(p) - 64) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) x ON x.d = n.d AND x.p = n.p),
s AS (SELECT p.d, p.p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * k.n_chars) AS saved
      FROM k JOIN p ON p.c = k.conv AND p.d <= k.d GROUP BY p.d, p.p),
e AS (SELECT d, p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT arg_max(p, d) AS p, max(d) AS d, c FROM p GROUP BY c) GROUP BY d, p)
SELECT conv AS conv_id, k.d::BIGINT AS depth, up AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.p = k.p LEFT JOIN e ON e.d = k.d AND e.p = k.p
"""


@query("op13_trie", TRIE_SQL)
def op13(spark, sf_dir):
    """The prefix trie of all rebuilt conversations with its subtree totals."""
    return trie.of_rebuilt(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
