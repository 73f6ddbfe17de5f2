"""Queries: near and exact duplicates."""

from pyspark.sql import functions as F

from placeweave.llm import ngram_join as N
from placeweave.llm import repeats as R
from placeweave.llm import vector_dedup as V
from placeweave.llm.registry import query, table


@query(oracle="""
WITH RECURSIVE w AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE w <> [''])),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id
""")
def op4_ngram_join(spark, sf_dir):
    """Every document's group by word 5-grams."""
    return N.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(oracle="""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(p), 0) AS m,
             CASE WHEN p IS NULL THEN w ELSE [w[i] FOR i IN list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)))] END AS kept
      FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""")
def op2_repeats(spark, sf_dir):
    """Every document without the word runs that occur earlier."""
    found = R.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query(oracle="""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, list_count(embedding) = len(embedding) AS full_ FROM embeddings),
u AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND full_
      AND len(list_filter(x, lambda c: NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op1_vector_dedup(spark, sf_dir):
    """Every vector's links and group."""
    return V.similar_vectors(table(spark, sf_dir, "embeddings"))
