"""Queries: repair of damaged conversations, and the trie of their prefixes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm import conversation_repair as R
from placeweave.llm import conversation_trie as P
from placeweave.llm.registry import query, table

# CRC-32 of the string column `s` of a relation, by a table of 256 entries that SQL computes.
CRC_SQL = """
crc_steps AS (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
              FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k)),
crc AS (SELECT list(v ORDER BY k) AS t FROM crc_steps)"""


def crc_sql(s: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) for c in string_split({s}, '')]), "
            "lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295)")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of their ends of sentences, repeated or given to the user, as
    the hash of their key says."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def _best_sql(q: int) -> str:
    """The best way into a state over one more row, as a struct of cost, letters and turns."""
    names, ways = "esua", []
    for p in range(4):
        for n, state in R._inserted(p):
            added, at = "", p
            for _ in range(n):
                role = "assistant" if at == R.USER else "user"
                added, at = added + f", '{role}:'", R.ASSISTANT if at == R.USER else R.USER
            had = f"list_concat({names[p]}.o, [{added[2:]}])" if n else f"{names[p]}.o"

            def way(cond, cost, letter, turn, p=p, n=n, had=had):
                out = f"list_append({had}, {turn})" if turn else had
                ways.append(f"CASE WHEN {names[p]} IS NOT NULL AND {cond} THEN {{'c': {names[p]}.c + {3 * n} + {cost}, "
                            f"'t': {names[p]}.t || '{'I' * n + letter}', 'o': {out}}} END")

            if state == q:
                way("true", "4", "D", "")
            for initial in "sua":
                if R._AFTER.get((initial, state)) == q:
                    way(f"NOT go AND initial = '{initial}'", "3 * cut", "K", "role || ':' || text")
            for role in ("user", "assistant"):
                if R._AFTER.get((role[0], state)) == q:
                    way("NOT go", "3 + 3 * cut", "R", f"'{role}:' || text")
    return f"list_min([{', '.join(ways)}])"


_STATE = "STRUCT(c BIGINT, t VARCHAR, o VARCHAR[])"

REPAIR_SQL = f"""
WITH RECURSIVE {CRC_SQL},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
coded AS (SELECT keyed.*, {crc_sql('s')} % 20 AS code FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                   CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0),
ended AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
marked AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, body = '' AS blank, right(body, 1) NOT IN ('.', '!', '?') AS open_,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM ended),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM marked),
numbered AS (SELECT conv_id, turn, role, text, i, initial, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND open_ AS truncated,
                    blank OR again AS go, CAST(NOT blank AND NOT again AND open_ AS BIGINT) AS cut FROM seen),
facts AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                 count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                 count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
          FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered) GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS fed, CAST({{'c': 0, 't': '', 'o': []}} AS {_STATE}) AS e, CAST(NULL AS {_STATE}) AS s,
         CAST(NULL AS {_STATE}) AS u, CAST(NULL AS {_STATE}) AS a FROM ids
  UNION ALL
  SELECT paths.conv_id, i, {_best_sql(0)}, {_best_sql(1)}, {_best_sql(2)}, {_best_sql(3)}
  FROM paths JOIN numbered ON numbered.conv_id IS NOT DISTINCT FROM paths.conv_id AND i = fed + 1),
ends AS (SELECT paths.conv_id, list_min([e, a, CASE WHEN u IS NOT NULL THEN {{'c': u.c + 3, 't': u.t || 'I', 'o': list_append(u.o, 'assistant:')}} END,
                CASE WHEN s IS NOT NULL THEN {{'c': s.c + 6, 't': s.t || 'II', 'o': list_concat(s.o, ['user:', 'assistant:'])}} END]) AS best
         FROM paths LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM paths.conv_id WHERE fed = coalesce(n, 0))
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.t AS audit,
       sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


@query(oracle=REPAIR_SQL)
def op11_repair(spark, sf_dir):
    """Every conversation's faults and cheapest repair, after the damage."""
    given = table(spark, sf_dir, "conversations")
    return R.with_all(given, R.digests(R.repair(damage(given))))


# A rebuilt conversation has fewer first turns of another one than this.
HEADS = 6

TRIE_SQL = f"""
WITH {CRC_SQL},
ids AS (SELECT conv_id, {crc_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h, conv_id - conv_id % 100 AS first
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS q
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (SELECT ids.conv_id, list_concat(coalesce(f.q[1:h], []), own.q[h + 1:]) AS q
            FROM ids JOIN own ON own.conv_id = ids.conv_id LEFT JOIN own f ON f.conv_id = first),
member AS (SELECT conv_id, d, q[1:d] AS path, len(q) = d AS ends FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM rebuilt)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
         FROM member GROUP BY path, d),
child AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * length(node.path[d].t) ELSE 0 END AS w
          FROM node LEFT JOIN child ON child.path = node.path),
above AS (SELECT path[1:k] AS path, CAST(sum(w) AS BIGINT) AS saved, count(*) FILTER (n_children = 0) AS leaves
          FROM (SELECT path, w, n_children, unnest(range(0, d + 1)) AS k FROM full_) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, leaves AS n_leaves, saved AS saved_tokens, a.ends AS ends_sha256
FROM full_ a JOIN above ON above.path = a.path LEFT JOIN node p ON a.d > 0 AND p.d = a.d - 1 AND p.path = a.path[1:a.d - 1]
"""


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, key, chars) of conversations that begin with the first turns of the first
    one in their hundred, and all conv_ids."""
    turns = P.sequences(P.turn_keys(conversations), "turn")
    ids = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    first = F.col("conv_id") - F.col("conv_id") % 100
    heads = turns.filter(F.col("depth") < HEADS).filter("conv_id % 100 = 0").select(F.col("conv_id").alias("first"), F.col("depth").alias("place"), "key", "chars")
    taken = ids.select("conv_id", first.alias("first"), h.alias("h")).join(heads, "first").filter("place <= h")
    length = heads.groupBy("first").agg(F.max("place").alias("had"))
    rest = turns.filter(F.col("depth") > h).withColumn("first", first).join(length, "first", "left").select(
        "conv_id", (F.col("depth") - h + F.least(h, F.coalesce("had", F.lit(0)))).alias("place"), "key", "chars")
    return taken.select("conv_id", "place", "key", "chars").unionByName(rest), ids


@query(oracle=TRIE_SQL)
def op12_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    turns, ids = rebuilt(table(spark, sf_dir, "conversations"))
    return P.prefix_trie(turns, "place", ids)
