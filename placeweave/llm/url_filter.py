"""URL rules by blocked Bloom filter and exact join (built-in Spark functions only).

Every rule is a host and a path prefix. A url asks for (host suffix, path prefix) keys: each of
its host's suffixes with each path length that the list has. A blocked Bloom filter of the
listed keys lets few unlisted keys through, and a hash join with the list removes those.

Cases: a null url or one without `://` has an empty host and path and fits no rule. Repeated
pages are judged each on its own. Of rules that fit, the longest host and path together wins;
of equally long ones that with the longer host. A rule listed twice with both verdicts blocks.
Rules with a null host, path or verdict are ignored. Without rules every url gets the default
verdict. Columns of the pages other than the id and the url are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (  # fixed values: (host, path, verdict)
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A block is one word of 64 bits; a key sets this many of them.
PROBES = 5
BITS_PER_KEY = 16
# Path lengths up to this many are an array literal; rules are few beside pages.
BROADCAST_KEYS = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path as the rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains: as many as it has labels."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The bits that a key sets in its block."""
    hashed = F.xxhash64(key, F.lit(2))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, bits) of the filter that holds the keys in column `key`."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
               default: str = "allow", bloom: bool = True) -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every page. `rules`: host, path, verdict.

    The path lengths of the list and its size are looked up once; both are bounded by the list.
    The filter and the list are broadcast up to a counted size and joined by shuffle beyond."""
    listed = (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), F.concat_ws("\n", "host", "path").alias("key"),
                F.length("host").alias("host_length"), F.length("path").alias("path_length"), "verdict")
    )
    shape = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()
    host, path = host_path(F.col(url_column))
    judged = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = F.broadcast if shape["n"] <= BROADCAST_KEYS else (lambda df: df)

    def keys(host: Column, path: Column) -> Column:
        fitting = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in shape["lengths"]]
        prefixes = F.array_compact(F.array(*fitting))
        return F.flatten(F.transform(suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))

    # Pages of one host and path are judged once.
    places = judged.groupBy("host", "path").agg(F.count("*").alias("n"))
    asked = places.select("host", "path", F.explode(keys(F.col("host"), F.col("path"))).alias("key"))
    if bloom:
        blocks = max(1, shape["n"] * BITS_PER_KEY // 64)
        bits = bloom_blocks(listed, blocks)
        asked = (
            asked.withColumn("block", _block(F.col("key"), blocks)).join(small(bits), "block")
            .filter(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select("host", "path", "key")
        )
    rank = F.struct((F.col("host_length") + F.col("path_length")).alias("length"), "host_length", "rule", "verdict")
    best = asked.join(small(listed), "key").groupBy("host", "path").agg(F.max(rank).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
