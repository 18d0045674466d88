"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join.

Two lists are asked. A list of URLs holds canonical URLs: spellings of one URL are one key. A list of rules holds hosts with paths: a
rule covers its host, all subdomains, and every path that starts with its own; so a URL asks for a few keys: each suffix of its host
with each prefix of its path that ends where a path of the list could. The filter, one 256-bit block per key, lets possible hits
through; the join with the list itself removes the false ones. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of the filter at most (32 bytes each, 16 MB in all): the filter is broadcast, and never grows beyond. A longer list
#: only lets more false hits through to the join.
MOST_BLOCKS = 1 << 19
#: Keys of a block, about: 256 bits with 8 set for each of 16 keys let some 0.2 % of other keys through.
KEYS_PER_BLOCK = 16
WORDS = 4
#: A list of at most so many rows is sent to every task for the join; beyond, both sides are shuffled by key.
MOST_SENT = 20_000

# The rules of the op1 query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The op1 query's list of blocked URLs, made by a rule: so many, on so many hosts.
LISTED, LISTED_HOSTS = 100_000, 977


def blocked_urls(spark: SparkSession) -> DataFrame:
    """The list of the op1 query: column url."""
    return spark.range(LISTED).select(F.concat(F.lit("https://Ads"), F.col("id") % LISTED_HOSTS, F.lit(".example.net:443/click/./"), "id").alias("url"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null and without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _percent(text: Column) -> Column:
    """Percent-encoding in one form: what needs none is decoded, the rest has capital digits. A % without two digits stays."""
    parts = F.split(text, "%")
    code = lambda p: F.upper(F.substring(p, 1, 2))
    plain = lambda p: F.chr(F.conv(code(p), 16, 10).cast("long"))
    own = lambda p: F.substring(p, 3, 1 << 30)
    one = lambda p: (
        F.when(~code(p).rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), p))
        .when(code(p).rlike("^(2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"), F.concat(plain(p), own(p)))
        .otherwise(F.concat(F.lit("%"), code(p), own(p)))
    )
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), one), ""))


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    segments = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    start = F.array().cast("array<string>")
    keep = lambda done, s: (
        F.when(s == ".", done).when((s == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).when(s == "..", done).otherwise(F.concat(done, F.array(s)))
    )
    last = F.element_at(segments, -1)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(segments, start, keep), "/"), F.when((F.size(segments) > 1) & last.isin(".", "..") & (F.size(F.aggregate(segments, start, keep)) > 0), "/").otherwise(""))


def canonical(url: Column) -> Column:
    """One spelling for a URL's spellings: the host in small letters, without user, closing dot and the scheme's own port; the path
    without dot segments and needless percent-encoding; the query; no scheme (http and https are one place) and no fragment. Null for
    a null, without ://, and without a host."""
    part = lambda n: F.regexp_extract(url, r"(?s)^(.*?)://(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:@]*)(:[^/?#]*)?([^?#]*)(\?[^#]*)?", n)
    scheme = F.lower(F.trim(part(1)))
    host = F.rtrim(F.translate(part(2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("."))
    port = F.regexp_replace(part(3), ":0*", "")
    port = F.when((port == "") | (port == "80") & (scheme == "http") | (port == "443") & (scheme == "https"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(part(4) == "", "/").otherwise(_without_dots(_percent(part(4))))
    return F.when(host != "", F.concat(host, port, path, F.when(part(5) == "?", "").otherwise(_percent(part(5)))))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: str) -> list[Column]:
    """Two bits in each of four 64-bit words, from a second hash of the key."""
    h = F.xxhash64(F.lit("bits"), F.col(key))
    out = []
    for w in range(WORDS):
        low = F.pmod(F.shiftrightunsigned(h, 12 * w), F.lit(64)).cast("int")
        high = F.pmod(F.shiftrightunsigned(h, 12 * w + 6), F.lit(64)).cast("int")
        one = F.lit(1).cast("long")
        out.append(F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high)).alias(f"m{w}"))
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column `key`: block and its words m0 to m3. Blocks without keys have no row."""
    bits = keys.select(_block("key", blocks).alias("block"), *_masks("key"))
    return bits.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def may_hold(asked: DataFrame, listed: DataFrame, size: int) -> DataFrame:
    """The rows of asked (column key) that the filter of the listed keys lets through: all that are listed, and a few others."""
    blocks = max(1, min(MOST_BLOCKS, size // KEYS_PER_BLOCK + 1))
    bloom = F.broadcast(bloom_blocks(listed.select("key"), blocks))
    passed = asked.select("*", _block("key", blocks).alias("block"), *_masks("key")).join(bloom, "block")
    for w in range(WORDS):
        passed = passed.where(F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"))
    return passed.select(*asked.columns)


def _candidates(urls: DataFrame, tails: list[int]) -> DataFrame:
    """host, path and key, a row for each key that a rule could have to cover the URL: prefixes of the path that end at a slash, and,
    where rules end within a segment, those that go on from a slash for as many characters as some rule does (tails)."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split("path", "/")
    # Where each segment begins, after its slash; the first, before any slash, is empty.
    begins = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.struct(F.length(F.array_join(F.slice(segments, 1, i - 1), "/")).alias("upto"), F.length(F.get(segments, i - 1)).alias("size"), i.alias("i")))
    slash = lambda b: F.when(b["i"] == 1, F.lit(0)).otherwise(b["upto"] + 1)
    ends = F.transform(begins, slash)
    if tails:
        lengths = F.array(*[F.lit(t) for t in tails])
        ends = F.array_distinct(F.concat(ends, F.flatten(F.transform(begins, lambda b: F.transform(F.filter(lengths, lambda t: t <= b["size"]), lambda t: t + slash(b))))))
    keys = urls.select("host", "path", F.explode(suffixes).alias("suffix"), F.transform(ends, lambda n: F.substring(F.col("path"), F.lit(1), n)).alias("prefixes"))
    return keys.select("host", "path", F.explode("prefixes").alias("prefix"), "suffix").select("host", "path", F.concat("suffix", "prefix").alias("key"), F.length("suffix").alias("n_suffix"))


def _rules_won(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: distinct host and path. host, path, rule and rule_verdict of the longest rule that fits."""
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rules.where("host != '' and path is not null and verdict is not null").select(lower.alias("host"), "path", "verdict").withColumn("key", F.concat("host", "path"))
    # A key may be split into host and path in one way only, as a path starts with / or is empty; the host's length makes sure.
    listed = listed.groupBy("key", F.length("host").alias("n_suffix")).agg(F.min("verdict").alias("rule_verdict"), F.first("path").alias("path"))
    tail = F.length(F.regexp_extract("path", r"(?s)([^/]*)\z", 1))
    known = listed.agg(F.count("*").alias("n"), F.collect_set(F.when(tail > 0, tail)).alias("tails")).first()
    listed = listed.drop("path")
    passed = may_hold(_candidates(urls, sorted(known.tails)), listed, known.n)
    exact = F.broadcast(listed) if known.n <= MOST_SENT else listed
    hits = passed.join(exact, ["key", "n_suffix"])
    longest = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "n_suffix", F.col("key").alias("rule"), "rule_verdict")).alias("won"))
    return longest.select("host", "path", "won.rule", "won.rule_verdict")


def in_list(urls: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct canonical URLs (column key) of urls that the list has. Both have a column url_col; nulls, and what is no URL, are
    never listed. Spellings of one URL are one row; an empty list or table gives no rows."""
    keys = lambda df: df.select(canonical(F.col(f"`{url_col}`")).alias("key")).where("key is not null").distinct()
    own = keys(listed)
    size = own.count()
    exact = F.broadcast(own) if size <= MOST_SENT else own
    return may_hold(keys(urls), own, size).join(exact, "key", "left_semi")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", listed: DataFrame | None = None) -> DataFrame:
    """The columns of keep, host, path, rule (null: none fits) and verdict, for every row.

    rules: host, path and verdict; repeats of a rule count once (the least verdict), one with a null or without a host is no rule. The
    longest rule that fits wins, by host and path together. A URL that no rule fits is blocked if the list (column url) has it, else
    it has the default verdict, as has a null or one without `://`, whose host and path are empty. Equal URLs are judged once; a URL
    that fills a third of the table is one row until the last joins, whose large side Spark splits, and rows without a host are dealt
    out by chance there. Long URLs are looked at whole; an empty table gives no rows; other columns may have any names.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    url = F.col(f"`{url_col}`")
    columns = [*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], host_of(url).alias("host"), path_of(url).alias("path")]
    rows = urls.select(*columns, *([canonical(url).alias("__url")] if listed is not None else []))
    chance = lambda c: F.when(c, F.pmod(F.monotonically_increasing_id(), F.lit(1000))).otherwise(F.lit(0))
    won = _rules_won(rows.select("host", "path").where("host != ''").distinct(), rules).withColumn("__salt", F.lit(0).cast("long"))
    judged = rows.withColumn("__salt", chance(F.col("host") == "")).join(won, ["host", "path", "__salt"], "left")
    verdict = F.coalesce("rule_verdict", F.lit(default))
    if listed is not None:
        found = in_list(urls, listed.select(F.col("url").alias(url_col)), url_col).select(F.col("key").alias("__url"), F.lit(True).alias("__listed"), F.lit(0).cast("long").alias("__salt"))
        judged = judged.withColumn("__salt", chance(F.col("__url").isNull())).join(found, ["__url", "__salt"], "left")
        verdict = F.coalesce("rule_verdict", F.when(F.col("__listed"), "block"), F.lit(default))
    return judged.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "host", "path", "rule", verdict.alias("verdict"))
