"""URL filters, with DataFrame operations only: a rule list, and rules mined from labelled URLs.

Spark's FP-growth finds the combinations of URL tokens that go with blocked
pages often enough; those with enough confidence become rules. A rule is filed
under its rarest token, and a URL's token set is compared only with the rules
filed under one of its tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.runtime import picked, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = "#(.*)"
NUMBER = "/([0-9]+)"
BLOCKED = "=block"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens in order: host labels, path segments with numbers as `0`, query keys, the fragment."""
    url = F.coalesce(url, F.lit(""))

    def some(parts: Column, prefix: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(prefix), p))

    query = F.split(F.regexp_extract(url, QUERY, 1), "&", -1)
    found = F.concat(
        some(F.split(host_of(url), r"\.", -1), "h:"),
        some(F.split(F.regexp_replace(path_of(url), "[0-9]+", "0"), "/", -1), "p:"),
        some(F.transform(query, lambda q: F.regexp_extract(q, "^([^=]*)", 1)), "q:"),
        some(F.array(F.regexp_extract(url, FRAGMENT, 1)), "f:"),
    )
    return F.array_sort(F.array_distinct(found))


def _token_classes(rows: DataFrame, least: int) -> DataFrame:
    """`token` and `members`: tokens that exactly the same rows have, under the least of them.

    Only tokens that `least` blocked rows have. Row sets are compared by their size
    and two 64-bit sums of row hashes; a class has no more members than one row.
    """
    rows = rows.withColumn("token", F.explode("tokens"))
    wide = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    found = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad"), *wide)
    merged = found.where(F.col("bad") >= least).groupBy("n", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return written(merged.select(F.col("members")[0].alias("token"), "members"), "url-classes")


def mine_rules(
    labelled: DataFrame, min_count: int = 10, min_share: float = 0.0005, min_confidence: float = 0.6, max_items: int | None = None
) -> DataFrame:
    """Rules (`items`, `members`, `anchor`, `count`, `confidence`) from rows (`tokens`, `blocked`).

    Kept are combinations of tokens, of `max_items` or fewer if given, that at least
    `min_count` blocked rows and a share of `min_share` of all rows have, and of whose
    rows `min_confidence` or more are blocked. `anchor` is the rarest token.

    k tokens that always come together would give 2^k - 1 combinations with the
    same rows. They are one item, named by the least of them; `members` lists for
    each item the tokens that may stand for it. Null tokens or sets count as absent,
    a null `blocked` as false, repeated rows each; an empty table gives no rule.
    """
    spark = labelled.sparkSession
    tokens = F.array_distinct(F.array_compact(F.coalesce("tokens", F.array().cast("array<string>"))))
    rows = labelled.select(
        F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked")
    )
    # written, so that row numbers stay the same
    rows = written(rows, "url-labelled")
    n = rows.count()
    if not n:
        kind = "items array<string>, members array<array<string>>, anchor string, count long, confidence double"
        return spark.createDataFrame([], kind)
    least = max(min_count, -int(-min_share * n // 1))
    classes = _token_classes(rows, least)
    named = rows.select("row", F.explode("tokens").alias("token")).join(classes.select("token"), "token", "left_semi")
    items = named.groupBy("row").agg(F.collect_list("token").alias("items"))
    blocked = F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))
    baskets = rows.select("row", blocked.alias("verdict")).join(items, "row", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), "verdict").alias("items")
    )
    # half a row less than the count, so that rounding cannot raise the bound
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=0.0).fit(baskets)
    sets = written(model.freqItemsets, "url-itemsets")
    sets = sets.select(F.array_sort("items").alias("items"), F.col("freq"))
    bad = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(
        F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("count")
    )
    rules = (
        (bad if max_items is None else bad.where(F.size("items") <= max_items))
        .join(sets, "items")
        .withColumn("confidence", F.col("count") / F.col("freq"))
        .where(F.col("confidence") >= min_confidence)
    )
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("rows"))
    filed = (
        rules.withColumn("token", F.explode("items"))
        .join(single, "token")
        .join(classes, "token")
        .groupBy("items", "count", "confidence")
        .agg(
            F.min_by("token", F.struct("rows", "token")).alias("anchor"),
            F.array_sort(F.collect_list(F.struct("token", "members"))).alias("parts"),
        )
    )
    return written(filed.select("items", F.col("parts.members").alias("members"), "anchor", "count", "confidence"), "url-rules")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the distinct sets in `tokens` that have a member of each item of a rule, found by the members of the anchor."""
    asked = token_sets.select("tokens", F.explode("tokens").alias("key"))
    place = F.array_position("items", F.col("anchor")).cast("int")
    filed = rules.select("members", F.explode(F.element_at("members", place)).alias("key"))
    fits = F.forall("members", lambda m: F.arrays_overlap(m, F.col("tokens")))
    return asked.join(filed, "key").where(fits).select("tokens").distinct()


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for of, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def labelled_urls(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs whose first number in the path is a labelled document: `tokens`, `blocked` (poor quality or toxic)."""
    urls = picked(pages, url=url_col).select("url", F.regexp_extract(path_of(F.col("url")), NUMBER, 1).alias("number"))
    known = picked(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    known = known.groupBy(F.col("doc_id").cast("string").alias("number")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("blocked")
    )
    return urls.join(known, "number").select(tokens_of(F.col("url")).alias("tokens"), "blocked")


def judge_urls(
    pages: DataFrame, rules: DataFrame, listing: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """`page_id`, `host`, `path`, `rule` (of the list, or null), `verdict`: the list's, else block if a mined rule matches.

    One output row per input row; a null URL, or one without `://`, has an empty
    host and path, fits no rule of the list and is allowed unless its other
    tokens match; other columns are left out. Repeated rows are each judged, an empty
    table gives an empty result. Rows are compared once per distinct
    token set, so a URL form that most rows share is matched once.
    """
    rows = picked(pages, page_id=id_col, url=url_col)
    rows = rows.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")
    ).withColumn("by_list", listed(F.col("host"), F.col("path"), listing))
    sets = rows.where("by_list is null").select("tokens").distinct()
    # written first: adaptive execution splits a large key only between two plain exchanges
    hits = written(matched(sets, rules).withColumn("hit", F.lit(True)), "url-hits")
    return rows.join(hits, "tokens", "left").select(
        "page_id", "host", "path", F.col("by_list.rule").alias("rule"),
        F.coalesce(F.col("by_list.verdict"), F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
