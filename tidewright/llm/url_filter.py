"""URL filter: rules first, then logistic regression on hashed character n-grams.

DataFrame operations only.  Host and path n-grams are hashed by crc32 into a fixed number
of buckets; a small labelled URL table gives the weights (plain gradient descent on the
driver over that table alone, whose size is checked); the weights are one constant array
in the scoring expression, so judging a table is a single scan without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.storage import need, read_table

BUCKETS = 4096
SIZES = (3, 4, 5)
MAX_LABELLED = 20_000
THRESHOLD = 0.5
#: (host suffix, path prefix, verdict) of the production query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Words of unwanted and of plain sites, as anyone would list them; the labelled table of the production query
#: is spelled out from these, from usual endings and from usual paths.
UNWANTED = "casino poker slots jackpot roulette betting bingo lottery viagra cialis pharmacy pills dietpill steroid xxx porn adult escort webcam hookup torrent crack keygen warez serial payday loan credit forex bitcoin profit giveaway prize coupon replica handbag popup adserver tracker clickbait".split()
PLAIN = "news journal times museum library archive school university science history geography garden kitchen recipes travel hiking weather music theatre cinema literature poetry chess football cycling health clinic council parliament ministry court forum wiki docs developer software hardware astronomy".split()
UNWANTED_PATHS = ("/bonus/claim-now", "/buy-cheap?aff=77", "/win/free-spins", "/click.php?id=9", "/offer/limited/")
PLAIN_PATHS = ("/about", "/article/2041", "/archive/2019/05/", "/contact.html", "/guide/introduction")
#: Paths that occur with both labels, so that they say nothing.
SHARED_PATHS = ("", "/", "/index.html", "/en/", "/page?id=3")
TOPS = ("com", "net", "org", "info", "co.uk")
FRONTS = ("", "www.", "m.", "blog.")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted): hosts of one or two words of a list, with either list's paths."""
    rows = []
    for words, paths, bad in ((UNWANTED, UNWANTED_PATHS, 1), (PLAIN, PLAIN_PATHS, 0)):
        n = len(words)
        for i, word in enumerate(words):
            for k in range(10):
                other = words[(i + 1 + 3 * k) % n]
                host = (word, f"{word}-{other}", f"{word}{other}", f"the{word}", f"{other}{k}{word}")[k % 5]
                path = SHARED_PATHS[(i + k) % 5] if k % 2 else paths[(i + k // 2) % 5]
                rows.append((f"http{'s' * (k // 5)}://{FRONTS[(i + k) % 4]}{host}.{TOPS[(i * 3 + k) % 5]}{path}", bad))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where the host is undefined."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bucket_of(text: Column, n: int, buckets: int):
    return lambda i: (F.crc32(F.encode(F.substring(text, i, F.lit(n)), "UTF-8")) % buckets).cast("int")


def ngram_buckets(host: Column, path: Column, buckets: int = BUCKETS, sizes=SIZES) -> Column:
    """Buckets of all n-grams of ``<host>`` and ``[path]``; the marks keep both apart."""
    grams = []
    for text in (F.concat(F.lit("<"), host, F.lit(">")), F.concat(F.lit("["), path, F.lit("]"))):
        for n in sizes:
            at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(at, _bucket_of(text, n, buckets)))
    return F.concat(*grams)


def train(labelled: DataFrame, buckets: int = BUCKETS, sizes=SIZES, epochs: int = 60, rate: float = 4.0, l2: float = 1e-5) -> list[float]:
    """Weights (bias last) from a table (url, label); more than MAX_LABELLED rows are refused.

    Rows with a null label are left out, a null url is an URL without n-grams.  Without rows
    all weights are 0, which scores everything 0.5."""
    need(labelled, "url", "label")
    rows = labelled.where("label IS NOT NULL").select("label", "url", ngram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets, sizes).alias("g")).orderBy("url", "label").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    weights, grams = [0.0] * (buckets + 1), []
    for r in rows:
        counts: dict[int, int] = {}
        for b in r["g"]:
            counts[b] = counts.get(b, 0) + 1
        total = max(1, len(r["g"]))
        grams.append(([(b, c / total) for b, c in counts.items()], float(r["label"])))
    for epoch in range(epochs):
        step = rate / (1 + epoch / 20)
        for features, label in grams[epoch % 2 :: 1] + grams[: epoch % 2]:
            z = weights[buckets] + sum(weights[b] * x for b, x in features)
            error = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            weights[buckets] += 0.1 * step * error
            for b, x in features:
                weights[b] += step * (error * x * 10 - l2 * weights[b])
    return weights


def url_score(host: Column, path: Column, weights: list[float], sizes=SIZES) -> Column:
    """Probability that the URL is unwanted."""
    buckets = len(weights) - 1
    table = F.split(F.lit(",".join(repr(w) for w in weights[:buckets])), ",").cast("array<double>")
    grams = ngram_buckets(host, path, buckets, sizes)
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(total / F.greatest(F.size(grams), F.lit(1)) + F.lit(weights[buckets]))))


def judge(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score added (an input's own columns of these
    names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's path; of several
    the longest wins, of equally long ones the first given.  Without a fitting rule the model
    decides: block at ``threshold`` or more.  A null url has an empty host and path.  Rows are judged one by
    one: repeated rows stay repeated, an empty table gives an empty result."""
    need(pages, "url")
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest is tested first, so it is outermost; of equally long ones the first given.
    for host, path, says in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    rows = rows.withColumn("score", url_score(F.col("host"), F.col("path"), weights))
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow"))})


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = train(spark.createDataFrame(labelled_urls(), "url string, label int"))
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict", "score")
