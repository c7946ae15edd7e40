"""URL filter: allow/block rules, then logistic regression on hashed character n-grams (operator 2, native).

Everything runs as Spark SQL expressions. The labelled table is made of words that are common in the names of
unwanted sites (gambling, adult, drugs, advertising, piracy, fraud) and of ordinary ones; ``labelled_urls`` puts two of a kind
together under the same endings and paths for both labels, so only names tell them apart. It knows no host of any
table; what it does on hosts it never saw is measured in the tests. Training takes a small labelled URL table (at most
``MAX_LABELS`` rows, picked by hash if there are more), turns each URL's host and path into counts of
hashed 3- and 4-grams and runs full-batch gradient descent inside one ``aggregate`` expression over one
row. Only its ``BUCKETS + 1`` weights reach the driver; scoring is a map-side expression over the URL table
without a shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the
method's verdict for an empty address (the bias); repeated rows are judged alike; empty table, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 8192
GRAMS = (3, 4)
STEPS, RATE, DECAY = 400, 6.0, 0.0003
MAX_LABELS = 2000
#: (host and path start, verdict)
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The labelled table's words.
BLOCK_WORDS = (
    "casino poker slots jackpot roulette blackjack bingo lottery betting bets sportsbook wager gamble gambling spins viagra cialis pills meds "
    "pharmacy steroids weightloss porn porno xxx sex sexy adult nude cams escorts erotic hentai hookup fetish ads adserver adnetwork "
    "banners popups popunder tracker tracking pixel affiliate clicks clickbait spam phishing malware warez cracked keygen torrent pirate serials "
    "hacked scam freemoney prizes winner giveaway bonus fastcash payday loans getrich bitcoin forex replica cheap"
).split()
ALLOW_WORDS = (
    "news times daily journal gazette herald weather museum library university college school academy science physics history "
    "garden kitchen recipes travel health hospital medical law council government parliament music theatre film books "
    "poetry language dictionary encyclopedia wiki archive research institute society foundation community docs developer software "
    "computer engineering football cricket hiking photo gallery market bank railway airport hotel bakery coffee forum maps "
    "river mountain ocean island north paper stars"
).split()
ENDINGS = ("com", "net", "org", "info", "co.uk", "io", "de")
PATHS = ("", "/", "/index.html", "/en/about", "/2021/04/list", "/page/3", "/view/item-8", "/a/b.php")


def _addresses(words: list[str], label: int, each: int) -> list[tuple[str, int]]:
    """Each word alone, then before and after others: ``each`` addresses."""
    out = []
    for k, word in enumerate(words):
        for j in range(each):
            other = words[(7 * k + 3 + 11 * j) % len(words)] if j else ""
            n = each * k + j
            name = f"{other}-{word}" if j % 3 == 2 else word + other
            out.append((f"https://{'www.' * (n % 2)}{name}.{ENDINGS[n % 7]}{PATHS[n % 8]}", label))
    return out


#: The labelled table: 1 block, 0 allow. Most addresses are ordinary: nothing known about a name speaks for it.
LABELLED_URLS = tuple(_addresses(BLOCK_WORDS, 1, 3) + _addresses(ALLOW_WORDS, 0, 9))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. ``rules`` is a fixed list that is part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """array<int>: the bucket of each character n-gram of ``^text$``."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(framed.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(*map(of, GRAMS))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{u}', {y})" for u, y in LABELLED_URLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS) -> list[float]:
    """Weights of the buckets, then the bias, from rows (url, label)."""
    host, path = host_and_path(F.col("url"))
    few = labelled.where("label is not null").orderBy(F.xxhash64("url", "label")).limit(MAX_LABELS)
    rows = few.select(F.col("label").cast("double").alias("y"), gram_buckets(F.concat(host, path), buckets).alias("g"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("y", "g"))).alias("rows"))
    # a row for each labelled URL's n-gram: bounded by MAX_LABELS
    each = one.select(F.posexplode("rows").alias("i", "r")).select(
        "i", F.explode("r.g").alias("j"), (1 / F.sqrt(F.size("r.g"))).alias("x")
    )
    at = each.groupBy("j", "i").agg(F.sum("x").alias("x"))
    bias = one.select(F.posexplode("rows").alias("i", "r")).select(F.lit(buckets).alias("j"), "i", F.lit(1.0).alias("x"))
    at = at.unionByName(bias)
    by_row = at.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("f"))
    ys = one.select(F.posexplode("rows").alias("i", "r")).select("i", "r.y").join(by_row, "i")
    by_row = ys.agg(F.sort_array(F.collect_list(F.struct("i", "y", "f"))).alias("rows"))
    every = labelled.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("j"))
    by_bucket = every.join(at, "j", "left").groupBy("j").agg(
        F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "x")))).alias("at")
    )
    by_bucket = by_bucket.agg(F.sort_array(F.collect_list(F.struct("j", "at"))).alias("cols"))
    step = f"""transform(array(transform(rows, r -> r.y - 1 / (1 + exp(-aggregate(r.f, 0D, (a, p) -> a + w[p.j] * p.x))))),
        e -> transform(cols, c -> w[c.j] * {1 - DECAY} + {RATE} / size(rows) * aggregate(c.at, 0D, (a, p) -> a + e[p.i] * p.x)))[0]"""
    got = by_row.crossJoin(by_bucket).selectExpr(  # one row each
        f"aggregate(sequence(1, {steps}), array_repeat(0D, {buckets + 1}), (w, t) -> {step}) AS w"
    )
    return [float(x) for x in got.first().w]


def block_probability(host: Column, path: Column, weights: list[float]) -> Column:
    """The trained model's probability that an address is to be blocked."""
    buckets = len(weights) - 1
    w = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    grams = gram_buckets(F.concat(host, path), buckets)
    margin = F.aggregate(grams, F.lit(0.0), lambda a, j: a + F.get(w, j)) / F.sqrt(F.greatest(F.size(grams), F.lit(1))) + weights[-1]
    return 1 / (1 + F.exp(-margin))


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability to block)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("said"), block_probability(F.col("host"), F.col("path"), weights).alias("score"))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fit(labelled_urls(spark)))
