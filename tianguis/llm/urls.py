"""URL filter: rules, and gradient-boosted trees on lexical features for the rest.

A rule is a host and a path prefix; it fits its host and all subdomains, and the
longest fitting rule decides. URLs that a rule decides are the labelled ones. From them the trees
learn to tell blocked from allowed by length, depth, digit ratio, entropy,
parameter counts and statistics of suffixes: of the host's last one to three labels and of the
path's ending, the share of blocked URLs among the labelled ones, drawn towards the overall share.

A labelled URL is left out of its own statistics: URLs are dealt to ``FOLDS`` folds by a hash, and a
labelled one sees the labelled ones of the other folds. A suffix whose labelled URLs were all decided by
one rule has no statistic, as that would only repeat the rule.

The trees are fitted to about ``TRAIN_ROWS`` labelled URLs, chosen by a hash; suffix statistics
count all labelled URLs. With only one class among the labelled URLs that class is the verdict,
with none every undecided URL is allowed.

A null URL, or one without ://, has an empty host and path. Repeated rows are returned
each and count each. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import cut, table

#: Fixed rules.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
TRAIN_ROWS = 50_000
TREES = 12
TREE_DEPTH = 4
#: Weight of the overall share in a suffix's statistic, in URLs.
PRIOR = 20
FOLDS = 5
SEED = 7

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "has_extension"]
SUFFIXES = ["suffix1", "suffix2", "suffix3", "ending"]
FEATURES += [f"{s}_{what}" for s in SUFFIXES for what in ("rate", "log")]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path): the host after the first ://, the path after it."""
    at = F.instr("u", "://")
    rest = F.when(at > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    p = pages.select("page_id", "url", F.coalesce("url", F.lit("")).alias("u")).withColumn("rest", rest)
    p = p.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0)
    return p.select("page_id", "url", F.translate("raw", UPPER, LOWER).alias("host"), path.alias("path"))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def lexical(p: DataFrame) -> DataFrame:
    """Features of the URL string; the entropy counts printable ASCII characters
    one by one and all others together, so its cost is linear in the length."""
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length("u"), F.lit(1))
    part = "({0} / n) * ln({0} / n)"
    times = "(length(u) - length(replace(u, chr(c), '')))"
    entropy = f"-aggregate(sequence(33, 126), 0D, (s, c) -> s + CASE WHEN {times} > 0 THEN {part.format(times)} ELSE 0D END)"
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    return p.withColumn("u", u).withColumn("n", n).withColumns({
        "url_length": F.length("u").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
        "labels": (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).cast("double"),
        "digit_ratio": (F.length("u") - F.length(F.translate("u", "0123456789", ""))) / F.col("n"),
        "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
        "entropy": F.expr(entropy),
        "parameters": F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")),
        "has_fragment": F.contains("u", F.lit("#")).cast("double"),
        "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix1": F.substring_index("host", ".", -1),
        "suffix2": F.substring_index("host", ".", -2),
        "suffix3": F.substring_index("host", ".", -3),
        "ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,5}|/|)$", 1),
    }).drop("u", "n")


def with_suffix_statistics(p: DataFrame, overall: float) -> DataFrame:
    """Blocked share and (log) number of labelled URLs per suffix, without those of a labelled row's own
    fold. The join is left to the sizes at run time: suffixes may be many."""
    decided = F.col("decided").isNotNull()
    p = p.withColumn("fold", F.when(decided, F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    for s in SUFFIXES:
        def per_fold(what: Column) -> Column:
            return F.array(*[F.sum(F.when(F.col("fold") == k, what).otherwise(0)) for k in range(FOLDS)])

        stats = p.filter(decided).groupBy(s).agg(F.min("rule").alias("r0"), F.max("rule").alias("r1"), F.sum("blocked").alias("b"), F.count("*").alias("m"),
                                                 per_fold(F.col("blocked")).alias("bs"), per_fold(F.lit(1)).alias("ms")).filter("r0 <> r1")
        at = F.col("fold") + 1
        b, m = F.col("b") - F.coalesce(F.element_at("bs", at), F.lit(0)), F.col("m") - F.coalesce(F.element_at("ms", at), F.lit(0))
        p = p.join(stats.drop("r0", "r1"), s, "left").withColumns({
            f"{s}_rate": F.coalesce((b + overall * PRIOR) / (m + PRIOR), F.lit(overall)),
            f"{s}_log": F.coalesce(F.log1p(m.cast("double")), F.lit(0.0))}).drop("b", "m", "bs", "ms")
    return p.drop("fold")


def prepared(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The pages with host, path, lexical features, rule, the rule's verdict (decided) and whether it blocks."""
    rule, decided = rule_of(rules)
    p = lexical(parsed(pages)).withColumns({"rule": rule, "decided": decided})
    return p.withColumn("blocked", (F.col("decided") == "block").cast("double"))


def classes(p: DataFrame) -> dict[str, int]:
    return {r["decided"]: r["n"] for r in p.filter("decided IS NOT NULL").groupBy("decided").agg(F.count("*").alias("n")).collect()}


def with_features(p: DataFrame, known: dict[str, int]) -> DataFrame:
    """The rows with all features, written and assembled to vectors."""
    columns = ["page_id", "url", "host", "path", "rule", "decided", "blocked"]
    rows = cut(with_suffix_statistics(p, known["block"] / sum(known.values())).select(*columns, *FEATURES), "urls")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def fitted(rows: DataFrame, labelled: int, train_rows: int = TRAIN_ROWS) -> GBTClassificationModel:
    """Trees fitted to about ``train_rows`` of the ``labelled`` decided rows."""
    share = min(1.0, train_rows / max(labelled, 1))
    train = rows.filter(F.col("decided").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("features", "blocked")
    return GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=TREES, maxDepth=TREE_DEPTH, seed=SEED).fit(train.coalesce(8))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    p = prepared(pages, rules)
    known, out = classes(p), ["page_id", "host", "path", "rule"]
    if len(known) < 2:
        return p.select(*out, F.coalesce("decided", F.lit(next(iter(known), "allow"))).alias("verdict"))
    rows = with_features(p, known)
    said = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return fitted(rows, sum(known.values()), train_rows).transform(rows).select(*out, F.coalesce("decided", said).alias("verdict"))


def held_out_accuracy(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """n and accuracy on the labelled URLs of one host in five, by trees that saw neither them nor any other
    URL of their hosts, and the share of the larger class among them (what a constant verdict reaches)."""
    p = prepared(pages, rules).withColumn("apart", F.pmod(F.xxhash64("host"), F.lit(5)) == 0)
    seen = p.withColumn("label", F.col("blocked")).withColumns({c: F.when(~F.col("apart"), F.col(c)) for c in ("decided", "blocked")})
    known = classes(seen)
    if len(known) < 2:
        return p.limit(0).select(F.lit(0).alias("n"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("constant"))
    rows = with_features(seen, known)
    test = p.filter("apart AND decided IS NOT NULL").select("page_id", "url", F.col("blocked").alias("label"))
    got = fitted(rows, sum(known.values()), train_rows).transform(rows).join(test, ["page_id", "url"])
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return got.agg(F.count("*").alias("n"), right.alias("accuracy"), F.greatest(F.avg("label"), 1 - F.avg("label")).alias("constant"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
