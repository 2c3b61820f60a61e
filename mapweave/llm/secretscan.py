"""Secret scans whose false positives a random forest removes, in Spark's own functions only.

Candidates are runs of at least 16 of ``A-Za-z0-9_+/.-``. A forest scores them by length, changes of character class, shares of
classes, coverage by dictionary words, what their path says and the words next to them. It is trained on labelled
findings: candidates whose form or neighbourhood settles what they are (``finding_label``), or labels a caller has. At most
about ``per_label`` of each label are taken, by hash. Issuer prefixes and values are no features, so the forest also judges
candidates that no rule labels.

Null and empty texts have no candidates. Without findings of both labels the labelled positives alone are reported. Equal rows have
equal findings; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import materialize
from mapweave.llm.pii import places

PATTERN = r"(?<![\p{L}\p{N}_+/.-])[A-Za-z0-9_+/.-]{16,}+={0,2}"
NEAR = 32
PER_LABEL = 4000
#: Words that occur inside of identifiers, hosts, paths and file names but not in random strings.
DICTIONARY = (
    "example", "mail", "http", "www", "com", "org", "net", "license", "version", "test", "user", "name", "file", "path", "data", "index",
    "page", "image", "html", "main", "class", "function", "return", "public", "value", "config", "default", "system", "server", "client",
    "tion", "ing", "the", "and", "ment", "heit", "keit", "ung", "eaux", "elle", "que", "mente", "cion", "lich", "schaft", "ed", "er", "on",
    "en", "th", "re", "sh", "an", "le", "de", "ou", "es", "st", "nd", "ha", "at", "or", "in", "ch", "ar", "os", "as", "la",
)
KEYWORD = r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
ISSUED = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35})$"
FEATURES = ("size", "changes", "digits", "uppers", "lowers", "different", "covered", "assigned", "quoted", "keyword", "mail", "test_path", "config_path")


def candidates(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, hash (of the text), start, stop, value, before, after (its neighbourhood), path."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("hash"), whole.alias("text"),
                       (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"),
                       F.when(whole.rlike(PATTERN), places(whole, PATTERN)).alias("found"))
    rows = rows.where(F.size("found") > 0).select("key", "hash", "text", "path", F.explode("found").alias("f"))
    first = F.greatest(F.col("f.start") - NEAR, F.lit(0))
    return rows.select("key", "hash", "f.start", "f.stop", "f.value", "path",
                       F.substr("text", first + 1, F.col("f.start") - first).alias("before"), F.substr("text", F.col("f.stop") + 1, F.lit(NEAR)).alias("after"))


def with_features(found: DataFrame) -> DataFrame:
    v, n = F.col("value"), F.char_length("value").cast("double")
    share = lambda kind: F.char_length(F.regexp_replace(v, f"[^{kind}]", "")) / n
    path = F.coalesce("path", F.lit(""))
    return found.withColumns({
        "size": n,
        "changes": (F.regexp_count(v, F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n,
        "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"),
        "different": F.size(F.array_distinct(F.split(v, ""))) / n,
        "covered": 1 - F.char_length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "keyword": F.col("before").rlike(KEYWORD).cast("double"),
        "mail": (F.col("before").rlike("@$") | F.col("after").rlike("^@") | F.col("before").rlike("://$")).cast("double"),
        "test_path": path.rlike("(?i)test|example|sample|docs?/").cast("double"),
        "config_path": path.rlike(r"(?i)\.env|config|settings|secrets?").cast("double"),
    })


def finding_label() -> Column:
    """1 for forms that issuers document and for mixed values assigned to a keyword; 0 for parts of addresses, plain words and plain numbers; else null."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return (
        F.when(value.rlike(ISSUED), 1)
        .when(before.rlike("@$") | after.rlike("^@") | before.rlike("://$"), 0)
        .when(mixed & before.rlike(KEYWORD + r"\s*[=:]\s*[\"']?$"), 1)
        .when(value.rlike(r"^[A-Za-z.-]+$") | value.rlike(r"^[0-9.+/-]+=*$"), 0)
    )


def scan(docs: DataFrame, key: str, text: str, path: str | None = None, label: Column | None = None, per_label: int = PER_LABEL,
         threshold: float = 0.5, trees: int = 20, depth: int = 6, seed: int = 13) -> DataFrame:
    """Scored candidates: key, hash, start, stop, value, label (null if not settled), score and secret (score at or above the threshold)."""
    found = materialize(with_features(candidates(docs, key, text, path)).withColumn("label", finding_label() if label is None else label))
    counts = {r["label"]: r["count"] for r in found.where("label IS NOT NULL").groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return found.withColumn("score", (F.col("label") == 1).cast("double")).fillna(0.0, ["score"]).select(
            "key", "hash", "start", "stop", "value", "label", "score", (F.col("score") >= threshold).alias("secret"))
    place = F.pmod(F.xxhash64(F.lit(seed), "value", "before", "after"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    sample = found.where("label IS NOT NULL").withColumn("_place", place).where(F.col("_place") < share).orderBy("_place", "value").limit(3 * per_label)
    # one partition of bounded size: the forest's bags don't depend on how the findings lay
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    training = materialize(vectors.transform(sample).select("features", F.col("label").cast("double").alias("label")).coalesce(1))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(training)
    scored = forest.transform(vectors.transform(found).withColumnRenamed("label", "settled"))
    return scored.select("key", "hash", "start", "stop", "value", F.col("settled").alias("label"),
                         vector_to_array("probability")[1].alias("score")).withColumn("secret", F.col("score") >= threshold)


def report(docs: DataFrame, scored: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``docs``: ``key``, candidates, secrets, spans (start:stop of the secrets) and top_score (null without candidates)."""
    once = scored.dropDuplicates(["key", "hash", "start"])  # rows that are repeated share their findings
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("secret"), F.struct("start", "stop")))),
                                     lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    found = once.groupBy("key", "hash").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("secret").alias("secrets"), spans.alias("spans"), F.max("score").alias("top_score"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    both = rows.alias("l").join(found.alias("r"), F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.hash") == F.col("r.hash")), "left")
    return both.select(F.col("l.key").alias(key), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
                       F.coalesce("secrets", F.lit(0)).cast("long").alias("secrets"), F.coalesce("spans", F.lit("")).alias("spans"), "top_score")
