"""Secret scans: candidates by shape, then a random forest that removes false findings.

Only DataFrame and SQL functions run on the rows: candidates are found, described, voted on and redacted inside one
projection, without a shuffle. A candidate is a run of at least ``MIN`` characters of key alphabets with a digit inside a
word. Features: length, shares of digits, capitals and signs, character transitions, distinct characters, hexadecimal
or not, share of characters covered by dictionary words, kind of path, and words that speak for or against a secret in the
``BEFORE`` characters before the candidate (of its word and the three before that), in it, and in the ``AFTER`` ones after
it in its word.

The forest is Spark's own, trained from labelled findings (by default ``findings``: a fixed number of generated ones of
known kinds, since the tables label none) and compiled to one expression: the share of trees that vote for a secret.

Nulls: a null text is empty and has no candidates; a null path is no path. Rows with null or repeated ids are scanned
each. A text without candidates stays as it is; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN = 16
# Characters read before a candidate, and after it in its word; multiples of MIN, which bounds the matches that they touch.
BEFORE, AFTER = 64, 32
SHAPE = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
FEATURES = ["size", "digits", "capitals", "signs", "transitions", "distinct", "hex", "digits_only", "dictionary", "test_path", "speaks_for", "speaks_against"]
# Fragments of ordinary words, and words around findings.
DICTIONARY = "about after agent application archive author banner before build cache center chapter class client code collection comment common company config content control country data date default demo design detail document domain download error event example figure file filter folder form forum game gallery general global group guide header history home house html image index information internal item john key language letter level library line link list local login main manager market master media member message method model module month name network news number object order page paper part people person photo picture place plugin point policy post press price private problem process product profile project public question read record region report request result review sample school script search section server service session shop site small source state static store story string student study style system table template test text theme thing time title tool topic type update upload user value version video view water web website widget window word work world year".split()
FOR = "secret|token|passw|passwd|pwd|api_?key|apikey|access_?key|private_?key|auth|bearer|credential|signing|client_?id|akia|ghp_|xox[bp]|sk-"
AGAINST = "commit|sha1|sha256|sha-|md5|digest|checksum|hash|uuid|guid|etag|revision|isbn|card|phone|order|invoice|serial|http|www"


def features(value: Column, before: Column, path: Column) -> dict[str, Column]:
    """value: the candidate; before: the text around it, with itself; path: where its text is from."""
    size = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    share = lambda p: F.regexp_count(value, F.lit(p)) / size
    near = F.lower(before)
    return {
        "size": F.least(size, F.lit(200.0)),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "signs": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0)),
        "hex": F.when(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 1.0).otherwise(0.0),
        "digits_only": F.when(value.rlike("^[0-9_\\-/+=]+$"), 1.0).otherwise(0.0),
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")) / size,
        "test_path": F.when(F.coalesce(path, F.lit("")).rlike("(?i)test|example|sample|mock|doc"), 1.0).otherwise(0.0),
        "speaks_for": F.when(near.rlike(FOR), 1.0).otherwise(0.0),
        "speaks_against": F.when(near.rlike(AGAINST), 1.0).otherwise(0.0),
    }


def findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """value, before, path, label: generated findings of fixed kinds, half of them secrets. The same rows each time."""
    d = spark.range(n).withColumn("i", F.col("id").cast("string"))
    hexa, other = F.sha2(F.concat(F.lit("a"), "i"), 256), F.sha2(F.concat(F.lit("b"), "i"), 256)
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("c"), "i"), 512))), "[+/=]", "")
    pick = lambda words, salt: F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int") + 1)
    w1, w2, w3 = (pick(DICTIONARY, s) for s in (1, 2, 3))
    number = F.conv(F.substring(hexa, 1, 14), 16, 10)
    plain = pick(["the", "in", "of", "a thing", "see", "it is", "from", "and here"], 4)
    said = pick(["token =", "secret:", "api_key =", "password =", "Authorization: Bearer", "apikey", "access_key", "auth token", "client_secret", "private_key ="], 5)
    denied = pick(["commit", "sha1", "md5", "checksum", "etag", "digest:", "uuid", "order", "card number", "revision"], 6)
    size = pick([16, 20, 24, 32, 40, 48, 64], 7).cast("int")
    kinds = [  # value, before, label
        (F.substr(hexa, F.lit(1), size), said, 1),
        (F.substr(base, F.lit(1), size), said, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(base, 1, 16))), plain, 1),
        (F.concat(F.lit("ghp_"), F.substring(base, 1, 36)), plain, 1),
        (F.concat(F.lit("sk-"), F.substring(base, 1, 48)), F.concat_ws(" ", plain, F.lit("sk-")), 1),
        (F.upper(F.substr(hexa, F.lit(1), size)), F.upper(said), 1),
        (F.substr(base, F.lit(1), F.greatest(size, F.lit(32))), plain, 1),
        (F.concat(F.lit("xoxb-"), number, F.lit("-"), F.substring(base, 1, 24)), plain, 1),
        (F.substr(hexa, F.lit(1), size), denied, 0),
        (F.substr(hexa, F.lit(1), F.lit(40)), plain, 0),
        (F.lpad(number, 16, "4"), plain, 0),
        (F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(other, 1, 12)), F.concat_ws(" ", plain, pick(["id", "uuid", "in", "the"], 8)), 0),
        (F.concat_ws("_", w1, w2, w3, F.pmod("id", F.lit(97)).cast("string")), pick(["token", "in", "key", "the", "see"], 9), 0),
        (F.concat(w1, F.initcap(w2), F.initcap(w3), F.pmod("id", F.lit(13)).cast("string")), plain, 0),
        (F.concat_ws("/", w1, w2, F.lit("2024"), F.concat(w3, F.lit("-"), F.pmod("id", F.lit(999)).cast("string"))), pick(["http", "www", "in", "from"], 10), 0),
        (F.rpad(F.lit("x"), 24, "x1"), said, 0),
    ]
    which = F.pmod("id", F.lit(len(kinds)))
    chosen = lambda k: reduce(lambda c, i: c.when(which == i, kinds[i][k] if isinstance(kinds[i][k], Column) else F.lit(kinds[i][k])), range(1, len(kinds)), F.when(which == 0, kinds[0][k] if isinstance(kinds[0][k], Column) else F.lit(kinds[0][k])))
    path = pick(["src0", "src7", "lib/a", "test/fixtures", "docs/example", "web"], 11)
    return d.select(chosen(0).alias("value"), F.concat_ws(" ", chosen(1), chosen(0)).alias("before"), path.alias("path"), chosen(2).cast("double").alias("label"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 6, seed: int = 11) -> list[tuple]:
    """A forest as nested (feature, threshold, low, high) with leaves 0.0 and 1.0. labelled: value, before, path, label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    f = features(F.col("value"), F.col("before"), F.col("path"))
    table = labelled.select("label", *(c.cast("double").alias(n) for n, c in f.items())).coalesce(1)
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(table)
    return [_tree(iter(t.toDebugString.splitlines()[1:])) for t in model.trees]


def _tree(lines) -> tuple | float:
    line = next(lines).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _tree(lines)
    next(lines)  # the else
    return FEATURES[int(m[1])], float(m[2]), low, _tree(lines)


def vote(forest: list[tuple], value: Column) -> Column:
    """Share of trees that say secret. value: a struct of features."""

    def one(t) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        return F.when(value[t[0]] <= t[1], one(t[2])).otherwise(one(t[3]))

    return reduce(lambda a, b: a + b, map(one, forest)) / len(forest)


def scan(docs: DataFrame, forest: list[tuple] | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5, mark: str = "<SECRET>", extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_candidates, secrets (array of distinct values, sorted), text (with the secrets replaced by ``mark``), and the
    columns named in ``extra``."""
    forest = train(findings(docs.sparkSession)) if forest is None else forest
    where = F.col(path) if path else F.lit(None).cast("string")
    kept = [F.col(c).alias(f"__{c}") for c in extra or []]
    passed = [f"__{c}" for c in extra or []]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), where.alias("path"), *kept)
    d = d.withColumn("words", F.split("text", r"\s+", -1))
    marked = F.transform("words", lambda w, i: F.when((F.char_length(w) >= MIN) & w.rlike("[0-9]") & w.rlike(SHAPE), i))
    d = d.withColumn("at", F.filter(marked, lambda i: i.isNotNull()))

    def cores(i: Column) -> Column:
        word = F.get("words", i)
        # matches and the text between them, found once for each word
        parts = F.array(F.struct(F.regexp_extract_all(word, F.lit(f"({SHAPE})"), F.lit(1)).alias("found"), F.split(word, SHAPE, -1).alias("gaps")))

        def around(p: Column, v: Column, k: Column) -> Column:
            found, gaps = p["found"], p["gaps"]
            lead = F.concat_ws("", *(x for j in range(BEFORE // MIN, 0, -1) for x in (F.get(gaps, k - j), F.get(found, k - j))), F.get(gaps, k))
            words = [F.when(F.char_length(lead) < BEFORE, F.get("words", i - j)) for j in (3, 2, 1)]
            tail = F.concat_ws("", *(x for j in range(1, AFTER // MIN + 1) for x in (F.get(gaps, k + j), F.get(found, k + j))))
            return F.concat(F.right(F.concat_ws(" ", *words, lead), F.lit(BEFORE)), v, F.left(tail, F.lit(AFTER)))

        each = F.flatten(F.transform(parts, lambda p: F.transform(p["found"], lambda v, k: F.struct(v.alias("value"), around(p, v, k).alias("before")))))
        return F.filter(each, lambda c: c["value"].rlike("[0-9]"))

    d = d.select("doc_id", "text", "path", *passed, F.flatten(F.transform("at", cores)).alias("found"))
    described = F.transform("found", lambda c: F.struct(c["value"].alias("value"), F.struct(*(x.cast("double").alias(n) for n, x in features(c["value"], c["before"], F.col("path")).items())).alias("f")))
    d = d.withColumn("described", described)
    yes = F.transform(F.filter("described", lambda c: vote(forest, c["f"]) >= threshold), lambda c: c["value"])
    d = d.select("doc_id", "text", *passed, F.size("found").cast("long").alias("n_candidates"), F.array_sort(F.array_distinct(yes)).alias("secrets"))
    longest_first = F.array_sort("secrets", lambda a, b: F.char_length(b) - F.char_length(a))
    clean = F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return d.select("doc_id", "n_candidates", "secrets", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")).alias("text"), *(F.col(f"__{c}").alias(c) for c in extra or []))
