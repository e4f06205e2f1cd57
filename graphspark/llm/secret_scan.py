"""Secret scans with a random forest that removes false positives (operator 1), with DataFrame functions and Spark ML alone.

Candidates are places of a text, found in one pass over each word (a run is tried at its first character only, so the time is linear
in the text, whatever its runs):

* maximal runs of ``RUN`` or more letters, digits and key characters that hold a digit, and of ``LONG_RUN`` or more without one;
* values of ``VALUE`` or more characters right behind a key word (in the same word or the next two);
* the end of the header of a private key (its body is a row of runs).

A word may hold several: each has for context its own field, back to a comma, semicolon, ampersand or the candidate before, and the
words beside it where it is the first or last. Features are length, transitions between character classes, shares of classes, repeated
characters, dictionary coverage, path features of the word and of the document's path, and the words beside it. Dictionary coverage is
the share of a candidate's ``GRAM``-letter windows that stand in a word of a public vocabulary (a parameter; its windows are a table of
``MAX_GRAMS`` rows at most, checked, and broadcast), so that joined words count and random letters don't. A random forest fitted on
labelled findings gives each a score; findings under ``LEAST`` are dropped as false positives.

Labelled findings are a table (the features and ``label``). The query has none, so ``weak_labels`` makes them from fixed formats of keys,
numbers, addresses and links on a sample drawn by hash, ``TRAIN_ROWS`` findings at most in expectation (a documented bound); every
candidate of every text is scored. Known formats are no features of the forest, so it also finds what no format tells:
``held_out_formats`` fits without one format's findings at a time and says how many of them are found all the same. A value without
digits that a key word but no sign of assignment introduces is ordinary prose, and labelled so.

Edge cases: null and empty texts have no candidate; a run of any length is one candidate; a candidate is found once for each place;
repeated rows and null ids are rows of their own; ties in score don't matter, as no rank is taken; where labels hold one class alone,
that class is the prediction; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fraction_of

RUN, LONG_RUN, VALUE, GRAM, MAX_GRAMS, TRAIN_ROWS, LEAST, TREES, DEPTH, SEED = 12, 20, 8, 4, 26**4, 20_000, 0.5, 24, 6, 7
_SIGN, _NO_DIGIT = r"[A-Za-z0-9+/_=.@:\-]", r"[A-Za-z+/_=.@:\-]"
#: A maximal run: tried at its first character, read on to its first digit and then to its end, without going back.
_CANDIDATE = rf"(?<!{_SIGN})(?:(?={_NO_DIGIT}*+[0-9]){_SIGN}{{{RUN},}}+|{_SIGN}{{{LONG_RUN},}}+)"
#: Words beside a value that speak of secrets.
KEY_WORDS = "password passwd pwd secret token apikey api_key api-key access_key private_key credential credentials auth bearer key".split()
_BETWEEN = r"[\x02\x20-%'-+\--/:<-@\[-^`{-~]"  # ASCII signs and the space, without what parts fields
_KEYED = rf"(?i:{'|'.join(KEY_WORDS)}){_BETWEEN}{{1,6}}"
_VALUE = rf"(?![=:>])[^\x00-\x20\x7F\"'`,;&<>(){{}}\[\]\\]{{{VALUE},}}"
#: Signs around a finding, and the one between a word and the last characters of the two words before it; in texts they become ``_OTHER``.
_OPEN, _CLOSE, _EDGE, _OTHER, _BEFORE = "\1", "\3", "\2", "\4", 40
_FINDING = rf"{_CANDIDATE}|(?<={_KEYED}){_VALUE}+|(?<=PRIVATE {_EDGE})KEY-----"
#: Formats for weak labels. The first that fits decides.
FORMATS = [
    (0, r"@[A-Za-z0-9\-]+\.[A-Za-z]"), (0, r"^\W*(https?:|www\.)"), (0, r"^\W*[0-9]{1,3}(\.[0-9]{1,3}){3}\W*$"), (0, r"^[\W0-9]*$"),
    (1, r"AKIA[A-Z0-9]{16}"), (1, r"gh[pousr]_[A-Za-z0-9]{36}"), (1, r"xox[abprs]-[A-Za-z0-9\-]{10,}"), (1, r"sk[_\-](live_)?[A-Za-z0-9]{20,}"),
    (1, r"PRIVATE KEY-----$"), (1, r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"), (1, r"(?i)(password|passwd|pwd|secret|token|api_?key)\W{1,3}[^\s]{8,}"), (1, r"^\W*[0-9a-f]{40}\W*$"),
]
NUMERIC = ["length", "transitions", "digits", "uppers", "lowers", "others", "hex", "repeats", "dictionary", "slashes", "dots", "at", "path_length", "path_digits", "key_inside", "key_before", "key_after", "assigned", "before_length", "after_length"]


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, word_index, finding, word, the words beside it, and path; one row a place."""
    place = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", place.alias("path"), "text", F.col("text").rlike(rf"(?i:{'|'.join(KEY_WORDS)})[\x09-\x2F:-@\[-^`{{-~]").alias("keyed")).where(F.col("keyed") | F.col("text").rlike(_CANDIDATE))
    words = rows.select("doc_id", "path", "keyed", F.split(F.trim(F.regexp_replace(F.translate("text", _OPEN + _CLOSE + _EDGE, _OTHER * 3), r"[\x20\x09-\x0D]+", " ")), " ").alias("words"))
    word = lambda i: F.get("words", i)
    joined = lambda i: F.concat(F.right(F.concat_ws(" ", word(i - 2), word(i - 1)), F.lit(_BEFORE)), F.lit(f" {_EDGE}"), word(i))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.length(word(i)) >= VALUE) & (((F.length(word(i)) >= RUN) & word(i).rlike(_CANDIDATE)) | (F.col("keyed") & joined(i).rlike(_FINDING))))
    near = lambda i, name: F.coalesce(word(i), F.lit("")).alias(name)
    each = words.select("doc_id", "path", F.explode(F.transform(at, lambda i: F.struct(i.cast("long").alias("word_index"), near(i - 2, "before2"), near(i - 1, "before"), near(i + 1, "after"), joined(i).alias("joined")))).alias("w")).select("doc_id", "path", "w.*")
    # Each finding is put between two signs; what is found before the word's edge belongs to other words.
    marked = F.substring_index(F.regexp_replace("joined", _FINDING, f"{_OPEN}$0{_CLOSE}"), _EDGE, -1)
    parts = each.withColumn("parts", F.split(marked, _OPEN)).where(F.size("parts") > 1)
    part, last = (lambda k: F.get("parts", k)), F.size("parts") - 1
    found = F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(F.substring_index(part(k), _CLOSE, 1).alias("finding"), F.substring_index(part(k - 1), _CLOSE, -1).alias("lead"), (k == 1).alias("is_first"), (k == last).alias("is_last")))
    found = parts.select("doc_id", "word_index", "path", "before2", "before", "after", F.explode(found).alias("f")).select("*", "f.*")
    first = F.col("is_first") & ~F.col("lead").rlike("[,;&]")
    beside = lambda name, near_it: F.when(near_it, F.col(name)).otherwise("").alias(name)
    return found.select("doc_id", "word_index", "path", F.concat(F.regexp_extract("lead", "[^,;&]*+$", 0), "finding").alias("word"), beside("before2", first), beside("before", first), beside("after", F.col("is_last")), "finding")


def dictionary_grams(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """The ``GRAM``-letter windows of the whole words of a public vocabulary (by default ``word_bpe_49k.json``), one row each."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as f:
        words = [w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")]
    grams = sorted({w[i : i + GRAM] for w in words if w.isascii() and w.isalpha() and w.islower() for i in range(len(w) - GRAM + 1)})
    if len(grams) > MAX_GRAMS:
        raise ValueError(f"{len(grams)} windows; {MAX_GRAMS} at most")
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(grams)), " ")).alias("gram"))


def with_dictionary(found: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``found`` (with a number ``row`` of its own for each row) with ``dictionary``."""
    grams = F.regexp_extract_all(F.lower("finding"), F.lit(rf"(?=([a-z]{{{GRAM}}}))"), 1)
    known = found.select("row", F.explode(grams).alias("gram")).join(F.broadcast(dictionary_grams(found.sparkSession, vocabulary)), "gram").groupBy("row").agg(F.count("*").alias("known"))
    return found.join(known, "row", "left").withColumn("dictionary", F.coalesce(F.col("known") / F.greatest(F.size(grams), F.lit(1)), F.lit(0.0))).drop("known")


def with_features(found: DataFrame) -> DataFrame:
    size = F.greatest(F.length("finding"), F.lit(1))
    count = lambda pattern, c="finding": F.regexp_count(F.col(c), F.lit(pattern))
    keys = rf"(?i)\b({'|'.join(KEY_WORDS)})\b"
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "length": F.length("finding"),
        "transitions": count(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / size,
        "digits": count("[0-9]") / size, "uppers": count("[A-Z]") / size, "lowers": count("[a-z]") / size, "others": count("[^A-Za-z0-9]") / size, "hex": count("[0-9a-f]") / size,
        "repeats": 1 - F.size(F.array_distinct(F.split("finding", ""))) / size,
        "slashes": count("/"), "dots": count(r"\."), "at": count("@"),
        "path_length": F.length(F.coalesce("path", F.lit(""))), "path_digits": F.regexp_count(F.coalesce("path", F.lit("")), F.lit("[0-9]")),
        "key_inside": flag(F.col("word").rlike(keys.replace(r"\b", ""))), "key_before": flag(F.col("before").rlike(keys) | F.col("before2").rlike(keys)), "key_after": flag(F.col("after").rlike(keys)),
        "assigned": flag(F.col("before").rlike(r"[=:]$") | F.col("word").rlike(r"[=:]")), "before_length": F.length("before"), "after_length": F.length("after"),
    })


def weak_format(found: DataFrame) -> Column:
    """The number of the fixed format that tells, -1 for prose, else null."""
    context = F.concat_ws(" ", "before2", "before", "word")
    which = F.lit(None).cast("int")
    for i, (value, pattern) in reversed(list(enumerate(FORMATS))):
        which = F.when((F.col("word") if value == 0 else context).rlike(pattern), F.lit(i)).otherwise(which)
    prose = ~F.col("finding").rlike("[0-9]") & (F.length("finding") < LONG_RUN) & ~F.col("finding").startswith("KEY-") & ~F.expr("left(word, length(word) - length(finding))").rlike("[=:>]") & ~(F.col("before").rlike("[=:>]$") & (F.length("word") - F.length("finding") <= 2))
    return F.when(prose, -1).otherwise(which)


def weak_labels(found: DataFrame) -> Column:
    """1 or 0 where a fixed format tells, else null."""
    return _label(weak_format(found))


def _label(which: Column) -> Column:
    return F.when(which >= 0, F.get(F.array(*[F.lit(float(value)) for value, _ in FORMATS]), which)).when(which == -1, 0.0)


def train(labelled: DataFrame, most: int = TRAIN_ROWS):
    """A forest from rows with the features and ``label``; of more than ``most`` labelled findings a share is drawn by hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labelled.where("label IS NOT NULL")
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or positive in (0, n):
        return None, float(positive > 0)
    drawn = known.where(fraction_of(F.col("finding"), F.col("before"), F.col("doc_id")) < min(1.0, most / n)).withColumn("label", F.col("label").cast("double"))
    vectors = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(drawn).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(cut(vectors)), None


def score(found: DataFrame, model, constant: float | None) -> DataFrame:
    """``found`` (with features) with ``score``, the forest's probability of a secret."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return found.withColumn("score", F.lit(constant))
    vectors = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(found)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def featured(docs: DataFrame, path: str | None = "source", vocabulary: str | None = None) -> DataFrame:
    """All candidates with their features."""
    found = cut(candidates(docs, path).withColumn("row", F.monotonically_increasing_id()))  # numbered before it is written: the numbers stay
    return cut(with_features(with_dictionary(found, vocabulary)).drop("row"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", least: float = LEAST, vocabulary: str | None = None) -> DataFrame:
    """doc_id, word_index, finding_sha256, finding_length, score and is_secret of every candidate; findings themselves are not shown."""
    found = featured(docs, path, vocabulary)
    model, constant = train(labelled if labelled is not None else found.withColumn("label", weak_labels(found)))
    scored = score(found, model, constant)
    return scored.select("doc_id", "word_index", F.sha2(F.col("finding").cast("binary"), 256).alias("finding_sha256"), F.col("length").cast("long").alias("finding_length"), "score", (F.col("score") >= least).alias("is_secret"))


def held_out_formats(found: DataFrame, least: float = LEAST) -> list[tuple[int, int, int, int, int]]:
    """For each format with findings (number, its value, findings, found as secrets) by a forest that saw none of them; and the others' false positives.

    A format's own findings have no label while the forest is fitted, so what it says of them no format tells it. The last number counts
    the findings of other formats, and of prose, with label 0 that the forest takes for secrets.
    """
    found, out = found.withColumn("which", weak_format(found)), []
    for i, n in sorted((r.which, r.n) for r in found.where("which >= 0").groupBy("which").agg(F.count("*").alias("n")).collect()):  # a row a format
        model, constant = train(found.withColumn("label", F.when(F.col("which") != i, _label(F.col("which")))))
        told = score(found, model, constant).agg(F.sum(F.when((F.col("which") == i) & (F.col("score") >= least), 1).otherwise(0)), F.sum(F.when((F.col("which") != i) & (_label(F.col("which")) == 0) & (F.col("score") >= least), 1).otherwise(0))).first()
        out.append((i, FORMATS[i][0], n, told[0], told[1]))
    return out
