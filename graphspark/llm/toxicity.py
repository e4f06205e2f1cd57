"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded texts (operator 11).

Folding undoes disguises: letters are lower-cased, compatibility forms and marks taken off, signs of other scripts that look like Latin
letters replaced, invisible signs dropped, digits and signs inside words read as the letters that they stand for, and ``l`` written as
``i`` (so that ``1`` may mean either). A text is then its words, each between single spaces.

The lexicon holds beginnings of words (a space and ``LEAST_LETTERS`` to ``MOST_LETTERS`` letters) and whole words (with the space behind).
It is learned: of labelled texts, the toxic and the other ones with each entry are counted by Spark; the weight is the logarithm of the
smoothed odds against those of all labelled texts. Entries are those of weight ``LEAST_WEIGHT`` or more that chance doesn't explain
(``LEAST_Z`` deviations, ``SUPPORT`` texts), and longer ones inside them whose counts say otherwise (a harmless word with the same
beginning). At each word the longest entry counts, so a rare form falls back to its beginning.

Exception phrases are entries with a neighbouring word (before or behind) whose texts are mostly not toxic, learned from hits in the same
rows, and given ones (``exceptions``); hits inside are dropped. The weights' sum and the same by the length of the text are calibrated
to a score by a logistic regression, fitted on labelled texts that the lexicon was not learned from.

Learning takes ``per_label`` labelled rows a label at most in expectation, drawn by a hash of the id (a documented bound: ``TRAIN_ROWS``);
whole texts. Every text is scored whole. The lexicon (``MAX_ENTRIES`` at most, those of most evidence) is broadcast.

Edge cases: null and empty texts and those without letters have no hit and no length, and get the score of such a text; a doc_id that is
labelled more than once is toxic where any label says so; labels other than 0 and null count as 1; where nothing is labelled scores are 0,
where one class alone is, its share; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, fraction_of, keep, small_batches

TRAIN_ROWS, LEAST_LETTERS, MOST_LETTERS, SUPPORT, LEAST_WEIGHT, LEAST_Z, OFF, MAX_ENTRIES, MAX_WORD = 10_000, 3, 10, 5, 1.0, 4.0, 0.5, 50_000, 40
#: Share of the labelled rows from which weights and phrases are learned; the rest calibrates.
LEARN = 0.75

#: Signs that look like Latin letters, after lower-casing and without marks.
HOMOGLYPHS = str.maketrans(
    "авекмнорстухіјѕԁһӏԛԝгпьзαβεηικνορτυχωγаıɑɡʟʀɪɴʏßøđħłŧ∅€£¢¥",
    "abekmhopctyxijsdhiqwrnb3abenikvoptuxwyaiagirinysodhitoeicy",
)
#: Digits and signs that stand for letters inside words; ``l`` is written ``i`` too.
LEET = str.maketrans("0134578@$!l", "oieastbasii")
_LEET_AT = re.compile(r"(?<=[^\W_])[0134578@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?!\w)|(?<!\w)[0134578@$!]+(?=[^\W\d_])")
_ASCII = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalpha()} | {"l": "i"})
#: Marks and invisible signs go, homoglyphs turn into letters.
_SIGNS = {i: None for i in range(128, 0x20000) if unicodedata.category(chr(i)) in ("Mn", "Me", "Cf")} | HOMOGLYPHS
_WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The text's words in folded form, each between single spaces; a space alone where there is none."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(_SIGNS)
    text = _LEET_AT.sub(lambda m: m[0].translate(LEET), text)
    words = text.translate(_ASCII).split() if text.isascii() else _WORDS.findall(text.translate(_ASCII))
    return f" {' '.join(words)} " if words else " "


def entries_of(word: str) -> Iterator[str]:
    """The lexicon entries that a folded word could match: its beginnings and the whole."""
    for n in range(LEAST_LETTERS, min(len(word), MOST_LETTERS) + 1):
        yield f" {word[:n]}"
    if LEAST_LETTERS <= len(word) <= MAX_WORD:
        yield f" {word} "


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight, False))
        for phrase in exceptions:  # a phrase that is an entry too takes its place
            self.automaton.add_word(phrase, (len(phrase), 0.0, True))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def hits(self, folded: str) -> dict[int, float]:
        """The weight of the longest entry at each place of a word that has one, without those in exception phrases. One pass."""
        if self.empty:
            return {}
        found, spared = {}, []
        for end, (size, weight, exception) in self.automaton.iter(folded):
            start = end - size + 1
            if exception:
                spared.append((start, end))
            else:
                found[start] = weight  # ends grow, so the last one that begins here is the longest
        for start, end in spared:
            for at in [start, *(i for i in _spaces(folded, start + 1, end))]:
                found.pop(at, None)
        return {at: w for at, w in found.items() if w}

    def measure(self, folded: str) -> tuple[tuple[float, float], int, list[str]]:
        """Features (the sum of weights, where each further hit of one form counts less, and the same by length, as logarithms), hits, and their forms."""
        seen: Counter = Counter()
        total = 0.0
        for at, w in self.hits(folded).items():
            form = folded[at + 1 : folded.index(" ", at + 1)]
            seen[form] += 1
            total += w / seen[form]
        n = folded.count(" ") - 1
        return (math.log1p(total), math.log1p(100 * total / (n + 20))), seen.total(), sorted(seen)


def _spaces(text: str, start: int, end: int) -> Iterator[int]:
    at = text.find(" ", start, end)
    while at >= 0:
        yield at
        at = text.find(" ", at + 1, end)


def _logit(pos: Column, n: Column, base: Column) -> Column:
    """Logarithm of the odds of a toxic text among ``n``, shrunk by two texts of the usual odds, against the usual odds."""
    share = (pos + 2 * base) / (n + 2)
    return F.log(share / (1 - share)) - F.log(base / (1 - base))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, toxic, part): drawn rows of ``docs`` with their label; ``part`` below ``LEARN`` is for the lexicon."""
    one = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    sizes = cut(one.groupBy("toxic").count())  # two rows
    drawn = one.join(F.broadcast(sizes), "toxic").where(fraction_of(F.col("doc_id"), F.lit("drawn")) * F.col("count") < per_label).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(broadcast_if_small(cut(drawn)), "doc_id").select("text", "toxic", fraction_of(F.col("doc_id"), F.lit("part")).alias("part"))


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """(entry, pos, n): in how many toxic texts and texts in all each key stands. Counted in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos: Counter = Counter()
            n: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = set(keys_of(fold(text or "")))
                n.update(keys)
                if toxic:
                    pos.update(keys)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([pos[k] for k in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["entry", "pos", "n"])

    return small_batches(rows.select("text", "toxic")).mapInArrow(count, "entry string, pos long, n long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def learn_weights(rows: DataFrame) -> dict[str, float]:
    """The lexicon of (text, toxic)."""
    total = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("t")).where("p > 0 AND p < t").withColumn("base", F.col("p") / F.col("t"))
    counts = _counted(rows, lambda text: (e for w in set(text.split()) for e in entries_of(w))).where(F.col("n") >= SUPPORT)
    counts = cut(counts.crossJoin(F.broadcast(total)).select("entry", "n", _logit(F.col("pos"), F.col("n"), F.col("base")).alias("weight"), ((F.col("pos") - F.col("n") * F.col("base")) / F.sqrt(F.col("n") * F.col("base") * (1 - F.col("base")))).alias("z")))  # one row
    strong = counts.where((F.col("weight") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
    # Entries inside a strong one whose own counts tell something else.
    begun = F.explode(F.transform(F.sequence(F.lit(LEAST_LETTERS + 1), F.length("entry") - 1), lambda k: F.substring(F.col("entry"), F.lit(1), k))).alias("begin")
    inside = counts.where(F.length("entry") > LEAST_LETTERS + 1).select("entry", "n", "weight", begun).join(strong.select(F.col("entry").alias("begin"), F.col("weight").alias("outer")), "begin")
    other = inside.groupBy("entry", "n", "weight").agg(F.max_by("outer", F.length("begin")).alias("outer")).where(F.abs(F.col("weight") - F.col("outer")) >= OFF)
    kept = strong.select("entry", "n", "weight").union(other.select("entry", "n", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).alias("weight")))
    kept = kept.groupBy("entry").agg(F.max("n").alias("n"), F.min("weight").alias("weight")).orderBy(F.desc(F.col("n")), "entry").limit(MAX_ENTRIES)
    return {r.entry: r.weight for r in kept.collect()}


def learn_exceptions(rows: DataFrame, weights: dict[str, float]) -> list[str]:
    """Phrases of two words around hits, whose texts are toxic less often than others."""
    shared, key = rows.sparkSession.sparkContext.broadcast(weights), ("toxic words", uuid.uuid4().hex)

    def phrases(text: str) -> Iterator[str]:
        lexicon = keep(key, lambda: Lexicon(shared.value))
        for at in lexicon.hits(text):
            end = text.index(" ", at + 1)
            if at:
                yield text[text.rindex(" ", 0, at) : end + 1]
            if end + 1 < len(text):
                yield text[at : text.index(" ", end + 1) + 1]

    total = rows.agg((F.sum("toxic") / F.count("*")).alias("base")).where("base > 0 AND base < 1")
    found = _counted(rows, phrases).where(F.col("n") >= 3).crossJoin(F.broadcast(total))  # one row
    harmless = found.where((_logit(F.col("pos"), F.col("n"), F.col("base")) <= 0) & (F.length("entry") <= 2 * MAX_WORD)).orderBy(F.desc("n"), "entry").limit(MAX_ENTRIES)
    return [r.entry for r in harmless.collect()]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS, exceptions: Iterable[str] = ()) -> tuple[dict[str, float], list[str], list[float]]:
    """Weights, exception phrases, and the calibration (a number for each feature and the constant last)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = cut(labelled_sample(docs, labels, per_label))
    learned = rows.where(F.col("part") < LEARN)
    weights = learn_weights(learned)
    given = [p if p.startswith(" ") else fold(p) for p in exceptions]
    phrases = given + learn_exceptions(learned, weights) if weights else given
    shared = rows.sparkSession.sparkContext.broadcast((weights, phrases))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            found = [list(lexicon.measure(fold(t or ""))[0]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["features", "label"])

    measured = cut(small_batches(rows.where(F.col("part") >= LEARN).select("text", F.col("toxic").cast("double"))).mapInArrow(measure, "features array<double>, label double"))
    sizes = {r.label: r["count"] for r in measured.groupBy("label").count().collect()}
    if len(sizes) < 2:  # the share of toxic rows, where one class or nothing is left to calibrate with
        both = rows.agg(F.avg("toxic").alias("share"), F.count("*").alias("n")).first()
        share = 0.0 if not both.n else both.share
        return weights, phrases, [0.0, 0.0, math.log(share / (1 - share)) if 0 < share < 1 else (1e3 if share else -1e3)]
    model = LogisticRegression(regParam=3e-3, maxIter=50).fit(measured.select(array_to_vector("features").alias("features"), "label"))
    return weights, phrases, [*map(float, model.coefficients), float(model.intercept)]


def score(docs: DataFrame, model: tuple[dict[str, float], list[str], list[float]], keys: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The keys, ``score``, ``predicted`` (1 from 0.5 on), ``n_hits`` and ``hits`` (distinct folded forms, sorted) of each row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), ("toxicity", uuid.uuid4().hex)
    taken = docs.select(*keys, F.col("text").alias("__text"))
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.LongType()), T.StructField("hits", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, phrases, calibration = shared.value
        lexicon = keep(key, lambda: Lexicon(weights, phrases))
        for batch in batches:
            scores, numbers, forms = [], [], []
            for text in batch.column(batch.num_columns - 1):
                features, n, held = lexicon.measure(fold(text.as_py() or ""))
                z = sum(a * b for a, b in zip(calibration, (*features, 1.0)))
                scores.append(1 / (1 + math.exp(-min(max(z, -700.0), 700.0))))
                numbers.append(n)
                forms.append(" ".join(held))
            found = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(numbers, pa.int64()), pa.array(forms, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "score", "predicted", "n_hits", "hits"])

    return small_batches(taken).mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, keys: list[str | Column] = ("doc_id",), per_label: int = TRAIN_ROWS, exceptions: Iterable[str] = ()) -> DataFrame:
    """``score`` of every row of ``docs``, by a model of the rows that ``labels`` (doc_id, toxic) names."""
    return score(docs, fit(docs, labels, per_label, exceptions), keys)
