"""Language identification by segmentation-marginalised unigrams (operator 10).

The pieces are those of a fixed public vocabulary (by default the 32,000 of ``piece_bpe_32k.model``, with one piece for each byte, so
that every text has a segmentation). A language gives each piece a probability. A word's likelihood is the sum over all ways to cut
it into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are fitted by expectation
maximisation (forward and backward over the same lattices).

Sums run over many words at once, with each piece's probability multiplied by ``PER_BYTE`` for each of its bytes, which cancels in
the end and keeps usual words near 1. Words of over ``WORD_BYTES`` bytes, and words whose sums come near the ends of a double's range,
take the same sums in logs (fitting) or with rescaled places (scoring): no word is left out for its length or its rarity.

Learning: labelled rows are drawn by a hash of the id, about ``per_language`` a language (a documented bound: ``TRAIN_ROWS`` = 2,000
by default; whole texts, words of any length). Their word counts are summed by Spark and each language is fitted in a task of its own.
The model has pieces x languages numbers (``MAX_LANGUAGES`` languages at most, checked) and is sent to the tasks that score; every text
is scored whole. Words are lower-cased runs of letters (ASCII punctuation, digits and white space divide them) and are scored once for
each worker, in bounded caches.

Edge cases: null texts and texts without letters get ``und`` and score 0; so does every text where nothing was labelled; null
languages are not learned; ties go to the first language by name; a text without any white space is one word, summed as any other;
repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored by ``predict`` and kept by
``keep_identified``, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, fraction_of, keep, small_batches

TRAIN_ROWS, ROUNDS, SMOOTHING, WORD_BYTES, PER_BYTE, CACHE_WORDS, CACHE_BYTES, MAX_LANGUAGES = 2_000, 4, 0.1, 160, 8.0, 120_000, 4 << 20, 500
#: Sums outside this range are taken anew by the slower way.
_LEAST, _MOST = 1e-250, 1e250
#: Words whose lattices are held at once while a language is fitted.
FIT_WORDS = 4_000
#: Bytes that divide words become spaces.
_CLEAN = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_CLEAN).split()


def vocabulary_pieces(path: str | None = None) -> list[bytes]:
    """The pieces as bytes, longest meaningful ones of the model and one for each byte; a word begins with a space."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(p for p in found if p and p == p.lower() and b" " not in p[1:])


class Lattice:
    """Finds the pieces in words; sums over segmentations for many words at once."""

    def __init__(self, pieces: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece.decode("latin-1"), i << 8 | len(piece))
        self.automaton.make_automaton()
        self.pieces, self.reach = len(pieces), max(map(len, pieces))
        self.lift = PER_BYTE ** np.array([len(p) for p in pieces], float)[:, None]

    def arcs(self, words: list[bytes]):
        """Arcs of all words, in the order of their ends: start, end (places in one row of all words' places), piece, and end within the word."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])  # a word of n bytes, with its space, has n + 2 places
        # Joined by a character that no piece has: places of the text and of the lattice then run alike.
        text = "Ā".join((b" " + w).decode("latin-1") for w in words)
        found = np.fromiter((end << 32 | value for end, value in self.automaton.iter(text)), np.int64)
        end, piece = (found >> 32) + 1, found >> 8 & 0xFFFFFF
        start = end - (found & 0xFF)
        local = end - base[np.searchsorted(base, end, "right") - 1]
        return base, sizes, start, end, piece, local

    def forward(self, words: list[bytes], lifted: np.ndarray):
        """From lifted probabilities: the words' lifted likelihoods, one column a language, and what led to them."""
        base, sizes, start, end, piece, local = arcs = self.arcs(words)
        alpha = np.zeros((base[-1], lifted.shape[1]))
        alpha[base[:-1]] = 1
        order = np.lexsort((end, local))
        start, end, piece, local = start[order], end[order], piece[order], local[order]
        edges = np.searchsorted(local, np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        for i, j in zip(edges, edges[1:]):
            if i < j:
                first = np.flatnonzero(np.diff(end[i:j], prepend=-1))
                alpha[end[i:j][first]] = np.add.reduceat(alpha[start[i:j]] * lifted[piece[i:j]], first, axis=0)
        return alpha[base[:-1] + sizes], alpha, arcs

    def log_likelihood(self, words: list[bytes], probability: np.ndarray) -> np.ndarray:
        """Natural logs of the words' likelihoods, one column a language."""
        out, lifted = np.empty((len(words), probability.shape[1])), probability * self.lift
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if len(words[i]) <= WORD_BYTES]
        slow = order[len(short) :]
        for k in range(0, len(short), 4_000):
            part = short[k : k + 4_000]
            whole = self.forward([words[i] for i in part], lifted)[0]
            fine = ((whole > _LEAST) & (whole < _MOST)).all(1)
            slow.extend(i for i, ok in zip(part, fine) if not ok)
            with np.errstate(divide="ignore"):
                out[part] = np.log(whole) - math.log(PER_BYTE) * np.array([[len(words[i]) + 1] for i in part])
        for i in slow:
            out[i] = self.scaled(words[i], probability)
        return out

    def scaled(self, word: bytes, probability: np.ndarray) -> np.ndarray:
        """The same sum for a long word, with the places rescaled on the way so that nothing underflows."""
        text = (b" " + word).decode("latin-1")
        scale, alpha = np.zeros(probability.shape[1]), np.zeros((len(text) + 1, probability.shape[1]))
        alpha[0] = 1
        for end, value in self.automaton.iter(text):
            piece, size = value >> 8, value & 0xFF
            if size == 1 and end and alpha[end].min() < 1e-100:  # the place before is complete; the byte's own piece comes last
                near = slice(max(0, end - self.reach), end + 2)  # with what longer pieces have given the next place already
                top = alpha[end].copy()
                alpha[near] /= top
                scale += np.log(top)
            alpha[end + 1] += alpha[end + 1 - size] * probability[piece]
        return scale + np.log(alpha[-1])

    def expected(self, word: bytes, log_p: list[float], times: float, total: np.ndarray) -> None:
        """Adds to ``total`` how often each piece is expected in ``times`` copies of a word, by forward and backward sums in logs."""
        text = (b" " + word).decode("latin-1")
        arcs = array("q", (end << 32 | value for end, value in self.automaton.iter(text)))
        alpha, beta = array("d", [-math.inf]) * (len(text) + 1), array("d", [-math.inf]) * (len(text) + 1)
        alpha[0] = beta[len(text)] = 0.0
        for arc in arcs:  # by their ends
            end = (arc >> 32) + 1
            new, held = alpha[end - (arc & 0xFF)] + log_p[arc >> 8 & 0xFFFFFF], alpha[end]
            low, high = (new, held) if new < held else (held, new)
            if high > -math.inf:
                alpha[end] = high + math.log1p(math.exp(low - high))
        whole = alpha[len(text)]
        for arc in reversed(arcs):  # all arcs that begin at a place end after it, so its sum is complete before it is used
            end, piece = (arc >> 32) + 1, arc >> 8 & 0xFFFFFF
            start, after = end - (arc & 0xFF), beta[end] + log_p[piece]
            total[piece] += times * math.exp(alpha[start] + after - whole)
            low, high = (after, beta[start]) if after < beta[start] else (beta[start], after)
            if high > -math.inf:
                beta[start] = high + math.log1p(math.exp(low - high))

    def fit(self, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities of one language from its words, of any length, and their counts."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        words, counts = [words[i] for i in order], np.asarray(counts, float)[order]
        n_short = sum(len(w) <= WORD_BYTES for w in words)
        p = np.full((self.pieces, 1), 1 / self.pieces)
        for _ in range(rounds):
            total, lifted, log_p, slow = np.zeros(self.pieces), p * self.lift, np.log(p[:, 0]).tolist(), list(range(n_short, len(words)))
            for k in range(0, n_short, FIT_WORDS):
                whole, alpha, (base, sizes, start, end, piece, local) = self.forward(words[k : min(k + FIT_WORDS, n_short)], lifted)
                fine = (whole[:, 0] > _LEAST) & (whole[:, 0] < _MOST)
                slow.extend(k + i for i in np.flatnonzero(~fine))
                owner = np.searchsorted(base, end, "right") - 1
                left = sizes[owner] - (start - base[owner])  # bytes from an arc's start to the word's end
                order = np.lexsort((start, left))
                beta = np.zeros(base[-1])
                beta[base[:-1] + sizes] = 1
                s, e, q, n = start[order], end[order], piece[order], left[order]
                edges = np.searchsorted(n, np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
                for i, j in zip(edges, edges[1:]):
                    if i < j:
                        first = np.flatnonzero(np.diff(s[i:j], prepend=-1))
                        beta[s[i:j][first]] = np.add.reduceat(beta[e[i:j]] * lifted[q[i:j], 0], first)
                weight = np.where(fine, counts[k : k + len(sizes)] / np.where(fine, whole[:, 0], 1.0), 0.0)[owner]
                held = fine[owner]
                total += np.bincount(piece[held], weights=(alpha[start, 0] * lifted[piece, 0] * beta[end] * weight)[held], minlength=self.pieces)
            for i in slow:
                self.expected(words[i], log_p, counts[i], total)
            p = ((total + SMOOTHING) / (total.sum() + SMOOTHING * self.pieces))[:, None]
        return p[:, 0]


def train(labelled: DataFrame, pieces: list[bytes], per_language: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample of rows (doc_id, text, lang): the languages by name and a matrix, pieces x languages."""
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = cut(rows.groupBy("lang").count())
    if (languages := sizes.count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages are labelled; the model holds {MAX_LANGUAGES} at most")
    drawn = rows.join(F.broadcast(sizes), "lang").where(fraction_of(F.col("doc_id")) * F.col("count") < per_language)  # one row a language
    shared = spark.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("word")
        p = Lattice(shared.value).fit(list(table["word"]), table["n"].to_numpy())
        return pd.DataFrame({"lang": [table["lang"].iloc[0]], "p": [p.astype("<f8").tobytes()]})

    counted = small_batches(drawn).select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = sorted(counted.groupBy("lang").applyInPandas(fit, "lang string, p binary").collect())
    return [r.lang for r in fitted], np.stack([np.frombuffer(r.p, "<f8") for r in fitted], 1) if fitted else np.zeros((len(pieces), 0))


class Scorer:
    def __init__(self, pieces: list[bytes], languages: list[str], probability: np.ndarray):
        self.lattice, self.languages, self.probability = Lattice(pieces), languages, probability
        self.place: dict[bytes, int] = {}
        self.held = 0  # bytes of the words in place
        self.older: dict[bytes, int] = {}
        self.table = self.older_table = np.zeros((0, len(languages)))

    def score(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """In parts of about one MB of text."""
        names, scores, part, held = [], [], [], 0
        for i, text in enumerate(texts):
            part.append(text.as_py())
            held += len(part[-1] or "")
            if held > 1_000_000 or i == len(texts) - 1:
                for out, new in zip((names, scores), self.part(part)):
                    out.extend(new)
                part, held = [], 0
        return names, scores

    def part(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not lettered:
            return names, scores
        split = [words_of(texts[i]) for i in lettered]
        if len(self.place) > CACHE_WORDS or self.held > CACHE_BYTES:  # the older half's words come back as they are met
            self.older, self.older_table = self.place, self.table
            self.place, self.table, self.held = {}, self.table[:0], 0
        new = list({w for words in split for w in words if w not in self.place})
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        if new:
            self.held += sum(map(len, new))
            rows, unseen = np.empty((len(new), len(self.languages))), []
            for i, w in enumerate(new):
                at = self.older.get(w)
                if at is None:
                    unseen.append(i)
                else:
                    rows[i] = self.older_table[at]
            rows[unseen] = self.lattice.log_likelihood([new[i] for i in unseen], self.probability)
            self.table = np.concatenate([self.table, rows])
        sizes = np.array([len(words) for words in split])
        at = np.fromiter((self.place[w] for words in split for w in words), np.int64, sizes.sum())
        sums = np.add.reduceat(self.table[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        for i, b, s in zip(lettered, best, share):
            names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def predictor(spark: SparkSession, pieces: list[bytes], languages: list[str], probability: np.ndarray):
    """A function that scores an array of texts in a Python worker, for a model that is broadcast (pieces x languages numbers)."""
    shared = spark.sparkContext.broadcast((pieces, languages, probability))
    key = hash((tuple(languages), probability.tobytes()))

    def score(texts):
        return keep(("language_id", key), lambda: Scorer(*shared.value)).score(texts)

    return score


def predict(docs: DataFrame, labelled: DataFrame, keys: list[str | Column] = ("doc_id",), per_language: int = TRAIN_ROWS, vocabulary: str | None = None) -> DataFrame:
    """The keys, ``lang_pred`` and ``score`` (the share of the language's likelihood among all languages') of each row of ``docs``."""
    pieces = vocabulary_pieces(vocabulary)
    score = predictor(docs.sparkSession, pieces, *train(labelled, pieces, per_language))
    taken = docs.select(*keys, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return small_batches(taken).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is told with a score of ``least`` or more; columns stay as they are."""
    pieces = vocabulary_pieces()
    score = predictor(docs.sparkSession, pieces, *train(docs.where(~held_out()), pieces))
    identified = F.arrow_udf(lambda texts: pa.array(score(texts)[1], pa.float64()), "double")  # 0 for und; the other columns stay in the JVM
    return small_batches(docs).where(identified("text") >= least)
