"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings. Every labelled text has
counterfactuals: if it names groups, one where each term is swapped for
another of its kind, and always one with a term inserted, so that pairs exist
where no text names a group. The loss adds the squared change of the score
over these pairs, so weights that only follow the mention of a group shrink,
also those of beginnings that a term shares with other words, and neutral
mentions are not flagged.

Fitting collects no texts. Executors count features by slot; the driver reads
the ``MAX_FEATURES`` slots that tell the two kinds apart best, and then each
labelled text as its numbers among these, at most ``labelled.MAX_ROWS`` texts
(two bytes a number: at most 50 MB and three times that with counterfactuals).
``MAX_FEATURES`` bounds the model: at sf0.1 the labelled texts have 72,115 slots
that four texts or more hold, of which 183 differ by more than chance brings; the
4096th differs by 1.9 deviations. With 16,384 features 3 of 825 held-out
predictions are others.

Defined results: a null or empty text has the score of a text without any known
feature; each row is scored by itself, repeated or not, its whole text however
long; a feature counts once in a text. Features that tell alike (ties) are
taken by slot. Labels of rows without text are not learned from. An empty table
gives no row. Without labelled rows of both kinds the score is the share of
toxic labels, or 0. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, sample_frame
from .stash import Stash

FOLDS, FOLD = 5, 0
#: Terms that name groups, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mothers", "fathers"),
    ("black", "white", "asian", "latino"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"), ("old", "young"), ("rich", "poor"), ("mexican", "chinese", "african", "american", "european"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "jungen"), ("mütter", "väter"), ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"), ("schwarze", "weiße"),
    ("schwule", "lesben", "heterosexuelle"), ("einwanderer", "einheimische", "flüchtlinge"), ("behinderte", "gehörlose", "blinde"), ("alte", "junge"), ("türken", "polen", "russen", "araber"),
    ("femme", "homme"), ("femmes", "hommes"), ("filles", "garçons"), ("mères", "pères"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "asiatiques"),
    ("homosexuels", "lesbiennes", "hétérosexuels"), ("immigrés", "réfugiés", "natifs"), ("handicapés", "sourds", "aveugles"), ("vieux", "jeunes"), ("arabes", "africains", "européens"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niñas", "niños"), ("madres", "padres"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos"),
    ("homosexuales", "lesbianas", "heterosexuales"), ("inmigrantes", "refugiados", "nativos"), ("discapacitados", "sordos", "ciegos"), ("viejos", "jóvenes"), ("gitanos", "árabes", "europeos"),
)
SWAPS = {term: tuple(t for t in kind if t != term) for kind in IDENTITY_TERMS for term in kind}
#: Terms that are inserted, in the order in which texts take them by hash.
TERMS = tuple(dict.fromkeys(t for kind in IDENTITY_TERMS for t in kind))
#: Beginnings of words that are features beside the words themselves.
BEGINNINGS = (4, 5, 6, 7)
MIN_TEXTS, MAX_FEATURES = 4, 4096
#: Times the ridge that holds features back whose kinds differ no more than chance brings.
DOUBT = 10.0
#: Tasks that measure the labelled texts.
FIT_TASKS = 24
#: Slots in which features are counted; two features of one slot share a weight.
SLOTS = 1 << 22
#: The ridge is of the sum over texts, so that more texts say more.
RIDGE, SWAP_PENALTY, STEPS = 0.6, 1.0, 300

_WORD = re.compile(r"[^\W\d_]+")


def _with_beginnings(words: set[str]) -> set[str]:
    out = set(words)
    for n in BEGINNINGS:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> set[str]:
    """Words of a text, and their beginnings marked by a leading ^."""
    return _with_beginnings(words_of(text))


def counterfactuals(text: str, found: set[str]) -> list[set[str]]:
    """``found``, features of a text, with each group term of the text replaced by the next of its kind, and with a term inserted."""
    words, out = words_of(text), []
    terms = words & SWAPS.keys()
    if terms:
        # A beginning stays where another word has it too.
        gone = _with_beginnings(terms) - _with_beginnings(words - terms)
        out.append((found - gone) | _with_beginnings({SWAPS[t][0] for t in terms}))
    new = TERMS[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(TERMS)]
    out.append(found | _with_beginnings({new}))
    return out


def slot_of(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def _slots(found: set[str]) -> np.ndarray:
    """Distinct slots of features, sorted."""
    return np.unique(np.fromiter(map(slot_of, found), np.int32, len(found)))


class Toxicity:
    """Weights by feature and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = {f for f in weights if f[0] != "^"}
        self.begins = {n: {f[1:] for f in weights if f[0] == "^" and len(f) == n + 1} for n in BEGINNINGS}

    def score(self, text: str) -> float:
        words = set(_WORD.findall(text.lower()))
        total = self.bias + sum(self.weights[w] for w in words & self.words)
        for n, known in self.begins.items():
            if known:
                total += sum(self.weights["^" + b] for b in {w[:n] for w in words if len(w) > n} & known)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    @classmethod
    def even(cls, labels) -> Toxicity:
        """Of labels of one kind, or none: their share."""
        share = float(np.mean(labels)) if len(labels) else 0.0
        return cls({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    @classmethod
    def fit(cls, labels: list[int], own: list[np.ndarray], pairs: list[tuple[int, np.ndarray]], names: list[tuple[str, int]], doubt: np.ndarray, penalty: float = SWAP_PENALTY, steps: int = STEPS) -> Toxicity:
        """From each text's feature numbers, counterfactuals (text, numbers), features by name and number, and the ridge of each number."""
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            return cls.even(y)
        n, n1 = len(y), y.sum()
        width, ridge = len(doubt), RIDGE / n * doubt

        def matrix(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(found)), [len(c) for c in found]), np.concatenate(found) if found else np.zeros(0, np.int64)

        # The rarer kind counts by the root of how much rarer it is.
        weight = np.where(y == 1, max(1.0, np.sqrt((n - n1) / n1)), max(1.0, np.sqrt(n1 / (n - n1))))
        r0, c0 = matrix(own)
        # Only what a counterfactual adds or takes away changes the score.
        ra, ca = matrix([np.setdiff1d(own[r], x) for r, x in pairs])
        r1, c1 = matrix([np.setdiff1d(x, own[r]) for r, x in pairs])
        w, b = np.zeros(width), float(np.log(n1 / (n - n1)))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(r0, w[c0], n) + b, -40, 40)))
            err = (p - y) * weight / n
            g = np.bincount(c0, err[r0], width) + ridge * w
            if pairs and penalty:
                change = np.bincount(ra, w[ca], len(pairs)) - np.bincount(r1, w[c1], len(pairs))
                g += 2 * penalty / len(pairs) * (np.bincount(ca, change[ra], width) - np.bincount(c1, change[r1], width))
            gb = err.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate = 0.1 / (1 + t / 60)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        return cls({f: float(w[at]) for f, at in names if w[at]}, float(b))


def _slot_rows(batches):
    """(slot, toxic): one row for each slot of each labelled text."""
    for batch in batches:
        slots = [_slots(features(t.as_py())) for t in batch.column("text")]
        toxic = np.repeat(batch.column("label").to_numpy(), [len(s) for s in slots])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots) if slots else [], pa.int32()), pa.array(toxic, pa.int32())], ["slot", "toxic"])


def _numbered(place: dict[int, int]):
    """(doc_id, label, h, own, others, names): a labelled text and its counterfactuals as numbers of chosen features."""
    kind = "<u2" if len(place) <= 1 << 16 else "<u4"

    def numbers(found) -> bytes:
        return np.unique(np.array([place[s] for s in map(slot_of, found) if s in place], kind)).tobytes()

    def run(batches):
        for batch in batches:
            own, others, names = [], [], []
            for t in batch.column("text"):
                found = [f for f in features(t.as_py()) if slot_of(f) in place]
                own.append(numbers(found))
                others.append([numbers(x) for x in counterfactuals(t.as_py(), set(found))])
                names.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), batch.column("h"), pa.array(own, pa.binary()), pa.array(others, pa.list_(pa.binary())), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "label", "h", "own", "others", "names"])

    return run


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", penalty: float = SWAP_PENALTY, steps: int = STEPS, features: int = MAX_FEATURES) -> Toxicity:
    """A model fitted on the labels that are not held out."""
    stash = Stash(docs.sparkSession, "toxic")
    rows = stash.keep(sample_frame(docs, labels, label, FOLDS, FOLD).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", F.xxhash64("text").alias("h")).repartition(FIT_TASKS), "rows")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or n1 in (0, n):
        return Toxicity.even([n1 / n] if n else [])
    share = n1 / n
    counts = rows.mapInArrow(_slot_rows, "slot int, toxic int").groupBy("slot").agg(F.count("*").alias("texts"), F.sum("toxic").alias("toxic")).where(F.col("texts") >= MIN_TEXTS)
    # The slots whose toxic texts lie farthest from what their number lets expect.
    gain = F.abs(F.col("toxic") - F.col("texts") * share) / F.sqrt(F.col("texts") * share * (1 - share))
    # Of so many slots, chance alone brings the farthest to about sqrt(2 ln(slots)); what lies no farther is doubted more.
    chance = float(np.sqrt(2 * np.log(max(counts.count(), 2))))
    chosen = counts.select("slot", gain.alias("gain")).orderBy(F.desc("gain"), "slot").limit(features).collect()
    place = {r["slot"]: k for k, r in enumerate(chosen)}
    doubt = np.array([1.0 if r["gain"] >= chance else DOUBT for r in chosen])
    numbered = stash.keep(rows.mapInArrow(_numbered(place), "doc_id long, label int, h long, own binary, others array<binary>, names array<string>"), "numbered")
    names = [(r[0], place[slot_of(r[0])]) for r in numbered.select(F.explode("names").alias("f")).distinct().collect()]
    found = sorted(numbered.select("doc_id", "label", "h", "own", "others").collect(), key=lambda r: (r["doc_id"], r["label"], r["h"]))
    read = lambda blob: np.frombuffer(blob, "<u2" if len(place) <= 1 << 16 else "<u4").astype(np.int64)
    pairs = [(k, read(x)) for k, r in enumerate(found) for x in r["others"]]
    model = Toxicity.fit([r["label"] for r in found], [read(r["own"]) for r in found], pairs, names, doubt, penalty, steps)
    stash.drop("rows", "numbered")
    return model


def _score(shipped):
    def run(batches):
        model = shipped.value
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Toxicity, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row; reads the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_score(shipped), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", penalty: float = SWAP_PENALTY) -> DataFrame:
    """(doc_id, held_out, score, predicted), the model fitted on labels that are not held out."""
    model = fit_model(docs, labels, label, penalty)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
