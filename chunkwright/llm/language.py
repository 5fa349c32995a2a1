"""Language ID: first the family, then one-versus-one linear support vector machines within it.

Features are hashed character n-grams of the whole text, square-rooted and scaled to unit length. The family is the one whose
machine (against all other families) has the largest margin. Within it each two languages have a machine that has seen
these two only; the language that wins most of its duels is the prediction. A model is a few matrices of FEATURES
columns, trained here on a bounded sample of labelled rows.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 4096
#: At most about this many different labelled texts of each language train the model (a bound of the method, whatever the input's size).
SAMPLE = 600
#: Texts of all languages together that train the model, about, and languages that are learned: those with most different texts. Both bound the driver's memory.
SAMPLE_OF_ALL, LANGUAGES = 8_000, 200
#: How steeply a margin becomes a probability.
STEEP = 3.0
#: Characters that one step of the feature count holds at once; longer texts take several steps.
SLICE = 1 << 16
REJECTED = "und"

#: Language families of common codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "baltic": ("lt", "lv"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
}


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang.split("-")[0] in langs), f"={lang}")


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed 1- to 3-grams over the whole text; None if it has no letter. White space is one blank."""
    counts = np.zeros(FEATURES)
    tail, letters = " ", False
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE].lower()
        letters = letters or any(map(str.isalpha, part))
        part = tail + " ".join(part.split()) + (" " if part[-1:].isspace() or at + SLICE >= len(text) else "")
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        h = codes * np.uint32(0x9E3779B1)
        grams = [h, h[:-1] * np.uint32(5) ^ (h[1:] + np.uint32(0x85EBCA6B)), h[:-2] * np.uint32(25) ^ h[1:-1] * np.uint32(7) ^ (h[2:] + np.uint32(0xC2B2AE35))]
        for g in grams:
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(g >> np.uint32(20), minlength=FEATURES)
        tail = part[-2:]
    if not letters:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def train_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 10.0) -> np.ndarray:
    """Weights (last one: bias) of a linear SVM with squared hinge loss, by dual coordinate descent over fixed orders.

    ``rows`` are the numbers of the rows of ``x`` that it learns from, ``y`` their signs; nothing of ``x`` is copied."""
    w, bias, alpha, rng = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    weight = np.where(y > 0, len(y) / (2.0 * max(1, (y > 0).sum())), len(y) / (2.0 * max(1, (y < 0).sum())))
    diagonal = 0.5 / (c * weight)
    norms = np.array([float(x[r] @ x[r]) for r in rows]) + 1.0 + diagonal
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            own = x[rows[i]].astype(np.float64)
            step = (y[i] * (own @ w + bias) - 1 + diagonal[i] * alpha[i]) / norms[i]
            new = max(0.0, alpha[i] - step)
            change = (new - alpha[i]) * y[i]
            w += change * own
            bias += change
            alpha[i] = new
    return np.append(w, bias)


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-2 * STEEP * np.clip(margin, -50, 50)))


@dataclasses.dataclass(frozen=True)
class Model:
    """families: weights, one row a family; langs: for each family its codes and weights, one row for each two of them (i < j, in order)."""

    families: tuple[str, ...]
    family_weights: np.ndarray
    langs: dict[str, tuple[tuple[str, ...], np.ndarray]]

    def family(self, x: np.ndarray) -> tuple[str, float]:
        """The family of the largest margin (ties: the first name) and its share, a softmax over the margins."""
        if len(self.families) == 1:
            return self.families[0], 1.0
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        share = np.exp(STEEP * (margins - margins.max()))
        best = int(margins.argmax())
        return self.families[best], float(share[best] / share.sum())

    def duels(self, family: str, x: np.ndarray) -> tuple[str, float]:
        """The language that wins most duels (ties: the larger sum of probabilities, then the first name) and the least probability of its duels."""
        names, weights = self.langs[family]
        if len(names) == 1:
            return names[0], 1.0
        i, j = np.triu_indices(len(names), 1)
        won = np.full((len(names), len(names)), np.nan)
        won[i, j] = _probability(weights[:, :-1] @ x + weights[:, -1])
        won[j, i] = 1 - won[i, j]
        best = min(range(len(names)), key=lambda k: (-np.nansum(won[k] > 0.5), -np.nansum(won[k]), names[k]))
        return names[best], float(np.nanmin(won[best]))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text or "")
        if x is None or not self.families:
            return REJECTED, 0.0
        family, a = self.family(x)
        lang, b = self.duels(family, x)
        return lang, min(1.0, max(0.0, a * b))


def one_versus_rest(x: np.ndarray, labels: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    rows = np.arange(len(x))
    return np.array([train_svm(x, rows, np.where(labels == name, 1.0, -1.0)) for name in names]) if len(names) > 1 else np.zeros((1, x.shape[1] + 1))


def one_versus_one(x: np.ndarray, labels: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """A machine for each two of ``names``, trained on their rows alone; the first of the two is the positive one."""
    out = []
    for a, b in itertools.combinations(names, 2):
        own = np.flatnonzero((labels == a) | (labels == b))
        out.append(train_svm(x, own, np.where(labels[own] == a, 1.0, -1.0)))
    return np.array(out).reshape(-1, x.shape[1] + 1)


def held_out() -> F.Column:
    """The fold that is never learned from; a null id is in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled texts outside the held-out fold: of each language about ``sample`` different texts (fewer where there are
    many languages, see SAMPLE_OF_ALL), taken by a hash of the text.

    Shares are of different texts, not of rows, so copies crowd nothing out. The driver gets a count for each of LANGUAGES languages and
    a feature vector for each sampled text.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    texts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    counts = {r["lang"]: max(1, r["texts"]) for r in texts.orderBy(F.desc("texts"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model((), np.zeros((0, FEATURES + 1)), {})
    sample = max(1, min(sample, SAMPLE_OF_ALL // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, sample / n))])
    rank = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003

    def rows(batch: list) -> Iterable[tuple]:
        for lang, text in batch:
            x = features(text)
            if x is not None:
                yield lang, x.astype(np.float32).tobytes()

    taken = labelled.where(rank < F.coalesce(share[F.col("lang")], F.lit(0.0))).dropDuplicates(["lang", "text"])
    got = common.map_rows(taken, rows, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return Model((), np.zeros((0, FEATURES + 1)), {})
    labels = np.array([r["lang"] for r in got], dtype=object)
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), FEATURES)
    del got
    kin = np.array([family_of(lang) for lang in labels], dtype=object)
    families = tuple(sorted(set(kin)))
    langs = {f: tuple(sorted(set(labels[kin == f]))) for f in families}
    return Model(families, one_versus_rest(x, kin, families), {f: (names, one_versus_one(x, labels, names)) for f, names in langs.items()})


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for each row; only the text is an input of the prediction.

    A null text, one without a letter, or a model that has seen no labelled row gives ``und`` and 0. A null id
    counts as held out. Repeated rows are predicted each; other columns are ignored. No shuffle.
    """
    model = model or train(docs)

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, out, text in batch:
            yield doc_id, out, *model.predict(text)

    return common.map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double")
