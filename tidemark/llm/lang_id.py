"""Language identification with string kernels.

A text is the set of its byte n-grams (n = 1 to 3, of its letters in lower case, with
spaces between words).  The kernel of two texts is the number of n-grams both have,
over the root of the product of their numbers.  A few hundred landmark texts span a
Nyström feature space; one ridge regression a language, one language against the
rest, is fitted in it.  Scoring a batch is two matrix products: presence matrix times
landmarks' n-grams, then kernel values times coefficients.

Scale: the model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS in all,
drawn by hash for each language) on the driver; scoring is one narrow pass over whole
texts with a model of a few MB in each worker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows and landmarks that a fit uses at most, over all languages.
SAMPLE_ROWS, LANDMARKS = 4000, 320
RIDGE = 1e-2
#: Divides scores before they become shares.
SHARPNESS = 0.2
#: Rows of one matrix product.
ROWS = 128
#: Texts of so many n-grams or more whose best share is lower are of no known language; the
#: shares of shorter ones are close to each other whatever they are.
MIN_SCORE, MIN_GRAMS = 0.4, 60
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct codes of the text's n-grams, n = 1 to 3; none if it has no letters."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words.replace(" ", "").isalpha():  # numerals that are no digits, as in x²
        words = "".join(c if c.isalpha() else " " for c in words)
        words = " ".join(words.split())
    if not words:
        return np.empty(0, np.int32)
    b = np.frombuffer(f" {words} ".encode("utf-8", "ignore"), np.uint8).astype(np.int32)
    # A code holds n bytes, none of which is 0, so codes of different n differ.
    two = b[:-1] << 8 | b[1:]
    return np.unique(np.concatenate([b, two, two[:-1] << 8 | b[2:]]))


def presence(texts: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix over the vocabulary, and each text's number of n-grams in all."""
    flat = np.concatenate(texts) if texts else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.searchsorted(vocabulary, flat)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    x[row[hit], at[hit]] = 1
    return x, np.array([max(1, len(t)) for t in texts], np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    vocabulary: np.ndarray  # n-grams of the landmarks
    landmarks: np.ndarray  # vocabulary x landmarks, over the root of each landmark's n-grams
    coefficients: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        x, n = presence(texts, self.vocabulary)
        return (x @ self.landmarks) / np.sqrt(n)[:, None]

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Languages and their shares of the scores; UNKNOWN and 0 without n-grams."""
        names, shares = [], []
        for s in range(0, len(texts), ROWS):
            part = texts[s : s + ROWS]
            z = (self.kernel(part) @ self.coefficients + self.bias) / SHARPNESS
            e = np.exp(z - z.max(1, keepdims=True))
            best, e = e.argmax(1), e / e.sum(1, keepdims=True)
            known = np.array([len(t) > 0 for t in part])
            names += [self.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            shares.append(np.where(known, e.max(1), 0.0))
        return names, np.concatenate(shares) if shares else np.empty(0)


def train(texts: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Nyström features of the first rows of each language as landmarks, then ridge regression."""
    names = tuple(sorted(set(labels)))
    if not names:
        return None
    y = np.array([names.index(x) for x in labels])
    each = max(2, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(names))])
    vocabulary = np.unique(np.concatenate([texts[i] for i in chosen]))
    x, n = presence([texts[i] for i in chosen], vocabulary)
    ours = (x / np.sqrt(n)[:, None]).T.copy()
    model = LanguageModel(names, vocabulary, ours, np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names)))
    w, v = np.linalg.eigh((ours.T @ ours).astype(np.float64))  # landmarks' kernel matrix
    good = w > 1e-6 * w.max()
    root = v[:, good] / np.sqrt(w[good])
    phi = np.concatenate([model.kernel(texts[s : s + ROWS]) @ root for s in range(0, len(texts), ROWS)])
    center = phi.mean(0)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    a = (phi - center) * weight[:, None]
    mean = (weight[:, None] * target).sum(0) / weight.sum()
    beta = np.linalg.solve(a.T @ (phi - center) + RIDGE * len(names) / 100 * np.eye(phi.shape[1]), a.T @ (target - mean))
    return LanguageModel(names, vocabulary, ours, (root @ beta).astype(np.float32), mean - center @ beta)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Learn from at most `rows` rows with a language whose id isn't held out; None if there are none.

    Of more than rows // 8 languages the most frequent are learnt (by name where counts tie).
    Repeated rows count as often as they come; other columns are not looked at."""
    usable = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(rows // 8).collect()}
    if not counts:
        return None
    each = rows // len(counts)
    # A draw by hash of a little more than is needed, so that no window holds a language's rows.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.5 * (each + 20) / n) * 1e9)))])
    order = F.xxhash64(F.col(id_col), F.lit(8))
    drawn = usable.where(F.pmod(order, F.lit(10**9)) < F.element_at(share, F.col(lang_col)))

    def codes(batches):
        for batch in batches:
            grams = [ngrams(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes() for g in grams], pa.binary()), batch.column(1), batch.column(2)], ["grams", "lang", "place"])

    ranked = drawn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.row_number().over(Window.partitionBy(lang_col).orderBy(order, F.xxhash64(text_col))).alias("place"))
    found = ranked.where(F.col("place") <= each).mapInArrow(codes, "grams binary, lang string, place int").collect()
    found = sorted(((r["lang"], r["place"], np.frombuffer(r["grams"], np.int32)) for r in found), key=lambda r: r[:2])
    found = [r for r in found if len(r[2])]
    return train([r[2] for r in found], [r[0] for r in found])


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; lang_pred is `und` with score 0
    for null texts, texts without letters, and without a model.  Of languages with equal scores
    the first by name is taken; repeated rows come out as often as they go in; a null id is not
    held out; an empty table gives no rows; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: landmarks are bounded

    def run(batches):
        for batch in batches:
            texts = [ngrams(t.as_py()) for t in batch.column(2)]
            names, score = shared.value.predict(texts) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose text is of a known language, with all their columns.

    Null texts and texts without letters go, and texts of MIN_GRAMS n-grams or more whose best
    share is below min_score; short texts with letters stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(False, index=texts.index)
        grams = [ngrams(t) for t in texts]
        names, score = shared.value.predict(grams)
        short = np.array([len(g) < MIN_GRAMS for g in grams], bool)
        return pd.Series((np.array(names, object) != UNKNOWN) & (short | (score >= min_score)), index=texts.index)

    return docs.where(known(F.col(text_col)))
