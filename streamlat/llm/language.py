"""Language of a text: first its family, then its language within the family.

Linear support vector machines over hashed byte trigrams of the small letters. The family
machines each separate one family from the rest; within a family every pair of languages
has a machine of its own, and the language with most support from its pairs wins. They are
trained by Spark tasks, one a machine, on a sample of labelled texts of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlat.llm.support import map_texts, marked, release, written

SAMPLE = 1000        # labelled texts of a language, for training
SIDE = 4             # times that, the texts of either side of a machine, however many languages it has
SAMPLE_CHARS = 20000  # texts above this are left out of the sample
FEATURES = 1 << 13
SCALE = 40.0         # of trigram shares, so that margins are around one
UNKNOWN = "und"

# Families of languages by their two-letter codes. Others are families of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne pa sa sd si ur",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd gv",
    "baltic": "lt lv",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Bytes that are no part of a letter become blanks; capitals beyond ASCII are lowered before.
_LETTERS = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def family_of(language: str) -> str:
    return FAMILY.get(re.split(r"[-_]", language.lower())[0], language)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts one after another, where each text begins, and its size.

    The last two entries of a text would reach into the next one, and are FEATURES.
    """
    data = [b"  " + t.lower().encode().translate(_LETTERS) + b"  " for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    ids = np.full(len(b), FEATURES, np.int32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    ids[:-2] = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
    ids[ends - 1] = ids[ends - 2] = FEATURES
    return ids, ends - sizes, sizes - 2


def shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigrams that each text has, text after text, their scaled shares, and where each text begins."""
    ids, values, sizes = [], [], []
    for text in texts:
        found, _, size = trigrams([text])
        count = np.bincount(found, minlength=FEATURES + 1)[:FEATURES]
        there = np.flatnonzero(count)
        ids.append(there.astype(np.int32))
        values.append((count[there] * (SCALE / size[0])).astype(np.float32))
        sizes.append(len(there))
    return np.concatenate(ids), np.concatenate(values), np.cumsum(sizes) - sizes


def machine(texts: list[str], positive: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge), the bias last."""
    ids, x, starts = shares(texts)
    sizes = np.diff(starts, append=len(ids))
    y = np.where(positive, 1, -1).astype(np.float32)
    # Each side weighs the same, whatever its size.
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    weight, bias, seen, ridge = np.zeros(FEATURES), 0.0, np.zeros(FEATURES), 1e-4
    rate = 1 / (2 * (float((share * np.add.reduceat(x * x, starts)).sum()) + 1) + ridge)
    for step in range(steps):
        # Accelerated gradient descent.
        ahead = weight + step / (step + 3) * (weight - seen)
        margin = np.add.reduceat(x * ahead.astype(np.float32)[ids], starts) + bias
        slack = share * np.maximum(0, 1 - y * margin) * y
        pull = np.bincount(ids, x * np.repeat(slack.astype(np.float32), sizes), FEATURES)
        seen, weight = weight, ahead + rate * (2 * pull - ridge * ahead)
        bias += rate * 2 * slack.sum()
    return np.append(weight, bias)


class Hierarchy:
    """The trained machines. `weights` has the name of each: a family, or two languages."""

    def __init__(self, languages: list[str], weights: dict[tuple[str, str], np.ndarray]):
        self.families: dict[str, list[str]] = {}
        for language in sorted(languages):
            self.families.setdefault(family_of(language), []).append(language)
        self.weights = {k: np.append(w[:-1], 0).astype(np.float32) for k, w in weights.items()}
        self.bias = {k: float(w[-1]) for k, w in weights.items()}

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not lettered or not self.families:
            return languages, scores
        ids, starts, sizes = trigrams([texts[i] for i in lettered])

        def chance(name):
            if name not in self.weights:
                return np.ones(len(sizes))
            margin = np.add.reduceat(self.weights[name][ids], starts) * SCALE / sizes
            return 1 / (1 + np.exp(-np.clip(4 * (margin + self.bias[name]), -50, 50)))

        names = sorted(self.families)
        family = np.stack([chance((f, "")) for f in names])
        family /= family.sum(0)
        within = {f: self._within(self.families[f], chance, len(sizes)) for f in names}
        for k, i in enumerate(lettered):
            best = int(family[:, k].argmax())
            share = within[names[best]][:, k]
            languages[i] = self.families[names[best]][int(share.argmax())]
            scores[i] = float(family[best, k] * share.max())
        return languages, scores

    @staticmethod
    def _within(languages: list[str], chance, n: int) -> np.ndarray:
        """Mean support of each language of a family from the machines of its pairs."""
        support = np.zeros((len(languages), n))
        if len(languages) == 1:
            return support + 1
        for i, a in enumerate(languages):
            for j, b in enumerate(languages[i + 1:], i + 1):
                first = chance((a, b))
                support[i] += first
                support[j] += 1 - first
        return support / (len(languages) - 1)


def held_out(doc_id="doc_id"):
    """Whether a document is in the fifth that nothing is learned from; so is one without id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(lang, text): at most `size` labelled texts of each language, by the hash of their id."""
    known = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()
                       & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    # A row a language. A few more than needed, so that the exact cut below sees a bounded set.
    chance = counts.select("lang", (F.lit(1.5 * size) / F.col("n") * 1_000_000).alias("share"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    few = (known.join(F.broadcast(chance), "lang")
           .where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < F.col("share")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(order, "text"))
    return few.withColumn("turn", turn).where(F.col("turn") <= size).select("lang", "text")


def train(docs: DataFrame, size: int = SAMPLE) -> Hierarchy:
    """The machines, from documents with doc_id, text and lang."""
    texts = written(sample(docs, size), "labelled")
    # A row a language.
    languages = sorted(r.lang for r in texts.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(family_of(language), []).append(language)
    jobs = []
    if len(families) > 1:
        jobs += [(f, "", x, x in members, SIDE / (len(members) if x in members else len(languages) - len(members)))
                 for f, members in families.items() for x in languages]
    for members in families.values():
        jobs += [(a, b, x, x == a, 1.0) for i, a in enumerate(members) for b in members[i + 1:] for x in (a, b)]
    if not jobs:
        return Hierarchy(languages, {})
    spark = docs.sparkSession
    plan = spark.createDataFrame(jobs, "one string, other string, lang string, positive boolean, share double")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        weights = machine(rows["text"].tolist(), rows["positive"].to_numpy(bool))
        release()
        return pd.DataFrame({"one": rows["one"].iloc[:1], "other": rows["other"].iloc[:1],
                             "weights": [weights.astype("<f8").tobytes()]})

    drawn = F.pmod(F.xxhash64("text", "one", "other"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    made = texts.join(F.broadcast(plan), "lang").where(drawn).drop("share").groupBy("one", "other").applyInPandas(
        fit, "one string, other string, weights binary")
    # A row a machine, of a fixed size.
    return Hierarchy(languages, {(r.one, r.other): np.frombuffer(r.weights, "<f8") for r in made.collect()})


def _predictor(docs: DataFrame, hierarchy: Hierarchy):
    shared = docs.sparkSession.sparkContext.broadcast(hierarchy)

    def make():
        def step(batch, texts):
            languages, scores = shared.value(texts)
            return {"doc_id": batch.column(0), "lang_pred": languages,
                    "score": pa.array(scores, pa.float64())}
        return step
    return make


def predict(docs: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; `und` and 0 for a text without letters.

    The same without any labelled text to learn from. With one family or language, its
    members are told apart, or it is the only answer. Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(narrow, "doc_id long, lang_pred string, score double", _predictor(docs, hierarchy))


def identified(docs: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """The documents that have a language, with their columns, written."""
    made = marked(docs, "lang_pred string, score double", _predictor(docs, hierarchy))
    return written(made.where(F.col("lang_pred") != UNKNOWN).select("row.*"), "identified")
