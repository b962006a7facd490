"""Language identification by hierarchical discrimination.

A text's features are hashed letter n-grams (1 to 3, with word ends), counted over the whole text, square-rooted and brought to length one.
The family of languages is predicted first; linear support vector machines, one for each pair of the family's languages, then tell the
close ones apart. Families are one-versus-one machines too. The machines are trained on the driver on a sample of at most `max_rows`
labelled rows, dealt evenly to the languages and drawn by a hash of the id; the features are worked out on the executors.

Defined results: null text or one without a letter is `und` with score 0; ties go to the first name in order; a family with one language
needs no second step; with no usable label everything is `und`; repeated rows are predicted alike; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .catalog import query, table

# Families by language code; a language not named here is in a family of its own kind, "other".
FAMILIES = {
    "germanic": "en de nl sv da no is af".split(), "romance": "fr es it pt ro ca gl".split(), "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(), "turkic": "tr az kk uz".split(), "indic": "hi mr ne bn pa gu".split(), "semitic": "ar he am".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMS = 1 << 13
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str | None) -> np.ndarray | None:
    """The unit vector of a text, or None if it has no letter. Long texts are taken in pieces that overlap by what an n-gram needs."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts, some = np.zeros(DIMS), False
    for at in range(0, len(points), CHUNK):
        piece = points[max(0, at - 3):at + CHUNK]
        alpha = letters()[piece]
        some = some or bool(alpha.any())
        piece = np.where(alpha, piece, np.uint32(32))
        piece = np.concatenate([[np.uint32(32)], piece, [np.uint32(32)]]).astype(np.uint32)
        piece = piece[np.concatenate([[True], (piece[1:] != 32) | (piece[:-1] != 32)])]
        gram = piece * np.uint32(0x9E3779B1)
        for n in range(1, 4):
            if n > 1:
                if len(gram) < 2:
                    break
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + piece[n - 1:] * np.uint32(0x9E3779B1)
            slot = (gram ^ (gram >> np.uint32(16))) * np.uint32(0xC2B2AE35) >> np.uint32(19)
            counts += np.bincount(slot, minlength=DIMS)
    if not some:
        return None
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


# ---- training ----------------------------------------------------------------------------------------------------------------------

def train_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and intercept of a linear machine with squared hinge loss, by accelerated gradient descent. y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (2 * 2 * 2.0 + reg)
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        loss = np.maximum(0, 1 - y * (x @ v.astype(np.float32)))
        new = v - step * (reg * v - 2 * x.T @ (weight * loss * y).astype(np.float32))
        v, w = new + t / (t + 3) * (new - w), new
    return w


def train(x: np.ndarray, lang: np.ndarray) -> dict:
    """The hierarchy: families with their languages, and a weight vector for each pair of families and of languages in a family."""
    names = sorted(set(lang))
    family = {name: FAMILY_OF.get(name, "other") for name in names}
    groups = {f: [n for n in names if family[n] == f] for f in sorted(set(family.values()))}
    kin = np.array([family[n] for n in lang])

    def pairs(of: np.ndarray, among: list[str]) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for a, b in combinations(range(len(among)), 2):
            rows = (of == among[a]) | (of == among[b])
            out.append((a, b, train_svm(x[rows], np.where(of[rows] == among[a], 1.0, -1.0))))
        return out
    return {"families": list(groups), "groups": groups, "kin": pairs(kin, list(groups)), "langs": {f: pairs(lang, g) for f, g in groups.items()}}


def vote(x: np.ndarray, machines: list[tuple[int, int, np.ndarray]], n: int) -> tuple[int, float]:
    """The winner of the pairwise machines, and its least margin against another."""
    wins, sums, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
    for a, b, w in machines:
        margin = float(x @ w[:-1] + w[-1])
        wins[a if margin >= 0 else b] += 1
        for i, m in ((a, margin), (b, -margin)):
            sums[i] += m
            least[i] = min(least[i], m)
    best = max(range(n), key=lambda i: (wins[i], sums[i], -i))
    return best, least[best]


def predict(x: np.ndarray | None, model: dict) -> tuple[str, float]:
    if x is None or not model["families"]:
        return "und", 0.0
    kin, sure = vote(x, model["kin"], len(model["families"]))
    family = model["families"][kin]
    lang, close = vote(x, model["langs"][family], len(model["groups"][family]))
    return model["groups"][family][lang], float(1 / (1 + np.exp(-4 * min(sure, close, 50))))


def labelled_sample(docs: DataFrame, text: str, lang: str, doc_id: str, usable: Column, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and languages of at most `max_rows` usable rows, about as many of each language."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return np.empty((0, DIMS), dtype=np.float32), np.empty(0, dtype=object)
    share = max_rows / len(counts)
    chance = F.lit(0.0)
    for name, n in counts.items():
        chance = F.when(F.col("lang") == name, min(1.0, share / n)).otherwise(chance)
    drawn = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("lang")), F.lit(1 << 20)) < chance * (1 << 20)).select("text", "lang").limit(max_rows + max_rows // 4)

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            xs = [features(t) for t in part["text"]]
            keep = [i for i, v in enumerate(xs) if v is not None]
            yield pd.DataFrame({"lang": [part["lang"].iloc[i] for i in keep], "x": [xs[i].astype(np.float16).tobytes() for i in keep]})
    got = drawn.mapInPandas(vectors, "lang string, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float16).reshape(-1, DIMS).astype(np.float32)
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(b) for b in got["x"]], dtype=np.uint64), got["lang"].to_numpy().astype(str))) if len(got) else []
    return x[order], got["lang"].to_numpy()[order]


def identify(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = 2400) -> DataFrame:
    """doc_id, lang_pred and score of every row; only rows that are `usable` and have a language are learned from."""
    model = train(*labelled_sample(docs, text, lang, doc_id, usable, max_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def named(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([predict(features(t), shared.value) for t in part], columns=["lang_pred", "score"])
    return docs.select(F.col(doc_id).alias("doc_id"), named(F.col(text)).alias("p")).select("doc_id", "p.lang_pred", "p.score")


@query("op3_language_families")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = identify(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
