"""Language identification by error-correcting output codes.

Each language has a codeword; for each of its bits a linear classifier on hashed byte n-grams says on which
side a text lies. Loss-weighted decoding takes the codeword whose bits disagree least with the margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, text_slices

TABLE_BITS = 16
_LATIN, _LETTER = re.compile("[A-Za-z]"), regex.compile(r"\p{L}")
#: ASCII letters in lower case and bytes of other scripts stay, all else is a blank.
LETTERS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n x bits of +1 and -1: all splits of up to five languages, else random splits with the largest least distance of 50 draws."""
    if n <= 5:
        splits = range(1, 1 << max(n - 1, 1)) if n > 1 else [0]
        return np.array([[1 if i == n - 1 or s >> i & 1 == 0 else -1 for s in splits] for i in range(n)][::-1], np.int8)
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) if code.shape[1] else -1
        if best is None or least > best[0]:
            best = least, code
    return best[1]


def has_letter(text: str) -> bool:
    """Whether a code point of a Unicode letter category is in text; number signs and marks are none."""
    return bool(_LATIN.search(text) or not text.isascii() and _LETTER.search(text))


def normalised(text: str) -> bytes:
    """Words in lower case between single blanks, as UTF-8."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY).split()) + b" "


def grams(buffer: np.ndarray) -> np.ndarray:
    """The table row of the three bytes that start at each byte."""
    x = buffer.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - TABLE_BITS)).astype(np.uint16)


def gram_means(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """texts x bits: the mean weight of each text's n-grams."""
    sizes = np.array([len(t) for t in texts])
    ends = sizes.cumsum()
    rows = grams(np.frombuffer(b"".join(texts), np.uint8))
    cuts = np.empty(2 * len(texts), np.int64)
    cuts[0::2], cuts[1::2] = ends - sizes, ends - 2  # n-grams that cross into the next text are summed apart
    cuts = np.minimum(cuts, len(rows) - 1)
    out = np.empty((len(texts), len(weights)))
    for f, w in enumerate(weights):
        sums = np.add.reduceat(w[rows].astype(np.float64), cuts)[0::2]
        out[:, f] = sums / (sizes - 2)
    # reduceat leaves out what lies behind the last cut, here nothing but the last text's own last n-gram
    out[-1] = [w[rows[cuts[-2] :]].mean() for w in weights]
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    ambiguous_below: float = 0.6

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; und, 0 and True where there is no letter."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        which = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        if not which or not self.languages:
            return out
        margins = (gram_means([normalised(texts[i]) for i in which], self.weights) - self.offset) / self.scale
        # loss of a codeword: the logistic loss of each bit, weighted by how well that bit's classifier separates
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(1) for word in self.code], 1)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        for i, p in zip(which, chance):
            k = int(p.argmax())
            out[i] = self.languages[k], float(p[k]), bool(p[k] < self.ambiguous_below)
        return out


def fit(labelled: DataFrame, rows_per_language: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits the bit classifiers on at most rows_per_language texts of each language, those whose ids hash lowest.

    That bound is what the driver receives; texts are whole. Rows without text or label are not used. Rows are
    counted first, and only ids whose hash lies below a share of some four times the bound are ranked.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    ids = rows.select("id", "lang", F.xxhash64(F.col("id").cast("string")).alias("h"))
    counts = dict(ids.groupBy("lang").count().collect())  # a row for each language, as the model has
    # hashes are even over 64 bits: of n ids, n * share lie below share of their range, rows_per_language of them at least but for a chance beyond counting
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(4.0 * rows_per_language / n, 1.0))]) if counts else F.create_map(F.lit("").cast(dict(ids.dtypes)["lang"]), F.lit(0.0))
    share = F.try_element_at(shares, "lang")
    ids = ids.where((share >= 1.0) | (F.col("h") / F.lit(2.0**64) + 0.5 <= share))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= rows_per_language).select("id", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.max("text").alias("text")).toPandas()
    sample = sample[np.array([has_letter(t) for t in sample["text"]], bool)]
    languages = sorted(sample["lang"].unique())
    code = codewords(len(languages))
    texts, label = [normalised(t) for t in sample["text"]], np.array([languages.index(x) for x in sample["lang"]], int)
    size = 1 << TABLE_BITS
    counts = np.zeros((len(languages), size))
    for t, k in zip(texts, label):
        counts[k] += np.bincount(grams(np.frombuffer(t, np.uint8)), minlength=size)
    share = 0.95 * counts / np.maximum(counts.sum(1, keepdims=True), 1) + 0.05 / size  # each language weighs the same in a bit, and an unseen n-gram tells nothing
    weights, offset, scale, trust = [], [], [], []
    for f in range(code.shape[1]) if len(languages) > 1 else []:
        weights.append((np.log(share[code[:, f] > 0].mean(0)) - np.log(share[code[:, f] < 0].mean(0))).astype(np.float32))
    weights = np.array(weights, np.float32).reshape(-1, size)
    margins = np.concatenate([gram_means(texts[a:b], weights) for a, b in slices(map(len, texts), 4_000_000)]) if texts and len(weights) else np.zeros((len(texts), 0))
    for f in range(len(weights)):
        up, down = (margins[code[label, f] * side > 0, f] for side in (1, -1))
        offset.append((up.mean() + down.mean()) / 2)
        scale.append(max(abs(up.mean() - down.mean()) / 8, 1e-9))
        wrong = ((up < offset[-1]).mean() + (down >= offset[-1]).mean()) / 2
        trust.append(0.5 * np.log((1 - wrong + 1e-3) / (wrong + 1e-3)))
    return LanguageModel(languages, code if len(weights) else np.ones((len(languages), 0), np.int8), weights, np.array(offset), np.array(scale), np.array(trust))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """docs' id and the columns in keep with lang_pred, score (0 to 1) and ambiguous, predicted from the text alone.

    A null text or one without a letter is und with score 0, and ambiguous; a text whose nearest codeword has less
    than the model's share of belief is ambiguous too. Each row is judged alone, so repeated rows agree; an empty
    table gives no rows; columns beside the named ones are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x 2**16 weights, bounded by the number of languages
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in texts:
            found: list[tuple[str, float, bool]] = []
            for _, _, some in text_slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text", 2_000_000):
                found += model.predict([None if t is None else t.decode("utf-8", "replace") for t in some])
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind[k].type) for k in range(3)], fields=list(kind))

    # only texts go to Python; what else is kept stays where it is
    kept = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), *kept, judged(F.col(text_col)).alias("v"))
    return rows.select(*([] if id_col in keep else [F.col("id").alias(id_col)]), *[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)], "v.lang_pred", "v.score", "v.ambiguous")
