"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm.arrow import texts
from quillwork.tables import spread

UNDETERMINED = "und"

# ISO 639-1 codes by language family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ca ro gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl pl cs sk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "indic": "hi bn ur mr ne gu pa sa si",
    "iranian": "fa ku ps tg",
    "turkic": "tr az uz kk ky tk tt",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "japonic": "ja",
    "koreanic": "ko",
    "tai": "th lo",
    "austroasiatic": "vi km",
    "austronesian": "id ms tl jv",
    "bantu": "sw zu xh",
    "hellenic": "el",
    "armenian": "hy",
    "kartvelian": "ka",
    "albanian": "sq",
}

#: What is learned: languages with MIN_DOCS labelled rows or more, and the MOST_LANGUAGES that have the most of them, so
#: that stray values of a label neither make classes of their own nor let the driver's work grow with the corpus.
MIN_DOCS = 3
MOST_LANGUAGES = 200
_HASH_BITS = 15
_DIMENSIONS = 1 << _HASH_BITS
_SCALE = 10.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _c
    _FOLD[_c - 32] = _c


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), lang)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    codes = np.frombuffer(text, np.uint8)
    if (_FOLD[codes[codes < 128]] != 32).any():
        return True
    return bool((codes >= 128).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _grams(parts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For byte 3-grams and 4-grams: hashed feature and validity at each offset; where each part starts.

    Letters are folded to lower case, other ASCII is a space. A gram with two spaces in a row is not valid, so none
    spans two parts.
    """
    joined = _FOLD[np.frombuffer(b" " + b"  ".join(parts) + b"    ", np.uint8)]
    starts = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) + 2 for p in parts[:-1]], out=starts[1:])
    space = joined == 32
    twin = space[:-1] & space[1:]
    wide = joined.astype(np.uint32)
    three = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16
    valid3 = ~(twin[:-2] | twin[1:-1])
    four = three | wide[3:] << 24
    valid4 = valid3 & ~twin[2:]
    spread, shift = np.uint32(2654435761), np.uint32(32 - _HASH_BITS)
    return [(((three + 1) * spread >> shift), valid3), ((four ^ np.uint32(0x9E3779B9)) * spread >> shift, valid4)], starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.float64)


def vectors(text: bytes, segments: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse gram frequencies of the whole text and of its ``segments`` equal parts."""
    size = -(-len(text) // segments)
    parts = [text] + [text[k : k + size] for k in range(0, len(text), size) if segments > 1]
    out = []
    for part in parts:
        kinds, _ = _grams([part])
        codes = np.concatenate([h[v] for h, v in kinds])
        if len(codes):
            index, counts = np.unique(codes, return_counts=True)
            out.append((index.astype(np.int32), (counts * (_SCALE / len(codes))).astype(np.float32)))
    return out


def train_svm(samples: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int, penalty: float, seed: int) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged stochastic subgradients of the hinge loss; the two classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, total, bias, bias_total = np.zeros(_DIMENSIONS), np.zeros(_DIMENSIONS), 0.0, 0.0
    weight = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (-1, 1)}
    step, steps, scale = 0, epochs * len(samples), 1.0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            step += 1
            rate = 0.5 / (1 + penalty * step)
            index, value = samples[k]
            scale *= 1 - rate * penalty
            if signs[k] * (scale * (w[index] @ value) + bias) < 1:
                move = rate * weight[int(signs[k])] * signs[k]
                w[index] += move / scale * value
                total[index] += (steps - step) / steps * move * value  # averaged over the steps that follow
                bias += 0.1 * move
                bias_total += (steps - step) / steps * 0.1 * move
    return total.astype(np.float32), bias_total


@dataclass
class Model:
    """Weights of one column for each family (against the rest) and for each pair of languages in a family."""

    languages: list[str]
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, _DIMENSIONS), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, parts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; every text has a letter."""
        kinds, starts = _grams(parts)
        n = sum(_sums(valid, starts) for _, valid in kinds)
        margins = np.zeros((len(self.weights), len(parts)))
        for k, column in enumerate(self.weights):
            for codes, valid in kinds:
                margins[k] += _sums(np.where(valid, column[codes], 0), starts)
        margins = margins * (_SCALE / np.maximum(n, 1)) + self.biases[:, None]
        family = {}
        if len(self.families) > 1:
            m = 2 * margins[: len(self.families)]
            share = np.exp(m - m.max(axis=0))
            share /= share.sum(axis=0)
            family = dict(zip(self.families, share, strict=True))
        first = np.argmax(margins[: len(self.families)], axis=0) if family else np.zeros(len(parts), int)
        at = len(self.families) if family else 0
        chosen, scores = np.empty(len(parts), object), np.zeros(len(parts))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(first == f)
            members = [x for x in self.languages if family_of(x) == name]
            votes, belief = {x: np.zeros(len(rows)) for x in members}, {x: np.zeros(len(rows)) for x in members}
            for k, (a, b) in enumerate(self.pairs):
                if a in votes:
                    m = margins[at + k][rows]
                    p = 1 / (1 + np.exp(np.clip(-2 * m, -50, 50)))
                    votes[a] += m >= 0
                    votes[b] += m < 0
                    belief[a] += p
                    belief[b] += 1 - p
            rounds = max(1, len(members) - 1)
            order = np.array([votes[x] + belief[x] / (rounds + 1) for x in members])
            best = order.argmax(axis=0)
            inside = np.array([belief[x] / rounds for x in members])[best, np.arange(len(rows))] if len(members) > 1 else 1.0
            chosen[rows] = [members[b] for b in best]
            scores[rows] = inside * (family[name][rows] if family else 1.0)
        return list(chosen), np.clip(scores, 0, 1)


def fit(train: DataFrame, text_col: str, lang_col: str, id_col: str, docs_per_language: int, segments: int, epochs: int, penalty: float, seed: int, min_docs: int = MIN_DOCS) -> Model:
    """Learns from at most ``docs_per_language`` whole texts of each language, those of the lowest hashed ids."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    counts = {r.lang: r.n for r in known.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return Model([])
    languages = sorted(counts)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, 1.3 * docs_per_language / counts[lang])))])
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    sample = rows.filter(F.col("lang").isin(languages)).withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")] * (1 << 30))
    sample = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).filter(F.col("k") <= docs_per_language)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in texts(batch.column("text")):
                langs = batch.column("lang")[first : first + len(part)].to_pylist()
                found = [(lang, i.tobytes(), v.tobytes()) for lang, t in zip(langs, part, strict=True) if has_letter(t) for i, v in vectors(t, segments)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "i", "v"])

    got = sample.select("lang", "text").mapInArrow(sparse, "lang string, i binary, v binary").toArrow().sort_by([("lang", "ascending"), ("i", "ascending"), ("v", "ascending")])
    langs = np.array(got.column("lang").to_pylist(), object)
    samples = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got.column("i").to_pylist(), got.column("v").to_pylist(), strict=True)]
    languages = [x for x in languages if (langs == x).any()]
    kin = np.array([family_of(x) for x in langs], object)
    families = sorted({family_of(x) for x in languages})
    pairs = [p for f in families for p in combinations([x for x in languages if family_of(x) == f], 2)]
    columns = []
    if len(families) > 1:
        columns += [train_svm(samples, np.where(kin == f, 1, -1), epochs, penalty, seed) for f in families]
    for a, b in pairs:
        own = np.flatnonzero((langs == a) | (langs == b))
        columns.append(train_svm([samples[k] for k in own], np.where(langs[own] == a, 1, -1), epochs, penalty, seed))
    if not columns:
        return Model(languages, families)
    return Model(languages, families, pairs, np.array([w for w, _ in columns], np.float32), np.array([b for _, b in columns]))


def predict_batch(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(column), [0.0] * len(column)
    for first, part in texts(column):
        rows = [k for k, t in enumerate(part) if model.languages and has_letter(t)]
        if rows:
            for k, lang, score in zip(rows, *model.predict([part[k] for k in rows]), strict=True):
                langs[first + k], scores[first + k] = lang, float(score)
    return langs, scores


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 150, segments: int = 4, epochs: int = 4, penalty: float = 1e-4, seed: int = 17) -> DataFrame:
    """id, held_out, lang_pred and score of every row of ``docs``.

    The model learns from rows with a language whose crc32 of the id is not 0 modulo 5, at most ``docs_per_language``
    whole texts of each. A null text, or one without a letter, gives ``und`` with score 0; so does every text where
    there is nothing to learn from: a language counts from MIN_DOCS rows on. Very long texts are read whole. Repeated
    rows and null ids are rows like any other (a null id is never held out and never learned from); equal texts get
    equal answers; of languages that tie, the first by code is taken. Other columns are not read, whatever their names;
    an empty table gives no rows.
    """
    model = fit(training_rows(docs, id_col), text_col, lang_col, id_col, docs_per_language, segments, epochs, penalty, seed)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_batch(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], out.names)

    rows = spread(docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col)))
    out = rows.select(id_col, "held_out").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(apply, out)


def keep_identified(docs: DataFrame, *, text_col: str = "text", min_score: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and a score of at least ``min_score``. All columns stay."""
    id_col, lang_col = options.pop("id_col", "doc_id"), options.pop("lang_col", "lang")
    settings = {"docs_per_language": 150, "segments": 4, "epochs": 4, "penalty": 1e-4, "seed": 17} | options
    model = fit(training_rows(docs, id_col), text_col, lang_col, id_col, **settings)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_batch(model, batch.column(at))
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
