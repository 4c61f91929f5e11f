"""Language identification by bit-sliced Bloom filters over letter trigrams.

One filter per language would need one look-up per language. Bit-sliced, row i of
the table holds bit i of every language's filter side by side, so the AND of a
trigram's k rows is the bitmask of all languages that contain it. A text's
popcounts per language, less what the filters answer wrongly by chance, decide.

Texts without a letter, and null, are ``und`` with score 0. Nothing to learn from
makes every text ``und``. Equal counts go to the smaller language name; a text of
which no language knows a trigram goes to the language with most trigrams.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docfathom.llm.text import held_out, mix64, runs, texts
from docfathom.session import materialize

UNDETERMINED = "und"
#: A trigram belongs to a language if it makes at least this share of its trigrams.
#: So no language has more than 1 / MIN_SHARE of them, whatever the corpus.
MIN_SHARE = 2e-5
#: More label values than this are no languages; the model would not be bounded.
MAX_LANGUAGES = 512
HASHES = 3
#: Code points handled at once.
SLICE = 1 << 20
#: Distinct trigrams that a task keeps before it passes them on.
HELD = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, the bit-sliced table (rows x words), chance answers."""

    languages: tuple[str, ...]
    rows: np.ndarray
    false_positive: np.ndarray
    fallback: int


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed lower-case letter trigrams (space for all else) and whose they are.

    Each has a letter in its middle, so a word of n letters has n trigrams.
    """
    lowered = [t.lower() for t in batch]
    codes = np.frombuffer(f" {'  '.join(lowered)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    middles = np.flatnonzero(is_letter)
    kept = np.where(is_letter, codes, 32).astype(np.uint64)
    packed = kept[middles - 1] << np.uint64(42) | kept[middles] << np.uint64(21) | kept[middles + 1]
    ends = np.cumsum([len(t) + 2 for t in lowered])
    return packed, np.searchsorted(ends, middles, side="right")


def _places(packed: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """The k rows of each trigram, by double hashing; ``n_rows`` is a power of two."""
    h = mix64(packed)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(n_rows - 1)).astype(np.intp) for i in range(HASHES)]


def build_model(grams: dict[str, np.ndarray], totals: dict[str, int]) -> LanguageModel:
    """The filters over each language's packed trigrams."""
    languages = tuple(sorted(grams))
    most = max((len(g) for g in grams.values()), default=0)
    n_rows = 1 << max(10, int(np.ceil(np.log2(max(most, 1) * 12))))
    rows = np.zeros((n_rows, max(1, -(-len(languages) // 64))), np.uint64)
    for i, language in enumerate(languages):
        for at in _places(grams[language], n_rows):
            rows[at, i // 64] |= np.uint64(1 << (i % 64))
    fill = [np.mean(rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]
    fallback = max(range(len(languages)), key=lambda i: (totals[languages[i]], -i), default=0)
    return LanguageModel(languages, rows, np.array(fill, float) ** HASHES, fallback)


def predict(model: LanguageModel, batch: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text: the share of trigrams its language knows."""
    n, languages = len(batch), model.languages
    packed, owner = trigrams(batch)
    total = np.bincount(owner, minlength=n)
    if not languages:
        return [UNDETERMINED] * n, [0.0] * n
    at = _places(packed, len(model.rows))
    masks = model.rows[at[0]]
    for i in at[1:]:
        masks &= model.rows[i]
    counts = np.empty((len(languages), n))
    for i, wrong in enumerate(model.false_positive):
        hit = masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)
        counts[i] = np.bincount(owner[hit.astype(bool)], minlength=n)
        # c hits of n trigrams, of which a share is known by chance alone.
        counts[i] = np.maximum(0, (counts[i] - total * wrong) / (1 - wrong) if wrong < 1 else 0)
    best = np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), model.fallback)
    score = counts[best, np.arange(n)] / np.maximum(total, 1)
    names = [languages[b] if t else UNDETERMINED for b, t in zip(best, total)]
    return names, np.where(total > 0, np.clip(score, 0, 1), 0.0).tolist()


def _trigram_counts(batches):
    """(lang, packed, n) of a task's rows, added up as far as memory allows."""

    def out(held):
        for lang, (keys, sums) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": sums}
            )

    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs, batch_texts = batch.column("lang").to_pylist(), texts(batch)
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(langs, batch_texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            for a, b in runs([len(t) for t in own], SLICE):
                keys, n = np.unique(trigrams(own[a:b])[0], return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], keys])
                    keys, back = np.unique(both, return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = keys, n
                if sum(len(k) for k, _ in held.values()) > HELD:
                    yield from out(held)
                    held = {}
    yield from out(held)


def fit(docs: DataFrame, lang: str = "lang", min_share: float = MIN_SHARE) -> LanguageModel:
    """Learn from every row of ``docs`` with a text and a language."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col("text").alias("text")).dropna()
    counts = labelled.mapInArrow(_trigram_counts, "lang string, gram long, n long")
    counts = materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = totals.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang}")
    kept = (
        counts.join(F.broadcast(totals), "lang")
        .filter(F.col("n") >= F.lit(min_share) * F.col("total"))
        .select("lang", "gram")
        .toArrow()
    )
    names = np.array(kept["lang"].to_pylist(), object)
    grams = kept["gram"].to_numpy().view(np.uint64)
    return build_model(
        {r.lang: grams[names == r.lang] for r in rows}, {r.lang: r.total for r in rows}
    )


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns so named."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see MIN_SHARE
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches):
        for batch in batches:
            found = texts(batch)
            names, scores = [], []
            for a, b in runs([len(t) for t in found], SLICE):
                more, values = predict(sent.value, found[a:b])
                names += more
                scores += values
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    schema = type(docs.schema)(list(kept)).add("lang_pred", "string").add("score", "double")
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows whose text is in a language the model knows, columns as they were.

    Rejected are texts without a letter and those whose best language knows less
    than the share ``least`` of their trigrams. A model without languages has nothing
    to say against a text with letters.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = texts(batch)
            keep = []
            for a, b in runs([len(t) for t in found], SLICE):
                names, scores = predict(sent.value, found[a:b])
                if sent.value.languages:
                    keep += [n != UNDETERMINED and s >= least for n, s in zip(names, scores)]
                else:
                    keep += [any(map(str.isalpha, t)) for t in found[a:b]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learns(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: three of four by their id's crc32."""
    return ~held_out(doc_id, 4, 2)
