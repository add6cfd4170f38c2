"""Language identification, words first.

A word of the training vocabulary scores by its log frequency in each language.
Any other word backs off: by the mean log frequency of its character n-grams of
five letters, or if none is known of four, and so on down to single letters.
Words are runs of letters in lower case, in training and in prediction alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words

UNKNOWN = "und"
#: Labelled documents that a model is fitted on, and their UTF-8 bytes, at most about; all their words are learned.
TRAIN_DOCS, TRAIN_BYTES = 20_000, 64 << 20
LONGEST = 5
#: Words whose n-grams are worked out at a time when a model is made.
PIECE = 1 << 15
#: Texts that are scored at a time take at most so many UTF-8 bytes (or are one text): a pass holds some 15 times its bytes.
PASS_BYTES = 4 << 20
#: Words that count in full towards a document's score; further ones only sharpen it as their mean.
EVIDENCE = 24
_LETTERS = regex.compile(r"\p{L}+")


def split(chunk: str) -> list[str]:
    """The words of a chunk of text."""
    low = chunk.lower()
    return [low] if low.isalpha() else _LETTERS.findall(low)


class LanguageModel:
    """Log frequencies of words and n-grams for each language, in arrays, so it can be sent to executors.

    Words and n-grams are kept by 64-bit keys in order, and looked up for all
    words of a pass at once.
    """

    def __init__(self, languages: list[str], names: list[str], n: np.ndarray):
        """*n*: how often each of *names* (distinct) was seen in each of *languages*."""
        self.languages = list(languages)
        keys = self._word_keys(names)
        order = np.argsort(keys)
        self.keys, self.words = keys[order], self._log(n)[order]
        weight = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0)
        self.grams = [self._level(names, weight, size) for size in range(1, LONGEST + 1)]

    @classmethod
    def of(cls, counts: dict[str, dict[str, int]]) -> LanguageModel:
        """A model of {language: {word: count}}."""
        names = sorted({w for c in counts.values() for w in c})
        languages = sorted(counts)
        return cls(languages, names, np.array([[counts[x].get(w, 0) for x in languages] for w in names], float).reshape(len(names), len(languages)))

    @staticmethod
    def _log(n: np.ndarray) -> np.ndarray:
        return np.log((n + 0.5) / (n.sum(0) + 0.5 * len(n) + 1e-9)).astype(np.float32)

    @staticmethod
    def _word_keys(names: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), np.uint64, len(names))

    @staticmethod
    def _keys(names: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of words between marks for their ends; the marks alone are none."""
        return words.gram_keys([f"^{w}$" for w in names], size, inner=size == 1)

    def _level(self, names: list[str], weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n-grams of one size, and their log frequencies; worked out for PIECE words at a time."""
        unique, total = np.zeros(0, np.uint64), np.zeros((0, weight.shape[1]))
        for a in range(0, len(names), PIECE):
            keys, number = self._keys(names[a : a + PIECE], size)
            own = np.repeat(weight[a : a + PIECE], number, axis=0)
            unique, of = np.unique(np.concatenate([unique, keys]), return_inverse=True)
            before, total = total, np.empty((len(unique), weight.shape[1]))
            for k in range(weight.shape[1]):
                total[:, k] = np.bincount(of, np.concatenate([before[:, k], own[:, k]]), len(unique))
        return unique, self._log(total)

    def table(self, names: list[str] | pa.Array) -> np.ndarray:
        """Each word's score for each language, 0 for the best of each, all 0 for a word of unknown letters."""
        out = np.zeros((len(names), len(self.languages)), np.float32)
        if not len(self.keys) or not len(names):
            return out
        whole = isinstance(names, pa.Array)
        if whole:
            # keys in order find their places nearby
            keys = words.digests(names, xxhash.xxh64_intdigest)
            order, at = np.argsort(keys), np.empty(len(keys), np.int64)
            at[order] = np.searchsorted(self.keys, keys[order])
        else:
            keys = self._word_keys(names)
            at = np.searchsorted(self.keys, keys)
        at = np.minimum(at, len(self.keys) - 1)
        known = self.keys[at] == keys
        out[known] = self.words[at[known]]
        left = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            level, scores = self.grams[size - 1]
            if not len(left) or not len(level):
                continue
            if whole:
                keys, number = words.code_keys(*words.marked(*words.codes(names.take(pa.array(left)))), size, inner=size == 1)
            else:
                keys, number = self._keys([names[i] for i in left], size)
            place = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[place] == keys
            owner = np.repeat(np.arange(len(left)), number)[hit]
            found = np.bincount(owner, minlength=len(left))
            some = found > 0
            sums = np.column_stack([np.bincount(owner, scores[place[hit], k], len(left)) for k in range(out.shape[1])])
            out[left[some]] = sums[some] / found[some, None]
            left = left[~some]
        return out - out.max(1, keepdims=True)

    def word(self, word: str) -> np.ndarray:
        return self.table([word])[0]

    def answer(self, names: list[str] | pa.Array, index: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """As score(), for the texts of one pass (see words.batches_of_words); faster with the distinct chunks as an array."""
        if isinstance(names, pa.Array):
            found, at, number = words.letter_runs(names, split)
            each = self.table(found)[at]
        else:
            found: dict[str, int] = {}
            parts = [[found.setdefault(w, len(found)) for w in split(x)] for x in names]
            number = np.fromiter(map(len, parts), np.int64, len(parts))
            each = self.table(list(found))[np.fromiter((i for x in parts for i in x), np.int64, int(number.sum()))]
        # a chunk's words added up, and how many they are
        table = np.zeros((len(names), len(self.languages) + 1))
        some = number > 0
        if some.any():
            table[some, :-1] = np.add.reduceat(each, (np.cumsum(number) - number)[some], axis=0)
        table[:, -1] = number
        total = words.sums(table, index, bounds)
        n, scores = total[:, -1], total[:, :-1]
        if not self.languages:
            return [UNKNOWN] * len(n), np.zeros(len(n))
        scores = scores * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        odds = np.exp(scores - scores.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        return [self.languages[k] if some else UNKNOWN for k, some in zip(odds.argmax(1), n > 0)], np.where(n > 0, odds.max(1), 0.0)

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability; UNKNOWN and 0 without letters or without a language learnt."""
        labels: list[str] = []
        shares = []
        for _, _, names, index, bounds in words.batches_of_words(texts, PASS_BYTES):
            own, share = self.answer(names, index, bounds)
            labels += own
            shares.append(share)
        return labels, np.concatenate(shares) if shares else np.zeros(0)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> LanguageModel:
    """A model of all languages in *docs*; rows with a null text or language teach nothing.

    Fitted on at most about *train_docs* documents of *train_bytes* bytes; their
    words are counted where they are, and the driver gets each distinct one.
    Without rows the model knows no language.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = words.sample(known, train_docs, "id", train_bytes, "text")
    each = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = each.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow().sort_by([("word", "ascending"), ("lang", "ascending")])
    languages = sorted(counted["lang"].unique().to_pylist())
    of = {x: k for k, x in enumerate(languages)}
    word = counted["word"].combine_chunks().dictionary_encode() if len(counted) else pa.array([], pa.string()).dictionary_encode()
    n = np.zeros((len(word.dictionary), len(languages)))
    n[np.asarray(word.indices), np.fromiter((of[x] for x in counted["lang"].to_pylist()), np.int64, len(counted))] = np.asarray(counted["n"], float)
    names = word.dictionary.to_pylist()
    del counted, word
    return LanguageModel(languages, names, n)


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of *docs*: doc_id, lang_pred, score (0 to 1), from the whole text alone.

    A null text or one without letters is ``und`` with score 0.  Repeated rows
    give a row each, an empty table none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            labels, shares = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of *docs*, with all columns, whose language is known with a score of *least* or more.

    Rows stay where they are.  Null and letterless texts go; columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        labels, shares = shared.value.score(text)
        return pa.array(np.array([x != UNKNOWN for x in labels], bool) & (shares >= least))

    return docs.where(known(F.col(f"`{text_col}`").cast("string")))
