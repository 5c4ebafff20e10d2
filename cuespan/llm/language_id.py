"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces, which a forward
pass over the word's piece graph gives; a text's is the product over its words. No piece reaches
from one word into the next, so this equals the sum over all segmentations of the text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cuespan.llm.chunks import give_back, slices
from cuespan.llm.common import hash60
from cuespan.llm.pieces import PieceEncoder, broadcast_tables, encoder

UNKNOWN = "und"
#: Forward values are divided by their largest this often, so long words do not underflow.
RESCALE = 64
#: Below this a word's value is too small to trust, and is summed again in logarithms.
TINY = 1e-250
#: Probability of a byte that no piece covers, the same in every language.
BARE = 1e-4
#: Words a worker remembers the scores of.
MEMO_WORDS = 150_000


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id is read as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class LanguageModel:
    """Languages and log-probabilities of pieces, [language, piece id]."""

    languages: list[str]
    log_p: np.ndarray


def fit(docs: DataFrame, model_path: str, max_docs: int = 8000, alpha: float = 0.5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Piece probabilities from the labelled documents whose id is not held out.

    At most about `max_docs` documents of a language are used: a pseudo-random sample by id, all
    if there are fewer. Counts are smoothed by `alpha`. The counts that reach the driver are one
    per language and piece of the vocabulary at most.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, 0)))
    limits = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, max_docs / sizes[lang]) * (1 << 60))))])
    rows = rows.where(hash60(seed, "doc_id") < limits[F.col("lang")])
    tables = broadcast_tables(docs, model_path)
    index = {lang: i for i, lang in enumerate(languages)}
    n_pieces = len(tables.value.text)

    def count(batches):
        own, total = encoder(tables), np.zeros((len(index), n_pieces), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = own.memo.rows(*own.cut(part.column("text")))
                lang = np.repeat([index[x] for x in part.column("lang").to_pylist()], np.diff(bounds))
                total += np.bincount(lang * n_pieces + ids, minlength=total.size).reshape(total.shape)
        own.memo.clear()
        give_back()
        lang, piece = np.nonzero(total)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang long, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), n_pieces))
    for r in counts.toPandas().itertuples(index=False):
        table[r.lang, r.piece] = r.n
    table[:, tables.value.matched] += alpha
    total = table[:, tables.value.matched].sum(axis=1, keepdims=True)
    return LanguageModel(languages, np.log(np.maximum(table, 1e-300) / total))


class WordScorer:
    """A worker's log-probabilities of words in every language, remembered."""

    def __init__(self, own: PieceEncoder, model: LanguageModel):
        self.own = own
        self.p = np.exp(np.vstack([model.log_p[:, own.t.matched].T, np.full(len(model.languages), np.log(BARE))]))  # the last row is index -1
        self.slot: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 14, self.p.shape[1]))

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Log of the sum over all segmentations, [word, language]."""
        data, starts, ends, piece, at, end, offset = self.own.graph(words)
        alpha = np.zeros((len(data) + 1, self.p.shape[1]))
        alpha[starts] = 1.0
        scale, length = np.zeros((len(words), self.p.shape[1])), ends - starts
        cuts = np.flatnonzero(np.diff(offset)) + 1
        reach = int(self.own.matcher.size.max())
        step_before = 0
        for lo, hi in zip(np.concatenate([[0], cuts]), np.append(cuts, len(offset))):
            step = int(offset[lo])
            if step // RESCALE > step_before // RESCALE:
                long = np.flatnonzero(length >= step)
                window = (starts[long] + step - 1)[:, None] - np.arange(min(reach, step))
                most = alpha[window].max(axis=1)
                most[most <= 0] = 1.0
                alpha[window] /= most[:, None, :]
                scale[long] += np.log(most)
            step_before = step
            value = alpha[at[lo:hi]] * self.p[piece[lo:hi]]
            target = end[lo:hi]
            order = np.argsort(target, kind="stable")
            target = target[order]
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            alpha[target[first]] = np.add.reduceat(value[order], first, axis=0)
        small = np.flatnonzero((alpha[ends] < TINY).any(axis=1))
        with np.errstate(divide="ignore"):
            out = np.log(alpha[ends]) + scale
        if len(small):
            out[small] = self.forward_logs([words[i] for i in small])
        return out

    def forward_logs(self, words: list[bytes]) -> np.ndarray:
        """The same in logarithms throughout: slower, and nothing is too small."""
        data, starts, ends, piece, at, end, offset = self.own.graph(words)
        alpha = np.full((len(data) + 1, self.p.shape[1]), -np.inf)
        alpha[starts] = 0.0
        log_p = np.log(self.p)
        cuts = np.flatnonzero(np.diff(offset)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.append(cuts, len(offset))):
            order = np.argsort(end[lo:hi], kind="stable") + lo
            target, value = end[order], alpha[at[order]] + log_p[piece[order]]
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            most = np.maximum.reduceat(value, first, axis=0)
            most[~np.isfinite(most)] = 0.0
            parts = np.exp(value - np.repeat(most, np.diff(np.append(first, len(order))), axis=0))
            with np.errstate(divide="ignore"):
                alpha[target[first]] = most + np.log(np.add.reduceat(parts, first, axis=0))
        return alpha[ends]

    def word_scores(self, words: pa.Array) -> np.ndarray:
        if len(self.slot) > MEMO_WORDS:
            self.slot, self.scores = {}, np.zeros((1 << 14, self.scores.shape[1]))
        values = words.to_pylist()
        out = np.fromiter((self.slot.get(v, -1) for v in values), np.int64, len(values))
        missing, size, group = np.flatnonzero(out < 0), 0, []
        for i in missing:
            group.append(i)
            size += len(values[i])
            if size >= 1 << 17 or i == missing[-1]:
                base, need = len(self.slot), len(self.slot) + len(group)
                if need > len(self.scores):
                    self.scores = np.vstack([self.scores, np.zeros((max(need, len(self.scores)), self.scores.shape[1]))])
                self.scores[base:need] = self.forward([values[k] for k in group])
                self.slot.update((values[k], base + n) for n, k in enumerate(group))
                out[group] = np.arange(base, need)
                group, size = [], 0
        return self.scores[out]

    def texts(self, column: pa.Array) -> np.ndarray:
        """Log-probability of each text in each language."""
        words, first = self.own.cut(column)
        if not len(words):
            return np.zeros((len(column), self.p.shape[1]))
        scores = self.word_scores(words.dictionary)
        flat = scores[words.indices.to_numpy(zero_copy_only=False)]
        total = np.zeros((len(column), self.p.shape[1]))
        full = np.flatnonzero(np.diff(first))
        total[full] = np.add.reduceat(flat, first[full], axis=0)
        return total


_SCORERS: dict[int, WordScorer] = {}


def predict(docs: DataFrame, model: LanguageModel, model_path: str, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the predicted language and its share of the likelihood among the learned languages.

    Null texts, texts without a letter, and all texts when nothing was learned get `und` and 0.
    Equal likelihoods go to the language first in code point order. Columns already named like
    the new ones are replaced; other columns and repeated rows stay as they are.
    """
    docs = docs.drop(pred_col, score_col)
    tables, learned = broadcast_tables(docs, model_path), docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{pred_col}` string", f"`{score_col}` double"])

    def score(batches):
        value = learned.value
        if value.languages:
            key = zlib.crc32(value.log_p.tobytes())
            if key not in _SCORERS:
                _SCORERS.clear()
                _SCORERS[key] = WordScorer(encoder(tables), value)
            own = _SCORERS[key]
        for batch in batches:
            for part in slices(batch, text_col):
                column = part.column(text_col)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if value.languages:
                    logs = own.texts(column)
                    best = logs.argmax(axis=1)
                    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [value.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                    share = np.where(letters, share, 0.0)
                else:
                    names, share = [UNKNOWN] * len(column), np.zeros(len(column))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(share)], [*part.schema.names, pred_col, score_col])
        _SCORERS.clear()  # a worker lives on: the next stage needs the memory
        give_back()

    return docs.mapInArrow(score, schema)


def identify_languages(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Learns from the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score.

    See `fit` and `predict` for nulls, texts without letters and ties; an empty table gives no
    rows. Predictions see the text alone.
    """
    model = fit(docs, model_path, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model, model_path).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
