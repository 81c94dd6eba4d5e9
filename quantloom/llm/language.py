"""Language identification by error-correcting output codes over hashed letter n-grams.

Every language gets a codeword; each bit has a binary classifier, a log-odds weight per hashed
n-gram between the languages whose bit is one and those whose bit is zero. The n-gram counts come
from all training documents, summed by Spark per language and bucket, so the model has at most
languages x ``BUCKETS`` numbers. A text's margins are averages over its n-grams. Decoding weighs
each bit's logistic loss by how well the bit separates the languages and takes the codeword with
the least loss; a small lead over the second best flags the text as ambiguous.

Defined cases: null and letter-free texts are ``und`` with score 0, flagged; texts are lower-cased
and only runs of letters count; rows without language don't train; without any training language all
is ``und``; ties go to the language that sorts first; repeated rows count again in training; languages
that no bit tells apart share the score, so texts in them are flagged. Of more than ``MAX_LANGUAGES``
language values those with most n-grams are learned, ties by name; rows of the others don't train.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import in_batches, unused, utf8

#: Hash buckets for n-grams (a power of two), and the n-gram lengths in bytes.
BUCKETS, ORDERS = 1 << 16, (3, 4)
#: Bytes of text that a task works on at once, and the most languages that a model learns.
PIECE, MAX_LANGUAGES = 1 << 19, 512
#: Lead of the best score over the second under which a text is flagged as ambiguous.
MIN_LEAD = 0.1
#: Evidence at which margins stop growing with the text, in n-grams.
FULL_EVIDENCE = 40.0
UNDETERMINED = "und"
_LETTERS = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def codewords(n: int) -> np.ndarray:
    """``n`` codewords as rows of 0 and 1: exhaustive up to five languages, else the best of fixed random draws."""
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= 5:
        bits = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and not all(c)]
        return np.array(bits, np.int8).T
    draws, width = np.random.default_rng(n), int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        code = draws.integers(0, 2, (n, width), dtype=np.int8)
        apart = (code[:, None] != code[None]).sum(2)
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > gap and 0 < code.sum(0).min() and code.sum(0).max() < n:
            best, gap = code, least
    return best


def _letters(text: str | None) -> bytes:
    """Lower-cased text as UTF-8, with blanks for ASCII that isn't a letter, and a blank at either end."""
    return b" " + utf8(text and text.lower()).translate(_LETTERS) + b" " if text else b""


def _features(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket at each position, once for each n-gram length (wrapping at the end)."""
    wide = np.concatenate((data, np.zeros(max(ORDERS), np.uint8))).astype(np.uint64)
    for n in ORDERS:
        code = np.full(len(data), n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | wide[k : len(data) + k]
        yield ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def _valid(lengths: np.ndarray, n: int) -> np.ndarray:
    """Positions at which an n-gram ends within its own text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(len(ends)) + n <= ends


@dataclass
class LanguageModel:
    """Learned languages, their codewords, bit weights by bucket, and each bit's separation."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    separation: np.ndarray

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray) -> LanguageModel:
        """``counts``: a row of bucket counts for each language."""
        code = codewords(len(languages))
        if len(languages) <= 1:
            return cls(languages, code, np.zeros((BUCKETS, 1), np.float32), np.ones(1))
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        weights, apart = np.empty((BUCKETS, code.shape[1]), np.float32), []
        for b, bit in enumerate(code.T):
            one, zero = p[bit == 1].mean(0), p[bit == 0].mean(0)
            w = np.log(one) - np.log(zero)
            weights[:, b] = w
            apart.append(((one - zero) * w).sum() / 2)
        apart = np.array(apart)
        useful = apart > 1e-12  # a bit whose two sides count alike tells nothing
        weights[:, ~useful] = 0
        share = apart * useful / apart[useful].sum() if useful.any() else np.full(len(apart), 1 / len(apart))
        return cls(languages, code, weights / np.where(useful, apart, 1).astype(np.float32), share)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and lead (score of the best minus that of the second) of each text."""
        import regex

        letter = regex.compile(r"\p{L}")
        named = np.array([bool(t and letter.search(t)) for t in texts], bool)
        k = len(self.languages)
        if not k:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        data = [_letters(t) if ok else b"" for t, ok in zip(texts, named)]
        margin = self._margins(data)
        sign = 2.0 * self.code - 1
        loss = (np.log1p(np.exp(-4 * margin[:, None, :] * sign[None])) * self.separation).sum(2)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        lead = score - (np.sort(p, 1)[:, -2] if k > 1 else 0)
        language = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named)]
        return language, np.where(named, score, 0.0).tolist(), np.where(named, lead, 0.0).tolist()

    def _margins(self, data: list[bytes]) -> np.ndarray:
        out = np.zeros((len(data), self.weights.shape[1]))
        lengths = np.array([len(d) for d in data], np.int64)
        seen = np.zeros(len(data))
        full = np.flatnonzero(lengths)
        if len(full):
            joined = np.frombuffer(b"".join(data), np.uint8)
            starts = (np.cumsum(lengths) - lengths)[full]
            blanks = joined == 32
            for n, bucket in zip(ORDERS, _features(joined)):
                ok = _valid(lengths, n) & ~(blanks & np.roll(blanks, -1))
                got = self.weights[bucket]
                got[~ok] = 0
                out[full] += np.add.reduceat(got, starts, axis=0, dtype=np.float64)
                seen[full] += np.add.reduceat(ok, starts, dtype=np.int64)
        evidence = np.minimum(1, seen / FULL_EVIDENCE)
        return np.clip(out / np.maximum(seen, 1)[:, None], -4, 4) * evidence[:, None]


def train(docs: DataFrame) -> LanguageModel:
    """A model from ``text`` and ``lang`` of all rows that have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            held: dict[str, int] = {}

            def add(lang: str) -> None:
                parts = by.pop(lang, [])
                lengths = np.array([len(x) for x in parts], np.int64)
                joined = np.frombuffer(b"".join(parts), np.uint8)
                held[lang] = 0
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                blanks = joined == 32
                for n, bucket in zip(ORDERS, _features(joined)):
                    own += np.bincount(bucket[_valid(lengths, n) & ~(blanks & np.roll(blanks, -1))], minlength=BUCKETS)

            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(_letters(text))
                held[lang] = held.get(lang, 0) + len(by[lang][-1])
                if held[lang] > PIECE:
                    add(lang)
            for lang in list(by):
                add(lang)
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    rows = in_batches(docs).select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"), F.sum("n").alias("all"))
    found = sorted(whole.orderBy(F.desc("all"), "lang").limit(MAX_LANGUAGES).collect(), key=lambda r: r["lang"])
    counts = np.zeros((len(found), BUCKETS))
    for row, own in zip(found, counts):
        own[np.array(row["at"], np.int64)] = row["n"]
    return LanguageModel.from_counts([r["lang"] for r in found], counts)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` and a last column, a struct of ``pred``, ``score`` and ``lead``; its name is one that ``docs`` doesn't have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = unused(docs, "__lang")
    out = in_batches(docs).withColumn(name, F.lit(None).cast("struct<pred:string,score:double,lead:double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            at = batch.num_columns - 1
            found: list[dict] = []
            start = size = 0
            for i, t in enumerate([*texts, None]):
                if i == len(texts) or size and size + len(t or "") > PIECE:
                    found += [{"pred": p, "score": s, "lead": d} for p, s, d in zip(*model.predict(texts[start:i]))]
                    start, size = i, 0
                size += len(t or "")
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return out.mapInArrow(run, out.schema)


def fold(column: str, folds: int) -> Column:
    """crc32 of the column as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def language_report(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``; learns only from documents outside the held-out fold."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", folds) != held_out))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), F.col("__lang.pred").alias("lang_pred"), F.col("__lang.score").alias("score"), (F.col("__lang.lead") < MIN_LEAD).alias("ambiguous"))


def keep_identified(docs: DataFrame, min_lead: float = 0.02) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or two languages less than ``min_lead`` apart.

    Where no row names a language there is nothing to tell apart, and each text with a letter stays.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model)
    own = F.col(found.columns[-1])
    return found.where((own["pred"] != UNDETERMINED) & (own["lead"] >= min_lead)).select(*docs.columns)
