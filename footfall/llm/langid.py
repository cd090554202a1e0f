"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a space; n-grams of one to three characters are
hashed to `BUCKETS` slots, slot 0 being spaces only, which says nothing. Training sums the slots'
counts by language in Spark; only the matrix of languages x slots, whose size the parameters bound,
reaches the driver and is broadcast. Scoring is sparse: a text's n-grams are counted by slot, and the
counts of the slots it has are multiplied with their columns. Long texts are read in pieces whose
counts' scores add up, so memory doesn't grow with a text's length times the languages.

Of a language at most about `SAMPLE` labelled rows are learned from, all of a rarer one; priors are
over all labelled rows. A language whose rows have no letters is no candidate.

A null text, an empty one and one without letters get `und` with score 0, and so does every text if
there are no labelled rows to learn from. Rows that repeat, null ids and further columns don't matter
to a prediction; ties go to the language that sorts first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, named_as, plain

BUCKETS = 1 << 15
PIECE, BATCH, ROWS = 200_000, 400_000, 1000
#: Labelled rows of each language that are learned from, at most about; a documented bound of the classifier's fit.
SAMPLE = 5_000
MOST_LANGUAGES = 512


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Batches of pieces of texts: whose each is, where each begins, and their codes with two characters more at the ends."""
    owner, begin, parts, at = [], [], [], 0
    for i, t in enumerate(texts):
        t = f" {t.lower()}  "
        for p in range(0, len(t) - 2, PIECE):
            part = t[p : p + PIECE + 2]
            owner.append(i)
            begin.append(at)
            parts.append(part)
            at += len(part)
            if at >= BATCH:
                yield owner, begin, codes_of(parts)
                owner, begin, parts, at = [], [], [], 0
    if parts:
        yield owner, begin, codes_of(parts)


def codes_of(parts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[codes], codes, np.uint32(32))


def slots(codes: np.ndarray) -> list[np.ndarray]:
    """Slots of the n-grams that begin at each character but the last two."""
    a, b, c = (codes[i : len(codes) - 2 + i] for i in range(3))
    out = []
    for n, grams in enumerate((a, a * np.uint32(0x01000193) + b, (a * np.uint32(0x01000193) + b) * np.uint32(0x01000193) + c)):
        h = (grams + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        blank = a == 32
        if n:
            blank = blank & (b == 32)
        if n > 1:
            blank = blank & (c == 32)
        out.append(np.where(blank, 0, 1 + (h >> np.uint32(8)) % np.uint32(BUCKETS - 1)).astype(np.int32))
    return out


def slot_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(whose, slots, how often each) of every piece; slot 0, spaces only, tells how many n-grams have no letter."""
    for owner, begin, codes in pieces(texts):
        ids = slots(codes)
        for i, s, e in zip(owner, begin, [*begin[1:], len(codes)], strict=True):
            n = sum(np.bincount(x[s : e - 2], minlength=BUCKETS) for x in ids)
            some = np.flatnonzero(n)
            yield i, some, n[some]


def counted(labelled: DataFrame) -> DataFrame:
    """(lang, slot, n) from rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(*(b.column(c).slice(k, ROWS).to_pylist() for c in range(2)), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for _, some, n in slot_counts(texts):
                        own[some] += n
        for lang, own in total.items():
            ids = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(own[ids])], ["lang", "slot", "n"])

    return labelled.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix languages x slots of log probabilities; slot 0 has the log priors.

    labelled has doc_id, text and lang. Of more than `sample` rows of a language a share is drawn by a
    hash of id and text.
    """
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(prior) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages are labelled")
    often = {k: sample / n for k, n in prior.items() if n > sample}
    if often:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in often.items() for x in p]), F.col("lang")), F.lit(1.0))
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1_000_000)) < share * 1_000_000)
    packed = counted(rows.select("lang", "text")).filter("slot > 0").groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c"))  # BUCKETS entries at most
    found = packed.select("lang", F.col("c.slot").alias("slots"), F.col("c.n").alias("counts")).toArrow().sort_by("lang")  # a row a language, as arrays of numbers
    langs = found["lang"].to_pylist()
    matrix = np.full((len(langs), BUCKETS), 0.5)
    for own, slots, counts in zip(matrix, found["slots"], found["counts"], strict=True):
        own[slots.values.to_numpy()] += counts.values.to_numpy()
    matrix[:, 0] = 0
    if langs:
        matrix[:, 1:] = np.log(matrix[:, 1:] / matrix[:, 1:].sum(1, keepdims=True))
        matrix[:, 0] = np.log([prior[x] / sum(prior.values()) for x in langs])
    return langs, matrix.astype(np.float32)


def score(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    table = np.ascontiguousarray(matrix.T)
    prior = table[0].astype(np.float64)
    sums, lettered = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), bool)
    for i, some, n in slot_counts(texts):
        begin = int(len(some) > 0 and some[0] == 0)
        if begin < len(some):
            lettered[i] = True
            sums[i] += n[begin:] @ table[some[begin:]].astype(np.float64)
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = sums.argmax(1)
    share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    return [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], [float(x) if ok else 0.0 for x, ok in zip(share, lettered, strict=True)]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if not given) with lang_pred and score, which replace columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("text scored"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        for b in batches:
            names, scores = [], []
            for k in range(0, b.num_rows, ROWS):
                some = score([t or "" for t in b.column(b.num_columns - 1).slice(k, ROWS).to_pylist()], langs, matrix)
                names += some[0]
                scores += some[1]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = picked.drop("text scored").schema.add("lang_pred", "string").add("score", "double")
    return picked.mapInArrow(run, schema)


def held_out(modulus: int = 5) -> Column:
    return bucket_of("doc_id", modulus) == 0


def reject_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those whose language can't be told: `und`, or no language with a share of `least`.

    The model is learned from the rows that have a lang, and the columns stay as they are.
    """
    same = ("doc_id", "text", "lang")
    judged = predict(plain(docs, *same), train(docs.filter(~held_out())))
    return named_as(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs, *same)
