"""Operator 6: quality rules and a hashed n-gram logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.words import Texts, batches, mix

#: Most labelled rows that the classifier is fitted on, and the share of these held out for calibration.
FIT_ROWS, CALIBRATE = 8000, 0.25
#: Hash bits of word and of character n-gram features, characters (bytes) of a gram.
BITS, GRAM = 17, 4
#: Fixed thresholds: least probability of good quality, fewest words, most repeated words in percent.
LEAST_QUALITY, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50
EPOCHS, RATE, RIDGE, SCALE = 120, 0.05, 1e-4, 30.0
#: Entries of texts' features that a step of the fit works on at once.
PART = 200_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [at, until)."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[until] - total[at]


def counts(t: Texts) -> pd.DataFrame:
    """Word, symbol, repeated line and repeated word counts of each text (``fold=False``)."""
    lead = (t.buf & 0xC0) != 0x80
    size = (t.first[1:] - t.first[:-1]).astype(np.int64)
    in_words = np.zeros(len(t.buf) + 1, np.int8)
    in_words[t.start] += 1
    in_words[t.stop] -= 1
    in_words = np.cumsum(in_words[:-1]).astype(bool)
    out = pd.DataFrame({"n_words": size, "word_chars": _sums(lead & in_words, t.begin, t.end),
                        "n_symbols": _sums(_SYMBOL[t.buf], t.begin, t.end)})
    dup = np.zeros(t.n, np.int64)
    for i in range(t.n):
        lines = [x for x in t.buf[t.begin[i]:t.end[i]].tobytes().split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    # 3-word windows, each with its text's number in the hash
    h = t.word_hash()
    whole = np.flatnonzero(t.doc[2:] == t.doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    key = mix(h[whole] * np.uint64(3) + mix(h[whole + 1] + np.uint64(1)) * np.uint64(5)
              + mix(h[whole + 2] + np.uint64(2)) * np.uint64(7) + mix(t.doc[whole].astype(np.uint64)))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    again = whole[n[back] > 1]
    mark = np.zeros(len(h) + 3, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + 3, -1)
    out["n_repeat_words"] = _sums(np.cumsum(mark)[:len(h)] > 0, t.first[:-1], t.first[1:])
    return out


def _features(t: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashed feature of each word or gram, begin and end of each text's) for words and for grams."""
    words = (t.word_hash() >> np.uint64(64 - BITS)).astype(np.int64)
    n = max(0, len(t.buf) - GRAM + 1)
    gram = np.zeros(n, np.uint32)
    for i in range(GRAM):
        gram = gram * np.uint32(0x01000193) + t.buf[i:i + n]
    gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS)
    last = np.maximum(t.begin, t.end - GRAM + 1)
    return [(words, t.first[:-1], t.first[1:]), (gram, t.begin, last)]


def logits(t: Texts, weights: np.ndarray) -> np.ndarray:
    """Score of each text: the mean weight of its words plus that of its grams, and a constant.

    Weights are summed as whole multiples of 2**-30, so that a text's score
    doesn't depend on the texts beside it in a batch.
    """
    whole = np.rint(np.asarray(weights, np.float64) * (1 << 30)).astype(np.int64)
    out = np.full(t.n, float(weights[-1]))
    for index, at, until in _features(t):
        out += SCALE * _sums(whole[index], at, until) / np.maximum(until - at, 1) / (1 << 30)
    return out


def _packed(texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, count, ends of the runs) of some texts at a time: each text's words and then its grams, eight bytes an entry.

    The fit goes through these parts once a step, so what it holds beside them is for PART entries, not for all texts.
    """
    index, count, ends, size = [], [], [], 0
    for text in texts:
        for idx, at, until in _features(Texts([text], fold=False)):
            u, n = np.unique(idx[at[0]:until[0]], return_counts=True)
            index.append(u.astype(np.int32))
            count.append(n.astype(np.int32))
            size += len(u)
            ends.append(size)
        if size >= PART:
            yield np.concatenate(index), np.concatenate(count), np.array(ends)
            index, count, ends, size = [], [], [], 0
    if ends:
        yield np.concatenate(index), np.concatenate(count), np.array(ends)


def fit(texts: list[str | None], good: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Weights and the two calibration terms, or None unless both classes are there to learn and to calibrate.

    Rows must come in a fixed order; every fourth is held out and a logistic
    curve over the scores is fitted to it (Platt), which makes the
    probabilities honest.  Classes weigh the same in the fit.
    """
    held = np.arange(len(texts)) % round(1 / CALIBRATE) == 0
    if len(texts) == 0 or len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        return None
    size = 2 * (1 << BITS) + 1
    y = good[~held].astype(np.float64)
    parts = list(_packed(np.array(texts, object)[~held]))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, EPOCHS + 1):
        grad, lead, constant = np.zeros(size), 0, w[-1]
        err = np.zeros(len(y))
        for index, n, ends in parts:
            k = len(ends) // 2
            runs = np.diff(ends, prepend=0)
            row = np.repeat(np.arange(2 * k) // 2, runs)
            value = SCALE * n / np.repeat(np.maximum(1, np.add.reduceat(np.append(n, 0), np.append(0, ends[:-1])) * (runs > 0)), runs)
            own = slice(lead, lead + k)
            z = np.bincount(row, value * w[index], k) + constant
            err[own] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * share[own]
            np.add.at(grad, index, value * err[own][row])
            lead += k
        grad += RIDGE * w
        grad[-1] = err.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    s = np.concatenate([logits(Texts([x], fold=False), w) for x in np.array(texts, object)[held]])
    a, b, y = 1.0, 0.0, good[held].astype(np.float64)
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # Platt's targets
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((p - y) * s).sum(), (p - y).sum()])
        q = p * (1 - p)
        hess = np.array([[(q * s * s).sum(), (q * s).sum()], [(q * s).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w.astype(np.float32), float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The model of ``fit`` from at most ``fit_rows`` labelled rows, those of the smallest hash of doc_id.

    The ids are chosen first, at most ``fit_rows`` of them, so only their
    texts move, to one task; the model is of a fixed size.
    """
    chosen = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "quality": []}), *frames], ignore_index=True)
        order = mix(all_["doc_id"].to_numpy().astype(np.int64).astype(np.uint64))
        all_ = all_.assign(o=order, k=all_["text"].fillna("")).sort_values(["o", "k"]).drop_duplicates("doc_id")
        got = fit(all_["text"].tolist(), all_["quality"].to_numpy() > 0)
        if got:
            yield pd.DataFrame({"w": [got[0].tobytes()], "a": [got[1]], "b": [got[2]]})

    model = rows.mapInPandas(run, "w binary, a double, b double").collect()
    return (np.frombuffer(model[0].w, np.float32), model[0].a, model[0].b) if model else None


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id), the counts, base_failed, quality and kept; a row per row of ``docs``.

    ``quality`` is the calibrated probability that the text is good.  kept:
    not base_failed and quality of at least 0.5.  Without labels of both
    kinds quality is null and only the base rules judge.  Null and empty
    text: no words, fails.  Repeated rows: judged alike; null doc_id: judged
    like any.  Empty table: empty result.  Texts are read whole.
    """
    keep = keep or ["doc_id"]
    model = train(docs, labels, fit_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 * 2**BITS + 1 floats
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames):
            t = Texts(pdf["text"], fold=False)
            out = counts(t)
            out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
            good = ~out["base_failed"]
            if held.value:
                w, a, b = held.value
                out["quality"] = 1 / (1 + np.exp(-np.clip(a * logits(t, w) + b, -30, 30)))
                good &= out["quality"] >= LEAST_QUALITY
            else:
                out["quality"] = None
            out["kept"] = good
            yield pd.concat([pdf[keep].reset_index(drop=True), out], axis=1)

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInPandas(run, (
        f"{schema}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, quality double, kept boolean"))


def good_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, in one pass over the texts."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so no column clashes with the counts
    plain = docs.toDF(*names)
    marked = judge(plain.withColumns({"doc_id": F.col(names[docs.columns.index("doc_id")]),
                                      "text": F.col(names[docs.columns.index("text")])}), labels, fit_rows, names)
    return marked.where("kept").select(*names).toDF(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "quality")
