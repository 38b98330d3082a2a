"""Quality classifier from weak labels.

1. Heuristic labellers, which overlap and may be wrong, vote good, bad or nothing
   on every document. Votes are counted by pattern: at most 3**len(LABELLERS) rows
   whatever the input.
2. Expectation-maximisation over the patterns estimates each labeller's accuracy
   and the share of good documents, without any true label.
3. The posterior labels of a bounded sample (SAMPLE documents, chosen by the hash of
   id and text) train a linear scorer over hashed words and word shapes.
4. The scorer scores every document.

Defined results: a null or empty text votes nothing and gets the score of the
scorer's constant and is not kept; null ids pass through; repeated rows are scored
one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, table
from .quality_rules import SEPARATOR, SYMBOLS, count_repeated

SAMPLE = 6_000
BUCKETS = 1 << 15
EM_STEPS = 200
EPOCHS = 300
THRESHOLD = 0.5
#: Words that each text is taken to have besides its own, of no weight: short texts lean on the constant.
PRIOR_WORDS = 10


def measures(text: str, words: list[str]) -> dict[str, float]:
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    return {
        "n": len(words),
        "symbols": (sum(map(text.count, SYMBOLS)) + text.count("!!")) / chars,
        "repeats": count_repeated(words) / n,
        "upper": sum(len(w) > 1 and w.isupper() for w in words) / n,
        "marks": text.count("!") / n,
        "bars": len(SEPARATOR.findall(text)) / n,
        "variety": len(set(words)) / n**0.8,
        "stops": sum(w[-1] in ".,;:?" for w in words) / n,
        "length": chars / n,
        "neighbours": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    }


def _band(x: float, good: tuple[float, float], bad_below: float, bad_above: float) -> int:
    return 1 if good[0] <= x <= good[1] else -1 if x < bad_below or x > bad_above else 0


#: name: vote of the measures, 1 good, -1 bad, 0 nothing.
LABELLERS = {
    "few symbols": lambda m: _band(m["symbols"], (0, 0.02), -1, 0.08),
    "few repeats": lambda m: _band(m["repeats"], (0, 0.08), -1, 0.3) if m["n"] >= 10 else 0,
    "lower case": lambda m: _band(m["upper"], (0, 0.1), -1, 0.4) if m["n"] >= 5 else 0,
    "calm": lambda m: _band(m["marks"], (0, 0.03), -1, 0.2),
    "no table": lambda m: _band(m["bars"], (0, 0.02), -1, 0.2),
    "varied": lambda m: _band(m["variety"], (0.9, 99), 0.5, 1e9) if m["n"] >= 30 else 0,
    "sentences": lambda m: _band(m["stops"], (0.04, 0.45), 0.02, 0.9) if m["n"] >= 20 else 0,
    "word length": lambda m: _band(m["length"], (3, 9), 2, 14),
}

DENSE = ("symbols", "repeats", "upper", "marks", "bars", "neighbours")


def shape(word: str) -> str:
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Buckets(dict):
    """Word to its bucket and its shape's bucket, as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        b = lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS
        self[word] = n = b("w" + word.lower()) * BUCKETS + b("s" + shape(word))
        return n


def votes(m: dict[str, float]) -> str:
    return "".join("0+-"[f(m)] for f in LABELLERS.values()) if m["n"] else "0" * len(LABELLERS)


def fit_accuracies(patterns: dict[str, int], steps: int = EM_STEPS) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good documents; p(vote | bad or good), by labeller, class and vote (0, +, -); p(good | pattern)."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    given = np.array([["0+-".index(c) for c in p] for p in names])
    good = np.array([(p.count("+") + 1.0) / (p.count("+") + 3 * p.count("-") + 2.0) for p in names])  # where the steps begin
    share, table_ = 0.5, np.zeros((given.shape[1], 2, 3))
    for _ in range(steps):
        for j in range(given.shape[1]):
            for k, p in enumerate((1 - good, good)):
                table_[j, k] = np.bincount(given[:, j], weights=n * p, minlength=3) + 0.1
        table_ /= table_.sum(axis=2, keepdims=True)
        share = float((n @ good + 1) / (n.sum() + 2))
        logs = np.stack([np.log(table_[np.arange(given.shape[1]), k, given]).sum(axis=1) for k in (0, 1)])
        before, good = good, 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - share) / share), -50, 50)))
        if np.abs(before - good).max() < 1e-9:
            break
    return share, table_, dict(zip(names, good.tolist(), strict=True))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression on word buckets, shape buckets and measures; full-batch steps of Adam, soft labels. The constant is the classes' share, so a text that tells nothing gets that."""
    size = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    codes = np.concatenate([r[0] for r in rows]) if len(owner) else np.zeros(0, np.int64)
    words, shapes = codes // BUCKETS, codes % BUCKETS
    share = 1 / (size + PRIOR_WORDS)[owner]
    dense = np.stack([r[1] for r in rows])
    theta = np.zeros(2 * BUCKETS + dense.shape[1] + 1)
    mean = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    theta[-1] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        a, b, c, d = theta[:BUCKETS], theta[BUCKETS : 2 * BUCKETS], theta[2 * BUCKETS : -1], theta[-1]
        z = np.bincount(owner, weights=(a[words] + b[shapes]) * share, minlength=len(rows)) + dense @ c + d
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        x = e[owner] * share
        gradient = np.concatenate([np.bincount(words, weights=x, minlength=BUCKETS), np.bincount(shapes, weights=x, minlength=BUCKETS), e @ dense, [0.0]])
        gradient[:-1] += 1e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:BUCKETS].astype(np.float32), theta[BUCKETS : 2 * BUCKETS].astype(np.float32), theta[2 * BUCKETS : -1], float(theta[-1])


def _look(text: str, buckets: Buckets) -> tuple[np.ndarray, dict[str, float]]:
    words = text.split()
    return np.array(list(map(buckets.__getitem__, words)), np.int64), measures(text, words)


def vote_patterns(docs: DataFrame, text_column: str = "text") -> dict[str, int]:
    """Documents by the pattern of their votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                seen[votes(measures(text, text.split()))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    rows = docs.select(text_column).mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return {r.votes: r.n for r in rows}


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE):
    """The scorer, and the labellers' accuracies. None for the scorer of an empty table."""
    patterns = vote_patterns(docs, text_column)
    total = sum(patterns.values())
    if not total:
        return None, {}
    share, table_, posterior = fit_accuracies(patterns)
    accuracy = {name: float(share * table_[j, 1, 1] + (1 - share) * table_[j, 0, 2]) for j, name in enumerate(LABELLERS)}
    pick = chosen(sample / total, id_column, text_column, salt=11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            codes, dense, said = [], [], []
            for text in batch.column(0):
                found, m = _look(text.as_py() or "", buckets)
                codes.append(found.astype("<i4").tobytes())
                dense.append([m[k] for k in DENSE])
                said.append(votes(m))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(dense, pa.list_(pa.float64())), pa.array(said, pa.string())], ["codes", "dense", "votes"])

    rows = docs.where(pick).select(text_column).mapInArrow(run, "codes binary, dense array<double>, votes string").collect()  # about sample rows
    rows = [r for r in rows if len(r.codes)]
    rows.sort(key=lambda r: (r.votes, bytes(r.codes)))  # the same sums in any order of tasks
    if not rows:
        return None, accuracy
    target = np.array([posterior.get(r.votes, share) for r in rows])
    return fit_scorer([(np.frombuffer(r.codes, "<i4").astype(np.int64), np.array(r.dense)) for r in rows], target), accuracy


def score(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, votes, score (of being good), kept."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_words long, votes string, score double, kept boolean").fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes, dense, constant = sent.value or (np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), np.zeros(len(DENSE)), 0.0)
        buckets = Buckets()
        for batch in batches:
            n, said, scores = [], [], []
            for text in batch.column(1):
                codes, m = _look(text.as_py() or "", buckets)
                z = constant + float((words[codes // BUCKETS] + shapes[codes % BUCKETS]).sum()) / (len(codes) + PRIOR_WORDS)
                z += sum(float(w) * m[k] for w, k in zip(dense, DENSE, strict=True))
                n.append(len(codes))
                said.append(votes(m))
                scores.append(1 / (1 + float(np.exp(-np.clip(z, -30, 30)))))
            kept = [x >= THRESHOLD and k > 0 for x, k in zip(scores, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = train(docs)
    return score(docs, model)
