"""Toxicity by a linear-chain conditional random field over words.

Words are labelled first: in documents marked toxic, a word is toxic when it, or its beginning, occurs
far more often in toxic than in clean documents. A chain of two states is then fitted to these labels.
Its features are hashes of the word, of its beginnings and its end, so a word never seen before is
judged by its stem. Over a whole document the forward and backward passes give each word's probability
of the toxic state. What they add up to gives the document's score, by a logistic curve fitted to the
document labels; words over one half give the offending offsets.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import steps, text_or_empty
from roamframe.llm.decontaminate import _letters, letters_of
from roamframe.llm.words import _powers_up_to, mixed

#: Labelled rows, clean and toxic, that the model is fitted to, at most; longer texts are not used for fitting.
FIT_ROWS, FIT_CHARS = (4000, 2000), 6000
#: Hashed features; beginnings and ends of words that are features beside the word; words of a fitted stretch.
BUCKET_BITS, HEADS, TAIL, STRETCH = 21, (4, 5, 6, 7, 8), 3, 40
BUCKETS = 1 << BUCKET_BITS
#: Documents that a feature is in, and how much likelier in toxic ones, to label a word.
SEEN, LIKELIER = 6, 25.0
THRESHOLD = 0.3
#: Stretches that the chain is fitted to, at most; a word's probability from which it counts for its document.
FIT_STRETCHES, UNLIKELY = 8000, 0.2
_BLOCK = 32
_FEATURES = 2 + len(HEADS)


def words_of(texts: list[str]):
    """(features, row, start, end) of every word: hashed features, its text, its code point offsets."""
    letters, place, borders = letters_of(texts)
    n = len(letters)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros((_FEATURES, 0), dtype=np.int32), empty, empty, empty
    inside = letters != 32
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[borders] = True
    first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | fresh[1:n]]))
    last = np.flatnonzero(inside & np.concatenate([~inside[1:] | fresh[1:n], [True]])) + 1
    _, table = _letters()
    up, down = _powers_up_to(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[np.minimum(letters, len(table) - 1)] * up[:n], out=sums[1:])

    def hashed(a, b, kind):
        value = (sums[b] - sums[a]) * down[a] + kind.astype(np.uint64) * np.uint64(0x1000193)
        return (mixed(value) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

    same = np.ones(len(first), dtype=np.int64)
    features = [hashed(first, last, same)]
    # A beginning that goes on is another feature than the word that ends there.
    features += [hashed(first, np.minimum(first + k, last), 2 * k + (last - first > k)) for k in HEADS]
    features.append(hashed(np.maximum(last - TAIL, first), last, same * 99))
    row = np.searchsorted(borders, first, side="right") - 1
    return np.stack(features), row, place[first], place[last - 1] + 1


@dataclass
class Chain:
    """weights: per feature, what speaks for the toxic state; move: 2 x 2 factors between states; curve: of the score."""

    weights: np.ndarray
    bias: float
    move: np.ndarray
    curve: np.ndarray

    def emission(self, features: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[features].sum(axis=0) + self.bias, -30, 30))

    def marginals(self, features: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Probability of the toxic state of each word, by forward and backward passes over whole texts."""
        return chain_marginals(self.emission(features), np.bincount(row, minlength=rows), self.move)


def _scan(odds: np.ndarray, sizes: np.ndarray, step, blocks_in_order: bool) -> np.ndarray:
    """Run ``step`` along each text; texts are cut into blocks that run side by side.

    The state is a ratio that one word maps by (a x + b) / (c x + d), so a block as a whole does too. The
    blocks' maps are made side by side, then chained text by text, then the blocks run from their starts.
    """
    count = -(-sizes // _BLOCK)
    edge = np.concatenate([[0], np.cumsum(count)])
    total = int(edge[-1])
    first_word = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(total) - edge[text]
    begin = first_word[text] + nth * _BLOCK
    length = np.minimum(_BLOCK, sizes[text] - nth * _BLOCK)
    offset = np.arange(_BLOCK) if blocks_in_order else np.arange(_BLOCK)[::-1]
    real = offset[:, None] < length[None, :]
    index = np.where(real, begin[None, :] + offset[:, None], 0)
    maps = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    for t in range(_BLOCK):
        a, b, c, d = step(odds[index[t]])
        live = real[t]
        a, b, c, d = (np.where(live, x, y) for x, y in zip((a, b, c, d), (1.0, 0.0, 0.0, 1.0)))
        p, q, r, s = maps
        maps = [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s]
        top = np.maximum(np.maximum(*maps[:2]), np.maximum(*maps[2:]))
        maps = [x / top for x in maps]
    # Start of every block, from the one before it in its text.
    start = np.ones(total)
    deep = np.argsort(-count, kind="stable")
    for k in range(1, int(count.max(initial=0))):
        own = deep[: int(np.searchsorted(-count[deep], -k, side="left"))]
        now = edge[own] + k if blocks_in_order else edge[own + 1] - 1 - k
        before = now - 1 if blocks_in_order else now + 1
        p, q, r, s = (m[before] for m in maps)
        start[now] = (p * start[before] + q) / (r * start[before] + s)
    out = np.empty(len(odds))
    x = start
    for t in range(_BLOCK):
        a, b, c, d = step(odds[index[t]])
        live = real[t]
        if not blocks_in_order:
            out[index[t][live]] = x[live]
        x = np.where(live, (a * x + b) / (c * x + d), x)
        if blocks_in_order:
            out[index[t][live]] = x[live]
    return out


def chain_marginals(odds: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probabilities of state 1 in chains of ``sizes`` words with these odds and moves."""
    if not len(odds):
        return np.zeros(0)
    # The step into a word weighs its odds; before the first word both states weigh as if just moved to.
    zero = np.zeros_like
    forward = _scan(odds, sizes, lambda e: (move[1, 1] * e, move[0, 1] * e, zero(e) + move[1, 0], zero(e) + move[0, 0]), True)
    backward = _scan(odds, sizes, lambda e: (move[1, 1] * e, zero(e) + move[1, 0], move[0, 1] * e, zero(e) + move[0, 0]), False)
    both = forward * backward
    return both / (1.0 + both)


def _fit_chain(features: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.3):
    """Weights and moves of stretches of STRETCH words (features x stretches x words) by Adam on the likelihood."""
    weights, bias, move = np.zeros(BUCKETS), -2.0, np.zeros((2, 2))
    n, length = labels.shape
    used, slot = np.unique(features, return_inverse=True)
    slot = slot.reshape(features.shape).astype(np.int32)
    w = np.zeros(len(used))
    moments = [np.zeros(len(w) + 5), np.zeros(len(w) + 5)]
    sizes = np.full(n, length)
    pairs = np.stack([((labels[:, :-1] == i) & (labels[:, 1:] == j)).sum() for i in (0, 1) for j in (0, 1)]).astype(float)
    for t in range(1, rounds + 1):
        odds = np.exp(np.clip(sum(w[own] for own in slot) + bias, -30, 30))
        m = np.exp(move)
        flat = odds.reshape(-1)
        p = chain_marginals(flat, sizes, m).reshape(n, length)
        expected = _pair_counts(odds, m, n, length)
        miss = labels - p
        by_slot = sum(np.bincount(own.reshape(-1), weights=miss.reshape(-1), minlength=len(w)) for own in slot)
        gradient = np.concatenate([by_slot / n, [miss.sum() / n], (pairs - expected) / n])
        gradient -= 1e-3 * np.concatenate([w, [0], move.reshape(-1)])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        change = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w += change[: len(w)]
        bias += change[len(w)]
        move += change[len(w) + 1 :].reshape(2, 2)
    weights[used] = w
    return weights, float(bias), np.exp(move)


def _pair_counts(odds: np.ndarray, move: np.ndarray, n: int, length: int) -> np.ndarray:
    """Expected moves between neighbouring words, from state i to j."""
    sizes = np.full(n, length)
    zero = np.zeros_like
    flat = odds.reshape(-1)
    forward = _scan(flat, sizes, lambda e: (move[1, 1] * e, move[0, 1] * e, zero(e) + move[1, 0], zero(e) + move[0, 0]), True).reshape(n, length)
    backward = _scan(flat, sizes, lambda e: (move[1, 1] * e, zero(e) + move[1, 0], move[0, 1] * e, zero(e) + move[0, 0]), False).reshape(n, length)
    left, right = forward[:, :-1], odds[:, 1:] * backward[:, 1:]
    each = [move[0, 0] + 0 * left, move[0, 1] * right, left * move[1, 0], left * move[1, 1] * right]
    total = sum(each)
    return np.array([(x / total).sum() for x in each])


def _summaries(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """What a document's score is made of: a constant, expected toxic words (log), the likeliest, the share.

    Unlikely words are left out of the sum, as thousands of them would add up in a long clean text.
    """
    total = np.bincount(row, weights=np.where(p >= UNLIKELY, p, 0.0), minlength=rows)
    words = np.bincount(row, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, row, p)
    return np.stack([np.ones(rows), np.log1p(total), most, np.minimum(1.0, 20 * total / np.maximum(words, 1))])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    curve = np.zeros(len(x))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(curve @ x, -30, 30)))
        slope = (x * (p * (1 - p) + 1e-6)) @ x.T + 1e-2 * np.eye(len(x))
        curve += np.linalg.solve(slope, x @ (y - p) - 1e-2 * curve)
    return curve


def learning_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: rows whose crc32 of the id leaves no 2 by four, and whose label is known."""
    return labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _trained(texts: list[str], toxic: list[int]) -> Chain:
    """The chain that these texts and labels give."""
    nothing = Chain(np.zeros(BUCKETS, dtype=np.float32), -5.0, np.ones((2, 2)), np.array([np.log(0.05 / 0.95), 0.0, 0.0, 0.0]))
    y = np.array(toxic, dtype=float)
    if len(set(y)) < 2:
        return nothing
    parts, owners = [], []
    for a, b in steps([len(t) for t in texts], 1_000_000):
        f, r, _, _ = words_of(texts[a:b])
        parts.append(f)
        owners.append((r + a).astype(np.int32))
    features, row = np.concatenate(parts, axis=1), np.concatenate(owners)
    del parts, owners
    n_toxic, n_clean = y.sum(), len(y) - y.sum()
    label = np.zeros(features.shape[1], dtype=bool)
    # Ends of words are features but label nothing.
    for k in range(_FEATURES - 1):
        once = np.unique(row * np.int64(BUCKETS) + features[k])
        bucket, bad = once % BUCKETS, y[once // BUCKETS] == 1
        seen, spared = np.bincount(bucket[bad], minlength=BUCKETS), np.bincount(bucket[~bad], minlength=BUCKETS)
        likelier = ((seen + 0.5) / (n_toxic + 1)) / ((spared + 0.5) / (n_clean + 1))
        label |= ((seen >= SEEN) & (likelier >= LIKELIER))[features[k]]
    label &= y[row] == 1
    if not label.any():
        return nothing
    # Stretches with a labelled word, and twice as many without one.
    whole = len(label) // STRETCH * STRETCH
    with_one = label[:whole].reshape(-1, STRETCH).any(axis=1)
    one, none = np.flatnonzero(with_one), np.flatnonzero(~with_one)
    none = none[np.argsort(mixed(none.astype(np.uint64)))][: 2 * len(one)]
    take = np.sort(np.concatenate([one, none]))
    if not len(take):
        return nothing
    take = take[np.argsort(mixed(take.astype(np.uint64)))][:FIT_STRETCHES]
    f = features[:, :whole].reshape(_FEATURES, -1, STRETCH)[:, take]
    weights, bias, move = _fit_chain(f, label[:whole].reshape(-1, STRETCH)[take].astype(float))
    chain = Chain(weights.astype(np.float32), bias, move, np.zeros(4))
    words = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
    sums = []
    for a, b in steps(np.diff(words), 200_000):
        own = slice(words[a], words[b])
        sums.append(_summaries(chain.marginals(features[:, own], row[own] - a, b - a), row[own] - a, b - a))
    chain.curve = _logistic(np.concatenate(sums, axis=1), y)
    return chain


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit to at most FIT_ROWS rows of the classes, chosen by a hash of their ids.

    One task reads these rows, fits, and gives back the model: no text comes to the driver. Without rows
    of both classes the score is 0.05 for every document.
    """
    chosen = None
    for toxic, most in enumerate(FIT_ROWS):
        own = learning_rows(labels).filter(F.col("toxic") == toxic).select(F.col("doc_id").cast("long").alias("_id"), "toxic").distinct()
        own = own.orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("text")).filter(F.length("text") <= FIT_CHARS)
    # At most as many ids as FIT_ROWS adds up to, whatever the input.
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "toxic", "text").limit(sum(FIT_ROWS))

    def train(batches):
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_trained(texts, toxic))], pa.binary())], ["model"])

    models = rows.select("text", "toxic").coalesce(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(models[0].model) if models else _trained([], [])


def judged(texts: list[str], chain: Chain):
    """(scores, row, start, end) of the texts and of their offending words, neighbours as one span."""
    features, row, start, end = words_of(texts)
    p = chain.marginals(features, row, len(texts))
    score = 1 / (1 + np.exp(-np.clip(chain.curve @ _summaries(p, row, len(texts)), -30, 30)))
    bad = np.flatnonzero(p >= 0.5)
    head = np.ones(len(bad), dtype=bool)
    head[1:] = (bad[1:] != bad[:-1] + 1) | (row[bad[1:]] != row[bad[:-1]])
    tail = np.ones(len(bad), dtype=bool)
    tail[:-1] = head[1:]
    return score, row[bad[head]], start[bad[head]], end[bad[tail]]


def _judged(texts: list[str], chain: Chain):
    for a, b in steps([len(t) for t in texts], 1_000_000):
        yield a, b, *judged(texts[a:b], chain)


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, score, predicted, n_spans, spans.

    spans are ``start:end`` of the offending words (code points, end exclusive), joined by commas. A null
    text counts as empty and has a score too. Nothing but the text decides a score, so equal texts have
    equal scores. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))

    def score(batches):
        for batch in batches:
            for a, b, scores, row, start, end in _judged(batch.column(1).to_pylist(), shared.value):
                spans = [[] for _ in range(b - a)]
                for r, i, j in zip(row.tolist(), start.tolist(), end.tolist()):
                    spans[r].append(f"{i}:{j}")
                own = [batch.column(0).slice(a, b - a), pa.array(scores), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans])]
                yield pa.RecordBatch.from_arrays(own, ["_id", "score", "n_spans", "spans"])

    out = rows.mapInArrow(score, "_id bigint, score double, n_spans bigint, spans string")
    return out.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_spans",
        "spans",
    )


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for a, b, scores, *_ in _judged([t or "" for t in batch.column(at).to_pylist()], shared.value):
                keep[a:b] = scores < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
