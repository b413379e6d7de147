"""Operator 10: toxicity by a bidirectional gated recurrent network.

A word enters as its own vector, as the mean vector of its character 4-grams and
with the log odds of label 1 of its beginnings (``HEADS``: the whole word and its first
4, 6 and 8 characters), counted by texts of the sample.  Two gated recurrent layers read a window of ``WINDOW`` words, one
from each end; attention pools their states; a logistic unit gives the
window's logit.  Windows start every ``STRIDE`` words, so they overlap, cover
the whole text, and its score is that of the most toxic one.

Training is plain NumPy: back-propagation through time, Adam at a falling rate, a
moving average of the weights, a held-back fifth of the sample to choose the
epoch whose average is kept.  The sample has ``PARTS`` parts; in training the words of a text have log
odds counted without its own part, so that the network trusts them as far as they hold for
other texts.  Labels belong to texts, so each epoch learns
from the window of each text that scores highest; the first, when nothing is known,
from the one with the largest sum of positive log odds.  The sample is bounded by
``SAMPLE`` texts of either label, of at most ``LONGEST`` characters, chosen by
hash of doc_id; the bias is set back to the labels' share over all learning rows.

Null and empty texts have one empty window.  Null labels and null ids teach
nothing.  With labels of one kind only, or none, every score is that share (0
without labels).  Repeated rows are each scored.  A very long text has as many
windows as it needs.  Of windows that score equally the first teaches.  Empty
tables give empty ones.  Further columns pass through under whatever name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import gather, mapped, named, of_rows, private, slices, texts
from .langid import grams, remainder

WINDOW, STRIDE = 64, 32
SAMPLE, LONGEST = 1500, 12_000
EPOCHS, BATCH, RATE = 9, 64, 0.01
#: How much of the average stays in a step; the share of the rate that is left at the end.
AVERAGE, LAST_RATE = 0.98, 0.2
#: How large the log odds enter; of how many first characters of a word (None: of all), in tables of how many slots;
#: how many parts the sample has.
ODDS = 0.3
HEADS = (None, 4, 6, 8)
SLOTS, PARTS = 1 << 18, 5
BITS, SIZE, HIDDEN, ATTENTION = 13, 8, 8, 8
#: Vectors of words, and of 4-grams.
BUCKETS = 1 << BITS
#: Words that a worker keeps with their projections.
KEPT = 200_000
_EDGE = " \t\n.,;:!?\"'()[]{}<>*_-+=/\\|&%$#@~`…«»“”‘’"

Params = dict[str, np.ndarray]


def fresh(seed: int = 7) -> Params:
    r = np.random.default_rng(seed)
    normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
    h, p = HIDDEN, {"word": normal(0.1, BUCKETS, SIZE), "char": normal(0.1, BUCKETS, SIZE)}
    for d in "fb":
        p |= {f"in_{d}": normal(0.3, 2 * SIZE + len(HEADS), 3 * h), f"own_{d}": normal(0.3, h, 3 * h), f"bias_{d}": np.zeros(3 * h, np.float32)}
    return p | {"look": normal(0.4, 2 * h, ATTENTION), "look_bias": np.zeros(ATTENTION, np.float32), "ask": normal(0.4, ATTENTION), "out": normal(0.4, 2 * h), "out_bias": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Numbers words, and keeps the places of their vectors."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.place, self.grams, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.heads = np.zeros((0, len(HEADS)), np.int64)

    def learn(self, new: list[str]) -> None:
        cut = [w.strip(_EDGE) for w in new]
        packed, sizes = grams(cut)
        slot = ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        ends = np.cumsum(sizes)
        mixed = packed * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        # A word's own place: its 4-grams' hashes, each turned by its position.
        turn = (np.arange(len(packed)) - np.repeat(ends - sizes, sizes)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        own = np.add.reduceat(mixed * turn, ends - sizes)
        own = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        heads = np.array([[xxhash.xxh64_intdigest(w[:n].encode("utf-8", "surrogatepass")) % SLOTS for n in HEADS] for w in cut], np.int64)
        self.heads = np.concatenate([self.heads, heads])
        self.place, self.grams, self.sizes = np.concatenate([self.place, own]), np.concatenate([self.grams, slot]), np.concatenate([self.sizes, sizes])

    def numbers(self, block: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The words of all texts, how many each has, and which are new."""
        number, new, at, counts = self.number, [], [], []
        for text in block:
            found = text.lower().split()
            counts.append(len(found))
            for w in found:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(number)
                    new.append(w)
                at.append(n)
        if new:
            self.learn(new)
        return np.array(at, np.int64), np.array(counts, np.int64), new

    def slots(self, of: np.ndarray) -> np.ndarray:
        """The places of the 4-grams of the words with these numbers, one word after the other."""
        sizes = self.sizes[of]
        return gather(self.grams, (np.cumsum(self.sizes) - self.sizes)[of], sizes)

    def vectors(self, p: Params, of: np.ndarray | None = None, part: np.ndarray | int = -1) -> np.ndarray:
        """The inputs of the words with these numbers (all), with the log odds of these tables (the last, which counts all parts)."""
        of = np.arange(len(self.place)) if of is None else of
        if not len(of):
            return np.zeros((0, 2 * SIZE + len(HEADS)), np.float32)
        sizes = self.sizes[of]
        mean = np.add.reduceat(p["char"][self.slots(of)], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        known = p["odds"][np.reshape(part, (-1, 1)), np.arange(len(HEADS)), self.heads[of]] if "odds" in p else np.zeros((len(of), len(HEADS)))
        return np.concatenate([p["word"][self.place[of]], mean, known], axis=1).astype(np.float32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words each: the text, first word and length of all windows."""
    many = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), many)
    within = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, np.repeat(np.cumsum(counts) - counts, many) + within, np.minimum(counts[text] - within, WINDOW)


def _layer(p: Params, d: str, x: np.ndarray, at: np.ndarray, inside: np.ndarray, keep: list | None) -> np.ndarray:
    """States after each step: (steps, windows, HIDDEN).  x: projected words; at, inside: (steps, windows)."""
    steps, n = at.shape
    own, h = p[f"own_{d}"], np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    full = inside.all(axis=1)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, b = x.take(at[t], axis=0), h @ own
        zr = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = b[:, 2 * HIDDEN :]
        m = np.tanh(a[:, 2 * HIDDEN :] + r * c)
        new = m + z * (h - m)
        if not full[t]:
            new = np.where(inside[t][:, None], new, h)
        if keep is not None:
            keep.append((t, h, z, r, c, m))
        out[t] = h = new
    return out


def logits(p: Params, x: dict[str, np.ndarray], at: np.ndarray, inside: np.ndarray, keep: dict | None = None) -> np.ndarray:
    hs = {d: _layer(p, d, x[d], at, inside, keep.setdefault(d, []) if keep is not None else None) for d in "fb"}
    both = np.concatenate([hs["f"], hs["b"]], axis=2)
    seen = np.tanh(both @ p["look"] + p["look_bias"])
    score = np.where(inside, seen @ p["ask"], -1e9)
    weight = np.exp(score - score.max(axis=0)) * inside
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = (weight[:, :, None] * both).sum(axis=0)
    if keep is not None:
        keep |= {"both": both, "seen": seen, "weight": weight, "pooled": pooled}
    return pooled @ p["out"] + p["out_bias"][0]


def projected(p: Params, vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {d: np.ascontiguousarray(vectors @ p[f"in_{d}"] + p[f"bias_{d}"]) for d in "fb"}


def gathered(at: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and whether they are inside: (steps, windows)."""
    steps = np.arange(max(1, int(size.max(initial=1))))[:, None]
    inside = steps < size
    flat = at if len(at) else np.zeros(1, np.int64)
    return flat[np.minimum(np.where(inside, start + steps, 0), len(flat) - 1)], inside


def gradients(p: Params, words: Words, at: np.ndarray, inside: np.ndarray, label: np.ndarray, part: np.ndarray | int = PARTS) -> tuple[float, Params]:
    """Mean log loss of windows, and its gradient; part: the table of log odds of each window."""
    used, local = np.unique(at * (PARTS + 1) + part, return_inverse=True)
    local = local.reshape(at.shape)
    used, part = np.divmod(used, PARTS + 1)
    sizes, slots = words.sizes[used], words.slots(used)
    spread = np.repeat(np.arange(len(used)), sizes)
    vectors = words.vectors(p, used, part)
    x, keep = projected(p, vectors), {}
    y = sigmoid(logits(p, x, local, inside, keep))
    n = len(label)
    loss = -float(np.mean(label * np.log(y + 1e-7) + (1 - label) * np.log(1 - y + 1e-7)))
    g: Params = {}
    d_logit = ((y - label) / n).astype(np.float32)
    g["out"], g["out_bias"] = keep["pooled"].T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["out"]
    both, seen, weight = keep["both"], keep["seen"], keep["weight"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = (both * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["ask"] = np.einsum("tn,tna->a", d_score, seen)
    d_seen = d_score[:, :, None] * p["ask"] * (1 - seen * seen)
    g["look"], g["look_bias"] = np.einsum("tnh,tna->ha", both, d_seen), d_seen.sum(axis=(0, 1))
    d_both += d_seen @ p["look"].T
    d_vectors = np.zeros_like(vectors)
    for k, d in enumerate("fb"):
        own, d_own, d_x = p[f"own_{d}"], np.zeros_like(p[f"own_{d}"]), np.zeros_like(x[d])
        d_h = np.zeros((n, HIDDEN), np.float32)
        d_out = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        for t, h, z, r, c, m in reversed(keep[d]):
            d_h = d_h + d_out[t]
            live = inside[t][:, None]
            d_new = np.where(live, d_h, 0)
            d_m = d_new * (1 - z) * (1 - m * m)
            d_z = d_new * (h - m) * z * (1 - z)
            d_r = d_m * c * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_m], axis=1)
            d_b = np.concatenate([d_z, d_r, d_m * r], axis=1)
            np.add.at(d_x, local[t], d_a)
            d_own += h.T @ d_b
            d_h = np.where(live, d_new * z, d_h) + d_b @ own.T
        g[f"own_{d}"], g[f"in_{d}"], g[f"bias_{d}"] = d_own, vectors.T @ d_x, d_x.sum(axis=0)
        d_vectors += d_x @ p[f"in_{d}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], words.place[used], d_vectors[:, :SIZE])
    np.add.at(g["char"], slots, (d_vectors[:, SIZE : 2 * SIZE] / sizes[:, None])[spread])
    return loss, g


def odds(words: Words, at: np.ndarray, counts: np.ndarray, label: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Log odds of label 1 of each slot of beginnings, by texts that have it: (PARTS + 1, HEADS, SLOTS).

    Table n leaves out the texts of part n, the last none.  A slot that no text has gets 0.  at, counts: the words of all
    texts, and how many each has.
    """
    n = max(1, len(words.place))
    text, word = np.divmod(np.unique(np.repeat(np.arange(len(counts)), counts) * n + at), n)
    kind = (label != 0).astype(np.int64) * PARTS + part
    texts_of = np.bincount(kind, minlength=2 * PARTS).reshape(2, PARTS)
    out = np.zeros((PARTS + 1, len(HEADS), SLOTS), np.float32)
    for k in range(len(HEADS)):
        of, slot = np.divmod(np.unique(text * SLOTS + words.heads[word, k]), SLOTS)
        found = np.bincount(kind[of] * SLOTS + slot, minlength=2 * PARTS * SLOTS).reshape(2, PARTS, SLOTS)
        for without in range(PARTS + 1):
            own, total = (c.sum(axis=1) - (c[:, without] if without < PARTS else 0) for c in (found, texts_of))
            ratio = np.log((own[1] + 1) / (total[1] + 2)) - np.log((own[0] + 1) / (total[0] + 2))
            out[without, k] = np.where(own.any(axis=0), ODDS * np.clip(ratio, -2, 4), 0)
    return out


def _scores(p: Params, words: Words, at: np.ndarray, part: np.ndarray, span: tuple[np.ndarray, np.ndarray], block: int = 2048) -> np.ndarray:
    used, at = np.unique(at * (PARTS + 1) + part, return_inverse=True)
    x, (start, size) = projected(p, words.vectors(p, *np.divmod(used, PARTS + 1))), span
    if not len(used):
        x = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
    out = np.empty(len(start), np.float32)
    order = np.argsort(size, kind="stable")
    for i in range(0, len(start), block):
        own = order[i : i + block]
        out[own] = logits(p, x, *gathered(at, start[own], size[own]))
    return out


def train(texts_in: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Params:
    """Fit the network to labelled texts."""
    rng, words = np.random.default_rng(seed), Words()
    at, counts, _ = words.numbers(texts_in)
    text, start, size = windows(counts)
    label = np.array(labels, np.float32)
    firsts = np.searchsorted(text, np.arange(len(counts)))
    check = np.arange(len(label)) % PARTS == 0
    p, best, least = fresh(seed), None, np.inf
    part = np.arange(len(label)) % PARTS
    parts = np.repeat(part, counts)
    p["odds"] = odds(words, at, counts, label, part)
    hot = np.maximum(p["odds"][parts[:, None], np.arange(len(HEADS)), words.heads[at]], 0)
    heat = np.concatenate([[0.0], np.cumsum(hot.sum(axis=1))])
    heat = heat[start + size] - heat[start]
    mean = p | {k: p[k].copy() for k in p if k != "odds"}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k != "odds"}
    step = 0
    for epoch in range(epochs + 1):
        score = _scores(mean, words, at, parts, (start, size))
        top = np.maximum.reduceat(score, firsts)
        y = sigmoid(top[check])
        loss = -float(np.mean(label[check] * np.log(y + 1e-7) + (1 - label[check]) * np.log(1 - y + 1e-7))) if check.any() else 0.0
        if epoch and loss <= least:
            best, least = mean | {k: mean[k].copy() for k in moment}, loss
        if epoch == epochs:
            break
        now = score if epoch else heat
        hot = np.flatnonzero(now == np.maximum.reduceat(now, firsts)[text])
        chosen = hot[np.searchsorted(text[hot], np.arange(len(counts)))]
        chosen = rng.permutation(chosen[~check[text[chosen]]])
        rate = RATE * (1 - (1 - LAST_RATE) * epoch / epochs)
        for i in range(0, len(chosen), BATCH):
            own = chosen[i : i + BATCH]
            _, g = gradients(p, words, *gathered(at, start[own], size[own]), label[text[own]], part[text[own]])
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m *= 0.9
                m += 0.1 * v
                s *= 0.99
                s += 0.01 * v * v
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) + (1e-4 * p[k] if k in ("word", "char") else 0)
            stay = min(AVERAGE, (1 + step) / (10 + step))  # young averages follow quickly
            for k in moment:
                mean[k] += (1 - stay) * (p[k] - mean[k])
    best = best or mean
    return best | {"odds": best["odds"][-1:]}


class Scorer:
    """Scores texts; keeps the projections of the words it has met."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.x = {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def logits(self, block: list[str], most: int = 2048) -> np.ndarray:
        if len(self.words.number) > KEPT:
            self.clear()
        known = len(self.words.number)
        at, counts, new = self.words.numbers(block)
        if new:
            more = projected(self.p, self.words.vectors(self.p, np.arange(known, len(self.words.place))))
            self.x = {d: np.concatenate([self.x[d], more[d]]) for d in "fb"}
        x = self.x if len(self.words.place) else {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
        text, start, size = windows(counts)
        out = np.empty(len(text), np.float32)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(text), most):
            own = order[i : i + most]
            out[own] = logits(self.p, x, *gathered(at, start[own], size[own]))
        return np.maximum.reduceat(out, np.searchsorted(text, np.arange(len(counts))))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[Params | None, float]:
    """The network, and what is to be added to its logits; without a network, the constant logit.

    labels: doc_id and toxic; learn: a condition on doc_id.
    """
    known = of_rows(labels, "doc_id", "toxic").where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    share = dict(known.groupBy((F.col("toxic") != 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect())
    total = sum(share.values())
    if len(share) < 2:
        return None, (30.0 if share.get(1) else -30.0)
    picked = [known.where(c).select("doc_id", F.lit(v).alias("label"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(2 * sample) for v, c in ((0, "toxic = 0"), (1, "toxic <> 0"))]
    # At most 4 * sample ids and labels: safe to broadcast.
    rows = of_rows(docs, "doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    rows = [r for v in (0, 1) for r in rows.where(F.col("label") == v).orderBy("h", "doc_id", "text").limit(sample).collect()]
    rows.sort(key=lambda r: (r.h, r.doc_id, r.text))
    kinds = [sum(r.label == v for r in rows) for v in (0, 1)]
    if not all(kinds):
        return None, float(np.log(share[1] / share[0]))
    p = train([r.text for r in rows], [r.label for r in rows])
    return p, float(np.log(share[1] / share[0]) - np.log(kinds[1] / kinds[0]))


def scored(docs: DataFrame, p: Params | None, shift: float, name: str = "score") -> DataFrame:
    """All columns of docs but ``name`` if it has one, and ``name``, 0 to 1."""
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != name.lower()])
    names, place = docs.columns, docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for batch in slices(batches):
            block = texts(batch.column(place))
            logit = scorer.logits(block).astype(np.float64) if scorer else np.zeros(len(block))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(logit + shift))], [*names, name])

    return mapped(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Remainder 0 modulo 5; a null id is not held out, and teaches nothing."""
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def folded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from labels that aren't held out."""
    p, shift = learned(docs, labels, ~held_out(F.col("doc_id")))
    rows = scored(of_rows(docs, "doc_id", "text"), p, shift)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5."""
    p, shift = learned(docs, labels, ~held_out(F.col("doc_id")))
    (name,) = private(docs, "score")
    return scored(docs, p, shift, name).where(named(name) < 0.5).select(*map(named, docs.columns))
