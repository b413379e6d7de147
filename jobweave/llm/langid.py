"""Operator 9: language identification by Kneser-Ney character models.

Each language has an interpolated Kneser-Ney model of order 4 over the
characters of words (small letters, between a start and an end mark), counted
over all rows it may learn from.  The top order holds counts, lower orders the
numbers of different characters that precede.  Probabilities stand in sorted
arrays of packed n-grams, found by binary search.  A text goes to the language
of the lowest cross-entropy a character.

No process need hold a whole model.  What the probability of an n-gram depends on shares its last character
but one, but for discounts and single characters: so n-grams, learnt and asked for, are grouped by that
character, and each group builds its piece of every language's arrays (its size depends on the alphabet, not on the
number of texts).  Bits of the commonest n-grams, at most ``HEAD`` numbers, go to all workers in sorted arrays;
others meet the texts that have them in an equality join.  The driver holds discounts, single characters (at most
65,536 a language) and the n-grams of ``HEAD``.

Calibration: one learning row in ``FOLDS``, by hash of its id and text, is held
back from a second set of counts, gathered in the same pass.  Models of these
give the mean and deviation of the cross-entropy of the rows held back under
their own language; a text whose cross-entropy lies more than ``DEVIATIONS``
above the mean of its language is marked rejected (its language is still given).
A language without rows held back rejects nothing.  The score is the share of the language's likelihood among all
languages', with the evidence of a text held at ``EVIDENCE`` characters.

A null text, and one without a letter (as ``str.isalpha`` has it), is ``und`` with
score 0.  A very long text is scored whole, word by word.  An empty table gives an
empty one; further columns are not carried.  Rows with a
null language or text teach nothing; without any learning row all is ``und``.
Repeated rows are each judged; equal cross-entropies go to the first language by
name.  Characters enter n-grams as 16 bits, so some rare ones share a place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, of_rows, remove, slices, texts, written

ORDER = 4
DEVIATIONS, EVIDENCE, FOLDS = 4.0, 40, 8
#: Bits of common n-grams that go to all workers.
HEAD = 1 << 22
#: Words that a worker keeps with their bits.
KEPT = 400_000


def remainder(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-grams that end at each character or end mark of all words, and how many each word has."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points = (points ^ (points >> np.uint64(16)) * np.uint64(40503)) & np.uint64(0xFFFF)
    starts = np.cumsum(sizes + 1) - sizes - 1
    since = np.arange(len(points)) - np.repeat(starts, sizes + 1)
    packed = points.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(points)
        before[back:] = points[:-back]
        packed |= np.where(since >= back, before, np.uint64(0)) << np.uint64(16 * back)
    return packed[since > 0], sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts[order], new) if len(keys) else counts


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n, fit over all rows (columns lang, text and back; a null lang is counted too); each task sums its own first.

    n counts all rows, fit those that aren't held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str | None, bool], tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, back), (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts), pa.array(0 * counts if back else counts)], ["lang", "gram", "n", "fit"])

        for batch in slices(batches):
            words: dict[tuple[str | None, bool], Counter] = {}
            for lang, text, back in zip(column(batch, "lang").to_pylist(), texts(column(batch, "text")), column(batch, "back").to_pylist(), strict=True):
                words.setdefault((lang, back), Counter()).update(text.lower().split())
            for which, found in words.items():
                if not found:
                    continue
                keys, sizes = grams(list(found))
                counts = np.repeat(np.fromiter(found.values(), np.int64, len(found)), sizes)
                before = held.get(which, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                held[which] = _summed(np.concatenate([before[0], keys]), np.concatenate([before[1], counts]))
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from out()
                held = {}
        yield from out()

    return rows.select("lang", "text", "back").mapInArrow(run, "lang string, gram long, n long, fit long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("fit").alias("fit"))


#: N-grams, their probabilities, their contexts, and what these leave to the order below.
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def discount(ones: int, twos: int) -> float:
    """Of as many n-grams counted once and twice."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def level(n: int, keys: np.ndarray, counts: np.ndarray, off: float, lower: Level | None) -> Level:
    """Order n from its sorted n-grams and their counts; lower: order n - 1."""
    context = keys >> np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    total, types = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))
    weight = off * types / total
    below = 1 / 65536 if lower is None else lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << 16 * (n - 1)) - 1))]
    return keys, (counts - off) / np.repeat(total, types) + np.repeat(weight, types) * below, context[first], weight


class Piece:
    """One language's probabilities of the n-grams given: all of some last characters but one.

    discounts: by order, of the whole language; single: its order 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discounts: dict[int, float], single: Level) -> None:
        self.levels = [single]
        if not len(keys):
            return
        upper = [_summed(keys, counts)]
        for n in range(ORDER - 1, 1, -1):  # lower orders: different characters before
            top = upper[-1][0]
            upper.append(_summed(top & np.uint64((1 << 16 * n) - 1), np.ones(len(top), np.int64)))
        for n, (own, found) in enumerate(reversed(upper), 2):
            self.levels.append(level(n, own, found, discounts[n], self.levels[-1]))

    def bits(self, packed: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each 4-gram's last character."""
        p = np.full(len(packed), 1 / 65536)
        for n, (keys, probability, contexts, weight) in enumerate(self.levels, 1):
            own = packed & np.uint64((1 << 16 * n) - 1) if n < ORDER else packed
            context = own >> np.uint64(16)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            p = np.where(contexts[at] == context, p * weight[at], p)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            p = np.where(keys[at] == own, probability[at], p)
        return -np.log2(p)


#: A language's discounts by order, and its order 1; None if it has no n-grams.
Side = tuple[dict[int, float], Level] | None


def sides(counted: DataFrame) -> tuple[list[str], list[Side], list[Side]]:
    """The languages of gram_counts, by name, and what the driver holds of each: for all rows, and for those not held back."""
    orders = {ORDER: counted}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram")
        orders[n] = orders[n + 1].groupBy("lang", suffix).agg(F.count("*").alias("n"), F.count_if(F.col("fit") > 0).alias("fit"))
    few = [F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in ("n", "fit") for k in (1, 2)]
    found = {(r.lang, r.order): r for n in range(2, ORDER + 1) for r in orders[n].groupBy("lang").agg(*few).withColumn("order", F.lit(n)).collect()}
    ones = orders[1].toPandas()  # at most 65,536 a language
    names, out = sorted(set(ones["lang"])), ([], [])
    for lang in names:
        own = ones[ones["lang"] == lang].sort_values("gram")
        for side, c in zip(out, ("n", "fit"), strict=True):
            some = own[own[c] > 0]
            keys, counts = some["gram"].to_numpy(np.int64).view(np.uint64), some[c].to_numpy(np.int64)
            off = {n: discount(found[lang, n][f"{c}1"], found[lang, n][f"{c}2"]) for n in range(2, ORDER + 1)}
            side.append((off, level(1, keys, counts, discount(int((counts == 1).sum()), int((counts == 2).sum())), None)) if len(keys) else None)
    return names, *out


def gram_bits(counted: DataFrame, asked: DataFrame, names: list[str], every: list[Side], fit: list[Side]) -> DataFrame:
    """gram, n, bits for each row of asked (gram, n): under each language's model of all rows, then of rows not held back (NaN without such)."""
    held = counted.sparkSession.sparkContext.broadcast((every, fit))
    middle = F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF)).alias("middle")

    def run(learnt: pa.Table, wanted: pa.Table) -> pa.Table:
        packed = wanted["gram"].to_numpy().view(np.uint64)
        langs = np.array(learnt["lang"].to_pylist(), object)
        keys, bits = learnt["gram"].to_numpy().view(np.uint64), []
        for side, c in zip(held.value, ("n", "fit"), strict=True):
            counts = learnt[c].to_numpy()
            for lang, known in zip(names, side, strict=True):
                own = np.flatnonzero((langs == lang) & (counts > 0))
                bits.append(Piece(keys[own], counts[own], *known).bits(packed) if known else np.full(len(packed), np.nan))
        return pa.table({"gram": wanted["gram"], "n": wanted["n"], "bits": lists(np.stack(bits, axis=1))})

    return counted.select("*", middle).groupBy("middle").cogroup(asked.select("gram", "n", middle).groupBy("middle")).applyInArrow(run, "gram long, n long, bits array<double>")


def lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel()))


def unlisted(array: pa.Array, width: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(name: str, width: int, times: Column) -> Column:
    """The sum of arrays, each times a number."""
    return F.array(*(F.sum(F.col(name)[i] * times) for i in range(width)))


def common(bits: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The commonest n-grams in order and their bits, ``HEAD`` numbers at most, and whether these are all.

    bits: gram, n, bits.  N-grams go by the power of two of their count, each power whole or not at all.
    """
    power = F.floor(F.log2("n")).cast("int")
    share = dict(bits.groupBy(power.alias("power")).agg(F.count("*").alias("grams")).collect())
    room, least = HEAD // width, 64
    for p in sorted(share, reverse=True):
        room -= share[p]
        if room < 0:
            break
        least = p
    got = bits.where(power >= least).select("gram", "bits").toArrow().combine_chunks()
    keys = got["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table = unlisted(got["bits"].combine_chunks(), width)[order] if len(keys) else np.zeros((0, width))
    return keys[order], table, len(keys) == sum(share.values())


class Scorer:
    """Sums the bits of texts' n-grams; keeps the words it has met.  keys, table: the common n-grams and their bits."""

    def __init__(self, keys: np.ndarray, table: np.ndarray) -> None:
        self.keys, self.bits = keys, np.concatenate([table, np.zeros((1, table.shape[1]))])
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rare: dict[int, list[int]] = {}
        self.table = np.zeros((0, self.bits.shape[1] + 1))

    def learn(self, new: list[str], first: int) -> None:
        packed, sizes = grams(new)
        at = np.searchsorted(self.keys, packed)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == packed[found]
        at[~found] = len(self.keys)
        sums = np.add.reduceat(self.bits[at], np.cumsum(sizes) - sizes, axis=0)
        self.table = np.concatenate([self.table, np.concatenate([sizes[:, None], sums], axis=1)])
        of = np.repeat(np.arange(first, first + len(new)), sizes)
        for word, gram in zip(of[~found].tolist(), packed[~found].view(np.int64).tolist(), strict=True):
            self.rare.setdefault(word, []).append(gram)

    def numbers(self, block: list[str]) -> tuple[np.ndarray, list[Counter]]:
        """Of each text its characters (with end marks) and bits, and how often it has which n-grams that aren't common."""
        if len(self.number) > KEPT:
            self.clear()
        number, new, at, words = self.number, [], [], []
        for text in block:
            found = text.lower().split()
            words.append(len(found))
            for w in found:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(number)
                    new.append(w)
                at.append(n)
        if new:
            self.learn(new, len(self.table))
        at, words = np.array(at, np.int64), np.array(words, np.int64)
        out, rest = np.zeros((len(block), self.table.shape[1])), [Counter() for _ in block]
        some = np.flatnonzero(words)
        if len(some):
            out[some] = np.add.reduceat(self.table[at], (np.cumsum(words) - words)[some], axis=0)
        if self.rare:
            seldom = np.zeros(len(self.table), bool)
            seldom[list(self.rare)] = True
            hits = np.flatnonzero(seldom[at])
            for text, word in zip(np.repeat(np.arange(len(block)), words)[hits].tolist(), at[hits].tolist(), strict=True):
                rest[text].update(self.rare[word])
        return out, rest


def text_numbers(rows: DataFrame, bits: DataFrame, width: int) -> DataFrame:
    """doc_id, held_out, own, known and numbers (characters, then bits) of each row (columns doc_id, held_out, own and text).

    known: whether the text has a letter; bits: gram, n and as many bits as width of all n-grams of the texts.
    """
    keys, table, complete = common(bits, width)
    held = rows.sparkSession.sparkContext.broadcast((keys, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch in slices(batches):
            block = texts(column(batch, "text"))
            sums, rest = scorer.numbers(block)
            known = pa.array([any(map(str.isalpha, t)) for t in block], pa.bool_())
            other = [pa.array([list(c) for c in rest], pa.list_(pa.int64())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "held_out", "own")), known, lists(sums), *other], ["doc_id", "held_out", "own", "known", "numbers", "grams", "times"])

    schema = "doc_id long, held_out boolean, own int, known boolean, numbers array<double>, grams array<long>, times array<long>"
    first = rows.select("doc_id", "held_out", "own", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    if complete:
        return written(first.drop("grams", "times", "row"), "langid-texts")[0]
    first, path = written(first, "langid-parts")
    pairs = first.where(F.size("grams") > 0).select("row", F.explode(F.arrays_zip("grams", "times")).alias("pair")).select("row", F.col("pair.grams").alias("gram"), F.col("pair.times").alias("times"))
    more = pairs.join(bits.select("gram", "bits"), "gram").groupBy("row").agg(summed("bits", width, F.col("times")).alias("more"))
    total = F.when(F.col("more").isNull(), F.col("numbers")).otherwise(F.zip_with("numbers", F.concat(F.array(F.lit(0.0)), "more"), lambda a, b: a + b))
    out, _ = written(first.join(more, "row", "left").select("doc_id", "held_out", "own", "known", total.alias("numbers")), "langid-texts")
    remove(rows.sparkSession, path)
    return out


def measured(docs: DataFrame, learn: Column, held_out: Column) -> tuple[list[str], DataFrame | None]:
    """The languages, and text_numbers of docs; own: the language's place for rows held back, else -1."""
    spark = docs.sparkSession
    teach = F.coalesce(learn & F.col("lang").isNotNull() & F.col("text").isNotNull(), F.lit(False))
    back = teach & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)) == 0)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), F.when(teach, F.col("lang")).alias("lang"), back.alias("back"))
    counted, of_counts = written(gram_counts(rows), "langid-counts")
    learnt = counted.where(F.col("lang").isNotNull())
    names, every, fit = sides(learnt)
    if not names:
        return names, None
    asked = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    bits, of_bits = written(gram_bits(learnt, asked, names, every, fit), "langid-bits")
    place = F.array_position(F.lit(names), F.col("lang")).cast("int") - 1
    out = text_numbers(rows.withColumn("own", F.when(F.col("back"), place).otherwise(-1)), bits, 2 * len(names))
    for path in (of_counts, of_bits):
        remove(spark, path)
    return names, out


def calibrated(found: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the cross-entropy of rows held back under their own language, by the models beside them."""
    h = F.col("numbers")[F.col("own") + 1 + len(names)] / F.col("numbers")[0]
    rows = found.where((F.col("own") >= 0) & (F.col("numbers")[0] > 0)).select("own", h.alias("h")).where(~F.isnan("h"))
    sums = rows.groupBy("own").agg(F.count("*").alias("n"), F.sum("h").alias("s"), F.sum(F.col("h") * F.col("h")).alias("q")).collect()
    return {names[r.own]: (r.s / r.n, max(r.q / r.n - (r.s / r.n) ** 2, 1e-6) ** 0.5) for r in sums}


def identified(docs: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row of docs.

    learn: which rows teach (their text and lang); held_out: a column to carry.
    """
    names, found = measured(docs, learn, held_out)
    if not names:
        return docs.select("doc_id", held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    calm, width = calibrated(found, names), 1 + 2 * len(names)
    limit = np.array([calm.get(x, (np.inf, 1.0))[0] + DEVIATIONS * calm.get(x, (np.inf, 1.0))[1] for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, known = unlisted(column(batch, "numbers"), width), column(batch, "known").to_numpy(zero_copy_only=False)
            size = numbers[:, 0]
            entropy = numbers[:, 1 : 1 + len(names)] / np.maximum(size, 1)[:, None]
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            over = np.exp2(-(entropy - least[:, None]) * np.minimum(size, EVIDENCE)[:, None])
            said = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            out = [column(batch, "doc_id"), column(batch, "held_out"), pa.array(said, pa.string()), pa.array(np.where(known, 1 / over.sum(axis=1), 0.0)), pa.array(np.where(known, least, 0.0)), pa.array(~known | (least > limit[best]))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return found.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def folded(docs: DataFrame) -> DataFrame:
    """Learn from rows whose remainder modulo 3 isn't 1 (a null id's isn't); hold out the rest."""
    docs = of_rows(docs, "doc_id", "text", "lang")
    out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return identified(docs, ~out, out)
