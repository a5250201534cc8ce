"""Toxic passages as maximal-scoring segments of token log-odds, with extreme-value calibration.

Tokens are runs of anything but white space, lower-cased, without the marks around them; runs of more than ``LONG`` characters
give their letters' runs. A token's units are the whole word, its beginnings and ends of up to seven letters and its inner
groups of four, after digits and signs that stand for letters are read as such and other marks and repeats are dropped, so that
unseen forms of a stem and spellings that hide a word score as well.

Log-odds. Training documents (labelled; at most ``TRAINING_ROWS`` labels, by a hash of the id) count once for each distinct token; a
document of a group of near copies (same least shingle hash) weighs one over the group's size. Partial units count kinds of
words instead, as in Kneser and Ney: what speaks for an unseen form is how many of the known forms are toxic, not how
often one of them is. With t of n being toxic, a unit's log-odds is that of t + a b against n - t + a (1 - b): a Dirichlet prior of
a = ``PRIOR`` counts at the base rate b. Every unit of the training texts has one, negative ones too; units are kept in
2**``BITS`` hashed slots, so a model has the same size whatever the corpus; tasks write them to the shared folder and workers read them there, the
driver sees where they are. A token starts from the most certain of its partial units
and moves to the odds of the whole word; either step x of standard error e is shrunk by 1 - (``SURE`` e / x) squared, as in James and
Stein, so that chance moves nothing. The n-th occurrence of a token in a text counts one nth, and what a text's tokens say
on average (of scores cut at 1) is taken off, since that is its language or style.

Passages. Scores less a small drift, set so that clean text falls on average, give all maximal-scoring segments in one
pass (Ruzzo and Tompa; every open segment knows the last one with a smaller sum, so the pass is linear). Lambda solves
E exp(lambda s) = 1 over clean tokens; in n clean tokens K n exp(-lambda S) segments of score S or more are expected, K counted on
clean documents. A segment counts with lambda S - log(1 + K n) if that is positive. The sum over segments is turned into a
probability by a monotone fit. Drift, lambda, K and the fit come from the fourth of the documents that the units of the
other folds haven't seen.

Labels, language, source and id are no inputs of a score.

Edge cases: null, empty and word-less texts have no passages and get the probability of such documents; rows whose id or label
is null train nothing, repeated labels of an id count by their maximum; without toxic or without clean training documents every
score is 0; repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import attempt_file, new_path, open_input, open_output, ship_package, staged, tidy
from prefgraph.llm.near_dedup import shingle_set

TRAINING_ROWS = 200_000
BITS, SLICE = 22, 16
PRIOR, SURE = 2.0, (4.0, 2.0)
#: Scores are counted in steps of 1/``STEPS`` up to ``MOST`` either way; evidence in steps of 1/4.
STEPS, MOST = 100, 16
#: From this evidence on clean segments are counted to measure K; bins of the monotone fit; least fall of clean text a token.
COUNTED_FROM, BINS, DRIFT = 3.0, 200, 0.05
THRESHOLD = 0.3
#: Tokens that a worker remembers; an older half is forgotten.
MEMORY = 200_000
LONG = 32
TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")
LETTERS = re.compile(r"[^\W\d_]{1,24}")
_REPEATS = re.compile(r"(.)\1\1+")
#: Signs that are read as letters (fixed values).
_READ_AS = str.maketrans("013457@$!", "oieastasi")


def tokens(text: str | None) -> list[str]:
    found = TOKEN.findall((text or "").lower())
    if max(map(len, found), default=0) <= LONG:
        return found
    out = []
    for w in found:
        out += [w] if len(w) <= LONG else LETTERS.findall(w)
    return out


def folded(token: str) -> str:
    """The letters of a token, hidden ones read, longer repeats once; a token without letters as it is."""
    if not token.isalpha():
        token = "".join(c for c in token.translate(_READ_AS) if c.isalpha()) or token
    return _REPEATS.sub(r"\1", token)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots of the units of tokens, one token after another, the whole word first; and where each starts. Letters of all
    tokens are hashed together, a unit as its letters from the word's edge inwards, after a seed of its kind."""
    found = list(map(folded, words))
    letters = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    first = np.cumsum(lens) - lens
    word = np.arange(len(found))
    owner = np.repeat(word, lens)
    inside = np.arange(len(letters)) - first[owner]
    step = np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(len(found), np.uint64)
    if len(letters):
        sums[lens > 0] = np.add.reduceat(_mixed(letters + (inside.astype(np.uint64) + np.uint64(1)) * step), first[lens > 0])
    hashed, owners = [_mixed(sums + np.uint64(1))], [word]
    for seed, least, edge, way in ((2, 2, first, 1), (3, 3, first + lens - 1, -1)):  # beginnings, ends
        own = word[lens > 1]
        h = np.full(len(own), seed, np.uint64)
        for k in range(1, 8):
            longer = lens[own] > k
            own, h = own[longer], h[longer]
            h = _mixed(h * step + letters[edge[own] + way * (k - 1)])
            if k >= least:
                hashed.append(h)
                owners.append(own)
    at = np.flatnonzero((inside >= 1) & (inside < lens[owner] - 4))
    h = np.full(len(at), 4, np.uint64)
    for k in range(4):
        h = _mixed(h * step + letters[at + k])
    hashed.append(h)
    owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    flat = (np.concatenate(hashed)[order] >> np.uint64(64 - BITS)).astype(np.int64)
    return flat, np.searchsorted(owners[order], word)


def slots(token: str) -> list[int]:
    """Hashed slots of a token's units, the whole word first."""
    return units([token])[0].tolist()


def odds(t: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Log-odds against the base rate and their standard errors, in two rows of half precision."""
    up, down = t + PRIOR * base, np.maximum(n - t, 0) + PRIOR * (1 - base)
    return np.stack([np.log(up / down) - math.log(base / (1 - base)), np.sqrt(1 / up + 1 / down)]).astype(np.float16)


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(sum, first, behind the last) of all maximal-scoring segments, in order."""
    sums = np.cumsum(scores).tolist()
    # an open segment: sum before it, sum at its end, first, behind its last, last open one with a smaller sum before it
    low: list[float] = []
    high: list[float] = []
    first: list[int] = []
    stop: list[int] = []
    smaller: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        hi = sums[i]
        lo, at, k = hi - float(scores[i]), i, len(low) - 1
        while True:
            while k >= 0 and low[k] >= lo:
                k = smaller[k]
            if k < 0 or high[k] >= hi:
                break
            lo, at, before = low[k], first[k], smaller[k]
            for column in (low, high, first, stop, smaller):
                del column[k:]
            k = before
        low.append(lo)
        high.append(hi)
        first.append(at)
        stop.append(i + 1)
        smaller.append(k)
    return [(hi - lo, a, b) for lo, hi, a, b in zip(low, high, first, stop, strict=True)]


@dataclass
class Model:
    slices: list[tuple[int, str, int]] = field(default_factory=list)  # of the slots: number, file, first byte of odds and standard errors
    base: float = 0.5  # base rate, the odds of slots in no slice
    kinds: float = 0.0  # log-odds of the base rate of kinds of words against that of words
    drift: float = DRIFT
    scale: float = 1.0
    k: float = 0.0
    curve: list[float] = field(default_factory=lambda: [0.0])  # probability by bin of evidence
    known: dict[str, float] = field(default_factory=dict)
    older: dict[str, float] = field(default_factory=dict)
    table: np.ndarray | None = None  # odds and standard errors by slot, read when first needed

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}, "table": None}

    def _learn(self, words: list[str]) -> list[float]:
        if not self.slices or not words:
            return [0.0] * len(words)
        if self.table is None:
            self.table = _read_table(self.slices, self.base)
        flat, starts = units(words)
        odds, error = self.table[0][flat].astype(np.float64), self.table[1][flat].astype(np.float64)
        whole, odds = odds[starts], odds - self.kinds
        sure = np.abs(odds) / error
        sure[starts] = 0.0
        most = np.maximum.reduceat(sure, starts)
        lens = np.diff(np.append(starts, len(flat)))
        at = np.flatnonzero(sure == np.repeat(most, lens))
        part = at[np.searchsorted(at, starts)]
        shrunk = lambda x, e, sure: x * np.maximum(0.0, 1 - (sure * e / np.maximum(np.abs(x), 1e-9)) ** 2)
        score = np.where(part == starts, 0.0, shrunk(odds[part], error[part], SURE[0]))
        return np.round(score + shrunk(whole - score, error[starts], SURE[1]), 4).tolist()

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-odds of each token of a text, less its average."""
        found = list(map(self.known.get, words))
        if None in found:
            missing = {w for w, s in zip(words, found, strict=True) if s is None}
            fresh = {w: self.older[w] for w in missing if w in self.older}
            new = [w for w in missing if w not in fresh]
            fresh.update(zip(new, self._learn(new), strict=True))
            if len(self.known) > MEMORY // 2:
                self.known, self.older = {}, self.known
            self.known.update(fresh)
            found = [fresh[w] if s is None else s for w, s in zip(words, found, strict=True)]
        scores, times = np.array(found, np.float64), {}
        for i in np.flatnonzero(scores > 0).tolist():
            n = times[words[i]] = times.get(words[i], 0) + 1
            if n > 1:
                scores[i] /= n
        # what a text's ordinary words say on average is its language or style, not a passage
        return scores - max(0.0, float(np.clip(scores, -1.0, 1.0).mean())) if len(scores) else scores

    def passages(self, scores: np.ndarray) -> list[tuple[float, int, int]]:
        """(lambda times the sum, first word, word behind the last) of all maximal-scoring segments."""
        return [(self.scale * s, a, b) for s, a, b in maximal_segments(scores - self.drift)]

    def evidence(self, scores: np.ndarray, passages=None) -> float:
        bound = math.log1p(self.k * len(scores))
        return sum(max(0.0, s - bound) for s, _, _ in (self.passages(scores) if passages is None else passages))

    def judge(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """Probability of a text, and the passages that less than one in twenty clean texts of its length would hold."""
        scores = self.scores(tokens(text))
        found = self.passages(scores)
        score = self.curve[min(_bin(self.evidence(scores, found)), len(self.curve) - 1)]
        least = math.log(max(self.k * len(scores), 1e-300)) - math.log(-math.log(0.95))
        return score, [p for p in found if p[0] > least]

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def _read_table(slices: list[tuple[int, str, int]], base: float) -> np.ndarray:
    table = np.repeat(odds(np.zeros(1), np.zeros(1), base), 1 << BITS, axis=1)
    for part, uri, first in slices:
        with open_input(uri) as data:
            data.seek(first)
            table[:, part << SLICE : (part + 1) << SLICE] = np.frombuffer(data.read(4 << SLICE), np.float16).reshape(2, -1)
    return table


def _bin(x: float) -> int:
    return 0 if x <= 0 else min(BINS, 1 + int(4 * x))


def _known_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle hash, which near copies share."""
    for batch in batches:
        least = [int(s[0]) - (1 << 63) if len(s := shingle_set(t)) else None for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "copies"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed weights by token, for toxic and clean documents, of all folds and of the calibrating one."""
    names = ["token", "t", "c", "t3", "c3"]
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            batch, sums = whole.slice(at, 4000), {}
            for text, toxic, fold, weight in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic", "fold", "weight")), strict=True):
                own = set(tokens(text))
                side = (0 if toxic else 1, 2 if toxic else 3)
                for w in own:
                    x = sums.get(w)
                    if x is None:
                        x = sums[w] = [0.0] * 4
                    x[side[0]] += weight
                    if fold == 3:
                        x[side[1]] += weight
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string())] + [pa.array([x[i] for x in sums.values()], pa.float64()) for i in range(4)], names)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slot of a task's tokens (toxic, all; the same without the calibrating fold), a row for each slice of the slots.

    The whole word's slot gets its weights, those of partial units the share of toxic among them, once for each kind of word.
    """
    sums = np.zeros((4, 1 << BITS), np.float32)
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            t, c, t3, c3 = (part.column(n).to_numpy() for n in ("t", "c", "t3", "c3"))
            flat, starts = units(part.column("token").to_pylist())
            lens = np.diff(np.append(starts, len(flat)))
            used, place = np.unique(flat, return_inverse=True)
            for row, (toxic, n) in enumerate(((t, t + c), (np.maximum(t - t3, 0), np.maximum(t + c - t3 - c3, 0)))):
                kind = np.minimum(1.0, n)
                for k, (whole, partial) in enumerate(((toxic, kind * toxic / np.maximum(n, 1e-9)), (n, kind))):
                    values = np.repeat(partial, lens)
                    values[starts] = whole
                    sums[2 * row + k, used] += np.bincount(place, values, len(used)).astype(np.float32)
    for slice_ in range(1 << (BITS - SLICE)):
        own = sums[:, slice_ << SLICE : (slice_ + 1) << SLICE]
        used = np.flatnonzero(own[1])
        if len(used):
            yield pa.RecordBatch.from_pydict({"part": pa.array([slice_], pa.int32()), "used": pa.array([used.astype(np.uint16).tobytes()], pa.binary()), "sums": pa.array([own[:, used].tobytes()], pa.binary())})


def _odds(folder: str, base: float, base_without: float):
    """Writes tables of each slice, of all folds and then of those without the calibrating one; a row for each says where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, used, sums in zip(*(batch.column(n).to_pylist() for n in ("part", "used", "sums")), strict=True):
                at = np.frombuffer(used, np.uint16)
                parts.setdefault(part, np.zeros((4, 1 << SLICE)))[:, at] += np.frombuffer(sums, np.float32).reshape(4, -1)
        if not parts:
            return
        uri = attempt_file(folder, ".odds")
        with open_output(uri) as out:
            for t, n, t_without, n_without in parts.values():
                out.write(odds(t, n, base).tobytes())
                out.write(odds(t_without, n_without, base_without).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int32()), "file": [uri] * len(parts), "first": pa.array([k * (8 << SLICE) for k in range(len(parts))], pa.int64())})

    return run


def _held(model):
    """Token scores of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                scores = [model.value.scores(tokens(t)).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(scores, pa.binary()), batch.column("toxic"), batch.column("weight")], ["scores", "toxic", "weight"])

    return run


def _arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(s, np.float32).astype(np.float64) for s in batch.column("scores").to_pylist())


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(2 * STEPS * MOST + 1)
    for batch in batches:
        for scores, weight in zip(_arrays(batch), batch.column("weight").to_pylist(), strict=True):
            at = np.clip(np.rint(scores * STEPS), -STEPS * MOST, STEPS * MOST).astype(np.int64) + STEPS * MOST
            seen += weight * np.bincount(at, minlength=len(seen))
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "n": pa.array(seen[used], pa.float64())})


def _clean_segments(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = 0.0, 0.0
        for batch in batches:
            for scores, weight in zip(_arrays(batch), batch.column("weight").to_pylist(), strict=True):
                seen += weight * len(scores)
                found += weight * math.exp(COUNTED_FROM) * sum(s >= COUNTED_FROM for s, _, _ in model.passages(scores))
        yield pa.RecordBatch.from_pydict({"found": [found], "seen": [seen]})

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [_bin(model.evidence(s)) for s in _arrays(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), batch.column("toxic"), batch.column("weight")], ["bin", "toxic", "weight"])

    return run


def drift_and_scale(scores: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """What to take from each score so that clean text falls by ``DRIFT`` a token at least, and the positive lambda with
    E exp(lambda s) = 1 of the scores after that (1 if there are none)."""
    total = weights.sum()
    if total <= 0:
        return DRIFT, 1.0
    drift = max(0.0, float(scores @ weights) / total + DRIFT)
    s = scores - drift
    if s[weights > 0].max() <= 0:
        return drift, 1.0
    least, most = 1e-3, 8.0
    for _ in range(50):
        middle = (least + most) / 2
        grows = np.log(weights @ np.exp(np.minimum(middle * s, 500.0)) / total) > 0
        least, most = (least, middle) if grows else (middle, most)
    return drift, least


def monotone(toxic: list[float], all_: list[float]) -> list[float]:
    """Rising probabilities by pooling neighbours that fall; bins without documents take those of their neighbours."""
    pools: list[list[float]] = []
    for k, (y, n) in enumerate(zip(toxic, all_, strict=True)):
        if n <= 0:
            continue
        pools.append([y, n, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, _ = pools.pop()
            pools[-1][0] += y
            pools[-1][1] += n
    if not pools:
        return [0.0] * len(all_)
    firsts = [p[2] for p in pools]
    values = [(y + 0.02) / (n + 0.1) for y, n, _ in pools]
    values = [max(values[: i + 1]) for i in range(len(values))]
    return [values[max(0, bisect.bisect_right(firsts, k) - 1)] for k in range(len(all_))]


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text") -> Model:
    """Model from the labelled documents whose crc32(id) mod 4 isn't 2."""
    spark = docs.sparkSession
    ship_package(spark)
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold).where("fold <> 2")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # TRAINING_ROWS rows of three numbers at most are broadcast
    rows = texts.join(F.broadcast(known), "doc_id").select("text", "toxic", "fold")
    rows = staged(rows.mapInArrow(tidy(_known_rows), "text string, toxic int, fold int, copies long"), "toxicity-training")
    sizes = rows.where("copies is not null").groupBy("copies").agg(F.count("*").alias("n"))
    # groups of at least two of the training rows: two numbers each
    rows = rows.join(F.broadcast(sizes.where("n > 1")), "copies", "left")
    rows = rows.select("text", "toxic", "fold", F.when(F.col("copies").isNull(), 0.0).otherwise(1.0 / F.coalesce("n", F.lit(1))).alias("weight"))
    sums = ("t", "c", "t3", "c3")
    tally = rows.mapInArrow(tidy(_tally), "token string, t double, c double, t3 double, c3 double")
    counts = staged(tally.groupBy("token").agg(*[F.sum(n).alias(n) for n in sums]), "toxicity-counts")
    shares = [(f"sum({t})", f"sum({n})", f"sum(least(1, {n}) * {t} / {n})", f"sum(least(1, {n}))") for t, n in (("t", "(t + c)"), ("(t - t3)", "nullif(round(t + c - t3 - c3, 9), 0)"))]
    total = counts.where("t + c > 0").agg(*[F.coalesce(F.expr(x), F.lit(0.0)).alias(f"{k}{i}") for k, xs in zip("fw", shares, strict=True) for i, x in enumerate(xs)]).first()
    (t, n, *kinds), (t_without, n_without, *kinds_without) = ([total[f"{k}{i}"] for i in range(4)] for k in "fw")
    if not 0 < t < n:
        return Model()
    parted = 1e-6 < t_without < n_without - 1e-6 and t_without < t - 1e-6 and n_without - t_without < n - t - 1e-6
    base, without = t / n, t_without / n_without if parted else t / n
    logit = lambda p: math.log(p / (1 - p))
    apart = lambda k, p: logit(k[0] / k[1]) - logit(p) if 0 < k[0] < k[1] else 0.0
    units = counts.mapInArrow(tidy(_units), "part int, used binary, sums binary")
    tables = units.repartition(1 << (BITS - SLICE), "part").mapInArrow(tidy(_odds(new_path(spark, "toxicity-odds"), base, without)), "part int, file string, first long").collect()
    # the driver gets three values for each of 2**(BITS - SLICE) slices, whatever the corpus
    full = [(r["part"], r["file"], r["first"]) for r in tables]
    held = [(part, uri, first + (4 << SLICE)) for part, uri, first in full]
    offset = apart(kinds, base)
    partial = Model(held, without, apart(kinds_without, without)) if parted else Model(full, base, offset)
    shared = spark.sparkContext.broadcast(partial)
    scored = staged(rows.where("fold = 3" if parted else "true").mapInArrow(tidy(_held(shared)), "scores binary, toxic int, weight double"), "toxicity-held")
    shared.unpersist()
    clean = scored.where("toxic = 0")
    bins = clean.mapInArrow(tidy(_histogram), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    partial.drift, partial.scale = drift_and_scale(np.array([(r["at"] - STEPS * MOST) / STEPS for r in bins]), np.array([r["n"] for r in bins]))
    light = Model(drift=partial.drift, scale=partial.scale)
    count = clean.mapInArrow(tidy(_clean_segments(light)), "found double, seen double").agg(F.sum("found").alias("found"), F.sum("seen").alias("seen")).first()
    light.k = max(count["found"] or 0.0, 1.0) / max(count["seen"] or 0.0, 1.0)
    bins = scored.mapInArrow(tidy(_evidence(light)), "bin int, toxic int, weight double").groupBy("bin").agg(F.sum(F.col("weight") * F.col("toxic")).alias("y"), F.sum("weight").alias("n")).collect()
    toxic, all_ = [0.0] * (BINS + 1), [0.0] * (BINS + 1)
    for r in bins:
        toxic[r["bin"]], all_[r["bin"]] = r["y"], r["n"]
    return Model(full, base, offset, light.drift, light.scale, light.k, monotone(toxic, all_))


def _score(model):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                judged = [model.value.judge(t) for t in batch.column("text").to_pylist()]
                passages = [[{"score": s, "first": a, "stop": b} for s, a, b in found] for _, found in judged]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in judged], pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, passages) for each row; passages are significant segments in words."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(tidy(_score(shared)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<score: double, first: int, stop: int>>")


def _keep(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield batch.filter(pa.array([model.value.score(t) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    ship_package(docs.sparkSession)
    return docs.mapInArrow(tidy(_keep(docs.sparkSession.sparkContext.broadcast(model))), docs.schema)
