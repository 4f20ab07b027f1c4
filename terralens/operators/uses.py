"""One counter over all samples, folded in parallel by guessing.

Each sample takes the question of highest score less three times the uses of its topic so far, so each choice depends on all before it. But it depends
on differences of uses only, and most choices aren't close. The samples are cut into ordered ranges, each is folded from a guessed counter, and the
fold notes by how much each choice was won. A guess was good enough if the true counter, put in its place, overturns no choice; ranges for which it
does are folded again from what is known then. The first of them starts from the true counter, so each round settles at least one more range; as
uses even out within a range whatever they start from, a few rounds settle all. Topics that are out of reach for long and then catch up carry their deficit
through many ranges, and such data may need a round for each; results are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.operators.saving import use_shared_folder

#: What one use of a topic costs its questions.
WEIGHT = 3
_COLUMNS = ["sample_id", "pos", "topic", "score"]


class Fold:
    """Choices of one range. ``margin[a, b]``: by how much, at least, a was chosen over b, less one where a tie would have gone to b. ``passed``: the place of the last sample that passed a topic over."""

    def __init__(self, uses: dict[str, int]):
        self.uses = Counter(uses)
        self.picked: Counter = Counter()
        self.margin: dict[tuple[str, str], int] = {}
        self.passed: dict[str, int] = {}

    def choose(self, candidates: list[tuple[int, int, str]]) -> tuple[int, str]:
        """candidates: (pos, score, topic), by pos."""
        worth = [s - WEIGHT * self.uses[t] for _, s, t in candidates]
        k = worth.index(max(worth))
        pos, _, topic = candidates[k]
        for j, (_, _, other) in enumerate(candidates):
            if other != topic:
                self.passed[other] = self.picked.total()
                lead = worth[k] - worth[j] - (j < k)
                key = (topic, other)
                if lead < self.margin.get(key, lead + 1):
                    self.margin[key] = lead
        self.uses[topic] += 1
        self.picked[topic] += 1
        return pos, topic


def holds(guess: dict[str, int], margin: dict[tuple[str, str], int], uses: dict[str, int]) -> bool:
    """Whether a range folded from ``guess`` makes the same choices from ``uses``."""
    off = lambda t: uses.get(t, 0) - guess.get(t, 0)
    return all(WEIGHT * (off(a) - off(b)) <= lead for (a, b), lead in margin.items())


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Ordered rows as samples; a sample's rows follow each other."""
    sample, rows, started = None, [], False
    for b in batches:
        for s, p, t, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if started and s != sample:
                yield sample, rows
                rows = []
            sample, started = s, True
            rows.append((p, x, t))
    if started:
        yield sample, rows


def _try(guesses: dict[int, dict[str, int]]):
    """Folds the ranges that have a guess: rows (part, topic, null, times picked), (part, topic, other, margin) and (part, null, topic, place last passed over)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part not in guesses:
            return
        fold = Fold(guesses[part])
        for _, rows in _samples(batches):
            fold.choose(rows)
        out = [(part, t, None, n) for t, n in fold.picked.items()] + [(part, a, b, m) for (a, b), m in fold.margin.items()]
        out += [(part, None, t, n) for t, n in fold.passed.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["part", "topic", "other", "n"])
    return run


def _pick(starts: list[dict[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(starts[TaskContext.get().partitionId()])
        out: list[tuple] = []

        def pack():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["sample_id", "pos", "topic"])
            out.clear()
            return made
        for sample, rows in _samples(batches):
            out.append((sample, *fold.choose(rows)))
            if len(out) == 5000:
                yield pack()
        if out:
            yield pack()
    return run


def likely(guess: dict[str, int], picked: dict[str, int], passed: dict[str, int], uses: Counter) -> Counter:
    """Where a range that must be folded again will seem to have started, for a guess of its end.

    A topic that was still passed over in the range's second half was level with the others then, wherever it started: its end follows from theirs. One that was taken whenever
    it could be keeps its distance from the start. The sum of uses is kept: it is the number of samples before, and two folds of which it differs never meet.
    """
    level = sorted((t for t, n in passed.items() if 2 * n >= sum(picked.values())), key=lambda t: (guess.get(t, 0), t))
    if not level:
        return uses
    more, left = divmod(sum(uses[t] - guess.get(t, 0) for t in level), len(level))
    return Counter(dict(uses) | {t: guess.get(t, 0) + more + (k < left) for k, t in enumerate(level)})


def settle(try_: object, parts: int) -> tuple[list[dict[str, int]], int]:
    """The counter at the start of each range, and the rounds it took. ``try_`` folds ranges from guesses: {part: guess} -> {part: (picked, margin, passed)}."""
    found: dict[int, tuple[dict, dict, dict, dict]] = {}
    todo: dict[int, dict[str, int]] = {k: {} for k in range(parts)}
    rounds = 0
    while True:
        rounds += 1
        got = try_(todo)
        for k, guess in todo.items():
            found[k] = (guess, *got.get(k, ({}, {}, {})))
        todo, starts = {}, []
        uses: Counter = Counter()
        for k in range(parts):
            guess, picked, margin, passed = found[k]
            starts.append(dict(uses))
            if not holds(guess, margin, uses):
                todo[k] = dict(uses)
                uses = likely(guess, picked, passed, uses)
            uses = Counter({t: uses[t] + picked.get(t, 0) for t in {*uses, *picked}})
        if not todo:
            return starts, rounds


def best_questions_in_order(scored: DataFrame, parts: int | None = None) -> DataFrame:
    """For each sample in the order of (city, ord, sample_id), the question (pos, topic) that scores best after all choices before it; the first on a tie.

    scored: city, ord, sample_id, pos, topic, score (whole). ``parts``: ranges, as many as shuffle partitions by default; the driver holds a counter and a table of margins
    between topics for each, and no rows. The ordered rows are checkpointed, so a lost executor costs its own tasks. Only picks of the last round come out.
    """
    spark = scored.sparkSession
    use_shared_folder(spark)
    order = ["city", "ord", "sample_id"]
    rows = scored.select(*order, F.col("pos").cast("int").alias("pos"), "topic", F.col("score").cast("long").alias("score"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "pos").select(*_COLUMNS).checkpoint()
    n = ranges.rdd.getNumPartitions()

    def fold(guesses: dict[int, dict[str, int]]) -> dict[int, tuple[dict, dict, dict]]:
        got: dict[int, tuple[dict, dict, dict]] = {}
        for r in ranges.mapInArrow(_try(guesses), "part int, topic string, other string, n long").collect():
            picked, margin, passed = got.setdefault(r.part, ({}, {}, {}))
            if r.other is None:
                picked[r.topic] = r.n
            elif r.topic is None:
                passed[r.other] = r.n
            else:
                margin[r.topic, r.other] = r.n
        return got
    starts, _ = settle(fold, n)
    return ranges.mapInArrow(_pick(starts), "sample_id string, pos int, topic string")
