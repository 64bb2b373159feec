"""Best-fit packing of token sequences by a configuration linear program.

The program has a variable for every way to fill a sequence (a configuration: how many pieces of
each length), and asks that the pieces of each length be used up with the fewest sequences. It
sees lengths only through their histogram, of at most `capacity` entries however many documents
there are, and prices every length by itself. It is solved by multiplicative weights: a price per
length starts at the length itself and falls exponentially with the share of its pieces used. Each
round an exact knapsack dynamic program over all capacities finds the highest price that fits; the
table also tells, for every length, the best configuration that holds it. Those whose price is
within SLACK of the highest are used a little each (each at most STEP of the pieces of any of
its lengths, but a whole sequence where that is less than one; none whose lengths have had as much
in this round), and then prices are set anew. A length
used to 1 - EPSILON has no price any more, and the rounds end when none has one. Amounts are
rounded down, and the fractions carried on to the next configuration. What is left goes to the
fullest sequence that still has room (best fit, decreasing), again by length.

Pieces then get their places: each is numbered among those of its length (a salted count, so that
a very common length is not numbered in one task), and a table of at most a few thousand runs
turns (length, number) into a sequence and an offset.

Defined cases: a null text counts as empty and packs as the end id alone; a null doc_id stays
null; repeated rows are packed each for itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, keep_id, map_batches, materialize, released, shuffle_partitions
from loomwork.llm.token_transducer import compiled, windows

EPSILON, STEP = 0.05, 0.5
#: The exponent by which a price falls when all of a length is used, and what a configuration may
#: cost less than the best one.
ETA, SLACK = 0.1, 0.005
LOG = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """Token ids of every document plus the end id, cut into pieces of capacity; one row a piece."""
    bounded_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in windows(batches, 1):
            ids, row, piece, crc, size = b.column(0).to_pylist(), [], [], [], []
            for i, code in enumerate(compiled(tokenizer_file).codes_of_texts(b.column(1).fill_null(""))):
                code += end
                for k in range(0, len(code), 4 * capacity):
                    part = code[k : k + 4 * capacity]
                    row.append(ids[i])
                    piece.append(k // (4 * capacity))
                    crc.append(zlib.crc32(part))
                    size.append(len(part) // 4)
            columns = [pa.array(row, pa.int64()), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keep_id(docs, "doc_id", "text").mapInArrow(released(run), PIECES)


def knapsack(prices: np.ndarray, capacity: int, rng: np.random.Generator, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for every capacity: the highest price of lengths with repetition, and how
    it comes about: the capacity itself as one piece (0), one unit left empty (-1), or two parts,
    one of which is given. Of splits within the slack of the best one, any may be taken, so that
    the fillings of different capacities do not all rest on the same few lengths."""
    best, split = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    draw = rng.random(capacity + 1)
    for c in range(1, capacity + 1):
        top, how = best[c - 1], -1
        half = c // 2
        if half:
            both = best[1 : half + 1] + best[c - half : c][::-1]
            most = both.max()
            if most > top:
                near = (both >= most * (1 - slack)).nonzero()[0]
                at = int(near[int(draw[c] * len(near))])
                if both[at] > top:
                    top, how = both[at], at + 1
        if prices[c] > 0 and prices[c] >= top * (1 - slack):
            top, how = prices[c], 0
        best[c], split[c] = top, how
    return best, split


def configuration(split: np.ndarray, capacity: int) -> Counter:
    """The pieces of the best filling of a capacity."""
    found: Counter = Counter()
    todo = [capacity]
    while todo:
        c = todo.pop()
        how = int(split[c])
        while how < 0 and c > 0:
            c -= 1
            how = int(split[c])
        if c == 0:
            continue
        if how:
            todo += (how, c - how)
        else:
            found[c] += 1
    return found


def program(demand: np.ndarray, capacity: int, epsilon: float = EPSILON, rounds: int | None = None) -> dict[tuple, float]:
    """Configurations and (fractional) amounts that use 1 - epsilon to all of the demand of every
    length. The number of rounds depends on epsilon alone but for lengths of few pieces."""
    need = demand.astype(np.float64)
    used = np.zeros(capacity + 1)  # pieces
    amounts: dict[tuple, float] = {}
    size, rng = np.arange(capacity + 1, dtype=float), np.random.default_rng(capacity)
    while rounds != 0:
        share = np.divide(used, need, out=np.ones(capacity + 1), where=need > 0)
        weight = np.where((need - used > 1e-9) & (share < 1 - epsilon), size * np.exp(-ETA * share), 0.0)
        if not weight.any():
            break
        best, split = knapsack(weight, capacity, rng, SLACK / 10)
        spent = np.zeros(capacity + 1)  # in this round
        lengths = np.flatnonzero(weight)
        value = weight[lengths] + best[capacity - lengths]
        order = lengths[np.argsort(-value, kind="stable")]
        least = (1 - SLACK) * best[capacity]
        for length in order[: int((value >= least).sum())].tolist():
            if spent[length] >= STEP * need[length]:
                continue
            config = configuration(split, capacity - length)
            config[length] += 1
            if any(spent[x] >= STEP * need[x] for x in config if spent[x]):
                continue  # there is more in a later round
            step = min(min(max(STEP * need[x] / n, 1.0), (need[x] - used[x]) / n) for x, n in config.items())
            if step <= 1e-9:
                continue
            key = tuple(sorted(config.items()))
            amounts[key] = amounts.get(key, 0.0) + step
            for x, n in key:
                spent[x] += step * n
                used[x] += step * n
        rounds = None if rounds is None else rounds - 1
    return amounts


def solve(histogram: dict[int, int], capacity: int, rounds: int | None = None, epsilon: float = EPSILON) -> list[tuple[Counter, int]]:
    """Configurations and how often to use each; together they hold exactly the histogram. Logs the
    share that the program places."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[Counter, int]] = []
    if left[capacity]:
        plan.append((Counter({capacity: 1}), int(left[capacity])))
        left[capacity] = 0
    pieces, total = int(left.sum()), int((left * np.arange(capacity + 1)).sum())
    placed: list[tuple[Counter, int]] = []
    carried = 0.0
    for key, amount in sorted(program(left, capacity, epsilon, rounds).items(), key=lambda x: (-x[1], x[0])):
        carried += amount
        times = min(int(carried + 1e-6), *(int(left[x]) // n for x, n in key)) if carried >= 1 - 1e-6 else 0
        carried = min(carried - times, 1.0)
        if times:
            for x, n in key:
                left[x] -= times * n
            placed.append((Counter(dict(key)), times))
    held = (1 - int(left.sum()) / max(1, pieces), 1 - int((left * np.arange(capacity + 1)).sum()) / max(1, total))
    LOG.info("the linear program places %.3f of the pieces under the capacity and %.3f of their tokens", *held)
    return plan + _best_fit(placed, left, capacity)


def _best_fit(placed: list[tuple[Counter, int]], left: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Fill the sequences of placed, the fullest first, and then one new sequence after the other
    with the longest pieces that fit; a filling is repeated as long as the pieces last, so the work
    depends on the distinct lengths and configurations alone."""
    left, plan = left.copy(), []
    open_ = sorted(((capacity - sum(length * n for length, n in c.items()), k, c, times) for k, (c, times) in enumerate(placed)), key=lambda x: x[:2])
    at = 0
    while at < len(open_) or left.any():
        room, _, config, most = open_[at] if at < len(open_) else (capacity, 0, Counter(), None)
        base, added = config, Counter()
        lengths = np.flatnonzero(left)
        while room > 0:
            k = int(np.searchsorted(lengths, room, side="right"))
            if k == 0:
                break
            length = int(lengths[k - 1])
            n = min(int(left[length]), room // length)
            added[length] = n
            room -= n * length
            lengths = lengths[: k - 1]
        times = min([int(left[length]) // n for length, n in added.items()] + ([most] if most is not None else []))
        for length, n in added.items():
            left[length] -= times * n
        plan.append((base + added, times))
        if most is not None:
            if times == most:
                at += 1
            else:
                open_[at] = (open_[at][0], 0, base, most - times)
    return plan


def runs_of(plan: list[tuple[Counter, int]]) -> tuple[np.ndarray, ...]:
    """Runs (length, first number, first sequence, sequences, offset), sorted by length and number:
    the pieces first..first + copies * sequences of a length go to the sequences in turn."""
    rows, taken, sequence = [], Counter(), 0
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            rows.append((length, taken[length], sequence, times, offset))
            taken[length] += times * config[length]
            offset += length * config[length]
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def number_within_length(pieces: DataFrame) -> DataFrame:
    """Adds number: 0, 1, ... among the pieces of a length, counted per salt and shifted by what
    the lower salts hold."""
    salts = shuffle_partitions(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(shift, ["length", "salt"]).withColumn("number", F.col("k") + F.col("shift")).drop("salt", "k", "shift")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (which should be a stored table: it is read twice)."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    length, first, sequence, times, offset = runs_of(solve(histogram, capacity))
    key = (length << 44) + first

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        size, number = own["length"].to_numpy(zero_copy_only=False), own["number"].to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, (size << 44) + number, side="right") - 1
        k = number - first[at]
        out = [own[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        out += [pa.array(sequence[at] + k % times[at]), pa.array(offset[at] + k // times[at] * size)]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(number_within_length(pieces), run, PIECES + ", sequence_id long, offset long", rows=20_000)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents; one row per piece. Tokens are computed once, the pieces' rows stored."""
    return pack(materialize(token_pieces(docs, tokenizer_file, capacity, end_id), "pieces"), capacity)
