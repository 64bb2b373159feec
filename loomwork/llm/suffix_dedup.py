"""Removal of repeated passages: every byte covered by a WINDOW-byte string that starts earlier.

Equal strings are found as equal suffixes, compared on their first WINDOW bytes, in sorted order.
A sparse set of suffixes suffices to decide where to look: in each WINDOW-byte string the GRAM-byte
string of the smallest hash (the leftmost of several) is its anchor. Equal strings have their
anchor at the same place, so only strings whose anchors are equal need comparing, and there are
about WINDOW / 4 times fewer anchors than suffixes.

Documents are packed into blocks of about BLOCK_BYTES, stored once and bucketed by block, so that
later passes read them without a shuffle. A suffix's keys are its leading bytes, LEAD of them as one
word, and then a hash of the bytes it is compared on, which orders suffixes of equal leading bytes.
Splitters sampled from the blocks (for the last question from the strings that it is about, which
are no even share of the text) range-partition the suffixes by these words among owners, who sort
what they get by multikey quicksort (leading bytes first, then the next word within runs of equal
ones) and answer each block with bits in the order asked:
  1. anchors: does the anchor's suffix occur elsewhere?
  2. of those, contexts (all bytes of the strings that share the anchor): is there an earlier
     suffix with the same context, so that all of its strings are repeats, and are there other
     contexts of the same anchor?
  3. of anchors with several contexts, the earliest suffix of each context: every string by itself.
A block sends a key once however often it holds it, so a passage that very many documents share
reaches an owner once per block. Equal keys never straddle a boundary, since splitters are keys, so
neighbours on either side of one differ; the exact order of ties is (doc_id, position, block).

Defined cases: null and empty texts and those under WINDOW bytes lose nothing; rows with a null
doc_id are left whole and nothing is compared with them; of repeated rows one keeps its text and
the others count as later copies; an empty table gives no rows. Other columns are carried through
by `remove_repeats` and ignored by `repeat_digest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.blocks import from_blob, store_blocks
from loomwork.llm.common import bounded_sample, discard, materialize, mix64, released
from loomwork.llm.ngram_hash import prefix_sums

WINDOW, GRAM, LEAD = 100, 50, 8
REACH = WINDOW - GRAM + 1  # suffix anchors in a window
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
SAMPLE_KEYS = 64
MAX_SAMPLE = 200_000


# --- blocks ------------------------------------------------------------------------------------
class Block:
    """A block's documents by doc_id, their bytes in one buffer, and their anchors."""

    def __init__(self, table: pa.Table, limit: int | None = None):
        self.table = table.sort_by([("doc_id", "ascending")]) if limit is None else table
        self.ids = self.table["doc_id"].to_pylist()
        self.texts = [(t or "").encode() for t in self.table["text"].to_pylist()]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        parts, at = [], 0
        while at < len(self.texts):
            stop, size = at, 0
            while stop < len(self.texts) and (stop == at or size + len(self.texts[stop]) <= SLICE_BYTES):
                size += len(self.texts[stop])
                stop += 1
            parts.append(self._anchors(at, stop))
            at = stop
            if limit is not None and size >= limit:
                break
        #: anchors in order: place of the suffix, first and last string, leading bytes, key, context hash
        self.place, self.first, self.last, self.lead, self.key, self.context = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3

    def _anchors(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(self.texts[lo:hi]), np.uint8)
        base, n = self.starts[lo], len(raw)
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
        if n < WINDOW:
            return none
        sums, down = prefix_sums(raw)
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        # strings that lie in one document with an id
        size, begin = self.sizes[lo:hi], self.starts[lo:hi] - base
        inside = np.zeros(n + 1, np.int32)
        ok = (size >= WINDOW) & np.array([i is not None for i in self.ids[lo:hi]], bool)
        np.add.at(inside, begin[ok], 1)
        np.add.at(inside, begin[ok] + size[ok] - WINDOW + 1, -1)
        valid = np.cumsum(inside[:-1])[: n - WINDOW + 1] > 0
        bits = max(1, int(n).bit_length())
        low = np.uint64((1 << bits) - 1)
        ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(ranked, REACH) & low).astype(np.int64)
        string = np.flatnonzero(valid)
        if not len(string):
            return none
        at = at[string]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (string[1:] != string[:-1] + 1)
        head = np.flatnonzero(new)
        place, first = at[head], string[head]
        last = string[np.append(head[1:], len(at)) - 1]
        shape = ((place - first) * 64 + (last - first)).astype(np.uint64)
        context = mix64((sums[last + WINDOW] - sums[first]) * down[first] + shape * np.uint64(0xC2B2AE3D27D4EB4F))
        return place + base, first + base, last + base, _leading(raw, place), grams[place], context

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading bytes and two hashes of the strings that start at these (sorted) places."""
        out: list[list[np.ndarray]] = [[], [], []]
        raw = np.frombuffer(b"".join(self.texts), np.uint8)
        for k in range(0, len(raw), SLICE_BYTES):
            here = at[np.searchsorted(at, k) : np.searchsorted(at, k + SLICE_BYTES)] - k
            if not len(here):
                continue
            part = raw[k : k + SLICE_BYTES + WINDOW]
            out[0].append(_leading(part, here))
            for column, mask, salt in ((1, 0, 0), (2, 0x5A, 1)):
                sums, down = prefix_sums(part ^ np.uint8(mask))
                out[column].append(mix64((sums[here + WINDOW] - sums[here]) * down[here] + np.uint64(salt)))
        lead, key, more = (np.concatenate(c or [np.zeros(0, np.uint64)]) for c in out)
        return lead, key, more

    def origin(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and position within the document of places in the buffer."""
        doc = np.searchsorted(self.starts, at, side="right") - 1
        # documents of no bytes share their start with the next one; the last of those is meant
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        return ids[doc] if len(ids) else doc, at - self.starts[doc] if len(ids) else at


def _leading(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LEAD bytes from each place on as one number, whose order is that of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(LEAD):
        out = out << np.uint64(8) | raw[at + k]
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from running minima within aligned pieces."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    pieces = full.reshape(-1, width)
    forth = np.minimum.accumulate(pieces, axis=1).reshape(-1)
    back = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def multikey_sort(words: list[np.ndarray]) -> np.ndarray:
    """Order by the first word, then, only within runs of equal words, by the next one."""
    order = np.argsort(words[0], kind="stable")
    same = words[0][order][1:] == words[0][order][:-1]
    for word in words[1:]:
        if not same.any():
            break
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in edge.reshape(-1, 2) if len(edge) <= 2000 else ():
            part = order[a : b + 1]
            order[a : b + 1] = part[np.argsort(word[part], kind="stable")]
        if len(edge) > 2000:  # many short runs: all at once
            rows = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            run = np.cumsum(~np.concatenate([[False], same]))[rows]
            order[rows] = order[rows][np.lexsort((word[order[rows]], run))]
        same &= word[order][1:] == word[order][:-1]
    return order


# --- questions and answers ---------------------------------------------------------------------
#: The owner that stands for a sample, and blocks that sample their strings.
SAMPLED, SAMPLE_BLOCKS = -1, 2000
ASKED = "owner int, block long, data binary"
ANSWERED = "block long, step int, owner int, bits binary"


def _cuts(columns: tuple[np.ndarray, ...], splitters: np.ndarray) -> np.ndarray:
    """Where the owners' runs begin and end among suffixes sorted by their first two words."""
    lead, key = columns[0], columns[1]
    low, high = np.searchsorted(lead, splitters[:, 0], side="left"), np.searchsorted(lead, splitters[:, 0], side="right")
    at = [a + int(np.searchsorted(key[a:b], k, side="left")) for a, b, k in zip(low.tolist(), high.tolist(), splitters[:, 1])]
    return np.array([0, *at, len(lead)], np.int64)


def _ask(block: int, columns: tuple[np.ndarray, ...], splitters: np.ndarray) -> pa.Table:
    """Rows for the owners: the columns' runs, one after the other, as raw bytes."""
    cut = _cuts(columns, splitters)
    rows = [(o, b"".join([np.array([b - a], "<i8").tobytes(), *(c[a:b].tobytes() for c in columns)])) for o, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
    return pa.table({"owner": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _read(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _answer(asked: DataFrame, step: int, kinds: tuple[str, ...], judge: Callable[..., list[np.ndarray]]) -> DataFrame:
    """Owners answer each block: judge gets the columns of all blocks, and each row's block, and
    returns boolean columns; they come back as bits, column after column."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = len(table)
        if key[0].as_py() == SAMPLED:  # of a bounded number of blocks
            return pa.table({"block": table["block"], "step": pa.array([step] * n, pa.int32()), "owner": table["owner"], "bits": table["data"]})
        table = table.sort_by([("block", "ascending")])
        blocks = table["block"].to_pylist()
        parts = [_read(x, kinds) for x in table["data"].to_pylist()]
        sizes = [len(p[0]) for p in parts]
        verdict = judge(*[np.concatenate(c) for c in zip(*parts)], np.repeat(np.arange(len(parts)), sizes))
        stops = np.cumsum(sizes)
        bits = [b"".join(np.packbits(v[b - s : b]).tobytes() for v in verdict) for b, s in zip(stops, sizes)]
        n = len(parts)
        return pa.table({"block": pa.array(blocks, pa.int64()), "step": pa.array([step] * n, pa.int32()), "owner": pa.array([key[0].as_py()] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("owner").applyInArrow(released(run), ANSWERED)


def _told(answers: pa.Table, step: int, columns: tuple[np.ndarray, ...], splitters: np.ndarray, width: int) -> list[np.ndarray]:
    """The answers to what _ask sent, in its order."""
    cut = _cuts(columns, splitters)
    out = [np.zeros(len(columns[0]), bool) for _ in range(width)]
    for s, owner, bits in zip(*(answers[c].to_pylist() for c in ("step", "owner", "bits"))):
        if s == step:
            a, b = int(cut[owner]), int(cut[owner + 1])
            per = -(-(b - a) // 8)
            raw = np.frombuffer(bits, np.uint8)
            for i in range(width):
                out[i][a:b] = np.unpackbits(raw[i * per : (i + 1) * per], count=b - a).astype(bool)
    return out


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which of sorted rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _judge_anchors(lead: np.ndarray, key: np.ndarray, several: np.ndarray, block: np.ndarray) -> list[np.ndarray]:
    order = multikey_sort([lead, key])
    run = np.cumsum(_new(lead[order], key[order])) - 1
    twice = (np.bincount(run) > 1) | (np.bincount(run, several[order]) > 0)
    out = np.zeros(len(key), bool)
    out[order] = twice[run]
    return [out]


def _judge_contexts(lead: np.ndarray, key: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray, block: np.ndarray) -> list[np.ndarray]:
    order = multikey_sort([lead, key, context, doc, place, block])
    lead, key, context = lead[order], key[order], context[order]
    new_key, new = _new(lead, key), _new(lead, key, context)
    run = np.cumsum(new_key) - 1
    contexts = np.bincount(run, new)
    repeat, open_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    repeat[order] = ~new
    open_[order] = new & (contexts[run] > 1)
    return [repeat, open_]


def _judge_strings(lead: np.ndarray, key: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, block: np.ndarray) -> list[np.ndarray]:
    order = multikey_sort([lead, key, more, doc, place, block])
    repeat = np.zeros(len(key), bool)
    repeat[order] = ~_new(lead[order], key[order], more[order])
    return [repeat]


class _Steps:
    """What a block asks at each step, given the answers so far; each pass recomputes it."""

    def __init__(self, block: Block, splitters: np.ndarray, last: np.ndarray | None = None):
        self.block, self.splitters, self.last = block, splitters, last

    def anchors(self) -> tuple[np.ndarray, ...]:
        b = self.block
        order = multikey_sort([b.lead, b.key])
        new = _new(b.lead[order], b.key[order])
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        n = np.bincount(self.inverse)
        return b.lead[order[new]], b.key[order[new]], (n > 1).astype("u1")

    def contexts(self, answers: pa.Table) -> tuple[np.ndarray, ...]:
        twice = _told(answers, 1, self.anchors(), self.splitters, 1)[0]
        self.shared = np.flatnonzero(twice[self.inverse])  # anchors, in order of place
        b = self.block
        lead, key, context = b.lead[self.shared], b.key[self.shared], b.context[self.shared]
        order = multikey_sort([lead, key, context])  # stable: the earliest of equal ones comes first
        new = _new(lead[order], key[order], context[order])
        self.heads = self.shared[order[new]]
        self.repeats = [self.shared[order[~new]]]
        return (b.lead[self.heads], b.key[self.heads], b.context[self.heads], *b.origin(b.place[self.heads]))

    def sample(self) -> bytes:
        """Keys of a few strings around the shared anchors."""
        b, some = self.block, self.shared[:: max(1, len(self.shared) // SAMPLE_KEYS)]
        lead, key, _ = b.strings(np.sort(b.first[some] + (b.last[some] - b.first[some]) // 2))
        return np.stack([lead, key], axis=1).astype(">u8").tobytes()

    def strings(self, answers: pa.Table) -> tuple[np.ndarray, ...]:
        asked = self.contexts(answers)
        repeat, open_ = _told(answers, 2, asked, self.splitters, 2)
        self.repeats.append(self.heads[repeat])
        b, at = self.block, np.sort(self.heads[open_])
        count = b.last[at] - b.first[at] + 1
        place = np.repeat(b.first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        lead, key, more = b.strings(place)
        order = multikey_sort([lead, key, more])
        new = _new(lead[order], key[order], more[order])
        self.heads = place[order[new]]
        self.again = place[order[~new]]
        return (lead[order[new]], key[order[new]], more[order[new]], *b.origin(self.heads))

    def covered(self, answers: pa.Table) -> np.ndarray:
        """Which bytes of the buffer go."""
        asked = self.strings(answers)
        repeat = _told(answers, 3, asked, self.last, 1)[0]
        b, anchors = self.block, np.concatenate(self.repeats)
        places = np.concatenate([self.again, self.heads[repeat]])
        edge = np.zeros(int(b.sizes.sum()) + 1, np.int32)
        np.add.at(edge, np.concatenate([b.first[anchors], places]), 1)
        np.add.at(edge, np.concatenate([b.last[anchors] + WINDOW, places + WINDOW]), -1)
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _sample(table: pa.Table) -> list[bytes]:
    """Keys of a few suffixes of the table, as bytes."""
    own = Block(table, limit=1)
    words = np.stack([own.lead, own.key], axis=1).astype(">u8")
    return [w.tobytes() for w in words[:: max(1, table.num_rows // 8)][:SAMPLE_KEYS]]


def _solve(docs: DataFrame, finish: Callable[[Block, np.ndarray], pa.Table], schema, block_bytes: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    blocks, name = store_blocks(docs, block_bytes, _sample)
    n = blocks.count()
    sampled = [r[0] for r in bounded_sample(blocks.select(F.explode("sample").alias("key")), ["key"], MAX_SAMPLE, n * SAMPLE_KEYS).collect()]
    splitters = _splitters([bytes(k) for k in sampled], n)
    blocks = blocks.select("block", "blob")
    try:
        return _rounds(blocks, n, splitters, finish, schema)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _splitters(keys: list[bytes], n: int) -> np.ndarray:
    """At most n - 1 of the keys, evenly apart, as pairs of words."""
    keys = sorted(keys)
    chosen = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    return np.frombuffer(b"".join(chosen), ">u8").astype(np.uint64).reshape(-1, 2)


def _rounds(blocks: DataFrame, n: int, splitters: np.ndarray, finish: Callable[[Block, np.ndarray], pa.Table], schema) -> DataFrame:
    """The three rounds of questions, and what is left of each text."""
    stride = np.uint64(max(1, n // SAMPLE_BLOCKS))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _ask(number, _Steps(Block(from_blob(blob)), splitters).anchors(), splitters).to_batches()

    def second(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = [_ask(0, (np.zeros(0, np.uint64),) * 2, np.zeros((0, 2), np.uint64))]
        for number, blob in zip(own["block"].to_pylist(), own["blob"].to_pylist()):
            steps = _Steps(Block(from_blob(blob)), splitters)
            out.append(_ask(number, steps.contexts(answers), splitters))
            if len(steps.shared) and mix64(np.array([number], np.uint64))[0] % stride == 0:
                out.append(pa.table({"owner": pa.array([SAMPLED], pa.int32()), "block": pa.array([number], pa.int64()), "data": pa.array([steps.sample()], pa.binary())}))
        return pa.concat_tables(out)

    def meet(answers: DataFrame, f: Callable, out) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.where(F.col("owner") != SAMPLED).groupBy("block")).applyInArrow(released(f), out)

    a = materialize(_answer(blocks.mapInArrow(released(first), ASKED), 1, ("<u8", "<u8", "u1"), _judge_anchors), "anchors")
    b = materialize(_answer(meet(a, second, ASKED), 2, ("<u8", "<u8", "<u8", "<i8", "<i8"), _judge_contexts), "contexts")
    sampled = [bytes(r[0]) for r in b.where(F.col("owner") == SAMPLED).select("bits").collect()]
    last = _splitters([x[i : i + 16] for x in sampled for i in range(0, len(x), 16)], n) if sampled else splitters

    def third(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = [_ask(0, (np.zeros(0, np.uint64),) * 2, np.zeros((0, 2), np.uint64))]
        for number, blob in zip(own["block"].to_pylist(), own["blob"].to_pylist()):
            out.append(_ask(number, _Steps(Block(from_blob(blob)), splitters, last).strings(answers), last))
        return pa.concat_tables(out)

    def end(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = [finish(b := Block(from_blob(blob)), _Steps(b, splitters, last).covered(answers)) for blob in own["blob"].to_pylist()]
        return pa.concat_tables(out) if out else pa.table({})

    ab = a.unionByName(b)
    c = materialize(_answer(meet(ab, third, ASKED), 3, ("<u8", "<u8", "<u8", "<i8", "<i8"), _judge_strings), "strings")
    result = materialize(meet(ab.unionByName(c), end, schema), "kept")
    discard(a, b, c)
    return result


def repeat_digest(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""

    def finish(block: Block, gone: np.ndarray) -> pa.Table:
        removed, spans, digest = [], [], []
        for start, text in zip(block.starts.tolist(), block.texts):
            mask = gone[start : start + len(text)]
            n = int(mask.sum())
            removed.append(n)
            spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0]) if n else 0)
            digest.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text).hexdigest())
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return _solve(docs.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes)


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same rows and columns without the repeated bytes in text (a character that loses some
    of its bytes goes); null texts stay null."""

    def finish(block: Block, gone: np.ndarray) -> pa.Table:
        old, new = block.table["text"].to_pylist(), []
        for start, text, was in zip(block.starts.tolist(), block.texts, old):
            mask = gone[start : start + len(text)]
            new.append(was if not mask.any() else np.frombuffer(text, np.uint8)[~mask].tobytes().decode("utf-8", "ignore"))
        at = block.table.schema.get_field_index("text")
        return block.table.set_column(at, block.table.schema.field(at), pa.array(new, block.table.schema.field(at).type))

    return _solve(docs, finish, docs.schema, block_bytes)
