"""Language-model scoring with a weighted backoff automaton.

Model: n-grams of words up to `order`, smoothed with a Dirichlet prior on the next lower order,
P(w | c) = (n(c w) + MU * P(w | shorter c)) / (n(c) + MU); single words have
P(w) = (n(w) + 1) / (N + V + 1). As an automaton: a state per context seen in training, an arc per
n-gram seen (weight log10 P, to the longest context that ends with its word), and a failure arc from
each state to that of the next shorter context (weight log10 MU / (n(c) + MU)). A text is scored in
one pass from left to right that carries the state: the arc of the next word if there is one, else
failure arcs until there is; the empty context has an arc for every word. All texts of a block move
in lockstep, long ones in stretches of STRETCH tokens: the order - 1 tokens before a stretch lead to
the state in which the whole text would enter it.

How it is spread out: documents are packed into blocks of about BLOCK_BYTES, stored once. A block
sorts the hashes of its single words and pairs, each once, and sends them, with their training
counts, in runs to the owners of hash ranges; an owner adds up and answers every block with the
totals of what it sent, in the order sent. For longer n-grams a block knows most totals by itself:
where one of the two shorter n-grams in it occurs in this block alone, so does the longer one; it
asks for the others. Those are the arcs and states that the block's texts can meet, so the block can
build its part of the automaton and score. Nothing is capped, no n-gram is dropped, nothing but N, V
and the number of training texts comes to the driver; an n-gram crosses the network once per block
that holds it, however frequent it is.

Defined cases: a null or empty text is its end token alone; a null id counts as the empty string
when held-out texts are chosen; repeated rows are texts of their own; without training texts every
word has P = 1 / (V + 1) with N = V = 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.blocks import from_blob, store_blocks
from loomwork.llm.common import discard, keep_id, materialize, mix64, released
from loomwork.llm.ngram_hash import word_hashes

ORDER = 3
MU = 20.0
BLOCK_BYTES = 8 << 20
#: Tokens that one lane of the lockstep pass scores.
STRETCH = 256
#: Bytes of text hashed at a time.
SLICE_BYTES = 1 << 20
#: Hashes that stand for the end token and the context before the first word.
END, START = np.uint64(0xE17A1465F0C5E2B3), np.uint64(0x5A0B7F3C29D481E7)


class Block:
    """The texts of a block as n-grams: for each order k the hash of the k-gram that ends at each
    token, and which texts are for training. Tokens of all texts stand in one array."""

    def __init__(self, texts: list[str | None], training: np.ndarray, order: int):
        self.order, self.training = order, training
        hashes, counts, at = [], [], 0
        encoded = [(t or "").encode() for t in texts]
        while at < len(encoded):
            stop, size = at, 0
            while stop < len(encoded) and (stop == at or size + len(encoded[stop]) <= SLICE_BYTES):
                size += len(encoded[stop])
                stop += 1
            h, n = word_hashes(encoded[at:stop])
            hashes.append(h)
            counts.append(n)
            at = stop
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.n_tokens = n + 1
        self.ends = np.cumsum(self.n_tokens) - 1
        tokens = np.empty(len(words) + len(n), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[self.ends] = True
        tokens[is_end], tokens[~is_end] = END, words
        self.text_of = np.repeat(np.arange(len(n), dtype=np.int32), self.n_tokens)
        self.place = (np.arange(len(tokens)) - np.repeat(self.ends + 1 - self.n_tokens, self.n_tokens)).astype(np.int32)
        #: grams[k]: the (k + 1)-grams' hashes; contexts reach back to START at most
        self.grams = [mix64(tokens)]
        context = mix64(np.where(self.place > 0, np.roll(tokens, 1), START))
        for k in range(1, order):
            self.grams.append(mix64(context * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(k)))
            context = np.where(self.place > 0, np.roll(self.grams[k], 1), context)

        #: for each order: distinct hashes in order, each token's place among them, training counts
        self.keys, self.places, self.local = [], [], []
        for g in self.grams:
            keys, inverse = np.unique(g, return_inverse=True)
            self.keys.append(keys)
            self.places.append(inverse.astype(np.int32))
            self.local.append(np.bincount(inverse, self.training[self.text_of], len(keys)).astype(np.int64))
        del self.grams

    def asked(self, k: int, shared: list[np.ndarray]) -> np.ndarray:
        """Which distinct (k + 1)-grams have to be asked for, given which shorter ones other blocks
        hold too: those of which both shorter n-grams are shared."""
        if k < 2:
            return np.ones(len(self.keys[k]), bool)
        wide = shared[k - 1][self.places[k - 1]]
        both = wide & np.roll(wide, 1) & (self.place >= k - 1)
        out = np.zeros(len(self.keys[k]), bool)
        out[self.places[k][both]] = True
        return out


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges of hashes, so runs of sorted hashes go to them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted hashes of one owner as differences of six bytes; the few larger gaps are spelled out."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = np.flatnonzero(gaps >> np.uint64(48))
    head = np.array([len(wide), len(keys)], "<u4").tobytes() + wide.astype("<u4").tobytes() + gaps[wide].astype("<u8").tobytes()
    return head + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n_wide, n = np.frombuffer(data, "<u4", 2)
    wide = np.frombuffer(data, "<u4", n_wide, 8)
    at = 8 + 4 * int(n_wide)
    values = np.frombuffer(data, np.uint8, -1, at)[: 8 * int(n_wide)].copy().view("<u8")
    body = np.frombuffer(data, np.uint8, 6 * int(n), at + 8 * int(n_wide)).reshape(-1, 6)
    gaps = np.zeros((int(n), 8), np.uint8)
    gaps[:, :6] = body
    gaps = gaps.reshape(-1).view("<u8").astype(np.uint64)
    gaps[wide] = values
    return np.cumsum(gaps, dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Most counts are small: a byte each, and the large ones in full."""
    large = np.flatnonzero(counts >= 255)
    small = np.minimum(counts, 255).astype(np.uint8)
    return np.array([len(large)], "<u4").tobytes() + counts[large].astype("<u8").tobytes() + small.tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    counts = np.frombuffer(data, np.uint8, -1, 4 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[4 : 4 + 8 * n], "<u8")
    return counts


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


class Automaton:
    """The part of the automaton that a block's texts can meet. State 0 is the empty context, state
    1 the beginning of a text; the others are the n-grams shorter than the order, level by level."""

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, texts: int, mu: float):
        order, places = block.order, block.places
        first = [np.zeros(len(t), np.int64) for t in totals]
        for k in range(order):
            first[k][places[k]] = np.arange(len(places[k]))
        sizes = [len(t) for t in totals]
        offset = np.cumsum([2, *sizes[: order - 1]])
        self.offset = offset
        self.words = places[0]
        self.n_words = sizes[0]
        #: single words: weight from the empty context, and the state they lead to
        self.weight = np.log10((totals[0] + 1) / float(n + v + 1))
        some = (totals[0] > 0) & (order > 1)
        self.next = np.where(some, offset[0] + np.arange(self.n_words), 0)
        self.fail = np.zeros(int(offset[-1]), np.int64)
        count = np.zeros(int(offset[-1]), np.int64)
        count[1] = texts
        for k in range(order - 1):
            states = offset[k] + np.arange(sizes[k])
            count[states] = totals[k]
            if k:
                self.fail[states] = offset[k - 1] + places[k - 1][first[k]]
        self.fail_weight = np.zeros(len(count))
        seen = count > 0
        self.fail_weight[seen] = np.log10(mu / (count[seen] + mu))
        keys, weights, nexts, lower = [], [], [], self.weight
        for k in range(1, order):
            at = first[k]
            valid = block.place[at] >= k - 1
            start = valid & (block.place[at] == 0)
            source = np.where(start, 1, offset[k - 1] + places[k - 1][at - 1])
            back = count[source]
            p = totals[k] / (back + mu) + mu / (back + mu) * 10 ** lower[places[k - 1][at]]
            lower = np.log10(np.maximum(p, 1e-300))
            arc = np.flatnonzero(valid & (totals[k] > 0))
            keys.append(source[arc] * self.n_words + places[0][at[arc]])
            weights.append(lower[arc])
            level = min(k, order - 2)
            nexts.append(offset[level] + places[level][at[arc]])
        self.arcs = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by = np.argsort(self.arcs, kind="stable")
        self.arcs = self.arcs[by]
        self.arc_weight = (np.concatenate(weights) if weights else np.zeros(0))[by]
        self.arc_next = (np.concatenate(nexts) if nexts else np.zeros(0, np.int64))[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each state: the states reached and the weights collected."""
        state, weight, to = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        live = np.arange(len(state))
        while len(live):
            empty = state[live] == 0
            done = live[empty]
            weight[done] += self.weight[word[done]]
            to[done] = self.next[word[done]]
            live = live[~empty]
            if not len(live):
                break
            key = state[live] * self.n_words + word[live]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(key), np.int64)
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
            weight[live[hit]] += self.arc_weight[at[hit]]
            to[live[hit]] = self.arc_next[at[hit]]
            live = live[~hit]
            weight[live] += self.fail_weight[state[live]]
            state[live] = self.fail[state[live]]
        return to, weight

    def score(self, block: Block, stretch: int = STRETCH) -> np.ndarray:
        """log10 P of each text, in one pass from left to right."""
        begin = block.ends + 1 - block.n_tokens
        pieces = -(-block.n_tokens // stretch)
        text = np.repeat(np.arange(len(begin)), pieces)
        index = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[text] + index * stretch
        stop = np.minimum(start + stretch, block.ends[text] + 1)
        warm = np.where(index > 0, np.minimum(block.order - 1, start - begin[text]), 0)
        at, total = start - warm, np.zeros(len(text))
        state = np.where(at == begin[text], int(block.order > 1), 0)
        order = np.argsort(-(stop - at), kind="stable")
        at, stop, start, state, text = at[order], stop[order], start[order], state[order], text[order]
        while len(at):
            state, weight = self.step(state, self.words[at])
            total[: len(at)] += np.where(at >= start[: len(at)], weight, 0.0)
            at = at + 1
            live = int((at < stop[: len(at)]).sum())  # the longest come first
            at, state = at[:live], state[:live]
        return np.bincount(text, total, len(begin)) if len(text) else np.zeros(len(begin))


ASKED = "owner int, block long, k int, keys binary, counts binary, tokens long, texts long"
ANSWERED = "block long, k int, owner int, counts binary, shared binary, tokens long, texts long, distinct long"


def _ask(number: int, block: Block, levels: list[int], shared: list[np.ndarray], owners: int, report: bool) -> pa.Table:
    rows: list[tuple] = []
    for k in levels:
        chosen = block.asked(k, shared)
        keys, counts = block.keys[k][chosen], block.local[k][chosen]
        cut = np.searchsorted(_owner(keys, owners), np.arange(owners + 1))
        rows += [(o, k, _pack(keys[a:b]), _pack_counts(counts[a:b]), 0, 0) for o, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
    if report:
        rows.append((0, -1, b"", b"", int(block.n_tokens[block.training].sum()), int(block.training.sum())))
    kinds = {"owner": pa.int32(), "k": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "tokens": pa.int64(), "texts": pa.int64()}
    columns = {c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())}
    columns["block"] = pa.array([number] * len(rows), pa.int64())
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in ASKED.split(", ")})


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """The owner of a range adds up what blocks sent, and tells each the totals and which of its
    n-grams other blocks sent too."""
    k = table["k"].to_pylist()
    counts, shared = [b""] * len(k), [b""] * len(k)
    distinct = [0] * len(k)
    for level in set(k) - {-1}:
        rows = [i for i, x in enumerate(k) if x == level]
        asked = [_unpack(table["keys"][i].as_py()) for i in rows]
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_unpack_counts(table["counts"][i].as_py()) for i in rows]), len(keys)).astype(np.int64)
        several, stops = np.bincount(inverse, minlength=len(keys)) > 1, np.cumsum([len(a) for a in asked])[:-1]
        for i, x, y in zip(rows, np.split(total[inverse], stops), np.split(several[inverse], stops)):
            counts[i], shared[i] = _pack_counts(x), np.packbits(y).tobytes()
        if level == 0:
            distinct[rows[0]] = int((total > 0).sum())
    return pa.table({"block": table["block"], "k": table["k"], "owner": table["owner"], "counts": pa.array(counts, pa.binary()), "shared": pa.array(shared, pa.binary()), "tokens": table["tokens"], "texts": table["texts"], "distinct": pa.array(distinct, pa.int64())})


def _totals(block: Block, told: pa.Table, upto: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The training counts of all distinct n-grams of a block, what the owners told and what it
    knows by itself, and which of the n-grams other blocks hold too."""
    told = told.sort_by([("k", "ascending"), ("owner", "ascending")])
    level, totals, shared = told["k"].to_numpy(), [], []
    for k in range(upto):
        total, several, chosen = block.local[k].copy(), np.zeros(len(block.keys[k]), bool), block.asked(k, shared)
        counts, bits = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for i in np.flatnonzero(level == k):
            counts.append(_unpack_counts(told["counts"][int(i)].as_py()))
            bits.append(np.unpackbits(np.frombuffer(told["shared"][int(i)].as_py(), np.uint8), count=len(counts[-1])).astype(bool))
        total[chosen], several[chosen] = np.concatenate(counts), np.concatenate(bits)
        totals.append(total)
        shared.append(several)
    return totals, shared


def _block_of(blob: bytes, order: int) -> tuple[pa.Table, Block]:
    table = from_blob(blob)
    return table, Block(table["text"].to_pylist(), ~table["held_out"].to_numpy(), order)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double"


def score_texts(docs: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token) for
    every row."""
    spark = docs.sparkSession
    source = keep_id(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    stored, name = store_blocks(source, block_bytes)
    blocks = stored.select("block", "blob")
    owners = max(1, blocks.count())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _ask(number, _block_of(blob, order)[1], list(range(min(2, order))), [], owners, True).to_batches()

    def later(k: int):
        def run(own: pa.Table, told: pa.Table) -> pa.Table:
            out = [_ask(-1, Block([], np.zeros(0, bool), order), [], [], 1, False)]
            for number, blob in zip(own["block"].to_pylist(), own["blob"].to_pylist()):
                block = _block_of(blob, order)[1]
                out.append(_ask(number, block, [k], _totals(block, told, k)[1], owners, False))
            return pa.concat_tables(out)

        return run

    def ask_owners(asked: DataFrame) -> DataFrame:
        return materialize(asked.groupBy("owner").applyInArrow(released(_answer), ANSWERED), "ngrams")

    def meet(told: DataFrame, f, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(told.where("k >= 0").select("block", "k", "owner", "counts", "shared").groupBy("block")).applyInArrow(released(f), schema)

    try:
        answers = [ask_owners(blocks.mapInArrow(released(first), ASKED))]
        n, texts, v = (x or 0 for x in answers[0].agg(F.sum("tokens"), F.sum("texts"), F.sum("distinct")).first())
        told = answers[0]
        for k in range(2, order):
            answers.append(ask_owners(meet(told, later(k), ASKED)))
            told = told.unionByName(answers[-1])

        def score(own: pa.Table, told: pa.Table) -> pa.Table:
            out = []
            for blob in own["blob"].to_pylist():
                table, block = _block_of(blob, order)
                totals = _totals(block, told, order)[0]
                block.keys = block.local = None  # no longer needed, and large
                model = Automaton(block, totals, n, v, texts, mu)
                scored = model.score(block)
                per_text = lambda x: np.bincount(block.text_of, x, len(table))  # noqa: B023, E731
                base, known = per_text(model.weight[block.places[0]]), per_text(totals[0][block.places[0]] > 0)
                out.append([table["doc_id"], table["held_out"], block.n_tokens, known.astype(np.int64), np.full(len(table), n, np.int64), base, scored, scored / block.n_tokens])
            names = [c.split()[0] for c in RESULT.split(", ")]
            return pa.concat_tables([pa.table(dict(zip(names, columns))) for columns in out]) if out else pa.table({})

        result = materialize(meet(told, score, RESULT), "scores")
        discard(*answers)
        return result
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
