"""Language-model scores from a weighted backoff automaton.

Model: trigrams, bigrams and add-one unigrams, each smoothed by the next shorter one (a Dirichlet prior of M tokens).
P1(w) = (c(w) + 1) / (N + V + 1); P(w | h) = (c(h w) + M P(w | h')) / (c(h) + M), where h' is h without its first word and M
is ``MASS`` of the order: a word that followed one word may do so by chance, one that followed two words hardly. A text begins after two start marks. Every context of one or two words seen in training is a state; the n-grams seen after
it are its arcs; its failure arc leads to the state of its shorter context with weight M / (c(h) + M), and the root has
an arc for every word. A text is scored by one traversal from left to right that carries the state: it fails, arc by arc,
until a state has an arc for the token, adds the log10 weights and goes on in the longest state seen.

Scale: the texts of a partition are dealt into blocks of bounded size and stored once, compressed. A block sends its distinct
n-grams, as sorted hashes with local counts, to hash ranges; a range adds up what all blocks sent and answers each
block with totals in the order of its own list. A block then holds the part of the automaton that its texts can reach,
whatever the corpus and its vocabulary grow to; very frequent n-grams are one entry per block. The number of ranges grows with the
input, so a range holds a bounded number of keys. Words are compared by 63-bit hashes, pairs and triples by hashes ``SPARE_BITS`` bits
wider than their number needs: one in 16 million unseen ones is taken for a seen one.

Defined results: a null or empty text is its end token alone. Rows that repeat an id are texts of their own. A null id counts
as the empty text for the hold-out. Extra columns are ignored. An empty table gives no rows. Without training texts every
probability of a known or unknown token is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import bounds, pack, pack_sorted, stored, unpack, unpack_sorted
from creditloom.llm.forest import word_hashes

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20  # of texts for each hash range
TOKEN_BYTES, SPARE_BITS = 8, 24
START = np.uint64(0x1F83D9ABFB41BD6B)  # hash of the context before a text
END_WORD = b" \xff "  # the end token is written as a byte that no UTF-8 text holds
WORD, PAIR, TRIPLE = 0, 1, 2
MASS = {PAIR: 1000.0, TRIPLE: 4.0}
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_KEY, _MARK = np.uint64(2**64 - 2), np.uint64(1)  # the lowest bit of a hash is left free for a mark
_END = word_hashes(END_WORD)[0] & _KEY


def key_bits(n_bytes: int) -> int:
    """The width of the hashes of pairs and triples in texts of so many bytes."""
    return min(63, SPARE_BITS + (n_bytes // TOKEN_BYTES).bit_length())


def _extended(context: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of contexts followed by a token; only the upper ``bits`` bits are used."""
    h = (context ^ (context >> np.uint64(29))) * _MIX[0] + tokens
    return ((h ^ (h >> np.uint64(32))) * _MIX[1]) & np.uint64(2**64 - 2 ** (64 - bits))


class Block:
    """The tokens of a block's texts and, for each token, the hashes of the n-grams that end there, by order."""

    def __init__(self, texts: list[bytes], bits: int = 63):
        tokens = word_hashes(END_WORD.join([*texts, b""])) & _KEY
        self.ends = np.flatnonzero(tokens == _END) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.sizes = self.ends - self.starts
        self.grams = [tokens]
        for _ in (PAIR, TRIPLE):
            before = np.empty_like(tokens)
            before[1:] = self.grams[-1][:-1]
            before[self.starts] = START
            self.grams.append(_extended(before, tokens, bits))

    def counts(self, training: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order the distinct n-grams, sorted, and how often they stand in training texts."""
        learnt = np.repeat(training, self.sizes).astype(np.uint64)
        for order, grams in enumerate(self.grams):
            marked = np.sort(grams | learnt)
            keys = marked & _KEY
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield order, keys[first], np.add.reduceat(marked & _MARK, first)


class Automaton:
    """States, arcs and failure arcs that the texts of one block can reach.

    A state is a context of two, one or no words; n-grams are named by their numbers in the block. ``arcs[order]`` has the weight of an
    n-gram as an arc of its context, ``NO_ARC`` if it was not seen; ``fails[order]`` the weight of the failure arc of the context, by the
    n-gram that equals it, the last entry for the start marks. ``reached`` is the order of the longest state that a pair leads to.
    """

    NO_ARC = 1.0  # no logarithm of a probability

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, n_texts: int):
        self.numbers = numbers = [np.unique(grams, return_inverse=True)[1] for grams in block.grams]
        begins = np.zeros(len(numbers[WORD]), bool)
        begins[block.starts] = True
        self.known = totals[WORD] > 0
        self.root = np.log10((totals[WORD] + 1.0) / (n + v + 1.0))
        self.arcs, self.fails = [self.root], [np.zeros(1)]
        lower, word = 10 ** self.root, numbers[WORD]
        shorter = word  # of each token, the number of the n-gram without its first word
        for order in (PAIR, TRIPLE):
            place = np.empty(len(totals[order]), np.int64)
            place[numbers[order]] = np.arange(len(word))  # any place of each n-gram
            seen = np.append(totals[order - 1], np.uint64(n_texts)).astype(float)  # of each context
            context = np.where(begins[place], -1, numbers[order - 1][place - 1])
            weight = (totals[order] + MASS[order] * lower[shorter[place]]) / (seen[context] + MASS[order])
            self.arcs.append(np.where(totals[order] > 0, np.log10(weight), self.NO_ARC))
            self.fails.append(np.log10(MASS[order] / (seen + MASS[order])))
            lower, shorter = weight, numbers[order]
            if order == PAIR:
                self.reached = np.where(totals[PAIR] > 0, 2, np.where(self.known[word[place]], 1, 0))

    def score(self, begin: int, end: int) -> float:
        """The log10 probability of the tokens of a text. What each token may meet is looked up at once; the state is carried."""
        words, pairs, triples = (numbers[begin:end] for numbers in self.numbers)
        before = [np.concatenate([[-1], numbers[:-1]]) for numbers in (words, pairs)]
        total, order = 0.0, 2
        for root, arc1, arc2, fail1, fail2, reached in zip(
                self.arcs[WORD][words].tolist(), self.arcs[PAIR][pairs].tolist(), self.arcs[TRIPLE][triples].tolist(),
                self.fails[PAIR][before[0]].tolist(), self.fails[TRIPLE][before[1]].tolist(), self.reached[pairs].tolist(), strict=True):
            if order == 2:
                if arc2 <= 0:
                    total += arc2
                    order = reached
                    continue
                total += fail2
                order = 1
            if order == 1:
                if arc1 <= 0:
                    total += arc1
                    order = reached
                    continue
                total += fail1
            total += root
            order = reached
        return total


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score`` for every row; the last is the score per token."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    kind = dict(rows.dtypes)["id"]
    block_bytes = BLOCK_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's texts as blocks, each compressed as a whole."""
        number = TaskContext.get().partitionId() << 33
        held_back: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            part = pa.Table.from_batches(held_back).combine_chunks()
            texts = [t.as_buffer().to_pybytes() for t in part["text"]]
            flags = part["held_out"].combine_chunks()
            whole = pa.array([0, len(texts)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([flags.false_count], pa.int64()),
                pa.ListArray.from_arrays(whole, part["id"].combine_chunks()), pa.ListArray.from_arrays(whole, flags),
                pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())],
                names=["block", "bytes", "n_training", "ids", "held_out", "sizes", "packed"])

        for batch in batches:
            lengths = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
            begin = 0
            for i, length in enumerate(lengths.tolist()):
                size += length
                if size >= block_bytes:
                    held_back.append(batch.slice(begin, i + 1 - begin))
                    yield block()
                    held_back, begin, size, number = [], i + 1, 0, number + 1
            if begin < batch.num_rows:
                held_back.append(batch.slice(begin))
        if held_back:
            yield block()

    blocks = stored(rows.select("id", held.alias("held_out"), "text").mapInArrow(
        deal, f"block long, bytes long, n_training long, ids array<{kind}>, held_out array<boolean>, sizes array<long>, packed binary"), "lm-blocks")
    measured = blocks.agg(F.sum("bytes").alias("bytes"), F.sum("n_training").alias("n_texts")).collect()[0]
    n_texts = measured["n_texts"] or 0
    bits = key_bits(measured["bytes"] or 0)
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(measured["bytes"] or 0) // RANGE_BYTES))

    def block_of(packed: pa.Scalar, sizes: list[int]) -> Block:
        whole, at, texts = zstandard.decompress(packed.as_buffer()), 0, []
        for size in sizes:
            texts.append(whole[at:at + size])
            at += size
        return Block(texts, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, block = batch["block"][i].as_py(), block_of(batch["packed"][i], batch["sizes"][i].as_py())
                for order, keys, counts in block.counts(~batch["held_out"][i].values.to_numpy(zero_copy_only=False)):
                    at = bounds(keys, ranges)
                    keys = keys >> np.uint64(64 - bits if order else 0)  # whole bytes compress better
                    filled = [r for r in range(ranges) if at[r] < at[r + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([order] * len(filled), pa.int64()), pa.array(filled, pa.int64()), pa.array([number] * len(filled), pa.int64()),
                        pa.array([pack_sorted(keys[at[r]:at[r + 1]]) for r in filled], pa.binary()),
                        pa.array([pack(counts[at[r]:at[r + 1]]) for r in filled], pa.binary())],
                        names=["kind", "range", "block", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        kind, r = table["kind"][0].as_py(), table["range"][0].as_py()
        lists = [unpack_sorted(b.as_py()) for b in table["keys"]]
        counts = np.concatenate([unpack(b.as_py()) for b in table["counts"]])
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(at, counts, len(keys)).astype(np.uint64)
        parts = np.split(totals[at], np.cumsum([len(x) for x in lists])[:-1])
        blocks = table["block"].to_pylist()
        answers = [(b, kind, r, pack(t), None, None) for b, t in zip(blocks, parts, strict=True)]
        if kind == WORD:  # what a range knows of N and V
            answers.append((-1, kind, r, None, int(totals.sum()), int((totals > 0).sum())))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("block", "kind", "range", "totals", "n", "v"), zip(*answers, strict=True),
            (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)})

    lists = blocks.select("block", "held_out", "sizes", "packed").mapInArrow(send, "kind long, range long, block long, keys binary, counts binary")
    answers = stored(
        lists.groupBy("kind", "range").applyInArrow(add, "block long, kind long, range long, totals binary, n long, v long"), "lm-totals")
    known = answers.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()[0]
    n, v = known["n"] or 0, known["v"] or 0

    def traverse(own: pa.Table, totals: pa.Table) -> pa.Table:
        block = block_of(own["packed"][0], own["sizes"][0].as_py())
        parts: list[list[np.ndarray]] = [[], [], []]
        totals = totals.sort_by([("kind", "ascending"), ("range", "ascending")])
        for kind, blob in zip(totals["kind"].to_pylist(), totals["totals"], strict=True):
            parts[kind].append(unpack(blob.as_py()))
        model = Automaton(block, [np.concatenate(p) for p in parts], n, v, n_texts)
        words = model.numbers[WORD]
        scores = np.array([model.score(a, b) for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True)])
        return pa.table({
            id_col: own["ids"][0].values, "held_out": own["held_out"][0].values, "n_tokens": pa.array(block.sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat(model.known[words], block.starts, dtype=np.int64)),
            "train_tokens": pa.array([n] * len(block.sizes), pa.int64()), "base_score": pa.array(np.add.reduceat(model.root[words], block.starts)),
            "score": pa.array(scores), "mean_score": pa.array(scores / block.sizes)})

    sent = answers.where("block >= 0").select("block", "kind", "range", "totals")
    return blocks.select("block", "ids", "held_out", "sizes", "packed").groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(
        traverse, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double")
