"""A hierarchical Pitman-Yor language model of words in the context of the word before.

Every context is a restaurant whose dishes are the words that follow it; all of them share one parent, the restaurant of
single words, whose own parent is uniform over the training types and one unknown word.  A context with c customers eating
a word at t tables, out of C customers and T tables, predicts

    P(word | context) = (c - d t + (theta + d T) P(word)) / (theta + C),

the parent likewise from its customers, which are the tables of all contexts.  Tables are latent: Gibbs sampling takes all
customers of a word off their tables and seats them again in proportion to the tables of the other words, ``BURN`` sweeps
without and ``SAMPLES`` with taking the tables down.  A text's score averages the predictions of the samples, each with the parent's
tables that it gave.  Words eaten once in a context sit at one table for certain and need no sampling.

*Work is dealt by context* into parts of about ``PART_TOKENS`` words, so that a restaurant's customers and tables are at
hand, and words are dealt to owners, which seat the parent.  A chunk of texts sends its distinct pairs to a part once, with
how often they occur in training texts and the texts they occur in; from there on parts and owners exchange sums per word
only.  Contexts that take more than a quarter of a part (found on a sample of the texts, which decides the dealing only) are
split over several parts by word; their totals go through the owners too.  A very common pair costs one entry per chunk
and text that has it.

*Approximations of the sampler.*  The words of a restaurant are seated side by side against its tables of the sweep before; a
part that holds a share of a split context extrapolates its tables to the whole, owners extrapolate the parent's in the
same way; and the parent's prediction is that of the exchange before.
Predictions use exact totals, so they add up to 1 over the training types and one unknown word.

Discounts are estimated from the numbers of pairs and words that occur once and twice.  Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.llm import pieces, shingles
from routeyard.llm.common import register, steps, table, utf8

BURN, SAMPLES = 2, 3
DRAWN = 1 << 20                             # chances held at a time
STRENGTH = 0.5                              # theta of the contexts; of the parent as well
PART_TOKENS, CHUNK_BYTES, WORD_BYTES = 1 << 22, 1 << 24, 6
HOT_SHARE, HOT_SAMPLE = 0.25, 16
#: Sums of logarithms travel as whole numbers of these units, a billionth and a ten-millionth about.
BASE_UNIT, MODEL_UNIT = 2.0 ** -30, 2.0 ** -24
#: Stand for the end of a text and for the context of its first word.
END, START = np.uint64(0x9D8E4E5C0D1F3A67), np.uint64(0x51B2C96E8A03F4D9)
OWNER = np.uint64(0x3C6EF372FE94F82B)

PAIRS = ("part int, chunk long, ids array<bigint>, sizes binary, contexts binary, words binary, per_word binary, "
         "context_of binary, trained binary, per_pair binary, docs binary, times binary")
SENT = "owner int, part int, words binary, counts binary, hot binary, hot_counts binary, once long, twice long"
REPLY = "part int, owner int, counts binary, hot_counts binary, header binary"
PARTIAL = "chunk long, ids array<bigint>, sizes binary, train_tokens long, docs binary, known binary, base binary, model binary"


@functools.cache
def codec():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, first bytes first, compressed."""
    top = int(a.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + codec()[0].compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(codec()[1].decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)


def packed_hashes(a: np.ndarray) -> bytes:
    """Hashes, mostly rising: their differences lack the first bits."""
    return packed(np.diff(a, prepend=np.uint64(0)))


def hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw).astype(np.uint64), dtype=np.uint64)


def stacked(arrays: list[np.ndarray]) -> bytes:
    """Several equally long arrays of whole numbers."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in map(packed, arrays))


def unstacked(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at:at + 8], "little")
        out.append(unpacked(raw[at + 8:at + 8 + size]))
        at += 8 + size
    return out


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end behind every text, and the tokens of every text; hashed in small steps."""
    tokens, sizes = [], []
    for part in steps(batch):
        words, first = shingles.word_hashes(*utf8(part.column("text")), shingles.NOT_BLANK)
        tokens.append(np.insert(words, first[1:], END))
        sizes.append(np.diff(first) + 1)
    return np.concatenate(tokens), np.concatenate(sizes)


def hot_contexts(docs: DataFrame, parts: int) -> dict[int, int]:
    """Words that take more than a share of a part, with the parts to split their context over.

    A sampled text reports words that make at least half that share of a step, so at most 2 / share of them; so many can
    stay in the end as well.
    """
    share = HOT_SHARE / parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                tokens, _ = tokens_of(part)
                words, n = np.unique(tokens, return_counts=True)
                often = n >= share / 2 * len(tokens)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(np.append(words[often], START).view(np.int64)),
                    "n": pa.array(np.append(n[often], part.num_rows), pa.int64()),
                    "all": pa.array(np.append(np.zeros(int(often.sum()), np.int64), len(tokens)))})

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "word long, n long, all long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = counts.agg(F.sum("all")).first()[0] or 0
    found = counts.filter(F.col("n") >= share * total).select("word", "n").collect() if total and parts > 1 else []
    return {r["word"] & (1 << 64) - 1: min(parts, int(np.ceil(r["n"] / (share * total)))) for r in found}


def part_of(contexts: np.ndarray, words: np.ndarray, parts: int, hot: dict[int, int]) -> np.ndarray:
    at = pieces.mix(contexts + OWNER) % np.uint64(parts)
    if hot:
        keys = np.array(sorted(hot), np.uint64)
        splits = np.array([hot[k] for k in keys.tolist()], np.uint64)
        place = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
        split = np.flatnonzero(keys[place] == contexts)
        at[split] = (at[split] + pieces.mix(words[split]) % splits[place[split]]) % np.uint64(parts)
    return at.astype(np.int64)


def chunk_pairs(batch: pa.RecordBatch, held: np.ndarray, parts: int, hot: dict[int, int]) -> tuple[np.ndarray, list[tuple]]:
    """Tokens per text and, per part with any, the distinct pairs of a chunk of texts (the columns of ``PAIRS``)."""
    tokens, sizes = tokens_of(batch)
    begins = np.cumsum(sizes) - sizes
    names, word = np.unique(tokens, return_inverse=True)
    word = word.astype(np.int32)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[begins] = len(names)                            # the start stands behind all words
    names = np.append(names, START)
    n = len(names)
    key = part_of(names[context], tokens, parts, hot)
    del tokens
    key *= n * n
    key += word * np.int64(n) + context
    del word, context
    order = np.argsort(key, kind="stable")                  # texts stay in order inside a pair
    key = key[order]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    del order
    fresh = np.diff(key, prepend=-1) != 0
    entry = np.flatnonzero(fresh | (np.diff(doc, prepend=np.int32(-1)) != 0))     # a pair in a text
    times = np.diff(entry, append=len(key))
    pair = np.flatnonzero(fresh[entry])
    per_pair = np.diff(pair, append=len(entry))
    doc, key = doc[entry], key[entry[pair]]
    del fresh, entry
    trained = np.add.reduceat(np.where(held[doc], 0, times), pair)
    context, word, part = key % n, key // n % n, key // n // n
    out = []
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
        low = int(pair[a])
        high = int(pair[b]) if b < len(pair) else len(doc)
        contexts, context_of = np.unique(context[a:b], return_inverse=True)
        first = np.flatnonzero(np.diff(word[a:b], prepend=-1))
        out.append((int(part[a]), packed_hashes(names[contexts]), packed_hashes(names[word[a:b][first]]),
                    packed(np.diff(first, append=b - a)), packed(context_of), packed(trained[a:b]), packed(per_pair[a:b]),
                    packed(doc[low:high]), packed(times[low:high])))
    return sizes, out


class Part:
    """All pairs of a part: places of their context and word, and their customers."""

    def __init__(self, rows: pa.Table, parts: int, hot: dict[int, int]):
        listed = rows.to_pylist()
        self.rows = [r for r in listed if r["words"] is not None]
        self.lists = [r for r in listed if r["words"] is None]
        named = [(hashes(r["contexts"]), hashes(r["words"])) for r in self.rows]
        self.contexts, self.words = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in named)])) for i in (0, 1))
        keys, trained = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, (contexts, words) in zip(self.rows, named):
            context = np.searchsorted(self.contexts, contexts)[unpacked(r["context_of"])]
            word = np.repeat(np.searchsorted(self.words, words), unpacked(r["per_word"]))
            keys.append(context * len(self.words) + word)
            trained.append(unpacked(r["trained"]))
        self.sizes = [len(k) for k in keys[1:]]
        key, self.pair_of = np.unique(np.concatenate(keys), return_inverse=True)
        self.customers = np.bincount(self.pair_of, np.concatenate(trained), minlength=len(key)).astype(np.int64)
        self.pair_of = self.pair_of.astype(np.int32)
        self.context, self.word = ((f(key, max(1, len(self.words)))).astype(np.int32) for f in (np.floor_divide, np.remainder))
        self.split = np.isin(self.contexts, np.array(sorted(hot), np.uint64))
        self.hot = self.contexts[self.split]

    def sums(self, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of, values, minlength=n).astype(np.int64)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return self.sums(self.word, values, len(self.words))

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return self.sums(self.context, values, len(self.contexts))

    def dealt(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of words and of split contexts by owner, and where each owner's begin."""
        of = [(pieces.mix(x ^ OWNER) % np.uint64(owners)).astype(np.int64) for x in (self.words, self.hot)]
        order = [np.argsort(x, kind="stable") for x in of]
        return order[0], np.searchsorted(of[0][order[0]], np.arange(owners + 1)), order[1], np.searchsorted(
            of[1][order[1]], np.arange(owners + 1))

    def messages(self, part: int, owners: int, word_values: list, hot_values: list, pairs: tuple | None = None) -> pa.Table:
        """Sums per word and per split context, a row for every owner (the columns of ``SENT``).

        The announcement, which tells how many pairs occur once and twice, names the words; later messages keep their order.
        """
        order, cut, hot_order, hot_cut = self.dealt(owners)
        rows = []
        for o in range(owners):
            mine, hot = order[cut[o]:cut[o + 1]], hot_order[hot_cut[o]:hot_cut[o + 1]]
            named = (packed_hashes(self.words[mine]), packed_hashes(self.hot[hot])) if pairs else (None, None)
            once, twice = pairs if pairs and o == part % owners else (0, 0)     # counts of the part itself go to one owner
            rows.append((o, part, named[0], stacked([v[mine] for v in word_values]), named[1],
                         stacked([v[hot] for v in hot_values]), once, twice))
        return as_table(rows, SENT)

    def replies(self, replies: pa.Table, owners: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Totals per word, totals per split context, and the sum of the owners' headers."""
        order, cut, hot_order, hot_cut = self.dealt(owners)
        by = {r["owner"]: r for r in replies.to_pylist()}
        if len(by) != owners:
            raise ValueError("a part needs the replies of all owners")

        def joined(column: str, order: np.ndarray) -> list[np.ndarray]:
            pieces_ = [unstacked(by[o][column]) for o in range(owners)]
            out = [np.empty(len(order), np.int64) for _ in pieces_[0]]
            for k, values in enumerate(out):
                values[order] = np.concatenate([p[k] for p in pieces_])
            return out

        header = sum(np.frombuffer(by[o]["header"], np.int64) for o in range(owners))
        return joined("counts", order), joined("hot_counts", hot_order), header


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def discount(once: int, twice: int) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def table_weights(customers: np.ndarray, width: int, d: float) -> np.ndarray:
    """Logarithms of S(c, t) / S(c, 1) for rising ``customers`` c and t from 1 to ``width`` tables.

    S(c, t) sums the weights of all ways to seat c customers at t tables; with S(n+1, t) = S(n, t-1) + (n - t d) S(n, t), the
    ratios of neighbours rise from n to n+1 customers by sums of positive numbers. From 256 customers (or twice the width) on
    they change so little that steps of that share of n follow them, to about five digits.
    """
    t, share = np.arange(1, width), max(256, 2 * width)
    out = np.zeros((len(customers), width))

    def risen(r: np.ndarray, n: int) -> np.ndarray:
        before = np.zeros(len(r))
        before[1:] = 1 / r[:-1]
        return (1 + (n - (t + 1) * d) * r) / (before + (n - t * d))

    r, n = np.zeros(width - 1), 1
    with np.errstate(divide="ignore"):
        for row, c in zip(out, customers.tolist()):
            while n < c:
                step = max(1, min(n // share, c - n))
                first = risen(r, n)
                if step == 1:
                    r = first
                else:
                    ahead = r + (step - 1) * (first - r)
                    r = r + step / 2 * (first - r + risen(ahead, n + step - 1) - ahead)
                n += step
            row[1:] = np.cumsum(np.log(r))
    return out


class Tables:
    """Customers that opened a table and customers that joined one, for rows with three customers or more.

    Which table a customer joined doesn't matter to any prediction, so only the two numbers are kept.
    """

    def __init__(self, customers: np.ndarray, weight: np.ndarray, rng: np.random.Generator):
        c = customers.astype(np.float64)
        # about as many tables as seating one customer after the other opens
        start = 1 + rng.poisson(np.minimum(weight * np.log1p((c - 1) / (1 + weight)), c))
        start = np.minimum(start, customers)
        self.groups = [(np.arange(len(customers)), np.stack([start, customers - start], axis=1))]
        self.weights = {}

    def counts(self, out: np.ndarray) -> None:
        for rows, seats in self.groups:
            out[rows] = seats[:, 0]

    def known(self, customers: np.ndarray, width: int, d: float) -> tuple[np.ndarray, np.ndarray]:
        """Rising numbers of customers, all of ``customers`` among them, and their ``table_weights``."""
        have, found = self.weights.get((width, d), (np.zeros(0, np.int64), None))
        if len(np.setdiff1d(customers, have)):
            have = np.union1d(have, customers)
            found = table_weights(have, width, d)
            self.weights[width, d] = have, found
        return have, found

    def sweep(self, customers: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> None:
        """Seat all customers of every row again at once; ``weight`` is that of a new table.

        Given the weight, c customers take t tables with probability S(c, t) weight^t up to a factor. A further table
        is at most weight / (t d) times as likely as t (beyond 2 / (1 - d) tables), so those beyond ``wide`` have about 1e-12.
        """
        mean = weight / d
        wide = np.minimum(customers, np.ceil(10 + 4 / (1 - d) + mean + 8 * np.sqrt(mean)))
        width = 4 ** np.ceil(np.log2(np.maximum(wide, 4)) / 2).astype(np.int64)
        for _, seats in self.groups:
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                have, found = self.known(customers[rows], w, d)
                for at in np.array_split(rows, -(-len(rows) * w // DRAWN)):
                    chances = found[np.searchsorted(have, customers[at])] + np.arange(w) * np.log(weight[at])[:, None]
                    reach = np.cumsum(np.exp(chances - chances.max(axis=1, keepdims=True)), axis=1)
                    seats[at, 0] = 1 + (reach <= rng.random((len(at), 1)) * reach[:, -1:]).sum(axis=1)
            seats[:, 1] = customers - seats[:, 0]


def seatings(customers: np.ndarray, parent: np.ndarray, group: np.ndarray, scale: np.ndarray, d: float, seed: int) -> list[np.ndarray]:
    """Tables of every row in ``SAMPLES`` Gibbs samples.

    ``parent`` is the parent's probability of the row's word, ``group`` its restaurant, ``scale`` by how much a
    restaurant has more tables than its rows here.
    """
    rng = np.random.default_rng(seed)
    tables = (customers > 0).astype(np.int32)
    two, many = np.flatnonzero(customers == 2), np.flatnonzero(customers > 2)
    weight_of = lambda rows: (STRENGTH + d * total[group[rows]]) * parent[rows]
    total = np.bincount(group, tables, minlength=len(scale)) * scale
    state = Tables(customers[many], weight_of(many), rng)
    out = []
    for sweep in range(BURN + SAMPLES):
        new = weight_of(two)
        # one of two customers moves: to the other's table, or to a new one
        tables[two] = 1 + (rng.random(len(two)) * (1 - d + new) < new)
        state.sweep(customers[many], weight_of(many), d, rng)
        found = np.zeros(len(many), np.int32)
        state.counts(found)
        tables[many] = found
        total = np.bincount(group, tables, minlength=len(scale)) * scale
        if sweep >= BURN:
            out.append(tables.copy())
    return out


def added(messages: list[dict], values: str, at: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Sums over all messages of each of their values; ``at`` has the places of every message's keys."""
    columns = zip(*[unstacked(m[values]) for m in messages])
    places = np.concatenate(at)
    return [np.bincount(places, np.concatenate(c), minlength=n).astype(np.int64) for c in columns]


def places_of(messages: list[dict], names: str) -> tuple[list[np.ndarray], int]:
    """Every message's places among the distinct keys of all, and how many there are."""
    keys = [hashes(m[names]) for m in messages]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return np.split(at, np.cumsum([len(k) for k in keys])[:-1]), len(found)


def parent_tables(customers: np.ndarray, types: int, owners: int, owner: int, number: int) -> list[np.ndarray]:
    """Samples of the parent's tables for the words of one owner, which is one of ``owners`` like shares."""
    d = discount(int((customers == 1).sum()), int((customers == 2).sum()))
    even = np.full(len(customers), 1.0 / (types * owners + 1))
    return seatings(customers, even, np.zeros(len(customers), np.int64), np.array([float(owners)]), d, (number << 32) + owner)


class Parent:
    """P(word) from its customers and tables, exactly normalised over the training types and one unknown word."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, types: int, d: float):
        rest = (STRENGTH + d * all_tables) / (types + 1)
        self.p = (customers - d * tables + rest) / (STRENGTH + all_customers)


class Exchange:
    """The steps of parts and owners; everything they need travels with them."""

    def __init__(self, parts: int, owners: int, hot: dict[int, int]):
        self.parts, self.owners, self.hot = parts, owners, hot

    def announce(self, rows: pa.Table) -> pa.Table:
        """Training customers and contexts per word, customers and words per split context."""
        part = Part(rows, self.parts, self.hot)
        eaten = (part.customers > 0).astype(np.int64)
        once, twice = int((part.customers == 1).sum()), int((part.customers == 2).sum())
        return part.messages(rows.column("part")[0].as_py(), self.owners, [part.by_word(part.customers), part.by_word(eaten)],
                             [part.by_context(part.customers)[part.split], part.by_context(eaten)[part.split]], (once, twice))

    def owned(self, messages: pa.Table):
        """What an owner adds up from the announcements, with its parent tables for one table per context and word."""
        listed = sorted(messages.to_pylist(), key=lambda m: m["part"])
        at, n = places_of(listed, "words")
        hot_at, n_hot = places_of(listed, "hot")
        tokens, contexts = added(listed, "counts", at, n)
        hot = added(listed, "hot_counts", hot_at, n_hot)
        known = int((tokens > 0).sum())
        tables = sum(parent_tables(contexts, known, self.owners, listed[0]["owner"], 0))
        header = [tokens.sum(), known, contexts.sum(), tables.sum(), (contexts == 1).sum(), (contexts == 2).sum(),
                  sum(m["once"] for m in listed), sum(m["twice"] for m in listed)]
        return listed, known, [tokens, contexts, tables], at, hot, hot_at, header

    def first_reply(self, messages: pa.Table) -> pa.Table:
        listed, _, words, at, hot, hot_at, header = self.owned(messages)
        return self.replied(listed, words, at, hot, hot_at, header)

    def replied(self, listed, words, at, hot, hot_at, header) -> pa.Table:
        head = np.array(header, np.int64).tobytes()
        return as_table([(m["part"], m["owner"], stacked([v[i] for v in words]), stacked([v[j] for v in hot]), head)
                         for m, i, j in zip(listed, at, hot_at)], REPLY)

    def seated(self, number: int, part: Part, words: list[np.ndarray], hot: list[np.ndarray], header: np.ndarray) -> list[np.ndarray]:
        """Samples of the tables of every pair, against the parent's prediction of the first exchange."""
        _, contexts, tables = words[:3]
        types, all_customers, all_tables, once, twice, pairs_once, pairs_twice = header[1:8].tolist()
        parent = Parent(contexts, tables / SAMPLES, all_customers, all_tables / SAMPLES, types, discount(once, twice))
        here = part.by_context((part.customers > 0).astype(np.int64))
        scale = np.ones(len(here))
        scale[part.split] = hot[1] / np.maximum(here[part.split], 1)
        return seatings(part.customers, parent.p[part.word], part.context, scale, discount(pairs_once, pairs_twice),
                        (1 << 40) + number)

    def seat(self, rows: pa.Table, replies: pa.Table) -> pa.Table:
        """Tables per word and per split context, for every sample."""
        if not rows.num_rows:
            return as_table([], SENT)
        part, number = Part(rows, self.parts, self.hot), rows.column("part")[0].as_py()
        samples = self.seated(number, part, *part.replies(replies, self.owners))
        return part.messages(number, self.owners, [part.by_word(t) for t in samples],
                             [part.by_context(t)[part.split] for t in samples])

    def second_reply(self, announced: pa.Table, seated: pa.Table) -> pa.Table:
        """The first reply again, then customers and tables of the parent for every sample."""
        if not announced.num_rows:
            return as_table([], REPLY)
        listed, known, words, at, hot, hot_at, header = self.owned(announced)
        again = sorted(seated.to_pylist(), key=lambda m: m["part"])
        customers = added(again, "counts", at, len(words[0]))
        hot_tables = added(again, "hot_counts", hot_at, len(hot[0]))
        tables = [parent_tables(c, known, self.owners, listed[0]["owner"], 1 + k)[-1] for k, c in enumerate(customers)]
        header = header + [x.sum() for pair in zip(customers, tables) for x in pair]
        return self.replied(listed, [*words, *customers, *tables], at, [*hot, *hot_tables], hot_at, header)

    def predicted(self, number: int, part: Part, words, hot, header) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pair: the word's training count, the base's logarithm and the model's probability."""
        samples = self.seated(number, part, words, hot, header)
        trained, types = int(header[0]), int(header[1])
        d_parent, d = discount(*header[4:6].tolist()), discount(*header[6:8].tolist())
        totals = part.by_context(part.customers)
        totals[part.split] = hot[0]
        model = np.zeros(len(part.customers))
        for k, t in enumerate(samples):
            customers, tables = words[3 + k], words[3 + SAMPLES + k]
            parent = Parent(customers, tables, header[8 + 2 * k], header[9 + 2 * k], types, d_parent).p[part.word]
            all_tables = part.by_context(t)
            all_tables[part.split] = hot[2 + k]
            own = (STRENGTH + d * all_tables)[part.context]
            own *= parent
            own += part.customers - d * t
            own /= (STRENGTH + totals)[part.context]
            np.copyto(own, parent, where=(totals == 0)[part.context])
            model += own / SAMPLES
            del own, parent
        count = words[0][part.word]
        base = np.log10((count + 0.5) / (trained + 0.5 * (types + 1)))
        return count, base, model

    def scored(self, rows: pa.Table, replies: pa.Table) -> pa.Table:
        """Sums over the tokens of every text of a chunk that fall into the part, and the chunks' lists of texts."""
        if not rows.num_rows:
            return as_table([], PARTIAL)
        part, number = Part(rows, self.parts, self.hot), rows.column("part")[0].as_py()
        words, hot, header = part.replies(replies, self.owners)
        count, base, model = self.predicted(number, part, words, hot, header)
        model = np.log10(model)
        out = [(r["chunk"], r["ids"], r["sizes"], int(header[0]), None, None, None, None) for r in part.lists]
        for r, pairs in zip(part.rows, np.split(part.pair_of, np.cumsum(part.sizes)[:-1])):
            of = np.repeat(pairs, unpacked(r["per_pair"]))
            doc, times = unpacked(r["docs"]), unpacked(r["times"])
            docs, doc = np.unique(doc, return_inverse=True)
            sums = lambda x: np.bincount(doc, x * times, minlength=len(docs))
            out.append((r["chunk"], None, None, None, packed(docs), packed(sums((count[of] > 0).astype(float))),
                        packed(np.rint(sums(base[of]) / -BASE_UNIT)), packed(np.rint(sums(model[of]) / -MODEL_UNIT))))
        return as_table(out, PARTIAL)


def gathered(rows: pa.Table) -> pa.Table:
    """One row per text of a chunk."""
    listed = rows.to_pylist()
    head = next(r for r in listed if r["ids"] is not None)
    sizes = unpacked(head["sizes"])
    known, base, model = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for r in (r for r in listed if r["docs"] is not None):
        docs = unpacked(r["docs"])
        known[docs] += unpacked(r["known"])
        base[docs] += unpacked(r["base"])
        model[docs] += unpacked(r["model"])
    return pa.table({"doc_id": pa.array(head["ids"], pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                     "n_known": pa.array(known), "train_tokens": pa.array([head["train_tokens"]] * len(sizes), pa.int64()),
                     "base_score": pa.array(0.0 - base * BASE_UNIT), "score": pa.array(0.0 - model * MODEL_UNIT)})


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def language_scores(docs: DataFrame, held: Column, part_tokens: int = PART_TOKENS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row; ``held`` marks the rows not to learn from.

    A null or empty text has one token, its end.  Rows whose ``held`` is null are learned from.  Repeated rows count as often
    as they occur; an empty table gives no rows; without any training row every word is the unknown one and has
    probability 1 in both scores; further columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tokens = (size["bytes"] or 0) // WORD_BYTES + size["n"]
    parts = max(1, -(-tokens // part_tokens))
    owners = max(1, parts // 8)
    hot = hot_contexts(rows, parts)
    work = Exchange(parts, owners, hot)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in steps(batch, limit=chunk_bytes):
                sizes, found = chunk_pairs(some, some.column("held").to_numpy(zero_copy_only=False), parts, hot)
                out = [(part, number, None, None, *columns) for part, *columns in found]
                out.append((number % parts, number, some.column("doc_id").to_pylist(), packed(sizes), *[None] * 8))
                yield from as_table(out, PAIRS).to_batches()
                number += 1

    sent = rows.mapInArrow(pairs, PAIRS)
    announced = sent.groupBy("part").applyInArrow(lambda rows: work.announce(rows), SENT)
    first = announced.groupBy("owner").applyInArrow(lambda sums: work.first_reply(sums), REPLY)
    seated = sent.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(lambda rows, back: work.seat(rows, back), SENT)
    second = announced.groupBy("owner").cogroup(seated.groupBy("owner")).applyInArrow(
        lambda sums, tables: work.second_reply(sums, tables), REPLY)
    partial = sent.groupBy("part").cogroup(second.groupBy("part")).applyInArrow(lambda rows, back: work.scored(rows, back), PARTIAL)
    return partial.groupBy("chunk").applyInArrow(gathered, SCORED)


def perplexity(scores: DataFrame, column: str = "score") -> float:
    """10 to the mean negative logarithm per token, ends included."""
    r = scores.agg(F.sum(column).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10.0 ** (-r["s"] / r["n"]) if r["n"] else float("nan")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


@register("op11_lm_scoring")
def op11_lm_scoring(spark, sf_dir):
    scores = language_scores(table(spark, sf_dir, "documents"), held_out())
    return scores.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
