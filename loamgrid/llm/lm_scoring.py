"""Language-model scores by Katz backoff.

The model has two levels. Single words get the add-half estimate P1, in which all unknown words share one half count. A word
after another gets its Good-Turing discounted bigram count over the count of the word before, if that bigram is in the model,
else a(before) * P1(word); a(before) is such that the probabilities after each word sum to 1 exactly. The query's model has every
bigram of the training texts, those seen once with their own discount. `scores` may be given a bound below which bigrams count as
unseen, as Katz allows; their mass then goes to the backoff.

Counts are tables partitioned by the hash of the word before; the partitions of the words' own counts are asked for those of the
predicted words, for P1, once for each partition of the model and word, and answer with numbers alone in the order of the question. Tasks count chunks of documents, and send arrays to each partition instead of rows: the distinct words
before, how many bigrams follow each, and their predicted words by 48 bits of hash. A scored chunk sends each partition its bigrams
so with the places of their documents, and gets sums for these documents back. Words and bigrams that hold more than one token in
HOT (HOT of each at most) are looked up where the chunk is read, and other bigrams after a hot word are spread over all partitions,
so no word or bigram fills a partition. Partitions are as many as the bytes and tokens of the texts ask for.

Null and empty texts have one token, the end; very long texts are one document of a chunk of their own size. Rows with a null doc_id
are learned from, and none of them is held out. Repeated rows count and are scored each; ties need no order. Without any training
row all counts are 0 and every token is unknown; no rows give no rows. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import as_bytes, discard, hash_texts, load, mix, shuffle_partitions, stash

HOT = 100_000
#: Bigrams seen less often are unseen if `scores` isn't given another bound; EVERY takes all. Counts up to DISCOUNTED are discounted.
CUT, EVERY, DISCOUNTED = 2, 1, 5
#: Tokens and documents of a chunk; documents whose sums are gathered together; training tokens for each partition.
CHUNK_TOKENS, CHUNK_DOCS, GATHERED, PART_TOKENS = 1_000_000, 60_000, 512, 2_000_000
#: Bytes of text for each partition of the words' own counts.
PART_BYTES = 1 << 26

START, END = (np.uint64(xxhash.xxh3_64_intdigest(b" " + name)) for name in (b"start", b"end"))
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a predicted word's hash in tables of bigrams.
WORD = np.uint64((1 << 48) - 1)

COUNTS = "part int, words binary, counts binary"
WORDS = "part int, words binary, counts binary, tokens long, types long"
PAIRS = "part int, before binary, word binary, counts binary"
#: single, dropped: words before, and how many of their bigrams' occurrences aren't in the model.
MODEL = "part int, before binary, word binary, counts binary, single binary, dropped binary, n_of array<long>"
#: Words that partition `part` is asked for by the model's partition `model`; the table of words itself has no `model`.
ASKS = "part int, model int, words binary, counts binary"
#: The answer to the model's partition `part` by the words' partition `by`: the counts of the words, in their order.
OWN = "part int, by int, counts binary"
HOT_ROWS = "hot binary, stars binary, lower binary, key binary, n binary, own binary"
MAIL = "part int, chunk long, block int, kind int, a binary, b binary, c binary, d binary"
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
MODEL_ROW, ASKED, TOLD, DOCS, OWN_ROW = range(5)


@dataclass
class Shared:
    """What all tasks know. Arrays are bounded by HOT."""

    parts: int
    word_parts: int
    least: int
    tokens: int = 0
    types: int = 0
    ends: int = 0
    hot: np.ndarray | None = None  # sorted hashes of hot words before, START among them
    hot_n: np.ndarray | None = None
    common: np.ndarray | None = None  # sorted hashes of WORD's bits of hot words and the end
    discounts: np.ndarray | None = None
    hot_total: np.ndarray | None = None
    hot_backoff: np.ndarray | None = None
    pairs: np.ndarray | None = None  # sorted keys of hot bigrams
    pairs_n: np.ndarray | None = None
    pairs_own: np.ndarray | None = None  # counts of the predicted words

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def part_of(self, before: np.ndarray, keys: np.ndarray) -> np.ndarray:
        spread = np.where(find(self.hot, before) >= 0, keys, before) if self.hot is not None else before
        return (mix(spread) >> np.uint64(33)) % np.uint64(self.parts)


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in a sorted table, -1 for those it lacks."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def key_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before * PAIR + mix(word + PAIR)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys sorted, the place of one row of each, and the sums of their counts."""
    order = np.argsort(keys)
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[first], order[first], np.add.reduceat(counts[order], first) if len(s) else counts


def by_part(parts: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(parts, kind="stable")
    return np.split(order, np.searchsorted(parts[order], np.arange(1, n, dtype=parts.dtype)))


def binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def squeezed(x: np.ndarray) -> bytes:
    """Numbers, compressed: all first bytes, all second bytes and so on."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(x: bytes, kind) -> np.ndarray:
    planes = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def joined(*parts: bytes) -> bytes:
    return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)


def parted(x: bytes, n: int) -> list[bytes]:
    ends = 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(x, np.int64, n))])
    return [x[ends[i] : ends[i + 1]] for i in range(n)]


def pack_coded(values: np.ndarray, common: np.ndarray, size: int) -> bytes:
    """Hashes of `size` bytes; those of the sorted table `common` by their steps in it."""
    at = find(common, values)
    met = at >= 0
    steps = np.diff(at[met].astype(np.uint32), prepend=np.uint32(0))
    return joined(squeezed(np.packbits(met)), squeezed(steps), np.ascontiguousarray(values[~met]).view(np.uint8).reshape(-1, 8)[:, :size].tobytes())


def unpack_coded(x: bytes, common: np.ndarray, size: int) -> np.ndarray:
    bits, steps, rest = parted(x, 3)
    at, n = np.cumsum(unsqueezed(steps, np.uint32), dtype=np.uint32), len(rest) // size
    met = np.unpackbits(unsqueezed(bits, np.uint8))[: len(at) + n].astype(bool)
    own = np.zeros((n, 8), np.uint8)
    own[:, :size] = np.frombuffer(rest, np.uint8).reshape(-1, size)
    out = np.empty(len(at) + n, np.uint64)
    out[met], out[~met] = common[at], own.view(np.uint64).ravel()
    return out


def pack_heads(s: Shared, before: np.ndarray) -> bytes:
    """Values that stand in runs: each once, and the runs' lengths."""
    first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.empty(0, np.int64)
    return joined(pack_coded(before[first], s.hot, 8), squeezed(np.diff(np.append(first, len(before))).astype(np.uint32)))


def unpack_heads(s: Shared, x: bytes) -> np.ndarray:
    heads, lengths = parted(x, 2)
    return np.repeat(unpack_coded(heads, s.hot, 8), unsqueezed(lengths, np.uint32))


def pack_next(s: Shared, words: np.ndarray) -> bytes:
    return pack_coded(words, s.common, 6)


def unpack_next(s: Shared, x: bytes) -> np.ndarray:
    return unpack_coded(x, s.common, 6)


def pack_words(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_words(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return (mix(words & WORD) >> np.uint64(33)) % np.uint64(parts)


def small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32)


class Chunk:
    """Documents read together: their tokens with the word before, the document's place, its id and side."""

    def __init__(self):
        self.words: list[np.ndarray] = []
        self.ids: list = []
        self.held: list = []
        self.size = 0

    def add(self, words: np.ndarray, doc_id, held) -> None:
        self.words.append(words)
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words) + 1

    def before(self) -> np.ndarray:
        start, every = np.array([START]), []
        for w in self.words:
            every += [start, w]
        return np.concatenate(every)

    def word(self) -> np.ndarray:
        end, every = np.array([END]), []
        for w in self.words:
            every += [w, end]
        return np.concatenate(every)


def chunks(batches: Iterator[pa.RecordBatch], tokens: int, docs: int) -> Iterator[Chunk]:
    """batches: doc_id, text, held_out."""
    chunk = Chunk()
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            for doc_id, words, held in zip(part.column(0).to_pylist(), hash_texts([t or b"" for t in as_bytes(part.column(1))]), part.column(2).to_pylist(), strict=True):
                chunk.add(words.copy(), doc_id, held)
                if chunk.size >= tokens or len(chunk.ids) >= docs:
                    yield chunk
                    chunk = Chunk()
    if chunk.ids:
        yield chunk


def rows(schema: str, out: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*out, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _count_words(parts: int, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size, 1 << 30):
            words, _, n = summed(chunk.word(), np.ones(chunk.size, np.int64))
            split = by_part(word_part(words, parts), parts)
            yield rows(COUNTS, [(i, binary(words[x]), binary(small(n[x]))) for i, x in enumerate(split) if len(x)])

    return count


def _merge_words(table: pa.Table) -> pa.Table:
    words, counts = (np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()]) for c, k in (("words", np.uint64), ("counts", np.uint32)))
    words, _, n = summed(words, counts.astype(np.int64))
    return pa.Table.from_batches([rows(WORDS, [(table["part"][0].as_py(), binary(words), binary(n), int(n.sum()), len(words))])])


def _at_least(least: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words, n = np.frombuffer(w, np.int64), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words[n >= least]), pa.array(n[n >= least])], names=["word", "n"])

    return read


def _count_pairs(known, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Shared = known.value
        for chunk in chunks(batches, size, 1 << 30):
            before, word = chunk.before(), chunk.word() & WORD
            keys, at, n = summed(key_of(before, word), np.ones(chunk.size, np.int64))
            at_before = np.argsort(before[at])
            keys, n, at = keys[at_before], n[at_before], at[at_before]
            before, word = before[at], word[at]
            split = by_part(s.part_of(before, keys), s.parts)
            yield rows(PAIRS, [(i, pack_heads(s, before[x]), pack_next(s, word[x]), squeezed(small(n[x]))) for i, x in enumerate(split) if len(x)])

    return count


def _merge_pairs(known):
    def merge(table: pa.Table) -> pa.Table:
        s: Shared = known.value
        before, word, counts = (np.concatenate([f(x.as_py()) for x in table[c]]) for c, f in (("before", lambda x: unpack_heads(s, x)), ("word", lambda x: unpack_next(s, x)), ("counts", lambda x: unsqueezed(x, np.uint32))))
        _, at, n = summed(key_of(before, word), counts.astype(np.int64))
        order = np.argsort(before[at])
        at, n = at[order], n[order]
        before, word = before[at], word[at]
        kept = n >= s.least
        single, _, dropped = summed(before[~kept], n[~kept])
        cold = find(s.hot, single) < 0
        n_of = np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2].tolist()
        return pa.Table.from_batches([rows(MODEL, [(table["part"][0].as_py(), pack_heads(s, before[kept]), pack_next(s, word[kept]), squeezed(n[kept]), binary(single[cold]), binary(dropped[cold]), n_of)])])

    return merge


def _ask_words(known):
    """Rows for the words' partitions: the distinct predicted words of each partition of the model."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Shared = known.value
        for batch in batches:
            for model, w in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), strict=True):
                words = np.unique(unpack_next(s, w))
                split = by_part(word_part(words, s.word_parts), s.word_parts)
                yield rows(ASKS, [(i, model, pack_words(words[x]), b"") for i, x in enumerate(split) if len(x)])

    return ask


def _answer_words(table: pa.Table) -> pa.Table:
    """The rows of one partition of words: its table, and the words that are asked for. Answers go to the model's partitions."""
    models, asked = table["model"].to_pylist(), table["words"]
    own = models.index(None)
    words, counts = (np.frombuffer(table[c][own].as_py(), k) for c, k in (("words", np.uint64), ("counts", np.int64)))
    order = np.argsort(words & WORD)
    words, counts = (words & WORD)[order], counts[order]
    out = [(model, table["part"][0].as_py(), squeezed(counts[find(words, unpack_words(asked[i].as_py()))])) for i, model in enumerate(models) if model is not None]
    return pa.Table.from_batches([rows(OWN, out)])


def own_counts(word: np.ndarray, answers: Iterable[tuple[int, bytes]], parts: int) -> np.ndarray:
    """The counts of a model's predicted words, from the answers (words' partition, counts)."""
    words = np.unique(word)
    split, counts = by_part(word_part(words, parts), parts), np.zeros(len(words), np.int64)
    for by, own in answers:
        counts[split[by]] = unsqueezed(own, np.int64)
    return counts[np.searchsorted(words, word)]


def good_turing(n_of: list[int]) -> np.ndarray:
    """Discount factors for counts 0 to DISCOUNTED (the first two unused), from the numbers of bigrams of each count; (r - 1/2) / r where the formula fails."""
    out = np.ones(DISCOUNTED + 1)
    tail = (DISCOUNTED + 1) * n_of[DISCOUNTED + 1] / n_of[1] if n_of[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n_of[r + 1] / (r * n_of[r]) - tail) / (1 - tail) if n_of[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(s: Shared, n: np.ndarray) -> np.ndarray:
    return n * np.where(n <= DISCOUNTED, s.discounts[np.minimum(n, DISCOUNTED)], 1.0)


def backoff(totals: np.ndarray, stars: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of words with these counts, sums of discounted counts, and sums of P1 of what follows them in the model.
    Where discounting leaves less than half a count, half a count is added."""
    below = np.where(totals - stars >= 0.5, totals, stars + 0.5)
    return below, np.where(stars > 0, (1 - stars / np.maximum(below, 0.5)) / (1 - lower), 1.0)


def _hot_rows(known, least: float):
    def read(table: pa.Table) -> pa.Table:
        """Of one partition of the model, whose other rows are answers: each hot word's sums of discounted counts and of P1, and the hot bigrams."""
        s: Shared = known.value
        by = table["by"].to_pylist()
        i = by.index(None)
        before, word, n = unpack_heads(s, table["before"][i].as_py()), unpack_next(s, table["word"][i].as_py()), unsqueezed(table["counts"][i].as_py(), np.int64)
        own = own_counts(word, ((x, table["counts"][j].as_py()) for j, x in enumerate(by) if x is not None), s.word_parts)
        at = find(s.hot, before)
        hot, often = at >= 0, n >= least
        stars, lower = (np.bincount(at[hot], weights=x[hot], minlength=len(s.hot)) for x in (discounted(s, n), s.p1(own)))
        met = np.flatnonzero(stars)
        return pa.Table.from_batches([rows(HOT_ROWS, [tuple(map(binary, (met, stars[met], lower[met], key_of(before, word)[often], n[often], own[often])))])])

    return read


def _unpacked(schema: str):
    """Rows of arrays as rows of their numbers."""
    kinds = {"long": np.int64, "double": np.float64}
    fields = [f.split() for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name, _ in fields), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, kinds[kind])) for x, (_, kind) in zip(row, fields, strict=True)], names=[name for name, _ in fields])

    return read


def _ask(known, size: int, docs: int):
    """Rows for the partitions: of each chunk its bigrams, how often each stands there, and the places of the documents; and what is known already."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Shared = known.value
        task = TaskContext.get().partitionId() << 32
        end = math.log10(float(s.p1(np.array([s.ends]))[0]))
        for number, chunk in enumerate(chunks(batches, size, docs)):
            lengths = np.array([len(w) + 1 for w in chunk.words], np.int64)
            doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
            before, word = chunk.before(), chunk.word() & WORD
            hot = find(s.hot, before)
            first = np.zeros(len(before), bool)
            first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
            keys = key_of(before, word)
            pair = np.where(hot >= 0, find(s.pairs, keys), -1)
            # the end of each document, and hot words
            local = pair >= 0
            told = np.flatnonzero((hot >= 0) & ~first)
            base = np.full(len(lengths), end) + np.bincount(doc[told], np.log10(s.p1(s.hot_n[hot[told]])), len(lengths))
            n_known = np.full(len(lengths), int(s.ends > 0)) + np.bincount(doc[told], s.hot_n[hot[told]] > 0, len(lengths)).astype(np.int64)
            more = np.zeros(len(before))
            x = np.flatnonzero(local)
            more[x] = np.log10(discounted(s, s.pairs_n[pair[x]]) / s.hot_total[hot[x]] / s.p1(s.pairs_own[pair[x]]))
            more = np.bincount(doc[local], more[local], len(lengths))
            out = []
            for block in range(0, len(lengths), GATHERED):
                x = slice(block, block + GATHERED)
                ids = np.array([0 if i is None else i for i in chunk.ids[x]], np.int64)
                flags = np.array([2 * (i is None) + bool(h) for i, h in zip(chunk.ids[x], chunk.held[x], strict=True)], np.uint8)
                out.append(((block // GATHERED + number) % s.parts, task + number, block // GATHERED, DOCS, binary(ids), binary(flags), binary(np.stack([lengths[x], n_known[x]])), binary(np.stack([base[x], more[x]]))))
            asked = np.flatnonzero(~local)
            order = asked[np.lexsort((keys[asked], before[asked]))]
            k = keys[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
            n = np.diff(np.append(at, len(k)))
            own_before, own_word, own_doc = before[order[at]], word[order[at]], doc[order]
            for i, x in enumerate(by_part(s.part_of(own_before, k[at]), s.parts)):
                if len(x):
                    # the places of this part's documents, bigram by bigram
                    taken = np.repeat(at[x] - np.concatenate([[0], np.cumsum(n[x])[:-1]]), n[x]) + np.arange(n[x].sum())
                    out.append((i, task + number, 0, ASKED, pack_heads(s, own_before[x]), pack_next(s, own_word[x]), squeezed(small(n[x])), squeezed(own_doc[taken])))
            yield rows(MAIL, out)

    return ask


def _tell(known):
    """The rows of one partition: the model's, and those of the chunks that ask."""

    def tell(table: pa.Table) -> pa.Table:
        s: Shared = known.value
        kinds = np.array(table["kind"].to_pylist())
        before, word, n, ctx = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        for i in np.flatnonzero(kinds == MODEL_ROW).tolist():
            before, word = unpack_heads(s, table["a"][i].as_py()), unpack_next(s, table["b"][i].as_py())
            n, ctx = unsqueezed(table["c"][i].as_py(), np.int64), np.frombuffer(table["d"][i].as_py(), np.int64)
        word_n = own_counts(word, ((table["block"][i].as_py(), table["a"][i].as_py()) for i in np.flatnonzero(kinds == OWN_ROW).tolist()), s.word_parts)
        single, _, totals = summed(np.concatenate([before, ctx[: len(ctx) // 2].view(np.uint64)]), np.concatenate([n, ctx[len(ctx) // 2 :]]))
        cold = find(s.hot, single) < 0
        single, totals = single[cold], totals[cold]
        keys = key_of(before, word)
        order = np.argsort(keys)
        keys, n_of_key, own_of_key = keys[order], n[order], word_n[order]
        own = find(single, before)
        cold = own >= 0
        below, weight = backoff(totals, np.bincount(own[cold], discounted(s, n[cold]), len(totals)), np.bincount(own[cold], s.p1(word_n[cold]), len(totals)))
        out = []
        for i in range(len(table)):
            if kinds[i] == DOCS:
                out.append((0, table["chunk"][i].as_py(), table["block"][i].as_py(), DOCS, *(table[c][i].as_py() for c in "abcd")))
            elif kinds[i] == ASKED:
                b, w = unpack_heads(s, table["a"][i].as_py()), unpack_next(s, table["b"][i].as_py())
                times, doc = (unsqueezed(table[c][i].as_py(), k) for c, k in (("c", np.uint32), ("d", np.uint16)))
                at, pair, hot = find(single, b), find(keys, key_of(b, w)), find(s.hot, b)
                seen, met = at >= 0, pair >= 0
                count = np.where(seen, totals[at], 0) if len(totals) else np.zeros(len(b), np.int64)
                # a word before is looked up here as a token of its own, unless it is hot
                base = np.where(hot < 0, np.log10(s.p1(count)), 0.0)
                a = np.where(hot >= 0, s.hot_backoff[hot], np.where(seen, weight[at], 1.0) if len(totals) else 1.0)
                d = np.where(hot >= 0, s.hot_total[hot], np.where(seen, below[at], 1.0) if len(totals) else 1.0)
                more = np.log10(a)
                x = np.flatnonzero(met)
                more[x] = np.log10(discounted(s, n_of_key[pair[x]]) / d[x] / s.p1(own_of_key[pair[x]]))
                spread = lambda v: np.bincount(doc, np.repeat(v, times))
                touched = np.flatnonzero(np.bincount(doc))
                known_, base, more = spread((count > 0) & (hot < 0)).astype(np.uint32)[touched], spread(base)[touched], spread(more)[touched]
                for block in np.unique(touched // GATHERED).tolist():
                    x = touched // GATHERED == block
                    out.append((0, table["chunk"][i].as_py(), block, TOLD, binary((touched[x] % GATHERED).astype(np.uint16)), binary(known_[x]), binary(base[x]), binary(more[x])))
        return pa.Table.from_batches([rows(MAIL, out)])

    return tell


def _gather(tokens: int):
    def gather(table: pa.Table) -> pa.Table:
        """The sums for the documents of one block."""
        kinds = table["kind"].to_pylist()
        value = lambda i, c, t: np.frombuffer(table[c][i].as_py(), t)
        i = kinds.index(DOCS)
        ids, flags = value(i, "a", np.int64), value(i, "b", np.uint8)
        (lengths, n_known), (base, more) = value(i, "c", np.int64).reshape(2, -1).copy(), value(i, "d", np.float64).reshape(2, -1).copy()
        for i in (i for i, kind in enumerate(kinds) if kind == TOLD):
            at = value(i, "a", np.uint16)
            n_known[at] += value(i, "b", np.uint32)
            base[at] += value(i, "c", np.float64)
            more[at] += value(i, "d", np.float64)
        columns = [pa.array(ids, mask=flags >= 2), pa.array(flags % 2 == 1), pa.array(lengths), pa.array(n_known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(base + more)]
        return pa.Table.from_arrays(columns, names=SCORES.names)

    return gather


def scores(docs: DataFrame, hot: int = HOT, chunk_tokens: int = CHUNK_TOKENS, least: int = CUT) -> DataFrame:
    """The columns of SCORES for each row of docs. Bigrams seen less often than `least` count as unseen."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    read = docs.select("doc_id", "text", held.alias("held_out"))
    train = read.where(~F.col("held_out"))
    n_bytes = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(shuffle_partitions(spark), -(-n_bytes // PART_BYTES))
    words = stash(train.mapInArrow(_count_words(n_parts, chunk_tokens), COUNTS).groupBy("part").applyInArrow(_merge_words, WORDS))
    total = words.agg(F.sum("tokens"), F.sum("types")).first()
    s = Shared(max(n_parts, -(-(total[0] or 0) // PART_TOKENS)), n_parts, least, total[0] or 0, total[1] or 0)
    table = words.mapInArrow(_at_least(max(1, s.tokens / hot)), "word long, n long").toArrow()  # `hot` rows at most
    found, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.int64)
    s.ends = train.count()
    before, n = np.append(found[found != END], START), np.append(n[found != END], s.ends)
    order = np.argsort(before)
    s.hot, s.hot_n = before[order], n[order].astype(np.int64)
    s.common = np.unique(np.append(s.hot, END) & WORD)
    known = spark.sparkContext.broadcast(s)
    model = stash(train.mapInArrow(_count_pairs(known, chunk_tokens), PAIRS).groupBy("part").applyInArrow(_merge_pairs(known), MODEL))
    asks = model.select("part", "word").mapInArrow(_ask_words(known), ASKS)
    own = stash(asks.unionByName(words.select("part", F.lit(None).cast("int").alias("model"), "words", "counts")).groupBy("part").applyInArrow(_answer_words, OWN))
    discard(words)
    n_of = model.select(*[F.sum(F.element_at("n_of", r + 1)).alias(f"n{r}") for r in range(DISCOUNTED + 2)]).first()
    s.discounts = good_turing([x or 0 for x in n_of])
    known = spark.sparkContext.broadcast(s)
    none, blank = F.lit(None).cast("binary"), F.lit(None).cast("int")
    both = model.select("part", blank.alias("by"), "before", "word", "counts").unionByName(own.select("part", "by", none.alias("before"), none.alias("word"), "counts"))
    found = stash(both.groupBy("part").applyInArrow(_hot_rows(known, max(least, s.tokens / hot)), HOT_ROWS))
    stars, lower, sums, often = np.zeros(len(s.hot)), np.zeros(len(s.hot)), "hot long, stars double, lower double", "key long, n long, own long"
    for r in found.select("hot", "stars", "lower").mapInArrow(_unpacked(sums), sums).groupBy("hot").agg(F.sum("stars").alias("stars"), F.sum("lower").alias("lower")).collect():  # `hot` rows at most
        stars[r["hot"]], lower[r["hot"]] = r["stars"], r["lower"]
    s.hot_total, s.hot_backoff = backoff(s.hot_n, stars, lower)
    pairs = found.select("key", "n", "own").mapInArrow(_unpacked(often), often).toArrow()  # `hot` rows at most
    discard(found)
    keys, n = pairs["key"].to_numpy().view(np.uint64), pairs["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    s.pairs, s.pairs_n, s.pairs_own = keys[order], n[order], pairs["own"].to_numpy().astype(np.int64)[order]
    known = spark.sparkContext.broadcast(s)
    asked = read.mapInArrow(_ask(known, chunk_tokens, CHUNK_DOCS), MAIL)
    no_chunk = F.lit(None).cast("long").alias("chunk")
    rows_of = model.select("part", no_chunk, blank.alias("block"), F.lit(MODEL_ROW).alias("kind"), F.col("before").alias("a"), F.col("word").alias("b"), F.col("counts").alias("c"), F.concat("single", "dropped").alias("d"))
    own_of = own.select("part", no_chunk, F.col("by").alias("block"), F.lit(OWN_ROW).alias("kind"), F.col("counts").alias("a"), *(none.alias(c) for c in "bcd"))
    told = asked.unionByName(rows_of).unionByName(own_of).groupBy("part").applyInArrow(_tell(known), MAIL)
    return told.groupBy("chunk", "block").applyInArrow(_gather(s.tokens), SCORES)


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(load(spark, sf_dir, "documents"), least=EVERY)
