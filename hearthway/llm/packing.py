"""Best-fit packing of tokenised documents by bin completion.

Lengths are whole numbers up to the capacity, so a corpus of any size is a histogram of at most ``capacity`` rows.
The search runs on that histogram and yields filling patterns with multiplicities; Spark then numbers the pieces of
each length and looks up which pattern, sequence and offset each number has.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, numbered_within, settle, ship, tidy, with_row

#: Bytes that the units of a generation may take, about; pieces that an encoder keeps, of some 40 bytes each; nodes and sets
#: of lengths that a search looks at.
UNIT_BYTES, PIECES_KEPT, EFFORT = 40_000_000, 1 << 19, 20_000
END = 2
PIECES = "row_no long, doc_id long, piece int, start long, length long, ids_crc32 long"

Counts = dict[int, int]
Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: Counts, capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing on a histogram: bins of equal content are handled together."""
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    rooms = 0  # bit r: there is an open bin with room r
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = rooms >> size
            if not fits:
                many, room, pattern = left, capacity, ()
            else:
                room = size + (fits & -fits).bit_length() - 1
                many, pattern = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            each = room // size
            full = min(many, left // each)
            made = [(full, each)] if full else []
            left, many = left - full * each, many - full
            if left and many and left < each:
                made.append((1, left))
                left, many = 0, many - 1
            made.append((many if pattern else 0, 0))
            for bins, k in made:
                if bins:
                    open_.setdefault(room - k * size, []).append((bins, (*pattern, (size, k)) if k else pattern))
                    rooms |= 1 << (room - k * size)
    return [x for group in open_.values() for x in group]


def lower_bound(counts: Counts, capacity: int) -> int:
    """Martello and Toth's bound: for each small size k, what the items over capacity - k and over half need."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in range(capacity // 2 + 1):
        big = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def _sums(size: int, times: int, upto: int) -> int:
    """Bits 0, size, 2 * size, ... times * size, as far as ``upto``."""
    out = 1
    for _ in range(min(times, upto // size)):
        out |= out << size
    return out & ((1 << (upto + 1)) - 1)


def dominated(chosen: tuple[int, ...], waste: int, spare: list[int]) -> bool:
    """Whether one item of ``spare`` could take the place of some of ``chosen`` and use no less room.

    Those it replaces, with the same or a smaller sum, are easier to place elsewhere. One item of the same size is no gain.
    """
    one, two = 0, 0  # sums of one member or more, and of two or more
    for s in chosen:
        one, two = one | one << s | 1 << s, two | two << s | one << s
    # an item x does it if some sum t has t <= x <= t + waste, and t < x where t is a single member
    reach = two
    for w in range(1, waste + 1):
        reach |= (one << w) | (two << w)
    return any(reach >> x & 1 for x in spare)


class Search:
    """The effort a search may spend, and what it did: nodes, sets of lengths, turns off the first choice, ends."""

    def __init__(self, effort: int = EFFORT):
        self.effort, self.nodes, self.sets, self.turns, self.leaves = effort, 0, 0, 0, 0

    def spent(self) -> int:
        return self.nodes + self.sets


def fillings(room: int, counts: Counts, waste: int, seen: Search) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated sets of lengths for ``room``, those that waste least first, as far as ``waste``: (waste, set).

    Sums that the lengths from each on can reach are kept as bits, so that no branch is entered that leads to none.
    Sets with the larger members come first. Each set looked at counts in ``seen``; without effort left there are no more.
    """
    sizes = sorted((s for s in counts if counts[s] and s <= room), reverse=True)
    reach = [1]
    for s in reversed(sizes):
        sums = reach[-1]
        for _ in range(min(counts[s], room // s)):
            grown = (sums | sums << s) & ((1 << (room + 1)) - 1)
            if grown == sums:
                break
            sums = grown
        reach.append(sums)
    reach.reverse()  # reach[i]: sums of sizes[i:]
    for lost in range(min(waste, room) + 1):
        if not reach[0] >> (room - lost) & 1:
            continue
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room - lost, ())]
        while stack:
            at, rest, chosen = stack.pop()
            while rest and at < len(sizes) and (sizes[at] > rest or not any(reach[at + 1] >> (rest - k * sizes[at]) & 1 for k in range(1, min(rest // sizes[at], counts[sizes[at]]) + 1))):
                at += 1
            if not rest:
                seen.sets += 1
                if seen.spent() > seen.effort:
                    return
                if not dominated(chosen, lost, [s for s in sizes if counts[s] > chosen.count(s)]):
                    yield lost, chosen
            elif at < len(sizes):
                s = sizes[at]
                if reach[at + 1] >> rest & 1:
                    stack.append((at + 1, rest, chosen))
                for k in range(1, min(rest // s, counts[s]) + 1):
                    if reach[at + 1] >> (rest - k * s) & 1:
                        stack.append((at + 1, rest - k * s, chosen + (s,) * k))


def bin_completion(counts: Counts, capacity: int, effort: int = EFFORT, seen: Search | None = None) -> list[tuple[int, Pattern]]:
    """Patterns with multiplicities that hold ``counts`` in few bins.

    Branch and bound: a node completes the bin of the longest item left by an undominated filling, used as often as the
    histogram allows, or half as often, and so on down to once, so that every packing can be reached. Nodes with the
    fewest departures from the first choice (the fullest filling, as often as can be) come first, the deepest of them
    before others; so the first descent reaches an end, and later ones turn off from it. A branch ends when its waste
    shows that it can't beat the incumbent, at first the best-fit solution. States met before with no more bins are not
    looked at again. The search stops at the lower bound, when nothing is left to try, or when it has spent ``effort``
    (nodes and sets of lengths looked at): the one budget. ``seen`` tells what it did, and brings its own effort.
    """
    seen = seen or Search(effort)
    counts = {s: n for s, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    fewest, bound, total = sum(m for m, _ in incumbent), lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    known: dict[tuple, int] = {}
    # departures, -depth, order; then the state: histogram, bins used, waste, moves made (linked), choice to take
    queue: list[tuple] = [(0, 0, 0, counts, 0, 0, None, 0)]
    pushed = 0

    def unrolled(made) -> list[tuple[int, Pattern]]:
        out = []
        while made:
            out.append(made[0])
            made = made[1]
        return out

    while queue and fewest > bound and seen.spent() < seen.effort:
        departures, depth, _, left, used, wasted, made, choice = heapq.heappop(queue)
        allowed = (fewest - 1) * capacity - total - wasted
        if allowed < 0:
            continue
        if choice == 0:
            seen.nodes += 1
            if not left:
                seen.leaves += 1
                incumbent, fewest = unrolled(made), used
                continue
            state = tuple(sorted(left.items()))
            digest = (hash(state), len(state), sum(left.values()))
            if known.get(digest, used + 1) <= used:
                continue
            known[digest] = used
            if depth % 16 == 0 or len(left) <= 32:
                # best-fit may finish what is left better than the incumbent does
                rest = best_fit(left, capacity)
                if used + sum(m for m, _ in rest) < fewest:
                    seen.leaves += 1
                    incumbent, fewest = [*unrolled(made), *rest], used + sum(m for m, _ in rest)
                    continue
        else:
            seen.turns += 1
        first = max(left)
        others = dict(left)
        others[first] -= 1
        # the choice-th pair of a filling and a multiplicity, and whether there is a next one
        at, found = 0, None
        for room, chosen in fillings(capacity - first, others, allowed, seen):
            items = (first, *chosen)
            pattern = tuple((s, items.count(s)) for s in sorted(set(items), reverse=True))
            most = min(left[s] // k for s, k in pattern)
            if room:
                most = min(most, max(1, allowed // room))
            steps = most.bit_length()
            if choice < at + steps:
                found = (room, pattern, max(1, most >> (choice - at)))
                break
            at += steps
        if found is None:
            continue
        room, pattern, many = found
        after = dict(left)
        for s, k in pattern:
            after[s] -= k * many
            if not after[s]:
                del after[s]
        pushed += 2
        heapq.heappush(queue, (departures, depth - 1, pushed, after, used + many, wasted + room * many, ((many, pattern), made), 0))
        heapq.heappush(queue, (departures + 1, depth, pushed + 1, left, used, wasted, made, choice + 1))
    return incumbent


class Units:
    """Ids of units met before, in two generations: those of the last batches, and those before, from which units are taken
    over when a batch brings them again. A generation has UNIT_BYTES."""

    def __init__(self):
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def learn(self, units: list[str], ids: list[bytes]) -> None:
        self.ids.update(zip(units, ids, strict=True))
        self.held += 200 * len(units) + sum(map(len, units))

    def missing(self, units: set[str]) -> list[str]:
        """Those of a batch that are to be learned; all others are in ``ids`` then."""
        if self.held > UNIT_BYTES:
            self.old, self.ids, self.held = self.ids, {}, 0
        new = units - self.ids.keys()
        again = list(new & self.old.keys())
        self.learn(again, list(map(self.old.__getitem__, again)))
        return list(new.difference(again))


class Pieces:
    """Ids of pieces met before, laid end to end. Over PIECES_KEPT of them, the half met last stays."""

    def __init__(self):
        self.texts = pa.array([], pa.large_string())
        self.ids, self.size, self.met, self.turn = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def places(self, wanted: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of some different pieces, after ``learn`` gave the ids of those not met before, and how many each has."""
        if len(self.size) > PIECES_KEPT:
            stay = np.sort(np.argsort(self.met, kind="stable")[-(PIECES_KEPT // 2) :])
            self.ids = laid(self.ids, self.starts()[stay], self.size[stay])
            self.texts, self.size, self.met = self.texts.take(pa.array(stay)), self.size[stay], self.met[stay]
        at = pc.fill_null(pc.index_in(wanted, value_set=self.texts), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(at < 0)
        at[new] = len(self.size) + np.arange(len(new))
        fresh = wanted.take(pa.array(new))
        ids, size = learn(fresh)
        self.texts, self.ids, self.size = pa.concat_arrays([self.texts, fresh]), np.append(self.ids, ids), np.append(self.size, size)
        self.met = np.append(self.met, np.zeros(len(new), np.int32))
        self.turn += 1
        self.met[at] = self.turn
        return at

    def starts(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def laid(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``ids`` one behind the other."""
    at = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at]


class Encoder:
    """Ids of whole texts by ``tokenizers``, as little-endian unsigned 32-bit integers, put together from blank-led pieces.

    Byte-level pre-tokenisation never joins a character with a blank after it, nor a letter with another character after
    it, so the words of a text can be encoded by themselves, each after a blank, and their leading letters apart from what
    follows these; unless a blank stands beside other white space. Such texts, texts with a special token and texts with
    characters beyond Latin script go to the tokenizer whole. Words are split and numbered in Arrow, and ids laid out in
    NumPy. Pieces that come first are joined to long texts, as the library's result for each text costs more than the
    merging of a word, and their ids told apart by their bytes. With ``plain`` special tokens are plain text.
    """

    rare = r"[\t\n\r ] (?:[\t\n\r ]|\z)|[^\t\n\r\x20-\x7e\x{a1}-\x{17f}]|<\|"
    parts = r"(?s)^(?P<stem> [A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]+|)(?P<rest>.*)$"

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        # a byte-level token has a character for each of its bytes
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.pieces = Pieces()

    def encode(self, texts: list[str], letters: int = 1 << 18) -> Iterator[bytes]:
        """Texts are encoded together up to some ``letters``: the library's result takes far more room than its ids."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= letters):
                size += len(texts[upto])
                upto += 1
            for one in self.tokenizer.encode_batch_fast(texts[at:upto], add_special_tokens=False):
                yield array("I", one.ids).tobytes()
            at = upto

    def learn(self, pieces: pa.Array, each: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some different pieces and how many each has: joined where they lead with a blank and end with none, else one by one."""
        joins = pc.match_substring_regex(pieces, r"(?s)\A \S(?:.*\S)?\z").to_numpy(zero_copy_only=False)
        order = np.argsort(~joins, kind="stable")
        joined, alone = pieces.take(pa.array(order[: joins.sum()])), pieces.take(pa.array(order[joins.sum() :])).to_pylist()
        made, sizes = [], []
        for at in range(0, len(joined), each):
            some = joined.slice(at, each)
            (ids,) = self.encode(["".join(some.to_pylist())])
            ends = np.cumsum(self.size[np.frombuffer(ids, np.uint32)])
            want = np.cumsum(pc.binary_length(some).to_numpy())
            stops = np.searchsorted(ends, want)
            if len(ends) > stops[-1] and (ends[stops] == want).all():
                made.append(ids)
                sizes.append(np.diff(stops, prepend=-1))
            else:  # a token reaches over two pieces
                made += self.encode(some.to_pylist())
                sizes.append(np.array([len(x) // 4 for x in made[-len(some) :]]))
        one_by_one = list(self.encode(alone))
        ids = np.frombuffer(b"".join([*made, *one_by_one]), np.uint32)
        size = np.concatenate([*sizes, np.array([len(x) // 4 for x in one_by_one], np.int64)]).astype(np.int32)
        back = np.argsort(order)
        return laid(ids, (np.cumsum(size) - size)[back], size[back]), size[back]

    def __call__(self, texts: list[str], letters: int = 1 << 22) -> list[bytes]:
        """Ids of each text. The words and ids of some texts at a time are held besides what comes out."""
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t) > letters:
                out += self.joined(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self.joined(some)

    def joined(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        rare = pc.match_substring_regex(column, self.rare)
        whole = self.encode(column.filter(rare).to_pylist())
        split = pc.split_pattern(column.filter(pc.invert(rare)), " ")
        put = self.put_together(split.flatten(), split.offsets.to_numpy())
        return [next(whole) if r else next(put) for r in rare.to_pylist()]

    def put_together(self, words: pa.Array, offsets: np.ndarray) -> Iterator[bytes]:
        """Ids of each text from all its words; ``offsets`` tells where each text's words start, and where the last one's end."""
        heads = list(self.encode(words.take(pa.array(offsets[:-1])).to_pylist()))
        coded = words.dictionary_encode()
        none, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        parts = pc.extract_regex(pc.binary_join_element_wise(none, coded.dictionary, blank), self.parts)
        pieces = pa.concat_arrays([parts.field("stem"), parts.field("rest")]).dictionary_encode()
        places = self.pieces.places(pieces.dictionary, self.learn)
        of = places[pieces.indices.to_numpy()].reshape(2, -1).T
        # the ids of each different word, then those of the texts' heads, which no blank leads
        sizes = self.pieces.size[of]
        table = np.append(laid(self.pieces.ids, self.pieces.starts()[of.ravel()], sizes.ravel()), np.frombuffer(b"".join(heads), np.uint32))
        sizes = np.append(sizes.sum(1), [len(h) // 4 for h in heads]).astype(np.int32)
        code = coded.indices.to_numpy().copy()
        code[offsets[:-1]] = len(of) + np.arange(len(heads))
        many = sizes[code]
        ids = laid(table, (np.cumsum(sizes) - sizes)[code], many)
        stops = np.append(0, np.cumsum(many))[offsets].tolist()
        for i, j in pairwise(stops):
            yield ids[i:j].tobytes()


def cut(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int | None = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids: row_no, doc_id, piece, start, length, ids_crc32 (and ids).

    Each document's ids are followed by ``end``. Only longer documents are cut, from the end, so that the first piece
    may be shorter. A null text counts as empty and still has its end id; without an end id it has no piece.
    """
    ship(docs.sparkSession)
    numbered, row = with_row(docs)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = kept(Encoder, tokenizer)
        tail = b"" if end is None else array("I", [end]).tobytes()
        for batch in batches:
            out = []
            for row_no, doc_id, known in zip(batch["row_no"], batch["doc_id"], encode(batch["text"].tolist()), strict=True):
                ids = memoryview(known + tail)
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((row_no, doc_id, piece, start, size, zlib.crc32(part), *([part.cast("I").tolist()] if with_ids else [])))
                    start, piece = start + size, piece + 1
            yield pd.DataFrame(out, columns=names)
        tidy()

    schema = PIECES + (", ids array<long>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    source = numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nullable = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**62))))
    out = nullable.mapInPandas(pieces, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**62), F.col("doc_id")))


def place(pieces: DataFrame, capacity: int = 1024, effort: int = EFFORT) -> DataFrame:
    """Add sequence_id and offset to settled ``pieces``; other columns stay.

    The histogram that goes to the driver has at most ``capacity`` rows and the table of slots that is broadcast at
    most a few for each pattern, whatever the corpus.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, slots, sequence = dict.fromkeys(counts, 0), [], 0
    for many, pattern in sorted(bin_completion(counts, capacity, effort), key=lambda x: x[1], reverse=True):
        offset = 0
        for size, each in pattern:
            slots.append((size, taken[size], taken[size] + many * each, each, sequence, offset))
            taken[size] += many * each
            offset += size * each
        sequence += many
    table = spark.createDataFrame(slots, "length long, _lo long, _hi long, _each long, _first long, _off long")
    rows = sum(counts.values())
    chunk = F.pmod(F.xxhash64("row_no", "piece"), F.lit(max(1, rows // 8192)))
    ranked = numbered_within(pieces, ["length"], chunk, name="_rank", order=[F.col("doc_id"), F.col("row_no"), F.col("piece")])
    joined = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(table["length"])
    index = F.col("_rank") - F.col("_lo")
    joined = joined.withColumn("sequence_id", (F.col("_first") + F.floor(index / F.col("_each"))).cast("long")).withColumn("offset", (F.col("_off") + index % F.col("_each") * F.col("length")).cast("long"))
    return joined.drop("_rank", "_lo", "_hi", "_each", "_first", "_off")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, **how) -> DataFrame:
    """Pack all rows of ``docs``: a row for each piece with its sequence and offset. An empty table gives no rows."""
    return place(settle(cut(docs, tokenizer, capacity, **how), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves from pieces cut with ``with_ids``: sequence_id, ids, doc_ids in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, byte_bpe()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
