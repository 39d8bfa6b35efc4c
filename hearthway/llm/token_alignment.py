"""Alignment of two tokenizers' tokens by lockstep merging, and how often their ids meet over a corpus.

Both tokenizers cut the same bytes, so a document's two lists of byte ends are merged: where two tokens end at the same
byte the document is cut, and the tokens between two cuts are a group, whose A and B tokens are all linked. One NumPy
state vector holds the pointers of all documents of a block (long ones as several stretches) and advances all of them at
each step. A block's links leave it as places in the block's own list of id pairs, so that the corpus-wide counts are
joined to a list for each block, not to each link.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, settle, ship, tidy
from .packing import Encoder, Units

#: Characters of text that are aligned together, and bytes of a stretch that one place of the state vector walks through.
BLOCK, STRETCH = 1 << 22, 1 << 11

#: Links of a group from which its equal ids are counted before they are paired.
WIDE = 1 << 12

BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pair_a array<int>, pair_b array<int>, pair_docs array<long>"
SPANS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, byte_cuts array<int>"


def byte_level() -> dict[str, int]:
    """The characters of byte-level vocabularies and their bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteEncoder(Encoder):
    """Ids of a byte-level vocabulary in which special tokens are plain text, and each id's bytes."""

    def __init__(self, path: str):
        super().__init__(path, plain=True)
        of = byte_level()
        self.bytes = [bytes(of[c] for c in (self.tokenizer.id_to_token(i) or "") if c in of) for i in range(self.tokenizer.get_vocab_size())]


class PieceEncoder:
    """Ids of a sentencepiece model with byte fallback, and each id's bytes.

    Where no piece has a blank behind a character, merges never cross the start of a word, so texts with single blanks
    between words are put together from words.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.units = Units()

    def encode(self, texts: list[str], each: int = 1 << 12) -> Iterator[bytes]:
        for at in range(0, len(texts), each):
            for ids in self.model.encode(texts[at : at + each], num_threads=1):
                yield array("I", ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [not self.by_words or "  " in t or t[:1] == " " or t[-1:] == " " for t in texts]
        parts = [[] if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        missing = self.units.missing({u for p in parts for u in p})
        self.units.learn(missing, list(self.encode(missing)))
        rest = self.encode([t for t, w in zip(texts, whole, strict=True) if w], 1)
        return [next(rest) if w else b"".join(map(self.units.ids.__getitem__, p)) for p, w in zip(parts, whole, strict=True)]


class Merged(NamedTuple):
    """The groups of a block in order: the tokens of group g are those before a_stop[g] that no earlier group has, as with b."""

    a_stop: np.ndarray
    b_stop: np.ndarray


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, stretch: int = STRETCH) -> Merged:
    """Merge the byte ends of all documents of a block, laid end to end; ``starts``: the byte at which each document starts.

    A place of the state is a document, or a stretch of a long one. At each step every place compares the ends of its two
    tokens: the token that ends first gives way to the next; where both end together both do, and the step puts out a cut,
    which links these two tokens and closes their group. Places past their stop leave the state.
    """
    total = int(a_ends[-1]) if len(a_ends) else 0
    inner = np.arange(stretch, total, stretch)
    begin = np.unique(np.concatenate([starts[starts < total], inner])).astype(np.int64)
    stop = np.append(begin[1:], total)
    a_ends, b_ends = np.append(a_ends, total + 1), np.append(b_ends, total + 1)
    ia, ib = np.searchsorted(a_ends, begin, side="right"), np.searchsorted(b_ends, begin, side="right")
    cut_a, cut_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(stop):
        ea, eb = a_ends[ia], b_ends[ib]
        going = np.minimum(ea, eb) <= stop
        if not going.all():
            ia, ib, stop, ea, eb = ia[going], ib[going], stop[going], ea[going], eb[going]
        both = np.flatnonzero(ea == eb)
        cut_a.append(ia[both])
        cut_b.append(ib[both])
        ia, ib = ia + (ea <= eb), ib + (eb <= ea)
    return Merged(np.sort(np.concatenate(cut_a)) + 1, np.sort(np.concatenate(cut_b)) + 1)


def links(groups: Merged, a_ids: np.ndarray, b_ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (document, A id, B id) of all links as sorted numbers doc << 32 | a << 16 | b, and how often each occurs.

    A group of many tokens brings each pair of its different ids once, with the number of its links.
    """
    na, nb = np.diff(groups.a_stop, prepend=0), np.diff(groups.b_stop, prepend=0)
    a_at, b_at, many = groups.a_stop - na, groups.b_stop - nb, na * nb
    small = np.flatnonzero(many <= WIDE)
    group = np.repeat(small, many[small])
    nth = np.arange(len(group)) - np.repeat(np.cumsum(many[small]) - many[small], many[small])
    a, b = a_ids[a_at[group] + nth // nb[group]], b_ids[b_at[group] + nth % nb[group]]
    keys = [doc[group] << 32 | a.astype(np.int64) << 16 | b]
    wide: list[np.ndarray] = []
    for g in np.flatnonzero(many > WIDE):
        ua, ca = np.unique(a_ids[a_at[g] : a_at[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b_ids[b_at[g] : b_at[g] + nb[g]], return_counts=True)
        keys.append((doc[g] << 32 | ua.astype(np.int64)[:, None] << 16 | ub[None]).ravel())
        wide.append((ca[:, None] * cb[None]).ravel())
    if wide:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, inverse, np.concatenate([np.ones(len(keys[0]), np.int64), *wide]))
        return key, times
    keys[0].sort()
    first = np.flatnonzero(np.diff(keys[0], prepend=-1))
    return keys[0][first], np.diff(np.append(first, len(keys[0])))


class Aligner:
    """Both tokenizers in a task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = kept(ByteEncoder, a_path), kept(PieceEncoder, b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in e.bytes], np.int64) for e in (self.a, self.b))
        if len(self.a_size) > 1 << 16 or len(self.b_size) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        # an id in decimal, with what follows it: inside a list, at the end of its side
        self.a_text = [f"{i}{c}" for i in range(len(self.a_size)) for c in ",|"]
        self.b_text = [f"{i}{c}" for i in range(len(self.b_size)) for c in ",;"]

    def agree(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        want = b" " + text.encode()
        return b"".join(map(self.a.bytes.__getitem__, a.tolist())) == want == b"".join(map(self.b.bytes.__getitem__, b.tolist()))

    def block(self, texts: list[str | None], spans: bool = False) -> dict[str, list]:
        """Columns of BLOCKS (and SPANS), without block and doc_id, for each text."""
        a_of, b_of = self.a([" " + (t or "") for t in texts]), self.b([t or "" for t in texts])
        for i, t in enumerate(texts):
            if not t or not self.agree(t, np.frombuffer(a_of[i], np.uint32), np.frombuffer(b_of[i], np.uint32)):
                a_of[i] = b_of[i] = b""
        a_ids, b_ids = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in (a_of, b_of))
        a_until, b_until = (np.cumsum([len(x) // 4 for x in of]) for of in (a_of, b_of))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        groups = lockstep(a_ends, b_ends, np.concatenate([[0], a_ends[a_until[a_until > 0] - 1]]))
        doc = np.searchsorted(a_until, groups.a_stop)
        until = np.searchsorted(doc, np.arange(len(texts)), side="right")
        linked = np.cumsum(np.append(0, np.diff(groups.a_stop, prepend=0) * np.diff(groups.b_stop, prepend=0)))
        key, times = links(groups, a_ids, b_ids, doc)
        pair, place, docs = np.unique(key & 0xFFFFFFFF, return_inverse=True, return_counts=True)
        key_until = np.searchsorted(key >> 32, np.arange(len(texts)), side="right")
        place, times = place.astype("<u4"), times.astype("<u8" if len(times) and times.max() >> 32 else "<u4")

        def parts(until: np.ndarray) -> list[tuple[int, int]]:
            stops = until.tolist()
            return list(zip([0, *stops[:-1]], stops, strict=True))

        n = lambda until: np.diff(until, prepend=0).tolist()
        out = {"n_a": n(a_until), "n_b": n(b_until), "n_groups": n(until), "n_links": n(linked[until])}
        out["groups_sha256"] = self.digests(groups, a_ids, b_ids, until)
        out["places"] = [place[i:j].tobytes() for i, j in parts(key_until)]
        out["times"] = [times[i:j].tobytes() for i, j in parts(key_until)]
        out |= {"pair_a": pair >> 16, "pair_b": pair & 0xFFFF, "pair_docs": docs}
        if spans:
            base = np.append(0, a_ends)[a_until - [len(x) // 4 for x in a_of]]
            out |= {"a_ids": [a_ids[i:j] for i, j in parts(a_until)], "b_ids": [b_ids[i:j] for i, j in parts(b_until)]}
            out |= {name: [x[i:j] - o for (i, j), o in zip(parts(until), offset, strict=True)] for name, x, offset in (("a_cuts", groups.a_stop, np.append(0, a_until[:-1])), ("b_cuts", groups.b_stop, np.append(0, b_until[:-1])), ("byte_cuts", a_ends[groups.a_stop - 1], base))}
        return out

    def digests(self, groups: Merged, a_ids: np.ndarray, b_ids: np.ndarray, until: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups as text; '' without tokens."""
        na, nb = np.diff(groups.a_stop, prepend=0), np.diff(groups.b_stop, prepend=0)
        # the A tokens of a group follow all B tokens of earlier groups, its B tokens follow its A tokens
        code = np.empty(len(a_ids) + len(b_ids), np.int64)
        last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        last_a[groups.a_stop - 1] = last_b[groups.b_stop - 1] = 1
        code[np.arange(len(a_ids)) + np.repeat(groups.b_stop - nb, na)] = 2 * a_ids + last_a
        code[np.arange(len(b_ids)) + np.repeat(groups.a_stop, nb)] = 2 * b_ids + last_b + len(self.a_text)
        text, out, start = self.a_text + self.b_text, [], 0
        for stop in np.append(0, groups.a_stop + groups.b_stop)[until].tolist():
            whole = "".join(map(text.__getitem__, code[start:stop].tolist()))
            out.append(hashlib.sha256(whole[:-1].encode()).hexdigest() if whole else "")
            start = stop
        return out


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Align all rows: a row for each document, and one for each block with its id pairs and the number of its documents that
    hold them linked (``pair_a`` is null in a document's row). ``spans`` adds ids, and the cuts in tokens and bytes."""
    ship(docs.sparkSession)
    schema = f"{BLOCKS}, {SPANS}" if spans else BLOCKS
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def batch(**columns) -> pa.RecordBatch:
        rows = max(len(c) for c in columns.values())
        return pa.RecordBatch.from_arrays([pa.array(columns[n], arrow.field(n).type) if n in columns else pa.nulls(rows, arrow.field(n).type) for n in names], schema=arrow)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for some in batches:
            texts, at = some.column("text").to_pylist(), 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= BLOCK):
                    size += len(texts[upto] or "")
                    upto += 1
                out = aligner.block(texts[at:upto], spans)
                pairs = {n: [out.pop(n)] for n in ("pair_a", "pair_b", "pair_docs")}
                yield batch(block=[block] * (upto - at), doc_id=some.column("doc_id").slice(at, upto - at), **out)
                yield batch(block=[block], **pairs)
                at, block = upto, block + 1
        del aligner
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(align, schema)


def pair_counts(settled: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each id pair is linked, and whether no pair with its A id is in more.

    ``settled``: blocks, written once. Blocks bring each pair once, and an A id has at most a vocabulary's number of pairs.
    """
    each = settled.filter("pair_a is not null").select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("p")).select(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_docs").alias("n"))
    counts = settle(each.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(settled: DataFrame, counts: DataFrame) -> DataFrame:
    """RESULT for each document of ``settled``: counts go to the blocks' lists, and each block's documents meet its list."""
    pairs = settled.filter("pair_a is not null").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "p")).select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    known = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("list_of"), "place", "count", "best")
    docs = settled.filter("pair_a is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        at = known.column("place").to_numpy()
        count[at], best[at] = known.column("count").to_numpy(), known.column("best").to_numpy()
        n_best, count_sum = [], []
        for place, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist(), strict=True):
            of = np.frombuffer(place, "<u4")
            many = np.frombuffer(times, "<u8" if len(times) > len(place) else "<u4").astype(np.int64)
            n_best.append(int((best[of] * many).sum()))
            count_sum.append(int((count[of] * many).sum()))
        out = docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.select(names)

    return docs.groupBy("block").cogroup(known.groupBy("list_of")).applyInArrow(score, RESULT)


def align(docs: DataFrame, a_path: str, b_path: str, **columns) -> DataFrame:
    """RESULT for each row of ``docs``, in which a null or empty text, or one whose tokens do not give back its bytes, has none.

    Rows with equal or null ids stay apart, an empty table gives no rows, and other columns are not read. Very long texts
    are blocks of their own. An id pair counts once for each document that links it.
    """
    settled = settle(blocks(docs, a_path, b_path, **columns), "aligned")
    return scored(settled, settle(pair_counts(settled), "pair-ranks"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
