"""Substring deduplication by content-defined chunking.

A gear rolling hash cuts each text where the hash of the last 32 bytes is small, so the cuts depend on nearby content
alone and settle again soon after an insertion. Chunks are deduplicated by digest over the whole corpus: the first
occurrence (smallest document, then position) stays. Runs of repeated chunks make up the repeated passages.

An exact check follows: each run is extended on both sides by all bytes that also equal the text around the place where
its first and its last chunk stay, and is a passage if it then has more than 50 words. Texts around places are read as far
as a chunk may reach; runs that are equal so far are read on, eight times as far each time, until they differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import forget, settle, settled_rows, ship, spread_join, tidy, unused, with_row

#: Bytes of a chunk at least, on average beyond that, and at most (but for the end of its last character).
LEAST, MEAN, MOST = 16, 24, 128
#: Bytes that the chunks of a run must hold for it to be extended, words that a passage has at least.
RUN, WORDS = 64, 51


def _gear() -> np.ndarray:
    """A 32-bit number for each byte value, from its hash."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=10) for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the gear hash h = 2h + GEAR[byte] (mod 2**32); so it covers the last 32 bytes.

    Sums over 2, 4, ... 32 bytes are put together from sums over half as many.
    """
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunk_ends(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Where the chunks of UTF-8 ``data`` end: after each byte whose hash is below 2**32 / mean and ``least`` bytes on.

    A chunk without such a byte ends after ``most``. An end within a character moves behind it.
    """
    if not data:
        return []
    cuts = (np.flatnonzero(gear_hashes(data) < np.uint32(2**32 // mean)) + 1).tolist()
    ends, at, size = [], 0, len(data)
    for c in [*cuts, size]:
        while c - at > most:
            at += most
            while at < size and data[at] & 0xC0 == 0x80:
                at += 1
            ends.append(at)
        if c - at >= least and c < size:
            while c < size and data[c] & 0xC0 == 0x80:
                c += 1
            ends.append(c)
            at = c
    if at < size:
        ends.append(size)
    return ends


def chunks(docs: DataFrame, least: int = LEAST, mean: int = MEAN, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_no, doc_id, t1 and t2 (digest of the text), starts and ends (bytes of UTF-8), d1 and d2 (digests) of the chunks."""
    ship(docs.sparkSession)
    numbered, row = (docs, row_col) if row_col else with_row(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole, starts, ends, digests = [], [], [], []
            for text in batch["text"]:
                data = text.encode()
                e = chunk_ends(data, least, mean, most)
                s = [0, *e[:-1]] if e else []
                starts.append(np.array(s, dtype=np.int32))
                ends.append(np.array(e, dtype=np.int32))
                digests.append(_halves([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(s, e, strict=True)]))
                whole.append(xxhash.xxh3_128_digest(data))
            texts = _halves(whole)
            yield pd.DataFrame({"row_no": batch["row_no"], "doc_id": batch["doc_id"].astype("Int64"), "t1": texts[0], "t2": texts[1], "starts": starts, "ends": ends, "d1": [d[0] for d in digests], "d2": [d[1] for d in digests]})
        tidy()

    source = numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, "row_no long, doc_id long, t1 long, t2 long, starts array<int>, ends array<int>, d1 array<long>, d2 array<long>")


def _halves(digests: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit numbers from digests of 16 bytes."""
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T.copy()


def repeated_chunks(table: DataFrame) -> DataFrame:
    """A row for each occurrence of a chunk that occurs more than once: row_no, start, end, n, removed, keep_doc_id,
    keep_row and keep_start (where it stays)."""
    # half a digest tells most single chunks apart, so that only what may be repeated is shuffled with its place
    twice = settle(table.select(F.explode("d1").alias("d1")).groupBy("d1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1"), "chunk-twice")
    words = table.sparkSession.sparkContext.broadcast(BlockedBloom.build(twice, "d1", hashed=True).words)
    arrays = ["starts", "ends", "d1", "d2"]

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = BlockedBloom(words.value)
        for batch in batches:
            if batch.empty:
                continue
            hit = np.split(bloom.passes(np.concatenate(batch["d1"].tolist())), np.cumsum([len(d) for d in batch["d1"]])[:-1])
            yield batch.assign(**{c: [x[h] for x, h in zip(batch[c], hit, strict=True)] for c in arrays}).astype({"doc_id": "Int64"})
        tidy()

    open_ = table.select("row_no", "doc_id", *arrays).mapInPandas(some, "row_no long, doc_id long, starts array<int>, ends array<int>, d1 array<long>, d2 array<long>")
    maybe = settle(open_.select("row_no", "doc_id", F.inline(F.arrays_zip(*[F.col(c).alias(c.rstrip("s")) for c in arrays]))), "chunk-maybe")
    first = F.min(F.struct("doc_id", "row_no", "start")).alias("first")
    repeated = settle(maybe.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1"), "chunk-repeats")
    found = spread_join(maybe, repeated, ["d1", "d2"], "n", F.hash("row_no", "start"))
    away = (F.col("row_no") != F.col("first.row_no")) | (F.col("start") != F.col("first.start"))
    found = found.select("row_no", "start", "end", "n", away.alias("removed"), F.col("first.doc_id").alias("keep_doc_id"), F.col("first.row_no").alias("keep_row"), F.col("first.start").alias("keep_start"))
    # a document's chunks meet in one task: they are no more than its text has
    found = settle(found.withColumn("island", _island()), "chunk-found")
    for done in (twice, maybe, repeated):
        forget(done)
    return found


def _island() -> Column:
    """A number for each run of chunks that follow each other, of those that stay here or those that stay elsewhere."""
    w = W.partitionBy("row_no", "removed").orderBy("start")
    return F.sum(F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)).over(w).cast("int")


def contexts(docs: DataFrame, asked: DataFrame, text_col: str, most: int) -> DataFrame:
    """(t1, t2, at, left, bytes, words) for asked(t1, t2, at, left): the text before (left) or after a place, one byte
    beyond it and ``most`` bytes and one more on its side, and how many words begin before it. Equal texts are read once."""
    wanted = settle(asked.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "left")).alias("places")), "texts-asked")
    words = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(wanted, "t1", hashed=True).words)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = BlockedBloom(words.value)
        for batch in batches:
            data = [t.encode() for t in batch["text"]]
            t1, t2 = _halves([xxhash.xxh3_128_digest(d) for d in data])
            hit = np.flatnonzero(bloom.passes(t1))
            yield pd.DataFrame({"t1": t1[hit], "t2": t2[hit], "data": [data[i] for i in hit]})
        tidy()

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(read, "t1 long, t2 long, data binary")
    once = texts.groupBy("t1", "t2").agg(F.max("data").alias("data"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t1, t2, data, places in zip(batch["t1"], batch["t2"], batch["data"], batch["places"], strict=True):
                begins = _word_starts(data)
                for place in places:
                    at, left = place["at"], place["left"]
                    part = data[max(0, at - most - 1) : at + 1] if left else data[at - 1 : at + most + 1]
                    out.append((t1, t2, at, left, part, int(np.searchsorted(begins, at))))
            yield pd.DataFrame(out, columns=["t1", "t2", "at", "left", "bytes", "words"])

    return once.join(wanted, ["t1", "t2"]).mapInPandas(cut, "t1 long, t2 long, at int, left boolean, bytes binary, words int")


def _word_starts(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8)
    solid = ~((x == 32) | ((x >= 9) & (x <= 13)))
    return np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))


def extension(own: bytes, kept: bytes, left: bool, start: bool, most: int = MOST) -> tuple[int, int, bool]:
    """Bytes that a run grows by on one side, the words that begin there (on the left, also one that is cut), and whether all
    ``most`` bytes are equal, so that it may grow further.

    ``own`` and ``kept`` are contexts; ``start``: the left one reaches the start of the text. Characters stay whole.
    """
    a, b = (own[:-1], kept[:-1]) if left else (own[1:], kept[1:])
    low, high = 0, max(0, min(len(a) - (0 if start else 1), len(b), most)) if left else min(len(a), len(b), most)
    while low < high:
        m = (low + high + 1) // 2
        if (a[len(a) - m :] == b[len(b) - m :]) if left else a[:m] == b[:m]:
            low = m
        else:
            high = m - 1
    m, full = low, low == most
    if left:
        while m and a[len(a) - m] & 0xC0 == 0x80:
            m -= 1
        return m, len(a[len(a) - m :].split()) if m else 0, full
    while m and m < len(a) and a[m] & 0xC0 == 0x80:
        m -= 1
    part = a[:m]
    return m, len(part.split()) - (1 if m and not part[:1].isspace() and not own[:1].isspace() else 0), full


def _grown(edges: DataFrame, docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """``edges`` with own_words and g (grown, words, full) from ``most`` bytes around their places."""
    columns = edges.columns
    asked = edges.select("t1", "t2", "at", "left").unionByName(edges.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("keep_at").alias("at"), "left"))
    around = settle(contexts(docs, asked, text_col, most), "run-contexts")
    for names, held in ((["t1", "t2", "at"], "own"), (["k1", "k2", "keep_at"], "kept")):
        part = around.withColumnsRenamed({"t1": names[0], "t2": names[1], "at": names[2], "bytes": held, "words": f"{held}_words"})
        groups = settle(edges.groupBy(*names, "left").agg(F.count(F.lit(1)).alias("n")).join(part, [*names, "left"]), f"run-{held}")
        edges = spread_join(edges, groups, [*names, "left"], "n", F.hash("row_no", "island")).drop("n")

    @F.pandas_udf("grown int, words int, full boolean")
    def grow(own: pd.Series, kept: pd.Series, left: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extension(*x[:3], x[3] <= most, most) for x in zip(own, kept, left, at, strict=True)], columns=["grown", "words", "full"])

    return edges.select(*columns, "own_words", grow("own", "kept", "left", "at").alias("g"))


def extended(runs: DataFrame, ids: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Add before, after (bytes that a run grows by) and words to runs(row_no, island, a, b, first, last)."""
    side = lambda left, at, kept: F.struct(F.lit(left).alias("left"), at.cast("int").alias("at"), kept["row"].alias("keep_row"), kept["at"].cast("int").alias("keep_at"))
    edges = runs.select("row_no", "island", F.inline(F.array(side(True, F.col("a"), F.col("first")), side(False, F.col("b"), F.col("last")))))
    edges = settle(edges.join(ids.select("row_no", "t1", "t2"), "row_no"), "run-edges")
    keepers = edges.groupBy("keep_row").agg(F.count(F.lit(1)).alias("n")).join(ids.select(F.col("row_no").alias("keep_row"), F.col("t1").alias("k1"), F.col("t2").alias("k2")), "keep_row")
    edges = settle(spread_join(edges, settle(keepers, "run-keepers"), ["keep_row"], "n", F.hash("row_no", "at")).drop("n", "keep_row"), "run-edges")
    most, done = MOST, []
    while True:
        grown = settle(_grown(edges, docs, text_col, most), "run-grown")
        done.append(grown.filter("not g.full"))
        edges = grown.filter("g.full").select(*edges.columns)
        if edges.isEmpty():
            break
        most *= 8
    grown = reduce(DataFrame.unionByName, done).select("row_no", "island", "left", F.col("own_words").alias("upto"), "g")
    on, off = F.col("left"), ~F.col("left")
    total = F.max(F.when(off, F.col("upto"))) - F.max(F.when(on, F.col("upto"))) + F.sum("g.words")
    sums = grown.groupBy("row_no", "island").agg(F.max(F.when(on, F.col("g.grown"))).alias("before"), F.max(F.when(off, F.col("g.grown"))).alias("after"), total.cast("long").alias("words"))
    return runs.join(sums, ["row_no", "island"])


def repeated_passages(docs: DataFrame, words: int = WORDS, run: int = RUN, text_col: str = "text", **how) -> DataFrame:
    """A row for each passage of at least ``words`` words that repeats, where it repeats (removed) and where it stays.

    row_no, doc_id, start and length (bytes of UTF-8, whole characters), n_chunks, words, copies (occurrences of its
    rarest chunk), removed (the passage stays elsewhere) and keep_doc_id (the document where its first chunk stays). A
    passage's chunks may stay in several documents; where chunks stay, they make up rows with removed = false and
    without a count of words. Passages of which whole chunks hold less than ``run`` bytes are not found. Null and empty
    texts have no chunks; repeated rows repeat each other's passages; an empty table has none. Digests have 128 bits.
    """
    table = settle(chunks(docs, text_col=text_col, **how), "chunks")
    ids = settle(table.select("row_no", "doc_id", "t1", "t2"), "chunk-rows")
    found = repeated_chunks(table)
    forget(table)
    elsewhere, here = found.filter("removed"), found.filter("not removed")
    first = F.min_by(F.struct(F.col("keep_row").alias("row"), F.col("keep_start").alias("at"), "keep_doc_id"), "start").alias("first")
    last = F.max_by(F.struct(F.col("keep_row").alias("row"), (F.col("keep_start") + F.col("end") - F.col("start")).alias("at")), "start").alias("last")
    sums = [F.min("start").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n_chunks"), F.min("n").alias("copies")]
    runs = settle(elsewhere.groupBy("row_no", "island").agg(*sums, first, last).filter(F.col("b") - F.col("a") >= run), "chunk-runs")
    passages = settle(extended(runs, ids, docs, text_col).filter(F.col("words") >= words), "passages")
    gone = passages.select("row_no", (F.col("a") - F.col("before")).alias("start"), (F.col("b") - F.col("a") + F.col("before") + F.col("after")).alias("length"), "n_chunks", "words", "copies", F.lit(True).alias("removed"), F.col("first.keep_doc_id").alias("keep_doc_id"))
    # where the chunks of those passages stay
    pointed = elsewhere.join(passages.select("row_no", "island"), ["row_no", "island"], "left_semi").select(F.col("keep_row").alias("row_no"), F.col("keep_start").alias("start")).distinct()
    stays = here.join(pointed, ["row_no", "start"], "left_semi").drop("island").withColumn("island", _island())
    kept = stays.groupBy("row_no", "island").agg(*sums, F.first("keep_doc_id").alias("keep_doc_id")).filter(F.col("b") - F.col("a") >= run)
    kept = kept.select("row_no", F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("length"), "n_chunks", F.lit(None).cast("long").alias("words"), "copies", F.lit(False).alias("removed"), "keep_doc_id")
    both = gone.unionByName(kept).join(ids.select("row_no", "doc_id"), "row_no")
    return both.select("row_no", "doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "n_chunks", "words", "copies", "removed", "keep_doc_id")


def strip_repeats(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its columns and rows, but without passages that stay elsewhere. Null texts stay null."""
    numbered, row = settled_rows(docs)
    found = repeated_passages(numbered, text_col=text_col, row_col=row, **how).filter("removed")
    spans = settle(found.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans")), "spans")

    @F.pandas_udf("string")
    def without(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(text: str | None, starts: np.ndarray | None, lengths: np.ndarray | None) -> str | None:
            if text is None or starts is None:
                return text
            data, at, kept = text.encode(), 0, []
            for s, n in zip(starts, lengths, strict=True):
                kept.append(data[at:s])  # nothing, where passages overlap
                at = max(at, s + n)
            return b"".join([*kept, data[at:]]).decode()

        return pd.Series([one(*x) for x in zip(texts, starts, lengths, strict=True)])

    held = unused(numbered, "spans")
    joined = numbered.join(spans.select(F.col("row_no").alias(row), F.col("spans").alias(held)), row, "left")
    text = without(F.col(text_col), F.col(f"{held}.start"), F.col(f"{held}.length"))
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_passages(docs).select("doc_id", "start", "length", "n_chunks", "words", "copies", "removed", "keep_doc_id")
