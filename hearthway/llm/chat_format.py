"""Chat formatting as prefix trees: turns that conversations share from their start on are emitted once.

A node is a turn with all turns before it; conversations with the same first turn are a tree. Paths (different
conversations, as lists of digests) are sorted, so that the nodes of a tree come depth first: a node belongs to the first
path that has it. Its tokens lie behind those of the paths before in its tree; it carries the position id of its first
token and the intervals of the tree in which its ancestors' tokens lie, to which it may attend beside itself.

Template: ``<turn>role<text>text</turn>``. In roles and texts a backslash is doubled, and a control string gets one behind
its ``<``, so the control strings themselves occur nowhere but as control.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each, forget, kept, scan, settle, ship, spread_join, tidy
from .conversation_repair import in_order
from .packing import byte_bpe
from .token_alignment import ByteEncoder

OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
CONTROL = re.compile(r"<(/?turn|text)>")

#: The role whose texts are under the loss mask.
LEARNED = "assistant"

#: Paths whose lengths are summed together before trees are laid out: those with the same place but for so many bits.
CHUNK_BITS = 12


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1>", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, middle, rest = formatted.partition(TEXT)
    if not (middle and head.startswith(OPEN) and rest.endswith(CLOSE)) or CONTROL.search(head[len(OPEN) :] + rest[: -len(CLOSE)]):
        raise ValueError(f"not one turn: {formatted[:80]!r}")
    return unescape(head[len(OPEN) :]), unescape(rest[: -len(CLOSE)])


def turns_of(df: DataFrame) -> DataFrame:
    """conv (the id as text, one space for null), turn, role and text (empty for null)."""
    return df.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])


def chained(digests: pd.Series) -> pd.Series:
    """For each turn of a path a digest of it and all before it."""
    out = []
    for path in digests:
        so_far, keys = b"", []
        for digest in path:
            so_far = hashlib.sha256(so_far + digest.encode()).digest()
            keys.append(so_far.hex()[:32])
        out.append(keys)
    return pd.Series(out)


def tokenised(contents: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, ids, length, loss_from, loss_to) of different turns: head, text and tail are encoded by themselves, so that the
    loss mask is a span of whole tokens (an empty one for other roles)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept(ByteEncoder, tokenizer)
        for batch in batches:
            heads = encoder([f"{OPEN}{escape(r)}{TEXT}" for r in batch["role"]])
            bodies, (tail,) = encoder([escape(t) for t in batch["text"]]), encoder([CLOSE])
            rows = []
            for digest, role, head, body in zip(batch["digest"], batch["role"], heads, bodies, strict=True):
                ids = array("I", head + body + tail)
                start, stop = (len(head) // 4, (len(head) + len(body)) // 4) if role == LEARNED else (0, 0)
                rows.append((digest, list(ids), len(ids), start, stop))
            yield pd.DataFrame(rows, columns=["digest", "ids", "length", "loss_from", "loss_to"])
        tidy()

    return contents.select("digest", "role", "text").mapInPandas(encode, "digest string, ids array<int>, length long, loss_from long, loss_to long")


PATH = "at long, path string, tree string, starts array<long>, nodes array<struct<prefix:string,position:long,sees:array<struct<from:long,to:long>>>>"


def attention(row: dict) -> dict:
    """For the nodes that a path owns: their first position, and the spans of all nodes before them on the path, joined where
    one follows the other."""
    position, sees, nodes = 0, [], []
    for step in row["steps"]:
        start, length = int(step["start"]), int(step["length"])
        if step["owner"] == row["at"]:
            nodes.append((step["prefix"], position, list(sees)))
        if sees and sees[-1][1] == start:
            sees[-1] = (sees[-1][0], start + length)
        else:
            sees.append((start, start + length))
        position += length
    return {**row, "starts": [int(s["start"]) for s in row["steps"]], "nodes": nodes}


def prefix_trees(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Format rows of ``turns_of``; returns the nodes and the conversations.

    Nodes: tree, start (place of the first token in the tree's sequence), ids, length, position (its position id), loss_from
    and loss_to (tokens of the node under the loss mask), sees (intervals of the sequence of its ancestors' tokens). In
    order of start the ids of a tree are its sequence, without a gap. Conversations: conv, tree, starts of its nodes.

    Turns without a number come first, rows of a turn follow role and text; equal rows are turns of their own. Empty
    texts have no tokens of their own, very long ones are one node, an empty table gives no tree. A conversation's digests
    (not its texts) are held together, 32 letters a turn.
    """
    spark = turns.sparkSession
    ship(spark)
    ordered = in_order(turns.withColumn("digest", F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)))
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x.digest)
    of = settle(ordered.groupBy("conv").agg(path.alias("digests")).withColumn("path", F.sha2(F.array_join("digests", ""), 256)), "chat-paths")
    paths = of.groupBy("path").agg(F.first("digests").alias("digests"), F.count(F.lit(1)).alias("conversations"))
    chain = F.pandas_udf(chained, "array<string>")
    ranged = paths.repartitionByRange("digests").sortWithinPartitions("digests").withColumn("at", F.monotonically_increasing_id())
    paths = settle(ranged.withColumn("prefixes", chain("digests")), "chat-sorted")

    walks = paths.select("at", "path", F.col("prefixes")[0].alias("tree"), F.posexplode(F.arrays_zip("digests", "prefixes")).alias("k", "s"))
    walks = walks.select("at", "path", "tree", "k", F.col("s.digests").alias("digest"), F.col("s.prefixes").alias("prefix"))
    nodes = settle(walks.groupBy("prefix").agg(F.min("at").alias("owner"), F.first("k").alias("k"), F.first("digest").alias("digest"), F.first("tree").alias("tree"), F.count(F.lit(1)).alias("paths")), "chat-nodes")

    contents = tokenised(ordered.groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text")), tokenizer)
    times = nodes.groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
    contents = settle(contents.join(times, "digest"), "chat-contents")
    forget(ordered)
    filled = settle(spread_join(nodes, contents, ["digest"], "times", F.col("prefix")).drop("times"), "chat-filled")
    forget(contents)
    forget(nodes)
    laid = settle(laid_out(filled), "chat-starts")  # prefix, start
    spans = settle(filled.select("prefix", "owner", "length", "paths").join(laid, "prefix"), "chat-spans")

    met = spread_join(walks.select("at", "path", "tree", "k", "prefix"), spans, ["prefix"], "paths", F.col("at"))
    steps = F.array_sort(F.collect_list(F.struct("k", "prefix", "start", "length", "owner"))).alias("steps")
    seen = settle(each(met.groupBy("at", "path", "tree").agg(steps), attention, PATH), "chat-attention")
    owned = seen.select(F.explode("nodes").alias("n")).select("n.*")
    out = filled.join(laid, "prefix").join(owned, "prefix").select("tree", "start", "ids", "length", "position", "loss_from", "loss_to", "sees")
    ends = settle(seen.select("path", "tree", "starts").join(paths.select("path", "conversations"), "path"), "chat-ends")
    tokens = settle(out, "chat-tokens")
    for done in (paths, filled, laid, spans, seen):
        forget(done)
    return tokens, spread_join(of.select("conv", "path"), ends, ["path"], "conversations", F.col("conv")).select("conv", "tree", "starts")


def laid_out(filled: DataFrame) -> DataFrame:
    """(prefix, start): where each node's tokens begin in its tree.

    Lengths are summed for the paths that own nodes, then for chunks of such paths, so that no task sums a whole tree.
    """
    chunk = F.shiftright("owner", CHUNK_BITS).alias("chunk")
    own = settle(filled.groupBy("tree", "owner", chunk).agg(F.sum("length").alias("long")), "chat-lengths")

    def before(length: str, within: list[str], order: str) -> Column:
        return F.coalesce(F.sum(length).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    chunks = own.groupBy("tree", "chunk").agg(F.sum("long").alias("long")).select("tree", "chunk", before("long", ["tree"], "chunk").alias("_chunks"))
    paths = own.select("tree", "owner", "chunk", before("long", ["tree", "chunk"], "owner").alias("_paths")).join(chunks, ["tree", "chunk"])
    nodes = filled.select("prefix", "owner", "k", before("length", ["owner"], "k").alias("_nodes"))
    return nodes.join(paths, "owner").select("prefix", (F.col("_chunks") + F.col("_paths") + F.col("_nodes")).alias("start"))


def read_back(nodes: DataFrame, conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv, k, role, text, learned (the text under the loss mask, unescaped) and chars (of the formatted turn), from tokens alone."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = kept(ByteEncoder, tokenizer).bytes
        say = lambda ids: b"".join(map(of.__getitem__, ids)).decode()
        for batch in batches:
            rows = []
            for tree, start, ids, a, b in batch[["tree", "start", "ids", "loss_from", "loss_to"]].itertuples(index=False):
                whole = say(ids)
                rows.append((tree, start, *parse(whole), unescape(say(ids[a:b])), len(whole)))
            yield pd.DataFrame(rows, columns=["tree", "start", "role", "text", "learned", "chars"])
        tidy()

    ship(nodes.sparkSession)
    said = nodes.select("tree", "start", "ids", "loss_from", "loss_to").mapInPandas(decode, "tree string, start long, role string, text string, learned string, chars long")
    steps = settle(conversations.select("conv", "tree", F.posexplode("starts").alias("k", "start")), "chat-steps")
    times = steps.groupBy("tree", "start").agg(F.count(F.lit(1)).alias("times"))
    said = settle(said.join(times, ["tree", "start"]), "chat-said")
    return spread_join(steps, said, ["tree", "start"], "times", F.col("conv")).select("conv", "k", "role", "text", "learned", "chars")


def summed(state: list | None, row: dict) -> tuple[list, None]:
    state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
    state[0] += 1
    state[1].update(f"{row['role']}\n{row['text']}\n".encode())
    state[2] += len(row["learned"])
    state[3].update(row["learned"].encode())
    state[4] += int(row["chars"])
    return state, None


def told(conv: str, state: list) -> dict:
    return {"conv_id": None if conv == " " else int(conv), "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

#: A conversation that holds what templates trip over.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    probe = spark.createDataFrame([(str(PROBE_ID), 0, "user", PROBE), (str(PROBE_ID), 1, "assistant", PROBE)], "conv string, turn long, role string, text string")
    nodes, conversations = prefix_trees(given.unionByName(probe), byte_bpe())
    said = read_back(nodes, conversations, byte_bpe())
    return scan(said, "conv", [F.col("k").asc()], summed, RESULT, told)


OP13_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(replace(role, '\', '\\'), '<(/?turn|text)>', '<\\\1>', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '<(/?turn|text)>', '<\\\1>', 'g')) + 19 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
