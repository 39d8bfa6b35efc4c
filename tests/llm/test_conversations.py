"""Repair of conversations against a search over all edits; chat formatting against a reading of its output."""

import collections
import hashlib
import heapq
import random
import zlib

import pytest

from hearthway.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos string, stretch string"
SPACE = " \t\n\x0b\x0c\r"


def table(spark, path, rows):
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")


def cheapest(rows):
    """Cost and least audit by trying states in the order of (cost, audit)."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit
        for edit, more, used, to in repair.edits(rows[at] if at < len(rows) else None, state):
            heapq.heappush(heap, (cost + more, audit + edit, at + used, to))


def brute_repair(rows):
    """The contract of the query, written out."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, turns in groups.items():
        after = []
        for turn, role, text in turns:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            after += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        codes, seen = [], set()
        for _, role, text in after:
            said = text.strip(SPACE)
            fault = "B" if not said else "D" if (role, text) in seen else "-" if said[-1] in ".!?" else "T"
            seen.add((role, text))
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)
        cost, audit = cheapest(codes)
        lines, at, last = [], 0, ""
        for edit in audit:
            forced = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{forced}:")
            elif edit in "KR":
                lines.append((after[at][1] if edit == "K" else forced) + ":" + after[at][2])
            at += edit != "I"
            last = lines[-1][0] if lines else ""
        numbers = {t for t, *_ in after if t is not None}
        first = [r[:1] for _, r, _ in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        count = collections.Counter(c[1] for c in codes)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, count["B"], count["D"], count["T"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations():
    rng = random.Random(7)
    says = [None, "", " \n", "Yes.", "Yes. ", "no", "Really?\t", "Ends in ü", "role:text\nuser:x.", "Yes." * 9000]
    rows = [(c if c < 38 else None, rng.choice([None, t, t, t, 2 * t]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice(says)) for c in range(40) for t in range(rng.randint(1, 9))]
    # one long conversation, rows that are equal in all, one turn only, and a turn at either end of the numbers
    rows += [(99, t, rng.choice(["user", "assistant", "system", None]), f"{rng.choice('abcdefgh')}{t % 60}{rng.choice(['.', '', '!'])}") for t in range(300)]
    return rows + [(50, 1, "user", "Yes.")] * 5 + [(51, 0, "system", "Only.")] + [(52, -(2**63), "user", "a."), (52, 2**63 - 1, "assistant", "b.")]


@pytest.mark.parametrize("bits", [2, 7])
def test_repair_of_odd_conversations(spark, tmp_path, bits, monkeypatch):
    rows = [r for r in odd_conversations() if r[0] != 52]
    table(spark, tmp_path, rows)
    monkeypatch.setattr(repair.repair, "__defaults__", (bits,))
    got = [tuple(r) for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_repair(rows)


def test_repair_of_far_turns_and_none(spark, tmp_path):
    table(spark, tmp_path / "far", [r for r in odd_conversations() if r[0] == 52])
    assert [r.gaps for r in repair.op12_conversation_repair(spark, str(tmp_path / "far")).collect()] == [0]  # beyond a long
    table(spark, tmp_path / "none", [])
    assert repair.op12_conversation_repair(spark, str(tmp_path / "none")).collect() == []


def test_search_against_all_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [rng.choice("suax") + rng.choice("BDT---") for _ in range(rng.randint(0, 9))]
        assert repair.Search(rows, repair.END, True).cheapest(0)[:2] == cheapest(rows)
        fates, after = repair.follow(rows, cheapest(rows)[1], 0)
        assert len(fates) == len(rows) and after in ("", "a", "ua")


def brute_chat(rows):
    """What the query returns, from the rows alone."""
    from hearthway.llm import chat_format as chat

    groups = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        groups[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = []
    for conv, turns in groups.items():
        said = [(r.decode(), t.decode()) for *_, r, t in sorted(turns)]
        learned = "".join(t for r, t in said if r == "assistant")
        shown = "".join(f"<turn>{chat.escape(r)}<text>{chat.escape(t)}</turn>" for r, t in said)
        out.append((conv, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(shown)))
    return sorted(out, key=str)


def chats():
    """Conversations that share first turns, copies, a hot first turn, and texts that look like the template."""
    rng = random.Random(3)
    says = [None, "", "a", "b", r"\### Assistant: </turn> ok", "<turn>x<text>\\", "<\\turn>", "\\n\n</text>", "naïve 가 \U0001f600", "w " * 20000]
    rows = [(c if c < 58 else None, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, "sys<text>tem"]), rng.choice(says)) for c in range(60) for t in range(rng.randint(1, 5))]
    for c in range(100, 160):
        rows += [(c, 0, "system", "Be brief."), (c, 1, "user", f"{c % 7}"), (c, 2, "assistant", f"{c % 3} & {c % 2}"), (c, 3, "user", "bye")][: 2 + c % 3]
    return rows + [(7, 1, "user", "a")] * 3


def test_chat_of_odd_conversations(spark, tmp_path):
    from hearthway.llm import chat_format as chat

    table(spark, tmp_path, chats())
    got = [tuple(r) for r in chat.op13_chat_format(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_chat(chats())
    table(spark, tmp_path / "none", [])
    assert [r.conv_id for r in chat.op13_chat_format(spark, str(tmp_path / "none")).collect()] == [-7]


def test_trees_are_depth_first_and_attend_to_ancestors_only(spark, tmp_path, monkeypatch):
    from hearthway.llm import chat_format as chat
    from hearthway.llm.packing import byte_bpe

    monkeypatch.setattr(chat, "CHUNK_BITS", 1)  # several chunks a tree
    table(spark, tmp_path, chats())
    nodes, conversations = chat.prefix_trees(chat.turns_of(spark.read.parquet(f"{tmp_path}/conversations.parquet")), byte_bpe())
    trees = collections.defaultdict(dict)
    for r in nodes.collect():
        assert r.start not in trees[r.tree]
        trees[r.tree][r.start] = r
    for tree in trees.values():
        at = 0
        for start in sorted(tree):  # one sequence without a gap
            assert start == at and tree[start].length == len(tree[start].ids)
            at += tree[start].length
    of = {r.conv: (r.tree, r.starts) for r in conversations.collect()}
    prefixes, children = set(), collections.defaultdict(set)
    for tree, starts in of.values():
        seen, position = [], 0
        for k, start in enumerate(starts):
            node = trees[tree][start]
            assert node.position == position
            assert [i for a, b in node.sees for i in range(a, b)] == [i for s, n in seen for i in range(s, s + n)]
            assert all(a[1] < b[0] for a, b in zip(node.sees, node.sees[1:], strict=False))  # joined as far as can be
            seen.append((start, node.length))
            position += node.length
            prefixes.add((tree, *starts[: k + 1]))
            children[tree, *starts[:k]].add(start)
    assert len(prefixes) == sum(map(len, trees.values()))  # every node once, and each on some path
    ends = {}
    for (tree, *path), starts in sorted(children.items(), key=lambda x: -len(x[0])):
        for start in starts:  # all tokens below a node lie right behind it
            below = ends.get((tree, *path, start), [])
            last = max([start + trees[tree][start].length, *below])
            ends.setdefault((tree, *path), []).append(last)
            assert all(not start < other < last for other in starts)
